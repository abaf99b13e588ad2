"""Cleaning, preparation and profiling queries."""

from __future__ import annotations

from itertools import combinations

from pyspark.sql import functions as F

from wardenframe.functions import columns as fx
from wardenframe.operators import cleaning as cl
from wardenframe.operators import profiling as pr
from wardenframe.plans import views
from wardenframe.plans.registry import query
from wardenframe.sources.tables import read_table

NUMBER_SQL = "CASE WHEN regexp_matches(trim({c}), '^[+-]?([0-9]+[.]?[0-9]*|[.][0-9]+)([eE][+-]?[0-9]+)?$') THEN TRY_CAST(trim({c}) AS DOUBLE) END"
PLAN_NUMBERS = (
    "received_in_network", "received_out_network", "denied_in_network", "denied_out_network", "resubmitted",
    "internal_appeals", "internal_overturned", "avg_monthly_enrollment", "avg_monthly_disenrollment",
)


def _per_column(columns, select: str, source: str) -> str:
    return " UNION ALL ".join("SELECT " + select.format(c=c) + f" FROM {source}" for c in columns)


# ---------------------------------------------------------------- cleaning


@query(
    "claim_amounts_cast", "D1",
    views.with_views("claims_raw") + f" SELECT claim_id, provider_id, {NUMBER_SQL.format(c='claim_amount')} AS claim_amount FROM claims_raw",
)
def claim_amounts_cast(spark, sf_dir):
    return cl.numeric_columns(views.claims_raw(spark, sf_dir).select("claim_id", "provider_id", "claim_amount"), ["claim_amount"])


def _starred(spark, sf_dir):
    token = "CASE npi % 3 WHEN 0 THEN '*' WHEN 1 THEN '**' ELSE '***' END"
    return views.prescriber_drug_year(spark, sf_dir).selectExpr(
        "npi", "brand", "data_year",
        f"CASE WHEN tot_clms < 3 THEN {token} ELSE CAST(CAST(tot_benes AS INT) AS STRING) END AS tot_benes",
        f"CASE WHEN tot_clms < 2 THEN {token} ELSE CAST(CAST(tot_clms AS INT) AS STRING) END AS tot_clms",
    )


_STARRED_SQL = views.with_views("prescriber_drug_year") + (
    ", starred AS (SELECT npi, brand, data_year, CASE WHEN tot_clms < 3 THEN CASE npi % 3 WHEN 0 THEN '*' WHEN 1 THEN '**' ELSE '***' END ELSE CAST(CAST(tot_benes AS INT) AS VARCHAR) END AS tot_benes, "
    "CASE WHEN tot_clms < 2 THEN CASE npi % 3 WHEN 0 THEN '*' WHEN 1 THEN '**' ELSE '***' END ELSE CAST(CAST(tot_clms AS INT) AS VARCHAR) END AS tot_clms FROM prescriber_drug_year)"
)


@query(
    "suppressed_values_opened", "D2",
    _STARRED_SQL + " SELECT npi, brand, data_year, CASE WHEN tot_benes NOT LIKE '*%' THEN tot_benes END AS tot_benes, CASE WHEN tot_clms NOT LIKE '*%' THEN tot_clms END AS tot_clms, "
    "CAST(tot_benes LIKE '*%' AS INT) AS tot_benes_suppressed, CAST(tot_clms LIKE '*%' AS INT) AS tot_clms_suppressed FROM starred",
)
def suppressed_values_opened(spark, sf_dir):
    return cl.open_suppressed(_starred(spark, sf_dir), ["tot_benes", "tot_clms"])


@query(
    "suppression_totals", "D2 E13",
    _STARRED_SQL + " " + _per_column(
        ("tot_benes", "tot_clms"),
        "'{c}' AS column_name, CAST(sum(CAST({c} LIKE '*%' AS INT)) AS BIGINT) AS suppressed, round(avg(CAST({c} LIKE '*%' AS INT)) * 100, 4) AS suppressed_percent", "starred",
    ),
)
def suppression_totals(spark, sf_dir):
    return cl.suppression_summary(cl.open_suppressed(_starred(spark, sf_dir), ["tot_benes", "tot_clms"]), ["tot_benes", "tot_clms"])


@query("auth_columns_tidied", "D3", views.with_views("auth_records") + " SELECT authorization_id, patient_id, provider_id FROM auth_records")
def auth_columns_tidied(spark, sf_dir):
    """Padded names, an index column left by an export and an empty column."""
    df = views.auth_records(spark, sf_dir).select("authorization_id", "patient_id", "provider_id")
    messy = df.select(
        F.monotonically_increasing_id().alias("Unnamed: 0"), F.col("authorization_id").alias(" authorization_id "),
        F.col("patient_id").alias("patient_id "), "provider_id", F.lit(None).cast("string").alias("remark"),
    )
    return cl.tidy_columns(messy)


def _with_infinite(spark, sf_dir):
    df = views.prescriber_drug_year(spark, sf_dir)
    signed = "CASE WHEN npi % 17 = 0 THEN CAST('Infinity' AS DOUBLE) WHEN npi % 19 = 0 THEN CAST('-Infinity' AS DOUBLE) ELSE tot_drug_cst END"
    return df.select("npi", "brand", "data_year", F.expr(signed).alias("tot_drug_cst"))


_INF_SQL = views.with_views("prescriber_drug_year") + (
    ", inf_rows AS (SELECT npi, brand, data_year, CASE WHEN npi % 17 = 0 THEN 'inf'::DOUBLE WHEN npi % 19 = 0 THEN '-inf'::DOUBLE ELSE tot_drug_cst END AS tot_drug_cst FROM prescriber_drug_year)"
)


@query("infinite_values_removed", "D4", _INF_SQL + " SELECT npi, brand, data_year, CASE WHEN NOT isinf(tot_drug_cst) THEN tot_drug_cst END AS tot_drug_cst FROM inf_rows")
def infinite_values_removed(spark, sf_dir):
    return cl.remove_infinite(_with_infinite(spark, sf_dir), ["tot_drug_cst"])


@query("infinite_value_counts", "D4", _INF_SQL + " SELECT 'tot_drug_cst' AS column_name, count(*) FILTER (isinf(tot_drug_cst)) AS infinite FROM inf_rows")
def infinite_value_counts(spark, sf_dir):
    return cl.infinite_counts(_with_infinite(spark, sf_dir), ["tot_drug_cst"])


_TRIED = ("member_id", "claim_date", "claim_amount", "claim_status")


@query(
    "numeric_column_shares", "D5",
    views.with_views("claims_raw") + " SELECT *, filled > 0 AND numeric >= 0.8 * filled AS is_numeric FROM (" + " UNION ALL ".join(
        f"SELECT '{c}' AS column_name, count(*) FILTER (trim({c}) NOT IN ('', 'nan', 'None', '*', '**', 'N/A', 'NA')) AS filled, count({NUMBER_SQL.format(c=c)}) AS numeric FROM claims_raw" for c in _TRIED
    ) + ")",
)
def numeric_column_shares(spark, sf_dir):
    return cl.numeric_shares(views.claims_raw(spark, sf_dir), _TRIED)


@query(
    "auto_numeric_claims", "D5",
    views.with_views("claims_raw") + f" SELECT claim_id, member_id, claim_status, {NUMBER_SQL.format(c='claim_amount')} AS claim_amount FROM claims_raw",
)
def auto_numeric_claims(spark, sf_dir):
    df = views.claims_raw(spark, sf_dir).select("claim_id", "member_id", "claim_status", "claim_amount")
    return cl.auto_numeric(df, ["member_id", "claim_status", "claim_amount"])


@query(
    "claim_keys_normalised", "D6",
    views.with_views("claims_raw") + " SELECT claim_id, CASE WHEN k IN ('nan', 'None', 'NaN') THEN '' ELSE k END AS member_key FROM "
    "(SELECT claim_id, trim(coalesce(CASE WHEN claim_status = 'UNKNOWN' THEN ' nan ' WHEN claim_status = 'PENDING' THEN 'None' ELSE member_id END, '')) AS k FROM claims_raw)",
)
def claim_keys_normalised(spark, sf_dir):
    raw = F.when(F.col("claim_status") == "UNKNOWN", " nan ").when(F.col("claim_status") == "PENDING", "None").otherwise(F.col("member_id"))
    return views.claims_raw(spark, sf_dir).select("claim_id", fx.clean_key(raw).alias("member_key"))


_SPELLED = "CASE event_id % 8 WHEN 0 THEN ' TRUE ' WHEN 1 THEN 'no' WHEN 2 THEN 'Y' WHEN 3 THEN '1' WHEN 4 THEN 'anomaly' WHEN 5 THEN 'Detected' WHEN 6 THEN NULL ELSE '0' END"


@query(
    "loose_booleans", "D7",
    f"SELECT event_id, coalesce(lower(trim(v)) IN ('1', 'true', 'yes', 'y'), false) AS plain, coalesce(lower(trim(v)) IN ('1', 'true', 'yes', 'y', 'anomaly'), false) AS with_anomaly, "
    f"coalesce(lower(trim(v)) IN ('1', 'true', 'yes', 'y', 'anomaly', 'detected'), false) AS with_detected FROM (SELECT event_id, {_SPELLED} AS v FROM events)",
)
def loose_booleans(spark, sf_dir):
    v = F.expr(_SPELLED)
    return read_table(spark, sf_dir, "events").select(
        "event_id", fx.parse_bool(v).alias("plain"), fx.parse_bool(v, fx.TRUE_WORDS_WITH_ANOMALY).alias("with_anomaly"),
        fx.parse_bool(v, fx.TRUE_WORDS_WITH_DETECTED).alias("with_detected"),
    )


@query(
    "median_imputation", "D8",
    views.with_views("plan_claims") + ", m AS (SELECT quantile_cont(avg_monthly_enrollment, 0.5) AS e FROM plan_claims) "
    "SELECT plan_id, issuer_id, coalesce(avg_monthly_enrollment, e) AS avg_monthly_enrollment, 0.0::DOUBLE AS never_filled FROM plan_claims, m",
)
def median_imputation(spark, sf_dir):
    df = views.plan_claims(spark, sf_dir).select("plan_id", "issuer_id", "avg_monthly_enrollment", F.lit(None).cast("double").alias("never_filled"))
    columns = ["avg_monthly_enrollment", "never_filled"]
    return cl.impute(df, columns, cl.fit_medians(df, columns))


@query(
    "standard_scaling", "D9",
    views.with_views("plan_claims") + ", s AS (SELECT avg(received_in_network) AS m1, stddev_pop(received_in_network) AS s1, avg(resubmitted) AS m2, stddev_pop(resubmitted) AS s2 FROM plan_claims) "
    "SELECT plan_id, issuer_id, round((received_in_network - m1) / s1, 6) AS received_in_network, round((resubmitted - m2) / s2, 6) AS resubmitted, 0.0::DOUBLE AS constant FROM plan_claims, s",
)
def standard_scaling(spark, sf_dir):
    df = views.plan_claims(spark, sf_dir).select("plan_id", "issuer_id", "received_in_network", "resubmitted", F.lit(4.0).alias("constant"))
    names = ["received_in_network", "resubmitted", "constant"]
    return cl.standard_scale(df, names).select("plan_id", "issuer_id", *[F.round(n, 6).alias(n) for n in names])


@query(
    "robust_scaling", "D10",
    views.with_views("plan_claims") + ", s AS (SELECT quantile_cont(received_in_network, [0.25, 0.5, 0.75]) AS a, quantile_cont(avg_monthly_enrollment, [0.25, 0.5, 0.75]) AS b FROM plan_claims) "
    "SELECT plan_id, issuer_id, round((received_in_network - a[2]) / (a[3] - a[1]), 6) AS received_in_network, round((avg_monthly_enrollment - b[2]) / (b[3] - b[1]), 6) AS avg_monthly_enrollment FROM plan_claims, s",
)
def robust_scaling(spark, sf_dir):
    names = ["received_in_network", "avg_monthly_enrollment"]
    df = views.plan_claims(spark, sf_dir).select("plan_id", "issuer_id", *names)
    return cl.robust_scale(df, names).select("plan_id", "issuer_id", *[F.round(n, 6).alias(n) for n in names])


@query(
    "ordinal_codes", "D11",
    views.with_views("auth_records") + ", l AS (SELECT 'authorization_type' AS column_name, trim(lower(coalesce(authorization_type, '__MISSING__'))) AS category FROM auth_records "
    "UNION SELECT 'service_code', trim(lower(coalesce(service_code, '__MISSING__'))) FROM auth_records) "
    "SELECT column_name, category, CAST(row_number() OVER (PARTITION BY column_name ORDER BY category) - 1 AS INT) AS code FROM l",
)
def ordinal_codes(spark, sf_dir):
    return cl.fit_ordinals(views.auth_records(spark, sf_dir), ["authorization_type", "service_code"])


@query(
    "ordinal_encoding", "D11",
    views.with_views("auth_records") + ", k AS (SELECT category, row_number() OVER (ORDER BY category) - 1 AS code FROM (SELECT DISTINCT trim(lower(authorization_type)) AS category FROM auth_records)), "
    "seen AS (SELECT authorization_id, CASE WHEN provider_id = 'PR7' THEN ' Unseen ' ELSE upper(authorization_type) END AS authorization_type FROM auth_records) "
    "SELECT s.authorization_id, s.authorization_type, CAST(coalesce(k.code, -1) AS INT) AS authorization_type_code FROM seen s LEFT JOIN k ON k.category = trim(lower(coalesce(s.authorization_type, '__MISSING__')))",
)
def ordinal_encoding(spark, sf_dir):
    auth = views.auth_records(spark, sf_dir)
    seen = auth.select("authorization_id", F.when(F.col("provider_id") == "PR7", " Unseen ").otherwise(F.upper("authorization_type")).alias("authorization_type"))
    return cl.encode(seen, ["authorization_type"], cl.fit_ordinals(auth, ["authorization_type"]))


_SHAPED = ("plan_id", "issuer_id", "avg_monthly_enrollment", "constant")


@query(
    "column_shapes", "D12 D14",
    views.with_views("plan_claims") + ", c AS (SELECT *, 1 AS constant FROM plan_claims) "
    + _per_column(_SHAPED, "'{c}' AS column_name, count(DISTINCT {c}) AS distinct_values, count({c}) AS filled, round(count(*) FILTER ({c} IS NULL) / count(*), 6) AS missing_rate", "c"),
)
def column_shapes(spark, sf_dir):
    return cl.column_shape(views.plan_claims(spark, sf_dir).withColumn("constant", F.lit(1)), _SHAPED)


@query("constant_columns_dropped", "D12", views.with_views("plan_claims") + " SELECT plan_id, issuer_id, resubmitted FROM plan_claims")
def constant_columns_dropped(spark, sf_dir):
    df = views.plan_claims(spark, sf_dir).select("plan_id", "issuer_id", "resubmitted", F.lit(3.0).alias("always_three"), F.lit(None).cast("double").alias("never"))
    return cl.drop_constant(df, ["resubmitted", "always_three", "never"])


@query(
    "missing_indicators", "D13",
    views.with_views("auth_records") + " SELECT authorization_id, patient_id, request_date, CAST(patient_id IS NULL AS INT) AS patient_id_missing_flag, CAST(request_date IS NULL AS INT) AS request_date_missing_flag FROM auth_records",
)
def missing_indicators(spark, sf_dir):
    df = views.auth_records(spark, sf_dir).select("authorization_id", "patient_id", "request_date")
    return cl.missing_indicators(df, ["patient_id", "request_date"])


@query("sparse_columns_dropped", "D14", views.with_views("auth_records") + " SELECT authorization_id, patient_id FROM auth_records")
def sparse_columns_dropped(spark, sf_dir):
    df = views.auth_records(spark, sf_dir).select(
        "authorization_id", "patient_id", F.when(F.col("requested_quantity") < 0, F.col("charged_amount")).alias("rarely_filled")
    )
    return cl.drop_sparse(df, ["patient_id", "rarely_filled"])


_CORRELATED = tuple(c for c in PLAN_NUMBERS if c != "avg_monthly_enrollment")


@query(
    "correlated_columns_dropped", "D15",
    views.with_views("plan_claims") + " SELECT DISTINCT b AS column_name FROM (" + " UNION ALL ".join(
        f"SELECT '{b}' AS b, corr({a}, {b}) AS r FROM plan_claims" for a, b in combinations(_CORRELATED, 2)
    ) + ") WHERE abs(r) > 0.6",
)
def correlated_columns_dropped(spark, sf_dir):
    dropped = cl.correlated_columns(views.plan_claims(spark, sf_dir), _CORRELATED, 0.6)
    return spark.createDataFrame([(c,) for c in dropped], "column_name string")


@query(
    "service_code_prefix", "D16",
    views.with_views("auth_records") + " SELECT authorization_id, CASE WHEN p = '' THEN 'OTHER' ELSE p END AS service_code_prefix FROM "
    "(SELECT authorization_id, regexp_extract(CASE WHEN provider_id = 'PR3' THEN concat('9', service_code) ELSE service_code END, '^([A-Za-z]+)', 1) AS p FROM auth_records)",
)
def service_code_prefix(spark, sf_dir):
    code = F.when(F.col("provider_id") == "PR3", F.concat(F.lit("9"), "service_code")).otherwise(F.col("service_code"))
    return views.auth_records(spark, sf_dir).select("authorization_id", cl.prefix(code).alias("service_code_prefix"))


@query(
    "fixed_feature_layout", "D17",
    views.with_views("plan_claims") + " SELECT plan_id, issuer_id, 0.0::DOUBLE AS external_appeals, coalesce(avg_monthly_enrollment, 500.0) AS avg_monthly_enrollment, resubmitted FROM plan_claims",
)
def fixed_feature_layout(spark, sf_dir):
    layout = {"external_appeals": 0.0, "avg_monthly_enrollment": 500.0, "resubmitted": 0.0}
    return cl.fixed_layout(views.plan_claims(spark, sf_dir), layout, keep=("plan_id", "issuer_id"))


# ---------------------------------------------------------------- profiling


@query("line_dataset_info", "E1", "SELECT count(*) AS rows, CAST(11 AS INT) AS columns FROM lineitem")
def line_dataset_info(spark, sf_dir):
    return pr.dataset_info(read_table(spark, sf_dir, "lineitem"))


@query(
    "claims_missing_profile", "E2",
    views.with_views("claims_raw") + " " + _per_column(
        views.CLAIMS_COLUMNS, "'{c}' AS column_name, count(*) FILTER ({c} IS NULL) AS missing_count, round(count(*) FILTER ({c} IS NULL) * 100.0 / count(*), 4) AS missing_percentage", "claims_raw"
    ),
)
def claims_missing_profile(spark, sf_dir):
    return pr.missing_profile(views.claims_raw(spark, sf_dir), views.CLAIMS_COLUMNS)


@query(
    "plan_numeric_profile", "E3 H10",
    views.with_views("plan_claims") + " " + _per_column(
        PLAN_NUMBERS,
        "'{c}' AS column_name, count({c}) AS count, round(avg({c}), 6) AS mean, round(stddev_samp({c}), 6) AS std, min({c}) AS min, max({c}) AS max, count(*) FILTER ({c} IS NULL) AS missing, "
        "count(*) FILTER ({c} = 0) AS zero_count, count(*) FILTER ({c} < 0) AS negative_count, count(DISTINCT {c}) AS distinct_values, quantile_cont({c}, 0.25) AS q1, quantile_cont({c}, 0.5) AS median, quantile_cont({c}, 0.75) AS q3",
        "plan_claims",
    ),
)
def plan_numeric_profile(spark, sf_dir):
    return pr.numeric_profile(views.plan_claims(spark, sf_dir), PLAN_NUMBERS)


@query("plan_skewness", "E3", views.with_views("plan_claims") + " " + _per_column(PLAN_NUMBERS, "'{c}' AS column_name, round(skewness({c}), 6) AS skewness", "plan_claims"))
def plan_skewness(spark, sf_dir):
    return pr.skewness_profile(views.plan_claims(spark, sf_dir), PLAN_NUMBERS)


_CATEGORIES = ("patient_id", "provider_id", "authorization_type", "approval_status")


@query(
    "auth_category_profile", "E4",
    views.with_views("auth_records") + ", l AS (" + _per_column(_CATEGORIES, "'{c}' AS column_name, coalesce({c}, '<NULL>') AS value", "auth_records")
    + "), g AS (SELECT column_name, value, count(*) AS rows FROM l GROUP BY ALL) SELECT column_name, value, rows, CAST(rank AS INT) AS rank FROM "
    "(SELECT *, row_number() OVER (PARTITION BY column_name ORDER BY rows DESC, value) AS rank FROM g) WHERE rank <= 10",
)
def auth_category_profile(spark, sf_dir):
    return pr.category_profile(views.auth_records(spark, sf_dir), _CATEGORIES)


@query(
    "auth_category_totals", "E4 E11",
    views.with_views("auth_records") + " " + _per_column(
        _CATEGORIES, "'{c}' AS column_name, count(DISTINCT {c}) AS unique_count, count(DISTINCT {c}) + max(CAST({c} IS NULL AS BIGINT)) AS unique_with_missing, count(*) FILTER ({c} IS NULL) AS missing_count", "auth_records"
    ),
)
def auth_category_totals(spark, sf_dir):
    return pr.category_totals(views.auth_records(spark, sf_dir), _CATEGORIES)


@query(
    "plan_correlations", "E5 H11",
    views.with_views("plan_claims") + " SELECT feature_1, feature_2, round(r, 6) AS correlation FROM (" + " UNION ALL ".join(
        f"SELECT '{a}' AS feature_1, '{b}' AS feature_2, corr({a}, {b}) AS r FROM plan_claims" for a, b in combinations(PLAN_NUMBERS, 2)
    ) + ") WHERE abs(round(r, 6)) >= 0.7",
)
def plan_correlations(spark, sf_dir):
    return pr.correlation_profile(views.plan_claims(spark, sf_dir), PLAN_NUMBERS)


@query(
    "plan_extreme_values", "E6",
    views.with_views("plan_claims") + " " + " UNION ALL ".join(
        f"SELECT '{c}' AS column_name, count(*) FILTER ({c} < q1 - 1.5 * (q3 - q1) OR {c} > q3 + 1.5 * (q3 - q1)) AS outliers, any_value(q1 - 1.5 * (q3 - q1)) AS lower_bound, any_value(q3 + 1.5 * (q3 - q1)) AS upper_bound "
        f"FROM plan_claims, (SELECT quantile_cont({c}, 0.25) AS q1, quantile_cont({c}, 0.75) AS q3 FROM plan_claims)" for c in PLAN_NUMBERS
    ),
)
def plan_extreme_values(spark, sf_dir):
    return pr.extreme_profile(views.plan_claims(spark, sf_dir), PLAN_NUMBERS)


@query("plan_zero_counts", "E7", views.with_views("plan_claims") + " " + _per_column(PLAN_NUMBERS, "'{c}' AS column_name, count(*) FILTER ({c} = 0) AS zero_count", "plan_claims"))
def plan_zero_counts(spark, sf_dir):
    return pr.zero_profile(views.plan_claims(spark, sf_dir), PLAN_NUMBERS)


_LINE_METRICS = ("l_quantity", "l_extendedprice", "l_discount", "l_tax")


@query(
    "line_metric_totals", "E8",
    _per_column(
        _LINE_METRICS, "'{c}' AS column_name, CAST(sum(CAST({c} AS DECIMAL(28,4))) AS DOUBLE) AS total, round(avg({c}), 6) AS average, min({c}) AS minimum, max({c}) AS maximum", "lineitem"
    ),
)
def line_metric_totals(spark, sf_dir):
    return pr.metric_totals(read_table(spark, sf_dir, "lineitem"), _LINE_METRICS)


_TEXTS = ("claim_id", "member_id", "claim_date", "claim_status", "denial_code")


@query(
    "claims_text_profile", "E9",
    views.with_views("claims_raw") + " " + _per_column(
        _TEXTS,
        "'{c}' AS column_name, count(*) FILTER (regexp_matches({c}, '[^a-zA-Z0-9\\s\\-_./]')) AS special_character_count, count(*) FILTER (trim({c}) = '') AS empty_count, count(*) FILTER (regexp_matches({c}, '^\\s+$')) AS whitespace_only_count",
        "claims_raw",
    ),
)
def claims_text_profile(spark, sf_dir):
    return pr.text_profile(views.claims_raw(spark, sf_dir), _TEXTS)


_DATES = ("request_date", "approval_date", "valid_from_date", "valid_to_date")


@query(
    "auth_date_profile", "E10",
    views.with_views("auth_records") + " " + _per_column(
        _DATES, "'{c}' AS column_name, count(*) FILTER ({c} IS NULL) AS missing_dates, count(*) FILTER ({c} IS NOT NULL AND TRY_CAST({c} AS DATE) IS NULL) AS invalid_dates", "auth_records"
    ),
)
def auth_date_profile(spark, sf_dir):
    return pr.date_profile(views.auth_records(spark, sf_dir), _DATES)


@query(
    "nation_value_counts", "E12",
    "SELECT n_name AS column_value, count(*) AS rows FROM customer JOIN nation ON c_nationkey = n_nationkey GROUP BY n_name",
)
def nation_value_counts(spark, sf_dir):
    customers, nations = read_table(spark, sf_dir, "customer"), read_table(spark, sf_dir, "nation")
    joined = customers.join(nations, customers.c_nationkey == nations.n_nationkey)
    return joined.groupBy(F.col("n_name").alias("column_value")).agg(F.count(F.lit(1)).alias("rows"))


@query(
    "claims_completeness", "E14",
    views.with_views("claims_raw") + ", k AS (SELECT claim_id, count(*) AS r, count(claim_id) + count(member_id) + count(provider_id) + count(claim_date) AS f FROM claims_raw GROUP BY claim_id) "
    "SELECT round(sum(f) * 100.0 / (sum(r) * 4), 4) AS completeness_percent, CAST(sum(r) - count(*) AS BIGINT) AS duplicate_count, round(1 - count(*) / sum(r), 6) AS duplicate_rate FROM k",
)
def claims_completeness(spark, sf_dir):
    return pr.completeness(views.claims_raw(spark, sf_dir), ("claim_id", "member_id", "provider_id", "claim_date"), "claim_id")


_CANDIDATES = (*PLAN_NUMBERS, "issuer_id", "enrollment_missing_flag", "claims_missing_count", "two_values", "all_null", "enrollment_suppressed")


@query(
    "statistical_feature_selection", "B8",
    views.with_views("plan_claims") + ", c AS (SELECT *, CAST(avg_monthly_enrollment IS NULL AS INT) AS enrollment_missing_flag, 3 * CAST(avg_monthly_enrollment IS NULL AS INT) AS claims_missing_count, "
    "resubmitted % 2 AS two_values, NULL::DOUBLE AS all_null, issuer_id % 5 AS enrollment_suppressed FROM plan_claims), f AS ("
    + _per_column(_CANDIDATES, "'{c}' AS column_name, count({c}) AS filled, count(DISTINCT {c}) AS d, var_samp({c}) AS v", "c")
    + "), r AS (SELECT column_name, filled, CASE WHEN column_name = 'issuer_id' THEN 'identifier' WHEN column_name LIKE '%missing_flag' THEN 'missing_flag' WHEN column_name LIKE '%suppressed' THEN 'suppressed' "
    "WHEN column_name LIKE '%missing_count' THEN 'missing_count' WHEN d <= 2 THEN 'binary_or_constant' WHEN filled < 20 OR coalesce(v, 0) <= 0 THEN 'low_information' END AS excluded_because FROM f) "
    "SELECT *, excluded_because IS NULL AS selected FROM r",
)
def statistical_feature_selection(spark, sf_dir):
    df = views.plan_claims(spark, sf_dir).selectExpr(
        "*", "CAST(avg_monthly_enrollment IS NULL AS INT) AS enrollment_missing_flag", "3 * CAST(avg_monthly_enrollment IS NULL AS INT) AS claims_missing_count",
        "resubmitted % 2 AS two_values", "CAST(NULL AS DOUBLE) AS all_null", "issuer_id % 5 AS enrollment_suppressed",
    )
    return pr.select_statistical_features(df, _CANDIDATES)
