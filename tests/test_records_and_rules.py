import pytest
from pyspark.sql import functions as F

from wardenframe.functions import columns as fx
from wardenframe.operators import cleaning as cl
from wardenframe.operators import pharmacy as ph
from wardenframe.operators import prescriber as ps
from wardenframe.operators import sla
from wardenframe.operators.claims import SEVERITIES


@pytest.mark.parametrize(("n", "d", "upper", "want"), [
    (1.0, None, 1.0, (None, 0, 1, None)),
    (1.0, 0.0, 1.0, (None, 0, 1, None)),
    (1.0, -2.0, 1.0, (None, 0, 1, None)),
    (3.0, 2.0, 1.0, (1.5, 1, 0, None)),
    (3.0, 2.0, float("inf"), (1.5, 0, 0, 1.5)),
    (-1.0, 2.0, 1.0, (-0.5, 1, 0, None)),
    (1.0, 2.0, 1.0, (0.5, 0, 0, 0.5)),
])
def test_ratio_family(spark, n, d, upper, want):
    df = spark.createDataFrame([(n, d)], "n double, d double")
    assert tuple(df.select(*fx.ratio_family("r", "n", "d", upper)).first()) == want


def test_severity_is_by_rank_and_empty_is_weakest(spark):
    df = spark.createDataFrame([(["HIGH", "CRITICAL"],), (["MEDIUM"],), ([],)], "s array<string>")
    assert [r[0] for r in df.select(fx.highest_severity(F.col("s"), SEVERITIES)).collect()] == ["CRITICAL", "MEDIUM", "NONE"]


def test_previous_available_year_not_calendar_year(spark):
    rows = [(1, "a", 2019, 10.0), (1, "a", 2021, 40.0), (2, "a", 2019, 5.0), (2, "a", 2022, 5.0), (3, "a", 2021, 0.0), (3, "a", 2022, 7.0)]
    df = spark.createDataFrame(rows, "npi int, brand string, data_year int, tot_clms double")
    got = {(r.npi, r.data_year): (r.change, r.new_pharmacy_record) for r in ph.year_over_year(df, changes=(("change", "tot_clms"),)).collect()}
    assert got == {(1, 2021): (3.0, False), (2, 2022): (None, True), (3, 2021): (None, True), (3, 2022): (None, False)}


def test_context_alone_scores_nothing(spark):
    df = spark.createDataFrame([(1, "c", "t", "b", 1.0, 1.0, 1.0, 1.0, 1.0, "*")], "npi int, city string, prescriber_type string, brand string, tot_clms double, tot_30day_fills double, tot_day_suply double, tot_drug_cst double, tot_benes double, ge65_sprsn_flag string")
    r = ps.score_evidence(ps.classify(ps.evaluate(ph.behaviour_ratios(df)))).first()
    assert (r.rule_anomaly, r.context_present, r.rule_evidence_score, r.evidence_count) == (False, True, 0.0, 0)


def test_noisy_or(spark):
    df = spark.createDataFrame([([0.75, 0.5],), ([],)], "s array<double>")
    assert [r[0] for r in df.select(ps.noisy_or(F.col("s"))).collect()] == [0.875, 0.0]


def test_sla_limit_is_reached_by_exact_sum(spark):
    df = spark.createDataFrame([(100000.0, 3.0, True, True)], "tot_clms double, claim_volume_change double, ml_anomaly boolean, rule_anomaly boolean")
    assert tuple(ph.sla_status(df).select("sla_breach_probability", "sla_status").first()) == (1.0, "NO")
    low = df.withColumn("tot_clms", F.lit(1.0))
    assert tuple(ph.sla_status(low).select("sla_breach_probability", "sla_status").first()) == (0.7, "NO")


def test_levels_and_signals(spark):
    df = spark.createDataFrame([(30.0, "None"), (60.0, "A, B;C"), (80.5, None)], "s double, t string")
    assert [tuple(r) for r in df.select(sla.risk_level(F.col("s")), sla.signal_names(F.col("t"))).collect()] == [("LOW", []), ("MEDIUM", ["A", "B", "C"]), ("CRITICAL", [])]


def test_ordinals_follow_sorted_categories_and_unknown_is_minus_one(spark):
    df = spark.createDataFrame([("beta",), (" Alpha",), (None,), ("betaX",)], "c string")
    codes = cl.fit_ordinals(df, ["c"])
    assert {r.category: r.code for r in codes.collect()} == {"__missing__": 0, "alpha": 1, "beta": 2, "betax": 3}
    out = cl.encode(spark.createDataFrame([("ALPHA",), ("zeta",)], "c string"), ["c"], codes)
    assert {r.c: r.c_code for r in out.collect()} == {"ALPHA": 1, "zeta": -1}


def test_constant_batch_scales_to_zero(spark):
    from wardenframe.operators.serving import min_max

    df = spark.createDataFrame([(2.0,), (2.0,)], "x double")
    assert [r.y for r in min_max(df, "x", "y").collect()] == [0.0, 0.0]
