"""Dataset contracts, and matching of landed file headers to them.

Headers are rows of a column catalogue ``(file_id, pos, column_name)``, so resolving the headers of
millions of files is an ordinary join on the distinct names.
"""

from __future__ import annotations

import difflib
import json
from collections.abc import Iterable, Mapping, Sequence
from dataclasses import dataclass, field
from pathlib import Path

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from wardenframe.session import materialise

FUZZY_THRESHOLD = 0.82
MIN_CONFIDENCE = 0.6
#: Proposals of canonical names that one task sorts and groups.
PROPOSALS_PER_TASK = 150_000


@dataclass(frozen=True)
class Contract:
    """What a dataset must look like."""

    name: str
    required: tuple[str, ...]
    types: Mapping[str, str] = field(default_factory=dict)
    aliases: Mapping[str, Sequence[str]] = field(default_factory=dict)
    conditional: Mapping[str, tuple[str, tuple[str, ...]]] = field(default_factory=dict)
    allowed: Mapping[str, tuple[str, ...]] = field(default_factory=dict)
    non_negative: tuple[str, ...] = ()
    unique: tuple[str, ...] = ()
    not_null: tuple[str, ...] | None = None

    @property
    def mandatory(self) -> tuple[str, ...]:
        """Columns that may not be blank: given, or all required ones without a condition."""
        if self.not_null is not None:
            return self.not_null
        return tuple(c for c in self.required if c not in self.conditional)

    @classmethod
    def from_dict(cls, name: str, spec: Mapping) -> "Contract":
        conditional = {c: (r["column"], tuple(r["equals"])) for c, r in spec.get("conditional_required", {}).items()}
        return cls(
            name,
            tuple(spec["required_columns"]),
            dict(spec.get("types", {})),
            {c: tuple(a) for c, a in spec.get("column_aliases", {}).items()},
            conditional,
            {c: tuple(v) for c, v in spec.get("allowed_values", {}).items()},
            tuple(spec.get("non_negative", ())),
            tuple(spec.get("unique_columns", ())),
            tuple(spec["not_null_columns"]) if "not_null_columns" in spec else None,
        )


def read_contracts(folder: str) -> dict[str, Contract]:
    """Contracts from ``<name>_schema.json`` files of a folder."""
    files = sorted(Path(folder).glob("*_schema.json"))
    return {f.stem.removesuffix("_schema"): Contract.from_dict(f.stem.removesuffix("_schema"), json.loads(f.read_text())) for f in files}


# The two shipped contracts.
CLAIMS = Contract(
    name="claims",
    required=(
        "claim_id", "member_id", "provider_id", "claim_date", "service_type", "procedure_code",
        "diagnosis_code", "claim_amount", "claim_status", "denial_code", "processing_time_minutes",
    ),
    types={"claim_date": "date", "claim_amount": "float", "processing_time_minutes": "float"},
    aliases={
        "claim_id": ("claimid", "claim_no", "claim_number", "claim number"),
        "member_id": ("memberid", "member_no", "patient_id", "member number"),
        "provider_id": ("providerid", "provider_no", "prov_id", "npi"),
        "claim_date": ("claimdate", "date_of_service", "service_date", "dos"),
        "service_type": ("servicetype", "type_of_service", "svc_type"),
        "procedure_code": ("proc_code", "cpt_code", "procedurecode"),
        "diagnosis_code": ("dx_code", "diagnosiscode", "icd_code"),
        "claim_amount": ("claim_amt", "billed_amount", "amount", "claimamount"),
        "claim_status": ("status", "claimstatus"),
        "denial_code": ("denial_reason", "denial_reason_code", "denialcode"),
        "processing_time_minutes": ("processing_time", "turnaround_minutes", "processing_mins"),
    },
    conditional={"denial_code": ("claim_status", ("DENIED",))},
    allowed={"claim_status": ("PAID", "PENDING", "DENIED")},
    non_negative=("claim_amount", "processing_time_minutes"),
    unique=("claim_id",),
)
PHARMACY = Contract(
    name="pharmacy",
    required=(
        "provider_id", "drug_id", "prescription_date", "total_claims", "total_drug_cost",
        "total_beneficiaries", "thirty_day_fills", "days_supply", "processing_time_minutes",
    ),
    types={
        "prescription_date": "date", "total_claims": "integer", "total_drug_cost": "float", "total_beneficiaries": "integer",
        "thirty_day_fills": "integer", "days_supply": "integer", "processing_time_minutes": "float",
    },
    aliases={
        "provider_id": ("providerid", "provider_no", "prov_id", "npi"),
        "drug_id": ("drugid", "ndc", "drug_code", "ndc_code"),
        "prescription_date": ("rx_date", "prescriptiondate", "fill_date", "date_filled"),
        "total_claims": ("claim_count", "totalclaims", "num_claims"),
        "total_drug_cost": ("drug_cost", "totaldrugcost", "total_cost"),
        "total_beneficiaries": ("beneficiaries", "totalbeneficiaries", "beneficiary_count"),
        "thirty_day_fills": ("30_day_fills", "thirtydayfills", "fills_30d"),
        "days_supply": ("dayssupply", "supply_days"),
        "processing_time_minutes": ("processing_time", "turnaround_minutes", "processing_mins"),
    },
    non_negative=(
        "total_claims", "total_drug_cost", "total_beneficiaries", "thirty_day_fills", "days_supply", "processing_time_minutes",
    ),
)

# Prescriber file columns, the ones that must be there, and accepted spellings.
PRESCRIBER_REQUIRED = (
    "Prscrbr_NPI", "Brnd_Name", "Gnrc_Name", "Tot_Clms", "Tot_30day_Fills", "Tot_Day_Suply", "Tot_Drug_Cst", "Tot_Benes",
)
PRESCRIBER_EXPECTED = (
    "Prscrbr_NPI", "Prscrbr_Last_Org_Name", "Prscrbr_First_Name", "Prscrbr_City", "Prscrbr_State_Abrvtn", "Prscrbr_State_FIPS",
    "Prscrbr_Type", "Prscrbr_Type_Src", "Brnd_Name", "Gnrc_Name", "Tot_Clms", "Tot_30day_Fills", "Tot_Day_Suply", "Tot_Drug_Cst",
    "Tot_Benes", "GE65_Sprsn_Flag", "GE65_Tot_Clms", "GE65_Tot_30day_Fills", "GE65_Tot_Drug_Cst", "GE65_Tot_Day_Suply",
    "GE65_Bene_Sprsn_Flag", "GE65_Tot_Benes",
)
PRESCRIBER_ALIASES = {
    "Prscrbr_NPI": ("Prscrbr_NPI", "NPI", "Prescriber_NPI", "Provider_NPI"),
    "Prscrbr_Last_Org_Name": ("Prscrbr_Last_Org_Name", "Prescriber_Last_Name", "Provider_Last_Name"),
    "Prscrbr_First_Name": ("Prscrbr_First_Name", "Prescriber_First_Name", "Provider_First_Name"),
    "Prscrbr_City": ("Prscrbr_City", "Prescriber_City", "Provider_City"),
    "Prscrbr_State_Abrvtn": ("Prscrbr_State_Abrvtn", "Prescriber_State", "Provider_State", "State"),
    "Prscrbr_State_FIPS": ("Prscrbr_State_FIPS", "State_FIPS"),
    "Prscrbr_Type": ("Prscrbr_Type", "Prescriber_Type", "Provider_Type"),
    "Prscrbr_Type_Src": ("Prscrbr_Type_Src", "Prescriber_Type_Source", "Provider_Type_Source"),
    "Brnd_Name": ("Brnd_Name", "Brand_Name", "Drug_Name"),
    "Gnrc_Name": ("Gnrc_Name", "Generic_Name", "Generic_Drug_Name"),
    "Tot_Clms": ("Tot_Clms", "Total_Claims", "Claims", "Claim_Count"),
    "Tot_30day_Fills": ("Tot_30day_Fills", "Total_30day_Fills", "Total_Fills", "Fills"),
    "Tot_Day_Suply": ("Tot_Day_Suply", "Tot_Day_Supply", "Total_Day_Supply", "Day_Supply"),
    "Tot_Drug_Cst": ("Tot_Drug_Cst", "Total_Drug_Cost", "Drug_Cost", "Total_Cost"),
    "Tot_Benes": ("Tot_Benes", "Total_Beneficiaries", "Beneficiaries", "Beneficiary_Count"),
    "GE65_Sprsn_Flag": ("GE65_Sprsn_Flag", "GE65_Suppression_Flag"),
    "GE65_Tot_Clms": ("GE65_Tot_Clms", "GE65_Total_Claims"),
    "GE65_Tot_30day_Fills": ("GE65_Tot_30day_Fills", "GE65_Total_30day_Fills"),
    "GE65_Tot_Drug_Cst": ("GE65_Tot_Drug_Cst", "GE65_Total_Drug_Cost"),
    "GE65_Tot_Day_Suply": ("GE65_Tot_Day_Suply", "GE65_Tot_Day_Supply", "GE65_Total_Day_Supply"),
    "GE65_Bene_Sprsn_Flag": ("GE65_Bene_Sprsn_Flag", "GE65_Beneficiary_Suppression_Flag"),
    "GE65_Tot_Benes": ("GE65_Tot_Benes", "GE65_Total_Beneficiaries"),
}
PRESCRIBER_INDICATORS = PRESCRIBER_REQUIRED
MIN_INDICATORS = 6


def normalise_name(c: Column) -> Column:
    """Lower case, separators to ``_``, other signs dropped, runs of ``_`` squeezed and trimmed."""
    text = F.regexp_replace(F.lower(F.trim(c)), r"[\s-]+", "_")
    text = F.regexp_replace(F.regexp_replace(text, r"[^a-z0-9_]", ""), "_+", "_")
    return F.trim(text, F.lit("_"))


def simple_name(c: Column) -> Column:
    """The looser form of the strict alias map: trimmed, lower case, blank and dash to ``_``."""
    return F.translate(F.lower(F.trim(c)), " -", "__")


def _plain(name: str) -> str:
    out = "".join("_" if ch.isspace() or ch == "-" else ch for ch in name.strip().lower())
    out = "".join(ch for ch in out if ch.isascii() and (ch.isalnum() or ch == "_"))
    return "_".join(p for p in out.split("_") if p)


def vocabulary(contracts: Iterable[Contract]) -> list[tuple[str, str, str]]:
    """``(contract, known name, canonical)``; a known name written twice keeps its last meaning."""
    rows: dict[tuple[str, str], str] = {}
    for k in contracts:
        for canonical in k.required:
            for known in (canonical, *k.aliases.get(canonical, ())):
                rows[(k.name, _plain(known))] = canonical
    return [(name, known, canonical) for (name, known), canonical in rows.items()]


def vocabulary_table(spark: SparkSession, contracts: Iterable[Contract]) -> DataFrame:
    return spark.createDataFrame(vocabulary(contracts), "schema string, known string, canonical string")


def sequence_ratio(a: Column, b: Column) -> Column:
    """Share of characters in matching blocks, as ``difflib`` defines it (Arrow batches of distinct names)."""

    @F.pandas_udf("double")
    def ratio(x: pd.Series, y: pd.Series) -> pd.Series:
        return pd.Series([difflib.SequenceMatcher(None, p, q).ratio() for p, q in zip(x, y)])

    return ratio(a, b)


#: Characters of a normalised name.
_NAME_CHARACTERS = "abcdefghijklmnopqrstuvwxyz0123456789_"


def _character_counts(name: Column) -> Column:
    return F.transform(F.array(*[F.lit(c) for c in _NAME_CHARACTERS]), lambda c: F.length(name) - F.length(F.replace(name, c, F.lit(""))))


def could_match(name: Column, counts: Column, known: Column, known_counts: Column, threshold: float) -> Column:
    """Whether the share of matching blocks can reach the threshold: it can't exceed that of the characters in common."""
    both = F.length(name) + F.length(known)
    common = F.aggregate(F.zip_with(counts, known_counts, lambda x, y: F.least(x, y)), F.lit(0), lambda n, x: n + x)
    needed = threshold * both - 1e-9
    return (2 * F.least(F.length(name), F.length(known)) >= needed) & (2 * common >= needed)


def edit_similarity(a: Column, b: Column) -> Column:
    return 1 - F.levenshtein(a, b) / F.greatest(F.length(a), F.length(b))


def fuzzy_candidates(norms: DataFrame, contracts: Sequence[Contract], threshold: float, similarity: str) -> DataFrame:
    """Similar canonicals of each distinct name and contract with their order of preference.

    Works on distinct names only, against the fixed vocabulary of the contracts. Of equal scores the
    later known name in the alphabet comes first.
    """
    entries = [{"schema": s, "known": k, "canonical": c, "counts": [k.count(x) for x in _NAME_CHARACTERS]} for s, k, c in vocabulary(contracts)]
    # One parsed constant instead of a tree of hundreds of literals, which the optimizer would walk over and over.
    known = F.from_json(F.lit(json.dumps(entries)), "array<struct<schema:string,known:string,canonical:string,counts:array<int>>>")
    pairs = norms.select("norm", _character_counts(F.col("norm")).alias("own"), F.explode(known).alias("v")).select("norm", "own", "v.*")
    if similarity == "sequence":
        # Python sees only pairs that can reach the threshold.
        pairs = pairs.where(could_match(F.col("norm"), F.col("own"), F.col("known"), F.col("counts"), threshold))
    score = sequence_ratio(F.col("norm"), F.col("known")) if similarity == "sequence" else edit_similarity(F.col("norm"), F.col("known"))
    scored = pairs.select("norm", "schema", "canonical", "known", score.alias("score")).where(F.col("score") >= threshold)
    best = scored.groupBy("norm", "schema", "canonical").agg(F.max(F.struct("score", "known")).alias("b"))
    order = Window.partitionBy("norm", "schema").orderBy(F.desc("b"))
    return best.select("norm", "schema", "canonical", F.col("b.score").alias("score"), F.row_number().over(order).alias("choice"))


def resolve_columns(
    catalogue: DataFrame, contracts: Sequence[Contract], threshold: float = FUZZY_THRESHOLD, similarity: str = "sequence"
) -> DataFrame:
    """Map each file's columns to canonical names: known names first, then similar names in file order.

    Returns ``(file_id, schema, pos, column_name, canonical, method, confidence)``; a canonical name is
    claimed once per file and contract.

    Every known or similar name is a proposal. Proposals of one file and contract are gone through in
    order (known before similar, then file order, then preference) and granted while both the column
    and the canonical are free. Only the first proposals per canonical can ever be granted: of the
    columns before, at most m go to known names and at most m - 1 to other canonicals, m being the
    number of canonicals. So each list is cut to 2m per canonical without changing the result, and no
    list grows with the file.
    """
    spark = catalogue.sparkSession
    # Names repeat over files, so text work is done once per distinct name and joined back.
    names = catalogue.groupBy("column_name").agg(F.count(F.lit(1)).alias("_n"))
    names = materialise(names.withColumn("norm", normalise_name(F.col("column_name"))), "header-names")
    similar = fuzzy_candidates(names.select("norm").distinct(), contracts, threshold, similarity)
    method = F.when(F.col("norm") == normalise_name(F.col("canonical")), "exact").otherwise("alias")
    known = vocabulary_table(spark, contracts).withColumnRenamed("known", "norm").select(
        "norm", "schema", "canonical", F.lit(1.0).alias("score"), F.lit(1).alias("choice"), F.lit(0).alias("kind"), method.alias("method")
    )
    meanings = known.unionByName(similar.withColumns({"kind": F.lit(1), "method": F.lit("fuzzy")}))
    meanings = materialise(names.join(meanings, "norm").drop("norm"), "header-meanings")
    # One exchange of the narrow rows serves the cut and the grouping. They repeat the same few words and shrink to a tenth
    # when compressed, so tasks sized by compressed bytes would sort millions of them; their number follows the rows instead.
    proposed = meanings.agg(F.sum("_n")).first()[0] or 0  # one number
    dealt = catalogue.select("file_id", "pos", "column_name").repartition(max(-(-proposed // PROPOSALS_PER_TASK), 1), "file_id")
    placed = dealt.join(meanings.drop("_n"), "column_name")
    most = 2 * max(len(k.required) for k in contracts)
    rank = F.row_number().over(Window.partitionBy("file_id", "schema", "canonical", "kind").orderBy("pos"))
    short = placed.withColumn("_r", rank).where(F.col("_r") <= most)
    lists = short.groupBy("file_id", "schema").agg(
        F.sort_array(F.collect_list(F.struct("kind", "pos", "choice", "canonical", "score", "column_name", "method"))).alias("proposals")
    )
    empty = F.filter(F.col("proposals"), lambda o: F.lit(False))
    granted = F.aggregate("proposals", empty, lambda acc, o: F.when(
        F.exists(acc, lambda t: (t["pos"] == o["pos"]) | (t["canonical"] == o["canonical"])), acc
    ).otherwise(F.concat(acc, F.array(o))))
    rows = lists.select("file_id", "schema", F.explode(granted).alias("g")).select("file_id", "schema", "g.*")
    return rows.select("file_id", "schema", "pos", "column_name", "canonical", "method", F.round("score", 3).alias("confidence"))


def score_contracts(catalogue: DataFrame, resolved: DataFrame, contracts: Sequence[Contract]) -> DataFrame:
    """Matched share of the required columns per file and contract; files without a match score 0."""
    sizes = F.array(*[F.struct(F.lit(k.name).alias("schema"), F.lit(len(k.required)).alias("required")) for k in contracts])
    grid = catalogue.select("file_id").distinct().select("file_id", F.explode(sizes).alias("k")).select("file_id", "k.*")
    matched = resolved.groupBy("file_id", "schema").agg(F.count_distinct("canonical").alias("matched"))
    return grid.join(matched, ["file_id", "schema"], "left").select(
        "file_id", "schema", F.coalesce("matched", F.lit(0)).alias("matched"), "required",
        F.round(F.coalesce("matched", F.lit(0)) / F.col("required"), 3).alias("score"),
    )


def detect_contract(scores: DataFrame, min_confidence: float = MIN_CONFIDENCE) -> DataFrame:
    """Best contract per file, or none below the limit."""
    best = scores.groupBy("file_id").agg(F.min(F.struct((-F.col("score")).alias("negated"), "schema")).alias("b"))
    confidence = -F.col("b.negated")
    return best.select(
        "file_id", F.when(confidence >= min_confidence, F.col("b.schema")).alias("matched_schema"), confidence.alias("confidence")
    )


def strict_alias_report(catalogue: DataFrame, aliases: Mapping[str, Sequence[str]], required: Sequence[str]) -> DataFrame:
    """Per file: conflicting canonicals, unmapped columns, missing required columns and the outcome."""
    rows = [(a.strip().lower().replace(" ", "_").replace("-", "_"), c) for c, known in aliases.items() for a in known]
    table = catalogue.sparkSession.createDataFrame(sorted(set(rows)), "known string, canonical string")
    named = catalogue.withColumn("known", simple_name(F.col("column_name")))
    mapped = named.join(F.broadcast(table), "known", "left")
    per_name = mapped.groupBy("file_id", "canonical").agg(F.count(F.lit(1)).alias("columns"))
    return per_name.groupBy("file_id").agg(
        F.count_if(F.col("canonical").isNotNull() & (F.col("columns") > 1)).alias("conflicts"),
        F.coalesce(F.sum(F.when(F.col("canonical").isNull(), F.col("columns"))), F.lit(0)).alias("unmapped"),
        (F.lit(len(required)) - F.count_if(F.col("canonical").isin(*required))).alias("missing_required"),
    ).withColumn(
        "outcome",
        F.when(F.col("conflicts") > 0, "CONFLICT").when(F.col("missing_required") > 0, "INCOMPLETE").otherwise("MATCH"),
    )


def recognise(catalogue: DataFrame, indicators: Sequence[str], at_least: int) -> DataFrame:
    """Does the header hold enough of the indicator columns (exact spelling)?"""
    seen = catalogue.groupBy("file_id").agg(
        F.count_distinct(F.when(F.col("column_name").isin(*indicators), F.col("column_name"))).alias("indicators_found")
    )
    return seen.withColumn("recognised", F.col("indicators_found") >= at_least)


def header_differences(catalogue: DataFrame, expected: Sequence[str]) -> DataFrame:
    """Missing and unexpected columns of each file against an expected header."""
    wanted = catalogue.select("file_id").distinct().select("file_id", F.explode(F.array(*[F.lit(c) for c in expected])).alias("column_name"))
    missing = wanted.join(catalogue, ["file_id", "column_name"], "left_anti").withColumn("finding", F.lit("missing"))
    extra = catalogue.where(~F.col("column_name").isin(*expected)).select("file_id", "column_name").distinct()
    return missing.unionByName(extra.withColumn("finding", F.lit("unexpected")))
