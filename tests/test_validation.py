from dataclasses import replace

import pytest
from pyspark.sql import functions as F

from wardenframe.operators import validation as va
from wardenframe.operators.contracts import CLAIMS, Contract

CLEAN = {
    "claim_id": "C1", "member_id": "M1", "provider_id": "P1", "claim_date": "2026-08-01", "service_type": "OFFICE", "procedure_code": "99213",
    "diagnosis_code": "E11", "claim_amount": "100.50", "claim_status": "PAID", "denial_code": "", "processing_time_minutes": "12",
}
SCHEMA = ", ".join(f"{c} string" for c in CLEAN)


def tagged(spark, *rows):
    return va.tag_errors(spark.createDataFrame([tuple({**CLEAN, **r}.values()) for r in rows], SCHEMA), CLAIMS)


def errors(spark, *rows):
    return [[(e.type, e.column) for e in r.errors] for r in tagged(spark, *rows).orderBy("claim_id").collect()]


@pytest.mark.parametrize(("change", "expected"), [
    ({}, []),
    ({"denial_code": None}, []),
    ({"claim_status": "DENIED"}, [("completeness", "denial_code")]),
    ({"claim_status": "DENIED", "denial_code": "D01"}, []),
    ({"claim_date": "2026/08/09"}, [("type", "claim_date")]),
    ({"claim_date": "2026-8-9"}, []),
    ({"claim_date": "2026-02-30"}, [("type", "claim_date")]),
    ({"claim_amount": "-5"}, [("range", "claim_amount")]),
    ({"claim_amount": "ABC"}, [("type", "claim_amount")]),
    ({"claim_amount": "12d"}, [("type", "claim_amount")]),
    ({"claim_status": "APPROVED"}, [("domain", "claim_status")]),
    ({"member_id": "  "}, [("completeness", "member_id")]),
    ({"member_id": None}, [("completeness", "member_id")]),
])
def test_single_changes(spark, change, expected):
    assert errors(spark, change) == [expected]


def test_every_copy_of_a_repeated_key_is_flagged(spark):
    got = errors(spark, {}, {}, {"claim_id": "C2"})
    assert got == [[("duplicate", "claim_id")], [("duplicate", "claim_id")], []]


def test_missing_and_unknown_columns_are_reported(spark):
    df = spark.createDataFrame([tuple(CLEAN.values())], SCHEMA).drop("service_type").withColumn("batch", F.lit("x"))
    report = {(r.type, r.severity, r.column) for r in va.issue_report(va.tag_errors(df, CLAIMS), CLAIMS).collect()}
    assert report == {("schema", "ERROR", "service_type"), ("schema", "WARNING", "batch")}


def test_split_is_complete(spark):
    t = tagged(spark, {}, {"claim_id": "C2", "claim_amount": "x"}, {"claim_id": "C3"})
    valid, invalid = va.split(t)
    assert (valid.count(), invalid.count()) == (2, 1)
    assert va.summary(t).first().asDict() == {"total_records": 3, "valid_records": 2, "invalid_records": 1, "status": "FAIL"}


def test_contract_from_dict_keeps_conditions():
    k = Contract.from_dict("x", {"required_columns": ["a", "b"], "conditional_required": {"b": {"column": "a", "equals": ["1"]}}})
    assert k.mandatory == ("a",) and k.conditional == {"b": ("a", ("1",))}
    assert replace(k, not_null=("b",)).mandatory == ("b",)


def test_affected_field_of_quarantined_rows(spark):
    t = tagged(spark, {"member_id": " "}, {"claim_id": "C2", "claim_amount": "x"}, {"claim_id": "C3", "claim_status": "DENIED"})
    rows = {r.record_id: (r.affected_field, r.error_message) for r in va.anomaly_rows(t, CLAIMS, "claim_id", "CLAIMS").collect()}
    assert rows["C1"] == ("member_id", "Missing/blank values")
    assert rows["C2"] == ("denial_code", "Missing/blank value required when claim_status in ['DENIED']")
    assert rows["C3"][0] == "denial_code"
