"""Fused results whose scores come from fitted models."""

import os

import pytest
from pyspark.sql import functions as F

import __spark_entry__ as contract
from wardenframe.operators import authorization as au
from wardenframe.operators import clusters as cu
from wardenframe.operators import forest as fo
from wardenframe.operators import pharmacy as ph
from wardenframe.plans import fusion, prescriber

DIR = "/root/testdata/sf0.001"
needs_tables = pytest.mark.skipif(not os.path.isdir(DIR), reason="test tables are not here")


@needs_tables
def test_prescriber_fusion_holds_what_the_models_found(spark):
    rows = {tuple(r[k] for k in prescriber.KEYS): r for r in contract.queries()["prescriber_fusion_by_models"](spark, DIR).collect()}
    named, ready, names = fusion.model_rows(prescriber.scored(spark, DIR), prescriber.KEYS, fusion.PRESCRIBER_FEATURES, "test", fusion.cl.standard_scale)
    assert len(rows) == named.count()
    forest = fo.detect(ready, names, fusion.PRESCRIBER_FEATURES, trees=200, contamination=0.01).collect()
    groups = cu.assign(ready, cu.fit_clusters(ready, fusion.PRESCRIBER_FEATURES), fusion.PRESCRIBER_FEATURES, names, 0.99).collect()
    keyed = {tuple(r[k] for k in prescriber.KEYS): [r] for r in forest}
    for r in groups:
        keyed[tuple(r[k] for k in prescriber.KEYS)].append(r)
    for k, (f, g) in keyed.items():
        assert (rows[k].isolation_anomaly, rows[k].cluster_anomaly) == (f.is_anomaly, g.cluster_anomaly)
        assert abs(rows[k].isolation_score - f.normalised_score) < 1e-9 and abs(rows[k].cluster_score - g.cluster_anomaly_score) < 1e-9
    assert {(r.isolation_model, r.cluster_model) for r in rows.values()} == {("Isolation Forest", "K-Means")}
    assert 0 < sum(r.isolation_anomaly for r in rows.values()) <= 0.02 * len(rows) + 1


@needs_tables
@pytest.mark.parametrize("name,formula", [
    ("prescriber_verdict_by_models", "prescriber_verdict"), ("pharmacy_decision_sla_by_forest", "pharmacy_decision_sla"), ("auth_risk_by_forest", "auth_risk"),
    ("claims_signal_merge_by_gaussian", "claims_signal_merge"), ("plan_service_risk_by_forest", "plan_service_risk"),
])
def test_every_record_is_scored_once(spark, name, formula):
    found, given = (contract.queries()[n](spark, DIR) for n in (name, formula))
    keys = [k for k in ("npi", "brand", "data_year", "authorization_id", "plan_id", "issuer_id") if k in given.columns]
    assert sorted(map(tuple, found.select(keys).collect())) == sorted(map(tuple, given.select(keys).collect()))


def test_repeated_keys_neither_fan_out_nor_share_a_score(spark):
    rows = [(i % 60, float(i % 7), float(i % 11)) for i in range(60)] + [(0, 500.0, 900.0), (0, 500.0, 900.0), (1, None, 3.0)]
    df = spark.createDataFrame(rows, "id int, a double, b double")
    found = fusion.with_forest(df, ["id"], ["a", "b"], "authorization", "test").collect()
    assert len(found) == len(rows)
    far, near = ([r for r in found if r.id == 0 and r.a == a] for a in (500.0, 0.0))
    assert [r.ml_anomaly for r in far] == [True, True] and far[0].ml_anomaly_score == far[1].ml_anomaly_score > near[0].ml_anomaly_score


def test_texts_name_the_model_of_the_column(spark):
    df = spark.range(1).select(F.lit(0).alias("rule_anomaly_count"), F.lit(0).alias("rule_anomaly_flag"), F.lit(1).alias("ml_anomaly_flag"), F.lit("HIGH").alias("ml_anomaly_severity"), F.lit("Model X").alias("ml_model"))
    assert au.risk(df).first().risk_explanation == "Model X anomaly (HIGH)"
    changes = [F.lit(None).cast("double").alias(c) for _, c, _ in ph.EXTREME_RULES]
    row = spark.range(1).select(F.lit(False).alias("rule_anomaly"), F.lit("").alias("rule_reason"), F.lit(True).alias("ml_anomaly"), F.lit("Model X").alias("ml_model"), *changes)
    assert ph.decide(row).first().explanation == "Model X identified unusual pharmacy behavior"


def test_rules_run_once_before_the_percentiles_of_the_score(spark):
    from wardenframe.plans import authorization

    df = authorization.modelled(spark, "/root/testdata/sf0.001")
    assert df.inputFiles() and not [f for f in df.inputFiles() if "/orders.parquet" in f]


def test_medians_of_the_models_read_written_features(spark, monkeypatch):
    from wardenframe.operators import cleaning
    from wardenframe.plans import models

    seen = []
    fit = cleaning.fit_medians
    monkeypatch.setattr(cleaning, "fit_medians", lambda df, columns: seen.extend(df.inputFiles()) or fit(df, columns))
    models.model_input(spark, DIR)
    assert seen and not [f for f in seen if f.startswith(f"file:{DIR}") or f.startswith(f"file://{DIR}")]


def test_medians_read_written_distinct_rows(spark, monkeypatch):
    seen = []
    fit = fusion.cl.fit_medians
    monkeypatch.setattr(fusion.cl, "fit_medians", lambda df, columns: seen.append(df) or fit(df, columns))
    df = spark.createDataFrame([(i % 50, float(i % 5), None if i % 7 == 0 else float(i % 3)) for i in range(200)], "id int, a double, b double")
    named, ready, names = fusion.model_rows(df, ["id"], ["a", "b"], "test", fusion.cl.standard_scale)
    assert all("test-features" in f for f in seen[0].inputFiles()) and all("test-features" in f for f in ready.inputFiles())
    assert seen[0].count() == ready.count() == named.select(*names).distinct().count() < named.count() == 200
