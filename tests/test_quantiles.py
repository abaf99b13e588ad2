import numpy as np
import pytest

from wardenframe.functions import quantiles
from wardenframe.functions.quantiles import cumulative_share, quantile_row, quantile_table, running_totals

PROBS = (0.0, 0.01, 0.05, 0.25, 0.5, 0.75, 0.9, 0.99, 1.0)


def frames():
    rng = np.random.default_rng(7)
    heavy = np.concatenate([np.full(4000, 3.0), rng.exponential(50, 6000), [1e9, -1e6]])
    return {"spread": rng.normal(size=10_002), "ties": rng.integers(0, 4, 10_002).astype(float), "heavy": heavy}


@pytest.mark.parametrize("ordered", [100_000, 500, 20])
def test_quantiles_are_exact(spark, monkeypatch, ordered):
    """With columns ordered at once, narrowed once, and narrowed until only ties are left."""
    monkeypatch.setattr(quantiles, "ORDERED_VALUES", ordered)
    data = frames()
    df = spark.createDataFrame([tuple(float(v[i]) for v in data.values()) for i in range(10_002)], ", ".join(f"{c} double" for c in data))
    got = {r.feature: r.q for r in quantile_table(df, list(data), PROBS).collect()}
    for name, values in data.items():
        assert np.allclose(got[name], np.quantile(values, PROBS), rtol=1e-12, atol=0)


@pytest.mark.parametrize("ordered", [100_000, 8])
def test_missing_values_thin_and_constant_columns(spark, monkeypatch, ordered):
    """NaN counts as missing on both ways, and a thin column next to a long one changes nothing."""
    monkeypatch.setattr(quantiles, "ORDERED_VALUES", ordered)
    rows = [(float(k), float(k) if k < 10 else None, float("nan") if k % 3 else k / 7, 4.0, None) for k in range(2000)]
    df = spark.createDataFrame(rows, "long double, thin double, holes double, constant double, empty double")
    row = quantile_row(df, df.columns, {"m": 0.5, "h": 0.9}).first()
    for name, column in zip(df.columns[:-1], zip(*rows)):
        values = [v for v in column if v is not None and v == v]
        assert np.allclose([row[f"{name}__m"], row[f"{name}__h"]], np.quantile(values, [0.5, 0.9]), rtol=1e-12)
    assert row["empty__m"] is None


def test_running_totals_cross_bucket_borders(spark):
    values = spark.createDataFrame([(float(v), 1 + v % 3) for v in range(5000)], "v double, w int")
    got = {r.v: r.w_upto for r in running_totals(values, "v", ["w"], buckets=37).collect()}
    total = 0
    for v in range(5000):
        total += 1 + v % 3
        assert got[float(v)] == total


def test_cumulative_share(spark):
    df = spark.createDataFrame([(1.0,), (1.0,), (2.0,), (5.0,), (None,)], "x double")
    assert {r.x: r.percentile_rank for r in cumulative_share(df, "x").collect()} == {1.0: 50.0, 2.0: 75.0, 5.0: 100.0}
