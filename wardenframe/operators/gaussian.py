"""Multivariate Gaussian score: shrunk covariance, squared Mahalanobis distance, percentile flag."""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from wardenframe.functions.columns import with_scalars
from wardenframe.functions.quantiles import quantile_row
from wardenframe.session import materialise

REGULARISATION = 1e-6
ANOMALY_PERCENTILE = 0.95


@dataclass(frozen=True)
class Gaussian:
    features: tuple[str, ...]
    mean: np.ndarray
    covariance: np.ndarray
    shrinkage: float


def shrink(second: np.ndarray, fourth: float, n: int) -> tuple[np.ndarray, float]:
    """Ledoit-Wolf covariance from the centred second moments and the mean fourth power of the norm."""
    p = len(second)
    mu = np.trace(second) / p
    squared = float((second**2).sum())
    distance = (squared - 2 * mu * np.trace(second) + p * mu**2) / p
    spread = min((fourth - squared) / (p * n), distance)
    weight = 0.0 if spread == 0 or distance == 0 else spread / distance
    return (1 - weight) * second + weight * mu * np.eye(p), float(weight)


def _moment_parts(df: DataFrame, features: tuple[str, ...], mean: np.ndarray) -> DataFrame:
    """Per batch of rows: the upper triangle of the centred products and the fourth powers, to be summed."""
    upper = np.triu_indices(len(features))

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        total, fourth = np.zeros((len(features), len(features))), 0.0
        for pdf in batches:
            x = pdf.to_numpy(dtype=float) - mean
            total += x.T @ x
            fourth += float((np.square(x).sum(axis=1) ** 2).sum())
        yield pd.DataFrame({
            "i": np.append(upper[0], -1), "j": np.append(upper[1], -1), "value": np.append(total[upper], fourth)
        })

    return df.select(*[F.col(f).cast("double").alias(f) for f in features]).mapInPandas(run, "i int, j int, value double")


def fit_gaussian(df: DataFrame, features: Sequence[str]) -> Gaussian:
    """Two passes: means, then centred moments. Only features x features sums reach the driver."""
    features = tuple(features)
    first = df.agg(F.count(F.lit(1)).alias("_n"), *[F.avg(f).alias(f) for f in features]).first()
    mean, n = np.array([first[f] for f in features]), first["_n"]
    sums = _moment_parts(df, features, mean).groupBy("i", "j").agg(F.sum("value").alias("value")).collect()
    second, fourth = np.zeros((len(features), len(features))), 0.0
    for r in sums:
        if r.i < 0:
            fourth = r.value / n
        else:
            second[r.i, r.j] = second[r.j, r.i] = r.value / n
    covariance, weight = shrink(second, fourth, n)
    return Gaussian(features, mean, covariance + REGULARISATION * np.eye(len(features)), weight)


def score(df: DataFrame, model: Gaussian, keep: Sequence[str], name: str = "gaussian_score") -> DataFrame:
    """Squared Mahalanobis distance per row, in Arrow batches; NULL where a feature is missing or not finite."""
    columns, mean = list(model.features), model.mean
    inverse = np.linalg.inv(model.covariance)
    keep = list(keep)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            x = pdf[columns].to_numpy(dtype=float) - mean
            out = pdf[keep].copy()
            distance = np.einsum("ij,jk,ik->i", x, inverse, x)
            out[name] = pd.Series(distance, index=out.index).astype(object).where(np.isfinite(distance), None)
            yield out

    types = {f.name: f.dataType.simpleString() for f in df.schema.fields}
    schema = ", ".join(f"`{c}` {types[c]}" for c in keep) + f", {name} double"
    return df.select(*keep, *[c for c in columns if c not in keep]).mapInPandas(run, schema)


def detect(df: DataFrame, features: Sequence[str], keep: Sequence[str], percentile: float = ANOMALY_PERCENTILE) -> DataFrame:
    """Score, score scaled to 0..1 over the table, threshold and flag. Scores are written once and read three times."""
    raw = materialise(score(df, fit_gaussian(df, features), keep), "gaussian-scores")
    limits = quantile_row(raw, ["gaussian_score"], {"cut": percentile})
    wide = with_scalars(with_scalars(raw, limits, "_q"), raw.agg(F.min("gaussian_score").alias("low"), F.max("gaussian_score").alias("high")), "_r")
    spread, cut = F.col("_r.high") - F.col("_r.low"), F.col("_q.gaussian_score__cut")
    return wide.select(
        *keep, "gaussian_score",
        F.when(spread > 0, (F.col("gaussian_score") - F.col("_r.low")) / spread).otherwise(0.0).alias("bayesian_probability"),
        cut.alias("bayesian_threshold"), (F.col("gaussian_score") >= cut).cast("int").alias("bayesian_anomaly"),
    )
