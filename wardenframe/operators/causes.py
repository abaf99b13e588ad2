"""Probabilistic cause reasoning in closed form and by counting."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from wardenframe.functions.columns import as_int, flag, total

# Weight of each kind of evidence in the fixed network, and the cause each stands for.
NETWORK_WEIGHTS = {
    "ml_anomaly": 0.25, "rule_anomaly": 0.20, "behavior_anomaly": 0.25, "cluster_anomaly": 0.15, "data_quality_issue": 0.05, "sla_risk": 0.10,
}
CAUSE_NAMES = {
    "ml_anomaly": "multivariate_ml_anomaly", "rule_anomaly": "rule_based_anomaly", "behavior_anomaly": "historical_behavior_anomaly",
    "cluster_anomaly": "unusual_peer_group_behavior", "data_quality_issue": "data_quality_issue", "sla_risk": "sla_processing_risk",
}
# Fixed values: (posterior when on, posterior when off, baseline).
POSTERIORS = {
    "ml_anomaly": (0.91, 0.05, 0.15), "rule_anomaly": (0.75, 0.05, 0.15), "behavior_anomaly": (0.75, 0.05, 0.20),
    "cluster_anomaly": (0.75, 0.05, 0.20), "data_quality_issue": (0.65, 0.05, 0.25), "sla_risk": (0.05, 0.05, 0.10),
}


def network_probability(evidence: Mapping[str, Column], weights: Mapping[str, float] = NETWORK_WEIGHTS) -> Column:
    """P(anomaly) with every parent observed: a clipped weighted sum."""
    weighted = total(as_int(flag(evidence[k])) * w for k, w in weights.items())
    return F.least(F.lit(0.99), 0.01 + 0.98 * weighted)


def lifted_causes(evidence: Mapping[str, Column], minimum: float = 0.5, minimum_lift: float = 1.0) -> Column:
    """Causes with enough posterior and lift, likeliest first."""
    items = []
    for k, (on, off, base) in POSTERIORS.items():
        posterior = F.when(flag(evidence[k]), on).otherwise(off)
        lift = posterior / base
        items.append(F.when((posterior >= minimum) & (lift >= minimum_lift), F.struct(
            (-posterior).alias("order"), F.lit(len(items)).alias("place"), F.lit(CAUSE_NAMES[k]).alias("cause"),
            F.round(posterior, 4).alias("probability_given_anomaly"), F.lit(base).alias("baseline_probability"), F.round(lift, 4).alias("bayesian_lift"),
        )))
    return F.sort_array(F.array_compact(F.array(*items)))


# ---------------------------------------------------------------- learned cause network


def _pattern(causes: Sequence[str]) -> Column:
    """The active causes of a row as bits."""
    return total(F.when(flag(F.col(c)), F.lit(1 << i).cast("long")).otherwise(F.lit(0).cast("long")) for i, c in enumerate(causes))


def pattern_counts(df: DataFrame, causes: Sequence[str], outcome: str) -> DataFrame:
    """Rows and anomalies per observed pattern of causes."""
    return df.groupBy(_pattern(causes).alias("pattern")).agg(F.count(F.lit(1)).alias("rows"), F.count_if(flag(F.col(outcome))).alias("anomalies"))


class CauseNetwork:
    """Independent causes with one common effect, smoothed by an equivalent sample size.

    Fitted from the counts of the patterns that occur. Follows the Bayesian Dirichlet equivalent uniform
    prior: P(effect | pattern) = (anomalies + ess/2q) / (rows + ess/q) over q parent patterns, and
    P(cause) = (rows with cause + ess/2) / (rows + ess). A cause or effect with one observed state
    only has a single state, as in a network learned from data.

    Of all 2^k patterns those that never occur have the effect's prior, one half. So a sum over the patterns that
    contain some causes is a product of their priors times one half, plus what the observed ones among them add: causes
    that nobody asks for are summed out in closed form, and no table of 2^k entries is built.
    """

    MOST_CAUSES, MOST_PATTERNS = 62, 50_000

    def __init__(self, counts: Sequence[tuple[int, int, int]], causes: Sequence[str], ess: float = 10.0) -> None:
        if len(causes) > self.MOST_CAUSES:
            raise ValueError(f"at most {self.MOST_CAUSES} causes: a pattern is one number")
        if len(counts) > self.MOST_PATTERNS:
            raise ValueError(f"at most {self.MOST_PATTERNS} patterns of causes may occur: they are compared with each other")
        self.causes = tuple(causes)
        k = len(self.causes)
        pattern = np.array([p for p, _, _ in counts], np.int64)
        n, a = (np.array([c[i] for c in counts], float) for i in (1, 2))
        rows, anomalies = n.sum(), a.sum()
        has = np.array([(pattern >> i) & 1 for i in range(k)], float).reshape(k, len(pattern))
        yes = has @ n
        free = (yes > 0) & (yes < rows)
        self.prior = [float((yes[i] + ess / 2) / (rows + ess)) if free[i] else float(rows > 0 and yes[i] == rows) for i in range(k)]
        q = 2.0 ** int(free.sum())
        self._pattern, self._weight = pattern, np.ones(len(pattern))
        for i in np.flatnonzero(free):
            self._weight *= np.where(has[i] == 1, self.prior[i], 1 - self.prior[i])
        both = 0 < anomalies < rows
        # Effect of a pattern that does not occur, and how far the observed ones are from it.
        self._unseen = 0.5 if both else float(anomalies > 0)
        effect = (a + ess / (2 * q)) / (n + ess / q) if both else np.full(len(pattern), self._unseen)
        self._added = self._weight * (effect - self._unseen)
        self.baseline = self._joint(0)

    def _mass(self, active: int) -> float:
        """P(the active causes are present)."""
        return float(np.prod([p for i, p in enumerate(self.prior) if active >> i & 1]))

    def _joint(self, active: int) -> float:
        """P(effect and the active causes)."""
        return self._unseen * self._mass(active) + float(self._added[(self._pattern & active) == active].sum())

    def probability(self, active: int) -> float:
        """P(effect | the active causes are present), the other causes left open."""
        mass = self._mass(active)
        return self.baseline if active == 0 or mass == 0 else self._joint(active) / mass

    def posterior(self, i: int) -> float:
        """P(cause i | effect)."""
        return 0.0 if self.baseline == 0 or self.prior[i] == 0 else self._joint(1 << i) / self.baseline


def fit_cause_network(df: DataFrame, causes: Sequence[str], outcome: str, ess: float = 10.0) -> CauseNetwork:
    counts = [(r.pattern, r.rows, r.anomalies) for r in pattern_counts(df, causes, outcome).collect()]
    return CauseNetwork(counts, causes, ess)


def apply_cause_network(df: DataFrame, net: CauseNetwork, top: int = 3) -> DataFrame:
    """Probability per record by its pattern of active causes, and its best causes by lift."""
    causes = net.causes
    seen = df.withColumn("_pattern", _pattern(causes))
    patterns = [r["_pattern"] for r in seen.select("_pattern").distinct().limit(net.MOST_PATTERNS + 1).collect()]
    if len(patterns) > net.MOST_PATTERNS:
        raise ValueError(f"at most {net.MOST_PATTERNS} patterns of causes may occur: they are compared with each other")
    table = df.sparkSession.createDataFrame([(p, round(net.probability(p), 6)) for p in patterns], "_pattern long, bayesian_anomaly_probability double")
    items = []
    for i, c in enumerate(causes):
        posterior, base = net.posterior(i), net.prior[i]
        lift = posterior / base if base > 0 else 0.0
        items.append(F.when(flag(F.col(c)), F.struct(
            F.lit(-lift).alias("order"), F.lit(-posterior).alias("second"), F.lit(c).alias("cause"),
            F.lit(round(posterior, 6)).alias("probability_given_anomaly"), F.lit(round(base, 6)).alias("baseline_probability"), F.lit(round(lift, 4)).alias("bayesian_lift"),
        )))
    joined = seen.join(F.broadcast(table), "_pattern")  # one row per pattern that occurs, counted above
    return joined.select(
        *df.columns, "bayesian_anomaly_probability",
        F.slice(F.sort_array(F.array_compact(F.array(*items))), 1, top).alias("probable_root_causes"),
    )
