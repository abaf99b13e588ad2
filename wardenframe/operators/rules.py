"""Declarative rules: a list of ``Rule`` compiles to one array of evidence structs in one projection."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column
from pyspark.sql import functions as F

from wardenframe.functions.columns import flag, highest_severity

EVIDENCE_TYPE = "struct<rule:string,severity:string,reason:string,value:double,threshold:double,column:string>"


@dataclass(frozen=True, eq=False)
class Rule:
    """One check. ``reason`` may be text or a column; ``value``/``threshold``/``column`` are optional proof."""

    name: str
    severity: str
    reason: str | Column
    when: Column
    value: Column | None = None
    threshold: float | None = None
    column: str | None = None

    def evidence(self) -> Column:
        reason = F.lit(self.reason) if isinstance(self.reason, str) else self.reason
        value = F.lit(None) if self.value is None else self.value
        item = F.struct(
            F.lit(self.name).alias("rule"),
            F.lit(self.severity).alias("severity"),
            reason.alias("reason"),
            value.cast("double").alias("value"),
            F.lit(self.threshold).cast("double").alias("threshold"),
            F.lit(self.column).cast("string").alias("column"),
        )
        return F.when(flag(self.when), item)


def evidence_array(rules: Sequence[Rule]) -> Column:
    """Evidence of every rule that fires, in rule order."""
    return F.array_compact(F.array(*[r.evidence() for r in rules]))


def two_level(name: str, value: Column, medium: float, high: float, active: Column, texts: tuple[str, str], level_in_name: bool = True, column: str | None = None) -> list[Rule]:
    """A limit pair: HIGH at ``high`` and above, else MEDIUM at ``medium`` and above."""
    high_name, medium_name = (f"{name}_high", f"{name}_medium") if level_in_name else (name, name)
    return [
        Rule(high_name, "HIGH", texts[0], active & (value >= high), value, high, column),
        Rule(medium_name, "MEDIUM", texts[1], active & (value >= medium) & (value < high), value, medium, column),
    ]


def names(evidence: Column) -> Column:
    return F.transform(evidence, lambda e: e["rule"])


def verdict_columns(evidence: Column, order: Sequence[str]) -> list[Column]:
    """Any evidence, strongest severity and count."""
    return [
        (F.size(evidence) > 0).alias("rule_anomaly"),
        highest_severity(F.transform(evidence, lambda e: e["severity"]), order).alias("rule_severity"),
        F.size(evidence).alias("rule_count"),
    ]
