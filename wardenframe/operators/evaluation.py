"""Binary evaluation of a flag and a score against known outcomes."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from wardenframe.functions.quantiles import running_totals


def _share(part: Column, whole: Column) -> Column:
    return F.coalesce(F.try_divide(part.cast("double"), whole.cast("double")), F.lit(0.0))


def classification_metrics(df: DataFrame, truth: str, predicted: str) -> DataFrame:
    """Confusion counts, accuracy, precision, recall and F1 (0 where undefined) in one aggregate."""
    t, p = F.col(truth) == 1, F.col(predicted) == 1
    row = df.where(F.col(truth).isNotNull()).agg(
        F.count_if(t & p).alias("true_positive"), F.count_if(~t & p).alias("false_positive"), F.count_if(t & ~p).alias("false_negative"), F.count_if(~t & ~p).alias("true_negative")
    )
    tp, fp, fn, tn = (F.col(c) for c in ("true_positive", "false_positive", "false_negative", "true_negative"))
    return row.select(
        "*",
        _share(tp + tn, tp + fp + fn + tn).alias("accuracy"),
        _share(tp, tp + fp).alias("precision"),
        _share(tp, tp + fn).alias("recall"),
        _share(2 * tp, 2 * tp + fp + fn).alias("f1"),
    )


def roc_auc(df: DataFrame, truth: str, score: str) -> DataFrame:
    """Area under the ROC curve by ranks, ties counted half; NULL when only one class is present.

    Works on counts per distinct score with distributed running totals, so no task sees all scores.
    """
    known = df.where(F.col(truth).isNotNull() & F.col(score).isNotNull())
    per_score = known.groupBy(score).agg(F.count_if(F.col(truth) == 1).alias("pos"), F.count_if(F.col(truth) == 0).alias("neg"))
    ordered = running_totals(per_score, score, ["neg"])
    below = F.col("neg_upto") - F.col("neg") + F.col("neg") / 2.0
    return ordered.agg(F.try_divide(F.sum(F.col("pos") * below), (F.sum("pos") * F.sum("neg")).cast("double")).alias("roc_auc"))
