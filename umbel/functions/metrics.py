"""Ratios and the metrics of binary masks."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Metric codes, in order.
METRICS = ("IOU", "TPR", "FPR", "TNR", "FNR", "PRV", "ACC", "FDR", "PRC", "FOR", "NPV", "PLR", "NLR", "F1S")
ESSENTIAL = ("IOU", "TPR", "FPR", "TNR", "FNR", "ACC", "PRC", "F1S")
#: Value of all metrics where no positive was found.
NONE_FOUND = -1.0


def ratio(a: Column, b: Column) -> Column:
    """a / b in double, 1.0 where b is zero."""
    return F.when(b != 0, F.try_divide(a.cast("double"), b.cast("double"))).when(b == 0, F.lit(1.0))


def confusion(verified: Column, reference: Column) -> dict[str, Column]:
    """Aggregates tp, tn, fp, fn of two boolean columns; rows with a null count nowhere."""
    return {
        "tp": F.count_if(verified & reference), "tn": F.count_if(~verified & ~reference),
        "fp": F.count_if(verified & ~reference), "fn": F.count_if(~verified & reference),
    }


def add_scores(df: DataFrame) -> DataFrame:
    """Adds the metrics of the columns tp, tn, fp, fn in order, rounded half-even to three digits; NONE_FOUND everywhere if tp is 0.

    Ratios that others are made of are columns first, so that each is computed once.
    """
    tp, tn, fp, fn = (F.col(c) for c in ("tp", "tn", "fp", "fn"))
    every = tp + fp + tn + fn
    first = {
        "IOU": ratio(tp, tp + fp + fn), "TPR": ratio(tp, tp + fn), "FPR": ratio(fp, fp + tn), "TNR": ratio(tn, tn + fp), "FNR": ratio(fn, tp + fn),
        "PRV": ratio(tp + fn, every), "ACC": ratio(tp + tn, every), "FDR": ratio(fp, tp + fp), "PRC": ratio(tp, tp + fp), "FOR": ratio(fn, fn + tn), "NPV": ratio(tn, tn + fn),
    }
    tpr, prc = F.col("TPR"), F.col("PRC")
    second = {"PLR": ratio(tpr, F.col("FPR")), "NLR": ratio(F.col("FNR"), F.col("TNR")), "F1S": 2 * ratio(prc * tpr, prc + tpr)}
    out = df.withColumns(first).withColumns(second)
    return out.withColumns({m: F.when(tp == 0, F.lit(NONE_FOUND)).otherwise(F.rint(F.col(m) * 1000) / 1000) for m in METRICS})


def nan_to_null(c: Column) -> Column:
    """NaN counts as missing."""
    return F.when(~F.isnan(c), c)


def truncated_mean(c: Column) -> Column:
    """Aggregate: the mean, cut to a whole number."""
    return F.avg(c).cast("int")
