"""Pairs and triplets of labelled vectors, and the losses over them.

All pairs of one batch are what these operators are defined on, so every one takes ``batch``: pairs are
formed within a batch of bounded size, never over a whole corpus.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from umbel.functions.vectors import cosine, dot, squared_distance
from umbel.operators.frames import seeded

EPSILON = 1e-9


def pairs(df: DataFrame, batch: str = "batch") -> DataFrame:
    """(batch, a, b, same, d2) for all ids a < b of a batch; ``df`` has id, label, vector (array<double>)."""
    a = df.select(batch, F.col("id").alias("a"), F.col("label").alias("la"), F.col("vector").alias("va"))
    b = df.select(batch, F.col("id").alias("b"), F.col("label").alias("lb"), F.col("vector").alias("vb"))
    j = a.join(b, batch).where("a < b")
    return j.select(batch, "a", "b", (F.col("la") == F.col("lb")).alias("same"), squared_distance(F.col("va"), F.col("vb")).alias("d2"))


def select_negatives(all_pairs: DataFrame, how: str, batch: str = "batch", seed: int = 0) -> DataFrame:
    """Positive pairs and as many negative ones of each batch: the closest (``hard``), or by a seeded hash (``random``); ``all`` keeps all."""
    if how == "all":
        return all_pairs
    order = {"hard": [F.col("d2").asc(), F.col("a"), F.col("b")], "random": [seeded(seed, "a", "b"), F.col("a"), F.col("b")]}[how]
    ranked = all_pairs.withColumn("r", F.row_number().over(Window.partitionBy(batch, "same").orderBy(*order)))
    counted = ranked.withColumn("p", F.count_if("same").over(Window.partitionBy(batch)))
    return counted.where(F.col("same") | (F.col("r") <= F.col("p"))).drop("r", "p")


def triplets(df: DataFrame, margin: float, how: str = "all", batch: str = "batch", seed: int = 0) -> DataFrame:
    """(batch, anchor, positive, negative, loss): same-label pairs with negatives of other labels of the batch.

    ``all`` keeps every negative; ``hardest`` the one of the greatest loss if that is above 0; ``random``
    any of loss above 0 and ``semihard`` any of loss between 0 and the margin, by a seeded hash. Ties go to
    the least id. Loss is not clipped.
    """
    every = pairs(df, batch)
    positive = every.where("same").select(batch, F.col("a").alias("anchor"), F.col("b").alias("positive"), F.col("d2").alias("ap"))
    other = every.where(~F.col("same"))
    both = other.select(batch, F.col("a").alias("anchor"), F.col("b").alias("negative"), F.col("d2").alias("an")).unionByName(
        other.select(batch, F.col("b").alias("anchor"), F.col("a").alias("negative"), F.col("d2").alias("an"))
    )
    t = positive.join(both, [batch, "anchor"]).select(batch, "anchor", "positive", "negative", (F.col("ap") - F.col("an") + margin).alias("loss"))
    if how == "all":
        return t
    wanted = {"hardest": F.col("loss") > 0, "random": F.col("loss") > 0, "semihard": (F.col("loss") > 0) & (F.col("loss") < margin)}[how]
    order = [F.col("loss").desc()] if how == "hardest" else [seeded(seed, "anchor", "positive", "negative")]
    first = F.row_number().over(Window.partitionBy(batch, "anchor", "positive").orderBy(*order, "negative"))
    return t.where(wanted).withColumn("r", first).where("r = 1").drop("r")


def contrastive_loss(d2: Column, same: Column, margin: float) -> Column:
    """Half the squared distance of a positive pair, or half the squared gap to the margin of a negative one."""
    gap = F.greatest(F.lit(margin) - F.sqrt(d2 + EPSILON), F.lit(0.0))
    return 0.5 * F.when(same, d2).otherwise(gap * gap)


def online_contrastive_loss(d2: Column, same: Column, margin: float) -> Column:
    """Squared distance of a positive pair, or the squared gap to the margin of a negative one."""
    gap = F.greatest(F.lit(margin) - F.sqrt(d2), F.lit(0.0))
    return F.when(same, d2).otherwise(gap * gap)


def triplet_loss(loss: Column) -> Column:
    return F.greatest(loss, F.lit(0.0))


def nt_xent(views: DataFrame, temperature: float = 0.5, use_cosine: bool = True, batch: str = "batch") -> DataFrame:
    """(batch, loss): normalised-temperature cross-entropy; ``views`` has id, view (0 or 1) and vector, both views of each id."""
    a = views.select(batch, F.col("id").alias("ia"), F.col("view").alias("wa"), F.col("vector").alias("va"))
    b = views.select(batch, F.col("id").alias("ib"), F.col("view").alias("wb"), F.col("vector").alias("vb"))
    j = a.join(b, batch).where((F.col("ia") != F.col("ib")) | (F.col("wa") != F.col("wb")))
    s = (cosine if use_cosine else dot)(F.col("va"), F.col("vb")) / temperature
    logits = j.select(batch, "ia", "wa", (F.col("ia") == F.col("ib")).alias("own"), s.alias("s"))
    # the greatest logit is taken off before exponents, so that none overflows
    top = logits.groupBy(batch, "ia", "wa").agg(F.max("s").alias("m"), F.max(F.when(F.col("own"), F.col("s"))).alias("p"))
    rows = logits.join(top, [batch, "ia", "wa"]).groupBy(batch, "ia", "wa", "m", "p").agg(F.sum(F.exp(F.col("s") - F.col("m"))).alias("z"))
    return rows.groupBy(batch).agg(F.avg(F.log("z") + F.col("m") - F.col("p")).alias("loss"))
