"""Quality rules with thresholds from mergeable quantile sketches per language and source (operator 2, native).

The sketch of a metric is a set of counters over logarithmic buckets (relative error ``ALPHA``): adding
two sketches is adding counters, so it is built by partial aggregation, one pass, in any order, and the
sketches of a language and of the whole are merged from those of the groups. Counters are exact, so every
rerun gives the same thresholds.
"""

from __future__ import annotations

import math

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from umbel.llm.store import BLANK_CHARS, BLANKS, drop_ids, keyed_lookup, numbered, row_number, settle, words_column

#: Relative error of a quantile.
ALPHA = 0.01
#: The thresholds of a group of n sound rows weigh n / (n + SHRINK) against those of its language, and these likewise
#: against those of all rows, so no row's verdict jumps as its group grows.
SHRINK = 200
#: A value is an outlier beyond the quantiles u and 1 - u by so many of their distances.
FENCE = 3.0
#: metric (a value per 1000 words): (u, units that are no distance yet, judged on the low side too). Junk may hold a share of 1 - u of
#: a group's sound rows before the quantile itself gives way: a quarter for symbols and word lengths; repetition has a natural tail in
#: sound texts, and texts that are mostly repeats fail the base rule, so there the tail itself is measured. A distance is at least
#: that many counts in a text of the group's median length.
METRICS = {
    "symbols": (0.75, 1, False),
    "dup_lines": (0.98, 1, False),
    "repeats": (0.98, 3, False),
    "word_length": (0.75, 1, True),
}
#: The sketch whose median gives the size of one count.
LENGTH = "n_words"
COUNTS = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")


def text_counts(docs: DataFrame, text_col: str = "text") -> DataFrame:
    """``docs`` with COUNTS, without the text; words, characters, symbols, repeated lines and repeated 3-word windows.

    Windows are compared by a 64-bit hash of their three words. Texts in which no window returns, the
    great majority, skip the sort.
    """
    other = [c for c in docs.columns if c != text_col]
    t = F.coalesce(F.col(text_col), F.lit(""))
    lines = F.filter(F.split(t, "\n"), lambda x: F.btrim(x, F.lit(BLANK_CHARS)) != "")
    d = docs.select(
        *other,
        words_column(F.col(text_col)).alias("__w"),
        lines.alias("__l"),
        F.length(F.regexp_replace(t, f"[{BLANKS}]+", "")).cast("bigint").alias("word_chars"),
        F.length(F.regexp_replace(t, r"[^#*$%&|<>]+", "")).cast("bigint").alias("n_symbols"),
    )
    w, n = F.col("__w"), F.size("__w")
    window = lambda i: F.xxhash64(F.get(w, i), F.get(w, i + 1), F.get(w, i + 2))
    d = d.select(
        *other, "word_chars", "n_symbols",
        n.cast("bigint").alias("n_words"),
        (F.size("__l") - F.size(F.array_distinct("__l"))).cast("bigint").alias("n_dup_lines"),
        F.when(n > 2, F.transform(F.sequence(F.lit(0), n - 3), window)).otherwise(F.array().cast("array<bigint>")).alias("__h"),
    )
    h = F.col("__h")
    placed = F.sort_array(F.transform(h, lambda x, i: F.struct(x.alias("h"), i.alias("p"))))
    d = d.withColumn("__s", F.when(F.size(F.array_distinct(h)) < F.size(h), placed)).drop("__h")
    s = F.col("__s")
    same = lambda x, i, by: F.coalesce(x["h"] == F.get(s, i + by)["h"], F.lit(False))
    returning = F.filter(s, lambda x, i: same(x, i, 1) | ((i > 0) & same(x, i, -1)))
    starts = F.sort_array(F.transform(returning, lambda x: x["p"]))
    covered = F.aggregate(
        starts,
        F.struct(F.lit(0).alias("end"), F.lit(0).cast("bigint").alias("n")),
        lambda a, p: F.struct((p + 3).alias("end"), (a["n"] + p + 3 - F.greatest(a["end"], p)).alias("n")),
        lambda a: a["n"],
    )
    d = d.withColumn("n_repeat_words", F.coalesce(covered, F.lit(0)).cast("bigint"))
    return d.select(*other, *COUNTS)


def base_failed() -> "F.Column":
    return (F.col("n_words") < 50) | (100 * F.col("n_repeat_words") > 50 * F.col("n_words"))


def metric(name: str) -> "F.Column":
    part = {"symbols": "n_symbols", "dup_lines": "n_dup_lines", "repeats": "n_repeat_words", "word_length": "word_chars"}[name]
    return F.expr(f"CASE WHEN n_words > 0 THEN 1000.0D * {part} / n_words ELSE 0.0D END")


def bucket(value) -> "F.Column":
    """0 for values under 1, else the index of the logarithmic bucket (gamma^(k-1), gamma^k]."""
    gamma = (1 + ALPHA) / (1 - ALPHA)
    return F.when(value < 1, F.lit(0)).otherwise(F.ceil(F.log(value) / F.lit(math.log(gamma)) - F.lit(1e-9)).cast("int") + 1).cast("int")


def bucket_value(b) -> "F.Column":
    """The value that stands for bucket ``b``: within ALPHA of all values in it."""
    gamma = (1 + ALPHA) / (1 - ALPHA)
    return F.when(b == 0, F.lit(0.0)).otherwise(2 * F.pow(F.lit(gamma), (b - 1).cast("double")) / F.lit(gamma + 1))


def sketches(counts: DataFrame, groups: list[str]) -> DataFrame:
    """(level, *groups, metric, bucket, n): the sketch of every metric and of n_words for each group, first group column and all rows.

    Only sound rows (not base_failed) are counted. Level 0 is the full group, higher levels drop group
    columns from the right; dropped columns are null.
    """
    values = {m: metric(m) for m in METRICS} | {LENGTH: F.col("n_words").cast("double")}
    pairs = F.array(*[F.struct(F.lit(m).alias("metric"), bucket(v).alias("bucket")) for m, v in values.items()])
    long = counts.where(~base_failed()).select(*groups, F.explode(pairs).alias("x")).select(*groups, "x.*")
    finest = settle(long.groupBy(*groups, "metric", "bucket").agg(F.count("*").alias("n")), "sketch")
    out = finest.select(F.lit(0).alias("level"), *groups, "metric", "bucket", "n")
    for level in range(1, len(groups) + 1):
        kept = groups[: len(groups) - level]
        merged = finest.groupBy(*kept, "metric", "bucket").agg(F.sum("n").alias("n"))
        out = out.unionByName(merged.withColumn("level", F.lit(level)), allowMissingColumns=True)
    return out


def thresholds(sketch: DataFrame, groups: list[str]) -> DataFrame:
    """One row per group of level 0: *groups and low_<metric>, high_<metric>.

    Each level's own thresholds are drawn from its sketch; then those of a group are weighed against the
    next level's, from the level of all rows downwards (see SHRINK).
    """
    by = ["level", *groups, "metric"]
    runs = sketch.groupBy(*by).agg(F.sort_array(F.collect_list(F.struct("bucket", "n"))).alias("runs"), F.sum("n").alias("total"))
    # the number of buckets of a metric is bounded by the width of its values' logarithm, so the lists are short

    def quantile(q):
        least = F.greatest(F.lit(1), F.ceil(q * F.col("total"))).cast("bigint")
        walk = F.aggregate(
            "runs",
            F.struct(F.lit(0).cast("bigint").alias("seen"), F.lit(None).cast("int").alias("at")),
            lambda a, x: F.struct((a["seen"] + x["n"]).alias("seen"), F.when(a["at"].isNull() & (a["seen"] + x["n"] >= least), x["bucket"]).otherwise(a["at"]).alias("at")),
            lambda a: a["at"],
        )
        return bucket_value(walk)

    def of_metric(values: dict[str, float]):
        return F.create_map(*[x for m, v in values.items() for x in (F.lit(m), F.lit(v))])[F.col("metric")]

    upper = of_metric({m: u for m, (u, _, _) in METRICS.items()} | {LENGTH: 0.5})
    lower = of_metric({m: 1 - u for m, (u, _, _) in METRICS.items()} | {LENGTH: 0.5})
    q = runs.select(*by, "total", quantile(upper).alias("u"), quantile(lower).alias("l"))
    at = lambda m, c: F.max(F.when(F.col("metric") == m, F.col(c)))
    wide = q.groupBy("level", *groups).agg(F.max("total").alias("total"), at(LENGTH, "u").alias("words"), *[at(m, c).alias(f"{c}_{m}") for m in METRICS for c in "ul"])
    limits = {}
    for m, (_, units, low) in METRICS.items():
        spread = F.greatest(F.col(f"u_{m}") - F.col(f"l_{m}"), F.lit(1000.0 * units) / F.col("words"))
        limits[f"high_{m}"] = F.col(f"u_{m}") + FENCE * spread
        if low:
            limits[f"low_{m}"] = F.col(f"l_{m}") - FENCE * spread
    wide = settle(wide.select("level", *groups, "total", *[v.alias(k) for k, v in limits.items()]), "levels")
    out = wide.where("level = 0").select(*groups, F.struct("total", *limits).alias("l0"))
    for level in range(1, len(groups)):
        kept = groups[: len(groups) - level]
        at_level = wide.where(F.col("level") == level).select(*[F.col(k).alias(f"k_{k}") for k in kept], F.struct("total", *limits).alias(f"l{level}"))
        out = out.join(at_level, [F.col(k).eqNullSafe(F.col(f"k_{k}")) for k in kept], "left").drop(*[f"k_{k}" for k in kept])
    if groups:  # the level of all rows is one row, so its few numbers go into the plan
        top = wide.where(F.col("level") == len(groups)).select("total", *limits).first()
        values = [F.lit(top[c] if top else None).cast("bigint" if c == "total" else "double").alias(c) for c in ("total", *limits)]
        out = out.withColumn(f"l{len(groups)}", F.struct(*values))
    chosen = {c: F.col(f"l{len(groups)}.{c}") for c in limits}
    for level in reversed(range(len(groups))):
        n = F.col(f"l{level}.total").cast("double")
        chosen = {c: (n * F.col(f"l{level}.{c}") + SHRINK * v) / (n + SHRINK) for c, v in chosen.items()}
    return out.select(*groups, *[v.alias(c) for c, v in chosen.items()])


def verdict() -> "F.Column":
    """True if no metric is beyond its group's thresholds; rows without thresholds pass."""
    bad = F.lit(False)
    for m, (_, _, low) in METRICS.items():
        bad = bad | F.coalesce(metric(m) > F.col(f"high_{m}"), F.lit(False))
        if low:
            bad = bad | F.coalesce(metric(m) < F.col(f"low_{m}"), F.lit(False))
    return ~bad


def judge(docs: DataFrame, text_col: str = "text", groups: tuple[str, ...] = ("lang", "source"), keep: tuple[str, ...] = ("doc_id",), row_id: str | None = None) -> DataFrame:
    """One row per row of ``docs``: the columns of ``keep``, COUNTS, base_failed, kept, row_id.

    Null texts have no words and fail. Null group values form groups of their own. An empty table gives
    no rows; repeated rows are judged alike; other columns are ignored. Texts are counted whole, once:
    the counts are settled as a narrow table before thresholds are drawn from them. ``row_id`` names a
    column of numbers to use instead of new ones.
    """
    g = [f"g{i}" for i in range(len(groups))]
    narrow = docs.select(
        *[F.col(c).alias(f"k{i}") for i, c in enumerate(keep)], *[F.col(c).alias(a) for a, c in zip(g, groups, strict=True)],
        F.col(text_col).alias("text"), row_number(row_id).alias("row_id"),
    )
    counts = settle(text_counts(narrow), "counts")
    limits = settle(thresholds(sketches(counts, g), g), "limits")
    judged = keyed_lookup(counts, limits, g, "row_id")
    return judged.select(
        *[F.col(f"k{i}").alias(c) for i, c in enumerate(keep)], *COUNTS,
        base_failed().alias("base_failed"), (~base_failed() & verdict()).alias("kept"), "row_id",
    )


def keep_good(docs: DataFrame, text_col: str = "text", groups: tuple[str, ...] = ("lang", "source")) -> DataFrame:
    """The rows of ``docs`` that pass, with all their columns."""
    docs, rid = numbered(docs)
    gone = judge(docs, text_col, groups, (), rid).where(~F.col("kept")).select("row_id")
    return drop_ids(docs, gone.withColumnRenamed("row_id", rid), rid).drop(rid)
