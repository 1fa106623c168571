"""Retrieval analytics, masks and metrics, losses of labelled masks, fine-matching analytics."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from umbel.functions import metrics
from umbel.operators import matching, regions, retrieval
from umbel.plans.fixtures import SQL_FINE, SQL_MATCHES, fine, matches
from umbel.plans.registry import Tables, query

_BEST = "SELECT *, row_number() OVER (PARTITION BY algorithm, phone, sample ORDER BY ransac DESC NULLS LAST, line, candidate) AS r FROM fine_match"


@query(
    "a20_accuracy",
    f"WITH {SQL_FINE} SELECT algorithm, phone, count(*) FILTER (WHERE match) AS hits, count(*) AS samples, count(*) FILTER (WHERE match) / count(*) AS accuracy FROM ({_BEST}) WHERE r = 1 GROUP BY ALL",
)
def a20(t: Tables) -> DataFrame:
    """Share of samples whose best candidate is the right package, per algorithm and phone."""
    return retrieval.accuracy(fine(t), ["algorithm", "phone"], "sample", "ransac", ["line", "candidate"])


@query(
    "a20_nearest_neighbour_accuracy",
    f"WITH {SQL_MATCHES} SELECT algorithm, count(*) FILTER (WHERE match) AS hits, count(*) AS queries, count(*) FILTER (WHERE match) / count(*) AS accuracy FROM matches WHERE pos = 1 GROUP BY algorithm",
)
def a20_nn(t: Tables) -> DataFrame:
    """The minimum slice: exact search, match flag, accuracy of the nearest."""
    m = matches(t, 1).groupBy("algorithm").agg(F.count_if("match").alias("hits"), F.count("*").alias("queries"))
    return m.withColumn("accuracy", F.try_divide("hits", "queries"))


@query(
    "a21_miss_probability",
    f"WITH {SQL_MATCHES} SELECT algorithm, 1 - count(DISTINCT CASE WHEN match THEN sample END) / count(DISTINCT sample) AS miss, count(DISTINCT CASE WHEN match THEN sample END) / count(DISTINCT sample) AS hit FROM matches GROUP BY algorithm",
)
def a21(t: Tables) -> DataFrame:
    """Misses and hits are given apart."""
    out = matches(t).groupBy("algorithm").agg(retrieval.miss_probability(F.col("match"), F.col("sample")).alias("miss"), F.count_distinct(F.when(F.col("match"), F.col("sample"))).alias("h"), F.count_distinct("sample").alias("n"))
    return out.select("algorithm", "miss", F.try_divide("h", "n").alias("hit"))


@query(
    "a22_miss_percentage",
    f"WITH {SQL_MATCHES} SELECT count(*) AS groups, count(*) FILTER (WHERE hit) AS hits, 100 - count(*) FILTER (WHERE hit) / count(*) * 100 AS miss_percent FROM (SELECT package_actual, phone, bool_or(match) AS hit FROM matches GROUP BY ALL)",
)
def a22(t: Tables) -> DataFrame:
    return retrieval.miss_percentage(matches(t), ["package_actual", "phone"], "match")


@query("a24_majority", f"WITH {SQL_FINE} SELECT count(*) FILTER (WHERE yes > no) AS majority, count(*) AS samples, count(*) FILTER (WHERE yes > no) / count(*) AS share FROM (SELECT sample, count(*) FILTER (WHERE match) AS yes, count(*) FILTER (WHERE NOT match) AS no FROM fine_match GROUP BY sample)")
def a24(t: Tables) -> DataFrame:
    return retrieval.majority_share(fine(t), "sample", "match")


@query(
    "a25_neighbour_sweep",
    f"""WITH {SQL_MATCHES}, n AS (SELECT unnest(range(1, 20, 2)) AS n),
    kept AS (SELECT n, algorithm AS arm, sample, package, match FROM matches, n WHERE pos <= n UNION ALL SELECT n, 'Both', sample, package, match FROM matches, n WHERE pos <= n),
    per AS (SELECT n, arm, sample, count(DISTINCT package) AS p, bool_or(match) AS hit FROM kept GROUP BY ALL)
    SELECT n::INT AS n, arm, trunc(avg(p))::INT AS list_size, 1 - count(*) FILTER (WHERE hit) / (SELECT count(DISTINCT sample) FROM matches) AS miss FROM per GROUP BY n, arm""",
)
def a25(t: Tables) -> DataFrame:
    """List size and misses for 1, 3, ..., 19 neighbours, by algorithm and for both."""
    return retrieval.neighbour_sweep(matches(t), list(range(1, 20, 2)))


@query(
    "p7_fine_match_ratios",
    f"""WITH {SQL_FINE} SELECT sample, line, match AS package_match, good / nullif(matches, 0) AS good_ratio, ransac / nullif(matches, 0) AS ransac_ratio, ransac / nullif(good, 0) AS ransac_good_ratio,
    matches / nullif(good + 1, 0) AS keypoint_ratio FROM fine_match WHERE ransac IS NOT NULL""",
)
def p7_fine(t: Tables) -> DataFrame:
    """Ratios of fine-matching results; rows without a count are left out."""
    f = fine(t).select(
        "sample", "line", "package_actual", F.col("candidate").alias("package_candidate"), F.col("matches").alias("matches_amount"), F.col("good").alias("good_matches_amount"),
        F.col("ransac").alias("ransac_matches_amount"), F.col("matches").alias("kp_amount_actual"), (F.col("good") + 1).alias("kp_amount_candidate"),
    )
    return matching.match_features(f).select("sample", "line", "package_match", "good_ratio", "ransac_ratio", "ransac_good_ratio", "keypoint_ratio")


@query(
    "f7_below_least_match",
    f"WITH {SQL_FINE} SELECT sample, line FROM fine_match WHERE NOT match AND good < (SELECT min(good) + 1 FROM fine_match WHERE match)",
)
def f7_fine(t: Tables) -> DataFrame:
    """Wrong candidates with fewer good matches than any right one has."""
    f = fine(t)
    least = f.where("match").agg((F.min("good") + 1).alias("least"))
    return f.where("NOT match").crossJoin(F.broadcast(least)).where("good < least").select("sample", "line")


_MASK = "m AS (SELECT quality = 1 AS v, toxic = 1 AS r FROM labels)"
_COUNTS = "count(*) FILTER (WHERE v AND r) AS tp, count(*) FILTER (WHERE NOT v AND NOT r) AS tn, count(*) FILTER (WHERE v AND NOT r) AS fp, count(*) FILTER (WHERE NOT v AND r) AS fn"


def _sql_ratio(a: str, b: str) -> str:
    return f"(CASE WHEN ({b}) <> 0 THEN ({a})::DOUBLE / ({b})::DOUBLE ELSE 1.0::DOUBLE END)"


def sql_scores() -> str:
    """The metrics over columns tp, tn, fp, fn."""
    r = _sql_ratio
    tpr, fpr, tnr, fnr, prc = r("tp", "tp + fn"), r("fp", "fp + tn"), r("tn", "tn + fp"), r("fn", "tp + fn"), r("tp", "tp + fp")
    found = {
        "IOU": r("tp", "tp + fp + fn"), "TPR": tpr, "FPR": fpr, "TNR": tnr, "FNR": fnr, "PRV": r("tp + fn", "tp + fp + tn + fn"), "ACC": r("tp + tn", "tp + fp + tn + fn"), "FDR": r("fp", "tp + fp"),
        "PRC": prc, "FOR": r("fn", "fn + tn"), "NPV": r("tn", "tn + fn"), "PLR": r(tpr, fpr), "NLR": r(fnr, tnr), "F1S": f"2 * {r(f'{prc} * {tpr}', f'{prc} + {tpr}')}",
    }
    return ", ".join(f'CASE WHEN tp = 0 THEN -1.0::DOUBLE ELSE round_even(({found[m]}) * 1000, 0) / 1000 END AS "{m}"' for m in metrics.METRICS)


def _mask(t: Tables) -> DataFrame:
    return t.labels.select((F.col("quality") == 1).alias("v"), (F.col("toxic") == 1).alias("r"), F.lit(0).alias("k"))


@query("a33_confusion_counts", f"WITH {_MASK} SELECT {_COUNTS} FROM m")
def a33(t: Tables) -> DataFrame:
    return _mask(t).agg(*[c.alias(k) for k, c in metrics.confusion(F.col("v"), F.col("r")).items()])


@query("m1_m2_m4_mask_metrics", f"WITH {_MASK}, c AS (SELECT {_COUNTS} FROM m) SELECT tp, tn, fp, fn, {sql_scores()} FROM c")
def m1(t: Tables) -> DataFrame:
    """The fourteen metrics of two masks."""
    return regions.mask_scores(_mask(t), ["k"], "v", "r").drop("k")


@query("m3_essential_metrics", f"WITH {_MASK}, c AS (SELECT {_COUNTS} FROM m) SELECT " + ", ".join(f'"{m}"' for m in metrics.ESSENTIAL) + f" FROM (SELECT {sql_scores()} FROM c)")
def m3(t: Tables) -> DataFrame:
    return regions.mask_scores(_mask(t), ["k"], "v", "r").select(*metrics.ESSENTIAL)


@query("m2_nothing_found", "SELECT p_partkey, " + ", ".join(f'-1.0::DOUBLE AS "{m}"' for m in metrics.METRICS) + " FROM part")
def m2(t: Tables) -> DataFrame:
    """Without a true positive every metric has the fixed negative value."""
    n = F.col("p_size")
    return metrics.add_scores(t.part.select("p_partkey", F.lit(0).alias("tp"), n.alias("tn"), n.alias("fp"), n.alias("fn"))).select("p_partkey", *metrics.METRICS)


@query("u5_mask_operations", "SELECT quality = 1 AND toxic = 1 AS both_, quality = 1 OR toxic = 1 AS either, (quality = 1) <> (toxic = 1) AS one, count(*) AS n FROM labels GROUP BY ALL")
def u5(t: Tables) -> DataFrame:
    ops = regions.combine_masks(F.col("v"), F.col("r"))
    return _mask(t).select(ops["both"].alias("both_"), ops["either"].alias("either"), ops["one"].alias("one")).groupBy("both_", "either", "one").agg(F.count("*").alias("n"))


@query(
    "m7_auc",
    """WITH c AS (SELECT length(text) % 50 AS s, count(*) FILTER (WHERE quality = 1) AS p, count(*) FILTER (WHERE quality = 0) AS n FROM labels JOIN documents USING (doc_id) GROUP BY 1),
    b AS (SELECT *, sum(n) OVER (ORDER BY s) - n AS below FROM c) SELECT round((sum(p * (below + n / 2)) / (sum(p) * sum(n)))::DOUBLE, 9) AS auc FROM b""",
)
def m7(t: Tables) -> DataFrame:
    """Area under the curve of an arbitrary score against a label."""
    d = t.labels.join(t.documents, "doc_id").select((F.length("text") % 50).alias("s"), "quality")
    return retrieval.auc(d, "s", "quality").select(F.round("auc", 9).alias("auc"))


@query(
    "m7_roc_curve",
    """WITH c AS (SELECT length(text) % 50 AS s, count(*) FILTER (WHERE quality = 1) AS p, count(*) FILTER (WHERE quality = 0) AS n FROM labels JOIN documents USING (doc_id) GROUP BY 1)
    SELECT s::INT AS threshold, round((sum(n) OVER (ORDER BY s DESC) / sum(n) OVER ())::DOUBLE, 9) AS fpr, round((sum(p) OVER (ORDER BY s DESC) / sum(p) OVER ())::DOUBLE, 9) AS tpr FROM c""",
)
def m7_roc(t: Tables) -> DataFrame:
    d = t.labels.join(t.documents, "doc_id").select((F.length("text") % 50).alias("s"), "quality")
    return retrieval.roc(d, "s", "quality").select("threshold", F.round("fpr", 9).alias("fpr"), F.round("tpr", 9).alias("tpr"))


@query("m6_linear_classifier")
def m6(t: Tables) -> DataFrame:
    """Standardise, fit support vectors on 80 % of the rows, predict the rest: confusion counts. Margins are linear."""
    from umbel.operators.frames import hash_split
    from umbel.operators.statistics import classifier

    o = t.lineitem.select("l_orderkey", "l_linenumber", "l_quantity", "l_extendedprice", "l_discount", (F.col("l_extendedprice") > 40000).cast("int").alias("label"))
    o = o.withColumn("part", hash_split(F.concat_ws("-", "l_orderkey", "l_linenumber"), [0.8, 0.2]))
    model = classifier(o.where("part = 0"), ["l_quantity", "l_extendedprice", "l_discount"], "label", 2, 10)
    return model.transform(o.where("part = 1")).groupBy("label", F.col("prediction").cast("int").alias("predicted")).agg(F.count("*").alias("n"))


@query("m6_kernel_classifier")
def m6_kernel(t: Tables) -> DataFrame:
    """A class inside a ring, which no line parts from the rest: area under the curve and accuracy of radial and linear margins on the held-out fifth."""
    from umbel.operators.frames import hash_split
    from umbel.operators.statistics import KernelClassifier, classifier

    x, y = (F.col("l_quantity") - 25.5) / 25, (F.col("l_discount") - 0.05) / 0.05
    o = t.lineitem.select(F.concat_ws("-", "l_orderkey", "l_linenumber", "l_partkey").alias("row"), x.cast("double").alias("x"), y.cast("double").alias("y"))
    o = o.withColumn("label", (F.col("x") * F.col("x") + F.col("y") * F.col("y") < 0.6).cast("int")).withColumn("part", hash_split(F.col("row"), [0.8, 0.2]))
    train, test = o.where("part = 0"), o.where("part = 1")
    found = KernelClassifier(["x", "y"], "label", "row", iterations=30).fit(train).margins(test).select("label", "margin", "predicted")
    linear = classifier(train, ["x", "y"], "label", 2, 10).transform(test)
    from pyspark.ml.functions import vector_to_array

    linear = linear.select("label", F.get(vector_to_array("rawPrediction"), F.lit(1)).alias("margin"), F.col("prediction").cast("int").alias("predicted"))
    out = None
    for name, rows in (("radial", found), ("linear", linear)):
        accuracy = rows.agg(F.avg((F.col("label") == F.col("predicted")).cast("int")).alias("accuracy"))
        row = retrieval.auc(rows.withColumn("s", F.round("margin", 6)), "s", "label").select(F.lit(name).alias("kernel"), "auc").crossJoin(accuracy)  # one row each
        out = row if out is None else out.unionByName(row)
    return out


@query(
    "x9_metric_accumulators",
    """WITH e AS (SELECT vec_id % 4 AS fold, embedding[1:5]::DOUBLE[] AS o, label % 5 AS l, len(list_filter(embedding, lambda x: x > 0)) AS n, list_sum(embedding[1:8]::DOUBLE[]) AS s FROM embeddings)
    SELECT fold, 'Accuracy' AS metric, round(100 * avg((list_position(o, list_max(o)) - 1 = l)::INT), 6) AS value FROM e GROUP BY fold
    UNION ALL SELECT fold, 'Average nonzero triplets', round(avg(n), 6) FROM e GROUP BY fold
    UNION ALL SELECT fold, 'Deviation', round(stddev_pop(s), 6) FROM e GROUP BY fold""",
)
def x9(t: Tables) -> DataFrame:
    """Three metrics of four folds through one interface of mergeable states."""
    from umbel.operators import accumulators as acc

    v = F.col("embedding").cast("array<double>")
    rows = t.embeddings.select(
        (F.col("vec_id") % 4).alias("fold"), F.slice(v, 1, 5).alias("outputs"), (F.col("label") % 5).alias("label"), F.size(F.filter(v, lambda x: x > 0)).alias("losses"),
        F.aggregate(F.slice(v, 1, 8), F.lit(0.0), lambda s, x: s + x).alias("score"),
    )
    return acc.evaluate(rows, [acc.Accuracy(), acc.Average("losses"), acc.Deviation("score")], "fold").withColumn("value", F.round("value", 6))
