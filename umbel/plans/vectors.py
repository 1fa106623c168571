"""Vector arithmetic, exact and hashed search, matching of descriptor sets, pairs and losses."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from umbel.functions import vectors as v
from umbel.operators import matching, pairs, search
from umbel.operators.frames import tasks_for
from umbel.plans.fixtures import SQL_DESCRIPTORS, SQL_MATCHES, descriptors, matches
from umbel.plans.registry import Tables, query


@query("j1_j18_exact_search", f"WITH {SQL_MATCHES} SELECT algorithm, descriptor AS query, neighbour, distance, pos FROM matches")
def j1(t: Tables) -> DataFrame:
    """Exact L2 search of all queries in the whole index, both algorithms, twenty neighbours."""
    return matches(t).select("algorithm", F.col("descriptor").alias("query"), "neighbour", "distance", "pos")


@query(
    "j2_w12_knn_with_self",
    """WITH e AS (SELECT vec_id, embedding::DOUBLE[] AS v FROM embeddings),
    p AS (SELECT q.vec_id AS query, i.vec_id AS neighbour, list_distance(q.v, i.v) AS d FROM e q, e i WHERE q.vec_id % 50 = 0)
    SELECT query, neighbour, round(d, 6) AS distance, pos::INT AS pos FROM (SELECT *, row_number() OVER (PARTITION BY query ORDER BY d, neighbour) AS pos FROM p) WHERE pos <= 100""",
)
def j2(t: Tables) -> DataFrame:
    """The hundred nearest of all rows, itself included, for the query set of ids divisible by 50."""
    e = t.embeddings
    near = search.knn(e.where("vec_id % 50 = 0"), e, 100, "vec_id", "embedding")
    return near.select("query", "neighbour", F.round("distance", 6).alias("distance"), "pos")


#: Of 256 buckets: the measured recall on unit vectors without clusters, the hardest case, is 0.9 and more (see j4_lsh_recall).
LSH = {"tables": 1, "bits": 8, "probes": 204, "dimension": 64}


@query("j4_v20_lsh_search")
def j4(t: Tables) -> DataFrame:
    """Search among rows in the nearest buckets of a table of random projections."""
    d = descriptors(t)
    near = search.lsh_search(d.where("angle <> 360"), d.where("angle = 360"), 20, id_col="vec_id", **LSH)
    return near.select("query", "neighbour", F.round("distance", 6).alias("distance"), "pos")


@query("j4_lsh_recall")
def j4_recall(t: Tables) -> DataFrame:
    """Share of the true first and twenty neighbours that the same search finds for the query set of ids divisible by 50, and the share of rows it compares."""
    e = t.embeddings
    q, rows = e.where("vec_id % 50 = 0"), e.count()
    found = search.lsh_search(q, e, 21, id_col="vec_id", vector_col="embedding", **LSH).where("query <> neighbour")
    truth = search.knn(q, e, 20, "vec_id", "embedding", with_self=False).select("query", "neighbour", F.col("pos").alias("true_pos"))
    hit = truth.join(found.select("query", "neighbour", F.lit(1).alias("hit")), ["query", "neighbour"], "left").na.fill(0, ["hit"])
    recalls = hit.agg(F.avg(F.when(F.col("true_pos") == 1, F.col("hit"))).alias("recall_1"), F.avg("hit").alias("recall_20"))
    share = found.groupBy("query").agg(F.max("compared").alias("n")).agg((F.avg("n") / rows).alias("share_compared"))
    return recalls.crossJoin(F.broadcast(share))  # one row each


@query("v20_k5_sign_buckets")
def v20(t: Tables) -> DataFrame:
    """Bucket of every vector: the signs of eight random projections."""
    return search.sign_bits(t.embeddings.select("vec_id", "embedding"), search.projections(64, 8), "embedding").select("vec_id", "bucket")


@query("v21_s19_k14_projection_tree")
def v21(t: Tables) -> DataFrame:
    """Leaves of a projection tree whose buckets keep twenty rows at least."""
    return search.projection_tree(t.embeddings.select("vec_id", "embedding"), search.projections(64, 8), 20, "embedding").select("vec_id", "node")


@query(
    "v1_v4_vector_functions",
    """WITH e AS (SELECT vec_id, embedding::DOUBLE[] AS v, list_reverse(embedding)::DOUBLE[] AS w FROM embeddings)
    SELECT vec_id, round(list_distance(v, w), 6) AS l2, round(pow(list_distance(v, w), 2), 6) AS l2_squared, round(list_inner_product(v, w), 6) AS dot, round(list_cosine_similarity(v, w), 6) AS cosine,
    round(v[1] / sqrt(list_inner_product(v, v)), 6) AS unit_first FROM e""",
)
def v1(t: Tables) -> DataFrame:
    e = t.embeddings.select("vec_id", F.col("embedding").cast("array<double>").alias("v")).withColumn("w", F.reverse("v"))
    a, b = F.col("v"), F.col("w")
    return e.select(
        "vec_id", F.round(v.distance(a, b), 6).alias("l2"), F.round(v.squared_distance(a, b), 6).alias("l2_squared"), F.round(v.dot(a, b), 6).alias("dot"), F.round(v.cosine(a, b), 6).alias("cosine"),
        F.round(F.get(v.normalised(a), 0), 6).alias("unit_first"),
    )


@query("v5_subvectors", "SELECT vec_id, " + ", ".join(f"round(list_sum(embedding[{i * 8 + 1}:{i * 8 + 8}]::DOUBLE[]), 5) AS s{i}" for i in range(8)) + " FROM embeddings")
def v5(t: Tables) -> DataFrame:
    """Sums of the eight contiguous sub-vectors."""
    e = F.col("embedding").cast("array<double>")
    return t.embeddings.select("vec_id", *[F.round(F.aggregate(p, F.lit(0.0), lambda s, x: s + x), 5).alias(f"s{i}") for i, p in enumerate(v.parts(e, 8, 64))])


_SQL_PAIRS = """e AS (SELECT vec_id // 25 AS batch, vec_id AS id, label, embedding::DOUBLE[] AS v FROM embeddings),
p AS (SELECT a.batch, a.id AS a, b.id AS b, a.label = b.label AS same, pow(list_distance(a.v, b.v), 2) AS d2 FROM e a JOIN e b ON a.batch = b.batch AND a.id < b.id)"""


def _batches(t: Tables) -> DataFrame:
    """All vectors in batches of 25 consecutive ids, as a training loader would give them."""
    return t.embeddings.select(F.expr("vec_id DIV 25").alias("batch"), F.col("vec_id").alias("id"), "label", F.col("embedding").cast("array<double>").alias("vector"))


@query("j13_v2_pairs", f"WITH {_SQL_PAIRS} SELECT batch, a, b, same, round(d2, 6) AS d2 FROM p")
def j13(t: Tables) -> DataFrame:
    """Positive and negative pairs of every batch with squared distances."""
    return pairs.pairs(_batches(t)).withColumn("d2", F.round("d2", 6))


@query(
    "o13_v28_hard_negative_pairs",
    f"""WITH {_SQL_PAIRS}, r AS (SELECT *, row_number() OVER (PARTITION BY batch, same ORDER BY d2, a, b) AS n, count(*) FILTER (WHERE same) OVER (PARTITION BY batch) AS pos FROM p)
    SELECT batch, a, b, same, round(d2, 6) AS d2 FROM r WHERE same OR n <= pos""",
)
def v28(t: Tables) -> DataFrame:
    """All positive pairs and as many of the closest negative ones."""
    return pairs.select_negatives(pairs.pairs(_batches(t)), "hard").withColumn("d2", F.round("d2", 6))


@query(
    "v28_random_negative_pairs",
    f"""WITH {_SQL_PAIRS}, r AS (SELECT *, row_number() OVER (PARTITION BY batch, same ORDER BY ('0x' || left(md5(concat_ws(':', '0', a, b)), 15))::BIGINT, a, b) AS n, count(*) FILTER (WHERE same) OVER (PARTITION BY batch) AS pos FROM p)
    SELECT batch, a, b, same, round(d2, 6) AS d2 FROM r WHERE same OR n <= pos""",
)
def v28_random_pairs(t: Tables) -> DataFrame:
    """All positive pairs and as many negative ones by a seeded hash."""
    return pairs.select_negatives(pairs.pairs(_batches(t)), "random").withColumn("d2", F.round("d2", 6))


_SQL_TRIPLETS = (
    _SQL_PAIRS
    + """, n AS (SELECT batch, a AS anchor, b AS negative, d2 AS an FROM p WHERE NOT same UNION ALL SELECT batch, b, a, d2 FROM p WHERE NOT same),
t AS (SELECT p.batch, p.a AS anchor, p.b AS positive, n.negative, p.d2 - n.an + 0.5 AS loss FROM p JOIN n ON n.batch = p.batch AND n.anchor = p.a WHERE p.same)"""
)


@query("j14_triplets", f"WITH {_SQL_TRIPLETS} SELECT batch, anchor, positive, negative, round(loss, 6) AS loss FROM t")
def j14(t: Tables) -> DataFrame:
    """All triplets of every batch with their losses at margin 0.5."""
    return pairs.triplets(_batches(t), 0.5).withColumn("loss", F.round("loss", 6))


@query(
    "v28_hardest_triplets",
    f"""WITH {_SQL_TRIPLETS} SELECT batch, anchor, positive, negative, round(loss, 6) AS loss FROM (
    SELECT *, row_number() OVER (PARTITION BY batch, anchor, positive ORDER BY loss DESC, negative) AS r FROM t WHERE loss > 0) WHERE r = 1""",
)
def v28_hardest(t: Tables) -> DataFrame:
    return pairs.triplets(_batches(t), 0.5, "hardest").withColumn("loss", F.round("loss", 6))


def _sql_seeded(where: str) -> str:
    h = "('0x' || left(md5(concat_ws(':', '1', anchor, positive, negative)), 15))::BIGINT"
    return f"""WITH {_SQL_TRIPLETS} SELECT batch, anchor, positive, negative, round(loss, 6) AS loss FROM (
    SELECT *, row_number() OVER (PARTITION BY batch, anchor, positive ORDER BY {h}, negative) AS r FROM t WHERE {where}) WHERE r = 1"""


@query("v28_semihard_triplets", _sql_seeded("loss > 0 AND loss < 0.5"))
def v28_semihard(t: Tables) -> DataFrame:
    """One seeded negative of loss between 0 and the margin for each positive pair."""
    return pairs.triplets(_batches(t), 0.5, "semihard", seed=1).withColumn("loss", F.round("loss", 6))


@query("x7_random_triplets", _sql_seeded("loss > 0"))
def v28_random(t: Tables) -> DataFrame:
    """One seeded negative of loss above 0 for each positive pair."""
    return pairs.triplets(_batches(t), 0.5, "random", seed=1).withColumn("loss", F.round("loss", 6))


@query(
    "v29_losses",
    f"""WITH {_SQL_TRIPLETS}, c AS (SELECT avg(0.5 * CASE WHEN same THEN d2 ELSE pow(greatest(1.5 - sqrt(d2 + 1e-9), 0), 2) END) AS contrastive, avg(CASE WHEN same THEN d2 ELSE pow(greatest(1.5 - sqrt(d2), 0), 2) END) AS online_contrastive FROM p)
    SELECT round(contrastive, 6) AS contrastive, round(online_contrastive, 6) AS online_contrastive, round((SELECT avg(greatest(loss, 0)) FROM t), 6) AS triplet FROM c""",
)
def v29(t: Tables) -> DataFrame:
    """Mean contrastive and triplet losses."""
    p = pairs.pairs(_batches(t))
    c = p.agg(
        F.round(F.avg(pairs.contrastive_loss(F.col("d2"), F.col("same"), 1.5)), 6).alias("contrastive"),
        F.round(F.avg(pairs.online_contrastive_loss(F.col("d2"), F.col("same"), 1.5)), 6).alias("online_contrastive"),
    )
    tr = pairs.triplets(_batches(t), 0.5).agg(F.round(F.avg(pairs.triplet_loss(F.col("loss"))), 6).alias("triplet"))
    return c.crossJoin(tr)  # one row each


@query(
    "v29_nt_xent",
    """WITH e AS (SELECT vec_id // 25 AS batch, vec_id AS id, 0 AS view, embedding::DOUBLE[] AS v FROM embeddings UNION ALL SELECT vec_id // 25, vec_id, 1, list_reverse(embedding)::DOUBLE[] FROM embeddings),
    s AS (SELECT a.batch, a.id, a.view, a.id = b.id AS own, list_cosine_similarity(a.v, b.v) / 0.5 AS s FROM e a JOIN e b ON a.batch = b.batch AND (a.id <> b.id OR a.view <> b.view))
    SELECT batch, round(avg(l), 6) AS loss FROM (SELECT batch, id, view, ln(sum(exp(s))) - max(CASE WHEN own THEN s END) AS l FROM s GROUP BY ALL) GROUP BY batch""",
)
def v29_nt(t: Tables) -> DataFrame:
    """Cross-entropy of two views of every vector; the second view is the reversed vector."""
    b = _batches(t)
    views = b.withColumn("view", F.lit(0)).unionByName(b.withColumn("vector", F.reverse("vector")).withColumn("view", F.lit(1)))
    return pairs.nt_xent(views).withColumn("loss", F.round("loss", 6))


_SQL_SETS = """s AS (SELECT vec_id, vec_id // 20 AS pair, vec_id % 20 < 8 AS ver, embedding::DOUBLE[] AS v FROM embeddings),
n AS (SELECT a.pair, a.vec_id AS kp, b.vec_id AS kp2, list_distance(a.v, b.v) AS d FROM s a JOIN s b ON a.pair = b.pair AND a.ver AND NOT b.ver),
r AS (SELECT *, row_number() OVER (PARTITION BY pair, kp ORDER BY d, kp2) AS r FROM n),
two AS (SELECT pair, kp, max(CASE WHEN r = 1 THEN kp2 END) AS first, max(CASE WHEN r = 1 THEN d END) AS d1, max(CASE WHEN r = 2 THEN d END) AS d2 FROM r WHERE r <= 2 GROUP BY ALL)"""


def _sets(t: Tables) -> tuple[DataFrame, DataFrame]:
    """Runs of 20 vectors as image pairs: eight verified keypoints, twelve reference ones."""
    s = t.embeddings.select(F.expr("vec_id DIV 20").alias("pair"), F.col("vec_id").alias("kp"), (F.col("vec_id") % 20 < 8).alias("ver"), F.col("embedding").cast("array<double>").alias("vector"))
    return s.where("ver").drop("ver"), s.where("NOT ver").drop("ver")


@query("j5_w10_two_nearest", f"WITH {_SQL_SETS} SELECT pair, kp, first, round(d1, 6) AS d1, round(d2, 6) AS d2 FROM two")
def j5(t: Tables) -> DataFrame:
    """Two nearest reference descriptors of every verified one, exactly."""
    return matching.two_nearest(*_sets(t), ["pair"]).withColumns({"d1": F.round("d1", 6), "d2": F.round("d2", 6)})


@query("x11_forest_two_nearest", f"WITH {_SQL_SETS} SELECT pair, kp, first, round(d1, 6) AS d1, round(d2, 6) AS d2 FROM two")
def x11(t: Tables) -> DataFrame:
    """The same by a forest of kd-trees that may open every cell, which is exact."""
    found = matching.two_nearest_of_sets(*_sets(t), "pair", "flann", checks=None)
    return found.select("pair", "kp", "first", F.round("d1", 6).alias("d1"), F.round("d2", 6).alias("d2"))


@query("x11_forest_recall")
def x11_recall(t: Tables) -> DataFrame:
    """Share of the true two nearest that 5 trees find with 32 to 512 checks among some 300 reference descriptors, and the share of them compared.

    The vectors have no clusters, where a kd-tree is at its worst; matches of real descriptors lie far nearer than the rest.
    """
    s = t.embeddings.select(F.expr("vec_id DIV 400").alias("pair"), F.col("vec_id").alias("kp"), F.col("embedding").cast("array<double>").alias("vector"))
    ver, ref = s.where("kp % 4 = 0"), s.where("kp % 4 <> 0")
    sizes = ref.groupBy("pair").agg(F.count("*").alias("n"))
    exact = matching.two_nearest_of_sets(ver, ref, "pair", "brute").select("pair", "kp", F.col("d2").alias("true_d2"))
    out = None
    for checks in (32, 128, 512):
        found = matching.two_nearest_of_sets(ver, ref, "pair", "flann", checks=checks).join(exact, ["pair", "kp"]).join(sizes, "pair")
        hits = (F.col("d1") <= F.col("true_d2") + 1e-12).cast("int") + (F.col("d2") <= F.col("true_d2") + 1e-12).cast("int")
        row = found.agg(F.lit(checks).alias("checks"), F.avg(hits / 2).alias("recall_2"), F.avg(F.col("compared") / F.col("n")).alias("share_compared"))
        out = row if out is None else out.unionByName(row)
    return out


@query("f19_ratio_test", f"WITH {_SQL_SETS} SELECT pair, count(*) AS matches, count(*) FILTER (WHERE d1 < 0.9 * d2) AS good FROM two GROUP BY pair")
def f19(t: Tables) -> DataFrame:
    """Matches and those that pass the ratio test (at 0.9 here: these vectors have no near copies)."""
    return matching.match_counts(matching.two_nearest(*_sets(t), ["pair"]), ["pair"], 0.9)


@query("i27_x4_x12_match_and_ransac")
def i27(t: Tables) -> DataFrame:
    """Matching of whole descriptor sets with inlier counts; a pair that can't be matched gives an error row."""
    ver, ref = _sets(t)
    point = F.array((F.col("kp") % 97).cast("double"), (F.col("kp") % 89).cast("double"))
    side = lambda d, s: d.groupBy("pair").agg(F.sort_array(F.collect_list(F.struct("kp", point.alias("p"), "vector"))).alias(s))
    j = side(ver, "a").join(side(ref, "b"), "pair", "left")
    rows = j.select(
        F.col("pair").cast("string").alias("pair"), F.transform("a", lambda x: x["p"]).alias("points_ver"), F.transform("a", lambda x: x["vector"]).alias("descriptors_ver"),
        F.transform("b", lambda x: x["p"]).alias("points_ref"), F.transform("b", lambda x: x["vector"]).alias("descriptors_ref"),
    )
    return matching.match_pairs(rows, 0.95)


@query(
    "f10_index_split",
    f"WITH {SQL_DESCRIPTORS} SELECT angle = 360 AS is_index, count(*) AS n FROM d GROUP BY 1",
)
def f10(t: Tables) -> DataFrame:
    from umbel.functions.keys import is_index

    return descriptors(t).groupBy(is_index(F.col("filename")).alias("is_index")).agg(F.count("*").alias("n"))


def _document_vectors(t: Tables) -> DataFrame:
    """(vec_id, embedding) of every document with a word: signed counts of its words in 64 hashed places, of length 1.

    A text's words are hashed and counted where it is read, so that it is shuffled as 64 numbers.
    """
    words = F.array_remove(F.split(F.lower(F.coalesce("text", F.lit(""))), r"[\x20\x09-\x0D]+"), "")
    hashed = t.documents.select("doc_id", F.transform(words, lambda w: F.xxhash64(w)).alias("hashes"))
    kind = dict(hashed.dtypes)["doc_id"]

    def counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for start in range(0, whole.num_rows, 1024):
                b = whole.slice(start, 1024)
                h, row = b.column("hashes").flatten().to_numpy(), np.repeat(np.arange(b.num_rows) * 64, b.column("hashes").value_lengths().to_numpy())
                n = np.bincount(row + (h & 63), weights=(h >> 32 & 1) * 2 - 1, minlength=b.num_rows * 64).astype(np.int32)
                yield pa.RecordBatch.from_arrays([b.column("doc_id"), pa.FixedSizeListArray.from_arrays(pa.array(n), 64).cast(pa.list_(pa.int32()))], ["doc_id", "n"])

    def of_length_1(ids: pa.Array, n: np.ndarray) -> pa.RecordBatch:
        length = np.sqrt((n * n).sum(axis=1))
        some = np.flatnonzero(length)
        v = pa.FixedSizeListArray.from_arrays(pa.array((n[some] / length[some, None]).ravel()), 64)
        return pa.RecordBatch.from_arrays([ids.take(pa.array(some)), v.cast(pa.list_(pa.float64()))], ["vec_id", "embedding"])

    def summed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids, sums = None, np.zeros((0, 64))  # of the last id, which may go on in the next batch
        for b in batches:
            if b.num_rows:
                runs = pc.run_end_encode(b.column("doc_id") if ids is None else pa.concat_arrays([ids, b.column("doc_id")]))
                n = np.add.reduceat(np.concatenate([sums, search.matrix(b.column("n"))]), [0, *runs.run_ends.to_numpy()[:-1]])
                yield of_length_1(runs.values[:-1], n[:-1])
                ids, sums = runs.values[-1:], n[-1:]
        if ids is not None:
            yield of_length_1(ids, sums)

    sums = hashed.mapInArrow(counted, f"doc_id {kind}, n array<int>")
    return sums.repartition(tasks_for(t.spark, t.documents.count()), "doc_id").sortWithinPartitions("doc_id").mapInArrow(summed, f"vec_id {kind}, embedding array<double>")


def _curve(rows: DataFrame, probes: tuple[int, ...], data: str) -> DataFrame:
    """(data, probes, share_compared, recall_1, recall_20): the query set of ids divisible by 50 against all rows.

    Copies are as near as each other, so a neighbour counts by its distance, not by its name. A query that finds none of the twenty
    counts as one that compares no row.
    """
    n = rows.count()
    # one search for all numbers of probes: what lsh_search would find with each of them
    each = search.probe_hits(rows.where("vec_id % 50 = 0"), rows, 20, probes, id_col="vec_id", vector_col="embedding", **{k: x for k, x in LSH.items() if k != "probes"})
    found = lambda i: F.coalesce(F.get("hits", i), F.lit(0))
    row = lambda i, p: F.struct(
        F.lit(p).alias("probes"), F.round(F.avg(F.when(found(i) > 0, F.get("compared", i)).otherwise(0)) / n, 4).alias("share_compared"),
        F.round(F.avg(F.coalesce(F.get("first", i), F.lit(False)).cast("int")), 4).alias("recall_1"), F.round(F.avg(found(i)) / 20, 4).alias("recall_20"),
    )
    return each.agg(F.array(*[row(i, p) for i, p in enumerate(probes)]).alias("rows")).select(F.lit(data).alias("data"), F.inline("rows"))


@query("j4_recall_curve")
def j4_curve(t: Tables) -> DataFrame:
    """Recall against the share of rows compared: vectors without clusters, and word vectors of the documents, which have weak ones."""
    path = t.scratch("document-vectors")
    _document_vectors(t).write.parquet(path)
    docs = t.spark.read.parquet(path)
    return _curve(t.embeddings.select("vec_id", "embedding"), (4, 32, 96, 204), "embeddings").unionByName(_curve(docs, (4, 32, 96, 204), "documents"))
