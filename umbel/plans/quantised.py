"""Locally optimised product quantisation: fixed centroids against SQL, trained models by their properties."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from umbel.functions import vectors as v
from umbel.lopq import LOPQModel, build_index, evaluate, search
from umbel.lopq.model import cell_moments, coarse_rounds
from umbel.lopq.search import cells_in_order, cells_to_quota, distances, search_reranked, share_quota, write_index
from umbel.operators.retrieval import recall
from umbel.operators.search import knn
from umbel.plans.registry import Tables, query

V = 4
#: Coarse centroids that both dialects know: the halves of the first vectors.
_SQL_FIXED = f"""e AS (SELECT vec_id, embedding::DOUBLE[] AS v FROM embeddings),
c AS (SELECT vec_id AS c, v[1:32] AS h0, v[33:64] AS h1 FROM e WHERE vec_id < {V}),
f AS (SELECT e.vec_id, c.c, pow(list_distance(e.v[1:32], c.h0), 2) AS d0, pow(list_distance(e.v[33:64], c.h1), 2) AS d1 FROM e, c),
codes AS (SELECT vec_id AS id, arg_min(c, (d0, c))::INT AS c0, arg_min(c, (d1, c))::INT AS c1 FROM f GROUP BY vec_id)"""


def _fixed(t: Tables) -> tuple[np.ndarray, np.ndarray]:
    rows = t.embeddings.where(F.col("vec_id") < V).orderBy("vec_id").select("embedding").collect()
    x = np.array([r[0] for r in rows], float)
    return x[:, :32], x[:, 32:]


def _codes(t: Tables) -> DataFrame:
    cs = _fixed(t)
    e = F.col("embedding").cast("array<double>")
    halves = v.parts(e, 2, 64)
    near = [v.nearest(h, F.array(*[v.literal(c) for c in part])) for h, part in zip(halves, cs, strict=True)]
    return t.embeddings.select(F.col("vec_id").alias("id"), near[0].alias("c0"), near[1].alias("c1"))


@query("v6_c20_nearest_centroids", f"WITH {_SQL_FIXED} SELECT id, c0, c1, c1 + c0 * {V} AS cell FROM codes")
def v6(t: Tables) -> DataFrame:
    """Coarse codes for fixed centroids, and the number of the cell."""
    return _codes(t).withColumn("cell", F.col("c1") + F.col("c0") * V)


@query(
    "v8_residuals",
    f"WITH {_SQL_FIXED} SELECT e.vec_id, round(pow(list_distance(e.v[1:32], c.h0), 2), 6) AS residual FROM e JOIN codes ON codes.id = e.vec_id JOIN c ON c.c = codes.c0",
)
def v8(t: Tables) -> DataFrame:
    """Squared length of the first half's residual."""
    cs, _ = _fixed(t)
    half = F.slice(F.col("embedding").cast("array<double>"), 1, 32)
    table = F.array(*[v.literal(c) for c in cs])
    j = t.embeddings.withColumn("h", half).withColumn("c", v.nearest(F.col("h"), table))
    r = v.minus(F.col("h"), F.get(table, F.col("c")))
    return j.select("vec_id", F.round(F.aggregate(r, F.lit(0.0), lambda s, x: s + x * x), 6).alias("residual"))


_SQL_CELLS = (
    _SQL_FIXED
    + f""", p AS (SELECT vec_id, c, d0, d1, row_number() OVER (PARTITION BY vec_id ORDER BY d0, c) AS p0, row_number() OVER (PARTITION BY vec_id ORDER BY d1, c) AS p1 FROM f WHERE vec_id % 50 = 0),
g AS (SELECT a.vec_id AS query, a.c::INT AS c0, b.c::INT AS c1, a.d0 + b.d1 AS dist, row_number() OVER (PARTITION BY a.vec_id ORDER BY a.d0 + b.d1, a.p0, b.p1)::INT AS pos FROM p a JOIN p b ON a.vec_id = b.vec_id)"""
)


@query("v15_multisequence_order", f"WITH {_SQL_CELLS} SELECT query, c0, c1, round(dist, 6) AS dist, pos FROM g")
def v15(t: Tables) -> DataFrame:
    """All cells of the grid in order of distance for the query set of ids divisible by 50."""
    q = t.embeddings.where("vec_id % 50 = 0")
    return cells_in_order(q, _fixed(t), "vec_id", "embedding").withColumn("dist", F.round("dist", 6))


@query(
    "v16_quota_cells",
    f"""WITH {_SQL_CELLS}, n AS (SELECT c0, c1, count(*) AS n FROM codes GROUP BY ALL),
    k AS (SELECT g.query, g.c0, g.c1, g.pos, coalesce(n.n, 0) AS count, sum(coalesce(n.n, 0)) OVER (PARTITION BY query ORDER BY pos) - coalesce(n.n, 0) AS before FROM g LEFT JOIN n USING (c0, c1))
    SELECT query, c0, c1, pos, count, count(*) OVER (PARTITION BY query) AS visited FROM k WHERE before < 60 OR pos = 1""",
)
def v16(t: Tables) -> DataFrame:
    """Whole cells until sixty rows are met."""
    q = t.embeddings.where("vec_id % 50 = 0")
    cells = cells_in_order(q, _fixed(t), "vec_id", "embedding")
    return cells_to_quota(cells, _codes(t), 60).select("query", "c0", "c1", "pos", "count", "visited")


@query("a30_cell_histogram", f"WITH {_SQL_FIXED} SELECT c0, c1, count(*) AS n FROM codes GROUP BY ALL")
def a30(t: Tables) -> DataFrame:
    return evaluate.cell_histogram(_codes(t))


@query(
    "v22_shared_codes",
    f"""WITH {_SQL_FIXED}, n AS (SELECT q.vec_id AS query, i.vec_id AS neighbour, row_number() OVER (PARTITION BY q.vec_id ORDER BY list_distance(q.v, i.v), i.vec_id) AS r FROM e q JOIN e i ON q.vec_id <> i.vec_id WHERE q.vec_id % 50 = 0)
    SELECT count(*) FILTER (WHERE a.c0 = b.c0 AND a.c1 = b.c1) / count(*) AS share FROM n JOIN codes a ON a.id = query JOIN codes b ON b.id = neighbour WHERE r = 1""",
)
def v22(t: Tables) -> DataFrame:
    """How many nearest neighbours share their query's coarse codes."""
    near = knn(t.embeddings.where("vec_id % 50 = 0"), t.embeddings, 1, "vec_id", "embedding", with_self=False)
    return evaluate.shared_codes(near, _codes(t))


@query(
    "v31_s12_cell_lookup",
    f"WITH {_SQL_FIXED} SELECT id, c1 FROM codes WHERE c0 = 1",
)
def v31(t: Tables) -> DataFrame:
    """A stored index, one folder per first coarse id: a lookup reads that folder."""
    path = t.scratch("cells")
    write_index(_codes(t).withColumn("fine", F.array().cast("array<smallint>")), path)
    return t.spark.read.parquet(path).where("c0 = 1").select("id", F.col("c1").cast("int").alias("c1"))


def _model(t: Tables) -> LOPQModel:
    return LOPQModel(V=4, M=8, S=16).fit(t.embeddings, "embedding", coarse_rounds=5, local_rounds=5)


@query("v12_v18_encoded_index")
def v12(t: Tables) -> DataFrame:
    """Codes of all vectors by a model trained on them (V7, V9, V10, V11 within)."""
    return build_index(t.embeddings, _model(t), "vec_id", "embedding")


@query("v13_v30_reconstruction")
def v13(t: Tables) -> DataFrame:
    """Squared error of what the codes stand for."""
    m = _model(t)
    back = m.decode(build_index(t.embeddings, m, "vec_id", "embedding")).withColumnRenamed("vector", "r")
    e = t.embeddings.select(F.col("vec_id").alias("id"), F.col("embedding").cast("array<double>").alias("v"))
    return e.join(back, "id").select("id", v.squared_distance(F.col("v"), F.col("r")).alias("error"))


#: Share of the rows that a query visits, and rows by code that are compared by their vectors: for recall of 0.9 and more on
#: unit vectors without clusters, where the cells of a query tell little; see v24_recall_of_others.
SHARE, DEPTH = 0.9, 0.5


def _stored_index(t: Tables, m: LOPQModel) -> DataFrame:
    """The index rows of all vectors, written once, as a search reads them several times."""
    path = t.scratch("index")
    build_index(t.embeddings, m, "vec_id", "embedding").write.parquet(path)
    return t.spark.read.parquet(path)


def _found(t: Tables, m: LOPQModel, limit: int) -> DataFrame:
    e = t.embeddings
    return search_reranked(e.where("vec_id % 50 = 0"), _stored_index(t, m), m, e, share_quota(e, SHARE), share_quota(e, DEPTH), limit, "vec_id", "embedding")


@query("v17_v14_lopq_search")
def v17(t: Tables) -> DataFrame:
    """Search by codes, then by vectors: the query set of ids divisible by 50 against all rows."""
    return _found(t, _model(t), 20)


@query("v24_recall")
def v24(t: Tables) -> DataFrame:
    """Recall of the true nearest neighbour, itself included, among the first 1, 10, 100 found by codes alone."""
    m = _model(t)
    q = t.embeddings.where("vec_id % 50 = 0")
    found = search(q, _stored_index(t, m), m, share_quota(t.embeddings, SHARE), 100, "vec_id", "embedding")
    truth = knn(q, t.embeddings, 1, "vec_id", "embedding")
    return recall(found.withColumn("pos", F.col("pos") - 1), truth, [1, 10, 100])


@query("v24_recall_of_others")
def v24_others(t: Tables) -> DataFrame:
    """Share of the true first and twenty other neighbours that v17's search finds."""
    found = _found(t, _model(t), 21).where("query <> neighbour").select("query", "neighbour", F.lit(1).alias("hit"))
    truth = knn(t.embeddings.where("vec_id % 50 = 0"), t.embeddings, 20, "vec_id", "embedding", with_self=False).select("query", "neighbour", F.col("pos").alias("true_pos"))
    hit = truth.join(found, ["query", "neighbour"], "left").na.fill(0, ["hit"])
    return hit.agg(F.avg(F.when(F.col("true_pos") == 1, F.col("hit"))).alias("recall_1"), F.avg("hit").alias("recall_20"))


# The whole chain with parts that both dialects know: axes turned round for rotations, a constant mean, and for the sub-centroids of
# subvector m the m-th part of the residuals of the vectors V to V + 15, seen from the cell of the vector 0.
_MU, _M, _S = 0.01, 8, 16
_SQL_LOPQ = f"""{_SQL_FIXED},
loc AS (SELECT e.vec_id AS id, codes.c0, codes.c1, list_concat(list_reverse(list_transform(range(1, 33), lambda i: e.v[i] - a.h0[i] - {_MU})), list_reverse(list_transform(range(1, 33), lambda i: e.v[32 + i] - b.h1[i] - {_MU}))) AS y
  FROM e JOIN codes ON codes.id = e.vec_id JOIN c a ON a.c = codes.c0 JOIN c b ON b.c = codes.c1),
m AS (SELECT unnest(range(0, {_M})) AS m),
sub AS (SELECT e.vec_id - {V} AS s, m.m, list_concat(list_reverse(list_transform(range(1, 33), lambda i: e.v[i] - z.h0[i])), list_reverse(list_transform(range(1, 33), lambda i: e.v[32 + i] - z.h1[i])))[m.m * 8 + 1 : m.m * 8 + 8] AS w
  FROM e, c z, m WHERE z.c = 0 AND e.vec_id >= {V} AND e.vec_id < {V + _S}),
fine AS (SELECT loc.id, sub.m, arg_min(sub.s, (pow(list_distance(loc.y[sub.m * 8 + 1 : sub.m * 8 + 8], sub.w), 2), sub.s)) AS s, min(pow(list_distance(loc.y[sub.m * 8 + 1 : sub.m * 8 + 8], sub.w), 2)) AS d FROM loc, sub GROUP BY ALL)"""


def _fixed_model(t: Tables) -> LOPQModel:
    h0, h1 = _fixed(t)
    rows = t.embeddings.where((F.col("vec_id") >= V) & (F.col("vec_id") < V + _S)).orderBy("vec_id").select("embedding").collect()
    x = np.array([r[0] for r in rows], float)
    local = [(x[:, :32] - h0[0])[:, ::-1], (x[:, 32:] - h1[0])[:, ::-1]]
    subs = tuple(np.array([h[:, i * 8 : i * 8 + 8] for i in range(_M // 2)]) for h in local)
    turned = np.array([np.eye(32)[::-1]] * V)
    return LOPQModel(V, _M, _S, (h0, h1), (turned, turned), (np.full((V, 32), _MU), np.full((V, 32), _MU)), subs)


@query("v9_v12_fixed_codes", f"WITH {_SQL_LOPQ} SELECT fine.id, c0, c1, " + ", ".join(f"max(CASE WHEN m = {i} THEN s END)::INT AS f{i}" for i in range(_M)) + " FROM fine JOIN codes USING (id) GROUP BY ALL")
def v12_fixed(t: Tables) -> DataFrame:
    """Coarse and fine codes of all vectors by a model of known parts."""
    codes = build_index(t.embeddings, _fixed_model(t), "vec_id", "embedding")
    return codes.select("id", "c0", "c1", *[F.col("fine")[i].cast("int").alias(f"f{i}") for i in range(_M)])


@query("v13_fixed_reconstruction", f"WITH {_SQL_LOPQ} SELECT id, round(sum(d), 6) AS error FROM fine GROUP BY id")
def v13_fixed(t: Tables) -> DataFrame:
    """Squared error of the decoded vectors: turned axes keep distances, so it is the sum of the subvectors' errors."""
    m = _fixed_model(t)
    back = m.decode(build_index(t.embeddings, m, "vec_id", "embedding")).withColumnRenamed("vector", "r")
    e = t.embeddings.select(F.col("vec_id").alias("id"), F.col("embedding").cast("array<double>").alias("v"))
    return e.join(back, "id").select("id", F.round(v.squared_distance(F.col("v"), F.col("r")), 6).alias("error"))


@query("v25_fixed_distortion", f"WITH {_SQL_LOPQ} SELECT m::INT AS subvector, round(avg(d), 6) AS distortion FROM fine GROUP BY m")
def v25_fixed(t: Tables) -> DataFrame:
    """Mean squared distance of each subvector to its centroid in the model of known parts."""
    d = evaluate.distortion(t.embeddings, _fixed_model(t), "embedding")
    return t.spark.createDataFrame([(i, round(float(x), 6)) for i, x in enumerate(d)], "subvector int, distortion double")


_SQL_ADC = (
    _SQL_LOPQ
    + f""", f2 AS (SELECT * FROM f WHERE vec_id % 50 = 0),
p AS (SELECT vec_id, c, d0, d1, row_number() OVER (PARTITION BY vec_id ORDER BY d0, c) AS p0, row_number() OVER (PARTITION BY vec_id ORDER BY d1, c) AS p1 FROM f2),
g AS (SELECT a.vec_id AS query, a.c::INT AS c0, b.c::INT AS c1, row_number() OVER (PARTITION BY a.vec_id ORDER BY a.d0 + b.d1, a.p0, b.p1)::INT AS pos FROM p a JOIN p b ON a.vec_id = b.vec_id),
n AS (SELECT c0, c1, count(*) AS n FROM codes GROUP BY ALL),
k AS (SELECT query, c0, c1, pos, sum(coalesce(n.n, 0)) OVER (PARTITION BY query ORDER BY pos) - coalesce(n.n, 0) AS before FROM g LEFT JOIN n USING (c0, c1)),
kept AS (SELECT query, c0, c1 FROM k WHERE before < 60 OR pos = 1),
ql AS (SELECT query, c0, c1, list_concat(list_reverse(list_transform(range(1, 33), lambda i: e.v[i] - a.h0[i] - {_MU})), list_reverse(list_transform(range(1, 33), lambda i: e.v[32 + i] - b.h1[i] - {_MU}))) AS y
  FROM kept JOIN e ON e.vec_id = kept.query JOIN c a ON a.c = kept.c0 JOIN c b ON b.c = kept.c1),
adc AS (SELECT ql.query, codes.id AS neighbour, sum(pow(list_distance(ql.y[fine.m * 8 + 1 : fine.m * 8 + 8], sub.w), 2)) AS distance
  FROM ql JOIN codes USING (c0, c1) JOIN fine ON fine.id = codes.id JOIN sub ON sub.m = fine.m AND sub.s = fine.s GROUP BY ALL)"""
)


@query("v14_v17_fixed_search", f"WITH {_SQL_ADC} SELECT query, neighbour, round(distance, 6) AS distance FROM adc")
def v17_fixed(t: Tables) -> DataFrame:
    """Distances by code to all rows of the cells that hold sixty rows, by the model of known parts."""
    m = _fixed_model(t)
    found = distances(t.embeddings.where("vec_id % 50 = 0"), _stored_index(t, m), m, 60, None, "vec_id", "embedding")
    return found.select("query", "neighbour", F.round("distance", 6).alias("distance"))


@query("v23_code_stability")
def v23(t: Tables) -> DataFrame:
    return evaluate.code_stability(t.embeddings, _model(t), "embedding")


@query("v25_distortion")
def v25(t: Tables) -> DataFrame:
    """Mean squared distance of each subvector to its centroid."""
    d = evaluate.distortion(t.embeddings, _model(t), "embedding")
    return t.spark.createDataFrame([(i, float(x)) for i, x in enumerate(d)], "subvector int, distortion double")


@query("k12_s15_model_store")
def k12(t: Tables) -> DataFrame:
    """A model written as a table and read again: shape and sum of every part."""
    path = t.scratch("model")
    _model(t).save(t.spark, path)
    rows = LOPQModel.load(t.spark, path).rows()
    return t.spark.createDataFrame([(r[0], r[1], r[2], len(r[4]), float(sum(r[4]))) for r in rows], "kind string, split int, idx int, size int, total double")


@query("k12_s14_model_files")
def k12_files(t: Tables) -> DataFrame:
    """A model written as a MAT container and as a message, read again: numbers of every part, and how far the codes of all vectors agree."""
    from umbel.sources import modelfiles

    m, out = _model(t), None
    codes = m.encode(t.embeddings, "vec_id", "embedding")
    for form in modelfiles.FORMS:
        path = t.scratch(form) + f"/model.{form}"
        modelfiles.export(m, t.spark, path, form)
        again = modelfiles.load(t.spark, path, form)
        same = again.encode(t.embeddings, "vec_id", "embedding").select("id", *[F.col(c).alias(f"{c}_") for c in ("c0", "c1", "fine")]).join(codes, "id")
        row = same.agg(
            F.lit(form).alias("form"), *[F.lit(sum(len(r[4]) for r in again.rows() if r[0] == k)).alias(k) for k in ("Cs", "Rs", "mus", "subs")],
            F.avg(((F.col("c0") == F.col("c0_")) & (F.col("c1") == F.col("c1_"))).cast("int")).alias("same_cell"), F.avg((F.col("fine") == F.col("fine_")).cast("int")).alias("same_code"),
        )
        out = row if out is None else out.unionByName(row)
    return out


_SQL_SEEDED = """e AS (SELECT vec_id, h AS half, embedding[(h * 32 + 1)::INT : (h * 32 + 32)::INT]::DOUBLE[] AS v FROM embeddings, (VALUES (0), (1)) AS t(h)),
  seed AS (SELECT half, row_number() OVER (PARTITION BY half ORDER BY vec_id) - 1 AS cell, v AS c FROM e QUALIFY row_number() OVER (PARTITION BY half ORDER BY vec_id) <= 4),
  near AS (SELECT vec_id, e.half, arg_min(cell, list_distance(v, c)) AS cell FROM e JOIN seed USING (half) GROUP BY vec_id, e.half),
  x AS (SELECT half, cell, vec_id, unnest(v) AS v, unnest(range(0, 32)) AS d FROM near JOIN e USING (vec_id, half))"""


def _seeds(t: Tables) -> list[np.ndarray]:
    """The halves of the four vectors of least id."""
    first = np.array([r["embedding"] for r in t.embeddings.orderBy("vec_id").limit(4).collect()], float)
    return np.split(first, 2, axis=1)


@query("v7_seeded_coarse_round", f"WITH {_SQL_SEEDED} SELECT half, cell::INT AS cell, d::INT AS dimension, round(avg(v), 6) AS centre FROM x GROUP BY half, cell, d")
def v7(t: Tables) -> DataFrame:
    """Coarse centroids after one round from given seeds, every component of every cell."""
    found = coarse_rounds(t.embeddings, _seeds(t), 1, "embedding")
    rows = [(s, i, d, float(v)) for s, c in enumerate(found) for i, row in enumerate(c) for d, v in enumerate(row)]
    return t.spark.createDataFrame(rows, "half int, cell int, dimension int, centre double").withColumn("centre", F.round("centre", 6))


@query(
    "a32_cell_moments",
    f"""WITH {_SQL_SEEDED}, r AS (SELECT x.half, x.cell, vec_id, d, v - c[d + 1] AS r FROM x JOIN seed s ON s.half = x.half AND s.cell = x.cell),
    p AS (SELECT half, cell, vec_id, list(r ORDER BY d) AS r FROM r GROUP BY ALL)
    SELECT half, cell::INT AS cell, count(*) AS n, round(sum(list_inner_product(r, r)), 5) AS trace, round(sum(r[1] * r[32]), 5) AS corner, round(sum(r[2]), 5) AS second FROM p GROUP BY half, cell""",
)
def a32(t: Tables) -> DataFrame:
    """Count, trace and one corner of the sum of outer products, and one component of the sum, of the residuals of each cell."""
    rows = t.embeddings.select(F.col("embedding").cast("array<double>").alias("v"))
    m = cell_moments(rows, tuple(_seeds(t)))
    out = [(s, i, int(m[f"n{s}"][i]), *(round(float(x), 5) + 0.0 for x in (np.trace(m[f"o{s}"][i]), m[f"o{s}"][i][0, 31], m[f"t{s}"][i][1]))) for s in (0, 1) for i in range(4)]
    return t.spark.createDataFrame(out, "half int, cell int, n bigint, trace double, corner double, second double")
