"""Projections, filters, joins, aggregates, windows, sorts and sets on relational tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from umbel.functions.metrics import truncated_mean
from umbel.operators import frames, prefix, retrieval, statistics
from umbel.plans.registry import Tables, query

# projections


@query("p1_rename", "SELECT c_custkey AS customer, c_nationkey AS nation FROM customer")
def p1(t: Tables) -> DataFrame:
    return t.customer.withColumnsRenamed({"c_custkey": "customer", "c_nationkey": "nation"}).select("customer", "nation")


@query("p2_swap_columns", "SELECT p_partkey, p_type AS p_brand, p_brand AS p_type FROM part")
def p2(t: Tables) -> DataFrame:
    return frames.swap(t.part.select("p_partkey", "p_brand", "p_type"), "p_brand", "p_type")


@query("p3_p11_drop_column", "SELECT s_suppkey, s_name, s_acctbal FROM supplier")
def p3(t: Tables) -> DataFrame:
    """Dropping a column; what pandas does with an index is nothing here."""
    return t.supplier.drop("s_nationkey")


@query("p4_drop_empty_columns", "SELECT n_nationkey, n_name FROM nation")
def p4(t: Tables) -> DataFrame:
    n = t.nation.select("n_nationkey", "n_name", F.when(F.col("n_regionkey") < 0, F.col("n_regionkey")).alias("never"))
    return frames.drop_empty_columns(n)


_SESSION_SQL = """session AS (
  SELECT o_orderkey AS fi_key, o_orderstatus AS ses_status, o_custkey % 5 AS fi_class, l_extendedprice AS "er_MI1_ALL_v", l_tax AS "er_MI1_TXT_v",
         CASE WHEN l_discount > 0.03 THEN l_discount END AS "er_MI1_ALL_d", l_quantity AS "qe_blur"
  FROM lineitem JOIN orders ON l_orderkey = o_orderkey)"""


def _session(t: Tables) -> DataFrame:
    """Order lines as per-image results with the prefixes of a session table."""
    j = t.lineitem.join(t.orders, F.col("l_orderkey") == F.col("o_orderkey"))
    return j.select(
        F.col("o_orderkey").alias("fi_key"), F.col("o_orderstatus").alias("ses_status"), (F.col("o_custkey") % 5).alias("fi_class"),
        F.col("l_extendedprice").alias("er_MI1_ALL_v"), F.col("l_tax").alias("er_MI1_TXT_v"),
        F.when(F.col("l_discount") > 0.03, F.col("l_discount")).alias("er_MI1_ALL_d"), F.col("l_quantity").alias("qe_blur"),
    )


@query("p5_columns_by_prefix", f'WITH {_SESSION_SQL} SELECT "er_MI1_ALL_v", "er_MI1_TXT_v", "er_MI1_ALL_d", fi_key, fi_class FROM session')
def p5(t: Tables) -> DataFrame:
    kept = frames.with_prefix(_session(t), ["er", "fi", "ses"])
    return frames.with_prefix(kept, ["ses"], keep=False)


@query("p6_difference_columns", f'WITH {_SESSION_SQL} SELECT fi_key, round("er_MI1_ALL_v" - "er_MI1_TXT_v", 6) AS "er_MI1_DIFF_v" FROM session')
def p6(t: Tables) -> DataFrame:
    """DIFF = ALL - TXT for every column pair that has both."""
    return frames.add_differences(_session(t)).select("fi_key", F.round("er_MI1_DIFF_v", 6).alias("er_MI1_DIFF_v"))


@query("p8_literal_tag", "SELECT r_regionkey, r_name, 'MSER' AS algorithm FROM region")
def p8(t: Tables) -> DataFrame:
    return t.region.withColumn("algorithm", F.lit("MSER"))


@query("p9_flatten_records", "SELECT c_custkey AS session_index, c_name AS file_info_name, c_acctbal AS file_info_balance_value FROM customer")
def p9(t: Tables) -> DataFrame:
    """Nested per-item records to section_key columns."""
    nested = t.customer.select(
        F.struct(F.col("c_custkey").alias("index")).alias("session"),
        F.struct(F.col("c_name").alias("name"), F.struct(F.col("c_acctbal").alias("value")).alias("balance")).alias("file_info"),
    )
    return frames.flatten(nested)


@query(
    "p10_impute_means",
    f"""WITH {_SESSION_SQL} SELECT fi_key, qe_blur, round(coalesce("er_MI1_ALL_d", (SELECT avg("er_MI1_ALL_d") FROM session)), 6) AS d FROM session""",
)
def p10(t: Tables) -> DataFrame:
    s = frames.impute_means(_session(t), ["er_MI1_ALL_d"])
    return s.select("fi_key", "qe_blur", F.round("er_MI1_ALL_d", 6).alias("d"))


@query(
    "p16_analysis_frame",
    f"""WITH {_SESSION_SQL}, ok AS (SELECT fi_class AS class, "er_MI1_ALL_d" AS d, "er_MI1_ALL_v" AS v FROM session WHERE ses_status = 'F')
    SELECT class, count(*) AS n, round(sum(coalesce(d, (SELECT avg(d) FROM ok))), 4) AS d, round(sum(v), 2) AS v FROM ok GROUP BY class""",
)
def p16(t: Tables) -> DataFrame:
    """Successful rows, empty columns off, renamed, cut to prefixes, imputed."""
    s = _session(t).withColumn("ses_status", F.when(F.col("ses_status") == "F", "success").otherwise("fail")).withColumn("er_none", F.lit(None).cast("double"))
    a = frames.analysis_frame(s, "ses_status", 1.0, {"fi_class": "er_class"}, ["er_"], "fi_key")
    return a.groupBy(F.col("er_class").cast("bigint").alias("class")).agg(F.count("*").alias("n"), F.round(F.sum("er_MI1_ALL_d"), 4).alias("d"), F.round(F.sum("er_MI1_ALL_v"), 2).alias("v"))


@query("p14_p17_column_subset", "SELECT o_custkey, count(*) AS n FROM orders GROUP BY o_custkey")
def p14(t: Tables) -> DataFrame:
    """A column subset; the first row's key value of a group is the grouping key itself."""
    return t.orders.select("o_custkey").groupBy("o_custkey").agg(F.count("*").alias("n"))


# filters


@query("f1_conjunction", "SELECT l_orderkey, l_linenumber FROM lineitem WHERE l_returnflag = 'R' AND l_linestatus = 'F' AND l_quantity = 10")
def f1(t: Tables) -> DataFrame:
    return t.lineitem.where((F.col("l_returnflag") == "R") & (F.col("l_linestatus") == "F") & (F.col("l_quantity") == 10)).select("l_orderkey", "l_linenumber")


@query("f2_in_and_not_in", "SELECT o_orderkey, o_orderpriority FROM orders WHERE o_orderpriority NOT IN ('1-URGENT', '2-HIGH') AND o_orderstatus IN ('F', 'O')")
def f2(t: Tables) -> DataFrame:
    return t.orders.where(~F.col("o_orderpriority").isin("1-URGENT", "2-HIGH") & F.col("o_orderstatus").isin("F", "O")).select("o_orderkey", "o_orderpriority")


@query("f3_j9_semi_join", "SELECT c_custkey, c_mktsegment FROM customer WHERE c_custkey IN (SELECT o_custkey FROM orders WHERE o_totalprice > 300000)")
def f3(t: Tables) -> DataFrame:
    big = t.orders.where("o_totalprice > 300000").select(F.col("o_custkey").alias("c_custkey"))
    return t.customer.join(big, "c_custkey", "left_semi").select("c_custkey", "c_mktsegment")


@query("j10_u4_anti_join", "SELECT c_custkey FROM customer WHERE c_custkey NOT IN (SELECT o_custkey FROM orders WHERE o_custkey IS NOT NULL)")
def j10(t: Tables) -> DataFrame:
    return t.customer.join(t.orders.select(F.col("o_custkey").alias("c_custkey")), "c_custkey", "left_anti").select("c_custkey")


@query("j10_label_negatives", "SELECT a.r_name AS label, b.r_name AS negative FROM region a JOIN region b ON a.r_name <> b.r_name")
def j10_labels(t: Tables) -> DataFrame:
    """Every label with the other labels: labels are few, rows are not touched."""
    a = t.region.select(F.col("r_name").alias("label"))
    return a.join(a.withColumnRenamed("label", "negative"), F.col("label") != F.col("negative"))


@query(
    "f4_a37_nulls",
    """SELECT k, ((a IS NULL)::INT + (b IS NULL)::INT)::INT AS nulls, a IS NOT NULL AND b IS NOT NULL AS complete FROM (
    SELECT p_partkey AS k, CASE WHEN p_size > 10 THEN p_size END AS a, CASE WHEN p_retailprice > 1200 THEN p_brand END AS b FROM part)""",
)
def f4(t: Tables) -> DataFrame:
    """Nulls per row and rows without any."""
    p = t.part.select(F.col("p_partkey").alias("k"), F.when(F.col("p_size") > 10, F.col("p_size")).alias("a"), F.when(F.col("p_retailprice") > 1200, F.col("p_brand")).alias("b"))
    n = frames.nulls_per_row(p)
    return p.select("k", n.alias("nulls"), (n == 0).alias("complete"))


@query("f5_ranges", "SELECT l_orderkey, l_linenumber, l_discount FROM lineitem WHERE l_discount >= 0.02 AND l_discount < 0.04 AND l_quantity <= 5")
def f5(t: Tables) -> DataFrame:
    return t.lineitem.where((F.col("l_discount") >= 0.02) & (F.col("l_discount") < 0.04) & (F.col("l_quantity") <= 5)).select("l_orderkey", "l_linenumber", "l_discount")


@query("f6_column_comparison", "SELECT s_suppkey FROM supplier JOIN nation ON s_nationkey = n_nationkey WHERE n_regionkey <> s_suppkey % 5")
def f6(t: Tables) -> DataFrame:
    return t.supplier.join(t.nation, F.col("s_nationkey") == F.col("n_nationkey")).where(F.col("n_regionkey") != F.col("s_suppkey") % 5).select("s_suppkey")


@query("f7_filter_on_aggregate", "SELECT o_orderkey FROM orders WHERE o_totalprice < (SELECT min(o_totalprice) * 2 FROM orders WHERE o_orderpriority = '1-URGENT')")
def f7(t: Tables) -> DataFrame:
    """Rows below the least of another set, which is one value."""
    least = t.orders.where("o_orderpriority = '1-URGENT'").agg((F.min("o_totalprice") * 2).alias("least"))
    return t.orders.crossJoin(F.broadcast(least)).where("o_totalprice < least").select("o_orderkey")


@query(
    "f8_having_against_maximum",
    "WITH c AS (SELECT o_custkey, count(*) AS n FROM orders GROUP BY o_custkey) SELECT o_custkey, n FROM c WHERE n > (SELECT max(n) // 2 FROM c)",
)
def f8(t: Tables) -> DataFrame:
    return statistics.frequent_values(t.orders, "o_custkey", 2)


@query("f9_catalogue_inclusive", "SELECT p_partkey FROM part WHERE p_size IN (1, 2, 3) AND p_brand IN ('Brand#11', 'Brand#12')")
def f9(t: Tables) -> DataFrame:
    return frames.catalogue_filter(t.part, {"p_size": [1, 2, 3], "p_brand": ["Brand#11", "Brand#12"], "p_type": []}).select("p_partkey")


@query("f9_catalogue_exclusive", "SELECT p_partkey FROM part WHERE p_size NOT IN (1, 2, 3) AND p_brand NOT IN ('Brand#11', 'Brand#12')")
def f9_not(t: Tables) -> DataFrame:
    return frames.catalogue_filter(t.part, {"p_size": [1, 2, 3], "p_brand": ["Brand#11", "Brand#12"]}, "exclusive").select("p_partkey")


@query(
    "f16_head_fraction",
    "SELECT s_suppkey FROM (SELECT s_suppkey, row_number() OVER (ORDER BY s_suppkey) AS n, count(*) OVER () AS c FROM supplier) WHERE n <= floor(c * 0.3)",
)
def f16(t: Tables) -> DataFrame:
    return frames.head_fraction(t.supplier, 0.3, "s_suppkey").select("s_suppkey")


# joins


@query("j7_cartesian_phones", "SELECT p_partkey, phone FROM part, (VALUES (1), (2), (3)) AS v(phone) WHERE p_brand IS NOT NULL")
def j7(t: Tables) -> DataFrame:
    """Candidates by the three phones: an explode, as one side is three literals."""
    from umbel.operators.matching import candidate_pairs

    return candidate_pairs(t.part.withColumn("package_candidate", F.col("p_brand"))).select("p_partkey", "phone")


@query("j11_j12_key_lookup", "SELECT o_custkey, list_sort(list(o_orderkey)) AS members, count(*) AS size FROM orders GROUP BY o_custkey")
def j12(t: Tables) -> DataFrame:
    """Rows of each key together, by key and never by position (also A39)."""
    return frames.group_members(t.orders, ["o_custkey"], "o_orderkey")


@query("j17_equi_join", "SELECT n_name, r_name FROM nation JOIN region ON n_regionkey = r_regionkey")
def j17(t: Tables) -> DataFrame:
    return t.nation.join(t.region, F.col("n_regionkey") == F.col("r_regionkey")).select("n_name", "r_name")


@query("j18_outer_join", "SELECT c_custkey, o_orderkey FROM customer LEFT JOIN orders ON o_custkey = c_custkey AND o_totalprice > 400000")
def j18(t: Tables) -> DataFrame:
    """Keys without partners stay, with nulls."""
    big = t.orders.where("o_totalprice > 400000").select(F.col("o_custkey").alias("c_custkey"), "o_orderkey")
    return t.customer.select("c_custkey").join(big, "c_custkey", "left")


# aggregates


@query("a1_count_by_group", "SELECT l_returnflag, l_linestatus, count(*) AS n FROM lineitem GROUP BY ALL")
def a1(t: Tables) -> DataFrame:
    return t.lineitem.groupBy("l_returnflag", "l_linestatus").agg(F.count("*").alias("n"))


@query("a2_value_counts", "SELECT p_brand, count(*) AS n FROM part WHERE p_brand IS NOT NULL GROUP BY p_brand")
def a2(t: Tables) -> DataFrame:
    return statistics.value_counts(t.part, ["p_brand"])


@query("a3_grouped_value_counts", "SELECT l_suppkey, l_returnflag, l_tax > 0.04 AS taxed, count(*) AS n FROM lineitem GROUP BY ALL")
def a3(t: Tables) -> DataFrame:
    return statistics.value_counts(t.lineitem.withColumn("taxed", F.col("l_tax") > 0.04), ["l_suppkey", "l_returnflag", "taxed"])


_STATS = ("l_quantity", "l_extendedprice", "l_discount")


@query(
    "a4_statistics_by_group",
    "SELECT l_returnflag, "
    + ", ".join(f"round({f}({c}), 4) AS {c}_{n}" for c in _STATS for n, f in (("mean", "avg"), ("median", "median"), ("std", "stddev_samp"), ("var", "var_samp"), ("sum", "sum"), ("min", "min")))
    + " FROM lineitem GROUP BY l_returnflag",
)
def a4(t: Tables) -> DataFrame:
    """All statistics of all given numeric columns in one pass."""
    d = statistics.describe_groups(t.lineitem, ["l_returnflag"], ["mean", "median", "std", "var", "sum", "min"], list(_STATS))
    return d.select("l_returnflag", *[F.round(c, 4).alias(c) for c in d.columns[1:]])


@query("a5_count_distinct", "SELECT count(DISTINCT l_partkey) AS parts, count(DISTINCT l_suppkey) AS suppliers FROM lineitem")
def a5(t: Tables) -> DataFrame:
    return t.lineitem.agg(F.count_distinct("l_partkey").alias("parts"), F.count_distinct("l_suppkey").alias("suppliers"))


@query("a6_mean_distinct_truncated", "SELECT trunc(avg(n))::INT AS list_size FROM (SELECT l_orderkey, count(DISTINCT l_suppkey) AS n FROM lineitem GROUP BY l_orderkey)")
def a6(t: Tables) -> DataFrame:
    per = t.lineitem.groupBy("l_orderkey").agg(F.count_distinct("l_suppkey").alias("n"))
    return per.agg(truncated_mean(F.col("n")).alias("list_size"))


@query("a7_distinct", "SELECT DISTINCT p_type FROM part")
def a7(t: Tables) -> DataFrame:
    return t.part.select("p_type").distinct()


@query("a8_distinct_composite", "SELECT count(*) AS n FROM (SELECT DISTINCT l_partkey, l_suppkey, l_returnflag FROM lineitem)")
def a8(t: Tables) -> DataFrame:
    return t.lineitem.select("l_partkey", "l_suppkey", "l_returnflag").distinct().agg(F.count("*").alias("n"))


_FLAGS = ["A", "N", "R"]


@query("a11_pivot_size", "SELECT l_suppkey, " + ", ".join(f"""count(*) FILTER (WHERE l_returnflag = '{f}') AS "{f}\"""" for f in _FLAGS) + " FROM lineitem GROUP BY l_suppkey")
def a11(t: Tables) -> DataFrame:
    """Counts of explicit values, absent cells 0."""
    return statistics.pivot_count(t.lineitem, ["l_suppkey"], "l_returnflag", _FLAGS)


@query("a12_pivot_match_counts", "SELECT l_orderkey, count(*) FILTER (WHERE l_tax > 0.04) AS yes, count(*) FILTER (WHERE NOT l_tax > 0.04) AS no FROM lineitem GROUP BY l_orderkey")
def a12(t: Tables) -> DataFrame:
    taxed = F.col("l_tax") > 0.04
    return t.lineitem.groupBy("l_orderkey").agg(F.count_if(taxed).alias("yes"), F.count_if(~taxed).alias("no"))


@query("a13_pivot_mean", "SELECT l_suppkey, " + ", ".join(f"""round(avg(l_quantity) FILTER (WHERE l_returnflag = '{f}'), 9) AS "{f}\"""" for f in _FLAGS) + " FROM lineitem GROUP BY l_suppkey")
def a13(t: Tables) -> DataFrame:
    p = t.lineitem.groupBy("l_suppkey").pivot("l_returnflag", _FLAGS).agg(F.avg("l_quantity"))
    return p.select("l_suppkey", *[F.round(f, 9).alias(f) for f in _FLAGS])


@query("a14_x1_pivot_lists", "SELECT l_orderkey, l_returnflag, list_sort(list(l_quantity)) AS quantities FROM lineitem GROUP BY ALL")
def a14(t: Tables) -> DataFrame:
    return t.lineitem.groupBy("l_orderkey", "l_returnflag").agg(F.sort_array(F.collect_list("l_quantity")).alias("quantities"))


@query(
    "a15_a16_pivot_mixed",
    "SELECT l_partkey, l_linestatus, min(l_extendedprice) AS low, round(avg(l_extendedprice), 8) AS mean, round(sum(l_extendedprice), 2) AS total, count(*) AS n FROM lineitem GROUP BY ALL",
)
def a15(t: Tables) -> DataFrame:
    x = "l_extendedprice"
    return t.lineitem.groupBy("l_partkey", "l_linestatus").agg(F.min(x).alias("low"), F.round(F.avg(x), 8).alias("mean"), F.round(F.sum(x), 2).alias("total"), F.count("*").alias("n"))


@query(
    "a18_x2_mode",
    """SELECT l_suppkey, l_returnflag, n FROM (SELECT *, row_number() OVER (PARTITION BY l_suppkey ORDER BY n DESC, l_returnflag IS NULL, l_returnflag) AS r
    FROM (SELECT l_suppkey, l_returnflag, count(*) AS n FROM lineitem GROUP BY ALL)) WHERE r = 1""",
)
def a18(t: Tables) -> DataFrame:
    return retrieval.mode(t.lineitem, ["l_suppkey"], "l_returnflag")


@query(
    "a19_argmax_row",
    """SELECT o_custkey, o_orderkey, o_totalprice FROM (SELECT *, row_number() OVER (PARTITION BY o_custkey ORDER BY o_totalprice DESC NULLS LAST, o_orderkey) AS r FROM orders) WHERE r = 1""",
)
def a19(t: Tables) -> DataFrame:
    return retrieval.best_row(t.orders, ["o_custkey"], "o_totalprice", ["o_orderkey"]).select("o_custkey", "o_orderkey", "o_totalprice")


@query(
    "a26_label_counts_total",
    "SELECT c_mktsegment AS label, count(*) AS n FROM customer GROUP BY c_mktsegment UNION ALL SELECT 'Total', count(*) FROM customer",
)
def a26(t: Tables) -> DataFrame:
    """Rows of each label and of all."""
    from umbel.operators.regions import label_counts

    return label_counts(t.customer.withColumn("k", F.lit(0)), ["k"], "c_mktsegment").select("label", "n")


_PRIORITIES = ["1-URGENT", "2-HIGH", "3-MEDIUM", "4-NOT SPECIFIED", "5-LOW"]


@query(
    "a27_crosstab",
    "SELECT o_orderstatus, " + ", ".join(f"""count(*) FILTER (WHERE o_orderpriority = '{p}') AS "{p}\"""" for p in _PRIORITIES) + " FROM orders GROUP BY o_orderstatus",
)
def a27(t: Tables) -> DataFrame:
    return statistics.crosstab(t.orders, "o_orderstatus", "o_orderpriority", _PRIORITIES)


@query(
    "a28_class_outcomes",
    "SELECT l_linenumber % 3 AS pred, count(*) FILTER (WHERE l_suppkey % 3 = l_linenumber % 3) AS correct, count(*) FILTER (WHERE l_suppkey % 3 <> l_linenumber % 3) AS wrong FROM lineitem GROUP BY 1",
)
def a28(t: Tables) -> DataFrame:
    d = t.lineitem.select((F.col("l_suppkey") % 3).alias("actual"), (F.col("l_linenumber") % 3).alias("pred"))
    return statistics.class_outcomes(d, "actual", "pred")


@query(
    "a29_histogram",
    """SELECT bin, 0.0 + bin * 5.0 AS low, 0.0 + (bin + 1) * 5.0 AS high, count(*) AS n FROM (
    SELECT least(floor((l_quantity - 0.0) / 5.0), 9)::INT AS bin FROM lineitem WHERE l_quantity >= 0 AND l_quantity <= 50) GROUP BY bin""".replace("0.0 + bin * 5.0", "(0.0 + bin * 5.0)::DOUBLE").replace("0.0 + (bin + 1) * 5.0", "(0.0 + (bin + 1) * 5.0)::DOUBLE"),
)
def a29(t: Tables) -> DataFrame:
    return retrieval.histogram(t.lineitem, "l_quantity", 0.0, 5.0, 10)


@query(
    "a31_vote_lists",
    """WITH g AS (SELECT l_orderkey, l_suppkey, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_extendedprice DESC, l_linenumber) AS r FROM lineitem)
    SELECT l_orderkey, l_suppkey, list_sort(list(r::INT)) AS ranks, count(*) AS votes FROM g GROUP BY ALL""",
)
def a31(t: Tables) -> DataFrame:
    """Ranks that each guess got, and their number."""
    order = Window.partitionBy("l_orderkey").orderBy(F.desc("l_extendedprice"), "l_linenumber")
    g = t.lineitem.select("l_orderkey", "l_suppkey", F.row_number().over(order).alias("r"))
    return g.groupBy("l_orderkey", "l_suppkey").agg(F.sort_array(F.collect_list("r")).alias("ranks"), F.count("*").alias("votes"))


@query("a34_a38_averages", "SELECT round(avg(n), 6) AS mean_lines, round(avg(total), 4) AS mean_total FROM (SELECT l_orderkey, count(*) AS n, sum(l_extendedprice) AS total FROM lineitem GROUP BY l_orderkey)")
def a34(t: Tables) -> DataFrame:
    """Mean of list lengths and of batch totals."""
    per = t.lineitem.groupBy("l_orderkey").agg(F.count("*").alias("n"), F.sum("l_extendedprice").alias("total"))
    return per.agg(F.round(F.avg("n"), 6).alias("mean_lines"), F.round(F.avg("total"), 4).alias("mean_total"))


@query(
    "a35_clipped_means",
    """SELECT c_mktsegment, round(avg(m), 6) AS mean, round(avg(d), 6) AS median FROM (
    SELECT c_mktsegment, c_nationkey, avg(greatest(c_acctbal, 0)) AS m, median(greatest(c_acctbal, 0)) AS d FROM customer GROUP BY ALL) GROUP BY c_mktsegment""",
)
def a35(t: Tables) -> DataFrame:
    """Values cut at 0, statistics per sample, then their mean."""
    v = F.greatest("c_acctbal", F.lit(0.0))
    per = t.customer.groupBy("c_mktsegment", "c_nationkey").agg(F.avg(v).alias("m"), F.median(v).alias("d"))
    return per.groupBy("c_mktsegment").agg(F.round(F.avg("m"), 6).alias("mean"), F.round(F.avg("d"), 6).alias("median"))


@query("a36_row_any_all", "SELECT l_orderkey, l_linenumber, (l_tax > 0.06 OR l_discount > 0.06) AS some, (l_tax > 0.06 AND l_discount > 0.06) AS every FROM lineitem")
def a36(t: Tables) -> DataFrame:
    flags = F.array(F.col("l_tax") > 0.06, F.col("l_discount") > 0.06)
    return t.lineitem.select("l_orderkey", "l_linenumber", F.exists(flags, lambda x: x).alias("some"), F.forall(flags, lambda x: x).alias("every"))


@query(
    "a43_c25_stacked_scores",
    """WITH k AS (SELECT l_suppkey, l_linenumber, l_discount FROM lineitem WHERE l_discount <= 0.02),
    r AS (SELECT *, row_number() OVER (PARTITION BY l_suppkey, l_linenumber ORDER BY l_discount DESC) - 1 AS place FROM k),
    w AS (SELECT l_suppkey, max(place) AS longest FROM r GROUP BY l_suppkey),
    g AS (SELECT DISTINCT l_suppkey, l_linenumber FROM k)
    SELECT g.l_suppkey, g.l_linenumber, p.place::INT AS place, coalesce(r.l_discount, 0.0) AS l_discount
    FROM g JOIN w USING (l_suppkey), unnest(range(0, w.longest + 1)) AS p(place) LEFT JOIN r ON r.l_suppkey = g.l_suppkey AND r.l_linenumber = g.l_linenumber AND r.place = p.place""",
)
def a43(t: Tables) -> DataFrame:
    """Low scores per key and prediction, highest first, padded to one length."""
    return statistics.stacked_scores(t.lineitem, ["l_suppkey"], "l_linenumber", "l_discount", 0.02)


# windows, sorts, samples


@query("w4_head_per_group", "SELECT o_custkey, o_orderkey FROM (SELECT *, row_number() OVER (PARTITION BY o_custkey ORDER BY o_totalprice, o_orderkey) AS r FROM orders) WHERE r <= 3")
def w4(t: Tables) -> DataFrame:
    return retrieval.head(t.orders, ["o_custkey"], 3, ["o_totalprice", "o_orderkey"]).select("o_custkey", "o_orderkey")


@query("w9_numbering", "SELECT l_orderkey, l_partkey, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_partkey, l_linenumber)::INT AS n FROM lineitem")
def w9(t: Tables) -> DataFrame:
    return t.lineitem.select("l_orderkey", "l_partkey", F.row_number().over(Window.partitionBy("l_orderkey").orderBy("l_partkey", "l_linenumber")).alias("n"))


@query(
    "w10_two_smallest",
    """SELECT l_orderkey, max(CASE WHEN r = 1 THEN l_extendedprice END) AS d1, max(CASE WHEN r = 2 THEN l_extendedprice END) AS d2 FROM (
    SELECT *, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_extendedprice, l_linenumber) AS r FROM lineitem) WHERE r <= 2 GROUP BY l_orderkey""",
)
def w10(t: Tables) -> DataFrame:
    two = retrieval.head(t.lineitem, ["l_orderkey"], 2, ["l_extendedprice", "l_linenumber"])
    s = two.groupBy("l_orderkey").agg(F.sort_array(F.collect_list("l_extendedprice")).alias("d"))
    return s.select("l_orderkey", F.get("d", 0).alias("d1"), F.get("d", 1).alias("d2"))


@query("o1_o4_sorts", "SELECT p_brand, count(*) AS n FROM part GROUP BY p_brand ORDER BY n DESC, p_brand")
def o1(t: Tables) -> DataFrame:
    return t.part.groupBy("p_brand").agg(F.count("*").alias("n")).orderBy(F.desc("n"), "p_brand")


@query(
    "o2_stable_multi_pass_sort",
    "SELECT s_suppkey, row_number() OVER (PARTITION BY s_nationkey ORDER BY s_acctbal > 0, s_suppkey)::INT AS place FROM supplier",
)
def o2(t: Tables) -> DataFrame:
    """The last of several sort keys is the primary one."""
    s = t.supplier.withColumn("positive", F.col("s_acctbal") > 0)
    order = frames.catalogue_order(["positive", "s_nationkey"], [F.col("s_suppkey")])
    return s.select("s_suppkey", F.row_number().over(Window.partitionBy("s_nationkey").orderBy(*order)).alias("place"))


_SQL_SEEDED = "('0x' || left(md5(concat_ws(':', '{seed}', {key})), 15))::BIGINT"


@query(
    "o7_o9_o10_hash_splits",
    f"""SELECT o_orderkey, CASE WHEN u < 800000 THEN 0 WHEN u < 900000 THEN 1 ELSE 2 END AS part
    FROM (SELECT o_orderkey, {_SQL_SEEDED.format(seed=42, key="o_orderkey")} % 1000000 AS u FROM orders)""",
)
def o9(t: Tables) -> DataFrame:
    """Seeded shares of 80, 10 and 10 %: rows keep their part on reruns."""
    part = frames.hash_split(F.col("o_orderkey"), [0.8, 0.1, 0.1])
    return t.orders.select("o_orderkey", part.alias("part"))


@query("o8_seeded_shuffle", f"SELECT s_suppkey, row_number() OVER (ORDER BY {_SQL_SEEDED.format(seed=666, key='s_suppkey')}) AS place FROM supplier")
def o8(t: Tables) -> DataFrame:
    """Places of all rows in a seeded random order."""
    keyed = t.supplier.select("s_suppkey", frames.shuffle_order(F.col("s_suppkey")).alias("h"))
    return prefix.row_numbers(keyed, "h", "place").select("s_suppkey", "place")


@query("o3_regions_by_area", "SELECT vec_id, row_number() OVER (PARTITION BY label ORDER BY list_sum(embedding::DOUBLE[]) DESC, vec_id) AS place FROM embeddings")
def o3(t: Tables) -> DataFrame:
    """Rows of each label from the largest sum down, as regions are sorted by their areas."""
    total = F.aggregate(F.col("embedding").cast("array<double>"), F.lit(0.0), lambda s, x: s + x)
    e = t.embeddings.select("vec_id", "label", total.alias("area"))
    return e.select("vec_id", F.row_number().over(Window.partitionBy("label").orderBy(F.desc("area"), "vec_id")).alias("place"))


@query("o11_v26_chunks", "SELECT o_orderkey, ((row_number() OVER (ORDER BY o_orderkey) - 1) // 5000)::BIGINT AS chunk FROM orders")
def o11(t: Tables) -> DataFrame:
    """Runs of 5000 rows."""
    return frames.chunks(t.orders.select("o_orderkey"), "o_orderkey", 5000)


@query("o6_o13_top_k", "SELECT o_orderkey, o_totalprice FROM orders ORDER BY o_totalprice DESC, o_orderkey LIMIT 100")
def o13(t: Tables) -> DataFrame:
    """The hundred largest orders: a bounded heap a task, no global sort."""
    return t.orders.select("o_orderkey", "o_totalprice").orderBy(F.desc("o_totalprice"), "o_orderkey").limit(100)


@query(
    "o14_first_unique",
    "SELECT o_custkey FROM (SELECT o_custkey, min(o_orderkey) AS f FROM orders GROUP BY o_custkey) ORDER BY f LIMIT 20",
)
def o14(t: Tables) -> DataFrame:
    """The first twenty different customers in order of appearance."""
    return t.orders.groupBy("o_custkey").agg(F.min("o_orderkey").alias("first")).orderBy("first").limit(20).select("o_custkey")


@query(
    "o15_frequent_above_mean",
    "WITH c AS (SELECT p_size, count(*) AS n FROM part GROUP BY p_size) SELECT p_size, n FROM c WHERE n > (SELECT avg(n) FROM c) ORDER BY n, p_size LIMIT 5",
)
def o15(t: Tables) -> DataFrame:
    return statistics.top_above_mean(t.part, "p_size", 5)


# sets


@query("u1_union_all", "SELECT c_custkey AS k FROM customer UNION ALL SELECT s_suppkey FROM supplier")
def u1(t: Tables) -> DataFrame:
    return frames.union_all([t.customer.select(F.col("c_custkey").alias("k")), t.supplier.select(F.col("s_suppkey").alias("k"))])


@query("u2_union_missing", "SELECT c_custkey AS k, c_mktsegment AS seg, NULL::VARCHAR AS name FROM customer UNION ALL SELECT s_suppkey, NULL, s_name FROM supplier")
def u2(t: Tables) -> DataFrame:
    return frames.union_all([t.customer.select(F.col("c_custkey").alias("k"), F.col("c_mktsegment").alias("seg")), t.supplier.select(F.col("s_suppkey").alias("k"), F.col("s_name").alias("name"))], True)


@query("u3_flatten_lists", "SELECT o_custkey, unnest(m) AS o_orderkey FROM (SELECT o_custkey, list(o_orderkey) AS m FROM orders GROUP BY o_custkey)")
def u3(t: Tables) -> DataFrame:
    return frames.group_members(t.orders, ["o_custkey"], "o_orderkey").select("o_custkey", F.explode("members").alias("o_orderkey"))


@query("u4_set_difference", "SELECT n_nationkey AS k FROM nation EXCEPT SELECT s_nationkey FROM supplier WHERE s_acctbal > 9000")
def u4(t: Tables) -> DataFrame:
    return t.nation.select(F.col("n_nationkey").alias("k")).exceptAll(t.supplier.where("s_acctbal > 9000").select(F.col("s_nationkey").alias("k")).distinct()).distinct()


# scalars


@query("c11_c12_c14_arithmetic", "SELECT l_orderkey, l_linenumber, round(1 - l_discount, 6) AS keep, floor(l_extendedprice / 7)::BIGINT AS f, CAST(l_quantity AS BIGINT) // 7 AS d, CAST(l_quantity AS BIGINT) % 7 AS m, round(sqrt(l_quantity), 6) AS r, round(log2(l_quantity), 6) AS lg, round(sin(l_tax) + cos(l_tax), 6) AS sc, abs(l_tax - l_discount) AS ab FROM lineitem")
def c11(t: Tables) -> DataFrame:
    q, e = F.col("l_quantity"), F.expr
    return t.lineitem.select(
        "l_orderkey", "l_linenumber", F.round(1 - F.col("l_discount"), 6).alias("keep"), F.floor(F.col("l_extendedprice") / 7).alias("f"), e("CAST(l_quantity AS BIGINT) DIV 7").alias("d"),
        (q.cast("bigint") % 7).alias("m"), F.round(F.sqrt(q), 6).alias("r"), F.round(F.log2(q), 6).alias("lg"), F.round(F.sin("l_tax") + F.cos("l_tax"), 6).alias("sc"),
        F.abs(F.col("l_tax") - F.col("l_discount")).alias("ab"),
    )


@query(
    "c13_c15_c16_ratio_and_rounding",
    "SELECT p_partkey, round_even(p_retailprice / 8, 3) AS even, greatest(p_size - 25, 0) AS clipped, CASE WHEN p_size % 5 <> 0 THEN (p_size / (p_size % 5))::DOUBLE ELSE 1.0::DOUBLE END AS ratio FROM part",
)
def c13(t: Tables) -> DataFrame:
    from umbel.functions.metrics import ratio

    return t.part.select("p_partkey", F.bround(F.col("p_retailprice") / 8, 3).alias("even"), F.greatest(F.col("p_size") - 25, F.lit(0)).alias("clipped"), ratio(F.col("p_size"), F.col("p_size") % 5).alias("ratio"))


@query("p7_c10_ratios_and_casts", "SELECT p_partkey, TRY_CAST(substr(p_brand, 7) AS INT) AS brand, TRY_CAST(p_type AS INT) AS none, p_retailprice / nullif(p_size % 4, 0) AS ratio FROM part")
def p7(t: Tables) -> DataFrame:
    """Casts that give null instead of failing, ratios that give null for zero."""
    return t.part.select("p_partkey", F.substr("p_brand", F.lit(7)).try_cast("int").alias("brand"), F.col("p_type").try_cast("int").alias("none"), F.try_divide(F.col("p_retailprice"), F.col("p_size") % 4).alias("ratio"))


@query(
    "c24_map_lookup",
    "SELECT o_orderkey, CASE o_orderstatus WHEN 'F' THEN 'done' WHEN 'O' THEN 'open' END AS state FROM orders",
)
def c24(t: Tables) -> DataFrame:
    states = F.create_map(F.lit("F"), F.lit("done"), F.lit("O"), F.lit("open"))
    return t.orders.select("o_orderkey", F.element_at(states, F.col("o_orderstatus")).alias("state"))


@query("c21_array_text", "SELECT p_partkey, [p_size * 1.0::DOUBLE, 2.5::DOUBLE] AS cell FROM part")
def c21(t: Tables) -> DataFrame:
    """A printed array, as ``[ 7.  2.5]``, read as numbers without evaluating it."""
    text = F.concat(F.lit("[ "), F.col("p_size").cast("string"), F.lit(".   2.5]"))
    clean = F.regexp_replace(F.regexp_replace(F.btrim(F.regexp_replace(text, r"[\[\]]", "")), r"\s+", ","), r"\.(,|$)", ".0$1")
    return t.part.select("p_partkey", F.from_json(F.concat(F.lit("["), clean, F.lit("]")), "array<double>").alias("cell"))
