"""Sources, sinks, file names and descriptor keys."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from umbel.functions import keys
from umbel.operators import frames
from umbel.plans.fixtures import SQL_DESCRIPTORS, descriptors
from umbel.plans.registry import Tables, query
from umbel.sources import catalog, tables, xvecs
from umbel.sources.store import DescriptorStore


@query("s1_k1_csv_round_trip", "SELECT c_custkey, c_name, CASE WHEN c_acctbal >= 0 THEN c_acctbal END AS c_acctbal FROM customer")
def s1(t: Tables) -> DataFrame:
    """A result table written as CSV and read by its schema; NaN is null."""
    path = t.scratch("csv")
    tables.write_csv(t.customer.select("c_custkey", "c_name", F.when(F.col("c_acctbal") >= 0, F.col("c_acctbal")).otherwise(F.lit(float("nan"))).alias("c_acctbal")), path)
    return tables.read_csv(t.spark, path, "c_custkey bigint, c_name string, c_acctbal double")


@query("s2_file_scan", "SELECT unnest(['benchmark', 'conversations', 'customer', 'documents', 'embeddings', 'events', 'labels', 'lineitem', 'nation', 'orders', 'pages', 'part', 'region', 'supplier']) AS name")
def s2(t: Tables) -> DataFrame:
    """Names of the Parquet tables below the folder, files or folders of parts; contents are not read."""
    return catalog.table_names(t.spark, t.folder)


@query("s3_debug_list", "SELECT 'PFP_Ph1_P0608_D01_S001_C2_az180_side1' AS filename, 608 AS packageclass, 1 AS phone, 1 AS distinct_, 1 AS sample, 2 AS size, 180 AS angle, 1 AS side")
def s3(t: Tables) -> DataFrame:
    return catalog.load(t.spark, "", debug=True).drop("path").withColumnRenamed("distinct", "distinct_")


@query(
    "s5_a40_annotation_statistics",
    """SELECT printf('%04d_D01', p_partkey % 10000) AS filename, 'regular' AS kind, 'Text' AS label, (p_size + 2)::DOUBLE AS height, (p_size * 2)::DOUBLE AS width,
    ((p_size + 2) * (p_size * 2))::DOUBLE AS area, round((p_size * 2) / (p_size + 2), 6) AS ratio FROM part""",
)
def s5(t: Tables) -> DataFrame:
    """Annotation XML, one document a part, parsed into boxes; boxes of unknown types are left out."""
    path = t.scratch("xml")
    n = F.col("p_size").cast("string")
    box = F.concat(F.lit("<bndbox><xmin>1</xmin><ymin>1</ymin><xmax>"), (F.col("p_size") * 2 + 1).cast("string"), F.lit("</xmax><ymax>"), (F.col("p_size") + 3).cast("string"), F.lit("</ymax></bndbox>"))
    known = F.concat(F.lit("<object><name>Text</name><type>bndbox</type>"), box, F.lit("</object>"))
    other = F.lit("<object><name>Odd</name><type>circle</type></object>")
    name = F.concat(keys.zfill(F.col("p_partkey") % 10000), F.lit("_D01"))
    size = F.concat(F.lit("<size><width>"), n, F.lit("</width><height>9</height><depth>3</depth></size>"))
    one = F.concat(F.lit("<annotation><filename>"), name, F.lit("</filename>"), size, known, other, F.lit("</annotation>"))
    files = t.part.groupBy(F.expr("p_partkey DIV 500").alias("file")).agg(F.concat(F.lit("<annotations>"), F.concat_ws("", F.collect_list(one)), F.lit("</annotations>")).alias("value"))
    files.write.partitionBy("file").text(path)
    from umbel.operators.regions import box_statistics

    return box_statistics(catalog.read_annotations(t.spark, path)).withColumn("ratio", F.round("ratio", 6))


def _store(t: Tables) -> DescriptorStore:
    store = DescriptorStore(t.spark, t.scratch("store"))
    d = descriptors(t)
    rows = d.select(F.lit("resnet18").alias("model"), F.lit(64).alias("length"), F.when(F.col("vec_id") % 2 == 0, "MSER").otherwise("MI1").alias("algorithm"), "filename", F.col("vec_id").cast("int").alias("region"), F.col("vector").cast("array<float>").alias("vector"))
    store.insert(rows)
    # a second write of the same keys changes nothing
    store.insert(rows.withColumn("vector", F.reverse("vector")))
    return store


@query(
    "s6_k3_f10_prefix_scan",
    f"WITH {SQL_DESCRIPTORS} SELECT filename, vec_id::INT AS region, round(vector[1], 5) AS first, angle = 360 AS is_index FROM d WHERE vec_id % 2 = 0",
)
def s6(t: Tables) -> DataFrame:
    """Keyed store: first write wins, one prefix is one folder, keys at angle 360 are the index."""
    store = _store(t)
    rows = store.with_keys(store.scan("resnet18", 64, "MSER"))
    return rows.select("filename", "region", F.round(F.get("vector", 0).cast("double"), 5).alias("first"), "is_index")


@query("s7_key_pattern", f"WITH {SQL_DESCRIPTORS} SELECT filename, vec_id::INT AS region FROM d WHERE 'resnet18+64+' || CASE WHEN vec_id % 2 = 0 THEN 'MSER' ELSE 'MI1' END || '+' || filename LIKE '%MI1+PFP_Ph2%'")
def s7(t: Tables) -> DataFrame:
    return _store(t).like("%MI1+PFP_Ph2%").select("filename", "region")


@query("s8_point_get", f"WITH {SQL_DESCRIPTORS} SELECT filename, vec_id::INT AS region FROM d WHERE vec_id = 41")
def s8(t: Tables) -> DataFrame:
    name = descriptors(t).where("vec_id = 41").select("filename").first()
    return _store(t).get(name[0] if name else "", 41).select("filename", "region")


@query(
    "s9_last_file_wins",
    "SELECT o_custkey, 'run' || o_orderdate::DATE::VARCHAR || '_' || o_orderkey AS file FROM (SELECT *, row_number() OVER (PARTITION BY o_custkey ORDER BY 'run' || o_orderdate::DATE::VARCHAR || '_' || o_orderkey DESC) AS r FROM orders) WHERE r = 1",
)
def s9(t: Tables) -> DataFrame:
    file = F.concat(F.lit("run"), F.to_date("o_orderdate").cast("string"), F.lit("_"), F.col("o_orderkey").cast("string"))
    return frames.last_file_wins(t.orders.select("o_custkey", file.alias("file")), ["o_custkey"], "file")


@query(
    "s10_j8_pattern_join",
    f"""WITH {SQL_DESCRIPTORS}, ann AS (SELECT package[1:8] AS k, min('ann_' || package || '_' || vec_id) AS annotation FROM d WHERE angle = 360 GROUP BY 1)
    SELECT vec_id, filename, annotation FROM d LEFT JOIN ann ON ann.k = d.package[1:8]""",
)
def s10(t: Tables) -> DataFrame:
    """Files with the first annotation that shares package and distinct number: an equi-join on what the names have in common."""
    d = catalog.parse(descriptors(t).withColumn("path", F.concat("filename", F.lit(".png"))).drop("sample", "phone", "angle"))
    d = d.withColumn("k", keys.annotation_key(F.col("packageclass"), F.col("distinct")))
    ann = d.where("angle = 360").select("k", F.concat(F.lit("ann_"), F.col("package"), F.lit("_"), F.col("vec_id").cast("string")).alias("annotation"))
    return catalog.first_match(d.select("k", "vec_id", "filename"), ann, ["k"], "annotation").select("vec_id", "filename", "annotation")


@query(
    "s11_result_sets",
    """SELECT p_partkey AS id, 'out/' || p_partkey || '_REF.png' AS reference, a AS algorithm, 'out/' || p_partkey || '_' || a || '.png' AS mask FROM part, (VALUES ('MI1'), ('MSER')) AS v(a)""",
)
def s11(t: Tables) -> DataFrame:
    """Stored results: the reference by its name, one mask per algorithm."""
    n = F.col("p_partkey").cast("string")
    files = t.part.select(F.col("p_partkey").alias("id"), F.explode(F.array(*[F.concat(F.lit("out/"), n, F.lit(f"_{x}.png")) for x in ("REF", "MI1", "MSER")])).alias("path"))
    return catalog.result_sets(files.withColumn("filename", keys.stem(F.col("path"))), ["MI1", "MSER"])


@query("s13_k13_xvecs_round_trip", "SELECT (row_number() OVER (ORDER BY vec_id) - 1)::BIGINT AS n, round(list_sum(embedding::DOUBLE[]), 4) AS total FROM embeddings")
def s13(t: Tables) -> DataFrame:
    """Vectors to files of the packed format and back."""
    from pyspark.sql import Window

    path = t.scratch("xvecs")
    xvecs.write(t.embeddings, path, "vec_id", "embedding")
    back = xvecs.read(t.spark, path)
    sizes = back.groupBy("path").agg(F.count("*").alias("size"))
    starts = sizes.select("path", (F.sum("size").over(Window.orderBy("path")) - F.col("size")).alias("start"))  # one row a file
    total = F.aggregate("vector", F.lit(0.0), lambda s, x: s + x)
    return back.join(starts, "path").select((F.col("start") + F.col("n")).alias("n"), F.round(total, 4).alias("total"))


@query("k2_p9_session_append", "SELECT s_suppkey AS session_index, CASE WHEN s_acctbal > 0 THEN 'success' ELSE 'fail' END AS session_status, s_name AS file_info_name FROM supplier")
def k2(t: Tables) -> DataFrame:
    """Results appended in two chunks, flattened, without rewriting what is stored."""
    s = tables.Session(t.spark, t.scratch("session"))
    rows = t.supplier.select(
        F.struct(F.col("s_suppkey").alias("index"), F.when(F.col("s_acctbal") > 0, "success").otherwise("fail").alias("status")).alias("session"), F.struct(F.col("s_name").alias("name")).alias("file_info")
    )
    for part in (0, 1):
        s.add(rows.where(F.col("session.index") % 2 == part))
    return s.read()


@query("k17_failed_items", "SELECT s_name AS file_info_name FROM supplier WHERE NOT s_acctbal > 0")
def k17(t: Tables) -> DataFrame:
    s = tables.Session(t.spark, t.scratch("session"))
    s.add(t.supplier.select(F.struct(F.when(F.col("s_acctbal") > 0, "success").otherwise("fail").alias("status")).alias("session"), F.struct(F.col("s_name").alias("name")).alias("file_info")))
    return s.failed("file_info_name")


@query(
    "c3_c4_c26_parse_enrollment",
    f"WITH {SQL_DESCRIPTORS} SELECT vec_id, label::INT AS packageclass, phone::INT AS phone, (1 + label % 3)::INT AS distinct_, (1 + label % 5)::INT AS sample, 2 AS size, angle::INT AS angle, 1 AS side FROM d",
)
def c3(t: Tables) -> DataFrame:
    """Attributes of enrollment file names."""
    d = descriptors(t)
    a = keys.attributes(F.col("filename"))
    return d.select("vec_id", *[c.alias("distinct_" if k == "distinct" else k) for k, c in a.items()])


@query(
    "c3_c26_parse_recognition",
    "SELECT p_partkey, (p_partkey % 10000)::INT AS packageclass, (1 + p_size % 3)::INT AS phone, 1 AS distinct_, (p_size)::INT AS sample, 2 AS size, (1 + p_size % 3)::INT AS \"RS\" FROM part",
)
def c26(t: Tables) -> DataFrame:
    """Attributes of recognition file names: the database's number is the first S and digit."""
    p = F.format_string("Package_R_I_S%d_Ph%d_P%04d_D01_S%03d_C2_S1", 1 + F.col("p_size") % 3, 1 + F.col("p_size") % 3, (F.col("p_partkey") % 10000).cast("int"), F.col("p_size"))
    a = keys.attributes(p, "recognition")
    return t.part.select("p_partkey", *[c.alias("distinct_" if k == "distinct" else k) for k, c in a.items()])


@query(
    "c1_c2_c6_key_slices",
    f"""WITH {SQL_DESCRIPTORS} SELECT vec_id, sample, package, vec_id::INT AS descriptor, package[1:4]::INT AS id, sample[3:3]::INT AS phone, package[1:-6] AS front FROM d""".replace("package[1:-6]", "left(package, length(package) - 5)"),
)
def c1(t: Tables) -> DataFrame:
    """Slices of descriptor keys, by position and by separators."""
    d = descriptors(t).withColumn("k", keys.key(F.lit("resnet18"), F.lit(64), F.lit("MSER"), F.col("filename"), F.col("vec_id")))
    parts = keys.key_parts(F.col("k"))
    name = parts["filename"]
    package = F.substring(name, 10, 13)
    return d.select(
        "vec_id", F.regexp_replace(F.substr(name, F.lit(5)), "_side.*$", "").alias("sample"), package.alias("package"), parts["region"].alias("descriptor"),
        F.substring(package, 1, 4).cast("int").alias("id"), F.substring(name, 7, 1).cast("int").alias("phone"), F.substr(package, F.lit(1), F.length(package) - 5).alias("front"),
    )


@query(
    "c5_c7_c22_compose_keys",
    f"""WITH {SQL_DESCRIPTORS} SELECT vec_id, 'resnet18+64+MSER+' || filename || ':' || vec_id AS key, package[1:4] || '_' || printf('%02d', 1 + label % 3) || '_' || printf('%02d', 1 + label % 5) AS identifier FROM d""",
)
def c5(t: Tables) -> DataFrame:
    """Keys and short identifiers from their parts."""
    one = F.col("label")
    return descriptors(t).select(
        "vec_id", keys.key(F.lit("resnet18"), F.lit(64), F.lit("MSER"), F.col("filename"), F.col("vec_id")).alias("key"), keys.identifier(one, 1 + one % 3, 1 + one % 5).alias("identifier")
    )


@query("c8_c9_replace_contains", "SELECT p_partkey, replace(p_type, ' ', '_') AS kind, contains(p_type, 'STEEL') AS steel, starts_with(p_brand, 'Brand#1') AS first FROM part")
def c8(t: Tables) -> DataFrame:
    return t.part.select("p_partkey", F.replace("p_type", F.lit(" "), F.lit("_")).alias("kind"), F.contains("p_type", F.lit("STEEL")).alias("steel"), F.startswith("p_brand", F.lit("Brand#1")).alias("first"))


@query(
    "f11_allow_list_routing",
    f"""WITH {SQL_DESCRIPTORS} SELECT vec_id, CASE WHEN phone = 1 AND label IN (1, 2, 3) THEN CASE WHEN filename LIKE '%az0%' THEN 'base' WHEN filename LIKE '%az3%' THEN 'query' END END AS route FROM d""",
)
def f11(t: Tables) -> DataFrame:
    """Base and query sets of listed packages, others to neither."""
    listed = [f"P{n:04d}_" for n in (1, 2, 3)]
    return descriptors(t).select("vec_id", keys.route(F.col("filename"), listed).alias("route"))


@query(
    "f2_excluded_packages",
    f"""WITH {SQL_DESCRIPTORS} SELECT vec_id, package FROM d WHERE package NOT IN ({', '.join(repr(p) for p in keys.EXCLUDED_PACKAGES)}, '0003_D01_S004')""",
)
def f2x(t: Tables) -> DataFrame:
    return descriptors(t).where(~F.col("package").isin(*keys.EXCLUDED_PACKAGES, "0003_D01_S004")).select("vec_id", "package")


@query("a39_f17_f18_groups", f"WITH {SQL_DESCRIPTORS} SELECT label AS packageclass, phone, count(*) AS size, count(*) FILTER (WHERE angle = 360) = 0 AS without_index FROM d GROUP BY ALL")
def a39(t: Tables) -> DataFrame:
    """Grouped catalogue, and which groups have no index view."""
    d = descriptors(t)
    return d.groupBy(F.col("label").alias("packageclass"), "phone").agg(F.count("*").alias("size"), (F.count_if(F.col("angle") == 360) == 0).alias("without_index"))


@query("k4_flushed_store", f"WITH {SQL_DESCRIPTORS} SELECT vec_id::INT AS region, round(vector[64], 5) AS first FROM d WHERE vec_id % 3 = 0")
def k4(t: Tables) -> DataFrame:
    """A store that was flushed holds what comes after, even under keys that it knew."""
    store = _store(t)
    rows = store.read().where("region % 3 = 0").withColumn("vector", F.reverse("vector"))
    path = t.scratch("turned")
    rows.write.parquet(path)  # read before the files go
    store.flush(sure=True)
    store.insert(t.spark.read.parquet(path).select(*rows.columns))
    return store.read().select("region", F.round(F.get("vector", 0).cast("double"), 5).alias("first"))


@query("k7_k8_k11_entities", "SELECT kind, c_custkey, c_name, c_acctbal FROM customer, (VALUES ('csv'), ('json'), ('parquet')) AS k(kind)")
def k8(t: Tables) -> DataFrame:
    """One result as csv, json and parquet in a folder that was cleared first, and read again."""
    rows, folder, out = t.customer.select("c_custkey", "c_name", "c_acctbal"), t.scratch("entities"), []
    tables.prepare_output(t.spark, folder)
    rows.write.parquet(f"{folder}/left-over.parquet")
    tables.prepare_output(t.spark, folder, clear=True)
    for kind in ("csv", "json", "parquet"):
        tables.write_entity(rows, f"{folder}/result.{kind}")
    for kind in ("csv", "json", "parquet"):
        back = t.spark.read.schema("c_custkey bigint, c_name string, c_acctbal double").option("header", True).format(kind)
        out.append(back.load(f"{folder}/*.{kind}").select(F.lit(kind).alias("kind"), "c_custkey", "c_name", "c_acctbal"))
    return out[0].union(out[1]).union(out[2])


@query("s17_folder_classes", "SELECT DISTINCT 'l_returnflag=' || l_returnflag AS label FROM lineitem")
def s17(t: Tables) -> DataFrame:
    """Files whose class is the name of their folder."""
    path = t.scratch("classes")
    t.lineitem.select("l_orderkey", "l_returnflag").write.partitionBy("l_returnflag").parquet(path)
    return catalog.folder_classes(t.spark, path, "*.parquet").select("label").distinct()
