"""Frames, catalogues, stores, vector files, annotations, matching and streams on small inputs."""

import struct
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from umbel.functions import keys, metrics
from umbel.operators import frames, matching, prefix, regions, robust
from umbel.sources import catalog, tables, xvecs
from umbel.sources.store import DescriptorStore
from umbel.streaming import ingest


def png(path, height=2, width=3):
    raw = b"".join(b"\x00" + bytes([10, 20, 30] * width) for _ in range(height))
    chunk = lambda kind, data: struct.pack(">I", len(data)) + kind + data + struct.pack(">I", zlib.crc32(kind + data))
    path.write_bytes(b"\x89PNG\r\n\x1a\n" + chunk(b"IHDR", struct.pack(">IIBBBBB", width, height, 8, 2, 0, 0, 0)) + chunk(b"IDAT", zlib.compress(raw)) + chunk(b"IEND", b""))


@pytest.fixture
def images(tmp_path):
    for p in (1, 2, 12):
        for ph in (1, 2):
            png(tmp_path / f"PFP_Ph{ph}_P{p:04d}_D{p:02d}_S00{ph}_C2_az{p * 10:03d}_side1.png")
    (tmp_path / "notes.txt").write_text("x")
    return tmp_path


def test_names_of_tables_in_files_and_folders(spark, tmp_path):
    rows = spark.range(4).selectExpr("id", "id % 2 AS half")
    rows.repartition(3).write.parquet(f"{tmp_path}/tables/events.parquet")
    rows.write.partitionBy("half").parquet(f"{tmp_path}/tables/pages.parquet")
    part = next((tmp_path / "tables" / "events.parquet").glob("part-*.parquet"))
    (tmp_path / "tables" / "nation.parquet").write_bytes(part.read_bytes())
    assert sorted(r["name"] for r in catalog.table_names(spark, f"{tmp_path}/tables").collect()) == ["events", "nation", "pages"]


def test_catalogue(spark, images):
    files = catalog.load(spark, str(images))
    assert files.count() == 6 and set(files.columns) == {"path", "filename", *keys.BY_DATABASE["enrollment"]}
    one = catalog.load(spark, str(images), filter_by={"packageclass": [1, 12], "phone": [2]})
    assert sorted(r["packageclass"] for r in one.collect()) == [1, 12]
    out = catalog.load(spark, str(images), filter_by={"packageclass": [1, 12], "phone": [2]}, filter_mode="exclusive")
    assert [(r["packageclass"], r["phone"]) for r in out.collect()] == [(2, 1)]
    ordered = catalog.load(spark, str(images), sort_by=["packageclass", "phone"]).collect()
    assert [(r["phone"], r["packageclass"]) for r in ordered] == [(1, 1), (1, 2), (1, 12), (2, 1), (2, 2), (2, 12)]
    assert catalog.load(spark, str(images), fraction=0.5).count() == 3
    shuffled = [r["filename"] for r in catalog.load(spark, str(images), sort_by=["phone"], shuffle=True).collect()]
    assert shuffled == [r["filename"] for r in catalog.load(spark, str(images), sort_by=["phone"], shuffle=True).collect()]
    assert {r["packageclass"]: r["size"] for r in catalog.groups(catalog.parse(catalog.scan(spark, str(images))).drop("size"), ["packageclass"]).collect()} == {1: 2, 2: 2, 12: 2}
    assert {r["label"] for r in catalog.folder_classes(spark, str(images)).collect()} == {images.name}
    with pytest.raises(ValueError, match="mode"):
        frames.catalogue_filter(files, {"phone": [1]}, "other")


def test_decode(spark, images):
    r = catalog.decode(spark, str(images)).first()
    assert (r["height"], r["width"], r["channels"]) == (2, 3, 3) and bytes(r["data"])[:3] == bytes([30, 20, 10])


def test_missing_attributes_are_null(spark):
    r = spark.createDataFrame([("nothing here",)], "n string").select(*[c.alias(k) for k, c in keys.attributes(F.col("n")).items()]).first()
    assert all(v is None for v in r)


def test_annotations(spark, tmp_path):
    (tmp_path / "a.xml").write_text(
        "<annotation><filename>f1</filename><size><width>9</width><height>8</height><depth>3</depth></size>"
        "<object><name>Text</name><type>bndbox</type><bndbox><xmin>1</xmin><ymin>2</ymin><xmax>5</xmax><ymax>4</ymax></bndbox></object>"
        "<object><name>Image</name><type>robndbox</type><robndbox><cx>10.0</cx><cy>10.0</cy><w>4.0</w><h>2.0</h><angle>0.0</angle></robndbox></object>"
        "<object><name>Odd</name><type>polygon</type></object></annotation>"
    )
    (tmp_path / "b.xml").write_text("<annotation><filename>f2</filename></annotation>")
    a = catalog.read_annotations(spark, str(tmp_path))
    assert {r["filename"]: len(r["objects"]) for r in a.collect()} == {"f1": 2, "f2": 0}
    rows = sorted(map(tuple, regions.box_statistics(a).collect()))
    assert rows == [("f1", "regular", "Text", 2.0, 4.0, 8.0, 2.0), ("f1", "rotated", "Image", 2.0, 4.0, 8.0, 2.0)]


def test_store(spark, tmp_path):
    s = DescriptorStore(spark, str(tmp_path / "s"))
    assert s.read().count() == 0
    row = lambda region, v: ("m", 2, "MI1", "PFP_az360", region, v)
    schema = "model string, length int, algorithm string, filename string, region int, vector array<float>"
    s.insert(spark.createDataFrame([row(1, [1.0, 2.0]), row(1, [9.0, 9.0]), row(2, [])], schema))
    s.insert(spark.createDataFrame([row(1, [5.0, 5.0]), row(3, [7.0, 7.0])], schema))
    assert sorted((r["region"], r["vector"]) for r in s.scan("m", 2, "MI1").collect()) == [(1, [1.0, 2.0]), (3, [7.0, 7.0])]
    assert s.like("m+2+%:3").count() == 1 and s.like("none").count() == 0 and s.get("PFP_az360", 1).count() == 1
    assert DescriptorStore.with_keys(s.read()).where("is_index").count() == 2
    with pytest.raises(ValueError, match="sure"):
        s.flush()
    s.flush(sure=True)
    assert s.read().count() == 0


@pytest.mark.parametrize("kind", ["f", "i", "b"])
def test_xvecs(spark, tmp_path, kind):
    x = np.arange(60).reshape(20, 3) % 200
    df = spark.createDataFrame([(i, [float(v) for v in r]) for i, r in enumerate(x)], "id int, vector array<double>")
    xvecs.write(df, str(tmp_path / "v"), "id", kind=kind)
    back = xvecs.read(spark, str(tmp_path / "v"), kind).orderBy("path", "n").collect()
    assert [r["vector"] for r in back] == x.astype(float).tolist()
    assert xvecs.decode(xvecs.encode(x, kind), kind).tolist() == x.tolist() and xvecs.decode(b"").shape == (0, 0)
    with pytest.raises(ValueError, match="whole number"):
        xvecs.decode(xvecs.encode(x, kind)[:-1], kind)


def test_csv_and_sessions(spark, tmp_path):
    df = spark.createDataFrame([("a", 1.5), ("b", float("nan")), (None, None)], "k string, v double")
    tables.write_csv(df, str(tmp_path / "c"))
    assert sorted(map(tuple, tables.read_csv(spark, str(tmp_path / "c"), "k string, v double").collect()), key=str) == sorted([("a", 1.5), ("b", None), (None, None)], key=str)
    s = tables.Session(spark, str(tmp_path / "s"))
    s.add(spark.sql("SELECT named_struct('status', 'fail', 'deep', named_struct('x', 1)) AS session, 'p1' AS path"))
    s.add(spark.sql("SELECT named_struct('status', 'success') AS session, 'p2' AS path"))
    assert set(s.read().columns) == {"session_status", "session_deep_x", "path"}
    assert [r["path"] for r in s.failed("path").collect()] == ["p1"]
    tables.write_entity(df, str(tmp_path / "e.json"))
    with pytest.raises(ValueError, match="no writer"):
        tables.write_entity(df, "x.png")
    tables.prepare_output(spark, str(tmp_path / "e.json"), clear=True)
    assert not any(tmp_path.joinpath("e.json").iterdir())


def test_frame_tools(spark):
    df = spark.createDataFrame([(1, None, 2.0, None), (2, None, None, "x")], "a int, b int, c double, d string")
    assert frames.drop_empty_columns(df).columns == ["a", "c", "d"]
    assert [r["c"] for r in frames.impute_means(df, ["c"]).orderBy("a").collect()] == [2.0, 2.0]
    assert frames.drop_rows_with_null(df.drop("b")).count() == 0
    assert [r[0] for r in df.orderBy("a").select(frames.nulls_per_row(df)).collect()] == [2, 2]
    d = spark.createDataFrame([(3.0, 1.0, 5.0)], "er_ALL_v double, er_TXT_v double, er_R_ALL double")
    assert frames.add_differences(d).first()["er_DIFF_v"] == 2.0
    shares = spark.range(20_000).select(frames.hash_split(F.col("id"), [0.7, 0.2, 0.1]).alias("p")).groupBy("p").count().collect()
    assert {r["p"]: round(r["count"] / 20_000, 1) for r in shares} == {0: 0.7, 1: 0.2, 2: 0.1}


@pytest.mark.parametrize("parts", [1, 9])
def test_running_sums(spark, parts):
    rng = np.random.default_rng(5)
    rows = [(int(i), int(v)) for i, v in enumerate(rng.integers(0, 40, 500))]
    df = spark.createDataFrame(rows, "i int, v int").repartition(parts)
    got = {r["i"]: (r["up"], r["down"]) for r in prefix.running(prefix.running(df.withColumn("one", F.lit(1)), "v", {"up": "one"}), "v", {"down": "one"}, True).collect()}
    v = np.array([r[1] for r in rows])
    assert got == {i: (int((v <= x).sum()), int((v >= x).sum())) for i, x in rows}
    numbered = {r["i"]: r["n"] for r in prefix.row_numbers(df, "i", "n").collect()}
    assert numbered == {i: i + 1 for i, _ in rows}
    assert prefix.row_numbers(df.where("false"), "i").count() == 0
    assert {r["chunk"] for r in frames.chunks(df, "i", 100).collect()} == {0, 1, 2, 3, 4}


def test_ratio_of_zero(spark):
    r = spark.createDataFrame([(0, 0, None), (3, 0, None)], "a int, b int, c int").select(metrics.ratio(F.col("a"), F.col("b")), metrics.ratio(F.col("a"), F.col("c"))).collect()
    assert [tuple(x) for x in r] == [(1.0, None), (1.0, None)]


def test_ransac(spark):
    rng = np.random.default_rng(7)
    world = np.c_[rng.uniform(-1, 1, (60, 2)), rng.uniform(4, 6, 60)]
    angle = 0.2
    turn = np.array([[np.cos(angle), 0, np.sin(angle)], [0, 1, 0], [-np.sin(angle), 0, np.cos(angle)]])
    view = lambda p: 500 * p[:, :2] / p[:, 2:]
    a, b = view(world), view(world @ turn.T + [0.5, 0.1, 0.0])
    assert robust.inliers(a, b, 1.0) == 60
    b[:20] += rng.uniform(40, 90, (20, 2))
    assert 38 <= robust.inliers(a, b, 1.0) <= 46
    assert robust.inliers(a[:7], b[:7]) is None
    desc = np.eye(60)
    rows = [("good", a.tolist(), desc.tolist(), b.tolist(), desc.tolist()), ("thin", a.tolist(), desc.tolist(), b[:1].tolist(), desc[:1].tolist()), ("none", None, None, None, None)]
    one = "array<array<double>>"
    got = {r["pair"]: r for r in matching.match_pairs(spark.createDataFrame(rows, f"pair string, points_ver {one}, descriptors_ver {one}, points_ref {one}, descriptors_ref {one}"), tolerance=1.0).collect()}
    assert (got["good"]["kp_actual"], got["good"]["good"]) == (60, 60) and got["good"]["ransac"] >= 38 and got["good"]["error"] is None
    assert "too few" in got["thin"]["error"] and "too few" in got["none"]["error"]


def test_image_stream(spark, images, tmp_path_factory):
    out = tmp_path_factory.mktemp("stream")
    seen = []
    q = ingest.run(catalog.parse(ingest.image_stream(spark, str(images), chunk=4)), lambda b, n: seen.append(sorted(r["packageclass"] for r in b.collect())), str(out / "state"))
    assert sorted(len(s) for s in seen) == [2, 4] and sum(p["rows"] for p in ingest.progress(q)) == 6
    assert ingest.run(catalog.parse(ingest.image_stream(spark, str(images), chunk=4)), lambda b, n: seen.append("again"), str(out / "state")) and "again" not in seen


def test_distinct_stream(spark, tmp_path):
    spark.range(20).selectExpr("id % 5 AS k").write.parquet(str(tmp_path / "in"))
    got = []
    ingest.run(ingest.distinct_keys(ingest.table_stream(spark, str(tmp_path / "in"), "k bigint"), ["k"]), lambda b, n: got.extend(r["k"] for r in b.collect()), str(tmp_path / "state"))
    assert sorted(got) == [0, 1, 2, 3, 4]


def test_overlap_counts_each_pair_once(spark):
    rng = np.random.default_rng(8)
    box = lambda i: (1, i, *(lambda x, y, w, h: (x, y, x + w, y + h))(*map(int, rng.integers(0, 200, 2)), *map(int, rng.integers(1, 150, 2))))
    a, b = [box(i) for i in range(30)], [box(i) for i in range(25)]
    schema = "image int, idx int, x1 int, y1 int, x2 int, y2 int"
    got = regions.overlap_join(spark.createDataFrame(a, schema), spark.createDataFrame(b, schema)).collect()
    want = {(p[1], q[1]) for p in a for q in b if p[2] < q[4] and q[2] < p[4] and p[3] < q[5] and q[3] < p[5]}
    assert {(r["ref"], r["ver"]) for r in got if r["ver"] is not None} == want and len([r for r in got if r["ver"] is not None]) == len(want)
    assert {r["ref"] for r in got} == set(range(30))


def test_medians_of_large_and_small_keys(spark, monkeypatch):
    """Keys with many rows get their bracket by broadcast, others by their key; null keys and values give nothing."""
    from statistics import median

    from umbel.operators import statistics

    monkeypatch.setattr(statistics, "_LARGE", 50)
    rows = [("a", float(i * i % 97)) for i in range(400)] + [("b", 3.0), ("b", 5.0), ("c", None), (None, 1.0)] + [("d", float(i)) for i in range(51)]
    found = statistics.medians(spark.createDataFrame(rows, "k string, v double"), ["k"], ["v"])
    got = {r["k"]: r["v_median"] for r in found.collect()}
    assert got == {k: median(v for x, v in rows if x == k) for k in "abd"}
    assert "BroadcastHashJoin" in found._jdf.queryExecution().toString() and "LeftAnti" in found._jdf.queryExecution().toString()
