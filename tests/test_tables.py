"""Stored objects, the request log, and filters that grow."""

import os
from datetime import datetime

import pytest
from pyspark.sql import functions as F

from gleaner.operators import sketch
from gleaner.sources.logs import LogTable
from gleaner.sources.objects import ObjectStore



def stamp():
    return F.lit("2024-06-01 00:00:00").cast("timestamp")


def _files(root):
    """Paths and modification times of the data files under a folder, by folder."""
    found = {}
    for folder, _, names in os.walk(root):
        for name in names:
            if name.endswith(".parquet"):
                found.setdefault(os.path.basename(folder), set()).add((name, os.stat(os.path.join(folder, name)).st_mtime_ns))
    return found


def _store(spark, tmp_path, contents, chunk=10):
    store = ObjectStore(spark, str(tmp_path / "objects"), chunk, folders=8)
    rows = spark.createDataFrame([(k, f"{k}.txt", bytearray(v)) for k, v in contents.items()], "object_key string, file_path string, content binary")
    assert store.put(rows, stamp()).count() == 0
    return store


def _read(spark, store, asked):
    rows = store.read_range(spark.createDataFrame(asked, "object_key string, first long, length long")).collect()
    found = {}
    for r in sorted(rows, key=lambda r: r["start"]):
        found[r["object_key"]] = found.get(r["object_key"], b"") + bytes(r["content"])
    return found


def test_ranges_of_objects(spark, tmp_path):
    contents = {f"k{i}": bytes(range(i)) for i in (0, 1, 9, 10, 11, 20, 57)}
    store = _store(spark, tmp_path, contents)
    for first, length in ((0, 100), (3, 4), (8, 5), (9, 1), (10, 10), (25, 1000), (60, 5), (5, 0), (-1, 5)):
        want = {k: v[first:first + length] for k, v in contents.items() if first >= 0 and v[first:first + length]}
        assert _read(spark, store, [(k, first, length) for k in contents] + [("none", 0, 5)]) == want
    assert {r["object_key"]: (r["size"], r["chunks"]) for r in store.manifest().collect()} == {k: (len(v), max(1, -(-len(v) // 10))) for k, v in contents.items()}


def test_a_later_version_is_read(spark, tmp_path):
    store = _store(spark, tmp_path, {"a": b"old content of a", "b": b"b"})
    rows = spark.createDataFrame([("a", "a.log", bytearray(b"new"))], "object_key string, file_path string, content binary")
    store.put(rows, F.lit("2024-07-01 00:00:00").cast("timestamp"))
    assert _read(spark, store, [("a", 0, 99), ("b", 0, 99)]) == {"a": b"new", "b": b"b"} and store.damaged().count() == 0


def test_damage_is_noticed(spark, tmp_path):
    store = _store(spark, tmp_path, {"a": bytes(100), "b": b"fine"})
    chunks = spark.read.parquet(f"{store.path}/chunks")
    bad = chunks.withColumn("content", F.when((F.col("object_key") == "a") & (F.col("chunk") == 3), F.lit(b"0123456789")).otherwise(F.col("content")))
    bad.write.partitionBy("folder").parquet(str(tmp_path / "bad/chunks"))
    spark.read.parquet(f"{store.path}/manifest").write.partitionBy("folder").parquet(str(tmp_path / "bad/manifest"))
    other = ObjectStore(spark, str(tmp_path / "bad"), 10)
    assert [r["object_key"] for r in other.damaged().collect()] == ["a"]
    assert _read(spark, other, [("a", 0, 25), ("b", 0, 9)]) == {"a": bytes(25), "b": b"fine"}
    with pytest.raises(Exception, match="damaged"):
        _read(spark, other, [("a", 25, 10)])


def test_delete_rewrites_only_folders_with_deleted_keys(spark, tmp_path):
    contents = {f"k{i}": b"content %d" % i * 3 for i in range(60)}
    store = _store(spark, tmp_path, contents)
    before = {name: _files(f"{store.path}/{name}") for name in ("manifest", "chunks")}
    touched = store.delete(spark.createDataFrame([("k3",), ("k17",), ("absent",)], "object_key string"))
    left = set(contents) - {"k3", "k17"}
    assert {r["object_key"] for r in store.manifest().collect()} == left and 1 <= len(touched) <= 2
    assert set(_read(spark, store, [(k, 0, 99) for k in contents])) == left and store.damaged().count() == 0
    for name, files in before.items():
        now = _files(f"{store.path}/{name}")
        assert {f for f in files if files[f] != now[f]} == {f"folder={t}" for t in touched}
    assert store.delete(spark.createDataFrame([(k,) for k in contents], "object_key string")) and store.manifest().count() == 0
    assert store.delete(spark.createDataFrame([("k5",)], "object_key string")) == []


def test_a_file_larger_than_a_cell(spark, tmp_path):
    path, size = str(tmp_path / "large.bin"), 3 << 30
    with open(path, "wb") as out:
        out.truncate(size)
        out.seek(size - 5)
        out.write(b"the e")
    store = ObjectStore(spark, str(tmp_path / "objects"), 32 << 20)
    rows = spark.createDataFrame([("large", path, size), ("gone", str(tmp_path / "gone.txt"), 3)], "file_id string, file_path string, file_size long")
    failed = store.put_files(rows, stamp()).collect()
    assert [r["file_id"] for r in failed] == ["gone"] and "FileNotFoundError" in failed[0]["error"]
    assert [(r["object_key"], r["size"], r["chunks"]) for r in store.manifest().collect()] == [("large", size, 96)]
    assert _read(spark, store, [("large", size - 7, 100)]) == {"large": b"\0\0the e"}


LOG = "query_id string, timestamp timestamp, api_key_hash string, endpoint string, response_time_ms long"


def test_log_is_shortened_by_whole_days(spark, tmp_path):
    log = LogTable(spark, str(tmp_path / "log"))
    assert log.read().count() == 0
    at = [datetime(2024, 1, d, h) for d in range(1, 11) for h in (1, 12, 23)]
    log.append(spark.createDataFrame([(str(i), t, "k", "/check", i) for i, t in enumerate(at)], LOG))
    log.append(spark.createDataFrame([(None, datetime(2024, 1, 10, 5), "k", "/stats", 1)], LOG))
    ids = [r["query_id"] for r in log.read().collect()]
    assert len(set(ids)) == 31 and sorted(map(len, ids))[-1] == 36
    assert log.between(datetime(2024, 1, 3), datetime(2024, 1, 4, 12)).count() == 4
    before = _files(log.path)
    gone, rewritten = log.retain(datetime(2024, 1, 15, 12), days=10)
    assert (gone, rewritten) == ([f"2024-01-0{d}" for d in range(1, 5)], ["2024-01-05"])
    assert sorted(r["timestamp"] for r in log.read().select("timestamp").collect())[0] == datetime(2024, 1, 5, 23)
    after = _files(log.path)
    assert {f: after[f] for f in after if f > "day=2024-01-05"} == {f: before[f] for f in before if f > "day=2024-01-05"}
    assert log.retain(datetime(2024, 1, 16), days=10) == (["2024-01-05"], ["2024-01-06"])
    assert log.retain(datetime(2025, 1, 1), days=1)[1] == [] and log.read().count() == 0


@pytest.mark.parametrize("hashing", ["xxhash64", "md5"])
def test_a_filter_grows(spark, hashing):
    first = sketch.SketchSize(1000, 0.01, hashing)
    values = spark.range(0, 10_000).select(F.concat(F.lit("v"), "id").alias("x"))
    series, items = sketch.grow(None, None, values.filter("x < 'v5'"), "x", first)
    series, items = sketch.grow(series.cache(), items.cache(), values, "x", first)
    series, items = series.cache(), items.cache()
    held = {r["layer"]: r["items"] for r in items.collect()}
    assert len(held) == 4 and 9_900 <= sum(held.values()) <= 10_000
    assert all(n <= 1.12 * (1000 << layer) for layer, n in held.items())
    info = sketch.series_info(series, items, first).first()
    assert info["expansions"] == 3 and info["capacity"] == 15_000 and info["items_inserted"] == sum(held.values())
    there = sketch.probe_series(values, "x", series, first, sorted(held))
    assert there.filter("maybe_present").count() == 10_000
    others = spark.range(0, 50_000).select(F.concat(F.lit("other"), "id").alias("x"))
    wrong = sketch.probe_series(others, "x", series, first, sorted(held)).filter("maybe_present").count()
    assert wrong / 50_000 < 3 * 0.01


def test_a_filter_of_nothing(spark):
    first = sketch.SketchSize(10)
    series, items = sketch.grow(None, None, spark.createDataFrame([(None,)], "x string"), "x", first)
    assert series.count() == 0 and items.count() == 0
    assert sketch.series_info(series, items, first).first()["items_inserted"] == 0


def test_a_bucketed_registry_is_not_shuffled(spark, tmp_path):
    from gleaner.plans.ingest import changed_files
    from gleaner.schemas import REGISTRY_TABLE
    from gleaner.sources.tables import BucketedTable, StoredTable

    plain = StoredTable(spark, str(tmp_path / "plain"), REGISTRY_TABLE)
    table = BucketedTable(spark, str(tmp_path / "it's bucketed"), REGISTRY_TABLE, buckets=4)
    assert table.all_versions().count() == 0
    at = datetime(2024, 1, 1)
    for n in (1, 2):  # two runs, so that a key has versions in two files of its bucket
        rows = spark.createDataFrame([(f"f{i}", f"/f{i}", 1, at, "misc" if i % 3 else "failed", 0, "", "", at, datetime(2024, 1, n)) for i in range(0, 40, n)], REGISTRY_TABLE.schema)
        plain.append(rows)
        table.append(rows)
    files = spark.createDataFrame([(f"f{i}", f"/f{i}", 1, at) for i in range(50)], "file_id string, file_path string, file_size long, last_modified timestamp")
    want = sorted(r["file_id"] for r in changed_files(files, plain.all_versions()).collect())
    found = changed_files(files, table.all_versions())
    assert sorted(r["file_id"] for r in found.collect()) == want
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    try:
        latest_plan = table.current()._jdf.queryExecution().executedPlan().toString()
        join_plan = changed_files(files.hint("merge"), table.all_versions())._jdf.queryExecution().executedPlan().toString()
    finally:
        spark.conf.set("spark.sql.adaptive.enabled", "true")
    assert "Exchange" not in latest_plan
    assert join_plan.count("Exchange hashpartitioning") == 1 and "Bucketed: true" in join_plan  # of the files only
    other = spark.newSession()
    assert BucketedTable(other, str(tmp_path / "it's bucketed"), REGISTRY_TABLE, buckets=4).current().count() == 40


def test_requests_are_all_answered(spark):
    from gleaner.operators import lookup
    from gleaner.plans.check import answer
    from gleaner.schemas import IOC_TABLE

    at = datetime(2024, 1, 1)
    store = spark.createDataFrame([("1.2.3.4", "ipv4", "f", "Unknown", 50, at, at, 0, None, [])], IOC_TABLE.schema)
    bodies = ['{"request_id": "a", "iocs": ["1.2.3.4", "x"]}', '{"request_id": "b", "iocs": []}', '{"request_id": "c"', "", None, '{"request_id": "d", "iocs": ["1","2","3","4"]}', '[1]', '{"iocs": "no list", "request_id": "e"}']
    lines = spark.createDataFrame(list(enumerate(bodies)), "n int, body string")
    parsed = lookup.parse_requests(lines)
    assert {r["n"]: r["error"] for r in parsed.collect() if r["error"]} == {n: "Invalid request body" for n in (2, 3, 4, 6, 7)}
    got = answer(parsed, store, max_iocs=3).collect()
    assert sorted((r["request_id"] or "", r["ioc"] or "", r["error"]) for r in got if r["error"]) == sorted(
        [("", "", "Invalid request body")] * 5 + [("b", "", "No IOCs provided"), ("d", "", "Too many IOCs")])
    assert sorted((r["request_id"], r["ioc"], r["found"]) for r in got if not r["error"]) == [("a", "1.2.3.4", True), ("a", "x", False)]


def test_payloads_are_filtered_before_the_search(spark):
    from gleaner.operators import vectors

    rows = [(i, [1.0, float(i)], p) for i, p in enumerate(['{"label": 3, "at": {"x": "a"}}', '{"label": "3"}', "no json", None, '{"label": 4}', "[]"])]
    held = vectors.with_payload(spark.createDataFrame(rows, "id long, vector array<double>, payload string"))
    assert [r["id"] for r in held.filter(vectors.payload_value("$.label", "int") >= 3).orderBy("id").collect()] == [0, 1, 4]
    assert [r["id"] for r in held.filter(vectors.payload_value("$.at.x", "string") == "a").collect()] == [0]
