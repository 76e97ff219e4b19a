"""The tree data source, timed windows, stream sinks that are written twice, fuzzy names and the vector index."""

import os
import random
from datetime import datetime, timedelta

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from gleaner.operators import fuzzy, vector_index, vectors
from gleaner.operators.extract import scan
from gleaner.plans.ingest import run_ingest
from gleaner.session import ship_package
from gleaner.sources import corpus, files
from gleaner.sources.objects import _read_chunks
from gleaner.sources.tables import ioc_table, registry_table
from gleaner.sources.tree import TreeSource, TreeStreamReader, changed, register, walk
from gleaner.streaming import jobs


def write(root, name, data, mtime=1_700_000_000):
    path = os.path.join(root, name)
    os.makedirs(os.path.dirname(path), exist_ok=True)
    with open(path, "wb") as out:
        out.write(data)
    os.utime(path, (mtime, mtime))
    return path


def names_of(rows):
    return sorted(os.path.basename(r["file_path"]) for r in rows)


def test_tree_is_read_in_pieces_and_filters_are_pushed_down(spark, tmp_path):
    register(spark)
    root = str(tmp_path / "in")
    write(root, "a/one.txt", b"".join(b"line %d\n" % i for i in range(5000)))
    for name in ("_h.log", ".d/e.LOG", "a/b.md", "empty.txt"):
        write(root, name, b"" if name == "empty.txt" else b"1.2.3.4")
    rows = spark.read.format("tree").options(path=root, pieceBytes="1000").load()
    assert set(names_of(rows.collect())) == {"one.txt", "_h.log", "e.LOG", "b.md", "empty.txt"}
    parts = sorted((r["start"], r["content"]) for r in rows.filter("file_path like '%one.txt'").collect())
    assert "".join(c for _, c in parts) == "".join(f"line {i}\n" for i in range(5000)) and len({s for s, _ in parts}) > 40
    os.remove(write(root, "x/gone.txt", b""))
    logs = rows.filter("extension = '.log'")
    assert names_of(logs.collect()) == ["_h.log", "e.LOG"] and names_of(rows.filter("extension in ('.md', '.txt') and start = 0").select("file_path").distinct().collect()) == ["b.md", "empty.txt", "one.txt"]
    assert "extension" in logs._jdf.queryExecution().executedPlan().toString()
    some = spark.read.format("tree").options(path=root, extensions=".md,.LOG").load()
    assert names_of(some.collect()) == ["_h.log", "b.md", "e.LOG"]


def test_a_folder_that_cannot_be_listed_is_a_failed_file(spark, tmp_path):
    missing = str(tmp_path / "none")
    assert "FileNotFoundError" in next(walk(missing, frozenset())).error
    result = run_ingest(spark, missing, str(tmp_path / "tables"), datetime(2024, 3, 1))
    assert (result.files_processed, result.files_failed) == (0, 1)
    row = registry_table(spark, str(tmp_path / "tables")).current().first()
    assert row["file_path"] == missing and row["scan_status"] == "failed" and "FileNotFoundError" in row["error_message"]


def test_listings_tell_what_changed(tmp_path):
    root = str(tmp_path / "in")
    for name in ("a", "a.b/c", "a-b", "z/y/x"):
        write(root, name, b"1")
    before = list(walk(root, frozenset()))
    assert [e.key() for e in before] == sorted(e.key() for e in before)
    write(root, "a.b/c", b"22")
    write(root, "a.b/d", b"1")
    os.remove(os.path.join(root, "a-b"))
    after = list(walk(root, frozenset()))
    assert [os.path.relpath(e.path, root) for e in changed(iter(before), iter(after))] == ["a.b/c", "a.b/d"]


def test_tree_stream_sees_hidden_names_and_changes_in_place(spark, tmp_path):
    root, tables = str(tmp_path / "in"), str(tmp_path / "tables")
    for name in ("a.txt", "_c.txt", ".h/b.txt"):
        write(root, name, b"see 1.2.3.4 and \"5.6.7.8\"")

    def run():
        jobs.ingest_tree(spark, root, tables, str(tmp_path / "checkpoint")).awaitTermination()
        return ioc_table(spark, tables).all_versions().count()

    assert run() == 6 and run() == 6
    write(root, "_c.txt", b"now 9.9.9.9", mtime=1_700_000_500)
    assert run() == 7
    assert registry_table(spark, tables).all_versions().count() == 4
    assert len(os.listdir(str(tmp_path / "checkpoint-listings"))) <= 2


def test_prune_drops_what_a_file_no_longer_holds(spark, tmp_path):
    root, tables = str(tmp_path / "in"), str(tmp_path / "tables")
    write(root, "a.txt", b"1.2.3.4 and 5.6.7.8")
    write(root, "b.txt", b"1.2.3.4")
    run_ingest(spark, root, tables, datetime(2024, 3, 1))
    write(root, "a.txt", b"5.6.7.8 only", mtime=1_700_000_100)
    run_ingest(spark, root, tables, datetime(2024, 3, 2), prune=True)
    rows = ioc_table(spark, tables).current().collect()
    assert sorted(r["ioc_value"] for r in rows) == ["1.2.3.4", "5.6.7.8"]


def test_a_long_line_is_cut_between_indicators(spark, tmp_path, monkeypatch):
    values = [f"10.{i % 250}.{i // 250 % 250}.7" for i in range(30_000)]
    path = write(str(tmp_path), "min.js", ('{"' + '","'.join(values) + '"}').encode())
    size = os.path.getsize(path)
    for row_bytes, piece in ((5_000, 40_000), (1000, 10 * size), (100, 1777)):
        monkeypatch.setattr(files, "ROW_BYTES", row_bytes)
        parts = [t for start in range(0, size, piece) for t in files.text_of(path, start, piece)]
        assert b"".join(parts) == open(path, "rb").read() and max(map(len, parts)) < 3 * row_bytes + 100
        assert sum(p.count(v) for p, v in ((b"".join(parts).decode(), values[0]),)) >= 1
        found = scan(spark.createDataFrame([("f", p.decode()) for p in parts], "file_id string, content string"), ["file_id"], types=["ipv4"], whole_keys=False)
        assert {r["ioc_value"] for r in found.collect()} == set(values)


def test_a_run_without_separators_is_bounded(tmp_path, monkeypatch):
    monkeypatch.setattr(files, "ROW_BYTES", 1000)
    monkeypatch.setattr(files, "LONGEST_RUN", 5000)
    path = write(str(tmp_path), "a.txt", b"a" * 100_000)
    parts = [t for start in range(0, 100_000, 30_000) for t in files.text_of(path, start, 30_000)]
    assert b"".join(parts) == b"a" * 100_000 and max(map(len, parts)) <= 7000


# --- timed windows -----------------------------------------------------------------------------------------------------


def _stream(spark, folder, rows, n):
    spark.createDataFrame(rows, "key string, at timestamp").coalesce(1).write.mode("append").parquet(f"{folder}/in")
    return spark.readStream.schema("key string, at timestamp").parquet(f"{folder}/in")


def test_state_goes_after_the_last_window(spark, tmp_path):
    folder, start = str(tmp_path), datetime(2024, 1, 1)
    rows = [(k, start + timedelta(seconds=s)) for k in ("a", "b", "c") for s in (0, 0, 30, 59, 60, 200)] + [(None, start), ("n", None)]

    def run():
        requests = spark.readStream.schema("key string, at timestamp").parquet(f"{folder}/in")
        jobs.audit_windows(requests, "key", "at", f"{folder}/windows", f"{folder}/checkpoint", 60, late_seconds=10).awaitTermination()
        got = {(r["key_hash"], r["window_start"] - int(start.replace(tzinfo=None).timestamp())): r["requests"] for r in jobs.current_windows(spark, f"{folder}/windows").collect()}
        state = spark.read.format("statestore").option("stateVarName", "open").load(f"{folder}/checkpoint")
        return got, sorted(str(r["key"]["key_hash"]) for r in state.collect())

    _stream(spark, folder, rows, 0)
    got, state = run()
    base = {s for _, s in got if _ == "a"}
    first = min(base)
    assert {(k, s - first): n for (k, s), n in got.items()} == {(k, s): n for k in ("a", "b", "c") for s, n in ((0, 4), (60, 1), (200, 1))} | {(None, 0): 1}
    assert state == ["a", "b", "c"]  # of the key without name, the window is over
    _stream(spark, folder, [("a", start + timedelta(seconds=215)), ("z", start + timedelta(days=1))], 1)
    got, state = run()
    assert {(k, s - first): n for (k, s), n in got.items()}[("a", 200)] == 2 and state == ["z"]


def test_a_busy_key_sends_a_row_a_second(spark):
    from gleaner.streaming.windows import count_per_second

    ship_package(spark)
    rows = spark.range(0, 100_000, numPartitions=4).select(F.lit("k").alias("key_hash"), (F.col("id") % 7).alias("second"))
    counted = rows.mapInPandas(count_per_second, "key_hash string, second bigint, n bigint").collect()
    assert len(counted) == 4 * 7 and sum(r["n"] for r in counted) == 100_000


def _sightings(spark, folder, rows):
    spark.createDataFrame(rows, "file_id string, ioc_type string, ioc_value string, first_seen timestamp").write.mode("append").parquet(f"{folder}/seen-in")
    return spark.readStream.schema("file_id string, ioc_type string, ioc_value string, first_seen timestamp").parquet(f"{folder}/seen-in")


def test_sinks_outlive_their_checkpoint(spark, tmp_path):
    folder, day = str(tmp_path), datetime(2024, 1, 1)
    rows = [("f", "ipv4", f"1.1.1.{i}", day) for i in range(3)]
    source = _sightings(spark, folder, rows + rows[:1])
    for checkpoint in ("one", "two"):
        jobs.distinct_sightings(source, f"{folder}/distinct", f"{folder}/{checkpoint}").awaitTermination()
    assert spark.read.parquet(f"{folder}/distinct").count() == 3
    jobs.daily_counts(source, f"{folder}/daily", f"{folder}/three").awaitTermination()
    other = _sightings(spark, f"{folder}/other", [("g", "ipv4", f"2.1.1.{i}", day) for i in range(5)])
    jobs.daily_counts(other, f"{folder}/daily", f"{folder}/four").awaitTermination()
    assert [r["count"] for r in jobs.current_daily_counts(spark, f"{folder}/daily").collect()] == [9]


# --- names and vectors -------------------------------------------------------------------------------------------------


def _distance(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        before, row[0] = row[0], i
        for j, y in enumerate(b, 1):
            before, row[j] = row[j], min(row[j] + 1, row[j - 1] + 1, before + (x != y))
    return row[-1]


@pytest.mark.parametrize("distance", [1, 2, 3])
def test_names_near_each_other(spark, distance):
    rnd = random.Random(distance)
    names = {"".join(rnd.choice("abé") for _ in range(rnd.randrange(0, 7))) for _ in range(60)}
    for _ in range(25):
        name = "".join(rnd.choice("abcdefgh.-1é") for _ in range(rnd.randrange(4, 30)))
        for _ in range(5):
            letters = list(name)
            for _ in range(rnd.randrange(distance + 2)):
                at = rnd.randrange(len(letters) + 1)
                letters[at:at + rnd.randrange(2)] = rnd.choice([[], ["x"], ["y"]])
            names.add("".join(letters))
    want = {(a, b): d for a in names for b in names if a < b and (d := _distance(a, b)) <= distance}
    frame = spark.createDataFrame([(n,) for n in [*names, None, "dup", "dup"]], "name string").filter("name is null or name <> 'dup'")
    got = {(r["left_name"], r["right_name"]): r["distance"] for r in fuzzy.similar_pairs(frame, "name", distance).collect()}
    assert got == want
    asked = sorted(names)[::3]
    rows = fuzzy.search(spark.createDataFrame([(n,) for n in asked], "name string"), frame, "name", distance).collect()
    assert {(r["left_name"], r["right_name"]): r["distance"] for r in rows} == {(a, b): d for a in asked for b in names if (d := _distance(a, b)) <= distance}


def test_long_names_and_numbered_hosts(spark):
    rnd = random.Random(1)
    long = ["".join(rnd.choice("abcdefghijklmnopqrstuvwxyz0123456789-") for _ in range(253)) for _ in range(40)]
    near = [n[:100] + "#" + n[101:200] + n[201:] for n in long]
    frame = spark.createDataFrame([(n,) for n in long + near], "name string")
    assert {(r["left_name"], r["right_name"]) for r in fuzzy.similar_pairs(frame, "name", 2).collect()} == {tuple(sorted(p)) for p in zip(long, near)}
    assert fuzzy._looked_up(frame.select("name"), 2).count() <= 80 * 40  # not with the square of the length
    hosts = [f"host{i:05d}.example.com" for i in range(5000)]
    pairs = fuzzy.similar_pairs(spark.createDataFrame([(h,) for h in hosts], "name string"), "name", 1)
    assert pairs.count() == 3 * 5000 * 9 // 2 + 5000 * 4 // 2  # one of the last three digits, or the first of 0 to 4


def test_index_finds_most_and_all_in_one_bucket(spark):
    ship_package(spark)
    rnd = np.random.default_rng(3)
    centres = rnd.normal(size=(60, 24))
    points = centres[rnd.integers(0, 60, 6000)] + 0.6 * rnd.normal(size=(6000, 24))
    points[:1500] = points[0]  # a vector that many rows have
    rows = [(i, p.tolist()) for i, p in enumerate(points)] + [(6000, None), (6001, [1.0, 2.0])]
    stored = spark.createDataFrame(rows, "id long, vector array<float>").cache()
    asked = stored.filter("id % 20 = 0").select(F.col("id").alias("query_id"), "vector")
    usable = stored.filter("size(vector) = 24")
    exact = vectors.top_k(usable, asked.filter("size(vector) = 24"), 10).cache()
    found = vector_index.top_k_many(stored, asked, 10, bucket_rows=300, cell_rows=400, cell_queries=30)
    assert vector_index.recall(found, exact).agg(F.avg("recall")).first()[0] >= 0.9
    few = vector_index.top_k_many(stored, asked, 10, bucket_rows=10_000)
    assert sorted(map(tuple, few.collect())) == sorted(map(tuple, exact.collect()))
    assert vector_index.top_k_many(stored, asked.limit(0), 10).count() == 0 and vector_index.top_k_many(stored.limit(0), asked, 10).count() == 0


def test_a_checked_batch_is_replaced_when_it_runs_again(spark, tmp_path):
    from gleaner.schemas import IOC_TABLE

    folder, at = str(tmp_path), datetime(2024, 1, 1)
    store = spark.createDataFrame([("1.1.1.1", "ipv4", f, "Unknown", 50, at, at + timedelta(days=d), 0, None, []) for f, d in (("x", 0), ("x", 2), ("y", 1))], IOC_TABLE.schema)
    rows = spark.createDataFrame([("r", "1.1.1.1"), ("r", "1.1.1.1"), ("s", "2.2.2.2"), ("t", None)], "request_id string, ioc string")
    rows.write.parquet(f"{folder}/in")
    asked = spark.readStream.schema(rows.schema).parquet(f"{folder}/in")
    for _ in range(2):
        jobs.check_stream(asked, store, f"{folder}/out", f"{folder}/checkpoint").awaitTermination()
        got = sorted((r["request_id"], r["ioc"], r["found"], r["source_file_id"]) for r in spark.read.parquet(f"{folder}/out").collect())
        assert got == [("r", "1.1.1.1", True, "y")] * 2 + [("s", "2.2.2.2", False, None), ("t", None, False, None)]
        os.remove(f"{folder}/checkpoint/commits/0")  # as if the run had ended before its batch was done
        for left in os.listdir(f"{folder}/checkpoint/commits"):
            os.remove(f"{folder}/checkpoint/commits/{left}")


def test_only_changed_contents_are_scanned(spark, monkeypatch):
    from gleaner.operators.extract import with_ioc_count
    from gleaner.plans import ingest
    from gleaner.schemas import REGISTRY_TABLE

    at = datetime(2024, 1, 1)
    files_ = spark.createDataFrame([(f"f{i}", f"/f{i}", 7, at, f"1.2.3.{i}") for i in range(6)], "file_id string, file_path string, file_size long, last_modified timestamp, content string")
    registry = spark.createDataFrame([(f"f{i}", f"/f{i}", 7, at, "misc", 0, "", "", at, at) for i in range(4)], REGISTRY_TABLE.schema)
    for bound in (10, -1):  # ids sent to the contents, or results joined
        monkeypatch.setattr(ingest, "BROADCAST_FILES", bound)
        got = ingest.scanned_changes(files_, registry, with_ioc_count)
        assert sorted((r["file_id"], r["ioc_count"]) for r in got.collect()) == [("f4", 1), ("f5", 1)]


def test_a_table_in_many_files_is_a_stream(spark, tmp_path):
    rows = spark.createDataFrame([(i, f"text {i}") for i in range(30)], "doc_id bigint, text string")
    rows.repartition(3).write.parquet(str(tmp_path / "tables" / "documents.parquet"))
    rows.write.parquet(str(tmp_path / "tables" / "documents.parquet.old"))
    part = next(f for f in (tmp_path / "tables" / "documents.parquet").iterdir() if f.name.startswith("part-"))
    (tmp_path / "tables" / "pages.parquet").write_bytes(part.read_bytes())
    for name, want in (("documents", 30), ("pages", spark.read.parquet(str(part)).count())):
        sink = str(tmp_path / name)
        seen = corpus.stream(spark, str(tmp_path / "tables"), name).select(F.lit("t").alias("ioc_type"), F.timestamp_seconds("doc_id").alias("first_seen"))
        jobs.daily_counts(seen, sink, f"{sink}-checkpoint").awaitTermination()
        assert jobs.current_daily_counts(spark, sink).agg(F.sum("count")).first()[0] == want


def test_a_tree_stream_lists_by_tasks(spark, tmp_path, monkeypatch):
    """What the driver lists file by file takes as long as the tree is large, however many executors there are."""
    monkeypatch.setattr(TreeStreamReader, "latestOffset", lambda self: 1 / 0)
    root, tables, checkpoint = (str(tmp_path / n) for n in ("in", "tables", "checkpoint"))
    write(root, "a/one.txt", b"1.2.3.4"), write(root, "b/empty.md", b"")
    source = spark.dataSource  # the patched class is the one that is sent
    source.register(TreeSource)
    for _ in range(3):
        jobs.ingest_tree(spark, root, tables, checkpoint).awaitTermination()
    assert sorted((os.path.basename(r["file_path"]), r["scan_status"]) for r in registry_table(spark, tables).all_versions().collect()) == [("empty.md", "misc"), ("one.txt", "infected")]
    assert sorted(os.listdir(f"{checkpoint}-listings")) == ["1", "2"]
    gone = files.changes_since_last(spark, str(tmp_path / "none"), (), f"{checkpoint}-other", 0).collect()
    assert len(gone) == 1 and "FileNotFoundError" in gone[0]["error"]


def test_small_chunks_go_out_together():
    rows = pa.RecordBatch.from_arrays([pa.array([f"k{i}" for i in range(50)]), pa.array(["/none"] * 50), pa.array(range(50)), pa.array([0] * 50), pa.array([5] * 50)],
                                      names=["object_key", "file_path", "chunk", "start", "length"])
    out = list(_read_chunks(iter([rows])))
    assert len(out) == 1 and out[0].column(0).to_pylist() == [f"k{i}" for i in range(50)]
