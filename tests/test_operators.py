"""Operators on small fixtures: properties and brute-force comparisons."""

import itertools
import random
from datetime import datetime, timedelta

import numpy as np
import pytest
from pyspark.sql import functions as F

from gleaner.functions.paths import content_type, extension, file_id, has_extension
from gleaner.operators import audit, fuzzy, lookup, sketch, stats, vectors, versions
from gleaner.plans.check import bulk_check, gated_check
from gleaner.schemas import IOC_STORE

T0 = datetime(2024, 1, 1)


def store_rows(spark, rows):
    """``(value, type, file, family, day)`` rows as a store."""
    return spark.createDataFrame(
        [(v, t, f, fam, 50, T0 + timedelta(days=d), T0 + timedelta(days=d), 0, None, []) for v, t, f, fam, d in rows],
        IOC_STORE,
    )


def test_paths(spark):
    paths = ["a/b.TXT", "a.b/c", "x.log", ".log", "y.yaml", "z.YAML", "n\nl.json"]
    rows = spark.createDataFrame([(p,) for p in paths], "p string").select(
        "p", extension(F.col("p")).alias("e"), has_extension(F.col("p")).alias("ok"),
        has_extension(F.col("p"), ()).alias("any"), content_type(F.col("p")).alias("ct"), file_id(F.col("p")).alias("id"),
    ).collect()
    assert [r["e"] for r in rows] == [".txt", "", ".log", ".log", ".yaml", ".yaml", ".json"]
    assert [r["ok"] for r in rows] == [True, False, True, True, False, False, True]
    assert all(r["any"] for r in rows)
    assert [r["ct"] for r in rows] == [
        "application/octet-stream", "application/octet-stream", "text/plain", "application/octet-stream",
        "application/x-yaml", "application/octet-stream", "application/json",
    ]
    assert len(rows[0]["id"]) == 64


def test_latest_does_not_depend_on_order(spark):
    rnd = random.Random(5)
    # One key holds a third of all rows.
    rows = [("hot" if rnd.random() < 0.33 else f"k{rnd.randint(0, 50)}", rnd.randint(0, 30), rnd.randint(0, 9)) for _ in range(3000)]
    want = {}
    for key, version, payload in rows:
        want[key] = max(want.get(key, (-1, -1)), (version, payload))
    for n in (1, 7):
        rnd.shuffle(rows)
        frame = spark.createDataFrame(rows, "k string, v int, x int").repartition(n)
        current = versions.latest(frame, ["k"], "v")
        assert {r["k"]: (r["v"], r["x"]) for r in current.collect()} == want
        again = versions.latest(current.unionByName(current), ["k"], "v")
        assert {r["k"]: (r["v"], r["x"]) for r in again.collect()} == want


def test_check_picks_and_keeps_order(spark):
    store = store_rows(spark, [
        ("1.1.1.1", "ipv4", "f2", "Old", 1), ("1.1.1.1", "ipv4", "f2", "New", 5), ("1.1.1.1", "ipv4", "f1", "Other", 3),
        ("evil.com", "domain", "f1", "Unknown", 2),
    ])
    requests = spark.createDataFrame([("r", ["evil.com", "EVIL.com", "1.1.1.1", "none", "1.1.1.1"])], "request_id string, iocs array<string>")

    def families(**options):
        rows = sorted(bulk_check(requests, store, **options).collect(), key=lambda r: r["position"])
        assert [r["ioc"] for r in rows] == ["evil.com", "EVIL.com", "1.1.1.1", "none", "1.1.1.1"]
        return [r["malware_family"] for r in rows]

    # The row of f2 is replaced by its later version, so f1 is now the oldest sighting.
    assert families() == ["Unknown", None, "Other", None, "Other"]
    assert families(pick="latest") == ["Unknown", None, "New", None, "New"]
    assert families(normalize=True) == ["Unknown", "Unknown", "Other", None, "Other"]
    assert bulk_check(requests, store, max_iocs=4).count() == 0
    first = bulk_check(requests, store).filter("position = 0").first()
    assert first["first_seen"] == "2024-01-03T00:00:00Z" and first["found"] and first["confidence"] == 50


def test_request_validation(spark):
    requests = spark.createDataFrame([("a", ["x"]), ("b", []), ("c", ["x"] * 1001), ("d", None)], "request_id string, iocs array<string>")
    rows = {r["request_id"]: (r["is_valid"], r["error"]) for r in lookup.validate_requests(requests).collect()}
    assert rows == {"a": (True, ""), "b": (False, "No IOCs provided"), "c": (False, "Too many IOCs"), "d": (False, "No IOCs provided")}


@pytest.mark.parametrize("hashing", ["xxhash64", "md5"])
def test_sketch_has_no_false_negatives(spark, hashing):
    size = sketch.SketchSize(capacity=20_000, error_rate=0.001, hashing=hashing)
    values = spark.range(20_000).select(F.concat(F.lit("host-"), "id").alias("v"))
    half = values.filter(F.length("v") < 9)
    whole = sketch.extend(sketch.build(half, "v", size), sketch.build(values, "v", size))
    hits = sketch.probe(values, "v", whole, size)
    assert hits.filter("maybe_present").count() == 20_000
    absent = spark.range(100_000).select(F.concat(F.lit("absent-"), "id").alias("v"))
    false_hits = sketch.probe(absent, "v", whole, size).filter("maybe_present").count()
    assert false_hits <= 3 * 0.001 * 100_000
    info = sketch.info(whole, values, "v", size).first()
    assert info["items_inserted"] == 20_000 and 0.2 < info["fill_ratio"] < 0.6


def test_gated_check_equals_plain_check(spark):
    store = store_rows(spark, [(f"v{i % 40}", "domain", f"f{i}", "Unknown", i) for i in range(100)])
    requests = spark.createDataFrame(
        [(f"r{i}", [f"v{j}" for j in range(i, i + 30)] + ["v1", "v1"]) for i in range(20)], "request_id string, iocs array<string>"
    )
    size = sketch.SketchSize(capacity=40, error_rate=0.3)  # many false hits, same answer
    gate = sketch.build(store, "ioc_value", size)
    plain = sorted(map(tuple, bulk_check(requests, store).collect()), key=str)
    assert sorted(map(tuple, gated_check(requests, store, gate, size).collect()), key=str) == plain


def brute_force_windows(times, window):
    out, start = {}, None
    for t in sorted(times):
        if start is None or t >= start + window:
            start = t
        out[start] = out.get(start, 0) + 1
    return out


@pytest.mark.parametrize("window", [60, 3600])
def test_anchored_windows(spark, window):
    rnd = random.Random(window)
    # A busy key over several days holds a third of the requests; the others come in bursts, some across midnight.
    times = {"busy": [rnd.randint(0, 4 * 86_400) for _ in range(6000)]}
    for k in range(40):
        centre = rnd.choice([86_400, 2 * 86_400, rnd.randint(0, 300_000)])
        times[f"k{k}"] = [max(0, centre + rnd.randint(-600, 600)) for _ in range(rnd.randint(1, 500))]
    rows = [(k, T0 + timedelta(seconds=t)) for k, ts in times.items() for t in ts]
    log = spark.createDataFrame(rows, "k string, t timestamp").repartition(5)
    got = audit.anchored_windows(log, "k", "t", 50, window).select(
        "key_hash", F.unix_seconds("window_start").alias("s"), "requests", "exceeded", "remaining"
    ).collect()
    base = int((T0 - datetime(1970, 1, 1)).total_seconds())
    want = {(k, base + s): n for k, ts in times.items() for s, n in brute_force_windows(ts, window).items()}
    assert {(r["key_hash"], r["s"]): r["requests"] for r in got} == want
    assert all(r["exceeded"] == max(r["requests"] - 50, 0) and r["remaining"] == max(50 - r["requests"], 0) for r in got)


def test_aligned_windows_with_default_limit(spark):
    rows = [("k", T0 + timedelta(seconds=s)) for s in (0, 59, 60, 61)]
    got = audit.aligned_windows(spark.createDataFrame(rows, "k string, t timestamp"), "k", "t").orderBy("window_start").collect()
    assert [(r["requests"], r["exceeded"], r["remaining"]) for r in got] == [(2, 0, 998), (2, 0, 998)]


def test_top_k_ways_agree(spark, monkeypatch):
    rng = np.random.default_rng(1)
    held, asked = rng.normal(size=(500, 8)), rng.normal(size=(30, 8))
    held[7] = 0
    stored = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(held)], "id bigint, vector array<float>").repartition(6)
    queries = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(asked)], "query_id bigint, vector array<float>")
    few = sorted(map(tuple, vectors.top_k(stored, queries, 5).collect()))
    monkeypatch.setattr(vectors, "BROADCAST_NUMBERS", 10)
    monkeypatch.setattr(vectors, "_QUERIES_PER_BLOCK", 7)
    many = sorted(map(tuple, vectors.top_k(stored, queries, 5).collect()))
    assert few == many and len(few) == 150
    a, b = held.astype(np.float32).astype(float), asked.astype(np.float32).astype(float)
    norms = np.linalg.norm(a, axis=1)
    norms[7] = 1
    scores = np.round((b / np.linalg.norm(b, axis=1, keepdims=True)) @ (a / norms[:, None]).T, 6)
    want = [(q, r + 1, int(i)) for q in range(30) for r, i in enumerate(np.lexsort((np.arange(500), -scores[q]))[:5])]
    assert [row[:3] for row in few] == want


def edit_distance(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        row = _next_row(row, i, x, b)
    return row[-1]


def _next_row(row, i, x, b):
    out = [i]
    for j, y in enumerate(b, 1):
        out.append(min(row[j] + 1, out[-1] + 1, row[j - 1] + (x != y)))
    return out


@pytest.mark.parametrize("distance", [1, 2])
def test_similar_pairs(spark, distance):
    rnd = random.Random(distance)
    names = {"".join(rnd.choice("ab.c") for _ in range(rnd.randint(1, 7))) for _ in range(150)}
    frame = spark.createDataFrame([(n,) for n in names for _ in range(2)], "name string")
    got = {(r["left_name"], r["right_name"]): r["distance"] for r in fuzzy.similar_pairs(frame, "name", distance).collect()}
    want = {(a, b): edit_distance(a, b) for a, b in itertools.combinations(sorted(names), 2)}
    assert got == {pair: d for pair, d in want.items() if d <= distance}
    found = fuzzy.search(frame.filter(F.length("name") == 3), frame, "name", distance).collect()
    assert {(r["left_name"], r["right_name"]) for r in found} == {
        (a, b) for a in names for b in names if len(a) == 3 and edit_distance(a, b) <= distance
    }


def test_histogram_and_counts(spark):
    rows = spark.createDataFrame([("a", 0.001), ("a", 0.02), ("a", 7.0), ("b", None)], "k string, v double")
    got = {(r["k"], r["le"]): r["bucket_count"] for r in stats.histogram(rows, F.col("v"), (0.001, 0.05, 5), ["k"]).collect()}
    assert got == {("a", "0.001"): 1, ("a", "0.05"): 2, ("a", "5"): 2, ("a", "+Inf"): 3,
                   ("b", "0.001"): 0, ("b", "0.05"): 0, ("b", "5"): 0, ("b", "+Inf"): 0}
    codes = spark.createDataFrame([("/check", "POST", 399), ("/check", "POST", 400)], "endpoint string, method string, status_code int")
    assert {(r["status"], r["requests"]) for r in stats.request_counters(codes).collect()} == {("success", 1), ("error", 1)}


def test_retention(spark):
    log = spark.createDataFrame([(1, T0), (2, T0 + timedelta(seconds=1))], "id int, t timestamp")
    assert [r["id"] for r in versions.retained(log, "t", T0 + timedelta(days=30)).collect()] == [2]
