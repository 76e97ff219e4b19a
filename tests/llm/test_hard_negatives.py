"""Hard negatives against all inner products."""

import math
import random

import duckdb
import numpy as np
import pytest

from gleaner.llm import hard_negatives
from gleaner.llm.oracles import ORACLES
from gleaner.session import ship_package

SCHEMA = "vec_id bigint, embedding array<double>, label int, row string, id string, score string, slot int, anchor int"


def _vectors(size=8):
    rnd = random.Random(4)
    hot = [rnd.uniform(-0.3, 0.3) for _ in range(size)]
    rows = [(k, [rnd.uniform(-0.5, 0.5) for _ in range(size)], rnd.randrange(3)) for k in range(600)]
    rows += [(1000 + k, hot, k % 3) for k in range(300)]  # a vector that many rows share
    rows += [(100, hot, 1), (100, hot, 1), (200, [-x for x in hot], 2)]  # anchors with an id that is there already
    rows += [(700, None, 1), (800, [0.1, None] * (size // 2), 1), (900, [math.nan] * size, 1), (1200, [math.inf] * size, 1), (1300, [0.1] * size, None), (None, hot, 0),
             (1400, [0.1, 0.2, 0.3], 1), (1401, [0.3, 0.2, 0.3], 1), (1402, [0.1, 0.1, 0.1], 2), (1500, [], 1), (1501, [], 1), (1502, [], 2), (1600, [0.0] * size, 0),
             (1700, [1e30] * size, 0), (1800, hot, 9)]
    return [(i, v, label, "r", "i", "s", 1, 2) for i, v, label in rows]


def _brute(rows, positives=5, negatives=10, scale=256):
    usable = [(i, [math.floor(scale * x) for x in v], label) for i, v, label, *_ in rows
              if i is not None and label is not None and v is not None and all(x is not None and math.isfinite(x) and abs(x) < 1e9 for x in v)]
    out = []
    for at, (anchor, a, label) in enumerate(usable):
        if anchor % 100:
            continue
        scored = [(-sum(x * y for x, y in zip(a, b)), i, other == label, k) for k, (i, b, other) in enumerate(usable) if k != at and len(a) == len(b)]
        for p, positive, _, _ in sorted(s for s in scored if s[2])[:positives]:
            hard = sorted(s for s in scored if not s[2] and 30 * -p <= 100 * -s[0] <= 90 * -p)[:negatives]
            out += [(anchor, positive, rank, i, -p, -s) for rank, (s, i, _, _) in enumerate(hard, 1)]
    return sorted(out)


@pytest.mark.parametrize("group_bytes", [16 << 20, 300])
def test_against_all_products(spark, group_bytes):
    ship_package(spark)
    rows = _vectors()
    table = spark.createDataFrame(rows, SCHEMA).repartition(4)
    got = hard_negatives.mine(table, lambda i: i % 100 == 0, group_bytes=group_bytes)
    assert sorted(map(tuple, got.collect())) == _brute(rows)


def test_large_components_are_exact(spark):
    rnd = random.Random(8)
    rows = [(k, [rnd.uniform(-4e6, 4e6) for _ in range(4)], k % 2, "r", "i", "s", 1, 2) for k in range(301)]
    got = hard_negatives.mine(spark.createDataFrame(rows, SCHEMA), lambda i: i % 100 == 0)
    assert sorted(map(tuple, got.collect())) == _brute(rows)


def test_the_statement_says_the_same():
    rows = [r for r in _vectors() if r[0] != 1700]
    moved = [(i, v, (label + 1) % 10 if i is not None and i % 7 == 0 and label is not None else label) for i, v, label, *_ in rows]
    con = duckdb.connect()
    con.execute("CREATE TABLE embeddings (vec_id BIGINT, embedding DOUBLE[], label INTEGER)")
    con.executemany("INSERT INTO embeddings VALUES (?, ?, ?)", [r[:3] for r in rows])
    assert sorted(con.execute(ORACLES["op12_hard_negatives"]).fetchall()) == _brute(moved)


def test_nothing(spark):
    ship_package(spark)
    table = spark.createDataFrame(_vectors(), SCHEMA)
    assert hard_negatives.mine(table.limit(0), lambda i: i % 100 == 0).count() == 0
    assert hard_negatives.mine(table, lambda i: i < 0).count() == 0


def test_the_bound_is_never_passed_and_ends_the_walk():
    rnd = np.random.default_rng(2)
    centre = rnd.normal(size=16)
    members = np.floor(256 * (centre + 0.1 * rnd.normal(size=(20, 16))))
    block = hard_negatives.Block(np.arange(20), members)
    others = np.floor(256 * rnd.normal(size=(3000, 16)))
    units, norms = hard_negatives._units(others)
    bounds = block.bounds(units, norms)
    assert (members @ others.T <= bounds[None, :] * block.norms[:, None]).all()
    tenth = np.sort(members @ others.T, axis=1)[:, -10]
    assert (bounds[None, :] * block.norms[:, None] >= tenth[:, None]).sum(axis=1).max() < 600  # of 3000
