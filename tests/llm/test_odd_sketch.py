"""Near duplicates by odd sketches against all pairs of full sets."""

import random

import numpy as np
import pytest

from gleaner.llm import odd_sketch
from gleaner.session import ship_package

SCHEMA = "doc_id bigint, text string, n bigint, digest string, keys string, cid string, n_shingles string, root string, component_id string"


def _texts():
    rnd = random.Random(9)
    vocabulary = ["w%d" % k for k in range(400)] + ["Été", "THE", "x\x00"]
    prose = lambda n: [rnd.choice(vocabulary) for _ in range(n)]
    out = []
    for _ in range(25):  # families: edited copies, some of copies
        family = [prose(rnd.choice([8, 30, 120, 300]))]
        for _ in range(rnd.randrange(12)):
            words = list(rnd.choice(family))
            for _ in range(rnd.randrange(1, max(2, len(words) // 25))):
                words[rnd.randrange(len(words))] = rnd.choice(vocabulary)
            family.append(words)
        out += [" ".join(w) for w in family]
    base = prose(200)
    for k in range(120):  # copies that are near the first one, and not all near each other
        words = list(base)
        for _ in range(rnd.randrange(1, 6)):
            words[rnd.randrange(200)] = "e%d" % k
        out.append("  ".join(words).upper() if k % 2 else "\n".join(words))
    passage = prose(100)
    out += [" ".join(prose(60) + passage + prose(60)) for _ in range(60)]
    rows = list(enumerate(out))
    rows += [(3, out[3]), (500, out[3]), (501, out[4].upper()), (None, out[5]), (None, "alone and without an id here"), (600, "a b"), (601, "A\tb"), (602, "a"),
             (603, ""), (604, None), (605, " \n "), (606, "a\x1cb c d"), (None, None), (607, " ".join(prose(20_000))), (608, "la " * 3000), (609, "la " * 4)]
    rnd.shuffle(rows)
    return [(i, t, 1, "d", "k", "c", "s", "r", "x") for i, t in rows]


def _set(text, shingle=4):
    words = (text or "").encode().lower().split()
    return {tuple(words[i:i + shingle]) for i in range(max(1, len(words) - shingle + 1))} if words else set()


def _brute(rows, percent=80, shingle=4):
    sets = [_set(t, shingle) for _, t, *_ in rows]
    root = list(range(len(rows)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for i in range(len(rows)):
        for j in range(i):
            both = len(sets[i] & sets[j])
            if both and 100 * both >= percent * len(sets[i] | sets[j]):
                root[find(i)] = find(j)
    least = {}
    for i, (doc, *_) in enumerate(rows):
        ids = least.setdefault(find(i), [])
        ids += [doc] if doc is not None else []
    out = []
    for i, (doc, *_) in enumerate(rows):
        component = min(least[find(i)], default=None)
        out.append((doc, len(sets[i]), component, doc == component))
    return sorted(out, key=str)


@pytest.mark.parametrize("block,links", [(odd_sketch.BLOCK, odd_sketch.FOREST_LINKS), (20, 30)])
def test_against_all_pairs(spark, monkeypatch, block, links):
    ship_package(spark)
    monkeypatch.setattr(odd_sketch, "FOREST_LINKS", links)
    rows = _texts()
    docs = spark.createDataFrame(rows, SCHEMA).repartition(3)
    got = odd_sketch.near_duplicates(docs, block=block)
    assert got.columns == ["doc_id", "n_shingles", "component_id", "kept"]
    assert sorted(map(tuple, got.collect()), key=str) == _brute(rows)


def test_other_limits(spark):
    ship_package(spark)
    rows = _texts()
    got = odd_sketch.near_duplicates(spark.createDataFrame(rows, SCHEMA), percent=90, shingle=2)
    assert sorted(map(tuple, got.collect()), key=str) == _brute(rows, 90, 2)


def test_nothing(spark):
    ship_package(spark)
    docs = spark.createDataFrame(_texts(), SCHEMA)
    assert odd_sketch.near_duplicates(docs.limit(0)).count() == 0
    rows = odd_sketch.near_duplicates(docs.filter("text is null or text = ''")).collect()
    assert sorted(map(tuple, rows), key=str) == [(603, 0, 603, True), (604, 0, 604, True), (None, 0, None, True)]


@pytest.mark.parametrize("count,size,other", [(odd_sketch.BANDS * odd_sketch.WIDTH, odd_sketch.BITS, 0.3), (odd_sketch.FINE_SAMPLES, odd_sketch.FINE_BITS, 0.68)])
def test_sketches_tell_similarity(count, size, other):
    rnd = np.random.default_rng(1)
    limit = odd_sketch.most_bits(80, count, size)

    def bits(share, n=400):
        common = int(n * 2 * share / (1 + share))
        a = rnd.integers(0, 1 << 63, n, np.uint64)
        b = np.concatenate((a[:common], rnd.integers(0, 1 << 63, n - common, np.uint64)))
        one, two = (np.frombuffer(odd_sketch.odd_sketch(odd_sketch.samples(x, count), size), np.uint64) for x in (a, b))
        return int(np.bitwise_count(one ^ two).sum())

    at_limit = [bits(0.8) for _ in range(300)]
    differ = 2 * count * 0.2
    expected = size / 2 * (1 - (1 - 2 / size) ** differ)
    assert abs(np.mean(at_limit) - expected) < size / 100 and max(at_limit) <= limit
    assert min(bits(other) for _ in range(100)) > limit


def test_a_pair_is_given_by_one_bucket(spark, monkeypatch):
    """Texts just under the limit share many buckets; all pairs of them were given by each of these."""
    ship_package(spark)
    rows = []
    for doc in range(16):  # three words of 200 differ in each, never the same or near ones: 173 of 221 shingles are common to two
        words = [f"w{i}" for i in range(200)]
        for at in (0, 64, 128):
            words[at + 4 * doc + 3] = f"x{doc}.{at}"
        rows.append((doc, " ".join(words)))
    pairs, given = odd_sketch._pairs, []

    def watched(*args):
        found = pairs(*args)
        if not args[4]:
            given.append([tuple(sorted(r)) for r in found.collect()])
        return found

    monkeypatch.setattr(odd_sketch, "_pairs", watched)
    got = odd_sketch.near_duplicates(spark.createDataFrame(rows, "doc_id bigint, text string"))
    assert got.filter("kept").count() == 16
    assert given and len(given[0]) == len(set(given[0])) > 100
