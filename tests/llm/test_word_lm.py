"""Word n-gram scores against brute force."""

import math
from collections import Counter
from pathlib import Path

import numpy as np
import pytest

from gleaner.llm import word_lm
from gleaner.llm.queries import QUERIES
from gleaner.session import ship_package

ROWS = [(1, "Été à la mer"), (2, "ètè a la mer"), (3, "один два три"), (4, "двое дар тир"), (4, "la  mer\nla mer 12"), (None, "la mer 34"), (None, "la mer 34"),
        (5, None), (6, " \n"), (7, "la mer la plage la mer la plage")]
GOOD = [1, 3, 7]


def _want(order, prior=5.0):
    texts = [(i, (t or "").lower().encode().split()) for i, t in ROWS]
    count, context = ({"t": Counter(), "b": Counter()} for _ in range(2))
    vocabulary = {w for _, ws in texts for w in ws}
    grams = lambda ws, n: [tuple(([None] * (n - 1) + ws)[i:i + n]) for i in range(len(ws))]
    for doc, words in texts:
        for n in range(1, order + 1):
            for g in grams(words, n):
                for side in ["b", *(["t"] if doc in GOOD else [])]:
                    count[side][g] += 1
                    context[side][n, g[:-1]] += 1

    def p(side, g):
        shorter = p(side, g[1:]) if len(g) > 1 else 1 / len(vocabulary)
        return (count[side][g] + prior * shorter) / (context[side][len(g), g[:-1]] + prior)

    out = []
    for doc, words in texts:
        losses = [sum(-math.log2(p(side, g)) for g in grams(words, order)) / len(words) if words else None for side in "tb"]
        out.append((doc, len(words), *losses, losses[0] - losses[1] if words else None))
    return sorted(out, key=lambda r: (str(r[0]), r[1]))


@pytest.mark.parametrize("order", [1, 2, 3])
def test_word_models(spark, order):
    ship_package(spark)
    docs = spark.createDataFrame(ROWS, "doc_id bigint, text string").repartition(3)
    good = spark.createDataFrame([(i,) for i in [*GOOD, 1, None]], "doc_id bigint")
    got = sorted((tuple(r) for r in word_lm.cross_entropy_difference(docs, good, order).collect()), key=lambda r: (str(r[0]), r[1]))
    assert [r[:2] for r in got] == [r[:2] for r in _want(order)]
    for a, b in zip(got, _want(order)):
        assert a[2:] == (pytest.approx(b[2:]) if b[2] is not None else (None,) * 3)
    assert word_lm.cross_entropy_difference(docs.limit(0), good, order).count() == 0


def test_texts_that_differ_in_letters_beyond_ascii_score_differently(spark, tmp_path):
    spark.createDataFrame(ROWS, "doc_id bigint, text string").write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(1, 1, 0), (3, 1, 0), (4, 0, 0)], "doc_id bigint, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    by = {r.n_tokens * 10 + (r.doc_id or 0): r for r in QUERIES["op7_lm_scoring"](spark, str(tmp_path)).collect()}
    assert by[41].score < by[42].score and by[33].score < by[34].score


def test_chunks_and_parts_give_what_one_table_gives(spark, monkeypatch):
    monkeypatch.setattr(word_lm, "PART_KEYS", 2)
    docs = spark.createDataFrame(ROWS, "doc_id bigint, text string").repartition(7)
    got = sorted((tuple(r) for r in word_lm.cross_entropy_difference(docs, spark.createDataFrame([(i,) for i in GOOD], "doc_id bigint")).collect()), key=lambda r: (str(r[0]), r[1]))
    for a, b in zip(got, _want(2), strict=True):
        assert a[2:] == (pytest.approx(b[2:]) if b[2] is not None else (None,) * 3)


def test_counts_of_ngrams_do_not_stay_on_the_disk(spark, tmp_path):
    numbers = np.random.default_rng(7)
    words = [f"word{k}" for k in numbers.zipf(1.3, 200_000) % 50_000]
    rows = [(k, " ".join(words[k * 200:(k + 1) * 200])) for k in range(1000)]
    path = f"{tmp_path}/documents.parquet"
    spark.createDataFrame(rows, "doc_id bigint, text string").write.parquet(path)
    shared = Path(spark.conf.get("spark.checkpoint.dir"))
    size = lambda at: sum(f.stat().st_size for f in Path(at).rglob("*.parquet"))
    before = size(shared)
    out = word_lm.cross_entropy_difference(spark.read.parquet(path), spark.createDataFrame([(1,)], "doc_id bigint"))
    assert out.count() == 1000
    assert size(shared) - before < size(path) / 2


def test_packed_numbers_come_back():
    arrays = [np.array(a, np.uint64) for a in ([], [0, 0], [1, 2**64 - 1, 5], range(70_000))]
    assert all((a == b).all() and len(a) == len(b) for a, b in zip(word_lm.unpack(word_lm.pack(*arrays)), arrays, strict=True))
