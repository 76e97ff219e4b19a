"""Collocations against plain counting, with shards and maps small enough to be cut often."""

import random
import re
from collections import Counter

import duckdb
import pytest

from gleaner.llm import collocations
from gleaner.llm.oracles import ORACLES
from gleaner.session import ship_package

SCHEMA = "doc_id bigint, text string, lang string, phrase string, n bigint, a bigint, l string, score string"


def _texts():
    rnd = random.Random(11)
    words = ["w%d" % min(k, 40) for k in range(60)] + ["été", "NÜN", "Of", "the", "x\x00y", "|"]
    prose = lambda n: "".join(rnd.choice(words) + rnd.choice([" ", " ", " ", "\t ", ", ", "\n", ". "]) for _ in range(n))
    rows = [(k, prose(rnd.randrange(120)) + " Of The west, of the west of the", rnd.choice(["en", "fr", None])) for k in range(150)]
    rows += [(1, None, "en"), (None, "", None), (2, " \n,;", "en"), (3, "solo", "xx"), (4, "la " * 900, "en"), (5, "z" * 5000 + " " + prose(3000), "fr"), (7, None, None)]
    rows += [(6, "same words here again", "de")] * 12
    return [(i, t, lang, "p", 1, 2, "l", "s") for i, t, lang in rows]


def _counts(rows, longest):
    counts = Counter()
    for _, text, lang, *_ in rows:
        text = (text or "").translate({c: c + 32 for c in range(65, 91)})
        for piece in re.split(r"[.,;:!?\n-\r]", text):
            words = [w for w in re.split(r"[ \t]+", piece) if w]
            for size in range(1, longest + 1):
                counts.update((lang or "und", *words[i:i + size]) for i in range(len(words) - size + 1))
    return counts


def _brute(rows, longest, least, covered, top):
    counts = _counts(rows, longest)
    candidates = {p: a for p, a in counts.items() if len(p) > 2 and a >= least}
    found = []
    for (lang, *words), a in candidates.items():
        cuts = []
        for k in range(1, len(words)):
            l, r = counts[(lang, *words[:k])], counts[(lang, *words[k:])]
            cuts.append((10 ** 6 * a * a // (l * r), k, l, r))
        score, _, l, r = min(cuts)
        inside = any(len(p) > len(words) + 1 and p[0] == lang and 100 * b >= covered * a and any(list(p[i:i + len(words)]) == words for i in range(1, len(p)))
                     for p, b in candidates.items())
        if not inside:
            found.append((lang, -score, -a, " ".join(words).encode(), l, r))
    out, rank = set(), Counter()
    for lang, score, a, phrase, l, r in sorted(found):
        rank[lang] += 1
        if rank[lang] <= top:
            n = sum(v for p, v in counts.items() if p[0] == lang and len(p) == 2)
            out.add((lang, rank[lang], phrase.decode(), -a, l, r, n, -score))
    return out


@pytest.mark.parametrize("longest,least,top,options", [
    (3, 10, 2000, {}), (3, 10, 7, {"shard_words": 97, "most_bits": 8192, "slice_bytes": 64}),
    (4, 3, 2000, {"shard_words": 300, "slice_bytes": 200}), (2, 2, 50, {"shard_words": 1, "slice_bytes": 1}),
])
def test_against_plain_counting(spark, longest, least, top, options):
    ship_package(spark)
    rows = _texts()
    docs = spark.createDataFrame(rows, SCHEMA).repartition(3)
    got = collocations.collocations(docs, longest, least, 50, top, **options)
    assert got.columns == ["lang", "rank", "phrase", "a", "l", "r", "n", "score"]
    assert sorted(map(tuple, got.collect())) == sorted(_brute(rows, longest, least, 50, top))


def test_the_statement_says_the_same(spark):
    rows = _texts()
    documents = spark.createDataFrame(rows, SCHEMA).toPandas()  # noqa: F841  read by name
    assert set(duckdb.sql(ORACLES["op11_collocations"]).fetchall()) == _brute(rows, 3, 10, 50, 2000)


def test_nothing(spark):
    ship_package(spark)
    docs = spark.createDataFrame(_texts(), SCHEMA)
    assert collocations.collocations(docs.limit(0)).count() == 0
    assert collocations.collocations(docs.filter("text is null")).count() == 0


def test_both_transforms_count_every_phrase():
    import numpy as np

    rnd = random.Random(5)
    symbols = np.array([rnd.choice([0, 1, 1, 2, 3, 7, 12]) for _ in range(400)])
    index = collocations.PhraseIndex(symbols, 4)
    want = Counter(tuple(symbols[i:i + 4].tolist()) for i in range(397) if (symbols[i:i + 4] > 0).all())
    for steps in (["right"] * 3, ["left"] * 3, ["right", "left", "right"], ["left", "right", "left"]):
        found = index.words()
        for step in steps:
            found = getattr(index, step)(found)
        assert {tuple(w): n for w, n in zip(found.words.tolist(), found.size.tolist())} == dict(want)
