"""A common anchor whose different contexts are more than a shard."""

import random

from pyspark.sql import functions as F

from gleaner.llm import substring, suffix
from gleaner.session import ship_package


def test_no_task_searches_a_group_larger_than_a_shard(spark):
    ship_package(spark)
    rnd = random.Random(6)
    length, gram, limit = 40, 8, 5_000
    side = length - gram
    rows, texts = [], []
    passage = rnd.randbytes(60).hex().encode()
    at = len(passage) // 2  # of the anchor; a context holds every string that holds the anchor, and no other
    for k in range(200):  # edited copies: most differ, and each shares most with the others
        edit = rnd.choice([rnd.randrange(at - side, at - 3), rnd.randrange(at + gram, at + length - 3)])
        text = passage[:edit] + b"%03d" % k + passage[edit + 3:]
        texts.append(text)
        rows.append((1, suffix._digest(text[at - side:at + length], side), b"class%03d" % k, at - side, side, False, text[at - side:at + length]))
    frame = spark.createDataFrame(rows, suffix.CONTEXT)
    inner = suffix._search(length, limit, 1 << 20)

    def search(batches):
        held = {}

        def seen():
            for batch in batches:
                for h, content in zip(batch.column(0).to_pylist(), batch.column(6).to_pylist()):
                    held[h] = held.get(h, 0) + len(content)
                    assert held[h] <= limit, "one group is in one task"
                yield batch

        yield from inner(seen())

    got = {}
    for r in suffix._common_spans(frame, search, length, limit).collect():
        got.setdefault(bytes(r["class"]), set()).update(range(r.first, r.end))
    count = {}
    around = range(at - side, at + 1)
    for t in texts:
        for i in around:
            count[t[i:i + length]] = count.get(t[i:i + length], 0) + 1
    for k, t in enumerate(texts):
        want = {i + j for i in around if count[t[i:i + length]] > 1 for j in range(length)}
        assert got.get(b"class%03d" % k, set()) == want


def test_a_place_has_a_row_for_many_windows(spark):
    """Windows of a common passage that overlap are one span before the places of its context are joined."""
    ship_package(spark)
    rnd = random.Random(7)
    length, gram, limit = 40, 8, 1_000
    side = length - gram
    rows = []
    for k in range(60):
        head, tail = (rnd.randbytes(8).hex().encode() for _ in range(2))
        context = head[:4] + b"a common passage, the same in all of them, and a little more." + tail[:3]
        rows += [(1, suffix._digest(context, side), b"class%03d-%d" % (k, copy), 100, side, False, context) for copy in range(4)]
    frame = spark.createDataFrame(rows, suffix.CONTEXT)
    found = suffix._common_spans(frame, suffix._search(length, limit, 1 << 20), length, limit).collect()
    assert {bytes(r["class"]) for r in found} == {r[2] for r in rows} and len(found) == len(rows)
    assert {(r["first"], r["end"]) for r in found} == {(100, 100 + len(rows[0][6]))}


def test_places_are_joined_with_one_span_a_context(spark):
    """Nothing is taken apart after the places are joined, so rows are places, however many windows a context has."""
    ship_package(spark)
    rnd = random.Random(8)
    length, gram = 40, 8
    side = length - gram
    rows = []
    for k in range(40):
        context = rnd.randbytes(2 + k % 7).hex().encode() + b"what a crowd of others has, and again the same, and more of it, and"
        context = context[-side - length:]
        rows += [(1, suffix._digest(context, side), b"class%03d-%d" % (k, copy), 7 * copy, side, copy == 2, context) for copy in range(3)]
    found = suffix._common_spans(spark.createDataFrame(rows, suffix.CONTEXT), suffix._search(length, 1_000, 1 << 20), length, 1_000)
    assert "Generate" not in found._jdf.queryExecution().optimizedPlan().toString()
    assert sorted((bytes(r["class"]), r["first"], r["end"]) for r in found.distinct().collect()) == sorted((r[2], r[3], r[3] + len(r[6])) for r in rows)


def _one_passage(spark, parts):
    """Three texts around one passage, as ``repeated_spans`` takes them."""
    texts = [(k, " ".join([f"{k}.{i}" for i in range(3)] + parts + [f"{k}/{i}" for i in range(3)])) for k in range(3)]
    docs = spark.createDataFrame(texts, "doc_id long, text string")
    return docs.withColumns({"class": F.unhex(F.sha2("text", 256)), "tag": F.xxhash64("text")})


def test_byte_spans_that_are_sent_do_not_overlap(spark):
    ship_package(spark)
    rnd = random.Random(31)
    found = suffix.repeated_spans(_one_passage(spark, [rnd.randbytes(8).hex() for _ in range(300)])).collect()
    assert [len(r["spans"]) for r in found] == [1, 1, 1]
    assert {r["spans"][0]["end"] - r["spans"][0]["first"] for r in found} == {300 * 17 + 3}  # the passage, three bytes before it and one after


def test_word_spans_that_are_sent_do_not_overlap(spark):
    ship_package(spark)
    rnd = random.Random(32)
    found = substring.repeated_spans(_one_passage(spark, [rnd.randbytes(8).hex() for _ in range(300)])).collect()
    assert sorted((r["doc_id"], [tuple(s) for s in r["spans"]]) for r in found) == [(1, [(3, 303)]), (2, [(3, 303)])]
