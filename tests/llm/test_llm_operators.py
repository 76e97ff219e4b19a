"""Operators on small tables with awkward rows, against brute force."""

import base64
import hashlib
import random
import zlib

import duckdb
import numpy as np
import public_tokenizers
import pytest
import xxhash
from pyspark.sql import functions as F
from tokenizers import Tokenizer

import corpus_pipeline
from gleaner.llm import decontam, packing, pii, quality, simhash, substring, suffix, toxicity, warc
from gleaner.llm.components import components
from gleaner.llm.oracles import ORACLES
from gleaner.llm.queries import QUERIES
from gleaner.session import ship_package

# Extra columns have the names that operators give to columns of their own.
SCHEMA = "doc_id bigint, text string, lang string, source string, n_chars bigint, fp bigint, class string, spans string, row string, words string"


def _rows():
    rnd = random.Random(3)
    vocabulary = ["w%d" % i for i in range(300)] + ["été", "ñandú", "the", "of"]
    prose = lambda n: " ".join(rnd.choice(vocabulary) for _ in range(n))
    passage, base = prose(120), prose(400)
    words = base.split()
    rows = [(1, base), (2, base), (3, base), (3, base), (None, base), (4, None), (5, ""), (6, " \n\t "), (7, "a b"), (8, "a b"), (None, None),
            (9, prose(30) + " " + passage + " " + prose(30)), (10, passage + "\n" + prose(40)), (11, prose(200) + " " + passage),
            (12, "la " * 600), (13, "x" * 5000), (14, prose(20000)), (15, " ".join([*words[:200], "changed", *words[201:]])),
            (16, "one line of words here\n" * 40), (17, "mail a@b.cd card 4417123456789113 " + prose(40)), (18, "$$$ " * 50), (19, "THE OF " + prose(15).upper())]
    return [(i, t, "en", "s", len(t or ""), 1, "c", "s", "r", "w") for i, t in rows]


@pytest.fixture(scope="module")
def docs(spark):
    ship_package(spark)
    return spark.createDataFrame(_rows(), SCHEMA).repartition(3).cache()


@pytest.fixture(scope="module")
def nothing(docs):
    return docs.limit(0)


def _key(rows):
    return sorted(rows, key=str)


def test_quality(spark, docs, nothing):
    got = {(r.doc_id, r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words, r.base_failed) for r in quality.apply_policy(quality.ledger(docs), quality.STANDARD).collect()}
    want = set()
    for doc, text, *_ in _rows():
        words = [w.decode() for w in (text or "").encode().split()]
        windows = [tuple(words[i:i + 5]) for i in range(len(words) - 4)]
        count = {w: windows.count(w) for w in windows} if len(windows) < 1000 else {w: 1 for w in windows}
        covered = len({i + k for i, w in enumerate(windows) if count[w] > 1 for k in range(5)})
        lines = [x for x in (text or "").split("\n") if x.split()]
        want.add((doc, len(words), sum(map(len, words)), sum(c in "#*$%&|<>" for c in text or ""), len(lines) - len(set(lines)), covered, len(words) < 10 or 100 * covered > 20 * len(words)))
    assert got == want
    assert quality.ledger(nothing).count() == 0
    table = {r.rule: r for r in quality.ablate(quality.ledger(docs), quality.STANDARD).collect()}
    kept = lambda *rules: quality.apply_policy(quality.ledger(docs), quality.Policy(9, rules)).filter("kept").count()
    names = [r.name for r in quality.RULES]
    for name in ("few_words", "symbols", "repeated_windows"):
        assert table[name].n_sole == kept(*(n for n in names if n != name)) - kept(*names)
        assert table[name].n_failed == docs.count() - kept(name)


@pytest.mark.parametrize("hot", [2000, 1])
def test_word_substrings(docs, nothing, hot):
    rows = [(i, (t or "").encode().split()) for i, t, *_ in _rows()]
    first: dict = {}
    for doc, words in rows:
        for i in range(len(words) - 12) if doc is not None else ():
            w = tuple(words[i:i + 13])
            first[w] = min(doc, first.get(w, doc))
    want = []
    for doc, words in rows:
        gone = {i + k for i in range(len(words) - 12) if doc is not None and first[tuple(words[i:i + 13])] < doc for k in range(13)}
        want.append((doc, len(words), len(gone), b" ".join(w for i, w in enumerate(words) if i not in gone).decode()))
    got = [tuple(r) for r in substring.remove_repeats(docs, hot=hot, shard_words=500).collect()]
    assert _key(got) == _key(want)
    assert substring.remove_repeats(nothing).count() == 0


@pytest.mark.parametrize("hot", [2000, 1])
def test_byte_substrings(docs, nothing, hot):
    rows = [(i, (t or "").encode()) for i, t, *_ in _rows()]
    count: dict = {}
    for _, text in rows:
        for i in range(len(text) - 399):
            h = xxhash.xxh3_128_digest(text[i:i + 400])
            count[h] = count.get(h, 0) + 1
    want = []
    for doc, text in rows:
        gone = np.zeros(len(text), bool)
        for i in range(len(text) - 399):
            if count[xxhash.xxh3_128_digest(text[i:i + 400])] > 1:
                gone[i:i + 400] = True
        runs = int((np.diff(np.concatenate(([0], gone.astype(int)))) == 1).sum())
        want.append((doc, len(text), int(gone.sum()), runs, np.frombuffer(text, np.uint8)[~gone].tobytes()))
    got = [(r.doc_id, r.n_bytes, r.n_removed, r.n_spans, bytes(r.kept)) for r in suffix.remove_repeats(docs, hot=hot, shard_bytes=20_000, in_memory=100).collect()]
    assert _key(got) == _key(want)
    assert suffix.remove_repeats(nothing).count() == 0


def _components(prints):
    label = list(range(len(prints)))
    for _ in prints:
        for i, a in enumerate(prints):
            for j, b in enumerate(prints):
                if (a ^ b).bit_count() <= 3:
                    label[i] = label[j] = min(label[i], label[j])
    return label


def test_simhash(docs, nothing):
    rows = [(i, simhash.fingerprint((t or "").encode())) for i, t, *_ in _rows()]
    label = _components([p for _, p in rows])
    least = {k: min((i for (i, _), x in zip(rows, label) if x == k and i is not None), default=None) for k in label}
    want = [(i, f"{p:016x}", least[k]) for (i, p), k in zip(rows, label)]
    got = simhash.near_duplicates(docs).select("doc_id", simhash.hex_digits("fp").alias("f"), "component_id")
    assert _key(tuple(r) for r in got.collect()) == _key(want)
    assert simhash.near_duplicates(nothing).count() == 0
    kept = simhash.one_of_each(docs)
    assert kept.columns == docs.columns and kept.count() == len(set(label))


def test_links_of_many_close_fingerprints(spark, docs):
    rnd = random.Random(4)
    values = {0}
    while len(values) < 300:  # a chain of small steps, and blocks far smaller than its lists
        x = rnd.choice(list(values))
        for _ in range(rnd.randint(1, 3)):
            x ^= 1 << rnd.randrange(64)
        values.add(x)
    values |= {rnd.getrandbits(64) for _ in range(100)}
    values = sorted(values)
    frame = spark.createDataFrame([(v - (1 << 64) if v >> 63 else v,) for v in values], "fp bigint")
    label = _components(values)
    for block in (4096, 7):
        got = {r.node % (1 << 64): r.root for r in components(simhash.links(frame, block=block)).collect()}
        groups: dict = {}
        for v, k in zip(values, label):
            groups.setdefault(k, set()).add(got.get(v, v))
        assert all(len(roots) == 1 for roots in groups.values())
        assert len({next(iter(r)) for r in groups.values()}) == len(groups)


def test_packing(docs, nothing):
    path = public_tokenizers.path("word_bpe_49k.json")
    tokenizer = Tokenizer.from_file(path)
    for split in (True, False):
        pieces = packing.pack(docs, path, split=split, group_tokens=9000).collect()
        held: dict = {}
        for r in pieces:
            assert len(r.ids) == 4 * r.length <= 4 * 2048
            held.setdefault(r.sequence_id, []).append((r.offset, r.length))
        for parts in held.values():
            at = 0
            for offset, length in sorted(parts):
                assert offset == at
                at += length
            assert at <= 2048
        want = [(i, [*tokenizer.encode(t or "", add_special_tokens=False).ids, 1]) for i, t, *_ in _rows()]
        joined: dict = {}
        for r in sorted(pieces, key=lambda r: r.start):
            if r.start == 0 or (r.doc_id, r.doc_tokens) not in joined:
                joined.setdefault((r.doc_id, r.doc_tokens), []).append(b"")
        for i, ids in want:
            cut = [r for r in pieces if r.doc_id == i and r.doc_tokens == len(ids)]
            assert sum(r.length for r in cut) % len(ids) == 0
            for r in cut:
                assert np.frombuffer(r.ids, "<u4").tolist() == ids[r.start:r.start + r.length]
    assert packing.pack(nothing, path).count() == 0


def test_warc(spark, tmp_path):
    ship_package(spark)
    rows = [(1, "http://a/", "same", "x"), (2, None, "same", "x"), (2, "u", "same", "x"), (3, "u\r\nv", None, "x"), (4, "u", "", "x"), (None, "u", "same", "x"),
            (None, "u", "lonely", "x"), (None, "u", "lonely", "x"), (5, "u", "é" * 300_000, "x")]
    pages = spark.createDataFrame(rows, "page_id bigint, url string, html string, digest string").repartition(3)
    got = warc.round_trip(pages, str(tmp_path / "w"), frame_bytes=1000, bundle_bytes=2000).collect()
    sha = lambda t: base64.b32encode(hashlib.sha1((t or "").encode()).digest()).decode()
    first = {"same": 1, "": 3, "é" * 300_000: 5, "lonely": None}
    want = [(i, len((h or "").encode()), sha(h), "response" if first[h or ""] in (None, i) else "revisit", None if first[h or ""] in (None, i) else first[h or ""]) for i, _, h, _ in rows]
    assert _key(tuple(r) for r in got) == _key(want)
    small = warc.round_trip(pages.filter("page_id is not null"), str(tmp_path / "v"), min_bytes=5)
    assert {r.record_type for r in small.collect()} == {"response"}
    archive = warc.write_archive(pages.filter("page_id is not null").dropDuplicates(["page_id"]), str(tmp_path / "u"), frame_bytes=100)
    asked = spark.createDataFrame([("5",), ("1",), ("77",)], "record_id string")
    assert {(r.record_id, r.payload_bytes) for r in warc.fetch(archive, asked).collect()} == {("5", 600_000), ("1", 4)}
    assert warc.round_trip(pages.limit(0), str(tmp_path / "t")).count() == 0


def test_toxicity(spark, docs, nothing):
    rnd = random.Random(8)
    rows, labels = [], []
    for i in range(1500):
        words = ["".join(rnd.choice(["ta", "no", "li", "re", "su"]) for _ in range(rnd.randint(1, 4))) for _ in range(80)]
        bad = i % 6 == 0
        if bad:
            words[rnd.randrange(80)] = rnd.choice(["Moron!", "idiot", "worthless"])
        rows.append((i, " ".join(words)))
        labels.append((i, int(bad)))
    frame = spark.createDataFrame(rows, "doc_id bigint, text string").repartition(3)
    got = {r.doc_id: r for r in toxicity.score(frame, spark.createDataFrame([*labels, (None, 1), (3, None)], "doc_id bigint, toxic int")).collect()}
    assert all(got[i].held_out == (zlib.crc32(str(i).encode()) % 4 == 2) for i in range(1500))
    held = [i for i in range(1500) if got[i].held_out]
    right = sum(got[i].predicted == labels[i][1] for i in held)
    assert right / len(held) > 0.95 and all(0 <= r.score <= 1 for r in got.values())
    none = spark.createDataFrame([], "doc_id bigint, toxic int")
    rows = toxicity.score(docs, none).collect()
    assert len(rows) == docs.count() and {r.score for r in rows} == {0.0}
    assert toxicity.score(nothing, none).count() == 0


def test_contained_items(spark, docs, nothing):
    rows = _rows()
    passage = rows[11][1].split()[40:70]
    near = [*passage[:28], "other", "end"]
    items = [(1, " ".join(passage)), (2, " ".join(near)), (3, "a b"), (4, None), (5, ""), (6, " ".join(passage).upper()), (7, " ".join(f"z{i}" for i in range(20))), (1, " ".join(passage))]
    frame = spark.createDataFrame([(i, t, 1, "x") for i, t in items], "item_id bigint, text string, doc_id int, shingle string")
    got = {(r.doc_id, r.item_id): (r.n_shared, r.n_item) for r in decontam.contained_items(docs, frame).collect()}

    def shingles(text):
        words = [w.decode().lower() for w in (text or "").encode().split()]
        return {tuple(words[i:i + 5]) for i in range(max(1, len(words) - 4))} if words else set()

    want = {}
    for item, text in items:
        for doc in {r[0] for r in rows}:
            have = set().union(*(shingles(t) for i, t, *_ in rows if i == doc))
            inside = len(shingles(text) & have)
            if shingles(text) and 100 * inside >= 80 * len(shingles(text)):
                want[doc, item] = (inside, len(shingles(text)))
    assert got == want and (9, 1) in got and (7, 3) in got
    assert decontam.contained_items(nothing, frame).count() == 0 and decontam.contained_items(docs, frame.limit(0)).count() == 0
    plan = decontam.shingles(docs, "doc_id", "text", "doc_id")._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Arrow" not in plan


def test_personal_data(docs, nothing):
    got = _key((r.doc_id, tuple((s.kind, s.start, s.end) for s in r.spans)) for r in pii.find_personal_data(docs).collect())
    assert got == _key((i, tuple((s["kind"], s["start"], s["end"]) for s in pii.find(t or ""))) for i, t, *_ in _rows())
    clean = pii.redact(docs)
    assert clean.columns == docs.columns and clean.filter("doc_id = 17 and text like '%[EMAIL] card [CARD]%'").count() == 1
    assert clean.filter("doc_id = 4 and text is null").count() == 1
    assert pii.find_personal_data(nothing).count() == 0 and pii.redact(nothing).count() == 0


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_statements(spark, sf_dir, name):
    con = duckdb.connect()
    for table in ("documents", "benchmark"):
        con.execute(f"CREATE VIEW {table} AS SELECT * FROM '{sf_dir}/{table}.parquet'")
    want = con.execute(ORACLES[name]).df()
    got = QUERIES[name](spark, sf_dir).toPandas()
    rows = lambda df: sorted(tuple(str(None if v != v else v) for v in row) for row in df[sorted(df.columns)].itertuples(index=False))
    assert len(got) and rows(got) == rows(want)


def test_pipeline(spark, sf_dir, docs, tmp_path):
    items = [r["text"] for r in spark.read.parquet(f"{sf_dir}/benchmark.parquet").collect()]
    folder = tmp_path / "tables"
    rows = [*_rows(), (50, "start " + items[0] + " end of the text with more words", "en", "s", 1, 1, "c", "s", "r", "w")]
    spark.createDataFrame(rows, SCHEMA).write.parquet(str(folder / "documents.parquet"))
    spark.read.parquet(f"{sf_dir}/benchmark.parquet").write.parquet(str(folder / "benchmark.parquet"))
    table = spark.read.parquet(str(folder / "documents.parquet"))
    for _, stage in corpus_pipeline.STAGES[:-1]:
        assert stage(spark, table, str(folder)).columns == table.columns
        assert stage(spark, table.limit(0), str(folder)).count() == 0
    got = corpus_pipeline.run(spark, str(folder))
    kept = {r.doc_id for r in got.select("doc_id").distinct().collect()}
    ledger = {r.doc_id for r in quality.apply_policy(quality.ledger(table), quality.STANDARD).filter("kept").collect()}
    near = {}
    for i, t, *_ in rows:
        if i in ledger:
            near.setdefault(simhash.fingerprint((t or "").encode()), set()).add(i)
    assert 50 in ledger and 50 not in kept and kept <= ledger and {1, 9, 10, 11, 14, 17} - {2, 3} <= kept and not {2, 3, None} & kept
    assert got.columns == ["doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset"]
    assert got.filter(F.col("offset") + F.col("length") > 2048).count() == 0
