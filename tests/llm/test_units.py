"""Parts of the operators against plain versions, without Spark."""

import random

import numpy as np
import pytest
import zstandard

from gleaner.llm import induced, packing, pii, simhash, substring, suffix, toxicity, warc
from gleaner.llm.anchors import merged, minimizers


@pytest.fixture()
def rnd():
    return random.Random(5)


def test_suffix_array(rnd):
    for _ in range(200):
        docs = [bytes(rnd.choice(b"abc"[:rnd.randint(1, 3)]) for _ in range(rnd.randint(1, 30))) for _ in range(rnd.randint(1, 6))]
        text = np.frombuffer(b"\xff".join(docs) + b"\xff", np.uint8) + np.uint8(1)
        ends = [i for i, x in enumerate(text) if x == 0]
        key = [ends.index(i) if x == 0 else len(ends) + int(x) for i, x in enumerate(text)]
        want = sorted(range(len(text)), key=lambda i: key[i:])
        assert induced.suffix_array(text, in_memory=rnd.choice([3, 1 << 20])).tolist() == want  # 3: nearly all on disk


def test_byte_shard(rnd):
    for _ in range(100):
        contexts = list(dict.fromkeys(bytes(rnd.choice(b"ab") for _ in range(rnd.randint(8, 30))) for _ in range(4)))
        twice = np.array([rnd.random() < 0.2 for _ in contexts])
        got = suffix.sort_shard(contexts, np.arange(len(contexts)), np.zeros(len(contexts), np.int64), twice, 8)
        windows = [[c[i:i + 8] for i in range(len(c) - 7)] for c in contexts]
        count = {}
        for ws, t in zip(windows, twice):
            for w in ws:
                count[w] = count.get(w, 0) + 1 + int(t)
        for c, ws, (a, b) in zip(contexts, windows, got):
            want = {i + k for i, w in enumerate(ws) if count[w] > 1 for k in range(8)}
            assert {k for x, y in zip(a, b) for k in range(x, y)} == want


def test_overlapping_contexts_of_one_place_are_no_repeat(rnd):
    text = bytes(rnd.choice(b"abcdefgh") for _ in range(60))
    got = suffix.sort_shard([text[:40], text[10:]], np.array([0, 0]), np.array([0, 10]), np.array([False, False]), 8)
    assert all(len(a) == 0 for a, _ in got)


def test_fm_shard(rnd):
    for _ in range(100):
        contexts = []
        for _ in range(6):
            n = rnd.randint(5, 8)
            contexts.append((b" ".join(rnd.choice([b"a", b"b", b"c"]) for _ in range(n)), rnd.randint(0, min(3, n - 2)), rnd.randint(0, 4)))
        windows = lambda text: [tuple(text.split()[i:i + 5]) for i in range(len(text.split()) - 4)]
        for (text, left, doc), hits in zip(contexts, substring.search_shard(contexts, 5, 2)):
            for i, w in enumerate(windows(text)[:left + 1]):
                assert hits[i] == any(d < doc and w in windows(t) for t, _, d in contexts)


def test_anchors_are_shared_by_equal_stretches(rnd):
    grams = np.array([rnd.randrange(1, 50) for _ in range(300)], np.uint64)
    at = set(minimizers(grams, 7).tolist())
    assert all(at & set(range(i, i + 7)) for i in range(294))
    assert len(minimizers(grams[:6], 7)) == 0
    a, b = merged(np.array([5, 0, 3]), np.array([9, 3, 4]))
    assert list(zip(a, b)) == [(0, 4), (5, 9)]


def test_positions_of_the_simhash_index():
    from itertools import combinations
    assert len(simhash.PLACES) == 14
    for bad in combinations(range(8), 3):
        assert any(not set(bad) & set(places) for places in simhash.PLACES)


def test_fingerprint():
    assert simhash.fingerprint(b"") == simhash.fingerprint(b" \n\t") == 0
    one = simhash.xxhash.xxh64_intdigest(b"a b", 42)
    assert simhash.fingerprint(b"A \n b") == one  # fewer words than a shingle: the whole sequence
    hashes = [simhash.xxhash.xxh64_intdigest(x, 42) for x in (b"a b c", b"b c d", b"c d c")]
    want = sum(1 << k for k in range(64) if sum(h >> k & 1 for h in hashes) > 1.5)
    assert simhash.fingerprint(b"a b c d c") == want


def test_best_fit_decreasing(rnd):
    for _ in range(100):
        lengths = [rnd.randint(1, 64) for _ in range(rnd.randint(0, 60))]
        sequences, offsets, n = packing.best_fit_decreasing(lengths, 64)
        room: list[int] = []
        for size in sorted(lengths, reverse=True):
            fit = [(c, j) for j, c in enumerate(room) if c >= size]
            if fit:
                room[min(fit)[1]] -= size
            else:
                room.append(64 - size)
        assert n == len(room)
        held: dict[int, list] = {}
        for s, o, size in zip(sequences, offsets, lengths):
            held.setdefault(s, []).append((o, size))
        for parts in held.values():
            at = 0
            for o, size in sorted(parts):
                assert o == at
                at += size
            assert at <= 64


def test_personal_data():
    text = "Mail a@b.c.d@e.f or x.y@h-1.org; ip 1.2.3.4.5.6.7.8 and 256.1.1.1, card 4417 1234 5678 9113, call +1 (212) 555-0100. IBAN GB82 WEST 1234 5698 7654 32 OK token = \"9233A8ECF7C5B09FE5949719\""
    found = [(s["kind"], text[s["start"]:s["end"]]) for s in pii.find(text)]
    assert found == [("email", "a@b.c.d"), ("email", "x.y@h-1.org"), ("ip", "1.2.3.4"), ("ip", "5.6.7.8"), ("card", "4417 1234 5678 9113"),
                     ("phone", "+1 (212) 555-0100"), ("iban", "GB82 WEST 1234 5698 7654 32"), ("secret", "9233A8ECF7C5B09FE5949719")]
    assert pii.redacted("é a@b.cd!", pii.find("é a@b.cd!")) == "é [EMAIL]!"
    assert pii.luhn("4417123456789113") and not pii.luhn("4417123456789114")
    for long in ("a" * 300_000, "1." * 150_000, "9" * 300_000, "+1" * 150_000, "a@" * 150_000):
        pii.find(long)  # linear, else this would not end


def test_personal_data_like_the_patterns(rnd):
    import re
    email = re.compile(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+")
    ip = re.compile(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)")
    for _ in range(2000):
        text = "".join(rnd.choice("a1.@_-2 ") for _ in range(30))
        assert list(pii.emails(text)) == [m.span() for m in email.finditer(text)]
        assert list(pii.addresses(text)) == [m.span() for m in ip.finditer(text) if all(int(p) <= 255 for p in m.group().split("."))]


def test_bundle(tmp_path):
    bundle = warc.Bundle(str(tmp_path))
    raws = [b"".join(warc.record(f"{k}{i}", "http://x/ y", b"abc\r\n\r\n" * i, None if i % 2 else "7") for i in range(5)) for k in range(3)]
    for raw in raws:
        bundle.add(raw)
    bundle.close()
    data = open(bundle.name, "rb").read()
    for (at, size, length), raw in zip(warc.seek_table(bundle.name), raws):
        assert zstandard.ZstdDecompressor().decompress(data[at:at + size]) == raw and length == len(raw)
    whole = zstandard.ZstdDecompressor().stream_reader(data, read_across_frames=True).read()
    assert whole == b"".join(raws)  # any reader of the format reads it through
    one, after = warc.parse(raws[0])
    assert one["record_type"] == "revisit" and one["refers_to"] == "7"
    two, _ = warc.parse(raws[0], after)
    assert two["record_id"] == "01" and two["payload"] == b"abc\r\n\r\n"


def test_cells_tell_words_of_a_dictionary():
    cells = toxicity.Cells(b" moron idiot ", b" friendly people other words ")
    assert cells.of(b"idiot, people 12 a") == [cells.work_out(b"idiot")] and cells.work_out(b"people") is None


def test_remembered_pieces_are_bounded_in_bytes():
    memory = packing.Remembered(100_000)
    for k in range(200):
        words = {b"%d.%d" % (k, i) for i in range(50)} | {b"often"}
        new = memory.missing(words)
        assert set(new) == words - {b"often"} or not k
        memory.add({w: bytes(8) for w in new})
        assert words <= set(memory.young)
        held = [memory.young, memory.old]
        assert sum(len(w) + len(v) + packing.ENTRY for d in held for w, v in d.items()) < 3 * 100_000
    memory.add({bytes(1_000_000): bytes(4)})
    assert memory.missing({b"often"}) == [b"often"] and not memory.young and not memory.old


def test_old_pieces_are_looked_up_and_not_gone_through():
    class Counted(dict):
        def __iter__(self):
            raise AssertionError("every batch goes through all that is remembered")

    memory = packing.Remembered()
    memory.old = Counted({b"%d" % i: bytes(4) for i in range(1000)})
    assert memory.missing({b"7", b"new"}) == [b"new"] and memory.young == {b"7": bytes(4)}


def test_words_encoded_in_one_go_are_as_each_by_itself():
    import public_tokenizers
    from tokenizers import Tokenizer

    path = public_tokenizers.path("word_bpe_49k.json")
    tokenizer = Tokenizer.from_file(path)
    rnd = random.Random(12)
    marks = ["'s", "'S", "'ll", "'", "\"", ".", ",", "&&&", "(", "12", "7", "a", "Bc", "don't", "É", "é", "≠", "ñ", "Σ", "ς", "İ", "<|endoftext|>", "<|", "x", "‍", "日本", "\x00", "\x1c", "_", "-", "½"]
    words = ["".join(rnd.choice(marks) for _ in range(rnd.randrange(1, 7))) for _ in range(4000)]
    texts = [" ".join(words[i:i + 20]).encode() for i in range(0, 4000, 20)]
    encode = packing._encoder(path, True)
    for text, got in zip(texts, encode(texts)):
        assert np.frombuffer(got, "<u4").tolist() == tokenizer.encode(text.decode(), add_special_tokens=False).ids
