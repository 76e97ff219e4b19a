"""Phrase collocations: word sequences that stand together more often than their parts would.

Texts are made shards of numbered words of one language, once, which are stored. A shard is indexed by the Burrows-Wheeler
transforms of its sequence and of the reverse, in wavelet matrices, sorted as deep as the longest phrase. Extending intervals
step by step, to the right and to the left, enumerates its n-grams with their counts, which are summed over all shards.

A phrase can be frequent only if its first and its last part of one word less are. So words are counted first; then, length by
length, phrases whose parts passed are counted by a part of their hash, and what reaches the minimum passes; last, phrases
that passed are counted as they are. What passed goes to the tasks as a bitmap of at most
16 MB. Equal hashes, or a bitmap too small, let more phrases through and lose none.

Words are what lies between blanks and tabs; phrases never go over one of ``BREAKS``. Everything is counted per language.

Defined results: null and empty texts have no words; a null language is ``und``; rows that repeat an id are counted each; an
empty table gives an empty table. A word or text of any length is read whole: shards overlap by one word less than the
length counted, so nothing is lost or counted twice where they meet. Other columns are not read.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import cached_property

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from gleaner.llm.anchors import mixed
from gleaner.llm.bitmap import MOST_BITS, BitMap, bit_map
from gleaner.llm.common import as_bytes, pieces, stored
from gleaner.llm.fm_index import Bits

#: Characters that end a piece of text.
BREAKS = b".,;:!?\n\x0b\x0c\r"
LONGEST = 3
LEAST = 10
COVERED = 50
TOP = 2000
SHARD_WORDS = 1_000_000
#: Words whose phrases are enumerated at once.
STEP = 20_000
#: Bytes of text that are made words at once.
SLICE = 1 << 20

COUNTS = "lang string, phrase string, n bigint"
SHARD = "lang string, overlap int, symbols binary, words binary"
#: Bits of a phrase's hash that it is counted by before it is counted as it is.
CELL_BITS = 31
_PLAIN = bytes(10 if c in BREAKS else 32 if c == 9 else c + 32 if 65 <= c <= 90 else c for c in range(256))


def _slices(text: bytes, limit: int) -> Iterator[bytes]:
    """A text in lower case with breaks as line ends and tabs as blanks, in parts that are cut at blanks."""
    text, start = text.translate(_PLAIN), 0
    while start < len(text):
        end = text.find(b" ", start + limit)
        end = len(text) if end < 0 else end
        yield text[start:end]
        start = end


def word_hash(lang: bytes, word: bytes) -> int:
    return xxhash.xxh3_64_intdigest(lang + b"\0" + word)


def phrase_hash(words: list[np.ndarray]) -> np.ndarray:
    """Of each phrase, from the hashes of its first words, its second words and so on."""
    out = np.zeros(len(words[0]), np.uint64)
    for h in words:
        out = mixed(out * np.uint64(0xD1342543DE82EF95) + h)
    return out


def _hashes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        langs, found = as_bytes(batch.column(0)).to_pylist(), as_bytes(batch.column(1)).to_pylist()
        split = [[word_hash(lang, w) for w in phrase.split(b" ")] for lang, phrase in zip(langs, found)]
        if split:
            h = phrase_hash([np.array(h, np.uint64) for h in zip(*split)])
            yield pa.RecordBatch.from_arrays([pa.array(h.view(np.int64))], names=["h"])


class Wavelet:
    """A wavelet matrix over symbols 0 to ``top`` that tells which symbols stand in a range, how often, and how often before it."""

    def __init__(self, symbols: np.ndarray, top: int):
        self.levels = []
        starts, every = np.zeros(top + 1, np.int64), np.arange(top + 1)
        for level in range(max(1, int(top).bit_length()) - 1, -1, -1):
            bits = (symbols >> level & 1).astype(np.uint8)
            self.levels.append(rank := Bits(bits))
            ones = rank.ones(starts).astype(np.int64)
            starts = np.where(every >> level & 1, rank.zeros + ones, starts - ones)
            symbols = np.concatenate((symbols[bits == 0], symbols[bits == 1]))
        self.starts = starts

    def within(self, low: np.ndarray, high: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """For ranges, in order of range and symbol: the range's number, a symbol in it, its count before the range, and in it."""
        node, symbol = np.arange(len(low)), np.zeros(len(low), np.int64)
        for rank in self.levels:
            ones_low, ones_high = rank.ones(low).astype(np.int64), rank.ones(high).astype(np.int64)
            low = np.stack((low - ones_low, rank.zeros + ones_low), 1).ravel()
            high = np.stack((high - ones_high, rank.zeros + ones_high), 1).ravel()
            some = np.flatnonzero(high > low)
            low, high, node, symbol = low[some], high[some], node[some >> 1], 2 * symbol[some >> 1] + (some & 1)
        return node, symbol, low - self.starts[symbol], high - low


def _order(symbols: np.ndarray, depth: int, top: int) -> np.ndarray:
    """Places of a ring of symbols in the order of the ``depth`` symbols from there on."""
    key, size = symbols.astype(np.int64), top + 1
    for d in range(1, depth):
        if size * (top + 1) >= 1 << 62:
            values, key = np.unique(key, return_inverse=True)
            size = len(values)
        key, size = key * (top + 1) + np.roll(symbols, -d), size * (top + 1)
    return np.argsort(key)


class Phrases:
    """Phrases of one length (a row of symbols each) with their intervals in both transforms; ``size`` is the count."""

    def __init__(self, words: np.ndarray, low: np.ndarray, reverse: np.ndarray, size: np.ndarray):
        self.words, self.low, self.reverse, self.size = words, low, reverse, size

    def where(self, rows: np.ndarray) -> Phrases:
        return Phrases(self.words[rows], self.low[rows], self.reverse[rows], self.size[rows])


class PhraseIndex:
    """Both transforms of a shard, each made when it is first asked. Symbol 0 is a break; phrases hold none. Right for phrases
    of up to ``depth`` words."""

    def __init__(self, symbols: np.ndarray, depth: int):
        self.symbols, self.depth = np.append(symbols, 0).astype(np.int32), depth  # the ring is closed by a break
        self.top = int(self.symbols.max())
        self.counts = np.bincount(self.symbols, minlength=self.top + 1)
        self.first = np.concatenate(([0], np.cumsum(self.counts)))[:-1]

    @cached_property
    def forward(self) -> Wavelet:
        return Wavelet(self.symbols[_order(self.symbols, self.depth, self.top) - 1], self.top)

    @cached_property
    def backward(self) -> Wavelet:
        back = self.symbols[::-1]
        return Wavelet(back[_order(back, self.depth, self.top) - 1], self.top)

    def words(self) -> Phrases:
        present = np.flatnonzero(self.counts[1:]) + 1
        return Phrases(present[:, None], self.first[present], self.first[present], self.counts[present])

    def _extended(self, transform: Wavelet, low: np.ndarray, other: np.ndarray, size: np.ndarray) -> tuple[np.ndarray, ...]:
        node, symbol, before, count = transform.within(low, low + size)
        smaller = np.cumsum(count) - count
        smaller -= smaller[np.searchsorted(node, np.arange(len(low)))][node]  # within the phrase; every phrase has an extension
        inside = np.flatnonzero(symbol)
        node, symbol = node[inside], symbol[inside]
        return node, symbol, self.first[symbol] + before[inside], other[node] + smaller[inside], count[inside]

    def left(self, p: Phrases) -> Phrases:
        """The phrases with every word that stands before them."""
        node, symbol, low, reverse, size = self._extended(self.forward, p.low, p.reverse, p.size)
        return Phrases(np.column_stack((symbol, p.words[node])), low, reverse, size)

    def right(self, p: Phrases) -> Phrases:
        node, symbol, reverse, low, size = self._extended(self.backward, p.reverse, p.low, p.size)
        return Phrases(np.column_stack((p.words[node], symbol)), low, reverse, size)


class _Shard:
    """Words of one language, numbered from 1 as they come; 0 is a break."""

    def __init__(self, before: list[bytes]):
        self.words, self.known = [b""], {b"\n": 0, b"": -1}
        self.parts, self.size, self.overlap = [], 0, len(before)
        self.add(before)

    def add(self, tokens: list[bytes]) -> None:
        new = set(tokens).difference(self.known)
        self.known.update(zip(new, range(len(self.words), len(self.words) + len(new))))
        self.words += new
        symbols = np.fromiter(map(self.known.__getitem__, tokens), np.int32, len(tokens))
        self.parts.append(symbols[symbols >= 0])
        self.size += len(self.parts[-1])

    def last(self, count: int) -> list[bytes]:
        found: list[int] = []
        for part in reversed(self.parts):
            if len(found) >= count:
                break
            found = part[-(count - len(found)):].tolist() + found
        return [self.words[i] if i else b"\n" for i in found]

    def row(self, lang: str) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays(
            [pa.array([lang]), pa.array([self.overlap], pa.int32()), pa.array([np.concatenate(self.parts).astype("<i4").tobytes()], pa.binary()),
             pa.array([b" ".join(self.words[1:])], pa.binary())], names=["lang", "overlap", "symbols", "words"])


def _shards(longest: int, shard_words: int, slice_bytes: int):
    """Shards of a task's ``(lang, text)``. One that begins within a text overlaps with the one before by ``longest - 1`` words."""
    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[str, _Shard] = {}
        for batch in pieces(batches, "text"):
            texts: dict[str, list[bytes]] = {}
            for lang, text in zip(batch.column(0).to_pylist(), as_bytes(batch.column(1)).to_pylist()):
                texts.setdefault(lang, []).append(text)
            for lang, of_lang in texts.items():
                for n, part in enumerate(_slices(b"\n".join(of_lang), slice_bytes)):
                    if sum(shard.size for shard in held.values()) >= shard_words:
                        before = held[lang].last(longest - 1) if n and lang in held else []
                        yield from (shard.row(name) for name, shard in held.items() if shard.size)
                        held = {lang: _Shard(before)}
                    shard = held.get(lang)
                    if shard is None:
                        shard = held[lang] = _Shard([])
                    shard.add(part.replace(b"\n", b" \n ").split(b" "))
                if lang in held:
                    held[lang].add([b"\n"])
        yield from (shard.row(name) for name, shard in held.items() if shard.size)

    return task


def _phrases(index: PhraseIndex, found: Phrases, width: int, hashes: np.ndarray, parts: list[BitMap]) -> Iterator[Phrases]:
    """The phrases of 2 to ``width`` words grown from some words, to the right and to the left by turns: those whose parts of
    2 and more words passed, as ``parts`` has them by length."""
    def passed(p: Phrases, size: int) -> Phrases:
        if size - 2 < len(parts):
            p = p.where(np.flatnonzero(parts[size - 2].has(phrase_hash([hashes[p.words[:, c]] for c in range(size)]))))
        elif size > 2:  # its parts must have passed
            for columns in (range(size - 1), range(1, size)):
                p = p.where(np.flatnonzero(parts[size - 3].has(phrase_hash([hashes[p.words[:, c]] for c in columns]))))
        return p

    for size in range(2, width + 1):
        if not len(found.size):
            return
        found = passed(index.left(found) if size % 2 else index.right(found), size)
        yield found


def _indexed(batches: Iterator[pa.RecordBatch], words_passed, width: int):
    """``(lang, words, hashes, symbols, overlap)`` of each shard, in which words that did not pass are breaks. The overlap is what
    phrases of ``width`` words need."""
    passed: BitMap | None = words_passed and words_passed.value
    for batch in batches:
        for lang, overlap, symbols, words in zip(*(column for column in batch.columns)):
            lang, names = lang.as_py(), [b"", *words.as_py().split(b" ")]
            shared = min(overlap.as_py(), width - 1)
            symbols = np.frombuffer(symbols.as_buffer(), "<i4")[overlap.as_py() - shared:]
            hashes = np.fromiter((word_hash(lang.encode(), w) for w in names), np.uint64, len(names))
            if passed is not None:
                keep = passed.has(phrase_hash([hashes]))
                keep[0] = False
                number = np.where(keep, np.cumsum(keep), 0).astype(np.int32)
                chosen = np.concatenate(([0], np.flatnonzero(keep)))
                symbols, hashes, names = number[symbols], hashes[chosen], [names[i] for i in chosen.tolist()]
            yield lang, names, hashes, symbols, shared


def _words(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Counts of the words of each shard."""
    for lang, names, _, symbols, _ in _indexed(batches, None, 1):
        counts = np.bincount(symbols, minlength=len(names))
        some = np.flatnonzero(counts[1:]) + 1
        for at in range(0, len(some), 50_000):
            part = some[at:at + 50_000]
            yield pa.RecordBatch.from_arrays([pa.array([lang] * len(part)), pa.array([names[i].decode() for i in part.tolist()], pa.string()), pa.array(counts[part], pa.int64())],
                                             names=["lang", "phrase", "n"])


def _cells(words_passed, parts_passed: list, width: int):
    """Counts of phrases of ``width`` words by their hash."""
    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        parts = [p.value for p in parts_passed]
        for _, _, hashes, symbols, _ in _indexed(batches, words_passed, width):
            index = PhraseIndex(symbols, width)
            every = index.words()
            for at in range(0, len(every.size), STEP):
                for found in _phrases(index, every.where(np.arange(at, min(at + STEP, len(every.size)))), width, hashes, parts):
                    pass
                if len(found.size) and found.words.shape[1] == width:
                    cell = phrase_hash([hashes[found.words[:, c]] for c in range(width)]) >> np.uint64(64 - CELL_BITS)
                    yield pa.RecordBatch.from_arrays([pa.array(cell.astype(np.int32)), pa.array(found.size.astype(np.int32))], names=["cell", "n"])

    return task


def _counted(words_passed, parts_passed: list, longest: int):
    """Counts of the phrases of 2 to ``longest`` words that can be frequent."""
    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        parts = [p.value for p in parts_passed]

        def rows(lang: str, words: pa.Array, found: Phrases, sign: int) -> Iterator[pa.RecordBatch]:
            for at in range(0, len(found.size), 50_000):
                part = found.words[at:at + 50_000]
                columns = [words.take(pa.array(part[:, c])) for c in range(part.shape[1])]
                phrase = pc.binary_join_element_wise(*columns, pa.scalar(b" ", pa.large_binary())).cast(pa.string())
                yield pa.RecordBatch.from_arrays([pa.array([lang] * len(part)), phrase, pa.array(sign * found.size[at:at + 50_000], pa.int64())], names=["lang", "phrase", "n"])

        for lang, names, hashes, symbols, shared in _indexed(batches, words_passed, longest):
            index, words = PhraseIndex(symbols, longest), pa.array(names, pa.large_binary())
            every = index.words()
            for at in range(0, len(every.size), STEP):
                for found in _phrases(index, every.where(np.arange(at, min(at + STEP, len(every.size)))), longest, hashes, parts):
                    yield from rows(lang, words, found, 1)
            if shared > 1:  # shorter phrases within the overlap have been counted by the shard before
                twice = PhraseIndex(symbols[:shared], longest)
                for found in _phrases(twice, twice.words(), shared, hashes, parts):
                    yield from rows(lang, words, found, -1)

    return task


def frequent_phrases(docs: DataFrame, longest: int = LONGEST, least: int = LEAST, lang_column: str = "lang", text_column: str = "text",
                     shard_words: int = SHARD_WORDS, most_bits: int = MOST_BITS, slice_bytes: int = SLICE) -> tuple[DataFrame, DataFrame]:
    """Stored ``(lang, phrase, words, n)`` of the phrases of 1 to ``longest`` words that stand ``least`` times or more, and
    ``(lang, n)`` with each language's word occurrences."""
    if longest < 2:
        raise ValueError("longest must be 2 or more")
    context = docs.sparkSession.sparkContext
    read = docs.select(F.coalesce(F.col(lang_column).cast("string"), F.lit("und")).alias("lang"), F.col(text_column).cast("string").alias("text"))
    shards = stored(read.mapInArrow(_shards(longest, shard_words, slice_bytes), SHARD), "shards")

    def sent(hashes: DataFrame):
        return context.broadcast(bit_map(hashes, hashes.count(), most_bits))

    # Rare words are made one row per language, for its total.
    often = shards.mapInArrow(_words, COUNTS).groupBy("lang", "phrase").agg(F.sum("n").alias("n")).withColumn("rare", F.col("n") < least)
    words = stored(often.groupBy("lang", "rare", F.when(~F.col("rare"), F.col("phrase")).alias("phrase")).agg(F.sum("n").alias("n")), "words")
    totals = words.groupBy("lang").agg(F.sum("n").alias("n"))
    frequent = words.filter("not rare").select("lang", "phrase", F.lit(1).alias("words"), "n")
    words_passed, parts = sent(frequent.select("lang", "phrase").mapInArrow(_hashes, "h bigint")), []
    for width in range(2, longest + 1):
        cells = shards.mapInArrow(_cells(words_passed, list(parts), width), "cell int, n int").groupBy("cell").agg(F.sum("n").alias("n"))
        many = stored(cells.filter(F.col("n") >= least).select(F.shiftleft(F.col("cell").cast("long"), 64 - CELL_BITS).alias("h")), "cells")
        parts.append(sent(many))
    long = shards.mapInArrow(_counted(words_passed, parts, longest), COUNTS).groupBy("lang", "phrase").agg(F.sum("n").alias("n")).filter(F.col("n") >= least)
    size = F.size(F.split("phrase", " ")).alias("words")
    return stored(frequent.union(long.select("lang", "phrase", size, "n")), "phrases"), totals


def _first(phrase: str, words: int):
    return F.substring_index(phrase, " ", words)


def collocations(docs: DataFrame, longest: int = LONGEST, least: int = LEAST, covered: int = COVERED, top: int = TOP, **options) -> DataFrame:
    """``(lang, rank, phrase, a, l, r, n, score)``: each language's first ``top`` phrases.

    A phrase of 2 to ``longest`` words that stands a times, at least ``least``, is cut in two, of l and r occurrences; its score
    is the lowest floor(1000000 a a / (l r)) of any cut, the first of equal ones. Phrases inside a longer candidate that has
    ``covered`` hundredths of their occurrences or more go. Order: score and a descending, phrase ascending by its bytes.
    """
    every, totals = frequent_phrases(docs, longest, least, **options)
    counts = every.filter(F.col("words") < longest)
    cuts, inside = None, None
    for width in range(2, longest + 1):
        rows = every.filter(F.col("words") == width).select("lang", "phrase", F.col("n").alias("a"))
        each = rows.select("lang", "phrase", "a", F.explode(F.sequence(F.lit(1), F.lit(width - 1))).alias("k"))
        each = each.withColumn("first", F.expr("substring_index(phrase, ' ', k)")).withColumn("rest", F.expr(f"substring_index(phrase, ' ', k - {width})"))
        cuts = each if cuts is None else cuts.union(each)
        for size in range(2, width):
            for start in range(width - size + 1):
                part = rows.select("lang", F.substring_index(_first("phrase", start + size), " ", -size).alias("phrase"), "a")
                inside = part if inside is None else inside.union(part)
    scored = cuts.join(counts.select("lang", F.col("phrase").alias("first"), F.col("n").alias("l")), ["lang", "first"])
    scored = scored.join(counts.select("lang", F.col("phrase").alias("rest"), F.col("n").alias("r")), ["lang", "rest"])
    of = lambda c: F.col(c).cast("decimal(15,0)")
    score = F.expr("cast(cast(a as decimal(15,0)) * cast(a as decimal(15,0)) * 1000000 as decimal(38,0)) div (cast(l as decimal(15,0)) * cast(r as decimal(15,0)))")
    best = scored.withColumn("score", score).groupBy("lang", "phrase", "a").agg(F.min(F.struct("score", "k", "l", "r")).alias("best"))
    if inside is not None:
        longer = inside.groupBy("lang", "phrase").agg(F.max("a").alias("longer"))
        best = best.join(longer, ["lang", "phrase"], "left").filter(F.coalesce(of("longer") * 100 < of("a") * covered, F.lit(True)))
    order = Window.partitionBy("lang").orderBy(F.desc("best.score"), F.desc("a"), F.asc("phrase"))
    ranked = best.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= top)
    return ranked.join(totals, "lang").select(
        "lang", F.col("rank").cast("long").alias("rank"), "phrase", "a", "best.l", "best.r", "n", F.col("best.score").cast("long").alias("score"))
