"""Language-model scores over words: how much less a target model is surprised by a text than a background model.

Two n-gram models share one vocabulary, order and smoothing. The background is counted over all documents, the target over
the good ones. A token is a word without case; the vocabulary is every word of the corpus, so what is counted grows with the
corpus.

Tasks cut the texts into chunks of about a million words and store them as numbers of words. Then, for each length of n-grams
from one word on, a chunk sends the distinct n-grams it holds with their counts to parts, told by their keys; a part adds up
what all chunks send and answers each with the sums, in the order of what it sent. A common n-gram is sent once a chunk. With
the answers a chunk has every count that the probabilities of its n-grams need, and scores its texts by itself. The driver
sees the sizes of the corpus only.

A word is told by 64 bits of its hash. A longer n-gram's key is made of two numbers, that of the n-gram without its last word
and that of its last word; parts give these numbers away, one for each n-gram, so keys are exact. A document's score is the
mean over its words of target loss minus background loss, in bits: low means like the target. A text begins after words that
stand nowhere else (``BEGIN``).

Defined results: null and empty texts have no tokens and null losses; without target documents the target model is the
smoothing alone; equal rows give equal rows; null ids are carried along and are never in the target; empty tables give
empty tables. Columns other than those named are not read.
"""

from __future__ import annotations

import secrets
import struct
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gleaner.llm.common import as_bytes, pieces, stored
from gleaner.sources.tables import passing

ORDER = 2
#: Weight of the shorter context's distribution, in counts.
PRIOR = 5.0
#: The number of the n-gram that is made of words before a text only.
BEGIN = 0
#: Words that a worker remembers the hashes of.
REMEMBERED = 500_000
#: Words, and texts, from which on a chunk is full.
CHUNK_WORDS, CHUNK_TEXTS = 1_000_000, 100_000
#: Keys that a part adds up, about.
PART_KEYS = 1_000_000
#: Target ids up to which every task gets them all; with more, rows are dealt by id.
BROADCAST_IDS = 1_000_000

_CHUNK = "chunk bigint, texts bigint, good_texts bigint, words bigint, good_words bigint, distinct bigint, dictionary binary, body binary"
_SENT = "part int, chunk bigint, body binary"
_ANSWER = "chunk bigint, part int, body binary, distinct bigint, top bigint"
#: Of an array: bytes it takes, values, bytes of a value.
_HEAD = struct.Struct("<QQB")


class Hashes:
    """Hashes of words; those met lately are remembered."""

    def __init__(self):
        self.known: dict[bytes, int] = {}

    def of(self, text: bytes) -> np.ndarray:
        words = text.decode().lower().encode().split()  # at the white space of ASCII, as elsewhere
        if len(self.known) > REMEMBERED:
            self.known.clear()
        known, out = self.known, []
        for word in words:
            value = known.get(word)
            if value is None:
                value = known[word] = xxhash.xxh3_64_intdigest(word)
            out.append(value)
        return np.array(out, np.uint64)


def pack(*arrays: np.ndarray) -> bytes:
    """Arrays of unsigned numbers in few bytes: each byte of the values by itself, compressed."""
    codec, out = pa.Codec("zstd"), []
    for values in arrays:
        values = np.ascontiguousarray(values, np.uint64)
        width = (int(values.max()).bit_length() + 7) // 8 if len(values) else 0
        data = codec.compress(values.view(np.uint8).reshape(-1, 8)[:, :width].T.tobytes(), asbytes=True) if width else b""
        out += _HEAD.pack(len(data), len(values), width), data
    return b"".join(out)


def unpack(data: bytes) -> list[np.ndarray]:
    codec, out, at = pa.Codec("zstd"), [], 0
    while at < len(data):
        size, n, width = _HEAD.unpack_from(data, at)
        at += _HEAD.size
        values = np.zeros((n, 8), np.uint8)
        if width:
            raw = codec.decompress(memoryview(data)[at:at + size], decompressed_size=n * width)
            values[:, :width] = np.frombuffer(raw, np.uint8).reshape(width, n).T
        out.append(values.reshape(-1).view(np.uint64))
        at += size
    return out


def _steps(keys: np.ndarray) -> np.ndarray:
    """Each key less the one before; ``cumsum`` undoes it."""
    return np.diff(keys, prepend=np.uint64(0))


def _part(keys: np.ndarray, level: int, parts: int) -> np.ndarray:
    """The part of each key. Hashes go by their order, so that those of a chunk, in order, are in the order of parts; numbers are mixed first."""
    mixed = keys if level == 1 else keys * np.uint64(0x9E3779B97F4A7C15)
    return ((mixed >> np.uint64(32)) * np.uint64(parts)) >> np.uint64(32)


def _added(at: np.ndarray, amounts: np.ndarray | None, n: int) -> np.ndarray:
    """Sums by place; exact, as they stay far under 2^53."""
    return np.bincount(at, amounts, n).astype(np.int64)


def _chunks(docs: DataFrame, with_ids: str) -> DataFrame:
    """Chunks of ``docs (doc_id, text, good)``: the ids, the lengths and marks of texts, words as places in the chunk's sorted hashes."""
    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hashes = Hashes()
        ids: list[pa.Array] = []
        words: list[np.ndarray] = []
        good: list[bool] = []

        def emit() -> pa.RecordBatch:
            sizes, marks, all_words = np.array([len(w) for w in words]), np.array(good), np.concatenate(words)
            dictionary, tokens = np.unique(all_words, return_inverse=True)
            held, body = pa.concat_arrays(ids), pack(sizes, marks, tokens)
            numbers = (secrets.randbits(63), (sizes > 0).sum(), (marks & (sizes > 0)).sum(), sizes.sum(), sizes[marks].sum(), len(dictionary))
            row = [*(pa.array([int(x)], pa.int64()) for x in numbers), pa.array([pack(_steps(dictionary))], pa.binary()), pa.array([body], pa.binary()),
                   pa.ListArray.from_arrays(pa.array([0, len(held)], pa.int32()), held)]
            ids.clear(), words.clear(), good.clear()
            return pa.RecordBatch.from_arrays(row, names=["chunk", "texts", "good_texts", "words", "good_words", "distinct", "dictionary", "body", "ids"])

        size = 0
        for batch in pieces(batches, "text"):
            ids.append(batch.column(0))
            words += map(hashes.of, as_bytes(batch.column(1)).to_pylist())
            good += batch.column(2).to_pylist()
            size += sum(map(len, words[-batch.num_rows:]))
            if size >= CHUNK_WORDS or len(words) >= CHUNK_TEXTS:
                yield emit()
                size = 0
        if words:
            yield emit()

    return docs.select("doc_id", "text", "good").mapInArrow(task, f"{_CHUNK}, ids array<{with_ids}>")


class Chunk:
    """A chunk, and what the parts have answered so far: for each place the number of the n-gram that ends there, and its counts."""

    def __init__(self, body: bytes):
        self.sizes, marks, self.tokens = (a.astype(np.int64) for a in unpack(body))
        self.marks = marks.astype(bool)
        self.good = np.repeat(self.marks, self.sizes)
        ends = np.cumsum(self.sizes)[self.sizes > 0]
        self.starts, self.ends = ends - self.sizes[self.sizes > 0], ends - 1
        self.good_ends = self.ends[self.marks[self.sizes > 0]]
        self.words = self.numbers = self.tokens  # after the first answer: numbers

    def keys(self, level: int, step: int) -> tuple[np.ndarray, np.ndarray]:
        """Distinct keys of the n-grams, in order, and the place of each n-gram among them. ``step`` is over every number of a word."""
        return np.unique(self.before(self.numbers, BEGIN).astype(np.uint64) * np.uint64(step) + self.words.astype(np.uint64), return_inverse=True)

    def before(self, values: np.ndarray, at_start) -> np.ndarray:
        """The value of the place before, of the same text."""
        out = np.roll(values, 1)
        out[self.starts] = at_start
        return out

    def send(self, level: int, order: int, keys: np.ndarray, at: np.ndarray, parts: int) -> Iterator[tuple[int, bytes]]:
        """For each part its keys, how often they stand in all and in good texts, and, if longer n-grams follow, at the end of these."""
        counted = [_added(x, None, len(keys)) for x in (at, at[self.good], *((at[self.ends], at[self.good_ends]) if level < order else ()))]
        for part, places in _dealt(keys, level, parts):
            yield part, pack(_steps(keys[places]), *(c[places] for c in counted))

    def take(self, level: int, keys: np.ndarray | None, at: np.ndarray, bodies: list[bytes], parts: int) -> list[np.ndarray]:
        """What the parts, in order, answer on the keys, for each place; columns are those of ``_answers``."""
        columns = [np.concatenate(c).astype(np.int64) for c in zip(*map(unpack, bodies))]
        if keys is not None:
            order = np.concatenate([places for _, places in _dealt(keys, level, parts)])
            for k, c in enumerate(columns):
                columns[k] = np.empty_like(c)
                columns[k][order] = c
        return [c[at] for c in columns]


def _dealt(keys: np.ndarray, level: int, parts: int) -> Iterator[tuple[int, np.ndarray]]:
    """The places of the keys of each part that has any, in order."""
    part = _part(keys, level, parts)
    order = np.argsort(part, kind="stable")
    found, starts = np.unique(part[order], return_index=True)
    yield from zip(found.tolist(), np.split(order, starts[1:]))


def _sums(level: int, order: int, parts: int) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """A task's parts: sums over chunks, given back to each of them in the order of its keys. The counts, after them the numbers of the n-grams if longer ones follow."""
    def answers(part: int, rows: list[tuple[int, bytes]]) -> Iterator[pa.RecordBatch]:
        sent = [unpack(body) for _, body in rows]
        keys, at = np.unique(np.concatenate([np.cumsum(s[0], dtype=np.uint64) for s in sent]), return_inverse=True)
        sums = [_added(at, np.concatenate(c).astype(np.float64), len(keys)) for c in list(zip(*sent))[1:]]
        if level < order:  # common n-grams get low numbers
            ranks = np.empty(len(keys), np.int64)
            ranks[np.argsort(-sums[0], kind="stable")] = np.arange(len(keys))
            sums.append(BEGIN + 1 + part + parts * ranks)
        top, start = int(sums[-1].max()), 0
        for k, (chunk, _) in enumerate(rows):
            mine = at[start:start + len(sent[k][0])]
            start += len(mine)
            row = (chunk, part, pack(*(s[mine] for s in sums)), 0 if k else len(keys), top)
            yield pa.RecordBatch.from_arrays([pa.array([x], kind) for x, kind in zip(row, (pa.int64(), pa.int32(), pa.binary(), pa.int64(), pa.int64()))],
                                             names=["chunk", "part", "body", "distinct", "top"])

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple[int, bytes]] = []
        last = None
        for batch in batches:
            for part, chunk, body in zip(*(c.to_pylist() for c in batch.columns)):
                if part != last and held:
                    yield from answers(last, held)
                    held = []
                held.append((chunk, body))
                last = part
        if held:
            yield from answers(last, held)

    return task


def _gathered(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[Chunk, dict[int, list[bytes]], int, pa.Array | None]]:
    """Each chunk with its answers by level, its number, and its ids if there is such a column."""
    held: tuple | None = None
    for batch in batches:
        levels, numbers, bodies = (batch.column(k).to_pylist() for k in (1, 0, 3))
        for row, (level, number, body) in enumerate(zip(levels, numbers, bodies)):
            if level == 0:
                if held:
                    yield held
                held = Chunk(body), {}, number, batch.column(4)[row].values if batch.num_columns > 4 else None
            else:
                held[1].setdefault(level, []).append(body)
    if held:
        yield held


class Model:
    """What the driver knows: sizes of the corpus, and of each level answered so far."""

    def __init__(self, order: int, prior: float, sizes: dict[str, int]):
        self.order, self.prior, self.sizes = order, prior, sizes
        self.parts: list[int] = []
        self.vocabulary = self.step = 0

    def numbered(self, chunk: Chunk, answers: dict[int, list[bytes]], levels: int) -> Iterator[list[np.ndarray]]:
        """The answers for each place, level by level; the chunk's numbers are those of the level."""
        for level in range(1, levels + 1):
            keys, at = (None, chunk.tokens) if level == 1 else chunk.keys(level, self.step)
            columns = chunk.take(level, keys, at, answers[level], self.parts[level - 1])
            if level < self.order:
                chunk.numbers = columns[-1]
                if level == 1:
                    chunk.words = chunk.numbers
            yield columns

    def sent(self, level: int, parts: int) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
        """What chunks that know the levels before send to the parts of a level."""
        def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for chunk, answers, number, _ in _gathered(batches):
                if len(chunk.tokens):
                    for _ in self.numbered(chunk, answers, level - 1):
                        pass
                    yield _sent_rows(number, chunk.send(level, self.order, *chunk.keys(level, self.step), parts))

        return task

    def losses(self, chunk: Chunk, answers: dict[int, list[bytes]]) -> list[np.ndarray]:
        """Sums over the words of each text, for target and background."""
        sides = (("good_words", "good_texts", 1), ("words", "texts", 0))
        p: list = [1.0 / max(1, self.vocabulary)] * 2
        contexts: list = [self.sizes["good_words"], self.sizes["words"]]
        for columns in self.numbered(chunk, answers, self.order):
            for k, (_, texts, count) in enumerate(sides):
                p[k] = (columns[count] + self.prior * p[k]) / (contexts[k] + self.prior)
                if len(columns) > 2:  # what the n-gram is followed by any word; before a text's first word stand all beginnings
                    contexts[k] = chunk.before(columns[count] - columns[count + 2], self.sizes[texts])
        text = np.repeat(np.arange(len(chunk.sizes)), chunk.sizes)
        return [np.bincount(text, -np.log2(x), len(chunk.sizes)) for x in p]


def _sent_rows(number: int, sent: Iterator[tuple[int, bytes]]) -> pa.RecordBatch:
    parts, bodies = zip(*sent)
    return pa.RecordBatch.from_arrays([pa.array(parts, pa.int32()), pa.array([number] * len(parts), pa.int64()), pa.array(bodies, pa.binary())], names=["part", "chunk", "body"])


def _first_sent(order: int, parts: int) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """What chunks send of their words."""
    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for number, dictionary, body in zip(*(c.to_pylist() for c in batch.columns)):
                chunk = Chunk(body)
                if len(chunk.tokens):
                    hashes = np.cumsum(unpack(dictionary)[0], dtype=np.uint64)
                    yield _sent_rows(number, chunk.send(1, order, hashes, chunk.tokens, parts))

    return task


def _met(chunks: DataFrame, answers: list[DataFrame], *more: str) -> DataFrame:
    """Rows of chunks, each followed by its answers by level and part."""
    rows = chunks.select("chunk", F.lit(0).alias("level"), F.lit(0).alias("part"), "body", *more)
    for level, answer in enumerate(answers, 1):
        rows = rows.unionByName(answer.select("chunk", F.lit(level).alias("level"), "part", "body"), allowMissingColumns=True)
    return rows.repartition("chunk").sortWithinPartitions("chunk", "level", "part")


def _sizes(chunks: DataFrame) -> dict[str, int]:
    names = ["texts", "good_texts", "words", "good_words", "distinct"]
    return chunks.agg(*(F.coalesce(F.sum(n), F.lit(0)).alias(n) for n in names)).first().asDict()


def _parts(spark: SparkSession, keys: int) -> int:
    return max(spark.sparkContext.defaultParallelism, -(-keys // PART_KEYS))


def cross_entropy_difference(docs: DataFrame, good_ids: DataFrame, order: int = ORDER, prior: float = PRIOR, id_column: str = "doc_id",
                             text_column: str = "text") -> DataFrame:
    """``(doc_id, n_tokens, target_loss, background_loss, score)``, losses in bits per word; the target is those whose id is in ``good_ids (doc_id)``."""
    spark = docs.sparkSession
    narrow = docs.select(F.col(id_column).alias("doc_id"), F.col(text_column).cast("string").alias("text"))
    kind = narrow.schema["doc_id"].dataType.simpleString()
    good = good_ids.select("doc_id").filter("doc_id is not null").distinct().withColumn("good", F.lit(True))
    few = good.count() <= BROADCAST_IDS
    marked = narrow.join(F.broadcast(good) if few else good, "doc_id", "left").select("doc_id", "text", F.coalesce("good", F.lit(False)).alias("good"))
    with passing(spark) as kept:
        chunks = kept(_chunks(marked, kind), "chunks")
        model = Model(order, prior, _sizes(chunks))
        answers: list[DataFrame] = []
        for level in range(1, order + 1):
            parts = _parts(spark, model.sizes["distinct" if level == 1 else "words"])
            sent = chunks.select("chunk", "dictionary", "body").mapInArrow(_first_sent(order, parts), _SENT) if level == 1 else _met(chunks, answers).mapInArrow(model.sent(level, parts), _SENT)
            dealt = sent.repartitionById(parts, F.col("part")).sortWithinPartitions("part")
            answers.append(kept(dealt.mapInArrow(_sums(level, order, parts), _ANSWER), "counts"))
            model.parts.append(parts)
            if level < order or level == 1:
                found = answers[-1].agg(F.coalesce(F.sum("distinct"), F.lit(0)).alias("n"), F.coalesce(F.max("top"), F.lit(0)).alias("top")).first()
                if level == 1:
                    model.vocabulary, model.step = found["n"], found["top"] + 1
                if (found["top"] + 1) * model.step >= 1 << 64:
                    raise OverflowError(f"{found['top']} n-grams of {level} words and {model.step} words do not fit a key")

        def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for chunk, answered, _, ids in _gathered(batches):
                empty = chunk.sizes == 0
                sums = model.losses(chunk, answered) if len(chunk.tokens) else [np.zeros(len(empty))] * 2
                target, background = (s / np.maximum(chunk.sizes, 1) for s in sums)
                yield pa.RecordBatch.from_arrays([ids, pa.array(chunk.sizes), *(pa.array(x, mask=empty) for x in (target, background, target - background))],
                                                 names=["doc_id", "n_tokens", "target_loss", "background_loss", "score"])

        scored = _met(chunks, answers, "ids").mapInArrow(task, f"doc_id {kind}, n_tokens bigint, target_loss double, background_loss double, score double")
        return stored(scored, "losses")
