"""Near duplicates by MinHash: banded candidates, screened by odd sketches, confirmed on full shingle sets.

A document is the set of its distinct word shingles, each a 64-bit hash. ``BANDS * WIDTH`` minimum hashes of a set make two
things: a key per band, which two sets share if they agree in all of a band's samples, and an odd sketch, a bitmap in which
every sample turns one bit. The bits in which two sketches differ tell how many samples do, and most exactly so where sets
are alike; a pair whose sketches differ in more bits than a pair at the limit would, six standard deviations out, is dropped
without its sets being read. Whoever is left is confirmed by the size of the intersection of the full sets.

Documents with equal sets are one class from the start. Not all pairs of a large group are met: first every class is
confirmed against the one in its buckets whose sketch is nearest, by few bands and then by all, and classes that hang together
by then are not compared again; only all pairs that are left, of different components, are screened and confirmed.
Buckets longer than ``BLOCK`` are cut into blocks that meet two by two in tasks of their own.

Two sets at the limit of 0.8 share no band with a chance of 3 in 10**9; more alike sets much less often.

Defined results: null and empty texts, and texts without words, have an empty set, which is linked with nothing; a text of
fewer words than a shingle has one element, all its words. Rows that repeat an id are rows of their own. ``component_id`` is
the smallest id that can be reached, null only where no row of the component has an id; ``kept`` compares it with the row's id
(null equals null). An empty table gives an empty table. Other columns are not read. One document's set must fit in a task.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gleaner.llm.anchors import mixed
from gleaner.llm.bitmap import BitMap, bit_map
from gleaner.llm.common import as_bytes, pieces, stored
from gleaner.llm.components import components

SHINGLE = 4
#: Hundredths of the union that the intersection must have.
PERCENT = 80
BANDS, WIDTH = 50, 5
#: Bands in which nearest classes are looked for first.
FIRST_BANDS = 10
#: Bits of an odd sketch; samples and bits of a longer one.
BITS = 512
FINE_SAMPLES, FINE_BITS = 3000, 8192
BLOCK = 4096
#: Members that are confirmed against one class in one task.
CHUNK = 256
#: Links that one task contracts: 16 bytes each.
FOREST_LINKS = 1_000_000
#: Samples of shingles that are taken at once.
STEP = 1 << 18
#: Buckets of at most so many classes are compared together, by size.
SMALL = 12

_SAMPLES = mixed(np.arange(1, 2 * FINE_SAMPLES + 1, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15))


def shingle_set(text: bytes, shingle: int = SHINGLE) -> np.ndarray:
    """The distinct shingles of a text as sorted 64-bit hashes."""
    words = text.lower().split()
    if not words:
        return np.zeros(0, np.uint64)
    hashes = np.fromiter(map(xxhash.xxh3_64_intdigest, words), np.uint64, len(words))
    n = max(1, len(words) - shingle + 1)
    out = np.zeros(n, np.uint64)
    for k in range(min(shingle, len(words))):
        out = mixed(out * np.uint64(0xD1342543DE82EF95) + hashes[k:k + n])
    return np.unique(out)


def samples(shingles: np.ndarray, count: int) -> np.ndarray:
    """Minimum hashes of a set that is not empty, 32 bits each."""
    a, b = (_SAMPLES[:count] >> np.uint64(32)).astype(np.uint32) | np.uint32(1), _SAMPLES[FINE_SAMPLES:FINE_SAMPLES + count].astype(np.uint32)
    h = (mixed(shingles) >> np.uint64(32)).astype(np.uint32)
    least = np.full(count, np.iinfo(np.uint32).max, np.uint32)
    step = max(1, STEP // count)
    for at in range(0, len(h), step):
        part = h[at:at + step, None] * a[None, :]
        part += b[None, :]
        np.minimum(least, part.min(axis=0), out=least)
    return least


def band_keys(least: np.ndarray, width: int) -> np.ndarray:
    parts = least.reshape(-1, width).astype(np.uint64)
    out = np.arange(len(parts), dtype=np.uint64)
    for k in range(width):
        out = mixed(out * np.uint64(0xD1342543DE82EF95) + parts[:, k] + np.uint64(1))
    return out.view(np.int64)


def odd_sketch(least: np.ndarray, bits: int = BITS) -> bytes:
    """Every sample turns the bit that it and its number are hashed to."""
    at = mixed(mixed(np.arange(len(least), dtype=np.uint64) << np.uint64(32) | least)) % np.uint64(bits)
    return np.packbits((np.bincount(at.astype(np.int64), minlength=bits) & 1).astype(np.uint8), bitorder="little").tobytes()


def most_bits(percent: int, count: int, bits: int = BITS, deviations: float = 6) -> int:
    """Bits that the sketches of two sets at the limit differ in, with so many standard deviations more."""
    alike = percent / 100
    differ = 2 * count * (1 - alike)
    left = (1 - 2 / bits) ** differ
    by_samples = 2 * math.sqrt(count * alike * (1 - alike)) * left
    by_hashing = math.sqrt(bits / 4 * (1 - left * left))
    return math.ceil(bits / 2 * (1 - left) + deviations * math.hypot(by_samples, by_hashing))


def _signed(docs: DataFrame, shingle: int, bands: int, width: int) -> DataFrame:
    """A row per row of ``(doc_id, text)``: the set's size and digest, the text's digest, the odd sketch, and the band keys."""

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in pieces(batches, "text"):
            sizes, digests, tags, sketches, keys = [], [], [], [], []
            for text in as_bytes(batch.column(1)).to_pylist():
                found = shingle_set(text, shingle)
                sizes.append(len(found))
                digests.append(xxhash.xxh3_128_digest(found.tobytes()))
                tags.append(xxhash.xxh3_128_digest(text))
                least = samples(found, bands * width) if len(found) else np.zeros(0, np.uint32)
                sketches.append(odd_sketch(least) if len(found) else b"")
                keys.append(band_keys(least, width).tolist() if len(found) else [])
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(sizes, pa.int64()), pa.array(digests, pa.binary()), pa.array(tags, pa.binary()), pa.array(sketches, pa.binary()),
                 pa.array(keys, pa.list_(pa.int64()))], names=["doc_id", "n", "digest", "tag", "sketch", "keys"])

    kind = docs.schema["doc_id"].dataType.simpleString()
    return docs.mapInArrow(task, f"doc_id {kind}, n bigint, digest binary, tag binary, sketch binary, keys array<bigint>")


class _Screen:
    """Which pairs of the classes of a batch of buckets may be links; columns are the row, comp, n and the sketch's words. Pairs are of rows."""

    def __init__(self, limit: int, percent: int, nearest: bool):
        self.limit, self.percent, self.nearest = limit, percent, nearest
        self.none = np.uint16(np.iinfo(np.uint16).max)

    def distances(self, left: tuple, right: tuple) -> np.ndarray:
        """Differing bits of pairs along the last two axes; ``none`` where a pair needs no look."""
        out = np.zeros(np.broadcast_shapes(left[0].shape + (1,), right[0].shape[:-1] + (1,) + right[0].shape[-1:]), np.uint16)
        for word in range(left[3].shape[-1]):
            out += np.bitwise_count(left[3][..., :, None, word] ^ right[3][..., None, :, word])
        a, b = left[2][..., :, None], right[2][..., None, :]
        idle = (out > self.limit) | (left[1][..., :, None] == right[1][..., None, :])
        # Sets whose sizes differ too much cannot reach the limit.
        idle |= np.minimum(a, b) * 100 < np.maximum(a, b) * self.percent
        out[idle] = self.none
        return out

    def small(self, columns: tuple, starts: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray]:
        rows = starts[:, None] + np.arange(size)[None, :]
        group = tuple(c[rows] for c in columns)
        far = self.distances(group, group)
        if self.nearest:
            best = far.argmin(axis=2)
            g, i = np.nonzero(np.take_along_axis(far, best[:, :, None], 2)[:, :, 0] != self.none)
            return group[0][g, i], group[0][g, best[g, i]]
        g, i, j = np.nonzero((far != self.none) & np.triu(np.ones((size, size), bool), 1))
        return group[0][g, i], group[0][g, j]

    def large(self, left: tuple, right: tuple, same: bool) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """Pairs across two blocks, or within one. The commonest component is not compared with itself."""
        if self.nearest:
            least = np.full(len(right[0]), self.none)
            by = np.zeros(len(right[0]), np.int64)
        comps, counts = np.unique(np.concatenate((left[1], right[1])), return_counts=True)
        common = comps[counts.argmax()]
        mine, others = left[1] == common, np.flatnonzero(right[1] != common)
        for rows, columns in ((np.flatnonzero(~mine), np.arange(len(right[0]))), (np.flatnonzero(mine), others)):
            if not len(columns):
                continue
            part = tuple(c[columns] for c in right)
            for at in range(0, len(rows), 256):
                some = rows[at:at + 256]
                far = self.distances(tuple(c[some] for c in left), part)
                if not self.nearest:
                    i, j = np.nonzero(far != self.none)
                    i, j = some[i], columns[j]
                    if same:
                        i, j = i[left[0][i] < right[0][j]], j[left[0][i] < right[0][j]]
                    yield left[0][i], right[0][j]
                    continue
                best = far.argmin(axis=1)
                found = np.flatnonzero(far[np.arange(len(some)), best] != self.none)
                yield left[0][some[found]], right[0][columns[best[found]]]
                if not same:
                    down = far.argmin(axis=0)
                    value = far[down, np.arange(len(columns))]
                    nearer = value < least[columns]
                    least[columns[nearer]], by[columns[nearer]] = value[nearer], some[down[nearer]]
        if self.nearest and not same:
            found = np.flatnonzero(least != self.none)
            yield right[0][found], left[0][by[found]]


def _pairs(members: DataFrame, classes: DataFrame, limit: int, percent: int, nearest: bool, block: int) -> DataFrame:
    """Candidates ``(member, leader)`` among ``(key, cid, comp, size)``, whose buckets have ``size`` rows each.

    Without ``nearest`` a pair is given by one bucket, that of the first band in which the two agree, however many they share: ``classes`` has
    the ``keys`` of all bands for that.
    """
    screen = _Screen(limit, percent, nearest)
    bands = [] if nearest else ["keys"]
    known = members.join(classes.select("cid", "n", "sketch", *bands), "cid").withColumn("blocks", F.ceil(F.col("size") / block))
    own = F.pmod(F.xxhash64("cid"), F.col("blocks")).cast("int")
    met = known.withColumn("own", own).withColumn("other", F.explode(F.sequence(F.lit(0), (F.col("blocks") - 1).cast("int"))))
    dealt = met.select(F.xxhash64("key", F.least("own", "other"), F.greatest("own", "other")).alias("g"), "key", F.least("own", "other").alias("a"),
                       F.greatest("own", "other").alias("b"), "own", "cid", "comp", "n", "sketch", *bands)
    dealt = dealt.repartition("g").sortWithinPartitions("g", "key", "a", "b", "own", "cid")

    def compared(table: pa.Table) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        g, key, a, b, own, cid, comp, n = (table.column(k).to_numpy() for k in range(8))
        sketches = pa.concat_arrays(table.column(8).chunks) if table.column(8).num_chunks else pa.array([], pa.binary())
        words = np.frombuffer(b"".join(sketches.to_pylist()), np.uint64).reshape(len(table), -1)
        columns = (np.arange(len(table)), comp, n, words)
        keys = None if nearest else table.column(9).combine_chunks().flatten().to_numpy().reshape(len(table), -1)

        def given(pairs: Iterator[tuple[np.ndarray, np.ndarray]]) -> Iterator[tuple[np.ndarray, np.ndarray]]:
            for all_u, all_v in pairs:
                for at in range(0, len(all_u), 100_000):
                    u, v = all_u[at:at + 100_000], all_v[at:at + 100_000]
                    if keys is not None:
                        first = (keys[u] == keys[v]).argmax(axis=1)
                        here = keys[u, first] == key[u]
                        u, v = u[here], v[here]
                    yield cid[u], cid[v]

        new = (key[1:] != key[:-1]) | (a[1:] != a[:-1]) | (b[1:] != b[:-1])
        starts = np.concatenate(([0], np.flatnonzero(new) + 1))
        sizes = np.diff(np.append(starts, len(table)))
        simple = (sizes <= SMALL) & (a[starts] == b[starts])
        for size in np.unique(sizes[simple]).tolist():
            if size > 1:
                of = starts[simple & (sizes == size)]
                for at in range(0, len(of), 4096):
                    yield from given(iter([screen.small(columns, of[at:at + 4096], size)]))
        for start, size in zip(starts[~simple].tolist(), sizes[~simple].tolist()):
            rows = np.arange(start, start + size)
            same = bool(a[start] == b[start])
            sides = [rows] if same else [rows[own[rows] == a[start]], rows[own[rows] == b[start]]]
            if len(sides[0]) and len(sides[-1]):
                left, right = (tuple(c[side] for c in columns) for side in (sides[0], sides[-1]))
                yield from given(screen.large(left, right, same))

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rest: pa.Table | None = None

        def found(table: pa.Table) -> Iterator[pa.RecordBatch]:
            for u, v in compared(table):
                yield pa.RecordBatch.from_arrays([pa.array(u, pa.int64()), pa.array(v, pa.int64())], names=["member", "leader"])

        for batch in batches:
            if not batch.num_rows:
                continue
            table = pa.Table.from_batches([batch])
            table = pa.concat_tables([rest, table]) if rest is not None else table
            g = table.column(0).to_numpy()
            cut = int(np.searchsorted(g != g[-1], False, side="left")) if g[0] == g[-1] else int(np.flatnonzero(g != g[-1])[-1]) + 1
            rest = table.slice(cut)
            if cut:
                yield from found(table.slice(0, cut).combine_chunks())
        if rest is not None and len(rest):
            yield from found(rest.combine_chunks())

    return dealt.mapInArrow(task, "member bigint, leader bigint")


def _of_texts(docs: DataFrame, needs: DataFrame, made, name: str) -> DataFrame:
    """``(tag, name)``: what ``made`` makes, as bytes, of the texts whose digests are the tags of ``needs``, and perhaps of others.

    A task gives a text once.
    """
    tags = needs.select("tag").distinct()
    wanted = docs.sparkSession.sparkContext.broadcast(bit_map(tags.mapInArrow(_tag_hash, "h bigint"), tags.count()))

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        passed: BitMap = wanted.value
        seen: set[bytes] = set()
        for batch in pieces(batches, "text"):
            texts = as_bytes(batch.column(1)).to_pylist()
            tags = [xxhash.xxh3_128_digest(t) for t in texts]
            may = passed.has(np.frombuffer(b"".join(tags), "<u8")[::2]) if tags else []
            kept = {tag: text for tag, text, ok in zip(tags, texts, may) if ok and tag not in seen}
            seen.update(kept)
            if kept:
                yield pa.RecordBatch.from_arrays([pa.array(list(kept), pa.binary()), pa.array(list(map(made, kept.values())), pa.binary())], names=["tag", name])

    return docs.mapInArrow(task, f"tag binary, {name} binary")


def _tag_hash(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        tags = np.frombuffer(b"".join(batch.column(0).to_pylist()), "<u8")[::2]
        yield pa.RecordBatch.from_arrays([pa.array(tags.view(np.int64))], names=["h"])


def _confirmed(pairs: DataFrame, docs: DataFrame, classes: DataFrame, percent: int, shingle: int) -> DataFrame:
    """Links ``(u, v)``: pairs whose full sets reach the limit. A leader's set goes to a task once for ``CHUNK`` members."""
    once = pairs.groupBy(F.least("member", "leader").alias("x"), F.greatest("member", "leader").alias("y")).agg(F.min("leader").alias("leader"))
    once = once.select("leader", (F.col("x") + F.col("y") - F.col("leader")).alias("member"))
    once = stored(once, "candidates")
    of = once.groupBy("leader").agg(F.ceil(F.count(F.lit(1)) / CHUNK).alias("chunks"))
    placed = once.join(of, "leader").select("leader", F.pmod(F.xxhash64("member"), F.col("chunks")).alias("chunk"), "member")
    needs = placed.select("leader", "chunk", F.lit(False).alias("leads"), F.col("member").alias("cid"))
    needs = needs.union(placed.select("leader", "chunk", F.lit(True), "leader").distinct())
    needs = stored(needs.join(classes.select("cid", "tag"), "cid"), "needs")
    if needs.isEmpty():
        return docs.sparkSession.createDataFrame([], "u bigint, v bigint")
    sets = _of_texts(docs, needs, lambda text: shingle_set(text, shingle).tobytes(), "shingles")
    rows = needs.join(sets, "tag").select("leader", "chunk", "leads", "cid", "shingles")
    dealt = rows.repartition("leader", "chunk").sortWithinPartitions("leader", "chunk", F.desc("leads"))

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at: tuple | None = None
        leader = np.zeros(0, np.uint64)
        for batch in batches:
            u, v = [], []
            for x, chunk, leads, cid, data in zip(*(batch.column(k).to_pylist() for k in range(4)), batch.column(4)):
                shingles = np.frombuffer(data.as_buffer(), np.uint64)
                if leads:
                    at, leader = (x, chunk), shingles.copy()
                    continue
                if at != (x, chunk):
                    raise ValueError("a leader's set is missing")
                place = np.minimum(np.searchsorted(leader, shingles), len(leader) - 1)
                both = int((leader[place] == shingles).sum())
                if 100 * both >= percent * (len(leader) + len(shingles) - both):
                    u.append(cid), v.append(x)
            if u:
                yield pa.RecordBatch.from_arrays([pa.array(u, pa.int64()), pa.array(v, pa.int64())], names=["u", "v"])

    return dealt.mapInArrow(task, "u bigint, v bigint").distinct()


def _forest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Of a task's links ``(u, v)``, each node with the smallest one that it hangs together with."""
    held = [np.zeros((2, 0), np.int64), *(np.stack([b.column(0).to_numpy(), b.column(1).to_numpy()]) for b in batches)]
    u, v = np.concatenate(held, axis=1)
    nodes, ends = np.unique(np.concatenate((u, v)), return_inverse=True)
    a, b = ends[:len(u)], ends[len(u):]
    root = np.arange(len(nodes))
    while True:
        low = np.minimum(root[a], root[b])
        after = root.copy()
        for side in (a, b, root[a], root[b]):
            np.minimum.at(after, side, low)
        after = after[after]
        if (after == root).all():
            break
        root = after
    for at in range(0, len(nodes), 100_000):
        yield pa.RecordBatch.from_arrays([pa.array(nodes[at:at + 100_000]), pa.array(nodes[root[at:at + 100_000]])], names=["node", "root"])


def _roots(links: DataFrame) -> DataFrame:
    """``(node, root)`` of all that is linked. Tasks contract ``FOREST_LINKS`` links each; if there are more, rounds join what is left."""
    parts = -(-links.count() // FOREST_LINKS)
    stars = links.repartition(max(1, parts)).mapInArrow(_forest, "node bigint, root bigint")
    return stored(stars, "roots") if parts <= 1 else components(stars.select(F.col("node").alias("u"), F.col("root").alias("v")))


def _finer(members: DataFrame, docs: DataFrame, classes: DataFrame, shingle: int) -> DataFrame:
    """``(cid, n, sketch)`` of the classes of ``members``, with longer sketches."""
    needs = stored(classes.select("cid", "n", "tag").join(members.select("cid").distinct(), "cid", "left_semi"), "compared")

    def made(text: bytes) -> bytes:
        found = shingle_set(text, shingle)
        return odd_sketch(samples(found, FINE_SAMPLES), FINE_BITS) if len(found) else b""

    sketches = _of_texts(docs, needs, made, "sketch").groupBy("tag").agg(F.first("sketch").alias("sketch"))
    return stored(needs.join(sketches, "tag").select("cid", "n", "sketch"), "sketches")


def near_duplicates(docs: DataFrame, percent: int = PERCENT, shingle: int = SHINGLE, bands: int = BANDS, width: int = WIDTH, block: int = BLOCK,
                    id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """``(doc_id, n_shingles, component_id, kept)`` for every row: documents are linked where 100 * intersection >= ``percent`` * union."""
    if not 1 <= bands * width <= BANDS * WIDTH:
        raise ValueError(f"at most {BANDS * WIDTH} samples")
    narrow = docs.select(F.col(id_column).alias("doc_id"), F.col(text_column).cast("string").alias("text"))
    limit = most_bits(percent, bands * width)
    rows = stored(_signed(narrow, shingle, bands, width), "signatures")
    each = rows.filter("n > 0").groupBy("digest").agg(F.min("doc_id").alias("least"), F.first("n").alias("n"), F.first(F.struct("tag", "sketch", "keys")).alias("s"))
    classes = stored(each.select(F.monotonically_increasing_id().alias("cid"), "digest", "least", "n", "s.tag", "s.sketch", "s.keys"), "classes")
    postings = classes.select("cid", F.posexplode("keys").alias("band", "key"))
    shared = postings.groupBy("key").agg(F.count(F.lit(1)).alias("size")).filter("size > 1")
    members = stored(postings.join(shared, "key").select("key", "band", "cid", "size"), "buckets")

    links = _confirmed(_pairs(members.filter(F.col("band") < FIRST_BANDS).withColumn("comp", F.col("cid")), classes, limit, percent, True, block), narrow, classes, percent, shingle)
    links = stored(links, "links")
    fine, limit = None, most_bits(percent, FINE_SAMPLES, FINE_BITS)
    for nearest in (True, False):
        marked = members.join(_roots(links), F.col("cid") == F.col("node"), "left").select("key", "cid", F.coalesce("root", "cid").alias("comp"))
        several = marked.groupBy("key").agg(F.count(F.lit(1)).alias("size"), F.min("comp").alias("x"), F.max("comp").alias("y")).filter("x < y").select("key", "size")
        left = stored(marked.join(several, "key"), "mixed")
        if left.isEmpty():
            break
        fine = fine if fine is not None else _finer(left, narrow, classes, shingle)
        of = fine if nearest else fine.join(classes.select("cid", "keys"), "cid")
        links = stored(links.union(_confirmed(_pairs(left, of, limit, percent, nearest, block), narrow, classes, percent, shingle)), "links")
    roots = _roots(links)
    placed = classes.join(roots, F.col("cid") == F.col("node"), "left").select("digest", "least", F.coalesce("root", "cid").alias("root"))
    named = placed.join(placed.groupBy("root").agg(F.min("least").alias("component_id")), "root").select("digest", "component_id")
    out = rows.select("doc_id", "n", "digest").join(named, "digest", "left")
    component = F.when(F.col("n") > 0, F.col("component_id")).otherwise(F.col("doc_id"))
    return out.select("doc_id", F.col("n").alias("n_shingles"), component.alias("component_id"), F.col("doc_id").eqNullSafe(component).alias("kept"))
