"""Suffix arrays of text collections by induced sorting, with queues that go to disk.

Every text ends in a separator (symbol 0); separators differ from each other in the order of their places. Suffixes are
classed (larger or smaller than the next), the left-most smaller ones (LMS) are ordered, and all others are induced from
them: in order of first symbols, each suffix taken from the queue of its symbol puts the suffix before it into the queue of
that one's symbol. What is taken is taken in batches: a queue is emptied at once, which may fill it again (a wave). Queues
beyond a memory bound are kept in an unnamed file of the task and read back in order.

LMS suffixes are ordered by their LMS substrings, which the same induction sorts; where substrings repeat, the string of
their names is ordered by doubling ranks.
"""

from __future__ import annotations

import tempfile

import numpy as np

#: Suffixes that queues hold in memory, 4 bytes each.
IN_MEMORY = 8 << 20


class Queues:
    """First-in first-out queues of places, one per symbol."""

    def __init__(self, symbols: int, in_memory: int = IN_MEMORY):
        self.parts: list[list] = [[] for _ in range(symbols)]
        self.limit, self.held, self.file = in_memory, 0, None

    def put(self, symbol: int, places: np.ndarray) -> None:
        if self.held + len(places) > self.limit:
            self.file = self.file or tempfile.TemporaryFile()
            at = self.file.seek(0, 2)
            self.file.write(places.tobytes())
            self.parts[symbol].append((at, len(places), places.dtype))
        else:
            self.held += len(places)
            self.parts[symbol].append(places)

    def deal(self, symbols: np.ndarray, places: np.ndarray) -> None:
        """Put each place into its symbol's queue, in order."""
        if len(places):
            order = np.argsort(symbols, kind="stable")
            places, counts = places[order], np.bincount(symbols)
            ends = np.cumsum(counts)
            for symbol in np.nonzero(counts)[0].tolist():
                self.put(symbol, places[ends[symbol] - counts[symbol]:ends[symbol]])

    def take(self, symbol: int) -> np.ndarray | None:
        """All places of a queue, which is empty then; None if it was."""
        parts, self.parts[symbol] = self.parts[symbol], []
        if not parts:
            return None
        out = []
        for part in parts:
            if isinstance(part, tuple):
                self.file.seek(part[0])
                out.append(np.frombuffer(self.file.read(part[1] * part[2].itemsize), part[2]))
            else:
                self.held -= len(part)
                out.append(part)
        return out[0] if len(out) == 1 else np.concatenate(out)


def smaller_than_next(text: np.ndarray) -> np.ndarray:
    """Whether each suffix is smaller than the next one."""
    starts = np.concatenate(([0], np.nonzero(text[1:] != text[:-1])[0] + 1))
    heads = text[starts].astype(np.int16)
    return np.repeat(np.concatenate((heads[1:] > heads[:-1], [True])), np.diff(np.concatenate((starts, [len(text)]))))


def _split(text: np.ndarray, places: np.ndarray, symbols: int) -> list[np.ndarray]:
    of = text[places]
    order = np.argsort(of, kind="stable")
    return np.split(places[order], np.cumsum(np.bincount(of, minlength=symbols))[:-1])


def induce(text: np.ndarray, lms: np.ndarray, in_memory: int = IN_MEMORY) -> np.ndarray:
    """The suffixes in order, given the LMS suffixes in order (within a symbol, as far as they are)."""
    symbols = int(text.max()) + 1
    seeds = _split(text, lms, symbols)
    larger: list[list[np.ndarray]] = [[] for _ in range(symbols)]
    queues = Queues(symbols, in_memory)

    def before(places: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        places = places[places > 0] - 1
        return text[places], places

    for symbol in range(symbols):
        while (wave := queues.take(symbol)) is not None:
            larger[symbol].append(wave)
            of, places = before(wave)
            up = of >= symbol
            queues.deal(of[up], places[up])
        if len(seeds[symbol]):
            of, places = before(seeds[symbol])
            up = of > symbol
            queues.deal(of[up], places[up])

    out: list[list[np.ndarray]] = [[] for _ in range(symbols)]  # from the last suffix to the first
    for symbol in range(symbols - 1, 0, -1):
        while (wave := queues.take(symbol)) is not None:
            out[symbol].append(wave)
            of, places = before(wave)
            down = (of <= symbol) & (of > 0)
            queues.deal(of[down], places[down])
        for wave in reversed(larger[symbol]):
            wave = wave[::-1]
            out[symbol].append(wave)
            of, places = before(wave)
            down = (of < symbol) & (of > 0)
            queues.deal(of[down], places[down])
    out[0] = [seeds[0][::-1]]
    return np.concatenate([wave[::-1] for parts in out for wave in reversed(parts)])


def _names(text: np.ndarray, ordered: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """Numbers of the LMS substrings that begin at ``ordered``: equal ones have the same. ``lengths`` by place in ``ordered``."""
    same = np.zeros(len(ordered), bool)
    pairs = np.nonzero((lengths[1:] == lengths[:-1]) & (text[ordered[1:]] > 0))[0] + 1
    at = 0
    while len(pairs):
        a, b = text[ordered[pairs] + at], text[ordered[pairs - 1] + at]
        pairs = pairs[(a == b) & (a > 0)]
        done = lengths[pairs] == at + 1
        same[pairs[done]] = True
        pairs = pairs[~done]
        at += 1
    return np.cumsum(~same) - 1


def _order_by_doubling(names: np.ndarray) -> np.ndarray:
    """Order of the suffixes of a string of names, in which some name that stands once ends all that repeats."""
    rank, step = names.astype(np.int64), 1
    counts = np.bincount(rank)
    rank = (np.cumsum(counts) - counts)[rank]  # a group's rank is the number of suffixes before it
    active = np.nonzero(counts[names] > 1)[0]
    while len(active):
        ahead = active + step
        after = np.where(ahead < len(rank), rank[np.minimum(ahead, len(rank) - 1)], -1)
        order = np.lexsort((after, rank[active]))
        active, after = active[order], after[order]
        group = rank[active]
        first = np.concatenate(([True], group[1:] != group[:-1]))
        new = first | np.concatenate(([True], after[1:] != after[:-1]))
        place = np.arange(len(active))
        base = np.maximum.accumulate(np.where(first, place, 0))
        head = np.maximum.accumulate(np.where(new, place, 0))
        rank[active] = group + head - base
        alone = new & np.concatenate((new[1:], [True]))
        active = active[~alone]
        step *= 2
    order = np.empty(len(rank), np.int64)
    order[rank] = np.arange(len(rank))
    return order


def suffix_array(text: np.ndarray, in_memory: int = IN_MEMORY) -> np.ndarray:
    """Places of all suffixes in order. ``text``: symbols from 1, and 0 after each text, never twice in a row."""
    if not len(text):
        return np.zeros(0, np.int32)
    kind = np.int32 if len(text) < 1 << 31 else np.int64
    smaller = smaller_than_next(text)
    lms = np.nonzero(smaller[1:] & ~smaller[:-1])[0].astype(kind) + kind(1)
    number = np.full(len(text), -1, kind)
    number[lms] = np.arange(len(lms), dtype=kind)
    ordered = induce(text, lms, in_memory)
    ordered = ordered[number[ordered] >= 0]
    lengths = np.diff(np.concatenate((lms, [len(text)]))) + 1
    lengths[-1] = 1
    names = np.empty(len(lms), np.int64)
    names[number[ordered]] = _names(text, ordered, lengths[number[ordered]])
    if names.max(initial=-1) + 1 < len(names):
        ordered = lms[_order_by_doubling(names)]
    return induce(text, ordered, in_memory)
