"""Personal data: patterns propose spans, checksums confirm them, words nearby adjust their score.

Each search is linear in the text: candidates are whole runs of characters, which are cut afterwards, so that a megabyte of
digits, dots or letters costs one pass. Places are code points, end exclusive.

Defined results: null counts as the empty text, which has no spans; equal rows give equal rows; null ids are carried along;
spans of different kinds may overlap, spans of one kind never do. Columns other than the id and the text are not read.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gleaner.llm.common import as_bytes, pieces

BASE_KINDS = ("email", "ip", "card", "phone")
KINDS = (*BASE_KINDS, "iban", "secret")
SPAN = "array<struct<kind:string,start:int,end:int,score:double>>"
THRESHOLD = 0.5
#: Code points before a span in which words count.
NEAR = 48

LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
DOMAIN = re.compile(r"[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
NUMBERS = re.compile(r"[0-9]++(?:\.[0-9]++)*+")
DIGITS = re.compile(r"[0-9](?:[\x20-]?[0-9])+")
PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
IBAN = re.compile(r"(?<![A-Za-z0-9])[A-Z]{2}[0-9]{2}(?: ?[A-Z0-9]){11,30}(?![A-Za-z0-9])")
SECRET = re.compile(r"(?i)(?<![a-z0-9])(?:token|secret|password|passwd|api[_ -]?key)[\"']?\s{0,3}[:=]\s{0,3}[\"']?([A-Za-z0-9_+/=-]{12,})")
SEPARATORS = str.maketrans("", "", " -().+")

#: Score of a span by itself, and words nearby that raise it.
CONTEXT = {
    "email": (0.8, re.compile(r"(?i)\b(?:e-?mail|contact|write|reach)\b")),
    "ip": (0.6, re.compile(r"(?i)\b(?:ip|host|server|address|ping)\b")),
    "card": (0.7, re.compile(r"(?i)\b(?:card|visa|mastercard|credit|payment|account)\b")),
    "phone": (0.6, re.compile(r"(?i)\b(?:phone|tel|call|mobile|fax|contact)\b")),
    "iban": (0.7, re.compile(r"(?i)\b(?:iban|bank|account|transfer)\b")),
    "secret": (0.3, re.compile(r"(?i)(?:token|secret|password|passwd|key)")),
}


def luhn(digits: str) -> bool:
    odd = sum(map(int, digits[-1::-2]))
    even = sum(sum(divmod(2 * int(d), 10)) for d in digits[-2::-2])
    return (odd + even) % 10 == 0


def mod97(value: str) -> bool:
    moved = value[4:] + value[:4]
    return int("".join(str(int(c, 36)) for c in moved)) % 97 == 1


def emails(text: str) -> Iterator[tuple[int, int]]:
    """Around each @: the run of local characters before it, back to the last span, and a dotted domain after it."""
    last, at = 0, text.find("@")
    while at >= 0:
        start = at
        while start > last and text[start - 1] in LOCAL:
            start -= 1
        if start < at and (domain := DOMAIN.match(text, at + 1)):
            last = domain.end()
            yield start, last
        at = text.find("@", at + 1)


def addresses(text: str) -> Iterator[tuple[int, int]]:
    """Runs of dotted numbers, taken four at a time."""
    for run in NUMBERS.finditer(text):
        if run.end() - run.start() < 7:
            continue
        parts = run.group().split(".")
        start = run.start()
        for k in range(0, len(parts) - 3, 4):
            four = parts[k:k + 4]
            end = start + sum(map(len, four)) + 3
            if all(len(p.lstrip("0")) <= 3 and int(p[-3:]) <= 255 for p in four):
                yield start, end
            start = end + 1


def cards(text: str) -> Iterator[tuple[int, int]]:
    for run in DIGITS.finditer(text):
        if run.end() - run.start() < 14:
            continue
        digits = run.group().translate(SEPARATORS)
        if 14 <= len(digits) <= 19 and luhn(digits):
            yield run.span()


def phones(text: str) -> Iterator[tuple[int, int]]:
    for run in PHONE.finditer(text):
        if 10 <= len(run.group().translate(SEPARATORS)) <= 15:
            yield run.span()


def ibans(text: str) -> Iterator[tuple[int, int]]:
    """The longest beginning of a run that passes, cut where no letter or digit follows."""
    for run in IBAN.finditer(text):
        for end in range(run.end(), run.start() + 14, -1):
            if end < run.end() and (text[end] != " " or text[end - 1] == " "):
                continue
            if mod97(text[run.start():end].replace(" ", "")):
                yield run.start(), end
                break


def secrets(text: str) -> Iterator[tuple[int, int]]:
    for run in SECRET.finditer(text):
        yield run.span(1)


FINDERS = (emails, addresses, cards, phones, ibans, secrets)


def find(text: str, threshold: float = THRESHOLD) -> list[dict]:
    """All spans in order of start, then kind. Confirmed base spans stay whatever their score; others need the threshold."""
    out = []
    for rank, (kind, finder) in enumerate(zip(KINDS, FINDERS)):
        alone, near = CONTEXT[kind]
        for start, end in finder(text):
            score = min(1.0, alone + (0.25 if near.search(text, max(0, start - NEAR), start) else 0.0))
            if kind in BASE_KINDS or score >= threshold:
                out.append((start, rank, {"kind": kind, "start": start, "end": end, "score": score}))
    out.sort(key=lambda x: x[:2])
    return [x[2] for x in out]


def redacted(text: str, spans: list[dict]) -> str:
    """The text with each run of touching spans replaced by the kind of its first."""
    out, done = [], 0
    for span in spans:
        if span["start"] >= done:
            out += [text[done:span["start"]], f"[{span['kind'].upper()}]"]
        done = max(done, span["end"])
    return "".join(out) + text[done:]


def find_personal_data(docs: DataFrame, threshold: float = THRESHOLD, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """``(doc_id, spans)`` per document."""
    narrow = docs.select(F.col(id_column).alias("doc_id"), F.col(text_column).cast("string").alias("text"))

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        spans_type = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int32()), ("end", pa.int32()), ("score", pa.float64())]))
        for batch in pieces(batches, "text"):
            spans = [find(t.decode(), threshold) for t in as_bytes(batch.column(1)).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(spans, spans_type)], names=["doc_id", "spans"])

    return narrow.mapInArrow(task, f"doc_id {narrow.schema['doc_id'].dataType.simpleString()}, spans {SPAN}")


def redact(docs: DataFrame, threshold: float = THRESHOLD, text_column: str = "text") -> DataFrame:
    """All columns and rows of ``docs``; personal data in the text is replaced by its kind. A null text stays null."""
    place = docs.columns.index(text_column)

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in pieces(batches, text_column):
            texts = [t if t is None else redacted(t, find(t, threshold)) for t in batch.column(place).to_pylist()]
            yield batch.set_column(place, text_column, pa.array(texts, batch.column(place).type))

    return docs.mapInArrow(task, docs.schema)


def as_text(spans: Column) -> Column:
    """``kind:start:end`` of each span, comma-joined."""
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"], s["end"])), ",")
