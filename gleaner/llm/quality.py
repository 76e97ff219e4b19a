"""Quality rules: a ledger of failure bits and measurements, and policies applied to it.

Every rule is evaluated once per document. The ledger keeps what was measured and one bit per rule that failed, so that a
policy (a versioned set of rules) is a bit mask: applying another policy, or asking what a single rule costs, reads the
ledger only. All of it is native: measurements are taken inside the row, nothing is shuffled but counts per bit pattern.

Defined results: a null text has no words; a document without a word fails ``few_words``; equal rows give equal rows;
null ids are carried along; an empty table gives an empty ledger. Columns other than the id and the text are not read.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gleaner.llm.common import SPACE

WINDOW = 5


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body`` of a value that is worked out once per row."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def words_of(text: Column) -> Column:
    """Words of a text; none for null."""
    trimmed = F.btrim(F.coalesce(text, F.lit("")), F.lit(" \t\n\x0b\f\r"))
    return let(trimmed, lambda t: F.when(t == "", F.array().cast("array<string>")).otherwise(F.split(t, rf"[{SPACE}]+")))


def window_hashes(words: Column, size: int) -> Column:
    """A hash of each run of ``size`` words, in order; none if there are fewer words. Words are hashed once each."""
    each = lambda h: F.transform(F.sequence(F.lit(0), F.size(h) - size),
                                 lambda i: F.xxhash64(*(F.get(h, i + k) for k in range(size))))
    return F.when(F.size(words) < size, F.array().cast("array<bigint>")).otherwise(
        let(F.transform(words, lambda w: F.xxhash64(w)), each))


def _covered(starts: Column) -> Column:
    """Words under windows that begin at these ascending places."""
    widths = F.transform(starts, lambda p, k: F.least(F.lit(WINDOW), F.coalesce(F.get(starts, k + 1) - p, F.lit(WINDOW))))
    return F.aggregate(widths, F.lit(0), lambda total, width: total + width)


def _repeated(hashes: Column) -> Column:
    """Words under windows found twice or more. Sorting is left to the few texts that repeat a window at all."""
    placed = F.sort_array(F.transform(hashes, lambda h, i: F.struct(h.alias("h"), i.alias("i"))))

    def starts(rows: Column) -> Column:
        twice = F.filter(rows, lambda x, k: (x["h"] == F.get(rows, k + 1)["h"]) | ((k > 0) & (x["h"] == F.get(rows, k - 1)["h"])))
        return F.sort_array(F.transform(twice, lambda x: x["i"]))

    return F.when(F.size(F.array_distinct(hashes)) == F.size(hashes), F.lit(0)).otherwise(
        let(let(placed, starts), _covered))


def measure(docs: DataFrame, id_column: str = "doc_id", text_column: str = "text", carry: bool = False) -> DataFrame:
    """One row per document with what the rules are about; all counts are long. ``carry`` adds the whole row as ``row``."""
    carried = [F.struct(*(F.col(f"`{c}`") for c in docs.columns)).alias("row")] if carry else []
    text = F.coalesce(F.col(text_column), F.lit(""))
    lines = F.filter(F.split(text, "\n"), lambda line: line.rlike(rf"[^{SPACE}]"))
    split = docs.select(
        *carried, F.col(id_column).alias("doc_id"), words_of(text).alias("words"), lines.alias("lines"),
        F.regexp_count(text, F.lit(r"[#*$%&|<>]")).alias("n_symbols"),
        F.length(F.regexp_replace(text, r"[^\p{Lu}]+", "")).alias("n_upper"),
    )
    counts = split.select(
        *["row"] * carry, "doc_id", F.size("words").alias("n_words"), F.length(F.array_join("words", "")).alias("word_chars"), "n_symbols",
        (F.size("lines") - F.size(F.array_distinct("lines"))).alias("n_dup_lines"),
        let(window_hashes(F.col("words"), WINDOW), _repeated).alias("n_repeat_words"),
        F.size("lines").alias("n_lines"), "n_upper",
    )
    return counts.select(*(c if c in ("row", "doc_id") else F.col(c).cast("long").alias(c) for c in counts.columns))


@dataclass(frozen=True)
class Rule:
    """A rule's bit is for ever: retire a rule by leaving it out of policies, never by giving its bit to another."""

    name: str
    bit: int
    fails: Callable[[], Column]


# Ratios are integer comparisons, so that any engine decides them alike.
RULES = (
    Rule("few_words", 0, lambda: F.col("n_words") < 10),
    Rule("repeated_windows", 1, lambda: 100 * F.col("n_repeat_words") > 20 * F.col("n_words")),
    Rule("symbols", 2, lambda: 100 * F.col("n_symbols") > 25 * F.col("n_words")),
    Rule("repeated_lines", 3, lambda: 100 * F.col("n_dup_lines") > 50 * F.col("n_lines")),
    Rule("shouting", 4, lambda: 100 * F.col("n_upper") > 40 * F.col("word_chars")),
    Rule("word_length", 5, lambda: (F.col("word_chars") < 2 * F.col("n_words")) | (F.col("word_chars") > 25 * F.col("n_words"))),
)


@dataclass(frozen=True)
class Policy:
    version: int
    rules: tuple[str, ...]

    @property
    def mask(self) -> int:
        bits = {rule.name: rule.bit for rule in RULES}
        return sum(1 << bits[name] for name in set(self.rules))


BASE = Policy(1, ("few_words", "repeated_windows"))
STANDARD = Policy(2, tuple(rule.name for rule in RULES))


def ledger(docs: DataFrame, rules: tuple[Rule, ...] = RULES, id_column: str = "doc_id", text_column: str = "text",
           carry: bool = False) -> DataFrame:
    """Measurements of every document, and ``fail_bits``: a bit for each rule that it fails."""
    bits = [F.when(rule.fails(), F.lit(1 << rule.bit)).otherwise(F.lit(0)).cast("long") for rule in rules]
    total = bits[0]
    for bit in bits[1:]:
        total = total.bitwiseOR(bit)
    return measure(docs, id_column, text_column, carry).withColumn("fail_bits", total)


def apply_policy(rows: DataFrame, policy: Policy) -> DataFrame:
    """Adds the verdict of a policy: ``kept``, its version, and the rule that alone rejects the document, if one does."""
    failed = F.col("fail_bits").bitwiseAND(F.lit(policy.mask))
    sole = F.coalesce(*(F.when(failed == (1 << rule.bit), F.lit(rule.name)) for rule in RULES))
    return (rows.withColumn("base_failed", F.col("fail_bits").bitwiseAND(F.lit(BASE.mask)) != 0)
            .withColumn("kept", failed == 0).withColumn("sole_rule", sole).withColumn("policy", F.lit(policy.version)))


def ablate(rows: DataFrame, policy: Policy) -> DataFrame:
    """For each rule of a policy: documents that fail it, and documents that would be kept without it.

    Documents are counted per bit pattern first, at most one row per pattern and task; the rules then read patterns.
    """
    mask = F.lit(policy.mask)
    patterns = rows.groupBy(F.col("fail_bits").bitwiseAND(mask).alias("bits")).agg(F.count(F.lit(1)).alias("n"))
    named = [F.struct(F.lit(r.name).alias("rule"), F.lit(1 << r.bit).cast("long").alias("bit")) for r in RULES if r.name in policy.rules]
    each = patterns.select("bits", "n", F.inline(F.array(*named)))
    hit = F.col("bits").bitwiseAND(F.col("bit")) != 0
    return each.groupBy("rule").agg(
        F.sum(F.when(hit, F.col("n")).otherwise(0)).alias("n_failed"),
        F.sum(F.when(F.col("bits") == F.col("bit"), F.col("n")).otherwise(0)).alias("n_sole"),
        F.bit_or("bits").alias("seen_bits"))
