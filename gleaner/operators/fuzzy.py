"""Names within a small edit distance of each other, exactly and without comparing all pairs.

A name of more than ``SHORT`` letters is cut into two segments more than the distance. At most as many segments as there are
edits can be changed by them, so at least two stand unchanged in any name within the distance, at most a few places away. An
inverted index on (length, segment number, segment) leaves out each name's commonest segment: one of the other two is still
there, and what all names of a site have in common is no key. Names are looked up with their substrings at the places where
an unchanged segment can stand: a number of substrings that depends on the distance and not on the length of a name.

Shorter names are joined on their deletion variants: two strings within distance ``d`` share a string that each of them
becomes by deleting at most ``d`` characters. Of a pair, the length of the shorter name decides which way it is found.
Candidates are verified with ``levenshtein`` and its threshold.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Names of up to so many letters are found through deletion variants.
SHORT = 8
#: Names under one key that a task meets at once; more are cut into blocks that are looked up one by one.
BLOCK = 2048


def _deletions(name: Column) -> Column:
    """``name`` and every string made by deleting one character of it."""
    each = F.transform(
        F.sequence(F.lit(1), F.greatest(F.length(name), F.lit(1))),
        lambda i: F.concat(F.substring(name, F.lit(1), i - 1), F.substring(name, i + 1, F.length(name))),
    )
    return F.array_distinct(F.concat(F.array(name), each))


def _variants(names: DataFrame, distance: int) -> DataFrame:
    """``(name, key)`` rows; the variant is hashed, since the candidates are verified anyway."""
    variants = F.array(F.col("name"))
    for _ in range(distance):
        variants = F.array_distinct(F.flatten(F.transform(variants, _deletions)))
    exploded = names.select("name", F.explode(variants).alias("text"))
    return exploded.select("name", F.xxhash64("text").alias("key"))


def _cut(length: str, parts: int) -> tuple[str, str]:
    """SQL for the place (from 0) and the length of segment ``j`` of a name: the last ones are longer by one where it is needed."""
    base, plain = f"({length} div {parts})", f"({parts} - {length} % {parts})"
    return f"(j * {base} + greatest(j - {plain}, 0))", f"({base} + if(j >= {plain}, 1, 0))"


def _indexed(names: DataFrame, distance: int) -> DataFrame:
    """``(name, key)``: each name under all its segments but the commonest one."""
    parts = distance + 2
    place, size = _cut("n", parts)
    cut = names.select("name", F.length("name").alias("n"), F.explode(F.sequence(F.lit(0), F.lit(parts - 1))).alias("j"))
    cut = cut.select("name", "j", F.expr(f"xxhash64(n, j, substring(name, {place} + 1, {size}))").alias("key"))
    common = cut.groupBy("key").agg(F.count(F.lit(1)).alias("names"))
    of_name = Window.partitionBy("name").orderBy(F.desc("names"), "j")  # at most ``parts`` rows each
    return cut.join(common, "key").withColumn("nth", F.row_number().over(of_name)).filter("nth > 1").select("name", "key")


def _looked_up(names: DataFrame, distance: int) -> DataFrame:
    """``(name, key)``: the substrings of each name at which an unchanged segment of a name of its length or a little less can stand."""
    parts = distance + 2
    moves = [(less, move) for less in range(distance + 1) for move in range(-distance, distance + 1) if abs(move) + abs(less - move) <= distance]
    place, size = _cut("n", parts)
    each = names.select("name", F.length("name").alias("length"), F.explode(F.expr("array(" + ", ".join(f"struct({a} AS less, {b} AS move)" for a, b in moves) + ")")).alias("m"))
    each = each.select("name", "length", (F.col("length") - F.col("m.less")).alias("n"), "m.move", F.explode(F.sequence(F.lit(0), F.lit(parts - 1))).alias("j"))
    each = each.filter(F.col("n") > SHORT).select("name", "length", "n", "j", F.expr(f"{place} + move").alias("at"), F.expr(size).alias("size"))
    each = each.filter((F.col("at") >= 0) & (F.col("at") + F.col("size") <= F.col("length")))
    return each.select("name", F.expr("xxhash64(n, j, substring(name, at + 1, size))").alias("key")).distinct()


def _candidates(shorter: DataFrame, longer: DataFrame, distance: int) -> DataFrame:
    """``(name, other)``: candidates with ``name`` of ``shorter``, which is no longer than ``other`` of ``longer``."""
    def met(indexed: DataFrame, asked: DataFrame) -> DataFrame:
        held = indexed.groupBy("key").agg(F.ceil(F.count(F.lit(1)) / BLOCK).alias("blocks"))
        under = indexed.join(held, "key").withColumn("block", F.pmod(F.xxhash64("name"), F.col("blocks")))
        looked = asked.join(held, "key").select(F.col("name").alias("other"), "key", F.explode(F.expr("sequence(0L, blocks - 1)")).alias("block"))
        return under.join(looked, ["key", "block"]).select("name", "other")

    few = met(_variants(shorter.filter(F.length("name") <= SHORT), distance), _variants(longer.filter(F.length("name") <= SHORT + distance), distance))
    many = met(_indexed(shorter.filter(F.length("name") > SHORT), distance), _looked_up(longer.filter(F.length("name") > SHORT), distance))
    return few.union(many).filter(F.length("name") <= F.length("other"))


def _verified(candidates: DataFrame, distance: int) -> DataFrame:
    """``(name, other, distance)``. Verified first, so that only true pairs are shuffled to be made distinct."""
    measured = candidates.select("name", "other", F.levenshtein("name", "other", distance).alias("distance"))
    return measured.filter(F.col("distance") >= 0).distinct()


def similar_pairs(names: DataFrame, name: str, distance: int = 1) -> DataFrame:
    """``(left_name, right_name, distance)`` for distinct names at most ``distance`` edits apart, each pair once. Null is no name."""
    own = names.select(F.col(name).alias("name")).filter("name is not null").distinct()
    pairs = _candidates(own, own, distance).filter((F.length("name") < F.length("other")) | (F.col("name") < F.col("other")))
    return _verified(pairs, distance).select(F.least("name", "other").alias("left_name"), F.greatest("name", "other").alias("right_name"), "distance")


def search(asked: DataFrame, names: DataFrame, name: str, distance: int = 1) -> DataFrame:
    """``(left_name, right_name, distance)`` with ``left_name`` from ``asked`` and ``right_name`` from ``names``."""
    left, right = (df.select(F.col(name).alias("name")).filter("name is not null").distinct() for df in (asked, names))
    longer = _verified(_candidates(right, left, distance), distance).select(F.col("other").alias("left_name"), F.col("name").alias("right_name"), "distance")
    shorter = _candidates(left, right, distance).filter(F.length("name") < F.length("other"))
    return longer.union(_verified(shorter, distance).select(F.col("name").alias("left_name"), F.col("other").alias("right_name"), "distance"))
