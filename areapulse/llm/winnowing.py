"""Document fingerprints by winnowing, in native expressions.

Every run of ``gram`` words of a text has a polynomial hash; of every ``window`` neighbouring hashes the smallest is kept, the
rightmost of equal ones, with its position. Two texts that share a run of ``window + gram - 1`` words share a kept hash, and no
kept hash stands for less than ``gram`` of them. Arrays have no running state in Spark, so the hash does not roll along the
text but up: each pass makes the hashes of 4 (or 2) times as many words from sums of those below, and window minima rise the
same way, which takes a number of passes that is logarithmic in the sizes. All of it happens in the row; whole texts are used.

``with_next`` puts the following text beside each, in descending order of ids, with one shuffle of the texts: rows are dealt
into ranges between sampled keys, and the first row of each range is also the last of the range before.

Defined cases: a null text is an empty one; a text without words has an empty fingerprint; fewer words than a gram are filled up
with zeros and have one hash; two empty fingerprints have a likeness of 1, an empty and another one of 0; ids that are null
come last, equal ids are ordered by the text's hash, rows of one id and one text are neighbours in one range; the only row
follows itself; an empty table has no rows. Very long texts take some 100 bytes a word while they are worked on. Columns are
picked by name, so others may clash with results.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from areapulse.llm.quality_rules import words_of

#: Prime modulus of the hash: four products of two numbers below it stay within 64 bits.
PRIME = (1 << 29) - 3
BASE = 1_000_003
_LOW = (1 << 32) - 1


@dataclass(frozen=True)
class WinnowRule:
    """Words of a gram and hashes of a window: powers of 2."""

    gram: int = 4
    window: int = 4

    def __post_init__(self) -> None:
        if any(n < 1 or n & (n - 1) for n in (self.gram, self.window)):
            raise ValueError("gram and window are powers of 2")


def rises(size: int) -> list[tuple[int, int]]:
    """(entries joined, distance between them) of each pass from 1 up to ``size``."""
    out, span = [], 1
    while span < size:
        step = 4 if span * 4 <= size else 2
        out.append((step, span))
        span *= step
    return out


def _summed(a: Column, step: int, span: int) -> Column:
    """Hashes of ``step * span`` words from those of ``span``."""
    power = [pow(BASE, span * (step - 1 - j), PRIME) for j in range(step)]

    def total(x: Column, i: Column) -> Column:
        for j in range(step):
            part = (F.get(a, i + j * span) if j else x) * F.lit(power[j])
            out = out + part if j else part
        return out % F.lit(PRIME)

    kept = F.slice(a, F.lit(1), F.greatest(F.size(a) - (step - 1) * span, F.lit(0)))
    return F.transform(kept, total)


def _least(a: Column, step: int, span: int) -> Column:
    """Minima of ``step * span`` entries from those of ``span``; windows end with the array."""
    return F.transform(a, lambda x, i: F.least(x, *[F.get(a, i + j * span) for j in range(1, step)]))


def with_fingerprint(df: DataFrame, text: str, hashes: str, positions: str | None = None, rule: WinnowRule = WinnowRule()) -> DataFrame:
    """Adds the kept hashes (array of bigint) and, if named, their positions (array of int), in order of position."""
    made = f"_{hashes}_made"
    listed = F.transform(words_of(F.coalesce(F.col(text), F.lit(""))), lambda w: F.crc32(w.cast("binary")) % F.lit(PRIME))
    df = df.withColumn(made, listed)
    n = F.size(made)
    short = F.when(n > 0, F.greatest(F.lit(rule.gram) - n, F.lit(0))).otherwise(0)
    df = df.withColumn(made, F.concat(made, F.array_repeat(F.lit(0).cast("bigint"), short)))
    a = F.col(made)
    for step, span in rises(rule.gram):
        df = df.withColumn(made, _summed(a, step, span))
    # Hash above, position below, counted from the right: the smallest number is the smallest hash, rightmost of equals.
    df = df.withColumn(made, F.transform(a, lambda x, i: x * F.lit(_LOW + 1) + (F.lit(_LOW) - i)))
    # A text of fewer hashes than a window is one window.
    windows = F.least(F.size(a), F.greatest(F.size(a) - rule.window + 1, F.lit(1)))
    df = df.withColumn(f"{made}_n", windows)
    for step, span in rises(rule.window):
        df = df.withColumn(made, _least(a, step, span))
    df = df.withColumn(made, F.array_distinct(F.slice(a, F.lit(1), F.col(f"{made}_n"))))
    df = df.withColumn(hashes, F.transform(a, lambda v: F.shiftright(v, 32)))
    if positions:
        df = df.withColumn(positions, F.transform(a, lambda v: (F.lit(_LOW) - v.bitwiseAND(F.lit(_LOW))).cast("int")))
    return df.drop(made, f"{made}_n")


def fingerprints(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", rule: WinnowRule = WinnowRule()) -> DataFrame:
    """One row per document: ``doc_id, n_chars, hashes, positions``."""
    rows = docs.select(F.col(doc_id).alias("doc_id"), F.coalesce(F.col(text), F.lit("")).alias("text"))
    made = with_fingerprint(rows, "text", "hashes", "positions", rule)
    return made.select("doc_id", F.length("text").cast("bigint").alias("n_chars"), "hashes", "positions")


def likeness(a: Column, b: Column) -> Column:
    """Distinct hashes that both have over those that either has."""
    common = F.size(F.array_intersect(a, b))
    either = F.size(F.array_distinct(a)) + F.size(F.array_distinct(b)) - common
    return F.when(either == 0, F.lit(1.0)).otherwise(common / either)


def written(hashes: Column) -> Column:
    """Hashes in hexadecimal digits, joined by commas."""
    return F.array_join(F.transform(hashes, lambda h: F.hex(h)), ",")


def with_next(
    docs: DataFrame, doc_id: str = "doc_id", text: str = "text", ranges: int | None = None, rule: WinnowRule | None = None
) -> DataFrame:
    """``doc_id, text, next_text`` in descending order of ids, the first row following the last; null texts are empty.

    With ``rule`` also ``hashes`` and ``next_hashes``, computed once a text, behind the shuffle. The ranges, four to a shuffle
    partition unless given, lie between keys of a sample: sixteen keys a range, those with the smallest hashes.
    """
    spark = docs.sparkSession
    partitions = int(spark.conf.get("spark.sql.shuffle.partitions"))
    ranges = ranges or 4 * partitions
    rows = docs.select(F.col(doc_id).alias("doc_id"), F.coalesce(F.col(text), F.lit("")).alias("text"))
    keyed = rows.withColumn("_h", F.xxhash64("text"))
    key = F.struct(F.col("doc_id").alias("i"), F.col("_h").alias("h"))
    keys = keyed.select(key.alias("k"))
    sample = keys.orderBy(F.xxhash64("k")).limit(16 * ranges).distinct().collect()
    first = keys.agg(F.max("k")).first()[0]
    ordered = sorted((r["k"] for r in sample), key=lambda k: (k["i"] is not None, 0 if k["i"] is None else k["i"], k["h"]), reverse=True)
    separators = [k for k in ordered[:: max(1, len(ordered) // ranges)][1:] if k != first]
    id_type = docs.schema[doc_id].dataType.simpleString()

    def literal(found: list) -> Column:
        """A constant array of keys; SQL text, since it is one call for thousands of them."""
        if not found:
            return F.lit(None).cast(f"array<struct<i:{id_type},h:bigint>>")
        name = lambda i: "NULL" if i is None else "'" + str(i).replace("\\", "\\\\").replace("'", "\\'") + "'"
        parts = (f"struct(CAST({name(k['i'])} AS {id_type}) AS i, {k['h']}L AS h)" for k in found)
        return F.expr(f"array({', '.join(parts)})")

    listed = literal(separators)
    # Range of a key: how many separators are not below it, by binary search.
    steps = [1 << b for b in reversed(range(len(separators).bit_length()))] or [1]
    at = F.aggregate(
        F.lit(steps), F.lit(0), lambda low, step: F.when(F.get(listed, low + step - 1) >= F.col("_k"), low + step).otherwise(low)
    )
    dealt = keyed.withColumn("_k", key).withColumn("_range", at)
    copies = F.array(
        F.struct(F.col("_range").alias("at"), F.lit(False).alias("copy")),
        F.when(F.get(listed, F.col("_range") - 1).eqNullSafe(F.col("_k")), F.struct((F.col("_range") - 1).alias("at"), F.lit(True).alias("copy"))),
        F.when(F.get(literal([first] if first else []), F.lit(0)).eqNullSafe(F.col("_k")), F.struct(F.lit(len(separators)).alias("at"), F.lit(True).alias("copy"))),
    )
    dealt = dealt.withColumn("_to", F.explode(F.filter(copies, lambda c: c.isNotNull())))
    dealt = dealt.select("doc_id", "text", "_k", F.col("_to.at").alias("_range"), F.col("_to.copy").alias("_copy"))
    # A stated number of partitions: the work behind the shuffle is far larger than its bytes.
    placed = dealt.repartition(partitions, "_range").sortWithinPartitions("_range", "_copy", F.desc("_k"))
    if rule:
        placed = with_fingerprint(placed, "text", "hashes", None, rule)
    order = Window.partitionBy("_range").orderBy("_copy", F.desc("_k"))
    ahead = [F.lead("text").over(order).alias("next_text")] + ([F.lead("hashes").over(order).alias("next_hashes")] if rule else [])
    kept = ["doc_id", "text"] + (["hashes"] if rule else [])
    return placed.select(*kept, "_copy", *ahead).where(~F.col("_copy")).drop("_copy")


def edited(text: Column, following: Column) -> Column:
    """The text with its second half (code points, rounded down) replaced by as many of the following text."""
    half = F.floor(F.length(text) / 2).cast("int")
    return F.concat(F.substring(text, F.lit(1), F.length(text) - half), F.substring(following, F.lit(1), half))
