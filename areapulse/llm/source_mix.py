"""Mixing sources to target weights by a low-discrepancy schedule.

The targets follow from weights, a budget and a cap on repeats. The schedule is a list of equal slots: slot k takes the
golden-ratio point frac(k * phi), the cumulative targets map it to a source, and its rank among the source's slots names
the next block of the source's stream. The stream is the source's documents in a shuffled order, cut into blocks of an
equal number of words, and begins again when it ends. Any stretch of the schedule is close to the target mix.

Only ids and sizes are shuffled, never texts. Running totals are taken in two levels (totals per bucket of the hash or
chunk of the schedule, then inside each), so a source with a third of all rows is many groups. A block has ``least_block``
words at every size, so the number of slots grows with the corpus. What the schedule leaves a source short of its target
(late points, and slots that fell on the short last block) is taken from the next places of its stream: every source gives
its target, rounded down.

Defined cases: a null text has size 0, and documents of size 0 are never taken; a null source is a source, the last one;
repeated rows are documents of their own (equal ones are interchangeable); an empty corpus, or one without words, takes
nothing. Only the id, the text and the source are read, so other columns may have any name.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from areapulse.session import cut_lineage

PHI = 0.6180339887498949
#: Least number of cells of the unit interval in which slots meet sources, and slots per chunk.
CELLS, CHUNK = 4096, 4096
#: Slots beyond the budget, for sources whose points come late.
SPARE = 64


@dataclass(frozen=True)
class MixRule:
    """Weights in the order of the sources, repeating; the budget as a part of all words; the most often a word is taken."""

    weights: tuple[int, ...] = (5, 2, 1)
    budget_num: int = 3
    budget_den: int = 2
    repeats: int = 2
    least_block: int = 16
    seed: str = "mix"


def source_targets(sizes: DataFrame, rule: MixRule = MixRule()) -> DataFrame:
    """Targets per source from (source, source_size): adds ``idx, weight, target``.

    Shares above the cap are cut to it and the excess goes to the others by weight until none is above: with sources
    ordered by cap per weight, that is one level for all sources that stay below. One row per source.
    """
    everything = Window.partitionBy()
    ordered = Window.orderBy(F.col("source").asc_nulls_last())
    rows = sizes.withColumn("idx", F.row_number().over(ordered) - 1)
    weights = F.array(*[F.lit(w) for w in rule.weights])
    rows = rows.withColumn("weight", F.get(weights, F.col("idx") % len(rule.weights)))
    rows = rows.withColumn("cap", F.col("source_size") * rule.repeats)
    rows = rows.withColumn("ratio", F.col("cap").cast("double") / F.col("weight"))
    earlier = Window.orderBy("ratio", "idx").rowsBetween(Window.unboundedPreceding, -1)
    budget = F.sum("source_size").over(everything).cast("double") * rule.budget_num / rule.budget_den
    left = budget - F.coalesce(F.sum("cap").over(earlier), F.lit(0))
    weight_left = F.sum("weight").over(everything) - F.coalesce(F.sum("weight").over(earlier), F.lit(0))
    rows = rows.withColumn("level", left / weight_left)
    level = F.max(F.when(F.col("ratio") > F.col("level"), F.col("level"))).over(everything)
    rows = rows.withColumn("level", level)
    below = F.col("ratio") > F.col("level")
    target = F.when(below, F.col("level") * F.col("weight")).otherwise(F.col("cap").cast("double"))
    return rows.select("source", "source_size", "idx", "weight", target.alias("target"))


def mix_sources(
    docs: DataFrame, rule: MixRule = MixRule(), doc_id: str = "doc_id", text: str = "text", source: str = "source"
) -> DataFrame:
    """One row per document: ``doc_id, source, size, source_size, target, taken, offset`` (place in its source's stream)."""
    spark = docs.sparkSession
    words = F.size(F.array_remove(F.split(F.coalesce(F.col(text), F.lit("")), r"[\x20\x09-\x0D]+"), "")).cast("bigint")
    key = F.md5(F.concat(F.lit(f"{rule.seed}:"), F.coalesce(F.col(doc_id).cast("string"), F.lit(""))).cast("binary"))
    sized = docs.select(F.col(doc_id).alias("doc_id"), F.col(source).cast("string").alias("source"), words.alias("size"), key.alias("h"))
    sized = cut_lineage(sized, "mix-sizes")
    total = sized.agg(F.sum("size")).first()[0] or 0
    budget = -(-total * rule.budget_num // rule.budget_den)
    block = rule.least_block
    n_slots = -(-budget // block) + SPARE if budget else 0

    per_source = source_targets(sized.groupBy("source").agg(F.sum("size").alias("source_size")), rule)
    whole = F.floor("target").cast("bigint")
    upto = F.sum(whole).over(Window.orderBy("idx"))
    per_source = per_source.withColumns({"hi": upto, "lo": upto - whole, "all": F.sum(whole).over(Window.partitionBy())})
    per_source = cut_lineage(per_source, "mix-sources")
    n_cells = max(CELLS, per_source.count())

    # The schedule.
    scaled = per_source.where("hi > lo")
    first, last = F.floor(F.col("lo") / F.col("all") * n_cells), F.floor(F.col("hi") / F.col("all") * n_cells)
    cells = scaled.select(
        "idx", "lo", "hi", "all", "source_size", "target", F.explode(F.sequence(F.greatest(first - 1, F.lit(0)), last + 1)).alias("cell")
    )
    point = F.col("k") * F.lit(PHI)
    slots = spark.range(n_slots).select(F.col("id").alias("k")).withColumn("x", point - F.floor(point))
    slots = slots.withColumn("cell", F.floor(F.col("x") * n_cells)).join(cells, "cell")
    slots = slots.where("x * all >= lo AND x * all < hi").select("k", "idx", "source_size", "target", F.floor(F.col("k") / CHUNK).alias("chunk"))
    counts = cut_lineage(slots.groupBy("idx", "chunk").agg(F.count(F.lit(1)).alias("n")), "mix-counts")
    given = counts.groupBy("idx").agg(F.sum("n").alias("given"))
    before = Window.partitionBy("idx").orderBy("chunk").rowsBetween(Window.unboundedPreceding, -1)
    counts = counts.select("idx", "chunk", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("before"))
    inside = Window.partitionBy("idx", "chunk").orderBy("k")
    ranked = slots.withColumn("r", F.row_number().over(inside) - 1).join(counts, ["idx", "chunk"]).withColumn("r", F.col("r") + F.col("before"))
    # The slots a source still needs: whole runs through its stream have one short block each, so they are counted in blocks.
    blocks = F.ceil(F.col("source_size") / block)
    needed = F.floor(whole / F.col("source_size")) * blocks + F.ceil((whole % F.col("source_size")) / block)
    short = scaled.join(given, "idx", "left").withColumns({"given": F.coalesce("given", F.lit(0)), "needed": needed}).where("given < needed")
    short = short.select("idx", "source_size", "target", F.explode(F.expr("sequence(given, needed - 1)")).alias("r"))
    ranked = ranked.select("idx", "source_size", "target", "r").unionByName(short)
    ranked = ranked.withColumn("blocks", blocks)
    ranked = ranked.withColumns({"b": F.col("r") % F.col("blocks"), "epoch": F.floor(F.col("r") / F.col("blocks"))})
    done = F.col("epoch") * F.col("source_size") + F.col("b") * block
    ranked = ranked.withColumn("take", F.least(F.lit(block), F.floor("target").cast("bigint") - done)).where("take > 0")

    # The streams: documents in the order of their hash, with the words before each.
    sources = per_source.select(F.col("source").alias("_source"), "idx", "source_size", "target")
    placed = sized.join(sources, F.col("source").eqNullSafe(F.col("_source"))).drop("_source")
    placed = placed.withColumn("bucket", F.substring("h", 1, 3))
    totals = placed.groupBy("idx", "bucket").agg(F.sum("size").alias("n"))
    before = Window.partitionBy("idx").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    totals = totals.select("idx", "bucket", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("before"))
    inside = Window.partitionBy("idx", "bucket").orderBy("h", "size").rowsBetween(Window.unboundedPreceding, -1)
    placed = placed.withColumn("within", F.coalesce(F.sum("size").over(inside), F.lit(0))).join(totals, ["idx", "bucket"])
    placed = placed.withColumn("offset", F.col("before") + F.col("within"))
    columns = ["doc_id", "source", "size", "source_size", "target", "offset"]
    placed = cut_lineage(placed.select(*columns, "idx"), "mix-streams")

    # Blocks: the pieces of documents in each, met by the slots that take the block.
    at, past = F.col("b") * block, (F.col("b") + 1) * block
    pieces = placed.where("size > 0").withColumn(
        "b", F.explode(F.sequence(F.floor(F.col("offset") / block), F.floor((F.col("offset") + F.col("size") - 1) / block)))
    )
    pieces = pieces.withColumn("from", F.greatest("offset", at) - at)
    pieces = pieces.withColumn("n", F.least(F.col("offset") + F.col("size"), past) - at - F.col("from"))
    met = pieces.join(ranked.select("idx", "b", "take"), ["idx", "b"], "left")
    words_taken = F.greatest(F.least(F.coalesce("take", F.lit(0)) - F.col("from"), F.col("n")), F.lit(0))
    taken = met.groupBy(*columns, "idx").agg(F.sum(words_taken).cast("bigint").alias("taken"))
    empty = placed.where("size = 0").withColumn("taken", F.lit(0).cast("bigint"))
    return taken.unionByName(empty).select("doc_id", "source", "size", "source_size", "target", "taken", "offset")
