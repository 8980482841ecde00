"""From the documents table to token files: five stages, each an operator of ``areapulse.llm`` over all rows of the one before.

Every stage but the last returns the columns of documents. Texts may be null, ids may be null or repeat, and a table may be
empty; what each stage then does is said in its docstring. SQL cannot express the learned and the encoding stage, so the
pipeline is tested against a brute-force version.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from areapulse.llm.common import unused
from areapulse.llm.decontaminate import cut_spans, find_passages
from areapulse.llm.jaccard_join import Threshold, similar_documents
from areapulse.llm.queries import TOXIC_FROM, token_digests
from areapulse.llm.quality_rules import words_of
from areapulse.llm.source_mix import mix_sources
from areapulse.llm.toxicity import fit_toxicity, fold
from areapulse.session import cut_lineage

Stage = Callable[[SparkSession, DataFrame, str], DataFrame]


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose calibrated toxicity is below the threshold. Empty and null texts are scored like any other."""
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet").where(fold("doc_id") != 2)
    scored = fit_toxicity(docs, labels).score(docs, docs.columns)
    return scored.where(F.col("score") < TOXIC_FROM).select("doc.*")


def keep_one_of_group(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each class of near-duplicates (5-word shingles, similarity 0.8): the one with the smallest id.

    Documents without words are in no class and stay. Rows of one id and one text are one document; rows without an id
    stay, once per text, if no document of their class has an id.
    """
    root, h, n = unused(docs, "root", "h", "n")
    roots = similar_documents(docs, Threshold(5, 4, 5)).where(F.col("doc_id").eqNullSafe(F.col("component_id")))
    roots = roots.select(F.col("doc_id").alias(root)).distinct()
    kept = docs.join(roots, F.col("doc_id").eqNullSafe(F.col(root)), "left_semi").withColumn(h, F.xxhash64("text"))
    first = F.row_number().over(Window.partitionBy("doc_id", h).orderBy(h))
    return kept.withColumn(n, first).where(F.col(n) == 1).drop(h, n)


def decontaminate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents with less than a twentieth of their words in benchmark passages; passages in those are cut out.

    ``n_chars`` follows the text. Documents without words are clean.
    """
    benchmark = spark.read.parquet(f"{sf_dir}/benchmark.parquet")
    (spans,) = unused(docs, "spans")
    found = find_passages(docs, benchmark, docs.columns)
    clean = found.where((F.col("n_hit") == 0) | (F.col("n_hit") * 20 < F.col("n_words"))).select("doc.*", F.col("spans").alias(spans))
    cut = F.size(spans) > 0
    clean = clean.withColumn("text", F.when(cut, cut_spans("text", spans)).otherwise(F.col("text")))
    if "n_chars" in docs.columns:
        length = F.length("text").cast(docs.schema["n_chars"].dataType)
        clean = clean.withColumn("n_chars", F.when(cut, length).otherwise(F.col("n_chars")))
    return clean.drop(spans)


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as the mix takes them: the words taken over the words held, rounded.

    A document of which the mix takes less than half, and one without words, is left out. Equal rows share their number.
    """
    size = F.size(words_of(F.coalesce(F.col("text"), F.lit("")))).cast("bigint")
    i, s, z, copies, rows, own_size, n, copy = unused(docs, "i", "s", "z", "copies", "rows", "size", "n", "copy")
    taken = mix_sources(docs).where("size > 0").withColumn("c", F.floor((F.col("taken") * 2 + F.col("size")) / (F.col("size") * 2)))
    plan = taken.groupBy(F.col("doc_id").alias(i), F.col("source").alias(s), F.col("size").alias(z))
    plan = plan.agg(F.sum("c").alias(copies), F.count(F.lit(1)).alias(rows)).where(F.col(copies) > 0)
    sized = docs.withColumn(own_size, size)
    same = F.col("doc_id").eqNullSafe(F.col(i)) & F.col("source").eqNullSafe(F.col(s)) & (F.col(own_size) == F.col(z))
    met = sized.join(plan, same).withColumn(n, F.row_number().over(Window.partitionBy("doc_id", "source", own_size).orderBy("text")))
    own = F.floor(F.col(copies) / F.col(rows)) + F.when(F.col(n) <= F.col(copies) % F.col(rows), 1).otherwise(0)
    repeated = met.withColumn(copy, F.explode(F.array_repeat(F.lit(1), own.cast("int"))))
    return repeated.drop(i, s, z, copies, rows, own_size, n, copy)


def tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token files of all documents, and per document where its ids start, how many they are and their checksum."""
    return token_digests(spark, docs)


STAGES: list[tuple[str, Stage]] = [
    ("toxicity", drop_toxic),
    ("jaccard_join", keep_one_of_group),
    ("decontaminate", decontaminate),
    ("source_mix", mix),
    ("token_codes", tokens),
]
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the documents, each written and read again before the next."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES:
        docs = cut_lineage(stage(spark, docs, sf_dir), name)
    return docs
