"""Queries of this package over the given tables, with their SQL where SQL can express them."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from areapulse.llm import sql
from areapulse.llm.common import documents
from areapulse.llm.decontaminate import find_passages
from areapulse.llm.jaccard_join import Threshold, similar_documents
from areapulse.llm.language_id import fit_languages, identify_languages
from areapulse.llm.middle_fill import fill_in_middle, restored
from areapulse.llm.quality_rules import clean_lines
from areapulse.llm.secret_scan import find_secrets, written
from areapulse.llm.source_mix import mix_sources
from areapulse.llm.substring_dedup import repeated_passages
from areapulse.llm.token_codes import read_tokens, write_tokens
from areapulse.llm.toxicity import fit_toxicity, fold
from areapulse.llm.turn_repair import damaged, repair_report
from areapulse.llm.url_rules import judge_urls
from areapulse.llm.winnowing import WinnowRule, edited, likeness, with_fingerprint, with_next
from areapulse.llm.winnowing import written as hash_list

#: Documents of this score or more count as toxic.
TOXIC_FROM = 0.3

Query = Callable[[SparkSession, str], DataFrame]


def op1_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Line-first cleaning of every document."""
    rows = clean_lines(documents(spark, sf_dir))
    return rows.select(
        "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "n_clean_words"
    )


def op2_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Secrets in every document."""
    rows = find_secrets(documents(spark, sf_dir)).select("doc_id", "spans")
    base = F.filter("spans", lambda s: s["kind"].isin("assign", "access", "hex"))
    count = lambda kind: F.size(F.filter("spans", lambda s: s["kind"] == kind)).cast("bigint")
    return rows.select(
        "doc_id",
        *[count(k).alias(f"n_{k}") for k in ("assign", "access", "hex")],
        F.sha2(written(base), 256).alias("base_sha256"),
        written(F.col("spans")).alias("spans"),
    )


def op3_source_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Words of every document in the mix."""
    return mix_sources(documents(spark, sf_dir)).select("doc_id", "size", "source_size", "target", "taken")


def op4_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Passages of 50 words or more that another document holds too; documents without one have no row."""
    return repeated_passages(documents(spark, sf_dir))


def op5_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Language of every document, learned from those outside the held-out fold."""
    docs = documents(spark, sf_dir)
    model = fit_languages(docs.where(fold("doc_id", 5) != 0))
    rows = identify_languages(docs, model)
    held_out = F.coalesce(fold("doc_id", 5) == 0, F.lit(False))
    return rows.select("doc_id", held_out.alias("held_out"), "lang_pred", "score", "bits_per_byte")


def op6_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Calibrated toxicity of every document."""
    docs, labels = documents(spark, sf_dir), spark.read.parquet(f"{sf_dir}/labels.parquet")
    model = fit_toxicity(docs, labels.where(fold("doc_id") != 2))
    rows = model.score(docs, ["doc_id"]).select("doc.doc_id", "score")
    held_out = F.coalesce(fold("doc_id") == 2, F.lit(False))
    return rows.select("doc_id", held_out.alias("held_out"), "score", (F.col("score") >= TOXIC_FROM).cast("int").alias("predicted"))


#: Tokenizer and end id of the token files.
TOKENIZER, END_ID = "word_bpe_49k.json", 2


def op7_token_codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Token files of all documents, written and read back."""
    return token_digests(spark, documents(spark, sf_dir))


def token_digests(spark: SparkSession, docs: DataFrame) -> DataFrame:
    """Per document: where its ids start, how many they are and their checksum."""
    rows = read_tokens(spark, write_tokens(docs, public_tokenizers.path(TOKENIZER), END_ID))
    return rows.select("doc_id", "start", "n_tokens", F.crc32("ids").alias("ids_crc32"))


def op8_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Passages of the benchmark in every document."""
    rows = find_passages(documents(spark, sf_dir), spark.read.parquet(f"{sf_dir}/benchmark.parquet"), ["doc_id"])
    return rows.select(
        "doc.doc_id",
        "n_words",
        "n_hit",
        F.size("items").cast("long").alias("n_items"),
        F.sha2(F.array_join("items", ","), 256).alias("items_sha256"),
        ((F.col("n_hit") > 0) & (F.col("n_hit") * 20 >= F.col("n_words"))).alias("contaminated"),
    )


def op9_url_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A verdict on every page's url; a page is bad by the label of its id."""
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet")
    labels = labels.select(F.col("doc_id").alias("page_id"), ((F.col("quality") == 0) | (F.col("toxic") == 1)).alias("bad"))
    rows = judge_urls(spark.read.parquet(f"{sf_dir}/pages.parquet"), labels)
    return rows.select("page_id", "host", "path", "rule", "verdict", "n_mined")


def op10_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Classes of documents whose sets of 3-word shingles have a similarity of 0.9 or more."""
    return similar_documents(documents(spark, sf_dir), Threshold(3, 9, 10))


def op11_middle_fill(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document as a fill-in-the-middle text, and the text that comes back from it."""
    rows = fill_in_middle(documents(spark, sf_dir))
    return rows.select(
        "doc_id",
        "n",
        "form",
        "prefix_chars",
        "middle_chars",
        F.sha2("output", 256).alias("output_sha256"),
        F.sha2(restored(F.col("output"), F.col("form")), 256).alias("restored_sha256"),
    )


def op12_winnowing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fingerprints of every document and of its edited text, and how alike they are."""
    rows = with_next(documents(spark, sf_dir), rule=WinnowRule())
    rows = rows.withColumn("edited", edited(F.col("text"), F.col("next_text")))
    rows = with_fingerprint(rows, "edited", "edited_hashes")
    return rows.select(
        "doc_id",
        F.length("text").cast("bigint").alias("n_chars"),
        F.sha2("edited", 256).alias("edited_sha256"),
        hash_list(F.col("hashes")).alias("fingerprint"),
        hash_list(F.col("edited_hashes")).alias("edited_fingerprint"),
        likeness(F.col("hashes"), F.col("edited_hashes")).alias("near_edited"),
        likeness(F.col("hashes"), F.col("next_hashes")).alias("near_next"),
    )


def op13_turn_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Repair of every conversation after planted damage."""
    rows, alive = damaged(spark.read.parquet(f"{sf_dir}/conversations.parquet"))
    return repair_report(rows, alive)


QUERIES: dict[str, Query] = {
    f.__name__: f
    for f in (
        op1_quality_rules,
        op2_secret_scan,
        op3_source_mix,
        op4_substring_dedup,
        op5_language_id,
        op6_toxicity,
        op7_token_codes,
        op8_decontaminate,
        op9_url_rules,
        op10_jaccard_join,
        op11_middle_fill,
        op12_winnowing,
        op13_turn_repair,
    )
}
SQL: dict[str, str] = {name: text for name, text in sql.SQL.items() if name in QUERIES}
