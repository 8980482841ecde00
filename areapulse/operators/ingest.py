"""Ingest hygiene: dedupe, insert, update, identify, chunk, flatten, cap, extract."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from areapulse.functions.text import SPACE
from areapulse.operators.ranking import number_rows


def dedupe_keep_last(df: DataFrame, key: str | Sequence[str], order: str) -> DataFrame:
    """Last record per key; keys may be dotted paths.

    The ``== 1`` filter becomes a group limit below the exchange, so each task ships one row per key however often
    a key occurs.
    """
    keys = [key] if isinstance(key, str) else list(key)
    last = Window.partitionBy(*[F.col(k) for k in keys]).orderBy(F.col(order).desc())
    return df.withColumn("_rn", F.row_number().over(last)).where("_rn = 1").drop("_rn")


def dedupe_keep_first(df: DataFrame, key: str | Sequence[str], order: str) -> DataFrame:
    """First record per key."""
    keys = [key] if isinstance(key, str) else list(key)
    first = Window.partitionBy(*[F.col(k) for k in keys]).orderBy(F.col(order).asc())
    return df.withColumn("_rn", F.row_number().over(first)).where("_rn = 1").drop("_rn")


def insert_new_only(stored: DataFrame, incoming: DataFrame, key: str, order: str) -> DataFrame:
    """Incoming records with an unseen key, one per key (the last one); a null key is a key like any other."""
    known = stored.select(F.col(key).alias("_seen"))
    return dedupe_keep_last(incoming, key, order).join(known, F.col(key).eqNullSafe(F.col("_seen")), "left_anti")


def update_set_by_key(df: DataFrame, patch: DataFrame, key: str, columns: Sequence[str]) -> DataFrame:
    """Set the given columns from the patch where it has a value; one patch row per key."""
    new = patch.select(key, *[F.col(c).alias(f"_new_{c}") for c in columns])
    joined = df.join(new, key, "left")
    kept = [F.coalesce(F.col(f"_new_{c}"), F.col(c)).alias(c) if c in columns else F.col(c) for c in df.columns]
    return joined.select(*kept)


def rename_to_id(df: DataFrame, name: str) -> DataFrame:
    """A key column becomes ``_id``."""
    return df.withColumnRenamed(name, "_id")


def assign_row_ids(df: DataFrame, key: str) -> DataFrame:
    """``_id`` = 0-based position in key order, gapless."""
    return number_rows(df, key, "_id")


def content_hash_id(col: Column) -> Column:
    """SHA-256 of the URL."""
    return F.sha2(col, 256)


def date_chunks(df: DataFrame, start: str, end: str, days: int) -> DataFrame:
    """Each row's [start, end) in chunks of ``days`` days, the last one clipped: chunk_no, chunk_start, chunk_end."""
    whole = F.sequence(F.col(start), F.col(end) - F.expr("interval 1 second"), F.expr(f"interval {days} days"))
    return df.select("*", F.posexplode(whole).alias("chunk_no", "chunk_start")).withColumn(
        "chunk_end", F.least(F.col("chunk_start") + F.expr(f"interval {days} days"), F.col(end))
    )


def chunk_range_join(df: DataFrame, ts: str, start: str, end: str, days: int) -> DataFrame:
    """Chunk number per record, half-open. Equal chunks make the range join plain arithmetic: no join, no shuffle."""
    first = F.lit(start).cast("timestamp_ntz")
    inside = (F.col(ts) >= first) & (F.col(ts) < F.lit(end).cast("timestamp_ntz"))
    seconds = F.unix_micros(F.col(ts).cast("timestamp")) - F.unix_micros(first.cast("timestamp"))
    return df.where(inside).withColumn("chunk_no", F.floor(seconds / F.lit(days * 86_400_000_000)).cast("int"))


def flatten_thread(parents: DataFrame, children: DataFrame, key: str, title: str, description: str, text: str) -> DataFrame:
    """One row per text: ``title + ". " + description`` of each parent, and each child.

    Parents and children stay flat; no thread is gathered into one row, however long it is.
    """
    head = parents.select(
        F.col(key),
        F.lit(True).alias("is_parent"),
        F.concat(F.coalesce(F.col(title), F.lit("")), F.lit(". "), F.coalesce(F.col(description), F.lit(""))).alias("text"),
    )
    return head.unionByName(children.select(F.col(key), F.lit(False).alias("is_parent"), F.col(text).alias("text")))


def flatten_nested(posts: DataFrame, key: str = "_id", text: str = "text", children: str = "comments") -> DataFrame:
    """Stored posts with a comment array to one row per text."""
    head = F.array(F.struct(F.lit(True).alias("is_parent"), F.col(text).alias("text")))
    tail = F.transform(children, lambda c: F.struct(F.lit(False).alias("is_parent"), c["text"].alias("text")))
    both = F.concat(head, tail)
    return posts.select(F.col(key), F.inline(F.coalesce(both, head)))


def cap_children(df: DataFrame, parent: str, order: str, n: int) -> DataFrame:
    """First ``n`` children per parent. The cap itself is the feature; the limit runs below the exchange."""
    first = Window.partitionBy(parent).orderBy(order)
    return df.withColumn("_rn", F.row_number().over(first)).where(F.col("_rn") <= n).drop("_rn")


def pending_work(df: DataFrame, content: str, urls: Sequence[str]) -> DataFrame:
    """Rows without content, with ``effective_url`` = first non-empty URL."""
    blank = F.col(content).isNull() | (F.col(content) == "")
    return df.where(blank).withColumn("effective_url", F.coalesce(*[F.nullif(F.col(u), F.lit("")) for u in urls]))


# Parts of a page that are not main text.
DROPPED_BLOCKS = ("script", "style", "head", "nav", "header", "footer", "aside", "form", "noscript", "table")
# Tags that end a line.
LINE_TAGS = "p|br|div|li|h1|h2|h3|h4|h5|h6|article|section|ul|ol|tr|blockquote|pre"
# Entities, the ampersand last so that a decoded one is not read again.
ENTITIES = (("&nbsp;", " "), ("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&#39;", "'"), ("&apos;", "'"), ("&amp;", "&"))


def extract_main_text(html: Column) -> Column:
    """Main text of a page, without comments, tables and page furniture; one line per block."""
    c = F.coalesce(html, F.lit(""))
    c = F.regexp_replace(c, r"(?s)<!--.*?-->", "")
    for tag in DROPPED_BLOCKS:
        c = F.regexp_replace(c, rf"(?is)<{tag}(?:\s[^>]*)?>.*?</{tag}\s*>", " ")
    article = F.regexp_extract(c, r"(?is)<article(?:\s[^>]*)?>(.*)</article\s*>", 1)
    c = F.when(article != "", article).otherwise(c)
    c = F.regexp_replace(c, rf"(?i)</?(?:{LINE_TAGS})(?:\s[^>]*)?/?>", "\n")
    c = F.regexp_replace(c, r"<[^>]*>", "")
    for entity, char in ENTITIES:
        c = F.replace(c, F.lit(entity), F.lit(char))
    c = F.regexp_replace(c, r"[ \t]+", " ")
    c = F.regexp_replace(c, r" ?\n[ \n]*", "\n")
    return F.regexp_replace(c, rf"^[{SPACE}]+|[{SPACE}]+$", "")
