"""Area mentions and keyword counts.

Word lists are configuration. One tokenising pass plus a hash lookup replaces one regex scan per list entry: tokens and
word n-grams are exploded inside the scan stage and looked up in the list; only hits leave the stage.
"""

from __future__ import annotations

import re
from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from areapulse.functions.arrays import bind, explode_once, word_ngrams
from areapulse.functions.text import WORD, nfc, nfc_text, word_pattern, words
from areapulse.operators.sizing import BROADCAST_ROWS, local_table


@dataclass(frozen=True)
class PhraseList:
    """(dimension, phrase) pairs of the configuration as a lookup table.

    ``plain`` are single words, which a token comparison settles; ``keys`` are the word sequences of everything else,
    which only propose an entry.
    """

    table: DataFrame
    plain: tuple[str, ...]
    keys: tuple[str, ...]


def phrase_list(spark: SparkSession, phrases: Sequence[tuple[str, str]]) -> PhraseList:
    """Lookup for (dimension, phrase) pairs."""
    rows = []
    for dimension, phrase in phrases:
        tokens = re.findall(r"\w+", phrase.lower())
        rows.append((dimension, phrase, " ".join(tokens), len(tokens), tokens == [phrase.lower()]))
    table = local_table(spark, rows, "dimension string, phrase string, phrase_key string, n_words int, plain boolean")
    return PhraseList(
        F.broadcast(table) if len(rows) <= BROADCAST_ROWS else table,
        tuple(sorted({r[2] for r in rows if r[4]})),
        tuple(sorted({r[2] for r in rows if not r[4]})),
    )


def _exact_hits(text: Column, phrase: Column) -> Column:
    """Whole-word occurrences of a phrase column in lowered text."""
    pattern = F.concat(F.lit(r"(?<![\p{L}\p{N}_])\Q"), F.lower(phrase), F.lit(r"\E(?![\p{L}\p{N}_])"))
    return F.regexp_count(F.lower(text), pattern).cast("long")


def find_phrases(df: DataFrame, text: str, phrases: PhraseList, keep: Sequence[str]) -> DataFrame:
    """Rows (keep..., dimension, phrase, hits) of the list entries found as whole words, case-blind.

    A plain word gives one row per occurrence, a longer entry one row per text with its number of occurrences; sum the
    hits. Tokens are compared with the list inside the row, so only hits are exploded, and only texts that hold the word
    sequence of a longer entry are searched for it.
    """
    lengths = sorted({k.count(" ") + 1 for k in phrases.keys})

    def hits(t: Column, low: Column) -> Column:
        none = F.lit(None).cast("string")
        plain = F.filter(t, lambda w: w.isin(list(phrases.plain))) if phrases.plain else F.array().cast("array<string>")
        found = F.transform(plain, lambda w: F.struct(w.alias("phrase_key"), none.alias("in_text")))
        if not phrases.keys:
            return found
        proposed = F.array_intersect(word_ngrams(t, lengths), F.array(*[F.lit(k) for k in phrases.keys]))
        return F.concat(found, F.transform(proposed, lambda k: F.struct(k.alias("phrase_key"), low.alias("in_text"))))

    composed = bind(nfc(F.col(text)), lambda c: bind(words(c), lambda t: hits(t, F.lower(c))))
    rows = explode_once(df, keep, composed, "_hit")
    rows = rows.select(*keep, "_hit.*").withColumn("plain", F.col("in_text").isNull())
    joined = rows.join(phrases.table, ["phrase_key", "plain"])
    n = F.when(F.col("plain"), F.lit(1).cast("long")).otherwise(_exact_hits(F.col("in_text"), F.col("phrase")))
    return joined.select(*keep, "dimension", "phrase", n.alias("hits")).where("hits > 0")


def tag_area_mentions(df: DataFrame, text: str, areas: Sequence[str], keep: Sequence[str]) -> DataFrame:
    """One row per text and area named in it as whole words, case-blind; an area inside another one counts too.

    The list is short, so each text is tested in place and exploded: no join. One expression of all names tells texts
    that hold none, which are most.
    """
    any_name = rf"(?iU)(?<!{WORD})({'|'.join(re.escape(nfc_text(a)) for a in areas)})(?!{WORD})"

    def found(t: Column) -> Column:
        each = F.array_compact(F.array(*[F.when(t.rlike(word_pattern(nfc_text(a))), F.lit(a)) for a in areas]))
        return F.when(t.rlike(any_name), each)

    names = bind(nfc(F.col(text)), found)
    return explode_once(df, keep, names, "area")


def _surfaces(low: Column, lengths: Sequence[int]) -> Column:
    """Distinct runs of so many pieces that begin and end with a word, as written: words and what stands between them."""

    def runs(pieces: Column, first: Column, n: int) -> Column:
        last = F.size(pieces) - (n - 1)
        starts = F.when(last >= first, F.sequence(first, last, F.lit(2))).otherwise(F.array().cast("array<int>"))
        return F.transform(starts, lambda i: F.array_join(F.slice(pieces, i, n), ""))

    def all_runs(pieces: Column) -> Column:
        first = F.when(F.get(pieces, F.lit(0)).rlike(rf"^{WORD}"), F.lit(1)).otherwise(F.lit(2))
        return F.array_distinct(F.concat(*[runs(pieces, first, n) for n in lengths]))

    return bind(F.regexp_extract_all(low, F.lit(rf"({WORD}+|[^\p{{L}}\p{{N}}_]+)"), 1), all_runs)


def tag_area_table(df: DataFrame, key: str, text: str, areas: DataFrame) -> DataFrame:
    """(key, area) as in ``tag_area_mentions`` for a long list held in a table with a column ``area``.

    A name that begins and ends with a word is found as it is written: the runs of words and separators of each text are
    made in its scan and joined with the names, so the cost of a text does not depend on the list and no text is shuffled.
    The name side is broadcast by adaptive execution if its size allows. Only for names that begin or end with another
    character, which no run can show, is the text carried along to be searched.
    """
    low = F.lower(nfc(F.col("area")))
    pieces = F.size(F.regexp_extract_all(low, F.lit(rf"({WORD}+|[^\p{{L}}\p{{N}}_]+)"), 1))
    names = areas.select("area", low.alias("_name"), pieces.alias("_pieces"))
    framed = F.col("_name").rlike(rf"(?s)^{WORD}(.*{WORD})?\z")
    shapes = names.groupBy(framed.alias("framed"), "_pieces").agg(F.lit(1)).collect()
    lengths = sorted(r["_pieces"] for r in shapes if r["framed"])
    rows = df.select(key, F.lit(None).cast("string").alias("area")).where(F.lit(False))
    composed = nfc(F.col(text))
    if lengths:
        runs = explode_once(df, [key], _surfaces(F.lower(composed), lengths), "_name")
        rows = rows.unionByName(runs.join(names.where(framed), "_name").select(key, "area"))
    if any(r["framed"] is False for r in shapes):
        tokens = words(F.col("area"))
        odd = names.where(~framed).select("area", F.array_join(tokens, " ").alias("_gram"), F.size(tokens).alias("_n"))
        counts = sorted(r["_n"] for r in odd.where("_n > 0").select("_n").distinct().collect())
        if counts:
            held = df.select(key, composed.alias("_text"))
            grams = F.array_distinct(word_ngrams(words(F.col("_text")), counts))
            proposed = explode_once(held, [key, "_text"], grams, "_gram").join(odd, "_gram")
            rows = rows.unionByName(proposed.where(_exact_hits(F.col("_text"), F.col("area")) > 0).select(key, "area"))
    return rows


def tag_area_substring(df: DataFrame, text: str, areas: Sequence[str], keep: Sequence[str]) -> DataFrame:
    """One row per text and area whose name occurs anywhere in the lowered text."""
    low = F.lower(text)
    names = F.array_compact(F.array(*[F.when(low.contains(a.lower()), F.lit(a)) for a in areas]))
    return explode_once(df, keep, names, "area")


def contains_any(text: Column, targets: Sequence[str]) -> Column:
    """Whether the text holds any target string."""
    flag = F.lit(False)
    for t in targets:
        flag = flag | text.contains(t)
    return F.coalesce(flag, F.lit(False))


def keyword_counts(df: DataFrame, text: str, area: str, lookup: PhraseList) -> DataFrame:
    """Whole-word occurrences per (area, dimension, keyword); only those found."""
    hits = find_phrases(df, text, lookup, [area])
    return hits.groupBy(F.col(area).alias("area"), "dimension", F.col("phrase").alias("keyword")).agg(F.sum("hits").alias("count"))


def keyword_dimension_counts(df: DataFrame, text: str, key: Sequence[str], lookup: PhraseList, dimensions: Sequence[str]) -> DataFrame:
    """Per dimension: occurrences and texts with at least one; 0 for a dimension never met."""
    hits = find_phrases(df, text, lookup, key)
    per_text = hits.groupBy(*key, "dimension").agg(F.sum("hits").alias("hits"))
    counted = per_text.groupBy("dimension").agg(F.sum("hits").alias("word_count"), F.count(F.lit(1)).alias("comments_count"))
    grid = local_table(df.sparkSession, [(d,) for d in dimensions], "dimension string")
    return grid.join(counted, "dimension", "left").na.fill(0, ["word_count", "comments_count"])


def substring_totals(df: DataFrame, text: str, keywords: Sequence[str]) -> DataFrame:
    """Raw substring occurrences per keyword over the whole corpus, in one pass."""
    low = F.lower(text)
    sums = [
        F.sum((F.length(low) - F.length(F.replace(low, F.lit(k), F.lit("")))) / len(k)).cast("long").alias(f"k{i}")
        for i, k in enumerate(keywords)
    ]
    pairs = F.array(*[F.struct(F.lit(k).alias("keyword"), F.coalesce(f"k{i}", F.lit(0)).alias("count")) for i, k in enumerate(keywords)])
    return df.agg(*sums).select(F.inline(pairs))
