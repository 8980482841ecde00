"""Token work: filters, lemmas, languages, n-grams and vocabularies."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from areapulse.functions.arrays import bind, explode_once, word_ngrams
from areapulse.functions.text import letter_words, words
from areapulse.operators.ranking import number_rows


def tokenise_filter(text: Column, stop: Sequence[str]) -> Column:
    """Token array without stop words, tokens with a digit and tokens of one or two characters."""
    return F.filter(words(text), lambda t: ~t.isin(list(stop)) & (F.length(t) > 2) & ~t.rlike(r"\p{N}"))


def dictionary_value(token: Column, entries: Mapping[str, str]) -> Column:
    """Value of a token in a dictionary, null without one: binary search over the sorted entries, held as two constant arrays.

    The steps grow with the logarithm of the dictionary; the plan is the same for every size.
    """
    if any("\0" in part for entry in entries.items() for part in entry):
        raise ValueError("dictionary entries cannot hold a zero character")
    ordered = sorted(entries.items(), key=lambda e: e[0].encode())
    # One literal each: splitting a constant is folded when the query is planned.
    names, values = (F.split(F.lit("\0".join(e[i] for e in ordered)), "\0") for i in (0, 1))
    steps = F.array(*[F.lit(1 << b) for b in reversed(range(max(1, len(ordered).bit_length())))])
    upto = F.aggregate(steps, F.lit(0), lambda n, step: F.when(F.get(names, n + step - 1) <= token, n + step).otherwise(n))
    return bind(upto, lambda n: F.when(F.get(names, n - 1) == token, F.get(values, n - 1)))


def lemma_lookup(df: DataFrame, tokens: str, lemmas: Mapping[str, str], out: str = "lemmas") -> DataFrame:
    """Token array to lemma array, row by row; tokens without an entry stay, and so do nulls."""
    if not lemmas:
        return df.withColumn(out, F.col(tokens))
    return df.withColumn(out, F.transform(tokens, lambda t: F.coalesce(dictionary_value(t, lemmas), t)))


def has_lemma(lemmas: Column, keywords: Sequence[str]) -> Column:
    """Whether any lemma is a keyword."""
    return F.exists(lemmas, lambda t: t.isin(list(keywords)))


def min_token_filter(df: DataFrame, tokens: str, least: int) -> DataFrame:
    """``word_count`` column, rows with at least ``least`` words."""
    return df.withColumn("word_count", F.size(tokens)).where(F.col("word_count") >= least)


def language_route(text: Column, stop_words: Mapping[str, Sequence[str]], default: str) -> Column:
    """Language with the most stop-word hits; the default without hits, alphabetical order on ties.

    Counted inside the row: no explode and no shuffle.
    """

    def hits(tokens: Column, listed: Sequence[str]) -> Column:
        return F.size(F.filter(tokens, lambda t: t.isin(list(listed))))

    def best(tokens: Column) -> Column:
        counts = [
            F.struct(hits(tokens, ws).alias("n"), F.lit(-i).alias("order"), F.lit(lang).alias("lang"))
            for i, (lang, ws) in enumerate(sorted(stop_words.items()))
        ]
        return F.array_max(F.array(*counts))

    return bind(
        bind(words(text), best), lambda b: F.when(b["n"] > 0, b["lang"]).otherwise(F.lit(default))
    )


def top_words_by_group(df: DataFrame, text: str, group: str, stop: Sequence[str], n: int = 10) -> DataFrame:
    """Most frequent words per group; ties by word."""
    tokens = F.filter(letter_words(F.col(text)), lambda t: ~t.isin(list(stop)) & (F.length(t) > 2))
    counted = explode_once(df, [group], tokens, "word").groupBy(group, "word").agg(F.count(F.lit(1)).alias("count"))
    order = Window.partitionBy(group).orderBy(F.desc("count"), F.asc("word"))
    return counted.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= n)


def ngrams_1_3(tokens: Column) -> Column:
    """Word n-grams of length 1 to 3."""
    return word_ngrams(tokens, (1, 2, 3))


def vocab_prune(df: DataFrame, terms: str, min_df: float, max_df: float) -> DataFrame:
    """(term, doc_freq) of the terms whose share of documents lies in [min_df, max_df].

    At most mean-terms-per-text / min_df terms can pass, whatever the number of texts.
    """
    n_docs = df.agg(F.count(F.lit(1)).alias("n"))
    freq = explode_once(df, [], F.array_distinct(terms), "term").groupBy("term").agg(F.count(F.lit(1)).alias("doc_freq"))
    n = n_docs.scalar()
    return freq.where((F.col("doc_freq") >= F.lit(min_df) * n) & (F.col("doc_freq") <= F.lit(max_df) * n))


# Slots of the word filter: a fixed size, whatever the vocabulary.
WORD_SLOTS = 1 << 20


def _slot(word: Column) -> Column:
    return F.pmod(F.xxhash64(word), F.lit(WORD_SLOTS))


def word_filter(listed: DataFrame) -> bytes:
    """The slots that the words of a column ``term`` fall into, one byte each.

    It lets a few other words through, which later counts drop, and never loses a listed one. The driver gets at most
    ``WORD_SLOTS`` slot numbers.
    """
    slots = listed.select(_slot(F.col("term")).alias("s")).distinct().toArrow()["s"].to_pylist()
    out = bytearray(WORD_SLOTS)
    for s in slots:
        out[s] = 1
    return bytes(out)


def frequent_ngrams(tokens: Column, lengths: Sequence[int], frequent: bytes) -> Column:
    """Word n-grams made of words that pass a ``word_filter`` only."""
    passed = F.lit(bytearray(frequent))

    def of_length(t: Column, n: int) -> Column:
        none = F.array().cast("array<int>")
        starts = F.when(F.size(t) >= n, F.sequence(F.lit(0), F.size(t) - n)).otherwise(none)
        # Joining with a null word gives null.
        return F.transform(starts, lambda i: reduce(lambda a, k: F.concat(a, F.lit(" "), t[i + k]), range(1, n), t[i]))

    one = F.lit(bytearray(b"\x01"))
    marked = F.transform(tokens, lambda w: F.when(F.substring(passed, (_slot(w) + 1).cast("int"), F.lit(1)) == one, w))
    return F.array_compact(bind(marked, lambda t: F.concat(*[of_length(t, n) for n in lengths])))


def ngram_vocabulary(df: DataFrame, tokens: str, lengths: Sequence[int], min_df: float, max_df: float, least: int = 1) -> DataFrame:
    """``vocab_prune`` of the word n-grams of a token column; a term is in ``least`` texts at least.

    An n-gram is never in more texts than its rarest word. So the words are counted first, and only n-grams of words that
    reach ``min_df`` are formed, shuffled and counted; the result is the same and most n-grams never leave their task.
    """
    n = df.count()
    low = F.greatest(F.lit(min_df) * n, F.lit(float(least)))
    each = explode_once(df, [], F.array_distinct(tokens), "term").groupBy("term").agg(F.count(F.lit(1)).alias("doc_freq"))
    grams = frequent_ngrams(F.col(tokens), lengths, word_filter(each.where(F.col("doc_freq") >= low)))
    freq = explode_once(df, [], F.array_distinct(grams), "term").groupBy("term").agg(F.count(F.lit(1)).alias("doc_freq"))
    return freq.where((F.col("doc_freq") >= low) & (F.col("doc_freq") <= F.lit(max_df) * n))


def doc_term_counts(df: DataFrame, key: str, terms: str, vocabulary: DataFrame) -> DataFrame:
    """(key, term_id, tf) with term ids in alphabetical order of the vocabulary.

    Terms outside the vocabulary leave before the count; the vocabulary is numbered by ranges.
    """
    ids = number_rows(vocabulary.select("term"), "term", "term_id")
    at = explode_once(df, [key], terms, "term").join(ids, "term")
    return at.groupBy(key, "term_id").agg(F.count(F.lit(1)).alias("tf"))


def topic_keyword_frequency(topics: DataFrame, topic: str, keywords: str, n: int = 30) -> DataFrame:
    """How often each word is a keyword of a topic over all areas; the ``n`` most frequent per topic, ties by word."""
    counted = (
        explode_once(topics, [topic], F.split(keywords, ", "), "word")
        .groupBy(topic, "word")
        .agg(F.count(F.lit(1)).alias("count"))
    )
    order = Window.partitionBy(topic).orderBy(F.desc("count"), F.asc("word"))
    return counted.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= n)
