"""Text cleaning, mentions, keywords, tokens and vocabularies over the given tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from areapulse.catalog.registry import (
    ALL_STOP,
    AREAS,
    DIMENSION_WORDS,
    KEYWORDS,
    SQL_KEYWORDS,
    query,
    quoted,
    sql_clean,
    sql_has_word,
    sql_word_count,
    sql_words,
)
from areapulse.functions import text as tx
from areapulse.functions.arrays import with_computed
from areapulse.functions.text import SPACE
from areapulse.operators import keywords as kw
from areapulse.operators import reshape, tokens
from areapulse.params import DEFAULT_LANGUAGE, STOP_WORDS
from areapulse.session import cut_lineage
from areapulse.sources.tables import text_table as table


@query(
    f"""
    SELECT kind, id, CAST(length(c) AS INTEGER) AS n_chars, md5(c) AS text_hash FROM (
      SELECT 'document' AS kind, doc_id AS id, {sql_clean('text')} AS c FROM documents
      UNION ALL SELECT 'page', page_id, {sql_clean('html')} FROM pages)
    """
)
def clean_text(spark: SparkSession, sf: str) -> DataFrame:
    docs = table(spark, sf, "documents").select(F.lit("document").alias("kind"), F.col("doc_id").alias("id"), "text")
    pages = table(spark, sf, "pages").select(F.lit("page").alias("kind"), F.col("page_id").alias("id"), F.col("html").alias("text"))
    cleaned = docs.unionByName(pages).withColumn("c", tx.clean_text(F.col("text")))
    return cleaned.select("kind", "id", F.length("c").alias("n_chars"), F.md5("c").alias("text_hash"))


_ALPHA = rf"""regexp_replace(regexp_replace(coalesce(text, ''), 'http[^{SPACE}]+', '', 'g'),
              '[^a-zA-ZáéíóúüñÁÉÍÓÚÜÑ{SPACE}]', '', 'g')"""


@query(
    rf"""
    SELECT doc_id, CAST(length(c) AS INTEGER) AS n_chars, md5(c) AS text_hash
    FROM (SELECT doc_id, lower(regexp_replace({_ALPHA}, '^[{SPACE}]+|[{SPACE}]+$', '', 'g')) AS c FROM documents)
    """
)
def clean_text_alpha(spark: SparkSession, sf: str) -> DataFrame:
    cleaned = table(spark, sf, "documents").select("doc_id", tx.clean_text_alpha(F.col("text")).alias("c"))
    return cleaned.select("doc_id", F.length("c").alias("n_chars"), F.md5("c").alias("text_hash"))


@query(
    f"""
    SELECT doc_id, CAST(length(c) AS INTEGER) AS n_chars FROM (SELECT doc_id, {sql_clean('text')} AS c FROM documents)
    WHERE length(c) >= 10
    """
)
def min_length_filter(spark: SparkSession, sf: str) -> DataFrame:
    docs = table(spark, sf, "documents").select("doc_id", "text")
    return with_computed(docs, "n_chars", F.length(tx.clean_text(F.col("text")))).where("n_chars >= 10").drop("text")


SOURCE_ALIASES = {"src1": "Fuente Uno", "src2": "Fuente Dos", "src10": "Fuente Diez"}
_NFD = (("é", "é"), ("è", "è"), ("ñ", "ñ"), ("ü", "ü"), ("ç", "ç"), ("É", "É"))


def _sql_decomposed(col: str) -> str:
    for composed, apart in _NFD:
        col = f"replace({col}, '{composed}', '{apart}')"
    return col


@query(
    rf"""
    SELECT doc_id,
           CASE source WHEN 'src1' THEN 'Fuente Uno' WHEN 'src2' THEN 'Fuente Dos' WHEN 'src10' THEN 'Fuente Diez'
                ELSE source END AS area,
           md5(regexp_replace(nfc_normalize({_sql_decomposed('text')}), '^[{SPACE}]+|[{SPACE}]+$', '', 'g')) AS key_hash
    FROM documents
    """
)
def canonical_key(spark: SparkSession, sf: str) -> DataFrame:
    apart = F.col("text")
    for composed, pieces in _NFD:
        apart = F.replace(apart, F.lit(composed), F.lit(pieces))
    return table(spark, sf, "documents").select(
        "doc_id",
        reshape.canonical_key(F.concat(F.lit("  "), "source", F.lit(" ")), SOURCE_ALIASES).alias("area"),
        F.md5(reshape.canonical_key(apart, SOURCE_ALIASES)).alias("key_hash"),
    )


@query(
    r"""
    WITH l AS (SELECT o_orderpriority AS label FROM orders UNION SELECT p_type || '_' || p_brand FROM part)
    SELECT label, array_to_string(list_transform(
             regexp_extract_all(lower(replace(label, '_', ' ')), '[\p{L}]+|[^\p{L}]+'),
             lambda p: upper(p[1]) || p[2:]), '') AS title
    FROM l
    """
)
def title_label(spark: SparkSession, sf: str) -> DataFrame:
    priorities = table(spark, sf, "orders").select(F.col("o_orderpriority").alias("label")).distinct()
    types = table(spark, sf, "part").select(F.concat("p_type", F.lit("_"), "p_brand").alias("label")).distinct()
    return priorities.union(types).select("label", tx.title_label(F.col("label")).alias("title"))


_MENTIONS = "\n UNION ALL ".join(f"SELECT doc_id, '{a}' AS area FROM documents WHERE {sql_has_word('text', a)}" for a in AREAS)


@query(_MENTIONS)
def tag_area_mentions(spark: SparkSession, sf: str) -> DataFrame:
    return kw.tag_area_mentions(table(spark, sf, "documents"), "text", AREAS, ["doc_id"])


@query(
    r"""
    WITH n AS (SELECT DISTINCT regexp_extract(lower(p_name), '^[\p{L}]+') AS area FROM part
               UNION SELECT 'the' UNION SELECT 'que' UNION SELECT 'of the'),
         t AS (SELECT doc_id, ' ' || regexp_replace(lower(text), '([^\p{L}\p{N}_ ])', ' \1 ', 'g') || ' ' AS t FROM documents)
    SELECT doc_id, area FROM t, n WHERE contains(t, ' ' || area || ' ')
    """
)
def tag_area_table(spark: SparkSession, sf: str) -> DataFrame:
    # A name list that is itself a table: the first words of the part names, and some words of the prose.
    names = table(spark, sf, "part").select(F.regexp_extract(F.lower("p_name"), r"^[\p{L}]+", 0).alias("area"))
    extra = names.select(F.explode(F.array(F.lit("the"), F.lit("que"), F.lit("of the"))).alias("area"))
    return kw.tag_area_table(table(spark, sf, "documents"), "doc_id", "text", names.union(extra).distinct())


_SUBSTRINGS = ("the", "Und", "que", "zzzz")


@query(" UNION ALL ".join(f"SELECT doc_id, '{a}' AS area FROM documents WHERE contains(lower(text), '{a.lower()}')" for a in _SUBSTRINGS))
def tag_area_substring(spark: SparkSession, sf: str) -> DataFrame:
    return kw.tag_area_substring(table(spark, sf, "documents"), "text", _SUBSTRINGS, ["doc_id"])


@query("SELECT doc_id, contains(text, 'The ') OR contains(text, ' und ') OR contains(text, 'http') AS flagged FROM documents")
def contains_any(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "documents").select("doc_id", kw.contains_any(F.col("text"), ["The ", " und ", "http"]).alias("flagged"))


_COUNTS = " UNION ALL ".join(
    f"SELECT {{key}}, '{d}' AS dimension, '{w}' AS keyword, {sql_word_count('text', w)} AS c FROM {{tab}}" for d, w in KEYWORDS
)


@query(
    f"""
    SELECT source AS area, dimension, keyword, CAST(sum(c) AS BIGINT) AS count
    FROM ({_COUNTS.replace('{key}', 'source').replace('{tab}', 'documents')}) WHERE c > 0 GROUP BY 1, 2, 3
    """
)
def keyword_counts(spark: SparkSession, sf: str) -> DataFrame:
    return kw.keyword_counts(table(spark, sf, "documents"), "text", "source", kw.phrase_list(spark, KEYWORDS))


@query(
    f"""
    WITH k(dimension, keyword) AS (VALUES {SQL_KEYWORDS}), d AS (SELECT DISTINCT dimension FROM k),
         h AS (SELECT conv_id, turn, dimension, sum(c) AS c
               FROM ({_COUNTS.replace('{key}', 'conv_id, turn').replace('{tab}', 'conversations')}) WHERE c > 0 GROUP BY 1, 2, 3)
    SELECT d.dimension, CAST(coalesce(sum(c), 0) AS BIGINT) AS word_count, count(c) AS comments_count
    FROM d LEFT JOIN h USING (dimension) GROUP BY 1
    """
)
def keyword_dimension_counts(spark: SparkSession, sf: str) -> DataFrame:
    turns = table(spark, sf, "conversations")
    lookup = kw.phrase_list(spark, KEYWORDS)
    return kw.keyword_dimension_counts(turns, "text", ["conv_id", "turn"], lookup, list(DIMENSION_WORDS))


_TOTALS = ("the", "tion", "und", "zzzz")


@query(
    " UNION ALL ".join(
        f"SELECT '{k}' AS keyword, CAST(sum(len(regexp_extract_all(lower(text), '{k}'))) AS BIGINT) AS count FROM documents" for k in _TOTALS
    )
)
def substring_totals(spark: SparkSession, sf: str) -> DataFrame:
    return kw.substring_totals(table(spark, sf, "documents"), "text", _TOTALS)


def _sql_tokens(col: str) -> str:
    return (
        f"list_filter({sql_words(col)}, lambda t: t NOT IN ({quoted(ALL_STOP)}) AND length(t) > 2 "
        r"AND NOT regexp_matches(t, '\p{N}'))"
    )


@query(
    f"""
    SELECT doc_id, CAST(len(t) AS INTEGER) AS n_tokens, md5(array_to_string(t, ' ')) AS token_hash
    FROM (SELECT doc_id, {_sql_tokens('text')} AS t FROM documents)
    """
)
def tokenise_filter(spark: SparkSession, sf: str) -> DataFrame:
    docs = table(spark, sf, "documents").select("doc_id", tokens.tokenise_filter(F.col("text"), ALL_STOP).alias("t"))
    return docs.select("doc_id", F.size("t").alias("n_tokens"), F.md5(F.array_join("t", " ")).alias("token_hash"))


LEMMAS = {
    "was": "be", "is": "be", "are": "be", "les": "le", "des": "de", "una": "uno", "las": "el", "los": "el",
    "die": "der", "das": "der", "den": "der", "ones": "one",
}
LEMMA_KEYS = ("be", "el")


@query(
    f"""
    WITH m AS (SELECT MAP {{{', '.join(f"'{k}': '{v}'" for k, v in LEMMAS.items())}}} AS m),
         l AS (SELECT doc_id, list_transform({sql_words('text')}, lambda t: coalesce(m.m[t], t)) AS l FROM documents, m)
    SELECT doc_id, CAST(len(l) AS INTEGER) AS n_tokens, md5(array_to_string(l, ' ')) AS lemma_hash,
           list_has_any(l, ['be', 'el']) AS has_keyword
    FROM l
    """
)
def lemma_lookup(spark: SparkSession, sf: str) -> DataFrame:
    docs = table(spark, sf, "documents").select("doc_id", tx.words(F.col("text")).alias("t"))
    mapped = tokens.lemma_lookup(docs, "t", LEMMAS)
    return mapped.select(
        "doc_id",
        F.size("lemmas").alias("n_tokens"),
        F.md5(F.array_join("lemmas", " ")).alias("lemma_hash"),
        tokens.has_lemma(F.col("lemmas"), LEMMA_KEYS).alias("has_keyword"),
    )


@query(
    f"""
    SELECT doc_id, CAST(len(t) AS INTEGER) AS word_count FROM (SELECT doc_id, {_sql_tokens('text')} AS t FROM documents)
    WHERE len(t) >= 10
    """
)
def min_token_filter(spark: SparkSession, sf: str) -> DataFrame:
    docs = with_computed(table(spark, sf, "documents").select("doc_id", "text"), "t", tokens.tokenise_filter(F.col("text"), ALL_STOP))
    return tokens.min_token_filter(docs, "t", 10).drop("t", "text")


_HITS = ", ".join(
    f"len(list_filter(t, lambda x: x IN ({quoted(ws)}))) AS n_{lang}" for lang, ws in sorted(STOP_WORDS.items())
)


@query(
    f"""
    WITH w AS (SELECT doc_id, lang, {sql_words('text')} AS t FROM documents), h AS (SELECT doc_id, lang, {_HITS} FROM w)
    SELECT doc_id, detected, detected = lang AS agrees FROM (
      SELECT doc_id, lang, CASE greatest(n_de, n_en, n_es, n_fr) WHEN 0 THEN '{DEFAULT_LANGUAGE}' WHEN n_de THEN 'de'
             WHEN n_en THEN 'en' WHEN n_es THEN 'es' ELSE 'fr' END AS detected FROM h)
    """
)
def language_route(spark: SparkSession, sf: str) -> DataFrame:
    routed = table(spark, sf, "documents").select(
        "doc_id", "lang", tokens.language_route(F.col("text"), STOP_WORDS, DEFAULT_LANGUAGE).alias("detected")
    )
    return routed.select("doc_id", "detected", (F.col("detected") == F.col("lang")).alias("agrees"))


@query(
    rf"""
    WITH w AS (SELECT lang, unnest(regexp_extract_all(lower(text), '[\p{{L}}]+')) AS word FROM documents),
         c AS (SELECT lang, word, count(*) AS count FROM w WHERE word NOT IN ({quoted(ALL_STOP)}) AND length(word) > 2 GROUP BY 1, 2)
    SELECT lang, word, count, CAST(rank AS INTEGER) AS rank FROM (
      SELECT *, row_number() OVER (PARTITION BY lang ORDER BY count DESC, encode(word)) AS rank FROM c) WHERE rank <= 10
    """
)
def top_words_by_group(spark: SparkSession, sf: str) -> DataFrame:
    return tokens.top_words_by_group(table(spark, sf, "documents"), "text", "lang", ALL_STOP)


_GRAMS = (
    "t || list_transform(generate_series(1, len(t) - 1), lambda i: t[i] || ' ' || t[i + 1]) "
    "|| list_transform(generate_series(1, len(t) - 2), lambda i: t[i] || ' ' || t[i + 1] || ' ' || t[i + 2])"
)


@query(
    f"""
    WITH t AS (SELECT doc_id, {_sql_tokens('text')} AS t FROM documents), g AS (SELECT doc_id, {_GRAMS} AS g FROM t)
    SELECT doc_id, CAST(len(g) AS INTEGER) AS n_grams, md5(array_to_string(g, '|')) AS gram_hash FROM g
    """
)
def ngrams_1_3(spark: SparkSession, sf: str) -> DataFrame:
    grams = _grams(spark, sf)
    return grams.select("doc_id", F.size("g").alias("n_grams"), F.md5(F.array_join("g", "|")).alias("gram_hash"))


def _tokens(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "documents").select("doc_id", tokens.tokenise_filter(F.col("text"), ALL_STOP).alias("t"))


def _grams(spark: SparkSession, sf: str) -> DataFrame:
    return _tokens(spark, sf).select("doc_id", tokens.ngrams_1_3(F.col("t")).alias("g"))


MIN_DF, MAX_DF = 0.001, 0.6
_VOCAB = f"""
    t AS (SELECT doc_id, {_sql_tokens('text')} AS t FROM documents), g AS (SELECT doc_id, {_GRAMS} AS g FROM t),
    v AS (SELECT term, count(*) AS doc_freq FROM (SELECT unnest(list_distinct(g)) AS term FROM g) GROUP BY term
          HAVING count(*) >= {MIN_DF}::DOUBLE * (SELECT count(*) FROM documents)
             AND count(*) <= {MAX_DF}::DOUBLE * (SELECT count(*) FROM documents))
"""


@query(f"WITH {_VOCAB} SELECT term, doc_freq FROM v")
def vocab_prune(spark: SparkSession, sf: str) -> DataFrame:
    return tokens.ngram_vocabulary(_tokens(spark, sf), "t", (1, 2, 3), MIN_DF, MAX_DF)


@query(
    f"""
    WITH {_VOCAB}, i AS (SELECT term, row_number() OVER (ORDER BY encode(term)) - 1 AS term_id FROM v)
    SELECT doc_id, term_id, count(*) AS tf FROM (SELECT doc_id, unnest(g) AS term FROM g) JOIN i USING (term) GROUP BY 1, 2
    """
)
def doc_term_counts(spark: SparkSession, sf: str) -> DataFrame:
    # The tokens are read for the vocabulary and for the counts, the vocabulary twice; only n-grams of its words are formed.
    held = cut_lineage(_tokens(spark, sf), "tokens")
    vocabulary = cut_lineage(tokens.ngram_vocabulary(held, "t", (1, 2, 3), MIN_DF, MAX_DF), "vocabulary")
    parts = vocabulary.select(F.explode(F.split("term", " ")).alias("term"))
    grams = held.select("doc_id", tokens.frequent_ngrams(F.col("t"), (1, 2, 3), tokens.word_filter(parts)).alias("g"))
    counts = tokens.doc_term_counts(grams, "doc_id", "g", vocabulary)
    return counts.select("doc_id", F.col("term_id").cast("long").alias("term_id"), "tf")


@query(
    rf"""
    WITH w AS (SELECT source, lang, unnest(regexp_extract_all(lower(text), '[\p{{L}}]+')) AS word FROM documents),
         c AS (SELECT source, lang, word, count(*) AS n FROM w WHERE length(word) > 2 AND word NOT IN ({quoted(ALL_STOP)}) GROUP BY ALL),
         k AS (SELECT lang, word FROM (SELECT *, row_number() OVER (PARTITION BY source, lang ORDER BY n DESC, encode(word)) AS r FROM c) WHERE r <= 15),
         f AS (SELECT lang AS topic, word, count(*) AS count FROM k GROUP BY 1, 2)
    SELECT topic, word, count, CAST(rank AS INTEGER) AS rank FROM (
      SELECT *, row_number() OVER (PARTITION BY topic ORDER BY count DESC, encode(word)) AS rank FROM f) WHERE rank <= 30
    """
)
def topic_keyword_frequency(spark: SparkSession, sf: str) -> DataFrame:
    # Topic table: for each source (area) and language (topic) the joined top words.
    docs = table(spark, sf, "documents").withColumn("cell", F.struct("source", F.col("lang").alias("topic")))
    top = tokens.top_words_by_group(docs, "text", "cell", ALL_STOP, 15)
    # 15 words per cell are gathered.
    joined = top.groupBy("cell").agg(
        F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("rank", "word"))), lambda s: s["word"]), ", ").alias("keywords")
    )
    return tokens.topic_keyword_frequency(joined.select("cell.topic", "keywords"), "topic", "keywords")
