"""Blocks of web pages and the main text that their scores leave."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from areapulse.catalog.registry import query
from areapulse.functions.arrays import with_computed
from areapulse.functions.text import SPACE
from areapulse.operators import blocks
from areapulse.operators.ingest import DROPPED_BLOCKS, ENTITIES
from areapulse.sources.tables import table


def _sql_page(col: str) -> str:
    s = rf"regexp_replace(translate(coalesce({col}, ''), chr(1) || chr(2), '  '), '[{SPACE}]+', ' ', 'g')"
    s = rf"regexp_replace({s}, '<!--.*?-->', '', 'g')"
    for tag in DROPPED_BLOCKS:
        s = rf"regexp_replace({s}, '(?i)<{tag}(?:\s[^>]*)?>.*?</{tag}\s*>', ' ', 'g')"
    return s


def _sql_marked(col: str) -> str:
    s = rf"regexp_replace(regexp_replace({col}, '{blocks.LINK}', chr(1), 'g'), '(?i)</a\s*>', chr(2), 'g')"
    s = rf"regexp_replace({s}, '(?i)</?(?:{blocks.BLOCK_TAGS})(?:\s[^>]*)?/?>', chr(10), 'g')"
    s = rf"regexp_replace({s}, '<[^>]*>', '', 'g')"
    for entity, char in ENTITIES:
        literal = "'" + char.replace("'", "''") + "'"
        s = f"replace({s}, '{entity}', {literal})"
    return s


_END = "CASE WHEN instr(x, chr(2)) > 0 THEN instr(x, chr(2)) WHEN instr(x, chr(10)) > 0 THEN instr(x, chr(10)) ELSE length(x) + 1 END"
_BLOCKS = rf"""
    a AS (SELECT page_id, {_sql_page('html')} AS page FROM pages),
    e AS (SELECT page_id, page, regexp_extract(page, '{blocks.ARTICLE}', 1) AS art FROM a),
    m AS (SELECT page_id, {_sql_marked("CASE WHEN art <> '' THEN art ELSE page END")} AS marked FROM e),
    l AS (SELECT page_id, string_split(array_to_string(list_transform(string_split(marked, chr(1)), lambda x, i:
            CASE WHEN i = 1 THEN x ELSE chr(1) || replace(substr(x, 1, {_END} - 1), chr(10), chr(2) || chr(10) || chr(1)) || chr(2)
              || substr(x, {_END}) END), ''), chr(10)) AS lines FROM m),
    t AS (SELECT page_id, list_filter(list_transform(lines, lambda b: struct_pack(
            t := trim(regexp_replace(translate(b, chr(1) || chr(2), ''), ' +', ' ', 'g')),
            k := trim(regexp_replace(array_to_string(regexp_extract_all(b, '\x01([^\x02]*)\x02', 1), ' '), ' +', ' ', 'g')))),
          lambda b: b.t <> '') AS b FROM l),
    n AS (SELECT page_id, list_transform(b, lambda x: struct_pack(t := x.t, n := len(string_split(x.t, ' ')),
            k := CASE WHEN x.k = '' THEN 0 ELSE len(string_split(x.k, ' ')) END)) AS b FROM t),
    p AS (SELECT page_id, b, list_transform(b, lambda x: greatest(x.n - x.k, 0)) AS w FROM n),
    s AS (SELECT page_id, b, list_transform(w, lambda x, i: 2 * x + coalesce(w[i - 1], 0) + coalesce(w[i + 1], 0)) AS s FROM p),
    u AS (SELECT page_id, i - 1 AS position, b[i].t AS t, b[i].n AS n_words, least(b[i].n, b[i].k) AS n_link_words, s[i] AS score
          FROM (SELECT *, unnest(range(1, len(b) + 1)) AS i FROM s)),
    v AS (SELECT *, 3 * n_link_words <= n_words AS sparse,
            coalesce(bool_or(3 * n_link_words <= n_words AND score >= {2 * blocks.LEAST_WORDS}) OVER (PARTITION BY page_id), false) AS any_pass FROM u),
    k AS (SELECT *, sparse AND (NOT any_pass OR score >= {2 * blocks.LEAST_WORDS}) AS kept FROM v)
"""


def _blocks(spark: SparkSession, sf: str) -> DataFrame:
    return with_computed(table(spark, sf, "pages").select("page_id", "html"), "blocks", blocks.page_blocks(F.col("html"))).select("page_id", "blocks")


@query(
    f"""
    WITH {_BLOCKS}
    SELECT page_id, position::BIGINT AS position, n_words::BIGINT AS n_words, n_link_words::BIGINT AS n_link_words, score::BIGINT AS score, kept,
           md5(t) AS text_hash FROM k
    """
)
def page_block_scores(spark: SparkSession, sf: str) -> DataFrame:
    rows = _blocks(spark, sf).select("page_id", F.posexplode("blocks").alias("position", "b"))
    return rows.select(
        "page_id", F.col("position").cast("bigint").alias("position"), "b.n_words", "b.n_link_words", "b.score", "b.kept", F.md5("b.text").alias("text_hash")
    )


@query(
    f"""
    WITH {_BLOCKS},
         g AS (SELECT page_id, count(*) AS n, count(*) FILTER (kept) AS nk, string_agg(t, chr(10) ORDER BY position) FILTER (kept) AS content
               FROM k GROUP BY page_id)
    SELECT page_id, coalesce(n, 0)::BIGINT AS n_blocks, coalesce(nk, 0)::BIGINT AS n_kept, length(coalesce(content, ''))::BIGINT AS n_chars,
           md5(coalesce(content, '')) AS content_hash
    FROM pages LEFT JOIN g USING (page_id)
    """
)
def main_text_by_density(spark: SparkSession, sf: str) -> DataFrame:
    pages = with_computed(_blocks(spark, sf), "content", blocks.dense_text(F.col("blocks")))
    kept = F.size(F.filter("blocks", lambda b: b["kept"]))
    return pages.select(
        "page_id",
        F.size("blocks").cast("bigint").alias("n_blocks"),
        kept.cast("bigint").alias("n_kept"),
        F.length("content").cast("bigint").alias("n_chars"),
        F.md5("content").alias("content_hash"),
    )
