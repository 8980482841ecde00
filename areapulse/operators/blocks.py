"""Main text of pages by block scores: words outside links, own and of the neighbours.

A page is cut into blocks where a tag ends a line. Menus, teasers and footers in plain ``div`` elements are blocks made of
links or of few words among blocks of few words; prose is not. The score of a block is twice its own words outside links
plus those of the block before and of the block after. A block is kept if at most a third of its words are linked and its
score reaches twice ``least`` words. A page on which no block reaches the score keeps all that are at most a third links, so
that short pages keep their text. All of it is one column expression: no page is shuffled or leaves the JVM, and its cost is
linear in the length of the page.

Defined cases: a null or empty page has no blocks; a link that holds whole blocks counts in each of them; a link that is
never closed ends with its block; a closing tag without a link is dropped.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from areapulse.functions.arrays import bind
from areapulse.functions.text import SPACE
from areapulse.operators.ingest import DROPPED_BLOCKS, ENTITIES, LINE_TAGS

BLOCK_TAGS = LINE_TAGS + "|main|dl|dt|dd|hr|figure|figcaption"
ARTICLE = r"(?i)<article(?:\s[^>]*)?>(.*)</article\s*>"
LINK = r"(?i)<a(?:\s[^>]*)?>"
# Marks of links in the text; such characters of the page itself count as blanks.
OPEN, CLOSE = "\x01", "\x02"
LEAST_WORDS = 10


def _marked(html: Column) -> Column:
    """Page text with one line per block and marked links; lines break nowhere else."""
    c = F.translate(F.coalesce(html, F.lit("")), OPEN + CLOSE, "  ")
    c = F.regexp_replace(F.regexp_replace(c, rf"[{SPACE}]+", " "), r"<!--.*?-->", "")
    for tag in DROPPED_BLOCKS:
        c = F.regexp_replace(c, rf"(?i)<{tag}(?:\s[^>]*)?>.*?</{tag}\s*>", " ")
    c = bind(c, lambda page: bind(F.regexp_extract(page, ARTICLE, 1), lambda a: F.when(a != "", a).otherwise(page)))
    c = F.regexp_replace(F.regexp_replace(c, LINK, OPEN), r"(?i)</a\s*>", CLOSE)
    c = F.regexp_replace(c, rf"(?i)</?(?:{BLOCK_TAGS})(?:\s[^>]*)?/?>", "\n")
    c = F.regexp_replace(c, r"<[^>]*>", "")
    for entity, char in ENTITIES:
        c = F.replace(c, F.lit(entity), F.lit(char))
    return c


def _closed_at_lines(marked: Column) -> Column:
    """Links that run over several lines, marked in each line."""

    def part(x: Column, i: Column) -> Column:
        close, line = F.instr(x, CLOSE), F.instr(x, "\n")
        end = F.when(close > 0, close).when(line > 0, line).otherwise(F.length(x) + 1)
        inside = F.replace(F.substring(x, F.lit(1), end - 1), F.lit("\n"), F.lit(CLOSE + "\n" + OPEN))
        return F.when(i == 0, x).otherwise(F.concat(F.lit(OPEN), inside, F.lit(CLOSE), F.substring(x, end, F.length(x))))

    return F.array_join(F.transform(F.split(marked, OPEN), part), "")


def _tidy(text: Column) -> Column:
    return F.trim(F.regexp_replace(text, " +", " "))


def _count(tidy: Column) -> Column:
    return F.when(tidy == "", 0).otherwise(F.size(F.split(tidy, " "))).cast("bigint")


def page_blocks(html: Column, least: int = LEAST_WORDS) -> Column:
    """Array of ``(text, n_words, n_link_words, score, kept)`` in page order."""

    def measured(b: Column) -> Column:
        linked = F.array_join(F.regexp_extract_all(b, F.lit(rf"{OPEN}([^{CLOSE}]*){CLOSE}"), F.lit(1)), " ")
        text = _tidy(F.translate(b, OPEN + CLOSE, ""))
        return F.struct(text.alias("text"), _count(text).alias("n"), _count(_tidy(linked)).alias("links"))

    def plain(b: Column) -> Column:
        return F.coalesce(F.greatest(b["n"] - b["links"], F.lit(0)), F.lit(0))

    def scored(blocks: Column) -> Column:
        def one(b: Column, i: Column) -> Column:
            score = plain(b) * 2 + plain(F.get(blocks, i - 1)) + plain(F.get(blocks, i + 1))
            links = F.least(b["links"], b["n"])
            return F.struct(
                b["text"].alias("text"), b["n"].alias("n_words"), links.alias("n_link_words"), score.alias("score"), (links * 3 <= b["n"]).alias("sparse")
            )

        return F.transform(blocks, one)

    def judged(blocks: Column) -> Column:
        def passes(b: Column) -> Column:
            return b["sparse"] & (b["score"] >= 2 * least)

        def one(none: Column) -> Column:
            return F.transform(
                blocks, lambda b: F.struct(*[b[c].alias(c) for c in ("text", "n_words", "n_link_words", "score")], (b["sparse"] & (none | passes(b))).alias("kept"))
            )

        return bind(~F.exists(blocks, passes), one)

    lines = F.split(_closed_at_lines(_marked(html)), "\n")
    blocks = F.filter(F.transform(lines, measured), lambda b: b["text"] != "")
    return bind(bind(blocks, scored), judged)


def dense_text(blocks: Column) -> Column:
    """Text of the kept blocks of ``page_blocks``, one line per block."""
    return F.array_join(F.transform(F.filter(blocks, lambda b: b["kept"]), lambda b: b["text"]), "\n")
