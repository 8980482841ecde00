"""Line-first cleaning.

Every line is judged by itself with punctuation, navigation and boilerplate rules; failing lines are removed, and a
document that loses too much of its text is rejected. A small set of document counts stands beside the rules. All of it
is native expressions inside the scan: nothing is shuffled, and no text leaves its task.

Defined cases: a null text is an empty one; an empty text has no line to lose, has zero counts and fails the length rule;
white-space-only lines are kept and never counted; repeated rows give repeated results; a null id is kept as it is.
Only the id and the text are read, so other columns may have any name.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from areapulse.functions.arrays import bind
from areapulse.llm.common import SPACES, WORD

#: Fixed phrases of page furniture, matched without regard to case.
BOILERPLATE = (
    "all rights reserved",
    "terms of (use|service)",
    "privacy policy",
    "cookie (policy|settings|preferences)",
    "(uses?|accept) (all )?cookies",
    "enable javascript",
    "subscribe to our newsletter",
    "sign up for our newsletter",
    "share (this|on) (page|facebook|twitter)",
    "powered by [a-z]+",
    "lorem ipsum",
    "licensed under the",
    "copyright (\\(c\\)|©)",
    "spdx-license-identifier",
)
#: Every phrase holds one of these in lower case; a text without them is not searched for phrases.
ANCHORS = (
    "all rights reserved",
    "terms of ",
    "privacy policy",
    "cookie",
    "enable javascript",
    "newsletter",
    "share ",
    "powered by ",
    "lorem ipsum",
    "licensed under the",
    "copyright ",
    "spdx-license-identifier",
)
#: Runs of symbol and shout marks, and menu separators.
MARKS = r"[#*$%&<>{}\\^~=]+|!!+"
BARS = "|»›•·▸→"
#: Fixed words that a line of menu entries is made of.
MENU = "home|menu|login|log in|logout|sign in|sign up|register|next|previous|back|top|search|contact|about|help|faq|skip|more"


@dataclass(frozen=True)
class LineRules:
    """Thresholds. ``*_per_100`` are per 100 words of the line."""

    marks_per_100: int = 50  # symbol and shout marks
    separators_per_100: int = 30  # menu separators
    stub_words: int = 3  # a line of so few words needs an end mark
    lost_per_100: int = 50  # a document that loses more of its words is rejected


def words_of(text: Column) -> Column:
    """Words between ASCII white space."""
    return F.array_remove(F.split(text, r"[\x20\x09-\x0D]+"), "")


def count_chars(text: Column, chars: str) -> Column:
    """How many code points of the text are among ``chars``."""
    return F.length(text) - F.length(F.translate(text, chars, ""))


def count_found(text: Column, pattern: str) -> Column:
    """Number of matches of a pattern."""
    return F.regexp_count(text, F.lit(pattern))


def line_fails(line: Column, rules: LineRules, may: Column | None = None) -> Column:
    """True if a line has a word and fails a rule. The rules:

    punctuation: too many symbols or exclamation runs for its words, or a stub without an end mark;
    navigation: too many separators for its words, or nothing but menu words;
    boilerplate: a phrase of page furniture.

    ``may`` (a struct) says of the whole text whether it holds any ``marks``, ``bars`` and ``phrases``; a line of a text without
    them is not searched. The cheap tests come first, and the words of a line are counted once.
    """
    if may is None:
        may = F.struct(*[F.lit(True).alias(kind) for kind in ("marks", "bars", "phrases")])
    marks = may["marks"] & line.rlike(MARKS)
    bars = may["bars"] & line.rlike(f"[{BARS}]")
    ends = line.rlike(r"[.!?:;…。！？,\"”’»')\]][\x20\x09-\x0D]*\z")
    menu = line.rlike(rf"(?i)^[\x20\x09-\x0D]*(({MENU})[\x20\x09-\x0D]*)+\z")
    known = may["phrases"] & line.rlike(rf"(?i){'|'.join(BOILERPLATE)}")

    def judged(n: Column) -> Column:
        stub = (n <= rules.stub_words) & ~ends
        symbols = marks & (count_found(line, MARKS) * 100 > n * rules.marks_per_100)
        separators = bars & (count_chars(line, BARS) * 100 > n * rules.separators_per_100)
        return (n > 0) & (stub | symbols | separators)

    return line.rlike(WORD) & (menu | known | bind(F.size(words_of(line)), judged))


def repeated_window_words(df: DataFrame, words: str, out: str, k: int = 5) -> DataFrame:
    """Adds the number of words inside windows of ``k`` words that a row's own word array holds twice or more.

    Windows are compared by hash first, from hashes of the words; if all hashes of a row differ, so do its windows.
    Otherwise the windows that share their hash with another are sorted by hash and words, so that equal windows are
    neighbours, which is exact and takes n log n steps for a long text.
    """
    w = F.col(words)
    n = F.size(w)
    starts = F.when(n >= k, F.sequence(F.lit(0), n - k)).otherwise(F.array().cast("array<int>"))
    own = F.transform(w, lambda x: F.xxhash64(x))
    hashed = df.withColumn("_h", bind(own, lambda a: F.transform(starts, lambda i: F.xxhash64(*[F.get(a, i + j) for j in range(k)]))))
    placed = F.array_sort(F.transform(F.col("_h"), lambda x, i: F.struct(x.alias("h"), i.alias("i"))))
    plain = F.size(F.array_distinct("_h")) == F.size("_h")

    def neighbours(s: Column, same: Callable[[Column, Column], Column]) -> Column:
        """Elements of a sorted array that equal the one before or after them."""

        def met(x: Column, i: Column) -> Column:
            return F.coalesce(same(x, F.get(s, i - 1)), F.lit(False)) | F.coalesce(same(x, F.get(s, i + 1)), F.lit(False))

        return F.filter(s, met)

    met = bind(placed, lambda s: neighbours(s, lambda x, y: x["h"] == y["h"]))
    spelled = F.transform(
        met, lambda x: F.struct(x["h"].alias("h"), F.array_join(F.slice(F.col(words), x["i"] + 1, k), " ").alias("w"), x["i"].alias("i"))
    )
    twice = bind(F.array_sort(spelled), lambda s: neighbours(s, lambda x, y: (x["h"] == y["h"]) & (x["w"] == y["w"])))
    at = F.array_sort(F.transform(twice, lambda x: x["i"]))
    marked = hashed.withColumn("_p", F.when(plain, F.array().cast("array<int>")).otherwise(at))

    def total(p: Column) -> Column:
        spans = F.transform(p, lambda x, i: F.least(F.lit(k), F.coalesce(F.get(p, i + 1) - x, F.lit(k))))
        return F.aggregate(spans, F.lit(0), lambda a, x: a + x)

    return marked.withColumn(out, total(F.col("_p"))).drop("_h", "_p")


def clean_lines(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", rules: LineRules = LineRules()) -> DataFrame:
    """One row per document: its counts, the cleaned text, words before and after, and the verdicts.

    Columns: ``doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, clean_text, n_clean_words,
    n_lines, n_failed_lines, base_failed, kept``.
    """
    rows = docs.select(F.col(doc_id).alias("doc_id"), F.coalesce(F.col(text), F.lit("")).alias("_t"))
    rows = rows.select("doc_id", "_t", words_of(F.col("_t")).alias("_w"), F.split("_t", "\n").alias("_l"))
    rows = rows.withColumn("_full", F.filter("_l", lambda x: x.rlike(WORD)))
    phrases = bind(F.lower("_t"), lambda low: reduce(Column.__or__, [F.contains(low, F.lit(a)) for a in ANCHORS]))
    may = F.struct(F.col("_t").rlike(MARKS).alias("marks"), F.col("_t").rlike(f"[{BARS}]").alias("bars"), phrases.alias("phrases"))
    # Bound, so that the tests of the whole text are not repeated at every line.
    rows = rows.withColumn("_kept", bind(may, lambda m: F.filter("_l", lambda x: ~line_fails(x, rules, m))))
    rows = repeated_window_words(rows, "_w", "_rep")
    rows = rows.withColumn("clean_text", F.array_join("_kept", "\n"))
    long = lambda c: c.cast("long")
    counted = rows.select(
        "doc_id",
        long(F.size("_w")).alias("n_words"),
        long(F.length(F.translate("_t", SPACES, ""))).alias("word_chars"),
        long(count_chars(F.col("_t"), "#*$%&|<>")).alias("n_symbols"),
        long(F.size("_full") - F.size(F.array_distinct("_full"))).alias("n_dup_lines"),
        long(F.col("_rep")).alias("n_repeat_words"),
        "clean_text",
        long(F.size(words_of(F.col("clean_text")))).alias("n_clean_words"),
        long(F.size("_full")).alias("n_lines"),
        long(F.size("_l") - F.size("_kept")).alias("n_failed_lines"),
    )
    failed = (F.col("n_words") < 10) | (F.col("n_repeat_words") * 100 > F.col("n_words") * 20)
    lost = (F.col("n_words") - F.col("n_clean_words")) * 100 > F.col("n_words") * rules.lost_per_100
    return counted.withColumn("base_failed", failed).withColumn("kept", ~(failed | lost))


__all__ = ["BOILERPLATE", "MENU", "WORD", "LineRules", "clean_lines", "repeated_window_words"]
