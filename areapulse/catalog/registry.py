"""Registration of queries and shared SQL fragments."""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import DataFrame, SparkSession

from areapulse.functions.text import SPACE
from areapulse.params import STOP_WORDS

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
SQL: dict[str, str] = {}


def query(sql: str | None = None) -> Callable[[Query], Query]:
    """Register a function under its own name, with its SQL if there is one."""

    def add(fn: Query) -> Query:
        QUERIES[fn.__name__] = fn
        if sql is not None:
            SQL[fn.__name__] = sql.strip()
        return fn

    return add


def quoted(values: Sequence[str]) -> str:
    """SQL list of string literals."""
    return ", ".join("'" + v.replace("'", "''") + "'" for v in values)


def sql_clean(col: str) -> str:
    """SQL form of ``clean_text``."""
    s = rf"regexp_replace(coalesce({col}, ''), '<[^\n>]*>', ' ', 'g')"
    s = rf"regexp_replace({s}, 'http[^{SPACE}]+', '', 'g')"
    s = rf"regexp_replace({s}, '[^\p{{L}}\p{{N}}_{SPACE}]', ' ', 'g')"
    return rf"lower(trim(regexp_replace({s}, '[{SPACE}]+', ' ', 'g')))"


def sql_words(col: str) -> str:
    """SQL form of ``words``."""
    return rf"regexp_extract_all(lower({col}), '[\p{{L}}\p{{N}}_]+')"


def sql_has_word(col: str, word: str) -> str:
    """Whole-word test of lowered text."""
    return rf"regexp_matches(lower({col}), '(^|[^\p{{L}}\p{{N}}_]){word.lower()}($|[^\p{{L}}\p{{N}}_])')"


def sql_word_count(col: str, word: str) -> str:
    """Whole-word occurrences: separators are doubled so that neighbours do not share one."""
    doubled = rf"regexp_replace(lower({col}), '([^\p{{L}}\p{{N}}_])', '\1\1', 'g')"
    target = word.lower().replace(" ", "  ")
    return rf"len(regexp_extract_all({doubled}, '(^|[^\p{{L}}\p{{N}}_]){target}($|[^\p{{L}}\p{{N}}_])'))"


# Names looked for in the prose in place of area names; one is part of another.
AREAS = ("the", "Of The", "und", "les", "que", "Is That", "nowhere")
# Keyword lists in place of the dimensions.
DIMENSION_WORDS = {
    "english": ("the", "and", "with", "of the", "that is"),
    "french": ("les", "des", "dans", "pas une"),
    "german": ("und", "nicht", "für", "das und"),
    "spanish": ("que", "los", "para"),
    "absent": ("zzzz", "qqqq xxxx"),
}
KEYWORDS = [(d, w) for d, ws in DIMENSION_WORDS.items() for w in ws]
ALL_STOP = sorted({w for ws in STOP_WORDS.values() for w in ws})
SQL_KEYWORDS = ", ".join(f"('{d}', '{w}')" for d, w in KEYWORDS)
