"""Text expressions. All of them are native columns and stay inside the scan stage."""

from __future__ import annotations

import re
import unicodedata
from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

from areapulse.functions.arrays import bind

# Word characters and white space as Unicode classes: plain \w and \s are ASCII in Java regexes.
WORD = r"[\p{L}\p{N}_]"
SPACE = r"\p{Z}\t\n\x0B\f\r\x1C-\x1F\x85"
LETTERS = r"[\p{L}]+"
TOKENS = rf"{WORD}+"


def clean_text(col: Column) -> Column:
    """Tags to blanks, links away, punctuation to blanks, blanks squeezed, lower case, null to ''."""
    c = nfc(F.coalesce(col, F.lit("")))
    c = F.regexp_replace(c, r"<[^\n>]*>", " ")
    c = F.regexp_replace(c, rf"http[^{SPACE}]+", "")
    c = F.regexp_replace(c, rf"[^\p{{L}}\p{{N}}_{SPACE}]", " ")
    return F.lower(F.trim(F.regexp_replace(c, rf"[{SPACE}]+", " ")))


def clean_text_alpha(col: Column) -> Column:
    """Links away, everything but letters and blanks removed, lower case, trimmed."""
    c = F.coalesce(col, F.lit(""))
    c = F.regexp_replace(c, rf"http[^{SPACE}]+", "")
    # fixed letter set: ASCII plus the Spanish accented letters
    c = F.regexp_replace(c, rf"[^a-zA-ZáéíóúüñÁÉÍÓÚÜÑ{SPACE}]", "")
    return F.lower(F.regexp_replace(c, rf"^[{SPACE}]+|[{SPACE}]+$", ""))


def word_pattern(word: str) -> str:
    """Whole-word pattern; the Java regex (?U) flag makes \\b and case folding Unicode-aware."""
    return rf"(?iU)(?<!{WORD}){re.escape(word)}(?!{WORD})"


def words(col: Column) -> Column:
    """Lower-cased word tokens."""
    return F.regexp_extract_all(F.lower(col), F.lit(f"({TOKENS})"), 1)


def letter_words(col: Column) -> Column:
    """Lower-cased runs of letters."""
    return F.regexp_extract_all(F.lower(col), F.lit(f"({LETTERS})"), 1)


def title_label(col: Column) -> Column:
    """``A_B`` to ``A B`` in title case; every letter after a non-letter starts a word."""
    pieces = F.regexp_extract_all(F.lower(F.replace(col, F.lit("_"), F.lit(" "))), F.lit(r"([\p{L}]+|[^\p{L}]+)"), 1)
    return F.array_join(
        F.transform(pieces, lambda p: F.concat(F.upper(F.substring(p, 1, 1)), p.substr(F.lit(2), F.length(p)))), ""
    )


def phrase(keywords: Column) -> Column:
    """Keyword block (any blanks) to one phrase."""
    parts = F.split(F.regexp_replace(keywords, rf"^[{SPACE}]+|[{SPACE}]+$", ""), rf"[{SPACE}]+")
    return F.array_join(parts, " ")


def snake_name(name: str) -> str:
    """Column header to a contract name."""
    return re.sub(r" ", "_", name.strip())


# Combining marks that occur with Latin letters (grave, acute, circumflex, tilde, macron, breve, dot,
# diaeresis, ring, double acute, caron, comma below, cedilla, ogonek).
MARKS = "\u0300\u0301\u0302\u0303\u0304\u0306\u0307\u0308\u030a\u030b\u030c\u0326\u0327\u0328"
LATIN = "".join(chr(i) for i in (*range(0x41, 0x5B), *range(0x61, 0x7B)))


def _composed(mark: str) -> tuple[str, str]:
    """Base letters that have a one-character form with ``mark``, and those forms."""
    pairs = [(b, unicodedata.normalize("NFC", b + mark)) for b in LATIN]
    pairs = [(b, c) for b, c in pairs if len(c) == 1]
    return "".join(b for b, _ in pairs), "".join(c for _, c in pairs)


def _compose_mark(text: Column, mark: str) -> Column:
    """Join each ``letter + mark`` of one mark to its one-character form."""
    bases, forms = _composed(mark)

    def rejoin(parts: Column) -> Column:
        def piece(p: Column, i: Column) -> Column:
            last = F.substring(p, -1, 1)
            known = (F.length(p) > 0) & (F.instr(F.lit(bases), last) > 0)
            short = F.concat(p.substr(F.lit(1), F.length(p) - 1), F.translate(last, bases, forms))
            return F.when(i == F.size(parts) - 1, p).when(known, short).otherwise(F.concat(p, F.lit(mark)))

        return F.array_join(F.transform(parts, piece), "")

    return F.when(F.contains(text, F.lit(mark)), bind(F.split(text, mark), rejoin)).otherwise(text)


def nfc_text(value: str) -> str:
    """A configuration value in NFC."""
    return unicodedata.normalize("NFC", value)


def _classes() -> dict[str, int]:
    """Combining class of the marks of U+0300 to U+036F that move and do not decompose."""
    marks = map(chr, range(0x300, 0x370))
    return {m: unicodedata.combining(m) for m in marks if unicodedata.combining(m) and not unicodedata.decomposition(m)}


def _letters() -> list[str]:
    """Composed Latin letters."""
    blocks = (*range(0xC0, 0x250), *range(0x1E00, 0x1F00))
    return [c for c in map(chr, blocks) if unicodedata.normalize("NFC", c) == c and len(unicodedata.normalize("NFD", c)) > 1]


def _constant_map(entries: dict[str, str]) -> Column:
    """A map of short strings as one folded constant."""
    return F.str_to_map(F.lit(",".join(f"{k}:{v}" for k, v in entries.items())), F.lit(","), F.lit(":"))


def _compose_clusters(text: Column) -> Column:
    """Full canonical composition of Latin letters with any number of marks.

    Each letter is taken apart, its marks are ordered by combining class (equal classes keep their order), and every mark
    joins the letter unless one of the same or a higher class that stayed apart stands between. Letters with a mark outside
    U+0300 to U+036F are left as they are.
    """
    classes, letters = _classes(), _letters()
    class_of = _constant_map({m: str(c) for m, c in classes.items()})
    apart = _constant_map({c: unicodedata.normalize("NFD", c) for c in letters})
    pairs = {unicodedata.normalize("NFC", unicodedata.normalize("NFD", c)[:-1]) + unicodedata.normalize("NFD", c)[-1]: c for c in letters}
    composed = _constant_map(pairs)

    def fold(decomposed: Column) -> Column:
        marks = F.regexp_extract_all(F.substring(decomposed, 2, 2**30), F.lit("(?s)(.)"), 1)
        placed = F.array_sort(
            F.transform(marks, lambda m, i: F.struct(F.try_element_at(class_of, m).cast("int").alias("k"), i.alias("i"), m.alias("m")))
        )
        start = F.struct(F.substring(decomposed, 1, 1).alias("done"), F.lit("").alias("rest"), F.lit(0).alias("last"))

        def step(state: Column, x: Column) -> Column:
            joined = F.try_element_at(composed, F.concat(state["done"], x["m"]))
            free = (state["last"] < x["k"]) & joined.isNotNull()
            return F.struct(
                F.when(free, joined).otherwise(state["done"]).alias("done"),
                F.when(free, state["rest"]).otherwise(F.concat(state["rest"], x["m"])).alias("rest"),
                F.when(free, state["last"]).otherwise(x["k"]).alias("last"),
            )

        return F.aggregate(placed, start, step, lambda state: F.concat(state["done"], state["rest"]))

    def piece(p: Column) -> Column:
        """A run of text that ends in a letter and its marks."""

        def split(marks: Column) -> Column:
            n = F.length(p) - F.length(marks)
            # Marks without a letter are only ordered: a hyphen, which joins no mark, stands in and is dropped.
            base = F.when(n > 0, F.substring(p, n, F.lit(1))).otherwise(F.lit("-"))
            known = marks.rlike(rf"^[{''.join(classes)}]+\z")
            whole = bind(F.concat(F.coalesce(F.try_element_at(apart, base), base), marks), fold)
            joined = F.concat(F.substring(p, F.lit(1), F.greatest(n - 1, F.lit(0))), whole)
            return F.when(~known, p).when(n > 0, joined).otherwise(F.substring(joined, 2, 2**30))

        return bind(F.regexp_extract(p, r"(\p{Mn}*)\z", 1), split)

    return F.array_join(F.transform(F.regexp_extract_all(text, F.lit(r"([^\p{Mn}]*\p{Mn}*)"), 1), piece), "")


def nfc(col: Column) -> Column:
    """Compose Latin letters with their combining marks.

    Rows without a combining mark skip the work. A letter directly before its one mark is composed by the mark; texts
    with a letter of several marks go through the full composition, which orders them first.
    """

    def step(mark: str) -> Callable[[Column], Column]:
        return lambda v: _compose_mark(v, mark)

    out = col
    for mark in MARKS:
        out = bind(out, step(mark))
    several = col.rlike(r"\p{Mn}{2}|[\u00C0-\u024F\u1E00-\u1EFF]\p{Mn}")
    return F.when(several, _compose_clusters(col)).when(col.rlike(r"\p{Mn}"), out).otherwise(col)
