"""Small tables with the odd rows that every operator must take."""

import random

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, n_words string, score string, _h long, target string"
WORDS = "river stone garden winter paper light cloud window table forest music letter summer mountain silver bridge".split()


def prose(seed: int, n: int) -> str:
    """Sentences of seven words, four to a line."""
    rng = random.Random(seed)
    out = []
    for i in range(n):
        word = rng.choice(WORDS) + rng.choice(["", "s", "ing", "ed", "ly"])
        out.append(word + (".\n" if i % 28 == 27 else "." if i % 7 == 6 else ""))
    return " ".join(out).replace("\n ", "\n")


def odd_rows() -> list[tuple]:
    base = prose(1, 120)
    rows = [
        (1, base, "en", "a"),
        (2, base, "en", "a"),  # an exact copy
        (3, base.replace("river", "rivers", 1), "en", None),  # a near copy
        (4, prose(2, 90), "en", "b"),
        (4, prose(2, 90), "en", "b"),  # a repeated row
        (5, None, "en", "b"),
        (6, "", None, "b"),
        (7, " \t\n ", "en", "c"),
        (8, "one", "en", "c"),
        (9, "Ünïcödé ﬁné 世界 é 😀 \x00 \x0b words", "xx", "c"),
        (None, prose(3, 60), "en", "c"),
        (None, None, None, None),
        (10, prose(4, 20000), "en", "a"),  # very long
        (11, "word " * 3000, "en", "a"),
    ]
    return [(i, t, lang, s, len(t or ""), "x", "y", 5, "z") for i, t, lang, s in rows]
