"""Fill-in-the-middle texts against a plain reading of the contract, and back."""

import hashlib
import random
import re

import pytest
from pyspark.sql import functions as F

from areapulse.llm.middle_fill import FillRule, fill, fill_in_middle, filled, restore, restored, rotate

TOKEN = re.compile("[\x20\x09-\x0d]*[^\x20\x09-\x0d]+|[\x20\x09-\x0d]+")


def plain_reading(doc_id: str, text: str):
    tokens = TOKEN.findall(text)
    n = len(tokens)
    digest = hashlib.sha256(f"42:{doc_id}".encode()).hexdigest()
    h = [int(digest[i : i + 8], 16) for i in (0, 8, 16, 24)]
    if not text or any(m in text for m in ("<P>", "<S>", "<M>")) or h[2] % 100 >= 50:
        return n, "plain", None, None, text
    a, b = sorted((h[0] % (n + 1), h[1] % (n + 1)))
    p, m, s = "".join(tokens[:a]), "".join(tokens[a:b]), "".join(tokens[b:])
    if h[3] % 100 < 80:
        return n, "spm", len(p), len(m), f"<S>{s}<P>{p}<M>{m}"
    return n, "psm", len(p), len(m), f"<P>{p}<S>{s}<M>{m}"


@pytest.mark.parametrize("seed", range(4))
def test_equals_plain_reading(seed):
    rng = random.Random(seed)
    parts = ["a", "é", "世", " ", "\n", "\x0b", "\xa0", "<", ">", "S", "P", "😀", "<S", "M>"]
    for i in range(1500):
        text = "".join(rng.choice(parts) for _ in range(rng.choice([0, 1, 2, 5, 30])))
        if i % 300 == 0:
            text *= 20_000  # several blocks
        *facts, output = fill(str(i), text.encode(), FillRule())
        assert (*facts, bytes(output).decode()) == plain_reading(str(i), text)
        assert bytes(restore(bytes(output), facts[1], FillRule())).decode() == text


def test_all_forms_occur_and_marks_are_a_parameter():
    rule = FillRule(rearranged=100, suffix_first=50, prefix_mark="[pre]", suffix_mark="[suf]", middle_mark="[mid]")
    text = "one two <P> three four".encode()
    made = [fill(str(i), text, rule) for i in range(50)]
    assert {x[1] for x in made} == {"psm", "spm"}
    assert all(bytes(restore(bytes(x[4]), x[1], rule)) == text for x in made)


def test_rotation():
    for n in (0, 1, 5, 200_001):
        data = bytes(i % 251 for i in range(n))
        for mid in {0, n // 3, n}:
            buf = bytearray(data)
            rotate(buf, 0, mid, n)
            assert bytes(buf) == data[mid:] + data[:mid]


def test_odd_rows(odd):
    rows = fill_in_middle(odd).withColumn("back", restored(F.col("output"), F.col("form"))).collect()
    want = sorted((*plain_reading("" if r.doc_id is None else str(r.doc_id), r.text or ""), r.text or "") for r in odd.collect())
    assert sorted((r.n, r.form, r.prefix_chars, r.middle_chars, r.output, r.back) for r in rows) == want


def test_as_a_column_beside_clashing_names(odd):
    rows = odd.withColumn("form", F.lit("mine")).withColumn("made", filled(F.col("doc_id"), F.col("text")))
    assert {r.form for r in rows.collect()} == {"mine"}
    assert rows.select("made.form").distinct().count() > 1


def test_empty_table(none):
    assert fill_in_middle(none).collect() == []
