"""Winnowing against a plain loop over windows, and its match guarantee."""

import random
import zlib

import pytest
from conftest_llm import prose
from pyspark.sql import functions as F

from areapulse.llm.winnowing import BASE, PRIME, WinnowRule, edited, fingerprints, likeness, with_fingerprint, with_next


def words(text):
    out = [text or ""]
    for c in " \t\n\x0b\x0c\r":
        out = [part for t in out for part in t.split(c)]
    return [w for w in out if w]


def kept(text, gram, window):
    codes = [zlib.crc32(w.encode()) % PRIME for w in words(text)]
    if not codes:
        return []
    codes += [0] * (gram - len(codes))
    hashes = [sum(c * pow(BASE, gram - 1 - j, PRIME) for j, c in enumerate(codes[i : i + gram])) % PRIME for i in range(len(codes) - gram + 1)]
    out = []
    for at in range(max(1, len(hashes) - window + 1)):
        best = min(range(at, min(at + window, len(hashes))), key=lambda i: (hashes[i], -i))
        if (hashes[best], best) not in out:
            out.append((hashes[best], best))
    return out


@pytest.mark.parametrize(("gram", "window"), [(4, 4), (1, 1), (8, 2), (16, 8)])
def test_equals_plain_loop(spark, gram, window):
    rng = random.Random(gram)
    texts = [" ".join(rng.choice("ab") for _ in range(n)) for n in (0, 1, 2, 3, 4, 5, 7, 8, 15, 16, 17, 24, 40)] + [prose(3, 300), "é 世\x0b😀 \x00"]
    rows = fingerprints(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string"), rule=WinnowRule(gram, window)).collect()
    for r in rows:
        assert list(zip(r.hashes, r.positions)) == kept(texts[r.doc_id], gram, window)
        assert r.n_chars == len(texts[r.doc_id])


def test_sizes_are_powers_of_two():
    with pytest.raises(ValueError):
        WinnowRule(3, 4)


def test_shared_runs_are_met(spark):
    rule = WinnowRule()
    rows = []
    for i in range(60):
        run = prose(1000 + i, rule.window + rule.gram - 1)
        rows.append((i, f"{prose(i, i % 9)} {run} {prose(2000 + i, 5)}", f"{prose(3000 + i, 12)} {run} {prose(4000 + i, i % 5)}"))
    df = spark.createDataFrame(rows, "i int, a string, b string")
    df = with_fingerprint(with_fingerprint(df, "a", "x", rule=rule), "b", "y", rule=rule)
    assert df.where(F.size(F.array_intersect("x", "y")) == 0).count() == 0


def test_likeness(spark):
    df = spark.sql("SELECT array(1L, 2L, 2L) AS a, array(2L, 3L) AS b, cast(array() AS array<bigint>) AS c")
    row = df.select(likeness(F.col("a"), F.col("b")), likeness(F.col("a"), F.col("c")), likeness(F.col("c"), F.col("c")), likeness(F.col("a"), F.col("a"))).first()
    assert tuple(row) == (1 / 3, 0.0, 1.0, 1.0)


@pytest.mark.parametrize("ranges", [1, 3, 100])
def test_next_text(spark, odd, ranges):
    rows = with_next(odd, ranges=ranges, rule=WinnowRule()).collect()
    hashed = odd.select("doc_id", F.coalesce("text", F.lit("")).alias("t"), F.xxhash64(F.coalesce("text", F.lit(""))).alias("h")).collect()
    order = sorted(hashed, key=lambda r: (r.doc_id is not None, r.doc_id or 0, r.h), reverse=True)
    want = [(r.doc_id, r.t, order[(i + 1) % len(order)].t) for i, r in enumerate(order)]
    key = lambda x: (x[0] is None, x[0] or 0, x[1], x[2])
    assert sorted([(r.doc_id, r.text, r.next_text) for r in rows], key=key) == sorted(want, key=key)
    for r in rows:
        assert r.hashes == [h for h, _ in kept(r.text, 4, 4)] and r.next_hashes == [h for h, _ in kept(r.next_text, 4, 4)]


def test_next_of_named_ids_and_single_rows(spark, none):
    rows = spark.createDataFrame([(f"k{i:03}", prose(i, 9)) for i in range(200)], "name string, body string")
    got = {r.doc_id: r.next_text for r in with_next(rows, "name", "body", ranges=7).collect()}
    assert got == {f"k{i:03}": prose((i - 1) % 200, 9) for i in range(200)}
    one = with_next(rows.limit(1), "name", "body").collect()
    assert [(r.text, r.next_text) for r in one] == [(prose(0, 9), prose(0, 9))]
    assert with_next(none).collect() == []


def test_edited(spark):
    pairs = [("", "abc"), ("a", "xyz"), ("ab", "xyz"), ("世é😀def", "1"), ("abcde", "")]
    got = [r[0] for r in spark.createDataFrame(pairs, "a string, b string").select(edited(F.col("a"), F.col("b"))).collect()]
    assert got == [a[: len(a) - len(a) // 2] + b[: len(a) // 2] for a, b in pairs]
