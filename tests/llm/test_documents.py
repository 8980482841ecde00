"""Operators on documents against brute force, exact round trips or held-out accuracy, with every odd row."""

import json
import random
import re
import zlib
from collections import defaultdict

import compare
import duckdb
import numpy as np
import pandas as pd
import public_tokenizers
import pyarrow as pa
import pytest
from conftest_llm import odd_rows, prose
from tokenizers import Tokenizer

from areapulse.llm import common, token_codes
from areapulse.llm.common import SPACED, components, giving_back
from areapulse.llm.decontaminate import cut_spans, find_passages
from areapulse.llm.fm_index import FMIndex
from areapulse.llm.jaccard_join import Threshold, _changed, family_members, family_pairs, name_filter, name_slots, pairs_inside, similar_documents
from areapulse.llm.language_id import fit_languages, identify_languages
from areapulse.llm.source_mix import MixRule, mix_sources, source_targets
from areapulse.llm.sql import SQL
from areapulse.llm.substring_dedup import PassageRule, _seeds, chains, repeated_passages, word_hashes
from areapulse.llm.token_codes import BUNCH, TokenFile, WordEncoder, _bunches, _writer, pack, read_tokens, word_level, write_tokens
from areapulse.llm.toxicity import fit_toxicity
from areapulse.llm.url_rules import judge_urls

WORD = re.compile(r"[^\x20\x09-\x0D]+")
LOW = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
DOC = "doc_id long, text string"


def shingles(text, k):
    w = WORD.findall((text or "").translate(LOW))
    return {tuple(w[i : i + k]) for i in range(len(w) - k + 1)} if len(w) >= k else ({tuple(w)} if w else set())


def classes(rows, rule):
    """Brute force over all pairs: (set size, smallest id reachable)."""
    sets = [shingles(t, rule.shingle) for _, t in rows]
    root = list(range(len(rows)))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for i, a in enumerate(sets):
        for j in range(i):
            both = len(a & sets[j])
            if a and sets[j] and rule.den * both >= rule.num * len(a | sets[j]):
                root[find(i)] = find(j)
    ids = defaultdict(list)
    for i, (key, _) in enumerate(rows):
        if key is not None:
            ids[find(i)].append(key)
    return sorted(str((key, len(sets[i]), min(ids[find(i)], default=key) if sets[i] else key)) for i, (key, _) in enumerate(rows))


def edited(text, seed, n):
    rng, w = random.Random(seed), text.split(" ")
    for _ in range(n):
        w[rng.randrange(len(w))] = f"new{rng.randrange(10**6)}"
    return " ".join(w)


@pytest.mark.parametrize("rule", [Threshold(3, 9, 10), Threshold(5, 4, 5)])
def test_jaccard_classes(spark, odd, rule):
    base = [prose(100 + i, 60 + 40 * i) for i in range(4)]
    rows = [(1000 + i, edited(base[i % 4], i, i % 7)) for i in range(60)]
    rows += [(2000 + i, " ".join(f"w{j}" for j in range(n))) for i, n in enumerate((9, 10, 11, 12, 20, 22))]
    rows += [(3000, "one"), (3001, "ONE"), (3002, "one two"), (3003, None)]
    df = odd.select("doc_id", "text").union(spark.createDataFrame(rows, DOC))
    got = similar_documents(df, rule).collect()
    assert sorted(str(tuple(r)) for r in got) == classes([(r[0], r[1]) for r in odd_rows()] + rows, rule)


def test_chain_of_copies_is_one_class(spark):
    """Neighbours are similar, ends are not."""
    w = [f"w{i}" for i in range(300)]
    rows = [(i, " ".join(w[: 300 - 4 * i] + [f"x{j}" for j in range(4 * i)])) for i in range(30)]
    got = similar_documents(spark.createDataFrame(rows, DOC), Threshold(3, 9, 10)).collect()
    assert sorted(str(tuple(r)) for r in got) == classes(rows, Threshold(3, 9, 10))


def test_components(spark):
    rng = random.Random(5)
    links = [(rng.randrange(400), rng.randrange(400)) for _ in range(260)] + [(i, 500) for i in range(501, 700)]
    root = {}

    def find(x):
        while root.setdefault(x, x) != x:
            x = root[x]
        return x

    for a, b in links:
        x, y = find(a), find(b)
        root[max(x, y)] = min(x, y)
    got = {r["node"]: r["root"] for r in components(spark.createDataFrame(links, "u long, v long")).collect()}
    assert got == {x: find(x) for x in got} and len(got) == len({x for p in links if p[0] != p[1] for x in p})


def test_empty_documents(spark, none):
    empty = spark.createDataFrame([], "item_id long, text string")
    assert similar_documents(none).count() == 0
    assert repeated_passages(none).count() == 0
    assert find_passages(none, empty, ["doc_id"]).count() == 0
    assert mix_sources(none).count() == 0
    assert read_tokens(spark, write_tokens(none, public_tokenizers.path("word_bpe_49k.json"), 2)).count() == 0
    assert identify_languages(none, fit_languages(none)).count() == 0
    labels = spark.createDataFrame([], "doc_id long, toxic int")
    assert fit_toxicity(none, labels).score(none, none.columns).count() == 0


ALNUM = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def hits(text, items, size=13):
    w = ALNUM.findall((text or "").translate(LOW))
    covered, found = set(), set()
    for key, item in items:
        v = ALNUM.findall((item or "").translate(LOW))
        m = min(size, len(v))
        for i in range(len(v) - m + 1 if m else 0):
            for j in range(len(w) - m + 1):
                if w[j : j + m] == v[i : i + m]:
                    covered.update(range(j, j + m))
                    found.add(str(key))
    return len(w), len(covered), sorted(found)


@pytest.mark.parametrize("block_bytes", [1 << 20, 200])
def test_passages_of_benchmark(spark, odd, block_bytes):
    items = [(1, prose(1, 30)), (2, "Short ITEM here"), (3, prose(50, 14)), (3, prose(50, 14)), (4, "..."), (5, None), (None, "one"), (6, "世界 é")]
    rows = [(70, "x " + prose(50, 14) + " y " + prose(50, 14)), (71, "a short item here. SHORT-item-here!"), (72, "short item")]
    df = odd.select("doc_id", "text").union(spark.createDataFrame(rows, DOC))
    bench = spark.createDataFrame(items, "item_id long, text string")
    got = find_passages(df, bench, ["doc_id", "text"], block_bytes=block_bytes, shard_bytes=3000).select("doc.*", "n_words", "n_hit", "items", "spans")
    known = [(k, t) for k, t in items if k is not None]
    want = [(i, *hits(t, known)) for i, t in [(r[0], r[1]) for r in odd_rows()] + rows if i != 10]
    assert sorted(str((r["doc_id"], r["n_words"], r["n_hit"], r["items"])) for r in got.collect() if r["doc_id"] != 10) == sorted(map(str, want))
    cut = got.where("doc_id = 70").select(cut_spans("text", "spans").alias("t")).first()["t"]
    assert ALNUM.findall(cut) == ["x", "y"]


def test_fm_index():
    rng = np.random.default_rng(1)
    seq = rng.integers(0, 5, 400)
    seq[0] = seq[-1] = 0
    index = FMIndex(seq, 4)
    for n in (1, 2, 4):
        phrases = rng.integers(1, 5, (50, n))
        lo, hi = index.search(phrases, np.full(50, n))
        for p, a, b in zip(phrases, lo, hi):
            want = [i for i in range(400 - n + 1) if (seq[i : i + n] == p).all()]
            assert sorted(index.locate(np.arange(a, b)).tolist()) == want


def test_targets(spark):
    rows = [("a", 100), ("b", 1000), ("c", 50), (None, 10), ("d", 0)]
    got = {r["source"]: r["target"] for r in source_targets(spark.createDataFrame(rows, "source string, source_size long")).collect()}
    names = ["a", "b", "c", "d", None]
    size, weight = dict(rows), dict(zip(names, [5, 2, 1, 5, 2]))
    left, target, open_to = 1160 * 1.5, {}, set(names)
    while True:
        share = {n: left * weight[n] / sum(weight[x] for x in open_to) for n in open_to}
        full = {n for n in open_to if share[n] > 2 * size[n]}
        if not full:
            break
        target |= {n: 2.0 * size[n] for n in full}
        left, open_to = left - sum(2 * size[n] for n in full), open_to - full
    assert got == pytest.approx(target | share)


def test_mix(spark, odd):
    first = mix_sources(odd, MixRule(least_block=4)).toPandas()
    again = mix_sources(odd.repartition(5), MixRule(least_block=4)).toPandas()
    columns = ["doc_id", "source", "size", "source_size", "target", "taken"]
    key = lambda f: sorted(map(str, f[columns].itertuples(index=False)))
    assert key(first) == key(again)
    assert len(first) == len(odd_rows()) and (first["taken"] <= 2 * first["size"]).all()
    by = first.assign(source=first["source"].fillna("-")).groupby("source").agg(target=("target", "first"), taken=("taken", "sum"))
    assert (abs(by["taken"] - by["target"]) <= 40).all()


def test_small_sources_reach_their_target(spark):
    """Sources far below a slot's share of the words, and with a last block of one word, still give their target."""
    rng = random.Random(9)
    rows = [(i, "w " * 400, "a") for i in range(100)]
    rows += [(1000 + 10 * s + i, "w " * rng.choice([1, 7, 17, 33]), f"s{s:03}") for s in range(60) for i in range(3)]
    got = mix_sources(spark.createDataFrame(rows, f"{DOC}, source string")).toPandas()
    by = got.groupby("source").agg(target=("target", "first"), taken=("taken", "sum"))
    assert (by["taken"] == by["target"].astype(int)).all()
    assert (got["taken"] <= 2 * got["size"]).all()


def test_mix_of_small_sources_equals_its_sql(spark):
    """The given tables need no place beyond the schedule; this one does."""
    rng = random.Random(4)
    rows = [(i, "w " * rng.choice([3, 20, 90, 333]), f"s{i % 120:03}" if i % 3 else "big") for i in range(600)]
    columns = ["doc_id", "size", "source_size", "target", "taken"]
    got = mix_sources(spark.createDataFrame(rows, f"{DOC}, source string")).select(*columns).toPandas()
    documents = pd.DataFrame(rows, columns=["doc_id", "text", "source"])
    with duckdb.connect() as con:
        con.register("documents", documents)
        want = con.execute(SQL["op3_source_mix"]).df()
    assert compare.differences(got, want) == []


def test_repeated_passages(spark, odd):
    rng = random.Random(2)
    fresh = lambda n: " ".join(f"u{rng.randrange(10**9)}" for _ in range(n))
    passage, other = fresh(60), fresh(80)
    fuzzy = edited(other, 3, 4)
    rows = [(100 + i, f"{fresh(70)} {passage} {fresh(30)}") for i in range(8)]
    rows += [(200, f"{fresh(40)} {other} {fresh(10)}"), (201, f"{fresh(5)} {fuzzy} {fresh(90)}"), (202, fresh(300)), (203, fresh(300) + " " + passage[:300])]
    df = odd.select("doc_id", "text").where("doc_id IS NULL OR doc_id < 10").union(spark.createDataFrame(rows, DOC))
    got = repeated_passages(df).toPandas()
    assert set(got["doc_id"].dropna()) == {1, 2, 3, 4, *range(100, 108), 200, 201}
    for r in got[got["doc_id"].between(100, 107)].itertuples():
        assert r.start <= 70 and r.past >= 130 and r.past - r.start <= 64
    kept = got[got["doc_id"].between(100, 107)]["cut"].tolist()
    assert kept.count(False) == 1
    assert got[got["doc_id"] == 200]["identity"].iloc[0] < 1


def test_passage_of_common_pieces(spark):
    """Two texts share 60 words whose halves are common on their own, with other texts of smallest and largest name."""
    rng = random.Random(7)
    fresh = lambda n: " ".join(f"u{rng.randrange(10**9)}" for _ in range(n))
    rows, pairs = [], []
    for t in range(12):
        p, q = fresh(30), fresh(30)
        for piece in (p, q):
            rows += [(10_000 + len(rows), f"{fresh(30)} {piece} {fresh(30)}") for _ in range(20)]
        pairs += [2 * t, 2 * t + 1]
        rows += [(i, f"{fresh(40)} {p} {q} {fresh(25)}") for i in pairs[-2:]]
    got = repeated_passages(spark.createDataFrame(rows, DOC)).toPandas()
    found = got[(got["start"] <= 40) & (got["past"] >= 100)]
    assert sorted(set(found["doc_id"])) == pairs and sorted(set(got["doc_id"])) == pairs
    assert sum(~found["cut"]) == 12


def test_changed_passage_of_common_pieces(spark):
    """Two texts share 110 words but for two, in pieces that are common on their own; no equal run has 50 words."""
    rng = random.Random(9)
    fresh = lambda n: " ".join(f"u{rng.randrange(10**9)}" for _ in range(n))
    rows, pairs = [], []
    for t in range(12):
        pieces = [fresh(36) for _ in range(3)]
        for piece in pieces:
            rows += [(10_000 + len(rows), f"{fresh(30)} {piece} {fresh(30)}") for _ in range(20)]
        pairs += [2 * t, 2 * t + 1]
        rows += [(i, f"{fresh(40)} {pieces[0]} {fresh(1)} {pieces[1]} {fresh(1)} {pieces[2]} {fresh(25)}") for i in pairs[-2:]]
    got = repeated_passages(spark.createDataFrame(rows, DOC)).toPandas()
    found = got[(got["start"] <= 40) & (got["past"] >= 150)]
    assert sorted(set(found["doc_id"])) == pairs and sorted(set(got["doc_id"])) == pairs
    assert sum(~found["cut"]) == 12
    other = dict(zip(found["doc_id"], found["other_doc_id"]))
    assert all(other[i] == i ^ 1 for i in pairs)


def test_passage_twice_in_one_text(spark):
    rng = random.Random(8)
    fresh = lambda n: " ".join(f"u{rng.randrange(10**9)}" for _ in range(n))
    rows = []
    for t in range(6):  # names are hashes: either text may be the smaller one
        p = fresh(60)
        rows += [(2 * t, f"{fresh(20)} {p} {fresh(100)} {p} {fresh(10)}"), (2 * t + 1, f"{fresh(30)} {p} {fresh(30)}")]
    got = repeated_passages(spark.createDataFrame(rows, DOC)).toPandas()
    for t in range(6):
        spans = got[got["doc_id"] == 2 * t]
        for at in (20, 180):
            assert ((spans["start"] <= at) & (spans["past"] >= at + 60)).any(), (t, at)


def test_chains():
    seg = np.array([[0, 10, 100, 110], [12, 30, 112, 130], [15, 40, 15, 40], [35, 60, 134, 159], [300, 320, 5, 25]])
    assert chains(seg, 0.2, 7)[0] == [0, 1, 3]
    assert PassageRule().least_words == 50


def test_token_files(spark, odd):
    path = public_tokenizers.path("word_bpe_49k.json")
    manifest = write_tokens(odd, path, 2, file_tokens=500)
    rows = sorted(read_tokens(spark, manifest).collect(), key=lambda r: r["start"])
    plain = Tokenizer.from_file(path)
    want = sorted(((r[0] is not None, r[0] or 0, (r[1] or "")) for r in odd_rows()))
    at = 0
    by_id = defaultdict(list)
    for _, key, text in want:
        by_id[key].append(plain.encode(text, add_special_tokens=False).ids + [2])
    for r in rows:
        ids = np.frombuffer(r["ids"], "<u4").tolist()
        assert r["start"] == at and r["n_tokens"] == len(ids)
        by_id[r["doc_id"] or 0].remove(ids)
        at += len(ids)
    assert [r["doc_id"] for r in rows] == [k if known else None for known, k, _ in want]
    assert not any(by_id.values())


def test_codes_round_trip():
    rng = np.random.default_rng(3)
    docs = [rng.integers(0, 1 << int(rng.choice([4, 8, 16, 31])), int(rng.integers(0, 700))) for _ in range(30)]
    file, every = TokenFile(pack([None, *range(29)], docs)), np.concatenate(docs)
    assert all((file.document(k) == d).all() for k, d in enumerate(docs))
    at = rng.permutation(len(every))
    assert (file.tokens(at) == every[at]).all()
    assert TokenFile(pack([], [])).n_tokens == 0


def test_a_language_in_few_long_texts_is_learned(spark):
    long = [(i, " ".join(w + "um" for w in prose(50 + i, 3000).split()), "la") for i in range(2)]
    many = [(10 + i, prose(100 + i, 60), "en") for i in range(40)]
    rows = spark.createDataFrame([*long, *many, (90, "", "xx"), (91, many[0][1], "en")], "doc_id long, text string, lang string")
    model = fit_languages(rows, sample_bytes=3000)
    assert {"la", "en"} <= set(model.languages)
    got = {r["doc_id"]: r["lang_pred"] for r in identify_languages(rows, model).collect()}
    assert got[0] == got[1] == "la" and all(got[i] == "en" for i, _, _ in many)


@pytest.mark.parametrize("name", ["word_bpe_49k.json", "byte_bpe_50k.json"])
def test_encoder_follows_the_tokenizer_file(spark, name):
    path = public_tokenizers.path(name)
    plain = Tokenizer.from_file(path)
    texts = ["Upper CASE  and\n\nblank lines ", " leading", "", "it's I'LL 1234 x2", "é e\u0301 Ünï 世界 😀", "a<|endoftext|>B", "\u00a0odd\u2003blanks\x1c"]
    rows = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = {r["doc_id"]: r["ids"] for r in read_tokens(spark, write_tokens(rows, path, 2)).collect()}
    for i, text in enumerate(texts):
        assert np.frombuffer(got[i], "<u4").tolist() == [*plain.encode(text, add_special_tokens=False).ids, 2], text


def test_other_splits_are_encoded_whole():
    spec = json.loads(open(public_tokenizers.path("word_bpe_49k.json"), encoding="utf-8").read())
    assert word_level(json.dumps(spec)) == (True, True)
    kept = {**spec, "normalizer": None}
    assert word_level(json.dumps(kept)) == (True, False)
    assert word_level(json.dumps({**spec, "normalizer": {"type": "Strip", "strip_left": True, "strip_right": True}}))[0] is False
    assert word_level(json.dumps({**spec, "pre_tokenizer": {"type": "Whitespace"}}))[0] is False


def test_word_encoder_equals_the_library():
    spec = open(public_tokenizers.path("word_bpe_49k.json"), encoding="utf-8").read()
    encoder, plain, rng = WordEncoder(spec, limit=50), Tokenizer.from_str(spec), random.Random(1)
    letters = "abcXYZ éÉßñİıΣσς ſK'’.,!<|endoftext|>\t\n\x1c\x85 ́éµªº×÷0123٣_-\"ÿ世界😀 's 'RE"
    for _ in range(3000):
        text = "".join(rng.choice(letters) for _ in range(rng.randint(0, 30)))
        assert np.frombuffer(encoder.encode(text.encode()), "<u4").tolist() == plain.encode(text, add_special_tokens=False).ids, repr(text)
    assert zlib.crc32(b"") == 0


def test_languages(spark, odd):
    vowels = [("aa", "aeiou"), ("bb", "xyzkw")]
    rng = random.Random(4)
    rows = [(i, "".join(rng.choice(vowels[i % 2][1] + "tn ") for _ in range(300)), vowels[i % 2][0]) for i in range(80)]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    model = fit_languages(df.where("doc_id < 60"))
    got = {r["doc_id"]: r for r in identify_languages(df, model).collect()}
    assert all(got[i]["lang_pred"] == lang for i, _, lang in rows if i >= 60)
    odd_found = identify_languages(odd, model).collect()
    assert len(odd_found) == len(odd_rows())
    assert all(r["lang_pred"] == "und" and r["score"] == 0 for r in odd_found if r["doc_id"] in (5, 6, 7))
    # The tables give the same cost as the definition, byte by byte.
    seen = defaultdict(int)
    texts = [t.encode() for i, t, lang in rows if i < 60 and lang == "aa"]
    for t in texts:
        for k in range(1, 6):
            for i in range(len(t) - k + 1):
                seen[t[i : i + k]] += 1
    follow = defaultdict(dict)
    for s, n in seen.items():
        follow[s[:-1]][s[-1]] = n
    sample, bits = rows[61][1].encode()[:120] + b"aeiou tn", 0.0
    for i, c in enumerate(sample):
        for k in range(min(4, i), -1, -1):
            f = follow.get(sample[i - k : i], {})
            total, kinds = sum(f.values()), len(f)
            if c in f:
                bits -= np.log2(f[c] / (total + kinds))
                break
            if f:
                bits -= np.log2(kinds / (total + kinds))
        else:
            bits += 8
    assert model.lengths(np.frombuffer(sample, np.uint8))[model.languages.index("aa")] == pytest.approx(bits)


def test_toxicity(spark, odd):
    rng = random.Random(6)
    rows = [(i, prose(i, 40) + (" you are a " + rng.choice(["stupid idiot", "pathetic loser"]) if i % 3 == 0 else " you are kind")) for i in range(240)]
    labels = spark.createDataFrame([(i, int(i % 3 == 0)) for i, _ in rows if i < 180] + [(None, 1), (1, None), (9999, 1)], "doc_id long, toxic int")
    df = spark.createDataFrame(rows, DOC)
    model = fit_toxicity(df, labels, trees=5)
    got = {r["doc_id"]: r["score"] for r in model.score(df, ["doc_id"]).select("doc.doc_id", "score").collect()}
    assert all((got[i] >= 0.3) == (i % 3 == 0) for i in range(180, 240))
    scored = model.score(odd, odd.columns).select("doc.*", (model.score(odd, ["doc_id"]).schema["score"].name))
    assert scored.count() == len(odd_rows())
    one_class = fit_toxicity(df, labels.where("toxic = 0"))
    assert one_class.score(df, ["doc_id"]).first()["score"] == pytest.approx(1 / 122)


def test_urls(spark):
    urls = ["http://WWW.Example.com/en/1", "https://m.example.com/en/x?q=1", "http://a.net/es/1#x", "http://net/fr/", "http://com", "http://com/", "xyz.com/en/", None, "a://b://c/d", "http://notexample.com/en/1", "ftp://a.org/bad/1?k=v", "http://a.org/bad/2?k=v"]
    train = [f"http://h{i % 5}.org/{'bad' if i % 2 else 'good'}/{i}?k={i}" for i in range(80)]
    pages = spark.createDataFrame(list(enumerate(urls + train)) + [(0, urls[0])], "page_id long, url string")
    labels = spark.createDataFrame([(len(urls) + i, bool(i % 2)) for i in range(80)] + [(None, True), (1, None)], "page_id long, bad boolean")
    got = judge_urls(pages, labels).collect()
    assert len(got) == len(urls) + 81
    by = {r["page_id"]: (r["host"], r["path"], r["rule"], r["verdict"]) for r in got}
    assert by[0] == ("www.example.com", "/en/1", "www.example.com/en/", "allow")
    assert by[1] == ("m.example.com", "/en/x", "example.com/en/", "block")
    assert by[2] == ("a.net", "/es/1", "net/es/", "block")
    assert by[3][2:] == ("net/fr/", "block")
    assert by[4] == ("com", "", None, "allow")
    assert by[5][2:] == ("com/", "allow")
    assert by[6][:3] == ("", "", None) and by[7][:3] == ("", "", None)
    assert by[8][:2] == ("b:", "//c/d")
    assert by[9][2] == "com/"
    assert by[10][2:] == (None, "block") and by[11][3] == "block"
    assert judge_urls(pages, labels.limit(0)).where("n_mined > 0").count() == 0
    assert judge_urls(pages.limit(0), labels).count() == 0


def test_large_families_around_two_pivots(spark):
    """Near copies of a text and of its own near copy: brute force over all pairs."""
    rng = random.Random(12)
    base = " ".join(f"w{rng.randrange(10**6)}" for _ in range(120))
    bases = [base, edited(base, 1, 3)]
    rows = [(i, edited(bases[i % 2], 100 + i, rng.choice([0, 1, 1, 2, 3, 4]))) for i in range(1000)]
    got = similar_documents(spark.createDataFrame(rows, DOC), Threshold(5, 4, 5)).collect()
    assert sorted(str((r["doc_id"], r["n_shingles"], r["component_id"])) for r in got) == classes(rows, Threshold(5, 4, 5))


def test_pairs_of_a_family_grow_with_its_members(spark):
    """All lack what the pivot alone adds; only twins agree in more than that."""
    rule, rows = Threshold(5, 4, 5), []
    for i in range(800):
        twin = 1000 + 40 * (i // 2)
        own = 10**6 + 40 * i
        lacks = [*range(12), *range(twin, twin + 3)]
        adds = [*range(twin + 10, twin + 22), *range(own, own + 3)]
        rows.append((i, -1, i % 4 == 0, True, lacks, adds))
    compared = spark.createDataFrame(rows, "u long, v long, linked boolean, near boolean, lacks array<long>, adds array<long>")
    members, pairs = family_pairs(compared, rule)
    assert members.count() == 801
    found = {tuple(sorted((r["u"], r["v"]))) for r in pairs.collect()}
    assert {(i, i + 1) for i in range(0, 800, 2)} <= found
    assert len(found) <= 2 * 800


def test_words_of_several_texts_are_learned_together():
    spec = open(public_tokenizers.path("word_bpe_49k.json"), encoding="utf-8").read()
    encoder, plain = WordEncoder(spec, limit=20), Tokenizer.from_str(spec)
    texts = [f"Wort{i} müßig, {prose(i, 12)} <|endoftext|> it's {i}" for i in range(30)]
    for lo in range(0, 30, 10):
        got = [np.frombuffer(x, "<u4").tolist() for x in encoder.encode_all([t.encode() for t in texts[lo : lo + 10]])]
        assert got == [plain.encode(t, add_special_tokens=False).ids for t in texts[lo : lo + 10]]


def test_bunches_hold_every_text_once():
    sizes = [0, 10, BUNCH - 5, 10, 3 * BUNCH, 0, 1]
    cuts = list(_bunches(pa.array([b"x" * n for n in sizes])))
    assert [i for lo, n in cuts for i in range(lo, lo + n)] == list(range(len(sizes)))
    assert all(n == 1 or sum(sizes[lo : lo + n]) <= BUNCH for lo, n in cuts) and len(cuts) == 5
    assert list(_bunches(pa.array([], pa.binary()))) == []


def test_seeds_carry_the_words_of_a_text_once():
    rule = PassageRule()
    batch = pa.RecordBatch.from_pydict({"doc_id": [1, 2, 3, 4], "text": [prose(1, 60).encode(), b"", prose(1, 60).encode(), prose(2, 80).encode()]})
    words = next(_seeds(rule)(iter([batch]))).column("words").to_pylist()
    assert [len(w) // 4 if w else None for w in words] == [60, None, None, 80]
    (h,) = word_hashes([prose(2, 80).encode()])
    assert words[3] == (h >> np.uint64(32)).astype("<u4").tobytes()


def test_a_set_of_many_pairs_is_in_the_name_filter_once(spark):
    names = spark.range(400).selectExpr("xxhash64(id % 4) AS sid")
    assert name_slots(names).count() == 8
    assert (name_filter(names) == name_filter(names.distinct())).all()


def test_toxicity_learns_words_that_no_list_holds(spark):
    rng = random.Random(5)

    def text(i: int) -> str:
        out = prose(i, 60).split()
        for _ in range(3 if i % 4 == 0 else 0):
            out.insert(rng.randrange(len(out)), rng.choice(["Übelzorn", "übelzorn", "grumfel"]) + "".join(rng.choice("abcdefg") for _ in range(3)))
        return " ".join(out)

    docs = spark.createDataFrame([(i, text(i)) for i in range(600)], "doc_id long, text string")
    labels = spark.createDataFrame([(i, int(i % 4 == 0)) for i in range(400)], "doc_id long, toxic int")
    scores = {r["doc"]["doc_id"]: r["score"] for r in fit_toxicity(docs, labels, trees=5).score(docs, ["doc_id"]).collect()}
    assert all(scores[i] >= 0.3 for i in range(400, 600) if i % 4 == 0)
    assert all(scores[i] < 0.3 for i in range(400, 600) if i % 4)


def test_sets_beside_a_family_are_not_paired_with_its_members(spark):
    """Members around a pivot and guests that share much with all of them: only a guest's near twin is worth a look."""
    rule, rows, size = Threshold(3, 9, 10), [], 200
    for i in range(300):
        rows.append((i, -1, True, True, size, [i % size, (i * 7 + 1) % size], [10**6 + 10 * i]))
    for i in range(60):
        far = [(i + k * 3) % size for k in range(50)]
        rows.append((1000 + i, -1, False, True, size, far, [10**7 + 100 * i + k for k in range(40)]))
    rows.append((1060, -1, False, True, size, rows[300][5], [*rows[300][6][:-1], 5]))
    kinds = "u long, v long, linked boolean, near boolean, size long, lacks array<long>, adds array<long>"
    compared = spark.createDataFrame(rows, kinds)
    members, _ = family_members(compared.where("u < 1000 OR u = 1060"), rule)
    guests = _changed(compared.where("u >= 1000 AND u < 1060"), rule, True)
    found = {tuple(sorted(r)) for r in pairs_inside(members.unionByName(guests), rule).collect()}
    assert (1000, 1060) in found
    assert all(1060 in pair for pair in found)


@pytest.mark.parametrize("rule", [Threshold(3, 9, 10), Threshold(5, 4, 5)])
def test_families_linked_only_through_members(spark, rule):
    """Chains of small steps lead from one pivot's family to the next: brute force over all pairs."""
    rng, rows = random.Random(5), []
    for chain_of in range(12):
        words = [f"c{chain_of}w{rng.randrange(10**6)}" for _ in range(90)]
        for step in range(25):
            words[rng.randrange(90)] = f"n{rng.randrange(10**6)}"
            rows.append((len(rows), " ".join(words)))
            rows += [(len(rows) + k, edited(" ".join(words), 1000 * chain_of + 10 * step + k, k)) for k in range(rng.randrange(3))]
    got = similar_documents(spark.createDataFrame(rows, DOC), rule).collect()
    assert sorted(str((r["doc_id"], r["n_shingles"], r["component_id"])) for r in got) == classes(rows, rule)


def test_a_worker_keeps_neither_its_last_batch_nor_tables_after_a_task(monkeypatch):
    alive, at_the_end = [], []

    class Batch(bytes):
        def __del__(self):
            alive.remove(len(self))

    @giving_back
    def run(batches):
        for batch in batches:
            yield len(common.words(batch, SPACED)[0])

    def batches():
        for n in (3, 5):
            alive.append(2 * n)
            yield Batch(b"a " * n)

    release = common.give_back
    monkeypatch.setattr(common, "give_back", lambda: (at_the_end.append(list(alive)), release()))
    assert list(run(batches())) == [3, 5]
    assert at_the_end == [[]]
    assert common._powers is None


def test_cached_words_go_at_the_end_of_a_task(tmp_path, monkeypatch):
    spec = open(public_tokenizers.path("word_bpe_49k.json"), encoding="utf-8").read()
    encoder = WordEncoder(spec)
    monkeypatch.setattr(token_codes, "_encoder", lambda _: encoder)
    monkeypatch.setattr(token_codes, "TaskContext", type("Task", (), {"get": staticmethod(lambda: type("At", (), {"partitionId": staticmethod(lambda: 0)}))}))
    batch = pa.RecordBatch.from_pydict({"doc_id": [1, 2], "text": [prose(1, 60).encode(), b"wordly, wordly"]})
    made = list(_writer(str(tmp_path), spec, 2, 1 << 21)(iter([batch])))
    assert made[0].column("n_docs").to_pylist() == [2]
    assert encoder.words == ({}, {}) and encoder.parts == ({}, {})
