import re
import unicodedata

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from areapulse.functions import text as tx
from areapulse.operators import keywords as kw
from areapulse.operators import tokens
from areapulse.params import AREA_ALIASES, AREA_CODES, STOP_WORDS
from areapulse.operators.reshape import canonical_key


def one(spark, value, expr):
    return spark.createDataFrame([(value,)], "t string").select(expr(F.col("t")).alias("o")).first()["o"]


CLEAN = [
    (None, ""),
    ("", ""),
    ("<b>Hola</b> Mundo", "hola mundo"),
    ("ver http://a.b/c?d=1 aquí", "ver aquí"),
    ("¡Ñandú, ÉXITO! 50%", "ñandú éxito 50"),
    ("a b c\n\td", "a b c d"),
    ("under_score - x", "under_score x"),
    ("<a\nb> c", "a b c"),
]


@pytest.mark.parametrize("raw,want", CLEAN)
def test_clean_text(spark, raw, want):
    assert one(spark, raw, tx.clean_text) == want


def test_lengths_around_the_limit(spark):
    rows = [("a" * n + "!",) for n in (9, 10, 11)] + [(None,)]
    cleaned = spark.createDataFrame(rows, "t string").select(F.length(tx.clean_text(F.col("t"))).alias("n"))
    assert sorted(r["n"] for r in cleaned.where("n >= 10").collect()) == [10, 11]


def test_nfc_orders_and_joins_several_marks(spark):
    marks = "\u0300\u0301\u0302\u0304\u0308\u0323\u0327\u0328\u031b\u0331"
    values = [f"x{b}{m}{n}y" for b in "aeouAsZêạ" for m in marks for n in marks]
    values += ["ệ\u0301\u0323", "a\u0315\u0300\u05aeb", "\u0301\u0323a", "word e\u0302\u0301 and ê\u0301\u0301 end", "q\u0323\u0307", "e\u0301 " * 3000 + "o\u0302\u0323"]
    values = [v for v in values if not any(0x370 <= ord(c) < 0x600 for c in v)]
    rows = spark.createDataFrame([(i, v) for i, v in enumerate(values)], "i int, t string").select("i", tx.nfc(F.col("t")).alias("o"))
    got = {r["i"]: r["o"] for r in rows.collect()}
    bad = [(v, got[i]) for i, v in enumerate(values) if got[i] != unicodedata.normalize("NFC", v)]
    assert bad == []


def test_nfc_matches_unicodedata(spark):
    words = ["discriminación", "México", "Querétaro", "ñandú", "façade", "über", "Ångström", "plain", "", "é", "x́y", "́a"]
    apart = [unicodedata.normalize("NFD", w) for w in words]
    got = spark.createDataFrame([(w,) for w in apart], "t string").select(tx.nfc(F.col("t")).alias("o")).collect()
    assert [r["o"] for r in got] == [unicodedata.normalize("NFC", w) for w in apart]


@settings(max_examples=15, deadline=None)
@given(st.lists(st.text(alphabet="abceinouzñéüçÁ ", max_size=12), min_size=1, max_size=20))
def test_nfc_property(spark, values):
    apart = [unicodedata.normalize("NFD", v) for v in values]
    got = spark.createDataFrame([(i, v) for i, v in enumerate(apart)], "i int, t string").select("i", tx.nfc(F.col("t")).alias("o"))
    assert [r["o"] for r in got.orderBy("i").collect()] == [unicodedata.normalize("NFC", v) for v in apart]


def test_canonical_key_merges_spellings(spark):
    raw = ["  Mexico ", unicodedata.normalize("NFD", "México"), "Yucatan", "Jalisco", None]
    got = spark.createDataFrame([(r,) for r in raw], "t string").select(canonical_key(F.col("t"), AREA_ALIASES).alias("o")).collect()
    assert [r["o"] for r in got] == ["Estado de México", "Estado de México", "Yucatán", "Jalisco", None]


def test_title_label(spark):
    assert one(spark, "ACCESS_TO_FOOD", tx.title_label) == "Access To Food"


TEXTS = [
    (1, "Baja California Sur y baja california"),
    (2, "CALIFORNIA Baja"),
    (3, "Querétaro, QUERÉTARO; queretaro"),
    (4, "Colimas no es Colima."),
    (5, ""),
    (6, "Ciudad  de México"),
]


@pytest.mark.parametrize("long_list", [False, True])
def test_area_mentions(spark, long_list):
    df = spark.createDataFrame(TEXTS, "id int, text string")
    areas = list(AREA_CODES.values())
    if long_list:
        table = spark.createDataFrame([(a,) for a in areas], "area string")
        found = kw.tag_area_table(df, "id", "text", table)
    else:
        found = kw.tag_area_mentions(df, "text", areas, ["id"])
    want = {(1, "Baja California"), (1, "Baja California Sur"), (3, "Querétaro"), (4, "Colima")}
    rows = [tuple(r) for r in found.select("id", "area").collect()]
    assert set(rows) == want and len(rows) == len(want)


def test_phrases_equal_a_regex_count(spark):
    phrases = [("a", "pan"), ("a", "pan de"), ("b", "pan"), ("b", "co-op"), ("c", "a a"), ("c", "ñu")]
    texts = ["pan de pan de PAN", "pande pan,de co-op co op CO-OP", "a a a a", "ñu ñus ÑU", "", "pan  de"]
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "id int, text string")
    found = kw.find_phrases(df, "text", kw.phrase_list(spark, phrases), ["id"])
    got = {tuple(r) for r in found.groupBy("id", "dimension", "phrase").agg(F.sum("hits")).collect()}
    want = set()
    for i, t in enumerate(texts):
        for d, p in phrases:
            n = len(re.findall(r"\b" + re.escape(p) + r"\b", t.lower()))
            if n:
                want.add((i, d, p, n))
    assert got == want


@pytest.mark.parametrize("entries", [2, 602, 100_000])
def test_one_lemma_plan_for_every_dictionary(spark, entries):
    lemmas = {"cats": "cat", "dogs": "dog"} | {f"x{i}": f"y{i}" for i in range(entries - 2)}
    rows = [(1, ["cats"]), (1, ["dogs", "été", ""]), (None, ["cats", None, "zz"]), (2, []), (3, None), (4, ["x1", "x599", "a"])]
    df = spark.createDataFrame(rows, "id int, t array<string>")
    got = sorted(str(tuple(r)) for r in tokens.lemma_lookup(df, "t", lemmas).select("id", "lemmas").collect())
    want = [(i, t and [lemmas.get(w, w) for w in t]) for i, t in rows]
    assert got == sorted(map(str, want))


def test_lemma_of_every_entry(spark):
    lemmas = {w: f"<{w}>" for w in ["a", "aa", "b", "é", "z", "😀", "ä", "Z", "0"]}
    df = spark.createDataFrame([(sorted(lemmas) + ["", "zz", "~"],)], "t array<string>")
    got = tokens.lemma_lookup(df, "t", lemmas).first()["lemmas"]
    assert got == [f"<{w}>" for w in sorted(lemmas)] + ["", "zz", "~"]
    assert tokens.lemma_lookup(df, "t", {}).first()["lemmas"] == df.first()["t"]


def test_long_area_list_equals_patterns(spark):
    areas = ["San Luis", "san  luis", "Luis Potosí", "co-op", "C.D.", "(north)", "the", "The", "a", "Río Bravo del Norte", "x_1"]
    texts = [
        (1, "San Luis Potosí, san  luis; SAN LUIS"), (2, "the co-op (north) of C.D. x"), (3, "a A the-a"), (4, "C.D.x north"), (5, None), (6, ""),
        (7, "río bravo del norte x_1 x_12"), (8, "(The) (North)"), (9, ", a"),
    ]
    df = spark.createDataFrame(texts, "id int, text string")
    found = kw.tag_area_table(df, "id", "text", spark.createDataFrame([(a,) for a in areas], "area string"))
    want = {(i, a) for i, t in texts for a in areas if re.search(r"(?<!\w)" + re.escape(a.lower()) + r"(?!\w)", (t or "").lower())}
    rows = [tuple(r) for r in found.collect()]
    assert set(rows) == want and len(rows) == len(want)


def test_ten_thousand_areas(spark):
    areas = [f"place {i} of land" for i in range(10_000)]
    texts = [(i, f"From Place {i * 7} of Land, to place {i} of\nland") for i in range(50)]
    df = spark.createDataFrame(texts, "id int, text string")
    found = kw.tag_area_table(df, "id", "text", spark.createDataFrame([(a,) for a in areas], "area string"))
    assert sorted(tuple(r) for r in found.collect()) == sorted((i, f"place {i * 7} of land") for i in range(50))
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert not [line for line in plan.splitlines() if "Exchange" in line and "text" in line]


def test_language_default_and_tie(spark):
    df = spark.createDataFrame([("",), ("the und",), ("los los the",)], "t string")
    got = df.select(tokens.language_route(F.col("t"), STOP_WORDS, "es").alias("o")).collect()
    assert [r["o"] for r in got] == ["es", "de", "es"]


def test_ngrams(spark):
    got = spark.createDataFrame([(["a", "b", "c"],), (["a"],), ([],)], "t array<string>").select(tokens.ngrams_1_3(F.col("t")).alias("g"))
    assert [r["g"] for r in got.collect()] == [["a", "b", "c", "a b", "b c", "a b c"], ["a"], []]


def test_pruned_ngrams_equal_plain_counting(spark):
    docs = [["a", "b", "c", f"r{i}", "a", "b"] if i % 2 else ["b", "c", "a"] for i in range(12)] + [[]]
    df = spark.createDataFrame([(i, t) for i, t in enumerate(docs)], "id int, t array<string>")
    plain = tokens.vocab_prune(df.withColumn("g", tokens.ngrams_1_3(F.col("t"))), "g", 0.3, 0.6)
    pruned = tokens.ngram_vocabulary(df, "t", (1, 2, 3), 0.3, 0.6)
    got, want = (sorted(tuple(r) for r in d.select("term", "doc_freq").collect()) for d in (pruned, plain))
    assert got == want and len(got) > 3


def test_vocabulary_bounds(spark):
    df = spark.createDataFrame([(i, ["all", f"t{i % 2}", f"u{i}"]) for i in range(10)], "id int, t array<string>")
    assert {r["term"] for r in tokens.vocab_prune(df, "t", 0.2, 0.6).collect()} == {"t0", "t1"}


def test_decomposed_letters_are_found(spark):
    decomposed = "en Michoaca\u0301n hay"
    df = spark.createDataFrame([(1, decomposed)], "id long, text string")
    assert df.select(tx.clean_text(F.col("text"))).first()[0] == "en michoac\u00e1n hay"
    assert [r["area"] for r in kw.tag_area_mentions(df, "text", ["Michoac\u00e1n", "Oaxaca"], ["id"]).collect()] == ["Michoac\u00e1n"]
    listed = kw.phrase_list(spark, [("d", "Michoac\u00e1n")])
    assert kw.find_phrases(df, "text", listed, ["id"]).first()["hits"] == 1
