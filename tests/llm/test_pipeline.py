"""The pipeline against a brute-force version, stage by stage and as a whole."""

import numpy as np
import public_tokenizers
import pytest
from conftest_llm import odd_rows, prose
from test_documents import ALNUM, LOW, WORD, classes, hits
from tokenizers import Tokenizer

import corpus_pipeline
from areapulse.llm.jaccard_join import Threshold
from areapulse.llm.queries import QUERIES, SQL
from areapulse.session import fresh_dir


@pytest.fixture(scope="module")
def folder(spark, odd):
    """Tables of the odd rows, copies, a contaminated and some toxic documents."""
    path = fresh_dir(spark, "pipeline-in")
    rows = [(100 + i, prose(100 + i, 50 + i), "en", "d", 9) for i in range(40)]
    rows += [(200 + i, prose(100 + i, 50 + i) + " more", "en", None, 9) for i in range(10)]
    rows += [(300 + i, prose(300 + i, 60) + " you are a stupid idiot, pathetic loser", "en", "e", 9) for i in range(20)]
    rows += [(400, prose(900, 40), "en", "d", 9), (401, prose(901, 300) + " " + prose(900, 14), "en", "d", 9)]
    wide = odd.select("doc_id", "text", "lang", "source", "n_chars", "n_words", "_h", "target")
    more = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    wide.unionByName(more, allowMissingColumns=True).write.parquet(f"{path}/documents.parquet")
    labels = [(i, 1, int(i >= 300)) for i, *_ in rows if i < 400] + [(None, None, 1)]
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(f"{path}/labels.parquet")
    spark.createDataFrame([(1, prose(900, 40)), (None, "x")], "item_id long, text string").write.parquet(f"{path}/benchmark.parquet")
    return path


def key(rows, columns):
    return sorted(str(tuple(r[c] for c in columns)) for r in rows)


def test_stages(spark, folder):
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    columns, kept = docs.columns, []
    for name, stage in corpus_pipeline.STAGES:
        docs = stage(spark, docs, folder).cache()
        kept.append(docs.collect())
        if name != "token_codes":
            assert docs.columns == columns
    toxic, one, clean, mixed, tokens = kept
    before = spark.read.parquet(f"{folder}/documents.parquet").collect()
    # Rejected documents go, all others stay as they are.
    assert key(toxic, columns) == key([r for r in before if not 300 <= (r["doc_id"] or 0) < 400], columns)
    # One row of each class stays, and every class has one.
    pairs = [(r["doc_id"], r["text"]) for r in toxic]
    roots = {eval(x)[2] for x in classes(pairs, Threshold(5, 4, 5))}
    assert {r["doc_id"] for r in one} == roots
    assert len({(r["doc_id"], r["text"]) for r in one}) == len(one)
    # Contaminated documents go; passages in others are cut, and nothing else changes.
    items = [(1, prose(900, 40))]
    found = {(r["doc_id"], r["text"]): hits(r["text"], items) if r["doc_id"] != 10 else (1, 0, []) for r in one}
    left = [k for k, (n, n_hit, _) in found.items() if not (n_hit and 20 * n_hit >= n)]
    assert sorted(str(r["doc_id"]) for r in clean) == sorted(str(i) for i, _ in left)
    for r in clean:
        if r["doc_id"] == 401:
            assert ALNUM.findall(r["text"].translate(LOW)) == ALNUM.findall(prose(901, 300).translate(LOW))
            assert r["n_chars"] == len(r["text"])
        else:
            assert (r["doc_id"], r["text"]) in found
    # The mix holds kept documents only, each at most twice.
    texts = {(r["doc_id"], r["text"]) for r in clean}
    taken = [(r["doc_id"], r["text"]) for r in mixed]
    assert set(taken) <= texts and max(taken.count(x) for x in set(taken)) <= 2
    sizes = [len(WORD.findall(t or "")) for _, t in texts]
    # Whole documents are taken, so each source may be off by half of one.
    assert abs(sum(len(WORD.findall(t or "")) for _, t in taken) - 1.5 * sum(sizes)) < 0.1 * sum(sizes) + max(sizes) / 2
    # Token files hold the mix in the order of ids.
    plain = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))
    want = sorted((i or -1, len(plain.encode(t or "", add_special_tokens=False).ids) + 1) for i, t in taken)
    got = sorted(tokens, key=lambda r: r["start"])
    assert sorted((r["doc_id"] or -1, r["n_tokens"]) for r in got) == want
    assert [r["start"] for r in got] == [0, *np.cumsum([r["n_tokens"] for r in got])[:-1].tolist()]


def test_run_is_the_chain_of_stages(spark, folder):
    once, again = (key(corpus_pipeline.run(spark, folder).collect(), ["doc_id", "start", "n_tokens", "ids_crc32"]) for _ in range(2))
    assert once == again and once
    assert corpus_pipeline.ORACLE_SQL is None and len(odd_rows())


def test_empty_tables(spark, folder):
    docs = spark.read.parquet(f"{folder}/documents.parquet").limit(0)
    for _, stage in corpus_pipeline.STAGES:
        assert stage(spark, docs, folder).count() == 0


def test_registered():
    with_sql = {"op1_quality_rules", "op2_secret_scan", "op3_source_mix", "op8_decontaminate"}
    assert set(SQL) == with_sql | {"op11_middle_fill", "op12_winnowing", "op13_turn_repair"}
    assert sorted(int(n[2:].split("_")[0]) for n in QUERIES) == list(range(1, 14))
