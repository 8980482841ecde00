import glob
import os

from areapulse.session import fresh_dir
from areapulse.sources.buckets import BucketStore

SCHEMA = "id long, name string, score double"


def _store(spark, rows, buckets=16):
    store = BucketStore(spark, fresh_dir(spark, "buckets"), "id", SCHEMA, buckets)
    store.create(spark.createDataFrame(rows, SCHEMA))
    return store


def _files(store):
    return {(b, os.path.basename(f)) for f in glob.glob(f"{store.path}/bucket=*/*.parquet") for b in [int(f.split("bucket=")[1].split("/")[0])]}


def _rows(store):
    return sorted((tuple(r) for r in store.rows().collect()), key=lambda r: (r[0] is None, r[0] or 0))


def test_upsert_sets_values_adds_keys_and_leaves_other_buckets(spark):
    store = _store(spark, [(i, f"n{i}", 1.0) for i in range(500)] + [(None, "null key", 0.0)])
    before = _files(store)
    patch = spark.createDataFrame([(3, None, 9.0), (7, "seven", None), (900, "new", None)], SCHEMA)
    touched = store.upsert(patch)
    after = _files(store)
    assert 0 < len(touched) <= 3
    assert {f for f in before if f[0] not in touched} == {f for f in after if f[0] not in touched}
    assert not {f for f in before if f[0] in touched} & after
    rows = {r[0]: r[1:] for r in _rows(store)}
    assert rows[3] == ("n3", 9.0) and rows[7] == ("seven", 1.0) and rows[900] == ("new", None) and rows[None] == ("null key", 0.0)
    assert len(rows) == 502 and rows[8] == ("n8", 1.0)


def test_patch_of_some_columns_null_keys_and_replay(spark):
    store = _store(spark, [(1, "a", 1.0), (2, "b", 2.0), (None, "n", 3.0)])
    patch = spark.createDataFrame([(None, 5.0, 1), (None, 6.0, 2), (2, 7.0, 1)], "id long, score double, at int")
    store.upsert(patch, order="at")
    want = [(1, "a", 1.0), (2, "b", 7.0), (None, "n", 6.0)]
    assert _rows(store) == want
    store.upsert(patch, order="at")
    assert _rows(store) == want
    store.upsert(spark.createDataFrame([(50, "x", 1.0)], SCHEMA), insert=False)
    assert _rows(store) == want


def test_insert_new_keeps_stored_rows_and_untouched_files(spark):
    store = _store(spark, [(i, "old", 1.0) for i in range(100)])
    before = _files(store)
    assert store.insert_new(spark.createDataFrame([(i, "again", 2.0) for i in range(100)], SCHEMA)) == []
    assert _files(store) == before
    changed = store.insert_new(spark.createDataFrame([(5, "again", 2.0), (200, "new", 3.0), (None, "n", 4.0)], SCHEMA))
    assert {f for f in before if f[0] not in changed} <= _files(store)
    rows = {r[0]: r[1] for r in _rows(store)}
    assert rows[5] == "old" and rows[200] == "new" and rows[None] == "n" and len(rows) == 102
    assert store.insert_new(spark.createDataFrame([(None, "n2", 4.0)], SCHEMA)) == []


def test_empty_patch(spark):
    store = _store(spark, [(1, "a", 1.0)])
    assert store.upsert(spark.createDataFrame([], SCHEMA)) == [] and _rows(store) == [(1, "a", 1.0)]
