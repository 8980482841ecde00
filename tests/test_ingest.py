import datetime as dt

from pyspark.sql import functions as F

from areapulse.operators import ingest, ranking, reshape, scoring
from areapulse.session import fresh_dir
from areapulse.sources import sinks, tables


def test_keep_last_and_dotted_key(spark):
    df = spark.createDataFrame([({"v": "a"}, 1), ({"v": "a"}, 3), ({"v": "b"}, 2)], "_id struct<v:string>, seq int")
    kept = ingest.dedupe_keep_last(df, "_id.v", "seq")
    assert sorted((r["_id"]["v"], r["seq"]) for r in kept.collect()) == [("a", 3), ("b", 2)]
    first = ingest.dedupe_keep_first(df, "_id.v", "seq")
    assert sorted(r["seq"] for r in first.collect()) == [1, 2]


def test_dedupe_limits_below_the_exchange(spark):
    plan = ingest.dedupe_keep_last(spark.range(10).withColumn("k", F.col("id") % 2), "k", "id")
    text = plan._jdf.queryExecution().executedPlan().toString()
    assert "WindowGroupLimit" in text and "Partial" in text


def test_insert_new_inside_batch_and_against_store(spark):
    stored = spark.createDataFrame([(1, 0)], "id int, seq int")
    incoming = spark.createDataFrame([(1, 1), (2, 1), (2, 2), (3, 1)], "id int, seq int")
    new = ingest.insert_new_only(stored, incoming, "id", "seq")
    assert sorted(tuple(r) for r in new.collect()) == [(2, 2), (3, 1)]


def test_chunks_are_half_open(spark):
    at = [dt.datetime(2024, 1, 1), dt.datetime(2024, 1, 10, 23, 59, 59), dt.datetime(2024, 1, 11), dt.datetime(2024, 1, 15)]
    df = spark.createDataFrame([(t,) for t in at], "ts timestamp_ntz")
    tagged = ingest.chunk_range_join(df, "ts", "2024-01-01", "2024-01-15", 10)
    assert sorted((r["ts"], r["chunk_no"]) for r in tagged.collect()) == [(at[0], 0), (at[1], 0), (at[2], 1)]
    ranges = spark.createDataFrame([(dt.datetime(2024, 1, 1), dt.datetime(2024, 1, 15))], "lo timestamp_ntz, hi timestamp_ntz")
    chunks = ingest.date_chunks(ranges, "lo", "hi", 10).orderBy("chunk_no").collect()
    assert [(r["chunk_no"], r["chunk_end"]) for r in chunks] == [(0, dt.datetime(2024, 1, 11)), (1, dt.datetime(2024, 1, 15))]


def test_flatten_nested_posts(spark):
    posts = spark.createDataFrame(
        [(1, "p", 9, 0.0, [(2, "c1", 9, 0.0, 1), (3, "c2", 9, 0.0, 1)]), (4, "q", 9, 0.0, None)], tables.POST
    )
    flat = ingest.flatten_nested(posts)
    assert sorted(tuple(r) for r in flat.collect()) == [(1, False, "c1"), (1, False, "c2"), (1, True, "p"), (4, True, "q")]


def test_update_keeps_old_values(spark):
    df = spark.createDataFrame([(1, "a", 1.0), (2, "b", 2.0)], "id int, s string, x double")
    patch = spark.createDataFrame([(2, None, 5.0)], "id int, s string, x double")
    assert sorted(tuple(r) for r in ingest.update_set_by_key(df, patch, "id", ["s", "x"]).collect()) == [(1, "a", 1.0), (2, "b", 5.0)]


def test_main_text(spark):
    html = (
        "<html><head><title>T</title></head><body><nav>menu</nav><article><h1>Head</h1><p>One &amp; <b>two</b></p>"
        "<table><tr><td>x</td></tr></table><!-- note --><script>var a='</p>';</script></article><footer>f</footer></body></html>"
    )
    got = spark.createDataFrame([(html,), (None,)], "h string").select(ingest.extract_main_text(F.col("h")).alias("o")).collect()
    assert [r["o"] for r in got] == ["Head\nOne & two", ""]


def test_dates(spark):
    raw = [("Thu, 02 Jan 2020 03:04:05 GMT",), ("2020-01-02",), ("soon",), (None,)]
    df = spark.createDataFrame(raw, "d string")
    got = df.select(reshape.parse_rfc822(F.col("d")).alias("a"), reshape.parse_iso_at_eight(F.col("d")).alias("b"))
    got = got.select(F.date_format("a", "yyyy-MM-dd HH:mm:ss"), F.date_format("b", "yyyy-MM-dd HH:mm:ss")).collect()
    assert [tuple(r) for r in got] == [("2020-01-02 03:04:05", None), (None, "2020-01-02 08:00:00"), (None, None), (None, None)]


def test_trend_documents_without_series(spark):
    docs = spark.createDataFrame(
        [({"timeline_data": [{"timestamp": "1577836800", "values": [{"query": "a", "extracted_value": 3.0}]}]}, "x", "s"), (None, "y", "s")],
        tables.TREND_DOCUMENT,
    )
    rows = tables.scan_nested_series(docs, ["area"]).collect()
    assert [(r["area"], r["keyword"], r["value"]) for r in rows] == [("x", "a", 3.0)]


def test_epoch_filter_is_half_open(spark):
    df = spark.createDataFrame([(0,), (86399,), (86400,)], "e long")
    assert tables.epoch_filter(df, "e", "1970-01-01", "1970-01-02").count() == 2


def test_partitioned_csv_round_trip(spark):
    path = fresh_dir(spark, "csv")
    sinks.sink_partitioned(spark.createDataFrame([(1, "a"), (2, "b"), (3, "a")], "x int, area string"), path, ["area"], "csv")
    back = spark.read.schema("x int, area string").option("header", True).csv(path)
    assert sorted(tuple(r) for r in back.collect()) == [(1, "a"), (2, "b"), (3, "a")]


def test_row_numbers_and_ranks_with_a_hot_group(spark):
    rows = [(i, "hot" if i % 3 else "cold", float(i % 7 if i % 5 else 1)) for i in range(2000)]
    df = spark.createDataFrame(rows, "id long, g string, v double")
    numbered = ranking.number_rows(df, "id").orderBy("id").collect()
    assert [r["row_id"] for r in numbered] == list(range(2000))
    ranks = ranking.value_ranks(df, "v", ["g"]).collect()
    got = {(r["g"], r["v"]): (r["n"], r["before"], r["dense"]) for r in ranks}
    for g in ("hot", "cold"):
        values = [v for _, h, v in rows if h == g]
        for d, v in enumerate(sorted(set(values)), start=1):
            assert got[(g, v)] == (values.count(v), sum(x < v for x in values), d)


def test_capped_sample_is_stable_and_exact(spark):
    df = spark.range(9000).withColumn("g", F.when(F.col("id") < 6000, "hot").otherwise("cold"))
    runs = [scoring.capped_sample(df.repartition(n), "g", "id", 2500) for n in (3, 7)]
    sets = [{r["id"] for r in run.collect()} for run in runs]
    assert sets[0] == sets[1] and len(sets[0]) == 5000
    plain = scoring.capped_sample(df, "g", "id", 10)
    assert plain.groupBy("g").count().where("count = 10").count() == 2


def test_capped_sample_keeps_null_keys(spark):
    rows = [("a", None), ("a", 1), ("a", 2)] + [("b", None)] * 5
    got = scoring.capped_sample(spark.createDataFrame(rows, "g string, id long"), "g", "id", 3).toPandas()
    assert got["g"].tolist().count("a") == 3 and got["g"].tolist().count("b") == 3
    assert got["id"].isna().sum() == 4


def test_ranks_keep_nulls_and_take_any_key_type(spark):
    rows = [("b", None, 2.0), (None, "x", None), ("a", "x", 1.0), ("c", None, 2.0)]
    df = spark.createDataFrame(rows, "k string, g string, v double")
    numbered = {r["k"]: r["row_id"] for r in ranking.number_rows(df, "k").collect()}
    assert numbered == {None: 0, "a": 1, "b": 2, "c": 3}
    ranks = {(r["g"], r["v"]): (r["n"], r["before"], r["dense"]) for r in ranking.value_ranks(df, "v", ["g"]).collect()}
    assert ranks == {(None, 2.0): (2, 0, 1), ("x", None): (1, 0, 1), ("x", 1.0): (1, 1, 2)}
    days = df.select(F.expr("timestamp_ntz'2024-01-01 00:00:00' + make_interval(0, 0, 0, cast(v as int))").alias("ts"), "k").where("v IS NOT NULL")
    assert [r["row_id"] for r in ranking.number_rows(days.dropDuplicates(["ts"]), "ts").orderBy("ts").collect()] == [0, 1]
