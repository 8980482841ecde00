import unicodedata

import numpy as np
import pytest
from pyspark.sql import functions as F

from areapulse.functions.numeric import round_even
from areapulse.functions.vectors import argmax_index
from areapulse.operators import indicators as ind
from areapulse.operators import reshape, scoring, topics
from areapulse.params import DIMENSIONS, OTHER, TREND_KEYWORDS
from areapulse.plans import news, texts, trends
from areapulse.sources import tables


def test_round_even(spark):
    got = spark.createDataFrame([(0.125,), (0.375,), (2.5,)], "x double").select(round_even(F.col("x")).alias("o")).collect()
    assert [r["o"] for r in got] == [0.12, 0.38, 2.5]


def test_shares_of_an_empty_area_are_zero(spark):
    df = spark.createDataFrame([("a", "X"), ("a", "X"), ("a", "Y")], "area string, dim string")
    areas = spark.createDataFrame([("a",), ("b",)], "area string")
    got = {(r["area"], r["dimension"]): (r["count"], round(r["percentage"], 3), r["total_posts"]) for r in ind.dimension_shares(df, "area", "dim", ["X", "Y", "Z"], areas).collect()}
    assert got[("a", "X")] == (2, 66.667, 3) and got[("a", "Z")] == (0, 0.0, 3)
    assert {v for k, v in got.items() if k[0] == "b"} == {(0, 0.0, 0)}


def test_conditional_sentiment_drops_nulls_from_shares(spark):
    df = spark.createDataFrame([("a", "X", 1.0, True), ("a", "X", -0.5, False), ("a", None, 1.0, False)], "area string, d string, s double, p boolean")
    raw = df.withColumn("r", ~F.col("p"))
    got = {r["dimension"]: r for r in ind.conditional_sentiment(raw, "area", "d", "s", ["X", "Y"], "p", "r").collect()}
    assert got["X"]["avg_sentiment"] == 0.25 and got["X"]["percentage_of_total"] == 100.0
    assert got["Y"]["avg_sentiment"] == 0.0 and got["Y"]["mentions_count"] == 0
    assert (got["Y"]["videos_analyzed"], got["Y"]["comments_analyzed"]) == (1, 2)


def test_threshold_edge_and_ties(spark):
    df = spark.createDataFrame([([0.10, 0.10, 0.0],), ([0.05, 0.09, 0.0],), ([0.2, 0.3, 0.3],)], "s array<double>")
    loose = [r[0] for r in df.select(scoring.classify_threshold(F.col("s"), ["A", "B", "C"], 0.10, OTHER)).collect()]
    strict = [r[0] for r in df.select(scoring.classify_threshold(F.col("s"), ["A", "B", "C"], 0.10, OTHER, True)).collect()]
    assert loose == ["A", OTHER, "B"] and strict == [OTHER, OTHER, "B"]
    assert [r[0] for r in df.select(argmax_index(F.col("s"))).collect()] == [0, 1, 1]


def test_cosine_with_zero_and_null_vectors(spark):
    df = spark.createDataFrame([(1, [3.0, 4.0]), (2, [0.0, 0.0]), (3, None)], "id int, v array<double>")
    got = {r["id"]: r["scores"] for r in scoring.cosine_scores(df, "v", [[1.0, 0.0], [0.0, 2.0]]).collect()}
    assert got[1] == pytest.approx([0.6, 0.8]) and got[2] == [0.0, 0.0] and got[3] is None


def test_scores(spark):
    df = spark.createDataFrame([(5, "good"), (1, "bad"), (4, "x")], "stars int, t string")
    assert [r[0] for r in df.select(scoring.star_score(F.col("stars"), F.col("t"))).collect()] == [1.0, -1.0, 0.0]


def test_user_encoder_and_scorer(spark):
    df = spark.createDataFrame([("ab",), (None,)], "t string")
    encoded = scoring.encode_text(df, "t", encoder=lambda ts: [[len(t), 1.0] for t in ts]).collect()
    assert [r["vector"] for r in encoded] == [[2.0, 1.0], [0.0, 1.0]]
    scored = scoring.sentiment_model(df, "t", lambda ts: [len(t) for t in ts]).collect()
    assert [r["class"] for r in scored] == [2, 0]


def _trend(area, keyword_set, query, values):
    points = [{"timestamp": str(1577836800 + i * 86400), "values": [{"query": query, "extracted_value": float(v)}]} for i, v in enumerate(values)]
    return ({"timeline_data": points}, area, keyword_set)


def test_trends_mean_of_means(spark):
    apart = unicodedata.normalize("NFD", "discriminación")
    docs = spark.createDataFrame(
        [
            _trend("A", "s1", "crisis", [1, 2, 2]),
            _trend("A", "s2", "crisis", [3]),
            _trend("A", "s1", "desempleo", [0, 0]),
            _trend("A", "s1", apart, [5]),
            _trend("A", "s1", "unlisted", [100]),
        ],
        tables.TREND_DOCUMENT,
    )
    words = {r["keyword"]: r["mean_value"] for r in trends.keyword_interest(docs, [2020]).collect()}
    want = float(np.round((1.67 + 3.0) / 2, 2))
    assert words["crisis"] == want and words["desempleo"] == 0.0 and words["discriminación"] == 5.0 and "unlisted" not in words
    dims = {r["dimension"]: r["mean_value"] for r in trends.dimension_interest(docs, [2020]).collect()}
    assert dims["income"] == want and dims["social_cohesion"] == 5.0 and dims["housing"] == 0.0
    assert set(dims) == set(TREND_KEYWORDS)


def test_rolling_mean_needs_three_periods(spark):
    df = spark.createDataFrame([("s", i, float(i)) for i in range(4)], "series string, p int, v double")
    got = [r["rolling_mean"] for r in ind.rolling_mean(df, "series", "p", "v").orderBy("p").collect()]
    assert got == [None, None, 1.0, 2.0]


def test_daily_counts_fill_missing_days(spark):
    df = spark.createDataFrame([("2024-01-01 10:00:00", True), ("2024-01-03 00:00:00", False)], "ts string, f boolean")
    got = ind.daily_counts(df.withColumn("ts", F.col("ts").cast("timestamp_ntz")), "ts", "f").orderBy("day").collect()
    assert [(r["total"], r["flagged"]) for r in got] == [(1, 1), (0, 0), (1, 0)]


def test_colours(spark):
    values = spark.createDataFrame([("x", "value_health", 1.0), ("y", "value_health", 2.0), ("z", "value_health", 2.0), ("x", "value_food", 7.0), ("y", "value_food", 7.0)], "area string, parameter string, value double")
    got = {(r["parameter"], r["value"]): r["color"] for r in reshape.color_classes(values).collect()}
    assert got == {("value_health", 1.0): "#add8e6", ("value_health", 2.0): "#00008b", ("value_food", 7.0): "#ffdab9"}


def test_union_and_bad_dates(spark):
    live = spark.createDataFrame([("u1", "Thu, 02 Jan 2020 03:04:05 GMT", "text"), ("u2", "bad", "text"), ("u3", "Thu, 02 Jan 2020 03:04:05 GMT", None)], "url string, `published date` string, content string")
    archive = spark.createDataFrame([("i1", "2022-05-01", "text")], "_id string, publish_date string, content string")
    got = news.combine_sources(live, archive, [2020, 2022]).collect()
    assert sorted((r["source_name"], r["year"], r["url"], r["_id"]) for r in got) == [("gnews", 2020, "u1", None), ("mcloud", 2022, None, "i1")]


def test_post_shares_count_each_area_and_short_posts(spark):
    rows = [(1, "Colima y Jalisco dinero dinero"), (2, "Colima"), (3, "Jalisco salud salud salud")]
    df = spark.createDataFrame(rows, "id int, text string")

    def encode(batch):
        return [[1.0 if "dinero" in t else 0.0, 1.0 if "salud" in t else 0.0] for t in batch]

    prototypes = [[1.0, 0.0], [0.0, 1.0]] + [[0.0, 0.0]] * 5
    got = {(r["area"], r["dimension"]): (r["count"], r["total_posts"]) for r in texts.post_shares(df, "id", "text", ["Colima", "Jalisco", "Sonora"], prototypes, encoder=encode).collect()}
    assert got[("Colima", "INCOME")] == (1, 2) and got[("Colima", OTHER)] == (1, 2)
    assert got[("Jalisco", DIMENSIONS[1])] == (1, 2) and got[("Sonora", OTHER)] == (0, 0)


def test_topics_separate_two_themes(spark):
    rows = [(i, "A", ["pan", "leche", "queso"] if i % 2 else ["gol", "juego", "equipo"]) for i in range(60)]
    df = spark.createDataFrame(rows, "id int, area string, tokens array<string>")
    fit = news.fit_topics(df, ["id", "area"], lengths=(1,), min_df=0.1, max_df=0.9, k=2, alpha=0.1, eta=0.1)
    top = [set(r["keywords"].split(", ")) for r in topics.topic_top_terms(fit.model, fit.vocabulary, 3).collect()]
    assert {"pan", "leche", "queso"} in top and {"gol", "juego", "equipo"} in top
    panel = news.topic_panel(fit, ["area"], ["t0", "t1"]).first()
    assert panel["t0"] + panel["t1"] == pytest.approx(1.0, abs=0.05)


def test_shares_count_every_text(spark):
    df = spark.createDataFrame([("A", "x"), ("A", None), ("B", "unlisted")], "area string, dim string")
    rows = ind.dimension_shares(df, "area", "dim", ["x", "OTHER"]).collect()
    assert {(r["area"], r["dimension"]): (r["count"], r["total_posts"]) for r in rows} == {
        ("A", "x"): (1, 2), ("A", "OTHER"): (1, 2), ("B", "x"): (0, 1), ("B", "OTHER"): (1, 1)
    }
