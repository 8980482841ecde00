"""Panel models and topics over the given tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from areapulse.catalog.panels import nation_panel
from areapulse.catalog.registry import ALL_STOP, query

from areapulse.operators import modelling, topics
from areapulse.operators.sizing import local_table
from areapulse.params import FOLDS, LASSO_ALPHA
from areapulse.plans import news
from areapulse.plans.nowcast import nowcast as nowcast_plan
from areapulse.session import cut_lineage
from areapulse.sources.tables import spread, spread_rows, table, text_table

FEATURES = ("l_quantity", "l_discount", "l_tax")
TARGET = "l_extendedprice"
_KEY = ("l_orderkey", "l_linenumber", "l_partkey")


def _lines(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "lineitem").select(*_KEY, *FEATURES, TARGET, "l_returnflag")


_STATS = ", ".join(f"avg({f}) AS m_{f}, stddev_pop({f}) AS s_{f}" for f in (*FEATURES, TARGET))


@query(
    f"WITH s AS (SELECT {_STATS} FROM lineitem) SELECT {', '.join(_KEY)}, "
    + ", ".join(f"round(({f} - m_{f}) / s_{f}, 6) AS {f}" for f in FEATURES)
    + " FROM lineitem, s"
)
def standardize(spark: SparkSession, sf: str) -> DataFrame:
    lines = _lines(spark, sf)
    scaled = modelling.standardize(lines, lines, FEATURES)
    return scaled.select(*_KEY, *[F.round(f, 6).alias(f) for f in FEATURES])


@query(
    """
    SELECT CASE WHEN year(o_orderdate) = 1997 THEN 'both' WHEN year(o_orderdate) < 1997 THEN 'train' ELSE 'test' END AS split,
           CAST(year(o_orderdate) AS INTEGER) AS year, count(*) AS n_orders
    FROM orders WHERE year(o_orderdate) IN (1995, 1996, 1997, 1998) GROUP BY 1, 2
    """
)
def train_test_protocol(spark: SparkSession, sf: str) -> DataFrame:
    years = table(spark, sf, "orders").select(F.year("o_orderdate").alias("year"))
    split = modelling.train_test_protocol(years, "year", (1995, 1996, 1997), (1997, 1998))
    return split.groupBy("split", "year").agg(F.count(F.lit(1)).alias("n_orders"))


CUSTOMER_FEATURES = ("balance", "orders_n", "price_mean", "price_max", "urgent_share", "open_share", "span_days")
SPEND = "spend"


def customer_panel(spark: SparkSession, sf: str) -> DataFrame:
    """One row per customer: order features and the spend in thousands. Orders are reduced before the join."""
    orders = table(spark, sf, "orders").groupBy(F.col("o_custkey").alias("c_custkey")).agg(
        F.count(F.lit(1)).cast("double").alias("orders_n"),
        F.avg("o_totalprice").alias("price_mean"),
        F.max("o_totalprice").alias("price_max"),
        F.avg((F.col("o_orderpriority") == "1-URGENT").cast("int")).alias("urgent_share"),
        F.avg((F.col("o_orderstatus") == "O").cast("int")).alias("open_share"),
        F.date_diff(F.max("o_orderdate"), F.min("o_orderdate")).cast("double").alias("span_days"),
        (F.sum("o_totalprice") / 1000.0).alias(SPEND),
    )
    return orders.join(table(spark, sf, "customer").select("c_custkey", F.col("c_acctbal").alias("balance")), "c_custkey")


def _training(spark: SparkSession, sf: str) -> DataFrame:
    """Customer panel, scaled and with folds, written once for the learners that read it many times."""
    panel = cut_lineage(customer_panel(spark, sf), "customer-panel")
    scaled = modelling.standardize(panel, panel, CUSTOMER_FEATURES)
    return spread_rows(cut_lineage(modelling.fold_assign(scaled, "c_custkey", FOLDS), "customer-training"), "c_custkey")


@query()
def lasso_select(spark: SparkSession, sf: str) -> DataFrame:
    panel = cut_lineage(customer_panel(spark, sf), "customer-panel")
    scaled = modelling.standardize(panel, panel, CUSTOMER_FEATURES)
    model = modelling.lasso_paths(scaled, CUSTOMER_FEATURES, [SPEND])[SPEND].at(LASSO_ALPHA)
    rows = [(SPEND, f, round(w, 4), w != 0.0) for f, w in zip(CUSTOMER_FEATURES, model.weights)]
    return local_table(spark, rows, "target string, feature string, weight double, selected boolean")


@query(
    """
    WITH s AS (SELECT avg(l_quantity) AS m, stddev_pop(l_quantity) AS s FROM lineitem),
         c AS (SELECT covar_pop((l_quantity - m) / s, l_extendedprice) AS c, avg(l_extendedprice) AS y FROM lineitem, s)
    SELECT alpha, round(sign(c) * greatest(abs(c) - alpha, 0), 3) AS weight, round(y, 3) AS intercept
    FROM c, (SELECT unnest([1.0, 5000.0, 1000000.0])::DOUBLE AS alpha)
    """
)
def lasso_single_feature(spark: SparkSession, sf: str) -> DataFrame:
    """One standardised feature: LASSO is the soft-thresholded covariance."""
    lines = _lines(spark, sf)
    scaled = modelling.standardize(lines, lines, ["l_quantity"]).select("l_quantity", TARGET)
    rows = []
    for alpha in (1.0, 5000.0, 1_000_000.0):
        model = modelling.lasso_fit(scaled, ["l_quantity"], TARGET, alpha)
        rows.append((alpha, float(model.coefficients[0]), float(model.intercept)))
    found = local_table(spark, rows, "alpha double, weight double, intercept double")
    return found.select("alpha", F.round("weight", 3).alias("weight"), F.round("intercept", 3).alias("intercept"))


@query(
    """
    WITH m AS (SELECT corr(l_quantity, l_tax) AS r, covar_pop(l_quantity, l_extendedprice) / stddev_pop(l_quantity) AS q,
                      covar_pop(l_tax, l_extendedprice) / stddev_pop(l_tax) AS t FROM lineitem),
         o AS (SELECT r, CASE WHEN abs(q) >= abs(t) THEN 'l_quantity' ELSE 'l_tax' END AS f1,
                      CASE WHEN abs(q) >= abs(t) THEN 'l_tax' ELSE 'l_quantity' END AS f2,
                      CASE WHEN abs(q) >= abs(t) THEN q ELSE t END AS c1, CASE WHEN abs(q) >= abs(t) THEN t ELSE q END AS c2 FROM m),
         k AS (SELECT *, greatest((c2 - r * c1) / (1 - r * sign(c1)), (r * c1 - c2) / (1 + r * sign(c1))) AS a FROM o),
         p AS (SELECT 0 AS knot, abs(c1) AS alpha, f1, f2, 0.0::DOUBLE AS w1, 0.0::DOUBLE AS w2 FROM k
               UNION ALL SELECT 1, a, f1, f2, c1 - sign(c1) * a, 0.0 FROM k
               UNION ALL SELECT 2, 0.0, f1, f2, (c1 - r * c2) / (1 - r * r), (c2 - r * c1) / (1 - r * r) FROM k)
    SELECT knot, round(alpha, 3) AS alpha, f1 AS feature, round(w1, 3) AS weight FROM p
    UNION ALL SELECT knot, round(alpha, 3), f2, round(w2, 3) FROM p
    """
)
def lasso_path(spark: SparkSession, sf: str) -> DataFrame:
    """All penalties of two standardised features: the second joins where its correlation with the residual meets the first's."""
    lines = table(spark, sf, "lineitem").select("l_quantity", "l_tax", TARGET)
    names = ["l_quantity", "l_tax"]
    path = modelling.lasso_paths(modelling.standardize(lines, lines, names).select(*names, TARGET), names, [TARGET])[TARGET]
    rows = [
        (k, float(a), f, float(w[i])) for k, (a, w) in enumerate(zip(path.alphas, path.weights)) for i, f in enumerate(path.features)
    ]
    found = local_table(spark, rows, "knot int, alpha double, feature string, weight double")
    return found.select("knot", F.round("alpha", 3).alias("alpha"), "feature", F.round("weight", 3).alias("weight"))


@query(
    """
    SELECT 'l_quantity' AS feature, round(regr_slope(l_extendedprice, l_quantity) * stddev_pop(l_quantity), 3) AS weight,
           round(avg(l_extendedprice), 3) AS intercept, round(regr_r2(l_extendedprice, l_quantity), 6) AS r2,
           round(sqrt(var_pop(l_extendedprice) * (1 - regr_r2(l_extendedprice, l_quantity))), 3) AS rmse
    FROM lineitem
    """
)
def ols_fit(spark: SparkSession, sf: str) -> DataFrame:
    model = modelling.ols_fit(_lines(spark, sf), ["l_quantity"], TARGET)
    rows = [("l_quantity", round(model.weights[0], 3), round(model.intercept, 3), round(model.extra["r2"], 6), round(model.extra["rmse"], 3))]
    return local_table(spark, rows, "feature string, weight double, intercept double, r2 double, rmse double")


@query(
    """
    SELECT 'price' AS dimension, 'l_quantity' AS feature, round(regr_slope(l_extendedprice, l_quantity) * stddev_pop(l_quantity), 3) AS weight,
           'linear_regression' AS method, round(avg(l_extendedprice), 3) AS intercept, round(avg(l_quantity), 6) AS scaler_mean,
           round(stddev_pop(l_quantity), 6) AS scaler_scale FROM lineitem
    UNION ALL
    SELECT 'quantity', 'l_extendedprice', round(regr_slope(l_quantity, l_extendedprice) * stddev_pop(l_extendedprice), 3),
           'linear_regression', round(avg(l_quantity), 3), round(avg(l_extendedprice), 6), round(stddev_pop(l_extendedprice), 6) FROM lineitem
    """
)
def model_tables(spark: SparkSession, sf: str) -> DataFrame:
    lines = _lines(spark, sf)
    models = {
        "price": modelling.ols_fit(lines, ["l_quantity"], TARGET),
        "quantity": modelling.ols_fit(lines, [TARGET], "l_quantity"),
    }
    tables = modelling.model_tables(spark, models)
    return tables.select(
        "dimension",
        "feature",
        F.round("weight", 3).alias("weight"),
        "method",
        F.round("intercept", 3).alias("intercept"),
        F.round("scaler_mean", 6).alias("scaler_mean"),
        F.round("scaler_scale", 6).alias("scaler_scale"),
    )


# Stored weights and scaling of two models.
WEIGHTS = [
    ("price", "l_quantity", 14000.0, "linear_regression", 38000.0, 25.5, 14.4),
    ("price", "l_discount", -120.0, "linear_regression", 38000.0, 0.05, 0.03),
    ("charge", "l_tax", 2.5, "linear_regression", 4.0, 0.04, 0.026),
    ("charge", "not_there", 9.0, "linear_regression", 4.0, 1.0, 1.0),
]


@query(
    f"""
    SELECT {', '.join(_KEY)}, 'price' AS dimension,
           round(38000.0 + (l_quantity - 25.5) / 14.4 * 14000.0 + (l_discount - 0.05) / 0.03 * -120.0, 4) AS prediction FROM lineitem
    UNION ALL SELECT {', '.join(_KEY)}, 'charge', round(4.0 + (l_tax - 0.04) / 0.026 * 2.5, 4) FROM lineitem
    """
)
def linear_score(spark: SparkSession, sf: str) -> DataFrame:
    schema = (
        "dimension string, feature string, weight double, method string, intercept double, scaler_mean double, scaler_scale double"
    )
    scores = modelling.linear_score(_lines(spark, sf), _KEY, local_table(spark, WEIGHTS, schema))
    return scores.withColumn("prediction", F.round("prediction", 4))


_C3 = "corr(l_quantity, l_extendedprice) AS c1, corr(l_discount, l_extendedprice) AS c2, corr(l_tax, l_extendedprice) AS c3"


@query(
    f"""
    WITH s AS (SELECT {_C3}, corr(l_quantity, l_discount) AS r12, corr(l_quantity, l_tax) AS r13, corr(l_discount, l_tax) AS r23,
                      stddev_samp(l_quantity) AS s1, stddev_samp(l_discount) AS s2, stddev_samp(l_tax) AS s3, stddev_samp(l_extendedprice) AS sy
               FROM lineitem),
         w AS (SELECT *, c1 / sqrt(c1 * c1 + c2 * c2 + c3 * c3) AS w1, c2 / sqrt(c1 * c1 + c2 * c2 + c3 * c3) AS w2,
                      c3 / sqrt(c1 * c1 + c2 * c2 + c3 * c3) AS w3 FROM s),
         q AS (SELECT *, (w1 * c1 + w2 * c2 + w3 * c3)
                 / (w1 * w1 + w2 * w2 + w3 * w3 + 2 * w1 * w2 * r12 + 2 * w1 * w3 * r13 + 2 * w2 * w3 * r23) AS q FROM w)
    SELECT 1 AS components, 'l_quantity' AS feature, round(w1 * q * sy / s1, 3) AS weight FROM q
    UNION ALL SELECT 1, 'l_discount', round(w2 * q * sy / s2, 3) FROM q
    UNION ALL SELECT 1, 'l_tax', round(w3 * q * sy / s3, 3) FROM q
    UNION ALL SELECT 2, 'l_quantity', round((c1 - r12 * c2) / (1 - r12 * r12) * sy / s1, 3) FROM s
    UNION ALL SELECT 2, 'l_discount', round((c2 - r12 * c1) / (1 - r12 * r12) * sy / s2, 3) FROM s
    """
)
def pls_regression(spark: SparkSession, sf: str) -> DataFrame:
    """One component on three features, and two components on two features, which equals least squares."""
    lines = _lines(spark, sf)
    one = modelling.pls_regression(lines, FEATURES, TARGET, 1)
    two = modelling.pls_regression(lines, FEATURES[:2], TARGET, 2)
    rows = [(k, f, round(w, 3)) for k, m in ((1, one), (2, two)) for f, w in zip(m.features, m.weights)]
    return local_table(spark, rows, "components int, feature string, weight double")


@query()
def pls_select_components(spark: SparkSession, sf: str) -> DataFrame:
    chosen = modelling.pls_select_components(_training(spark, sf), CUSTOMER_FEATURES, SPEND, "fold")
    return chosen.withColumn("mse", F.round("mse", 6))


@query()
def random_forest(spark: SparkSession, sf: str) -> DataFrame:
    model = modelling.random_forest(_training(spark, sf), CUSTOMER_FEATURES, SPEND)
    return modelling.importances(spark, model, CUSTOMER_FEATURES)


@query()
def grid_search(spark: SparkSession, sf: str) -> DataFrame:
    """All 27 grid points over contiguous folds of the nation panel."""
    panel = nation_panel(spark, sf).withColumn("row", F.col("year") * 1000 + F.col("nation"))
    features = ["quantity_mean", "discount_mean", "tax_mean", "balance_mean", "supplier_balance_mean"]
    folded = cut_lineage(modelling.fold_assign(panel, "row", FOLDS), "nation-training")
    search = modelling.grid_search(folded, features, "orders_mean", "fold")
    return modelling.grid_table(spark, search).withColumn("mse", F.round("mse", 4))


@query(
    """
    SELECT o_orderkey, CAST(ntile(5) OVER (ORDER BY o_orderkey) - 1 AS INTEGER) AS fold FROM orders
    """
)
def fold_assign(spark: SparkSession, sf: str) -> DataFrame:
    return modelling.fold_assign(table(spark, sf, "orders").select("o_orderkey"), "o_orderkey", FOLDS)


@query()
def stack_regressors(spark: SparkSession, sf: str) -> DataFrame:
    training = _training(spark, sf)
    scored = modelling.stack_regressors(training, CUSTOMER_FEATURES, SPEND, "fold").transform(training)
    return scored.select("c_custkey", *[F.round(c, 4).alias(c) for c in (SPEND, "rf", "pls", "stacked")])


@query()
def nowcast(spark: SparkSession, sf: str) -> DataFrame:
    """Out-of-sample run on the nation panel: fitted on 1996, scored on 1998."""
    panel = nation_panel(spark, sf).withColumn("row", F.col("year") * 1000 + F.col("nation"))
    panel = panel.withColumn("spend_target", F.col("orders_mean") / 1000.0).withColumn("size_target", F.col("orders_n").cast("double"))
    features = ["quantity_mean", "discount_mean", "tax_mean", "balance_mean", "suppliers_n", "supplier_balance_mean"]
    _, metrics, chosen = nowcast_plan(panel, "nation", "year", "row", features, ["spend_target", "size_target"], [1996], [1998])
    rounded = [F.round(c, 4).alias(c) for c in ("r2", "mae", "rmse")]
    return metrics.join(chosen, "target").select("target", "model", "n", *rounded, "n_selected_features")


def _predicted(spark: SparkSession, sf: str) -> DataFrame:
    """Three simple predictors of the price, long form."""
    lines = spread(_lines(spark, sf))
    cells = F.array(
        F.struct(F.lit("rf").alias("model"), (F.col("l_quantity") * 1500.0).alias("predicted")),
        F.struct(F.lit("pls").alias("model"), (F.col("l_quantity") * 1200.0 + 9000.0).alias("predicted")),
        F.struct(F.lit("stacked").alias("model"), (F.col("l_quantity") * 1490.0 + 300.0).alias("predicted")),
    )
    return lines.select(F.col("l_returnflag").alias("target"), F.col(TARGET).alias("actual"), F.inline(cells))


_PREDICTED = """
    p AS (SELECT l_returnflag AS target, l_extendedprice AS y, unnest(['rf', 'pls', 'stacked']) AS model,
                 unnest([l_quantity * 1500.0, l_quantity * 1200.0 + 9000.0, l_quantity * 1490.0 + 300.0]) AS x FROM lineitem),
    m AS (SELECT target, model, count(*) AS n, 1 - sum((y - x) * (y - x)) / (var_pop(y) * count(*)) AS r2, avg(abs(y - x)) AS mae,
                 sqrt(avg((y - x) * (y - x))) AS rmse, avg(CASE WHEN y <> 0 THEN abs((y - x) / y) * 100.0 END) AS pct, corr(y, x) AS pearson
          FROM p GROUP BY 1, 2)
"""


@query(
    f"""
    WITH {_PREDICTED},
         k AS (SELECT target, model, rank() OVER (PARTITION BY target, model ORDER BY y) + (count(*) OVER (PARTITION BY target, model, y) - 1) / 2.0 AS ry,
                      rank() OVER (PARTITION BY target, model ORDER BY x) + (count(*) OVER (PARTITION BY target, model, x) - 1) / 2.0 AS rx FROM p),
         s AS (SELECT target, model, corr(ry, rx) AS spearman FROM k GROUP BY 1, 2)
    SELECT target, model, n, round(r2, 6) AS r2, round(mae, 4) AS mae, round(rmse, 4) AS rmse, round(pct, 4) AS mean_pct_error,
           round(pearson, 6) AS pearson, round(spearman, 6) AS spearman FROM m JOIN s USING (target, model)
    """
)
def regression_metrics(spark: SparkSession, sf: str) -> DataFrame:
    rows = _predicted(spark, sf)
    keys = ["target", "model"]
    metrics = modelling.regression_metrics(rows, keys, "actual", "predicted")
    both = metrics.join(modelling.spearman(rows, keys, "actual", "predicted"), keys)
    places = {"r2": 6, "mae": 4, "rmse": 4, "mean_pct_error": 4, "pearson": 6, "spearman": 6}
    return both.select(*keys, "n", *[F.round(c, p).alias(c) for c, p in places.items()])


@query(
    f"""
    WITH {_PREDICTED}
    SELECT target, round(max(r2) FILTER (model = 'stacked'), 6) AS r2, round(max(mae) FILTER (model = 'stacked'), 4) AS mae,
           round(max(r2) FILTER (model = 'stacked') - max(r2) FILTER (model <> 'stacked'), 6) AS r2_gain,
           round(min(mae) FILTER (model <> 'stacked') - max(mae) FILTER (model = 'stacked'), 4) AS mae_gain
    FROM m GROUP BY 1
    """
)
def compare_models(spark: SparkSession, sf: str) -> DataFrame:
    metrics = modelling.regression_metrics(_predicted(spark, sf), ["target", "model"], "actual", "predicted")
    gains = modelling.compare_models(metrics, "target", "model", ["rf", "pls"], "stacked")
    places = {"r2": 6, "mae": 4, "r2_gain": 6, "mae_gain": 4}
    return gains.select("target", *[F.round(c, p).alias(c) for c, p in places.items()])


_PAIR = f"""
    c AS (SELECT {', '.join(_KEY)}, l_quantity AS a, l_quantity * 1000.0 + l_extendedprice AS b FROM lineitem),
    s AS (SELECT avg(a) AS ma, stddev_pop(a) AS sa, avg(b) AS mb, stddev_pop(b) AS sb FROM c),
    z AS (SELECT {', '.join(_KEY)}, ((a - ma) / sa + (b - mb) / sb) / sqrt(2) AS pc FROM c, s)
"""


def _pair(spark: SparkSession, sf: str) -> DataFrame:
    """Two positively correlated columns: their PC1 is the scaled sum."""
    return _lines(spark, sf).select(*_KEY, F.col("l_quantity").alias("a"), (F.col("l_quantity") * 1000.0 + F.col(TARGET)).alias("b"))


@query(
    f"""
    WITH {_PAIR} SELECT {', '.join(_KEY)}, round((pc - (SELECT min(pc) FROM z)) / (SELECT max(pc) - min(pc) FROM z) * 100.0, 5) AS latent_index FROM z
    """
)
def latent_index(spark: SparkSession, sf: str) -> DataFrame:
    scored = modelling.latent_index(_pair(spark, sf), ["a", "b"])
    return scored.select(*_KEY, F.round("latent_index", 5).alias("latent_index"))


@query(f"WITH {_PAIR} SELECT {', '.join(_KEY)}, round(pc + abs((SELECT min(pc) FROM z)) + 10, 5) AS score FROM z")
def shifted_component(spark: SparkSession, sf: str) -> DataFrame:
    lines = _pair(spark, sf)
    model = modelling.shifted_component(lines, ["a", "b"], 10.0)
    return lines.select(*_KEY, F.round(model.score(), 5).alias("score"))


def _topics(spark: SparkSession, sf: str) -> news.TopicFit:
    terms = news.article_tokens(text_table(spark, sf, "documents").select("doc_id", "source", "text"), "text", ALL_STOP)
    return news.fit_topics(terms, ["doc_id", "source"], min_df=0.001, max_df=0.6)


@query()
def lda_fit(spark: SparkSession, sf: str) -> DataFrame:
    panel = news.topic_panel(_topics(spark, sf), ["source"], [f"topic_{i}" for i in range(8)])
    return panel.select("source", *[F.round(f"topic_{i}", 4).alias(f"topic_{i}") for i in range(8)])


@query()
def topic_shares_by_year(spark: SparkSession, sf: str) -> DataFrame:
    # Every document is an article of one of the two years; one half comes live, the other from the archive.
    h = F.crc32(F.col("doc_id").cast("string").cast("binary"))
    year = F.when(h % 2 == 0, 2020).otherwise(2022)
    day = F.make_date(year, F.lit(1), F.lit(1)) + F.floor(h / 4).cast("int") % 365
    docs = text_table(spark, sf, "documents").select("doc_id", F.col("source").alias("area"), F.col("text").alias("content"), day.alias("day"), h.alias("h"))
    live = docs.where("h % 4 < 2").withColumn("published date", F.concat(F.date_format("day", "EEE, dd MMM yyyy HH:mm:ss"), F.lit(" GMT")))
    archive = docs.where("h % 4 >= 2").withColumn("publish_date", F.date_format("day", "yyyy-MM-dd"))
    fit = news.fit_yearly_topics(live.drop("day", "h"), archive.drop("day", "h"), (2020, 2022), ["area"], "content", ALL_STOP)
    panel = news.topic_panel(fit, ["area", "year"], [f"topic_{i}" for i in range(8)])
    return panel.select("area", "year", *[F.round(f"topic_{i}", 4).alias(f"topic_{i}") for i in range(8)])


@query()
def fitted_topic_report(spark: SparkSession, sf: str) -> DataFrame:
    report = news.topic_report(_topics(spark, sf), "doc_id")
    places = {"percentage": 6, "probability": 4}
    return report.select("topic", "keywords", "count", "exemplar", *[F.round(c, p).alias(c) for c, p in places.items()])


@query()
def topic_top_terms(spark: SparkSession, sf: str) -> DataFrame:
    fit = _topics(spark, sf)
    return topics.topic_top_terms(fit.model, fit.vocabulary, 50)


