"""Unions, pivots, panel joins and report tables over the given tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from areapulse.catalog.indicators import PRIORITIES
from areapulse.catalog.registry import query
from areapulse.operators import reshape
from areapulse.params import OFFICIAL_TO_PREDICTED, RED_GREEN
from areapulse.session import cut_lineage
from areapulse.sources import tables
from areapulse.sources.tables import table


@query(
    """
    SELECT 'documents' AS source_name, lang, count(*) AS n_rows, count(doc_id) AS n_doc, CAST(0 AS BIGINT) AS n_url FROM documents GROUP BY lang
    UNION ALL SELECT 'pages', NULL, count(*), 0, count(url) FROM pages
    """
)
def union_align(spark: SparkSession, sf: str) -> DataFrame:
    docs = table(spark, sf, "documents").select("doc_id", "lang")
    both = reshape.union_align({"documents": docs, "pages": table(spark, sf, "pages").select("page_id", "url")})
    return both.groupBy("source_name", "lang").agg(
        F.count(F.lit(1)).alias("n_rows"), F.count("doc_id").alias("n_doc"), F.count("url").alias("n_url")
    )


@query(
    """
    SELECT o_orderkey, CASE WHEN o_orderstatus = 'P' THEN NULL
             WHEN o_orderstatus = 'F' THEN strftime(date_trunc('day', o_orderdate) + INTERVAL 8 HOUR, '%Y-%m-%d %H:%M:%S')
             ELSE strftime(o_orderdate + INTERVAL 3723 SECOND, '%Y-%m-%d %H:%M:%S') END AS ts
    FROM orders
    """
)
def parse_dates(spark: SparkSession, sf: str) -> DataFrame:
    # F orders carry ISO dates, O orders RFC-822 strings, P orders text that is no date.
    stamp = F.col("o_orderdate") + F.expr("interval 3723 seconds")
    raw = table(spark, sf, "orders").select(
        "o_orderkey",
        F.when(F.col("o_orderstatus") == "P", F.concat(F.lit("pending "), "o_orderpriority"))
        .when(F.col("o_orderstatus") == "F", F.date_format("o_orderdate", "yyyy-MM-dd"))
        .otherwise(F.concat(F.date_format(stamp, "EEE"), F.lit(", "), F.date_format(stamp, "dd MMM yyyy HH:mm:ss"), F.lit(" GMT")))
        .alias("raw"),
    )
    parsed = F.coalesce(reshape.parse_rfc822(F.col("raw")), reshape.parse_iso_at_eight(F.col("raw")))
    return raw.select("o_orderkey", F.date_format(parsed, "yyyy-MM-dd HH:mm:ss").alias("ts"))


@query(
    """
    SELECT CAST(year(o_orderdate) AS INTEGER) AS year, o_orderstatus AS status, count(*) AS n_orders
    FROM orders WHERE year(o_orderdate) IN (1996, 1998) GROUP BY 1, 2
    """
)
def period_filter(spark: SparkSession, sf: str) -> DataFrame:
    kept = reshape.period_filter(table(spark, sf, "orders").select("o_orderdate", F.col("o_orderstatus").alias("status")), "o_orderdate", [1996, 1998])
    return kept.groupBy("year", "status").agg(F.count(F.lit(1)).alias("n_orders"))


@query(
    """
    SELECT event_id, strftime(date_trunc('second', ts), '%Y-%m-%d %H:%M:%S') AS posted_at FROM events
    WHERE date_trunc('second', ts) >= TIMESTAMP '2024-01-05' AND date_trunc('second', ts) < TIMESTAMP '2024-01-20'
    """
)
def epoch_filter(spark: SparkSession, sf: str) -> DataFrame:
    epochs = table(spark, sf, "events").select("event_id", F.unix_timestamp(F.col("ts").cast("timestamp")).alias("epoch"))
    kept = tables.epoch_filter(epochs, "epoch", "2024-01-05", "2024-01-20")
    return kept.select("event_id", F.date_format("posted_at", "yyyy-MM-dd HH:mm:ss").alias("posted_at"))


def _slug(priority: str) -> str:
    return priority.lower().replace(" ", "_")


_PIVOT = ", ".join(
    f"""count(*) FILTER (o_orderpriority = '{p}') AS "{_slug(p)}_n", """
    f"""round(sum(o_totalprice) FILTER (o_orderpriority = '{p}'), 2) / count(*) FILTER (o_orderpriority = '{p}') AS "{_slug(p)}_mean" """
    for p in PRIORITIES
)


@query(f"SELECT c_nationkey, {_PIVOT} FROM orders JOIN customer ON o_custkey = c_custkey GROUP BY 1")
def pivot_metrics(spark: SparkSession, sf: str) -> DataFrame:
    # Priorities per customer first: the join then moves five rows per customer instead of all orders.
    per_customer = (
        table(spark, sf, "orders")
        .groupBy(F.col("o_custkey").alias("c_custkey"), "o_orderpriority")
        .agg(F.count(F.lit(1)).alias("n"), F.sum("o_totalprice").alias("total"))
    )
    joined = per_customer.join(table(spark, sf, "customer").select("c_custkey", "c_nationkey"), "c_custkey")
    metrics = {"n": F.coalesce(F.sum("n"), F.lit(0)), "mean": F.round(F.sum("total"), 2) / F.sum("n")}
    wide = reshape.pivot_metrics(joined, ["c_nationkey"], "o_orderpriority", metrics, PRIORITIES)
    return wide.fillna(0, subset=[f"{_slug(p)}_n" for p in PRIORITIES])


@query(
    "SELECT label, "
    + ", ".join(f"round(avg(embedding[{i + 1}]::DOUBLE), 6) AS topic_{i}" for i in range(64))
    + " FROM embeddings GROUP BY 1"
)
def topic_wide(spark: SparkSession, sf: str) -> DataFrame:
    first = table(spark, sf, "embeddings").select("label", F.posexplode("embedding").alias("topic", "x"))
    means = first.groupBy("label", "topic").agg(F.round(F.avg(F.col("x").cast("double")), 6).alias("share"))
    return reshape.topic_wide(means, ["label"], "topic", "share", [f"topic_{i}" for i in range(64)])


@query("SELECT c_custkey AS id, c_name AS area_name, c_acctbal AS account_balance FROM customer")
def project_rename(spark: SparkSession, sf: str) -> DataFrame:
    raw = table(spark, sf, "customer").withColumnsRenamed({"c_name": " area name ", "c_acctbal": "account balance"})
    return reshape.project_rename(raw, ["c_nationkey", "c_mktsegment"], {"c_custkey": "id"})


@query("SELECT l_orderkey, l_linenumber, l_partkey, round((l_discount + l_tax) / 2.0, 6) AS charge FROM lineitem")
def derive_mean_column(spark: SparkSession, sf: str) -> DataFrame:
    lines = table(spark, sf, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", "l_discount", "l_tax")
    return reshape.derive_mean_column(lines, "l_discount", "l_tax", "charge").withColumn("charge", F.round("charge", 6))


PANEL_YEARS = (1996, 1998)


def nation_panel(spark: SparkSession, sf: str, years: tuple[int, ...] = PANEL_YEARS) -> DataFrame:
    """One row per nation and year from five sources: orders, lines, customers, suppliers and the nation itself.

    Orders and lines are reduced to one row per customer or order before they meet the dimension tables.
    """
    customer = table(spark, sf, "customer")
    supplier = table(spark, sf, "supplier")
    orders = reshape.period_filter(table(spark, sf, "orders"), "o_orderdate", years)
    lines = reshape.period_filter(table(spark, sf, "lineitem"), "l_shipdate", years)
    owners = customer.select(F.col("c_custkey").alias("o_custkey"), F.col("c_nationkey").alias("nation"))
    makers = supplier.select(F.col("s_suppkey").alias("l_suppkey"), F.col("s_nationkey").alias("nation"))
    per_owner = orders.groupBy("o_custkey", "year").agg(F.count(F.lit(1)).alias("n"), F.sum("o_totalprice").alias("total"))
    spend = per_owner.join(owners, "o_custkey").groupBy("nation", "year").agg(
        F.sum("n").alias("orders_n"), (F.sum("total") / F.sum("n")).alias("orders_mean")
    )
    per_maker = lines.groupBy("l_suppkey", "year").agg(
        F.count(F.lit(1)).alias("n"), F.sum("l_quantity").alias("q"), F.sum("l_discount").alias("d"), F.sum("l_tax").alias("t")
    )
    shipped = per_maker.join(makers, "l_suppkey").groupBy("nation", "year").agg(
        (F.sum("q") / F.sum("n")).alias("quantity_mean"),
        (F.sum("d") / F.sum("n")).alias("discount_mean"),
        (F.sum("t") / F.sum("n")).alias("tax_mean"),
    )
    balances = customer.groupBy(F.col("c_nationkey").alias("nation")).agg(F.avg("c_acctbal").alias("balance_mean"))
    makers_n = supplier.groupBy(F.col("s_nationkey").alias("nation")).agg(
        F.count(F.lit(1)).alias("suppliers_n"), F.avg("s_acctbal").alias("supplier_balance_mean")
    )
    names = table(spark, sf, "nation").select(F.col("n_nationkey").alias("nation"), "n_regionkey")
    # A few rows per nation and year, read once per period below: written, so that the tables are scanned once.
    spend, shipped = cut_lineage(spend, "spend"), cut_lineage(shipped, "shipped")
    periods = {
        y: [names, *(s.where(F.col("year") == y).drop("year") for s in (spend, shipped)), balances, makers_n] for y in years
    }
    return reshape.assemble_panel(periods, "nation")


_PANEL = f"""
    o AS (SELECT c_nationkey AS nation, CAST(year(o_orderdate) AS INTEGER) AS year, count(*) AS orders_n, avg(o_totalprice) AS orders_mean
          FROM orders JOIN customer ON o_custkey = c_custkey WHERE year(o_orderdate) IN {PANEL_YEARS} GROUP BY 1, 2),
    l AS (SELECT s_nationkey AS nation, CAST(year(l_shipdate) AS INTEGER) AS year, avg(l_quantity) AS quantity_mean,
                 avg(l_discount) AS discount_mean, avg(l_tax) AS tax_mean
          FROM lineitem JOIN supplier ON l_suppkey = s_suppkey WHERE year(l_shipdate) IN {PANEL_YEARS} GROUP BY 1, 2),
    b AS (SELECT c_nationkey AS nation, avg(c_acctbal) AS balance_mean FROM customer GROUP BY 1),
    s AS (SELECT s_nationkey AS nation, count(*) AS suppliers_n, avg(s_acctbal) AS supplier_balance_mean FROM supplier GROUP BY 1),
    panel AS (SELECT nation, n_regionkey, o.year, orders_n, orders_mean, quantity_mean, discount_mean, tax_mean, balance_mean,
                     suppliers_n, supplier_balance_mean
              FROM nation JOIN o ON n_nationkey = o.nation JOIN l USING (nation, year) JOIN b USING (nation) JOIN s USING (nation))
"""
_MEANS = ("orders_mean", "quantity_mean", "discount_mean", "tax_mean", "balance_mean", "supplier_balance_mean")


@query(
    f"WITH {_PANEL} SELECT nation, n_regionkey, year, orders_n, suppliers_n, "
    + ", ".join(f"round({m}, 4) AS {m}" for m in _MEANS)
    + ", count(*) OVER (PARTITION BY year) AS period_rows FROM panel"
)
def assemble_panel(spark: SparkSession, sf: str) -> DataFrame:
    panel = nation_panel(spark, sf)
    counted = panel.join(reshape.panel_rows(panel).withColumnRenamed("rows", "period_rows"), "year")
    return counted.select(
        "nation", "n_regionkey", "year", "orders_n", "suppliers_n", *[F.round(m, 4).alias(m) for m in _MEANS], "period_rows"
    )


EVENT_TYPES = ("click", "error", "purchase", "signup", "view")


@query(
    """
    WITH h AS (SELECT date_trunc('hour', ts) AS hour, event_type, avg(value) AS v FROM events GROUP BY 1, 2)
    SELECT strftime(hour, '%Y-%m-%d %H') AS hour, """
    + ", ".join(f"round(max(v) FILTER (event_type = '{e}'), 6) AS {e}" for e in EVENT_TYPES)
    + " FROM h GROUP BY hour"
)
def outer_join_series(spark: SparkSession, sf: str) -> DataFrame:
    hourly = (
        table(spark, sf, "events")
        .groupBy(F.date_trunc("hour", "ts").alias("hour"), "event_type")
        .agg(F.avg("value").alias("v"))
    )
    # One row per hour and type, read once per series.
    hourly = cut_lineage(hourly, "hourly")
    series = {e: hourly.where(F.col("event_type") == e) for e in EVENT_TYPES}
    wide = reshape.outer_join_series(series, "hour", "v")
    return wide.select(F.date_format("hour", "yyyy-MM-dd HH").alias("hour"), *[F.round(e, 6).alias(e) for e in EVENT_TYPES])


@query(
    " UNION ALL ".join(
        f"SELECT '{c}' AS feature, count({c}) AS n, round(sum({c}), 2) AS total FROM lineitem" for c in ("l_quantity", "l_discount", "l_tax")
    )
)
def select_features(spark: SparkSession, sf: str) -> DataFrame:
    lines = table(spark, sf, "lineitem")
    keys = ("l_orderkey", "l_partkey", "l_suppkey", "l_linenumber", "l_extendedprice")
    features = reshape.select_features(lines, exclude=keys, prefix="l_")
    long = reshape.long_features(lines, [], features)
    return long.groupBy("feature").agg(F.count("value").alias("n"), F.round(F.sum("value"), 2).alias("total"))


@query(
    """
    WITH j AS (SELECT d.doc_id, source, n_chars, quality, toxic FROM documents d LEFT JOIN labels USING (doc_id)),
         f AS (SELECT doc_id, source, 'drop' AS how, quality, toxic FROM j WHERE quality IS NOT NULL AND toxic IS NOT NULL
               UNION ALL SELECT doc_id, source, 'fill', coalesce(quality, 0), coalesce(toxic, 0) FROM j)
    SELECT doc_id, source, how, quality, toxic FROM f
    QUALIFY how = 'fill' OR count(*) OVER (PARTITION BY how, source) >= 10
    """
)
def null_handling(spark: SparkSession, sf: str) -> DataFrame:
    joined = table(spark, sf, "documents").select("doc_id", "source").join(table(spark, sf, "labels"), "doc_id", "left")
    dropped = reshape.null_handling(joined, ["quality", "toxic"], "drop", "source", 10)
    filled = reshape.null_handling(joined, ["quality", "toxic"], "fill")
    tagged = [d.select("doc_id", "source", F.lit(h).alias("how"), "quality", "toxic") for d, h in ((dropped, "drop"), (filled, "fill"))]
    return tagged[0].unionByName(tagged[1])


def _properties(spark: SparkSession, sf: str) -> DataFrame:
    """Nation figures as open property maps: official values, some predicted ones, and entries that are no values."""
    totals = (
        table(spark, sf, "customer")
        .groupBy("c_nationkey")
        .agg(F.count(F.lit(1)).alias("n"), (F.round(F.sum("c_acctbal"), 2) / F.count(F.lit(1))).alias("mean"), F.round(F.max("c_acctbal"), 2).alias("top"))
    )
    named = totals.join(table(spark, sf, "nation"), F.col("c_nationkey") == F.col("n_nationkey"))
    entries = {
        "state_name": F.col("n_name"),
        "region": F.col("n_regionkey").cast("string"),
        "value_income": F.col("n").cast("string"),
        "value_income_predicted": (F.col("n") + 1).cast("string"),
        "value_housing1": F.col("mean").cast("string"),
        "value_housing2": F.col("top").cast("string"),
        "value_housing_predicted": F.when(F.col("n_regionkey") != 2, F.col("mean").cast("string")),
        "value_access to food": F.col("n_regionkey").cast("string"),
        "value_note": F.lit("none"),
    }
    return named.select(F.create_map(*[c for k, v in entries.items() for c in (F.lit(k), v)]).alias("properties"))


_VALUES = """
    t AS (SELECT n_name AS area, n_regionkey AS r, count(*) AS n, round(sum(c_acctbal), 2) / count(*) AS mean, round(max(c_acctbal), 2) AS top
          FROM customer JOIN nation ON c_nationkey = n_nationkey GROUP BY 1, 2),
    v AS (SELECT area, 'value_income' AS parameter, n::DOUBLE AS value FROM t UNION ALL SELECT area, 'value_income_predicted', n + 1 FROM t
          UNION ALL SELECT area, 'value_housing1', mean FROM t UNION ALL SELECT area, 'value_housing2', top FROM t
          UNION ALL SELECT area, 'value_housing_predicted', mean FROM t WHERE r <> 2
          UNION ALL SELECT area, 'value_access to food', r FROM t)
"""


def _values(spark: SparkSession, sf: str) -> DataFrame:
    return reshape.unpivot_properties(_properties(spark, sf), "state_name", "properties")


@query(f"WITH {_VALUES} SELECT area, parameter, value FROM v")
def unpivot_properties(spark: SparkSession, sf: str) -> DataFrame:
    return _values(spark, sf)


@query(
    f"""
    WITH {_VALUES}, m(parameter, predicted_parameter) AS (VALUES {', '.join(f"('{a}', '{b}')" for a, b in OFFICIAL_TO_PREDICTED.items())})
    SELECT o.area, o.parameter, o.value, m.predicted_parameter, p.value AS predicted_value
    FROM v o LEFT JOIN m USING (parameter) LEFT JOIN v p ON p.area = o.area AND p.parameter = m.predicted_parameter
    WHERE NOT ends_with(o.parameter, '_predicted')
    """
)
def pair_official_predicted(spark: SparkSession, sf: str) -> DataFrame:
    paired = reshape.pair_official_predicted(_values(spark, sf), OFFICIAL_TO_PREDICTED)
    return paired.select("area", "parameter", "value", "predicted_parameter", "predicted_value")


def _sql_channel(which: int, palette: dict[str, tuple]) -> str:
    a, b = palette[0][which], palette[1][which]
    return f"lpad(format('{{:x}}', CAST(floor({a} + ({b} - {a}) * ratio) AS BIGINT)), 2, '0')"


def _sql_colour(palette: tuple) -> str:
    return "'#' || " + " || ".join(_sql_channel(c, palette) for c in range(3))


_HOUSING, _FOOD, _INCOME = ((221, 160, 221), (75, 0, 130)), ((255, 218, 185), (255, 69, 0)), ((255, 255, 224), (184, 134, 11))


@query(
    f"""
    WITH {_VALUES}, r AS (SELECT DISTINCT parameter, value, dense_rank() OVER (PARTITION BY parameter ORDER BY value) AS k FROM v),
         q AS (SELECT *, max(k) OVER (PARTITION BY parameter) AS top FROM r),
         c AS (SELECT *, CASE WHEN top > 1 THEN (k - 1) / (top - 1)::DOUBLE ELSE 0.0::DOUBLE END AS ratio FROM q)
    SELECT parameter, value, CASE WHEN parameter LIKE '%housing%' THEN {_sql_colour(_HOUSING)}
           WHEN parameter LIKE '%food%' THEN {_sql_colour(_FOOD)} ELSE {_sql_colour(_INCOME)} END AS color,
           {_sql_colour(RED_GREEN)} AS red_green
    FROM c
    """
)
def color_classes(spark: SparkSession, sf: str) -> DataFrame:
    return reshape.color_classes(_values(spark, sf), {"color": None, "red_green": RED_GREEN})


@query(
    f"""
    WITH {_VALUES} SELECT parameter, count(*) AS n_values, count(DISTINCT value) AS n_distinct, min(value) AS min_value, max(value) AS max_value
    FROM v GROUP BY 1
    """
)
def parameter_summary(spark: SparkSession, sf: str) -> DataFrame:
    return reshape.parameter_summary(_values(spark, sf))


RESULT_DIMENSIONS = ("quantity", "discount")


@query(
    f"""
    WITH {_PANEL}, p AS (SELECT nation, max(quantity_mean) FILTER (year = 1998) AS qa, max(quantity_mean) FILTER (year = 1996) AS qp,
                                max(discount_mean) FILTER (year = 1998) AS da, max(discount_mean) FILTER (year = 1996) AS dp FROM panel GROUP BY 1)
    SELECT nation, round(qa, 6) AS quantity_actual, round(qp, 6) AS quantity_predicted, round(da, 6) AS discount_actual,
           round(dp, 6) AS discount_predicted FROM p
    """
)
def results_wide(spark: SparkSession, sf: str) -> DataFrame:
    """The later year as the actual value, the earlier one as its naive prediction."""
    panel = nation_panel(spark, sf)
    later = panel.where("year = 1998").select("nation", *[F.col(f"{d}_mean").alias(f"a_{d}") for d in RESULT_DIMENSIONS])
    earlier = panel.where("year = 1996").select("nation", *[F.col(f"{d}_mean").alias(f"p_{d}") for d in RESULT_DIMENSIONS])
    cells = F.array(
        *[F.struct(F.lit(d).alias("dimension"), F.col(f"a_{d}").alias("actual"), F.col(f"p_{d}").alias("predicted")) for d in RESULT_DIMENSIONS]
    )
    long = later.join(earlier, "nation").select("nation", F.inline(cells))
    wide = reshape.results_wide(long, "nation", "dimension", "actual", "predicted", RESULT_DIMENSIONS)
    return wide.select("nation", *[F.round(c, 6).alias(c) for c in wide.columns if c != "nation"])


