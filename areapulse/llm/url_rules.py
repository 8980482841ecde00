"""URL filtering by association rules.

A URL is a set of tokens: the labels of its host, the parts of its path, the keys of its query. Spark's FP-growth mines
the token combinations of labelled pages together with their label; rules that imply the bad label with enough support
and confidence, and that no shorter rule makes needless, stay. They are matched by an inverted index from token to rule:
a rule fires when all of its tokens are met. Listed rules of a host and a path go first; the longest that fits decides.

Defined cases: a null url or one without ``://`` has an empty host and path, no token, and is allowed unless a listed rule
fits; labels without a page, and null labels, teach nothing; repeated labels of a page count as bad if any is; repeated
pages give repeated rows; without labelled pages no rule is mined. Only the id and the url are read, so other columns may
have any name.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.ml.fpm import FPGrowth
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from areapulse.session import cut_lineage

BAD = "=bad"


@dataclass(frozen=True)
class ListedRule:
    """A verdict for a host, its subdomains, and paths that start with ``path``."""

    verdict: str
    host: str
    path: str


LISTED = (
    ListedRule("allow", "com", "/"),
    ListedRule("block", "example.com", "/en/"),
    ListedRule("allow", "www.example.com", "/en/"),
    ListedRule("block", "net", "/es/"),
    ListedRule("block", "net", "/fr/"),
)


def host_of(url: Column) -> Column:
    """After the first ``://`` up to ``/``, ``?``, ``#`` or the end; A-Z lower-cased."""
    host = F.coalesce(F.regexp_extract(url, r"(?s)^.*?://([^/?#]*)", 1), F.lit(""))
    return F.translate(host, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def path_of(url: Column) -> Column:
    """After the host up to ``?``, ``#`` or the end."""
    return F.coalesce(F.regexp_extract(url, r"(?s)^.*?://[^/?#]*([^?#]*)", 1), F.lit(""))


def url_tokens(url: Column, host: Column, path: Column) -> Column:
    """Distinct tokens. Numbers in a path are ids and stay out; an empty part is no token."""
    labels = F.transform(F.filter(F.split(host, r"\."), lambda x: x != ""), lambda x: F.concat(F.lit("host:"), x))
    parts = F.filter(F.split(path, "/"), lambda x: (x != "") & ~x.rlike("^[0-9]"))
    parts = F.transform(parts, lambda x: F.concat(F.lit("path:"), x))
    query = F.coalesce(F.regexp_extract(url, r"(?s)\?([^#]*)", 1), F.lit(""))
    keys = F.transform(F.filter(F.split(query, "&"), lambda x: x != ""), lambda x: F.concat(F.lit("key:"), F.split(x, "=", 2)[0]))
    return F.array_distinct(F.concat(labels, parts, keys))


def listed_rule(host: Column, path: Column, rules: Sequence[ListedRule] = LISTED) -> Column:
    """(rule, verdict) of the longest listed rule that fits, else null."""
    out = F.lit(None).cast("struct<rule:string,verdict:string>")
    for r in sorted(rules, key=lambda r: len(r.host + r.path)):
        fits = ((host == r.host) | F.endswith(host, F.lit("." + r.host))) & F.startswith(path, F.lit(r.path))
        out = F.when(fits, F.struct(F.lit(r.host + r.path).alias("rule"), F.lit(r.verdict).alias("verdict"))).otherwise(out)
    return out


def mine_rules(labelled: DataFrame, min_count: int = 20, min_support: float = 0.001, min_confidence: float = 0.6) -> DataFrame:
    """(antecedent, n, confidence) of the rules that imply a bad page, from (tokens, bad).

    A combination must be met ``min_count`` times and in a share ``min_support`` of the pages. A rule is needless if a
    rule on some of its tokens is as confident.
    """
    spark = labelled.sparkSession
    pages = labelled.select(F.concat("tokens", F.when(F.col("bad"), F.array(F.lit(BAD))).otherwise(F.array().cast("array<string>"))).alias("items"))
    pages = cut_lineage(pages.where(F.size("items") > 0), "url-items")
    n = pages.count()
    if not n:
        return spark.range(0).select(*[F.lit(None).cast(t).alias(c) for c, t in (("antecedent", "array<string>"), ("n", "int"), ("confidence", "double"))])
    model = FPGrowth(itemsCol="items", minSupport=min(1.0, max(min_support, min_count / n)), minConfidence=min_confidence).fit(pages)
    rules = model.associationRules.where(F.col("consequent") == F.array(F.lit(BAD)))
    rules = cut_lineage(rules.select(F.array_sort("antecedent").alias("antecedent"), F.size("antecedent").alias("n"), "confidence"), "url-rules")
    # A shorter rule meets the longer ones that hold its first token.
    short = rules.select(F.col("antecedent").alias("less"), F.col("n").alias("m"), F.col("confidence").alias("c"), F.col("antecedent")[0].alias("t"))
    long = rules.select("antecedent", "n", "confidence", F.explode("antecedent").alias("t"))
    covered = long.join(short, "t").where((F.col("m") < F.col("n")) & (F.col("c") >= F.col("confidence")) & (F.size(F.array_except("less", "antecedent")) == 0))
    out = rules.join(covered.select("antecedent").distinct(), "antecedent", "left_anti")
    return out.select("antecedent", "n", "confidence")


def judge_urls(
    pages: DataFrame,
    labels: DataFrame,
    listed: Sequence[ListedRule] = LISTED,
    page_id: str = "page_id",
    url: str = "url",
    **limits: float,
) -> DataFrame:
    """One row per page: ``page_id, url, host, path, rule, verdict, n_mined`` (mined rules that fire).

    ``labels`` has page_id and bad (boolean).
    """
    rows = pages.select(F.col(page_id).alias("page_id"), F.col(url).alias("url"))
    rows = rows.withColumns({"host": host_of(F.col("url")), "path": path_of(F.col("url"))})
    rows = rows.withColumn("tokens", F.coalesce(url_tokens(F.col("url"), F.col("host"), F.col("path")), F.array().cast("array<string>")))
    known = labels.select(F.col("page_id").alias("_id"), "bad").dropna().groupBy("_id").agg(F.max("bad").alias("bad"))
    rules = mine_rules(rows.join(known, F.col("page_id") == F.col("_id")).select("tokens", "bad"), **limits)
    # The inverted index: one posting per token of a rule. Pages meet it once per distinct url.
    index = rules.select(F.xxhash64("antecedent").alias("mined"), "n", F.explode("antecedent").alias("token"))
    met = rows.where("url IS NOT NULL").select("url", F.explode_outer("tokens").alias("token")).distinct().join(index, "token")
    fired = met.groupBy("url", "mined", "n").agg(F.count(F.lit(1)).alias("c")).where("c = n")
    fired = fired.groupBy(F.col("url").alias("_url")).agg(F.count(F.lit(1)).alias("n_mined"))
    judged = rows.join(fired, F.col("url") == F.col("_url"), "left").withColumn("listed", listed_rule(F.col("host"), F.col("path"), listed))
    own = F.when(F.col("n_mined") > 0, "block").otherwise("allow")
    return judged.select(
        "page_id",
        "url",
        "host",
        "path",
        F.col("listed.rule").alias("rule"),
        F.coalesce("listed.verdict", own).alias("verdict"),
        F.coalesce("n_mined", F.lit(0)).cast("bigint").alias("n_mined"),
    )
