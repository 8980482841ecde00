"""Secret scanning through a trigram inverted index.

Every rule's regular expression gives a Boolean query of trigrams: any match holds all trigrams of at least one of the
query's alternatives. The index lists, for each trigram that a rule asks for, the texts that hold it (one posting a
trigram and text, never gathered into a list). Intersecting the postings gives the candidate texts of each rule, and only
those are searched with the expression itself; a rule without mandatory trigrams is searched in every text.

All steps are native. Texts are named by a 128-bit hash, so copies share their postings; a hot text is split by the skew
join, which is a left join from the documents.

Defined cases: a null text is an empty one; an empty text has no span; repeated rows give repeated results; a null id is
kept. Only the id and the text are read, so other columns may have any name.
"""

from __future__ import annotations

from collections.abc import Iterable, Sequence
from dataclasses import dataclass
from itertools import product
from re import _constants as sre
from re import _parser

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from areapulse.operators.sizing import local_table


@dataclass(frozen=True)
class Rule:
    """A kind of secret: a Java regular expression, and the least length of one of its groups (0: the whole match)."""

    kind: str
    pattern: str
    group: int = 0
    least: int = 1


BASE_RULES = (
    Rule("assign", r"((?i:password|passwd|secret|token|api_?key))[\"']?\x20*[:=]\x20*[\"']?([A-Za-z0-9+/_.=-]+)", 2, 6),
    Rule("access", r"AKIA[A-Z0-9]+", 0, 20),
    # Runs of 24 or more: the same spans as runs of any length of which the short ones are dropped.
    Rule("hex", r"[0-9a-f]{24,}", 0, 24),
)
MORE_RULES = (
    Rule("github", r"gh[pousr]_[A-Za-z0-9]{36,}"),
    Rule("slack", r"xox[abprs]-[A-Za-z0-9-]{10,}"),
    Rule("jwt", r"eyJ[A-Za-z0-9_-]{8,}\.eyJ[A-Za-z0-9_-]{8,}\.[A-Za-z0-9_-]{8,}"),
    Rule("private_key", r"-----BEGIN [A-Z ]{0,20}PRIVATE KEY-----"),
    Rule("live_key", r"[sr]k_live_[A-Za-z0-9]{16,}"),
    Rule("google", r"AIza[A-Za-z0-9_-]{35}"),
)

Query = frozenset[frozenset[str]]
ANYTHING: Query = frozenset([frozenset()])
#: Alternatives beyond which a query is cut back to what is known so far.
MOST = 64


def _smallest(query: Iterable[frozenset[str]]) -> Query:
    """Alternatives that no other one is part of."""
    every = set(query)
    return frozenset(a for a in every if not any(b < a for b in every))


def _both(a: Query, b: Query) -> Query:
    joined = _smallest(x | y for x in a for y in b)
    return joined if len(joined) <= MOST else min((a, b), key=len)


def _of_strings(strings: Iterable[str]) -> Query:
    """Any of the strings must occur."""
    return _smallest(frozenset(s[i : i + 3] for i in range(len(s) - 2)) for s in strings)


def _walk(nodes: Sequence) -> tuple[frozenset[str] | None, Query]:
    """The exact strings of a sequence, or None with the query of its parts. Letters are folded."""
    exact: frozenset[str] = frozenset([""])  # of the stretch since the last open part
    query, closed = ANYTHING, True
    for op, value in nodes:
        own: frozenset[str] | None = None
        inner = ANYTHING
        if op is sre.LITERAL:
            own = frozenset([chr(value).lower()])
        elif op is sre.IN and all(o is sre.LITERAL for o, _ in value) and len(value) <= 8:
            own = frozenset(chr(v).lower() for _, v in value)
        elif op is sre.SUBPATTERN:
            own, inner = _walk(value[3])
        elif op is sre.BRANCH:
            parts = [_walk(x) for x in value[1]]
            if all(p[0] is not None for p in parts):
                own = frozenset().union(*[p[0] for p in parts])
            else:
                inner = _smallest(frozenset().union(*[_of_strings(p[0]) if p[0] is not None else p[1] for p in parts]))
        elif op is sre.MAX_REPEAT:
            low, high, body = value
            some, within = _walk(body)
            if some is not None and high == 1:
                own = some | {""} if low == 0 else some
            elif low >= 1:
                inner = _of_strings(some) if some is not None else within
        if own is not None and len(exact) * len(own) <= MOST:
            exact = frozenset(a + b for a, b in product(exact, own))
            continue
        closed = False
        query = _both(query, _of_strings(exact))
        query = _both(query, inner if own is None else _of_strings(own))
        exact = frozenset([""])
    return (exact, ANYTHING) if closed else (None, _both(query, _of_strings(exact)))


def trigram_query(pattern: str) -> Query:
    """Alternatives of lower-case trigrams of which every match holds one whole; ``ANYTHING`` if there is none."""
    exact, query = _walk(list(_parser.parse(pattern)))
    query = _of_strings(exact) if exact is not None else query
    return ANYTHING if frozenset() in query else query


def postings(texts: DataFrame, trigrams: Sequence[str]) -> DataFrame:
    """The index: (trigram, k1, k2), one row for each asked trigram and text that holds it."""
    asked = F.array(*[F.lit(t) for t in trigrams])
    held = F.filter(asked, lambda t: F.contains(F.col("folded"), t))
    folded = texts.select("k1", "k2", F.lower("text").alias("folded"))
    # The outer form keeps the optimizer from computing the array a second time for a size filter.
    rows = folded.select("k1", "k2", F.explode_outer(held).alias("trigram")).where("trigram IS NOT NULL")
    return rows.distinct()


def candidates(spark: SparkSession, index: DataFrame, queries: dict[str, Query]) -> DataFrame:
    """(k1, k2, kinds): the texts that hold an alternative of a rule, by intersecting the postings."""
    terms = [(kind, i, t, len(a)) for kind, q in queries.items() for i, a in enumerate(sorted(q, key=sorted)) for t in sorted(a)]
    asked = local_table(spark, terms, "kind string, alternative int, trigram string, need int")
    # The terms follow from the list of rules alone.
    met = index.join(F.broadcast(asked), "trigram").groupBy("k1", "k2", "kind", "alternative", "need").agg(F.count(F.lit(1)).alias("n"))
    return met.where("n = need").groupBy("k1", "k2").agg(F.collect_set("kind").alias("kinds"))


def running_total(a: Column) -> Column:
    """Running totals of an array, in blocks of about the root of its size: n ** 1.5 steps for n numbers."""
    none = F.array().cast("array<bigint>")

    def plain(x: Column) -> Column:
        return F.aggregate(x, none, lambda acc, v: F.concat(acc, F.array(F.coalesce(F.get(acc, F.size(acc) - 1), F.lit(0)) + v)))

    width = F.greatest(F.ceil(F.sqrt(F.size(a))).cast("int"), F.lit(1))
    parts = F.transform(F.sequence(F.lit(0), F.ceil(F.size(a) / width).cast("int") - 1), lambda c: plain(F.slice(a, c * width + 1, width)))

    def shifted(p: Column) -> Column:
        ends = plain(F.transform(p, lambda x: F.get(x, F.size(x) - 1)))
        return F.flatten(F.transform(F.arrays_zip(p.alias("p"), ends.alias("e")), lambda z: F.transform(z["p"], lambda v: v + z["e"] - F.get(z["p"], F.size(z["p"]) - 1))))

    return F.when(F.size(a) == 0, none).otherwise(F.transform(F.array(parts), shifted)[0])


def rule_spans(text: str, rule: Rule, order: int) -> Column:
    """Spans of a rule's leftmost matches, in code points: the text between matches and the matches themselves have
    lengths that add up to the positions."""
    t, pattern = F.col(text), F.lit(rule.pattern)
    found = F.regexp_extract_all(t, pattern, F.lit(0))
    part = F.regexp_extract_all(t, pattern, F.lit(rule.group))
    between = F.split(t, rule.pattern, -1)

    def spans(x: Column) -> Column:
        steps = F.transform(x["m"], lambda m, i: (F.length(F.get(x["g"], i)) + F.coalesce(F.length(F.get(x["m"], i - 1)), F.lit(0))).cast("bigint"))
        return F.transform(
            F.arrays_zip(x["m"].alias("m"), x["p"].alias("p"), running_total(steps).alias("s")),
            lambda z: F.struct(
                z["s"].alias("start"), F.lit(order).alias("o"), F.lit(rule.kind).alias("kind"), (z["s"] + F.length(z["m"])).alias("end"), F.length(z["p"]).alias("n")
            ),
        )

    held = F.transform(F.array(F.struct(found.alias("m"), part.alias("p"), between.alias("g"))), spans)[0]
    return F.filter(held, lambda z: z["n"] >= rule.least)


SPANS = "array<struct<start:bigint,o:int,kind:string,end:bigint,n:int>>"


def find_secrets(docs: DataFrame, rules: Sequence[Rule] = BASE_RULES + MORE_RULES, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """One row per document: ``doc_id``, ``text`` and ``spans`` (start, o, kind, end, n), by start and then order of rules."""
    spark = docs.sparkSession
    whole = docs.select(F.col(doc_id).alias("doc_id"), F.coalesce(F.col(text), F.lit("")).alias("text"))
    keyed = whole.select("doc_id", "text", F.xxhash64("text").alias("k1"), F.xxhash64(F.lit("second"), "text").alias("k2"))
    queries = {r.kind: q for r in rules if (q := trigram_query(r.pattern)) != ANYTHING}
    asked = sorted({t for q in queries.values() for a in q for t in a})
    if asked:
        found = candidates(spark, postings(keyed, asked), queries)
        keyed = keyed.join(found, ["k1", "k2"], "left")
    else:
        keyed = keyed.withColumn("kinds", F.lit(None).cast("array<string>"))
    none = F.array().cast(SPANS)
    for i, rule in enumerate(rules):
        open_to = F.coalesce(F.array_contains("kinds", rule.kind), F.lit(False)) if rule.kind in queries else F.lit(True)
        keyed = keyed.withColumn(f"s{i}", F.when(open_to & F.col("text").rlike(rule.pattern), rule_spans("text", rule, i)).otherwise(none))
    spans = F.array_sort(F.concat(*[F.col(f"s{i}") for i in range(len(rules))]))
    return keyed.select("doc_id", "text", spans.alias("spans"))


def written(spans: Column) -> Column:
    """kind:start:end, comma-joined."""
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")


def masked(text: str, spans: str, mask: str = "*") -> Column:
    """The text with every character of a span replaced; overlapping spans may share characters."""
    return F.aggregate(
        spans,
        F.col(text),
        lambda t, s: F.concat(
            F.substring(t, F.lit(1), s["start"].cast("int")),
            F.repeat(F.lit(mask), (s["end"] - s["start"]).cast("int")),
            F.substring(t, (s["end"] + 1).cast("int"), F.length(t)),
        ),
    )
