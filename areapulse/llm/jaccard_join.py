"""Exact Jaccard self-join of documents on word shingles with a token-group matrix.

1. Every document becomes a set of shingle hashes. Equal sets are one from here on (their documents are members).
2. Tokens are ordered from rare to frequent. Two sets of similarity s or more share tokens in their prefixes (the first
   ``n - ceil(s n) + l`` tokens share at least l), so only prefix tokens that two sets hold are looked at.
3. Partition: every set is compared with one pivot, the most central set among those it shares prefix tokens with.
   Verified pairs put similar sets into one group; thousands of copies of a text become a star around one of them.
4. Sets near one pivot are a family, known by what they lack of the pivot and what they add. A set that misses the
   pivot can only reach a member that shares more than about half of the member's own changes with it, so pairs inside a
   family are sought through those few tokens.
5. The token-group matrix holds the union of each family's prefix tokens, with the sizes of the sets behind them. A set's
   overlap with a family's union bounds its overlap with every member, so a set visits only families that reach the bound:
   of two families, the sets of the smaller one visit the larger. A visitor is compared with the pivot on the whole sets.
   One that is near enough for any link is a guest of the family, known by its changes like a member, and the pairs of
   guests and members are sought with those of step 4. So nobody is joined with all members of a group.
6. Classes are the connected components of all verified pairs.

No step is approximate: steps 3 to 5 only leave out pairs that are connected already or cannot reach the threshold.
Tokens and names of sets are 64-bit hashes; among n of them about n^2 / 2^65 pairs meet by chance.

Defined cases: a null text or one without words has an empty set and is linked with nothing; a text of fewer words than a
shingle is one shingle; repeated rows and equal texts share a class; rows with a null id take part, and a class's name is
its smallest non-null id. Only the id and the text are read, so other columns may have any name.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from areapulse.llm.common import SPACED, components, giving_back, joined, mix64, window_hashes, words
from areapulse.session import cut_lineage

#: Counters of the frequency sketch; two rows of so many.
SKETCH_BITS = 18
SKETCH = 1 << SKETCH_BITS
#: Bits of the name filter.
FILTER = 1 << 23


@dataclass(frozen=True)
class Threshold:
    """Similarity ``num / den`` on shingles of ``shingle`` words."""

    shingle: int = 5
    num: int = 4
    den: int = 5

    def least(self, n: int) -> int:
        """Tokens that a partner of a set of size n must share."""
        return -(-self.num * n // self.den)

    def shared(self, n: int) -> int:
        """Prefix tokens that a partner must share."""
        return 3 if self.least(n) >= 24 else 1

    def prefix(self, n: int) -> int:
        return n - self.least(n) + self.shared(n)


def shingle_sets(texts: list[bytes | None], k: int) -> Iterator[np.ndarray]:
    """Sorted distinct shingle hashes of each text."""
    for lo, hi, text, starts in joined(texts):
        s, _, h = words(text, SPACED)
        cut = np.searchsorted(s, starts)
        for a, b in zip(cut[:-1].tolist(), cut[1:].tolist()):
            own = h[a:b]
            if len(own) >= k:
                yield np.unique(window_hashes(own, k))
            elif len(own):
                # Its length is part of the name, so that it never equals a longer shingle.
                yield mix64(window_hashes(own, len(own)) + np.uint64(len(own)))
            else:
                yield own


def set_name(tokens: np.ndarray) -> int:
    """Name of a set, from an order-free sum of its tokens."""
    total = mix64(tokens ^ np.uint64(0xD6E8FEB86659FD93)).sum(dtype=np.uint64) + np.uint64(len(tokens))
    return int(mix64(np.array([total], np.uint64)).view(np.int64)[0])


def _frequency(k: int) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts = np.zeros(2 * SKETCH, np.int64)
        held: list[np.ndarray] = []

        def add() -> None:
            tokens = np.concatenate(held) if held else np.empty(0, np.uint64)
            counts[:SKETCH] += np.bincount((tokens & np.uint64(SKETCH - 1)).astype(np.int64), minlength=SKETCH)
            counts[SKETCH:] += np.bincount(((tokens >> np.uint64(32)) & np.uint64(SKETCH - 1)).astype(np.int64), minlength=SKETCH)
            held.clear()

        for batch in batches:
            for tokens in shingle_sets(batch.column("text").to_pylist(), k):
                held.append(tokens)
                if len(held) >= 1000:
                    add()
            add()
        at = np.flatnonzero(counts)
        yield pa.RecordBatch.from_arrays([pa.array(at, pa.int64()), pa.array(counts[at], pa.int64())], names=["slot", "n"])

    return giving_back(run)


def rare_first(tokens: np.ndarray, sketch: np.ndarray) -> np.ndarray:
    """Tokens from rare to frequent by the sketch's estimate, ties by hash; the same order for every set."""
    low = sketch[(tokens & np.uint64(SKETCH - 1)).astype(np.int64)]
    high = sketch[((tokens >> np.uint64(32)) & np.uint64(SKETCH - 1)).astype(np.int64) + SKETCH]
    return tokens[np.argsort(np.minimum(low, high), kind="stable")]


def _fingerprints(rule: Threshold, sketch: np.ndarray) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            names, sizes, prefixes = [], [], []
            for tokens in shingle_sets(batch.column("text").to_pylist(), rule.shingle):
                n = len(tokens)
                names.append(set_name(tokens) if n else None)
                sizes.append(n)
                prefixes.append(rare_first(tokens, sketch)[: rule.prefix(n)].view(np.int64) if n else tokens.view(np.int64))
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column("doc_id"),
                    pa.array(sizes, pa.int64()),
                    pa.array(names, pa.int64()),
                    pa.array(prefixes, pa.list_(pa.int64())),
                ],
                names=["doc_id", "n", "sid", "prefix"],
            )

    return giving_back(run)


def _bits(sid: int) -> tuple[int, int]:
    """Places of a set in the name filter: its name is a hash already."""
    return sid & (FILTER - 1), (sid >> 24) & (FILTER - 1)


def name_slots(names: DataFrame) -> DataFrame:
    """Slots of the name filter; a set has its two however many pairs name it."""
    return names.distinct().select(F.explode(F.expr(f"array(sid & {FILTER - 1}L, shiftright(sid, 24) & {FILTER - 1}L)")).alias("s"))


def name_filter(names: DataFrame) -> np.ndarray:
    """A Bloom filter of a fixed size over set names, as bits: what it lets through besides is dropped by a later join."""
    words_of = name_slots(names).groupBy(F.expr("s div 32").alias("w")).agg(F.expr("bit_or(shiftleft(1L, cast(s % 32 as int)))").alias("b"))
    got = words_of.toArrow()
    out = np.zeros(FILTER // 32, np.uint32)
    out[got["w"].to_numpy()] = got["b"].to_numpy().astype(np.uint32)
    return np.unpackbits(out.view(np.uint8), bitorder="little").astype(bool)


def _tokens(k: int, packed: bytes) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """Whole sets of the wanted names, once per task."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        wanted = np.unpackbits(np.frombuffer(packed, np.uint8)).astype(bool)
        done: set[int] = set()
        for batch in batches:
            names, sets = [], []
            for tokens in shingle_sets(batch.column("text").to_pylist(), k):
                sid = set_name(tokens)
                if len(tokens) and all(wanted[b] for b in _bits(sid)) and sid not in done:
                    done.add(sid)
                    names.append(sid)
                    sets.append(tokens.tobytes())
            yield pa.RecordBatch.from_arrays([pa.array(names, pa.int64()), pa.array(sets, pa.binary())], names=["sid", "tokens"])

    return giving_back(run)


#: A set that shares less than this part of the union with its pivot is in no family.
NEAR = 0.6
#: A change that at least one member in so many has is a common one of its family.
COMMON = 64

COMPARED = "u long, v long, linked boolean, near boolean, size long, lacks array<bigint>, adds array<bigint>"


def _compare(rule: Threshold, least: float | None) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """Whether each pair reaches the threshold on its whole sets, and the size of v; from the similarity ``least`` on (none:
    never) the pair is near and comes with what u lacks of v and what it adds."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            linked, near, sizes, lacks, adds = [], [], [], [], []
            for x, y in zip(batch.column("tx"), batch.column("ty")):
                a, b = np.frombuffer(x.as_buffer(), np.uint64), np.frombuffer(y.as_buffer(), np.uint64)
                both = len(np.intersect1d(a, b, assume_unique=True))
                union = len(a) + len(b) - both
                linked.append(rule.den * both >= rule.num * union)
                near.append(least is not None and both >= least * union)
                sizes.append(len(b))
                lacks.append(np.setdiff1d(b, a, assume_unique=True).view(np.int64) if near[-1] else None)
                adds.append(np.setdiff1d(a, b, assume_unique=True).view(np.int64) if near[-1] else None)
            kinds = [pa.bool_(), pa.bool_(), pa.int64(), pa.list_(pa.int64()), pa.list_(pa.int64())]
            made = [pa.array(x, t) for x, t in zip((linked, near, sizes, lacks, adds), kinds)]
            names = ["u", "v", "linked", "near", "size", "lacks", "adds"]
            yield pa.RecordBatch.from_arrays([batch.column("u"), batch.column("v"), *made], names=names)

    return giving_back(run)


def _changed(compared: DataFrame, rule: Threshold, guest: bool) -> DataFrame:
    """Near sets of ``compared`` with their family, their changes, and what of them a partner must share."""
    tag = lambda column, kind: F.transform(column, lambda t: F.xxhash64(F.lit(kind), t))
    r, a = F.size("lacks"), F.size("adds")
    weight = a * rule.num + r * rule.den
    size = F.col("size") if "size" in compared.columns else F.lit(None)
    return compared.where("near").select(
        F.col("u").alias("sid"),
        F.col("v").alias("family"),
        "linked",
        F.concat(tag("adds", 1), tag("lacks", 0)).alias("changes"),
        F.floor(weight / (rule.num + rule.den)).cast("int").alias("part"),
        r.alias("r"),
        a.alias("a"),
        (2 * weight - (rule.den - rule.num) * size).cast("bigint").alias("due"),
        F.lit(guest).alias("guest"),
    )


def family_members(compared: DataFrame, rule: Threshold) -> tuple[DataFrame, DataFrame]:
    """The sets near a pivot with their changes, and (sid, family) of those sets and of the pivots. A pivot is a member of
    its own family alone."""
    pivots = compared.where("near").select(F.col("v").alias("family")).distinct()
    members = _changed(compared, rule, False).join(pivots.select(F.col("family").alias("sid")), "sid", "left_anti")
    members = cut_lineage(members, "families")
    return members, members.select("sid", "family").unionByName(pivots.select(F.col("family").alias("sid"), "family"))


def pairs_inside(members: DataFrame, rule: Threshold) -> DataFrame:
    """The pairs (u, v) of members, and of guests and members, of one family that may still be similar.

    Let a member lack r tokens of the pivot and add a. Two members share the pivot's tokens that neither lacks and the
    additions of both, so they reach the threshold if they agree in s changes, where s is a sum of a part of each. For a
    set that misses the pivot its own part alone is positive, so the other member's part, (num a + den r) / (num + den),
    must be exceeded by the changes of that member that the two agree in. If the member's changes stand in one order for
    the whole family, one of its first ``r + a - part`` is then shared. The order puts rare changes first: what the pivot
    alone adds is lacked by nearly all of its family, and a prefix that held it would pair them all. The changes of at least
    one member in ``COMMON`` go to the end, by their number of members; a family has at most ``COMMON`` times the mean
    number of changes of them, however many members it has. Two members that both miss the pivot must exceed both parts, so
    both come with their prefix alone; against a linked member, a member that misses comes with all its changes.

    Two sets agree in no more changes than the smaller number of lacks and the smaller number of additions, and must agree
    in ``due``, of which each of them brings its share and the size of the pivot is taken. So a set that is far from the
    pivot is not paired with those close to it.
    """
    # Only families with a member, or a guest of one, that misses the pivot have pairs to be sought.
    sizes = members.groupBy("family").agg(
        F.count(F.lit(1)).alias("size"), F.count_if(~F.col("linked")).alias("misses"), F.count_if(~F.col("guest")).alias("own")
    )
    open_to = members.join(sizes.where("misses > 0 AND size > 1 AND own > 0"), "family")
    held = open_to.select("family", "size", F.explode("changes").alias("token")).groupBy("family", "size", "token").agg(F.count(F.lit(1)).alias("n"))
    common = held.where(F.col("n") * COMMON >= F.col("size")).groupBy("family").agg(F.sort_array(F.collect_list(F.struct("n", "token"))).alias("c"))
    common = common.select("family", F.col("c.token").alias("common"))
    none = F.array().cast("array<bigint>")
    ordered = open_to.join(common, "family", "left").withColumn("common", F.coalesce("common", none))
    rare_first = F.concat(F.sort_array(F.array_except("changes", "common")), F.array_intersect("common", "changes"))
    kept = F.size("changes") - F.col("part")
    ordered = ordered.select("family", "sid", "linked", "guest", "r", "a", "due", rare_first.alias("changes"), kept.alias("kept"))
    entries = ordered.select("*", F.posexplode("changes").alias("at", "token")).withColumn("early", F.col("at") < F.col("kept")).drop("changes", "kept", "at")
    sought = entries.where("early").withColumnsRenamed({"sid": "v"} | {c: f"v_{c}" for c in ("linked", "guest", "r", "a", "due")}).drop("early")
    missing = entries.where("NOT linked").withColumnsRenamed({"sid": "u"} | {c: f"u_{c}" for c in ("early", "guest", "r", "a", "due")}).drop("linked")
    agree = f"{2 * (rule.num + rule.den)} * (least(u_r, v_r) + least(u_a, v_a)) >= u_due + v_due"
    met = missing.join(sought, ["family", "token"]).where(
        f"(v_linked OR (u_early AND u < v)) AND u <> v AND NOT (u_guest AND v_guest) AND coalesce({agree}, true)"
    )
    return met.select("u", "v").distinct()


def family_pairs(compared: DataFrame, rule: Threshold) -> tuple[DataFrame, DataFrame]:
    """(sid, family) of the sets near a pivot, and the pairs (u, v) inside families that may still be similar."""
    members, families = family_members(compared, rule)
    return families, pairs_inside(members, rule)


def similar_documents(docs: DataFrame, rule: Threshold = Threshold(), doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """One row per document: ``doc_id, n_shingles, component_id`` (smallest id of its class)."""
    spark = docs.sparkSession
    source = docs.select(F.col(doc_id).alias("doc_id"), F.coalesce(F.col(text), F.lit("")).cast("binary").alias("text"))

    # Frequency sketch: a fixed number of counters, over all documents.
    counted = source.select("text").mapInArrow(_frequency(rule.shingle), "slot long, n long").groupBy("slot").agg(F.sum("n").alias("n"))
    sketch = np.zeros(2 * SKETCH, np.int64)
    got = counted.toArrow()
    sketch[got["slot"].to_numpy()] = got["n"].to_numpy()

    id_type = source.schema["doc_id"].dataType.simpleString()
    found = source.mapInArrow(_fingerprints(rule, sketch), f"doc_id {id_type}, n long, sid long, prefix array<bigint>")
    found = cut_lineage(found, "fingerprints")
    sets = found.where("sid IS NOT NULL").groupBy("sid").agg(F.min("doc_id").alias("doc_id"))

    # Prefix tokens that at least two sets hold. Copies repeat their entries, which changes neither end of the range.
    entries = found.where("sid IS NOT NULL").select("sid", "n", F.explode_outer("prefix").alias("token"))
    held = entries.groupBy("token").agg(F.min("sid").alias("a"), F.max("sid").alias("b")).where("a <> b").select("token")
    shared = cut_lineage(entries.join(held, "token", "left_semi").distinct(), "shared-tokens")

    # Partition: one pivot per set, the partner with which it shares most among the most central ones.
    size_fits = f"{rule.den} * least(n, pn) >= {rule.num} * greatest(n, pn)"
    # The least number of prefix tokens that partners share follows from the size, as in Threshold.shared.
    need = lambda n: F.when(F.ceil(F.col(n) * rule.num / rule.den) >= 24, 3).otherwise(1)
    degree = shared.groupBy("token").agg(F.count(F.lit(1)).alias("df"))
    central = shared.join(degree, "token").groupBy("sid").agg(F.sum("df").alias("score"))
    pivots = shared.join(central, "sid").groupBy("token").agg(F.max(F.struct("score", "sid", "n")).alias("p"))
    pairs = (
        shared.join(pivots.select("token", F.col("p.sid").alias("pivot"), F.col("p.n").alias("pn")), "token")
        .where(f"sid <> pivot AND {size_fits}")
        .groupBy("sid", "pivot", "n", "pn")
        .agg(F.count(F.lit(1)).alias("c"))
        .where(F.col("c") >= F.least(need("n"), need("pn")))
        .groupBy("sid")
        .agg(F.max(F.struct("c", "pivot")).alias("p"))
        .select(F.col("sid").alias("u"), F.col("p.pivot").alias("v"))
    )

    def compare(pairs: DataFrame, name: str, least: float | None = None) -> DataFrame:
        """Pairs compared on their whole sets, which come from one more scan of the texts."""
        pairs = cut_lineage(pairs, f"{name}-asked")
        names = name_filter(pairs.select(F.col("u").alias("sid")).unionByName(pairs.select(F.col("v").alias("sid"))))
        packed = np.packbits(names).tobytes()
        whole = source.select("text").mapInArrow(_tokens(rule.shingle, packed), "sid long, tokens binary").dropDuplicates(["sid"])
        x = whole.select(F.col("sid").alias("u"), F.col("tokens").alias("tx"))
        y = whole.select(F.col("sid").alias("v"), F.col("tokens").alias("ty"))
        both = pairs.join(y, "v").join(x, "u").select("u", "v", "tx", "ty")
        return cut_lineage(both.mapInArrow(_compare(rule, least), COMPARED), name)

    stars = compare(pairs, "stars", NEAR)
    star_links = stars.where("linked").select("u", "v")
    members, families = family_members(stars, rule)
    groups = components(star_links, "groups").select(F.col("node").alias("sid"), F.col("root").alias("grp"))
    families = families.join(families.groupBy("family").agg(F.count(F.lit(1)).alias("many")), "family")
    grouped = shared.join(groups, "sid", "left").join(families, "sid", "left")
    own = [F.coalesce(c, "sid").alias(c) for c in ("grp", "family")]
    grouped = grouped.select("token", "sid", "n", *own, F.coalesce("many", F.lit(1)).alias("many"))

    # The matrix: tokens of each family's union, if a set of another family and group holds the token as well.
    ends = [f(c).alias(f"{c}{i}") for c in ("n", "grp") for i, f in enumerate((F.min, F.max))]
    matrix = grouped.groupBy("token", "family", "many").agg(*ends)
    matrix = cut_lineage(matrix, "token-family-matrix")
    several = matrix.groupBy("token").agg(F.min("family").alias("a"), F.max("family").alias("b"), F.min("grp0").alias("g"), F.max("grp1").alias("h"))
    cells = grouped.join(several.where("a <> b AND g <> h").select("token"), "token", "left_semi")
    others = matrix.withColumnsRenamed({"family": "kin", "many": "kin_many"})
    fits = f"{rule.den} * n1 >= {rule.num} * n AND {rule.den} * n >= {rule.num} * n0"
    visits = (
        cells.join(others, "token")
        .where(f"(many < kin_many OR (many = kin_many AND family < kin)) AND (grp0 <> grp OR grp1 <> grp) AND {fits}")
        .groupBy("sid", "n", "kin")
        .agg(F.count(F.lit(1)).alias("c"), F.min("n0").alias("n0"))
        .where(F.col("c") >= F.least(need("n"), need("n0")))
        .select(F.col("sid").alias("u"), F.col("kin").alias("v"))
    )
    # Distances 1 - J add up along a way: a set farther from the pivot than this is linked with none of its family.
    visits = compare(visits, "visits", NEAR - 1 + rule.num / rule.den - 1e-9)
    guests = cut_lineage(_changed(visits, rule, True).join(members.select("family").distinct(), "family", "left_semi"), "guests")
    rest = compare(pairs_inside(members.unionByName(guests), rule), "opened")
    star_links = star_links.unionByName(visits.where("linked").select("u", "v"))
    links = star_links.unionByName(rest.where("linked").select("u", "v"))
    roots = components(links, "classes")
    # The smallest id of each class, then back to every document through its set.
    classed = sets.join(roots.withColumnRenamed("node", "sid"), "sid", "left").withColumn("root", F.coalesce("root", "sid"))
    named = classed.groupBy("root").agg(F.min("doc_id").alias("component_id"))
    by_set = classed.select("sid", "root").join(named, "root").select("sid", "component_id")
    out = found.select("doc_id", F.col("n").alias("n_shingles"), "sid").join(by_set, "sid", "left")
    return out.select("doc_id", "n_shingles", F.coalesce("component_id", "doc_id").alias("component_id"))
