"""Benchmark decontamination with an FM-index per training shard.

A shard is a bounded run of documents inside a scan task. Its words become ids of the benchmark's vocabulary; words that
no benchmark item holds separate the runs, and runs shorter than every test phrase are left out, since none can lie in
them. The FM-index of the shard answers all test phrases by backward search; occurrences are located through sampled
suffix positions, checked against the words themselves, and merged into removal spans. Documents are never shuffled.

The benchmark is read in blocks of a bounded number of bytes, one pass over the documents each, so that neither the
driver nor a task ever holds more of it than ``block_bytes``.

Defined cases: a null or empty text has no words and is never hit; a benchmark row without id, text or words asks for
nothing; repeated benchmark rows count once per id; repeated documents give repeated rows; with an empty benchmark
nothing is hit. Input columns are carried in one struct, so their names cannot clash with results.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_type

from areapulse.llm.common import ALNUM, giving_back, words
from areapulse.llm.fm_index import FMIndex

SPANS = T.ArrayType(T.StructType().add("first_word", "long").add("past_word", "long").add("start", "long").add("end", "long"))


@dataclass
class Phrases:
    """The test phrases of one block: distinct windows over a vocabulary, and the items that hold each."""

    hashes: np.ndarray  # sorted hashes of the vocabulary; id = position + 1
    spelled: list[bytes]  # words in the same order
    windows: np.ndarray  # ids, one row a phrase
    lengths: np.ndarray
    items: list[np.ndarray]  # item positions of each phrase
    names: list[str]

    @property
    def shortest(self) -> int:
        return int(self.lengths.min()) if len(self.lengths) else 0


def phrases_of(items: list[tuple[str, bytes]], size: int) -> Phrases:
    """Windows of ``size`` words of each item; a shorter item is one window."""
    spelled: dict[int, bytes] = {}
    rows = []
    for name, text in items:
        s, e, h = words(text, ALNUM)
        low = text.lower()  # bytes: A-Z only
        spelled.update((int(x), low[a:b]) for x, a, b in zip(h, s, e))
        rows.append((name, h))
    hashes = np.array(sorted(spelled), np.uint64)
    found: dict[tuple[int, ...], set[int]] = {}
    names: dict[str, int] = {}
    for name, h in rows:
        ids = (np.searchsorted(hashes, h) + 1).tolist()
        for at in range(max(1, len(ids) - size + 1) if ids else 0):
            found.setdefault(tuple(ids[at : at + size]), set()).add(names.setdefault(name, len(names)))
    windows = np.zeros((len(found), size), np.int64)
    for i, w in enumerate(found):
        windows[i, : len(w)] = w
    lengths = np.array([len(w) for w in found], np.int64)
    return Phrases(hashes, [spelled[int(x)] for x in hashes], windows, lengths, [np.array(sorted(v)) for v in found.values()], list(names))


def _code_points(text: bytes) -> np.ndarray:
    """Number of code points before each byte."""
    data = np.frombuffer(text, np.uint8)
    return np.concatenate([[0], np.cumsum((data & 0xC0) != 0x80)])


def search_shard(texts: list[bytes], earlier: list[list[tuple[int, int]]], block: Phrases) -> tuple[list[int], list[list[dict]], list[list[str]]]:
    """Words, merged removal spans and found items of each text. ``earlier``: word spans of other blocks."""
    counts, where, ids_of = [], [], []
    for t in texts:
        s, e, h = words(t, ALNUM)
        counts.append(len(s))
        where.append((s, e))
        at = np.minimum(np.searchsorted(block.hashes, h), max(0, len(block.hashes) - 1))
        ids_of.append(np.where(block.hashes[at] == h, at + 1, 0) if len(block.hashes) else np.zeros(len(h), np.int64))
    base = np.concatenate([[0], np.cumsum(counts)])
    hit = np.zeros(int(base[-1]) + 1, np.int64)  # +1 at the first word of a span, -1 past its last
    items: list[set[int]] = [set() for _ in texts]
    # A 0 after each document keeps runs apart; `place` maps the joined ids back to words.
    parts = [np.append(i, 0) for i in ids_of]
    joined = np.concatenate([[0], *parts]) if parts else np.zeros(1, np.int64)
    edge = np.diff(np.concatenate([[0], (joined > 0).astype(np.int8), [0]]))
    starts, ends = np.flatnonzero(edge == 1), np.flatnonzero(edge == -1)
    long = (ends - starts >= block.shortest) if block.shortest else np.zeros(len(starts), bool)
    starts, ends = starts[long], ends[long]
    if len(starts):
        size = ends - starts
        keep = np.zeros(len(joined), np.int64)
        keep[starts] += 1
        keep[ends[ends < len(joined)]] -= 1
        inside = np.cumsum(keep) > 0
        inside[ends[ends < len(joined)]] = True  # the separator after each kept run
        inside[0] = True
        place = np.flatnonzero(inside)
        index = FMIndex(joined[place], len(block.hashes))
        lo, hi = index.search(block.windows, block.lengths)
        on = np.flatnonzero(hi > lo)
        n = (hi - lo)[on]
        if len(on):
            which = np.repeat(on, n)
            rows = np.repeat(lo[on] - np.concatenate([[0], np.cumsum(n)[:-1]]), n) + np.arange(int(n.sum()))
            at = place[index.locate(rows)] - 1
            doc_starts = base[:-1] + np.arange(len(texts))
            doc = np.searchsorted(doc_starts, at, side="right") - 1
            first = at - doc_starts[doc]
            for d, f, w in zip(doc.tolist(), first.tolist(), which.tolist()):
                m = int(block.lengths[w])
                if not _same_words(texts[d], where[d], ids_of[d], block, f, m):
                    continue
                hit[base[d] + f] += 1
                hit[base[d] + f + m] -= 1
                items[d].update(block.items[w].tolist())
    for d, spans in enumerate(earlier):
        for a, b in spans:
            hit[base[d] + a] += 1
            hit[base[d] + b] -= 1
    covered = np.cumsum(hit)[:-1] > 0
    out = []
    for d, t in enumerate(texts):
        own = covered[base[d] : base[d + 1]]
        spans = []
        if own.any():
            edge = np.diff(np.concatenate([[0], own.astype(np.int8), [0]]))
            points = _code_points(t)
            s, e = where[d]
            for a, b in zip(np.flatnonzero(edge == 1).tolist(), np.flatnonzero(edge == -1).tolist()):
                spans.append({"first_word": a, "past_word": b, "start": int(points[s[a]]), "end": int(points[e[b - 1]])})
        out.append(spans)
    return counts, out, [[block.names[i] for i in sorted(x)] for x in items]


def _same_words(text: bytes, where: tuple[np.ndarray, np.ndarray], ids: np.ndarray, block: Phrases, first: int, n: int) -> bool:
    """The exact check behind the hashes."""
    s, e = where
    return all(text[s[i] : e[i]].lower() == block.spelled[ids[i] - 1] for i in range(first, first + n))


_FOUND = T.StructType().add("n_words", "long").add("spans", SPANS).add("items", T.ArrayType(T.StringType()))
_ARROW = to_arrow_type(_FOUND)


def _searched(block: Phrases, shard_bytes: int) -> Callable[..., Column]:
    """Column function: a text and what earlier blocks found in it, to what is found by now."""

    @giving_back
    def search(batches: Iterator[tuple[pa.Array, pa.Array]]) -> Iterator[pa.Array]:
        for texts, found in batches:
            sizes = np.cumsum([len(x.as_buffer()) if x.is_valid else 0 for x in texts])
            out, lo = [], 0
            while lo < len(texts):
                before = int(sizes[lo - 1]) if lo else 0
                hi = max(lo + 1, int(np.searchsorted(sizes, before + shard_bytes, side="right")))
                part = [t or b"" for t in texts.slice(lo, hi - lo).cast(pa.binary()).to_pylist()]
                known = [x or {"spans": [], "items": []} for x in found.slice(lo, hi - lo).to_pylist()]
                lo = hi
                spans = [[(s["first_word"], s["past_word"]) for s in x["spans"]] for x in known]
                counts, merged, items = search_shard(part, spans, block)
                for n, s, i, x in zip(counts, merged, items, known):
                    out.append({"n_words": int(n), "spans": s, "items": sorted({*i, *x["items"]})})
            yield pa.array(out, _ARROW)

    @F.arrow_udf(_FOUND)
    def run(batches: Iterator[tuple[pa.Array, pa.Array]]) -> Iterator[pa.Array]:
        yield from search(batches)

    return run


def find_passages(
    docs: DataFrame,
    benchmark: DataFrame,
    keep: list[str],
    text: str = "text",
    item_id: str = "item_id",
    item_text: str = "text",
    window: int = 13,
    block_bytes: int = 4 << 20,
    shard_bytes: int = 8 << 20,
) -> DataFrame:
    """One row per document: ``doc`` (struct of ``keep``), ``n_words, n_hit, spans, items``.

    ``spans`` are disjoint, in order, in words and in code points (ends exclusive); ``items`` are distinct ids as text,
    sorted.
    """
    asked = benchmark.select(F.col(item_id).cast("string").alias("item"), F.col(item_text).cast("binary").alias("text")).dropna().distinct()
    total = asked.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    blocks = max(1, -(-int(total) // block_bytes))
    # Only the text goes through Python; what is kept of a row stays in the JVM.
    doc = F.struct(*[F.col(f"`{c}`") for c in keep]).alias("doc")
    rows = docs.select(doc, F.coalesce(F.col(text), F.lit("")).alias("text"), F.lit(None).cast(_FOUND).alias("found"))
    for b in range(blocks):
        part = asked.where(F.pmod(F.xxhash64("item", "text"), F.lit(blocks)) == b).collect()
        block = phrases_of(sorted((r["item"], bytes(r["text"])) for r in part), window)
        rows = rows.select("doc", "text", _searched(block, shard_bytes)(F.col("text"), F.col("found")).alias("found"))
    rows = rows.select("doc", "found.*")
    hit = F.aggregate("spans", F.lit(0).cast("bigint"), lambda a, s: a + s["past_word"] - s["first_word"])
    return rows.select("doc", "n_words", hit.alias("n_hit"), "spans", "items")


def cut_spans(text: str, spans: str) -> Column:
    """The text without its removal spans."""
    start = F.concat(F.array(F.lit(0).cast("bigint")), F.transform(spans, lambda s: s["end"]))
    past = F.concat(F.transform(spans, lambda s: s["start"]), F.array(F.length(text).cast("bigint")))
    parts = F.zip_with(start, past, lambda a, b: F.substring(F.col(text), (a + 1).cast("int"), (b - a).cast("int")))
    return F.array_join(parts, "")
