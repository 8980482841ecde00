"""Shared by the operators of this package: whole-text word splitting over bytes, hashes, and connected components."""

from __future__ import annotations

import ctypes
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from areapulse.session import cut_lineage

#: Java pattern of a word between ASCII white space.
WORD = r"[^\x20\x09-\x0D]+"
#: The same white space as characters.
SPACES = " \t\n\x0b\x0c\r"

# Odd base of the polynomial word hash and its inverse modulo 2^64.
_BASE = np.uint64(0x9E3779B97F4A7C15)
_INVERSE = np.uint64(pow(0x9E3779B97F4A7C15, -1, 1 << 64))
_SEGMENT = 1 << 20

_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
#: Bytes of words between white space. Bytes of non-ASCII characters are above 0x7F and always belong to a word.
SPACED = np.ones(256, bool)
SPACED[[0x20, *range(0x09, 0x0E)]] = False
#: Bytes of words of lower-cased letters and digits.
ALNUM = np.zeros(256, bool)
ALNUM[0x30:0x3A] = ALNUM[0x61:0x7B] = ALNUM[0x80:] = True


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The documents table as stored."""
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def unused(df: DataFrame, *names: str) -> list[str]:
    """Column names that start with these and that ``df`` does not have."""
    taken = {c.lower() for c in df.columns}
    prefix = "_"
    while any(c.startswith(prefix) for c in taken):
        prefix += "_"
    return [prefix + n for n in names]


def give_back() -> None:
    """Return free memory of this Python worker to the system: Spark keeps idle workers beside those of later stages."""
    global _powers
    _powers = None
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)  # glibc alone has it
    if trim is not None:
        trim(0)


def giving_back(run: Callable[[Iterator], Iterator]) -> Callable[[Iterator], Iterator]:
    """``run``, then ``give_back`` once its own frame and the last batch in it are gone."""

    def whole(batches: Iterator) -> Iterator:
        yield from run(batches)
        give_back()

    return whole


def mix64(h: np.ndarray) -> np.ndarray:
    """Finalizer that spreads every bit of a 64-bit hash."""
    h = h ^ (h >> np.uint64(30))
    h = h * np.uint64(0xBF58476D1CE4E5B9)
    h = h ^ (h >> np.uint64(27))
    h = h * np.uint64(0x94D049BB133111EB)
    return h ^ (h >> np.uint64(31))


_powers: tuple[np.ndarray, np.ndarray] | None = None


def _power_tables(n: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of the base and of its inverse, kept for the next call while they are of segment size."""
    global _powers
    if _powers is None or len(_powers[0]) < n:
        size = max(n, _SEGMENT + 4096)
        up, down = np.full(size, _BASE), np.full(size, _INVERSE)
        up[0] = down[0] = 1
        made = np.multiply.accumulate(up), np.multiply.accumulate(down)
        if size > 4 * _SEGMENT:
            return made
        _powers = made
    return _powers


def words(text: bytes, is_word: np.ndarray, lower: bool = True) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts, ends (bytes, end exclusive) and 64-bit hashes of the words of a whole text.

    Long texts are handled in segments that are cut at a byte between words, so working memory follows the number of
    words. Two different words share a hash with a probability of about 2^-64.
    """
    data = np.frombuffer(text, np.uint8)
    if lower:
        data = _LOWER[data]
    starts, ends, hashes = [], [], []
    at = 0
    while at < len(data):
        stop = min(len(data), at + _SEGMENT)
        while stop < len(data) and is_word[data[stop]]:
            stop += 1
        part = data[at:stop]
        inside = np.zeros(len(part) + 2, np.int8)
        inside[1:-1] = is_word[part]
        edge = np.diff(inside)
        s, e = np.flatnonzero(edge == 1), np.flatnonzero(edge == -1)
        if len(s):
            up, down = _power_tables(len(part) + 1)
            total = np.zeros(len(part) + 1, np.uint64)
            np.cumsum((part.astype(np.uint64) + np.uint64(1)) * up[: len(part)], out=total[1:])
            h = (total[e] - total[s]) * down[s] + (e - s).astype(np.uint64)
            starts.append(s + at)
            ends.append(e + at)
            hashes.append(mix64(h))
        at = stop
    if not starts:
        none = np.empty(0, np.int64)
        return none, none, np.empty(0, np.uint64)
    return np.concatenate(starts), np.concatenate(ends), np.concatenate(hashes)


def joined(texts: list[bytes | None], limit: int = 1 << 20) -> Iterator[tuple[int, int, bytes, np.ndarray]]:
    """Runs of texts as (first, past, bytes with a line break after each, start of each): one vectorized call for many short texts."""
    lo, size = 0, 0
    for i, t in enumerate(texts):
        n = len(t or b"") + 1
        if i > lo and size + n > limit:
            yield _run(texts, lo, i)
            lo, size = i, 0
        size += n
    if lo < len(texts):
        yield _run(texts, lo, len(texts))


def _run(texts: list[bytes | None], lo: int, hi: int) -> tuple[int, int, bytes, np.ndarray]:
    part = [t or b"" for t in texts[lo:hi]]
    starts = np.zeros(len(part) + 1, np.int64)
    np.cumsum([len(t) + 1 for t in part], out=starts[1:])
    return lo, hi, b"\n".join(part) + b"\n", starts


def window_hashes(h: np.ndarray, k: int) -> np.ndarray:
    """Hash of every run of ``k`` hashes, in order."""
    n = len(h) - k + 1
    out = np.zeros(max(n, 0), np.uint64)
    for i in range(k if n > 0 else 0):
        out = mix64(out * np.uint64(0x2545F4914F6CDD1D) + h[i : i + n] + np.uint64(i))
    return out


def components(links: DataFrame, name: str = "components") -> DataFrame:
    """(node, root) with the smallest node of every connected component of ``links`` (u, v).

    Alternating large and small stars: every round is two joins on aggregated minima and is cut by a written table, the
    number of rounds is logarithmic in practice, and a star of any size is split by the skew join. Loops are ignored.
    """
    spark = links.sparkSession
    pairs = links.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).where("u <> v").distinct()
    edges = cut_lineage(pairs, name)
    last = None
    while True:
        both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.join(low, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        large = cut_lineage(large, name)
        low = large.groupBy("u").agg(F.min("v").alias("m"))
        rest = large.join(low, "u").where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
        small = rest.unionByName(low.select("u", F.col("m").alias("v"))).where("u <> v")
        small = small.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct()
        edges = cut_lineage(small, name)
        state = edges.agg(F.count("*"), F.bit_xor(F.xxhash64("u", "v"))).first()
        if state == last:
            break
        last = state
    roots = edges.select(F.col("v").alias("node"), F.col("v").alias("root")).distinct()
    return edges.select(F.col("u").alias("node"), F.col("v").alias("root")).unionByName(roots)
