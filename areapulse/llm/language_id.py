"""Language identification by prediction by partial matching.

Each language has a context tree of bytes up to ``order``: how often each byte followed each context. A text's code length
under a language is the sum over its bytes: the longest seen context predicts the byte if it ever followed there (method
C: count over total plus distinct), else the escape is paid and the next shorter context is asked, down to a uniform
byte. Statistics are frozen after the fit, so a byte's cost is a function of the ``order`` bytes before it and is kept in
tables: one of costs for seen strings of each length, one of escapes for seen contexts, with a column per language.

The fit counts strings through Spark on a sample of at most about ``sample_bytes`` in all, spread evenly over the
languages and taken by a hash of the text, at least one text each. The tables are therefore bounded, and are sent to the
tasks. Every document is scored whole, in pieces of bounded size.

Defined cases: a text that is null or has no letter is ``und`` with score 0; null languages teach nothing; repeated rows
teach once and are scored as often as they come; equal code lengths go to the first language by name; without a learnable row every document is ``und``. Only the id, the text and
the language are read, so other columns may have any name.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

UNKNOWN = "und"
PIECE = 1 << 19


def _codes(data: np.ndarray, k: int) -> np.ndarray:
    """Strings of k bytes that end at each position, as numbers; a leading 1 tells lengths apart. The first k-1 have none."""
    n = len(data) - k + 1
    if n <= 0:
        return np.empty(0, np.int64)
    out = np.ones(n, np.int64)
    for i in range(k):
        out = out * 256 + data[i : i + n]
    return out


def _counter(order: int) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """Counts of all strings of 1 to order + 1 bytes per language, added up inside a batch."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts: dict[str, list[bytes]] = {}
            for lang, text in zip(batch.column("lang").to_pylist(), batch.column("text").to_pylist()):
                texts.setdefault(lang, []).append(text)
            for lang, own in texts.items():
                found = [_codes(np.frombuffer(t, np.uint8), k) for t in own for k in range(1, order + 2)]
                code, n = np.unique(np.concatenate(found), return_counts=True)
                yield pa.RecordBatch.from_arrays([pa.array([lang] * len(code), pa.string()), pa.array(code, pa.int64()), pa.array(n, pa.int64())], names=["lang", "code", "n"])

    return run


class Table:
    """Open-addressed lookup from codes to rows, for whole arrays at once."""

    def __init__(self, keys: np.ndarray) -> None:
        self.bits = max(4, int(2 * len(keys)).bit_length())
        self.keys = np.full(1 << self.bits, -1, np.int64)
        self.rows = np.full(1 << self.bits, -1, np.int32)
        left, at = np.arange(len(keys), dtype=np.int32), self._place(keys)
        while len(left):
            free = self.keys[at] < 0
            # Of several keys on one free slot the last written stays; the others try the next slot.
            self.keys[at[free]] = keys[left[free]]
            won = self.keys[at] == keys[left]
            self.rows[at[won]] = left[won]
            left, at = left[~won], (at[~won] + 1) & ((1 << self.bits) - 1)

    def _place(self, keys: np.ndarray) -> np.ndarray:
        return ((keys.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(64 - self.bits)).astype(np.int64)

    def find(self, keys: np.ndarray) -> np.ndarray:
        """Row of each key, -1 if absent."""
        at = self._place(keys)
        got = self.keys[at]
        out = np.where(got == keys, self.rows[at], -1)
        on = np.flatnonzero((got != keys) & (got >= 0))
        at = at[on]
        while len(on):
            at = (at + 1) & ((1 << self.bits) - 1)
            got = self.keys[at]
            same = got == keys[on]
            out[on[same]] = self.rows[at[same]]
            more = ~same & (got >= 0)
            on, at = on[more], at[more]
        return out


@dataclass
class LanguageModel:
    """Frozen context trees of all languages."""

    languages: list[str]
    order: int
    tables: list[tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]]  # per length: string codes, costs, context codes, escapes

    def __post_init__(self) -> None:
        self._lookup: list[tuple[Table, Table]] | None = None

    def __getstate__(self) -> dict:
        return {"languages": self.languages, "order": self.order, "tables": self.tables, "_lookup": None}

    def lengths(self, data: np.ndarray) -> np.ndarray:
        """Code length in bits under each language."""
        if self._lookup is None:
            self._lookup = [(Table(t[0]), Table(t[2])) for t in self.tables]
        total = np.zeros(len(self.languages))
        for at in range(0, len(data), PIECE):
            total += self._piece(data[max(0, at - self.order) : at + PIECE], min(at, self.order))
        return total

    def _piece(self, data: np.ndarray, skip: int) -> np.ndarray:
        """Costs of the bytes from ``skip`` on; the ones before are context."""
        total = np.zeros(len(self.languages))
        on = np.arange(skip, len(data))
        for k in range(self.order, -1, -1):
            strings, costs, contexts, escapes = self.tables[k]
            code = _codes(data, k + 1)
            early = on < k  # too close to the start of the text for a context of this length
            some = on[~early]
            row = self._lookup[k][0].find(code[some - k])
            hit = row >= 0
            if hit.any():
                total += np.bincount(row[hit], minlength=len(strings)) @ costs if len(strings) < hit.sum() else costs[row[hit]].sum(axis=0)
            missed = some[~hit]
            if k and len(missed):
                row = self._lookup[k][1].find(_codes(data, k)[missed - k])
                total += escapes[row[row >= 0]].sum(axis=0)
            on = np.concatenate([on[early], missed])
        return total + 8.0 * len(on)


def build_model(counts: DataFrame, order: int) -> LanguageModel:
    """Tables from (lang, code, n). The counts come from a bounded sample."""
    got = counts.toArrow()
    langs = got["lang"].to_numpy(zero_copy_only=False) if got.num_rows else np.empty(0, object)
    languages = sorted(set(langs.tolist()))
    column = np.array([languages.index(x) for x in langs], np.int64) if len(langs) else np.empty(0, np.int64)
    code, n = got["code"].to_numpy().astype(np.int64), got["n"].to_numpy().astype(np.int64)
    wide = len(languages)
    tables = []
    below: tuple[np.ndarray, np.ndarray] | None = None  # strings one byte shorter and their costs
    for k in range(order + 1):
        own = (code >> (8 * (k + 1))) == 1
        strings, at = np.unique(code[own], return_inverse=True)
        seen = np.zeros((len(strings), wide))
        seen[at, column[own]] = n[own]
        # Contexts of these strings: the string without its last byte.
        contexts, of = np.unique(strings >> 8, return_inverse=True)
        total, kinds = np.zeros((len(contexts), wide)), np.zeros((len(contexts), wide))
        np.add.at(total, of, seen)
        np.add.at(kinds, of, seen > 0)
        with np.errstate(divide="ignore", invalid="ignore"):
            escape = np.where(total > 0, -np.log2(kinds / (total + kinds)), 0.0)
            here = -np.log2(seen / (total + kinds)[of])
        # Where a language has not seen the string, it pays its escape (none if the context is new) and asks below.
        if k == 0:
            lower = np.full((len(strings), wide), 8.0)
        else:
            tail = (strings & ((1 << (8 * k)) - 1)) | (1 << (8 * k))
            lower = below[1][np.searchsorted(below[0], tail)]
        costs = np.where(seen > 0, here, escape[of] + lower)
        tables.append((strings, costs, contexts, escape))
        below = (strings, costs)
    return LanguageModel(languages, order, tables)


def fit_languages(
    docs: DataFrame, order: int = 4, sample_bytes: int = 6 << 20, text: str = "text", lang: str = "lang"
) -> LanguageModel:
    """Context trees from about ``sample_bytes`` of text, an equal share for each language (all of it if it has less).

    The text of the smallest hash of every language is always taken, so that no language is lost; copies teach once, and
    a text longer than a language's share teaches with its first share of bytes. The bound holds for the sample alone.
    """
    rows = docs.select(F.col(lang).cast("string").alias("lang"), F.col(text).cast("binary").alias("text")).dropna()
    rows = rows.withColumn("h", F.xxhash64("text"))
    known = rows.groupBy("lang").agg(F.sum(F.octet_length("text")).alias("n"), F.min(F.when(F.octet_length("text") > 0, F.col("h"))).alias("first"))
    known = known.collect()  # one row a language
    sizes = {r["lang"]: r["n"] for r in known}
    firsts = [r["first"] for r in known if r["first"] is not None]
    if not sizes:
        return LanguageModel([], order, [])
    share = max(1, sample_bytes // len(sizes))
    part = F.create_map(*[x for k, v in sizes.items() for x in (F.lit(k), F.lit(min(1.0, share / max(v, 1))))])
    # A text's place in [0, 1) by its hash, so that the sample does not depend on the order of rows.
    place = F.pmod("h", F.lit(1 << 30)) / float(1 << 30)
    taken = rows.where((place < F.element_at(part, F.col("lang"))) | F.col("h").isin(firsts))
    taken = taken.withColumn("text", F.substring("text", 1, share)).dropDuplicates(["lang", "h"]).select("lang", "text")
    counts = taken.mapInArrow(_counter(order), "lang string, code long, n long").groupBy("lang", "code").agg(F.sum("n").alias("n"))
    return build_model(counts, order)


def _scorer(model: LanguageModel) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            best, score, bits = [], [], []
            for text, letters in zip(batch.column("text"), batch.column("letters").to_pylist()):
                data = np.frombuffer(text.as_buffer(), np.uint8) if text.is_valid else np.empty(0, np.uint8)
                if not letters or not model.languages:
                    best.append(UNKNOWN)
                    score.append(0.0)
                    bits.append(None)
                    continue
                length = model.lengths(data)
                k = int(length.argmin())
                best.append(model.languages[k])
                score.append(float(1.0 / np.exp2(np.maximum(length[k] - length, -1000.0)).sum()))
                bits.append(float(length[k] / len(data)))
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), pa.array(best, pa.string()), pa.array(score, pa.float64()), pa.array(bits, pa.float64())],
                names=["doc_id", "lang_pred", "score", "bits_per_byte"],
            )

    return run


def identify_languages(docs: DataFrame, model: LanguageModel, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """``doc_id, lang_pred, score, bits_per_byte``: the language of the shortest code, and its share of the posterior."""
    rows = docs.select(
        F.col(doc_id).alias("doc_id"), F.col(text).cast("binary").alias("text"), F.coalesce(F.col(text).rlike(r"\p{L}"), F.lit(False)).alias("letters")
    )
    kind = rows.schema["doc_id"].dataType.simpleString()
    return rows.mapInArrow(_scorer(model), f"doc_id {kind}, lang_pred string, score double, bits_per_byte double")
