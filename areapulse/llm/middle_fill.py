"""Fill-in-the-middle texts by rotating blocks of a text in place.

A text is cut twice between its tokens; the cuts follow from a hash of the document's id, so every run makes the same.
The sentinels go into a bytearray in front of their segments, and segments change places by rotations of three reversals
each, which need no second copy of the text. The original comes back exactly by the inverse rotations. Both directions are
columns of their own: only id and text go through Python, other columns stay in the JVM, and nothing is shuffled.

Defined cases: a null text is an empty one; an empty text, and one that holds a sentinel, stays plain; a text of white space
is one token; a cut may fall on either end, which leaves segments empty; a null id hashes as an empty one; rows of one id are
cut alike, repeated rows give repeated rows, and there are no ties. A very long text is scanned and reversed in blocks, so
working memory beyond its bytearray is bounded. Nothing is kept but what is asked for, so columns may have any name.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from areapulse.llm.common import SPACED

_BLOCK = 1 << 16

FILLED = "struct<n:bigint,form:string,prefix_chars:bigint,middle_chars:bigint,output:string>"
_ARROW = pa.struct(
    [("n", pa.int64()), ("form", pa.string()), ("prefix_chars", pa.int64()), ("middle_chars", pa.int64()), ("output", pa.string())]
)


@dataclass(frozen=True)
class FillRule:
    """Which texts are rearranged, and how. Shares are per 100."""

    seed: int = 42
    rearranged: int = 50  # of all texts
    suffix_first: int = 80  # of those
    prefix_mark: str = "<P>"
    suffix_mark: str = "<S>"
    middle_mark: str = "<M>"

    @property
    def marks(self) -> tuple[bytes, bytes, bytes]:
        return self.prefix_mark.encode(), self.suffix_mark.encode(), self.middle_mark.encode()


def reverse(buf: bytearray, lo: int, hi: int) -> None:
    """Reverse ``buf[lo:hi]`` in place, swapping mirrored blocks."""
    while hi - lo > 1:
        k = min(_BLOCK, (hi - lo) // 2)
        left = buf[lo : lo + k]
        buf[lo : lo + k] = buf[hi - k : hi][::-1]
        buf[hi - k : hi] = left[::-1]
        lo, hi = lo + k, hi - k


def rotate(buf: bytearray, lo: int, mid: int, hi: int) -> None:
    """Exchange ``buf[lo:mid]`` and ``buf[mid:hi]`` in place by three reversals."""
    reverse(buf, lo, mid)
    reverse(buf, mid, hi)
    reverse(buf, lo, hi)


class Cuts:
    """Tokens of a text: white space with the word behind it; white space at the very end is one more."""

    def __init__(self, text: bytes) -> None:
        self.data = np.frombuffer(text, np.uint8)
        self.counts = [len(self._ends(lo)) for lo in range(0, len(self.data), _BLOCK)]
        self.words = sum(self.counts)
        self.n = self.words + int(len(text) > 0 and not SPACED[self.data[-1]])

    def _ends(self, lo: int) -> np.ndarray:
        """Ends of the words that end in a block."""
        is_word = np.zeros(min(_BLOCK, len(self.data) - lo) + 1, bool)
        part = SPACED[self.data[lo : lo + _BLOCK + 1]]
        is_word[: len(part)] = part
        return np.flatnonzero(is_word[:-1] & ~is_word[1:]) + lo + 1

    def end(self, k: int) -> int:
        """Bytes up to the end of the ``k``-th token."""
        if k > self.words:
            return len(self.data)
        before = 0
        for block, count in enumerate(self.counts):
            if k <= before + count:
                return int(self._ends(block * _BLOCK)[k - before - 1]) if k else 0
            before += count
        return 0


def code_points(text: bytes | bytearray | memoryview) -> int:
    """Code points of UTF-8 bytes: those that do not continue another."""
    data = np.frombuffer(text, np.int8)
    return sum(int(np.count_nonzero(data[lo : lo + _BLOCK] >= -64)) for lo in range(0, len(data), _BLOCK))


def fill(doc_id: str, text: bytes, rule: FillRule) -> tuple[int, str, int | None, int | None, bytes | bytearray]:
    """Tokens, form, code points of prefix and middle, and the output."""
    digest = hashlib.sha256(f"{rule.seed}:{doc_id}".encode()).hexdigest()
    h1, h2, h3, h4 = (int(digest[i : i + 8], 16) for i in (0, 8, 16, 24))
    cuts = Cuts(text)
    if not text or h3 % 100 >= rule.rearranged or any(m in text for m in rule.marks):
        return cuts.n, "plain", None, None, text
    a, b = sorted((h1 % (cuts.n + 1), h2 % (cuts.n + 1)))
    a, b = cuts.end(a), cuts.end(b)
    chars = code_points(memoryview(text)[:a]), code_points(memoryview(text)[a:b])
    p, s, m = rule.marks
    buf = bytearray(text)
    for at, mark in ((b, s), (a, m), (0, p)):
        buf[at:at] = mark
    middle, suffix = a + len(p), b + len(p) + len(m)
    if h4 % 100 < rule.suffix_first:
        rotate(buf, 0, suffix, len(buf))
        return cuts.n, "spm", *chars, buf
    rotate(buf, middle, suffix, len(buf))
    return cuts.n, "psm", *chars, buf


def restore(output: bytes, form: str, rule: FillRule) -> bytes | bytearray:
    """The text of an output: rotations back, then the sentinels go. No segment holds a sentinel, so each is found at once."""
    if form == "plain":
        return output
    p, s, m = rule.marks
    buf = bytearray(output)
    if form == "spm":
        rotate(buf, 0, buf.find(p), len(buf))
    else:
        rotate(buf, buf.find(s), buf.find(m), len(buf))
    for mark in (s, m, p):
        at = buf.rfind(mark)
        del buf[at : at + len(mark)]
    return buf


def filled(doc_id: Column, text: Column, rule: FillRule = FillRule()) -> Column:
    """``FILLED``: number of tokens, form (plain, psm or spm), code points of prefix and middle (null if plain), output."""

    @F.arrow_udf(FILLED)
    def run(batches: Iterator[tuple[pa.Array, pa.Array]]) -> Iterator[pa.Array]:
        for ids, texts in batches:
            rows = [fill(i.as_py(), t.as_buffer().to_pybytes() if t.is_valid else b"", rule) for i, t in zip(ids, texts)]
            columns = list(zip(*rows)) or [()] * 5
            outputs = pa.array([bytes(x) for x in columns[4]], pa.binary()).cast(pa.string())
            made = [pa.array(c, f.type) for c, f in zip(columns[:4], _ARROW)]
            yield pa.StructArray.from_arrays([*made, outputs], fields=list(_ARROW))

    return run(F.coalesce(doc_id.cast("string"), F.lit("")), F.coalesce(text, F.lit("")))


def restored(output: Column, form: Column, rule: FillRule = FillRule()) -> Column:
    """The original text of an output."""

    @F.arrow_udf("string")
    def run(batches: Iterator[tuple[pa.Array, pa.Array]]) -> Iterator[pa.Array]:
        for outputs, forms in batches:
            texts = [bytes(restore(o.as_buffer().to_pybytes(), f.as_py(), rule)) for o, f in zip(outputs, forms)]
            yield pa.array(texts, pa.binary()).cast(pa.string())

    return run(output, form)


def fill_in_middle(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", rule: FillRule = FillRule()) -> DataFrame:
    """One row per document: ``doc_id, n, form, prefix_chars, middle_chars, output``."""
    made = filled(F.col(doc_id), F.col(text), rule)
    return docs.select(F.col(doc_id).alias("doc_id"), made.alias("made")).select("doc_id", "made.*")
