"""Token ids in files of directly addressable codes.

An id is split into chunks of eight bits. Level 0 holds the lowest chunk of every id; a continuation bitmap marks the ids
that go on, and level 1 holds their next chunk, and so on. A rank directory over each bitmap counts the set bits up to
every 512th position, so the chunks of any one token are found by one rank a level, without decoding a block.

Documents are range-partitioned and sorted by id, encoded once, and written as files of bounded size to the shared
folder. A manifest with one row per file is written through Spark: an attempt that is repeated after a lost executor
writes files of its own, and only the files of the attempt that ended are listed. Reading joins nothing: the manifest's
running totals give every file its first position.

Defined cases: a null text is an empty one and holds the end id only; a null id sorts first and is kept; repeated rows are
written as often as they come; rows of one id are ordered by their text; an empty table has a manifest without rows.
Only the id and the text are read, so other columns may have any name.
"""

from __future__ import annotations

import json
import os
import re
import struct
import uuid
import zlib
from collections.abc import Callable, Iterator
from dataclasses import dataclass
from itertools import chain

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyarrow import fs
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from tokenizers import Tokenizer, pre_tokenizers

from areapulse.llm.common import giving_back
from areapulse.session import cut_lineage, fresh_dir

MAGIC = b"DACTOK01"
HEAD = struct.Struct("<8sQQII")
LEVEL = struct.Struct("<Q")
BLOCK = 512  # bits per entry of a rank directory


def _rank_directory(bits: np.ndarray) -> np.ndarray:
    """Set bits before each block of the packed bitmap."""
    per_byte = np.bitwise_count(bits).astype(np.uint64)
    full = np.zeros(-(-len(bits) * 8 // BLOCK) * (BLOCK // 8), np.uint64)
    full[: len(bits)] = per_byte
    sums = full.reshape(-1, BLOCK // 8).sum(axis=1) if len(full) else np.zeros(0, np.uint64)
    return np.concatenate([[0], np.cumsum(sums)]).astype("<u8")


def pack(doc_ids: list[int | None], docs: list[np.ndarray]) -> bytes:
    """One file: header, documents, then the levels with their bitmaps and rank directories."""
    ids = np.concatenate(docs).astype(np.uint32) if docs else np.zeros(0, np.uint32)
    levels = []
    rest = ids
    while True:
        goes_on = rest > 255
        bits = np.packbits(goes_on, bitorder="little")
        levels.append((len(rest), (rest & 255).astype(np.uint8), bits, _rank_directory(bits)))
        rest = rest[goes_on] >> 8
        if not len(rest):
            break
    starts = np.concatenate([[0], np.cumsum([len(d) for d in docs])]).astype("<u8")
    known = np.array([d is not None for d in doc_ids], np.uint8)
    keys = np.array([d or 0 for d in doc_ids], "<i8")
    out = [HEAD.pack(MAGIC, len(ids), len(docs), len(levels), 8), known.tobytes(), keys.tobytes(), starts.tobytes()]
    for n, chunks, bits, ranks in levels:
        out += [LEVEL.pack(n), chunks.tobytes(), bits.tobytes(), ranks.tobytes()]
    return b"".join(out)


class TokenFile:
    """Random access to the ids of one file."""

    def __init__(self, data: bytes) -> None:
        magic, self.n_tokens, self.n_docs, n_levels, self.width = HEAD.unpack_from(data)
        if magic != MAGIC:
            raise ValueError("not a token file")
        at = HEAD.size

        def take(kind: str, n: int) -> np.ndarray:
            nonlocal at
            out = np.frombuffer(data, kind, n, at)
            at += out.nbytes
            return out

        known, keys = take("u1", self.n_docs), take("<i8", self.n_docs)
        self.doc_ids = [int(k) if ok else None for k, ok in zip(keys, known)]
        self.starts = take("<u8", self.n_docs + 1).astype(np.int64)
        self.levels = []
        for _ in range(n_levels):
            n = LEVEL.unpack_from(data, at)[0]
            at += LEVEL.size
            packed = -(-n // 8)
            self.levels.append((take("u1", n), take("u1", packed), take("<u8", -(-packed * 8 // BLOCK) + 1)))

    def _rank(self, bits: np.ndarray, ranks: np.ndarray, at: np.ndarray) -> np.ndarray:
        """Set bits before each position: the directory, then at most 63 bytes and one part of a byte."""
        block = at // BLOCK
        byte = (block * (BLOCK // 8))[:, None] + np.arange(BLOCK // 8)
        full = np.bitwise_count(bits[np.minimum(byte, len(bits) - 1)])
        out = ranks[block].astype(np.int64) + np.where(byte < (at // 8)[:, None], full, 0).sum(axis=1, dtype=np.int64)
        last = np.minimum(at // 8, len(bits) - 1)
        return out + np.bitwise_count(bits[last] & ((1 << (at % 8)) - 1).astype(np.uint8))

    @staticmethod
    def _rank_one(bits: np.ndarray, ranks: np.ndarray, at: int) -> int:
        """The same for one position."""
        block, byte = at // BLOCK, at // 8
        out = int(ranks[block]) + int(np.bitwise_count(bits[block * (BLOCK // 8) : byte]).sum())
        return out + (int(bits[byte]) & ((1 << (at % 8)) - 1)).bit_count() if at % 8 else out

    def tokens(self, at: np.ndarray) -> np.ndarray:
        """Ids at any positions, in any order."""
        at = np.asarray(at, np.int64)
        out = np.zeros(len(at), np.uint32)
        on = np.arange(len(at))
        for depth, (chunks, bits, ranks) in enumerate(self.levels):
            out[on] |= chunks[at].astype(np.uint32) << np.uint32(8 * depth)
            more = (bits[at // 8] >> (at % 8).astype(np.uint8)) & 1 == 1
            on, at = on[more], at[more]
            if not len(on):
                break
            at = self._rank(bits, ranks, at)
        return out

    def slice(self, first: int, past: int) -> np.ndarray:
        """Ids of a range: one rank a level, then the chunks of every level lie side by side."""
        out = np.zeros(past - first, np.uint32)
        on = np.arange(past - first)
        for depth, (chunks, bits, ranks) in enumerate(self.levels):
            if not len(on):
                break
            out[on] |= chunks[first : first + len(on)].astype(np.uint32) << np.uint32(8 * depth)
            lo = first // 8
            flags = np.unpackbits(bits[lo : -(-(first + len(on)) // 8)], bitorder="little")[first - lo * 8 :][: len(on)]
            first = self._rank_one(bits, ranks, first)
            on = on[flags == 1]
        return out

    def document(self, k: int) -> np.ndarray:
        """Ids of the k-th document of the file."""
        return self.slice(int(self.starts[k]), int(self.starts[k + 1]))


# Latin letters with trailing marks, where lower-casing and splitting are the same in every Unicode version; one word a line.
_PLAIN = re.compile(r"^(?:([A-Za-zÀ-ÖØ-öø-ÿ]+)([!-&(-/:;=?@\[-`{}~]*)|.*)$", re.MULTILINE)


# Fixed pattern of the pre-tokens of a word-level BPE: letters, single digits or marks, never white space.
_PRE_TOKENS = r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"


def word_level(spec: str) -> tuple[bool, bool]:
    """Whether a tokenizer file encodes each word between white space by itself, and whether it lower-cases.

    True only for what is known to do so: composition, white space made blanks and lower-casing as the only normalizers, and
    the pre-tokens of letters, digits or marks above. Any other file is encoded text by text.
    """
    file = json.loads(spec)
    normalizer, splitter = file.get("normalizer") or {}, file.get("pre_tokenizer") or {}
    steps = normalizer.get("normalizers", [normalizer] if normalizer else [])
    blanks = {"type": "Replace", "pattern": {"Regex": r"\s+"}, "content": " "}
    plain = all(step == blanks or step in ({"type": "NFC"}, {"type": "Lowercase"}) for step in steps)
    parts = splitter.get("pretokenizers", [splitter] if splitter else [])
    split = parts[0] if parts else {}
    alone = split.get("type") == "Split" and split.get("invert") is True and split.get("behavior") == "Removed"
    alone = alone and split.get("pattern") == {"Regex": _PRE_TOKENS}
    bytes_only = all(x.get("type") == "ByteLevel" and not x.get("use_regex", True) and not x.get("add_prefix_space", True) for x in parts[1:])
    return plain and alone and bytes_only, {"type": "Lowercase"} in steps


@dataclass
class WordEncoder:
    """Encodes texts word by word with a bounded cache of two generations, or whole where the tokenizer needs it.

    ``word_level`` reads from the file whether words can be encoded by themselves and whether the tokenizer lower-cases
    (words of one spelling then share an entry).
    """

    spec: str
    limit: int = 250_000

    def __post_init__(self) -> None:
        # Spark runs one task per core; threads of the tokenizer would only compete with them.
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        self.tokenizer = Tokenizer.from_str(self.spec)
        self.alone, self.lower = word_level(self.spec)
        # Pieces of plain words are lower-cased, composed and one pre-token each, so only blanks have to be cut between them.
        self.pieces = Tokenizer.from_str(self.spec)
        if self.alone:
            rest = json.loads(self.spec)["pre_tokenizer"].get("pretokenizers", [])[1:]
            levels = [pre_tokenizers.ByteLevel(add_prefix_space=False, use_regex=False) for _ in rest]
            self.pieces.normalizer, self.pieces.pre_tokenizer = None, pre_tokenizers.Sequence([pre_tokenizers.WhitespaceSplit(), *levels])
        vocabulary = self.tokenizer.get_vocab(with_added_tokens=True)
        suffix = getattr(self.tokenizer.model, "end_of_word_suffix", None)
        self.closes = np.zeros(max(vocabulary.values(), default=0) + 1, bool)
        if suffix:
            self.closes[[i for t, i in vocabulary.items() if t.endswith(suffix)]] = True
        self.words: tuple[dict, dict] = ({}, {})  # young and old
        self.parts: tuple[dict, dict] = ({}, {})

    def _encode(self, pieces: list[str]) -> list[bytes]:
        """Ids of pieces that are one pre-token each: all in one call, cut where a token closes a word."""
        ids = np.array(self.pieces.encode_batch_fast([" ".join(pieces)], add_special_tokens=False)[0].ids, "<u4")
        past = np.flatnonzero(self.closes[ids]) + 1
        if len(past) != len(pieces) or (len(past) and past[-1] != len(ids)):
            return self._encode_each(pieces)
        data, cuts = ids.tobytes(), (past * 4).tolist()
        return [data[a:b] for a, b in zip([0, *cuts], cuts)]

    def _encode_each(self, words: list[str]) -> list[bytes]:
        return [np.array(x.ids, "<u4").tobytes() for x in self.tokenizer.encode_batch_fast(words, add_special_tokens=False)]

    def _recall(self, known: tuple[dict, dict], asked: list) -> list:
        """What neither generation has; what only the old one has becomes young again."""
        young, old = known
        young.update((x, old[x]) for x in asked if x in old)
        return [x for x in asked if x not in young]

    def _aged(self, known: tuple[dict, dict]) -> tuple[dict, dict]:
        return ({}, known[0]) if len(known[0]) > self.limit else known

    def _learn(self, missing: list[bytes]) -> None:
        spelled = [w.decode("utf-8", "replace") for w in missing]
        # Words hold no line break: one search over all of them, with an empty pair for what is not plain.
        pieces = [(a.lower(), b) for a, b in _PLAIN.findall("\n".join(spelled))] if self.lower and spelled else [("", "")] * len(spelled)
        asked = set().union(*pieces)
        asked.discard("")
        new = self._recall(self.parts, list(asked))
        if new:
            self.parts[0].update(zip(new, self._encode(new)))
        known, words = self.parts[0], self.words[0]
        odd = [(w, x) for w, x, p in zip(missing, spelled, pieces) if not p[0]]
        words.update(zip([w for w, _ in odd], self._encode_each([x for _, x in odd])))
        words.update((w, known[a] + known[b] if b else known[a]) for w, (a, b) in zip(missing, pieces) if a)

    def forget(self) -> None:
        """Drop the cached words: idle workers would hold them beside those at work."""
        self.words, self.parts = ({}, {}), ({}, {})

    def encode(self, text: bytes) -> bytes:
        """Ids as little-endian unsigned 32-bit integers."""
        return self.encode_all([text])[0]

    def encode_all(self, texts: list[bytes]) -> list[bytes]:
        """Ids of several texts; the words that none of them had before are learned in one go."""
        if not self.alone:
            return [self._encode_each([text.decode("utf-8", "replace")])[0] for text in texts]
        # Special tokens are spelled exactly; elsewhere A-Z are lowered.
        split = [(text.lower() if self.lower and b"<|" not in text else text).split() for text in texts]
        unknown = set().union(*split).difference(self.words[0])
        if unknown:
            self.words, self.parts = self._aged(self.words), self._aged(self.parts)
            if not self.words[0]:
                unknown = set().union(*split)
            missing = self._recall(self.words, list(unknown))
            if missing:
                self._learn(missing)
        known = self.words[0].__getitem__
        return [b"".join(map(known, words)) for words in split]


_encoders: dict[int, WordEncoder] = {}


def _encoder(spec: str) -> WordEncoder:
    """One encoder per Python worker."""
    key = zlib.crc32(spec.encode())
    if key not in _encoders:
        _encoders[key] = WordEncoder(spec)
    return _encoders[key]


def open_folder(path: str) -> tuple[fs.FileSystem, str]:
    """File system and path of a shared folder: a plain path or a URI that Arrow knows (file, hdfs, s3, gs)."""
    return fs.FileSystem.from_uri(re.sub(r"^s3a:", "s3:", path))


MANIFEST = "task int, seq int, path string, n_docs long, n_tokens long, n_bytes long"


#: Bytes of text whose words are looked up together.
BUNCH = 1 << 18


def _bunches(texts: pa.Array) -> Iterator[tuple[int, int]]:
    """(first, number) of runs of texts of about ``BUNCH`` bytes, one text at least."""
    lo, size = 0, 0
    for i, n in enumerate(pc.binary_length(texts).to_pylist()):
        if i > lo and size + n > BUNCH:
            yield lo, i - lo
            lo, size = i, 0
        size += n
    if lo < len(texts):
        yield lo, len(texts) - lo


def _writer(folder: str, spec: str, end_id: int, file_tokens: int) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        store, root = open_folder(folder)
        store.create_dir(root, recursive=True)
        encoder, end = _encoder(spec), np.array([end_id], np.uint32)
        task, attempt, seq = TaskContext.get().partitionId(), uuid.uuid4().hex, 0
        keys: list[int | None] = []
        held: list[np.ndarray] = []
        size = 0

        def flush() -> pa.RecordBatch:
            nonlocal keys, held, size, seq
            name = f"part-{task:06d}-{seq:06d}-{attempt}.dac"
            data = pack(keys, held)
            with store.open_output_stream(f"{root}/{name}") as out:
                out.write(data)
            row = [[task], [seq], [f"{folder}/{name}"], [len(keys)], [size], [len(data)]]
            kinds = [pa.int32(), pa.int32(), pa.string(), pa.int64(), pa.int64(), pa.int64()]
            names = ["task", "seq", "path", "n_docs", "n_tokens", "n_bytes"]
            keys, held, size, seq = [], [], 0, seq + 1
            return pa.RecordBatch.from_arrays([pa.array(v, k) for v, k in zip(row, kinds)], names=names)

        for batch in batches:
            column = batch.column("text")
            bunches = (encoder.encode_all(column.slice(lo, n).to_pylist()) for lo, n in _bunches(column))
            for key, coded in zip(batch.column("doc_id").to_pylist(), chain.from_iterable(bunches)):
                ids = np.concatenate([np.frombuffer(coded, "<u4"), end])
                keys.append(key)
                held.append(ids)
                size += len(ids)
                if size >= file_tokens:
                    yield flush()
        if keys:
            yield flush()
        encoder.forget()

    return giving_back(run)


def write_tokens(
    docs: DataFrame, tokenizer_path: str, end_id: int, doc_id: str = "doc_id", text: str = "text", file_tokens: int = 1 << 21
) -> DataFrame:
    """Encode and write; returns the manifest, in the order of the files: ``task, seq, path, n_docs, n_tokens, n_bytes``."""
    spark = docs.sparkSession
    with open(tokenizer_path, encoding="utf-8") as f:
        spec = f.read()
    rows = docs.select(F.col(doc_id).cast("bigint").alias("doc_id"), F.coalesce(F.col(text), F.lit("")).cast("binary").alias("text"))
    # The text's hash is part of the key so that many rows of one id can go to several tasks.
    rows = rows.withColumn("_h", F.xxhash64("text")).repartitionByRange("doc_id", "_h").sortWithinPartitions("doc_id", "_h", "text")
    made = rows.select("doc_id", "text").mapInArrow(_writer(fresh_dir(spark, "token-files"), spec, end_id, file_tokens), MANIFEST)
    return cut_lineage(made, "token-manifest")


def _reader(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for path, start in zip(batch.column("path").to_pylist(), batch.column("file_start").to_pylist()):
            store, at = open_folder(path)
            with store.open_input_file(at) as f:
                file = TokenFile(f.read())
            data, cuts = file.slice(0, file.n_tokens).astype("<u4").tobytes(), (file.starts * 4).tolist()
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array(file.doc_ids, pa.int64()),
                    pa.array(file.starts[:-1] + start, pa.int64()),
                    pa.array(np.diff(file.starts), pa.int64()),
                    pa.array([data[a:b] for a, b in zip(cuts, cuts[1:])], pa.binary()),
                ],
                names=["doc_id", "start", "n_tokens", "ids"],
            )


def read_tokens(spark: SparkSession, manifest: DataFrame) -> DataFrame:
    """Every document from its file: ``doc_id, start, n_tokens, ids`` (little-endian unsigned 32-bit integers)."""
    files = manifest.count()
    # One row per file, some megabytes each: the running total is small.
    before = Window.orderBy("task", "seq").rowsBetween(Window.unboundedPreceding, -1)
    placed = manifest.select("path", F.coalesce(F.sum("n_tokens").over(before), F.lit(0)).alias("file_start"))
    return placed.repartition(max(1, min(files, 20_000))).mapInArrow(
        _reader, "doc_id long, start long, n_tokens long, ids binary"
    )
