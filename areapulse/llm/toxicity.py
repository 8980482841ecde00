"""Toxicity by gradient-boosted trees over dense features, with isotonic calibration.

Features are computed from the whole text, one pass over its bytes: densities of insult, threat and profanity words, how
near they stand to a second person, capitals, marks and obfuscation (look-alike characters, spaced letters). Words that
no list holds are learned: a lexicon of fixed size says how much more often a word, or a word with its first letters, is in
toxic texts. The lexicon, the trees and the calibration are fitted on a sample of at most ``max_rows`` labelled rows, the
last two by Spark ML; what a labelled row tells the trees comes from a lexicon of rows of other texts. Every document is scored
in its scan task.

Defined cases: a null text is an empty one, and empty texts have a score like any other; labelled rows without an id or a
label, and labels of ids without a document, teach nothing; repeated labels of an id count once, as toxic if any is; with
labels of fewer than two classes every score is the smoothed share of toxic labels; repeated documents give repeated
rows. Input columns are carried in one struct, so their names cannot clash with results.
"""

from __future__ import annotations

import re
import zlib
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.ml.classification import GBTClassificationModel, GBTClassifier
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.ml.regression import IsotonicRegression
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from areapulse.llm.common import giving_back, joined, mix64, words
from areapulse.session import cut_lineage

# Fixed word lists.
INSULTS = """
idiot idiots idiotic moron morons moronic stupid dumb dumbass fool fools imbecile imbeciles loser losers clown clowns
trash scum scumbag worthless pathetic disgusting garbage filth filthy vermin parasite cretin dimwit halfwit brainless
jerk creep freak pig swine rat coward weakling lowlife nobody ugly vile repulsive despicable
trottel dummkopf vollidiot depp arschloch abschaum versager widerlich dumm erbärmlich
imbécile crétin débile abruti connard connasse salaud minable pourriture dégoûtant stupide
idiota imbécil estúpido estúpida basura escoria inútil patético asqueroso payaso perdedor tonto tonta
""".split()
PROFANITY = "fuck fucking fucker shit shitty bullshit bitch bastard asshole damn crap scheisse scheiße fick merde putain puta mierda cabrón joder".split()
THREATS = "kill die hang shoot stab burn destroy beat hurt punch strangle murder töten sterben tuer crever matar morir".split()
SECOND_PERSON = """
you your yours yourself yourselves u ur du dich dir dein deine deiner ihr euch euer tu te toi ton ta tes vous votre vos
tú ti tus usted ustedes vosotros
""".split()
# Look-alike characters and the letters that they stand for.
LOOK_ALIKE = bytes.maketrans(b"013457@$!*", b"oieastasi*")

LETTERS = np.zeros(256, bool)
LETTERS[0x61:0x7B] = LETTERS[0x80:] = True

_MIXED = re.compile(rb"[a-z@$]*[a-z][013457@$!*]+[a-z@$][a-z013457@$!*]*")
_SPACED = re.compile(rb"(?<![a-z])(?:[a-z][ ._*-]){3,}[a-z](?![a-z])")
_DROP = bytes(range(0x21, 0x30)) + b" _"

FEATURES = (
    "insults profanity threats distinct_insults any_insult near_you you capitals capital_words exclamations questions "
    "marks digits look_alikes hidden_insults spaced_letters long_runs log_words learned_top learned_words learned_sum learned_density"
).split()

#: Counters of the lexicon; two rows of so many.
SLOTS = 1 << 18
#: Bytes of the word beginnings that the lexicon knows besides whole words.
STEMS = (4, 5, 6, 7, 8)
#: Parts of the labelled texts; the lexicon of a part comes from the others.
PARTS = 4
#: A word or beginning in fewer toxic texts teaches nothing.
LEAST_TOXIC = 3
#: A weight of one in the lexicon's bytes.
UNIT = 32


def _hashes(listed: list[str]) -> np.ndarray:
    return np.unique(np.concatenate([words(w.encode(), LETTERS)[2] for w in listed]))


def _among(h: np.ndarray, table: np.ndarray) -> np.ndarray:
    at = np.minimum(np.searchsorted(table, h), len(table) - 1)
    return table[at] == h


def stems(data: np.ndarray, s: np.ndarray, e: np.ndarray, h: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(words, hashes) of the whole words and of their beginnings, capitals of ASCII and Latin-1 lowered."""
    yield np.arange(len(h)), h
    low = np.concatenate([data, np.zeros(max(STEMS), np.uint8)])
    low[(low >= 65) & (low <= 90)] += 32
    latin = np.flatnonzero((low[:-1] == 0xC3) & (low[1:] >= 0x80) & (low[1:] <= 0x9E) & (low[1:] != 0x97)) + 1
    low[latin] += 32
    on, head = np.arange(len(h)), np.zeros(len(h), np.uint64)
    for i in range(max(STEMS)):
        longer = e[on] - s[on] > i
        on, head = on[longer], head[longer]
        head = head | (low[s[on] + i].astype(np.uint64) << np.uint64(8 * i))
        if i + 1 in STEMS:
            yield on, mix64(head + np.uint64(i + 1))


def slots_of(h: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Places of hashes in the two rows of the lexicon."""
    return (h & np.uint64(SLOTS - 1)).astype(np.int64), ((h >> np.uint64(32)) & np.uint64(SLOTS - 1)).astype(np.int64) + SLOTS


def seen_in(texts: list[bytes]) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """Runs of texts: (first text, text of each hash, hash), a word or beginning once per text."""
    for lo, _, text, starts in joined(texts):
        s, e, h = words(text, LETTERS)
        doc = np.searchsorted(starts, s, side="right") - 1
        mark = mix64(np.arange(1, len(starts), dtype=np.uint64))
        once = np.unique(h ^ mark[doc], return_index=True)[1]
        s, e, h, doc = s[once], e[once], h[once], doc[once]
        found = list(stems(np.frombuffer(text, np.uint8), s, e, h))
        of, g = np.concatenate([doc[on] for on, _ in found]), np.concatenate([x for _, x in found])
        once = np.unique(g ^ mark[of], return_index=True)[1]
        yield lo, of[once], g[once]


SEEN = "slot int, part int, n long"


def _seen(wanted: bytes | None) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """Texts per part that hold each of the wanted slots (packed bits; all without them)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts = np.zeros(PARTS * 2 * SLOTS, np.int64)
        keep = None if wanted is None else np.unpackbits(np.frombuffer(zlib.decompress(wanted), np.uint8)).astype(bool)
        for batch in batches:
            part = batch.column("part").to_numpy()
            for lo, of, g in seen_in(batch.column("text").cast(pa.binary()).to_pylist()):
                for at in slots_of(g):
                    own = slice(None) if keep is None else keep[at]
                    np.add.at(counts, part[lo + of[own]] * (2 * SLOTS) + at[own], 1)
        at = np.flatnonzero(counts)
        yield pa.RecordBatch.from_arrays([pa.array(at % (2 * SLOTS), pa.int32()), pa.array(at // (2 * SLOTS), pa.int32()), pa.array(counts[at], pa.int64())], names=["slot", "part", "n"])

    return run


def fit_lexicon(rows: DataFrame) -> np.ndarray:
    """Weights (bytes, ``UNIT`` is one) of the slots: a lexicon per part, made of the other parts, and one of all rows.

    ``rows`` has ``text``, ``part`` and ``label``. A weight is the log of how much more often toxic texts hold the slot, less
    one standard error, and zero below that. The driver gets at most one count per slot, part and label.
    """

    def counted(label: int, wanted: bytes | None) -> DataFrame:
        own = rows.where(F.col("label") == label).select("text", "part")
        return own.mapInArrow(_seen(wanted), SEEN).groupBy("slot", "part").agg(F.sum("n").alias("n"))

    def table(counts: DataFrame) -> np.ndarray:
        got, out = counts.toArrow(), np.zeros((PARTS, 2 * SLOTS))
        out[got["part"].to_numpy(), got["slot"].to_numpy()] = got["n"].to_numpy()
        return out

    held = cut_lineage(counted(1, None), "toxicity-words")
    often = held.groupBy("slot").agg(F.sum("n").alias("all")).where(F.col("all") >= LEAST_TOXIC).select("slot")
    toxic = table(held.join(often, "slot"))
    clean = table(counted(0, zlib.compress(np.packbits(toxic.any(axis=0)).tobytes())))
    sizes = np.zeros((2, PARTS))
    for r in rows.groupBy("label", "part").agg(F.count(F.lit(1)).alias("n")).collect():
        sizes[int(r["label"]), r["part"]] = r["n"]
    out = np.zeros((PARTS + 1, 2 * SLOTS), np.uint8)
    for part in range(PARTS + 1):
        others = np.arange(PARTS) != part
        p, q, (n_clean, n_toxic) = toxic[others].sum(axis=0), clean[others].sum(axis=0), sizes[:, others].sum(axis=1)
        weight = np.log((p + 0.5) / (n_toxic + 1)) - np.log((q + 0.5) / (n_clean + 1)) - np.sqrt(1 / (p + 0.5) + 1 / (q + 0.5))
        out[part] = np.where(p >= LEAST_TOXIC, np.clip(weight * UNIT, 0, 255), 0)
    return out


class Features:
    """Feature rows of whole texts."""

    def __init__(self, lexicon: np.ndarray | None = None) -> None:
        self.lexicon = np.zeros(2 * SLOTS, np.uint8) if lexicon is None else lexicon
        self.insults, self.profanity = _hashes(INSULTS), _hashes(PROFANITY)
        self.threats, self.you = _hashes(THREATS), _hashes(SECOND_PERSON)
        self.spelled = {w.encode() for w in (*INSULTS, *PROFANITY)}

    def of(self, texts: list[bytes | None]) -> np.ndarray:
        return np.concatenate([self._run(text, starts) for _, _, text, starts in joined(texts)] or [np.zeros((0, len(FEATURES)))])

    def _hidden(self, text: bytes) -> tuple[int, int, int]:
        """Words with look-alike characters, insults among them, and words of spaced letters."""
        mixed = _MIXED.findall(text)
        hidden = sum(w.translate(LOOK_ALIKE, b"*").strip(b"!") in self.spelled for w in mixed)
        spaced = [w.translate(None, _DROP) for w in _SPACED.findall(text)]
        return len(mixed), hidden + sum(w in self.spelled for w in spaced), len(spaced)

    def _run(self, text: bytes, starts: np.ndarray) -> np.ndarray:
        n = len(starts) - 1
        s, e, h = words(text, LETTERS)
        doc = np.searchsorted(starts, s, side="right") - 1
        data = np.frombuffer(text, np.uint8)

        def per_doc(mask: np.ndarray) -> np.ndarray:
            """Marked words of each document."""
            return np.bincount(doc[mask], minlength=n).astype(float)

        def bytes_in(mask: np.ndarray) -> np.ndarray:
            """Marked bytes of each document."""
            total = np.concatenate([[0], np.cumsum(mask)])
            return (total[starts[1:]] - total[starts[:-1]]).astype(float)

        rude, foul, threat, you = (_among(h, t) for t in (self.insults, self.profanity, self.threats, self.you))
        count = per_doc(np.ones(len(h), bool))
        hits = np.flatnonzero(rude | foul)
        near = np.zeros(n)
        at = np.flatnonzero(you)
        if len(hits) and len(at):
            right = np.searchsorted(at, hits)
            for k in (np.maximum(right - 1, 0), np.minimum(right, len(at) - 1)):
                close = np.where(doc[at[k]] == doc[hits], 1.0 / (1.0 + np.abs(at[k] - hits)), 0.0)
                np.maximum.at(near, doc[hits], close)
        kinds = np.zeros(n)
        found = np.flatnonzero(rude)
        if len(found):
            pairs = np.unique(np.stack([doc[found].astype(np.uint64), h[found]]), axis=1)[0]
            kinds += np.bincount(pairs.astype(np.int64), minlength=n)
        learned = np.zeros(len(h), np.uint8)
        for on, g in stems(data, s, e, h):
            low_slot, high_slot = slots_of(g)
            learned[on] = np.maximum(learned[on], np.minimum(self.lexicon[low_slot], self.lexicon[high_slot]))
        found = np.flatnonzero(learned)
        weight, of = learned[found] / UNIT, doc[found]
        once = np.unique(h[found] ^ mix64(of.astype(np.uint64)), return_index=True)[1]
        top = np.zeros(n)
        np.maximum.at(top, of, weight)
        learned_words = np.bincount(of[once][weight[once] >= 1], minlength=n).astype(float)
        learned_sum = np.bincount(of[once], weights=weight[once], minlength=n)
        learned_all = np.bincount(of, weights=weight, minlength=n)
        upper = (data >= 65) & (data <= 90)
        letters = upper | LETTERS[data]
        total_upper = np.concatenate([[0], np.cumsum(upper)])
        capital = (total_upper[e] - total_upper[s] == e - s) & (e - s > 1)
        # A run of three equal bytes.
        runs = np.zeros(len(data), bool)
        if len(data) > 2:
            runs[2:] = (data[2:] == data[1:-1]) & (data[1:-1] == data[:-2]) & letters[2:]
        low = text.lower()
        hidden = np.array([self._hidden(low[a:b]) for a, b in zip(starts[:-1], starts[1:])], float).reshape(n, 3)
        marks = (data > 32) & (data < 127) & ~letters & ~((data >= 48) & (data <= 57))
        per = 100.0 / np.maximum(count, 1)
        size = np.maximum(starts[1:] - starts[:-1] - 1, 1)
        return np.column_stack(
            [
                per_doc(rude) * per,
                per_doc(foul) * per,
                per_doc(threat) * per,
                kinds,
                (kinds + hidden[:, 1] > 0).astype(float),
                near,
                per_doc(you) * per,
                bytes_in(upper) / np.maximum(bytes_in(letters), 1),
                per_doc(capital) * per,
                bytes_in(data == 33) * per,
                bytes_in(data == 63) * per,
                bytes_in(marks) / size,
                bytes_in((data >= 48) & (data <= 57)) / size,
                hidden[:, 0] * per,
                hidden[:, 1],
                hidden[:, 2] * per,
                bytes_in(runs) / size,
                np.log1p(count),
                top,
                learned_words,
                learned_sum,
                learned_all * per,
            ]
        )


def features(lexicons: np.ndarray) -> Callable[[Column, Column], Column]:
    """Features of a text by one of the lexicons. Only these two go through Python; other columns of the row stay in the JVM."""
    packed = zlib.compress(lexicons.tobytes(), 1)

    @giving_back
    def rows(batches: Iterator[tuple[pa.Array, pa.Array]]) -> Iterator[pa.Array]:
        makers = [Features(x) for x in np.frombuffer(zlib.decompress(packed), np.uint8).reshape(-1, 2 * SLOTS)]
        for batch, part in batches:
            # Slices keep the working memory of a batch of long texts small.
            flat = np.zeros((len(batch), len(FEATURES)))
            which = part.to_numpy(zero_copy_only=False)
            for at in range(0, len(batch), 250):
                texts, own = batch.slice(at, 250).cast(pa.binary()).to_pylist(), which[at : at + 250]
                for k in np.unique(own).tolist():
                    on = np.flatnonzero(own == k)
                    flat[at + on] = makers[k].of([texts[i] for i in on])
            ends = pa.array(np.arange(len(flat) + 1) * len(FEATURES), pa.int32())
            yield pa.ListArray.from_arrays(ends, pa.array(flat.ravel(), pa.float64()))

    @F.arrow_udf(T.ArrayType(T.DoubleType()))
    def made(batches: Iterator[tuple[pa.Array, pa.Array]]) -> Iterator[pa.Array]:
        yield from rows(batches)

    return made


def with_features(docs: DataFrame, keep: list[str], text: str = "text", lexicons: np.ndarray | None = None, part: Column | None = None) -> DataFrame:
    """``doc`` (struct of ``keep``) and ``x`` (array of the features); ``part`` says which of the lexicons, the last by default."""
    doc = F.struct(*[F.col(f"`{c}`") for c in keep]).alias("doc")
    known = np.zeros((1, 2 * SLOTS), np.uint8) if lexicons is None else lexicons if part is not None else lexicons[-1:]
    return docs.select(doc, features(known)(F.coalesce(F.col(text), F.lit("")), F.lit(0) if part is None else part).alias("x"))


def fold(doc_id: str, folds: int = 4) -> Column:
    """crc32 of the id as text, modulo ``folds``; null for a null id."""
    return F.crc32(F.col(doc_id).cast("string").cast("binary")) % folds


@dataclass
class ToxicityModel:
    """Trees with the steps of their calibration and the lexicon of their texts, or a constant."""

    trees: GBTClassificationModel | None
    borders: list[float]
    values: list[float]
    lexicons: np.ndarray | None = None

    def score(self, docs: DataFrame, keep: list[str], text: str = "text") -> DataFrame:
        """``doc`` and ``score`` (0 to 1) of every row."""
        rows = with_features(docs, keep, text, self.lexicons)
        if self.trees is None:
            return rows.select("doc", F.lit(self.values[0]).alias("score"))
        raw = self.trees.transform(rows.select("doc", array_to_vector("x").alias("features")))
        p = vector_to_array("probability")[1]
        return raw.select("doc", p.alias("p")).select("doc", self._calibrated(F.col("p")).alias("score"))

    def _calibrated(self, p: Column) -> Column:
        """Linear between the borders, constant outside."""
        b, v = self.borders, self.values
        out = F.lit(v[-1])
        for i in range(len(b) - 1, 0, -1):
            wide = b[i] - b[i - 1]
            inner = F.lit(v[i - 1]) + (p - b[i - 1]) * ((v[i] - v[i - 1]) / wide if wide else 0.0)
            out = F.when(p < b[i], inner).otherwise(out)
        return F.when(p <= b[0], F.lit(v[0])).otherwise(out).cast("double")


def fit_toxicity(
    docs: DataFrame, labels: DataFrame, max_rows: int = 20_000, trees: int = 20, depth: int = 3, doc_id: str = "doc_id", text: str = "text"
) -> ToxicityModel:
    """Fit on at most ``max_rows`` labelled rows, taken by the hash of their id; ``labels`` has doc_id and toxic."""
    known = labels.select("doc_id", "toxic").dropna().groupBy("doc_id").agg(F.max((F.col("toxic") > 0).cast("double")).alias("label"))
    # At most max_rows rows of two numbers: small enough to be sent to every task.
    taken = known.orderBy(F.xxhash64("doc_id"), "doc_id").limit(max_rows)
    rows = docs.select(F.col(doc_id).alias("doc_id"), F.coalesce(F.col(text), F.lit("")).alias("text")).join(F.broadcast(taken), "doc_id")
    # Copies share a part, so that no text is in the lexicon of its own part.
    rows = rows.withColumn("part", F.pmod(F.xxhash64(F.lit("part"), "text"), F.lit(PARTS)).cast("int"))
    rows = cut_lineage(rows, "toxicity-texts")
    n, toxic = rows.agg(F.count(F.lit(1)), F.sum("label")).first()
    if not n or toxic in (0, n):
        return ToxicityModel(None, [], [((toxic or 0) + 1) / (n + 2)])
    lexicons = fit_lexicon(rows)
    made = with_features(rows, ["doc_id", "label"], "text", lexicons, F.col("part")).select("doc.doc_id", "doc.label", "x")
    made = cut_lineage(made, "toxicity-training")
    # Fixed partitions and order, so that the fit does not depend on the cluster.
    ready = made.select("doc_id", "label", array_to_vector("x").alias("features")).repartitionByRange(4, "doc_id").sortWithinPartitions("doc_id")
    grower = GBTClassifier(maxIter=trees, maxDepth=depth, stepSize=0.2, maxBins=32, minInstancesPerNode=5, seed=7)
    # Four fifths grow the trees; the other fifth, which they have not seen, calibrates them.
    apart = F.pmod(F.xxhash64(F.lit("calibrate"), "doc_id"), F.lit(5)) == 0
    grown, rest = ready.where(~apart), ready.where(apart)
    if any(part.select("label").distinct().count() < 2 for part in (grown, rest)):
        grown = rest = ready
    model = grower.fit(grown)
    scored = model.transform(rest).select("label", vector_to_array("probability")[1].alias("p"))
    steps = IsotonicRegression(featuresCol="p", labelCol="label").fit(scored)
    return ToxicityModel(model, [float(x) for x in steps.boundaries], [min(1.0, max(0.0, float(x))) for x in steps.predictions], lexicons)
