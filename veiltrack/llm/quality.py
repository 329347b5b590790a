"""Quality of texts by logistic regression over hashed word n-grams, trained with follow-the-regularised-leader updates.

A text's tokens are its words (letters, digits and bytes above ASCII) and its
runs of other signs.  Its features are runs of one to ``order`` tokens, as they
are and with every word's shape in place of the word (so that a sign after a
word counts whatever the word), and which of the last tokens a token repeats.
Each is hashed into one of 2 ** ``bits`` buckets; a bucket's value is one plus
the logarithm of its count, and values are scaled to unit length.  A score is
one sparse dot product with the weights, through the logistic function.

Weights come from per-coordinate follow-the-regularised-leader updates (with
L1 and L2 terms), in several passes over a bounded sample in one task: about
``sample_docs`` distinct labelled (doc_id, text, label), by a hash, of those
with texts of at most ``sample_bytes`` bytes.  Those two are the only bounds;
whole texts of any length are scored, all by the same weights.

Defined results: null text is empty and scores by the intercept alone, as an
empty one; rows whose label is neither 0 nor 1 (or null), or without doc_id,
aren't learned from; a doc_id with both labels is learned from with each; rows
that repeat are learned from once and scored one by one; with nothing to learn
from every score is 0.5; an empty table gives no rows; other columns of either
table are ignored, or passed on by ``keep``, whatever their names.
"""

from __future__ import annotations

from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .kneser_ney import remainder
from .tokens import mix, slices, words

BITS, ORDER = 18, 2
SAMPLE_DOCS, SAMPLE_BYTES = 6000, 16_384
PASSES = 10
#: Step, its damping, and the L1 and L2 terms of an update.
ALPHA, BETA, L1, L2 = 1.0, 1.0, 0.02, 0.1
#: Tokens back that a token is compared with.
BACK = 8
#: A score from which a text is predicted to be of quality.
LEAST = 0.3

_U = np.uint64
_WORD = np.zeros(256, bool)
_WORD[[*range(48, 58), *range(65, 91), *range(97, 123), *range(128, 256)]] = True
_SIGN = ~_WORD
_SIGN[[0x20, *range(0x09, 0x0E)]] = False


class Model(NamedTuple):
    """Weights of the buckets, of which the last one is the intercept's."""

    weights: np.ndarray
    order: int

    @property
    def bits(self) -> int:
        return (len(self.weights) - 1).bit_length() - 1


def _shapes(data: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """What a word looks like: how it begins, whether it goes on in capitals, and its length up to 15."""
    first, second = data[start], data[np.minimum(start + 1, end - 1)]
    kind = lambda b: np.where(b >= 97, 0, np.where(b >= 65, 1, 2))
    return (kind(first) * 48 + kind(second) * 16 + np.minimum(end - start, 15)).astype(np.uint64)


def features(texts: pa.Array, bits: int = BITS, order: int = ORDER) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Buckets and values of all texts, one text after the other, and the n + 1 offsets of the texts."""
    own, signs = words(texts, _WORD), words(texts, _SIGN)
    at = np.concatenate((own.start, signs.start))
    turn = np.argsort(at, kind="stable")
    token = np.concatenate((mix(own.hash + _U(1)), mix(signs.hash + _U(2))))[turn]
    shape = np.concatenate((mix(_shapes(own.data, own.start, own.end) + _U(1 << 40)), mix(signs.hash + _U(2))))[turn]
    doc = np.concatenate((own.doc, signs.doc))[turn]
    made, docs = [token, mix(shape + _U(3))], [doc, doc]
    run, shaped = token, shape
    for n in range(2, order + 1):
        run, shaped = mix(run[:-1] * _U(0x9E3779B97F4A7C15) + token[n - 1 :]), mix(shaped[:-1] * _U(0xC2B2AE3D27D4EB4F) + shape[n - 1 :])
        inside = doc[n - 1 :] == doc[: len(doc) - n + 1]
        made += [run[inside], mix(shaped[inside] + _U(5))]
        docs += [doc[n - 1 :][inside]] * 2
    for back in range(1, BACK + 1):
        again = (token[back:] == token[:-back]) & (doc[back:] == doc[:-back])
        docs.append(doc[back:][again])
        made.append(np.full(len(docs[-1]), mix(np.array([1000 + back], np.uint64))[0]))
    key = (np.concatenate(docs).astype(np.uint64) << _U(bits)) | (np.concatenate(made) >> _U(64 - bits))
    key, count = np.unique(key, return_counts=True)
    of = (key >> _U(bits)).astype(np.int64)
    value = 1.0 + np.log(count)
    norm = np.sqrt(np.bincount(of, value * value, minlength=len(texts)))
    first = np.searchsorted(of, np.arange(len(texts) + 1))
    return (key & _U((1 << bits) - 1)).astype(np.int32), (value / norm[of]).astype(np.float32), first


def _logistic(x: np.ndarray) -> np.ndarray:
    return 1.0 / (1.0 + np.exp(-np.clip(x, -30.0, 30.0)))


class Leader:
    """Follow-the-regularised-leader state: a coordinate's gradients, corrected, and their squares."""

    def __init__(self, size: int, alpha: float = ALPHA, beta: float = BETA, l1: float = L1, l2: float = L2):
        self.z, self.n = np.zeros(size), np.zeros(size)
        self.alpha, self.beta, self.l1, self.l2 = alpha, beta, l1, l2

    def weights(self, at) -> np.ndarray:
        z, root = self.z[at], np.sqrt(self.n[at])
        return np.where(np.abs(z) <= self.l1, 0.0, (np.sign(z) * self.l1 - z) / ((self.beta + root) / self.alpha + self.l2))

    def learn(self, at: np.ndarray, x: np.ndarray, label: int) -> float:
        """One update from a text's distinct coordinates; gives the probability before it."""
        w = self.weights(at)
        p = float(_logistic(w @ x))
        g = (p - label) * x
        n = self.n[at]
        self.z[at] += g - (np.sqrt(n + g * g) - np.sqrt(n)) / self.alpha * w
        self.n[at] = n + g * g
        return p


def sample(docs: DataFrame, labels: DataFrame, label: str = "quality", sample_docs: int = SAMPLE_DOCS, sample_bytes: int = SAMPLE_BYTES) -> DataFrame:
    """draw, label, text: about sample_docs distinct labelled texts."""
    known = labels.select("doc_id", F.col(label).cast("int").alias("label")).filter(F.col("label").isin(0, 1) & F.col("doc_id").isNotNull()).distinct()
    short = docs.select("doc_id", "text").filter(F.col("doc_id").isNotNull() & (F.coalesce(F.octet_length("text"), F.lit(0)) <= sample_bytes)).withColumn("draw", F.xxhash64(F.col("doc_id").cast("string"), "text"))
    n = short.select("doc_id", "draw").join(known, "doc_id").agg(F.approx_count_distinct(F.struct("doc_id", "draw", "label"))).first()[0]
    drawn = short.filter(F.shiftrightunsigned("draw", 11) / F.lit(float(1 << 53)) < F.lit(sample_docs / max(n, 1)))
    return drawn.join(known, "doc_id").select("draw", "label", "text").dropDuplicates(["draw", "label"])


def fit(drawn: DataFrame, bits: int = BITS, order: int = ORDER, passes: int = PASSES) -> Model:
    """Weights from draw, label and text: features are made where the texts are, updates in one task, which sends the weights alone to the driver."""

    def featured(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i, j in slices(batch.column(2)):
                at, x, first = features(batch.column(2).slice(i, j - i), bits, order)
                rows = list(zip(first[:-1], first[1:]))
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(i, j - i), batch.column(1).slice(i, j - i), pa.array([at[a:b].tobytes() for a, b in rows], pa.binary()), pa.array([x[a:b].tobytes() for a, b in rows], pa.binary())], names=["draw", "label", "at", "x"])

    def learn(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows = []
        for batch in batches:
            for draw, label, at, x in zip(*(batch.column(c).to_pylist() for c in range(4))):
                # the intercept is a coordinate that every text has
                rows.append((mix(np.array([draw & (1 << 64) - 1], np.uint64))[0], label, np.append(np.frombuffer(at, np.int32), np.int32(1 << bits)), np.append(np.frombuffer(x, np.float32), np.float32(1))))
        rows.sort(key=lambda r: (r[0], r[1]))
        leader = Leader((1 << bits) + 1)
        for _ in range(passes):
            for _, label, at, x in rows:
                leader.learn(at, x, label)
        yield pa.RecordBatch.from_arrays([pa.array([leader.weights(slice(None)).astype(np.float32).tobytes()], pa.binary())], names=["weights"])

    made = drawn.mapInArrow(featured, "draw long, label int, at binary, x binary")
    rows = made.repartition(1).mapInArrow(learn, "weights binary").collect()  # one row of a fixed size
    return Model(np.frombuffer(rows[0][0], np.float32) if rows else np.zeros((1 << bits) + 1, np.float32), order)


def score_texts(texts: pa.Array, model: Model) -> np.ndarray:
    """Scores of texts; a text's score does not depend on the others."""
    at, x, first = features(texts, model.bits, model.order)
    total = np.zeros(len(at) + 1)
    product = model.weights[at].astype(np.float64) * x
    dot = np.array([product[a:b].sum() for a, b in zip(first[:-1], first[1:])]) if len(first) > 1 else total[:0]
    return _logistic(dot + float(model.weights[-1]))


def score_quality(docs: DataFrame, model: Model, keep: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """The columns ``keep`` of every row of docs, with score."""
    spark = docs.sparkSession
    shared = spark.sparkContext.broadcast(model)  # of a fixed size, whatever the input
    fields = ", ".join(f"`__keep{i}` {docs.schema[c].dataType.simpleString()}" for i, c in enumerate(keep))
    rows = docs.select(*(F.col(c).alias(f"__keep{i}") for i, c in enumerate(keep)), F.col("text").alias("__text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = shared.value
        for batch in batches:
            texts = batch.column(len(keep))
            for i, j in slices(texts):
                yield pa.RecordBatch.from_arrays([*(batch.column(c).slice(i, j - i) for c in range(len(keep))), pa.array(score_texts(texts.slice(i, j - i), own))], names=[*(f"__keep{c}" for c in range(len(keep))), "__score"])

    scored = rows.mapInArrow(run, f"{fields}, `__score` double")
    return scored.select(*(F.col(f"__keep{i}").alias(c) for i, c in enumerate(keep) if c != "score"), F.col("__score").alias("score"))


def score_held_out(docs: DataFrame, labels: DataFrame, of: int = 5, held: int = 0) -> DataFrame:
    """doc_id, held_out, score, predicted of every row, by a model of the rows whose crc32 of doc_id has another remainder than ``held``."""
    docs = docs.select("doc_id", "text")
    model = fit(sample(docs, labels.filter(remainder(F.col("doc_id"), of) != held)))
    return score_quality(docs, model).select("doc_id", (remainder(F.col("doc_id"), of) == held).alias("held_out"), "score", (F.col("score") >= LEAST).cast("int").alias("predicted"))
