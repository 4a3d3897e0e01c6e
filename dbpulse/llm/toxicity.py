"""Toxicity by FTRL-proximal logistic regression over hashed word n-grams and skip-grams.

Features of a text are its lower-cased words (trimmed of ASCII punctuation), word pairs,
pairs with one word left out between them, and the words' first ``PREFIX`` bytes, hashed
into 2**bits slots; each slot counts once for a text. FTRL-proximal keeps a rate for every
slot and an L1 penalty keeps most weights at exactly zero, so the model is a few hundred
(slot, weight) pairs, sent to every executor. Scoring hashes whole texts with numpy.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType

from .common import cut_lineage, set_aside

BITS = 20
PREFIX = 4
SAMPLE_ROWS = 8_000
SAMPLE_SLOTS = 32_000_000
ADDED = ("score", "__text")
WORDS_AT_ONCE = 1 << 17

_P = np.uint64(0x9E3779B97F4A7C15)
_LOWER = np.frombuffer(bytes(range(256)).lower(), np.uint8)
_SPACES = [bytes([b]) for b in (0x20, *range(0x09, 0x0E))]
_SPACE = np.zeros(256, bool)
_SPACE[[s[0] for s in _SPACES]] = True
#: bytes that never count as part of a word when they stand at its edge or inside it
_MARK = np.zeros(256, bool)
_MARK[[b for b in range(0x21, 0x7F) if not chr(b).isalnum()]] = True
_VALUE = (np.arange(1, 257, dtype=np.uint64) * np.uint64(0xD6E8FEB86659FD93)) ^ (np.arange(1, 257, dtype=np.uint64) << np.uint64(40))


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(31))) * np.uint64(0x7FB5D329728EA185)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x81DADEF4BC2DD44D)
    return x ^ (x >> np.uint64(33))


def _powers(n: int) -> np.ndarray:
    with np.errstate(over="ignore"):
        return np.cumprod(np.full(n, _P | np.uint64(1), np.uint64), dtype=np.uint64)


_POWER = _powers(4096)


def _distinct(x: np.ndarray) -> np.ndarray:
    x = np.sort(x)
    return x[np.concatenate(([True], x[1:] != x[:-1]))] if len(x) else x


def _cut(text: bytes, at: int, to: int) -> int:
    """Where the piece from ``at`` ends: after its last white space before ``to``, else after the next one, so that no word is cut."""
    if to >= len(text):
        return len(text)
    last = max(text.rfind(s, at, to) for s in _SPACES)
    if last >= 0:
        return last + 1
    return min((k for s in _SPACES if (k := text.find(s, to)) >= 0), default=len(text) - 1) + 1


def slots(text: bytes, bits: int = BITS) -> np.ndarray:
    """The distinct slots of one text (sorted); works through long texts in pieces."""
    out: list[np.ndarray] = []
    shift = np.uint64(64 - bits)
    tail = np.zeros(0, np.uint64)  # hashes of the two words before the piece
    at, step = 0, WORDS_AT_ONCE * 8
    while at < len(text):
        to = _cut(text, at, at + step)
        data = np.frombuffer(text, np.uint8, to - at, at)
        at = to
        solid = ~_SPACE[data]
        begin = np.flatnonzero(solid & ~np.concatenate(([False], solid[:-1])))
        if not len(begin):
            continue
        end = np.flatnonzero(solid & ~np.concatenate((solid[1:], [False]))) + 1
        place = np.arange(len(data)) - np.repeat(np.concatenate(([0], begin)), np.diff(np.concatenate(([0], begin, [len(data)]))))
        letter = solid & ~_MARK[data]
        value = np.where(letter, _VALUE[_LOWER[data]], np.uint64(0))
        with np.errstate(over="ignore"):
            value = value * _POWER[place & 4095]
            total = np.concatenate((np.zeros(1, np.uint64), np.cumsum(value, dtype=np.uint64)))
            word = _mix(total[end] - total[begin])
            start = _mix((total[np.minimum(end, begin + PREFIX)] - total[begin]) ^ np.uint64(0x5DEECE66D))
            chain = np.concatenate((tail, word))
            pair = _mix(chain[:-1] * np.uint64(3) + chain[1:] * np.uint64(5) + np.uint64(1)) if len(chain) > 1 else chain[:0]
            skip = _mix(chain[:-2] * np.uint64(7) + chain[2:] * np.uint64(11) + np.uint64(2)) if len(chain) > 2 else chain[:0]
        tail = chain[-2:]
        out.append(_distinct(np.concatenate((word, start, pair, skip)) >> shift))
    return _distinct(np.concatenate(out)).astype(np.int64) if out else np.zeros(0, np.int64)


@dataclass
class Model:
    """Non-zero weights by slot, and the bias."""

    index: np.ndarray
    weight: np.ndarray
    bias: float
    bits: int

    def dense(self) -> np.ndarray:
        full = np.zeros(1 << self.bits, np.float64)
        full[self.index] = self.weight
        return full


def ftrl(
    rows: list[np.ndarray], labels: np.ndarray, bits: int = BITS, alpha: float = 2.0, beta: float = 1.0, l1: float = 4.0, l2: float = 1.0, passes: int = 6
) -> Model:
    """Follow-the-regularised-leader with per-coordinate rates, in the given order of rows."""
    z, n = np.zeros(1 << bits), np.zeros(1 << bits)
    zb = nb = 0.0

    def weights(zi, ni, l1, l2):
        return np.where(np.abs(zi) <= l1, 0.0, -(zi - np.sign(zi) * l1) / ((beta + np.sqrt(ni)) / alpha + l2))

    for _ in range(passes):
        for slot, y in zip(rows, labels.tolist()):
            w = weights(z[slot], n[slot], l1, l2)
            b = float(weights(np.float64(zb), np.float64(nb), 0.0, 0.0))
            p = 1.0 / (1.0 + np.exp(-np.clip(w.sum() + b, -35, 35)))
            g = p - y
            s = (np.sqrt(n[slot] + g * g) - np.sqrt(n[slot])) / alpha
            z[slot] += g - s * w
            n[slot] += g * g
            zb += g - (np.sqrt(nb + g * g) - np.sqrt(nb)) / alpha * b
            nb += g * g
    w = weights(z, n, l1, l2)
    index = np.flatnonzero(w)
    return Model(index, w[index], float(weights(np.float64(zb), np.float64(nb), 0.0, 0.0)), bits)


def sampled_labels(labels: DataFrame, sample_rows: int) -> DataFrame:
    """At most ``sample_rows`` of ``labels(doc_id, label)``: the ids least by hash.

    Which rows these are does not depend on how they are stored. Null ids and labels are
    left out; an id with several labels has the largest.
    """
    known = labels.filter("label is not null and doc_id is not null").groupBy("doc_id").agg(F.max(F.col("label").cast("int")).alias("label"))
    return known.orderBy(F.xxhash64("doc_id"), "doc_id").limit(sample_rows)


def fit(docs: DataFrame, labels: DataFrame, sample_rows: int = SAMPLE_ROWS, bits: int = BITS, sample_slots: int = SAMPLE_SLOTS) -> Model:
    """``docs(doc_id, text)`` and ``labels(doc_id, label)`` -> model, from a bounded sample.

    At most ``sample_rows`` labelled documents with ``sample_slots`` slots (of 4 bytes) in
    all go to the driver, least hash of the id first. Rows that repeat an id count once, by
    the text of least slots. Without any row, or with one class only, the model says that
    class's share everywhere (0.5 without rows). Null texts count as empty; an empty table
    gives 0.5 everywhere. Other columns are ignored.
    """
    chosen = docs.select("doc_id", F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text")).join(
        F.broadcast(sampled_labels(labels, sample_rows)), "doc_id"  # at most sample_rows small rows
    )

    def features(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [slots(t.as_py().encode("utf-8", "surrogatepass"), bits).astype(np.int32).tobytes() for t in batch.column(1)]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(found, pa.binary()), batch.column(2)], ["doc_id", "slots", "label"])

    order = lambda r: ((r[0] * 0x9E3779B97F4A7C15) % (1 << 64), r[1], r[2])
    found = chosen.select("doc_id", "text", "label").mapInArrow(features, "doc_id long, slots binary, label int")
    once = cut_lineage(found.groupBy("doc_id").agg(F.min("slots").alias("slots"), F.max("label").alias("label")))
    sizes = once.select(F.xxhash64("doc_id").alias("h"), (F.octet_length("slots") / 4).alias("n")).orderBy("h").collect()  # sample_rows pairs of numbers
    total, last = 0, None
    for h, n in sizes:
        total += n
        if total > sample_slots:
            break
        last = h
    bounded = once.filter(F.xxhash64("doc_id") <= last) if last is not None else once.limit(0)
    got = sorted(bounded.collect(), key=order)
    truth = np.array([r[2] for r in got], np.float64)
    if not len(truth) or truth.min() == truth.max():
        share = min(max(truth.mean() if len(truth) else 0.5, 1e-6), 1 - 1e-6)
        return Model(np.zeros(0, np.int64), np.zeros(0), float(np.log(share / (1 - share))), bits)
    return ftrl([np.frombuffer(r[1], np.int32) for r in got], truth, bits)


def score(docs: DataFrame, model: Model) -> DataFrame:
    """``docs`` with a column ``score`` in [0, 1]; a null or empty text gets the bias alone.

    Every row comes back, repeated ones as often, with all its columns; a column of that
    name is called ``score_given`` in the result.
    """
    docs = set_aside(docs, *ADDED)
    # at most 2**bits weights, as plain arrays: executors need no copy of this package
    sent = docs.sparkSession.sparkContext.broadcast((model.index, model.weight, model.bias, model.bits))

    def run(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        bias, bits = sent.value[2:]
        weight = Model(*sent.value).dense()
        for batch in batches:
            total = np.array([weight[slots((t.as_py() or "").encode("utf-8", "surrogatepass"), bits)].sum() + bias for t in batch], np.float64)
            yield pa.array(1.0 / (1.0 + np.exp(-np.clip(total, -35, 35))), pa.float64())

    # only texts go to Python and only scores come back: the rows wait in Spark, which may spill them
    return docs.withColumn("score", F.arrow_udf(run, DoubleType())(F.col("text").cast("string")))
