"""Quality classifier: histogram gradient-boosted trees over document statistics.

The trees are grown on a bounded sample of labelled rows: features are cut into quantile
bins once, each split is chosen from per-bin sums of gradients. The finished trees are
flattened into arrays (feature, threshold, children, value), so a batch of documents goes
down all trees with a few numpy look-ups for each level.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass
from operator import eq

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, StructType

from .common import set_aside
from .toxicity import sampled_labels

SAMPLE_ROWS = 12_000
PIECE_WORDS = 40

_CLASSES = {
    "upper": [*range(65, 91)], "lower": [*range(97, 123)], "digit": [*range(48, 58)], "space": [32], "line": [10, 13], "bang": [33],
    "bar": [124], "symbol": [35, 36, 37, 38, 42, 64, 94, 126], "stop": [46, 63], "comma": [44, 58, 59], "wide": [*range(128, 256)],
    "bracket": [40, 41, 60, 62, 91, 93, 123, 125], "rest": [34, 39, 43, 45, 47, 61, 92, 95],
}
_TABLE = np.zeros((256, len(_CLASSES)))
for _i, _bytes in enumerate(_CLASSES.values()):
    _TABLE[_bytes, _i] = 1
FEATURES = [
    "log_bytes", "log_words", *(f"{c}_share" for c in _CLASSES), "word_bytes", "distinct_words", "top_word", "repeats", "distinct_lines", "line_bytes",
    "worst_upper", "worst_marks", "worst_repeats", "worst_distinct", "marked_pieces", "long_words", "short_words", "spread_word_bytes",
]


def statistics(text: bytes) -> list[float]:
    """The features of one whole text, in the order of ``FEATURES``; all zero but the logs if it is empty."""
    n = len(text)
    words = text.split()
    if not words:
        return [float(np.log1p(n)), 0.0] + [0.0] * (len(FEATURES) - 2)
    shares = np.bincount(np.frombuffer(text, np.uint8), minlength=256) @ _TABLE / n
    counts = Counter(words)
    sizes = np.fromiter(map(len, words), np.int32, len(words))
    same = np.fromiter(map(eq, words, words[1:]), np.int8, len(words) - 1) if len(words) > 1 else np.zeros(0, np.int8)
    lines = text.split(b"\n")
    # the worst of the pieces of a text that is only partly bad
    ends = np.cumsum(sizes + 1)
    cut = np.arange(0, len(words), PIECE_WORDS)
    data = np.frombuffer(b" ".join(words), np.uint8)
    starts = np.concatenate(([0], ends))[cut].astype(np.int64)
    width = np.diff(np.concatenate((starts, [len(data)])))
    upper = np.add.reduceat((data >= 65) & (data <= 90), starts, dtype=np.int64) / width
    marks = np.add.reduceat(_TABLE[:, [5, 6, 7]].sum(axis=1)[data], starts) / width
    repeats = np.add.reduceat(np.concatenate(([0], same)), cut) / PIECE_WORDS
    distinct = min(len(set(words[c : c + PIECE_WORDS])) / len(words[c : c + PIECE_WORDS]) for c in cut.tolist())
    return [
        float(np.log1p(n)), float(np.log1p(len(words))), *shares.tolist(), float(sizes.mean()), len(counts) / len(words), max(counts.values()) / len(words),
        float(same.mean()) if len(same) else 0.0, len(set(lines)) / len(lines), n / len(lines),
        float(upper.max()), float(marks.max()), float(repeats.max()), distinct, float((marks > 0.05).mean()), float((sizes > 15).mean()),
        float((sizes < 3).mean()), float(sizes.std()),
    ]


@dataclass
class Trees:
    """All trees in flat arrays; a leaf points to itself, so every row takes ``depth`` steps."""

    feature: np.ndarray
    threshold: np.ndarray
    left: np.ndarray
    right: np.ndarray
    value: np.ndarray
    roots: np.ndarray
    depth: int
    bias: float

    def predict(self, x: np.ndarray) -> np.ndarray:
        total = np.full(len(x), self.bias)
        rows = np.arange(len(x))
        for root in self.roots.tolist():
            node = np.full(len(x), root)
            for _ in range(self.depth):
                low = x[rows, self.feature[node]] <= self.threshold[node]
                node = np.where(low, self.left[node], self.right[node])
            total += self.value[node]
        return 1.0 / (1.0 + np.exp(-np.clip(total, -35, 35)))


def grow(x: np.ndarray, y: np.ndarray, trees: int = 80, depth: int = 4, rate: float = 0.15, bins: int = 64, least: float = 5.0, l2: float = 1.0) -> Trees:
    """Logistic boosting with second-order leaf values, on quantile histograms."""
    cuts = [np.unique(np.quantile(x[:, f], np.linspace(0, 1, bins + 1)[1:-1])) for f in range(x.shape[1])]
    binned = np.stack([np.searchsorted(c, x[:, f], side="left") for f, c in enumerate(cuts)], axis=1)
    share = min(max(float(y.mean()), 1e-6), 1 - 1e-6)
    bias = float(np.log(share / (1 - share)))
    total = np.full(len(y), bias)
    flat: dict[str, list] = {k: [] for k in ("feature", "threshold", "left", "right", "value")}
    roots = []

    def leaf(value: float) -> int:
        at = len(flat["value"])
        for k, v in (("feature", 0), ("threshold", 0.0), ("left", at), ("right", at), ("value", value)):
            flat[k].append(v)
        return at

    for _ in range(trees):
        p = 1.0 / (1.0 + np.exp(-total))
        g, h = p - y, np.maximum(p * (1 - p), 1e-9)
        roots.append(leaf(0.0))
        open_nodes = [(roots[-1], np.arange(len(y)))]
        for level in range(depth + 1):
            following = []
            for node, rows in open_nodes:
                G, H = g[rows].sum(), h[rows].sum()
                best = (1e-6, None, None)
                if level < depth and H >= 2 * least * 0.01:
                    for f in range(x.shape[1]):
                        n = len(cuts[f]) + 1
                        gl = np.cumsum(np.bincount(binned[rows, f], g[rows], n))[:-1]
                        hl = np.cumsum(np.bincount(binned[rows, f], h[rows], n))[:-1]
                        nl = np.cumsum(np.bincount(binned[rows, f], minlength=n))[:-1]
                        ok = (nl >= least) & (len(rows) - nl >= least)
                        if ok.any():
                            gain = np.where(ok, gl**2 / (hl + l2) + (G - gl) ** 2 / (H - hl + l2) - G**2 / (H + l2), -1)
                            k = int(gain.argmax())
                            if gain[k] > best[0]:
                                best = (gain[k], f, k)
                if best[1] is None:
                    flat["value"][node] = float(-rate * G / (H + l2))
                    total[rows] += flat["value"][node]
                    continue
                f, k = best[1], best[2]
                low = binned[rows, f] <= k
                flat["feature"][node], flat["threshold"][node] = f, float(cuts[f][k])
                flat["left"][node], flat["right"][node] = leaf(0.0), leaf(0.0)
                following += [(flat["left"][node], rows[low]), (flat["right"][node], rows[~low])]
            open_nodes = following
    return Trees(*(np.array(flat[k]) for k in ("feature", "threshold", "left", "right", "value")), np.array(roots), depth, bias)


def _features(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        found = [np.array(statistics((t.as_py() or "").encode("utf-8", "surrogatepass"))).tobytes() for t in batch.column(1)]
        yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(found, pa.binary()), batch.column(2)], ["doc_id", "x", "label"])


def fit(docs: DataFrame, labels: DataFrame, sample_rows: int = SAMPLE_ROWS) -> Trees:
    """``docs(doc_id, text)`` and ``labels(doc_id, label)`` -> trees, from at most ``sample_rows`` labelled rows.

    Rows that repeat an id count once, by the least of their statistics. Without any row,
    or with one class only, the score is that class's share everywhere (0.5 without rows).
    Null texts count as empty; other columns are ignored.
    """
    chosen = docs.select("doc_id", F.col("text").cast("string").alias("text")).join(F.broadcast(sampled_labels(labels, sample_rows)), "doc_id")
    found = chosen.select("doc_id", "text", "label").mapInArrow(_features, "doc_id long, x binary, label int")
    got = sorted(tuple(r) for r in found.groupBy("doc_id").agg(F.min("x").alias("x"), F.max("label").alias("label")).collect())
    y = np.array([r[2] for r in got], np.float64)
    if not len(y) or y.min() == y.max():
        share = min(max(float(y.mean()) if len(y) else 0.5, 1e-6), 1 - 1e-6)
        none = np.zeros(0, np.int64)
        return Trees(none, none.astype(float), none, none, none.astype(float), none, 0, float(np.log(share / (1 - share))))
    return grow(np.stack([np.frombuffer(r[1]) for r in got]), y)


def score(docs: DataFrame, trees: Trees) -> DataFrame:
    """``docs`` with a column ``score`` in [0, 1] for every row, null and empty texts too.

    Repeated rows come back as often, with all their columns; a column of that name is
    called ``score_given`` in the result.
    """
    docs = set_aside(docs, "score", "__text")
    sent = docs.sparkSession.sparkContext.broadcast(tuple(vars(trees).values()))  # a fixed number of small trees, as plain arrays

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        walk = Trees(*sent.value)
        for batch in batches:
            texts = batch.column(batch.schema.get_field_index("__text"))
            x = np.array([statistics((t.as_py() or "").encode("utf-8", "surrogatepass")) for t in texts]).reshape(len(texts), len(FEATURES))
            keep = [i for i, n in enumerate(batch.schema.names) if n != "__text"]
            out = pa.array(walk.predict(x), pa.float64())
            yield pa.RecordBatch.from_arrays([*(batch.column(i) for i in keep), out], [*(batch.schema.names[i] for i in keep), "score"])

    schema = StructType([*docs.schema.fields]).add("score", DoubleType())
    return docs.withColumn("__text", F.col("text").cast("string")).mapInArrow(run, schema)
