"""Quality classifier: histogram gradient-boosted trees over document statistics.

Statistics of the whole text are made in one pass over its bytes. Trees are grown on the driver
from a bounded sample of labelled rows (`most`), level by level on binned statistics, and kept as
flat arrays of one shape (heap order), so that a batch of documents walks all trees at once in
numpy. Labels, language, source and id are no inputs.

Nulls: a null text counts as empty, a null id scores like any other and is not held out. Without
labels of both kinds every score is the prior (0.5 without any label). Repeated rows come out as
often as they came in. Other columns are ignored.
"""

from __future__ import annotations

import math
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from millrace.llm.common import documents, id_remainder, labelled_sample, small_batches, table, texts

#: Labelled rows that a fit reads at most.
FIT_ROWS = 12_000
BINS, DEPTH, TREES, RATE, SHRINK, LEAST = 64, 4, 80, 0.15, 1.0, 5.0

STATISTICS = (
    "log_bytes", "log_words", "bytes_a_word", "distinct_words", "root_ttr", "top_word", "same_as_last",
    "upper", "lower", "digits", "spaces", "line_ends", "exclaims", "bars", "symbols", "full_stops", "commas",
    "other_marks", "beyond_ascii", "top_byte", "entropy", "distinct_lines", "bytes_a_line", "ats",
)

_KINDS = {
    "upper": range(65, 91), "lower": range(97, 123), "digits": range(48, 58), "spaces": (32, 9, 13), "line_ends": (10,),
    "exclaims": (33, 63), "bars": (124,), "symbols": (35, 36, 37, 38, 42, 94, 126, 95, 61, 43), "full_stops": (46,), "commas": (44,),
    "other_marks": (34, 39, 40, 41, 45, 47, 58, 59, 60, 62, 91, 92, 93, 96, 123, 125), "beyond_ascii": range(128, 256), "ats": (64,),
}
_KIND_OF = np.zeros((256, len(_KINDS)))
for _k, _codes in enumerate(_KINDS.values()):
    _KIND_OF[list(_codes), _k] = 1


def statistics(text: str) -> list[float]:
    """The STATISTICS of one text; all defined for the empty text too."""
    raw = text.encode("utf-8", "surrogatepass")
    n = len(raw)
    counts = np.bincount(np.frombuffer(raw, np.uint8), minlength=256)
    shares = dict(zip(_KINDS, (counts @ _KIND_OF) / max(1, n), strict=True))
    seen = counts[counts > 0] / max(1, n)
    words, lines = text.split(), text.split("\n")
    w = len(words)
    tally = Counter(words)
    counts[32] = 0
    rest = {
        "log_bytes": math.log1p(n), "log_words": math.log1p(w), "bytes_a_word": n / max(1, w),
        "distinct_words": len(tally) / max(1, w), "root_ttr": len(tally) / math.sqrt(max(1, w)),
        "top_word": max(tally.values(), default=0) / max(1, w),
        "same_as_last": sum(map(str.__eq__, words, words[1:])) / max(1, w),
        "top_byte": counts.max() / max(1, n), "entropy": float(-(seen * np.log2(seen)).sum()) if n else 0.0,
        "distinct_lines": len(set(lines)) / len(lines), "bytes_a_line": math.log1p(n / len(lines)),
    }
    shares.update(rest)
    return [float(shares[k]) for k in STATISTICS]


@dataclass
class Trees:
    """Boosted trees of one depth in heap order: node i has children 2i+1 and 2i+2."""

    prior: float
    feature: np.ndarray  # trees x inner nodes
    cut: np.ndarray  # trees x inner nodes; x <= cut goes left
    leaf: np.ndarray  # trees x leaves

    def margin(self, x: np.ndarray) -> np.ndarray:
        t, inner = self.feature.shape
        if not t:
            return np.full(len(x), self.prior)
        node = np.zeros((len(x), t), np.int64)
        rows, trees = np.arange(len(x))[:, None], np.arange(t)[None, :]
        for _ in range(int(math.log2(inner + 1))):
            node = 2 * node + 1 + (x[rows, self.feature[trees, node]] > self.cut[trees, node])
        return self.prior + self.leaf[trees, node - inner].sum(axis=1)

    def probability(self, x: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(self.margin(x), -35, 35)))


def grow(x: np.ndarray, y: np.ndarray, trees: int = TREES, depth: int = DEPTH) -> Trees:
    """Newton boosting of the logistic loss on binned columns."""
    inner = 2**depth - 1
    empty = Trees(0.0, np.zeros((0, inner), np.int64), np.zeros((0, inner)), np.zeros((0, inner + 1)))
    if not len(y):
        return empty
    rate = float(np.clip(y.mean(), 0.5 / (len(y) + 1), 1 - 0.5 / (len(y) + 1)))
    empty.prior = math.log(rate / (1 - rate))
    if y.min() == y.max():
        return empty
    n, m = x.shape
    cuts = [np.unique(np.quantile(x[:, j], np.linspace(0, 1, BINS + 1)[1:-1])) for j in range(m)]
    binned = np.stack([np.searchsorted(c, x[:, j], side="left") for j, c in enumerate(cuts)], axis=1)
    flat = binned + np.arange(m) * BINS
    margin = np.full(n, empty.prior)
    features, thresholds, leaves = [], [], []
    for _ in range(trees):
        p = 1 / (1 + np.exp(-margin))
        g, h = p - y, np.maximum(p * (1 - p), 1e-9)
        feature, cut, node = np.zeros(inner, np.int64), np.full(inner, np.inf), np.zeros(n, np.int64)
        for level in range(depth):
            first, width = 2**level - 1, 2**level
            key = ((node - first)[:, None] * (m * BINS) + flat).ravel()
            size = width * m * BINS
            gs = np.bincount(key, np.repeat(g, m), size).reshape(width, m, BINS).cumsum(axis=2)
            hs = np.bincount(key, np.repeat(h, m), size).reshape(width, m, BINS).cumsum(axis=2)
            gt, ht = gs[:, :, -1:], hs[:, :, -1:]
            gain = gs**2 / (hs + SHRINK) + (gt - gs) ** 2 / (ht - hs + SHRINK) - gt**2 / (ht + SHRINK)
            gain[(hs < LEAST / 4) | (ht - hs < LEAST / 4)] = -1
            best = gain.reshape(width, -1).argmax(axis=1)
            for k, b in enumerate(best):
                j, at = divmod(int(b), BINS)
                if gain[k, j, at] > 1e-6 and at < len(cuts[j]):
                    feature[first + k], cut[first + k] = j, cuts[j][at]
            node = 2 * node + 1 + (x[np.arange(n), feature[node]] > cut[node])
        at = node - inner
        gs, hs = np.bincount(at, g, inner + 1), np.bincount(at, h, inner + 1)
        leaf = -RATE * gs / (hs + SHRINK)
        margin = margin + leaf[at]
        features.append(feature), thresholds.append(cut), leaves.append(leaf)
    return Trees(empty.prior, np.array(features), np.array(thresholds), np.array(leaves))


def _measured(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        x = [statistics(t or "") for t in b.column("text").to_pylist()]
        yield pa.RecordBatch.from_arrays([b.column("doc_id"), b.column("label"), pa.array(x, pa.list_(pa.float64()))], ["doc_id", "label", "x"])


def fit(docs: DataFrame, labels: DataFrame, fits=None, label: str = "quality", most: int = FIT_ROWS) -> Trees:
    """Trees from at most `most` labelled documents for which the condition `fits` holds."""
    small_batches(docs.sparkSession)
    sample = labelled_sample(labels, label, F.lit(True) if fits is None else fits, most)
    rows = (
        texts(docs).join(F.broadcast(sample), "doc_id")
        .mapInArrow(_measured, "doc_id long, label int, x array<double>")
        .toPandas()
    )
    if not len(rows):
        return grow(np.zeros((0, len(STATISTICS))), np.zeros(0))
    # One row an id: repeated rows must not add to what `most` bounds; in a fixed order, as sums of floats depend on it.
    rows = rows.assign(k=[tuple(x) for x in rows.x]).sort_values(["doc_id", "k"]).drop_duplicates("doc_id")
    return grow(np.array(rows.k.tolist()), rows.label.to_numpy(float))


def score(docs: DataFrame, model: Trees) -> DataFrame:
    """doc_id, score, predicted of every row."""
    small_batches(docs.sparkSession)

    def scored(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if b.num_rows:
                p = model.probability(np.array([statistics(t or "") for t in b.column("text").to_pylist()]))
                yield pa.RecordBatch.from_arrays([b.column("doc_id"), pa.array(p), pa.array((p >= 0.5).astype(np.int32))], ["doc_id", "score", "predicted"])

    return texts(docs).mapInArrow(scored, "doc_id long, score double, predicted int")


def stage(spark, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pipeline stage: documents that the classifier rejects go."""
    model = fit(docs, table(spark, sf_dir, "labels"))
    columns = docs.columns
    small_batches(spark)

    def kept(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if b.num_rows:
                p = model.probability(np.array([statistics(t or "") for t in b.column("text").to_pylist()]))
                yield b.filter(pa.array(p >= 0.5))

    return docs.select(*columns).mapInArrow(kept, docs.schema)


def op1_quality(spark, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir)
    model = fit(docs, table(spark, sf_dir, "labels"), id_remainder(3) != 1)
    return score(docs, model).select("doc_id", (id_remainder(3) == 1).alias("held_out"), "score", "predicted")
