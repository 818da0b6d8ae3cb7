"""Toxicity: a factorization machine over hashed terms.

A term is a run of letters, in lower case, or the start of a longer one (words of one family differ in their
endings), hashed into 2**18 buckets; its value grows with the number of times that the
text has it. Besides a weight per bucket the machine learns a short
vector per bucket, whose inner products are the weights of pairs: two mild terms may together say
what neither says alone. Buckets are kept that tell something of the label by a chi-squared test, alone
or in a pair with any other bucket (`interacting`); the rest are dropped before the fit. The fit runs on the driver over a bounded sample of labelled rows (`most`); whole
texts are read both then and when scoring. Labels, language, source and id are no inputs.

Nulls: a null text counts as empty, and scores by the intercept as a text without known terms
does. Without labels of both kinds every score is the prior (0.5 without any label). Repeated rows
come out as often as they came in. Other columns are ignored.
"""

from __future__ import annotations

import math
import re
import zlib
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
BUCKETS, FACTORS, EPOCHS, LEAST_TEXTS, LEAST_CHI = 2**18, 6, 24, 4, 12.0
#: Of a pair; larger, as there are very many pairs. Buckets that are held against others at once.
PAIR_CHI, PAIR_BLOCK = 60.0, 1024
PARTS = (5, 6, 7)
#: Terms whose bucket a worker keeps in mind; beyond, it starts anew.
MEMO = 400_000

_LETTERS = re.compile(r"[^\W\d_]+")


def bucket(term: str) -> int:
    return zlib.crc32(term.encode("utf-8", "surrogatepass")) & (BUCKETS - 1)


def terms(text: str) -> Counter:
    return Counter(_LETTERS.findall(text.lower()))


def buckets_of(word: str) -> list[int]:
    """Those of the word and of its starts."""
    return [bucket(p) for p in (word, *[word[:k] + "*" for k in PARTS if k < len(word)])]


def value(count) -> np.ndarray:
    """1 for a term that occurs once, growing with the logarithm."""
    return np.log1p(count) / math.log(2)


@dataclass
class Machine:
    intercept: float
    buckets: np.ndarray  # sorted
    weight: np.ndarray
    factor: np.ndarray  # terms x factors

    def margin(self, rows: np.ndarray, columns: np.ndarray, values: np.ndarray, n: int) -> np.ndarray:
        out = np.full(n, self.intercept)
        if len(rows):
            out += np.bincount(rows, self.weight[columns] * values, n)
            xv = self.factor[columns] * values[:, None]
            for k in range(xv.shape[1]):
                out += 0.5 * (np.bincount(rows, xv[:, k], n) ** 2 - np.bincount(rows, xv[:, k] ** 2, n))
        return out


def _sigmoid(z: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(z, -35, 35)))


def interacting(rows: np.ndarray, columns: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Buckets of pairs whose texts have label 1 oftener than either bucket's, or both by independent odds, let expect.

    A pair of h texts of label 1 reaches at most the chi-squared of h texts that all have it, so buckets
    with fewer such texts than PAIR_CHI asks for are in no pair; all pairs of the others are counted.
    """
    n = len(y)
    prior = float(y.mean())
    seen, hit = np.bincount(columns, minlength=BUCKETS), np.bincount(columns, y[rows], BUCKETS)
    able = np.flatnonzero(hit * (1 - prior) >= PAIR_CHI * prior)
    if len(able) < 2:
        return able[:0]
    where = np.full(BUCKETS, -1)
    where[able] = np.arange(len(able))
    inside = where[columns] >= 0
    rows, columns = rows[inside], where[columns[inside]]
    order = np.argsort(columns, kind="stable")
    rows, columns = rows[order], columns[order]
    logit = lambda r: np.log(r / (1 - r))
    rate = np.clip(hit[able] / seen[able], 0.5 / (n + 1), 1 - 0.5 / (n + 1))
    odds, found = logit(rate), np.zeros(len(able), bool)

    def dense(lo: int) -> np.ndarray:
        a, b = np.searchsorted(columns, (lo, lo + PAIR_BLOCK))
        out = np.zeros((n, min(PAIR_BLOCK, len(able) - lo)), np.float32)
        out[rows[a:b], columns[a:b] - lo] = 1
        return out

    of_one = np.flatnonzero(y > 0)
    for lo in range(0, len(able), PAIR_BLOCK):
        left = dense(lo)
        one = left[of_one]
        for at in range(lo, len(able), PAIR_BLOCK):
            right = left if at == lo else dense(at)
            h = one.T @ right[of_one]
            i, j = np.nonzero(h * (1 - prior) >= PAIR_CHI * prior)
            apart = lo + i < at + j
            i, j = i[apart], j[apart]
            if not len(i):
                continue
            h, both = h[i, j].astype(float), (left.T @ right)[i, j].astype(float)
            i, j = lo + i, at + j
            expected = np.maximum(np.maximum(np.maximum(rate[i], rate[j]), _sigmoid(odds[i] + odds[j] - logit(prior))), prior)
            expected = np.minimum(expected, 1 - 0.5 / (n + 1))
            over = h - both * expected
            far = (over > 0) & (over * over >= PAIR_CHI * both * expected * (1 - expected))
            found[i[far]] = found[j[far]] = True
    return able[found]


def fit_machine(bags: list[tuple[np.ndarray, np.ndarray]], y: np.ndarray, seed: int = 7) -> Machine:
    """From bags (buckets, counts) and labels; AdaGrad on the logistic loss."""
    none = Machine(0.0, np.zeros(0, np.int64), np.zeros(0), np.zeros((0, FACTORS)))
    n = len(y)
    if not n:
        return none
    prior = float(np.clip(y.mean(), 0.5 / (n + 1), 1 - 0.5 / (n + 1)))
    none.intercept = math.log(prior / (1 - prior))
    if y.min() == y.max():
        return none
    lengths = np.array([len(b) for b, _ in bags])
    rows, columns = np.repeat(np.arange(n), lengths), np.concatenate([b for b, _ in bags]).astype(np.int64)
    counts = np.concatenate([c for _, c in bags]).astype(float)
    hit, seen = np.bincount(columns, y[rows], BUCKETS), np.bincount(columns, minlength=BUCKETS).astype(float)
    spread = np.maximum(n * prior * (1 - prior) * (seen / n) * (1 - seen / n), 1e-9)
    chi = np.where(seen >= LEAST_TEXTS, (hit - seen * prior) ** 2 / spread, 0)
    kept = np.union1d(np.flatnonzero(chi >= LEAST_CHI), np.union1d(interacting(rows, columns, y), interacting(rows, columns, 1 - y)))
    if not len(kept):
        return none
    where = np.full(BUCKETS, -1)
    where[kept] = np.arange(len(kept))
    inside = where[columns] >= 0
    rows, columns, values = rows[inside], where[columns[inside]], value(counts[inside])
    rng = np.random.default_rng(seed)
    m = Machine(none.intercept, kept, np.zeros(len(kept)), rng.normal(0, 0.02, (len(kept), FACTORS)))
    starts = np.searchsorted(rows, np.arange(n + 1))
    gw, gv, g0 = np.full(len(kept), 1e-6), np.full(m.factor.shape, 1e-6), 1e-6
    for _ in range(EPOCHS):
        order = rng.permutation(n)
        for batch in np.array_split(order, max(1, n // 256)):
            at = np.concatenate([np.arange(starts[i], starts[i + 1]) for i in batch])
            r, c, v = np.repeat(np.arange(len(batch)), starts[batch + 1] - starts[batch]), columns[at], values[at]
            e = (_sigmoid(m.margin(r, c, v, len(batch))) - y[batch]) / len(batch)
            g = e.sum()
            g0 += g * g
            m.intercept -= 0.1 * g / math.sqrt(g0)
            if not len(at):
                continue
            xv = m.factor[c] * v[:, None]
            sums = np.stack([np.bincount(r, xv[:, k], len(batch)) for k in range(FACTORS)], axis=1)
            dw = np.bincount(c, e[r] * v, len(kept)) + 2e-5 * m.weight
            part = (e[r] * v)[:, None] * (sums[r] - xv)
            dv = np.stack([np.bincount(c, part[:, k], len(kept)) for k in range(FACTORS)], axis=1) + 1e-4 * m.factor
            gw += dw * dw
            gv += dv * dv
            m.weight -= 0.15 * dw / np.sqrt(gw)
            m.factor -= 0.03 * dv / np.sqrt(gv)
    return m


def _bagged(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        bags = []
        for t in b.column("text").to_pylist():
            bag: dict[int, int] = {}
            for w, c in terms(t or "").items():
                for k in buckets_of(w):
                    bag[k] = bag.get(k, 0) + c
            bags.append(sorted(bag.items()))
        yield pa.RecordBatch.from_arrays(
            [b.column("doc_id"), b.column("label"), pa.array([[k for k, _ in x] for x in bags], pa.list_(pa.int32())), pa.array([[c for _, c in x] for x in bags], pa.list_(pa.int32()))],
            ["doc_id", "label", "buckets", "counts"],
        )


def fit(docs: DataFrame, labels: DataFrame, fits=None, label: str = "toxic", most: int = FIT_ROWS) -> Machine:
    """A machine from at most `most` labelled documents for which the condition `fits` holds."""
    small_batches(docs.sparkSession)
    sample = labelled_sample(labels, label, F.lit(True) if fits is None else fits, most)
    got = (
        texts(docs).join(F.broadcast(sample), "doc_id")
        .mapInArrow(_bagged, "doc_id long, label int, buckets array<int>, counts array<int>")
        .toArrow()
    )
    rows, seen = [], set()
    ids, y = got.column("doc_id").to_pylist(), got.column("label").to_pylist()
    b, c = got.column("buckets").combine_chunks(), got.column("counts").combine_chunks()
    for i in range(got.num_rows):
        rows.append((ids[i], np.asarray(b[i].values), np.asarray(c[i].values), y[i]))
    rows.sort(key=lambda r: (r[0], len(r[1]), r[1].tobytes(), r[2].tobytes()))
    rows = [r for r in rows if not (r[0] in seen or seen.add(r[0]))]
    return fit_machine([(r[1], r[2]) for r in rows], np.array([r[3] for r in rows], float))


def score(docs: DataFrame, model: Machine) -> DataFrame:
    """doc_id, score, predicted of every row."""
    small_batches(docs.sparkSession)

    def scored(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at = {int(k): i for i, k in enumerate(model.buckets)}
        memo: dict[str, list[int]] = {}
        for b in batches:
            rows, columns, counts = [], [], []
            for i, t in enumerate(b.column("text").to_pylist()):
                bag: dict[int, int] = {}
                for w, n in terms(t or "").items():
                    own = memo.get(w)
                    if own is None:
                        if len(memo) >= MEMO:
                            memo.clear()
                        own = memo[w] = [at[k] for k in buckets_of(w) if k in at]
                    for k in own:
                        bag[k] = bag.get(k, 0) + n
                for k, n in sorted(bag.items()):
                    rows.append(i), columns.append(k), counts.append(n)
            p = _sigmoid(model.margin(np.array(rows, int), np.array(columns, int), value(np.array(counts, float)), b.num_rows))
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), pa.array(p), pa.array((p >= 0.5).astype(np.int32))], ["doc_id", "score", "predicted"])

    return texts(docs).mapInArrow(scored, "doc_id long, score double, predicted int")


def op3_toxicity(spark, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir)
    model = fit(docs, table(spark, sf_dir, "labels"), id_remainder(5) != 0)
    return score(docs, model).select("doc_id", (id_remainder(5) == 0).alias("held_out"), "score", "predicted")
