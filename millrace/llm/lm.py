"""Language-model scores: subword lattice likelihood.

A text is its words and one end. A word's probability sums over all ways to write it: as the whole word, if
training texts have it (its count less a discount), and, by the mass that discounts leave, as any sequence of
pieces of an existing subword vocabulary (and of single bytes). The sum over all segmentations is a forward
recursion in log space; a first piece comes from the pieces that open words, later ones from the others, and
after each the word ends or goes on. The vocabulary is taken as it is. Its own scores are where expectation
maximisation starts, which weighs each distinct training word once, as words not seen yet are like rare ones.

A text repeats its own words. So its words are drawn from an urn (a Polya urn of `URN` balls by those word
probabilities, to which each drawn word adds one of its kind): the text's probability depends on how often it has
each word, not on their order, and sums to 1 over all texts as before.

Counts. Each task numbers the words of its documents in blocks of `BLOCK_BYTES` of text; documents become
compressed lists of numbers, and only a block's distinct words are shuffled: to be counted, scored once for the
whole corpus, and sent back to their blocks. So a frequent word costs a row a block, wherever it stands.

Nulls: a null text is empty and scores its end alone; a null id is in training or not by the empty text's
checksum. Repeated rows count as often as they come. Without training texts every token has base
probability 1 by the formula, and the model gives half to an end. Other columns are ignored.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from millrace.llm.bytehash import _BASE, _INVERSE, mix, powers
from millrace.llm.common import documents, id_remainder, materialize, small_batches, texts

BLOCK_BYTES, ROUNDS, LONGEST_BATCHED, URN = 48_000_000, 2, 160, 1000.0
_LOWER = bytes(c + 32 if 65 <= c <= 90 else c for c in range(256))


def default_vocabulary() -> str:
    import public_tokenizers

    return public_tokenizers.path("piece_bpe_32k.model")


def words(text: str) -> list[bytes]:
    return text.encode("utf-8", "surrogatepass").translate(_LOWER).split()


# --- the lattice -------------------------------------------------------------------------------------------


def pieces(path: str) -> tuple[list[bytes], np.ndarray]:
    """Pieces as bytes, a space for the mark that opens a word, with weights by their existing scores.

    Every byte, and the opening mark, is a piece too, so that each word has a segmentation.
    """
    import sentencepiece

    model = sentencepiece.SentencePieceProcessor(model_file=path)
    weight: dict[bytes, float] = {}
    for i in range(model.get_piece_size()):
        if not (model.is_control(i) or model.is_unknown(i) or model.is_byte(i)):
            raw = model.id_to_piece(i).replace("▁", " ").encode()
            if raw and b" " not in raw[1:]:  # BPE scores are ranks of merges: by Zipf's law the weight is about 1 / rank
                weight[raw] = max(weight.get(raw, 0), 1 / (10 - model.get_score(i)))
    for c in range(256):
        weight.setdefault(bytes([c]), 1e-6)
    return list(weight), np.array(list(weight.values()))


class Lattice:
    """Log probabilities of words under piece weights."""

    def __init__(self, names: list[bytes], weights: np.ndarray, go_on: float = 0.7):
        self.names, self.go_on = names, go_on
        self.opens = np.array([n[:1] == b" " for n in names])
        w = np.maximum(weights, 1e-300)
        self.score = np.log(np.where(self.opens, w / w[self.opens].sum(), go_on * w / w[~self.opens].sum()))
        self.at = {n: i for i, n in enumerate(names)}
        self.longest = max(map(len, names))
        self._build()

    def __getstate__(self):
        return {"names": self.names, "go_on": self.go_on, "opens": self.opens, "score": self.score}

    def __setstate__(self, state):
        self.__dict__.update(state)
        self.at = {n: i for i, n in enumerate(self.names)}
        self.longest = max(map(len, self.names))
        self._build()

    def _build(self) -> None:
        """An open-addressed table from a piece's hash to its number."""
        size = 1 << 18
        self.mask, self.keys, self.ids, self.probes = size - 1, np.zeros(size, np.uint64), np.full(size, -1, np.int64), 0
        lengths, hashes = np.array([len(x) for x in self.names]), np.zeros(len(self.names), np.uint64)
        for n in np.unique(lengths):
            at = np.flatnonzero(lengths == n)
            hashes[at] = self._hash(np.frombuffer(b"".join([self.names[i] for i in at]), np.uint8).reshape(len(at), n))(0, n)
        left = np.arange(len(self.names))
        while len(left):
            slot = ((hashes[left] & np.uint64(self.mask)).astype(np.int64) + self.probes) & self.mask
            free = self.ids[slot] < 0
            self.ids[slot[free]] = left[free]  # of those that want one slot, the last has it
            won = self.ids[slot] == left
            self.keys[slot[won]] = hashes[left[won]]
            left = left[~won]
            self.probes += 1

    @staticmethod
    def _hash(table: np.ndarray):
        n = table.shape[1]
        upto = np.zeros((len(table), n + 1), np.uint64)
        np.cumsum((table.astype(np.uint64) + np.uint64(1)) * powers(_BASE, n), axis=1, out=upto[:, 1:])
        back = powers(_INVERSE, n + 1)
        return lambda i, j: mix((upto[:, j] - upto[:, i]) * back[i] + np.uint64(j - i))

    def _lookup(self, h: np.ndarray) -> np.ndarray:
        out = np.full(len(h), -1, np.int64)
        slot = (h & np.uint64(self.mask)).astype(np.int64)
        for k in range(self.probes):
            s = (slot + k) & self.mask
            out = np.where((self.ids[s] >= 0) & (self.keys[s] == h), self.ids[s], out)
        return out

    def _batch(self, table: np.ndarray, counts: np.ndarray | None) -> np.ndarray:
        """Forward over words of one length (each with its opening space); adds expected uses to counts."""
        m, n = table.shape
        key, arcs = self._hash(table), {}
        padded = np.append(self.score, -np.inf)
        forward = np.full((m, n + 1), -np.inf)
        forward[:, 0] = 0
        for j in range(1, n + 1):
            terms = []
            for i in range(max(0, j - self.longest), j):
                got = self._lookup(key(i, j))
                if (got >= 0).any():
                    arcs[i, j] = got
                    terms.append(forward[:, i] + padded[got])
            if terms:
                forward[:, j] = np.logaddexp.reduce(terms, axis=0) if len(terms) > 1 else terms[0]
        total = forward[:, n]
        if counts is not None:
            backward, used = np.full((m, n + 1), -np.inf), []
            backward[:, n] = 0
            for i in range(n - 1, -1, -1):
                terms = []
                for j in range(i + 1, min(n, i + self.longest) + 1):
                    if (i, j) in arcs:
                        got = arcs[i, j]
                        terms.append(padded[got] + backward[:, j])
                        use = np.exp(forward[:, i] + terms[-1] - total)
                        on = (got >= 0) & np.isfinite(use)
                        used.append((got[on], use[on]))
                if terms:
                    backward[:, i] = np.logaddexp.reduce(terms, axis=0) if len(terms) > 1 else terms[0]
            if used:
                counts += np.bincount(np.concatenate([a for a, _ in used]), np.concatenate([b for _, b in used]), len(counts))
        return total

    def _single(self, word: bytes, counts: np.ndarray | None) -> float:
        """The same for one word, however long."""
        n, at, score = len(word), self.at, self.score
        forward, arcs = [0.0] + [-math.inf] * n, []
        for j in range(1, n + 1):
            terms = []
            for i in range(max(0, j - self.longest), j):
                k = at.get(word[i:j])
                if k is not None and forward[i] > -math.inf:
                    arcs.append((i, j, k))
                    terms.append(forward[i] + score[k])
            if terms:
                top = max(terms)
                forward[j] = top + math.log(sum(math.exp(t - top) for t in terms))
        if counts is not None:
            backward = [-math.inf] * n + [0.0]
            for i, j, k in reversed(arcs):
                t = score[k] + backward[j]
                if t > -math.inf:
                    counts[k] += math.exp(forward[i] + t - forward[n])
                    hi = max(t, backward[i])
                    backward[i] = hi + math.log(math.exp(t - hi) + math.exp(backward[i] - hi))
        return forward[n]

    def logs(self, batch: list[bytes], counts: np.ndarray | None = None) -> np.ndarray:
        """Natural log probability of each word, the stop after its last piece included."""
        out = np.zeros(len(batch))
        lengths = np.array([len(w) for w in batch], np.int64)
        for n in np.unique(lengths):
            at = np.flatnonzero(lengths == n)
            if n > LONGEST_BATCHED:
                for i in at:
                    out[i] = self._single(b" " + batch[i], counts)
                continue
            table = np.full((len(at), n + 1), 32, np.uint8)
            table[:, 1:] = np.frombuffer(b"".join([batch[i] for i in at]), np.uint8).reshape(len(at), n)
            for s in range(0, len(at), 4096):
                out[at[s : s + 4096]] = self._batch(table[s : s + 4096], counts)
        # Arcs of later pieces hold the chance to go on; after the last piece the word stops.
        return out + math.log(1 - self.go_on)


def refit(lattice: Lattice, uses: np.ndarray, types: float) -> Lattice:
    """The maximisation step: from expected uses of each piece over `types` words."""
    later = uses[~lattice.opens].sum()
    go_on = float(np.clip((later + 1) / (later + types + 2), 0.01, 0.99))
    return Lattice(lattice.names, uses + 0.01, go_on)


# --- counting and scoring over the corpus -------------------------------------------------------------------

_NUMBERED = "block long, first int, words array<binary>, counts array<bigint>, doc_ids array<bigint>, known array<boolean>, held array<boolean>, sizes array<int>, distinct array<int>, body binary"
_SCHEMA = pa.schema(
    [("block", pa.int64()), ("first", pa.int32()), ("words", pa.list_(pa.binary())), ("counts", pa.list_(pa.int64())), ("doc_ids", pa.list_(pa.int64())), ("known", pa.list_(pa.bool_())), ("held", pa.list_(pa.bool_())), ("sizes", pa.list_(pa.int32())), ("distinct", pa.list_(pa.int32())), ("body", pa.binary())]
)


def _numbered(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    press = zstandard.ZstdCompressor(level=1)
    part, number, size = TaskContext.get().partitionId(), 0, 0
    index: dict[bytes, int] = {}
    counts = np.zeros(1 << 16, np.int64)

    def row(**x) -> pa.RecordBatch:
        x["block"] = part * 2**20 + number
        return pa.RecordBatch.from_arrays([pa.array([x.get(f.name)], f.type) for f in _SCHEMA], schema=_SCHEMA)

    def dictionary() -> Iterator[pa.RecordBatch]:
        names = list(index)
        for i in range(0, len(names), 20_000):
            yield row(first=i, words=names[i : i + 20_000], counts=counts[i : i + 20_000][: len(names) - i])

    for b in batches:
        if not b.num_rows:
            continue
        ids, held, sizes, distinct, gaps, times = b.column("doc_id").to_pylist(), b.column("held_out").to_pylist(), [], [], [], []
        for t, h in zip(b.column("text").to_pylist(), held, strict=True):
            w = words(t or "")
            own, n = np.unique(np.fromiter((index.setdefault(x, len(index)) for x in w), np.int64, len(w)), return_counts=True)
            if len(index) > len(counts):
                counts = np.concatenate((counts, np.zeros(max(len(counts), len(index) - len(counts)), np.int64)))
            if not h:
                counts[own] += n
            sizes.append(len(w)), distinct.append(len(own)), gaps.append(np.diff(own, prepend=0)), times.append(n)
            size += len(t or "")
        body = np.concatenate([*gaps, *times]).astype("<u4").view(np.uint8).reshape(-1, 4).T.tobytes() if ids else b""
        yield row(doc_ids=[0 if i is None else i for i in ids], known=[i is not None for i in ids], held=held, sizes=sizes, distinct=distinct, body=press.compress(body))
        if size >= BLOCK_BYTES:
            yield from dictionary()
            index, counts, size, number = {}, np.zeros(1 << 16, np.int64), 0, number + 1
    if index:
        yield from dictionary()


def _unpacked(body: bytes) -> np.ndarray:
    raw = zstandard.ZstdDecompressor().decompress(body)
    return np.frombuffer(raw, np.uint8).reshape(4, -1).T.copy().view("<u4").ravel().astype(np.int64)


def score_texts(docs: DataFrame, held_out, vocabulary: str | None = None) -> DataFrame:
    """doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score; a row for each row of docs."""
    spark = docs.sparkSession
    small_batches(spark)
    rows = texts(docs).withColumn("held_out", held_out)
    numbered = materialize(spark, rows.mapInArrow(_numbered, _NUMBERED), "lm-numbered")
    held = numbered.where("doc_ids IS NOT NULL")
    listed = numbered.where("words IS NOT NULL").select("block", "first", F.posexplode(F.arrays_zip("words", "counts")).alias("at", "w"))
    listed = listed.select("block", (F.col("first") + F.col("at")).alias("local"), F.col("w.words").alias("word"), F.col("w.counts").alias("n"))
    types = materialize(spark, listed.groupBy("word").agg(F.sum("n").alias("c")), "lm-words")
    ends = held.select(F.explode("held").alias("h")).where("NOT h").count()
    got = types.where("c > 0").agg(F.sum("c").alias("n"), F.count("*").alias("v"), F.count_if(F.col("c") == 1).alias("n1"), F.count_if(F.col("c") == 2).alias("n2")).first()
    n, v = (got["n"] or 0) + ends, got["v"] + (ends > 0)
    discount = min(0.95, max(0.1, got["n1"] / max(1, got["n1"] + 2 * got["n2"])))
    names, weights = pieces(vocabulary or default_vocabulary())
    lattice = Lattice(names, weights)
    for _ in range(ROUNDS if got["v"] else 0):
        lattice = refit(lattice, _uses(types, lattice), float(got["v"]))
    escape = discount * v / n if n else 0.5
    end = (ends - discount) / n if ends else escape
    scored = materialize(spark, _scored(types, lattice, n, discount, escape), "lm-scored")
    back = listed.select(F.col("block").alias("of"), "local", "word").join(scored, "word").select("of", "local", "c", "s")
    base_of = _base(n, v)
    base_end, log_end = float(base_of(np.array([ends]))[0]), math.log10(end)

    def summed(docs_: pd.DataFrame, values: pd.DataFrame) -> pd.DataFrame:
        size = int(values["local"].max()) + 1 if len(values) else 0
        c, s = np.zeros(size, np.int64), np.zeros(size)
        at = values["local"].to_numpy()
        c[at], s[at] = values["c"].to_numpy(), values["s"].to_numpy()
        base, out = base_of(c), []
        for ids, known, held_, sizes, distinct, body in zip(docs_["doc_ids"], docs_["known"], docs_["held"], docs_["sizes"], docs_["distinct"], docs_["body"], strict=True):
            flat = _unpacked(body)
            gaps, times = flat[: len(flat) // 2], flat[len(flat) // 2 :]
            stop = np.cumsum(distinct)
            for i, there, h, w, d, e in zip(ids, known, held_, sizes, distinct, stop, strict=True):
                own, k = np.cumsum(gaps[e - d : e]), times[e - d : e]
                out.append((int(i) if there else None, bool(h), int(w) + 1, int(k[c[own] > 0].sum()) + (ends > 0), n, float(k @ base[own]) + base_end, urn(s[own], k, log_end)))
        table = pd.DataFrame(out, columns=["doc_id", "held_out", "n_tokens", "n_known", "train_tokens", "base_score", "score"])
        table["doc_id"] = pd.array([x[0] for x in out], dtype="Int64")
        return table

    schema = "doc_id long, held_out boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double"
    return held.drop("words", "counts", "first").groupBy("block").cogroup(back.groupBy("of")).applyInPandas(summed, schema)


def urn(logs: np.ndarray, times: np.ndarray, log_end: float, size: float = URN) -> float:
    """log10 probability of drawing each word its number of times, and then the end."""
    balls = size * 10.0**logs
    out = float((logs.sum() + len(logs) * math.log10(size)) if len(logs) else 0.0)  # each first draw
    more = np.flatnonzero(times > 1)
    few = more[times[more] <= 16]
    for k in range(1, int(times[few].max()) if len(few) else 0):
        few = few[times[few] > k]
        out += float(np.log10(balls[few] + k).sum())
    for i in more[times[more] > 16]:
        out += (math.lgamma(balls[i] + times[i]) - math.lgamma(balls[i] + 1)) / math.log(10)
    n = int(times.sum())
    return out - (math.lgamma(size + n + 1) - math.lgamma(size)) / math.log(10) + math.log10(size) + log_end


def _base(n: int, v: int):
    return lambda c: np.log10((c + 0.1) / (n + 0.1 * (v + 1)))


def _uses(types: DataFrame, lattice: Lattice) -> np.ndarray:
    """Expected uses of each piece over all distinct training words."""

    def gathered(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts, own = np.zeros(len(lattice.names)), []
        for b in batches:
            own += b.column("word").to_pylist()
            if len(own) >= 20_000:
                lattice.logs(own, counts)
                own = []
        if own:
            lattice.logs(own, counts)
        at = np.flatnonzero(counts)
        yield pa.RecordBatch.from_arrays([pa.array(at), pa.array(counts[at])], ["piece", "uses"])

    got = types.where("c > 0").select("word").mapInArrow(gathered, "piece long, uses double").groupBy("piece").agg(F.sum("uses").alias("uses")).toPandas()
    out = np.zeros(len(lattice.names))  # one entry for each piece of the vocabulary, however large the corpus
    out[got["piece"].to_numpy(np.int64)] = got["uses"].to_numpy(float)
    return out


def _scored(types: DataFrame, lattice: Lattice, n: int, discount: float, escape: float) -> DataFrame:
    def logs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def done(parts: list[pa.RecordBatch]) -> pa.RecordBatch:
            t = pa.Table.from_batches(parts).combine_chunks()
            c = t.column("c").to_numpy().astype(float)
            spelled = lattice.logs(t.column("word").to_pylist()) + math.log(escape)
            with np.errstate(divide="ignore"):
                whole = np.log(np.maximum(c - discount, 0) / max(1, n))
            s = np.logaddexp(whole, spelled) / math.log(10)
            return pa.RecordBatch.from_arrays([t.column("word").combine_chunks(), t.column("c").combine_chunks(), pa.array(s)], ["word", "c", "s"])

        parts, size = [], 0
        for b in batches:
            parts.append(b)
            size += b.num_rows
            if size >= 20_000:
                yield done(parts)
                parts, size = [], 0
        if size:
            yield done(parts)

    return types.mapInArrow(logs, "word binary, c long, s double")


def op4_lm(spark, sf_dir: str) -> DataFrame:
    return score_texts(documents(spark, sf_dir), id_remainder(10) == 0)
