"""Benchmark decontamination: an FM-index over each shard of the training text.

A shard is a run of documents of one Arrow batch. Its words become numbers by the vocabulary of the
benchmark block at hand; a word that no item has can be in no occurrence, so only runs of known
words that are as long as the shortest window go into the shard's index, each behind a sentinel. The
index holds the Burrows-Wheeler transform of the reversed order's suffixes as a wavelet tree with
rank counts, and every `SAMPLE`-th suffix position. Each window of an item is searched backwards
through ranks; rows of the found interval are located by stepping to a sampled position. Located
windows mark words of their documents, and marked words merge into spans. All windows of all items
step together as numpy arrays.

The benchmark is read in blocks of at most `BLOCK_BYTES` of text, each of which goes to every task;
more blocks mean more passes over the documents, whose spans are then merged by document. So the
size of what is broadcast is bounded whatever the benchmark's size.

Nulls: a null text has no words, and is neither hit nor contaminated; an item that is null or has no
words is never found; items with equal texts are each found. Repeated document rows each get their
own result in one block; with several blocks rows are told apart by id and text. Other columns are
ignored.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from millrace.llm.common import documents, materialize, small_batches, table, texts

WINDOW, CONTAMINATED = 13, 20
BLOCK_BYTES, SAMPLE = 8_000_000, 8

#: Bytes that end a word become spaces, A-Z become a-z.
_FOLD = bytes(c + 32 if 65 <= c <= 90 else 32 if c <= 0x2F or 0x3A <= c <= 0x60 or 0x7B <= c <= 0x7F else c for c in range(256))
_SPANS = re.compile(rb"[^ ]+")


def words(text: str) -> list[bytes]:
    return text.encode("utf-8", "surrogatepass").translate(_FOLD).split()


class Wavelet:
    """Rank of a symbol below a position, by a wavelet matrix over bits of the symbols."""

    def __init__(self, symbols: np.ndarray, bits: int):
        self.bits, self.ones, self.zeros = bits, [], []
        for b in range(bits - 1, -1, -1):
            bit = (symbols >> b) & 1
            self.ones.append(np.concatenate(([0], np.cumsum(bit, dtype=np.int64))))
            self.zeros.append(len(symbols) - int(bit.sum()))
            symbols = np.concatenate((symbols[bit == 0], symbols[bit == 1]))

    def rank(self, symbol: np.ndarray, at: np.ndarray) -> np.ndarray:
        """How often symbol[i] stands before at[i]."""
        lo, hi = np.zeros_like(at), at
        for k in range(self.bits):
            one = ((symbol >> (self.bits - 1 - k)) & 1).astype(bool)
            ones, zeros = self.ones[k], self.zeros[k]
            lo = np.where(one, zeros + ones[lo], lo - ones[lo])
            hi = np.where(one, zeros + ones[hi], hi - ones[hi])
        return hi - lo


class FMIndex:
    """Over an array of symbols >= 1; 0 ends it. Symbols used as sentinels must end every string."""

    def __init__(self, symbols: np.ndarray):
        s = np.concatenate((symbols.astype(np.int64), [0]))
        n = len(s)
        self.suffixes = suffix_array(s)
        bwt = s[self.suffixes - 1]
        top = int(s.max()) + 1
        self.below = np.concatenate(([0], np.cumsum(np.bincount(s, minlength=top))))
        self.bwt, self.tree = bwt, Wavelet(bwt, max(1, top.bit_length()))
        self.sampled = self.suffixes % SAMPLE == 0
        self.position = np.where(self.sampled, self.suffixes, -1)
        del self.suffixes
        self.n, self.top = n, top

    def search(self, patterns: np.ndarray, lengths: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Intervals of rows whose suffixes begin with the patterns (rows padded on the left with 0)."""
        lo, hi = np.zeros(len(patterns), np.int64), np.full(len(patterns), self.n, np.int64)
        for j in range(1, patterns.shape[1] + 1):
            symbol = patterns[:, -j]
            on = (j <= lengths) & (lo < hi)
            known = on & (symbol < self.top)
            i = np.flatnonzero(known)
            lo[i] = self.below[symbol[i]] + self.tree.rank(symbol[i], lo[i])
            hi[i] = self.below[symbol[i]] + self.tree.rank(symbol[i], hi[i])
            lo[on & ~known] = hi[on & ~known] = 0
        return lo, np.maximum(lo, hi)

    def locate(self, rows: np.ndarray) -> np.ndarray:
        """Text positions of the rows' suffixes."""
        out, at, steps, open_ = np.zeros(len(rows), np.int64), rows.copy(), 0, np.arange(len(rows))
        while len(open_):
            got = self.sampled[at]
            out[open_[got]] = self.position[at[got]] + steps
            open_, at = open_[~got], at[~got]
            symbol = self.bwt[at]
            at = self.below[symbol] + self.tree.rank(symbol, at)
            steps += 1
        return out


def suffix_array(s: np.ndarray) -> np.ndarray:
    """By doubling; only suffixes that still tie are sorted again."""
    n = len(s)
    order = np.argsort(s, kind="stable")
    rank = np.zeros(n, np.int64)
    first = np.concatenate(([True], s[order][1:] != s[order][:-1]))
    rank[order] = np.maximum.accumulate(np.where(first, np.arange(n), 0))
    step = 1
    while True:
        head = np.flatnonzero(first)
        size = np.diff(np.append(head, n))
        tied = np.repeat(size > 1, size)
        if not tied.any():
            return order
        at = np.flatnonzero(tied)
        pos = order[at]
        nxt = np.where(pos + step < n, rank[np.minimum(pos + step, n - 1)], -1)
        own = rank[pos]
        again = np.lexsort((nxt, own))
        order[at] = pos[again]
        own, nxt = own[again], nxt[again]
        new = np.concatenate(([True], (own[1:] != own[:-1]) | (nxt[1:] != nxt[:-1])))
        first[at] = new
        starts = np.maximum.accumulate(np.where(first, np.arange(n), 0))
        rank[order[at]] = starts[at]
        step *= 2


class Phrases:
    """The windows of one block of items as rows of word numbers."""

    def __init__(self, items: list[tuple[object, str]], window: int = WINDOW):
        self.ids = [str(i) for i, _ in items]
        self.vocabulary: dict[bytes, int] = {}
        found: dict[tuple[int, ...], set[int]] = {}
        for k, (_, text) in enumerate(items):
            own = [self.vocabulary.setdefault(w, len(self.vocabulary) + 2) for w in words(text)]
            for i in range(max(1, len(own) - window + 1) if own else 0):
                found.setdefault(tuple(own[i : i + window]), set()).add(k)
        self.owners = [sorted(v) for v in found.values()]
        self.lengths = np.array([len(k) for k in found], np.int64)
        self.patterns = np.zeros((len(found), window), np.int64)
        for i, k in enumerate(found):
            self.patterns[i, window - len(k) :] = k
        self.least = int(self.lengths.min()) if len(found) else 0


def hits(batch: list[list[bytes]], phrases: Phrases) -> list[tuple[np.ndarray, set[int]]]:
    """For each document: its marked words as a difference array, and the items found in it."""
    none: list = [(None, set())] * len(batch)
    if not len(phrases.owners):
        return none
    get, parts, doc_of, word_of = phrases.vocabulary.get, [], [], []
    for d, ws in enumerate(batch):
        if len(ws) < phrases.least:
            continue
        ids = np.fromiter((get(w, 0) for w in ws), np.int64, len(ws))
        known = np.flatnonzero(np.diff(np.concatenate(([0], (ids > 0).astype(np.int8), [0]))))
        for a, b in zip(known[::2], known[1::2], strict=True):
            if b - a >= phrases.least:
                parts.append(np.append(ids[a:b], 1))  # 1: sentinel, in no pattern
                doc_of.append(np.full(b - a + 1, d)), word_of.append(np.arange(a, b + 1))
    if not parts:
        return none
    doc, word = np.concatenate(doc_of), np.concatenate(word_of)
    index = FMIndex(np.concatenate(parts))
    lo, hi = index.search(phrases.patterns, phrases.lengths)
    found = np.flatnonzero(hi > lo)
    which = np.repeat(found, (hi - lo)[found])
    rows = np.concatenate([np.arange(lo[i], hi[i]) for i in found]) if len(found) else np.zeros(0, np.int64)
    at = index.locate(rows)
    out = none[:]
    for p, q in zip(which, at, strict=True):
        d = int(doc[q])
        if out[d][0] is None:
            out[d] = (np.zeros(len(batch[d]) + 1, np.int32), set())
        mark, items = out[d]
        mark[word[q]] += 1
        mark[word[q] + phrases.lengths[p]] -= 1
        items.update(phrases.owners[p])
    return out


def spans(mark: np.ndarray | None) -> list[tuple[int, int]]:
    """Runs of marked words, half open."""
    if mark is None:
        return []
    on = np.concatenate(([0], (np.cumsum(mark)[:-1] > 0).astype(np.int8), [0]))
    edges = np.flatnonzero(np.diff(on))
    return [(int(a), int(b)) for a, b in zip(edges[::2], edges[1::2], strict=True)]


def _blocks(benchmark: DataFrame, block_bytes: int) -> tuple[DataFrame, int]:
    items = benchmark.select(F.col("item_id").alias("item_id"), F.coalesce(F.col("text"), F.lit("")).alias("text"))
    total = items.agg(F.sum(F.octet_length("text") + 16)).first()[0] or 0
    n = -(-2 * total // block_bytes) if total > block_bytes else 1
    return items.withColumn("block", F.pmod(F.xxhash64("item_id", "text"), F.lit(n))), n


def find(docs: DataFrame, benchmark: DataFrame, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """doc_id, text_hash, n_words, spans (of words) and item ids found, a row for each row of docs."""
    spark = docs.sparkSession
    small_batches(spark)
    items, n = _blocks(benchmark, block_bytes)
    schema = "doc_id long, text_hash long, n_words long, spans array<struct<lo:long,hi:long>>, items array<string>"
    arrow = pa.schema([("doc_id", pa.int64()), ("text_hash", pa.int64()), ("n_words", pa.int64()), ("spans", pa.list_(pa.struct([("lo", pa.int64()), ("hi", pa.int64())]))), ("items", pa.list_(pa.string()))])
    source = texts(docs).withColumn("text_hash", F.xxhash64("text"))

    def one(block: int) -> DataFrame:
        phrases = Phrases(sorted(((r["item_id"], r["text"]) for r in items.where(F.col("block") == block).collect()), key=lambda x: (str(x[0]), x[1])))

        def marked(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for b in batches:
                if not b.num_rows:
                    continue
                shard = [words(t or "") for t in b.column("text").to_pylist()]
                got = hits(shard, phrases)
                yield pa.RecordBatch.from_arrays(
                    [b.column("doc_id"), b.column("text_hash"), pa.array([len(w) for w in shard], pa.int64()), pa.array([[{"lo": x, "hi": y} for x, y in spans(m)] for m, _ in got], arrow.field("spans").type), pa.array([sorted({phrases.ids[k] for k in i}) for _, i in got], pa.list_(pa.string()))],
                    schema=arrow,
                )

        return source.mapInArrow(marked, schema)

    if n == 1:
        return one(0)
    rows = one(0)
    for k in range(1, n):
        rows = rows.unionByName(one(k))
    # Equal rows have equal spans: one stands for them, and is repeated as often as it came.
    merged = rows.groupBy("doc_id", "text_hash", "n_words").agg(
        (F.count("*") / n).cast("int").alias("times"), F.array_sort(F.flatten(F.collect_set("spans"))).alias("all"),
        F.array_sort(F.array_distinct(F.flatten(F.collect_set("items")))).alias("items"),
    )
    return merged.select(
        "doc_id", "text_hash", "n_words",
        F.expr("""aggregate(all, cast(array() as array<struct<lo:bigint,hi:bigint>>), (s, x) ->
            case when size(s) > 0 and element_at(s, -1).hi >= x.lo
                 then concat(slice(s, 1, size(s) - 1), array(named_struct('lo', element_at(s, -1).lo, 'hi', greatest(element_at(s, -1).hi, x.hi))))
                 else concat(s, array(x)) end)""").alias("spans"),
        "items", F.explode(F.expr("array_repeat(0, times)")).alias("again"),
    ).drop("again")


def verdict(found: DataFrame) -> DataFrame:
    n_hit = F.expr("aggregate(spans, 0L, (s, x) -> s + x.hi - x.lo)")
    return found.select(
        "doc_id", "n_words", n_hit.alias("n_hit"), F.size("items").cast("long").alias("n_items"),
        F.sha2(F.array_join(F.array_sort("items"), ","), 256).alias("items_sha256"),
        ((n_hit > 0) & (CONTAMINATED * n_hit >= F.col("n_words"))).alias("contaminated"),
    )


def cut_out(text: str, runs: list[tuple[int, int]]) -> str:
    """The text without the given runs of words, and without what stands between the words of a run."""
    raw = text.encode("utf-8", "surrogatepass")
    at = [m.span() for m in _SPANS.finditer(raw.translate(_FOLD))]
    out, last = [], 0
    for lo, hi in runs:
        out.append(raw[last : at[lo][0]])
        last = at[hi - 1][1]
    return b"".join([*out, raw[last:]]).decode("utf-8", "surrogatepass")


def joined(runs: list[tuple[int, int]]) -> list[tuple[int, int]]:
    """The union of half-open runs; runs that touch become one."""
    out: list[tuple[int, int]] = []
    for lo, hi in sorted(runs):
        if out and out[-1][1] >= lo:
            out[-1] = (out[-1][0], max(out[-1][1], hi))
        else:
            out.append((lo, hi))
    return out


def stage(spark, docs: DataFrame, sf_dir: str, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """Pipeline stage: contaminated documents go; the others lose the words of an item that they hold.

    With several blocks the spans of each are found in the whole text and kept beside it; the last
    block's pass joins them, decides and cuts once.
    """
    small_batches(spark)
    items, n = _blocks(table(spark, sf_dir, "benchmark"), block_bytes)
    names, kept = docs.columns, "millrace_spans"
    if n > 1:
        docs = docs.withColumn(kept, F.expr("cast(array() as array<struct<lo:bigint,hi:bigint>>)"))
    for k in range(n):
        if k:
            docs = materialize(spark, docs, "decontaminated")
        phrases = Phrases(sorted(((r["item_id"], r["text"]) for r in items.where(F.col("block") == k).collect()), key=lambda x: (str(x[0]), x[1])))

        def cleaned(batches: Iterator[pa.RecordBatch], phrases: Phrases = phrases, last: bool = k == n - 1) -> Iterator[pa.RecordBatch]:
            for b in batches:
                if not b.num_rows:
                    continue
                own = b.column("text").to_pylist()
                shard = [words(t or "") for t in own]
                runs = [spans(m) for m, _ in hits(shard, phrases)]
                columns = {f.name: b.column(i) for i, f in enumerate(b.schema)}
                if kept in columns:
                    runs = [joined([(x["lo"], x["hi"]) for x in old] + r) for old, r in zip(columns.pop(kept).to_pylist(), runs, strict=True)]
                if not last:
                    columns[kept] = pa.array([[{"lo": x, "hi": y} for x, y in r] for r in runs], b.schema.field(kept).type)
                    yield pa.RecordBatch.from_arrays(list(columns.values()), names=list(columns))
                    continue
                size = [sum(y - x for x, y in r) for r in runs]
                new = [cut_out(t, r) if r else t for t, r in zip(own, runs, strict=True)]
                columns["text"] = pa.array(new, b.schema.field("text").type)
                if "n_chars" in columns:
                    old = columns["n_chars"].to_pylist()
                    columns["n_chars"] = pa.array([len(t) if r else c for t, r, c in zip(new, runs, old, strict=True)], b.schema.field("n_chars").type)
                keep = [not s or CONTAMINATED * s < len(w) for s, w in zip(size, shard, strict=True)]
                yield pa.RecordBatch.from_arrays(list(columns.values()), names=list(columns)).filter(pa.array(keep))

        docs = docs.mapInArrow(cleaned, docs.select(names).schema if k == n - 1 else docs.schema)
    return docs


def op5_decontaminate(spark, sf_dir: str) -> DataFrame:
    return verdict(find(documents(spark, sf_dir), table(spark, sf_dir, "benchmark")))


#: The same by a join of all windows.
SQL = {
    "op5_decontaminate": r"""
WITH dw AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM documents),
iw AS (SELECT item_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM benchmark),
ip AS (SELECT item_id, w, least(13, len(w)) AS k, unnest(range(1, greatest(len(w) - 13, 0) + 2)) AS i FROM iw WHERE len(w) > 0),
win AS (SELECT DISTINCT item_id, k, array_to_string(w[i:i + k - 1], ' ') AS g FROM ip),
ks AS (SELECT DISTINCT k FROM win),
dp AS (SELECT doc_id, w, k, unnest(range(1, len(w) - k + 2)) AS i FROM dw, ks WHERE len(w) >= k),
hit AS (SELECT DISTINCT doc_id, i, k, item_id FROM (SELECT doc_id, i, k, array_to_string(w[i:i + k - 1], ' ') AS g FROM dp) JOIN win USING (k, g)),
pos AS (SELECT doc_id, count(DISTINCT p) AS n_hit FROM (SELECT doc_id, unnest(range(i, i + k)) AS p FROM hit) GROUP BY doc_id),
its AS (SELECT doc_id, count(DISTINCT item_id) AS n_items, string_agg(DISTINCT CAST(item_id AS VARCHAR), ',' ORDER BY CAST(item_id AS VARCHAR)) AS ids FROM hit GROUP BY doc_id)
SELECT dw.doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(coalesce(n_hit, 0) AS BIGINT) AS n_hit, CAST(coalesce(n_items, 0) AS BIGINT) AS n_items,
       sha256(coalesce(ids, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AND 20 * coalesce(n_hit, 0) >= len(w) AS contaminated
FROM dw LEFT JOIN pos USING (doc_id) LEFT JOIN its USING (doc_id)
"""
}
