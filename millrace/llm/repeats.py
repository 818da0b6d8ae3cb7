"""Suffix-array dedup of repeated byte strings: later copies go, the first stays.

A byte goes if a string of `WINDOW` bytes over it also starts earlier in the order of (id, position): if the longest
previous factor of some start is WINDOW or more. The array of longest previous factors is made from the suffix
order: of all starts that come earlier in the text, the two that share most with a start are the next
smaller positions before and behind it in suffix order (`previous_factors`). One suffix array of everything doesn't fit a
task, so the starts are dealt into groups that hold all equal strings of WINDOW bytes together:

1. Anchors. In each string of WINDOW bytes the substring of `KEY` bytes with the smallest hash is an anchor (about
   3 in 100 positions). Equal strings have equal anchors at equal places. An anchor is written with a hash of its
   surroundings: all bytes that strings over it can reach. Each task first merges equal ones of its own.
2. Anchors meet by hash. Where surroundings are equal too, all strings over the later ones are repeats. Only
   where one anchor has different surroundings are those bytes looked at.
3. These are brought in suffix order, by prefix doubling over their bytes (`suffix_order`), and the starts whose longest previous
   factor reaches WINDOW are repeats. Anchors with very many different surroundings are first cut
   into finer ones: the strings that start in a SPREAD of places before the anchor share a longer core, which
   becomes the anchor, and fewer surroundings, which are merged as in 1 and 2. What is still crowded then
   may be more than a task holds: there the suffixes that share WINDOW bytes meet by 128 bits of hashes, and a start has an
   earlier one among them exactly if it isn't their smallest position, which a grouped minimum finds over all tasks.

Surroundings count as equal by 128 bits: 64 of the anchor, 64 of the whole.

Nulls: a null text is empty; a null id comes before all others. Rows of equal id are one document to the order:
their positions compare, equal rows keep what they have. Texts of less than WINDOW bytes lose nothing. Other
columns are ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from millrace.llm.bytehash import mix, ranges, sums
from millrace.llm.common import documents, materialize, small_batches, texts

WINDOW, KEY = 100, 32
REACH = WINDOW - KEY
#: Bytes that are hashed at once, anchors that a task merges at once, and surroundings of an anchor that one task takes.
PIECE, MERGED, CROWD = 1_000_000, 300_000, 4_096
#: Places before a crowded anchor whose strings share a finer one.
SPREAD = 14
_LEAST = -(2**63)


def _sliding(a: np.ndarray, width: int, pick) -> np.ndarray:
    """pick (minimum or maximum) over a[i : i + width], by doubling."""
    have, got = 1, a
    while have * 2 <= width:
        got = pick(got[:-have], got[have:])
        have *= 2
    return pick(got[: len(a) - width + 1], got[width - have :][: len(a) - width + 1]) if have < width else got


def anchors(raws: list[bytes]) -> tuple[np.ndarray, ...]:
    """document number, position, hash and hash of surroundings of each anchor."""
    raw = np.frombuffer(b"".join(raws), np.uint8)
    sizes = np.array([len(r) for r in raws], np.int64)
    ends = np.cumsum(sizes)
    if len(raw) < WINDOW:
        return (np.zeros(0, np.int64),) * 2 + (np.zeros(0, np.uint64),) * 2
    total = sums(raw)
    at = np.arange(len(raw) - KEY + 1)
    h = ranges(total, at, at + KEY)
    least = _sliding(h, REACH + 1, np.minimum)
    inside = np.repeat(ends, sizes)[: len(least)] - np.arange(len(least)) >= WINDOW
    least = np.concatenate((np.zeros(REACH, np.uint64), np.where(inside, least, 0), np.zeros(REACH, np.uint64)))
    p = np.flatnonzero(_sliding(least, REACH + 1, np.maximum)[: len(h)] == h)
    d = np.searchsorted(ends, p, side="right")
    begin, end = ends[d] - sizes[d], ends[d]
    lo, hi = np.maximum(begin, p - REACH), np.minimum(end, p + WINDOW)
    return d, p - begin, h[p], mix(ranges(total, lo, hi) ^ mix((p - lo).astype(np.uint64)))


_FOUND = pa.schema([("whole", pa.bool_()), ("anchor", pa.int64()), ("around", pa.int64()), ("ord", pa.int64()), ("twin", pa.int64()), ("pos", pa.int32())])


def _anchored(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    held: list[tuple[np.ndarray, ...]] = []

    def merged() -> pa.RecordBatch:
        o, w, p, a, s = (np.concatenate(x) for x in zip(*held, strict=True))
        held.clear()
        order = np.lexsort((p, o, s, a))
        o, w, p, a, s = o[order], w[order], p[order], a[order], s[order]
        first = np.concatenate(([True], (a[1:] != a[:-1]) | (s[1:] != s[:-1])))
        lead = np.maximum.accumulate(np.where(first, np.arange(len(a)), 0))
        later = (o != o[lead]) | (p != p[lead])
        keep = later | first | (w != w[lead])
        a = np.where(later, mix(o.view(np.uint64) ^ mix(p.astype(np.uint64))), a)  # dealt anywhere: it needs no one
        return pa.RecordBatch.from_arrays([pa.array(x[keep]) for x in (later, a.view(np.int64), s.view(np.int64), o, w, p.astype(np.int32))], schema=_FOUND)

    def flush(ids: list, twins: list, raws: list) -> None:
        """Long texts are cut into overlapping parts, whose anchors count inside their own PIECE bytes."""
        parts = [(k, s, max(0, s - 2 * WINDOW)) for k, r in enumerate(raws) for s in range(0, max(1, len(r)), PIECE)]
        for g in range(0, len(parts), 1 if len(parts) > len(raws) else len(parts)):
            own = parts[g : g + 1] if len(parts) > len(raws) else parts
            d, p, a, s = anchors([raws[k][lo : at + PIECE + 2 * WINDOW] for k, at, lo in own])
            k, at, lo = (np.array(x, np.int64)[d] for x in zip(*own, strict=True))
            p = p + lo
            on = (p >= at) & (p < at + PIECE)
            held.append((np.array(ids, np.int64)[k[on]], np.array(twins, np.int64)[k[on]], p[on], a[on], s[on]))

    ids, twins, raws, size = [], [], [], 0
    for b in batches:
        for i, w, t in zip(b.column("ord").to_pylist(), b.column("twin").to_pylist(), b.column("text").to_pylist(), strict=True):
            ids.append(i), twins.append(w), raws.append((t or "").encode("utf-8", "surrogatepass"))
            size += len(raws[-1])
            if size >= PIECE:
                flush(ids, twins, raws)
                ids, twins, raws, size = [], [], [], 0
                if sum(len(x[0]) for x in held) >= MERGED:
                    yield merged()
    if ids:
        flush(ids, twins, raws)
    if held:
        yield merged()


def _packed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    press = zstandard.ZstdCompressor(level=1)
    for b in batches:
        yield pa.RecordBatch.from_arrays(
            [b.column("doc_id"), b.column("ord"), b.column("twin"), pa.array([press.compress((t or "").encode("utf-8", "surrogatepass")) for t in b.column("text").to_pylist()], pa.binary())], ["doc_id", "ord", "twin", "packed"]
        )


_AROUND = "anchor long, crowded boolean, ord long, twin long, pos int, reach int, bytes binary"


def _surroundings(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    unpack = zstandard.ZstdDecompressor()
    for b in batches:
        out: list[list] = [[] for _ in range(7)]
        for o, w, packed, asked in zip(*(b.column(c).to_pylist() for c in ("ord", "twin", "packed", "asked")), strict=True):
            raw = unpack.decompress(packed)
            for x in asked:
                p = x["pos"]
                lo = max(0, p - REACH)
                for column, v in zip(out, (x["anchor"], x["crowded"], o, w, p, p - lo, raw[lo : p + WINDOW]), strict=True):
                    column.append(v)
        types = (pa.int64(), pa.bool_(), pa.int64(), pa.int64(), pa.int32(), pa.int32(), pa.binary())
        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(out, types, strict=True)], ["anchor", "crowded", "ord", "twin", "pos", "reach", "bytes"])


def _starts(around: list[bytes], reach: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Of all strings of WINDOW bytes in the surroundings: row, start before the anchor, and place in raw, the joined bytes."""
    sizes = np.array([len(x) for x in around], np.int64)
    begin = np.cumsum(sizes) - sizes
    n = np.maximum(0, sizes - WINDOW + 1)
    row = np.repeat(np.arange(len(around)), n)
    off = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
    return row, reach[row] - off, begin[row] + off, np.frombuffer(b"".join(around), np.uint8)


def suffix_order(raw: np.ndarray, starts: np.ndarray, width: int = WINDOW) -> tuple[np.ndarray, np.ndarray]:
    """The order of raw[s : s + width] over `starts`, by prefix doubling, and which are equal to the one before in it."""

    def ranked(key: np.ndarray) -> np.ndarray:
        order = np.argsort(key)
        in_order = key[order]
        rank = np.empty(len(key), np.uint64)
        rank[order] = np.cumsum(np.concatenate(([0], (in_order[1:] != in_order[:-1]).astype(np.int64))))[: len(key)].astype(np.uint64)
        return rank

    padded = np.concatenate((raw, np.zeros(width, np.uint8)))
    key, have = np.zeros(len(raw), np.uint64), 8
    for k in range(8):
        key = key << np.uint64(8) | padded[k : k + len(raw)].astype(np.uint64)
    rank = ranked(key)
    while have * 2 <= width:  # ranks are below 2**32, as a batch is
        tail = np.concatenate((rank[have:], np.zeros(min(have, len(rank)), np.uint64)))[: len(rank)]
        rank, have = ranked(rank << np.uint64(32) | tail), have * 2
    key = rank[starts] << np.uint64(32) | rank[np.minimum(starts + width - have, max(0, len(raw) - 1))]
    order = np.argsort(key)
    return order, np.concatenate(([False], key[order][1:] == key[order][:-1]))[: len(order)]


def previous_factors(pos: np.ndarray, common: np.ndarray) -> np.ndarray:
    """Longest previous factors of suffixes in suffix order: `pos` is each one's place in the text, `common` what it shares with the one before.

    The nearest suffix on each side with a smaller place is found by following the pointers of those between,
    which halves the way in each round; what is shared with it is the least of `common` on the way.
    """
    best = np.zeros(len(pos), common.dtype)
    for side in (1, -1):
        p = pos[::side]
        # Backwards, a suffix shares with the one behind it what that one shares with it.
        shared = common.copy() if side == 1 else np.concatenate((common[:1] * 0, common[:0:-1]))
        at = np.arange(len(p)) - 1
        todo = np.flatnonzero((shared > 0) & (at >= 0))
        todo = todo[p[at[todo]] >= p[todo]]
        while len(todo):
            over = at[todo]
            shared[todo], at[todo] = np.minimum(shared[todo], shared[over]), at[over]
            todo = todo[(at[todo] >= 0) & (shared[todo] > 0)]
            todo = todo[p[at[todo]] >= p[todo]]
        best = np.maximum(best, np.where(at >= 0, shared, 0)[::side])
    return best


def _runs(ord_: np.ndarray, twin: np.ndarray, pos: np.ndarray) -> pa.RecordBatch:
    """Byte ranges of repeated starts (of which each row is one), merged where they follow each other."""
    order = np.lexsort((pos, twin, ord_))
    o, w, p = ord_[order], twin[order], pos[order]
    new = np.concatenate(([True], (o[1:] != o[:-1]) | (w[1:] != w[:-1]) | (p[1:] > p[:-1] + WINDOW)))[: len(o)]
    head = np.flatnonzero(new)
    last = np.append(head[1:], len(o)) - 1
    return pa.RecordBatch.from_arrays([pa.array(o[head], pa.int64()), pa.array(w[head], pa.int64()), pa.array(p[head], pa.int32()), pa.array(p[last[: len(head)]] + WINDOW, pa.int32())], ["ord", "twin", "lo", "hi"])


def _compared(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows come sorted by anchor; whole anchors are taken together, some thousand rows at once."""

    def done(rows: pa.Table) -> pa.RecordBatch:
        rows = rows.combine_chunks()
        o, w, pos, reach = (rows.column(c).to_numpy() for c in ("ord", "twin", "pos", "reach"))
        row, before, at, raw = _starts(rows.column("bytes").to_pylist(), reach.astype(np.int64))
        start = pos[row] - before
        order, equal = suffix_order(raw, at)
        row, start = row[order], start[order]
        place = np.empty(len(row), np.int64)  # in the text; rows of equal ord and start have one place
        by = np.lexsort((start, o[row]))
        place[by] = np.cumsum(np.concatenate(([0], ((start[by][1:] != start[by][:-1]) | (o[row[by]][1:] != o[row[by]][:-1])).astype(np.int64))))[: len(by)]
        later = previous_factors(place, np.where(equal, WINDOW, 0)) >= WINDOW
        return _runs(o[row[later]], w[row[later]], start[later])

    rest: pa.Table | None = None
    for b in batches:
        if not b.num_rows:
            continue
        t = pa.Table.from_batches([b])
        rest = t if rest is None else pa.concat_tables([rest, t])
        if rest.num_rows >= 4 * CROWD:
            a = rest.column("anchor").to_numpy()
            cut = int(np.searchsorted(a, a[-1]))
            if cut:
                yield done(rest.slice(0, cut))
                rest = rest.slice(cut)
    if rest is not None and rest.num_rows:
        yield done(rest)


_FINER = "whole boolean, anchor long, around long, ord long, twin long, pos int, reach int, hi int, bytes binary"


def _finer(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Finer anchors of crowded ones; of equal surroundings in a task only the first keeps its bytes."""
    held: list[tuple[np.ndarray, ...]] = []
    kept: list[bytes] = []

    def merged() -> pa.RecordBatch:
        o, w, p, a, s, reach, hi, src = (np.concatenate(x) for x in zip(*held, strict=True))
        held.clear()
        order = np.lexsort((p, o, s, a))
        o, w, p, a, s, reach, hi, src = (x[order] for x in (o, w, p, a, s, reach, hi, src))
        first = np.concatenate(([True], (a[1:] != a[:-1]) | (s[1:] != s[:-1])))
        lead = np.maximum.accumulate(np.where(first, np.arange(len(a)), 0))
        later = (o != o[lead]) | (p != p[lead])
        a = np.where(later, mix(o.view(np.uint64) ^ mix(p.astype(np.uint64))), a)
        own = [None if x else kept[k][at : at + n] for x, (k, at), n in zip(later.tolist(), src.tolist(), (hi - p + reach).tolist(), strict=True)]
        columns = [(later, pa.bool_()), (a.view(np.int64), pa.int64()), (s.view(np.int64), pa.int64()), (o, pa.int64()), (w, pa.int64()), (p, pa.int32()), (reach, pa.int32()), (hi, pa.int32()), (own, pa.binary())]
        kept.clear()
        return pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in columns], ["whole", "anchor", "around", "ord", "twin", "pos", "reach", "hi", "bytes"])

    for b in batches:
        if not b.num_rows:
            continue
        anchor, o, w, pos, reach = (b.column(c).to_numpy(zero_copy_only=False) for c in ("anchor", "ord", "twin", "pos", "reach"))
        raws = b.column("bytes").to_pylist()
        size = np.array([len(x) for x in raws], np.int64)
        begin, total, reach = np.cumsum(size) - size, sums(np.frombuffer(b"".join(raws), np.uint8)), reach.astype(np.int64)
        at = begin + reach  # of the anchor
        for n, near in enumerate(range(0, REACH + 1, SPREAD)):
            most, least = np.minimum(min(near + SPREAD - 1, REACH), reach), np.maximum(near, WINDOW - (size - reach))
            i = np.flatnonzero(least <= most)
            far, core = min(near + SPREAD - 1, REACH), at[i] - near
            key = mix(ranges(total, core, at[i] + WINDOW - far) ^ mix(anchor[i].view(np.uint64) + np.uint64(n)))
            lo, hi = at[i] - most[i], at[i] - least[i] + WINDOW
            around = mix(ranges(total, lo, hi) ^ mix(most[i].astype(np.uint64)))
            source = np.stack((i + len(kept), lo - begin[i]), axis=1)
            held.append((o[i], w[i], pos[i].astype(np.int64), key, around, most[i], pos[i] - least[i] + WINDOW, source))
        kept += raws
        if sum(len(x[0]) for x in held) >= MERGED:
            yield merged()
    if held and sum(len(x[0]) for x in held):
        yield merged()


def _ranked(found: DataFrame, crowd: int) -> DataFrame:
    """With `repeated` (its surroundings stand earlier), `crowded`, and only what is repeated or has others to be compared to."""
    same = Window.partitionBy("anchor", "around").orderBy("ord", "pos")
    ranked = (
        found.repartition("anchor")
        .withColumn("first", F.first(F.struct("ord", "pos")).over(same))
        .withColumn("nth", F.row_number().over(same))
        .withColumn("differ", F.sum((F.col("nth") == 1).cast("long")).over(Window.partitionBy("anchor")))
    )
    repeated = F.col("whole") | (F.col("first.ord") != F.col("ord")) | (F.col("first.pos") != F.col("pos"))
    return ranked.withColumn("whole", repeated).withColumn("crowded", F.col("differ") > crowd).where("whole OR differ > 1").drop("first", "nth", "differ", "around")


def _spelled(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Every string of the surroundings of crowded anchors, for a grouped minimum."""
    for b in batches:
        if b.num_rows:
            anchor, o, w, pos, reach = (b.column(c).to_numpy() for c in ("anchor", "ord", "twin", "pos", "reach"))
            row, before, at, raw = _starts(b.column("bytes").to_pylist(), reach.astype(np.int64))
            one, two = ranges(sums(raw), at, at + WINDOW), ranges(sums(raw ^ np.uint8(0x5A)), at, at + WINDOW)
            keys = [mix(h ^ mix(anchor[row].view(np.uint64) + before.astype(np.uint64))) for h in (one, mix(two + one))]
            yield pa.RecordBatch.from_arrays(
                [*(pa.array(k.view(np.int64)) for k in keys), pa.array(o[row]), pa.array(w[row]), pa.array((pos[row] - before).astype(np.int32))], ["key", "key2", "ord", "twin", "start"]
            )


_RESULT = "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string, spans array<struct<lo:bigint,hi:bigint>>"


def _cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    unpack = zstandard.ZstdDecompressor()
    for b in batches:
        sizes, removed, counts, digests, spans = [], [], [], [], []
        for packed, runs in zip(b.column("packed").to_pylist(), b.column("runs").to_pylist(), strict=True):
            raw = unpack.decompress(packed)
            merged: list[list[int]] = []
            for lo, hi in sorted((x["lo"], min(x["hi"], len(raw))) for x in runs or ()):
                if merged and lo <= merged[-1][1]:
                    merged[-1][1] = max(merged[-1][1], hi)
                else:
                    merged.append([lo, hi])
            digest, last = hashlib.sha256(), 0
            for lo, hi in merged:
                digest.update(raw[last:lo])
                last = hi
            digest.update(raw[last:])
            sizes.append(len(raw)), removed.append(sum(hi - lo for lo, hi in merged)), counts.append(len(merged)), digests.append(digest.hexdigest()), spans.append([{"lo": x, "hi": y} for x, y in merged])
        yield pa.RecordBatch.from_arrays(
            [b.column("doc_id"), pa.array(sizes, pa.int64()), pa.array(removed, pa.int64()), pa.array(counts, pa.int64()), pa.array(digests, pa.string()), pa.array(spans, pa.list_(pa.struct([("lo", pa.int64()), ("hi", pa.int64())])))],
            ["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256", "spans"],
        )


def remove_repeats(docs: DataFrame, crowd: int = CROWD) -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans, kept_sha256 and the removed spans (of bytes) of every row."""
    spark = docs.sparkSession
    small_batches(spark)
    rows = texts(docs).withColumn("ord", F.coalesce("doc_id", F.lit(_LEAST)))
    twins = rows.groupBy("ord").count().where("count > 1").limit(1).count() > 0
    rows = rows.withColumn("twin", F.xxhash64("text") if twins else F.lit(0).cast("long"))

    found = rows.select("ord", "twin", "text").mapInArrow(_anchored, "whole boolean, anchor long, around long, ord long, twin long, pos int")
    state = materialize(spark, _ranked(found, crowd).select("ord", "twin", "pos", "anchor", "whole", "crowded"), "repeats-anchors")

    packed = rows.mapInArrow(_packed, "doc_id long, ord long, twin long, packed binary")
    asked = state.where("NOT whole").groupBy("ord", "twin").agg(F.collect_set(F.struct("pos", "anchor", "crowded")).alias("asked"))
    unique = packed.select("ord", "twin", "packed").join(asked, ["ord", "twin"])
    around = unique.mapInArrow(_surroundings, _AROUND)
    runs = state.where("whole").select("ord", "twin", F.greatest(F.col("pos") - REACH, F.lit(0)).alias("lo"), (F.col("pos") + WINDOW).alias("hi"))
    quiet = around.where("NOT crowded").select("anchor", "ord", "twin", "pos", "reach", "bytes")
    if state.where("NOT whole AND crowded").limit(1).count():
        around = materialize(spark, around, "repeats-around")
        quiet = around.where("NOT crowded").select("anchor", "ord", "twin", "pos", "reach", "bytes")
        finer = materialize(spark, _ranked(around.where("crowded").mapInArrow(_finer, _FINER), crowd).withColumn("bytes", F.when(~F.col("whole"), F.col("bytes"))), "repeats-finer")
        quiet = quiet.unionByName(finer.where("NOT whole AND NOT crowded").select(*quiet.columns))
        spelled = finer.where("NOT whole AND crowded").mapInArrow(_spelled, "key long, key2 long, ord long, twin long, start int")
        least = spelled.groupBy("key", "key2").agg(F.min(F.struct("ord", "start")).alias("least"))
        again = spelled.join(least, ["key", "key2"]).where("ord <> least.ord OR start <> least.start").select("ord", "twin", F.col("start").alias("lo"), (F.col("start") + WINDOW).alias("hi"))
        runs = runs.unionByName(finer.where("whole").select("ord", "twin", (F.col("pos") - F.col("reach")).alias("lo"), "hi")).unionByName(again)
    compared = quiet.repartition("anchor").sortWithinPartitions("anchor", "ord", "pos").mapInArrow(_compared, "ord long, twin long, lo int, hi int")
    runs = runs.unionByName(compared)
    marks = materialize(spark, runs.groupBy("ord", "twin").agg(F.collect_set(F.struct("lo", "hi")).alias("runs")), "repeats-marks")
    return packed.join(marks, ["ord", "twin"], "left").select("doc_id", "packed", "runs").mapInArrow(_cut, _RESULT)


def op10_repeats(spark, sf_dir: str) -> DataFrame:
    return remove_repeats(documents(spark, sf_dir)).select("doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256")
