"""Near duplicates by circulant MinHash, banding and exact verification.

A document's set holds its distinct 5-word shingles as 64-bit hashes. Two permutations make its whole
signature: the first (a hash) gives each shingle a place among 2**18, the second is a table of ranks that
is shifted round by one place for each coordinate; so coordinate k is the smallest rank at (place + k),
and a shingle's part in all coordinates is one contiguous run of the table. 36 bands of 6 coordinates
let a pair of similarity 0.85 slip by with probability 4e-8.

Documents of equal sets are one node. In each bucket (band, hash) every node is first compared, on full
sets, to the bucket's pivot: the node that shares most buckets with others, which is what copies of one
original have in common. Links join nodes to components. A bucket whose nodes are one component can't
change any component. Of the others each pair of nodes of different components is compared, unless sizes
or distances to the pivot (Jaccard distance is a metric) rule out a link. Buckets that would make many
pairs, such as those of a passage that many documents share, are searched by rare shingles instead: two
sets of similarity 0.85 share one of the rarest 15 hundredths of each, in whatever order of rarity. So no
bucket is capped, no group's pairs are all made, and no link between components is lost.

Nulls: a null or empty text has an empty set, is linked with nothing and is its own component. A null id
is never smaller than another; a component of null ids only has a null id, and its rows are kept.
Repeated rows have equal sets and so share a component; each row of the kept id is kept. Other columns
are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from millrace.llm.bytehash import mix, shingles, word_hashes
from millrace.llm.common import documents, materialize, small_batches, texts
from millrace.llm.components import components

BANDS, ROWS, PLACES = 36, 6, 2**18
#: A link has DENOMINATOR * shared >= NUMERATOR * union.
NUMERATOR, DENOMINATOR = 85, 100
#: Buckets with more than so many open pairs a row are searched by rare shingles.
CROWDED = 10
#: Shingles of a set that is compared inside the join of such a search.
ALONG = 512
#: Cells of the table of frequencies by which shingles are ordered.
CELLS = 2**20
#: Members of a bucket that are compared to its pivot together; larger buckets are dealt in parts of about that size.
PART = 256
#: Sets that a task remembers, so that it signs copies once.
MEMO = 2**18
#: Bytes of text that a task takes apart together, and shingles of the sets that it keeps for pairs to come.
TOGETHER, KEPT = 2**20, 2**22

_table: np.ndarray | None = None


def ranks() -> np.ndarray:
    """The second permutation, wrapped round so that each run of coordinates is contiguous."""
    global _table
    if _table is None:
        p = np.random.default_rng(20240229).permutation(PLACES).astype(np.uint32)
        _table = np.concatenate((p, p[: BANDS * ROWS]))
    return _table


def signature(sets: np.ndarray) -> np.ndarray:
    """BANDS * ROWS coordinates of one set of shingles."""
    place = (mix(sets ^ np.uint64(0xA5A5F00D5EED1234)) & np.uint64(PLACES - 1)).astype(np.int64)
    runs = np.lib.stride_tricks.sliding_window_view(ranks(), BANDS * ROWS)
    out = np.full(BANDS * ROWS, np.iinfo(np.uint32).max, np.uint32)
    for i in range(0, len(place), 256):
        np.minimum(out, runs[place[i : i + 256]].min(axis=0), out=out)
    return out


def band_keys(sig: np.ndarray) -> np.ndarray:
    """One 64-bit key for each band of each signature, the band's number within."""
    s = sig.reshape(len(sig), BANDS, ROWS).astype(np.uint64)
    key = np.broadcast_to(mix(np.arange(1, BANDS + 1, dtype=np.uint64)), s.shape[:2])
    for r in range(ROWS):
        key = mix(key * np.uint64(0x9E3779B97F4A7C15) + s[:, :, r])
    return key.view(np.int64)


def _bounded(batch: pa.RecordBatch, sizes: np.ndarray) -> Iterator[pa.RecordBatch]:
    """The batch in slices of rows whose sizes add up to TOGETHER at most, or of one larger row: a batch is bounded in rows, not in bytes."""
    lo, total = 0, 0
    for i, size in enumerate(sizes.tolist()):
        if i > lo and total + size > TOGETHER:
            yield batch.slice(lo, i - lo)
            lo, total = i, 0
        total += size
    if lo < len(sizes):
        yield batch.slice(lo)


def _signed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Of equal sets in a task only the first has keys and text, so that copies don't meet with theirs in one task later."""
    press = zstandard.ZstdCompressor(level=1)
    seen: set[bytes] = set()
    for b in (part for whole in batches for part in _bounded(whole, pc.fill_null(pc.binary_length(whole.column("text")), 0).to_numpy(zero_copy_only=False))):
        own = [t or "" for t in b.column("text").to_pylist()]
        sets = shingles(*word_hashes(own))
        nodes = [xxhash.xxh3_128_digest(s.tobytes()) if len(s) else None for s in sets]
        firsts = []
        for i, node in enumerate(nodes):
            if node is not None and node not in seen:
                seen.add(node), firsts.append(i)
        if len(seen) > MEMO:  # a set that comes again then has keys again, which are equal
            seen.clear()
        keys: list = [None] * len(own)
        packed: list = [None] * len(own)
        if firsts:
            got = band_keys(np.stack([signature(sets[i]) for i in firsts]))
            for i, k in zip(firsts, got, strict=True):
                keys[i], packed[i] = k, press.compress(own[i].encode("utf-8", "surrogatepass"))
        yield pa.RecordBatch.from_arrays(
            [b.column("doc_id"), pa.array([len(s) for s in sets], pa.int64()), pa.array(nodes, pa.binary()), pa.array(keys, pa.list_(pa.int64())), pa.array(packed, pa.binary())],
            ["doc_id", "n_shingles", "node", "keys", "packed"],
        )


def _shared(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Verification on full sets; a pivot's set is made once for a run of its pairs."""
    unpack = zstandard.ZstdDecompressor()
    memo: dict[bytes, np.ndarray] = {}
    kept = 0

    def sets(node: bytes, packed: bytes) -> np.ndarray:
        nonlocal kept
        got = memo.get(node)
        if got is None:
            if len(memo) >= 256 or kept > KEPT:
                memo.clear()
                kept = 0
            got = memo[node] = shingles(*word_hashes([unpack.decompress(packed).decode("utf-8", "surrogatepass")]))[0]
            kept += len(got)
        return got

    for b in batches:
        a, x, pa_, px = (b.column(c).to_pylist() for c in ("a", "b", "packed_a", "packed_b"))
        n = [(len(s), len(t), len(np.intersect1d(s, t, assume_unique=True))) for s, t in ((sets(i, p), sets(j, q)) for i, j, p, q in zip(a, x, pa_, px, strict=True))]
        yield pa.RecordBatch.from_arrays([b.column("a"), b.column("b"), pa.array([k for *_, k in n], pa.int64()), pa.array([s + t - k for s, t, k in n], pa.int64())], ["a", "b", "shared", "union"])


def verified(pairs: DataFrame, nodes: DataFrame) -> DataFrame:
    """(a, b) with shared and union of their full sets, and whether that is a link."""
    side = nodes.select("node", "packed")
    got = pairs.join(side.withColumnsRenamed({"node": "b", "packed": "packed_b"}), "b").join(side.withColumnsRenamed({"node": "a", "packed": "packed_a"}), "a")
    out = got.select("a", "b", "packed_a", "packed_b").mapInArrow(_shared, "a binary, b binary, shared long, union long")
    return out.withColumn("link", F.col("shared") * DENOMINATOR >= F.col("union") * NUMERATOR)


def classify(docs: DataFrame) -> DataFrame:
    """doc_id, n_shingles, component_id, kept: one row for each row of docs."""
    spark = docs.sparkSession
    small_batches(spark)
    signed = materialize(spark, texts(docs).mapInArrow(_signed, "doc_id long, n_shingles long, node binary, keys array<bigint>, packed binary"), "minhash-signed")
    full = signed.where("node IS NOT NULL")
    firsts = full.where("keys IS NOT NULL")  # one a task for each of its sets
    nodes = full.groupBy("node").agg(F.min("doc_id").alias("least"), F.max("n_shingles").alias("n"))
    nodes = materialize(spark, nodes, "minhash-nodes")
    # Of equal sets, the row that stands for them all is any of them: keys are equal.
    keyed = firsts.groupBy("node").agg(F.any_value("keys").alias("keys")).select("node", F.explode("keys").alias("key"))
    buckets = keyed.groupBy("key").agg(F.count("*").alias("size")).where("size > 1")
    members = materialize(spark, keyed.join(buckets, "key"), "minhash-members")  # only buckets of two or more
    degree = members.groupBy("node").agg(F.sum("size").alias("degree"))
    packed = firsts.select("node", "packed").join(degree, "node").groupBy("node").agg(F.max("packed").alias("packed"))
    packed = materialize(spark, packed, "minhash-packed")
    sizes = nodes.select("node", "n")

    def possible(pairs: DataFrame) -> DataFrame:
        """Without those whose sizes rule out a link."""
        a, b = sizes.withColumnsRenamed({"node": "a", "n": "na"}), sizes.withColumnsRenamed({"node": "b", "n": "nb"})
        return pairs.join(a, "a").join(b, "b").where(F.least("na", "nb") * DENOMINATOR >= F.greatest("na", "nb") * NUMERATOR).select("a", "b")

    tested = materialize(spark, verified(possible(_pivoted(members.join(degree, "node"))), packed), "minhash-tested")
    roots = components(tested.where("link").select("a", "b"))
    open_ = materialize(spark, _open(members, roots), "minhash-open")
    load = open_.groupBy("key", "root").agg(F.count("*").alias("k")).groupBy("key").agg(F.sum("k").alias("rows"), F.sum(F.col("k") * F.col("k")).alias("own"))
    crowded = load.where((F.col("rows") * F.col("rows") - F.col("own")) / 2 > CROWDED * F.col("rows")).select("key")
    pairs = _rest(open_.join(crowded, "key", "left_anti"), tested).unionByName(_by_rare_shingles(open_.join(crowded, "key", "left_semi"), packed))
    fresh = possible(pairs.distinct().join(tested.select("a", "b"), ["a", "b"], "left_anti"))
    more = materialize(spark, verified(fresh, packed).where("link"), "minhash-more")
    label = roots.join(nodes.select("node", "least"), "node").groupBy("root").agg(F.min("least").alias("component"))
    if more.limit(1).count():
        roots, label = _joined(more, roots, nodes)
    of_node = nodes.select("node", "least").join(roots, "node", "left").join(label, "root", "left").select("node", F.coalesce("component", "least").alias("component"))
    return signed.select("doc_id", "n_shingles", "node").join(of_node, "node", "left").select(
        "doc_id", "n_shingles", F.when(F.col("node").isNull(), F.col("doc_id")).otherwise(F.col("component")).alias("component_id")
    ).withColumn("kept", F.col("doc_id").eqNullSafe(F.col("component_id")))


def _joined(more: DataFrame, roots: DataFrame, nodes: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Roots with nodes that only the links of `more` have, and each root's smallest id once these links join their components."""
    ends = more.select(F.explode(F.array("a", "b")).alias("node")).distinct()
    roots = roots.unionByName(ends.join(roots, "node", "left_anti").select("node", F.col("node").alias("root")))
    roots = materialize(more.sparkSession, roots, "roots")
    a, b = roots.withColumnsRenamed({"node": "a", "root": "ra"}), roots.withColumnsRenamed({"node": "b", "root": "rb"})
    above = components(more.join(a, "a").join(b, "b").where("ra <> rb").select(F.col("ra").alias("a"), F.col("rb").alias("b")))
    own = roots.join(nodes.select("node", "least"), "node").groupBy("root").agg(F.min("least").alias("own"))
    own = own.join(above.withColumnsRenamed({"root": "top", "node": "root"}), "root", "left").withColumn("top", F.coalesce("top", "root"))
    least = own.groupBy("top").agg(F.min("own").alias("component"))
    return roots, own.join(least, "top").select("root", "component")


def _pivoted(ranked: DataFrame) -> DataFrame:
    """Pairs of each bucket's nodes with its pivot, that of the largest degree; a large bucket's pivot goes to each part of it."""
    parts = F.ceil(F.col("size") / PART)
    pivots = ranked.groupBy("key").agg(F.max(F.struct("degree", "node")).alias("p"), F.first("size").alias("size"))
    pivots = pivots.select("key", F.col("p.node").alias("pivot"), F.explode(F.sequence(F.lit(0).cast("long"), parts - 1)).alias("part"))
    dealt = ranked.select("key", "node", F.pmod(F.xxhash64("node"), parts).alias("part"))
    met = dealt.join(pivots, ["key", "part"]).where("node <> pivot")
    return met.select(F.least("node", "pivot").alias("a"), F.greatest("node", "pivot").alias("b")).distinct()


def _open(members: DataFrame, roots: DataFrame) -> DataFrame:
    """(key, node, root) of buckets that hold nodes of more than one component."""
    placed = members.select("key", "node").join(roots, "node", "left").withColumn("root", F.coalesce("root", "node"))
    mixed = placed.groupBy("key").agg(F.min("root").alias("lo"), F.max("root").alias("hi")).where("lo <> hi").select("key")
    return placed.join(mixed, "key")


def _rest(open_: DataFrame, tested: DataFrame) -> DataFrame:
    """Every pair of different components in a bucket that distances to its pivot don't rule out.

    For any node p, a link (x, y) has |d(p, x) - d(p, y)| <= 1 - NUMERATOR / DENOMINATOR. Each bucket's
    nodes are dealt by their distance to the node that met most of them into slices of that width, and
    only nodes of the same or of neighbouring slices are compared.
    """
    width = 1 - NUMERATOR / DENOMINATOR
    met = tested.select(F.col("a").alias("p"), F.col("b").alias("node"), (1 - F.col("shared") / F.col("union")).alias("d"))
    met = met.unionByName(met.select(F.col("node").alias("p"), F.col("p").alias("node"), "d"))
    known = open_.join(met, "node").groupBy("key", "p").agg(F.count("*").alias("n"))
    best = known.groupBy("key").agg(F.max_by("p", F.struct("n", "p")).alias("p"))
    dealt = open_.join(best, "key", "left").join(met, ["p", "node"], "left").withColumn("slice", F.floor(F.col("d") / F.lit(width + 1e-9)))
    # A node that the pivot never met (its size ruled it out, or it shares its component) may stand anywhere.
    spots = F.when(F.col("slice").isNull(), F.sequence(F.lit(0).cast("long"), F.lit(8).cast("long"))).otherwise(F.array(F.col("slice"), F.col("slice") + 1))
    placed = dealt.select("key", "node", "root", F.explode(spots).alias("at"))
    return _across(placed, ["key", "at"])


def _across(rows: DataFrame, on: list[str]) -> DataFrame:
    """Distinct pairs of nodes of different components that meet in the columns `on`."""
    x, y = rows.alias("x"), rows.alias("y")
    where = (F.col("x.root") != F.col("y.root")) & (F.col("x.node") < F.col("y.node"))
    for c in on:
        where = where & (F.col(f"x.{c}") == F.col(f"y.{c}"))
    return x.join(y, where).select(F.col("x.node").alias("a"), F.col("y.node").alias("b")).distinct()


def _sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    unpack = zstandard.ZstdDecompressor()
    for whole in batches:
        sizes = np.array([zstandard.frame_content_size(p) for p in whole.column("packed").to_pylist()], np.int64)
        for b in _bounded(whole, sizes):
            got = shingles(*word_hashes([unpack.decompress(p).decode("utf-8", "surrogatepass") for p in b.column("packed").to_pylist()]))
            offsets = np.concatenate(([0], np.cumsum([len(s) for s in got])))
            flat = pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), pa.array(np.concatenate(got).view(np.int64)))
            yield pa.RecordBatch.from_arrays([b.column("node"), b.column("root"), pa.array(np.diff(offsets)), flat], ["node", "root", "n", "s"])


def _frequencies(sets: DataFrame) -> np.ndarray:
    """How often shingles of each of CELLS cells come: as many numbers whatever the number of documents."""

    def counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(CELLS, np.int64)
        for b in batches:
            total += np.bincount(b.column("s").flatten().to_numpy() & (CELLS - 1), minlength=CELLS)
        at = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(at), pa.array(total[at])], ["cell", "n"])

    got = sets.select("s").mapInArrow(counted, "cell long, n long").groupBy("cell").agg(F.sum("n").alias("n")).toArrow()
    out = np.zeros(CELLS, np.int64)
    out[got.column("cell").to_numpy()] = got.column("n").to_numpy()
    return np.minimum(out, 2**31 - 1).astype(np.int32)


def _by_rare_shingles(open_: DataFrame, packed: DataFrame) -> DataFrame:
    """Pairs of different components that share one of their rarest shingles, as any link does.

    In one order of shingles for all (by the frequency of their cell, then by hash), a link's larger set has one of
    its first 15 hundredths among the first 8 of the smaller one, at places behind which enough is left for both.
    """
    own = open_.select("node", "root").distinct().join(packed, "node")
    sets = materialize(open_.sparkSession, own.mapInArrow(_sets, "node binary, root binary, n long, s array<bigint>"), "minhash-shingles")
    often = _frequencies(sets)
    both = NUMERATOR + DENOMINATOR  # a link of sizes n and m shares NUMERATOR * (n + m) / both at least

    def ranked(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """The first places of each set; a shingle alone in its cell meets nobody and is left out."""
        for b in (part for whole in batches for part in _bounded(whole, 8 * whole.column("n").to_numpy())):
            rows: list[list] = [[] for _ in range(7)]
            for node, root, s in zip(b.column("node").to_pylist(), b.column("root").to_pylist(), b.column("s"), strict=True):
                s = s.values.to_numpy()
                n, f = len(s), often[s & (CELLS - 1)]
                order = np.lexsort((s, f))[: n - -(-n * NUMERATOR // DENOMINATOR) + 1]
                firsts = s[order[f[order] > 1]]
                alone = len(order) - len(firsts)
                for column, v in zip(rows, (node, root, n, firsts, alone, firsts if n <= 4 * ALONG else None, s if n <= ALONG else None), strict=True):
                    column.append(v)
            types = (pa.binary(), pa.binary(), pa.int64(), pa.list_(pa.int64()), pa.int64(), pa.list_(pa.int64()), pa.list_(pa.int64()))
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(rows, types, strict=True)], ["node", "root", "n", "places", "alone", "firsts", "set"])

    # Small sets go along, so that the join itself compares them and only links come out of it; and of the shingles
    # that two prefixes share only the first makes a pair. Large sets are not repeated for each of their shingles.
    placed = sets.mapInArrow(ranked, "node binary, root binary, n long, places array<bigint>, alone long, firsts array<bigint>, set array<bigint>")
    shares = placed.select("node", "root", "n", "firsts", "set", "alone", F.posexplode("places").alias("at", "s")).withColumn("place", F.col("alone") + F.col("at") + 1)
    fewer = shares.where(F.col("place") <= F.col("n") - F.ceil(F.col("n") * 2 * NUMERATOR / both) + 1)
    x, y = shares.alias("x"), fewer.alias("y")
    linked = F.size(F.array_intersect("x.set", "y.set")) * both >= (F.col("x.n") + F.col("y.n")) * NUMERATOR
    order = F.struct("x.n", "x.node") > F.struct("y.n", "y.node")
    reach = (1 + F.least(F.col("x.n") - F.col("x.place"), F.col("y.n") - F.col("y.place"))) * both >= (F.col("x.n") + F.col("y.n")) * NUMERATOR
    first = F.when(F.col("x.firsts").isNotNull() & F.col("y.firsts").isNotNull(), F.get(F.array_intersect("y.firsts", "x.firsts"), F.lit(0)) == F.col("x.s"))
    met = x.join(y, (F.col("x.s") == F.col("y.s")) & (F.col("x.root") != F.col("y.root")) & order & reach & F.coalesce(first, F.lit(True)) & F.coalesce(linked, F.lit(True)))
    return met.select(F.least("x.node", "y.node").alias("a"), F.greatest("x.node", "y.node").alias("b")).distinct()


def stage(spark, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pipeline stage: one document of each component stays, the one of the smallest id."""
    kept = classify(docs).where("kept").select("doc_id").distinct()
    columns = docs.columns
    rows = docs.withColumn("_id", F.col("doc_id").cast("long"))
    return rows.join(kept.withColumnRenamed("doc_id", "_kept"), F.col("_id").eqNullSafe(F.col("_kept")), "left_semi").select(*columns).dropDuplicates(["doc_id", "text"])


def op6_minhash(spark, sf_dir: str) -> DataFrame:
    return classify(documents(spark, sf_dir))
