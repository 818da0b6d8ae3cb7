"""Queries of sequence packing: cutting, filling windows, and what each policy makes of the same items."""

from __future__ import annotations

from bisect import bisect_left, insort
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from millrace.functions import text as T
from millrace.operators.ordered import prefix_sums
from millrace.plans.text import WORDS
from millrace.registry import query
from millrace.session import materialize, small_batches, table

LENGTH, LEAST_TAIL, GROUP = 256, 16, 100

_ITEMS = f"it AS (SELECT doc_id, lang, n FROM (SELECT doc_id, lang, len({WORDS}) AS n FROM documents) WHERE n > 0)"


def items(spark, sf) -> DataFrame:
    return table(spark, sf, "documents").select("doc_id", "lang", T.word_count("text").alias("n")).where("n > 0")


_STREAM = f"""st AS (SELECT *, sum(n) OVER (PARTITION BY lang ORDER BY doc_id) - n AS lo FROM it),
mb AS (SELECT lang, doc_id, lo, lo + n AS hi, unnest(range(CAST(lo // {LENGTH} AS BIGINT), CAST((lo + n - 1) // {LENGTH} + 1 AS BIGINT))) AS win FROM st),
cc AS (SELECT lang, win, count(*) AS members, sum(least(hi, (win + 1) * {LENGTH}) - greatest(lo, win * {LENGTH})) AS occupied FROM mb GROUP BY lang, win)"""
_CONCAT = f"{_ITEMS}, {_STREAM}"


def concat_chop(docs: DataFrame, length: int = LENGTH) -> DataFrame:
    """(lang, win, members, occupied): each lane as one stream, cut every `length` tokens."""
    placed = prefix_sums(docs, ["lang"], ["doc_id"], {"lo": F.col("n")}).withColumn("hi", F.col("lo") + F.col("n"))
    members = placed.select("lang", "lo", "hi", F.explode(F.sequence(F.floor(F.col("lo") / length), F.floor((F.col("hi") - 1) / length))).alias("win"))
    part = F.least("hi", (F.col("win") + 1) * length) - F.greatest("lo", F.col("win") * length)
    return members.groupBy("lang", "win").agg(F.count("*").alias("members"), F.sum(part).alias("occupied"))


@query("pack_concat_chop", f"WITH {_CONCAT} SELECT lang, CAST(win AS BIGINT) AS win, CAST(members AS BIGINT) AS members, CAST(occupied AS BIGINT) AS occupied FROM cc")
def pack_concat_chop(spark, sf):
    return concat_chop(items(spark, sf))


def pieces(docs: DataFrame) -> DataFrame:
    """(doc_id, lang, off, n): long items in pieces of a window's length; a tail of a few tokens is dropped."""
    rows = docs.select("doc_id", "lang", "n", F.explode(F.sequence(F.lit(0).cast("long"), F.col("n") - 1, F.lit(LENGTH).cast("long"))).alias("off"))
    return rows.where((F.col("n") <= LENGTH) | (F.col("n") - F.col("off") >= LEAST_TAIL)).select("doc_id", "lang", "off", F.least(F.lit(LENGTH).cast("long"), F.col("n") - F.col("off")).alias("n"))


@query("pack_chunk", f"""
WITH {_ITEMS}, c AS (SELECT doc_id, n, unnest(range(0, n, {LENGTH})) AS off FROM it)
SELECT doc_id, CAST(off AS BIGINT) AS off, CAST(least({LENGTH}, n - off) AS BIGINT) AS tokens FROM c WHERE n <= {LENGTH} OR n - off >= {LEAST_TAIL}""")  # fmt: skip
def pack_chunk(spark, sf):
    """Long items in pieces of a window's length; a tail of a few tokens is dropped."""
    return pieces(items(spark, sf)).select("doc_id", "off", F.col("n").alias("tokens"))


@query("pack_pad_only", f"WITH {_ITEMS} SELECT doc_id, CAST(least(n, {LENGTH}) AS BIGINT) AS occupied, CAST({LENGTH} - least(n, {LENGTH}) AS BIGINT) AS pad, n > {LENGTH} AS truncated FROM it")
def pack_pad_only(spark, sf):
    kept = F.least("n", F.lit(LENGTH).cast("long"))
    return items(spark, sf).select("doc_id", kept.alias("occupied"), (LENGTH - kept).alias("pad"), (F.col("n") > LENGTH).alias("truncated"))


def fill(sizes: list[int], policy: str, length: int = LENGTH) -> list[int]:
    """The bin of each item (no item is longer than a bin)."""
    room: list[int] = []
    bins = [-1] * len(sizes)
    order = list(range(len(sizes))) if policy == "greedy" else sorted(range(len(sizes)), key=lambda i: (-sizes[i], i))
    if policy == "long_context":
        left = [i for i in order if sizes[i] < length]
        for i in order[: len(order) - len(left)]:  # full ones stand first, and leave no room
            bins[i] = len(room)
            room.append(0)
        while left:
            space, rest = length, []
            for i in left:
                if sizes[i] <= space:
                    bins[i], space = len(room), space - sizes[i]
                else:
                    rest.append(i)
            room.append(space)
            left = rest
        return bins
    if policy == "greedy":
        open_: list[int] = []  # bins that have room left, in order
        for i in order:
            b = next((b for b in open_ if room[b] >= sizes[i]), len(room))
            if b == len(room):
                room.append(length)
                open_.append(b)
            room[b] -= sizes[i]
            if not room[b]:
                open_.remove(b)
            bins[i] = b
        return bins
    left_in: list[tuple[int, int]] = []  # (room, bin) of those that have room left, sorted
    n = 0
    for i in order:
        at = bisect_left(left_in, (sizes[i], -1))
        space, b = left_in.pop(at) if at < len(left_in) else (length, n)
        n = max(n, b + 1)
        if space > sizes[i]:
            insort(left_in, (space - sizes[i], b))
        bins[i] = b
    return bins


def packed(docs: DataFrame, policy: str) -> DataFrame:
    """(lang, grp, bin, doc_id, off, tokens, truncated): bins are filled inside groups of GROUP neighbouring ids.

    Documents come in `pieces`, none of which is longer than a window. Of an item that is (a sample that must
    not be cut in pieces) a window's length is placed, and `truncated` says so; `structure` gives such items a
    bin of their own, behind the others.
    """

    return packed_by(docs, (policy,)).drop("policy")


def bins_of(sizes: list[int], policy: str) -> list[int]:
    if policy != "structure":
        return fill([min(n, LENGTH) for n in sizes], policy)
    short = [i for i, n in enumerate(sizes) if n <= LENGTH]
    bins = dict(zip(short, fill([sizes[i] for i in short], "best_fit")))
    after = max(bins.values(), default=-1) + 1
    for k, i in enumerate(i for i, n in enumerate(sizes) if n > LENGTH):
        bins[i] = after + k
    return [bins[i] for i in range(len(sizes))]


def packed_by(docs: DataFrame, policies: tuple[str, ...]) -> DataFrame:
    """policy and the columns of `packed`, of several policies at once: a group is brought together once for all of them."""
    schema = pa.schema([("policy", pa.string()), ("lang", pa.string()), *((c, pa.int64()) for c in ("grp", "bin", "doc_id", "off", "tokens")), ("truncated", pa.bool_())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for lang, grp, ids, offs, sizes in zip(*(c.to_pylist() for c in batch.columns)):
                n, tokens = len(sizes), [min(x, LENGTH) for x in sizes]
                for policy in policies:
                    columns = [policy] * n, [lang] * n, [grp] * n, bins_of(sizes, policy), ids, offs, tokens, [x > LENGTH for x in sizes]
                    yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, schema.types)], schema=schema)

    small_batches(docs.sparkSession)
    grouped = docs.withColumn("grp", F.floor(F.col("doc_id") / GROUP)).groupBy("lang", "grp").agg(F.array_sort(F.collect_list(F.struct("doc_id", "off", "n"))).alias("m"))
    rows = grouped.select("lang", "grp", "m.doc_id", "m.off", "m.n")
    return rows.mapInArrow(run, "policy string, lang string, grp long, bin long, doc_id long, off long, tokens long, truncated boolean")


POLICIES = ("greedy", "best_fit", "structure", "long_context")


@query("pack_verify_pieces", f"""
WITH {_ITEMS}, c AS (SELECT n, unnest(range(0, n, {LENGTH})) AS off FROM it), p AS (SELECT unnest(['greedy', 'best_fit', 'structure', 'long_context']) AS policy),
t AS (SELECT count(*) AS items, sum(least({LENGTH}, n - off)) AS tokens FROM c WHERE n <= {LENGTH} OR n - off >= {LEAST_TAIL})
SELECT policy, CAST(items AS BIGINT) AS items, CAST(tokens AS BIGINT) AS tokens, CAST(0 AS BIGINT) AS over_full, CAST(0 AS BIGINT) AS truncated, CAST(0 AS BIGINT) AS placed_twice FROM p, t""")  # fmt: skip
def pack_verify_pieces(spark, sf):
    """Of each policy: pieces and tokens placed, bins over their capacity, pieces that are cut or in more than one bin."""
    return placed(pieces(items(spark, sf)))


def placed(docs: DataFrame) -> DataFrame:
    rows = materialize(docs.sparkSession, packed_by(docs, POLICIES), "packed")
    bins = rows.groupBy("policy", "lang", "grp", "bin").agg(F.count("*").alias("items"), F.sum("tokens").alias("tokens"), F.count_if("truncated").alias("truncated"))
    sums = bins.groupBy("policy").agg(F.sum("items").alias("items"), F.sum("tokens").alias("tokens"), F.count_if(F.col("tokens") > LENGTH).alias("over_full"), F.sum("truncated").alias("truncated"))
    twice = rows.groupBy("policy", "doc_id", "off").count().groupBy("policy").agg(F.count_if(F.col("count") > 1).alias("placed_twice"))
    every = docs.sparkSession.createDataFrame([(p,) for p in POLICIES], "policy string")  # a row each, whatever they were given
    return F.broadcast(every).join(sums.join(twice, "policy"), "policy", "left").na.fill(0, ["over_full", "placed_twice"])


@query("agg_utilisation", f"""
WITH {_CONCAT}, r AS (SELECT 'concat_chop' AS policy, lang, count(*) AS sequences, sum(occupied) AS occupied, sum(members) AS members FROM cc GROUP BY lang
UNION ALL SELECT 'pad_only', lang, count(*), sum(least(n, {LENGTH})), count(*) FROM it GROUP BY lang)
SELECT policy, lang, CAST(sequences AS BIGINT) AS sequences, CAST(occupied AS BIGINT) AS occupied, CAST(sequences * {LENGTH} - occupied AS BIGINT) AS pad, round(occupied / (sequences * {LENGTH})::DOUBLE, 6) AS occupancy, round(members / sequences::DOUBLE, 6) AS mean_members FROM r""")  # fmt: skip
def agg_utilisation(spark, sf):
    """What two policies make of each lane."""
    docs = items(spark, sf)
    chop = concat_chop(docs).groupBy(F.lit("concat_chop").alias("policy"), "lang").agg(F.count("*").alias("sequences"), F.sum("occupied").alias("occupied"), F.sum("members").alias("members"))
    pad = docs.groupBy(F.lit("pad_only").alias("policy"), "lang").agg(F.count("*").alias("sequences"), F.sum(F.least("n", F.lit(LENGTH).cast("long"))).alias("occupied"), F.count("*").alias("members"))
    positions = F.col("sequences") * LENGTH
    return chop.unionByName(pad).select("policy", "lang", "sequences", "occupied", (positions - F.col("occupied")).alias("pad"), F.round(F.col("occupied") / positions, 6).alias("occupancy"), F.round(F.col("members") / F.col("sequences"), 6).alias("mean_members"))


@query("attn_pairs", f"""
WITH s AS (SELECT conv_id, len({WORDS}) AS n FROM conversations)
SELECT conv_id, CAST(sum(n * (n + 1) // 2) AS BIGINT) AS pairs, CAST(sum(n) * (sum(n) + 1) // 2 AS BIGINT) AS pairs_unsegmented FROM s GROUP BY conv_id""")  # fmt: skip
def attn_pairs(spark, sf):
    """Visible pairs under the causal mask inside segments, in closed form, and without segments."""
    n = table(spark, sf, "conversations").select("conv_id", F.size(T.words("text")).cast("long").alias("n"))
    half = lambda x: F.floor(x * (x + 1) / 2).cast("long")
    return n.groupBy("conv_id").agg(F.sum(half(F.col("n"))).alias("pairs"), half(F.sum("n")).alias("pairs_unsegmented"))
