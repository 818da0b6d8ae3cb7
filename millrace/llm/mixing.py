"""Mixing sources to target weights by weighted fair queueing.

Each source's documents stand in a shuffled order (SHA-256 of seed and id). A document finishes at
the virtual time (words of its source up to and with it) / (target of its source); a source whose
target is more than it holds comes round again, its second round behind its first. All copies, over
all sources, are taken in the order of that time until their words reach the total budget: a copy
is taken whole if the words before it are below the budget.

Nothing is ordered in one task. Running sums are made in ranges of the shuffle key, whose totals are
summed once over a table of (source, range); the cut is searched in ranges of virtual time, and only
copies of the range that holds the cut are ordered.

A null source is a source of its own, in the last place; a null text has size 0; rows of equal id are
ordered by size. Without any word all targets are 0 and nothing is taken. Other columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from millrace.llm.common import WORD, documents, materialize

WEIGHTS, SHARE, MOST = (3.0, 1.0, 2.0), 1.5, 2.0
#: Rows of a source that one range of its shuffle order holds on average, at most.
RANGE_ROWS = 50_000


def size_of(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def source_targets(sizes: DataFrame, share: float = SHARE, most: float = MOST) -> DataFrame:
    """source, source_size, target from (source, source_size); one row a source.

    Shares are filled up to `most` times the size, in the order of size by weight: a source is held
    at its limit if that is no more than its part of what those before it left.
    """
    order = Window.orderBy(F.col("source").isNull(), "source")
    ranked = sizes.withColumn("rank", F.row_number().over(order) - 1).withColumn(
        "weight", F.element_at(F.array(*map(F.lit, WEIGHTS)), (F.col("rank") % len(WEIGHTS) + 1).cast("int"))
    )
    limit = F.col("source_size") * F.lit(most)
    up = Window.orderBy(F.col("ratio"), F.col("rank"))
    before = up.rowsBetween(Window.unboundedPreceding, -1)
    everyone = Window.partitionBy()
    levels = (
        ranked.withColumn("ratio", limit / F.col("weight"))
        .withColumn("held", F.coalesce(F.sum("source_size").over(before), F.lit(0)))
        .withColumn("rest", F.sum("weight").over(everyone) - F.coalesce(F.sum("weight").over(before), F.lit(0.0)))
        .withColumn("total", F.sum("source_size").over(everyone))
        .withColumn("level", (F.col("total") * F.lit(share) - F.col("held") * F.lit(most)) / F.col("rest"))
        # The level rises while sources are held at their limit; the first that isn't held has the highest, which is the common one.
        .withColumn("water", F.max(F.when(F.col("ratio") > F.col("level"), F.col("level"))).over(everyone))
    )
    target = F.when(F.col("water").isNull() | (F.col("ratio") <= F.col("water")), limit).otherwise(F.col("weight") * F.col("water"))
    return levels.select("source", "source_size", target.cast("double").alias("target"))


def mix(docs: DataFrame, seed: str = "mix") -> DataFrame:
    """doc_id, source, size, source_size, target, copies (0 to 2), taken."""
    spark = docs.sparkSession
    rows = docs.select(
        F.col("doc_id").cast("long").alias("doc_id"), F.col("source").alias("source"), size_of(F.col("text")).alias("size"),
        F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col("doc_id").cast("string"), F.lit(""))), 256).alias("key"),
    )
    rows = materialize(spark, rows, "mix-sizes")
    by_source = rows.groupBy("source").agg(F.sum("size").alias("source_size"), F.count("*").alias("n"))
    targets = source_targets(by_source.drop("n"))
    most = by_source.agg(F.max("n")).first()[0] or 0
    digits = 1
    while digits < 7 and most / 16**digits > RANGE_ROWS:
        digits += 1
    rows = rows.withColumn("range", F.substring("key", 1, digits))
    base = (
        rows.groupBy("source", "range").agg(F.sum("size").alias("held"))
        .withColumn("base", F.sum("held").over(Window.partitionBy("source").orderBy("range")) - F.col("held"))
        .drop("held")
    )
    known = base.join(targets, base["source"].eqNullSafe(targets["source"])).select(base["source"], "range", "base", "source_size", "target")
    r, k = rows.alias("r"), known.alias("k")
    running = Window.partitionBy("source", "range").orderBy("key", "doc_id", "size").rowsBetween(Window.unboundedPreceding, 0)
    queued = (
        r.join(k, F.col("r.source").eqNullSafe(F.col("k.source")) & (F.col("r.range") == F.col("k.range")))
        .select("r.*", "base", "source_size", "target")
        .withColumn("ahead", F.col("base") + F.sum("size").over(running))
    )
    queued = materialize(spark, queued, "mix-queue")
    # What the targets sum up to, without the rounding of a sum in changing order.
    budget = min(SHARE, MOST) * (targets.agg(F.sum("source_size")).first()[0] or 0)

    # The cut in virtual time: copies finish in (0, 1] or soon after; in which range do the words reach the budget?
    copies = queued.where("size > 0 AND target > 0").select(
        "source", "key", "doc_id", "size",
        F.explode(F.array(F.struct(F.lit(1).alias("round"), (F.col("ahead") / F.col("target")).alias("time")), F.struct(F.lit(2).alias("round"), ((F.col("source_size") + F.col("ahead")) / F.col("target")).alias("time")))).alias("c"),
    ).select("source", "key", "doc_id", "size", "c.round", "c.time")
    n = rows.count()
    slots = min(max(64, n // 1_000), 1_000_000)

    def slot_of(time: Column) -> Column:
        return F.least(F.floor(time * slots), F.lit(4 * slots)).cast("long")  # what comes very late shares one slot

    slot = slot_of(F.col("time"))
    totals = copies.groupBy(slot.alias("slot")).agg(F.sum("size").alias("words"))
    upto = totals.withColumn("upto", F.sum("words").over(Window.orderBy("slot")))
    cut = upto.where(F.col("upto") >= F.lit(budget)).orderBy("slot").first()
    if cut is None:  # not reached: everything up to the end is taken
        last = totals.agg(F.max("slot")).first()[0]
        cut_slot, before = (last + 1 if last is not None else 0), 0
    else:
        cut_slot, before = cut["slot"], cut["upto"] - cut["words"]
    order = Window.orderBy("time", F.col("source").isNull(), "source", "key", "doc_id", "size").rowsBetween(Window.unboundedPreceding, -1)
    edge = (
        copies.where(slot == cut_slot)
        .withColumn("before", F.coalesce(F.sum("size").over(order), F.lit(0)) + F.lit(before))
        .agg(F.max_by(F.struct("time", F.col("source").isNull().alias("none"), F.coalesce("source", F.lit("")).alias("source"), "key", "doc_id", "size"), F.when(F.col("before") < F.lit(budget), F.col("before"))).alias("last"))
        .first()
    )
    last = edge["last"] if edge else None
    if last is None:
        end = None
    else:
        end = F.struct(F.lit(last["time"]).alias("time"), F.lit(last["none"]).alias("none"), F.lit(last["source"]).alias("source"), F.lit(last["key"]).alias("key"), F.lit(last["doc_id"]).cast("long").alias("doc_id"), F.lit(last["size"]).cast("long").alias("size"))

    def taken(time: Column) -> Column:
        if end is None:
            return (slot_of(time) < F.lit(cut_slot)).cast("long")
        own = F.struct(time.alias("time"), F.col("source").isNull().alias("none"), F.coalesce("source", F.lit("")).alias("source"), F.col("key"), F.col("doc_id"), F.col("size"))
        return (own <= end).cast("long")

    first, second = F.col("ahead") / F.col("target"), (F.col("source_size") + F.col("ahead")) / F.col("target")
    held = F.when((F.col("size") > 0) & (F.col("target") > 0), taken(first) + taken(second)).otherwise(F.lit(0))
    return queued.select("doc_id", "source", "size", "source_size", "target", held.cast("int").alias("copies")).withColumn("taken", F.col("size") * F.col("copies"))


def stage(spark, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pipeline stage: a document stays as often as the mix takes it.

    Rows of one id, source and size are told apart by a number, so that none is multiplied.
    """
    same = ["doc_id", "source", "size"]
    plan = mix(docs).withColumn("nth", F.row_number().over(Window.partitionBy(*same).orderBy(F.desc("copies"))))
    plan = plan.where("copies > 0").select(F.col("doc_id").alias("_id"), F.col("source").alias("_source"), F.col("size").alias("_size"), F.col("nth").alias("_nth"), F.col("copies").alias("_copies"))
    own = Window.partitionBy("_a", "_b", "_c").orderBy("_t")
    rows = docs.select(F.struct(*docs.columns).alias("_row"), F.col("doc_id").cast("long").alias("_a"), F.col("source").alias("_b"), size_of(F.col("text")).alias("_c"), F.xxhash64("text").alias("_t"))
    rows = rows.withColumn("_n", F.row_number().over(own))
    on = F.col("_a").eqNullSafe(F.col("_id")) & F.col("_b").eqNullSafe(F.col("_source")) & (F.col("_c") == F.col("_size")) & (F.col("_n") == F.col("_nth"))
    return rows.join(plan, on).select(F.explode(F.expr("array_repeat(_row, _copies)")).alias("_row")).select("_row.*")


def op2_mixing(spark, sf_dir: str) -> DataFrame:
    return mix(documents(spark, sf_dir)).select("doc_id", "size", "source_size", "target", "taken", "copies")


#: Targets by resharing the excess round by round, and the queue by windows over the whole table.
SQL = {
    "op2_mixing": r"""
WITH RECURSIVE d AS (SELECT doc_id, source, CAST(len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')) AS BIGINT) AS size, sha256('mix:' || doc_id) AS key FROM documents),
s AS (SELECT source, CAST(sum(size) AS BIGINT) AS source_size, row_number() OVER (ORDER BY source IS NULL, source) - 1 AS rank FROM d GROUP BY source),
w AS (SELECT *, [3.0::DOUBLE, 1.0::DOUBLE, 2.0::DOUBLE][CAST(rank % 3 + 1 AS INT)] AS weight FROM s),
b AS (SELECT sum(source_size) * 1.5::DOUBLE AS budget FROM w),
f(k, level) AS (SELECT 0, (SELECT budget FROM b) / (SELECT sum(weight) FROM w)
  UNION ALL SELECT k + 1, next FROM (
    SELECT f.k, f.level, (b.budget - 2.0::DOUBLE * sum(CASE WHEN w.source_size * 2.0::DOUBLE <= w.weight * f.level THEN w.source_size ELSE 0 END))
      / sum(CASE WHEN w.source_size * 2.0::DOUBLE > w.weight * f.level THEN w.weight END) AS next FROM f, w, b GROUP BY f.k, f.level, b.budget) WHERE next > level),
t AS (SELECT source, source_size, least(source_size * 2.0::DOUBLE, weight * (SELECT arg_max(level, k) FROM f)) AS target FROM w),
q AS (SELECT d.*, source_size, target, sum(size) OVER (PARTITION BY d.source ORDER BY key, doc_id, size ROWS UNBOUNDED PRECEDING) AS ahead
      FROM d JOIN t ON d.source IS NOT DISTINCT FROM t.source),
c AS (SELECT *, 1 AS round, ahead / target AS time FROM q WHERE size > 0 UNION ALL SELECT *, 2, (source_size + ahead) / target FROM q WHERE size > 0),
r AS (SELECT *, coalesce(sum(size) OVER (ORDER BY time, source IS NULL, source, key, doc_id, size ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before FROM c),
k AS (SELECT doc_id, count(*) AS copies FROM r WHERE before < (SELECT budget FROM b) GROUP BY doc_id)
SELECT q.doc_id, q.size, q.source_size, q.target, CAST(q.size * coalesce(copies, 0) AS BIGINT) AS taken, CAST(coalesce(copies, 0) AS INTEGER) AS copies FROM q LEFT JOIN k USING (doc_id)
"""
}
