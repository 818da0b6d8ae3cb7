"""Ordered operators that scale: running sums, numbering and neighbours without one task for a whole lane.

A window over a lane puts the lane in one task. Here rows are dealt by (lane, range of the order), ranges are
cut at quantiles, each range is summed alone, and what the ranges before it hold comes from a small table.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from millrace.session import materialize

#: Ranges at most, so that the list of cuts stays small.
MOST_RANGES = 1024


def cuts(df: DataFrame, order: str, n: int | None = None) -> list:
    """Quantiles of a numeric column: the ends of at most n ranges."""
    n = min(MOST_RANGES, n or max(1, int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))))
    if n < 2:
        return []
    found = df.agg(F.percentile_approx(order, F.array(*[F.lit((i + 1) / n) for i in range(n - 1)]), 10_000)).first()[0]
    return sorted(set(found or []))


def range_of(order: str, ends: list) -> Column:
    """How many ends are less, by halving."""
    if not ends:
        return F.lit(0)
    at = F.array(*map(F.lit, ends))
    halves = F.array(*[F.lit(1 << k) for k in reversed(range(len(ends).bit_length()))])
    return F.aggregate(halves, F.lit(0), lambda n, k: F.when(F.get(at, n + k - 1) < F.col(order), n + k).otherwise(n))


def prefix_sums(df: DataFrame, by: list[str], order: list[str], sums: dict[str, Column], n: int | None = None) -> DataFrame:
    """Adds, for each name in `sums`, the sum over the rows before this one in its group.

    `order` is a total order inside a group; its first column must be numeric, and cuts the ranges. The rows are read
    for the cuts, for the sums of ranges and again for the result, so they are written first, and made once.
    """
    values = {f"_v{i}": c for i, c in enumerate(sums.values())}
    rows = materialize(df.sparkSession, df.withColumns(values), "ordered")
    rows = rows.withColumn("_range", range_of(order[0], cuts(rows, order[0], n)))
    totals = rows.groupBy(*by, "_range").agg(*[F.sum(v).alias(f"_t{i}") for i, v in enumerate(values)])
    upto = Window.partitionBy(*by).orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)
    base = totals.select(
        *[F.col(c).alias(f"_k{i}") for i, c in enumerate(by)], F.col("_range").alias("_r"),
        *[F.coalesce(F.sum(f"_t{i}").over(upto), F.lit(0)).alias(f"_b{i}") for i in range(len(values))],
    )
    on = F.col("_range") == F.col("_r")
    for i, c in enumerate(by):
        on = on & F.col(c).eqNullSafe(F.col(f"_k{i}"))
    inside = Window.partitionBy(*by, "_range").orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    joined = rows.join(base, on)
    out = {name: F.col(f"_b{i}") + F.coalesce(F.sum(f"_v{i}").over(inside), F.lit(0)) for i, name in enumerate(sums)}
    return joined.withColumns(out).drop(*values, "_range", "_r", *[f"_b{i}" for i in range(len(values))], *[f"_k{i}" for i in range(len(by))])


def numbered(df: DataFrame, by: list[str], order: list[str], name: str = "rn") -> DataFrame:
    """Row numbers from 1 in each group."""
    out = prefix_sums(df, by, order, {name: F.lit(1).cast("long")})
    return out.withColumn(name, F.col(name) + 1)


def hash_order(*parts: Column) -> Column:
    """A number that orders rows at random, the same everywhere: the first 15 digits of a SHA-256."""
    return F.conv(F.substring(F.sha2(F.concat_ws(":", *parts), 256), 1, 15), 16, 10).cast("long")


def last_in(df: DataFrame, by: list[str], order: list[str]) -> DataFrame:
    """The last row of each group (pre-aggregated in each task)."""
    value = F.struct(*[c for c in df.columns])
    return df.groupBy(*by).agg(F.max_by(value, F.struct(*order)).alias("_last")).select("_last.*")
