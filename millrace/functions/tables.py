"""Functions for SQL: scalar ones as SQL expressions, and table functions that unfold a row into several."""

from __future__ import annotations

from collections.abc import Iterator

from pyspark.sql import SparkSession
from pyspark.sql.functions import udtf

#: Name, arguments, result, body: all on the JVM.
SCALARS = (
    ("mr_words", "t STRING", "ARRAY<STRING>", r"filter(split(t, '[ \\t\\n\\r]+'), w -> w <> '')"),
    ("mr_perplexity", "loss DOUBLE", "DOUBLE", "exp(least(20D, loss))"),
    ("mr_bits_a_byte", "nats DOUBLE, bytes_a_token DOUBLE", "DOUBLE", "nats / ln(2D) / bytes_a_token"),
)


@udtf(returnType="off: bigint, size: bigint")
class Chunks:
    """(off, size) of the pieces of `n` tokens in windows of `length`; a tail under `least` tokens of a longer item is dropped."""

    def eval(self, n: int, length: int, least: int) -> Iterator[tuple[int, int]]:
        for off in range(0, n or 0, length):
            if n <= length or n - off >= least:
                yield off, min(length, n - off)


@udtf(returnType="win: bigint, lo: bigint, hi: bigint")
class Windows:
    """(win, lo, hi) of the windows that a stretch [start, start + n) of a stream lies in."""

    def eval(self, start: int, n: int, length: int) -> Iterator[tuple[int, int, int]]:
        for win in range(start // length, (start + n - 1) // length + 1) if n else ():
            yield win, max(start, win * length), min(start + n, (win + 1) * length)


def register(spark: SparkSession) -> None:
    """Makes all of them known to SQL in this session; again is no error."""
    for name, args, result, body in SCALARS:
        spark.sql(f"CREATE OR REPLACE TEMPORARY FUNCTION {name}({args}) RETURNS {result} RETURN {body}")
    spark.udtf.register("mr_chunks", Chunks)
    spark.udtf.register("mr_windows", Windows)
