"""Paged row sources with a cache: JSON pages of a rows API, as files `{root}/{name}/{offset}.json`, each of {"rows": [{"row": {...}}]}.

Pages that the cache lacks are fetched by executors, with retries; reading is a plain JSON scan, so columns that
aren't asked for are never built.
"""

from __future__ import annotations

import time
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

TRIES, WAIT = 4, 2.0


def fetch_page(get: Callable[[int], str], offset: int, tries: int = TRIES, wait: float = WAIT) -> str:
    """One page's text; a failed try waits twice, four times ... `wait` seconds before the next."""
    for n in range(tries):
        try:
            return get(offset)
        except OSError:
            if n == tries - 1:
                raise
            time.sleep(wait * (n + 1))
    raise ValueError("no tries")


def fetch(spark: SparkSession, path: str, offsets: list[int], get: Callable[[int], str], wait: float = WAIT) -> int:
    """Fetches the pages that `path` lacks and adds them to it; returns how many that were."""
    want = spark.createDataFrame([(o,) for o in offsets], "offset long")
    try:
        have = cached(spark, path).select("offset").distinct()
        want = want.join(have, "offset", "left_anti")
    except Exception as e:  # nothing cached yet
        if "PATH_NOT_FOUND" not in str(e):
            raise
    n = want.count()

    def pages(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            yield pd.DataFrame({"offset": b["offset"], "page": [fetch_page(get, int(o), wait=wait) for o in b["offset"]]})

    if n:
        want.repartition(min(n, 64)).mapInPandas(pages, "offset long, page string").write.mode("append").partitionBy("offset").text(path)
    return n


def cached(spark: SparkSession, path: str) -> DataFrame:
    """(offset, value): the cached pages."""
    return spark.read.text(path)


def rows(spark: SparkSession, path: str, schema: StructType | str) -> DataFrame:
    """offset, at (place in the page) and the columns of `schema` of every row in the cache."""
    text = schema if isinstance(schema, str) else ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in schema)
    page = F.from_json("value", f"rows array<struct<row: struct<{text.replace(' ', ': ').replace(',:', ',')}>>>")
    found = cached(spark, path).select(F.col("offset").cast("long").alias("offset"), F.posexplode(page["rows"]).alias("at", "r"))
    return found.select("offset", "at", "r.row.*")
