"""What the training-data operators share: columns, splits and Arrow helpers."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from millrace.session import materialize, shared_dir, small_batches, table  # noqa: F401

#: ASCII white space of the contracts: space and U+0009 to U+000D.
WORD = r"[^\x20\x09-\x0D]+"
WORD_PATTERN = r"[^ \t-\r]+"


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents")


def id_remainder(mod: int, col: str = "doc_id") -> Column:
    """crc32 of the id's text, mod `mod`; a null id counts as the empty text."""
    return F.crc32(F.coalesce(F.col(col).cast("string"), F.lit("")).cast("binary")) % mod


def texts(docs: DataFrame) -> DataFrame:
    """doc_id and whole text, null as the empty text; whatever other columns there are stay out."""
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("text"), F.lit("")).alias("text"))


def table_of(schema: pa.Schema, **columns) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(columns[f.name], type=f.type) for f in schema], schema=schema)


def each_batch(batches: Iterator[pa.RecordBatch], *names: str):
    for batch in batches:
        if batch.num_rows:
            yield [batch.column(batch.schema.get_field_index(n)).to_pylist() for n in names]


def labelled_sample(labels: DataFrame, label: str, fits: Column, most: int) -> DataFrame:
    """At most `most` labelled ids for which `fits` holds, the same ones in every run.

    `most` bounds the driver's share of a fit, and proves the size of the table, which may
    therefore be broadcast. Rows with an id or a label that is null are no labels; of an id that
    is labelled more than once the largest label holds.
    """
    return (
        labels.where(F.col("doc_id").isNotNull() & F.col(label).isin(0, 1) & fits)
        .groupBy(F.col("doc_id").cast("long").alias("doc_id"))
        .agg(F.max(F.col(label)).cast("int").alias("label"))
        .orderBy(F.xxhash64("doc_id"), "doc_id")
        .limit(most)
    )
