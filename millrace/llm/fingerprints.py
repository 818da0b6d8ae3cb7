"""Document fingerprints: canonical exact digests, on the JVM only.

The canonical text is NFKC, case folded, NFKC again, with runs of white space as one space and none
at the ends (ICU, by Spark's own `reflect`). Its fingerprint is 128 bits wide: two xxHash64 with
different seeds. Documents group by fingerprint and, inside equal fingerprints, by the bytes of the
canonical text; should two different canonical texts ever share a fingerprint, the later ones (by
smallest id) get a number behind it, so equal fingerprints of `classes` always mean equal texts.

Grouping pre-aggregates in each task, so a group of copies sends one row a task. The next document of
each is found in ranges of ids whose first documents are linked across ranges.

Nulls: a null text counts as empty; null ids come first; rows of equal id are ordered by text. One
document alone is its own next. Other columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from millrace.llm.common import documents, texts

#: Ranges of ids at most, so that the table of first documents is bounded.
MOST_RANGES = 4096
_LEAST = -(2**63)


def canonical(text: Column) -> Column:
    def nfkc(c: Column) -> Column:
        return F.reflect(F.lit("com.ibm.icu.text.Normalizer"), F.lit("compose"), c, F.lit(True))

    folded = nfkc(F.reflect(F.lit("com.ibm.icu.lang.UCharacter"), F.lit("foldCase"), nfkc(text), F.lit(True)))
    return F.trim(F.regexp_replace(folded, r"(?U)\s+", " "))


def wide_hash(canon: Column) -> Column:
    def half(h: Column) -> Column:
        return F.lpad(F.lower(F.hex(h)), 16, "0")

    return F.concat(half(F.xxhash64(canon)), half(F.xxhash64(F.lit("wide"), canon)))


def classes(docs: DataFrame) -> DataFrame:
    """hash, digest (of the canonical bytes), class_id (smallest id), n_copies, rank inside the hash."""
    rows = texts(docs).select("doc_id", canonical(F.col("text")).alias("canon")).withColumn("hash", wide_hash(F.col("canon")))
    groups = rows.groupBy("hash", "canon").agg(F.min("doc_id").alias("class_id"), F.count("*").alias("n_copies"))
    slim = groups.select("hash", F.sha2(F.col("canon").cast("binary"), 256).alias("digest"), "class_id", "n_copies")
    return slim.withColumn("rank", F.row_number().over(Window.partitionBy("hash").orderBy("class_id", "digest")) - 1)


def _ranges(rows: DataFrame) -> Column:
    """The range of `ord`: how many cuts lie below it. Cuts are quantiles, no more than MOST_RANGES."""
    spark = rows.sparkSession
    n = min(MOST_RANGES, max(1, int(spark.conf.get("spark.sql.shuffle.partitions"))))
    cuts = rows.agg(F.percentile_approx("ord", F.array(*[F.lit((i + 1) / n) for i in range(n - 1)]), 10_000)).first()[0] if n > 1 else None
    cuts = sorted(set(cuts or []))
    if not cuts:
        return F.lit(0)
    return F.size(F.filter(F.array(*map(F.lit, cuts)), lambda x: x < F.col("ord")))


def neighbours(docs: DataFrame) -> DataFrame:
    """doc_id, text, canonical hash and digest, and text and hash of the next document in id order."""
    rows = texts(docs).withColumn("ord", F.coalesce("doc_id", F.lit(_LEAST)))
    rows = rows.withColumn("range", _ranges(rows))
    first = rows.groupBy("range").agg(F.min("ord").alias("head"))
    first = first.withColumn("wrapped", F.min("head").over(Window.partitionBy())).withColumn(
        "next_head", F.coalesce(F.lead("head").over(Window.orderBy("range")), F.col("wrapped"))
    )
    # One row for each of at most MOST_RANGES ranges: that bounds the broadcast.
    heads = rows.join(F.broadcast(first.select(F.col("head").alias("ord"))), "ord").groupBy("ord").agg(F.min("text").alias("head_text"))
    heads = heads.withColumn("head_hash", wide_hash(canonical(F.col("head_text"))))
    follows = first.join(heads, first["next_head"] == heads["ord"]).select("range", "head_text", "head_hash")
    order = Window.partitionBy("range").orderBy("ord", "text")
    hashed = rows.withColumn("canon", canonical(F.col("text"))).withColumn("hash", wide_hash(F.col("canon"))).withColumn("digest", F.sha2(F.col("canon").cast("binary"), 256)).drop("canon")
    led = hashed.withColumn("next_text", F.lead("text").over(order)).withColumn("next_hash", F.lead("hash").over(order))
    return led.join(follows, "range").select(
        "doc_id", "text", "hash", "digest", F.coalesce("next_text", "head_text").alias("next_text"), F.coalesce("next_hash", "head_hash").alias("next_hash")
    )


def op7_fingerprints(spark, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir)
    n = F.char_length("text")
    part = F.floor(n / 4).cast("int")
    edited = F.concat(F.substring("text", F.lit(1), n - part), F.substring("next_text", F.lit(1), part))
    rows = neighbours(docs).select("doc_id", n.cast("long").alias("n_chars"), "hash", "digest", "next_hash", edited.alias("edited"))
    rows = rows.select(
        "doc_id", "n_chars", "hash", "digest", "next_hash", F.sha2(F.col("edited").cast("binary"), 256).alias("edited_sha256"), wide_hash(canonical(F.col("edited"))).alias("edited_fingerprint")
    )
    fingerprint = F.concat(F.col("hash"), F.when(F.col("rank") > 0, F.concat(F.lit("-"), F.col("rank").cast("string"))).otherwise(F.lit("")))
    return rows.join(classes(docs), ["hash", "digest"]).select(
        "doc_id", "n_chars", "edited_sha256", fingerprint.alias("fingerprint"), "edited_fingerprint",
        (F.col("hash") == F.col("edited_fingerprint")).cast("double").alias("near_edited"), (F.col("hash") == F.col("next_hash")).cast("double").alias("near_next"),
        "class_id", "n_copies",
    )
