"""Rows of several schemas to documents: (row_id, lane, kind, segments of role and text)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from millrace.functions import text as T

MOST, CODE_MOST, BAND, STUB = 12_000, 40_000, 1_100, 200
ROLES = {"system": "system", "human": "user", "user": "user", "tool": "tool", "gpt": "assistant", "assistant": "assistant"}


def _segments(*pairs: tuple[str, Column]) -> Column:
    return F.array(*[F.struct(F.lit(role).alias("role"), text.alias("text")) for role, text in pairs])


def plain(df: DataFrame, row_id: Column, lane: Column, text: str = "text") -> DataFrame:
    """Prose: normalised, then capped."""
    cleaned = T.with_normal(df, text, "_t")
    return cleaned.select(row_id.cast("string").alias("row_id"), lane.alias("lane"), F.lit("pretrain").alias("kind"), _segments(("text", F.substring("_t", 1, MOST))).alias("segments"))


def code(df: DataFrame, row_id: Column, text: str, most: int = MOST) -> DataFrame:
    """Code isn't normalised: its white space means something."""
    return df.select(row_id.cast("string").alias("row_id"), F.lit("code").alias("lane"), F.lit("pretrain").alias("kind"), _segments(("text", F.substring(text, 1, most))).alias("segments"))


def solved(df: DataFrame, source: Column, problem: str, solution: str) -> DataFrame:
    """Problems with solutions: by the solution's length reasoning or stem; both must be there."""
    p, s = T.strip(F.coalesce(F.col(problem), F.lit(""))), T.strip(F.coalesce(F.col(solution), F.lit("")))
    rows = df.select(source.alias("_s"), p.alias("_p"), s.alias("_a")).where("_p <> '' AND _a <> ''")
    row_id = F.concat_ws(":", "_s", F.substring(F.sha2(F.col("_p").cast("binary"), 256), 1, 12))
    segments = _segments(("prompt", F.concat(F.lit("Problem: "), F.substring("_p", 1, MOST // 2))), ("response", F.concat(F.lit("Solution: "), F.substring("_a", 1, MOST))))
    return rows.select(row_id.alias("row_id"), F.when(F.char_length("_a") >= BAND, "reasoning").otherwise("stem").alias("lane"), F.lit("sft").alias("kind"), segments.alias("segments"))


def talks(df: DataFrame, row_id: Column, turns: str) -> DataFrame:
    """Trajectories from an array of (from, value): roles mapped, turns capped, unknown roles and blank turns dropped, an assistant required."""
    role = F.create_map(*[F.lit(x) for kv in ROLES.items() for x in kv])
    mapped = F.transform(turns, lambda t: F.struct(F.try_element_at(role, t["from"]).alias("role"), F.substring(T.strip(F.coalesce(t["value"], F.lit(""))), 1, MOST // 2).alias("text")))
    own = F.filter(mapped, lambda t: t["role"].isNotNull() & (t["text"] != ""))
    rows = df.select(row_id.cast("string").alias("row_id"), F.lit("agentic").alias("lane"), F.lit("agentic").alias("kind"), own.alias("segments"))
    return rows.where(F.exists("segments", lambda t: t["role"] == "assistant"))


def kept(df: DataFrame, stub: int = STUB) -> DataFrame:
    """Blank segments go, then documents of less than `stub` characters; adds `chars`."""
    filled = df.withColumn("segments", F.filter("segments", lambda s: T.strip(s["text"]) != ""))
    return filled.withColumn("chars", F.aggregate("segments", F.lit(0).cast("long"), lambda n, s: n + F.char_length(s["text"]))).where(F.col("chars") >= stub)
