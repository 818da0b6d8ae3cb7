"""The queries of the training-data operators, and the SQL of those that SQL can express."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from millrace.llm import decontaminate, fingerprints, lm, minhash, mixing, quality, repeats, secrets, tokens, toxicity

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_quality": quality.op1_quality,
    "op2_mixing": mixing.op2_mixing,
    "op3_toxicity": toxicity.op3_toxicity,
    "op4_lm": lm.op4_lm,
    "op5_decontaminate": decontaminate.op5_decontaminate,
    "op6_minhash": minhash.op6_minhash,
    "op7_fingerprints": fingerprints.op7_fingerprints,
    "op8_secrets": secrets.op8_secrets,
    "op9_tokens": tokens.op9_tokens,
    "op10_repeats": repeats.op10_repeats,
}

SQL: dict[str, str] = {**mixing.SQL, **decontaminate.SQL}
