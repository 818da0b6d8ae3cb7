"""Text columns: words, normalisation, scripts, byte codes and digests, all on the JVM."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

WHITE = r"[ \t\n\r]+"
#: Zero-width space, byte-order mark, direction marks and embeddings, soft hyphen, replacement character.
NOISE = "​﻿‎‏‪‫‬‭‮­�"
JOINERS = "‌‍"
_STRIP = r"[ \t\n\r\x0B\f\x1c-\x1f\x85   -     　]+"

#: The characters of _STRIP.
_BLANK = "".join(c for c in map(chr, range(0x3001)) if re.match(_STRIP, c))


def col(c) -> Column:
    return F.col(c) if isinstance(c, str) else c


def words(text) -> Column:
    return F.array_remove(F.split(col(text), WHITE), "")


def word_count(text) -> Column:
    """As many as `words` has, without making them."""
    return F.regexp_count(col(text), F.lit(r"[^ \t\n\r]+")).cast("long")


def strip(text: Column) -> Column:
    return F.btrim(text, F.lit(_BLANK))


def unescape(text: Column) -> Column:
    done = F.reflect(F.lit("org.apache.commons.text.StringEscapeUtils"), F.lit("unescapeHtml4"), text)
    return F.when(text.contains("&") & text.contains(";"), done).otherwise(text)


def nfc(text: Column) -> Column:
    done = F.reflect(F.lit("com.ibm.icu.text.Normalizer"), F.lit("compose"), text, F.lit(False))
    return F.when(text.rlike(r"[^\x00-\x7f]"), done).otherwise(text)


_EDGES = _STRIP.replace("\\n", "")
#: The first is the plain space.
_SPACES = r"[ \t\u00A0\u2000-\u200A\u3000]"


def normalize(text) -> Column:
    """Unescape, NFC, drop noise and control characters, collapse spaces and blank lines, strip lines and text.

    Costly: name it in a projection of its own (`with_normal`) where more than one column is made from it.
    """
    t = nfc(unescape(col(text)))
    t = F.regexp_replace(t, f"[\\x00-\\x08\\x0b\\x0c\\x0e-\\x1f\\x7f{NOISE}]", "")
    t = F.regexp_replace(t, f"{_SPACES}{{2,}}|{_SPACES[:1] + _SPACES[2:]}", " ")  # a single space stays as it is
    t = F.regexp_replace(t, r"\n{3,}", "\n\n")
    return strip(F.regexp_replace(t, f"(?={_EDGES[:-1]})(?:(?<=\n){_EDGES}|{_EDGES}(?=\n))", ""))


def with_normal(df: DataFrame, text: str = "text", name: str = "t") -> DataFrame:
    """Adds the normalised text, computed once a row: the calls by reflection keep the optimizer from repeating it."""
    return df.withColumn(name, normalize(text))


def count_of(text: Column, characters: str) -> Column:
    return F.length(text) - F.length(F.translate(text, characters, ""))


def ngrams(items: str, n: int = 8, stride: int = 4) -> Column:
    """Distinct runs of n items at every stride-th place; none if there are fewer than n.

    `items` names a column: an expression here would be evaluated again for every run.
    """
    many = F.size(items)
    starts = F.when(many >= n, F.sequence(F.lit(1), many - (n - 1), F.lit(stride))).otherwise(F.array().cast("array<int>"))
    return F.array_distinct(F.transform(starts, lambda i: F.array_join(F.slice(items, i, n), " ")))


def gram_hashes(hashes: str, n: int = 8, stride: int = 4) -> Column:
    """The distinct runs of `ngrams` as 64-bit hashes, from a column of the items' hashes: no run is spelled out."""
    many = F.size(hashes)
    starts = F.when(many >= n, F.sequence(F.lit(1), many - (n - 1), F.lit(stride))).otherwise(F.array().cast("array<int>"))
    return F.array_distinct(F.transform(starts, lambda i: F.xxhash64(F.slice(hashes, i, n))))


def script(token: Column) -> Column:
    """By the first character that is no space."""
    # Spark's ascii() gives the code point of the first character.
    code = F.ascii(F.regexp_extract(token, r"([^ \t\n\r])", 1))
    return (
        F.when(code == 0, "space/empty").when(code < 128, "latin/ascii").when(code.between(0x0900, 0x097F), "devanagari")
        .when(code.between(0x0A80, 0x0AFF), "gujarati").when(code.between(0x0C00, 0x0C7F), "telugu").otherwise("other")
    )


def byte_cells(token: Column, window: int = 32) -> Column:
    """(byte, position) of the first `window` bytes."""
    raw = F.hex(token.cast("binary"))
    n = F.least(F.octet_length(token), F.lit(window))
    at = F.when(n > 0, F.sequence(F.lit(0), n - 1)).otherwise(F.array().cast("array<int>"))
    return F.transform(at, lambda i: F.struct(F.conv(F.substring(raw, i * 2 + 1, F.lit(2)), 16, 10).cast("int").alias("byte"), i.cast("int").alias("pos")))


def digest(parts: Column) -> Column:
    return F.sha2(F.array_join(parts, ",").cast("binary"), 256)
