"""Small tables for the operators: every odd case that they must define."""

import random

DOCS = "doc_id long, text string, lang string, source string, n_chars long, score double, size long, words string"


def odd_docs(spark, seed=1, n=60):
    """Ties, repeated rows, nulls in any column, empty and long texts, and columns with clashing names."""
    rng = random.Random(seed)
    vocab = [f"w{i}" for i in range(200)] + ["Émile", "straße", "ﬁn", "日本"]
    rows = []
    for i in range(n):
        text = " ".join(rng.choice(vocab) for _ in range(rng.choice([1, 3, 4, 5, 6, 40, 120])))
        rows.append((i, text, "en", f"s{i % 4}", len(text), 0.5, 1, "x"))
    rows += [(100 + i, rows[5][1], None, None, None, None, None, None) for i in range(3)]
    rows += [(110, rows[7][1] + " tail", "en", "s1", 3, 0.1, 1, ""), (111, rows[7][1].upper(), "en", "s1", 3, 0.1, 1, "")]
    rows += [(120, None, None, None, None, None, None, None), (121, "", "", "", 0, 0.0, 0, ""), (122, " \t\n ", "de", "s2", 4, 0.0, 0, "")]
    rows += [rows[3], rows[3], (130, " ".join(rng.choice(vocab) for _ in range(20000)), "en", "s0", 1, 0.0, 0, "")]
    rows += [(None, "no id at all", "en", "s0", 1, 0.0, 0, "")]
    return rows, spark.createDataFrame(rows, DOCS).repartition(5)


def empty_docs(spark):
    return spark.createDataFrame([], DOCS)
