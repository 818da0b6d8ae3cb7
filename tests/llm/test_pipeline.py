"""The pipeline, stage by stage, against brute force on the smallest tables; each stage on what its predecessor kept."""

import math
import re
import zlib
from collections import Counter

import numpy as np

import corpus_pipeline
from millrace.llm import mixing, quality, tokens
from millrace.session import table
from tests.llm.helpers import DOCS, odd_docs
from tests.llm.test_models import brute_mix
from tests.llm.test_pairs import brute_components

SF = "/root/testdata/sf0.001"
WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
LOWER = {c: chr(c + 32) for c in range(65, 91)}


def words(text):
    return WORD.findall((text or "").translate(LOWER))


def brute_cut(rows, items):
    """Rows below 5 % of words in an item's window, without those words."""
    windows = set()
    for (text,) in items:
        q = words(text)
        windows |= {tuple(q[s : s + 13]) for s in range(max(1, len(q) - 12) if q else 0)}
    out = []
    for r in rows:
        w, hit = words(r[1]), set()
        for n in {len(g) for g in windows}:
            for i in range(len(w) - n + 1):
                if tuple(w[i : i + n]) in windows:
                    hit |= set(range(i, i + n))
        if hit and 20 * len(hit) >= len(w):
            continue
        out.append((r, len(w) - len(hit)))
    return out


def test_every_stage_against_brute_force(spark):
    docs, frames = table(spark, SF, "documents"), []
    columns = docs.columns
    for number, (_, stage) in enumerate(corpus_pipeline.STAGES):
        frames.append(corpus_pipeline.materialize(spark, stage(spark, docs, SF), f"test-pipeline-{number}"))
        docs = frames[-1]
    kept, single, clean, mixed, ids = ([tuple(r) for r in f.collect()] for f in frames)
    assert all(f.columns == columns for f in frames[:-1]) and all((kept, single, clean, mixed, ids))
    before = [tuple(r) for r in table(spark, SF, "documents").collect()]

    # 1: the documents that the same model's own walk accepts, one text at a time.
    model = quality.fit(table(spark, SF, "documents"), table(spark, SF, "labels"))
    good = [r for r in before if model.probability(np.array([quality.statistics(r[1] or "")]))[0] >= 0.5]
    assert Counter(kept) == Counter(good) and len(good) < len(before)
    label = {r.doc_id: r.quality for r in table(spark, SF, "labels").collect()}
    assert np.mean([label[r[0]] for r in kept if r[0] in label]) > 0.9

    # 2: one of each component.
    i = columns.index("doc_id")
    assert i == 0 and columns[1] == "text"
    ones = {r[0] for r in brute_components(kept) if r[3]}
    assert Counter(r[0] for r in single) == Counter(ones) and set(single) <= set(kept)

    # 3: contaminated ones go, the rest lose the words of items and nothing else.
    items = [(r.text,) for r in table(spark, SF, "benchmark").collect()]
    want = {r[0]: n for r, n in brute_cut(single, items)}
    assert {r[0]: len(words(r[1])) for r in clean} == want
    text = {r[0]: r[1] for r in single}
    assert {r for r in clean if want[r[0]] == len(words(text[r[0]]))} <= set(single)

    # 4: as often as the queue takes it.
    own = [(r[0], r[1], None, r[columns.index("source")]) for r in clean]
    size, _, target, taken = brute_mix(own)
    assert Counter(r[0] for r in mixed) == Counter({r[0]: taken[k] // z for k, (r, z) in enumerate(zip(own, size)) if z and taken[k]})
    assert math.isclose(sum(target.values()), 1.5 * sum(size)) and set(mixed) <= set(clean)

    # 5: what the library makes of each text, in id order.
    lib, start, rows = tokens.Encoder(tokens.default_tokenizer()), 0, []
    for r in sorted(mixed, key=lambda r: (r[0], r[1])):
        x = np.append(lib.whole(r[1]), 0).astype("<u4")
        rows.append((r[0], start, len(x), zlib.crc32(x.tobytes())))
        start += len(x)
    assert sorted(ids, key=lambda r: r[1]) == rows


def test_stages_take_odd_rows_and_empty_tables(spark, tmp_path):
    """Nulls, ties, repeated rows, long texts, extra columns, and no rows at all pass every stage but the model's own fit."""
    rows, df = odd_docs(spark)
    spark.createDataFrame([(1, rows[0][1])], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    spark.createDataFrame([(r[0], int(len(r[1] or "") > 40), 0) for r in rows if r[0] is not None], "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    for docs in (df, spark.createDataFrame([], DOCS)):
        for _, stage in corpus_pipeline.STAGES[:-1]:
            out = stage(spark, docs, str(tmp_path))
            assert out.columns == df.columns
            assert set(map(tuple, (r[:1] + r[2:] for r in out.collect()))) <= set(r[:1] + r[2:] for r in rows)
        assert corpus_pipeline.STAGES[-1][1](spark, docs, str(tmp_path)).count() == docs.count()


def test_mixing_of_twenty_sources(spark):
    """Sources of very different sizes: some are held at twice their size, and the rest share what they leave."""
    rows, k = [], 0
    for s in range(20):
        for _ in range(2 + 7 * (s % 5) ** 2):
            rows.append((k, " ".join(["w"] * (1 + k % 23)), "en", f"src{s}", 0, 0.0, 0, ""))
            k += 1
    size, held, target, taken = brute_mix(rows)
    got = mixing.mix(spark.createDataFrame(rows, DOCS)).collect()
    by_source = {}
    for r in got:
        assert math.isclose(r.target, target[r.source], rel_tol=1e-12) and 0 <= r.target <= 2 * r.source_size
        by_source[r.source] = by_source.get(r.source, 0) + r.taken
    assert any(math.isclose(target[s], 2 * held[s]) for s in held) and any(target[s] < 1.9 * held[s] for s in held)
    assert math.isclose(sum(target.values()), 1.5 * sum(size), rel_tol=1e-12)
    assert all(abs(by_source[s] - target[s]) <= 46 for s in held)
    assert {r.doc_id: r.taken for r in got} == {r[0]: taken[i] for i, r in enumerate(rows)}
