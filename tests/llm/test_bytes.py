import hashlib
import random
import zlib
from collections import Counter

import numpy as np
import pytest

from millrace.llm import coder, repeats, tokens
from tests.llm.helpers import DOCS, empty_docs, odd_docs


@pytest.mark.parametrize("n", [0, 1, 2, 255, 256, 700, 5000, 70000])
def test_coder_round_trip(n):
    rng = np.random.default_rng(n)
    for ids in (rng.integers(0, 50257, n), rng.zipf(1.3, n) % 50257, np.zeros(n, int), np.full(n, 50256), np.tile([5, 9, 9, 2], n)[:n], rng.integers(0, 2, n)):
        assert (coder.decode(coder.encode(ids)) == ids).all()


def test_coder_learns_and_rescales(monkeypatch):
    rng = np.random.default_rng(1)
    words = [rng.integers(0, 50000, 4) for _ in range(300)]
    ids = np.concatenate([words[i] for i in rng.integers(0, 300, 60000)])
    assert len(coder.encode(ids)) * 8 < 5 * len(ids)  # log2(300) bits a word of 4 ids, and what learning costs
    monkeypatch.setattr(coder, "GAIN", 4000)
    assert (coder.decode(coder.encode(ids)) == ids).all()


def test_coder_notices_damage():
    block = bytearray(coder.encode(np.arange(1000)))
    for at in (0, 9, 200, len(block) - 1):
        bad = block.copy()
        bad[at] ^= 1
        with pytest.raises(ValueError):
            coder.decode(bytes(bad))


def test_coder_mixes_all_orders():
    """An id that several orders predict costs what the sum of their shares says, and every point belongs to one id."""
    rng = np.random.default_rng(5)
    m = coder.Model(40)
    ids = rng.zipf(1.5, (60, 64)) % 40
    last2 = last1 = np.zeros(64, np.int64)
    for own in ids:
        m.predict(last2, last1)
        for lane in range(0, 64, 9):
            start, size = zip(*((int(a[lane]), int(b[lane])) for a, b in (m.share(np.full(64, i)) for i in range(40))))
            assert start[0] == 0 and all(a + b == c for a, b, c in zip(start, size, start[1:])) and start[-1] + size[-1] == coder.TOTAL and min(size) > 0
            p2, p1 = int(m.p2[lane]), int(m.p1[lane])
            order0 = (int(m.upto[p2 + 1]) * int(m.w0[lane]) >> coder.TOTAL_BITS) - (int(m.upto[p2]) * int(m.w0[lane]) >> coder.TOTAL_BITS)
            assert size[p2] == order0 + int(m.w2[lane]) + (int(m.w1[lane]) if p1 == p2 else 0)
        a, b = m.share(own)
        for at in (a, a + b - 1):
            assert (m.find(at) == own).all()
        m.share(own)
        m.learn(own)
        last2, last1 = last1, own


def test_token_files_notice_damage(spark):
    from pyspark.sql import functions as F

    rows, df = odd_docs(spark)
    good = tokens.materialize(spark, tokens.blocks(df, tokens.default_tokenizer(), 500), "test-tokens")
    assert tokens.read_back(good).count() == len(rows)
    for column, bad in (("start", F.col("start") + 1), ("doc_ids", F.reverse("doc_ids")), ("lengths", F.transform("lengths", lambda n: n + 1)), ("block", F.col("block") + 1)):
        with pytest.raises(Exception, match="damaged"):
            tokens.read_back(good.withColumn(column, bad)).collect()


def test_pieces_encode_as_whole_texts():
    e = tokens.Encoder(tokens.default_tokenizer())
    rng = random.Random(3)
    alphabet = ["a", "Ab", "the", " ", "  ", "\n", "\t", "'s", "'", "é", "日本", "1", "22", ".", "!!", "$$", "ß", "é,", "Àb-", "_x", "×", "÷.", "'ll", "'Re", "`", "~", " ", "\x1c", "<|endoftext|>", " x"]
    for _ in range(400):
        t = "".join(rng.choice(alphabet) for _ in range(rng.randrange(0, 30)))
        assert e(t).tolist() == e.whole(t).tolist(), repr(t)


def test_tokens_written_and_read(spark):
    rows, df = odd_docs(spark)
    lib = tokens.Encoder(tokens.default_tokenizer())
    rows = sorted(((-(2**63) if r[0] is None else r[0], r[1] or "") for r in rows))
    want, start = [], 0
    for i, t in rows:
        ids = np.append(lib.whole(t), 0).astype("<u4")
        want.append((None if i == -(2**63) else i, start, len(ids), zlib.crc32(ids.tobytes())))
        start += len(ids)
    for block in (2**19, 500):
        got = [tuple(r) for r in tokens.write_and_read(df, block=block).collect()]
        assert sorted(got, key=lambda r: (r[1], r[2])) == want
    assert tokens.write_and_read(empty_docs(spark)).count() == 0


def brute_repeats(rows, width=100):
    raws = [((-(2**63) if r[0] is None else r[0]), (r[1] or "").encode()) for r in rows]
    first = {}
    for i, raw in raws:
        for p in range(len(raw) - width + 1):
            s = raw[p : p + width]
            if s not in first or (i, p) < first[s]:
                first[s] = (i, p)
    out = []
    for (i, raw), r in zip(raws, rows):
        gone = np.zeros(len(raw) + 1, int)
        for p in range(len(raw) - width + 1):
            if first[raw[p : p + width]] < (i, p):
                gone[p] += 1
                gone[p + width] -= 1
        on = np.cumsum(gone[:-1]) > 0 if len(raw) else np.zeros(0, bool)
        kept = bytes(b for b, o in zip(raw, on) if not o)
        spans = int((np.diff(np.concatenate(([0], on.astype(int)))) == 1).sum())
        out.append((r[0], len(raw), int(on.sum()), spans, hashlib.sha256(kept).hexdigest()))
    return Counter(out)


def repeated_rows(seed=6):
    rng = random.Random(seed)
    vocab = [f"v{rng.randrange(10**5)}" for _ in range(400)]
    text = lambda n: " ".join(rng.choice(vocab) for _ in range(n))
    shared = [text(40) for _ in range(4)]
    rows = []
    for i in range(50):
        parts = [text(rng.randrange(0, 60))]
        for _ in range(rng.randrange(0, 3)):
            s = rng.choice(shared)
            a, b = sorted((rng.randrange(len(s)), rng.randrange(len(s))))
            parts += [s if rng.random() < 0.5 else s[a:b], text(rng.randrange(0, 20))]
        rows.append((i, " ".join(parts), "en", "s", 0, 0.0, 0, ""))
    line = text(20)
    rows += [(60, "\n".join([line] * 6), *rows[0][2:]), (61, "a" * 500, *rows[0][2:]), (62, "ab" * 300, *rows[0][2:]), (63, "a" * 99, *rows[0][2:]), (64, shared[0][:100], *rows[0][2:]), (65, shared[0][:99] + "é", *rows[0][2:])]
    rows += [(66, rows[3][1], *rows[0][2:]), (5, shared[1] + text(30), *rows[0][2:]), rows[8]]
    return rows


def found(df):
    return Counter((r.doc_id, r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) for r in df.collect())


def test_repeats_against_brute_force(spark):
    rows = repeated_rows()
    df = spark.createDataFrame(rows, DOCS).repartition(3)
    assert found(repeats.remove_repeats(df)) == brute_repeats(rows)


def test_repeats_with_crowded_anchors_and_small_pieces(spark, monkeypatch):
    rows = repeated_rows(7)
    df = spark.createDataFrame(rows, DOCS).repartition(4)
    assert found(repeats.remove_repeats(df, crowd=2)) == brute_repeats(rows)


def test_anchors_of_long_texts_do_not_depend_on_pieces(monkeypatch):
    rng = random.Random(1)
    raw = "".join(rng.choice("abcdef ") for _ in range(5000)).encode()
    whole = {(int(p), int(a), int(s)) for _, p, a, s in zip(*repeats.anchors([raw]))}
    monkeypatch.setattr(repeats, "PIECE", 700)
    import pyarrow as pa

    b = pa.RecordBatch.from_arrays([pa.array([1]), pa.array([0]), pa.array([raw.decode()])], ["ord", "twin", "text"])
    got = set()
    for out in repeats._anchored(iter([b])):
        got |= {(p, a % 2**64, s % 2**64) for p, a, s, w in zip(*(out.column(c).to_pylist() for c in ("pos", "anchor", "around", "whole"))) if not w}
    assert got == whole


def test_suffix_order_and_previous_factors():
    rng = random.Random(9)
    for width in (8, 100):
        for alphabet in ("ab", "abcdefgh", "a"):
            raw = "".join(rng.choice(alphabet) for _ in range(700)).encode()
            starts = np.array(sorted(rng.sample(range(len(raw) - width), 400)))
            order, equal = repeats.suffix_order(np.frombuffer(raw, np.uint8), starts, width)
            s = [raw[i : i + width] for i in starts[order]]
            assert s == sorted(s) and equal.tolist() == [False] + [a == b for a, b in zip(s, s[1:])]
    for _ in range(60):
        n = rng.randrange(0, 40)
        t = "".join(rng.choice("ab") for _ in range(n))
        order = sorted(range(n), key=lambda i: t[i:])
        share = lambda a, b: next((k for k in range(n) if t[a + k : a + k + 1] != t[b + k : b + k + 1] or not t[a + k : a + k + 1]), n)
        common = np.array([0] + [share(a, b) for a, b in zip(order, order[1:])][: max(0, n - 1)])[:n]
        got = repeats.previous_factors(np.array(order, np.int64), common.astype(np.int64))
        assert got.tolist() == [max((share(i, j) for j in range(i)), default=0) for i in order]


def test_repeats_odd_cases(spark):
    rows, df = odd_docs(spark)
    assert found(repeats.remove_repeats(df)) == brute_repeats(rows)
    assert repeats.remove_repeats(empty_docs(spark)).count() == 0
