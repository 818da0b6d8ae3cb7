import hashlib
import random
import re
import tracemalloc
import unicodedata

import numpy as np
import pyarrow as pa
import pytest
import xxhash
import zstandard

from millrace.llm import bytehash, decontaminate, fingerprints, minhash
from tests.llm.helpers import DOCS, empty_docs, odd_docs


def brute_components(rows):
    lower = {c: chr(c + 32) for c in range(65, 91)}
    nodes = []
    for r in rows:
        w = re.findall(r"[^\x20\x09-\x0D]+", (r[1] or "").translate(lower))
        nodes.append(frozenset(tuple(w[i : i + 5]) for i in range(len(w) - 4)) if len(w) >= 5 else frozenset([tuple(w)]) if w else frozenset())
    label = list(range(len(rows)))

    def find(i):
        while label[i] != i:
            i = label[i]
        return i

    for i in range(len(rows)):
        for j in range(i):
            if nodes[i] and nodes[j] and 100 * len(nodes[i] & nodes[j]) >= 85 * len(nodes[i] | nodes[j]):
                label[find(i)] = find(j)
    least = {}
    for i, r in enumerate(rows):
        k = find(i)
        ids = [x for x in (least.get(k), r[0]) if x is not None]
        least[k] = min(ids) if ids else None
    return sorted(((r[0], len(nodes[i]), least[find(i)], r[0] == least[find(i)]) for i, r in enumerate(rows)), key=str)


def found(df):
    return sorted((tuple(r) for r in df.select("doc_id", "n_shingles", "component_id", "kept").collect()), key=str)


def test_minhash_odd_cases(spark):
    rows, df = odd_docs(spark)
    assert found(minhash.classify(df)) == brute_components(rows)
    assert minhash.classify(empty_docs(spark)).count() == 0


@pytest.mark.parametrize("part", [minhash.PART, 8])
def test_minhash_chains_and_hubs(spark, monkeypatch, part):
    """Copies in parts of a bucket; chains whose ends aren't linked, and copies that are linked by their base only, which isn't the smallest id."""
    rng = random.Random(5)
    base = [f"t{rng.randrange(10**6)}" for _ in range(200)]
    rows, i = [], 0

    def add(words, doc_id):
        rows.append((doc_id, " ".join(words), "en", "s", 0, 0.0, 0, ""))

    chain = list(base)
    for k in range(8):  # each link two words on
        add(chain, 1000 + k)
        for j in (20 * k + 5, 20 * k + 15):
            chain[j] = f"c{k}{j}"
    hub = [f"h{rng.randrange(10**6)}" for _ in range(100)]
    for k in range(40):
        own = list(hub)
        own[2 * k + 5] = f"x{k}"
        own[(2 * k + 50) % 95] = f"y{k}"
        add(own, 2000 + k)
    add(hub, 2500)
    shared = [f"p{j}" for j in range(60)]
    for k in range(30):  # half in common: many shared buckets, no link
        add(shared + [f"q{k}_{j}" for j in range(40)], 3000 + k)
    for k in range(30):
        add(base, 900 + k)
    rng.shuffle(rows)
    monkeypatch.setattr(minhash, "PART", part)
    assert found(minhash.classify(spark.createDataFrame(rows, DOCS))) == brute_components(rows)


def test_signature_estimates_similarity():
    rng = np.random.default_rng(3)
    common, a, b = (rng.integers(0, 2**63, n, dtype=np.uint64) for n in (850, 75, 75))
    x, y = minhash.signature(np.concatenate((common, a))), minhash.signature(np.concatenate((common, b)))
    assert abs((x == y).mean() - 0.85) < 0.1


def test_long_texts_are_taken_apart_in_bounded_memory():
    """A batch is bounded in rows, so long texts (or copies that are small while packed) can meet in one."""
    rng = random.Random(7)
    own = [" ".join(rng.choices("abcdefghijklmnopqrstuvwxyz", k=80_000)) for _ in range(25)]
    batch = pa.RecordBatch.from_arrays([pa.array([*range(50)], pa.int64()), pa.array(own + ["many words " * 15_000 + str(i) for i in range(25)])], ["doc_id", "text"])
    press = zstandard.ZstdCompressor(level=1)
    packed = pa.RecordBatch.from_arrays([pa.array([b"%16d" % i for i in range(50)]), pa.array([b"root"] * 50), pa.array([press.compress(t.encode()) for t in batch.column("text").to_pylist()])], ["node", "root", "packed"])
    for make, given in ((minhash._signed, batch), (minhash._sets, packed)):
        tracemalloc.start()
        try:
            rows = sum(b.num_rows for b in make(iter([given])))
            peak = tracemalloc.get_traced_memory()[1]
        finally:
            tracemalloc.stop()
        assert rows == 50
        assert peak < 150e6  # for 8 MB of text


@pytest.mark.parametrize("piece", [7, 64, 1000])
def test_word_hashes_do_not_depend_on_pieces(monkeypatch, piece):
    rng = random.Random(9)
    texts = ["", " \t\n", "Q" * 700, " " * 90 + "x" * 300 + "\v" + "yz" * 200 + " end"]
    texts += ["".join(rng.choice("aBé日 \t\n\v ") for _ in range(rng.randrange(400))) for _ in range(40)]
    whole = bytehash.word_hashes(texts)
    monkeypatch.setattr(bytehash, "PIECE", piece)
    cut = bytehash.word_hashes(texts)
    assert [x.tolist() for x in cut] == [x.tolist() for x in whole]


def test_few_words_alone():
    """A text that is taken apart alone has the set that it has among others."""
    texts = ["", "a", "a b", "a b c", "a b c d", "a b c d e", "a b c d e f"]
    among = bytehash.shingles(*bytehash.word_hashes(texts))
    assert [len(s) for s in among] == [0, 1, 1, 1, 1, 1, 2]
    for text, s in zip(texts, among, strict=True):
        assert bytehash.shingles(*bytehash.word_hashes([text]))[0].tolist() == s.tolist()


def test_minhash_short_texts_of_one_signature(spark):
    """Sets of one shingle have few signatures, so larger tables hold short texts that are alike in every bucket and aren't linked."""
    first, rows = {}, []
    for n in range(1, 5):
        texts = [" ".join([f"a{i}", *"bcd"[: n - 1]]) for i in range(4000)]
        for text, s in zip(texts, bytehash.shingles(*bytehash.word_hashes(texts)), strict=True):
            other = first.setdefault((n, minhash.signature(s).tobytes()), text)
            if other != text:
                rows += [(len(rows), other, "en", "s", 0, 0.0, 0, ""), (len(rows) + 1, text, "en", "s", 0, 0.0, 0, "")]
                break
    assert [len(r[1].split()) for r in rows] == [1, 1, 2, 2, 3, 3, 4, 4]
    df = spark.createDataFrame(rows, DOCS)
    assert found(minhash.classify(df)) == brute_components(rows)
    assert sorted(map(tuple, minhash.stage(spark, df, "").collect())) == rows


def brute_hits(rows, items):
    def words(t):
        t = (t or "").translate({c: chr(c + 32) for c in range(65, 91)})
        return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", t)

    out = []
    for r in rows:
        w, mark, ids = words(r[1]), set(), set()
        for item, text in items:
            q = words(text)
            for s in range(max(1, len(q) - 12) if q else 0):
                g = q[s : s + 13]
                for i in range(len(w) - len(g) + 1):
                    if w[i : i + len(g)] == g:
                        mark.update(range(i, i + len(g))), ids.add(str(item))
        out.append((r[0], len(w), len(mark), len(ids), hashlib.sha256(",".join(sorted(ids)).encode()).hexdigest(), bool(mark) and 20 * len(mark) >= len(w)))
    return sorted(out, key=str)


def test_decontaminate_against_brute_force(spark):
    rows, _ = odd_docs(spark)
    long = rows[-2][1].split()
    items = [(1, " ".join(long[50:90])), (2, "W1, w2! w3"), (3, None), (4, ""), (5, " ".join(long[60:80]).upper()), (10, " ".join(long[60:80])), (7, "straße--ﬁn"), (8, rows[3][1])]
    rows = [*rows, (500, "a b w1 w2 w3 w1.W2 w3", *rows[0][2:]), (501, "straße ﬁn straße ﬁn", *rows[0][2:]), (502, " ".join(long[70:84] + ["zzz"] * 400), *rows[0][2:])]
    df = spark.createDataFrame(rows, DOCS).repartition(3)
    bench = spark.createDataFrame(items, "item_id long, text string")
    want = brute_hits(rows, items)
    for block in (8_000_000, 300):
        got = decontaminate.verdict(decontaminate.find(df, bench, block))
        assert sorted((tuple(r) for r in got.collect()), key=str) == want
    assert decontaminate.find(empty_docs(spark), bench).count() == 0
    none = decontaminate.verdict(decontaminate.find(df, bench.limit(0)))
    assert {(r.n_hit, r.contaminated) for r in none.collect()} == {(0, False)}


def test_stage_does_not_depend_on_blocks(spark, tmp_path):
    """Documents hit by items of several blocks: by a little of each, and by windows that overlap."""
    own = [[f"i{k}x{j}" for j in range(14)] for k in range(24)]
    items = [(k, " ".join(w)) for k, w in enumerate(own)] + [(100 + k, " ".join([*own[k][5:], *own[k + 1][:6]])) for k in range(23)]
    spark.createDataFrame(items, "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    rest = [f"r{j}" for j in range(1400)]
    texts = [" ".join([*rest[:300], *own[k], *rest[300:500], *own[k + 8], *rest[500 : 500 + more]]) for k in range(8) for more in (0, 400)]
    texts += [" ".join([*rest[:500], *own[k], *own[k + 1], *rest[500:1400]]) for k in range(8)] + [" ".join(rest), "", None, " ".join(own[3])]
    rows = [(i, t, None if t is None else len(t)) for i, t in enumerate(texts)]
    docs = spark.createDataFrame([*rows, rows[1], rows[1], (None, texts[3], 5)], "doc_id long, text string, n_chars long")
    whole, small = (sorted(map(tuple, decontaminate.stage(spark, docs, str(tmp_path), size).collect()), key=str) for size in (8_000_000, 900))
    assert decontaminate._blocks(spark.read.parquet(f"{tmp_path}/benchmark.parquet"), 900)[1] > 3
    assert small == whole
    assert 0 < len(whole) < len(rows) + 3
    assert not any(re.search(r"i[0-9]+x", t or "") for _, t, _ in whole)


def test_fm_index_on_periodic_text():
    rng = random.Random(1)
    for _ in range(50):
        s = np.array([rng.choice([2, 3, 4]) if rng.random() < 0.95 else 1 for _ in range(rng.randrange(1, 80))])
        index = decontaminate.FMIndex(s)
        for m in (1, 2, 5):
            p = np.array([[rng.choice([2, 3, 4, 9]) for _ in range(m)]])
            lo, hi = index.search(p, np.array([m]))
            at = sorted(index.locate(np.arange(lo[0], hi[0])).tolist())
            assert at == [i for i in range(len(s) - m + 1) if s[i : i + m].tolist() == p[0].tolist()]


def test_cut_out_keeps_the_rest():
    assert decontaminate.cut_out("Ab, cd. EF gh-ij!", [(1, 3)]) == "Ab,  gh-ij!"
    assert decontaminate.cut_out("one two", [(0, 2)]) == ""


def canon(t):
    fold = unicodedata.normalize("NFKC", unicodedata.normalize("NFKC", t).casefold())
    return " ".join(fold.split())


def test_fingerprints(spark):
    rows, df = odd_docs(spark)
    df.createOrReplaceTempView("odd_documents")
    rows = [(-1 if r[0] is None else r[0], r[1] or "") for r in rows]
    rows.sort()

    def fp(t):
        b = canon(t).encode()
        return f"{xxhash.xxh64_intdigest(b, 42):016x}{xxhash.xxh64_intdigest(b, xxhash.xxh64_intdigest(b'wide', 42)):016x}"

    want = []
    for k, (i, t) in enumerate(rows):
        nxt = rows[(k + 1) % len(rows)][1]
        cut = len(t) // 4
        e = t[: len(t) - cut] + nxt[:cut]
        want.append((i, len(t), hashlib.sha256(e.encode()).hexdigest(), fp(t), fp(e), float(fp(t) == fp(e)), float(fp(t) == fp(nxt))))
    import millrace.llm.fingerprints as module

    before = module.documents
    module.documents = lambda spark, d: df
    try:
        got = fingerprints.op7_fingerprints(spark, "")
        rows7 = got.collect()
        names = got.queryExecution if hasattr(got, "queryExecution") else got._jdf.queryExecution()
        assert "Python" not in names.toString() and "Arrow" not in names.toString()
    finally:
        module.documents = before
    have = sorted((-1 if r.doc_id is None else r.doc_id, *tuple(r)[1:7]) for r in rows7)
    assert have == sorted(want)
    groups = {}
    for i, t in rows:
        groups.setdefault(canon(t), []).append(i)
    assert sorted(r.n_copies for r in rows7) == sorted(len(groups[canon(t)]) for _, t in rows)


def test_fingerprints_fold_but_do_not_confuse(spark):
    df = spark.createDataFrame([(1, "Straße  é\n"), (2, "STRASSE É"), (3, "strasse e")], "doc_id long, text string")
    got = {r.class_id: r.n_copies for r in fingerprints.classes(df).collect()}
    assert got == {1: 2, 3: 1}
    assert fingerprints.classes(empty_docs(spark)).count() == 0
