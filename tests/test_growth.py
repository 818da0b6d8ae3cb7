"""What larger or odd tables showed: results against SQL on rows made here, and steps that must not be repeated for each row or shuffle its words."""

import contextlib
import io

import duckdb
import pytest
from pyspark.sql import functions as F

from millrace.registry import QUERIES, SQL
from tests.test_queries import SF, rows


@pytest.fixture
def documents(spark, tmp_path):
    """Writes texts, by doc_id, as the table of documents of a folder of tables."""

    def write(texts, lang="en"):
        lang_of = lang if callable(lang) else lambda i: lang
        data = [(i, t, lang_of(i), "web" if i % 2 else "books", len(t)) for i, t in texts]
        spark.createDataFrame(data, "doc_id long, text string, lang string, source string, n_chars long").coalesce(1).write.mode("overwrite").parquet(f"{tmp_path}/documents.parquet")
        return str(tmp_path)

    return write


def same_as_sql(spark, folder, name):
    con = duckdb.connect()
    con.execute(f"CREATE VIEW documents AS SELECT * FROM read_parquet('{folder}/documents.parquet/*.parquet')")
    for t in ("benchmark", "conversations", "pages", "events"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{SF}/{t}.parquet')")
    got, want = QUERIES[name](spark, folder), con.execute(SQL[name])
    names = [d[0] for d in want.description]
    found = rows(names, want.fetchall())
    assert rows(got.columns, map(tuple, got.collect())) == found
    return found


def plan(df):
    out = io.StringIO()
    with contextlib.redirect_stdout(out):
        df.explain("extended")
    return out.getvalue()


def test_encoding_looks_nothing_up_in_a_map(spark, documents):
    """Tokens by the thousand, unknown ones, and the mark that stands between tokens in the text itself."""
    many = " ".join(f"w{i}" for i in range(3000))
    folder = documents([(0, many), (1, "a\0b \0\0 c"), (2, ""), (3, "\0"), (4, "é \U0001d11e once ünknown"), (5, many[:999])])
    assert len(same_as_sql(spark, folder, "fn_encode_vocab")) == 5
    assert "map_contains_key" not in plan(QUERIES["fn_encode_vocab"](spark, folder))


def test_marks_in_tokens():
    from millrace.plans.text import _Spelt, cut_at_marks

    for tokens in (["a", "\0", "b"], ["\0"], ["\0", "\0", "x"], [], ["a"]):
        assert cut_at_marks("".join(t + "\0" for t in tokens)) == tokens
    spelt = _Spelt({"a": 0, "b": 1, "ab": 7})
    assert [spelt[t] for t in ("ab", "ba", "axb", "x")] == [("7", 7), ("1,0", 1), ("0,1", 1), ("", 0)]


def test_sizes_round_as_sql_does(spark, documents):
    """1.005 and 2.675 stand below their decimal digits; so do tenths of MB."""
    sizes = [1005, 2675, 1015, 10049, 1035, 1450, 1050, 999, 1000]
    folder = documents([(4 * i + k, "x" * n) for i, n in enumerate(sizes) for k in range(4)])
    assert [r for r in same_as_sql(spark, folder, "fn_sizes") if r[0] == 2] == [[2, "1.0 GB"]]


def shuffled(spark, run):
    """Bytes that the stages of `run` shuffle."""
    sc = spark.sparkContext
    gateway, store = sc._gateway, sc._jsc.sc().statusStore()

    def stages():
        sc._jsc.sc().listenerBus().waitUntilEmpty(30_000)
        found = store.stageList(None, False, False, gateway.new_array(gateway.jvm.double, 0), gateway.jvm.java.util.ArrayList())
        return {(s.stageId(), s.attemptId()): s.shuffleWriteBytes() for s in (found.apply(i) for i in range(found.size()))}

    spark.range(1).collect()
    last = max(stages())
    run()
    return sum(n for k, n in stages().items() if k > last)


def words_of(i, n=400):
    return " ".join(f"word{(i * 7 + k * (1 + i % 3)) % n}" for k in range(n))


@pytest.mark.parametrize("name", ["agg_shard_cards", "agg_lane_summary", "lm_evaluate", "fn_perplexity", "agg_token_clusters"])
def test_losses_shuffle_no_row_for_each_word_of_a_document(spark, documents, name):
    """Eight times the documents with the same 400 words: what is shuffled grows by less than a byte for each of a document's words."""
    sizes = []
    for n in (40, 320):
        folder = documents([(i, words_of(i)) for i in range(n)], lambda i: "en" if i % 2 else "fr")
        sizes.append(shuffled(spark, QUERIES[name](spark, folder).collect))
    assert sizes[1] - sizes[0] < 280 * 100, sizes


def test_losses_of_rare_words_are_joined(spark, documents):
    """However few words are broadcast, the sums are the same."""
    from millrace.plans.learning import _documents, document_losses

    folder = documents([(i, words_of(i, 50) + f" only{i} pair{i // 2} pair{i // 2}") for i in range(30)] + [(99, "")])
    want = {r.doc_id: (r.n, round(r.loss, 8)) for r in document_losses(_documents(spark, folder)).collect()}
    assert len(want) == 30 and want[3][0] == 53
    for common in (0, 20, 60, 75):
        got = document_losses(_documents(spark, folder), common).collect()
        assert len(got) == 30 and {r.doc_id: (r.n, round(r.loss, 8)) for r in got} == want
    for name in ("agg_shard_cards", "lm_evaluate", "fn_perplexity"):
        same_as_sql(spark, folder, name)


def records_read(spark, run):
    """Rows that the stages of `run` read from tables."""
    sc = spark.sparkContext
    gateway, store = sc._gateway, sc._jsc.sc().statusStore()

    def stages():
        sc._jsc.sc().listenerBus().waitUntilEmpty(30_000)
        found = store.stageList(None, False, False, gateway.new_array(gateway.jvm.double, 0), gateway.jvm.java.util.ArrayList())
        return {(s.stageId(), s.attemptId()): s.inputRecords() for s in (found.apply(i) for i in range(found.size()))}

    spark.range(1).collect()
    last = max(stages())
    run()
    return sum(n for k, n in stages().items() if k > last)


@pytest.mark.parametrize(("name", "most"), [("lane_draw", 1), ("src_lane_sample", 2), ("agg_fertility_rules", 2), ("pack_concat_chop", 1)])
def test_texts_are_read_once_for_each_thing_made_of_them(spark, documents, name, most):
    """Orders, cuts and sums of ranges come from narrow rows that are written once; a policy of packing doesn't cut the texts again.

    Most texts are empty, and not among the narrow rows, which therefore hardly count.
    """
    folder = documents([(i, words_of(i, 50) if i < 40 else "") for i in range(6000)], lambda i: "en" if i % 2 else "fr")
    assert records_read(spark, QUERIES[name](spark, folder).collect) < 6000 * (most + 0.5)


def test_quality_ranks_are_written(spark, documents):
    """Each of the three ranks is made once, so the plan of the result holds the last order only."""
    folder = documents([(i, words_of(i, 9 + i % 17) + ".") for i in range(120)], lambda i: "en" if i % 2 else "fr")
    assert len(same_as_sql(spark, folder, "win_quality_reserve")) == 120
    assert plan(QUERIES["win_quality_reserve"](spark, folder)).split("== Physical Plan ==")[1].count("Window") <= 4


def test_ranges_by_halving(spark):
    from millrace.operators.ordered import range_of

    for ends in ([], [3], [1, 4, 6], list(range(0, 40, 3))):
        got = spark.range(-2, 45).select("id", range_of("id", ends).alias("r")).collect()
        assert [r.r for r in got] == [sum(e < r.id for e in ends) for r in got]


def test_nothing_is_ordered_twice_for_keep_rates(spark, documents):
    """Ranks are written once, so the plan of the result sorts nothing."""
    folder = documents([(i, f"text {i}") for i in range(200)], lambda i: "en" if i % 3 else "fr")
    assert len(same_as_sql(spark, folder, "sel_keep_rates")) == 2
    assert plan(QUERIES["sel_keep_rates"](spark, folder)).split("== Physical Plan ==")[1].count("Window") <= 2


def test_groups_are_packed_as_before(spark, documents):
    """All policies in one go, of long documents and short ones; a group of no document is none."""
    folder = documents([(i, "w " * (i * 37 % 900)) for i in range(230)], lambda i: "en" if i % 2 else "fr")
    assert len(same_as_sql(spark, folder, "pack_verify_pieces")) == 4
    found = plan(QUERIES["pack_verify_pieces"](spark, folder)).split("== Physical Plan ==")[1]
    assert found.count("InPandas") + found.count("InArrow") <= 1
    for name in ("pack_greedy", "pack_best_fit", "pack_structure", "pack_long_context"):
        same_as_sql(spark, folder, name)


@pytest.mark.parametrize("name", ["dedup_greedy", "agg_dedup_report"])
def test_dedup_hashes_texts_once(spark, documents, name):
    """What follows the verdicts' hashes and grams reads no text."""
    folder = documents([(i, words_of(i // 3, 60) + (" more" if i % 3 == 1 else "")) for i in range(30)], lambda i: "en" if i % 2 else "fr")
    assert len(same_as_sql(spark, folder, name)) == (30 if name == "dedup_greedy" else 2)
    assert "text:string" not in plan(QUERIES[name](spark, folder)).split("== Physical Plan ==")[1]


def test_checks_share_what_they_count(spark, monkeypatch):
    """The bundle screens documents once, and makes one manifest."""
    import functools

    from millrace.plans import evidence, hygiene

    made = []

    def counted(f):
        @functools.wraps(f)
        def g(*a, **b):
            made.append(f.__name__)
            return f(*a, **b)

        return g

    for name in ("screen_containment", "manifests"):
        monkeypatch.setattr(hygiene, name, counted(getattr(hygiene, name)))
    evidence.bundle(spark, SF)
    assert sorted(made) == ["manifests", "screen_containment"]


def test_normalized_as_by_single_steps(spark):
    """One pattern for what is dropped, and spaces that stay aren't replaced: the same texts as by a step for each."""
    from millrace.functions import text as T

    texts = ["a  b\tc\u00a0d \u2003 e", " \u3000x \n\t y\u00a0\n\n\n\n z\x00\x1f \u200b ", "a \u200b b", "\ufffd\u00ad", "no change at all", "\x1c\n\x1c a \x85\n\u2028b", None]
    rows = spark.createDataFrame([(t,) for t in texts], "text string")
    t = F.translate(T.nfc(T.unescape(F.col("text"))), T.NOISE, "")
    for pattern, new in ((r"[\x00-\x08\x0b\x0c\x0e-\x1f\x7f]", ""), (r"[ \t\u00A0\u2000-\u200A\u3000]+", " "), (r"\n{3,}", "\n\n"), (f"(?<=\n){T._EDGES}|{T._EDGES}(?=\n)", ""), (f"^{T._STRIP}|{T._STRIP}$", "")):
        t = F.regexp_replace(t, pattern, new)
    assert [r.t for r in T.with_normal(rows).collect()] == [r.t for r in rows.select(t.alias("t")).collect()]
