"""What no SQL checks: runs of steps, ledgers, page caches, reports, controls that must fail."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from millrace.functions import text as T
from millrace.operators import stepper
from millrace.plans import evidence, steps, windows
from millrace.plans.packing import fill
from millrace.registry import QUERIES
from millrace.sources import mappers, pages
from millrace.sources.ledger import Ledger

SF = "/root/testdata/sf0.001"


def pool(n=12):
    rng = np.random.default_rng(3)
    lanes = {}
    for lane in steps.LANES:
        kind = "agentic" if lane in ("reasoning", "agentic") else "pretrain"
        sizes = rng.integers(20, 900, n).tolist()
        spans = lambda m: [(m // 2, m)] if kind == "agentic" else [(0, m)]
        lanes[lane] = [{"id": f"{lane}{i}", "kind": kind, "n": m, "spans": spans(m), "score": float(rng.normal())} for i, m in enumerate(sizes)]
    return lanes


def digest(s):
    return s["step"], s["windows"]


def test_builder_goes_on_from_its_state_and_not_from_less():
    whole = stepper.Builder(pool(), steps.plan(), fill)
    first = [digest(whole.build()) for _ in range(10)]
    state = whole.state()
    rest = [digest(whole.build()) for _ in range(8)]
    again = stepper.Builder(pool(), steps.plan(), fill, state=state)
    assert [digest(again.build()) for _ in range(8)] == rest
    assert any(e > 0 for e in state["epoch"].values())  # lanes came round
    for lost in ("tokens", "cursor", "epoch", "carry"):
        less = stepper.Builder(pool(), steps.plan(), fill, state={k: v for k, v in state.items() if k != lost})
        assert [digest(less.build()) for _ in range(8)] != rest, lost
    assert [digest(stepper.Builder(pool(), steps.plan(), fill).build())] == first[:1]


def test_builder_keeps_to_its_rules():
    b = stepper.Builder(pool(), steps.plan(), fill)
    items = {i["id"]: i for lane in pool().values() for i in lane}
    for _ in range(20):
        s = b.build()
        assert sum(s["quotas"].values()) == stepper.PER_STEP and len(s["windows"]) <= stepper.PER_STEP
        for lane, policy, members in s["windows"]:
            assert sum(m["hi"] - m["lo"] for m in members) <= s["length"] and sum(m["loss"] for m in members) > 0
            assert policy == ("structure_preserving" if lane in ("reasoning", "agentic") else "long_context" if lane == "web" and s["length"] == steps.LENGTH else "best_fit")
            for m in members:
                item = items[m["id"]]
                assert 0 <= m["lo"] < m["hi"] <= item["n"] and m["loss"] == sum(1 for p in range(m["lo"], m["hi"]) if any(x <= p < y for x, y in item["spans"]))


def test_quotas_stay_near_their_shares():
    shares, carry, total = np.array([0.6, 0.14, 0.14, 0.09, 0.02, 0.01]), np.zeros(6), np.zeros(6)
    for k in range(1, 200):
        counts, carry = stepper.whole_quotas(shares, np.zeros(6), carry)
        total += counts
        assert counts.sum() == 16 and (np.abs(total - k * 16 * shares) <= 1 + 1e-9).all()
    floors = np.array([0, 0, 0.1, 0, 0.04, 0.01])
    counts, _ = stepper.whole_quotas(np.array([0.9, 0.1, 0, 0, 0, 0]), floors, np.zeros(6), 100)
    assert counts.tolist() == [76, 9, 10, 0, 4, 1] or counts.sum() == 100 and (counts[[2, 4, 5]] == [10, 4, 1]).all()


def test_best_start_is_the_first_of_the_best():
    rng = np.random.default_rng(1)
    for _ in range(200):
        n, length = int(rng.integers(1, 60)), int(rng.integers(1, 30))
        edges = sorted(rng.choice(n + 1, size=min(n + 1, 4) // 2 * 2, replace=False).tolist())
        spans = list(zip(edges[::2], edges[1::2]))
        cover = [stepper.graded_in(spans, o, o + length) for o in range(max(1, n - length + 1))]
        assert stepper.best_start(n, spans, length) == (int(np.argmax(cover)) if n > length else 0)


def test_resume_replay_and_fork(spark):
    runs = {r.run: r for r in QUERIES["resume_exact"](spark, SF).collect()}
    assert runs["resumed"].identical and runs["resumed"].got == runs["resumed"].expected > 0
    assert not any(runs[k].identical for k in runs if k != "resumed"), runs
    replays = QUERIES["replay_compare"](spark, SF).collect()
    assert len(replays) == 5 and all(r.identical and r.got == r.expected for r in replays)
    fork = QUERIES["fork_divergence"](spark, SF).collect()
    assert any(r.differs for r in fork) and sum(r.fork for r in fork if r.lane == "indic") > sum(r.main for r in fork if r.lane == "indic")


def test_step_records_bind_members(spark):
    rows = QUERIES["stream_members"](spark, SF)
    over = rows.groupBy("step", "seq").agg(F.sum(F.col("hi") - F.col("lo")).alias("n"), F.max("length").alias("length"), F.max("placed").alias("p")).where("n > length").count()
    assert over == 0 and rows.groupBy("step", "seq", "segment").count().where("count > 1").count() == 0
    recs = QUERIES["stream_build"](spark, SF).collect()
    assert len({r.batch_hash for r in recs}) == len(recs) and all(r.batch_hash[:32] != r.loss_mask_hash[:32] for r in recs)
    assert sum(r.tokens for r in recs) == rows.agg(F.sum(F.col("hi") - F.col("lo"))).first()[0]


def test_spoilt_windows_are_caught_by_their_own_rule(spark):
    packs = windows.arrays(spark, SF)
    names = F.array(*map(F.lit, windows.RULES))
    broken = F.filter(F.zip_with(names, windows.violations(), lambda n, b: F.when(b, n)), lambda x: x.isNotNull())
    assert packs.where(F.size(broken) > 0).count() == 0
    for r in windows.spoilt(packs).select("bin", "used", broken.alias("b")).collect():
        k = r.bin % 8
        if k and not (k in (2, 3) and r.used == windows.WIDTH):
            assert windows.RULES[k - 1] in r.b


def test_ledger_goes_on_behind_its_last_record(spark, tmp_path):
    ledger = Ledger(spark, f"file://{tmp_path}/ledger", "n long")
    rows = lambda *x: spark.createDataFrame([(i,) for i in x], "n long")
    assert [ledger.append("a", rows(5), ["n"]), ledger.append("a", rows(9, 7), ["n"]), ledger.append("b", rows(1), ["n"])] == [0, 1, 0]
    assert sorted((r.ledger_offset, r.n) for r in ledger.table("a").collect()) == [(0, 5), (1, 7), (2, 9)]
    assert [r.n for r in ledger.at("a", 1).collect()] == [7] and ledger.read_from("a", 1).count() == 2 and ledger.read_range("a", 0, 2).count() == 2


def test_pages_are_fetched_once_and_again_after_errors(spark, tmp_path):
    path, log = f"file://{tmp_path}/pages", tmp_path / "log"

    def get(offset: int) -> str:
        log.open("a").write(f"{offset}\n")
        if len(log.read_text().split()) == 1:
            raise OSError("first try")
        return '{"rows": [{"row": {"x": %d, "t": "a b"}}, {"row": {"x": null, "t": "c"}}]}' % offset

    assert pages.fetch(spark, path, [0], get, wait=0.0) == 1
    assert pages.fetch(spark, path, [0, 100], get, wait=0.0) == 1
    assert sorted(log.read_text().split()) == ["0", "0", "100"]
    assert sorted((r.offset, r["at"], r.x, r.t) for r in pages.rows(spark, path, "x bigint, t string").collect()) == [(0, 0, 0, "a b"), (0, 1, None, "c"), (100, 0, 100, "a b"), (100, 1, None, "c")]
    with pytest.raises(OSError):
        pages.fetch_page(lambda o: (_ for _ in ()).throw(OSError()), 0, wait=0.0)


def test_mappers(spark):
    talk = spark.createDataFrame([("a", [("human", " q "), ("gpt", "x" * 300), ("other", "y"), ("tool", " ")]), ("b", [("human", "no answer" * 50)]), ("c", None)], "id string, t array<struct<`from`: string, value: string>>")
    got = mappers.kept(mappers.talks(talk, F.col("id"), "t")).collect()
    assert [(r.row_id, [s.role for s in r.segments], r.chars) for r in got] == [("a", ["user", "assistant"], 301)]
    solved = spark.createDataFrame([("p" * 300, "s" * 1100), ("p" * 300, "s" * 1099), ("p", " "), (None, "s")], "p string, s string")
    assert sorted(r.lane for r in mappers.kept(mappers.solved(solved, F.lit("set"), "p", "s")).collect()) == ["reasoning", "stem"]


def test_normalize_odd_texts(spark):
    cases = {
        "&lt;b&gt; x &amp; y;": "<b> x & y;", "é  a  b": "é a b", " a \n\n\n\n b\t\n": "a\n\nb", "a‍‌b​﻿": "a‍‌b", "x\x00\x1fy\x7f": "xy", "": "", "\n \n": "",
        "l1 \t\n  l2　\n": "l1\nl2", None: None,
    }
    rows = T.with_normal(spark.createDataFrame([(k,) for k in cases], "text string")).collect()
    assert {r.text: r.t for r in rows} == cases


def test_report_escapes_and_counts_failures():
    rows = [{"requirement": "a|b", "result": "FAIL", "detail": "x\ny" * 2000, "left": 1, "right": 2}, {"requirement": "c", "result": "PASS", "detail": "d", "left": 3, "right": 3}]
    text = evidence.markdown(rows)
    assert "2 checks, 1 failed." in text and "a\\|b" in text and max(map(len, text.split("\n"))) < 3000 and text.count("\n") == 8


def test_bundle_fails_where_a_side_is_off(spark, monkeypatch):
    one = ("planted", "1; 2", lambda s, f: (s.range(1).agg(F.count("*").alias("v")), s.range(2).agg(F.count("*").alias("v"))), "SELECT 1")
    monkeypatch.setattr(evidence, "CHECKS", (one,))
    rows, text = evidence.report(evidence.bundle(spark, SF))
    assert [(r.result, r.left, r.right) for r in rows.collect()] == [("FAIL", 1, 2)]
    assert spark.read.text(text).where("value = '1 checks, 1 failed.'").count() == 1
