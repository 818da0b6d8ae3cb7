"""Queries of training steps: what the step builder makes, its consumption ledger, checkpoints, resume, replay and fork."""

from __future__ import annotations

import json

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from millrace.functions import text as T
from millrace.operators.ordered import hash_order, prefix_sums
from millrace.operators.stepper import ATTEMPTS, MICROBATCH, MORE, PER_STEP, RANKS, Builder, Plan
from millrace.plans.curriculum import FLOORS, LANES, LENGTH, STAGES, WARM_UP, values
from millrace.plans.hygiene import trajectories
from millrace.plans.packing import fill
from millrace.plans.windows import GRADED
from millrace.registry import query
from millrace.session import importable, materialize, table

#: Steps of a run, the tokens its schedule is made for, and the step at which the run is cut off.
STEPS, RUN_TOKENS, CRASH, SEED = 24, 40_000, 15, 1234
EVERY, KEEP_MODELS, KEEP_OPTIMISERS = 4, 6, 2
_LANE_OF = {"en": "web", "fr": "code", "de": "indic", "es": "stem"}
#: From this length on a trajectory counts as reasoning.
LONG_TALK = 120


def plan(edit: float = 0.0, tokens: int = RUN_TOKENS) -> Plan:
    """The stage schedule over `tokens`; `edit` moves that share from web to indic."""
    edges = [0, *(int(s[1] * tokens) for s in STAGES)]
    warm = [int((b - a) * WARM_UP) for a, b in zip(edges, edges[1:], strict=False)]
    shares = np.array([s[3] for s in STAGES]) / 100.0
    moved = np.minimum(shares[:, LANES.index("web")], edit)
    shares[:, LANES.index("web")] -= moved
    shares[:, LANES.index("indic")] += edit
    lengths = [max(32, round(s[2] * LENGTH / 32) * 32) for s in STAGES]
    bands = [0, *((min(a, b) or b) for a, b in zip(warm, warm[1:], strict=False))]
    return Plan(LANES, edges[:-1], [s[0] for s in STAGES], lengths, bands, np.round(shares, 4), np.array([FLOORS.get(lane, 0.0) for lane in LANES]), LENGTH)


def pool(spark, sf, steps: int = STEPS) -> DataFrame:
    """lane, id, kind, n, spans, score: of each lane as much, in its first order, as `steps` can draw at most."""
    docs = table(spark, sf, "documents")
    lane = F.element_at(F.create_map(*[F.lit(x) for kv in _LANE_OF.items() for x in kv]), F.col("lang"))
    n = F.size(T.words("text")).cast("long") + 1
    plain = docs.select(lane.alias("lane"), F.concat(F.lit("d"), F.col("doc_id")).alias("id"), F.lit("pretrain").alias("kind"), n.alias("n")).where("lane IS NOT NULL")
    plain = plain.withColumn("spans", F.array(F.array(F.lit(0).cast("long"), F.col("n"))))
    graded = F.expr(f"transform(filter(spans, x -> x.role = '{GRADED}'), x -> array(x.a, x.b))")
    talks = trajectories(spark, sf).select(F.when(F.col("n_tokens") >= LONG_TALK, "reasoning").otherwise("agentic").alias("lane"), F.concat(F.lit("c"), F.col("conv_id")).alias("id"), F.lit("agentic").alias("kind"), F.col("n_tokens").alias("n"), graded.alias("spans"))
    rows = plain.unionByName(talks).withColumn("score", hash_order(F.lit("score"), F.col("id")) % 400 / 100.0 - 2).withColumn("h", hash_order(F.lit(str(SEED)), F.col("lane"), F.lit("0"), F.col("id")))
    most = steps * ATTEMPTS * int(PER_STEP * LENGTH * MORE)
    return prefix_sums(rows, ["lane"], ["h", "id"], {"before": F.col("n")}).where(F.col("before") < most).drop("h", "before")


_MEMBERS = "run string, step int, stage string, length int, seq int, rank int, accum int, microbatch string, lane string, policy string, segment int, id string, pass int, lo long, hi long, placed long, loss long, truncated boolean, state string"


def run(items: DataFrame, runs: list[tuple[str, int, float, str | None]]) -> DataFrame:
    """Members of every window of every run (name, steps, edit of the mixture, state to start from), a group a run.

    A step's last member carries the state behind it; a step is read whole or not at all.
    """

    def one(key: tuple, rows: pd.DataFrame) -> pd.DataFrame:
        name, steps, edit, state = rows.iloc[0][["run", "steps", "edit", "state"]]
        lanes: dict[str, list[dict]] = {}
        for r in rows.sort_values(["lane", "id"]).itertuples(index=False):
            lanes.setdefault(r.lane, []).append({"id": r.id, "kind": r.kind, "n": int(r.n), "spans": [(int(a), int(b)) for a, b in r.spans], "score": float(r.score)})
        builder = Builder(lanes, plan(float(edit)), fill, SEED, json.loads(state) if state else None)
        out = []
        for _ in range(int(steps)):
            s = builder.build()
            for seq, (lane, policy, members) in enumerate(s["windows"]):
                batch, placed = seq // MICROBATCH, 0
                for k, m in enumerate(members):
                    out.append((name, s["step"], s["stage"], s["length"], seq, batch % RANKS, batch // RANKS, f"s{s['step']:05d}-r{batch % RANKS}-a{batch // RANKS}", lane, policy, k, m["id"], m["pass"], m["lo"], m["hi"], placed, m["loss"], m["hi"] < m["whole"], None))
                    placed += m["hi"] - m["lo"]
            if s["windows"]:
                out[-1] = (*out[-1][:-1], json.dumps(builder.state()))
        return pd.DataFrame(out, columns=[c.split(" ")[0] for c in _MEMBERS.split(", ")])

    spark = items.sparkSession
    importable(spark)
    listed = values(spark, runs, "run string, steps int, edit double, state string")
    return items.crossJoin(F.broadcast(listed)).groupBy("run").applyInPandas(one, _MEMBERS)


def records(members: DataFrame) -> DataFrame:
    """The consumption ledger: one record a microbatch, with digests over what stands in it and over what is graded."""
    key = ["run", "step", "stage", "length", "rank", "accum", "microbatch"]
    place = F.array_sort(F.collect_list(F.struct("seq", "segment", "id", "lo", "hi", "placed", "loss", "pass", "lane")))
    text = lambda *c: F.array_join(F.transform("m", lambda x: F.concat_ws(":", *[x[i].cast("string") for i in c])), ",")
    rows = members.groupBy(*key).agg(place.alias("m"), F.array_sort(F.collect_set("policy")).alias("policies"))
    lanes = F.array_sort(F.array_distinct(F.transform("m", lambda x: x["lane"])))
    of = lambda lane, c: F.aggregate(F.filter("m", lambda x: x["lane"] == lane), F.lit(0).cast("long"), lambda s, x: s + c(x))
    return rows.select(
        *key, F.size(F.array_distinct(F.transform("m", lambda x: x["seq"]))).alias("n_sequences"), F.size("m").alias("n_members"), F.array_join("policies", ",").alias("policies"), F.array_join(lanes, ",").alias("lanes"),
        F.aggregate("m", F.lit(0).cast("long"), lambda s, x: s + x["hi"] - x["lo"]).alias("tokens"), F.aggregate("m", F.lit(0).cast("long"), lambda s, x: s + x["loss"]).alias("loss_tokens"),
        F.map_from_arrays(lanes, F.transform(lanes, lambda x: of(x, lambda y: y["loss"]))).alias("loss_by_lane"), F.sha2(text("seq", "segment", "id", "lo", "hi", "placed").cast("binary"), 256).alias("batch_hash"), F.sha2(text("seq", "placed", "loss").cast("binary"), 256).alias("loss_mask_hash"),
        F.array_join(F.transform("m", lambda x: F.format_string("%s:%d-%d", x["id"], x["lo"], x["hi"])), " ").alias("span_ids"),
    )


def main_run(spark, sf) -> tuple[DataFrame, DataFrame]:
    """The pool and the members of an uninterrupted run, both written."""
    items = materialize(spark, pool(spark, sf), "step-pool")
    return items, materialize(spark, run(items, [("main", STEPS, 0.0, None)]), "step-members")


@query("stream_build")
def stream_build(spark, sf):
    """Microbatch records of a run."""
    return records(main_run(spark, sf)[1]).drop("loss_by_lane", "run")


@query("stream_members")
def stream_members(spark, sf):
    """Which part of which item stands where in which window of which step."""
    return main_run(spark, sf)[1].drop("run", "state")


@query("stream_quotas")
def stream_quotas(spark, sf):
    """Windows of each lane over the run against its mixture, with and without blending and floors."""
    _, members = main_run(spark, sf)
    windows = members.select("step", "stage", "lane", "seq", "length").distinct()
    served = windows.groupBy("stage", "lane").agg(F.count("*").alias("windows"), F.sum("length").alias("positions"))
    shares = values(spark, [(s[0], lane, x / 100.0, FLOORS.get(lane, 0.0)) for s in STAGES for lane, x in zip(LANES, s[3], strict=True)], "stage string, lane string, planned_raw double, floor double")
    totals = served.groupBy("stage").agg(F.sum("positions").alias("all"))
    share = F.col("positions") / F.col("all")
    return served.join(F.broadcast(shares), ["stage", "lane"]).join(F.broadcast(totals), "stage").select(
        "stage", "lane", "windows", "positions", F.greatest("planned_raw", "floor").alias("planned_effective"), "planned_raw", F.round(share, 6).alias("actual"), F.round(F.abs(share - F.col("planned_raw")), 6).alias("error"), (share >= F.col("floor") - 0.005).alias("floor_held")
    )


def compared(expected: DataFrame, got: DataFrame) -> DataFrame:
    """Per run in `got`: records of both sides by ordinal, and how many differ in any of six fields or are missing."""
    order = ["step", "accum", "rank"]
    fields = ["step", "microbatch", "batch_hash", "loss_mask_hash", "span_ids", "loss_tokens"]

    def listed(df: DataFrame) -> DataFrame:
        # A run has RANKS * ACCUMULATE records a step: the ordinal is arithmetic, no window.
        first = df.groupBy("run").agg(F.min("step").alias("s0"))
        return df.join(F.broadcast(first), "run").select("run", ((F.col("step") - F.col("s0")) * PER_STEP + F.col("accum") * RANKS + F.col("rank")).alias("ordinal"), F.struct(*fields).alias("r"), *order)

    a = listed(expected).select(F.col("run").alias("_e"), "ordinal", F.col("r").alias("a"))
    names = got.select("run").distinct()
    a = a.drop("_e").crossJoin(F.broadcast(names))
    b = listed(got).select("run", "ordinal", F.col("r").alias("b"))
    both = a.join(b, ["run", "ordinal"], "full")
    return both.groupBy("run").agg(F.count("a").alias("expected"), F.count("b").alias("got"), F.count_if(~F.col("a").eqNullSafe(F.col("b"))).alias("differ")).withColumn("identical", F.col("differ") == 0)


def state_after(members: DataFrame, step: int) -> str:
    """The state row of one step: a checkpoint."""
    return members.where((F.col("step") == step) & F.col("state").isNotNull()).select("state").first()[0]


@query("resume_exact")
def resume_exact(spark, sf):
    """A run that stopped goes on from its checkpoint: exactly the same with the whole state, otherwise if any field of it is lost."""
    items, members = main_run(spark, sf)
    at = CRASH // EVERY * EVERY
    state = json.loads(state_after(members, at - 1))
    runs = [("resumed", STEPS - at, 0.0, json.dumps(state)), ("from scratch", STEPS - at, 0.0, json.dumps({"step": at}))]
    runs += [(f"without {k}", STEPS - at, 0.0, json.dumps({x: v for x, v in state.items() if x != k})) for k in ("tokens", "cursor", "epoch", "carry")]
    got = materialize(spark, run(items, runs), "step-resumed")
    return compared(records(members.where(F.col("step") >= at)), records(got))


@query("replay_compare")
def replay_compare(spark, sf):
    """Steps built again from each kept checkpoint, against the ledger."""
    items, members = main_run(spark, sf)
    spots = list(range(EVERY, STEPS, EVERY))
    runs = [(f"from {at}", EVERY, 0.0, state_after(members, at - 1)) for at in spots]
    got = records(materialize(spark, run(items, runs), "step-replayed"))
    ledger = records(members)
    out = None
    for at in spots:
        one = compared(ledger.where((F.col("step") >= at) & (F.col("step") < at + EVERY)), got.where(F.col("run") == f"from {at}"))
        out = one if out is None else out.unionByName(one)
    return out


@query("fork_divergence")
def fork_divergence(spark, sf):
    """A branch that goes on from a checkpoint with another mixture: lanes' windows on both branches, and where they part."""
    items, members = main_run(spark, sf)
    at = CRASH // EVERY * EVERY
    fork = materialize(spark, run(items, [("fork", STEPS - at, 0.10, state_after(members, at - 1))]), "step-fork")
    windows = lambda df, name: df.where(F.col("step") >= at).select("step", "lane", "seq").distinct().groupBy("step", "lane").agg(F.count("*").alias(name))
    both = windows(members, "main").join(windows(fork, "fork"), ["step", "lane"], "full").na.fill(0)
    return both.select("step", "lane", "main", "fork", (F.col("main") != F.col("fork")).alias("differs"))


_CKPT = f"""c AS (SELECT k * {EVERY} AS step, row_number() OVER (ORDER BY k DESC) AS back FROM range(1, {STEPS // EVERY + 1}) r(k))"""


@query("ckpt_index", f"WITH {_CKPT} SELECT CAST(step AS BIGINT) AS step, CAST(step * 4 AS BIGINT) AS ledger_offset, back <= {KEEP_MODELS} AS model_kept, back <= {KEEP_OPTIMISERS} AS optimiser_kept, 'ckpt-' || lpad(CAST(step AS VARCHAR), 5, '0') AS checkpoint_id FROM c")
def ckpt_index(spark, sf):
    """Checkpoints with the ledger's offset that each is bound to, counted from the ledger, and what retention keeps."""
    _, members = main_run(spark, sf)
    ledger = members.select("step", "microbatch").distinct().groupBy("step").agg(F.count("*").alias("n"))
    marks = spark.range(1, STEPS // EVERY + 1).select((F.col("id") * EVERY).alias("at"))
    spots = ledger.join(F.broadcast(marks), F.col("step") < F.col("at")).groupBy("at").agg(F.sum("n").alias("ledger_offset"))
    later = STEPS // EVERY - F.col("at") / EVERY
    return spots.select(F.col("at").alias("step"), "ledger_offset", (later < KEEP_MODELS).alias("model_kept"), (later < KEEP_OPTIMISERS).alias("optimiser_kept"), F.concat(F.lit("ckpt-"), F.lpad(F.col("at").cast("string"), 5, "0")).alias("checkpoint_id"))
