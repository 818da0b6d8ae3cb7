"""Queries of structured samples in windows: where a long one is read, how policies pack them, the arrays of a window and their checks."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from millrace.functions import text as T
from millrace.operators.ordered import prefix_sums
from millrace.plans.curriculum import LENGTH as MOST_LENGTH
from millrace.plans.curriculum import STAGES, schedule, values
from millrace.plans.hygiene import trajectories
from millrace.plans.packing import GROUP, LENGTH, _ITEMS, _STREAM, concat_chop, fill, items, packed, pieces
from millrace.plans.text import WORDS
from millrace.registry import query
from millrace.session import table

#: Window of trajectories; LENGTH is that of documents.
WIDTH = 64
GRADED = "assistant"
PAD, END = "<pad>", "</s>"

_TRAJECTORIES = f"""tu AS (SELECT conv_id, turn, role, len({WORDS}) AS m, row_number() OVER (PARTITION BY conv_id ORDER BY turn DESC) AS back FROM conversations WHERE len({WORDS}) > 0),
sp AS (SELECT conv_id, role, CAST(coalesce(sum(m) OVER (PARTITION BY conv_id ORDER BY turn ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS BIGINT) AS a, m + (back = 1)::INT AS w FROM tu),
sz AS (SELECT conv_id, CAST(sum(w) AS BIGINT) AS n, CAST(sum(CASE WHEN role = '{GRADED}' THEN w ELSE 0 END) AS BIGINT) AS graded FROM sp GROUP BY conv_id),
mk AS (SELECT conv_id, (role = '{GRADED}')::INT AS g, unnest(range(a, a + w)) AS p FROM sp)"""


def _best_sql(width: int) -> str:
    return f"""cv{width} AS (SELECT conv_id, p AS off, n, sum(g) OVER (PARTITION BY conv_id ORDER BY p ROWS BETWEEN CURRENT ROW AND {width - 1} FOLLOWING) AS cov FROM mk JOIN sz USING (conv_id)),
bw{width} AS (SELECT conv_id, any_value(n) AS n, CAST(arg_min(off, (-cov, off)) AS BIGINT) AS off, CAST(max(cov) AS BIGINT) AS cov, CAST(least(any_value(n), {width}) AS BIGINT) AS take FROM cv{width} WHERE off <= greatest(0, n - {width}) GROUP BY conv_id)"""


def best_window(width: int) -> Column:
    """(cov, off) of the window of `width` places with the most graded tokens of a row's `spans`, the first such.

    What a window covers changes its slope only where an edge of it meets an edge of a graded span, so only
    those places are tried, not every place.
    """
    own = f"filter(spans, x -> x.role = '{GRADED}')"
    edges = f"concat(array(0L), flatten(transform({own}, x -> array(x.a, x.b, x.a - {width}L, x.b - {width}L))))"
    places = f"array_distinct(transform({edges}, o -> greatest(0L, least(o, n_tokens - {width}L))))"
    covered = f"aggregate({own}, 0L, (s, x) -> s + greatest(0L, least(x.b, o + {width}L) - greatest(x.a, o)))"
    return F.expr(f"array_max(transform({places}, o -> named_struct('cov', {covered}, 'back', -o)))")


def structured(spark, sf, width: int = WIDTH) -> DataFrame:
    """conv_id, grp, n, spans, off, cov, take: trajectories and the part of each that a window of `width` takes."""
    rows = trajectories(spark, sf).withColumn("best", best_window(width))
    return rows.select(
        "conv_id", F.floor(F.col("conv_id") / GROUP).alias("grp"), F.col("n_tokens").alias("n"), "spans", (-F.col("best.back")).alias("off"), F.col("best.cov").alias("cov"), F.least(F.col("n_tokens"), F.lit(width).cast("long")).alias("take")
    )


@query("win_best_window", f"WITH {_TRAJECTORIES}, {_best_sql(WIDTH)} SELECT conv_id, n, off, cov AS graded FROM bw{WIDTH}")
def win_best_window(spark, sf):
    """Where a trajectory that is longer than a window is read, so that most of what is graded is inside."""
    return structured(spark, sf).select("conv_id", "n", "off", F.col("cov").alias("graded"))


@query("pack_make_items", f"WITH {_TRAJECTORIES} SELECT conv_id, n, graded, n - graded AS context, n > {WIDTH} AS is_long FROM sz")
def pack_make_items(spark, sf):
    """Items of trajectories: tokens, graded tokens and what is only context."""
    graded = F.expr(f"aggregate(filter(spans, x -> x.role = '{GRADED}'), 0L, (s, x) -> s + x.b - x.a)")
    rows = trajectories(spark, sf).select("conv_id", F.col("n_tokens").alias("n"), graded.alias("graded"))
    return rows.select("conv_id", "n", "graded", (F.col("n") - F.col("graded")).alias("context"), (F.col("n") > WIDTH).alias("is_long"))


@query("pack_pad_best", f"WITH {_TRAJECTORIES}, {_best_sql(WIDTH)} SELECT conv_id, off, take AS occupied, {WIDTH} - take AS pad, cov AS loss, off + take < n AS truncated FROM bw{WIDTH}")
def pack_pad_best(spark, sf):
    """One trajectory a window, read at its best place."""
    return structured(spark, sf).select("conv_id", "off", F.col("take").alias("occupied"), (WIDTH - F.col("take")).alias("pad"), F.col("cov").alias("loss"), (F.col("off") + F.col("take") < F.col("n")).alias("truncated"))


# --- bins in SQL: one level of recursion an item, the room of all bins as a list ---------------------------


def bins_sql(name: str, source: str, policy: str, length: int) -> str:
    """CTEs that put items (g, id, n <= length) of `source` in bins: `name` (g, id, n, bin)."""
    order = "id" if policy == "greedy" else "n DESC, id"
    ordered = f"{name}_o AS (SELECT g, id, n, row_number() OVER (PARTITION BY g ORDER BY {order}) AS k FROM {source})"
    if policy == "long_context":
        return f"""{ordered},
{name}_r(g, id, n, bin, room, sizes, ids) AS (
  SELECT g, NULL::BIGINT, NULL::BIGINT, -1::BIGINT, 0::BIGINT, list(n ORDER BY k), list(id ORDER BY k) FROM {name}_o GROUP BY g
  UNION ALL SELECT g, ids[j], sizes[j], CASE WHEN fits THEN bin ELSE bin + 1 END, CASE WHEN fits THEN room ELSE {length} END - sizes[j], list_concat(sizes[1:j - 1], sizes[j + 1:]), list_concat(ids[1:j - 1], ids[j + 1:])
  FROM (SELECT g, bin, room, sizes, ids, coalesce(list_position(list_transform(sizes, lambda x: x <= room), true), 0) > 0 AS fits,
    greatest(1, coalesce(list_position(list_transform(sizes, lambda x: x <= room), true), 0)) AS j FROM {name}_r WHERE len(sizes) > 0)),
{name} AS (SELECT g, id, n, bin FROM {name}_r WHERE id IS NOT NULL)"""
    place = "list_position(list_transform(rooms, lambda x: x >= n), true)" if policy == "greedy" else "list_position(rooms, list_min(list_filter(rooms, lambda x: x >= n)))"
    return f"""{ordered},
{name}_r(g, k, id, n, bin, rooms) AS (
  SELECT DISTINCT g, 0::BIGINT, NULL::BIGINT, NULL::BIGINT, 0::BIGINT, []::BIGINT[] FROM {name}_o
  UNION ALL SELECT g, k, id, n, b - 1, CASE WHEN b > len(rooms) THEN list_append(rooms, {length} - n) ELSE list_transform(range(1, len(rooms) + 1), lambda i: rooms[i] - CASE WHEN i = b THEN n ELSE 0 END) END
  FROM (SELECT g, k, id, n, rooms, coalesce(nullif({place}, 0), len(rooms) + 1) AS b FROM (SELECT o.g, o.k, o.id, o.n, r.rooms FROM {name}_r r JOIN {name}_o o ON o.g = r.g AND o.k = r.k + 1))),
{name} AS (SELECT g, id, n, bin FROM {name}_r WHERE id IS NOT NULL)"""


_PIECES = f"""{_ITEMS}, pc AS (SELECT lang || '/' || (doc_id // {GROUP}) AS g, doc_id * 1048576 + off AS id, CAST(least({LENGTH}, n - off) AS BIGINT) AS n FROM (SELECT doc_id, lang, n, unnest(range(0, n, {LENGTH})) AS off FROM it) WHERE n <= {LENGTH} OR n - off >= 16)"""


def _pieces_query(policy: str) -> str:
    return f"""WITH RECURSIVE {_PIECES}, {bins_sql("bn", "pc", policy, LENGTH)}
SELECT string_split(g, '/')[1] AS lang, CAST(string_split(g, '/')[2] AS BIGINT) AS grp, bin, id // 1048576 AS doc_id, CAST(id % 1048576 AS BIGINT) AS off, n AS tokens, false AS truncated FROM bn"""


@query("pack_greedy", _pieces_query("greedy"))
def pack_greedy(spark, sf):
    """First fit in order of arrival."""
    return packed(pieces(items(spark, sf)), "greedy")


@query("pack_best_fit", _pieces_query("best_fit"))
def pack_best_fit(spark, sf):
    """Longest first, each in the tightest bin."""
    return packed(pieces(items(spark, sf)), "best_fit")


@query("pack_structure", _pieces_query("best_fit"))
def pack_structure(spark, sf):
    """Best fit of whole pieces; no piece is longer than a window, so none stands alone."""
    return packed(pieces(items(spark, sf)), "structure")


@query("pack_long_context", _pieces_query("long_context"))
def pack_long_context(spark, sf):
    """The longest item anchors a bin, which what still fits fills up."""
    return packed(pieces(items(spark, sf)), "long_context")


# --- trajectories under all six policies -------------------------------------------------------------------

BINNED = ("greedy", "best_fit", "structure_preserving", "long_context")


def binned(rows: DataFrame, policy: str) -> DataFrame:
    """Members of windows: grp, bin, conv_id, segment, placed_lo, placed_hi, span_lo, span_hi, loss, truncated, ends_early.

    `rows` are those of `structured`. Only sizes go to the packer, in groups of GROUP neighbouring ids.
    """

    def one(key: tuple, own: pd.DataFrame) -> pd.DataFrame:
        own = own.sort_values("conv_id").reset_index(drop=True)
        if policy == "structure_preserving":
            alone = own["n"] > WIDTH
            own.loc[~alone, "bin"] = fill(own.loc[~alone, "take"].tolist(), "best_fit", WIDTH)
            own.loc[alone, "bin"] = [(own["bin"].max() if (~alone).any() else -1) + 1 + k for k in range(int(alone.sum()))]
        else:
            own["bin"] = fill(own["take"].tolist(), policy, WIDTH)
        return own.assign(bin=own["bin"].astype("int64"))[["grp", "bin", "conv_id"]]

    bins = rows.select("grp", "conv_id", "n", "take").groupBy("grp").applyInPandas(one, "grp long, bin long, conv_id long")
    order = ["conv_id"] if policy == "greedy" else [F.desc("take"), "conv_id"]
    inside = Window.partitionBy("grp", "bin").orderBy(*order)
    return rows.join(bins.drop("grp"), "conv_id").select(
        "grp", "bin", "conv_id", (F.row_number().over(inside) - 1).cast("int").alias("segment"), (F.sum("take").over(inside) - F.col("take")).alias("placed_lo"), F.sum("take").over(inside).alias("placed_hi"),
        F.col("off").alias("span_lo"), (F.col("off") + F.col("take")).alias("span_hi"), F.col("cov").alias("loss"), (F.col("off") + F.col("take") < F.col("n")).alias("truncated"), "spans",
    )


def _binned_sql(policy: str, name: str) -> str:
    """(g, bin, id, placed_lo, take, off, cov, n) as `name`."""
    order = "id" if policy == "greedy" else "take DESC, id"
    if policy == "structure_preserving":
        bins = f"""{name}_s AS (SELECT conv_id // {GROUP} AS g, conv_id AS id, take AS n FROM bw{WIDTH} WHERE n <= {WIDTH}), {bins_sql(f"{name}_b", f"{name}_s", "best_fit", WIDTH)},
{name}_m AS (SELECT g, max(bin) AS m FROM {name}_b GROUP BY g),
{name}_a AS (SELECT g, id, bin FROM {name}_b UNION ALL SELECT conv_id // {GROUP}, conv_id, coalesce(m, -1) + row_number() OVER (PARTITION BY conv_id // {GROUP} ORDER BY conv_id) FROM bw{WIDTH} LEFT JOIN {name}_m ON g = conv_id // {GROUP} WHERE n > {WIDTH})"""
    else:
        bins = f"""{name}_s AS (SELECT conv_id // {GROUP} AS g, conv_id AS id, take AS n FROM bw{WIDTH}), {bins_sql(f"{name}_b", f"{name}_s", policy, WIDTH)}, {name}_a AS (SELECT g, id, bin FROM {name}_b)"""
    return f"""{bins},
{name} AS (SELECT g, bin, id, CAST(row_number() OVER w - 1 AS INTEGER) AS segment, CAST(sum(take) OVER w - take AS BIGINT) AS placed_lo, take, off, cov, n FROM {name}_a JOIN bw{WIDTH} ON conv_id = id WINDOW w AS (PARTITION BY g, bin ORDER BY {order}))"""


@query("pack_members", f"""WITH RECURSIVE {_TRAJECTORIES}, {_best_sql(WIDTH)}, {_binned_sql("structure_preserving", "mb")}
SELECT g AS grp, bin, id AS conv_id, segment, placed_lo, CAST(placed_lo + take AS BIGINT) AS placed_hi, off AS span_lo, off + take AS span_hi, cov AS loss, off + take < n AS truncated FROM mb""")  # fmt: skip
def pack_members(spark, sf):
    """Trajectories in windows without cutting what fits: which part of each stands where."""
    return binned(structured(spark, sf), "structure_preserving").drop("spans")


def chopped(spark, sf) -> DataFrame:
    """Trajectories of a group as one stream, cut every WIDTH tokens: grp, win, members, occupied, loss, truncated."""
    rows = trajectories(spark, sf).select("conv_id", F.floor(F.col("conv_id") / GROUP).alias("grp"), F.col("n_tokens").alias("n"), "spans")
    placed = prefix_sums(rows, ["grp"], ["conv_id"], {"lo": F.col("n")})
    parts = placed.select("grp", "conv_id", "lo", "n", "spans", F.explode(F.sequence(F.floor(F.col("lo") / WIDTH), F.floor((F.col("lo") + F.col("n") - 1) / WIDTH))).alias("win"))
    loss = F.expr(f"aggregate(filter(spans, x -> x.role = '{GRADED}'), 0L, (s, x) -> s + greatest(0L, least(lo + x.b, (win + 1) * {WIDTH}) - greatest(lo + x.a, win * {WIDTH})))")
    hi = F.least(F.col("lo") + F.col("n"), (F.col("win") + 1) * WIDTH)
    own = parts.select("grp", "win", (hi - F.greatest(F.col("lo"), F.col("win") * WIDTH)).alias("part"), loss.alias("loss"), (hi < F.col("lo") + F.col("n")).alias("cut"))
    return own.groupBy("grp", "win").agg(F.count("*").alias("members"), F.sum("part").alias("occupied"), F.sum("loss").alias("loss"), F.count_if("cut").alias("truncated"))


_CHOPPED = f"""cs AS (SELECT conv_id, conv_id // {GROUP} AS grp, n, sum(n) OVER (PARTITION BY conv_id // {GROUP} ORDER BY conv_id) - n AS lo FROM sz),
cp AS (SELECT grp AS g, conv_id, (lo + p) // {WIDTH} AS win, count(*) AS part, sum(mk.g) AS loss, max(p) + 1 < any_value(n) AS cut FROM cs JOIN mk USING (conv_id) GROUP BY 1, 2, 3)"""


@query("pack_drop_loss_free", f"""WITH {_TRAJECTORIES}, {_CHOPPED}, w AS (SELECT g, win, sum(loss) AS loss FROM cp GROUP BY g, win)
SELECT CAST(g AS BIGINT) AS grp, CAST(count(*) AS BIGINT) AS windows, CAST(count_if(loss > 0) AS BIGINT) AS kept, CAST(count_if(loss = 0) AS BIGINT) AS dropped, CAST(sum(loss) AS BIGINT) AS loss FROM w GROUP BY g""")  # fmt: skip
def pack_drop_loss_free(spark, sf):
    """Windows of the chopped stream without anything graded teach nothing and go; how many is reported."""
    w = chopped(spark, sf)
    return w.groupBy("grp").agg(F.count("*").alias("windows"), F.count_if(F.col("loss") > 0).alias("kept"), F.count_if(F.col("loss") == 0).alias("dropped"), F.sum("loss").alias("loss"))


def _report_sql() -> str:
    parts = [f"SELECT '{p}' AS policy, g, bin, count(*) AS members, count(*) AS segments, sum(take) AS used, sum(cov) AS loss, count_if(off + take < n) AS truncated FROM mb_{p} GROUP BY g, bin" for p in BINNED]
    parts += [f"SELECT 'pad_only', conv_id // {GROUP}, conv_id, 1, 1, take, cov, (off + take < n)::INT FROM bw{WIDTH}", "SELECT 'concat_chop', g, win, count(*), 1, sum(part), sum(loss), count_if(cut) FROM cp GROUP BY g, win"]
    return f"""pk AS ({" UNION ALL ".join(parts)}), kp AS (SELECT * FROM pk WHERE loss > 0)
SELECT policy, CAST(count(*) AS BIGINT) AS sequences, CAST(count(*) * {WIDTH} AS BIGINT) AS positions, CAST(sum(used) AS BIGINT) AS occupied, CAST(count(*) * {WIDTH} - sum(used) AS BIGINT) AS pad, CAST(sum(loss) AS BIGINT) AS loss, CAST(sum(used) - sum(loss) AS BIGINT) AS context,
 round(sum(used) / (count(*) * {WIDTH})::DOUBLE, 6) AS occupancy, round(sum(loss) / (count(*) * {WIDTH})::DOUBLE, 6) AS loss_coverage, round(sum(segments) / count(*)::DOUBLE, 4) AS mean_segments, CAST(sum(truncated) AS BIGINT) AS truncated,
 CAST(sum(members - segments) AS BIGINT) AS boundary_crossings, (SELECT CAST(count(*) AS BIGINT) FROM pk x WHERE x.policy = kp.policy AND x.loss = 0) AS dropped FROM kp GROUP BY policy"""


@query("agg_policy_report", f"""WITH RECURSIVE {_TRAJECTORIES}, {_best_sql(WIDTH)}, {_CHOPPED}, {", ".join(_binned_sql(p, f"mb_{p}") for p in BINNED)}, {_report_sql()}""")
def agg_policy_report(spark, sf):
    """What each of six policies makes of the same trajectories; windows without anything graded are dropped and counted."""
    rows = structured(spark, sf)
    shape = ["members", "segments", "used", "loss", "truncated"]
    parts = [
        binned(rows, p).groupBy("grp", "bin").agg(F.count("*").alias("members"), F.count("*").alias("segments"), F.sum(F.col("placed_hi") - F.col("placed_lo")).alias("used"), F.sum("loss").alias("loss"), F.count_if("truncated").alias("truncated")).select(F.lit(p).alias("policy"), *shape)
        for p in BINNED
    ]
    one = F.lit(1).cast("long")
    parts.append(rows.select(F.lit("pad_only").alias("policy"), one.alias("members"), one.alias("segments"), F.col("take").alias("used"), F.col("cov").alias("loss"), (F.col("off") + F.col("take") < F.col("n")).cast("long").alias("truncated")))
    parts.append(chopped(spark, sf).select(F.lit("concat_chop").alias("policy"), "members", one.alias("segments"), F.col("occupied").alias("used"), "loss", "truncated"))
    packs = parts[0]
    for p in parts[1:]:
        packs = packs.unionByName(p)
    kept = F.col("loss") > 0
    total = lambda c: F.sum(F.when(kept, F.col(c)).otherwise(0))
    n = F.count_if(kept)
    return packs.groupBy("policy").agg(
        n.alias("sequences"), (n * WIDTH).alias("positions"), total("used").alias("occupied"), (n * WIDTH - total("used")).alias("pad"), total("loss").alias("loss"), (total("used") - total("loss")).alias("context"),
        F.round(total("used") / (n * WIDTH), 6).alias("occupancy"), F.round(total("loss") / (n * WIDTH), 6).alias("loss_coverage"), F.round(total("segments") / n, 4).alias("mean_segments"), total("truncated").alias("truncated"),
        (total("members") - total("segments")).alias("boundary_crossings"), F.count_if(~kept).alias("dropped"),
    )


_KINDS = (("web", "pretrain"), ("code", "pretrain"), ("indic", "pretrain"), ("stem", "sft"), ("reasoning", "sft"), ("agentic", "agentic"))


@query("pack_policy_for_kind", f"""
WITH k AS (SELECT * FROM (VALUES {", ".join(f"('{a}', '{b}')" for a, b in _KINDS)}) AS v(lane, kind)), s AS (SELECT * FROM (VALUES {", ".join(f"('{s[0]}', {s[2]}::DOUBLE)" for s in STAGES)}) AS v(stage, scale))
SELECT stage, lane, kind, CASE WHEN lane = 'web' AND scale >= 1 THEN 'long_context' WHEN kind = 'pretrain' THEN 'best_fit' ELSE 'structure_preserving' END AS policy FROM k, s""")  # fmt: skip
def pack_policy_for_kind(spark, sf):
    """Text may be cut in pieces, samples of structure stay whole; the longest windows take long web documents first."""
    kinds = values(spark, _KINDS, "lane string, kind string")
    long = (F.col("lane") == "web") & (F.col("sequence_length") >= MOST_LENGTH)
    policy = F.when(long, "long_context").when(F.col("kind") == "pretrain", "best_fit").otherwise("structure_preserving")
    return schedule(spark).crossJoin(F.broadcast(kinds)).select("stage", "lane", "kind", policy.alias("policy"))


# --- the arrays of a window, and their seven checks ---------------------------------------------------------

RULES = ("lengths", "tail_not_padding", "padding_carries_loss", "no_loss", "segments_disagree", "positions_do_not_restart", "loss_outside_segments")


def arrays(spark, sf) -> DataFrame:
    """grp, bin, used, loss, members and the four arrays of each window that has anything graded."""
    turns = table(spark, sf, "conversations").select("conv_id", "turn", T.words("text").alias("w")).where(F.size("w") > 0)
    tokens = turns.groupBy("conv_id").agg(F.array_sort(F.collect_list(F.struct("turn", "w"))).alias("t")).select("conv_id", F.concat(F.flatten(F.transform("t", lambda x: x["w"])), F.array(F.lit(END))).alias("tokens"))
    members = binned(structured(spark, sf), "structure_preserving").join(tokens, "conv_id")
    take = (F.col("placed_hi") - F.col("placed_lo")).cast("int")
    graded = F.expr(f"flatten(transform(spans, x -> array_repeat(if(x.role = '{GRADED}', 1, 0), cast(x.b - x.a as int))))")
    part = lambda c: F.slice(c, (F.col("span_lo") + 1).cast("int"), take)
    own = members.withColumn("mask", graded).select("grp", "bin", F.struct(F.col("placed_lo").cast("int").alias("placed_lo"), take.alias("take"), "segment", F.col("span_lo").cast("int").alias("span_lo"), part(F.col("tokens")).alias("ids"), part(F.col("mask")).alias("mask")).alias("m"))
    packs = own.groupBy("grp", "bin").agg(F.array_sort(F.collect_list("m")).alias("members")).withColumn("used", F.expr("aggregate(members, 0, (s, m) -> s + m.take)"))
    tail = f"{WIDTH} - used"
    return packs.select(
        "grp", "bin", "used", "members",
        F.expr(f"concat(flatten(transform(members, m -> m.ids)), array_repeat('{PAD}', {tail}))").alias("input_ids"),
        F.expr(f"concat(flatten(transform(members, m -> m.mask)), array_repeat(0, {tail}))").alias("loss_mask"),
        F.expr(f"concat(flatten(transform(members, m -> sequence(m.span_lo, m.span_lo + m.take - 1))), array_repeat(0, {tail}))").alias("position_ids"),
        F.expr(f"concat(flatten(transform(members, m -> array_repeat(m.segment, m.take))), array_repeat(-1, {tail}))").alias("segment_ids"),
    ).where("array_max(loss_mask) = 1")


def violations() -> Column:
    """Which of RULES a window's arrays break."""
    broken = (
        f"size(input_ids) <> {WIDTH} OR size(loss_mask) <> {WIDTH} OR size(position_ids) <> {WIDTH} OR size(segment_ids) <> {WIDTH}",
        f"exists(slice(input_ids, used + 1, {WIDTH}), x -> x <> '{PAD}')",
        f"exists(slice(loss_mask, used + 1, {WIDTH}), x -> x <> 0)",
        "NOT exists(loss_mask, x -> x = 1)",
        "exists(members, m -> exists(slice(segment_ids, m.placed_lo + 1, m.take), s -> s <> m.segment))",
        "exists(members, m -> get(position_ids, m.placed_lo) <> m.span_lo)",
        "exists(arrays_zip(loss_mask, segment_ids), z -> z.loss_mask = 1 AND z.segment_ids = -1)",
    )
    return F.array(*[F.expr(b) for b in broken])


def spoilt(packs: DataFrame) -> DataFrame:
    """The windows with one fault each, of the rule (number of the bin) mod 8; 0 stays as it is, and so does a full window where the tail is meant."""
    k = "bin % 8"
    last = f"bin % 8 = {{0}} AND used < {WIDTH}"
    return packs.select(
        "grp", "bin", "used", "members",
        F.expr(f"CASE WHEN {k} = 1 THEN slice(input_ids, 1, {WIDTH - 1}) WHEN {last.format(2)} THEN concat(slice(input_ids, 1, {WIDTH - 1}), array('word')) ELSE input_ids END").alias("input_ids"),
        F.expr(f"CASE WHEN {last.format(3)} THEN concat(slice(loss_mask, 1, {WIDTH - 1}), array(1)) WHEN {k} = 4 THEN array_repeat(0, {WIDTH}) ELSE loss_mask END").alias("loss_mask"),
        F.expr(f"CASE WHEN {k} = 6 THEN transform(position_ids, p -> p + 1) ELSE position_ids END").alias("position_ids"),
        F.expr(f"CASE WHEN {k} = 5 THEN transform(segment_ids, s -> s + 100) WHEN {k} = 7 THEN array_repeat(-1, {WIDTH}) ELSE segment_ids END").alias("segment_ids"),
    )


_ARRAYS_SQL = f"""WITH RECURSIVE {_TRAJECTORIES}, {_best_sql(WIDTH)}, {_binned_sql("structure_preserving", "mb")},
pk AS (SELECT g, bin, sum(take) AS used, sum(cov) AS loss, max(placed_lo + take) AS edge FROM mb GROUP BY g, bin HAVING sum(cov) > 0)"""


@query("pack_verify", f"""{_ARRAYS_SQL}, ru AS (SELECT unnest(['{"', '".join(RULES)}']) AS rule, unnest(range(1, 8)) AS k)
SELECT rule, CAST(count_if(used <> edge OR used > {WIDTH} OR loss = 0) AS BIGINT) AS violations, CAST(count_if(bin % 8 = k AND (k NOT IN (2, 3) OR used < {WIDTH})) AS BIGINT) AS caught_where_spoilt FROM ru, pk GROUP BY rule""")  # fmt: skip
def pack_verify(spark, sf):
    """Violations of each rule in the windows as made, and the windows spoilt on purpose in which the rule catches the fault."""
    packs = arrays(spark, sf)
    rule = lambda df: df.select("bin", F.posexplode(violations()).alias("k", "broken"))
    own = F.col("bin") % 8 == F.col("k") + 1
    both = rule(packs).select("k", F.col("broken").cast("long").alias("a"), F.lit(0).cast("long").alias("b")).unionByName(rule(spoilt(packs)).select("k", F.lit(0).cast("long").alias("a"), (F.col("broken") & own).cast("long").alias("b")))
    names = F.array(*map(F.lit, RULES))
    return both.groupBy("k").agg(F.sum("a").alias("violations"), F.sum("b").alias("caught_where_spoilt")).select(F.get(names, F.col("k")).alias("rule"), "violations", "caught_where_spoilt")


@query("pack_arrays", f"""{_ARRAYS_SQL}, tk AS (SELECT conv_id, turn, {WORDS} AS w FROM conversations WHERE len({WORDS}) > 0), tw AS (SELECT conv_id, list_append(flatten(list(w ORDER BY turn)), '{END}') AS w FROM tk GROUP BY conv_id),
gm AS (SELECT conv_id, list(g ORDER BY p) AS g FROM mk GROUP BY conv_id),
ar AS (SELECT mb.g AS grp, mb.bin, string_agg(array_to_string(tw.w[off + 1:off + take], ','), ',' ORDER BY placed_lo) AS ids, string_agg(array_to_string(gm.g[off + 1:off + take], ','), ',' ORDER BY placed_lo) AS mask,
  string_agg(array_to_string(range(off, off + take), ','), ',' ORDER BY placed_lo) AS pos, string_agg(array_to_string(list_transform(range(0, take), lambda i: segment), ','), ',' ORDER BY placed_lo) AS seg, CAST(sum(take) AS BIGINT) AS used
  FROM mb JOIN pk USING (g, bin) JOIN tw ON tw.conv_id = mb.id JOIN gm ON gm.conv_id = mb.id GROUP BY 1, 2)
SELECT CAST(grp AS BIGINT) AS grp, bin, used, sha256('{WIDTH}|' || ids || repeat(',{PAD}', {WIDTH} - used) || '|' || mask || repeat(',0', {WIDTH} - used) || '|' || pos || repeat(',0', {WIDTH} - used) || '|' || seg || repeat(',-1', {WIDTH} - used)) AS batch_hash,
 sha256(mask || repeat(',0', {WIDTH} - used)) AS loss_mask_hash FROM ar""")  # fmt: skip
def pack_arrays(spark, sf):
    """A digest over a window's shape and its four arrays, and one of the mask alone."""
    text = lambda c: F.array_join(F.col(c).cast("array<string>"), ",")
    whole = F.concat_ws("|", F.lit(str(WIDTH)), text("input_ids"), text("loss_mask"), text("position_ids"), text("segment_ids"))
    return arrays(spark, sf).select("grp", "bin", F.col("used").cast("long").alias("used"), F.sha2(whole.cast("binary"), 256).alias("batch_hash"), F.sha2(text("loss_mask").cast("binary"), 256).alias("loss_mask_hash"))


# --- documents under all six policies ----------------------------------------------------------------------


def _documents_sql() -> str:
    bins = ", ".join(bins_sql(f"d_{p}", "pc", p, LENGTH) for p in ("greedy", "best_fit", "long_context"))
    parts = [f"SELECT '{p}' AS policy, g, bin, sum(n) AS used, count(*) AS members FROM d_{q} GROUP BY g, bin" for p, q in (("greedy", "greedy"), ("best_fit", "best_fit"), ("structure_preserving", "best_fit"), ("long_context", "long_context"))]
    return f"""WITH RECURSIVE {_PIECES}, {bins}, {_STREAM},
pk AS ({" UNION ALL ".join(parts)} UNION ALL SELECT 'concat_chop', lang, win, occupied, members FROM cc UNION ALL SELECT 'pad_only', lang, doc_id, least(n, {LENGTH}), 1 FROM it)
SELECT policy, CAST(count(*) AS BIGINT) AS sequences, CAST(sum(used) AS BIGINT) AS occupied, CAST(count(*) * {LENGTH} - sum(used) AS BIGINT) AS pad, round(sum(used) / (count(*) * {LENGTH})::DOUBLE, 6) AS occupancy, round(sum(members) / count(*)::DOUBLE, 6) AS mean_members FROM pk GROUP BY policy"""


@query("agg_policy_documents", _documents_sql())
def agg_policy_documents(spark, sf):
    """What each of six policies makes of the same documents, all of whose tokens are graded."""
    docs = items(spark, sf)
    cut = pieces(docs)
    rows = concat_chop(docs).select(F.lit("concat_chop").alias("policy"), F.col("occupied").alias("used"), "members")
    rows = rows.unionByName(docs.select(F.lit("pad_only").alias("policy"), F.least("n", F.lit(LENGTH).cast("long")).alias("used"), F.lit(1).cast("long").alias("members")))
    for name, policy in (("greedy", "greedy"), ("best_fit", "best_fit"), ("structure_preserving", "structure"), ("long_context", "long_context")):
        rows = rows.unionByName(packed(cut, policy).groupBy("lang", "grp", "bin").agg(F.sum("tokens").alias("used"), F.count("*").alias("members")).select(F.lit(name).alias("policy"), "used", "members"))
    n = F.count("*")
    return rows.groupBy("policy").agg(n.alias("sequences"), F.sum("used").alias("occupied"), (n * LENGTH - F.sum("used")).alias("pad"), F.round(F.sum("used") / (n * LENGTH), 6).alias("occupancy"), F.round(F.sum("members") / n, 6).alias("mean_members"))
