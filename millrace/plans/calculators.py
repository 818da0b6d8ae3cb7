"""Calculators: cache sizes, visibility, cost of sparse attention, position codes, recurrences."""

from __future__ import annotations

from pyspark.sql import functions as F

from millrace.registry import query
from millrace.session import table

LAYERS, HEADS, WIDTH, BYTES, LATENT, ROPE = 32, 32, 128, 2, 512, 64


@query("calc_kv_cache", f"""
WITH t AS (SELECT unnest([4096, 32768, 131072, 1048576]::BIGINT[]) AS tokens), k AS (SELECT unnest(['MHA', 'GQA', 'MQA']) AS kind, unnest([{HEADS}, 8, 1]) AS heads)
SELECT kind, tokens, CAST(2 * {LAYERS} * heads * {WIDTH} * tokens * {BYTES} AS BIGINT) AS bytes FROM k, t UNION ALL SELECT 'latent', tokens, CAST({LAYERS} * ({LATENT} + {ROPE}) * tokens * {BYTES} AS BIGINT) FROM t""")  # fmt: skip
def calc_kv_cache(spark, sf):
    """Bytes that keys and values take, by how many heads share them."""
    kinds = [("MHA", 2 * HEADS * WIDTH), ("GQA", 2 * 8 * WIDTH), ("MQA", 2 * WIDTH), ("latent", LATENT + ROPE)]
    rows = spark.createDataFrame(kinds, "kind string, each long").withColumn("tokens", F.explode(F.array(*[F.lit(x).cast("long") for x in (4096, 32768, 131072, 1048576)])))
    return rows.select("kind", "tokens", (F.col("each") * LAYERS * BYTES * F.col("tokens")).alias("bytes"))


@query("calc_sparse", """
WITH t AS (SELECT unnest([1024, 16384, 262144]::BIGINT[]) AS t), k AS (SELECT unnest([64, 2048]::BIGINT[]) AS k)
SELECT t AS tokens, k AS kept, 2 * t AS whole, t + least(k, t) AS naive, CAST(ceil(t / 64.0) AS BIGINT) + least(k, t) AS blocks FROM t, k""")
def calc_sparse(spark, sf):
    """Reads for one token: all, scored one by one, or scored by blocks of 64."""
    rows = spark.createDataFrame([(t, k) for t in (1024, 16384, 262144) for k in (64, 2048)], "tokens long, kept long")
    top = F.least("kept", "tokens")
    return rows.select("tokens", "kept", (F.col("tokens") * 2).alias("whole"), (F.col("tokens") + top).alias("naive"), (F.ceil(F.col("tokens") / 64) + top).alias("blocks"))


@query("calc_window_sinks", """
WITH i AS (SELECT unnest(range(0, 64)) AS i), j AS (SELECT unnest(range(0, 64)) AS j)
SELECT i, CAST(count_if(j > i - 16 OR j < 4) AS BIGINT) AS seen, CAST(count_if(NOT (j > i - 16 OR j < 4)) AS BIGINT) AS lost FROM i JOIN j ON j <= i GROUP BY i""")
def calc_window_sinks(spark, sf):
    """What a window of 16 with 4 sinks shows of 64 positions, in closed form."""
    i = F.col("id")
    seen = F.least(i + 1, F.lit(16)) + F.least(F.lit(4), F.greatest(F.lit(0), i - 15))
    return spark.range(64).select(i.alias("i"), seen.cast("long").alias("seen"), (i + 1 - seen).cast("long").alias("lost"))


@query("calc_rope", """
WITH d AS (SELECT unnest(range(0, 32)) AS pair), p AS (SELECT unnest([1, 16, 256, 4096]::BIGINT[]) AS dist)
SELECT dist, round(avg(cos(dist * power(10000.0::DOUBLE, -pair / 32.0::DOUBLE))), 6) AS similarity FROM d, p GROUP BY dist""")
def calc_rope(spark, sf):
    """Mean cosine of rotary angles by distance."""
    rows = spark.range(32).select("id", F.explode(F.array(*[F.lit(x).cast("long") for x in (1, 16, 256, 4096)])).alias("dist"))
    return rows.groupBy("dist").agg(F.round(F.avg(F.cos(F.col("dist") * F.pow(F.lit(10000.0), -F.col("id") / 32))), 6).alias("similarity"))


@query("calc_extend", """
WITH d AS (SELECT unnest(range(0, 32)) AS pair), w AS (SELECT pair, 2 * pi() * power(10000.0::DOUBLE, pair / 32.0::DOUBLE) AS wave FROM d), t AS (SELECT pair, 4096 / wave AS turns FROM w)
SELECT pair, CASE WHEN turns > 32 THEN 'fast' WHEN turns < 1 THEN 'slow' ELSE 'mid' END AS kind, round(least(1, greatest(0, (turns - 1) / 31)), 6) AS kept FROM t""")
def calc_extend(spark, sf):
    """By turns in the trained length: fast pairs are kept, slow ones interpolated, a ramp between."""
    turns = 4096 / (2 * F.pi() * F.pow(F.lit(10000.0), F.col("id") / 32))
    return spark.range(32).select(F.col("id").alias("pair"), F.when(turns > 32, "fast").when(turns < 1, "slow").otherwise("mid").alias("kind"), F.round(F.least(F.lit(1.0), F.greatest(F.lit(0.0), (turns - 1) / 31)), 6).alias("kept"))


@query("calc_delta", """
SELECT unnest(range(1, 33)) AS step, round(1 - power(0.75::DOUBLE, unnest(range(1, 33))), 9) AS delta_state, CAST(unnest(range(1, 33)) AS DOUBLE) * 0.25 AS added_state""")
def calc_delta(spark, sf):
    """s += b (t - s) against adding b t each time, for t = 1 and b = 0.25."""
    state = F.aggregate(F.sequence(F.lit(1), F.col("id").cast("int")), F.lit(0.0), lambda s, _: s + 0.25 * (1 - s))
    return spark.range(1, 33).select(F.col("id").alias("step"), F.round(state, 9).alias("delta_state"), (F.col("id") * 0.25).alias("added_state"))


@query("agg_head_cost", """
WITH v AS (SELECT unnest([1200, 16384, 131072]::BIGINT[]) AS vocabulary), d AS (SELECT unnest([96, 512, 4096]::BIGINT[]) AS width)
SELECT vocabulary, width, vocabulary * width AS parameters, vocabulary * width * 16 AS training_bytes, vocabulary * width * 2 AS serving_bytes FROM v, d""")
def agg_head_cost(spark, sf):
    rows = spark.createDataFrame([(v, d) for v in (1200, 16384, 131072) for d in (96, 512, 4096)], "vocabulary long, width long")
    n = F.col("vocabulary") * F.col("width")
    return rows.select("vocabulary", "width", n.alias("parameters"), (n * 16).alias("training_bytes"), (n * 2).alias("serving_bytes"))


@query("nearest_code", """
WITH c AS (SELECT label, list(m ORDER BY i) AS code FROM (SELECT label, i, avg(embedding[i]::DOUBLE) AS m FROM embeddings, range(1, 65) r(i) GROUP BY label, i) GROUP BY label),
s AS (SELECT vec_id, c.label, round(list_sum(list_transform(range(1, 65), lambda i: embedding[i]::DOUBLE * code[i])), 6) AS dot FROM embeddings e, c)
SELECT vec_id, arg_max(label, (dot, -label)) AS nearest, max(dot) AS dot FROM s GROUP BY vec_id""")
def nearest_code(spark, sf):
    """Each vector's nearest label centre by inner product; centres are as few as there are labels (checked)."""
    vectors = table(spark, sf, "embeddings").select("vec_id", "label", "embedding")
    cells = vectors.select("label", F.posexplode("embedding").alias("i", "v")).groupBy("label", "i").agg(F.avg(F.col("v").cast("double")).alias("m"))
    codes = cells.groupBy("label").agg(F.transform(F.array_sort(F.collect_list(F.struct("i", "m"))), lambda s: s["m"]).alias("code"))
    codes = codes.agg(F.collect_list(F.struct("label", "code")).alias("codes"))
    if vectors.select("label").distinct().limit(10_001).count() > 10_000:
        raise ValueError("too many labels for a table of centres")
    dot = lambda c: F.round(F.aggregate(F.zip_with("embedding", c["code"], lambda a, b: a.cast("double") * b), F.lit(0.0), lambda s, x: s + x), 6)
    best = F.array_max(F.transform("codes", lambda c: F.struct(dot(c).alias("dot"), (-c["label"]).alias("l"))))
    return vectors.crossJoin(F.broadcast(codes)).select("vec_id", best.alias("b")).select("vec_id", (-F.col("b.l")).alias("nearest"), F.col("b.dot").alias("dot"))


@query("calc_sdpa", """
WITH v AS (SELECT vec_id, label, embedding[1:8] AS e, row_number() OVER (PARTITION BY label ORDER BY vec_id) AS pos FROM embeddings),
s AS (SELECT q.label, q.pos AS i, k.pos AS j, list_sum(list_transform(range(1, 9), lambda d: q.e[d]::DOUBLE * k.e[d]::DOUBLE)) / sqrt(8.0::DOUBLE) AS s, k.e AS e FROM v q JOIN v k ON k.label = q.label AND k.pos <= q.pos AND k.pos > q.pos - 6),
m AS (SELECT *, exp(s - max(s) OVER (PARTITION BY label, i)) AS x FROM s), w AS (SELECT *, x / sum(x) OVER (PARTITION BY label, i) AS w FROM m)
SELECT label, CAST(i AS BIGINT) AS pos, CAST(count(*) AS BIGINT) AS seen, round(max(w), 6) AS most, round(sum(w * e[1]::DOUBLE), 6) AS out_1, round(sum(w * e[8]::DOUBLE), 6) AS out_8 FROM w GROUP BY label, i""")
def calc_sdpa(spark, sf):
    """Scaled dot-product attention of each vector over the six before it in its label: scores, softmax, weighed sum.

    A window gathers the few vectors that a place sees, so nothing is joined.
    """
    from pyspark.sql import Window

    order = Window.partitionBy("label").orderBy("vec_id")
    rows = table(spark, sf, "embeddings").select("label", "vec_id", F.transform(F.slice("embedding", 1, 8), lambda x: x.cast("double")).alias("e"))
    rows = rows.select("label", "e", F.row_number().over(order).alias("pos"), F.collect_list("e").over(order.rowsBetween(-5, 0)).alias("near"))
    dot = lambda a, b: F.aggregate(F.zip_with(a, b, lambda x, y: x * y), F.lit(0.0), lambda s, x: s + x)
    rows = rows.withColumn("s", F.transform("near", lambda k: dot(F.col("e"), k) / F.sqrt(F.lit(8.0)))).withColumn("x", F.transform("s", lambda v: F.exp(v - F.array_max("s"))))
    rows = rows.withColumn("w", F.transform("x", lambda v: v / F.aggregate("x", F.lit(0.0), lambda s, y: s + y)))
    out = lambda d: F.round(F.aggregate(F.zip_with("w", "near", lambda w, k: w * F.element_at(k, d)), F.lit(0.0), lambda s, x: s + x), 6)
    return rows.select("label", F.col("pos").cast("long").alias("pos"), F.size("near").cast("long").alias("seen"), F.round(F.array_max("w"), 6).alias("most"), out(1).alias("out_1"), out(8).alias("out_8"))


@query("calc_linear", """
WITH v AS (SELECT label, row_number() OVER (PARTITION BY label ORDER BY vec_id) AS pos, greatest(embedding[1]::DOUBLE, 0) + 1 AS a, greatest(embedding[2]::DOUBLE, 0) + 1 AS b, embedding[3]::DOUBLE AS x FROM embeddings)
SELECT q.label, CAST(q.pos AS BIGINT) AS pos, round(sum((q.a * k.a + q.b * k.b) * k.x), 6) AS numerator, round(sum((q.a * k.a + q.b * k.b) * k.x) / sum(q.a * k.a + q.b * k.b), 6) AS out FROM v q JOIN v k ON k.label = q.label AND k.pos <= q.pos GROUP BY 1, 2""")
def calc_linear(spark, sf):
    """Attention without softmax, regrouped: running sums of keys and of keys times values, then one product a place; the SQL does it pair by pair."""
    from pyspark.sql import Window

    upto = Window.partitionBy("label").orderBy("vec_id").rowsBetween(Window.unboundedPreceding, 0)
    e = lambda i: F.element_at("embedding", i).cast("double")
    rows = table(spark, sf, "embeddings").select("label", "vec_id", (F.greatest(e(1), F.lit(0.0)) + 1).alias("a"), (F.greatest(e(2), F.lit(0.0)) + 1).alias("b"), e(3).alias("x"))
    rows = rows.select("label", "a", "b", F.row_number().over(Window.partitionBy("label").orderBy("vec_id")).cast("long").alias("pos"), *[F.sum(c).over(upto).alias(n) for n, c in (("ka", F.col("a")), ("kb", F.col("b")), ("va", F.col("a") * F.col("x")), ("vb", F.col("b") * F.col("x")))])
    top, below = F.col("a") * F.col("va") + F.col("b") * F.col("vb"), F.col("a") * F.col("ka") + F.col("b") * F.col("kb")
    return rows.select("label", "pos", F.round(top, 6).alias("numerator"), F.round(top / below, 6).alias("out"))


@query("calc_position", """
WITH d AS (SELECT unnest(range(0, 32)) AS pair), p AS (SELECT unnest([0, 1, 2, 4, 8, 16, 64, 256]::BIGINT[]) AS dist), w AS (SELECT dist, avg(cos(dist * power(10000.0::DOUBLE, -pair / 32.0::DOUBLE))) AS c FROM d, p GROUP BY dist),
h AS (SELECT dist, avg(exp(-power(2.0::DOUBLE, -head) * dist)) AS a FROM p, (SELECT unnest(range(1, 9)) AS head) GROUP BY dist)
SELECT dist, round(c, 6) AS sinusoidal, round(c, 6) AS rotary, round(a, 6) AS slopes, 1.0::DOUBLE AS learned FROM w JOIN h USING (dist)""")
def calc_position(spark, sf):
    """How alike positions look by distance: sinusoidal and rotary codes (mean cosine), linear slopes of eight heads, learned codes (no decay)."""
    dist = spark.createDataFrame([(x,) for x in (0, 1, 2, 4, 8, 16, 64, 256)], "dist long")
    angle = F.aggregate(F.sequence(F.lit(0), F.lit(31)), F.lit(0.0), lambda s, i: s + F.cos(F.col("dist") * F.pow(F.lit(10000.0), -i / 32.0))) / 32
    heads = F.aggregate(F.sequence(F.lit(1), F.lit(8)), F.lit(0.0), lambda s, h: s + F.exp(-F.pow(F.lit(2.0), -h.cast("double")) * F.col("dist"))) / 8
    return dist.select("dist", F.round(angle, 6).alias("sinusoidal"), F.round(angle, 6).alias("rotary"), F.round(heads, 6).alias("slopes"), F.lit(1.0).alias("learned"))


@query("calc_relative_angle", """
WITH m AS (SELECT unnest(range(0, 8)) * 37 AS m), n AS (SELECT unnest(range(0, 8)) * 11 AS n), f AS (SELECT unnest([0, 4, 16, 31]) AS pair)
SELECT CAST(m AS BIGINT) AS m, CAST(n AS BIGINT) AS n, pair, round(cos((m - n) * power(10000.0::DOUBLE, -pair / 32.0::DOUBLE)), 6) AS product FROM m, n, f""")
def calc_relative_angle(spark, sf):
    """Two unit vectors turned by their positions: their product depends on the distance alone; made here from both angles."""
    grid = spark.range(8).select((F.col("id") * 37).alias("m")).select("m", F.explode(F.transform(F.sequence(F.lit(0), F.lit(7)), lambda i: (i * 11).cast("long"))).alias("n")).select("m", "n", F.explode(F.array(*map(F.lit, (0, 4, 16, 31)))).alias("pair"))
    rate = F.pow(F.lit(10000.0), -F.col("pair") / 32.0)
    a, b = F.col("m") * rate, F.col("n") * rate
    return grid.select("m", "n", "pair", F.round(F.cos(a) * F.cos(b) + F.sin(a) * F.sin(b), 6).alias("product"))


@query("calc_extend_methods", """
WITH d AS (SELECT unnest(range(0, 32)) AS pair), x AS (SELECT unnest([2.0, 8.0, 32.0]::DOUBLE[]) AS factor), r AS (SELECT pair, factor, power(10000.0::DOUBLE, -pair / 32.0::DOUBLE) AS rate, power(10000.0::DOUBLE * power(factor, 64 / 62.0::DOUBLE), -pair / 32.0::DOUBLE) AS ntk FROM d, x),
t AS (SELECT *, greatest(0, least(1, (4096 * rate / (2 * pi()) - 1) / 31)) AS kept FROM r)
SELECT factor, CAST(pair AS BIGINT) AS pair, round(rate / factor, 9) AS interpolated, round(ntk, 9) AS wider_base, round(rate * kept + rate / factor * (1 - kept), 9) AS ramp FROM t""")
def calc_extend_methods(spark, sf):
    """Rates of rotary pairs under three ways to lengthen a context: all divided, a wider base, a ramp by turns in the trained length."""
    rows = spark.range(32).select(F.col("id").alias("pair"), F.explode(F.array(*map(F.lit, (2.0, 8.0, 32.0)))).alias("factor"))
    power = lambda base: F.pow(base, -F.col("pair") / 32.0)
    rate = power(F.lit(10000.0))
    kept = F.greatest(F.lit(0.0), F.least(F.lit(1.0), (4096 * rate / (2 * F.pi()) - 1) / 31))
    return rows.select("factor", "pair", F.round(rate / F.col("factor"), 9).alias("interpolated"), F.round(power(10000.0 * F.pow("factor", F.lit(64 / 62))), 9).alias("wider_base"), F.round(rate * kept + rate / F.col("factor") * (1 - kept), 9).alias("ramp"))


@query("adjoint_identity", """
WITH c AS (SELECT label, list(m ORDER BY i) AS code FROM (SELECT label, i, avg(embedding[i]::DOUBLE) AS m FROM embeddings, range(1, 17) r(i) GROUP BY label, i) GROUP BY label),
w AS (SELECT label, list_transform(range(1, 17), lambda j: list_sum(list_transform(range(1, 17), lambda i: code[i] * sin(i * j)))) AS wc FROM c)
SELECT vec_id, w.label AS candidate, round(list_sum(list_transform(range(1, 17), lambda j: embedding[j]::DOUBLE * wc[j])), 4) + 0.0 AS logit FROM embeddings e, w""")
def adjoint_identity(spark, sf):
    """Logits of codes either way round: hidden states through a map and then against codes here, codes through its transpose first in the SQL."""
    n = 16
    vectors = table(spark, sf, "embeddings").select("vec_id", "label", F.transform(F.slice("embedding", 1, n), lambda x: x.cast("double")).alias("h"))
    cells = vectors.select("label", F.posexplode("h").alias("i", "v")).groupBy("label", "i").agg(F.avg("v").alias("m"))
    codes = cells.groupBy("label").agg(F.transform(F.array_sort(F.collect_list(F.struct("i", "m"))), lambda s: s["m"]).alias("code"))
    codes = codes.agg(F.collect_list(F.struct("label", "code")).alias("codes"))  # labels are few
    dot = lambda a, b: F.aggregate(F.zip_with(a, b, lambda x, y: x * y), F.lit(0.0), lambda s, x: s + x)
    mapped = F.transform(F.sequence(F.lit(1), F.lit(n)), lambda i: F.aggregate(F.transform("h", lambda x, j: x * F.sin((j + 1) * i)), F.lit(0.0), lambda s, x: s + x))
    rows = vectors.withColumn("through", mapped).crossJoin(F.broadcast(codes)).select("vec_id", "through", F.explode("codes").alias("c"))
    return rows.select("vec_id", F.col("c.label").alias("candidate"), (F.round(dot(F.col("through"), F.col("c.code")), 4) + 0.0).alias("logit"))


# --- a dated catalogue: cards are the first order of each priority and month -------------------------------

_CARDS = """cd AS (SELECT o_orderpriority AS lane, CAST(date_trunc('month', o_orderdate) AS DATE) AS month, CAST(min(o_orderdate) AS DATE) AS day, max(o_totalprice) > 400000 AS req, list_sort(list_distinct(list(o_orderstatus))) AS touches FROM orders GROUP BY 1, 2)"""
_ERAS = (("early", "1992-01-01", "1994-01-01"), ("middle", "1994-01-01", "1997-01-01"), ("late", "1997-01-01", "2100-01-01"))


def cards(spark, sf):
    """lane, month, day, req, touches: the catalogue."""
    month = F.trunc(F.col("o_orderdate").cast("date"), "month")
    return table(spark, sf, "orders").groupBy(F.col("o_orderpriority").alias("lane"), month.alias("month")).agg(F.min(F.col("o_orderdate").cast("date")).alias("day"), (F.max("o_totalprice") > 400000).alias("req"), F.array_sort(F.collect_set("o_orderstatus")).alias("touches"))


@query("cat_by_lane", f"WITH {_CARDS} SELECT lane, req, CAST(count(*) AS BIGINT) AS cards, GROUPING(lane, req) AS level FROM cd GROUP BY CUBE (lane, req)")
def cat_by_lane(spark, sf):
    """Cards by lane, by whether they are required, and by both."""
    return cards(spark, sf).cube("lane", "req").agg(F.count("*").alias("cards"), F.grouping_id().alias("level"))


_ERA_ROWS = ", ".join(f"('{n}', DATE '{a}', DATE '{b}')" for n, a, b in _ERAS)


@query("cat_by_era", f"WITH {_CARDS}, e AS (SELECT * FROM (VALUES {_ERA_ROWS}) AS v(era, lo, hi)) SELECT era, CAST(count(*) AS BIGINT) AS cards, CAST(count_if(req) AS BIGINT) AS required FROM cd JOIN e ON day >= lo AND day < hi GROUP BY era")
def cat_by_era(spark, sf):
    """Cards in ranges of dates."""
    eras = F.broadcast(spark.createDataFrame(list(_ERAS), "era string, lo string, hi string").select("era", F.to_date("lo").alias("lo"), F.to_date("hi").alias("hi")))
    return cards(spark, sf).join(eras, (F.col("day") >= F.col("lo")) & (F.col("day") < F.col("hi"))).groupBy("era").agg(F.count("*").alias("cards"), F.count_if("req").alias("required"))


@query("cat_touches", f"WITH {_CARDS} SELECT stage, CAST(count(*) AS BIGINT) AS cards FROM (SELECT unnest(touches) AS stage FROM cd) GROUP BY stage")
def cat_touches(spark, sf):
    return cards(spark, sf).select(F.explode("touches").alias("stage")).groupBy("stage").agg(F.count("*").alias("cards"))


@query("cat_positions", f"WITH {_CARDS}, t AS (SELECT min(day) AS t0, max(day) AS t1 FROM cd) SELECT lane, day, round((day - t0) * 100.0::DOUBLE / (t1 - t0), 6) AS pos FROM cd, t")
def cat_positions(spark, sf):
    """Each card's place on a line of dates, in percent."""
    c = cards(spark, sf)
    t = c.agg(F.min("day").alias("t0"), F.max("day").alias("t1"))
    return c.crossJoin(F.broadcast(t)).select("lane", "day", F.round(F.datediff("day", "t0") * 100.0 / F.datediff("t1", "t0"), 6).alias("pos"))


GAP, SLOTS = 2.0, 3


@query("cat_slots", f"""
WITH RECURSIVE {_CARDS}, t AS (SELECT min(day) AS t0, max(day) AS t1 FROM cd), p AS (SELECT lane, day, (day - t0) * 100.0::DOUBLE / (t1 - t0) AS pos, row_number() OVER (PARTITION BY lane ORDER BY day) AS k FROM cd, t),
r(lane, k, day, slot, ends) AS (SELECT DISTINCT lane, 0::BIGINT, NULL::DATE, 0::BIGINT, [-1000.0::DOUBLE, -1000, -1000] FROM p
 UNION ALL SELECT lane, k, day, s - 1, list_transform(range(1, 4), lambda i: CASE WHEN i = s THEN pos ELSE ends[i] END) FROM (SELECT p.lane, p.k, p.day, p.pos, r.ends, coalesce(nullif(list_position(list_transform(r.ends, lambda e: p.pos - e > {GAP}), true), 0), list_position(r.ends, list_min(r.ends))) AS s FROM r JOIN p ON p.lane = r.lane AND p.k = r.k + 1))
SELECT lane, day, slot FROM r WHERE k > 0""")  # fmt: skip
def cat_slots(spark, sf):
    """Cards of a lane in three rows so that neighbours don't overlap: the first row that has room, else the one that ended first.

    A fold over a lane's cards in order of date; a lane has as many as there are months.
    """
    c = cards(spark, sf)
    t = c.agg(F.min("day").alias("t0"), F.max("day").alias("t1"))
    rows = c.crossJoin(F.broadcast(t)).select("lane", "day", (F.datediff("day", "t0") * 100.0 / F.datediff("t1", "t0")).alias("pos"))
    lanes = rows.groupBy("lane").agg(F.array_sort(F.collect_list(F.struct("day", "pos"))).alias("cards"))
    fold = f"""aggregate(cards, named_struct('ends', array(-1000D, -1000D, -1000D), 'out', cast(array() as array<struct<day: date, slot: bigint>>)),
      (s, c) -> transform(array(coalesce(nullif(array_position(transform(s.ends, e -> c.pos - e > {GAP}D), true), 0L), array_position(s.ends, array_min(s.ends)))),
        k -> named_struct('ends', transform(s.ends, (e, i) -> if(i + 1 = k, c.pos, e)), 'out', concat(s.out, array(named_struct('day', c.day, 'slot', k - 1L)))))[0], s -> s.out)"""
    return lanes.select("lane", F.explode(F.expr(fold)).alias("x")).select("lane", "x.day", "x.slot")


@query("fn_sizes", """
WITH s AS (SELECT doc_id, CAST(octet_length(encode(text)) AS DOUBLE) * CASE doc_id % 4 WHEN 0 THEN 1 WHEN 1 THEN 1e3 WHEN 2 THEN 1e6 ELSE 1 END AS b FROM documents)
SELECT doc_id, CASE WHEN b >= 1e9 THEN round(b / 1e9, 2)::VARCHAR || ' GB' WHEN b >= 1e6 THEN round(b / 1e6, 1)::VARCHAR || ' MB' WHEN b >= 1e3 THEN floor(b / 1e3)::BIGINT::VARCHAR || ' KB' ELSE b::BIGINT::VARCHAR || ' B' END AS label FROM s""")
def fn_sizes(spark, sf):
    """Sizes of texts, scaled up by rule, as a reader wants them."""
    k = F.col("doc_id") % 4
    b = (F.octet_length("text").cast("double") * F.when(k == 1, 1e3).when(k == 2, 1e6).otherwise(1.0)).alias("b")
    rows = table(spark, sf, "documents").select("doc_id", b)
    text = lambda c: c.cast("string")
    # To places as SQL rounds doubles: the scaled double is rounded. Spark's round to places rounds the decimal digits: 1.005 to 1.01.
    places = lambda c, ten: F.round(c * ten) / ten
    label = F.when(F.col("b") >= 1e9, F.concat(text(places(F.col("b") / 1e9, 100.0)), F.lit(" GB"))).when(F.col("b") >= 1e6, F.concat(text(places(F.col("b") / 1e6, 10.0)), F.lit(" MB"))).when(F.col("b") >= 1e3, F.concat(text(F.floor(F.col("b") / 1e3)), F.lit(" KB"))).otherwise(F.concat(text(F.col("b").cast("long")), F.lit(" B")))
    return rows.select("doc_id", label.alias("label"))
