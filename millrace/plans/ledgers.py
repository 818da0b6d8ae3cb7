"""Queries of ledgers and reports over lanes: offsets, gaps, last records, fertility, compliance."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from millrace.functions import text as T
from millrace.operators.ordered import last_in, numbered, prefix_sums
from millrace.plans.curriculum import _MM, _SCHEDULE, schedule, stage_mixture
from millrace.plans.text import _VOCAB_SQL, PRETOKEN, TRIM, WORDS, token_counts, vocabulary_of
from millrace.registry import query
from millrace.session import materialize, table

TAIL, FLOOR, WINDOW = 0.97, {"fr": 0.10, "de": 0.10, "es": 0.10}, (2_000, 5_000)
_PLANNED = {"en": 0.6, "fr": 0.15, "de": 0.15, "es": 0.1}


@query("agg_fertility", f"""
SELECT lang, CAST(count(*) AS BIGINT) AS docs, CAST(sum(length(text)) AS BIGINT) AS chars, CAST(sum(octet_length(encode(text))) AS BIGINT) AS bytes, CAST(sum(len({WORDS})) AS BIGINT) AS words,
 round(sum(octet_length(encode(text))) / greatest(1, sum(len({WORDS})))::DOUBLE, 6) AS bytes_a_word FROM documents GROUP BY lang""")  # fmt: skip
def agg_fertility(spark, sf):
    n = F.size(T.words("text")).cast("long")
    rows = table(spark, sf, "documents").groupBy("lang").agg(F.count("*").alias("docs"), F.sum(F.char_length("text").cast("long")).alias("chars"), F.sum(F.octet_length("text").cast("long")).alias("bytes"), F.sum(n).alias("words"))
    return rows.withColumn("bytes_a_word", F.round(F.col("bytes") / F.greatest(F.lit(1), F.col("words")), 6))


_LIMITS = {"en": 6.0, "fr": 7.0, "de": 7.0, "es": 7.0, "hi": 9.0}


@query("agg_fertility_gate", f"""
WITH f AS (SELECT lang, sum(octet_length(encode(text))) / greatest(1, sum(len({WORDS})))::DOUBLE AS b FROM documents GROUP BY lang), l AS (SELECT unnest(['en', 'fr', 'de', 'es', 'hi']) AS lang, unnest([6.0::DOUBLE, 7.0, 7.0, 7.0, 9.0]) AS most)
SELECT lang, CASE WHEN b IS NULL THEN 'lane is missing' WHEN b > most THEN 'over its limit' ELSE 'ok' END AS verdict FROM l LEFT JOIN f USING (lang)""")  # fmt: skip
def agg_fertility_gate(spark, sf):
    """A lane must be there and keep to its limit."""
    limits = spark.createDataFrame(list(_LIMITS.items()), "lang string, most double")
    b = F.col("bytes") / F.greatest(F.lit(1), F.col("words"))
    return limits.join(agg_fertility(spark, sf), "lang", "left").select("lang", F.when(F.col("docs").isNull(), "lane is missing").when(b > F.col("most"), "over its limit").otherwise("ok").alias("verdict"))


@query("ledger_records", """
SELECT event_id AS record, event_type AS lane, CAST(sum(1) OVER (PARTITION BY event_type ORDER BY event_id) - 1 AS BIGINT) AS lane_offset, CAST(coalesce(sum(event_id % 97 + 1) OVER (PARTITION BY event_type ORDER BY event_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS BIGINT) AS tokens_before FROM events""")
def ledger_records(spark, sf):
    """Offset of each record in its lane, and the tokens before it."""
    rows = table(spark, sf, "events").select(F.col("event_id").alias("record"), F.col("event_type").alias("lane"))
    return prefix_sums(rows, ["lane"], ["record"], {"lane_offset": F.lit(1).cast("long"), "tokens_before": F.col("record") % 97 + 1})


@query("agg_token_audit", f"""
WITH r AS (SELECT event_id, event_type, user_id, event_id % 97 + 1 AS n, sum(event_id % 97 + 1) OVER (ORDER BY event_id) - (event_id % 97 + 1) AS lo FROM events)
SELECT event_type AS lane, CAST(count(*) AS BIGINT) AS records, CAST(min(event_id) AS BIGINT) AS first_record, CAST(max(event_id) AS BIGINT) AS last_record, CAST(count(DISTINCT user_id) AS BIGINT) AS shards, CAST(sum(n) AS BIGINT) AS tokens FROM r WHERE lo < {WINDOW[1]} AND lo + n > {WINDOW[0]} GROUP BY event_type""")  # fmt: skip
def agg_token_audit(spark, sf):
    """What a range of the token stream was made of."""
    rows = table(spark, sf, "events").select("event_id", "event_type", "user_id", (F.col("event_id") % 97 + 1).alias("n"))
    placed = prefix_sums(rows.withColumn("all", F.lit(0)), ["all"], ["event_id"], {"lo": F.col("n")})
    hit = placed.where((F.col("lo") < WINDOW[1]) & (F.col("lo") + F.col("n") > WINDOW[0]))
    return hit.groupBy(F.col("event_type").alias("lane")).agg(F.count("*").alias("records"), F.min("event_id").alias("first_record"), F.max("event_id").alias("last_record"), F.countDistinct("user_id").alias("shards"), F.sum("n").alias("tokens"))


@query("win_gaps", """
WITH d AS (SELECT DISTINCT user_id, datediff('day', DATE '1970-01-01', CAST(ts AS DATE)) AS step FROM events), l AS (SELECT *, lead(step) OVER (PARTITION BY user_id ORDER BY step) AS nxt FROM d)
SELECT user_id, step AS after_step, nxt AS next_step, nxt - step - 1 AS missing FROM l WHERE nxt > step + 1""")
def win_gaps(spark, sf):
    """Steps (days) that are missing between a user's steps; a user has as many as there are days."""
    day = F.datediff(F.col("ts").cast("date"), F.lit("1970-01-01").cast("date")).cast("long")
    steps = table(spark, sf, "events").select("user_id", day.alias("step")).distinct()
    return steps.withColumn("next_step", F.lead("step").over(Window.partitionBy("user_id").orderBy("step"))).where("next_step > step + 1").select("user_id", F.col("step").alias("after_step"), "next_step", (F.col("next_step") - F.col("step") - 1).alias("missing"))


@query("win_effective_stream", """
SELECT user_id, event_type, event_id, value FROM (SELECT *, row_number() OVER (PARTITION BY user_id, event_type ORDER BY event_id DESC) AS k FROM events) WHERE k = 1""")
def win_effective_stream(spark, sf):
    """The last record of each key wins; found by a maximum, without a sort of the key's records."""
    rows = table(spark, sf, "events").select("user_id", "event_type", "event_id", "value")
    return last_in(rows, ["user_id", "event_type"], ["event_id"])


@query("resume_compare", """
WITH a AS (SELECT user_id, event_type, max(event_id) AS last, count(*) AS n FROM events WHERE event_id % 50 <> 7 GROUP BY 1, 2), b AS (SELECT user_id, event_type, max(event_id) AS last, count(*) AS n FROM events WHERE event_id % 50 <> 8 GROUP BY 1, 2)
SELECT coalesce(a.user_id, b.user_id) AS user_id, coalesce(a.event_type, b.event_type) AS event_type, CASE WHEN b.user_id IS NULL THEN 'lost' WHEN a.user_id IS NULL THEN 'extra' ELSE 'differs' END AS verdict
FROM a FULL JOIN b ON a.user_id = b.user_id AND a.event_type = b.event_type WHERE a.last IS DISTINCT FROM b.last OR a.n IS DISTINCT FROM b.n""")
def resume_compare(spark, sf):
    """Two runs' state by key, full outer, field by field with nulls as values; only what differs."""
    events = table(spark, sf, "events")
    run = lambda skip: events.where(F.col("event_id") % 50 != skip).groupBy("user_id", "event_type").agg(F.max("event_id").alias("last"), F.count("*").alias("n"), F.lit(True).alias("there"))
    a, b = run(7).alias("a"), run(8).alias("b")
    both = a.join(b, (F.col("a.user_id") == F.col("b.user_id")) & (F.col("a.event_type") == F.col("b.event_type")), "full")
    off = ~F.col("a.last").eqNullSafe(F.col("b.last")) | ~F.col("a.n").eqNullSafe(F.col("b.n"))
    verdict = F.when(F.col("b.there").isNull(), "lost").when(F.col("a.there").isNull(), "extra").otherwise("differs")
    return both.where(off).select(F.coalesce("a.user_id", "b.user_id").alias("user_id"), F.coalesce("a.event_type", "b.event_type").alias("event_type"), verdict.alias("verdict"))


@query("agg_compliance", f"""
WITH p AS (SELECT unnest(['en', 'fr', 'de', 'es']) AS lang, unnest([0.6::DOUBLE, 0.15, 0.15, 0.1]) AS planned), a AS (SELECT lang, sum(len({WORDS})) AS tokens FROM documents GROUP BY lang)
SELECT lang, planned, round(tokens / t::DOUBLE, 6) AS actual, round(abs(tokens / t::DOUBLE - planned), 6) AS error, lang = 'en' OR tokens / t::DOUBLE >= 0.1 - 0.005 AS floor_held FROM p JOIN a USING (lang), (SELECT sum(tokens) AS t FROM a)""")  # fmt: skip
def agg_compliance(spark, sf):
    """Planned and actual shares of lanes, and whether floors held."""
    plan = spark.createDataFrame([(k, v, FLOOR.get(k)) for k, v in _PLANNED.items()], "lang string, planned double, floor double")
    used = table(spark, sf, "documents").groupBy("lang").agg(F.sum(F.size(T.words("text")).cast("long")).alias("tokens"))
    total = used.agg(F.sum("tokens").alias("t"))
    share = F.col("tokens") / F.col("t")
    held = F.col("floor").isNull() | (share >= F.col("floor") - 0.005)
    return used.join(F.broadcast(plan), "lang").crossJoin(F.broadcast(total)).select("lang", "planned", F.round(share, 6).alias("actual"), F.round(F.abs(share - F.col("planned")), 6).alias("error"), held.alias("floor_held"))


@query("win_tail_split", f"""
WITH r AS (SELECT doc_id, lang, row_number() OVER (PARTITION BY lang ORDER BY doc_id) AS k, count(*) OVER (PARTITION BY lang) AS n FROM documents)
SELECT doc_id, lang, CASE WHEN k <= floor(n * {TAIL}::DOUBLE) THEN 'train' ELSE 'validation' END AS part FROM r""")  # fmt: skip
def win_tail_split(spark, sf):
    """The last documents of each lane are held back."""
    docs = table(spark, sf, "documents").select("doc_id", "lang")
    n = docs.groupBy("lang").agg(F.count("*").alias("n"))
    return numbered(docs, ["lang"], ["doc_id"], "k").join(F.broadcast(n), "lang").select("doc_id", "lang", F.when(F.col("k") <= F.floor(F.col("n") * TAIL), "train").otherwise("validation").alias("part"))


_QUALITY = f"""qd AS (SELECT doc_id, lang, {WORDS} AS w, len(list_filter(regexp_split_to_array(text, '[।॥.!?]'), lambda s: {TRIM.format('s')} <> '')) AS s, length(text) AS chars FROM documents),
qq AS (SELECT doc_id, lang, chars, len(w) AS n, round(len(list_distinct(w)) / sqrt(greatest(1, len(w))), 6) AS ttr, round(len(w)::DOUBLE / greatest(1, s), 6) AS wps FROM qd),
qp AS (SELECT *, greatest(1, count(*) OVER (PARTITION BY lang) - 1)::DOUBLE AS m, row_number() OVER (PARTITION BY lang ORDER BY ttr, doc_id) - 1 AS a, row_number() OVER (PARTITION BY lang ORDER BY wps, doc_id) - 1 AS b, row_number() OVER (PARTITION BY lang ORDER BY n, doc_id) - 1 AS c FROM qq),
qs AS (SELECT doc_id, lang, chars, round(0.4 * a / m + 0.35 * (1 - 2 * abs(b / m - 0.5)) + 0.25 * c / m, 6) AS score FROM qp)"""


def quality_scores(spark, sf):
    """doc_id, lang, chars, score: percent ranks in the lane of vocabulary richness, of sentences of middling length, and of length."""
    docs = table(spark, sf, "documents").select("doc_id", "lang", F.char_length("text").cast("long").alias("chars"), T.words("text").alias("w"), F.size(F.filter(F.split("text", "[।॥.!?]"), lambda x: T.strip(x) != "")).alias("s"))
    n = F.size("w")
    docs = docs.select("doc_id", "lang", "chars", n.cast("long").alias("n"), F.round(F.size(F.array_distinct("w")) / F.sqrt(F.greatest(F.lit(1), n).cast("double")), 6).alias("ttr"), F.round(n / F.greatest(F.lit(1), F.col("s")), 6).alias("wps"))
    docs = materialize(spark, docs, "quality-parts")  # three orders of it follow
    lanes = docs.groupBy("lang").agg(F.count("*").alias("size"))
    for c, name in (("ttr", "a"), ("wps", "b"), ("n", "c")):
        docs = numbered(docs, ["lang"], [c, "doc_id"], name)
    pct = lambda k: (F.col(k) - 1) / F.greatest(F.lit(1), F.col("size") - 1)
    score = 0.4 * pct("a") + 0.35 * (1 - 2 * F.abs(pct("b") - 0.5)) + 0.25 * pct("c")
    return docs.join(F.broadcast(lanes), "lang").select("doc_id", "lang", "chars", F.round(score, 6).alias("score"))


@query("win_quality_score", f"WITH {_QUALITY} SELECT doc_id, score FROM qs")
def win_quality_score(spark, sf):
    return quality_scores(spark, sf).select("doc_id", "score")


RESERVE = 0.15


@query("win_quality_reserve", f"""WITH {_QUALITY}, t AS (SELECT lang, sum(chars) AS total FROM qs GROUP BY lang), o AS (SELECT *, coalesce(sum(chars) OVER (PARTITION BY lang ORDER BY score DESC, doc_id DESC ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before FROM qs JOIN t USING (lang))
SELECT doc_id, lang, CASE WHEN before < total * {RESERVE}::DOUBLE THEN 'reserve' ELSE 'bulk' END AS part FROM o""")  # fmt: skip
def win_quality_reserve(spark, sf):
    """The best documents of each lane until they hold a share of its characters; of equal scores the later id first."""
    rows = quality_scores(spark, sf)
    totals = rows.groupBy("lang").agg(F.sum("chars").alias("total"))
    rows = rows.withColumn("down", -F.col("score")).withColumn("back", -F.col("doc_id"))
    placed = prefix_sums(rows, ["lang"], ["down", "back"], {"before": F.col("chars")}).join(F.broadcast(totals), "lang")
    return placed.select("doc_id", "lang", F.when(F.col("before") < F.col("total") * RESERVE, "reserve").otherwise("bulk").alias("part"))


@query("set_pool_complement", f"""WITH {_QUALITY}, t AS (SELECT lang, sum(chars) AS total FROM qs GROUP BY lang), o AS (SELECT *, coalesce(sum(chars) OVER (PARTITION BY lang ORDER BY score DESC, doc_id DESC ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before FROM qs JOIN t USING (lang))
SELECT doc_id FROM documents EXCEPT SELECT doc_id FROM o WHERE before < total * {RESERVE}::DOUBLE""")  # fmt: skip
def set_pool_complement(spark, sf):
    """All documents but the reserve."""
    reserve = win_quality_reserve(spark, sf).where("part = 'reserve'").select("doc_id")
    return table(spark, sf, "documents").select("doc_id").exceptAll(reserve)


@query("set_unseen_words", f"""WITH a AS (SELECT DISTINCT unnest({WORDS}) AS w FROM conversations), b AS (SELECT DISTINCT unnest({WORDS}) AS w FROM documents)
SELECT w FROM a WHERE octet_length(encode(w)) <= 32 EXCEPT SELECT w FROM b""")  # fmt: skip
def set_unseen_words(spark, sf):
    """Words of up to 32 bytes that conversations have and documents don't."""
    words = lambda name: table(spark, sf, name).select(F.explode(T.words("text")).alias("w")).distinct()
    return words("conversations").where(F.octet_length("w") <= 32).join(words("documents"), "w", "left_anti")


@query("set_common_words", f"""SELECT lang, CAST(count(*) AS BIGINT) AS common FROM (SELECT DISTINCT lang, unnest({WORDS}) AS w FROM documents) WHERE w IN (SELECT unnest({WORDS}) FROM benchmark) GROUP BY lang""")
def set_common_words(spark, sf):
    """How many of each lane's words held-out items also have."""
    held = table(spark, sf, "benchmark").select(F.explode(T.words("text")).alias("w")).distinct()
    return table(spark, sf, "documents").select("lang", F.explode(T.words("text")).alias("w")).distinct().join(held, "w", "left_semi").groupBy("lang").agg(F.count("*").alias("common"))


@query("win_tail_tokens", f"""WITH d AS (SELECT doc_id, lang, len({WORDS}) AS n FROM documents), o AS (SELECT *, sum(n) OVER (PARTITION BY lang) AS t, sum(n) OVER (PARTITION BY lang ORDER BY doc_id) - n AS lo FROM d)
SELECT doc_id, lang, CAST(greatest(0, least(n, floor(t * 0.98::DOUBLE) - lo)) AS BIGINT) AS train_tokens, CAST(n - greatest(0, least(n, floor(t * 0.98::DOUBLE) - lo)) AS BIGINT) AS validation_tokens FROM o""")  # fmt: skip
def win_tail_tokens(spark, sf):
    """The last 2 % of each lane's tokens are for validation, wherever in a document that begins."""
    docs = table(spark, sf, "documents").select("doc_id", "lang", F.size(T.words("text")).cast("long").alias("n"))
    totals = docs.groupBy("lang").agg(F.sum("n").alias("t"))
    placed = prefix_sums(docs, ["lang"], ["doc_id"], {"lo": F.col("n")}).join(F.broadcast(totals), "lang")
    train = F.greatest(F.lit(0).cast("long"), F.least("n", F.floor(F.col("t") * 0.98) - F.col("lo")))
    return placed.select("doc_id", "lang", train.alias("train_tokens"), (F.col("n") - train).alias("validation_tokens"))


@query("tok_pools", f"""WITH {_VOCAB_SQL}, p AS (SELECT doc_id, lang, octet_length(encode(text)) AS bytes, regexp_extract_all(text, '{PRETOKEN}') AS p FROM documents), e AS (SELECT doc_id, lang, i, p[i] AS t FROM (SELECT doc_id, lang, p, unnest(range(1, len(p) + 1)) AS i FROM p)),
w AS (SELECT e.*, v.id FROM e LEFT JOIN vocab v ON v.token = e.t), c AS (SELECT doc_id, lang, count_if(id IS NOT NULL) AS known, sum(CASE WHEN id IS NULL THEN length(t) ELSE 0 END) AS spelled FROM w GROUP BY 1, 2),
t AS (SELECT c.lang, c.doc_id, known + spelled AS n, spelled, bytes FROM c JOIN p USING (doc_id)), o AS (SELECT *, sum(n) OVER (PARTITION BY lang ORDER BY doc_id) - n AS lo, sum(n) OVER (PARTITION BY lang) AS total FROM t)
SELECT lang, CAST(sum(n) AS BIGINT) AS tokens, CAST(any_value(total) - floor(any_value(total) * 0.98::DOUBLE) AS BIGINT) AS validation, round(sum(bytes) / sum(n)::DOUBLE, 6) AS bytes_a_token, round(sum(spelled) / sum(n)::DOUBLE, 6) AS spelled_rate FROM o GROUP BY lang""")  # fmt: skip
def tok_pools(spark, sf):
    """Pools of tokens by a vocabulary (a token, or its characters): size, validation tail, bytes a token, share of characters that had to be spelled."""
    docs = table(spark, sf, "documents")
    counts = token_counts(docs, "lang")
    vocab = vocabulary_of(counts.groupBy("t").agg(F.sum("c").alias("c")))
    uses = counts.select("lang", F.col("t").alias("token"), F.col("c").alias("k"))
    joined = uses.join(F.broadcast(vocab), "token", "left")  # of VOCAB_SIZE tokens, and the characters of Unicode at most
    spelled = F.when(F.col("id").isNull(), F.char_length("token") * F.col("k")).otherwise(0)
    n = joined.groupBy("lang").agg(F.sum(F.when(F.col("id").isNull(), F.char_length("token") * F.col("k")).otherwise(F.col("k"))).alias("n"), F.sum(spelled).alias("spelled"))
    size = docs.groupBy("lang").agg(F.sum(F.octet_length("text").cast("long")).alias("bytes"))
    return n.join(size, "lang").select("lang", F.col("n").alias("tokens"), (F.col("n") - F.floor(F.col("n") * 0.98)).alias("validation"), F.round(F.col("bytes") / F.col("n"), 6).alias("bytes_a_token"), F.round(F.col("spelled") / F.col("n"), 6).alias("spelled_rate"))


@query("agg_fertility_rules", f"""WITH {_VOCAB_SQL}, u AS (SELECT lang, t, count(*) AS k FROM (SELECT lang, unnest(regexp_extract_all(text, '{PRETOKEN}')) AS t FROM documents) WHERE trim(t, ' ' || chr(9) || chr(10) || chr(13)) <> '' GROUP BY ALL),
n AS (SELECT lang, sum(CASE WHEN v.id IS NULL THEN length(t) * k ELSE k END) AS tokens FROM u LEFT JOIN vocab v ON v.token = u.t GROUP BY lang), w AS (SELECT lang, sum(len({WORDS})) AS words FROM documents GROUP BY lang),
f AS (SELECT lang, tokens / greatest(1, words)::DOUBLE AS f FROM n JOIN w USING (lang)), l AS (SELECT unnest(['en', 'fr', 'de', 'es', 'hi']) AS lang)
SELECT lang, round(f, 6) AS tokens_a_word, CASE WHEN f IS NULL THEN 'lane is missing' WHEN f > 9 THEN 'over its limit' WHEN lang <> 'en' AND f > 1.5 * (SELECT f FROM f WHERE lang = 'en') THEN 'over the reference lane' ELSE 'ok' END AS verdict FROM l LEFT JOIN f USING (lang)""")  # fmt: skip
def agg_fertility_rules(spark, sf):
    """Tokens a word by the vocabulary; a lane must be there, keep to its limit, and not exceed half as much again as the reference lane."""
    docs = table(spark, sf, "documents")
    counts = token_counts(docs, "lang")  # the vocabulary is made from them too
    vocab = vocabulary_of(counts.groupBy("t").agg(F.sum("c").alias("c")))
    uses = counts.where(~F.col("t").isin(" ", "\t", "\n", "\r")).select("lang", F.col("t").alias("token"), F.col("c").alias("k"))  # white space comes a character a token
    n = uses.join(F.broadcast(vocab), "token", "left").groupBy("lang").agg(F.sum(F.when(F.col("id").isNull(), F.char_length("token") * F.col("k")).otherwise(F.col("k"))).alias("tokens"))
    words = docs.groupBy("lang").agg(F.sum(T.word_count("text")).alias("words"))
    f = n.join(words, "lang").select("lang", (F.col("tokens") / F.greatest(F.lit(1).cast("long"), F.col("words"))).alias("f"))
    limits = F.broadcast(spark.createDataFrame([(k,) for k in _LIMITS], "lang string")).join(f, "lang", "left").crossJoin(F.broadcast(f.where("lang = 'en'").agg(F.max("f").alias("ref"))))
    verdict = F.when(F.col("f").isNull(), "lane is missing").when(F.col("f") > 9, "over its limit").when((F.col("lang") != "en") & (F.col("f") > 1.5 * F.col("ref")), "over the reference lane").otherwise("ok")
    return limits.select("lang", F.round("f", 6).alias("tokens_a_word"), verdict.alias("verdict"))


# --- records with a stage: compliance, repeats, comparison by ordinal --------------------------------------

_EVENT_LANES = {"view": "web", "click": "code", "purchase": "indic", "signup": "stem", "error": "reasoning"}
_LANE_CASE = "CASE event_type " + " ".join(f"WHEN '{k}' THEN '{v}'" for k, v in _EVENT_LANES.items()) + " END"
_STAGED = f"""{_SCHEDULE}, {_MM}, rec AS (SELECT event_id, {_LANE_CASE} AS lane, event_id % 97 + 1 AS n, sum(event_id % 97 + 1) OVER (ORDER BY event_id) - (event_id % 97 + 1) AS lo FROM events),
rs AS (SELECT rec.*, coalesce((SELECT min(idx) FROM sc WHERE lo * 2 < token_end), (SELECT max(idx) FROM sc)) AS idx FROM rec),
sl AS (SELECT idx, lane, sum(n) AS tokens FROM rs GROUP BY 1, 2), st AS (SELECT idx, sum(tokens) AS total FROM sl GROUP BY idx),
cm AS (SELECT sc.stage, sl.lane, tokens, CAST(floor(share / 100 * total) AS BIGINT) AS planned_tokens, round(share / 100, 6) AS planned, round(tokens / total::DOUBLE, 6) AS actual, round(abs(tokens / total::DOUBLE - share / 100), 6) AS error FROM sl JOIN st USING (idx) JOIN sc USING (idx) JOIN mm ON mm.idx = sl.idx AND mm.lane = sl.lane)"""


def staged(spark, sf):
    """idx, lane, n: records in order of the tokens before them, with the stage in which they fall (half the tokens of a step are pad)."""
    names = F.create_map(*[F.lit(x) for kv in _EVENT_LANES.items() for x in kv])
    rows = table(spark, sf, "events").select("event_id", names[F.col("event_type")].alias("lane"), (F.col("event_id") % 97 + 1).alias("n"), F.lit(0).alias("all"))
    placed = prefix_sums(rows, ["all"], ["event_id"], {"lo": F.col("n")})
    stages = schedule(spark).orderBy("idx").collect()  # six rows: an expression of six cases, so no join for each record
    case = F.lit(stages[-1]["idx"])
    for r in reversed(stages[:-1]):
        case = F.when(F.col("lo") * 2 < r["token_end"], r["idx"]).otherwise(case)
    return placed.withColumn("idx", case)


@query("agg_compliance_stages", f"WITH {_STAGED} SELECT stage, lane, CAST(tokens AS BIGINT) AS tokens, planned_tokens, planned, actual, error, row_number() OVER (PARTITION BY stage ORDER BY error DESC, lane) = 1 AS worst FROM cm")
def agg_compliance_stages(spark, sf):
    """Planned and actual tokens of each lane in each stage, and the lane that is furthest off."""
    from pyspark.sql import Window

    lanes = staged(spark, sf).groupBy("idx", "lane").agg(F.sum("n").alias("tokens"))
    total = F.sum("tokens").over(Window.partitionBy("idx"))
    plan = F.broadcast(stage_mixture(spark).select("stage", "idx", "lane", (F.col("share") / 100).alias("planned")))
    rows = lanes.withColumn("total", total).join(plan, ["idx", "lane"])
    share = F.col("tokens") / F.col("total")
    rows = rows.select("stage", "lane", "tokens", F.floor(F.col("planned") * F.col("total")).alias("planned_tokens"), F.round("planned", 6).alias("planned"), F.round(share, 6).alias("actual"), F.round(F.abs(share - F.col("planned")), 6).alias("error"))
    return rows.withColumn("worst", F.row_number().over(Window.partitionBy("stage").orderBy(F.desc("error"), "lane")) == 1)


@query("agg_compliance_rollup", f"WITH {_STAGED}, j AS (SELECT stage, sl.lane, tokens FROM sl JOIN sc USING (idx)) SELECT stage, lane, CAST(sum(tokens) AS BIGINT) AS tokens, GROUPING(stage, lane) AS level FROM j GROUP BY ROLLUP (stage, lane)")
def agg_compliance_rollup(spark, sf):
    """Tokens by stage and lane, by stage, and in all."""
    names = F.broadcast(schedule(spark).select("idx", "stage"))
    return staged(spark, sf).groupBy("idx", "lane").agg(F.sum("n").alias("n")).join(names, "idx").rollup("stage", "lane").agg(F.sum("n").alias("tokens"), F.grouping_id().alias("level"))


@query("win_repeats", """SELECT user_id, event_type, CAST(CAST(ts AS DATE) AS VARCHAR) AS day, CAST(count(*) AS BIGINT) AS times, min(event_id) AS first_offset, max(event_id) AS last_offset FROM events GROUP BY 1, 2, 3 HAVING count(*) > 1""")
def win_repeats(spark, sf):
    """Keys (user, type, day) that the log has more than once, and where."""
    key = ["user_id", "event_type", F.date_format("ts", "yyyy-MM-dd").alias("day")]
    return table(spark, sf, "events").groupBy(*key).agg(F.count("*").alias("times"), F.min("event_id").alias("first_offset"), F.max("event_id").alias("last_offset")).where("times > 1")


@query("resume_ordinal", """
WITH a AS (SELECT row_number() OVER (ORDER BY event_id) AS k, * FROM events), b AS (SELECT row_number() OVER (ORDER BY event_id) AS k, * FROM events WHERE event_id <> (SELECT max(event_id) // 2 FROM events)),
j AS (SELECT coalesce(a.k, b.k) AS k, a.k IS NULL OR b.k IS NULL AS missing, (a.event_id IS NOT DISTINCT FROM b.event_id)::INT + (a.user_id IS NOT DISTINCT FROM b.user_id)::INT + (a.event_type IS NOT DISTINCT FROM b.event_type)::INT + (a.ts IS NOT DISTINCT FROM b.ts)::INT + (a.value IS NOT DISTINCT FROM b.value)::INT + (a.props IS NOT DISTINCT FROM b.props)::INT AS same FROM a FULL JOIN b ON a.k = b.k)
SELECT same, missing, CAST(count(*) AS BIGINT) AS records, CAST(min(k) AS BIGINT) AS first_ordinal FROM j GROUP BY same, missing""")
def resume_ordinal(spark, sf):
    """Two logs laid side by side by ordinal, six fields each, nulls as values; the second has lost one record in the middle."""
    events = table(spark, sf, "events").withColumn("all", F.lit(0))
    lost = (events.agg(F.max("event_id")).first()[0] or 0) // 2
    fields = ["event_id", "user_id", "event_type", "ts", "value", "props"]
    side = lambda df, name: numbered(df, ["all"], ["event_id"], "k").select("k", F.struct(*fields).alias(name))
    both = side(events, "a").join(side(events.where(F.col("event_id") != lost), "b"), "k", "full")
    same = sum((F.col(f"a.{f}").eqNullSafe(F.col(f"b.{f}")).cast("int") for f in fields), F.lit(0))
    return both.select("k", (F.col("a").isNull() | F.col("b").isNull()).alias("missing"), same.alias("same")).groupBy("same", "missing").agg(F.count("*").alias("records"), F.min("k").alias("first_ordinal"))
