"""Queries of shard hygiene: dedup, screening against held-out items, manifests, admission."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from millrace.functions import text as T
from millrace.operators.ordered import numbered
from millrace.plans.text import TRIM, WORDS, ngram_sql
from millrace.registry import query
from millrace.session import materialize, table

NEAR, CONTAMINATED, LEAST_SHARED, CONTAINED = 0.8, 0.35, 4, 0.8
#: Ids of rows that queries add to the documents as positive controls: held-out items as they are and with a tail, and near copies of long documents.
EXACT_ID, TAIL_ID, COPY_ID = 1_000_000_000, 2_000_000_000, 3_000_000_000
TAIL = " and some more words"

_CONTROLLED = f"""ctl AS (SELECT doc_id, lang, text FROM documents UNION ALL SELECT {EXACT_ID} + item_id, 'en', text FROM benchmark UNION ALL SELECT {TAIL_ID} + item_id, 'en', text || '{TAIL}' FROM benchmark)"""
_COPIED = f"""cop AS (SELECT doc_id, lang, text FROM documents UNION ALL SELECT {COPY_ID} + doc_id, lang, text || '{TAIL}' FROM documents WHERE length(text) > 4000)"""


def controlled(spark, sf) -> DataFrame:
    """The documents, and every held-out item as a document, as it is and with a tail."""
    held = table(spark, sf, "benchmark")
    rows = table(spark, sf, "documents").select("doc_id", "lang", "text")
    for first, tail in ((EXACT_ID, ""), (TAIL_ID, TAIL)):
        rows = rows.unionByName(held.select((F.col("item_id") + first).alias("doc_id"), F.lit("en").alias("lang"), F.concat("text", F.lit(tail)).alias("text")))
    return rows


def with_copies(spark, sf) -> DataFrame:
    """The documents, and near copies of the long ones."""
    docs = table(spark, sf, "documents").select("doc_id", "lang", "text")
    return docs.unionByName(docs.where(F.char_length("text") > 4000).select((F.col("doc_id") + COPY_ID).alias("doc_id"), "lang", F.concat("text", F.lit(TAIL)).alias("text")))


def fingerprint_sets(df: DataFrame, key: str, stride: int = 4) -> DataFrame:
    """(key, g): the distinct 8-grams of each row's words as 64-bit hashes. Words are hashed once, and grams from those hashes."""
    worded = df.select(F.col(key), F.transform(T.words("text"), lambda x: F.xxhash64(x)).alias("w"))
    return worded.select(key, T.gram_hashes("w", 8, stride).alias("g"))


def exploded(sets: DataFrame, key: str) -> DataFrame:
    """One row a gram.

    The outer form, and a size that can't be null, leave the optimizer no test of the grams to push down: below, it
    would make them again, and from the text for every gram.
    """
    return sets.select(key, F.coalesce(F.size("g"), F.lit(0)).cast("long").alias("size"), F.explode_outer("g").alias("gram")).where("gram IS NOT NULL")


def fingerprints(df: DataFrame, key: str, stride: int = 4) -> DataFrame:
    """(key, gram, size): one row a gram, with how many its row has."""
    return exploded(fingerprint_sets(df, key, stride), key)


def near_pairs(docs: DataFrame, least: float = NEAR, stride: int = 4, first: DataFrame | None = None) -> DataFrame:
    """(a, b, shared, jaccard), a < b, of documents of different texts whose fingerprints are alike.

    Documents of one text are one node (the first of them), so copies don't pair off; `first` (doc_id) names them where they are known. A document's grams are
    ordered by rarity; two sets of similarity `least` share one of their first size - ceil(least * size) + 1
    grams, so only those are joined (prefix filter), and common passages rarely are among them. Pairs that meet are
    compared once, on both sets as arrays.
    """
    if first is None:
        first = docs.groupBy(F.xxhash64("text").alias("h"), F.sha2(F.col("text").cast("binary"), 256).alias("sha")).agg(F.min("doc_id").alias("doc_id")).select("doc_id")
    sets = materialize(docs.sparkSession, fingerprint_sets(docs.join(first, "doc_id", "left_semi"), "doc_id", stride), "grams")
    grams = exploded(sets, "doc_id")
    often = grams.groupBy("gram").agg(F.count("*").alias("df")).where("df > 1")
    ranked = grams.join(often, "gram").withColumn("place", F.row_number().over(Window.partitionBy("doc_id").orderBy("df", "gram")))
    lonely = F.col("size") - F.count("*").over(Window.partitionBy("doc_id"))  # grams that no other has come before all
    prefix = ranked.withColumn("lonely", lonely).where(F.col("place") + F.col("lonely") <= F.col("size") - F.ceil(F.col("size") * least) + 1).select("doc_id", "gram", "size")
    prefix = materialize(docs.sparkSession, prefix, "prefix-grams")
    a, b = prefix.alias("a"), prefix.alias("b")
    sizes = (F.col("b.size") >= F.col("a.size") * least) & (F.col("a.size") >= F.col("b.size") * least)
    met = a.join(b, (F.col("a.gram") == F.col("b.gram")) & (F.col("a.doc_id") < F.col("b.doc_id")) & sizes).select(F.col("a.doc_id").alias("a"), F.col("b.doc_id").alias("b")).distinct()
    left = met.join(sets.select(F.col("doc_id").alias("a"), F.col("g").alias("ga")), "a")
    both = left.join(sets.select(F.col("doc_id").alias("b"), F.col("g").alias("gb")), "b")
    shared = both.select("a", "b", F.size("ga").alias("na"), F.size("gb").alias("nb"), F.size(F.array_intersect("ga", "gb")).cast("long").alias("shared"))
    out = shared.withColumn("jaccard", F.col("shared") / (F.col("na") + F.col("nb") - F.col("shared")))
    return out.where(F.col("jaccard") >= least).select("a", "b", "shared", "jaccard")


@query("dedup_exact", "SELECT doc_id, sha256(text) AS sha, row_number() OVER (PARTITION BY sha256(text) ORDER BY doc_id) = 1 AS kept FROM documents")
def dedup_exact(spark, sf):
    """The first of equal texts stays: a minimum made in each task first, then joined."""
    docs = table(spark, sf, "documents").select("doc_id", F.sha2(F.col("text").cast("binary"), 256).alias("sha"))
    first = docs.groupBy("sha").agg(F.min("doc_id").alias("first"))
    return docs.join(first, "sha").select("doc_id", "sha", (F.col("doc_id") == F.col("first")).alias("kept"))


_PAIRS = f"""{_COPIED}, {ngram_sql(4, "cop")},
fd AS (SELECT min(doc_id) AS doc_id FROM cop GROUP BY sha256(text)),
g AS (SELECT dg.* FROM dg SEMI JOIN fd USING (doc_id)), sz AS (SELECT doc_id, count(*) AS n FROM g GROUP BY doc_id),
sh AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS shared FROM g a JOIN g b ON a.g = b.g AND a.doc_id < b.doc_id GROUP BY 1, 2),
pairs AS (SELECT a, b, shared, shared / (x.n + y.n - shared)::DOUBLE AS jaccard FROM sh JOIN sz x ON x.doc_id = a JOIN sz y ON y.doc_id = b WHERE shared / (x.n + y.n - shared)::DOUBLE >= {NEAR})"""


@query("dedup_near_pairs", f"WITH {_PAIRS} SELECT a, b, CAST(shared AS BIGINT) AS shared, round(jaccard, 6) AS jaccard FROM pairs")
def dedup_near_pairs(spark, sf):
    """Pairs among the documents and near copies of the long ones."""
    return near_pairs(with_copies(spark, sf)).select("a", "b", "shared", F.round("jaccard", 6).alias("jaccard"))


def greedy(pairs: DataFrame) -> DataFrame:
    """(node, kept) of all nodes with a pair: kept if no earlier neighbour is kept, in the order of nodes.

    Rounds decide what they can: a node whose earlier neighbours all went is kept, one with a kept earlier
    neighbour goes. That equals one pass in order; each round is written, so nothing is recomputed.
    """
    spark = pairs.sparkSession
    edges = materialize(spark, pairs.select("a", "b"), "greedy-edges")
    nodes = edges.select(F.col("a").alias("node")).unionByName(edges.select(F.col("b").alias("node"))).distinct()
    state = materialize(spark, nodes.withColumn("kept", F.lit(None).cast("boolean")), "greedy")
    while state.where("kept IS NULL").limit(1).count():
        before = edges.join(state.withColumnsRenamed({"node": "a", "kept": "ka"}), "a").groupBy(F.col("b").alias("node")).agg(
            F.bool_or(F.coalesce("ka", F.lit(False))).alias("beaten"), F.bool_and(F.coalesce(~F.col("ka"), F.lit(False))).alias("free")
        )
        new = F.when(F.col("kept").isNotNull(), F.col("kept")).when(F.col("beaten"), False).when(F.coalesce("free", F.lit(True)), True)
        state = materialize(spark, state.join(before, "node", "left").select("node", new.alias("kept")), "greedy")
    return state


@query("dedup_greedy", f"""
WITH RECURSIVE {_PAIRS},
o AS (SELECT node, row_number() OVER (ORDER BY node) AS k FROM (SELECT a AS node FROM pairs UNION SELECT b FROM pairs)),
r(k, kept) AS (SELECT CAST(0 AS BIGINT), CAST([] AS BIGINT[]) UNION ALL
  SELECT o.k, CASE WHEN EXISTS (SELECT 1 FROM pairs WHERE b = o.node AND list_contains(r.kept, a)) THEN r.kept ELSE list_append(r.kept, o.node) END FROM r JOIN o ON o.k = r.k + 1),
kk AS (SELECT unnest(kept) AS node FROM r WHERE k = (SELECT max(k) FROM r)),
sh2 AS (SELECT doc_id, min(doc_id) OVER (PARTITION BY sha256(text)) AS f FROM cop)
SELECT doc_id, CASE WHEN f <> doc_id THEN 'exact' WHEN f IN (SELECT node FROM o) AND f NOT IN (SELECT node FROM kk) THEN 'near' ELSE 'kept' END AS verdict FROM sh2""")  # fmt: skip
def dedup_greedy(spark, sf):
    """First seen wins: exact copies go, then what is near an earlier kept document."""
    return verdicts(with_copies(spark, sf)).select("doc_id", "verdict")


def verdicts(docs: DataFrame) -> DataFrame:
    """doc_id, lang, verdict. Texts are read twice: for their hashes and for their grams."""
    hashed = materialize(docs.sparkSession, docs.select("doc_id", "lang", F.sha2(F.col("text").cast("binary"), 256).alias("sha")), "hashed")
    first = hashed.groupBy("sha").agg(F.min("doc_id").alias("first"))
    state = greedy(near_pairs(docs, first=first.select(F.col("first").alias("doc_id"))))
    rows = hashed.join(first, "sha").join(state.withColumnRenamed("node", "first"), "first", "left")
    return rows.select("doc_id", "lang", F.when(F.col("doc_id") != F.col("first"), "exact").when(~F.coalesce("kept", F.lit(True)), "near").otherwise("kept").alias("verdict"))


@query("agg_dedup_report", f"""
WITH RECURSIVE {_PAIRS},
o AS (SELECT node, row_number() OVER (ORDER BY node) AS k FROM (SELECT a AS node FROM pairs UNION SELECT b FROM pairs)),
r(k, kept) AS (SELECT CAST(0 AS BIGINT), CAST([] AS BIGINT[]) UNION ALL
  SELECT o.k, CASE WHEN EXISTS (SELECT 1 FROM pairs WHERE b = o.node AND list_contains(r.kept, a)) THEN r.kept ELSE list_append(r.kept, o.node) END FROM r JOIN o ON o.k = r.k + 1),
kk AS (SELECT unnest(kept) AS node FROM r WHERE k = (SELECT max(k) FROM r)),
sh2 AS (SELECT doc_id, lang, min(doc_id) OVER (PARTITION BY sha256(text)) AS f FROM cop),
v AS (SELECT lang, CASE WHEN f <> doc_id THEN 'exact' WHEN f IN (SELECT node FROM o) AND f NOT IN (SELECT node FROM kk) THEN 'near' ELSE 'kept' END AS verdict FROM sh2)
SELECT lang, CAST(count(*) AS BIGINT) AS samples_in, CAST(count_if(verdict = 'kept') AS BIGINT) AS samples_kept, CAST(count_if(verdict = 'exact') AS BIGINT) AS exact, CAST(count_if(verdict = 'near') AS BIGINT) AS near FROM v GROUP BY lang""")  # fmt: skip
def agg_dedup_report(spark, sf):
    verdict = F.col("verdict")
    rows = verdicts(with_copies(spark, sf))
    return rows.groupBy("lang").agg(F.count("*").alias("samples_in"), F.count_if(verdict == "kept").alias("samples_kept"), F.count_if(verdict == "exact").alias("exact"), F.count_if(verdict == "near").alias("near"))


@query("screen_exact", f"""
WITH {_CONTROLLED}, h AS (SELECT sha256(text) AS sha, max(item_id) AS item_id FROM benchmark GROUP BY 1)
SELECT doc_id, item_id FROM (SELECT doc_id, sha256(text) AS sha FROM ctl) JOIN h USING (sha)""")  # fmt: skip
def screen_exact(spark, sf):
    """Documents, controls among them, that equal a held-out item; of equal items the last registered counts."""
    return same_text(controlled(spark, sf), table(spark, sf, "benchmark"))


def same_text(docs: DataFrame, held: DataFrame) -> DataFrame:
    items = held.groupBy(F.sha2(F.col("text").cast("binary"), 256).alias("sha")).agg(F.max("item_id").alias("item_id"))
    return docs.select("doc_id", F.sha2(F.col("text").cast("binary"), 256).alias("sha")).join(items, "sha").select("doc_id", "item_id")


#: Grams of held-out items that go to every task.
MOST_HELD = 1_000_000


def screened(docs: DataFrame, held: DataFrame, stride: int) -> DataFrame:
    """(doc_id, item_id, shared, n_doc, n_item) of documents and items with a gram in common."""
    d = fingerprints(docs, "doc_id", stride).withColumnRenamed("size", "n_doc")
    h = materialize(docs.sparkSession, fingerprints(held, "item_id", stride).withColumnRenamed("size", "n_item"), "held-out-grams")
    if h.limit(MOST_HELD + 1).count() <= MOST_HELD:
        h = F.broadcast(h)  # grams of documents stay where they are made; of more items than that they are shuffled
    return d.join(h, "gram").groupBy("doc_id", "item_id", "n_doc", "n_item").agg(F.count("*").alias("shared"))


def _screen_sql(stride: int, docs: str = "documents") -> str:
    return f"""{ngram_sql(stride, docs)}, sz AS (SELECT doc_id, count(*) AS n FROM dg GROUP BY doc_id),
hw AS (SELECT item_id, {WORDS} AS w FROM benchmark),
hg AS (SELECT DISTINCT item_id, array_to_string(w[i:i + 7], ' ') AS g FROM (SELECT item_id, w, unnest(range(1, len(w) - 6, {stride})) AS i FROM hw WHERE len(w) >= 8)),
hz AS (SELECT item_id, count(*) AS m FROM hg GROUP BY item_id),
sh AS (SELECT doc_id, item_id, count(*) AS shared FROM dg JOIN hg USING (g) GROUP BY 1, 2),
j AS (SELECT doc_id, item_id, shared, n, m FROM sh JOIN sz USING (doc_id) JOIN hz USING (item_id))"""


_ALIKE = f"""ok AS (SELECT *, shared / (n + m - shared)::DOUBLE AS jaccard FROM j WHERE shared >= {LEAST_SHARED}),
alike AS (SELECT doc_id, min(item_id) AS item_id, CAST(arg_min(shared, item_id) AS BIGINT) AS shared, round(arg_min(jaccard, item_id), 6) AS jaccard FROM ok WHERE jaccard >= {CONTAMINATED} GROUP BY doc_id)"""


def alike(docs: DataFrame, held: DataFrame) -> DataFrame:
    """By similarity of fingerprints; the first registered item that matches is named."""
    j = screened(docs, held, 4).where(F.col("shared") >= LEAST_SHARED).withColumn("jaccard", F.col("shared") / (F.col("n_doc") + F.col("n_item") - F.col("shared")))
    ok = j.where(F.col("jaccard") >= CONTAMINATED)
    return ok.groupBy("doc_id").agg(F.min("item_id").alias("item_id"), F.min_by("shared", "item_id").alias("shared"), F.round(F.min_by("jaccard", "item_id"), 6).alias("jaccard"))


@query("screen_ngram_jaccard", f"WITH {_CONTROLLED}, {_screen_sql(4, 'ctl')}, {_ALIKE} SELECT * FROM alike")
def screen_ngram_jaccard(spark, sf):
    """Documents, controls among them, whose fingerprint is like a held-out item's."""
    return alike(controlled(spark, sf), table(spark, sf, "benchmark"))


_SCREEN = f"""{_CONTROLLED}, {_screen_sql(4, 'ctl')}, {_ALIKE}, hx AS (SELECT sha256(text) AS sha, max(item_id) AS item_id FROM benchmark GROUP BY 1),
ex AS (SELECT doc_id, item_id FROM (SELECT doc_id, sha256(text) AS sha FROM ctl) JOIN hx USING (sha)),
scr AS (SELECT doc_id, lang, CASE WHEN ex.item_id IS NOT NULL THEN 'exact' WHEN alike.item_id IS NOT NULL THEN 'alike' ELSE 'clean' END AS verdict, coalesce(ex.item_id, alike.item_id) AS item_id, CASE WHEN ex.item_id IS NULL THEN alike.jaccard END AS jaccard FROM ctl LEFT JOIN ex USING (doc_id) LEFT JOIN alike USING (doc_id))"""


def screen(docs: DataFrame, held: DataFrame) -> DataFrame:
    """doc_id, lang, verdict, item_id, jaccard: equal to a held-out item, else like one, else clean. What is equal isn't compared again."""
    spark = docs.sparkSession
    exact = materialize(spark, same_text(docs, held), "screen-exact")
    near = alike(docs.join(exact, "doc_id", "left_anti"), held)
    hits = exact.select("doc_id", F.lit("exact").alias("verdict"), "item_id", F.lit(None).cast("double").alias("jaccard")).unionByName(near.select("doc_id", F.lit("alike").alias("verdict"), "item_id", "jaccard"))
    return docs.select("doc_id", "lang").join(hits, "doc_id", "left").withColumn("verdict", F.coalesce("verdict", F.lit("clean")))


@query("screen_documents", f"WITH {_SCREEN} SELECT * FROM scr")
def screen_documents(spark, sf):
    """Every document, controls among them, with the verdict of the held-out index and the item that it matched."""
    return screen(controlled(spark, sf), table(spark, sf, "benchmark"))


@query("agg_screening_report", f"WITH {_SCREEN} SELECT lang, CAST(count(*) AS BIGINT) AS offered, CAST(count_if(verdict = 'clean') AS BIGINT) AS kept, CAST(count_if(verdict = 'exact') AS BIGINT) AS exact, CAST(count_if(verdict = 'alike') AS BIGINT) AS alike FROM scr GROUP BY lang")
def agg_screening_report(spark, sf):
    v = F.col("verdict")
    return screen_documents(spark, sf).groupBy("lang").agg(F.count("*").alias("offered"), F.count_if(v == "clean").alias("kept"), F.count_if(v == "exact").alias("exact"), F.count_if(v == "alike").alias("alike"))


@query("gate_heldout_index", f"""
WITH hw AS (SELECT item_id, text, {WORDS} AS w FROM benchmark), hg AS (SELECT DISTINCT item_id, array_to_string(w[i:i + 7], ' ') AS g FROM (SELECT item_id, w, unnest(range(1, len(w) - 6, 4)) AS i FROM hw WHERE len(w) >= 8)),
n AS (SELECT item_id, count(*) AS n FROM hg GROUP BY item_id)
SELECT 'held-' || item_id AS held_id, CASE WHEN item_id % 2 = 0 THEN 'test' ELSE 'validation' END AS split, true AS never_train, sha256(text) AS sha, CAST(coalesce(n, 0) AS BIGINT) AS grams FROM hw LEFT JOIN n USING (item_id)""")  # fmt: skip
def gate_heldout_index(spark, sf):
    """The index that screening looks in: each held-out item's id, split, hash and number of grams; both splits are never trained on."""
    held = table(spark, sf, "benchmark")
    sets = fingerprint_sets(held, "item_id")
    split = F.when(F.col("item_id") % 2 == 0, "test").otherwise("validation")
    return held.join(sets, "item_id", "left").select(F.concat(F.lit("held-"), F.col("item_id")).alias("held_id"), split.alias("split"), F.lit(True).alias("never_train"), F.sha2(F.col("text").cast("binary"), 256).alias("sha"), F.coalesce(F.size("g").cast("long"), F.lit(0)).alias("grams"))


@query("screen_containment", f"WITH {_screen_sql(1)} SELECT doc_id, item_id, CAST(shared AS BIGINT) AS shared, round(shared / m::DOUBLE, 6) AS contained FROM j WHERE shared / m::DOUBLE >= {CONTAINED}")
def screen_containment(spark, sf):
    """By the share of an item's grams that a document holds, at every offset: finds items inside long documents."""
    j = screened(table(spark, sf, "documents"), table(spark, sf, "benchmark"), 1)
    share = F.col("shared") / F.col("n_item")
    return j.where(share >= CONTAINED).select("doc_id", "item_id", "shared", F.round(share, 6).alias("contained"))


_HITS = f"{_screen_sql(1)}, hit AS (SELECT DISTINCT doc_id FROM j WHERE shared / m::DOUBLE >= {CONTAINED})"


@query("agg_screening", f"""
WITH {_HITS}
SELECT lang, CAST(count(*) AS BIGINT) AS offered, CAST(count(*) - count(hit.doc_id) AS BIGINT) AS kept, CAST(count(hit.doc_id) AS BIGINT) AS rejected, coalesce(string_agg(CAST(hit.doc_id AS VARCHAR), ',' ORDER BY hit.doc_id), '') AS rejected_ids
FROM documents LEFT JOIN hit USING (doc_id) GROUP BY lang""")  # fmt: skip
def agg_screening(spark, sf):
    hit = screen_containment(spark, sf).select("doc_id").distinct().withColumn("hit", F.lit(True))
    rows = table(spark, sf, "documents").select("doc_id", "lang").join(hit, "doc_id", "left")
    ids = F.array_join(F.transform(F.array_sort(F.collect_list(F.when(F.col("hit"), F.col("doc_id")))), lambda x: x.cast("string")), ",")
    return rows.groupBy("lang").agg(F.count("*").alias("offered"), F.count_if(F.col("hit").isNull()).alias("kept"), F.count_if("hit").alias("rejected"), ids.alias("rejected_ids"))


@query("screen_clean", f"WITH {_HITS} SELECT doc_id, lang FROM documents ANTI JOIN hit USING (doc_id)")
def screen_clean(spark, sf, hits: DataFrame | None = None):
    """What screening lets through; `hits` are those of screen_containment where they are at hand."""
    hits = screen_containment(spark, sf) if hits is None else hits
    return table(spark, sf, "documents").select("doc_id", "lang").join(hits.select("doc_id").distinct(), "doc_id", "left_anti")


SHARD_DOCS = 100
_SHARD = f"source || '-' || lpad(CAST(doc_id // {SHARD_DOCS} AS VARCHAR), 4, '0')"


def shard_of():
    return F.concat_ws("-", "source", F.lpad(F.floor(F.col("doc_id") / SHARD_DOCS).cast("string"), 4, "0"))


def samples(docs: DataFrame) -> DataFrame:
    """One row a document: shard, its words and an end, tokens and loss tokens."""
    return docs.select(shard_of().alias("shard_id"), "doc_id", "lang", "source", T.words("text").alias("w")).withColumn("n_tokens", (F.size("w") + 1).cast("long"))


def manifests(docs: DataFrame) -> DataFrame:
    """Totals and a content hash of each shard: a digest over its samples' digests in order."""
    one = samples(docs).withColumn("d", T.digest(F.col("w")))
    return one.groupBy("shard_id").agg(
        F.count("*").alias("n_samples"), F.sum("n_tokens").alias("n_tokens"),
        T.digest(F.transform(F.array_sort(F.collect_list(F.struct("doc_id", "d"))), lambda s: s["d"])).alias("content_hash"),
    )


_MANIFEST = f"""sm AS (SELECT {_SHARD} AS shard_id, doc_id, len({WORDS}) + 1 AS n, sha256(array_to_string({WORDS}, ',')) AS d FROM documents),
mf AS (SELECT shard_id, CAST(count(*) AS BIGINT) AS n_samples, CAST(sum(n) AS BIGINT) AS n_tokens, sha256(string_agg(d, ',' ORDER BY doc_id)) AS content_hash FROM sm GROUP BY shard_id)"""


@query("agg_manifest", f"WITH {_MANIFEST} SELECT * FROM mf")
def agg_manifest(spark, sf):
    return manifests(table(spark, sf, "documents"))


@query("agg_manifest_structured", f"""
WITH d AS (SELECT conv_id, turn, role, len({WORDS}) AS n, row_number() OVER (PARTITION BY conv_id ORDER BY turn DESC) AS back FROM conversations WHERE len({WORDS}) > 0)
SELECT 'talk-' || lpad(CAST(conv_id // 50 AS VARCHAR), 4, '0') AS shard_id, CAST(count(DISTINCT conv_id) AS BIGINT) AS n_samples, CAST(sum(n + (back = 1)::INT) AS BIGINT) AS n_tokens, CAST(sum(CASE WHEN role = 'assistant' THEN n + (back = 1)::INT ELSE 0 END) AS BIGINT) AS n_loss_tokens FROM d GROUP BY 1""")  # fmt: skip
def agg_manifest_structured(spark, sf):
    """Totals of shards of trajectories, with the tokens that carry loss."""
    loss = F.aggregate("spans", F.lit(0).cast("long"), lambda s, x: s + F.when(x["role"] == "assistant", x["b"] - x["a"]).otherwise(0))
    shard = F.concat(F.lit("talk-"), F.lpad(F.floor(F.col("conv_id") / 50).cast("string"), 4, "0"))
    return trajectories(spark, sf).select(shard.alias("shard_id"), "n_tokens", loss.alias("l")).groupBy("shard_id").agg(F.count("*").alias("n_samples"), F.sum("n_tokens").alias("n_tokens"), F.sum("l").alias("n_loss_tokens"))


@query("tok_documents", f"""
WITH d AS (SELECT conv_id, turn, role, len({WORDS}) AS n, row_number() OVER (PARTITION BY conv_id ORDER BY turn DESC) AS back FROM conversations WHERE len({WORDS}) > 0),
s AS (SELECT conv_id, turn, role, n + (back = 1)::INT AS n FROM d)
SELECT conv_id, CAST(sum(n) AS BIGINT) AS n_tokens, CAST(sum(CASE WHEN role = 'assistant' THEN n ELSE 0 END) AS BIGINT) AS n_loss_tokens, CAST(count(*) AS BIGINT) AS n_spans FROM s GROUP BY conv_id""")  # fmt: skip
def tok_documents(spark, sf):
    """Trajectories as token spans: empty segments dropped, the end goes to the last span, loss on answers."""
    return trajectories(spark, sf).select(
        "conv_id", "n_tokens", F.aggregate("spans", F.lit(0).cast("long"), lambda s, x: s + F.when(x["role"] == "assistant", x["b"] - x["a"]).otherwise(0)).alias("n_loss_tokens"), F.size("spans").cast("long").alias("n_spans")
    )


def trajectories(spark, sf) -> DataFrame:
    """conv_id, n_tokens, spans [a, b) with roles."""
    turns = table(spark, sf, "conversations").select("conv_id", "turn", "role", F.size(T.words("text")).cast("long").alias("n")).where("n > 0")
    grouped = turns.groupBy("conv_id").agg(F.array_sort(F.collect_list(F.struct("turn", "role", "n"))).alias("t"))
    spans = F.expr(
        """aggregate(t, named_struct('at', 0L, 'spans', cast(array() as array<struct<a:bigint,b:bigint,role:string>>)),
        (s, x) -> named_struct('at', s.at + x.n, 'spans', concat(s.spans, array(named_struct('a', s.at, 'b', s.at + x.n, 'role', x.role)))),
        s -> transform(s.spans, (x, i) -> named_struct('a', x.a, 'b', if(i = size(s.spans) - 1, x.b + 1, x.b), 'role', x.role)))"""
    )
    return grouped.select("conv_id", spans.alias("spans")).withColumn("n_tokens", F.element_at("spans", -1)["b"])


@query("fn_loss_mask", f"""
WITH d AS (SELECT conv_id, turn, role, len({WORDS}) AS n, row_number() OVER (PARTITION BY conv_id ORDER BY turn DESC) AS back FROM conversations WHERE len({WORDS}) > 0),
s AS (SELECT *, n + (back = 1)::INT AS m, coalesce(sum(n) OVER (PARTITION BY conv_id ORDER BY turn ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS a FROM d),
p AS (SELECT conv_id, role = 'assistant' AS g, unnest(range(CAST(a AS BIGINT), CAST(a + m AS BIGINT))) AS p FROM s)
SELECT conv_id, CAST(count(*) AS BIGINT) AS n, CAST(count_if(g) AS BIGINT) AS loss, sha256(string_agg(CASE WHEN g THEN '1' ELSE '0' END, '' ORDER BY p)) AS mask_sha256 FROM p GROUP BY conv_id""")  # fmt: skip
def fn_loss_mask(spark, sf):
    """The loss mask of whole trajectories from their spans: its length, its sum and a digest of its digits."""
    digits = F.array_join(F.transform("spans", lambda x: F.repeat(F.when(x["role"] == "assistant", "1").otherwise("0"), (x["b"] - x["a"]).cast("int"))), "")
    loss = F.aggregate("spans", F.lit(0).cast("long"), lambda s, x: s + F.when(x["role"] == "assistant", x["b"] - x["a"]).otherwise(0))
    return trajectories(spark, sf).select("conv_id", F.col("n_tokens").alias("n"), loss.alias("loss"), F.sha2(digits.cast("binary"), 256).alias("mask_sha256"))


@query("verify_shards", f"""
WITH {_MANIFEST}, t AS (SELECT *, CAST(('0x' || left(sha256('spoil:' || shard_id), 4)) AS BIGINT) AS k FROM mf)
SELECT shard_id, CASE WHEN k % 13 = 0 THEN 'missing' WHEN k % 7 = 0 THEN 'hash mismatch' WHEN k % 11 = 0 THEN 'token count' ELSE 'ok' END AS verdict FROM t""")  # fmt: skip
def verify_shards(spark, sf, now: DataFrame | None = None):
    """Recounts shards (or takes what was counted: `now`) against a manifest that was tampered with on purpose: hashes, counts, missing files."""
    now = materialize(spark, manifests(table(spark, sf, "documents")), "manifests") if now is None else now
    k = F.conv(F.substring(F.sha2(F.concat(F.lit("spoil:"), "shard_id").cast("binary"), 256), 1, 4), 16, 10).cast("long")  # which entries are spoilt
    claimed = now.withColumn("k", k).select("shard_id", F.when(F.col("k") % 7 == 0, F.reverse("content_hash")).otherwise(F.col("content_hash")).alias("claimed_hash"), F.when(F.col("k") % 11 == 0, F.col("n_tokens") + 1).otherwise(F.col("n_tokens")).alias("claimed_tokens"), "k")
    on_disk = now.where(k % 13 != 0)
    verdict = F.when(F.col("content_hash").isNull(), "missing").when(F.col("content_hash") != F.col("claimed_hash"), "hash mismatch").when(F.col("n_tokens") != F.col("claimed_tokens"), "token count").otherwise("ok")
    return claimed.join(on_disk, "shard_id", "left").select("shard_id", verdict.alias("verdict"))


_GATE_SQL = f"""
{_HITS}, {_MANIFEST}, lic AS (SELECT *, CAST(('0x' || left(sha256(shard_id), 2)) AS INTEGER) AS h FROM mf),
fl AS (SELECT shard_id, n_tokens, CASE WHEN h % 4 = 3 THEN 'licence tier D not admitted' END AS a, CASE WHEN h % 5 = 0 THEN 'wrong tokenizer hash' END AS b, CASE WHEN h % 9 = 0 THEN 'no cleaning hash' END AS c,
  CASE WHEN h % 6 = 0 THEN 'dedup not passed' END AS d, CASE WHEN h % 17 = 0 THEN 'no lane' END AS e, CASE WHEN h % 13 = 0 THEN 'no content hash' END AS f FROM lic),
ovl AS (SELECT shard_id, count(hit.doc_id) AS n_hits FROM sm LEFT JOIN hit USING (doc_id) GROUP BY shard_id),
gate AS (SELECT shard_id, n_tokens, CAST(n_hits AS BIGINT) AS eval_overlap, n_hits = 0 AND a IS NULL AND b IS NULL AND c IS NULL AND d IS NULL AND e IS NULL AND f IS NULL AS admitted, concat_ws('; ', a, b, c, d, e, f, CASE WHEN n_hits > 0 THEN 'overlaps held-out items' END) AS reasons FROM fl JOIN ovl USING (shard_id))"""


def admission(manifest: DataFrame) -> DataFrame:
    """Every failed rule of each shard, in the order of the rules; none admits it."""
    rules = F.array(
        F.when(~F.col("license_tier").isin("A", "B"), F.concat(F.lit("licence tier "), F.col("license_tier"), F.lit(" not admitted"))), F.when(F.col("tokenizer_hash") != F.lit("tok"), "wrong tokenizer hash"), F.when(F.col("cleaning_hash").isNull(), "no cleaning hash"),
        F.when(F.col("dedup_status") != "pass", "dedup not passed"), F.when(F.col("lane").isNull(), "no lane"), F.when(F.col("content_hash").isNull(), "no content hash"),
        F.when(F.col("eval_overlap") > 0, "overlaps held-out items"),
    )
    failed = F.filter(rules, lambda x: x.isNotNull())
    return manifest.select("shard_id", "n_tokens", "eval_overlap", (F.size(failed) == 0).alias("admitted"), F.array_join(failed, "; ").alias("reasons"))


def gated(spark, sf, manifest: DataFrame | None = None, hits: DataFrame | None = None) -> DataFrame:
    h = F.conv(F.substring(F.sha2(F.col("shard_id").cast("binary"), 256), 1, 2), 16, 10).cast("int")
    docs = table(spark, sf, "documents")
    hits = (screen_containment(spark, sf) if hits is None else hits).select("doc_id").distinct()
    overlap = docs.select(shard_of().alias("shard_id"), "doc_id").join(hits, "doc_id", "left_semi").groupBy("shard_id").agg(F.count("*").alias("eval_overlap"))
    m = (manifests(docs) if manifest is None else manifest).join(overlap, "shard_id", "left").na.fill(0, ["eval_overlap"]).withColumn("h", h)
    return admission(
        m.select(
            "shard_id", "n_tokens", "eval_overlap", F.when(F.col("h") % 13 != 0, F.col("content_hash")).alias("content_hash"), F.element_at(F.array(*map(F.lit, "ABBD")), F.col("h") % 4 + 1).alias("license_tier"), F.when(F.col("h") % 5 == 0, "old").otherwise("tok").alias("tokenizer_hash"), F.when(F.col("h") % 9 != 0, "clean").alias("cleaning_hash"),
            F.when(F.col("h") % 6 == 0, "fail").otherwise("pass").alias("dedup_status"), F.when(F.col("h") % 17 != 0, "lane").alias("lane"),
        )
    )


@query("gate_admission", f"WITH {_GATE_SQL} SELECT * FROM gate")
def gate_admission(spark, sf):
    return gated(spark, sf)


@query("registry_events", f"""
WITH {_GATE_SQL} SELECT CAST(row_number() OVER (ORDER BY CAST(right(shard_id, 4) AS BIGINT), shard_id) - 1 AS BIGINT) AS event, shard_id, CASE WHEN admitted THEN 'admit' ELSE 'block' END AS kind, reasons AS detail FROM gate""")  # fmt: skip
def registry_events(spark, sf, manifest: DataFrame | None = None, hits: DataFrame | None = None):
    """The gate's log, in order: one event a shard."""
    log = gated(spark, sf, manifest, hits).withColumn("at", F.right(F.col("shard_id"), F.lit(4)).cast("long"))
    return numbered(log.withColumn("all", F.lit(0)), ["all"], ["at", "shard_id"], "n").select((F.col("n") - 1).alias("event"), "shard_id", F.when(F.col("admitted"), "admit").otherwise("block").alias("kind"), F.col("reasons").alias("detail"))


@query("gate_quarantine", f"""
WITH {_HITS}, s AS (SELECT {_SHARD} AS shard_id, doc_id, len({WORDS}) + 1 AS n FROM documents),
b AS (SELECT shard_id, count(*) AS n_before, count(hit.doc_id) AS removed, sum(CASE WHEN hit.doc_id IS NULL THEN n ELSE 0 END) AS n_tokens FROM s LEFT JOIN hit USING (doc_id) GROUP BY shard_id)
SELECT CASE WHEN removed > 0 THEN shard_id || '-r1' ELSE shard_id END AS shard_id, CASE WHEN removed > 0 THEN shard_id END AS parent_shard_id, CAST(removed AS BIGINT) AS removed, CAST(n_before - removed AS BIGINT) AS n_samples, CAST(n_tokens AS BIGINT) AS n_tokens FROM b WHERE n_before > removed""")  # fmt: skip
def gate_quarantine(spark, sf):
    """Shards with contaminated samples are rebuilt without them; the child names its parent. Stops when none is left."""
    rows = samples(table(spark, sf, "documents")).select("shard_id", "doc_id", "n_tokens").withColumn("parent_shard_id", F.lit(None).cast("string")).withColumn("removed", F.lit(0).cast("long"))
    bad = materialize(spark, screen_containment(spark, sf).select("doc_id").distinct().withColumn("bad", F.lit(True)), "held-out-hits")
    for turn in range(1, 6):
        marked = rows.join(bad, "doc_id", "left")
        if not marked.where("bad").limit(1).count():
            break
        hit = marked.groupBy("shard_id").agg(F.count_if("bad").alias("gone")).where("gone > 0")
        joined = marked.where("bad IS NULL").drop("bad").join(hit, "shard_id", "left")
        again = F.col("gone").isNotNull()
        rows = materialize(
            spark,
            joined.select(
                F.when(again, F.concat("shard_id", F.lit(f"-r{turn}"))).otherwise(F.col("shard_id")).alias("shard_id"), "doc_id", "n_tokens", F.when(again, F.col("shard_id")).otherwise(F.col("parent_shard_id")).alias("parent_shard_id"), F.when(again, F.col("gone")).otherwise(F.col("removed")).alias("removed")
            ),
            "rebuilt",
        )
    return rows.groupBy("shard_id", "parent_shard_id", "removed").agg(F.count("*").alias("n_samples"), F.sum("n_tokens").alias("n_tokens"))


@query("win_repack", f"""
WITH s AS (SELECT {_SHARD} AS shard_id, doc_id, len({WORDS}) + 1 AS n, row_number() OVER (PARTITION BY sha256(text) ORDER BY doc_id) = 1 AS kept FROM documents),
a AS (SELECT *, sum(n) OVER (PARTITION BY shard_id ORDER BY doc_id) - n AS old_start FROM s)
SELECT shard_id, doc_id, CAST(old_start AS BIGINT) AS old_start, CAST(sum(n) OVER (PARTITION BY shard_id ORDER BY doc_id) - n AS BIGINT) AS new_start, CAST(n AS BIGINT) AS n_tokens FROM a WHERE kept""")  # fmt: skip
def win_repack(spark, sf):
    """Offsets of a shard's samples before and after duplicates went; a shard has a bounded number of samples."""
    kept = dedup_exact(spark, sf).select("doc_id", "kept")
    w = Window.partitionBy("shard_id").orderBy("doc_id")
    rows = samples(table(spark, sf, "documents")).select("shard_id", "doc_id", "n_tokens").withColumn("old_start", F.sum("n_tokens").over(w) - F.col("n_tokens"))
    return rows.join(kept.where("kept"), "doc_id").select("shard_id", "doc_id", "old_start", (F.sum("n_tokens").over(w) - F.col("n_tokens")).alias("new_start"), "n_tokens")


@query("leak_check", f"""
WITH {_HITS}, c AS (SELECT DISTINCT doc_id FROM documents WHERE lang <> 'en')
SELECT 'held-out content in what was consumed' AS rule, CAST(count(*) AS BIGINT) AS violations FROM c SEMI JOIN hit USING (doc_id)
UNION ALL SELECT 'held-out ids in what was consumed', CAST(count(*) AS BIGINT) FROM c WHERE CAST(doc_id AS VARCHAR) IN (SELECT 'held-' || item_id FROM benchmark)""")  # fmt: skip
def leak_check(spark, sf):
    """Held-out items in what training consumed (here: all lanes but en), by content and by id."""
    used = table(spark, sf, "documents").where("lang <> 'en'").select("doc_id").distinct()
    content = used.join(screen_containment(spark, sf).select("doc_id").distinct(), "doc_id", "left_semi").agg(F.lit("held-out content in what was consumed").alias("rule"), F.count("*").alias("violations"))
    held = table(spark, sf, "benchmark").select(F.concat(F.lit("held-"), F.col("item_id")).alias("id"))
    ids = used.select(F.col("doc_id").cast("string").alias("id")).join(held, "id", "left_semi").agg(F.lit("held-out ids in what was consumed").alias("rule"), F.count("*").alias("violations"))
    return content.unionByName(ids)


@query("shard_lineage", f"""
WITH RECURSIVE {_MANIFEST}, e AS (SELECT shard_id, CASE WHEN CAST(right(shard_id, 4) AS INTEGER) % 3 > 0 THEN left(shard_id, length(shard_id) - 4) || lpad(CAST(CAST(right(shard_id, 4) AS INTEGER) - 1 AS VARCHAR), 4, '0') END AS parent FROM mf),
r AS (SELECT shard_id, shard_id AS root, 0 AS depth FROM e WHERE parent IS NULL OR parent NOT IN (SELECT shard_id FROM e) UNION ALL SELECT e.shard_id, r.root, r.depth + 1 FROM e JOIN r ON e.parent = r.shard_id)
SELECT shard_id, root, CAST(depth AS BIGINT) AS depth FROM r""")  # fmt: skip
def shard_lineage(spark, sf):
    """Each shard's first ancestor and how far it is, level by level over parent links."""
    n = F.right(F.col("shard_id"), F.lit(4)).cast("int")
    parent = F.when(n % 3 > 0, F.concat(F.expr("left(shard_id, length(shard_id) - 4)"), F.lpad((n - 1).cast("string"), 4, "0")))
    edges = materialize(spark, manifests(table(spark, sf, "documents")).select("shard_id", parent.alias("parent")), "lineage")
    at = edges.join(edges.select(F.col("shard_id").alias("parent")), "parent", "left_anti").select("shard_id", F.col("shard_id").alias("root"), F.lit(0).cast("long").alias("depth"))
    out, depth = at, 0
    while True:
        depth += 1
        at = materialize(spark, edges.join(at.select(F.col("shard_id").alias("parent"), "root"), "parent").select("shard_id", "root", F.lit(depth).cast("long").alias("depth")), "lineage")
        if not at.limit(1).count():
            return out
        out = out.unionByName(at)
