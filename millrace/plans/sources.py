"""Queries of sources and sinks: cached pages, mappers, lane files, shards with an index, ledgers, records of runs."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from millrace.functions import text as T
from millrace.operators.ordered import prefix_sums
from millrace.plans.curriculum import SUPPLY, rows_sql, values
from millrace.plans.text import TRIM, WORDS
from millrace.registry import query
from millrace.session import importable, materialize, shared_dir, table
from millrace.sources import mappers, pages
from millrace.sources.ledger import Ledger

PAGE = 100


def scratch(spark, name: str) -> str:
    return f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex[:12]}"


@query("src_cached_pages", f"""
SELECT doc_id, CAST(doc_id // {PAGE} * {PAGE} AS BIGINT) AS "offset", lang, CAST(length(text) AS BIGINT) AS chars, sha256(text) AS digest FROM documents""")  # fmt: skip
def src_cached_pages(spark, sf):
    """Documents through the page cache: one JSON page for 100 ids, read back row by row.

    A page that is asked for again isn't fetched again; here the source is the table itself, as there is no network.
    """
    importable(spark)
    docs = table(spark, sf, "documents").select("doc_id", "text", "lang")
    path = scratch(spark, "page-cache")
    page = docs.groupBy((F.floor(F.col("doc_id") / PAGE) * PAGE).cast("long").alias("offset")).agg(F.to_json(F.struct(F.collect_list(F.struct(F.struct("doc_id", "text", "lang").alias("row"))).alias("rows"))).alias("page"))
    page.write.partitionBy("offset").text(path)
    rows = pages.rows(spark, path, "doc_id bigint, text string, lang string")
    return rows.select("doc_id", "offset", "lang", F.char_length("text").cast("long").alias("chars"), F.sha2(F.col("text").cast("binary"), 256).alias("digest"))


_NORMAL = r"""trim(array_to_string(list_transform(string_split(regexp_replace(regexp_replace(regexp_replace(translate(nfc_normalize(text), chr(8203) || chr(65279) || chr(8206) || chr(8207) || chr(8234) || chr(8235) || chr(8236) || chr(8237) || chr(8238) || chr(173) || chr(65533), ''), '[\x00-\x08\x0b\x0c\x0e-\x1f\x7f]', '', 'g'), '[ \t\x{00A0}\x{2000}-\x{200A}\x{3000}]+', ' ', 'g'), '\n{3,}', chr(10) || chr(10), 'g'), chr(10)), lambda x: trim(x, ' ' || chr(9) || chr(13))), chr(10)), ' ' || chr(9) || chr(10) || chr(13))"""
_PAIRS = f"""pr AS (SELECT conv_id, turn, {TRIM.format("text")} AS q, lead({TRIM.format("text")}) OVER w AS a, role, lead(role) OVER w AS next_role FROM conversations WINDOW w AS (PARTITION BY conv_id ORDER BY turn))"""


@query("src_map_documents", f"""WITH {_PAIRS},
d AS (SELECT 'doc:' || doc_id AS row_id, CASE WHEN lang = 'en' THEN 'web' ELSE 'indic' END AS lane, 'pretrain' AS kind, 1 AS n_segments, left({_NORMAL}, {mappers.MOST}) AS t FROM documents
UNION ALL SELECT 'page:' || page_id, 'code', 'pretrain', 1, left(html, {mappers.MOST}) FROM pages
UNION ALL SELECT 'turns:' || left(sha256(q), 12), CASE WHEN length(a) >= {mappers.BAND} THEN 'reasoning' ELSE 'stem' END, 'sft', 2, 'Problem: ' || left(q, {mappers.MOST // 2}) || 'Solution: ' || left(a, {mappers.MOST}) FROM pr WHERE role = 'user' AND next_role = 'assistant' AND q <> '' AND a <> ''
UNION ALL SELECT 'talk:' || conv_id, 'agentic', 'agentic', CAST(count(*) AS INTEGER), string_agg(left({TRIM.format("text")}, {mappers.MOST // 2}), '' ORDER BY turn) FROM conversations WHERE {TRIM.format("text")} <> '' AND role IN ('system', 'human', 'user', 'tool', 'gpt', 'assistant') GROUP BY conv_id HAVING count_if(role IN ('assistant', 'gpt')) > 0)
SELECT row_id, lane, kind, n_segments, CAST(length(t) AS BIGINT) AS chars, sha256(t) AS digest FROM d WHERE length(t) >= {mappers.STUB}""")  # fmt: skip
def src_map_documents(spark, sf):
    """All mappers: prose normalised, pages as code, question and answer turns as solved problems, whole conversations; stubs dropped."""
    docs = table(spark, sf, "documents").where("text IS NOT NULL")
    turns = table(spark, sf, "conversations")
    whole = turns.groupBy("conv_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("turn", "role", "text"))), lambda t: F.struct(t["role"].alias("from"), t["text"].alias("value"))).alias("turns"))
    asked = whole.select("conv_id", F.posexplode("turns").alias("i", "t"), "turns").select("conv_id", "t", F.get("turns", F.col("i") + 1).alias("n")).where("t.`from` = 'user' AND n.`from` = 'assistant'").select(F.col("t.value").alias("problem"), F.col("n.value").alias("solution"))
    rows = mappers.plain(docs, F.concat(F.lit("doc:"), F.col("doc_id")), F.when(F.col("lang") == "en", "web").otherwise("indic"))
    rows = rows.unionByName(mappers.code(table(spark, sf, "pages"), F.concat(F.lit("page:"), F.col("page_id")), "html"))
    rows = rows.unionByName(mappers.solved(asked, F.lit("turns"), "problem", "solution")).unionByName(mappers.talks(whole, F.concat(F.lit("talk:"), F.col("conv_id")), "turns"))
    joined = F.array_join(F.transform("segments", lambda s: s["text"]), "")
    return mappers.kept(rows).select("row_id", "lane", "kind", F.size("segments").alias("n_segments"), "chars", F.sha2(joined.cast("binary"), 256).alias("digest"))


@query("src_local_lanes", f"""WITH {_PAIRS}, r AS (SELECT 'indic' AS lane, {_NORMAL} AS t FROM documents WHERE lang <> 'en' UNION ALL SELECT 'math', 'Problem: ' || q || chr(10) || chr(10) || 'Solution: ' || a FROM pr WHERE role = 'user' AND next_role = 'assistant' AND q <> '' AND a <> '' UNION ALL SELECT 'code', left(html, {mappers.CODE_MOST}) FROM pages)
SELECT lane, CAST(count(*) AS BIGINT) AS docs, CAST(sum(length(t)) AS BIGINT) AS chars, CAST(sum(octet_length(encode(t))) AS BIGINT) AS bytes, CAST(sum(CAST(('0x' || left(sha256(t), 8)) AS BIGINT)) AS BIGINT) AS digest_sum FROM r WHERE t <> '' GROUP BY lane""")  # fmt: skip
def src_local_lanes(spark, sf):
    """Lanes from local files: prose cleaned, problems formatted, code capped; one column of each file is read."""
    docs = T.with_normal(table(spark, sf, "documents").where("lang <> 'en'").select("text")).select(F.lit("indic").alias("lane"), "t")
    turns = table(spark, sf, "conversations").groupBy("conv_id").agg(F.array_sort(F.collect_list(F.struct("turn", "role", "text"))).alias("turns"))
    asked = turns.select(F.posexplode("turns").alias("i", "q"), "turns").select("q", F.get("turns", F.col("i") + 1).alias("a")).where("q.role = 'user' AND a.role = 'assistant'").select(T.strip(F.col("q.text")).alias("q"), T.strip(F.col("a.text")).alias("a")).where("q <> '' AND a <> ''")
    math = asked.select(F.lit("math").alias("lane"), F.concat(F.lit("Problem: "), "q", F.lit("\n\nSolution: "), "a").alias("t"))
    code = table(spark, sf, "pages").select(F.lit("code").alias("lane"), F.substring("html", 1, mappers.CODE_MOST).alias("t"))
    rows = docs.unionByName(math).unionByName(code).where("t <> ''")
    return rows.groupBy("lane").agg(F.count("*").alias("docs"), F.sum(F.char_length("t").cast("long")).alias("chars"), F.sum(F.octet_length("t").cast("long")).alias("bytes"), F.sum(F.conv(F.substring(F.sha2(F.col("t").cast("binary"), 256), 1, 8), 16, 10).cast("long")).alias("digest_sum"))


#: Between documents of a lane file; texts don't hold it.
MARK = "\x1e"


@query("src_lane_files", """
SELECT lang, CAST(count(*) AS BIGINT) AS docs, CAST(sum(length(replace(text, chr(30), ''))) AS BIGINT) AS chars, CAST(sum(CAST(('0x' || left(sha256(replace(text, chr(30), '')), 8)) AS BIGINT)) AS BIGINT) AS digest_sum FROM documents GROUP BY lang""")
def src_lane_files(spark, sf):
    """Flat text files, a folder a lane, with a mark between documents so that none is split again; counted from what was written."""
    path = scratch(spark, "lane-files")
    table(spark, sf, "documents").select(F.translate("text", MARK, "").alias("value"), "lang").write.partitionBy("lang").option("lineSep", MARK).text(path)
    back = spark.read.schema("value string, lang string").option("lineSep", MARK).text(path)
    return back.groupBy("lang").agg(F.count("*").alias("docs"), F.sum(F.char_length("value").cast("long")).alias("chars"), F.sum(F.conv(F.substring(F.sha2(F.col("value").cast("binary"), 256), 1, 8), 16, 10).cast("long")).alias("digest_sum"))


_SHARD_ID = "lang || '-' || lpad(CAST(doc_id // 500 AS VARCHAR), 6, '0')"


@query("src_shard_index", f"""
WITH d AS (SELECT {_SHARD_ID} AS shard_id, doc_id, len({WORDS}) AS n, sha256(array_to_string({WORDS}, ',')) AS h FROM documents)
SELECT shard_id, doc_id, CAST(sum(n) OVER w - n AS BIGINT) AS "start", CAST(sum(n) OVER w AS BIGINT) AS "end", h AS content_hash FROM d WINDOW w AS (PARTITION BY shard_id ORDER BY doc_id)""")  # fmt: skip
def src_shard_index(spark, sf):
    """A written shard's index: where each sample starts and ends, and its hash, from the files."""
    shard = F.concat_ws("-", "lang", F.lpad(F.floor(F.col("doc_id") / 500).cast("string"), 6, "0"))
    docs = table(spark, sf, "documents").select("doc_id", shard.alias("shard_id"), T.words("text").alias("tokens"))
    written = materialize(spark, docs, "shards", partition_by="shard_id")
    rows = written.select("shard_id", "doc_id", F.size("tokens").cast("long").alias("n"), T.digest(F.col("tokens")).alias("content_hash"))
    placed = prefix_sums(rows, ["shard_id"], ["doc_id"], {"start": F.col("n")})
    return placed.select("shard_id", "doc_id", "start", (F.col("start") + F.col("n")).alias("end"), "content_hash")


@query("ledger_append", """
WITH r AS (SELECT event_type AS branch, event_id, value, row_number() OVER (PARTITION BY event_type ORDER BY event_id % 2, event_id) - 1 AS o FROM events WHERE event_type IN ('click', 'purchase'))
SELECT branch, CAST(o AS BIGINT) AS ledger_offset, event_id, value FROM r WHERE o >= 10 AND (branch = 'purchase' OR o < 250)""")
def ledger_append(spark, sf):
    """Two appends to each of two branches: even records first, then odd ones; a range of one branch and the rest of the other are read."""
    events = table(spark, sf, "events").select("event_id", "value", "event_type")
    ledger = Ledger(spark, scratch(spark, "ledger"), "event_id long, value double")
    for half in (0, 1):
        for branch in ("click", "purchase"):
            ledger.append(branch, events.where((F.col("event_type") == branch) & (F.col("event_id") % 2 == half)), ["event_id"])
    click, purchase = ledger.read_range("click", 10, 250), ledger.read_from("purchase", 10)
    return click.withColumn("branch", F.lit("click")).unionByName(purchase.withColumn("branch", F.lit("purchase")))


_RUNS = (("spread", 24, 0.13, 1.0093, 1.21), ("held", 24, 0.13, 1.0150, 1.19), ("no floor", 32, 0.0, 1.6159, 1.17))


@query("src_run_records", f"""
WITH r AS (SELECT * FROM {rows_sql(_RUNS, 'run, batch, share, indic, web')})
SELECT run, CAST(batch AS BIGINT) AS batch, 'indic' AS lane, indic AS bits_a_byte, round(share, 6) AS share FROM r UNION ALL SELECT run, CAST(batch AS BIGINT), 'web', web, round(share, 6) FROM r""")  # fmt: skip
def src_run_records(spark, sf):
    """Records of runs as JSON documents: arguments and a map of lanes' results, unfolded to one row a lane."""
    path = scratch(spark, "runs")
    rows = values(spark, _RUNS, "name string, batch long, share double, indic double, web double")
    rows.select("name", F.struct("batch", "share").alias("args"), F.create_map(F.lit("indic"), F.struct(F.col("indic").alias("bpb")), F.lit("web"), F.struct(F.col("web").alias("bpb"))).alias("final_eval")).write.json(path)
    back = spark.read.schema("name string, args struct<batch: bigint, share: double>, final_eval map<string, struct<bpb: double>>").json(path)
    return back.select(F.col("name").alias("run"), F.col("args.batch").alias("batch"), F.explode("final_eval").alias("lane", "e"), F.round("args.share", 6).alias("share")).select("run", "batch", "lane", F.col("e.bpb").alias("bits_a_byte"), "share")


@query("src_inventory", f"""SELECT lane, round(sum(natural_b), 3) AS natural_b, round(sum(synthetic_b), 3) AS synthetic_b, round(sum(further_b), 3) AS further_b FROM {rows_sql(SUPPLY, 'lane, natural_b, synthetic_b, further_b')} GROUP BY lane""")
def src_inventory(spark, sf):
    """The inventory of supply as a JSON file, loaded again."""
    path = scratch(spark, "inventory")
    values(spark, SUPPLY, "lane string, natural_b double, synthetic_b double, further_b double").write.json(path)
    return spark.read.schema("lane string, natural_b double, synthetic_b double, further_b double").json(path).select("lane", *[F.round(c, 3).alias(c) for c in ("natural_b", "synthetic_b", "further_b")])
