"""The evidence bundle: named checks, each a comparison of two numbers that are made in different ways, as rows and as a report."""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from millrace.functions import tables
from millrace.functions import text as T
from millrace.plans import curriculum, hygiene, learning, ledgers, packing, steps, windows
from millrace.plans.packing import _ITEMS, LENGTH
from millrace.plans.text import WORDS
from millrace.registry import query
from millrace.session import importable, materialize, shared_dir, table

MOST_VALUE = 2_600
_W = f"len({WORDS})"

Pair = tuple[DataFrame, DataFrame]


def _n(df: DataFrame, value=None) -> DataFrame:
    return df.agg((F.count("*") if value is None else value).cast("long").alias("v"))


def _token_sums(spark, sf):
    """One row: words of all documents, and documents."""
    return table(spark, sf, "documents").agg(F.sum(F.size(T.words("text")).cast("long")).alias("n"), F.count("*").alias("docs"))


#: What checks of the bundle under way have in common, by table folder and function: written once.
_MADE: dict[tuple, DataFrame] = {}


def _once(spark, sf, make: Callable[..., DataFrame]) -> DataFrame:
    key = (sf, make.__module__, make.__name__)
    if key not in _MADE:
        _MADE[key] = materialize(spark, make(spark, sf), "evidence-part")
    return _MADE[key]


def _manifest(s, f):
    return _once(s, f, hygiene.agg_manifest)


def _hits(s, f):
    return _once(s, f, hygiene.screen_containment)


def _items(s, f):
    return _once(s, f, packing.items)


def _texts(spark, sf):
    """Distinct texts, by digests other than dedup's, so that no text is shuffled."""
    return table(spark, sf, "documents").select(F.md5(F.col("text").cast("binary")), F.xxhash64("text"), F.octet_length("text")).distinct()


#: Requirement, detail, the two sides here, and the common value in SQL. A side is one row with one number.
CHECKS: tuple[tuple[str, str, Callable[..., Pair], str], ...] = (
    ("every document is in one shard", "documents; samples of all manifests", lambda s, f: (_n(table(s, f, "documents")), _n(_manifest(s, f), F.sum("n_samples"))), "SELECT count(*) FROM documents"),
    ("shards hold all tokens", "words and an end of each document; tokens of all manifests", lambda s, f: (_n(_once(s, f, _token_sums), F.sum(F.col("n") + F.col("docs"))), _n(_manifest(s, f), F.sum("n_tokens"))), f"SELECT sum({_W} + 1) FROM documents"),
    ("dedup keeps one of each text", "distinct texts; documents that exact dedup keeps", lambda s, f: (_n(_texts(s, f)), _n(hygiene.dedup_exact(s, f).where("kept"))), "SELECT count(DISTINCT text) FROM documents"),
    ("dedup verdicts cover every row", "rows offered; rows with a verdict", lambda s, f: (_n(hygiene.with_copies(s, f)), _n(hygiene.dedup_greedy(s, f))), "SELECT count(*) + count_if(length(text) > 4000) FROM documents"),
    ("screening finds every planted item", "held-out items; controls found equal", lambda s, f: (_n(table(s, f, "benchmark")), _n(hygiene.screen_exact(s, f).where(F.col("doc_id").between(hygiene.EXACT_ID, hygiene.TAIL_ID - 1)))), "SELECT count(*) FROM benchmark"),
    ("no clean document holds an item", "none; clean documents that contain one", lambda s, f: (s.range(0).agg(F.count("*").alias("v")), _n(hygiene.screen_clean(s, f, _hits(s, f)).join(_hits(s, f), "doc_id", "left_semi"))), "SELECT count(*) FROM documents WHERE false"),
    ("the held-out index is complete", "held-out items; entries that are never trained on", lambda s, f: (_n(table(s, f, "benchmark")), _n(hygiene.gate_heldout_index(s, f).where("never_train"))), "SELECT count(*) FROM benchmark"),
    ("the gate judges every shard", "shards; decisions in its log", lambda s, f: (_n(_manifest(s, f)), _n(hygiene.registry_events(s, f, _manifest(s, f), _hits(s, f)))), "SELECT count(DISTINCT source || '/' || doc_id // 100) FROM documents"),
    ("tampered shards are caught", "entries that are right; shards that verify", lambda s, f: (_n(_manifest(s, f).where("conv(substring(sha2(concat('spoil:', shard_id), 256), 1, 4), 16, 10) % 7 <> 0 AND conv(substring(sha2(concat('spoil:', shard_id), 256), 1, 4), 16, 10) % 11 <> 0 AND conv(substring(sha2(concat('spoil:', shard_id), 256), 1, 4), 16, 10) % 13 <> 0")), _n(hygiene.verify_shards(s, f, _manifest(s, f)).where("verdict = 'ok'"))), "SELECT count(*) FROM (SELECT DISTINCT source || '-' || lpad(CAST(doc_id // 100 AS VARCHAR), 4, '0') AS i FROM documents) WHERE CAST(('0x' || left(sha256('spoil:' || i), 4)) AS BIGINT) % 7 <> 0 AND CAST(('0x' || left(sha256('spoil:' || i), 4)) AS BIGINT) % 11 <> 0 AND CAST(('0x' || left(sha256('spoil:' || i), 4)) AS BIGINT) % 13 <> 0"),
    ("stages follow each other", "tokens of the run; tokens of all stages", lambda s, f: (s.range(1).select(F.lit(curriculum.BUDGET).cast("long").alias("v")), _n(curriculum.schedule(s), F.sum(F.col("token_end") - F.col("token_start")))), f"SELECT {curriculum.BUDGET}"),
    ("quotas fill every step", "steps times sequences; quotas of all lanes", lambda s, f: (s.range(1).select(F.lit(curriculum.QUOTA_STEPS * curriculum.PER_STEP).cast("long").alias("v")), _n(curriculum.mix_quota(s, f), F.sum("quota"))), f"SELECT {curriculum.QUOTA_STEPS * curriculum.PER_STEP}"),
    ("every candidate is decided on", "candidates; first decisions", lambda s, f: (_n(curriculum.candidates(s, f)), _n(curriculum.sel_opus(s, f).where("NOT topup"))), f"SELECT count(*) FROM conversations WHERE {_W} > 0"),
    ("a stream that is cut loses nothing", "tokens of documents; tokens in windows", lambda s, f: (_n(_once(s, f, _token_sums), F.sum("n")), _n(packing.concat_chop(_items(s, f)), F.sum("occupied"))), f"SELECT sum({_W}) FROM documents"),
    ("packing places what it is given", "tokens of pieces; tokens in bins", lambda s, f: (_n(packing.pieces(_items(s, f)), F.sum("n")), _n(packing.packed(packing.pieces(_items(s, f)), "best_fit"), F.sum("tokens"))), f"WITH {_ITEMS}, c AS (SELECT n, unnest(range(0, n, {LENGTH})) AS off FROM it) SELECT sum(least({LENGTH}, n - off)) FROM c WHERE n <= {LENGTH} OR n - off >= 16"),
    ("windows break no rule", "none; violations of all rules", lambda s, f: (s.range(0).agg(F.count("*").alias("v")), _n(windows.pack_verify(s, f), F.sum("violations"))), "SELECT 0"),
    ("throughput can be counted again", "claims that are right; claims that the ledger bears out", lambda s, f: (s.range(1).agg(F.count("*").alias("v")), _n(learning.agg_reconstruction(s, f, _items(s, f)).where("ok"))), "SELECT 1"),
    ("the ledger has every record once", "events; records with an offset", lambda s, f: (_n(table(s, f, "events")), _n(ledgers.ledger_records(s, f).select("lane", "lane_offset").distinct())), "SELECT count(*) FROM events"),
    ("a resumed run goes on exactly", "records of the run; records that are the same", lambda s, f: (_n(_once(s, f, steps.stream_build).where(F.col("step") >= steps.CRASH // steps.EVERY * steps.EVERY)), _n(steps.resume_exact(s, f).where("run = 'resumed'"), F.sum(F.col("got") - F.col("differ")))), f"SELECT {(steps.STEPS - steps.CRASH // steps.EVERY * steps.EVERY) * 4}"),
    ("a replay gives the ledger again", "records replayed; records that are the same", lambda s, f: (_n(_once(s, f, steps.stream_build).where(F.col("step") >= steps.EVERY)), _n(steps.replay_compare(s, f), F.sum(F.col("got") - F.col("differ")))), f"SELECT {(steps.STEPS - steps.EVERY) * 4}"),
)


def bundle(spark, sf) -> DataFrame:
    """requirement, result, detail, left, right."""
    _MADE.clear()
    out = None
    for name, detail, sides, _ in CHECKS:
        a, b = sides(spark, sf)
        one = a.select(F.coalesce("v", F.lit(0)).cast("long").alias("left")).crossJoin(b.select(F.coalesce("v", F.lit(0)).cast("long").alias("right")))
        one = one.select(F.lit(name).alias("requirement"), F.when(F.col("left") == F.col("right"), "PASS").otherwise("FAIL").alias("result"), F.lit(detail).alias("detail"), "left", "right")
        out = one if out is None else out.unionByName(one)
    return out


_SIDES = " UNION ALL ".join(f"SELECT '{n}' AS requirement, '{d}' AS detail, CAST(({sql}) AS BIGINT) AS v" for n, d, _, sql in CHECKS)


def markdown(rows: list) -> str:
    """The report of a bundle: pipes are escaped, and values cut, so that a table stays a table."""
    cell = lambda x: str(x)[:MOST_VALUE].replace("|", "\\|").replace("\n", " ")
    failed = sum(r["result"] != "PASS" for r in rows)
    head = ["# Evidence", "", f"{len(rows)} checks, {failed} failed.", "", "| Requirement | Result | Compared | Values |", "|---|---|---|---|"]
    return "\n".join([*head, *(f"| {cell(r['requirement'])} | {r['result']} | {cell(r['detail'])} | {cell(r['left'])} and {cell(r['right'])} |" for r in rows)]) + "\n"


def report(checks: DataFrame) -> tuple[DataFrame, str]:
    """The bundle as a JSON table, read back, and the path of its Markdown text beside it."""
    spark = checks.sparkSession
    rows = materialize(spark, checks, "evidence")
    path = f"{shared_dir(spark)}/evidence-{uuid.uuid4().hex[:12]}"
    text = markdown(rows.orderBy("requirement").collect())  # one row a check
    spark.createDataFrame([(text,)], "value string").coalesce(1).write.text(f"{path}-md")
    rows.write.json(f"{path}-json")
    return spark.read.schema(rows.schema).json(f"{path}-json"), f"{path}-md"


@query("evidence_bundle", f"""SELECT requirement, 'PASS' AS result, detail, v AS "left", v AS "right" FROM ({_SIDES})""")
def evidence_bundle(spark, sf):
    """All checks, from the report that is written of them; each passes if its two sides are the same number."""
    return report(bundle(spark, sf))[0]


@query("udtf_chunks", f"WITH {_ITEMS}, c AS (SELECT doc_id, n, unnest(range(0, n, {LENGTH})) AS off FROM it) SELECT doc_id, CAST(off AS BIGINT) AS off, CAST(least({LENGTH}, n - off) AS BIGINT) AS size FROM c WHERE n <= {LENGTH} OR n - off >= 16")
def udtf_chunks(spark, sf):
    """Pieces of documents by the table function, called from SQL with the scalar ones."""
    importable(spark)
    tables.register(spark)
    table(spark, sf, "documents").createOrReplaceTempView("mr_documents")
    return spark.sql(f"SELECT doc_id, c.off, c.size FROM (SELECT doc_id, CAST(size(mr_words(text)) AS BIGINT) AS n FROM mr_documents) d, LATERAL mr_chunks(d.n, {LENGTH}, 16) c")


@query("udtf_windows", f"WITH {_ITEMS}, s AS (SELECT doc_id, n, sum(n) OVER (PARTITION BY lang ORDER BY doc_id) - n AS lo FROM it), m AS (SELECT doc_id, lo, n, unnest(range(CAST(lo // {LENGTH} AS BIGINT), CAST((lo + n - 1) // {LENGTH} + 1 AS BIGINT))) AS win FROM s) SELECT doc_id, CAST(win AS BIGINT) AS win, CAST(greatest(lo, win * {LENGTH}) AS BIGINT) AS lo, CAST(least(lo + n, (win + 1) * {LENGTH}) AS BIGINT) AS hi FROM m")
def udtf_windows(spark, sf):
    """The windows that each document lies in when its lane is cut as one stream."""
    from millrace.operators.ordered import prefix_sums

    importable(spark)
    tables.register(spark)
    prefix_sums(packing.items(spark, sf), ["lang"], ["doc_id"], {"at": F.col("n")}).createOrReplaceTempView("mr_placed")
    return spark.sql(f"SELECT doc_id, w.win, w.lo, w.hi FROM mr_placed p, LATERAL mr_windows(p.at, p.n, {LENGTH}) w")
