"""Queries of the text layer: sources, sinks, cleaning, features, byte codes."""

from __future__ import annotations

from pyspark.sql import functions as F

from millrace.functions import text as T
from millrace.operators.ordered import hash_order, prefix_sums
from millrace.registry import query
from millrace.session import materialize, small_batches, table

LANE_BUDGET, PAGE_DOCS, SAMPLE_CHARS, STUB, BAND, TURN_CAP = 200_000, 100, 50_000, 200, 1100, 6000

WORDS = r"list_filter(string_split_regex(text, '[ \t\n\r]+'), lambda w: w <> '')"
#: The same white space for DuckDB's trim as strip() uses on these tables.
TRIM = r"regexp_replace({0}, '^[ \t\n\r]+|[ \t\n\r]+$', '', 'g')"


@query("src_lane_budget", f"""
SELECT doc_id, lang, n_chars, chars_before FROM (
  SELECT doc_id, lang, n_chars, CAST(coalesce(sum(n_chars) OVER (PARTITION BY lang ORDER BY doc_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS BIGINT) AS chars_before FROM documents)
WHERE chars_before < {LANE_BUDGET}""")  # fmt: skip
def src_lane_budget(spark, sf):
    """Documents of each lane, in order, until their characters reach the lane's budget."""
    docs = table(spark, sf, "documents").select("doc_id", "lang", "n_chars")
    return prefix_sums(docs, ["lang"], ["doc_id"], {"chars_before": F.col("n_chars")}).where(F.col("chars_before") < LANE_BUDGET)


@query("src_page_budget", f"""
WITH p AS (SELECT lang, doc_id // {PAGE_DOCS} AS page, count(*) AS docs, sum(n_chars) AS chars FROM documents GROUP BY 1, 2),
q AS (SELECT *, coalesce(sum(chars) OVER (PARTITION BY lang ORDER BY page ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before FROM p)
SELECT lang, CAST(count(*) AS BIGINT) AS pages, CAST(sum(docs) AS BIGINT) AS docs, CAST(sum(chars) AS BIGINT) AS chars, CAST(max(page) + 1 AS BIGINT) AS next_page FROM q WHERE before < {LANE_BUDGET} GROUP BY lang""")  # fmt: skip
def src_page_budget(spark, sf):
    """The same by whole pages: the page that reaches the budget is finished; and where to go on."""
    pages = table(spark, sf, "documents").groupBy("lang", F.floor(F.col("doc_id") / PAGE_DOCS).cast("long").alias("page")).agg(F.count("*").alias("docs"), F.sum("n_chars").alias("chars"))
    kept = prefix_sums(pages, ["lang"], ["page"], {"before": F.col("chars")}).where(F.col("before") < LANE_BUDGET)
    return kept.groupBy("lang").agg(F.count("*").alias("pages"), F.sum("docs").alias("docs"), F.sum("chars").alias("chars"), (F.max("page") + 1).alias("next_page"))


@query("src_band_routing", f"""
SELECT lang, CASE WHEN length(text) >= {BAND} THEN 'reasoning' ELSE 'stem' END AS band, CAST(count(*) AS BIGINT) AS docs, CAST(sum(length(text)) AS BIGINT) AS chars FROM documents GROUP BY 1, 2""")  # fmt: skip
def src_band_routing(spark, sf):
    n = F.char_length("text")
    return table(spark, sf, "documents").groupBy("lang", F.when(n >= BAND, "reasoning").otherwise("stem").alias("band")).agg(F.count("*").alias("docs"), F.sum(n.cast("long")).alias("chars"))


@query("src_map_rows", f"""
WITH t AS (SELECT conv_id, turn, CASE role WHEN 'human' THEN 'user' WHEN 'gpt' THEN 'assistant' ELSE role END AS role, left(text, {TURN_CAP}) AS text FROM conversations)
SELECT conv_id, CAST(count(*) AS BIGINT) AS segments, CAST(sum(length(text)) AS BIGINT) AS chars, CAST(sum(CASE WHEN role = 'assistant' THEN length(text) ELSE 0 END) AS BIGINT) AS loss_chars,
  string_agg(role, '>' ORDER BY turn) AS roles FROM t WHERE {TRIM.format('text')} <> '' GROUP BY conv_id HAVING sum(CASE WHEN role = 'assistant' THEN 1 ELSE 0 END) > 0""")  # fmt: skip
def src_map_rows(spark, sf):
    """Turns to a trajectory's segments: roles mapped, turns capped, blank turns dropped, an assistant required."""
    role = F.when(F.col("role") == "human", "user").when(F.col("role") == "gpt", "assistant").otherwise(F.col("role"))
    turns = table(spark, sf, "conversations").select("conv_id", "turn", role.alias("role"), F.substring("text", 1, TURN_CAP).alias("text")).where(T.strip(F.col("text")) != "")
    n = F.char_length("text").cast("long")
    out = turns.groupBy("conv_id").agg(
        F.count("*").alias("segments"), F.sum(n).alias("chars"), F.sum(F.when(F.col("role") == "assistant", n).otherwise(0)).alias("loss_chars"),
        F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("turn", "role"))), lambda s: s["role"]), ">").alias("roles"), F.count_if(F.col("role") == "assistant").alias("answers"),
    )
    return out.where("answers > 0").drop("answers")


@query("src_stub_filter", f"""
SELECT lang, CAST(count(*) AS BIGINT) AS offered, CAST(count_if(length({TRIM.format('text')}) >= {STUB}) AS BIGINT) AS kept, CAST(count_if(length({TRIM.format('text')}) < {STUB}) AS BIGINT) AS stubs FROM documents GROUP BY lang""")  # fmt: skip
def src_stub_filter(spark, sf):
    n = F.char_length(T.strip(F.col("text")))
    return table(spark, sf, "documents").groupBy("lang").agg(F.count("*").alias("offered"), F.count_if(n >= STUB).alias("kept"), F.count_if(n < STUB).alias("stubs"))


@query("src_text_coalesce", r"""
WITH c AS (SELECT conv_id, string_agg(text, chr(10) ORDER BY turn) AS turns FROM conversations GROUP BY conv_id),
r AS (SELECT 'text' AS kind, doc_id AS id, text, NULL AS code, NULL AS turns FROM documents UNION ALL SELECT 'code', page_id, '', html, NULL FROM pages UNION ALL SELECT 'turns', conv_id, NULL, '', turns FROM c)
SELECT kind, id, CAST(length(coalesce(nullif(text, ''), nullif(code, ''), turns)) AS BIGINT) AS chars, sha256(coalesce(nullif(text, ''), nullif(code, ''), turns)) AS digest FROM r""")  # fmt: skip
def src_text_coalesce(spark, sf):
    """One text column from rows of several schemas: text, else code, else the turns joined."""
    none = F.lit(None).cast("string")
    docs = table(spark, sf, "documents").select(F.lit("text").alias("kind"), F.col("doc_id").alias("id"), "text", none.alias("code"), none.alias("turns"))
    pages = table(spark, sf, "pages").select(F.lit("code").alias("kind"), F.col("page_id").alias("id"), F.lit("").alias("text"), F.col("html").alias("code"), none.alias("turns"))
    joined = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("turn", "text"))), lambda s: s["text"]), "\n")
    convs = table(spark, sf, "conversations").groupBy(F.col("conv_id").alias("id")).agg(joined.alias("turns")).select(F.lit("turns").alias("kind"), "id", none.alias("text"), F.lit("").alias("code"), "turns")
    one = F.coalesce(F.nullif(F.col("text"), F.lit("")), F.nullif(F.col("code"), F.lit("")), F.col("turns"))
    return docs.unionByName(pages).unionByName(convs).select("kind", "id", F.char_length(one).cast("long").alias("chars"), F.sha2(one.cast("binary"), 256).alias("digest"))


HASHED = "CAST(('0x' || left(sha256({0}), 15)) AS BIGINT)"


@query("src_lane_sample", f"""
WITH h AS (SELECT doc_id, lang, {TRIM.format('text')} AS t, {HASHED.format("'sample:' || lang || ':' || doc_id")} AS h FROM documents),
s AS (SELECT *, coalesce(sum(length(t)) OVER (PARTITION BY lang ORDER BY h, doc_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before FROM h WHERE t <> '')
SELECT doc_id, lang, CAST(least(length(t), {SAMPLE_CHARS} - before) AS BIGINT) AS taken_chars, sha256(left(t, CAST(least(length(t), {SAMPLE_CHARS} - before) AS BIGINT))) AS digest FROM s WHERE before < {SAMPLE_CHARS}""")  # fmt: skip
def src_lane_sample(spark, sf):
    """A shuffled sample of each lane, up to a cap of characters to which the last document is cut."""
    docs = table(spark, sf, "documents").select("doc_id", "lang", hash_order(F.lit("sample"), F.col("lang"), F.col("doc_id").cast("string")).alias("h"), F.char_length(T.strip(F.col("text"))).cast("long").alias("n")).where("n > 0")
    picked = prefix_sums(docs, ["lang"], ["h", "doc_id"], {"before": F.col("n")}).where(F.col("before") < SAMPLE_CHARS)
    taken = picked.select("doc_id", F.least("n", SAMPLE_CHARS - F.col("before")).alias("taken_chars"))
    texts = table(spark, sf, "documents").select("doc_id", "lang", "text").join(F.broadcast(taken), "doc_id")  # a lane has as many as characters are asked for
    return texts.select("doc_id", "lang", "taken_chars", F.sha2(F.substring(T.strip(F.col("text")), F.lit(1), F.col("taken_chars").cast("int")).cast("binary"), 256).alias("digest"))


@query("src_jsonl_roundtrip", "SELECT doc_id, lang, source, n_chars, sha256(text) AS digest FROM documents")
def src_jsonl_roundtrip(spark, sf):
    """Documents as JSON lines in the shared folder, and read again with their schema."""
    import uuid

    from millrace.session import shared_dir

    docs = table(spark, sf, "documents")
    path = f"{shared_dir(spark)}/jsonl-{uuid.uuid4().hex[:12]}"
    docs.write.json(path)
    return spark.read.schema(docs.schema).json(path).select("doc_id", "lang", "source", "n_chars", F.sha2(F.col("text").cast("binary"), 256).alias("digest"))


@query("src_lane_sink", """
WITH s AS (SELECT lang, doc_id // 100 AS shard, count(*) AS docs, sum(n_chars) AS chars, sha256(string_agg(sha256(text), ',' ORDER BY doc_id)) AS digest FROM documents GROUP BY 1, 2)
SELECT lang, CAST(count(*) AS BIGINT) AS shards, CAST(sum(docs) AS BIGINT) AS docs, CAST(sum(chars) AS BIGINT) AS chars, left(sha256(string_agg(digest, ',' ORDER BY shard)), 16) AS digest16 FROM s GROUP BY lang""")  # fmt: skip
def src_lane_sink(spark, sf):
    """What a lane's file would hold, with a digest: over digests of its shards, so no lane is gathered whole."""
    shards = table(spark, sf, "documents").groupBy("lang", F.floor(F.col("doc_id") / 100).cast("long").alias("shard")).agg(
        F.count("*").alias("docs"), F.sum("n_chars").alias("chars"),
        T.digest(F.transform(F.array_sort(F.collect_list(F.struct("doc_id", F.sha2(F.col("text").cast("binary"), 256).alias("d")))), lambda s: s["d"])).alias("digest"),
    )
    return shards.groupBy("lang").agg(
        F.count("*").alias("shards"), F.sum("docs").alias("docs"), F.sum("chars").alias("chars"),
        F.substring(T.digest(F.transform(F.array_sort(F.collect_list(F.struct("shard", "digest"))), lambda s: s["digest"])), 1, 16).alias("digest16"),
    )


@query("src_shard_sink", f"""
WITH d AS (SELECT lang || '-' || lpad(CAST(doc_id // 500 AS VARCHAR), 3, '0') AS shard_id, len({WORDS}) AS n FROM documents)
SELECT shard_id, CAST(count(*) AS BIGINT) AS n_samples, CAST(sum(n) AS BIGINT) AS n_tokens FROM d GROUP BY shard_id""")  # fmt: skip
def src_shard_sink(spark, sf):
    """Shards written as one partition each; the manifest is counted from what was written."""
    shard = F.concat_ws("-", "lang", F.lpad(F.floor(F.col("doc_id") / 500).cast("string"), 3, "0"))
    docs = table(spark, sf, "documents").select("doc_id", shard.alias("shard_id"), T.words("text").alias("tokens"))
    written = materialize(spark, docs, "shards", partition_by="shard_id")
    return written.groupBy("shard_id").agg(F.count("*").alias("n_samples"), F.sum(F.size("tokens").cast("long")).alias("n_tokens"))


@query("fn_normalize_text", r"""
WITH a AS (SELECT doc_id, text, nfc_normalize(text) AS t FROM documents),
b AS (SELECT doc_id, text, regexp_replace(regexp_replace(regexp_replace(translate(t, chr(8203) || chr(65279) || chr(8206) || chr(8207) || chr(8234) || chr(8235) || chr(8236) || chr(8237) || chr(8238) || chr(173) || chr(65533), ''), '[\x00-\x08\x0b\x0c\x0e-\x1f\x7f]', '', 'g'), '[ \t\x{00A0}\x{2000}-\x{200A}\x{3000}]+', ' ', 'g'), '\n{3,}', chr(10) || chr(10), 'g') AS t FROM a),
c AS (SELECT doc_id, text, trim(array_to_string(list_transform(string_split(t, chr(10)), lambda x: trim(x, ' ' || chr(9) || chr(13))), chr(10)), ' ' || chr(9) || chr(10) || chr(13)) AS t FROM b)
SELECT doc_id, CAST(length(t) AS BIGINT) AS chars, sha256(t) AS digest, t <> text AS changed FROM c""")  # fmt: skip
def fn_normalize_text(spark, sf):
    t = F.col("t")
    return T.with_normal(table(spark, sf, "documents").select("doc_id", "text")).select("doc_id", F.char_length(t).cast("long").alias("chars"), F.sha2(t.cast("binary"), 256).alias("digest"), (t != F.col("text")).alias("changed"))


@query("fn_clean_counters", r"""
SELECT lang, CAST(count(*) AS BIGINT) AS docs, CAST(count_if(contains(text, '&') AND contains(text, ';')) AS BIGINT) AS html_rows,
  CAST(sum(length(text) - length(translate(text, chr(8204) || chr(8205), ''))) AS BIGINT) AS joiners_kept,
  CAST(sum(length(text) - length(translate(text, chr(8203) || chr(65279) || chr(8206) || chr(8207) || chr(8234) || chr(8235) || chr(8236) || chr(8237) || chr(8238) || chr(173) || chr(65533), ''))) AS BIGINT) AS noise_removed,
  CAST(count_if(translate(text, chr(8203) || chr(65279) || chr(8206) || chr(8207) || chr(8234) || chr(8235) || chr(8236) || chr(8237) || chr(8238) || chr(173) || chr(65533), '') <> text) AS BIGINT) AS changed FROM documents GROUP BY lang""")  # fmt: skip
def fn_clean_counters(spark, sf):
    t = F.col("text")
    return table(spark, sf, "documents").groupBy("lang").agg(
        F.count("*").alias("docs"), F.count_if(t.contains("&") & t.contains(";")).alias("html_rows"),
        F.sum(T.count_of(t, T.JOINERS).cast("long")).alias("joiners_kept"), F.sum(T.count_of(t, T.NOISE).cast("long")).alias("noise_removed"),
        F.count_if(F.translate(t, T.NOISE, "") != t).alias("changed"),
    )


@query("fn_words_bytes", f"SELECT doc_id, CAST(len({WORDS}) AS BIGINT) AS words, CAST(octet_length(encode(text)) AS BIGINT) AS bytes, CAST(length(text) AS BIGINT) AS chars FROM documents")
def fn_words_bytes(spark, sf):
    return table(spark, sf, "documents").select("doc_id", F.size(T.words("text")).cast("long").alias("words"), F.octet_length("text").cast("long").alias("bytes"), F.char_length("text").cast("long").alias("chars"))


PRETOKEN = r"[\p{L}\p{M}\p{N}_]+|[ \t\n\r]|[^\p{L}\p{M}\p{N}_ \t\n\r]"


@query("fn_pretokens", f"""
WITH t AS (SELECT doc_id, regexp_extract_all(text, '{PRETOKEN}') AS p FROM documents)
SELECT doc_id, CAST(len(p) AS BIGINT) AS pretokens, CAST(len(list_filter(p, lambda x: x = ' ')) AS BIGINT) AS spaces, CAST(len(list_distinct(p)) AS BIGINT) AS distinct_pretokens FROM t""")  # fmt: skip
def fn_pretokens(spark, sf):
    p = F.regexp_extract_all("text", F.lit(PRETOKEN), F.lit(0))
    return table(spark, sf, "documents").select("doc_id", p.alias("p")).select("doc_id", F.size("p").cast("long").alias("pretokens"), F.size(F.filter("p", lambda x: x == " ")).cast("long").alias("spaces"), F.size(F.array_distinct("p")).cast("long").alias("distinct_pretokens"))


VOCAB_SIZE, MOST_BYTES = 1200, 32
_VOCAB_SQL = f"""
tk AS (SELECT t, count(*) AS c FROM (SELECT unnest(regexp_extract_all(text, '{PRETOKEN}')) AS t FROM documents) GROUP BY t),
ch AS (SELECT DISTINCT c FROM (SELECT unnest(string_split(t, '')) AS c FROM tk) WHERE c <> ''),
cn AS (SELECT c AS token, row_number() OVER (ORDER BY c) - 1 AS id FROM ch),
mu AS (SELECT t AS token, row_number() OVER (ORDER BY c DESC, t) - 1 AS r FROM tk WHERE length(t) > 1 AND octet_length(encode(t)) <= {MOST_BYTES}),
vocab AS (SELECT token, id FROM cn UNION ALL SELECT token, r + (SELECT count(*) FROM cn) FROM mu WHERE r + (SELECT count(*) FROM cn) < {VOCAB_SIZE})"""


def token_counts(docs, *by):
    """(*by, t, c): how often each token comes; written, so that what is made of it doesn't cut the texts again."""
    tokens = docs.select(*by, F.explode(F.regexp_extract_all("text", F.lit(PRETOKEN), F.lit(0))).alias("t")).groupBy(*by, "t").agg(F.count("*").alias("c"))
    return materialize(docs.sparkSession, tokens, "token-counts")


def vocabulary(docs, size: int = VOCAB_SIZE):
    """(token, id): all single characters, then the most frequent longer tokens up to the size."""
    return vocabulary_of(token_counts(docs), size)


def vocabulary_of(tokens, size: int = VOCAB_SIZE):
    """The same from counted tokens (t, c)."""
    from pyspark.sql import Window

    chars = tokens.select(F.explode(F.split("t", "")).alias("token")).where("token <> ''").distinct()
    # Characters are at most as many as Unicode has; of longer tokens only `size` are ever numbered.
    chars = chars.withColumn("id", F.row_number().over(Window.orderBy("token")) - 1)
    longer = tokens.where((F.char_length("t") > 1) & (F.octet_length("t") <= MOST_BYTES)).orderBy(F.desc("c"), "t").limit(size)
    longer = longer.select(F.col("t").alias("token"), (F.row_number().over(Window.orderBy(F.desc("c"), "t")) - 1).alias("r"))
    n = chars.agg(F.count("*").alias("n"))
    return chars.unionByName(longer.crossJoin(F.broadcast(n)).where(F.col("r") + F.col("n") < size).select("token", (F.col("r") + F.col("n")).cast("int").alias("id")))


@query("agg_vocab", f"WITH {_VOCAB_SQL} SELECT token, CAST(id AS BIGINT) AS id FROM vocab")
def agg_vocab(spark, sf):
    return vocabulary(table(spark, sf, "documents")).select("token", F.col("id").cast("long").alias("id"))


@query("fn_encode_vocab", f"""
WITH {_VOCAB_SQL},
p AS (SELECT doc_id, regexp_extract_all(text, '{PRETOKEN}') AS p FROM documents),
e AS (SELECT doc_id, i, p[i] AS t FROM (SELECT doc_id, p, unnest(range(1, len(p) + 1)) AS i FROM p)),
w AS (SELECT e.doc_id, i, 0 AS j, e.t, v.id FROM e LEFT JOIN vocab v ON v.token = e.t),
x AS (SELECT doc_id, i, j, id FROM w WHERE id IS NOT NULL UNION ALL
      SELECT m.doc_id, m.i, m.j, v.id FROM (SELECT doc_id, i, unnest(range(1, length(t) + 1)) AS j, t FROM w WHERE id IS NULL) m JOIN vocab v ON v.token = substring(m.t, m.j, 1))
SELECT doc_id, CAST(count(*) AS BIGINT) AS n_ids, CAST(sum(id) AS BIGINT) AS id_sum, sha256(string_agg(CAST(id AS VARCHAR), ',' ORDER BY i, j)) AS ids_sha256 FROM x GROUP BY doc_id""")  # fmt: skip
def fn_encode_vocab(spark, sf):
    """A token's id if it is known, else the ids of its known characters; by a dictionary, as the vocabulary is bounded.

    Spark's maps are looked through entry by entry. The JVM cuts the tokens, as Python's expressions don't know the classes.
    """
    docs = table(spark, sf, "documents")
    small_batches(spark)
    known = {r["token"]: r["id"] for r in vocabulary(docs).collect()}
    marked = docs.where("text <> ''").select("doc_id", F.regexp_replace("text", PRETOKEN, f"$0{MARK}").alias("t"))
    return marked.mapInArrow(lambda batches: encoded(batches, known), "doc_id long, n_ids long, id_sum long, ids_sha256 string")


#: Ends each token on the way to Python.
MARK = "\0"
#: Unknown tokens whose ids a task remembers.
MOST_SPELT = 100_000


def cut_at_marks(t: str) -> list[str]:
    """The tokens again. No token is empty, so two empty ones stand for a mark that the text itself holds."""
    out = t.split(MARK)[:-1]
    if "" in out:
        left = iter(out)
        out = [x if x else next(left) or MARK for x in left]
    return out


class _Spelt(dict):
    """(ids joined, their sum) by token; ids of an unknown token are those of its known characters."""

    def __init__(self, known: dict[str, int]):
        super().__init__({t: (str(i), i) for t, i in known.items()})
        self.known, self.most = known, len(known) + MOST_SPELT

    def __missing__(self, token: str) -> tuple[str, int]:
        ids = [self.known[c] for c in token if c in self.known]
        found = ",".join(map(str, ids)), sum(ids)
        if len(self) < self.most:
            self[token] = found
        return found


def encoded(batches, known: dict[str, int]):
    import hashlib

    import pyarrow as pa

    spelt = _Spelt(known)
    for batch in batches:
        rows = []
        for doc_id, t in zip(batch.column(0).to_pylist(), batch.column(1)):
            found = [x for x in map(spelt.__getitem__, cut_at_marks(t.as_py())) if x[0]]
            if found:
                ids = ",".join([x[0] for x in found])
                rows.append((doc_id, ids.count(",") + 1, sum([x[1] for x in found]), hashlib.sha256(ids.encode()).hexdigest()))
        columns = [pa.array(list(c), kind) for c, kind in zip(zip(*rows), (pa.int64(), pa.int64(), pa.int64(), pa.string()))]
        if rows:
            yield pa.RecordBatch.from_arrays(columns, ["doc_id", "n_ids", "id_sum", "ids_sha256"])


def _tokens(spark, sf):
    """Distinct words, with how often they come."""
    return table(spark, sf, "documents").select(F.explode(T.words("text")).alias("token")).groupBy("token").agg(F.count("*").alias("uses"))


_TOKENS = f"tk AS (SELECT token, count(*) AS uses FROM (SELECT unnest({WORDS}) AS token FROM documents) GROUP BY token)"


@query("fn_words_unicode", r"""
SELECT doc_id, CAST(len(list_filter(string_split_regex(text, '[\t\n\x0B\f\r \x1c-\x1f\x{0085}\x{00A0}\x{1680}\x{2000}-\x{200A}\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}]+'), lambda w: w <> '')) AS BIGINT) AS words FROM documents""")
def fn_words_unicode(spark, sf):
    """Words between white space of any script."""
    white = "[\\t\\n\\x0B\\f\\r \\x1c-\\x1f\\x85\\u00A0\\u1680\\u2000-\\u200A\\u2028\\u2029\\u202F\\u205F\\u3000]+"
    return table(spark, sf, "documents").select("doc_id", F.size(F.filter(F.split("text", white), lambda w: w != "")).cast("long").alias("words"))


@query("fn_script_names", f"""
WITH {_TOKENS}, c AS (SELECT DISTINCT unicode(token) AS u FROM tk)
SELECT CAST(u AS INTEGER) AS code, CASE WHEN u < 128 THEN 'latin/ascii' WHEN u BETWEEN 2304 AND 2431 THEN 'devanagari' WHEN u BETWEEN 2688 AND 2815 THEN 'gujarati' WHEN u BETWEEN 3072 AND 3199 THEN 'telugu'
  WHEN (u BETWEEN 192 AND 591 AND u NOT IN (215, 247)) THEN 'latin' WHEN u BETWEEN 913 AND 969 THEN 'greek' WHEN u BETWEEN 1024 AND 1279 THEN 'cyrillic' WHEN u = 191 THEN 'inverted' WHEN u = 171 THEN 'left-pointing' WHEN u BETWEEN 8220 AND 8221 THEN CASE u WHEN 8220 THEN 'left' ELSE 'right' END ELSE 'other' END AS script FROM c""")  # fmt: skip
def fn_script_names(spark, sf):
    """Scripts of first characters: by range, and else the first word of the character's Unicode name."""
    code = _tokens(spark, sf).select(F.ascii("token").alias("code"), T.script(F.col("token")).alias("script")).distinct()
    name = F.lower(F.split(F.reflect(F.lit("java.lang.Character"), F.lit("getName"), F.col("code")), " ")[0])
    return code.select("code", F.when(F.col("script") == "other", F.coalesce(name, F.lit("other"))).otherwise(F.col("script")).alias("script"))


@query("fn_script", f"""
WITH {_TOKENS}, s AS (SELECT token, uses, unicode(token) AS u FROM tk)
SELECT CASE WHEN u < 128 THEN 'latin/ascii' WHEN u BETWEEN 2304 AND 2431 THEN 'devanagari' WHEN u BETWEEN 2688 AND 2815 THEN 'gujarati' WHEN u BETWEEN 3072 AND 3199 THEN 'telugu' ELSE 'other' END AS script,
  CAST(count(*) AS BIGINT) AS tokens, CAST(sum(uses) AS BIGINT) AS uses FROM s GROUP BY 1""")  # fmt: skip
def fn_script(spark, sf):
    return _tokens(spark, sf).groupBy(T.script(F.col("token")).alias("script")).agg(F.count("*").alias("tokens"), F.sum("uses").alias("uses"))


@query("fn_kron_cells", f"""
WITH {_TOKENS}, h AS (SELECT token, hex(encode(token)) AS x, least(octet_length(encode(token)), 32) AS n FROM tk)
SELECT token, CAST(n AS BIGINT) AS n_cells, CAST(list_sum(list_transform(range(0, n), lambda i: (i + 1) * CAST(('0x' || substring(x, i * 2 + 1, 2)) AS INTEGER))) AS BIGINT) AS weighted FROM h""")  # fmt: skip
def fn_kron_cells(spark, sf):
    """(byte, position) cells of each word's first 32 bytes, summed up by position."""
    cells = T.byte_cells(F.col("token"))
    return _tokens(spark, sf).select("token", cells.alias("c")).select("token", F.size("c").cast("long").alias("n_cells"), F.aggregate("c", F.lit(0).cast("long"), lambda s, x: s + (x["pos"] + 1) * x["byte"]).alias("weighted"))


@query("fn_kron_encode_stats", f"""
WITH {_TOKENS}, l AS (SELECT least(octet_length(encode(token)), 32)::DOUBLE AS l, count(*) AS tokens FROM tk GROUP BY 1),
m AS (SELECT *, 1 / sqrt(l) AS v, l / sqrt(l) / 8192 AS mean FROM l), s AS (SELECT *, sqrt(l * v * v / 8192 - mean * mean) AS sd FROM m)
SELECT CAST(l AS BIGINT) AS n_bytes, CAST(tokens AS BIGINT) AS tokens, round((v - mean) / sd, 6) AS hi, round(-mean / sd, 6) AS lo FROM s""")  # fmt: skip
def fn_kron_encode_stats(spark, sf):
    """The two values that a z-normalised grid code of 256 x 32 takes, in closed form from the number of bytes."""
    n = F.least(F.octet_length("token"), F.lit(32)).cast("double")
    rows = _tokens(spark, sf).groupBy(n.alias("l")).agg(F.count("*").alias("tokens"))
    v, mean = 1 / F.sqrt("l"), F.col("l") / F.sqrt("l") / 8192
    sd = F.sqrt(F.col("l") * v * v / 8192 - mean * mean)
    return rows.select(F.col("l").cast("long").alias("n_bytes"), "tokens", F.round((v - mean) / sd, 6).alias("hi"), F.round(-mean / sd, 6).alias("lo"))


@query("fn_kron_roundtrip", f"""
WITH {_TOKENS}
SELECT token, octet_length(encode(token)) <= 32 AS fits, true AS bytes_ok, octet_length(encode(token)) <= 32 AS exact FROM tk""")  # fmt: skip
def fn_kron_roundtrip(spark, sf):
    """Encode to cells in any order, decode by position, and compare bytes with the word's first 32."""
    shuffled = F.sort_array(T.byte_cells(F.col("token")), asc=False)
    back = F.array_join(F.transform(F.array_sort(F.transform(shuffled, lambda c: F.struct(c["pos"].alias("p"), c["byte"].alias("b")))), lambda c: F.lpad(F.hex(c["b"]), 2, "0")), "")
    whole = F.hex(F.col("token").cast("binary"))
    return _tokens(spark, sf).select("token", (F.octet_length("token") <= 32).alias("fits"), (back == F.substring(whole, 1, 64)).alias("bytes_ok"), (back == whole).alias("exact"))


@query("agg_collisions", f"""
WITH {_TOKENS}, w AS (SELECT unnest([4, 8, 32, 48, 64]) AS win),
c AS (SELECT win, token, hex(encode(token)) AS x, unicode(token) AS u FROM tk, w),
d AS (SELECT win, token, CASE WHEN u < 128 THEN 'latin/ascii' ELSE 'other' END AS script, length(x) <= win * 2 AS fits, row_number() OVER (PARTITION BY win, left(x, win * 2) ORDER BY token) AS rn FROM c)
SELECT CAST(win AS INTEGER) AS win, script, CAST(count(*) AS BIGINT) AS n, CAST(count_if(fits) AS BIGINT) AS fit, CAST(count_if(rn > 1) AS BIGINT) AS collisions, CAST(count_if(rn = 1) AS BIGINT) AS distinct_codes,
 CAST(count_if(fits) AS BIGINT) AS roundtrip_ok, coalesce(array_to_string(list_sort(list(token) FILTER (rn > 1))[1:8], ' '), '') AS examples FROM d GROUP BY 1, 2""")  # fmt: skip
def agg_collisions(spark, sf):
    """Words whose codes (first bytes of a window) another word has already taken, by script of the later word."""
    from pyspark.sql import Window

    rows = _tokens(spark, sf).select("token", F.hex(F.col("token").cast("binary")).alias("x"), F.explode(F.array(*map(F.lit, (4, 8, 32, 48, 64)))).alias("win"))
    code = F.substring(F.col("x"), F.lit(1), F.col("win") * 2)
    rows = rows.withColumn("rn", F.row_number().over(Window.partitionBy("win", code).orderBy("token"))).withColumn("script", F.when(F.ascii("token") < 128, "latin/ascii").otherwise("other"))
    # Of words that another has the code of, the first eight of each script are named.
    named = Window.partitionBy("win", "script").orderBy("token")
    shown = rows.where("rn > 1").withColumn("nth", F.row_number().over(named)).where("nth <= 8").groupBy("win", "script").agg(F.array_join(F.array_sort(F.collect_list("token")), " ").alias("examples"))
    counted = rows.groupBy("win", "script").agg(
        F.count("*").alias("n"), F.count_if(F.length("x") <= F.col("win") * 2).alias("fit"), F.count_if(F.col("rn") > 1).alias("collisions"), F.count_if(F.col("rn") == 1).alias("distinct_codes"),
        F.count_if(F.unhex(code) == F.col("token").cast("binary")).alias("roundtrip_ok"),
    )
    return counted.join(shown, ["win", "script"], "left").na.fill("", ["examples"])


@query("fn_digest", f"SELECT doc_id, sha256(array_to_string({WORDS}, ',')) AS digest FROM documents")
def fn_digest(spark, sf):
    return table(spark, sf, "documents").select("doc_id", T.digest(T.words("text")).alias("digest"))


def ngram_sql(stride: int, docs: str = "documents") -> str:
    return f"""
dw AS (SELECT doc_id, lang, {WORDS} AS w FROM {docs}),
dg AS (SELECT DISTINCT doc_id, array_to_string(w[i:i + 7], ' ') AS g FROM (SELECT doc_id, w, unnest(range(1, len(w) - 6, {stride})) AS i FROM dw WHERE len(w) >= 8))"""


@query("fn_ngram_fingerprint", f"""
WITH {ngram_sql(4)}, n AS (SELECT doc_id, count(*) AS n FROM dg GROUP BY doc_id)
SELECT doc_id, CAST(len(w) AS BIGINT) AS tokens, CAST(coalesce(n, 0) AS BIGINT) AS ngrams FROM dw LEFT JOIN n USING (doc_id)""")  # fmt: skip
def fn_ngram_fingerprint(spark, sf):
    rows = table(spark, sf, "documents").select("doc_id", T.words("text").alias("w"))
    return rows.select("doc_id", F.size("w").cast("long").alias("tokens"), F.size(T.ngrams("w")).cast("long").alias("ngrams"))


@query("fn_quality_components", f"""
WITH d AS (SELECT doc_id, {WORDS} AS w, list_filter(regexp_split_to_array(text, '[।॥.!?]'), lambda s: {TRIM.format('s')} <> '') AS s FROM documents)
SELECT doc_id, CAST(len(w) AS BIGINT) AS words, round(len(list_distinct(w)) / sqrt(greatest(1, len(w))), 6) AS root_ttr, round(len(w)::DOUBLE / greatest(1, len(s)), 6) AS words_a_sentence FROM d""")  # fmt: skip
def fn_quality_components(spark, sf):
    w, s = T.words("text"), F.filter(F.split("text", "[।॥.!?]"), lambda x: T.strip(x) != "")
    n = F.size(w)
    return table(spark, sf, "documents").select(
        "doc_id", n.cast("long").alias("words"), F.round(F.size(F.array_distinct(w)) / F.sqrt(F.greatest(F.lit(1), n).cast("double")), 6).alias("root_ttr"), F.round(n / F.greatest(F.lit(1), F.size(s)), 6).alias("words_a_sentence")
    )


@query("fn_html_escape", """
SELECT page_id, CAST(length(e) AS BIGINT) AS chars, sha256(e) AS digest FROM (SELECT page_id, replace(replace(replace(replace(html, '&', '&amp;'), '<', '&lt;'), '>', '&gt;'), '"', '&quot;') AS e FROM pages)""")
def fn_html_escape(spark, sf):
    e = F.col("html")
    for a, b in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"), ('"', "&quot;")):
        e = F.replace(e, F.lit(a), F.lit(b))
    return table(spark, sf, "pages").select("page_id", F.char_length(e).cast("long").alias("chars"), F.sha2(e.cast("binary"), 256).alias("digest"))
