"""Secret scans: candidates by pattern, false positives removed by a random forest; on the JVM only.

A candidate is a run of at least 16 characters of keys, with or without digits; a word (between white space) has as
many candidates as it has such runs, as in minified JSON, CSV or a URL. Each has its own lead: what stands before
it in its word, from the last mark that ends a field (`FIELD`), or with the run before if no such mark is between
them (a long name before its value). A run behind the first that has a name of its own in the word leaves the
words before out; only a word's last run has the word behind.
The forest judges it by its length, transitions between kinds of characters (digits and letters, cases, vowels and
consonants), how much of it words of a dictionary cover, its own form (a URL, an address, an identifier of
a known form, a placeholder), the path of its place, and the two words before and the word behind. The dictionary is the whole
words of a public tokenizer's vocabulary, a file of fixed size whose path is a parameter. The path is a
column that the caller names, as tables call it differently.

The forest is fitted to a table of labelled findings (label, candidate, lead, before2, before1, after, path), a parameter;
`labelled_findings` makes a default one by rule, as the documents' tables hold none. Everything is DataFrame
functions and the DataFrame-based forest, whose table of findings is bounded by `FINDINGS`.

Nulls: a null or empty text has no candidates; a null id or path is kept as it is. Repeated rows each report their
findings. However long a text is, each of its runs is a candidate. Candidates are reported by place, length and digest, never by their characters. Other columns are
ignored. `at` numbers the words, so candidates of one word share it.
"""

from __future__ import annotations

import functools
import json
import re

from pyspark.ml import PipelineModel
from pyspark.ml.classification import RandomForestClassifier
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from millrace.llm.common import documents, materialize

FINDINGS, TREES, DEPTH, SEED = 6_000, 32, 9, 11
_KEY = r"[A-Za-z0-9_+/=.@:~\-]{16,}"
FIELD = r",;&?#|"
#: Letters that a dictionary word has at least.
LEAST_WORD = 4
_SECRET_WORDS = r"(token|secret|passw|pwd|api.?key|access.?key|\bkey\b|auth|bearer|credential|private)"
_PLAIN_WORDS = r"(commit|sha\d*|md5|checksum|hash|digest|etag|uuid|guid|build|version|order|card|phone|call|tel|iban|isbn|serial|invoice|revision|rev)"


def default_dictionary() -> str:
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


@functools.cache
def dictionary(path: str) -> str:
    """The vocabulary's whole words in lower case, as the list of an SQL IN (a hashed set on the JVM)."""
    with open(path) as f:
        names = json.load(f)["model"]["vocab"]
    whole = sorted(n[: -len("</w>")] for n in names if re.fullmatch(f"[a-z]{{{LEAST_WORD},}}</w>", n))
    return ",".join(f"'{w}'" for w in whole)


def candidates(docs: DataFrame, path: str | None = None) -> DataFrame:
    """doc_id, path, at (number of the word), candidate, lead, before2, before1, after; one row for each run."""
    words = F.split(F.coalesce(F.col("text"), F.lit("")), r"[\x20\x09-\x0D]+")
    place = F.col(path).cast("string") if path else F.lit(None).cast("string")
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), place.alias("path"), words.alias("w"))

    def fits(i: Column) -> Column:
        w = F.get("w", i)
        return (F.length(w) >= 16) & w.rlike(_KEY)

    rows = rows.select("doc_id", "path", "w", F.explode(F.filter(F.sequence(F.lit(0), F.size("w") - 1), fits)).alias("at"))
    near = lambda k: F.lower(F.coalesce(F.get("w", F.col("at") + k), F.lit("")))
    rows = rows.select("doc_id", "path", "at", F.get("w", F.col("at")).alias("word"), near(-2).alias("before2"), near(-1).alias("before1"), near(1).alias("after"))
    # Of run k: itself, what stands between it and the run before, and the run before; one more entry, without a run, ends a word.
    runs = F.regexp_extract_all("word", F.lit(f"({_KEY})"), 1)
    zipped = F.arrays_zip(runs.alias("candidate"), F.split("word", _KEY, -1).alias("between"), F.concat(F.array(F.lit("")), runs).alias("previous"))
    rows = rows.select("doc_id", "path", "at", "before2", "before1", "after", F.size(runs).alias("runs"), F.posexplode(zipped).alias("k", "run"))
    rows = rows.where("run.candidate IS NOT NULL").select("doc_id", "path", "at", "before2", "before1", "after", "runs", "k", "run.*")
    field = F.regexp_extract("between", f"([^{FIELD}]*)$", 1)
    lead = F.when((F.col("k") == 0), F.col("between")).when(field == F.col("between"), F.concat("previous", "between")).otherwise(field)
    rows = rows.withColumn("lead", F.lower(lead))
    named = (F.col("k") > 0) & (F.col("lead").rlike("[a-z=:]") | F.col("candidate").rlike("[=:][^=]"))
    before = lambda c: F.when(named, F.lit("")).otherwise(F.col(c)).alias(c)
    return rows.select("doc_id", "path", "at", "candidate", "lead", before("before2"), before("before1"), F.when(F.col("k") == F.col("runs") - 1, F.col("after")).otherwise(F.lit("")).alias("after"))


def features(found: DataFrame, words: str | None = None) -> tuple[DataFrame, list[str]]:
    """The forest's inputs beside the candidates. `words` is the file of the dictionary."""
    listed = dictionary(words or default_dictionary())
    # Lengths of the dictionary's words among the parts of letters as names are written: camelCase, UPPER, lower.
    parts = "regexp_extract_all(candidate, '[A-Z]?[a-z]+|[A-Z]+(?![a-z])', 0)"
    found = found.withColumn("known_parts", F.expr(f"transform({parts}, p -> if(lower(p) IN ({listed}), length(p), 0))"))
    covered, longest = F.aggregate("known_parts", F.lit(0), lambda t, x: t + x), F.coalesce(F.array_max("known_parts"), F.lit(0))
    place = F.lower(F.coalesce("path", F.lit("")))
    c = F.col("candidate")
    low = F.lower(c)
    n = F.greatest(F.length(c), F.lit(1))
    body = F.regexp_extract(c, r"([^=:]*)$", 1)  # what stands behind an inner = or :
    context = F.concat_ws(" ", "before2", "before1", "lead", F.regexp_extract(low, r"^(.*[=:])", 1))

    def count(pattern: str, of: Column = c) -> Column:
        return F.regexp_count(of, F.lit(pattern)).cast("double")

    columns = {
        "length": n.cast("double"),
        "digits": count(r"[0-9]") / n,
        "upper": count(r"[A-Z]") / n,
        "lower": count(r"[a-z]") / n,
        "marks": count(r"[^A-Za-z0-9]") / n,
        "changes": (count(r"(?<=[0-9])[A-Za-z]|(?<=[A-Za-z])[0-9]") + count(r"(?<=[a-z])[A-Z]|(?<=[A-Z])[a-z]")) / n,
        "kinds": F.size(F.array_distinct(F.split(c, ""))).cast("double") / n,
        "covered": covered / n,
        "longest_word": longest.cast("double"),
        "vowels": count(r"[aeiou]", low) / n,
        "vowel_changes": count(r"(?<=[aeiouy])[b-df-hj-np-tv-xz]|(?<=[b-df-hj-np-tv-xz])[aeiouy]", low) / n,
        "rare_letters": count(r"[jqxz]", low) / n,
        "test_path": place.rlike(r"(test|spec|fixture|mock|example|sample|demo|docs?/|readme|\.md$)").cast("double"),
        "settings_path": place.rlike(r"(\.env|config|settings|credential|secret|deploy|\.ya?ml$|\.ini$|\.properties$|\.tfvars$)").cast("double"),
        "hex": body.rlike(r"^[0-9A-Fa-f]{16,}$").cast("double"),
        "only_digits": c.rlike(r"^[0-9.+\-]+$").cast("double"),
        "uuid": low.rlike(r"[0-9a-f]{8}-[0-9a-f]{4}-[0-9a-f]{4}-").cast("double"),
        "path": (low.rlike(r"^(https?:|www\.|/)") | low.rlike(r"\.(com|org|net|html?|pdf|png|jpg|gz|zip|py|js|json|txt)\b")).cast("double"),
        "slashes": count(r"/"),
        "mail": c.contains("@").cast("double"),
        "known_form": c.rlike(r"(AKIA|ghp_|gho_|xox[bp]-|sk_live_|sk-|eyJ|AIza)").cast("double"),
        "placeholder": low.rlike(r"(example|sample|dummy|your|change.?me|placeholder|redacted|insert|replace|xxxx|0000|1234|test)").cast("double"),
        "secret_near": context.rlike(_SECRET_WORDS).cast("double"),
        "plain_near": context.rlike(_PLAIN_WORDS).cast("double"),
        "assigned": context.rlike(r"[=:]").cast("double"),
        "quoted": F.col("lead").rlike("[\"'`]").cast("double"),
        "plain_after": F.col("after").rlike(_PLAIN_WORDS).cast("double"),
    }
    return found.withColumns(columns).drop("known_parts"), list(columns)


def labelled_findings(spark: SparkSession, n: int = FINDINGS) -> DataFrame:
    """`n` findings made by rule: keys of several forms in their usual places, and what is taken for them."""
    i = F.col("id")
    hexed = F.sha2(i.cast("string"), 256)
    other = F.sha2(F.concat(F.lit("b"), i.cast("string")), 256)
    mixed = F.regexp_replace(F.base64(F.unhex(hexed)), "[+/=]", "")
    word = F.element_at(F.array(*[F.lit(w) for w in "the of and then in to is by a with der und la que los onto".split()]), (F.pmod(F.xxhash64("id"), F.lit(16)) + 1).cast("int"))
    pick = lambda salt, *of: F.element_at(F.array(*map(F.lit, of)), (F.pmod(F.xxhash64("id", F.lit(salt)), F.lit(len(of))) + 1).cast("int"))
    size = lambda lo, hi: (F.pmod(F.xxhash64("id", F.lit("n")), F.lit(hi - lo + 1)) + lo).cast("int")
    name = pick("name", "token", "api_key", "secret", "access_token", "password", "auth", "client_secret")
    sign = pick("sign", "=", ":", "=>")
    cut = lambda text, k: F.substring(text, F.lit(1), k)
    neutral, empty = F.concat(word, F.lit(".")), F.lit("")
    day = F.concat(F.lit("2024-"), F.lpad((F.pmod(i, F.lit(12)) + 1).cast("string"), 2, "0"))
    settings, trial, prose = pick("p1", ".env", "deploy/config.yml", "app/settings.ini", "src/main.py", ""), pick("p2", "tests/test_client.py", "docs/readme.md", "examples/demo.ini", "src/main.py", ""), pick("p3", "", "notes.txt", "src/main.py", "posts/page.html")
    letters = lambda text: F.translate(F.substring(text, F.lit(1), size(16, 32)), "0123456789", "ghijklmnop")
    syllables = ("ba", "ter", "in", "ung", "tion", "el", "ment", "sch", "ou", "re", "lich", "an", "ver", "ing", "os", "de")
    spoken = F.aggregate(F.sequence(F.lit(1), size(5, 8)), F.lit(""), lambda t, k: F.concat(t, F.element_at(F.array(*map(F.lit, syllables)), F.conv(F.substring(hexed, k, F.lit(1)), 16, 10).cast("int") + 1)))
    named = F.aggregate(F.sequence(F.lit(1), size(3, 5)), F.lit(""), lambda t, k: F.concat(t, F.initcap(F.element_at(F.array(*map(F.lit, ("user", "default", "server", "account", "list", "with", "name", "value", "event", "handler", "request", "number", "table", "report", "access", "token"))), F.conv(F.substring(other, k, F.lit(1)), 16, 10).cast("int") + 1))))
    # (label, before2, before1, lead, candidate, path)
    kinds = [
        (1, name, sign, F.lit('"'), cut(hexed, F.lit(40)), settings),
        (1, name, sign, F.lit('"'), cut(F.upper(hexed), size(32, 64)), settings),
        (1, name, sign, F.lit('"'), cut(mixed, size(20, 40)), settings),
        (1, word, name, empty, cut(mixed, size(20, 40)), settings),
        (1, neutral, word, empty, F.concat(name, pick("s2", "=", ":"), cut(mixed, size(16, 30))), settings),
        (1, word, F.lit("authorization: bearer"), empty, F.concat(F.lit("eyJ"), mixed, F.lit("."), cut(other, F.lit(30))), trial),
        (1, word, pick("w", "export", "use", "found"), empty, F.concat(pick("k", "AKIA", "ghp_", "sk_live_", "xoxb-", "AIza"), F.upper(cut(mixed, size(16, 36)))), prose),
        (0, word, pick("h", "commit", "sha1", "revision", "hash", "digest"), empty, cut(hexed, F.lit(40)), prose),
        (0, pick("h", "md5", "checksum", "etag"), sign, F.lit('"'), cut(hexed, F.lit(32)), prose),
        (0, word, pick("u", "uuid", "id", "record", "session"), empty, F.concat_ws("-", cut(hexed, F.lit(8)), F.substring(hexed, 9, 4), F.substring(hexed, 13, 4), F.substring(hexed, 17, 4), F.substring(hexed, 21, 12)), prose),
        (0, word, neutral, empty, F.concat(pick("p", "https://www.", "http://docs.", "/usr/lib/", "/home/user/"), cut(other, F.lit(6)), pick("t", ".example.com/page/", "/static/image/", ".org/index/"), cut(F.conv(F.substring(other, 1, 12), 16, 10), F.lit(4)), pick("e", ".html", ".png", ".pdf", "")), prose),
        (0, neutral, word, empty, cut(F.regexp_replace(F.concat(hexed, other), "[^0-9]", ""), size(16, 19)), prose),
        (0, word, neutral, empty, F.concat(word, F.lit("."), cut(F.regexp_replace(hexed, "[^0-9]", ""), F.lit(2)), F.lit("@mail"), F.pmod(i, F.lit(9)).cast("string"), F.lit(".example.com")), prose),
        (0, word, word, empty, F.concat(pick("f", "report-final-", "backup_archive_", "release-version-"), day, pick("x", ".tar.gz", ".zip", "-beta.2.json")), prose),
        (0, name, sign, F.lit('"'), pick("d", "your_api_key_0000", "example-token-12345", "changeme-password-1", "xxxxxxxxxxxxxxxx1234", "test_secret_00000001", "dummy-value-1234567"), trial),
        (0, neutral, word, F.lit('"'), F.concat(pick("c", "defaultServerConfig", "clientModuleVersion", "documentTableValue", "publicUserName"), F.pmod(i, F.lit(100)).cast("string")), prose),
        (0, word, neutral, empty, F.concat(pick("q", "+1-(555)-", "00-44-20-", "+49-30-"), cut(F.regexp_replace(hexed, "[^0-9]", ""), F.lit(10))), prose),
        (1, name, sign, F.lit('"'), letters(hexed), settings),
        (1, neutral, word, empty, F.concat(name, pick("s3", "=", ":"), letters(other)), prose),
        (1, word, name, F.lit('"'), F.translate(cut(mixed, size(16, 40)), "0123456789", "QzRkXwVbNj"), settings),
        (1, word, name, F.lit("'"), cut(mixed, size(20, 40)), trial),
        (0, neutral, word, empty, F.concat(spoken, pick("dot", "", ".", "")), prose),
        (0, word, word, empty, F.concat(F.initcap(spoken), pick("dot2", "", ".", "-")), prose),
        (0, word, name, empty, spoken, trial),
        (0, word, pick("fn", "def", "call", "new", "return", "import"), empty, F.concat(F.lower(F.substring(named, 1, 1)), F.substring(named, F.lit(2), F.lit(60))), settings),
        (0, name, sign, pick("q0", '"', ""), pick("ph", "your-api-key-goes-here", "replace_with_your_token", "changeme-please-change", "insert.secret.here.please", "sample-password-value", "REDACTED_BY_THE_EDITOR", "dummy-dummy-dummy-dummy", "placeholder-for-the-key"), pick("p4", "", "docs/readme.md", "deploy/config.yml")),
        (0, name, sign, empty, named, trial),
        (0, word, neutral, empty, F.lower(F.regexp_replace(named, "(?<=.)([A-Z])", pick("sep", "_", "-", "."))), prose),
        (0, word, word, empty, F.concat(F.lit("AWS_"), F.upper(F.regexp_replace(named, "(?<=.)([A-Z])", F.lit("_$1")))), settings),
        (0, word, neutral, empty, F.repeat(pick("rule", "=", "-", "_", "=-", "~"), F.lit(20)), prose),
    ]
    rows = spark.range(0, n, 1, 1).withColumn("kind", F.pmod(i, F.lit(len(kinds))))
    case = None
    for k, (label, b2, b1, lead, candidate, path) in enumerate(kinds):
        one = F.struct(F.lit(label).alias("label"), F.lower(b2).alias("before2"), F.lower(b1).alias("before1"), F.lower(lead).alias("lead"), candidate.alias("candidate"), word.alias("after"), path.alias("path"))
        case = F.when(F.col("kind") == k, one) if case is None else case.when(F.col("kind") == k, one)
    return rows.select("id", case.alias("f")).select("id", "f.*")


def fit(findings: DataFrame, words: str | None = None) -> PipelineModel:
    """A forest from (label, candidate, lead, before2, before1, after, path); of more than FINDINGS a hashed sample, the same in every run."""
    if "path" not in findings.columns:
        findings = findings.withColumn("path", F.lit(None).cast("string"))
    order = [F.xxhash64("candidate", "before1", "before2"), "candidate", "before1", "before2", "label"]
    table, names = features(findings.orderBy(*order).limit(FINDINGS).coalesce(1), words)
    table = materialize(findings.sparkSession, table.select("label", *names), "secrets-findings")  # the forest reads it several times
    assemble = VectorAssembler(inputCols=names, outputCol="features")
    forest = RandomForestClassifier(numTrees=TREES, maxDepth=DEPTH, seed=SEED, labelCol="label", featureSubsetStrategy="sqrt")
    return PipelineModel([assemble, forest.fit(assemble.transform(table.coalesce(1)))])


def scan(docs: DataFrame, findings: DataFrame | None = None, path: str | None = None, words: str | None = None) -> DataFrame:
    """doc_id, at, length, candidate_sha256, score, secret of every candidate of every row; `path` names the column of the place's path."""
    model = fit(labelled_findings(docs.sparkSession) if findings is None else findings, words)
    table, _ = features(candidates(docs, path), words)
    score = vector_to_array("probability")
    return model.transform(table).select(
        "doc_id", F.col("at").cast("long").alias("at"), F.length("candidate").cast("long").alias("length"), F.sha2(F.col("candidate").cast("binary"), 256).alias("candidate_sha256"),
        score[1].alias("score"), (score[1] >= 0.5).alias("secret"),
    )


def op8_secrets(spark, sf_dir: str) -> DataFrame:
    return scan(documents(spark, sf_dir), path="source")
