"""Secret scans: candidates from whole texts, a random forest to drop false positives. Native.

Candidates are runs of at least ``MIN_LENGTH`` signs ``[A-Za-z0-9_+/-]`` with a digit, a change of case
inside or capitals only, found in words (cut at white space), with up to three words before and two after. So are values of
six and more signs, whatever they are, that a credential's name and ``=`` or ``:`` stand before (less the signs
that end a clause), and keys that begin as known services' keys do.

Features: length; transitions between kinds of characters (lower, upper, digit, other) per character;
shares of digits and upper case; distinct characters; longest run of digits; dictionary coverage (share of
the characters in words of a small dictionary); neighbouring words that name credentials or that name
harmless identifiers; an assignment sign or a quote before it; a known key's beginning; the path's kind (tests and documentation,
configuration), here the source column.

The forest learns from labelled findings: a table (candidate, before, after, path, label) given by the
caller, at most ``TRAIN_ROWS`` rows of it by a hash, else ``labelled_findings``, which writes such findings
from rules: random keys and short passwords beside credential words and known services' keys anywhere, against digests, identifiers, numbers, placeholders and
words beside others. Results hold a digest and a mask of a candidate, never the candidate.

Null text has no candidates. Each repeated row gives its findings again; ties of score are not broken, as rows
stand by themselves. Null source is an empty path. Long texts are read whole; an empty table has no findings. Of
extra columns none is read.
"""

from __future__ import annotations

from pyspark.ml.classification import RandomForestClassifier
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

MIN_LENGTH = 16
TRAIN_ROWS = 20_000
TREES, DEPTH, SEED = 24, 7, 5
RUN = r"[A-Za-z0-9_+/\-]{16,}"
NAMED = r"(?i)(?:api[_-]?key|access[_-]?key|private[_-]?key|secret|passw(?:or)?d|passwd|pwd|token|authorization|cookie)[\"']?"
#: A sign put before each value; what stands before a value.
MARK = "\uE000"
VALUE = r"[^\s\"'" + MARK + "]{6,}"
ASSIGNED = "(" + NAMED + r"\s*[:=]\s*[\"']?|(?i:\b(?:bearer|basic))\s+)(?=" + VALUE + ")"
PREFIXED = r"\b(?:gh[pousr]_[A-Za-z0-9]{16,}|github_pat_[A-Za-z0-9_]{16,}|sk[-_][A-Za-z0-9_-]{16,}|xox[abps]-[A-Za-z0-9-]{10,}|A[KS]IA[A-Z0-9]{12,}|AIza[A-Za-z0-9_-]{20,}|eyJ[A-Za-z0-9_-]{10,}\.[A-Za-z0-9_-]{10,}\.[A-Za-z0-9_-]{10,})"
CREDENTIAL = r"(?i)(token|secret|passw|passwd|pwd|api[_\-]?key|apikey|auth|bearer|credential|private|access[_\-]?key|client[_\-]?key|\bkey\b)"
HARMLESS = r"(?i)(commit|sha\d*|md5|checksum|digest|fingerprint|hash|version|uuid|guid|\bid\b|etag|revision|build|card|phone|order|invoice|isbn|figure|page|licen[cs]e|see)"
DICTIONARY = [
    "account", "admin", "change", "config", "default", "dummy", "empty", "example", "fake", "file", "foobar", "here", "insert", "local", "name", "number", "password",
    "placeholder", "random", "replace", "sample", "secret", "server", "service", "string", "test", "that", "this", "token", "user", "value", "with", "xxxx", "your",
]
TEST_PATH = r"(?i)(test|spec|example|sample|doc|readme|fixture|mock)"
CONFIG_PATH = r"(?i)(\.env|config|settings|\.ya?ml|\.ini|\.toml|\.properties|secret)"


def candidates(docs: DataFrame) -> DataFrame:
    """``doc_id, path, word_index, candidate, before, after`` of all texts."""
    marked = F.regexp_replace(F.translate(F.col("text").cast("string"), MARK, "\uFFFD"), ASSIGNED, "$1" + MARK)
    rows = docs.where(F.col("text").isNotNull()).select("doc_id", F.coalesce(F.col("source").cast("string"), F.lit("")).alias("path"), F.split(marked, r"\s+").alias("_w"))
    worth = lambda w: (F.length(w) >= 6) & (w.rlike(RUN) | w.contains(MARK) | w.rlike(PREFIXED))
    numbered = F.transform("_w", lambda w, i: F.when(worth(w), i))
    rows = rows.withColumn("_i", F.filter(numbered, lambda i: i.isNotNull())).where(F.size("_i") > 0)
    context = lambda i: F.struct(
        i.alias("i"), F.get("_w", i).alias("word"),
        F.array_join(F.slice("_w", F.greatest(i - 3, F.lit(0)) + 1, F.least(i, F.lit(3))), " ").alias("left"), F.array_join(F.slice("_w", i + 2, 2), " ").alias("right"),
    )
    rows = rows.select("doc_id", "path", F.explode(F.transform("_i", context)).alias("x")).select("doc_id", "path", "x.*")
    mixed = lambda c: c.rlike("[0-9]") | c.rlike("[a-z][A-Z]+[a-z]") | c.rlike("^[A-Z]+$")
    values = F.transform(F.regexp_extract_all("word", F.lit(f"{MARK}({VALUE})"), F.lit(1)), lambda v: F.regexp_replace(v, r"[.,;:)\]}>=]+$", ""))
    bare = lambda c: F.translate(c, MARK, "")
    rows = rows.withColumn("_v", F.filter(values, lambda v: F.length(v) >= 6)).withColumns({n: bare(F.col(n)) for n in ("word", "left", "right")})
    runs = F.filter(F.regexp_extract_all("word", F.lit(RUN), F.lit(0)), mixed)
    # Runs count as often as they occur; a value that is one isn't told twice.
    rows = rows.withColumn("candidate", F.explode(F.concat(runs, F.array_except(F.concat(F.regexp_extract_all("word", F.lit(PREFIXED), F.lit(0)), F.col("_v")), runs))))
    head = F.expr("substring_index(word, candidate, 1)")
    return rows.select("doc_id", "path", F.col("i").cast("long").alias("word_index"), "candidate", F.concat_ws(" ", "left", head).alias("before"), F.col("right").alias("after"))


def features(df: DataFrame) -> tuple[DataFrame, list[str]]:
    """Adds the forest's inputs (``f_*``) to rows with candidate, before, after and path."""
    c, n = F.col("candidate"), F.length("candidate").cast("double")
    kinds = F.regexp_replace(F.regexp_replace(F.regexp_replace(c, "[a-z]", "a"), "[A-Z]", "A"), "[0-9]", "0")
    runs = F.regexp_count(F.regexp_replace(kinds, r"[^aA0]", "-"), F.lit(r"a+|A+|0+|-+"))
    covered = n - F.length(F.regexp_replace(F.lower(c), "(" + "|".join(sorted(DICTIONARY, key=len, reverse=True)) + ")", ""))
    digits = F.array_max(F.transform(F.regexp_extract_all(c, F.lit("[0-9]+"), F.lit(0)), lambda x: F.length(x)))
    flag = lambda col: F.coalesce(col, F.lit(False)).cast("double")
    made = {
        "f_length": n, "f_transitions": (runs - 1) / n, "f_digits": F.regexp_count(c, F.lit("[0-9]")) / n, "f_upper": F.regexp_count(c, F.lit("[A-Z]")) / n,
        "f_other": F.regexp_count(c, F.lit("[^A-Za-z0-9]")) / n, "f_distinct": F.size(F.array_distinct(F.split(c, ""))) / n, "f_run": F.coalesce(digits, F.lit(0)) / n, "f_dictionary": covered / n,
        "f_hex": flag(c.rlike("^([0-9a-f]+|[0-9A-F]+)$")), "f_credential": flag(F.col("before").rlike(CREDENTIAL)), "f_harmless": flag(F.col("before").rlike(HARMLESS)),
        "f_after": flag(F.col("after").rlike(HARMLESS)), "f_assigned": flag(F.col("before").rlike(r"[=:]\s*[\"']?$")), "f_quoted": flag(F.col("before").rlike(r"[\"']$")),
        "f_prefix": flag(c.rlike("^" + PREFIXED)), "f_test_path": flag(F.col("path").rlike(TEST_PATH)), "f_config_path": flag(F.col("path").rlike(CONFIG_PATH)),
    }
    return df.withColumns(made), list(made)


def labelled_findings(spark: SparkSession, rows: int = 6_000) -> DataFrame:
    """Findings written from rules, labelled 1 (a secret) or 0."""
    i = F.col("id")
    pick = lambda salt, options: F.element_at(F.array(*[F.lit(o) for o in options]), (F.pmod(F.xxhash64(F.lit(salt), i), F.lit(len(options))) + 1).cast("int"))
    long_hex = F.concat(F.sha2(F.concat(F.lit("a"), i.cast("string")), 256), F.sha2(F.concat(F.lit("b"), i.cast("string")), 256))
    size = F.element_at(F.array(*[F.lit(x) for x in (16, 20, 24, 32, 40, 64)]), (F.pmod(F.xxhash64(F.lit("n"), i), F.lit(6)) + 1).cast("int"))
    hexa = F.substring(long_hex, F.lit(1), size)
    base = F.substring(F.regexp_replace(F.base64(F.unhex(long_hex)), "[=]", ""), F.lit(1), size)
    number = F.substring(F.regexp_replace(long_hex, "[a-f]", ""), F.lit(1), F.lit(16))
    dull = F.concat(pick("d1", ["your", "example", "sample", "test", "dummy", "placeholder"]), pick("d2", ["_token_", "_secret_", "-password-", "Value", "_key_"]), pick("d3", ["here1234", "xxxx0000", "changeme1", "number123"]))
    word = F.concat(pick("w1", ["handling", "tion", "international", "Sehr", "conception"]), pick("w2", ["er", "ation", "ouLe", "ungen", "mente"]), pick("w3", ["isation", "keiten", "2ndly", "ement", "heitXvon"]))
    good = pick("g", ["token = \"", "secret = \"", "password: ", "api_key=", "export AUTH_TOKEN=", "the access key \"", "client_secret: '", "Bearer ", "key = \"", "token: "])
    bad = pick("b", ["commit ", "sha256: ", "checksum = ", "fingerprint ", "see ", "id ", "revision = \"", "md5 ", "of the ", "uuid: ", "card ", "figure ", "and then ", "the ", "version \"", "key fingerprint "])
    path = pick("p", ["src/app.py", "config/settings.yaml", "docs/readme.md", "tests/test_api.py", "notes.txt", "web", ".env", ""])
    kind = F.pmod(i, F.lit(8))
    value = F.when(kind.isin(0, 4), hexa).when(kind.isin(1, 5), base).when(kind == 2, F.when(F.pmod(i, F.lit(16)) < 8, F.upper(hexa)).otherwise(base)).when(kind == 3, number).when(kind == 6, dull).otherwise(word)
    secret = kind.isin(0, 1) | ((kind == 2) & (F.pmod(i, F.lit(16)) >= 8))
    # Placeholders stand beside credential words as well; numbers and words beside any.
    before = F.when(secret | (kind == 6), good).when((kind == 7) & (F.pmod(i, F.lit(32)) < 8), good).otherwise(bad)
    after = F.when(secret, pick("a1", ["", "and more", "\" then", "with"])).otherwise(pick("a2", ["", "of the page", "and so on", "id"]))
    old = spark.range(rows).select(value.alias("candidate"), before.alias("before"), after.alias("after"), path.alias("path"), secret.cast("double").alias("label")).where(F.length("candidate") >= MIN_LENGTH)
    # Short passwords and words beside credential words, and known services' keys anywhere.
    shape = F.pmod(i, F.lit(4))
    tail = F.substring(F.regexp_replace(F.base64(F.unhex(long_hex)), "[^A-Za-z0-9]", ""), F.lit(1), size)
    keyed = F.concat(pick("k", ["ghp_", "gho_", "sk_live_", "sk-", "sk-proj-", "xoxb-", "AIza", "github_pat_"]), F.rpad(tail, 20, "x7Q"))
    keyed = F.when(F.pmod(F.xxhash64(F.lit("aws"), i), F.lit(4)) == 0, F.concat(F.lit("AKIA"), F.upper(F.substring(tail, 1, 16)))).otherwise(keyed)
    digits = F.substring(F.regexp_replace(long_hex, "[a-f]", ""), F.lit(1), F.pmod(F.xxhash64(F.lit("m"), i), F.lit(4)).cast("int") + 1)
    password = F.concat(pick("p1", ["hunter", "dragon", "Summer", "qwerty", "Tiger", "abc", "monkey", "letme", "Winter"]), digits, pick("p2", ["", "!", "!x", "#a", "def", "$Q", "xyz"]))
    short = F.when(F.pmod(i, F.lit(8)) < 4, password).otherwise(F.substring(tail, F.lit(1), F.pmod(F.xxhash64(F.lit("l"), i), F.lit(7)).cast("int") + 7))
    plain = pick("n", ["required", "missing", "expired", "invalid", "handling", "changes", "section", "before", "string", "example", "placeholder", "changeme", "Bearer", "holder", "number", "<redacted>", "${TOKEN}", "your-password", "settings", "otherwise"])
    prose = pick("q", ["", "then ", "and then ", "the ", "use ", "we saw ", "see ", "log line "])
    new = F.when(shape.isin(0, 1), keyed).when(shape == 2, short).otherwise(plain)
    first = F.when(shape == 0, prose).otherwise(good)
    more = spark.range(rows // 2).select(new.alias("candidate"), first.alias("before"), pick("a3", ["", "and more", "then", "with", "of the page"]).alias("after"), path.alias("path"), (shape != 3).cast("double").alias("label"))
    return old.unionByName(more.where(F.length("candidate") >= 6))


def scan(docs: DataFrame, findings: DataFrame | None = None, train_rows: int = TRAIN_ROWS) -> DataFrame:
    """``doc_id, word_index, candidate_sha256, mask, score, is_secret`` of all candidates."""
    spark = docs.sparkSession
    if findings is None:
        known = labelled_findings(spark)
    else:
        n = findings.count()
        known = findings.where(F.pmod(F.xxhash64(*findings.columns), F.lit(1 << 30)) < int(min(1.0, train_rows / max(n, 1)) * (1 << 30)))
    learn, names = features(known.where("label IS NOT NULL AND candidate IS NOT NULL"))
    assemble = VectorAssembler(inputCols=names, outputCol="features", handleInvalid="keep")
    sample = assemble.transform(learn).select("features", "label").coalesce(8).cache()
    forest = RandomForestClassifier(numTrees=TREES, maxDepth=DEPTH, seed=SEED, featuresCol="features", labelCol="label", subsamplingRate=0.8)
    model = forest.fit(sample).setPredictionCol("_predicted").setProbabilityCol("_p").setRawPredictionCol("_raw")
    sample.unpersist()
    found, _ = features(candidates(docs))
    scored = model.transform(assemble.transform(found)).withColumn("score", F.element_at(vector_to_array("_p"), -1))
    mask = F.concat(F.substring("candidate", 1, 2), F.lit("..."), F.length("candidate").cast("string"))
    return scored.select("doc_id", "word_index", F.sha2("candidate", 256).alias("candidate_sha256"), mask.alias("mask"), "score", (F.col("score") > 0.5).alias("is_secret"))
