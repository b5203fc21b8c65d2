"""URL filters: host and path rules, and gradient-boosted trees on lexical features. Native.

A rule's verdict stands where a rule fits; the trees judge the other URLs. They learn from labelled URLs:
a table (url, label: 1 block, 0 allow) that the caller gives. ``pages`` has none, so the query labels the
pages themselves by the seed words ``SEEDS`` in their hosts: weak labels, which the README gives figures for.
The trees are fitted on a bounded sample: rows below a bound on a hash of the URL, about ``TRAIN_ROWS``.

Features: lengths of URL, host and path, labels of the host, depth of the path, ratios of digits and
of other signs, entropy of the characters, number of parameters, whether it has a fragment, hyphens,
and smoothed block rates of the host's suffix, of the first path part and of both together. The rates are of
all labelled URLs of *other* hosts, so neither a row's label nor its host's is in its features; no
feature has words of the host.

Null or empty url, or one without ``://``: host and path are empty. Long URLs count whole. Without labelled URLs
of both verdicts the trees are left out: the one verdict seen, else ``allow``, is given. Repeated rows get a row
each, an empty table none. Of extra columns none is read.
"""

from __future__ import annotations

from pyspark.ml.classification import GBTClassifier
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ._common import materialize

#: The contract's rules (fixed values): host, path, verdict.
RULES = [
    ("com", "/", "allow"),
    ("example.com", "/en/", "block"),
    ("www.example.com", "/en/", "allow"),
    ("net", "/es/", "block"),
    ("net", "/fr/", "block"),
]
#: Words of hosts that mark a labelled URL as one to block.
SEEDS = ["ad", "ads", "adult", "bet", "bets", "casino", "pills", "poker", "porn", "spam", "viagra", "xxx"]
TRAIN_ROWS = 20_000
TREES, DEPTH, SEED = 12, 4, 11
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: Suffix statistics: a group without rows has the overall rate, ``PRIOR`` rows strong.
GROUPS = {"suffix": ["_suffix"], "part": ["_part"], "both": ["_suffix", "_part"]}
PRIOR = 10.0


def parts(url: Column) -> tuple[Column, Column]:
    """Host (A-Z lower-cased) and path of a URL; both empty without ``://``."""
    has = F.coalesce(F.locate("://", url) > 0, F.lit(False))
    rest = F.expr("substring(_url, locate('://', _url) + 3)")
    host = F.translate(F.regexp_extract(rest, r"^[^/?#]*", 0), UPPER, LOWER)
    path = F.regexp_extract(rest, r"^[^/?#]*([^?#]*)", 1)
    return F.when(has, host).otherwise(F.lit("")), F.when(has, path).otherwise(F.lit(""))


def rule_columns(host: Column, path: Column, rules: list[tuple[str, str, str]]) -> tuple[Column, Column]:
    """The longest fitting rule, and its verdict; null where none fits."""
    name, verdict = F.lit(None).cast("string"), F.lit(None).cast("string")
    for h, p, v in sorted(rules, key=lambda r: (len(r[0] + r[1]), r[0] + r[1])):
        fits = ((host == h) | host.endswith("." + h)) & path.startswith(p)
        name, verdict = F.when(fits, F.lit(h + p)).otherwise(name), F.when(fits, F.lit(v)).otherwise(verdict)
    return name, verdict


def _entropy(text: Column) -> Column:
    """Shannon entropy in bits of the characters."""
    chars = F.filter(F.split(text, ""), lambda c: c != "")
    n = F.length(text).cast("double")
    one = lambda c: (n - F.length(F.replace(text, c, F.lit("")))) / n
    bits = F.aggregate(F.array_distinct(chars), F.lit(0.0), lambda acc, c: acc - one(c) * F.log2(one(c)))
    return F.when(n > 0, bits).otherwise(F.lit(0.0))


def lexical(df: DataFrame) -> DataFrame:
    """Adds host, path, the group keys and the plain features (``f_*``) to rows with ``_url``."""
    url = F.coalesce(F.col("_url"), F.lit(""))
    host, path = parts(F.col("_url"))
    df = df.withColumn("host", host).withColumn("path", path)
    host, path, n = F.col("host"), F.col("path"), F.greatest(F.length(url), F.lit(1)).cast("double")
    count = lambda pattern, col=url: F.regexp_count(col, F.lit(pattern)).cast("double")
    query = F.regexp_extract(url, r"\?([^#]*)", 1)
    return df.select(
        "*", F.substring_index(host, ".", -1).alias("_suffix"), F.regexp_extract(path, r"^/([^/]*)", 1).alias("_part"),
        F.length(url).cast("double").alias("f_length"), F.length(host).cast("double").alias("f_host"), F.length(path).cast("double").alias("f_path"), count(r"[^.]+", host).alias("f_labels"),
        count(r"[^/]+", path).alias("f_depth"), (count(r"[0-9]") / n).alias("f_digits"), (count(r"[^0-9A-Za-z/.:]") / n).alias("f_signs"), _entropy(url).alias("f_entropy"),
        F.when(query == "", 0.0).otherwise(count(r"&", query) + 1).alias("f_params"), count(r"#").alias("f_fragment"), count(r"-", host).alias("f_hyphens"),
    )


def seed_label(host: Column) -> Column:
    """1.0 if a word of the host is a seed word."""
    words = F.split(host, "[^a-z0-9]+")
    return F.arrays_overlap(words, F.array(*[F.lit(w) for w in SEEDS])).cast("double")


def judge(pages: DataFrame, labelled: DataFrame | None = None, rules: list[tuple[str, str, str]] = RULES, train_rows: int = TRAIN_ROWS) -> DataFrame:
    """``page_id, host, path, rule, verdict, block_score`` of each row."""
    made = lexical(pages.select("page_id", F.col("url").cast("string").alias("_url")))
    rule, verdict = rule_columns(F.col("host"), F.col("path"), rules)
    made = made.withColumn("rule", rule).withColumn("_ruled", verdict)
    if labelled is None:
        known = made.withColumn("label", seed_label(F.col("host")))
    else:
        known = lexical(labelled.select(F.col("url").cast("string").alias("_url"), F.col("label").cast("double").alias("label")).where("label IS NOT NULL"))
    known = known.where(F.col("host") != "")
    total = known.agg(F.count("*").alias("n"), F.sum("label").alias("b")).first()
    n, blocked = total["n"], total["b"] or 0.0
    plain = ["page_id", "host", "path", "rule"]
    if not n or blocked in (0.0, float(n)):
        usual = "block" if blocked else "allow"
        return made.select(*plain, F.coalesce("_ruled", F.lit(usual)).alias("verdict"), F.lit(float(bool(blocked))).alias("block_score"))
    base = blocked / n
    # Counts by host, suffix and path part: a group's rate for a row leaves the row's own host out.
    per = materialize(known.groupBy("host", "_suffix", "_part").agg(F.count("*").alias("n"), F.sum("label").alias("b")), "url-hosts")
    counts = lambda name, keys: per.groupBy(*keys).agg(F.sum("n").alias(f"n_{name}"), F.sum("b").alias(f"b_{name}"))
    groups = {name: counts(name, keys) for name, keys in GROUPS.items()}
    own = {"suffix": counts("own_suffix", ["host"]), "part": per.select("host", "_suffix", "_part", F.col("n").alias("n_own_part"), F.col("b").alias("b_own_part"))}
    features = [c for c in made.columns if c.startswith("f_")] + [f"g_{name}" for name in GROUPS]

    def ready(df: DataFrame) -> DataFrame:
        df = df.join(own["suffix"], ["host"], "left").join(own["part"], ["host", "_suffix", "_part"], "left")
        for name, keys in GROUPS.items():
            mine = "own_suffix" if name == "suffix" else "own_part"
            rest = lambda c: F.coalesce(f"{c}_{name}", F.lit(0)) - F.coalesce(f"{c}_{mine}", F.lit(0))  # noqa: B023, E731
            df = df.join(groups[name], keys, "left").withColumn(f"g_{name}", (rest("b") + PRIOR * base) / (rest("n") + PRIOR))
        return VectorAssembler(inputCols=features, outputCol="features", handleInvalid="keep").transform(df)

    # Both verdicts are sampled, each about in proportion to the root of its rows, so a rare one is seen.
    order = F.pmod(F.xxhash64(F.lit(SEED), "_url"), F.lit(1 << 30))
    room = {1.0: blocked, 0.0: n - blocked}
    share = {k: min(1.0, train_rows * (c**0.5 / sum(x**0.5 for x in room.values())) / c) for k, c in room.items()}
    bound = F.when(F.col("label") == 1.0, F.lit(int(share[1.0] * (1 << 30)))).otherwise(F.lit(int(share[0.0] * (1 << 30))))
    sample = materialize(ready(known.where(order < bound)).select("features", "label"), "url-sample").coalesce(8).cache()
    seen = sample.select("label").distinct().count()
    if seen == 2:
        trees = GBTClassifier(maxIter=TREES, maxDepth=DEPTH, seed=SEED, stepSize=0.3, featuresCol="features", labelCol="label")
        model = trees.fit(sample).setPredictionCol("_predicted").setProbabilityCol("_p").setRawPredictionCol("_raw")
        scored = model.transform(ready(made)).withColumn("block_score", vector_to_array("_p")[1])
    else:
        scored = made.withColumn("block_score", F.lit(base))
    sample.unpersist()
    method = F.when(F.col("block_score") > 0.5, "block").otherwise("allow")
    return scored.select(*plain, F.coalesce("_ruled", method).alias("verdict"), "block_score")


#: host, path, rule in DuckDB (the trees' verdicts aren't SQL).
SQL_RULES = r"""
WITH u AS (SELECT page_id, url, CASE WHEN strpos(url, '://') > 0 THEN substr(url, strpos(url, '://') + 3) END AS rest FROM pages),
p AS (SELECT page_id, coalesce(translate(regexp_extract(rest, '^[^/?#]*'), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '') AS host, coalesce(regexp_extract(rest, '^[^/?#]*([^?#]*)', 1), '') AS path FROM u),
r AS (SELECT * FROM (VALUES ('com', '/', 'allow'), ('example.com', '/en/', 'block'), ('www.example.com', '/en/', 'allow'), ('net', '/es/', 'block'), ('net', '/fr/', 'block')) t(h, q, v))
SELECT page_id, host, path, (SELECT h || q FROM r WHERE (host = h OR ends_with(host, '.' || h)) AND starts_with(path, q) ORDER BY length(h || q) DESC LIMIT 1) AS rule FROM p
"""
