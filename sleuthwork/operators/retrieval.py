"""The token channel: rarity-weighted search of content units, for all requests at once."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions import fixed as V
from ..functions import text as fn
from . import tables
from .tables import bounded, materialize

#: Decimals kept of scores before they are compared with thresholds.
ROUND = 9


#: Patterns without a literal trigram that one pass over the units takes.
PATTERN_BLOCK = 1_000
#: Pairs of a request's token and an object that hits it, in one task of a census.
TASK_PAIRS = 4_000_000


def _grams(text) -> F.Column:
    """The distinct runs of three characters of a lower-cased text."""
    low = F.lower(text)
    return F.array_distinct(F.transform(F.sequence(F.lit(1), F.greatest(F.length(low) - 2, F.lit(1))), lambda i: F.substring(low, i, F.lit(3))))


def token_hits(units: DataFrame, tokens: DataFrame) -> DataFrame:
    """``object_id, token, unit_hits``: units of an object that match a token as an unescaped ILIKE pattern.

    A match of a token without blanks lies in one word. Words are matched once, in the distinct vocabulary,
    which is a table of its own, and found by a trigram that both share (an equi-join): of a token's trigrams
    the one that the fewest words have, so no common trigram gathers both sides. Words shorter than every token hold
    none. The words that were found, no others, lead back to the units; while they are few they are sent to the units, so only
    hits are moved, once. Tokens with blanks or wildcards share a trigram with the unit itself.
    Those without a literal trigram are matched with every unit, in blocks of ``PATTERN_BLOCK``, so what is
    broadcast is bounded.
    """
    distinct = materialize(tokens.select("token").where("token IS NOT NULL").distinct(), "tokens")
    keyed = distinct.withColumn("gram", F.regexp_extract(F.lower("token"), r"[^\s_%\\]{3}", 0)).withColumn("like", fn.ilike_token(F.col("token")))
    loose = F.col("token").rlike(r"[\s_%\\]")
    plain = (F.col("gram") != "") & ~loose
    counts = keyed.agg(F.count_if((F.col("gram") != "") & loose).alias("loose"), F.count_if(F.col("gram") == "").alias("bare"), F.coalesce(F.min(F.when(plain, F.length(F.lower("token")))), F.lit(0)).alias("shortest")).first()
    words = units.select("object_id", "seq", F.explode(F.split(F.lower("text"), r"\s+")).alias("word")).where((F.col("word") != "") & (F.length("word") >= counts["shortest"]))
    vocabulary = materialize(words.select("word").distinct(), "vocabulary")
    parts = bounded(keyed.where(plain).select("token", F.explode(_grams("token")).alias("gram")), "grams")
    near = vocabulary.select("word", F.explode(_grams("word")).alias("gram"))
    often = near.join(parts.select("gram").distinct(), "gram", "left_semi").groupBy("gram").agg(F.count("*").alias("n"))
    rarest = parts.join(often, "gram").groupBy("token").agg(F.min_by("gram", F.struct("n", "gram")).alias("gram"), F.count("*").alias("have"), F.first(F.size(_grams("token"))).alias("need"))
    # A token whose trigrams aren't all in the vocabulary is in no word.
    asked = bounded(rarest.where("have = need").select("token", "gram"), "rarest")
    found = near.join(asked, "gram").where(F.col("word").contains(F.lower("token"))).select("word", "token")
    out = words.join(bounded(found, "found"), "word").select("object_id", "seq", "token")
    if counts["loose"]:
        spread = units.select("object_id", "seq", "text", F.explode(_grams("text")).alias("gram")).join(keyed.where((F.col("gram") != "") & loose), "gram")
        out = out.unionByName(spread.where(F.expr("text ILIKE like")).select("object_id", "seq", "token"))
    blocks = -(-counts["bare"] // PATTERN_BLOCK)
    for k in range(blocks):
        part = keyed.where((F.col("gram") == "") & (F.pmod(F.xxhash64("token"), F.lit(blocks)) == k))
        out = out.unionByName(units.join(F.broadcast(part), F.expr("text ILIKE like")).select("object_id", "seq", "token"))
    # By object once: both aggregations are of rows that lie together.
    return out.repartition("object_id").distinct().groupBy("object_id", "token").agg(F.count("*").alias("unit_hits"))


def doc_freq(hits: DataFrame) -> DataFrame:
    """``token, doc_freq``; a hit row is one object."""
    return hits.groupBy("token").agg(F.count("*").alias("doc_freq"))


def weights(hits: DataFrame, units: DataFrame) -> DataFrame:
    """``token, doc_freq, weight`` of the tokens that hit: weight is ln(1 + objects / doc_freq)."""
    corpus = units.agg(F.count_distinct("object_id").alias("corpus"))
    return doc_freq(hits).crossJoin(F.broadcast(corpus)).withColumn("weight", F.log(1 + F.col("corpus") / F.greatest("doc_freq", F.lit(1)))).drop("corpus")


def weighted(hits: DataFrame, units: DataFrame) -> DataFrame:
    """Hits with doc_freq and weight; hits should be a table, as they are read twice."""
    return hits.join(bounded(weights(hits, units), "weights"), "token")


def rejection(identifying, structural, matched, score, coverage):
    """The first reason to refuse a hit, or null."""
    return (
        F.when(identifying == 0, "no_identifying_token").when((structural == 0) & (identifying < 2), "single_rare_word").when(matched < V.MIN_MATCHED_TOKENS, "too_few_tokens")
        .when(score < V.MIN_SCORE, "score_below_threshold").when(coverage < V.MIN_COVERAGE, "coverage_below_threshold")
    )


def scored(units: DataFrame, tokens: DataFrame, objects: DataFrame | None = None, kinds: tuple[str, ...] = ("discussion", "issue", "release")) -> DataFrame:
    """The candidates of ``search`` without their ranks."""
    tokens = materialize(tokens, "asked")
    hits = materialize(token_hits(units, tokens), "hits")
    weight = bounded(weights(hits, units), "weights")
    asked = bounded(tokens.select("request_id", "token").distinct().join(weight, "token"), "wanted")
    own = bounded(asked.groupBy("request_id").agg(F.sum("weight").alias("total")), "totals")
    if objects is None:
        per_token = hits.join(asked, "token")
    else:
        threads = objects.select("object_id", F.coalesce("parent_id", "object_id").alias("thread"))
        hits = hits.join(threads, "object_id").groupBy(F.col("thread").alias("object_id"), "token").agg(F.sum("unit_hits").alias("unit_hits"))
        allowed = objects.where(F.col("kind").isin(*kinds)).select("object_id")
        per_token = hits.join(allowed, "object_id", "left_semi").join(asked, "token")
    t, df = F.col("token"), F.col("doc_freq")
    ordered = F.array_sort(F.collect_list(F.struct((-F.col("weight")).alias("w"), t.alias("token"))))
    out = per_token.groupBy("request_id", "object_id").agg(
        F.round(F.sum("weight"), ROUND).alias("score"), F.count("*").alias("matched"), F.count_if(fn.is_identifying(t, df)).alias("identifying"),
        F.count_if(fn.is_structural(t)).alias("structural"), F.sum("unit_hits").alias("unit_hits"), F.transform(ordered, lambda x: x["token"]).alias("tokens"),
    )
    out = out.join(own, "request_id").withColumn("coverage", F.round(F.col("score") / F.col("total"), ROUND)).drop("total")
    return out.withColumn("rejection", rejection(F.col("identifying"), F.col("structural"), F.col("matched"), F.col("score"), F.col("coverage")))


_BEST_FIRST = (F.desc, "score"), (F.desc, "unit_hits"), (F.asc, "object_id")


def search(units: DataFrame, tokens: DataFrame, objects: DataFrame | None = None, kinds: tuple[str, ...] = ("discussion", "issue", "release")) -> DataFrame:
    """Scored candidates of each request: tokens has request_id and token, objects object_id, parent_id, kind.

    A comment's hits count for its thread; frequencies are those of objects before that. Without objects
    every object is its own thread. Ranked per request among the accepted.
    """
    w = Window.partitionBy("request_id", F.col("rejection").isNull()).orderBy(*[by(c) for by, c in _BEST_FIRST])
    return scored(units, tokens, objects, kinds).withColumn("rank", F.when(F.col("rejection").isNull(), F.row_number().over(w)))


def search_top(units: DataFrame, tokens: DataFrame, limit: int = 5, **given) -> DataFrame:
    """The accepted candidates of ``search`` up to a rank: each task keeps its own best of a request, so no request is sorted as a whole."""
    w = Window.partitionBy("request_id").orderBy(*[by(c) for by, c in _BEST_FIRST])
    return scored(units, tokens, **given).where("rejection IS NULL").withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= limit)


def top(found: DataFrame, limit: int = 5) -> DataFrame:
    """The accepted candidates up to a rank, of each request."""
    return found.where(F.col("rank") <= limit)


def best_excerpt(units: DataFrame, wanted: DataFrame) -> DataFrame:
    """The unit shown for (object_id, token): logs first, then code, then the rest; the shortest of those."""
    order = F.when(F.col("unit_type") == "log", 0).when(F.col("unit_type") == "code", 1).otherwise(2)
    # ILIKE compiles its pattern for every row; a token without wildcards is looked for as it is, which is the same.
    wanted = wanted.withColumn("like", fn.ilike_token(F.col("token"))).withColumn("low", F.when(~F.col("token").rlike(r"[_%\\]"), F.lower("token")))
    near = units.join(wanted, "object_id").where(F.when(F.col("low").isNotNull(), F.lower("text").contains(F.col("low"))).otherwise(F.expr("text ILIKE like")))
    w = Window.partitionBy("object_id", "token").orderBy(order, F.length("text"), "seq")
    return near.withColumn("n", F.row_number().over(w)).where("n = 1").select("object_id", "token", F.col("text").alias("excerpt"))


def feature_channel(signatures: DataFrame, wanted: DataFrame) -> DataFrame:
    """Objects that share features with a request: signatures object_id, kind, value; wanted request_id, kind, value."""
    strong = F.col("kind").isin("subject_package", "subject_path", "error", "structural")
    shared = signatures.select("object_id", "kind", "value").distinct().join(wanted.select("request_id", "kind", "value").distinct(), ["kind", "value"])
    return shared.groupBy("request_id", "object_id").agg(F.count("*").alias("feature_hits"), F.count_if(strong).alias("strong_hits"))


def merge_channels(token_hits: DataFrame, features: DataFrame, limit: int = 8) -> DataFrame:
    """Full outer merge; admitted by a token hit, two features or a strong one; ranked per request."""
    left = token_hits.select("request_id", "object_id", F.col("score").alias("token_score"))
    both = left.join(features, ["request_id", "object_id"], "full_outer").na.fill(0, ["token_score", "feature_hits", "strong_hits"])
    both = both.where((F.col("token_score") > 0) | (F.col("feature_hits") >= 2) | (F.col("strong_hits") >= 1))
    channels = F.array_compact(F.array(F.when(F.col("token_score") > 0, F.lit("tokens")), F.when(F.col("feature_hits") > 0, F.lit("features"))))
    w = Window.partitionBy("request_id").orderBy(F.desc("token_score"), F.desc("feature_hits"), "object_id")
    return both.withColumn("channels", F.concat_ws("+", channels)).withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= limit)


def leave_one_out(units: DataFrame, tokens: DataFrame) -> DataFrame:
    """Census search: request_id is an object of the corpus, and is left out of its own answer, of the
    number of objects and of the frequencies."""
    tokens = materialize(tokens, "asked")
    hits = materialize(token_hits(units, tokens), "hits")
    freq = bounded(doc_freq(hits), "frequencies")
    corpus = units.agg((F.count_distinct("object_id") - 1).alias("corpus"))
    asked = tokens.select("request_id", "token").distinct()
    mine = hits.select(F.col("object_id").alias("request_id"), "token", F.lit(1).alias("own"))
    df = asked.join(freq, "token").join(mine, ["request_id", "token"], "left").withColumn("df", F.col("doc_freq") - F.coalesce("own", F.lit(0))).where("df > 0")
    weights_ = materialize(df.crossJoin(F.broadcast(corpus)).select("request_id", "token", F.log(1 + F.col("corpus") / F.col("df")).alias("weight"), "doc_freq"), "weights")
    size = weights_.agg(F.count("*").alias("n"), F.coalesce(F.sum("doc_freq"), F.lit(0)).alias("pairs")).first()
    # Pairs are made and added up where their object's hits lie: hits are moved, pairs are not. Requests go in blocks whose
    # weights every task gets, and a task takes so few objects that its sums stay in memory.
    blocks = max(1, -(-size["n"] // tables.SENT))
    width = int(units.sparkSession.conf.get("spark.sql.shuffle.partitions", "200"))
    dealt = max(width, min(20_000, size["pairs"] // (blocks * TASK_PAIRS)))
    out = None
    for k in range(blocks):
        part = weights_.where(F.pmod(F.xxhash64("request_id"), F.lit(blocks)) == k).drop("doc_freq")
        rows = hits.select("object_id", "token").repartition(dealt, "object_id").join(F.broadcast(part), "token").where("object_id <> request_id")
        one = rows.groupBy("request_id", "object_id").agg(F.round(F.sum("weight"), 6).alias("score"), F.count("*").alias("matched"))
        out = one if out is None else out.unionByName(one)
    return out
