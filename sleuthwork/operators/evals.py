"""Evaluation: rates with their denominators, latencies, intervals, gates and samples."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

GATE = 0.05
#: Actions that change what someone runs.
UNSAFE = ("upgrade", "downgrade", "migrate", "config_change", "workaround")


def rate(hits: Column, of: Column) -> Column:
    """Rounded to four places; null on a zero denominator."""
    return F.round(F.try_divide(F.count_if(hits & of).cast("double"), F.count_if(of).cast("double")), 4)


def latencies(df: DataFrame, column: str, *keys: str) -> DataFrame:
    """Median, 95th value (the one at int(0.95 n) of the sorted ones) and maximum per group; groups without a
    value are left out. No group's values are gathered in a list."""
    if not keys:
        return latencies(df.withColumn("_all", F.lit(1)), column, "_all").drop("_all")
    ends = exact_quantile(df, column, *keys).withColumnRenamed("value", "p95")
    return df.where(F.col(column).isNotNull()).groupBy(*keys).agg(F.percentile(column, 0.5).alias("p50"), F.max(column).alias("max")).join(ends, list(keys))


def exact_quantile(df: DataFrame, column: str, *keys: str, share: float = 0.95) -> DataFrame:
    """As ``latencies``' 95th, for groups too large for one list: ranks by counts of values."""
    from pyspark.sql import Window

    counts = df.where(F.col(column).isNotNull()).groupBy(*keys, column).agg(F.count("*").alias("c"))
    w = Window.partitionBy(*keys)
    cum = counts.withColumn("_n", F.sum("c").over(w)).withColumn("_c", F.sum("c").over(w.orderBy(column)))
    want = F.greatest(F.floor(F.col("_n") * share), F.lit(1))
    return cum.where(F.col("_c") >= want).groupBy(*keys).agg(F.min(column).alias("value"))


def wilson(hits: Column, n: Column, z: float = 1.959963984540054) -> tuple[Column, Column]:
    """The 95 % interval of a rate; null without cases."""
    p, zz = hits / n, z * z
    mid, half, scale = p + zz / (2 * n), z * F.sqrt(p * (1 - p) / n + zz / (4 * n * n)), 1 + zz / n
    return F.when(n > 0, (mid - half) / scale), F.when(n > 0, (mid + half) / scale)


def suite(results: DataFrame) -> DataFrame:
    """The rates of a suite's results in one row, each null where nothing is counted.

    Results: kind (incident, paraphrase, negative, regression, perturbation), passed, known_gap, matched, action,
    applicability, cited, resolved (numbers of evidence ids).
    """
    kind, held = F.col("kind"), F.col("action").isin("abstain", "collect_more_info")
    negative, perturbed = kind.isin("negative", "regression"), kind == "perturbation"
    judged = kind.isin("incident", "paraphrase", "perturbation") & ~F.col("known_gap")
    unsafe = F.col("action").isin(*UNSAFE)
    against = perturbed & (F.col("applicability") == "hard_contradiction")
    every = F.lit(True)
    return results.agg(
        rate(F.col("passed"), judged).alias("action_at_1"), rate(F.col("matched"), negative).alias("false_incident"), rate(unsafe, negative).alias("unsafe_negative"), rate(unsafe, against).alias("unsafe_contradiction"),
        rate(negative, held).alias("abstention_precision"), rate(held, negative).alias("abstention_recall"), rate(F.col("passed"), perturbed).alias("version_verdict"),
        F.round(F.try_divide(F.sum("resolved").cast("double"), F.sum("cited").cast("double")), 4).alias("citation_validity"), rate(F.col("resolved") == F.col("cited"), every).alias("claim_support"), F.count_if("known_gap").alias("gaps"),
    )


def pooled(rows: DataFrame) -> DataFrame:
    """Census rows of several draws (seed, object_id, matched, possible, proposed) together: draws and distinct reports."""
    n, chances, made = F.count("*"), F.count_if("possible"), F.count_if("proposed")
    return rows.agg(
        F.count_distinct("seed").alias("seeds"), n.alias("reports"), F.count_distinct("object_id").alias("distinct_reports"), F.round(F.try_divide(F.count_if("matched"), n), 4).alias("match_rate"),
        chances.alias("opportunities"), made.alias("proposals"), F.round(F.try_divide(made, n), 4).alias("overall"), F.round(F.try_divide(made, chances), 4).alias("conditional"),
    )


def holdout(rows: DataFrame) -> DataFrame:
    """Overall and conditional rates of proposals over census rows (object_id, matched, possible, proposed)."""
    n, chances, made = F.count("*"), F.count_if("possible"), F.count_if("proposed")
    return rows.agg(
        n.alias("reports"), F.count_distinct("object_id").alias("distinct_reports"), F.count_if("matched").alias("matched"), chances.alias("opportunities"), made.alias("proposals"),
        F.round(F.try_divide(made, n), 4).alias("overall"), F.round(F.try_divide(F.count_if(F.col("proposed") & F.col("possible")), chances), 4).alias("conditional"),
    ).withColumn("passes", F.coalesce(F.col("overall") <= GATE, F.lit(False)))


def hash_sample(df: DataFrame, key: str, seed: int, n: int) -> DataFrame:
    """``n`` rows in the order of a seeded hash: the same rows on every run."""
    return df.orderBy(F.md5(F.concat(F.lit(f"{seed}:"), F.col(key).cast("string"))), key).limit(n)
