"""Idempotent writes as set algebra: each function returns the new state of a table."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def _equal(left: DataFrame, right: DataFrame, keys: list[str]):
    return reduce(lambda a, b: a & b, [left[k].eqNullSafe(right[k]) for k in keys])


def latest(rows: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    """One row of each key (nulls are equal): the last in the given order."""
    w = Window.partitionBy(*keys).orderBy(*[F.col(o).desc_nulls_last() for o in order])
    return rows.withColumn("_n", F.row_number().over(w)).where("_n = 1").drop("_n")


def merge_keep(existing: DataFrame, incoming: DataFrame, keys: list[str]) -> DataFrame:
    """Incoming values replace stored ones, but a null never does. Null keys are equal."""
    # A key that comes twice counts once: its greatest row, the same on every run.
    order = [c for c in incoming.columns if c not in keys]
    old, new = existing.alias("o"), latest(incoming, keys, order or keys).alias("n")
    on = reduce(lambda a, b: a & b, [F.col(f"o.{k}").eqNullSafe(F.col(f"n.{k}")) for k in keys])
    both = old.withColumn("_o", F.lit(1)).alias("o").join(new, on, "full_outer")
    return both.select(*[F.coalesce(f"n.{c}", f"o.{c}").alias(c) for c in existing.columns])


def replace_rows(existing: DataFrame, incoming: DataFrame, keys: list[str]) -> DataFrame:
    """Incoming rows replace stored ones of the same key, nulls and all."""
    kept = existing.join(incoming, _equal(existing, incoming, keys), "left_anti")
    return kept.unionByName(incoming.select(*existing.columns))


def replace_partition(existing: DataFrame, incoming: DataFrame, partition: list[str]) -> DataFrame:
    """All rows of the partitions that incoming has are replaced."""
    touched = incoming.select(*partition).distinct()
    return existing.join(touched, _equal(existing, touched, partition), "left_anti").unionByName(incoming.select(*existing.columns))


def assert_relations(existing: DataFrame, incoming: DataFrame) -> DataFrame:
    """Edges by (repo, type, source, target, target's name), nulls equal: confidence and evidence are renewed,
    the derivation stays."""
    keys = ["repo_id", "type", "src_object_id", "dst_object_id", "dst_ref"]
    order = [c for c in incoming.columns if c not in keys]
    old, new = existing.withColumn("_o", F.lit(True)).alias("o"), latest(incoming, keys, order).withColumn("_i", F.lit(True)).alias("n")
    both = old.join(new, reduce(lambda a, b: a & b, [F.col(f"o.{k}").eqNullSafe(F.col(f"n.{k}")) for k in keys]), "full_outer")
    pick = lambda c: (
        F.when(F.col("_o").isNull(), F.col(f"n.{c}")).when(F.col("_i").isNull(), F.col(f"o.{c}")).otherwise(F.col(f"n.{c}") if c in ("confidence", "evidence") else F.col(f"o.{c}"))
    )
    return both.select(*[pick(c).alias(c) for c in existing.columns])


def record_revisions(existing: DataFrame, incoming: DataFrame) -> DataFrame:
    """Bodies by (object, hash); every observation may move ``observed_at`` and with it what is current."""
    from .signatures import current_revision

    every = existing.select("object_id", "body_hash", "body", "observed_at").unionByName(incoming.select("object_id", "body_hash", "body", "observed_at"))
    return current_revision(every.groupBy("object_id", "body_hash").agg(F.first("body").alias("body"), F.max("observed_at").alias("observed_at")))


def sync_log(log: DataFrame, incoming: DataFrame) -> DataFrame:
    """Runs by (repo, source, run): a run that is told again replaces itself, so replays count once."""
    return replace_rows(log, latest(incoming, ["repo_id", "source", "run_id"], ["at"]), ["repo_id", "source", "run_id"])


def sync_totals(log: DataFrame) -> DataFrame:
    """Bookkeeping per (repo, source) from its runs (status, at, watermark, objects_seen, full, error, stats).

    The watermark only moves forward and comes from successes; their objects add up; the last run's status holds,
    and its error if it failed; failures since the last success; statistics merge, the later value of a name wins.
    """
    keys = ["repo_id", "source"]
    ok = F.col("status") != "failed"
    base = log.groupBy(*keys).agg(
        F.max(F.when(ok, F.col("watermark"))).alias("watermark"), F.coalesce(F.sum(F.when(ok, F.col("objects_seen"))), F.lit(0)).alias("objects_seen"),
        F.max_by("status", "at").alias("status"), F.max("at").alias("last_attempt_at"), F.max(F.when(ok, F.col("at"))).alias("last_success_at"),
        F.max(F.when(ok & F.col("full"), F.col("at"))).alias("last_full_sync_at"), F.max_by(F.when(~ok, F.substring("error", 1, 4000)), "at").alias("last_error"),
    )
    since = log.join(base.select(*keys, "last_success_at"), keys).where(~ok & (F.col("last_success_at").isNull() | (F.col("at") > F.col("last_success_at"))))
    failures = since.groupBy(*keys).agg(F.count("*").alias("consecutive_failures"))
    named = log.where(ok).select(*keys, "at", F.explode("stats").alias("name", "value")).groupBy(*keys, "name").agg(F.max_by("value", "at").alias("value"))
    stats = named.groupBy(*keys).agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct("name", "value")))).alias("stats"))
    return base.join(failures, keys, "left").join(stats, keys, "left").withColumn("consecutive_failures", F.coalesce("consecutive_failures", F.lit(0)))


def sync_state(existing: DataFrame, events: DataFrame) -> DataFrame:
    """Per (repo, source): the watermark only moves forward, objects add up, the last status holds. For events
    that are delivered once; ``sync_log`` and ``sync_totals`` are for those that may come again."""
    every = existing.unionByName(events.select(*existing.columns))
    return every.groupBy("repo_id", "source").agg(F.max("watermark").alias("watermark"), F.sum("objects_seen").alias("objects_seen"), F.max_by("status", "at").alias("status"), F.max("at").alias("at"))


def sync_health(state: DataFrame) -> DataFrame:
    """Per repo: stale without sources, complete or failed if all are, else degraded; and the data's date."""
    n = F.count("*")
    done, bad = F.count_if(F.col("status") == "complete"), F.count_if(F.col("status") == "failed")
    health = F.when(n == 0, "stale").when(done == n, "complete").when(bad == n, "failed").otherwise("degraded")
    return state.groupBy("repo_id").agg(health.alias("health"), F.max(F.when(F.col("status") == "complete", F.col("at"))).alias("data_as_of"), n.alias("sources"))


def downgrade_unresolved(relations: DataFrame, commits: DataFrame) -> DataFrame:
    """Commit references that resolve to no commit get low confidence."""
    known = commits.select(F.col("sha").alias("dst_ref")).distinct().withColumn("_known", F.lit(True))
    return relations.join(known, "dst_ref", "left").withColumn("confidence", F.when((F.col("type") == "references_commit") & F.col("_known").isNull(), "low").otherwise(F.col("confidence"))).drop("_known")


def digest(df: DataFrame) -> DataFrame:
    """A digest of a table's content that doesn't depend on order: rows, and sums of two hashes."""
    cols = [F.col(c).cast("string") for c in sorted(df.columns)]
    # Values are joined by a separator; a null is a sign of its own.
    row = F.sha2(F.array_join(F.array(*[F.coalesce(c, F.lit("\x1e")) for c in cols]), "\x1f"), 256)
    part = lambda a: F.conv(F.substring(row, a, 12), 16, 10).cast("decimal(38,0)")
    return df.agg(F.count("*").alias("rows"), F.sum(part(1)).alias("low"), F.sum(part(13)).alias("high"))


def _files(spark, path: str):
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    return at, at.getFileSystem(spark._jsc.hadoopConfiguration())


def _versions(spark, root: str, kind: str) -> list[int]:
    """Numbers of the entries ``kind``=N of a folder that were written to the end."""
    at, fs = _files(spark, root)
    if not fs.exists(at):
        return []
    names = [x.getPath().getName() for x in fs.listStatus(at)]
    done = [int(n.split("=")[1]) for n in names if n.startswith(f"{kind}=")]
    return sorted(n for n in done if fs.exists(_files(spark, f"{root}/{kind}={n}/_SUCCESS")[0]))


def write_snapshot(df: DataFrame, root: str) -> str:
    """Write a table's next version beside the last; readers see one or the other.

    Versions are never overwritten, and one counts from the moment its writer's ``_SUCCESS`` is there (the last
    thing it writes). A writer that dies before leaves an incomplete folder, which is passed over for good.
    """
    spark = df.sparkSession
    at, fs = _files(spark, root)
    taken = [int(x.getPath().getName().split("=")[1]) for x in fs.listStatus(at) if x.getPath().getName().startswith("v=")] if fs.exists(at) else []
    path = f"{root}/v={max(taken, default=0) + 1}"
    df.write.mode("errorifexists").parquet(path)
    return path


def read_version(spark, root: str) -> int:
    """The greatest complete version; 0 before the first."""
    return max(_versions(spark, root, "v"), default=0)


def read_snapshot(spark, root: str) -> DataFrame:
    version = read_version(spark, root)
    if not version:
        raise FileNotFoundError(f"{root} has no complete version")
    return spark.read.parquet(f"{root}/v={version}")
