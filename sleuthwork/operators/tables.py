"""Tables between the steps of an operator, and ranks over whole tables."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

_LOCAL: list[str] = []


def shared(spark: SparkSession) -> str:
    """The folder that cuts lineage; a local one only in local runs where the setting is absent."""
    root = spark.conf.get("spark.checkpoint.dir", None)
    if root:
        return root.rstrip("/")
    master = spark.sparkContext.master
    if not master.startswith("local") or master.startswith("local-cluster"):
        raise ValueError("spark.checkpoint.dir has to name a folder that all executors share")
    if not _LOCAL:
        _LOCAL.append(tempfile.mkdtemp(prefix="sleuthwork-"))
    return "file://" + _LOCAL[0]


def materialize(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` once to the shared folder and return a reader of it."""
    path = f"{shared(df.sparkSession)}/sleuthwork/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


#: Rows that a table may have if every task gets a copy of it.
SENT = 200_000


def bounded(df: DataFrame, name: str) -> DataFrame:
    """``df`` written once, and marked for broadcast if it has at most SENT rows."""
    out = materialize(df, name)
    return F.broadcast(out) if out.limit(SENT + 1).count() <= SENT else out


def placed(df: DataFrame, *order: str, name: str = "place") -> DataFrame:
    """``df`` with each row's place from 1 on in an order over the whole table, without one task for all.

    Rows are dealt to ranges and ranked in each; the ranges' sizes, one number a range, are with the driver.
    Rows that are equal in the order should not exist: which comes first is not defined.
    """
    spark = df.sparkSession
    width = int(spark.conf.get("spark.sql.shuffle.partitions", "200"))
    parts = materialize(df.repartitionByRange(width, *order).withColumn("_part", F.spark_partition_id()), "placed")
    before, starts = 0, {}
    for r in parts.groupBy("_part").agg(F.count("*").alias("n")).orderBy("_part").collect():
        starts[r["_part"]], before = before, before + r["n"]
    if not starts:
        return parts.drop("_part").withColumn(name, F.lit(None).cast("long"))
    offsets = F.expr("array(" + ",".join(f"{starts.get(p, 0)}L" for p in range(max(starts) + 1)) + ")")
    rank = F.row_number().over(Window.partitionBy("_part").orderBy(*order))
    return parts.withColumn(name, F.element_at(offsets, F.col("_part") + 1) + rank).drop("_part")
