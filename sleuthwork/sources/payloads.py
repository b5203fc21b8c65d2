"""Readers of connector payloads and tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

COMMENT = "struct<id:string,body:string,createdAt:string,replies:struct<nodes:array<struct<id:string,body:string,createdAt:string>>>>"
DISCUSSION = (
    "id string, number long, title string, body string, url string, createdAt string, updatedAt string, lastEditedAt string, closed boolean, "
    f"author struct<login:string>, category struct<name:string>, comments struct<totalCount:long,nodes:array<{COMMENT}>>"
)
WORK_ITEM = (
    "id string, number long, title string, body string, state string, createdAt string, updatedAt string, closedAt string, mergedAt string, "
    "mergeCommit struct<oid:string>, closingIssuesReferences struct<nodes:array<struct<id:string,number:long,url:string>>>"
)
RELEASE = "tagName string, name string, description string, isPrerelease boolean, isDraft boolean, publishedAt string, tagCommit struct<oid:string>"


def read_table(spark: SparkSession, root: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{root}/{name}.parquet")


def read_json(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """JSON lines with a fixed schema: no inference pass."""
    return spark.read.schema(schema).json(path)


def timestamp(text) -> F.Column:
    """An ISO time, null where it isn't one."""
    return F.try_to_timestamp(text)


def discussions(nodes: DataFrame) -> DataFrame:
    """Threads, comments and replies as source objects; comments and replies point to their thread."""
    top = nodes.select(F.col("id").alias("native_id"), F.lit("discussion").alias("kind"), F.lit(None).cast("string").alias("parent"), "number", "title", "body", timestamp("createdAt").alias("created_at"), timestamp(F.coalesce("lastEditedAt", "updatedAt")).alias("updated_at"))
    comments = nodes.select(F.col("id").alias("parent"), F.explode("comments.nodes").alias("c"))
    row = lambda df, c: df.select(F.col(f"{c}.id").alias("native_id"), F.lit("comment").alias("kind"), "parent", F.lit(None).cast("long").alias("number"), F.lit(None).cast("string").alias("title"), F.col(f"{c}.body").alias("body"), timestamp(F.col(f"{c}.createdAt")).alias("created_at"), timestamp(F.col(f"{c}.createdAt")).alias("updated_at"))
    replies = comments.select("parent", F.explode("c.replies.nodes").alias("r"))
    return top.unionByName(row(comments, "c")).unionByName(row(replies, "r"))


def work_items(nodes: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Issues or pull requests, and (pull, issue) pairs that a pull request closes."""
    items = nodes.select(F.col("id").alias("native_id"), "number", "title", "body", F.lower("state").alias("state"), timestamp("updatedAt").alias("updated_at"), F.col("mergeCommit.oid").alias("merge_sha"))
    closes = nodes.select(F.col("id").alias("pull"), F.explode("closingIssuesReferences.nodes").alias("i")).select("pull", F.col("i.id").alias("issue"), F.concat(F.lit("issue:"), F.col("i.number").cast("string")).alias("dst_ref"))
    return items, closes


def releases(nodes: DataFrame, ignore: str | None = None, drafts: bool = False) -> DataFrame:
    """Releases; drafts are left out unless asked for, and so are tags that match ``ignore``."""
    rows = nodes.select(F.col("tagName").alias("tag"), "isPrerelease", "isDraft", timestamp("publishedAt").alias("published_at"), F.col("tagCommit.oid").alias("sha"))
    rows = rows if drafts else rows.where(~F.coalesce("isDraft", F.lit(False)))
    return rows.where(~F.col("tag").rlike(ignore)) if ignore else rows


def probe(surfaces: DataFrame) -> DataFrame:
    """The surface on which a repository is supported, and whether it has pull requests to follow."""
    d, i, p = F.col("discussions"), F.col("issues"), F.col("pulls")
    main = F.when(d > F.greatest(i, F.lit(50)), "discussions").when(i > 0, "issues").when(d > 0, "discussions").otherwise("none")
    return surfaces.withColumn("primary_support_surface", main).withColumn("has_pr_chain", p > 0)


def git_log(lines: DataFrame) -> DataFrame:
    """Lines of ``git log`` with 0x1f between fields (sha, parents, time, subject, files)."""
    f = F.split("value", "\x1f")
    words = lambda i, sep: F.filter(F.split(F.get(f, F.lit(i)), sep), lambda x: x != "")
    return lines.select(F.get(f, F.lit(0)).alias("sha"), words(1, " ").alias("parents"), F.get(f, F.lit(2)).cast("long").alias("committed_at"), F.get(f, F.lit(3)).alias("subject"), words(4, "\t").alias("files"))


def manifests(files: DataFrame) -> DataFrame:
    """package.json files (repo_id, path, value) outside of node_modules: name, version, root, dependencies."""
    body = F.from_json("value", "name string, version string, dependencies map<string,string>, peerDependencies map<string,string>")
    rows = files.where(F.col("path").rlike(r"(^|/)package\.json$") & ~F.col("path").contains("node_modules/")).withColumn("_b", body)
    deps = F.array_union(F.coalesce(F.map_keys("_b.dependencies"), F.array().cast("array<string>")), F.coalesce(F.map_keys("_b.peerDependencies"), F.array().cast("array<string>")))
    return rows.where("_b.name IS NOT NULL").select("repo_id", "path", F.lower("_b.name").alias("name"), F.col("_b.version").alias("version"), (~F.col("path").contains("/")).alias("is_root"), F.array_sort(deps).alias("dependencies"))
