"""Releases, commits and links: ancestry, containment, changes."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions import text as fn
from ..functions import versions as ver
from .tables import shared

#: What path evidence is worth, and the least that is believed.
TAIL3, TAIL2, BASENAME, PER_TOKEN, MIN_CHANGE_SCORE, MAX_FILES = 4.0, 2.0, 0.5, 0.5, 3.0, 60
FIX_SUBJECT = r"(?i)\b(fix(e[sd])?|bug|resolve[sd]?|repair|correct|prevent|avoid|handle|guard)\b"


#: Levels that are taken one by one, levels at one stride before it doubles, the longest stride, and the most pairs
#: an edge that a stride's table may have for it to double again.
PLAIN, LEVELS, MAX_STRIDE, SPREAD = 32, 4, 64, 256
#: Turns that a frontier may go up without being compared with earlier ones.
UNCOMPARED = 8


def ancestors(commits: DataFrame, starts: DataFrame) -> DataFrame:
    """``start, sha``: every commit reachable from a start by parents, itself included.

    Starts go up in blocks of 64 that follow each other in their order: a row (block, sha) has a bit for each
    start that is at the commit in this turn, and pairs are made of bits in the returned plan only, where nothing
    moves. So starts that reach a commit over as many edges share its row; others have a row each until the end.

    A frontier goes up until it brings no new bit. It is compared with all earlier ones when half as many rows
    as those have come since the last time, or after UNCOMPARED turns: a bit that was in one before has all its
    ancestors met. Edges and earlier rows outside of the frontier's least and greatest sha, or its parents', stay
    where they are, which spares most of them where parents have smaller ids. After PLAIN levels it goes up by strides. A stride has two tables of (sha, parent): what is
    exactly so many edges up, the next frontier, and what is within. It doubles as long as the history goes on,
    by joining the tables with themselves, so ten thousand levels take some two hundred turns.
    """
    spark = commits.sparkSession
    root = f"{shared(spark)}/sleuthwork/ancestors-{uuid.uuid4().hex}"

    def written(df: DataFrame, name: str) -> DataFrame:
        df.write.parquet(f"{root}/{name}")
        return spark.read.schema(df.schema).parquet(f"{root}/{name}")

    def above(low: DataFrame, high: DataFrame) -> DataFrame:
        return low.withColumnRenamed("parent", "_mid").join(high.select(F.col("sha").alias("_mid"), "parent"), "_mid").select("sha", "parent")

    def merged(df: DataFrame, mask: str = "_mask") -> DataFrame:
        return df.groupBy("_block", "sha").agg(F.bit_or("_mask").alias(mask))

    # A partition's numbers begin at a multiple of 2^33, so no block is in two.
    numbered = starts.select("start").distinct().repartitionByRange("start").sortWithinPartitions("start").withColumn("_n", F.monotonically_increasing_id())
    numbered = written(numbered, "starts").withColumn("_block", F.shiftright("_n", 6))
    exact = within = written(commits.select("sha", F.explode("parents").alias("parent")).where("sha IS NOT NULL AND parent IS NOT NULL").distinct(), "edges")
    most, stride = SPREAD * exact.count(), 1
    frontier = written(numbered.select("_block", F.col("start").alias("sha"), F.expr("shiftleft(1L, CAST(_n & 63 AS INT))").alias("_mask")), "frontier-0")
    schema, found, seen, last = frontier.schema, [], [f"{root}/frontier-0"], 0
    compared = since = 0
    while (now := frontier.agg(F.count("*").alias("rows"), F.min("sha").alias("low"), F.max("sha").alias("high")).first())["rows"]:
        n = len(seen)
        since += now["rows"]
        if n >= PLAIN and n % LEVELS == 0 and stride < MAX_STRIDE and within.count() <= most:
            stride *= 2
            within = written(within.unionByName(above(exact, within)).distinct(), f"within-{stride}")
            exact = written(above(exact, exact).distinct(), f"exact-{stride}")
        ahead = lambda table: table.where(F.col("sha").between(now["low"], now["high"]))  # noqa: E731, B023
        up = lambda table: merged(frontier.join(ahead(table), "sha").select("_block", F.col("parent").alias("sha"), "_mask"))  # noqa: E731, B023
        if stride > 1:
            up(within).write.parquet(f"{root}/found-{n}")
            found.append(f"{root}/found-{n}")
        reached = up(exact)
        if 2 * since >= compared or n - last >= UNCOMPARED:
            to = ahead(exact).agg(F.min("parent").alias("low"), F.max("parent").alias("high")).first()
            known = merged(spark.read.schema(schema).parquet(*seen).where(F.col("sha").between(to["low"], to["high"])), "_known")
            fresh = F.col("_mask").bitwiseAND(F.bitwise_not(F.coalesce("_known", F.lit(0).cast("long"))))
            reached = reached.join(known, ["_block", "sha"], "left").select("_block", "sha", fresh.alias("_mask")).where("_mask <> 0")
            compared, since, last = compared + since, 0, n
        frontier = written(reached, f"frontier-{n}")
        seen.append(f"{root}/frontier-{n}")
    every = merged(spark.read.schema(schema).parquet(*seen, *found).repartition("_block"))
    names = numbered.groupBy("_block").agg(F.sort_array(F.collect_list(F.struct("_n", "start"))).getField("start").alias("_starts"))
    pairs = every.join(names, "_block").select("sha", "_mask", F.posexplode("_starts").alias("_bit", "start"))
    return pairs.where("shiftright(_mask, _bit) & 1 = 1").select("start", "sha")


def containment(commits: DataFrame, tags: DataFrame, wanted: DataFrame) -> DataFrame:
    """``sha, tag, contains`` for the tags (tag, sha) of each wanted commit that contain it, and, with null, for
    those of which the tag's commit or the wanted one is unknown. What is known and not listed isn't contained.
    """
    known = commits.select("sha").distinct()
    wanted = wanted.select("sha").distinct()
    reach = ancestors(commits, tags.join(known, "sha", "left_semi").select(F.col("sha").alias("start")))
    held = reach.join(wanted, "sha").join(tags.select("tag", F.col("sha").alias("start")), "start").select("sha", "tag", F.lit(True).alias("contains"))
    strange = wanted.join(known, "sha", "left_anti").select("sha", F.lit(None).cast("string").alias("tag"), F.lit(None).cast("boolean").alias("contains"))
    lost = tags.join(known, "sha", "left_anti").select(F.lit(None).cast("string").alias("sha"), "tag", F.lit(None).cast("boolean").alias("contains"))
    return held.unionByName(strange).unionByName(lost)


def first_releases(contained: DataFrame) -> DataFrame:
    """Per commit: the first release that has it, and the first that isn't a pre-release."""
    key = ver.version_key(F.col("tag"))
    rows = contained.where("contains").withColumn("_k", key).where("_k IS NOT NULL").withColumn("_pre", ver.is_prerelease(F.col("tag")))
    return rows.groupBy("sha").agg(F.min_by("tag", "_k").alias("first_release"), F.min_by(F.when(~F.col("_pre"), F.col("tag")), F.when(~F.col("_pre"), F.col("_k"))).alias("first_stable"))


def already_contains(user_version, first_release):
    """True, false, or null where either can't be ordered."""
    return ver.version_key(user_version) >= ver.version_key(first_release)


def release_pairs(releases: DataFrame, last: int = 6) -> DataFrame:
    """Consecutive releases of a repository, the newest ``last`` of them."""
    w = Window.partitionBy("repo_id").orderBy("_k", "tag")
    rows = releases.withColumn("_k", ver.version_key(F.col("tag"))).where("_k IS NOT NULL")
    rows = rows.withColumn("next_tag", F.lead("tag").over(w)).withColumn("_n", F.row_number().over(w)).where("next_tag IS NOT NULL")
    newest = Window.partitionBy("repo_id").orderBy(F.desc("_n"))
    return rows.withColumn("age", F.row_number().over(newest)).where(F.col("age") <= last).drop("_k", "_n")


def linked_change(issues: DataFrame, relations: DataFrame, pulls: DataFrame) -> DataFrame:
    """Issue, its CLOSES edge (by object or by ``issue:n``), the pull request and its merge commit.

    The alternative in the edge's target is a union of two joins. The earliest relation wins.
    """
    closes = relations.where("type = 'closes'")
    by_id = issues.join(closes, issues["object_id"] == closes["dst_object_id"]).select(issues["object_id"], closes["relation_id"], closes["src_object_id"])
    refs = issues.select("object_id", F.concat(F.lit("issue:"), F.col("number").cast("string")).alias("dst_ref"))
    by_ref = refs.join(closes, "dst_ref").select("object_id", "relation_id", "src_object_id")
    merged = by_id.unionByName(by_ref).distinct().join(pulls.select(F.col("object_id").alias("src_object_id"), "merge_sha"), "src_object_id").where("merge_sha IS NOT NULL")
    w = Window.partitionBy("object_id").orderBy("relation_id")
    return merged.withColumn("n", F.row_number().over(w)).where("n = 1").select("object_id", F.col("src_object_id").alias("pull_id"), "merge_sha", F.lit(100.0).alias("score"))


def path_change(symptoms: DataFrame, commits: DataFrame, tokens: DataFrame | None = None) -> DataFrame:
    """The commit that best fits a report's source paths.

    Symptoms: request_id, path (tails of two or three parts, or a file name). Commits: sha, subject,
    parents, files, position (order of time). Fix subjects, no merges, at most 60 files; a file name
    alone never carries a commit. Ties go to the earliest.
    """
    fixes = commits.where(F.col("subject").rlike(FIX_SUBJECT) & (F.size("parents") < 2) & (F.size("files") <= MAX_FILES))
    parts = F.split(F.lower("file"), "/")
    n = F.size(parts)
    tails = F.array(
        F.struct(F.array_join(F.slice(parts, F.greatest(n - 2, F.lit(1)), 3), "/").alias("tail"), F.lit(3).alias("k")),
        F.struct(F.array_join(F.slice(parts, F.greatest(n - 1, F.lit(1)), 2), "/").alias("tail"), F.lit(2).alias("k")),
        F.struct(F.element_at(parts, -1).alias("tail"), F.lit(1).alias("k")),
    )
    rows = fixes.select("sha", "subject", "position", F.explode("files").alias("file")).select("sha", "subject", "position", "file", F.explode(tails).alias("t"))
    rows = rows.select("sha", "subject", "position", "file", "t.*").where(F.size(F.split("tail", "/")) == F.col("k"))
    worth = F.when(F.col("k") == 3, TAIL3).when(F.col("k") == 2, TAIL2).otherwise(BASENAME)
    hits = symptoms.join(rows, F.col("path") == F.col("tail")).groupBy("request_id", "sha", "subject", "position", "file").agg(F.max(worth).alias("w"))
    scored = hits.groupBy("request_id", "sha", "subject", "position").agg(F.sum("w").alias("score"), F.max("w").alias("best"))
    if tokens is not None:
        words = tokens.groupBy("request_id").agg(F.collect_set("token").alias("_t"))
        scored = scored.join(words, "request_id", "left").withColumn("score", F.col("score") + PER_TOKEN * F.coalesce(F.size(F.filter("_t", lambda t: F.lower("subject").contains(t))), F.lit(0))).drop("_t")
    good = scored.where((F.col("best") > BASENAME) & (F.col("score") >= MIN_CHANGE_SCORE))
    return good.groupBy("request_id").agg(F.max_by(F.struct("sha", "score"), F.struct("score", (-F.col("position")).alias("p"))).alias("c")).select("request_id", "c.sha", "c.score")


def resolve_change(linked: DataFrame, inferred: DataFrame) -> DataFrame:
    """The native link where there is one, else the inferred change."""
    rest = inferred.join(linked.select("request_id"), "request_id", "left_anti")
    basis = lambda df, b: df.select("request_id", "sha", "score", F.lit(b).alias("basis"))
    return basis(linked, "linked").unionByName(basis(rest, "inferred"))


def reference_edges(df: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """``object_id, kind, value, confidence`` of the references in texts: the first of each kind and value,
    whatever its case."""
    rows = df.select(F.col(key).alias("object_id"), F.posexplode(fn.references(F.col(text))).alias("i", "r")).select("object_id", "i", "r.*")
    return rows.groupBy("object_id", "kind", F.lower("value").alias("_v")).agg(F.min_by(F.struct("value", "confidence"), "i").alias("r")).select("object_id", "kind", "r.*")


def package_family(packages: DataFrame, manifests: DataFrame, retrieval: bool = False) -> DataFrame:
    """``name, related``: of two names one continues the other after a boundary sign, and the repository
    publishes both (for retrieval: one of them).

    Ancestors are found by a name's own prefixes (an equi-join), not by comparing all names.
    """
    owned = manifests.select("name").distinct()
    names = packages.select("name").unionByName(owned).distinct()
    cut = F.transform(F.filter(F.sequence(F.lit(2), F.greatest(F.length("name"), F.lit(2))), lambda i: F.substring("name", i, F.lit(1)).isin("-", "/", ".")), lambda i: F.substring("name", F.lit(1), i - 1))
    up = names.select("name", F.explode(cut).alias("related")).join(names.select(F.col("name").alias("related")), "related", "left_semi").select("name", "related")
    mark = lambda c: owned.select(F.col("name").alias(c), F.lit(True).alias(f"_{c}"))
    up = up.join(mark("name"), "name", "left").join(mark("related"), "related", "left")
    left, right = F.col("_name").isNotNull(), F.col("_related").isNotNull()
    up = up.where((left | right) if retrieval else (left & right)).select("name", "related")
    return up.unionByName(up.select(F.col("related").alias("name"), F.col("name").alias("related"))).distinct()
