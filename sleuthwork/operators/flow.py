"""From candidates to an answer: families, budget, identity, the accepted incident, claims and records.

Everything is for many requests at once: a row has a request_id, and what the steps hand on are tables.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import fixed as V
from . import identity, signatures, subjects, upsert
from .tables import bounded, materialize

FLAGS = ("pointed", "pointed_unnamed", "unbound")


# --- features of a text, and the two sides of the gate ---------------------------------------------

def stated_text(df: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """``object_id, text, quoted``: the text with its quotations blanked, and whether there were any."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            spans = [subjects.quoted_spans(t) for t in pdf["text"]]
            texts = [subjects.blank(t, s) for t, s in zip(pdf["text"], spans, strict=True)]
            yield pd.DataFrame({"object_id": pdf["object_id"], "text": texts, "quoted": [bool(s) for s in spans]})

    rows = df.where(F.col(text).isNotNull()).select(F.col(key).cast("long").alias("object_id"), F.col(text).alias("text"))
    return rows.mapInPandas(run, "object_id long, text string, quoted boolean")


def extract(df: DataFrame, key: str = "doc_id", text: str = "text", modules: list[str] | None = None) -> DataFrame:
    """``object_id, view, kind, value``: all features of a text (view ``all``), and those without its quotations
    (view ``stated``, of texts that quote; a row of kind ``quotes`` marks those). Roles come from what is stated in both; strings from the whole in one."""
    plain = stated_text(df, key, text)
    roles = subjects.classify(df, key, text, modules).where("view = 'stated'").select("object_id", "kind", "value")
    whole = signatures.mine(df, key, text).select(F.col("object_id").cast("long").alias("object_id"), "kind", "value")
    # What Python reads is written, as both views and their marks are made of it.
    roles, quoting = materialize(roles, "roles"), materialize(plain.where("quoted"), "quoting")
    bare = signatures.mine(quoting, "object_id", "text").select("object_id", "kind", "value")
    view = lambda rows, name: rows.select("object_id", F.lit(name).alias("view"), "kind", "value")
    stated = bare.unionByName(roles.join(quoting.select("object_id"), "object_id", "left_semi"))
    marks = quoting.select("object_id", F.lit("quotes").alias("kind"), F.lit("true").alias("value"))
    return view(whole.unionByName(roles), "all").unionByName(view(stated.unionByName(marks), "stated")).distinct()


def sides(features: DataFrame) -> DataFrame:
    """``object_id, side, stated``: the structs that the identity cascade reads. ``stated`` is null where an
    object quotes nothing. An object's features are bounded by its text."""
    values = lambda kind: F.array_sort(F.collect_set(F.when(F.col("kind") == kind, F.col("value")))).alias(kind)
    flags = [F.coalesce(F.bool_or(F.col("kind") == f), F.lit(False)).alias(f) for f in FLAGS]
    rows = features.groupBy("object_id", "view").agg(*[values(c) for c in identity.CLASSES], *flags)
    made = rows.select("object_id", "view", F.struct(*identity.CLASSES, *FLAGS).alias("s"))
    pick = lambda v: F.first(F.when(F.col("view") == v, F.col("s")), ignorenulls=True)
    return made.groupBy("object_id").agg(pick("all").alias("side"), pick("stated").alias("stated"))


# --- candidates ------------------------------------------------------------------------------------

def mark_families(candidates: DataFrame, packages: DataFrame, asked: DataFrame, related: DataFrame) -> DataFrame:
    """Adds ``family_related``: a package of the candidate (object_id, name) is one that the request asks about
    (request_id, name), or related to one (name, related)."""
    near = asked.select("request_id", "name").unionByName(asked.join(related, "name").select("request_id", F.col("related").alias("name"))).distinct()
    # One row an object and one a request: names meet in their lists, so no request's candidates go to one task.
    wanted = bounded(near.groupBy("request_id").agg(F.collect_set("name").alias("_near")), "near")
    have = packages.groupBy("object_id").agg(F.collect_set("name").alias("_have"))
    rows = candidates.join(wanted, "request_id", "left").join(have, "object_id", "left")
    return rows.withColumn("family_related", F.coalesce(F.arrays_overlap("_have", "_near"), F.lit(False))).select(*candidates.columns, "family_related")


def ranked(candidates: DataFrame, limit: int = V.MAX_CANDIDATES) -> DataFrame:
    """Per request: family first, then by token score, feature hits and id; the first ``limit``, with ``position``."""
    w = Window.partitionBy("request_id").orderBy(F.desc("family_related"), F.desc("token_score"), F.desc("feature_hits"), "object_id")
    return candidates.withColumn("position", F.row_number().over(w)).where(F.col("position") <= limit)


def budgeted(candidates: DataFrame, checks: int = V.MAX_IDENTITY_CHECKS) -> DataFrame:
    """Adds ``checked``: every family-related candidate, and others in order while checks are left."""
    all_ = Window.partitionBy("request_id")
    family = F.count_if(F.col("family_related")).over(all_)
    rest = F.sum(F.when(F.col("family_related"), 0).otherwise(1)).over(all_.orderBy("position"))
    return candidates.withColumn("checked", F.col("family_related") | (rest <= F.greatest(checks - family, F.lit(0))))


def feature_lists(signatures_: DataFrame, wanted: DataFrame) -> DataFrame:
    """``request_id, object_id, hits``: the shared values of each kind, as a map of sorted lists."""
    shared = signatures_.select("object_id", "kind", "value").distinct().join(wanted.select("request_id", "kind", "value").distinct(), ["kind", "value"])
    lists = shared.groupBy("request_id", "object_id", "kind").agg(F.array_sort(F.collect_set("value")).alias("v"))
    return lists.groupBy("request_id", "object_id").agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct("kind", "v")))).alias("hits"))


def identify(candidates: DataFrame, requests: DataFrame, objects: DataFrame, frequencies: DataFrame | None = None, corpus: int = 0, family: DataFrame | None = None, anchors: DataFrame | None = None, stated: DataFrame | None = None, checks: int = V.MAX_IDENTITY_CHECKS) -> DataFrame:
    """Candidates with ``checked``, ``rejection``, ``rule``, ``score`` and ``accepted``.

    ``candidates`` come from ``ranked``; ``requests`` (request_id, side, stated) and ``objects`` (object_id, side,
    stated) from ``sides``; ``family`` has (name, related). Anchors (request_id, kind, value) that an accepted
    candidate doesn't state (``stated``: object_id, kind, value) turn it down.
    """
    rows = budgeted(candidates)
    q = requests.select("request_id", F.col("side").alias("q"), F.col("stated").alias("q_stated"))
    c = objects.select("object_id", F.col("side").alias("c"), F.col("stated").alias("c_stated"))
    none = identity.empty_side()
    pairs = rows.where("checked").select("request_id", "object_id").join(q, "request_id", "left").join(c, "object_id", "left").withColumn("q", F.coalesce("q", none)).withColumn("c", F.coalesce("c", none))
    pairs = pairs.withColumn("_pair", F.xxhash64("request_id", "object_id"))
    if family is not None:
        names = pairs.select("request_id", F.explode(F.array_distinct(F.flatten(F.array(*[F.col("q")[k] for k in ("subject_package", "subject_dependency", "healthy", "conflicted", "unresolved")])))).alias("name")).distinct()
        maps = names.join(family, "name").groupBy("request_id", "name").agg(F.array_sort(F.collect_set("related")).alias("r")).groupBy("request_id").agg(F.map_from_entries(F.collect_list(F.struct("name", "r"))).alias("family"))
        pairs = pairs.join(maps, "request_id", "left").withColumn("family", F.coalesce("family", F.create_map().cast("map<string,array<string>>")))
    judged = identity.evaluate(pairs, frequencies, corpus).select("request_id", "object_id", "rejection", "rule", "score", "accepted")
    if anchors is not None and stated is not None:
        wanted = judged.where("accepted").select("request_id", "object_id").join(anchors, "request_id")
        lost = identity.anchors_missing(wanted, stated).select("request_id", "object_id").distinct().withColumn("_lost", F.lit(True))
        judged = judged.join(lost, ["request_id", "object_id"], "left")
        gone = F.col("_lost").isNotNull()
        judged = judged.withColumn("rejection", F.when(gone, "structured_anchor_mismatch").otherwise(F.col("rejection"))).withColumn("rule", F.when(~gone, F.col("rule"))).withColumn("accepted", F.col("accepted") & ~gone).drop("_lost")
    return rows.join(judged, ["request_id", "object_id"], "left").withColumn("accepted", F.coalesce("accepted", F.lit(False)))


def best_accepted(identified: DataFrame) -> DataFrame:
    """Per request the accepted candidate of the highest score; the earlier position wins a tie."""
    w = Window.partitionBy("request_id").orderBy(F.desc("score"), "position")
    return identified.where("accepted").withColumn("_n", F.row_number().over(w)).where("_n = 1").drop("_n")


def rejection_counts(identified: DataFrame) -> DataFrame:
    """``request_id, rejection, n``: candidates that were not accepted, by class."""
    kind = F.coalesce("rejection", F.lit("not_evaluated"))
    return identified.where(~F.col("accepted")).groupBy("request_id", kind.alias("rejection")).agg(F.count("*").alias("n"))


# --- claims and records -----------------------------------------------------------------------------

def claims(matches: DataFrame) -> DataFrame:
    """``request_id, claim_id, type, value, confidence, basis, evidence_ids`` of the accepted matches.

    Matches: request_id, symptom, score, change, derivation (``linked`` or ``inferred``), first_release, user_version,
    contains (boolean or null), conflicts, upgrade (whether it is proposed), symptom_ids, change_ids, release_ids.
    A claim is only made if what it says is there, and it cites what it rests on.
    """
    text = lambda *parts: F.concat(*[F.lit(p) if isinstance(p, str) else F.coalesce(p.cast("string"), F.lit("?")) for p in parts])
    made = lambda kind, value, sure, basis, ids: F.struct(F.lit(kind).alias("type"), value.alias("value"), (F.lit(sure) if isinstance(sure, str) else sure).alias("confidence"), (F.lit(basis) if isinstance(basis, str) else basis).alias("basis"), ids.alias("evidence_ids"))
    c = {n: F.col(n) for n in matches.columns}
    both, linked = F.concat("change_ids", "release_ids"), c["derivation"] == "linked"
    changed = c["change"].isNotNull() & (F.size("change_ids") > 0)
    released = c["first_release"].isNotNull() & (F.size("release_ids") > 0)
    rows = F.concat(
        F.array(made("symptom_match", text("matches ", c["symptom"]), F.when(c["score"] >= V.HIGH_CONFIDENCE_SCORE, "high").otherwise("medium"), "observed", c["symptom_ids"])),
        F.array(
            F.when(changed, made("change", text(F.when(linked, "closed by ").otherwise("likely changed by "), c["change"]), F.when(linked, "high").otherwise("medium"), F.when(linked, "explicit").otherwise("inferred"), c["change_ids"])),
            F.when(released, made("released_in", text("first contained in ", c["first_release"]), "high", "deterministic", both)),
            F.when(released & c["contains"], made("affected_in", text(c["user_version"], " already contains the change of ", c["first_release"]), "high", "deterministic", both)),
            F.when(released & ~c["contains"] & c["upgrade"], made("action", text("upgrade to ", c["first_release"]), "medium", "deterministic", both)),
        ),
        F.transform(F.array_distinct(F.coalesce("conflicts", F.array().cast("array<string>"))), lambda x: made("conflict", x, "high", "explicit", c["symptom_ids"])),
    )
    return matches.select("request_id", F.posexplode(F.array_compact(rows)).alias("claim_id", "x")).select("request_id", "claim_id", "x.*")


RECORD = ["repo_id", "incident_key", "signature", "symptom_id", "fix_commit", "first_release", "derivation", "evidence_level", "updated_at"]


def store_incidents(existing: DataFrame, derived: DataFrame) -> DataFrame:
    """Records by (repo, key): a derived one renews what it says, and keeps how it was reviewed. That something was
    verified at run time is never set by deriving it."""
    fresh = upsert.latest(derived.select(*RECORD), ["repo_id", "incident_key"], ["updated_at", "symptom_id"])
    old = existing.select("repo_id", "incident_key", "review_state", "runtime_verified", *[F.col(c).alias(f"o_{c}") for c in RECORD[2:]], F.lit(True).alias("_o"))
    both = fresh.withColumn("_n", F.lit(True)).join(old, ["repo_id", "incident_key"], "full_outer")
    pick = [F.when(F.col("_n").isNotNull(), F.col(c)).otherwise(F.col(f"o_{c}")).alias(c) for c in RECORD[2:]]
    return both.select("repo_id", "incident_key", *pick, F.coalesce("review_state", F.lit("derived")).alias("review_state"), F.coalesce("runtime_verified", F.lit(False)).alias("runtime_verified"))


def review_incidents(policies: DataFrame, issues: DataFrame, pulls: DataFrame, releases: DataFrame, closes: DataFrame, firsts: DataFrame) -> DataFrame:
    """Reviewed incidents (key, issue, pull, merge_commit, first_release) with ``error``: what no longer holds, or null.

    issues (number), pulls (number, merge_sha), releases (tag), closes (pull, issue, derivation: only ``native``
    counts), firsts (sha, first_release).
    """
    flag = lambda df, *keys: df.select(*keys).distinct().withColumn("_" + "_".join(keys), F.lit(True))
    rows = policies.join(flag(issues.withColumnRenamed("number", "issue"), "issue"), "issue", "left")
    rows = rows.join(pulls.select(F.col("number").alias("pull"), F.col("merge_sha").alias("_sha"), F.lit(True).alias("_pull")), "pull", "left")
    rows = rows.join(flag(releases.withColumnRenamed("tag", "first_release"), "first_release"), "first_release", "left")
    rows = rows.join(flag(closes.where("derivation = 'native'"), "pull", "issue"), ["pull", "issue"], "left")
    rows = rows.join(firsts.select(F.col("sha").alias("merge_commit"), F.col("first_release").alias("_first")), "merge_commit", "left")
    error = (
        F.when(F.col("_issue").isNull() | F.col("_pull").isNull() | F.col("_first_release").isNull(), "missing_issue_pull_or_release").when(F.col("_pull_issue").isNull(), "pull_does_not_close_issue")
        .when(~F.coalesce(F.col("_sha") == F.col("merge_commit"), F.lit(False)), "merge_commit_changed").when(~F.coalesce(F.col("_first") == F.col("first_release"), F.lit(False)), "other_first_release")
    )
    return rows.select("key", "issue", "pull", "merge_commit", "first_release", error.alias("error"))


def recent(df: DataFrame, order: str, limit: int, *ties: str) -> DataFrame:
    """The last rows in an order: incidents by date, releases by key (the limit is what it is for)."""
    return df.orderBy(F.desc(order), *ties).limit(limit)


def reference_list(edges: DataFrame, limit: int = V.MAX_REFERENCES) -> DataFrame:
    """Distinct references, the first of them in order."""
    return edges.select("kind", "value").distinct().orderBy("kind", "value").limit(limit)


def untagged(tags: DataFrame, releases: DataFrame, ignore: str | None = None) -> DataFrame:
    """Tags (repo_id, tag, sha) that no release has; they bound versions as well."""
    kept = tags.where(~F.col("tag").rlike(ignore)) if ignore else tags
    return kept.join(releases.select("repo_id", "tag").distinct(), ["repo_id", "tag"], "left_anti")


def resolve_evidence(cited: DataFrame, known: DataFrame) -> DataFrame:
    """Cited ids (``ev:kind:locator``) with the row that they name (kind, locator, object_id): a commit by the
    first twelve digits of its sha, all others by the whole locator."""
    key = lambda k, loc: F.concat_ws(":", k, F.when(k == "commit", F.substring(loc, 1, 12)).otherwise(loc))
    named = known.select(key(F.col("kind"), F.col("locator")).alias("_key"), "object_id").groupBy("_key").agg(F.min("object_id").alias("object_id"))
    parts = cited.withColumn("_key", key(F.regexp_extract("evidence_id", r"^ev:([^:]+):", 1), F.regexp_extract("evidence_id", r"^ev:[^:]+:(.*)$", 1)))
    return parts.join(named, "_key", "left").drop("_key")


def inventory(objects: DataFrame, key: str = "repo_id") -> DataFrame:
    """Objects of each kind, and of those the open ones and the comments, per repository."""
    return objects.groupBy(key, "kind").agg(F.count("*").alias("n"), F.count_if(F.col("state") == "open").alias("open"), F.count_if(F.col("parent_id").isNotNull()).alias("comments"))
