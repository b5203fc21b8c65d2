"""From verdicts to actions: assessment, decision tree, authorization, evidence and claims."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: A token score from which a match without containment is probable; roles in order.
PROBABLE_SCORE = 12.0
ROLES = ["symptom", "change", "release", "action", "context"]


def assess(kind: Column, features: dict[str, Column]) -> Column:
    """A struct: allowed, basis. A declared kind decides; else what the report states has to show a failure."""
    some = lambda n: F.size(features[n]) > 0
    names_it = some("subject_package") | some("subject_path")
    seen = F.array_compact(F.array(
        F.when(some("error"), F.lit("error")), F.when(some("cause"), F.lit("cause")), F.when(names_it & some("behavior"), F.lit("package_and_symptom")),
        F.when(features.get("unbound", F.lit(False)), F.lit("unbound_failure")), F.when(some("structural") & some("behavior"), F.lit("symbol_and_behaviour")),
    ))
    declared = kind.isin("failure", "question", "idea")
    allowed = F.when(kind == "failure", True).when(declared, False).otherwise(F.size(seen) > 0)
    return F.struct(allowed.alias("allowed"), F.when(declared, F.concat(F.lit("declared_"), kind)).otherwise(F.concat_ws(",", seen)).alias("basis"))


def decide(applicability: Column, user_version: Column, first_release: Column, contains: Column, score: Column) -> Column:
    """A struct: action, status, target.

    The order is the meaning: a contradiction, then an unknown version, then no containment, then the
    three values of "already contained". Only a false one proposes an upgrade.
    """
    unknown = user_version.isNull() | (user_version == "")
    step = (
        F.when(applicability == "hard_contradiction", "collect:conflicting").when(applicability == "unresolved_version", "collect:unresolved_version")
        .when(first_release.isNull(), F.when(score >= PROBABLE_SCORE, "collect:probable").otherwise("collect:possible")).when(unknown | contains.isNull(), "collect:version_needed")
        .when(contains, "collect:already_contains").otherwise("upgrade:actionable")
    )
    step = F.when((applicability == "possible_contradiction") & step.isin("collect:probable", "upgrade:actionable"), "collect:conflicting").otherwise(step)
    action = F.substring_index(step, ":", 1)
    return F.struct(action.alias("action"), F.substring_index(step, ":", -1).alias("status"), F.when(action == "upgrade", first_release).alias("target"))


def authorize(stated: Column, failing: Column, related: Column, confirm: Column, digest: Column) -> Column:
    """Whether a proposal may be acted on: its reading was confirmed, or a package that the report states is
    one that the candidate (or its family) blames. Else it stays a proposal."""
    return F.when(confirm.isNotNull() & (confirm == digest), "confirmed").when(F.arrays_overlap(stated, F.array_union(failing, related)), "stated_package").otherwise("proposal_only")


def reading_digest(*columns: Column) -> Column:
    """Twelve hex digits over what was understood of a report."""
    return F.substring(F.sha2(F.to_json(F.struct(*[c.alias(f"c{i}") for i, c in enumerate(columns)])), 256), 1, 12)


def evidence_id(kind: str | Column, locator: Column) -> Column:
    kind = F.lit(kind) if isinstance(kind, str) else kind
    return F.concat_ws(":", F.lit("ev"), kind, F.when(kind == "commit", F.substring(locator, 1, 12)).otherwise(locator))


def packet(items: DataFrame) -> DataFrame:
    """Evidence once per request and id; a role other than context wins; in the order of roles, then ids."""
    rank = F.array_position(F.array(*[F.lit(r) for r in ROLES]), F.col("role")).cast("int")
    w = Window.partitionBy("request_id", "evidence_id").orderBy("_r")
    once = items.withColumn("_r", rank).withColumn("_n", F.row_number().over(w)).where("_n = 1")
    return once.withColumn("position", F.row_number().over(Window.partitionBy("request_id").orderBy("_r", "evidence_id"))).drop("_r", "_n")


def verify(claims: DataFrame, evidence: DataFrame) -> DataFrame:
    """Claims (request_id, claim_id, type, evidence_ids) with those of their ids that nothing backs.

    A claim without evidence, or with some missing, is dropped (``supported`` false).
    """
    cited = claims.select("request_id", "claim_id", F.explode_outer("evidence_ids").alias("evidence_id"))
    absent = cited.join(evidence.select("request_id", "evidence_id").distinct(), ["request_id", "evidence_id"], "left_anti").where("evidence_id IS NOT NULL")
    lost = absent.groupBy("request_id", "claim_id").agg(F.array_sort(F.collect_set("evidence_id")).alias("missing"))
    out = claims.join(lost, ["request_id", "claim_id"], "left").withColumn("missing", F.coalesce("missing", F.array().cast("array<string>")))
    return out.withColumn("supported", (F.size("missing") == 0) & (F.size(F.coalesce("evidence_ids", F.array().cast("array<string>"))) > 0))


def revoke(decisions: DataFrame, verified: DataFrame) -> DataFrame:
    """An action whose same-incident claim or own claim isn't supported becomes a request for more."""
    broken = verified.where(~F.col("supported") & F.col("type").isin("same_incident", "action")).select("request_id").distinct().withColumn("_broken", F.lit(True))
    out = decisions.join(broken, "request_id", "left")
    held = F.col("_broken").isNotNull()
    return out.withColumn("action", F.when(held, "collect").otherwise(F.col("action"))).withColumn("target", F.when(~held, F.col("target"))).withColumn("status", F.when(held, "unsupported").otherwise(F.col("status"))).drop("_broken")


def resolve_context(observations: DataFrame, catalog: DataFrame) -> DataFrame:
    """Per workspace: the repository that its packages name, if it is one, and the version of best source.

    Observations: workspace_id, name, version, priority (1 is best). Catalog: name, repo_id.
    """
    named = observations.join(catalog, "name", "left")
    w = Window.partitionBy("workspace_id").orderBy("priority", "name", "version")
    versions = observations.where("version IS NOT NULL").withColumn("_n", F.row_number().over(w)).where("_n = 1").select("workspace_id", F.col("version").alias("core_version"))
    repos = named.groupBy("workspace_id").agg(F.count_distinct("repo_id").alias("repos"), F.min("repo_id").alias("_one"))
    return repos.join(versions, "workspace_id", "left").select("workspace_id", F.when(F.col("repos") == 1, F.col("_one")).alias("repo_id"), (F.col("repos") > 1).alias("ambiguous"), "core_version")
