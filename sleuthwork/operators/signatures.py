"""Typed symptom features as long rows, and their frequencies."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import fixed as V
from ..functions import text as fn

VALUE_LIMIT = 300


KINDS = ("error", "structural", "subject_path", "behavior", "component", "cause")


def feature_arrays(sig: Column, low: Column | None = None, folded: Column | None = None) -> dict[str, Column]:
    """The feature classes of a normalised text that are read without a subject: one array each."""
    error = F.array_distinct(fn.lowered(F.concat(fn.find_all(sig, V.EXCEPTION), fn.find_all(sig, V.ERROR_CODE))))
    camel = F.filter(fn.find_all(sig, V.CAMEL), lambda c: F.length(c) >= 6)
    shapes = fn.lowered(F.concat(fn.find_all(sig, V.DUNDER), fn.find_all(sig, V.DOTTED), camel, fn.find_all(sig, V.HTTP_ROUTE)))
    return {
        "error": error, "structural": F.array_except(F.array_distinct(shapes), error), "subject_path": fn.path_tails(fn.source_paths(sig, low)),
        "behavior": fn.behaviour(sig), "component": fn.components(sig, low), "cause": fn.causes(sig, folded),
    }


def _tagged(kind: str, values: Column) -> Column:
    return F.transform(values, lambda v: F.struct(F.lit(kind).alias("kind"), F.substring(v, 1, VALUE_LIMIT).alias("value")))


def mine(df: DataFrame, key: str = "doc_id", text: str = "text", kinds: tuple[str, ...] = KINDS) -> DataFrame:
    """``object_id, kind, value`` of each text, of the classes asked for, with the extractor's version."""
    rows = df.where(F.col(text).isNotNull()).select(F.col(key).alias("object_id"), fn.normalize(F.col(text)).alias("_sig"))
    # Columns of their own, so that the text is lower-cased once and not for each pattern.
    rows = rows.withColumns({"_low": F.lower("_sig"), "_folded": fn.folded(F.col("_sig"))})
    arrays = {k: a for k, a in feature_arrays(F.col("_sig"), F.col("_low"), F.col("_folded")).items() if k in kinds}
    rows = rows.withColumns({f"_{k}": a for k, a in arrays.items()})
    every = F.concat(*[_tagged(k, F.col(f"_{k}")) for k in arrays])
    rows = rows.select("object_id", F.explode(F.array_distinct(every)).alias("f"))
    return rows.select("object_id", "f.kind", "f.value", F.lit(V.FEATURE_EXTRACTOR_VERSION).alias("extractor_version"))


def fingerprints(df: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    return fn.with_fingerprint(df.select(key, text), F.col(text)).drop(text)


def frequencies(signatures: DataFrame) -> DataFrame:
    """Objects that have a value, whatever its kind."""
    return signatures.select("object_id", "value").distinct().groupBy("value").agg(F.count("*").alias("doc_freq"))


def store(existing: DataFrame, mined: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Rows to append (those that exist are left as they are), and one row of attempted and inserted."""
    keys = ["object_id", "kind", "value"]
    fresh = mined.dropDuplicates(keys).join(existing.select(*keys), keys, "left_anti")
    return fresh, mined.agg(F.count("*").alias("attempted")).crossJoin(fresh.agg(F.count("*").alias("inserted")))


def require_fresh(signatures: DataFrame) -> None:
    """Raise if rows of another extractor are there."""
    if not signatures.where(~F.col("extractor_version").eqNullSafe(F.lit(V.FEATURE_EXTRACTOR_VERSION))).isEmpty():
        raise ValueError("stale signatures: mine them again")


def object_text(units: DataFrame, objects: DataFrame, limit: int = 20_000) -> DataFrame:
    """Title and units of an object and its comments in order, cut to a length."""
    owner = objects.select("object_id", F.coalesce("parent_id", "object_id").alias("thread"))
    rows = units.join(owner, "object_id").groupBy("thread").agg(F.array_sort(F.collect_list(F.struct("object_id", "seq", "text"))).alias("u"))
    titles = objects.select(F.col("object_id").alias("thread"), F.coalesce("title", F.lit("")).alias("title"))
    body = F.concat_ws("\n", F.when(F.col("title") != "", F.col("title")), F.array_join(F.transform("u", lambda x: x["text"]), "\n"))
    return rows.join(titles, "thread").select(F.col("thread").alias("object_id"), F.substring(body, 1, limit).alias("text"))


def module_names(signatures: DataFrame) -> DataFrame:
    """Module names that packages and paths of the corpus vouch for."""
    value = F.col("value")
    name = F.when(value.startswith("@") & value.contains("/"), F.element_at(F.split(value, "/"), 2)).when(value.contains("/"), F.element_at(F.split(value, "/"), 1))
    rows = signatures.where(F.col("kind").isin("subject_package", "subject_dependency", "subject_path")).select(name.alias("module"))
    return rows.where(F.col("module").contains("-") & (F.length("module") >= 6)).distinct()


def current_revision(revisions: DataFrame) -> DataFrame:
    """Per object, the body observed last is current; a body seen before may become current again."""
    w = Window.partitionBy("object_id").orderBy(F.desc("observed_at"), F.desc("body_hash"))
    return revisions.withColumn("is_current", F.row_number().over(w) == 1)
