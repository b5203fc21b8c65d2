"""Document fingerprints: a Merkle tree over paragraphs and sections. Native: SQL functions only.

A *paragraph* (leaf) is a run of text up to and with its closing ``. ! ? |`` or line break; a run
without one is cut after 240 characters. Each leaf is hashed with SHA-256. A *section* ends after a
leaf whose digest starts with 0 or 1, so section borders depend on content alone and an insertion
moves none but its own. A section's digest is over its leaf digests, the root over the sections'.

A fingerprint is text: ``root|leaf,leaf,|leaf,...`` with the leaves cut to 16 hex digits. Equal roots
mean equal texts; sections, then leaves, that differ locate an edit (``differing_sections``).

Null text counts as the empty text. Its tree has no leaf; two empty texts have likeness 1.
Rows with one doc_id are ordered by text; a null doc_id comes before all others. Extra columns are
ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ._common import bucket_of, shuffle_width, splitters

LEAF = r"[^.!?|\n]{1,240}[.!?|\n]*[ \t]*|[.!?|\n]+[ \t]*"


def leaf_digests(text: Column) -> Column:
    pieces = F.regexp_extract_all(text, F.lit(LEAF), F.lit(0))
    return F.transform(pieces, lambda p: F.sha2(p, 256))


def sections(digests: Column) -> Column:
    """Each section as one string: its leaf digests, each with a comma after it."""
    closing = lambda d: F.substring(d, 1, 1).isin("0", "1")
    marked = F.array_join(F.transform(digests, lambda d: F.concat(d, F.when(closing(d), F.lit(",|")).otherwise(F.lit(",")))), "")
    return F.filter(F.split(marked, r"\|"), lambda s: s != "")


def root(parts: Column) -> Column:
    return F.sha2(F.array_join(F.transform(parts, lambda s: F.sha2(s, 256)), ""), 256)


def fingerprint(text: Column) -> Column:
    """The fingerprint of a text column as a string."""
    parts = sections(leaf_digests(F.coalesce(text, F.lit(""))))
    cut = F.transform(parts, lambda s: F.regexp_replace(s, "([0-9a-f]{16})[0-9a-f]{48}", "$1"))
    return F.concat(root(parts), F.lit("|"), F.array_join(cut, "|"))


def leaves(mark: Column) -> Column:
    """The distinct leaves of a fingerprint."""
    return F.array_distinct(F.filter(F.split(F.substring(mark, 66, 2**31 - 1), "[|,]+"), lambda x: x != ""))


def likeness(a: Column, b: Column) -> Column:
    """Shared leaves of two fingerprints over the mean number of their leaves, from 0 to 1."""
    x, y = leaves(a), leaves(b)
    total = F.size(x) + F.size(y)
    return F.when(F.substring(a, 1, 64) == F.substring(b, 1, 64), F.lit(1.0)).otherwise(F.coalesce(2.0 * F.size(F.array_intersect(x, y)) / F.when(total > 0, total), F.lit(0.0)))


def differing_sections(a: Column, b: Column) -> Column:
    """Numbers of the sections of ``b`` that ``a`` lacks; only those branches are gone into."""
    mine, other = F.split(F.substring(a, 66, 2**31 - 1), r"\|"), F.split(F.substring(b, 66, 2**31 - 1), r"\|")
    found = F.filter(F.transform(other, lambda s, i: F.struct(i.alias("i"), F.array_contains(mine, s).alias("same"))), lambda x: ~x["same"])
    return F.when(F.substring(a, 1, 64) == F.substring(b, 1, 64), F.array().cast("array<int>")).otherwise(F.transform(found, lambda x: x["i"]))


def with_next(df: DataFrame, payload: list[str], prefix: str = "next_") -> DataFrame:
    """Adds each row's ``payload`` of the row with the next doc_id; after the last comes the first.

    The rows are dealt to ranges of doc_id. The first row of a range is also sent to the range
    before it, so each window is complete without a global sort, and each text is shuffled once.
    """
    cuts = splitters(df, "doc_id", 4 * shuffle_width(df.sparkSession))
    low = df.agg(F.min("doc_id").alias("m"), F.max(F.col("doc_id").isNull()).alias("n")).first()
    key = F.col("doc_id")
    own = bucket_of(key, cuts)
    first = key.isNull() if low["n"] else key.eqNullSafe(F.lit(low["m"]))
    places = [F.struct(own.alias("b"), F.lit(0).alias("late"), F.lit(False).alias("extra"))]
    if cuts:
        places.append(F.when(key.isin(cuts), F.struct((own - 1).alias("b"), F.lit(0).alias("late"), F.lit(True).alias("extra"))))
    places.append(F.when(first, F.struct(F.lit(len(cuts)).alias("b"), F.lit(1).alias("late"), F.lit(True).alias("extra"))))
    dealt = df.withColumn("_at", F.explode(F.array_compact(F.array(*places)))).select("*", "_at.*").drop("_at")
    w = Window.partitionBy("b").orderBy("late", F.col("doc_id").asc_nulls_first(), "text")
    return dealt.select("*", *[F.lead(c).over(w).alias(prefix + c) for c in payload]).where(~F.col("extra")).drop("b", "late", "extra")


def edited(text: Column, following: Column) -> Column:
    """The last quarter (rounded down) of a text replaced by as much of the next one's start."""
    n = F.length(text)
    q = F.floor(n / 4).cast("int")
    return F.concat(F.substring(text, F.lit(1), n - q), F.substring(following, F.lit(1), q))


def fingerprint_documents(docs: DataFrame) -> DataFrame:
    """Fingerprints of all documents and of their edited texts."""
    base = docs.select("doc_id", F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    marked = base.withColumn("fingerprint", fingerprint(F.col("text")))
    paired = with_next(marked, ["text", "fingerprint"])
    made = paired.withColumn("_edited", edited(F.col("text"), F.col("next_text")))
    made = made.withColumn("edited_fingerprint", fingerprint(F.col("_edited")))
    return made.select(
        "doc_id", F.length("text").cast("long").alias("n_chars"), F.sha2("_edited", 256).alias("edited_sha256"), "fingerprint", "edited_fingerprint",
        likeness(F.col("fingerprint"), F.col("edited_fingerprint")).alias("near_edited"), likeness(F.col("fingerprint"), F.col("next_fingerprint")).alias("near_next"),
    )


#: The same rows in DuckDB.
SQL = rf"""
WITH d AS (SELECT doc_id, coalesce(text, '') AS text FROM documents),
o AS (SELECT doc_id, text, coalesce(lead(text) OVER w, first_value(text) OVER w) AS nxt FROM d WINDOW w AS (ORDER BY doc_id, text ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING)),
e AS (SELECT doc_id, text, nxt, substr(text, 1, length(text) - length(text) // 4) || substr(nxt, 1, length(text) // 4) AS ed FROM o),
t AS (SELECT *, [text, ed, nxt] AS three FROM e),
l AS (SELECT doc_id, text, ed, list_transform(three, lambda x: list_transform(regexp_extract_all(x, '{LEAF}'), lambda p: sha256(p))) AS ds FROM t),
s AS (SELECT doc_id, text, ed, list_transform(ds, lambda z: list_filter(string_split(array_to_string(list_transform(z, lambda d: d || CASE WHEN d[1] IN ('0', '1') THEN ',|' ELSE ',' END), ''), '|'), lambda q: q <> '')) AS ps FROM l),
f AS (SELECT doc_id, text, ed, list_transform(ps, lambda z: sha256(coalesce(array_to_string(list_transform(z, lambda q: sha256(q)), ''), '')) || '|' || coalesce(array_to_string(list_transform(z, lambda q: regexp_replace(q, '([0-9a-f]{{16}})[0-9a-f]{{48}}', '\1', 'g')), '|'), '')) AS fs FROM s),
g AS (SELECT *, list_transform(fs, lambda z: list_distinct(list_filter(regexp_split_to_array(substr(z, 66), '[|,]+'), lambda q: q <> ''))) AS vs FROM f)
SELECT doc_id, length(text)::BIGINT AS n_chars, sha256(ed) AS edited_sha256, fs[1] AS fingerprint, fs[2] AS edited_fingerprint,
  CASE WHEN fs[1][1:64] = fs[2][1:64] THEN 1.0 ELSE coalesce(2.0 * len(list_intersect(vs[1], vs[2])) / nullif(len(vs[1]) + len(vs[2]), 0), 0.0) END::DOUBLE AS near_edited,
  CASE WHEN fs[1][1:64] = fs[3][1:64] THEN 1.0 ELSE coalesce(2.0 * len(list_intersect(vs[1], vs[3])) / nullif(len(vs[1]) + len(vs[3]), 0), 0.0) END::DOUBLE AS near_next
FROM g
"""
