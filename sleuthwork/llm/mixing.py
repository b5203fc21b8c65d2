"""Mixing sources to target weights: Sainte-Laguë quotas of equal-token blocks, seeded block selection.

Targets. Every source has a weight; together the sources are to give as many words as the corpus
has, in proportion to the weights, but none more than ``MAX_REPEATS`` times its own. What is above
is shared among the others by weight until none is above (``targets`` solves this directly).

Quotas. A source's words, its documents in a seeded order one after the other, are cut into blocks of
``BLOCK`` words. The mix has as many blocks as its words fill; Sainte-Laguë gives these seats to the sources
by highest quotients target / (2 s + 1). The sequence of seats is dealt to ``SHARDS`` output shards in equal
runs, so each shard has an integer quota of each source (``shard_quotas``).

Selection. A seeded permutation puts a source's blocks in order; shard after shard takes as many of them as
its quota says, going on where the shard before ended and from the start again after the last. So a source
with b blocks and quota q gives each block q // b times, and q % b of them once more. ``taken`` sums a
document's words in selected blocks, so it is at most ``MAX_REPEATS`` times its size; ``shard_words`` has
them by shard.

Sources are ordered by code point, null last; weights 1, 2, 3 repeat. The totals of sources
(one row a source, not a document) are what the driver holds.

Null text has no words and is not taken. A null doc_id is ordered by its text. Ties (one doc_id) are ordered
by size, then by a hash of the text; repeated rows are documents of their own, and take adjoining words. An
empty table gives no rows. Long texts are cut in blocks like any other. Extra columns pass through
``mixed_documents``; names that begin with ``_sw_`` are kept for it.
"""

from __future__ import annotations

import math
from fractions import Fraction

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ._common import materialize, shuffle_width

BLOCK = 64
MAX_REPEATS = 3
SEED = 20240917
SHARDS = 16
#: A prime above any number of blocks: its powers are strides that meet every block once.
PRIME = (1 << 61) - 1
WORD = r"[^\x20\x09-\x0D]+"


def targets(sizes: list[int], weights: list[int], total: int | None = None) -> list[float]:
    """Words wanted of each source; see above."""
    left = Fraction(sum(sizes) if total is None else total)
    out = [Fraction(0)] * len(sizes)
    free = sorted((i for i in range(len(sizes)) if sizes[i]), key=lambda i: Fraction(MAX_REPEATS * sizes[i], weights[i]))
    weight = sum(weights[i] for i in free)
    for i in free:
        cap = Fraction(MAX_REPEATS * sizes[i])
        out[i] = min(cap, left * weights[i] / weight)
        left, weight = left - out[i], weight - weights[i]
    return [float(x) for x in out]


def sainte_lague(votes: list[float], seats: int, caps: list[int]) -> list[int]:
    """Seats by highest quotients votes / (2 s + 1), ties to the earlier source, none above its cap.

    A party gets as many seats as it has quotients at or above the last one that gets a seat; the
    value of that one is found by bisection, so the work doesn't grow with the seats.
    """
    seats = min(seats, sum(c for c, v in zip(caps, votes, strict=True) if v > 0))
    at = lambda price: [min(c, max(0, math.floor((v / price + 1) / 2))) if v > 0 else 0 for v, c in zip(votes, caps, strict=True)]
    if seats <= 0:
        return [0] * len(votes)
    low, high = 0.0, 2 * max(votes)
    for _ in range(200):
        mid = (low + high) / 2
        if mid <= low or mid >= high:
            break
        low, high = (mid, high) if sum(at(mid)) >= seats else (low, mid)
    out = at(high)
    while sum(out) < seats:
        i = max((i for i in range(len(votes)) if out[i] < caps[i] and votes[i] > 0), key=lambda i: (votes[i] / (2 * out[i] + 1), -i))
        out[i] += 1
    return out


def shard_quotas(votes: list[float], seats: int, caps: list[int], shards: int) -> list[list[int]]:
    """Each shard's quota of each source: the seats of the sequence that fall to the shard."""
    steps = [sainte_lague(votes, seats * k // shards, caps) for k in range(1, shards + 1)]
    return [[b - a for a, b in zip(prev, now, strict=True)] for prev, now in zip([[0] * len(votes), *steps], steps, strict=False)]


def _permutation(blocks: int, number: int, seed: int = SEED) -> tuple[int, int]:
    """Stride and shift of the permutation of a source's blocks 0..blocks-1."""
    return (pow(PRIME, 1 + (seed + 7 * number) % 11, blocks), seed * (number + 1) % blocks) if blocks > 1 else (1, 0)


def n_words(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def plan(sizes: list[tuple[str | None, int]]) -> list[dict]:
    """Target, quota and block permutation of each source."""
    order = sorted(sizes, key=lambda s: (s[0] is None, s[0] or ""))
    weights = [1 + i % 3 for i in range(len(order))]
    words = [s for _, s in order]
    want = targets(words, weights)
    blocks = [-(-s // BLOCK) for s in words]
    # A source's last block is short: its votes are counted in words a mean block has.
    votes = [t * b / s if s else 0.0 for t, b, s in zip(want, blocks, words, strict=True)]
    quotas = shard_quotas(votes, round(sum(votes)), [MAX_REPEATS * b for b in blocks], SHARDS)
    out = []
    for i, (name, size) in enumerate(order):
        a, c = _permutation(blocks[i], i)
        ends = [sum(q[i] for q in quotas[: k + 1]) for k in range(SHARDS)]
        out.append({"source": name, "source_size": size, "target": want[i], "blocks": max(1, blocks[i]), "ends": ends, "a": a, "c": c})
    return out


PLAN = T.StructType([T.StructField("source", T.StringType()), *[T.StructField(n, T.LongType()) for n in ("source_size", "blocks", "a", "c")], T.StructField("ends", T.ArrayType(T.LongType())), T.StructField("target", T.DoubleType())])


def sized(docs: DataFrame, *keep: str) -> DataFrame:
    """source, doc_id, size, the seeded order and a hash of the text; ``keep`` as well."""
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    named = F.coalesce(F.col("doc_id").cast("string"), F.concat(F.lit("?"), text))
    order = F.conv(F.substring(F.md5(F.concat(F.lit(f"{SEED}:"), named)), 1, 15), 16, 10).cast("long")
    return docs.select(F.col("source").cast("string").alias("_sw_source"), F.col("doc_id").alias("_sw_id"), n_words(text).alias("_sw_size"), order.alias("_sw_h"), F.xxhash64(text).alias("_sw_tie"), *keep)


def mix(rows: DataFrame, totals: DataFrame | None = None) -> DataFrame:
    """Adds source_size, target, taken, shard_words and parts to the rows of ``sized``.

    ``parts``: for each shard that takes words of the document, how often it takes which words [from, to).
    ``totals`` are the same rows without what was kept, if reading them is cheaper.
    """
    spark = rows.sparkSession
    totals = rows if totals is None else totals
    made = plan([(r["_sw_source"], r["s"] or 0) for r in totals.groupBy("_sw_source").agg(F.sum("_sw_size").alias("s")).collect()])
    table = spark.createDataFrame([tuple(p[f.name] for f in PLAN.fields) for p in made], PLAN)
    key = lambda c: F.coalesce(F.concat(F.lit("s"), c), F.lit("n"))  # noqa: E731  null-safe, and the same key for window and joins
    table = table.select(key(F.col("source")).alias("_sw_key"), F.struct("source_size", "target", "blocks", "a", "c", "ends").alias("_sw_p"))
    # Positions of the documents' words in their source: sums over ranges of the order, then within a
    # range; neither window holds more than a range's rows or a source's ranges.
    n = max(64, 8 * shuffle_width(spark))
    keyed = lambda df: df.withColumn("_sw_key", key(F.col("_sw_source"))).withColumn("_sw_b", F.floor(F.col("_sw_h") / float(1 << 60) * n).cast("int"))
    per = keyed(totals).groupBy("_sw_key", "_sw_b").agg(F.sum("_sw_size").alias("_sw_n"))
    before = per.select("_sw_key", "_sw_b", (F.sum("_sw_n").over(Window.partitionBy("_sw_key").orderBy("_sw_b")) - F.col("_sw_n")).alias("_sw_before"))
    inside = Window.partitionBy("_sw_key", "_sw_b").orderBy("_sw_h", F.col("_sw_id").asc_nulls_first(), "_sw_size", "_sw_tie").rowsBetween(Window.unboundedPreceding, 0)
    out = keyed(rows).withColumn("_sw_in", F.sum("_sw_size").over(inside) - F.col("_sw_size")).join(before, ["_sw_key", "_sw_b"])
    # One row a source: small next to any broadcast bound, else the join is left to the optimizer.
    out = out.join(F.broadcast(table) if len(made) <= 100_000 else table, "_sw_key")
    out = out.withColumn("_sw_s", F.col("_sw_before") + F.col("_sw_in")).withColumn("_sw_e", F.col("_sw_s") + F.col("_sw_size"))
    p = F.col("_sw_p")
    numbers = F.when(F.col("_sw_size") > 0, F.sequence(F.floor(F.col("_sw_s") / BLOCK), F.floor((F.col("_sw_e") - 1) / BLOCK))).otherwise(F.array().cast("array<bigint>"))
    # (a * j + c) mod blocks: in decimals where the product may not fit 64 bits.
    wide = lambda j: F.pmod(p["a"].cast("decimal(19,0)") * j.cast("decimal(18,0)") + p["c"], p["blocks"].cast("decimal(19,0)")).cast("long")
    place = lambda j: F.when(p["blocks"] < 3_000_000_000, F.pmod(p["a"] * j + p["c"], p["blocks"])).otherwise(wide(j))
    block = lambda j: F.struct(place(j).alias("at"), (F.greatest(j * BLOCK, F.col("_sw_s")) - F.col("_sw_s")).alias("from"), (F.least((j + 1) * BLOCK, F.col("_sw_e")) - F.col("_sw_s")).alias("to"))
    out = out.withColumn("_sw_blocks", F.transform(numbers, block))
    # Block at place x of the order is taken at x, x + blocks, ...: so often below the place ``end``.
    times = lambda end, x: F.greatest(F.lit(0).cast("long"), F.floor((end - x + p["blocks"] - 1) / p["blocks"]))
    got = lambda end: F.aggregate("_sw_blocks", F.lit(0).cast("long"), lambda acc, b: acc + times(end, b["at"]) * (b["to"] - b["from"]))
    out = out.withColumn("_sw_sums", F.transform(p["ends"], got))
    words = F.transform("_sw_sums", lambda x, i: x - F.when(i > 0, F.get("_sw_sums", i - 1)).otherwise(0))
    return out.select("*", p["source_size"].alias("source_size"), p["target"].alias("target"), F.coalesce(got(F.element_at(p["ends"], -1)), F.lit(0)).alias("taken"), words.alias("shard_words"))


def mixed(docs: DataFrame) -> DataFrame:
    """The contract's rows, and the words that each shard takes."""
    out = mix(materialize(sized(docs), "mix-sizes"))
    return out.select(F.col("_sw_id").alias("doc_id"), F.col("_sw_size").alias("size"), "source_size", "target", "taken", "shard_words")


def mixed_documents(docs: DataFrame) -> DataFrame:
    """The mix itself, with the columns of ``docs``: each document once for every time that all its blocks
    are taken, and once more with the words of the blocks that are taken once more (n_chars is counted anew)."""
    if clash := [c for c in docs.columns if c.startswith("_sw_")]:
        raise ValueError(f"columns {clash} have names that are kept for this operator")
    row = docs.select(F.struct(*docs.columns).alias("_sw_row"), *[c for c in ("doc_id", "text", "source")])
    p, text = F.col("_sw_p"), F.col("_sw_row")["text"].cast("string")
    quota = F.element_at(p["ends"], -1)
    full, rest = F.floor(quota / p["blocks"]).cast("int"), quota % p["blocks"]
    out = mix(sized(row, "_sw_row"), materialize(sized(docs), "mix-sizes")).where("taken > 0")
    out = out.select("_sw_row", full.alias("_sw_full"), F.filter("_sw_blocks", lambda b: b["at"] < rest).alias("_sw_ranges"))
    # The words are a column of their own: inside the lambda they would be cut anew for every range.
    out = out.withColumn("_sw_words", F.when(F.size("_sw_ranges") > 0, F.regexp_extract_all(text, F.lit(WORD), F.lit(0))))
    part = F.array_join(F.flatten(F.transform("_sw_ranges", lambda r: F.slice("_sw_words", (r["from"] + 1).cast("int"), (r["to"] - r["from"]).cast("int")))), " ")
    texts = F.concat(F.array_repeat(text, F.col("_sw_full")), F.when(F.size("_sw_ranges") > 0, F.array(part)).otherwise(F.array().cast("array<string>")))
    out = out.select("_sw_row", F.explode(texts).alias("_sw_text"))
    new = {"text": F.col("_sw_text"), "n_chars": F.length("_sw_text")}
    return out.select(*[new[f.name].cast(f.dataType).alias(f.name) if f.name in new else F.col("_sw_row")[f.name].alias(f.name) for f in docs.schema.fields])


#: The same rows in DuckDB: seats are ranked by their quotients.
SQL = r"""
WITH d AS (SELECT doc_id, source, len(regexp_extract_all(coalesce(text, ''), '[^ 	-
]+'))::BIGINT AS size, ('0x' || substr(md5('20240917:' || coalesce(doc_id::VARCHAR, '?' || coalesce(text, ''))), 1, 15))::BIGINT AS h FROM documents),
s AS (SELECT source, sum(size)::BIGINT AS size, row_number() OVER (ORDER BY source NULLS LAST) - 1 AS i FROM d GROUP BY source),
w AS (SELECT *, 1 + i % 3 AS weight, 3 * size AS cap, (size + 63) // 64 AS b FROM s),
r AS (SELECT *, row_number() OVER o AS n, (SELECT sum(size) FROM w) - (sum(cap) OVER o - cap) AS rest, sum(weight) OVER (ORDER BY cap / weight, i ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS heavy FROM w WHERE size > 0 WINDOW o AS (ORDER BY cap / weight, i ROWS UNBOUNDED PRECEDING)),
f AS (SELECT rest, heavy FROM r WHERE cap * heavy >= rest * weight ORDER BY n LIMIT 1),
t AS (SELECT w.*, CASE WHEN size = 0 THEN 0.0 WHEN cap * heavy <= rest * weight THEN cap::DOUBLE ELSE (rest * weight)::DOUBLE / heavy::DOUBLE END AS target FROM w, f),
v AS (SELECT *, CASE WHEN size > 0 THEN target * b / size ELSE 0 END AS vote, list_reduce(list_prepend(1::HUGEINT % greatest(b, 1), list_transform(range(0, 1 + (20240917 + 7 * i) % 11), lambda x: 2305843009213693951::HUGEINT % greatest(b, 1))), lambda x, y: x * y % greatest(b, 1)) AS a, (20240917::HUGEINT * (i + 1)) % greatest(b, 1) AS c FROM t),
q AS (SELECT i, b, s, row_number() OVER (ORDER BY vote / (2 * s + 1) DESC, i) AS place FROM (SELECT i, b, vote, unnest(range(0, 3 * b)) AS s FROM v WHERE vote > 0)),
n AS (SELECT round(sum(vote))::BIGINT AS seats FROM v),
g AS (SELECT i, s % b AS at, list_filter(range(0, 16), lambda k: place <= seats * (k + 1) // 16)[1] AS shard FROM q, n WHERE place <= seats),
p AS (SELECT doc_id, size, i, h, sum(size) OVER (PARTITION BY i ORDER BY h, doc_id NULLS FIRST, size ROWS UNBOUNDED PRECEDING) - size AS lo, row_number() OVER () AS row FROM d JOIN s s2(source2, size2, i) ON d.source IS NOT DISTINCT FROM source2),
k AS (SELECT row, p.i, j, least((j + 1) * 64, lo + p.size) - greatest(j * 64, lo) AS n FROM (SELECT *, unnest(range((lo // 64)::BIGINT, ((lo + size - 1) // 64 + 1)::BIGINT)) AS j FROM p WHERE size > 0) p),
m AS (SELECT row, shard, sum(n)::BIGINT AS n FROM k JOIN v ON v.i = k.i JOIN g ON g.i = k.i AND g.at = (v.a * k.j + v.c) % greatest(v.b, 1) GROUP BY ALL),
z AS (SELECT row, sum(n)::BIGINT AS taken, map_from_entries(list((shard, n))) AS got FROM m GROUP BY row)
SELECT doc_id, p.size, v.size AS source_size, target, coalesce(taken, 0)::BIGINT AS taken, list_transform(range(0, 16), lambda x: coalesce(got[x], 0)::BIGINT) AS shard_words FROM p JOIN v ON v.i = p.i LEFT JOIN z USING (row)
"""
