"""Sharding by histogram sort: equal bytes in each shard, one exchange.

Rows are ordered by (60 bits of the text's MD5, doc_id), so equal texts stand together. Candidate
boundaries (probes) are counted exactly: one pass sums rows and bytes between neighbouring probes over
all partitions, and only these sums reach the driver. The first pass takes ``1 << BINS`` even ranges of the
hash as its probes; each target (a multiple of the mean shard) then keeps the bracket of keys around it, and
the next probes cut the brackets, until a bracket holds one row or one group of equal texts.

A target inside a group of at most ``TOLERANCE`` of a shard is moved to the nearer end of the group; in a
larger group the bracket goes on over doc_ids. So the boundaries are determined by the rows alone, and
shards differ by no more than the tolerance and a row.

Each shard is cut into ``PARTS`` parts in the same way, but only roughly. The exchange goes to the parts, and a row's
slot is its rank in its part plus the exact row counts of the parts before it, so no window holds
more than a part.

Null text: size 1, CRC 0. Null doc_id: before all others. Repeated rows get slots of their own; rows of one
text and doc_id are one key, which no boundary cuts. Long texts: a shard may exceed the mean by one row. An
empty table gives no rows. Of extra columns none is read.
"""

from __future__ import annotations

import bisect

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ._common import materialize, shuffle_width

LOW, HIGH = -(1 << 63), (1 << 63) - 1
#: Bits of the hash, and of the first pass's ranges of it.
BITS, BINS = 60, 14
PROBES = 1024
TOLERANCE = 0.01
ROUNDS = 40

Key = tuple[int, int]


def slim(docs: DataFrame) -> DataFrame:
    """What the boundaries and the result need: no texts."""
    text = F.col("text").cast("string")
    return docs.select(
        F.col("doc_id").cast("long").alias("doc_id"), (F.coalesce(F.octet_length(text), F.lit(0)) + 1).cast("long").alias("size"),
        F.crc32(F.coalesce(text, F.lit("")).cast("binary")).alias("text_crc32"), F.conv(F.substring(F.md5(F.coalesce(text, F.lit("")).cast("binary")), 1, 15), 16, 10).cast("long").alias("h"), F.coalesce(F.col("doc_id").cast("long"), F.lit(LOW)).alias("d"),
    )


def _search(probes: list[Key], h: Column, d: Column) -> Column:
    """How many of the ascending probes are at or below (h, d): a scan in two steps."""
    rows = "array(" + ",".join(f"named_struct('h', {_long(a)}, 'd', {_long(b)})" for a, b in probes) + ")"
    step = max(1, int(len(probes) ** 0.5))
    heads = "array(" + ",".join(f"named_struct('h', {_long(a)}, 'd', {_long(b)})" for a, b in probes[::step]) + ")"
    me = F.struct(h.alias("h"), d.alias("d"))
    below = lambda arr: F.size(F.filter(arr, lambda p: p <= me))
    block = F.greatest(below(F.expr(heads)) - 1, F.lit(0))
    return block * step + below(F.slice(F.expr(rows), block * step + 1, step))


def _long(v: int) -> str:
    return f"{v}L" if v != LOW else f"(-{HIGH}L - 1L)"


def _between(lo: Key, hi: Key, n: int) -> list[Key]:
    """About ``n`` keys strictly between two keys: over hashes, or over doc_ids of one hash."""
    if hi[0] - lo[0] > 1:
        return [(lo[0] + (hi[0] - lo[0]) * i // (n + 1), LOW) for i in range(1, n + 1)]
    out = []
    for h, a, b in ((lo[0], lo[1], HIGH if hi[0] > lo[0] else hi[1]), *(((hi[0], LOW, hi[1]),) if hi[0] > lo[0] else ())):
        out += [(h, a + (b - a) * i // (n + 1)) for i in range(1, n + 1)]
    return out


def boundaries(rows: DataFrame, shards: int, parts: int, law: str = "bytes", tolerance: float = TOLERANCE) -> tuple[list[Key], list[int]]:
    """The ascending keys at which parts begin (but the first), and the rows of every part."""
    weight = "size" if law == "bytes" else "one"
    rows = rows.withColumn("one", F.lit(1).cast("long"))
    shift = BITS - BINS
    first = rows.groupBy(F.shiftright("h", shift).alias("i")).agg(F.sum(weight).alias("w"), F.count("*").alias("n"), F.min("d").alias("dl"), F.max("d").alias("dh")).collect()
    total, count = sum(r["w"] for r in first), sum(r["n"] for r in first)
    pieces = shards * parts
    if not count:
        return [], [0] * pieces
    least, most = min(r["dl"] for r in first), max(r["dh"] for r in first)
    known: dict[Key, tuple[int, int]] = {(LOW, LOW): (0, 0)}
    w = n = 0
    for r in sorted(first, key=lambda r: r["i"]):
        known[(r["i"] << shift, LOW)] = (w, n)
        w, n = w + r["w"], n + r["n"]
        known[((r["i"] + 1) << shift, LOW)] = (w, n)
    known[(HIGH, HIGH)] = (total, count)
    slack, inner = tolerance * total / shards, max(1.0, 0.1 * total / pieces)
    chosen: dict[int, Key] = {}
    for _ in range(ROUNDS):
        keys = sorted(known)
        sums = [known[k][0] for k in keys]
        brackets = set()
        for t in range(1, pieces):
            if t in chosen:
                continue
            at = total * t // pieces
            i = max(1, bisect.bisect_left(sums, at))  # the first boundary with at least the target below it
            lo, hi = keys[i - 1], keys[i]
            below, width = at - sums[i - 1], sums[i] - sums[i - 1]
            near = lo if below <= width - below else hi
            single = known[hi][1] - known[lo][1] <= 1
            group = lo[1] == LOW and hi == (lo[0] + 1, LOW) or single and lo[1] == LOW and hi[1] in (LOW, HIGH)
            if sums[i] == at:
                chosen[t] = hi
            elif t % parts and min(below, width - below) <= inner:
                chosen[t] = near
            elif group and width <= slack:
                chosen[t] = near
            elif single or hi == (lo[0], lo[1] + 1):
                chosen[t] = hi
            else:
                brackets.add((lo, hi))
        if not brackets:
            break
        probes = set()
        for lo, hi in brackets:
            if lo[0] == hi[0] or hi[0] - lo[0] == 1:  # within one hash: doc_ids only lie in their range
                lo, hi = (lo[0], max(lo[1], least - 1 if least > LOW else LOW)), (lo[0], min(hi[1] if hi[0] == lo[0] else HIGH, most + 1))
                probes.update((lo[0], x) for x in (least, most + 1) if lo[1] < x < hi[1])
            probes.update(_between(lo, hi, max(3, PROBES // len(brackets))))
        cuts = sorted({*(p for p in probes if p not in known), *(k for b in brackets for k in b if k not in ((LOW, LOW), (HIGH, HIGH)))})
        got = rows.groupBy(_search(cuts, F.col("h"), F.col("d")).alias("i")).agg(F.sum(weight).alias("w"), F.count("*").alias("n")).collect()
        w, n, at = 0, 0, {r["i"]: (r["w"], r["n"]) for r in got}
        for i, k in enumerate(cuts):
            a, b = at.get(i, (0, 0))
            w, n = w + a, n + b
            known[k] = (w, n)
    else:
        raise RuntimeError("the boundaries were not found")
    # A part's rough boundary stays between those of its shard.
    ends = [(LOW, LOW), *(chosen[t] for t in range(parts, pieces, parts)), (HIGH, HIGH)]
    out, last = [], (LOW, LOW)
    for t in range(1, pieces):
        k = chosen[t] if t % parts == 0 else min(max(chosen[t], ends[t // parts]), ends[t // parts + 1])
        last = max(last, k)
        out.append(last)
    cum = [0, *(known[k][1] for k in out), count]
    return out, [b - a for a, b in zip(cum, cum[1:], strict=False)]


def shard_documents(rows: DataFrame, shards: int = 16, parts: int | None = None, law: str = "bytes", tolerance: float = TOLERANCE) -> DataFrame:
    """Adds ``shard`` and ``slot`` to rows that have the columns of ``slim`` (others are kept)."""
    parts = parts or max(16, -(-4 * shuffle_width(rows.sparkSession) // shards))
    cuts, counts = boundaries(rows, shards, parts, law, tolerance)
    if not cuts:
        return rows.select("*", F.lit(0).alias("shard"), F.lit(0).cast("long").alias("slot"))
    placed = rows.withColumn("_part", _search(cuts, F.col("h"), F.col("d")).cast("int"))
    offsets, n = [], 0
    for i, c in enumerate(counts):
        n = 0 if i % parts == 0 else n
        offsets.append(n)
        n += c
    start = F.element_at(F.expr("array(" + ",".join(f"{o}L" for o in offsets) + ")"), F.col("_part") + 1)
    w = Window.partitionBy("_part").orderBy("h", "d", "size")
    slot = start + F.row_number().over(w) - 1
    return placed.select("*", F.floor(F.col("_part") / parts).cast("int").alias("shard"), slot.cast("long").alias("slot")).drop("_part")


def sharded(docs: DataFrame, shards: int = 16) -> DataFrame:
    """The contract's rows of the law ``bytes``."""
    rows = materialize(slim(docs), "shard-sizes")
    out = shard_documents(rows, shards)
    return out.select("doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))


#: The same rows in DuckDB (bytes of a character from its code point, CRC-32 byte by byte).
SQL = r"""
WITH c AS (SELECT list_transform(range(0, 256), lambda x: list_reduce(list_prepend(x::UBIGINT, list_transform(range(0, 8), lambda y: 0::UBIGINT)), lambda v, y: CASE WHEN v % 2 = 1 THEN xor(v >> 1, 3988292384::UBIGINT) ELSE v >> 1 END)) AS tab),
b AS (SELECT row_number() OVER () AS row, doc_id, text, flatten(list_transform(list_transform(string_split(coalesce(text, ''), ''), lambda s: ord(s)::BIGINT), lambda p: CASE WHEN p < 128 THEN [p] WHEN p < 2048 THEN [192 + (p >> 6), 128 + p % 64] WHEN p < 65536 THEN [224 + (p >> 12), 128 + (p >> 6) % 64, 128 + p % 64] ELSE [240 + (p >> 18), 128 + (p >> 12) % 64, 128 + (p >> 6) % 64, 128 + p % 64] END)) AS bytes FROM documents),
d AS (SELECT row, doc_id, strlen(coalesce(text, ''))::BIGINT + 1 AS size, ('0x' || substr(md5(coalesce(text, '')), 1, 15))::BIGINT AS h,
  CASE WHEN coalesce(text, '') = '' THEN 0 ELSE xor(list_reduce(list_prepend(4294967295::UBIGINT, list_transform(bytes, lambda y: y::UBIGINT)), lambda v, y: xor(v >> 8, tab[(xor(v, y) % 256 + 1)::BIGINT])), 4294967295::UBIGINT) END::BIGINT AS text_crc32 FROM b, c),
s AS (SELECT *, sum(size) OVER (ORDER BY h, doc_id NULLS FIRST, size ROWS UNBOUNDED PRECEDING) - size AS lo, (SELECT sum(size) FROM d) AS total FROM d),
g AS (SELECT h, min(lo) AS a, sum(size) + min(lo) AS z FROM s GROUP BY h),
t AS (SELECT k, (total * k // 16)::BIGINT AS goal, total FROM (SELECT unnest(range(1, 16)) AS k), (SELECT DISTINCT total FROM s)),
e AS (SELECT k, CASE WHEN z - a <= 0.01 * total / 16 THEN CASE WHEN goal = z THEN z WHEN goal - a <= z - goal THEN a ELSE z END ELSE goal END AS edge FROM t JOIN g ON g.a < goal AND goal <= g.z),
p AS (SELECT s.*, (SELECT count(*) FROM e WHERE e.edge <= s.lo)::INT AS shard FROM s)
SELECT doc_id, size, text_crc32, 'bytes' AS law, shard, row_number() OVER (PARTITION BY shard ORDER BY h, doc_id NULLS FIRST, size) - 1 AS slot, NULL::INT AS grown_shard FROM p
"""
