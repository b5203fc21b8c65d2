"""MinHash near-dedup with tensored banding.

A document's set: its distinct shingles of five words (``[^\\x20\\x09-\\x0D]+``, A-Z lower-cased); with
fewer words its whole sequence; without words it is empty and linked with nothing. Documents are linked
if 100 * |A ∩ B| >= 75 * |A ∪ B|.

Tensored banding. ``HALVES`` small collections of ``ROWS`` minhashes each give a document that many half
keys. A table's key combines a *pair* of half keys, so 16 x 2 = 32 minhashes serve 120 tables of four
rows, which would else need 480. Two documents meet in a table if two of their half keys agree. At
similarity s, with p = s^2, they meet nowhere with chance (1-p)^16 + 16 p (1-p)^15: 4e-5 at the
threshold, 2e-6 at 0.8, below 1e-9 from 0.9 on.

Steps.
1. Equal sets form one class (keyed by a 128-bit digest); only its smallest doc_id goes on. So exact
   copies cost one row each and never meet in a table.
2. Half keys that one class alone has can't bring a meeting. They are dropped first (16 rows a class,
   counted with map-side combining); classes with fewer than two others are done.
3. Shingles that no other class left has are counted per class (its *own* shingles). A link leaves at
   most a quarter of a set outside of the other, so classes with more own shingles are done as well; and
   the sizes and own shingles of two classes bound their similarity (``_possible``).
4. A table's members with one key are a bucket. Buckets are never expanded to all pairs: in a round each
   bucket proposes its members against one of them (the smallest, later the least by a hash of the
   round). Proposals are verified on full sets, links joined to components, and buckets whose members
   are all in one component are done. Rounds go on while they join many. What is left (classes in buckets
   of several components) is compared across components by an exact prefix filter: shingles ordered by
   rarity, pairs that share one among the first n - a + 1 of both (a: the overlap that the sizes ask
   for) are verified. So no link that would join two components is left out, and none that repeats a
   known connection is paid for.
5. Components by alternating large-star and small-star steps over the links between components so far.

An empty table gives no rows; long texts are read whole; of the documents' other columns none is read, and
``deduplicated`` lets them pass.

Nulls: null text is the empty set; rows with null doc_id join their equal sets (component_id is null if
all of a set's rows have none, and such sets get no other links). Repeated rows and rows that share a doc_id have the same rows as any copy would.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ._common import SPACE, Words, arrow_type, claim, discard, distinct_sorted, materialize, mix, slices

SHINGLE = 5
SIMILARITY = 75
HALVES = 16
ROWS = 2
MAX_ROUNDS = 8
#: Bits of the filter per member, and the most there are: with more members the rows are joined without it.
FILTER_SHARE, FILTER_BITS = 10, 1 << 27

_rng = np.random.Generator(np.random.PCG64(7))
_MUL = _rng.integers(1, 2**63, HALVES * ROWS, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_ADD = _rng.integers(0, 2**63, HALVES * ROWS, dtype=np.uint64)

SKETCH = "doc_id long, n long, digest binary, halves array<long>"


def sets(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Sorted distinct shingle hashes of each text, and the texts' offsets."""
    return distinct_sorted(*Words(texts, SPACE).shingles(SHINGLE))


def _digest(part: np.ndarray) -> bytes:
    return hashlib.blake2b(part.tobytes(), digest_size=16).digest()


def half_keys(values: np.ndarray, bounds: np.ndarray) -> np.ndarray:
    """A row of ``HALVES`` half keys for each non-empty set."""
    full = np.flatnonzero(np.diff(bounds) > 0)
    out = np.zeros((len(full), HALVES), np.uint64)
    if not len(full):
        return out.view(np.int64)
    starts = bounds[:-1][full]
    for j in range(HALVES):
        key = np.full(len(full), (j + 1) * 0x9E3779B97F4A7C15 % (1 << 64), np.uint64)
        for r in range(ROWS):
            i = j * ROWS + r
            h = (values ^ _ADD[i]) * _MUL[i]
            h ^= h >> np.uint64(32)
            key = mix(key ^ np.minimum.reduceat(h, starts))
        out[:, j] = key
    return out.view(np.int64)


def sketches(docs: DataFrame) -> DataFrame:
    """doc_id, set size, set digest and half keys of each row."""
    arrow = arrow_type(SKETCH)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        claim()
        for whole in batches:
            for b in slices(whole, "text", 1 << 20):
                values, bounds = sets(b.column("text"))
                n = np.diff(bounds)
                keys = half_keys(values, bounds)
                full = np.flatnonzero(n)
                sizes = np.zeros(len(n), np.int32)
                sizes[full] = HALVES
                offsets = np.concatenate([[0], np.cumsum(sizes)]).astype(np.int32)
                halves = pa.ListArray.from_arrays(pa.array(offsets), pa.array(keys.ravel()))
                digests = [_digest(values[s:e]) if e > s else None for s, e in zip(bounds[:-1].tolist(), bounds[1:].tolist(), strict=True)]
                cols = [b.column("doc_id"), pa.array(n.astype(np.int64)), pa.array(digests, pa.binary()), halves]
                yield pa.RecordBatch.from_arrays([c.cast(f.type) for c, f in zip(cols, arrow, strict=True)], schema=arrow)

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).mapInArrow(run, SKETCH)


def components(links: DataFrame) -> DataFrame:
    """``node, label`` for links (a, b): the least node reachable, for each node that isn't it.

    Large-star and small-star steps in turn until a turn changes nothing (the number of edges and a sum of
    their hashes stay); each is aggregations and joins with one row per node on one side, so a node with
    very many links is no group of its own.
    """
    def mark(df: DataFrame) -> tuple:
        return tuple(df.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first())

    edges = materialize(links.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).where("u <> v").distinct(), "edges")
    before = mark(edges)
    while True:
        both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.join(least, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        down = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(down, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v")
        old, edges = edges, materialize(small.unionByName(down.select("u", F.col("m").alias("v"))).distinct(), "edges")
        discard(old)
        after = mark(edges)
        if after == before:
            return edges.withColumnsRenamed({"u": "node", "v": "label"})
        before = after


def _bloom_places(ids: np.ndarray, bits: int) -> np.ndarray:
    x = ids.astype(np.int64).view(np.uint64)
    return np.stack([mix(x + np.uint64(k * 0x51ED27 + 1)) % np.uint64(bits) for k in range(3)]).astype(np.int64)


def _maybe_in(docs: DataFrame, ids: DataFrame) -> DataFrame:
    """``docs`` (doc_id, text) without most rows whose doc_id isn't in ``ids``.

    A Bloom filter with ``FILTER_SHARE`` bits an id (one other row in 60 stays); its words are or-ed on the
    executors. At most ``FILTER_BITS`` / 64 words reach the driver; where more would be needed, no row is left out.
    """
    bits = 1 << max(12, (FILTER_SHARE * ids.count()).bit_length())
    if bits > FILTER_BITS:
        return docs.where(F.col("doc_id").isNotNull())

    def places(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            p = _bloom_places(b.column("id").drop_null().to_numpy(zero_copy_only=False), bits).ravel()
            yield pa.RecordBatch.from_arrays([pa.array(p >> 6), pa.array((np.uint64(1) << (p & 63).astype(np.uint64)).view(np.int64))], names=["w", "bits"])

    words = ids.select(F.col("doc_id").alias("id")).mapInArrow(places, "w long, bits long").groupBy("w").agg(F.bit_or("bits").alias("bits")).toPandas()
    table = np.zeros(bits // 64, np.uint64)
    table[words["w"].to_numpy(np.int64)] = words["bits"].to_numpy(np.int64).view(np.uint64)
    shared = docs.sparkSession.sparkContext.broadcast(table)
    arrow = arrow_type("doc_id long, text string")

    def keep(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            p = _bloom_places(b.column("doc_id").fill_null(0).to_numpy(zero_copy_only=False), bits)
            hit = ((shared.value[p >> 6] >> (p & 63).astype(np.uint64)) & np.uint64(1)).all(axis=0)
            if hit.any():
                yield b.filter(pa.array(hit)).cast(arrow)

    return docs.where(F.col("doc_id").isNotNull()).mapInArrow(keep, "doc_id long, text string")


def _bodies(docs: DataFrame, members: DataFrame) -> DataFrame:
    """The text of each member class, once: ``node, body``."""
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).where(F.col("text").isNotNull())
    found = _maybe_in(rows, members.select("doc_id")).join(members, "doc_id")
    arrow = arrow_type("node long, body string")

    def check(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        # Rows that share a doc_id may have other texts.
        for whole in batches:
            for b in slices(whole, "text"):
                values, bounds = sets(b.column("text"))
                own = [_digest(values[s:e]) for s, e in zip(bounds[:-1].tolist(), bounds[1:].tolist(), strict=True)]
                same = [x == y for x, y in zip(own, b.column("digest").to_pylist(), strict=True)]
                yield pa.RecordBatch.from_arrays([b.column("node"), b.column("text")], names=["node", "body"]).filter(pa.array(same)).cast(arrow)

    return found.select("node", "digest", "text").mapInArrow(check, "node long, body string").dropDuplicates(["node"])


def own_shingles(bodies: DataFrame) -> DataFrame:
    """``node, own``: how many shingles of each body no other body has (if any)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for b in slices(whole, "body", 256 << 10):
                values, bounds = sets(b.column("body"))
                node = np.repeat(b.column("node").to_numpy(), np.diff(bounds))
                yield pa.RecordBatch.from_arrays([pa.array(values.view(np.int64)), pa.array(node)], names=["h", "node"])

    rows = bodies.mapInArrow(run, "h long, node long")
    single = rows.groupBy("h").agg(F.count("*").alias("c"), F.min("node").alias("node")).where("c = 1")
    return single.groupBy("node").agg(F.count("*").alias("own"))


def verify(pairs: DataFrame, bodies: DataFrame) -> DataFrame:
    """The pairs (a, b) with ``linked``, decided on the full sets of both texts."""
    left = bodies.select(F.col("node").alias("a"), F.col("body").alias("x"))
    right = bodies.select(F.col("node").alias("b"), F.col("body").alias("y"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for b in slices(whole, "y", 1 << 20):
                (v, p), (w, q) = sets(b.column("x")), sets(b.column("y"))
                linked = []
                for i in range(b.num_rows):
                    s, t = v[p[i] : p[i + 1]], w[q[i] : q[i + 1]]
                    both = np.concatenate([s, t])
                    both.sort()
                    common = int((both[1:] == both[:-1]).sum())
                    linked.append(common > 0 and 100 * common >= SIMILARITY * (len(s) + len(t) - common))
                yield pa.RecordBatch.from_arrays([b.column("a"), b.column("b"), pa.array(linked, pa.bool_())], names=["a", "b", "linked"])

    # The pairs go to their first text, then with it to the second: texts of members only move.
    return pairs.join(left, "a").join(right, "b").select("a", "b", "x", "y").mapInArrow(run, "a long, b long, linked boolean")


def prefix_pairs(nodes: DataFrame, bodies: DataFrame) -> DataFrame:
    """Pairs (a, b) of nodes with other labels (node, n, label) that may be linked, by a prefix filter.

    A linked pair has at least ``need`` shingles in common, so the first common one in a fixed order is
    among the first n - need + 1 of both. Rare shingles come first; those of one node alone match nothing
    and only count in the ranks.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for b in slices(whole, "body", 256 << 10):
                values, bounds = sets(b.column("body"))
                k = np.repeat(np.arange(b.num_rows), np.diff(bounds))
                yield pa.RecordBatch.from_arrays([pa.array(values.view(np.int64)), *[pa.array(b.column(c).to_numpy()[k]) for c in ("node", "n", "label")]], names=["h", "node", "n", "label"])

    rows = bodies.join(nodes, "node").select("body", "node", "n", "label").mapInArrow(run, "h long, node long, n long, label long")
    often = rows.groupBy("h").agg(F.count("*").alias("c")).where("c > 1")
    shared = rows.join(often, "h")
    w = Window.partitionBy("node")
    ranked = shared.withColumn("rank", F.col("n") - F.count("*").over(w) + F.row_number().over(w.orderBy("c", "h")))
    first = materialize(ranked.where(F.col("rank") <= F.col("n") - F.ceil(F.col("n") * SIMILARITY / 100) + 1).drop("c"), "prefixes")
    x, y = first.alias("x"), first.alias("y")
    need = F.ceil((F.col("x.n") + F.col("y.n")) * SIMILARITY / (100 + SIMILARITY))
    near = (F.col("x.rank") <= F.col("x.n") - need + 1) & (F.col("y.rank") <= F.col("y.n") - need + 1)
    both = x.join(y, (F.col("x.h") == F.col("y.h")) & (F.col("x.node") < F.col("y.node")) & (F.col("x.label") != F.col("y.label")) & near)
    return both.select(F.col("x.node").alias("a"), F.col("y.node").alias("b")).distinct()


def _possible(n: Column, own: Column, m: Column, other: Column) -> Column:
    """False for sizes and numbers of own shingles with which two sets can't be linked."""
    common = F.least(n - own, m - other)
    return common * 100 >= (n + m - common) * SIMILARITY


def classes(sketch: DataFrame) -> DataFrame:
    """Distinct non-empty sets, numbered: node, digest, size, half keys, smallest doc_id."""
    full = sketch.where("n > 0")
    found = full.groupBy("digest").agg(F.min("doc_id").alias("doc_id"), F.first("n").alias("n"), F.first("halves").alias("halves"))
    return found.withColumn("node", F.monotonically_increasing_id())


def meetings(found: DataFrame) -> DataFrame:
    """``node, n, keys``: classes with at least two half keys that other classes have, and those keys."""
    rows = found.select("node", "n", F.explode("halves").alias("key"))
    shared = rows.groupBy("key").agg(F.count("*").alias("c")).where("c > 1").select("key")
    return rows.join(shared, "key").groupBy("node").agg(F.first("n").alias("n"), F.array_sort(F.collect_list("key")).alias("keys")).where(F.size("keys") > 1)


def _tables(keys: str) -> Column:
    """The table keys: a hash of each pair of half keys."""
    return F.flatten(F.transform(keys, lambda k, i: F.transform(F.slice(keys, i + 2, HALVES), lambda m: F.xxhash64(k, m))))


def labels(docs: DataFrame, found: DataFrame) -> DataFrame | None:
    """``node, label`` of the classes that are linked with a smaller one; None if none is."""
    alive = materialize(meetings(found).join(found.select("node", "digest", "doc_id").where("doc_id IS NOT NULL"), "node"), "alive")
    bodies = materialize(_bodies(docs, alive.select("node", "digest", "doc_id")), "bodies")
    kept = alive.select("node", "n", "keys").join(own_shingles(bodies), "node", "left").withColumn("own", F.coalesce("own", F.lit(0)))
    kept = kept.where((F.col("n") - F.col("own")) * 100 >= F.col("n") * SIMILARITY)
    base = materialize(kept.select("node", "n", "own", F.explode(_tables("keys")).alias("table")), "buckets")
    tested = known = None
    first_joined, last = 0, False
    held = [alive, bodies, base]
    x, y = (F.struct(*[F.col(f"{side}.{c}") for c in ("node", "n", "own", "label")]) for side in "xy")
    possible = _possible(x["n"], x["own"], y["n"], y["own"]) & (x["label"] != y["label"])
    for step in range(MAX_ROUNDS):
        if known is None:
            rows = base.withColumn("label", F.col("node"))
        else:
            rows = base.join(known, "node", "left").withColumn("label", F.coalesce("label", "node"))
        order = F.xxhash64("node", F.lit(step)) if step else F.col("node")
        center = rows.groupBy("table").agg(F.min(F.struct(order.alias("h"), F.struct("node", "n", "own", "label").alias("y"))).alias("z"), F.min("label").alias("lo"), F.max("label").alias("hi"))
        center = center.where("lo <> hi").select("table", "z.y.*")
        if last:
            held.append(materialize(rows.join(center.select("table"), "table").select("node", "n", "label").distinct(), "left"))
            pairs = prefix_pairs(held[-1], bodies)
        else:
            both = rows.alias("x").join(center.alias("y"), (F.col("x.table") == F.col("y.table")) & possible)
            pairs = both.select(F.least("x.node", "y.node").alias("a"), F.greatest("x.node", "y.node").alias("b")).distinct()
        if tested is not None:
            pairs = pairs.join(tested, ["a", "b"], "left_anti")
        judged = materialize(verify(pairs, bodies), "judged")
        held.append(judged)
        tested = judged.select("a", "b") if tested is None else tested.unionByName(judged.select("a", "b"))
        joined = judged.where("linked").count()
        if joined:
            links = judged.where("linked")
            if known is not None:
                # Links between the components so far.
                links = links.join(known.select(F.col("node").alias("a"), F.col("label").alias("la")), "a", "left").join(known.select(F.col("node").alias("b"), F.col("label").alias("lb")), "b", "left")
                links = links.select(F.coalesce("la", "a").alias("a"), F.coalesce("lb", "b").alias("b"))
            fresh = components(links)
            if known is None:
                known = fresh
            else:
                moved = known.join(fresh.select(F.col("node").alias("label"), F.col("label").alias("to")), "label", "left").select("node", F.coalesce("to", "label").alias("label"))
                known = materialize(moved.unionByName(fresh.join(known.select("node"), "node", "left_anti")), "labels")
        if last:
            break
        first_joined = first_joined or joined
        last = joined * 20 <= first_joined or step == MAX_ROUNDS - 2
    discard(*held)
    return known


def near_duplicates(docs: DataFrame) -> DataFrame:
    """A row per document: doc_id, n_shingles, component_id, kept."""
    sketch = materialize(sketches(docs), "sketches")
    found = materialize(classes(sketch), "classes")
    known = labels(docs, found)
    parts = found.select("digest", "node", "doc_id")
    if known is None:
        ids = parts.select("digest", F.col("doc_id").alias("component_id"))
    else:
        parts = parts.join(known, "node", "left").select("digest", "doc_id", F.coalesce("label", "node").alias("label"))
        least = parts.groupBy("label").agg(F.min("doc_id").alias("component_id"))
        ids = parts.join(least, "label").select("digest", "component_id")
    out = sketch.select("doc_id", F.col("n").alias("n_shingles"), "digest").join(ids, "digest", "left")
    component = F.when(F.col("digest").isNull(), F.col("doc_id")).otherwise(F.col("component_id"))
    return out.select("doc_id", "n_shingles", component.alias("component_id"), component.eqNullSafe(F.col("doc_id")).alias("kept"))


def deduplicated(docs: DataFrame) -> DataFrame:
    """The documents that are kept, with the columns of ``docs``; a repeated row (same doc_id and text)
    once. Rows with null doc_id stay: no doc_id says which of them would."""
    ids = near_duplicates(docs).where("kept AND doc_id IS NOT NULL").select(F.col("doc_id").alias("_sw_id")).distinct()
    named = docs.where(F.col("doc_id").isNotNull())
    kept = named.join(ids, named["doc_id"] == ids["_sw_id"], "left_semi").dropDuplicates(["doc_id", "text"])
    return kept.unionByName(docs.where(F.col("doc_id").isNull()))


#: The same rows in DuckDB: all pairs that share a shingle, and what each document reaches.
SQL = r"""
WITH RECURSIVE w AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS ws FROM documents),
s AS (SELECT DISTINCT doc_id, array_to_string(ws[p : p + least(5, len(ws)) - 1], ' ') AS sh FROM (SELECT doc_id, ws, unnest(range(1, greatest(len(ws) - 4, 1) + 1)) AS p FROM w WHERE len(ws) > 0)),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
k AS (SELECT a.doc_id AS x, b.doc_id AS y, count(*) AS c FROM s a JOIN s b USING (sh) WHERE a.doc_id <> b.doc_id GROUP BY ALL),
l AS (SELECT x, y FROM k JOIN n a ON a.doc_id = x JOIN n b ON b.doc_id = y WHERE 100 * c >= 75 * (a.n + b.n - c)),
r(x, y) AS (SELECT doc_id, doc_id FROM w UNION SELECT r.x, l.y FROM r JOIN l ON l.x = r.y),
m AS (SELECT x, min(y) AS y FROM r GROUP BY x)
SELECT w.doc_id, coalesce(n.n, 0)::BIGINT AS n_shingles, m.y AS component_id, w.doc_id = m.y AS kept FROM w LEFT JOIN n USING (doc_id) JOIN m ON m.x = w.doc_id
"""
