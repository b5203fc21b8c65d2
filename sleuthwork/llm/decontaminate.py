"""Benchmark decontamination: a prefix-filtered set join of item windows with whole documents.

A window is ``WINDOW`` consecutive words of an item (an item of fewer words is one window). Its set is
its shingles of ``SHINGLE`` words. A document contains the window only if it contains all of them, so
the prefix that must be joined is one shingle: the rarest by document frequency, counted over all
documents. A match at word i of a shingle that stands at place p of the window proposes the start
i - p (positional bound); the window must fit between there and the document's end (length bound).
Proposals are verified word by word, first by hash, then by bytes.

The benchmark is dealt to blocks of at most ``BLOCK_BYTES`` of text (about 70 bytes a word of it in memory); one
block is broadcast to a pass over the documents, and passes are chained in one narrow stage. So no size of the
benchmark breaks the bound, and the documents are never shuffled. A benchmark of 20 MB takes three blocks.

Null text has no words and is not contaminated; an item without words has no window; items with one id
count once; a null item_id counts as the empty string. Of the shingles of a window that are equally rare the
first is joined. Long texts are read whole, repeated rows get a row each, an empty table none (and an empty
benchmark hits nothing). Columns of the documents pass through; names that begin with ``_sw_`` are kept.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ._common import PUNCT, Words, _powers, arrow_type, claim, mix, slices

WINDOW = 8
SHINGLE = 3
MIN_ITEMS = 2
BLOCK_BYTES = 8 << 20


def runs(h: np.ndarray, k: int) -> np.ndarray:
    """Hashes of all runs of ``k`` words, across rows; the caller drops those that cross."""
    if len(h) < k:
        return np.zeros(0, np.uint64)
    base = _powers("s", np.uint64(0xD6E8FEB86659FD93), k + 1)
    out = np.zeros(len(h) - k + 1, np.uint64)
    for i in range(k):
        out += h[i : len(h) - k + 1 + i] * base[i + 1]
    return mix(out + np.uint64(k))


class Table:
    """Finds which of many hashes are in a sorted set."""

    def __init__(self, values: np.ndarray):
        self.values = np.unique(values)
        self.maybe = np.zeros(1 << 18, bool)
        self.maybe[(self.values >> np.uint64(46)).astype(np.int64)] = True

    def find(self, h: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Places in ``h`` that are in the set, and where in it."""
        if not len(self.values) or not len(h):
            return np.zeros(0, np.int64), np.zeros(0, np.int64)
        at = np.flatnonzero(self.maybe[(h >> np.uint64(46)).astype(np.int64)])
        slot = np.searchsorted(self.values, h[at])
        slot[slot == len(self.values)] = 0
        ok = self.values[slot] == h[at]
        return at[ok], slot[ok]


class Windows:
    """The distinct windows of a block of items: where each stands in the items' words, and who owns it."""

    def __init__(self, ids: list[str], texts: list[str]):
        w = Words(pa.array(texts, pa.string()), PUNCT)
        self.raw, self.begin, self.end, self.hash = w.raw.tobytes().lower(), w.start, w.end, w.hash
        self.names, owner = np.unique(np.array(ids, object).astype(str), return_inverse=True) if ids else (np.zeros(0, str), np.zeros(0, np.int64))
        words = np.diff(w.bounds)
        n = np.minimum(WINDOW, words)
        many = np.where(words > 0, words - n + 1, 0)
        row = np.repeat(np.arange(len(words)), many)
        start = w.bounds[row] + np.arange(many.sum()) - np.repeat(np.cumsum(many) - many, many)
        size = n[row]
        # Two hashes of a window's words; equal windows are one.
        low, high = np.zeros(len(start), np.uint64), np.zeros(len(start), np.uint64)
        for j in range(WINDOW):
            k = np.flatnonzero(size > j)
            h = self.hash[start[k] + j]
            low[k], high[k] = mix(low[k] + h), mix(high[k] ^ (h * np.uint64(0x9E3779B97F4A7C15)))
        order = np.lexsort((start, high, low, size))
        fresh = np.ones(len(order), bool)
        o = order
        fresh[1:] = (low[o[1:]] != low[o[:-1]]) | (high[o[1:]] != high[o[:-1]]) | (size[o[1:]] != size[o[:-1]])
        #: First word and number of words of each window.
        self.start, self.size = start[o[fresh]], size[o[fresh]]
        pair = np.unique((np.cumsum(fresh) - 1) * max(1, len(self.names)) + owner[row[o]]) if len(o) else np.zeros(0, np.int64)
        self.owner, self.owners = pair % max(1, len(self.names)), np.searchsorted(pair // max(1, len(self.names)), np.arange(len(self.start) + 1))
        self.runs = {k: runs(self.hash, k) for k in range(1, SHINGLE + 1)}
        self.lengths = sorted({min(SHINGLE, int(k)) for k in np.unique(self.size)})
        self.table = Table(np.concatenate([np.zeros(0, np.uint64), *(self._shingles(k).ravel() for k in np.unique(self.size).tolist())]))

    def _shingles(self, size: int) -> np.ndarray:
        """Hashes of the shingles of the windows of a size, a row each."""
        k = min(SHINGLE, size)
        return self.runs[k][self.start[self.size == size][:, None] + np.arange(size - k + 1)]

    def items(self, k: int) -> list[str]:
        return self.names[self.owner[self.owners[k] : self.owners[k + 1]]].tolist()

    def choose(self, slots: np.ndarray, counts: np.ndarray) -> None:
        """Keep the rarest shingle of each window as the one that is joined."""
        often = np.zeros(len(self.table.values), np.int64)
        often[slots] = counts
        place, key = np.zeros(len(self.size), np.int64), np.zeros(len(self.size), np.uint64)
        for size in np.unique(self.size).tolist():
            mine = self._shingles(size)
            best = often[np.searchsorted(self.table.values, mine)].argmin(axis=1)
            place[self.size == size], key[self.size == size] = best, mine[np.arange(len(mine)), best]
        self.prefix = Table(key)
        order = np.argsort(key, kind="stable")
        self.by_key, self.place = order, place
        self.first = np.searchsorted(key[order], self.prefix.values)
        self.count = np.diff(np.append(self.first, len(order)))
        self.runs = self.table = None


def _matches(w: Words, table: Table, lengths: list[int]) -> tuple[np.ndarray, np.ndarray]:
    """Word places and table slots of the shingles of a batch that are in the table."""
    ends = np.repeat(w.bounds[1:], np.diff(w.bounds))
    at, slot = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
    for k in lengths:
        a, s = table.find(runs(w.hash, k))
        ok = a + k <= ends[a]
        at.append(a[ok])
        slot.append(s[ok])
    return np.concatenate(at), np.concatenate(slot)


def _frequencies(docs: DataFrame, block) -> tuple[np.ndarray, np.ndarray]:
    """Slots of the block's shingles, and how many documents hold each."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        claim()
        win = block.value
        total = np.zeros(len(win.table.values), np.int64)
        for whole in batches:
            for b in slices(whole, "text"):
                w = Words(b.column("text"), PUNCT)
                at, slot = _matches(w, win.table, win.lengths)
                row = np.searchsorted(w.bounds, at, side="right") - 1
                pairs = np.unique(row * len(total) + slot)
                total += np.bincount(pairs % len(total), minlength=len(total)) if len(total) else 0
        some = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(some), pa.array(total[some])], names=["slot", "df"])

    texts = docs.select(F.col("text").cast("string").alias("text")).where(F.col("text").isNotNull())
    got = texts.mapInArrow(count, "slot long, df long").groupBy("slot").agg(F.sum("df").alias("df"))
    got = got.toPandas()  # at most one row a shingle of the block
    return got["slot"].to_numpy(np.int64), got["df"].to_numpy(np.int64)


def _join(batch: pa.RecordBatch, win: Windows) -> tuple[list, list, np.ndarray]:
    """New hit ranges and item ids of the rows of a batch, and their numbers of words."""
    w = Words(batch.column("text"), PUNCT)
    n = np.diff(w.bounds)
    at, slot = _matches(w, win.prefix, win.lengths)
    many = win.count[slot]
    which = win.by_key[np.repeat(win.first[slot] - (np.cumsum(many) - many), many) + np.arange(many.sum())]
    start = np.repeat(at, many) - win.place[which]
    row = np.searchsorted(w.bounds, np.repeat(at, many), side="right") - 1
    ok = (start >= w.bounds[row]) & (start + win.size[which] <= w.bounds[row + 1])
    start, which, row = start[ok], which[ok], row[ok]
    same = np.ones(len(start), bool)
    for j in range(WINDOW):
        inside = np.flatnonzero(same & (win.size[which] > j))
        same[inside] = w.hash[start[inside] + j] == win.hash[win.start[which[inside]] + j]
    start, which, row = start[same], which[same], row[same]
    hits: list = [None] * w.rows
    items: list = [None] * w.rows
    if len(start):
        for i in range(len(start)):
            s, k, r = int(start[i]), int(which[i]), int(row[i])
            size, t = int(win.size[k]), int(win.start[k])
            if all(w.raw[w.start[s + j] : w.end[s + j]].tobytes().lower() == win.raw[win.begin[t + j] : win.end[t + j]] for j in range(size)):
                hits[r] = hits[r] or []
                items[r] = items[r] or set()
                a = s - int(w.bounds[r])
                hits[r].append((a, a + size))
                items[r].update(win.items(k))
    return hits, items, n


def _union(ranges: list[tuple[int, int]]) -> list[int]:
    """Disjoint ranges, flat, that cover what the given ones cover."""
    out: list[int] = []
    for s, e in sorted(ranges):
        if out and s <= out[-1]:
            out[-1] = max(out[-1], e)
        else:
            out += [s, e]
    return out


def _pass(docs: DataFrame, block) -> DataFrame:
    schema = T.StructType([*docs.schema.fields])
    arrow = arrow_type(schema)
    names = schema.names

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        claim()
        win = block.value
        for whole in batches:
            for b in slices(whole, "_sw_text"):
                texts = pa.RecordBatch.from_arrays([b.column("_sw_text")], names=["text"])
                hits, items, n = _join(texts, win)
                old_hits, old_items = b.column("_sw_hits").to_pylist(), b.column("_sw_items").to_pylist()
                for r in range(len(n)):
                    if hits[r]:
                        flat = old_hits[r]
                        hits[r] = _union([*hits[r], *zip(flat[::2], flat[1::2], strict=True)])
                        items[r] = sorted(items[r].union(old_items[r]))
                    else:
                        hits[r], items[r] = old_hits[r], old_items[r]
                new = {"_sw_words": pa.array(n, pa.int64()), "_sw_hits": pa.array(hits, pa.list_(pa.int64())), "_sw_items": pa.array(items, pa.list_(pa.string()))}
                yield pa.RecordBatch.from_arrays([new[c].cast(arrow.field(c).type) if c in new else b.column(c) for c in names], schema=arrow)

    return docs.mapInArrow(run, schema)


def contamination(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """``docs`` with ``_sw_words``, ``_sw_hits`` (flat word ranges) and ``_sw_items`` (ids) of its matches."""
    spark = docs.sparkSession
    items = benchmark.select(F.coalesce(F.col("item_id").cast("string"), F.lit("")).alias("item_id"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    size = items.agg(F.sum(F.octet_length("text") + F.octet_length("item_id") + 16).alias("n")).first()["n"] or 0
    blocks = max(1, -(-size // BLOCK_BYTES))
    out = docs.withColumn("_sw_text", F.coalesce(F.col("text").cast("string"), F.lit(""))).withColumn("_sw_words", F.lit(0).cast("long"))
    out = out.withColumn("_sw_hits", F.array().cast("array<bigint>")).withColumn("_sw_items", F.array().cast("array<string>"))
    out = out.to(T.StructType([T.StructField(f.name, f.dataType, True) for f in out.schema.fields]))
    for k in range(blocks):
        rows = items.where(F.pmod(F.xxhash64("item_id", "text"), F.lit(blocks)) == k).orderBy("item_id", "text").collect()
        win = Windows([r["item_id"] for r in rows], [r["text"] for r in rows])
        first = spark.sparkContext.broadcast(win)
        win.choose(*_frequencies(docs, first))
        first.unpersist()
        out = _pass(out, spark.sparkContext.broadcast(win))
    return out.drop("_sw_text")


def decontaminate(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """The contract's rows."""
    found = contamination(docs.select("doc_id", "text"), benchmark)
    names = F.array_sort("_sw_items")
    signed = F.transform("_sw_hits", lambda x, i: F.when(i % 2 == 1, x).otherwise(-x))
    hit = F.aggregate(signed, F.lit(0).cast("long"), lambda a, x: a + x)
    return found.select(
        "doc_id", F.col("_sw_words").alias("n_words"), hit.alias("n_hit"), F.size("_sw_items").cast("long").alias("n_items"),
        F.sha2(F.array_join(names, ","), 256).alias("items_sha256"), (F.size("_sw_items") >= MIN_ITEMS).alias("contaminated"),
    )


def clean_documents(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """The documents that hold no passage of an item, with their own columns.

    A document goes if ``WINDOW`` words of it in a row are hit, or windows of ``MIN_ITEMS`` items are. So a
    single item is enough; an item of fewer words, which may be an everyday phrase, isn't by itself.
    """
    long = F.exists(F.transform("_sw_hits", lambda x, i: F.when(i % 2 == 1, x - F.get("_sw_hits", i - 1))), lambda n: F.coalesce(n >= WINDOW, F.lit(False)))
    kept = contamination(docs, benchmark).where(~long & (F.size("_sw_items") < MIN_ITEMS))
    return kept.select(*docs.columns)


#: The same rows in DuckDB.
SQL = r"""
WITH w AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS ws FROM documents),
b AS (SELECT item_id::VARCHAR AS item_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS ws FROM benchmark),
i AS (SELECT DISTINCT item_id, least(8, len(ws)) AS k, array_to_string(ws[p : p + least(8, len(ws)) - 1], ' ') AS win FROM (SELECT item_id, ws, unnest(range(1, len(ws) - least(8, len(ws)) + 2)) AS p FROM b WHERE len(ws) > 0)),
k AS (SELECT DISTINCT k FROM i),
d AS (SELECT doc_id, p, k, array_to_string(ws[p : p + k - 1], ' ') AS win FROM (SELECT doc_id, ws, k, unnest(range(1, len(ws) - k + 2)) AS p FROM w, k)),
m AS (SELECT d.doc_id, d.p, d.k, i.item_id FROM d JOIN i ON d.win = i.win AND d.k = i.k),
h AS (SELECT doc_id, count(DISTINCT q) AS n_hit FROM (SELECT doc_id, unnest(range(p, p + k)) AS q FROM m) GROUP BY doc_id),
t AS (SELECT doc_id, count(*) AS n_items, string_agg(item_id, ',' ORDER BY item_id) AS s FROM (SELECT DISTINCT doc_id, item_id FROM m) GROUP BY doc_id)
SELECT w.doc_id, len(ws)::BIGINT AS n_words, coalesce(n_hit, 0)::BIGINT AS n_hit, coalesce(n_items, 0)::BIGINT AS n_items, sha256(coalesce(s, '')) AS items_sha256, coalesce(n_items, 0) >= 2 AS contaminated
FROM w LEFT JOIN h USING (doc_id) LEFT JOIN t USING (doc_id)
"""
