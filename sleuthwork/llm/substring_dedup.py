"""Substring dedup: content-defined chunks cut by a gear rolling hash, deduplicated by digest.

A chunk ends after a byte at which the gear hash of the last 16 bytes falls below a bound (about one byte
in 26) and did not at the byte before; it depends on those bytes alone, so an insertion moves the borders
next to it only. The first 16 bytes of a text end no chunk. A chunk of over 256 bytes (such as one word
over and over, where the hash repeats as well) is cut before every eighth word and after 65,536 bytes. A chunk's digest is 80 bits of two
hashes of its bytes: at 100 TB (4e12 chunks) fewer than ten pairs of other chunks are expected to share one.

A digest that occurs in two documents (different doc_ids) is repeated; its smallest doc_id keeps it.
Neighbouring repeated chunks of a document form a run. A run is reported if it has at least
``MIN_RUN`` words and, with the two chunks around it, which hold the ends of the passage that no border
marks, at least ``PASSAGE`` words. It is a span for each part that other documents keep and that is such a
run by itself, and for each part between those, which stays in the document.

Passages whose borders leave fewer than ``MIN_RUN`` words between them are found word by word: every
``PASSAGE`` words in a row that hold so few between the first and the last border that they determine
themselves are hashed as well, and neighbouring ones that another document holds too form a span without
chunks. Such a span may overlap others of its document. So every passage of over 50 words that two
documents share is reported; repeated lines and phrases of fewer words are not.

Shuffles: (digest, doc_id) with map-side combining, whose repeated digests are written as a table; then the
chunks to their digests (a frequent chunk is one row of that table, so adaptive execution may split the join),
then the repeated ones to their documents.

Null or empty text has no chunks; rows with null doc_id are left alone. Repeated rows (same doc_id and
text) are one document: their spans are reported once, and do not repeat each other. Ties of first holders go to the
smallest doc_id. An empty table has no spans. Columns of the documents pass through ``without_repeats``.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._common import SPACE, _powers, arrow_type, buffers, materialize, mix, slices

WINDOW = 16
BOUND = 10
#: Longer chunks are cut before every so many words.
LONG, LONG_WORDS, LONGEST = 256, 8, 1 << 16
MIN_RUN = 12
PASSAGE = 46

_rng = np.random.Generator(np.random.PCG64(42))
_GEAR = _rng.integers(0, 1 << 32, 256, dtype=np.uint32)
_BYTES = _rng.integers(1, 2**63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_MORE = _rng.integers(1, 2**63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_P, _PINV = np.uint64(0x9E3779B97F4A7C15), np.uint64(pow(0x9E3779B97F4A7C15, -1, 1 << 64))
#: A chunk in three words: where it is, how long, which one of its text, and words in and around it.
CHUNKS = "digest long, more short, doc_id long, number long, place long, words long"
BITS = 20
MASK = (1 << BITS) - 1


def borders(raw: np.ndarray) -> np.ndarray:
    """True after which bytes the gear hash ends a chunk (texts run together)."""
    h = _GEAR[raw]
    for shift in (1, 2, 4, 8):
        later = h.copy()
        later[shift:] += h[:-shift] << np.uint32(shift)
        h = later
    low = ((h >> np.uint32(8)) & np.uint32(0xFF)) < BOUND
    low[1:] &= ~low[:-1].copy()
    return low


def chunks(texts: pa.Array) -> tuple[np.ndarray, ...]:
    """Row, start, stop, digest and words (that begin in it) of every chunk, and hashes of the texts."""
    found = _cut(texts)[0]
    return (*found[:5], found[6])


def _cut(texts: pa.Array, min_run: int = 0, passage: int = 0) -> tuple[tuple[np.ndarray, ...], tuple[np.ndarray, ...]]:
    """``chunks``, with the further digest before the texts; and row, start, stop, both digests and number of the first word of every ``passage`` words that
    hold fewer than ``min_run`` between the borders they determine (none if ``min_run`` is 0)."""
    raw, off = buffers(texts)
    raw, off = raw[off[0] : off[-1]], off - off[0]
    n = len(raw)
    power, inverse = _powers("p", _P, n), _powers("q", _PINV, n + 1)

    def hashes(table):
        sums = np.zeros(n + 1, np.uint64)
        np.cumsum(table[raw] * power, out=sums[1:])
        return lambda s, e: mix((sums[e] - sums[s]) * inverse[s] + (e - s).astype(np.uint64))

    hashed, again = hashes(_BYTES), hashes(_MORE)
    short = lambda s, e: (again(s, e) >> np.uint64(48)).astype(np.uint16).view(np.int16)
    text_hash = hashed(off[:-1], off[1:]).view(np.int64)
    if not n:
        empty = np.zeros(0, np.int64)
        return (empty, empty, empty, empty, empty, empty, text_hash), (empty,) * 6
    ends = borders(raw)
    pure = np.flatnonzero(ends)
    size = np.diff(off)
    for i in range(WINDOW):
        ends[(off[:-1] + i)[size > i]] = False
    ends[(off[1:] - 1)[size > 0]] = True
    inside = ~SPACE[raw]
    first = inside.copy()
    first[1:] &= ~inside[:-1]
    heads = off[:-1][size > 0]
    first[heads] = inside[heads]
    stop = np.flatnonzero(ends) + 1
    start = np.concatenate([[0], stop[:-1]])
    for k in np.flatnonzero(stop - start > LONG).tolist():
        ends[start[k] + np.flatnonzero(first[start[k] : stop[k]])[1:][::LONG_WORDS] - 1] = True
        ends[start[k] + LONGEST - 1 : stop[k] : LONGEST] = True
    stop = np.flatnonzero(ends) + 1
    start = np.concatenate([[0], stop[:-1]])
    row = np.searchsorted(off, start, side="right") - 1
    words = np.concatenate([[0], np.cumsum(first)])
    found = row, start, stop, hashed(start, stop).view(np.int64), words[stop] - words[start], short(start, stop), text_hash
    head = np.flatnonzero(first)
    if not min_run or len(head) < passage:
        return found, (np.zeros(0, np.int64),) * 6
    last = inside.copy()
    last[:-1] &= ~inside[1:] | first[1:]
    s, e = head[: len(head) - passage + 1], np.flatnonzero(last)[passage - 1 :] + 1
    of = np.searchsorted(off, s, side="right") - 1
    # A border depends on the 17 bytes up to it.
    a, b = np.searchsorted(pure, s + WINDOW), np.searchsorted(pure, e) - 1
    at = np.append(pure, n - 1) + 1
    k = np.flatnonzero((e <= off[of + 1]) & ((b <= a) | (words[at[np.maximum(b, 0)]] - words[at[a]] < min_run)))
    s, e, of = s[k], e[k], of[k]
    # Not the digest that a chunk of the same bytes has.
    return found, (of, s, e, mix(hashed(s, e) ^ _P).view(np.int64), short(s, e), k - words[off[of]])


def _rows(docs: DataFrame) -> DataFrame:
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).where("doc_id IS NOT NULL AND text IS NOT NULL")


def repeated(docs: DataFrame, min_run: int = MIN_RUN, passage: int = PASSAGE) -> DataFrame:
    """``digest, more, first_doc_id`` of the chunks, and of the passages with few borders, that several documents hold."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for b in slices(whole, "text"):
                (row, _, _, digest, _, more, _), (of, _, _, sparse, less, _) = _cut(b.column("text"), min_run, passage)
                row, digest, more = np.concatenate([row, of]), np.concatenate([digest, sparse]), np.concatenate([more, less]).astype(np.int16)
                order = np.lexsort((more, digest, row))
                row, digest, more = row[order], digest[order], more[order]
                once = np.ones(len(row), bool)
                once[1:] = (row[1:] != row[:-1]) | (digest[1:] != digest[:-1]) | (more[1:] != more[:-1])
                ids = b.column("doc_id").to_numpy(zero_copy_only=False)
                yield pa.RecordBatch.from_arrays([pa.array(digest[once]), pa.array(more[once]), pa.array(ids[row[once]])], names=["digest", "more", "doc_id"])

    seen = _rows(docs).mapInArrow(run, "digest long, more short, doc_id long").groupBy("digest", "more").agg(F.min("doc_id").alias("first_doc_id"), F.max("doc_id").alias("_last"))
    return seen.where("first_doc_id < _last").drop("_last")


def occurrences(docs: DataFrame, min_run: int = MIN_RUN, passage: int = PASSAGE) -> DataFrame:
    """All chunks of all documents: both digests, doc_id, and packed into three numbers the text's hash (32 bits) and
    the chunk's number; its start and length; the words that begin in it, before it and after it. Passages with
    few borders as well: the number is their first word's, the last field is less than 0, their length."""
    arrow = arrow_type(CHUNKS)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for b in slices(whole, "text"):
                _, off = buffers(b.column("text"))
                off = off - off[0]
                (row, start, stop, digest, words, more, text_hash), (of, s, e, sparse, less, k) = _cut(b.column("text"), min_run, passage)
                head = np.ones(len(row), bool)
                head[1:] = row[1:] != row[:-1]
                tail = np.append(head[1:], True)[: len(row)]
                at = np.flatnonzero(head)
                seq = np.arange(len(row)) - np.repeat(at, np.diff(np.append(at, len(row))))
                before, after = np.append(0, words[:-1])[: len(row)], np.append(words[1:], 0)[: len(row)]
                before, after = np.where(head, 0, before), np.where(tail, 0, after)
                ids = b.column("doc_id").to_numpy(zero_copy_only=False)
                number = (text_hash[row] & np.int64(0xFFFFFFFF)) << np.int64(32) | seq
                place = (start - off[row]) << np.int64(BITS) | (stop - start)
                packed = words << np.int64(2 * BITS) | before << np.int64(BITS) | after
                rest = sparse, less, ids[of], (text_hash[of] & np.int64(0xFFFFFFFF)) << np.int64(32) | k, (s - off[of]) << np.int64(BITS), s - e
                both = [np.concatenate(c) for c in zip([digest, more, ids[row], number, place, packed], rest, strict=True)]
                yield pa.RecordBatch.from_arrays([pa.array(c).cast(f.type) for c, f in zip(both, arrow, strict=True)], schema=arrow)

    return _rows(docs).mapInArrow(run, CHUNKS)


def _parts(row, doc, number, place, words, first, min_run, passage):
    """Row, start, stop, words, chunks, first_doc_id and removed of the spans; the input is ordered by row and number."""
    others = first != doc
    seq, start = number & np.int64(0xFFFFFFFF), place >> np.int64(BITS)
    new = lambda r, q, f: np.append(True, (r[1:] != r[:-1]) | (q[1:] != q[:-1] + 1) | (f[1:] != f[:-1]))
    out = []
    i = np.flatnonzero(words >= 0)
    if len(i):
        r, q, w, begin, size, who = row[i], seq[i], words[i], start[i], place[i] & np.int64(MASK), first[i]
        own, before, after = w >> np.int64(2 * BITS), w >> np.int64(BITS) & np.int64(MASK), w & np.int64(MASK)

        def long(at):
            n = np.add.reduceat(own, at)
            stop = np.append(at[1:], len(i))
            return np.repeat((n >= min_run) & (n + before[at] + after[stop - 1] >= passage), stop - at)

        none = np.zeros(len(i), bool)
        kept = long(np.flatnonzero(new(r, q, none)))
        gone = others[i] & long(np.flatnonzero(new(r, q, others[i])))
        r, q, own, begin, size, who, gone = (c[kept] for c in (r, q, own, begin, size, who, gone))
        if len(r):
            head = new(r, q, gone)
            at, span = np.flatnonzero(head), np.cumsum(head) - 1
            stop = np.append(at[1:], len(r))
            largest = np.lexsort((-who, size, span))[stop - 1]
            out.append((r[at], begin[at], begin[stop - 1] + size[stop - 1], np.add.reduceat(own, at), stop - at, who[largest], gone[at]))
    i = np.flatnonzero(words < 0)
    if len(i):
        at = np.flatnonzero(new(row[i], seq[i], others[i]))
        stop = np.append(at[1:], len(i))
        h, t = i[at], i[stop - 1]
        out.append((row[h], start[h], start[t] - words[t], passage + stop - at - 1, 0 * at, first[h], others[h]))
    if not out:
        return (np.zeros(0, np.int64),) * 6 + (np.zeros(0, bool),)
    cols = [np.concatenate(c) for c in zip(*out, strict=True)]
    # What lies within a span of the same kind before it is no span of its own.
    order = np.lexsort((-cols[2], cols[1], cols[6], cols[0]))
    cols = [c[order] for c in cols]
    keep, reach = np.ones(len(order), bool), (None, None, -1)
    for k, (r, stop, gone) in enumerate(zip(cols[0].tolist(), cols[2].tolist(), cols[6].tolist(), strict=True)):
        keep[k] = (r, gone) != reach[:2] or stop > reach[2]
        reach = (r, gone, stop) if keep[k] else reach
    return tuple(c[keep] for c in cols)


SPANS = "doc_id long, text_hash long, span_start long, span_end long, n_words long, n_chunks long, first_doc_id long, removed boolean"


def spans(docs: DataFrame, min_run: int = MIN_RUN, passage: int = PASSAGE) -> DataFrame:
    """A row per repeated passage of a document, or part of one: doc_id, text_hash, span_start and span_end (bytes
    of the UTF-8 text), n_words, n_chunks, first_doc_id (who keeps its largest part), removed (someone else does)."""
    found = occurrences(docs, min_run, passage).join(materialize(repeated(docs, min_run, passage), "repeated"), ["digest", "more"])
    text_hash = F.shiftrightunsigned("number", 32).cast("long")
    item = F.struct("number", "place", "words", "first_doc_id")
    lists = found.groupBy("doc_id", text_hash.alias("text_hash")).agg(F.array_sort(F.collect_set(item)).alias("c"))
    arrow = arrow_type(SPANS)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            lists = b.column("c")
            row = np.repeat(np.arange(len(b)), lists.value_lengths().to_numpy(zero_copy_only=False))
            number, place, words, first = (c.to_numpy(zero_copy_only=False) for c in lists.flatten().flatten())
            ids, hashes = (b.column(n).to_numpy(zero_copy_only=False) for n in ("doc_id", "text_hash"))
            r, *cols = _parts(row, ids[row], number, place, words, first, min_run, passage)
            yield pa.RecordBatch.from_arrays([pa.array(c).cast(f.type) for c, f in zip([ids[r], hashes[r], *cols], arrow, strict=True)], schema=arrow)

    return lists.mapInArrow(run, SPANS)


def repeats(docs: DataFrame) -> DataFrame:
    """The query's rows."""
    return spans(docs).drop("text_hash")


def without_repeats(docs: DataFrame) -> DataFrame:
    """``docs`` whose removed spans are cut out of the texts (columns unchanged). A character of which a span
    holds a part only stays whole."""
    cut = spans(docs).where("removed").groupBy("doc_id", "text_hash").agg(F.array_sort(F.collect_list(F.struct("span_start", "span_end"))).alias("_sw_cuts"))
    fields = docs.columns
    schema_in = docs.schema
    from pyspark.sql import types as T

    hashed_schema = T.StructType([*[T.StructField(f.name, f.dataType, True) for f in schema_in.fields], T.StructField("_sw_hash", T.LongType())])
    arrow_hashed = arrow_type(hashed_schema)

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for b in slices(whole, "text"):
                h = chunks(b.column("text"))[-1]
                yield pa.RecordBatch.from_arrays([*b.columns, pa.array(h & np.int64(0xFFFFFFFF))], schema=arrow_hashed)

    out_schema = T.StructType(hashed_schema.fields[:-1])
    arrow_out = arrow_type(out_schema)

    def remove(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            texts = b.column("text").to_pylist()
            for r, spans_ in enumerate(b.column("_sw_cuts").to_pylist()):
                if spans_:
                    data, parts, at = texts[r].encode("utf-8"), [], 0
                    for s in spans_:
                        begin, end = s["span_start"], s["span_end"]
                        while begin < len(data) and data[begin] & 0xC0 == 0x80:
                            begin += 1
                        while begin < end < len(data) and data[end] & 0xC0 == 0x80:
                            end -= 1
                        parts.append(data[at : max(at, begin)])
                        at = max(at, end)
                    texts[r] = b"".join([*parts, data[at:]]).decode("utf-8")
            yield pa.RecordBatch.from_arrays([pa.array(texts, pa.string()) if c == "text" else b.column(c) for c in fields], schema=arrow_out)

    hashed = docs.to(T.StructType(hashed_schema.fields[:-1])).mapInArrow(add, hashed_schema)
    joined = hashed.join(cut.withColumnsRenamed({"doc_id": "_sw_id", "text_hash": "_sw_th"}), (F.col("doc_id") == F.col("_sw_id")) & (F.col("_sw_hash") == F.col("_sw_th")), "left")
    return joined.select(*fields, "_sw_cuts").mapInArrow(remove, out_schema)
