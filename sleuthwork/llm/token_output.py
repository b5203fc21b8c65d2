"""Token-ID output, compressed per block by Re-Pair, with random access.

Layout. The documents are range-partitioned and sorted by doc_id, encoded, and an end id (0) is
appended to each. Consecutive documents form blocks of about a million ids. A block is one row of a
Parquet table (Spark's writer commits it, so a lost executor costs a retry only):

``part, block, n_docs, n_tokens, blob``, ordered by (part, block). A blob is little-endian:
``b"RPB1"``, then uint32 counts of documents, rules and symbols; int64 doc_ids (with a uint8 flag for
null), uint32 ids per document, uint16 rule pairs, uint32 expansion lengths, uint16 symbols.
Symbols below 50,257 are ids, the others are rules; a rule only uses symbols before it.

Re-Pair: pairs of neighbours that are at least a 32nd as frequent as the most frequent one get nonterminals,
round after round, until no pair occurs ``MIN_COUNT`` times or the 16-bit symbols run out. The expansion
lengths let ``read_range`` find an id range in a block without expanding the rest.

Null text counts as empty: its row has the end id only. Rows with one doc_id are ordered by text; repeated
rows get ids of their own, and null doc_ids come first. A text longer than a block has a block of its own. An
empty table gives no files' rows. Only doc_id and text are read, whatever other columns there are.
"""

from __future__ import annotations

import json
import struct
import uuid
import zlib
from collections.abc import Iterator
from itertools import repeat

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ._common import arrow_type, claim, shared_dir, shuffle_width, slices

BLOCK_SCHEMA = "part int, block int, n_docs long, n_tokens long, blob binary"
DOC_SCHEMA = "part int, block int, doc_id long, at long, n_tokens long, ids_crc32 long"
END = 0
BLOCK_IDS = 1 << 20
VOCAB = 50_257
MIN_COUNT = 4
#: Pieces a worker's cache holds; beyond, those that came back least go.
CACHE_PIECES = 1_000_000
BATCH_BYTES = 4 << 20


def vocabulary() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


class Encoder:
    """Encodes batches of texts; ids of pieces that were seen before come from a bounded cache.

    The pre-tokeniser always cuts before a single space or line break that stands between two
    characters that are not white space, so a text is the concatenation of the pieces cut there.
    A text with any other white space at a cut is encoded as a whole.
    """

    def __init__(self, path: str):
        import os

        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tok = Tokenizer.from_file(path)
        self.safe = json.load(open(path))["pre_tokenizer"] == {"type": "ByteLevel", "add_prefix_space": False, "trim_offsets": True, "use_regex": True}
        self.reset()

    def reset(self) -> None:
        self.number: dict[str, int] = {}
        self.flat, self.used = np.zeros(1 << 20, np.uint16), 0
        self.at, self.size = np.zeros(1 << 16, np.int32), np.zeros(1 << 16, np.int32)
        self.seen = np.zeros(1 << 16, np.int32)

    def evict(self) -> None:
        """Keep the pieces that were in several batches."""
        least = 2
        while (keep := self.seen[: len(self.number)] >= least).sum() > CACHE_PIECES // 2:
            least *= 2
        names = [p for p, k in zip(self.number, keep.tolist(), strict=True) if k]
        old = np.flatnonzero(keep)
        size = self.size[old]
        n = np.maximum(size, 0).astype(np.int64)
        ends = np.cumsum(n)
        flat = self.flat[np.repeat(self.at[old] - (ends - n), n) + np.arange(n.sum())]
        self.number = {p: i for i, p in enumerate(names)}
        self.flat, self.used = flat, len(flat)
        self.at, self.size, self.seen = (ends - n).astype(np.int32), size, np.ones(len(old), np.int32)

    def whole(self, text: str) -> list[int]:
        return self.tok.encode(text, add_special_tokens=False).ids

    def _add(self, pieces: list[str]) -> None:
        """Encode new pieces: a leading line break is kept, others get their leading space."""
        bare = [p[1:] if p[:1] == "\n" else p for p in pieces]
        bad = [not q or q[0].isspace() or q[-1].isspace() for q in bare]
        good = [p if p[:1] == "\n" else " " + p for p, k in zip(pieces, bad, strict=True) if not k] if any(bad) else [p if p[0] == "\n" else " " + p for p in pieces]
        bad = np.array(bad)
        if good:
            made = self.tok.encode(good, is_pretokenized=True, add_special_tokens=False)
            ids, of = np.array(made.ids, np.uint16), np.array(made.word_ids, np.int64)
        else:
            ids, of = np.zeros(0, np.uint16), np.zeros(0, np.int64)
        n, m = len(self.number), len(self.number) + len(pieces)
        while m > len(self.at):
            self.at, self.size, self.seen = (np.concatenate([x, np.zeros(max(1 << 16, len(x)), x.dtype)]) for x in (self.at, self.size, self.seen))
        while self.used + len(ids) > len(self.flat):
            self.flat = np.concatenate([self.flat, np.zeros(max(1 << 20, len(self.flat)), np.uint16)])
        self.flat[self.used : self.used + len(ids)] = ids
        size = np.zeros(len(pieces), np.int64)
        size[~bad] = np.bincount(of, minlength=len(good))
        self.at[n:m] = self.used + np.cumsum(size) - size
        self.size[n:m] = np.where(bad, -1, size)
        self.seen[n:m] = 0
        self.used += len(ids)
        self.number.update(zip(pieces, range(n, m), strict=True))

    def batch(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """All ids of the texts, and how many each has. Nulls are empty."""
        texts = pc.fill_null(texts, "")
        if not self.safe:
            got = [self.whole(t) for t in texts.to_pylist()]
            return np.array([i for g in got for i in g], np.uint16), np.array([len(g) for g in got], np.int64)
        if len(self.number) > CACHE_PIECES:
            self.evict()
        split = pc.split_pattern(pc.replace_substring(texts, "\n", " \n"), " ")
        bounds = np.asarray(split.offsets).astype(np.int64) - split.offsets[0].as_py()
        coded = split.flatten().dictionary_encode()
        names = coded.dictionary.to_numpy(zero_copy_only=False)
        have = self.number
        known = np.fromiter(map(have.get, names, repeat(-1)), np.int32, len(names))
        if len(new := np.flatnonzero(known < 0)):
            known[new] = np.arange(len(have), len(have) + len(new))
            self._add(names[new].tolist())
        self.seen[known] += 1
        codes = np.asarray(coded.indices)
        size, at = self.size[known][codes], self.at[known][codes]
        flat = self.flat
        # The first piece of a text has no space before it.
        heads = bounds[:-1]
        firsts = pc.list_element(split, 0).to_pylist() if len(heads) else []
        bad = np.zeros(len(heads), bool)
        bad[np.searchsorted(bounds, np.flatnonzero(size < 0), side="right") - 1] = True
        extra, extra_at = [], len(flat)
        for r, p in enumerate(firsts):
            v = self.whole(p) if not bad[r] else []
            at[heads[r]], size[heads[r]] = extra_at, len(v)
            extra_at += len(v)
            extra += v
        for r in np.flatnonzero(bad).tolist():
            v = self.whole(texts[r].as_py())
            size[bounds[r] : bounds[r + 1]] = 0
            at[heads[r]], size[heads[r]] = extra_at, len(v)
            extra_at += len(v)
            extra += v
        source = np.concatenate([flat, np.array(extra, np.uint16)]) if extra else flat
        totals = np.zeros(len(size) + 1, np.int32)
        np.cumsum(size, out=totals[1:])
        where = np.repeat(at - totals[:-1], size)
        where += np.arange(totals[-1], dtype=np.int32)
        return source[where], np.diff(totals[bounds]).astype(np.int64)


_ENCODERS: dict[str, Encoder] = {}


def encoder(path: str) -> Encoder:
    claim(_ENCODERS)
    if path not in _ENCODERS:
        _ENCODERS[path] = Encoder(path)
    return _ENCODERS[path]


def repair(ids: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Re-Pair in rounds: rule pairs, their expansion lengths and the compressed symbols."""
    seq = ids.astype(np.uint16, copy=False)
    rules: list[np.ndarray] = []
    lengths = np.ones(1 << 16, np.int64)
    following = VOCAB
    while True:
        room = (1 << 16) - following
        if len(seq) < 2 or room < 1:
            break
        keys = (seq[:-1].astype(np.uint32) << np.uint32(16)) | seq[1:]
        order = np.sort(keys)
        edge = np.flatnonzero(np.concatenate([[True], order[1:] != order[:-1], [True]]))
        counts, values = np.diff(edge), order[edge[:-1]]
        often = counts >= max(MIN_COUNT, int(counts.max()) >> 5)
        if not often.any():
            break
        counts, values = counts[often], values[often]
        # The pairs' places are looked up in a table of 18-bit hashes: of two pairs with one hash, the
        # more frequent one is taken now.
        best = np.lexsort((values, -counts))[: min(room, 4096)]
        place = lambda k: (k * np.uint32(2654435761)) >> np.uint32(14)
        slot = np.full(1 << 18, -1, np.int16)
        slot[place(values[best][::-1])] = np.arange(len(best), dtype=np.int16)[::-1]
        values = values[best]
        found = slot[place(keys)]
        at = np.flatnonzero(found >= 0)
        found = found[at]
        hit = values[found] == keys[at]
        at, found = at[hit], found[hit]
        # Overlapping occurrences: every second one of a run of neighbours is replaced.
        fresh = np.concatenate([[True], at[1:] != at[:-1] + 1])
        start = np.maximum.accumulate(np.where(fresh, np.arange(len(at)), 0))
        pick = (np.arange(len(at)) - start) % 2 == 0
        at, found = at[pick], found[pick]
        pairs = np.stack([values >> np.uint32(16), values & np.uint32(0xFFFF)], 1).astype(np.uint16)
        lengths[following : following + len(values)] = lengths[pairs[:, 0]] + lengths[pairs[:, 1]]
        seq = seq.copy()
        seq[at] = (found.astype(np.int32) + following).astype(np.uint16)
        keep = np.ones(len(seq), bool)
        keep[at + 1] = False
        seq = seq[keep]
        rules.append(pairs)
        following += len(values)
    pairs = np.concatenate(rules) if rules else np.zeros((0, 2), np.uint16)
    return pairs, lengths[VOCAB:following].astype(np.uint32), seq


def _unfold(pairs: np.ndarray, seq: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Ids of each of the symbols, and how many each has: one level of rules after the other."""
    owner = np.arange(len(seq))
    while len(rule := np.flatnonzero(seq >= VOCAB)):
        n = np.ones(len(seq), np.int64)
        n[rule] = 2
        out, owner = np.repeat(seq, n), np.repeat(owner, n)
        at = (np.cumsum(n) - n)[rule]
        which = seq[rule] - VOCAB
        out[at], out[at + 1] = pairs[which, 0], pairs[which, 1]
        seq = out
    return seq, owner


def expand(pairs: np.ndarray, seq: np.ndarray) -> np.ndarray:
    """The ids that ``seq`` stands for: the rules are unfolded once, then copied."""
    wide = pairs.astype(np.int32)
    flat, owner = _unfold(wide, np.arange(VOCAB, VOCAB + len(pairs), dtype=np.int32))
    length = np.ones(1 << 16, np.int32)
    length[VOCAB : VOCAB + len(pairs)] = np.bincount(owner, minlength=len(pairs))
    # Ids stand in front of the unfolded rules, so one table serves all symbols.
    source = np.concatenate([np.arange(VOCAB, dtype=np.uint32), flat.astype(np.uint32)])
    start = np.arange(1 << 16, dtype=np.int32)
    start[VOCAB : VOCAB + len(pairs)] = VOCAB + np.cumsum(length[VOCAB : VOCAB + len(pairs)]) - length[VOCAB : VOCAB + len(pairs)]
    n = length[seq]
    ends = np.cumsum(n, dtype=np.int32)
    return source[np.repeat(start[seq] - (ends - n), n) + np.arange(int(ends[-1]) if len(ends) else 0, dtype=np.int32)]


def pack(doc_ids: list[int | None], sizes: np.ndarray, ids: np.ndarray) -> bytes:
    if len(ids) and int(ids.max()) >= VOCAB:
        raise ValueError("an id is outside of the vocabulary")
    pairs, lengths, seq = repair(ids)
    known = np.array([d is not None for d in doc_ids], np.uint8)
    numbers = np.array([d or 0 for d in doc_ids], "<i8")
    parts = [b"RPB1", struct.pack("<III", len(doc_ids), len(pairs), len(seq)), numbers.tobytes(), known.tobytes(), sizes.astype("<u4").tobytes(), pairs.astype("<u2").tobytes(), lengths.astype("<u4").tobytes(), seq.astype("<u2").tobytes()]
    return b"".join(parts)


class Block:
    """A blob's parts."""

    def __init__(self, blob: bytes):
        if blob[:4] != b"RPB1":
            raise ValueError("not a block")
        docs, rules, symbols = struct.unpack_from("<III", blob, 4)
        at = 16

        def take(kind: str, n: int) -> np.ndarray:
            nonlocal at
            out = np.frombuffer(blob, kind, n, at)
            at += out.nbytes
            return out

        self.doc_ids, self.known, self.sizes = take("<i8", docs), take("u1", docs), take("<u4", docs)
        self.pairs = take("<u2", 2 * rules).reshape(-1, 2)
        self.lengths, self.seq = take("<u4", rules), take("<u2", symbols)

    def ids(self) -> np.ndarray:
        return expand(self.pairs, self.seq)

    def read_range(self, start: int, stop: int) -> np.ndarray:
        """Ids ``start`` to ``stop``; only symbols that overlap the range are expanded."""
        length = np.ones(len(self.seq), np.int64)
        rule = self.seq >= VOCAB
        length[rule] = self.lengths[self.seq[rule].astype(np.int64) - VOCAB]
        ends = np.cumsum(length)
        first, last = np.searchsorted(ends, start, side="right"), np.searchsorted(ends, stop, side="left") + 1
        got = expand(self.pairs, self.seq[first:last])
        skip = start - int(ends[first - 1] if first else 0)
        return got[skip : skip + max(0, stop - start)]


def write(docs: DataFrame, path: str, vocab: str | None = None) -> None:
    """Encode ``docs`` (doc_id, text) and write the blocks to ``path``."""
    vocab = vocab or vocabulary()
    arrow = arrow_type(BLOCK_SCHEMA)

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        enc, part, block = encoder(vocab), TaskContext.get().partitionId(), 0
        doc_ids: list = []
        sizes: list = []
        held: list = []
        total = 0

        def flush() -> pa.RecordBatch:
            row = {"part": [part], "block": [block], "n_docs": [len(doc_ids)], "n_tokens": [total], "blob": [pack(doc_ids, np.concatenate(sizes), np.concatenate(held))]}
            return pa.RecordBatch.from_pydict(row, schema=arrow)

        for whole in batches:
            for b in slices(whole, "text", BATCH_BYTES):
                ids, n = enc.batch(b.column("text"))
                ends = np.cumsum(n)
                doc_ids += b.column("doc_id").to_pylist()
                sizes.append(n + 1)
                held.append(np.insert(ids, ends, END))
                total += len(ids) + len(n)
                if total >= BLOCK_IDS:
                    yield flush()
                    doc_ids, sizes, held, total, block = [], [], [], 0, block + 1
        if doc_ids:
            yield flush()

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    rows = rows.repartitionByRange(shuffle_width(docs.sparkSession), F.col("doc_id").asc_nulls_first())
    rows.sortWithinPartitions(F.col("doc_id").asc_nulls_first(), "text").mapInArrow(encode, BLOCK_SCHEMA).write.parquet(path)


def read(spark, path: str) -> DataFrame:
    """Per document of the files: doc_id, start, n_tokens and the CRC-32 of its ids.

    Ids before a block: those of the parts before (one number a part, with the driver) and of the
    part's blocks before (a window over the blocks of one part).
    """
    blocks = spark.read.schema(BLOCK_SCHEMA).parquet(path)
    parts = {r["part"]: r["n"] for r in blocks.groupBy("part").agg(F.sum("n_tokens").alias("n")).collect()}
    before, starts = 0, []
    for p in range(max(parts, default=-1) + 1):
        starts.append(before)
        before += parts.get(p, 0)
    arrow = arrow_type(DOC_SCHEMA)

    def decode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.to_pylist():
                b = Block(row["blob"])
                ids = b.ids().astype("<u4")
                ends = np.cumsum(b.sizes.astype(np.int64))
                begins = ends - b.sizes
                data = memoryview(ids).cast("B")
                crc = [zlib.crc32(data[4 * s : 4 * e]) for s, e in zip(begins.tolist(), ends.tolist(), strict=True)]
                n = len(crc)
                cols = [pa.array([row["part"]] * n, pa.int32()), pa.array([row["block"]] * n, pa.int32()), pa.array(b.doc_ids, mask=b.known == 0), pa.array(begins), pa.array(b.sizes.astype(np.int64)), pa.array(crc, pa.int64())]
                yield pa.RecordBatch.from_arrays(cols, schema=arrow)

    docs = blocks.select("part", "block", "blob").mapInArrow(decode, DOC_SCHEMA)
    w = Window.partitionBy("part").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    offsets = blocks.select("part", "block", F.coalesce(F.sum("n_tokens").over(w), F.lit(0)).alias("inner"))
    table = F.expr("array(" + ",".join(f"{s}L" for s in starts or [0]) + ")")
    joined = docs.join(offsets, ["part", "block"])
    return joined.select("doc_id", (F.element_at(table, F.col("part") + 1) + F.col("inner") + F.col("at")).alias("start"), "n_tokens", "ids_crc32")


def token_output(docs: DataFrame, path: str | None = None, vocab: str | None = None) -> DataFrame:
    """Write the documents' ids and return, read back from the files, a row per document."""
    spark = docs.sparkSession
    path = path or f"{shared_dir(spark)}/sleuthwork/tokens-{uuid.uuid4().hex}"
    write(docs, path, vocab)
    return read(spark, path)
