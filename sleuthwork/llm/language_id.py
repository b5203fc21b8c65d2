"""Language identification by cross-parsing with suffix automata.

Training. For each label a sample of texts is taken from rows whose ``crc32(doc_id) mod 3`` is not 1:
rows in the order of a hash of doc_id, until ``SAMPLE_BYTES`` are reached (a documented bound; each text
gives at most its first ``TEXT_CHARS`` characters). Every label's sample becomes a suffix automaton over classes
of bytes, of at most 2 * ``SAMPLE_BYTES`` states; a worker needs 40 MB a label at most.

Prediction. A text is parsed into phrases: each is the longest match of what is left in the automaton
(a byte that the sample lacks is a phrase of its own). A language's cost is its number of phrases times
the bits that name a place in its sample, a cross entropy; the lowest cost a byte wins, ties go to the
label that comes first. Long texts are parsed in lanes of ``LANE`` bytes next to one another, every byte
of the text counts.

``score``: exp of minus the winner's cost a byte, times EVIDENCE, over the sum of those of all
languages; the evidence grows with the length of the text, so short texts score lower.

``und`` with score 0: text that is null or has no letter, or no label to learn from.
Only text is an input of a prediction. Repeated rows are judged alike, an empty table gives no rows. Extra
columns pass through ``identify``.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ._common import arrow_type, buffers, claim, slices

SAMPLE_BYTES = 96 << 10
TEXT_CHARS = 4 << 10
SAMPLE_ROWS = 2_000
LANE = 256
EVIDENCE = 0.05
UNDETERMINED = "und"
SPACE_CLASS = 1

_LETTER = np.zeros(256, bool)
_LETTER[[*range(65, 91), *range(97, 123)]] = True
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32


def held_out(doc_id) -> F.Column:
    return F.crc32(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary")) % 3 == 1


def plain(raw: np.ndarray) -> np.ndarray:
    """Lower-case bytes; ASCII that isn't a letter becomes a space, runs of spaces one."""
    b = _LOWER[raw]
    b[(raw < 128) & ~_LETTER[raw]] = 32
    keep = np.ones(len(b), bool)
    keep[1:] = (b[1:] != 32) | (b[:-1] != 32)
    return b[keep]


def automaton(symbols: list[int], width: int) -> np.ndarray:
    """Transitions of the suffix automaton: row 1 is the start, 0 means none."""
    follow: list[dict[int, int]] = [{}, {}]
    link, length, last = [0, 0], [0, 0], 1
    for c in symbols:
        cur = len(follow)
        follow.append({})
        length.append(length[last] + 1)
        link.append(1)
        p = last
        while p and c not in follow[p]:
            follow[p][c] = cur
            p = link[p]
        if p:
            q = follow[p][c]
            if length[p] + 1 == length[q]:
                link[cur] = q
            else:
                copy = len(follow)
                follow.append(dict(follow[q]))
                length.append(length[p] + 1)
                link.append(link[q])
                while p and follow[p].get(c) == q:
                    follow[p][c] = copy
                    p = link[p]
                link[q] = link[cur] = copy
        last = cur
    out = np.zeros((len(follow), width), np.int32)
    for s, row in enumerate(follow):
        out[s, list(row)] = list(row.values())
        follow[s] = None
    return out


class Model:
    """The labels' automata over common byte classes."""

    def __init__(self, samples: dict[str, bytes]):
        self.labels = sorted(samples)
        texts = [plain(np.frombuffer(samples[k], np.uint8)) for k in self.labels]
        seen = np.unique(np.concatenate(texts)) if texts else np.zeros(0, np.int64)
        #: Class 0 is any byte that no sample has.
        self.classes = np.zeros(256, np.uint8)
        self.classes[seen] = np.arange(1, len(seen) + 1)
        self.width = len(seen) + 1
        self.bits = [float(np.log2(max(2, len(t)))) for t in texts]
        self.next = []
        for t in texts:
            table = automaton(self.classes[t].tolist(), self.width)
            start = np.where(table[1] > 0, table[1], 1)
            start[0] = 1
            # States are stored times the width, so a step is one addition and one look-up.
            table *= self.width
            self.next.append((table.ravel(), (start * self.width).astype(np.int32)))

    def costs(self, raw: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Bits that each language takes for each text (rows of ``off``), and the texts' lengths."""
        rows = len(off) - 1
        owner = np.repeat(np.arange(rows, dtype=np.int32), np.diff(off))
        b = _LOWER[raw]
        b[(raw < 128) & ~_LETTER[raw]] = 32
        keep = np.ones(len(b), bool)
        keep[1:] = (b[1:] != 32) | (b[:-1] != 32) | (owner[1:] != owner[:-1])
        b, owner = self.classes[b[keep]], owner[keep]
        n = np.bincount(owner, minlength=rows)
        lanes = -(-n // LANE)
        first = np.cumsum(n) - n
        lane_owner = np.repeat(np.arange(rows), lanes)
        number = np.arange(lanes.sum()) - np.repeat(np.cumsum(lanes) - lanes, lanes)
        begin = first[lane_owner] + number * LANE
        size = np.minimum(LANE, n[lane_owner] - number * LANE)
        order = np.argsort(-size, kind="stable")
        begin, size, lane_owner = begin[order], size[order], lane_owner[order]
        out = np.zeros((rows, len(self.labels)))
        longest = int(size[0]) if len(size) else 0
        active = np.searchsorted(-size, -np.arange(1, longest + 1), side="right")
        state = [np.full(len(begin), self.width, np.int32) for _ in self.labels]
        phrases = [np.ones(len(begin), np.int32) for _ in self.labels]
        for i in range(longest):
            k = active[i]
            c = b[begin[:k] + i]
            for s, p, (table, start) in zip(state, phrases, self.next, strict=True):
                t = table[s[:k] + c]
                miss = t == 0
                if i:  # a phrase also begins after a byte that the sample lacks
                    p[:k] += miss | (s[:k] == self.width)
                s[:k] = np.where(miss, start[c], t)
        for j, p in enumerate(phrases):
            out[:, j] = np.bincount(lane_owner, p, minlength=rows) * self.bits[j]
        return out, n

    def predict(self, texts: pa.Array) -> tuple[list[str], np.ndarray]:
        raw, off = buffers(texts)
        raw, off = raw[off[0] : off[-1]], off - off[0]
        rows = len(off) - 1
        letters = np.concatenate([[0], np.cumsum(_LETTER[raw], dtype=np.int32)])[off]
        known = np.diff(letters) > 0
        for r in np.flatnonzero(~known & (np.diff(off) > 0)).tolist():
            known[r] = any(ch.isalpha() for ch in raw[off[r] : off[r + 1]].tobytes().decode("utf-8", "replace"))
        if not self.labels:
            return [UNDETERMINED] * rows, np.zeros(rows)
        cost, n = self.costs(raw, off)
        best = cost.argmin(axis=1)
        gap = (cost - cost[np.arange(rows), best][:, None]) * EVIDENCE
        score = 1 / np.exp(-np.minimum(gap, 700)).sum(axis=1)
        return [self.labels[k] if ok else UNDETERMINED for k, ok in zip(best.tolist(), known.tolist(), strict=True)], np.where(known, score, 0.0)


def samples(docs: DataFrame) -> dict[str, bytes]:
    """The bounded training text of each label; at most ``SAMPLE_ROWS`` rows of each are looked at.

    Hashes and ids are ranked without the texts; ranks are cut within each task before any exchange.
    """
    order = F.xxhash64(F.lit("language"), F.col("doc_id"))
    usable = docs.where(F.col("lang").isNotNull() & F.col("text").isNotNull() & ~held_out(F.col("doc_id")))
    ranked = usable.select(F.col("lang").cast("string").alias("lang"), F.substring(F.col("text").cast("string"), 1, TEXT_CHARS).alias("text"), order.alias("h"), F.coalesce(F.col("doc_id").cast("string"), F.lit("")).alias("d"))
    # About as many rows of each label as the sample needs, by a bound on the hash, before anything is moved.
    counts = usable.groupBy(F.col("lang").cast("string").alias("lang")).agg(F.count("*").alias("_sw_c")).collect()
    table = docs.sparkSession.createDataFrame([tuple(r) for r in counts], "lang string, _sw_c long")
    table = F.broadcast(table) if len(counts) <= 100_000 else table  # one row a label
    near = ranked.join(table, "lang").where(F.pmod("h", F.lit(1 << 30)) < F.least(F.lit(1.0), 2.0 * SAMPLE_ROWS / F.col("_sw_c")) * float(1 << 30)).drop("_sw_c")
    w = Window.partitionBy("lang").orderBy(F.pmod("h", F.lit(1 << 30)), "d", "text")
    rows = near.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= SAMPLE_ROWS)
    # Rows go on while the bytes before them are below the bound.
    sizes = F.sum(F.octet_length("text") + 1).over(Window.partitionBy("lang").orderBy("rank"))
    rows = rows.withColumn("size", sizes).where(F.col("size") - F.octet_length("text") <= SAMPLE_BYTES).select("lang", "rank", "text")
    parts: dict[str, list[tuple[int, str]]] = {}
    for r in rows.collect():
        parts.setdefault(r["lang"], []).append((r["rank"], r["text"]))
    return {k: "\n".join(t for _, t in sorted(v)).encode("utf-8")[: SAMPLE_BYTES] for k, v in parts.items() if any(t for _, t in v)}


_MODELS: dict[bytes, Model] = {}


def _model(data: dict[str, bytes]) -> Model:
    """A worker builds the automata of one training sample once."""
    key = hashlib.sha256(repr(sorted(data.items())).encode()).digest()
    claim(_MODELS)
    if key not in _MODELS:
        _MODELS.clear()
        _MODELS[key] = Model(data)
    return _MODELS[key]


def identify(docs: DataFrame, training: dict[str, bytes] | None = None) -> DataFrame:
    """``docs`` with ``_sw_lang`` and ``_sw_score``, predicted from text alone."""
    data = docs.sparkSession.sparkContext.broadcast(samples(docs) if training is None else training)
    fields = [T.StructField(f.name, f.dataType, True) for f in docs.schema.fields]
    schema = T.StructType([*fields, T.StructField("_sw_lang", T.StringType()), T.StructField("_sw_score", T.DoubleType())])
    arrow = arrow_type(schema)
    names = docs.columns

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = _model(data.value)
        for whole in batches:
            for b in slices(whole, "text", 1 << 20):
                lang, score = model.predict(b.column("text"))
                yield pa.RecordBatch.from_arrays([*[b.column(c) for c in names], pa.array(lang, pa.string()), pa.array(score)], schema=arrow)

    return docs.to(T.StructType(fields)).mapInArrow(run, schema)


def languages(docs: DataFrame) -> DataFrame:
    """The contract's rows."""
    data = samples(docs)
    rows = docs.select("doc_id", F.col("text").cast("string").alias("text"))
    found = identify(rows, data)
    return found.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), F.col("_sw_lang").alias("lang_pred"), F.col("_sw_score").alias("score"))


def with_language(docs: DataFrame) -> DataFrame:
    """The documents whose language can be told, with their own columns."""
    return identify(docs).where(F.col("_sw_lang") != UNDETERMINED).select(*docs.columns)
