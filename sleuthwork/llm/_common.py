"""Helpers that the operators of this package share.

* ``materialize`` cuts lineage with a Parquet table in the shared folder named by
  ``spark.checkpoint.dir`` (a local folder is used only where the setting is absent).
* ``splitters``/``bucket_of`` range-partition by a numeric key without a global sort.
* ``Words`` tokenises a whole Arrow batch of texts with NumPy, straight from the Arrow
  buffers, so that no Python object is made per word.
"""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

_LOCAL: list[str] = []


def shared_dir(spark: SparkSession) -> str:
    """The folder all executors share; a temporary one only where none is configured, in local runs."""
    root = spark.conf.get("spark.checkpoint.dir", None)
    if root:
        return root.rstrip("/")
    if not spark.sparkContext.master.startswith("local") or spark.sparkContext.master.startswith("local-cluster"):
        raise ValueError("spark.checkpoint.dir has to name a folder that all executors share")
    if not _LOCAL:
        _LOCAL.append(tempfile.mkdtemp(prefix="sleuthwork-"))
    return "file://" + _LOCAL[0]


def materialize(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` once to the shared folder and return a reader of it."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/sleuthwork/{name}-{uuid.uuid4().hex}"
    df.write.option("compression", "zstd").parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out._sw_path = path
    return out


def discard(*tables: DataFrame | None) -> None:
    """Remove tables that ``materialize`` wrote and that no later plan reads."""
    for t in tables:
        path = getattr(t, "_sw_path", None)
        if path:
            spark = t.sparkSession
            at = spark._jvm.org.apache.hadoop.fs.Path(path)
            at.getFileSystem(spark._jsc.hadoopConfiguration()).delete(at, True)


def reachable(spark: SparkSession) -> None:
    """Let Python workers import this package where it isn't installed, from the driver's folder."""
    import os

    root = os.path.dirname(os.path.dirname(os.path.dirname(os.path.abspath(__file__))))
    env = spark.sparkContext.environment
    known = env.get("PYTHONPATH", "").split(os.pathsep)
    if root not in known:
        env["PYTHONPATH"] = os.pathsep.join([root, *filter(None, known)])


_HELD: list[dict] = []


def claim(cache: dict | None = None) -> None:
    """Called in a Python worker that begins a task: caches of other operators are given back to the
    system, so a worker that many stages share holds one operator's tables at a time."""
    others = [c for c in _HELD if c is not cache and c]
    if cache is not None and not any(c is cache for c in _HELD):
        _HELD.append(cache)
    if others:
        import ctypes
        import gc

        for c in others:
            c.clear()
        gc.collect()
        try:
            ctypes.CDLL(None).malloc_trim(0)
        except (OSError, AttributeError):  # another C library
            pass


def shuffle_width(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions", "200"))


def splitters(df: DataFrame, key: str, n: int) -> list[int]:
    """At most ``n - 1`` ascending values of the integer column ``key`` that cut it evenly.

    Only these values reach the driver. Nulls are ignored; an empty table gives none.
    """
    n = max(1, min(n, 1 << 16))
    if n == 1:
        return []
    at = [i / n for i in range(1, n)]
    got = df.agg(F.percentile_approx(F.col(key), at, max(10_000, 8 * n)).alias("p")).first()["p"]
    return sorted({int(x) for x in got or []})


def _longs(values: list[int]) -> Column:
    return F.expr("array(" + ",".join(f"{v}L" for v in values) + ")")


def bucket_of(key: Column, cuts: list[int]) -> Column:
    """How many of the ascending ``cuts`` are at or below ``key`` (null: 0).

    Two short scans (a coarse and a fine one) replace a scan of all cuts.
    """
    if not cuts:
        return F.lit(0)
    step = max(1, int(len(cuts) ** 0.5))
    below = lambda arr: F.size(F.filter(arr, lambda s: s <= key))
    if step < 4:
        return below(_longs(cuts))
    block = F.greatest(below(_longs(cuts[::step])) - 1, F.lit(0))
    return block * step + below(F.slice(_longs(cuts), block * step + 1, step))


def arrow_type(schema: str | T.StructType) -> pa.Schema:
    from pyspark.sql.pandas.types import to_arrow_schema

    return to_arrow_schema(T._parse_datatype_string(schema) if isinstance(schema, str) else schema)


def slices(batch: pa.RecordBatch, column: str, limit: int = 2 << 20) -> Iterator[pa.RecordBatch]:
    """Parts of ``batch`` with about ``limit`` bytes of ``column`` each, at least one row."""
    if not batch.num_rows:
        return
    _, off = buffers(batch.column(column))
    start = 0
    while start < batch.num_rows:
        end = int(np.searchsorted(off, off[start] + limit, side="right")) - 1
        end = min(max(end, start + 1), batch.num_rows)
        yield batch.slice(start, end - start)
        start = end


def buffers(col: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Bytes and row offsets of a string column; a null row is empty."""
    if isinstance(col, pa.ChunkedArray):
        col = col.combine_chunks()
    if col.null_count:
        col = col.fill_null("")
    if not (pa.types.is_string(col.type) or pa.types.is_large_string(col.type)):
        col = col.cast(pa.string())
    wide = pa.types.is_large_string(col.type)
    _, offs, data = col.buffers()
    off = np.frombuffer(offs, dtype=np.int64 if wide else np.int32)[col.offset : col.offset + len(col) + 1].astype(np.int64)
    raw = np.frombuffer(data, dtype=np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)
    return raw, off


def _table(seed: int) -> np.ndarray:
    return np.random.Generator(np.random.PCG64(seed)).integers(1, 2**63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)


_BYTE = _table(20240601)
_BYTE[65:91] = _BYTE[97:123]  # A-Z count as a-z
_P = np.uint64(0x9E3779B97F4A7C15)
_PINV = np.uint64(pow(0x9E3779B97F4A7C15, -1, 1 << 64))
_POWERS: dict[str, np.ndarray] = {}


def _powers(name: str, base: np.uint64, n: int) -> np.ndarray:
    have = _POWERS.get(name)
    if have is None or len(have) < n:
        size = max(1 << 16, 1 << (n - 1).bit_length())
        have = np.cumprod(np.concatenate([np.ones(1, np.uint64), np.full(size - 1, base, np.uint64)]))
        if size <= 1 << 23:
            _POWERS[name] = have
    return have[:n]


def mix(x: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser (the splitmix64 constants)."""
    x = x ^ (x >> np.uint64(30))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x = x ^ (x >> np.uint64(27))
    x = x * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


SPACE = np.zeros(256, bool)
SPACE[[0x20, *range(0x09, 0x0E)]] = True
#: Bytes that end a word of letters and digits: all of ASCII but 0-9, A-Z and a-z.
PUNCT = np.ones(256, bool)
PUNCT[0x80:] = False
PUNCT[0x30:0x3A] = PUNCT[0x41:0x5B] = PUNCT[0x61:0x7B] = False


class Words:
    """Words of a column of texts: 64-bit hashes, byte ranges and the rows' word offsets.

    A word is a maximal run of bytes that are not in ``breaks``; A-Z count as a-z.
    """

    def __init__(self, col: pa.Array, breaks: np.ndarray):
        raw, off = buffers(col)
        base, top = (int(off[0]), int(off[-1])) if len(off) else (0, 0)
        raw, off = raw[base:top], off - base
        self.raw, self.rows = raw, len(off) - 1
        n = len(raw)
        if not n:
            self.start = self.end = np.zeros(0, np.int64)
            self.hash = np.zeros(0, np.uint64)
            self.bounds = np.zeros(self.rows + 1, np.int64)
            return
        inside = ~breaks[raw]
        first = inside.copy()
        first[1:] &= ~inside[:-1]
        cuts = off[1:-1]
        cuts = cuts[(cuts > 0) & (cuts < n)]
        first[cuts] = inside[cuts]
        self.start = np.flatnonzero(first)
        last = inside.copy()
        last[:-1] &= ~inside[1:]
        last[cuts - 1] = inside[cuts - 1]
        self.end = np.flatnonzero(last) + 1
        sums = np.empty(n + 1, np.uint64)
        sums[0] = 0
        np.cumsum(_BYTE[raw] * _powers("p", _P, n), out=sums[1:])
        self.hash = mix((sums[self.end] - sums[self.start]) * _powers("q", _PINV, n)[self.start])
        self.bounds = np.searchsorted(self.start, off).astype(np.int64)

    def shingles(self, k: int) -> tuple[np.ndarray, np.ndarray]:
        """Hashes of all runs of ``k`` words of a row, and the rows' offsets into them.

        A row of fewer words, but not none, has its whole sequence as its one shingle.
        """
        h, b = self.hash, self.bounds
        counts = np.diff(b)
        m = np.where(counts >= k, counts - k + 1, (counts > 0).astype(np.int64))
        out_b = np.concatenate([[0], np.cumsum(m)])
        if not out_b[-1]:
            return np.zeros(0, np.uint64), out_b
        if len(h) >= k:
            full = np.zeros(len(h) - k + 1, np.uint64)
            for i in range(k):
                full += h[i : len(h) - k + 1 + i] * _powers("s", np.uint64(0xD6E8FEB86659FD93), k + 1)[i + 1]
            full = mix(full)
        else:
            full = np.zeros(0, np.uint64)
        at = np.repeat(b[:-1] - out_b[:-1], m) + np.arange(out_b[-1])
        short = np.flatnonzero((counts > 0) & (counts < k))
        if not len(short):
            return full[at], out_b
        out = np.zeros(out_b[-1], np.uint64)
        ok = np.repeat(counts >= k, m)
        out[ok] = full[at[ok]]
        for r in short:
            w = h[b[r] : b[r + 1]]
            v = (w * _powers("s", np.uint64(0xD6E8FEB86659FD93), k + 1)[1 : len(w) + 1]).sum(dtype=np.uint64)
            out[out_b[r]] = mix(np.array([v + np.uint64(len(w))], np.uint64))[0]
        return out, out_b


def distinct_sorted(values: np.ndarray, bounds: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Each row's distinct values in ascending order, and the rows' new offsets."""
    values = values.copy()
    for s, e in zip(bounds[:-1].tolist(), bounds[1:].tolist(), strict=True):
        if e - s > 1:
            values[s:e].sort()
    keep = np.ones(len(values), bool)
    keep[1:] = values[1:] != values[:-1]
    starts = bounds[:-1][np.diff(bounds) > 0]
    keep[starts] = True
    new = np.concatenate([[0], np.cumsum(keep)])[bounds]
    return values[keep], new


def hex_digest(col: Column) -> Column:
    return F.sha2(col, 256)
