"""Bodies to content units."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import text as fn

PROSE_LIMIT = 1500
UNIT_SCHEMA = "object_id long, seq int, unit_type string, lang string, text string"


def line_units(df: DataFrame, key: str = "doc_id") -> DataFrame:
    """Lines that aren't blank as units: the form for bodies without fences. Native."""
    pieces = df.select(F.col(key).alias("object_id"), F.posexplode(F.split("text", r"\n")).alias("seq", "text"))
    return pieces.where(F.trim("text") != "").select("object_id", "seq", F.lit("prose").alias("unit_type"), "text")


def _prose(lines: list[str]) -> list[str]:
    """Paragraphs of at most PROSE_LIMIT characters, cut at a line break where there is one."""
    out, block = [], []
    for line in [*lines, ""]:
        if line.strip():
            block.append(line)
            continue
        rest = "\n".join(block).strip()
        block = []
        while rest:
            if len(rest) <= PROSE_LIMIT:
                cut = len(rest)
            else:
                at = rest.rfind("\n", 0, PROSE_LIMIT)
                cut = at if at > 0 else PROSE_LIMIT
            out.append(rest[:cut].strip())
            rest = rest[cut:].strip()
    return out


def _fence(line: str) -> tuple[str, str] | None:
    bare = line.lstrip(" \t")
    if len(line) - len(bare) > 3:
        return None
    sign = bare[:1]
    if sign not in ("`", "~"):
        return None
    run = len(bare) - len(bare.lstrip(sign))
    info = bare[run:].strip()
    if run < 3 or any(not (ch.isalnum() or ch in "_.+-") for ch in info):
        return None
    return sign * run, info


def split_body(body: str | None) -> list[tuple[str, str | None, str]]:
    """(type, language, text) of each unit; fenced blocks stay whole, an unclosed one is kept.

    Blocks have the type ``block``; ``fn.classify_block`` names it.
    """
    units: list[tuple[str, str | None, str]] = []
    prose: list[str] = []
    block: list[str] | None = None
    mark, lang = "", ""
    for line in (body or "").splitlines():
        fence = _fence(line)
        if block is None and fence:
            units += [("prose", None, p) for p in _prose(prose)]
            prose, block, (mark, lang) = [], [], fence
        elif block is None:
            prose.append(line)
        elif fence and fence[0][0] == mark[0] and len(fence[0]) >= len(mark):
            text = "\n".join(block).strip("\n")
            units += [("block", lang or None, text)] if text.strip() else []
            block = None
        else:
            block.append(line)
    if block and (text := "\n".join(block).strip("\n")).strip():
        units.append(("block", lang or None, text))
    return units + [("prose", None, p) for p in _prose(prose)]


def content_units(df: DataFrame, key: str = "doc_id", body: str = "text") -> DataFrame:
    """Fence-aware units, in Arrow batches; the blocks are classified JVM-side."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            rows = [(k, i, t, lang, text) for k, b in zip(pdf["object_id"], pdf["body"], strict=True) for i, (t, lang, text) in enumerate(split_body(b))]
            yield pd.DataFrame(rows, columns=["object_id", "seq", "unit_type", "lang", "text"])

    raw = df.select(F.col(key).cast("long").alias("object_id"), F.col(body).alias("body")).where("body IS NOT NULL").mapInPandas(run, UNIT_SCHEMA)
    kind = F.when(F.col("unit_type") == "block", fn.classify_block(F.col("lang"), F.col("text"))).otherwise(F.col("unit_type"))
    return raw.withColumn("unit_type", kind)
