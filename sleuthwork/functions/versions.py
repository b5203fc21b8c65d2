"""Versions as sort keys: release numbers, pre, post and development parts, NULL for what isn't a version."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from . import fixed as V

#: Decoration of tags before the first digit.
PREFIX = r"(?i)^\s*(?:[A-Za-z][A-Za-z0-9._-]*?[-/@])?(?:v|version[-_]?|release[-_]?)?(?=\d)"
SHAPE = r"(?i)^(?:(\d+)!)?(\d+(?:\.\d+)*)(?:[-_.]?(alpha|a|beta|b|preview|pre|c|rc)[-_.]?(\d+)?)?(?:-(\d+)|[-_.]?(post|rev|r)[-_.]?(\d+)?)?(?:[-_.]?(dev)[-_.]?(\d+)?)?(?:\+([a-z0-9]+(?:[-_.][a-z0-9]+)*))?$"


def _let(value: Column, use) -> Column:
    """``use(value)`` with the value evaluated once: a lambda's variable is bound, an expression is copied."""
    return F.element_at(F.transform(F.array(value), use), 1)


def _read(raw: Column, use) -> Column:
    """``use(groups)`` of a version's parts (of ``SHAPE``, "" where absent); NULL for what isn't a version."""
    clean = F.regexp_replace(F.regexp_replace(F.regexp_replace(raw, r"[\s)\],;]+$", ""), r"^\s+", ""), PREFIX, "")
    cut = "\x1f".join(f"${k}" for k in range(1, 11))
    # A text that holds the separator is no version, so the parts are unambiguous.
    groups = lambda c: F.split(F.regexp_replace(c, SHAPE, cut), "\x1f", -1)
    return _let(clean, lambda c: F.when(c.rlike(SHAPE), _let(groups(c), use)))


def _part(g: Column, k: int) -> Column:
    return F.element_at(g, k)


def _value(g: Column, k: int) -> Column:
    return F.when(_part(g, k) == "", F.lit("0")).otherwise(_part(g, k)).cast("decimal(20,0)")


def _stage(name: Column) -> Column:
    low = F.lower(name)
    return F.when(low.isin("a", "alpha"), "a").when(low.isin("b", "beta"), "b").when(low.isin("c", "rc", "pre", "preview"), "rc")


def _numbers(g: Column) -> Column:
    return F.transform(F.split(_part(g, 2), r"\."), lambda n: n.cast("decimal(20,0)"))


def normalize_version(raw: Column) -> Column:
    """The canonical spelling, e.g. ``abc-v0.1.2-alpha.3`` as ``0.1.2a3``; NULL when unsure."""

    def spell(g: Column) -> Column:
        number, some = lambda k: _value(g, k).cast("string"), lambda k: _part(g, k) != ""
        return F.concat(
            F.when(number(1) != "0", F.concat(number(1), F.lit("!"))).otherwise(""), F.array_join(F.transform(_numbers(g), lambda n: n.cast("string")), "."),
            F.when(some(3), F.concat(_stage(_part(g, 3)), number(4))).otherwise(""), F.when(some(5), F.concat(F.lit(".post"), number(5))).when(some(6), F.concat(F.lit(".post"), number(7))).otherwise(""),
            F.when(some(8), F.concat(F.lit(".dev"), number(9))).otherwise(""), F.when(some(10), F.concat(F.lit("+"), F.regexp_replace(F.lower(_part(g, 10)), "[-_]", "."))).otherwise(""),
        )

    return _read(raw, spell)


def version_key(raw: Column) -> Column:
    """An orderable struct (development < pre < final < post); NULL when unsure."""
    number = lambda n: F.lit(n).cast("decimal(20,0)")

    def key(g: Column) -> Column:
        some = lambda k: _part(g, k) != ""
        # Trailing zeros don't count; 1.0 equals 1.
        release = _let(_numbers(g), lambda ns: F.slice(ns, F.lit(1), F.greatest(F.array_max(F.transform(ns, lambda n, i: F.when(n != 0, i + 1).otherwise(0))), F.lit(0))))
        stage = F.when(some(3), F.when(_stage(_part(g, 3)) == "a", 1).when(_stage(_part(g, 3)) == "b", 2).otherwise(3)).when(some(8) & ~some(5) & ~some(6), 0).otherwise(4)
        post = F.when(some(5), _value(g, 5)).when(some(6), _value(g, 7)).otherwise(number(-1))
        # A local part orders after none; numbers after words, as zero-padded text.
        local = F.transform(F.split(F.regexp_replace(F.lower(_part(g, 10)), "[-_]", "."), r"\."), lambda p: F.when(p.rlike("^[0-9]+$"), F.concat(F.lit("~"), F.lpad(p, 20, "0"))).otherwise(p))
        return F.struct(
            _value(g, 1).alias("epoch"), release.alias("release"), stage.alias("stage"), F.when(some(3), _value(g, 4)).otherwise(number(0)).alias("pre"), post.alias("post"),
            F.when(some(8), _value(g, 9)).otherwise(number(10**18)).alias("dev"), local.alias("local"),
        )

    return _read(raw, key)


def compare(left: Column, right: Column) -> Column:
    """-1, 0 or 1; NULL if either isn't a version."""
    a, b = version_key(left), version_key(right)
    return F.when(a < b, -1).when(a > b, 1).when(a == b, 0)


def is_prerelease(raw: Column) -> Column:
    return _read(raw, lambda g: (_part(g, 3) != "") | (_part(g, 8) != ""))


def normalize_tag(tag: Column, prefixes: list[str]) -> Column:
    """The version of a tag less the first of a profile's prefixes that fits; else of the whole tag."""
    bare = tag
    for p in reversed(prefixes):
        bare = F.when(tag.startswith(p), F.substring(tag, F.lit(len(p) + 1), F.length(tag))).otherwise(bare)
    return F.coalesce(normalize_version(bare), normalize_version(tag)) if prefixes else normalize_version(tag)


def exact_version(raw: Column) -> Column:
    """``x.y.z`` if the text is that and no range; else NULL."""
    found = F.regexp_extract(raw, r"^\s*[v=]?(\d+\.\d+\.\d+(?:[-+.][0-9A-Za-z.+-]+)?)\s*$", 1)
    return F.when(found != "", found)


def report_version(text: Column, patterns: list[str]) -> Column:
    """The version in a report's template field: of the first pattern in the list that hits."""
    hit = lambda p: F.regexp_extract(text, p, 1)
    return F.coalesce(*[F.when(text.rlike(p), F.trim(hit(p))) for p in patterns]) if patterns else F.lit(None).cast("string")


def in_range(raw: Column, low: Column | None = None, high: Column | None = None) -> Column:
    """Half-open: low <= version < high; NULL if any part that is given isn't a version."""
    v = version_key(raw)
    out = F.when(v.isNotNull(), F.lit(True))
    if low is not None:
        out = out & (v >= version_key(low))
    if high is not None:
        out = out & (v < version_key(high))
    return out


def covers(low: Column, high: Column, points: Column, version: Column) -> Column:
    """Whether a runtime bound covers a version: a maximum also covers what it is a text prefix of,
    a point also what continues it after a dot. NULL if that can't be decided."""
    none = F.lit(None).cast("boolean")

    def decide(x: Column) -> Column:
        v, text, lo, hi = x["v"], x["text"], x["lo"], x["hi"]
        below = v < lo
        above = (v > hi) & ~text.startswith(x["high"])
        unsure = (low.isNotNull() & lo.isNull()) | (high.isNotNull() & hi.isNull())
        bounded = F.when(unsure, none).otherwise(~(F.coalesce(below, F.lit(False)) | F.coalesce(above, F.lit(False))))
        listed = F.exists(points, lambda p: F.coalesce((version_key(p) == v) | text.startswith(F.concat(normalize_version(p), F.lit("."))), F.lit(False)))
        return F.when(v.isNull(), none).when(low.isNotNull() | high.isNotNull(), bounded).when(F.size(points) > 0, listed)

    return _let(F.struct(version_key(version).alias("v"), normalize_version(version).alias("text"), version_key(low).alias("lo"), version_key(high).alias("hi"), normalize_version(high).alias("high")), decide)


def canonical_runtime(name: Column) -> Column:
    low = F.lower(name)
    return F.when(low.startswith("node"), "node").otherwise(low)


def canonical_system(name: Column) -> Column:
    out = F.lower(name)
    for alias, system in V.SYSTEM_ALIASES.items():
        out = F.when(F.lower(name) == alias, system).otherwise(out)
    return out


def constraints(text: Column) -> Column:
    """A struct: runtimes (runtime, low, high, points) and systems that a text bounds. Ranges win over points."""
    from .text import find_all

    body = F.coalesce(text, F.lit(""))
    group = lambda pattern, k: find_all(body, pattern, k)
    null, empty = F.lit(None).cast("string"), F.array().cast("array<string>")
    row = lambda r, a, b, p: F.struct(canonical_runtime(r).alias("runtime"), a.alias("low"), b.alias("high"), p.alias("points"))
    ranges = F.transform(F.arrays_zip(group(V.RUNTIME_RANGE, 1).alias("r"), group(V.RUNTIME_RANGE, 2).alias("a"), group(V.RUNTIME_RANGE, 3).alias("b")), lambda z: row(z["r"], z["a"], z["b"], empty))
    lows = F.transform(F.arrays_zip(group(V.RUNTIME_MIN, 1).alias("r"), group(V.RUNTIME_MIN, 2).alias("a")), lambda z: row(z["r"], z["a"], null, empty))
    highs = F.transform(F.arrays_zip(group(V.RUNTIME_MAX, 1).alias("r"), group(V.RUNTIME_MAX, 2).alias("a")), lambda z: row(z["r"], null, z["a"], empty))
    bounds = F.concat(ranges, lows, highs)
    taken = F.flatten(F.transform(bounds, lambda b: F.array(F.concat_ws(" ", b["runtime"], b["low"]), F.concat_ws(" ", b["runtime"], b["high"]))))
    points = F.transform(F.arrays_zip(group(V.RUNTIME_POINT, 1).alias("r"), group(V.RUNTIME_POINT, 2).alias("a")), lambda z: F.struct(canonical_runtime(z["r"]).alias("r"), z["a"].alias("a")))
    points = F.filter(points, lambda z: ~F.array_contains(taken, F.concat_ws(" ", z["r"], z["a"])))
    names = F.array_distinct(F.transform(points, lambda z: z["r"]))
    listed = F.transform(names, lambda n: row(n, null, null, F.array_distinct(F.transform(F.filter(points, lambda z: z["r"] == n), lambda z: z["a"]))))
    systems = F.array_sort(F.array_distinct(F.transform(find_all(body, V.SYSTEMS), canonical_system)))
    return F.struct(F.concat(bounds, listed).alias("runtimes"), systems.alias("systems"))


def applicability(core_version: Column, runtime: Column, runtime_version: Column, system: Column, bounds: Column, source: Column) -> Column:
    """How far a report's environment agrees with bounds: one of ``fixed.SEVERITY``."""
    rank = {name: i for i, name in enumerate(V.SEVERITY)}
    return _let(bounds, lambda b: _applicability(core_version, runtime, runtime_version, system, b, source, rank))


def _applicability(core_version, runtime, runtime_version, system, bounds, source, rank) -> Column:
    asked = F.filter(bounds["runtimes"], lambda c: runtime.isNull() | (c["runtime"] == runtime))
    return _let(F.transform(asked, lambda c: covers(c["low"], c["high"], c["points"], runtime_version)), lambda v: _level(v, core_version, runtime_version, system, bounds, source, rank))


def _level(verdicts, core_version, runtime_version, system, bounds, source, rank) -> Column:
    checked = runtime_version.isNotNull() & (runtime_version != "")
    worst = F.array_max(F.transform(verdicts, lambda v: F.when(v.isNull(), rank["unresolved_version"]).when(~v, F.when(source == "explicit", rank["hard_contradiction"]).otherwise(rank["possible_contradiction"])).otherwise(rank["compatible_unknown"])))
    other = system.isNotNull() & (F.size(bounds["systems"]) > 0) & ~F.array_contains(bounds["systems"], canonical_system(system))
    level = F.greatest(F.when(checked, F.coalesce(worst, F.lit(1))).otherwise(1), F.when(F.coalesce(other, F.lit(False)), rank["possible_contradiction"]).otherwise(1))
    matched = checked & F.exists(verdicts, lambda v: F.coalesce(v, F.lit(False)))
    level = F.when((level == 1) & matched, 0).otherwise(level)
    level = F.when(core_version.isNotNull() & (core_version != "") & version_key(core_version).isNull(), rank["unresolved_version"]).otherwise(level)
    return F.element_at(F.array(*[F.lit(s) for s in V.SEVERITY]), level + 1)
