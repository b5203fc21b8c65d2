"""Text functions: columns in, columns out, all JVM-side."""

from __future__ import annotations

import re._parser as parser
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import fixed as V


def _u(pattern: str) -> str:
    return "(?U)" + pattern


def strings() -> Column:
    return F.array().cast("array<string>")


def find_all(text: Column, pattern: str, group: int = 1) -> Column:
    """All matches of a group; none for null."""
    return F.coalesce(F.regexp_extract_all(text, F.lit(_u(pattern)), F.lit(group)), strings())


def lowered(values: Column) -> Column:
    return F.transform(values, lambda v: F.lower(v))


#: Letters that a case-blind pattern takes for i, k and s, though lower-casing alone does not make them so.
_FOLDED = ("\u0130\u0131\u017f\u212a", "iisk")


def marks(pattern: str) -> list[str]:
    """Lower-cased pieces of text of which every match of a pattern has at least one; none if there is no such piece."""
    def best(sequence) -> list[str]:
        found, run = [], ""
        for op, arg in [*sequence, (None, None)]:
            if op is parser.LITERAL:
                run += chr(arg)
                continue
            found, run = found + ([[run.lower()]] if run else []), ""
            if op is parser.SUBPATTERN and not arg[1] and not arg[2]:
                found.append(best(arg[3]))
            elif op is parser.BRANCH:
                ways = [best(x) for x in arg[1]]
                found.append([m for w in ways for m in w] if all(ways) else [])
            elif op in (parser.MAX_REPEAT, parser.MIN_REPEAT) and arg[0] >= 1:
                found.append(best(arg[2]))
        return max(found, key=lambda ms: (min(map(len, ms), default=0), -len(ms)), default=[])

    return best(parser.parse(pattern))


def folded(text: Column) -> Column:
    """Text as ``marks`` are looked for in it."""
    return F.lower(F.translate(F.coalesce(text, F.lit("")), *_FOLDED))


def _any(low: Column, pieces: list[str]) -> Column:
    return reduce(lambda a, b: a | b, [low.contains(m) for m in pieces])


def normalize(text: Column) -> Column:
    """Volatile fragments out, blanks and line breaks collapsed, trimmed."""
    out = reduce(lambda t, rule: F.regexp_replace(t, _u(rule[0]), rule[1]), V.VOLATILE, text)
    out = F.regexp_replace(F.regexp_replace(out, r"[ \t]+", " "), r"\n{2,}", "\n")
    return F.regexp_replace(out, r"(?U)^\s+|\s+$", "")


def redact(text: Column) -> Column:
    """Credentials, addresses and home folders masked."""
    return reduce(lambda t, rule: F.regexp_replace(t, _u(rule[0]), rule[1]), V.REDACTIONS, text)


def excerpt(text: Column, limit: int = 600) -> Column:
    flat = F.regexp_replace(F.regexp_replace(F.coalesce(text, F.lit("")), r"(?U)\s+", " "), "^ | $", "")
    return F.when(F.length(flat) > limit, F.concat(F.regexp_replace(F.substring(flat, 1, limit - 1), r"\s+$", ""), F.lit("…"))).otherwise(flat)


def body_hash(body: Column) -> Column:
    return F.sha2(F.coalesce(body, F.lit("")), 256)


def sanitize(text: Column) -> Column:
    """Without NUL characters."""
    return F.regexp_replace(text, "\\x00", "")


def config_key(entry: Column) -> Column:
    """The name in ``name=value``; the value is never kept."""
    return F.trim(F.element_at(F.split(entry, "=", 2), 1))


def runtime_parts(text: Column) -> tuple[Column, Column]:
    """``node 24.1`` or ``node@v24`` as (name, version); null where it doesn't parse."""
    pattern = r"^\s*([A-Za-z][A-Za-z.]*)[\s@]*v?(\d[\w.\-]*)?\s*$"
    some = lambda c: F.when(c != "", c)
    return some(F.lower(F.regexp_extract(text, pattern, 1))), some(F.regexp_extract(text, pattern, 2))


def is_structural(token: Column) -> Column:
    """Shaped like a name: symbol, package, path, error type."""
    return (
        token.rlike("[@/_.]") | (token.contains("-") & (F.length(token) >= 6)) | token.rlike("^[a-z]+(?:[A-Z][a-z0-9]+)+$")
        | (token.rlike("[A-Z]") & (F.upper(token) == token) & (F.length(token) >= 4)) | (token.rlike("(error|exception)$") & (F.length(token) > 7))
    )


def is_identifying(token: Column, doc_freq: Column) -> Column:
    return is_structural(token) | (doc_freq <= V.RARE_DOC_FREQ)


def is_discriminative(token: Column) -> Column:
    low = F.btrim(F.lower(token), F.lit(".-_"))
    generic = low.isin(V.GENERIC_TOKENS)
    shaped = token.rlike("[@/_.]") | low.contains("-") | token.rlike("^[a-z]+(?:[A-Z][a-z0-9]+)+$") | token.rlike("^[A-Z][A-Za-z0-9]*(?:Error|Exception|Warning)$")
    shouted = token.rlike("[A-Z]") & (F.upper(token) == token) & (F.length(token) >= 4)
    return ~generic & (F.length(low) >= 4) & ~low.rlike("^[0-9]+$") & ((F.length(low) >= 6) | shaped | shouted)


def first_spellings(values: Column, low: Column) -> Column:
    """Distinct values regardless of case; the first spelling stays. ``low``: the values lower-cased, as a
    column (a nested expression would be evaluated for every element)."""
    return F.filter(values, lambda v, i: F.array_position(low, F.lower(v)) == i + 1)


def tokenize(text: Column) -> Column:
    """Lower-cased words, their parts and dunder names."""
    words = F.filter(F.transform(find_all(text, V.WORD, 0), lambda w: F.btrim(w, F.lit(".-_"))), lambda w: w != "")
    # A word without a sign to cut at is its own part.
    parts = F.flatten(F.transform(words, lambda w: F.when(_any(w, [".", "/", "@"]), F.transform(F.split(w, "[./@]"), lambda p: F.btrim(p, F.lit("-_")))).otherwise(F.array(w))))
    parts = F.filter(parts, lambda p: F.length(p) >= 3)
    return F.array_sort(F.array_distinct(lowered(F.concat(words, parts, find_all(text, V.DUNDER)))))


def with_fingerprint(df: DataFrame, error: Column, context: Column | None = None) -> DataFrame:
    """Adds ``fingerprint``: a struct of signature, hash, tokens, discriminative tokens and typed lists.

    It is made in steps, each a projection of its own, so that no step's pattern is evaluated twice.
    """
    keep = df.columns
    source = F.concat_ws("\n", F.when(error != "", error), *([F.when(context != "", context)] if context is not None else []))
    df = df.withColumn("_sig", normalize(source))
    sig = F.col("_sig")
    patterns = {"exceptions": V.EXCEPTION, "codes": V.ERROR_CODE, "packages": V.PACKAGE, "frames": V.FRAME, "files": V.FILE}
    raw = {f"_{n}": find_all(sig, p) for n, p in patterns.items()}
    shapes = [find_all(sig, p) for p in (V.BACKTICK, V.DUNDER, V.DOTTED, V.CAMEL, V.HYPHEN_MODULE, V.HTTP_ROUTE)]
    raw["_symbols"] = F.filter(F.transform(F.concat(*shapes), lambda s: F.trim(s)), lambda s: (s != "") & ~s.rlike("^[0-9]+$"))
    raw["_versions"], raw["_plain"] = find_all(sig, V.VERSIONISH, 0), find_all(sig, V.PLAIN_WORD, 0)
    df = df.withColumns(raw)
    df = df.withColumn("_codes", F.array_except("_codes", "_exceptions"))
    lists = [*patterns, "symbols", "versions"]
    df = df.withColumns({f"_l_{n}": lowered(F.col(f"_{n}")) for n in lists})
    df = df.withColumns({f"_{n}": first_spellings(F.col(f"_{n}"), F.col(f"_l_{n}")) for n in lists})
    pool = F.concat(*[F.col(f"_{n}") for n in ("exceptions", "codes", "packages", "symbols", "frames", "files", "plain")])
    made = F.struct(
        sig.alias("signature"), F.when(sig == "", F.lit("")).otherwise(F.substring(F.sha2(F.lower(sig), 256), 1, 32)).alias("hash"), tokenize(sig).alias("tokens"),
        F.array_distinct(lowered(F.filter(pool, is_discriminative))).alias("discriminative"), *[F.col(f"_{n}").alias(n) for n in lists],
    )
    return df.select(*keep, made.alias("fingerprint"))


def query_tokens(discriminative: Column) -> Column:
    """At most 24: structural ones first, then the longest; the given order breaks ties."""
    usable = F.array_distinct(F.filter(discriminative, lambda t: F.length(t) >= 4))
    ranked = F.transform(usable, lambda t, i: F.struct(F.when(t.rlike(r"[@/_.\-]"), 0).otherwise(1).alias("r"), (-F.length(t)).alias("n"), i.alias("i"), t.alias("t")))
    return F.transform(F.slice(F.array_sort(ranked), 1, V.MAX_QUERY_TOKENS), lambda x: x["t"])


def stem(word: Column) -> Column:
    """A light stem: ies to y, else one of ing, ed, es, s off where enough stays."""
    low = F.regexp_replace(F.lower(word), r"^[`'\".,;:()\[\]{}]+|[`'\".,;:()\[\]{}]+$", "")
    n = F.length(low)
    out = low
    for suffix in ("s", "es", "ed", "ing"):
        out = F.when(low.endswith(suffix) & (n > len(suffix) + 3), F.substring(low, F.lit(1), n - len(suffix))).otherwise(out)
    return F.when(low.endswith("ies") & (n > 4), F.concat(F.substring(low, F.lit(1), n - 3), F.lit("y"))).otherwise(out)


ABSENCE = r"(?i)\b(?:" + "|".join(V.ABSENCE_MARKERS) + r")\b[\s,]*((?:[\w@./`_-]+[\s]+){0,4}[\w@./`_-]+)"


def behaviour(text: Column) -> Column:
    """``absent:stem`` facts: what a report says did not happen or was not there."""
    words = F.flatten(F.transform(find_all(text, ABSENCE), lambda w: F.split(w, r"(?U)[\s,]+")))
    kept = F.filter(F.transform(words, stem), lambda s: (F.length(s) >= 3) & ~s.isin(V.BEHAVIOUR_STOP) & ~s.rlike("^[0-9]+$"))
    return F.array_sort(F.array_distinct(F.transform(kept, lambda s: F.concat(F.lit("absent:"), s))))


def components(text: Column, low: Column | None = None) -> Column:
    """Areas named in a text; ``low``: the text lower-cased, where that is a column already."""
    low = F.lower(F.coalesce(text, F.lit(""))) if low is None else low
    return F.array_sort(F.array_compact(F.array(*[F.when(low.contains(c) & low.rlike(_u(rf"\b{c}s?\b")), F.lit(c)) for c in V.COMPONENTS])))


def causes(text: Column, folded_: Column | None = None) -> Column:
    """Stated causes; a pattern is only looked for in a text that has one of its marks (``folded_``: see ``folded``)."""
    body = F.coalesce(text, F.lit(""))
    low = folded(text) if folded_ is None else folded_
    found = []
    for name, patterns in V.CAUSES.items():
        pieces = [marks(p) for p in patterns]
        hit = body.rlike("(?iU)(?:" + "|".join(f"(?:{p})" for p in patterns) + ")")
        found.append(F.when(_any(low, sorted({m for ms in pieces for m in ms})) & hit if all(pieces) else hit, F.lit(name)))
    return F.array_sort(F.array_compact(F.array(*found)))


def source_paths(text: Column, low: Column | None = None) -> Column:
    """Tokens with a folder and a source suffix; cut, not matched, so nothing backtracks. A text without a suffix is not cut."""
    low = F.lower(F.coalesce(text, F.lit(""))) if low is None else low
    placed = F.filter(F.split(low, r"[\s()\[\]{}<>|=]+"), lambda t: _any(t, ["/", "\\"]))
    tokens = F.transform(placed, lambda t: F.regexp_replace(F.regexp_replace(t, r":\d+(:\d+)?$", ""), "^['\"`.,;]+|['\"`.,;]+$", ""))
    found = F.filter(tokens, lambda t: t.rlike("(" + "|".join(s.replace(".", r"\.") for s in V.SOURCE_SUFFIXES) + ")$"))
    return F.when(_any(low, V.SOURCE_SUFFIXES) & _any(low, ["/", "\\"]), found).otherwise(strings())


def path_tails(paths: Column) -> Column:
    """The last two parts of each path, or three where the folder names nothing; else dropped."""
    def tail(p: Column) -> Column:
        parts = F.filter(F.split(F.regexp_replace(p, r"\\", "/"), "/"), lambda x: x != "")
        n = F.size(parts)
        at = lambda k: F.get(parts, n - k)
        generic = lambda k: at(k).isin(V.GENERIC_PATH_DIRS)
        return F.when((n >= 2) & ~generic(2), F.array_join(F.slice(parts, n - 1, 2), "/")).when((n >= 3) & ~generic(3), F.array_join(F.slice(parts, F.greatest(n - 2, F.lit(1)), 3), "/"))

    return F.array_sort(F.array_distinct(F.array_compact(F.transform(paths, tail))))


def symptom_paths(text: Column) -> tuple[Column, Column]:
    """Source paths that a report names: tails of two and three parts, and file names that tell something."""
    tidy = lambda p: F.regexp_replace(F.lower(F.regexp_replace(p, r"\\", "/")), r"^[./]+", "")
    sources = F.filter(F.transform(find_all(text, V.PATH_IN_TEXT), tidy), lambda p: p.rlike("(" + "|".join(s.replace(".", r"\.") for s in V.PATH_SUFFIXES) + ")$"))
    split = F.transform(sources, lambda p: F.filter(F.split(p, "/"), lambda x: x != ""))
    last = lambda parts: F.element_at(parts, -1)
    tail = lambda parts, k: F.slice(parts, F.size(parts) - k + 1, k)
    tells = lambda t: ~last(t).isin(V.GENERIC_BASENAMES) | ((F.size(t) >= 3) & ~F.element_at(t, 1).isin(V.GENERIC_DIRS))
    of = lambda k: F.filter(F.transform(F.filter(split, lambda p: F.size(p) >= k), lambda p: tail(p, k)), tells)
    tails = F.array_sort(F.array_distinct(F.transform(F.concat(of(2), of(3)), lambda t: F.array_join(t, "/"))))
    names = F.concat(F.transform(F.filter(split, lambda p: F.size(p) > 0), last), F.transform(find_all(text, V.FILE_IN_TEXT), tidy))
    return tails, F.array_sort(F.array_distinct(F.filter(names, lambda n: ~n.isin(V.GENERIC_BASENAMES))))


def references(text: Column) -> Column:
    """References as structs (kind, value, confidence), in order and not yet distinct; URLs are read first and then left out."""
    raw = F.coalesce(text, F.lit(""))
    url = lambda g: find_all(raw, V.REF_URL, g)
    kinds = F.create_map(*[x for k, v in V.REF_KINDS.items() for x in (F.lit(k), F.lit(v))])
    from_urls = F.transform(F.arrays_zip(url(3).alias("s"), url(4).alias("t")), lambda z: F.struct(F.element_at(kinds, F.lower(z["s"])).alias("kind"), F.regexp_extract(F.regexp_replace(z["t"], r"[.,);]+$", ""), r"^([^#?]*)", 1).alias("v")))
    from_urls = F.transform(from_urls, lambda z: F.struct(z["kind"].alias("kind"), F.when(z["kind"] == "release", F.regexp_replace(z["v"], "^tag/", "")).otherwise(z["v"]).alias("value"), F.lit("high").alias("confidence")))
    bare = F.regexp_replace(raw, _u(V.REF_URL), " ")
    made = lambda values, kind, sure: F.transform(values, lambda v: F.struct(F.lit(kind).alias("kind"), v.alias("value"), sure(v).alias("confidence")))
    shas = F.filter(find_all(bare, V.REF_SHA), lambda s: ~s.rlike("^[0-9]+$"))
    every = F.concat(
        from_urls, made(find_all(bare, V.REF_NUMBER), "number", lambda v: F.lit("high")),
        made(shas, "commit", lambda v: F.when(F.length(v) >= 12, "high").otherwise("medium")), made(find_all(bare, V.REF_VERSION), "version", lambda v: F.lit("medium")),
    )
    return every


def ilike_token(token: Column) -> Column:
    """A LIKE pattern for tokens read as unescaped patterns: a stray backslash escapes what follows."""
    kept = F.regexp_replace(token, r"\\([^%_\\])", "$1")
    return F.concat(F.lit("%"), F.regexp_replace(kept, r"\\$", ""), F.lit("%"))


def repository_slug(url: Column) -> Column:
    """``owner/name`` of a git URL; null if there is none."""
    slug = F.regexp_extract(url, r"^(?:[a-z+]+://(?:[^@/]+@)?[^/]+/|[^@\s]+@[^:\s]+:)([^/\s]+/[^/\s]+?)(?:\.git)?/?$", 1)
    return F.when(slug != "", slug)


def classify_block(lang: Column, text: Column) -> Column:
    """Type of a fenced block: config, log or code."""
    low = F.lower(F.coalesce(lang, F.lit("")))
    log = text.rlike(r"(?Um)\b(?:Error|Exception|Traceback|panic|FATAL|WARN|ERR!)\b|^\s+at\s+\S+|^\s*File \".*\", line \d+|\b[A-Z][A-Za-z]*(?:Error|Exception)\b|\b(?:ENOENT|ECONNREFUSED|ETIMEDOUT|EACCES|MODULE_NOT_FOUND)\b")
    return (
        F.when(low.isin("json", "jsonc", "json5", "yaml", "yml", "toml", "ini", "env", "dotenv"), "config")
        .when(low.isin("log", "logs", "console", "output", "text", "txt", "", "bash", "sh", "shell", "powershell", "ps1") & log, "log").otherwise("code")
    )
