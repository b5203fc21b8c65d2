"""Who a report blames: packages with a relation and a state, modules, quotations, unread claims.

The one operator that reads language, so the one that is Python: Arrow batches in, long rows out. A text is
cut into clauses; a clause's subject is a package named in it, a word that points back at one, or
something else; its predicate is read by a word scanner. What cannot be read is kept as such and blocks
later decisions instead of being guessed.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import fixed as V

# Endings of adjectives; labels of provenance.
ADJECTIVES = ("ing", "ed", "ive", "able", "ible", "ful", "less", "ous", "ary", "ent", "ant", "istic", "wide")
PROVENANCE = re.compile(
    r"\b(?:quoted|copied|taken|reproduced|pasted)\s+from\b|\b(?:documentation|docs?|upstream|vendor|old|previous|earlier|another|unrelated|archived|retired|resolved|historical|legacy)\b"
    r"[^:]{0,40}?\b(?:example|ticket|issue|thread|report|incident|discussion)\b|\bfor\s+(?:reference|comparison)\b|\bexample\s+only\b|\bnot\s+our\s+incident\b",
    re.IGNORECASE,
)
NAME = re.compile(r"@[\w.-]*[\w-]/[\w.-]*[\w-](?:/[\w.-]*[\w-])*|\b(?!node:)[a-z][\w.-]{2,}(?=@[\^~>=<]*\d)")

_FAIL, _ACT, _WELL = set(V.FAILURES), set(V.ACTIONS), set(V.HEALTHY)
_NOT = {"cannot", "never", "not"}
_COPULA = set("is was are were be been looks look seems seem remains remain has have had will would can could does did do still also again now".split())
_LINK = re.compile(r"[,;:]|--?\s|\b(?:and|but|then|yet|which|that|when|while|however|so|because)\b")
_POINTER = re.compile(r"^(?:it|they|said\s+\w+|(?:this|that|the)\s+(?:package|module|library|dependency|plugin|component|thing))\s+")
# Cues before a name.
_USES = re.compile(
    r"(?:depends?\s+(?:up)?on|dependenc(?:y|ies)(?:\s+on)?|uses?|using|used\s+by|imports?|imported|importing|requires?|required|requiring|installs?|installed|installing|bundles?|bundled|bundling|"
    r"pulls?\s+in|via|through|resolve[sd]?\s+to|pinned|upgraded?|version)\b[^.\n]{0,30}$"
)
_BLAMED_BEFORE = re.compile(r"(?:error\s+(?:in|loading|from)|problem\s+(?:in|with)|crash(?:es|ed)?\s+in|thrown\s+by|raised\s+(?:from|by)|coming\s+from|broken\s+in|missing)\s+[\"'`]?$")
_NEGATED_BEFORE = re.compile(r"(?:(?:do|does|did|is|was|could|can|would|will)\s*(?:not|n['’]t)|cannot|never|unable\s+to|fail(?:s|ed)?\s+to)\s+([a-z-]+)(?:\s+\w+){0,2}\s+[\"'`]?$")
SENTENCE = re.compile(r"[.!?](?=\s|$)|\n")
SCHEMA = "object_id long, view string, kind string, value string"


def quoted_spans(text: str) -> list[tuple[int, int]]:
    """Fenced blocks, ``>`` lines, and indented lines after a line that says whose they are."""
    spans: list[tuple[int, int]] = []
    at, fence, handed = 0, None, False
    for line in text.splitlines(keepends=True):
        bare = line.strip()
        end = at + len(line.rstrip("\r\n"))
        mark = bare[:3] in ("```", "~~~")
        if fence is not None:
            if mark:
                spans.append((fence, at))
                fence = None
        elif mark:
            fence = at + len(line)
        elif bare.startswith(">") or (handed and line.startswith(("    ", "\t"))):
            spans.append((at, end))
        elif bare:
            handed = bare.endswith(":") and bool(PROVENANCE.search(bare))
        at += len(line)
    if fence is not None:
        spans.append((fence, len(text)))
    return spans


def blank(text: str, spans: list[tuple[int, int]]) -> str:
    """The text with the spans blanked, offsets kept."""
    out = list(text)
    for s, e in spans:
        out[s:e] = [ch if ch == "\n" else " " for ch in out[s:e]]
    return "".join(out)


def read_predicate(words: list[str]) -> str | None:
    """``failing``, ``healthy``, ``unread`` (a claim in unknown words) or None (no claim)."""
    negated, i = False, 0
    while i < len(words):
        w = words[i]
        nxt = words[i + 1] if i + 1 < len(words) else ""
        if w in _NOT or w.endswith(("n't", "n’t")) or (w in ("unable", "fails", "failed", "fail") and nxt == "to"):
            negated, i = True, i + (2 if nxt == "to" else 1)
            continue
        if w in _COPULA or w in ("to", "just", "simply", "completely", "perfectly"):
            i += 1
            continue
        if w in ("stopped", "ceased", "quit"):
            return "healthy" if negated else "failing"
        if w == "up" and words[i + 1 : i + 3] == ["to", "date"]:
            w = "up-to-date"
        if w in _FAIL:
            return "healthy" if negated else "failing"
        if w in _WELL:
            return "failing" if negated else "healthy"
        if w in _ACT:
            return "failing" if negated else None
        return "unread" if negated or i > 0 or (w.isalpha() and w.endswith("s") and len(w) > 4) else None
    return None


def _words(clause: str) -> list[str]:
    return re.findall(r"[\w'’@/.-]*[\w]", clause)


def _aliases(name: str) -> list[str]:
    """A scoped name with sub-path also stands for its package."""
    parts = name.split("/")
    return [name] if len(parts) < 3 or not name.startswith("@") else [name, "/".join(parts[:2])]


def read(text: str) -> tuple[dict[str, set[str]], dict[str, set[str]], set[str]]:
    """States of each package, relations of each, and flags of claims that have no package or can't be read."""
    states: dict[str, set[str]] = {}
    uses: dict[str, set[str]] = {}
    flags: set[str] = set()
    low = text.lower()
    names = [(m.start(), m.end(), _aliases(m.group())[-1]) for m in NAME.finditer(low)]
    at = 0
    seen: list[str] = []
    for stop in [*(m.end() for m in SENTENCE.finditer(low)), len(low)]:
        here = [n for n in names if at <= n[0] < stop]
        for k, (s, e, name) in enumerate(here):
            states.setdefault(name, set())
            left = low[max(at, s - 48, here[k - 1][1] if k else at) : s]
            right = low[e : min(stop, e + 60, here[k + 1][0] if k + 1 < len(here) else stop)]
            right = re.sub(r"^@[\^~>=<]*[\w.-]+", "", right)
            if _USES.search(left):
                uses.setdefault(name, set()).add("dependency")
            before = _NEGATED_BEFORE.search(left)
            if _BLAMED_BEFORE.search(left):
                states[name].add("failing")
            elif before:
                verb = before.group(1)
                states[name].add("failing" if verb in _ACT or verb in _WELL else "healthy" if verb in _FAIL else "ambiguous")
            cut = [0, *(m.end() for m in _LINK.finditer(right))]
            for c in cut:
                clause = right[c:].strip().rstrip(".!?")
                pointer = _POINTER.match(clause)
                found = read_predicate(_words(clause[pointer.end() :] if pointer else clause))
                if found in ("failing", "healthy"):
                    states[name].add(found)
                elif found == "unread" and pointer:
                    flags.add("pointed")
                elif c and not pointer and any(w in _FAIL for w in _words(clause)[1:4]):
                    states[name].add("ambiguous")
            seen.append(name)
        if not here:
            clause = low[at:stop].strip().rstrip(".!?").strip()
            pointer = _POINTER.match(clause)
            found = read_predicate(_words(clause[pointer.end() :] if pointer else clause))
            known = set(seen)
            if pointer and found:
                if len(known) == 1 and found in ("failing", "healthy"):
                    states[next(iter(known))].add(found)
                elif len(known) == 1:
                    flags.add("pointed")
                else:
                    flags.add("pointed_unnamed")
            elif not pointer and any(w in _FAIL for w in _words(clause)[1:5]):
                flags.add("unbound")
        at = stop
    return states, uses, flags


def role(states: set[str], uses: set[str]) -> str:
    """The class a package's states and relations put it in."""
    if {"failing", "healthy"} <= states:
        return "conflicted"
    if "failing" in states:
        return "subject_package"
    if "ambiguous" in states:
        return "unresolved"
    if "healthy" in states:
        return "healthy"
    return "subject_dependency" if uses else "unresolved"


def is_module(token: str, text: str, known: frozenset[str]) -> bool:
    """A hyphenated name that the corpus, the syntax around it or its last part shows to be a module."""
    parts = token.split("-")
    last = parts[-1]
    one = last[:-1] if last.endswith("s") and len(last) > 3 else last
    shaped = all(len(p) > 1 for p in parts) and not last.endswith(ADJECTIVES) and (last in V.MODULE_NOUNS or one in V.MODULE_NOUNS or (len(last) >= 5 and last.endswith(("er", "or", "ers", "ors"))))
    t = re.escape(token)
    return token in known or shaped or bool(re.search(rf"[`\"']{t}[`\"']|\b{t}[/\\.][\w./\\-]|\b{t}@[\w.-]|(?m:^\s*{t}\s*:)|\b(?:package|module|plugin|vendor|import|require|from|dependency)\s+[`\"']?{t}", text, re.IGNORECASE))


def features(text: str, known: frozenset[str] = frozenset()) -> list[tuple[str, str]]:
    """(kind, value) of one text."""
    states, uses, flags = read(text)
    rows = [(role(s, uses.get(n, set())), n) for n, s in states.items()]
    low = text.lower()
    rows += [("builtin", m.group()) for m in re.finditer(r"\bnode:[\w/]+", low)]
    for m in re.finditer(r"\b[a-z][a-z0-9]*(?:-[a-z0-9]+){1,4}\b", low):
        token = m.group()
        if len(token) >= 6 and not any(token in n for n in states) and is_module(token, text, known):
            rows.append(("subject_module", token))
    return sorted({*rows, *((f, "true") for f in flags)})


def classify(df: DataFrame, key: str = "doc_id", text: str = "text", modules: list[str] | None = None) -> DataFrame:
    """``object_id, view, kind, value``: roles and claims come from what a report states, not from what it
    quotes; the view ``quoted`` has the packages of the quotations."""
    known = frozenset(modules or ())

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            out = []
            for k, t in zip(pdf["object_id"], pdf["text"], strict=True):
                spans = quoted_spans(t)
                out += [(k, "stated", kind, value) for kind, value in features(blank(t, spans), known)]
                inside = "\n".join(t[s:e] for s, e in spans)
                out += [(k, "quoted", kind, value) for kind, value in (features(inside, known) if inside.strip() else []) if not kind.startswith(("pointed", "unbound"))]
            yield pd.DataFrame(out, columns=["object_id", "view", "kind", "value"])

    rows = df.where(F.col(text).isNotNull()).select(F.col(key).cast("long").alias("object_id"), F.col(text).alias("text"))
    return rows.mapInPandas(run, SCHEMA)


def two_pass(df: DataFrame, key: str = "doc_id", text: str = "text", limit: int = 100_000) -> DataFrame:
    """Mining in two passes: the module names that the first pass vouches for are known to the second, which
    only reads texts that hold one of them. The names are a vocabulary, checked against ``limit``."""
    from .signatures import module_names

    first = classify(df, key, text)
    names = [r["module"] for r in module_names(first).limit(limit + 1).collect()]
    if len(names) > limit:
        raise ValueError("too many module names for a broadcast")
    if not names:
        return first
    named = df.select(key, F.explode(F.regexp_extract_all(F.lower(text), F.lit(r"\b[a-z][a-z0-9]*(?:-[a-z0-9]+){1,4}\b"), F.lit(0))).alias("module"))
    again = df.join(named.join(module_names(first), "module", "left_semi").select(key).distinct(), key, "left_semi")
    return first.unionByName(classify(again, key, text, names)).distinct()
