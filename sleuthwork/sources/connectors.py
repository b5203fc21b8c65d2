"""Connectors: paged APIs as a Spark data source, filters, profiles and workspaces.

Paging, retries and budgets are plain functions over a ``fetch`` callable, so they run without a network in
tests; ``PagedSource`` puts them behind ``spark.read.format("paged_json")``, one partition per endpoint, on
the executors.
"""

from __future__ import annotations

import json
import os
import platform
import re
import subprocess
import time
import urllib.error
import urllib.request
from collections.abc import Callable, Iterator

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

# What is tried again, and the longest waits in seconds.
RETRY_STATUS = (429, 502, 503, 504)
MAX_BACKOFF, MAX_RATE_WAIT, ATTEMPTS = 30, 90, 5
DOC_SUFFIXES = (".md", ".mdx", ".rst", ".txt", ".adoc", ".json", ".jsonc", ".yaml", ".yml", ".toml", ".ini", ".env", ".cfg", ".conf", ".html", ".ts", ".js", ".mjs", ".py", ".sh")
DEPENDENCY_SECTIONS = ("dependencies", "devDependencies", "peerDependencies", "optionalDependencies")


def wait_before(attempt: int, reset_after: float | None = None) -> float:
    """Seconds to wait: the server's rate limit if it told one, else doubling; both bounded."""
    return min(MAX_RATE_WAIT, max(0.0, reset_after)) if reset_after is not None else min(MAX_BACKOFF, 2**attempt)


def with_retries(call: Callable[[], tuple[int, dict, float | None]], sleep: Callable[[float], None] = time.sleep) -> dict:
    """The body of a call; statuses in ``RETRY_STATUS`` are tried again."""
    for attempt in range(ATTEMPTS):
        status, body, reset = call()
        if status < 400:
            return body
        if status not in RETRY_STATUS or attempt == ATTEMPTS - 1:
            raise OSError(f"status {status}")
        sleep(wait_before(attempt, reset))
    raise OSError("no attempt left")


def http_page(url: str, cursor: str | None, token: str | None = None) -> tuple[int, dict, float | None]:
    """One GET of a page: status, body, seconds to the rate limit's reset."""
    request = urllib.request.Request(url + (("&" if "?" in url else "?") + f"cursor={cursor}" if cursor else ""), headers={"Authorization": f"Bearer {token}"} if token else {})
    try:
        with urllib.request.urlopen(request, timeout=30) as r:
            return r.status, json.load(r), None
    except urllib.error.HTTPError as e:
        after = e.headers.get("Retry-After")
        return e.code, {}, float(after) if after and after.isdigit() else None


def graphql(url: str, query: str, variables: dict, token: str | None = None) -> tuple[int, dict, float | None]:
    """One POST of a query: status, data, seconds to the reset that the answer tells where the budget is spent."""
    body = json.dumps({"query": query, "variables": variables}).encode()
    request = urllib.request.Request(url, body, {"Content-Type": "application/json", **({"Authorization": f"Bearer {token}"} if token else {})})
    try:
        with urllib.request.urlopen(request, timeout=30) as r:
            answer = json.load(r)
            left, reset = r.headers.get("X-RateLimit-Remaining"), r.headers.get("X-RateLimit-Reset")
    except urllib.error.HTTPError as e:
        after = e.headers.get("Retry-After")
        return e.code, {}, float(after) if after and after.isdigit() else None
    if answer.get("errors"):
        spent = left == "0" or any(x.get("type") == "RATE_LIMITED" for x in answer["errors"])
        return (429 if spent else 400), {}, max(0.0, float(reset) - time.time()) if spent and reset else None
    return 200, answer.get("data") or {}, None


def drain(fetch: Callable[[str], dict], cursor: str | None, budget: int = 20) -> tuple[list[dict], bool]:
    """What is left of a thread's comments from a cursor on, in at most ``budget`` pages; whether that was all."""
    found: list[dict] = []
    for _ in range(budget):
        if not cursor:
            break
        body = fetch(cursor)
        found += body.get("nodes", [])
        cursor = body.get("next")
    return found, not cursor


def lookup(fetch: Callable[[str, int], dict], kind: str, number: int) -> dict | None:
    """One work item by kind and number; None where there is none."""
    if kind not in ("issue", "pull_request"):
        raise ValueError(kind)
    node = fetch(kind, number)
    return {**node, "kind": kind} if node else None


def run_sources(sources: dict[str, Callable[[], Iterator[tuple[list[dict], str | None, str]]]], sink: Callable[[str, list[dict]], None], clock: Callable[[], float] = time.time) -> list[dict]:
    """Read several sources one after the other; one that fails doesn't stop the rest.

    A row a source: source, status, objects_seen, cursor, error, seconds. A walk that ends before the source does
    (``capped`` or ``budget``) is ``degraded``, and its cursor is where the next run goes on.
    """
    rows = []
    for name, walk in sources.items():
        began, seen, cursor, state, error = clock(), 0, None, "complete", None
        try:
            for nodes, cursor, state in walk():
                sink(name, nodes)
                seen += len(nodes)
        except Exception as e:  # noqa: BLE001  the failure is the source's row
            error = str(e)
        status = "failed" if error is not None else "complete" if state == "complete" else "degraded"
        rows.append({"source": name, "status": status, "objects_seen": seen, "cursor": cursor if status != "complete" else None, "error": error, "seconds": clock() - began})
    return rows


def git(root: str, *args: str) -> str:
    """Output of git in a repository; an error if it fails."""
    done = subprocess.run(["git", "-C", root, *args], capture_output=True, text=True, check=False)
    if done.returncode:
        raise OSError(done.stderr.strip() or f"git {args[0]} failed")
    return done.stdout


def mirror(url: str, path: str) -> str:
    """A mirror without blobs: made on the first call, brought up to date (and pruned) on later ones."""
    if os.path.isdir(path):
        git(path, "remote", "update", "--prune")
        return "updated"
    done = subprocess.run(["git", "clone", "--mirror", "--filter=blob:none", url, path], capture_output=True, text=True, check=False)
    if done.returncode:
        raise OSError(done.stderr.strip())
    return "cloned"


def git_tags(root: str) -> list[dict]:
    """Tags with the commit that they, or the tag objects they name, stand for."""
    form = "%(refname:short)%1f%(objectname)%1f%(*objectname)%1f%(creatordate:unix)"
    rows = [line.split("\x1f") for line in git(root, "for-each-ref", f"--format={form}", "refs/tags").splitlines()]
    return [{"tag": t, "sha": peeled or sha, "tagged_at": int(at) if at else None} for t, sha, peeled, at in rows]


def git_commits(root: str, span: str = "--all") -> list[str]:
    """Lines as ``payloads.git_log`` reads them, of all commits or of a range (a..b): sha, parents, time, subject, files."""
    out = []
    for entry in git(root, "log", span, "--name-only", "--pretty=format:%x1e%H%x1f%P%x1f%ct%x1f%s").split("\x1e")[1:]:
        head, _, files = entry.partition("\n")
        out.append("\x1f".join([head, "\t".join(f for f in files.splitlines() if f)]))
    return out


def git_tree(root: str, ref: str = "HEAD") -> list[dict]:
    """Files of a tree: path and blob."""
    rows = [x.partition("\t") for x in git(root, "ls-tree", "-r", "-z", ref).split("\0") if x]
    return [{"path": path, "blob": head.split()[2]} for head, _, path in rows if head.split()[1] == "blob"]


def git_show(root: str, what: str) -> str | None:
    """A blob, or ``ref:path``; None where it isn't there."""
    try:
        return git(root, "show", what)
    except OSError:
        return None


def git_changed(root: str, old: str, new: str) -> list[str]:
    """Paths that differ between two commits."""
    return [p for p in git(root, "diff", "--name-only", "-z", old, new).split("\0") if p]


def git_manifests(root: str, repo_id: int, ref: str = "HEAD", limit: int = 400) -> list[dict]:
    """The package manifests of a tree, as rows that ``payloads.manifests`` reads; at most ``limit``, as the source has it."""
    paths = [f for f in git_tree(root, ref) if re.search(r"(^|/)package\.json$", f["path"]) and "node_modules/" not in f["path"]][:limit]
    return [{"repo_id": repo_id, "path": f["path"], "value": git_show(root, f["blob"]) or ""} for f in paths]


def pages(fetch: Callable[[str | None], dict], start: str | None = None, updated_after: str | None = None, max_items: int | None = None, page_budget: int | None = None) -> Iterator[tuple[list[dict], str | None, str]]:
    """(nodes, next cursor, state) page by page; state is more, complete, capped or budget.

    ``updated_after`` filters each page: the walk ends at a page of which nothing is newer, so one row out of
    order doesn't end it.
    """
    cursor, items, read = start, 0, 0
    while True:
        body = fetch(cursor)
        nodes, cursor, read = body.get("nodes", []), body.get("next"), read + 1
        fresh = [n for n in nodes if updated_after is None or (n.get("updatedAt") or "") > updated_after]
        if max_items is not None:
            fresh = fresh[: max_items - items]
        items += len(fresh)
        done = not cursor or (updated_after is not None and nodes and not fresh)
        state = "complete" if done else "capped" if max_items is not None and items >= max_items else "budget" if page_budget is not None and read >= page_budget else "more"
        yield fresh, cursor, state
        if state != "more":
            return


class _Endpoint(InputPartition):
    def __init__(self, url: str):
        self.url = url


class _Reader(DataSourceReader):
    def __init__(self, options: dict):
        self.options = options

    def partitions(self):
        return [_Endpoint(u) for u in self.options["urls"].split(",") if u]

    def read(self, partition):
        o = self.options
        number = lambda k: int(o[k]) if k in o else None
        call = lambda cursor: with_retries(lambda: http_page(partition.url, cursor, os.environ.get(o.get("token_env", ""))))
        for nodes, cursor, state in pages(call, o.get("start_cursor"), o.get("updated_after"), number("max_items"), number("page_budget")):
            for n in nodes:
                yield (partition.url, json.dumps(n), cursor, state)


class PagedSource(DataSource):
    """``spark.dataSource.register(PagedSource)``; options: urls, start_cursor, updated_after, max_items,
    page_budget, token_env (the name of a variable that holds the token)."""

    @classmethod
    def name(cls) -> str:
        return "paged_json"

    def schema(self) -> str:
        return "url string, node string, next_cursor string, state string"

    def reader(self, schema):
        return _Reader(dict(self.options))


def keep_tag(tag: Column, ignore: list[str]) -> Column:
    """Tags that no pattern matches."""
    return ~tag.rlike("|".join(f"(?:{p})" for p in ignore)) if ignore else F.lit(True)


def keep_document(path: Column, exclude: list[str]) -> Column:
    """Paths of documentation and configuration that no pattern excludes."""
    good = F.lower(path).rlike("(" + "|".join(re.escape(s) for s in DOC_SUFFIXES) + ")$")
    return good & (~path.rlike("|".join(f"(?:{p})" for p in exclude)) if exclude else F.lit(True))


def load_profile(folder: str, name: str) -> dict:
    """A profile by name: NAME.yaml, NAME.yml, or either in a folder of that name."""
    import yaml

    for path in (f"{name}.yaml", f"{name}.yml", f"{name}/profile.yaml", f"{name}/profile.yml"):
        full = os.path.join(folder, path)
        if os.path.isfile(full):
            with open(full) as f:
                found = yaml.safe_load(f) or {}
            for pattern in found.get("tag_ignore", []) + found.get("version_patterns", []):
                re.compile(pattern)
            return found
    raise FileNotFoundError(name)


def inspect_workspace(root: str, limit: int = 2 << 20) -> list[dict]:
    """Packages of a workspace: an installed manifest wins over a declared range. A driver-side helper.

    Rows: name, version, source, priority (1 is best); files over ``limit`` bytes are not read.
    """
    def read(path: str) -> dict:
        try:
            if os.path.getsize(path) > limit:
                return {}
            with open(path) as f:
                got = json.load(f)
            return got if isinstance(got, dict) else {}
        except (OSError, ValueError):
            return {}

    declared = read(os.path.join(root, "package.json"))
    rows = [{"name": declared["name"], "version": declared.get("version"), "source": "manifest", "priority": 2}] if declared.get("name") else []
    for section in DEPENDENCY_SECTIONS:
        for name, wanted in (declared.get(section) or {}).items():
            installed = read(os.path.join(root, "node_modules", name, "package.json")).get("version")
            rows.append({"name": name, "version": installed or wanted, "source": "installed" if installed else "declared", "priority": 1 if installed else 3})
    try:
        import tomllib

        with open(os.path.join(root, "pyproject.toml"), "rb") as f:
            project = tomllib.load(f).get("project", {})
        rows += [{"name": project["name"], "version": project.get("version"), "source": "pyproject", "priority": 2}] if project.get("name") else []
    except (OSError, ValueError):
        pass
    return rows


def workspace_facts(root: str, run: Callable[[list[str]], str] | None = None) -> dict:
    """Where a workspace comes from and what it runs on: origin, runtimes (name, version), system."""
    run = run or (lambda args: subprocess.run(args, capture_output=True, text=True, timeout=10, check=True).stdout)

    def said(args: list[str]) -> str | None:
        try:
            return run(args).strip() or None
        except (OSError, subprocess.SubprocessError):
            return None

    versions = {name: said([name, "--version"]) for name in ("node", "python3", "deno", "bun")}
    found = {n: re.search(r"\d+(?:\.\d+)+", v) for n, v in versions.items() if v}
    return {"origin": said(["git", "-C", root, "remote", "get-url", "origin"]), "runtimes": {n: m.group() for n, m in found.items() if m}, "system": platform.system().lower()}
