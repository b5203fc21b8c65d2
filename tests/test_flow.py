"""From a text to an answer, and the parts of it that have no SQL."""

import json
import subprocess

import pytest
from pyspark.sql import functions as F

from sleuthwork.functions import text as fn
from sleuthwork.functions import versions as ver
from sleuthwork.operators import decisions, flow, history, identity, signatures, upsert
from sleuthwork.operators.tables import placed
from sleuthwork.sources import connectors, payloads
from sleuthwork.streaming import ingest

CRASH = "The @acme/loader crashes on start with TypeError in resolveModule. "


def one(spark, **cols):
    return spark.range(1).select(*[c.alias(n) for n, c in cols.items()]).first()


def texts(spark, rows):
    return spark.createDataFrame(rows, "doc_id long, text string")


def test_stated_view(spark):
    quoted = "The page is blank.\n> @acme/loader crashes with TypeError in resolveModule\nThat is all."
    rows = flow.sides(flow.extract(texts(spark, [(1, CRASH), (2, quoted), (3, "nothing here"), (4, None)]))).collect()
    by = {r["object_id"]: r for r in rows}
    assert by[1]["stated"] is None and by[1]["side"]["subject_package"] == ["@acme/loader"] and "typeerror" in by[1]["side"]["error"]
    assert "typeerror" in by[2]["side"]["error"] and by[2]["side"]["subject_package"] == [] and by[2]["stated"]["error"] == []


def test_identify(spark):
    features = flow.extract(texts(spark, [(1, CRASH), (2, CRASH + "Again."), (3, "The @other/tool crashes on start with TypeError in resolveModule."), (4, "a blank page"), (5, "See this:\n> " + CRASH)]))
    sides = flow.sides(features)
    rows = [(1, i, float(9 - i), 1, False) for i in (2, 3, 4, 5)] + [(1, 100 + i, 0.5, 0, i == 9) for i in range(10)]
    candidates = flow.ranked(spark.createDataFrame(rows, "request_id long, object_id long, token_score double, feature_hits long, family_related boolean"))
    requests = sides.where("object_id = 1").withColumnRenamed("object_id", "request_id")
    got = {r["object_id"]: r for r in flow.identify(candidates, requests, sides).collect()}
    assert len(got) == 8 and got[109]["position"] == 1 and got[109]["checked"]
    assert sum(r["checked"] for r in got.values()) == 6
    assert got[2]["accepted"] and got[2]["rule"] == "primary_package_plus_second_class"
    assert got[3]["rejection"] == "different_subject" and not got[4]["accepted"] and not got[5]["accepted"]
    out = flow.identify(candidates, requests, sides)
    assert [r["object_id"] for r in flow.best_accepted(out).collect()] == [2]
    counts = {r["rejection"]: r["n"] for r in flow.rejection_counts(out).collect()}
    assert sum(counts.values()) == 7 and counts["not_evaluated"] == 2 and counts["different_subject"] >= 1
    anchors = spark.createDataFrame([(1, "structural", "Absent_Name")], "request_id long, kind string, value string")
    turned = flow.identify(candidates, requests, sides, anchors=anchors, stated=features.where("view = 'all'")).where("object_id = 2").first()
    assert turned["rejection"] == "structured_anchor_mismatch" and not turned["accepted"] and turned["rule"] is None


def side(**given):
    return identity.empty_side(**{k: F.lit(v) if isinstance(v, bool) else F.array(*[F.lit(x) for x in v]) for k, v in given.items()})


CASES = [
    ("exculpated_subject", {"healthy": ["@a/x"]}, {}),
    ("unread_claim_about_a_named_package", {"subject_package": ["@a/x"], "pointed": True}, {"subject_package": ["@a/x"]}),
    ("unbound_state_assertion", {"unbound": True, "subject_package": ["@a/x"]}, {"error": ["e"]}),
    ("unestablished_subject", {"subject_dependency": ["@a/x"]}, {"error": ["e"]}),
    ("conflicted_subject", {"conflicted": ["@a/x"]}, {"conflicted": ["@a/x"]}),
    ("different_root_cause", {"cause": ["dns"], "error": ["e"]}, {"error": ["e"], "cause": ["disk"]}),
    ("unread_claim_about_an_unnamed_package", {"pointed_unnamed": True, "error": ["e"]}, {"error": ["e"]}),
    ("different_subject", {"subject_package": ["@a/x"], "error": ["e"]}, {"subject_package": ["@b/y"], "error": ["e"]}),
    ("unestablished_subject", {"unresolved": ["@a/x"], "error": ["e"]}, {"error": ["e"]}),
    ("different_subject", {"subject_path": ["a/b.ts"], "error": ["e"]}, {"subject_path": ["c/d.ts"], "error": ["e"]}),
    ("insufficient_identity_evidence", {"error": ["e"]}, {"error": ["e"]}),
    ("insufficient_identity_evidence", {"structural": ["s", "t"], "subject_module": ["m-a"]}, {"structural": ["s", "t"], "subject_module": ["n-b"]}),
    ("identity_score_below_threshold", {"behavior": ["a", "b", "c"], "component": ["x", "y"]}, {"behavior": ["a", "b", "c"], "component": ["x", "y"]}),
    (None, {"error": ["e"], "structural": ["s"]}, {"error": ["e"], "structural": ["s"]}),
]


@pytest.mark.parametrize("want, q, c", CASES)
def test_rejections(spark, want, q, c):
    freq = spark.createDataFrame([(v, 1000) for v in ("a", "b", "c", "x", "y")], "value string, doc_freq long")
    got = identity.evaluate(spark.range(1).select("id", side(**q).alias("q"), side(**c).alias("c")), freq, 1000).first()
    assert got["rejection"] == want and got["accepted"] == (want is None)


def test_quoted_evidence_only(spark):
    full, bare = {"error": ["e"], "structural": ["s"]}, {"error": ["e"]}
    pairs = spark.range(1).select("id", side(**full).alias("q"), side(**full).alias("c"), side(**bare).alias("q_stated"), side(**full).alias("c_stated"))
    assert identity.evaluate(pairs).first()["rejection"] == "quoted_evidence_only"


def test_feature_lists(spark):
    have = spark.createDataFrame([(1, "error", "e"), (1, "error", "f"), (1, "cause", "d"), (2, "error", "z")], "object_id long, kind string, value string")
    want = spark.createDataFrame([(9, "error", "f"), (9, "error", "e"), (9, "cause", "d")], "request_id long, kind string, value string")
    assert [(r["request_id"], r["object_id"], r["hits"]) for r in flow.feature_lists(have, want).collect()] == [(9, 1, {"error": ["e", "f"], "cause": ["d"]})]


def test_inventory(spark):
    rows = spark.createDataFrame([(1, "issue", "open", None), (1, "issue", "closed", None), (1, "comment", None, 5)], "repo_id long, kind string, state string, parent_id long")
    assert {r["kind"]: (r["n"], r["open"], r["comments"]) for r in flow.inventory(rows).collect()} == {"issue": (2, 1, 0), "comment": (1, 0, 1)}


def test_placed(spark):
    rows = spark.range(5000).select((F.col("id") * 7919 % 5000).alias("k"))
    assert all(r["place"] == r["k"] + 1 for r in placed(rows, "k").collect()) and placed(rows.limit(0), "k").count() == 0


# --- writes -----------------------------------------------------------------------------------------

def test_snapshot_survives_a_kill(spark, tmp_path):
    root = str(tmp_path / "t")
    rows = lambda *ids: spark.createDataFrame([(i, f"b{i}", None) for i in ids], "object_id long, body string, observed_at timestamp")
    assert upsert.read_version(spark, root) == 0
    with pytest.raises(FileNotFoundError):
        upsert.read_snapshot(spark, root)
    ingest.apply_batch(spark, root, rows(1, 2))
    # A writer that died: files, but no mark that they are all there.
    rows(7).write.parquet(f"{root}/v=2")
    (tmp_path / "t" / "v=2" / "_SUCCESS").unlink()
    assert upsert.read_version(spark, root) == 1
    ingest.apply_batch(spark, root, rows(3))
    ingest.apply_batch(spark, root, rows(3))
    assert upsert.read_version(spark, root) == 4 and sorted(r["object_id"] for r in upsert.read_snapshot(spark, root).collect()) == [1, 2, 3]


def test_repeated_keys_count_once(spark):
    old = spark.createDataFrame([(1, "a")], "k long, v string")
    assert upsert.merge_keep(old, spark.createDataFrame([(1, "b"), (1, "c")], "k long, v string"), ["k"]).collect() == [(1, "c")]


def test_sync_totals(spark):
    schema = "repo_id long, source string, run_id long, at long, watermark long, objects_seen long, status string, full boolean, error string, stats map<string,string>"
    runs = [(1, "s", 1, 10, 5, 3, "complete", True, None, {"a": "1", "b": "1"}), (1, "s", 2, 20, 4, 2, "degraded", False, None, {"a": "2"}), (1, "s", 3, 30, 9, 7, "failed", False, "boom", None)]
    log = spark.createDataFrame(runs, schema)
    got = upsert.sync_totals(upsert.sync_log(log, log.where("run_id = 2"))).first()
    assert (got["watermark"], got["objects_seen"], got["status"], got["consecutive_failures"], got["last_error"], got["stats"]) == (5, 5, "failed", 1, "boom", {"a": "2", "b": "1"})
    assert (got["last_full_sync_at"], got["last_success_at"], got["last_attempt_at"]) == (10, 20, 30)


# --- functions ----------------------------------------------------------------------------------------

def test_small_functions(spark):
    lit = F.lit
    name, version = fn.runtime_parts(lit("node@v24.1"))
    other, none = fn.runtime_parts(lit("Deno"))
    got = one(spark, key=fn.config_key(lit("TOKEN = abc=d")), name=name, version=version, other=other, none=none, clean=fn.sanitize(lit("a\x00b")), slug=fn.repository_slug(lit("git@host.org:own/name.git")), slug2=fn.repository_slug(lit("https://x@h.org/own/name")), noslug=fn.repository_slug(lit("nothing")),
              exact=ver.exact_version(lit("v1.2.3")), ranged=ver.exact_version(lit("^1.2.3")), tag=ver.normalize_tag(lit("desktop@v1.2.0-rc.1"), ["web@", "desktop@"]), bad=ver.normalize_tag(lit("nightly"), []), field=ver.report_version(lit("x 9.9.9\nVersion: v1.4\n"), [r"(?im)^release: (\S+)", r"(?im)^version:\s*v?(\S+)"]))
    assert (got["key"], got["name"], got["version"], got["other"], got["none"], got["clean"]) == ("TOKEN", "node", "24.1", "deno", None, "ab")
    assert (got["slug"], got["slug2"], got["noslug"], got["exact"], got["ranged"], got["tag"], got["bad"], got["field"]) == ("own/name", "own/name", None, "1.2.3", None, "1.2.0rc1", None, "1.4")


def test_symptom_paths(spark):
    tails, names = fn.symptom_paths(F.lit(r"see Packages\Loader\src\internal.ts and src/index.ts, web/core/index.ts or util.py; ./a/b.md"))
    got = one(spark, tails=tails, names=names)
    assert got["tails"] == ["loader/src/internal.ts", "src/internal.ts", "web/core/index.ts"] and got["names"] == ["internal.ts", "util.py"]


def test_assess_and_authorize(spark):
    lists = {k: F.array(*[F.lit(x) for x in v]) for k, v in {"error": ["e"], "cause": [], "subject_package": ["p"], "subject_path": [], "behavior": ["b"], "structural": []}.items()}
    none = {k: F.array().cast("array<string>") for k in lists}
    a, b, c = decisions.assess(F.lit("question"), lists), decisions.assess(F.lit(None).cast("string"), lists), decisions.assess(F.lit(None).cast("string"), none)
    arr = lambda *x: F.array(*[F.lit(v) for v in x]).cast("array<string>")
    got = one(spark, a=a, b=b, c=c, ok=decisions.authorize(arr("p"), arr("q"), arr("p"), F.lit(None).cast("string"), F.lit("d")), no=decisions.authorize(arr("z"), arr("q"), arr("p"), F.lit("x"), F.lit("d")), sure=decisions.authorize(arr(), arr(), arr(), F.lit("d"), F.lit("d")), digest=decisions.reading_digest(F.lit("a"), arr("b")), again=decisions.reading_digest(F.lit("a"), arr("b")), other=decisions.reading_digest(F.lit("a"), arr("c")))
    assert tuple(got["a"]) == (False, "declared_question") and tuple(got["b"]) == (True, "error,package_and_symptom") and tuple(got["c"]) == (False, "")
    assert (got["ok"], got["no"], got["sure"]) == ("stated_package", "proposal_only", "confirmed") and got["digest"] == got["again"] != got["other"] and len(got["digest"]) == 12


def test_changes_and_texts(spark):
    linked = spark.createDataFrame([(1, "s1", 100.0)], "request_id long, sha string, score double")
    guessed = spark.createDataFrame([(1, "s2", 4.0), (2, "s3", 5.0)], "request_id long, sha string, score double")
    assert sorted(tuple(r) for r in history.resolve_change(linked, guessed).collect()) == [(1, "s1", 100.0, "linked"), (2, "s3", 5.0, "inferred")]
    objects = spark.createDataFrame([(1, None, "Title"), (2, 1, None)], "object_id long, parent_id long, title string")
    units = spark.createDataFrame([(2, 0, "reply"), (1, 1, "b"), (1, 0, "a")], "object_id long, seq int, text string")
    assert signatures.object_text(units, objects).first()["text"] == "Title\na\nb\nreply"
    relations = spark.createDataFrame([("references_commit", "s1", "high"), ("references_commit", "gone", "high"), ("closes", "gone", "high")], "type string, dst_ref string, confidence string")
    got = sorted((r["type"], r["dst_ref"], r["confidence"]) for r in upsert.downgrade_unresolved(relations, spark.createDataFrame([("s1",)], "sha string")).collect())
    assert got == [("closes", "gone", "high"), ("references_commit", "gone", "low"), ("references_commit", "s1", "high")]
    rows = spark.createDataFrame([(1, "2024-01-02"), (2, "2024-01-01"), (3, None)], "i long, updated_at string")
    assert [r["i"] for r in ingest.newer_than(rows, "2024-01-01").collect()] == [1] and ingest.newer_than(rows, None).count() == 3


# --- sources -------------------------------------------------------------------------------------------

def test_payloads(spark, tmp_path):
    node = {"id": "P1", "number": 4, "title": "t", "body": "b", "state": "MERGED", "updatedAt": "2024-01-02T00:00:00Z", "mergeCommit": {"oid": "abc"}, "closingIssuesReferences": {"nodes": [{"id": "I1", "number": 7, "url": "u"}]}}
    (tmp_path / "w.json").write_text(json.dumps(node))
    items, closes = payloads.work_items(payloads.read_json(spark, str(tmp_path / "w.json"), payloads.WORK_ITEM))
    assert items.first()["merge_sha"] == "abc" and items.first()["state"] == "merged" and tuple(closes.first()) == ("P1", "I1", "issue:7")
    rel = [{"tagName": t, "isPrerelease": False, "isDraft": d, "publishedAt": None, "tagCommit": None} for t, d in (("v1", False), ("v2", True), ("nightly-1", False))]
    (tmp_path / "r.json").write_text("\n".join(map(json.dumps, rel)))
    nodes = payloads.read_json(spark, str(tmp_path / "r.json"), payloads.RELEASE)
    assert [r["tag"] for r in payloads.releases(nodes, "^nightly").collect()] == ["v1"] and payloads.releases(nodes, drafts=True).count() == 3


def test_sources_fail_alone():
    def good():
        yield [{"a": 1}], "c1", "more"
        yield [{"a": 2}], None, "complete"

    def capped():
        yield [{"a": 1}], "c9", "budget"

    def bad():
        yield [{"a": 1}], "c1", "more"
        raise OSError("status 500")

    kept = []
    rows = {r["source"]: r for r in connectors.run_sources({"bad": bad, "good": good, "capped": capped}, lambda n, x: kept.append((n, len(x))))}
    assert [(rows[n]["status"], rows[n]["objects_seen"], rows[n]["cursor"]) for n in ("bad", "good", "capped")] == [("failed", 1, "c1"), ("complete", 2, None), ("degraded", 1, "c9")]
    assert rows["bad"]["error"] == "status 500" and len(kept) == 4


def test_drain_and_lookup():
    pages = {f"c{i}": {"nodes": [i], "next": f"c{i + 1}" if i < 30 else None} for i in range(31)}
    assert connectors.drain(pages.get, "c25") == ([25, 26, 27, 28, 29, 30], True)
    found, done = connectors.drain(pages.get, "c0")
    assert len(found) == 20 and not done and connectors.drain(pages.get, None) == ([], True)
    assert connectors.lookup(lambda k, n: {"number": n}, "issue", 3) == {"number": 3, "kind": "issue"} and connectors.lookup(lambda k, n: {}, "issue", 3) is None
    with pytest.raises(ValueError):
        connectors.lookup(lambda k, n: {}, "tag", 3)


def test_git(spark, tmp_path):
    root = str(tmp_path / "r")
    run = lambda *a: subprocess.run(["git", "-C", root, "-c", "user.name=a", "-c", "user.email=a@b.c", *a], check=True, capture_output=True)
    subprocess.run(["git", "init", "-q", "-b", "main", root], check=True)
    (tmp_path / "r" / "package.json").write_text('{"name": "@A/Root", "version": "1.0.0", "dependencies": {"z": "1"}, "peerDependencies": {"b": "2"}}')
    run("add", "-A"), run("commit", "-qm", "first"), run("tag", "v1")
    (tmp_path / "r" / "src").mkdir()
    (tmp_path / "r" / "src" / "a b.py").write_text("x")
    run("add", "-A"), run("commit", "-qm", "fix: second"), run("tag", "-a", "v2", "-m", "two")
    lines = connectors.git_commits(root)
    log = {r["subject"]: r for r in payloads.git_log(spark.createDataFrame([(x,) for x in lines], "value string")).collect()}
    first, second = log["first"], log["fix: second"]
    assert second["parents"] == [first["sha"]] and second["files"] == ["src/a b.py"] and len(connectors.git_commits(root, "v1..v2")) == 1
    assert {t["tag"]: t["sha"] for t in connectors.git_tags(root)} == {"v1": first["sha"], "v2": second["sha"]}
    assert [f["path"] for f in connectors.git_tree(root, "v2")] == ["package.json", "src/a b.py"] and connectors.git_changed(root, "v1", "v2") == ["src/a b.py"]
    assert connectors.git_show(root, "v2:src/a b.py") == "x" and connectors.git_show(root, "v2:none") is None
    found = payloads.manifests(spark.createDataFrame(connectors.git_manifests(root, 1), "repo_id long, path string, value string")).first()
    assert (found["name"], found["is_root"], found["dependencies"]) == ("@a/root", True, ["b", "z"])
    copy = str(tmp_path / "m.git")
    assert connectors.mirror(root, copy) == "cloned" and connectors.mirror(root, copy) == "updated" and len(connectors.git_tags(copy)) == 2
    run("remote", "add", "origin", "https://h.org/own/name.git")
    facts = connectors.workspace_facts(root)
    assert facts["origin"].endswith("own/name.git") and facts["system"] and "python3" in facts["runtimes"]
