from datetime import datetime

from pyspark.sql import functions as F

from sleuthwork.operators import content, decisions, evals, history, identity, retrieval, signatures, upsert
from sleuthwork.sources import payloads


def test_split_body():
    body = "Intro\n\n```log\nTypeError: x\n```\n```json\n{}\n```\nend\n````\n```\ninner\n````"
    assert content.split_body(body) == [("prose", None, "Intro"), ("block", "log", "TypeError: x"), ("block", "json", "{}"), ("prose", None, "end"), ("block", None, "```\ninner")]
    assert content.split_body("a\n```py\nx = 1") == [("prose", None, "a"), ("block", "py", "x = 1")]
    assert content.split_body(None) == content.split_body("  \n") == []
    assert [len(t) for _, _, t in content.split_body("x" * 4000)] == [1500, 1500, 1000]


def test_content_units_types(spark):
    df = spark.createDataFrame([(1, "```\nTraceback\n```\n```yaml\na: 1\n```\n```js\nx()\n```"), (2, None)], "doc_id long, text string")
    assert [(r["seq"], r["unit_type"]) for r in content.content_units(df).orderBy("seq").collect()] == [(0, "log"), (1, "config"), (2, "code")]


def test_token_hits_wildcards(spark):
    units = spark.createDataFrame([(1, 0, "call __abc_boot__ now"), (2, 0, "call xxabcxbootyy now"), (3, 0, "Some Error-Code here")], "object_id long, seq int, text string")
    tokens = spark.createDataFrame([(1, "__abc_boot__"), (1, "error-code"), (1, "code here"), (1, "absent")], "request_id long, token string")
    got = {(r["object_id"], r["token"]) for r in retrieval.token_hits(units, tokens).collect()}
    assert got == {(1, "__abc_boot__"), (2, "__abc_boot__"), (3, "error-code"), (3, "code here")}


def test_search_rolls_up_threads(spark):
    units = spark.createDataFrame([(1, 0, "alpha.one"), (2, 0, "beta.two gamma.three"), (3, 0, "other")] + [(i, 0, f"filler{i}") for i in range(4, 400)], "object_id long, seq int, text string")
    objects = units.select("object_id", F.when(F.col("object_id") == 2, 1).alias("parent_id"), F.lit("discussion").alias("kind"))
    tokens = spark.createDataFrame([(7, "alpha.one"), (7, "beta.two"), (7, "gamma.three")], "request_id long, token string")
    got = retrieval.search(units, tokens, objects).collect()
    assert [(r["request_id"], r["object_id"], r["matched"], r["rejection"], r["rank"]) for r in got] == [(7, 1, 3, None, 1)]
    assert got[0]["coverage"] == 1.0


def _side(**arrays):
    return identity.empty_side(**{k: (F.lit(v) if isinstance(v, bool) else F.array(*[F.lit(x) for x in v])) for k, v in arrays.items()})


def _verdict(spark, q, c, **kw):
    df = spark.range(1).select(_side(**q).alias("q"), _side(**c).alias("c"))
    return identity.evaluate(df, **kw).first()


def test_identity_rules(spark):
    pkg = {"subject_package": ["@a/x"], "error": ["typeerror"]}
    assert _verdict(spark, pkg, pkg)["rule"] == "primary_package_plus_second_class"
    assert _verdict(spark, pkg, pkg)["accepted"]
    assert _verdict(spark, pkg, {"subject_package": ["@b/y"], "error": ["typeerror"]})["rejection"] == "different_subject"
    assert _verdict(spark, {"healthy": ["@a/x"], "error": ["e"]}, {"error": ["e"]})["rejection"] == "exculpated_subject"
    assert _verdict(spark, {**pkg, "pointed": True}, pkg)["rejection"] == "unread_claim_about_a_named_package"
    assert _verdict(spark, {"subject_dependency": ["@z/z"], "unbound": True}, {"error": ["e"]})["rejection"] == "unbound_state_assertion"
    assert _verdict(spark, {"subject_dependency": ["@z/z"], "error": ["e"]}, {"error": ["e"]})["rejection"] == "unestablished_subject"
    assert _verdict(spark, {**pkg, "conflicted": ["@a/x"]}, pkg)["rejection"] == "conflicted_subject"
    other = _verdict(spark, {**pkg, "cause": ["dns_resolution"]}, {**pkg, "cause": ["permission"]})
    assert (other["rejection"], other["score"]) == ("different_root_cause", 0.0)
    assert _verdict(spark, {**pkg, "pointed_unnamed": True}, pkg)["rejection"] == "unread_claim_about_an_unnamed_package"
    assert _verdict(spark, {"subject_path": ["a/b.ts"], "error": ["e"]}, {"subject_path": ["c/d.ts"], "error": ["e"]})["rejection"] == "different_subject"
    assert _verdict(spark, {"component": ["web"]}, {"component": ["web"]})["rejection"] == "insufficient_identity_evidence"
    two = {"structural": ["a.b", "c.d"]}
    assert _verdict(spark, two, two)["rule"] == "two_independent_symbols"
    weak = _verdict(spark, {**two, "subject_module": ["x-parser"]}, {**two, "subject_module": ["y-loader"]})
    assert weak["rejection"] == "insufficient_identity_evidence" and weak["weakened"] == ["subjects"]
    path = {"subject_path": ["loader/internal.ts"], "structural": ["internal.ts"]}
    assert _verdict(spark, path, path)["rejection"] == "insufficient_identity_evidence"
    profile = {"behavior": ["absent:a1", "absent:b1", "absent:c1"], "component": ["web", "cli"]}
    assert _verdict(spark, profile, profile)["rule"] == "behaviour_profile_plus_component"


def test_identity_common_values(spark):
    freq = spark.createDataFrame([("a.b", 900), ("c.d", 900)], "value string, doc_freq long")
    two = {"structural": ["a.b", "c.d"]}
    assert _verdict(spark, two, two, frequencies=freq, corpus=1000)["rejection"] == "identity_score_below_threshold"


def test_identity_quotation(spark):
    two = {"structural": ["a.b", "c.d"]}
    df = spark.range(1).select(_side(**two).alias("q"), _side(**two).alias("c"), _side().alias("q_stated"), F.lit(None).cast(identity.side_type()).alias("c_stated"))
    assert identity.evaluate(df).first()["rejection"] == "quoted_evidence_only"


def test_family_relation(spark):
    q, c = {"subject_package": ["@a/x"], "error": ["e"]}, {"subject_package": ["@a/x-core"], "error": ["e"]}
    df = spark.range(1).select(_side(**q).alias("q"), _side(**c).alias("c"), F.create_map(F.lit("@a/x"), F.array(F.lit("@a/x-core"))).alias("family"))
    assert identity.evaluate(df).first()["rule"] == "related_package_plus_second_class"
    packages = spark.createDataFrame([("@a/x",), ("@a/x-core",), ("@a/xy",)], "name string")
    none = spark.createDataFrame([], "repo_id long, name string")
    both = spark.createDataFrame([(1, "@a/x"), (1, "@a/x-core"), (1, "@a/xy")], "repo_id long, name string")
    want = {("@a/x", "@a/x-core"), ("@a/x-core", "@a/x")}
    # Only names that the repository publishes are related; for retrieval one of them is enough.
    assert history.package_family(packages, none).count() == 0 and history.package_family(packages, none, retrieval=True).count() == 0
    assert {(r[0], r[1]) for r in history.package_family(packages, both).collect()} == want
    assert history.package_family(packages, both.where("name = '@a/x'")).count() == 0
    assert {(r[0], r[1]) for r in history.package_family(packages, both.where("name = '@a/x'"), retrieval=True).collect()} == want


def test_containment(spark):
    commits = spark.createDataFrame([("c1", []), ("c2", ["c1"]), ("c3", ["c2", "c1"])], "sha string, parents array<string>")
    tags = spark.createDataFrame([("v0.1.0", "c1"), ("v0.1.1", "c3"), ("v0.2.0", "gone")], "tag string, sha string")
    got = history.containment(commits, tags, spark.createDataFrame([("c2",)], "sha string"))
    # A known tag that isn't listed doesn't contain the commit.
    assert {r["tag"]: r["contains"] for r in got.collect()} == {"v0.1.1": True, "v0.2.0": None}
    first = history.first_releases(got).first()
    assert (first["first_release"], first["first_stable"]) == ("v0.1.1", "v0.1.1")


def test_path_change(spark):
    commits = spark.createDataFrame([
        ("a", "chore: bump", ["p"], ["src/loader/x.ts"], 1), ("b", "refactor loader", ["p"], ["pkg/loader/x.ts"], 2), ("c", "fix other", ["p"], ["pkg/else/x.ts"], 3),
        ("d", "fix: loader crash", ["p"], ["pkg/loader/x.ts"], 4), ("e", "fix: merge", ["p", "q"], ["pkg/loader/x.ts"], 5),
    ], "sha string, subject string, parents array<string>, files array<string>, position int")
    symptoms = spark.createDataFrame([(1, "pkg/loader/x.ts"), (1, "x.ts"), (2, "x.ts")], "request_id int, path string")
    assert [(r["request_id"], r["sha"], r["score"]) for r in history.path_change(symptoms, commits).collect()] == [(1, "d", 4.0)]


def test_upserts(spark):
    old = spark.createDataFrame([(1, "a", "x"), (None, "b", "y")], "k int, v string, w string")
    new = spark.createDataFrame([(1, None, "z"), (None, "c", None), (2, "d", None)], "k int, v string, w string")
    keep = {tuple(r) for r in upsert.merge_keep(old, new, ["k"]).collect()}
    assert keep == {(1, "a", "z"), (None, "c", "y"), (2, "d", None)}
    assert {tuple(r) for r in upsert.replace_rows(old, new, ["k"]).collect()} == {tuple(r) for r in new.collect()}
    assert {tuple(r) for r in upsert.replace_partition(old, new.where("k = 1"), ["k"]).collect()} == {(1, None, "z"), (None, "b", "y")}


def test_revisions_flip_back(spark):
    t = lambda d: datetime(2024, 1, d)
    rows = lambda *r: spark.createDataFrame(r, "object_id int, body_hash string, body string, observed_at timestamp")
    state = upsert.record_revisions(rows((1, "h1", "one", t(1))), rows((1, "h2", "two", t(2))))
    again = upsert.record_revisions(state, rows((1, "h1", "one", t(3))))
    assert {(r["body"], r["is_current"]) for r in again.collect()} == {("one", True), ("two", False)}
    same = upsert.record_revisions(again, rows((1, "h1", "one", t(3))))
    assert upsert.digest(same).first() == upsert.digest(again).first()


def test_stale_signatures(spark):
    good = signatures.mine(spark.createDataFrame([(1, "TypeError in the client")], "doc_id int, text string"))
    signatures.require_fresh(good)
    try:
        signatures.require_fresh(good.withColumn("extractor_version", F.lit(3)))
    except ValueError:
        return
    raise AssertionError


def test_decisions(spark):
    rows = [("direct_match", "1.0", "1.1", 9.0, "upgrade"), ("hard_contradiction", "1.0", "1.1", 9.0, "collect"), ("direct_match", "1.2", "1.1", 9.0, "collect"), ("direct_match", None, "1.1", 9.0, "collect"), ("direct_match", "1.0", None, 13.0, "collect"), ("possible_contradiction", "1.0", "1.1", 9.0, "collect")]
    df = spark.createDataFrame(rows, "a string, u string, f string, s double, want string")
    got = df.select("want", decisions.decide(F.col("a"), F.col("u"), F.col("f"), history.already_contains(F.col("u"), F.col("f")), F.col("s")).alias("x")).collect()
    assert all(r["want"] == r["x"]["action"] for r in got)
    assert [r["x"]["status"] for r in got] == ["actionable", "conflicting", "already_contains", "version_needed", "probable", "conflicting"]


def test_claims(spark):
    claims = spark.createDataFrame([(1, 1, "action", ["e1"]), (1, 2, "same_incident", ["e2"]), (2, 1, "action", ["e1"]), (3, 1, "action", [])], "request_id int, claim_id int, type string, evidence_ids array<string>")
    evidence = spark.createDataFrame([(1, "e1"), (2, "e1")], "request_id int, evidence_id string")
    checked = decisions.verify(claims, evidence)
    assert {(r["request_id"], r["claim_id"]): r["supported"] for r in checked.collect()} == {(1, 1): True, (1, 2): False, (2, 1): True, (3, 1): False}
    acts = spark.createDataFrame([(1, "upgrade", "actionable", "1"), (2, "upgrade", "actionable", "1")], "request_id int, action string, status string, target string")
    assert {r["request_id"]: r["action"] for r in decisions.revoke(acts, checked).collect()} == {1: "collect", 2: "upgrade"}


def test_evals(spark):
    df = spark.createDataFrame([(float(v),) for v in (1, 2, 10, 11)], "v double")
    got = evals.latencies(df, "v").first()
    assert (got["p50"], got["p95"], got["max"]) == (6.0, 10.0, 11.0)
    assert evals.latencies(df.limit(1), "v").first()["p95"] == 1.0
    none = spark.createDataFrame([], "object_id int, matched boolean, possible boolean, proposed boolean")
    assert evals.holdout(none).first()["conditional"] is None


def test_payloads(spark, tmp_path):
    (tmp_path / "d.json").write_text('{"id":"D1","number":42,"title":"t","body":"b","updatedAt":"2024-01-01T00:00:00Z","comments":{"nodes":[{"id":"C1","body":"c","createdAt":"bad","replies":{"nodes":[{"id":"R1","body":"r"}]}}]}}\n')
    got = {r["native_id"]: r for r in payloads.discussions(payloads.read_json(spark, str(tmp_path), payloads.DISCUSSION)).collect()}
    assert set(got) == {"D1", "C1", "R1"} and got["C1"]["parent"] == got["R1"]["parent"] == "D1" and got["C1"]["created_at"] is None
    files = spark.createDataFrame([(1, "package.json", '{"name":"A","version":"1","dependencies":{"b":"1"}}'), (1, "node_modules/x/package.json", '{"name":"x"}')], "repo_id int, path string, value string")
    assert [tuple(r) for r in payloads.manifests(files).collect()] == [(1, "package.json", "a", "1", True, ["b"])]
    log = spark.createDataFrame([("s1\x1fp1 p2\x1f5\x1ffix\x1fa.ts\tb.ts",)], "value string")
    assert [tuple(r) for r in payloads.git_log(log).collect()] == [("s1", ["p1", "p2"], 5, "fix", ["a.ts", "b.ts"])]


def test_streaming_replay(spark, tmp_path):
    from sleuthwork.streaming import ingest

    src, root, check = tmp_path / "in", tmp_path / "out", tmp_path / "ck"
    src.mkdir()
    (src / "1.json").write_text('{"object_id":1,"body":"a","observed_at":"2024-01-01T00:00:00"}\n')
    run = lambda ck: ingest.ingest(spark, str(src), str(root), str(ck), "object_id long, body string, observed_at timestamp").awaitTermination()
    run(check)
    (src / "2.json").write_text('{"object_id":1,"body":"b","observed_at":"2023-01-01T00:00:00"}\n{"object_id":2,"body":null,"observed_at":"2024-01-02T00:00:00"}\n')
    run(check)
    first = upsert.digest(upsert.read_snapshot(spark, str(root))).first()
    run(tmp_path / "again")
    assert upsert.digest(upsert.read_snapshot(spark, str(root))).first() == first
    assert {(r["object_id"], r["body"]) for r in upsert.read_snapshot(spark, str(root)).where("is_current").collect()} == {(1, "a"), (2, None)}
