"""Steps whose work has to grow with the input, not with the square of a group."""

import pandas as pd
from pyspark.sql import functions as F

from sleuthwork.functions import fixed as V
from sleuthwork.functions import text as fn
from sleuthwork.operators import content, flow, history, identity, retrieval, signatures, tables
from sleuthwork.plans import queries as engine
from tests.oracle import same


def _documents(spark, tmp_path, texts):
    spark.createDataFrame(pd.DataFrame({"doc_id": range(len(texts)), "text": texts}), "doc_id long, text string").repartition(3).write.parquet(f"{tmp_path}/documents.parquet")
    return str(tmp_path)


def test_identity_judges_only_sides_that_share(spark, tmp_path, monkeypatch):
    letters = "abcdefghijklmnopqrst"
    texts = [f"one head\n{a * 13} {a * 11} {a * 15}ble {a * 10}tion" for a in letters] * 2 + ["one head\n" + "z" * 13] * 3 + ["one head\naaaaaaaaaaaaa " + "z" * 13, "one head", "one head", "alone", None]
    judged = []
    evaluate = identity.evaluate
    monkeypatch.setattr(identity, "evaluate", lambda pairs, *a, **k: (judged.append(pairs.count()), evaluate(pairs, *a, **k))[1])
    monkeypatch.setattr(identity, "BLOCK", 4)
    d = _documents(spark, tmp_path, texts)
    same(spark, d, "identity_cascade", engine.QUERIES, engine.SQL)
    same(spark, d, "identity_score", engine.QUERIES, engine.SQL)
    assert max(judged) <= 3 * len(letters)


def _plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


WORDS = ["alphabet", "betamax", "gammaray", "deltawing", "epsilon", "zetaform"]


def _channel(spark, n=40):
    rows = [(i, f"{WORDS[i % 6]} {WORDS[i * i % 6]}s\n" * 2 + f"un{WORDS[i % 5]} short\n{WORDS[i % 3].upper()}") for i in range(n)]
    units = content.line_units(spark.createDataFrame(pd.DataFrame(rows, columns=["doc_id", "text"]))).repartition(3)
    return rows, units


def _hits(rows, tokens):
    return {(i, t): n for i, text in rows for t in tokens if (n := sum(t in line.lower() for line in text.split("\n")))}


def test_hits_are_moved_once_and_words_are_not(spark, monkeypatch):
    rows, units = _channel(spark)
    tokens = spark.createDataFrame([(w,) for w in WORDS[:4]], "token string")
    got = retrieval.token_hits(units, tokens)
    assert _plan(got).count("Exchange hashpartitioning") == 1 and "BroadcastHashJoin" in _plan(got)
    want = _hits(rows, WORDS[:4])
    assert {(r["object_id"], r["token"]): r["unit_hits"] for r in got.collect()} == want
    monkeypatch.setattr(tables, "SENT", 0)  # what is too large to be sent is joined
    assert {(r["object_id"], r["token"]): r["unit_hits"] for r in retrieval.token_hits(units, tokens).collect()} == want


def test_census_adds_up_where_hits_lie(spark, monkeypatch):
    rows, units = _channel(spark)
    asked = spark.createDataFrame([(i, w) for i in (0, 20) for w in WORDS[:3]], "request_id long, token string")
    whole = retrieval.leave_one_out(units, asked)
    # Objects of the hits, and the counting of objects; the pairs are not dealt again.
    assert "hashpartitioning(request_id" not in _plan(whole)
    key = lambda df: sorted((r["request_id"], r["object_id"], r["score"], r["matched"]) for r in df.collect())
    monkeypatch.setattr(tables, "SENT", 2)
    assert key(retrieval.leave_one_out(units, asked)) == key(whole) and whole.count() > 20


def test_top_is_that_of_the_search_and_kept_by_each_task(spark):
    _, units = _channel(spark)
    rare = units.selectExpr("object_id", "seq", "unit_type", "CASE WHEN object_id IN (3, 7, 11) THEN text || ' uncommonerror rarefication oddwording strangeness' ELSE text END AS text")
    asked = spark.createDataFrame([(1, t) for t in ("uncommonerror", "rarefication", "oddwording", "strangeness", "alphabet")], "request_id long, token string")
    top = retrieval.search_top(rare, asked, limit=2)
    assert "WindowGroupLimit" in _plan(top)
    want = retrieval.top(retrieval.search(rare, asked), 2)
    pick = lambda df: sorted((r["request_id"], r["object_id"], r["score"], r["rank"]) for r in df.collect())
    assert pick(top) == pick(want) and len(pick(want)) == 2


def test_excerpts_of_plain_tokens_need_no_pattern_per_row(spark):
    _, units = _channel(spark)
    wanted = spark.createDataFrame([(1, "BETA"), (1, "be_a"), (2, "gamma%s"), (3, "nothere")], "object_id long, token string")
    got = {(r["object_id"], r["token"]): r["excerpt"] for r in retrieval.best_excerpt(units, wanted).collect()}
    assert got == {(1, "BETA"): "BETAMAX", (1, "be_a"): "BETAMAX", (2, "gamma%s"): "ungammaray short"}
    assert "Contains" in _plan(retrieval.best_excerpt(units, wanted))


def test_family_is_marked_without_a_request_in_one_task(spark):
    found = spark.createDataFrame([(r, o, 1.0, 1) for r in (1, 2) for o in range(5)], "request_id long, object_id long, token_score double, feature_hits long")
    packages = spark.createDataFrame([(0, "@m/core-web"), (1, "@m/other"), (1, None), (2, "@m/core")], "object_id long, name string")
    asked = spark.createDataFrame([(1, "@m/core"), (2, None)], "request_id long, name string")
    got = flow.mark_families(found, packages, asked, spark.createDataFrame([("@m/core", "@m/core-web")], "name string, related string"))
    assert "hashpartitioning(request_id" not in _plan(got) and "SortMergeJoin [request_id" not in _plan(got)
    assert {(r["request_id"], r["object_id"]) for r in got.where("family_related").collect()} == {(1, 0), (1, 2)}


def test_causes_and_paths_are_looked_for_where_their_marks_are(spark):
    texts = [
        "Refuſed to load", "eKcausing ENOſPC", "unable to get local ıssuer", "DİSK full", "bad credentİals", "no space left on it", "peer dep was a conflict", "conflicting peer deps",
        "redis had an error", 'relation "x" does not exist', "script-src", "csp will block", "yaml parse error", "nothing at all", "", "see src/a/b.py:3:4 and '\\\\x\\\\y\\\\z.ts'", "a/b.pyc a.py/ /q/w.js", "No.ts/but",
    ]
    df = spark.createDataFrame([(t,) for t in texts], "t string")
    plain = [F.when(F.col("t").rlike("(?iU)(?:" + "|".join(f"(?:{p})" for p in ps) + ")"), F.lit(n)) for n, ps in V.CAUSES.items()]
    rows = df.select("t", fn.causes(F.col("t")).alias("got"), F.array_sort(F.array_compact(F.array(*plain))).alias("want"), fn.source_paths(F.col("t")).alias("paths")).collect()
    assert [r["got"] for r in rows] == [r["want"] for r in rows] and sum(bool(r["want"]) for r in rows) >= 10
    assert [p for r in rows for p in r["paths"]] == ["src/a/b.py", r"\\x\\y\\z.ts", "/q/w.js"]
    assert all(fn.marks(p) for ps in V.CAUSES.values() for p in ps) and fn.marks(r"a|b\d") == ["a", "b"] and fn.marks(r"(?:ab)?\d+|x") == []
    assert "Contains" in df.select(fn.causes(F.col("t")))._jdf.queryExecution().executedPlan().toString() or "contains" in _plan(df.select(fn.causes(F.col("t")))).lower()


def test_words_are_trimmed_without_patterns(spark):
    df = spark.createDataFrame([("..a.b-c-- __X__ foo.bar/baz@-qux- x- $y. -- plain-word_",)], "t string")
    want = ["$y", "__x__", "a.b-c", "b-c", "bar", "baz", "foo", "foo.bar", "plain-word", "qux", "x"]
    assert df.select(fn.tokenize(F.col("t")).alias("w")).first()["w"] == want
    assert "regexp_replace" not in _plan(df.select(fn.tokenize(F.col("t"))))


def test_only_the_classes_asked_for_are_mined(spark):
    df = spark.createDataFrame([(1, "The Loader lost ENOSPC in the web.")], "doc_id long, text string")
    every = {(r["kind"], r["value"]) for r in signatures.mine(df).collect()}
    some = signatures.mine(df, kinds=("component",))
    assert {(r["kind"], r["value"]) for r in some.collect()} == {x for x in every if x[0] == "component"} == {("component", "loader"), ("component", "web")}
    assert "ENOSPC" not in _plan(some)


def test_diagnosis_reads_each_text_once(spark, sf):
    assert "MapInPandas" not in _plan(engine.QUERIES["diagnosis"](spark, sf))


def _reach(parents, starts):
    want = set()
    for start in starts:
        todo, met = [start], {start}
        while todo:
            up = set(parents.get(todo.pop(), ())) - met
            todo += up
            met |= up
        want |= {(start, k) for k in met}
    return want


def _ancestors(spark, parents, starts):
    commits = spark.createDataFrame(pd.DataFrame({"sha": list(parents), "parents": list(parents.values())}), "sha long, parents array<long>")
    return [tuple(r) for r in history.ancestors(commits, spark.createDataFrame([(s,) for s in starts], "start long")).collect()]


def test_starts_that_go_up_together_share_rows(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(history, "shared", lambda spark: f"file://{tmp_path}")
    parents = {k: [p for p in (k // 2, k // 3) if p > 0] for k in range(1024)}
    got = _ancestors(spark, parents, parents)
    assert len(got) == len(set(got)) and set(got) == _reach(parents, parents)
    written = sum(spark.read.parquet(str(p)).count() for kind in ("frontier", "found") for p in tmp_path.glob(f"sleuthwork/ancestors-*/{kind}-*"))
    assert 3 * written < len(got)


def test_ancestors_of_many_starts_by_any_strides(spark, monkeypatch):
    # Branches of unequal length, a circle, starts that are no commits, twice there or null.
    parents = {k: [k - 1] if k % 5 else [k - 1, k - 7] for k in range(1, 90)} | {0: [], 200: [201], 201: [202], 202: [200, 3], 300: None}
    starts = [*parents, *range(50), 999]
    want = _reach({k: v or [] for k, v in parents.items()}, starts) | {(None, None)}
    for plain, levels, uncompared in ((32, 4, 8), (1, 1, 3), (3, 2, 1)):
        for name, value in (("PLAIN", plain), ("LEVELS", levels), ("UNCOMPARED", uncompared)):
            monkeypatch.setattr(history, name, value)
        got = _ancestors(spark, parents, [*starts, None])
        assert len(got) == len(set(got)) and set(got) == want
