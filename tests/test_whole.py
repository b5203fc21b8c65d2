"""Queries that do a whole job which the SQL of an older query covers in part."""

import re

from sleuthwork.functions import fixed as V
from sleuthwork.operators import history
from sleuthwork.plans import queries as engine


def _documents(spark, tmp_path, texts, table="documents"):
    spark.createDataFrame([(i, t, "en", "s") for i, t in enumerate(texts, 1)], "doc_id long, text string, lang string, source string").write.parquet(f"{tmp_path}/{table}.parquet")
    return str(tmp_path)


def test_identity_judges_later_documents(spark, tmp_path):
    shared = "alphabeticalorder betacarotenelike"
    d = _documents(spark, tmp_path, ["head\nnothing here", f"head\n{shared} one", f"head\ntwo {shared}", f"head\n{shared} one"])
    got = {(r["query_id"], r["candidate_id"]): r["accepted"] for r in engine.QUERIES["identity_cascade"](spark, d).collect()}
    assert got == {(1, 2): False, (1, 3): False, (1, 4): False, (2, 3): True, (2, 4): True, (3, 4): True}


def test_leave_one_out_asks_every_twentieth(spark, tmp_path):
    texts = ["filler words only"] * 20
    texts[6] = texts[19] = "zebracrossing here"
    d = _documents(spark, tmp_path, texts)
    got = [(r["request_id"], r["object_id"], r["matched"]) for r in engine.QUERIES["leave_one_out"](spark, d).collect()]
    assert got == [(20, 7, 1)]


def test_thread_rollup_takes_every_opening_turn(spark, tmp_path):
    rows = [(3, 0, "user", "zebracrossing"), (3, 1, "assistant", "a zebracrossing"), (10, 0, "user", "waterfalls")]
    spark.createDataFrame(rows, "conv_id long, turn int, role string, text string").write.parquet(f"{tmp_path}/conversations.parquet")
    got = {r["thread"]: (r["matched"], r["unit_hits"]) for r in engine.QUERIES["thread_rollup"](spark, str(tmp_path)).collect()}
    assert got == {3000: (1, 2), 10000: (1, 1)}


def test_redaction_needs_no_address(spark, tmp_path):
    texts = ["password: hunter22", "api_key=abc123def x", "secret='s3cr3t!!'", "cookie: abcdefgh", "token: abcdefgh", "ghp_abcdefghijklmnop1234", "sk-abcdefghijklmnop1234 z", "xoxb-1234567890ab",
             "eyJhbGciOiJIUzI1.eyJzdWIiOiIxMjM0.SflKxwRJSMeKKF2Q", "/home/bob/x and /Users/eve/y", "C:\\Users\\bob\\z", "nothing", "", None, "a@b.org token=abcdefgh"]
    got = {r["doc_id"]: r["redacted"] for r in engine.QUERIES["redact_documents"](spark, _documents(spark, tmp_path, texts)).collect()}
    want = {}
    for i, text in enumerate(texts, 1):
        for pattern, by in V.REDACTIONS:
            if text is not None:
                text = re.sub(pattern, re.sub(r"\$(\d)", r"\\g<\1>", by), text)
        want[i] = text
    assert got == want
    assert all(got[i] != t for i, t in enumerate(texts, 1) if t not in ("nothing", "", None))


def test_excerpts_of_short_tokens(spark, tmp_path):
    d = _documents(spark, tmp_path, ["a giraffe walks\ngiraffe"])
    spark.createDataFrame([(1, "giraffe")], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    assert [tuple(r) for r in engine.QUERIES["best_excerpt"](spark, d).collect()] == [(1, "giraffe", "giraffe")]


def test_ancestors_meet_a_merge_once(spark):
    # 22 merges in a row have 2^22 paths, more than a recursive query's rows.
    rows = [(f"m{i}", [f"a{i}", f"b{i}"]) for i in range(22)] + [(f"{s}{i}", [f"m{i + 1}"]) for s in "ab" for i in range(22)] + [("m22", [])]
    commits = spark.createDataFrame(rows, "sha string, parents array<string>")
    got = history.ancestors(commits, spark.createDataFrame([("m0",)], "start string")).collect()
    assert len(got) == len({r["sha"] for r in got}) == 67


def test_ancestors_of_a_long_history(spark, monkeypatch):
    # Strides double often, or stop doubling early; branches of unequal length meet again.
    rows = {i: [i + 1] for i in range(150)} | {150: []}
    for i in range(0, 140, 7):
        rows[i] = [i + 1, 1000 + i]
        rows[1000 + i] = [i + 5]
    commits = spark.createDataFrame([(f"c{k}", [f"c{p}" for p in v]) for k, v in rows.items()] + [("lone", None), (None, ["c1"])], "sha string, parents array<string>")
    starts = ["c0", "c3", "c75", "c1007", "c150", "lone", "gone"]
    want = set()
    for start in starts:
        todo, met = [start], {start}
        while todo:
            k = todo.pop()
            up = {f"c{p}" for p in rows.get(int(k[1:]), ())} if k[1:].isdigit() else set()
            todo += up - met
            met |= up
        want |= {(start, k) for k in met}
    for levels, spread in ((2, 256), (4, 3)):
        monkeypatch.setattr(history, "LEVELS", levels)
        monkeypatch.setattr(history, "SPREAD", spread)
        got = [tuple(r) for r in history.ancestors(commits, spark.createDataFrame([(s,) for s in [*starts, "c0"]], "start string")).collect()]
        assert len(got) == len(set(got)) and set(got) == want
