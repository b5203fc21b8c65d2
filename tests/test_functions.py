import pytest
from pyspark.sql import functions as F

from sleuthwork.functions import text as fn
from sleuthwork.functions import versions as ver


def one(spark, column, **values):
    names = list(values)
    df = spark.createDataFrame([tuple(values.values())], ", ".join(f"{n} {'array<string>' if isinstance(v, list) else 'string'}" for n, v in values.items()) or "x string")
    assert names
    return df.select(column.alias("r")).first()["r"]


@pytest.mark.parametrize("raw,want", [("abc-v0.1.2-alpha.3", "0.1.2a3"), ("v0.2.3", "0.2.3"), ("release-1.4", "1.4"), ("foo@1.4", "1.4"), ("0.1.1-rc.2", "0.1.1rc2"), *[(x, None) for x in (None, "", "latest", "main", "nightly", "v")]])
def test_normalize_version(spark, raw, want):
    assert one(spark, ver.normalize_version(F.col("v")), v=raw) == want


def test_order_of_versions(spark):
    want = ["1.0.dev1", "1.0a1", "1.0b1", "1.0rc1", "1.0", "1.0.post1", "1.1", "1.10"]
    df = spark.createDataFrame([(v,) for v in ["main", *reversed(want)]], "v string")
    got = [r["v"] for r in df.orderBy(ver.version_key(F.col("v")).asc_nulls_last()).collect()]
    assert got == [*want, "main"]


@pytest.mark.parametrize("a,b,want", [("0.1.2-alpha.3", "0.1.2", -1), ("0.1.1-rc.2", "0.1.2-alpha.1", -1), ("1.0", "1", 0), ("main", "1", None)])
def test_compare(spark, a, b, want):
    assert one(spark, ver.compare(F.col("a"), F.col("b")), a=a, b=b) == want


@pytest.mark.parametrize("v,want", [("0.1.5", True), ("0.0.9", False), ("0.2.0", False), ("nightly", None)])
def test_half_open_range(spark, v, want):
    assert one(spark, ver.in_range(F.col("v"), F.lit("0.1.0"), F.lit("0.2.0")), v=v) is want


@pytest.mark.parametrize("v,want", [("24.5.0", True), ("24.11.1", True), ("22.19.0", False), ("25.0.0", False), ("nightly", None), (None, None)])
def test_runtime_bounds(spark, v, want):
    none = F.array().cast("array<string>")
    assert one(spark, ver.covers(F.lit("24.0"), F.lit("24.11.1"), none, F.col("v")), v=v) is want


def test_point_needs_a_dot(spark):
    null = F.lit(None).cast("string")
    point = lambda p: F.array(F.lit(p))
    assert one(spark, ver.covers(null, null, point("24.11"), F.col("v")), v="24.11.1") is True
    assert one(spark, ver.covers(null, null, point("24.1"), F.col("v")), v="24.11.1") is False


def test_constraints(spark):
    got = one(spark, ver.constraints(F.col("t")), t="Needs Node 24.0 – 24.11.1 on Windows and WSL; python >= 3.11. Node 22")
    assert [(r["runtime"], r["low"], r["high"], r["points"]) for r in got["runtimes"]] == [("node", "24.0", "24.11.1", []), ("python", "3.11", None, []), ("node", None, None, ["22"])]
    assert got["systems"] == ["linux", "windows"]


def test_fingerprint(spark):
    df = spark.createDataFrame([(1, "TypeError: Registry.get at /home/a/b/foo.ts:1:2"), (2, "TypeError: Registry.get at /srv/x/y/foo.ts:9:9"), (3, "ERR_OTHER: nothing here"), (4, None)], "id int, t string")
    got = {r["id"]: r["fingerprint"] for r in fn.with_fingerprint(df, F.col("t")).collect()}
    assert got[1]["hash"] == got[2]["hash"] != got[3]["hash"]
    assert "Registry.get" in got[1]["symbols"] and "foo.ts" in got[1]["files"] and got[1]["exceptions"] == ["TypeError"]
    assert not set(got[1]["discriminative"]) & set(got[3]["discriminative"])
    assert got[4]["hash"] == ""


def test_redaction(spark):
    got = one(spark, fn.redact(F.col("t")), t="password: hunter22 a@b.org /home/bob/x ghp_abcdefghijklmnop1234")
    assert "hunter22" not in got and "a@b.org" not in got and "bob" not in got and "abcdefghij" not in got


def test_references(spark):
    df = spark.createDataFrame([(1, "#391 and deadbee or 0x1234567 #a1b2c3d https://github.com/o/r/issues/12. fixed in v0.1.2 #391")], "doc_id int, text string")
    from sleuthwork.operators import history

    got = {(r["kind"], r["value"], r["confidence"]) for r in history.reference_edges(df).collect()}
    assert got == {("number", "391", "high"), ("commit", "deadbee", "medium"), ("issue", "12", "high"), ("version", "v0.1.2", "medium")}


def test_behaviour_and_causes(spark):
    assert one(spark, fn.behaviour(F.col("t")), t="no entries were preloaded, it did not start") == ["absent:entry", "absent:preload", "absent:start"]
    assert one(spark, fn.causes(F.col("t")), t="getaddrinfo ENOTFOUND and permission denied") == ["dns_resolution", "permission"]
    assert one(spark, fn.causes(F.col("t")), t="peer dependency @a/b is healthy") == []


@pytest.mark.parametrize("t,want", [("vendor/esm-shim/src/resolve.ts", ["esm-shim/src/resolve.ts"]), ("src/x.ts", []), ("a/loader/x.ts", ["loader/x.ts"]), (None, [])])
def test_paths(spark, t, want):
    assert one(spark, fn.path_tails(fn.source_paths(F.col("t"))), t=t) == want


@pytest.mark.parametrize("w,want", [("entries", "entry"), ("preloads", "preload"), ("starting", "start"), ("bus", "bus"), ("failed", "fail")])
def test_stem(spark, w, want):
    assert one(spark, fn.stem(F.col("w")), w=w) == want


def test_query_tokens_order(spark):
    got = one(spark, fn.query_tokens(F.col("d")), d=["plainword", "a.b.c", "longerplainword", "abc", "x-module"])
    assert got == ["x-module", "a.b.c", "longerplainword", "plainword"]
