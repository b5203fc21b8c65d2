import json
import threading
from http.server import BaseHTTPRequestHandler, HTTPServer

import pytest

from sleuthwork.sources import connectors as c


def source(*batches):
    return lambda cursor: {"nodes": batches[int(cursor or 0)], "next": str(int(cursor or 0) + 1) if int(cursor or 0) + 1 < len(batches) else None}


def node(i, day):
    return {"id": i, "updatedAt": f"2024-01-{day:02d}T00:00:00Z"}


def test_pages():
    fetch = source([node(1, 9), node(2, 8)], [node(3, 7), node(4, 2)], [node(5, 1)])
    walk = lambda **kw: [([n["id"] for n in nodes], cur, s) for nodes, cur, s in c.pages(fetch, **kw)]
    assert walk() == [([1, 2], "1", "more"), ([3, 4], "2", "more"), ([5], None, "complete")]
    assert walk(updated_after="2024-01-05") == [([1, 2], "1", "more"), ([3], "2", "more"), ([], None, "complete")]
    assert walk(max_items=3)[-1] == ([3], "2", "capped")
    assert walk(page_budget=1) == [([1, 2], "1", "budget")]
    assert walk(start="2") == [([5], None, "complete")]


def test_retries():
    waits, answers = [], iter([(502, {}, None), (429, {}, 500.0), (200, {"ok": 1}, None)])
    assert c.with_retries(lambda: next(answers), waits.append) == {"ok": 1} and waits == [1, 90]
    with pytest.raises(OSError):
        c.with_retries(lambda: (404, {}, None), waits.append)


def test_data_source(spark):
    fetch = source([node(1, 9)], [node(2, 8)])

    class Handler(BaseHTTPRequestHandler):
        def do_GET(self):
            body = json.dumps(fetch(self.path.partition("cursor=")[2] or None)).encode()
            self.send_response(200)
            self.end_headers()
            self.wfile.write(body)

        def log_message(self, *args):
            pass

    server = HTTPServer(("127.0.0.1", 0), Handler)
    threading.Thread(target=server.serve_forever, daemon=True).start()
    spark.dataSource.register(c.PagedSource)
    rows = spark.read.format("paged_json").option("urls", f"http://127.0.0.1:{server.server_port}/x").load().collect()
    server.shutdown()
    assert sorted(json.loads(r["node"])["id"] for r in rows) == [1, 2] and {r["state"] for r in rows} == {"more", "complete"}


def test_filters_and_profile(spark, tmp_path):
    from pyspark.sql import functions as F

    df = spark.createDataFrame([("nightly-1", "a/readme.MD"), ("v1", "dist/x.json"), ("v2", "x.png")], "tag string, path string")
    got = df.select(c.keep_tag(F.col("tag"), ["^nightly"]).alias("t"), c.keep_document(F.col("path"), ["^dist/"]).alias("d")).collect()
    assert [(r["t"], r["d"]) for r in got] == [(False, True), (True, False), (True, False)]
    (tmp_path / "p.yaml").write_text("tag_ignore: ['^x']\n")
    assert c.load_profile(str(tmp_path), "p") == {"tag_ignore": ["^x"]}
    with pytest.raises(FileNotFoundError):
        c.load_profile(str(tmp_path), "q")


def test_workspace(tmp_path):
    assert c.inspect_workspace(str(tmp_path)) == []
    (tmp_path / "package.json").write_text('{"name":"app","version":"1","dependencies":{"a":"^1","b":"^2"}}')
    (tmp_path / "node_modules/a").mkdir(parents=True)
    (tmp_path / "node_modules/a/package.json").write_text('{"version":"1.4.0"}')
    got = {r["name"]: (r["version"], r["source"]) for r in c.inspect_workspace(str(tmp_path))}
    assert got == {"app": ("1", "manifest"), "a": ("1.4.0", "installed"), "b": ("^2", "declared")}
