"""Each operator against a plain version of what it promises, on awkward rows, small tables and no rows."""

import collections
import hashlib
import random
import re
import zlib

import numpy as np
import pyarrow as pa
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from sleuthwork.llm import decontaminate, fingerprints, language_id, mixing, near_dedup, queries, secret_scan, sharding, substring_dedup, token_output, url_filter
from tests.oracle import same


def documents(spark, sf):
    return spark.read.parquet(f"{sf}/documents.parquet")


@pytest.mark.parametrize("name", sorted(queries.oracle_sql()))
def test_matches_sql(spark, sf, name):
    same(spark, sf, name, queries.queries(), queries.oracle_sql())


# --- 1 fingerprints -----------------------------------------------------------------------------------

def test_fingerprints(spark, hard, empty):
    got = fingerprints.fingerprint_documents(hard).collect()
    assert len(got) == hard.count() and fingerprints.fingerprint_documents(empty).count() == 0
    rows = sorted(((r["doc_id"], r["text"] or "") for r in hard.collect()), key=lambda r: (r[0] is not None, r[0] or 0, r[1]))
    want = collections.Counter()
    for (d, t), (_, n) in zip(rows, rows[1:] + rows[:1], strict=True):
        q = len(t) // 4
        want[(d, len(t), hashlib.sha256((t[: len(t) - q] + n[:q]).encode()).hexdigest())] += 1
    assert collections.Counter((r["doc_id"], r["n_chars"], r["edited_sha256"]) for r in got) == want
    by = {(r["doc_id"], r["n_chars"]): r for r in got}
    assert by[(1, 0) if (1, 0) in by else next(k for k in by if k[0] == 1)]["fingerprint"] == next(r for r in got if r["doc_id"] == 2)["fingerprint"]
    assert all(0 <= r["near_edited"] <= 1 and 0 <= r["near_next"] <= 1 for r in got)
    assert next(r for r in got if r["doc_id"] == 1)["near_next"] == 1.0


def test_edit_is_located(spark):
    text = "".join(f"Sentence number {i} is here. " for i in range(200))
    df = spark.createDataFrame([(text, text.replace("number 100 ", "number one hundred "))], "a string, b string")
    a, b = fingerprints.fingerprint(F.col("a")), fingerprints.fingerprint(F.col("b"))
    row = df.select(a.alias("x"), b.alias("y")).select("x", "y", fingerprints.differing_sections(F.col("x"), F.col("y")).alias("d"), fingerprints.likeness(F.col("x"), F.col("y")).alias("l")).first()
    assert 1 <= len(row["d"]) <= 2 and row["l"] > 0.98 and len(row["y"].split("|")) > 10


# --- 2 near-dedup ---------------------------------------------------------------------------------------

def brute_components(rows):
    """doc_id -> (set size, component) by comparing all pairs."""
    sets = []
    for _, t in rows:
        w = re.findall(rb"[^\x20\x09-\x0D]+", re.sub(rb"[A-Z]", lambda m: m[0].lower(), (t or "").encode()))
        sets.append({tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))} if w else set())
    top = list(range(len(rows)))

    def find(i):
        while top[i] != i:
            i = top[i]
        return i

    for i in range(len(rows)):
        for j in range(i):
            if sets[i] and sets[j] and 100 * len(sets[i] & sets[j]) >= 75 * len(sets[i] | sets[j]):
                top[max(find(i), find(j))] = min(find(i), find(j))
    groups = collections.defaultdict(list)
    for i, (d, _) in enumerate(rows):
        groups[find(i)].append(d)
    best = {k: min((d for d in v if d is not None), default=None) for k, v in groups.items()}
    return collections.Counter((d, len(sets[i]), best[find(i)]) for i, (d, _) in enumerate(rows))


def near_counter(df):
    return collections.Counter((r["doc_id"], r["n_shingles"], r["component_id"]) for r in near_dedup.near_duplicates(df).collect())


def edits(rng, words, n, vocabulary):
    words = list(words)
    for _ in range(n):
        words[rng.randrange(len(words))] = rng.choice(vocabulary)
    return words


def test_near_dedup_brute(spark, hard, empty):
    rng = random.Random(5)
    vocabulary = [f"w{i}" for i in range(3000)]
    rows = [(r["doc_id"], r["text"]) for r in hard.collect()]
    d = 100
    for size in (12, 60, 200):
        seed = [rng.choice(vocabulary) for _ in range(size)]
        chain = seed
        for k in range(25):  # copies of copies and of the first, at all distances
            chain = edits(rng, chain, rng.randint(0, 1 + size // 60), vocabulary)
            rows += [(d, " ".join(chain)), (d + 1, " ".join(edits(rng, seed, k % (2 + size // 20), vocabulary)))]
            d += 2
    passage = " ".join(rng.choice(vocabulary) for _ in range(60))
    rows += [(d + i, passage + " " + " ".join(rng.choice(vocabulary) for _ in range(50))) for i in range(30)]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    assert near_counter(df) == brute_components(rows)
    assert near_dedup.near_duplicates(empty).count() == 0


def test_near_dedup_documents(spark, sf):
    rows = [(r["doc_id"], r["text"]) for r in documents(spark, sf).select("doc_id", "text").collect()]
    assert near_counter(documents(spark, sf)) == brute_components(rows)


def test_prefix_filter_finds_all_links(spark):
    rng = random.Random(8)
    vocabulary = [f"w{i}" for i in range(500)]
    seed = [rng.choice(vocabulary) for _ in range(80)]
    rows = [(i, " ".join(edits(rng, seed, rng.randint(0, 4), vocabulary))) for i in range(40)]
    texts = pa.array([t for _, t in rows])
    v, b = near_dedup.sets(texts)
    s = [set(v[b[i] : b[i + 1]].tolist()) for i in range(len(rows))]
    nodes = spark.createDataFrame([(i, len(s[i]), i) for i in range(len(rows))], "node long, n long, label long")
    bodies = spark.createDataFrame(rows, "node long, body string")
    pairs = {(r["a"], r["b"]) for r in near_dedup.prefix_pairs(nodes, bodies).collect()}
    want = {(i, j) for j in range(len(rows)) for i in range(j) if 100 * len(s[i] & s[j]) >= 75 * len(s[i] | s[j])}
    assert want and want <= pairs


def test_components(spark):
    links = [(i, i + 1) for i in range(0, 60)] + [(100 + i, 100) for i in range(1, 30)] + [(200, 300), (300, 250), (7, 7)]
    got = {r["node"]: r["label"] for r in near_dedup.components(spark.createDataFrame(links, "a long, b long")).collect()}
    want = {i: 0 for i in range(1, 61)} | {100 + i: 100 for i in range(1, 30)} | {250: 200, 300: 200}
    assert got == want


def test_deduplicated_keeps_columns(spark, hard):
    out = near_dedup.deduplicated(hard)
    ids = sorted(r["doc_id"] for r in out.collect() if r["doc_id"] is not None)
    assert out.columns == hard.columns and 2 not in ids and ids.count(8) == 1 and ids.count(9) == 2 and -5 in ids


# --- 3 token output -----------------------------------------------------------------------------------------

def test_token_output(spark, hard, empty, tmp_path):
    enc = token_output.encoder(token_output.vocabulary())
    rows = sorted(((r["doc_id"], r["text"]) for r in hard.collect()), key=lambda r: (r[0] is not None, r[0] or 0, r[1] is not None, r[1] or ""))
    want, start = [], 0
    for d, t in rows:
        ids = np.array([*enc.whole(t or ""), 0], "<u4")
        want.append((d, start, len(ids), zlib.crc32(ids.tobytes())))
        start += len(ids)
    got = [tuple(r) for r in token_output.token_output(hard, str(tmp_path / "t")).collect()]
    assert sorted(got, key=repr) == sorted(want, key=repr)
    assert token_output.token_output(empty, str(tmp_path / "e")).count() == 0


@settings(max_examples=60, deadline=None)
@given(st.lists(st.text(alphabet=st.sampled_from(list("ab Z'.\n\t 1é日\x1f  |<>")) | st.characters(), max_size=30), max_size=6))
def test_encoder_equals_library(texts):
    texts = [t.encode("utf-8", "ignore").decode() for t in texts] + ["x<|endoftext|> y  z", " a", "a ", "\n\na b"]
    enc = token_output.encoder(token_output.vocabulary())
    ids, n = enc.batch(pa.array([*texts, None], pa.string()))
    assert [i.tolist() for i in np.split(ids, np.cumsum(n))[:-1]] == [*[enc.whole(t) for t in texts], []]


def test_encoder_eviction(monkeypatch):
    monkeypatch.setattr(token_output, "CACHE_PIECES", 50)
    enc = token_output.Encoder(token_output.vocabulary())
    for k in range(6):
        texts = [f"common words and rare{k}x{i} ones" for i in range(40)]
        ids, n = enc.batch(pa.array(texts))
        assert [i.tolist() for i in np.split(ids, np.cumsum(n))[:-1]] == [enc.whole(t) for t in texts]


@settings(max_examples=60, deadline=None)
@given(st.lists(st.integers(0, 6) | st.integers(0, 50_256), max_size=400))
def test_repair_round_trip(ids):
    ids = np.array(ids, np.uint16)
    pairs, lengths, seq = token_output.repair(ids)
    assert (token_output.expand(pairs, seq) == ids).all() and len(seq) <= len(ids)
    block = token_output.Block(token_output.pack([3, None], np.array([len(ids), 0]), ids))
    assert (block.ids() == ids).all()
    for a, b in ((0, len(ids)), (len(ids) // 3, len(ids) // 2), (5, 5)):
        assert (block.read_range(a, b) == ids[a:b]).all() or a >= len(ids)


def test_repair_compresses():
    ids = np.array([1, 2, 3, 4] * 500, np.uint16)
    assert len(token_output.repair(ids)[2]) < 200


# --- 4 decontamination ----------------------------------------------------------------------------------------

def brute_hits(text, items):
    words = lambda t: re.findall(rb"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", re.sub(rb"[A-Z]", lambda m: m[0].lower(), (t or "").encode()))
    doc, hit, found = words(text), set(), set()
    for name, t in items:
        w = words(t)
        k = min(8, len(w))
        for i in range(len(w) - k + 1 if k else 0):
            for j in range(len(doc) - k + 1):
                if doc[j : j + k] == w[i : i + k]:
                    hit.update(range(j, j + k))
                    found.add(name or "")
    return len(doc), len(hit), sorted(found)


def test_decontamination(spark, hard, empty, monkeypatch):
    rows = hard.collect()
    base = rows[0]["text"].split()
    items = [("b", " ".join(base[10:30])), ("a", " ".join(base[25:60]).upper()), ("10", "one"), ("9", None), ("8", ""), (None, "x y z"), ("b", "12 34"), ("c", " ".join(base[100:104]))]
    bench = spark.createDataFrame(items, "item_id string, text string")
    want = collections.Counter()
    for r in rows:
        n, h, f = brute_hits(r["text"], items)
        want[(r["doc_id"], n, h, len(f), hashlib.sha256(",".join(f).encode()).hexdigest(), len(f) >= 2)] += 1
    once = collections.Counter(tuple(r) for r in decontaminate.decontaminate(hard, bench).collect())
    assert once == want
    monkeypatch.setattr(decontaminate, "BLOCK_BYTES", 150)  # several passes over blocks of items
    assert collections.Counter(tuple(r) for r in decontaminate.decontaminate(hard, bench).collect()) == want
    assert decontaminate.decontaminate(empty, bench).count() == 0
    assert not any(r["contaminated"] for r in decontaminate.decontaminate(hard, bench.limit(0)).collect())
    kept = decontaminate.clean_documents(hard, bench)
    assert kept.columns == hard.columns and kept.count() == sum(c for k, c in want.items() if not k[-1])


# --- 5 secrets --------------------------------------------------------------------------------------------------

def test_secret_scan(spark, hard, empty):
    key, key2 = hashlib.sha1(b"k").hexdigest(), "Zk3Jq9fLp0TtVx82mQwY"
    texts = [f'set token = "{key}" then go', f"commit {key} was fine", f"api_key={key2} end", "card 4845168114407329 here", "password: your_secret_here1234 ok", None, ""]
    df = spark.createDataFrame([(i, t, None) for i, t in enumerate(texts)], "doc_id int, text string, source string")
    got = {r["doc_id"]: r for r in secret_scan.scan(df).collect()}
    assert set(got) == {0, 1, 2, 3, 4}
    assert {k for k, r in got.items() if r["is_secret"]} == {0, 2}
    assert got[0]["candidate_sha256"] == hashlib.sha256(key.encode()).hexdigest() and key not in got[0]["mask"] and got[0]["word_index"] == 3
    assert secret_scan.scan(empty).count() == 0 and secret_scan.scan(hard).count() >= 0


def test_secret_forest_held_out(spark):
    known = secret_scan.labelled_findings(spark, 4000).cache()
    test = known.where(F.pmod(F.xxhash64("candidate"), F.lit(4)) == 0)
    docs = test.select(F.xxhash64("candidate").alias("doc_id"), F.concat("before", "candidate", F.lit(" "), "after").alias("text"), F.col("path").alias("source"), "label")
    found = secret_scan.scan(docs, known.where(F.pmod(F.xxhash64("candidate"), F.lit(4)) != 0)).join(docs.select("doc_id", "label"), "doc_id")
    assert found.where(F.col("is_secret").cast("double") == F.col("label")).count() / found.count() > 0.95


# --- 6 languages -----------------------------------------------------------------------------------------------------

def test_languages_held_out(spark, hard, empty):
    docs = documents(spark, "/root/testdata/sf0.01")
    got = language_id.languages(docs).join(docs.select("doc_id", "lang"), "doc_id").where("held_out").collect()
    assert sum(r["lang"] == r["lang_pred"] for r in got) / len(got) > 0.98 and all(0 <= r["score"] <= 1 for r in got)
    for r in docs.limit(20).collect():
        held = zlib.crc32(str(r["doc_id"]).encode()) % 3 == 1
        assert docs.where(F.col("doc_id") == r["doc_id"]).select(language_id.held_out(F.col("doc_id"))).first()[0] == held
    rows = language_id.languages(hard)
    assert rows.count() == hard.count() and language_id.languages(empty).count() == 0
    und = {r["doc_id"] for r in rows.collect() if r["lang_pred"] == "und"}
    assert {5, 6, 7, 11} <= und and 12 not in und


def test_labels_are_no_input(spark):
    docs = documents(spark, "/root/testdata/sf0.001")
    data = language_id.samples(docs)
    changed = docs.withColumn("lang", F.lit("xx")).withColumn("source", F.lit("yy"))
    a = {r["doc_id"]: r["_sw_lang"] for r in language_id.identify(docs, data).collect()}
    assert a == {r["doc_id"]: r["_sw_lang"] for r in language_id.identify(changed, data).collect()}


@settings(max_examples=50, deadline=None)
@given(st.text("abc", min_size=1, max_size=60), st.text("abcd", min_size=1, max_size=60))
def test_automaton_parses_by_longest_match(train, text):
    model = language_id.Model({"x": train.encode()})
    got, _ = model.costs(np.frombuffer(text.encode(), np.uint8), np.array([0, len(text)]))
    phrases, i = 0, 0
    while i < len(text):
        j = i + 1
        while j < len(text) and text[i : j + 1] in train:
            j += 1
        phrases, i = phrases + 1, j
    assert round(got[0, 0] / model.bits[0]) == phrases


# --- 7 URLs ---------------------------------------------------------------------------------------------------------------

RULED = [("com/", "allow"), ("example.com/en/", "block"), ("www.example.com/en/", "allow"), ("net/es/", "block"), ("net/fr/", "block")]


def brute_url(url):
    if url is None or "://" not in url:
        return "", "", None, None
    rest = url.split("://", 1)[1]
    host = re.split(r"[/?#]", rest)[0]
    path = re.split(r"[?#]", rest[len(host) :])[0]
    host = "".join(c.lower() if "A" <= c <= "Z" else c for c in host)
    fits = [(len(r), r, v) for r, v in RULED if (host == r.split("/")[0] or host.endswith("." + r.split("/")[0])) and path.startswith("/" + r.split("/", 1)[1])]
    return host, path, *((max(fits)[1], max(fits)[2]) if fits else (None, None))


def test_urls(spark, sf):
    urls = [r["url"] for r in spark.read.parquet(f"{sf}/pages.parquet").collect()]
    urls += [None, "", "nothing", "http://", "http://COM/x", "https://a.COM?q=://b", "ftp://x.net/es/", "http://x.net/es", "://com/", "http://WWW.example.com/en/1", "http://sub.www.example.com/en/", "http://notexample.com/en/", "http://com#/", "http://É.com/", urls[0], urls[0]]
    got = url_filter.judge(spark.createDataFrame(list(enumerate(urls)), "page_id int, url string")).collect()
    assert len(got) == len(urls)
    for r in got:
        host, path, rule, verdict = brute_url(urls[r["page_id"]])
        assert (r["host"], r["path"], r["rule"]) == (host, path, rule) and r["verdict"] in ("allow", "block") and verdict in (None, r["verdict"])
    assert url_filter.judge(spark.createDataFrame([], "page_id int, url string")).count() == 0


def test_url_trees_learn_form(spark):
    rng = random.Random(2)
    rows = [(f"http://{'cheap-' * (i % 2)}site{rng.randrange(10**6)}.org/{rng.randrange(9)}", float(i % 2)) for i in range(600)]
    known = spark.createDataFrame(rows[:400], "url string, label double")
    got = url_filter.judge(spark.createDataFrame([(i, u) for i, (u, _) in enumerate(rows[400:])], "page_id int, url string"), known).collect()
    assert sum((r["verdict"] == "block") == bool(rows[400 + r["page_id"]][1]) for r in got) / len(got) > 0.95


# --- 8 sharding --------------------------------------------------------------------------------------------------------------

def test_sharding(spark, hard, empty):
    docs = documents(spark, "/root/testdata/sf0.01")
    for df in (hard, docs):
        got, src = sharding.sharded(df).collect(), df.collect()
        assert collections.Counter((r["doc_id"], r["size"], r["text_crc32"]) for r in got) == collections.Counter((r["doc_id"], len((r["text"] or "").encode()) + 1, zlib.crc32((r["text"] or "").encode())) for r in src)
        shards = collections.defaultdict(list)
        for r in got:
            assert 0 <= r["shard"] < 16 and r["law"] == "bytes" and r["grown_shard"] is None
            shards[r["shard"]].append(r["slot"])
        assert all(sorted(s) == list(range(len(s))) for s in shards.values())
    sizes, biggest = collections.Counter(), max(r["size"] for r in got)
    for r in got:
        sizes[r["shard"]] += r["size"]
    mean = sum(sizes.values()) / 16
    assert all(abs(s - mean) <= biggest for s in sizes.values())
    assert sharding.sharded(empty).count() == 0


def test_sharding_hot_group(spark):
    rows = [(i, "same text") for i in range(400)] + [(1000 + i, f"text {i}") for i in range(400)]
    got = sharding.sharded(spark.createDataFrame(rows, "doc_id long, text string")).groupBy("shard").agg(F.sum("size").alias("s"), F.count("*").alias("n"), F.max("slot").alias("m")).collect()
    assert len(got) == 16 and all(r["n"] == r["m"] + 1 for r in got) and max(r["s"] for r in got) < 1.1 * min(r["s"] for r in got)


# --- 9 mixing -----------------------------------------------------------------------------------------------------------------

def brute_targets(sizes, weights):
    total, free, out = sum(sizes), [i for i, s in enumerate(sizes) if s], [0.0] * len(sizes)
    while free:
        left = total - sum(out[i] for i in range(len(sizes)) if i not in free)
        w = sum(weights[i] for i in free)
        above = [i for i in free if left * weights[i] / w > 3 * sizes[i]]
        for i in free:
            out[i] = min(left * weights[i] / w, 3 * sizes[i])
        if not above:
            break
        free = [i for i in free if i not in above]
    return out


@settings(max_examples=80, deadline=None)
@given(st.lists(st.integers(0, 10_000), min_size=1, max_size=12))
def test_targets(sizes):
    weights = [1 + i % 3 for i in range(len(sizes))]
    assert mixing.targets(sizes, weights) == pytest.approx(brute_targets(sizes, weights))


@settings(max_examples=80, deadline=None)
@given(st.lists(st.floats(0, 1000), min_size=1, max_size=8), st.integers(0, 200))
def test_sainte_lague(votes, seats):
    caps = [90] * len(votes)
    want = [0] * len(votes)
    for _ in range(min(seats, sum(c for c, v in zip(caps, votes, strict=True) if v > 0))):
        i = max((i for i in range(len(votes)) if want[i] < caps[i] and votes[i] > 0), key=lambda i: (votes[i] / (2 * want[i] + 1), -i))
        want[i] += 1
    got = mixing.sainte_lague(votes, seats, caps)
    assert sum(got) == sum(want) and all(abs(a - b) <= 1 for a, b in zip(got, want, strict=True))
    shards = mixing.shard_quotas(votes, seats, caps, 4)
    assert [sum(x) for x in zip(*shards, strict=True)] == got and all(q >= 0 for s in shards for q in s)


def test_mixing(spark, hard, empty):
    docs = documents(spark, "/root/testdata/sf0.01")
    for df in (docs, hard):
        got, src = mixing.mixed(df).collect(), df.collect()
        size = lambda t: len(re.findall(rb"[^\x20\x09-\x0D]+", (t or "").encode()))
        assert collections.Counter((r["doc_id"], r["size"]) for r in got) == collections.Counter((r["doc_id"], size(r["text"])) for r in src)
        sums = collections.Counter()
        for r in src:
            sums[r["source"]] += size(r["text"])
        order = sorted(sums, key=lambda s: (s is None, s or ""))
        want = dict(zip(order, brute_targets([sums[s] for s in order], [1 + i % 3 for i in range(len(order))]), strict=True))
        source = {(r["doc_id"], size(r["text"])): r["source"] for r in src}
        taken = collections.Counter()
        for r in got:
            s = source[(r["doc_id"], r["size"])]
            assert r["source_size"] == sums[s] and r["target"] == pytest.approx(want[s]) and 0 <= r["taken"] <= 3 * r["size"]
            taken[s] += r["taken"]
        assert all(abs(taken[s] - want[s]) <= 2 * mixing.BLOCK for s in order)
    assert sorted(map(tuple, got), key=repr) == sorted(map(tuple, mixing.mixed(df).collect()), key=repr)
    assert mixing.mixed(empty).count() == 0


def test_mixed_documents(spark, sf):
    docs = documents(spark, sf)
    out = mixing.mixed_documents(docs)
    assert out.columns == docs.columns
    words = out.groupBy("doc_id").agg(F.sum(mixing.n_words(F.col("text"))).alias("w"))
    both = mixing.mixed(docs).where("taken > 0").join(words, "doc_id", "full_outer")
    assert both.where("NOT (taken <=> w)").count() == 0
    assert out.where(F.length("text") != F.col("n_chars")).count() == 0


# --- 10 substring dedup -----------------------------------------------------------------------------------------------------------

def test_chunks_resist_insertions():
    rng = random.Random(4)
    text = " ".join("".join(rng.choice("abcdefgh") for _ in range(rng.randint(2, 9))) for _ in range(2000))
    a, b = (set(substring_dedup.chunks(pa.array([t]))[3].tolist()) for t in (text, "inserted " + text[:3000] + "more" + text[3000:]))
    assert len(a - b) <= 6
    row, start, stop, _, words, _ = substring_dedup.chunks(pa.array([text, None, "", "x " * 3000]))
    assert sum((stop - start).tolist()) == len(text) + 6000 and words.sum() == 5000 and set(row.tolist()) == {0, 3}


def test_repeats(spark, hard, empty):
    rng = random.Random(6)
    words = lambda n: " ".join("".join(rng.choice("abcdefghijkl") for _ in range(rng.randint(2, 9))) for _ in range(n))
    passages = [words(60) for _ in range(40)]
    rows = [(i, words(80), None) for i in range(200)]
    for k, p in enumerate(passages):
        rows += [(1000 + 2 * k, words(rng.randint(0, 50)) + " " + p + " " + words(30), k), (1001 + 2 * k, words(20) + "\n" + p + words(rng.randint(0, 9)), k)]
    rows += [(5000 + i, "a line that many share and nothing else " + words(60), None) for i in range(50)]
    df = spark.createDataFrame(rows, "doc_id long, text string, k int")
    got = substring_dedup.repeats(df).collect()
    planted = {r[0] for r in rows if r[2] is not None}
    assert {r["doc_id"] for r in got} == planted
    assert all(r["first_doc_id"] in planted and r["removed"] == (r["doc_id"] != r["first_doc_id"]) for r in got)
    out = {r["doc_id"]: r["text"] for r in substring_dedup.without_repeats(df).collect()}
    before = {r[0]: r[1] for r in rows}
    assert len(out) == len(rows) and all(out[d] == before[d] for d in before if d not in planted or d % 2 == 0)
    cut = [len(before[d].split()) - len(out[d].split()) for d in planted if d % 2]
    assert min(cut) > 0 and sum(cut) / len(cut) > 40
    assert substring_dedup.repeats(empty).count() == 0
    ids = {r["doc_id"] for r in substring_dedup.repeats(hard).collect()}
    assert {1, 2, 4} <= ids and 9 not in ids


def test_repeats_recall(spark):
    docs = documents(spark, "/root/testdata/sf0.01")
    seen, hit = {}, set()
    for r in docs.select("doc_id", "text").collect():
        w = r["text"].split()
        for i in range(len(w) - 50):
            first = seen.setdefault(hash(tuple(w[i : i + 51])), r["doc_id"])
            if first != r["doc_id"]:
                hit |= {first, r["doc_id"]}
    got = {r["doc_id"] for r in substring_dedup.repeats(docs).collect()}
    assert hit and len(hit - got) <= 0.01 * len(hit)
