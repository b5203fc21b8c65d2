import collections

import corpus_pipeline
from sleuthwork.llm import decontaminate, mixing, near_dedup, token_output
from tests.llm.test_ops import brute_components, brute_hits


def test_stages(spark, hard):
    d = "/root/testdata/sf0.001"
    names = [n for n, _ in corpus_pipeline.STAGES]
    assert names == ["language_id", "near_dedup", "decontamination", "mixing", "token_output"]
    items = [(str(r["item_id"]), r["text"]) for r in spark.read.parquet(f"{d}/benchmark.parquet").collect()]
    filler = " ".join(f"plain{i} wording{i}" for i in range(60))
    planted = [(900001, f"{filler} {items[0][1]} {filler} one", "en", "s1"), (900002, f"{filler} {' '.join(items[1][1].split()[2:12])} two", "en", "s1"), (900003, f"{filler} three three three {' '.join(items[2][1].split()[:7])} nothing", "en", "s1")]
    more = spark.createDataFrame([(i, t + f" only {i} " * 40, g, o, len(t), 7, "v") for i, t, g, o in planted], hard.schema)
    # Extra columns with clashing names stay.
    docs = spark.read.parquet(f"{d}/documents.parquet").unionByName(hard.unionByName(more), allowMissingColumns=True)
    columns = docs.columns
    told = corpus_pipeline.identify_language(spark, docs, d)
    want = [r for r in docs.collect() if r["text"] is not None and any(c.isalpha() for c in r["text"])]
    assert told.columns == columns and collections.Counter(map(tuple, told.collect())) == collections.Counter(map(tuple, want))
    single = corpus_pipeline.drop_near_duplicates(spark, told, d)
    rows = [(r["doc_id"], r["text"]) for r in told.collect()]
    kept = {(i, c) for (i, _, c), _ in brute_components(rows).items() if i == c}
    assert single.columns == columns and {r["doc_id"] for r in single.collect()} - {None} == {i for i, _ in kept} - {None}
    clean = corpus_pipeline.decontaminate_benchmark(spark, single, d)
    small = [r for r in single.collect() if len(r["text"]) < 4000]
    bad = {r["doc_id"] for r in small if brute_hits(r["text"], items)[2]}
    assert {900001, 900002} <= bad and 900003 not in bad and len(bad) > 3 and decontaminate.WINDOW == 8
    assert clean.columns == columns and {r["doc_id"] for r in small} - bad <= {r["doc_id"] for r in clean.collect()} and not bad & {r["doc_id"] for r in clean.collect()}
    mix = corpus_pipeline.mix_sources(spark, clean, d)
    assert mix.columns == columns and {r["doc_id"] for r in mix.collect()} <= {r["doc_id"] for r in clean.collect()}
    out = corpus_pipeline.write_tokens(spark, mix, d)
    enc = token_output.encoder(token_output.vocabulary())
    assert collections.Counter((r["doc_id"], r["n_tokens"]) for r in out.collect()) == collections.Counter((r["doc_id"], len(enc.whole(r["text"])) + 1) for r in mix.collect())
    assert mixing.BLOCK and near_dedup.HALVES
    gone = docs.limit(0)
    for _, stage in corpus_pipeline.STAGES:
        gone = stage(spark, gone, d)
        assert gone.count() == 0


def test_run(spark):
    assert corpus_pipeline.run(spark, "/root/testdata/sf0.001").columns == ["doc_id", "start", "n_tokens", "ids_crc32"]
