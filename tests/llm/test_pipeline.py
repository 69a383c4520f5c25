"""The pipeline stage by stage against brute force, and run() against the stages."""

import base64
import hashlib
import struct

import brute
import public_tokenizers
import pytest
from conftest import prose
from pyspark.sql import functions as F

import corpus_pipeline
from gridloom.llm import source_mix

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


@pytest.fixture(scope="module")
def folder(spark, rows, tmp_path_factory):
    path = tmp_path_factory.mktemp("sf")
    kept = [(d, t, lang, s, len(t or "")) for d, t, lang, s in dict((r[0], r) for r in rows if r[0] is not None).values()]
    import random

    rng = random.Random(3)
    # Another script: no learned language has its letters.
    kept += [(900, "это не тот язык", None, "a", 1), (901, "12345 67", "en", "b", 1), (902, prose(rng, "en", 40), "en", "c", 1)]
    spark.createDataFrame(kept, "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{path}/documents.parquet")
    return str(path)


@pytest.fixture(scope="module")
def stages(spark, folder, tmp_path_factory):
    """Each stage's result, written and read again."""
    docs, out = spark.read.parquet(f"{folder}/documents.parquet"), []
    for k, (_, stage) in enumerate(corpus_pipeline.STAGES):
        path = str(tmp_path_factory.mktemp("stage") / str(k))
        stage(spark, docs, folder).write.parquet(path)
        docs = spark.read.parquet(path)
        out.append(docs)
    return out


def pairs(df):
    return [(r.doc_id, r.text) for r in df.collect()]


def test_stages(spark, folder, stages):
    assert all(s.columns == COLUMNS for s in stages[:-1])
    first = pairs(spark.read.parquet(f"{folder}/documents.parquet"))
    after = pairs(stages[0])
    gone = {d for d, _ in first} - {d for d, _ in after}
    assert gone == {d for d, t in first if not any(c.isascii() and c.isalpha() for c in t or "")}
    assert sorted(d for d, _ in pairs(stages[1])) == sorted(d for d, _, _, kept, _ in brute.exact(after) if kept)
    assert sorted(d for d, _ in pairs(stages[2])) == sorted(d for d, _, c in brute.near(pairs(stages[1])) if d == c)


def test_mix_stage(stages):
    before = stages[2]
    taken = {r.doc_id: (r["size"], r.taken) for r in source_mix.mix(before).collect()}
    want = {d: int(t / s + 0.5) for d, (s, t) in taken.items() if s}
    got = {r.doc_id: r["count"] for r in stages[3].groupBy("doc_id").count().collect()}
    assert got == {d: n for d, n in want.items() if n} and max(got.values()) <= 3


def test_stages_release_memory(spark, folder):
    """Each stage starts with a full collection of the executors' heap and with small batches for Python."""
    beans = spark._jvm.java.lang.management.ManagementFactory.getGarbageCollectorMXBeans()
    # The collector of the old generation is the last one.
    full, batch = beans[len(beans) - 1], "spark.sql.execution.arrow.maxRecordsPerBatch"
    docs, before = spark.read.parquet(f"{folder}/documents.parquet").limit(0), spark.conf.get(batch)
    try:
        for _, stage in corpus_pipeline.STAGES:
            spark.conf.set(batch, "10000")
            n = full.getCollectionCount()
            stage(spark, docs, folder)
            assert full.getCollectionCount() > n and spark.conf.get(batch) == "1000"
        spark.conf.set(batch, "10")
        corpus_pipeline.STAGES[-1][1](spark, docs, folder)
        assert spark.conf.get(batch) == "10"
    finally:
        spark.conf.set(batch, before)


def test_encoding_and_run(spark, folder, stages):
    import tiktoken

    path = public_tokenizers.path("byte_bpe_multi_50k.tiktoken")
    ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, open(path, "rb"))}
    encode = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={}).encode_ordinary
    want = []
    for d, t in pairs(stages[3]):
        ids = encode(t)
        want.append((d, len(ids), hashlib.sha256(struct.pack(f"<{len(ids)}I", *ids)).hexdigest(), brute.sha(t)))
    assert sorted(map(tuple, stages[4].collect())) == sorted(want)
    assert sorted(map(tuple, corpus_pipeline.run(spark, folder).collect())) == sorted(want)
    assert stages[4].where(F.col("n_tokens") < 1).count() == 0
