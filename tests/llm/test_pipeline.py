"""Each stage's rows against plain code over the rows that the stage before it gave."""

import hashlib
from collections import Counter

import sentencepiece
from pyspark.sql import functions as F

import corpus_pipeline as C
from tessel.llm import langid, mixing, pieces

from .test_lines import brute as brute_lines
from .test_mixing import brute as brute_mix
from .test_simhash import brute_groups

SF = "/root/testdata/sf0.001"


def test_stages_against_plain_code(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    columns, outs = docs.columns, []
    for k, (_, stage) in enumerate(C.STAGES):
        docs = stage(spark, docs, SF)
        if k < len(C.STAGES) - 1:
            assert docs.columns == columns
            docs = spark.createDataFrame(docs.toPandas(), docs.schema)
        outs.append(docs.collect())
    first = spark.read.parquet(f"{SF}/documents.parquet").collect()
    rejected = {r.doc_id for r in langid.identify(spark.read.parquet(f"{SF}/documents.parquet")).collect() if r.rejected}
    assert {r.doc_id for r in outs[0]} == {r.doc_id for r in first} - rejected

    want = brute_lines([(r.doc_id, r.text) for r in outs[0]])
    got = sorted(((r.doc_id, hashlib.sha256((r.text or "").encode()).hexdigest()) for r in outs[1]), key=str)
    assert got == sorted(((i, h) for i, _, _, h in want), key=str)

    roots = brute_groups({r.doc_id: r.text or "" for r in outs[1]})
    assert sorted(r.doc_id for r in outs[2]) == sorted(set(roots.values()))

    rows = [(r.doc_id, r.text, r.lang, r.source) for r in outs[2]]
    assert Counter(r.doc_id for r in outs[3]) == Counter(brute_mix(rows, mixing.WEIGHTS, 90, 1, mixing.SEED))

    lib = sentencepiece.SentencePieceProcessor(model_file=pieces.model_path())
    text = {r.doc_id: r.text or "" for r in outs[3]}
    assert {r.doc_id: r.n_tokens for r in outs[4]} == {i: len(lib.encode(t)) + 1 for i, t in text.items()}
    assert {r.doc_id: r.decoded_sha256 for r in outs[4]} == {i: hashlib.sha256(lib.decode(lib.encode(t)).encode()).hexdigest() for i, t in text.items()}


def test_run_gives_the_last_stage(spark):
    out = C.run(spark, SF)
    assert out.columns[:4] == ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"] and out.count() > 50


def test_columns_of_any_name(spark):
    """Each stage but the last keeps all columns, also those named like what operators use within."""
    extra = ["row", "key", "__lines", "__row_key", "__kept", "k", "__lang", "__p_score", "said", "rejected", "score", "__tokens", "__order", "__copies", "__copy", "copies", "of", "at", "fp", "domain", "a.b", "lost", "h1"]
    docs = spark.read.parquet(f"{SF}/documents.parquet").limit(60)
    for c in extra:
        docs = docs.withColumn(c, F.lit(f"value of {c}"))
    docs = spark.createDataFrame(docs.toPandas(), docs.schema)
    for _, stage in C.STAGES[:-1]:
        out = stage(spark, docs, SF)
        assert out.columns == docs.columns
        rows = out.collect()
        assert rows and all(r[c] == f"value of {c}" for r in rows for c in extra)
    assert stage and C.STAGES[-1][1](spark, docs, SF).count() == 60
