"""The pipeline's stages against brute force, each on what its predecessor kept, and the registered queries on whole tables."""

import hashlib

import corpus_pipeline
from fathomgrid.llm import bpe, mixing, queries, toxicity

from .test_edges import WORD_BPE, brute_fingerprint, brute_substring, words


def test_stages(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet")
    (_, toxic), (_, near), (_, sub), (_, mix), (_, enc) = corpus_pipeline.STAGES
    a = toxic(spark, docs, sf_dir).cache()
    assert a.columns == docs.columns
    bad = {r.doc_id for r in toxicity.score(docs, toxicity.fit(docs, labels), evidence=False).filter("_score >= 0.5").collect()}
    assert {r.doc_id for r in a.collect()} == {r.doc_id for r in docs.collect()} - bad
    b = near(spark, a, sf_dir).cache()
    assert b.columns == docs.columns
    fp = sorted((r.doc_id, brute_fingerprint(r.text)) for r in a.collect())
    label = {i: i for i, _ in fp}
    for _ in range(3):
        for i, f in fp:
            for j, g in fp:
                if (f ^ g).bit_count() <= 2:
                    label[i] = label[j] = min(label[i], label[j])
    assert {r.doc_id for r in b.collect()} == {i for i, c in label.items() if i == c}
    c = sub(spark, b, sf_dir).cache()
    assert c.columns == docs.columns and c.schema["n_chars"].dataType == docs.schema["n_chars"].dataType
    got = sorted((r.doc_id, hashlib.sha256(" ".join(words(r.text)).encode()).hexdigest()) for r in c.collect())
    assert got == sorted((x[0], x[3]) for x in brute_substring([(r.doc_id, r.text) for r in b.collect()]))
    d = mix(spark, c, sf_dir).cache()
    assert d.columns == docs.columns
    times = {r.doc_id: r._times for r in mixing.mix(c).collect()}
    seen = {r.doc_id: r["count"] for r in d.groupBy("doc_id").count().collect()}
    assert seen == {i: t for i, t in times.items() if t}
    e = enc(spark, d, sf_dir).collect()
    texts = {r.doc_id: r.text for r in d.collect()}
    n = bpe.Encoder(WORD_BPE)
    assert len(e) == d.count()
    assert all(r.ids_sha256 == hashlib.sha256(n.encode(texts[r.doc_id] or "")).hexdigest() for r in e)


def test_registered_names():
    assert sorted(int(k[2:].split("_")[0]) for k in queries.QUERIES) == list(range(1, 11))
    assert set(queries.ORACLES) <= set(queries.QUERIES)
