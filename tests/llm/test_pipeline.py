"""The pipeline's stages one after the other on documents whose fate is known."""

import numpy as np
from pyspark.sql import functions as F

import corpus_pipeline
from packlens.llm.common import stash
from packlens.llm.tokens import encoder


def run(spark, docs, sf, upto):
    for name, stage in corpus_pipeline.STAGES[:upto]:
        docs = stash(stage(spark, docs, sf), name.replace(" ", "-"))
    return docs


def test_stages(spark, sf, odd):
    word = lambda i, k: f"word{i}x{k * k % 97}y{k}"
    body = lambda i, n=60: " ".join(word(i, k) for k in range(n))
    item = spark.read.parquet(f"{sf}/benchmark.parquet").orderBy("item_id").first()["text"]
    shared = " ".join(f"shared{k}" for k in range(60))
    rows = [(1, body(1)), (2, body(1)), (3, body(1) + " end"), (4, body(4)), (5, f"{body(5)}!{shared}?{body(55)}"), (6, f"{body(6)}+{shared}={body(66)}")]
    rows += [(7, f"{body(7)} {item} {body(77)}"), (8, "too short"), (9, None), (10, "again and again " * 40)]
    docs = spark.createDataFrame([(i, t, "en", "s", None if t is None else len(t)) for i, t in rows], odd.schema).repartition(3)
    texts = lambda df: {r["doc_id"]: r["text"] for r in df.collect()}
    given = dict(rows)
    assert texts(run(spark, docs, sf, 1)) == {i: given[i] for i in (1, 2, 3, 4, 5, 6, 7)}
    assert texts(run(spark, docs, sf, 2)) == {i: given[i] for i in (1, 4, 5, 6, 7)}
    third = texts(run(spark, docs, sf, 3))
    assert third[5] == f"{body(5)}!?{body(55)}" and third[6] == f"{body(6)}+={body(66)}" and third[1] == body(1)
    fourth = run(spark, docs, sf, 4)
    assert set(texts(fourth)) == {1, 4, 5, 6} and fourth.columns == odd.columns
    pieces = run(spark, docs, sf, 5).orderBy("sequence_id", "offset").collect()
    ids = {}
    for p in pieces:
        ids.setdefault(p["doc_id"], []).append((p["start"], np.frombuffer(p["ids"], "<u4")))
    for doc, text in texts(fourth).items():
        path = corpus_pipeline.public_tokenizers.path("byte_bpe_50k.json")
        want = [*encoder(path).library.encode(text, add_special_tokens=False).ids, 0]
        assert np.concatenate([x for _, x in sorted(ids[doc], key=lambda s: s[0])]).tolist() == want


def test_odd_and_empty(spark, sf, odd, empty):
    assert run(spark, odd, sf, 5).count() > 0
    assert run(spark, empty, sf, 5).collect() == []
    assert run(spark, odd.withColumn("more", F.lit(1)), sf, 4).columns == [*odd.columns, "more"]
