import zlib
from collections import Counter

import numpy as np
import pytest
from samples import MESSY, SMALL, documents

from staygrid.llm import toxicity
from staygrid.llm.toxicity import Model, Sets, fit, grams_of

BIG = "/root/testdata/sf0.1"


def plain_grams(text):
    out = set()
    for word in set(text.lower().split()):
        marked = [ord(c) for c in f" {word} "]
        for size in toxicity.SIZES:
            for k in range(len(marked) - size + 1):
                h = size
                for c in marked[k : k + size]:
                    h = h * 0x01000193 & 0xFFFFFFFF
                    h ^= c * 0x9E3779B1 & 0xFFFFFFFF
                h ^= h >> 15
                out.add((h * 0x9E3779B1 & 0xFFFFFFFF) >> (32 - toxicity.BITS))
    return sorted(out)


def test_grams_against_plain_code():
    for text in [t or "" for _, t in MESSY] + ["a", "A a", "éÉ 😀", "x" * 50]:
        assert grams_of(text).tolist() == plain_grams(text)


def test_fit_separates_and_gradient_vanishes(monkeypatch):
    texts = [f"plain words number {k} here" for k in range(40)] + [f"plain nasty words number {k}" for k in range(40)]
    sets = [grams_of(t) for t in texts]
    bounds = np.concatenate([[0], np.cumsum([len(s) for s in sets])])
    model = fit(Sets(np.concatenate(sets), bounds), [0] * 40 + [1] * 40)
    raw = np.array([model.weights[s].sum() + model.bias for s in sets])
    assert (raw[:40] < 0).all() and (raw[40:] > 0).all()


def test_without_both_classes():
    empty = Sets(np.zeros(0, np.int32), np.zeros(1, np.int64))
    assert fit(empty, []).bias == 0
    assert fit(Sets(grams_of("a b"), np.array([0, len(grams_of("a b"))])), [1]).bias > 6


@pytest.fixture(scope="module")
def model(spark):
    docs, labels = (spark.read.parquet(f"{BIG}/{t}.parquet") for t in ("documents", "labels"))
    return toxicity.train(docs, labels)


def test_held_out_accuracy(spark, model):
    docs, labels = (spark.read.parquet(f"{BIG}/{t}.parquet") for t in ("documents", "labels"))
    rows = toxicity.score(docs, model).join(labels, "doc_id").where("held_out").collect()
    assert all(zlib.crc32(str(r.doc_id).encode()) % 3 == 1 for r in rows)
    toxic = np.array([r.toxic for r in rows])
    score, said = np.array([r.score for r in rows]), np.array([r.predicted for r in rows])
    assert (said[toxic == 0] == 0).mean() > 0.99
    assert toxic[said == 1].mean() > 0.95
    assert said[toxic == 1].mean() > 0.55  # one in three has words of its own kind only, rare in this sample
    assert (score[toxic == 1][:, None] > score[toxic == 0][None, :]).mean() > 0.93


def test_labels_of_held_out_rows_change_nothing(spark):
    from pyspark.sql import functions as F

    docs, labels = (spark.read.parquet(f"{SMALL}/{t}.parquet") for t in ("documents", "labels"))
    turned = labels.withColumn("toxic", F.when(toxicity.held_out(F.col("doc_id")), 1 - F.col("toxic")).otherwise(F.col("toxic")))
    a, b = toxicity.train(docs, labels), toxicity.train(docs.repartition(5), turned.repartition(3))
    assert (a.weights == b.weights).all() and a.bias == b.bias


def test_messy_documents(spark, model):
    got = toxicity.score(documents(spark, MESSY), model).collect()
    want = Counter()
    for doc, text in MESSY:
        raw = model.weights[plain_grams(text or "")].sum() + model.bias
        held = doc is not None and zlib.crc32(str(doc).encode()) % 3 == 1
        p = 1 / (1 + np.exp(-raw))
        want[doc, held, round(float(p), 9), int(p >= 0.7)] += 1
    assert Counter((r.doc_id, r.held_out, round(r.score, 9), r.predicted) for r in got) == want
    assert toxicity.score(documents(spark, []), model).collect() == []


def test_messy_labels(spark):
    schema = "doc_id long, quality int, toxic int"
    labels = spark.createDataFrame([(None, 1, 1), (0, 1, None), (1, 1, 7), (3, 1, 0), (3, 1, 1), (999, 0, 1)], schema)
    assert isinstance(toxicity.train(documents(spark, MESSY), labels), Model)
    nothing = toxicity.train(documents(spark, []), spark.createDataFrame([], schema))
    assert nothing.bias == 0 and not nothing.weights.any()


def test_filter_keeps_columns(spark, model):
    docs = documents(spark, MESSY)
    kept = toxicity.keep_clean(docs, model)
    assert kept.columns == docs.columns
    clean = [r.doc_id for r in toxicity.score(docs, model).where("predicted = 0").collect()]
    assert Counter(r.doc_id for r in kept.collect()) == Counter(clean)
