import numpy as np
from samples import MESSY, SMALL, documents
from test_jaccard import plain_classes
from test_repetition import plain_measure

import __spark_entry__
import corpus_pipeline
from staygrid.llm import catalog, packing, toxicity
from staygrid.llm.repetition import Limits
from staygrid.llm.tokens import byte_pairs, default_paths


def plain_pipeline(rows, model):
    clean = []
    for doc, text in rows:
        raw = model.weights[toxicity.grams_of(text or "")].sum() + model.bias
        if 1 / (1 + np.exp(-raw)) < toxicity.THRESHOLD:
            clean.append((doc, text))
    kept = [(d, t) for d, t in clean if plain_measure(t, Limits())["kept"]]
    found = plain_classes([t for _, t in kept])
    least = {}
    for (d, _), c in zip(kept, found, strict=True):
        least[c] = min(d, least.get(c, d))
    return {d: t for (d, t), c in zip(kept, found, strict=True) if least[c] == d}


def test_run_against_plain_stages(spark):
    docs, labels = (spark.read.parquet(f"{SMALL}/{t}.parquet") for t in ("documents", "labels"))
    rows = [(r.doc_id, r.text) for r in docs.collect()]
    stay = plain_pipeline(rows, toxicity.train(docs, labels))
    assert 0.5 * len(rows) < len(stay) < len(rows)
    pieces = corpus_pipeline.run(spark, SMALL).collect()
    encoder = byte_pairs(*default_paths())
    got = {}
    for p in sorted(pieces, key=lambda p: (p.doc_id, p.start)):
        got.setdefault(p.doc_id, []).extend(np.frombuffer(p.ids, "<u4").tolist())
    import pyarrow as pa

    want = dict(zip(stay, encoder.encode(pa.array(list(stay.values()))), strict=True))
    assert got == {d: [*ids.tolist(), packing.SEPARATOR] for d, ids in want.items()}


def test_stages_keep_the_columns_and_survive_odd_tables(spark, tmp_path):
    labels = "doc_id long, quality int, toxic int"
    spark.createDataFrame([(0, 1, 0), (1, 1, 1), (2, None, None)], labels).write.parquet(f"{tmp_path}/labels.parquet")
    for rows in (MESSY, [], [(None, None)]):
        docs = documents(spark, rows)
        for place, (_, stage) in enumerate(corpus_pipeline.STAGES):
            out = stage(spark, docs, str(tmp_path))
            if place + 1 < len(corpus_pipeline.STAGES):
                assert out.columns == docs.columns
            out.collect()


def test_registered_queries():
    names = set(__spark_entry__.queries())
    assert set(catalog.QUERIES) | {"pipeline"} <= names
    for n in range(1, 14):
        assert len([q for q in names if q.startswith(f"op{n}_")]) == 1
