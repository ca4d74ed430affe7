import zlib

import numpy as np
import pytest

from barloom.llm import quality as Q


def test_held_out_labels_are_predicted(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    labels = spark.read.parquet("/root/testdata/sf0.01/labels.parquet")
    found = {r.doc_id: r for r in Q.score_documents(docs, labels).collect()}
    truth = {r.doc_id: r.quality for r in labels.collect()}
    assert len(found) == docs.count()
    assert all(r.held_out == (zlib.crc32(str(d).encode()) % 5 == 0) for d, r in found.items())
    assert all(r.predicted == (r.score >= 0.3) and 0 <= r.score <= 1 for r in found.values())
    good = [found[d].score for d, q in truth.items() if q == 1 and found[d].held_out]
    bad = [found[d].score for d, q in truth.items() if q == 0 and found[d].held_out]
    assert len(bad) >= 5 and np.mean([[g > b for b in bad] for g in good]) > 0.9


def test_edge_cases(spark):
    docs = spark.createDataFrame([(1, None, 5), (1, "a", 5), (None, "", 5), (2, "w " * 20_000, 5)], "doc_id bigint, text string, label int")
    labels = spark.createDataFrame([(1, 1), (1, 0), (2, None), (2, 7)], "doc_id bigint, quality int")
    rows = Q.score_documents(docs, labels).collect()
    assert len(rows) == 4 and all(0 <= r.score <= 1 for r in rows)
    assert [r.held_out for r in rows if r.doc_id is None] == [False]
    assert {r.score for r in Q.score_documents(docs, labels.limit(0)).collect()} == {0.5}
    assert Q.score_documents(docs.limit(0), labels).collect() == []


def test_long_texts_are_pooled_piece_by_piece(monkeypatch):
    rng = np.random.default_rng(0)
    words, rows = rng.normal(size=(Q.ROWS, Q.DIMS)).astype(np.float32), rng.integers(0, Q.ROWS, 1000)
    whole = Q._pool(rows, words)
    monkeypatch.setattr(Q, "POOL_STEP", 37)
    assert Q._pool(rows, words) == pytest.approx(whole, rel=1e-4, abs=1e-5)
    assert not Q._pool(rows[:0], words).any()


def test_temperature_mends_overconfidence():
    rng = np.random.default_rng(0)
    logits = rng.normal(size=5000) * 2
    y = (rng.random(5000) < 1 / (1 + np.exp(-logits))).astype(float)
    assert Q.fit_temperature(logits * 3, y) == pytest.approx(3, rel=0.15)
