import zlib

import numpy as np
import pytest

from tamarack.llm import mil_quality as Q
from tests.llm.test_quality_rules import corpus, frames


def test_passages_cover_whole_texts(monkeypatch):
    monkeypatch.setattr(Q, "PASSAGES_AT_ONCE", 3)
    for n in (0, 1, 511, 512, 513, 5000):
        text = "".join(chr(97 + k % 26) for k in range(n))
        parts = [(b, m) for b, m in Q.passages(text)]
        assert "".join(chr(c) for b, m in parts for row, k in zip(b, m, strict=True) for c in row[:k]) == text
    x = np.concatenate([Q.features(*p) for p in Q.passages("aB3 " * 900)])
    assert x.shape == (8, Q.INPUTS) and np.allclose((x[:, : Q.CLASSES**3] ** 2).sum(1), 1, atol=1e-5)


def test_gradients_match_differences():
    rng = np.random.default_rng(3)
    shapes = {"W": (Q.INPUTS, 4), "b": (4,), "V": (4, 3), "U": (4, 3), "g": (3,), "c": (4,), "d": (1,)}
    w = {k: rng.standard_normal(s) * 0.3 for k, s in shapes.items()}
    bags, y = [rng.random((n, Q.INPUTS)) * 0.1 for n in (1, 3, 2)], np.array([1.0, 0.0, 1.0])

    def loss(w):
        total = 0.0
        for bag, label in zip(bags, y, strict=True):
            h, logit = Q.Model(w).encode(bag)
            a = np.exp(logit) / np.exp(logit).sum()
            z = (a @ h) @ w["c"] + w["d"][0]
            total += np.log1p(np.exp(z)) - label * z
        return total / len(bags)

    grads = Q._gradients(w, [b.astype(np.float64) for b in bags], y)
    for k, v in w.items():
        at = tuple(0 for _ in v.shape)
        moved = {j: u.copy() for j, u in w.items()}
        moved[k][at] += 1e-4
        up = loss(moved)
        moved[k][at] -= 2e-4
        assert grads[k][at] == pytest.approx((up - loss(moved)) / 2e-4, rel=0.02, abs=2e-5), k


def test_held_out_accuracy_and_edges(spark):
    rows = corpus(2, 500)
    docs, labels = frames(spark, rows, lambda i: True)
    model = Q.train(docs, labels, epochs=6)
    got = {r.doc_id: r for r in Q.apply(docs, model, columns=["doc_id"]).collect()}
    assert all(r.held_out == (zlib.crc32(str(i).encode()) % 5 == 0) for i, r in got.items())
    assert np.mean([got[i].predicted == y for i, _, y in rows if got[i].held_out]) > 0.97
    odd = spark.createDataFrame([(1, None), (2, ""), (2, ""), (None, "some words here"), (4, "a b " * 400_000)], "doc_id long, text string")
    found = Q.apply(odd, model).collect()
    assert found[0].score == found[1].score == found[2].score and all(0 <= r.score <= 1 for r in found)
    assert found[3].held_out is True and found[4].passages == 3125 and 0 < found[4].top_attention <= 1
    assert Q.apply(odd.limit(0), model).count() == 0
    assert [r.score for r in Q.apply(odd, None).collect()] == [0.5] * 5
    assert Q.apply(odd.selectExpr("*", "text AS Score"), model).columns[2:5] == ["Score", "held_out", "score_"]


def test_never_learns_from_fold_zero(spark):
    rows = corpus(4, 500)
    docs, labels = frames(spark, [(i, t, y if zlib.crc32(str(i).encode()) % 5 else 1 - y) for i, t, y in rows], lambda i: True)
    good, _ = frames(spark, rows, lambda i: True)
    got = Q.apply(good, Q.train(docs, labels), columns=["doc_id"]).collect()
    truth = {i: y for i, _, y in rows}
    assert np.mean([r.predicted == truth[r.doc_id] for r in got]) > 0.95
