"""Refined histograms against sorting every combination."""

import numpy as np
import pytest

from tarnfield.plans import search


def brute(score, y):
    pos, neg = score[y == 1], score[y == 0]
    if not len(pos) or not len(neg):
        return None, None
    diff = pos[:, None] - neg[None, :]
    tp = np.array([(pos >= v).sum() for v in pos])
    fp = np.array([(neg >= v).sum() for v in pos])
    return ((diff > 0) + 0.5 * (diff == 0)).mean(), (tp / (tp + fp)).mean()


@pytest.mark.parametrize("kind", ["smooth", "ties", "rare", "one class", "wide"])
def test_all_combinations(spark, kind, monkeypatch):
    monkeypatch.setattr(search, "ROWS", 50)
    monkeypatch.setattr(search, "HELD", 500)
    r = np.random.default_rng(4)
    x = r.random((300, 3)) if kind != "ties" else r.integers(0, 3, (300, 3)) / 2
    if kind == "wide":
        x = (x - 0.5) * 80
    y = (r.random(300) < (0.02 if kind == "rare" else 0.3)).astype(int) if kind != "one class" else np.ones(300, int)
    grid = {"a": (1.0,), "b": (0.0, 0.3), "c": (0.1, 0.5, 2.0)}
    frame = spark.createDataFrame([(k, int(y[k]), *map(float, x[k])) for k in range(300)], "object_id long, y int, a double, b double, c double").repartition(3)
    got = {v.combo: v for v in search.search(frame, grid).collect()}
    combos = search.combinations(grid)
    assert sorted(got) == list(range(6)) == list(range(len(combos)))
    for k, w in enumerate(combos):
        score = np.floor(sum(x[:, i] * w[c] for i, c in enumerate("abc")) * 1e9 + 0.5)
        auc, ap = brute(score, y)
        assert got[k].n_pos == y.sum() and got[k].n_neg == (1 - y).sum()
        assert (got[k].roc_auc, got[k].average_precision) == (None, None) if auc is None else np.allclose((got[k].roc_auc, got[k].average_precision), (auc, ap))


def test_bins_without_positives_stay_closed(spark):
    frame = spark.createDataFrame([(k, int(k > 995), k / 1000) for k in range(1000)], "object_id long, y int, a double")
    row = search.search(frame, {"a": (1.0,)}).first()
    assert (row.roc_auc, row.average_precision, row.n_pos, row.n_neg) == (1.0, 1.0, 4.0, 996.0)
