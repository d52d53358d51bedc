"""The isolation forest: its trees, its order of outliers, its bounded samples."""

import numpy as np
import pytest

from tarnfield.operators import isolation


def test_paths_and_trees():
    assert isolation.expected_path([0, 1, 2]).tolist() == [0.0, 0.0, 1.0] and abs(isolation.expected_path(256) - 10.244770920116851) < 1e-9
    x = np.random.default_rng(1).normal(size=(100, 3))
    nodes = {n[0]: n for n in isolation.grown(x, 3, 5, 42)}
    assert sum(n[2] for n in nodes.values() if n[3] is None) == 100
    for node, depth, size, value, feature in nodes.values():
        if value is not None:
            assert nodes[2 * node + 1][2] + nodes[2 * node + 2][2] == size and depth < 5
    assert isolation.grown(np.ones((9, 2)), 0, 5, 42) == [(0, 0, 9, None, None)]


def test_outliers_come_first_and_samples_are_bounded(spark):
    from pyspark.sql import functions as F

    r = np.random.default_rng(2)
    x = np.vstack([r.normal(size=(1500, 2)), [[9.0, -9.0], [0.0, 12.0]]])
    frame = spark.createDataFrame([(k, float(a), None if k == 3 else float(b)) for k, (a, b) in enumerate(x)], "object_id long, a double, b double").repartition(3)
    forest = isolation.IsolationForest(["a", "b"], trees=100).fit(frame)
    got = forest.score(frame).orderBy(F.desc("isolation")).collect()
    assert len(got) == 1502 and {1500, 1501} <= {g.object_id for g in got[:10]} and all(0 < g.isolation < 1 for g in got)
    sizes = forest.nodes.filter("node = 0").select("size").collect()
    assert len(sizes) == 100 and max(s["size"] for s in sizes) < 340
    again = {g.object_id: g.isolation for g in isolation.IsolationForest(["a", "b"], trees=100).fit(frame.repartition(7)).score(frame).collect()}
    assert again == {g.object_id: g.isolation for g in got}


def test_empty_reference(spark):
    frame = spark.createDataFrame([], "object_id long, a double")
    with pytest.raises(ValueError):
        isolation.IsolationForest(["a"]).fit(frame)
