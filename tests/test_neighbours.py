"""Exact neighbours over Voronoi cells against brute force, and on odd vectors."""

import numpy as np
import pytest

from tarnfield.operators import evidence, neighbours

KIND = "object_id long, label int, x array<double>"


def brute(rows, asked, k):
    out = {}
    for q in asked:
        near = sorted((float(np.sqrt(((rows[q] - v) ** 2).sum())), o) for o, v in rows.items() if o != q)[:k]
        out[q] = [(o, round(d, 9)) for d, o in near]
    return out


def table(spark, rows):
    return spark.createDataFrame([(o, o % 3, list(map(float, v))) for o, v in rows.items()], KIND).repartition(3)


def collected(found):
    out = {}
    for r in found.orderBy("query_id", "rank").collect():
        out.setdefault(r["query_id"], []).append((r["object_id"], round(r["distance"], 9)))
    return out


@pytest.mark.parametrize("kind", ["clusters", "grid", "copies"])
def test_equal_to_brute_force(spark, kind, monkeypatch):
    monkeypatch.setattr(neighbours, "PART", 40)  # cells and their queries are dealt in parts
    monkeypatch.setattr(neighbours, "ROWS", 16)
    monkeypatch.setattr(neighbours, "PAIRS", 50)
    r = np.random.default_rng(3)
    if kind == "clusters":
        x = r.normal(size=(300, 4)) + 30 * r.integers(0, 6, (300, 1))
    elif kind == "grid":  # ties throughout
        x = r.integers(0, 4, (300, 3)).astype(float)
    else:  # a third are one vector
        x = np.where(np.arange(300)[:, None] % 3 == 0, 1.0, r.normal(size=(300, 3)))
    rows = dict(enumerate(x))
    frame = table(spark, rows)
    index = neighbours.PivotIndex(cell_rows=20).fit(frame)
    asked = range(0, 300, 4)
    queries = frame.filter("object_id % 4 = 0")
    assert collected(index.query(queries, 7)) == brute(rows, asked, 7)
    if kind == "clusters":
        seen = index.visited(queries, 7).collect()
        assert len(seen) == len(asked) and all(v["visited"] < v["cells"] / 2 for v in seen)


@pytest.mark.parametrize("kind", ["normal", "grid", "copies", "far", "scales", "huge"])
def test_single_precision_leaves_nothing_out(kind, monkeypatch):
    monkeypatch.setattr(neighbours, "SLICE", 128)
    r, n, k = np.random.default_rng(7), 600, 5
    x = r.normal(size=(n, 16))
    if kind == "grid":
        x = r.integers(0, 3, (n, 4)).astype(float)
    elif kind == "copies":
        x[::3] = 1.0
    elif kind == "far":  # single precision can't tell these apart
        x = 1e4 + 1e-3 * x
    elif kind == "scales":
        x *= 10.0 ** r.integers(-8, 13, (n, 1))
    elif kind == "huge":  # beyond single precision
        x *= 1e30
    single, ids, asked = neighbours.rough(x), r.permutation(n), np.arange(0, n, 5)
    assert (single is None) == (kind == "huge")
    apart = np.sqrt(((x[asked][:, None] - x[None]) ** 2).sum(axis=2))
    apart[np.arange(len(asked)), asked] = np.inf
    bound = np.sort(apart, axis=1)[:, 2 * k]
    q, at, d = neighbours.nearest_of(ids[asked], x[asked], ids, x, k, bound, single)
    want = [np.lexsort((ids, row))[:k] for row in apart]
    assert np.array_equal(q, np.repeat(np.arange(len(asked)), k)) and np.array_equal(at, np.concatenate(want))
    assert np.allclose(d, [apart[i, j] for i, own in enumerate(want) for j in own], rtol=1e-12)


def test_slices_go_by_single_precision(monkeypatch):
    r, calls = np.random.default_rng(8), []
    x, ids = r.normal(size=(4096, 16)), np.arange(4096)
    bound = np.sqrt(np.sort(neighbours.squares(x[:64], x), axis=1)[:, 9])
    own = neighbours.squares
    monkeypatch.setattr(neighbours, "squares", lambda a, b: calls.append(len(b)) or own(a, b))
    assert len(neighbours.nearest_of(ids[:64], x[:64], ids, x, 5, bound, neighbours.rough(x))[0]) == 64 * 5
    assert not calls  # no pair's square was taken in double precision


def test_odd_vectors_take_no_part(spark):
    rows = [(1, 0, [0.0, 0.0]), (2, None, [1.0, 0.0]), (3, 1, None), (4, 1, [1.0]), (5, 1, [float("nan"), 0.0]), (6, 1, [None, 0.0]), (7, 2, [0.0, 3.0]), (8, 1, []), (9, 1, [float("inf"), 1.0])]
    frame = spark.createDataFrame(rows, KIND)
    got = evidence.neighbours(frame, frame, 5).orderBy("query_id", "rank").collect()
    assert [(r["query_id"], r["object_id"], r["label"]) for r in got] == [(1, 2, -1), (1, 7, 2), (2, 1, 0), (2, 7, 2), (7, 1, 0), (7, 2, -1)]


def test_nothing_to_find(spark):
    empty, one = spark.createDataFrame([], KIND), spark.createDataFrame([(1, 0, [1.0])], KIND)
    assert evidence.neighbours(one, empty, 3).collect() == [] == evidence.neighbours(empty, one, 3).collect()
    assert evidence.neighbours(one, one, 3).collect() == []
    assert neighbours.PivotIndex().fit(empty).visited(one, 3).collect() == []


def shuffled_rows(spark):
    sc = spark.sparkContext._jsc.sc()
    sc.listenerBus().waitUntilEmpty(30_000)
    stages = sc.statusStore().stageList(None, False, False, spark.sparkContext._gateway.new_array(spark._jvm.double, 0), spark._jvm.java.util.ArrayList())
    return sum(stages.apply(k).shuffleWriteRecords() for k in range(stages.size()))


def test_what_is_shuffled_grows_with_the_rows(spark):
    r, sent = np.random.default_rng(5), []
    for n in (400, 1600):  # four times the rows in four times the cells, nearly all of which are visited
        frame = table(spark, dict(enumerate(r.normal(size=(n, 24))))).cache()
        index = neighbours.PivotIndex(cell_rows=8).fit(frame)
        before = shuffled_rows(spark)
        assert index.query(frame, 3).count() == 3 * n
        sent.append(shuffled_rows(spark) - before)
    assert sent[1] < 5 * sent[0]
