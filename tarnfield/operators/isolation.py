"""Isolation forest: how few random cuts part a row from the reference.

Each tree takes some hundred reference rows by a hash of their ids, so that one shuffle
deals every tree its own bounded sample and trees grow side by side. A node cuts a
feature that varies in it (the one of the least hash) at a place between its ends (drawn
by hash as well): the forest follows from the rows alone. It is kept as a table of nodes.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tarnfield.operators import protocol
from tarnfield.sources import stages

#: How many times the rows that all trees take together pass the first draw.
SPARE = 4
ROWS = 4096
EULER = 0.5772156649015329


def unit(key: str) -> float:
    """The number in [0, 1) that protocol.draw gives for a key with its seed in front."""
    return int(hashlib.md5(key.encode()).hexdigest()[:8], 16) / float(1 << 32)


def expected_path(n: np.ndarray | float) -> np.ndarray:
    """Mean path length of an unsuccessful search among n rows."""
    n = np.asarray(n, float)
    some = np.maximum(n, 3)
    return np.where(n <= 1, 0.0, np.where(n == 2, 1.0, 2 * (np.log(some - 1) + EULER) - 2 * (some - 1) / some))


def grown(x: np.ndarray, tree: int, limit: int, seed: int) -> list[tuple[int, int, int, float | None, int | None]]:
    """(node, depth, size, value, feature) in heap order; leaves have no value. Rows at or
    above the value go to node 2 k + 2, the others to 2 k + 1."""
    out, todo = [], [(0, 0, np.arange(len(x)))]
    while todo:
        node, depth, rows = todo.pop()
        low, high = (x[rows].min(axis=0), x[rows].max(axis=0)) if len(rows) else (np.zeros(x.shape[1]),) * 2
        varies = np.nonzero(high > low)[0]
        if depth >= limit or len(rows) < 2 or not len(varies):
            out.append((node, depth, len(rows), None, None))
            continue
        feature = min(varies.tolist(), key=lambda f: hashlib.md5(f"iso-{seed}:{tree}|{node}|{f}".encode()).hexdigest())
        value = float(low[feature] + unit(f"iso-{seed}:{tree}|{node}") * (high[feature] - low[feature]))
        right = x[rows, feature] >= value
        out.append((node, depth, len(rows), value, feature))
        todo += [(2 * node + 1, depth + 1, rows[~right]), (2 * node + 2, depth + 1, rows[right])]
    return out


class IsolationForest:
    """``fit`` and ``score`` take object_id and the features; missing values count as 0."""

    def __init__(self, features: list[str], trees: int = 100, sample: int = 256, seed: int = 42) -> None:
        self.features, self.trees, self.sample, self.seed = list(features), trees, sample, seed

    def _x(self, rows: DataFrame) -> DataFrame:
        return rows.select("object_id", F.array(*(F.coalesce(F.col(f).cast("double"), F.lit(0.0)) for f in self.features)).alias("x"))

    def fit(self, reference: DataFrame) -> IsolationForest:
        rows = self._x(reference)
        n = rows.count()
        if not n:
            raise ValueError("no reference rows")
        self.size = min(self.sample, n)
        limit, seed = math.ceil(math.log2(max(self.size, 2))), self.seed
        share = min(1.0, self.size / n)
        some = min(1.0, SPARE * self.trees * share)
        drawn = rows.filter(protocol.draw(F.col("object_id"), f"iso-{seed}") < some)
        own = F.filter(F.sequence(F.lit(0), F.lit(self.trees - 1)), lambda t: protocol.draw(F.concat_ws("|", "object_id", t), f"iso-{seed}") < share / some)
        drawn = drawn.select("x", F.explode(own).alias("tree"))
        width = len(self.features)

        def grow(table: pa.Table) -> pa.Table:
            tree = table["tree"][0].as_py()
            x = np.asarray(table["x"].combine_chunks().flatten().to_numpy(zero_copy_only=False), float).reshape(-1, width)
            rows = grown(x, tree, limit, seed)
            kinds = (pa.int64(), pa.int64(), pa.int64(), pa.float64(), pa.int64())
            return pa.table({"tree": pa.array([tree] * len(rows), pa.int64()), **{name: pa.array([r[k] for r in rows], kinds[k]) for k, name in enumerate(("node", "depth", "size", "value", "feature"))}})

        self.nodes = stages.written(drawn.groupBy("tree").applyInArrow(grow, "tree long, node long, depth long, size long, value double, feature long"))
        heap = (1 << (limit + 1)) - 1
        self.table = {"feature": np.zeros((self.trees, heap), np.int32), "value": np.full((self.trees, heap), np.nan), "length": np.zeros((self.trees, heap))}
        self.grown = np.zeros(self.trees, bool)
        for r in self.nodes.collect():  # trees times 2 * sample at most
            self.grown[r["tree"]] = True
            if r["value"] is None:
                self.table["length"][r["tree"], r["node"]] = r["depth"] + float(expected_path(r["size"]))
            else:
                self.table["feature"][r["tree"], r["node"]], self.table["value"][r["tree"], r["node"]] = r["feature"], r["value"]
        self.limit = limit
        return self

    def score(self, rows: DataFrame) -> DataFrame:
        """object_id, isolation: 2 to the power of minus the mean path over the expected one."""
        feature, value, length = self.table["feature"], self.table["value"], self.table["length"]
        trees, limit, scale = np.nonzero(self.grown)[0], self.limit, float(expected_path(self.size)) or 1.0

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                x = np.asarray(batch.column(1).flatten().to_numpy(zero_copy_only=False), float).reshape(batch.num_rows, -1)
                total = np.zeros(batch.num_rows)
                every = np.arange(batch.num_rows)
                for t in trees:
                    node = np.zeros(batch.num_rows, np.int64)
                    for _ in range(limit):
                        cut = value[t][node]
                        inner = ~np.isnan(cut)
                        right = x[every, feature[t][node]] >= cut
                        node = np.where(inner, 2 * node + 1 + right, node)
                    total += length[t][node]
                yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(np.power(2.0, -total / max(len(trees), 1) / scale))], names=["object_id", "isolation"])

        return self._x(rows).mapInArrow(run, f"object_id {rows.schema['object_id'].dataType.simpleString()}, isolation double")
