"""Known-class probabilities by gradient-boosted trees over binned features.

Every level of a round is one aggregation for all classes and folds: tasks sum
gradients and curvatures by (fold, class, node, feature, bin), a shuffle by fold, class
and block of features adds these up and keeps each node's best split. What comes to the
driver is one candidate for each node and block. A fold's model never sees its own rows,
but scores them on the way, so the out-of-fold probabilities are there at the end.

Features are binned at quantiles of all rows; a missing value has a bin of its own, left
of all others. Scores of a few rounds are kept as trees and added up again in each pass;
every KEEP rounds they are written, which cuts the lineage.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tarnfield.operators import evidence, protocol
from tarnfield.sources import stages

#: Rounds between two written tables, features that one task of the shuffle looks at.
KEEP, BLOCK = 8, 64
#: Rows of a pass that are held as matrices at once.
ROWS = 4096


class Tree:
    """A binary tree of fixed depth in heap order: node k has children 2k + 1 and 2k + 2.
    A row goes right where its bin is greater than the node's; unsplit nodes send all left."""

    def __init__(self, depth: int) -> None:
        n = (1 << depth) - 1
        self.feature, self.bin = np.zeros(n, np.int32), np.full(n, 255, np.int32)
        self.value = np.zeros(1 << depth)

    def node_of(self, bins: np.ndarray, depth: int) -> np.ndarray:
        """The node of each row ``depth`` levels below the root, from 0 within that level."""
        at = np.zeros(len(bins), np.int64)
        rows = np.arange(len(bins))
        for level in range(depth):
            heap = at + (1 << level) - 1
            at = 2 * at + (bins[rows, self.feature[heap]] > self.bin[heap])
        return at


def best_splits(hist: np.ndarray, l2: float, least_rows: int) -> list[tuple[float, int, int, np.ndarray]]:
    """For each node of ``hist`` (node, feature, bin, (gradient, curvature, rows)) the best
    (gain, feature, bin, left sums); gain is -1 where nothing can be split."""
    total = hist.sum(axis=2)  # the same for every feature
    left = hist.cumsum(axis=2)[:, :, :-1]
    right = total[:, :, None] - left

    def worth(s: np.ndarray) -> np.ndarray:
        return s[..., 0] ** 2 / (s[..., 1] + l2)

    gain = worth(left) + worth(right) - worth(total)[:, :, None]
    gain[(left[..., 2] < least_rows) | (right[..., 2] < least_rows)] = -1.0
    gain = np.round(gain, 9)  # sums in other orders differ in their last bits
    flat = gain.reshape(len(hist), -1)
    at = flat.argmax(axis=1)
    feature, cut = at // gain.shape[2], at % gain.shape[2]
    return [(float(flat[n, at[n]]), int(feature[n]), int(cut[n]), left[n, feature[n], cut[n]]) for n in range(len(hist))]


class BoostedPrior:
    """``fit`` takes object_id, label (any integers) and the features; labels' places in
    rising order are the places of their probabilities.

    Classes weigh the same in total (with a ``weight`` column, on top of it). A class of
    fewer rows than folds lowers the number of folds, to two at least. ``columns`` is the
    share of features that a round may split on."""

    def __init__(self, features: list[str], n_folds: int = 3, rounds: int = 24, depth: int = 3, rate: float = 0.2, bins: int = 32, least_rows: int = 5, l2: float = 1.0, columns: float = 1.0, seed: int = 42) -> None:
        if not 2 <= bins <= 254:
            raise ValueError("2 to 254 bins")
        self.features, self.n_folds, self.rounds, self.depth, self.rate = list(features), n_folds, rounds, depth, rate
        self.bins, self.least_rows, self.l2, self.columns, self.seed = bins, least_rows, l2, columns, seed
        self.forest: list[list[list[Tree]]] = []  # by round, fold, class

    def __getstate__(self) -> dict:
        """What tasks need: the fitted numbers without the tables."""
        return {k: v for k, v in self.__dict__.items() if not isinstance(v, DataFrame)}

    # -- binning

    def _binned(self, rows: DataFrame, keep: list[str]) -> DataFrame:
        edges = self.edges

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                n = batch.num_rows
                x = np.asarray(batch.column(len(keep)).flatten().to_numpy(zero_copy_only=False), float).reshape(n, len(edges)) if n else np.zeros((0, len(edges)))
                out = np.zeros((n, len(edges)), np.uint8)
                for f, e in enumerate(edges):
                    out[:, f] = np.where(np.isnan(x[:, f]), 0, 1 + np.searchsorted(e, x[:, f], "right"))
                yield pa.RecordBatch.from_arrays([*batch.columns[: len(keep)], pa.array([r.tobytes() for r in out], pa.binary())], names=[*keep, "bins"])

        kinds = ", ".join(f"`{c}` {rows.schema[c].dataType.simpleString()}" for c in keep)
        return rows.select(*keep, F.array(*(F.col(f).cast("double") for f in self.features)).alias("_x")).mapInArrow(run, f"{kinds}, bins binary")

    # -- passes

    def _scores(self, bins: np.ndarray, start: np.ndarray, rounds: list[list[list[Tree]]]) -> np.ndarray:
        out = start.copy()
        for trees in rounds:
            for fold, own in enumerate(trees):
                for cls, tree in enumerate(own):
                    out[:, fold, cls] += self.rate * tree.value[tree.node_of(bins, self.depth)]
        return out

    def _blocks(self, batch: pa.RecordBatch, first: int) -> Iterator[tuple[slice, np.ndarray, np.ndarray]]:
        """(rows, bins, scores) of a batch whose columns from ``first`` on are bins and scores."""
        n_f, shape = len(self.features), (-1, self.n_folds, len(self.labels))
        for a in range(0, batch.num_rows, ROWS):
            part = batch.slice(a, ROWS)
            bins = np.frombuffer(b"".join(part.column(first).to_pylist()), np.uint8).reshape(-1, n_f)
            yield slice(a, a + part.num_rows), bins, np.frombuffer(b"".join(part.column(first + 1).to_pylist()), "<f8").reshape(shape)

    def _level(self, state: DataFrame, recent: list, trees: list[list[Tree]], level: int, usable: np.ndarray) -> dict:
        """Best split of every (fold, class, node) of a level: (gain, feature, bin, left sums, all sums)."""
        folds, classes, nodes, n_bins, model = self.n_folds, len(self.labels), 1 << level, self.bins + 1, self
        blocks = [usable[k : k + BLOCK] for k in range(0, len(usable), BLOCK)]

        def sums(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            hist = np.zeros((folds, classes, nodes, len(usable), n_bins, 3))
            for batch in batches:
                label, weight, fold = (batch.column(k).to_numpy(zero_copy_only=False) for k in range(3))
                for at, bins, start in model._blocks(batch, 3):
                    raw = model._scores(bins, start, recent)
                    p = np.exp(raw - raw.max(axis=2, keepdims=True))
                    p /= p.sum(axis=2, keepdims=True)
                    y = label[at][:, None] == np.arange(classes)[None]
                    for f in range(folds):
                        own = fold[at] != f
                        w = weight[at][own][:, None]
                        grad, curve = w * (p[own, f] - y[own]), w * p[own, f] * (1 - p[own, f]) * classes / max(classes - 1, 1)
                        mine = bins[own][:, usable].astype(np.int64)
                        for c in range(classes):
                            node = trees[f][c].node_of(bins[own], level)
                            cell = (node[:, None] * len(usable) + np.arange(len(usable))) * n_bins + mine
                            for k, v in enumerate((grad[:, c], curve[:, c], np.ones(len(node)))):
                                hist[f, c, ..., k] += np.bincount(cell.ravel(), np.repeat(v, len(usable)), nodes * len(usable) * n_bins).reshape(nodes, len(usable), n_bins)
            keys, blobs = [], []
            for f in range(folds):
                for c in range(classes):
                    for b in range(len(blocks)):
                        keys.append((f, c, b))
                        blobs.append(hist[f, c, :, b * BLOCK : b * BLOCK + BLOCK].tobytes())
            yield pa.RecordBatch.from_arrays([*(pa.array([k[i] for k in keys], pa.int32()) for i in range(3)), pa.array(blobs, pa.binary())], names=["fold", "cls", "block", "hist"])

        def best(table: pa.Table) -> pa.Table:
            f, c, b = (table.column(k)[0].as_py() for k in range(3))
            shape = (nodes, len(blocks[b]), n_bins, 3)
            hist = np.zeros(shape)
            for blob in table.column(3).to_pylist():
                hist += np.frombuffer(blob).reshape(shape)
            found = best_splits(hist, model.l2, model.least_rows)
            total = hist[:, 0].sum(axis=1)
            return pa.table({"fold": [f] * nodes, "cls": [c] * nodes, "node": list(range(nodes)), "gain": [x[0] for x in found], "feature": [int(blocks[b][x[1]]) for x in found], "bin": [x[2] for x in found], "left": [x[3].tolist() for x in found], "total": [t.tolist() for t in total]})

        partial = state.select("label_at", "weight", "fold", "bins", "scores").mapInArrow(sums, "fold int, cls int, block int, hist binary")
        found = partial.groupBy("fold", "cls", "block").applyInArrow(best, "fold long, cls long, node long, gain double, feature long, bin long, left array<double>, total array<double>")
        out: dict = {}
        for r in found.collect():  # a row for each fold, class, node and block of features
            key, own = (r["fold"], r["cls"], r["node"]), (r["gain"], -r["feature"], r["bin"], r["left"], r["total"])
            if key not in out or own[:2] > out[key][:2]:
                out[key] = own
        return out

    def _round(self, state: DataFrame, recent: list, number: int) -> list[list[Tree]]:
        n = len(self.features)
        usable = np.sort(np.random.default_rng((self.seed, number)).permutation(n)[: max(1, round(self.columns * n))])
        trees = [[Tree(self.depth) for _ in self.labels] for _ in range(self.n_folds)]
        for level in range(self.depth):
            for (f, c, node), (gain, feature, cut, left, total) in self._level(state, recent, trees, level, usable).items():
                tree, heap = trees[f][c], node + (1 << level) - 1
                left = np.array(left if gain > 0 else total)
                if gain > 0:
                    tree.feature[heap], tree.bin[heap] = -feature, cut
                if level == self.depth - 1:
                    for side, s in enumerate((left, np.array(total) - left)):
                        tree.value[2 * node + side] = -s[0] / (s[1] + self.l2)
        return trees

    def fit(self, rows: DataFrame) -> BoostedPrior:
        counts = {r["label"]: r["n"] for r in rows.groupBy("label").agg(F.count(F.lit(1)).alias("n")).collect()}  # a row for each class
        self.labels = sorted(counts)
        if len(self.labels) < 2:
            raise ValueError("at least two classes are needed")
        self.n_folds = max(2, min(self.n_folds, min(counts.values())))
        shares = [i / self.bins for i in range(1, self.bins)]
        found = rows.stat.approxQuantile(self.features, shares, 0.25 / self.bins)
        self.edges = [np.unique(np.array(q, float)) for q in found]
        total = sum(counts.values())
        place = F.create_map(*(F.lit(v) for k, c in enumerate(self.labels) for v in (c, k)))
        balance = F.create_map(*(F.lit(v) for c in self.labels for v in (c, total / (len(self.labels) * counts[c]))))
        own = F.greatest(F.least(F.coalesce(F.col("weight"), F.lit(1.0)), F.lit(20.0)), F.lit(1e-3)) if "weight" in rows.columns else F.lit(1.0)
        dealt = protocol.folds(rows, "label", self.n_folds, f"boost-{self.seed}").withColumns({"label_at": place[F.col("label")].cast("int"), "weight": balance[F.col("label")] * own})
        zeros = F.lit(bytes(8 * self.n_folds * len(self.labels)))
        state = stages.written(self._binned(dealt, ["object_id", "label", "label_at", "weight", "fold"]).withColumn("scores", zeros))
        self.forest, recent = [], []
        for number in range(self.rounds):
            trees = self._round(state, recent, number)
            self.forest.append(trees)
            recent.append(trees)
            if len(recent) == KEEP or number == self.rounds - 1:
                old, state = state, stages.written(self._added(state, recent))
                stages.drop(old)
                recent = []
        self.state = state
        at = F.col("fold")
        width = len(self.labels)
        self.out_of_fold = self._softmax(state.select("object_id", "label", "label_at", "fold", "scores"), ["object_id", "label", "label_at"], lambda p, fold: p[np.arange(len(p)), fold], at)
        self.centroids = evidence.centroids(self.out_of_fold.select(F.col("label_at").alias("label"), "p"), width)
        return self

    def _added(self, state: DataFrame, recent: list) -> DataFrame:
        model = self
        keep = [c for c in state.columns if c not in ("bins", "scores")]

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                out = [raw.tobytes() for _, bins, start in model._blocks(batch, len(keep)) for raw in model._scores(bins, start, recent)]
                yield pa.RecordBatch.from_arrays([*batch.columns[:-1], pa.array(out, pa.binary())], names=batch.schema.names)

        return state.select(*keep, "bins", "scores").mapInArrow(run, ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in state.select(*keep, "bins", "scores").schema))

    def _softmax(self, rows: DataFrame, keep: list[str], pick, fold=None) -> DataFrame:
        shape = (-1, self.n_folds, len(self.labels))
        fold = F.lit(0) if fold is None else fold

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                raw = np.frombuffer(b"".join(batch.column(len(keep) + 1).to_pylist()), "<f8").reshape(shape)
                p = np.exp(raw - raw.max(axis=2, keepdims=True)) if len(raw) else raw
                p = p / p.sum(axis=2, keepdims=True)
                p = pick(p, batch.column(len(keep)).to_numpy(zero_copy_only=False))
                yield pa.RecordBatch.from_arrays([*batch.columns[: len(keep)], pa.array(list(p), pa.list_(pa.float64()))], names=[*keep, "p"])

        kinds = ", ".join(f"`{c}` {rows.schema[c].dataType.simpleString()}" for c in keep)
        return rows.select(*keep, fold.alias("_fold"), "scores").mapInArrow(run, f"{kinds}, p array<double>")

    # -- results

    def probabilities(self, rows: DataFrame) -> DataFrame:
        """object_id and the folds' mean probability vector, p."""
        zeros = F.lit(bytes(8 * self.n_folds * len(self.labels)))
        scored = self._added(self._binned(rows, ["object_id"]).withColumn("scores", zeros), self.forest)
        return self._softmax(scored, ["object_id"], lambda p, fold: p.mean(axis=1))

    def report(self) -> DataFrame:
        """accuracy, log_loss, roc_auc_macro (one class against the rest, ties count half), n_classes, n_objects, n_folds of the out-of-fold probabilities."""
        return report(self.out_of_fold, len(self.labels), self.n_folds)


def report(out_of_fold: DataFrame, n_classes: int, n_folds: int) -> DataFrame:
    """Quality of probabilities p beside the place of the true class, label_at."""
    from tarnfield.operators import metrics

    rows = stages.written(out_of_fold.select("object_id", "label_at", "p"))
    lead = F.array_position("p", F.array_max("p")) - 1
    loss = -F.log(F.greatest(F.element_at("p", F.col("label_at") + 1), F.lit(1e-15)))
    whole = rows.agg(F.avg((lead == F.col("label_at")).cast("double")).alias("accuracy"), F.avg(loss).alias("log_loss"), F.count(F.lit(1)).alias("n_objects"))
    long = rows.select("object_id", "label_at", F.posexplode("p").alias("cls", "v")).select("object_id", "cls", (F.col("cls") == F.col("label_at")).cast("int").alias("y"), F.round("v", 9).alias("score"))
    auc = metrics.auc_and_ap(long, ["cls"]).agg(F.avg("roc_auc").alias("roc_auc_macro"))
    return whole.join(auc).select("accuracy", "log_loss", "roc_auc_macro", F.lit(n_classes).alias("n_classes"), "n_objects", F.lit(n_folds).alias("n_folds"))
