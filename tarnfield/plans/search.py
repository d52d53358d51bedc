"""Weight search and ablation: all combinations of weights by refined histograms.

One pass bins the scores of all combinations: a task adds its rows up by (group,
combination, bin), and only these sums are shuffled. A bin without positives, or with a
single row, needs no more: nothing in it changes AUC or average precision. The others are
opened in a second pass, where rows are added up by (group, combination, score). The
result is that of sorting all rows for every combination.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import product

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tarnfield.operators import metrics, protocol
from tarnfield.sources import stages

# The searched weights of each channel.
GRID = {"taxonomy_gap": (1.0,), "simplex_novelty": (0.0, 0.1, 0.2, 0.4), "novelty_gap": (0.0, 0.05, 0.15), "prior_entropy": (0.0, 0.1, 0.25), "neighbor_entropy": (0.0, 0.1), "cc_weighted": (0.0, 0.15, 0.35)}
#: Scores are compared at 1 / UNIT; bins of the first pass for each combination; rows scored at once, sums held by a task.
UNIT, BINS, ROWS, HELD = 10**9, 1024, 2048, 1 << 19


def combinations(grid: dict[str, tuple[float, ...]] = GRID) -> list[dict[str, float]]:
    """All combinations, in order, with weights scaled to sum 1."""
    return [dict(zip(grid, (v / sum(values) for v in values))) for values in product(*grid.values())]


def _binned(rows: DataFrame, weights: np.ndarray, shift: int, opened: np.ndarray | None) -> DataFrame:
    """(grp, combo, bin, pos, neg): scores in units, shifted right by ``shift``; with
    ``opened`` (sorted rows of grp, combo, bin as one number) those in these bins only, unshifted."""
    n, combos = weights.shape[1], len(weights)
    names = ["grp", "combo", "bin", "pos", "neg"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        keys, counts, size = [], [], 0

        def packed() -> pa.RecordBatch:
            k = np.concatenate(keys) if keys else np.zeros((0, 3), np.int64)
            c = np.concatenate(counts) if counts else np.zeros((0, 2), np.int64)
            own, at = np.unique(k, axis=0, return_inverse=True) if len(k) else (k, np.zeros(0, np.int64))
            total = np.stack([np.bincount(at.ravel(), c[:, i], len(own)) for i in range(2)], axis=1) if len(k) else c
            return pa.RecordBatch.from_arrays([*(pa.array(own[:, i], pa.int64()) for i in range(3)), *(pa.array(total[:, i].astype(float)) for i in range(2))], names=names)

        for batch in batches:
            for a in range(0, batch.num_rows, ROWS):
                part = batch.slice(a, ROWS)
                x = np.nan_to_num(np.asarray(part.column(0).flatten().to_numpy(zero_copy_only=False), float).reshape(-1, n))
                y = part.column(1).to_numpy(zero_copy_only=False)
                groups = part.column(2).flatten().to_numpy(zero_copy_only=False).reshape(len(x), -1)
                for c in range(combos):
                    score = np.zeros(len(x))
                    for k in range(n):
                        score = score + x[:, k] * weights[c, k]
                    unit = np.floor(score * UNIT + 0.5).astype(np.int64)
                    for g in range(groups.shape[1]):
                        own, label, grp = unit, y, groups[:, g].astype(np.int64)
                        if opened is not None:
                            code = _code(grp, c, unit >> shift, combos)
                            at = np.searchsorted(opened, code)
                            inside = (at < len(opened)) & (opened[np.minimum(at, len(opened) - 1)] == code) if len(opened) else np.zeros(len(code), bool)
                            own, label, grp = unit[inside], y[inside], grp[inside]
                        else:
                            own = unit >> shift
                        pair, at = np.unique(np.stack([grp, own], axis=1), axis=0, return_inverse=True)
                        at = at.ravel()
                        pos = np.bincount(at, label == 1, len(pair)).astype(np.int64)
                        keys.append(np.stack([pair[:, 0], np.full(len(pair), c), pair[:, 1]], axis=1))
                        counts.append(np.stack([pos, np.bincount(at, minlength=len(pair)) - pos], axis=1))
                        size += len(pair)
                if size > HELD:
                    yield packed()
                    keys, counts, size = [], [], 0
        yield packed()

    summed = rows.mapInArrow(run, "grp long, combo long, bin long, pos double, neg double")
    return summed.groupBy("grp", "combo", "bin").agg(F.sum("pos").alias("pos"), F.sum("neg").alias("neg"))


def _code(grp: np.ndarray, combo: int, key: np.ndarray, combos: int) -> np.ndarray:
    """Group, combination and bin as one number; bins are in -2 BINS to 2 BINS."""
    return (grp * combos + combo) * (4 * BINS) + key + 2 * BINS


def evaluated(evidence: DataFrame, weights: list[dict[str, float]], groups: Column | None = None) -> DataFrame:
    """grp, combo (the place in ``weights``), n_pos, n_neg, roc_auc, average_precision of each
    set of weights. ``groups`` is an array of integers: the groups that a row counts in
    (all rows have as many); without it there is one, 0. A missing channel counts as 0."""
    channels = sorted({c for w in weights for c in w})
    table = np.array([[w.get(c, 0.0) for c in channels] for w in weights])
    own = F.array(*(F.col(c).cast("double") for c in channels))
    rows = stages.written(evidence.select(own.alias("x"), F.col("y").cast("int").alias("y"), (F.array(F.lit(0)) if groups is None else groups).alias("groups")))
    greatest = rows.agg(F.max(F.aggregate("x", F.lit(0.0), lambda a, v: F.greatest(a, F.abs(F.coalesce(v, F.lit(0.0))))))).first()[0] or 0.0
    reach = max(1, int(greatest * np.abs(table).sum(axis=1).max() * UNIT) + 1)
    shift = max(0, (reach // BINS).bit_length())
    first = stages.written(_binned(rows, table, shift, None))
    open_bin = (F.col("pos") > 0) & (F.col("pos") + F.col("neg") > 1)
    found = first.filter(open_bin).select("grp", "combo", "bin").collect()  # 2 * BINS for each group and combination at most
    codes = np.sort(np.array([_code(r["grp"], r["combo"], r["bin"], len(table)) for r in found], np.int64))
    second = _binned(rows, table, shift, codes)
    closed = first.filter(~open_bin).withColumn("bin", F.shiftleft("bin", shift))
    return metrics.of_blocks(closed.unionByName(second).withColumnRenamed("bin", "score"), ["grp", "combo"])


def search(evidence: DataFrame, grid: dict[str, tuple[float, ...]] = GRID) -> DataFrame:
    """roc_auc and average_precision of every combination; ``evidence`` has y and the channels."""
    return evaluated(evidence, combinations(grid)).drop("grp")


def best(results: DataFrame) -> DataFrame:
    """The greatest average precision; the first combination of ties."""
    return results.orderBy(F.desc("average_precision"), "combo").limit(1)


def optimism(evidence: DataFrame, grid: dict[str, tuple[float, ...]], seeds: tuple[int, ...] = (0, 1, 2, 3, 4)) -> DataFrame:
    """What a weight search gains by being judged on the rows it chose on: seed, combo,
    ap_select, ap_report, optimism.

    For each seed a hash of their id puts objects into two halves. The combination that
    is best on one half is scored on the other; a seed is left out if a half has one class
    only. All seeds, halves and combinations are one pass."""
    halves = F.array(*(F.lit(2 * k) + (protocol.draw(F.col("object_id"), f"optimism-{s}") < 0.5).cast("int") for k, s in enumerate(seeds)))
    seed = F.element_at(F.array(*map(F.lit, seeds)), F.floor(F.col("grp") / 2).cast("int") + 1)
    aps = stages.written(evaluated(evidence, combinations(grid), halves).filter(F.col("average_precision").isNotNull()).select(seed.alias("seed"), (F.col("grp") % 2 == 1).alias("selects"), "combo", "average_precision"))
    chosen = aps.filter("selects").groupBy("seed").agg(F.max(F.struct(F.round("average_precision", 9).alias("ap"), (-F.col("combo")).alias("nth"))).alias("b"))
    chosen = chosen.select("seed", (-F.col("b.nth")).alias("combo"), F.col("b.ap").alias("ap_select"))
    report = aps.filter("not selects").select("seed", "combo", F.round("average_precision", 9).alias("ap_report"))
    return chosen.join(report, ["seed", "combo"]).withColumn("optimism", F.col("ap_select") - F.col("ap_report"))


def side_by_side(sides: dict[str, DataFrame]) -> DataFrame:
    """Metrics of several scored populations (object_id, y, score) as one table."""
    rows = None
    for name, scored in sides.items():
        own = scored.select(F.lit(name).alias("side"), "y", "score")
        rows = own if rows is None else rows.unionByName(own)
    return metrics.auc_and_ap(rows, ["side"])


def compare(evidence: DataFrame, variants: dict[str, dict[str, float]]) -> DataFrame:
    """Metrics of each named set of weights on raw evidence; sets without weight are left out."""
    used = {name: {c: x / sum(w.values()) for c, x in w.items()} for name, w in variants.items() if sum(w.values()) > 0}
    name = F.element_at(F.array(*map(F.lit, used)), F.col("combo").cast("int") + 1)
    return evaluated(evidence, list(used.values())).select(name.alias("variant"), "n_pos", "n_neg", "roc_auc", "average_precision")


def ablation(evidence: DataFrame, weights: dict[str, float], bump: float = 0.2) -> DataFrame:
    """Metrics of the full weights, and with each channel dropped, raised and alone, on raw evidence."""
    variants = {"full": weights}
    for c in weights:
        variants[f"drop_{c}"] = {k: v for k, v in weights.items() if k != c}
        variants[f"plus_{c}"] = weights | {c: weights[c] + bump}
        variants[f"only_{c}"] = {c: 1.0}
    return compare(evidence, variants)
