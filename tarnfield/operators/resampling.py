"""Bootstrap intervals of ranking metrics with a vector of weights for each row.

A resample gives every object a Poisson(1) weight, drawn from a hash of its id and the
draw's number. Rows, not rows times draws, are dealt by ranges of the score; a range's
task makes the weights of all draws as one matrix and puts out a vector of partial sums.
Values that come up often (ties) are already summed where they are read. What comes to
the driver is one vector for each range: RANGES times the draws at most.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tarnfield.operators import metrics, ordered

#: Draws of one digest, 16 bits each, and where a draw's weight rises by one.
PER_DIGEST = 8
THRESHOLDS = [math.ceil(65536 * sum(math.exp(-1) / math.factorial(i) for i in range(k + 1))) for k in range(8)]
#: Rows whose weights are a matrix at once; rows of one score in a batch that are summed at once; sums held before they go.
ROWS, OFTEN, HELD = 1024, 16, 256
#: Positives or negatives below which an interval is flagged.
SMALL = 30
# The k of the precision.
PRECISION_K = (10, 20, 50, 100)


def weights(ids: list[str], draws: int, seed: int) -> np.ndarray:
    """Poisson(1) weights (ids by draws) from MD5 of seed, id and block of draws."""
    blocks = -(-draws // PER_DIGEST)
    raw = b"".join(hashlib.md5(f"boot-{seed}:{i}|{b}".encode()).digest() for i in ids for b in range(blocks))
    u = np.frombuffer(raw, ">u2").reshape(len(ids), blocks * PER_DIGEST)[:, :draws]
    return np.searchsorted(THRESHOLDS, u, "right").astype(np.int64)


def _summed(rows: DataFrame, draws: int, seed: int) -> DataFrame:
    """(_range, score, object_id, y, pos, neg): single rows, or vectors of summed weights of one score."""
    names = ["_range", "score", "object_id", "y", "pos", "neg"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[tuple[int, float], np.ndarray] = {}

        def sums() -> pa.RecordBatch:
            keys = list(held)
            none = [None] * len(keys)
            out = [pa.array([k[0] for k in keys], pa.int32()), pa.array([k[1] for k in keys], pa.float64()), pa.array(none, pa.string()), pa.array(none, pa.int32()), *(pa.array([held[k][i].tobytes() for k in keys], pa.binary()) for i in range(2))]
            held.clear()
            return pa.RecordBatch.from_arrays(out, names=names)

        for batch in batches:
            if not batch.num_rows:
                continue
            ranges, score, y = (batch.column(k).to_numpy(zero_copy_only=False) for k in (0, 1, 3))
            _, at, n = np.unique(score, return_inverse=True, return_counts=True)
            often = n[at] >= OFTEN
            for k in np.unique(at[often]):
                rows_at = np.nonzero(at == k)[0]
                ids = batch.column(2).take(pa.array(rows_at)).to_pylist()
                total = held.setdefault((int(ranges[rows_at[0]]), float(score[rows_at[0]])), np.zeros((2, draws), np.int64))
                for p in range(0, len(ids), ROWS):
                    w = weights(ids[p : p + ROWS], draws, seed)
                    one = y[rows_at[p : p + ROWS]] == 1
                    total[0] += w[one].sum(axis=0)
                    total[1] += w[~one].sum(axis=0)
            single = batch.take(pa.array(np.nonzero(~often)[0]))
            none = pa.nulls(single.num_rows, pa.binary())
            yield pa.RecordBatch.from_arrays([*single.columns, none, none], names=names)
            if len(held) > HELD:
                yield sums()
        yield sums()

    slim = rows.select("_range", F.col("score").cast("double").alias("score"), F.col("object_id").cast("string").alias("object_id"), F.col("y").cast("int").alias("y"))
    return slim.mapInArrow(run, "_range int, score double, object_id string, y int, pos binary, neg binary")


def _blocks(table: pa.Table, draws: int, seed: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(pos, neg), blocks by draws, of the range's scores from the greatest on, a piece at a time."""
    score = table["score"].to_numpy()
    order = np.argsort(-score, kind="stable")
    score = score[order]
    ids, y, pos, neg = (table[c].take(pa.array(order)).to_pylist() for c in ("object_id", "y", "pos", "neg"))
    a = 0
    while a < len(score):
        b = min(a + ROWS, len(score))
        while b < len(score) and score[b] == score[b - 1]:  # a tie is never cut
            b += 1
        begin = np.nonzero(np.concatenate(([True], score[a + 1 : b] != score[a : b - 1])))[0]
        both = np.zeros((2, len(begin), draws), np.int64)
        block = np.cumsum(np.isin(np.arange(b - a), begin)) - 1
        single = [k for k in range(a, b) if ids[k] is not None]
        for p in range(0, len(single), ROWS):
            own = single[p : p + ROWS]
            w = weights([ids[k] for k in own], draws, seed)
            for label, side in ((1, 0), (0, 1)):
                mine = [j for j, k in enumerate(own) if y[k] == label]
                np.add.at(both[side], block[[own[j] - a for j in mine]], w[mine])
        for k in range(a, b):
            if ids[k] is None:
                both[0, block[k - a]] += np.frombuffer(pos[k], np.int64)
                both[1, block[k - a]] += np.frombuffer(neg[k], np.int64)
        yield both[0], both[1]
        a = b


def _range_sums(dealt: DataFrame, draws: int, seed: int, offsets: dict[int, tuple[np.ndarray, np.ndarray]] | None, scales: tuple[float, ...]) -> list:
    """For each range its sums of positives and negatives, or with the offsets its wins and gains."""

    def run(table: pa.Table) -> pa.Table:
        number = table["_range"][0].as_py()
        n_pos, n_neg = np.zeros(draws), np.zeros(draws)
        if offsets is None:
            for pos, neg in _blocks(table, draws, seed):
                n_pos += pos.sum(axis=0)
                n_neg += neg.sum(axis=0)
            out = [n_pos, n_neg]
        else:
            tp, fp = (x.astype(float) for x in offsets[number])
            wins, gains = np.zeros(draws), [np.zeros(draws) for _ in scales]
            for pos, neg in _blocks(table, draws, seed):
                tps, fps = tp + pos.cumsum(axis=0), fp + neg.cumsum(axis=0)
                wins += (neg * (tps - pos / 2)).sum(axis=0)
                for gain, scale in zip(gains, scales):
                    gain += np.divide(pos * tps, tps + scale * fps, out=np.zeros(tps.shape), where=pos > 0).sum(axis=0)
                tp, fp = tps[-1], fps[-1]
            out = [wins, *gains]
        return pa.table({"_range": pa.array([number], pa.int32()), "sums": pa.array([np.concatenate(out).tobytes()], pa.binary())})

    found = dealt.groupBy("_range").applyInArrow(run, "_range int, sums binary").collect()  # a vector for each range
    return [(r["_range"], np.frombuffer(bytes(r["sums"])).reshape(-1, draws)) for r in found]


def _precisions(rows: DataFrame, ks: tuple[int, ...], draws: int, seed: int) -> dict[int, np.ndarray]:
    """Precision at k of every draw, from as many of the best rows as all draws need."""
    out, take, best = {}, 3 * max(ks) + 200, []
    while True:
        best = rows.select(F.col("object_id").cast("string").alias("id"), "y").orderBy(F.desc("score"), "object_id").limit(take).collect()  # some hundreds
        w = weights([r["id"] for r in best], draws, seed)
        if len(best) < take or not len(best) or w.sum(axis=0).min() >= max(ks):
            break
        take *= 2
    y = np.array([r["y"] for r in best], float)
    before = w.cumsum(axis=0) - w
    for k in ks:
        mine = np.clip(k - before, 0, w)
        taken = mine.sum(axis=0)
        out[k] = np.divide((mine * y[:, None]).sum(axis=0), taken, out=np.full(draws, np.nan), where=taken > 0)
    return out


def draw_metrics(rows: DataFrame, draws: int, seed: int = 42, ks: tuple[int, ...] = PRECISION_K, scales: tuple[float, ...] = (1.0,)) -> dict[str, np.ndarray]:
    """The metrics of every draw, by name; NaN where a draw has one class only. ``scales``
    are weights of the negatives, each with an average precision of its own."""
    dealt = ordered.stages.written(_summed(ordered.by_ranges(rows.select("object_id", "y", "score"), -F.col("score")), draws, seed))
    sums = sorted(_range_sums(dealt, draws, seed, None, scales), key=lambda s: s[0])
    pos, neg = np.zeros(draws), np.zeros(draws)
    offsets = {}
    for number, own in sums:
        offsets[number] = (pos, neg)
        pos, neg = pos + own[0], neg + own[1]
    wins, gains = np.zeros(draws), np.zeros((len(scales), draws))
    for _, own in sorted(_range_sums(dealt, draws, seed, offsets, scales), key=lambda s: s[0]):
        wins += own[0]
        gains += own[1:]
    both = (pos > 0) & (neg > 0)
    ratio = lambda a, b: np.divide(a, b, out=np.full(draws, np.nan), where=both)
    out = {"roc_auc": ratio(wins, pos * neg)}
    for scale, gain in zip(scales, gains):
        out["average_precision" if len(scales) == 1 else f"average_precision_{scale!r}"] = ratio(gain, pos)
    if ks:
        out |= {f"p_at_{k}": np.where(both, v, np.nan) for k, v in _precisions(rows, ks, draws, seed).items()}
    return out


def interval(values: np.ndarray, alpha: float = 0.05) -> tuple[float | None, float | None, int]:
    """(low, high, draws): percentile interval of the draws that have a value."""
    own = values[np.isfinite(values)]
    if not len(own):
        return None, None, 0
    low, high = np.quantile(own, [alpha / 2, 1 - alpha / 2])
    return float(low), float(high), len(own)


def intervals(rows: DataFrame, draws: int = 1000, seed: int = 42, alpha: float = 0.05, ks: tuple[int, ...] = PRECISION_K) -> DataFrame:
    """metric, point, low, high, draws and small_n (fewer than SMALL positives or negatives)
    of roc_auc, average_precision and p_at_<k>; rows have object_id, y, score. Draws with
    one class only do not count; without any, the ends are null."""
    rows = ordered.stages.written(rows.select("object_id", "y", "score"))
    auc = metrics.auc_and_ap(rows).first()
    points = {"roc_auc": auc["roc_auc"], "average_precision": auc["average_precision"]} | {f"p_at_{r['k']}": r["precision"] for r in metrics.at_k(rows, ks).collect()} if auc else {}
    small = auc is None or min(auc["n_pos"] or 0, auc["n_neg"] or 0) < SMALL
    out = [(name, points.get(name), *interval(v, alpha), small) for name, v in draw_metrics(rows, draws, seed, ks).items()]
    return rows.sparkSession.createDataFrame(out, "metric string, point double, low double, high double, draws long, small_n boolean")


def report(rows: DataFrame, draws: int = 1000, seed: int = 42, alpha: float = 0.05, precision_k: tuple[int, ...] = PRECISION_K, recall_k: tuple[int, ...] = metrics.RECALL_K) -> DataFrame:
    """One row: metrics.evaluate of all rows, beside roc_auc, average_precision and each
    p_at_<k> the ends of its interval (<metric>_low, <metric>_high), draws (those of
    roc_auc) and small_n. Without rows counts are 0 and metrics and ends null."""
    rows = ordered.stages.written(rows.select("object_id", "y", "score"))
    found = {r["metric"]: r for r in intervals(rows, draws, seed, alpha, precision_k).collect()}
    ends = {f"{m}_{end}": F.lit(r[end]).cast("double") for m, r in found.items() for end in ("low", "high")}
    whole = metrics.evaluate(rows, precision_k=precision_k, recall_k=recall_k)
    return whole.withColumns({**ends, "draws": F.lit(found["roc_auc"]["draws"]), "small_n": F.lit(found["roc_auc"]["small_n"])})
