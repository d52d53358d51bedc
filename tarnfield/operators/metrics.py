"""Ranking metrics with tie blocks, base-rate weights, and per-class tables.

Input rows have object_id, y (0/1), score and optionally a group column; global
orders are over distinct scores (tie blocks), which are aggregated first.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tarnfield.operators import ordered
from tarnfield.sources import stages


def tie_blocks(rows: DataFrame, by: list[str], weight: Column | None = None) -> DataFrame:
    """Weight of positives (pos) and negatives (neg) at each score."""
    w = weight if weight is not None else F.lit(1.0)
    return rows.groupBy(*by, "score").agg(F.sum(F.when(F.col("y") == 1, w).otherwise(0.0)).alias("pos"), F.sum(F.when(F.col("y") == 0, w).otherwise(0.0)).alias("neg"))


def auc_and_ap(rows: DataFrame, by: list[str] = [], weight: Column | None = None) -> DataFrame:  # noqa: B006
    """roc_auc (ties count half) and average_precision (by tie block); null for one class only."""
    return of_blocks(tie_blocks(rows, by, weight), by)


def of_blocks(blocks: DataFrame, by: list[str]) -> DataFrame:
    """The same for tie blocks (by, score, pos, neg)."""
    b = ordered.running(ordered.by_ranges(blocks, -F.col("score")), [F.desc("score")], {"tp": F.col("pos"), "fp": F.col("neg")}, by)
    a = b.groupBy(*by).agg(F.sum("pos").alias("n_pos"), F.sum("neg").alias("n_neg"), F.sum(F.col("neg") * (F.col("tp") - F.col("pos") / 2)).alias("wins"), F.sum(F.when(F.col("pos") > 0, F.col("pos") * F.col("tp") / (F.col("tp") + F.col("fp")))).alias("gain"))
    both = (F.col("n_pos") > 0) & (F.col("n_neg") > 0)
    return a.select(*by, "n_pos", "n_neg", F.when(both, F.col("wins") / (F.col("n_pos") * F.col("n_neg"))).alias("roc_auc"), F.when(both, F.coalesce(F.col("gain"), F.lit(0.0)) / F.col("n_pos")).alias("average_precision"))


def at_k(rows: DataFrame, ks: tuple[int, ...]) -> DataFrame:
    """precision, recall and lift at each k; ties by object_id. Only max(ks) rows are sorted."""
    total = rows.agg(F.count(F.lit(1)).alias("n"), F.sum("y").alias("pos"))
    best = rows.orderBy(F.desc("score"), "object_id").limit(max(ks))
    best = best.withColumn("rank", F.row_number().over(Window.partitionBy(F.lit(0)).orderBy(F.desc("score"), "object_id")))
    hits = best.select(F.explode(F.array(*map(F.lit, ks))).alias("k"), "rank", "y").filter(F.col("rank") <= F.col("k")).groupBy("k").agg(F.sum("y").alias("hits"), F.count(F.lit(1)).alias("taken"))
    out = hits.join(F.broadcast(total))
    return out.select("k", "hits", (F.col("hits") / F.col("taken")).alias("precision"), F.try_divide(F.col("hits"), F.col("pos")).alias("recall"), F.try_divide(F.col("hits") / F.col("taken"), F.col("pos") / F.col("n")).alias("lift"))


def negative_weight(base_rate: float | Column, target_rate: float, inverted: bool = False) -> float | Column:
    """Weight of negatives that moves the positives' share from base to target.

    The odds must fall from base/(1-base) to target/(1-target), so negatives weigh
    their ratio. ``inverted`` gives the reciprocal, only for comparing with numbers
    that were made with it."""
    w = (base_rate / (1 - base_rate)) * ((1 - target_rate) / target_rate)
    return 1 / w if inverted else w


# The targets and k of the stress table, and its k of recall.
STRESS_TARGETS, STRESS_K, STRESS_RECALL_K = (0.10, 0.01, 0.001, 0.0001), (50, 100, 200), (200, 500)


def stress(rows: DataFrame, targets: tuple[float, ...] = STRESS_TARGETS, ks: tuple[int, ...] = STRESS_K, draws: int = 400, seed: int = 42) -> DataFrame:
    """One ranking under lower base rates, a row for each target below the observed one:
    target, negative_weight, roc_auc, average_precision, its interval (ap_low, ap_high, none
    with draws = 0), p_at_<k>, lift_at_<k> and r_at_<k>, negatives weighing negative_weight.

    One pass over tie blocks serves all targets; only the best rows are ordered for k."""
    from tarnfield.operators import resampling

    rows = stages.written(rows.select("object_id", "y", "score"))
    base = rows.agg(F.avg("y")).first()[0]
    used = [t for t in targets if base and 0 < t < 1 and t < base]
    weight = {t: negative_weight(base, t) for t in used}
    names = [f"{x}_at_{k}" for k in ks for x in ("p", "lift")] + [f"r_at_{k}" for k in STRESS_RECALL_K]
    kinds = "target double, negative_weight double, roc_auc double, average_precision double, ap_low double, ap_high double, " + ", ".join(f"{n} double" for n in names)
    if not used:
        return rows.sparkSession.createDataFrame([], kinds)
    grid = F.explode(F.array(*(F.struct(F.lit(t).alias("target"), F.lit(weight[t]).alias("w")) for t in used))).alias("g")
    blocks = tie_blocks(rows, []).select("score", "pos", "neg", grid).select("g.target", "score", "pos", (F.col("neg") * F.col("g.w")).alias("neg"))
    auc = {r["target"]: r for r in of_blocks(blocks, ["target"]).collect()}  # a row for each target
    total = rows.agg(F.sum("y")).first()[0]
    best = [r["y"] for r in rows.orderBy(F.desc("score"), "object_id").limit(max(*ks, *STRESS_RECALL_K)).select("y").collect()]
    drawn = resampling.draw_metrics(rows, draws, seed, (), tuple(weight.values())) if draws else {}
    out = []
    for t in used:
        own = []
        for k in ks:
            pos = sum(best[:k])
            p = pos / (pos + weight[t] * (len(best[:k]) - pos)) if best else None
            own += [p, None if p is None else p / t]
        name = "average_precision" if len(used) == 1 else f"average_precision_{weight[t]!r}"
        low, high, _ = resampling.interval(drawn[name]) if draws else (None, None, 0)
        out.append((t, weight[t], auc[t]["roc_auc"], auc[t]["average_precision"], low, high, *own, *(sum(best[:k]) / total if total else None for k in STRESS_RECALL_K)))
    return rows.sparkSession.createDataFrame(out, kinds)


def review_budget(rows: DataFrame, target: float, budgets: tuple[int, ...] = (10, 50, 100, 500, 1000)) -> DataFrame:
    """What each budget of reviews brings at a lower base rate: weighted mass, positives, precision and lift.

    A budget beyond the rows takes all of them. Only max(budgets) rows are ordered."""
    total = rows.agg(F.avg("y").alias("base"))
    top = rows.orderBy(F.desc("score"), "object_id").limit(max(budgets)).withColumn("rank", F.row_number().over(Window.partitionBy(F.lit(0)).orderBy(F.desc("score"), "object_id")))
    own = top.select("y", "rank", F.explode(F.array(*map(F.lit, budgets))).alias("budget")).filter(F.col("rank") <= F.col("budget"))
    mass = own.groupBy("budget").agg(F.sum("y").cast("double").alias("recovered"), F.sum(1 - F.col("y")).cast("double").alias("others")).join(F.broadcast(total))
    reviews = F.col("recovered") + F.col("others") * negative_weight(F.col("base"), target)
    precision = F.when(reviews > 0, F.col("recovered") / reviews)
    return mass.select("budget", reviews.alias("expected_reviews"), F.col("recovered").alias("expected_recovered"), precision.alias("precision"), (precision / target).alias("lift"))


def audit(ranked: DataFrame, k: int = 100, low: float = 0.5) -> DataFrame:
    """The queue's top k in one row: counts, quality, uncertainty, abstentions and false positives."""
    top = ranked.orderBy(F.desc("score"), "object_id").limit(k)
    tiers = [F.count_if(F.col("tier") == t).alias(f"n_{t}") for t in ("critical", "high", "moderate", "routine")]
    return top.agg(F.count(F.lit(1)).alias("n"), F.avg("quality").alias("mean_quality"), F.min("quality").alias("min_quality"), F.count_if(F.col("quality") < low).alias("n_low_quality"), F.avg("uncertainty").alias("mean_uncertainty"), F.count_if("abstain").alias("n_abstained"), F.count_if(F.col("y") == 0).alias("n_false_positives"), *tiers)


def per_class(rows: DataFrame, k: int, min_n: int = 30, names: DataFrame | None = None) -> DataFrame:
    """How often each group (grp) is among the top k, against its share; groups of fewer than
    min_n rows are flagged. ``names`` (grp, name, held_out) adds these; a group without a
    row there is named after itself and not held out."""
    n = rows.agg(F.count(F.lit(1)).alias("total"))
    best = rows.orderBy(F.desc("score"), "object_id").limit(k).groupBy("grp").agg(F.count(F.lit(1)).alias("in_top"))
    out = rows.groupBy("grp").agg(F.count(F.lit(1)).alias("n")).join(best.withColumnRenamed("grp", "_grp"), F.col("grp").eqNullSafe(F.col("_grp")), "left").join(F.broadcast(n))
    top = F.coalesce(F.col("in_top"), F.lit(0))
    out = out.select("grp", "n", top.alias("in_top"), (top / F.col("n")).alias("recall"), (top / (F.col("n") / F.col("total") * k)).alias("enrichment"), (F.col("n") < min_n).alias("low_n"))
    if names is None:
        return out
    own = names.select(F.col("grp").alias("_grp"), "name", "held_out")
    return out.join(F.broadcast(own), F.col("grp") == F.col("_grp"), "left").select(*out.columns, F.coalesce("name", F.col("grp").cast("string")).alias("name"), F.coalesce("held_out", F.lit(False)).alias("held_out"))


def weighted_at_k(rows: DataFrame, ks: tuple[int, ...]) -> DataFrame:
    """Precision by ``weight`` and recall (which weights do not change) at each k; ties by object_id."""
    best = rows.orderBy(F.desc("score"), "object_id").limit(max(ks))
    best = best.withColumn("rank", F.row_number().over(Window.partitionBy(F.lit(0)).orderBy(F.desc("score"), "object_id")))
    own = best.select("weight", "y", "rank", F.explode(F.array(*map(F.lit, ks))).alias("k")).filter(F.col("rank") <= F.col("k"))
    hits = own.groupBy("k").agg(F.sum(F.col("weight") * F.col("y")).alias("hit"), F.sum("weight").alias("all"), F.sum("y").alias("n"))
    total = rows.agg(F.sum("y").alias("pos"))
    return hits.join(F.broadcast(total)).select("k", F.when(F.col("all") > 0, F.col("hit") / F.col("all")).alias("precision"), F.when(F.col("pos") > 0, F.col("n") / F.col("pos")).alias("recall"))


# K of precision and lift, and of recall.
PRECISION_K, RECALL_K = (10, 20, 50, 100), (200, 500)


def evaluate(rows: DataFrame, by: list[str] = [], precision_k: tuple[int, ...] = PRECISION_K, recall_k: tuple[int, ...] = RECALL_K) -> DataFrame:  # noqa: B006
    """All ranking metrics in one row for each ``by``: counts, base_rate, roc_auc,
    average_precision, p_at_<k>, lift_at_<k> and r_at_<k>.

    A k beyond the rows takes all of them. Rows are numbered by ranges of their score."""
    placed = ordered.numbered(rows, -F.col("score"), [F.desc("score"), F.col("object_id")], "_rank", by, F.col("object_id"))
    n, pos = F.count(F.lit(1)), F.sum("y")
    hit = lambda k: F.sum(F.when(F.col("_rank") <= k, F.col("y")).otherwise(0))
    out = [n.alias("n_objects"), pos.alias("n_novel"), (pos / n).alias("base_rate")]
    for k in precision_k:
        p = hit(k) / F.least(n, F.lit(k))
        out += [p.alias(f"p_at_{k}"), F.try_divide(p, pos / n).alias(f"lift_at_{k}")]
    out += [F.try_divide(hit(k), pos).alias(f"r_at_{k}") for k in recall_k]
    counts, auc = placed.groupBy(*by).agg(*out), auc_and_ap(rows, by).select(*by, "roc_auc", "average_precision")
    return counts.join(auc, by) if by else counts.join(auc)
