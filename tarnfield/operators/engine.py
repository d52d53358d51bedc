"""The whole chain as one fitted object: features, prior, channels, gate, score.

``fit`` takes the reference, ``evidence`` gives any later rows their channels. What is
fitted comes from the reference alone, so a row's channels do not depend on its batch.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tarnfield.operators import evidence, features, models, protocol, quality, ranking
from tarnfield.operators.neighbours import PivotIndex
from tarnfield.schema import KNOWN
from tarnfield.sources import stages

#: Rows that the overall variance counts for in a class's own; places at which raw channels are compared.
PSEUDO_ROWS, PLACES = 5.0, 6
#: Added before rounding: a value on a tie of the last place would otherwise fall either way.
NUDGE = 3.7e-8
FLOOR = 1e-12


def gated(obs: DataFrame, meta: DataFrame, names: list[str]) -> DataFrame:
    """object_id, the named columns of the feature matrix, quality and redshift reliability.
    Columns that nothing asks for are never computed."""
    rows = quality.with_quality(features.feature_matrix(obs, meta))
    return rows.select("object_id", *names, "quality", F.coalesce("unc_z_reliability", F.lit(1.0)).alias("reliability"))


class GaussianPrior:
    """Probabilities in closed form: each class has a mean and a deviation in every feature
    (the variance shrunk towards that of all rows), and weighs exp(-chi2 / 2), chi2 being
    the mean squared deviation over the features. Two halves by a hash of the id give
    out-of-fold probabilities; other rows get the mean of both. Missing values deviate by
    nothing; without a class to compare with all classes weigh the same."""

    def __init__(self, names: list[str], n_classes: int = len(KNOWN), seed: str = "chain-fold") -> None:
        self.names, self.n_classes, self.seed = list(names), n_classes, seed

    def fold(self) -> Column:
        return (protocol.draw(F.col("object_id"), self.seed) < 0.5).cast("int")

    def fit(self, rows: DataFrame) -> GaussianPrior:
        """``rows`` has object_id, label (0 to n_classes - 1) and the features."""
        x = F.array(*(F.col(c).cast("double") for c in self.names))
        long = rows.select("label", self.fold().alias("fold"), F.posexplode(x).alias("k", "v")).filter("v IS NOT NULL")
        long = long.withColumn("m", F.explode(F.array(1 - F.col("fold"), F.lit(2)))).drop("fold")  # a model for each half's rows, and for all
        own = long.groupBy("m", "label", "k").agg(F.count("v").alias("n"), F.avg("v").alias("mean"), F.var_samp("v").alias("var"))
        whole = long.groupBy("m", "k").agg(F.var_samp("v").alias("all_var"))
        shape = (3, self.n_classes, len(self.names))
        self.mean, self.scale, self.has = np.zeros(shape), np.ones(shape), np.zeros(shape, bool)
        for r in own.join(whole, ["m", "k"]).filter("all_var > 1e-24").collect():  # models by classes by features
            at = (r["m"], r["label"], r["k"])
            self.mean[at], self.has[at] = r["mean"], True
            self.scale[at] = np.sqrt(((r["n"] - 1) * (r["var"] or 0.0) + PSEUDO_ROWS * r["all_var"]) / (r["n"] - 1 + PSEUDO_ROWS))
        return self

    def channels(self, rows: DataFrame, out_of_fold: bool = False) -> DataFrame:
        """object_id, p, gap (the least chi2 of any class, by all rows) and cc (that expected under p)."""
        mean, scale, has, width = self.mean, self.scale, self.has, len(self.names)

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                n = batch.num_rows
                x = np.asarray(batch.column(2).flatten().to_numpy(zero_copy_only=False), float).reshape(n, width)
                chi = np.full((n, *has.shape[:2]), np.nan)
                for m in range(3):
                    for c in np.nonzero(has[m].any(axis=1))[0]:
                        z = (x - mean[m, c]) / scale[m, c]
                        chi[:, m, c] = np.where(has[m, c] & ~np.isnan(x), z * z, 0.0).sum(axis=1) / width
                e = np.where(np.isnan(chi[:, :2]), 0.0, np.exp(-0.5 * chi[:, :2]))
                total = e.sum(axis=2, keepdims=True)
                p = np.maximum(np.where(total > 0, e / np.where(total > 0, total, 1.0), 1.0 / has.shape[1]), FLOOR)
                fold = batch.column(1).to_numpy(zero_copy_only=False)
                p = p[np.arange(n), fold] if out_of_fold else p.mean(axis=1)
                whole = chi[:, 2]
                some = ~np.isnan(whole).all(axis=1)
                gap = np.where(some, np.where(np.isnan(whole), np.inf, whole).min(axis=1), 0.0)
                cc = np.where(np.isnan(whole), 0.0, whole * p).sum(axis=1)
                yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(list(p), pa.list_(pa.float64())), pa.array(gap), pa.array(cc)], names=["object_id", "p", "gap", "cc"])

        x = F.array(*(F.col(c).cast("double") for c in self.names))
        out = rows.select("object_id", self.fold().alias("fold"), x.alias("x")).mapInArrow(run, f"object_id {rows.schema['object_id'].dataType.simpleString()}, p array<double>, gap double, cc double")
        return out.withColumns({c: F.round(F.col(c) + NUDGE, PLACES) for c in ("gap", "cc")})


class NoveltyEngine:
    """Rows have object_id, the features, quality and reliability; the reference has label as well."""

    def __init__(self, names: list[str], k: int = 25) -> None:
        self.names, self.k = list(names), k

    def _packed(self, rows: DataFrame) -> DataFrame:
        z = models.standardised(rows.select("object_id", *(["label"] if "label" in rows.columns else []), *self.names), self.centre)
        return z.select("object_id", F.col("label") if "label" in rows.columns else F.lit(-1).alias("label"), F.array(*self.names).alias("x"))

    def fit(self, reference: DataFrame) -> NoveltyEngine:
        rows = stages.written(reference.select("object_id", "label", *self.names))
        self.prior = GaussianPrior(self.names).fit(rows)
        self.known = stages.written(self.prior.channels(rows, out_of_fold=True).join(rows.select("object_id", "label"), "object_id"))
        self.centroids = stages.written(evidence.centroids(self.known))
        self.centre = models.standardiser(rows, self.names)
        self.index = PivotIndex().fit(self._packed(rows))
        return self

    def evidence(self, rows: DataFrame) -> DataFrame:
        """Every channel, the best fits, quality, reliability and uncertainty (the entropy of the probabilities)."""
        rows = stages.written(rows.select("object_id", *self.names, "quality", "reliability"))
        raw = stages.written(self.prior.channels(rows).withColumn("label", F.lit(-1)))
        near = stages.written(self.index.query(self._packed(rows), self.k))
        out = evidence.simplex_channels(raw, self.centroids).drop("label")
        out = out.join(evidence.quantile_maps(raw, self.known, {"gap": "physics_gap", "cc": "cc_weighted"}), "object_id")
        out = out.join(evidence.neighbour_channels(near, len(KNOWN)), "object_id").join(evidence.family_misfit(raw, near), "object_id")
        return out.join(rows.select("object_id", "quality", "reliability"), "object_id").withColumn("uncertainty", F.col("prior_entropy"))

    def score(self, rows: DataFrame, weights: dict[str, float] = ranking.BASELINE) -> DataFrame:
        return ranking.scores(self.evidence(rows), weights)
