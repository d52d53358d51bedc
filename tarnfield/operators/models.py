"""Fitted models: standardiser, known-class prior, anomaly scores, uncertainty, weights.

Fits aggregate over all rows on the cluster; what comes to the driver is moments,
edges and trees, whose size depends on the number of features and classes only.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark import SparkContext
from pyspark.ml.classification import LogisticRegression, RandomForestClassifier
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.ml.stat import Summarizer
from pyspark.mllib.linalg.distributed import RowMatrix
from pyspark.mllib.util import MLUtils
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tarnfield.operators import evidence, metrics, ordered, protocol
from tarnfield.schema import clip
from tarnfield.sources import stages

SIGMA_LOW, SIGMA_HIGH = 0.158655254, 0.841344746
#: Range that row weights of a fit are held to.
WEIGHT_RANGE = (1e-3, 20.0)


def standardiser(reference: DataFrame, features: list[str]) -> dict[str, tuple[float, float]]:
    """(centre, scale) of each feature: median and one-sigma range, else the standard deviation, else 1."""
    row = reference.agg(*(F.stddev_samp(f).alias(f"s_{f}") for f in features)).first()
    found, out = ordered.quantiles(reference, features, [SIGMA_LOW, 0.5, SIGMA_HIGH]), {}
    for f in features:
        q, s = found.get(f), row[f"s_{f}"]
        width = q[2] - q[0] if q else 0.0
        out[f] = (q[1] if q else 0.0, width if width > 1e-9 else s if s and s > 1e-9 else 1.0)
    return out


def standardised(rows: DataFrame, fitted: dict[str, tuple[float, float]]) -> DataFrame:
    """Missing values become 0, the centre."""
    return rows.withColumns({f: F.coalesce((F.col(f) - c) / s, F.lit(0.0)) for f, (c, s) in fitted.items()})


def covariance(rows: DataFrame, features: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Mean vector and sample covariance; features by features comes to the driver."""
    x = VectorAssembler(inputCols=features, outputCol="x").transform(rows).select("x")
    n, mean = x.agg(F.count(F.lit(1)), Summarizer.mean(F.col("x"))).first()
    if n < 2:
        return mean.toArray() if n else np.zeros(len(features)), np.zeros((len(features), len(features)))
    return mean.toArray(), RowMatrix(MLUtils.convertVectorColumnsFromML(x, "x")).computeCovariance().toArray()


def bare(model):
    """A fitted model without its training summary. The summary holds the session, and a
    session that has observed metrics (as harvests and replays do) cannot be sent to tasks."""
    if model.hasSummary:
        model._java_obj.setSummary(SparkContext._active_spark_context._jvm.scala.Option.empty())
    return model


class AnomalyEnsemble:
    """Mahalanobis distance and principal-component residual of standardised
    features, each mapped to its mid-rank in the reference and averaged."""

    def __init__(self, features: list[str], components: int = 2) -> None:
        self.features, self.components = features, components

    def fit(self, reference: DataFrame) -> AnomalyEnsemble:
        self.scale = standardiser(reference, self.features)
        ref = standardised(reference, self.scale)
        self.mean, cov = covariance(ref, self.features)
        self.precision = np.linalg.pinv(cov + 1e-6 * np.eye(len(cov)))
        _, vectors = np.linalg.eigh(cov)
        self.axes = vectors[:, ::-1][:, : self.components].T
        return self

    def distances(self, rows: DataFrame) -> DataFrame:
        """Adds mahalanobis and pca_residual: a batch of rows is one matrix product."""
        mean, precision, axes = self.mean, self.precision, self.axes

        @F.pandas_udf("struct<mahalanobis: double, pca_residual: double>")
        def both(x: pd.Series) -> pd.DataFrame:
            d = (np.stack(x.to_list()) if len(x) else np.zeros((0, len(mean)))) - mean
            own, along = (d * d).sum(axis=1), ((d @ axes.T) ** 2).sum(axis=1)
            return pd.DataFrame({"mahalanobis": np.sqrt(np.maximum(((d @ precision) * d).sum(axis=1), 0.0)), "pca_residual": np.sqrt(np.maximum(own - along, 0.0))})

        z = standardised(rows, self.scale).withColumn("_d", both(F.array(*self.features)))
        return z.withColumns({"mahalanobis": F.col("_d.mahalanobis"), "pca_residual": F.col("_d.pca_residual")}).drop("_d")


def assembled(rows: DataFrame, features: list[str]) -> DataFrame:
    return VectorAssembler(inputCols=features, outputCol="x", handleInvalid="keep").transform(rows.fillna(0.0, features))


class Prior:
    """Known-class probabilities: a random forest per fold, balanced by class, with
    out-of-fold probabilities for the training rows, and the classes' mean probability
    vectors and feature statistics. Classes are label indices. With a ``weight``
    column (held to WEIGHT_RANGE) rows weigh by it on top of the balance."""

    def __init__(self, features: list[str], n_folds: int = 3, trees: int = 30, seed: int = 42) -> None:
        self.features, self.n_folds, self.trees, self.seed = features, n_folds, trees, seed

    def _fit(self, rows: DataFrame) -> RandomForestClassifier:
        weights = rows.groupBy("label").agg(F.count(F.lit(1)).alias("_n"))
        weights = weights.withColumn("w", F.sum("_n").over(Window.partitionBy(F.lit(0))) / F.col("_n"))
        rows = assembled(rows, self.features).join(weights.select("label", "w"), "label")
        if "weight" in rows.columns:
            rows = rows.withColumn("w", F.col("w") * clip(F.coalesce(F.col("weight"), F.lit(1.0)), *WEIGHT_RANGE))
        return bare(RandomForestClassifier(labelCol="label", featuresCol="x", weightCol="w", numTrees=self.trees, maxDepth=6, seed=self.seed).fit(rows))

    def fit(self, rows: DataFrame) -> Prior:
        """``rows`` has object_id, label (0..K-1) and the features."""
        dealt = stages.written(protocol.folds(rows, "label", self.n_folds, f"prior-{self.seed}"))  # read by every fold's fit
        self.models = [self._fit(dealt.filter(F.col("fold") != k)) for k in range(self.n_folds)]
        parts = [m.transform(assembled(dealt.filter(F.col("fold") == k), self.features)).select("object_id", "label", vector_to_array("probability").alias("p")) for k, m in enumerate(self.models)]
        self.out_of_fold = parts[0]
        for p in parts[1:]:
            self.out_of_fold = self.out_of_fold.unionByName(p)
        self.centroids = self.out_of_fold.groupBy("label").agg(Summarizer.mean(array_to_vector("p")).alias("_m")).select("label", vector_to_array("_m").alias("centroid"))
        self.class_statistics = evidence.class_statistics(rows, self.features)
        return self

    def probabilities(self, rows: DataFrame) -> DataFrame:
        """object_id and the folds' mean probability vector, p."""
        out = assembled(rows, self.features).select("object_id", "x")
        for k, m in enumerate(self.models):
            out = m.transform(out).select("object_id", "x", *(f"p{i}" for i in range(k)), vector_to_array("probability").alias(f"p{k}"))
        total = F.col("p0")
        for k in range(1, len(self.models)):
            total = F.zip_with(total, F.col(f"p{k}"), lambda a, b: a + b)
        return out.select("object_id", F.transform(total, lambda v: v / len(self.models)).alias("p"))

    def accuracy(self) -> DataFrame:
        hit = F.array_position("p", F.array_max("p")) - 1 == F.col("label")
        return self.out_of_fold.agg(F.avg(hit.cast("double")).alias("accuracy"), F.count(F.lit(1)).alias("n"))


class GatedPrior(Prior):
    """A prior whose probabilities are half its own and half those reweighed by a
    two-way model of the family (``first_family``: labels of one of the two)."""

    def __init__(self, features: list[str], first_family: tuple[int, ...], n_folds: int = 3, trees: int = 30, seed: int = 42) -> None:
        super().__init__(features, n_folds, trees, seed)
        self.first_family = first_family

    def fit(self, rows: DataFrame) -> GatedPrior:
        gated = rows.withColumn("label", F.col("label").isin(*self.first_family).cast("int"))
        if gated.select("label").distinct().count() < 2:
            raise ValueError("both families need rows")
        self.gate = self._fit(gated)
        self.branches: dict[bool, Prior] = {}  # a model for each family's own classes
        for first in (True, False):
            side = rows.filter(F.col("label").isin(*self.first_family) == F.lit(first))
            if side.select("label").distinct().count() > 1:
                self.branches[first] = Prior(self.features, self.n_folds, self.trees, self.seed).fit(side)
        super().fit(rows)
        return self

    def within(self, rows: DataFrame, first: bool) -> DataFrame:
        """object_id and p of the family's own model, over all classes; those of the other family are 0."""
        if first not in self.branches:
            raise LookupError("the family has one class only")
        return self.branches[first].probabilities(rows)

    def probabilities(self, rows: DataFrame) -> DataFrame:
        gate = self.gate.transform(assembled(rows, self.features)).select("object_id", vector_to_array("probability")[1].alias("g"))
        both = super().probabilities(rows).join(gate, "object_id")
        side = F.transform("p", lambda v, i: v * F.when(i.isin(*self.first_family), F.col("g")).otherwise(1 - F.col("g")))
        both = both.withColumn("q", side).withColumn("t", F.greatest(F.aggregate("q", F.lit(0.0), lambda a, v: a + v), F.lit(1e-12)))
        both = both.withColumn("p", F.zip_with("p", "q", lambda a, b: 0.5 * a + 0.5 * b / F.col("t")))
        total = F.aggregate("p", F.lit(0.0), lambda a, v: a + v)
        return both.withColumn("t", F.greatest(total, F.lit(1e-12))).select("object_id", F.transform("p", lambda v: v / F.col("t")).alias("p"))


def bootstrap_uncertainty(train: DataFrame, rows: DataFrame, features: list[str], models: int = 3, share: float = 0.75, seed: int = 42) -> DataFrame:
    """object_id, uncertainty: 0.7 (1 - greatest mean probability) + 0.3 (1 - share of the leading vote)."""
    out = assembled(rows, features).select("object_id", "x")
    for k in range(models):
        part = train.filter(protocol.draw(F.col("object_id"), f"boot-{seed}-{k}") < share)
        model = bare(RandomForestClassifier(labelCol="label", featuresCol="x", numTrees=15, maxDepth=5, seed=seed + k).fit(assembled(part, features)))
        out = model.transform(out).select("object_id", "x", *(f"p{i}" for i in range(k)), vector_to_array("probability").alias(f"p{k}"))
    total = F.col("p0")
    for k in range(1, models):
        total = F.zip_with(total, F.col(f"p{k}"), lambda a, b: a + b)
    votes = F.array(*(F.array_position(f"p{k}", F.array_max(f"p{k}")) for k in range(models)))
    lead = F.array_max(F.transform(votes, lambda v: F.size(F.filter(votes, lambda u: u == v))))
    return out.select("object_id", (0.7 * (1 - F.array_max(total) / models) + 0.3 * (1 - lead / models)).alias("uncertainty"))


def _domain_model(reference: DataFrame, target: DataFrame, covariates: list[str]):
    both = reference.select(*covariates, "object_id").withColumn("is_target", F.lit(0.0)).unionByName(target.select(*covariates, "object_id").withColumn("is_target", F.lit(1.0)))
    z = stages.written(assembled(standardised(both, standardiser(both, covariates)), covariates))  # read by every step of the fit
    n = z.count()
    return z, bare(LogisticRegression(labelCol="is_target", featuresCol="x", regParam=1.0 / max(n, 1)).fit(z))


def density_ratio_weights(reference: DataFrame, target: DataFrame, covariates: list[str], cap: float = 5.0) -> DataFrame:
    """object_id, weight of the reference: odds of belonging to the target, mean 1, clipped."""
    z, model = _domain_model(reference, target, covariates)
    p = model.transform(z.filter("is_target = 0")).select("object_id", vector_to_array("probability")[1].alias("p"))
    odds = p.withColumn("odds", clip(F.col("p"), 1e-6, 1 - 1e-6) / (1 - clip(F.col("p"), 1e-6, 1 - 1e-6)))
    mean = odds.agg(F.avg("odds").alias("mean"))
    return odds.join(F.broadcast(mean)).select("object_id", clip(F.col("odds") / F.col("mean"), 1 / cap, cap).alias("weight"))


def adversarial_validation(reference: DataFrame, target: DataFrame, covariates: list[str], n_folds: int = 3, novelty: DataFrame | None = None) -> DataFrame:
    """Out-of-fold AUC of telling the two apart, with a verdict, and the importances of the covariates."""
    both = reference.select(*covariates, "object_id").withColumn("y", F.lit(0)).unionByName(target.select(*covariates, "object_id").withColumn("y", F.lit(1)))
    z = stages.written(protocol.folds(standardised(both, standardiser(both, covariates)), "y", n_folds, "adversarial"))  # read by every fold's fit
    parts, weights = None, []
    for k in range(n_folds):
        model = bare(RandomForestClassifier(labelCol="y", featuresCol="x", numTrees=20, maxDepth=5, seed=k).fit(assembled(z.filter(F.col("fold") != k), covariates)))
        p = model.transform(assembled(z.filter(F.col("fold") == k), covariates)).select("object_id", "y", F.round(vector_to_array("probability")[1], 9).alias("score"))
        parts = p if parts is None else parts.unionByName(p)
        weights.append(model.featureImportances.toArray())
    auc = metrics.auc_and_ap(parts)
    # Separability below which the two are indistinguishable, weakly and clearly separable.
    verdict = F.when(F.col("roc_auc") < 0.6, "indistinguishable").when(F.col("roc_auc") < 0.75, "weakly separable").when(F.col("roc_auc") < 0.9, "clearly separable").otherwise("trivially separable")
    by_weight = sorted(zip(covariates, np.mean(weights, axis=0).tolist()), key=lambda c: (-c[1], c[0]))
    out = auc.select("roc_auc", verdict.alias("verdict"), F.array(*(F.struct(F.lit(c).alias("covariate"), F.lit(w).alias("importance")) for c, w in by_weight)).alias("importances"))
    if novelty is None:
        return out
    # how far the ranking follows likeness to the target: Pearson, and Spearman as that of the ranks
    own = parts.filter("y = 1").select("object_id", F.col("score").alias("likeness")).join(novelty.select("object_id", "novelty"), "object_id")
    for c in ("likeness", "novelty"):
        own = evidence.quantile_map(own, own, c).withColumnRenamed("mapped", f"rank_{c}")
    return out.join(own.agg(F.corr("likeness", "novelty").alias("pearson"), F.corr("rank_likeness", "rank_novelty").alias("spearman")))


def calibration_cells(rows: DataFrame, confidence: str, nuisance: str, error: str, bins: int = 5, least: int = 40) -> DataFrame:
    """Mean error by quantile bins of confidence and nuisance; thin cells are flagged."""
    edges = ordered.quantiles(rows, [confidence, nuisance], [i / bins for i in range(1, bins)])

    def bin_of(c: str) -> Column:
        return sum((F.col(c) >= e).cast("int") for e in edges.get(c, [0.0]))

    j = rows.withColumns({"c_bin": bin_of(confidence), "n_bin": bin_of(nuisance)})
    return j.groupBy("c_bin", "n_bin").agg(F.count(F.lit(1)).alias("n"), F.avg(error).alias("mean_error")).withColumn("thin", F.col("n") < least)


class Calibrator:
    """Expected error by confidence and nuisance: the cells of ``calibration_cells`` as a fitted state.

    ``transform`` looks a row's cell up; a thin or absent cell takes the mean over its
    confidence bin's cells that are not thin, and where there is none the overall mean.
    ``degenerate`` says that no cell has enough rows, so that all rows get the overall mean."""

    def __init__(self, confidence: str, nuisance: str, error: str, bins: int = 5, least: int = 40) -> None:
        self.confidence, self.nuisance, self.error, self.bins, self.least = confidence, nuisance, error, bins, least

    def fit(self, rows: DataFrame) -> Calibrator:
        rows = stages.written(rows.select(self.confidence, self.nuisance, self.error))
        found = ordered.quantiles(rows, [self.confidence, self.nuisance], [i / self.bins for i in range(1, self.bins)])
        self.edges = {c: found.get(c, []) for c in (self.confidence, self.nuisance)}
        cells = self._binned(rows).groupBy("c_bin", "n_bin").agg(F.count(F.lit(1)).alias("n"), F.avg(self.error).alias("error")).collect()  # bins squared
        known = [c for c in cells if c["error"] is not None]
        total = sum(c["n"] for c in known)
        self.overall = sum(c["n"] * c["error"] for c in known) / total if total else 0.0
        self.cells = {(c["c_bin"], c["n_bin"]): (c["n"], c["error"]) for c in known}
        fat = {k: v for k, v in self.cells.items() if v[0] >= self.least}
        self.degenerate = not fat
        self.table = {}
        for c in range(self.bins):
            row = [v for k, v in fat.items() if k[0] == c]
            fallback = sum(n * e for n, e in row) / sum(n for n, _ in row) if row else self.overall
            for n in range(self.bins):
                self.table[c, n] = fat[c, n][1] if (c, n) in fat else fallback
        return self

    def _binned(self, rows: DataFrame) -> DataFrame:
        place = lambda c: sum(((F.coalesce(F.col(c) >= e, F.lit(False))).cast("int") for e in self.edges[c]), F.lit(0))
        return rows.withColumns({"c_bin": place(self.confidence), "n_bin": place(self.nuisance)})

    def transform(self, rows: DataFrame) -> DataFrame:
        """Adds expected_error and from_cell (whether the row's own cell was full enough)."""
        fat = [k for k, v in self.cells.items() if v[0] >= self.least]
        key = F.col("c_bin") * self.bins + F.col("n_bin")
        value = F.element_at(F.array(*(F.lit(float(self.table[c, n])) for c in range(self.bins) for n in range(self.bins))), key + 1)
        own = key.isin([c * self.bins + n for c, n in fat]) if fat else F.lit(False)
        return self._binned(rows).withColumns({"expected_error": value, "from_cell": own}).drop("c_bin", "n_bin")

    def coverage(self, rows: DataFrame) -> DataFrame:
        """One row: n, the share of rows whose own cell is full enough, mean expected and true error, degenerate."""
        t = self.transform(rows)
        return t.agg(F.count(F.lit(1)).alias("n"), F.avg(F.col("from_cell").cast("double")).alias("coverage"), F.avg("expected_error").alias("mean_expected"), F.avg(self.error).alias("mean_error")).withColumn("degenerate", F.lit(self.degenerate))
