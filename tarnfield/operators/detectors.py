"""Unsupervised detectors and their fused score: an audit channel of weight zero.

Each detector is a column; each is mapped to its mid-rank among the reference, and
the score is the mean of these, so that a row's score does not depend on its batch.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tarnfield.operators import evidence, isolation, models

#: Places at which detector values are compared: last bits may differ with the batch.
PLACES = 9


class DetectorEnsemble:
    """Mahalanobis distance, principal-component residual and isolation of all rows, and
    with ``near`` the mean distance to a stated query set's neighbours."""

    def __init__(self, features: list[str], components: int = 24, trees: int = 100) -> None:
        self.features, self.components, self.trees = features, max(1, min(components, len(features) - 1)), trees

    def fit(self, reference: DataFrame) -> DetectorEnsemble:
        """An empty reference raises ValueError."""
        if reference.limit(1).count() == 0:
            raise ValueError("no reference rows")
        self.moments = models.AnomalyEnsemble(self.features, self.components).fit(reference)
        self.forest = isolation.IsolationForest(self.features, self.trees).fit(reference)
        self.reference = reference
        return self

    def _values(self, rows: DataFrame, near: DataFrame | None) -> tuple[DataFrame, list[str]]:
        names = ["mahalanobis", "pca_residual", "isolation"]
        out = self.moments.distances(rows).join(self.forest.score(rows), "object_id").select("object_id", *(F.round(n, PLACES).alias(n) for n in names))
        if near is not None:
            far = near.groupBy(F.col("query_id").alias("object_id")).agg(F.round(F.avg("distance"), PLACES).alias("knn_distance"))
            out, names = out.join(far, "object_id"), [*names, "knn_distance"]
        return out, names

    def score(self, rows: DataFrame, near: DataFrame | None = None, reference_near: DataFrame | None = None) -> DataFrame:
        """object_id, the detectors' values, and anomaly_score. ``near`` and
        ``reference_near`` are the neighbours (evidence.neighbours) of rows and of reference rows."""
        out, names = self._values(rows, near)
        known, _ = self._values(self.reference, reference_near if near is not None else None)
        for n in names:
            out = evidence.quantile_map(out, known, n).withColumnRenamed("mapped", f"rank_{n}")
        return out.select("object_id", *names, (sum(F.col(f"rank_{n}") for n in names) / len(names)).alias("anomaly_score"))
