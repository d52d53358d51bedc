"""Queries over the whole chain: the queue, its metrics, early detection and corruptions.

The engine is fitted on the known objects of one split and scores all objects of the
other. Shortened or corrupted observations are scored as objects of their own by the
engine of the clean ones; their ids are below zero, so that they clash with no other.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tarnfield.operators import engine, features, inject, metrics, ordered, protocol, ranking
from tarnfield.schema import KNOWN
from tarnfield.sources import stages, views

NAMES = [f"lc_{c}" for c in ("flux_max", "flux_mean", "flux_std", "snr_max", "snr_median", "err_mean", "dflux_max", "t_span", "det_frac", "variability", "points_per_day")] + ["col_gmr", "col_rmi", "col_imz", "col_dt_gmr", "col_temp_proxy", "col_n_bands_positive"]
PLACES, NUDGE = 5, 3.7e-8
SIDES, FIT_SHARE = 16, 0.6
#: Days of the shortened views; 0 is all of them.
DAYS = (15, 30, 60, 120, 0)
SCENARIOS = ("clean", *inject.INJECTORS)


def _rows(obs: DataFrame, meta: DataFrame) -> DataFrame:
    """Features at five places, so that other arithmetic finds the same ties."""
    out = engine.gated(obs, meta, NAMES)
    return out.withColumns({c: F.round(F.col(c).cast("double") + NUDGE, PLACES) + 0.0 for c in NAMES})


def _truth(spark: SparkSession, sf_dir: str) -> DataFrame:
    """object_id, label (place among the known codes, or null), y (withheld population), fits."""
    label = F.array_position(F.array(*map(F.lit, KNOWN)), F.col("code")).cast("int") - 1
    m = views.metadata(spark, sf_dir).select("object_id", F.when(label >= 0, label).alias("label"))
    return m.withColumns({"y": F.col("label").isNull().cast("int"), "fits": protocol.draw(F.col("object_id"), "chain") < FIT_SHARE})


def fitted(spark: SparkSession, sf_dir: str) -> tuple[engine.NoveltyEngine, DataFrame, DataFrame]:
    """The engine, the rows that it has not seen, and the truth."""
    truth = stages.written(_truth(spark, sf_dir))
    rows = stages.written(_rows(views.photometry(spark, sf_dir), views.metadata(spark, sf_dir)).join(truth, "object_id"))
    return engine.NoveltyEngine(NAMES).fit(rows.filter("fits AND label IS NOT NULL").drop("y", "fits")), rows.filter("NOT fits").drop("label", "fits"), truth


def queue(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The ranked queue of the unseen objects, from their observations on."""
    model, rows, truth = fitted(spark, sf_dir)
    scored = stages.written(model.score(rows).join(truth.select("object_id", "y"), "object_id").withColumn("score", F.round("score", 9)))
    return ranking.rank(scored)


def side_id(number: Column) -> Column:
    return -(F.col("object_id") * SIDES + number) - 1


def sides(spark: SparkSession, sf_dir: str, vary: Callable[[DataFrame], DataFrame], side: str, order: tuple) -> DataFrame:
    """object_id, side, score, quality and y of the unseen objects in every side of their
    observations. ``vary`` makes the sides, object by object, of what the unseen ones have."""
    model, _, truth = fitted(spark, sf_dir)
    number = F.array_position(F.array(*map(F.lit, order)), F.col(side)) - 1
    unseen = views.photometry(spark, sf_dir).join(truth.filter("NOT fits").select("object_id"), "object_id", "left_semi")
    keyed = vary(unseen).withColumn("object_id", side_id(number))
    meta = views.metadata(spark, sf_dir).withColumn("object_id", F.explode(F.array(*(side_id(F.lit(k)) for k in range(len(order))))))
    own = -F.col("object_id") - 1
    scored = model.score(_rows(keyed, meta)).select(F.floor(own / SIDES).cast("long").alias("object_id"), F.element_at(F.array(*map(F.lit, order)), (own % SIDES).cast("int") + 1).alias(side), F.round("score", 6).alias("score"), "quality")
    return scored.join(truth.select("object_id", "y"), "object_id")


def shortened(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sides(spark, sf_dir, lambda obs: features.views(obs, DAYS).withColumn("days", F.col("view").cast("int")), "days", DAYS)


def corrupted(spark: SparkSession, sf_dir: str) -> DataFrame:
    scored = sides(spark, sf_dir, inject.scenarios, "scenario", SCENARIOS)
    return stages.written(ordered.numbered(scored, -F.col("score"), [F.desc("score"), F.col("object_id")], "rank", ["scenario"], F.col("object_id")))


def early(spark: SparkSession, sf_dir: str) -> DataFrame:
    """AUC, average precision, precision at 50 and recall at 200 of each shortened view."""
    return metrics.evaluate(shortened(spark, sf_dir), ["days"], (50,), (200,))
