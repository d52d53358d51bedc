"""Read-only views of a stored queue, one function per endpoint of a service."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tarnfield import VERSION
from tarnfield.operators import metrics, ranking
from tarnfield.schema import KNOWN, finite, taxonomy

MAX_PAGE = 500


def candidates(queue: DataFrame, limit: int = 50, offset: int = 0, tier: str | None = None, family: str | None = None, abstained: bool | None = None) -> tuple[DataFrame, DataFrame]:
    """A filtered page by rank, and the number of rows before paging."""
    if not 1 <= limit <= MAX_PAGE or offset < 0:
        raise ValueError("limit must be 1 to 500 and offset not negative")
    tax = taxonomy(queue.sparkSession).select(F.col("code").alias("best_fit_code"), F.col("name").alias("best_fit"), "family")
    q = queue.join(F.broadcast(tax), "best_fit_code", "left").withColumn("family", F.coalesce("family", F.lit("unknown")))
    for column, value in (("tier", tier), ("family", family), ("abstain", abstained)):
        if value is not None:
            q = q.filter(F.col(column) == value)
    return q.orderBy("rank").limit(offset + limit).offset(offset), q.agg(F.count(F.lit(1)).alias("total"))


def candidate(queue: DataFrame, object_id: int) -> DataFrame:
    return queue.filter(F.col("object_id") == object_id)


def summary(queue: DataFrame) -> DataFrame:
    return queue.agg(F.count(F.lit(1)).alias("n"), *(F.count_if(F.col("tier") == t).alias(t) for t in ("critical", "high", "moderate", "routine")), F.avg(F.col("abstain").cast("double")).alias("abstention_rate"), F.min("score").alias("min_score"), F.max("score").alias("max_score"))


def classes(spark: SparkSession) -> DataFrame:
    return taxonomy(spark).withColumn("in_known_prior", F.col("code").isin(*KNOWN)).orderBy("code")


def records(queue: DataFrame, weights: dict[str, float], limit: int | None = None, explanations: DataFrame | None = None) -> DataFrame:
    """object_id and ``document``: the nested JSON record of each ranked candidate.

    Evidence has six places, other numbers four; a candidate without an explanation
    (object_id, explanation as JSON) has an empty one. Numbers that are not finite are null."""
    if limit is not None:
        queue = queue.orderBy("rank").limit(limit)
    norm = ranking.normalised(weights)
    tax = taxonomy(queue.sparkSession).select(F.col("code").alias("best_fit_code"), F.coalesce("name", F.lit("unknown")).alias("best_fit_class"))
    q = queue.join(F.broadcast(tax), "best_fit_code", "left")  # the taxonomy has nineteen rows
    if explanations is not None:
        q = q.join(explanations.select("object_id", "explanation"), "object_id", "left")
    number = lambda c, places: F.round(finite(F.col(c)), places)
    present = [c for c in ranking.CHANNELS if c in queue.columns]
    evidence = F.struct(*(number(c, 6).alias(c) for c in present))
    weighted = F.struct(*(F.round(finite(F.col(c)) * norm.get(c, 0.0), 6).alias(c) for c in present))
    own = [number(c, 4).alias(c) for c in ("quality", "uncertainty", "confidence", "reliability", "best_fit_prob") if c in queue.columns]
    truth = [(F.col("y") == 1).alias("is_novel")] if "y" in queue.columns else []
    text = F.coalesce(F.col("explanation"), F.lit("{}")) if explanations is not None else F.lit("{}")
    record = F.struct("rank", "object_id", number("score", 6).alias("novelty_score"), "tier", evidence.alias("evidence"), weighted.alias("weighted_evidence"), *own, "abstain", "abstain_reason", F.coalesce("best_fit_class", F.lit("unknown")).alias("best_fit_class"), *truth, text.alias("explanation"))
    return q.select("object_id", F.to_json(record).alias("document"))


def health(spark: SparkSession, queue: DataFrame, metrics: DataFrame | None, light_curves: DataFrame | None) -> DataFrame:
    """One row: version, rows of the queue, and whether metrics and light curves are there."""
    have = [F.lit(x is not None and x.limit(1).count() > 0).alias(n) for n, x in (("metrics", metrics), ("light_curves", light_curves))]
    return queue.agg(F.count(F.lit(1)).alias("candidates")).select(F.lit("ok").alias("status"), F.lit(VERSION).alias("version"), F.lit(spark.version).alias("spark"), "candidates", *have)


def evaluation(metrics: DataFrame | None) -> DataFrame:
    """The stored metrics; an error where none have been stored."""
    if metrics is None or metrics.limit(1).count() == 0:
        raise LookupError("no metrics have been stored")
    return metrics


def light_curve(points: DataFrame, object_id: int) -> DataFrame:
    """One row: counts, time range and the points of an object; none for an unknown one."""
    p = points.filter(F.col("object_id") == object_id)
    point = F.struct("mjd", "passband", "flux", "flux_err", (F.col("detected_bool") == 1).alias("detected"))
    return p.groupBy("object_id").agg(F.count(F.lit(1)).alias("n_points"), F.count_if(F.col("detected_bool") == 1).alias("n_detections"), F.array(F.min("mjd"), F.max("mjd")).alias("mjd_range"), F.array_sort(F.collect_list(point)).alias("points"))


def report(ranked: DataFrame, name: str, channels: list[str]) -> DataFrame:
    """One JSON document of a benchmark: metrics, audit of the queue's head, classes' places,
    channels' power, tiers and abstentions. ``ranked`` has score, y, grp and the queue's columns."""
    rows = ranked.select("object_id", "score", "y", "grp")
    each = ranked.select("object_id", "y", F.explode(F.array(*(F.struct(F.lit(c).alias("channel"), F.round(c, 9).alias("score")) for c in channels))).alias("v")).select("object_id", "y", "v.*")
    parts = {
        "metrics": metrics.evaluate(rows), "audit": metrics.audit(ranked), "classes": metrics.per_class(rows, 200), "channels": metrics.auc_and_ap(each, ["channel"]),
        "tiers": ranked.groupBy("tier").agg(F.count(F.lit(1)).alias("n"), F.count_if("abstain").alias("abstained")),
    }
    out = ranked.sparkSession.range(1).select(F.lit(name).alias("benchmark"))
    for part, df in parts.items():  # each is a handful of rows
        clean = [F.round(finite(F.col(c)), 6).alias(c) if t == "double" else F.col(c) for c, t in df.dtypes]
        out = out.join(F.broadcast(df.agg(F.collect_list(F.struct(*clean)).alias(part))))
    return out.select("benchmark", F.to_json(F.struct("*")).alias("document"))


def documents(queue: DataFrame) -> DataFrame:
    """The queue's rows as JSON documents, doubles at six places, null where they are not finite."""
    cols = [F.round(finite(F.col(c)), 6).alias(c) if t == "double" else F.col(c) for c, t in queue.dtypes]
    return queue.select("object_id", F.to_json(F.struct(*cols)).alias("document"))
