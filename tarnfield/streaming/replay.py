"""Alert files as a stream: an extension, the batch operators run unchanged on it."""

from __future__ import annotations

import time
from collections.abc import Callable

from pyspark.sql import DataFrame, Observation, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from tarnfield.sources import alerts, stages


def alert_stream(spark: SparkSession, folder: str, files_per_trigger: int = 10) -> DataFrame:
    lines = spark.readStream.format("text").option("maxFilesPerTrigger", files_per_trigger).load(folder)
    return alerts.packets(lines)


#: A scoring path: packets without errors to rows with alert_id and score (null: it failed).
Score = Callable[[DataFrame], DataFrame]
FAILURES = 20


def _scored(batch: DataFrame, score: Score | None) -> DataFrame:
    """The packets with score and, where scoring gave none, an error; counts are observed as they pass."""
    if score is None:
        return batch.withColumn("score", F.lit(None).cast("double"))
    own = score(batch.filter(F.size("errors") == 0)).select(F.col("alert_id").alias("_alert"), F.col("score").cast("double").alias("score")).dropDuplicates(["_alert"])
    out = batch.join(own, F.col("alert_id") == F.col("_alert"), "left").drop("_alert")
    return out.withColumn("errors", F.when((F.size("errors") == 0) & F.col("score").isNull(), F.array(F.lit("scoring failed"))).otherwise(F.col("errors")))


def _report(written: DataFrame, seen: dict, seconds: float) -> DataFrame:
    """One row: n_packets, n_succeeded, n_failed, elapsed_s, throughput, first_failures."""
    first = [(r["alert_id"], r["survey"], r["error"]) for r in alerts.failures(written, FAILURES).collect()]
    n = seen["n"]
    row = (n, seen["ok"], n - seen["ok"], seconds, n / seconds if seconds > 0 else 0.0, first)
    return written.sparkSession.createDataFrame([row], "n_packets long, n_succeeded long, n_failed long, elapsed_s double, throughput double, first_failures array<struct<alert_id: string, survey: string, error: string>>")


def replay_file(spark: SparkSession, path: str, score: Score | None = None, limit: int | None = None) -> tuple[DataFrame, DataFrame]:
    """The packets of a file with their scores, and the report of the run. A packet that
    cannot be read or scored is counted and the others go on. ``limit`` takes the first
    packets only. Counts are taken while the packets are written, not by reading them again."""
    began, seen = time.perf_counter(), Observation()
    packets = alerts.read_packets(spark, path)
    rows = _scored(packets if limit is None else stages.written(packets.limit(limit)), score)
    ok = F.size("errors") == 0
    written = stages.written(rows.observe(seen, F.count(F.lit(1)).alias("n"), F.count_if(ok).alias("ok")))
    return written, _report(written, seen.get, time.perf_counter() - began)


def replay(spark: SparkSession, folder: str, out: str, checkpoint: str, score: Score | None = None) -> StreamingQuery:
    """Good packets' observations go to ``out``, failures to ``out``_errors, with ``score``
    their scores to ``out``_scores, and each batch's report to ``out``_report; each batch once.

    A batch's number names its folder, so one that is run again replaces itself."""

    def write(batch: DataFrame, number: int) -> None:
        began, seen = time.perf_counter(), Observation()
        rows = stages.written(_scored(batch, score).observe(seen, F.count(F.lit(1)).alias("n"), F.count_if(F.size("errors") == 0).alias("ok")))
        alerts.to_photometry(rows).write.mode("overwrite").parquet(f"{out}/batch={number}")
        rows.filter(F.size("errors") > 0).select("value", "errors").write.mode("overwrite").parquet(f"{out}_errors/batch={number}")
        if score is not None:
            rows.filter(F.size("errors") == 0).select("alert_id", "object_id", "score").write.mode("overwrite").parquet(f"{out}_scores/batch={number}")
        _report(rows, seen.get, time.perf_counter() - began).write.mode("overwrite").parquet(f"{out}_report/batch={number}")
        stages.drop(rows)

    return alert_stream(spark, folder).writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def running_counts(obs: DataFrame, delay: str = "1 day", width: str = "1 day") -> DataFrame:
    """Observations and detections by object in event-time windows, late data up to ``delay``."""
    return obs.withWatermark("ts", delay).groupBy(F.window("ts", width), "object_id").agg(F.count(F.lit(1)).alias("n_obs"), F.sum("detected_bool").alias("n_det"))
