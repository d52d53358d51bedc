"""Intermediate tables that cut lineage, in the folder that driver and executors share.

What nobody has dropped goes when the driver's Python ends."""

from __future__ import annotations

import atexit
import uuid

from pyspark.sql import DataFrame, SparkSession

_left: dict[str, SparkSession] = {}


def folder(spark: SparkSession) -> str:
    """``spark.checkpoint.dir``; on a local master without it a folder below the warehouse."""
    own = spark.conf.get("spark.checkpoint.dir", None)
    if not own:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
        own = spark.conf.get("spark.sql.warehouse.dir").rstrip("/") + "/_stages"
    return own.rstrip("/")


def written(df: DataFrame) -> DataFrame:
    """``df``, computed once and read back without its lineage; the files survive lost executors."""
    path = f"{folder(df.sparkSession)}/stage-{uuid.uuid4().hex}"
    _left[path] = df.sparkSession
    df.write.parquet(path)
    back = df.sparkSession.read.schema(df.schema).parquet(path)
    back._stage_path = path
    return back


def _delete(spark: SparkSession, name: str) -> None:
    path = spark._jvm.org.apache.hadoop.fs.Path(name)
    path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)
    _left.pop(name, None)


def drop(df: DataFrame) -> None:
    """Delete the files of a written table that nothing reads any more."""
    _delete(df.sparkSession, df._stage_path)


@atexit.register
def drop_all() -> None:
    """Delete what is left. A session that has been stopped leaves its tables."""
    for name, spark in list(_left.items()):
        try:
            if spark.sparkContext._jsc is not None:
                _delete(spark, name)
        except Exception:  # noqa: BLE001 - the driver ends either way
            return
