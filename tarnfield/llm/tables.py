"""Intermediate tables in the folder that driver and executors share.

Lineage is cut by writing Parquet below ``spark.checkpoint.dir``; the files
survive the loss of any executor. The setting is read from the session; where it is
unset a folder below the warehouse is used on a local master (tests, a laptop), and
on a cluster an error says so. Tables that an operator is done with are dropped; those
that a returned result still reads go when the driver's Python ends.
"""

from __future__ import annotations

import atexit
import uuid

from pyspark.sql import DataFrame, SparkSession

_left: dict[str, SparkSession] = {}


def shared_folder(spark: SparkSession) -> str:
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if not folder:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
        folder = spark.conf.get("spark.sql.warehouse.dir").rstrip("/") + "/_tarnfield"
    return folder.rstrip("/")


def materialise(df: DataFrame) -> DataFrame:
    """Write ``df`` once and return it read back, without its lineage."""
    spark = df.sparkSession
    path = f"{shared_folder(spark)}/tarnfield-{uuid.uuid4().hex}"
    _left[path] = spark
    df.write.parquet(path)
    back = spark.read.schema(df.schema).parquet(path)
    back._tarnfield_path = path
    return back


def _delete(spark: SparkSession, path: str) -> None:
    jvm = spark._jvm
    target = jvm.org.apache.hadoop.fs.Path(path)
    target.getFileSystem(spark._jsc.hadoopConfiguration()).delete(target, True)
    _left.pop(path, None)


@atexit.register
def drop_all() -> None:
    """Delete what is left. A session that has been stopped leaves its tables."""
    for path, spark in list(_left.items()):
        try:
            if spark.sparkContext._jsc is not None:
                _delete(spark, path)
        except Exception:  # noqa: BLE001 - the driver ends either way
            return


def drop(df: DataFrame) -> None:
    """Delete the files of a table that nothing reads any more."""
    _delete(df.sparkSession, df._tarnfield_path)


def fresh(names: list[str], taken: list[str]) -> list[str]:
    """``names``, each with underscores in front until none clashes with ``taken``."""
    used = {x.lower() for x in taken}
    out = []
    for name in names:
        while name.lower() in used:
            name = "_" + name
        used.add(name.lower())
        out.append(name)
    return out


def shuffle_partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))
