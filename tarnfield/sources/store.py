"""Stores that stay readable: snapshots with a pointer that is put last, and light curves in buckets."""

from __future__ import annotations

import json
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def _fs(spark: SparkSession, path: str):
    """The file system of ``path`` and the path, as the JVM has them."""
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    return at.getFileSystem(spark._jsc.hadoopConfiguration()), at


def _names(spark: SparkSession, path: str) -> list[str]:
    fs, at = _fs(spark, path)
    return sorted(s.getPath().getName() for s in fs.listStatus(at)) if fs.exists(at) else []


def _put(spark: SparkSession, path: str, text: str) -> None:
    """A file that is there whole or not at all; one that is there already raises."""
    fs, at = _fs(spark, path)
    _, tmp = _fs(spark, f"{path.rsplit('/', 1)[0]}/.{uuid.uuid4().hex}")
    out = fs.create(tmp, False)
    out.write(bytearray(text.encode()))
    out.close()
    if fs.exists(at) or not fs.rename(tmp, at):
        fs.delete(tmp, False)
        raise FileExistsError(path)


def _get(spark: SparkSession, path: str) -> str:
    fs, at = _fs(spark, path)
    stream = fs.open(at)
    try:
        return bytes(stream.readAllBytes()).decode()
    finally:
        stream.close()


def replace(df: DataFrame, out: str) -> None:
    """Write ``df`` beside ``out`` and put it in its place once it stands: a write that
    fails leaves the old table as it was, and ``df`` may read it."""
    spark = df.sparkSession
    beside, old = f"{out.rstrip('/')}.new-{uuid.uuid4().hex}", f"{out.rstrip('/')}.old-{uuid.uuid4().hex}"
    fs, new_at = _fs(spark, beside)
    try:
        df.write.parquet(beside)
    except Exception:
        fs.delete(new_at, True)
        raise
    _, out_at = _fs(spark, out)
    _, old_at = _fs(spark, old)
    had = fs.exists(out_at)
    if had:
        fs.rename(out_at, old_at)
    fs.rename(new_at, out_at)
    if had:
        fs.delete(old_at, True)


class Snapshots:
    """Versions of one table below a path. A version counts once its pointer, the last thing
    to be written, is there; readers see the newest one, or one they name."""

    def __init__(self, spark: SparkSession, path: str) -> None:
        self.spark, self.path = spark, path.rstrip("/")

    def versions(self) -> list[int]:
        return [int(n) for n in _names(self.spark, f"{self.path}/_versions") if n.isdigit()]

    def publish(self, df: DataFrame, note: dict | None = None) -> int:
        """Write a new version; what failed before leaves nothing that is read. Of two writers
        at once the later one raises FileExistsError."""
        number = max(self.versions(), default=0) + 1
        folder = f"data-{number:08d}-{uuid.uuid4().hex}"
        df.write.parquet(f"{self.path}/{folder}")
        _put(self.spark, f"{self.path}/_versions/{number:08d}", json.dumps({"folder": folder, "note": note or {}}))
        return number

    def _pointer(self, version: int | None) -> dict:
        have = self.versions()
        number = version if version is not None else max(have, default=0)
        if number not in have:
            raise FileNotFoundError(f"no version {number or ''} of {self.path}")
        return json.loads(_get(self.spark, f"{self.path}/_versions/{number:08d}"))

    def read(self, version: int | None = None) -> DataFrame:
        return self.spark.read.parquet(f"{self.path}/{self._pointer(version)['folder']}")

    def note(self, version: int | None = None) -> dict:
        return self._pointer(version)["note"]

    def prune(self, keep: int = 2) -> None:
        """Delete all but the newest ``keep`` versions, and data that no version points at."""
        gone = self.versions()[:-keep] if keep else self.versions()
        for number in gone:
            fs, at = _fs(self.spark, f"{self.path}/_versions/{number:08d}")
            fs.delete(at, False)
        used = {self._pointer(v)["folder"] for v in self.versions()}
        for name in _names(self.spark, self.path):
            if name.startswith("data-") and name not in used:
                fs, at = _fs(self.spark, f"{self.path}/{name}")
                fs.delete(at, True)


class FeedbackLog:
    """Verdicts: each is a small file of its own until ``compact`` gathers them in a snapshot."""

    VERDICTS = ("novel", "known", "artifact", "unclear")

    def __init__(self, spark: SparkSession, path: str) -> None:
        self.spark, self.log, self.whole = spark, f"{path.rstrip('/')}/log", Snapshots(spark, f"{path.rstrip('/')}/whole")

    def append(self, object_id: int, verdict: str, note: str = "", reviewer: str = "") -> None:
        if verdict not in self.VERDICTS:
            raise ValueError(verdict)
        row = self.spark.createDataFrame([(object_id, verdict, note[:2000], reviewer[:80])], "object_id long, verdict string, note string, reviewer string")
        row.withColumn("at", F.current_timestamp()).coalesce(1).write.mode("append").parquet(self.log)

    def _open(self) -> list[str]:
        """Files of the log that no snapshot has."""
        done = set(self.whole.note()["files"]) if self.whole.versions() else set()
        return [n for n in _names(self.spark, self.log) if n.endswith(".parquet") and n not in done]

    def read(self) -> DataFrame:
        parts = [self.whole.read()] if self.whole.versions() else []
        if files := self._open():
            parts.append(self.spark.read.parquet(*(f"{self.log}/{n}" for n in files)))
        if not parts:
            return self.spark.createDataFrame([], "object_id long, verdict string, note string, reviewer string, at timestamp")
        return parts[0] if len(parts) == 1 else parts[0].unionByName(parts[1])

    def tail(self, n: int = 50) -> DataFrame:
        return self.read().orderBy(F.desc("at")).limit(n)

    def compact(self, files: int = 1) -> None:
        """Gather the log in one snapshot; its files go only once that stands."""
        taken = self._open()
        if not taken:
            return
        self.whole.publish(self.read().coalesce(files), {"files": taken})
        for n in taken:
            fs, at = _fs(self.spark, f"{self.log}/{n}")
            fs.delete(at, False)


class LightCurveStore:
    """Observations in buckets of a hash of their object, each sorted by object and time,
    with bloom filters over the ids: one look-up reads one bucket, and features need no
    exchange of observations."""

    def __init__(self, spark: SparkSession, path: str) -> None:
        self.spark, self.path = spark, path.rstrip("/")

    def write(self, obs: DataFrame, buckets: int = 64) -> None:
        """A new store beside the old one, which stays until the new one stands."""
        name, at = f"store_{uuid.uuid4().hex}", f"{self.path}/data-{uuid.uuid4().hex}"
        dealt = obs.repartition(buckets, "object_id")  # the hash of the buckets: a file for each
        dealt.write.bucketBy(buckets, "object_id").sortBy("object_id", "mjd").option("parquet.bloom.filter.enabled#object_id", "true").option("path", at).format("parquet").saveAsTable(name)
        self.spark.sql(f"DROP TABLE {name}")  # the table goes, its files stay
        number = max((int(n) for n in _names(self.spark, f"{self.path}/_versions") if n.isdigit()), default=0) + 1
        _put(self.spark, f"{self.path}/_versions/{number:08d}", json.dumps({"at": at, "buckets": buckets, "columns": obs.schema.json()}))

    def read(self) -> DataFrame:
        have = [n for n in _names(self.spark, f"{self.path}/_versions") if n.isdigit()]
        if not have:
            raise FileNotFoundError(self.path)
        own = json.loads(_get(self.spark, f"{self.path}/_versions/{have[-1]}"))
        name = f"curves_{own['at'].rsplit('-', 1)[-1]}"
        if not self.spark.catalog.tableExists(name):
            from pyspark.sql.types import StructType

            kinds = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in StructType.fromJson(json.loads(own["columns"])))
            self.spark.sql(f"CREATE TABLE {name} ({kinds}) USING parquet CLUSTERED BY (object_id) SORTED BY (object_id, mjd) INTO {own['buckets']} BUCKETS LOCATION '{own['at']}'")
        return self.spark.table(name)

    def light_curve(self, object_id: int) -> DataFrame:
        return self.read().filter(F.col("object_id") == object_id).orderBy("mjd")
