"""Readers, sinks and the light-curve table."""

from __future__ import annotations

from pyspark.sql import DataFrame, Observation, SparkSession, Window
from pyspark.sql import functions as F

from tarnfield.operators import ordered
from tarnfield.operators.features import aligned
from tarnfield.schema import METADATA, PHOTOMETRY, finite
from tarnfield.sources import store


def _nulls(df: DataFrame) -> DataFrame:
    return df.select(*(finite(F.col(c)).cast(t).alias(c) if t in ("float", "double") else F.col(c) for c, t in df.dtypes))


def read_photometry(spark: SparkSession, path: str, ids: DataFrame | None = None) -> DataFrame:
    """Observations from CSV (also gzip) by the fixed schema; NaN and infinities are null."""
    obs = _nulls(spark.read.schema(PHOTOMETRY).option("header", True).csv(path))
    return obs.join(ids, "object_id", "left_semi") if ids is not None else obs


def read_metadata(spark: SparkSession, path: str, ids: DataFrame | None = None, label: str | None = None) -> DataFrame:
    """Metadata from CSV; a label column that is all zero (blinded) raises."""
    columns = spark.read.option("header", True).csv(path).columns
    schema = METADATA if label is None else type(METADATA)([*METADATA.fields]).add(label, "int")
    raw = spark.read.option("header", True).csv(path).select(*(c for c in schema.names if c in columns))
    meta = _nulls(raw.select(*(F.col(f.name).cast(f.dataType).alias(f.name) for f in schema.fields if f.name in columns)))
    if label is not None:
        if meta.agg(F.coalesce(F.bool_and(F.col(label) == 0), F.lit(False))).first()[0]:
            raise ValueError(f"{label} is zero throughout: the table is blinded")
        meta = meta.withColumnRenamed(label, "target")
    return meta.join(ids, "object_id", "left_semi") if ids is not None else meta


def harvest(obs: DataFrame, ids: DataFrame, out: str) -> DataFrame:
    """Filtered copy to Parquet, sorted for lookups; returns its counts (rows, objects), which
    are taken while it is written, and raises if nothing was selected. The old copy stays
    until the new one stands."""
    first = F.row_number().over(Window.partitionBy("object_id").orderBy("mjd")) == 1
    seen = Observation()
    rows = obs.join(ids, "object_id", "left_semi").repartitionByRange("object_id").withColumn("_first", first).sortWithinPartitions("object_id", "mjd")
    rows = rows.observe(seen, F.count(F.lit(1)).alias("rows"), F.coalesce(F.sum(F.col("_first").cast("long")), F.lit(0)).alias("objects"))
    store.replace(rows.drop("_first"), out)
    if not seen.get["rows"]:
        raise ValueError("no observations of these objects")
    return obs.sparkSession.createDataFrame([(seen.get["rows"], seen.get["objects"])], "rows long, objects long")


def write_light_curves(obs: DataFrame, out: str) -> None:
    """Ranges of objects, each file sorted by object and time, so that statistics prune lookups."""
    store.replace(obs.repartitionByRange("object_id").sortWithinPartitions("object_id", "mjd"), out)


def light_curve(spark: SparkSession, path: str, object_id: int) -> DataFrame:
    return spark.read.parquet(path).filter(F.col("object_id") == object_id).orderBy("mjd")


def light_curves(spark: SparkSession, path: str, ids: list[int] | None = None) -> DataFrame:
    """The observations of the named objects (of all, if none are named); an unknown id raises KeyError."""
    rows = spark.read.parquet(path)
    if ids is None:
        return rows
    rows = rows.filter(F.col("object_id").isin(*ids))
    missing = set(ids) - {r[0] for r in rows.select("object_id").distinct().collect()}  # as many as were asked for
    if missing:
        raise KeyError(f"unknown objects: {sorted(missing)}")
    return rows


def known_ids(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.parquet(path).select("object_id").distinct()


def stored(spark: SparkSession, path: str) -> DataFrame:
    """One row: files and bytes below a path, and rows, of a Parquet table or of CSV text without its header lines."""
    kind = "parquet" if path.rstrip("/").endswith(".parquet") or not path.endswith((".csv", ".csv.gz")) else "csv"
    rows = spark.read.option("header", True).format(kind).load(path)
    files = rows.select("_metadata.file_path", "_metadata.file_size")
    return files.groupBy("file_path", "file_size").agg(F.count(F.lit(1)).alias("n")).agg(F.count(F.lit(1)).alias("files"), F.sum("file_size").alias("bytes"), F.sum("n").alias("rows"))


def read_features(spark: SparkSession, path: str, names: list[str] | None = None) -> DataFrame:
    """Stored features as doubles; with ``names`` exactly these, missing ones 0."""
    rows = spark.read.parquet(path)
    rows = rows.select(*(F.col(c).cast("double").alias(c) if t == "float" else F.col(c) for c, t in rows.dtypes))
    return rows if names is None else aligned(rows, ["object_id", *names])


def write_features(features: DataFrame, out: str) -> None:
    """Doubles as floats; the old table stays until the new one stands."""
    store.replace(features.select(*(F.col(c).cast("float").alias(c) if t == "double" else F.col(c) for c, t in features.dtypes)), out)


def learn_fill(reference: DataFrame) -> dict[str, float]:
    """Medians of the reference's double columns; one row comes to the driver."""
    names = [c for c, t in reference.dtypes if t in ("double", "float")]
    found = ordered.quantiles(_nulls(reference), names, [0.5])
    return {c: found.get(c, [0.0])[0] for c in names}


def fill(features: DataFrame, medians: dict[str, float]) -> DataFrame:
    return features.withColumns({c: F.coalesce(F.col(c), F.lit(m)).cast("float") for c, m in medians.items()})


def append_feedback(spark: SparkSession, path: str, object_id: int, verdict: str, note: str = "", reviewer: str = "") -> None:
    store.FeedbackLog(spark, path).append(object_id, verdict, note, reviewer)


def feedback_tail(spark: SparkSession, path: str, n: int = 50) -> DataFrame:
    return store.FeedbackLog(spark, path).tail(n)
