"""Time-series views over the generic tables, and their SQL twins."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tarnfield.schema import CODES, KNOWN

BAND_OF = {"click": 0, "error": 1, "purchase": 2, "signup": 3, "view": 4}


def photometry(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events as observations: users are objects, event types bands, value - 60 flux."""
    e = spark.read.parquet(f"{sf_dir}/events.parquet")
    flux, err = F.col("value") - 60.0, 5.0 + F.pmod(F.col("event_id"), F.lit(7)).cast("double")
    band = F.create_map(*(F.lit(x) for kv in BAND_OF.items() for x in kv))[F.col("event_type")]
    mjd = F.unix_micros(F.col("ts").cast("timestamp")) / 86400000000.0 + 40587.0
    return e.select(F.col("user_id").alias("object_id"), mjd.alias("mjd"), band.alias("passband"), flux.alias("flux"), err.alias("flux_err"), (flux / err > 3).cast("int").alias("detected_bool"))


PHOTOMETRY_SQL = """phot AS (SELECT user_id AS object_id, epoch_us(ts)::DOUBLE / 86400000000.0::DOUBLE + 40587.0::DOUBLE AS mjd,
  CASE event_type WHEN 'click' THEN 0 WHEN 'error' THEN 1 WHEN 'purchase' THEN 2 WHEN 'signup' THEN 3 WHEN 'view' THEN 4 END AS passband,
  value - 60.0::DOUBLE AS flux, 5.0::DOUBLE + (event_id % 7)::DOUBLE AS flux_err,
  ((value - 60.0::DOUBLE) / (5.0::DOUBLE + (event_id % 7)::DOUBLE) > 3)::INTEGER AS detected_bool FROM events)"""


def metadata(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row per object, by arithmetic on its id."""
    o = spark.read.parquet(f"{sf_dir}/events.parquet").select(F.col("user_id").alias("object_id")).distinct()
    k = F.col("object_id")
    z = (k % 40) / 25.0
    code = F.element_at(F.array(*map(F.lit, CODES)), (k % len(CODES)).cast("int") + 1)
    return o.select(
        "object_id", ((k * 7919) % 3600 / 10.0).alias("ra"), ((k * 104729) % 1700 / 10.0 - 85.0).alias("decl"), F.when(k % 5 != 0, z).alias("hostgal_specz"),
        z.alias("hostgal_photoz"), (0.01 + (k % 17) / 100.0).alias("hostgal_photoz_err"), F.when(k % 3 == 0, 35.0 + z).otherwise(0.0).alias("distmod"), ((k % 11) / 20.0).alias("mwebv"), (k % 4 == 0).cast("tinyint").alias("ddf_bool"), code.alias("code"),
    )


METADATA_SQL = f"""meta AS (SELECT object_id, ((object_id * 7919) % 3600)::DOUBLE / 10 AS ra, ((object_id * 104729) % 1700)::DOUBLE / 10 - 85.0::DOUBLE AS decl,
  CASE WHEN object_id % 5 <> 0 THEN (object_id % 40)::DOUBLE / 25 END AS hostgal_specz, (object_id % 40)::DOUBLE / 25 AS hostgal_photoz,
  0.01::DOUBLE + (object_id % 17)::DOUBLE / 100 AS hostgal_photoz_err, CASE WHEN object_id % 3 = 0 THEN 35.0::DOUBLE + (object_id % 40)::DOUBLE / 25 ELSE 0.0::DOUBLE END AS distmod,
  (object_id % 11)::DOUBLE / 20 AS mwebv, (object_id % 4 = 0)::TINYINT AS ddf_bool, ({list(CODES)})[object_id % {len(CODES)} + 1] AS code FROM (SELECT DISTINCT user_id AS object_id FROM events))"""


def probabilities(spark: SparkSession, sf_dir: str) -> DataFrame:
    """object_id, label, p: a softmax over the known classes (by rising code) of sums over
    the embedding, each class taking every K-th component from its own place on."""
    e = spark.read.parquet(f"{sf_dir}/embeddings.parquet")
    k = len(KNOWN)
    own = F.transform(F.sequence(F.lit(0), F.lit(k - 1)), lambda j: F.exp(F.aggregate(F.filter("embedding", lambda v, i: i % k == j), F.lit(0.0), lambda a, v: a + v.cast("double"))))
    e = e.select(F.col("vec_id").alias("object_id"), F.col("label").cast("int").alias("label"), own.alias("x"))
    total = F.aggregate("x", F.lit(0.0), lambda a, v: a + v)
    return e.withColumn("total", total).select("object_id", "label", F.transform("x", lambda v: F.greatest(v / F.col("total"), F.lit(1e-12))).alias("p"))


PROBABILITIES_SQL = f"""proba_x AS (SELECT vec_id AS object_id, label::INTEGER AS label, list_transform(range({len(KNOWN)}), lambda j: exp(list_sum(list_transform(list_filter(embedding, lambda v, i: (i - 1) % {len(KNOWN)} = j), lambda v: v::DOUBLE)))) AS x FROM embeddings),
proba AS (SELECT object_id, label, list_transform(x, lambda v: greatest(v / list_sum(x), 1e-12::DOUBLE)) AS p FROM proba_x)"""


def scored(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Labelled documents as a ranked list: id, score (n_chars, so it ties) and truth."""
    d = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "n_chars", "source")
    lab = spark.read.parquet(f"{sf_dir}/labels.parquet").select("doc_id", "toxic", "quality")
    return d.join(lab, "doc_id").select(F.col("doc_id").alias("object_id"), F.floor(F.col("n_chars") / 50).cast("double").alias("score"), F.col("toxic").cast("int").alias("y"), F.col("source").alias("grp"))


SCORED_SQL = """scored AS (SELECT d.doc_id AS object_id, floor(n_chars / 50)::DOUBLE AS score, toxic::INTEGER AS y, source AS grp FROM documents d JOIN labels l ON d.doc_id = l.doc_id)"""
