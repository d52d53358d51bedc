"""Simulated light curves: three templates, seeded by object, for demonstrations and tests."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Template by object_id modulo 3: rise and decline in days, peak flux, period (0: none).
TEMPLATES = ((3.0, 20.0, 300.0, 0.0), (1.0, 5.0, 150.0, 0.0), (0.0, 0.0, 200.0, 4.0))


def light_curves(spark: SparkSession, n_objects: int, n_epochs: int = 24, span: float = 60.0, seed: int = 7) -> DataFrame:
    """Observations of ``n_objects`` in six bands; the noise is a hash of its place, so any part of it is reproducible."""
    u = lambda salt: F.pmod(F.xxhash64("object_id", "passband", "epoch", F.lit(f"{seed}-{salt}")), F.lit(1 << 40)) / float(1 << 40)
    o = spark.range(n_objects).select((F.col("id") + 1000).alias("object_id"), F.explode(F.sequence(F.lit(0), F.lit(5))).alias("passband"))
    o = o.select("object_id", "passband", F.explode(F.sequence(F.lit(0), F.lit(n_epochs - 1))).alias("epoch"))
    o = o.withColumns({"mjd": 60000.0 + (F.col("epoch") + u("t")) * (span / n_epochs), "noise": (u("a") + u("b") + u("c") - 1.5) * 6.0, "flux_err": 1.5 + 10.5 * u("e")})
    flux = F.lit(0.0)
    t = F.col("mjd") - 60000.0 - span / 3
    for k, (rise, decline, peak, period) in enumerate(TEMPLATES):
        shape = F.sin(t * (6.283185307179586 / period)) if period else F.when(t < 0, F.exp(t / rise)).otherwise(F.exp(-t / decline))
        flux = F.when(F.pmod(F.col("object_id"), F.lit(3)) == k, shape * peak).otherwise(flux)
    return o.select("object_id", "mjd", "passband", (flux + F.col("noise")).alias("flux"), "flux_err", ((flux + F.col("noise")) / F.col("flux_err") > 5).cast("int").alias("detected_bool"))
