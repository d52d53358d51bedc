"""Record types, the band and population dictionaries, and null handling at ingest."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

PHOTOMETRY = T.StructType([T.StructField("object_id", T.IntegerType()), T.StructField("mjd", T.FloatType()), T.StructField("passband", T.ByteType()), T.StructField("flux", T.FloatType()), T.StructField("flux_err", T.FloatType()), T.StructField("detected_bool", T.ByteType())])
METADATA = T.StructType([T.StructField("object_id", T.IntegerType()), *(T.StructField(c, T.FloatType()) for c in ("ra", "decl")), T.StructField("ddf_bool", T.ByteType()), *(T.StructField(c, T.FloatType()) for c in ("hostgal_specz", "hostgal_photoz", "hostgal_photoz_err", "distmod", "mwebv"))])

BANDS = ("u", "g", "r", "i", "z", "y")
GALACTIC, EXTRAGALACTIC = "galactic", "extragalactic"
# Code, name, family, withheld from fitting.
POPULATIONS = (
    (6, "muLens-Single", GALACTIC, True),
    (15, "TDE", EXTRAGALACTIC, False),
    (16, "EB", GALACTIC, False),
    (42, "SNII", EXTRAGALACTIC, False),
    (52, "SNIax", EXTRAGALACTIC, False),
    (53, "Mira", GALACTIC, False),
    (62, "SNIbc", EXTRAGALACTIC, False),
    (64, "KN", EXTRAGALACTIC, True),
    (65, "M-dwarf", GALACTIC, False),
    (67, "SNIa-91bg", EXTRAGALACTIC, False),
    (88, "AGN", EXTRAGALACTIC, False),
    (90, "SNIa", EXTRAGALACTIC, False),
    (92, "RRL", GALACTIC, False),
    (95, "SLSN-I", EXTRAGALACTIC, False),
    (991, "muLens-Binary", GALACTIC, True),
    (992, "ILOT", EXTRAGALACTIC, True),
    (993, "CaRT", EXTRAGALACTIC, True),
    (994, "PISN", EXTRAGALACTIC, True),
    (995, "muLens-String", GALACTIC, True),
)
CODES = tuple(p[0] for p in POPULATIONS)
KNOWN = tuple(p[0] for p in POPULATIONS if not p[3])
IS_GALACTIC = tuple(p[0] for p in POPULATIONS if p[2] == GALACTIC)


def taxonomy(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(list(POPULATIONS), "code int, name string, family string, held_out boolean")


def finite(x: Column) -> Column:
    """NaN and infinities become null, so that aggregates skip them."""
    return F.when(~F.isnan(x) & (F.abs(x) != float("inf")), x)


def safe_div(num: Column, den: Column, fill: float | None = None) -> Column:
    """num / den where the denominator is not (near) zero, else ``fill``."""
    return F.when(F.abs(den) > 1e-12, num / den).otherwise(F.lit(fill).cast("double"))


def clip(x: Column, lo: float, hi: float) -> Column:
    """Null stays null."""
    return F.when(x.isNotNull(), F.least(F.greatest(x, F.lit(lo)), F.lit(hi)))
