"""Alert packets: two broker shapes from JSON lines, one bad line never stops a file."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tarnfield.functions.physics import alert_id

_POINT = "jd double, fid int, flux double, fluxerr double, isdiffpos string"
_ZTF = f"candid string, objectId string, candidate struct<{', '.join(x.replace(' ', ': ', 1) for x in (_POINT + ', ra double, dec double, drb double, rb double').split(', '))}>, prv_candidates array<struct<{', '.join(x.replace(' ', ': ', 1) for x in _POINT.split(', '))}>>"
_SOURCE = "struct<midPointTai: double, band: string, psfFlux: double, flux: double, psfFluxErr: double>"
_RUBIN = f"alertId string, diaSource struct<diaSourceId: string, midPointTai: double, band: string, psfFlux: double, flux: double, psfFluxErr: double, ra: double, decl: double, reliability: double>, diaSourceHistory array<{_SOURCE}>, diaObject struct<diaObjectId: string, zphot: double, zphotErr: double>"
ADAPTER_VERSION = "2"
POINTS = "array<struct<mjd: double, passband: int, flux: double, flux_err: double, detected_bool: int>>"


_BOTH = f"{_ZTF}, {_RUBIN}, _bad string"


def packets(lines: DataFrame) -> DataFrame:
    """From a column ``value`` of JSON lines: shape, alert_id, object_id, points, errors (array of messages).

    Each line is parsed once, by a schema that holds the fields of both shapes; a field
    whose value does not fit its type is null and the others stay."""
    v = F.col("value")
    both = F.from_json(v, _BOTH, {"columnNameOfCorruptRecord": "_bad"})
    # a generator of one row: the optimiser would copy the parsing into every field that is read
    p = lines.select(v, F.explode(F.array(both)).alias("z")).select("value", "z", F.col("z").alias("r"))
    # a line that did not fit the schema in some place is looked at again, which few are
    whole = F.col("z._bad").isNull()
    parsed = F.when(whole, v.isNotNull() & (F.trim(v) != "")).otherwise(F.try_parse_json(v).isNotNull())
    there = lambda field: F.when(whole, F.col(f"z.{field}").isNotNull()).otherwise(F.get_json_object(v, f"$.{field}").isNotNull())
    ztf, rubin = there("candidate") | there("candid"), there("alertId") | there("diaSource")
    p = p.select("value", F.when(~parsed, None).when(ztf, "ztf").when(rubin, "rubin").alias("shape"), F.coalesce(parsed, F.lit(False)).alias("parsed"), "z", "r")

    def ztf_point(x: Column) -> Column:
        up = F.coalesce(F.lower(x["isdiffpos"]), F.lit("1")).isin("1", "t", "true")
        return F.struct((x["jd"] - 2400000.5).alias("mjd"), x["fid"].alias("passband"), x["flux"].alias("flux"), x["fluxerr"].alias("flux_err"), up.cast("int").alias("detected_bool"))

    def rubin_point(x: Column) -> Column:
        flux = F.coalesce(x["psfFlux"], x["flux"])
        return F.struct(x["midPointTai"].alias("mjd"), (F.instr(F.lit("ugrizy"), x["band"]) - 1).cast("int").alias("passband"), flux.alias("flux"), x["psfFluxErr"].alias("flux_err"), (flux >= 0).cast("int").alias("detected_bool"))

    def usable(x: Column) -> Column:
        return x["mjd"].isNotNull() & x["flux"].isNotNull() & (x["flux_err"] > 0) & x["passband"].between(0, 5)

    head = F.struct(*(F.col(f"z.candidate.{c}").alias(c) for c in ("jd", "fid", "flux", "fluxerr", "isdiffpos")))
    own = F.struct(*(F.col(f"r.diaSource.{c}").alias(c) for c in ("midPointTai", "band", "psfFlux", "flux", "psfFluxErr")))
    z_points = F.transform(F.filter(F.concat(F.array(head), F.coalesce("z.prv_candidates", F.array().cast(f"array<{_struct()}>"))), lambda x: x["fid"].isin(1, 2, 3)), ztf_point)
    r_points = F.transform(F.concat(F.array(own), F.coalesce("r.diaSourceHistory", F.array().cast(f"array<{_SOURCE}>"))), rubin_point)
    points = F.filter(F.when(F.col("shape") == "ztf", z_points).when(F.col("shape") == "rubin", r_points), usable)
    name = F.when(F.col("shape") == "ztf", F.coalesce("z.objectId", "z.candid")).when(F.col("shape") == "rubin", F.coalesce("r.diaObject.diaObjectId", "r.alertId"))
    out = p.select("value", "shape", F.when(F.col("shape") == "ztf", F.col("z.candid")).otherwise(F.col("r.alertId")).alias("alert_id"), alert_id(name).alias("object_id"), F.coalesce("z.candidate.drb", "z.candidate.rb", "r.diaSource.reliability").alias("realbogus"), F.explode(F.array(F.struct(points.alias("points")))).alias("_p"), "parsed").withColumn("points", F.col("_p.points")).drop("_p")
    errors = F.array_compact(F.array(F.when(~F.col("parsed"), "not JSON"), F.when(F.col("parsed") & F.col("shape").isNull(), "unknown shape"), F.when(F.col("shape").isNotNull() & (F.size("points") == 0), "no usable points")))
    provenance = F.create_map(F.lit("survey"), F.coalesce("shape", F.lit("unknown")), F.lit("alert_id"), F.coalesce("alert_id", F.lit("unknown")), F.lit("adapter_version"), F.lit(ADAPTER_VERSION))
    return out.withColumn("errors", errors).withColumn("provenance", provenance).drop("parsed")


def problems(points: Column) -> Column:
    """What is wrong with a light curve (array of POINTS), field by field; an empty array if nothing is."""
    some = lambda test, text: F.when(F.exists(points, test), text)
    odd = lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf"))
    found = F.array_compact(F.array(some(lambda x: F.coalesce(x["flux_err"] <= 0, F.lit(True)), "non-positive flux_err"), some(lambda x: odd(x["flux"]), "non-finite flux"), some(lambda x: odd(x["mjd"]), "non-finite mjd"), some(lambda x: ~F.coalesce(x["passband"].between(0, 5), F.lit(False)), "passband outside 0..5")))
    return F.when(F.coalesce(F.size(points), F.lit(0)) <= 0, F.array(F.lit("empty light curve"))).otherwise(found)


def _struct() -> str:
    return "struct<" + ", ".join(x.replace(" ", ": ", 1) for x in _POINT.split(", ")) + ">"


def read_packets(spark: SparkSession, path: str) -> DataFrame:
    """Packets of JSON lines (blank ones are skipped), or of .json files that hold one packet or a list of them."""
    if not path.endswith(".json"):
        return packets(spark.read.text(path).filter(F.trim("value") != ""))
    whole = spark.read.text(path, wholetext=True)
    items = F.coalesce(F.from_json("value", "array<string>"), F.array("value"))
    return packets(whole.select(F.explode(F.when(F.ltrim("value").startswith("["), items).otherwise(F.array("value"))).alias("value")))


def to_photometry(good: DataFrame) -> DataFrame:
    """Observations of packets without errors."""
    return good.filter(F.size("errors") == 0).select("object_id", F.inline("points"))


def failures(p: DataFrame, n: int = 20) -> DataFrame:
    """A sample of the packets that failed: alert_id, survey and the first error."""
    bad = p.filter(F.size("errors") > 0)
    return bad.select(F.coalesce("alert_id", F.lit("unknown")).alias("alert_id"), F.coalesce("shape", F.lit("unknown")).alias("survey"), F.col("errors")[0].alias("error")).orderBy("alert_id", "error").limit(n)


def replay_report(p: DataFrame) -> DataFrame:
    return p.agg(F.count(F.lit(1)).alias("n"), F.count_if(F.size("errors") == 0).alias("ok"), F.count_if(F.size("errors") > 0).alias("failed"))


def write_packets(obs: DataFrame) -> DataFrame:
    """One JSON line per object in the first shape: the last point is the trigger, the rest history.
    Bands beyond the shape's three are left out, with their count in ``dropped``."""
    pt = F.struct((F.col("mjd") + 2400000.5).alias("jd"), F.col("passband").alias("fid"), "flux", F.col("flux_err").alias("fluxerr"), F.col("detected_bool").cast("string").alias("isdiffpos"))
    g = obs.groupBy("object_id").agg(F.array_sort(F.collect_list(F.when(F.col("passband").isin(1, 2, 3), pt))).alias("pts"), F.count_if(~F.col("passband").isin(1, 2, 3)).alias("dropped"))
    n = F.size("pts")
    line = F.to_json(F.struct(F.col("object_id").cast("string").alias("candid"), F.col("object_id").cast("string").alias("objectId"), F.element_at("pts", -1).alias("candidate"), F.slice("pts", 1, F.greatest(n - 1, F.lit(0))).alias("prv_candidates")))
    return g.filter(n > 0).select("object_id", line.alias("value"), "dropped", n.alias("n_points"))
