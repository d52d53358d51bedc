"""Artifact injectors: deterministic corruptions of observations, by object."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tarnfield.operators.protocol import draw


# Share of detections that change sign, factors of a spike and of the error
# bars, observations that are doubled, share of observations before a gap.
FLIPPED, SPIKE, ERRORS, DOUBLED, KEPT = 0.6, 60.0, 25.0, 6, 0.35
INJECTORS = ("negative_flux_heavy", "single_epoch_spike", "error_bar_corruption", "duplicate_timestamps", "long_cadence_gap", "incomplete_band_coverage")


def scenarios(obs: DataFrame, names: tuple[str, ...] = ("clean", *INJECTORS)) -> DataFrame:
    """The named corruptions of all objects under a ``scenario`` of each (clean: as they are),
    to be scored at once: one pass over the observations, all windows by object.

    negative_flux_heavy flips a share of each object's detections (one at least),
    single_epoch_spike multiplies one observation, duplicate_timestamps has some twice,
    long_cadence_gap keeps the first share in time where there are four, and
    incomplete_band_coverage keeps one of the object's own bands. Observations of one time and
    band are told apart by their values, so that the order of rows decides nothing."""
    c, by = F.col, Window.partitionBy("object_id")
    n = lambda order: F.row_number().over(by.orderBy(*order))
    key = F.concat_ws("|", "object_id", "passband", c("mjd").cast("decimal(20,6)"))
    place = ("mjd", "passband", "flux", "flux_err", "detected_bool")
    nth = lambda seed: n((draw(key, seed), *place))
    detected = c("detected_bool") == 1
    among = Window.partitionBy("object_id", "detected_bool")
    o = obs.withColumns({
        "_neg": F.row_number().over(among.orderBy(draw(key, "neg"), *place)), "_det": F.count(F.lit(1)).over(among), "_spike": nth("spike"), "_dup": nth("dup"), "_time": n(place), "_all": F.count(F.lit(1)).over(by),
        "_band": F.min(F.struct(draw(F.concat_ws("|", "object_id", "passband"), "band").alias("d"), c("passband").alias("b"))).over(by)["b"],
    })
    flipped = detected & (c("_neg") <= F.greatest(F.lit(1), F.floor(c("_det") * FLIPPED)))
    early = (c("_all") < 4) | (c("_time") <= F.greatest(F.lit(1), F.floor(c("_all") * KEPT)))
    same = {"flux": c("flux"), "err": c("flux_err"), "copies": F.lit(1)}
    changed = {
        "clean": {}, "negative_flux_heavy": {"flux": F.when(flipped, -F.abs("flux")).otherwise(c("flux"))}, "single_epoch_spike": {"flux": F.when(c("_spike") == 1, c("flux") * SPIKE).otherwise(c("flux"))}, "error_bar_corruption": {"err": c("flux_err") * ERRORS},
        "duplicate_timestamps": {"copies": 1 + (c("_dup") <= DOUBLED).cast("int")}, "long_cadence_gap": {"copies": early.cast("int")}, "incomplete_band_coverage": {"copies": (c("passband") == c("_band")).cast("int")},
    }

    def variant(name: str) -> Column:
        own = same | changed[name]
        return F.struct(F.lit(name).alias("scenario"), own["flux"].alias("flux"), own["err"].alias("flux_err"), own["copies"].cast("int").alias("copies"))

    each = F.array(*map(variant, names))
    out = o.withColumn("_v", F.explode(F.flatten(F.transform(each, lambda v: F.array_repeat(v, v["copies"])))))
    return out.select(*("_v." + x if x in ("flux", "flux_err") else x for x in obs.columns), "_v.scenario")


def corrupted(obs: DataFrame, name: str) -> DataFrame:
    """The observations with one corruption."""
    return scenarios(obs, (name,)).drop("scenario")


def safety(scored: DataFrame) -> DataFrame:
    """Per corruption: cases, how many rose in rank or score against the clean scenario, and
    the mean changes. ``scored`` has scenario, object_id, score (null: not scorable), quality and rank."""
    clean = scored.filter("scenario = 'clean'").select("object_id", F.col("score").alias("c_score"), F.col("quality").alias("c_quality"), F.col("rank").alias("c_rank"))
    j = scored.filter("scenario <> 'clean'").join(clean, "object_id")
    d = F.col("score") - F.col("c_score")
    rose = F.coalesce(d > 1e-9, F.lit(False))
    return j.groupBy("scenario").agg(F.count(F.lit(1)).alias("n"), F.count_if(F.col("score").isNotNull() & (F.col("rank") < F.col("c_rank"))).alias("n_promoted"), F.count_if(rose).alias("n_score_increased"), F.avg(F.col("quality") - F.col("c_quality")).alias("mean_delta_quality"), F.avg(d).alias("mean_delta_score"))


def passed(report: DataFrame) -> DataFrame:
    """One row: whether no corruption promoted an object or raised its score."""
    return report.agg(F.sum("n").alias("n_cases"), F.sum("n_promoted").alias("n_promoted"), F.sum("n_score_increased").alias("n_score_increased"), ((F.sum("n_promoted") == 0) & (F.sum("n_score_increased") == 0)).alias("passed"))
