"""The feature matrix: per band and object, over all bands, colours, physics, host, quality.

One window for gaps, one aggregation by (object, band), one pivot by object: the
observations are shuffled by object once, and later steps reuse that dealing.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tarnfield.functions import physics
from tarnfield.schema import BANDS, METADATA, clip, safe_div

# Names of the statistics.
#: Columns of band_statistics besides the keys; a row's suffixes are these.
PLAIN = ("n_obs", "n_det", "flux_max", "flux_min", "flux_mean", "flux_std", "flux_sum", "err_mean", "err_min", "t_min", "t_max", "t_mean", "t_std", "snr_max", "snr_mean")
ORDERED = ("snr_median", "flux_p10", "flux_p25", "flux_p50", "flux_p75", "flux_p90", "snr_p90", "gap_median", "gap_max", "t_peak", "peak_snr")
DETECTED = ("dflux_max", "dflux_mean", "dflux_median", "dpeak_time")
SHAPE = ("flux_skew", "flux_kurt", "slope", "curvature", "resid_std")
DERIVED = ("det_frac", "flux_range", "flux_iqr", "rise_time", "decline_time", "t_centroid", "integral", "rise_rate", "decline_rate", "variability", "neg_frac", "peak_mag", "det_peak_mag", "med_mag")


def _first_at(value: Column, order: Column) -> Column:
    """The value at the greatest ``order``, the earliest mjd of ties and of those the greatest
    value, in whatever order rows come; null where order is null throughout."""
    return F.max_by(value, F.when(order.isNotNull(), F.struct(order, -F.col("mjd"), value)))


def band_statistics(obs: DataFrame) -> DataFrame:
    """One row per (object_id, passband) with PLAIN, ORDERED, DETECTED, SHAPE and DERIVED."""
    by = Window.partitionBy("object_id", "passband")
    c = F.col
    obs = obs.withColumns({"snr": F.when(c("flux_err") > 0, c("flux") / c("flux_err")), "dflux": F.when(c("detected_bool") == 1, c("flux")), "gap": c("mjd") - F.lag("mjd").over(by.orderBy("mjd", "flux")), "x": c("mjd") - F.min("mjd").over(by)})
    q = F.percentile("flux", F.array(*map(F.lit, (0.1, 0.25, 0.5, 0.75, 0.9))))
    s = obs.groupBy("object_id", "passband").agg(
        F.count(F.lit(1)).alias("n_obs"), F.sum("detected_bool").alias("n_det"), F.max("flux").alias("flux_max"), F.min("flux").alias("flux_min"), F.avg("flux").alias("flux_mean"), F.stddev_samp("flux").alias("flux_std"), F.sum("flux").alias("flux_sum"),
        F.avg("flux_err").alias("err_mean"), F.min("flux_err").alias("err_min"), F.min("mjd").alias("t_min"), F.max("mjd").alias("t_max"), F.avg("mjd").alias("t_mean"), F.stddev_samp("mjd").alias("t_std"), F.max("snr").alias("snr_max"), F.avg("snr").alias("snr_mean"),
        F.percentile("snr", F.lit(0.5)).alias("snr_median"), q.alias("q"), F.percentile("snr", F.lit(0.9)).alias("snr_p90"), F.percentile("gap", F.lit(0.5)).alias("gap_median"), F.max("gap").alias("gap_max"),
        _first_at(c("mjd"), c("flux")).alias("t_peak"), _first_at(c("snr"), c("flux")).alias("peak_snr"),
        F.max("dflux").alias("dflux_max"), F.avg("dflux").alias("dflux_mean"), F.percentile("dflux", F.lit(0.5)).alias("dflux_median"), _first_at(c("mjd"), c("dflux")).alias("dpeak_time"),
        *(F.sum(F.pow("x", F.lit(float(k)))).alias(f"x{k}") for k in (1, 2, 3, 4)), *(F.sum(F.pow("flux", F.lit(float(k)))).alias(f"f{k}") for k in (2, 3, 4)), F.sum(c("x") * c("flux")).alias("xf"), F.sum(c("x") * c("x") * c("flux")).alias("xxf"), F.sum(c("mjd") * c("flux")).alias("tf"), F.count_if(c("flux") < 0).alias("neg"),
    )
    n, m = c("n_obs").cast("double"), c("flux_mean")
    m2 = c("f2") / n - m * m
    m3 = c("f3") / n - 3 * m * c("f2") / n + 2 * m * m * m
    m4 = c("f4") / n - 4 * m * c("f3") / n + 6 * m * m * c("f2") / n - 3 * m * m * m * m
    flat = m2 <= 1e-24
    den = n * c("x2") - c("x1") * c("x1")
    slope = safe_div(n * c("xf") - c("x1") * c("flux_sum"), den, 0.0)
    base = (c("flux_sum") - slope * c("x1")) / n
    rss = c("f2") - 2 * base * c("flux_sum") - 2 * slope * c("xf") + n * base * base + 2 * base * slope * c("x1") + slope * slope * c("x2")
    det = n * (c("x2") * c("x4") - c("x3") * c("x3")) - c("x1") * (c("x1") * c("x4") - c("x2") * c("x3")) + c("x2") * (c("x1") * c("x3") - c("x2") * c("x2"))
    top = n * (c("x2") * c("xxf") - c("x3") * c("xf")) - c("x1") * (c("x1") * c("xxf") - c("x2") * c("xf")) + c("flux_sum") * (c("x1") * c("x3") - c("x2") * c("x2"))
    s = s.withColumns({
        **{f"flux_p{p}": c("q")[k] for k, p in enumerate((10, 25, 50, 75, 90))},
        "flux_skew": F.when(flat, 0.0).otherwise(m3 / F.pow(m2, F.lit(1.5))), "flux_kurt": F.when(flat, 0.0).otherwise(m4 / (m2 * m2) - 3.0),
        "slope": slope, "curvature": F.when(F.abs(det) > 1e-9, top / det).otherwise(0.0), "resid_std": F.sqrt(F.greatest(rss, F.lit(0.0)) / F.greatest(n - 2, F.lit(1.0))),
    })
    return _derived(s)


def _derived(s: DataFrame) -> DataFrame:
    c = F.col
    rise, decline = c("t_peak") - c("t_min"), c("t_max") - c("t_peak")
    s = s.withColumns({
        "det_frac": safe_div(c("n_det"), c("n_obs")), "flux_range": c("flux_max") - c("flux_min"), "flux_iqr": c("flux_p75") - c("flux_p25"), "rise_time": rise, "decline_time": decline,
        "t_centroid": safe_div(c("tf"), c("flux_sum")), "integral": c("flux_sum") / F.greatest(c("t_max") - c("t_min"), F.lit(0.5)),
        "rise_rate": c("flux_max") / F.greatest(rise, F.lit(0.5)), "decline_rate": c("flux_max") / F.greatest(decline, F.lit(0.5)), "variability": safe_div(c("flux_std"), F.abs(c("flux_mean"))),
        "neg_frac": c("neg") / F.greatest(c("n_det"), F.lit(1)), "peak_mag": physics.masked_magnitude(c("flux_max"), c("snr_max")), "det_peak_mag": physics.masked_magnitude(c("dflux_max"), c("snr_max")), "med_mag": physics.masked_magnitude(c("flux_p50"), c("snr_median")),
    })
    return s.select("object_id", "passband", *PLAIN, *ORDERED, *DETECTED, *SHAPE, *DERIVED)


def wide(bands: DataFrame, suffixes: tuple[str, ...]) -> DataFrame:
    """One row per object, a column for each band and suffix; absent bands are null, their shape 0."""
    out = bands.groupBy("object_id").pivot("passband", list(range(len(BANDS)))).agg(*(F.first(s).alias(s) for s in suffixes))
    cols = []
    for k, b in enumerate(BANDS):
        for s in suffixes:
            x = f"`{k}_{s}`" if len(suffixes) > 1 else f"`{k}`"
            cols.append((f"coalesce({x}, 0D)" if s in SHAPE else x) + f" AS `{b}_{s}`")
    return out.selectExpr("object_id", *cols)


def _overall_inputs() -> dict[str, Column]:
    c = F.col
    return {"snr": F.when(c("flux_err") > 0, c("flux") / c("flux_err")), "dflux": F.when(c("detected_bool") == 1, c("flux"))}


def _overall() -> list[Column]:
    return [F.count(F.lit(1)).alias("n_obs"), F.sum("detected_bool").alias("n_det"), F.max("flux").alias("flux_max"), F.avg("flux").alias("flux_mean"), F.stddev_samp("flux").alias("flux_std"), F.max("snr").alias("snr_max"), F.percentile("snr", F.lit(0.5)).alias("snr_median"), F.avg("flux_err").alias("err_mean"), F.min("mjd").alias("t_min"), F.max("mjd").alias("t_max"), F.max("dflux").alias("dflux_max")]


def _overall_columns() -> list[Column]:
    c = F.col
    plain = [c(x) for x in ("n_obs", "n_det", "flux_max", "flux_mean", "flux_std", "snr_max", "snr_median", "err_mean", "t_min", "t_max", "dflux_max")]
    span = c("t_max") - c("t_min")
    more = {"t_span": span, "det_frac": safe_div(c("n_det"), c("n_obs")), "peak_mag": physics.masked_magnitude(c("flux_max"), c("snr_max")), "det_peak_mag": physics.masked_magnitude(c("dflux_max"), c("snr_max")), "variability": safe_div(c("flux_std"), F.abs(c("flux_mean"))), "points_per_day": c("n_obs") / F.greatest(span, F.lit(0.5))}
    names = ("n_obs", "n_det", "flux_max", "flux_mean", "flux_std", "snr_max", "snr_median", "err_mean", "t_min", "t_max", "dflux_max", *more)
    return [x.alias(f"lc_{n}") for n, x in zip(names, (*plain, *more.values()))]


def global_features(obs: DataFrame) -> DataFrame:
    """The features over all bands of an object."""
    return obs.withColumns(_overall_inputs()).groupBy("object_id").agg(*_overall()).select("object_id", *_overall_columns())


def _quality_inputs() -> dict[str, Column]:
    c = F.col
    det = c("detected_bool") == 1
    return {"er": F.when(det & (F.abs(c("flux")) > 1e-9), c("flux_err") / F.abs(c("flux"))), "ds": F.when(det & (c("flux_err") > 0), c("flux") / c("flux_err")), "same": F.count(F.lit(1)).over(Window.partitionBy("object_id", "passband", "mjd"))}


def _quality() -> list[Column]:
    c = F.col
    det = c("detected_bool") == 1
    per_band = [F.count_if(c("passband") == k).alias(f"q_obs_{b}") for k, b in enumerate(BANDS)] + [F.count_if((c("passband") == k) & det).alias(f"q_det_{b}") for k, b in enumerate(BANDS)]
    return [F.count(F.lit(1)).alias("q_n_obs"), F.sum("detected_bool").alias("q_n_det"), F.count_if(det & (c("flux") < 0)).alias("neg"), F.avg("er").alias("q_err_ratio_mean"), F.percentile("er", F.lit(0.5)).alias("q_err_ratio_median"), F.max("er").alias("q_err_ratio_max"), F.percentile("ds", F.lit(0.5)).alias("q_det_snr_median"), F.min("ds").alias("q_det_snr_min"), F.min("flux_err").alias("q_err_min"), (F.max("mjd") - F.min("mjd")).alias("q_t_span"), F.count_if(c("same") > 1).alias("q_duplicate_epochs"), *per_band]


def _quality_columns() -> list[Column]:
    c = F.col
    o, d = [c(f"q_obs_{b}") for b in BANDS], [c(f"q_det_{b}") for b in BANDS]
    plain = [c(x) for x in ("q_n_obs", "q_n_det", "q_err_ratio_mean", "q_err_ratio_median", "q_err_ratio_max", "q_det_snr_median", "q_det_snr_min", "q_err_min", "q_t_span", "q_duplicate_epochs")]
    more = {"q_neg_flux_frac": c("neg") / F.greatest(c("q_n_det"), F.lit(1)), "q_single_band_frac": safe_div(F.greatest(*o), c("q_n_obs")), "q_dominant_band_det_frac": safe_div(F.greatest(*d), c("q_n_det")), "q_n_bands": sum((x > 0).cast("int") for x in o), "q_n_bands_detected": sum((x > 0).cast("int") for x in d), "q_det_frac": safe_div(c("q_n_det"), c("q_n_obs"))}
    return [*plain, *o, *d, *(x.alias(n) for n, x in more.items())]


def quality_features(obs: DataFrame) -> DataFrame:
    """Data-quality statistics of detections, coverage and duplicates. ``q_obs_b`` counts
    a band's observations, ``q_det_b`` its detections."""
    return obs.withColumns(_quality_inputs()).groupBy("object_id").agg(*_quality()).select("object_id", *_quality_columns())


def band_peaks(obs: DataFrame) -> DataFrame:
    """Per object the peak flux of each band (p_b), its time (t_b), and the days from the
    band's first observation to it (r_b) and from it to the last (d_b)."""
    at = _first_at(F.col("mjd"), F.col("flux"))
    s = obs.groupBy("object_id").pivot("passband", list(range(len(BANDS)))).agg(F.max("flux").alias("p"), at.alias("t"), (at - F.min("mjd")).alias("r"), (F.max("mjd") - at).alias("d"))
    return s.select("object_id", *(F.col(f"{k}_{x}").alias(f"{x}_{b}") for k, b in enumerate(BANDS) for x in "ptrd"))


# Pairs of bands whose colours, and whose lags of the peak, are features.
COLOURS, LAGS = ("ug", "gr", "ri", "iz", "zy", "gi", "rz", "ur", "gz"), ("gr", "ri", "ug", "iz")


def _colours() -> list[Column]:
    mag = {b: physics.magnitude(F.col(f"p_{b}")) for b in BANDS}
    out = [clip(mag[a] - mag[b], -12.0, 12.0).alias(f"col_{a}m{b}") for a, b in COLOURS]
    out += [(F.col(f"t_{a}") - F.col(f"t_{b}")).alias(f"col_dt_{a}m{b}") for a, b in LAGS]
    out.append((1.0 / (0.2 + F.abs(mag["g"] - mag["r"]))).alias("col_temp_proxy"))
    out.append(sum(F.coalesce((F.col(f"p_{b}") > 0).cast("int"), F.lit(0)) for b in BANDS).alias("col_n_bands_positive"))
    return out


def colour_features(peaks: DataFrame) -> DataFrame:
    return peaks.select("object_id", *_colours())


def _placed(peaks: DataFrame, meta: DataFrame) -> DataFrame:
    """Peaks beside the metadata, with redshift (z), distance modulus (dm), its source (flag) and dust (ebv)."""
    c = F.col
    z = F.coalesce(c("hostgal_photoz"), F.lit(0.0))
    dm, flag = physics.resolve_distmod(c("distmod"), z)
    return peaks.join(meta, "object_id", "left").withColumns({"z": z, "dm": dm, "flag": flag, "ebv": F.coalesce(c("mwebv"), F.lit(0.0))})


def _brightest() -> Column:
    return F.greatest(*(F.col(f"p_{b}") for b in BANDS))


def _physics() -> list[Column]:
    c = F.col
    dust = {b: physics.extinction(c("ebv"), k) for k, b in enumerate(BANDS)}
    absmag = {b: physics.magnitude(c(f"p_{b}")) - c("dm") - dust[b] for b in BANDS}
    stretch = F.greatest(1.0 + c("z"), F.lit(1.0))
    per_band = [x for b in BANDS for x in (absmag[b].alias(f"phys_absmag_{b}"), dust[b].alias(f"phys_A_{b}"), (c(f"r_{b}") / stretch).alias(f"phys_rf_rise_{b}"), (c(f"d_{b}") / stretch).alias(f"phys_rf_decline_{b}"))]
    own = [c("z").alias("phys_z"), F.coalesce(c("hostgal_photoz_err"), F.lit(0.0)).alias("phys_z_err"), c("dm").alias("phys_distmod"), c("flag").alias("phys_distmod_source"), c("ebv").alias("phys_mwebv")]
    ends = [F.greatest(*absmag.values()).alias("phys_absmag_max"), F.least(*absmag.values()).alias("phys_absmag_min"), physics.luminosity_proxy(_brightest(), c("dm")).alias("phys_peak_luminosity")]
    return [*own, *per_band, *ends]


def physics_features(peaks: DataFrame, meta: DataFrame) -> DataFrame:
    """Distances, dust, absolute magnitudes and rest-frame times of every band (32 columns)."""
    return _placed(peaks, meta).select("object_id", *_physics())


def _host() -> list[Column]:
    c = F.col
    zero = lambda x: F.coalesce(c(x).cast("double"), F.lit(0.0))
    l, b = physics.galactic(zero("ra"), zero("decl"))
    return [zero("ra").alias("host_ra"), zero("decl").alias("host_decl"), l.alias("host_gal_l"), b.alias("host_gal_b"), F.abs(b).alias("host_abs_gal_b"), zero("ddf_bool").alias("host_ddf"), c("hostgal_specz").isNotNull().cast("double").alias("host_has_specz"), zero("hostgal_specz").alias("host_specz")]


def host_features(objects: DataFrame, meta: DataFrame) -> DataFrame:
    """Position and spectroscopic redshift of the host (8 columns); missing values count as 0."""
    return objects.select("object_id").join(meta, "object_id", "left").select("object_id", *_host())


def _drawn(placed: DataFrame) -> DataFrame:
    """Adds the distance moduli of the redshift's draws (dms), their mean and deviation, and the brightest magnitude."""
    c = F.col
    draws = physics.redshift_draws(c("z"), F.coalesce(c("hostgal_photoz_err"), F.lit(0.0)))
    j = placed.withColumn("dms", F.array_sort(F.transform(draws, physics.distance_modulus))).withColumn("mag", physics.magnitude(_brightest()))
    n = float(physics.DRAWS)

    def mean(xs: Column) -> Column:
        return F.aggregate(xs, F.lit(0.0), lambda a, v: a + v) / n

    j = j.withColumn("dm_mean", mean(c("dms")))
    return j.withColumn("dm_std", F.sqrt(F.aggregate("dms", F.lit(0.0), lambda a, v: a + (v - c("dm_mean")) * (v - c("dm_mean"))) / n))


def _uncertainty() -> list[Column]:
    c = F.col

    def quantile(share: float) -> Column:  # of the magnitudes, which fall as the moduli rise
        at = (1 - share) * (physics.DRAWS - 1)
        k = int(at)
        return c("mag") - (c("dms")[k] + (c("dms")[k + 1] - c("dms")[k]) * (at - k))

    spread = F.when(c("mag").isNotNull(), c("dm_std"))
    known = physics.reliability(c("z"), c("hostgal_photoz_err"), c("flag"))
    return [spread.alias("unc_absmag_std"), quantile(0.16).alias("unc_absmag_q16"), quantile(0.84).alias("unc_absmag_q84"), (c("mag") - c("dm_mean")).alias("unc_absmag_mean"), c("dm_std").alias("unc_distmod_std"), known.alias("unc_z_reliability"), physics.feature_reliability(spread, known).alias("unc_feature_reliability")]


def uncertainty_features(peaks: DataFrame, meta: DataFrame) -> DataFrame:
    """What the redshift's error does to the absolute magnitude, over fixed draws (7 columns)."""
    return _drawn(_placed(peaks, meta)).select("object_id", *_uncertainty())


#: Columns that the blocks read, and where band_peaks' values stand in the wide rows.
_OBSERVED = ("object_id", "mjd", "passband", "flux", "flux_err", "detected_bool")
_PEAK_OF = {"p": "flux_max", "t": "t_peak", "r": "rise_time", "d": "decline_time"}


def feature_matrix(obs: DataFrame, meta: DataFrame, dealt: bool = False) -> DataFrame:
    """All blocks beside each other, a row for each object. Observations are dealt by
    object once: both aggregations read every column, so that they share the exchange,
    and the blocks of peaks and metadata are columns over the wide rows. Metadata has
    a row for each object. ``dealt`` observations (of a store in buckets of object_id)
    are not dealt again."""
    obs = obs.select(*_OBSERVED)
    obs = obs if dealt else obs.repartition("object_id")
    bands = wide(band_statistics(obs), (*PLAIN, *ORDERED, *DETECTED, *SHAPE, *DERIVED))
    peaks = bands.withColumns({f"{x}_{b}": F.col(f"{b}_{s}") for b in BANDS for x, s in _PEAK_OF.items()})
    meta = meta.select(*(f.name for f in METADATA.fields if f.name in meta.columns))
    left = _drawn(_placed(peaks, meta)).select(*bands.columns, *_colours(), *_physics(), *_host(), *_uncertainty())
    whole = obs.withColumns({**_overall_inputs(), **_quality_inputs()}).groupBy("object_id").agg(*_overall(), *_quality())
    return left.join(whole.select("object_id", *_overall_columns(), *_quality_columns()), "object_id")


def aligned(rows: DataFrame, names: list[str]) -> DataFrame:
    """Exactly the named columns in their order: missing ones are 0, others go."""
    return rows.select(*(F.col(n) if n in rows.columns else F.lit(0.0).alias(n) for n in names))


def reliability_of(rows: DataFrame) -> Column:
    """The objects' own feature reliability held to 0 to 1; 1 where the block is missing, 0 for missing values."""
    name = "unc_feature_reliability"
    return clip(F.coalesce(F.col(name).cast("double"), F.lit(0.0)), 0.0, 1.0) if name in rows.columns else F.lit(1.0)


def views(obs: DataFrame, days: tuple[float, ...]) -> DataFrame:
    """Each observation once for every window (days from the object's first; 0: no end)
    that it falls into, as ``view``, on one pass."""
    obs = obs.withColumn("_first", F.min("mjd").over(Window.partitionBy("object_id")))
    own = F.filter(F.array(*map(F.lit, map(float, days))), lambda d: (d == 0) | (F.col("mjd") <= F.col("_first") + d))
    return obs.withColumn("view", F.explode(own)).drop("_first")


def early_window(obs: DataFrame, days: float) -> DataFrame:
    """Observations within ``days`` of the object's first."""
    first = F.min("mjd").over(Window.partitionBy("object_id"))
    return obs.withColumn("_first", first).filter(F.col("mjd") <= F.col("_first") + days).drop("_first")
