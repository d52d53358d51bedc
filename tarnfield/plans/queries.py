"""The library's queries by name, each beside DuckDB SQL for the same rows.

Every query runs over its whole tables. Doubles are rounded on both sides, since
sums in different orders differ in their last bits.
"""

from __future__ import annotations

import math
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tarnfield.functions import physics
from tarnfield.operators import boosting, detectors, domain, engine, evidence, explain, features, inject, isolation, metrics, models, neighbours, ordered, protocol, quality, ranking, resampling
from tarnfield.plans import chain, search, serve
from tarnfield.schema import BANDS, IS_GALACTIC, KNOWN, POPULATIONS, taxonomy
from tarnfield.sources import alerts, stages, views
from tarnfield.sources.views import METADATA_SQL, PHOTOMETRY_SQL, PROBABILITIES_SQL, SCORED_SQL

PLACES = 5
#: Added before rounding: means of values with few decimals fall on ties otherwise.
NUDGE = 3.7e-8


def rounded(df: DataFrame, places: int = PLACES, other: dict[str, int] | None = None) -> DataFrame:
    """Doubles rounded to ``places`` (``other``: those of single columns), integers as longs."""

    def one(c: str, t: str) -> str:
        if t in ("double", "float"):
            return f"round(`{c}` + {NUDGE!r}D, {(other or {}).get(c, places)}) + 0D AS `{c}`"
        return f"CAST(`{c}` AS BIGINT) AS `{c}`" if t in ("int", "tinyint", "smallint", "bigint") else f"`{c}`"

    return df.selectExpr(*(one(c, t) for c, t in df.dtypes))  # text: hundreds of columns are one call


def _draw_sql(seed: str, key: str) -> str:
    return f"('0x' || substr(md5('{seed}:' || {key}), 1, 8))::BIGINT::DOUBLE / 4294967296.0::DOUBLE"


def _r(expr: str, name: str | None = None) -> str:
    return f"round(({expr})::DOUBLE + {NUDGE}, {PLACES}) + 0.0 AS {name or expr}"


def _i(*names: str) -> str:
    return ", ".join(f"{n}::BIGINT AS {n}" for n in names)


# ---- features ----------------------------------------------------------------

_DIV = "CASE WHEN abs({d}) > 1e-12 THEN ({n}) / ({d}) END"


def _div(n: str, d: str, fill: str = "NULL") -> str:
    return f"CASE WHEN abs({d}) > 1e-12 THEN ({n}) / ({d}) ELSE {fill} END"


def _mag(flux: str) -> str:
    return f"CASE WHEN {flux} > 0 THEN -2.5 * log10(greatest({flux}, 1e-300)) + 27.5 END"


def _masked(flux: str, snr: str) -> str:
    return f"CASE WHEN {snr} >= 3 AND {flux} > 0 THEN least(greatest(-2.5 * log10(greatest({flux}, 1e-300)) + 27.5, -5.0), 32.0) END"


_BAND_SQL = f"""WITH {PHOTOMETRY_SQL},
o AS (SELECT *, CASE WHEN flux_err > 0 THEN flux / flux_err END AS snr, CASE WHEN detected_bool = 1 THEN flux END AS dflux,
  mjd - lag(mjd) OVER (PARTITION BY object_id, passband ORDER BY mjd, flux) AS gap, mjd - min(mjd) OVER (PARTITION BY object_id, passband) AS x FROM phot),
s AS (SELECT object_id, passband, count(*) AS n_obs, sum(detected_bool) AS n_det, max(flux) AS flux_max, min(flux) AS flux_min, avg(flux) AS flux_mean, stddev_samp(flux) AS flux_std, sum(flux) AS flux_sum,
  avg(flux_err) AS err_mean, min(flux_err) AS err_min, min(mjd) AS t_min, max(mjd) AS t_max, avg(mjd) AS t_mean, stddev_samp(mjd) AS t_std, max(snr) AS snr_max, avg(snr) AS snr_mean,
  quantile_cont(snr, 0.5) AS snr_median, quantile_cont(flux, 0.1) AS flux_p10, quantile_cont(flux, 0.25) AS flux_p25, quantile_cont(flux, 0.5) AS flux_p50, quantile_cont(flux, 0.75) AS flux_p75, quantile_cont(flux, 0.9) AS flux_p90,
  quantile_cont(snr, 0.9) AS snr_p90, quantile_cont(gap, 0.5) AS gap_median, max(gap) AS gap_max, first(mjd ORDER BY flux DESC, mjd) AS t_peak, first(snr ORDER BY flux DESC, mjd) AS peak_snr,
  max(dflux) AS dflux_max, avg(dflux) AS dflux_mean, quantile_cont(dflux, 0.5) AS dflux_median, first(mjd ORDER BY dflux DESC, mjd) FILTER (dflux IS NOT NULL) AS dpeak_time,
  sum(x) AS x1, sum(x**2) AS x2, sum(x**3) AS x3, sum(x**4) AS x4, sum(flux**2) AS f2, sum(flux**3) AS f3, sum(flux**4) AS f4, sum(x*flux) AS xf, sum(x*x*flux) AS xxf, sum(mjd*flux) AS tf, count(*) FILTER (flux < 0) AS neg
  FROM o GROUP BY object_id, passband),
m AS (SELECT *, f2/n_obs - flux_mean**2 AS m2, f3/n_obs - 3*flux_mean*f2/n_obs + 2*flux_mean**3 AS m3, f4/n_obs - 4*flux_mean*f3/n_obs + 6*flux_mean**2*f2/n_obs - 3*flux_mean**4 AS m4,
  {_div("n_obs*xf - x1*flux_sum", "n_obs*x2 - x1*x1", "0.0")} AS slope, n_obs*(x2*x4 - x3*x3) - x1*(x1*x4 - x2*x3) + x2*(x1*x3 - x2*x2) AS det,
  n_obs*(x2*xxf - x3*xf) - x1*(x1*xxf - x2*xf) + flux_sum*(x1*x3 - x2*x2) AS top FROM s),
k AS (SELECT *, CASE WHEN m2 <= 1e-24 THEN 0.0 ELSE m3 / m2**1.5 END AS flux_skew, CASE WHEN m2 <= 1e-24 THEN 0.0 ELSE m4/(m2*m2) - 3 END AS flux_kurt, CASE WHEN abs(det) > 1e-9 THEN top/det ELSE 0.0 END AS curvature,
  (flux_sum - slope*x1)/n_obs AS base, t_peak - t_min AS rise_time, t_max - t_peak AS decline_time FROM m),
b AS (SELECT *, sqrt(greatest(f2 - 2*base*flux_sum - 2*slope*xf + n_obs*base*base + 2*base*slope*x1 + slope*slope*x2, 0.0) / greatest(n_obs - 2, 1)) AS resid_std,
  {_div("n_det", "n_obs")} AS det_frac, flux_max - flux_min AS flux_range, flux_p75 - flux_p25 AS flux_iqr, {_div("tf", "flux_sum")} AS t_centroid, flux_sum / greatest(t_max - t_min, 0.5) AS integral,
  flux_max / greatest(rise_time, 0.5) AS rise_rate, flux_max / greatest(decline_time, 0.5) AS decline_rate, {_div("flux_std", "abs(flux_mean)")} AS variability, neg / greatest(n_det, 1) AS neg_frac,
  {_masked("flux_max", "snr_max")} AS peak_mag, {_masked("dflux_max", "snr_max")} AS det_peak_mag, {_masked("flux_p50", "snr_median")} AS med_mag FROM k)"""
_SUFFIXES = (*features.PLAIN, *features.ORDERED, *features.DETECTED, *features.SHAPE, *features.DERIVED)
_COUNTS = ("n_obs", "n_det")


def band_features(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = features.band_statistics(views.photometry(spark, sf_dir))
    # a near-cancelling sum has fewer sure digits than the others
    return rounded(out.withColumn("t_centroid", F.round("t_centroid", 3)))


_band_features_sql = _BAND_SQL + " SELECT " + _i("object_id", "passband", *_COUNTS) + ", " + ", ".join(_r("round(t_centroid, 3)", s) if s == "t_centroid" else _r(s) for s in _SUFFIXES if s not in _COUNTS) + " FROM b"

_WIDE = tuple(_SUFFIXES)


def band_matrix(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = features.wide(features.band_statistics(views.photometry(spark, sf_dir)), _WIDE)
    return rounded(out.withColumns({f"{b}_t_centroid": F.round(f"{b}_t_centroid", 3) for b in BANDS}))


_band_matrix_sql = _BAND_SQL + " SELECT object_id, " + ", ".join(
    (f"max({s}) FILTER (passband = {k})::BIGINT AS {b}_{s}" if s in _COUNTS else _r(f"max(round(t_centroid, 3)) FILTER (passband = {k})", f"{b}_{s}") if s == "t_centroid" else _r(f"coalesce(max({s}) FILTER (passband = {k}), 0.0)" if s in features.SHAPE else f"max({s}) FILTER (passband = {k})", f"{b}_{s}")) for k, b in enumerate(BANDS) for s in _WIDE
) + " FROM b GROUP BY object_id"


def global_features(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(features.global_features(views.photometry(spark, sf_dir)))


_global_sql = f"""WITH {PHOTOMETRY_SQL},
o AS (SELECT *, CASE WHEN flux_err > 0 THEN flux / flux_err END AS snr, CASE WHEN detected_bool = 1 THEN flux END AS dflux FROM phot),
a AS (SELECT object_id, count(*) AS n_obs, sum(detected_bool) AS n_det, max(flux) AS flux_max, avg(flux) AS flux_mean, stddev_samp(flux) AS flux_std, max(snr) AS snr_max, quantile_cont(snr, 0.5) AS snr_median, avg(flux_err) AS err_mean,
  min(mjd) AS t_min, max(mjd) AS t_max, max(dflux) AS dflux_max, max(mjd) - min(mjd) AS t_span FROM o GROUP BY object_id)
SELECT object_id, n_obs::BIGINT AS lc_n_obs, n_det::BIGINT AS lc_n_det, """ + ", ".join(_r(s, f"lc_{s}") for s in ("flux_max", "flux_mean", "flux_std", "snr_max", "snr_median", "err_mean", "t_min", "t_max", "dflux_max", "t_span")) + ", " + ", ".join(
    _r(x, f"lc_{n}") for n, x in {"det_frac": _div("n_det", "n_obs"), "peak_mag": _masked("flux_max", "snr_max"), "det_peak_mag": _masked("dflux_max", "snr_max"), "variability": _div("flux_std", "abs(flux_mean)"), "points_per_day": "n_obs / greatest(t_span, 0.5)"}.items()) + " FROM a"

_Q_SQL = f"""{PHOTOMETRY_SQL},
qo AS (SELECT *, CASE WHEN detected_bool = 1 AND abs(flux) > 1e-9 THEN flux_err / abs(flux) END AS er, CASE WHEN detected_bool = 1 AND flux_err > 0 THEN flux / flux_err END AS ds, count(*) OVER (PARTITION BY object_id, passband, mjd) AS same FROM phot),
qa AS (SELECT object_id, count(*) AS q_n_obs, sum(detected_bool) AS q_n_det, count(*) FILTER (detected_bool = 1 AND flux < 0) AS neg, avg(er) AS q_err_ratio_mean, quantile_cont(er, 0.5) AS q_err_ratio_median, max(er) AS q_err_ratio_max,
  quantile_cont(ds, 0.5) AS q_det_snr_median, min(ds) AS q_det_snr_min, min(flux_err) AS q_err_min, max(mjd) - min(mjd) AS q_t_span, count(*) FILTER (same > 1) AS q_duplicate_epochs,
  {", ".join(f"count(*) FILTER (passband = {k}) AS q_obs_{b}, count(*) FILTER (passband = {k} AND detected_bool = 1) AS q_det_{b}" for k, b in enumerate(BANDS))} FROM qo GROUP BY object_id),
q AS (SELECT *, neg / greatest(q_n_det, 1) AS q_neg_flux_frac, {_div("greatest(" + ", ".join(f"q_obs_{b}" for b in BANDS) + ")", "q_n_obs")} AS q_single_band_frac, {_div("greatest(" + ", ".join(f"q_det_{b}" for b in BANDS) + ")", "q_n_det")} AS q_dominant_band_det_frac,
  {" + ".join(f"(q_obs_{b} > 0)::INT" for b in BANDS)} AS q_n_bands, {" + ".join(f"(q_det_{b} > 0)::INT" for b in BANDS)} AS q_n_bands_detected, {_div("q_n_det", "q_n_obs")} AS q_det_frac FROM qa)"""
_Q_DOUBLE = ("q_err_ratio_mean", "q_err_ratio_median", "q_err_ratio_max", "q_det_snr_median", "q_det_snr_min", "q_err_min", "q_t_span", "q_neg_flux_frac", "q_single_band_frac", "q_dominant_band_det_frac", "q_det_frac")
_Q_INT = ("q_n_obs", "q_n_det", "q_duplicate_epochs", "q_n_bands", "q_n_bands_detected", *(f"q_{x}_{b}" for b in BANDS for x in ("obs", "det")))


def quality_features(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(features.quality_features(views.photometry(spark, sf_dir)))


_quality_features_sql = f"WITH {_Q_SQL} SELECT object_id, " + _i(*_Q_INT) + ", " + ", ".join(map(_r, _Q_DOUBLE)) + " FROM q"

_c01 = lambda x: f"least(greatest(({x})::DOUBLE, 0.0), 1.0)"
_PEN = {
    "neg_flux": _c01("q_neg_flux_frac / 0.35"), "few_detections": _c01("1 - q_n_det / 8"), "dominant_band": _c01("(coalesce(q_dominant_band_det_frac, 0) - 0.7) / (0.9::DOUBLE - 0.7::DOUBLE)"), "high_error": _c01("(coalesce(q_err_ratio_median, 0) - 0.25) / 0.5"),
    "thin_coverage": _c01("(4 - q_n_bands_detected) / 3"), "duplicates": _c01("q_duplicate_epochs / 10"), "low_snr": _c01("1 - coalesce(q_det_snr_median, 10) / 5"),
}
_P = ", ".join(f"qpen_{k}" for k in _PEN)
_QUALITY_SQL = f"""{_Q_SQL}, pen AS (SELECT object_id, {", ".join(f"{x} AS qpen_{k}" for k, x in _PEN.items())} FROM q),
sev AS (SELECT *, 1 - {_c01("0.8 * greatest(" + _P + ") + 0.2 * (" + " + ".join(f"qpen_{k}" for k in _PEN) + " - greatest(" + _P + ")) / 6")} AS raw_q FROM pen),
qual AS (SELECT *, CASE WHEN raw_q < 0.25 THEN 0.125 ELSE raw_q END AS quality FROM sev)"""


def quality_gate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(quality.quality(features.quality_features(views.photometry(spark, sf_dir))))


_quality_gate_sql = f"WITH {_QUALITY_SQL} SELECT object_id, " + ", ".join(_r(f"qpen_{k}") for k in _PEN) + ", " + _r("quality") + " FROM qual"

_PEAKS_SQL = f"""{PHOTOMETRY_SQL},
peaks AS (SELECT object_id, {", ".join(f"max(flux) FILTER (passband = {k}) AS p_{b}, first(mjd ORDER BY flux DESC, mjd) FILTER (passband = {k}) AS t_{b}, first(mjd ORDER BY flux DESC, mjd) FILTER (passband = {k}) - min(mjd) FILTER (passband = {k}) AS r_{b}, max(mjd) FILTER (passband = {k}) - first(mjd ORDER BY flux DESC, mjd) FILTER (passband = {k}) AS d_{b}" for k, b in enumerate(BANDS))} FROM phot GROUP BY object_id),
mags AS (SELECT *, {", ".join(f"{_mag(f'p_{b}')} AS m_{b}" for b in BANDS)} FROM peaks)"""


def colour_features(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(features.colour_features(features.band_peaks(views.photometry(spark, sf_dir))))


_colour_sql = f"WITH {_PEAKS_SQL} SELECT object_id, " + ", ".join(_r(f"CASE WHEN m_{a} IS NOT NULL AND m_{b} IS NOT NULL THEN least(greatest(m_{a} - m_{b}, -12.0), 12.0) END", f"col_{a}m{b}") for a, b in ("ug", "gr", "ri", "iz", "zy", "gi", "rz", "ur", "gz")) + ", " + ", ".join(_r(f"t_{a} - t_{b}", f"col_dt_{a}m{b}") for a, b in ("gr", "ri", "ug", "iz")) + ", " + _r("1 / (0.2 + abs(m_g - m_r))", "col_temp_proxy") + ", (" + " + ".join(f"coalesce((p_{b} > 0)::INT, 0)" for b in BANDS) + ")::BIGINT AS col_n_bands_positive FROM mags"


def physics_features(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(features.physics_features(features.band_peaks(views.photometry(spark, sf_dir)), views.metadata(spark, sf_dir)), 4)


def host_features(spark: SparkSession, sf_dir: str) -> DataFrame:
    meta = views.metadata(spark, sf_dir)
    return rounded(features.host_features(meta, meta), 4)


def uncertainty_features(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(features.uncertainty_features(features.band_peaks(views.photometry(spark, sf_dir)), views.metadata(spark, sf_dir)), 4)


def _modulus_sql(z: str) -> str:
    """Distance modulus of a redshift by interpolation in g.grid."""
    at = f"(ln(1 + least(greatest({z}, 0.0), {physics.Z_MAX})) / step)"
    k = f"least(floor({at}), {physics.GRID_STEPS - 1})::INT"
    return f"(5 * log10((grid[{k} + 1] + (grid[{k} + 2] - grid[{k} + 1]) * ({at} - {k})) * (1 + {z}) * 1e6) - 5)"


def _placed_sql() -> str:
    """CTEs up to ``pl``: peaks and magnitudes, metadata, redshift, modulus, dust, draws and their moduli."""
    from statistics import NormalDist

    step, grid = physics.comoving_grid()
    q = [NormalDist().inv_cdf((k + 0.5) / 24) for k in range(24)]
    return f"""{_PEAKS_SQL}, {METADATA_SQL}, g AS (SELECT {grid}::DOUBLE[] AS grid, {step!r}::DOUBLE AS step, {q}::DOUBLE[] AS q),
z1 AS (SELECT m.*, coalesce(hostgal_photoz, 0.0) AS zz, coalesce(mwebv, 0.0) AS ebv, CASE WHEN distmod > 0 THEN 1 WHEN coalesce(hostgal_photoz, 0.0) > 1e-4 THEN 0 ELSE -1 END AS flag FROM meta m),
z2 AS (SELECT z1.*, CASE WHEN flag = 1 THEN distmod WHEN flag = 0 THEN {_modulus_sql("least(greatest(zz, 1e-4), 6.0)")} ELSE 0.0 END AS dm,
  list_sort(list_transform(list_transform(q, lambda s: least(greatest(zz + greatest(coalesce(hostgal_photoz_err, 0.0), 1e-4) * s, 1e-4), 8.0)), lambda d: {_modulus_sql("d")})) AS dms,
  exp(-least(coalesce(hostgal_photoz_err, 1.0) / greatest(zz, 1e-4), 5.0) / 0.15) AS base FROM z1, g),
pl AS (SELECT p.*, z2.* EXCLUDE (object_id), CASE WHEN flag < 0 AND zz <= 1e-3 THEN 1.0 WHEN flag < 0 THEN 0.0 WHEN flag >= 1 THEN greatest(base, 0.9) ELSE base END AS z_rel,
  greatest({", ".join(f"p_{b}" for b in BANDS)}) AS p_max FROM mags p LEFT JOIN z2 USING (object_id))"""


def _r4(x: str, n: str) -> str:
    return f"round(({x})::DOUBLE + {NUDGE}, 4) + 0.0 AS {n}"


def _physics_sql() -> str:
    absmag = {b: f"(m_{b} - dm - ebv * 3.1 * {physics.EXTINCTION[k]})" for k, b in enumerate(BANDS)}
    own = [_r4("zz", "phys_z"), _r4("coalesce(hostgal_photoz_err, 0.0)", "phys_z_err"), _r4("dm", "phys_distmod"), "flag::BIGINT AS phys_distmod_source", _r4("ebv", "phys_mwebv")]
    for k, b in enumerate(BANDS):
        own += [_r4(absmag[b], f"phys_absmag_{b}"), _r4(f"ebv * 3.1 * {physics.EXTINCTION[k]}", f"phys_A_{b}"), _r4(f"r_{b} / greatest(1 + zz, 1.0)", f"phys_rf_rise_{b}"), _r4(f"d_{b} / greatest(1 + zz, 1.0)", f"phys_rf_decline_{b}")]
    own += [_r4("greatest(" + ", ".join(absmag.values()) + ")", "phys_absmag_max"), _r4("least(" + ", ".join(absmag.values()) + ")", "phys_absmag_min"), _r4(f"{_mag('p_max')} - dm", "phys_peak_luminosity")]
    return f"WITH {_placed_sql()} SELECT object_id, {', '.join(own)} FROM pl"


def _host_sql() -> str:
    pd = f"radians({physics.POLE_DEC})"
    return f"""WITH {METADATA_SQL}, a AS (SELECT *, radians(ra - {physics.POLE_RA}) AS a, radians(decl) AS de FROM meta),
h AS (SELECT *, {physics.POLE_L} - degrees(atan2(cos(de) * sin(a), sin(de) * cos({pd}) - cos(de) * sin({pd}) * cos(a))) AS l, degrees(asin(least(greatest(sin(de) * sin({pd}) + cos(de) * cos({pd}) * cos(a), -1.0), 1.0))) AS b FROM a)
SELECT object_id, {_r4("ra", "host_ra")}, {_r4("decl", "host_decl")}, {_r4("l - 360 * floor(l / 360)", "host_gal_l")}, {_r4("b", "host_gal_b")}, {_r4("abs(b)", "host_abs_gal_b")}, {_r4("ddf_bool", "host_ddf")}, {_r4("(hostgal_specz IS NOT NULL)::INT", "host_has_specz")}, {_r4("coalesce(hostgal_specz, 0.0)", "host_specz")} FROM h"""


def _uncertainty_sql() -> str:
    q = lambda share: f"{_mag('p_max')} - (dms[{int((1 - share) * 23) + 1}] + (dms[{int((1 - share) * 23) + 2}] - dms[{int((1 - share) * 23) + 1}]) * {(1 - share) * 23 - int((1 - share) * 23)!r})"
    std = "list_stddev_pop(dms)"
    own = [_r4(f"CASE WHEN p_max > 0 THEN {std} END", "unc_absmag_std"), _r4(q(0.16), "unc_absmag_q16"), _r4(q(0.84), "unc_absmag_q84"), _r4(f"{_mag('p_max')} - list_avg(dms)", "unc_absmag_mean"), _r4(std, "unc_distmod_std"), _r4("z_rel", "unc_z_reliability"), _r4(f"least(greatest(z_rel * exp(-CASE WHEN p_max > 0 THEN {std} ELSE 3.0 END / 1.5), 0.0), 1.0)", "unc_feature_reliability")]
    return f"WITH {_placed_sql()} SELECT object_id, {', '.join(own)} FROM pl"


def feature_matrix(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All blocks of features, one row for each object."""
    out = features.feature_matrix(views.photometry(spark, sf_dir), views.metadata(spark, sf_dir))
    four = {c: 4 for c in out.columns if c.startswith(("phys_", "host_", "unc_"))}
    out = out.withColumns({f"{b}_t_centroid": F.round(f"{b}_t_centroid", 3) for b in BANDS})
    return rounded(out, other=four)


def _matrix_sql() -> str:
    parts = (_band_matrix_sql, _global_sql, _colour_sql, _physics_sql(), _host_sql(), _uncertainty_sql(), _quality_features_sql)
    return "SELECT * FROM " + " JOIN ".join(f"({sql}) t{k}" + (" USING (object_id)" if k else "") for k, sql in enumerate(parts))


def early_window(spark: SparkSession, sf_dir: str) -> DataFrame:
    obs = views.photometry(spark, sf_dir)
    return rounded(features.views(obs, (7, 15, 30)).groupBy("object_id", F.col("view").cast("int").alias("days")).agg(F.count(F.lit(1)).alias("n_obs"), F.max("flux").alias("flux_max")))


_early_sql = f"WITH {PHOTOMETRY_SQL}, f AS (SELECT *, min(mjd) OVER (PARTITION BY object_id) AS m FROM phot) SELECT object_id, count(*)::BIGINT AS n_obs, {_r('max(flux)', 'flux_max')}, days::BIGINT AS days FROM f, (SELECT unnest([7, 15, 30]) AS days) WHERE mjd <= m + days GROUP BY object_id, days"


def part_statistics(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The grouped statistics on a larger table: prices by part and return flag over ship dates."""
    li = spark.read.parquet(f"{sf_dir}/lineitem.parquet")
    obs = li.select(F.col("l_partkey").alias("object_id"), (F.unix_micros(F.col("l_shipdate").cast("timestamp")) / 86400000000.0).alias("mjd"), F.when(F.col("l_returnflag") == "A", 0).when(F.col("l_returnflag") == "N", 1).otherwise(2).alias("passband"), (F.col("l_extendedprice") / 1000.0).alias("flux"), (1.0 + F.col("l_quantity")).alias("flux_err"), F.lit(1).alias("detected_bool"))
    return rounded(features.band_statistics(obs).select("object_id", "passband", "n_obs", "flux_max", "flux_mean", "flux_std", "flux_p50", "gap_max", "flux_range"))


_part_sql = f"""WITH o AS (SELECT l_partkey AS object_id, epoch_us(l_shipdate)::DOUBLE / 86400000000.0::DOUBLE AS mjd, CASE l_returnflag WHEN 'A' THEN 0 WHEN 'N' THEN 1 ELSE 2 END AS passband, l_extendedprice / 1000.0::DOUBLE AS flux FROM lineitem),
g AS (SELECT *, mjd - lag(mjd) OVER (PARTITION BY object_id, passband ORDER BY mjd, flux) AS gap FROM o)
SELECT object_id, passband::BIGINT AS passband, count(*)::BIGINT AS n_obs, {_r("max(flux)", "flux_max")}, {_r("avg(flux)", "flux_mean")}, {_r("stddev_samp(flux)", "flux_std")}, {_r("quantile_cont(flux, 0.5)", "flux_p50")}, {_r("max(gap)", "gap_max")}, {_r("max(flux) - min(flux)", "flux_range")} FROM g GROUP BY ALL"""


def population_lookup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Objects with their population's name and family; unknown codes are named so."""
    m = views.metadata(spark, sf_dir).select("object_id", F.when(F.col("object_id") % 10 == 9, F.col("code") + 5000).otherwise(F.col("code")).alias("code"))
    j = m.join(F.broadcast(taxonomy(spark)), "code", "left")
    return j.select("object_id", F.col("code").cast("long").alias("code"), F.coalesce("name", F.concat(F.lit("unknown-"), F.col("code"))).alias("name"), F.coalesce("family", F.lit("unknown")).alias("family"), F.coalesce("held_out", F.lit(False)).alias("held_out"))


_TAX_SQL = "tax AS (SELECT * FROM (VALUES " + ", ".join(f"({c}, '{n}', '{f}', {h})" for c, n, f, h in POPULATIONS) + ") t(code, name, family, held_out))"
_lookup_sql = f"WITH {METADATA_SQL}, {_TAX_SQL}, m AS (SELECT object_id, CASE WHEN object_id % 10 = 9 THEN code + 5000 ELSE code END AS code FROM meta) SELECT object_id, m.code::BIGINT AS code, coalesce(name, 'unknown-' || m.code) AS name, coalesce(family, 'unknown') AS family, coalesce(held_out, false) AS held_out FROM m LEFT JOIN tax ON m.code = tax.code"

# ---- evidence ----------------------------------------------------------------

_K = len(KNOWN)
_SIMPLEX_SQL = f"""{PROBABILITIES_SQL},
cent AS (SELECT label, [{", ".join(f"avg(p[{i + 1}])" for i in range(_K))}] AS c FROM proba GROUP BY label),
cents AS (SELECT list(c) AS cs FROM cent),
pn AS (SELECT object_id, label, list_transform(p, lambda v: v / list_sum(p)) AS p, cs FROM proba, cents),
ps AS (SELECT *, list_sort(p, 'DESC') AS s FROM pn),
chan AS (SELECT object_id, label, 1 - s[1] AS taxonomy_gap, list_sum(list_transform(p, lambda v: -v * ln(v))) / ln({_K}) AS prior_entropy,
  0.5 * list_min(list_transform(cs, lambda c: list_sum(list_transform(list_zip(p, c), lambda z: abs(z[1] - z[2]))))) AS simplex_novelty, 1 - (s[1] - s[2]) AS novelty_gap,
  ({list(KNOWN)})[list_position(p, s[1])] AS best_fit_code, s[1] AS best_fit_prob, ({list(KNOWN)})[list_position(p, s[2])] AS runner_up_code, s[2] AS runner_up_prob FROM ps)"""


def _simplex(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = views.probabilities(spark, sf_dir)
    return evidence.simplex_channels(p, evidence.centroids(p))


def simplex_channels(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(_simplex(spark, sf_dir))


_simplex_sql = f"WITH {_SIMPLEX_SQL} SELECT object_id, " + _i("label", "best_fit_code", "runner_up_code") + ", " + ", ".join(map(_r, ("taxonomy_gap", "prior_entropy", "simplex_novelty", "novelty_gap", "best_fit_prob", "runner_up_prob"))) + " FROM chan"

_KNN_SQL = """e AS (SELECT vec_id AS object_id, label, list_transform(embedding, lambda v: v::DOUBLE) AS x FROM embeddings),
dist AS (SELECT q.object_id AS query_id, r.object_id, r.label, sqrt(list_sum(list_transform(list_zip(q.x, r.x), lambda z: (z[1] - z[2]) * (z[1] - z[2])))) AS distance FROM e q, e r WHERE q.object_id % 20 = 0 AND q.object_id <> r.object_id),
near AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY distance, object_id) AS rank FROM dist QUALIFY rank <= 25)"""


def _near(spark: SparkSession, sf_dir: str, k: int = 25) -> DataFrame:
    e = spark.read.parquet(f"{sf_dir}/embeddings.parquet").select(F.col("vec_id").alias("object_id"), "label", F.col("embedding").alias("x"))
    return evidence.neighbours(e.filter("object_id % 20 = 0"), e, k)


def nearest_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(_near(spark, sf_dir))


_knn_sql = f"WITH {_KNN_SQL} SELECT query_id, object_id, label::BIGINT AS label, {_r('distance')}, rank::BIGINT AS rank FROM near"


def neighbour_cells(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How many cells the exact search of each stated query visits, of all."""
    e = spark.read.parquet(f"{sf_dir}/embeddings.parquet").select(F.col("vec_id").alias("object_id"), "label", F.col("embedding").alias("x"))
    return neighbours.PivotIndex(cell_rows=128).fit(e).visited(e.filter("object_id % 20 = 0"), 25)


def neighbour_channels(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(evidence.neighbour_channels(_near(spark, sf_dir), 10))


_nch_sql = f"WITH {_KNN_SQL}, sh AS (SELECT query_id, label, count(*) AS n, sum(distance) AS d, min(distance) AS m, count(*) / sum(count(*)) OVER (PARTITION BY query_id) AS share FROM near GROUP BY query_id, label) SELECT query_id AS object_id, {_r('-sum(share * ln(share)) / ln(10)', 'neighbor_entropy')}, {_r('sum(d) / sum(n)', 'neighbour_mean_distance')}, {_r('min(m)', 'neighbour_min_distance')} FROM sh GROUP BY query_id"


def galactic_probability(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(evidence.galactic_probability(views.probabilities(spark, sf_dir)))


def family_misfit(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(evidence.family_misfit(views.probabilities(spark, sf_dir), _near(spark, sf_dir)))


_gal_sql = f"WITH {PROBABILITIES_SQL} SELECT object_id, {_r(' + '.join(f'p[{i + 1}]' for i, c in enumerate(KNOWN) if c in IS_GALACTIC), 'p_galactic')} FROM proba"

_GALACTIC_SQL = " + ".join(f"p[{i + 1}]" for i in evidence.GALACTIC_LABELS)
_misfit_sql = f"WITH {PROBABILITIES_SQL}, {_KNN_SQL}, sh AS (SELECT query_id AS object_id, avg((label IN {evidence.GALACTIC_LABELS})::INT) AS share FROM near GROUP BY query_id) SELECT object_id, {_r(f'abs({_GALACTIC_SQL} - share)', 'family_misfit')} FROM proba JOIN sh USING (object_id)"
#: The components of an embedding, all of them.
_FEATS = [f"f{i}" for i in range(64)]


def _vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = spark.read.parquet(f"{sf_dir}/embeddings.parquet")
    return e.select(F.col("vec_id").alias("object_id"), F.col("label").cast("int").alias("label"), *(F.col("embedding")[i].cast("double").alias(f) for i, f in enumerate(_FEATS)))


def _packed(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The vectors as they are, in one array column x."""
    e = spark.read.parquet(f"{sf_dir}/embeddings.parquet")
    return e.select(F.col("vec_id").alias("object_id"), F.col("label").cast("int").alias("label"), F.transform("embedding", lambda v: v.cast("double")).alias("x"))


_LONG_SQL = f"lf AS (SELECT vec_id AS object_id, label, 'f' || i AS feature, embedding[i + 1]::DOUBLE AS v FROM embeddings, (SELECT unnest(range({len(_FEATS)})) AS i)), cs AS (SELECT label, feature, avg(v) AS mean, stddev_samp(v) AS sd FROM lf GROUP BY label, feature)"


def class_statistics(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(evidence.class_statistics(_packed(spark, sf_dir), _FEATS))


_cstat_sql = f"WITH {_LONG_SQL} SELECT label::BIGINT AS label, feature, {_r('mean')}, {_r('sd')} FROM cs"


def _physics_channels(spark: SparkSession, sf_dir: str) -> DataFrame:
    v = _packed(spark, sf_dir)
    rows = v.join(views.probabilities(spark, sf_dir).select("object_id", "p"), "object_id")
    return evidence.physics_channels(rows, evidence.class_statistics(v, _FEATS), _FEATS)


def physics_gap(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The least deviation from any class, and the one expected under the probabilities."""
    return rounded(_physics_channels(spark, sf_dir))


_GAP_SQL = f"{_LONG_SQL}, chi AS (SELECT object_id, cs.label AS class, avg(((v - mean) / sd) * ((v - mean) / sd)) AS chi2 FROM lf JOIN cs ON lf.feature = cs.feature AND sd > 1e-12 GROUP BY object_id, cs.label), gap AS (SELECT object_id, min(chi2) AS physics_gap, first(class ORDER BY chi2, class) AS nearest_class, sum(chi2 * p[class + 1]) AS cc_weighted FROM chi JOIN proba USING (object_id) GROUP BY object_id)"
_gap_sql = f"WITH {PROBABILITIES_SQL}, {_GAP_SQL} SELECT object_id, {_r('physics_gap')}, nearest_class::BIGINT AS nearest_class, {_r('cc_weighted')} FROM gap"


def quantile_channel(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A raw channel mapped to its mid-rank in the objects of the first classes."""
    v = _vectors(spark, sf_dir).select("object_id", "label")
    g = _physics_channels(spark, sf_dir).withColumn("g", F.round("physics_gap", 2)).join(v, "object_id")
    return rounded(evidence.quantile_map(g.select("object_id", "g"), g.filter(_REFERENCE), "g"))


#: The reference population of fits over embeddings: the first classes.
_REFERENCE = "label < 5"
_qmap_sql = f"WITH {PROBABILITIES_SQL}, {_GAP_SQL}, g AS (SELECT object_id, label, round(physics_gap, 2) AS g FROM gap JOIN proba USING (object_id)), r AS (SELECT g AS v FROM g WHERE {_REFERENCE}) SELECT object_id, round(g + {NUDGE}, 5) + 0.0 AS g, {_r('((SELECT count(*) FROM r WHERE v < g.g) + (SELECT count(*) FROM r WHERE v = g.g) / 2) / (SELECT count(*) FROM r)', 'mapped')} FROM g"


def rank01(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents by length, placed from 0 to 1."""
    d = spark.read.parquet(f"{sf_dir}/documents.parquet").select(F.col("doc_id").alias("object_id"), F.col("n_chars").cast("double").alias("n_chars"))
    return rounded(evidence.rank01(d, "n_chars"))


_rank01_sql = f"SELECT doc_id AS object_id, {_r('(row_number() OVER (ORDER BY n_chars NULLS FIRST, doc_id) - 1) / greatest(count(*) OVER () - 1, 1)', 'mapped')} FROM documents"

# ---- ranking -----------------------------------------------------------------


def _evidence(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All channels of every object: probabilities, neighbours, class statistics, and the
    quality gate and redshift reliability of the object's observations. An object without
    observations has quality and reliability 1. Inputs of several channels are written
    once, and so is the result, which is read by several passes."""
    p = stages.written(views.probabilities(spark, sf_dir))
    e = spark.read.parquet(f"{sf_dir}/embeddings.parquet").select(F.col("vec_id").alias("object_id"), "label", F.col("embedding").alias("x"))
    near = stages.written(evidence.neighbours(e, e, 25))
    gap = _physics_channels(spark, sf_dir).select("object_id", F.round(F.col("physics_gap") + NUDGE, 6).alias("gap"), F.round(F.col("cc_weighted") + NUDGE, 6).alias("cc"))
    gap = stages.written(gap)
    out = evidence.simplex_channels(p, evidence.centroids(p)).join(evidence.quantile_maps(gap, gap, {"gap": "physics_gap", "cc": "cc_weighted"}), "object_id")
    out = out.join(evidence.neighbour_channels(near, 10).select("object_id", "neighbor_entropy"), "object_id").join(evidence.family_misfit(p, near), "object_id")
    gate = quality.quality(features.quality_features(views.photometry(spark, sf_dir))).select("object_id", "quality")
    meta = views.metadata(spark, sf_dir)
    z = F.coalesce(F.col("hostgal_photoz"), F.lit(0.0))
    known = meta.select("object_id", physics.reliability(z, F.col("hostgal_photoz_err"), physics.resolve_distmod(F.col("distmod"), z)[1]).alias("reliability"))
    out = out.join(gate, "object_id", "left").join(known, "object_id", "left")
    one = F.lit(1.0)
    return stages.written(out.withColumns({"quality": F.coalesce("quality", one), "reliability": F.coalesce("reliability", one), "uncertainty": F.col("prior_entropy"), "y": F.col("label").isin(0, 3, 7).cast("int")}))


def evidence_channels(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(_evidence(spark, sf_dir))


_W = ranking.normalised(ranking.BASELINE)
_MEAN = "(taxonomy_gap + simplex_novelty + novelty_gap) / 3"
_EVIDENCE_SQL = f"""{_SIMPLEX_SQL}, {_GAP_SQL}, {_QUALITY_SQL}, {METADATA_SQL},
ex AS (SELECT vec_id AS object_id, label, list_transform(embedding, lambda v: v::DOUBLE) AS x FROM embeddings),
nn AS (SELECT a.object_id, b.label FROM ex a JOIN ex b ON a.object_id <> b.object_id QUALIFY row_number() OVER (PARTITION BY a.object_id ORDER BY list_distance(a.x, b.x), b.object_id) <= 25),
ns AS (SELECT object_id, label, count(*) / sum(count(*)) OVER (PARTITION BY object_id) AS share FROM nn GROUP BY object_id, label),
ne AS (SELECT object_id, -sum(share * ln(share)) / ln(10) AS neighbor_entropy, coalesce(sum(share) FILTER (label IN {evidence.GALACTIC_LABELS}), 0.0) AS galactic FROM ns GROUP BY object_id),
gm AS (SELECT object_id, round(physics_gap + {NUDGE}, 6) AS g, round(cc_weighted + {NUDGE}, 6) AS c FROM gap),
gq AS (SELECT object_id, (rank() OVER (ORDER BY g) - 1 + count(*) OVER (PARTITION BY g) / 2) / count(*) OVER () AS physics_gap, (rank() OVER (ORDER BY c) - 1 + count(*) OVER (PARTITION BY c) / 2) / count(*) OVER () AS cc_weighted FROM gm),
rb AS (SELECT *, coalesce(hostgal_photoz, 0.0) AS zz, exp(-least(coalesce(hostgal_photoz_err, 1.0) / greatest(coalesce(hostgal_photoz, 0.0), 1e-4), 5.0) / 0.15) AS base FROM meta),
rl AS (SELECT object_id, CASE WHEN distmod > 0 THEN greatest(base, 0.9) WHEN zz > 1e-4 THEN base WHEN zz <= 1e-3 THEN 1.0 ELSE 0.0 END AS reliability FROM rb),
ev AS (SELECT chan.*, gq.physics_gap, gq.cc_weighted, neighbor_entropy, abs({_GALACTIC_SQL} - galactic) AS family_misfit, coalesce(quality, 1.0) AS quality, coalesce(reliability, 1.0) AS reliability, prior_entropy AS uncertainty, (chan.label IN (0, 3, 7))::INT AS y
  FROM chan JOIN gq USING (object_id) JOIN ne USING (object_id) JOIN proba USING (object_id) LEFT JOIN qual USING (object_id) LEFT JOIN rl USING (object_id))"""
_EV_OUT = ("taxonomy_gap", "prior_entropy", "simplex_novelty", "novelty_gap", "best_fit_prob", "runner_up_prob", "physics_gap", "cc_weighted", "neighbor_entropy", "family_misfit", "quality", "reliability", "uncertainty")
_channels_sql = f"WITH {_EVIDENCE_SQL} SELECT object_id, {_i('label', 'best_fit_code', 'runner_up_code', 'y')}, {', '.join(map(_r, _EV_OUT))} FROM ev"
_RANK_SQL = f"""{_EVIDENCE_SQL}, s1 AS (SELECT *, {" + ".join(f"{c} * {w!r}::DOUBLE" for c, w in _W.items())} AS raw_evidence, {_MEAN} AS mu, least(greatest((1 - least(greatest(uncertainty, 0.0), 1.0)) * quality, 0.0), 1.0) AS confidence FROM ev),
s2 AS (SELECT *, least(greatest(1 - sqrt(((taxonomy_gap - mu)**2 + (simplex_novelty - mu)**2 + (novelty_gap - mu)**2) / 3) / greatest(mu + 0.5, 1e-9), 0.0), 1.0) AS agreement FROM s1),
s3 AS (SELECT *, raw_evidence * least(greatest(quality, 1e-6), 1.0)**0.5 * least(greatest(confidence, 1e-6), 1.0)**0.25 * (1 + 0.15 * agreement) AS score FROM s2),
s4 AS (SELECT *, score / greatest(max(score) OVER (), 1e-12) AS normalised_score, (SELECT quantile_cont(uncertainty, 0.97) FROM s3) AS cut, row_number() OVER (ORDER BY score DESC, object_id) AS rank FROM s3),
s5 AS (SELECT *, CASE WHEN normalised_score >= 0.95 THEN 'critical' WHEN normalised_score >= 0.85 THEN 'high' WHEN normalised_score >= 0.6 THEN 'moderate' ELSE 'routine' END AS tier,
  CASE WHEN quality < 0.3 THEN 'low data quality' WHEN uncertainty > cut THEN 'high predictive uncertainty' WHEN reliability < 0.05 THEN 'no reliable distance information' END AS why FROM s4),
ranked AS (SELECT *, why IS NOT NULL AS abstain, CASE WHEN why IS NULL THEN '' WHEN normalised_score > 0.5 THEN why || ' (would otherwise rank highly)' ELSE why END AS abstain_reason FROM s5)"""
_RANK_OUT = ("raw_evidence", "agreement", "confidence", "score", "normalised_score")


def _ranked(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ranking.rank(ranking.scores(_evidence(spark, sf_dir)))


def review_queue(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(_ranked(spark, sf_dir).select("object_id", "rank", *_RANK_OUT, "tier", "abstain", "abstain_reason"))


_queue_sql = f"WITH {_RANK_SQL} SELECT object_id, rank::BIGINT AS rank, " + ", ".join(map(_r, _RANK_OUT)) + ", tier, abstain, abstain_reason FROM ranked"


def queue_page(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A page of the queue: the second twenty of those that are not of poor quality."""
    s = ranking.scores(_evidence(spark, sf_dir)).filter(F.col("quality") >= 0.3)
    return rounded(ranking.top(s, 20, 20).select("object_id", "score", "best_fit_code"))


_page_sql = f"WITH {_RANK_SQL} SELECT object_id, {_r('score')}, best_fit_code::BIGINT AS best_fit_code FROM ranked WHERE quality >= 0.3 ORDER BY ranked.score DESC, object_id LIMIT 20 OFFSET 20"


def queue_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    r = _ranked(spark, sf_dir)
    return rounded(r.groupBy("tier").agg(F.count(F.lit(1)).alias("n"), F.count_if("abstain").alias("abstained"), F.max("score").alias("max_score"), F.min("score").alias("min_score"), F.avg("y").alias("base_rate")))


_summary_sql = f"WITH {_RANK_SQL} SELECT tier, count(*)::BIGINT AS n, count(*) FILTER (abstain)::BIGINT AS abstained, {_r('max(score)', 'max_score')}, {_r('min(score)', 'min_score')}, {_r('avg(y)', 'base_rate')} FROM ranked GROUP BY tier"


def abstention_policy(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = _evidence(spark, sf_dir).withColumn("domain_status", F.when(F.col("object_id") % 23 == 0, "abstain").when(F.col("object_id") % 5 == 0, "degraded").otherwise("matched"))
    return rounded(ranking.decisions(e).groupBy("abstain", "reason").agg(F.count(F.lit(1)).alias("n"), F.avg("confidence").alias("mean_confidence")))


_policy_sql = f"""WITH {_EVIDENCE_SQL}, d AS (SELECT least(greatest((1 - least(greatest(uncertainty, 0.0), 1.0)) * least(greatest(quality, 0.0), 1.0), 0.0), 1.0) AS confidence, object_id % 23 <> 0 AND object_id % 5 = 0 AS careful,
  CASE WHEN quality < 0.3 THEN '{ranking.LOW_QUALITY}' WHEN uncertainty > 0.9 THEN '{ranking.UNCERTAIN}' WHEN reliability < 0.05 THEN '{ranking.UNPLACED}' WHEN object_id % 23 = 0 THEN '{ranking.FOREIGN}' END AS r FROM ev)
SELECT r IS NOT NULL AS abstain, coalesce(r, CASE WHEN careful THEN '{ranking.DEGRADED}' ELSE '' END) AS reason, count(*)::BIGINT AS n, {_r('avg(confidence)', 'mean_confidence')} FROM d GROUP BY ALL"""

# ---- metrics -----------------------------------------------------------------


def _auc_sql(rows: str, by: str = "", weight: str = "1.0::DOUBLE") -> str:
    """CTE ``auc`` over rows(y, score[, by])."""
    g = f"{by}, " if by else ""
    p = f"PARTITION BY {by}" if by else ""
    return f"""blk AS (SELECT {g}score, sum(CASE WHEN y = 1 THEN {weight} ELSE 0 END) AS pos, sum(CASE WHEN y = 0 THEN {weight} ELSE 0 END) AS neg FROM {rows} GROUP BY {g}score),
cumul AS (SELECT *, sum(pos) OVER ({p} ORDER BY score DESC) AS tp, sum(neg) OVER ({p} ORDER BY score DESC) AS fp FROM blk),
auc AS (SELECT {g}sum(pos) AS n_pos, sum(neg) AS n_neg, CASE WHEN sum(pos) > 0 AND sum(neg) > 0 THEN sum(neg * (tp - pos / 2)) / (sum(pos) * sum(neg)) END AS roc_auc,
  CASE WHEN sum(pos) > 0 AND sum(neg) > 0 THEN coalesce(sum(pos * tp / (tp + fp)) FILTER (pos > 0), 0) / sum(pos) END AS average_precision FROM cumul {"GROUP BY " + by if by else ""})"""


_AUC_OUT = ", ".join(map(_r, ("n_pos", "n_neg", "roc_auc", "average_precision")))


def auc_and_ap(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(metrics.auc_and_ap(views.scored(spark, sf_dir)))


_auc_query_sql = f"WITH {SCORED_SQL}, {_auc_sql('scored')} SELECT {_AUC_OUT} FROM auc"


def weighted_auc(spark: SparkSession, sf_dir: str) -> DataFrame:
    w = F.when(F.col("y") == 0, metrics.negative_weight(0.1, 0.01)).otherwise(1.0)
    return rounded(metrics.auc_and_ap(views.scored(spark, sf_dir), weight=w), 4)


_wauc_sql = f"WITH {SCORED_SQL}, {_auc_sql('scored', '', f'CASE WHEN y = 0 THEN {metrics.negative_weight(0.1, 0.01)!r}::DOUBLE ELSE 1.0::DOUBLE END')} SELECT " + ", ".join(f"round({c} + {NUDGE}, 4) + 0.0 AS {c}" for c in ("n_pos", "n_neg", "roc_auc", "average_precision")) + " FROM auc"
_KS = (10, 50, 100)


def precision_at_k(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(metrics.at_k(views.scored(spark, sf_dir), _KS))


_TOP_SQL = f"{SCORED_SQL}, rk AS (SELECT *, row_number() OVER (ORDER BY score DESC, object_id) AS rank FROM scored), tot AS (SELECT count(*) AS n, sum(y) AS pos, avg(y) AS base FROM scored)"
_pk_sql = f"WITH {_TOP_SQL}, h AS (SELECT k, sum(y) AS hits, count(*) AS taken FROM rk, (SELECT unnest({list(_KS)}) AS k) WHERE rank <= k GROUP BY k) SELECT k::BIGINT AS k, hits::BIGINT AS hits, {_r('hits / taken', 'precision')}, {_r('hits / pos', 'recall')}, {_r('hits / taken / (pos / n)', 'lift')} FROM h, tot"
_TARGETS = (0.05, 0.01, 0.001)


def base_rate_stress(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The whole stress table, with the interval of each target's average precision over 100 draws."""
    return rounded(metrics.stress(views.scored(spark, sf_dir), _TARGETS, _KS, draws=100))


def _stress_sql() -> str:
    own = ", ".join(f"{_r(f'sum(y) FILTER (rank <= {k}) / (sum(y) FILTER (rank <= {k}) + any_value(nw) * sum(1 - y) FILTER (rank <= {k}))', f'p_at_{k}')}, {_r(f'sum(y) FILTER (rank <= {k}) / (sum(y) FILTER (rank <= {k}) + any_value(nw) * sum(1 - y) FILTER (rank <= {k})) / t.target', f'lift_at_{k}')}" for k in _KS)
    recall = ", ".join(_r(f"sum(y) FILTER (rank <= {k}) / sum(y)", f"r_at_{k}") for k in metrics.STRESS_RECALL_K)
    return f"""WITH {_TOP_SQL}, t AS (SELECT target, (base / (1 - base)) * ((1 - target) / target) AS nw FROM tot, (SELECT unnest({list(_TARGETS)}::DOUBLE[]) AS target) WHERE target < base),
wr AS (SELECT target, score, y, nw FROM scored, t), {_auc_sql('wr', 'target', 'CASE WHEN y = 0 THEN nw ELSE 1.0::DOUBLE END')},
{_drawn_sql(100).replace("dr AS", "dr0 AS", 1).replace("FROM dr)", "FROM dr0)")}, wd AS (SELECT target, draw, score, y, w * CASE WHEN y = 0 THEN nw ELSE 1.0::DOUBLE END AS w FROM kept, t),
db AS (SELECT target, draw, score, sum(w) FILTER (y = 1) AS pos, sum(w) FILTER (y = 0) AS neg FROM wd GROUP BY ALL),
dc AS (SELECT target, draw, coalesce(pos, 0) AS pos, coalesce(neg, 0) AS neg, sum(coalesce(pos, 0)) OVER v AS tp, sum(coalesce(neg, 0)) OVER v AS fp FROM db WINDOW v AS (PARTITION BY target, draw ORDER BY score DESC)),
da AS (SELECT target, draw, sum(pos * tp / (tp + fp)) FILTER (pos > 0) / sum(pos) AS ap FROM dc GROUP BY target, draw HAVING sum(pos) > 0 AND sum(neg) > 0),
ci AS (SELECT target, quantile_cont(ap, 0.025) AS lo, quantile_cont(ap, 0.975) AS hi FROM da GROUP BY target)
SELECT round(t.target + {NUDGE}, 5) + 0.0 AS target, {_r('any_value(nw)', 'negative_weight')}, {_r('any_value(roc_auc)', 'roc_auc')}, {_r('any_value(average_precision)', 'average_precision')}, {_r('any_value(lo)', 'ap_low')}, {_r('any_value(hi)', 'ap_high')}, {own}, {recall}
FROM t JOIN auc USING (target) JOIN ci USING (target), rk GROUP BY t.target"""


def per_class(spark: SparkSession, sf_dir: str) -> DataFrame:
    names = spark.createDataFrame([(f"src{k}", f"source {k}", k % 3 == 0) for k in range(20)], "grp string, name string, held_out boolean")
    return rounded(metrics.per_class(views.scored(spark, sf_dir), 100, names=names))


_class_sql = f"WITH {_TOP_SQL} SELECT grp, count(*)::BIGINT AS n, count(*) FILTER (rank <= 100)::BIGINT AS in_top, {_r('count(*) FILTER (rank <= 100) / count(*)', 'recall')}, {_r('count(*) FILTER (rank <= 100) / (count(*) / any_value(n) * 100)', 'enrichment')}, count(*) < 30 AS low_n, replace(grp, 'src', 'source ') AS name, replace(grp, 'src', '')::INT % 3 = 0 AS held_out FROM rk, tot GROUP BY grp"
_CH = ("taxonomy_gap", "prior_entropy", "simplex_novelty", "novelty_gap", "neighbor_entropy", "family_misfit", "physics_gap", "cc_weighted")


def channel_power(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = _evidence(spark, sf_dir).select("object_id", "y", F.explode(F.array(*(F.struct(F.lit(c).alias("channel"), F.round(c, 9).alias("score")) for c in _CH))).alias("v")).select("object_id", "y", "v.*")
    return rounded(metrics.auc_and_ap(e, ["channel"]))


_power_sql = f"WITH {_EVIDENCE_SQL}, ch AS (" + " UNION ALL ".join(f"SELECT object_id, y, '{c}' AS channel, round({c}, 9) AS score FROM ev" for c in _CH) + f"), {_auc_sql('ch', 'channel')} SELECT channel, {_AUC_OUT} FROM auc"


def uncertainty_value(spark: SparkSession, sf_dir: str) -> DataFrame:
    """AUC and purity of the queue among its most confident shares (half, three quarters, nine tenths)."""
    e = _evidence(spark, sf_dir)
    cuts = ordered.quantiles(e, ["uncertainty"], [0.5, 0.75, 0.9])["uncertainty"]
    kept = e.select("object_id", "y", F.round("taxonomy_gap", 9).alias("score"), "uncertainty", F.posexplode(F.array(*map(F.lit, cuts))).alias("nth", "cut")).filter("uncertainty <= cut")
    return rounded(metrics.evaluate(kept.withColumn("nth", F.col("nth").cast("long")), ["nth"], (20, 50, 100), (200,)))


def _uncertainty_value_sql() -> str:
    return f"WITH {_EVIDENCE_SQL}, cu AS (SELECT unnest([0, 1, 2]::BIGINT[]) AS nth, unnest([quantile_cont(uncertainty, 0.5), quantile_cont(uncertainty, 0.75), quantile_cont(uncertainty, 0.9)]) AS cut FROM ev), kept AS (SELECT nth, object_id, y, round(taxonomy_gap, 9) AS score FROM ev, cu WHERE uncertainty <= cut), " + _evaluated_sql("kept", "nth", (20, 50, 100), (200,))


def bootstrap_auc(spark: SparkSession, sf_dir: str) -> DataFrame:
    own = resampling.draw_metrics(views.scored(spark, sf_dir), 100, ks=())["roc_auc"]
    return rounded(spark.createDataFrame([resampling.interval(own)], "low double, high double, draws long"))


def _drawn_sql(draws: int) -> str:
    """CTE ``kept``: rows with y, score, draw and the weight w that the draw gives them."""
    v = f"('0x' || substr(md5('boot-42:' || object_id || '|' || (draw // {resampling.PER_DIGEST})), (1 + 4 * (draw % {resampling.PER_DIGEST}))::BIGINT, 4))::BIGINT"
    return f"""dr AS (SELECT object_id, y, score, draw, {v} AS v FROM scored, (SELECT unnest(range({draws})) AS draw)),
kept AS (SELECT * FROM (SELECT *, {" + ".join(f"(v >= {t})::INT" for t in resampling.THRESHOLDS)} AS w FROM dr) WHERE w > 0)"""


_boot_sql = f"WITH {SCORED_SQL}, {_drawn_sql(100)}, {_auc_sql('kept', 'draw', 'w::DOUBLE')} SELECT {_r('quantile_cont(roc_auc, 0.025)', 'low')}, {_r('quantile_cont(roc_auc, 0.975)', 'high')}, count(roc_auc)::BIGINT AS draws FROM auc"


def metric_intervals(spark: SparkSession, sf_dir: str) -> DataFrame:
    """AUC, average precision and precision at k, each with its interval over a thousand draws."""
    return rounded(resampling.intervals(views.scored(spark, sf_dir)))


def _intervals_sql(start: str = _TOP_SQL, ks: tuple[int, ...] = resampling.PRECISION_K) -> str:
    """``start`` has the CTEs scored (object_id, y, score) and rk (the same with rank)."""
    ks = list(ks)
    return f"""WITH {start}, {_drawn_sql(1000)}, {_auc_sql('kept', 'draw', 'w::DOUBLE')},
cw AS (SELECT draw, y, w, sum(w) OVER (PARTITION BY draw ORDER BY score DESC, object_id ROWS UNBOUNDED PRECEDING) - w AS before FROM kept),
pk AS (SELECT draw, k, sum(y * greatest(least(w, k - before), 0)) / sum(greatest(least(w, k - before), 0)) AS v FROM cw, (SELECT unnest({ks}) AS k) GROUP BY draw, k),
ok AS (SELECT draw FROM auc WHERE roc_auc IS NOT NULL),
vs AS (SELECT 'roc_auc' AS metric, roc_auc AS v FROM auc WHERE roc_auc IS NOT NULL UNION ALL SELECT 'average_precision', average_precision FROM auc WHERE roc_auc IS NOT NULL UNION ALL SELECT 'p_at_' || k, v FROM pk JOIN ok USING (draw)),
b0 AS (SELECT score, sum(y) AS pos, sum(1 - y) AS neg FROM scored GROUP BY score), b1 AS (SELECT *, sum(pos) OVER (ORDER BY score DESC) AS tp, sum(neg) OVER (ORDER BY score DESC) AS fp FROM b0),
pt AS (SELECT 'roc_auc' AS metric, sum(neg * (tp - pos / 2)) / (sum(pos) * sum(neg)) AS point FROM b1 UNION ALL SELECT 'average_precision', sum(pos * tp / (tp + fp)) FILTER (pos > 0) / sum(pos) FROM b1
  UNION ALL SELECT 'p_at_' || k, sum(y) / count(*) FROM rk, (SELECT unnest({ks}) AS k) WHERE rank <= k GROUP BY k)
SELECT metric, {_r('any_value(point)', 'point')}, {_r('quantile_cont(v, 0.025)', 'low')}, {_r('quantile_cont(v, 0.975)', 'high')}, count(*)::BIGINT AS draws, (SELECT least(sum(y), sum(1 - y)) < {resampling.SMALL} FROM scored) AS small_n FROM vs JOIN pt USING (metric) GROUP BY metric"""


def evaluation_bundle(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All ranking metrics by source and over all."""
    rows = views.scored(spark, sf_dir)
    both = rows.withColumn("grp", F.lit("all")).unionByName(rows.withColumn("grp", F.coalesce("grp", F.lit("none"))))
    return rounded(metrics.evaluate(both, ["grp"]))


def _bundle_sql() -> str:
    hit = lambda k: f"sum(CASE WHEN rank <= {k} THEN y ELSE 0 END)"
    p = lambda k: f"{hit(k)} / least(count(*), {k})"
    own = [x for k in metrics.PRECISION_K for x in (_r(p(k), f"p_at_{k}"), _r(f"CASE WHEN sum(y) > 0 THEN {p(k)} / (sum(y) / count(*)) END", f"lift_at_{k}"))] + [_r(f"CASE WHEN sum(y) > 0 THEN {hit(k)} / sum(y) END", f"r_at_{k}") for k in metrics.RECALL_K]
    return f"""WITH {SCORED_SQL}, bth AS (SELECT object_id, score, y, 'all' AS grp FROM scored UNION ALL SELECT object_id, score, y, coalesce(grp, 'none') FROM scored), {_auc_sql('bth', 'grp')},
rk AS (SELECT *, row_number() OVER (PARTITION BY grp ORDER BY score DESC, object_id) AS rank FROM bth),
ct AS (SELECT grp, count(*)::BIGINT AS n_objects, sum(y)::BIGINT AS n_novel, {_r("sum(y) / count(*)", "base_rate")}, {", ".join(own)} FROM rk GROUP BY grp)
SELECT ct.*, {_r("roc_auc")}, {_r("average_precision")} FROM ct JOIN auc USING (grp)"""


def weighted_precision(spark: SparkSession, sf_dir: str) -> DataFrame:
    w = F.when(F.col("y") == 0, metrics.negative_weight(0.1, 0.01)).otherwise(1.0)
    return rounded(metrics.weighted_at_k(views.scored(spark, sf_dir).withColumn("weight", w), _KS))


_wpk_sql = f"WITH {_TOP_SQL}, w AS (SELECT rk.*, CASE WHEN y = 0 THEN {metrics.negative_weight(0.1, 0.01)!r}::DOUBLE ELSE 1.0 END AS w FROM rk), h AS (SELECT k, sum(w * y) AS hit, sum(w) AS whole, sum(y) AS n FROM w, (SELECT unnest({list(_KS)}) AS k) WHERE rank <= k GROUP BY k) SELECT k::BIGINT AS k, {_r('hit / whole', 'precision')}, {_r('h.n / pos', 'recall')} FROM h, tot"


def weight_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(search.search(_evidence(spark, sf_dir)))


def _search_sql() -> str:
    from itertools import product

    rows = [(k, *(x / sum(v) for x in v)) for k, v in enumerate(product(*search.GRID.values()))]
    values = ", ".join(f"({r[0]}, {', '.join(f'{x!r}::DOUBLE' for x in r[1:])})" for r in rows)
    score = " + ".join(f"{c} * w_{c}" for c in search.GRID)
    return f"WITH {_EVIDENCE_SQL}, combos AS (SELECT * FROM (VALUES {values}) t(combo, {', '.join(f'w_{c}' for c in search.GRID)})), sc AS (SELECT combo, y, round({score}, 9) AS score FROM ev, combos), {_auc_sql('sc', 'combo')} SELECT combo::BIGINT AS combo, {_AUC_OUT} FROM auc"


def ablation(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(search.ablation(_evidence(spark, sf_dir), ranking.BASELINE))


def _ablation_sql() -> str:
    w0 = ranking.BASELINE
    variants = {"full": w0} | {k: v for c in w0 for k, v in ((f"drop_{c}", {a: b for a, b in w0.items() if a != c}), (f"plus_{c}", w0 | {c: w0[c] + 0.2}), (f"only_{c}", {c: 1.0}))}
    parts = [f"SELECT '{n}' AS variant, y, round({' + '.join(f'{c} * {x / sum(w.values())!r}::DOUBLE' for c, x in w.items())}, 9) AS score FROM ev" for n, w in variants.items()]
    return f"WITH {_EVIDENCE_SQL}, v AS ({' UNION ALL '.join(parts)}), {_auc_sql('v', 'variant')} SELECT variant, {_AUC_OUT} FROM auc"


def weight_variants(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(search.compare(_evidence(spark, sf_dir), _VARIANTS))


_VARIANTS = {"baseline": ranking.BASELINE, "entropy": {"taxonomy_gap": 1.0, "prior_entropy": 0.25}, "gap only": {"taxonomy_gap": 1.0}}
_variants_sql = f"WITH {_EVIDENCE_SQL}, v AS (" + " UNION ALL ".join(f"SELECT '{n}' AS variant, y, round({' + '.join(f'{c} * {x / sum(w.values())!r}::DOUBLE' for c, x in w.items())}, 9) AS score FROM ev" for n, w in _VARIANTS.items()) + f"), {_auc_sql('v', 'variant')} SELECT variant, {_AUC_OUT} FROM auc"
_NESTED = {c: search.GRID[c] for c in ("taxonomy_gap", "simplex_novelty", "novelty_gap", "prior_entropy")}
_SEEDS = (0, 1, 2, 3, 4)


def weight_optimism(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(search.optimism(_evidence(spark, sf_dir), _NESTED, _SEEDS))


def _optimism_sql() -> str:
    from itertools import product

    rows = [(k, *(x / sum(v) for x in v)) for k, v in enumerate(product(*_NESTED.values()))]
    values = ", ".join(f"({r[0]}, {', '.join(f'{x!r}::DOUBLE' for x in r[1:])})" for r in rows)
    score = " + ".join(f"{c} * w_{c}" for c in _NESTED)
    halves = " UNION ALL ".join(f"SELECT *, {s} AS seed, {_draw_sql(f'optimism-{s}', 'object_id')} < 0.5 AS selects FROM ev" for s in _SEEDS)
    return f"""WITH {_EVIDENCE_SQL}, combos AS (SELECT * FROM (VALUES {values}) t(combo, {', '.join(f'w_{c}' for c in _NESTED)})), half AS ({halves}),
sc AS (SELECT seed, selects, combo, y, round({score}, 9) AS score FROM half, combos), {_auc_sql('sc', 'seed, selects, combo')},
b AS (SELECT seed, combo, round(average_precision, 9) AS ap_select FROM auc WHERE selects AND average_precision IS NOT NULL QUALIFY row_number() OVER (PARTITION BY seed ORDER BY round(average_precision, 9) DESC, combo) = 1)
SELECT b.seed::BIGINT AS seed, b.combo::BIGINT AS combo, {_r('ap_select')}, {_r('round(average_precision, 9)', 'ap_report')}, {_r('ap_select - round(average_precision, 9)', 'optimism')} FROM b JOIN auc ON b.seed = auc.seed AND b.combo = auc.combo AND NOT auc.selects AND average_precision IS NOT NULL"""


def review_budget(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(metrics.review_budget(views.scored(spark, sf_dir), 0.01, _KS), 4)


_budget_sql = f"""WITH {_TOP_SQL}, h AS (SELECT k AS budget, sum(y)::DOUBLE AS pos, sum(1 - y)::DOUBLE AS neg FROM rk, (SELECT unnest({list(_KS)}) AS k) WHERE rank <= k GROUP BY k),
w AS (SELECT budget, h.pos, h.pos + neg * (base / (1 - base)) * (0.99::DOUBLE / 0.01::DOUBLE) AS mass FROM h, tot)
SELECT budget::BIGINT AS budget, round(mass + {NUDGE}, 4) AS expected_reviews, round(pos + {NUDGE}, 4) AS expected_recovered, round(pos / mass + {NUDGE}, 4) AS precision, round(pos / mass / 0.01::DOUBLE + {NUDGE}, 4) AS lift FROM w"""


def queue_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(metrics.audit(_ranked(spark, sf_dir)))


_audit_sql = f"WITH {_RANK_SQL} SELECT count(*)::BIGINT AS n, {_r('avg(quality)', 'mean_quality')}, {_r('min(quality)', 'min_quality')}, count_if(quality < 0.5)::BIGINT AS n_low_quality, {_r('avg(uncertainty)', 'mean_uncertainty')}, count_if(abstain)::BIGINT AS n_abstained, count_if(y = 0)::BIGINT AS n_false_positives, " + ", ".join(f"count_if(tier = '{t}')::BIGINT AS n_{t}" for t in ("critical", "high", "moderate", "routine")) + " FROM ranked WHERE rank <= 100"


# ---- the whole chain ---------------------------------------------------------


def _chain_features_sql(name: str, photometry: str) -> str:
    """CTE of the chain's features and the quality of the observations that ``photometry`` (a CTE phot) has."""
    g, c = (x.replace(PHOTOMETRY_SQL, photometry) for x in (_global_sql, _colour_sql))
    q = f"WITH {_QUALITY_SQL.replace(PHOTOMETRY_SQL, photometry)} SELECT object_id, quality FROM qual"
    own = ", ".join(f"coalesce({x}::DOUBLE, NULL) AS {x}" for x in chain.NAMES)
    return f"{name} AS (SELECT object_id, {own}, quality FROM ({g}) JOIN ({c}) USING (object_id) JOIN ({q}) USING (object_id))"


def _chain_sql(keyed: str | None = None) -> str:
    """CTEs up to ``ev``: the channels of the unseen objects, or of the sides of their
    observations that ``keyed`` (CTEs that end with keyed, in the columns of phot) has."""
    names, k = chain.NAMES, len(KNOWN)
    long = lambda rows, keep: f"SELECT {keep}, unnest({names}) AS feature, unnest([{', '.join(names)}]) AS v FROM {rows}"
    own_id = "object_id" if keyed is None else f"((-object_id - 1) // {chain.SIDES})"
    scored = "cf" if keyed is None else "ck"
    more = "" if keyed is None else f", {keyed}, {_chain_features_sql('ck', 'phot AS (SELECT * FROM keyed)')}"
    probability = f"coalesce(exp(-0.5 * chi), 0.0)"
    return f"""{METADATA_SQL}, {_chain_features_sql("cf", PHOTOMETRY_SQL)}{more},
lab AS (SELECT object_id, CASE WHEN list_position({list(KNOWN)}, code) > 0 THEN list_position({list(KNOWN)}, code) - 1 END AS label, {_draw_sql("chain", "object_id")} < {chain.FIT_SHARE}::DOUBLE AS fits, ({_draw_sql("chain-fold", "object_id")} < 0.5)::INT AS fold FROM meta),
rf AS (SELECT cf.*, label, fold FROM cf JOIN lab USING (object_id) WHERE fits AND label IS NOT NULL),
ts AS (SELECT c.* FROM {scored} c JOIN lab ON lab.object_id = {own_id.replace('object_id', 'c.object_id')} WHERE NOT fits),
lr AS ({long("rf", "object_id, label, fold")}), lt AS ({long("ts", "object_id")}),
lm AS (SELECT m, lr.* FROM lr, (SELECT unnest([0, 1, 2]) AS m) WHERE fold <> m AND v IS NOT NULL),
va AS (SELECT m, feature, var_samp(v) AS va FROM lm GROUP BY ALL), cl AS (SELECT m, label, feature, count(v) AS n, avg(v) AS mean, var_samp(v) AS vc FROM lm GROUP BY ALL),
st AS (SELECT m, label, feature, mean, sqrt(((n - 1) * coalesce(vc, 0) + {engine.PSEUDO_ROWS} * va) / (n - 1 + {engine.PSEUDO_ROWS})) AS sd FROM cl JOIN va USING (m, feature) WHERE va > 1e-24),
every AS (SELECT object_id, feature, v FROM lr UNION ALL SELECT object_id, feature, v FROM lt),
ch AS (SELECT object_id, m, label, sum(coalesce(((v - mean) / sd) * ((v - mean) / sd), 0.0)) / {len(names)} AS chi FROM every JOIN st USING (feature) GROUP BY ALL),
grid AS (SELECT object_id, m, l AS label FROM (SELECT DISTINCT object_id FROM every), (SELECT unnest([0, 1]) AS m), (SELECT unnest(range({k})) AS l)),
pe AS (SELECT object_id, m, label, {probability} AS e, sum({probability}) OVER (PARTITION BY object_id, m) AS t FROM grid LEFT JOIN ch USING (object_id, m, label)),
pm AS (SELECT object_id, m, label, greatest(CASE WHEN t > 0 THEN e / t ELSE {1 / k!r}::DOUBLE END, {engine.FLOOR}::DOUBLE) AS v FROM pe),
oof AS (SELECT rf.object_id, any_value(rf.label) AS label, list(v ORDER BY pm.label) AS p FROM pm JOIN rf ON rf.object_id = pm.object_id AND rf.fold = pm.m GROUP BY rf.object_id),
pa AS (SELECT object_id, label, avg(v) AS v FROM pm JOIN (SELECT DISTINCT object_id FROM lt) USING (object_id) GROUP BY object_id, label),
proba AS (SELECT object_id, list(v ORDER BY label) AS p FROM pa GROUP BY object_id),
cent AS (SELECT label, [{", ".join(f"avg(p[{i + 1}])" for i in range(k))}] AS c FROM oof GROUP BY label), cents AS (SELECT list(c) AS cs FROM cent),
pn AS (SELECT object_id, list_transform(p, lambda v: v / list_sum(p)) AS p, cs FROM proba, cents), ps AS (SELECT *, list_sort(p, 'DESC') AS s FROM pn),
sx AS (SELECT object_id, 1 - s[1] AS taxonomy_gap, list_sum(list_transform(p, lambda v: -v * ln(v))) / ln({k}) AS prior_entropy,
  0.5 * list_min(list_transform(cs, lambda c: list_sum(list_transform(list_zip(p, c), lambda z: abs(z[1] - z[2]))))) AS simplex_novelty, 1 - (s[1] - s[2]) AS novelty_gap, ({list(KNOWN)})[list_position(p, s[1])] AS best_fit_code, s[1] AS best_fit_prob FROM ps),
both_p AS (SELECT object_id, p FROM proba UNION ALL SELECT object_id, p FROM oof),
gp AS (SELECT object_id, round(coalesce(min(chi), 0.0) + {engine.NUDGE}, 6) AS g, round(coalesce(sum(chi * p[label + 1]), 0.0) + {engine.NUDGE}, 6) AS c FROM both_p LEFT JOIN (SELECT * FROM ch WHERE m = 2) w USING (object_id) GROUP BY object_id),
gr AS (SELECT gp.* FROM gp JOIN oof USING (object_id)),
gq AS (SELECT object_id, ((SELECT count(*) FROM gr WHERE gr.g < gp.g) + (SELECT count(*) FROM gr WHERE gr.g = gp.g) / 2) / (SELECT count(*) FROM gr) AS physics_gap, ((SELECT count(*) FROM gr WHERE gr.c < gp.c) + (SELECT count(*) FROM gr WHERE gr.c = gp.c) / 2) / (SELECT count(*) FROM gr) AS cc_weighted FROM gp JOIN proba USING (object_id)),
sc AS (SELECT feature, quantile_cont(v, 0.5) AS mid, quantile_cont(v, {models.SIGMA_HIGH}) - quantile_cont(v, {models.SIGMA_LOW}) AS w, stddev_samp(v) AS s FROM lr GROUP BY feature),
z AS (SELECT object_id, list(coalesce((v - coalesce(mid, 0.0)) / CASE WHEN w > 1e-9 THEN w WHEN s > 1e-9 THEN s ELSE 1.0 END, 0.0) ORDER BY feature) AS x FROM every JOIN sc USING (feature) GROUP BY object_id),
nn AS (SELECT a.object_id, oof.label FROM z a JOIN proba USING (object_id), z b JOIN oof ON oof.object_id = b.object_id WHERE a.object_id <> b.object_id QUALIFY row_number() OVER (PARTITION BY a.object_id ORDER BY list_distance(a.x, b.x), b.object_id) <= 25),
sh AS (SELECT object_id, label, count(*) / sum(count(*)) OVER (PARTITION BY object_id) AS share FROM nn GROUP BY object_id, label),
ne AS (SELECT object_id, -sum(share * ln(share)) / ln({k}) AS neighbor_entropy, coalesce(sum(share) FILTER (label IN {evidence.GALACTIC_LABELS}), 0.0) AS galactic FROM sh GROUP BY object_id),
rb AS (SELECT *, coalesce(hostgal_photoz, 0.0) AS zz, exp(-least(coalesce(hostgal_photoz_err, 1.0) / greatest(coalesce(hostgal_photoz, 0.0), 1e-4), 5.0) / 0.15) AS base FROM meta),
rl AS (SELECT object_id, CASE WHEN distmod > 0 THEN greatest(base, 0.9) WHEN zz > 1e-4 THEN base WHEN zz <= 1e-3 THEN 1.0 ELSE 0.0 END AS reliability FROM rb),
ev AS (SELECT sx.*, physics_gap, cc_weighted, neighbor_entropy, abs({_GALACTIC_SQL} - galactic) AS family_misfit, quality, reliability, prior_entropy AS uncertainty, (lab.label IS NULL)::INT AS y
  FROM sx JOIN gq USING (object_id) JOIN ne USING (object_id) JOIN proba USING (object_id) JOIN ts USING (object_id) JOIN lab ON lab.object_id = {own_id.replace('object_id', 'sx.object_id')} JOIN rl ON rl.object_id = {own_id.replace('object_id', 'sx.object_id')})"""


#: What follows the channels: s1 to s3 give the score, the rest the queue.
_SCORE_STEPS = _RANK_SQL[len(_EVIDENCE_SQL) :]
_CHAIN_CHANNELS = ("taxonomy_gap", "prior_entropy", "simplex_novelty", "novelty_gap", "best_fit_prob", "physics_gap", "cc_weighted", "neighbor_entropy", "family_misfit", "quality", "reliability")


def chain_queue(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Observations to ranked queue: features, prior, every channel, gate, score, rank and tier of all unseen objects."""
    out = chain.queue(spark, sf_dir).select("object_id", "rank", "y", "best_fit_code", *_CHAIN_CHANNELS, *_RANK_OUT, "tier", "abstain", "abstain_reason")
    return rounded(out)


_chain_ranked_sql = _chain_sql() + _SCORE_STEPS.replace("s3 AS (SELECT *, raw_evidence", "s3 AS (SELECT *, round(raw_evidence").replace("(1 + 0.15 * agreement) AS score", "(1 + 0.15 * agreement), 9) AS score")
_chain_queue_sql = f"WITH {_chain_ranked_sql} SELECT object_id, rank::BIGINT AS rank, y::BIGINT AS y, best_fit_code::BIGINT AS best_fit_code, " + ", ".join(map(_r, (*_CHAIN_CHANNELS, *_RANK_OUT))) + ", tier, abstain, abstain_reason FROM ranked"


def chain_metrics(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How well the chain's queue finds the withheld populations."""
    return rounded(metrics.evaluate(chain.queue(spark, sf_dir).select("object_id", "y", "score"), precision_k=(10, 20, 50), recall_k=(200,)))


def _evaluated_sql(rows: str, by: str, ks: tuple[int, ...], recall_ks: tuple[int, ...]) -> str:
    """CTEs blk to rk over ``rows`` (object_id, y, score[, by]) and the metrics of metrics.evaluate."""
    hit = lambda k: f"sum(CASE WHEN rank <= {k} THEN y ELSE 0 END)"
    p = lambda k: f"{hit(k)} / least(count(*), {k})"
    own = [x for k in ks for x in (_r(p(k), f"p_at_{k}"), _r(f"CASE WHEN sum(y) > 0 THEN {p(k)} / (sum(y) / count(*)) END", f"lift_at_{k}"))] + [_r(f"CASE WHEN sum(y) > 0 THEN {hit(k)} / sum(y) END", f"r_at_{k}") for k in recall_ks]
    g, group, part = (f"{by}, ", f"GROUP BY {by}", f"PARTITION BY {by} ") if by else ("", "", "")
    return f"""{_auc_sql(rows, by)}, erk AS (SELECT *, row_number() OVER ({part}ORDER BY score DESC, object_id) AS rank FROM {rows}),
ect AS (SELECT {g}count(*)::BIGINT AS n_objects, sum(y)::BIGINT AS n_novel, {_r("sum(y) / count(*)", "base_rate")}, {", ".join(own)} FROM erk {group})
SELECT ect.*, {_r("roc_auc")}, {_r("average_precision")} FROM ect {f"JOIN auc USING ({by})" if by else ", auc"}"""


_chain_metrics_sql = f"WITH {_chain_ranked_sql}, cq AS (SELECT object_id, y, score FROM ranked), " + _evaluated_sql("cq", "", (10, 20, 50), (200,))

_REPORT_K = ((10, 20, 50), (200,))


def chain_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The chain's metrics with their intervals over a thousand draws of its objects."""
    return rounded(resampling.report(chain.queue(spark, sf_dir), precision_k=_REPORT_K[0], recall_k=_REPORT_K[1]))


def _chain_report_sql() -> str:
    scored = f"scored AS MATERIALIZED (WITH {_chain_ranked_sql} SELECT object_id, y, score FROM ranked)"
    start = f"{scored}, rk AS (SELECT *, row_number() OVER (ORDER BY score DESC, object_id) AS rank FROM scored)"
    names = ("roc_auc", "average_precision", *(f"p_at_{k}" for k in _REPORT_K[0]))
    ends = ", ".join(f"any_value({end}) FILTER (metric = '{m}') AS {m}_{end}" for m in names for end in ("low", "high"))
    return f"""SELECT * FROM (WITH {scored}, {_evaluated_sql("scored", "", *_REPORT_K)}),
(SELECT {ends}, any_value(draws) FILTER (metric = 'roc_auc') AS draws, any_value(small_n) AS small_n FROM ({_intervals_sql(start, _REPORT_K[0])}))"""


_VIEWS_KEYED = f"""{PHOTOMETRY_SQL}, fm AS (SELECT *, min(mjd) OVER (PARTITION BY object_id) AS first_mjd FROM phot),
keyed AS (SELECT fm.* EXCLUDE (object_id, first_mjd), -(fm.object_id * {chain.SIDES} + list_position({list(chain.DAYS)}, days) - 1) - 1 AS object_id FROM fm, (SELECT unnest({list(chain.DAYS)}) AS days) WHERE days = 0 OR mjd <= first_mjd + days)"""


def _sides_sql(keyed: str, names: tuple, side: str) -> str:
    """CTE ``sd``: object_id, side, score, quality, y of every side."""
    value = lambda n: f"'{n}'" if isinstance(n, str) else str(n)
    steps = _SCORE_STEPS[: _SCORE_STEPS.index("s4 AS")].rstrip().rstrip(",")
    return f"{_chain_sql(keyed)}{steps}, sd AS (SELECT (-object_id - 1) // {chain.SIDES} AS object_id, ([{', '.join(map(value, names))}])[(-object_id - 1) % {chain.SIDES} + 1] AS {side}, round(score, 6) AS score, quality, y FROM s3)"


def early_detection(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How well the chain, fitted on whole observations, finds withheld populations in shortened views (0 days: all)."""
    return rounded(chain.early(spark, sf_dir))


_detection_sql = f"WITH {_sides_sql(_VIEWS_KEYED, chain.DAYS, 'days')}, sdl AS (SELECT * REPLACE (days::BIGINT AS days) FROM sd), " + _evaluated_sql("sdl", "days", (50,), (200,))


def survey_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The gate with a survey's score, which some objects lack."""
    q = quality.quality(features.quality_features(views.photometry(spark, sf_dir))).select("object_id", "quality")
    own = F.when(F.col("object_id") % 4 != 0, (F.col("object_id") % 13) / 10.0)
    return rounded(quality.with_survey_score(q.withColumn("realbogus", own)).select("object_id", "quality"))


_survey_sql = f"WITH {_QUALITY_SQL} SELECT object_id, {_r('quality * CASE WHEN object_id % 4 <> 0 THEN least((object_id % 13)::DOUBLE / 10, 1.0) ELSE 1.0 END', 'quality')} FROM qual"


def k_correction(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each object's correction in every band."""
    bands = F.explode(F.array(*map(F.lit, range(len(BANDS)))))
    return rounded(views.metadata(spark, sf_dir).select("object_id", "hostgal_photoz", bands.alias("band")).select("object_id", "band", physics.k_correction(F.col("hostgal_photoz"), F.col("band")).alias("k")))


_kcorr_sql = f"WITH {METADATA_SQL} SELECT object_id, band::BIGINT AS band, {_r(f'hostgal_photoz * {physics.K_SLOPE!r}::DOUBLE * {physics.K_NM!r}::DOUBLE / ({list(physics.WAVELENGTH_NM)}::DOUBLE[])[band + 1]', 'k')} FROM meta, (SELECT unnest(range({len(BANDS)})) AS band)"

# ---- drift -------------------------------------------------------------------

_COV = ["n_chars", "words"]


def _sides(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """English documents as the reference, all others as the target."""
    d = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", F.coalesce(F.col("lang") == "en", F.lit(False)).alias("ref"), F.col("n_chars").cast("double").alias("n_chars"), F.length("text").cast("double").alias("words"))
    return d.filter("ref"), d.filter("not ref")


_SIDES_SQL = "side AS (SELECT doc_id, n_chars::DOUBLE AS n_chars, length(text)::DOUBLE AS words, coalesce(lang = 'en', false) AS ref FROM documents), lng AS (SELECT 'n_chars' AS covariate, n_chars AS v, ref FROM side WHERE n_chars IS NOT NULL UNION ALL SELECT 'words', words, ref FROM side WHERE words IS NOT NULL)"
_PSI_SQL = f"""{_SIDES_SQL}, ed AS (SELECT covariate, list_sort(list_distinct(quantile_cont(v, {[i / 10 for i in range(11)]}))) AS e FROM lng WHERE ref GROUP BY covariate),
bins AS (SELECT lng.covariate, len(list_filter(e[2:len(e) - 1], lambda x: x <= v)) AS bin, count(*) FILTER (ref) AS r, count(*) FILTER (NOT ref) AS t FROM lng JOIN ed USING (covariate) GROUP BY ALL),
pq AS (SELECT covariate, greatest(r / sum(r) OVER (PARTITION BY covariate), 1e-6) AS p, greatest(t / sum(t) OVER (PARTITION BY covariate), 1e-6) AS q FROM bins), ps AS (SELECT covariate, sum((q - p) * ln(q / p)) AS psi FROM pq GROUP BY covariate)"""


def _long(spark: SparkSession, sf_dir: str) -> DataFrame:
    r, t = _sides(spark, sf_dir)
    return domain.long_form(r, _COV, "reference").unionByName(domain.long_form(t, _COV, "target"))


def drift_psi(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(domain.psi(_long(spark, sf_dir)))


_psi_sql = f"WITH {_PSI_SQL} SELECT covariate, {_r('psi')} FROM ps"


def drift_ks(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(domain.ks(_long(spark, sf_dir)))


_ks_sql = f"WITH {_SIDES_SQL}, c AS (SELECT covariate, v, count(*) FILTER (ref) AS r, count(*) FILTER (NOT ref) AS t FROM lng GROUP BY covariate, v), d AS (SELECT covariate, abs(sum(r) OVER w / sum(r) OVER (PARTITION BY covariate) - sum(t) OVER w / sum(t) OVER (PARTITION BY covariate)) AS d FROM c WINDOW w AS (PARTITION BY covariate ORDER BY v)) SELECT covariate, {_r('max(d)', 'ks')} FROM d GROUP BY covariate"


def domain_match(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(domain.match(domain.psi(_long(spark, sf_dir))))


_match_sql = f"WITH {_PSI_SQL}, m AS (SELECT avg(psi) AS mean_psi, max(psi) AS worst_psi FROM ps) SELECT {_r('mean_psi')}, {_r('worst_psi')}, {_r('least(1.0, greatest(0.0, 1 - 0.5 * mean_psi / 0.25 - 0.5 * worst_psi / 0.5))', 'match_score')}, CASE WHEN m.mean_psi < 0.1 THEN 'matched' WHEN m.mean_psi > 0.25 THEN 'abstain' ELSE 'degraded' END AS status FROM m"


def outside_range(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(domain.outside_range(*_sides(spark, sf_dir), _COV))


_outside_sql = f"WITH {_SIDES_SQL}, r AS (SELECT covariate, quantile_cont(v, 0.005) AS lo, quantile_cont(v, 0.995) AS hi FROM lng WHERE ref GROUP BY covariate) SELECT covariate, {_r('avg((v < lo OR v > hi)::INT)', 'outside_fraction')} FROM lng JOIN r USING (covariate) WHERE NOT ref GROUP BY covariate"


def shift_health(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each covariate's drift against the stored state of the reference; missing values count as 0."""
    reference, target = _sides(spark, sf_dir)
    return rounded(domain.ShiftMonitor(_COV).fit(reference).health(target))


_health_sql = f"""WITH {_SIDES_SQL.split(", lng AS")[0]}, lz AS (SELECT 'n_chars' AS covariate, coalesce(n_chars, 0.0) AS v, ref FROM side UNION ALL SELECT 'words', coalesce(words, 0.0), ref FROM side),
ft AS (SELECT covariate, quantile_cont(v, 0.005) AS low, quantile_cont(v, 0.5) AS reference_median, quantile_cont(v, 0.995) AS high, list_sort(list_distinct(quantile_cont(v, {[i / 10 for i in range(11)]}))) AS e FROM lz WHERE ref GROUP BY covariate),
bn AS (SELECT covariate, len(list_filter(e[2:len(e) - 1], lambda x: x <= v)) AS bin, count(*) FILTER (ref) AS r, count(*) FILTER (NOT ref) AS t FROM lz JOIN ft USING (covariate) GROUP BY ALL),
pq AS (SELECT covariate, greatest(r / sum(r) OVER (PARTITION BY covariate), 1e-6) AS p, greatest(t / sum(t) OVER (PARTITION BY covariate), 1e-6) AS q FROM bn), ps AS (SELECT covariate, sum((q - p) * ln(q / p)) AS psi FROM pq GROUP BY covariate),
cc AS (SELECT covariate, v, count(*) FILTER (ref) AS r, count(*) FILTER (NOT ref) AS t FROM lz GROUP BY covariate, v), dd AS (SELECT covariate, abs(sum(r) OVER w / sum(r) OVER (PARTITION BY covariate) - sum(t) OVER w / sum(t) OVER (PARTITION BY covariate)) AS d FROM cc WINDOW w AS (PARTITION BY covariate ORDER BY v)),
ks AS (SELECT covariate, max(d) AS ks FROM dd GROUP BY covariate), ou AS (SELECT covariate, avg((v < low OR v > high)::INT) AS outside, quantile_cont(v, 0.5) AS target_median FROM lz JOIN ft USING (covariate) WHERE NOT ref GROUP BY covariate)
SELECT covariate, {", ".join(map(_r, ("psi", "ks", "outside", "low", "high", "target_median", "reference_median")))} FROM ps JOIN ks USING (covariate) JOIN ou USING (covariate) JOIN ft USING (covariate)"""


def reference_weights(spark: SparkSession, sf_dir: str) -> DataFrame:
    w = domain.stratified_weights(*_sides(spark, sf_dir), ["n_chars"])
    return rounded(w.groupBy("stratum").agg(F.count(F.lit(1)).alias("n"), F.max("weight").alias("weight")))


_weights_sql = f"""WITH {_SIDES_SQL}, e AS (SELECT quantile_cont(n_chars, [0.25, 0.5, 0.75]) AS e FROM side WHERE ref), st AS (SELECT len(list_filter(e, lambda x: x <= n_chars))::VARCHAR AS stratum, ref FROM side, e),
c AS (SELECT stratum, count(*) FILTER (ref) AS nr, count(*) FILTER (NOT ref) AS nt FROM st GROUP BY stratum) SELECT stratum, nr::BIGINT AS n, {_r('least(greatest((nt / sum(nt) OVER ()) / (nr / sum(nr) OVER ()), 0.2), 5.0)', 'weight')} FROM c WHERE nr > 0"""


def effective_size(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(domain.effective_size(domain.stratified_weights(*_sides(spark, sf_dir), ["n_chars"])), 3)


_size_sql = f"""WITH {_SIDES_SQL}, e AS (SELECT quantile_cont(n_chars, [0.25, 0.5, 0.75]) AS e FROM side WHERE ref), st AS (SELECT len(list_filter(e, lambda x: x <= n_chars))::VARCHAR AS stratum, ref FROM side, e),
c AS (SELECT stratum, count(*) FILTER (ref) AS nr, count(*) FILTER (NOT ref) AS nt FROM st GROUP BY stratum), w AS (SELECT nr, least(greatest((nt / sum(nt) OVER ()) / (nr / sum(nr) OVER ()), 0.2), 5.0) AS w FROM c WHERE nr > 0)
SELECT round((sum(nr * w) * sum(nr * w) / sum(nr * w * w))::DOUBLE + {NUDGE}, 3) + 0.0 AS ess, sum(nr)::BIGINT AS n FROM w"""


# ---- protocol ----------------------------------------------------------------

_FRACTIONS = {"fit": 0.6, "validation": 0.2, "test": 0.2}


def _members(spark: SparkSession, sf_dir: str) -> DataFrame:
    return protocol.split(spark.read.parquet(f"{sf_dir}/embeddings.parquet").select(F.col("vec_id").alias("object_id"), F.col("label").cast("int").alias("label")), _FRACTIONS, "s1")


def object_split(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(_members(spark, sf_dir))


_MEMBERS_SQL = f"mem AS (SELECT vec_id AS object_id, label, CASE WHEN u < 0.6 THEN 'fit' WHEN u < 0.8 THEN 'validation' ELSE 'test' END AS split FROM (SELECT *, {_draw_sql('s1', 'vec_id')} AS u FROM embeddings))"
_split_sql = f"WITH {_MEMBERS_SQL} SELECT object_id, label::BIGINT AS label, split FROM mem"


def exact_split(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents split as one seeded generator deals their ascending ids."""
    d = spark.read.parquet(f"{sf_dir}/documents.parquet").select(F.col("doc_id").alias("object_id"))
    return protocol.exact_split(d, _FRACTIONS, 42)


def split_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    return protocol.fingerprints(_members(spark, sf_dir))


_finger_sql = f"WITH {_MEMBERS_SQL} SELECT split, count(*)::BIGINT AS n, sum(('0x' || substr(md5(object_id::VARCHAR), 1, 12))::BIGINT::HUGEINT)::VARCHAR AS fingerprint FROM mem GROUP BY split"


def stratified_folds(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(protocol.folds(_members(spark, sf_dir), "label", 4, "f1").select("object_id", "label", "fold"))


_folds_sql = f"SELECT vec_id AS object_id, label::BIGINT AS label, ((row_number() OVER (PARTITION BY label ORDER BY {_draw_sql('f1', 'vec_id')}, vec_id) - 1) % 4)::BIGINT AS fold FROM embeddings"


def rare_subsample(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = spark.read.parquet(f"{sf_dir}/documents.parquet").select(F.col("doc_id").alias("object_id"), F.coalesce("lang", F.lit("none")).alias("lang"))
    return protocol.rare_preserving(d, "lang", 400, 160, "r1").select("object_id", "lang")


_rare_sql = f"""WITH d AS (SELECT doc_id AS object_id, coalesce(lang, 'none') AS lang FROM documents), n AS (SELECT lang, count(*) AS n FROM d GROUP BY lang),
q AS (SELECT lang, CASE WHEN n <= 160 THEN n ELSE greatest(1, floor(greatest(400 - coalesce((SELECT sum(n) FROM n WHERE n <= 160), 0), 0) * n / (SELECT sum(n) FROM n WHERE n > 160))) END AS quota FROM n),
o AS (SELECT d.*, row_number() OVER (PARTITION BY lang ORDER BY {_draw_sql('r1', 'object_id')}, object_id) AS nth FROM d) SELECT object_id, o.lang FROM o JOIN q USING (lang) WHERE nth <= quota"""


def leakage_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    m = _members(spark, sf_dir)
    guard = protocol.LeakageGuard(m, "test")
    guard.saw("fit", m.filter("split = 'fit'"))
    guard.saw("select", m.filter("object_id % 7 = 0"))
    return guard.violations()


_leak_sql = f"WITH {_MEMBERS_SQL} SELECT 'select' AS stage, count(*)::BIGINT AS n FROM mem WHERE split = 'test' AND object_id % 7 = 0 HAVING count(*) > 0"


def content_hash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return protocol.content_hash(spark.read.parquet(f"{sf_dir}/documents.parquet"), ["doc_id", "source", "lang", "n_chars", "text"])


_hash_sql = "SELECT sum(('0x' || substr(md5(" + " || '|' || ".join(f"coalesce({c}::VARCHAR, 'null')" for c in ("doc_id", "source", "lang", "n_chars", "text")) + "), 1, 12))::BIGINT::HUGEINT)::VARCHAR AS hash, count(*)::BIGINT AS n FROM documents"

# ---- artifacts and alerts ----------------------------------------------------


def artifact_scenarios(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = inject.scenarios(views.photometry(spark, sf_dir))
    return rounded(s.groupBy("scenario", "object_id").agg(F.count(F.lit(1)).alias("n_obs"), F.sum("flux").alias("flux_sum"), F.sum("flux_err").alias("err_sum"), F.count_distinct("passband").alias("n_bands")), 3)


def _scenarios_sql() -> str:
    key = "object_id || '|' || passband || '|' || mjd::DECIMAL(20,6)"
    nth = lambda seed: f"row_number() OVER (PARTITION BY object_id ORDER BY {_draw_sql(seed, f'({key})')}, mjd, passband)"
    cols = "object_id, mjd, passband, flux, flux_err, detected_bool"
    return f"""WITH {PHOTOMETRY_SQL},
i1 AS (SELECT object_id, mjd, passband, CASE WHEN n <= greatest(1, floor(a * 0.6::DOUBLE)) THEN -abs(flux) ELSE flux END AS flux, flux_err, detected_bool FROM (SELECT *, {nth('neg')} AS n, count(*) OVER (PARTITION BY object_id) AS a FROM phot WHERE detected_bool = 1) UNION ALL SELECT {cols} FROM phot WHERE detected_bool <> 1),
i2 AS (SELECT object_id, mjd, passband, CASE WHEN n = 1 THEN flux * 60 ELSE flux END AS flux, flux_err, detected_bool FROM (SELECT *, {nth('spike')} AS n FROM phot)),
i3 AS (SELECT object_id, mjd, passband, flux, flux_err * 25 AS flux_err, detected_bool FROM phot),
i4 AS (SELECT {cols} FROM phot UNION ALL SELECT {cols} FROM (SELECT *, {nth('dup')} AS n FROM phot) WHERE n <= 6),
i5 AS (SELECT {cols} FROM (SELECT *, row_number() OVER (PARTITION BY object_id ORDER BY mjd, passband) AS n, count(*) OVER (PARTITION BY object_id) AS a FROM phot) WHERE a < 4 OR n <= greatest(1, floor(a * 0.35::DOUBLE))),
pick AS (SELECT object_id, first(passband ORDER BY {_draw_sql('band', "(object_id || '|' || passband)")}, passband) AS passband FROM (SELECT DISTINCT object_id, passband FROM phot) GROUP BY object_id),
i6 AS (SELECT {', '.join('phot.' + c for c in cols.split(', '))} FROM phot JOIN pick ON phot.object_id = pick.object_id AND phot.passband = pick.passband),
u AS (SELECT 'clean' AS scenario, {cols} FROM phot {' '.join(f"UNION ALL SELECT '{n}', {cols} FROM i{k + 1}" for k, n in enumerate(inject.INJECTORS))})
SELECT scenario, object_id, count(*)::BIGINT AS n_obs, round(sum(flux) + {NUDGE}, 3) + 0.0 AS flux_sum, round(sum(flux_err) + {NUDGE}, 3) + 0.0 AS err_sum, count(DISTINCT passband)::BIGINT AS n_bands FROM u GROUP BY scenario, object_id"""


def alert_round_trip(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Observations written as alert lines, read back, and counted by band."""
    lines = alerts.write_packets(views.photometry(spark, sf_dir)).select("value")
    back = alerts.to_photometry(alerts.packets(lines))
    return rounded(back.groupBy("object_id", "passband").agg(F.count(F.lit(1)).alias("n_obs"), F.sum("flux").alias("flux_sum"), F.sum("detected_bool").alias("n_det")), 4)


_alert_sql = f"WITH {PHOTOMETRY_SQL}, i AS (SELECT *, ('0x' || substr(sha256(object_id::VARCHAR), 1, 8))::BIGINT % 2147483647 AS id FROM phot WHERE passband IN (1, 2, 3)) SELECT id AS object_id, passband::BIGINT AS passband, count(*)::BIGINT AS n_obs, round(sum(flux) + {NUDGE}, 4) + 0.0 AS flux_sum, sum(detected_bool)::BIGINT AS n_det FROM i GROUP BY id, passband"


# ---- models and explanations -------------------------------------------------


def standardised_vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    v = _vectors(spark, sf_dir)
    return rounded(models.standardised(v, models.standardiser(v.filter(_REFERENCE), _FEATS)))


_standard_sql = "WITH v AS (SELECT vec_id AS object_id, label, " + ", ".join(f"embedding[{i + 1}]::DOUBLE AS {f}" for i, f in enumerate(_FEATS)) + " FROM embeddings), s AS (SELECT " + ", ".join(f"quantile_cont({f}, 0.5) AS m_{f}, quantile_cont({f}, {models.SIGMA_HIGH}) - quantile_cont({f}, {models.SIGMA_LOW}) AS w_{f}" for f in _FEATS) + f" FROM v WHERE {_REFERENCE}) SELECT object_id, label::BIGINT AS label, " + ", ".join(_r(f"({f} - m_{f}) / w_{f}", f) for f in _FEATS) + " FROM v, s"


def anomaly_distances(spark: SparkSession, sf_dir: str) -> DataFrame:
    v = _vectors(spark, sf_dir)
    return rounded(models.AnomalyEnsemble(_FEATS).fit(v.filter(_REFERENCE)).distances(v).select("object_id", "mahalanobis", "pca_residual"))


def _anomaly_sql(components: int = 2, column: Callable[[str, str], str] = _r) -> str:
    """The covariance is inverted by sweeping one variable after the other; each main axis is
    what repeated squaring leaves of it, those found before having been taken off."""
    n = len(_FEATS)
    z = ", ".join(f"(embedding[{i + 1}]::DOUBLE - m_{f}) / w_{f}" for i, f in enumerate(_FEATS))
    square = "list_transform(m, lambda r: list_transform(m, lambda s: list_dot_product(r, s)))"

    def axis(k: int) -> str:
        diagonal = f"list_transform(range(1, {n + 1}), lambda i: m[i][i])"
        return f"""p{k} AS (SELECT 0 AS k, m FROM c{k} UNION ALL SELECT k + 1, list_transform(q, lambda r: list_transform(r, lambda e: e / t)) FROM (SELECT k, {square} AS q, list_sum(list_transform(m, lambda r: list_dot_product(r, r))) AS t FROM p{k} WHERE k < 40)),
l{k} AS (SELECT m[list_position({diagonal}, list_max({diagonal}))] AS r FROM p{k} WHERE k = 40),
a{k} AS (SELECT a, list_dot_product(a, list_transform(m, lambda r: list_dot_product(r, a))) AS l, m FROM (SELECT list_transform(r, lambda e: e / sqrt(list_dot_product(r, r))) AS a FROM l{k}), c{k}),
c{k + 1} AS (SELECT list_transform(m, lambda r, i: list_transform(r, lambda e, j: e - l * a[i] * a[j])) AS m FROM a{k})"""

    scale = ", ".join(f"quantile_cont(embedding[{i + 1}]::DOUBLE, 0.5) AS m_{f}, quantile_cont(embedding[{i + 1}]::DOUBLE, {models.SIGMA_HIGH}) - quantile_cont(embedding[{i + 1}]::DOUBLE, {models.SIGMA_LOW}) AS w_{f}" for i, f in enumerate(_FEATS))
    return f"""WITH RECURSIVE s AS (SELECT {scale} FROM embeddings WHERE {_REFERENCE}), z AS (SELECT vec_id AS object_id, label, [{z}] AS z FROM embeddings, s),
e AS (SELECT object_id, unnest(range(1, {n + 1})) AS i, unnest(z) AS v FROM z WHERE {_REFERENCE}),
mu AS (SELECT list(mean ORDER BY i) AS mean FROM (SELECT i, avg(v) AS mean FROM e GROUP BY i)),
c1 AS (SELECT list(r ORDER BY i) AS m FROM (SELECT i, list(v ORDER BY j) AS r FROM (SELECT a.i, b.i AS j, covar_samp(a.v, b.v) AS v FROM e a JOIN e b USING (object_id) GROUP BY a.i, b.i) GROUP BY i)),
w AS (SELECT 1 AS k, list_transform(range(1, {n + 1}), lambda i: list_transform(m[i], lambda e, j: e + CASE WHEN i = j THEN 1e-6::DOUBLE ELSE 0.0::DOUBLE END)) AS m FROM c1
UNION ALL SELECT k + 1, list_transform(range(1, {n + 1}), lambda i: CASE WHEN i = k THEN list_transform(p, lambda e, j: CASE WHEN j = k THEN -1 / d ELSE e / d END) ELSE list_transform(m[i], lambda e, j: CASE WHEN j = k THEN e / d ELSE e - m[i][k] * p[j] / d END) END) FROM (SELECT k, m, m[k] AS p, m[k][k] AS d FROM w WHERE k <= {n})),
{", ".join(map(axis, range(1, components + 1)))},
axes AS ({" UNION ALL ".join(f"SELECT a FROM a{k}" for k in range(1, components + 1))}), ax AS (SELECT list(a) AS axes FROM axes),
d AS (SELECT object_id, label, list_transform(z, lambda e, i: e - mean[i]) AS d FROM z, mu),
g AS (SELECT object_id, label, -list_dot_product(d, list_transform(w.m, lambda r: list_dot_product(r, d))) AS far, list_dot_product(d, d) - list_sum(list_transform(axes, lambda a: pow(list_dot_product(a, d), 2))) AS rest FROM d, (SELECT m FROM w WHERE k = {n + 1}) w, ax)
SELECT object_id, {column("sqrt(greatest(far, 0.0))", "mahalanobis")}, {column("sqrt(greatest(rest, 0.0))", "pca_residual")} FROM g"""


def known_class_prior(spark: SparkSession, sf_dir: str) -> DataFrame:
    return models.Prior(_FEATS).fit(_vectors(spark, sf_dir)).accuracy()


def gated_prior(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Share of labels that the family-gated prior finds in vectors that it was not fitted on."""
    v = protocol.split(_vectors(spark, sf_dir), {"fit": 0.5, "rest": 0.5}, "gate")
    model = models.GatedPrior(_FEATS, (0, 1, 2, 3, 4), n_folds=2, trees=15).fit(v.filter("split = 'fit'"))
    rest = v.filter("split = 'rest'")
    hit = F.array_position("p", F.array_max("p")) - 1 == F.col("label")
    return model.probabilities(rest).join(rest.select("object_id", "label"), "object_id").agg(F.avg(hit.cast("double")).alias("accuracy"), F.count(F.lit(1)).alias("n"))


def anomaly_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Detectors of all vectors, fitted on the first classes."""
    v = _vectors(spark, sf_dir)
    return rounded(detectors.DetectorEnsemble(_FEATS, trees=50).fit(v.filter(_REFERENCE)).score(v))


def boosted_prior(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Out-of-fold quality of boosted trees over the whole feature matrix of the known objects."""
    code = F.array_position(F.array(*map(F.lit, KNOWN)), F.col("code")).cast("int") - 1
    known = views.metadata(spark, sf_dir).select("object_id", code.alias("label")).filter("label >= 0")
    rows = stages.written(features.feature_matrix(views.photometry(spark, sf_dir), views.metadata(spark, sf_dir)).join(known, "object_id"))
    names = [c for c in rows.columns if c not in ("object_id", "label")]
    return boosting.BoostedPrior(names, rounds=8, bins=16, columns=0.3).fit(rows).report()


_TREES = 20


def isolation_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How easily a forest over the first classes parts each vector from them."""
    v = _vectors(spark, sf_dir)
    return rounded(isolation.IsolationForest(_FEATS, _TREES).fit(v.filter(_REFERENCE)).score(v))


def _isolation_sql(trees: int = _TREES, column: Callable[[str, str], str] = _r) -> str:
    """The forest level by level: each node's ends, the cut of the least hash, and both sides."""
    levels = 8
    draw = lambda key: _draw_sql("iso-42", f"({key})")
    c = f"CASE WHEN size <= 1 THEN 0.0 WHEN size = 2 THEN 1.0 ELSE 2 * (ln(size - 1) + {isolation.EULER!r}::DOUBLE) - 2 * (size - 1) / size END"
    parts = [f"""v AS (SELECT vec_id AS object_id, label, list_transform(embedding, lambda e: e::DOUBLE) AS x FROM embeddings),
ref AS (SELECT * FROM v WHERE {_REFERENCE}), dim AS (SELECT least(256, count(*)) AS size, least(1.0::DOUBLE, least(256, count(*))::DOUBLE / count(*)) AS share FROM ref),
lim AS (SELECT *, ceil(log2(greatest(size, 2)))::BIGINT AS depth, least(1.0::DOUBLE, {isolation.SPARE * trees} * share) AS loose FROM dim),
s0 AS (SELECT tree, 0 AS node, x FROM ref, lim, (SELECT unnest(range({trees})) AS tree) WHERE {draw("object_id")} < loose AND {draw("object_id || '|' || tree")} < share / loose),
w0 AS (SELECT object_id, tree, 0 AS node, x FROM v, (SELECT DISTINCT tree FROM s0))"""]
    for k in range(levels + 1):
        parts.append(f"n{k} AS (SELECT tree, node, count(*) AS size FROM s{k} GROUP BY tree, node)")
        if k < levels:
            parts += [
                f"e{k} AS (SELECT s.tree, s.node, f, min(x[f + 1]) AS lo, max(x[f + 1]) AS hi FROM s{k} s, (SELECT unnest(range({len(_FEATS)})) AS f), lim WHERE {k} < depth GROUP BY ALL HAVING min(x[f + 1]) < max(x[f + 1]))",
                f"c{k} AS (SELECT tree, node, f, lo + {draw("tree || '|' || node")} * (hi - lo) AS cut FROM e{k} QUALIFY row_number() OVER (PARTITION BY tree, node ORDER BY md5('iso-42:' || tree || '|' || node || '|' || f)) = 1)",
                f"s{k + 1} AS (SELECT s.tree, 2 * s.node + 1 + (x[f + 1] >= cut)::INT AS node, x FROM s{k} s JOIN c{k} c ON s.tree = c.tree AND s.node = c.node)",
                f"w{k + 1} AS (SELECT object_id, w.tree, 2 * w.node + 1 + (x[f + 1] >= cut)::INT AS node, x FROM w{k} w JOIN c{k} c ON w.tree = c.tree AND w.node = c.node)",
                f"l{k} AS (SELECT w.object_id, w.tree, {k} + {c} AS length FROM w{k} w LEFT JOIN n{k} n ON w.tree = n.tree AND w.node = n.node WHERE NOT EXISTS (FROM c{k} c WHERE w.tree = c.tree AND w.node = c.node))",
            ]
    parts.append(f"l{levels} AS (SELECT w.object_id, w.tree, {levels} + {c} AS length FROM w{levels} w LEFT JOIN n{levels} n ON w.tree = n.tree AND w.node = n.node)")
    every = " UNION ALL ".join(f"SELECT * FROM l{k}" for k in range(levels + 1))
    return f"WITH {', '.join(parts)}, p AS (SELECT object_id, avg(length) AS length FROM ({every}) GROUP BY object_id) SELECT object_id, {column(f'pow(2.0, -length / (SELECT {c} FROM lim))', 'isolation')} FROM p"


def _detector_sql() -> str:
    """All detectors at the places at which they are compared, each value's place among the first classes."""
    at = lambda x, name: f"round({x}, {detectors.PLACES}) AS {name}"
    names = ("mahalanobis", "pca_residual", "isolation")
    reference = ", ".join(f"list_sort(list({n}) FILTER ({_REFERENCE})) AS r_{n}" for n in names)
    below = lambda n, less: f"len(list_filter(r_{n}, lambda e: e {less} {n}))"
    ranks = " + ".join(f"({below(n, '<')} + {below(n, '=')} / 2) / len(r_{n})" for n in names)
    return f"""WITH v AS (SELECT m.*, i.isolation, label FROM ({_anomaly_sql(24, at)}) m JOIN ({_isolation_sql(50, at)}) i USING (object_id) JOIN embeddings ON vec_id = object_id), r AS (SELECT {reference} FROM v)
SELECT object_id, {", ".join(_r(n) for n in names)}, {_r(f"({ranks}) / {len(names)}", "anomaly_score")} FROM v, r"""


def neighbour_novelty(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Mean distance to the neighbours of the stated queries, and its mid-rank among those of the first classes."""
    e = spark.read.parquet(f"{sf_dir}/embeddings.parquet").select(F.col("vec_id").alias("object_id"), "label")
    far = _near(spark, sf_dir).groupBy(F.col("query_id").alias("object_id")).agg(F.round(F.avg("distance"), 6).alias("knn_distance"))
    return rounded(evidence.quantile_map(far, far.join(e.filter(_REFERENCE), "object_id", "left_semi"), "knn_distance"))


_novelty_sql = f"WITH {_KNN_SQL}, far AS (SELECT query_id AS object_id, round(avg(distance), 6) AS d FROM near GROUP BY query_id), r AS (SELECT d AS v FROM far JOIN embeddings ON vec_id = object_id WHERE {_REFERENCE}) SELECT object_id, {_r('d', 'knn_distance')}, {_r('((SELECT count(*) FROM r WHERE v < far.d) + (SELECT count(*) FROM r WHERE v = far.d) / 2) / nullif((SELECT count(*) FROM r), 0)', 'mapped')} FROM far"


def predictive_uncertainty(spark: SparkSession, sf_dir: str) -> DataFrame:
    v = _vectors(spark, sf_dir)
    return models.bootstrap_uncertainty(v.filter(_REFERENCE), v, _FEATS)


def density_weights(spark: SparkSession, sf_dir: str) -> DataFrame:
    v = _vectors(spark, sf_dir)
    return models.density_ratio_weights(v.filter("label < 5"), v.filter("label >= 5"), _FEATS)


def adversarial_check(spark: SparkSession, sf_dir: str) -> DataFrame:
    v = _vectors(spark, sf_dir)
    novelty = v.select("object_id", F.col("f0").alias("novelty"))
    return models.adversarial_validation(v.filter("label < 5"), v.filter("label >= 5"), _FEATS, novelty=novelty)


def calibration(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = _evidence(spark, sf_dir).withColumn("error", F.col("y").cast("double"))
    return rounded(models.calibration_cells(e, "best_fit_prob", "quality", "error"))


_calibration_sql = f"WITH {_EVIDENCE_SQL}, e AS (SELECT quantile_cont(best_fit_prob, [0.2, 0.4, 0.6, 0.8]) AS a, quantile_cont(quality, [0.2, 0.4, 0.6, 0.8]) AS b FROM ev) SELECT len(list_filter(a, lambda x: x <= best_fit_prob))::BIGINT AS c_bin, len(list_filter(b, lambda x: x <= quality))::BIGINT AS n_bin, count(*)::BIGINT AS n, {_r('avg(y)', 'mean_error')}, count(*) < 40 AS thin FROM ev, e GROUP BY ALL"


def feature_deviations(spark: SparkSession, sf_dir: str) -> DataFrame:
    v = _vectors(spark, sf_dir)
    rows = v.withColumn("best_fit_code", F.pmod(F.col("label") + 1, F.lit(10)))
    return rounded(explain.feature_deviations(rows, evidence.class_statistics(_packed(spark, sf_dir), _FEATS), _FEATS, 1.5))


_deviation_sql = f"WITH {_LONG_SQL}, z AS (SELECT object_id, lf.feature, v AS value, (v - mean) / sd AS z FROM lf JOIN cs ON cs.label = (lf.label + 1) % 10 AND cs.feature = lf.feature AND sd > 1e-12), k AS (SELECT *, row_number() OVER (PARTITION BY object_id ORDER BY abs(z) DESC, feature) AS rank FROM z WHERE abs(z) >= 1.5) SELECT object_id, feature, {_r('value')}, {_r('z')}, rank::BIGINT AS rank FROM k WHERE rank <= 5"


def analogue_block(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = explain.analogues(_near(spark, sf_dir))
    return rounded(out.withColumn("leading_share", F.col("class_shares")[F.col("dominant").cast("string")]).drop("class_shares"))


_analogue_sql = f"WITH {_KNN_SQL}, c AS (SELECT query_id, label, count(*) AS n, sum(distance) AS d FROM near WHERE distance <= 12 GROUP BY ALL) SELECT query_id AS object_id, sum(n)::BIGINT AS n_analogues, first(label ORDER BY n DESC, label)::BIGINT AS dominant, {_r('max(n) / sum(n)', 'purity')}, {_r('sum(d) / sum(n)', 'mean_distance')}, sum(n) >= 3 AS reliable, CASE WHEN sum(n) >= 3 THEN '' ELSE 'only ' || sum(n)::BIGINT || ' analogues within reach, 3 are needed' END AS reason, {_r('max(n) / sum(n)', 'leading_share')} FROM c GROUP BY query_id"


def explanations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(explain.contributions(_evidence(spark, sf_dir), ranking.BASELINE))


_explain_sql = f"""WITH {_EVIDENCE_SQL}, {_TAX_SQL}, p AS (SELECT object_id, best_fit_code, best_fit_prob, unnest([{', '.join(repr(c) for c in _W)}]) AS driver, unnest([{', '.join(f'{c} * {w!r}::DOUBLE' for c, w in _W.items())}]) AS share FROM ev),
d AS (SELECT object_id, any_value(best_fit_code) AS code, any_value(best_fit_prob) AS prob, first(driver ORDER BY share DESC, driver DESC) AS driver, max(share) AS share FROM p GROUP BY object_id)
SELECT object_id, driver, {_r('share')}, printf('Closest known population %s (probability %.2f); driven by %s.', coalesce(name, 'unknown'), prob::DOUBLE, replace(driver, '_', ' ')) AS summary FROM d LEFT JOIN tax ON tax.code = d.code"""


def explanation_payload(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The whole explanation of the stated queries' objects, read back field by field."""
    e = _evidence(spark, sf_dir).filter("object_id % 20 = 0")
    near = stages.written(_near(spark, sf_dir))
    v = _vectors(spark, sf_dir).withColumn("best_fit_code", F.pmod(F.col("label") + 1, F.lit(10)))
    odd = explain.feature_deviations(v, evidence.class_statistics(_packed(spark, sf_dir), _FEATS), _FEATS, 1.5)
    docs = explain.payload(e, ranking.BASELINE, odd, explain.analogues(near), near)
    d = F.from_json("document", "summary string, channels array<struct<contribution: double, channel: string, value: double, weight: double>>, deviations array<struct<rank: int, feature: string, z: double>>, analogues struct<n_analogues: long, mean_distance: double, class_shares: map<string, double>, nearest: array<struct<rank: int, analogue: long>>>")
    rows = docs.select("object_id", "driver", d.alias("d"))
    first = lambda x: F.try_element_at(x, F.lit(1))
    return rounded(rows.select("object_id", "driver", first(F.col("d.channels"))["contribution"].alias("share"), F.size("d.channels").alias("n_channels"), first(F.col("d.deviations"))["feature"].alias("odd_feature"), first(F.col("d.deviations"))["z"].alias("odd_z"), "d.analogues.n_analogues", "d.analogues.mean_distance", F.size("d.analogues.class_shares").alias("n_classes"), first(F.col("d.analogues.nearest"))["analogue"].alias("nearest")))


_payload_sql = f"""WITH {_EVIDENCE_SQL}, {_KNN_SQL}, zz AS (SELECT object_id, lf.feature, (v - mean) / sd AS z FROM lf JOIN cs ON cs.label = (lf.label + 1) % 10 AND cs.feature = lf.feature AND sd > 1e-12),
zk AS (SELECT *, row_number() OVER (PARTITION BY object_id ORDER BY abs(z) DESC, feature) AS rank FROM zz WHERE abs(z) >= 1.5),
an AS (SELECT query_id, count(*) AS n_analogues, avg(distance) AS mean_distance, count(DISTINCT label) AS n_classes, min(object_id) FILTER (rank = 1) AS nearest FROM near WHERE distance <= 12 GROUP BY query_id),
pc AS (SELECT object_id, unnest([{', '.join(repr(c) for c in _W)}]) AS driver, unnest([{', '.join(f'{c} * {w!r}::DOUBLE' for c, w in _W.items())}]) AS share FROM ev),
dv AS (SELECT object_id, first(driver ORDER BY share DESC, driver DESC) AS driver, max(share) AS share FROM pc GROUP BY object_id)
SELECT ev.object_id, driver, {_r('share')}, {len(_W)}::BIGINT AS n_channels, zk.feature AS odd_feature, {_r('z', 'odd_z')}, n_analogues::BIGINT AS n_analogues, {_r('mean_distance')}, coalesce(n_classes, -1)::BIGINT AS n_classes, nearest
FROM ev JOIN dv USING (object_id) LEFT JOIN zk ON zk.object_id = ev.object_id AND zk.rank = 1 LEFT JOIN an ON an.query_id = ev.object_id WHERE ev.object_id % 20 = 0"""


def calibrated_error(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each object's expected error by the calibrator's cells, fitted on one half and applied to the other."""
    e = _evidence(spark, sf_dir).withColumn("error", F.col("y").cast("double"))
    model = models.Calibrator("best_fit_prob", "quality", "error").fit(e.filter("object_id % 2 = 0"))
    return rounded(model.transform(e.filter("object_id % 2 = 1")).select("object_id", "expected_error", "from_cell"))


_calibrated_sql = f"""WITH {_EVIDENCE_SQL}, h AS (SELECT * FROM ev WHERE object_id % 2 = 0), ed AS (SELECT quantile_cont(best_fit_prob, [0.2, 0.4, 0.6, 0.8]) AS a, quantile_cont(quality, [0.2, 0.4, 0.6, 0.8]) AS b FROM h),
bi AS (SELECT object_id, y, len(list_filter(a, lambda x: x <= best_fit_prob)) AS c_bin, len(list_filter(b, lambda x: x <= quality)) AS n_bin FROM ev, ed),
ce AS (SELECT c_bin, n_bin, count(*) AS n, avg(y) AS error FROM bi WHERE object_id % 2 = 0 GROUP BY ALL HAVING count(*) >= 40), ro AS (SELECT c_bin, sum(n * error) / sum(n) AS error FROM ce GROUP BY c_bin)
SELECT object_id, {_r('coalesce(ce.error, ro.error, (SELECT avg(y) FROM h))', 'expected_error')}, ce.error IS NOT NULL AS from_cell FROM bi LEFT JOIN ce USING (c_bin, n_bin) LEFT JOIN ro ON ro.c_bin = bi.c_bin WHERE object_id % 2 = 1"""


def candidate_records(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The queue's first hundred as nested documents, read back field by field."""
    docs = serve.records(_ranked(spark, sf_dir), ranking.BASELINE, limit=100)
    doc = F.from_json("document", "rank long, object_id long, tier string, best_fit_class string, evidence map<string, double>, weighted_evidence map<string, double>, abstain boolean, is_novel boolean")
    return docs.select(doc.alias("d")).select("d.object_id", "d.rank", "d.tier", "d.best_fit_class", "d.abstain", "d.is_novel", F.round(F.col("d.evidence")["taxonomy_gap"], 4).alias("taxonomy_gap"), F.round(F.col("d.weighted_evidence")["taxonomy_gap"], 4).alias("weighted_gap"))


_records_sql = f"WITH {_RANK_SQL}, {_TAX_SQL} SELECT object_id, rank::BIGINT AS rank, tier, coalesce(name, 'unknown') AS best_fit_class, abstain, y = 1 AS is_novel, round(round(taxonomy_gap, 6), 4) AS taxonomy_gap, round(round(taxonomy_gap * {_W['taxonomy_gap']!r}::DOUBLE, 6), 4) AS weighted_gap FROM ranked LEFT JOIN tax ON code = best_fit_code WHERE rank <= 100"


def safety_suite(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every corruption of every unseen object, scored by the chain, against the clean observations."""
    return rounded(inject.safety(chain.corrupted(spark, sf_dir)))


def _safety_sql() -> str:
    head = _scenarios_sql()
    ctes = head[head.index("WITH ") + 5 : head.rindex("\nSELECT scenario")]
    keyed = f"{ctes}, keyed AS (SELECT -(object_id * {chain.SIDES} + list_position({list(chain.SCENARIOS)}, scenario) - 1) - 1 AS object_id, mjd, passband, flux, flux_err, detected_bool FROM u)"
    return f"""WITH {_sides_sql(keyed, chain.SCENARIOS, 'scenario')},
rk AS (SELECT *, row_number() OVER (PARTITION BY scenario ORDER BY score DESC, object_id) AS rank FROM sd),
j AS (SELECT a.scenario, a.score - c.score AS ds, a.quality - c.quality AS dq, a.rank < c.rank AS up FROM rk a JOIN rk c ON a.object_id = c.object_id AND c.scenario = 'clean' AND a.scenario <> 'clean')
SELECT scenario, count(*)::BIGINT AS n, count(*) FILTER (up)::BIGINT AS n_promoted, count(*) FILTER (ds > 1e-9)::BIGINT AS n_score_increased, {_r('avg(dq)', 'mean_delta_quality')}, {_r('avg(ds)', 'mean_delta_score')} FROM j GROUP BY scenario"""


def flagship(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Statistics, gate and queue: the twenty brightest objects of good quality."""
    obs = views.photometry(spark, sf_dir)
    q = quality.quality(features.quality_features(obs)).select("object_id", "quality")
    g = features.global_features(obs).select("object_id", "lc_snr_max", "lc_n_obs")
    s = g.join(q, "object_id").withColumn("score", F.col("quality") * F.col("lc_snr_max"))
    return rounded(ranking.top(s, 20))


_flagship_sql = f"WITH {_QUALITY_SQL}, g AS (SELECT object_id, max(flux / flux_err) AS lc_snr_max, count(*) AS lc_n_obs FROM phot GROUP BY object_id), s AS (SELECT g.*, quality, quality * lc_snr_max AS score FROM g JOIN qual USING (object_id) ORDER BY score DESC, object_id LIMIT 20) SELECT object_id, {_r('lc_snr_max')}, lc_n_obs::BIGINT AS lc_n_obs, {_r('quality')}, {_r('score')} FROM s"

_ALL = {
    band_features: _band_features_sql, band_matrix: _band_matrix_sql, global_features: _global_sql, quality_features: _quality_features_sql, quality_gate: _quality_gate_sql, colour_features: _colour_sql, physics_features: _physics_sql(), host_features: _host_sql(), uncertainty_features: _uncertainty_sql(), feature_matrix: _matrix_sql(), early_window: _early_sql, part_statistics: _part_sql, population_lookup: _lookup_sql,
    simplex_channels: _simplex_sql, nearest_neighbours: _knn_sql, neighbour_cells: None, neighbour_channels: _nch_sql, galactic_probability: _gal_sql, family_misfit: _misfit_sql, rank01: _rank01_sql, evidence_channels: _channels_sql, class_statistics: _cstat_sql, physics_gap: _gap_sql, quantile_channel: _qmap_sql,
    review_queue: _queue_sql, queue_page: _page_sql, queue_summary: _summary_sql, abstention_policy: _policy_sql,
    auc_and_ap: _auc_query_sql, weighted_auc: _wauc_sql, precision_at_k: _pk_sql, base_rate_stress: _stress_sql(), per_class: _class_sql, channel_power: _power_sql, uncertainty_value: _uncertainty_value_sql(), bootstrap_auc: _boot_sql, metric_intervals: _intervals_sql(), evaluation_bundle: _bundle_sql(), weighted_precision: _wpk_sql, weight_search: _search_sql(), ablation: _ablation_sql(), weight_variants: _variants_sql, weight_optimism: _optimism_sql(), review_budget: _budget_sql, queue_audit: _audit_sql, chain_queue: _chain_queue_sql, chain_metrics: _chain_metrics_sql, chain_report: _chain_report_sql(), early_detection: _detection_sql, survey_quality: _survey_sql, k_correction: _kcorr_sql,
    drift_psi: _psi_sql, drift_ks: _ks_sql, domain_match: _match_sql, outside_range: _outside_sql, shift_health: _health_sql, reference_weights: _weights_sql, effective_size: _size_sql,
    object_split: _split_sql, exact_split: None, split_fingerprints: _finger_sql, stratified_folds: _folds_sql, rare_subsample: _rare_sql, leakage_report: _leak_sql, content_hash: _hash_sql, artifact_scenarios: _scenarios_sql(), safety_suite: _safety_sql(), alert_round_trip: _alert_sql,
    standardised_vectors: _standard_sql, anomaly_distances: _anomaly_sql(), known_class_prior: None, boosted_prior: None, gated_prior: None, anomaly_scores: _detector_sql(), isolation_scores: _isolation_sql(), neighbour_novelty: _novelty_sql, predictive_uncertainty: None, density_weights: None, adversarial_check: None, calibration: _calibration_sql, feature_deviations: _deviation_sql, analogue_block: _analogue_sql, explanations: _explain_sql, explanation_payload: _payload_sql, calibrated_error: _calibrated_sql, candidate_records: _records_sql,
    flagship: _flagship_sql,
}


def queries() -> dict:
    return {f.__name__: f for f in _ALL}


def oracle_sql() -> dict[str, str]:
    return {f.__name__: sql for f, sql in _ALL.items() if sql}
