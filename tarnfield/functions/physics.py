"""Cosmology, photometry and sky positions as column expressions."""

from __future__ import annotations

import functools
import math
from statistics import NormalDist

from pyspark.sql import Column
from pyspark.sql import functions as F

from tarnfield.schema import clip

# Slope of the K-correction and its reference wavelength in nm.
K_SLOPE, K_NM = 1.6, 400.0
# Cosmology, zero point, extinction ratios by band, galactic pole in degrees.
H0, OMEGA_M, LIGHT_KM_S, ZERO_POINT, R_V = 70.0, 0.3, 299792.458, 27.5, 3.1
EXTINCTION = (1.579, 1.180, 0.859, 0.661, 0.493, 0.394)
WAVELENGTH_NM = (367.0, 482.5, 622.2, 754.5, 869.1, 971.0)
POLE_RA, POLE_DEC, POLE_L = 192.85948, 27.12825, 122.93192
Z_MAX, GRID_STEPS = 10.0, 1024
DRAWS = 24
MAG_LO, MAG_HI = -5.0, 32.0


def ez(z: Column, omega_m: float = OMEGA_M) -> Column:
    return F.sqrt(omega_m * F.pow(1.0 + z, F.lit(3.0)) + (1.0 - omega_m))


def comoving_grid(omega_m: float = OMEGA_M, h0: float = H0, steps: int = GRID_STEPS) -> tuple[float, list[float]]:
    """Step in ln(1+z) and the cumulative trapezoid of c/H0 (1+z)/E(z) over it."""
    step = math.log1p(Z_MAX) / steps
    rate = [math.exp(k * step) / math.sqrt(omega_m * math.exp(3 * k * step) + 1 - omega_m) for k in range(steps + 1)]
    out = [0.0]
    for a, b in zip(rate, rate[1:]):
        out.append(out[-1] + (a + b) / 2 * step * LIGHT_KM_S / h0)
    return step, out


_grid = functools.cache(comoving_grid)


def comoving_distance(z: Column) -> Column:
    """Linear interpolation on the grid: a lookup in a constant array, no UDF.

    The array is written as one text, which the optimizer folds: a plan of a thousand
    literals would be slow to analyse."""
    step, grid = _grid()
    table = F.split(F.lit(",".join(map(repr, grid))), ",").cast("array<double>")
    z = clip(z, 0.0, Z_MAX)
    at = F.log1p(z) / step
    k = F.least(F.floor(at), F.lit(GRID_STEPS - 1)).cast("int")
    a, b = F.element_at(table, k + 1), F.element_at(table, k + 2)
    return a + (b - a) * (at - k)


def luminosity_distance(z: Column) -> Column:
    return comoving_distance(z) * (1.0 + clip(z, 0.0, Z_MAX))


def distance_modulus(z: Column) -> Column:
    return F.when(z > 0, 5.0 * F.log10(luminosity_distance(z) * 1e6) - 5.0)


def extinction(mwebv: Column, band: int) -> Column:
    return mwebv * R_V * EXTINCTION[band]


def k_correction(z: Column, band: Column, slopes: tuple[float, ...] | None = None) -> Column:
    """Linear in redshift, steeper in bluer bands (1.6 at 400 nm) unless slopes are given."""
    table = F.array(*(F.lit(float(s)) for s in slopes or [K_SLOPE * (K_NM / nm) for nm in WAVELENGTH_NM]))
    return z * F.element_at(table, band.cast("int") + 1)


def absolute_magnitude(apparent: Column, modulus: Column, absorbed: Column, k: Column | None = None) -> Column:
    """Apparent less distance modulus and extinction, and less the K-correction where one is given."""
    out = apparent - modulus - absorbed
    return out if k is None else out - k


def magnitude(flux: Column) -> Column:
    return F.when(flux > 0, -2.5 * F.log10(flux) + ZERO_POINT)


def magnitude_error(flux: Column, err: Column) -> Column:
    return F.when(flux > 0, 2.5 / math.log(10.0) * err / flux)


def luminosity_proxy(flux: Column, modulus: Column) -> Column:
    """Magnitude of a peak flux at 10 pc."""
    return magnitude(flux) - modulus


def feature_reliability(spread: Column, z_reliability: Column) -> Column:
    """Redshift reliability, falling with the spread of the absolute magnitude; a missing spread counts as 3."""
    return clip(F.coalesce(z_reliability, F.lit(0.0)) * F.exp(-F.coalesce(spread, F.lit(3.0)) / 1.5), 0.0, 1.0)


def masked_magnitude(flux: Column, snr: Column, least: float = 3.0) -> Column:
    return clip(F.when(snr >= least, magnitude(flux)), MAG_LO, MAG_HI)


def galactic(ra: Column, dec: Column) -> tuple[Column, Column]:
    """(l, b) in degrees of equatorial positions in degrees."""
    a, d, pd = F.radians(ra - POLE_RA), F.radians(dec), math.radians(POLE_DEC)
    b = F.asin(clip(F.sin(d) * math.sin(pd) + F.cos(d) * math.cos(pd) * F.cos(a), -1.0, 1.0))
    l = F.degrees(F.atan2(F.cos(d) * F.sin(a), F.sin(d) * math.cos(pd) - F.cos(d) * math.sin(pd) * F.cos(a)))
    return F.pmod(F.lit(POLE_L) - l, F.lit(360.0)), F.degrees(b)


def resolve_distmod(distmod: Column, photoz: Column) -> tuple[Column, Column]:
    """(modulus, flag): the survey's (1), else from the photometric redshift (0), else 0 (-1)."""
    flag = F.when(distmod > 0, 1).when(photoz > 1e-4, 0).otherwise(-1)
    return F.when(distmod > 0, distmod).when(photoz > 1e-4, distance_modulus(clip(photoz, 1e-4, 6.0))).otherwise(0.0), flag


def redshift_draws(photoz: Column, err: Column) -> Column:
    """DRAWS redshifts at fixed normal quantiles, within [1e-4, 8]."""
    q = [NormalDist().inv_cdf((k + 0.5) / DRAWS) for k in range(DRAWS)]
    return F.transform(F.array(*map(F.lit, q)), lambda s: F.least(F.greatest(photoz + F.greatest(err, F.lit(1e-4)) * s, F.lit(1e-4)), F.lit(8.0)))


def reliability(photoz: Column, err: Column, flag: Column) -> Column:
    """1 for galactic objects and near-exact redshifts, falling with the fractional error."""
    frac = F.least(F.coalesce(err, F.lit(1.0)) / F.greatest(photoz, F.lit(1e-4)), F.lit(5.0))
    base = F.exp(-frac / 0.15)
    return F.when((flag < 0) & (photoz <= 1e-3), 1.0).when(flag < 0, 0.0).when(flag >= 1, F.greatest(base, F.lit(0.9))).otherwise(base)


def alert_id(text: Column) -> Column:
    """31-bit id from the first 8 hex digits of SHA-256."""
    return (F.conv(F.substring(F.sha2(text, 256), 1, 8), 16, 10).cast("long") % 2147483647).cast("long")
