"""The quality gate: seven penalties of detection statistics, suppress-only."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tarnfield.schema import clip

# Limits of the penalties and the cut below which quality is floored.
MAX_NEGATIVE, MIN_DETECTIONS, MAX_SINGLE_BAND, MIN_SNR, LOW_QUALITY = 0.35, 8, 0.90, 5.0, 0.25


def penalties() -> dict[str, Column]:
    c = lambda name, default: F.coalesce(F.col(f"q_{name}"), F.lit(default)).cast("double")
    return {
        "neg_flux": clip(c("neg_flux_frac", 0.0) / MAX_NEGATIVE, 0.0, 1.0),
        "few_detections": clip(1.0 - c("n_det", 0.0) / MIN_DETECTIONS, 0.0, 1.0),
        "dominant_band": clip((c("dominant_band_det_frac", 0.0) - 0.7) / (MAX_SINGLE_BAND - 0.7), 0.0, 1.0),
        "high_error": clip((c("err_ratio_median", 0.0) - 0.25) / 0.5, 0.0, 1.0),
        "thin_coverage": clip((4.0 - c("n_bands_detected", 6.0)) / 3.0, 0.0, 1.0),
        "duplicates": clip(c("duplicate_epochs", 0.0) / 10.0, 0.0, 1.0),
        "low_snr": clip(1.0 - c("det_snr_median", 10.0) / MIN_SNR, 0.0, 1.0),
    }


def quality(stats: DataFrame) -> DataFrame:
    """object_id, quality and the penalties as qpen_*. A missing statistic has a neutral default."""
    out = with_quality(stats)
    return out.select("object_id", *(f"qpen_{k}" for k in penalties()), "quality")


def with_quality(stats: DataFrame) -> DataFrame:
    """``stats`` with the penalties and quality beside what is there."""
    out = stats.withColumns({f"qpen_{k}": x for k, x in penalties().items()})
    names = [f"qpen_{k}" for k in penalties()]
    worst = F.greatest(*names)
    others = (sum(F.col(x) for x in names) - worst) / (len(names) - 1)
    q = 1.0 - clip(0.8 * worst + 0.2 * others, 0.0, 1.0)
    return out.withColumn("quality", F.when(q < LOW_QUALITY, LOW_QUALITY / 2).otherwise(q))


def artifact_adjusted(quality_col: Column, score: Column) -> Column:
    """Quality times an external real/bogus score; a missing score changes nothing."""
    return quality_col * clip(F.coalesce(score, F.lit(1.0)), 0.0, 1.0)


def with_survey_score(rows: DataFrame, column: str = "realbogus") -> DataFrame:
    """Quality times the survey's own score held to 0 to 1; a missing score or column changes nothing."""
    if column not in rows.columns:
        return rows
    own = F.when(F.isnan(F.col(column).cast("double")), None).otherwise(F.col(column).cast("double"))
    return rows.withColumn("quality", clip(F.col("quality") * clip(F.coalesce(own, F.lit(1.0)), 0.0, 1.0), 0.0, 1.0))
