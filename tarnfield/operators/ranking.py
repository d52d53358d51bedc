"""Score, rank, tiers and abstention of the review queue."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tarnfield.operators import ordered
from tarnfield.schema import clip

CHANNELS = ("taxonomy_gap", "prior_entropy", "simplex_novelty", "novelty_gap", "neighbor_entropy", "family_misfit", "physics_gap", "cc_weighted", "anomaly_score")
# Baseline weights, exponents, bonus, tier and abstention thresholds.
BASELINE = {"taxonomy_gap": 1.0, "simplex_novelty": 0.2, "novelty_gap": 0.05}
QUALITY_EXPONENT, CONFIDENCE_EXPONENT, AGREEMENT_BONUS = 0.5, 0.25, 0.15
TIERS = (("critical", 0.95), ("high", 0.85), ("moderate", 0.60))
ABSTAIN_QUALITY, ABSTAIN_QUANTILE, ABSTAIN_RELIABILITY = 0.30, 0.97, 0.05
# What the decisions say.
LOW_QUALITY, UNCERTAIN, UNPLACED = "low data quality", "high predictive uncertainty", "no reliable distance information"
FOREIGN, DEGRADED = "reference domain does not represent this stream", "degraded domain match: treat ranking as indicative"


def normalised(weights: dict[str, float]) -> dict[str, float]:
    total = sum(weights.values())
    if total <= 0:
        raise ValueError("weights must have a positive sum")
    return {c: w / total for c, w in weights.items()}


def raw_evidence(weights: dict[str, float]) -> Column:
    return sum(F.col(c) * w for c, w in normalised(weights).items() if w > 0)


def agreement(weights: dict[str, float]) -> Column:
    """1 less the active channels' standard deviation over (mean + 0.5)."""
    active = [F.col(c) for c, w in weights.items() if w > 0]
    if len(active) < 2:
        return F.lit(1.0)
    mean = sum(active) / len(active)
    spread = F.sqrt(sum((x - mean) * (x - mean) for x in active) / len(active))
    return clip(1.0 - spread / F.greatest(mean + 0.5, F.lit(1e-9)), 0.0, 1.0)


def confidence(quality: Column, uncertainty: Column) -> Column:
    return clip((1.0 - clip(uncertainty, 0.0, 1.0)) * clip(quality, 0.0, 1.0), 0.0, 1.0)


def scores(evidence: DataFrame, weights: dict[str, float] = BASELINE, domain_match: bool = False) -> DataFrame:
    """Adds raw_evidence, agreement, confidence and score."""
    e = evidence.withColumns({"raw_evidence": raw_evidence(weights), "agreement": agreement(weights), "confidence": confidence(F.col("quality"), F.col("uncertainty"))})
    score = F.col("raw_evidence") * F.pow(clip(F.col("quality"), 1e-6, 1.0), F.lit(QUALITY_EXPONENT)) * F.pow(clip(F.col("confidence"), 1e-6, 1.0), F.lit(CONFIDENCE_EXPONENT)) * (1.0 + AGREEMENT_BONUS * F.col("agreement"))
    if domain_match:
        score = score * (0.7 + 0.3 * clip(F.col("domain_match"), 0.0, 1.0))
    return e.withColumn("score", score)


def rank(scored: DataFrame, reference_max: float | None = None, uncertainty_cut: float | None = None) -> DataFrame:
    """Adds normalised score, rank (ties by object_id), tier, abstain and reason.

    The batch's greatest score and its uncertainty quantile are read first; frozen
    values can be given instead, as a stream needs. Rows are ranked by ranges of the
    score; use top() for a page of the queue.
    """
    if reference_max is None:
        reference_max = scored.agg(F.max("score")).first()[0]
    if uncertainty_cut is None:
        uncertainty_cut = ordered.quantiles(scored, ["uncertainty"], [ABSTAIN_QUANTILE]).get("uncertainty", [None])[0]
    top, cut = F.lit(reference_max).cast("double"), F.lit(uncertainty_cut).cast("double")
    s = scored.withColumn("normalised_score", F.col("score") / F.greatest(top, F.lit(1e-12)))
    tier = F.lit("routine")
    for name, least in reversed(TIERS):
        tier = F.when(F.col("normalised_score") >= least, name).otherwise(tier)
    reason = F.when(F.col("quality") < ABSTAIN_QUALITY, LOW_QUALITY).when(F.col("uncertainty") > cut, UNCERTAIN).when(F.col("reliability") < ABSTAIN_RELIABILITY, UNPLACED)
    s = s.withColumns({"tier": tier, "reason": reason})
    s = s.withColumns({"abstain": F.col("reason").isNotNull(), "abstain_reason": F.when(F.col("reason").isNull(), "").when(F.col("normalised_score") > 0.5, F.concat("reason", F.lit(" (would otherwise rank highly)"))).otherwise(F.col("reason"))})
    return ordered.numbered(s.drop("reason"), -F.col("score"), [F.desc("score"), F.col("object_id")], "rank", tie=F.col("object_id"))


def top(scored: DataFrame, n: int, offset: int = 0) -> DataFrame:
    """A page of the queue, without a global sort of it."""
    return scored.orderBy(F.desc("score"), "object_id").limit(offset + n).offset(offset)


def decisions(rows: DataFrame, uncertainty_limit: float = 0.9, enabled: bool = True) -> DataFrame:
    """Adds confidence, abstain and reason: quality is asked first, then uncertainty (against an
    absolute limit), reliability and the domain. A degraded domain is a reason to be careful,
    not to abstain. Not ``enabled``: nothing abstains."""
    sure = confidence(F.col("quality"), F.col("uncertainty"))
    why = F.when(F.col("quality") < ABSTAIN_QUALITY, LOW_QUALITY).when(F.col("uncertainty") > uncertainty_limit, UNCERTAIN).when(F.col("reliability") < ABSTAIN_RELIABILITY, UNPLACED).when(F.col("domain_status") == "abstain", FOREIGN)
    care = F.when(F.col("domain_status") == "degraded", DEGRADED)
    if not enabled:
        why, care = F.lit(None).cast("string"), F.lit(None).cast("string")
    return rows.withColumns({"confidence": sure, "abstain": why.isNotNull(), "reason": F.coalesce(why, care, F.lit(""))})


def abstentions(decided: DataFrame) -> DataFrame:
    """The decisions in one row: n, n_abstained, abstention_rate, mean_confidence_kept, and the
    number of abstentions for each reason (reasons, a map)."""
    by_reason = decided.filter("abstain").groupBy("reason").agg(F.count(F.lit(1)).alias("n")).agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct("reason", "n")))).alias("reasons"))
    n = F.count(F.lit(1))
    whole = decided.agg(n.alias("n"), F.count_if("abstain").alias("n_abstained"), (F.count_if("abstain") / F.greatest(n, F.lit(1))).alias("abstention_rate"), F.avg(F.when(~F.col("abstain"), F.col("confidence"))).alias("mean_confidence_kept"))
    return whole.join(by_reason)
