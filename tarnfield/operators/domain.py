"""Drift between a reference and a target: PSI, KS, match score, reference weights."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tarnfield.operators import ordered
from tarnfield.sources import stages, store

EPSILON = 1e-6
# PSI at which a domain is matched, and at which it abstains.
MATCHED, ABSTAIN = 0.10, 0.25


def long_form(rows: DataFrame, covariates: list[str], side: str) -> DataFrame:
    e = F.explode(F.array(*(F.struct(F.lit(c).alias("covariate"), F.col(c).cast("double").alias("v")) for c in covariates))).alias("e")
    return rows.select(e).select("e.covariate", "e.v", F.lit(side).alias("side")).filter(F.col("v").isNotNull())


def psi(long: DataFrame, bins: int = 10) -> DataFrame:
    """Per covariate, over bins at the reference's quantiles; 0 with fewer than 3 distinct edges."""
    found = ordered.quantiles_of(long.filter("side = 'reference'").select(F.col("covariate").alias("name"), "v"), [i / bins for i in range(bins + 1)])
    edges = long.sparkSession.createDataFrame([(c, list(dict.fromkeys(e))) for c, e in found.items()], "covariate string, edges array<double>")
    inner = F.slice("edges", 2, F.greatest(F.size("edges") - 2, F.lit(0)))
    j = long.join(edges.withColumn("inner", inner), "covariate").withColumn("bin", F.size(F.filter("inner", lambda e: e <= F.col("v"))))
    counts = j.groupBy("covariate", "bin").agg(F.count_if(F.col("side") == "reference").alias("r"), F.count_if(F.col("side") == "target").alias("t"), F.first(F.size("edges")).alias("n_edges"))
    w = Window.partitionBy("covariate")
    p = F.greatest(F.col("r") / F.sum("r").over(w), F.lit(EPSILON))
    q = F.greatest(F.col("t") / F.sum("t").over(w), F.lit(EPSILON))
    terms = counts.select("covariate", "n_edges", ((q - p) * F.log(q / p)).alias("term"))
    return terms.groupBy("covariate").agg(F.when(F.first("n_edges") < 3, 0.0).otherwise(F.sum("term")).alias("psi"))


def ks(long: DataFrame) -> DataFrame:
    """Greatest distance of the two distribution functions per covariate, over distinct values."""
    c = long.groupBy("covariate", "v").agg(F.count_if(F.col("side") == "reference").alias("r"), F.count_if(F.col("side") == "target").alias("t"))
    c = ordered.running(ordered.by_ranges(c, F.col("v")), [F.col("v")], {"upto_r": F.col("r"), "upto_t": F.col("t")}, ["covariate"], totals=True)
    d = F.abs(F.col("upto_r") / F.col("all_upto_r") - F.col("upto_t") / F.col("all_upto_t"))
    return c.groupBy("covariate").agg(F.max(d).alias("ks"))


def match(psis: DataFrame) -> DataFrame:
    """Match score and status from all covariates' PSI; missing ones do not count."""
    a = psis.agg(F.avg("psi").alias("mean_psi"), F.max("psi").alias("worst_psi"))
    score = F.least(F.lit(1.0), F.greatest(F.lit(0.0), 1.0 - 0.5 * F.col("mean_psi") / 0.25 - 0.5 * F.col("worst_psi") / 0.5))
    status = F.when(F.col("mean_psi") < MATCHED, "matched").when(F.col("mean_psi") > ABSTAIN, "abstain").otherwise("degraded")
    return a.select("mean_psi", "worst_psi", score.alias("match_score"), status.alias("status"))


def outside_range(reference: DataFrame, target: DataFrame, covariates: list[str]) -> DataFrame:
    """Share of the target outside the reference's 0.5 to 99.5 % range, per covariate."""
    found = ordered.quantiles(reference, covariates, [0.005, 0.995])
    r = reference.sparkSession.createDataFrame([(c, *q) for c, q in found.items()], "covariate string, lo double, hi double")
    t = long_form(target, covariates, "target").join(r, "covariate")
    return t.groupBy("covariate").agg(F.avg(((F.col("v") < F.col("lo")) | (F.col("v") > F.col("hi"))).cast("double")).alias("outside_fraction"))


def stratified_weights(reference: DataFrame, target: DataFrame, covariates: list[str], bins: int = 4, cap: float = 5.0) -> DataFrame:
    """Weight per reference object: share of its stratum in the target over that in the reference, clipped last."""
    edges = ordered.quantiles(reference, covariates, [i / bins for i in range(1, bins)])

    def cell(c: str) -> Column:
        return sum((F.col(c) >= e).cast("int") for e in edges.get(c, [0.0])).cast("string")

    def strata(rows: DataFrame) -> DataFrame:
        return rows.withColumn("stratum", F.concat_ws("-", *map(cell, covariates)))

    r, t = strata(reference), strata(target)
    rs = r.groupBy("stratum").agg(F.count(F.lit(1)).alias("nr"))
    ts = t.groupBy("stratum").agg(F.count(F.lit(1)).alias("nt"))
    w = rs.join(ts, "stratum", "left").withColumn("r", F.sum("nr").over(Window.partitionBy(F.lit(0))))
    n_t = t.agg(F.count(F.lit(1)).alias("n_t"))
    w = w.join(F.broadcast(n_t)).select("stratum", ((F.coalesce("nt", F.lit(0)) / F.col("n_t")) / (F.col("nr") / F.col("r"))).alias("ratio"))
    return r.join(w, "stratum").withColumn("weight", F.least(F.greatest(F.col("ratio"), F.lit(1.0 / cap)), F.lit(cap))).drop("ratio")


def effective_size(weights: DataFrame) -> DataFrame:
    return weights.agg((F.sum("weight") * F.sum("weight") / F.sum(F.col("weight") * F.col("weight"))).alias("ess"), F.count(F.lit(1)).alias("n"))


class ShiftMonitor:
    """A reference as exact tables of its values, to which later batches are compared.

    The state is (covariate, v, n), how often each value is there; states of several batches
    are added up. It can be published as a version and read back. Missing values and NaN
    count as 0. Drift below WARN matches, above FAIL abstains (the worst covariate counts)."""

    #: Shares of the range that was seen, of the bins' edges, and the median.
    SHARES = (0.005, 0.5, 0.995, *(i / 10 for i in range(11)))

    def __init__(self, covariates: list[str]) -> None:
        self.covariates = list(covariates)

    def counts(self, rows: DataFrame) -> DataFrame:
        value = lambda c: F.when(F.isnan(F.col(c).cast("double")), 0.0).otherwise(F.coalesce(F.col(c).cast("double"), F.lit(0.0)))
        own = [c for c in self.covariates if c in rows.columns]
        if not own:
            return rows.sparkSession.createDataFrame([], "covariate string, v double, n long")
        each = F.explode(F.array(*(F.struct(F.lit(c).alias("covariate"), value(c).alias("v")) for c in own))).alias("e")
        return rows.select(each).groupBy("e.covariate", "e.v").agg(F.count(F.lit(1)).alias("n"))

    def _with(self, state: DataFrame) -> ShiftMonitor:
        self.state = stages.written(state)
        found = ordered.quantiles_of_counts(self.state.select(F.col("covariate").alias("name"), "v", F.col("n").alias("same")), list(self.SHARES))
        self.fitted = {c: {"low": q[0], "median": q[1], "high": q[2], "edges": sorted(set(q[3:]))} for c, q in found.items()}
        return self

    def fit(self, reference: DataFrame) -> ShiftMonitor:
        return self._with(self.counts(reference))

    def merge(self, batch: DataFrame) -> ShiftMonitor:
        """Adds a batch to the reference; its rows are read once, the reference's are not."""
        return self._with(self.state.unionByName(self.counts(batch)).groupBy("covariate", "v").agg(F.sum("n").alias("n")))

    def save(self, path: str) -> int:
        return store.Snapshots(self.state.sparkSession, path).publish(self.state, {"covariates": self.covariates})

    @classmethod
    def load(cls, spark: SparkSession, path: str, version: int | None = None) -> ShiftMonitor:
        versions = store.Snapshots(spark, path)
        return cls(versions.note(version)["covariates"])._with(versions.read(version))

    def health(self, target: DataFrame) -> DataFrame:
        """A row for each covariate of both sides: covariate, psi, ks, outside (the share beyond
        the reference's 0.5 to 99.5 %), low, high, target_median, reference_median."""
        spark = target.sparkSession
        kinds = "covariate string, low double, high double, reference_median double, edges array<double>"
        fitted = spark.createDataFrame([(c, f["low"], f["high"], f["median"], f["edges"]) for c, f in self.fitted.items()], kinds)
        mine = stages.written(self.counts(target))
        medians = ordered.quantiles_of_counts(mine.select(F.col("covariate").alias("name"), "v", F.col("n").alias("same")), [0.5])
        medians = spark.createDataFrame([(c, q[0]) for c, q in medians.items()], "covariate string, target_median double")
        both = self.state.select("covariate", "v", F.col("n").alias("r"), F.lit(0).cast("long").alias("t")).unionByName(mine.select("covariate", "v", F.lit(0).cast("long").alias("r"), F.col("n").alias("t")))
        both = both.groupBy("covariate", "v").agg(F.sum("r").alias("r"), F.sum("t").alias("t")).join(F.broadcast(fitted), "covariate")
        inner = F.slice("edges", 2, F.greatest(F.size("edges") - 2, F.lit(0)))
        both = both.withColumn("bin", F.size(F.filter(inner, lambda e: e <= F.col("v"))))
        cum = stages.written(ordered.running(ordered.by_ranges(both, F.col("v")), [F.col("v")], {"upto_r": F.col("r"), "upto_t": F.col("t")}, ["covariate"], totals=True))
        cum = cum.filter("all_upto_r > 0 AND all_upto_t > 0")
        bins = cum.groupBy("covariate", "bin").agg(F.greatest(F.sum("r") / F.first("all_upto_r"), F.lit(EPSILON)).alias("p"), F.greatest(F.sum("t") / F.first("all_upto_t"), F.lit(EPSILON)).alias("q"), F.first(F.size("edges")).alias("n_edges"))
        psis = bins.groupBy("covariate").agg(F.when(F.first("n_edges") < 3, 0.0).otherwise(F.sum((F.col("q") - F.col("p")) * F.log(F.col("q") / F.col("p")))).alias("psi"))
        far = F.sum(F.when((F.col("v") < F.col("low")) | (F.col("v") > F.col("high")), F.col("t")).otherwise(0)) / F.first("all_upto_t")
        rest = cum.groupBy("covariate").agg(F.max(F.abs(F.col("upto_r") / F.col("all_upto_r") - F.col("upto_t") / F.col("all_upto_t"))).alias("ks"), far.alias("outside"), F.first("low").alias("low"), F.first("high").alias("high"), F.first("reference_median").alias("reference_median"))
        return psis.join(rest, "covariate").join(F.broadcast(medians), "covariate").select("covariate", "psi", "ks", "outside", "low", "high", "target_median", "reference_median")

    @staticmethod
    def status(health: DataFrame) -> DataFrame:
        """One row: score (1 less the worst PSI over ABSTAIN, 0 to 1), status, worst_psi, mean_psi. Without covariates: matched, score null."""
        worst = F.col("worst_psi")
        state = F.when(worst.isNull() | (worst < MATCHED), "matched").when(worst > ABSTAIN, "abstain").otherwise("degraded")
        return health.agg(F.max("psi").alias("worst_psi"), F.avg("psi").alias("mean_psi")).select(F.when(worst.isNotNull(), F.least(F.lit(1.0), F.greatest(F.lit(0.0), 1.0 - worst / ABSTAIN))).alias("score"), state.alias("status"), "worst_psi", "mean_psi")
