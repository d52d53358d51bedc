"""Evidence channels: how badly known populations explain an object."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tarnfield.operators import ordered
from tarnfield.operators.neighbours import PivotIndex
from tarnfield.schema import IS_GALACTIC, KNOWN
from tarnfield.sources import stages


def centroids(proba: DataFrame, k: int = len(KNOWN)) -> DataFrame:
    """(label, centroid): the mean probability vector (of k classes) of each label; k sums per label."""
    return proba.groupBy("label").agg(F.array(*(F.avg(F.col("p")[i]) for i in range(k))).alias("centroid"))


def simplex_channels(proba: DataFrame, cents: DataFrame) -> DataFrame:
    """The channels that a probability vector gives by itself and against class centroids.

    ``cents`` has a row per class; its one packed row is broadcast."""
    k = len(KNOWN)
    packed = cents.agg(F.collect_list("centroid").alias("cents"))
    # a sequential scan of the one-row side: every object meets all K centroids in one expression
    j = proba.join(F.broadcast(packed))
    total = F.aggregate("p", F.lit(0.0), lambda a, v: a + v)
    j = j.withColumn("t", total).withColumn("p", F.transform("p", lambda v: v / F.col("t"))).withColumn("s", F.sort_array(F.arrays_zip("p", F.array(*(F.lit(-c) for c in KNOWN)).alias("c")), asc=False))
    entropy = F.aggregate("p", F.lit(0.0), lambda a, v: a - v * F.log(v)) / math.log(k)
    l1 = F.transform("cents", lambda c: F.aggregate(F.zip_with("p", c, lambda a, b: F.abs(a - b)), F.lit(0.0), lambda a, v: a + v))
    first, second = F.col("s")[0], F.col("s")[1]
    return j.select("object_id", "label", (1 - first["p"]).alias("taxonomy_gap"), entropy.alias("prior_entropy"), (0.5 * F.array_min(l1)).alias("simplex_novelty"), (1 - (first["p"] - second["p"])).alias("novelty_gap"), (-first["c"]).alias("best_fit_code"), first["p"].alias("best_fit_prob"), (-second["c"]).alias("runner_up_code"), second["p"].alias("runner_up_prob"))


def neighbours(queries: DataFrame, reference: DataFrame, k: int) -> DataFrame:
    """Exact Euclidean kNN of a query set: query_id, rank, object_id, label, distance.

    Own rows are no neighbours; vectors that are null, hold null or non-finite components,
    or differ in size from most of the reference take no part."""
    return PivotIndex().fit(reference).query(queries, k)


def neighbour_channels(near: DataFrame, n_classes: int) -> DataFrame:
    """Entropy of the neighbours' classes over log(n classes), and distances."""
    shares = near.groupBy("query_id", "label").agg(F.count(F.lit(1)).alias("n"), F.sum("distance").alias("d"), F.min("distance").alias("m"))
    w = Window.partitionBy("query_id")
    shares = shares.withColumn("total", F.sum("n").over(w)).withColumn("share", F.col("n") / F.col("total"))
    return shares.groupBy(F.col("query_id").alias("object_id")).agg((-F.sum(F.col("share") * F.log("share")) / math.log(n_classes)).alias("neighbor_entropy"), (F.sum("d") / F.sum("n")).alias("neighbour_mean_distance"), F.min("m").alias("neighbour_min_distance"))


#: Labels (places in KNOWN) of galactic populations.
GALACTIC_LABELS = tuple(i for i, c in enumerate(KNOWN) if c in IS_GALACTIC)


def galactic_probability(proba: DataFrame) -> DataFrame:
    """Probability that the vector gives to galactic populations."""
    return proba.select("object_id", sum(F.col("p")[i] for i in GALACTIC_LABELS).alias("p_galactic"))


def family_misfit(proba: DataFrame, near: DataFrame) -> DataFrame:
    """How far the vector's galactic probability is from the share of galactic neighbours."""
    share = near.groupBy(F.col("query_id").alias("object_id")).agg(F.avg(F.col("label").isin(*GALACTIC_LABELS).cast("double")).alias("share"))
    return galactic_probability(proba).join(share, "object_id").select("object_id", F.abs(F.col("p_galactic") - F.col("share")).alias("family_misfit"))


def class_statistics(rows: DataFrame, features: list[str]) -> DataFrame:
    """(label, feature, mean, sd) of every feature by class, in long form. The features
    are columns, or in their order the array column x."""
    if "x" in rows.columns:
        name = F.element_at(F.array(*map(F.lit, features)), F.col("k") + 1).alias("feature")
        long = rows.select("label", F.posexplode("x").alias("k", "v")).select("label", name, "v")
        return long.groupBy("label", "feature").agg(F.avg("v").alias("mean"), F.stddev_samp("v").alias("sd"))
    long = rows.select("label", F.explode(F.array(*(F.struct(F.lit(f).alias("feature"), F.col(f).cast("double").alias("v")) for f in features))).alias("e")).select("label", "e.feature", "e.v")
    return long.groupBy("label", "feature").agg(F.avg("v").alias("mean"), F.stddev_samp("v").alias("sd"))


def physics_channels(rows: DataFrame, stats: DataFrame, features: list[str]) -> DataFrame:
    """The least mean squared deviation from any class over the features, the class,
    and (where rows have probabilities ``p``) the mean over the classes weighted by them.

    The statistics, classes by features, are one packed row; every object meets all
    classes in one expression, without a shuffle. A missing value deviates by nothing."""
    place = {f: k for k, f in enumerate(features)}
    at = F.create_map(*(F.lit(x) for kv in place.items() for x in kv))[F.col("feature")]
    packed = stats.filter(F.col("sd") > 1e-12).groupBy("label").agg(F.array_sort(F.collect_list(F.struct(at.alias("k"), "mean", "sd"))).alias("s"))
    packed = packed.agg(F.array_sort(F.collect_list(F.struct("label", "s"))).alias("_classes"))
    x = F.col("x") if "x" in rows.columns else F.array(*(F.col(f).cast("double") for f in features))
    j = rows.withColumn("_x", x).join(F.broadcast(packed))

    def square(s: Column) -> Column:
        z = (F.col("_x")[s["k"]] - s["mean"]) / s["sd"]
        return F.coalesce(z * z, F.lit(0.0))

    chi = F.transform("_classes", lambda c: F.struct((F.aggregate(c["s"], F.lit(0.0), lambda a, s: a + square(s)) / len(features)).alias("chi2"), c["label"].alias("label")))
    j = j.withColumn("_chi", chi)
    least = F.array_min("_chi")
    out = [least["chi2"].alias("physics_gap"), least["label"].alias("nearest_class")]
    if "p" in rows.columns:
        out.append(F.aggregate("_chi", F.lit(0.0), lambda a, c: a + c["chi2"] * F.col("p")[c["label"]]).alias("cc_weighted"))
    return j.select("object_id", *out)


def rank01(rows: DataFrame, col: str) -> DataFrame:
    """object_id and ``mapped``: the place in the order of ``col`` from 0 to 1, missing
    values lowest, ties by object_id."""
    value = F.coalesce(F.col(col), F.lit(float("-inf")))
    placed = ordered.numbered(rows.select("object_id", value.alias("v")), F.col("v"), [F.col("v"), F.col("object_id")], "nth", tie=F.col("object_id"))
    n = rows.agg(F.greatest(F.count(F.lit(1)) - 1, F.lit(1)).alias("n"))
    return placed.join(F.broadcast(n)).select("object_id", ((F.col("nth") - 1) / F.col("n")).alias("mapped"))


def quantile_map(values: DataFrame, reference: DataFrame, col: str) -> DataFrame:
    """``values`` with ``mapped``: the mid-rank of ``col`` in the reference, (below + ties/2) / N."""
    own = stages.written(values)
    return own.join(mid_ranks(own, reference, [col]).select(F.col("v").alias("_v"), "mapped"), F.col(col) == F.col("_v")).drop("_v")


def quantile_maps(values: DataFrame, reference: DataFrame, columns: dict[str, str]) -> DataFrame:
    """object_id and, under the given names, the mid-ranks of several columns: one order for all."""
    own = stages.written(values.select("object_id", *columns))
    ranks = stages.written(mid_ranks(own, reference, list(columns)))
    out = own
    for c, name in columns.items():
        mapped = ranks.filter(F.col("name") == c).select(F.col("v").alias("_v"), F.col("mapped").alias(name))
        out = out.join(mapped, F.col(c) == F.col("_v")).drop("_v")
    return out.select("object_id", *columns.values())


def mid_ranks(values: DataFrame, reference: DataFrame, columns: list[str]) -> DataFrame:
    """(name, v, mapped): the mid-rank in the reference of every value of the columns.

    Reference and values are united; equal values are counted, and their counts are
    summed along the order by ranges."""

    def long(rows: DataFrame, one: int) -> DataFrame:
        each = F.explode(F.array(*(F.struct(F.lit(c).alias("name"), F.col(c).cast("double").alias("v")) for c in columns))).alias("e")
        return rows.select(each).select("e.name", "e.v", F.lit(one).alias("one"))

    both = long(reference, 1).unionByName(long(values, 0)).groupBy("name", "v").agg(F.sum("one").alias("same"))
    cum = ordered.running(ordered.by_ranges(both, F.col("v")), [F.col("v")], {"upto": F.col("same")}, ["name"], totals=True)
    return cum.select("name", "v", F.try_divide(F.col("upto") - F.col("same") / 2, F.col("all_upto")).alias("mapped"))
