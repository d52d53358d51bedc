"""Why an object is in the queue: deviating features, analogues, channel shares, a sentence."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tarnfield.schema import taxonomy


def feature_deviations(rows: DataFrame, stats: DataFrame, features: list[str], least: float = 2.0, n: int = 5) -> DataFrame:
    """The features furthest from the best-fitting class: object_id, feature, value, z, rank.

    ``rows`` has object_id, best_fit_code and the features; ``stats`` label, feature, mean, sd."""
    place = F.create_map(*(F.lit(x) for kv in ((f, k) for k, f in enumerate(features)) for x in kv))[F.col("feature")]
    own = stats.filter(F.col("sd") > 1e-12).groupBy(F.col("label").alias("_label")).agg(F.collect_list(F.struct(place.alias("k"), "mean", "sd")).alias("_stats"))
    # a row for each class, with all its features: objects meet their class, not their features one by one
    j = rows.select("object_id", "best_fit_code", F.array(*(F.col(f).cast("double") for f in features)).alias("x")).join(F.broadcast(own), F.col("best_fit_code") == F.col("_label"))
    names = F.array(*map(F.lit, features))
    each = F.transform("_stats", lambda s: F.struct((-F.abs((F.col("x")[s["k"]] - s["mean"]) / s["sd"])).alias("far"), names[s["k"]].alias("feature"), F.col("x")[s["k"]].alias("value"), ((F.col("x")[s["k"]] - s["mean"]) / s["sd"]).alias("z")))
    best = F.slice(F.array_sort(F.filter(each, lambda e: e["far"] <= -least)), 1, n)
    return j.select("object_id", F.posexplode(best).alias("at", "e")).select("object_id", "e.feature", "e.value", "e.z", (F.col("at") + 1).alias("rank"))


def analogues(near: DataFrame, max_distance: float = 12.0, min_reliable: int = 3) -> DataFrame:
    """Per query with a neighbour in reach: how many there are, the leading class and its share,
    whether they suffice, their mean distance, the classes' shares (a map), and why they do not suffice."""
    counts = near.filter(F.col("distance") <= max_distance).groupBy("query_id", "label").agg(F.count(F.lit(1)).alias("n"), F.sum("distance").alias("d"))
    lead = F.max_by("label", F.struct(F.col("n"), -F.col("label")))
    out = counts.groupBy(F.col("query_id").alias("object_id")).agg(F.sum("n").alias("n_analogues"), lead.alias("dominant"), (F.max("n") / F.sum("n")).alias("purity"), (F.sum("d") / F.sum("n")).alias("mean_distance"), F.array_sort(F.collect_list(F.struct("label", "n"))).alias("_each"))
    shares = F.map_from_entries(F.transform("_each", lambda e: F.struct(e["label"].cast("string"), e["n"] / F.col("n_analogues"))))
    enough = F.col("n_analogues") >= min_reliable
    why = F.when(enough, "").otherwise(F.format_string("only %d analogues within reach, %d are needed", F.col("n_analogues"), F.lit(min_reliable)))
    return out.withColumns({"reliable": enough, "class_shares": shares, "reason": why}).drop("_each")


def contributions(evidence: DataFrame, weights: dict[str, float]) -> DataFrame:
    """object_id, the channel that contributes most, and a sentence about it."""
    total = sum(weights.values())
    parts = F.array(*(F.struct((F.col(c) * (w / total)).alias("share"), F.lit(c).alias("channel")) for c, w in weights.items() if w > 0))
    tax = taxonomy(evidence.sparkSession).select(F.col("code").alias("best_fit_code"), F.col("name").alias("best_fit"))
    e = evidence.withColumn("driver", F.sort_array(parts, asc=False)[0]).join(F.broadcast(tax), "best_fit_code", "left")
    text = F.format_string("Closest known population %s (probability %.2f); driven by %s.", F.coalesce("best_fit", F.lit("unknown")), F.col("best_fit_prob"), F.translate("driver.channel", "_", " "))
    return e.select("object_id", F.col("driver.channel").alias("driver"), F.col("driver.share").alias("share"), text.alias("summary"))


def payload(evidence: DataFrame, weights: dict[str, float], deviations: DataFrame, analogue_rows: DataFrame, near: DataFrame, n_near: int = 5) -> DataFrame:
    """object_id and one document with all that explains it: channels with value, weight and
    contribution (largest first), the deviating features, the analogues with their nearest
    members, the driver and the sentence.

    ``evidence`` is the page of the queue that is explained; the other tables (of
    feature_deviations, analogues and neighbours) may hold more objects. What an object lacks is null."""
    total = sum(weights.values())
    each = [F.struct((F.col(c) * (w / total)).alias("contribution"), F.lit(c).alias("channel"), F.col(c).alias("value"), F.lit(w / total).alias("weight")) for c, w in weights.items() if w > 0]
    page = evidence.select("object_id")
    channels = evidence.select("object_id", F.sort_array(F.array(*each), asc=False).alias("channels"))
    odd = deviations.join(page, "object_id", "left_semi").groupBy("object_id").agg(F.array_sort(F.collect_list(F.struct("rank", "feature", "value", "z"))).alias("deviations"))
    members = near.filter(F.col("rank") <= n_near).groupBy(F.col("query_id").alias("object_id")).agg(F.array_sort(F.collect_list(F.struct("rank", F.col("object_id").alias("analogue"), "label", "distance"))).alias("nearest"))
    like = analogue_rows.join(members, "object_id", "left").join(page, "object_id", "left_semi")
    like = like.select("object_id", F.struct(*(c for c in [*analogue_rows.columns, "nearest"] if c != "object_id")).alias("analogues"))
    out = channels.join(contributions(evidence, weights), "object_id").join(odd, "object_id", "left").join(like, "object_id", "left")
    return out.select("object_id", "driver", F.to_json(F.struct("driver", "summary", "channels", "deviations", "analogues")).alias("document"))
