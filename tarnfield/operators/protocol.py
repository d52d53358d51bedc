"""Splits, folds, subsamples, manifests and the leakage guard."""

from __future__ import annotations

import hashlib
import json
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tarnfield.operators import ordered


def draw(key: Column, seed: str) -> Column:
    """A number in [0, 1) from the key alone: the same in any batch and order."""
    return F.conv(F.substring(F.md5(F.concat(F.lit(seed + ":"), key.cast("string"))), 1, 8), 16, 10).cast("double") / float(1 << 32)


def split(objects: DataFrame, fractions: dict[str, float], seed: str, key: str = "object_id") -> DataFrame:
    """Adds ``split`` by object, by cumulative thresholds of a hash."""
    u, upto, name = draw(F.col(key), seed), 0.0, F.lit(None).cast("string")
    out = []
    for k, f in fractions.items():
        upto += f
        out.append((k, upto))
    name = F.lit(out[-1][0])
    for k, t in reversed(out[:-1]):
        name = F.when(u < t, k).otherwise(name)
    return objects.withColumn("split", name)


def exact_split(objects: DataFrame, fractions: dict[str, float], seed: int, key: str = "object_id") -> DataFrame:
    """(key, u, split) of the distinct ids as one generator would deal them in ascending order.

    Ids are numbered by ranges; a task moves the generator ahead to the first number of
    each run of ids it holds, so the draws are those of NumPy's default generator over all
    ids at once. Null ids take no part; the last split takes the rest."""
    numbered = ordered.numbered(objects.select(F.col(key).cast("long").alias(key)).filter(F.col(key).isNotNull()).distinct(), F.col(key), [F.col(key)], "_n")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            n = batch.column(1).to_numpy(zero_copy_only=False)
            u = np.zeros(len(n))
            for part in np.split(np.arange(len(n)), np.nonzero(np.diff(n) != 1)[0] + 1) if len(n) else []:
                bits = np.random.default_rng(seed).bit_generator
                bits.advance(int(n[part[0]]) - 1)
                u[part] = np.random.Generator(bits).random(len(part))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(u)], names=[key, "u"])

    drawn = numbered.select(key, F.col("_n").cast("long")).mapInArrow(run, f"`{key}` long, u double")
    upto, bounds = 0.0, []
    for name, share in list(fractions.items())[:-1]:
        bounds.append((name, upto, upto + float(share)))
        upto += float(share)
    own = F.lit(list(fractions)[-1])
    for name, low, high in reversed(bounds):
        own = F.when((F.col("u") >= low) & (F.col("u") < high), name).otherwise(own)
    return drawn.withColumn("split", own)


def folds(rows: DataFrame, label: str, n: int, seed: str, key: str = "object_id") -> DataFrame:
    """Adds ``fold``: each label's rows dealt in turn, in hash order."""
    dealt = ordered.dealt(rows, draw(F.col(key), seed), [F.col(key)], [label], "_nth")
    return dealt.withColumn("fold", F.pmod(F.col("_nth") - 1, F.lit(n)).cast("int")).drop("_nth")


def rare_preserving(rows: DataFrame, label: str, budget: int, rare_cap: int, seed: str, key: str = "object_id") -> DataFrame:
    """Classes of at most rare_cap rows stay whole; the others share the rest of the budget in proportion."""
    n = rows.groupBy(label).agg(F.count(F.lit(1)).alias("_n"))
    one = Window.partitionBy(F.lit(0))
    rare = F.col("_n") <= rare_cap
    left = F.greatest(F.lit(budget) - F.coalesce(F.sum(F.when(rare, F.col("_n"))).over(one), F.lit(0)), F.lit(0))
    common = F.sum(F.when(~rare, F.col("_n"))).over(one)
    n = n.withColumn("_quota", F.when(rare, F.col("_n")).otherwise(F.greatest(F.lit(1), F.floor(left * F.col("_n") / common))))
    out = ordered.dealt(rows, draw(F.col(key), seed), [F.col(key)], [label], "_nth").join(n, label)
    return out.filter(F.col("_nth") <= F.col("_quota")).drop("_nth", "_quota", "_n")


def overlaps(members: DataFrame, key: str = "object_id") -> DataFrame:
    """Objects that are in more than one split: empty where splits are disjoint."""
    return members.groupBy(key).agg(F.count_distinct("split").alias("splits")).filter("splits > 1")


def fingerprints(members: DataFrame, key: str = "object_id") -> DataFrame:
    """Order-free fingerprint and size of each split."""
    h = F.conv(F.substring(F.md5(F.col(key).cast("string")), 1, 12), 16, 10).cast("decimal(38,0)")
    return members.groupBy("split").agg(F.count(F.lit(1)).alias("n"), F.sum(h).cast("string").alias("fingerprint"))


def manifest(members: DataFrame, name: str, seed: str, locked: str) -> str:
    """A JSON manifest: sizes and fingerprints, with a digest of itself. One row per split is read."""
    splits = {r["split"]: {"n": r["n"], "fingerprint": r["fingerprint"]} for r in fingerprints(members).collect()}
    body = {"name": name, "seed": seed, "locked": locked, "splits": dict(sorted(splits.items()))}
    return json.dumps(body | {"digest": hashlib.sha256(json.dumps(body, sort_keys=True).encode()).hexdigest()[:16]}, sort_keys=True)


def write_manifest(text: str, path: str, force: bool = False) -> None:
    """Write a manifest once: a file that is there already raises FileExistsError, unless ``force`` replaces it."""
    with open(path, "w" if force else "x", encoding="utf-8") as f:
        f.write(text)


def verify(members: DataFrame, text: str) -> bool:
    """Whether a manifest is untampered and fits the members."""
    body = json.loads(text)
    digest = body.pop("digest")
    if hashlib.sha256(json.dumps(body, sort_keys=True).encode()).hexdigest()[:16] != digest:
        return False
    return json.loads(manifest(members, body["name"], body["seed"], body["locked"]))["splits"] == body["splits"]


class LeakageError(RuntimeError):
    """A stage has read what it must not."""


class LeakageGuard:
    """Collects what each stage reads; reads of the locked split are violations."""

    def __init__(self, members: DataFrame, locked: str) -> None:
        self.locked, self.reads = members.filter(F.col("split") == locked).select("object_id"), []

    def saw(self, stage: str, ids: DataFrame) -> None:
        self.reads.append(ids.select(F.lit(stage).alias("stage"), "object_id"))

    def assert_clean(self) -> None:
        """Raises LeakageError, naming the stages, if any has read the locked split."""
        bad = {r["stage"]: r["n"] for r in self.violations().collect()}  # a row for each stage
        if bad:
            raise LeakageError(f"stages read the locked split {self.locked!r}: {bad}")

    def violations(self) -> DataFrame:
        if not self.reads:
            raise ValueError("no stage has reported its reads")
        rows = self.reads[0]
        for r in self.reads[1:]:
            rows = rows.unionByName(r)
        return rows.join(self.locked, "object_id", "left_semi").groupBy("stage").agg(F.count(F.lit(1)).alias("n"))


def content_hash(rows: DataFrame, columns: list[str]) -> DataFrame:
    """Order-free hash of the rows' contents, doubles at six places."""
    text = F.concat_ws("|", *(F.coalesce((F.round(F.col(c), 6) if t in ("double", "float") else F.col(c)).cast("string"), F.lit("null")) for c, t in rows.select(*columns).dtypes))
    h = F.conv(F.substring(F.md5(text), 1, 12), 16, 10).cast("decimal(38,0)")
    return rows.agg(F.sum(h).cast("string").alias("hash"), F.count(F.lit(1)).alias("n"))
