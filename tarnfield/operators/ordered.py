"""Global orders without a global task: running totals, ranks and exact quantiles.

Rows are cut into ranges of their order; the ranges' sums give each range's offset,
and only then rows are summed within their range. A range is a task's window, the
ranges' sums are the only thing that is ordered as a whole. Boundaries come from a
mergeable quantile sketch and only spread the work: the totals are exact wherever
they lie. A value that several boundaries fall on (a score that most rows have) is
split further by ranges of the column that breaks its ties.
"""

from __future__ import annotations

from pyspark.ml.feature import Bucketizer
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tarnfield.sources import stages

#: Ranges of values, and ranges of the tie-breaker within a value that is split.
RANGES, TIE_RANGES = 1024, 64
#: Ranges of a uniform draw.
DRAWN = 1024


def _bounds(found: list[float] | None) -> list[float]:
    return sorted({float(b) for b in found or [] if abs(b) != float("inf") and b == b})


def _bucket(rows: DataFrame, col: str, bounds: list[float], out: str) -> DataFrame:
    """The number of boundaries at or below the value, by binary search; null is 0, NaN above all."""
    if not bounds:
        return rows.withColumn(out, F.lit(0))
    inf = float("inf")
    rows = Bucketizer(splits=[-inf, *bounds, inf], inputCol=col, outputCol=out, handleInvalid="keep").transform(rows)
    return rows.withColumn(out, F.when(F.col(col).isNull(), 0).when(F.isnan(col), len(bounds)).otherwise(F.col(out)).cast("int"))


def by_ranges(rows: DataFrame, value: Column, tie: Column | None = None) -> DataFrame:
    """``rows``, written, with _range, which rises with ``value`` and, within a value that
    several boundaries fall on, with the numeric ``tie``.

    Groups share the boundaries: no range of a group is larger than that of all rows."""
    rows = rows.withColumn("_v", value.cast("double"))
    rows = stages.written(rows if tie is None else rows.withColumn("_tie", tie.cast("double")))
    sketch = [F.percentile_approx("_v", [i / RANGES for i in range(1, RANGES)], 20_000).alias("v")]
    if tie is not None:
        sketch.append(F.percentile_approx("_tie", [i / TIE_RANGES for i in range(1, TIE_RANGES)], 2_000).alias("tie"))
    found = rows.agg(*sketch).first()
    bounds = _bounds(found["v"])
    out = _bucket(rows, "_v", bounds, "_range")
    hot = sorted({b for a, b in zip(found["v"] or [], (found["v"] or [])[1:]) if a == b}) if tie is not None else []
    if hot:
        out = _bucket(out, "_tie", _bounds(found["tie"]), "_sub")
        own = F.col("_v").isin(hot)  # such a value is itself a boundary: it stands first in its range
        out = out.withColumn("_range", F.col("_range") * (TIE_RANGES + 1) + F.when(own, F.col("_sub")).otherwise(TIE_RANGES)).drop("_sub")
    return out.drop("_v", "_tie")


def running(rows: DataFrame, order: list[Column], sums: dict[str, Column], by: list[str] = [], totals: bool = False) -> DataFrame:  # noqa: B006
    """Adds the running total of each of ``sums``, up to and with the row, within ``by``.

    ``rows`` has _range, which must not contradict ``order``. With ``totals`` the
    groups' whole sums come beside them as all_<name>."""
    group = Window.partitionBy(*(by or [F.lit(0)]))
    before = group.orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)
    spans = rows.groupBy(*by, "_range").agg(*(F.sum(x).alias(f"_s_{n}") for n, x in sums.items()))
    offsets = spans.select(*(F.col(c).alias(f"_k_{c}") for c in (*by, "_range")), *(F.coalesce(F.sum(f"_s_{n}").over(before), F.lit(0)).alias(f"_o_{n}") for n in sums), *(F.sum(f"_s_{n}").over(group).alias(f"all_{n}") for n in sums if totals))
    within = Window.partitionBy(*by, "_range").orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    out = rows.withColumns({f"_w_{n}": F.sum(x).over(within) for n, x in sums.items()})
    on = None
    for c in (*by, "_range"):
        same = F.col(c).eqNullSafe(F.col(f"_k_{c}"))
        on = same if on is None else on & same
    out = out.join(offsets, on).withColumns({n: F.col(f"_o_{n}") + F.col(f"_w_{n}") for n in sums})
    return out.drop("_range", *(f"_k_{c}" for c in (*by, "_range")), *(f"_{x}_{n}" for n in sums for x in "ow"))


def numbered(rows: DataFrame, value: Column, order: list[Column], out: str, by: list[str] = [], tie: Column | None = None) -> DataFrame:  # noqa: B006
    """Adds the row number from 1 in ``order`` (which begins with ``value``) within ``by``.
    With ``tie``, the numeric column that ``order`` goes on with, ties are split as well."""
    return running(by_ranges(rows, value, tie), order, {out: F.lit(1)}, by)


def dealt(rows: DataFrame, draw: Column, order: list[Column], by: list[str], out: str) -> DataFrame:
    """Adds the row number from 1 within ``by``, in the order of a uniform ``draw`` from
    0 to 1 and then ``order``: ranges of the draw need no boundaries."""
    ranged = rows.withColumn("_draw", draw).withColumn("_range", F.floor(F.col("_draw") * DRAWN).cast("int"))
    return running(ranged, [F.col("_draw"), *order], {out: F.lit(1)}, by).drop("_draw")


def long_form(rows: DataFrame, columns: list[str]) -> DataFrame:
    """(name, v) of every value that is not null."""
    each = F.explode(F.array(*(F.struct(F.lit(c).alias("name"), F.col(c).cast("double").alias("v")) for c in columns))).alias("e")
    return rows.select(each).select("e.name", "e.v").filter(F.col("v").isNotNull())


def quantiles(rows: DataFrame, columns: list[str], shares: list[float]) -> dict[str, list[float]]:
    """Exact linearly interpolated quantiles of columns; those without values are left out."""
    return quantiles_of(long_form(rows, columns), shares)


def quantiles_of(long: DataFrame, shares: list[float]) -> dict[str, list[float]]:
    """The same for long rows (name, v)."""
    return quantiles_of_counts(long.groupBy("name", "v").agg(F.count(F.lit(1)).alias("same")), shares)


def quantiles_of_counts(counts: DataFrame, shares: list[float]) -> dict[str, list[float]]:
    """The same for values and how often each is there (name, v, same). What comes to the
    driver is the few values that the quantiles lie between."""
    cum = running(by_ranges(counts, F.col("v")), [F.col("v")], {"upto": F.col("same")}, ["name"], totals=True)
    at = F.explode(F.array(*(F.struct(F.lit(k).alias("k"), ((F.col("all_upto") - 1) * s).alias("pos")) for k, s in enumerate(shares))))
    cum = cum.select("name", "v", "same", "upto", at.alias("at"))
    first = F.col("upto") - F.col("same")
    low, high = F.floor("at.pos"), F.ceil("at.pos")
    cum = cum.filter((first <= high) & (F.col("upto") > low))
    row = cum.groupBy("name", "at.k").agg(F.min(F.when(F.col("upto") > low, F.col("v"))).alias("low"), F.max(F.when(first <= high, F.col("v"))).alias("high"), F.max(F.col("at.pos") - low).alias("part"))
    out: dict[str, dict[int, float]] = {}
    for r in row.collect():  # one row for each name and share
        out.setdefault(r["name"], {})[r["k"]] = r["low"] + (r["high"] - r["low"]) * r["part"]
    return {c: [own[k] for k in range(len(shares))] for c, own in out.items()}
