"""Mixing sources to target weights by weighted fair queueing.

Within each source documents are shuffled by a hash of id and text; a document's virtual finish
time is the cumulative size of its source up to and with it, divided by the
source's target. A source can be gone through twice, so each document stands in
line two times. All copies are then range-sorted by finish time over all sources
and cut where the total budget is used up.

Both running sums are distributed: hash ranges within sources, and ranges of
finish time over all, are summed first, their few sums give each range's offset,
and only then rows are summed within their range. Ranges are arithmetic (the
hash is uniform, and so is the load over virtual time), so nothing is sampled,
and a source with a third of all rows is spread like any other.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tarnfield.llm.merkle_manifest import indexed
from tarnfield.llm.tables import drop, fresh, materialise

WEIGHTS = (3, 1, 2)
BUDGET_SHARE = 1.5
EPOCHS = 2
SEED = "mix-1"
#: Rows that a range holds on average; the number of ranges follows the table. Small
#: ranges spread a large source over more tasks; their sums stay a thousandth of the rows.
RANGE_ROWS = 1024


def word_count(text: Column) -> Column:
    r"""Number of [^\x20\x09-\x0D]+ in a text; 0 for null.

    A word begins where a non-space follows the start or a space; all built-in."""
    plain = F.trim(F.translate(text, "\t\n\x0b\x0c\r", "     "))
    return F.when(F.coalesce(plain, F.lit("")) == "", F.lit(0)).otherwise(F.size(F.split(plain, " +"))).cast("long")


def targets(sizes: DataFrame, weights: tuple[int, ...] = WEIGHTS, budget_share: float = BUDGET_SHARE, most: int = EPOCHS) -> DataFrame:
    """From (source, source_size): target and the total budget.

    Sources by code point, null last, take ``weights`` in turn. The budget is
    dealt by weight; a source stops at ``most`` times its size and what is over is
    dealt again, which ends at the water level where the sources with the least
    size per weight are full. Sources are ordered by ranges: however many there
    are (domains, say), no task holds all of them.
    """
    none = F.col("source").isNull()
    named = indexed(sizes.select("source", "source_size", none.alias("none")), None, ["none", "source"])
    weight = F.element_at(F.array(*map(F.lit, weights)), F.pmod(F.col("idx"), F.lit(len(weights))).cast("int") + 1).cast("double")
    cap = (F.col("source_size") * most).cast("double")
    weighed = materialise(named.select("source", "source_size", "none", weight.alias("weight"), cap.alias("cap")).withColumn("ratio", F.col("cap") / F.col("weight")))
    whole = weighed.agg(F.sum("source_size").alias("all_size"), F.sum("weight").alias("all_weight"))
    level = indexed(weighed, None, ["ratio", "none", "source"]).withColumn("span", F.floor(F.col("idx") / RANGE_ROWS).cast("long")).drop("n")
    level = running_total(level, [], "span", [F.col("idx")], "cap", "upto_cap")
    level = running_total(level, [], "span", [F.col("idx")], "weight", "upto_weight")
    level = level.join(F.broadcast(whole)).withColumn("budget", F.col("all_size").cast("double") * budget_share)
    left = F.col("budget") - (F.col("upto_cap") - F.col("cap"))
    open_weight = F.col("all_weight") - (F.col("upto_weight") - F.col("weight"))
    level = materialise(level.select("source", "source_size", "weight", "cap", "ratio", "budget", (left / open_weight).alias("share")))
    # the first source that its share does not fill fixes the level for all behind it
    water = level.agg(F.max(F.when(F.col("ratio") > F.col("share"), F.col("share"))).alias("water"))
    level = level.join(F.broadcast(water))
    return level.select("source", "source_size", F.coalesce(F.least(F.col("cap"), F.col("water") * F.col("weight")), F.col("cap")).alias("target"), F.round(F.col("budget")).cast("long").alias("budget"))


def running_total(rows: DataFrame, groups: list[str], range_col: str, order: list[Column], value: str, out: str) -> DataFrame:
    """Running sum of ``value`` in ``order`` within ``groups``, two-level: sums of
    ranges, their offsets, then sums within each range."""
    span = rows.groupBy(*groups, range_col).agg(F.sum(value).alias("_span"))
    before = Window.partitionBy(*(groups or [F.lit(0)])).orderBy(range_col).rowsBetween(Window.unboundedPreceding, -1)
    offset = span.select(*groups, range_col, F.coalesce(F.sum("_span").over(before), F.lit(0)).alias("_offset"))
    within = Window.partitionBy(*groups, range_col).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    summed = rows.withColumn("_within", F.sum(value).over(within))
    keys = [*groups, range_col]
    offset = offset.withColumnsRenamed({k: f"_k_{k}" for k in keys})
    on = None
    for k in keys:
        same = F.col(k).eqNullSafe(F.col(f"_k_{k}"))
        on = same if on is None else on & same
    return summed.join(offset, on).withColumn(out, F.col("_offset") + F.col("_within")).drop("_offset", "_within", *(f"_k_{k}" for k in keys))


IDENTITY = ["doc_id", "text_md5"]


def text_md5(text: Column) -> Column:
    return F.md5(F.coalesce(text, F.lit("")))


def mix(docs: DataFrame, weights: tuple[int, ...] = WEIGHTS, budget_share: float = BUDGET_SHARE, seed: str = SEED) -> DataFrame:
    """One row per document: doc_id, source, text_md5, size, source_size, target, copies (0 to EPOCHS), taken.

    Whole documents are taken, so a source meets its target to within a document.
    A null text or one without words has size 0 and is never taken. Rows with
    equal doc_id are told apart by their text; rows equal in both stand side by
    side in line. An empty table gives an empty result.
    """
    slim = docs.select("doc_id", F.col("source").cast("string").alias("source"), word_count(F.col("text")).alias("size"), text_md5(F.col("text")).alias("text_md5"))
    slim = materialise(slim.withColumn("shuffle", F.md5(F.concat(F.lit(seed + ":"), F.coalesce(F.col("doc_id").cast("string"), F.lit("null")), F.lit(":"), F.col("text_md5")))))
    ranges = max(1, min(1 << 20, slim.count() // RANGE_ROWS))
    share = materialise(targets(slim.groupBy("source").agg(F.sum("size").alias("source_size")), weights, budget_share))
    budget = (share.agg(F.max("budget")).first() or [None])[0] or 0
    rows = slim.withColumn("span", F.floor(F.conv(F.substring("shuffle", 1, 7), 16, 10).cast("long") * ranges / F.lit(16**7)).cast("int"))
    order = [F.col(c) for c in ("shuffle", "doc_id", "text_md5", "size")]
    queued = running_total(rows, ["source"], "span", order, "size", "upto").drop("span")
    share = share.drop("budget").withColumnRenamed("source", "_source")
    queued = materialise(queued.join(share, F.col("source").eqNullSafe(F.col("_source"))).drop("_source"))

    def finish(epoch: Column) -> Column:
        return F.when(F.col("size") > 0, F.try_divide((F.col("upto") + epoch * F.col("source_size")).cast("double"), F.col("target")))

    def place(epoch: Column) -> Column:
        return F.struct(finish(epoch).alias("finish"), F.col("source").isNull().alias("none"), F.coalesce(F.col("source"), F.lit("")).alias("source"), F.col("shuffle"), F.col("doc_id"), F.col("text_md5"), epoch.alias("epoch"))

    epochs = F.sequence(F.lit(0), F.lit(EPOCHS - 1))
    line = queued.select("size", F.explode(F.transform(epochs, place)).alias("place")).filter(F.col("place.finish").isNotNull())
    line = line.withColumn("span", F.floor(F.col("place.finish") * ranges).cast("long"))
    # the range that holds the cut: one of some thousand rows, whatever the table's size
    spans = line.groupBy("span").agg(F.sum("size").alias("load"))
    before = F.coalesce(F.sum("load").over(Window.partitionBy(F.lit(0)).orderBy("span").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    at = spans.withColumn("before", before).filter((F.col("before") <= budget) & (F.col("before") + F.col("load") > budget)).first()
    taken_here = F.lit(True)
    if at is not None:
        own = line.filter(F.col("span") == at["span"]).withColumn("total", at["before"] + F.sum("size").over(Window.partitionBy("span").orderBy("place")))
        last = own.filter(F.col("total") <= budget).agg(F.max("place").alias("place")).first()["place"]
        if last is None:
            taken_here = None
        else:
            edge = F.struct(F.lit(last["finish"]).alias("finish"), F.lit(last["none"]).alias("none"), F.lit(last["source"]).alias("source"), F.lit(last["shuffle"]).alias("shuffle"), F.lit(last["doc_id"]).cast(docs.schema["doc_id"].dataType).alias("doc_id"), F.lit(last["text_md5"]).alias("text_md5"), F.lit(last["epoch"]).alias("epoch"))

    def is_in(epoch: Column) -> Column:
        here = finish(epoch)
        if at is None:
            return here.isNotNull()
        early = F.floor(here * ranges).cast("long") < at["span"]
        return F.coalesce(early if taken_here is None else early | (place(epoch) <= edge), F.lit(False)) & here.isNotNull()

    copies = F.size(F.filter(epochs, is_in))
    out = queued.withColumn("copies", copies).withColumn("taken", F.col("copies") * F.col("size"))
    drop(slim)
    return out.select("doc_id", "source", "text_md5", "size", "source_size", "target", "copies", F.col("taken").cast("long").alias("taken"))


def take_mixed(docs: DataFrame) -> DataFrame:
    """The mixture: each document as often as it is taken, columns as they are."""
    n, md5, p_id, p_md5, p_nth, p_copies, p_epoch = fresh(["nth", "text_md5", "plan_id", "plan_md5", "plan_nth", "plan_copies", "plan_epoch"], docs.columns)
    plan = mix(docs).filter(F.col("copies") > 0)
    plan = plan.withColumn("nth", F.row_number().over(Window.partitionBy(*IDENTITY).orderBy(F.desc("copies"))))
    plan = plan.select(F.col("doc_id").alias(p_id), F.col("text_md5").alias(p_md5), F.col("nth").alias(p_nth), F.col("copies").alias(p_copies))
    rows = docs.withColumn(md5, text_md5(F.col("text")))
    rows = rows.withColumn(n, F.row_number().over(Window.partitionBy("doc_id", md5).orderBy(md5)))
    on = F.col("doc_id").eqNullSafe(F.col(p_id)) & (F.col(md5) == F.col(p_md5)) & (F.col(n) == F.col(p_nth))
    out = rows.join(plan, on).withColumn(p_epoch, F.explode(F.sequence(F.lit(1), F.col(p_copies))))
    return out.select(*(F.col(f"`{c}`") for c in docs.columns))


def op7_mixing(spark, sf_dir: str) -> DataFrame:
    out = mix(spark.read.parquet(f"{sf_dir}/documents.parquet"))
    return out.select("doc_id", "size", "source_size", "target", "taken", "copies")


def oracle_sql() -> str:
    weight = "CASE (row_number() OVER (ORDER BY source IS NULL, encode(source)) - 1) % 3 " + " ".join(f"WHEN {i} THEN {w}.0::DOUBLE" for i, w in enumerate(WEIGHTS)) + " END"
    return f"""
WITH d AS (SELECT doc_id, source, len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+'))::BIGINT AS size,
  md5(coalesce(text, '')) AS h, md5('{SEED}:' || coalesce(doc_id::VARCHAR, 'null') || ':' || md5(coalesce(text, ''))) AS shuffle FROM documents),
s AS (SELECT source, sum(size)::BIGINT AS source_size FROM d GROUP BY source),
w AS (SELECT *, {weight} AS weight FROM s),
r AS (SELECT *, (source_size * {EPOCHS})::DOUBLE AS cap, (source_size * {EPOCHS})::DOUBLE / weight AS ratio,
  (sum(source_size) OVER ())::DOUBLE * {BUDGET_SHARE}::DOUBLE AS budget FROM w),
l AS (SELECT *, (budget - coalesce(sum(cap) OVER p, 0)) / (sum(weight) OVER () - coalesce(sum(weight) OVER p, 0)) AS share FROM r
  WINDOW p AS (ORDER BY ratio, source IS NULL, encode(source) ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
t AS (SELECT source, source_size, budget, coalesce(least(cap, max(CASE WHEN ratio > share THEN share END) OVER () * weight), cap) AS target FROM l),
q AS (SELECT d.*, t.source_size, t.target, t.budget, sum(size) OVER (PARTITION BY d.source ORDER BY shuffle, d.doc_id, h ROWS UNBOUNDED PRECEDING) AS upto
  FROM d JOIN t ON d.source IS NOT DISTINCT FROM t.source),
c AS (SELECT q.*, epoch, (upto + epoch * source_size)::DOUBLE / target AS finish FROM q, (SELECT unnest(range({EPOCHS})) AS epoch) WHERE size > 0),
g AS (SELECT *, sum(size) OVER (ORDER BY finish, source IS NULL, encode(coalesce(source, '')), shuffle, doc_id, h, epoch) AS total FROM c),
n AS (SELECT doc_id, h, count(*) AS copies FROM g WHERE total <= round(budget) GROUP BY doc_id, h)
SELECT q.doc_id, q.size, q.source_size::BIGINT AS source_size, q.target, (coalesce(n.copies, 0) * q.size)::BIGINT AS taken, coalesce(n.copies, 0)::INTEGER AS copies
FROM q LEFT JOIN n ON q.doc_id = n.doc_id AND q.h = n.h"""
