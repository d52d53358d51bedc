"""Sharding by sampled splitters, with built-in functions only.

Records are keyed by (md5 of the text, doc_id): the hash spreads texts evenly,
equal texts stand together, and the id cuts through a group of copies that is
larger than a shard. A size-weighted sample of keys gives quantile boundaries and
with them ranges; ranges that turn out overfull are subdivided by boundaries from
samples of their own. Sums of the ranges give each range's offset in bytes and
rows, a window within each range the rest, so every record's place in the whole
order is known; shards are equal shares of the total bytes.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tarnfield.llm.tables import drop, materialise

SHARDS = 24
#: Bytes a record takes besides its text.
OVERHEAD = 8
#: Rows a range should hold.
RANGE_ROWS = 1024
#: Most ranges of the first and, within each of those, of the second level.
FIRST, SECOND = 384, 256
#: Sampled keys for each boundary.
OVERSAMPLE = 16


def _chance(*cols: Column) -> Column:
    """A number in [0, 1) from a hash."""
    return F.xxhash64(*cols).bitwiseAND(F.lit((1 << 52) - 1)).cast("double") / float(1 << 52)


def _every(keys: Column, nth: int) -> Column:
    """Each nth of the sorted keys: the quantile boundaries."""
    return F.filter(F.sort_array(keys), lambda _, i: (i + 1) % nth == 0)


def _behind(bounds: Column, key: Column) -> Column:
    """How many boundaries a key has reached."""
    return F.size(F.filter(bounds, lambda b: b <= key)).cast("int")


def place(docs: DataFrame, shards: int = SHARDS) -> DataFrame:
    """One row per document: doc_id, size, text_crc32, law, shard, slot, grown_shard.

    ``size`` counts the text's UTF-8 bytes (null: none) and OVERHEAD. Shards hold
    equal shares of all bytes, to within a record; slots number a shard's records
    in key order without gaps. Rows equal in id and text are interchangeable, a
    null id sorts first, an empty table gives an empty result.
    """
    text = F.coalesce(F.col("text"), F.lit(""))
    key = F.struct(F.md5(text).alias("h"), F.coalesce(F.col("doc_id").cast("long"), F.lit(-(1 << 63))).alias("id"))
    slim = materialise(docs.select("doc_id", (F.octet_length(text) + OVERHEAD).cast("long").alias("size"), F.crc32(text).alias("text_crc32"), key.alias("key")))
    n_rows, total = slim.agg(F.count(F.lit(1)), F.coalesce(F.sum("size"), F.lit(0))).first()
    first = max(1, min(FIRST, -(-n_rows // RANGE_ROWS)))

    # first level: one bounded sample of the whole table
    drawn = slim.filter(F.col("size") * (first * OVERSAMPLE / max(total, 1)) > _chance("key.h", "key.id"))
    bounds = drawn.agg(_every(F.collect_list("key"), OVERSAMPLE).alias("b")).first()["b"]
    literal = F.array(*(F.struct(F.lit(b["h"]).alias("h"), F.lit(b["id"]).cast("long").alias("id")) for b in bounds))
    ranged = slim.withColumn("r1", _behind(literal, F.col("key")) if bounds else F.lit(0))

    # second level: overfull ranges get boundaries of their own; FIRST rows of at most SECOND keys
    loads = ranged.groupBy("r1").agg(F.count(F.lit(1)).alias("n"), F.sum("size").alias("bytes")).filter(F.col("n") > 2 * RANGE_ROWS)
    loads = loads.select(F.col("r1").alias("_r"), (F.least(F.lit(SECOND), F.ceil(F.col("n") / RANGE_ROWS)) * OVERSAMPLE / F.col("bytes")).alias("rate"))
    inner = ranged.join(F.broadcast(loads), F.col("r1") == F.col("_r")).filter(F.col("size") * F.col("rate") > _chance("key.id", "key.h"))
    inner = inner.groupBy("_r").agg(_every(F.collect_list("key"), OVERSAMPLE).alias("cuts"))
    ranged = ranged.join(F.broadcast(inner), F.col("r1") == F.col("_r"), "left").withColumn("r2", F.coalesce(_behind(F.col("cuts"), F.col("key")), F.lit(0))).drop("_r", "cuts")

    # offsets: of the first level's ranges, then of theirs
    spans = ranged.groupBy("r1", "r2").agg(F.count(F.lit(1)).alias("n"), F.sum("size").alias("bytes"))
    outer = Window.partitionBy(F.lit(0)).orderBy("r1").rowsBetween(Window.unboundedPreceding, -1)
    inside = Window.partitionBy("r1").orderBy("r2").rowsBetween(Window.unboundedPreceding, -1)
    tops = spans.groupBy("r1").agg(F.sum("n").alias("n"), F.sum("bytes").alias("bytes"))
    tops = tops.select("r1", F.coalesce(F.sum("n").over(outer), F.lit(0)).alias("n0"), F.coalesce(F.sum("bytes").over(outer), F.lit(0)).alias("bytes0"))
    offsets = spans.select("r1", "r2", F.coalesce(F.sum("n").over(inside), F.lit(0)).alias("n1"), F.coalesce(F.sum("bytes").over(inside), F.lit(0)).alias("bytes1"))

    within = Window.partitionBy("r1", "r2").orderBy("key")
    upto = within.rowsBetween(Window.unboundedPreceding, 0)
    rows = ranged.withColumns({"nth": F.row_number().over(within) - 1, "upto": F.sum("size").over(upto)})
    rows = rows.join(offsets, ["r1", "r2"]).join(F.broadcast(tops), "r1")
    middle = F.col("bytes0") + F.col("bytes1") + F.col("upto") - F.col("size") + F.floor(F.col("size") / 2)
    rows = rows.select("doc_id", "size", "text_crc32", (F.col("n0") + F.col("n1") + F.col("nth")).alias("nth"), F.least(F.floor(middle * shards / F.lit(max(total, 1))), F.lit(shards - 1)).cast("int").alias("shard"))
    rows = materialise(rows)
    drop(slim)
    starts = rows.groupBy("shard").agg(F.min("nth").alias("_start"))
    out = rows.join(F.broadcast(starts), "shard")
    return out.select("doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", (F.col("nth") - F.col("_start")).alias("slot"), F.lit(None).cast("int").alias("grown_shard"))


def op4_sharding(spark, sf_dir: str) -> DataFrame:
    return place(spark.read.parquet(f"{sf_dir}/documents.parquet"))


def oracle_sql() -> str:
    """The CRC is computed bit by bit over the bytes; its reversed polynomial is 0xEDB88320."""
    step = "CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END"
    table = "list_transform(range(256), lambda i: list_reduce(list_prepend(i::BIGINT, range(8)), lambda c, _: " + step + "))"
    return f"""
WITH t AS (SELECT {table} AS crc),
d AS (SELECT doc_id, (octet_length(encode(coalesce(text, ''))) + {OVERHEAD})::BIGINT AS size, md5(coalesce(text, '')) AS h, hex(encode(coalesce(text, ''))) AS x FROM documents),
b AS (SELECT d.*, xor(list_reduce(list_prepend(4294967295::BIGINT, list_transform(range(length(x) // 2), lambda i: ('0x' || substr(x, 2 * i + 1, 2))::BIGINT)),
  lambda c, y: xor(c >> 8, crc[(xor(c, y) & 255) + 1])), 4294967295) AS text_crc32 FROM d, t),
o AS (SELECT *, row_number() OVER w - 1 AS nth, sum(size) OVER w - size + size // 2 AS middle, sum(size) OVER () AS total FROM b WINDOW w AS (ORDER BY h, doc_id NULLS FIRST ROWS UNBOUNDED PRECEDING)),
s AS (SELECT *, least(middle * {SHARDS} // total, {SHARDS - 1})::INTEGER AS shard FROM o)
SELECT doc_id, size, text_crc32::BIGINT AS text_crc32, 'bytes' AS law, shard, (nth - min(nth) OVER (PARTITION BY shard))::BIGINT AS slot, NULL::INTEGER AS grown_shard FROM s"""
