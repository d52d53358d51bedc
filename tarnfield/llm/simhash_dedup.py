"""SimHash near-dedup with covering locality-sensitive hashing.

Fingerprints link where they differ in RADIUS bits or fewer. Positions of the 64
bits are mapped to non-zero vectors of RADIUS + 1 bits; each non-zero vector v
gives a mask of the positions whose vector has an odd product with v. For any
RADIUS positions some v is orthogonal to all of them, so two fingerprints that
differ only there agree under v's mask: every pair within the radius meets in
one of the 2^(RADIUS+1) - 1 tables, with certainty.

Equal fingerprints are one node from the start, so copies cost nothing after the
scan. Buckets are walked in sorted order; a bucket emits the spanning stars of
its own components, never its pairs. A bucket of more than LARGE fingerprints is
not compared as it is: the same masks, laid over the bits that its own mask leaves
free, deal it into smaller buckets in which its pairs meet again, and what is still
large then is cut into sub-blocks whose pairs are dealt over the tasks. Components
over all buckets come from alternating large-star and small-star steps, which are
grouped minima and joins.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tarnfield.llm.tables import drop, fresh, materialise, shuffle_partitions
from tarnfield.llm.text import ASCII_LOWER, as_bytes

SHINGLE_WORDS, SEED, RADIUS = 3, 42, 3
#: Shingles hashed at once; a longer text is summed in pieces.
PIECE = 1 << 16
#: Rows of a bucket that are compared with the rest at once.
BLOCK = 256
#: Fingerprints that a bucket, and later a sub-block of one, has at most when it is
#: compared, and overfull buckets that may be broadcast (at some 40 bytes each, 4 MB).
LARGE, BROADCAST_BUCKETS = 4096, 100_000
SALTS = 64
_UINT64 = (1 << 64) - 1


def fingerprint(raw: bytes | None) -> int:
    """64-bit SimHash: a bit is set where over half of the shingles' XXH64 have it."""
    words = (raw or b"").translate(ASCII_LOWER).split()
    if not words:
        return 0
    joined, ends, at = b" ".join(words), [], -1
    for w in words:
        at += len(w) + 1
        ends.append(at)
    if len(words) <= SHINGLE_WORDS:
        spans = [(0, at)]
    else:
        starts = [0, *(e + 1 for e in ends[: -SHINGLE_WORDS])]
        spans = list(zip(starts, ends[SHINGLE_WORDS - 1 :]))
    digest = xxhash.xxh64_intdigest
    ones = np.zeros(64, np.int64)
    for p in range(0, len(spans), PIECE):
        h = np.array([digest(joined[a:b], SEED) for a, b in spans[p : p + PIECE]], "<u8")
        ones += np.unpackbits(h.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(sum(1 << int(b) for b in np.nonzero(2 * ones > len(spans))[0]))


def fingerprints(docs: DataFrame, keep: list[str], text_col: str, out: str) -> DataFrame:
    """``keep`` columns and the fingerprint of the text as a signed long."""
    at = len(keep)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            fps = np.array([fingerprint(raw) for raw in as_bytes(batch.column(at))], np.uint64).view(np.int64)
            yield pa.RecordBatch.from_arrays([*batch.columns[:at], pa.array(fps)], names=[*keep, out])

    kinds = ", ".join([*(f"`{c}` {docs.schema[c].dataType.simpleString()}" for c in keep), f"`{out}` long"])
    return docs.select(*(F.col(f"`{c}`") for c in keep), F.col(f"`{text_col}`").alias(fresh(["text_in"], [*keep, out])[0])).mapInArrow(run, kinds)


def covering_masks(radius: int = RADIUS, bits: int = 64) -> list[int]:
    """One mask for each non-zero v of radius + 1 bits; positions take the non-zero vectors in turn."""
    vectors = 1 << (radius + 1)
    return [sum(1 << i for i in range(bits) if ((i % (vectors - 1) + 1) & v).bit_count() & 1) for v in range(1, vectors)]


def components(n: int, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Least reachable index of each of n nodes over the edges a-b."""
    label = np.arange(n)
    while len(a):
        low = np.minimum(label[a], label[b])
        new = label.copy()
        np.minimum.at(new, label[a], low)
        np.minimum.at(new, label[b], low)
        new = new[new]
        if np.array_equal(new, label):
            break
        label = new
        a, b = label[a], label[b]
        left = a != b
        a, b = a[left], b[left]
    while True:
        new = label[label]
        if np.array_equal(new, label):
            return label
        label = new


def bucket_stars(fps: np.ndarray, radius: int) -> tuple[np.ndarray, np.ndarray]:
    """Links (member, least member) of the components inside one bucket.

    Blocks are compared with all behind them; only the block's own union of links is kept."""
    n = len(fps)
    label = np.arange(n)
    for p in range(0, n, BLOCK):
        near = np.bitwise_count(fps[p : p + BLOCK, None] ^ fps[None, p:]) <= radius
        i, j = np.nonzero(near)
        i, j = i + p, j + p
        later = i < j
        i, j = label[i[later]], label[j[later]]
        apart = i != j
        if apart.any():
            label = components(n, i[apart], j[apart])[label]
    order = np.full(n, np.iinfo(np.int64).max)
    signed = fps.view(np.int64)
    np.minimum.at(order, label, signed)
    root = order[label]
    own = root != signed
    return signed[own], root[own]


def nested_masks(radius: int = RADIUS) -> list[int]:
    """For each covering mask all covering masks of the bits that it leaves free."""
    out = []
    for m in covering_masks(radius):
        free = [i for i in range(64) if not m >> i & 1]
        out += [sum(1 << free[i] for i in range(len(free)) if own >> i & 1) for own in covering_masks(radius, len(free))]
    return out


def _signed(masks: list[int]) -> list[int]:
    return [m - (1 << 64) if m >> 63 else m for m in masks]


#: What names a bucket: its table and masked bits, and those of the level below (or -1, 0).
_BUCKET = ("t", "key", "t2", "key2")


def _walk(rows: DataFrame, radius: int) -> DataFrame:
    """Rows (u, v, n) of the buckets: links with n = 0, and for an overfull bucket one
    row with its _BUCKET and n, the number of its fingerprints; of those only counts are held."""
    names = [*_BUCKET, "u", "v", "n"]
    rows = rows.repartition(shuffle_partitions(rows.sparkSession), *_BUCKET).sortWithinPartitions(*_BUCKET)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[np.ndarray] = []
        beyond = 0  # rows of the open bucket that were let go

        def found(u: np.ndarray, v: np.ndarray, over: list[tuple]) -> pa.RecordBatch:
            keys = np.concatenate((np.zeros((len(u), 4), np.int64), np.array([o[:4] for o in over], np.int64).reshape(-1, 4)))
            u, v = (np.concatenate((x, np.zeros(len(over), np.int64))) for x in (u, v))
            n = np.concatenate((np.zeros(len(u) - len(over), np.int64), np.array([o[4] for o in over], np.int64)))
            return pa.RecordBatch.from_arrays([*(pa.array(keys[:, k]) for k in range(4)), pa.array(u), pa.array(v), pa.array(n)], names=names)

        def whole(table: np.ndarray) -> pa.RecordBatch:
            """All buckets of a sorted piece: small ones by shifted comparison at once, others block by block."""
            fp = np.ascontiguousarray(table[4]).view(np.uint64)
            begin = np.nonzero(np.concatenate(([True], (table[:4, 1:] != table[:4, :-1]).any(axis=0))))[0]
            count = np.diff(np.append(begin, len(fp)))
            us, vs, over = [], [], []
            pair = begin[count == 2]
            if len(pair):
                x, y = fp[pair].view(np.int64), fp[pair + 1].view(np.int64)
                near = np.bitwise_count(fp[pair] ^ fp[pair + 1]) <= radius
                us.append(np.maximum(x, y)[near])
                vs.append(np.minimum(x, y)[near])
            for b, c in zip(begin[count > 2].tolist(), count[count > 2].tolist()):
                if c > LARGE:
                    over.append((*table[:4, b].tolist(), c))
                    continue
                u, v = bucket_stars(np.ascontiguousarray(fp[b : b + c]), radius)
                us.append(u)
                vs.append(v)
            u, v = (np.concatenate(x) if x else np.zeros(0, np.int64) for x in (us, vs))
            return found(u, v, over)

        def close() -> Iterator[pa.RecordBatch]:
            nonlocal held, beyond
            if held:
                table = np.concatenate(held, axis=1)
                if beyond:
                    yield found(np.zeros(0, np.int64), np.zeros(0, np.int64), [(*table[:4, 0].tolist(), beyond + table.shape[1])])
                else:
                    yield whole(table)
            held, beyond = [], 0

        for batch in batches:
            if not batch.num_rows:
                continue
            table = np.stack([batch.column(k).to_numpy(zero_copy_only=False).astype(np.int64) for k in range(5)])
            last = int(np.argmax((table[:4] == table[:4, -1:]).all(axis=0)))  # where the last bucket begins
            if held and (held[0][:4, 0] == table[:4, 0]).all():  # the open bucket goes on
                first = int(np.argmin(np.append((table[:4] == table[:4, :1]).all(axis=0), False)))
                held.append(table[:, :first])
                if beyond + sum(h.shape[1] for h in held) > LARGE:
                    beyond += sum(h.shape[1] for h in held[1:])
                    del held[1:]
                if first == table.shape[1]:
                    continue
                table, last = table[:, first:], last - first
            yield from close()
            if last:
                yield whole(table[:, :last])
            held = [table[:, last:]]
        yield from close()

    return rows.mapInArrow(run, "t long, key long, t2 long, key2 long, u long, v long, n long")


def _of_buckets(rows: DataFrame, over: DataFrame, few: bool) -> DataFrame:
    """The rows of the overfull buckets, with n. Few buckets are broadcast; of many
    both sides are salted, so that no bucket meets one task."""
    over = over.select(*(F.col(c).alias(f"o_{c}") for c in _BUCKET), "n")
    on = [F.col(c) == F.col(f"o_{c}") for c in _BUCKET]
    if few:
        over = F.broadcast(over)
    else:
        rows = rows.withColumn("salt", F.pmod(F.xxhash64("fp"), F.lit(SALTS)))
        over = over.withColumn("o_salt", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(SALTS - 1).cast("long"))))
        on.append(F.col("salt") == F.col("o_salt"))
    return rows.join(over, on).select(*_BUCKET, "fp", "n")


def _by_sub_blocks(rows: DataFrame, radius: int) -> DataFrame:
    """(u, v) of overfull buckets: a hash deals each into sub-blocks, and every pair of these is a row."""
    parts = F.ceil(F.col("n") / (LARGE / 2)).cast("long")
    packed = rows.withColumn("parts", parts).withColumn("part", F.pmod(F.xxhash64("fp", F.lit("part")), F.col("parts")))
    packed = materialise(packed.groupBy(*_BUCKET, "parts", "part").agg(F.collect_list("fp").alias("fps")))
    left = packed.withColumn("other", F.explode(F.sequence(F.col("part"), F.col("parts") - 1)))
    right = packed.select(*(F.col(c).alias(f"r_{c}") for c in _BUCKET), F.col("part").alias("r_part"), F.col("fps").alias("r_fps"))
    pairs = left.join(right, [*(F.col(c) == F.col(f"r_{c}") for c in _BUCKET), F.col("other") == F.col("r_part")]).select("fps", "r_fps")

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for k in range(batch.num_rows):
                fps = np.unique(np.concatenate([batch.column(c)[k].values.to_numpy() for c in range(2)]))
                u, v = bucket_stars(fps.view(np.uint64), radius)
                yield pa.RecordBatch.from_arrays([pa.array(u), pa.array(v)], names=["u", "v"])

    return pairs.repartition(shuffle_partitions(rows.sparkSession)).mapInArrow(compare, "u long, v long")


def links(nodes: DataFrame, radius: int = RADIUS) -> DataFrame:
    """Edges (u, v), u > v, that connect whatever links within the radius. ``nodes`` has distinct fp."""
    none = [F.lit(-1).cast("long").alias("t2"), F.lit(0).cast("long").alias("key2")]
    keys = [F.struct(F.lit(t).cast("long").alias("t"), F.col("fp").bitwiseAND(F.lit(m)).alias("key")) for t, m in enumerate(_signed(covering_masks(radius)))]
    rows = nodes.select(F.explode(F.array(*keys)).alias("k"), "fp").select("k.t", "k.key", *none, "fp")
    walked = materialise(_walk(rows, radius))
    out, over = walked.filter("n = 0").select("u", "v"), walked.filter("n > 0")
    if n_over := over.count():
        n_masks = (1 << (radius + 1)) - 1
        inner = F.array(*(F.lit(m) for m in _signed(nested_masks(radius))))
        deep = _of_buckets(rows, over, n_over <= BROADCAST_BUCKETS)
        deep = deep.select("t", "key", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(n_masks - 1).cast("long"))).alias("t2"), "fp")
        deep = deep.withColumn("key2", F.col("fp").bitwiseAND(F.element_at(inner, (F.col("t") * n_masks + F.col("t2") + 1).cast("int")))).select(*_BUCKET, "fp")
        walked = materialise(_walk(deep, radius))
        out, over = out.unionByName(walked.filter("n = 0").select("u", "v")), walked.filter("n > 0")
        if n_over := over.count():
            out = out.unionByName(_by_sub_blocks(_of_buckets(deep, over, n_over <= BROADCAST_BUCKETS), radius))
    return out.distinct()


def least_reachable(edges: DataFrame) -> DataFrame:
    """(u, v) with v the least node reachable from u, for every u that is not it.

    Large-star: each node's greater neighbours link to the least of its
    neighbourhood; small-star: each node and its lesser neighbours do. Stars of
    stars halve until nothing changes. A hub's edges are a skewed join's, which
    adaptive execution splits; its minimum is combined before the exchange.
    """
    edges = materialise(edges)
    while True:
        both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.least(F.min("v"), F.first("u")).alias("m"))
        large = edges.join(least.withColumnRenamed("u", "w"), F.col("v") == F.col("w")).select("u", F.col("m").alias("v"))
        large = materialise(large.filter("u != v").distinct())
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(least.withColumnRenamed("u", "w"), F.col("u") == F.col("w"))
        small = small.select(F.explode(F.array(F.struct(F.col("u"), F.col("m").alias("v")), F.struct(F.col("v").alias("u"), F.col("m").alias("v")))).alias("e")).select("e.u", "e.v")
        small = materialise(small.filter("u != v").distinct())
        # stars: nobody is both a member and a centre, and each member has one centre
        members = small.groupBy("u").agg(F.count(F.lit(1)).alias("n"))
        loose = members.filter("n > 1").select("u").unionByName(members.select("u").join(small.select(F.col("v").alias("u")).distinct(), "u", "left_semi")).limit(1).count()
        drop(edges)
        drop(large)
        edges = small
        if not loose:
            return edges


def class_components(fps: DataFrame, radius: int = RADIUS) -> DataFrame:
    """(fp, root, component_id): root is the component's least fingerprint, component_id
    the least doc_id of all whose fingerprints are connected. ``fps`` has doc_id and fp."""
    nodes = materialise(fps.groupBy("fp").agg(F.min("doc_id").alias("least_id")))
    stars = least_reachable(links(nodes, radius))
    root = nodes.join(stars.select(F.col("u").alias("fp"), "v"), "fp", "left").select("fp", "least_id", F.coalesce("v", "fp").alias("root"))
    least = root.groupBy("root").agg(F.min("least_id").alias("component_id"))
    return root.join(least, "root").select("fp", "root", "component_id")


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", radius: int = RADIUS) -> DataFrame:
    """One row per document: id, fingerprint (16 hex digits), component_id.

    A null text or one without words has fingerprint 0 and links like any other.
    Rows with the same id stand for themselves; null ids take part but name no
    component (one of null ids only has a null component_id). Empty table: empty
    result; other columns are ignored. Fingerprints are compared in full, no bucket is
    capped. A very long text is hashed in pieces and costs its length.
    """
    fps = materialise(fingerprints(docs, [id_col], text_col, "fp").withColumnRenamed(id_col, "doc_id"))
    found = class_components(fps, radius).select(F.col("fp").alias("_fp"), "component_id")
    out = fps.join(found, F.col("fp") == F.col("_fp"))
    return out.select(F.col("doc_id").alias(id_col), F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def keep_first(docs: DataFrame) -> DataFrame:
    """One document of each component, columns as they are: its least doc_id (null
    last), of rows with equal ids the least MD5 of the text, of equal rows one.

    Only ids and digests are sorted out; the texts meet the rows that stay once."""
    md5, stay_id, stay_md5, nth = fresh(["text_md5", "stay_id", "stay_md5", "nth"], docs.columns)
    own_md5 = F.md5(F.coalesce(F.col("text"), F.lit("")))
    slim = materialise(fingerprints(docs.select("doc_id", own_md5.alias("digest"), "text"), ["doc_id", "digest"], "text", "fp"))
    found = class_components(slim).select(F.col("fp").alias("_fp"), "root")
    place = F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "digest")
    stay = slim.join(found, F.col("fp") == F.col("_fp")).groupBy("root").agg(F.min(place).alias("p"))
    stay = stay.select(F.col("p.doc_id").alias(stay_id), F.col("p.digest").alias(stay_md5))
    rows = docs.withColumn(md5, own_md5)
    rows = rows.join(stay, F.col("doc_id").eqNullSafe(F.col(stay_id)) & (F.col(md5) == F.col(stay_md5)), "left_semi")
    if slim.groupBy("doc_id", "digest").agg(F.count(F.lit(1)).alias("n")).filter("n > 1").limit(1).count():
        rows = rows.withColumn(nth, F.row_number().over(Window.partitionBy("doc_id", md5).orderBy(md5))).filter(F.col(nth) == 1)
    return rows.select(*(F.col(f"`{c}`") for c in docs.columns))


def op10_simhash_dedup(spark, sf_dir: str) -> DataFrame:
    return near_duplicates(spark.read.parquet(f"{sf_dir}/documents.parquet"))
