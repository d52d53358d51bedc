"""A Merkle manifest of a dataset, by reduction of superblocks.

Every row is a leaf, the SHA-256 of its columns. The leaves of a source, in order of
their ids, make a tree of fanout FANOUT, and the sources' roots another on top of them.
A node's hash is that of its children's hashes, written as hex text one after another.

1. Leaves are sorted by ranges; a leaf's index within its source is its place in the
   range plus the counts of the ranges before, so a source may be spread over all tasks.
2. Indices are bucketed by FANOUT^LEVELS. One task collapses a bucket by LEVELS levels to
   its root; the bucket roots are bucketed in turn, until each tree has one node left.
3. Downwards each bucket gets the proof of its root and hangs it behind those that lead
   from its nodes to that root. Only at the bottom a proof exists for each row, and there
   it is folded at once; it never goes through a shuffle.
"""

from __future__ import annotations

import hashlib

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tarnfield.llm.tables import drop, materialise, shuffle_partitions

FANOUT, LEVELS = 3, 6
COLUMNS = ("doc_id", "source", "lang", "n_chars", "text")
#: monotonically_increasing_id has the row's place in the low bits, its partition above.
_PLACE_BITS = 33


def leaf(columns: list[Column]) -> Column:
    """SHA-256 over the columns: ``-`` for null, else the UTF-8 byte count, ``:`` and the value."""
    text = [c.cast("string") for c in columns]
    return F.sha2(F.concat(*(F.coalesce(F.concat(F.octet_length(t).cast("string"), F.lit(":"), t), F.lit("-")) for t in text)), 256)


def levels_over(n: int) -> int:
    """Levels from n nodes up to a single one."""
    up = 0
    while n > 1:
        n, up = -(-n // FANOUT), up + 1
    return up


def parents(hashes: list[str]) -> list[str]:
    return [hashlib.sha256("".join(hashes[k : k + FANOUT]).encode()).hexdigest() for k in range(0, len(hashes), FANOUT)]


def siblings(hashes: list[str], levels: int) -> tuple[list[list[str]], list[list[str]]]:
    """For each node, level by level, its siblings on the left and on the right, joined."""
    n = len(hashes)
    left: list[list[str]] = [[] for _ in range(n)]
    right: list[list[str]] = [[] for _ in range(n)]
    width = 1  # nodes of the bucket below one of the present level
    for _ in range(levels):
        for k in range(len(hashes)):
            run = k - k % FANOUT
            before, behind = "".join(hashes[run:k]), "".join(hashes[k + 1 : run + FANOUT])
            for own in range(k * width, min((k + 1) * width, n)):
                left[own].append(before)
                right[own].append(behind)
        hashes, width = parents(hashes), width * FANOUT
    return left, right


def indexed(rows: DataFrame, group: str | None, order: list[str]) -> DataFrame:
    """``rows``, written, with idx, the place in its group (or among all) by ``order``, and n, the group's size.

    Ranges share the work; rows that are equal in ``order`` are kept apart by their
    place in the files, so that one of them in very many copies is spread as well."""
    spark = rows.sparkSession
    keys = ([F.col(group).asc_nulls_first()] if group else []) + [F.col(c).asc_nulls_first() for c in order] + [F.col("file_place")]
    rows = rows.withColumn("file_place", F.monotonically_increasing_id())
    rows = rows.repartitionByRange(shuffle_partitions(spark), *keys).sortWithinPartitions(*keys).drop("file_place")
    rows = materialise(rows.withColumn("seq", F.monotonically_increasing_id())).withColumn("range", F.shiftright("seq", _PLACE_BITS))
    own = [F.col(group).alias("own_group")] if group else [F.lit(0).alias("own_group")]
    spans = rows.groupBy(*own, F.col("range").alias("own_range")).agg(F.min("seq").alias("first"), F.count(F.lit(1)).alias("rows_here"))
    by_group = Window.partitionBy("own_group")  # a group has as many spans as it has ranges
    before = F.coalesce(F.sum("rows_here").over(by_group.orderBy("own_range").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    spans = spans.select("own_group", "own_range", (before - F.col("first")).alias("shift"), F.sum("rows_here").over(by_group).alias("n"))
    on = F.col("range") == F.col("own_range")
    if group:
        on = on & F.col(group).eqNullSafe(F.col("own_group"))
    return rows.join(spans, on).withColumn("idx", F.col("seq") + F.col("shift")).drop("seq", "range", "own_group", "own_range", "shift")


def _bucket(levels: int) -> Column:
    return F.floor(F.col("idx") / F.lit(FANOUT**levels)).cast("long").alias("bucket")


def climb(nodes: DataFrame, levels: int = LEVELS) -> list[DataFrame]:
    """``nodes`` (tree, idx, n, hash), their bucket roots, those of these, and so on to the trees' roots."""

    def collapse(part: pd.DataFrame) -> pd.DataFrame:
        n, hashes = int(part["n"].iloc[0]), part.sort_values("idx")["hash"].tolist()
        up = min(levels, levels_over(n))
        for _ in range(up):
            hashes = parents(hashes)
            n = -(-n // FANOUT)
        return pd.DataFrame({"tree": part["tree"].iloc[:1], "idx": [int(part["idx"].iloc[0]) // FANOUT**levels], "n": [n], "hash": hashes})

    chain = [nodes]
    while True:
        slim = chain[-1].select("tree", "idx", "n", "hash")
        chain.append(materialise(slim.groupBy("tree", _bucket(levels)).applyInPandas(collapse, "tree long, idx long, n long, hash string")))
        if (chain[-1].agg(F.max("n")).first()[0] or 1) == 1:
            return chain


def descend(chain: list[DataFrame], tops: DataFrame, levels: int = LEVELS) -> DataFrame:
    """The chain's first table with left and right, the siblings of each level from there to
    the root, and what else ``tops`` (tree, idx, left, right, ...) has for each tree's root."""
    more = [c for c in tops.columns if c not in ("tree", "idx", "left", "right")]

    def hang(part: pd.DataFrame, above: pd.DataFrame) -> pd.DataFrame:
        part = part.sort_values("idx").reset_index(drop=True)
        left, right = siblings(part["hash"].tolist(), min(levels, levels_over(int(part["n"].iloc[0]))))
        upper = above.iloc[0]
        over_left, over_right = list(upper["left"]), list(upper["right"])
        part = part.drop(columns="bucket")
        part["left"] = [x + over_left for x in left]
        part["right"] = [x + over_right for x in right]
        return part.assign(**{c: upper[c] for c in more})

    proofs = tops
    for nodes in reversed(chain[:-1]):
        kinds = ", ".join([*(f"{f.name} {f.dataType.simpleString()}" for f in nodes.schema), "left array<string>", "right array<string>", *(f"{c} {tops.schema[c].dataType.simpleString()}" for c in more)])
        below = nodes.withColumn("bucket", _bucket(levels)).groupBy("tree", "bucket")
        proofs = below.cogroup(proofs.withColumnRenamed("idx", "bucket").groupBy("tree", "bucket")).applyInPandas(hang, kinds)
    return proofs


def manifest(docs: DataFrame, columns: tuple[str, ...] = COLUMNS, id_col: str = "doc_id", group_col: str = "source", altered: dict[str, Column] | None = None, levels: int = LEVELS) -> DataFrame:
    """One row per document: id, leaf, subroot (its source's), root, proof_sha256,
    folded_root, verified.

    ``altered`` gives columns as they are found when the manifest is checked: folded_root
    leads from the leaf of these along the stored siblings. Nulls are values of their own
    (null sources are the first tree, null ids stand first in theirs); rows with the same
    id are ordered by leaf; equal rows are leaves of their own, which of them comes first
    makes no difference. A text of any length is one hash. Empty table: empty result. Only
    ``columns`` count; other columns are ignored, whatever their names."""
    columns_in = {c: F.col(f"`{c}`") for c in columns}
    found = columns_in | (altered or {})
    # ids go through pandas as text: a null would turn their longs into doubles
    rows = docs.select(F.col(f"`{id_col}`").alias("id"), F.col(f"`{group_col}`").alias("source"), leaf(list(columns_in.values())).alias("hash"), leaf(list(found.values())).alias("found"))
    # what is found as it was costs a null
    rows = materialise(rows.withColumn("found", F.when(F.col("found") != F.col("hash"), F.col("found"))))
    leaves = indexed(rows, "source", ["id", "hash"])
    groups = indexed(materialise(leaves.groupBy("source").agg(F.count(F.lit(1)).alias("leaves"))), None, ["source"])
    groups = materialise(groups.select(F.col("source").alias("of_source"), F.col("idx").alias("tree"), F.col("n").alias("trees")))
    leaves = materialise(leaves.join(groups, F.col("source").eqNullSafe(F.col("of_source"))).select("tree", "idx", "n", F.col("id").cast("string").alias("id"), "hash", "found"))
    drop(rows)

    chain = climb(leaves, levels)
    roots = chain[-1].select("tree", F.col("hash").alias("subroot"))
    top = climb(roots.join(groups, "tree").select(F.lit(0).cast("long").alias("tree"), F.col("tree").alias("idx"), F.col("trees").alias("n"), F.col("subroot").alias("hash")), levels)
    none = F.array().cast("array<string>")
    over = descend(top, top[-1].select("tree", "idx", none.alias("left"), none.alias("right"), F.col("hash").alias("root")), levels)
    tops = materialise(over.select(F.col("idx").alias("tree"), F.lit(0).cast("long").alias("idx"), "left", "right", "root", F.col("hash").alias("subroot")))
    out = descend(chain, tops, levels)

    steps = F.arrays_zip("left", "right")
    folded = F.aggregate(steps, F.coalesce("found", "hash"), lambda h, s: F.sha2(F.concat(s["left"], h, s["right"]), 256))
    proof = F.sha2(F.array_join(F.transform(steps, lambda s: F.concat(s["left"], s["right"])), ""), 256)
    out = out.select(F.col("id").cast(docs.schema[id_col].dataType).alias(id_col), F.col("hash").alias("leaf"), "subroot", "root", proof.alias("proof_sha256"), folded.alias("folded_root"))
    return out.withColumn("verified", F.col("folded_root") == F.col("root"))


def op12_merkle_manifest(spark, sf_dir: str) -> DataFrame:
    """Tampering takes the line ends out of the texts of half the documents (a null id counts as an empty string)."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    half = F.crc32(F.coalesce(F.col("doc_id").cast("string"), F.lit(""))) % 2 == 0
    return manifest(docs, altered={"text": F.when(half, F.translate("text", "\n", "")).otherwise(F.col("text"))})


def oracle_sql() -> str:
    """The same trees level by level; the CRC of the short ids is computed as in a table-driven loop over bytes."""
    step = "CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END"
    table = "list_transform(range(256), lambda i: list_reduce(list_prepend(i::BIGINT, range(8)), lambda c, _: " + step + "))"

    def field(c: str) -> str:
        return f"coalesce(strlen({c}::VARCHAR)::VARCHAR || ':' || {c}::VARCHAR, '-')"

    leaf_sql, found_sql = ("sha256(" + " || ".join(field(c) for c in (*COLUMNS[:-1], last)) + ")" for last in ("text", "tampered"))

    def climb_sql(key: str) -> str:
        return f"SELECT {key}, lvl + 1, idx // {FANOUT}, (n + {FANOUT - 1}) // {FANOUT}, sha256(string_agg(h, '' ORDER BY idx))"

    def sides(nodes: str, own: str, on: str) -> str:
        return f"""SELECT {own}, u.lvl, coalesce(string_agg(u.h, '' ORDER BY u.idx) FILTER (u.idx < d.idx // pow({FANOUT}, u.lvl)::BIGINT), '') AS l,
  coalesce(string_agg(u.h, '' ORDER BY u.idx) FILTER (u.idx > d.idx // pow({FANOUT}, u.lvl)::BIGINT), '') AS r
  FROM {nodes} ON {on} AND u.n > 1 AND u.idx // {FANOUT} = d.idx // pow({FANOUT}, u.lvl + 1)::BIGINT GROUP BY ALL"""

    return f"""
WITH RECURSIVE t AS (SELECT {table} AS crc),
c AS (SELECT *, hex(encode(coalesce(doc_id::VARCHAR, ''))) AS x FROM documents),
k AS (SELECT c.*, (xor(list_reduce(list_prepend(4294967295::BIGINT, list_transform(range(length(x) // 2), lambda i: ('0x' || substr(x, 2 * i + 1, 2))::BIGINT)),
  lambda a, y: xor(a >> 8, crc[(xor(a, y) & 255) + 1])), 4294967295) & 1) = 0 AS half FROM c, t),
a AS (SELECT *, CASE WHEN half THEN replace(text, chr(10), '') ELSE text END AS tampered FROM k),
b AS (SELECT doc_id, source, {leaf_sql} AS leaf, {found_sql} AS found FROM a),
g AS (SELECT source, dense_rank() OVER (ORDER BY encode(source) NULLS FIRST) - 1 AS tree FROM (SELECT DISTINCT source FROM b)),
d AS (SELECT b.doc_id, leaf, found, g.tree, row_number() OVER (PARTITION BY g.tree ORDER BY doc_id NULLS FIRST, leaf) - 1 AS idx, count(*) OVER (PARTITION BY g.tree) AS n FROM b JOIN g ON b.source IS NOT DISTINCT FROM g.source),
up AS (SELECT tree, 0 AS lvl, idx, n, leaf AS h FROM d UNION ALL {climb_sql("tree")} FROM up WHERE n > 1 GROUP BY tree, lvl, idx // {FANOUT}, n),
s AS (SELECT tree AS idx, h, count(*) OVER () AS n FROM up WHERE n = 1),
top AS (SELECT 0 AS one, 0 AS lvl, idx, n, h FROM s UNION ALL {climb_sql("one")} FROM top WHERE n > 1 GROUP BY one, lvl, idx // {FANOUT}, n),
lower_sides AS ({sides("d JOIN up u", "d.tree, d.idx", "u.tree = d.tree")}),
upper_sides AS ({sides("s d JOIN top u", "d.idx AS tree", "true")}),
every_side AS (SELECT tree, idx, lvl, l, r FROM lower_sides UNION ALL SELECT d.tree, d.idx, 1000 + u.lvl, u.l, u.r FROM d JOIN upper_sides u ON u.tree = d.tree),
p AS (SELECT tree, idx, list({{'l': l, 'r': r}} ORDER BY lvl) AS steps FROM every_side GROUP BY tree, idx),
f AS (SELECT d.doc_id, d.leaf, s.h AS subroot, (SELECT h FROM top WHERE n = 1) AS root, coalesce(p.steps, []) AS steps, d.found FROM d JOIN s ON s.idx = d.tree LEFT JOIN p ON p.tree = d.tree AND p.idx = d.idx),
e AS (SELECT doc_id, leaf, subroot, root, sha256(coalesce(array_to_string(list_transform(steps, lambda x: x.l || x.r), ''), '')) AS proof_sha256,
  (list_reduce(list_prepend({{'l': found, 'r': ''}}, steps), lambda a, x: {{'l': sha256(x.l || a.l || x.r), 'r': ''}})).l AS folded_root FROM f)
SELECT *, folded_root = root AS verified FROM e"""
