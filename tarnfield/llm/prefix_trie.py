"""The prefix trie of conversations by an external merge sort that knows common prefixes.

A turn is the digest of its role and text, a conversation the sequence of its turns. In
sorted order the conversations below a node of the trie stand together, and the common
prefix of neighbours says which nodes end between them.

1. Turns are sorted by conversation; each conversation becomes a row of digests.
2. Splitters from a weighted sample cut the order into ranges. A splitter is the shortest
   sequence that parts its neighbours; the conversation's id is the last element, so
   that copies of one conversation in any number are split too.
3. Each task sorts what it has into runs, one for each range, in which every entry is its
   common prefix with the one before and the rest.
4. A range's runs are merged by a loser tree that carries the common prefixes: turns that
   two conversations are known to share are not compared again. The merged stream keeps
   a stack of the open path; a node is finished when an entry does not share it.
5. Nodes on the path to a splitter may go on in another range. They are put out in
   parts, which are added up afterwards; there are as many as the splitters are long.

Memory: a task holds a range's encoded runs, one path, and the finished nodes of the
subtree whose top is open. A conversation is held whole, at 24 bytes for each turn.
"""

from __future__ import annotations

import hashlib
import os.path
from bisect import bisect_right
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tarnfield.llm.suffix_dedup import LoserTree
from tarnfield.llm.tables import drop, materialise, shuffle_partitions

DIGEST = 16
#: A turn's digest behind a byte of 1; a byte of 0 and the id (8 bytes) end a conversation.
STEP = DIGEST + 1
#: Turns that are sorted into runs together, turns of a range, ranges at most.
RUN_TURNS, RANGE_TURNS, RANGES_MOST = 1 << 20, 1 << 22, 1 << 14
#: Conversations in the sample for each range, and the sample's size on the driver at most.
SAMPLES, SAMPLE_BYTES = 40, 1 << 25
#: Rows of an output batch, and ids of a piece of a list that several ranges share.
ROWS_OUT, PIECE_IDS = 10_000, 1 << 14
ROOT = bytes(DIGEST)
#: Border nodes whose table may be broadcast (some 40 bytes each).
BROADCAST_BORDER = 50_000


def turns(conversations: DataFrame) -> DataFrame:
    """conv_id, turn, digest of role and text, code points of the text; nulls as empty texts."""
    role, text = (F.coalesce(F.col(c), F.lit("")) for c in ("role", "text"))
    digest = F.unhex(F.substring(F.sha2(F.concat(F.octet_length(role).cast("string"), F.lit(":"), role, text), 256), 1, 2 * DIGEST))
    return conversations.filter("conv_id IS NOT NULL").select("conv_id", "turn", digest.alias("digest"), F.length(text).cast("long").alias("points"))


def paths(conversations: DataFrame, base: Column | None = None, heads: Column | None = None, heads_most: int = 0) -> DataFrame:
    """(conv_id, path, points, n): each conversation as its turns' digests and code points.

    With ``base`` (the id of another conversation, or its own) and ``heads``, its first
    ``heads`` turns are replaced by those of ``base``: all if that has fewer, none if there
    is no such conversation; ``heads_most`` bounds ``heads``."""
    base = F.col("conv_id") if base is None else base
    heads = F.lit(0) if heads is None else heads
    rows = turns(conversations).select(base.alias("base"), (F.col("conv_id") != base).alias("other"), "conv_id", heads.cast("long").alias("heads"), "turn", "digest", "points")
    # the base conversation stands first among those that take turns from it
    rows = rows.repartition(shuffle_partitions(rows.sparkSession), "base").sortWithinPartitions("base", "other", "conv_id", F.col("turn").asc_nulls_first(), "digest")
    names = ["conv_id", "path", "points", "n"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        of, first = None, (b"", np.zeros(0, np.int64))  # whose first turns these are
        own: tuple | None = None
        held: list[tuple[bytes, np.ndarray]] = []

        def close() -> tuple:
            nonlocal of, first
            base_id, conv, take = own
            path, points = b"".join(h[0] for h in held), np.concatenate([h[1] for h in held])
            if of != base_id:
                of, first = base_id, (b"", points[:0])
            if conv == base_id:
                first = path[: heads_most * DIGEST], points[:heads_most]
            path = first[0][: take * DIGEST] + path[take * DIGEST :]
            points = np.concatenate((first[1][:take], points[take:]))
            return conv, path, points.astype("<i8").tobytes(), len(points)

        def batch_of(done: list[tuple]) -> pa.RecordBatch:
            kinds = (pa.int64(), pa.binary(), pa.binary(), pa.int64())
            return pa.RecordBatch.from_arrays([pa.array([d[k] for d in done], kind) for k, kind in enumerate(kinds)], names=names)

        for batch in batches:
            if not batch.num_rows:
                continue
            base_id, conv, take, points = (batch.column(k).to_numpy(zero_copy_only=False) for k in (0, 2, 3, 6))
            digests = b"".join(batch.column(5).to_pylist())
            cuts = [0, *(np.nonzero(conv[1:] != conv[:-1])[0] + 1).tolist(), len(conv)]
            done, size = [], 0
            for a, b in zip(cuts, cuts[1:]):
                key = int(base_id[a]), int(conv[a]), int(take[a])
                if key != own:
                    if held:
                        done.append(close())
                        size += done[-1][3]
                        if size > RUN_TURNS:
                            yield batch_of(done)
                            done, size = [], 0
                    own, held = key, []
                held.append((digests[a * DIGEST : b * DIGEST], points[a:b]))
            yield batch_of(done)
        if held:
            yield batch_of([close()])

    return rows.mapInArrow(run, "conv_id long, path binary, points binary, n long")


# ---- order ------------------------------------------------------------------


def sort_key(path: bytes, conv: int) -> bytes:
    """Bytes that sort as the turns do, then by id."""
    out = np.ones((len(path) // DIGEST, STEP), np.uint8)
    out[:, 1:] = np.frombuffer(path, np.uint8).reshape(-1, DIGEST)
    return out.tobytes() + b"\0" + (conv + (1 << 63)).to_bytes(8, "big")


def key_id(key: bytes) -> int:
    return int.from_bytes(key[-8:], "big") - (1 << 63)


def common(a: bytes, b: bytes, at: int = 0) -> int:
    """Bytes of the common prefix, known to reach ``at``."""
    stop = min(len(a), len(b))
    step = STEP
    while at < stop and a[at : at + step] == b[at : at + step]:
        at += step
        step *= 2
    return at if at >= stop else at + len(os.path.commonprefix([a[at : min(at + step, stop)], b[at : min(at + step, stop)]]))


def splitters(sample: list[tuple[bytes, int]], ranges: int) -> list[bytes]:
    """Ascending splitters of (key, weight) at weighted quantiles, as short as parts their neighbours."""
    sample = sorted(sample)
    upto = np.cumsum([w for _, w in sample]) if sample else np.zeros(0)
    out: list[bytes] = []
    for k in range(1, ranges):
        at = int(np.searchsorted(upto, upto[-1] * k / ranges, "right")) if len(upto) else 0
        if not 0 < at < len(sample):
            continue
        low, high = sample[at - 1][0], sample[at][0]
        own = high[: (common(low, high) // STEP + 1) * STEP]
        if not out or own > out[-1]:
            out.append(own)
    return out


def encode_run(rows: list[tuple[bytes, np.ndarray]]) -> bytes:
    """Sorted (key, points), each as its common prefix with the one before and the rest."""
    lcps, rest, body, points, last = [], [], [], [], b""
    for key, own in rows:
        lcp = common(last, key)
        lcps.append(lcp)
        rest.append(len(key) - lcp)
        body.append(key[lcp:])
        points.append(own[lcp // STEP :])
        last = key
    head = np.array([lcps, rest], "<i4")
    return len(rows).to_bytes(4, "little") + head.tobytes() + b"".join(body) + np.concatenate(points).astype("<i8").tobytes()


def decode_run(raw: bytes) -> Iterator[tuple[int, bytes, np.ndarray, None]]:
    """(common prefix with the one before, key, code points, None) in order."""
    n = int.from_bytes(raw[:4], "little")
    lcps, rest = np.frombuffer(raw, "<i4", 2 * n, 4).reshape(2, n).tolist()
    at = 4 + 8 * n
    points = np.frombuffer(raw, "<i8", offset=at + sum(rest))
    last, own, used = b"", points[:0], 0
    for lcp, more in zip(lcps, rest):
        last = last[:lcp] + raw[at : at + more]
        at += more
        shared = lcp // STEP
        new = len(last) // STEP - shared
        own = np.concatenate((own[:shared], points[used : used + new]))
        used += new
        yield lcp, last, own, None


# ---- nodes ------------------------------------------------------------------


class Node:
    """An open node: what the conversations so far have added to it."""

    __slots__ = ("depth", "border", "points", "least", "convs", "children", "leaves", "saved", "ends", "pieces", "waiting")

    def __init__(self, depth: int, border: bytes | None, points: int) -> None:
        self.depth, self.border, self.points = depth, border, points
        self.least, self.convs, self.children, self.leaves, self.saved = 1 << 63, 0, 0, 0, 0
        self.ends = None  # running hash of the ids that end here, of a border node a list of them
        self.pieces = 0
        self.waiting: list[list] = []  # finished children: their rows lack only this node's least id


_NODE = "conv_id long, depth long, parent_conv_id long, n_convs long, n_children long, n_leaves long, saved_tokens long, ends string"
_OUT = f"kind int, {_NODE}, key binary, parent_key binary, above array<binary>, points long, place long"
_TYPES = [pa.int32(), *[pa.int64()] * 7, pa.string(), pa.binary(), pa.binary(), pa.list_(pa.binary()), pa.int64(), pa.int64()]
NODES, PARTS, ENDS = range(3)
_NO_ENDS = hashlib.sha256().hexdigest()


def border_depth(key: bytes, near: list[bytes]) -> int:
    """Down to which depth the path's nodes are proper prefixes of a splitter; the root always is."""
    return max([0, *(min(common(key, s), len(s) - 1) // STEP for s in near)])


def finished(merged: Iterator[tuple[int, bytes, np.ndarray, None]], number: int, near: list[bytes]) -> Iterator[list]:
    """Rows of _OUT for the merged entries of one range, between the splitters ``near``."""
    stack = [Node(0, ROOT, 0)]

    def piece(node: Node) -> list:
        text, node.ends = ",".join(map(str, node.ends)), []
        node.pieces += 1
        return [ENDS, *[None] * 7, text, node.border, None, None, None, (number << 32) + node.pieces]

    def pop() -> Iterator[list]:
        node = stack.pop()
        parent = stack[-1] if stack else None
        if node.border is None:
            node.leaves = node.leaves or 1
            node.saved += (node.convs - 1) * node.points
            for row in node.waiting:
                row[3] = node.least
                yield row
            row = [NODES, node.least, node.depth, None, node.convs, node.children, node.leaves, node.saved, node.ends.hexdigest() if node.ends else _NO_ENDS, None, None, None, None, None]
            parent.children += 1
            if parent.border is None:
                parent.waiting.append(row)
            else:
                row[10] = parent.border
                yield row
        else:
            if node.ends:
                yield piece(node)
            yield [PARTS, node.least, node.depth, None, node.convs, node.children, node.leaves, node.saved, None, node.border, parent.border if parent else None, [s.border for s in stack], node.points, None]
        if parent:
            parent.least = min(parent.least, node.least)
            parent.convs += node.convs
            parent.leaves += node.leaves
            parent.saved += node.saved

    seen = False
    for lcp, key, points, _ in merged:
        seen = True
        shared = lcp // STEP
        while stack[-1].depth > shared:
            yield from pop()
        if len(points) > shared:
            border = border_depth(key, near)
            for depth in range(shared + 1, len(points) + 1):
                own = None
                if depth <= border:
                    own = hashlib.blake2b(stack[-1].border + key[(depth - 1) * STEP : depth * STEP], digest_size=DIGEST).digest()
                stack.append(Node(depth, own, int(points[depth - 1])))
        node, conv = stack[-1], key_id(key)
        node.least = min(node.least, conv)
        node.convs += 1
        if node.border is not None:
            node.ends = node.ends or []
            node.ends.append(conv)
            if len(node.ends) >= PIECE_IDS:
                yield piece(node)
        elif node.ends is None:
            node.ends = hashlib.sha256(str(conv).encode())
        else:
            node.ends.update(b",%d" % conv)
    while seen and stack:
        yield from pop()


def sorted_runs(rows: DataFrame, cuts: list[bytes]) -> DataFrame:
    """(r, run): each task's conversations as sorted runs, one for each range at a time."""

    def send(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple[bytes, np.ndarray]] = []
        size = 0

        def flush() -> pa.RecordBatch:
            held.sort(key=lambda x: x[0])
            by: dict[int, list] = {}
            for row in held:
                by.setdefault(bisect_right(cuts, row[0]), []).append(row)
            return pa.RecordBatch.from_arrays([pa.array(list(by), pa.int32()), pa.array([encode_run(v) for v in by.values()], pa.binary())], names=["r", "run"])

        for batch in batches:
            for conv, path, points in zip(*(batch.column(k).to_pylist() for k in range(3))):
                held.append((sort_key(path, conv), np.frombuffer(points, "<i8")))
                size += len(held[-1][1]) + 1
                if size >= RUN_TURNS:
                    yield flush()
                    held, size = [], 0
        if held:
            yield flush()

    return rows.select("conv_id", "path", "points").mapInArrow(send, "r int, run binary")


def merged_nodes(runs: DataFrame, cuts: list[bytes]) -> DataFrame:
    """Rows of _OUT: finished nodes, parts of border nodes, pieces of the latter's lists of ids."""
    names = [f.split()[0] for f in _OUT.split(", ")]

    def merge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out: list[list] = []

        def packed() -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array([row[k] for row in out], kind) for k, kind in enumerate(_TYPES)], names=names)

        def ranges() -> Iterator[tuple[int, list[bytes]]]:
            number, blobs = None, []
            for batch in batches:
                for r, run in zip(batch.column(0).to_pylist(), batch.column(1)):
                    if r != number:
                        if blobs:
                            yield number, blobs
                        number, blobs = r, []
                    blobs.append(run.as_py())
            if blobs:
                yield number, blobs

        for number, blobs in ranges():
            near = cuts[max(number - 1, 0) : number + 1] if number else cuts[:1]
            for row in finished(iter(LoserTree([decode_run(b) for b in blobs])), number, near):
                out.append(row)
                if len(out) >= ROWS_OUT:
                    yield packed()
                    out.clear()
        yield packed()

    return runs.repartition(shuffle_partitions(runs.sparkSession), "r").sortWithinPartitions("r").mapInArrow(merge, _OUT)


def joined_lists(pieces: DataFrame) -> DataFrame:
    """(key, ends): SHA-256 of each border node's ids, whose pieces go by in order and are not held."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, state = None, None

        def out(done: list[tuple[bytes, str]]) -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array([d[0] for d in done], pa.binary()), pa.array([d[1] for d in done], pa.string())], names=["key", "ends"])

        for batch in batches:
            done = []
            for own, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                if own == key:
                    state.update(b"," + text.encode())
                    continue
                if key is not None:
                    done.append((key, state.hexdigest()))
                key, state = own, hashlib.sha256(text.encode())
            yield out(done)
        if key is not None:
            yield out([(key, state.hexdigest())])

    rows = pieces.select("key", "ends", "place").repartition(shuffle_partitions(pieces.sparkSession), "key").sortWithinPartitions("key", "place")
    return rows.select("key", "ends").mapInArrow(run, "key binary, ends string")


def border_nodes(parts: DataFrame, pieces: DataFrame) -> DataFrame:
    """The border nodes whole: key, parent_key and the columns of a node but its parent's id."""
    whole = parts.groupBy("key").agg(
        F.min("conv_id").alias("conv_id"), F.first("depth").alias("depth"), F.sum("n_convs").alias("n_convs"), F.sum("n_children").alias("inner"), F.sum("n_leaves").alias("inner_leaves"),
        F.sum("saved_tokens").alias("inner_saved"), F.first("points").alias("points"), F.first("parent_key").alias("parent_key"), F.first("above").alias("above"),
    )
    whole = materialise(whole)
    children = whole.filter("parent_key IS NOT NULL").groupBy(F.col("parent_key").alias("key")).agg(F.count(F.lit(1)).alias("outer"))
    whole = whole.join(children, "key", "left").withColumn("n_children", F.col("inner") + F.coalesce("outer", F.lit(0)))
    own = whole.select(F.explode(F.concat("above", F.array("key"))).alias("key"), (F.col("n_children") == 0).cast("long").alias("leaf"), ((F.col("n_convs") - 1) * F.col("points")).alias("saved"))
    below = own.groupBy("key").agg(F.sum("leaf").alias("leaves_below"), F.sum("saved").alias("saved_below"))
    whole = whole.join(below, "key").join(joined_lists(pieces), "key", "left")
    return whole.select("key", "parent_key", "conv_id", "depth", "n_convs", "n_children", (F.col("inner_leaves") + F.col("leaves_below")).alias("n_leaves"), (F.col("inner_saved") + F.col("saved_below")).alias("saved_tokens"), F.coalesce("ends", F.lit(_NO_ENDS)).alias("ends"))


def prefix_trie(rows: DataFrame) -> DataFrame:
    """One row per node of the trie over ``paths``: conv_id, depth, parent_conv_id, n_convs,
    n_children, n_leaves, saved_tokens, ends_sha256.

    The root (depth 0, parent null) is there as soon as there is a conversation; a
    conversation without turns ends at it. No conversation: no row."""
    rows = materialise(rows)
    parts = shuffle_partitions(rows.sparkSession)
    convs, total = rows.agg(F.count(F.lit(1)), F.coalesce(F.sum(F.col("n") + 1), F.lit(0))).first()
    ranges = min(RANGES_MOST, max(parts, -(-total // RANGE_TURNS)))
    rate = min(1.0, SAMPLES * ranges / max(convs, 1), SAMPLE_BYTES / max(total * STEP, 1))
    drawn = rows.filter(F.pmod(F.xxhash64("conv_id"), F.lit(1 << 20)) < F.lit(int(rate * (1 << 20)) or 1))
    sample = [(sort_key(bytes(r["path"]), r["conv_id"]), r["n"] + 1) for r in drawn.select("conv_id", "path", "n").collect()]
    cuts = splitters(sample, ranges)
    nodes = materialise(merged_nodes(sorted_runs(rows, cuts), cuts))
    drop(rows)
    border = materialise(border_nodes(nodes.filter(F.col("kind") == PARTS), nodes.filter(F.col("kind") == ENDS)))
    names = border.select("key", F.col("conv_id").alias("of_parent"))
    if sum(len(c) // STEP for c in cuts) <= BROADCAST_BORDER:
        names = F.broadcast(names)
    columns = ["conv_id", "depth", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends"]
    inner = nodes.filter(F.col("kind") == NODES)
    inner = inner.join(names.withColumnRenamed("key", "own_key"), F.col("parent_key") == F.col("own_key"), "left").select(*columns, F.coalesce("parent_conv_id", "of_parent").alias("parent_conv_id"))
    outer = border.join(names.withColumnRenamed("key", "own_key"), F.col("parent_key") == F.col("own_key"), "left").select(*columns, F.col("of_parent").alias("parent_conv_id"))
    return inner.unionByName(outer).select("conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", F.col("ends").alias("ends_sha256"))


def conversation_trie(conversations: DataFrame) -> DataFrame:
    """The trie of the conversations as they are.

    Turns are in the order of ``turn``, null first, equal ones in that of their digests;
    null role and text are empty. Rows without conv_id belong to no conversation. Repeated
    rows are turns of their own. Other columns are ignored, whatever their names."""
    return prefix_trie(paths(conversations.select("conv_id", "turn", "role", "text")))


def op11_prefix_trie(spark, sf_dir: str) -> DataFrame:
    """Each conversation starts with the first crc32(id) % 6 turns of the one at the hundred below."""
    conversations = spark.read.parquet(f"{sf_dir}/conversations.parquet")
    own = F.col("conv_id")
    return prefix_trie(paths(conversations, own - own % 100, F.crc32(own.cast("string").cast("binary")) % 6, 5))


def oracle_sql() -> str:
    """Every prefix of every conversation as a row, grouped; subtrees by each node's ancestors."""
    step = "CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END"
    table = "list_transform(range(256), lambda i: list_reduce(list_prepend(i::BIGINT, range(8)), lambda c, _: " + step + "))"
    return f"""
WITH crcs AS (SELECT {table} AS crc),
t AS (SELECT conv_id, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, sha256(strlen(coalesce(role, ''))::VARCHAR || ':' || coalesce(role, '') || coalesce(text, ''))) AS k,
  sha256(strlen(coalesce(role, ''))::VARCHAR || ':' || coalesce(role, '') || coalesce(text, '')) AS d, length(coalesce(text, '')) AS points FROM conversations WHERE conv_id IS NOT NULL),
i AS (SELECT DISTINCT conv_id, conv_id - conv_id % 100 AS base, hex(encode(conv_id::VARCHAR)) AS x FROM t),
c AS (SELECT conv_id, base, xor(list_reduce(list_prepend(4294967295::BIGINT, list_transform(range(length(x) // 2), lambda i: ('0x' || substr(x, 2 * i + 1, 2))::BIGINT)),
  lambda a, y: xor(a >> 8, crc[(xor(a, y) & 255) + 1])), 4294967295) % 6 AS h FROM i, crcs),
r AS (SELECT c.conv_id, t.k, t.d, t.points FROM c JOIN t ON t.conv_id = c.base AND t.k <= c.h UNION ALL SELECT c.conv_id, t.k, t.d, t.points FROM c JOIN t ON t.conv_id = c.conv_id AND t.k > c.h),
s AS (SELECT conv_id, d, points, row_number() OVER w AS depth, array_agg(substr(d, 1, 32)) OVER w AS path FROM r WINDOW w AS (PARTITION BY conv_id ORDER BY k)),
m AS (SELECT conv_id, depth, points, path FROM s UNION ALL SELECT conv_id, 0, 0, []::VARCHAR[] FROM c),
e AS (SELECT conv_id, max(depth) AS n FROM m GROUP BY conv_id),
n AS (SELECT m.depth, array_to_string(m.path, '') AS key, CASE WHEN m.depth > 0 THEN array_to_string(m.path[1:m.depth - 1], '') END AS parent, min(m.conv_id) AS conv_id, count(*) AS n_convs, any_value(m.points) AS points, any_value(m.path) AS path,
  sha256(coalesce(string_agg(m.conv_id::VARCHAR, ',' ORDER BY m.conv_id) FILTER (e.n = m.depth), '')) AS ends_sha256 FROM m JOIN e USING (conv_id) GROUP BY m.depth, key, parent),
k AS (SELECT parent AS key, count(*) AS n_children FROM n GROUP BY parent),
f AS (SELECT n.*, coalesce(k.n_children, 0) AS n_children FROM n LEFT JOIN k ON n.key = k.key),
a AS (SELECT array_to_string(path[1:up], '') AS key, (n_children = 0)::BIGINT AS leaf, (n_convs - 1) * points AS saved FROM f, unnest(range(depth + 1)) u(up)),
b AS (SELECT key, sum(leaf) AS n_leaves, sum(saved) AS saved_tokens FROM a GROUP BY key)
SELECT f.conv_id, f.depth::BIGINT AS depth, p.conv_id AS parent_conv_id, f.n_convs::BIGINT AS n_convs, f.n_children::BIGINT AS n_children, b.n_leaves::BIGINT AS n_leaves, b.saved_tokens::BIGINT AS saved_tokens, f.ends_sha256
FROM f JOIN b ON f.key = b.key LEFT JOIN f p ON f.parent = p.key"""
