"""Exact nearest neighbours over Voronoi cells.

A bounded sample of the reference rows are pivots; every row belongs to the cell of its
nearest pivot. A query is first searched in its nearest cells, as many as hold k rows,
which gives a distance that its k-th neighbour cannot exceed. After that it visits only
cells that can hold something nearer: the triangle inequality bounds the distance to a
cell's rows by its radii, the bisecting plane between two pivots bounds it as well. What
is left out is provably further away, so the result is exact for any data; how much is
left out depends on the data (random vectors of many dimensions leave out little).

The first search deals cells and their queries in parts, so that neither one cell with most
rows nor one with most queries meets a single task. The second compares blocks of cells with
parts of the queries: a query goes once to a block, whatever number of the block's cells it
visits, and takes its distance along, so that what is shuffled grows with the rows and not
with rows times cells, while the comparisons still go by cells. Only where a block or a part
would hold more than PART rows there are more of them. Its comparisons, which grow with the
square where little is left out, go by single precision first: that leaves out rows that are
further away whatever was rounded, and only what remains is measured, in double precision.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tarnfield.sources import stages

#: Rows of a cell that are aimed at, pivots at most (they come to the driver), rows of a part or block at most, queries and rows compared at once.
CELL_ROWS, PIVOTS, PART, ROWS, SLICE = 1024, 1024, 1 << 17, 256, 8192
#: Pairs of blocks and parts that are aimed at, and the share of them that goes to blocks where
#: there are as many queries as rows (each pair sends a query's vector and its k nearest).
DEALT, BLOCK_SHARE = 128, 0.43
#: Pairs whose distances are taken at once.
PAIRS = 1 << 16
#: Squares that single precision holds with room for their products, four times the rounding of
#: one of its operations, and candidates for k neighbours beyond which a slice goes by double precision.
HELD, ROUNDING, LOOSE = 1e30, 2.0**-22, 8


def usable(x: Column, size: int | None = None) -> Column:
    """Whether a vector takes part: not null, no component null or not finite, of this size."""
    fine = x.isNotNull() & (F.size(x) > 0) & F.forall(x, lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v) != float("inf")))
    return F.coalesce(fine if size is None else fine & (F.size(x) == size), F.lit(False))


def squares(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    return (a * a).sum(axis=1)[:, None] + (b * b).sum(axis=1)[None, :] - 2 * a @ b.T


def rough(b: np.ndarray) -> np.ndarray | None:
    """Rows for products in single precision: -2 b, the own square less the most that rounding
    adds to a squared distance, and 1. None where single precision does not hold the squares."""
    own = (b * b).sum(axis=1)
    if not own.max(initial=0.0) < HELD:
        return None
    return np.column_stack([-2 * b, own * (1 - (b.shape[1] + 8) * ROUNDING), np.ones(len(b))]).astype(np.float32)


def nearest_of(asked: np.ndarray, a: np.ndarray, ids: np.ndarray, b: np.ndarray, k: int, bound: np.ndarray, single: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(place in asked, place in ids, distance) of the k nearest rows of each query that are
    no further than its ``bound``, ties by id; a row of the query's own id is none. All that
    ties with the k-th is looked at, and rows further than the k-th so far are not. With
    ``single`` (``rough`` of b) single precision leaves out what is further away for certain;
    distances are always taken in double precision."""
    own, limit = (a * a).sum(axis=1), bound * bound
    q, r, d = np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0)
    mine = None
    if single is not None and own.max(initial=0.0) < HELD:
        mine = np.column_stack([a, np.ones(len(a)), own * (1 - (a.shape[1] + 8) * ROUNDING)]).astype(np.float32)
    for s in range(0, len(b), SLICE):
        part, near = b[s : s + SLICE], None
        if mine is not None and np.isfinite(limit).all():
            most = (np.minimum(limit, 4 * HELD) * (1 + 1e-6) + 1e-9 * (1.0 + own)).astype(np.float32)
            near = np.flatnonzero(mine @ single[s : s + SLICE].T <= most[:, None])
        if near is not None and len(near) <= LOOSE * (k + 1) * len(a):
            i, j = np.divmod(near, len(part))
            fine = asked[i] != ids[s + j]
        else:
            square = squares(a, part)
            slack = 1e-9 * (1.0 + own + (part * part).sum(axis=1).max(initial=0.0))  # of the matrix product
            if k < len(part) and (near is not None or np.isinf(limit).any()):  # one more than k: the query's own row
                limit = np.minimum(limit, np.partition(square, k, axis=1)[:, k])
            i, j = np.nonzero(square <= (limit + slack)[:, None])
            fine = (asked[i] != ids[s + j]) & np.isfinite(square[i, j])
        i, j = i[fine], j[fine]
        far = [np.sqrt(((part[j[p : p + PAIRS]] - a[i[p : p + PAIRS]]) ** 2).sum(axis=1)) for p in range(0, len(i), PAIRS)]
        q, r, d = np.concatenate([q, i]), np.concatenate([r, s + j]), np.concatenate([d, *far])
        order = np.lexsort((ids[r], d, q))
        q, r, d = q[order], r[order], d[order]
        first = np.searchsorted(q, np.arange(len(asked) + 1))
        keep = np.arange(len(q)) - first[q] < k
        full = np.nonzero(np.diff(first) >= k)[0]
        limit[full] = np.minimum(limit[full], d[first[full] + k - 1] ** 2)
        q, r, d = q[keep], r[keep], d[keep]
    return q, r, d


def _matrix(column: pa.ChunkedArray | pa.Array, n: int) -> np.ndarray:
    column = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    return np.asarray(column.flatten().to_numpy(zero_copy_only=False), float).reshape(n, -1)


class PivotIndex:
    """Cells over reference rows (object_id, label, x). Vectors that are null, hold null or
    non-finite components, or have another size than most, take no part: they are nobody's
    neighbours and have none. A null label is -1."""

    def __init__(self, cell_rows: int = CELL_ROWS, pivots: int = PIVOTS) -> None:
        self.cell_rows, self.most = cell_rows, pivots

    def fit(self, reference: DataFrame) -> PivotIndex:
        rows = self._clean(reference.select("object_id", F.coalesce(F.col("label").cast("int"), F.lit(-1)).alias("label"), "x"))
        sizes = rows.filter(usable(F.col("x"))).groupBy(F.size("x").alias("size")).agg(F.count(F.lit(1)).alias("n"))
        first = sizes.orderBy(F.desc("n"), "size").first()
        self.size, n = (first["size"], first["n"]) if first else (0, 0)
        rows = rows.filter(usable(F.col("x"), self.size))
        m = min(self.most, max(1, -(-n // self.cell_rows)))
        drawn = rows.orderBy(F.xxhash64("object_id"), "object_id").limit(m).select("x").collect()  # the pivots
        self.pivots = np.unique(np.array([r["x"] for r in drawn], float).reshape(len(drawn), -1), axis=0) if drawn else np.zeros((0, 0))
        self.cells = stages.written(self._placed(rows))
        stats = self.cells.groupBy("cell").agg(F.count(F.lit(1)).alias("n"), F.min("r").alias("low"), F.max("r").alias("high")).collect()  # a row for each cell
        self.count, self.low, self.high = np.zeros(len(self.pivots), np.int64), np.zeros(len(self.pivots)), np.zeros(len(self.pivots))
        for s in stats:
            self.count[s["cell"]], self.low[s["cell"]], self.high[s["cell"]] = s["n"], s["low"], s["high"]
        return self

    @staticmethod
    def _clean(rows: DataFrame) -> DataFrame:
        return rows.withColumns({"object_id": F.col("object_id").cast("long"), "x": F.transform("x", lambda v: v.cast("double"))})

    def _placed(self, rows: DataFrame) -> DataFrame:
        """Adds the cell and the distance r to its pivot."""
        pivots = self.pivots

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                x = _matrix(batch.column(2), batch.num_rows) if batch.num_rows else np.zeros((0, pivots.shape[1]))
                cell = np.concatenate([squares(x[a : a + ROWS], pivots).argmin(axis=1) for a in range(0, len(x), ROWS)] or [np.zeros(0, np.int64)])
                r = np.sqrt(((x - pivots[cell]) ** 2).sum(axis=1)) if len(x) else np.zeros(0)
                yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(cell, pa.int64()), pa.array(r)], names=[*batch.schema.names, "cell", "r"])

        return rows.select("object_id", "label", "x").mapInArrow(run, "object_id long, label int, x array<double>, cell long, r double")

    def _visits(self, queries: DataFrame, k: int, second: bool) -> DataFrame:
        """query_id, x, visits: the cells of the first search, or those that ``bound`` leaves for the second."""
        reach = self._reach()
        pivots, count = self.pivots, self.count

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                n, out = batch.num_rows, []
                x = _matrix(batch.column(1), n) if n else np.zeros((0, pivots.shape[1]))
                bound = batch.column(2).to_numpy(zero_copy_only=False).astype(float)
                for a in range(0, n, ROWS):
                    d = np.sqrt(np.maximum(squares(x[a : a + ROWS], pivots), 0.0))
                    order = d.argsort(axis=1, kind="stable")
                    held = np.cumsum(count[order], axis=1)
                    rank = np.empty_like(order)
                    np.put_along_axis(rank, order, np.arange(len(pivots))[None, :], 1)
                    enough = (held < k + 1).sum(axis=1)  # one more than k: the query's own row
                    visit = (rank <= enough[:, None]) & (count > 0)
                    if second:
                        visit = ~visit & reach(d, bound[a : a + ROWS])
                    out += [np.nonzero(v)[0] for v in visit]
                yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(out, pa.list_(pa.int64()))], names=["query_id", "x", "visits"])

        return queries.select("query_id", "x", "bound").mapInArrow(run, "query_id long, x array<double>, visits array<long>")

    def _reach(self) -> Callable[[np.ndarray, np.ndarray], np.ndarray]:
        """Which cells can hold rows within ``bound`` of queries at distances d from the pivots."""
        count, low, high = self.count, self.low, self.high
        between = np.sqrt(np.maximum(squares(self.pivots, self.pivots), 0.0))

        def reach(d: np.ndarray, bound: np.ndarray) -> np.ndarray:
            at, own = np.arange(len(d)), d.argmin(axis=1)
            plane = (d**2 - d[at, own][:, None] ** 2) / np.maximum(2 * between[own], 1e-12)
            plane[at, own] = 0.0
            least = np.maximum(np.maximum(d - high, low - d), plane)
            return (count > 0) & (least <= bound[:, None] * (1 + 1e-9) + 1e-7)

        return reach

    def _searched(self, visits: DataFrame, k: int) -> DataFrame:
        """The k nearest of each visited cell's parts: query_id, object_id, label, distance."""
        asked = visits.select("query_id", F.col("x").alias("qx"), F.explode("visits").alias("cell"))
        sizes = self.cells.sparkSession.createDataFrame([(c, int(-(-n // PART))) for c, n in enumerate(self.count.tolist()) if n], "cell long, r_parts int")
        deals = asked.groupBy("cell").agg(F.ceil(F.count(F.lit(1)) / PART).cast("int").alias("q_parts")).join(F.broadcast(sizes), "cell").select(F.col("cell").alias("of_cell"), "r_parts", "q_parts")
        deals = F.broadcast(stages.written(deals))  # PIVOTS rows at most

        def dealt(rows: DataFrame, key: str, own: str, other: str) -> DataFrame:
            rows = rows.join(deals, F.col("cell") == F.col("of_cell")).withColumn(own, F.pmod(F.xxhash64(key), F.col(f"{own}s")).cast("int"))
            return rows.withColumn(other, F.explode(F.sequence(F.lit(0), F.col(f"{other}s") - 1))).drop("of_cell", "r_parts", "q_parts")

        left, right = dealt(asked, "query_id", "q_part", "r_part"), dealt(self.cells.select("object_id", "label", "x", "cell"), "object_id", "r_part", "q_part")
        keys = ["cell", "r_part", "q_part"]

        def search(qs: pa.Table, rs: pa.Table) -> pa.Table:
            out = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)], [np.zeros(0, np.int32)], [np.zeros(0)]
            if qs.num_rows and rs.num_rows:
                ids, labels, b = rs["object_id"].to_numpy(), rs["label"].to_numpy(), _matrix(rs["x"], rs.num_rows)
                query, a = qs["query_id"].to_numpy(), _matrix(qs["qx"], qs.num_rows)
                for p in range(0, len(query), ROWS):
                    q, r, d = nearest_of(query[p : p + ROWS], a[p : p + ROWS], ids, b, k, np.full(len(query[p : p + ROWS]), np.inf))
                    for o, v in zip(out, (query[p : p + ROWS][q], ids[r], labels[r], d)):
                        o.append(v)
            return pa.table(dict(zip(("query_id", "object_id", "label", "distance"), map(np.concatenate, out))))

        return left.groupBy(*keys).cogroup(right.groupBy(*keys)).applyInArrow(search, "query_id long, object_id long, label int, distance double")

    def _blocks(self, asked: int) -> np.ndarray:
        """The block of each cell: about as many rows in each, fewer blocks the more queries there are."""
        n = max(int(self.count.sum()), 1)
        most = max(-(-n // PART), min(DEALT, round(math.sqrt(DEALT * BLOCK_SHARE * n / max(asked, 1)))), 1)
        return (np.cumsum(self.count) - self.count) * most // n

    def _compared(self, held: DataFrame, k: int) -> DataFrame:
        """The k nearest of each query (query_id, x, bound) in every block that holds a cell
        within its bound: query_id, object_id, label, distance."""
        asked = held.count()
        block, reach, pivots, spark = self._blocks(asked), self._reach(), self.pivots, held.sparkSession
        sizes = np.bincount(block, self.count).astype(int)
        q_parts = max(-(-asked // PART), -(-DEALT // len(sizes)))
        cells = spark.createDataFrame([(c, int(block[c]), int(-(-sizes[block[c]] // PART))) for c in np.nonzero(self.count)[0].tolist()], "of_cell long, block int, r_parts int")
        parts = cells.select(F.col("block").alias("of_block"), "r_parts").distinct()

        def send(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                n = batch.num_rows
                x, bound = _matrix(batch.column(1), n) if n else np.zeros((0, pivots.shape[1])), batch.column(2).to_numpy(zero_copy_only=False)
                for a in range(0, n, ROWS):
                    visit = reach(np.sqrt(np.maximum(squares(x[a : a + ROWS], pivots), 0.0)), bound[a : a + ROWS])
                    to = np.zeros((len(visit), len(sizes)), bool)
                    np.logical_or.at(to.T, block, visit.T)
                    q, at = np.nonzero(to)
                    rows = batch.take(pa.array(a + q))
                    yield pa.RecordBatch.from_arrays([*rows.columns, pa.array(at.astype(np.int32))], names=["query_id", "qx", "bound", "block"])

        left = held.select("query_id", "x", "bound").mapInArrow(send, "query_id long, qx array<double>, bound double, block int")
        left = left.join(F.broadcast(parts), F.col("block") == F.col("of_block")).withColumn("r_part", F.explode(F.sequence(F.lit(0), F.col("r_parts") - 1))).withColumn("q_part", F.pmod(F.xxhash64("query_id"), F.lit(q_parts)).cast("int"))
        right = self.cells.select("object_id", "label", "x", "cell").join(F.broadcast(cells), F.col("cell") == F.col("of_cell"))
        right = right.withColumn("r_part", F.pmod(F.xxhash64("object_id"), F.col("r_parts")).cast("int")).withColumn("q_part", F.explode(F.sequence(F.lit(0), F.lit(q_parts - 1))))
        keys = ["block", "r_part", "q_part"]

        def search(qs: pa.Table, rs: pa.Table) -> pa.Table:
            out = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)], [np.zeros(0, np.int32)], [np.zeros(0)]
            if qs.num_rows and rs.num_rows:
                cell = rs["cell"].to_numpy()
                by = cell.argsort(kind="stable")
                cell, ids, labels, b = cell[by], rs["object_id"].to_numpy()[by], rs["label"].to_numpy()[by], _matrix(rs["x"], rs.num_rows)[by]
                query, bound, a = qs["query_id"].to_numpy(), qs["bound"].to_numpy(), _matrix(qs["qx"], qs.num_rows)
                own, single = np.concatenate([squares(a[p : p + ROWS], pivots).argmin(axis=1) for p in range(0, len(a), ROWS)]), rough(b)
                near = own.argsort(kind="stable")  # queries of one cell visit the same ones
                for p in range(0, len(near), ROWS):
                    at = near[p : p + ROWS]
                    visit = reach(np.sqrt(np.maximum(squares(a[at], pivots), 0.0)), bound[at]).any(axis=0)
                    rows = np.nonzero(visit[cell])[0]
                    some = slice(None) if len(rows) == len(cell) else rows
                    q, r, d = nearest_of(query[at], a[at], ids[some], b[some], k, bound[at], None if single is None else single[some])
                    for o, v in zip(out, (query[at][q], ids[some][r], labels[some][r], d)):
                        o.append(v)
            return pa.table(dict(zip(("query_id", "object_id", "label", "distance"), map(np.concatenate, out))))

        return left.select("query_id", "qx", "bound", *keys).groupBy(*keys).cogroup(right.select("object_id", "label", "x", "cell", *keys).groupBy(*keys)).applyInArrow(search, "query_id long, object_id long, label int, distance double")

    @staticmethod
    def _best(found: DataFrame, k: int) -> DataFrame:
        w = Window.partitionBy("query_id").orderBy("distance", "object_id")  # k rows for each part that was searched
        return found.withColumn("rank", F.row_number().over(w)).filter(F.col("rank") <= k)

    def _held(self, queries: DataFrame, k: int) -> tuple[DataFrame, DataFrame]:
        """The first search: its visits, and query_id, x, bound, which is the distance of the k-th row found."""
        q = self._clean(queries.select("object_id", "x")).filter(usable(F.col("x"), self.size)).select(F.col("object_id").alias("query_id"), "x")
        one = self._visits(q.withColumn("bound", F.lit(float("inf"))), k, False)
        bound = self._best(self._searched(one, k), k).filter(F.col("rank") == k).select(F.col("query_id").alias("of_query"), F.col("distance").alias("bound"))
        held = q.join(bound, F.col("query_id") == F.col("of_query"), "left").select("query_id", "x", F.coalesce("bound", F.lit(float("inf"))).alias("bound"))
        return one, stages.written(held)

    def query(self, queries: DataFrame, k: int) -> DataFrame:
        """query_id, object_id, label, distance, rank (ties by object_id) of each query's k
        nearest other rows; queries have object_id and x."""
        if not len(self.pivots):
            return self.cells.sparkSession.createDataFrame([], "query_id long, object_id long, label int, distance double, rank int")
        return self._best(self._compared(self._held(queries, k)[1], k), k)

    def visited(self, queries: DataFrame, k: int) -> DataFrame:
        """query_id, the number of cells that its search visits, and that of all cells with rows."""
        if not len(self.pivots):
            return self.cells.sparkSession.createDataFrame([], "query_id long, visited int, cells int")
        one, held = self._held(queries, k)
        second = self._visits(held, k, True)
        both = one.select("query_id", F.size("visits").alias("n")).unionByName(second.select("query_id", F.size("visits").alias("n")))
        return both.groupBy("query_id").agg(F.sum("n").cast("int").alias("visited")).withColumn("cells", F.lit(int((self.count > 0).sum())))
