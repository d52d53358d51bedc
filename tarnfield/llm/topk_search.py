"""Exact top-k search by distributed histogram selection.

A stated set of query vectors is scored against all vectors, block by block. The
scores themselves are not kept: every round counts, for each query, how the scores
fall into the bins of its current interval, sums the counts over all blocks and
narrows the interval to the bin that holds the kth greatest score, until the bin
is one score wide. A last round emits what lies above each query's kth score and,
of the ties at it, the least ids.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tarnfield.llm.tables import drop, materialise

K, SCALE, QUERY_EVERY = 20, 64.0, 20
#: Bits of a score that a round settles, with a bin for each of their values; vectors of a block.
STEP_BITS, QUERY_BLOCK, ROW_BLOCK = 6, 256, 4096
BINS = 1 << STEP_BITS
#: Added to a score, it gives an unsigned number in the same order.
_SIGN = np.uint64(1 << 63)
_LEAST, _GREATEST = -(1 << 63), (1 << 63) - 1
#: What a block's components are kept as: the first that holds all of them exactly.
_KINDS = ("<i1", "<i2", "<i4", "<f8")


def quantised(rows: DataFrame, id_col: str, vector_col: str) -> DataFrame:
    """id, dim and floor(SCALE * x) as a packed blob of little-endian doubles; only
    vectors that are not null, not empty and finite throughout."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, dims, blobs = [], [], []
            for i, v in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                if i is None or not v or any(x is None for x in v):
                    continue
                x = np.floor(SCALE * np.array(v, np.float64))
                if np.isfinite(x).all():
                    ids.append(i)
                    dims.append(len(v))
                    blobs.append(x.astype("<f8").tobytes())
            yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(dims, pa.int32()), pa.array(blobs, pa.binary())], names=["vec_id", "dim", "v"])

    return rows.select(F.col(id_col).cast("long"), vector_col).mapInArrow(run, "vec_id long, dim int, v binary")


def blocks(rows: DataFrame, size: int) -> DataFrame:
    """Rows packed as (dim, block, ids, vectors): a hash of the id deals them into
    blocks of about ``size`` rows, so equal vectors spread like all others."""
    n = max(1, -(-rows.count() // size))
    dealt = rows.withColumn("block", F.pmod(F.xxhash64("vec_id"), F.lit(n)).cast("int"))

    def pack(pdf: pd.DataFrame) -> pd.DataFrame:
        v = np.frombuffer(b"".join(pdf["v"]), "<f8")
        kind = next(k for k, t in enumerate(_KINDS) if t == "<f8" or np.abs(v).max(initial=0) <= np.iinfo(t).max)
        return pd.DataFrame({"dim": pdf["dim"].iloc[:1], "block": pdf["block"].iloc[:1], "ids": [pdf["vec_id"].to_numpy("<i8").tobytes()], "vs": [bytes([kind]) + v.astype(_KINDS[kind]).tobytes()]})

    return dealt.groupBy("dim", "block").applyInPandas(pack, "dim int, block int, ids binary, vs binary")


def _matrix(ids: bytes, vs: bytes, dim: int) -> tuple[np.ndarray, np.ndarray]:
    return np.frombuffer(ids, "<i8"), np.frombuffer(vs, _KINDS[vs[0]], offset=1).reshape(-1, dim).astype(np.float64)


def scores(q: np.ndarray, x: np.ndarray) -> np.ndarray:
    """Integer inner products: exact in floating point while sums stay below its
    mantissa, in Python's integers beyond, held to the ends of a long."""
    top = float(np.abs(q).max(initial=0)) * float(np.abs(x).max(initial=0)) * q.shape[1]
    if top < 2**24:
        return (q.astype(np.float32) @ x.T.astype(np.float32)).astype(np.int64)
    if top < 2**53:
        return (q @ x.T).astype(np.int64)
    exact = np.array([[int(c) for c in r] for r in q], object) @ np.array([[int(c) for c in r] for r in x], object).T
    return np.clip(exact, _LEAST, _GREATEST).astype(np.int64)


def beyond(q: np.ndarray, x: np.ndarray, score: int) -> int | None:
    """The whole inner product where ``score`` is an end of the longs, else None."""
    return sum(int(a) * int(b) for a, b in zip(q, x)) if score in (_LEAST, _GREATEST) else None


def _key(exact: int | None) -> bytes | None:
    """Bytes that sort as the integers do: products of doubles stay far below 2 ** 2300."""
    return None if exact is None else (exact + (1 << 2300)).to_bytes(288, "big")


def _pairs(queries: DataFrame, candidates: DataFrame, n_blocks: int) -> DataFrame:
    """Every query block beside every candidate block of its dimension.

    The query set is the stated one; blocks, not rows, are paired. Each query block
    is sent to every block number, so that a candidate block is a key of its own. The
    hint keeps the copies away from the driver: Spark takes them to be as small as the
    query blocks, and would broadcast them."""
    numbers = F.sequence(F.lit(0), F.lit(n_blocks - 1))
    sent = queries.withColumn("c_block", F.explode(numbers))
    right = candidates.select(F.col("dim").alias("c_dim"), F.col("block").alias("c_no"), F.col("ids").alias("c_ids"), F.col("vs").alias("c_vs"))
    return sent.hint("merge").join(right, (F.col("dim") == F.col("c_dim")) & (F.col("c_block") == F.col("c_no")))


_STATE = "dim int, block int, ids binary, vs binary, lo binary, shift binary, above binary, found boolean"


def search(rows: DataFrame, queries: DataFrame, k: int = K, id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """Each query's k greatest scores: query_id, rank, vec_id, score.

    ``queries`` are rows of the same columns. A query's own row (equal id) is no
    candidate; ties go to the smaller id. Vectors that are null, empty or hold null
    or non-finite components take no part; vectors of different lengths have no
    score with each other. Fewer candidates than k: all. Repeated rows count each;
    other columns are ignored, whatever their names. Scores are ranked as
    whole integers; one that no long holds is returned as the nearest long. A vector's cost is its length times the queries, and
    a block holds ROW_BLOCK vectors, so very long ones need memory for that many.
    """
    cand = materialise(blocks(quantised(rows, id_col, vector_col), ROW_BLOCK))
    n_blocks = 1 + (cand.agg(F.max("block")).first()[0] or 0)
    ask = materialise(blocks(quantised(queries, id_col, vector_col), QUERY_BLOCK))

    def begin(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        """Cauchy's bound gives each query's first interval, of BINS equal bins from lo;
        no score lies outside it."""
        for pdf in batches:
            out = pdf.copy()
            for c in ("lo", "shift", "above"):
                out[c] = None
            for r in out.index:
                ids, q = _matrix(out.at[r, "ids"], out.at[r, "vs"], out.at[r, "dim"])
                with np.errstate(over="ignore"):
                    bound = np.ceil(np.sqrt((q**2).sum(axis=1)) * longest[int(out.at[r, "dim"])] * (1 + 1e-9)) + 1
                bound = np.where(np.isnan(bound), 1.0, np.minimum(bound, 2.0**63)).astype(np.uint64)  # 0 times infinity: all scores are 0
                out.at[r, "lo"] = (_SIGN - bound).astype("<u8").tobytes()
                shift = np.zeros(len(ids), np.int64)
                for _ in range(64 // STEP_BITS):  # until BINS bins hold 2 * bound + 1 values
                    shift[(bound >> shift.astype(np.uint64)) >= BINS // 2 - 1] += STEP_BITS
                out.at[r, "shift"] = shift.astype("<i8").tobytes()
                out.at[r, "above"] = np.zeros(len(ids), "<i8").tobytes()
            out["found"] = False
            yield out

    def norms(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            with np.errstate(over="ignore"):
                tops = [float(np.sqrt((_matrix(i, v, d)[1] ** 2).sum(axis=1)).max()) for i, v, d in zip(pdf["ids"], pdf["vs"], pdf["dim"])]
            yield pd.DataFrame({"dim": pdf["dim"], "top": tops})

    # a row for each dimension that vectors have
    longest = {r["dim"]: r["top"] for r in cand.mapInPandas(norms, "dim int, top double").groupBy("dim").agg(F.max("top").alias("top")).collect()}

    def count(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        """Histograms of a partition's pairs, summed per query block."""
        sums: dict[tuple[int, int], np.ndarray] = {}
        for pdf in batches:
            for r in pdf.itertuples():
                if r.found:
                    continue
                ids, q = _matrix(r.ids, r.vs, r.dim)
                c_ids, x = _matrix(r.c_ids, r.c_vs, r.dim)
                lo, shift = np.frombuffer(r.lo, "<u8"), np.frombuffer(r.shift, "<i8")
                # what lies below lo wraps round to a number beyond all bins
                place = (scores(q, x).view(np.uint64) ^ _SIGN) - lo[:, None]
                bin_ = place >> np.maximum(shift, 0).astype(np.uint64)[:, None]
                inside = (bin_ < BINS) & (shift >= 0)[:, None] & (ids[:, None] != c_ids[None, :])
                at = (np.arange(len(ids))[:, None] * BINS + bin_.astype(np.int64))[inside]
                h = np.bincount(at, minlength=len(ids) * BINS)
                key = (r.dim, r.block)
                sums[key] = sums[key] + h if key in sums else h
        yield pd.DataFrame({"dim": [d for d, _ in sums], "block": [b for _, b in sums], "h": [h.astype("<i8").tobytes() for h in sums.values()]})

    def add(pdf: pd.DataFrame) -> pd.DataFrame:
        total = sum(np.frombuffer(h, "<i8") for h in pdf["h"])
        return pd.DataFrame({"dim": pdf["dim"].iloc[:1], "block": pdf["block"].iloc[:1], "h": [total.astype("<i8").tobytes()]})

    def narrow(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            out = pdf.drop(columns=["h"]).astype({"found": bool})
            for r in pdf.index:
                if pdf.at[r, "found"] or pdf.at[r, "h"] is None:
                    out.at[r, "found"] = True
                    continue
                lo = np.frombuffer(pdf.at[r, "lo"], "<u8").copy()
                shift, above = (np.frombuffer(pdf.at[r, c], "<i8").copy() for c in ("shift", "above"))
                h = np.frombuffer(pdf.at[r, "h"], "<i8").reshape(-1, BINS)
                down = h[:, ::-1].cumsum(axis=1)
                enough = down + above[:, None] >= k
                bin_ = np.where(enough.any(axis=1), BINS - 1 - enough.argmax(axis=1), 0)  # too few: all
                row = np.arange(len(lo))
                open_ = shift >= 0  # below 0: the kth score is known
                above += np.where(open_, down[row, BINS - 1 - bin_] - h[row, bin_], 0)
                lo += np.where(open_, bin_.astype(np.uint64) << np.maximum(shift, 0).astype(np.uint64), np.uint64(0))
                shift -= STEP_BITS
                out.at[r, "lo"], out.at[r, "shift"], out.at[r, "above"] = lo.astype("<u8").tobytes(), shift.astype("<i8").tobytes(), above.astype("<i8").tobytes()
                out.at[r, "found"] = not (shift >= 0).any()
            yield out

    state = materialise(ask.mapInPandas(begin, _STATE))
    while not state.agg(F.coalesce(F.bool_and("found"), F.lit(True))).first()[0]:
        hist = _pairs(state.filter("not found"), cand, n_blocks).mapInPandas(count, "dim int, block int, h binary").groupBy("dim", "block").applyInPandas(add, "dim int, block int, h binary")
        last, state = state, materialise(state.join(hist, ["dim", "block"], "left").mapInPandas(narrow, _STATE))
        drop(last)

    def emit(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            for r in pdf.itertuples():
                ids, q = _matrix(r.ids, r.vs, r.dim)
                c_ids, x = _matrix(r.c_ids, r.c_vs, r.dim)
                kth = (np.frombuffer(r.lo, "<u8") ^ _SIGN).view(np.int64)
                s = scores(q, x)
                other = ids[:, None] != c_ids[None, :]
                i, j = np.nonzero((s > kth[:, None]) & other)
                ti, tj = np.nonzero((s == kth[:, None]) & other)
                order = np.lexsort((c_ids[tj], ti))  # of a block's ties the k least ids are enough
                if np.isin(kth, (_LEAST, _GREATEST)).any():  # at the ends of the longs the whole products decide
                    order = np.array(sorted(range(len(ti)), key=lambda n: (ti[n], -(beyond(q[ti[n]], x[tj[n]], kth[ti[n]]) or 0), c_ids[tj[n]])), np.int64)
                ti, tj = ti[order], tj[order]
                nth = np.arange(len(ti)) - np.searchsorted(ti, ti, side="left")
                ti, tj = ti[nth < k], tj[nth < k]
                i, j = np.concatenate((i, ti)), np.concatenate((j, tj))
                far = [_key(beyond(q[a], x[b], v)) for a, b, v in zip(i, j, s[i, j])] if np.isin(s[i, j], (_LEAST, _GREATEST)).any() else [None] * len(i)
                yield pd.DataFrame({"query_id": ids[i], "vec_id": c_ids[j], "score": s[i, j], "far": far})

    found = _pairs(state, cand, n_blocks).mapInPandas(emit, "query_id long, vec_id long, score long, far binary")
    best = Window.partitionBy("query_id").orderBy(F.desc("score"), F.desc("far"), "vec_id")
    ranked = found.withColumn("rank", F.row_number().over(best)).filter(F.col("rank") <= k)
    return ranked.select("query_id", F.col("rank").cast("int").alias("rank"), "vec_id", "score")


def op6_topk_search(spark, sf_dir: str) -> DataFrame:
    rows = spark.read.parquet(f"{sf_dir}/embeddings.parquet")
    return search(rows, rows.filter(F.col("vec_id") % QUERY_EVERY == 0))


def oracle_sql() -> str:
    return f"""
WITH v AS (SELECT vec_id, list_transform(embedding, lambda x: floor({SCALE} * x::DOUBLE)) AS v FROM embeddings
  WHERE len(embedding) > 0 AND list_bool_and(list_transform(embedding, lambda x: coalesce(isfinite(x::DOUBLE), false)))),
s AS (SELECT q.vec_id AS query_id, c.vec_id, list_inner_product(q.v, c.v)::BIGINT AS score FROM v q JOIN v c ON q.vec_id <> c.vec_id AND len(q.v) = len(c.v) WHERE q.vec_id % {QUERY_EVERY} = 0),
r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS rank FROM s)
SELECT query_id, rank::INTEGER AS rank, vec_id, score FROM r WHERE rank <= {K}"""
