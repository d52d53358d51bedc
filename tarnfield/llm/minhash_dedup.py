"""MinHash near-dedup with min-max hashing.

A document's set holds its distinct shingles. Each of some dozens of permutations is
evaluated once over a set and gives two values, its minimum and its maximum: both
agree between two sets with the probability of their Jaccard similarity, so half the
permutations fill a signature, and the two vary together less than two minima would.

1. Equal sets are one node from the start, so copies cost nothing after the scan.
2. Signatures are cut into bands of ROWS values, each from another permutation, so
   many that a pair at the threshold shares none with a probability below MISS.
3. Bands of several nodes are walked with the signatures: a band's nodes whose
   signatures agree in SLACK less than the threshold asks, or more, are connected
   (a pair at the threshold falls short of that about once in 10^12). A walk takes a
   node, finds all open nodes that are near it at once and goes on from these; it puts
   out a star for each connected group, never the pairs.
4. Connected groups are clusters. Only their documents are read again, for the whole
   sets, and the same walk is made in each cluster with the exact test
   100 * |intersection| >= percent * |union|. Links that it finds connect the result.

A band or cluster that is too large for a task is dealt by a hash into blocks, and
every pair of blocks is walked as a group of its own: no pair of nodes is left out.
Sets are compared by 64-bit hashes of their shingles; two of a pair's shingles of
20,000 words each clash with a probability of about 10^-10.
"""

from __future__ import annotations

import hashlib
import math
import re
import string
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tarnfield.llm.simhash_dedup import least_reachable
from tarnfield.llm.tables import drop, materialise, shuffle_partitions
from tarnfield.llm.text import ASCII_LOWER, as_bytes

SHINGLE_WORDS, PERCENT = 3, 85
#: Values of a band; the chance that a pair at the threshold meets in no band.
ROWS, MISS = 4, 1e-7
#: How far below the threshold the share of agreeing values may lie.
SLACK = 0.35
#: Text that is split into words at once, and shingles that are permuted at once.
PIECE, CHUNK = 1 << 20, 1 << 18
#: Nodes of a band, and shingles of a cluster, that one group of the walk has at most.
BAND_NODES, CLUSTER_SHINGLES = 1 << 14, 1 << 21
_SPACE = re.compile(rb"[ \t-\r]")
_WORD_MULT = np.array([0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9], np.uint64)


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def word_hashes(raw: bytes) -> np.ndarray:
    """A hash of every word of a lower-cased text, taken piece by piece."""
    out, at = [], 0
    while at < len(raw):
        space = _SPACE.search(raw, at + PIECE) if len(raw) - at > PIECE else None
        end = space.start() if space else len(raw)
        words = raw[at:end].split()
        out.append(np.fromiter(map(xxhash.xxh64_intdigest, words), np.uint64, len(words)))
        at = end
    return np.concatenate(out) if out else np.zeros(0, np.uint64)


def shingle_set(raw: bytes | None, width: int = SHINGLE_WORDS) -> np.ndarray:
    """Sorted distinct shingle hashes; with fewer words the whole sequence is one shingle."""
    h = word_hashes((raw or b"").translate(ASCII_LOWER))
    if not len(h):
        return h
    mult = _mix(np.arange(1, width + 1, dtype=np.uint64) * _WORD_MULT[0] + _WORD_MULT[1]) | np.uint64(1)
    if len(h) < width:
        return _mix((h * mult[: len(h)]).sum(keepdims=True, dtype=np.uint64) + np.uint64(len(h)) * _WORD_MULT[2])
    n = len(h) - width + 1
    total = h[:n] * mult[0]
    for k in range(1, width):
        total += h[k : k + n] * mult[k]
    return np.unique(_mix(total))


class MinMax:
    """Permutations of 64-bit hashes, and the bands of their minima and maxima."""

    def __init__(self, percent: int = PERCENT, rows: int = ROWS, miss: float = MISS) -> None:
        share = percent / 100
        bands = max(2, math.ceil(math.log(miss) / math.log(1 - share**rows))) if share < 1 else 2
        self.rows, self.bands = rows, bands + bands % 2
        self.permutations = self.rows * self.bands // 2
        seeds = np.arange(1, 2 * self.permutations + 1, dtype=np.uint64) * _WORD_MULT[0]
        self.mult, self.add = _mix(seeds[::2]) | np.uint64(1), _mix(seeds[1::2])
        self.least_agreeing = max(1, math.floor(2 * self.permutations * (share - SLACK)))

    def values(self, sets: list[np.ndarray]) -> np.ndarray:
        """For each set its minima and then its maxima; sets are not empty."""
        x = np.concatenate(sets)
        begin = np.cumsum([0, *map(len, sets[:-1])])
        out = np.empty((len(sets), 2 * self.permutations), np.uint64)
        for k in range(self.permutations):
            t = x * self.mult[k]
            t += self.add[k]
            out[:, k] = np.minimum.reduceat(t, begin)
            out[:, self.permutations + k] = np.maximum.reduceat(t, begin)
        return out

    def band_keys(self, values: np.ndarray) -> np.ndarray:
        """A hash for each band; its values are of different permutations."""
        v = values.reshape(len(values), self.bands, self.rows)
        key = np.broadcast_to(np.arange(self.bands, dtype=np.uint64), v.shape[:2])
        for k in range(self.rows):
            key = _mix(key * _WORD_MULT[0] + v[:, :, k])
        return key.view(np.int64)


def _digest(own: np.ndarray) -> bytes:
    return hashlib.blake2b(own.astype("<u8", copy=False).tobytes(), digest_size=16).digest()


def sketches(docs: DataFrame, width: int, family: MinMax) -> DataFrame:
    """doc_id, md5, n, digest of the set (null: no words), sig (16 bits of each value), bands."""
    names = ["doc_id", "md5", "n", "digest", "sig", "bands"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sets = [shingle_set(raw, width) for raw in as_bytes(batch.column(2))]
            digest = [_digest(s) if len(s) else None for s in sets]
            sig: list[bytes | None] = [None] * len(sets)
            bands: list[np.ndarray | None] = [None] * len(sets)
            some = [k for k, s in enumerate(sets) if len(s)]
            upto = np.cumsum([len(sets[k]) for k in some])
            begin = 0
            while begin < len(some):
                end = max(begin + 1, int(np.searchsorted(upto, (upto[begin - 1] if begin else 0) + CHUNK, "right")))
                values = family.values([sets[k] for k in some[begin:end]])
                short = (_mix(values) & np.uint64(0xFFFF)).astype("<u2")
                keys = family.band_keys(values)
                for at, k in enumerate(some[begin:end]):
                    sig[k], bands[k] = short[at].tobytes(), keys[at]
                begin = end
            n = pa.array([len(s) for s in sets], pa.int64())
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), n, pa.array(digest, pa.binary()), pa.array(sig, pa.binary()), pa.array(bands, pa.list_(pa.int64()))], names=names)

    kind = docs.schema["doc_id"].dataType.simpleString()
    return docs.select("doc_id", "md5", "text").mapInArrow(run, f"doc_id {kind}, md5 string, n long, digest binary, sig binary, bands array<long>")


# ---- walks ------------------------------------------------------------------


def connected(n: int, near: Callable[[int, np.ndarray], np.ndarray]) -> np.ndarray:
    """For each of n nodes the first node of its connected group. ``near(i, open)`` says
    which of the open nodes link with i; a node that is reached is never asked for again."""
    label = np.arange(n)
    left = np.arange(n)
    while len(left):
        root, left = left[0], left[1:]
        queue = [int(root)]
        while queue and len(left):
            hit = near(queue.pop(), left)
            new, left = left[hit], left[~hit]
            label[new] = root
            queue += new.tolist()
    return label


def near_signatures(sigs: list[bytes], least: int) -> np.ndarray:
    """``connected`` for signatures that agree in ``least`` values or more."""
    v = np.frombuffer(b"".join(sigs), "<u2").reshape(len(sigs), -1)
    return connected(len(sigs), lambda i, left: (v[left] == v[i]).sum(axis=1) >= least)


def near_sets(sets: list[np.ndarray], percent: int) -> np.ndarray:
    """``connected`` for sets with 100 * |intersection| >= percent * |union|."""
    size = np.array([len(s) for s in sets])
    ids = np.split(np.unique(np.concatenate(sets), return_inverse=True)[1], np.cumsum(size)[:-1])
    mark = np.zeros(max(int(i.max()) for i in ids) + 1, np.int32)
    held = {"of": np.zeros(0, np.int64), "ids": None, "begin": None}

    def near(i: int, left: np.ndarray) -> np.ndarray:
        if held["ids"] is None or 2 * len(left) < len(held["of"]):  # what is held has shrunk to half: packed anew
            held.update(of=left, ids=np.concatenate([ids[k] for k in left]), begin=np.cumsum(np.append(0, size[left][:-1])))
        mark[ids[i]] = 1
        both = np.add.reduceat(mark[held["ids"]], held["begin"]).astype(np.int64)[np.searchsorted(held["of"], left)]
        mark[ids[i]] = 0
        return 100 * both >= percent * (size[i] + size[left] - both)

    return connected(len(sets), near)


def _in_blocks(rows: DataFrame, weight: str, most: int) -> DataFrame:
    """Rows with blocks (i, j): a group whose weight is over ``most`` is dealt by a hash of
    the digest, and each row goes to every pair of blocks that its own is part of."""
    parts = F.when(F.col(weight) > most, F.ceil(F.col(weight) * 2 / most)).otherwise(1).cast("int")
    rows = rows.withColumn("parts", parts).withColumn("part", F.pmod(F.xxhash64("digest"), F.col("parts")).cast("int"))
    rows = rows.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)))
    return rows.withColumn("i", F.least("part", "other")).withColumn("j", F.greatest("part", "other"))


def _stars(rows: DataFrame, group: str, payload: str, label: Callable[[list], np.ndarray]) -> DataFrame:
    """(u, v), u > v: the members of each connected group of a (group, i, j) and its least digest."""
    rows = rows.select(group, "i", "j", "digest", payload).repartition(shuffle_partitions(rows.sparkSession), group, "i", "j").sortWithinPartitions(group, "i", "j", "digest")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        open_key, digests, held = None, [], []

        def close() -> tuple[list, list]:
            if len(digests) < 2:
                return [], []
            root = label(held).tolist()
            own = [k for k, r in enumerate(root) if r != k]
            return [digests[k] for k in own], [digests[root[k]] for k in own]

        for batch in batches:
            us, vs = [], []
            values = batch.column(4)
            for at, key in enumerate(zip(*(batch.column(c).to_pylist() for c in range(3)), batch.column(3).to_pylist())):
                key, digest = key[:3], key[3]
                if key != open_key:
                    u, v = close()
                    us += u
                    vs += v
                    open_key, digests, held = key, [], []
                if not digests or digests[-1] != digest:  # a row that is there twice is one node
                    digests.append(digest)
                    held.append(values[at])
            yield pa.RecordBatch.from_arrays([pa.array(us, pa.binary()), pa.array(vs, pa.binary())], names=["u", "v"])
        us, vs = close()
        yield pa.RecordBatch.from_arrays([pa.array(us, pa.binary()), pa.array(vs, pa.binary())], names=["u", "v"])

    return rows.mapInArrow(run, "u binary, v binary").distinct()


def _reached(edges: DataFrame) -> DataFrame:
    """(digest, root) of every node that the edges touch."""
    stars = least_reachable(edges)
    return stars.select(F.col("u").alias("digest"), F.col("v").alias("root")).unionByName(stars.select(F.col("v").alias("digest"), F.col("v").alias("root")).distinct())


def clusters(nodes: DataFrame, family: MinMax, band_nodes: int = BAND_NODES) -> DataFrame:
    """(digest, root): nodes that signatures connect within bands."""
    met = nodes.select(F.explode("bands").alias("band"), "digest")
    often = met.groupBy("band").agg(F.count(F.lit(1)).alias("met_by")).filter("met_by > 1")
    met = met.join(often, "band").join(nodes.select("digest", "sig"), "digest")
    least = family.least_agreeing
    return _reached(_stars(_in_blocks(met, "met_by", band_nodes), "band", "sig", lambda held: near_signatures([s.as_py() for s in held], least)))


def confirmed(docs: DataFrame, found: DataFrame, nodes: DataFrame, width: int, percent: int, repeats: bool, most: int = CLUSTER_SHINGLES) -> DataFrame:
    """Links (u, v) within clusters by the documents' whole sets."""
    members = materialise(found.join(nodes.select("digest", "n", "place"), "digest").select("root", "n", "place"))
    weight = members.groupBy("root").agg(F.sum("n").alias("weight"))
    wanted = members.join(weight, "root").select("root", "weight", F.col("place.doc_id").alias("own_id"), F.col("place.md5").alias("own_md5"))
    texts = docs.join(wanted, F.col("doc_id").eqNullSafe(F.col("own_id")) & (F.col("md5") == F.col("own_md5")))
    if repeats:
        texts = texts.dropDuplicates(["root", "own_id", "own_md5"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sets = [shingle_set(raw, width) for raw in as_bytes(batch.column(2))]
            own = [pa.array([_digest(s) for s in sets], pa.binary()), pa.array([s.view(np.int64) for s in sets], pa.list_(pa.int64()))]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), *own], names=["root", "weight", "digest", "shingles"])

    sets = texts.select("root", "weight", "text").mapInArrow(run, "root binary, weight long, digest binary, shingles array<long>")
    return _stars(_in_blocks(sets, "weight", most), "root", "shingles", lambda held: near_sets([s.values.to_numpy() for s in held], percent))


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", width: int = SHINGLE_WORDS, percent: int = PERCENT) -> DataFrame:
    """One row per document: doc_id, n_shingles, component_id, kept.

    A null, empty or blank text has no shingles, links with nothing and is its own
    component. Rows with the same id stand for themselves. Null ids take part but name no
    component; one of null ids only has a null component_id and its rows are kept. Empty
    table: empty result; other columns are ignored, whatever their names. Sets of any size
    are compared whole. The signature's miss (MISS for a pair right at the threshold,
    less above it) is the method's only loss.
    """
    family = MinMax(percent)
    text = F.col(f"`{text_col}`")
    slim = docs.select(F.col(f"`{id_col}`").alias("doc_id"), F.md5(F.coalesce(text, F.lit(""))).alias("md5"), text.alias("text"))
    drawn = materialise(sketches(slim, width, family))
    place = F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "md5")
    nodes = drawn.filter("digest IS NOT NULL").groupBy("digest").agg(F.min(F.struct(place.alias("place"), "n", "sig", "bands")).alias("x"))
    nodes = materialise(nodes.select("digest", "x.place", "x.n", "x.sig", "x.bands"))
    repeats = bool(drawn.groupBy("doc_id", "md5").agg(F.count(F.lit(1)).alias("times")).filter("times > 1").limit(1).count())
    found = clusters(nodes, family)
    links = _reached(confirmed(slim, found, nodes, width, percent, repeats))
    grouped = materialise(links.join(nodes.select("digest", F.col("place.doc_id").alias("least_id")), "digest"))
    least = grouped.groupBy("root").agg(F.min("least_id").alias("component_id"))
    linked = grouped.select("digest", "root").join(least, "root").select(F.col("digest").alias("_digest"), "component_id")
    own = nodes.join(linked, F.col("digest") == F.col("_digest"), "left").select(F.col("digest").alias("_digest"), F.when(F.col("_digest").isNull(), F.col("place.doc_id")).otherwise(F.col("component_id")).alias("of_set"))
    own = materialise(own)
    drop(nodes)
    drop(grouped)
    out = drawn.select("doc_id", "n", "digest").join(own, F.col("digest") == F.col("_digest"), "left")
    component = F.when(F.col("digest").isNull(), F.col("doc_id")).otherwise(F.col("of_set"))
    return out.select(F.col("doc_id").alias(id_col), F.col("n").alias("n_shingles"), component.alias("component_id"), F.col("doc_id").eqNullSafe(component).alias("kept"))


def op13_minhash_dedup(spark, sf_dir: str) -> DataFrame:
    return near_duplicates(spark.read.parquet(f"{sf_dir}/documents.parquet"))


def oracle_sql() -> str:
    """Sets of shingles, equal ones once; pairs by shared shingles; what can be reached over them."""
    upper, lower = string.ascii_uppercase, string.ascii_lowercase
    return rf"""
WITH RECURSIVE t AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), '{upper}', '{lower}'), '[^\x20\x09-\x0D]+') AS w FROM documents),
s AS (SELECT doc_id, list_sort(list_distinct(CASE WHEN len(w) >= {SHINGLE_WORDS} THEN list_transform(range(1, len(w) - {SHINGLE_WORDS - 2}), lambda i: array_to_string(w[i : i + {SHINGLE_WORDS - 1}], ' '))
  WHEN len(w) > 0 THEN [array_to_string(w, ' ')] ELSE [] END)) AS g FROM t),
c AS (SELECT min(doc_id) AS rep, g FROM s WHERE len(g) > 0 GROUP BY g),
e AS (SELECT rep, len(g) AS n, unnest(g) AS x FROM c),
linked AS (SELECT a.rep AS u, b.rep AS v FROM e a JOIN e b ON a.x = b.x AND a.rep <> b.rep GROUP BY a.rep, b.rep, a.n, b.n HAVING 100 * count(*) >= {PERCENT} * (a.n + b.n - count(*))),
reach AS (SELECT rep AS u, rep AS v FROM c UNION SELECT r.u, l.v FROM reach r JOIN linked l ON r.v = l.u),
least AS (SELECT u, min(v) AS component_id FROM reach GROUP BY u)
SELECT doc_id, len(s.g)::BIGINT AS n_shingles, coalesce(component_id, doc_id) AS component_id, coalesce(component_id, doc_id) = doc_id AS kept
FROM s LEFT JOIN c ON c.g = s.g LEFT JOIN least ON u = rep"""
