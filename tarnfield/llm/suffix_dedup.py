"""Exact repeats by a common-prefix-aware distributed merge sort of suffixes.

A byte goes where a WINDOW-byte string that covers it also starts earlier. Every
such string holds a GRAM-byte anchor chosen by its content alone (the least hash
of its grams), so two equal strings have equal anchors at equal offsets, and only
suffixes that start at anchors need sorting.

1. Anchors of all texts are counted by hash; those that occur once are dropped.
   Nothing that repeats is lost, a clash of hashes only keeps too much.
2. Each task sorts the suffixes at its anchors (WINDOW bytes, with what stands
   left of them) into runs, one for each range of anchor hashes. Suffixes equal
   in all their context are settled in the task, where only the earliest goes on.
   Runs are front-coded: a suffix is its common prefix with the one before and
   the rest.
3. A range's runs are combined by a loser tree over common-prefix lengths. Two
   suffixes whose known prefixes with the last output differ in length are
   ordered by that alone; others are compared from the known prefix on.
4. In the merged order, suffixes with the same anchor stand together. A window at
   offset o left of the anchor is equal where the merged common prefix reaches
   WINDOW - o and the o bytes to the left agree; all but the earliest are marked.

Everything that is sent is blocks of bytes per (task, range), and a task sends each
distinct context once. How many ranges there are follows the size of the texts.

An anchor in very many places (a short line that a third of all documents have, say)
would still gather its contexts in one range: anchors beyond a share of 1 / HOT_MOST
of all, and HOT_LEAST places, are split. Their suffixes are cut into the windows that
hold the anchor, 69 each, which are sorted, front-coded and merged by the same loser
tree, dealt over the ranges by a hash of the window; two are equal where the merged
common prefix is the whole window. Each task sends each distinct window once, so
nothing of a hot anchor meets in one place but equal windows of different tasks.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tarnfield.llm.tables import fresh, materialise, shuffle_partitions
from tarnfield.llm.text import as_bytes

WINDOW, GRAM = 100, 32
SPAN = WINDOW - GRAM + 1
#: Text that is scanned at once, and text whose runs are built together.
SCAN_BYTES, RUN_BYTES = 1 << 20, 1 << 23
NULL_ID = -(1 << 63)
#: Bytes of text that a range of the merge stands for.
RANGE_BYTES = 1 << 25
#: An anchor is hot from this many places on, and at most HOT_MOST anchors are: as
#: all places together are the total, that many hashes (8 MB) bound what is broadcast.
HOT_LEAST, HOT_MOST = 100_000, 1_000_000


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


_BYTE_HASH = _mix(np.arange(1, 257, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15))
_STEPS = [_mix(np.array([k], np.uint64))[0] | np.uint64(1) for k in range(11, 16)]


def gram_hashes(buf: np.ndarray) -> np.ndarray:
    """Hash of the GRAM bytes from each position on, by doubling; never zero."""
    h = _BYTE_HASH[buf]
    width = 1
    for mult in _STEPS:
        h = h[:-width] * mult + h[width:]
        width *= 2
    return _mix(h) | np.uint64(1)


def _sliding(x: np.ndarray, pick: np.ufunc) -> np.ndarray:
    """``pick`` over SPAN neighbours from each position on."""
    width = 1
    while 2 * width <= SPAN:
        x = pick(x[:-width], x[width:])
        width *= 2
    rest = SPAN - width
    return pick(x[: len(x) - rest], x[rest:]) if rest else x


def anchors(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(text number, position, hash) of every anchor of the texts, in order."""
    found: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
    parts: list[tuple[int, int, bytes]] = []
    size = 0

    def scan() -> None:
        buf = np.frombuffer(b"".join(p[2] for p in parts), np.uint8)
        begin = np.cumsum([0, *(len(p[2]) for p in parts)])
        h = gram_hashes(buf)
        least = _sliding(h, np.minimum)
        for end in begin[1:-1]:  # windows that reach into the next text
            least[max(0, end - WINDOW + 1) : end] = 0
        pad = np.zeros(SPAN - 1, np.uint64)
        chosen = np.nonzero(_sliding(np.concatenate((pad, least, pad)), np.maximum) == h)[0]
        part = np.searchsorted(begin, chosen, side="right") - 1
        number = np.array([p[0] for p in parts])[part]
        found.append((number, chosen - begin[part] + np.array([p[1] for p in parts])[part], h[chosen]))

    for k, raw in enumerate(texts):
        for at in range(0, max(len(raw) - WINDOW + 1, 0), SCAN_BYTES):  # long texts in overlapping pieces
            parts.append((k, at, raw[at : at + SCAN_BYTES + WINDOW - 1]))
            size += len(parts[-1][2])
            if size >= SCAN_BYTES:
                scan()
                parts, size = [], 0
    if parts:
        scan()
    if not found:
        none = np.zeros(0, np.int64)
        return none, none, none.astype(np.uint64)
    number, at, h = (np.concatenate(x) for x in zip(*found))
    order = np.lexsort((at, number))
    number, at, h = number[order], at[order], h[order]
    new = np.ones(len(at), bool)
    new[1:] = (number[1:] != number[:-1]) | (at[1:] != at[:-1])
    return number[new], at[new], h[new]


def _range_of(h: np.ndarray, ranges: int) -> np.ndarray:
    return (_mix(h) >> np.uint64(20)) % np.uint64(ranges)


def _by_range(r: np.ndarray, *cols: np.ndarray) -> Iterator[tuple[int, list[np.ndarray]]]:
    order = np.argsort(r, kind="stable")
    r = r[order]
    cuts = np.nonzero(np.diff(r))[0] + 1
    pieces = [np.split(c[order], cuts) for c in cols]
    for k, first in enumerate(np.concatenate(([0], cuts)) if len(r) else []):
        yield int(r[first]), [p[k] for p in pieces]


def _gather(batches: Iterator[pa.RecordBatch], text_at: int, most: int) -> Iterator[tuple[list[pa.RecordBatch], list[bytes]]]:
    """Batches joined until they hold ``most`` bytes of text."""
    held, texts, size = [], [], 0
    for batch in batches:
        raw = [t or b"" for t in as_bytes(batch.column(text_at))]
        held.append(batch)
        texts += raw
        size += sum(map(len, raw))
        if size >= most:
            yield held, texts
            held, texts, size = [], [], 0
    if held:
        yield held, texts


def _column(batches: list[pa.RecordBatch], at: int) -> np.ndarray:
    return np.concatenate([b.column(at).to_numpy(zero_copy_only=False) for b in batches])


def _blobs(arrays: dict[str, list]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(v, pa.int32() if k == "r" else pa.binary()) for k, v in arrays.items()], names=list(arrays))


_PLACE = np.dtype([("key", "<i8"), ("at", "<i4")])
_COUNT = np.dtype([("hash", "<u8"), ("n", "<i8")])


def _split(rows: np.ndarray, by: str) -> tuple[pa.Array, list[np.ndarray]]:
    """Keys of sorted rows, and the rows of each."""
    cuts = np.nonzero(np.diff(rows[by]))[0] + 1
    parts = np.split(rows, cuts) if len(rows) else []
    return pa.array([int(p[by][0]) for p in parts], pa.int64()), parts


def _dealt(rows: np.ndarray, by: str, ranges: int) -> pa.Table:
    """Rows on their way back to their documents: one blob for each range of keys, so
    that what is sent is a few blobs for each task however many rows there are."""
    blobs = {r: own.tobytes() for r, (own,) in _by_range(_range_of(np.ascontiguousarray(rows[by]).view("<u8"), ranges), rows)}
    return pa.table({"b": pa.array(list(blobs), pa.int32()), "rows": pa.array(list(blobs.values()), pa.binary())})


def repeated_anchors(docs: DataFrame, key: str, text_col: str, ranges: int) -> tuple[DataFrame, np.ndarray]:
    """(key, pos), for each key the positions of anchors that occur twice or more, and
    the hashes of hot anchors."""

    def send(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for held, texts in _gather(batches, 1, RUN_BYTES):
            keys = _column(held, 0).astype(np.int64)
            number, at, h = anchors(texts)
            own, order = keys[number], np.argsort(h, kind="stable")
            own, at, h = own[order], at[order].astype(np.int32), h[order]
            first = np.ones(len(h), bool)
            first[1:] = h[1:] != h[:-1]
            again = ~first
            again[:-1] |= ~first[1:]  # repeated in this task: settled, only one goes on to be counted
            rows: dict[int, list[bytes]] = {}
            send_at = np.where(again, np.int32(-1), at)
            times = np.diff(np.append(np.nonzero(first)[0], len(h))).astype(np.int32)
            for r, cols in _by_range(_range_of(h[first], ranges), h[first], own[first], send_at[first], times):
                rows[r] = [c.tobytes() for c in cols] + [b"", b""]
            for r, cols in _by_range(_range_of(own[again].view(np.uint64), ranges), own[again], at[again]):
                rows.setdefault(r, [b""] * 6)[4:] = [c.tobytes() for c in cols]
            yield _blobs({"r": list(rows)} | {n: [v[k] for v in rows.values()] for k, n in enumerate(("h", "k", "p", "n", "ks", "ps"))})

    def count(table: pa.Table) -> pa.Table:
        def read(name: str, kind: str) -> np.ndarray:
            return np.frombuffer(b"".join(table.column(name).to_pylist()), kind)

        h, own, at, times = read("h", "<u8"), read("k", "<i8"), read("p", "<i4"), read("n", "<i4").astype(np.int64)
        order = np.argsort(h, kind="stable")
        same = h[order][1:] == h[order][:-1]
        first = np.nonzero(np.concatenate(([True], ~same)))[0] if len(h) else np.zeros(0, np.int64)
        places = np.add.reduceat(times[order], first) if len(h) else times
        many = places >= HOT_LEAST
        often = np.rec.fromarrays((h[order][first[many]], places[many]), dtype=_COUNT)
        again = np.zeros(len(h), bool)
        again[1:] |= same
        again[:-1] |= same
        again = order[again & (at[order] >= 0)]
        own = np.concatenate((own[again], read("ks", "<i8")))
        at = np.concatenate((at[again], read("ps", "<i4")))
        back = _dealt(np.rec.fromarrays((own, at), dtype=_PLACE), "key", ranges)
        back = pa.concat_tables([back, pa.table({"b": pa.array([-1], pa.int32()), "rows": pa.array([often.tobytes()], pa.binary())})])
        total = [0] * (back.num_rows - 1) + [int(times.sum())]
        return back.append_column("total", pa.array(total, pa.int64()))

    def positions(table: pa.Table) -> pa.Table:
        places = np.unique(np.frombuffer(b"".join(table.column("rows").to_pylist()), _PLACE))
        keys, parts = _split(places, "key")
        return pa.table({"key": keys, "pos": pa.array([np.ascontiguousarray(p["at"]).tobytes() for p in parts], pa.binary())})

    sent = docs.select(key, text_col).mapInArrow(send, "r int, h binary, k binary, p binary, n binary, ks binary, ps binary")
    counted = materialise(sent.groupBy("r").applyInArrow(count, "b int, rows binary, total long"))
    least = max(HOT_LEAST, (counted.agg(F.sum("total")).first()[0] or 0) // HOT_MOST)

    def hashes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = np.frombuffer(b"".join(batch.column(0).to_pylist()), _COUNT)
            yield pa.RecordBatch.from_arrays([pa.array(rows["hash"][rows["n"] >= least].view(np.int64))], names=["hash"])

    found = counted.filter("b = -1").select("rows").mapInArrow(hashes, "hash long").collect()  # HOT_MOST at most
    hot = np.sort(np.array([r["hash"] for r in found], np.int64).view(np.uint64))
    places = counted.filter("b >= 0").select("b", "rows").groupBy("b").applyInArrow(positions, "key long, pos binary")
    return places, hot


# ---- runs -------------------------------------------------------------------

_INTERVAL = np.dtype([("key", "<i8"), ("text", "<u8"), ("begin", "<i4"), ("end", "<i4")])
_ENTRY = np.dtype([("lcp", "u1"), ("right", "u1"), ("left", "u1"), ("key", "<i8"), ("text", "<u8"), ("at", "<i4")])


def encode_run(suffixes: list[bytes], lefts: list[bytes], places: list[tuple[int, int, int]]) -> bytes:
    """A front-coded run of sorted suffixes."""
    n = len(suffixes)
    entries = np.zeros(n, _ENTRY)
    size = np.fromiter(map(len, suffixes), np.int64, n)
    matrix = np.frombuffer(b"".join(s.ljust(WINDOW, b"\0") for s in suffixes), np.uint8).reshape(n, WINDOW)
    lcp = np.zeros(n, np.int64)
    if n > 1:
        differ = matrix[1:] != matrix[:-1]
        lcp[1:] = np.where(differ.any(axis=1), differ.argmax(axis=1), WINDOW)
        lcp[1:] = np.minimum(lcp[1:], np.minimum(size[1:], size[:-1]))
    entries["lcp"], entries["right"], entries["left"] = lcp, size, np.fromiter(map(len, lefts), np.int64, n)
    for k, name in enumerate(("key", "text", "at")):
        entries[name] = np.array([p[k] for p in places], entries.dtype[name])
    body = b"".join(s[c:] for s, c in zip(suffixes, lcp.tolist())) + b"".join(lefts)
    return n.to_bytes(4, "little") + entries.tobytes() + body


def decode_run(raw: bytes) -> Iterator[tuple[int, bytes, bytes, tuple[int, int, int]]]:
    """(common prefix with the one before, suffix, left, place) in order."""
    n = int.from_bytes(raw[:4], "little")
    entries = np.frombuffer(raw, _ENTRY, n, 4)
    at = 4 + entries.nbytes
    rest = entries["right"].astype(np.int64) - entries["lcp"]
    left_at = at + int(rest.sum())
    last = b""
    columns = (entries[c].tolist() for c in ("lcp", "right", "left", "key", "text", "at"))
    for lcp, right, left, key, text, pos in zip(*columns):
        last = last[:lcp] + raw[at : at + right - lcp]
        at += right - lcp
        yield lcp, last, raw[left_at : left_at + left], (key, text, pos)
        left_at += left


class LoserTree:
    """k-way merge that carries common-prefix lengths.

    ``known[r]`` is the common prefix of run r's head with the last string put
    out. Of two heads the one with the longer known prefix is smaller and nothing
    is compared; at equal lengths comparison starts behind the known prefix, and
    the loser keeps the length found."""

    def __init__(self, runs: list[Iterator[tuple]]) -> None:
        self.runs = runs
        self.size = 1 << max(len(runs) - 1, 0).bit_length()
        self.heads: list[tuple | None] = [next(r, None) for r in runs] + [None] * (self.size - len(runs))
        self.known = [0] * self.size
        self.losers = [0] * self.size
        self.compared = 0  # bytes looked at, for tests
        winners = list(range(self.size))
        node = self.size
        while len(winners) > 1:
            node //= 2
            played = [self._play(a, b) for a, b in zip(winners[::2], winners[1::2])]
            self.losers[node : 2 * node] = [loser for _, loser in played]
            winners = [w for w, _ in played]
        self.winner = winners[0]

    def _play(self, a: int, b: int) -> tuple[int, int]:
        if self.heads[b] is None:
            return a, b
        if self.heads[a] is None:
            return b, a
        known = self.known
        if known[a] != known[b]:
            return (a, b) if known[a] > known[b] else (b, a)
        x, y = self.heads[a][1], self.heads[b][1]
        at, stop = known[a], min(len(x), len(y))
        step = at
        while step < stop and x[step : step + 16] == y[step : step + 16]:
            step += 16
        step = min(step, stop)
        while step < stop and x[step] == y[step]:
            step += 1
        self.compared += step - at + 1
        if step == stop:
            a, b = (a, b) if len(x) <= len(y) else (b, a)
        elif x[step] > y[step]:
            a, b = b, a
        known[b] = step
        return a, b

    def __iter__(self) -> Iterator[tuple]:
        """(common prefix with the one before, suffix, left, place) over all runs, sorted."""
        heads, known, losers = self.heads, self.known, self.losers
        winner = self.winner
        while heads[winner] is not None:
            head = heads[winner]
            yield known[winner], head[1], head[2], head[3]
            nxt = heads[winner] = next(self.runs[winner], None)
            known[winner] = nxt[0] if nxt else 0
            node = (winner + self.size) // 2
            while node:
                winner, losers[node] = self._play(winner, losers[node])
                node //= 2


def _common_suffix(x: bytes, y: bytes) -> int:
    n, stop = 0, min(len(x), len(y))
    while n < stop and x[len(x) - n - 1] == y[len(y) - n - 1]:
        n += 1
    return n


def marked(group: list[tuple]) -> Iterator[tuple[int, int, int, int]]:
    """(key, text, begin, end) of what repeats in a group of suffixes with one
    anchor, in merged order. All windows of one suffix hold the anchor, so their
    union is one interval."""
    if len(group) == 2:
        (_, x, left_x, at_x), (lcp, y, left_y, at_y) = group
        if at_x == at_y:
            return
        left = _common_suffix(left_x, left_y)
        if lcp + left >= WINDOW:
            key, text, at = max(at_x, at_y)
            yield key, text, at - left, at + lcp
        return
    lcps = [g[0] for g in group]
    lcps[0] = 0
    low, high = {}, {}
    for o in range(max(0, WINDOW - max(lcps)), SPAN):
        need, number, best = WINDOW - o, 0, {}
        for k, (_, right, left, place) in enumerate(group):
            if lcps[k] < need:
                number += 1
            if len(right) < need or len(left) < o:
                continue
            at = (number, left[len(left) - o :])
            first = best.get(at)
            if first is None:
                best[at] = k
                continue
            if group[first][3] > place:
                best[at], k = k, first
            elif group[first][3] == place:
                continue  # a row that is there twice is one document
            low.setdefault(k, o)
            high[k] = o
    for k in low:
        key, text, at = group[k][3]
        yield key, text, at - high[k], at - low[k] + WINDOW


def merged_intervals(blobs: list[bytes]) -> list[tuple[int, int, int, int]]:
    out: list[tuple[int, int, int, int]] = []
    group: list[tuple] = []
    for item in LoserTree([decode_run(b) for b in blobs]):
        if item[0] < GRAM:
            if len(group) > 1:
                out += marked(group)
            group = [item]
        else:
            group.append(item)
    if len(group) > 1:
        out += marked(group)
    return out


def window_runs(contexts: list[tuple[bytes, bytes, tuple[int, int, int]]], ranges: int) -> tuple[dict[int, bytes], list[tuple[int, int, int, int]]]:
    """By range a run of the contexts' distinct windows at their earliest places, and
    the intervals that are settled here."""
    best: dict[bytes, tuple[int, int, int]] = {}
    settled = []
    for right, left, (key, text, at) in contexts:
        for o in range(max(0, WINDOW - len(right)), min(SPAN - 1, len(left)) + 1):
            window, place = left[len(left) - o :] + right[: WINDOW - o], (key, text, at - o)
            first = best.setdefault(window, place)
            if first == place:
                continue
            if first > place:
                best[window], place = place, first
            settled.append((*place, place[2] + WINDOW))
    rows: dict[int, list[bytes]] = {}
    for w in sorted(best):
        rows.setdefault(xxhash.xxh32_intdigest(w, 1) % ranges, []).append(w)
    return {r: encode_run(own, [b""] * len(own), [best[w] for w in own]) for r, own in rows.items()}, settled


def repeated_windows(blobs: list[bytes]) -> list[tuple[int, int, int, int]]:
    """Intervals of all places of a window but the earliest, from the merged runs."""
    out: list[tuple[int, int, int, int]] = []
    first = (0, 0, 0)
    for lcp, _, _, place in LoserTree([decode_run(b) for b in blobs]):
        if lcp < WINDOW:
            first = place
        elif place != first:
            first, place = min(first, place), max(first, place)
            out.append((*place, place[2] + WINDOW))
    return out


def build_runs(keys: np.ndarray, texts: list[bytes], positions: list[bytes | None], ranges: int, hot: np.ndarray) -> dict[int, list]:
    """For each range [run, intervals, windows] of the suffixes at the given positions."""
    contexts: dict[tuple[bytes, bytes], tuple[int, int, int]] = {}
    settled: list[tuple[int, int, int, int]] = []
    for key, raw, places in zip(keys.tolist(), texts, positions):
        if not places:
            continue
        text = xxhash.xxh64_intdigest(raw)
        for at in np.frombuffer(places, "<i4").tolist():
            right = raw[at : at + WINDOW]
            if len(right) < GRAM:  # of another text with this key
                continue
            left, place = raw[max(0, at - SPAN + 1) : at], (key, text, at)
            first = contexts.setdefault((right, left), place)
            if first == place:
                continue
            if first > place:
                contexts[right, left], (key_, text_, at_) = place, first
            else:
                key_, text_, at_ = place
            if len(left) + len(right) >= WINDOW:
                settled.append((key_, text_, at_ - len(left), at_ + len(right)))
    rows: dict[int, list] = {}
    if len(hot) and contexts:
        grams = np.frombuffer(b"".join(c[0][:GRAM] for c in contexts), np.uint8)
        split = np.isin(gram_hashes(grams)[::GRAM], hot)
        apart = [(*c, contexts[c]) for c, x in zip(list(contexts), split.tolist()) if x]
        for c in apart:
            del contexts[c[0], c[1]]
        windows, more = window_runs(apart, ranges)
        rows = {r: [b"", b"", w] for r, w in windows.items()}
        settled += more
    order = sorted((xxhash.xxh32_intdigest(c[0][:GRAM]) % ranges, *c) for c in contexts)
    begin = 0
    while begin < len(order):
        end, r = begin, order[begin][0]
        while end < len(order) and order[end][0] == r:
            end += 1
        own = order[begin:end]
        rows.setdefault(r, [b"", b"", b""])[0] = encode_run([o[1] for o in own], [o[2] for o in own], [contexts[o[1], o[2]] for o in own])
        begin = end
    if settled:
        table = np.array(settled, _INTERVAL)
        for r, (piece,) in _by_range(_range_of(table["key"].view("<u8"), ranges), table):
            rows.setdefault(r, [b"", b"", b""])[1] = piece.tobytes()
    return rows


def repeats(docs: DataFrame, key: str, text_col: str, keyed: DataFrame, ranges: int) -> DataFrame:
    """(key, spans): for each key the intervals to remove. ``keyed`` are all
    columns of the documents, dealt by ``key``."""
    place_key, pos = fresh(["place_key", "pos"], keyed.columns)
    places, hot = repeated_anchors(docs, key, text_col, ranges)
    places = places.withColumnsRenamed({"key": place_key, "pos": pos})
    joined = keyed.join(places.hint("shuffle_hash"), F.col(key) == F.col(place_key), "left")
    key_at, text_at, pos_at = joined.columns.index(key), joined.columns.index(text_col), joined.columns.index(pos)

    def build(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        squeeze = zstandard.ZstdCompressor(level=1).compress
        for held, texts in _gather(batches, text_at, RUN_BYTES):
            positions = [p for b in held for p in b.column(pos_at).to_pylist()]
            rows = build_runs(_column(held, key_at), texts, positions, ranges, hot)
            yield _blobs({"r": list(rows)} | {n: [squeeze(v[k]) for v in rows.values()] for k, n in enumerate(("run", "settled", "windows"))})

    def merge(table: pa.Table) -> pa.Table:
        spread = zstandard.ZstdDecompressor().decompress
        runs = [r for r in map(spread, table.column("run").to_pylist()) if r]
        found = np.array(merged_intervals(runs), _INTERVAL)
        known = np.frombuffer(b"".join(map(spread, table.column("settled").to_pylist())), _INTERVAL)
        windows = [w for w in map(spread, table.column("windows").to_pylist()) if w]
        found = np.concatenate((found, np.array(repeated_windows(windows), _INTERVAL)))
        return _dealt(np.concatenate((found, known)), "key", ranges)

    def unite(table: pa.Table) -> pa.Table:
        """One row for each document: its maximal intervals."""
        rows = np.frombuffer(b"".join(table.column("rows").to_pylist()), _INTERVAL)
        rows = rows[np.lexsort((rows["begin"], rows["text"], rows["key"]))]
        if len(rows):
            same = np.concatenate(([False], (rows["key"][1:] == rows["key"][:-1]) & (rows["text"][1:] == rows["text"][:-1])))
            # begins are shifted apart by document, so that one running maximum serves all
            shift = np.cumsum(~same).astype(np.int64) << 33
            reach = np.maximum.accumulate(rows["end"] + shift)
            first = np.concatenate(([True], rows["begin"][1:] + shift[1:] > reach[:-1]))
            ends = np.append(np.nonzero(first)[0][1:], len(rows)) - 1
            upto = reach[ends] - shift[ends]
            rows = rows[first]
            rows["end"] = upto
        keys, parts = _split(rows, "key")
        return pa.table({"_key": keys, "_spans": pa.array([p.tobytes() for p in parts], pa.binary())})

    runs = joined.mapInArrow(build, "r int, run binary, settled binary, windows binary")
    return runs.groupBy("r").applyInArrow(merge, "b int, rows binary").groupBy("b").applyInArrow(unite, "_key long, _spans binary")


def remove_repeats(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> tuple[DataFrame, dict[str, str]]:
    """All columns of ``docs`` with the text cut, and behind them n_bytes, n_removed,
    n_spans, kept_sha256 (under the names of the returned dictionary).

    The digest is of the remaining bytes; the cut text leaves out what removal has
    left of a torn character. A null text is empty in the digest and stays null.
    Ids should be integers; null ids come first. Rows with equal ids and different
    texts are ordered by a hash of the text; rows equal in both count as one
    document, and each gets its result.
    """
    n_bytes = docs.agg(F.sum(F.octet_length(F.col(f"`{text_col}`")))).first()[0] or 0
    ranges = max(shuffle_partitions(docs.sparkSession), -(-n_bytes // RANGE_BYTES))
    key, span_key, span_col, *new = fresh(["k", "span_key", "spans", "n_bytes", "n_removed", "n_spans", "kept_sha256"], docs.columns)
    named = dict(zip(("n_bytes", "n_removed", "n_spans", "kept_sha256"), new))
    with_key = docs.withColumn(key, F.coalesce(F.col(f"`{id_col}`").cast("long"), F.lit(NULL_ID)))
    keyed = with_key.repartition(ranges, key)  # the texts' one exchange, used by both joins
    spans = repeats(with_key, key, text_col, keyed, ranges).withColumnsRenamed({"_key": span_key, "_spans": span_col})
    joined = keyed.join(spans.hint("shuffle_hash"), F.col(key) == F.col(span_key), "left")
    names = docs.columns
    text_at, spans_at, n = joined.columns.index(text_col), joined.columns.index(span_col), len(names)

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows, texts = [], []
            for raw, spans in zip(as_bytes(batch.column(text_at)), batch.column(spans_at).to_pylist()):
                whole, gone = raw or b"", []
                if spans:
                    table = np.frombuffer(spans, _INTERVAL)
                    table = table[table["text"] == xxhash.xxh64_intdigest(whole)]
                    gone = list(zip(table["begin"].tolist(), table["end"].tolist()))
                kept, at = [], 0
                for a, b in gone:
                    kept.append(whole[at:a])
                    at = b
                kept = b"".join([*kept, whole[at:]])
                rows.append((len(whole), sum(b - a for a, b in gone), len(gone), hashlib.sha256(kept).hexdigest()))
                texts.append(None if raw is None else kept.decode("utf-8", "ignore") if gone else whole.decode("utf-8", "replace"))
            cols = list(zip(*rows)) or [()] * 4
            old = list(batch.columns[:n])
            old[text_at] = pa.array(texts, pa.string())
            yield pa.RecordBatch.from_arrays([*old, *(pa.array(c, k) for c, k in zip(cols, (pa.int64(), pa.int64(), pa.int64(), pa.string())))], names=[*names, *new])

    kinds = [f"`{c}` {'string' if c == text_col else docs.schema[c].dataType.simpleString()}" for c in docs.columns]
    kinds += [f"`{c}` {'string' if k == 'kept_sha256' else 'long'}" for k, c in named.items()]
    return joined.mapInArrow(cut, ", ".join(kinds)), named


def cut_texts(docs: DataFrame) -> DataFrame:
    """The documents with repeats cut out of their texts. Documents of which
    nothing is left go; others keep their columns, n_chars as it was."""
    out, named = remove_repeats(docs)
    gone = (F.col(named["n_removed"]) > 0) & (F.col(named["n_removed"]) == F.col(named["n_bytes"]))
    return out.filter(~gone).select(*(F.col(f"`{c}`") for c in docs.columns))


def op3_suffix_dedup(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    out, _ = remove_repeats(docs)
    return out.select("doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256")


def oracle_sql() -> str:
    """Every window of every text by its first place; the later ones' bytes in runs; what stands between these."""
    return f"""
WITH d AS (SELECT doc_id, encode(coalesce(text, '')) AS b, octet_length(encode(coalesce(text, ''))) AS n FROM documents),
w AS (SELECT doc_id, k, array_slice(b, k, k + {WINDOW - 1}) AS w FROM (SELECT doc_id, b, unnest(range(1, n - {WINDOW - 2})) AS k FROM d)),
again AS (SELECT doc_id, k FROM w QUALIFY row_number() OVER (PARTITION BY w ORDER BY doc_id, k) > 1),
begun AS (SELECT doc_id, k, coalesce(k > lag(k) OVER (PARTITION BY doc_id ORDER BY k) + {WINDOW}, true)::INT AS one FROM again),
runs AS (SELECT doc_id, min(k) AS a, max(k) + {WINDOW - 1} AS z FROM (SELECT doc_id, k, sum(one) OVER (PARTITION BY doc_id ORDER BY k) AS run FROM begun) GROUP BY doc_id, run),
ends AS (SELECT doc_id, a, z, true AS cut FROM runs UNION ALL SELECT doc_id, n + 1, n + 1, false FROM d),
parts AS (SELECT *, coalesce(lag(z) OVER (PARTITION BY doc_id ORDER BY a), 0) AS upto FROM ends),
kept AS (SELECT doc_id, n, coalesce(sum(z - a + 1) FILTER (cut), 0) AS n_removed, count(*) FILTER (cut) AS n_spans,
  string_agg(CASE WHEN a > upto + 1 THEN hex(array_slice(b, upto + 1, a - 1)) ELSE '' END, '' ORDER BY a) AS bytes FROM parts JOIN d USING (doc_id) GROUP BY doc_id, n)
SELECT doc_id, n::BIGINT AS n_bytes, n_removed::BIGINT AS n_removed, n_spans::BIGINT AS n_spans, sha256(unhex(bytes)) AS kept_sha256 FROM kept"""
