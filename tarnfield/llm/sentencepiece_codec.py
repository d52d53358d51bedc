"""SentencePiece encoding and decoding by suffix-array matching.

The distinct chunks of a batch (runs that no piece reaches out of) are laid one
behind the other and indexed by a suffix array. Every piece of the vocabulary is
looked up by binary search, which gives the range of suffixes it begins, that is
all its occurrences at once. The resulting edges are sorted by position and
relaxed from left to right.

The model merges neighbours, best rank first and leftmost of equals. Of a text
encoded so, every prefix that ends where a piece ends is encoded by its own pieces,
so each position has one last piece, and an edge relaxes its end if its piece can
stand behind the last piece of its begin: if merging the two side by side never
crosses between them. That is read from how each of both came about (``Merges``),
for many pairs at once. What is left at the end is the model's own encoding.

Spaces become U+2581 with one more in front; characters that no piece has, and a
U+2581 in the text itself, go through the byte pieces, so decoding is exact.
"""

from __future__ import annotations

import hashlib
import re
from array import array
from collections.abc import Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tarnfield.llm.tables import fresh
from tarnfield.llm.text import as_bytes, slices

MODEL = "/opt/tokenizers/piece_bpe_32k.model"
MARK = "\u2581".encode()
#: Bytes of text that are chunked at once (each chunk is an object of some ten times its
#: size), bytes of chunks that one suffix array indexes, and bytes of chunks and ids that a
#: worker remembers, which it holds on to while it runs other operators.
TEXT_BYTES, INDEX_BYTES, MEMO_BYTES = 1 << 19, 1 << 17, 5 << 23
#: What an entry of the memo takes besides its contents.
ENTRY_BYTES = 150
#: Longest chunk, in bytes, that is relaxed side by side with others; pairs of
#: pieces whose fit is remembered for the longer ones.
TOGETHER, MEMO_PAIRS = 64, 1 << 18
NEVER = 1 << 40


class Merges:
    """How each piece comes about, and which pieces can stand side by side.

    Pieces are numbered; ``count`` stands for a character without a piece and
    ``count + 1`` for the begin of a chunk, which merge with nothing."""

    def __init__(self, pieces: list[bytes], ranks: list[int]) -> None:
        rank = dict(zip(pieces, ranks))
        number = {p: k for k, p in enumerate(pieces)}
        n = self.count = len(pieces)
        self.left, self.right = (np.full(n + 2, -1, np.int64) for _ in range(2))
        self.time = np.full(n + 2, -1, np.int64)  # when a piece is there at the earliest; characters always
        self.reached = np.zeros(n, bool)
        pairs: dict[int, int] = {}
        for p in sorted(pieces, key=lambda x: (len(x), x)):
            k, chars = number[p], [c.encode() for c in p.decode()]
            parts, last = chars[:], None
            while len(parts) > 1:
                r, at = min((rank.get(parts[i] + parts[i + 1], NEVER), i) for i in range(len(parts) - 1))
                if r == NEVER:
                    break
                last = parts[at], parts[at + 1]
                parts[at : at + 2] = [parts[at] + parts[at + 1]]
            self.reached[k] = len(parts) == 1
            if last and self.reached[k]:
                self.left[k], self.right[k] = (number[x] for x in last)
                self.time[k] = max(rank[p], self.time[self.left[k]], self.time[self.right[k]])
            at = 0
            for c in chars[:-1]:
                at += len(c)
                if p[:at] in number and p[at:] in number:
                    pairs[number[p[:at]] * (n + 2) + number[p[at:]]] = rank[p]
        self.keys = np.array(sorted(pairs), np.int64)
        self.pair_rank = np.array([pairs[k] for k in self.keys.tolist()], np.int64)
        self.known: dict[int, bool] = {}

    def fit(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """Whether b can stand behind a. Both are taken apart again, what came last first;
        all that stood side by side at some time must have been taken away before it could merge."""
        out = np.ones(len(a), bool)
        if not len(self.keys):
            return out
        at, x, y = np.arange(len(a)), a.astype(np.int64), b.astype(np.int64)
        until_x, until_y = (np.full(len(a), NEVER, np.int64) for _ in range(2))
        while len(at):
            key = x * (self.count + 2) + y
            place = np.minimum(np.searchsorted(self.keys, key), len(self.keys) - 1)
            r = np.where(self.keys[place] == key, self.pair_rank[place], NEVER)
            crossed = (r < until_x) & (r <= until_y)
            out[at[crossed]] = False
            tx, ty = self.time[x], self.time[y]
            undo_x = tx > ty
            until_x, until_y = np.where(undo_x, tx, until_x), np.where(undo_x, until_y, ty)
            goes_on = ~crossed & (np.maximum(tx, ty) >= 0)
            x, y = np.where(undo_x, self.right[x], x), np.where(undo_x, y, self.left[y])
            at, x, y, until_x, until_y = (v[goes_on] for v in (at, x, y, until_x, until_y))
        return out

    def fits(self, a: int, b: int) -> bool:
        """The same for one pair, remembered."""
        key = a * (self.count + 2) + b
        known = self.known.get(key)
        if known is None:
            if len(self.known) >= MEMO_PAIRS:
                self.known.clear()
            known = self.known[key] = bool(self.fit(np.array([a]), np.array([b]))[0])
        return known


class PieceCodec:
    """Vocabulary and merge ranks of a model file, an encoder and a decoder."""

    def __init__(self, path: str = MODEL) -> None:
        import sentencepiece

        model = sentencepiece.SentencePieceProcessor(model_file=path)
        normal, self.byte_ids, self.shown = [], {}, []
        for i in range(model.get_piece_size()):
            piece = model.id_to_piece(i)
            if model.is_byte(i):
                self.byte_ids[int(piece[3:5], 16)] = i
                self.shown.append(bytes([int(piece[3:5], 16)]))
            elif model.is_control(i) or model.is_unknown(i) or model.is_unused(i):
                self.shown.append(b"")
            else:
                normal.append((piece.encode(), i, model.get_score(i)))
                self.shown.append(piece.encode().replace(MARK, b" "))
        if len(self.byte_ids) != 256:
            raise ValueError("the model needs byte pieces, or decoding cannot be exact")
        if not all(float(s).is_integer() for _, _, s in normal):
            raise ValueError("the model's scores must be merge ranks")
        normal.sort()
        merges = self.merges = Merges([p for p, _, _ in normal], [int(-s) for _, _, s in normal])
        self.pieces = {p: i for p, i, _ in normal}
        if not all(c.encode() in self.pieces for p in self.pieces for c in p.decode()):
            raise ValueError("each character of a piece must be a piece")
        self.longest = max(map(len, self.pieces))
        #: pieces that can be met, in order; ids by number, and -1 for a character without a piece
        self.number = np.nonzero(merges.reached)[0]
        names = [normal[k][0] for k in self.number]
        self.names = np.array(names, f"S{self.longest}")
        self.behind = np.array([n + b"\xff" * (self.longest - len(n)) for n in names], f"S{self.longest}")
        self.lengths = np.array([len(n) for n in names])
        self.single = np.array([len(n.decode()) == 1 for n in names])
        self.id_of = np.array([*(i for _, i, _ in normal), -1, -1])
        inside = {c for p in self.pieces for c in p}
        lone = bytes(b for b in range(128) if b not in inside)  # ASCII that only byte pieces have
        # does any piece have a mark behind something else? then only whole texts are chunks
        crossing = any(not p.startswith(MARK * p.count(MARK)) for p in self.pieces)
        stop = b" " + re.escape(lone.replace(b" ", b""))
        self.chunker = None if crossing else re.compile(rb" +[^%s]*|[^%s]+|[%s]" % (stop, stop, stop))
        self.byte_table = np.array([self.byte_ids[_HIDDEN.get(b, b)] for b in range(256)])
        #: ids of each chunk as packed 32-bit integers
        self.memo: dict[bytes, bytes] = {}
        self.older: dict[bytes, bytes] = {}
        self.held = 0

    def chunks(self, raw: bytes) -> list[bytes]:
        """Runs that no piece reaches out of; spaces are still spaces, and a U+2581 of
        the text itself is hidden as bytes that UTF-8 never has."""
        if not raw:
            return []
        text = b" " + (raw.replace(MARK, b"\xff\xfe\xfd") if MARK in raw else raw)
        return self.chunker.findall(text) if self.chunker else [text]

    def encode_chunks(self, chunks: list[bytes]) -> None:
        """Encode into the memo, some INDEX_BYTES at a time. Short chunks are relaxed
        side by side, the others one position at a time."""
        for relax, some in ((self._relax_together, [c for c in chunks if len(c) <= TOGETHER]), (self._relax, [c for c in chunks if len(c) > TOGETHER])):
            group, size = [], 0
            for c in some:
                group.append(c)
                size += len(c) + 1
                if size >= INDEX_BYTES:
                    self._index(group, relax)
                    group, size = [], 0
            if group:
                self._index(group, relax)

    def _index(self, chunks: list[bytes], relax) -> None:
        marked = [c.replace(b" ", MARK) for c in chunks]
        text = b"\x00".join(marked) + b"\x00"
        begins, pieces, most = [], [], 2 * INDEX_BYTES
        for at in range(0, len(text), most):  # one part, unless a chunk is very long
            begin, piece = self._occurrences(text[at : at + most + self.longest])
            own = begin < most
            begins.append(begin[own] + at)
            pieces.append(piece[own])
        begin, piece = np.concatenate(begins), np.concatenate(pieces)
        relax(text, chunks, marked, begin, piece)

    def _occurrences(self, text: bytes) -> tuple[np.ndarray, np.ndarray]:
        """Where every piece occurs in a text: the suffixes it begins are neighbours in the suffix array."""
        n, width = len(text), self.longest
        padded = np.frombuffer(text + b"\x00" * width, np.uint8)
        keys = np.ascontiguousarray(np.lib.stride_tricks.sliding_window_view(padded, width)[:n]).view(f"S{width}")[:, 0]
        suffixes = np.argsort(keys, kind="stable")
        ordered = keys[suffixes]
        low = np.searchsorted(ordered, self.names, "left")
        count = np.searchsorted(ordered, self.behind, "right") - low
        which = np.nonzero(count)[0]
        low, count = low[which], count[which]
        nth = np.arange(count.sum()) - np.repeat(np.cumsum(count) - count, count)
        return suffixes[np.repeat(low, count) + nth], np.repeat(which, count)

    def _edges(self, text: bytes, begin: np.ndarray, piece: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Begin, end and number of all edges: the pieces' and one for each character without a piece."""
        raw = np.frombuffer(text, np.uint8)
        head = np.nonzero((raw != 0) & ((raw & 0xC0) != 0x80))[0]  # where characters begin
        first = raw[head]
        width = np.where((first < 0x80) | (first >= 0xFD), 1, np.where(first < 0xE0, 2, np.where(first < 0xF0, 3, 4)))
        known = np.zeros(len(raw) + 1, bool)
        known[begin[self.single[piece]]] = True
        lone = ~known[head]
        head, width = head[lone], width[lone]
        begin, number = np.concatenate((begin, head)), np.concatenate((self.number[piece], np.full(len(head), self.merges.count)))
        return begin, np.concatenate((begin[: len(piece)] + self.lengths[piece], head + width)), number

    def _relax_together(self, text: bytes, chunks: list[bytes], marked: list[bytes], begin: np.ndarray, piece: np.ndarray) -> None:
        """All edges that end at the same offset of their chunks are relaxed at once."""
        raw = np.frombuffer(text, np.uint8)
        size = np.fromiter(map(len, marked), np.int64, len(marked)) + 1
        starts = np.cumsum(size) - size
        begin, end, number = self._edges(text, begin, piece)
        offset = end - np.repeat(starts, size)[begin]
        order = np.lexsort((begin, end, offset))
        begin, end, number, offset = begin[order], end[order], number[order], offset[order]
        final = np.append(end[1:] != end[:-1], True)  # an end's last edge needs no test: one of them fits
        last = np.full(len(raw) + 1, self.merges.count + 1)
        back = np.zeros(len(raw) + 1, np.int64)
        cuts = np.searchsorted(offset, np.arange(TOGETHER * len(MARK) + 2))
        for a, b in zip(cuts[:-1].tolist(), cuts[1:].tolist()):
            if a == b:
                continue
            k = np.concatenate(([a], a + 1 + np.nonzero(final[a : b - 1])[0]))  # each end's longest edge, then the next
            while len(k):
                good = final[k]
                test = np.nonzero(~good)[0]
                good[test] = self.merges.fit(last[begin[k[test]]], number[k[test]])
                won = k[good]
                last[end[won]], back[end[won]] = number[won], begin[won]
                k = k[~good] + 1
        via = np.where(last <= self.merges.count, self.id_of[last], -1)
        # all chunks walk back from their ends at once, one piece a round
        who, q, walked = np.arange(len(chunks)), starts + size - 1, []
        while len(who):
            p = back[q]
            walked.append((who, p, q, via[q]))
            left = p > starts[who]
            who, q = who[left], p[left]
        who, p, q, ids = (np.concatenate(x) for x in zip(*walked))
        order = np.lexsort((p, who))
        who, p, q, ids = who[order], p[order], q[order], ids[order]
        width = np.where(ids >= 0, 1, q - p)  # a character without a piece takes one for each byte
        flat = np.repeat(ids, width)
        lone = np.nonzero(ids < 0)[0]
        if len(lone):
            w = width[lone]
            nth = np.arange(w.sum()) - np.repeat(np.cumsum(w) - w, w)
            flat[np.repeat((np.cumsum(width) - width)[lone], w) + nth] = self.byte_table[raw[np.repeat(p[lone], w) + nth]]
        packed = flat.astype(np.int32).tobytes()
        ends = (4 * np.cumsum(np.bincount(who, width, len(chunks)).astype(np.int64))).tolist()
        self.memo.update(zip(chunks, map(packed.__getitem__, map(slice, [0, *ends], ends))))
        self.held += len(packed) + sum(map(len, chunks)) + ENTRY_BYTES * len(chunks)

    def _relax(self, text: bytes, chunks: list[bytes], marked: list[bytes], begin: np.ndarray, piece: np.ndarray) -> None:
        """The same from left to right, one end after the other."""
        begin, end, number = self._edges(text, begin, piece)
        order = np.lexsort((begin, end))
        begin, end, number = begin[order].tolist(), end[order].tolist(), number[order].tolist()
        n, fits, none = len(text), self.merges.fits, self.merges.count + 1
        last, back = [none] * (n + 1), [0] * (n + 1)
        e, m = 0, len(end)
        while e < m:
            q = end[e]
            until = e + 1
            while until < m and end[until] == q:
                until += 1
            for k in range(e, until):
                if k == until - 1 or fits(last[begin[k]], number[k]):
                    last[q], back[q] = number[k], begin[k]
                    break
            e = until
        at = 0
        for c, m in zip(chunks, marked):
            out, q = [], at + len(m)
            while q > at:
                p = back[q]
                i = int(self.id_of[last[q]])
                out += [i] if i >= 0 else [self.byte_ids[_HIDDEN.get(b, b)] for b in reversed(text[p:q])]
                q = p
            self.memo[c] = array("i", out[::-1]).tobytes()
            self.held += len(c) + 4 * len(out) + ENTRY_BYTES
            at += len(m) + 1

    def encode_batch(self, texts: list[bytes | None]) -> list[array]:
        """Piece ids of each text (none for null or empty), some TEXT_BYTES at a time."""
        out: list[array] = []
        group, size = [], 0
        for t in texts:
            group.append(t or b"")
            size += len(group[-1])
            if size >= TEXT_BYTES:
                out += self._encode(group)
                group, size = [], 0
        return out + self._encode(group)

    def _encode(self, texts: list[bytes]) -> list[array]:
        split = list(map(self.chunks, texts))
        if self.held > MEMO_BYTES // 2:  # two generations: what is in use moves on
            self.memo, self.older, self.held = {}, self.memo, 0
        memo, older = self.memo, self.older
        new = {}
        for c in dict.fromkeys(chain.from_iterable(split)):
            if c not in memo:
                if (ids := older.get(c)) is not None:
                    memo[c] = ids
                    self.held += len(c) + len(ids) + ENTRY_BYTES
                else:
                    new[c] = None
        # a NUL separates chunks in the index, so one of the text's own is encoded by itself
        self.memo[b"\x00"] = array("i", [self.byte_ids[0]]).tobytes()
        new.pop(b"\x00", None)
        self.encode_chunks(list(new))
        get = self.memo.__getitem__
        return [array("i", b"".join(map(get, cs))) for cs in split]

    def decode(self, ids: array) -> bytes:
        return b"".join(map(self.shown.__getitem__, ids))[1:]


#: What stands for the bytes of a U+2581 of the text while its spaces are marked.
_HIDDEN = {0xFF: MARK[0], 0xFE: MARK[1], 0xFD: MARK[2]}
_codecs: dict[str, PieceCodec] = {}


def codec(path: str) -> PieceCodec:
    if path not in _codecs:
        _codecs[path] = PieceCodec(path)
    return _codecs[path]


def encode(docs: DataFrame, text_col: str = "text", model: str = MODEL) -> DataFrame:
    """All columns of ``docs`` and behind them ``piece_ids`` (array of int).

    A null or empty text has no pieces. Rows are encoded each, in whole; no
    shuffle. A clashing column name gets the new one an underscore in front.
    """
    out = fresh(["piece_ids"], docs.columns)[0]
    names = docs.columns
    at = names.index(text_col)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = codec(model)
        for batch in batches:
            for part in slices(batch, at, TEXT_BYTES):
                ids = own.encode_batch(as_bytes(part.column(at)))
                ends = np.cumsum([0, *map(len, ids)])
                flat = pa.array(np.frombuffer(b"".join(i.tobytes() for i in ids), np.int32))
                yield pa.RecordBatch.from_arrays([*part.columns, pa.ListArray.from_arrays(pa.array(ends, pa.int32()), flat)], names=[*names, out])

    kinds = [f"`{c}` {docs.schema[c].dataType.simpleString()}" for c in docs.columns]
    return docs.mapInArrow(run, ", ".join([*kinds, f"`{out}` array<int>"]))


def decode(rows: DataFrame, ids_col: str = "piece_ids", model: str = MODEL) -> DataFrame:
    """All columns and ``decoded``, the text of the pieces (null for null)."""
    out = fresh(["decoded"], rows.columns)[0]
    names = rows.columns
    at = names.index(ids_col)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = codec(model)
        for batch in batches:
            texts = [None if i is None else own.decode(i) for i in batch.column(at).to_pylist()]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(texts, pa.binary()).cast(pa.string())], names=[*names, out])

    kinds = [f"`{c}` {rows.schema[c].dataType.simpleString()}" for c in rows.columns]
    return rows.mapInArrow(run, ", ".join([*kinds, f"`{out}` string"]))


def encoding_digest(docs: DataFrame, model: str = MODEL) -> DataFrame:
    """One row per document: doc_id, n_pieces, n_bytes, ids_sha256 (of the ids as
    little-endian 32-bit integers), round_trip (decoding gives the text back)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = codec(model)
        for batch in batches:
            rows = []
            for part in slices(batch, 1, TEXT_BYTES):
                texts = as_bytes(part.column(1))
                for raw, ids in zip(texts, own.encode_batch(texts)):
                    rows.append((len(ids), len(raw or b""), hashlib.sha256(ids.tobytes()).hexdigest(), own.decode(ids) == (raw or b"")))
            cols = list(zip(*rows)) or [()] * 4
            kinds = (pa.int64(), pa.int64(), pa.string(), pa.bool_())
            yield pa.RecordBatch.from_arrays([batch.column(0), *(pa.array(c, k) for c, k in zip(cols, kinds))], names=["doc_id", "n_pieces", "n_bytes", "ids_sha256", "round_trip"])

    kind = docs.schema["doc_id"].dataType.simpleString()
    return docs.select("doc_id", "text").mapInArrow(run, f"doc_id {kind}, n_pieces long, n_bytes long, ids_sha256 string, round_trip boolean")


def op9_sentencepiece(spark, sf_dir: str) -> DataFrame:
    return encoding_digest(spark.read.parquet(f"{sf_dir}/documents.parquet"))
