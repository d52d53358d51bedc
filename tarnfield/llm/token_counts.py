"""Token counts with a linear longest-match automaton.

Greedy word-piece segmentation only has to be *counted* here, so pieces are
never built. The vocabulary is a byte trie; every node carries a failure link
and the number of tokens popped when it is followed, as in linear-time
MaxMatch: on a mismatch at node v the longest-match pieces of v's string are
popped (a precomputed count) and the walk continues at ``fail[v]``, the node of
what remains. Each byte is read once.
"""

from __future__ import annotations

import json
from collections.abc import Iterable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame

from tarnfield.llm.text import as_bytes

VOCABULARY = "/opt/tokenizers/byte_bpe_50k.json"
SPACE_MARK = b" "
#: Bytes of distinct words whose counts one worker remembers before it starts afresh,
#: and what a word takes besides its own bytes. Longer words are counted each time.
MEMO_BYTES, ENTRY_BYTES, LONGEST = 1 << 26, 120, 256


class Memo(dict):
    """Counts of words, with the bytes that they take."""

    held = 0

    def learn(self, word: bytes, count: int) -> None:
        if self.held > MEMO_BYTES:
            self.clear()
            self.held = 0
        self[word] = count
        self.held += len(word) + ENTRY_BYTES


def byte_alphabet() -> dict[str, int]:
    """The printable stand-ins of byte-level vocabularies, by rule: printable
    Latin-1 stands for itself, the rest is numbered from U+0100 on."""
    own = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in set(own)]
    return {chr(b): b for b in own} | {chr(256 + i): b for i, b in enumerate(rest)}


def load_vocabulary(path: str = VOCABULARY) -> list[bytes]:
    """Pieces of a byte-level vocabulary file as bytes; a space marks a word's start."""
    alphabet = byte_alphabet()
    with open(path, encoding="utf-8") as f:
        model = json.load(f)["model"]["vocab"]
    return [bytes(alphabet[c] for c in piece) for piece in model if all(c in alphabet for c in piece)]


class LongestMatch:
    """Trie with failure links and popped-token counts.

    ``children[v]`` maps a byte to a node, ``fail[v]`` is the node reached after
    popping ``pops[v]`` tokens from v's string (-1: the string cannot be split).
    Bytes that no piece covers count one token each.
    """

    def __init__(self, pieces: Iterable[bytes]) -> None:
        self.children: list[dict[int, int]] = [{}]
        final = [False]
        parents: list[tuple[int, int]] = [(0, 0)]
        for piece in pieces:
            at = 0
            for byte in piece:
                step = self.children[at].get(byte)
                if step is None:
                    step = len(self.children)
                    self.children[at][byte] = step
                    self.children.append({})
                    final.append(False)
                    parents.append((at, byte))
                at = step
            final[at] = bool(piece) or final[at]
        self.final = final
        n = len(self.children)
        self.fail, self.pops = [-1] * n, [0] * n
        level = [0]
        while level:  # breadth first: what a link needs is shorter
            nxt = []
            for v in level:
                for byte, u in self.children[v].items():
                    nxt.append(u)
                    if final[u]:
                        self.fail[u], self.pops[u] = 0, 1
                        continue
                    z, popped = self.fail[v], self.pops[v]
                    while z >= 0 and byte not in self.children[z]:
                        popped += self.pops[z]
                        z = self.fail[z]
                    if z >= 0:
                        self.fail[u], self.pops[u] = self.children[z][byte], popped
            level = nxt

    def count(self, word: bytes) -> int:
        """Tokens of the greedy longest-match segmentation of ``word``."""
        children, fail, pops = self.children, self.fail, self.pops
        at = tokens = 0
        for byte in word:
            step = children[at].get(byte)
            while step is None:
                if at == 0:  # no piece begins with this byte: a token of its own
                    tokens += 1
                    step = 0
                    break
                if fail[at] < 0:
                    return self.by_rescan(word)
                tokens += pops[at]
                at = fail[at]
                step = children[at].get(byte)
            at = step
        while at:
            if fail[at] < 0:
                return self.by_rescan(word)
            tokens += pops[at]
            at = fail[at]
        return tokens

    def by_rescan(self, word: bytes) -> int:
        """The same count by restarting at every piece, byte by byte where
        nothing matches (vocabularies that lack single bytes)."""
        tokens = i = 0
        while i < len(word):
            at, last = 0, i + 1
            for j in range(i, len(word)):
                at = self.children[at].get(word[j], -1)
                if at < 0:
                    break
                if self.final[at]:
                    last = j + 1
            tokens, i = tokens + 1, last
        return tokens


_automata: dict[str, tuple[LongestMatch, Memo]] = {}


def _automaton(path: str) -> tuple[LongestMatch, Memo]:
    if path not in _automata:
        _automata[path] = (LongestMatch(load_vocabulary(path)), Memo())
    return _automata[path]


def count_tokens(raw: bytes | None, automaton: LongestMatch, memo: Memo) -> tuple[int, int]:
    """Words and tokens of a text; a word is looked up once per worker."""
    words = (raw or b"").split()
    counts = list(map(memo.get, words))
    if None in counts:
        for k, word in enumerate(words):
            if counts[k] is None:
                n = memo.get(word)
                if n is None:
                    n = automaton.count(SPACE_MARK + word)
                    if len(word) <= LONGEST:
                        memo.learn(word, n)
                counts[k] = n
    return len(words), sum(counts)


def token_counts(docs: DataFrame, vocabulary: str = VOCABULARY, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per input row: id, ``n_words``, ``n_tokens``.

    No shuffle. A null or empty text has 0 words and 0 tokens; repeated rows are
    counted each; other columns are ignored, whatever their names; a very long text or
    word costs its length, and is not remembered. ``vocabulary``
    is a path that every executor can open (an installed file).
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        automaton, memo = _automaton(vocabulary)
        for batch in batches:
            counts = [count_tokens(raw, automaton, memo) for raw in as_bytes(batch.column(1))]
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array([c[0] for c in counts], pa.int64()), pa.array([c[1] for c in counts], pa.int64())],
                names=[id_col, "n_words", "n_tokens"],
            )

    kind = docs.schema[id_col].dataType.simpleString()
    return docs.select(id_col, text_col).mapInArrow(run, f"`{id_col}` {kind}, n_words long, n_tokens long")


def op1_token_counts(spark, sf_dir: str) -> DataFrame:
    return token_counts(spark.read.parquet(f"{sf_dir}/documents.parquet"))
