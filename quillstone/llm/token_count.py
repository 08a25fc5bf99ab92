"""Token counts by a linear longest-match automaton (Song, Salcianu, Song, Dopson and Zhou, EMNLP 2021).

The vocabulary is a trie over bytes, with all single bytes in it, so every text can be split. A node has a failure link
and the number of tokens that greedy longest match has popped once it follows the link; both come from the trie alone.
A word's length in tokens is then one walk over its bytes: no byte is read twice and no piece is built.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from .text import Words, chunks

#: Words up to this many bytes are walked together, a byte place at a time; longer ones one by one.
TOGETHER = 64
MARK = "▁".encode()


def vocabulary(path: str | None = None) -> list[bytes]:
    """Pieces of a sentencepiece model file, without its control and byte pieces."""
    import public_tokenizers
    import sentencepiece

    sp = sentencepiece.SentencePieceProcessor(model_file=path or public_tokenizers.path("piece_bpe_32k.model"))
    return [sp.id_to_piece(i).encode() for i in range(sp.get_piece_size()) if not (sp.is_control(i) or sp.is_unknown(i) or sp.is_byte(i))]


class Automaton:
    """link: failure links; popped: tokens popped on the way; rest: tokens popped from a node to the end of a word."""

    def __init__(self, pieces: list[bytes]):
        child: dict[tuple[int, int], int] = {}
        nodes, whole, up = 1, {0: False}, [(0, 0)]
        for piece in [*(bytes([i]) for i in range(256)), *sorted(set(pieces) - {b""})]:
            at = 0
            for c in piece:
                nxt = child.get((at, c))
                if nxt is None:
                    nxt = child[at, c] = nodes
                    nodes += 1
                    up.append((at, c))
                at = nxt
            whole[at] = True
        depth = np.zeros(nodes, np.int64)
        for v in range(1, nodes):
            depth[v] = depth[up[v][0]] + 1
        self.link, self.popped, self.rest = np.zeros(nodes, np.int32), np.zeros(nodes, np.int32), np.zeros(nodes, np.int32)
        for v in np.argsort(depth, kind="stable")[1:].tolist():
            parent, c = up[v]
            if whole.get(v):
                self.popped[v] = 1
            else:  # the single byte under the root ends every chain
                z, n = int(self.link[parent]), int(self.popped[parent])
                while (z, c) not in child:
                    n += int(self.popped[z])
                    z = int(self.link[z])
                self.link[v], self.popped[v] = child[z, c], n
            self.rest[v] = self.popped[v] + self.rest[self.link[v]]
        self._hash(child)

    def _hash(self, child: dict) -> None:
        """Edges in an open-addressed table, so that arrays of states can step at once."""
        self.mask = (1 << (2 * len(child)).bit_length()) - 1
        self.keys, self.next = np.full(self.mask + 1, -1, np.int64), np.zeros(self.mask + 1, np.int32)
        key, value = np.array([v << 8 | c for v, c in child], np.int64), np.array(list(child.values()), np.int32)
        slot = self._slot(key)
        while len(key):
            free = self.keys[slot] < 0
            order = np.flatnonzero(free)
            first = order[np.unique(slot[order], return_index=True)[1]]
            self.keys[slot[first]], self.next[slot[first]] = key[first], value[first]
            left = np.ones(len(key), bool)
            left[first] = False
            taken = self.keys[slot] != key
            key, value, slot = key[left], value[left], np.where(taken, slot + 1, slot)[left] & self.mask

    def _slot(self, key):
        return ((key * 0x2545F4914F6CDD1D) >> 20) & self.mask

    def step(self, state: np.ndarray, byte: np.ndarray) -> np.ndarray:
        """Children of states by bytes; -1 where there is none."""
        key = state.astype(np.int64) << 8 | byte
        slot, out, open_ = self._slot(key), np.full(len(key), -1, np.int32), np.arange(len(key))
        while len(open_):
            held = self.keys[slot[open_]]
            hit = held == key[open_]
            out[open_[hit]] = self.next[slot[open_[hit]]]
            open_ = open_[~hit & (held >= 0)]
            slot[open_] = (slot[open_] + 1) & self.mask
        return out

    def walk(self, state: np.ndarray, total: np.ndarray, byte: np.ndarray) -> np.ndarray:
        """States after one more byte each; total gains the tokens popped."""
        todo, out = np.arange(len(state)), np.empty(len(state), np.int32)
        at = state.copy()
        while len(todo):
            nxt = self.step(at[todo], byte[todo])
            out[todo[nxt >= 0]] = nxt[nxt >= 0]
            todo = todo[nxt < 0]
            total[todo] += self.popped[at[todo]]
            at[todo] = self.link[at[todo]]
        return out

    def start(self, mark: bytes) -> tuple[int, int]:
        state, total = np.zeros(1, np.int32), np.zeros(1, np.int64)
        for c in mark:
            state = self.walk(state, total, np.array([c], np.uint8))
        return int(state[0]), int(total[0])

    def lengths(self, buf: np.ndarray, start: np.ndarray, end: np.ndarray, mark: bytes = MARK) -> np.ndarray:
        """Tokens of mark + buf[start:end] of each word."""
        state, total = (np.full(len(start), x, t) for x, t in zip(self.start(mark), (np.int32, np.int64), strict=True))
        size = end - start
        order = np.argsort(-np.minimum(size, TOGETHER + 1), kind="stable")
        long = int((size > TOGETHER).sum())
        order, sizes = order[long:], size[order[long:]]
        for j in range(int(sizes[0]) if len(sizes) else 0):
            now = order[: np.searchsorted(-sizes, -j, "left")]
            part = total[now]
            state[now] = self.walk(state[now], part, buf[start[now] + j])
            total[now] = part
        for w in np.flatnonzero(size > TOGETHER).tolist():
            total[w], state[w] = self._one(int(state[w]), int(total[w]), buf[start[w] : end[w]].tobytes())
        return total + self.rest[state]

    def _one(self, v: int, n: int, word: bytes) -> tuple[int, int]:
        edge = self.__dict__.setdefault("edges", None)
        if edge is None:
            used = self.keys >= 0
            edge = self.edges = dict(zip(self.keys[used].tolist(), self.next[used].tolist(), strict=True))
        link, popped = self.link, self.popped
        for c in word:
            while (z := edge.get(v << 8 | c)) is None:
                n, v = n + int(popped[v]), int(link[v])
            v = z
        return n, v


def _counted(a: Automaton, w: Words) -> tuple[np.ndarray, np.ndarray]:
    words = np.diff(w.bound)
    if not len(w.start):
        return words, np.zeros(len(words), np.int64)
    _, first, back = np.unique(w.hashes(), return_index=True, return_inverse=True)
    each = a.lengths(w.buf, w.start[first], w.end[first])[back]
    sums = np.concatenate(([0], np.cumsum(each)))
    return words, sums[w.bound[1:]] - sums[w.bound[:-1]]


def token_counts(docs: DataFrame, pieces: list[bytes] | None = None) -> DataFrame:
    """(doc_id, n_words, n_tokens) of every row of docs (doc_id, text, ...).

    Words are runs of characters other than ASCII white space; each, behind a word mark, is split by greedy longest
    match into pieces, and what no piece covers into bytes. Null or empty text has none. Repeated rows count alike, no
    rows give no rows, other columns are ignored. The automaton goes to the workers once; its size is the vocabulary's.
    """
    automaton = docs.sparkSession.sparkContext.broadcast(Automaton(vocabulary() if pieces is None else pieces))

    def run(batches):
        for rows, w in chunks(batches, lower=False):
            words, tokens = _counted(automaton.value, w)
            yield pa.RecordBatch.from_arrays([rows.column(0), pa.array(words.astype(np.int64)), pa.array(tokens)], ["doc_id", "n_words", "n_tokens"])

    return docs.select("doc_id", "text").mapInArrow(run, "doc_id long, n_words long, n_tokens long")
