"""Packing documents into windows by minimum bin slack (Gupta and Ho, 1999).

Documents longer than a window give full windows; what is left of each is one piece. Every window takes the longest
piece that remains and then the multiset of remaining lengths that comes closest to filling it, found by subset-sum
dynamic programming over a bitset of reachable fills, with counts traced back. Pieces are packed in groups of a bounded
size, drawn by hash, so a window can't close across groups: the padding this costs is a window a group at most.
"""

from __future__ import annotations

import json
import re
import zlib
from bisect import bisect_right
from functools import lru_cache

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import stash
from .text import Words, runs, utf8

WINDOW, END, GROUP = 4096, 2, 20_000


# The steps before merging of tokenizers whose texts can be encoded word by word.
BY_WORD = {
    "normalizer": {"type": "Sequence", "normalizers": [{"type": "NFC"}, {"type": "Replace", "pattern": {"Regex": "\\s+"}, "content": " "}, {"type": "Lowercase"}]},
    "pre_tokenizer": {
        "type": "Sequence",
        "pretokenizers": [
            {"type": "Split", "pattern": {"Regex": "'s|'t|'re|'ve|'m|'ll|'d|[\\p{L}]+|[\\p{N}]|[^\\s\\p{L}\\p{N}]+"}, "behavior": "Removed", "invert": True},
            {"type": "ByteLevel", "add_prefix_space": False, "trim_offsets": True, "use_regex": False},
        ],
    },
    "post_processor": None,
    "truncation": None,
}
#: A word of letters that no step before merging changes.
_PLAIN = re.compile(rb"(?:[a-z]|\xc3[\x9f-\xb6\xb8-\xbf])+")


def _letter_ends(buf: np.ndarray, at: np.ndarray) -> np.ndarray:
    """Whether a letter of _PLAIN ends right before each place."""
    one = np.where(at > 0, buf[at - 1], 0)
    two = np.where(at > 1, buf[at - 2], 0)
    return (one >= 97) & (one <= 122) | (two == 0xC3) & (one >= 0x9F) & (one <= 0xBF) & (one != 0xB7)


class Tokens:
    """Ids of texts by a tokenizer file.

    Where the tokenizer splits at white space, drops it and lower-cases (BY_WORD), a text's ids are those of its words
    one after another, and words are kept in a cache of a bounded size that lives as long as the worker: its older half
    goes when it is full. A stop or comma that ends a word is a piece of its own there, so it is cut off first. Equal
    words of a run of texts are found by hash, checked byte by byte, and looked up once. New words are encoded many at a time. One of letters only ends with the one id of it that has the suffix of a word's end;
    between others stands a mark whose id nothing else has. Any other tokenizer encodes whole texts.
    """

    MARK = b"\x01"

    def __init__(self, path: str, most: int = 800_000):
        from tokenizers import Tokenizer

        self.tok = Tokenizer.from_file(path)
        steps = json.loads(self.tok.to_str())
        suffix = steps["model"].get("end_of_word_suffix")
        self.by_word = suffix and steps["model"]["type"] == "BPE" and not steps["model"].get("ignore_merges") and all(steps.get(k) == v for k, v in BY_WORD.items())
        if self.by_word:
            self.known, self.older, self.half = {}, {}, most // 2
            (self.mark,) = self._ids(self.MARK)
            vocab = self.tok.get_vocab()
            self.ends = np.zeros(max(vocab.values()) + 1, bool)
            self.ends[[i for piece, i in vocab.items() if piece.endswith(suffix)]] = True

    def _ids(self, text: bytes) -> np.ndarray:
        (e,) = self.tok.encode_batch_fast([text.decode()], add_special_tokens=False)
        return np.array(e.ids, "<u4")

    def _keep(self, words: list[bytes], ids: np.ndarray, start: list[int], stop: list[int]) -> None:
        raw = ids.tobytes()
        for w, a, b in zip(words, start, stop, strict=True):
            self.known[w] = raw[4 * a : 4 * b]

    def _learn(self, words: set[bytes]) -> None:
        older = self.older
        if older:
            again = {w: older[w] for w in words if w in older}
            self.known |= again
            words = words.difference(again)
        plain = [w for w in words if _PLAIN.fullmatch(w)]
        for i in range(0, len(plain), 8000):
            part = plain[i : i + 8000]
            ids = self._ids(b" ".join(part))
            stop = (np.flatnonzero(self.ends[ids]) + 1).tolist()
            self._keep(part, ids, [0, *stop[:-1]], stop)
        other = list(words.difference(plain))
        for w in [w for w in other if self.MARK in w]:
            self.known[w] = self._ids(w).tobytes()
            other.remove(w)
        for i in range(0, len(other), 4000):
            part = other[i : i + 4000]
            ids = self._ids((b" " + self.MARK + b" ").join(part))
            cut = np.flatnonzero(ids == self.mark)
            self._keep(part, ids, [0, *(cut + 1).tolist()], [*cut.tolist(), len(ids)])

    def _of_words(self, words: list[bytes]) -> list[bytes]:
        new = set(words).difference(self.known)
        if len(self.known) + len(new) > self.half:
            self.known, self.older, new = {}, self.known, set(words)
        self._learn(new)
        return list(map(self.known.__getitem__, words))

    def of(self, buf: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all texts of a run, one after another, and where each text's begin and the last's end."""
        if not self.by_word:
            got = self.tok.encode_batch_fast([buf[a:b].tobytes().decode() for a, b in zip(off[:-1], off[1:], strict=True)], add_special_tokens=False)
            return np.concatenate([np.zeros(0, "<u4"), *(np.array(e.ids, "<u4") for e in got)]), np.cumsum([0, *(len(e.ids) for e in got)])
        w = Words(buf, off, True)
        start, end = w.start, w.end
        for at in np.unique(np.searchsorted(start, np.flatnonzero(buf == 60), "right") - 1).tolist():  # special tokens tell case
            w.buf[start[at] : end[at]] = buf[start[at] : end[at]]
        stop = np.flatnonzero(end - start > 1)
        stop = stop[np.isin(w.buf[end[stop] - 1], (44, 46))]
        stop = stop[_letter_ends(w.buf, end[stop] - 1)]
        start, end = np.sort(np.concatenate([start, end[stop] - 1])), np.sort(np.concatenate([end, end[stop] - 1]))
        w.start, w.end = start, end
        _, first, back = np.unique(w.hashes(), return_index=True, return_inverse=True)
        size, place = end - start, np.concatenate(([0], np.cumsum(end - start)))
        inside = np.arange(place[-1]) - np.repeat(place[:-1], size)
        alike = first[back]
        if (size != size[alike]).any() or (w.buf[np.repeat(start, size) + inside] != w.buf[np.repeat(start[alike], size) + inside]).any():
            first = back = np.arange(len(start))  # two words share a hash: each is looked up
        raw = w.buf.tobytes()
        ids = self._of_words([raw[a:b] for a, b in zip(start[first].tolist(), end[first].tolist(), strict=True)])
        n = np.fromiter(map(len, ids), np.int64, len(ids)) // 4
        flat, begin = np.frombuffer(b"".join(ids), "<u4"), np.concatenate(([0], np.cumsum(n)))[:-1]
        each = n[back]
        bound = np.concatenate(([0], np.cumsum(each)))
        got = flat[np.repeat(begin[back] - bound[:-1], each) + np.arange(bound[-1])]
        return got, bound[np.searchsorted(start, off)]


@lru_cache(1)
def _tokens(path: str) -> Tokens:
    return Tokens(path)


def _cut(path: str, window: int, end: int):
    def run(batches):
        import os

        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        tokens, tail = _tokens(path), np.array([end], "<u4")
        for batch in batches:
            buf, off = utf8(batch.column(1))
            for a, b in runs(off):
                got = []
                ids, bound = tokens.of(buf[off[a] : off[b]], off[a : b + 1] - off[a])
                for doc, p, q in zip(batch.column(0).slice(a, b - a).to_pylist(), bound[:-1].tolist(), bound[1:].tolist(), strict=True):
                    x = np.concatenate([ids[p:q], tail]).tobytes()
                    n = len(x) // 4
                    got += [(doc, s, min(window, n - s), zlib.crc32(x[4 * s : 4 * (s + window)]), n) for s in range(0, n, window)]
                yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in zip(*got, strict=True)], ["doc_id", "start", "length", "ids_crc32", "doc_tokens"])

    return run


def fullest(room: int, lengths: list[int], count: list[int]) -> dict[int, int]:
    """How many of each length together come closest to room from below; lengths ascending, count by length."""
    reach, steps, mask = 1, [], (1 << (room + 1)) - 1
    for i in range(bisect_right(lengths, room) - 1, -1, -1):
        size, left, take = lengths[i], min(count[lengths[i]], room // lengths[i]), 1
        while left:
            k = min(take, left)
            steps.append((size, k, reach))
            reach |= (reach << (size * k)) & mask
            left, take = left - k, take * 2
        if reach >> room:
            break
    at, used = reach.bit_length() - 1, {}
    for size, k, before in reversed(steps):
        if not before >> at & 1:
            at -= size * k
            used[size] = used.get(size, 0) + k
    return used


def windows(sizes: list[int], window: int) -> list[list[int]]:
    """Window after window, the lengths of its pieces: the longest that remains, and the fullest filling beside it."""
    count = [0] * (window + 1)
    for s in sizes:
        count[s] += 1
    lengths, out = [s for s in range(1, window + 1) if count[s]], []
    while lengths:
        top = lengths[-1]
        count[top] -= 1
        if not count[top]:
            lengths.pop()
        one = [top]
        for size, k in fullest(window - top, lengths, count).items():
            one += [size] * k
            count[size] -= k
            if not count[size]:
                del lengths[bisect_right(lengths, size) - 1]
        out.append(one)
    return out


def _packed(window: int):
    def run(g: pd.DataFrame) -> pd.DataFrame:
        g = g.sort_values(["length", "h", "doc_id", "start", "ids_crc32", "doc_tokens"], na_position="last").reset_index(drop=True)
        size = g["length"].to_numpy()
        nxt = {int(s): int(i) for i, s in zip(*np.unique(size, return_index=True)[::-1], strict=True)}
        seq, offset = np.zeros(len(g), np.int64), np.zeros(len(g), np.int64)
        for k, one in enumerate(windows(size.tolist(), window)):
            at = 0
            for s in one:
                i = nxt[s]
                nxt[s] += 1
                seq[i], offset[i] = k, at
                at += s
        return g.assign(sequence_id=(g["bucket"].to_numpy() << 32) + seq, offset=offset).drop(columns=["h", "bucket"])

    return run


def pack(docs: DataFrame, tokenizer: str | None = None, window: int = WINDOW, end: int = END, group: int = GROUP) -> DataFrame:
    """One row per piece of every row of docs (doc_id, text, ...): doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset.

    A document is its text's ids and then end; null or empty text is end alone. Each id is in one piece; pieces of a
    sequence are gapless from offset 0 and at most window long. Repeated rows and null doc_ids are packed as documents
    of their own. No rows give no rows. Other columns are ignored.
    """
    if tokenizer is None:
        import public_tokenizers

        tokenizer = public_tokenizers.path("word_bpe_49k.json")
    schema = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long"
    pieces = stash(docs.select("doc_id", "text").mapInArrow(_cut(tokenizer, window, end), schema), "pieces")
    groups = max(1, -(-pieces.count() // group))
    h = F.xxhash64("doc_id", "start", "ids_crc32", "doc_tokens")
    dealt = pieces.withColumn("h", h).withColumn("bucket", F.pmod("h", F.lit(groups).cast("long")))
    return dealt.groupBy("bucket").applyInPandas(_packed(window), schema + ", sequence_id long, offset long")
