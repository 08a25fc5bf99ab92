"""Interpolated modified Kneser-Ney scoring (Chen and Goodman, 1998) with a bigram model counted in Spark.

Counting: tasks sort the (context, token) hash pairs of about PAIRS tokens at a time and send them out as one
compressed block of distinct pairs with counts for each shard of the pair's key. A shard merges its blocks, writes the
sorted key array with its counts to the shared folder, and passes on what each word gains by it: occurrences, distinct
contexts, distinct continuations by count. Word shards merge these the same way. Scoring: workers map the sorted arrays
into memory (or a copy of a file, where the folder isn't a local one) and look up a block of texts at a time by binary search.

A key is context * A + token modulo 2^64 of 64-bit word hashes, so the token follows from key and context.
"""

from __future__ import annotations

import shutil
import tempfile
from functools import lru_cache

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import discard, scratch, stash
from .text import Words, chunks

A = np.uint64(0x9E6C63D0676A9A99)
BOS, END = np.uint64(0x0123456789ABCDEF), np.uint64(0xFEDCBA9876543210)
#: Tokens a task sorts at once; bytes of text a shard is meant for; most shards.
PAIRS, SHARD_BYTES, SHARDS = 1 << 21, 16 << 20, 1 << 13
FIELDS = ("c", "ncont", "tot", "n1", "n2", "n3")


def held_out(modulus: int = 10, rest: int = 0) -> Column:
    return F.coalesce(F.pmod(F.crc32(F.col("doc_id").cast("string")), F.lit(modulus)) == rest, F.lit(False))


def tokens(w: Words) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Tokens and contexts of all rows, each row's words then END; and where each row's tokens begin and the last end."""
    rows, begin = len(w.bound) - 1, w.bound + np.arange(len(w.bound))
    tok = np.empty(begin[-1], np.uint64)
    tok[begin[1:] - 1] = END
    is_word = np.ones(len(tok), bool)
    is_word[begin[1:] - 1] = False
    tok[is_word] = w.hashes()
    ctx = np.empty_like(tok)
    ctx[1:] = tok[:-1]
    ctx[begin[:rows]] = BOS
    return tok, ctx, begin


def _squeeze(columns: list[np.ndarray]) -> bytes:
    """Columns of one length as bytes, by byte plane; the first is sorted and kept as steps."""
    import zstandard

    columns = [np.diff(columns[0], prepend=np.uint64(0)), *columns[1:]]
    planes = b"".join(c.view(np.uint8).reshape(len(c), -1).T.tobytes() for c in columns)
    return len(columns[0]).to_bytes(8, "little") + zstandard.ZstdCompressor(level=1).compress(planes)


def _unsqueeze(blob: bytes, kinds: list) -> list[np.ndarray]:
    import zstandard

    n, raw, at, out = int.from_bytes(blob[:8], "little"), np.frombuffer(zstandard.ZstdDecompressor().decompress(blob[8:]), np.uint8), 0, []
    for kind in map(np.dtype, kinds):
        out.append(raw[at : at + n * kind.itemsize].reshape(kind.itemsize, n).T.copy().view(kind)[:, 0])
        at += n * kind.itemsize
    out[0] = np.cumsum(out[0], dtype=np.uint64)
    return out


def _summed(keys: np.ndarray, *values: np.ndarray) -> list[np.ndarray]:
    """Distinct keys, sorted, and the sums of values over each."""
    order = np.argsort(keys)
    keys = keys[order]
    first = np.flatnonzero(np.concatenate(([True], keys[1:] != keys[:-1]))) if len(keys) else np.zeros(0, np.int64)
    return [keys[first], *(np.add.reduceat(v[order], first) if len(first) else v[:0] for v in values)]


def _shard(keys: np.ndarray, bits: int) -> np.ndarray:
    return (keys >> np.uint64(64 - bits)).astype(np.int64) if bits else np.zeros(len(keys), np.int64)


def _count(bits: int):
    def flush(tok, ctx):
        key = np.concatenate(ctx) * A + np.concatenate(tok)
        order = np.argsort(key)
        key, ctx = key[order], np.concatenate(ctx)[order]
        first = np.flatnonzero(np.concatenate(([True], key[1:] != key[:-1])))
        count = np.diff(first, append=len(key)).astype(np.uint32)
        key, ctx = key[first], ctx[first]
        cut = np.searchsorted(_shard(key, bits), np.arange((1 << bits) + 1))
        rows = []
        for s in range(1 << bits):
            a, b = cut[s], cut[s + 1]
            if b > a:
                by = np.argsort(ctx[a:b])
                rows.append((s, _squeeze([ctx[a:b][by], key[a:b][by], count[a:b][by]])))
        return pa.RecordBatch.from_arrays([pa.array([s for s, _ in rows], pa.int32()), pa.array([b for _, b in rows], pa.binary())], ["shard", "blob"])

    def run(batches):
        tok, ctx, n = [], [], 0
        for _, w in chunks(batches):
            t, c, _ = tokens(w)
            tok.append(t)
            ctx.append(c)
            n += len(t)
            if n >= PAIRS:
                yield flush(tok, ctx)
                tok, ctx, n = [], [], 0
        if n:
            yield flush(tok, ctx)

    return run


def _save(folder: str, name: str, arrays: list[np.ndarray]) -> None:
    """One file, complete or absent; a task that runs again writes the same one."""
    import uuid

    from pyarrow import fs as pafs

    fs, path = pafs.FileSystem.from_uri(folder)
    fs.create_dir(path)
    temporary = f"{path}/.{name}-{uuid.uuid4().hex}"
    with fs.open_output_stream(temporary) as f:
        f.write(np.array([len(arrays), *(len(a) for a in arrays)], np.int64).tobytes())
        for a in arrays:
            f.write(a.tobytes())
    fs.move(temporary, f"{path}/{name}")


def _merge_pairs(folder: str, bits: int):
    def run(g: pd.DataFrame) -> pd.DataFrame:
        parts = [_unsqueeze(b, [np.uint64, np.uint64, np.uint32]) for b in g["blob"]]
        ctx, key, count = (np.concatenate(x) for x in zip(*parts, strict=True))
        del parts
        order = np.argsort(key)
        key, ctx, count = key[order], ctx[order], count[order].astype(np.int64)
        first = np.flatnonzero(np.concatenate(([True], key[1:] != key[:-1])))
        key, ctx, count = key[first], ctx[first], np.add.reduceat(count, first)
        many = count > 254
        _save(folder, f"pairs-{int(g['shard'].iloc[0]):05d}", [key, key[many], count[many], np.minimum(count, 255).astype(np.uint8)])
        one, none = np.ones(len(key), np.int64), np.zeros(len(key), np.int64)
        word = _summed(
            np.concatenate([key - ctx * A, ctx]),
            *(np.concatenate(x) for x in ((count, none), (one, none), (none, count), (none, count == 1), (none, count == 2), (none, count > 2))),
        )
        word[1:] = [x.astype(np.int64) for x in word[1:]]
        cut = np.searchsorted(_shard(word[0], bits), np.arange((1 << bits) + 1))
        rows = [(s, _squeeze([x[cut[s] : cut[s + 1]] for x in word])) for s in range(1 << bits) if cut[s + 1] > cut[s]]
        rows.append((-1, np.array([*((count == i).sum() for i in (1, 2, 3, 4)), 0, 0, 0, 0], np.int64).tobytes()))
        return pd.DataFrame(rows, columns=["shard", "blob"])

    return run


def _merge_words(folder: str):
    def run(g: pd.DataFrame) -> pd.DataFrame:
        parts = [_unsqueeze(b, [np.uint64, *[np.int64] * len(FIELDS)]) for b in g["blob"]]
        word = _summed(*(np.concatenate(x) for x in zip(*parts, strict=True)))
        _save(folder, f"words-{int(g['shard'].iloc[0]):05d}", word)
        c, n = word[1], word[2]
        got = np.array([*((n == i).sum() for i in (1, 2, 3, 4)), (n > 2).sum(), (c > 0).sum(), c.sum(), n.sum()], np.int64)
        return pd.DataFrame([(-2, got.tobytes())], columns=["shard", "blob"])

    return run


def discounts(n1: int, n2: int, n3: int, n4: int) -> np.ndarray:
    """Discounts of counts 0, 1, 2 and over; 0.5 where counts of counts can't tell."""
    y = n1 / (n1 + 2 * n2) if n1 else 0.0
    d = [i - (i + 1) * y * b / a if a and b else 0.5 for i, a, b in ((1, n1, n2), (2, n2, n3), (3, n3, n4))]
    return np.array([0.0, *(min(max(x, 0.05), i) if x < i else 0.5 for i, x in zip((1, 2, 3), d, strict=True))])


class Model:
    """The arrays of a folder, each file mapped into memory when it is first looked up in.

    A file of a remote folder is fetched to a local one that has no name any more once it is mapped.
    """

    def __init__(self, folder: str, bits: int, stats: dict):
        from pyarrow import fs as pafs

        self.fs, self.path = pafs.FileSystem.from_uri(folder)
        self.bits, self.s, self.open = bits, stats, {}

    def _mapped(self, file: str) -> np.ndarray:
        from pyarrow import fs as pafs

        if isinstance(self.fs, pafs.LocalFileSystem):
            return np.memmap(file, np.uint8, "r")
        with tempfile.NamedTemporaryFile(prefix="shard-") as local, self.fs.open_input_stream(file) as remote:
            shutil.copyfileobj(remote, local, 1 << 20)
            local.flush()
            return np.memmap(local.name, np.uint8, "r")

    def arrays(self, name: str, kinds: list) -> list[np.ndarray] | None:
        if name not in self.open:
            from pyarrow import fs as pafs

            file, out = f"{self.path}/{name}", None
            if self.fs.get_file_info(file).type != pafs.FileType.NotFound:
                raw, at, out = self._mapped(file), 8 * (len(kinds) + 1), []
                for n, kind in zip(raw[8:at].view(np.int64).tolist(), map(np.dtype, kinds), strict=True):
                    out.append(raw[at : at + n * kind.itemsize].view(kind))
                    at += n * kind.itemsize
            self.open[name] = out
        return self.open[name]

    def _each(self, kind: str, keys: np.ndarray, kinds: list):
        """(slice of keys, arrays, places in them, found) by shard; keys sorted."""
        cut = np.searchsorted(_shard(keys, self.bits), np.arange((1 << self.bits) + 1))
        for s in np.flatnonzero(np.diff(cut)):
            part = slice(cut[s], cut[s + 1])
            if (a := self.arrays(f"{kind}-{s:05d}", kinds)) is not None:
                at = np.minimum(np.searchsorted(a[0], keys[part]), len(a[0]) - 1)
                yield part, a, at, a[0][at] == keys[part]

    def words(self, keys: np.ndarray) -> np.ndarray:
        """FIELDS of each key, one row a field."""
        out = np.zeros((len(FIELDS), len(keys)), np.int64)
        for part, a, at, found in self._each("words", keys, [np.uint64, *[np.int64] * len(FIELDS)]):
            for i in range(len(FIELDS)):
                out[i, part] = np.where(found, a[i + 1][at], 0)
        return out

    def pairs(self, keys: np.ndarray) -> np.ndarray:
        out = np.zeros(len(keys), np.int64)
        for part, a, at, found in self._each("pairs", keys, [np.uint64, np.uint64, np.int64, np.uint8]):
            got = np.where(found, a[3][at].astype(np.int64), 0)
            if (many := got == 255).any():
                got[many] = a[2][np.searchsorted(a[1], keys[part][many])]
            out[part] = got
        return out

    def score(self, w: Words) -> tuple[np.ndarray, ...]:
        """Of each row: tokens, known tokens, base score, score."""
        tok, ctx, begin = tokens(w)
        s = self.s
        uniq, back = np.unique(np.concatenate([tok, ctx]), return_inverse=True)
        c, ncont, tot, n1, n2, n3 = self.words(uniq)
        n, v = s["N"], s["V"]
        base = np.log10((c + 0.1) / (n + 0.1 * (v + 1)))
        d, dw = s["pairs"], s["words"]
        uni = (ncont - dw[np.minimum(ncont, 3)] + s["gamma"] / (v + 1)) / s["T"] if s["T"] else np.full(len(uniq), 1 / (v + 1))
        with np.errstate(divide="ignore", invalid="ignore"):
            gamma = np.where(tot > 0, (d[1] * n1 + d[2] * n2 + d[3] * n3) / tot, 1.0)
        t, h = back[: len(tok)], back[len(tok) :]
        key = ctx * A + tok
        order = np.argsort(key)
        count = np.empty(len(key), np.int64)
        count[order] = self.pairs(key[order])
        high = (count - d[np.minimum(count, 3)]) / np.maximum(tot[h], 1)
        p = np.log10(high + gamma[h] * uni[t])
        at = begin[:-1]
        return np.diff(begin), np.add.reduceat((c[t] > 0).astype(np.int64), at), np.add.reduceat(base[t], at), np.add.reduceat(p, at)


@lru_cache(1)
def _model(folder: str, bits: int) -> Model:
    """A worker keeps its last model, so that its tasks share what is mapped."""
    return Model(folder, bits, {})


def train(docs: DataFrame) -> tuple[str, int, dict]:
    """(folder, bits, statistics) of a model of all rows of docs (text, ...); no rows make a model that knows nothing."""
    spark = docs.sparkSession
    size = docs.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    bits = min(SHARDS, max(8, -(-size // SHARD_BYTES))).bit_length()
    folder = scratch(spark, "model")
    blobs = docs.select("text").mapInArrow(_count(bits), "shard int, blob binary")
    merged = stash(blobs.groupBy("shard").applyInPandas(_merge_pairs(folder, bits), "shard int, blob binary"), "gains")
    got = merged.where("shard >= 0").groupBy("shard").applyInPandas(_merge_words(folder), "shard int, blob binary")
    total = np.zeros((3, 8), np.int64)
    both = stash(got.unionByName(merged.where("shard < 0")), "counts")
    discard(spark, merged.inputFiles()[0].rpartition("/")[0])
    for shard, blob in both.toLocalIterator():  # a few numbers a shard
        total[-shard] += np.frombuffer(blob, np.int64)
    pairs, words = total[1], total[2]
    d, dw = discounts(*map(int, pairs[:4])), discounts(*map(int, words[:4]))
    return folder, bits, {
        "N": int(words[6]), "V": int(words[5]), "pairs": d, "words": dw, "T": int(words[7]),
        "gamma": float(dw[1] * words[0] + dw[2] * words[1] + dw[3] * words[4]),
    }


def score(docs: DataFrame, model: tuple[str, int, dict]) -> DataFrame:
    """doc_id, n_tokens, n_known, train_tokens, base_score, score of every row of docs (doc_id, text, ...).

    Words are lower-cased (A-Z); null or empty text is its end alone; an unseen context backs off to the words, an
    unseen word to one share in V + 1. Repeated rows score alike, no rows give no rows, other columns are ignored.
    """

    def run(batches):
        m = _model(*model[:2])
        m.s = model[2]
        for rows, w in chunks(batches, chunk=2 << 20):
            n, known, base, p = m.score(w)
            yield pa.RecordBatch.from_arrays(
                [rows.column(0), pa.array(n), pa.array(known), pa.array(np.full(len(n), model[2]["N"], np.int64)), pa.array(base), pa.array(p)],
                ["doc_id", "n_tokens", "n_known", "train_tokens", "base_score", "score"],
            )

    return docs.select("doc_id", "text").mapInArrow(run, "doc_id long, n_tokens long, n_known long, train_tokens long, base_score double, score double")
