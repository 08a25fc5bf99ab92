"""N-gram Jaccard join by PartEnum signatures (Arasu, Ganti and Kaushik, VLDB 2006).

A document's set holds the hashes of its distinct n-word shingles. Sets go to size bands; a pair whose Jaccard
similarity reaches t differs in at most k = floor(r * (1 - t) / t) elements, r being the largest size of the band
of its smaller set. For a band the feature domain is cut into n1 groups of 3 parts. With n1 = k // 2 + 1 + x, some
x + 1 groups differ in one element at most, and so agree on one of the 3 subsets of two parts: each subset of each
group is a signature. Parts are ranges of hashes, so a sorted set is cut by binary search.

A subset that holds nothing would be shared by strangers, so it gives no signature; x groups of slack make up for it.
A set with more than x such groups also emits its prefix elements, which any two such sets that link must share. So
candidates are complete. They are then checked exactly: each set against the most connected member of its buckets that
it shares most signatures with, then, across components only, the pairs of sets with any shared signature that a prefix
filter on rare features finds. That second phase doesn't read buckets: signatures only say which sets take part.
"""

from __future__ import annotations

from functools import partial

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import bitmap_filter, components, drop, stash
from .text import Words, chunks, mix, tidy

#: Similarity in hundredths and shingle length.
NUM, DEN, SHINGLE = 85, 100, 4
#: Upper over lower size of a band.
BAND = 1.4
#: Bits of slots of the tables that tell common features from rare ones, at most; slots of a block of them.
SLOT_BITS, BLOCK = 24, 1 << 16
#: Tasks whose counts of a block are added in one; features that a task counts at once.
FAN, TALLY = 256, 1 << 21
_ARMS = [np.uint64(x) for x in (0x9FB21C651E98DF25, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0xD6E8FEB86659FD93, 0xA0761D6478BD642F, 0xE7037ED1A0B428DB, 0x8EBC6AF09C88C6E3)]


def shingle_sets(w: Words, n: int):
    """(row, its sorted distinct shingle hashes); fewer than n words are one shingle, no words none."""
    h = w.hashes()
    full = np.zeros(max(0, len(h) - n + 1), np.uint64)
    for j in range(n):
        full += h[j : j + len(full)] * (_ARMS[j % 7] + np.uint64(2 * (j // 7)))
    full = mix(full)
    for i in range(len(w.bound) - 1):
        a, b = w.bound[i], w.bound[i + 1]
        if b - a >= n:
            s = np.sort(full[a : b - n + 1])
            yield i, s[np.concatenate(([True], s[1:] != s[:-1]))]
        elif b > a:
            arms = np.array([_ARMS[j % 7] + np.uint64(2 * (j // 7)) for j in range(b - a)])
            yield i, mix((h[a:b] * arms).sum(dtype=np.uint64, keepdims=True) + np.uint64(b - a))
        else:
            yield i, full[:0]


def bands(size: int, num: int, den: int) -> list[tuple[int, int]]:
    """(band, k) of the instances that a set of this size takes part in, as the smaller or the larger set."""
    out, low, i = [], 1, 0
    while low <= size:
        high = max(low, int(low * BAND))
        if high * den >= size * num and (k := high * (den - num) // num):
            out.append((i, k))
        low, i = high + 1, i + 1
    return out


def signatures(s: np.ndarray, num: int = NUM, den: int = DEN, bits: int = 64) -> np.ndarray:
    """The signatures of one sorted set of 64-bit features, cut to bits: two that collide are one more candidate to check."""
    out = []
    if len(s):
        sums = np.zeros(len(s) + 1, np.uint64)
        np.cumsum(mix(s + _ARMS[4]), out=sums[1:])
    for band, k in bands(len(s), num, den):
        slack = 1 + k // 24
        n1 = k // 2 + 1 + slack
        part = ((s >> np.uint64(32)) * np.uint64(3 * n1)) >> np.uint64(32)
        cut = np.searchsorted(part, np.arange(3 * n1 + 1, dtype=np.uint64))
        held, count = (sums[cut[1:]] - sums[cut[:-1]]).reshape(n1, 3), np.diff(cut).reshape(n1, 3)
        sig = np.stack([held[:, 0] + held[:, 1], held[:, 1] + held[:, 2], held[:, 0] + held[:, 2]], 1)
        empty = np.stack([count[:, 0] + count[:, 1], count[:, 1] + count[:, 2], count[:, 0] + count[:, 2]], 1) == 0
        slot = mix(np.arange(3 * n1, dtype=np.uint64) + np.uint64(band << 40))
        out.append(mix(sig.ravel() + slot)[~empty.ravel()])
        if empty.any(1).sum() > slack:
            out.append(mix(s[: len(s) - (len(s) * num + den - 1) // den + 1] + mix(np.array([band + 1], np.uint64) * _ARMS[5])))
    return np.concatenate(out) >> np.uint64(64 - bits) if out else np.zeros(0, np.uint64)


def _set_key(s: np.ndarray, clashing: frozenset = frozenset(), bits: int = 64) -> tuple[int, int]:
    """Key and check of a set. A key that different sets have gives way to one made of the check."""
    a, b = mix(s).sum(dtype=np.uint64), mix(s ^ _ARMS[6]).sum(dtype=np.uint64)
    key, check = (mix(np.array([a + np.uint64(len(s)), b], np.uint64)) >> np.array([64 - bits, 0], np.uint64)).view(np.int64).tolist()
    return (_rekeyed(check) if key in clashing else key), check


def _rekeyed(check: int) -> int:
    return int(mix(np.array([check], np.int64).view(np.uint64) ^ _ARMS[2]).view(np.int64)[0])


def _profile(n: int, key_bits: int):
    @tidy
    def run(batches):
        for rows, w in chunks(batches):
            got = [(len(s), *_set_key(s, bits=key_bits)) for _, s in shingle_sets(w, n)]
            size, key, check = (np.array(x, np.int64) for x in zip(*got, strict=True))
            yield pa.RecordBatch.from_arrays([rows.column(0), pa.array(size), pa.array(key), pa.array(check)], ["doc_id", "n_shingles", "key", "check"])

    return run


def _rekey(clashing: frozenset):
    @tidy
    def run(batches):
        for b in batches:
            key = [_rekeyed(c) if k in clashing else k for k, c in zip(b.column(2).to_pylist(), b.column(3).to_pylist(), strict=True)]
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(key, pa.int64()), b.column(3)], ["doc_id", "n_shingles", "key", "check"])

    return run


def _signed(n: int, num: int, den: int, bits: int, key_of):
    @tidy
    def run(batches):
        last, done = None, set()
        for rows, w in chunks(batches):
            keys, sigs = [], []
            for _, s in shingle_sets(w, n):
                key = key_of(s)[0]
                if len(done) > 50_000:
                    done = set()
                if len(s) and key not in done:  # a task's own copies add nothing
                    done.add(key)
                    got = signatures(s, num, den, bits)
                    sigs.append(got)
                    keys.append(np.full(len(got), key, np.int64))
            if sigs:
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(sigs).view(np.int64)), pa.array(np.concatenate(keys))], ["sig", "key"])

    return run


def _sets(n: int, key_of):
    @tidy
    def run(batches):
        for _, w in chunks(batches):
            got = [(key_of(s)[0], s.tobytes()) for _, s in shingle_sets(w, n)]
            yield pa.RecordBatch.from_arrays([pa.array([k for k, _ in got], pa.int64()), pa.array([b for _, b in got], pa.binary())], ["key", "shingles"])

    return run


def _verified(num: int, den: int):
    @tidy
    def run(batches):
        for b in batches:
            u, v, x, y = (b.column(i) for i in range(4))
            keep = np.zeros(b.num_rows, bool)
            for i in range(b.num_rows):
                p, q = np.frombuffer(x[i].as_buffer(), np.uint64), np.frombuffer(y[i].as_buffer(), np.uint64)
                if min(len(p), len(q)) * den >= max(len(p), len(q)) * num:
                    at = np.searchsorted(q, p)
                    both = int((q[np.minimum(at, len(q) - 1)] == p).sum()) if len(q) else 0
                    keep[i] = den * both >= num * (len(p) + len(q) - both) and both > 0
            yield pa.RecordBatch.from_arrays([u, v, pa.array(keep)], ["u", "v", "linked"])

    return run


def _tally(bits: int):
    """How many features each eighth of 2^bits slots holds, up to 255: for each block of slots, runs of (eighths, counts) as sorted steps."""

    @tidy
    def run(batches):
        import zstandard
        from pyspark import TaskContext

        pack, part = zstandard.ZstdCompressor(level=1).compress, TaskContext.get().partitionId() // FAN

        def flush(features):
            eighth, n = np.unique(np.concatenate(features), return_counts=True)
            block = (eighth // np.uint64(8 * BLOCK)).astype(np.int64)
            at = (eighth % np.uint64(8 * BLOCK)).astype(np.uint32)
            cut = np.flatnonzero(np.diff(block, prepend=-1, append=-1))
            rows = []
            for a, b in zip(cut[:-1], cut[1:], strict=True):
                planes = np.diff(at[a:b], prepend=np.uint32(0)).view(np.uint8).reshape(-1, 4).T.tobytes()
                rows.append((int(block[a]), part, (b - a).item().to_bytes(4, "little") + pack(planes + np.minimum(n[a:b], 255).astype(np.uint8).tobytes())))
            return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows, strict=True), (pa.int32(), pa.int32(), pa.binary()), strict=True)], ["block", "part", "counts"])

        held, size = [], 0
        for b in batches:
            for at in range(0, b.num_rows, 500):
                held += [np.frombuffer(x.as_buffer(), np.uint64) >> np.uint64(61 - bits) for x in b.column(1).slice(at, 500)]
                size += sum(map(len, held[-500:]))
                if size >= TALLY:
                    yield flush(held)
                    held, size = [], 0
        if size:
            yield flush(held)

    return run


def _tables(blobs) -> list[np.ndarray]:
    """Of a block of slots: features, eighths that hold one or more, eighths that hold two or more."""
    import zstandard

    total, once, twice = np.zeros(BLOCK, np.int64), np.zeros(BLOCK, np.uint8), np.zeros(BLOCK, np.uint8)
    for x in blobs:
        m = int.from_bytes(x[:4], "little")
        raw = np.frombuffer(zstandard.ZstdDecompressor().decompress(x[4:]), np.uint8)
        at, n = np.cumsum(raw[: 4 * m].reshape(4, m).T.copy().view(np.uint32)[:, 0], dtype=np.int64), raw[4 * m :]
        slot, bit = at >> 3, np.uint8(1) << (at & 7).astype(np.uint8)
        first = np.flatnonzero(np.diff(slot, prepend=-1))
        slot, ones = slot[first], np.bitwise_or.reduceat(bit, first)
        twice[slot] |= np.bitwise_or.reduceat(np.where(n > 1, bit, 0).astype(np.uint8), first) | once[slot] & ones
        once[slot] |= ones
        total[slot] += np.add.reduceat(n.astype(np.int64), first)
    return [np.minimum(255, total).astype(np.uint8), once, twice]


def _gathered(g):
    import zstandard

    return g.iloc[:1].assign(counts=[zstandard.compress(np.stack(_tables(g["counts"])).tobytes(), 1)])


def _summed(g):
    import zstandard

    total, once, twice = np.zeros(BLOCK, np.int64), np.zeros(BLOCK, np.uint8), np.zeros(BLOCK, np.uint8)
    for x in g["counts"]:
        n, one, two = np.frombuffer(zstandard.decompress(x), np.uint8).reshape(3, BLOCK)
        total += n
        twice |= two | once & one
        once |= one
    return g.iloc[:1].assign(counts=[zstandard.compress(np.stack([np.minimum(255, total).astype(np.uint8), twice]).tobytes(), 1)])


def _prefixes(common, bits: int, num: int, den: int):
    @tidy
    def run(batches):
        for b in batches:
            for at in range(0, b.num_rows, 500):
                part = b.slice(at, 500)
                sizes, features, places = [], [], []
                for x in part.column(1):
                    s = np.frombuffer(x.as_buffer(), np.uint64)
                    n = len(s) - (len(s) * num + den - 1) // den + 1
                    count, twice = common.value
                    slot = (s >> np.uint64(64 - bits)).astype(np.int64)
                    first = np.lexsort((s, count[slot]))[:n]
                    shared = twice[slot[first]] >> (s[first] >> np.uint64(61 - bits) & np.uint64(7)).astype(np.uint8) & 1
                    place = np.flatnonzero(shared)  # where an eighth of a slot holds one, nothing shares the feature
                    sizes.append(len(s))
                    features.append(s[first[place]].view(np.int64))
                    places.append(place)
                times = [len(f) for f in features]
                each = [np.repeat(c, times) for c in (part.column(0).to_numpy(), np.array(sizes, np.int64))]
                yield pa.RecordBatch.from_arrays([*map(pa.array, each), pa.array(np.concatenate(features)), pa.array(np.concatenate(places))], ["node", "size", "feature", "place"])

    return run


def _prefix_pairs(sets: DataFrame, labels: DataFrame, num: int, den: int) -> DataFrame:
    """Pairs (u > v) of nodes of labels (node, label) with different labels, with every pair that links among them; sets has (key, shingles).

    Features are ordered by how common their slot of a table of a bounded size is, rare first; any order is right, this
    one is quick. At the first feature a pair shares, at places i and j of sets of sizes a <= b, at most
    min(a - i, b - j) are shared in all, so it must reach num (a + b) / (num + den). Texts that share no more than what
    all of a large group share are thus no pair.
    """
    import zstandard

    n = (sets.agg(F.sum(F.octet_length("shingles"))).first()[0] or 0) // 8
    bits = max(16, min(SLOT_BITS, (4 * n).bit_length()))
    schema = "block int, part int, counts binary"
    tallied = sets.select("key", "shingles").mapInArrow(_tally(bits), schema)
    tallied = tallied.groupBy("block", "part").applyInPandas(_gathered, schema).groupBy("block").applyInPandas(_summed, schema)  # those of FAN tasks meet, then their tables
    tables = np.zeros((2, 1 << bits), np.uint8)
    for block, _, blob in tallied.collect():  # 2^bits slots at most
        tables[:, block * BLOCK : (block + 1) * BLOCK] = np.frombuffer(zstandard.decompress(blob), np.uint8).reshape(2, BLOCK)
    common = sets.sparkSession.sparkContext.broadcast(tables)
    placed = sets.select("key", "shingles").mapInArrow(_prefixes(common, bits, num, den), "node long, size long, feature long, place long")
    placed = stash(placed.join(labels, "node"), "prefixes")
    a = placed.where(f"(size - place) * {num + den} >= 2 * size * {num}").select("feature", *(F.col(c).alias(c + "_a") for c in ("node", "label", "size", "place")))
    b = placed.select("feature", *(F.col(c).alias(c + "_b") for c in ("node", "label", "size", "place")))
    enough = f"(size_a <= size_b) and (size_b * {num} <= size_a * {den}) and least(size_a - place_a, size_b - place_b) * {num + den} >= (size_a + size_b) * {num}"
    met = a.join(b, (a["feature"] == b["feature"]) & (a["label_a"] != b["label_b"]) & F.expr(enough))
    out = stash(met.select(F.greatest("node_a", "node_b").alias("u"), F.least("node_a", "node_b").alias("v")).distinct(), "more")
    drop(placed)
    return out


def ngram_join(docs: DataFrame, n: int = SHINGLE, num: int = NUM, den: int = DEN, key_bits: int = 64) -> DataFrame:
    """(doc_id, n_shingles, component_id) of every row of docs (doc_id, text, ...).

    Sets of n-word shingles link when den * intersection >= num * union; component_id is the least doc_id reachable.
    Rows without words have no shingles and link with nothing: their component is their own doc_id. Rows with equal
    sets, repeated rows included, are one class and share a component. A null doc_id is never a component's id unless
    all of the component are null. An empty table gives an empty result; other columns are ignored. A text is one set
    however long; a worker holds its words' hashes, 8 bytes a word.

    A class is known by key_bits of hash and a check of 64 more: where two classes share the former, the latter tells.
    """
    spark = docs.sparkSession
    texts = docs.select("doc_id", "text")
    rows = stash(texts.mapInArrow(_profile(n, key_bits), "doc_id long, n_shingles long, key long, check long"), "rows")

    def classed(rows: DataFrame) -> tuple[DataFrame, DataFrame]:
        got = rows.where("n_shingles > 0").groupBy("key").agg(F.min("doc_id").alias("rep"), F.min("check").alias("c0"), F.max("check").alias("c1"))
        got = stash(got, "classes")
        return got, got.where("c0 <> c1").select("key")

    classes, clash = classed(rows)
    clashing = frozenset(x.key for x in clash.collect())  # of N classes about N * N / 2^65, a few at any size of corpus
    if clashing:
        drop(classes)
        rows = stash(rows.mapInArrow(_rekey(clashing), rows.schema), "rows")
        classes, clash = classed(rows)
        if clash.limit(1).count():
            raise RuntimeError("two different shingle sets share 128 bits of hash")
    key_of = partial(_set_key, clashing=clashing, bits=key_bits)
    total = rows.agg(F.sum("n_shingles")).first()[0] or 0
    bits = min(64, max(43, total.bit_length() + 15))  # chance puts one signature in some ten thousand into another's bucket
    signed = texts.select("text").mapInArrow(_signed(n, num, den, bits, key_of), "sig long, key long")
    # What a signature is shared by combines map-side; only rows of shared signatures are then dealt out, by a join that AQE splits.
    shared = signed.groupBy("sig").agg(F.min("key").alias("hub"), F.max("key").alias("top")).where("hub <> top").select("sig", "hub")
    shared = stash(shared, "shared")
    buckets = bitmap_filter(signed, F.col("sig"), shared, F.col("sig"), shared.count()).distinct().join(shared, "sig").where("key <> hub")
    buckets = stash(buckets, "buckets")
    drop(shared)
    member = buckets.select("sig", F.col("key").alias("node")).unionByName(buckets.select("sig", F.col("hub").alias("node")).distinct())
    wide = member.groupBy("sig").agg(F.count("*").alias("width"))
    degree = member.join(wide, "sig").groupBy("node").agg(F.sum("width").alias("degree"))
    member = stash(member.join(degree, "node"), "member")
    drop(buckets)
    centre = member.groupBy("sig").agg(F.max_by("node", F.struct("degree", "node")).alias("hub"))
    shared = member.join(centre, "sig").where("node <> hub").groupBy("node", "hub").count()
    best = stash(shared.groupBy("node").agg(F.max_by("hub", F.struct("count", "hub")).alias("hub")), "best")
    nodes = member.select(F.col("node").alias("key")).distinct().join(classes.select("key", "rep"), "key")
    nodes = stash(nodes.join(best.withColumnRenamed("node", "key"), "key", "left"), "nodes")
    count = nodes.count()
    if count:
        near = bitmap_filter(texts, F.col("doc_id"), nodes, F.col("rep"), count).select("text")
        sets = near.mapInArrow(_sets(n, key_of), "key long, shingles binary").join(nodes.select("key", "hub"), "key").dropDuplicates(["key"])
        sets = stash(sets, "sets")

        def check(left: DataFrame, hubs: DataFrame) -> DataFrame:
            """Whether u and v of left (u, v, x) link; hubs are the distinct v."""
            right = bitmap_filter(sets.select(F.col("key").alias("v"), F.col("shingles").alias("y")), F.col("v"), hubs, F.col("v"), hubs.count())
            return stash(left.join(right, "v").select("u", "v", "x", "y").mapInArrow(_verified(num, den), "u long, v long, linked boolean"), "pairs")

        first = check(sets.where("hub is not null").select(F.col("key").alias("u"), F.col("hub").alias("v"), F.col("shingles").alias("x")), best.select(F.col("hub").alias("v")).distinct())
        label = components(first.where("linked").select("u", "v"))
        rest = nodes.select(F.col("key").alias("node")).join(label, "node", "left").select("node", F.coalesce("label", "node").alias("label"))
        more = _prefix_pairs(sets, rest, num, den)
        known = first.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v"))
        todo = stash(more.join(known, ["u", "v"], "left_anti"), "todo")
        u = todo.select("u").distinct()
        x = bitmap_filter(sets.select(F.col("key").alias("u"), F.col("shingles").alias("x")), F.col("u"), u, F.col("u"), u.count())
        second = check(todo.join(x, "u"), todo.select("v").distinct())
        label = components(first.where("linked").select("u", "v").union(second.where("linked").select("u", "v")))
        drop(sets, more, todo, first, second)
    else:
        label = spark.createDataFrame([], "node long, label long")
    named = label.join(classes.select(F.col("key").alias("node"), "rep"), "node").select("node", "label", "rep")
    least = named.groupBy("label").agg(F.min("rep").alias("component"))
    linked = named.join(least, "label").select(F.col("node").alias("key"), "component")
    final = classes.select("key", "rep").join(linked, "key", "left").select("key", F.coalesce("component", "rep").alias("component"))
    final = stash(final, "final")  # read back, so that AQE may split the join at a large class
    drop(classes, member, best, nodes)
    out = rows.where("n_shingles > 0").join(final, "key").select("doc_id", "n_shingles", F.col("component").alias("component_id"))
    return out.unionByName(rows.where("n_shingles = 0").select("doc_id", "n_shingles", F.col("doc_id").alias("component_id")))
