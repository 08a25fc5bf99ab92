import random

import numpy as np
import pytest

from quillstone.llm.ngram_join import ngram_join, signatures

DOCS = "doc_id long, text string, lang string, sig string"


def brute(rows, n=4, num=85, den=100):
    lower = str.maketrans({c: c + 32 for c in range(65, 91)})
    sets = []
    for d, t in rows:
        w = (t or "").translate(lower).replace("\x0b", " ").replace("\x0c", " ")
        for c in "\t\n\r":
            w = w.replace(c, " ")
        w = [x for x in w.split(" ") if x]
        sets.append(frozenset(tuple(w[i : i + n]) for i in range(max(1, len(w) - n + 1))) if w else frozenset())
    root = list(range(len(rows)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for i, a in enumerate(sets):
        for j in range(i):
            b = sets[j]
            if a and b and den * len(a & b) >= num * len(a | b):
                root[find(i)] = find(j)
    least = {}
    for i, (d, _) in enumerate(rows):
        if d is not None:
            least[find(i)] = min(least.get(find(i), d), d)
    return sorted((d, len(sets[i]), least.get(find(i))) for i, (d, _) in enumerate(rows) if d is not None)


def got(spark, rows, **k):
    df = spark.createDataFrame([(d, t, "x", "clash") for d, t in rows], DOCS)
    return sorted((r.doc_id, r.n_shingles, r.component_id) for r in ngram_join(df, **k).collect() if r.doc_id is not None)


def corpus(seed, families=14):
    r = random.Random(seed)
    rows = []
    vocabulary = [f"w{i}é" for i in range(400)]
    for _ in range(families):
        base = [r.choice(vocabulary) for _ in range(r.choice([3, 5, 9, 12, 40, 90, 300]))]
        for _ in range(r.randint(1, 9)):
            w = list(base)
            for _ in range(r.choice([0, 0, 1, 1, 2, 3, 6, 12])):
                at = r.randrange(len(w))
                w[at : at + r.choice([0, 1])] = [r.choice(vocabulary)]
            rows.append((r.randrange(1 << 40), r.choice([" ", "\n", "\t "]).join(w)))
    r.shuffle(rows)
    return rows


@pytest.mark.parametrize("seed", [1, 2])
def test_equals_brute_force(spark, seed):
    rows = corpus(seed) + [(5, None), (6, ""), (7, " \n"), (8, "One"), (9, "oNE"), (9, "oNE"), (None, "one"), (None, None)]
    assert got(spark, rows) == brute(rows)


def test_chains_and_repeats_stay_whole(spark):
    base = [f"t{i}" for i in range(120)]
    rows, w = [], list(base)
    for i in range(25):  # each links with the next only
        rows.append((100 - i, " ".join(w)))
        w[(i * 5) % 120] = f"new{i}"
    rows += [(200 + i, rows[3][1]) for i in range(50)]
    assert got(spark, rows) == brute(rows)


def test_empty(spark):
    assert got(spark, []) == []


def test_linked_sets_share_a_signature():
    r = np.random.default_rng(3)
    for size in [*range(6, 60), 100, 333, 1000, 3000] * 3:
        s = np.sort(r.integers(0, 1 << 64, size, np.uint64))
        for drop in range(0, size * 15 // 100 + 1, max(1, size // 40)):
            keep = np.sort(r.choice(s, size - drop, replace=False))
            extra = r.integers(0, 1 << 64, max(0, (100 * (size - drop)) // 85 - size), np.uint64)
            b = np.sort(np.concatenate([keep, extra[: r.integers(0, len(extra) + 1)]]))
            assert len(np.intersect1d(keep, s)) * 100 >= 85 * len(np.union1d(s, b))
            assert len(np.intersect1d(signatures(s), signatures(b))), (size, drop)


def test_equal_keys_of_different_sets(spark):
    rows = corpus(5)
    assert got(spark, rows, key_bits=5) == brute(rows)


def test_long_text(spark):
    words = [f"w{i % 977}x{i}" for i in range(60_000)]
    rows = [(1, " ".join(words)), (2, " ".join([*words[:50_000], *words[50_100:]])), (3, " ".join(words[30_000:])), (4, "one two three four")]
    assert got(spark, rows) == brute(rows)


def test_a_task_gives_its_memory_back():
    from pathlib import Path

    from quillstone.llm.text import tidy

    pins, mb = [], lambda: int(Path("/proc/self/statm").read_text().split()[1]) * 4096 >> 20

    def run(batches):
        held = [b"x" * 100_000 for _ in range(3000)]
        pins.append(b"y" * 100_000)  # above the freed blocks, so that the heap can't shrink by itself
        yield from batches
        del held

    before = mb()
    assert list(tidy(run)([1, 2])) == [1, 2] and mb() - before < 150
