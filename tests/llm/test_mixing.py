import random
from collections import defaultdict

import pytest

from quillstone.llm.mixing import duel, mix_sources, pivot, settle

SCHEMA = "doc_id long, text string, source string, target double, n int"


def fill(sizes):
    names = sorted((s for s in sizes if s is not None)) + [None] * (None in sizes)
    w = {s: (1, 2, 3)[i % 3] for i, s in enumerate(names)}
    total, out, free = sum(sizes.values()), {}, list(names)
    left = total
    while free:
        share = left / sum(w[s] for s in free)
        over = [s for s in free if w[s] * share > 3 * sizes[s]]
        if not over:
            out |= {s: w[s] * share for s in free}
            break
        for s in over:
            out[s] = 3.0 * sizes[s]
            left -= out[s]
            free.remove(s)
    return out


def test_targets_and_words(spark):
    r = random.Random(5)
    rows = [(i, " ".join("w" * r.choice([1, 2, 5]) for _ in range(r.randint(0, 60))), r.choice(["a", "a", "a", "b", "é", "Z", "tiny", None]) if i % 97 else "one") for i in range(3000)]
    rows += [(None, "x y", "a"), (None, "x y", "a"), (7000, None, None), (7001, "", "void"), (7002, "a b", "a"), (7002, "a b", "a")]
    df = spark.createDataFrame([(*x, 1.0, 1) for x in rows], SCHEMA)
    got = mix_sources(df, bucket=64).collect()
    assert len(got) == len(rows)
    size, taken, largest = defaultdict(int), defaultdict(int), defaultdict(int)
    for x in got:
        size[x.source] += x["size"]
        taken[x.source] += x.taken
        largest[x.source] = max(largest[x.source], 2 * x["size"])
        assert 0 <= x.taken <= 3 * x["size"] and (not x["size"] or x.taken % x["size"] == 0)
    want = fill(dict(size))
    for x in got:
        assert x.source_size == size[x.source] and x.target == pytest.approx(want[x.source])
    for s in size:
        assert abs(taken[s] - want[s]) <= largest[s] + 1e-6
    again = mix_sources(df.repartition(7), bucket=64).collect()
    assert sorted(map(str, got)) == sorted(map(str, again))


def test_no_rows_and_no_words(spark):
    assert mix_sources(spark.createDataFrame([], SCHEMA)).collect() == []
    assert [x.taken for x in mix_sources(spark.createDataFrame([(1, "", "a", 1.0, 1)], SCHEMA)).collect()] == [0]


def test_pivot_keeps_mass_and_expectation():
    r = random.Random(1)
    for _ in range(2000):
        w1, p1, w2, p2 = r.randint(1, 50), r.random(), r.randint(1, 50), r.random()
        a, b = duel(w1, p1, w2, p2, r.random())
        assert w1 * a + w2 * b == pytest.approx(w1 * p1 + w2 * p2) and (a in (0, 1) or b in (0, 1)) and 0 <= a <= 1 and 0 <= b <= 1
    w, p = [3, 1, 7, 2, 5], [0.3, 0.8, 0.45, 0.5, 0.1]
    runs = [pivot(w, p, random.Random(i), True) for i in range(20_000)]
    for i in range(5):
        assert sum(x[i] for x in runs) / len(runs) == pytest.approx(p[i], abs=0.015)


def test_settle_keeps_mass_and_expectation():
    w = sorted([random.Random(2).randint(1, 40) for _ in range(60)], reverse=True)
    runs = [settle(w, 0.37, random.Random(i)) for i in range(4000)]
    for x in runs:
        assert abs(sum(a * b for a, b in zip(x, w)) - 0.37 * sum(w)) < 1e-6 and sum(0 < a < 1 for a in x) <= 1
    for i in range(0, 60, 7):
        assert sum(x[i] for x in runs) / len(runs) == pytest.approx(0.37, abs=0.03)
