import math
import random
from collections import Counter, defaultdict

import pytest

from quillstone.llm import lm


def split(t):
    return [x for x in (t or "").lower().replace("\n", " ").split(" ") if x]


def brute(train, texts):
    pairs = Counter()
    for t in train:
        w = ["<s>", *split(t), "</s>"]
        pairs.update(zip(w, w[1:]))
    c, n, follow, before = Counter(), sum(pairs.values()), defaultdict(Counter), Counter()
    for (h, w), k in pairs.items():
        c[w] += k
        follow[h][w] = k
        before[w] += 1
    v, types = len(c), len(pairs)
    cc = lambda counts: [sum(x == i for x in counts.values()) for i in (1, 2, 3, 4)]
    d, dw = lm.discounts(*cc(pairs)), lm.discounts(*cc(before))
    gamma = sum(dw[min(k, 3)] for k in before.values())

    def uni(w):
        return (max(before[w] - dw[min(before[w], 3)], 0) + gamma / (v + 1)) / types if types else 1 / (v + 1)

    def prob(h, w):
        tot = sum(follow[h].values())
        if not tot:
            return uni(w)
        k = follow[h][w]
        return (k - d[min(k, 3)]) / tot + sum(d[min(x, 3)] for x in follow[h].values()) / tot * uni(w)

    out = []
    for t in texts:
        w = ["<s>", *split(t), "</s>"]
        base = sum(math.log10((c[x] + 0.1) / (n + 0.1 * (v + 1))) for x in w[1:])
        out.append((len(w) - 1, sum(c[x] > 0 for x in w[1:]), n, base, sum(math.log10(prob(a, b)) for a, b in zip(w, w[1:]))))
    if types:
        for h in ["<s>", *list(c)[:5], "never"]:
            assert sum(prob(h, w) for w in c) + prob(h, "unseen") == pytest.approx(1)
    return out


def run(spark, train, texts):
    schema = "doc_id long, text string, score string, shard int"
    t = spark.createDataFrame([(i, x, "", 0) for i, x in enumerate(train)], schema)
    s = spark.createDataFrame([(i, x, "", 0) for i, x in enumerate(texts)], schema)
    return [tuple(r)[1:] for r in sorted(lm.score(s, lm.train(t)).collect(), key=lambda r: r.doc_id)]


def test_equals_brute_force(spark, monkeypatch):
    r = random.Random(9)
    words = [f"w{int(r.paretovariate(0.6)) % 300}é" for _ in range(4000)]
    train = [" ".join(r.choice(words) for _ in range(r.choice([0, 1, 5, 40, 200]))) for _ in range(150)] + [None, "", "The the THE\nthe"] + ["a b"] * 400
    texts = train[:40] + ["new words here", None, "", "a b", "a b", "the " * 5000]
    for got, want in zip(run(spark, train, texts), brute(train, texts), strict=True):
        assert got[:3] == want[:3] and got[3:] == pytest.approx(want[3:], rel=1e-9)


def test_nothing_learned(spark):
    assert run(spark, [], ["a b", None]) == [(3, 0, 0, 0.0, 0.0), (1, 0, 0, 0.0, 0.0)]
    assert run(spark, ["a"], []) == []
