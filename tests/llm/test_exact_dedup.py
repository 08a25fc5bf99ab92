import hashlib
import random
import re

from quillstone.llm.exact_dedup import exact_dedup


def brute(rows):
    norm = [re.sub(r"[\x20\x09-\x0D]+", " ", t or "") for _, t in rows]
    groups = {}
    for (d, _), t in zip(rows, norm):
        groups.setdefault(t, []).append(d)
    out, seen = [], set()
    for (d, _), t in sorted(zip(rows, norm), key=lambda x: (x[0][0] is None, x[0][0] or 0)):
        keep = min((x for x in groups[t] if x is not None), default=None)
        out.append((d, keep, len(groups[t]), t not in seen, hashlib.sha256(t.encode()).hexdigest()))
        seen.add(t)
    return sorted(out, key=str)


def got(spark, rows, **k):
    df = spark.createDataFrame([(d, t, "x", 1) for d, t in rows], "doc_id long, text string, name string, n int")
    return sorted((tuple(r) for r in exact_dedup(df, **k).select("doc_id", "keep_id", "group_size", "kept", "text_sha256").collect()), key=str)


def test_equals_brute_force(spark):
    r = random.Random(4)
    base = ["".join(r.choice("ab é\n") for _ in range(r.choice([0, 3, 7, 8, 9, 30, 64, 200]))) for _ in range(60)]
    rows = []
    for i in range(400):
        t = r.choice(base)
        rows.append((i, t.replace(" ", r.choice([" ", "  ", "\t\n"])) if r.random() < 0.4 else t + r.choice(["", "", "x"])))
    rows += [(1000, None), (1001, ""), (1001, ""), (None, "a b"), (None, "a  b"), (1002, "a\vb")]
    for block in (8, 4096):
        assert got(spark, rows, block=block) == brute(rows)


def test_long_text_and_hot_group(spark):
    long = "word " * 60_000
    rows = [(i, long) for i in range(3)] + [(9, long[:-2]), (10, "x" + long)] + [(20 + i, "hot  copy") for i in range(300)]
    assert got(spark, rows, block=512) == brute(rows)


def test_empty(spark):
    assert got(spark, []) == []


def test_identity_of_every_row(spark):
    r = random.Random(9)
    texts = ["".join(r.choice("ab ") for _ in range(r.choice([0, 2, 5, 40, 700]))) for _ in range(120)] * 2 + ["only one", None]
    df = spark.createDataFrame([(i, t, "x") for i, t in enumerate(texts)], "doc_id long, text string, identity string")
    of = {x.doc_id: x.identity for x in exact_dedup(df, block=64).collect()}
    norm = [re.sub(r"[\x20\x09-\x0D]+", " ", t or "") for t in texts]
    assert len(of) == len(texts) and len({(of[i], t) for i, t in enumerate(norm)}) == len(set(of.values())) == len(set(norm))
