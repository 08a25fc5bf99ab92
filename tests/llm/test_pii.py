import hashlib
import math
import random
import re

from quillstone.llm import pii

P = {
    "email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+",
    "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)",
    "card": r"[0-9]([\x20-]?[0-9])+",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}


def luhn(d):
    s = 0
    for i, c in enumerate(reversed(d)):
        v = int(c) * (1 + i % 2)
        s += v - 9 * (v > 9)
    return s % 10 == 0


def good(kind, m):
    d = re.sub("[^0-9]", "", m)
    return {"email": True, "ip": kind != "ip" or all(int(x) <= 255 for x in m.split(".")), "card": 12 <= len(d) <= 19 and luhn(d or "1"), "phone": 9 <= len(d) <= 15}[kind]


def brute(t):
    spans = [(m.start(), i, m.end(), k) for i, k in enumerate(P) for m in re.finditer(P[k], t or "") if good(k, m[0])]
    spans.sort()
    return [sum(s[3] == k for s in spans) for k in P], ",".join(f"{k}:{a}:{b}" for a, _, b, k in spans)


def test_base_spans_equal_brute_force(spark):
    r = random.Random(8)
    bits = ["a@b.co", "x.y+z@q-r.s.t", "@", "a@b", "1.2.3.4", "256.1.1.1", "001.02.3.255", "1.2.3.4.5.6.7.8", "4111 1111 1111 1111", "4111-1111-1111-1112", "411111111111 1111",
            "+1 (555) 010-9999", "+49 30 123456", "+1", "0", " ", " ", "\n", "é", "😀", "word", ".", "-", "5", "_c@d.e", "@d.e"]
    rows = [(i, "".join(r.choice(bits) for _ in range(r.randint(0, 25)))) for i in range(1500)]
    rows += [(9000, None), (9001, ""), (9002, "7 " * 40_000), (9003, "a." * 40_000 + "@"), (9004, "x@y" + ".z" * 30_000), (9005, "1." * 30_000), (9006, "a@b.co"), (9006, "a@b.co")]
    df = spark.createDataFrame([(d, t, "x", "y") for d, t in rows], "doc_id long, text string, spans string, t string")
    got = {x.doc_id: x for x in pii.find(df).collect()}
    for d, t in rows:
        n, s = brute(t)
        x = got[d]
        assert [x.n_email, x.n_ip, x.n_card, x.n_phone] == n and x.base_sha256 == hashlib.sha256(s.encode()).hexdigest(), (d, t, s, x.spans)


def test_terms(spark):
    filler = "one two three four five six seven eight nine and ten".split()
    rows = [(i, " ".join(filler[i % 7 :] + filler[: i % 5])) for i in range(200)]
    rows += [(300 + i, f"{filler[i]} {filler[i + 1]} Zorblatt, kim@x.org {filler[i + 2]} {filler[i + 3]} and zorblatt") for i in range(5)]
    rows += [(400 + i, "same same quux jo@x.org same same") for i in range(9)]  # copies are one surrounding
    df = spark.createDataFrame(rows, "doc_id long, text string")
    got = {x.doc_id: x for x in pii.find(df).collect()}
    assert all(got[300 + i].n_term == 2 and got[300 + i].spans.count("term:") == 2 for i in range(5))
    assert all(x.n_term == 0 and not x.spans for d, x in got.items() if d < 300) and got[400].n_term == 0
    clean = {x.doc_id: x.text for x in pii.sanitise(df).collect()}
    assert "orblatt" not in clean[300] and "[EMAIL]" in clean[300] and clean[5] == dict(rows)[5]


def test_terms_of_a_signature(spark):
    filler = "one two three four five six seven eight nine and ten or call contact".split()
    rows = [(i, " ".join(filler[i % 9 :] + filler[: i % 6])) for i in range(200)]
    rows += [(300 + i, f"{filler[i]} {filler[i + 3]} two three\nContact Jane Doe at jane@x.org or call one two three") for i in range(2)]
    rows += [(400 + i, f"one two{' ' * i} three Contact Quux at jo@x.org or call") for i in range(1, 9)]  # copies but for blanks are one document
    got = {x.doc_id: x for x in pii.find(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert [got[300 + i].n_term for i in range(2)] == [2, 2] and all(x.n_term == 0 for d, x in got.items() if d < 300 or d > 400)


def test_terms_of_the_whole_text(spark):
    filler = "one two three four five six seven eight nine and ten".split()
    rows = [(i, " ".join(filler[i % 7 :] + filler[: i % 5])) for i in range(200)]
    rows += [(300 + i, f"Zorblatt Works\n{' '.join(filler[i:] * 9)}\nName:{' ' * 120}kim@x.org {' '.join(filler[: i + 1] * 9)}\nquux") for i in range(4)]
    rows += [(400 + i, f"{filler[i]} six ten kim@x.org") for i in range(1)]
    got = {x.doc_id: x for x in pii.find(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert [got[300 + i].n_term for i in range(4)] == [4] * 4  # zorblatt, works, name, quux
    assert all(x.n_term == 0 for d, x in got.items() if d < 300 or d == 400)


def test_disclosing_equals_brute_force(spark):
    r = random.Random(3)
    rows = [(i, " ".join(r.choices([f"w{'abcdefghij'[j % 10]}{'klmnopq'[j // 10]}" for j in range(70)], [1 / (j + 1) for j in range(70)], k=r.randint(1, 30)) + [f"p{r.randint(1, 9)}@x.org"] * (r.random() < 0.3))) for i in range(400)]
    rows += rows[:40]
    docs = {(frozenset(w for w in t.split() if "@" not in w), frozenset(w for w in t.split() if "@" in w), t) for _, t in rows}
    n = lambda f: sum(map(f, docs))
    want = set()
    for e in {e for d in docs for e in d[1]}:
        for w in {w for d in docs if e in d[1] for w in d[0]}:
            ne, nt, nb = n(lambda d: e in d[1]), n(lambda d: w in d[0]), n(lambda d: e in d[1] and w in d[0])  # noqa: B023
            if nb >= 2 and math.log2(nb * len(docs) / (nt * ne)) / math.log2(len(docs) / ne) >= 0.3:
                want.add(("email:" + e, w))
    t = spark.createDataFrame(rows, "rid long, text string")
    got = {tuple(x) for x in pii.disclosing(pii.base_spans(t).where("size(base) > 0"), t.select(pii.F.col("text").alias("t")), 0.3).collect()}
    assert len(want) > 3 and got == want


def test_empty(spark):
    assert pii.find(spark.createDataFrame([], "doc_id long, text string")).collect() == []


def test_terms_of_a_kind_equal_brute_force(spark):
    r = random.Random(6)
    words = [f"w{'abcdefghij'[j % 10]}{'klmnopq'[j // 10]}" for j in range(70)]
    rows = []
    for i in range(300):
        t = r.choices(words, [1 / (j + 1) for j in range(70)], k=r.randint(3, 30))
        if i % 6 == 0:
            t += [r.choice(["Fon:", "call"]), f"+49 30 {100000 + i}"]
        if i % 11 == 0:
            t += [f"kim{i if i % 2 else ''}@x.org"]
        rows.append((i, " ".join(t)))
    rows += [(1000 + i, t) for i, t in rows[:40]]
    docs = {}
    for _, t in rows:
        phone = re.search(r"\+49 30 [0-9]+", t)
        docs[t] = ({w.strip(":").lower() for w in t.split() if not re.search("[0-9@]", w)}, {"phone:" + re.sub("[^0-9]", "", phone[0])} if phone else set(), {"email:" + w for w in t.split() if "@" in w})
    every = [v for d in docs.values() for v in d[1] | d[2]]
    held = {t: {v if every.count(v) >= 2 else v.split(":")[0] for v in d[1] | d[2]} for t, d in docs.items()}
    want = set()
    for e in set().union(*held.values()):
        for w in set().union(*(docs[t][0] for t in docs if e in held[t])):
            ne, nt, nb = sum(e in h for h in held.values()), sum(w in d[0] for d in docs.values()), sum(e in held[t] and w in d[0] for t, d in docs.items())
            if len(w) > 2 and nb >= (2 if ":" in e else 3) and math.log2(nb * len(docs) / (nt * ne)) / math.log2(len(docs) / ne) >= 0.9:
                want.add((e, w))
    t = spark.createDataFrame(rows, "rid long, text string")
    got = {tuple(x) for x in pii.disclosing(pii.base_spans(t).where("size(base) > 0"), t.select(pii.F.col("text").alias("t"))).collect()}
    assert ("phone", "fon") in want and got == want
    found = {x.doc_id: x for x in pii.find(t.withColumnRenamed("rid", "doc_id")).collect()}
    clean = {x.doc_id: x.text for x in pii.sanitise(t.withColumnRenamed("rid", "doc_id")).collect()}
    told = {d: {w for e, w in want if e in held[x]} & docs[x][0] for d, x in rows}
    assert all(found[d].n_term == sum(w.strip(":").lower() in told[d] for w in x.split()) for d, x in rows)
    assert all(found[d].clean_sha256 == hashlib.sha256(clean[d].encode()).hexdigest() for d, _ in rows) and any("[PHONE]" in x and "Fon" not in x for x in clean.values())


def test_many_spans_in_one_text(spark):
    n = 3000
    df = spark.createDataFrame([(1, " ".join(f"u{i}@x.org" for i in range(n)), 5, "c")], "doc_id long, text string, rid int, clean string")
    (x,) = pii.find(df).collect()
    assert x.n_email == n and len(x.spans.split(",")) == n
    assert pii.sanitise(df).collect() == [(1, " ".join(["[EMAIL]"] * n))]
