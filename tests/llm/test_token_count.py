import random

import numpy as np

from quillstone.llm.token_count import Automaton, token_counts, vocabulary


def greedy(pieces, word):
    n, at = 0, 0
    while at < len(word):
        for end in range(min(len(word), at + 40), at, -1):
            if word[at:end] in pieces or end == at + 1:
                n, at = n + 1, end
                break
    return n


def test_small_vocabulary():
    r = random.Random(4)
    for _ in range(30):
        pieces = {bytes(r.choice(b"abc") for _ in range(r.randint(1, 6))) for _ in range(r.randint(0, 25))}
        a = Automaton(list(pieces))
        words = [bytes(r.choice(b"abcd") for _ in range(r.choice([1, 2, 5, 20, 150]))) for _ in range(60)]
        buf = np.frombuffer(b"".join(words), np.uint8)
        end = np.cumsum([len(w) for w in words])
        got = a.lengths(buf, end - [len(w) for w in words], end, b"")
        assert got.tolist() == [greedy(pieces, w) for w in words]


def test_counts_equal_greedy(spark):
    r = random.Random(5)
    pieces = vocabulary()
    known = set(pieces)
    texts = [None, "", " \n", "naïve 中文 😀́", "a" * 3000, " ".join("".join(r.choice("thequickbrown'É-") for _ in range(r.randint(1, 14))) for _ in range(800))]
    df = spark.createDataFrame([(i, t, 0) for i, t in enumerate(texts)], "doc_id long, text string, n_tokens int")
    got = {x.doc_id: (x.n_words, x.n_tokens) for x in token_counts(df).collect()}
    for i, t in enumerate(texts):
        words = (t or "").split()
        assert got[i] == (len(words), sum(greedy(known, "▁".encode() + w.encode()) for w in words))
    assert token_counts(df.limit(0)).collect() == []
