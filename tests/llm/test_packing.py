import random
import zlib

import numpy as np

from quillstone.llm.packing import fullest, pack, windows


def test_pieces_round_trip(spark):
    import public_tokenizers
    from tokenizers import Tokenizer

    tok = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))
    r = random.Random(2)
    rows = [(i, " ".join(r.choice(["the", "Nation's", "é", "ΑΣ", "x1y", "<|endoftext|>", "don't", "́a", "\x1c", "\x01", "a\x01b", "<|STARTOFTEXT|>", "ΑΣ.", "İK", "😀"]) for _ in range(r.choice([0, 1, 5, 60, 300])))) for i in range(200)]
    rows += [(900, None), (901, ""), (902, " \n\t"), (903, "long text " * 3000), (904, "a" * 5000), (905, "a b c"), (None, "null id")]
    df = spark.createDataFrame([(d, t, "x") for d, t in rows], "doc_id long, text string, bucket string")
    got = pack(df, window=512, group=100).collect()
    want = {d: [*tok.encode(t or "", add_special_tokens=False).ids, 2] for d, t in rows}
    by, seq = {}, {}
    for x in got:
        ids = want[x.doc_id]
        assert x.doc_tokens == len(ids) and x.ids_crc32 == zlib.crc32(np.array(ids[x.start : x.start + x.length], "<u4").tobytes())
        by.setdefault(x.doc_id, []).append((x.start, x.length))
        seq.setdefault(x.sequence_id, []).append((x.offset, x.length))
    for d, ids in want.items():
        at = 0
        for s, n in sorted(by[d]):
            assert s == at
            at += n
        assert at == len(ids)
    for parts in seq.values():
        at = 0
        for o, n in sorted(parts):
            assert o == at
            at += n
        assert at <= 512
    assert sum(map(len, want.values())) / (512 * len(seq)) > 0.9


def test_fullest_equals_brute_force():
    r = random.Random(3)
    for _ in range(300):
        sizes = [r.randint(1, 30) for _ in range(r.randint(1, 9))]
        room = r.randint(0, 70)
        best = max(t for m in range(1 << len(sizes)) if (t := sum(s for i, s in enumerate(sizes) if m >> i & 1)) <= room)
        count = [0] * 200
        for s in sizes:
            count[s] += 1
        use = fullest(room, sorted(set(sizes)), count)
        assert sum(s * k for s, k in use.items()) == best and all(k <= count[s] for s, k in use.items())


def test_windows_hold_every_piece():
    r = random.Random(1)
    sizes = [r.randint(1, 4096) for _ in range(3000)]
    got = windows(sizes, 4096)
    assert sorted(s for w in got for s in w) == sorted(sizes) and max(map(sum, got)) <= 4096
    assert sum(sizes) / (4096 * len(got)) > 0.97


def test_empty(spark):
    assert pack(spark.createDataFrame([], "doc_id long, text string")).collect() == []
