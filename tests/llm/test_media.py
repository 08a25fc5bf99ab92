import random
import zlib
from hashlib import sha256

import numpy as np

from quillstone.llm import media


def test_round_trip(spark):
    r = random.Random(1)
    texts = [None, "", "a", "é" * 288, "x" * 576, "x" * 577, "".join(chr(r.randrange(1, 0x2000)) for _ in range(9000)), "\0\1\2" * 1000, "a"]
    df = spark.createDataFrame([(i, t, "clash") for i, t in enumerate(texts)], "doc_id long, text string, feature string")
    got = {x.doc_id: x for x in media.digest(df).collect()}
    for i, t in enumerate(texts):
        raw = (t or "").encode()
        p = raw + b"\xff" * (-len(raw) % 576 or (0 if raw else 576))
        x, m = got[i], media.write_avi(p)
        assert (x.n_bytes, x.payload_bytes, x.payload_sha256, x.tail_crc32) == (len(raw), len(p), sha256(p).hexdigest(), zlib.crc32(p[-32:]))
        assert (x.media_bytes, x.media_sha256) == (len(m), sha256(m).hexdigest())
    assert got[2][1:] == got[8][1:]
    assert media.digest(df.limit(0)).collect() == []
    rows = media.clip_shots(media.clips(df)).collect()
    assert sum(x.frames for x in rows if x.doc_id == 6) == got[6].payload_bytes // 576


def test_any_decoder_reads_the_same_pixels():
    samples = np.random.default_rng(1).integers(0, 256, (2, 576)).astype(np.uint8)
    samples[1, :300] = 255
    data = media.write_avi(samples.tobytes())
    index, fps = media.read_index(data)
    assert fps == 25 and len(index) == 2
    for i, (a, n) in enumerate(index.tolist()):
        pixels = media.decode_jpeg(data[a : a + n])
        assert pixels.shape == (192, 192) and (pixels == np.kron(samples[i].reshape(24, 24), np.ones((8, 8), np.uint8))).all()
    assert (media.read_avi(data)[0] == samples).all()


def test_shots():
    dark, light = np.full((30, 576), 20, np.uint8), np.full((20, 576), 200, np.uint8)
    assert [x[3] for x in media.shots(np.vstack([dark, light, dark]))] == [30, 20, 30]
    assert media.shots(dark[:0]) == [] and len(media.shots(dark[:1])) == 1


def test_parts_of_a_long_clip():
    samples = np.random.default_rng(2).integers(0, 255, (23, 576)).astype(np.uint8)
    for part in (1, 2, 7, 22, 23, 24):
        data = media.write_avi(samples.tobytes(), part)
        index, fps = media.read_index(data)
        assert data.count(b"AVIX") == -(-23 // part) - 1 and fps == 25 and len(index) == 23
        assert (media.read_avi(data)[0] == samples).all()
        a, n = index[-1].tolist()
        assert (media.decode_jpeg(data[a : a + n])[::8, ::8].ravel() == samples[-1]).all()


def plain_shots(raw):
    """Cuts of a text's bytes frame by frame; a frame with padding begins none."""
    frames = [raw[i : i + 576] for i in range(0, len(raw), 576)]
    diff = []
    for p, q in zip(frames, frames[1:]):
        count = lambda f: [sum(x >> 4 == k for x in f) + (k == 15) * (576 - len(f)) for k in range(16)]
        diff.append(sum(abs(x - y) for x, y in zip(count(p), count(q))) / 1152)
    cuts = [0]
    for i, x in enumerate(diff):
        last = diff[max(0, i - 12) : i]
        mean = sum(last) / max(1, len(last))
        dev = (max(0, sum(y * y for y in last) / max(1, len(last)) - mean * mean)) ** 0.5
        if x > 0.12 and x > mean + 3 * dev + 1e-12 and len(frames[i + 1]) == 576:
            cuts.append(i + 1)
    return [b - a for a, b in zip(cuts, [*cuts[1:], max(1, len(frames))])]


def test_feature_and_clips_equal_brute_force(spark):
    r = random.Random(5)
    rows = [(i, "".join(r.choice(["ab ", "XY!", "éÉ", "0 1"]) * r.choice([50, 200, 700]) for _ in range(r.randint(1, 9)))) for i in range(25)] + [(90, None), (91, "a"), (92, "long " * 40_000), (92, "long " * 40_000)]
    rows += [(100, "a" * 576 * 40 + "é" * 5)]
    got = media.digest(spark.createDataFrame(rows, "doc_id long, text string"))
    for x, (d, t) in zip(sorted(got.collect(), key=lambda x: x.doc_id), sorted(rows, key=lambda x: x[0])):
        want = plain_shots((t or "").encode())
        assert x.feature == f"frames={max(1, -(-len((t or '').encode()) // 576))};shots={len(want)};lengths={','.join(map(str, want))}", d
        assert [c.frames for c in x.clips] == want and x.clips[-1].end_s == sum(want) / 25 and [c.shot for c in x.clips] == list(range(len(want)))
