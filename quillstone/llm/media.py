"""AVI motion-JPEG columns: byte payloads as clips, RIFF indexes, intra frames, shots.

Storage is lossless under any baseline decoder: a payload byte is an 8x8 block of that grey level, so a frame of 576
bytes is 192 x 192 pixels. With a DC quantiser of 8 and no AC coefficients the inverse transform gives the level back
exactly. Huffman codes are chosen so that the code of a DC difference and its extra bits always take 10 bits and the
end of block 6: a block is 16 bits, never holds the byte 255, and frames are coded and decoded as arrays.

Reading follows the index (idx1) to the frames and reads each frame's own tables. Frames in the layout above decode as
arrays; other baseline grey frames decode bit by bit.
"""

from __future__ import annotations

import struct
import zlib
from functools import lru_cache
from hashlib import sha256

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from .text import runs, utf8

SIDE, FRAME, FPS = 24, 576, 25
#: Histogram bins; frames a threshold looks back on; standard deviations above their mean that make a cut.
BINS, LOOK, SIGMAS, LEAST = 16, 12, 3.0, 0.12
#: Frames of a RIFF part: its sizes have 32 bits.
PART = 1_500_000


# --- JPEG -----------------------------------------------------------------------------------------------------------


def _segment(marker: int, body: bytes) -> bytes:
    return struct.pack(">BBH", 255, marker, len(body) + 2) + body


def _canonical(lengths: dict[int, int]) -> dict[int, tuple[int, int]]:
    """{symbol: (code, length)} in the order of a DHT segment."""
    out, code, last = {}, 0, 0
    for length, symbol in sorted((n, s) for s, n in lengths.items()):
        code <<= length - last
        out[symbol], code, last = (code, length), code + 1, length
    return out


def _dht(cls: int, lengths: dict[int, int]) -> bytes:
    order = sorted((n, s) for s, n in lengths.items())
    return _segment(0xC4, bytes([cls << 4]) + bytes(sum(n == i for n, _ in order) for i in range(1, 17)) + bytes(s for _, s in order))


#: Of a difference of c bits: a code of 10 - c. End of block: 6 bits.
_DC, _AC = {c: 10 - c for c in range(9)}, {0: 6}


@lru_cache(1)
def _tables() -> tuple[np.ndarray, np.ndarray]:
    """Of each difference + 255, its 16 bits; and back (-1000: no such block)."""
    dc, (eob, n) = _canonical(_DC), _canonical(_AC)[0]
    put, get = np.zeros(511, np.uint16), np.full(1 << 16, -1000, np.int16)
    for d in range(-255, 256):
        bits = abs(d).bit_length()
        code, length = dc[bits]
        extra = d if d >= 0 else d + (1 << bits) - 1
        put[d + 255] = ((code << bits | extra) << n | eob) & 0xFFFF
        get[put[d + 255]] = d
    return put, get


@lru_cache(1)
def _head() -> bytes:
    quant = _segment(0xDB, bytes([0, 8]) + bytes([1]) * 63)
    size = struct.pack(">BHHB", 8, SIDE * 8, SIDE * 8, 1) + bytes([1, 0x11, 0])
    return b"\xff\xd8" + quant + _segment(0xC0, size) + _dht(0, _DC) + _dht(1, _AC) + _segment(0xDA, bytes([1, 1, 0, 0, 63, 0]))


def encode_frames(samples: np.ndarray) -> np.ndarray:
    """Rows of coded frames from rows of FRAME samples."""
    put, _ = _tables()
    diff = np.diff(samples.astype(np.int16), axis=1, prepend=np.int16(128))
    body = put[diff + 255].astype(">u2").view(np.uint8).reshape(len(samples), -1)
    head, tail = np.frombuffer(_head(), np.uint8), np.array([255, 0xD9], np.uint8)
    return np.hstack([np.broadcast_to(head, (len(samples), len(head))), body, np.broadcast_to(tail, (len(samples), 2))])


def _decode_alike(frames: np.ndarray) -> np.ndarray | None:
    """Samples of frames in the layout of encode_frames; None if one isn't."""
    head = np.frombuffer(_head(), np.uint8)
    if frames.shape[1] != len(head) + 2 * FRAME + 2 or (frames[:, : len(head)] != head).any():
        return None
    words = np.ascontiguousarray(frames[:, len(head) : -2]).view(">u2")
    diff = _tables()[1][words]
    level = 128 + np.cumsum(diff, axis=1, dtype=np.int32)
    return level.astype(np.uint8) if level.min(initial=0) >= 0 and level.max(initial=0) < 256 and (frames[:, -2:] == (255, 0xD9)).all() else None


def decode_jpeg(data: bytes) -> np.ndarray:
    """Pixels of any baseline, one-component JPEG without restart markers."""
    zigzag = sorted(range(64), key=lambda i: (i // 8 + i % 8, i // 8 if (i // 8 + i % 8) % 2 else i % 8))
    at, quant, codes = 2, {}, {}
    while True:
        marker, length = data[at + 1], int.from_bytes(data[at + 2 : at + 4], "big")
        body, at = data[at + 4 : at + 2 + length], at + 2 + length
        if marker == 0xDB:
            while body:
                wide = body[0] >> 4
                quant[body[0] & 15], body = np.frombuffer(body[1 : 65 + 64 * wide], ">u2" if wide else np.uint8).astype(np.int64), body[65 + 64 * wide :]
        elif marker == 0xC4:
            while body:
                n, symbols = body[1:17], iter(body[17 : 17 + sum(body[1:17])])
                lengths = [(i + 1, next(symbols)) for i in range(16) for _ in range(n[i])]
                code, last, table = 0, 0, {}
                for size, symbol in lengths:
                    code <<= size - last
                    table[size, code], code, last = symbol, code + 1, size
                codes[body[0]], body = table, body[17 + sum(n) :]
        elif marker == 0xC0:
            height, width, parts, q = *struct.unpack(">HH", body[1:5]), body[5], body[8]
            if parts != 1:
                raise ValueError("only one component is decoded")
        elif marker == 0xDA:
            dc, ac = codes[body[2] >> 4], codes[16 | body[2] & 15]
            break
        elif marker in range(0xC1, 0xD0):
            raise ValueError("not a baseline frame")
    raw = data[at : data.rindex(b"\xff\xd9")].replace(b"\xff\x00", b"\xff")
    bits, place = np.unpackbits(np.frombuffer(raw, np.uint8)).tolist(), 0

    def symbol(table):
        nonlocal place
        code = 0
        for size in range(1, 17):
            code = code << 1 | bits[place]
            place += 1
            if (size, code) in table:
                return table[size, code]
        raise ValueError("no such code")

    def value(size):
        nonlocal place
        v = 0
        for _ in range(size):
            v, place = v << 1 | bits[place], place + 1
        return v if not size or v >> (size - 1) else v - (1 << size) + 1

    k = np.arange(8)
    basis = np.cos((2 * k[:, None] + 1) * k[None] * np.pi / 16) * np.where(k == 0, np.sqrt(1 / 8), 0.5)
    across, down, last = -(-width // 8), -(-height // 8), 0
    out = np.zeros((down * 8, across * 8), np.uint8)
    for b in range(across * down):
        coded = np.zeros(64, np.int64)
        last += value(symbol(dc))
        coded[0], i = last, 1
        while i < 64:
            s = symbol(ac)
            if s == 0:
                break
            i += s >> 4
            if s & 15:
                coded[i] = value(s & 15)
            i += 1
        square = np.zeros(64)
        square[zigzag] = coded * quant[q]
        y, x = divmod(b, across)
        out[y * 8 : y * 8 + 8, x * 8 : x * 8 + 8] = np.clip(np.round(basis @ square.reshape(8, 8) @ basis.T + 128), 0, 255)
    return out[:height, :width]


# --- AVI ------------------------------------------------------------------------------------------------------------


def _chunk(tag: bytes, body: bytes) -> bytes:
    return tag + struct.pack("<I", len(body)) + body + b"\0" * (len(body) % 2)


def write_avi(payload: bytes, part: int = PART) -> bytes:
    """A clip of payload, whose length is a multiple of FRAME: one RIFF part, or more (AVIX) where there are over part frames; each has its index."""
    samples = np.frombuffer(payload, np.uint8).reshape(-1, FRAME)
    return b"".join(_part(samples[i : i + part], len(samples), b"AVIX" if i else b"AVI ") for i in range(0, len(samples), part))


def _part(samples: np.ndarray, total: int, kind: bytes) -> bytes:
    frames = encode_frames(samples)
    n, length = frames.shape
    padded = length + length % 2
    movi = np.zeros((n, 8 + padded), np.uint8)
    movi[:, :8] = np.frombuffer(b"00dc" + struct.pack("<I", length), np.uint8)
    movi[:, 8 : 8 + length] = frames
    index = np.zeros((n, 4), "<u4")
    index[:, 0], index[:, 1] = int.from_bytes(b"00dc", "little"), 16
    index[:, 2], index[:, 3] = 4 + np.arange(n) * (8 + padded), length
    px, head = SIDE * 8, b""
    if kind == b"AVI ":
        avih = struct.pack("<14I", 1_000_000 // FPS, padded * FPS, 0, 16, total, 0, 1, padded, px, px, 0, 0, 0, 0)
        strh = b"vidsMJPG" + struct.pack("<IHHIIIIIIIIHHHH", 0, 0, 0, 0, 1, FPS, 0, total, padded, 0xFFFFFFFF, 0, 0, 0, px, px)
        strf = struct.pack("<IiiHH4sIiiII", 40, px, px, 1, 24, b"MJPG", px * px * 3, 0, 0, 0, 0)
        strl = _chunk(b"LIST", b"strl" + _chunk(b"strh", strh) + _chunk(b"strf", strf))
        head = _chunk(b"LIST", b"hdrl" + _chunk(b"avih", avih) + strl)
    return _chunk(b"RIFF", kind + head + _chunk(b"LIST", b"movi" + movi.tobytes()) + _chunk(b"idx1", index.tobytes()))


def read_index(data: bytes) -> tuple[np.ndarray, float]:
    """(offset, length) of each indexed video frame of all parts, and frames a second, of a RIFF AVI file."""
    if data[:4] != b"RIFF" or data[8:12] != b"AVI ":
        raise ValueError("not an AVI file")
    fps, found, at = 0.0, [], 0
    while data[at : at + 4] == b"RIFF":
        size = int.from_bytes(data[at + 4 : at + 8], "little")
        movi, index, todo = None, None, [(at + 12, min(len(data), at + 8 + size))]
        while todo:
            here, end = todo.pop()
            while here + 8 <= end:
                tag, n = data[here : here + 4], int.from_bytes(data[here + 4 : here + 8], "little")
                if tag == b"LIST" and data[here + 8 : here + 12] == b"movi":
                    movi = here + 8
                elif tag == b"LIST":
                    todo.append((here + 12, here + 8 + n))
                elif tag == b"avih":
                    fps = 1e6 / max(1, int.from_bytes(data[here + 8 : here + 12], "little"))
                elif tag == b"idx1":
                    index = np.frombuffer(data, "<u4", n // 16 * 4, here + 8).reshape(-1, 4)
                here += 8 + n + n % 2
        if movi is None or index is None:
            raise ValueError("no index")
        video = index[index[:, 0] == int.from_bytes(b"00dc", "little")].astype(np.int64)
        start = movi if len(video) and data[movi + video[0, 2] : movi + video[0, 2] + 4] == b"00dc" else at  # offsets may count from the part
        found.append(np.stack([start + video[:, 2] + 8, video[:, 3]], 1))
        at += 8 + size + size % 2
    return np.concatenate(found), fps


def read_avi(data: bytes) -> tuple[np.ndarray, float]:
    """Samples of each frame, FRAME to a row, and frames a second."""
    index, fps = read_index(data)
    if not len(index):
        return np.zeros((0, FRAME), np.uint8), fps
    length, raw = index[0, 1], np.frombuffer(data, np.uint8)
    if (index[:, 1] == length).all():
        got, step = [], np.diff(index[:, 0])
        cuts = [0, *(np.flatnonzero(step != step[0]) + 1).tolist(), len(index)] if len(step) else [0, 1]  # where a part begins
        for a, b in zip(cuts[:-1], cuts[1:], strict=True):
            got.append(_decode_alike(np.lib.stride_tricks.as_strided(raw[index[a, 0] :], (b - a, length), (int(step[0]) if len(step) else 0, 1))))
        if all(x is not None for x in got):
            return np.concatenate(got), fps
    return np.stack([decode_jpeg(data[a : a + n])[::8, ::8].ravel() for a, n in index.tolist()]), fps


def shots(samples: np.ndarray, fps: float = FPS) -> list[tuple[int, float, float, int]]:
    """(shot, start second, end second, frames) of a clip.

    A cut is where the share of pixels that change histogram bin exceeds LEAST and the mean of the last LOOK differences
    by SIGMAS of their standard deviations. A last frame that ends in padding (255, which no text has) begins no shot.
    """
    n = len(samples)
    if not n:
        return []
    bins = (samples >> 4).astype(np.int64) + np.arange(n)[:, None] * BINS
    hist = np.bincount(bins.ravel(), minlength=n * BINS).reshape(n, BINS)
    diff = np.abs(np.diff(hist, axis=0)).sum(1) / (2 * samples.shape[1])
    one, two = (np.concatenate(([0.0], np.cumsum(x))) for x in (diff, diff * diff))
    at = np.arange(len(diff))
    low = np.maximum(0, at - LOOK)
    m = np.maximum(1, at - low)
    mean = (one[at] - one[low]) / m
    dev = np.sqrt(np.maximum(0, (two[at] - two[low]) / m - mean * mean))
    cuts = np.flatnonzero((diff > LEAST) & (diff > mean + SIGMAS * dev)) + 1
    cuts = cuts[cuts < n - (samples[-1, -1] == 255)]
    edge = [0, *cuts.tolist(), n]
    return [(i, a / fps, b / fps, b - a) for i, (a, b) in enumerate(zip(edge[:-1], edge[1:], strict=True))]


def payload_of(raw: bytes) -> bytes:
    return raw + b"\xff" * (-len(raw) % FRAME if raw else FRAME)


def _texts(batches):
    for batch in batches:
        buf, off = utf8(batch.column(1))
        for a, b in runs(off):
            yield batch.column(0).slice(a, b - a), [buf[off[i] : off[i + 1]].tobytes() for i in range(a, b)]


def clips(docs: DataFrame) -> DataFrame:
    """(doc_id, media) of every row of docs (doc_id, text, ...): its UTF-8 bytes, 255 up to a multiple of FRAME, as a clip; null text is empty."""

    def run(batches):
        for ids, texts in _texts(batches):
            yield pa.RecordBatch.from_arrays([ids, pa.array([write_avi(payload_of(t)) for t in texts], pa.binary())], ["doc_id", "media"])

    return docs.select("doc_id", "text").mapInArrow(run, "doc_id long, media binary")


SHOT = ("shot", "start_s", "end_s", "frames")


def clip_shots(media: DataFrame) -> DataFrame:
    """(doc_id, shot, start_s, end_s, frames), a row a shot, of every row of media (doc_id, media, ...); null media has none."""

    def run(batches):
        for batch in batches:
            for doc, data in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                if data.is_valid and (rows := shots(*read_avi(data.as_buffer().to_pybytes()))):
                    yield pa.RecordBatch.from_arrays([pa.array([doc] * len(rows), pa.int64()), *map(pa.array, zip(*rows, strict=True))], ["doc_id", *SHOT])

    return media.select("doc_id", "media").mapInArrow(run, "doc_id long, shot long, start_s double, end_s double, frames long")


def digest(docs: DataFrame) -> DataFrame:
    """Of every row of docs (doc_id, text, ...), what its clip holds once it was written and read back.

    doc_id, n_bytes, payload_bytes, payload_sha256, tail_crc32, media_bytes, media_sha256, feature, clips. The feature lists
    frames, shots and each shot's length in frames; clips has a (shot, start_s, end_s, frames) for each shot, as
    clip_shots() gives them. Equal texts have equal values, repeated rows too; null text is empty; no rows give no rows;
    other columns are ignored. A text of any length is one clip, held in memory with its frames.
    """

    def one(raw: bytes) -> tuple:
        media = write_avi(payload_of(raw))
        samples, fps = read_avi(media)
        back = samples.tobytes()
        cut = shots(samples, fps)
        feature = f"frames={len(samples)};shots={len(cut)};lengths={','.join(str(x[3]) for x in cut)}"
        return len(raw), len(back), sha256(back).hexdigest(), zlib.crc32(back[-32:]), len(media), sha256(media).hexdigest(), feature, [dict(zip(SHOT, x, strict=True)) for x in cut]

    def run(batches):
        shot = pa.list_(pa.struct([("shot", pa.int64()), ("start_s", pa.float64()), ("end_s", pa.float64()), ("frames", pa.int64())]))
        kinds = [pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.string(), pa.string(), shot]
        for ids, texts in _texts(batches):
            columns = zip(*map(one, texts), strict=True)
            yield pa.RecordBatch.from_arrays([ids, *(pa.array(c, k) for c, k in zip(columns, kinds, strict=True))], ["doc_id", *names])

    names = ["n_bytes", "payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "media_sha256", "feature", "clips"]
    schema = "doc_id long, n_bytes long, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string, "
    return docs.select("doc_id", "text").mapInArrow(run, schema + "clips array<struct<shot:long,start_s:double,end_s:double,frames:long>>")
