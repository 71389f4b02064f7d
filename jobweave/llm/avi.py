"""Motion-JPEG AVI media columns: lossless intra frames, a RIFF index, and shots by adaptive histogram differences.

A payload of 192-byte units becomes 8 x 8 frames of three 8-bit components, each a lossless JPEG (SOF3, left
predictor). Frames are located through the file's idx1 chunk and decoded on their own. All frames of a batch go
through the entropy coder together, one sample at a time, so numpy does the work.

Defined cases: a null or empty text is one unit of blanks. Repeated rows are coded each. Extra columns are ignored;
an empty table gives an empty one.
"""

from __future__ import annotations

import hashlib
import struct
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

UNIT, SIDE, FPS, BINS = 192, 8, 25, 16
#: Shots: a histogram difference over mean + SPREAD * deviation of up to WINDOW before it, and over LEAST.
WINDOW, SPREAD, LEAST = 8, 2.0, 0.25
TOGETHER = 4096  # units coded at a time
# JPEG and AVI headers. Difference classes 0 to 8 have codes of four bits.
DHT = b"\xff\xc4" + struct.pack(">HB16B9B", 28, 0, *[0, 0, 0, 9] + [0] * 12, *range(9))
SOF3 = b"\xff\xc3" + struct.pack(">HBHHB9B", 17, 8, SIDE, SIDE, 3, 1, 0x11, 0, 2, 0x11, 0, 3, 0x11, 0)
SOS = b"\xff\xda" + struct.pack(">HB6B3B", 12, 3, 1, 0, 2, 0, 3, 0, 1, 0, 0)
HEAD, TAIL = b"\xff\xd8" + DHT + SOF3 + SOS, b"\xff\xd9"


def predictions(x: np.ndarray) -> np.ndarray:
    """What each sample of frames (n, row, column, component) is predicted from: its left, else upper neighbour."""
    p = np.full_like(x, 128)
    p[:, :, 1:] = x[:, :, :-1]
    p[:, 1:, 0] = x[:, :-1, 0]
    return p


def coded(units: np.ndarray) -> list[bytes]:
    """JPEG files of units (n, UNIT)."""
    x = units.reshape(-1, SIDE, SIDE, 3).astype(np.int32)
    d = (x - predictions(x)).reshape(len(x), UNIT)
    size = np.zeros(d.shape, np.int32)
    for k in range(9):
        size += np.abs(d) >= 1 << k
    code = (size << size) | np.where(d < 0, d + (1 << size) - 1, d)
    bits = size + 4
    n, rows = len(x), np.arange(len(x))
    out = np.zeros((n, UNIT * 3 // 2 + 4), np.uint8)
    held, count, at = np.zeros(n, np.int64), np.zeros(n, np.int64), np.zeros(n, np.int64)
    for k in range(UNIT):
        held = (held << bits[:, k]) | code[:, k]
        count += bits[:, k]
        for _ in range(2):
            ready = count >= 8
            out[rows[ready], at[ready]] = (held[ready] >> (count[ready] - 8)) & 255
            at += ready
            count -= 8 * ready
        held &= (1 << count) - 1
    rest = count > 0
    out[rows[rest], at[rest]] = ((held[rest] << (8 - count[rest])) | ((1 << (8 - count[rest])) - 1)) & 255
    at += rest
    return [HEAD + out[k, : at[k]].tobytes().replace(b"\xff", b"\xff\x00") + TAIL for k in range(n)]


def decoded(frames: list[bytes]) -> np.ndarray:
    """Units (n, UNIT) of JPEG files."""
    data = [f[f.index(SOS) + len(SOS) : -2].replace(b"\xff\x00", b"\xff") for f in frames]
    begin = np.cumsum([0, *map(len, data)])[:-1]
    raw = np.frombuffer(b"".join(data) + b"\0\0\0", np.uint8).astype(np.int32)
    word = (raw[:-2] << 16) | (raw[1:-1] << 8) | raw[2:]
    place = begin.astype(np.int64) * 8
    d = np.empty((UNIT, len(frames)), np.int32)
    for k in range(UNIT):
        some = word[place >> 3] & ((1 << (24 - (place & 7))) - 1)
        room = 20 - (place & 7)
        size = some >> room
        value = (some >> (room - size)) & ((1 << size) - 1)
        d[k] = np.where((size > 0) & (value < (1 << np.maximum(size - 1, 0))), value - (1 << size) + 1, value)
        place += 4 + size
    d = np.ascontiguousarray(d.T).reshape(-1, SIDE, SIDE, 3)
    d[:, 0, 0] += 128
    d[:, :, 0] = np.cumsum(d[:, :, 0], axis=1)
    return (np.cumsum(d, axis=2) & 255).astype(np.uint8).reshape(-1, UNIT)


def chunk(name: bytes, body: bytes) -> bytes:
    return name + struct.pack("<I", len(body)) + body + b"\0" * (len(body) % 2)


def avi(frames: list[bytes]) -> bytes:
    """An AVI file of JPEG frames with an idx1 index."""
    n, largest = len(frames), max(map(len, frames))
    avih = struct.pack("<14I", 1_000_000 // FPS, largest * FPS, 0, 0x10, n, 0, 1, largest, SIDE, SIDE, 0, 0, 0, 0)
    strh = struct.pack("<4s4sIHHIIIIIIII4H", b"vids", b"MJPG", 0, 0, 0, 0, 1, FPS, 0, n, largest, 0xFFFFFFFF, 0, 0, 0, SIDE, SIDE)
    strf = struct.pack("<IiiHH4sIiiII", 40, SIDE, SIDE, 1, 24, b"MJPG", UNIT, 0, 0, 0, 0)
    header = chunk(b"LIST", b"hdrl" + chunk(b"avih", avih) + chunk(b"LIST", b"strl" + chunk(b"strh", strh) + chunk(b"strf", strf)))
    body = [chunk(b"00dc", f) for f in frames]
    offsets = np.cumsum([4, *map(len, body)])[:-1]
    index = np.zeros((n, 4), "<u4")
    index[:, 0], index[:, 1], index[:, 2], index[:, 3] = int.from_bytes(b"00dc", "little"), 0x10, offsets, list(map(len, frames))
    return chunk(b"RIFF", b"AVI " + header + chunk(b"LIST", b"movi" + b"".join(body)) + chunk(b"idx1", index.tobytes()))


def frames_of(file: bytes) -> list[bytes]:
    """The frames that a file's index names."""
    at, movi, index = 12, None, None
    while at + 8 <= len(file):
        name, (size,) = file[at : at + 4], struct.unpack_from("<I", file, at + 4)
        if name == b"LIST" and file[at + 8 : at + 12] == b"movi":
            movi = at + 8
        elif name == b"idx1":
            index = np.frombuffer(file, "<u4", size // 4, at + 8).reshape(-1, 4)
        at += 8 + size + size % 2
    if movi is None or index is None:
        raise ValueError("no movi list or no idx1 index")
    return [file[movi + a + 8 : movi + a + 8 + n] for a, n in index[:, 2:].tolist()]


def shots(units: np.ndarray) -> tuple[list[int], np.ndarray]:
    """First frames of shots, and each frame's histogram."""
    n = len(units)
    hist = np.bincount((np.arange(n)[:, None] * BINS + (units >> 4)).ravel(), minlength=n * BINS).reshape(n, BINS)
    differ = np.abs(np.diff(hist, axis=0)).sum(1) / (2 * UNIT)
    starts = [0]
    if n > 2:
        one, two = np.r_[0, np.cumsum(differ)], np.r_[0, np.cumsum(differ * differ)]
        k = np.arange(1, n - 1)
        lo = np.maximum(k - WINDOW, 0)
        mean = (one[k] - one[lo]) / (k - lo)
        spread = np.sqrt(np.maximum((two[k] - two[lo]) / (k - lo) - mean * mean, 0))
        starts += (k[(differ[1:] > mean + SPREAD * spread) & (differ[1:] > LEAST)] + 1).tolist()
    return starts, hist


def payload(text: str | None) -> tuple[int, bytes]:
    raw = (text or "").encode()
    return len(raw), raw.ljust(max(1, -(-len(raw) // UNIT)) * UNIT)


def in_parts(texts: list[str | None]) -> Iterator[tuple[int, int]]:
    """Ranges of texts that hold about TOGETHER units."""
    first, held = 0, 0
    for k, t in enumerate(texts):
        held += 1 + len(t or "") // UNIT
        if held >= TOGETHER or k + 1 == len(texts):
            yield first, k + 1
            first, held = k + 1, 0


def stored(texts: list[str | None]) -> list[tuple[int, bytes, np.ndarray]]:
    """For each text: its bytes, its file, and the units read back from that file."""
    loads = [payload(t) for t in texts]
    frames = coded(np.frombuffer(b"".join(p for _, p in loads), np.uint8).reshape(-1, UNIT))
    ends = np.cumsum([len(p) // UNIT for _, p in loads])
    files = [avi(frames[b - len(p) // UNIT : b]) for b, (_, p) in zip(ends, loads, strict=True)]
    units = decoded([f for file in files for f in frames_of(file)])
    return [(n, file, u) for (n, _), file, u in zip(loads, files, np.split(units, ends[:-1]), strict=True)]


def describe(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    names = ("n_bytes", "payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "media_sha256", "feature")
    for batch in batches:
        texts, rows = batch["text"].to_pylist(), []
        for a, b in in_parts(texts):
            for n, file, units in stored(texts[a:b]):
                back = units.tobytes()
                starts, hist = shots(units)
                longest = int(np.diff([*starts, len(units)]).max())
                feature = f"frames={len(units)};shots={len(starts)};longest={longest};mean={units.mean():.3f};hist={zlib.crc32(hist.astype('<i8').tobytes()):08x}"
                rows.append((n, len(back), hashlib.sha256(back).hexdigest(), zlib.crc32(back[-16:]), len(file), hashlib.sha256(file).hexdigest(), feature))
        columns = list(zip(*rows, strict=True)) if rows else [[]] * 7
        kinds = (pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.string(), pa.string())
        yield pa.RecordBatch.from_arrays([batch["doc_id"], *(pa.array(c, k) for c, k in zip(columns, kinds, strict=True))], names=["doc_id", *names])


def features(docs: DataFrame) -> DataFrame:
    """Digests and features of each row's file, as read back from it."""
    kind = docs.schema["doc_id"].dataType.simpleString()
    schema = f"doc_id {kind}, n_bytes long, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string"
    return docs.select("doc_id", "text").mapInArrow(describe, schema)


def media(docs: DataFrame) -> DataFrame:
    """(doc_id, file): each row's AVI file."""

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = batch["text"].to_pylist()
            for a, b in in_parts(texts):
                yield pa.RecordBatch.from_arrays([batch["doc_id"].slice(a, b - a), pa.array([f for _, f, _ in stored(texts[a:b])], pa.binary())], names=["doc_id", "file"])

    return docs.select("doc_id", "text").mapInArrow(write, f"doc_id {docs.schema['doc_id'].dataType.simpleString()}, file binary")


def clips(files: DataFrame) -> DataFrame:
    """(doc_id, clip, start_s, end_s, n_frames) for each shot of files(doc_id, file)."""

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, clip, start, end = [], [], [], []
            for k, file in enumerate(batch["file"].to_pylist()):
                units = decoded(frames_of(file))
                starts, _ = shots(units)
                for c, (a, b) in enumerate(zip(starts, [*starts[1:], len(units)], strict=True)):
                    ids.append(k)
                    clip.append(c)
                    start.append(a)
                    end.append(b)
            a, b = np.array(start, float), np.array(end, float)
            yield pa.RecordBatch.from_arrays(
                [batch["doc_id"].take(pa.array(ids, pa.int64())), pa.array(clip, pa.int32()), pa.array(a / FPS), pa.array(b / FPS), pa.array((b - a).astype(int), pa.int64())],
                names=["doc_id", "clip", "start_s", "end_s", "n_frames"],
            )

    kind = files.schema["doc_id"].dataType.simpleString()
    return files.select("doc_id", "file").mapInArrow(read, f"doc_id {kind}, clip int, start_s double, end_s double, n_frames long")
