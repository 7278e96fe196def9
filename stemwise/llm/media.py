"""AVI motion-JPEG media columns.

Bytes are stored as 64-sample lines of lossless JPEG (process 14, 8 bits, predictor 1)
frames in an AVI file with an index. Reading parses the RIFF index, decodes the intra
frames and cuts the run of frames into shots where the histogram difference exceeds a
threshold that follows the shot so far; each shot is a timed clip.

The Huffman table gives category k a code of 16 - k bits, so code and extra bits fill 16
bits together and whole scans are coded and decoded by table; scans with other tables
are decoded bit by bit.

Cases: null and empty bytes make one line of zeros; lengths that are no multiple of 64
are padded with zeros; the last frame of a file may have fewer lines than the others;
malformed files raise ValueError; an empty table gives no rows.
"""

from __future__ import annotations

import struct
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

WIDTH = 64
LINES = 16
FPS = 25
BINS = 16
#: A cut: difference over FLOOR and over mean + SPREAD * deviation of the shot so far.
FLOOR, SPREAD = 0.25, 3.0
BATCH_BYTES = 8_000_000

CATEGORIES = range(9)


def _codes(counts: bytes, values: bytes) -> dict[tuple[int, int], int]:
    """(length, code) -> value of a JPEG Huffman table."""
    out, code, k = {}, 0, 0
    for length, n in enumerate(counts, 1):
        for _ in range(n):
            out[length, code] = values[k]
            code, k = code + 1, k + 1
        code <<= 1
    return out


COUNTS = bytes([0] * 7 + [1] * 9)
VALUES = bytes(reversed(CATEGORIES))


def _tables() -> tuple[np.ndarray, np.ndarray]:
    """16-bit word of each difference + 255, and the difference of each word."""
    code = {v: c for (_, c), v in _codes(COUNTS, VALUES).items()}
    words, back = np.zeros(511, np.uint16), np.full(65_536, 9999, np.int16)
    for d in range(-255, 256):
        k = abs(d).bit_length()
        words[d + 255] = code[k] << k | (d if d > 0 else d + (1 << k) - 1)
        back[words[d + 255]] = d
    return words, back


WORDS, BACK = _tables()


def _segment(marker: int, body: bytes) -> bytes:
    return struct.pack(">BBH", 0xFF, marker, len(body) + 2) + body


def _head(lines: int) -> bytes:
    """Start of image, lossless frame, Huffman table and scan of a frame."""
    return (
        b"\xff\xd8"
        + _segment(0xC3, struct.pack(">BHHBBBB", 8, lines, WIDTH, 1, 1, 0x11, 0))
        + _segment(0xC4, b"\x00" + COUNTS + VALUES)
        + _segment(0xDA, b"\x01\x01\x00\x01\x00\x00")
    )


HEADS = {n: _head(n) for n in range(1, LINES + 1)}


def pad(data: bytes) -> bytes:
    return data + bytes(max(WIDTH, -(-len(data) // WIDTH) * WIDTH) - len(data))


def encode_frames(payload: bytes) -> list[bytes]:
    x = np.frombuffer(payload, np.uint8).reshape(-1, WIDTH).astype(np.int16)
    d = np.empty_like(x)
    np.subtract(x[:, 1:], x[:, :-1], out=d[:, 1:])
    d[1:, 0] = x[1:, 0] - x[:-1, 0]
    d[::LINES, 0] = x[::LINES, 0] - 128
    raw = WORDS[d + 255].astype(">u2").tobytes()
    size = 2 * WIDTH * LINES
    return [HEADS[len(part) // (2 * WIDTH)] + part.replace(b"\xff", b"\xff\x00") + b"\xff\xd9" for part in (raw[i : i + size] for i in range(0, len(raw), size))]


def _chunk(name: bytes, body: bytes) -> bytes:
    return name + struct.pack("<I", len(body)) + body + b"\0" * (len(body) % 2)


def write_avi(frames: list[bytes], lines: int = LINES) -> bytes:
    largest = max(map(len, frames))
    main = struct.pack("<14I", 1_000_000 // FPS, 0, 0, 0x10, len(frames), 0, 1, largest, WIDTH, lines, 0, 0, 0, 0)
    stream = struct.pack("<4s4sIHHIIIIIIII4H", b"vids", b"MJPG", 0, 0, 0, 0, 1, FPS, 0, len(frames), largest, 0xFFFFFFFF, 0, 0, 0, WIDTH, lines)
    image = struct.pack("<IiiHH4sIiiII", 40, WIDTH, lines, 1, 8, b"MJPG", WIDTH * lines, 0, 0, 0, 0)
    head = _chunk(b"LIST", b"hdrl" + _chunk(b"avih", main) + _chunk(b"LIST", b"strl" + _chunk(b"strh", stream) + _chunk(b"strf", image)))
    chunks, index, at = [b"movi"], [], 4
    for f in frames:
        c = _chunk(b"00dc", f)
        index.append(struct.pack("<4sIII", b"00dc", 0x10, at, len(f)))
        chunks.append(c)
        at += len(c)
    body = b"AVI " + head + _chunk(b"LIST", b"".join(chunks)) + _chunk(b"idx1", b"".join(index))
    return _chunk(b"RIFF", body)


def read_avi(media: bytes) -> tuple[float, list[bytes]]:
    """Frames a second and the frames, by the file's index."""
    if media[:4] != b"RIFF" or media[8:12] != b"AVI ":
        raise ValueError("not an AVI file")
    fps, movi, index = float(FPS), 0, b""
    at, end = 12, 8 + struct.unpack_from("<I", media, 4)[0]
    while at + 8 <= end:
        name, size = media[at : at + 4], struct.unpack_from("<I", media, at + 4)[0]
        if name == b"LIST" and media[at + 8 : at + 12] == b"movi":
            movi = at + 8
        elif name == b"LIST" and media[at + 8 : at + 12] == b"hdrl":
            fps = 1e6 / struct.unpack_from("<I", media, at + 20)[0]
        elif name == b"idx1":
            index = media[at + 8 : at + 8 + size]
        at += 8 + size + size % 2
    if not movi or len(index) % 16:
        raise ValueError("no frames or no index")
    frames = []
    for name, _, offset, size in struct.iter_unpack("<4sIII", index):
        start = movi + offset
        if name[2:] in (b"dc", b"db"):
            if media[start : start + 4] != name:
                raise ValueError("the index points beside a frame")
            frames.append(media[start + 8 : start + 8 + size])
    return fps, frames


def _scan(frame: bytes) -> tuple[int, bytes, bytes, bytes]:
    """Lines, Huffman counts and values, and entropy-coded bytes of a frame."""
    if frame[:2] != b"\xff\xd8":
        raise ValueError("not a JPEG image")
    at, lines, counts, values = 2, 0, b"", b""
    while True:
        marker, size = frame[at + 1], struct.unpack_from(">H", frame, at + 2)[0]
        body = frame[at + 4 : at + 2 + size]
        at += 2 + size
        if marker == 0xC3:
            depth, lines, width, parts = struct.unpack_from(">BHHB", body)
            if (depth, width, parts) != (8, WIDTH, 1):
                raise ValueError("only 8-bit frames of one component and 64 samples a line are read")
        elif 0xC0 <= marker <= 0xCF and marker != 0xC4:
            raise ValueError("only lossless frames are read")
        elif marker == 0xC4:
            counts, values = body[1:17], body[17:]
        elif marker == 0xDA:
            if body[3] != 1:
                raise ValueError("only predictor 1 is read")
            return lines, counts, values, frame[at:-2].replace(b"\xff\x00", b"\xff")


def _bitwise(n: int, counts: bytes, values: bytes, data: bytes) -> np.ndarray:
    """n differences of a scan with any Huffman table."""
    table = _codes(counts, values)
    bits, have, at = 0, 0, 0
    out = np.empty(n, np.int16)

    def take(k: int) -> int:
        nonlocal bits, have, at
        while have < k:
            bits, have, at = bits << 8 | (data[at] if at < len(data) else 0xFF), have + 8, at + 1
        have -= k
        got = bits >> have
        bits &= (1 << have) - 1
        return got

    for i in range(n):
        length = code = 0
        while (length, code) not in table:
            code, length = code << 1 | take(1), length + 1
            if length > 16:
                raise ValueError("no such code")
        k = table[length, code]
        x = take(k)
        out[i] = x if k and x >> (k - 1) else x - (1 << k) + 1
    return out


def decode_frames(frames: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """Samples of all lines, and the frame of each line."""
    parts, counts = [], []
    for f in frames:
        lines, n, values, data = _scan(f)
        counts.append(lines)
        if n == COUNTS and values == VALUES and len(data) == 2 * WIDTH * lines:
            parts.append(BACK[np.frombuffer(data, ">u2")])
        else:
            parts.append(_bitwise(WIDTH * lines, n, values, data))
    d = np.concatenate(parts).reshape(-1, WIDTH).astype(np.int32)
    frame = np.repeat(np.arange(len(frames)), counts)
    first = np.cumsum(counts) - counts
    left = np.cumsum(d[:, 0])
    base = np.where(first > 0, left[np.maximum(first - 1, 0)], 0)
    d[:, 0] = left - base[frame] + 128
    return (np.cumsum(d, axis=1) & 0xFF).astype(np.uint8), frame


def shots(samples: np.ndarray, frame: np.ndarray) -> list[tuple[int, int, int]]:
    """(first frame, frames, mean sample) of each shot."""
    n = int(frame[-1]) + 1
    where = frame[:, None] * BINS + (samples >> 4)
    hist = np.bincount(where.ravel(), minlength=n * BINS).reshape(n, BINS)
    share = hist / hist.sum(axis=1, keepdims=True)
    jump = (np.abs(np.diff(share, axis=0)).sum(axis=1) / 2).tolist()
    cuts, count, mean, square = [0], 0, 0.0, 0.0
    for i, x in enumerate(jump, 1):
        spread = (max(square / count - mean * mean, 0.0)) ** 0.5 if count else 0.0
        if x > FLOOR and x > mean + SPREAD * spread:
            cuts.append(i)
            count, mean, square = 0, 0.0, 0.0
        else:
            count, square = count + 1, square + x * x
            mean += (x - mean) / count
    total = np.bincount(frame, samples.sum(axis=1, dtype=np.int64), n)
    size = np.bincount(frame, minlength=n) * WIDTH
    return [(a, b - a, int(total[a:b].sum()) // int(size[a:b].sum())) for a, b in zip(cuts, [*cuts[1:], n], strict=True)]


def _batches(rows: Iterator[tuple], schema: pa.Schema, sized: int) -> Iterator[pa.RecordBatch]:
    """Record batches of about BATCH_BYTES by the length of column ``sized``."""
    held, size = [], 0
    for row in rows:
        held.append(row)
        size += len(row[sized]) + 64
        if size >= BATCH_BYTES:
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*held, strict=True), schema, strict=True)], schema=schema)
            held, size = [], 0
    if held:
        yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*held, strict=True), schema, strict=True)], schema=schema)


def _id_field(df: DataFrame, id_column: str) -> tuple[str, pa.DataType]:
    from pyspark.sql.pandas.types import to_arrow_type

    kind = df.schema[id_column].dataType
    return kind.simpleString(), to_arrow_type(kind)


def to_media(df: DataFrame, id_column: str, data: str) -> DataFrame:
    """(id, n_bytes, media): the AVI file of each row's bytes (a string or binary column)."""
    sql, kind = _id_field(df, id_column)
    schema = pa.schema([(id_column, kind), ("n_bytes", pa.int64()), ("media", pa.binary())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def rows() -> Iterator[tuple]:
            for batch in batches:
                for key, x in zip(batch.column(0), batch.column(1), strict=True):
                    x = x.as_py() or b""
                    yield key.as_py(), len(x), write_avi(encode_frames(pad(x)))

        yield from _batches(rows(), schema, 2)

    return df.select(id_column, df[data].cast("binary")).mapInArrow(run, f"`{id_column}` {sql}, n_bytes long, media binary")


CLIPS = "array<struct<first:int,frames:int,start_s:double,end_s:double,mean:int>>"


def from_media(df: DataFrame, id_column: str) -> DataFrame:
    """Adds payload, frames and clips to the rows (id, n_bytes, media) of ``to_media``."""
    sql, kind = _id_field(df, id_column)
    clip = pa.list_(pa.struct([("first", pa.int32()), ("frames", pa.int32()), ("start_s", pa.float64()), ("end_s", pa.float64()), ("mean", pa.int32())]))
    schema = pa.schema([(id_column, kind), ("n_bytes", pa.int64()), ("media", pa.binary()), ("payload", pa.binary()), ("frames", pa.int32()), ("clips", clip)])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def rows() -> Iterator[tuple]:
            for batch in batches:
                for key, n, media in zip(*batch.columns, strict=True):
                    media = media.as_py()
                    fps, frames = read_avi(media)
                    samples, frame = decode_frames(frames)
                    found = [{"first": a, "frames": n_, "start_s": a / fps, "end_s": (a + n_) / fps, "mean": m} for a, n_, m in shots(samples, frame)]
                    yield key.as_py(), n.as_py(), media, samples.tobytes(), len(frames), found

        yield from _batches(rows(), schema, 2)

    return df.select(id_column, "n_bytes", "media").mapInArrow(run, f"`{id_column}` {sql}, n_bytes long, media binary, payload binary, frames int, clips {CLIPS}")
