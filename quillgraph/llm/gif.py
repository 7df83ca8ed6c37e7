"""GIF media columns: LZW code streams, palettes, disposal, transparency and timed frames.

``decode`` reads any GIF87a or GIF89a: global and local palettes, interlaced rows, graphic control extensions
(delay, transparent index, disposal 0 to 3), application and comment extensions (skipped), deferred clear codes.
A file that breaks off or breaks the format raises ``BadGif``; in a column it gives no frames and an ``error``.

``encode_samples`` stores 8-bit samples losslessly: a grey palette in which index i has colour (i, i, i), rows of 64 samples,
frames of at most 1024 rows, each with delay 40 ms and disposal "leave". Equal samples give equal files.

Documents: a null or empty text is 64 zero bytes; a null doc_id is kept; every row is answered by itself.
"""

from __future__ import annotations

import hashlib
import struct
import zlib
from collections.abc import Iterator
from dataclasses import dataclass
from functools import cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from . import common

# Fixed values of the format.
MAX_CODE, MAX_WIDTH = 4096, 12
INTERLACE = ((0, 8), (4, 8), (2, 4), (1, 2))

ROW, FRAME_ROWS, DELAY_CS = 64, 1024, 4
GREY = bytes(v for i in range(256) for v in (i, i, i))
#: Colour histogram: two bits of each channel; the last bin holds pixels that show nothing.
BINS = 64


class BadGif(ValueError):
    pass


@dataclass
class Frame:
    x: int
    y: int
    width: int
    height: int
    delay_ms: int
    disposal: int
    transparent: int | None
    canvas: np.ndarray  # rows x columns, packed R | G << 8 | B << 16 | A << 24, after this frame was drawn
    histogram: np.ndarray  # BINS + 1 counts over the canvas


@cache
def widths(bits: int, n: int) -> tuple[np.ndarray, np.ndarray]:
    """Widths and bit offsets of the codes after a clear code: code i is read when bits.. entries up to 2**bits + 1 + i are known."""
    known = np.arange(n, dtype=np.int64) + (1 << bits) + 1
    w = np.full(n, bits + 1, np.int64)
    for k in range(bits + 1, MAX_WIDTH):
        w[known >= (1 << k)] = k + 1
    return w, np.concatenate(([0], np.cumsum(w)))


def lzw_codes(data: bytes) -> Iterator[list[int]]:
    """LZW codes of 8-bit samples, in runs that a clear code ends: a run fills the table."""
    room = MAX_CODE - 258
    table: dict[int, int] = {}
    out: list[int] = []
    add = out.append
    find = table.get
    n = 258
    prefix = -1
    for c in data:
        if prefix < 0:
            prefix = c
            continue
        key = prefix << 8 | c
        code = find(key)
        if code is not None:
            prefix = code
            continue
        add(prefix)
        table[key] = n
        n += 1
        prefix = c
        if n == MAX_CODE:
            assert len(out) == room
            yield out
            table.clear()
            out = []
            add = out.append
            n = 258
    if prefix >= 0:
        add(prefix)
    yield out


def lzw_pack(data: bytes) -> bytes:
    """The LZW stream of 8-bit samples: least significant bits first, a clear code at the start, an end code at the end."""
    codes, sizes = [np.array([256])], [np.array([9])]
    runs = list(lzw_codes(data))
    for i, run in enumerate(runs):
        w, _ = widths(8, MAX_CODE)
        codes += [np.array(run, np.int64), np.array([256 if i + 1 < len(runs) else 257])]
        sizes += [w[: len(run)], w[len(run) : len(run) + 1]]
    code, size = np.concatenate(codes), np.concatenate(sizes)
    place = np.arange(MAX_WIDTH)
    bits = (code[:, None] >> place & 1).astype(np.uint8)
    return np.packbits(bits[place < size[:, None]], bitorder="little").tobytes()


def lzw_unpack(stream: bytes, bits: int, limit: int) -> bytes:
    """At most ``limit`` samples of an LZW stream with codes from ``bits`` + 1 bits."""
    if not 1 <= bits <= 8:
        raise BadGif("code size")
    clear, end = 1 << bits, (1 << bits) + 1
    base = [bytes([i]) for i in range(clear)] + [b"", b""]
    raw = np.frombuffer(stream + b"\0\0\0", np.uint8).astype(np.uint32)
    total, at = len(stream) * 8, 0
    out: list[bytes] = []
    made = 0
    done = False
    while not done and at + bits < total and made < limit:
        table, prev, index = base.copy(), b"", 0  # a new table after each clear code
        fresh = True
        while fresh and made < limit:
            # Codes up to the next clear or end code; widths depend on their index alone.
            w, off = widths(bits, 2 * MAX_CODE)
            if index >= MAX_CODE:
                w, off = np.full(MAX_CODE, MAX_WIDTH), np.arange(MAX_CODE + 1) * MAX_WIDTH
            elif index:
                w, off = w[index:], off[index:] - off[index]
            n = int(np.searchsorted(off[1:], total - at, side="right"))
            if not n:
                done = True
                break
            p = at + off[:n]
            byte = p >> 3
            code = ((raw[byte] | raw[byte + 1] << 8 | raw[byte + 2] << 16) >> (p & 7).astype(np.uint32)) & ((1 << w[:n]) - 1).astype(np.uint32)
            stops = np.flatnonzero((code == clear) | (code == end))
            upto = int(stops[0]) if len(stops) else n
            known = len(table)
            add, grow = out.append, table.append
            for c in code[:upto].tolist():
                if not prev:
                    if c >= clear:
                        raise BadGif("first code")
                    prev = base[c]
                    add(prev)
                    made += len(prev)
                    continue
                if c < known:
                    entry = table[c]
                elif c == known and known < MAX_CODE:
                    entry = prev + prev[:1]
                else:
                    raise BadGif("code beyond the table")
                add(entry)
                made += len(entry)
                if known < MAX_CODE:
                    grow(prev + entry[:1])
                    known += 1
                prev = entry
            if len(stops):
                at += int(off[upto] + w[upto])
                fresh, done = False, bool(code[upto] == end)
            else:
                at += int(off[n])
                index += n
    return b"".join(out)[:limit]


def blocks(data: bytes) -> bytes:
    whole = len(data) // 255
    body = b""
    if whole:
        full = np.frombuffer(data, np.uint8, whole * 255).reshape(whole, 255)
        body = np.hstack([np.full((whole, 1), 255, np.uint8), full]).tobytes()
    rest = data[whole * 255 :]
    return body + (bytes([len(rest)]) + rest if rest else b"") + b"\0"


def encode_samples(samples: bytes, row: int = ROW, frame_rows: int = FRAME_ROWS, delay_cs: int = DELAY_CS) -> bytes:
    """A GIF89a whose frames, one under the other in time, hold the samples; their number is a positive multiple of ``row``."""
    if not samples or len(samples) % row:
        raise ValueError(f"samples must be a positive multiple of {row}")
    rows = len(samples) // row
    out = [b"GIF89a", struct.pack("<HHBBB", row, min(rows, frame_rows), 0xF7, 0, 0), GREY]
    for top in range(0, rows, frame_rows):
        part = samples[top * row : (top + frame_rows) * row]
        out += [b"\x21\xf9\x04", struct.pack("<BHB", 1 << 2, delay_cs, 0), b"\0", b"\x2c", struct.pack("<HHHHB", 0, 0, row, len(part) // row, 0), b"\x08", blocks(lzw_pack(part))]
    return b"".join([*out, b"\x3b"])


def read_blocks(data: bytes, at: int) -> tuple[bytes, int]:
    parts = []
    while True:
        if at >= len(data):
            raise BadGif("sub-block")
        n = data[at]
        if not n:
            return b"".join(parts), at + 1
        parts.append(data[at + 1 : at + 1 + n])
        at += 1 + n


def read_palette(data: bytes, at: int, packed: int) -> tuple[np.ndarray | None, int]:
    if not packed & 0x80:
        return None, at
    n = 2 << (packed & 7)
    raw = np.frombuffer(data[at : at + 3 * n], np.uint8)
    if len(raw) < 3 * n:
        raise BadGif("palette")
    rgb = raw.reshape(n, 3).astype(np.uint32)
    full = np.zeros(256, np.uint32)
    full[:n] = rgb[:, 0] | rgb[:, 1] << 8 | rgb[:, 2] << 16 | 0xFF000000
    return full, at + 3 * n


def bins_of(colour: np.ndarray) -> np.ndarray:
    seen = (colour >> 6 & 3) << 4 | (colour >> 14 & 3) << 2 | colour >> 22 & 3
    return np.where(colour >> 24, seen, BINS).astype(np.uint8)


def decode(data: bytes) -> Iterator[Frame]:
    """Frames in order, each with the canvas as it shows."""
    try:
        yield from _decode(data)
    except (struct.error, IndexError) as e:
        raise BadGif(str(e)) from e


def _decode(data: bytes) -> Iterator[Frame]:
    if data[:6] not in (b"GIF87a", b"GIF89a"):
        raise BadGif("header")
    width, height, packed, _, _ = struct.unpack_from("<HHBBB", data, 6)
    common_palette, at = read_palette(data, 13, packed)
    canvas = np.zeros((height, width), np.uint32)
    shown = np.full((height, width), BINS, np.uint8)
    delay, disposal, clear = 0, 0, None
    while True:
        if at >= len(data):
            raise BadGif("no trailer")
        kind = data[at]
        at += 1
        if kind == 0x3B:
            return
        if kind == 0x21:
            label = data[at]
            body, at = read_blocks(data, at + 1)
            if label == 0xF9:
                flags, delay, index = struct.unpack_from("<BHB", body)
                disposal, clear = flags >> 2 & 7, index if flags & 1 else None
            continue
        if kind != 0x2C:
            raise BadGif("block")
        x, y, w, h, flags = struct.unpack_from("<HHHHB", data, at)
        local, at = read_palette(data, at + 9, flags)
        palette = local if local is not None else common_palette
        if palette is None:
            raise BadGif("no palette")
        bits = data[at]
        stream, at = read_blocks(data, at + 1)
        index = np.frombuffer(lzw_unpack(stream, bits, w * h), np.uint8)
        if len(index) < w * h:
            raise BadGif("pixels missing")
        index = index.reshape(h, w)
        if flags & 0x40:
            order = np.concatenate([np.arange(a, h, step) for a, step in INTERLACE])
            straight = np.empty_like(index)
            straight[order] = index
            index = straight
        before = (canvas.copy(), shown.copy()) if disposal == 3 else None
        index = index[: max(0, height - y), : max(0, width - x)]
        area = (slice(y, y + index.shape[0]), slice(x, x + index.shape[1]))
        drawn, drawn_bins = palette[index], bins_of(palette)[index]
        if clear is not None:
            keep = index == clear
            drawn, drawn_bins = np.where(keep, canvas[area], drawn), np.where(keep, shown[area], drawn_bins)
        canvas[area], shown[area] = drawn, drawn_bins
        yield Frame(x, y, w, h, delay * 10, disposal, clear, canvas.copy(), np.bincount(shown.ravel(), minlength=BINS + 1))
        if disposal == 2:
            canvas[area], shown[area] = 0, BINS
        elif before:
            canvas, shown = before
        delay, disposal, clear = 0, 0, None


def samples_of(frames: Iterator[Frame]) -> bytes:
    """What encode_samples stored: the red channel of each frame's own rows."""
    return b"".join((f.canvas[f.y : f.y + f.height, f.x : f.x + f.width] & 0xFF).astype(np.uint8).tobytes() for f in frames)


MEDIA = "doc_id long, n_bytes long, media binary"
FRAMES = "doc_id long, frame int, x int, y int, width int, height int, at_ms long, delay_ms long, disposal int, transparent int, pixels binary, histogram array<long>, error string"
DIGEST = "doc_id long, n_bytes long, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string"


def padded(text: bytes) -> bytes:
    return text + bytes(-len(text) % ROW if text else ROW)


def _encode_batches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for whole in batches:
        for batch in common.small_batches(whole, "text"):
            data, off = common.flat_bytes(batch.column("text"))
            each = [bytes(data[a:b]) for a, b in zip(off[:-1], off[1:], strict=True)]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array([len(t) for t in each], pa.int64()), pa.array([encode_samples(padded(t)) for t in each], pa.binary())], names=["doc_id", "n_bytes", "media"])


def store_texts(docs: DataFrame) -> DataFrame:
    """doc_id, n_bytes and media: each text's bytes as a GIF."""
    return common.texts(docs).mapInArrow(_encode_batches, MEDIA)


def _frame_batches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    schema = pa.schema([("doc_id", pa.int64()), *((n, pa.int32()) for n in ("frame", "x", "y", "width", "height")), ("at_ms", pa.int64()), ("delay_ms", pa.int64()), ("disposal", pa.int32()), ("transparent", pa.int32()), ("pixels", pa.binary()), ("histogram", pa.list_(pa.int64())), ("error", pa.string())])
    for batch in batches:
        for doc_id, media in zip(batch.column("doc_id").to_pylist(), batch.column("media"), strict=True):
            rows, at, error = [], 0, None
            try:
                for k, f in enumerate(decode(media.as_py() or b"")):
                    rows.append((doc_id, k, f.x, f.y, f.width, f.height, at, f.delay_ms, f.disposal, f.transparent, f.canvas.tobytes(), f.histogram.tolist(), None))
                    at += f.delay_ms
            except BadGif as e:
                error = str(e)
            if error:
                rows.append((doc_id, len(rows), *[None] * 10, error))
            yield pa.RecordBatch.from_pylist([dict(zip(schema.names, r, strict=True)) for r in rows], schema=schema)


def frames(media: DataFrame) -> DataFrame:
    """One row per frame of each GIF in (doc_id, media): place, time, disposal, RGBA pixels as shown and the colour histogram. A file that fails adds a row with its error after the frames read so far."""
    return media.select("doc_id", "media").mapInArrow(_frame_batches, FRAMES)


def _digest_batches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    names = [c.split()[0] for c in DIGEST.split(", ")]
    types = [{"long": pa.int64(), "string": pa.string()}[c.split()[1]] for c in DIGEST.split(", ")]
    for batch in batches:
        cols: list[list] = [[] for _ in names]
        for doc_id, n, media in zip(batch.column("doc_id").to_pylist(), batch.column("n_bytes").to_pylist(), batch.column("media"), strict=True):
            media = media.as_py()
            parts, histogram, ms, last, payload = [], np.zeros(BINS + 1, np.int64), 0, None, None
            try:
                for f in decode(media):
                    parts.append(samples_of(iter([f])))
                    histogram += f.histogram
                    ms += f.delay_ms
                    last = f
                if last is None:
                    raise BadGif("no frame")
                payload = b"".join(parts)
                feature = f"frames={len(parts)};ms={ms};canvas={last.canvas.shape[1]}x{last.canvas.shape[0]};hist=" + ",".join(f"{i}:{histogram[i]}" for i in np.flatnonzero(histogram))
            except BadGif as e:  # a damaged file has no payload, and says why
                feature = f"error={e}"
            read = (None, None, None) if payload is None else (len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-64:]))
            for c, v in zip(cols, (doc_id, n, *read, len(media), hashlib.sha256(media).hexdigest(), feature), strict=True):
                c.append(v)
        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, types, strict=True)], names=names)


def op2_gif_media(spark, sf_dir: str) -> DataFrame:
    stored = common.stash(store_texts(common.documents(spark, sf_dir)), "gif")
    return stored.mapInArrow(_digest_batches, DIGEST)


__all__ = ["BadGif", "decode", "encode_samples", "frames", "samples_of", "store_texts"]
