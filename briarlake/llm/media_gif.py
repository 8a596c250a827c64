"""GIF media columns: bytes stored as the pixels of timed GIF frames, and a decoder with palettes, disposal and transparency.

`encode` writes a GIF89a with a palette of 256 different colours (three bits of red and green, two of blue). The payload
fills frame after frame of one screen. A pixel that shows already has the transparent index, if some byte value is free for
it; every `KEY` frames the screen is disposed of, so a damaged frame harms few others. Each frame is a true LZW code stream.

`decode` reads any GIF: global and local palettes, code streams with growing codes and full tables, interlacing,
transparency, disposal 0-3 and delays; a truncated file gives what it holds. The stored bytes are read back from the colours
of the rendered screen, so a wrong code, palette, disposal or transparency would show in them.

The stream decoder copies no strings. Entry j of the LZW table is the output of code j and the first byte of the next one,
which stand next to each other in the output itself. So each output byte points to an earlier one or is a literal, and
pointer doubling resolves them all at once.
"""

from __future__ import annotations

import hashlib
import struct
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from briarlake.llm._arrow import frugal, slices, text_bytes
from briarlake.llm._store import ids_and_text

WIDTH, FRAME_ROWS = 64, 128
DELAY = 10
#: Frames between two empty screens.
KEY = 16
#: Codes between clear codes: as many as fill the table of 4096 entries.
RUN = 3839
_CLEAR, _END = 256, 257
_INDEX = np.arange(256)
PALETTE = np.stack([(_INDEX >> 5) * 36, (_INDEX >> 2 & 7) * 36, (_INDEX & 3) * 85], axis=1).astype(np.uint8)
#: Classes of a colour histogram: two bits of each channel.
BINS = 64
SCHEMA = (
    "doc_id long, n_bytes long, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, "
    "media_sha256 string, feature string, n_frames int, duration_cs long, histogram array<long>"
)
FRAMES = "id long, frame int, begin_cs long, delay_cs int, disposal int, left int, top int, width int, height int, histogram array<long>"


def _codes_of(pixels: bytes) -> np.ndarray:
    """The LZW codes of pixels, without clear and end codes; the table starts anew behind every RUN codes."""
    out: list[int] = []
    add, table, following, rest = out.append, {}, _END + 1, iter(pixels)
    last = next(rest)
    for c in rest:
        key = last << 8 | c
        if key in table:
            last = table[key]
            continue
        add(last)
        last = c
        if following < 4096:
            table[key] = following
            following += 1
        else:
            table, following = {}, _END + 1
    add(last)
    return np.array(out, np.uint16)


def _stream(pixels: bytes) -> bytes:
    """The code stream of 8-bit pixels: a code's width follows from its place behind the last clear code."""
    plain = _codes_of(pixels)
    n = len(plain)
    groups = -(-n // RUN)
    codes = np.full(n + groups + 1, _CLEAR, np.uint16)
    at = np.arange(n)
    codes[at + at // RUN + 1] = plain
    codes[-1] = _END
    place = np.arange(-1, len(codes) - 1) % (RUN + 1)
    width = np.clip(np.frexp((_END + place).astype(np.float64))[1], 9, 12)
    width[0] = 9
    width[1 + RUN :: RUN + 1] = 12  # a clear code behind a full table
    bits = (codes[:, None] >> np.arange(12, dtype=np.uint16)) & 1
    return np.packbits(bits[np.arange(12) < width[:, None]].astype(np.uint8), bitorder="little").tobytes()


def _sub_blocks(data: bytes) -> bytes:
    whole = len(data) // 255
    out = np.empty((whole, 256), np.uint8)
    out[:, 0] = 255
    out[:, 1:] = np.frombuffer(data, np.uint8, whole * 255).reshape(whole, 255)
    rest = data[whole * 255 :]
    return out.tobytes() + (bytes([len(rest)]) + rest if rest else b"") + b"\0"


def encode(payload: bytes, width: int = WIDTH, frame_rows: int = FRAME_ROWS, delay: int = DELAY) -> bytes:
    """A GIF of the payload, whose length is a positive multiple of width."""
    rows = np.frombuffer(payload, np.uint8).reshape(-1, width)
    height = min(len(rows), frame_rows)
    free = np.flatnonzero(np.bincount(rows.ravel(), minlength=256) == 0)
    clear = int(free[-1]) if len(free) else -1
    out = [b"GIF89a", struct.pack("<HHBBB", width, height, 0xF7, 0, 0), PALETTE.tobytes()]
    shown = None
    for k, lo in enumerate(range(0, len(rows), frame_rows)):
        part = rows[lo : lo + frame_rows]
        drawn = part
        if shown is not None and clear >= 0:
            drawn = np.where(part == shown[: len(part)], np.uint8(clear), part)
        last = k % KEY == KEY - 1
        out += [
            b"\x21\xf9\x04" + struct.pack("<BHB", (2 if last else 1) << 2 | (clear >= 0), delay, max(clear, 0)) + b"\0",
            b"\x2c" + struct.pack("<HHHHB", 0, 0, width, len(part), 0),
            b"\x08",
            _sub_blocks(_stream(drawn.tobytes())),
        ]
        shown = None if last else part
    return b"".join([*out, b"\x3b"])


def _codes(data: np.ndarray, low: int, clear: int, end: int, at: int) -> tuple[np.ndarray, int, bool]:
    """The codes from bit `at` up to the next clear or end code: values, the bit behind, whether the stream ended."""
    size, out = low + 1, []
    bits_left = len(data) * 8 - at
    first = True
    entries = end + 1
    while True:
        # the width grows once the table holds 2^size entries; the first code after a clear adds none
        room = 4096 * 4 if size == 12 and entries >= 4095 else (1 << size) - entries + (1 if first else 0)
        n = min(room, bits_left // size)
        if n <= 0:
            return np.concatenate(out) if out else np.zeros(0, np.int64), at, True
        span = data[at // 8 : (at + n * size + 7) // 8 + 3].astype(np.int64)
        if len(span) < (n * size + 7) // 8 + 4:
            span = np.concatenate([span, np.zeros(4, np.int64)])
        place = at % 8 + np.arange(n) * size
        b = place >> 3
        values = ((span[b] | (span[b + 1] << 8) | (span[b + 2] << 16)) >> (place & 7)) & ((1 << size) - 1)
        stop = np.flatnonzero((values == clear) | (values == end))
        if len(stop):
            k = int(stop[0])
            out.append(values[:k])
            return np.concatenate(out), at + (k + 1) * size, bool(values[k] == end)
        out.append(values)
        at, bits_left = at + n * size, bits_left - n * size
        entries = min(4096, entries + n - (1 if first else 0))
        first = False
        if entries >= 1 << size and size < 12:
            size += 1


def _expand(codes: np.ndarray, clear: int) -> np.ndarray:
    """The bytes of the codes between two clear codes."""
    base = clear + 2
    if not (codes >= base).any():
        return codes.astype(np.uint8)
    n = len(codes)
    entry = codes - base
    bad = np.flatnonzero((codes >= base) & (entry > np.minimum(np.arange(n) - 1, 4096 - base - 1)))
    if len(bad):
        codes, n = codes[: bad[0]], int(bad[0])
        entry = entry[:n]
    # lengths: a code of entry j is one byte longer than code j
    depth, up = np.ones(n, np.int64), np.where(codes >= base, entry, -1)
    while (up >= 0).any():
        live = np.flatnonzero(up >= 0)
        depth[live] += depth[up[live]]
        up[live] = up[up[live]]
    begin = np.cumsum(depth) - depth
    total = int(depth.sum())
    code_of = np.repeat(np.arange(n), depth)
    inner = np.arange(total) - begin[code_of]
    source = np.where(codes[code_of] >= base, begin[np.maximum(entry, 0)][code_of] + inner, -1)
    value = np.where(source < 0, codes[code_of], 0).astype(np.uint8)
    point = np.where(source < 0, np.arange(total), source)
    while True:
        further = point[point]
        if np.array_equal(further, point):
            return value[point]
        point = further


def _pixels(data: bytes, low: int, n: int) -> np.ndarray:
    """n colour indices of a code stream; what a broken stream lacks is 0."""
    raw, clear, end = np.frombuffer(data, np.uint8), 1 << low, (1 << low) + 1
    out, got, at, ended = [], 0, 0, False
    while not ended and got < n:
        codes, at, ended = _codes(raw, low, clear, end, at)
        if len(codes):
            out.append(_expand(codes, clear))
            got += len(out[-1])
    found = np.concatenate(out)[:n] if out else np.zeros(0, np.uint8)
    return np.concatenate([found, np.zeros(n - len(found), np.uint8)])


@dataclass
class Frame:
    """A frame as stored, and the RGBA screen that a viewer shows with it."""

    delay: int
    disposal: int
    transparent: int
    left: int
    top: int
    index: np.ndarray
    palette: np.ndarray
    canvas: np.ndarray

    def colours(self) -> np.ndarray:
        """Red, green and blue of the frame's part of the screen."""
        h, w = self.index.shape
        return self.canvas[self.top : self.top + h, self.left : self.left + w, :3]


def _blocks(data: bytes, at: int) -> tuple[bytes, int]:
    """The data of the sub-blocks at a place, and the place behind them."""
    out = []
    while at < len(data) and data[at]:
        out.append(data[at + 1 : at + 1 + data[at]])
        at += data[at] + 1
    return b"".join(out), at + 1


def decode(data: bytes) -> Iterator[Frame]:
    """The frames of a GIF, one at a time. Bytes that are no GIF have none."""
    if data[:3] != b"GIF" or len(data) < 13:
        return
    width, height, flags = struct.unpack("<HHB", data[6:11])
    at, common = 13, np.zeros((0, 3), np.uint8)

    def palette(at: int, size: int) -> np.ndarray:
        return np.frombuffer(data[at : at + 3 * size].ljust(3 * size, b"\0"), np.uint8).reshape(-1, 3)

    if flags & 0x80:
        size = 2 << (flags & 7)
        common, at = palette(at, size), at + 3 * size
    canvas = np.zeros((height, width, 4), np.uint8)
    delay, disposal, transparent = 0, 0, -1
    while at < len(data):
        kind = data[at]
        if kind == 0x21 and at + 2 < len(data):
            body, behind = _blocks(data, at + 2)
            if data[at + 1] == 0xF9 and len(body) >= 4:
                packed, delay, index = struct.unpack("<BHB", body[:4])
                disposal, transparent = packed >> 2 & 7, index if packed & 1 else -1
            at = behind
        elif kind == 0x2C and at + 11 <= len(data):
            left, top, w, h, packed = struct.unpack("<HHHHB", data[at + 1 : at + 10])
            at, own = at + 10, common
            if packed & 0x80:
                size = 2 << (packed & 7)
                own, at = palette(at, size), at + 3 * size
            if at >= len(data) or not 1 <= data[at] <= 11:
                return
            low = data[at]
            body, at = _blocks(data, at + 1)
            index = _pixels(body, low, w * h).reshape(h, w)
            if packed & 0x40:
                rows = np.concatenate([np.arange(a, h, b) for a, b in ((0, 8), (4, 8), (2, 4), (1, 2))])
                plain = np.empty_like(index)
                plain[rows] = index
                index = plain
            before = canvas.copy() if disposal == 3 else None
            shown = index[: max(0, height - top), : max(0, width - left)]
            colours = np.zeros((256, 4), np.uint8)
            colours[: len(own), :3] = own
            colours[:, 3] = 255
            area = canvas[top : top + h, left : left + w]
            area[:] = np.where((shown == transparent)[..., None], area, colours[shown])
            yield Frame(delay, disposal, transparent, left, top, index, own, canvas.copy())
            if disposal == 2:
                area[:] = 0
            elif disposal == 3:
                canvas = before
            delay, disposal, transparent = 0, 0, -1
        else:
            return


def histogram(frame: Frame) -> np.ndarray:
    """Pixels of the frame's part of the screen by colour, two bits of each channel."""
    c = frame.colours().reshape(-1, 3).astype(np.int64) >> 6
    return np.bincount(c[:, 0] << 4 | c[:, 1] << 2 | c[:, 2], minlength=BINS)


def _bytes_of(frame: Frame) -> bytes:
    """The bytes whose colours in PALETTE the frame shows."""
    c = frame.colours()
    return ((c[..., 0] // 36) << 5 | (c[..., 1] // 36) << 2 | c[..., 2] // 85).astype(np.uint8).tobytes()


def timed_frames(media: DataFrame) -> DataFrame:
    """A row per frame of rows (id, gif binary): when it shows, for how long, its place and its colours. Null and broken ones have none."""
    kinds = [pa.int64(), pa.int32(), pa.int64(), pa.int32(), pa.int32(), pa.int32(), pa.int32(), pa.int32(), pa.int32(), pa.list_(pa.int64())]
    names = [x.split()[0] for x in FRAMES.split(", ")]

    def run(batches):
        for batch in slices(batches, "gif"):
            rows: list[tuple] = []
            for id_, gif in zip(batch.column("id").to_pylist(), batch.column("gif").to_pylist(), strict=True):
                begin = 0
                for k, f in enumerate(decode(gif or b"")):
                    h, w = f.index.shape
                    rows.append((id_, k, begin, f.delay, f.disposal, f.left, f.top, w, h, histogram(f).tolist()))
                    begin += f.delay
            cols = list(zip(*rows, strict=True)) if rows else [[]] * len(kinds)
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(cols, kinds, strict=True)], names)

    return media.select(F.col("id").cast("long").alias("id"), F.col("gif").cast("binary").alias("gif")).mapInArrow(frugal(run), FRAMES)


def as_gif(docs: DataFrame) -> DataFrame:
    """(id, gif) of every text: its UTF-8 bytes and zeros up to a positive multiple of 64. Null is as empty."""

    def run(batches):
        for batch in slices(batches, "text"):
            raw, offsets = text_bytes(batch.column("text"))
            gifs = [encode(_padded(raw[a:b].tobytes())) for a, b in zip(offsets[:-1], offsets[1:], strict=True)]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(gifs, pa.binary())], ["id", "gif"])

    return ids_and_text(docs).mapInArrow(frugal(run), "id long, gif binary")


def _padded(data: bytes) -> bytes:
    return data.ljust(max(WIDTH, -(-len(data) // WIDTH) * WIDTH), b"\0")


def stored(docs: DataFrame) -> DataFrame:
    """Every text as a GIF, read back from the stored bytes. Null is as empty: 64 zero bytes. Equal texts give equal rows."""
    kinds = [pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.string(), pa.string(), pa.int32(), pa.int64(), pa.list_(pa.int64())]
    names = [x.split()[0] for x in SCHEMA.split(", ")]

    def row(data: bytes) -> tuple:
        media = encode(_padded(data))
        digest, tail, size, frames, shown, colours = hashlib.sha256(), b"", 0, 0, 0, np.zeros(BINS, np.int64)
        for f in decode(media):
            back = _bytes_of(f)
            digest.update(back)
            size, tail = size + len(back), (tail + back)[-64:]
            frames, shown, colours = frames + 1, shown + f.delay, colours + histogram(f)
        feature = f"{frames}x{WIDTH}:" + ",".join(map(str, colours.tolist()))
        return len(data), size, digest.hexdigest(), zlib.crc32(tail), len(media), hashlib.sha256(media).hexdigest(), feature, frames, shown, colours.tolist()

    def run(batches):
        for batch in slices(batches, "text"):
            raw, offsets = text_bytes(batch.column("text"))
            cols = list(zip(*(row(raw[a:b].tobytes()) for a, b in zip(offsets[:-1], offsets[1:], strict=True)), strict=True))
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), *(pa.array(c, k) for c, k in zip(cols, kinds, strict=True))], names)

    return ids_and_text(docs).mapInArrow(frugal(run), SCHEMA)


def op8_media_gif(spark: SparkSession, sf_dir: str) -> DataFrame:
    return stored(spark.read.parquet(f"{sf_dir}/documents.parquet"))
