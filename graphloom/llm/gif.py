"""GIF frames in columns: LZW code streams, palettes, disposal, transparency, timing, colours.

Decoding reads a stream's codes a table at a time. Between two clear codes the width of the n-th
code depends on n alone, so all codes of a table are cut out of the bits at once. The entry that
code n adds is the text of code n and one more sample, which is a stretch of what is being written,
so each code is a copy from a known place of the output.

``store`` compresses a payload into timed frames, each twice as high as the one before, with shared and
local palettes, transparency and every disposal in turn. The samples are palette places, so the payload
is exact whatever colours, transparency and disposal make of the canvas.

Defined results: null content gives no frames; a file that breaks off gives the frames and samples
that are whole (missing samples are 0) and ``complete`` false; so does a stream whose sample size is not 2
to 8 bits, and a frame or canvas of more than ``MOST_PIXELS``, which is never allocated; bytes that are
no GIF give no frames; a place beyond the palette is black; repeated rows are decoded alike. Payloads are stored whole: beyond one frame's 65,535 rows of 64
samples they continue in further frames.
"""

from __future__ import annotations

import functools
import hashlib
import struct
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from .common import texts_of

TABLE = 4096
WIDTH = 64
MOST_ROWS = 65_535
FIRST_ROWS = 32
BINS = 8
#: Pixels of a frame or canvas that a reader allocates at most (64 MB in RGBA).
MOST_PIXELS = 1 << 24


@functools.lru_cache(maxsize=64)
def _widths(start: int, n: int) -> np.ndarray:
    """Bit widths of the first n codes after a clear code; ``start`` is the first free entry."""
    free = np.minimum(start + np.maximum(np.arange(n) - 1, 0), TABLE)
    grown = np.frexp(free.astype(float))[1]  # bits needed for the entry that is free when the code is read
    return np.minimum(np.maximum(grown, np.int64(start - 1).item().bit_length()), 12)


def lzw_encode(samples: bytes, bits: int = 8) -> bytes:
    """The code stream of ``samples``, each under 2**bits."""
    clear = 1 << bits
    codes: list[list[int]] = [[]]
    out, table, free = codes[0], {}, clear + 2
    at = samples[0] if samples else -1
    for sample in samples[1:]:
        pair = at << 8 | sample
        if pair in table:
            at = table[pair]
            continue
        out.append(at)
        at = sample
        if free < TABLE:
            table[pair] = free
            free += 1
        else:
            out.append(clear)
            out = []
            codes.append(out)
            table, free = {}, clear + 2
    if at >= 0:
        out.append(at)
    out.append(clear + 1)
    codes[0].insert(0, clear)
    values, widths = [], []
    for k, part in enumerate(codes):
        lead = k == 0  # the first clear code stands before any table
        values.append(np.asarray(part, np.int64))
        w = _widths(clear + 2, TABLE)[: len(part) - lead]
        widths.append(np.concatenate([[bits + 1], w]) if lead else w)
    value, width = np.concatenate(values), np.concatenate(widths)
    ends = np.cumsum(width)
    starts = ends - width
    # A code of up to 12 bits touches at most three bytes.
    wide = value << (starts & 7)
    size = int(ends[-1] + 7 >> 3) + 3
    stream = sum(np.bincount((starts >> 3) + k, (wide >> 8 * k) & 255, size) for k in range(3))
    return stream.astype(np.uint8)[:-3].tobytes()


def lzw_decode(stream: bytes, bits: int, most: int) -> tuple[bytes, bool]:
    """At most ``most`` samples of a code stream, and whether it was whole."""
    clear, free = 1 << bits, (1 << bits) + 2
    data = np.concatenate([np.frombuffer(stream, np.uint8), np.zeros(4, np.uint8)]).astype(np.uint32)
    at, span, out = 0, len(stream) * 8, bytearray()
    first_widths = _widths(free, TABLE - free + 2 + 1)
    while len(out) < most:
        # All codes that one table can hold; a full table goes on with 12 bits until it is cleared.
        n = len(first_widths) if at + 9 * len(first_widths) <= span + 9 * TABLE else TABLE
        widths = first_widths[: min(n, (span - at) // (bits + 1) + 1)]  # no code is shorter
        ends = np.cumsum(widths) + at
        here = ends - widths
        use = int(np.searchsorted(ends, span, "right"))
        here, widths = here[:use], widths[:use]
        byte = here >> 3
        codes = ((data[byte] | data[byte + 1] << 8 | data[byte + 2] << 16) >> (here & 7).astype(np.uint32)) & ((1 << widths) - 1).astype(np.uint32)
        stops = np.flatnonzero((codes == clear) | (codes == clear + 1))
        stop = int(stops[0]) if len(stops) else len(codes)
        full = stop == len(codes) == len(first_widths)
        list_of = codes[:stop].tolist()
        if full:
            more, here_end = [], int(ends[use - 1])
            while here_end + 12 <= span:
                b = here_end >> 3
                code = int((data[b] | data[b + 1] << 8 | data[b + 2] << 16) >> (here_end & 7)) & 4095
                here_end += 12
                if code in (clear, clear + 1):
                    break
                more.append(code)
            else:
                code = -1
            list_of += more
            ended, at = code, here_end
        else:
            ended = int(codes[stop]) if stop < len(codes) else -1
            at = int(here[stop] + widths[stop]) if stop < len(codes) else span
        if not _unroll(list_of, clear, out, most):
            return bytes(out[:most]), False
        if ended == clear + 1:
            return bytes(out[:most]), len(out) >= most
        if ended == -1:
            return bytes(out[:most]), False
    return bytes(out[:most]), True


def _unroll(codes: list[int], clear: int, out: bytearray, most: int) -> bool:
    """Write what the codes of one table stand for; false where a code has no entry yet."""
    free = clear + 2
    places: list[int] = []
    sizes: list[int] = []
    place, n = len(out), 0
    for code in codes:
        places.append(place)
        if code < clear:
            out.append(code)
            place += 1
            sizes.append(2)
        else:
            k = code - free
            if k >= n or k < 0:
                return False
            size = sizes[k]
            start = places[k]
            if start + size <= place:
                out += out[start : start + size]
            else:  # the entry that this very code completes: its last sample is its first
                out += out[start:place]
                out.append(out[start])
            place += size
            sizes.append(size + 1)
        n += 1
        if place >= most:
            return True
    return True


@dataclass
class Frame:
    samples: np.ndarray  # rows x columns of palette places
    palette: np.ndarray  # n x 3
    left: int
    top: int
    delay_ms: int
    disposal: int
    transparent: int | None


def write(frames: list[Frame], palette: np.ndarray) -> bytes:
    """A GIF of 8-bit frames; a palette other than the shared one (256 colours) is written with its frame."""
    width = max(f.left + f.samples.shape[1] for f in frames)
    height = max(f.top + f.samples.shape[0] for f in frames)
    out = [b"GIF89a", struct.pack("<HHBBB", width, height, 0xF7, 0, 0), palette.astype(np.uint8).tobytes()]
    for f in frames:
        seen = f.transparent is not None
        out.append(b"\x21\xf9\x04" + struct.pack("<BHBB", f.disposal << 2 | seen, f.delay_ms // 10, f.transparent if seen else 0, 0))
        local = f.palette is not palette
        out.append(b"\x2c" + struct.pack("<HHHHB", f.left, f.top, f.samples.shape[1], f.samples.shape[0], 0x87 if local else 0))
        if local:
            out.append(f.palette.astype(np.uint8).tobytes())
        stream = lzw_encode(f.samples.tobytes())
        out += [b"\x08", *(bytes([len(part)]) + part for part in (stream[i : i + 255] for i in range(0, len(stream), 255))), b"\0"]
    return b"".join([*out, b"\x3b"])


def read(content: bytes) -> tuple[tuple[int, int], list[Frame], bool]:
    """((width, height), frames, complete) of a GIF."""
    if content[:6] not in (b"GIF87a", b"GIF89a") or len(content) < 13:
        return (0, 0), [], False
    width, height, flags = struct.unpack_from("<HHB", content, 6)
    if width * height > MOST_PIXELS:
        return (width, height), [], False
    at, shared = 13, np.zeros((0, 3), np.uint8)

    def palette(flags: int) -> np.ndarray:
        nonlocal at
        size = 3 << (flags & 7) + 1
        part = content[at : at + size].ljust(size, b"\0")
        at += size
        return np.frombuffer(part, np.uint8).reshape(-1, 3)

    def blocks() -> tuple[bytes, bool]:
        nonlocal at
        parts = []
        while at < len(content) and (n := content[at]):
            parts.append(content[at + 1 : at + 1 + n])
            at += 1 + n
        at += 1
        return b"".join(parts), at <= len(content)

    if flags & 128:
        shared = palette(flags)
    frames: list[Frame] = []
    delay = disposal = 0
    transparent = None
    while at < len(content):
        kind = content[at]
        at += 1
        if kind == 0x3B:
            return (width, height), frames, True
        if kind == 0x21 and at < len(content):
            label = content[at]
            at += 1
            body, whole = blocks()
            if label == 0xF9 and len(body) >= 4:
                disposal, delay = body[0] >> 2 & 7, int.from_bytes(body[1:3], "little") * 10
                transparent = body[3] if body[0] & 1 else None
        elif kind == 0x2C and at + 9 < len(content):
            left, top, columns, rows, own = struct.unpack_from("<HHHHB", content, at)
            at += 9
            colours = palette(own) if own & 128 else shared
            if at >= len(content):
                break
            bits = content[at]
            at += 1
            stream, whole = blocks()
            if not 2 <= bits <= 8 or rows * columns > MOST_PIXELS:
                return (width, height), frames, False
            data, all_there = lzw_decode(stream, bits, rows * columns)
            grid = np.frombuffer(data.ljust(rows * columns, b"\0"), np.uint8).reshape(rows, columns)
            if own & 64:  # interlaced: every 8th row, those between, and so on
                order = np.concatenate([np.arange(first, rows, step) for first, step in ((0, 8), (4, 8), (2, 4), (1, 2))])
                straight = np.empty_like(grid)
                straight[order] = grid
                grid = straight
            frames.append(Frame(grid, colours, left, top, delay, disposal, transparent))
            delay, disposal, transparent = 0, 0, None
            if not (whole and all_there):
                return (width, height), frames, False
        else:
            break
    return (width, height), frames, False


def shown(size: tuple[int, int], frames: list[Frame]) -> Iterator[np.ndarray]:
    """The canvas (rows x columns x RGBA) as each frame shows it."""
    canvas = np.zeros((size[1], size[0], 4), np.uint8)
    for frame in frames:
        rows, columns = max(0, min(frame.samples.shape[0], size[1] - frame.top)), max(0, min(frame.samples.shape[1], size[0] - frame.left))
        area = (slice(frame.top, frame.top + rows), slice(frame.left, frame.left + columns))
        kept = canvas[area].copy() if frame.disposal == 3 else None
        colours = np.zeros((256, 4), np.uint8)
        colours[: len(frame.palette), :3] = frame.palette[:256]
        colours[:, 3] = 255
        part = frame.samples[:rows, :columns]
        drawn = colours[part]
        if frame.transparent is not None:
            drawn = np.where((part == frame.transparent)[..., None], canvas[area], drawn)
        canvas[area] = drawn
        yield canvas
        if frame.disposal == 2:
            canvas[area] = 0
        elif kept is not None:
            canvas[area] = kept


def histogram(canvas: np.ndarray) -> np.ndarray:
    """Visible pixels by channel and brightness: 3 x BINS counts."""
    flat = canvas.reshape(-1, 4)
    flat = flat[flat[:, 3] > 0] if not flat[:, 3].all() else flat
    return np.stack([np.bincount(flat[:, c] >> 5, minlength=BINS) for c in range(3)])


FRAMES = "frame int, at_ms long, delay_ms int, width int, height int, disposal int, transparent int, complete boolean, rgba binary, red array<long>, green array<long>, blue array<long>"


def decode_frames(media: DataFrame, key: str, content: str = "content") -> DataFrame:
    """One row for each frame of each GIF: its time, its canvas after composition, its histograms."""
    source = media.select(media[key].alias("key"), media[content].cast("binary").alias("content"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i, data in enumerate(texts_of(batch.column("content"))):
                size, frames, complete = read(data)
                clock = 0
                for k, (frame, canvas) in enumerate(zip(frames, shown(size, frames), strict=True)):
                    bins = histogram(canvas).tolist()
                    row = [k, clock, frame.delay_ms, *size, frame.disposal, frame.transparent, complete, canvas.tobytes(), *bins]
                    clock += frame.delay_ms
                    columns = [batch.column("key").slice(i, 1), *(pa.array([v], t) for v, t in zip(row, ARROW, strict=True))]
                    yield pa.RecordBatch.from_arrays(columns, names=[key, *(f.split()[0] for f in FRAMES.split(", "))])

    return source.mapInArrow(run, f"`{key}` {source.schema['key'].dataType.simpleString()}, {FRAMES}")


ARROW = [pa.int32(), pa.int64(), pa.int32(), pa.int32(), pa.int32(), pa.int32(), pa.int32(), pa.bool_(), pa.binary(), *(pa.list_(pa.int64()),) * 3]
#: Place i is a grey of brightness i in the shared palette and of brightness 255 - i in the local one.
GREYS = np.repeat(np.arange(256, dtype=np.uint8)[:, None], 3, 1)
NEGATIVE = GREYS[::-1].copy()


def store(payload: bytes) -> bytes:
    """A GIF whose samples are the payload (a positive multiple of 64 bytes), 100 to 300 ms a frame."""
    grid = np.frombuffer(payload, np.uint8).reshape(-1, WIDTH)
    frames: list[Frame] = []
    at, rows = 0, FIRST_ROWS
    while at < len(grid):
        k = len(frames)
        frames.append(Frame(grid[at : at + rows], NEGATIVE if k % 2 else GREYS, 0, 0, 100 + k % 3 * 100, k % 3 + 1, 0 if k else None))
        at += rows
        rows = min(2 * rows, MOST_ROWS)
    return write(frames, GREYS)


def stored_texts(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """Store each text in a GIF, read it back, and describe both.

    (doc_id, n_bytes, payload_bytes, payload_sha256, tail_crc32, media_bytes, media_sha256, feature):
    the payload is the text's UTF-8 and zeros up to a positive multiple of 64 bytes; the feature has
    the number of frames, their time and size, and the brightness histogram of all canvases shown.
    """
    source = docs.select(docs[doc_id].alias("doc_id"), docs[text].cast("string").alias("text"))
    kind = source.schema["doc_id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for data in texts_of(batch.column("text")):
                media = store(data.ljust(max(WIDTH, -(-len(data) // WIDTH) * WIDTH), b"\0"))
                size, frames, _ = read(media)
                back = b"".join(f.samples.tobytes() for f in frames)
                grey = sum(histogram(canvas)[0] for canvas in shown(size, frames))
                feature = f"frames={len(frames)};ms={sum(f.delay_ms for f in frames)};size={size[0]}x{size[1]};grey={','.join(map(str, grey.tolist()))}"
                rows.append((len(data), len(back), hashlib.sha256(back).hexdigest(), zlib.crc32(back[-WIDTH:]), len(media), hashlib.sha256(media).hexdigest(), feature))
            if rows:
                kinds = (pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.string(), pa.string())
                names = ["n_bytes", "payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "media_sha256", "feature"]
                yield pa.RecordBatch.from_arrays([batch.column("doc_id"), *(pa.array(c, k) for c, k in zip(zip(*rows, strict=True), kinds, strict=True))], names=["doc_id", *names])

    return source.mapInArrow(run, f"doc_id {kind}, n_bytes long, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string")
