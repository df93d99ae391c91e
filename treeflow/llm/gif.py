"""GIF media: payloads stored as 8-bit samples, and a decoder for frames, palettes, disposal and transparency."""

from __future__ import annotations

import hashlib
import struct
import zlib
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from .common import as_bytes, batch, columns, slices

#: Samples in a row, and rows in a frame at most: longer payloads take several frames.
WIDTH, FRAME_ROWS, DELAY = 64, 4096, 10
_GREY = bytes(v for i in range(256) for v in (i, i, i))
CLEAR, END = 256, 257


@dataclass
class Frame:
    """One composed picture: RGBA samples, how long and from when on it shows, in hundredths of a second, and the
    box (x, y, width, height) that its image drew."""

    rgba: np.ndarray
    delay: int
    start: int
    box: tuple[int, int, int, int]


# --- LZW -------------------------------------------------------------------------------------------------------


def _widths(clear: int, count: int) -> np.ndarray:
    """Bits of each of the first ``count`` codes after a clear code: one more whenever the table outgrows the width."""
    out = np.full(count, 12, np.int64)
    done = 0
    for width in range(clear.bit_length(), 12):
        stop = (1 << width) - clear - 1
        out[done:stop] = width
        done = stop
    return out


#: Codes unpacked at once; a table is full after fewer.
_RUN = 4096
_SCHEDULES = {size: _widths(1 << size, _RUN) for size in range(2, 9)}


def _packed(codes: np.ndarray, widths: np.ndarray) -> bytes:
    """Codes of varying widths, least significant bit first."""
    bit = np.arange(12)
    held = bit < widths[:, None]
    return np.packbits(((codes[:, None] >> bit) & 1).astype(np.uint8)[held], bitorder="little").tobytes()


def lzw_compress(samples: bytes) -> bytes:
    """An 8-bit LZW stream with a growing table, cleared when it is full."""
    runs, codes, table, following, last = [], [CLEAR], {}, CLEAR + 2, -1
    for s in samples:
        if last < 0:
            last = s
            continue
        key = last << 8 | s
        code = table.get(key)
        if code is not None:
            last = code
            continue
        codes.append(last)
        if following < 4096:
            table[key] = following
            following += 1
        else:
            codes.append(CLEAR)
            runs.append(codes)
            codes, table, following = [], {}, CLEAR + 2
        last = s
    if last >= 0:
        codes.append(last)
    runs.append([*codes, END])
    # the first run opens with a clear code of its own, nine bits wide like any first code
    widths = [_SCHEDULES[8][: len(x)] for x in runs]
    widths[0] = np.concatenate([[9], _SCHEDULES[8][: len(runs[0]) - 1]])
    return _packed(np.array([c for x in runs for c in x], np.int64), np.concatenate(widths))


def lzw_decode(data: bytes, min_size: int, wanted: int) -> np.ndarray:
    """Samples of any GIF LZW stream; short or damaged streams give zeros for what is missing."""
    if not 2 <= min_size <= 8:
        return np.zeros(wanted, np.uint8)
    clear, end = 1 << min_size, (1 << min_size) + 1
    schedule = _SCHEDULES[min_size]
    base = [bytes([i]) for i in range(clear)] + [b"", b""]
    padded = np.zeros(len(data) + 8, np.uint8)
    padded[: len(data)] = np.frombuffer(data, np.uint8)
    words4 = np.ndarray((len(data) + 1,), "<u4", padded.data, strides=(1,))  # the four bytes from each place on
    table, size, prev, seen = list(base), clear + 2, None, 0
    out, have, at, total = [], 0, 0, 8 * len(data)
    while have < wanted:
        widths = schedule[seen : seen + _RUN] if seen < _RUN else np.full(_RUN, 12)
        stops = at + np.cumsum(widths)
        widths = widths[stops <= total]
        if not len(widths):
            break
        stops = stops[: len(widths)]
        starts = stops - widths
        codes = (words4[starts >> 3] >> (starts & 7).astype(np.uint32)) & ((1 << widths) - 1)
        marks = np.flatnonzero((codes == clear) | (codes == end))
        mark = int(marks[0]) if len(marks) else -1
        for code in (codes[:mark] if len(marks) else codes).tolist():
            if code < size:
                word = table[code]
            elif code == size and prev is not None and size < 4096:
                word = prev + prev[:1]
            else:
                mark, total = 0, 0  # damaged: nothing after this can be read
                break
            out.append(word)
            have += len(word)
            if prev is not None and size < 4096:
                table.append(prev + word[:1])
                size += 1
            prev = word
        if mark < 0:
            at, seen = int(stops[-1]), seen + len(widths)
        elif total and codes[mark] == clear:
            at, seen = int(stops[mark]), 0
            table, size, prev = list(base), clear + 2, None
        else:
            break
    joined = np.frombuffer(b"".join(out)[:wanted], np.uint8)
    return np.concatenate([joined, np.zeros(wanted - len(joined), np.uint8)]) if len(joined) < wanted else joined


# --- the container ---------------------------------------------------------------------------------------------


def _blocks(data: bytes) -> bytes:
    view = np.frombuffer(data, np.uint8)
    whole = len(view) // 255
    full = np.empty((whole, 256), np.uint8)
    full[:, 0] = 255
    full[:, 1:] = view[: whole * 255].reshape(whole, 255)
    rest = data[whole * 255 :]
    return full.tobytes() + (bytes([len(rest)]) + rest if rest else b"") + b"\0"


def _unblock(media: bytes, pos: int) -> tuple[bytes, int]:
    parts = []
    while pos < len(media) and (n := media[pos]):
        parts.append(media[pos + 1 : pos + 1 + n])
        pos += 1 + n
    return b"".join(parts), pos + 1


def encode(payload: bytes, *, delay: int = DELAY) -> bytes:
    """A GIF whose samples, in order, are the payload's bytes, under a grey palette; the length is a multiple of 64."""
    if not payload or len(payload) % WIDTH:
        raise ValueError(f"the payload's length must be a positive multiple of {WIDTH}")
    rows = len(payload) // WIDTH
    out = [b"GIF89a", struct.pack("<HHBBB", WIDTH, min(rows, FRAME_ROWS), 0xF7, 0, 0), _GREY]
    for at in range(0, rows, FRAME_ROWS):
        part = payload[at * WIDTH : (at + FRAME_ROWS) * WIDTH]
        out.append(b"\x21\xf9\x04" + struct.pack("<BHB", 1 << 2, delay, 0) + b"\0")
        out.append(b"\x2c" + struct.pack("<HHHHB", 0, 0, WIDTH, len(part) // WIDTH, 0) + b"\x08")
        out.append(_blocks(lzw_compress(part)))
    return b"".join([*out, b"\x3b"])


@dataclass
class Image:
    """One image of a file as stored: where it goes, its samples, and its graphic control."""

    screen: tuple[int, int]
    at: tuple[int, int]
    samples: np.ndarray
    palette: np.ndarray
    transparent: int | None
    disposal: int
    delay: int


_GREYS = np.frombuffer(_GREY, np.uint8).reshape(-1, 3)


def _palette(media: bytes, flags: int, pos: int) -> tuple[np.ndarray, int]:
    size = 3 << ((flags & 7) + 1)
    return np.frombuffer(media[pos : pos + size].ljust(size, b"\0"), np.uint8).reshape(-1, 3), pos + size


def images(media: bytes):
    """Each image of the file. What is not a GIF has none; a file cut short ends with its last whole image header.

    An image without a palette of its own takes the file's; without that, samples are shades of grey.
    """
    if media[:3] != b"GIF" or len(media) < 13:
        return
    width, height, flags = struct.unpack("<HHB", media[6:11])
    pos, common = 13, _GREYS
    if flags & 0x80:
        common, pos = _palette(media, flags, pos)
    disposal = delay = 0
    transparent = None
    while pos < len(media) and media[pos] != 0x3B:
        kind = media[pos]
        if kind == 0x21:
            if media[pos + 1 : pos + 2] == b"\xf9" and len(media) >= pos + 7:
                f, delay, index = struct.unpack("<BHB", media[pos + 3 : pos + 7])
                disposal, transparent = (f >> 2) & 7, index if f & 1 else None
            _, pos = _unblock(media, pos + 2)
        elif kind == 0x2C and len(media) > pos + 10:
            x, y, w, h, f = struct.unpack("<HHHHB", media[pos + 1 : pos + 10])
            pos, palette = pos + 10, common
            if f & 0x80:
                palette, pos = _palette(media, f, pos)
            data, after = _unblock(media, pos + 1)
            samples = lzw_decode(data, media[pos] if pos < len(media) else 0, w * h).reshape(h, w)
            if f & 0x40:
                order = np.concatenate([np.arange(s, h, t) for s, t in ((0, 8), (4, 8), (2, 4), (1, 2))])
                straight = np.empty_like(samples)
                straight[order] = samples
                samples = straight
            yield Image((width, height), (x, y), samples, palette, transparent, disposal, delay)
            pos, disposal, delay, transparent = after, 0, 0, None
        else:
            break


def frames(media: bytes):
    """The composed frames, one by one: palettes applied, transparent samples left as they were, disposal rules obeyed."""
    canvas, clock = None, 0
    for m in images(media):
        width, height = m.screen
        x, y = m.at
        if canvas is None:
            canvas = np.zeros((height, width, 4), np.uint8)
        before = canvas.copy() if m.disposal == 3 else None
        h, w = max(0, min(m.samples.shape[0], height - y)), max(0, min(m.samples.shape[1], width - x))
        part = m.samples[:h, :w]
        colours = np.zeros((256, 4), np.uint8)
        colours[: len(m.palette), :3] = m.palette
        colours[:, 3] = 255
        area = canvas[y : y + h, x : x + w]
        if m.transparent is None:
            area[:] = colours[part]
        else:
            shown = part != m.transparent
            area[shown] = colours[part][shown]
        yield Frame(canvas.copy(), m.delay, clock, (x, y, w, h))
        clock += m.delay
        if m.disposal == 2:
            area[:] = 0
        elif m.disposal == 3:
            canvas = before


def histogram(values: np.ndarray, bins: int = 8) -> list[int]:
    return np.bincount(values.reshape(-1) >> (8 - bins.bit_length() + 1), minlength=bins).tolist()


# --- columns ---------------------------------------------------------------------------------------------------

_FRAMES = pa.schema([("doc_id", pa.int64()), ("frame", pa.int32()), ("start_cs", pa.int64()), ("delay_cs", pa.int32()), ("width", pa.int32()), ("height", pa.int32()), ("rgba", pa.binary()), *[(f"hist_{c}", pa.list_(pa.int64())) for c in ("red", "green", "blue")]])
_STORED = pa.schema([("doc_id", pa.int64()), ("n_bytes", pa.int64()), ("media", pa.binary())])
_DIGEST = pa.schema([("doc_id", pa.int64()), ("n_bytes", pa.int64()), ("payload_bytes", pa.int64()), ("payload_sha256", pa.string()), ("tail_crc32", pa.int64()), ("media_bytes", pa.int64()), ("media_sha256", pa.string()), ("feature", pa.string())])


def _ddl(schema: pa.Schema) -> str:
    kinds = {pa.int64(): "long", pa.int32(): "int", pa.string(): "string", pa.binary(): "binary", pa.list_(pa.int64()): "array<long>"}
    return ", ".join(f"{f.name} {kinds[f.type]}" for f in schema)


def store(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Each text's UTF-8 bytes, with zeros up to a positive multiple of 64, as a GIF: doc_id, n_bytes, media.

    A null text counts as empty; null ids and equal rows stay as they are; an empty table gives an empty one.
    """

    def run(batches):
        for b in batches:
            texts = [x or b"" for x in as_bytes(b.column(1))]
            for i, j in slices(len(texts), [len(x) for x in texts], 4_000_000):
                part = texts[i:j]
                media = [encode(x.ljust(max(WIDTH, -(-len(x) // WIDTH) * WIDTH), b"\0")) for x in part]
                yield batch(_STORED, b.column(0).slice(i, len(part)), [len(x) for x in part], media)

    return columns(docs, doc_id=id_col, text=text_col).mapInArrow(run, _ddl(_STORED))


def frame_table(stored: DataFrame, *, id_col: str = "doc_id", media_col: str = "media") -> DataFrame:
    """One row for each composed frame of each GIF: its time, RGBA samples and colour histograms of eight bins.

    A medium that is null, empty or not a GIF has no frames; of a damaged one, what is missing is the first colour, and
    a file cut short keeps the frames before the cut. Null ids and equal rows stay as they are.
    """

    def run(batches):
        for b in batches:
            for key, media in zip(b.column(0), b.column(1), strict=True):
                for i, f in enumerate(frames(media.as_py()) if media.is_valid else []):
                    h, w = f.rgba.shape[:2]
                    yield batch(_FRAMES, [key.as_py()], [i], [f.start], [f.delay], [w], [h], [f.rgba.tobytes()], *[[histogram(f.rgba[:, :, c])] for c in range(3)])

    return columns(stored, doc_id=id_col, media=media_col).mapInArrow(run, _ddl(_FRAMES))


def described(media: bytes) -> tuple[bytes, str]:
    """The payload that a stored GIF shows, and its feature: both read from the composed frames.

    The payload is what each frame's image drew, in its red samples. The feature names the screen, the number of
    frames, the time they take, and the histograms of eight bins of each colour, summed over the frames.
    """
    parts, bins, count, clock, size = [], np.zeros((3, 8), np.int64), 0, 0, (0, 0)
    for f in frames(media):
        x, y, w, h = f.box
        parts.append(f.rgba[y : y + h, x : x + w, 0].tobytes())
        bins += [histogram(f.rgba[:, :, c]) for c in range(3)]
        count, clock, size = count + 1, f.start + f.delay, f.rgba.shape[1::-1]
    said = ";".join(f"{c}={','.join(map(str, x))}" for c, x in zip("rgb", bins.tolist(), strict=True))
    return b"".join(parts), f"{size[0]}x{size[1]};frames={count};cs={clock};{said}"


def digest(stored: DataFrame) -> DataFrame:
    """Decode what ``store`` made, compose its frames, and describe payload and medium.

    Equal payloads have equal values. A null medium, or one without frames, has an empty payload; null ids and equal
    rows stay as they are; an empty table gives an empty one.
    """

    def run(batches):
        sha = lambda x: hashlib.sha256(x).hexdigest()
        for b in batches:
            rows = []
            for media in b.column(2).to_pylist():
                media = media or b""
                payload, feature = described(media)
                rows.append((len(payload), sha(payload), zlib.crc32(payload[-WIDTH:]), len(media), sha(media), feature))
            yield batch(_DIGEST, b.column(0), b.column(1), *[list(x) for x in zip(*rows, strict=True)] if rows else [[]] * 6)

    return stored.select("doc_id", "n_bytes", "media").mapInArrow(run, _ddl(_DIGEST))
