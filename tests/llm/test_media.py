"""GIF media against a decoder of its own, bit by bit, and against pictures composed by hand."""

import hashlib
import zlib

import numpy as np
import pytest

from treeflow.llm import gif

PALETTE = bytes([0, 0, 0, 255, 0, 0, 0, 255, 0, 0, 0, 255])
R, G, B = (255, 0, 0), (0, 255, 0), (0, 0, 255)


def serial_decode(data: bytes, size: int = 8) -> bytes:
    """Reads one code after another, widening as the standard says."""
    bits = int.from_bytes(data, "little")
    clear = 1 << size
    out, table, width, prev, at = bytearray(), None, size + 1, None, 0
    while True:
        code = bits >> at & ((1 << width) - 1)
        at += width
        if code == clear:
            table, width, prev = [bytes([i]) for i in range(clear)] + [b"", b""], size + 1, None
        elif code == clear + 1:
            return bytes(out)
        else:
            word = table[code] if code < len(table) else prev + prev[:1]
            if prev is not None and len(table) < 4096:
                table.append(prev + word[:1])
                if len(table) == 1 << width and width < 12:
                    width += 1
            out += word
            prev = word


def image(x, y, w, h, samples, disposal, delay, transparent=None, flags=0, palette=b""):
    control = b"\x21\xf9\x04" + bytes([(disposal << 2) | (transparent is not None), delay, 0, transparent or 0, 0])
    return control + b"\x2c" + b"".join(v.to_bytes(2, "little") for v in (x, y, w, h)) + bytes([flags]) + palette + b"\x08" + gif._blocks(gif.lzw_compress(bytes(samples)))


def screen(w, h, palette=PALETTE):
    return b"GIF89a" + w.to_bytes(2, "little") + h.to_bytes(2, "little") + bytes([0x81 if palette else 0, 0, 0]) + palette


def shown(frame):
    return [tuple(p[:3]) if p[3] else None for row in frame.rgba.tolist() for p in row]


def test_payloads(docs_of, corpus):
    rows = corpus[:30] + corpus[-10:]
    for r in gif.digest(gif.store(docs_of(rows))).collect():
        if r["doc_id"] in (None, 5003):
            continue
        raw = (dict((i, t) for i, t, _ in rows)[r["doc_id"]] or "").encode()
        padded = raw.ljust(max(64, -(-len(raw) // 64) * 64), b"\0")
        assert (r["n_bytes"], r["payload_bytes"], r["payload_sha256"], r["tail_crc32"]) == (len(raw), len(padded), hashlib.sha256(padded).hexdigest(), zlib.crc32(padded[-64:]))
        media = gif.encode(padded)
        assert (r["media_bytes"], r["media_sha256"]) == (len(media), hashlib.sha256(media).hexdigest())
        bins = np.bincount(np.frombuffer(padded, np.uint8) >> 5, minlength=8)
        assert r["feature"] == f"64x{len(padded) // 64};frames=1;cs=10;" + ";".join(f"{c}={','.join(map(str, bins))}" for c in "rgb")
    assert gif.digest(gif.store(docs_of([]))).collect() == []


def test_long_payloads_take_several_timed_frames():
    payload = np.random.default_rng(8).integers(0, 256, 64 * (2 * gif.FRAME_ROWS + 3), dtype=np.uint8).tobytes()
    media = gif.encode(payload)
    f = list(gif.frames(media))
    assert [(x.start, x.delay, x.box[3]) for x in f] == [(0, 10, 4096), (10, 10, 4096), (20, 10, 3)]
    assert gif.described(media)[0] == payload
    # the last frame draws three rows over the second one
    assert f[2].rgba[3:, :, 0].tobytes() == f[1].rgba[3:, :, 0].tobytes() and f[2].rgba[:3, :, 0].tobytes() == payload[-192:]


def test_palettes_transparency_and_disposal(spark):
    media = screen(2, 2) + image(0, 0, 2, 2, [1, 1, 1, 1], 1, 5) + image(0, 0, 2, 1, [2, 0], 2, 7, 0) + image(1, 1, 1, 1, [3], 3, 9) + image(0, 1, 1, 1, [2], 1, 1) + b"\x3b"
    f = list(gif.frames(media))
    assert [shown(x) for x in f] == [[R, R, R, R], [G, R, R, R], [None, None, R, B], [None, None, G, R]]
    assert [(x.start, x.delay) for x in f] == [(0, 5), (5, 7), (12, 9), (21, 1)]
    table = gif.frame_table(spark.createDataFrame([(1, bytearray(media)), (2, None), (None, bytearray(b"not a picture")), (4, bytearray(b""))], "doc_id long, media binary")).collect()
    assert len(table) == 4 and {r["doc_id"] for r in table} == {1} and sum(table[0]["hist_red"]) == 4
    assert sorted((r["frame"], r["start_cs"], r["delay_cs"]) for r in table) == [(0, 0, 5), (1, 5, 7), (2, 12, 9), (3, 21, 1)]


def test_local_palettes_interlace_and_none():
    own = image(0, 0, 1, 1, [1], 1, 0, flags=0x80, palette=bytes([9, 9, 9, 7, 8, 9]))
    assert shown(next(gif.frames(screen(1, 1) + own + b"\x3b"))) == [(7, 8, 9)]
    # rows come as 0, 8, 4, 2, 6, then the odd ones
    woven = image(0, 0, 1, 9, [0, 8, 4, 2, 6, 1, 3, 5, 7], 1, 0, flags=0x40)
    assert [p[0] for p in shown(next(gif.frames(screen(1, 9, b"") + woven + b"\x3b")))] == list(range(9))
    # an image that reaches over the screen's edge is cut
    wide = image(1, 1, 2, 2, [1, 2, 3, 3], 1, 0)
    assert shown(next(gif.frames(screen(2, 2) + wide + b"\x3b"))) == [None, None, None, R]


def test_damaged_files_end_early():
    whole = gif.encode(bytes(range(256)) * 40)
    for k in range(0, len(whole), 13):
        f = list(gif.frames(whole[:k]))
        assert len(f) <= 1 and all(x.rgba.shape == (160, 64, 4) for x in f)
    assert gif.described(b"") == (b"", "0x0;frames=0;cs=0;r=0,0,0,0,0,0,0,0;g=0,0,0,0,0,0,0,0;b=0,0,0,0,0,0,0,0")
    noise = np.random.default_rng(4)
    for _ in range(40):
        spoilt = bytearray(whole)
        spoilt[int(noise.integers(13, len(whole)))] = int(noise.integers(0, 256))
        list(gif.frames(bytes(spoilt)))


@pytest.mark.parametrize("top", [1, 2, 40, 256])
def test_lzw_streams(top):
    rng = np.random.default_rng(1)
    for n in (1, 2, 254, 255, 256, 257, 511, 767, 768, 3838, 3839, 3840, 3841, 5000, 60000):
        s = rng.integers(0, top, n, dtype=np.uint8)
        stream = gif.lzw_compress(s.tobytes())
        assert serial_decode(stream) == s.tobytes()
        assert (gif.lzw_decode(stream, 8, n) == s).all()
    assert gif.lzw_decode(b"", 8, 3).tolist() == [0, 0, 0]


def test_small_alphabets_and_full_tables():
    """A stream of two-bit samples that never clears its table once it is full."""
    rng = np.random.default_rng(6)
    s = rng.integers(0, 4, 30000, dtype=np.uint8).tolist()
    bits, at, width, table, last = 0, 0, 3, {(i,): i for i in range(4)}, ()
    codes = [4]
    for x in s:
        if (*last, x) in table:
            last = (*last, x)
            continue
        codes.append(table[last])
        if len(table) + 2 < 4096:
            table[(*last, x)] = len(table) + 2
        last = (x,)
    codes += [table[last], 5]
    size = 6
    for i, c in enumerate(codes):
        bits |= c << at
        at += width
        if i >= 2 and size < 4096:
            size += 1
            if size == 1 << width and width < 12:
                width += 1
    data = bits.to_bytes(-(-at // 8), "little")
    assert serial_decode(data, 2) == bytes(s)
    assert gif.lzw_decode(data, 2, len(s)).tolist() == s
