"""A small TIFF codec: classic and BigTIFF GeoTIFF, read by ranges of bytes, written in strips.

Reads both byte orders, strips and tiles, chunky and planar samples, no compression, deflate, LZW and PackBits, horizontal
prediction, and unsigned, signed and float samples of 8 to 64 bits. A file is a function that gives ``size`` bytes from
``at``, or bytes; only the header and the wanted strips or tiles are asked for. Writes deflated or plain strips with
georeference, as BigTIFF beyond 4 GB.
"""

from __future__ import annotations

import struct
import zlib
from collections.abc import Callable
from dataclasses import dataclass
from itertools import accumulate

import numpy as np

#: Tags and their field types (fixed values of the format).
WIDTH, HEIGHT, BITS, COMPRESSION, PHOTOMETRIC, STRIP_OFFSETS, SAMPLES, ROWS_PER_STRIP, STRIP_BYTES, PLANAR = 256, 257, 258, 259, 262, 273, 277, 278, 279, 284
PREDICTOR, TILE_WIDTH, TILE_HEIGHT, TILE_OFFSETS, TILE_BYTES, SAMPLE_FORMAT = 317, 322, 323, 324, 325, 339
PIXEL_SCALE, TIE_POINT, TRANSFORM, GEO_KEYS = 33550, 33922, 34264, 34735
TYPES = {1: "B", 2: "s", 3: "H", 4: "I", 5: "II", 6: "b", 8: "h", 9: "i", 11: "f", 12: "d", 13: "I", 16: "Q", 17: "q", 18: "Q"}
PLAIN, LZW, DEFLATES, PACKBITS = 1, 5, (8, 32946), 32773
#: Offsets of classic files end here.
CLASSIC = 1 << 32
Fetch = Callable[[int, int], bytes]


@dataclass(frozen=True)
class Header:
    order: str
    tags: dict[int, tuple]

    def one(self, tag: int, default=None):
        return self.tags[tag][0] if tag in self.tags else default

    @property
    def height(self) -> int:
        return self.one(HEIGHT)

    @property
    def width(self) -> int:
        return self.one(WIDTH)

    @property
    def bands(self) -> int:
        return self.one(SAMPLES, 1)

    @property
    def dtype(self) -> np.dtype:
        kind = {1: "u", 2: "i", 3: "f"}[self.one(SAMPLE_FORMAT, 1)]
        bits = self.one(BITS, 1)
        if bits % 8:
            raise ValueError(f"samples of {bits} bits are not supported")
        return np.dtype(f"{self.order}{kind}{bits // 8}")

    @property
    def block(self) -> tuple[int, int]:
        """Height and width of a strip or tile."""
        if TILE_OFFSETS in self.tags:
            return self.one(TILE_HEIGHT), self.one(TILE_WIDTH)
        return min(self.one(ROWS_PER_STRIP, self.height), self.height), self.width

    @property
    def transform(self) -> tuple[float, ...] | None:
        if TRANSFORM in self.tags:
            m = self.tags[TRANSFORM]
            return (m[3], m[0], m[1], m[7], m[4], m[5])
        if PIXEL_SCALE in self.tags and TIE_POINT in self.tags:
            sx, sy = self.tags[PIXEL_SCALE][:2]
            i, j, _, x, y, _ = self.tags[TIE_POINT][:6]
            return (x - i * sx, sx, 0.0, y + j * sy, 0.0, -sy)
        return None

    @property
    def epsg(self) -> int | None:
        keys = self.tags.get(GEO_KEYS, ())
        found = {keys[k]: keys[k + 3] for k in range(4, len(keys) - 3, 4) if keys[k + 1] == 0}
        return found.get(3072) or found.get(2048)  # a projected or else a geographic system


def fetcher(source: bytes | Fetch) -> Fetch:
    return source if callable(source) else lambda at, size: bytes(source[at : at + size])


def read_header(source: bytes | Fetch) -> Header:
    """The first image's header: the file's first bytes, its directory, and the values that lie elsewhere."""
    fetch = fetcher(source)
    head = fetch(0, 16)
    order = {b"II": "<", b"MM": ">"}.get(head[:2])
    if order is None or len(head) < 8 or (magic := struct.unpack(f"{order}H", head[2:4])[0]) not in (42, 43):
        raise ValueError("this is no TIFF file")
    big = magic == 43
    word, number, wide, entry = ("Q", "Q", 8, 20) if big else ("I", "H", 4, 12)
    at = struct.unpack(f"{order}{word}", head[8:16] if big else head[4:8])[0]
    first = struct.calcsize(f"<{number}")
    count = struct.unpack(f"{order}{number}", fetch(at, first))[0]
    table, tags = fetch(at + first, count * entry), {}
    for k in range(count):
        tag, kind, n = struct.unpack_from(f"{order}HH{word}", table, entry * k)
        if kind not in TYPES:
            continue
        form = f"{order}{n}{TYPES[kind]}" if kind != 5 else f"{order}{2 * n}I"
        size, place = struct.calcsize(form), table[entry * k + 4 + wide : entry * (k + 1)]
        raw = place if size <= wide else fetch(struct.unpack(f"{order}{word}", place)[0], size)
        tags[tag] = struct.unpack_from(form, raw)
    return Header(order, tags)


def unpack_lzw(data: bytes) -> bytes:
    """Codes of 9 to 12 bits, most significant first; 256 clears the table and 257 ends the data."""
    out, table, width, bits, held, before = bytearray(), [], 9, 0, 0, None
    for byte in data:
        held, bits = (held << 8 | byte) & 0xFFFFFF, bits + 8
        if bits < width:
            continue
        bits -= width
        code = held >> bits & (1 << width) - 1
        if code == 257:
            break
        if code == 256:
            table, width, before = [bytes([b]) for b in range(256)] + [b"", b""], 9, None
            continue
        now = table[code] if code < len(table) else before + before[:1]
        out += now
        if before is not None:
            table.append(before + now[:1])
        before = now
        width = 9 if len(table) < 511 else 10 if len(table) < 1023 else 11 if len(table) < 2047 else 12
    return bytes(out)


def _unpack_bits(data: bytes) -> bytes:
    out, at = bytearray(), 0
    while at < len(data):
        n = data[at]
        if n < 128:
            out += data[at + 1 : at + 2 + n]
            at += n + 2
        else:
            if n > 128:
                out += data[at + 1 : at + 2] * (257 - n)
            at += 2 if n > 128 else 1
    return bytes(out)


def read_blocks(source: bytes | Fetch, header: Header, first_row: int = 0, last_row: int | None = None):
    """(y, x, array (bands, h, w)) of the strips or tiles that hold rows from ``first_row`` to before ``last_row``."""
    fetch, last_row = fetcher(source), header.height if last_row is None else last_row
    tall, wide = header.block
    tiled = TILE_OFFSETS in header.tags
    offsets, sizes = (header.tags[t] for t in ((TILE_OFFSETS, TILE_BYTES) if tiled else (STRIP_OFFSETS, STRIP_BYTES)))
    across, down = -(-header.width // wide), -(-header.height // tall)
    planar = header.one(PLANAR, 1) == 2 and header.bands > 1
    inside = 1 if planar else header.bands
    for by in range(max(0, first_row // tall), min(down, -(-last_row // tall))):
        for bx in range(across):
            rows = tall if tiled else min(tall, header.height - by * tall)
            planes = []
            for plane in range(header.bands if planar else 1):
                n = (plane * down + by) * across + bx
                raw = fetch(offsets[n], sizes[n])
                packing = header.one(COMPRESSION, PLAIN)
                if packing in DEFLATES:
                    raw = zlib.decompress(raw)
                elif packing == PACKBITS:
                    raw = _unpack_bits(raw)
                elif packing == LZW:
                    raw = unpack_lzw(raw)
                elif packing != PLAIN:
                    raise ValueError(f"compression {packing} is not supported")
                cells = np.frombuffer(raw, header.dtype, rows * wide * inside).reshape(rows, wide, inside)
                if header.one(PREDICTOR, 1) == 2:
                    cells = np.cumsum(cells, 1, dtype=header.dtype.newbyteorder("="))
                planes.append(cells.transpose(2, 0, 1))
            block = np.concatenate(planes)[:, : header.height - by * tall, : header.width - bx * wide]
            yield by * tall, bx * wide, block


def layout(sizes: list[int], shape: tuple[int, int, int], dtype: np.dtype, rows_per_strip: int, transform: tuple[float, ...] | None = None, epsg: int | None = None, deflate: bool = True, big: bool | None = None) -> tuple[bytes, bytes]:
    """What stands before and after strips of ``sizes`` bytes in the file of a raster of ``shape`` (bands, height, width)."""
    bands, height, width = shape
    big = sum(sizes) + 16 * len(sizes) + (1 << 20) >= CLASSIC if big is None else big
    first, word, wide, entry = (16, "Q", 8, 20) if big else (8, "I", 4, 12)
    kind, pointer = {"u": 1, "i": 2, "f": 3}[dtype.kind], 16 if big else 4
    offsets = [first + n for n in accumulate([0, *sizes])]
    start = offsets.pop()
    tags = {WIDTH: (4, [width]), HEIGHT: (4, [height]), BITS: (3, [dtype.itemsize * 8] * bands), COMPRESSION: (3, [8 if deflate else PLAIN]), PHOTOMETRIC: (3, [2 if bands == 3 else 1]), STRIP_OFFSETS: (pointer, offsets), SAMPLES: (3, [bands]), ROWS_PER_STRIP: (4, [rows_per_strip]), STRIP_BYTES: (pointer, sizes), PLANAR: (3, [1]), SAMPLE_FORMAT: (3, [kind] * bands)}
    if transform:
        x, dx, rx, y, ry, dy = transform
        if rx or ry:
            tags[TRANSFORM] = (12, [dx, rx, 0, x, ry, dy, 0, y, 0, 0, 0, 0, 0, 0, 0, 1])
        else:
            tags |= {PIXEL_SCALE: (12, [dx, -dy, 0]), TIE_POINT: (12, [0, 0, 0, x, y, 0])}
    if epsg:
        geographic = 4000 <= epsg < 5000
        tags[GEO_KEYS] = (3, [1, 1, 0, 3, 1024, 0, 1, 2 if geographic else 1, 1025, 0, 1, 1, 2048 if geographic else 3072, 0, 1, epsg])
    gap = start % 2
    start += gap
    number = "Q" if big else "H"
    extra_at = start + struct.calcsize(f"<{number}") + entry * len(tags) + wide
    entries, extra = b"", b""
    for tag, (form, values) in sorted(tags.items()):
        raw = struct.pack(f"<{len(values)}{TYPES[form]}", *values)
        if len(raw) <= wide:
            place = raw.ljust(wide, b"\0")
        else:
            place = struct.pack(f"<{word}", extra_at + len(extra))
            extra += raw + b"\0" * (len(raw) % 2)
        entries += struct.pack(f"<HH{word}", tag, form, len(values)) + place
    head = b"II+\0" + struct.pack("<HHQ", 8, 0, start) if big else b"II*\0" + struct.pack("<I", start)
    return head, b"\0" * gap + struct.pack(f"<{number}", len(tags)) + entries + b"\0" * wide + extra


def pack_strip(strip: np.ndarray, deflate: bool = True) -> bytes:
    """The bytes of a strip (bands, rows, width), samples of a pixel together."""
    raw = np.ascontiguousarray(strip.transpose(1, 2, 0), strip.dtype.newbyteorder("<")).tobytes()
    return zlib.compress(raw) if deflate else raw


def encode(strips: list[np.ndarray], rows_per_strip: int, transform: tuple[float, ...] | None = None, epsg: int | None = None, deflate: bool = True, big: bool | None = None) -> bytes:
    """A TIFF of strips (bands, rows, width), top to bottom, all but the last of ``rows_per_strip`` rows."""
    bands, _, width = strips[0].shape
    body = [pack_strip(s, deflate) for s in strips]
    head, tail = layout(list(map(len, body)), (bands, sum(s.shape[1] for s in strips), width), strips[0].dtype, rows_per_strip, transform, epsg, deflate, big)
    return head + b"".join(body) + tail
