"""GeoTIFF headers and windows, read from bytes; a plain writer for fixtures.

Covers strips and tiles, chunky and planar samples, no compression, Deflate, LZW and
PackBits, horizontal and floating-point predictors, classic and big files.
"""

from __future__ import annotations

import struct
import zlib
from dataclasses import dataclass, field

import numpy as np

from pixelarium.functions.geo import Crs, lonlat_bounds

# Tags and their value types (fixed values of the format)
WIDTH, HEIGHT, BITS, COMPRESSION, STRIP_AT, SAMPLES, STRIP_ROWS, STRIP_SIZES = 256, 257, 258, 259, 273, 277, 278, 279
PLANAR, PREDICTOR, TILE_W, TILE_H, TILE_AT, TILE_SIZES, SAMPLE_FORMAT = 284, 317, 322, 323, 324, 325, 339
PIXEL_SCALE, TIEPOINT, TRANSFORMATION, GEO_KEYS, NODATA = 33550, 33922, 34264, 34735, 42113
TYPES = {1: "B", 2: "s", 3: "H", 4: "I", 5: "II", 6: "b", 8: "h", 9: "i", 10: "ii", 11: "f", 12: "d", 13: "I", 16: "Q", 17: "q", 18: "Q"}
KINDS = {1: "u", 2: "i", 3: "f"}
GEOGRAPHIC_KEY, PROJECTED_KEY, RASTER_TYPE_KEY, PIXEL_IS_POINT = 2048, 3072, 1025, 2


@dataclass
class Tiff:
    """A raster's header; ``window`` reads samples."""

    data: bytes | Ranges = field(repr=False)
    width: int
    height: int
    count: int
    dtype: np.dtype
    affine: tuple[float, ...]
    crs: Crs
    nodata: float | None
    tags: dict[int, tuple] = field(repr=False)

    @property
    def bounds(self) -> tuple[float, float, float, float]:
        a, b, c, d, e, f = self.affine
        xs = [c + col * a + row * b for col in (0, self.width) for row in (0, self.height)]
        ys = [f + col * d + row * e for col in (0, self.width) for row in (0, self.height)]
        return min(xs), min(ys), max(xs), max(ys)

    @property
    def bounds_wgs84(self) -> tuple[float, float, float, float]:
        return lonlat_bounds(self.crs, *self.bounds)

    def _one(self, tag: int, default):
        return self.tags.get(tag, (default,))[0]

    def window(self, row: int, col: int, rows: int, cols: int) -> np.ndarray:
        """(count, rows, cols) samples; the window must lie inside."""
        planar = self._one(PLANAR, 1) == 2
        if TILE_AT in self.tags:
            wide, high, at, sizes = self._one(TILE_W, 0), self._one(TILE_H, 0), self.tags[TILE_AT], self.tags[TILE_SIZES]
        else:
            wide, high = self.width, min(self._one(STRIP_ROWS, self.height), self.height)
            at, sizes = self.tags[STRIP_AT], self.tags[STRIP_SIZES]
        across, down = -(-self.width // wide), -(-self.height // high)
        out = np.zeros((self.count, rows, cols), self.dtype.newbyteorder("="))
        for i in range(row // high, (row + rows - 1) // high + 1):
            for j in range(col // wide, (col + cols - 1) // wide + 1):
                for plane in range(self.count if planar else 1):
                    k = (plane * down + i) * across + j
                    tall = high if TILE_AT in self.tags else min(high, self.height - i * high)
                    block = self._block(self.data[at[k] : at[k] + sizes[k]], tall, wide, 1 if planar else self.count)
                    r0, r1 = max(row, i * high), min(row + rows, i * high + tall)
                    c0, c1 = max(col, j * wide), min(col + cols, (j + 1) * wide)
                    part = block[r0 - i * high : r1 - i * high, c0 - j * wide : c1 - j * wide].transpose(2, 0, 1)
                    bands = slice(plane, plane + 1) if planar else slice(None)
                    out[bands, r0 - row : r1 - row, c0 - col : c1 - col] = part
        return out

    def _block(self, raw: bytes, rows: int, cols: int, samples: int) -> np.ndarray:
        need = rows * cols * samples * self.dtype.itemsize
        raw = _decompress(self._one(COMPRESSION, 1), raw, need)
        predictor = self._one(PREDICTOR, 1)
        if predictor == 3:
            width = self.dtype.itemsize
            lanes = np.frombuffer(raw, np.uint8, need).reshape(rows, -1).copy()
            lanes = np.add.accumulate(lanes.reshape(rows, -1, samples), axis=1, dtype=np.uint8).reshape(rows, width, cols * samples)
            return np.ascontiguousarray(lanes.transpose(0, 2, 1)).view(f">f{width}").reshape(rows, cols, samples)
        block = np.frombuffer(raw, self.dtype, rows * cols * samples).reshape(rows, cols, samples)
        if predictor == 2:
            block = np.add.accumulate(block, axis=1, dtype=self.dtype.newbyteorder("="))
        return block


def _decompress(kind: int, raw: bytes, need: int) -> bytes:
    if kind == 1:
        return raw
    if kind in (8, 32946):
        return zlib.decompress(raw)
    if kind == 5:
        return _lzw(raw, need)
    if kind == 32773:
        return _packbits(raw)
    raise ValueError(f"unsupported TIFF compression {kind}")


def _packbits(raw: bytes) -> bytes:
    out, i = bytearray(), 0
    while i < len(raw):
        n, i = raw[i], i + 1
        if n < 128:
            out += raw[i : i + n + 1]
            i += n + 1
        elif n > 128:
            out += raw[i : i + 1] * (257 - n)
            i += 1
    return bytes(out)


def _lzw(raw: bytes, need: int) -> bytes:
    """Variable-width codes, most significant bit first, widths grown one early."""
    clear, end = 256, 257
    base = [bytes([b]) for b in range(256)] + [b"", b""]
    table, width, before, out = list(base), 9, b"", bytearray()
    bits = have = 0
    for byte in raw:
        bits, have = (bits << 8 | byte) & 0xFFFFFF, have + 8
        if have < width:
            continue
        have -= width
        code = bits >> have & ((1 << width) - 1)
        if code == end or len(out) >= need:
            break
        if code == clear:
            table, width, before = list(base), 9, b""
            continue
        entry = table[code] if code < len(table) else before + before[:1]
        out += entry
        if before:
            table.append(before + entry[:1])
        before = entry
        width = min(12, max(9, (len(table) + 1).bit_length()))
    return bytes(out)


class Ranges:
    """A file's bytes, read from its store where they are sliced."""

    def __init__(self, file):
        self.file = file

    def __getitem__(self, part: slice) -> bytes:
        start = part.start or 0
        return self.file.read_at(part.stop - start, start)


def read_header(data: bytes | Ranges) -> Tiff:
    """The header alone is read; ``data`` stays with the raster for its windows."""

    def unpack(form: str, at: int) -> tuple:
        return struct.unpack(form, data[at : at + struct.calcsize(form)])

    if data[:2] not in (b"II", b"MM"):
        raise ValueError("not a TIFF file")
    end = "<" if data[:2] == b"II" else ">"
    big = unpack(end + "H", 2)[0] == 43
    at = unpack(end + ("Q" if big else "I"), 8 if big else 4)[0]
    number = unpack(end + ("Q" if big else "H"), at)[0]
    at += 8 if big else 2
    word, step = ("Q", 20) if big else ("I", 12)
    tags: dict[int, tuple] = {}
    for k in range(number):
        tag, kind, n = unpack(end + "HH" + word, at + k * step)
        spec = TYPES.get(kind)
        if spec is None:
            continue
        form = f"{end}{n}s" if spec == "s" else end + spec * n
        inline = at + k * step + (12 if big else 8)
        place = inline if struct.calcsize(form) <= struct.calcsize(word) else unpack(end + word, inline)[0]
        tags[tag] = unpack(form, place)
    bits, kind = tags.get(BITS, (1,))[0], tags.get(SAMPLE_FORMAT, (1,))[0]
    if bits % 8 or kind not in KINDS:
        raise ValueError(f"unsupported TIFF samples of {bits} bits")
    nodata = tags[NODATA][0].split(b"\0")[0].strip() if NODATA in tags else b""
    return Tiff(
        data, tags[WIDTH][0], tags[HEIGHT][0], tags.get(SAMPLES, (1,))[0], np.dtype(f"{end}{KINDS[kind]}{bits // 8}"),
        _affine(tags), Crs.from_epsg(_epsg(tags)), float(nodata) if nodata else None, tags,
    )


def _geo_keys(tags: dict[int, tuple]) -> dict[int, int]:
    keys = tags.get(GEO_KEYS, ())
    return {keys[i]: keys[i + 3] for i in range(4, len(keys) - 3, 4) if keys[i + 1] == 0}


def _epsg(tags: dict[int, tuple]) -> int:
    keys = _geo_keys(tags)
    return keys.get(PROJECTED_KEY) or keys.get(GEOGRAPHIC_KEY) or 4326


def _affine(tags: dict[int, tuple]) -> tuple[float, ...]:
    if TRANSFORMATION in tags:
        m = tags[TRANSFORMATION]
        out = [m[0], m[1], m[3], m[4], m[5], m[7]]
    elif PIXEL_SCALE in tags and TIEPOINT in tags:
        (sx, sy), (i, j, _, x, y, _) = tags[PIXEL_SCALE][:2], tags[TIEPOINT][:6]
        out = [sx, 0.0, x - i * sx, 0.0, -sy, y + j * sy]
    else:
        out = [1.0, 0.0, 0.0, 0.0, 1.0, 0.0]
    if _geo_keys(tags).get(RASTER_TYPE_KEY) == PIXEL_IS_POINT:
        out[2] -= (out[0] + out[1]) / 2
        out[5] -= (out[3] + out[4]) / 2
    return tuple(float(v) for v in out)


def write(path: str, bands: np.ndarray, *, origin: tuple[float, float], pixel: tuple[float, float], epsg: int, nodata: float | None = None, compress: bool = False) -> None:
    """An uncompressed or Deflate planar file of one strip per band."""
    count, height, width = bands.shape
    little = bands.astype(bands.dtype.newbyteorder("<"))
    strips = [zlib.compress(b.tobytes()) if compress else b.tobytes() for b in little]
    projected = epsg != 4326
    keys = (1, 1, 0, 3, 1024, 0, 1, 1 if projected else 2, RASTER_TYPE_KEY, 0, 1, 1, PROJECTED_KEY if projected else GEOGRAPHIC_KEY, 0, 1, epsg)
    tags: list[tuple[int, int, tuple | bytes]] = [
        (WIDTH, 4, (width,)), (HEIGHT, 4, (height,)), (BITS, 3, (bands.dtype.itemsize * 8,) * count), (COMPRESSION, 3, (8 if compress else 1,)),
        (262, 3, (1,)), (STRIP_AT, 4, (0,) * count), (SAMPLES, 3, (count,)), (STRIP_ROWS, 4, (height,)), (STRIP_SIZES, 4, tuple(map(len, strips))),
        (PLANAR, 3, (2,)), (SAMPLE_FORMAT, 3, ({"u": 1, "i": 2, "f": 3}[bands.dtype.kind],) * count),
        (PIXEL_SCALE, 12, (*pixel, 0.0)), (TIEPOINT, 12, (0.0, 0.0, 0.0, *origin, 0.0)), (GEO_KEYS, 3, keys),
    ]
    if nodata is not None:
        tags.append((NODATA, 2, f"{nodata:g}".encode() + b"\0"))

    def pack(kind: int, values) -> bytes:
        return values if isinstance(values, bytes) else struct.pack("<" + TYPES[kind] * len(values), *values)

    head = 8 + 2 + 12 * len(tags) + 4
    extra = sum(len(b) + len(b) % 2 for _, k, v in tags if len(b := pack(k, v)) > 4)
    places, at = [], head + extra
    for s in strips:
        places.append(at)
        at += len(s)
    tags = [(t, k, tuple(places) if t == STRIP_AT else v) for t, k, v in tags]
    entries, more = b"", b""
    for tag, kind, values in tags:
        body = pack(kind, values)
        n = len(values)
        if len(body) > 4:
            place, more = head + len(more), more + body + b"\0" * (len(body) % 2)
            body = struct.pack("<I", place)
        entries += struct.pack("<HHI", tag, kind, n) + body.ljust(4, b"\0")
    with open(path, "wb") as f:
        f.write(b"II*\0" + struct.pack("<I", 8) + struct.pack("<H", len(tags)) + entries + struct.pack("<I", 0) + more + b"".join(strips))
