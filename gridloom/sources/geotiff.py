"""GeoTIFF in pure Python: headers, windows, and a streaming writer of tiled BigTIFF.

Reads classic and Big TIFF, striped or tiled, chunky or planar, without compression or with Deflate, and the
horizontal predictor. Files are opened through pyarrow's file systems, so any URI those know will do.
"""

from __future__ import annotations

import struct
import zlib
from dataclasses import dataclass, field

import numpy as np
import pyarrow.fs as pafs

_KIND = {1: "B", 2: "s", 3: "H", 4: "I", 5: "II", 6: "b", 8: "h", 9: "i", 11: "f", 12: "d", 13: "I", 16: "Q", 17: "q", 18: "Q"}
_FORMAT = {(1, 8): "uint8", (1, 16): "uint16", (1, 32): "uint32", (1, 64): "uint64", (2, 8): "int8", (2, 16): "int16", (2, 32): "int32", (2, 64): "int64", (3, 32): "float32", (3, 64): "float64"}
DTYPES = {v: k for k, v in _FORMAT.items()}


class RasterError(ValueError):
    """A file that is no raster this module can read, or a value that does not fit one."""


@dataclass
class Header:
    """What a raster's header says; gt is (x0, xres, xskew, y0, yskew, yres)."""

    ncols: int
    nrows: int
    gt: tuple
    srs: str
    dtype: str
    num_bands: int
    nodata: float | None
    layer_type: list = field(default_factory=list)
    tags: dict = field(default_factory=dict, repr=False)
    order: str = "<"

    def info(self, scene_id: str) -> dict:
        return {"scene_id": scene_id} | {k: getattr(self, k) for k in ("ncols", "nrows", "gt", "srs", "dtype", "num_bands", "nodata", "layer_type")}


def open_input(path: str):
    if "://" in path or path.startswith("file:"):
        fs, p = pafs.FileSystem.from_uri(path.replace("s3a://", "s3://", 1))
        return fs.open_input_file(p)
    return open(path, "rb")


def read_directories(f) -> list[Header]:
    """The headers of the image and its overviews."""
    f.seek(0)
    head = f.read(16)
    order = {b"II": "<", b"MM": ">"}.get(head[:2])
    if order is None:
        raise RasterError("not a TIFF file")
    big = struct.unpack(order + "H", head[2:4])[0] == 43
    at, out = struct.unpack(order + "Q", head[8:16])[0] if big else struct.unpack(order + "I", head[4:8])[0], []
    while at:
        f.seek(at)
        n = struct.unpack(order + ("Q" if big else "H"), f.read(8 if big else 2))[0]
        size = 20 if big else 12
        raw = f.read(n * size + (8 if big else 4))
        tags = {}
        for i in range(n):
            e = raw[i * size:(i + 1) * size]
            tag, kind = struct.unpack(order + "HH", e[:4])
            count = struct.unpack(order + ("Q" if big else "I"), e[4:12] if big else e[4:8])[0]
            code = _KIND.get(kind)
            if code is None:
                continue
            width = struct.calcsize("=" + code) * count
            data = e[12:20] if big else e[8:12]
            if width > len(data):
                back = f.tell()
                f.seek(struct.unpack(order + ("Q" if big else "I"), data)[0])
                data = f.read(width)
                f.seek(back)
            tags[tag] = data[:count].rstrip(b"\0").decode(errors="replace") if kind == 2 else struct.unpack(f"{order}{count * len(code)}{code[0]}", data[:width])
        out.append(_header(tags, order))
        at = struct.unpack(order + ("Q" if big else "I"), raw[n * size:])[0]
    return out


def _header(tags: dict, order: str) -> Header:
    one = lambda t, d=None: tags[t][0] if t in tags else d
    dtype = _FORMAT.get((one(339, 1), one(258, 1)))
    if dtype is None:
        raise RasterError(f"samples of {one(258, 1)} bits in format {one(339, 1)} are not supported")
    if 34264 in tags:
        m = tags[34264]
        gt = (m[3], m[0], m[1], m[7], m[4], m[5])
    elif 33550 in tags and 33922 in tags:
        sx, sy = tags[33550][:2]
        i, j, _, x, y = tags[33922][:5]
        gt = (x - i * sx, sx, 0.0, y + j * sy, 0.0, -sy)
    else:
        gt = (0.0, 1.0, 0.0, 0.0, 0.0, 1.0)
    keys = tags.get(34735, ())
    geo = {keys[i]: keys[i + 3] for i in range(4, len(keys) - 3, 4) if keys[i + 1] == 0}
    code = geo.get(3072) or geo.get(2048)
    nodata = tags.get(42113)
    bands = one(277, 1)
    return Header(one(256), one(257), tuple(map(float, gt)), f"EPSG:{code}" if code else "", dtype, bands, float(nodata) if nodata not in (None, "") else None, ["athematic"] * bands, tags, order)


def read_header(path: str) -> Header:
    with open_input(path) as f:
        return read_directories(f)[0]


def read_window(f, h: Header, band: int, top: int, left: int, ysize: int, xsize: int) -> np.ndarray:
    """A window inside the image, of one band counted from 1; only the strips or tiles it touches are read."""
    t, one = h.tags, lambda k, d=None: h.tags[k][0] if k in h.tags else d
    tiled = 324 in t
    bw, bh = (one(322), one(323)) if tiled else (h.ncols, min(one(278, h.nrows), h.nrows))
    offsets, counts = (t[324], t[325]) if tiled else (t[273], t[279])
    planar, compression, predictor = one(284, 1) == 2, one(259, 1), one(317, 1)
    samples = 1 if planar else h.num_bands
    across, down = -(-h.ncols // bw), -(-h.nrows // bh)
    kind = np.dtype(h.dtype).newbyteorder(h.order)
    out = np.zeros((ysize, xsize), h.dtype)
    for by in range(top // bh, -(-(top + ysize) // bh)):
        for bx in range(left // bw, -(-(left + xsize) // bw)):
            i = by * across + bx + ((band - 1) * across * down if planar else 0)
            rows = bh if tiled else min(bh, h.nrows - by * bh)
            if not counts[i]:
                continue
            f.seek(offsets[i])
            data = f.read(counts[i])
            if compression in (8, 32946):
                data = zlib.decompress(data)
            elif compression != 1:
                raise RasterError(f"compression {compression} is not supported")
            a = np.frombuffer(data, kind, rows * bw * samples).reshape(rows, bw, samples)
            if predictor == 2:
                a = np.cumsum(a.astype(h.dtype), axis=1, dtype=h.dtype)
            elif predictor != 1:
                raise RasterError(f"predictor {predictor} is not supported")
            a = a[:, :, 0 if planar else band - 1]
            y0, y1, x0, x1 = max(top, by * bh), min(top + ysize, by * bh + rows), max(left, bx * bw), min(left + xsize, bx * bw + bw)
            out[y0 - top:y1 - top, x0 - left:x1 - left] = a[y0 - by * bh:y1 - by * bh, x0 - bx * bw:x1 - bx * bw]
    return out


class Writer:
    """Tiled Deflate BigTIFF, band after band, overviews after the image; tiles may come in any order."""

    def __init__(self, path: str, ncols: int, nrows: int, num_bands: int, dtype: str, gt, srs: str, nodata: float | None, tile: int, levels=(), compress: bool = True):
        if tile % 16:
            raise RasterError("tile sides are multiples of 16")
        self.f, self.tile, self.dtype, self.compress = open(path, "wb"), tile, np.dtype(dtype), compress
        self.shape, self.bands, self.gt, self.srs, self.nodata = (nrows, ncols), num_bands, gt, srs, nodata
        self.f.write(struct.pack("<2sHHHQ", b"II", 43, 8, 0, 0))
        self.sizes = {1: (nrows, ncols)} | {x: (len(range(x // 2, nrows, x)), len(range(x // 2, ncols, x))) for x in levels}
        self.tiles = {x: {} for x in self.sizes}
        self.stats: dict[int, dict] = {}
        self._empty: tuple[int, int] | None = None

    def _grid(self, level: int) -> tuple[int, int]:
        h, w = self.sizes[level]
        return -(-h // self.tile), -(-w // self.tile)

    def write(self, level: int, band: int, row: int, col: int, a: np.ndarray) -> None:
        """Tile (row, col) of a level (1 for the image) and band."""
        full = np.full((self.tile, self.tile), self.fill(), self.dtype)
        full[:a.shape[0], :a.shape[1]] = a
        self.tiles[level][band, row, col] = self._put(full)

    def fill(self):
        return self.nodata if self.nodata is not None else 0

    def _put(self, full: np.ndarray) -> tuple[int, int]:
        data = full.astype(self.dtype.newbyteorder("<")).tobytes()
        data = zlib.compress(data, 6) if self.compress else data
        at = self.f.tell()
        self.f.write(data)
        return at, len(data)

    def close(self) -> None:
        if self._empty is None:
            self._empty = self._put(np.full((self.tile, self.tile), self.fill(), self.dtype))
        link = 8
        for level in self.sizes:
            link = self._directory(level, link)
        self.f.close()

    def _directory(self, level: int, link: int) -> int:
        (h, w), (down, across) = self.sizes[level], self._grid(level)
        places = [self.tiles[level].get((b, r, c), self._empty) for b in range(1, self.bands + 1) for r in range(down) for c in range(across)]
        fmt, bits = DTYPES[self.dtype.name]
        e = [(254, 4, [0 if level == 1 else 1]), (256, 4, [w]), (257, 4, [h]), (258, 3, [bits] * self.bands), (259, 3, [8 if self.compress else 1]), (262, 3, [1]), (277, 3, [self.bands]), (284, 3, [2]),
             (322, 4, [self.tile]), (323, 4, [self.tile]), (324, 16, [p[0] for p in places]), (325, 16, [p[1] for p in places]), (339, 3, [fmt] * self.bands)]
        if self.bands > 1:
            e.append((338, 3, [0] * (self.bands - 1)))
        if level == 1:
            x0, xres, xskew, y0, yskew, yres = self.gt
            if xskew or yskew or yres > 0:
                e.append((34264, 12, [xres, xskew, 0, x0, yskew, yres, 0, y0, 0, 0, 0, 0, 0, 0, 0, 1]))
            else:
                e += [(33550, 12, [xres, -yres, 0.0]), (33922, 12, [0.0, 0.0, 0.0, x0, y0, 0.0])]
            if self.srs:
                code = int(self.srs.rpartition(":")[2])
                flat = code == 4326
                e.append((34735, 3, [1, 1, 0, 3, 1024, 0, 1, 2 if flat else 1, 1025, 0, 1, 1, 2048 if flat else 3072, 0, 1, code]))
            items = "".join(f'<Item name="STATISTICS_{k}" sample="{b - 1}">{v}</Item>' for b, s in sorted(self.stats.items()) for k, v in s.items())
            if items:
                e.append((42112, 2, f"<GDALMetadata>{items}</GDALMetadata>".encode() + b"\0"))
        if self.nodata is not None:
            e.append((42113, 2, f"{self.nodata:.17g}".encode() + b"\0"))
        e.sort(key=lambda x: x[0])
        body = []
        for tag, kind, v in e:
            data = v if kind == 2 else struct.pack(f"<{len(v)}{_KIND[kind]}", *v)
            if len(data) > 8:
                self.f.seek(0, 2)
                at = self.f.tell()
                self.f.write(data)
                data = struct.pack("<Q", at)
            body.append(struct.pack("<HHQ", tag, kind, len(v)) + data.ljust(8, b"\0"))
        self.f.seek(0, 2)
        at = self.f.tell()
        self.f.write(struct.pack("<Q", len(body)) + b"".join(body) + struct.pack("<Q", 0))
        end = self.f.tell()
        self.f.seek(link)
        self.f.write(struct.pack("<Q", at))
        self.f.seek(end)
        return end - 8


def write_array(path: str, bands: np.ndarray, gt, srs: str, nodata: float | None, tile: int = 256) -> None:
    """A small raster of (bands, rows, cols) in one go."""
    n, h, w = bands.shape
    out = Writer(path, w, h, n, bands.dtype.name, gt, srs, nodata, tile)
    for b in range(n):
        for r in range(-(-h // tile)):
            for c in range(-(-w // tile)):
                out.write(1, b + 1, r, c, bands[b, r * tile:(r + 1) * tile, c * tile:(c + 1) * tile])
    out.close()


def read_array(path: str, band: int = 1, directory: int = 0) -> np.ndarray:
    with open_input(path) as f:
        h = read_directories(f)[directory]
        return read_window(f, h, band, 0, 0, h.nrows, h.ncols)
