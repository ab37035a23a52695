"""Single-band GeoTIFF rasters as a table of pixels ``(row, col, lon, lat, value)``, in plain Python.

Strips and tiles, uncompressed or deflate, without or with horizontal predictor, 8 to
64 bit. The driver reads the header; each task reads its own strips or tiles. Pixels
without data are left out. ``encode`` writes small files for tests.
"""

from __future__ import annotations

import struct
import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession

from .. import contracts

_SIZES = {1: ("B", 1), 2: ("c", 1), 3: ("H", 2), 4: ("I", 4), 5: ("II", 8), 11: ("f", 4), 12: ("d", 8), 16: ("Q", 8)}


def header(path: str) -> dict[int, tuple]:
    """Tags of the first image; tag 0 holds the byte order."""
    with open(path, "rb") as f:
        order = {b"II": "<", b"MM": ">"}[f.read(2)]
        big = struct.unpack(order + "H", f.read(2))[0] == 43
        if big:
            f.read(4)
        at = struct.unpack(order + ("Q" if big else "I"), f.read(8 if big else 4))[0]
        f.seek(at)
        n = struct.unpack(order + ("Q" if big else "H"), f.read(8 if big else 2))[0]
        width = 8 if big else 4
        entries = [f.read(12 + width - 4 + (4 if big else 0)) for _ in range(n)]
        tags: dict[int, tuple] = {0: (order,)}
        for e in entries:
            tag, kind = struct.unpack(order + "HH", e[:4])
            count = struct.unpack(order + ("Q" if big else "I"), e[4 : 4 + width])[0]
            if kind not in _SIZES:
                continue
            code, size = _SIZES[kind]
            raw = e[4 + width :]
            if count * size > width:
                f.seek(struct.unpack(order + ("Q" if big else "I"), raw)[0])
                raw = f.read(count * size)
            raw = raw[: count * size]
            tags[tag] = (raw,) if kind == 2 else struct.unpack(order + code * count, raw)
    return tags


def read(spark: SparkSession, path: str) -> DataFrame:
    """Pixels of a file that all executors can read; it has to be in degrees of WGS84."""
    t = header(path)
    keys = t.get(34735, ())
    geo = {keys[i]: keys[i + 3] for i in range(4, len(keys), 4)}
    contracts.require_crs(f"EPSG:{geo.get(2048, 0)}")
    width, height, bits, kind, packing, predictor = t[256][0], t[257][0], t[258][0], t.get(339, (1,))[0], t.get(259, (1,))[0], t.get(317, (1,))[0]
    if t.get(277, (1,))[0] != 1 or packing not in (1, 8, 32946) or predictor not in (1, 2):
        raise ValueError("only one band, plain or deflate, is read")
    dtype = np.dtype({1: "u", 2: "i", 3: "f"}[kind] + str(bits // 8)).newbyteorder(t[0][0])
    (sx, sy, *_), (_, _, _, x0, y0, *_) = t[33550], t[33922]
    nodata = float(t[42113][0].strip(b"\0 ")) if 42113 in t else None
    if 322 in t:
        w, h, at, size = t[322][0], t[323][0], t[324], t[325]
        across = -(-width // w)
        parts = [(k // across * h, k % across * w, h, w, o, s) for k, (o, s) in enumerate(zip(at, size))]
    else:
        h = t.get(278, (height,))[0]
        parts = [(k * h, 0, min(h, height - k * h), width, o, s) for k, (o, s) in enumerate(zip(t[273], t[279]))]
    index = spark.createDataFrame(parts, "r long, c long, h long, w long, at long, size long").repartition(max(1, min(len(parts), 10_000)))

    def load(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            for p in b.itertuples():
                with open(path, "rb") as f:
                    f.seek(p.at)
                    raw = f.read(p.size)
                a = np.frombuffer(raw if packing == 1 else zlib.decompress(raw), dtype)[: p.h * p.w].reshape(p.h, p.w)
                if predictor == 2:
                    a = np.cumsum(a, axis=1, dtype=dtype)
                rows, cols = np.meshgrid(np.arange(p.r, p.r + p.h), np.arange(p.c, p.c + p.w), indexing="ij")
                v = a.astype(np.float64)
                ok = (rows < height) & (cols < width) & ~np.isnan(v)
                if nodata is not None:
                    ok &= v != nodata
                rows, cols = rows[ok], cols[ok]
                yield pd.DataFrame({"row": rows.astype(np.int32), "col": cols.astype(np.int32), "lon": x0 + (cols + 0.5) * sx, "lat": y0 - (rows + 0.5) * sy, "value": v[ok]})

    return index.mapInPandas(load, contracts.PIXELS)


def encode(a: np.ndarray, x0: float, y0: float, step: float, nodata: float | None = None) -> bytes:
    """A deflate file of float32 strips of one row each."""
    strips = [zlib.compress(r.astype("<f4").tobytes()) for r in a]
    data = b"".join(strips)
    at = [8 + sum(map(len, strips[:k])) for k in range(len(strips))]
    geo = (1, 1, 0, 2, 1024, 0, 1, 2, 2048, 0, 1, 4326)
    tags = [(256, "I", (a.shape[1],)), (257, "I", (a.shape[0],)), (258, "H", (32,)), (259, "H", (8,)), (273, "I", at), (277, "H", (1,)), (278, "I", (1,)), (279, "I", [len(s) for s in strips]), (339, "H", (3,)), (33550, "d", (step, step, 0.0)), (33922, "d", (0.0, 0.0, 0.0, x0, y0, 0.0)), (34735, "H", geo)]
    if nodata is not None:
        tags.append((42113, "s", str(nodata).encode() + b"\0"))
    ifd = 8 + len(data)
    extra, entries = b"", b""
    base = ifd + 2 + 12 * len(tags) + 4
    for tag, code, v in tags:
        raw = v if code == "s" else struct.pack("<" + code * len(v), *v)
        kind = {"I": 4, "H": 3, "d": 12, "s": 2}[code]
        entries += struct.pack("<HHI", tag, kind, len(v))
        if len(raw) <= 4:
            entries += raw.ljust(4, b"\0")
        else:
            entries += struct.pack("<I", base + len(extra))
            extra += raw
    return b"II*\0" + struct.pack("<I", ifd) + data + struct.pack("<H", len(tags)) + entries + struct.pack("<I", 0) + extra
