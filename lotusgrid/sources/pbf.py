"""OpenStreetMap PBF files as tables of nodes and ways, in plain Python.

A file is a sequence of zlib blobs. The driver reads only blob headers (a few bytes
per blob) and lists offsets; tasks read, inflate and decode their blobs, so the work
is split by blob. ``encode`` writes small files for tests.
"""

from __future__ import annotations

import struct
import zlib
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession

from .. import contracts
from ..session import cut


def _varint(b: bytes, i: int) -> tuple[int, int]:
    x = shift = 0
    while True:
        c = b[i]
        i += 1
        x |= (c & 127) << shift
        if c < 128:
            return x, i
        shift += 7


def _zigzag(x: int) -> int:
    return (x >> 1) ^ -(x & 1)


def fields(b: bytes) -> Iterator[tuple[int, int | bytes]]:
    """(number, value) of a message's fields."""
    i = 0
    while i < len(b):
        key, i = _varint(b, i)
        kind = key & 7
        if kind == 0:
            v, i = _varint(b, i)
        elif kind == 2:
            n, i = _varint(b, i)
            v, i = b[i : i + n], i + n
        elif kind == 1:
            v, i = b[i : i + 8], i + 8
        elif kind == 5:
            v, i = b[i : i + 4], i + 4
        else:
            raise ValueError(f"wire type {kind}")
        yield key >> 3, v


def packed(b: bytes, signed: bool = False) -> list[int]:
    out, i = [], 0
    while i < len(b):
        v, i = _varint(b, i)
        out.append(_zigzag(v) if signed else v)
    return out


def _sums(a: list[int]) -> list[int]:
    t, out = 0, []
    for x in a:
        t += x
        out.append(t)
    return out


def blobs(path: str) -> list[tuple[str, int, int]]:
    """(kind, offset, size) of a file's blobs."""
    out = []
    with open(path, "rb") as f:
        while head := f.read(4):
            header = dict(fields(f.read(struct.unpack(">I", head)[0])))
            size = header[3]
            out.append((header[1].decode(), f.tell(), size))
            f.seek(size, 1)
    return out


def inflate(blob: bytes) -> bytes:
    parts = dict(fields(blob))
    if 1 in parts:
        return parts[1]
    if 3 in parts:
        return zlib.decompress(parts[3])
    raise ValueError("only raw and zlib blobs are read")


def decode(data: bytes) -> tuple[list[tuple], list[tuple]]:
    """Nodes (id, lon, lat, tags) and ways (id, tags, refs) of a primitive block."""
    strings, groups, gran, lat0, lon0 = [], [], 100, 0, 0
    for n, v in fields(data):
        if n == 1:
            strings = [s.decode("utf-8", "replace") for k, s in fields(v) if k == 1]
        elif n == 2:
            groups.append(v)
        elif n == 17:
            gran = v
        elif n == 19:
            lat0 = v
        elif n == 20:
            lon0 = v
    deg = lambda x, o: (o + gran * x) * 1e-9
    nodes, ways = [], []
    for g in groups:
        for n, v in fields(g):
            if n == 1:
                d = dict(fields(v))
                tags = {strings[a]: strings[b] for a, b in zip(packed(d.get(2, b"")), packed(d.get(3, b"")))}
                nodes.append((_zigzag(d[1]), deg(_zigzag(d[9]), lon0), deg(_zigzag(d[8]), lat0), tags))
            elif n == 2:
                d = dict(fields(v))
                ids, lat, lon = (_sums(packed(d.get(k, b""), True)) for k in (1, 8, 9))
                kv, at = packed(d.get(10, b"")), 0
                for a, y, x in zip(ids, lat, lon):
                    tags = {}
                    while at < len(kv) and kv[at]:
                        tags[strings[kv[at]]] = strings[kv[at + 1]]
                        at += 2
                    at += 1
                    nodes.append((a, deg(x, lon0), deg(y, lat0), tags))
            elif n == 3:
                d = dict(fields(v))
                tags = {strings[a]: strings[b] for a, b in zip(packed(d.get(2, b"")), packed(d.get(3, b"")))}
                ways.append((d[1], tags, _sums(packed(d.get(8, b""), True))))
    return nodes, ways


def read(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """(nodes, ways) of a file that all executors can read; each block is decoded once, into a table in the shared folder."""
    data = [(o, s) for kind, o, s in blobs(path) if kind == "OSMData"]
    index = spark.createDataFrame(data, "at long, size long").repartition(max(1, min(len(data), 10_000)))
    names = ["id", "lon", "lat", "tags", "refs"]

    def load(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            for at, size in zip(b["at"], b["size"]):
                with open(path, "rb") as f:
                    f.seek(at)
                    nodes, ways = decode(inflate(f.read(size)))
                yield pd.DataFrame([(*n, None) for n in nodes], columns=names)
                yield pd.DataFrame([(i, None, None, tags, refs) for i, tags, refs in ways], columns=names)

    both = cut(index.mapInPandas(load, f"{contracts.NODES}, refs array<long>"), "pbf")
    return both.where("refs is null").select("id", "lon", "lat", "tags"), both.where("refs is not null").select("id", "tags", "refs")


def _put(n: int) -> bytes:
    out = bytearray()
    while n > 127:
        out.append(n & 127 | 128)
        n >>= 7
    return bytes([*out, n])


def _field(n: int, v: int | bytes) -> bytes:
    return _put(n << 3) + _put(v) if isinstance(v, int) else _put(n << 3 | 2) + _put(len(v)) + v


def _packed(a: list[int], signed: bool = False) -> bytes:
    return b"".join(_put((x << 1) ^ (x >> 63) if signed else x) for x in a)


def _steps(a: list[int]) -> list[int]:
    return [x - y for x, y in zip(a, [0, *a])]


def encode(nodes: list[tuple], ways: list[tuple]) -> bytes:
    """A file of dense nodes and ways."""
    words = [""]
    for t in [n[3] for n in nodes] + [w[1] for w in ways]:
        words += [x for kv in t.items() for x in kv if x not in words]
    k = {w: i for i, w in enumerate(words)}
    kv = [x for n in nodes for x in [*(k[y] for p in n[3].items() for y in p), 0]]
    place = lambda j: _packed(_steps([round(n[j] * 1e7) for n in nodes]), True)
    dense = _field(1, _packed(_steps([n[0] for n in nodes]), True)) + _field(8, place(2)) + _field(9, place(1)) + _field(10, _packed(kv))
    ws = b"".join(_field(3, _field(1, w[0]) + _field(2, _packed([k[x] for x in w[1]])) + _field(3, _packed([k[x] for x in w[1].values()])) + _field(8, _packed(_steps(w[2]), True))) for w in ways)
    block = _field(1, b"".join(_field(1, w.encode()) for w in words)) + _field(2, _field(2, dense)) + _field(2, ws)
    out = b""
    for kind, data in (("OSMHeader", _field(4, b"OsmSchema-V0.6")), ("OSMData", block)):
        blob = _field(2, len(data)) + _field(3, zlib.compress(data))
        head = _field(1, kind.encode()) + _field(3, len(blob))
        out += struct.pack(">I", len(head)) + head + blob
    return out
