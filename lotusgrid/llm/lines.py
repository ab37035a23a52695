"""Lines that a source repeats over many of its documents (problem 4).

Each (source, line) keeps the set of its documents as compressed bitmaps: document
ids are cut into containers of 2^16; a container is a sorted array of 16-bit
positions while that is smaller, else 8 KB of bits. Bitmaps are built where the text
is read (variants of a line that share the one form meet there, in one bitmap), so
what is shuffled is one row per line and input partition. Bitmaps of one container
are united exactly and their cardinalities added up; a line is over-repeated when
its documents number at least ``least`` and at least ``share`` of the source's
documents. The occurrences of its documents stand beside the bitmaps, so they are looked
up by the line in the same rows; ``without_repeated`` takes the lines out of the texts.

Defined results: null and empty bodies count as documents of their source and have
no lines; empty lines never count; a document counts once per line, all its
occurrences are given; repeated ids are one document; ids that are no whole numbers are
an error, as bitmaps are of numbers.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .. import contracts
from ..session import cut, spread
from .batches import slices
from .content import clean_lines


def site_of(url: Column) -> Column:
    """Host of a url in lower case, without port and a leading ``www.`` or ``m.``."""
    host = F.regexp_extract(F.lower(F.trim(url)), r"^[a-z][a-z0-9+.-]*://(?:[^/@?#]*@)?([^/:?#]*)", 1)
    return F.regexp_replace(host, r"^(?:www|m)\.", "")


def pack(low: np.ndarray) -> bytes:
    """A container of distinct 16-bit positions: array form below 4,096 of them, else bits."""
    if len(low) < 4096:
        return np.sort(low).astype("<u2").tobytes()
    bits = np.zeros(65536, np.uint8)
    bits[low] = 1
    return np.packbits(bits, bitorder="little").tobytes()


def unpack(b: bytes) -> np.ndarray:
    if len(b) < 8192:
        return np.frombuffer(b, "<u2")
    return np.flatnonzero(np.unpackbits(np.frombuffer(b, np.uint8), bitorder="little")).astype(np.uint16)


def unite(parts: list[bytes]) -> bytes:
    """The union of containers."""
    if len(parts) == 1:
        return parts[0]
    return pack(np.unique(np.concatenate([unpack(p) for p in parts])))


def line_bitmaps(df: DataFrame, record: str, site: Column, body: str, rows_at_once: int = 20_000) -> DataFrame:
    """(site, line, box, docs, places): bitmaps of lines, one row per line, container and stretch of input.

    ``line`` is a 128-bit hash of the line's one form, ``box`` the upper bits of the
    document ids, ``places`` packs the occurrences (position in box, line number).
    Stretches of ``rows_at_once`` documents bound the memory, not the result.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[tuple, list[int]] = {}
        n = 0

        def flush() -> pa.RecordBatch:
            sites, lines, boxes, docs, places = [], [], [], [], []
            for (s, line, box), occ in held.items():
                a = np.array(occ, dtype=np.int64)
                sites.append(s)
                lines.append(line)
                boxes.append(box)
                docs.append(pack(np.unique((a >> 32).astype(np.uint16))))
                places.append(a.astype("<i8").tobytes())
            held.clear()
            return pa.RecordBatch.from_arrays(
                [pa.array(sites, pa.string()), pa.array(lines, pa.binary()), pa.array(boxes, pa.int64()), pa.array(docs, pa.binary()), pa.array(places, pa.binary())],
                names=["site", "line", "box", "docs", "places"],
            )

        digest = xxhash.xxh3_128_digest
        for b in slices(batches):
            for r, s, t in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), b.column(2).to_pylist()):
                if r is None or s is None:
                    continue
                box, low = r >> 16, (r & 0xFFFF) << 32
                for i, x in clean_lines(t):
                    k = (s, digest(x.encode("utf-8", "surrogatepass")), box)
                    occ = held.get(k)
                    if occ is None:
                        held[k] = [low | i]
                    else:
                        occ.append(low | i)
            n += b.num_rows
            if n >= rows_at_once:
                n = 0
                yield flush()
        if held:
            yield flush()

    contracts.require_whole_numbers(df, record)
    rows = df.select(F.col(record).cast("long").alias("rec"), site.alias("site"), F.col(body).alias("body"))
    return spread(rows, "rec").mapInArrow(run, "site string, line binary, box long, docs binary, places binary")


def repeated_lines(df: DataFrame, record: str = "record_id", url: str = "url", body: str = "body", least: int = 4, share: float = 0.05, site: Column | None = None) -> DataFrame:
    """(record, line_no) of all occurrences of over-repeated lines in their source's documents."""
    src = site if site is not None else site_of(F.col(url))
    maps = cut(line_bitmaps(df, record, src, body), "line-maps")
    totals = df.select(src.alias("site"), F.col(record).alias("rec")).where("site is not null and rec is not null").groupBy("site").agg(F.count_distinct("rec").alias("n_docs"))
    n_rows = maps.select("site", "line", "box", F.when(F.octet_length("docs") < 8192, F.octet_length("docs") / 2).otherwise(65536).alias("most"), "docs")
    # Upper bounds first: lines that cannot reach ``least`` are settled by a sum, without touching bitmaps.
    likely = n_rows.groupBy("site", "line").agg(F.sum("most").alias("most")).where(F.col("most") >= least).select("site", "line")

    @F.pandas_udf("int")
    def united(parts: pd.Series) -> pd.Series:
        return parts.map(lambda p: len(unpack(unite(list(p)))))

    boxes = n_rows.join(likely, ["site", "line"], "left_semi").groupBy("site", "line", "box").agg(F.collect_list("docs").alias("parts"))
    cards = boxes.select("site", "line", united("parts").alias("n")).groupBy("site", "line").agg(F.sum("n").alias("n"))
    over = cards.join(totals, "site").where((F.col("n") >= least) & (F.col("n") >= F.col("n_docs") * F.lit(share))).select("site", "line")

    def places(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            boxes, packed = b.column(0).to_pylist(), b.column(1).to_pylist()
            occ = [np.frombuffer(p, "<i8") for p in packed]
            a = np.concatenate(occ) if occ else np.zeros(0, np.int64)
            base = np.repeat(np.array(boxes, dtype=np.int64) << 16, [len(o) for o in occ])
            yield pa.RecordBatch.from_arrays([pa.array(base | (a >> 32)), pa.array(a & 0xFFFFFFFF)], names=[record, "line_no"])

    hit = maps.join(over, ["site", "line"], "left_semi").select("box", "places")
    return hit.mapInArrow(places, f"`{record}` long, line_no long")


def without_repeated(df: DataFrame, record: str = "record_id", url: str = "url", body: str = "body", **how) -> DataFrame:
    """The table with the over-repeated lines taken out of ``body``; a null body stays null, other columns stay as they are.

    The lines are told by record and number, so record ids are taken to be unique.
    """
    hits = repeated_lines(df, record, url, body, **how).groupBy(record).agg(F.collect_set("line_no").alias("_gone"))
    kept = F.filter(F.split(body, "\n", -1), lambda _, i: ~F.array_contains("_gone", (i + 1).cast("long")))
    return df.join(hits, record, "left").withColumn(body, F.when(F.col("_gone").isNull(), F.col(body)).otherwise(F.array_join(kept, "\n"))).drop("_gone")
