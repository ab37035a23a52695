"""Main content of a page (problem 5).

A page's lines are the nodes of a tree-structured graphical model. Stored bodies
keep no markup, so the document tree that is left is the one of reading order: the
page is the root's only path, and each non-empty line is the child of the non-empty
line above it (a path is a tree). Hidden states of a node:

    0 furniture above the article   1 article (paragraph or section heading)
    2 furniture inside the article  3 furniture below the article

Node potentials are log-linear in hashed features of the line in its one form;
parent-child potentials are a 4x4 table and root and leaf have their own tables.
Sum-product messages go upward and downward through all pages of a batch at once
(one vectorised step per tree depth), and give each line's marginal of state 1.
A line is content when that marginal is at least ``threshold``.

The weights were trained by ``content_train`` from labelled pages and are stored
beside this module. Defined results: null and empty bodies have no lines, empty
lines are never content, line numbers start at 1 and count empty lines; repeated
records give repeated rows.
"""

from __future__ import annotations

import os
import re
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql.pandas.types import to_arrow_type

from ..session import spread
from .batches import slices
from .canon import canon

DIM = 1 << 15
STATES = 4
CONTENT = 1
_BULLET = re.compile(r"(?:[•◦▪*+–»-]|>>?|\d+\.)\s")
_SPEAKER = re.compile(r"\S+(?: \S+){0,2} ?\d*:\s")
_DIGITS = re.compile(r"\d+")
_HOST = re.compile(r"^[a-z][a-z0-9+.-]*://(?:[^/@]*@)?(?:www\.|m\.)?([^/:?#.]+)")
_SIGNS = "|·☰©>:?!"


def site_label(url: str | None) -> str:
    """The first label of the url's host, in lower case."""
    m = _HOST.match((url or "").strip().lower())
    return m.group(1) if m else "\0"


_IDS: dict[str, int] = {}


def _h(s: str) -> int:
    i = _IDS.get(s)
    if i is None:
        i = zlib.crc32(s.encode("utf-8", "surrogatepass")) % DIM
        if len(_IDS) < 100_000:
            _IDS[s] = i
    return i


def features(line: str, label: str) -> list[int]:
    """Hashed features of a line in its one form, trimmed, white space runs as one space."""
    return [_h(x) for part in split_features(line, label) for x in part]


def split_features(line: str, label: str) -> tuple[list[str], list[str]]:
    """Features of layout and of words."""
    low = line.lower()
    n = line.count(" ") + 1
    own = label in low
    if n <= 9:
        if own:
            low = low.replace(label, "§")
        words = _DIGITS.sub("0", low).split(" ")
        last = words[-1]
    else:
        words = _DIGITS.sub("0", low[:60]).split(" ", 3)
        last = low[-24:].rsplit(" ", 1)[-1]
    size = 0 if n == 1 else 1 if n <= 3 else 2 if n <= 8 else 3 if n <= 14 else 4 if n <= 25 else 5
    end = line[-1]
    end = end if end in ".?!:" else "a"
    shape = [f"n{size}", f"e{end}", f"n{size}e{end}", "up" if line[0].isupper() else "lo"]
    if own:
        shape.append("§")
    if _BULLET.match(line):
        shape.append("bullet")
    elif ":" in line[:40] and _SPEAKER.match(line):
        shape.append("speaker" + words[0])
    for c in _SIGNS:
        if c in line:
            shape.append("c" + c)
    if " - " in line:
        shape.append("dash" + end)
    lexical = ["1" + words[0], "2" + " ".join(words[:2]), "3" + " ".join(words[:3]), "z" + last]
    if n <= 9:
        lexical.append("=" + " ".join(words))
        lexical.extend(["w" + w for w in words])
    return shape, lexical


class Model:
    """Weights of the potentials."""

    def __init__(self, node: np.ndarray, edge: np.ndarray, root: np.ndarray, leaf: np.ndarray):
        self.node, self.edge, self.root, self.leaf = node, edge, root, leaf

    @staticmethod
    def load(path: str | None = None) -> Model:
        with np.load(path or os.path.join(os.path.dirname(__file__), "content_weights.npz")) as z:
            return Model(z["node"].astype(np.float32), z["edge"].astype(np.float64), z["root"].astype(np.float64), z["leaf"].astype(np.float64))

    def save(self, path: str) -> None:
        np.savez_compressed(path, node=self.node.astype(np.float16), edge=self.edge.astype(np.float32), root=self.root.astype(np.float32), leaf=self.leaf.astype(np.float32))


def marginals(node: np.ndarray, start: np.ndarray, length: np.ndarray, m: Model) -> np.ndarray:
    """Marginals of all states by sum-product over many paths at once.

    ``node`` holds log potentials of all lines, page after page; page i owns the
    ``length[i]`` rows from ``start[i]``. Pages are handled in groups of like length.
    """
    out = np.zeros_like(node, dtype=np.float64)
    edge, root, leaf = np.exp(m.edge), np.exp(m.root), np.exp(m.leaf)
    order = np.argsort(-length, kind="stable")
    order = order[length[order] > 0]
    for lo in range(0, len(order), 512):
        pages = order[lo : lo + 512]
        n, s, depth = length[pages], start[pages], int(length[pages[0]])
        phi = np.zeros((depth, len(pages), STATES))
        for t in range(depth):
            on = int(np.searchsorted(-n, -t, side="left"))  # lengths fall: pages with n > t come first
            x = node[s[:on] + t].astype(np.float64)
            phi[t, :on] = np.exp(x - x.max(axis=1, keepdims=True))
        down = np.zeros_like(phi)
        up = np.ones_like(phi)
        for t in range(depth):
            on = int(np.searchsorted(-n, -t, side="left"))
            into = root if t == 0 else (down[t - 1, :on] * phi[t - 1, :on]) @ edge
            into = np.broadcast_to(into, (on, STATES))
            down[t, :on] = into / into.sum(axis=1, keepdims=True)
        for t in range(depth - 1, -1, -1):
            on = int(np.searchsorted(-n, -t, side="left"))
            more = int(np.searchsorted(-n, -(t + 1), side="left")) if t + 1 < depth else 0
            up[t, more:on] = leaf
            if more:
                got = (up[t + 1, :more] * phi[t + 1, :more]) @ edge.T
                up[t, :more] = got / got.sum(axis=1, keepdims=True)
        p = down * phi * up
        p /= np.maximum(p.sum(axis=2, keepdims=True), 1e-300)
        for t in range(depth):
            on = int(np.searchsorted(-n, -t, side="left"))
            out[s[:on] + t] = p[t, :on]
    return out


def clean_lines(body: str | None) -> list[tuple[int, str]]:
    """(line number, line in its one form with single spaces) of the non-empty lines of a body."""
    if not body:
        return []
    c = canon(body)
    return [(i, s) for i, x in enumerate(c.split("\n"), 1) if (s := " ".join(x.split()))]


class Scorer:
    """Node potentials of lines, computed a batch at a time; short lines are remembered."""

    def __init__(self, m: Model, room: int = 50_000):
        self.m, self.room = m, room
        self.place: dict = {}
        self.known = np.zeros((0, STATES), np.float32)

    def of(self, pages: list[tuple[str, list[tuple[int, str]]]]) -> np.ndarray:
        if len(self.place) > self.room:
            self.place, self.known = {}, np.zeros((0, STATES), np.float32)
        place, at, new, cuts = self.place, [], [], []
        base, n_new = len(self.known), 0
        for label, lines in pages:
            for _, s in lines:
                short = len(s) < 90
                if short:
                    k = (label, s) if label in s.lower() else s
                    i = place.get(k)
                    if i is not None:
                        at.append(i)
                        continue
                    place[k] = base + n_new
                at.append(base + n_new)
                n_new += 1
                cuts.append(len(new))
                new.extend(features(s, label))
        if n_new:
            got = np.add.reduceat(self.m.node[np.array(new)], np.array(cuts), axis=0)
            self.known = np.concatenate([self.known, got])
        out = self.known[np.array(at, dtype=np.int64)]
        if len(self.known) > 2 * self.room:  # long lines are not asked for again
            self.place, self.known = {}, np.zeros((0, STATES), np.float32)
        return out


def content_of(urls: list, bodies: list, m: Model, threshold: float = 0.5, scorer: Scorer | None = None) -> list[list[tuple[int, str]]]:
    """The content lines (number, line in its one form) of each page."""
    pages = [(site_label(u), clean_lines(b)) for u, b in zip(urls, bodies)]
    n = np.array([len(lines) for _, lines in pages], dtype=np.int64)
    if not n.sum():
        return [[] for _ in pages]
    start = np.concatenate([[0], np.cumsum(n)[:-1]])
    node = (scorer or Scorer(m)).of(pages)
    keep = (marginals(node, start, n, m)[:, CONTENT] >= threshold).tolist()
    return [[x for x, k in zip(lines, keep[a : a + len(lines)]) if k] for (_, lines), a in zip(pages, start.tolist())]


def content_lines(df: DataFrame, record: str = "record_id", url: str = "url", body: str = "body", model: Model | None = None, threshold: float = 0.5) -> DataFrame:
    """(record, line_no) of the lines that belong to the article itself; one map step without a shuffle."""
    m = model or Model.load()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scorer = Scorer(m)
        for b in slices(batches):
            ids, nos = [], []
            got = content_of(b.column(1).to_pylist(), b.column(2).to_pylist(), m, threshold, scorer)
            for r, lines in zip(b.column(0).to_pylist(), got):
                if r is not None:
                    ids.extend([r] * len(lines))
                    nos.extend([i for i, _ in lines])
            yield pa.RecordBatch.from_arrays([pa.array(ids, kind), pa.array(nos, pa.int64())], names=[record, "line_no"])

    pages = df.select(record, url, body)
    kind = to_arrow_type(pages.schema[0].dataType)
    return spread(pages, record).mapInArrow(run, f"`{record}` {pages.dtypes[0][1]}, line_no long")
