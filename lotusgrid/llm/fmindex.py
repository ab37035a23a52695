"""Evaluation passages inside training text (problem 7).

Every stretch of training text that a task reads (a shard) gets a word-level
FM-index: Burrows-Wheeler transform of the word ids, wavelet matrix for ranks, and
suffix positions sampled every ``SAMPLE`` places of the text. All windows of
``length`` words of the evaluation items are searched backward at once, one
vectorised step per word; occurrences are located by LF steps to the next sample;
hits of one item in one document are merged to spans.

Words that no item uses cannot be part of a passage: they become one separator, and
runs of item words shorter than ``length`` are left out of the index, which loses
nothing. Separators are pairwise different, so no match crosses a gap or a
document.

Defined results: null or empty text holds nothing; items shorter than ``length``
words cannot leak; repeated documents count for themselves; a very long document is
indexed whole, in overlapping shards.
"""

from __future__ import annotations

import re
import unicodedata
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type

from ..session import spread
from .batches import slices

SAMPLE = 16
_WORD = re.compile(r"[^\W_]+")
_ODD = re.compile("[^\\t\\n -~\\xa0-\\xff\\u0100-\\u01ff\\u1ea0-\\u1ef9\\u2010-\\u2027]")


def words(text: str | None) -> list[str]:
    """Runs of letters and digits, in composed form and lower case."""
    if not text:
        return []
    if _ODD.search(text):
        text = unicodedata.normalize("NFC", text)
    return _WORD.findall(text.lower())


class Wavelet:
    """Wavelet matrix over small integers: rank of a symbol before a place."""

    def __init__(self, a: np.ndarray, bits: int):
        self.bits, self.n = bits, len(a)
        self.ranks, self.zeros = [], []
        for b in range(bits - 1, -1, -1):
            bit = (a >> b) & 1
            self.ranks.append(np.concatenate([[0], np.cumsum(bit, dtype=np.int32)]).astype(np.int32))
            self.zeros.append(int(self.n - self.ranks[-1][-1]))
            a = np.concatenate([a[bit == 0], a[bit == 1]])
        self.starts: dict[int, int] = {}

    def rank(self, symbol: np.ndarray, at: np.ndarray) -> np.ndarray:
        """How often each symbol stands before each place."""
        lo, hi = np.zeros_like(at), at.copy()
        for k, b in enumerate(range(self.bits - 1, -1, -1)):
            ones, bit = self.ranks[k], (symbol >> b) & 1
            l1, h1 = ones[lo], ones[hi]
            lo = np.where(bit, self.zeros[k] + l1, lo - l1)
            hi = np.where(bit, self.zeros[k] + h1, hi - h1)
        return hi - lo

    def access(self, at: np.ndarray) -> np.ndarray:
        """The symbols at places."""
        at, out = at.copy(), np.zeros_like(at)
        for k in range(self.bits):
            ones = self.ranks[k]
            bit = ones[at + 1] - ones[at]
            out = (out << 1) | bit
            at = np.where(bit, self.zeros[k] + ones[at], at - ones[at])
        return out


def suffix_array(a: np.ndarray) -> np.ndarray:
    """Suffix array by prefix doubling; separators (negative) are different from each other."""
    n = len(a)
    rank = np.unique(a, return_inverse=True)[1].astype(np.int64)
    k = 1
    while True:
        second = np.full(n, -1, np.int64)
        second[: n - k] = rank[k:]
        key = rank * (n + 1) + second + 1
        order = np.argsort(key, kind="stable")
        s = key[order]
        new = np.empty(n, np.int64)
        new[order] = np.cumsum(np.concatenate([[0], (s[1:] != s[:-1]).astype(np.int64)]))
        rank, k = new, 2 * k
        if k >= n or new[order[-1]] == n - 1:
            return order


class FMIndex:
    """FM-index of a sequence of word ids from 1; 0 stands for separators."""

    def __init__(self, seq: np.ndarray, alphabet: int):
        sep = seq == 0
        distinct = seq.astype(np.int64)
        distinct[sep] = -np.arange(1, int(sep.sum()) + 1)
        sa = suffix_array(distinct)
        self.n = len(seq)
        bwt = seq[sa - 1].astype(np.int64)
        self.wave = Wavelet(bwt, max(1, int(alphabet).bit_length()))
        counts = np.bincount(seq, minlength=alphabet + 1)
        self.first = np.concatenate([[0], np.cumsum(counts)])
        # The first word of a stretch is sampled too: separators are ordered among themselves by place, so an LF step must not cross one.
        marked = (sa % SAMPLE == 0) | (bwt == 0)
        self.marked = np.concatenate([[0], np.cumsum(marked)])
        self.samples = sa[marked]
        self.is_marked = marked

    def search(self, patterns: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Row ranges of equally long patterns (one a row), by backward search."""
        lo = np.zeros(len(patterns), np.int64)
        hi = np.full(len(patterns), self.n, np.int64)
        for k in range(patterns.shape[1] - 1, -1, -1):
            c = patterns[:, k].astype(np.int64)
            lo = self.first[c] + self.wave.rank(c, lo)
            hi = self.first[c] + self.wave.rank(c, hi)
            hi = np.maximum(lo, hi)
        return lo, hi

    def locate(self, rows: np.ndarray) -> np.ndarray:
        """Text positions of rows, stepping back to the next sampled one."""
        at, steps = rows.copy(), np.zeros(len(rows), np.int64)
        out = np.full(len(rows), -1, np.int64)
        open_ = np.arange(len(rows))
        while len(open_):
            hit = self.is_marked[at[open_]]
            done = open_[hit]
            out[done] = self.samples[self.marked[at[done]]] + steps[done]
            open_ = open_[~hit]
            if not len(open_):
                break
            c = self.wave.access(at[open_])
            at[open_] = self.first[c] + self.wave.rank(c, at[open_])
            steps[open_] += 1
        return out


class Items:
    """The evaluation items: vocabulary and all distinct windows of ``length`` words."""

    def __init__(self, rows: list[tuple[int, str]], length: int):
        self.length = length
        split = [(i, w) for i, t in rows if len(w := words(t)) >= length]
        self.vocabulary = {w: k for k, w in enumerate(sorted({x for _, w in split for x in w}), 1)}
        seen: dict[tuple, int] = {}
        owners: list[set[int]] = []
        for i, w in split:
            ids = [self.vocabulary[x] for x in w]
            for s in range(len(ids) - length + 1):
                k = tuple(ids[s : s + length])
                if k not in seen:
                    seen[k] = len(owners)
                    owners.append(set())
                owners[seen[k]].add(i)
        self.windows = np.array(list(seen), dtype=np.int32).reshape(len(seen), length)
        self.owners = [sorted(o) for o in owners]


def shard_spans(docs: list[tuple[int, list[np.ndarray], list[int]]], items: Items) -> list[tuple[int, int, int, int]]:
    """(document's place in ``docs``, item, first word, end) of merged spans in one shard."""
    seqs, owner, offset = [np.zeros(1, np.int32)], [np.full(1, -1)], [np.zeros(1, np.int64)]
    gap = np.zeros(1, np.int32)
    for d, (_, stretches, starts) in enumerate(docs):
        for s, a in zip(stretches, starts):
            seqs += [s, gap]
            owner += [np.full(len(s), d), np.full(1, -1)]
            offset += [np.arange(a, a + len(s)), np.zeros(1, np.int64)]
    seq = np.concatenate(seqs)
    if len(seq) < items.length or not len(items.windows):
        return []
    owner, offset = np.concatenate(owner), np.concatenate(offset)
    index = FMIndex(seq, len(items.vocabulary))
    lo, hi = index.search(items.windows)
    n = hi - lo
    hit = np.flatnonzero(n)
    if not len(hit):
        return []
    which = np.repeat(hit, n[hit])
    rows = np.concatenate([np.arange(lo[k], hi[k]) for k in hit])
    at = index.locate(rows)
    found: dict[tuple[int, int], list[int]] = {}
    for w, p in zip(which.tolist(), at.tolist()):
        for i in items.owners[w]:
            found.setdefault((int(owner[p]), i), []).append(int(offset[p]))
    out = []
    for (d, i), ps in found.items():
        ps.sort()
        a, e = ps[0], ps[0] + items.length
        for p in ps[1:]:
            if p > e:
                out.append((d, i, a, e))
                a = p
            e = max(e, p + items.length)
        out.append((d, i, a, e))
    return out


def merged(spans: list[tuple[int, int, int]]) -> list[tuple[int, int, int]]:
    """Spans (item, first word, end) with those of one item that touch made one."""
    out: list[tuple[int, int, int]] = []
    for i, a, e in sorted(spans):
        if out and out[-1][0] == i and a <= out[-1][2]:
            out[-1] = (i, out[-1][1], max(e, out[-1][2]))
        else:
            out.append((i, a, e))
    return out


def stretches(ids: np.ndarray, length: int, most: int) -> Iterator[tuple[np.ndarray, int]]:
    """(word ids, first word) of the runs of at least ``length`` item words; longer ones than ``most`` in pieces that overlap by length - 1."""
    edge = np.concatenate([[-1], np.flatnonzero(ids == 0), [len(ids)]])
    for k in np.flatnonzero(np.diff(edge) > length).tolist():
        a, e = int(edge[k]) + 1, int(edge[k + 1])
        for s in range(a, max(a + 1, e - length + 1), most):
            yield ids[s : min(e, s + most + length - 1)], s


def leak_spans(docs: DataFrame, items: DataFrame, doc_id: str = "doc_id", text: str = "text", item_id: str = "item_id", item_text: str = "text", length: int = 12, max_item_rows: int = 1_000_000, max_item_bytes: int = 64 << 20, shard_words: int = 1_000_000) -> DataFrame:
    """(doc_id, item_id, first_word, end_word) of leaked passages, words counted from 0.

    The items are a stated query set and are read to the driver; more than
    ``max_item_rows`` of them, or more text than ``max_item_bytes``, is an error, to be
    met by calling in blocks. A shard holds about ``shard_words`` item words; a longer
    document is cut into several, which overlap by length - 1 words.
    """
    items = items.select(F.col(item_id).alias("i"), F.col(item_text).alias("t")).where("i is not null and t is not null")
    n, size = items.agg(F.count("*"), F.sum(F.octet_length("t"))).first()
    if n > max_item_rows or (size or 0) > max_item_bytes:
        raise ValueError(f"{n} items of {size} bytes, more than {max_item_rows} or {max_item_bytes} bytes: search them in blocks")
    it = Items([(r[0], r[1]) for r in items.collect()], length)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        get, held, size = it.vocabulary.get, [], 0

        def flush() -> list[tuple[int, int, int, int]]:
            nonlocal held, size
            got = [(held[d][0], *s) for d, *s in shard_spans(held, it)]
            held, size = [], 0
            return got

        def rows(spans: list[tuple[int, int, int, int]]) -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array([s[k] for s in spans], kinds[k]) for k in range(4)], names=[doc_id, "item_id", "first_word", "end_word"])

        for b in slices(batches):
            for r, t in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
                if r is None or not t:
                    continue
                ids = np.array([get(w, 0) for w in words(t)], dtype=np.int32)
                cut = int(np.count_nonzero(ids)) > shard_words
                if cut and held:
                    yield rows(flush())
                own: list[tuple[int, int, int, int]] = []
                arrays, starts = [], []
                for a, s in stretches(ids, it.length, shard_words):
                    arrays.append(a)
                    starts.append(s)
                    size += len(a) + 1
                    if cut and size >= shard_words:
                        held.append((r, arrays, starts))
                        own += flush()
                        arrays, starts = [], []
                if arrays:
                    held.append((r, arrays, starts))
                if cut:
                    own += flush() if held else []
                    yield rows([(r, *s) for s in merged([s[1:] for s in own])])
            if size >= shard_words:
                yield rows(flush())
        if held:
            yield rows(flush())

    docs = docs.select(doc_id, text)
    kinds = [to_arrow_type(docs.schema[0].dataType), to_arrow_type(items.schema[0].dataType), pa.int64(), pa.int64()]
    return spread(docs, doc_id).mapInArrow(run, f"`{doc_id}` {docs.dtypes[0][1]}, item_id {items.dtypes[0][1]}, first_word long, end_word long")


def leaks(docs: DataFrame, items: DataFrame, **how) -> DataFrame:
    """(doc_id, item_id): which document holds a passage of which item."""
    return leak_spans(docs, items, **how).select("doc_id", "item_id").distinct()
