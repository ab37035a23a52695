"""Near-duplicate records by parity-sketch join (problem 2).

A record is the set of its runs of three successive words. Runs are hashed; the
XOR of the hashes of a set is its parity sketch: runs that both sets hold cancel, so
the Hamming distance of two sketches never exceeds the symmetric difference of the
sets. A similarity of at least s bounds that difference by (|A|+|B|)(1-s)/(1+s).

1. Candidates by pigeonhole on part sketches. A set is first brought to a sample of
   fixed size: at each place the run that is least under the place's own hash, so two
   sets agree at a place with probability equal to their similarity, whatever their
   sizes, and one cut into parts serves every size band. The parity sketch of the
   sample is cut into parts of ``PART`` places (each place is in ``SHARED`` parts, by
   different dealings), and sets that agree in a part - the XOR of its hashes - are
   candidates. With fewer differing places than parts of a dealing one part must be free
   of differences; beyond that a part is free with probability s^PART, and ``n_groups``
   takes so many that the computed share of pairs lost just at the threshold is under
   ``MISS``. Unlike sets of one domain share runs too and agree in a part by chance, and
   such pairs grow with the square of the number of sets. So a key carries its set's mark,
   a few bits of each of the turn's places, and where sets meet only pairs go on whose
   marks differ in no more bits than pairs at the threshold do (but for ``STRAY`` of
   them, which other turns' places still find; ``lost`` counts it in). What is written and
   shuffled thus follows the pairs that are near. ``candidates="prefix"`` loses none at all: the runs of
   every set are put in one order, rare ones first, and sets are joined by the first
   runs that a common run can be among (``first_runs``); its work grows with the square
   of a run's frequency.
2. Candidates must pass the Hamming bound on ``bits``-bit parity sketches of the whole
   sets, which loses no pair.
3. The rest is verified on the sets.

Exact copies (equal sets, by a 128-bit hash) form a class; classes are compared by one
set each, so a group of copies costs one set however large it is. ``near_pairs``
expands classes to pairs of records, ``near_classes`` gives each record its class and
number of links to other classes. Sets are made once and travel apart from the rows
(record, class), which are only counted and joined; joins on a hot class are left to
adaptive skew handling, which can split them, as the class side is one row.

Defined results: records without text (null, empty, fewer than three words) match
nothing; a repeated record id counts once per different set and never pairs with itself;
no pair is dropped by a cap.
"""

from __future__ import annotations

import math
import re
from collections.abc import Callable, Iterator
from functools import lru_cache, partial, reduce

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type

from ..session import cut, parallelism, spread
from .batches import slices
from .canon import canon
from .content import Model, Scorer, content_of

WORD = re.compile(r"[^\W_]+")
RANK_BITS = 20
#: Sampled places in a part, and how many parts a place takes part in; the share of pairs just at the threshold that the parts may lose.
PART, SHARED, MISS = 5, 2, 1e-6
#: Parts are joined in so many rounds, each cut before the next, so that not all keys lie on disk at once.
ROUNDS = 12
#: Words of a mark, its bits at most (their number fits a byte), and the share of pairs just at the threshold that marks may part in one round.
MARK, MARK_BITS, STRAY = 4, 255, 0.05
#: Sets of one key that meet in the task that sorts it; keys of more sets meet in a join, which can be split.
HOT = 2_000
#: Keys that are sorted at once, about, and that travel in one row, at most.
PIECE, PACK = 500_000, 512
#: Runs of several sets that are hashed at once; they stay in the cache.
_RUNS = 1 << 16
_U = np.uint64


def mix(k: np.ndarray) -> np.ndarray:
    k = (k ^ (k >> _U(33))) * _U(0xFF51AFD7ED558CCD)
    k = (k ^ (k >> _U(33))) * _U(0xC4CEB9FE1A85EC53)
    return k ^ (k >> _U(33))


#: Characters that are hashed at once.
_CELLS = 1 << 17
#: An odd factor and its inverse modulo 2^64.
_FACTOR = 0x9E3779B97F4A7C15
_BACK = pow(_FACTOR, -1, 1 << 64)


class Words:
    """64-bit hashes of all words (runs of letters and digits) of texts, by array operations.

    A word's hash is the sum of its characters' hashes times powers of a factor, taken
    from running sums over the whole text and brought to the word's own beginning.
    """

    def __init__(self):
        self.known = np.zeros(0, _U)

    def _grow(self, n: int) -> None:
        self.up, self.down = np.full(n + 1, _FACTOR, _U), np.full(n + 1, _BACK, _U)
        for x in (self.up, self.down):
            x[0] = 1
            np.multiply.accumulate(x, out=x)

    def _table(self, top: int) -> None:
        """Hashes of characters up to a code point; 0 for what stands between words."""
        n = max(1 << 14, 1 << (top + 1).bit_length())
        word = np.fromiter((WORD.match(chr(i)) is not None for i in range(n)), bool, n)
        self.known = np.where(word, mix(np.arange(n, dtype=_U) + _U(1)) | _U(1), _U(0))

    def of(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """(hashes of all words, number of words of each text)."""
        n = np.zeros(len(texts), np.int64)
        out, held, size, first = [], [], 0, 0
        for k, t in enumerate(texts):
            if len(t) > _CELLS:
                out.append(self._some(held, n, first))
                for piece in self._pieces(t):
                    m = np.zeros(1, np.int64)
                    out.append(self._some([piece], m, 0))
                    n[k] += m[0]
                held, size, first = [], 0, k + 1
                continue
            held.append(t)
            size += len(t) + 1
            if size > _CELLS:
                out.append(self._some(held, n, first))
                held, size, first = [], 0, k + 1
        out.append(self._some(held, n, first))
        return np.concatenate(out), n

    def _pieces(self, t: str) -> Iterator[str]:
        """A very long text cut between words."""
        at = 0
        while at < len(t):
            e = at + _CELLS
            while e < len(t) and WORD.match(t[e]):
                e += 1
            yield t[at:e]
            at = e

    def _some(self, texts: list[str], n: np.ndarray, first: int) -> np.ndarray:
        if not texts:
            return np.zeros(0, _U)
        cp = np.frombuffer(("\n".join(texts) + "\n").encode("utf-32-le", "surrogatepass"), "<u4")
        if (top := int(cp.max())) >= len(self.known):
            self._table(top)
        h = self.known[cp]
        word = h != 0
        edge = np.flatnonzero(word[1:] != word[:-1]) + 1
        if word[0]:
            edge = np.concatenate([[0], edge])
        start, end = edge[::2], edge[1::2]
        if len(cp) >= len(getattr(self, "up", ())):
            self._grow(len(cp))
        sums = np.concatenate([np.zeros(1, _U), np.cumsum(h * self.up[: len(h)])])
        ends = np.cumsum([len(t) + 1 for t in texts])
        n[first : first + len(texts)] = np.diff(np.searchsorted(start, ends), prepend=0)
        return mix((sums[end] - sums[start]) * self.down[start] + (end - start).astype(_U))


def runs(texts: list[str], words: Words, size: int = 3) -> list[np.ndarray]:
    """The sorted set of 32-bit hashes of the runs of ``size`` words of each text."""
    h, n = words.of([t.lower() for t in texts])
    if len(h) < size:
        return [np.zeros(0, np.uint32) for _ in texts]
    k = np.zeros(len(h) - size + 1, dtype=_U)
    for i in range(size):
        k = mix(k + h[i : len(h) - size + 1 + i])
    k = (k >> _U(32)).astype(np.uint32)
    out, at = [], 0
    for m in n.tolist():
        out.append(np.unique(k[at : at + m - size + 1]) if m >= size else np.zeros(0, np.uint32))
        at += m
    return out


def binomial(n: int, p: float) -> np.ndarray:
    if not 0 < p < 1:
        return (np.arange(n + 1) == (n if p >= 1 else 0)).astype(np.float64)
    return np.array([math.exp(math.lgamma(n + 1) - math.lgamma(k + 1) - math.lgamma(n - k + 1) + k * math.log(p) + (n - k) * math.log1p(-p)) for k in range(n + 1)])


def mark_shape(places: int) -> tuple[int, int]:
    """(places that a mark is taken from, bits of each)."""
    return min(places, MARK_BITS), min(64, max(1, MARK_BITS // places))


@lru_cache(maxsize=256)
def mark_limit(similarity: float, places: int) -> tuple[int, float]:
    """(bits in which the marks of a pair may differ, share of pairs of the similarity that this parts).

    Places that agree have equal bits; each bit of the others differs by even chance.
    """
    m, bits = mark_shape(places)
    differ = np.zeros(m * bits + 1)
    for agree, p in enumerate(binomial(m, similarity)):
        n = (m - agree) * bits
        differ[: n + 1] += p * binomial(n, 0.5)
    beyond = 1 - np.cumsum(differ)
    limit = int(np.argmax(beyond <= STRAY))
    return limit, max(0.0, float(beyond[limit]))


def lost(similarity: float, groups: int) -> float:
    """The share of pairs of a similarity that ``groups`` x ``SHARED`` parts in ``ROUNDS`` rounds lose, at most.

    Each round deals its places out to parts ``SHARED`` times, so parts of different
    dealings overlap by chance only; given the number of places that agree, parts agree as
    good as independently. A round also loses what marks part; more places that agree make
    both rarer, so the product of the shares is a bound. Rounds have places of their own.
    """
    groups //= ROUNDS
    t = groups * PART
    k = np.arange(t + 1, dtype=np.float64)
    one = np.ones(t + 1)
    for r in range(PART):
        one *= np.maximum(k - r, 0) / (t - r)
    apart = float((binomial(t, similarity) * (1 - one) ** (groups * SHARED)).sum())
    return (apart + (1 - apart) * mark_limit(similarity, t)[1]) ** ROUNDS


@lru_cache(maxsize=64)
def n_groups(similarity: float, miss: float = MISS) -> int:
    """The least number of groups of ``PART`` places, a multiple of ``ROUNDS``, that loses no more than ``miss``."""
    if similarity >= 1:
        return ROUNDS
    groups = ROUNDS
    while lost(similarity, groups) > miss:
        groups += ROUNDS
    return groups


def part_sketches(sets: list[np.ndarray], similarity: float, turn: int = 0, turns: int = 1) -> tuple[np.ndarray, np.ndarray]:
    """(index of the set, key) of all parts of the sampled sets' parity sketches, or of those of one turn's places."""
    return marked_parts(sets, similarity, turn, turns)[:2]


def marked_parts(sets: list[np.ndarray], similarity: float, turn: int, turns: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """``part_sketches`` and, for each key, the mark of its set at the turn's places."""
    groups = n_groups(similarity) // turns
    t = groups * PART
    full = [i for i, s in enumerate(sets) if len(s)]
    places = np.arange(turn * t + 1, (turn + 1) * t + 1, dtype=_U)
    factors = (mix(places * _U(0x9E3779B97F4A7C15)) >> _U(32)).astype(np.uint32) | np.uint32(1)
    sample = np.empty((t, len(full)), np.uint32)
    first = np.concatenate([[0], np.cumsum([len(sets[i]) for i in full], dtype=np.int64)])
    lo = 0
    while lo < len(full):
        e = max(lo + 1, int(np.searchsorted(first, first[lo] + _RUNS, side="right")) - 1)
        flat, start = np.concatenate([sets[i] for i in full[lo:e]]), first[lo:e] - first[lo]
        turned = np.empty_like(flat)
        for j in range(t):
            np.minimum.reduceat(np.multiply(flat, factors[j], out=turned), start, out=sample[j, lo:e])
        lo = e
    hashed = mix(sample.T.astype(_U, order="C") + (places << _U(32)))
    keys = []
    for d in range(SHARED):
        # A dealing by a fixed order of the turn's places; the first is the natural one.
        order = np.argsort(mix(places + _U(d << 40)), kind="stable") if d else np.arange(t)
        part = np.bitwise_xor.reduce(hashed[:, order].reshape(len(full), groups, PART), axis=2)
        keys.append(mix(part + _U(d)))
    keys = np.concatenate(keys, axis=1)
    m, bits = mark_shape(t)
    flags = np.zeros((len(full), 64 * MARK), np.uint8)
    flags[:, : m * bits] = ((hashed[:, :m, None] >> np.arange(bits, dtype=_U)) & _U(1)).reshape(len(full), m * bits)
    marks = np.packbits(flags, axis=1).view(_U)
    return np.tile(np.array(full, dtype=np.int64), keys.shape[1]), keys.T.ravel(), np.tile(marks, (keys.shape[1], 1))


def packed(keys: np.ndarray, c: np.ndarray, pieces: int, marks: np.ndarray | None = None) -> pa.RecordBatch:
    """Rows (piece, keys, sets, and marks where there are some) of keys by their piece, at most ``PACK`` in a row."""
    p = (keys % _U(pieces)).astype(np.uint16 if pieces <= 1 << 16 else np.int32)
    order = np.argsort(p, kind="stable")
    p, keys, c = p[order], keys[order], c[order]
    start = np.flatnonzero(np.concatenate([[True], p[1:] != p[:-1]])) if len(p) else np.zeros(0, np.int64)
    cuts = [x for a, e in zip(start.tolist(), [*start[1:].tolist(), len(p)]) for x in range(a, e, PACK)]
    rows = list(zip(cuts, [*cuts[1:], len(p)]))
    held = {"keys": keys, "sets": c} | ({} if marks is None else {"marks": marks[order]})
    return pa.RecordBatch.from_arrays([pa.array(p[cuts].astype(np.int32)), *(pa.array([x[a:e].tobytes() for a, e in rows], pa.binary()) for x in held.values())], names=["piece", *held])


#: Places of a key's list of sets that are compared at once; such arrays stay in the cache.
_STEP = 1 << 14


def meet(batches: Iterator[pa.RecordBatch], hot: int = HOT, most: int = 1_000_000, room: int = 1_500_000, limit: int = MARK_BITS) -> Iterator[pa.RecordBatch]:
    """Packed rows in order of piece to pairs (a, b) of sets of one key, with marks those that differ in ``limit`` bits at most; the sets of keys that more than ``hot`` of them have go on as (key, a, mark).

    A piece is held whole, but where it goes beyond ``room`` its hot keys go on at once.
    """
    names = ["key", "a", "b", *(f"m{j}" for j in range(MARK))]

    def told_apart(x: np.ndarray, y: np.ndarray) -> pa.RecordBatch:
        x, y = np.minimum(x, y), np.maximum(x, y)
        order = np.lexsort((y, x))
        x, y = x[order], y[order]
        new = np.concatenate([[True], (x[1:] != x[:-1]) | (y[1:] != y[:-1])])[: len(x)] & (x != y)
        n = int(new.sum())
        return pa.RecordBatch.from_arrays([pa.nulls(n, pa.int64()), pa.array(x[new]), pa.array(y[new]), *[pa.nulls(n, pa.int64())] * MARK], names=names)

    def pairs(c: np.ndarray, m: np.ndarray | None, start: np.ndarray, end: np.ndarray) -> Iterator[pa.RecordBatch]:
        size = end - start
        many = np.flatnonzero(size > 1)
        many = many[np.argsort(-size[many], kind="stable")]
        size = size[many]
        ends = np.cumsum(size)
        i = np.repeat(start[many] - ends + size, size) + np.arange(int(size.sum()))
        c, own = c[i], np.repeat(np.arange(len(many), dtype=np.int32), size)
        words = [] if m is None else [np.ascontiguousarray(m[i, j]) for j in range(MARK)]
        left, right, held = [], [], 0
        # Keys of many sets come first: at each distance the keys that still have two sets so far apart are the first rows.
        for d in range(1, int(size[0]) if len(size) else 0):
            top = int(ends[np.searchsorted(-size, -d) - 1]) - d
            for lo in range(0, top, _STEP):
                e = min(top, lo + _STEP)
                hit = own[lo:e] == own[lo + d : e + d]
                if words:
                    differ = np.bitwise_count(words[0][lo:e] ^ words[0][lo + d : e + d])
                    for w in words[1:]:
                        differ += np.bitwise_count(w[lo:e] ^ w[lo + d : e + d])
                    hit &= differ <= limit
                at = np.flatnonzero(hit) + lo
                if len(at):
                    left.append(c[at])
                    right.append(c[at + d])
                    held += len(at)
                if held >= most:
                    yield told_apart(np.concatenate(left), np.concatenate(right))
                    left, right, held = [], [], 0
        if held:
            yield told_apart(np.concatenate(left), np.concatenate(right))

    def go_on(key: np.ndarray, c: np.ndarray, m: np.ndarray | None) -> pa.RecordBatch:
        marks = [pa.nulls(len(c), pa.int64()) if m is None else pa.array(m[:, j].view(np.int64)) for j in range(MARK)]
        return pa.RecordBatch.from_arrays([pa.array(key), pa.array(c), pa.nulls(len(c), pa.int64()), *marks], names=names)

    piece, keys, sets, marks, size, most_held = None, [], [], [], 0, room
    burning: set[int] = set()

    def settle(end: bool) -> Iterator[pa.RecordBatch]:
        """Hot keys go on; at the end of a piece the other ones' pairs are made, before it they stay."""
        nonlocal keys, sets, marks, size, most_held
        if not keys:
            return
        k, c = np.frombuffer(b"".join(keys), np.int64), np.frombuffer(b"".join(sets), np.int64)
        m = np.frombuffer(b"".join(marks), _U).reshape(-1, MARK) if marks else None
        order = np.argsort(k)
        k, c = k[order], c[order]
        start = np.flatnonzero(np.concatenate([[True], k[1:] != k[:-1]]))
        stop = np.append(start[1:], len(k))
        big = stop - start > hot
        if burning:
            big |= np.isin(k[start], np.array(list(burning)))
        rows = np.repeat(big, stop - start)
        at = lambda x: None if m is None else m[order[x]]
        if big.any():
            burning.update(k[start[big]].tolist())
            yield go_on(k[rows], c[rows], at(rows))
        if end:
            keys, sets, marks, size, most_held = [], [], [], 0, room
            yield from pairs(c, at(slice(None)), start[~big], stop[~big])
            burning.clear()
        else:
            keys, sets, size = [k[~rows].tobytes()], [c[~rows].tobytes()], int((~rows).sum())
            marks = [] if m is None else [at(~rows).tobytes()]
            most_held = max(room, 2 * size)

    for b in batches:
        columns = [b.column(j).to_pylist() for j in range(b.num_columns)]
        for p, k, c, *m in zip(*columns):
            if p != piece:
                yield from settle(True)
                piece = p
            keys.append(k)
            sets.append(c)
            marks += m
            size += len(k) // 8
            if size > most_held:
                yield from settle(False)
    yield from settle(True)


def run_ranks(reps: DataFrame) -> np.ndarray:
    """Logarithmic counts of runs by the upper ``RANK_BITS`` bits of their hash: a table of fixed size.

    It only says which runs come first; candidates are whole under any order.
    """
    block = 1 << 12

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        c = np.zeros(1 << RANK_BITS, np.uint32)
        for b in batches:
            flat = np.frombuffer(b"".join(b.column(0).to_pylist()), np.uint32)
            c += np.bincount(flat >> np.uint32(32 - RANK_BITS), minlength=1 << RANK_BITS).astype(np.uint32)
        rows = [(k, x.tobytes()) for k, x in enumerate(c.reshape(-1, block)) if x.any()]
        yield pa.RecordBatch.from_arrays([pa.array([k for k, _ in rows], pa.int32()), pa.array([x for _, x in rows], pa.binary())], names=["block", "counts"])

    def unite(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total: dict[int, np.ndarray] = {}
        for b in batches:
            for k, x in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
                total[k] = total.get(k, 0) + np.frombuffer(x, np.uint32).astype(np.uint64)
        rows = [(k, np.minimum(np.round(8 * np.log2(x + 1.0)), 255).astype(np.uint8).tobytes()) for k, x in total.items()]
        yield pa.RecordBatch.from_arrays([pa.array([k for k, _ in rows], pa.int32()), pa.array([x for _, x in rows], pa.binary())], names=["block", "ranks"])

    ranks = np.zeros(1 << RANK_BITS, np.uint8)
    for k, x in reps.select("runs").mapInArrow(count, "block int, counts binary").repartition("block").mapInArrow(unite, "block int, ranks binary").collect():
        ranks[k * block : (k + 1) * block] = np.frombuffer(x, np.uint8)
    return ranks


def first_runs(sets: list[np.ndarray], similarity: float, ranks: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(index of the set, run, place in the order) of the runs at which a similar set can share its first run.

    Sets at least ``similarity`` alike share s/(1+s) of |A|+|B| runs, so at least s|A|;
    their first common run has that many runs of A from it on.
    """
    n = np.array([len(s) for s in sets], dtype=np.int64)
    flat = np.concatenate(sets) if len(sets) else np.zeros(0, np.uint32)
    owner = np.repeat(np.arange(len(sets)), n)
    order = np.lexsort((flat, ranks[flat >> np.uint32(32 - RANK_BITS)], owner))
    place = np.arange(len(flat)) - np.repeat(np.cumsum(n) - n, n)
    use = n[owner] - place >= similarity * n[owner] - 1e-6
    return owner[use], flat[order][use], place[use]


def bit_sketch(s: np.ndarray, bits: int) -> bytes:
    """Parity of the number of runs at each of ``bits`` places."""
    c = np.bincount((mix(s.astype(_U)) % _U(bits)).astype(np.int64), minlength=bits) & 1
    return np.packbits(c.astype(np.uint8)).tobytes()


def main_sets(df: DataFrame, record: str, url: str | None, body: str, size: int = 3, model: Model | None = None) -> tuple[DataFrame, DataFrame]:
    """(rec, c1, c2) of the records that have main text, and (c1, c2, n, runs), one row for each class (c1, c2) of equal sets.

    Without ``url`` the whole text is the main text. Of copies within a task only the
    first carries its set.
    """
    m = model or Model.load()

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scorer, words, seen = Scorer(m), Words(), set()
        for b in slices(batches):
            if url is None:
                texts = [canon(x) or "" for x in b.column(2).to_pylist()]
            else:
                texts = ["\n".join(s for _, s in lines) for lines in content_of(b.column(1).to_pylist(), b.column(2).to_pylist(), m, 0.5, scorer)]
            sets = runs(texts, words, size)
            ids, names, sizes, held = [], [], [], []
            for r, s in zip(b.column(0).to_pylist(), sets):
                if r is None or not len(s):
                    continue
                x = s.tobytes()
                c = xxhash.xxh3_128_digest(x)
                ids.append(r)
                names.append(c)
                sizes.append(len(s))
                held.append(None if c in seen else x)
                seen.add(c)
            if len(seen) > 200_000:
                seen.clear()
            c = np.frombuffer(b"".join(names), np.int64).reshape(-1, 2)
            yield pa.RecordBatch.from_arrays([pa.array(ids, kind), pa.array(c[:, 0]), pa.array(c[:, 1]), pa.array(sizes, pa.int32()), pa.array(held, pa.binary())], names=["rec", "c1", "c2", "n", "runs"])

    rows = df.select(F.col(record).alias("rec"), F.lit(None).cast("string").alias("url") if url is None else F.col(url).alias("url"), F.col(body).alias("body"))
    kind = to_arrow_type(rows.schema["rec"].dataType)
    rows = cut(spread(rows, "rec").mapInArrow(read, f"rec {dict(rows.dtypes)['rec']}, c1 long, c2 long, n int, runs binary"), "parity-rows")
    with_set = rows.where("runs is not null")
    owner = with_set.groupBy("c1", "c2").agg(F.min("rec").alias("rec"))
    sets = with_set.join(owner, ["c1", "c2", "rec"], "left_semi")
    return rows.select("rec", "c1", "c2"), cut(sets.select("c1", "c2", "n", "runs"), "parity-sets")


def class_links(sets: DataFrame, similarity: float = 0.5, bits: int = 1024, candidates: str = "parts") -> DataFrame:
    """(c1_a, c2_a, c1_b, c2_b, n_common, similarity) of classes of equal sets, each pair once; ``sets`` is the second result of ``main_sets``."""

    def sketch(turn: int) -> Callable:
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for b in slices(batches, 1000):
                s = [np.frombuffer(x, np.uint32) for x in b.column(1).to_pylist()]
                who, keys, marks = marked_parts(s, similarity, turn, ROUNDS)
                yield packed(keys, b.column(0).to_numpy()[who], pieces, marks)

        return run

    def met(turn: int) -> DataFrame:
        keys = sets.select("c1", "runs").mapInArrow(sketch(turn), "piece int, keys binary, sets binary, marks binary")
        return cut(keys.repartitionById(tasks, F.col("piece")).sortWithinPartitions("piece").mapInArrow(partial(meet, limit=limit), "key long, a long, b long, " + ", ".join(f"m{j} long" for j in range(MARK))), "parity-met")

    limit = mark_limit(similarity, n_groups(similarity) // ROUNDS * PART)[0]
    # Keys travel packed by pieces of about PIECE keys, so that few and larger rows are shuffled and sorted.
    pieces = max(2 * parallelism(sets.sparkSession), sets.count() * n_groups(similarity) * SHARED // ROUNDS // PIECE)
    tasks = min(pieces, max(2 * parallelism(sets.sparkSession), int(sets.sparkSession.conf.get("spark.sql.shuffle.partitions"))))

    def first(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in slices(batches, 300):
            s = [np.frombuffer(x, np.uint32) for x in b.column(1).to_pylist()]
            who, run, place = first_runs(s, similarity, ranks)
            n = np.array([len(x) for x in s], dtype=np.int32)
            yield pa.RecordBatch.from_arrays([pa.array(run.view(np.int32)), pa.array(b.column(0).to_numpy()[who]), pa.array(n[who]), pa.array(place.astype(np.int32))], names=["key", "c", "n", "place"])

    if candidates == "prefix":
        ranks = run_ranks(sets)
        keys = sets.select("c1", "runs").mapInArrow(first, "key int, c long, n int, place int")
        a, b = (keys.select("key", F.col("c").alias(x), F.col("n").alias(f"n_{x}"), F.col("place").alias(f"at_{x}")) for x in "ab")
        left_over = F.least(F.col("n_a") - F.col("at_a"), F.col("n_b") - F.col("at_b"))
        pairs = a.join(b, "key").where("a < b").where(left_over * (1 + similarity) >= (F.col("n_a") + F.col("n_b")) * similarity - 1e-6)
        pairs = cut(pairs.select("a", "b").distinct(), "parity-pairs")
    else:
        got = reduce(DataFrame.unionByName, [met(k) for k in range(ROUNDS)])
        hot = got.where("b is null").drop("b")
        differ = reduce(lambda x, y: x + y, [F.bit_count(F.col(f"m{j}").bitwiseXOR(F.col(f"o{j}"))) for j in range(MARK)])
        across = hot.join(hot.select("key", F.col("a").alias("b"), *(F.col(f"m{j}").alias(f"o{j}") for j in range(MARK))), "key").where(F.col("a") < F.col("b")).where(differ <= limit).select("a", "b")
        pairs = got.where("b is not null").select("a", "b").unionByName(across).distinct()

    @F.pandas_udf("binary")
    def sketched(x: pd.Series) -> pd.Series:
        return x.map(lambda r: bit_sketch(np.frombuffer(r, np.uint32), bits))

    small = sets.select(F.col("c1").alias("c"), "n", sketched("runs").alias("sketch"))
    left, right = (small.select(F.col("c").alias(x), F.col("n").alias(f"n_{x}"), F.col("sketch").alias(f"s_{x}")) for x in "ab")

    @F.pandas_udf("int")
    def hamming(x: pd.Series, y: pd.Series) -> pd.Series:
        if not len(x):
            return pd.Series([], dtype="int32")
        p = np.frombuffer(b"".join(x), np.uint8) ^ np.frombuffer(b"".join(y), np.uint8)
        return pd.Series(np.bitwise_count(p.reshape(len(x), -1)).sum(axis=1).astype(np.int32))

    bound = (1 - similarity) / (1 + similarity)
    sized = pairs.join(left, "a").join(right, "b").where(F.least("n_a", "n_b") >= F.greatest("n_a", "n_b") * F.lit(similarity))
    near = sized.withColumn("d", hamming("s_a", "s_b")).where(F.col("d") <= (F.col("n_a") + F.col("n_b")) * F.lit(bound))
    near = cut(near.select("a", "b").distinct(), "parity-near")
    left, right = (sets.select(F.col("c1").alias(x), F.col("c1").alias(f"c1_{x}"), F.col("c2").alias(f"c2_{x}"), F.col("runs").alias(f"r_{x}")) for x in "ab")

    @F.pandas_udf("int")
    def common(x: pd.Series, y: pd.Series) -> pd.Series:
        return pd.Series([len(np.intersect1d(np.frombuffer(p, np.uint32), np.frombuffer(q, np.uint32), assume_unique=True)) for p, q in zip(x, y)], dtype="int32")

    both = near.join(left, "a").join(right, "b").withColumn("n_common", common("r_a", "r_b"))
    both = both.withColumn("similarity", F.col("n_common") / (F.octet_length("r_a") / 4 + F.octet_length("r_b") / 4 - F.col("n_common")))
    both = both.where(F.col("similarity") >= similarity).select("c1_a", "c2_a", "c1_b", "c2_b", "n_common", "similarity")
    return both.dropDuplicates(["c1_a", "c2_a", "c1_b", "c2_b"])


def near_pairs(df: DataFrame, record: str = "record_id", url: str | None = "url", body: str = "body", similarity: float = 0.5, size: int = 3, **how) -> DataFrame:
    """All pairs (record_a < record_b) at least ``similarity`` alike, each once, copies expanded; the work of the last join is the result's size."""
    rows, sets = main_sets(df, record, url, body, size)
    links = cut(class_links(sets, similarity, **how).select("c1_a", "c2_a", "c1_b", "c2_b"), "parity-links")
    mem = rows.distinct()
    a = mem.select(F.col("rec").alias("x"), F.col("c1").alias("c1_a"), F.col("c2").alias("c2_a"))
    b = mem.select(F.col("rec").alias("y"), F.col("c1").alias("c1_b"), F.col("c2").alias("c2_b"))
    across = links.join(a, ["c1_a", "c2_a"]).join(b, ["c1_b", "c2_b"]).where("x <> y")
    copied = mem.groupBy("c1", "c2").agg(F.count("*").alias("k")).where("k > 1").select("c1", "c2")
    inside = mem.join(copied, ["c1", "c2"], "left_semi")
    inside = inside.withColumnRenamed("rec", "x").join(inside.withColumnRenamed("rec", "y"), ["c1", "c2"]).where("x < y")
    pairs = across.select("x", "y").unionByName(inside.select("x", "y"))
    return pairs.select(F.least("x", "y").alias("record_a"), F.greatest("x", "y").alias("record_b")).distinct()


def near_classes(df: DataFrame, record: str = "record_id", url: str | None = "url", body: str = "body", similarity: float = 0.5, size: int = 3, **how) -> DataFrame:
    """(record, class_id, n_links): class of equal main text, named by its least record, and its number of links to other classes."""
    rows, sets = main_sets(df, record, url, body, size)
    links = class_links(sets, similarity, **how)
    ends = F.explode(F.array(F.struct(F.col("c1_a").alias("c1"), F.col("c2_a").alias("c2")), F.struct(F.col("c1_b").alias("c1"), F.col("c2_b").alias("c2"))))
    ends = links.select(ends.alias("e")).groupBy("e.c1", "e.c2").agg(F.count("*").alias("n_links"))
    classes = rows.groupBy("c1", "c2").agg(F.min("rec").alias("class_id")).join(ends, ["c1", "c2"], "left")
    out = rows.distinct().join(classes, ["c1", "c2"])
    return out.select(F.col("rec").alias(record), "class_id", F.coalesce("n_links", F.lit(0)).alias("n_links"))
