"""Periodic runs of words: suffix-tree LCE over Lyndon roots.

A run is a stretch of words with smallest period q that holds at least max(LEAST, FOLD * q) words and
that no neighbouring word extends. Each document is a sequence of word numbers, and the documents of
an Arrow slice are worked on together:

1. Every 5 neighbouring words inside a run stand again q words away, and q is at most a quarter of
   the run. Stretches in which every 5-gram has an equal one so near are found by sorting hashes,
   until nothing more falls away; all else can't lie in a run. No run is lost (a hash collision only
   leaves more), and a document without repeats costs one sort.
2. The stretches, each closed by a separator of its own, are one string. Ukkonen trees of it and of
   its reversal, with Euler tours and range minima over them, give the longest common extension of
   two places to the right and to the left in constant time.
3. The longest Lyndon word at each place, for the order of the words and for the reversed one, comes
   from the next smaller suffix by the tree's leaf order. Each is a candidate root [i, j) of period
   j - i: extended in both directions it is a run if it is long enough. Every run has a root of this
   kind, and a Lyndon word has no smaller period.

Defined results: a null or empty text has no words and no run; overlapping runs of different periods
are all reported; repeated rows and ties are treated each on its own; a null doc_id is kept as null;
an empty table gives an empty table; further columns are not read. A task holds one slice of texts,
or one longer text alone with about 500 bytes for each word of its periodic stretches.
"""

from __future__ import annotations

import zlib
from collections.abc import Callable

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import slices, table
from .textvec import U, mix

#: Least length of a run, and least number of its periods.
LEAST, FOLD = 6, 4
#: Neighbouring words that a run must repeat: LEAST - 1, and at most (FOLD - 1) * q from q = 2 on.
GRAM = 5
SCHEMA = "doc_id bigint, n_words bigint, runs array<struct<start:bigint,length:bigint,period:bigint>>, collapsed string"


def stretches(words: np.ndarray, doc: np.ndarray) -> list[tuple[int, int]]:
    """Bounds of the stretches that can hold runs. words: numbers, with a number of its own at each
    document's end; doc: the document of each place."""
    m = len(words) - GRAM + 1
    if m < 2:
        return []
    g = words[:m].astype(U)
    for j in range(1, GRAM):
        g = g * U(0x9DDFEA08EB382D69) + words[j : j + m].astype(U)
    g = mix(g)
    at, part, size = np.arange(m), doc[:m], np.bincount(doc)[doc[:m]]
    while len(at):
        key = mix(g[at] ^ (part.astype(U) * U(0xD6E8FEB86659FD93)))
        order = np.argsort(key, kind="stable")  # equal keys stay in the order of their places
        gap = np.where(key[order][1:] == key[order][:-1], np.diff(at[order]), len(words))
        near = np.full(len(at), len(words))
        near[order[1:]] = gap
        near[order[:-1]] = np.minimum(near[order[:-1]], gap)
        keep = near * FOLD <= size
        if keep.all():
            break
        at = at[keep]
        part = np.cumsum(np.diff(at, prepend=at[:1]) != 1)
        size = np.bincount(part)[part] + GRAM - 1 if len(at) else at
        long = size >= LEAST
        at, part, size = at[long], part[long], size[long]
    if not len(at):
        return []
    edge = np.flatnonzero(np.diff(at) != 1)
    first, last = np.concatenate((at[:1], at[edge + 1])), np.concatenate((at[edge], at[-1:]))
    return list(zip(first.tolist(), (last + GRAM).tolist(), strict=True))


class SuffixTree:
    """Ukkonen's tree of a list of numbers whose last one occurs once, with an Euler tour for longest
    common extensions."""

    #: Tour entries in a block; within blocks running minima answer, over blocks a sparse table.
    BLOCK = 16

    def __init__(self, s: list[int]):
        self.n = len(s)
        self.wide = max(s) + 1
        self._grow(s)
        self._sort_children()
        self._tour()

    def _grow(self, s: list[int]) -> None:
        n, wide = self.n, self.wide
        start, end, link, edge = [0], [0], [0], {}
        node = at = length = todo = 0
        for i, c in enumerate(s):
            todo += 1
            last = 0
            while todo:
                if not length:
                    at = i
                key = node * wide + s[at]
                child = edge.get(key)
                if child is None:
                    edge[key] = len(start)
                    start.append(i)
                    end.append(n)
                    link.append(0)
                    if last:
                        link[last] = node
                        last = 0
                else:
                    begin, stop = start[child], end[child]
                    if stop > i:
                        stop = i + 1
                    if length >= stop - begin:
                        at += stop - begin
                        length -= stop - begin
                        node = child
                        continue
                    if s[begin + length] == c:
                        length += 1
                        if last:
                            link[last] = node
                        break
                    middle = len(start)
                    start += (begin, i)
                    end += (begin + length, n)
                    link += (0, 0)
                    edge[key] = middle
                    edge[middle * wide + c] = middle + 1
                    start[child] = begin + length
                    edge[middle * wide + s[begin + length]] = child
                    if last:
                        link[last] = middle
                    last = middle
                todo -= 1
                if node:
                    node = link[node]
                elif length:
                    length -= 1
                    at = i - todo + 1
        keys = np.fromiter(edge.keys(), np.int64, len(edge))
        self.child = np.fromiter(edge.values(), np.int64, len(edge))
        self.parent, self.symbol = keys // wide, keys % wide
        self.length = np.array(end) - np.array(start)

    def _sort_children(self) -> None:
        order = np.lexsort((self.symbol, self.parent))
        self.child, self.parent, self.symbol = self.child[order], self.parent[order], self.symbol[order]

    def _bounds(self, parent: np.ndarray) -> tuple[list[int], list[int]]:
        nodes = np.arange(len(self.length))
        return np.searchsorted(parent, nodes).tolist(), np.searchsorted(parent, nodes, side="right").tolist()

    def _tour(self) -> None:
        nxt, stop = self._bounds(self.parent)
        child, length = self.child.tolist(), self.length.tolist()
        depth, up, first, tour, leaves = [0] * len(length), [0] * len(length), [0] * self.n, [0], []
        node = 0
        while True:
            p = nxt[node]
            if p < stop[node]:
                nxt[node] = p + 1
                c = child[p]
                d = depth[node] + length[c]
                if nxt[c] == stop[c]:  # a leaf; its suffix starts so far from the end
                    first[self.n - d] = len(tour)
                    leaves.append(self.n - d)
                    tour += (d, depth[node])
                else:
                    depth[c] = d
                    up[c] = node
                    tour.append(d)
                    node = c
            elif node:
                node = up[node]
                tour.append(depth[node])
            else:
                break
        self.first = np.array(first)
        self.rank = np.empty(self.n, np.int64)
        self.rank[leaves] = np.arange(self.n)
        self._minima(np.array(tour, np.int32))

    def _minima(self, tour: np.ndarray) -> None:
        b = self.BLOCK
        flat = np.full(-(-len(tour) // b) * b, np.iinfo(np.int32).max, np.int32)
        flat[: len(tour)] = tour
        rows = flat.reshape(-1, b)
        self.flat = flat
        self.to_left = np.minimum.accumulate(rows, axis=1).ravel()
        self.to_right = np.minimum.accumulate(rows[:, ::-1], axis=1)[:, ::-1].ravel()
        level = rows.min(axis=1)
        self.table = [level]
        while 2 * (1 << (len(self.table) - 1)) <= len(rows):
            half = 1 << (len(self.table) - 1)
            level = np.minimum(level[:-half], level[half:])
            self.table.append(level)

    def extension(self, i: np.ndarray, j: np.ndarray) -> np.ndarray:
        """Longest common prefix of the suffixes at i and j, which differ."""
        b = self.BLOCK
        x, y = self.first[i], self.first[j]
        x, y = np.minimum(x, y), np.maximum(x, y)
        bx, by = x // b, y // b
        out = np.minimum(self.to_right[x], self.to_left[y])
        inner = by - bx - 1
        far = np.flatnonzero(inner > 0)
        level = np.frexp(inner[far])[1] - 1  # floor of the binary logarithm
        for k in np.unique(level):
            some = far[level == k]
            t = self.table[k]
            out[some] = np.minimum(out[some], np.minimum(t[bx[some] + 1], t[by[some] - (1 << int(k))]))
        same = np.flatnonzero(bx == by)
        if len(same):
            low = self.flat[x[same]]
            for step in range(1, b):
                low = np.minimum(low, self.flat[np.minimum(x[same] + step, y[same])])
            out[same] = low
        return out

    def ranks(self, order: np.ndarray) -> np.ndarray:
        """Ranks of the suffixes if symbols compare by these numbers."""
        by = np.lexsort((order[self.symbol], self.parent))
        child, length = self.child[by].tolist(), self.length.tolist()
        begin, stop = self._bounds(self.parent[by])
        rank, starts, stack = np.empty(self.n, np.int64), [], [(0, 0)]
        while stack:
            node, d = stack.pop()
            if begin[node] == stop[node]:
                starts.append(self.n - d)
            else:
                stack += [(c, d + length[c]) for c in child[begin[node] : stop[node]][::-1]]
        rank[starts] = np.arange(self.n)
        return rank


def next_smaller(rank: np.ndarray) -> np.ndarray:
    """For each place the next one whose suffix is smaller (the length, if none)."""
    r, n = rank.tolist(), len(rank)
    out = [n] * n
    for i in range(n - 2, -1, -1):
        j, own = i + 1, r[i]
        while j < n and r[j] > own:
            j = out[j]
        out[i] = j
    return np.array(out)


def runs_of(s: np.ndarray, n_ends: int) -> np.ndarray:
    """(start, end, period) of all runs in a string. Numbers below n_ends occur once, and a run can't
    hold them; the last number is one of them."""
    n = len(s)
    right, left = SuffixTree(s.tolist()), SuffixTree([*s[:-1][::-1].tolist(), int(s[-1])])
    order = np.arange(int(s.max()) + 1)
    order[n_ends:] = order[n_ends:][::-1].copy()  # ends stay the smallest in both orders
    found = []
    for rank in (right.rank, right.ranks(order)):
        j = next_smaller(rank)
        i = np.flatnonzero((s >= n_ends) & (j < n))
        j = j[i]
        q = j - i
        more = right.extension(i, j)
        # the reversal without its end: place x stands at n - 2 - x; nothing stands before place 0
        inside = i > 0
        back = np.zeros(len(i), np.int64)
        back[inside] = left.extension(n - 2 - (i[inside] - 1), n - 2 - (j[inside] - 1))
        start, end = i - back, j + more
        long = end - start >= np.maximum(LEAST, FOLD * q)
        found.append(np.column_stack((start, end, q))[long])
    return np.unique(np.concatenate(found), axis=0)


def slice_runs(documents: list[list[bytes]]) -> list[np.ndarray]:
    """(start, length, period) of each document's runs, by start, then period."""
    out = [np.zeros((0, 3), np.int64)] * len(documents)
    sizes = np.array([len(d) for d in documents])
    if not sizes.sum():
        return out
    known = {}
    for words in documents:
        known.update(dict.fromkeys(words))
    number = dict(zip(known, range(len(known)), strict=True)).__getitem__
    first = np.concatenate(([0], np.cumsum(sizes + 1)))
    words = np.empty(first[-1], np.int64)
    for d, own in enumerate(documents):
        words[first[d] : first[d] + len(own)] = np.fromiter(map(number, own), np.int64, len(own))
    words[first[1:] - 1] = len(known) + np.arange(len(documents))
    doc = np.repeat(np.arange(len(documents)), sizes + 1)
    parts = stretches(words, doc)
    if not parts:
        return out
    # ends get the small numbers, words those after them
    string, place, ends = [], [], len(parts)
    for e, (a, b) in enumerate(parts):
        string += [words[a:b], [-1 - e]]
        place += [np.arange(a, b), [b]]
    string, place = np.concatenate(string), np.concatenate(place)
    values, dense = np.unique(string, return_inverse=True)  # the negative ends come first
    found = runs_of(dense, ends)
    start = place[found[:, 0]]
    d = doc[start]
    rows = np.column_stack((start - first[d], found[:, 1] - found[:, 0], found[:, 2]))
    rows, d = rows[np.lexsort((found[:, 2], start))], np.sort(d)
    for i in np.unique(d):
        out[i] = rows[d == i]
    return out


def collapse(words: list[bytes], runs: np.ndarray) -> list[bytes]:
    """The words but for those that a run holds after its first period."""
    if not len(runs):
        return words
    cover = np.zeros(len(words) + 1, np.int64)
    np.add.at(cover, runs[:, 0] + runs[:, 2], 1)
    np.add.at(cover, runs[:, 0] + runs[:, 1], -1)
    return [words[i] for i in np.flatnonzero(np.cumsum(cover)[:-1] == 0)]


def periodic_runs(documents: DataFrame, edit: Callable[[int | None, list[bytes]], list[bytes]] | None = None) -> DataFrame:
    """(doc_id, n_words, runs, collapsed): the runs of every text, and the text without repeated periods.
    edit: changes a document's words before."""

    def run(batches):
        for batch, texts in slices(batches, "text"):
            words = [t.split() for t in texts]  # bytes part at the six characters of the contract only
            ids = batch.column(0).to_pylist()
            if edit:
                words = [edit(i, w) for i, w in zip(ids, words, strict=True)]
            found = slice_runs(words)
            flat = np.concatenate(found) if found else np.zeros((0, 3), np.int64)
            offsets = np.concatenate(([0], np.cumsum([len(r) for r in found]))).astype(np.int32)
            structs = pa.StructArray.from_arrays([pa.array(flat[:, k], pa.int64()) for k in range(3)], ["start", "length", "period"])
            kept = pa.array([b" ".join(collapse(w, r)) for w, r in zip(words, found, strict=True)], pa.large_binary())
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array([len(w) for w in words], pa.int64()), pa.ListArray.from_arrays(pa.array(offsets), structs), kept.cast(pa.large_string()).cast(pa.string())],
                ["doc_id", "n_words", "runs", "collapsed"],
            )

    return documents.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(run, SCHEMA)


def planted(doc_id: int | None, words: list[bytes]) -> list[bytes]:
    """The contract's periodic ends: in one of ten documents, by its id, the words from one on repeat."""
    h = 1 if doc_id is None else zlib.crc32(str(doc_id).encode())
    if h % 10 or not words:
        return words
    g, n = h // 10, len(words)
    a = g % n
    p = 1 + (n - a) // (3 + g % 8)
    return words[:a] + (words[a : a + p] * (-(-(n - a) // p)))[: n - a]


def op11_periodic_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = periodic_runs(table(spark, sf_dir, "documents", "doc_id", "text"), planted)
    line = lambda r: F.concat_ws(",", r["start"], r["length"], r["period"])
    longest = F.array_max(F.transform("runs", lambda r: F.struct(r["length"].alias("length"), (-r["start"]).alias("start"), (-r["period"]).alias("period"))))
    return found.withColumn("top", longest).select(
        "doc_id", F.size("runs").cast("long").alias("n_runs"), (-F.col("top.start")).alias("start"), "top.length", (-F.col("top.period")).alias("period"),
        F.expr("(1000 * top.length) div -top.period").alias("exponent_milli"),
        F.sha2(F.array_join(F.transform("runs", lambda r: F.concat(line(r), F.lit("\n"))), ""), 256).alias("runs_sha256"), F.sha2("collapsed", 256).alias("collapsed_sha256"),
    )
