"""SentencePiece encoding and decoding by suffix-array matching.

The texts of a batch are cut into words, and the distinct words that the cache doesn't hold are
concatenated into one text of at most `STRETCH` characters at a time (a longer word goes alone). Its
suffix array is built by prefix doubling up to the longest piece, and a binary search for every piece
of the vocabulary gives its range of occurrences: an edge (position, length, rank) for each. The
edges are sorted by position and length, and relaxed over the symbols until none joins any more.

The public model is a byte-pair model, whose ids a best-path search over the edges doesn't give: on
the documents of sf0.001, 35,082 of 75,835 words would get other pieces. Relaxing therefore takes
edges in order of rank, then position: an edge holds if two neighbouring symbols make it up. Words
of up to `LONG` characters take one edge each in common rounds, longer ones theirs from a heap, in
n log n steps. A piece reaches over white space only as
a run of it, so words are independent, and a bounded cache keeps those seen before.

Defined results: a null or empty text has no pieces; characters outside the vocabulary become
byte pieces; repeated rows are encoded alike; an empty table gives an empty table; other columns
are not read. round_trip is false only if the text itself holds the model's space mark.
"""

from __future__ import annotations

import heapq
import re
import sys
import zlib
from bisect import bisect_left

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import slices, table

MARK = "▁"
#: Bytes that the cache of words may hold, and bytes of text that are worked on at once.
CACHE, SLICE = 192 << 20, 6 << 20
#: Characters that are indexed at once, and from how many on a word is relaxed for itself.
STRETCH, LONG = 1 << 20, 64
NO_RANK = np.int32(2**31 - 1)
_models: dict[str, Model] = {}
_WORD = re.compile(f"{MARK}+[^{MARK}]*|[^{MARK}]+")


class Model:
    def __init__(self, path: str):
        import sentencepiece

        sp = sentencepiece.SentencePieceProcessor(model_file=path)
        n = sp.get_piece_size()
        plain = [i for i in range(n) if not (sp.is_byte(i) or sp.is_control(i) or sp.is_unknown(i) or sp.is_unused(i))]
        self.id_of = {sp.id_to_piece(i): i for i in plain}
        self.byte_id = {int(sp.id_to_piece(i)[3:5], 16): i for i in range(n) if sp.is_byte(i)}
        self.raw = [b""] * n
        for piece, i in self.id_of.items():
            self.raw[i] = piece.replace(MARK, " ").encode()
        for b, i in self.byte_id.items():
            self.raw[i] = bytes([b])
        joined = sorted((p for p in self.id_of if len(p) > 1), key=lambda p: -sp.get_score(self.id_of[p]))
        self.longest = max(map(len, joined))
        self.length = np.array([len(p) for p in joined])
        self.letters = np.zeros((len(joined), self.longest), np.uint32)
        for r, p in enumerate(joined):
            self.letters[r, : len(p)] = [ord(c) for c in p]
        self.cache: dict[str, bytes] = {}
        self.held = 0  # its bytes, about

    def suffixes(self, text: np.ndarray) -> np.ndarray:
        """Starts of all suffixes in the order of their first `longest` characters."""
        rank = np.unique(text, return_inverse=True)[1].astype(np.int64) + 1
        n, step = len(text), 1
        while True:
            behind = np.zeros(n, np.int64)
            behind[:-step] = rank[step:]
            key = rank * (rank.max() + 1) + behind
            order = np.argsort(key, kind="stable")
            new = np.zeros(n, np.int64)
            new[order] = np.cumsum(np.diff(key[order], prepend=-1) != 0)
            rank, step = new, 2 * step
            if step >= self.longest or rank.max() == n or step >= n:
                return order

    def ranges(self, text: np.ndarray, order: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """For each piece, the range of the suffixes that start with it."""
        padded = np.concatenate((text, np.zeros(self.longest, np.uint32)))

        def search(upper):
            lo, hi = np.zeros(len(self.length), np.int64), np.full(len(self.length), len(order), np.int64)
            while True:
                open_ = np.flatnonzero(lo < hi)
                if not len(open_):
                    return lo
                mid = (lo[open_] + hi[open_]) // 2
                start = order[mid]
                sign = np.zeros(len(open_), np.int8)
                left = np.arange(len(open_))
                for d in range(self.longest):
                    left = left[(sign[left] == 0) & (self.length[open_[left]] > d)]
                    if not len(left):
                        break
                    a, b = padded[start[left] + d], self.letters[open_[left], d]
                    sign[left] = np.where(a < b, -1, np.where(a > b, 1, 0))
                below = sign < 0 if not upper else sign <= 0
                lo[open_[below]] = mid[below] + 1
                hi[open_[~below]] = mid[~below]

        return search(False), search(True)

    def edges(self, text: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The occurrences of all pieces, sorted by position and length, with their ranks."""
        order = self.suffixes(text)
        lo, hi = self.ranges(text, order)
        count = hi - lo
        place = np.repeat(lo, count) + np.arange(count.sum()) - np.repeat(np.cumsum(count) - count, count)
        keys = order[place] * (self.longest + 1) + np.repeat(self.length, count)
        by = np.argsort(keys)
        return keys[by], np.repeat(np.arange(len(count), dtype=np.int32), count)[by]

    def joins(self, edges, at: np.ndarray, length: np.ndarray) -> np.ndarray:
        """The rank of the edge of that length at each position, NO_RANK without one."""
        keys, ranks = edges
        if not len(keys):
            return np.full(len(at), NO_RANK)
        key = at * (self.longest + 1) + length
        i = np.minimum(np.searchsorted(keys, key), len(keys) - 1)
        return np.where((length <= self.longest) & (keys[i] == key), ranks[i], NO_RANK)

    def relax_words(self, text: np.ndarray, edges, size: np.ndarray, alive: np.ndarray, word: np.ndarray) -> None:
        """In each round every word takes the leftmost edge of its best rank; at most LONG rounds."""
        n = len(text)
        while len(alive):
            nxt = np.minimum(alive + size[alive], n - 1)
            joined = size[alive] + np.where(text[nxt] != 0, size[nxt], self.longest)
            rank = self.joins(edges, alive, joined)
            group = np.cumsum(np.diff(word, prepend=-1) != 0) - 1
            best = np.minimum.reduceat(rank, np.flatnonzero(np.diff(word, prepend=-1)))
            hit = np.flatnonzero((rank == best[group]) & (rank != NO_RANK))
            if not len(hit):
                return
            hit = hit[np.diff(group[hit], prepend=-1) != 0]
            gone = np.zeros(len(alive), bool)
            gone[hit + 1] = True
            size[alive[hit]] = joined[hit]
            size[alive[hit + 1]] = 0
            changed = np.zeros(len(best), bool)
            changed[group[hit]] = True
            left = changed[group] & ~gone
            alive, word = alive[left], word[left]

    def relax_long(self, edges, size: np.ndarray, start: int, stop: int) -> None:
        """One word of any length: its edges by rank, then position, from a heap."""
        keys, ranks = edges
        m = stop - start
        sizes, before, after = [1] * m, list(range(-1, m - 1)), list(range(1, m + 1))
        at = np.arange(start, stop - 1)
        first = self.joins(edges, at, np.full(m - 1, 2))
        heap = [(r, i, 1, 1) for i, r in enumerate(first.tolist()) if r != NO_RANK]
        heapq.heapify(heap)

        def offer(i, j):
            length = sizes[i] + sizes[j]
            if length <= self.longest:
                key = (start + i) * (self.longest + 1) + length
                k = bisect_left(keys, key)
                if k < len(keys) and keys[k] == key:
                    heapq.heappush(heap, (int(ranks[k]), i, sizes[i], sizes[j]))

        while heap:
            _, i, a, b = heapq.heappop(heap)
            j = after[i]
            if sizes[i] != a or j >= m or sizes[j] != b:
                continue  # one of the two has been joined since
            sizes[i], sizes[j] = a + b, 0
            after[i] = j = after[j]
            if j < m:
                before[j] = i
                offer(i, j)
            if before[i] >= 0:
                offer(before[i], i)
        size[start:stop] = sizes

    def solve(self, words: list[str]) -> None:
        """Put the ids of new words into the cache, a stretch of them at a time."""
        some: list[str] = []
        held = 0
        for w in words:
            if some and held + len(w) > STRETCH:
                self.solve_stretch(some)
                some, held = [], 0
            some.append(w)
            held += len(w) + 1
        if some:
            self.solve_stretch(some)

    def solve_stretch(self, words: list[str]) -> None:
        text = np.frombuffer("\n".join([*words, ""]).encode("utf-32-le"), np.uint32).copy()
        lengths = np.array([len(w) for w in words])
        ends = np.cumsum(lengths + 1)
        text[ends - 1] = 0  # ends a word and is in no piece
        edges = self.edges(text)
        size = np.ones(len(text), np.int32)  # of the symbol that starts here
        alive = np.flatnonzero(text != 0)
        word = np.searchsorted(ends, alive, side="right")
        short = lengths[word] <= LONG
        self.relax_words(text, edges, size, alive[short], word[short])
        for i in np.flatnonzero(lengths > LONG).tolist():
            self.relax_long(edges, size, int(ends[i] - 1 - lengths[i]), int(ends[i] - 1))
        at = 0
        sizes = size.tolist()
        for w in words:
            ids: list[int] = []
            i, stop = at, at + len(w)
            while i < stop:
                piece = w[i - at : i - at + sizes[i]]
                known = self.id_of.get(piece)
                ids += [known] if known is not None else [self.byte_id[b] for b in piece.encode()]
                i += sizes[i]
            self.cache[w] = np.array(ids, "<u4").tobytes()
            at = stop + 1

    def encode(self, texts: list[str]) -> list[np.ndarray]:
        split, new = [], set()
        for t in texts:
            if not t:
                split.append([])
                continue
            words = t.split(" ")
            if MARK in t or "" in words:
                words = _WORD.findall(MARK + t.replace(" ", MARK))
            else:
                words = [MARK + w for w in words]
            split.append(words)
            new.update(words)
        if self.held > CACHE:
            self.cache.clear()
            self.held = 0
        new = [w for w in new if w not in self.cache]
        self.solve(new)
        out = [np.frombuffer(b"".join(map(self.cache.__getitem__, words)), "<u4") for words in split]
        for w in new:
            if len(w) > LONG:  # in text without spaces a word is a paragraph, which does not come again
                del self.cache[w]
            else:
                self.held += sys.getsizeof(w) + len(self.cache[w]) + 150
        return out

    def decode(self, ids: np.ndarray) -> str:
        out = b"".join(map(self.raw.__getitem__, ids.tolist())).decode("utf-8", "replace")
        return out[1:] if out.startswith(" ") else out


def model(path: str | None) -> Model:
    if path is None:
        import public_tokenizers

        path = public_tokenizers.path("piece_bpe_32k.model")
    if path not in _models:
        _models[path] = Model(path)
    return _models[path]


def encode(documents: DataFrame, vocabulary: str | None = None) -> DataFrame:
    """doc_id and ids of every document."""

    def run(batches):
        m = model(vocabulary)
        for batch, texts in slices(batches, "text", SLICE):
            ids = m.encode([t.decode("utf-8", "replace") for t in texts])
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([x.astype(np.int32) for x in ids], pa.list_(pa.int32()))], ["doc_id", "ids"])

    return documents.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(run, "doc_id long, ids array<int>")


def decode(pieces: DataFrame, vocabulary: str | None = None) -> DataFrame:
    """doc_id and text from doc_id and ids."""

    def run(batches):
        m = model(vocabulary)
        for batch in batches:
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([m.decode(np.array(x or [], np.int64)) for x in batch.column(1).to_pylist()], pa.string())], ["doc_id", "text"])

    return pieces.select("doc_id", "ids").mapInArrow(run, "doc_id long, text string")


def op2_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, n_pieces, ids_crc32 and round_trip (decoding gives the text again) of every document."""

    def run(batches):
        m = model(None)
        for batch, raw in slices(batches, "text", SLICE):
            texts = [t.decode("utf-8", "replace") for t in raw]
            ids = m.encode(texts)
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column(0), pa.array([len(x) for x in ids], pa.int64()), pa.array([zlib.crc32(x) for x in ids], pa.int64()),
                    pa.array([m.decode(x) == t for x, t in zip(ids, texts, strict=True)]),
                ],
                ["doc_id", "n_pieces", "ids_crc32", "round_trip"],
            )

    rows = table(spark, sf_dir, "documents", "doc_id", "text").select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    return rows.mapInArrow(run, "doc_id long, n_pieces long, ids_crc32 long, round_trip boolean")
