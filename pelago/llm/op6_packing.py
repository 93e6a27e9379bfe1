"""Order-preserving packing of token streams into sequences of at most 1024 tokens.

Each partition is one stream of documents in their stored order; nothing is shuffled. A dynamic
programme over cut places (document ends, sentence ends, and a grid where none lies within a sequence)
minimises padding plus truncation penalties plus a cost per sequence. A window of L tokens pads
1024 - L unless L is a power of two, so f[j] = penalty[j] + 1024 - j + min(f[i] + i) over the last
1024 positions, kept in a monotone queue, besides eleven direct transitions for powers of two.
Blocks of about `BLOCK` tokens bound the memory; the open end of a block is carried into the next.

Defined results: a null or empty text is the single id 0; repeated rows are packed each for
itself; the string of an added token, as in "<|endoftext|>", becomes that token, as the library has
it; an empty table gives an empty table; other columns are not read. A sequence id is the
partition's number times 2**40 plus the place in the partition, so a repeated task gives the same.
"""

from __future__ import annotations

import os
import sys
import zlib
from collections import deque

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import slices, table

SEQUENCE, END_ID = 1024, 0
#: Cost of a cut at a sentence end, of one elsewhere inside a document, and of a sequence.
SENTENCE_CUT, INNER_CUT, EACH = 2, 24, 12
BLOCK, CARRY, GRID = 1 << 16, 4096, 256
#: Bytes that a cache of words may hold, and the longest word that goes into it (in text without spaces
#: a word is a paragraph, which does not come again).
CACHE, LONG = 96 << 20, 64
#: Sentence ends are cut places if they lie at least so many tokens apart.
SPACING = 8
#: How the byte-level vocabulary writes a space, a line feed, and white space at all.
SPACE, LINE_FEED, WHITE = "\u0120", "\u010a", "\u0120\u010a\u0109\u010d"
#: White space but for the space and the line feed: all of it, and what of it is ASCII.
OTHER_SPACE = [c for c in map(chr, range(0x3001)) if c.isspace() and c not in " \n"]
ASCII_SPACE = [c for c in OTHER_SPACE if c.isascii()]
_encoders: dict[str, Encoder] = {}


class Encoder:
    """Byte-level BPE ids of whole texts, with a bounded cache of white-space separated words.

    A token never spans from a character into following white space, so a text whose words are
    set apart by single spaces or line feeds is the concatenation of its words' ids.
    """

    def __init__(self, vocabulary: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"  # a task has one core
        from tokenizers import Tokenizer

        self.bpe = Tokenizer.from_file(vocabulary)
        tokens = self.bpe.get_vocab(with_added_tokens=True)
        size = max(tokens.values()) + 1
        self.spaced, self.ends = np.zeros(size, bool), np.zeros(size, bool)
        for token, i in tokens.items():
            self.spaced[i] = token.startswith(SPACE)
            self.ends[i] = token.rstrip(WHITE)[-1:] in (".", "!", "?") or token.endswith(LINE_FEED)
        #: Tokens that the library takes out of a text before it splits words.
        self.added = [t.content for t in self.bpe.get_added_tokens_decoder().values()]
        self.inner: dict[str, bytes] = {}
        self.first: dict[str, bytes] = {}
        self.held = [0, 0]  # bytes of the two, about
        self.line_feed = self.whole("\n")

    def batch(self, texts: list[str]) -> list[np.ndarray]:
        return [np.array(e.ids, "<u4") for e in self.bpe.encode_batch_fast(texts, add_special_tokens=False)]

    def whole(self, text: str) -> bytes:
        return self.batch([text])[0].tobytes()

    def learn(self, words: set[str], heads: set[str]) -> None:
        """Put the ids of words behind a space, and of words that begin a line, into the caches."""
        if words:
            listed = list(words)
            ids = self.batch([" " + " ".join(listed)])[0]
            at = np.flatnonzero(self.spaced[ids])
            raw, cuts = ids.tobytes(), [*(at * 4).tolist(), len(ids) * 4]
            for i, w in enumerate(listed):
                self.inner[w] = raw[cuts[i] : cuts[i + 1]]
            self.held[0] += len(raw) + sum(map(sys.getsizeof, listed)) + 150 * len(listed)
        listed = list(heads)
        for w, ids in zip(listed, self.batch(listed), strict=True):
            self.first[w] = ids.tobytes()
            self.held[1] += sys.getsizeof(w) + ids.nbytes + 150

    def simple(self, text: str) -> bool:
        """Words set apart by one space or line feed each, no other white space of any kind, no added token."""
        if not text or text[0] in " \n" or text[-1] in " \n" or any(x in text for x in ("  ", " \n", "\n ", "\n\n", *self.added)):
            return False
        return not any(c in text for c in (ASCII_SPACE if text.isascii() else OTHER_SPACE))

    def encode(self, texts: list[bytes]) -> list[bytes]:
        """Ids as little-endian 32-bit words, the closing id included."""
        plain, missing, heads = [], set(), set()
        for i, known in enumerate((self.inner, self.first)):
            if self.held[i] > CACHE:
                known.clear()
                self.held[i] = 0
        for raw in texts:
            text = raw.decode("utf-8", "replace")
            if not self.simple(text):
                plain.append(text)
                continue
            lines = [line.split(" ") for line in text.split("\n")]
            plain.append(lines)
            for line in lines:
                missing.update(line[1:])
                heads.add(line[0])
        missing, heads = missing.difference(self.inner), heads.difference(self.first)
        self.learn(missing, heads)
        end, out = np.array([END_ID], "<u4").tobytes(), []
        for lines in plain:
            if isinstance(lines, str):
                out.append(self.whole(lines) + end)
                continue
            parts = []
            for line in lines:
                parts.append(b"".join((self.first[line[0]], *map(self.inner.__getitem__, line[1:]))))
            out.append(self.line_feed.join(parts) + end)
        for i, (known, new) in enumerate(((self.inner, missing), (self.first, heads))):
            for w in new:
                if len(w) > LONG:
                    self.held[i] -= sys.getsizeof(w) + len(known.pop(w)) + 150
        return out


def encoder(vocabulary: str) -> Encoder:
    if vocabulary not in _encoders:
        _encoders[vocabulary] = Encoder(vocabulary)
    return _encoders[vocabulary]


def cut_places(ids: np.ndarray, doc_ends: np.ndarray, sentence_end: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Positions where a window may end, 0 included, and the penalty of each: the ends of documents and of
    sentences, and where two of those are more than a sequence apart a grid between them."""
    cost = np.full(len(ids) + 1, -1, np.int64)
    at = np.flatnonzero(sentence_end[ids]) + 1
    if len(at):
        cost[at[np.diff(at // SPACING, prepend=-1) > 0]] = SENTENCE_CUT
    cost[doc_ends] = 0
    cost[0] = cost[len(ids)] = 0
    places = np.flatnonzero(cost >= 0)
    wide = np.flatnonzero(np.diff(places) > SEQUENCE)
    if len(wide):
        for a, b in zip(places[wide].tolist(), places[wide + 1].tolist(), strict=True):
            cost[a + GRID : b : GRID] = INNER_CUT
        places = np.flatnonzero(cost >= 0)
    return places, cost[places]


def best_cuts(places: np.ndarray, penalty: np.ndarray) -> list[int]:
    """Indexes into places of the cheapest cuts, from the end back to 0, in ascending order."""
    n = len(places)
    jumps: list[list[int]] = [[] for _ in range(n)]
    for k in range(SEQUENCE.bit_length()):
        i = np.searchsorted(places, places - (1 << k))
        hit = np.flatnonzero((places >= 1 << k) & (places[np.minimum(i, n - 1)] == places - (1 << k)))
        for j, x in zip(hit.tolist(), i[hit].tolist(), strict=True):
            jumps[j].append(x)
    pos, pen = places.tolist(), penalty.tolist()
    cost, back = [0] * n, [0] * n
    queue = deque([0])  # indexes with rising cost + position
    for j in range(1, n):
        p = pos[j]
        while pos[queue[0]] < p - SEQUENCE:
            queue.popleft()
        i = queue[0]
        best = cost[i] + pos[i] + SEQUENCE - p
        for x in jumps[j]:
            if cost[x] < best:
                best, i = cost[x], x
        cost[j] = best = best + pen[j] + EACH
        back[j] = i
        best += p
        while queue and cost[queue[-1]] + pos[queue[-1]] >= best:
            queue.pop()
        queue.append(j)
    out, j = [], n - 1
    while j:
        out.append(j)
        j = back[j]
    return out[::-1]


class Stream:
    """The open documents of one partition: what is encoded and not packed yet."""

    def __init__(self, sentence_end: np.ndarray, partition: int):
        self.sentence_end, self.next = sentence_end, partition << 40
        self.ids: list[bytes] = []
        self.docs: list[tuple] = []  # doc_id, ids before what is open, all ids
        self.tokens = 0

    def add(self, doc_id, ids: bytes) -> None:
        self.ids.append(ids)
        self.docs.append((doc_id, 0, len(ids) // 4))
        self.tokens += len(ids) // 4

    def pack(self, final: bool):
        """Pieces of the windows that are settled, as columns; the rest stays open."""
        raw = b"".join(self.ids)
        ids = np.frombuffer(raw, "<u4")
        ends = np.cumsum([total - before for _, before, total in self.docs])
        places, penalty = cut_places(ids, ends, self.sentence_end)
        cuts = places[best_cuts(places, penalty)]
        if not final:
            cuts = cuts[cuts <= len(ids) - CARRY]
        rows: list[tuple] = []
        start, d, last = 0, 0, 0
        for cut in cuts.tolist():
            at = start
            while at < cut:
                doc_id, before, total = self.docs[d]
                head = int(ends[d - 1]) if d else 0
                stop = min(cut, int(ends[d]))
                rows.append((doc_id, before + at - head, stop - at, zlib.crc32(raw[4 * at : 4 * stop]), total, self.next, at - start))
                at = stop
                if stop == ends[d]:
                    d += 1
            start, last = cut, cut
            self.next += 1
        rest = []
        for i in range(d, len(self.docs)):
            doc_id, before, total = self.docs[i]
            head = int(ends[i - 1]) if i else 0
            rest.append((doc_id, before + max(0, last - head), total))
        self.docs, self.ids, self.tokens = rest, [raw[4 * last :]], len(ids) - last
        return rows


SCHEMA = pa.schema([(c, pa.int64()) for c in ("doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset")])


def pack(documents: DataFrame, vocabulary: str | None = None) -> DataFrame:
    """One row per piece: doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset.

    vocabulary: a file of the tokenizers library with a byte-level BPE; the public 50k one if not given.
    """

    def run(batches):
        path = vocabulary
        if path is None:
            import public_tokenizers

            path = public_tokenizers.path("byte_bpe_50k.json")
        enc = encoder(path)
        stream = Stream(enc.ends, TaskContext.get().partitionId())

        def out(final):
            rows = stream.pack(final)
            return pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in zip(*rows, strict=True)] if rows else [pa.array([], pa.int64())] * 7, schema=SCHEMA)

        for batch, texts in slices(batches, "text"):
            for doc_id, ids in zip(batch.column(0).to_pylist(), enc.encode(texts), strict=True):
                stream.add(doc_id, ids)
                if stream.tokens >= BLOCK:
                    yield out(False)
        if stream.docs:
            yield out(True)

    rows = documents.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    return rows.mapInArrow(run, ", ".join(f"`{f.name}` long" for f in SCHEMA))


def op6_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack(table(spark, sf_dir, "documents", "doc_id", "text"))
