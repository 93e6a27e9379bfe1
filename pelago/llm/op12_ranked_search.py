"""Ranked lexical search: MaxScore over an inverted index, its bounds tightened by term pairs.

Items are searched in groups of at most ITEMS items and about TERMS different terms (one item is
never split). For each group

1. documents become blocks, each a small inverted index over the group's terms with its own document
   numbers; counts of documents and terms (N, L, df) are summed over all blocks by Spark;
2. each block gets its impacts: for every term its postings and their maximum, and for every pair of
   an item the intersection list with the largest impact that its documents have from both terms
   together. A block also reports the best sums over an item's rarer terms alone; the k-th best of
   all blocks is a score that the k-th result is known to reach (the floor);
3. each block is searched. A pair bounds a document's score from both terms by the largest of the two
   term maxima and the joint maximum, which is often far below their sum; units (pairs and single
   terms) are sorted by bound, and those whose bounds together stay below the floor bring no
   candidates. Candidates of the others are bounded again by the intersection lists that hold them,
   and only those that can still reach the floor are scored in full.

What a block returns is at most k rows for each item and task; one window keeps the k best of them.
Pairs are neighbours in an item's terms by falling weight; a list is stored where the rarer term is
in at most one document in RARE, so that no list is longer than that; other pairs are bounded by
the sum of their term maxima. Skipping never changes a result: bounds are exact maxima.

Defined results: null or empty texts have no terms and are neither counted nor found; an item
without terms, or with terms that no document has, gives no row; rows that share an item_id are one
item with the terms of all; rows that share a doc_id are documents of their own (so a repeated row
is found twice, with different ranks); a null doc_id stands last among equal scores; an empty table
gives an empty table; further columns are not read.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import outlives, scratch, table, written

#: Most items, and about the most different terms, that are searched together.
ITEMS, TERMS = 1024, 1 << 17
#: A block ends after so many documents or bytes of text.
BLOCK_DOCS, BLOCK_BYTES = 4096, 8 << 20
#: Terms in at most one document in RARE have pair lists and make the floor.
RARE = 64
#: A text is split in pieces of about so many bytes, cut between terms.
PIECE = 1 << 22
#: Bytes of terms (ASCII letters and digits, and everything beyond ASCII) as they are compared; all others part terms.
_FOLD = bytes(b + 32 if 65 <= b <= 90 else b if b >= 128 or chr(b).isalnum() else 32 for b in range(256))
_NULL = np.iinfo(np.int64).max

_BLOCK = "docs array<bigint>, terms array<int>, sizes array<int>, places array<int>"
INDEX = f"{_BLOCK}, lengths array<bigint>, counts array<bigint>, n_docs bigint, n_terms bigint"
IMPACTS = f"{_BLOCK}, impacts array<bigint>, pairs array<int>, pair_sizes array<int>, pair_places array<int>, pair_maxima array<bigint>, seed_items array<int>, seed_scores array<bigint>"
FOUND = "item int, doc_id bigint, score bigint"


def pieces(text: bytes) -> Iterator[list[bytes]]:
    """The terms of a text, in lists of bounded size."""
    folded = text.translate(_FOLD)
    start = 0
    while start < len(folded):
        end = start + PIECE
        if end < len(folded):
            cut = folded.find(b" ", end)
            end = len(folded) if cut < 0 else cut
        yield folded[start:end].split()
        start = end


def weight(n_docs: int, df: int) -> int:
    return math.floor(1000 * math.log((2 * n_docs + 2) / (2 * df + 1)))


def _lists(**columns) -> pa.RecordBatch:
    """One row whose cells are arrays or numbers."""
    cells = [pa.array([v]) if isinstance(v, int) else pa.ListArray.from_arrays(pa.array([0, len(v)], pa.int32()), v if isinstance(v, pa.Array) else pa.array(v)) for v in columns.values()]
    return pa.RecordBatch.from_arrays(cells, list(columns))


def _rows(batches) -> Iterator[dict]:
    """Each row's arrays as numpy arrays (a null document id is the largest number)."""
    for batch in batches:
        for i in range(len(batch)):
            row = {name: batch.column(j)[i] for j, name in enumerate(batch.schema.names)}
            yield {k: pc.fill_null(v.values, _NULL).to_numpy(zero_copy_only=False) if k == "docs" else v.values.to_numpy(zero_copy_only=False) for k, v in row.items() if pa.types.is_list(v.type)}


class _Blocks:
    """Collects documents and gives an inverted index of each block."""

    def __init__(self, vocabulary: dict[bytes, int]):
        self.get = vocabulary.get
        self.clear()

    def clear(self) -> None:
        self.ids, self.lengths, self.keys = [], [], []
        self.n_docs = self.n_terms = self.size = 0

    def add(self, doc_id, text: bytes) -> None:
        n, found = 0, []
        for words in pieces(text):
            n += len(words)
            known = [t for t in map(self.get, words) if t is not None]
            if known:
                found.append(np.array(known, np.int64))
        self.size += len(text)
        self.n_terms += n
        self.n_docs += n > 0
        if found:
            self.keys.append(np.concatenate(found) * BLOCK_DOCS + len(self.ids))
            self.ids.append(doc_id)
            self.lengths.append(n)

    def full(self) -> bool:
        return len(self.ids) == BLOCK_DOCS or self.size >= BLOCK_BYTES

    def row(self) -> pa.RecordBatch:
        keys, counts = np.unique(np.concatenate(self.keys) if self.keys else np.zeros(0, np.int64), return_counts=True)
        terms, sizes = np.unique(keys // BLOCK_DOCS, return_counts=True)
        return _lists(
            docs=pa.array(self.ids, pa.int64()), terms=terms.astype(np.int32), sizes=sizes.astype(np.int32), places=(keys % BLOCK_DOCS).astype(np.int32),
            lengths=np.array(self.lengths, np.int64), counts=counts.astype(np.int64), n_docs=self.n_docs, n_terms=self.n_terms,
        )


def index(documents: DataFrame, vocabulary: dict[bytes, int]) -> DataFrame:
    """The blocks of all documents over the terms of the vocabulary."""

    def run(batches):
        block = _Blocks(vocabulary)
        for batch in batches:
            texts = batch.column(1).cast(pa.large_string()).cast(pa.large_binary())
            for doc_id, text in zip(batch.column(0).to_pylist(), texts, strict=True):
                if text.is_valid:
                    block.add(doc_id, text.as_py())
                    if block.full():
                        yield block.row()
                        block.clear()
        if block.n_docs:
            yield block.row()

    return documents.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(run, INDEX)


class Items:
    """A group of items against the counts of all documents: weights, and the units of each item."""

    def __init__(self, items: list[list[int]], n_terms: int, df: dict[int, int], n_docs: int):
        self.weight = np.zeros(n_terms, np.int64)
        for t, n in df.items():
            self.weight[t] = weight(n_docs, n)
        self.pairs: dict[tuple[int, int], int] = {}
        self.terms, self.units, self.rare = [], [], []
        for item in items:
            # terms with weight 0 add nothing; by falling weight, so that rare terms are paired
            terms = sorted((t for t in set(item) if t in df and self.weight[t] > 0), key=lambda t: (-self.weight[t], t))
            a, b, pair = [], [], []
            for j in range(0, len(terms), 2):
                two = j + 1 < len(terms)
                key = (terms[j], terms[j + 1]) if two else None
                stored = two and df[terms[j]] * RARE <= n_docs
                a.append(j)
                b.append(j + 1 if two else len(terms))  # one past the end: no term
                pair.append(self.pairs.setdefault(key, len(self.pairs)) if stored else -1)
            self.terms.append(np.array(terms, np.int64))
            self.units.append((np.array(a, np.int64), np.array(b, np.int64), np.array(pair, np.int64)))
            self.rare.append([t for t in terms if df[t] * RARE <= n_docs])


class _Postings:
    """The lists of one block: term or pair -> places and impacts."""

    def __init__(self, keys: np.ndarray, sizes: np.ndarray, space: int):
        self.slot = np.full(space + 1, -1, np.int64)  # the last entry stands for no term
        self.slot[keys] = np.arange(len(keys))
        self.at = np.concatenate(([0], np.cumsum(sizes, dtype=np.int64)))

    def span(self, key: int) -> slice:
        s = self.slot[key]
        return slice(self.at[s], self.at[s + 1]) if s >= 0 else slice(0, 0)


def _top(scores: np.ndarray, docs: np.ndarray, k: int) -> np.ndarray:
    """Places of the k best, equal scores by document id."""
    if len(scores) > 4 * k:
        least = np.partition(scores, -k)[-k]
        some = np.flatnonzero(scores >= least)
        return some[np.lexsort((docs[some], -scores[some]))[:k]]
    return np.lexsort((docs, -scores))[:k]


def impacts(blocks: DataFrame, items: Items, n_docs: int, n_terms: int, k: int) -> DataFrame:
    """The blocks with impacts (weight times saturated count), pair lists and seeds of the floor."""

    def run(batches):
        for row in _rows(batches):
            term_of = np.repeat(row["terms"], row["sizes"]).astype(np.int64)
            longest = int(row["lengths"].max(initial=0))
            if 90 * longest * n_docs < 2**63:
                m = 100 - 90 + (90 * row["lengths"] * n_docs) // max(1, n_terms)
            else:
                m = np.array([100 - 90 + (90 * int(n) * n_docs) // n_terms for n in row["lengths"]], np.int64)
            count = row["counts"]
            impact = items.weight[term_of] * ((1_000_000_000 * count) // (1000 * count + 8 * m[row["places"]]))
            post = _Postings(row["terms"], row["sizes"], len(items.weight))
            ids, sizes, places, maxima = [], [], [], []
            for (a, b), pair in items.pairs.items():
                x, y = post.span(a), post.span(b)
                if x.stop > x.start and y.stop > y.start:
                    at = np.searchsorted(row["places"][y], row["places"][x])
                    at[at == y.stop - y.start] = 0
                    both = row["places"][y][at] == row["places"][x]
                    if both.any():
                        ids.append(pair)
                        sizes.append(int(both.sum()))
                        places.append(row["places"][x][both])
                        maxima.append(int((impact[x][both] + impact[y][at[both]]).max()))
            seed_items, seed_scores = [], []
            for i, rare in enumerate(items.rare):
                spans = [post.span(t) for t in rare]
                spans = [s for s in spans if s.stop > s.start]
                if spans:
                    at = np.concatenate([row["places"][s] for s in spans])
                    some, where = np.unique(at, return_inverse=True)
                    score = np.zeros(len(some), np.int64)
                    np.add.at(score, where, np.concatenate([impact[s] for s in spans]))
                    best = score if len(score) <= k else np.partition(score, -k)[-k:]
                    seed_items += [i] * len(best)
                    seed_scores += best.tolist()
            yield _lists(
                docs=pa.array(row["docs"], pa.int64(), mask=row["docs"] == _NULL), terms=row["terms"], sizes=row["sizes"], places=row["places"], impacts=impact,
                pairs=np.array(ids, np.int32), pair_sizes=np.array(sizes, np.int32), pair_places=np.concatenate(places).astype(np.int32) if places else np.zeros(0, np.int32),
                pair_maxima=np.array(maxima, np.int64), seed_items=np.array(seed_items, np.int32), seed_scores=np.array(seed_scores, np.int64),
            )

    return blocks.mapInArrow(run, IMPACTS)


class Searcher:
    """One block's lists, and the search of one item in them."""

    def __init__(self, row: dict, items: Items):
        self.row, self.items = row, items
        self.post = _Postings(row["terms"], row["sizes"], len(items.weight))
        self.both = _Postings(row["pairs"], row["pair_sizes"], len(items.pairs))
        self.maxima = np.concatenate((np.maximum.reduceat(row["impacts"], self.post.at[:-1]), [0])) if len(row["terms"]) else np.zeros(1, np.int64)
        self.joint = np.concatenate((row["pair_maxima"], [0]))  # slot -1: nothing

    def bounds(self, i: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """For each unit of item i: its bound, the larger of its term maxima, and its joint maximum."""
        terms, (a, b, pair) = self.items.terms[i], self.items.units[i]
        most = np.concatenate((self.maxima[self.post.slot[terms]], [0]))  # of each term of the item; slot -1 is the last, 0
        one = np.maximum(most[a], most[b])
        joint = self.joint[self.both.slot[pair]]
        return np.where(pair >= 0, np.maximum(one, joint), most[a] + most[b]), one, joint

    def find(self, i: int, floor: int) -> tuple[np.ndarray, np.ndarray]:
        """Places and full scores of all documents that reach the floor and 1."""
        none = np.zeros(0, np.int64), np.zeros(0, np.int64)
        terms, (a, b, pair) = self.items.terms[i], self.items.units[i]
        if not len(terms):
            return none
        bound, one, joint = self.bounds(i)
        floor = max(floor, 1)
        if bound.sum() < floor:
            return none
        order = np.argsort(bound, kind="stable")
        below = np.cumsum(bound[order])
        first = int(np.searchsorted(below, floor))  # units before it together stay below the floor
        score = np.zeros(len(self.row["docs"]), np.int64)
        places, impact = self.row["places"], self.row["impacts"]
        for u in order[first:]:
            for j in (a[u], b[u]):
                if j < len(terms):
                    span = self.post.span(terms[j])
                    score[places[span]] += impact[span]
        rest = int(below[first - 1]) if first else 0
        found = np.flatnonzero(score + rest >= floor) if first else np.flatnonzero(score >= floor)
        found = found[score[found] > 0]
        if not first or not len(found):
            return found, score[found]
        # bounds by intersection: a document outside a pair's list has one of its terms at most
        room = np.zeros((first, len(found)), np.int64)
        for row, u in enumerate(order[:first]):
            if pair[u] >= 0:
                room[row] = one[u]
                held = places_in(self.row["pair_places"][self.both.span(pair[u])], found)
                room[row, held >= 0] = joint[u]
            else:
                room[row] = bound[u]
        left = room.sum(axis=0)
        total = score[found]
        for row in range(first - 1, -1, -1):
            keep = total + left >= floor
            if not keep.all():
                found, total, left, room = found[keep], total[keep], left[keep], room[:, keep]
            if not len(found):
                break
            u = order[row]
            for j in (a[u], b[u]):
                if j < len(terms):
                    span = self.post.span(terms[j])
                    at = places_in(places[span], found)
                    total = total + np.where(at >= 0, impact[span][at] if span.stop > span.start else 0, 0)
            left = left - room[row]
        keep = total >= floor
        return found[keep], total[keep]


def places_in(sorted_list: np.ndarray, wanted: np.ndarray) -> np.ndarray:
    """Where each wanted number stands in the list, or -1."""
    if not len(sorted_list):
        return np.full(len(wanted), -1, np.int64)
    at = np.minimum(np.searchsorted(sorted_list, wanted), len(sorted_list) - 1)
    return np.where(sorted_list[at] == wanted, at, -1)


def search_blocks(blocks: DataFrame, items: Items, floors: dict[int, int], k: int) -> DataFrame:
    """(item, doc_id, score): for each task at most k rows of an item, the best of all among them."""

    def run(batches):
        n = len(items.terms)
        floor = [floors.get(i, 0) for i in range(n)]
        docs, scores = [np.zeros(0, np.int64)] * n, [np.zeros(0, np.int64)] * n
        for row in _rows(batches):
            block = Searcher(row, items)
            for i in range(n):
                found, score = block.find(i, floor[i])
                if len(found):
                    d, s = np.concatenate((docs[i], row["docs"][found])), np.concatenate((scores[i], score))
                    best = _top(s, d, k)
                    docs[i], scores[i] = d[best], s[best]
                    if len(best) == k:
                        floor[i] = max(floor[i], int(scores[i][-1]))
        sizes = [len(d) for d in docs]
        ids = np.concatenate(docs) if n else np.zeros(0, np.int64)
        yield pa.RecordBatch.from_arrays(
            [pa.array(np.repeat(np.arange(n, dtype=np.int32), sizes)), pa.array(ids, pa.int64(), mask=ids == _NULL), pa.array(np.concatenate(scores) if n else np.zeros(0, np.int64))],
            ["item", "doc_id", "score"],
        )

    return blocks.mapInArrow(run, FOUND)


def _groups(queries: DataFrame) -> Iterator[tuple[list, list[list[bytes]]]]:
    """Item ids and their different terms, in groups; rows come to the driver partition by partition."""
    ids, terms, size = [], [], 0
    for row in queries.select("item_id", "text").where("text is not null").orderBy("item_id").toLocalIterator():
        new = {w for words in pieces(row["text"].encode()) for w in words}
        if ids and ids[-1] == row["item_id"]:
            terms[-1] = sorted(new.union(terms[-1]))
            continue
        if ids and (len(ids) == ITEMS or size + len(new) > TERMS):
            yield ids, terms
            ids, terms, size = [], [], 0
        ids.append(row["item_id"])
        terms.append(sorted(new))
        size += len(new)
    if ids:
        yield ids, terms


def _search_group(documents: DataFrame, ids: list, terms: list[list[bytes]], k: int, kind) -> DataFrame:
    spark = documents.sparkSession
    vocabulary = {w: t for t, w in enumerate(sorted({w for words in terms for w in words}))}
    blocks = written(index(documents, vocabulary), "index")
    n_docs, n_terms = blocks.agg(F.coalesce(F.sum("n_docs"), F.lit(0)), F.coalesce(F.sum("n_terms"), F.lit(0))).collect()[0]
    by_term = blocks.select(F.explode(F.arrays_zip("terms", "sizes")).alias("p")).groupBy("p.terms").agg(F.sum("p.sizes").alias("df"))
    df = {r[0]: r[1] for r in by_term.toLocalIterator()}  # at most the group's terms
    items = Items([[vocabulary[w] for w in words] for words in terms], len(vocabulary), df, n_docs)
    scored = written(impacts(blocks.select("docs", "terms", "sizes", "places", "lengths", "counts"), items, n_docs, n_terms, k), "impacts")
    seeds = scored.select(F.explode(F.arrays_zip("seed_items", "seed_scores")).alias("s")).select(F.col("s.seed_items").alias("item"), F.col("s.seed_scores").alias("score"))
    place = F.row_number().over(W.partitionBy("item").orderBy(F.desc("score")))
    floors = {r[0]: r[1] for r in seeds.withColumn("place", place).where(F.col("place") <= k).groupBy("item").agg(F.min("score"), F.count(F.lit(1)).alias("n")).where(F.col("n") == k).toLocalIterator()}
    found = search_blocks(scored.drop("seed_items", "seed_scores"), items, floors, k)
    rank = F.row_number().over(W.partitionBy("item").orderBy(F.desc("score"), F.asc_nulls_last("doc_id")))
    best = found.withColumn("rank", rank).where(F.col("rank") <= k)
    names = spark.createDataFrame(list(enumerate(ids)), T.StructType([T.StructField("item", T.IntegerType()), T.StructField("item_id", kind)]))
    return best.join(F.broadcast(names), "item").select("item_id", "rank", "doc_id", "score")  # at most ITEMS rows


def search(documents: DataFrame, queries: DataFrame, k: int = 10) -> DataFrame:
    """(item_id, rank, doc_id, score): the k best documents of each row of queries (item_id, text)."""
    kind = queries.schema["item_id"].dataType
    out = None
    for ids, terms in _groups(queries):
        with scratch(documents.sparkSession):
            part = outlives(_search_group(documents, ids, terms, k, kind), "found")
        out = part if out is None else out.unionByName(part)
    if out is None:
        schema = T.StructType([T.StructField("item_id", kind), T.StructField("rank", T.IntegerType()), T.StructField("doc_id", T.LongType()), T.StructField("score", T.LongType())])
        return documents.sparkSession.createDataFrame([], schema)
    return out


def op12_ranked_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    return search(table(spark, sf_dir, "documents", "doc_id", "text"), table(spark, sf_dir, "benchmark", "item_id", "text"))


_TERM = r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"
_LOWER = "translate({}, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
ORACLE = f"""
WITH d AS (SELECT row_number() OVER () AS r, doc_id, regexp_extract_all({_LOWER.format('text')}, '{_TERM}') AS w FROM documents WHERE text IS NOT NULL),
c AS (SELECT count(*) AS all_docs, CAST(sum(len(w)) AS BIGINT) AS all_terms FROM d WHERE len(w) > 0),
tf AS (SELECT r, doc_id, n, term, count(*) AS tf FROM (SELECT r, doc_id, len(w) AS n, unnest(w) AS term FROM d) u GROUP BY ALL),
df AS (SELECT term, count(*) AS df FROM tf GROUP BY term),
q AS (SELECT DISTINCT item_id, unnest(regexp_extract_all({_LOWER.format('text')}, '{_TERM}')) AS term FROM benchmark),
s AS (SELECT item_id, r, doc_id, CAST(sum(CAST(floor(1000 * ln((2 * all_docs + 2) / (2 * df + 1))) AS BIGINT)
        * ((1000000000 * tf) // (1000 * tf + 8 * (100 - 90 + ((90 * n * all_docs) // all_terms))))) AS BIGINT) AS score
      FROM q JOIN tf USING (term) JOIN df USING (term) CROSS JOIN c GROUP BY ALL)
SELECT item_id, CAST(rank AS INT) AS rank, doc_id, score
FROM (SELECT *, row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id) AS rank FROM s WHERE score > 0) o WHERE rank <= 10
"""
