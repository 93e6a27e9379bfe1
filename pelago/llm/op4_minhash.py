"""MinHash near-dedup as an inverted join on signature coordinates.

Every text becomes a set of k-word shingles and a signature of `COORDINATES` minima. Texts with
equal sets form a class with a key of its own; only one text of it goes on. A class is found by a
128-bit fingerprint of the set and holds one sequence of words (by SHA-256), or its other sequences
are confirmed on the words of the full sets (refuted()). Each (coordinate, value) pair is a token, and a pair of sets is a candidate if
at least `least` tokens collide, a number at which a pair of the wanted similarity is missed with a
probability under `MISS`.

Prefix: with a document's tokens in order of frequency, rarest first, two documents with `least`
common tokens share one among the first COORDINATES - least + 1 of each. Tokens of one document
alone take the first places; a document in which they fill the prefix is done.
Skip: a posting list is first merged as a star around its most typical member; pairs inside one
component need no more counting and are skipped. In lists that still hold several components, the
members whose shared shingles rule out any further link are skipped too, and the others meet by a
second prefix filter, over the shingles (leftover_pairs), whose lists are split in blocks of
`BLOCK` rows that meet two at a time. Candidates are confirmed on the words of their full sets. Hot tokens, shingles, classes and centres are broadcast or salted, see join_hot().

Defined results: a null or empty text, or one without words, has an empty set and is linked with
nothing; fewer words than k count as one shingle; a row with a null doc_id keeps a null component
and stays; repeated rows share a class; rows that share a doc_id and differ in their text are
documents of their own, each with its own links; an empty table gives an empty table; further
columns, whatever their names, pass through drop_near() and are ignored elsewhere. drop_near()
keeps exactly one row of each component, one with its smallest doc_id.
"""

from __future__ import annotations

import hashlib
import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import fresh, join_hot, outlives, scratch, slices, table, written
from .components import components
from .textvec import Texts, mix

U = np.uint64
COORDINATES, MISS = 48, 1e-6
_rng = np.random.default_rng(48)
_A = _rng.integers(1, 2**63, COORDINATES, dtype=U) | U(1)
_B = _rng.integers(0, 2**63, COORDINATES, dtype=U)
_C = _rng.integers(0, 2**63, COORDINATES, dtype=U)


def least_collisions(percent: int) -> int:
    """The largest count that a pair at the wanted similarity falls short of with probability under MISS."""
    s, below = percent / 100, 0.0
    for t in range(COORDINATES + 1):
        below += math.comb(COORDINATES, t) * s**t * (1 - s) ** (COORDINATES - t)
        if below > MISS:
            return max(1, t)
    return COORDINATES


def shingle_sets(texts: list[bytes], k: int, both: bool = False) -> list:
    """For each text the sorted distinct hashes of its k-word shingles; with both, a pair of these
    and of the hashes of the second family in the same order."""
    t = Texts(texts, fold=True)
    families = []
    for family in range(1 + both):
        words = t.words(family)
        _, g = t.windows(words, k)
        short = {}
        for d in np.flatnonzero((t.n_words > 0) & (t.n_words < k)).tolist():
            n, first = int(t.n_words[d]), int(t.first[d])
            h = words[first : first + 1].copy()
            for j in range(1, n):
                h = h * U(0x9DDFEA08EB382D69) + words[first + j : first + j + 1]
            short[d] = mix(h + U(n))
        families.append((g, short))
    counts = np.maximum(t.n_words - k + 1, 0).tolist()
    out, end = [], 0
    for d, n in enumerate(counts):
        own = [short[d] if d in short else g[end : end + n] for g, short in families]
        end += n
        if both:
            first, at = np.unique(own[0], return_index=True)
            out.append((first, own[1][at]))
        else:
            out.append(np.unique(own[0]))
    return out


def shingle_words(text: str, k: int) -> set[bytes]:
    """The shingles themselves: words of ASCII white space, lower-cased from A-Z, joined by spaces."""
    w = text.encode().lower().split()
    return {b" ".join(w[i : i + k]) for i in range(max(1, len(w) - k + 1))} if w else set()


ROW = ["doc_id", "t1", "t2"]
SUMS = ["n", "s1", "s2"]
#: A class: the sums of its set and, only if these stand for another set as well, the digest of its words.
SET = [*SUMS, "variant"]


def with_row_key(documents: DataFrame) -> DataFrame:
    """doc_id, text, and t1, t2: a fingerprint of the text, which tells apart rows that share a doc_id."""
    return documents.select(F.col("doc_id").cast("long").alias("doc_id"), "text", F.xxhash64("text").alias("t1"), F.xxhash64(F.lit(1), "text").alias("t2"))


def _signatures(k: int):
    schema = pa.schema([*((c, pa.int64()) for c in (*ROW, *SUMS)), ("words", pa.binary()), ("tokens", pa.list_(pa.int64()))])

    def run(batches):
        for batch, texts in slices(batches, "text"):
            sets = shingle_sets(texts, k, both=True)
            n = np.array([len(x) for x, _ in sets], np.int64)
            full = np.flatnonzero(n)
            sums = np.zeros((2, len(sets)), U)
            tokens = np.zeros((len(full), COORDINATES), U)
            if len(full):
                values = np.concatenate([sets[i][0] for i in full])
                cuts = np.concatenate(([0], np.cumsum(n[full])[:-1]))
                sums[0, full] = np.add.reduceat(values, cuts)
                sums[1, full] = np.add.reduceat(np.concatenate([sets[i][1] for i in full]), cuts)
                for c in range(COORDINATES):
                    tokens[:, c] = mix(np.minimum.reduceat(values * _A[c] + _B[c], cuts) + _C[c])
            flat = pa.array(tokens.ravel().view(np.int64))
            step = np.zeros(len(sets) + 1, np.int32)
            step[1:] = np.cumsum(np.where(n > 0, COORDINATES, 0))
            own = [batch.column(batch.schema.get_field_index(c)) for c in ROW]
            words = pa.array([hashlib.sha256(b" ".join(t.lower().split())).digest() for t in texts], pa.binary())
            columns = [*own, pa.array(n), *(pa.array(x.view(np.int64)) for x in sums), words, pa.ListArray.from_arrays(pa.array(step), flat)]
            yield pa.RecordBatch.from_arrays(columns, schema=schema)

    return run


def _confirmed(k: int, percent: int):
    """Keeps the pairs with 100 * intersection >= percent * union, by hashes and then by the words."""

    def linked(x, y):
        both = len(np.intersect1d(x, y, assume_unique=True)) if isinstance(x, np.ndarray) else len(x & y)
        return 100 * both >= percent * (len(x) + len(y) - both)

    def run(batches):
        for batch in batches:
            a, b = batch.column(0).to_pylist(), batch.column(1).to_pylist()
            ok, last, own, words = [], None, None, None
            for x, y, s, t in zip(a, b, batch.column(2), batch.column(3), strict=True):
                if x != last:  # rows come sorted by a
                    last, mine = x, s.as_py()
                    own, words = shingle_sets([mine.encode()], k)[0], None
                other = t.as_py()
                if linked(own, shingle_sets([other.encode()], k)[0]):
                    words = shingle_words(mine, k) if words is None else words
                    if linked(words, shingle_words(other, k)):
                        ok.append((x, y))
            yield pa.RecordBatch.from_arrays([pa.array([p[i] for p in ok], pa.int64()) for i in (0, 1)], ["a", "b"])

    return run


#: Pairs of one document that are confirmed against one copy of its text.
FAN = 512


def confirm(pairs: DataFrame, texts: DataFrame, k: int, percent: int) -> DataFrame:
    """The links among candidate pairs (a, b), stored: enough collisions, then the full sets.

    A text meets its pairs in copies of `FAN` pairs each, so a centre of very many is no hot key."""
    fans = written(pairs.groupBy("a").agg(F.count(F.lit(1)).alias("fan")), "fans")
    copies = F.floor((F.col("fan") - 1) / FAN) + 1
    salted = join_hot(pairs, fans, ["a"], "fan", drop=False).select("a", "b", F.pmod(F.xxhash64("b"), copies).alias("salt"))
    right = salted.join(texts.select(F.col("cls").alias("b"), F.col("tokens").alias("kb"), F.col("text").alias("tb")), "b")
    left = texts.join(fans.withColumnRenamed("a", "cls"), "cls").select(F.col("cls").alias("a"), F.col("tokens").alias("ka"), F.col("text").alias("ta"), F.explode(F.sequence(F.lit(0).cast("long"), copies - 1)).alias("salt"))
    hits = F.size(F.array_intersect("ka", "kb"))
    return (
        right.join(left.hint("merge"), ["a", "salt"])
        .where(hits >= least_collisions(percent))
        .select("a", "b", "ta", "tb")
        .mapInArrow(_confirmed(k, percent), "a long, b long")
    )


def refuted(members: DataFrame, rows: DataFrame, k: int) -> DataFrame:
    """(n, s1, s2, words): the word sequences whose set is not that of the least one with the same sums.

    Of each sequence one text is compared with that of the least, on the words of both full sets."""
    texts = members.groupBy(*SUMS, "words").agg(F.min(F.struct(*ROW)).alias("rep"), F.first("tokens").alias("tokens"))
    several = members.groupBy(*SUMS).agg(F.min("words").alias("least"), F.max("words").alias("most")).where("least <> most").drop("most")
    several = written(texts.join(several, SUMS).withColumn("cls", F.monotonically_increasing_id()), "several")
    centres = several.where("words = least").select(*SUMS, F.col("cls").alias("a"))
    pairs = written(several.where("words <> least").select(*SUMS, "words", F.col("cls").alias("b")).join(centres, SUMS), "variants")
    same = written(confirm(pairs.select("a", "b"), texts_of(rows, several), k, 100), "same")
    return written(pairs.join(same.select("b"), "b", "left_anti").select(*SUMS, "words"), "refuted")


def classes_and_postings(rows: DataFrame, k: int, percent: int) -> tuple[DataFrame, DataFrame, DataFrame]:
    """members: the keys of every row and its set; classes: one row per set, with a number `cls`, the
    count of its rows and one of them; postings: (token, cls, weight) of each prefix."""
    kinds = ", ".join(f"{c} long" for c in (*ROW, *SUMS)) + ", words binary, tokens array<long>"
    members = written(rows.mapInArrow(_signatures(k), kinds).withColumn("variant", F.lit("")), "signatures")

    def grouped(members: DataFrame) -> DataFrame:
        """One row per set."""
        one = [F.min(F.struct(*ROW)).alias("rep"), F.count(F.lit(1)).alias("rows"), F.first("tokens").alias("tokens")]
        return members.where("n > 0 and doc_id is not null").groupBy(*SET).agg(*one, F.min("words").alias("least"), F.max("words").alias("most"))

    sets = written(grouped(members), "sets")
    if not sets.where("least <> most").isEmpty():
        apart = refuted(members.where("n > 0 and doc_id is not null"), rows, k)
        if not apart.isEmpty():
            apart = apart.withColumn("variant", F.hex("words"))
            kept = members.drop("variant").join(apart, [*SUMS, "words"], "left").withColumn("variant", F.coalesce("variant", F.lit("")))
            members = written(kept, "signatures")
            sets = grouped(members)
    sets = sets.drop("least", "most")
    # numbered once, where the table is written: what is read later has the same numbers
    classes = written(sets.withColumn("cls", F.monotonically_increasing_id()), "classes")
    tokens = classes.select("cls", F.explode("tokens").alias("token"))
    often = written(tokens.groupBy("token").agg(F.count(F.lit(1)).alias("df")).where("df > 1"), "frequencies")
    own = W.partitionBy("cls")
    least = least_collisions(percent)
    prefix = (
        join_hot(tokens, often, ["token"], "df", drop=False)
        .withColumn("shared", F.count(F.lit(1)).over(own))
        .where(F.col("shared") >= least)
        .withColumn("weight", F.sum("df").over(own))
        .withColumn("place", F.row_number().over(own.orderBy("df", "token")))
        .where(F.col("place") <= F.col("shared") - least + 1)
        .select("cls", "token", "weight")
    )
    return members, classes, written(prefix, "postings")


def star(rows: DataFrame) -> tuple[DataFrame, DataFrame]:
    """The lists (token, cls) with two members or more, and the pairs of each list's centre with the
    others. rows: (token, cls, weight).

    The centre is the member whose tokens are the most frequent ones: in a group of edited copies
    that is the one with the fewest edits, which most of the others are similar to."""
    centre = F.max(F.struct("weight", (-F.col("cls")).alias("minus"))).alias("c")
    centres = written(rows.groupBy("token").agg(centre, F.count(F.lit(1)).alias("g")).select("token", (-F.col("c.minus")).alias("centre"), "g").where("g > 1"), "centres")
    lists = written(join_hot(rows.select("token", "cls"), centres, ["token"], "g"), "lists")
    return lists, written(lists.where("cls <> centre").select(F.col("centre").alias("a"), F.col("cls").alias("b")).distinct(), "stars")


def _shingle_rows(k: int):
    def run(batches):
        for batch, texts in slices(batches, "text"):
            sets = [x.view(np.int64) for x in shingle_sets(texts, k)]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(sets, pa.list_(pa.int64()))], ["cls", "component", "set"])

    return run


def open_lists(lists: DataFrame, found: DataFrame) -> DataFrame:
    """The lists (token, cls, component) that still hold more than one component."""
    rows = written(lists.select("token", "cls").join(found.withColumnRenamed("node", "cls"), "cls", "left").withColumn("component", F.coalesce("component", "cls")), "labelled")
    ends = rows.groupBy("token").agg(F.min("component").alias("lo"), F.max("component").alias("hi"), F.count(F.lit(1)).alias("g"))
    return written(join_hot(rows, written(ends.where("lo <> hi").select("token", "g"), "split"), ["token"], "g"), "open")


def leftover_pairs(rows: DataFrame, texts: DataFrame, k: int, percent: int) -> DataFrame:
    """Pairs (a, b) in different components of the open lists that can still be links; none is lost.

    A link needs an overlap of q = percent / (100 + percent) of both sizes together. Of a set of n
    shingles, only the m that also occur in another component can be shared with a partner, so a
    partner has at most m / q - n shingles; a member whose lists hold no set that small is skipped.
    The rest meet by a prefix filter on the shingles themselves: if no partner in the lists has
    fewer than s shingles, the overlap is at least q * (n + s), so with a set's shingles in order
    of frequency, rarest first, the first common one is among the first n + 1 - q * (n + s). Where
    two sets meet, what follows in either of them must still reach their own overlap.
    """
    q = percent / (100 + percent)
    members = rows.select("cls", "component").distinct()
    sets = texts.select("cls", "text").join(members, "cls").select("cls", "component", "text").mapInArrow(_shingle_rows(k), "cls long, component long, set array<long>")
    shingles = written(sets.select("cls", "component", F.size("set").alias("n"), F.explode("set").alias("shingle")), "shingles")
    often = shingles.groupBy("shingle").agg(F.count(F.lit(1)).alias("df"), F.min("component").alias("lo"), F.max("component").alias("hi")).where("lo <> hi").select("shingle", "df")
    shared = written(join_hot(shingles, written(often, "often"), ["shingle"], "df", drop=False), "shared")
    bound = shared.groupBy("cls", "n").agg(F.count(F.lit(1)).alias("m"))
    bound = bound.withColumn("most", F.floor(F.col("m") / q - F.col("n") + 1e-6)).where(100 * F.col("most") >= percent * F.col("n"))
    sized = written(rows.join(bound, "cls"), "sized")
    smallest = sized.groupBy("token").agg(F.min("n").alias("least"), F.min("component").alias("lo"), F.max("component").alias("hi"), F.count(F.lit(1)).alias("g"))
    smallest = written(smallest.where("lo <> hi").select("token", "least", "g"), "smallest")
    kept = join_hot(sized, smallest, ["token"], "g").where("most >= least").groupBy("cls", "m", "most").agg(F.min("least").alias("least"))
    need = F.ceil(q * (F.col("n") + F.greatest(F.col("least"), F.ceil(percent * F.col("n") / 100 - 1e-6))) - 1e-6)
    place = F.row_number().over(W.partitionBy("cls").orderBy("df", "shingle"))
    prefix = shared.join(kept, "cls").withColumn("place", place).where(F.col("place") <= F.col("m") + 1 - need)
    after = (F.col("m") - F.col("place") + 1).alias("left")  # the overlap, if this shingle is the first common one
    prefix = written(prefix.select("shingle", "cls", "component", "n", "most", after), "prefixes")
    lists = prefix.groupBy("shingle").agg(F.count(F.lit(1)).alias("g"), F.min("component").alias("lo"), F.max("component").alias("hi"))
    lists = written(lists.where("lo <> hi").select("shingle", "g"), "lists")
    dealt = in_blocks(join_hot(prefix, lists, ["shingle"], "g", drop=False))
    one, other = (dealt.select("shingle", "lower", "upper", *[F.col(c).alias(f"{c}_{s}") for c in ("cls", "component", "n", "most", "left", "block")]) for s in "ab")
    sizes = f"n_b <= most_a and n_a <= most_b and 100 * n_a >= {percent} * n_b and 100 * n_b >= {percent} * n_a"
    overlap = f"{100 + percent} * left_a >= {percent} * (n_a + n_b) and {100 + percent} * left_b >= {percent} * (n_a + n_b)"
    fits = f"cls_a < cls_b and component_a <> component_b and (lower = upper or block_a <> block_b) and {sizes} and {overlap}"
    return written(one.join(other, ["shingle", "lower", "upper"]).where(fits).select(F.col("cls_a").alias("a"), F.col("cls_b").alias("b")).distinct(), "leftover")


#: Rows of a shingle's list that one block holds; two blocks are the most that one key of the join brings together.
BLOCK = 4096


def in_blocks(rows: DataFrame) -> DataFrame:
    """rows: (shingle, cls, g, ...), g the length of the shingle's list. Each row stands once for every
    block of its list, under the pair (lower, upper) of that block and its own: any two rows of a list
    meet under exactly one pair of their blocks, and lists of up to BLOCK rows stay as they are."""
    blocks = F.floor((F.col("g") - 1) / BLOCK) + 1
    rows = rows.withColumn("block", F.pmod(F.xxhash64("cls"), blocks)).withColumn("with", F.explode(F.sequence(F.lit(0).cast("long"), blocks - 1)))
    return rows.withColumns({"lower": F.least("block", "with"), "upper": F.greatest("block", "with")}).drop("g", "with")


def texts_of(rows: DataFrame, classes: DataFrame) -> DataFrame:
    """(cls, tokens, text): one text for each of the classes, from rows that may be repeated."""
    wanted = classes.select("rep.*", "cls", "tokens")
    some = rows.join(wanted.select(*ROW), ROW, "left_semi").groupBy(*ROW).agg(F.first("text").alias("text"))
    return some.join(wanted, ROW).select("cls", "tokens", "text")


def labelled(documents: DataFrame, k: int, percent: int) -> DataFrame:
    """ROW, n, component (a class number) and component_id (a doc_id) of every row with a set and a
    doc_id, and the rest with null components. Reads stored tables only."""
    rows = with_row_key(documents)
    with scratch(documents.sparkSession):
        members, classes, postings = classes_and_postings(rows, k, percent)
        lists, pairs = star(postings)
        texts = written(texts_of(rows, classes.join(lists.select("cls").distinct(), "cls", "left_semi")), "texts")
        links = written(confirm(pairs, texts, k, percent), "links")
        found = components(links)
        more = written(confirm(leftover_pairs(open_lists(lists, found), texts, k, percent), texts, k, percent), "links")
        if not more.isEmpty():
            found = components(links.unionByName(more))
        whole = written(classes.select(*SET, "rows", "cls", "rep").join(found.withColumnRenamed("node", "cls"), "cls", "left").withColumn("component", F.coalesce("component", "cls")), "found")
        least = whole.groupBy("component").agg(F.min("rep.doc_id").alias("component_id"), F.count(F.lit(1)).alias("size"))
        named = written(join_hot(whole.select(*SET, "rows", "component"), written(least, "least"), ["component"], "size"), "named")
        keys = members.select(*ROW, *SET)
        own = F.col("n").isNotNull() & (F.col("n") > 0) & F.col("doc_id").isNotNull()
        linked = join_hot(keys.where(own), named, SET, "rows").select(*ROW, "n", "component", "component_id")
        alone = keys.where(~own).select(*ROW, "n", F.lit(None).cast("long").alias("component"), F.col("doc_id").alias("component_id"))
        return outlives(linked.unionByName(alone), "labelled")


def near_components(documents: DataFrame, k: int = 5, percent: int = 80) -> DataFrame:
    """doc_id, n_shingles, component_id, kept for every document."""
    out = labelled(documents, k, percent).select("doc_id", F.col("n").alias("n_shingles"), "component_id")
    return out.withColumn("kept", F.coalesce(F.col("doc_id") == F.col("component_id"), F.lit(True)))


def drop_near(documents: DataFrame, k: int = 5, percent: int = 80) -> DataFrame:
    """The rows that stay, with all their columns: those without a set or a doc_id, and one of each component."""
    names = documents.columns
    new = fresh(names, *(f"_{c}" for c in ROW), *(f"_{c}_kept" for c in ROW))
    keys, kept_keys = new[:3], new[3:]
    with scratch(documents.sparkSession):
        rows = labelled(documents, k, percent).where("doc_id is not null")
        first = rows.where("component is not null").groupBy("component").agg(F.min(F.struct(*ROW)).alias("r")).select("r.*")
        stay = outlives(first.unionByName(rows.where("component is null").select(*ROW).distinct()).toDF(*kept_keys), "stay")
        again = rows.where("component is not null").groupBy(*ROW).agg(F.count(F.lit(1)).alias("times")).where("times > 1").select(*ROW)
        again = outlives(again.toDF(*kept_keys), "again")
    keyed = documents.withColumns({keys[0]: F.col("doc_id").cast("long"), keys[1]: F.xxhash64("text"), keys[2]: F.xxhash64(F.lit(1), "text")})
    same = [F.col(a) == F.col(b) for a, b in zip(keys, kept_keys, strict=True)]
    kept = keyed.where(F.col(keys[0]).isNotNull()).join(stay, same, "left_semi")
    if not again.isEmpty():  # rows with the same doc_id and text: one of them stays
        kept = kept.join(again, same, "left_anti").unionByName(kept.join(again, same, "left_semi").dropDuplicates(keys))
    return kept.unionByName(keyed.where(F.col(keys[0]).isNull())).select(*[F.col(f"`{c}`") for c in names])


def op4_minhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_components(table(spark, sf_dir, "documents", "doc_id", "text"), k=3, percent=85)
