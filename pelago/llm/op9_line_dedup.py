"""Line dedup: a suffix array of line-id sequences by prefix doubling, in DataFrame functions only.

Lines with a word become ids: ranks of their 128-bit fingerprints, of those that stand at two places
or more. A line of its own ends a sequence, and a sequence of fewer than `MIN_WORDS` words holds no
repeated run. A suffix is compared over its first `top` lines: as many as a run of MIN_WORDS words
needs that is shortest from its first or from its last line, at most MIN_WORDS + 1.

Prefix doubling: level h + 1 ranks each suffix by the pair of level-h ranks of itself and of the
suffix 2**h lines on. The distinct pairs, counted before anything is shuffled whole, are sorted by
range and numbered in that order, and the numbers joined back. A suffix rests once 2**h covers its
top. The last ranks, one row for all suffixes of a rank, are the suffix array; from its neighbours'
longest common prefixes follow, for each length that counts, the intervals of suffixes that share so
many lines. A run that stands at an earlier place (by doc_id, then text, then line) is a later copy;
such runs are merged and deleted.

Defined results: words are set apart by white space; lines without a word are not compared, and go
only inside a deleted run; a null text stays null with no lines; rows with a null doc_id are returned
unchanged; rows that share a doc_id and differ in their text are documents of their own, in the order
of a hash of the text, and rows with the same doc_id and text one document, treated alike; an empty
table gives an empty table; other columns are not read.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import join_hot, outlives, scratch, table, written

#: Words that a repeated run needs; a compared run then has at most one line more.
MIN_WORDS = 50
DOC = ["doc_id", "t"]
PLACE = ["doc_id", "t", "k"]


def keyed(documents: DataFrame) -> DataFrame:
    return documents.select("doc_id", "text", F.xxhash64("text").alias("t"))


def line_rows(rows: DataFrame) -> DataFrame:
    """DOC, k (place among the lines with a word), pos, w (words) and the fingerprint h1, h2 of these lines."""
    words = lambda x: F.regexp_count(x, F.lit(r"[^ \t\r\x0b\x0c]+"))
    lines = F.transform(F.split("text", "\n"), lambda x, i: F.struct(i.alias("pos"), words(x).alias("w"), F.xxhash64(x).alias("h1"), F.xxhash64(F.lit(1), x).alias("h2")))
    out = rows.where("doc_id is not null").select(*DOC, F.posexplode(F.filter(lines, lambda x: x["w"] > 0)).alias("k", "x")).select(*PLACE, "x.*")
    again = rows.groupBy(*DOC).agg(F.count(F.lit(1)).alias("n")).where("n > 1")
    return out if again.isEmpty() else out.dropDuplicates(PLACE)


def ranked(rows: DataFrame, keys: list[str], least: int, name: str) -> DataFrame:
    """keys, n (their rows) and r, a number from 1 that rises with the keys, of those in `least` rows or more."""
    counts = rows.groupBy(*keys).agg(F.count(F.lit(1)).alias("n")).where(F.col("n") >= least)
    # numbers are made once, where the table is written
    return written(counts.repartitionByRange(*keys).sortWithinPartitions(*keys).withColumn("r", F.monotonically_increasing_id() + 1), name)


def sequences(rows: DataFrame) -> DataFrame:
    """The suffixes: PLACE, seq, r (line id), n_min and top (lines), ids and spots (ids and places of the top lines)."""
    lines = written(line_rows(rows), "lines")
    named = join_hot(lines, ranked(lines, ["h1", "h2"], 2, "ids"), ["h1", "h2"], "n").select(*PLACE, "pos", "w", "r")
    doc = W.partitionBy(*DOC)
    own = W.partitionBy(*DOC, "seq")
    named = named.withColumn("seq", F.col("k") - F.row_number().over(doc.orderBy("k")))
    named = named.withColumn("all", F.sum("w").over(own)).where(F.col("all") >= MIN_WORDS)
    named = named.withColumn("c", F.sum("w").over(own.orderBy("k"))).withColumn("b", F.col("c") - F.col("w"))
    line = F.struct("r", "pos")
    first = own.orderBy("b").rangeBetween(0, MIN_WORDS - 1)  # the lines that start within MIN_WORDS words from here
    last = own.orderBy("c").rangeBetween(0, MIN_WORDS - 1)  # those that end within MIN_WORDS words from this line's end
    named = named.withColumn("x", F.collect_list(line).over(first)).withColumn("y", F.collect_list(line).over(last))
    enough = F.col("all") - F.col("b") >= MIN_WORDS
    named = named.withColumn("n_min", F.when(enough, F.size("x"))).withColumn("x", F.when(F.size("x") >= F.size("y"), F.col("x")).otherwise(F.col("y")))
    top = F.when(enough, F.size("x")).otherwise(MIN_WORDS + 1)
    return written(named.select(*PLACE, "seq", "r", "n_min", top.alias("top"), F.col("x.r").alias("ids"), F.col("x.pos").alias("spots")), "sequences")


def doubled(suffixes: DataFrame) -> DataFrame:
    """PLACE and r, the rank of each suffix by its first `top` lines, after all levels."""
    most = suffixes.where("n_min is not null").agg(F.max("top")).first()[0] or 1
    ranks = suffixes.select(*PLACE, "seq", "top", "r")
    order = W.partitionBy(*DOC, "seq").orderBy("k")
    for h in range((most - 1).bit_length()):
        ahead = F.when(F.col("top") > (1 << h), F.lead("r", 1 << h).over(order))
        pairs = written(ranks.withColumnRenamed("r", "r1").withColumn("r", F.col("r1")).withColumn("r2", F.coalesce(ahead, F.lit(0))).drop("r"), f"level{h}")
        ranks = join_hot(pairs, ranked(pairs, ["r1", "r2"], 1, f"ranks{h}"), ["r1", "r2"], "n").select(*PLACE, "seq", "top", "r")
    return ranks.select(*PLACE, "r")


def common_prefix(a: Column, b: Column) -> Column:
    """How many leading elements two arrays share."""
    apart = F.array_position(F.zip_with(a, b, lambda x, y: x.eqNullSafe(y)), False)
    return F.when(a.isNull() | b.isNull(), 0).when(apart == 0, F.size(a)).otherwise(apart - 1)


def intervals(array: DataFrame) -> DataFrame:
    """r, n and origins: for each length that counts, the first place of the suffixes with these first lines.

    array: r, n, first, ids, n_min, top. The rows of one length in suffix order fall into intervals
    wherever neighbours share fewer lines. An interval may go on in the next range of the sort; what
    joins them is one row for each range."""
    rows = array.select("r", "n", "first", "ids", F.explode(F.sequence("n_min", "top")).alias("l"))
    rows = written(rows.repartitionByRange("l", "r").withColumn("part", F.spark_partition_id()), "lengths")
    order = W.partitionBy("part").orderBy("l", "r")
    lcp = common_prefix(F.lag("ids").over(order), F.col("ids"))
    cut = F.when(F.lag("l").over(order).isNull(), 0).otherwise(((F.lag("l").over(order) != F.col("l")) | (lcp < F.col("l"))).cast("int"))
    rows = written(rows.withColumn("cut", cut).withColumn("local", F.sum("cut").over(order)), "cuts")
    ends = rows.groupBy("part").agg(F.min(F.struct("l", "r", "ids")).alias("head"), F.max(F.struct("l", "r", "ids")).alias("tail"), F.max("local").alias("cuts"))
    across = W.orderBy("part")  # as many rows as the sort has ranges
    before = F.lag("tail").over(across)
    new = before.isNull() | (before["l"] != F.col("head.l")) | (common_prefix(before["ids"], F.col("head.ids")) < F.col("head.l"))
    ends = ends.withColumn("new", new.cast("int"))
    ends = written(ends.select("part", (F.coalesce(F.sum(F.col("cuts") + F.col("new")).over(across.rowsBetween(W.unboundedPreceding, -1)), F.lit(0)) + F.col("new")).alias("base")), "ranges")
    numbered = written(rows.join(F.broadcast(ends), "part").select("r", "n", "first", "l", (F.col("base") + F.col("local")).alias("interval")), "numbered")
    least = written(numbered.groupBy("interval").agg(F.min("first").alias("origin"), F.count(F.lit(1)).alias("size")), "origins")
    found = join_hot(numbered.select("r", "n", "l", "interval"), least, ["interval"], "size")
    return written(found.groupBy("r", "n").agg(F.collect_list(F.struct("l", "origin")).alias("origins")), "intervals")


def later_copies(rows: DataFrame) -> DataFrame:
    """DOC, and the line ranges (first, last) of the maximal runs that have an earlier copy, merged."""
    suffixes = sequences(rows)
    starts = suffixes.where("n_min is not null").select(*PLACE, "ids", "spots", "n_min", "top")
    placed = written(starts.join(doubled(suffixes), PLACE), "placed")
    place = F.struct(*PLACE)
    array = placed.groupBy("r").agg(F.min(place).alias("first"), F.count(F.lit(1)).alias("n"), F.min("ids").alias("ids"), F.min("n_min").alias("n_min"), F.min("top").alias("top"))
    hits = join_hot(placed.select(*PLACE, "spots", "r"), intervals(array), ["r"], "n")
    longest = F.array_max(F.transform(F.filter("origins", lambda o: o["origin"] < place), lambda o: o["l"]))
    hits = hits.withColumn("l", longest).where("l is not null").select(*DOC, F.get("spots", F.lit(0)).alias("first"), F.get("spots", F.col("l") - 1).alias("last"))
    own = W.partitionBy(*DOC).orderBy("first", "last")
    before = F.max("last").over(own.rowsBetween(W.unboundedPreceding, -1))
    islands = hits.withColumn("new", F.coalesce((F.col("first") > before + 1).cast("int"), F.lit(1))).withColumn("island", F.sum("new").over(own))
    return outlives(islands.groupBy(*DOC, "island").agg(F.min("first").alias("first"), F.max("last").alias("last")).drop("island"), "copies")


def drop_repeated_lines(documents: DataFrame) -> DataFrame:
    """doc_id, text without later copies, n_lines, n_removed for every document."""
    rows = keyed(documents)
    with scratch(documents.sparkSession):
        ranges = later_copies(rows)
    gap = F.col("first") - F.coalesce(F.lag("last").over(W.partitionBy(*DOC).orderBy("first")), F.lit(-1)) - 1
    parts = F.array_sort(F.collect_list(F.struct("first", "gap", (F.col("last") - F.col("first") + 1).alias("gone"))))
    marks = F.flatten(F.transform("parts", lambda p: F.concat(F.array_repeat(F.lit(True), p["gap"]), F.array_repeat(F.lit(False), p["gone"]))))
    ranges = ranges.withColumn("gap", gap).groupBy(*DOC).agg(parts.alias("parts")).select(*DOC, marks.alias("stays"), F.aggregate("parts", F.lit(0), lambda a, p: a + p["gone"]).alias("removed"))
    lines = F.split("text", "\n")
    keep = F.filter(lines, lambda x, i: F.coalesce(F.get("stays", i), F.lit(True)))
    # the texts are shuffled at every size: how many documents have copies is not bounded
    return rows.join(ranges.hint("merge"), DOC, "left").select(
        "doc_id",
        F.when(F.col("stays").isNull(), F.col("text")).otherwise(F.array_join(keep, "\n")).alias("text"),
        F.when(F.col("text").isNull(), F.lit(0)).otherwise(F.size(lines)).cast("long").alias("n_lines"),
        F.coalesce("removed", F.lit(0)).cast("long").alias("n_removed"),
    )


def op9_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return drop_repeated_lines(table(spark, sf_dir, "documents", "doc_id", "text"))
