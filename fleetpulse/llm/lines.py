"""Line dedup within one edit, by deletion neighbourhoods.

Lines are normalised (lower case, white space as single spaces, trimmed). Of lines that are equal, or
that differ by one inserted, deleted or replaced character, the earliest in the corpus stays: order is
by document id and line number. A line goes if any earlier line is within the bound, whether that one
stays or not. Lines shorter than ``least_length`` characters must be equal, since one edit changes too
much of them.

Two lines within one edit agree before and after some block of the longer one. So lines are first
keyed by what surrounds each of a few blocks, and only lines that share a key with a different line go
on. These suspects emit all variants with one character of the block deleted, as hashed keys. Equal
variants are joined: lines of one length that lose the same position are all within one edit of each
other, so each needs only the earliest of them; a variant equal to a whole shorter line joins with
that line. Found pairs are verified with the edit distance. Nothing lists the pairs of a group.

Defined results: a null text has no lines; lines without a word are neither counted nor dropped. Null
ids come last. Equal rows are separate documents, of which one, the same throughout a run, is the
earlier. An empty table gives an empty table. The document's own columns stay inside ``row``.
"""

from __future__ import annotations

from functools import reduce
from operator import or_

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from fleetpulse.llm.expressions import SPACES, whole
from fleetpulse.llm.store import stage

COARSE, FINE = 2, 8  # blocks of a line: for all lines, and for suspects


def normal(line: Column) -> Column:
    """Lower case, white space as single spaces, trimmed. Most lines have single spaces only and need no pattern."""
    wide = reduce(or_, [line.contains(x) for x in ("  ", "\t", "\x0b", "\x0c", "\r")])
    return F.trim(F.lower(F.when(wide, F.regexp_replace(line, SPACES, " ")).otherwise(line)))


def _surroundings(line: Column, blocks: int) -> list[tuple[Column, Column, int]]:
    """``(key, longest, block)`` for each block of the longer line (``longest`` characters) a partner may share.

    A line of n characters is the longer of the two (longest = n) or one shorter (longest = n + 1).
    """
    n = F.length(line)
    keys = []
    for more in (0, 1):
        longest = n + more
        for j in range(blocks):
            head, tail = F.floor(longest * j / blocks).cast("int"), longest - F.floor(longest * (j + 1) / blocks).cast("int")
            key = F.xxhash64(longest, F.lit(j), F.substring(line, F.lit(1), head), F.substring(line, n - tail + 1, tail))
            keys.append((key, longest, j))
    return keys


def _occurrences(docs: DataFrame, doc_id: str, text: str, least_length: int) -> DataFrame:
    """One row per line with a word: place in the corpus, hash of the normal line, coarse keys."""
    df = docs.select(
        F.monotonically_increasing_id().alias("rid"), docs[f"`{doc_id}`"].alias("id"), whole(docs[f"`{text}`"]).alias("__text"))
    df = df.select("rid", "id", F.xxhash64("__text").alias("tx"), F.posexplode(F.split("__text", "\n", -1)).alias("no", "line"))
    df = df.withColumn("line", normal(F.col("line"))).withColumn("n", F.length("line"))
    long = F.col("n") >= least_length
    # no higher-order function here: Spark interprets them row by row, with all they are given
    coarse = F.array(*[key for key, _, _ in _surroundings(F.col("line"), COARSE)])
    keys = F.when(long, coarse).otherwise(F.array().cast("array<bigint>"))
    return df.select(
        "rid", "id", "tx", "no", F.when(F.col("n") > 0, F.xxhash64("line", "n")).alias("h"), keys.alias("keys"))


def place(rid: str = "rid") -> Column:
    """Sorts by document id, nulls last, then by row and line."""
    return F.struct(F.col("id").isNull().alias("none"), F.col("id").alias("id"), F.col(rid).alias("rid"), F.col("no").alias("no"))


def _suspect_lines(docs: DataFrame, lines: DataFrame, doc_id: str, text: str) -> DataFrame:
    """Text of each line that shares a coarse key with a different line."""
    keyed = lines.where(F.size("keys") > 0).select("h", "id", "tx", F.explode("keys").alias("key"))
    shared = (
        keyed.groupBy("key").agg(F.min("h").alias("low"), F.max("h").alias("high"))
        .where(F.col("low") != F.col("high")).select("key")
    )
    # any one document with the line will do to fetch its text
    where = keyed.join(shared, "key", "left_semi").groupBy("h").agg(F.max(F.struct("tx", "id")).alias("d"))
    wanted = where.groupBy("d.tx", "d.id").agg(F.collect_set("h").alias("hs")).select(
        F.col("tx").alias("__tx"), F.col("id").alias("__wid"), "hs")
    texts = docs.select(docs[f"`{doc_id}`"].alias("__id"), whole(docs[f"`{text}`"]).alias("__text"))
    return (
        texts.withColumn("__hash", F.xxhash64("__text"))
        .join(wanted, (F.col("__hash") == F.col("__tx")) & F.col("__id").eqNullSafe(F.col("__wid")))
        .select("hs", F.explode(F.split("__text", "\n", -1)).alias("line"))
        .withColumn("line", normal(F.col("line"))).withColumn("n", F.length("line"))
        .withColumn("h", F.xxhash64("line", "n"))
        .where(F.array_contains("hs", F.col("h"))).select("h", "line", "n").dropDuplicates(["h"])
    )


def _partners(suspects: DataFrame, firsts: DataFrame) -> DataFrame:
    """``h`` and ``other``: for every line, the earliest lines that the variants bring up."""
    df = stage(suspects.join(firsts, "h"), "lines-suspects")
    around = [F.struct(key.alias("key"), longest.alias("longest"), F.lit(j).alias("block")) for key, longest, j in _surroundings(F.col("line"), FINE)]
    fine = df.select("h", F.explode(F.array(*around)).alias("k")).select("h", "k.*")
    shared = (
        fine.groupBy("key").agg(F.min("h").alias("low"), F.max("h").alias("high"))
        .where(F.col("low") != F.col("high")).select("key")
    )
    blocks = fine.join(shared, "key", "left_semi").groupBy("h", "longest").agg(F.collect_set("block").alias("blocks"))
    work = df.join(blocks, "h").select("h", "line", "n", "first", "longest", "blocks")
    # the longer line, or one of two of equal length: delete each position of its blocks
    spots = F.flatten(F.transform("blocks", lambda b: F.when(
        F.floor(F.col("longest") * (b + 1) / FINE) > F.floor(F.col("longest") * b / FINE),
        F.sequence((F.floor(F.col("longest") * b / FINE) + 1).cast("int"), F.floor(F.col("longest") * (b + 1) / FINE).cast("int")),
    ).otherwise(F.array().cast("array<int>"))))
    spots = F.array_distinct(spots)
    shorter = lambda p: F.concat(F.substring(F.col("line"), F.lit(1), p - 1), F.substring(F.col("line"), p + 1, F.col("n")))
    variants = F.transform(spots, lambda p: F.struct(p.alias("spot"), F.xxhash64(F.col("longest"), shorter(p)).alias("v")))
    longer = work.where(F.col("longest") == F.col("n")).select("h", "first", F.explode(variants).alias("x")).select("h", "first", "x.*")
    longer = stage(longer, "lines-variants")
    whole_line = work.where(F.col("longest") == F.col("n") + 1).select(
        "h", "first", F.xxhash64(F.col("longest"), F.col("line")).alias("v"))

    best = F.min(F.struct(F.col("first").alias("first"), F.col("h").alias("h"))).alias("best")
    replaced = longer.groupBy("v", "spot").agg(best, F.count("*").alias("m")).where(F.col("m") > 1)
    same = longer.join(replaced.select("v", "spot", F.col("best.h").alias("other")), ["v", "spot"]).select("h", "other")
    up = whole_line.select("v", F.col("h").alias("other")).join(longer.select("v", "h"), "v").select("h", "other")
    lost = longer.groupBy("v").agg(best).select("v", F.col("best.h").alias("other"))
    down = whole_line.join(lost, "v").select("h", "other")
    pairs = same.union(up).union(down).where(F.col("h") != F.col("other")).distinct()
    mine = df.select("h", F.col("line").alias("a"), F.col("first").alias("fa"))
    theirs = df.select(F.col("h").alias("other"), F.col("line").alias("b"), F.col("first").alias("fb"))
    return (
        pairs.join(mine, "h").join(theirs, "other")
        .where(F.col("fb") < F.col("fa"))
        .where(F.levenshtein("a", "b", 1).between(0, 1))
        .groupBy("h").agg(F.min(F.struct(F.col("fb").alias("first"), F.col("other").alias("other"))).alias("earlier"))
        .select("h", "earlier.other")
    )


def repeated_lines(docs: DataFrame, least_length: int = 20, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """One row per row of ``docs``: ``rid``, ``id``, ``tx`` (hash of the text), ``n_lines``, ``equal`` and
    ``near``: numbers, from 0, of the lines that go for an equal or for a near earlier line."""
    lines = stage(_occurrences(docs, doc_id, text, least_length), "lines-occurrences")
    known = lines.where(F.col("h").isNotNull())
    firsts = known.groupBy("h").agg(F.min(place()).alias("first"))
    firsts = stage(firsts, "lines-firsts")
    near = _partners(_suspect_lines(docs, lines, doc_id, text), firsts)
    marks = firsts.join(near, "h", "left").select("h", "first", F.col("other").isNotNull().alias("near"))
    # lines without a word have no hash and take no part in the join
    wordless = lines.where(F.col("h").isNull())
    judged = known.join(marks, "h").unionByName(wordless, allowMissingColumns=True).withColumn("mine", place())
    equal = F.col("h").isNotNull() & (F.col("mine") != F.col("first"))
    go = lambda c: F.sort_array(F.collect_list(F.when(c, F.col("no"))))
    return judged.groupBy("rid", "id", "tx").agg(
        F.count("h").alias("n_lines"), go(equal).alias("equal"), go(~equal & F.col("near")).alias("near"))


def without_lines(text: Column, gone: Column) -> Column:
    """The text without the lines of these numbers."""
    numbered = F.transform(F.split(whole(text), "\n", -1), lambda x, i: F.when(~F.array_contains(gone, i), x))
    return F.array_join(F.array_compact(numbered), "\n")
