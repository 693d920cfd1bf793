r"""Phrase collocations by SETM relational mining.

Texts are lower-cased (A-Z), cut at ``[.,;:!?\x0A-\x0D]`` into pieces and those into
words ``[^\x20\x09]+``.  A phrase of 2 to ``longest`` words that occurs ``least`` times
or more in a language is a candidate; its score is the lowest
``floor(1000 * a * n / (l * r))`` over its cuts.

Method.  The occurrence relation of length k holds a row (document, position,
group) for every place where a frequent phrase (group) of k words begins.
Positions count words and skip one at every border of a piece, so neighbours in
position are neighbours in a piece.  A relation is persisted as a table
bucketed and sorted by document and position.  Two of its rows at adjacent
positions, found by a merge join without an exchange, are the occurrences of
length k + 1; they are counted by their two groups, the groups below ``least``
go, and the occurrences are semi-joined with the groups that stay before they
are extended.  A group remembers the two groups it was made of, so the counts
of both parts of every cut come from the group tables alone.

A group table is broadcast only when its counted rows and bytes are small;
otherwise the join is left to Spark and the rows are dealt by document again.

Edge cases: a null text has no words, a null lang is ``und`` (as is a lang of
that name); ids are not used, so null or repeated ids and repeated rows count as rows of their
own.  Empty tables and texts give no phrases.  Scores are exact while
``1000 * a * n`` and ``l * r`` stay below 10**38.
"""

from __future__ import annotations

import string
import uuid
from contextlib import contextmanager

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from replytime.session import ensure_checkpoint_dir

from .common import session_settings, stored

#: Borders of pieces; each becomes a line feed.
BORDERS = ".,;:!?\n\x0b\x0c\r"
#: Words of one bucket of an occurrence relation, about; Spark allows 100,000 buckets.
BUCKET_WORDS = 4_000_000
MOST_BUCKETS = 100_000
#: A group table of more rows or more bytes of text is not broadcast.
SMALL_ROWS = 2_000_000
SMALL_BYTES = 64_000_000


def word_column(text: Column) -> Column:
    """Array of the words of a text, with a line feed between pieces (and maybe empty words at the ends)."""
    lowered = F.translate(F.coalesce(text, F.lit("")), string.ascii_uppercase + BORDERS + "\t",
                          string.ascii_lowercase + "\n" * len(BORDERS) + " ")
    return F.split(F.replace(lowered, F.lit("\n"), F.lit(" \n ")), " +")


def _words(docs: DataFrame) -> DataFrame:
    """The table with a row for every word and its position; borders take a position and give no row."""
    others = [c for c in docs.columns if c != "text"]
    return docs.select(*others, F.posexplode(word_column(F.col("text"))).alias("pos", "word")).where(
        ~F.col("word").isin("", "\n"))


@contextmanager
def _relations(spark: SparkSession):
    """A database in the shared folder for the occurrence relations; it goes with its tables at the end."""
    name = f"setm_{uuid.uuid4().hex}"
    spark.sql(f"CREATE DATABASE {name} LOCATION '{ensure_checkpoint_dir(spark).rstrip('/')}/{name}'")
    try:
        # buckets by document serve joins by document and position
        with session_settings(spark, {"spark.sql.requireAllClusterKeysForCoPartition": "false"}):
            yield name
    finally:
        spark.sql(f"DROP DATABASE IF EXISTS {name} CASCADE")


def _persist(rows: DataFrame, name: str, buckets: int) -> DataFrame:
    """Occurrences (doc, pos, g) as a table bucketed and sorted by document and position."""
    rows.write.format("parquet").option("compression", "zstd").option("parquet.writer.version", "PARQUET_2_0").bucketBy(
        buckets, "doc").sortBy("doc", "pos").saveAsTable(name)
    return rows.sparkSession.table(name)


def _numbered(groups: DataFrame) -> DataFrame:
    """The groups, written once, each with a number of its own."""
    return stored(groups.withColumn("g", F.monotonically_increasing_id()))


def _is_small(groups: DataFrame, small_rows: int) -> bool:
    rows, size = groups.agg(F.count("*"), F.sum(F.octet_length("phrase"))).first()
    return rows <= small_rows and (size or 0) <= SMALL_BYTES


def _with_group(rows: DataFrame, groups: DataFrame, on: list[str], small: bool, buckets: int) -> DataFrame:
    """doc, pos, g of the occurrences whose group stays; the rows lie together by document."""
    found = rows.join(F.broadcast(groups) if small else groups, on).select("doc", "pos", "g")
    return found if small else found.repartition(buckets, "doc")


def _adjacent(relation: DataFrame) -> DataFrame:
    """Occurrences of the next length: doc, pos and the groups that begin here (left) and one word on (right)."""
    here = relation.withColumnRenamed("g", "left")
    there = relation.select("doc", (F.col("pos") - 1).alias("pos"), F.col("g").alias("right"))
    return here.join(there, ["doc", "pos"])


def _grown(counts: DataFrame, before: DataFrame) -> DataFrame:
    """Groups of the next length with their phrase and the counts of the first and last parts of their cuts."""
    left = before.select(F.col("g").alias("left"), "lang", F.col("phrase").alias("head"), F.col("a").alias("head_a"),
                         F.col("firsts").alias("head_firsts"))
    right = before.select(F.col("g").alias("right"), "last", F.col("a").alias("tail_a"), F.col("rests").alias("tail_rests"))
    return counts.join(left, "left").join(right, "right").select(
        "lang", F.concat_ws(" ", "head", "last").alias("phrase"), "last", "a", "left", "right",
        F.concat("head_firsts", F.array("head_a")).alias("firsts"),
        F.concat(F.array("tail_a"), "tail_rests").alias("rests"))


def mine(docs: DataFrame, least: int = 100, longest: int = 5, small_rows: int = SMALL_ROWS,
         bucket_words: int = BUCKET_WORDS) -> tuple[DataFrame, list[DataFrame]]:
    """Word counts of the languages, (lang, n), and the frequent groups of 1 to `longest` words.

    A group has lang, phrase, a (its count), g (its number), left and right (numbers of the groups of one
    word less that it begins and ends with), firsts and rests (counts of the parts of its cuts, the cut
    after the first word first).  Reads text and lang.
    """
    spark = docs.sparkSession
    texts = docs.select(F.coalesce(F.col("lang").cast("string"), F.lit("und")).alias("lang"), F.col("text").cast("string").alias("text"))
    counted = stored(_words(texts).groupBy("lang", "word").agg(F.count("*").alias("a")))
    sizes = stored(counted.groupBy("lang").agg(F.sum("a").alias("n")))
    none = F.array().cast("array<bigint>")
    groups = [_numbered(counted.where(F.col("a") >= least).select(
        "lang", F.col("word").alias("phrase"), F.col("word").alias("last"), "a", F.lit(None).cast("long").alias("left"),
        F.lit(None).cast("long").alias("right"), none.alias("firsts"), none.alias("rests")))]
    total = sizes.agg(F.sum("n")).first()[0] or 0
    buckets = max(1, min(MOST_BUCKETS, total // bucket_words))
    with _relations(spark) as database:
        small = _is_small(groups[0], small_rows)
        placed = texts.withColumn("doc", F.monotonically_increasing_id())
        words = _words(placed.repartition(buckets, "doc") if small else placed)
        first = groups[0].select("lang", F.col("phrase").alias("word"), "g")
        relation = _persist(_with_group(words, first, ["lang", "word"], small, buckets), f"{database}.length_1", buckets)
        for length in range(2, longest + 1):
            pairs = _adjacent(relation)
            counts = stored(pairs.groupBy("left", "right").agg(F.count("*").alias("a")).where(F.col("a") >= least))
            groups.append(_numbered(_grown(counts, groups[-1])))
            if length < longest:
                now = groups[-1]
                relation = _persist(_with_group(pairs, now.select("left", "right", "g"), ["left", "right"],
                                                _is_small(now, small_rows), buckets), f"{database}.length_{length}", buckets)
                spark.sql(f"DROP TABLE {database}.length_{length - 1}")
    return sizes, groups


def _scored(groups: DataFrame) -> DataFrame:
    """Adds the lowest cut: score, k, l, r (of equal scores the smallest k)."""
    exact = "decimal(38,0)"

    def cut(parts: Column, k: Column) -> Column:
        product = F.col("a").cast("decimal(18,0)") * F.col("n").cast("decimal(16,0)") * F.lit(1000).cast("decimal(4,0)")
        both = parts["firsts"].cast("decimal(18,0)") * parts["rests"].cast("decimal(18,0)")
        score = F.call_function("div", product.cast(exact), both.cast(exact))
        return F.struct(score.alias("score"), k.alias("k"), parts["firsts"].alias("l"), parts["rests"].alias("r"))

    lowest = F.array_min(F.transform(F.arrays_zip("firsts", "rests"), cut))
    return groups.withColumn("cut", lowest).select("*", "cut.l", "cut.r", "cut.score")


def collocations(docs: DataFrame, least: int = 100, longest: int = 5, top: int = 2000, share: int = 100, **sizes) -> DataFrame:
    """The first `top` phrases of each language: lang, rank, phrase, a, l, r, n, score.

    Dropped are candidates that lie inside a longer candidate with ``share`` hundredths of their count
    or more.  A phrase between the two is as frequent as the longer one at least, so it is enough to look at
    the candidates that are one word longer.
    """
    n, groups = mine(docs, least, longest, **sizes)
    kept = []
    for here, longer in zip(groups[1:], [*groups[2:], None]):
        if longer is not None:
            around = longer.select(F.col("left").alias("g"), F.col("a").alias("most")).unionAll(
                longer.select(F.col("right").alias("g"), F.col("a").alias("most")))
            here = here.join(around.groupBy("g").agg(F.max("most").alias("most")), "g", "left").where(
                F.col("most").isNull() | (100 * F.col("most") < share * F.col("a")))
        kept.append(_scored(here.join(n, "lang")).select("lang", "phrase", "a", "l", "r", "n", "score"))
    every = kept[0]
    for more in kept[1:]:
        every = every.unionAll(more)
    order = Window.partitionBy("lang").orderBy(F.col("score").desc(), F.col("a").desc(), F.col("phrase"))
    ranked = every.withColumn("rank", F.row_number().over(order).cast("long")).where(F.col("rank") <= top)
    return ranked.select("lang", "rank", "phrase", "a", "l", "r", "n", "score")
