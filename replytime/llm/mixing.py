r"""Mixing sources to target weights with a splitting tree over blocks.

Sizes are words (``[^\x20\x09-\x0D]+``).  Sources, by code point with null last,
weigh ``weights`` in turn and share all words; no target exceeds ``most`` times
its source, and the excess is shared anew by weight.

Method.  A hash of the id puts the documents of a source in a permuted order;
equal ranges of the hash are its blocks (``BLOCKS`` in all, shared by the number
of documents, one a source at least).  A source takes whole passes over its
blocks, then a prefix of the permuted blocks up to its exact quota; the block,
and in it the document, at which the quota ends is taken in part.  A
splitting tree then deals the block copies to the output shards: at every
node, the copies in an order drawn by hash, the first half goes left and the
rest right, so the numbers of each source on either side are multivariate
hypergeometric and no copy is dealt twice.  Rows of a shard are shuffled
locally by a hash.

All draws are hashes of ids and a seed: reruns agree.  Only sources and blocks
(bounded in number) meet in one window; documents are never ranked globally.

Edge cases: a null text has size 0; a source of size 0 has target 0; rows
that share an id share their place, and a part of them is shared in
proportion to size.  An empty table gives no rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import WORD_PATTERN, stored

BLOCKS = 4096
#: Parts into which the rows of a shard may be split between tasks.
SPLITS = 1024
SEED = 8


def n_words(text: Column) -> Column:
    """Number of words: each becomes one letter, white space goes."""
    marks = F.translate(F.regexp_replace(text, WORD_PATTERN, "x"), " \t\n\x0b\x0c\r", "")
    return F.coalesce(F.length(marks), F.lit(0)).cast("long")


def place(doc_id: Column, seed: int = SEED) -> Column:
    """The document's place in the permuted order."""
    return F.xxhash64(doc_id, F.lit(seed))


def block_of(at: Column, n_blocks: Column) -> Column:
    """The block (equal ranges of the hash) of a place."""
    unit = (at.cast("double") + F.lit(2.0 ** 63)) / F.lit(2.0 ** 64)
    return F.least(F.floor(unit * n_blocks), n_blocks - 1).cast("long")


def targets(sources: DataFrame, weights: tuple[int, ...] = (1, 2, 3), most: float = 3.0) -> DataFrame:
    """Adds target to sources (source, source_size): shares by weight under the cap.

    The sources are few; they are ranked in one window.
    """
    rank = F.row_number().over(Window.orderBy(F.col("source").asc_nulls_last())) - 1
    weight = F.element_at(F.array(*[F.lit(float(w)) for w in weights]), (rank % len(weights) + 1).cast("int"))
    everything = Window.partitionBy()
    capped = sources.withColumn("w", weight).withColumn("cap", most * F.col("source_size")).withColumn(
        "total", F.sum("source_size").over(everything).cast("double"))
    # in the order of cap / weight, sources are capped until the level of the rest is below their cap
    order = Window.orderBy(F.col("cap") / F.col("w"), F.col("source").asc_nulls_last())
    before = order.rowsBetween(Window.unboundedPreceding, -1)
    after = order.rowsBetween(Window.currentRow, Window.unboundedFollowing)
    level = (F.col("total") - F.coalesce(F.sum("cap").over(before), F.lit(0.0))) / F.sum("w").over(after)
    levels = capped.withColumn("level", level).withColumn("k", F.row_number().over(order))
    fits = F.when(F.col("level") * F.col("w") <= F.col("cap"), F.struct("k", "level"))
    final = levels.withColumn("final", F.min(fits).over(everything))
    free = F.col("k") >= F.col("final.k")
    return final.withColumn("target", F.when(free, F.col("final.level") * F.col("w")).otherwise(F.col("cap"))).drop(
        "w", "cap", "total", "level", "k", "final")


def _quotas(sized: DataFrame, weights: tuple[int, ...], most: float) -> DataFrame:
    """One row a source: sizes, target, passes, blocks and words beyond the passes."""
    per = sized.groupBy("source").agg(F.sum("size").alias("source_size"), F.count("*").alias("n_docs"))
    share = F.col("n_docs") * BLOCKS / F.sum("n_docs").over(Window.partitionBy())
    per = per.withColumn("n_blocks", F.greatest(F.lit(1), F.ceil(share)).cast("long"))
    goal = targets(per, weights, most)
    passes = F.when(F.col("source_size") > 0, F.floor(F.round(F.col("target") / F.col("source_size"), 9))).otherwise(0)
    goal = goal.withColumn("passes", passes.cast("long"))
    return goal.withColumn("rest", F.greatest(
        F.lit(0), F.round(F.col("target") - F.col("passes") * F.col("source_size"))).cast("long"))


def _by_source(left: DataFrame, right: DataFrame) -> DataFrame:
    """Join on source, null equal to null."""
    r = right.withColumnRenamed("source", "source_r")
    return left.join(r, left["source"].eqNullSafe(r["source_r"]), "left").drop("source_r")


def _ends(sized: DataFrame, quotas: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Blocks with their copies, and per source the place where its quota ends.

    Places below the end are taken once more; the rows at the end share
    ``part`` of their ``end_size`` words.
    """
    placed = _by_source(sized, quotas.select("source", "n_blocks", "rest", "passes")).withColumn(
        "block", block_of(F.col("at"), F.col("n_blocks")))
    blocks = placed.groupBy("source", "block", "rest", "passes").agg(F.sum("size").alias("words"))
    along = Window.partitionBy("source").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    blocks = stored(blocks.withColumn("before", F.coalesce(F.sum("words").over(along), F.lit(0))))
    last = blocks.where((F.col("before") < F.col("rest")) & (F.col("rest") <= F.col("before") + F.col("words"))).select(
        "source", F.col("block").alias("last"), (F.col("rest") - F.col("before")).alias("open"))
    # documents of the one block a source in which its quota ends
    inside = _by_source(placed.select("source", "block", "at", "size"), stored(last)).where(
        F.col("block") == F.col("last"))
    tied = inside.groupBy("source", "open", "at").agg(F.sum("size").alias("end_size"))
    along = Window.partitionBy("source").orderBy("at").rowsBetween(Window.unboundedPreceding, -1)
    tied = tied.withColumn("sofar", F.coalesce(F.sum("end_size").over(along), F.lit(0)))
    ends = tied.where((F.col("sofar") < F.col("open")) & (F.col("open") <= F.col("sofar") + F.col("end_size"))).select(
        "source", F.col("at").alias("end_at"), "end_size", (F.col("open") - F.col("sofar")).alias("part"))
    copies = blocks.withColumn("copies", F.col("passes") + (F.col("before") < F.col("rest")).cast("long")).select(
        "source", "block", "copies")
    return copies, ends


def deal(copies: DataFrame, levels: int = 4, seed: int = SEED) -> DataFrame:
    """Shards (2 ** levels) of each block copy, by the splitting tree: source, block, shards array."""
    tickets = copies.where(F.col("copies") > 0).select(
        "source", "block", F.explode(F.sequence(F.lit(1).cast("long"), F.col("copies"))).alias("copy")).withColumn(
        "node", F.lit(0))
    for k in range(levels):
        draw = F.xxhash64("source", "block", "copy", F.lit(seed * 100 + k))
        w = Window.partitionBy("node")
        rank = F.row_number().over(w.orderBy(draw, "source", "block", "copy"))
        left = F.ceil(F.count("*").over(w) / 2)
        tickets = tickets.withColumn("rank", rank).withColumn("left", left).select(
            "source", "block", "copy", (2 * F.col("node") + (F.col("rank") > F.col("left")).cast("int")).alias("node"))
    pair = F.array_sort(F.collect_list(F.struct("copy", "node")))  # at most four copies a block
    return tickets.groupBy("source", "block").agg(pair.alias("p")).select(
        "source", "block", F.col("p.node").alias("shards"))


def mix(docs: DataFrame, weights: tuple[int, ...] = (1, 2, 3), most: float = 3.0, levels: int = 4,
        seed: int = SEED, keep: tuple[str, ...] = ("doc_id", "source")) -> DataFrame:
    """The columns keep of the documents with size, source_size, target, taken (words) and shards (of their copies).

    Reads doc_id, source and text; keep may name a struct that holds a whole row.
    """
    made = ["size", "source_size", "target", "taken", "shards"]
    kept = list(keep)
    docs = docs.select(*dict.fromkeys([*kept, "doc_id", "source", "text"]))
    rows = docs.select(*dict.fromkeys([*kept, "doc_id", "source"]), n_words(F.col("text")).alias("size"), place(F.col("doc_id"), seed).alias("at__"))
    sized = stored(rows.select("source", "size", F.col("at__").alias("at")))
    quotas = stored(_quotas(sized, weights, most))
    copies, ends = _ends(sized, quotas)
    plan = stored(_by_source(quotas.select("source", "source_size", "target", "passes", "n_blocks"), ends))
    dealt = stored(deal(copies, levels, seed)).withColumnsRenamed({"source": "source_d", "block": "block_d"})
    here = _by_source(rows, plan).withColumn("block__", block_of(F.col("at__"), F.col("n_blocks")))
    more = F.when(F.col("at__") < F.col("end_at"), F.col("size")).when(
        F.col("at__") == F.col("end_at"), F.round(F.col("size") * F.col("part") / F.col("end_size")).cast("long")
    ).otherwise(F.lit(0).cast("long"))
    here = here.withColumn("taken", F.col("passes") * F.col("size") + F.least(F.col("size"), more))
    full = here.join(dealt, here["source"].eqNullSafe(dealt["source_d"]) & (here["block__"] == dealt["block_d"]), "left")
    shards = F.when(F.col("taken") > 0, F.slice("shards", 1, F.greatest(
        F.lit(1), F.ceil(F.col("taken") / F.col("size"))).cast("int"))).otherwise(F.array().cast("array<int>"))
    return full.withColumn("shards", shards).select(*dict.fromkeys([*kept, "doc_id"]), *made)


def draw(mixed: DataFrame, seed: int = SEED) -> DataFrame:
    """The rows of the mix: a document once for each copy, shuffled inside its shard.

    The copy that a quota cuts is taken whole if half of its words or more are
    taken, else not at all.  Adds the column shard.
    """
    number = F.when(F.col("size") > 0, F.floor(F.col("taken") / F.col("size") + 0.5)).otherwise(0).cast("int")
    rows = mixed.where(number > 0).select(*[c for c in mixed.columns if c != "shards"],
                                          F.posexplode(F.slice("shards", 1, number)).alias("copy__", "shard"))
    # a shard is written by as many tasks as the session's partitions allow: equal ranges of the shuffling hash
    mixed_up = F.xxhash64("doc_id", "copy__", F.lit(seed + 1))
    return rows.repartition("shard", F.pmod(mixed_up, F.lit(SPLITS))).sortWithinPartitions("shard", mixed_up).drop("copy__")
