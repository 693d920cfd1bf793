"""Sharding by a k-d tree over document metadata, with shards of near equal bytes.

A document's size is the UTF-8 bytes of its text plus 1.  The tree is split at
weighted medians until its leaves reach the target bytes; the leaves are the shards.

Method.  Equal texts are one point (unit) of the tree; a group of copies that is
larger than a 64th of a leaf is dealt by a hash into parts below that size, so no
group is too big for a balanced split.  A unit's coordinates are metadata: smallest doc_id
of the group, size, language and source (names by their hash).  At every level
all nodes are split at once: the widest dimension is the one whose weighted
variance in the node is the largest share of its variance at the root, and the
weighted median along it is found by distributed selection.  Each round counts
the bytes of 4,096 equal intervals of the open range, takes the one that holds
the median, and goes on inside it until the interval holds one unit or less
than a 1,024th of a leaf.  Units that share a coordinate are told apart by a
hash below it, so ties do not unbalance a split.  A node of an odd number of
leaves is split in that proportion.  A document on the median that is itself larger
than that interval goes to the nearer side, and the median of the others is sought again.

Slots are numbered inside a shard by the input partition of a row and its place
there: offsets come from one count a (shard, partition), so no window holds a
whole shard.

Edge cases: a null text has size 1 and the checksum of the empty text; null
metadata have the lowest coordinate (a name: the hash of null); repeated rows are
rows of their own; an empty table gives no rows, and a table of fewer units
than shards leaves shards empty.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import free_name, stored

#: A unit holds at most this part of a leaf's bytes (one document may be larger), and this many rows.
UNITS_A_LEAF = 64
UNIT_ROWS = 100_000
#: Intervals of a selection round, as bits; bits of a coordinate and of the hash below it.
ROUND_BITS, PLACE_BITS, TIE_BITS = 12, 20, 42
#: An interval below this part of a leaf's bytes is not divided further.
SLACK = 1 / 1024
#: Units on the median of a node that may go to a side of their own.
PINS = 6
LAW = "bytes"


def doc_size(text: Column) -> Column:
    return (F.octet_length(F.coalesce(text, F.lit(""))) + 1).cast("long")


def text_crc32(text: Column) -> Column:
    return F.crc32(F.coalesce(text, F.lit("")).cast("binary"))


def name_place(name: str) -> Column:
    """Coordinate of a name."""
    return F.shiftrightunsigned(F.xxhash64(name), 64 - PLACE_BITS)


def units(rows: DataFrame, leaves: int) -> tuple[DataFrame, DataFrame]:
    """Rows with the part of their group (columns rid, g, size and coordinates), and the units (g, part)."""
    total = rows.agg(F.sum("size")).first()[0] or 0
    most = max(1, total // (leaves * UNITS_A_LEAF))
    groups = rows.groupBy("g").agg(F.sum("size").alias("w"), F.count("*").alias("n"))
    large = stored(groups.where((F.col("w") > most) & (F.col("n") > 1) | (F.col("n") > UNIT_ROWS)).select("g", F.ceil(
        F.greatest(F.col("w") / most, F.col("n") / UNIT_ROWS)).alias("parts")))
    parted = rows.join(large, "g", "left").withColumn(
        "part", F.coalesce(F.pmod(F.xxhash64("rid", F.lit(13)), F.col("parts")), F.lit(0).cast("long"))).drop("parts")
    names = [c for c in rows.columns if c.startswith("c_")]
    return parted, parted.groupBy("g", "part").agg(F.sum("size").alias("w"), *[F.min(c).alias(c) for c in names])


def placed(made: DataFrame) -> DataFrame:
    """Units with whole coordinates x_1, x_2, ... of PLACE_BITS and the tie-breaking hash, written once."""
    names = [c for c in made.columns if c.startswith("c_")]
    made = stored(made)
    ends = made.agg(*[f(c).cast("double").alias(f"{e}{c}") for c in names for e, f in (("lo_", F.min), ("hi_", F.max))]).first()
    cells = 2 ** PLACE_BITS - 2

    def place(c: str) -> Column:
        lo, width = ends[f"lo_{c}"] or 0.0, (ends[f"hi_{c}"] or 0.0) - (ends[f"lo_{c}"] or 0.0)
        part = (F.col(c).cast("double") - F.lit(lo)) / F.lit(width or 1.0)
        return F.coalesce(1 + F.floor(part * cells), F.lit(0)).cast("long")

    tie = F.shiftrightunsigned(F.xxhash64("g", "part", F.lit(7)), 64 - TIE_BITS)
    return made.select("g", "part", "w", tie.alias("tie"), *[place(c).alias(f"x_{k}") for k, c in enumerate(names)])


def _widest(tree: DataFrame, dims: int) -> DataFrame:
    """Of each node that is to be split: its bytes w, the dimension, and the bytes that go left (goal)."""
    def variance(k: int) -> Column:
        x, w = F.col(f"x_{k}").cast("double"), F.col("w").cast("double")
        mean = F.sum(w * x) / F.sum(w)
        return (F.sum(w * x * x) / F.sum(w) - mean * mean).alias(f"v{k}")

    spreads = [variance(k) for k in range(dims)]
    root = tree.agg(*spreads).first()
    nodes = tree.where(F.col("leaves") > 1).groupBy("node", "leaves").agg(F.sum("w").alias("bytes"), *spreads)
    # of equal shares the first dimension is the widest
    shares = [F.struct(F.round(F.col(f"v{k}") / F.lit(root[k]), 9).alias("share") if (root[k] or 0) > 0 else
                       F.lit(0.0).alias("share"), F.lit(-k).alias("k")) for k in range(dims)]
    wide = nodes.withColumn("dim", -F.array_max(F.array(*shares))["k"])
    return wide.select("node", "dim", (F.col("bytes") * F.floor(F.col("leaves") / 2) / F.col("leaves")).alias("goal"))


def _select(keyed: DataFrame, goals: DataFrame, enough: float) -> DataFrame:
    """Of each node (node, goal) the interval of keys that holds its weighted median.

    lo and step say where it is; below, w and n are the bytes under it and the bytes and units in it, key its least key.
    """
    bits = PLACE_BITS + TIE_BITS - ROUND_BITS
    state = goals.select("node", "goal", F.lit(0).cast("long").alias("lo"), F.lit(0).cast("long").alias("below"))
    while True:
        place = F.shiftright(F.col("key") - F.col("lo"), bits)
        bins = keyed.join(state, "node").where((F.col("key") >= F.col("lo")) & (place < 2 ** ROUND_BITS)).groupBy(
            "node", "goal", "lo", "below", place.alias("bin")).agg(
            F.sum("w").alias("w"), F.count("*").alias("n"), F.min("key").alias("key"))
        upto = F.col("below") + F.sum("w").over(Window.partitionBy("node").orderBy("bin"))
        reached = bins.withColumn("upto", upto).where(F.col("upto") >= F.col("goal"))
        first = F.min_by(F.struct("bin", "w", "n", "upto", "key"), "bin").alias("first")
        state = stored(reached.groupBy("node", "goal", "lo").agg(first).select(
            "node", "goal", (F.col("lo") + F.shiftleft("first.bin", bits)).alias("lo"), F.lit(2 ** bits).alias("step"),
            (F.col("first.upto") - F.col("first.w")).alias("below"), "first.w", "first.n", "first.key"))
        if bits == 0 or state.where((F.col("n") > 1) & (F.col("w") > enough)).isEmpty():
            return state
        state, bits = state.select("node", "goal", "lo", "below"), max(0, bits - ROUND_BITS)


def _cuts(keyed: DataFrame, chosen: DataFrame, enough: float) -> tuple[DataFrame, DataFrame]:
    """The cut of each chosen node (units whose key is below it go left), and the units that go to a side of their own.

    A unit on the median that is larger than `enough` goes to the nearer side, and the median of the other
    units is sought again so that both sides fill up; after PINS such units the rest stays uneven.
    """
    goals = chosen.select("node", "goal")
    pins = stored(keyed.limit(0).select("node", "key", F.lit(True).alias("goes_left")))
    for again in range(PINS + 1):
        state = _select(keyed.join(pins, ["node", "key"], "left_anti"), goals, enough)
        over = F.col("below") + F.col("w") - F.col("goal")
        short = F.col("goal") - F.col("below")
        left = over < short
        large = state.where((F.col("n") == 1) & (F.least(F.abs(over), F.abs(short)) > enough))
        if again == PINS or large.isEmpty():
            break
        found = large.select("node", "key", left.alias("goes_left"), "w")
        pins = stored(pins.unionAll(found.drop("w")))
        goals = stored(goals.join(found.where("goes_left").select("node", F.col("w").alias("taken")), "node", "left").select(
            "node", F.greatest(F.lit(0.0), F.col("goal") - F.coalesce("taken", F.lit(0))).alias("goal")))
    cut = F.when(left, F.col("lo") + F.col("step")).otherwise(F.col("lo"))
    made = chosen.select("node", "dim").join(state.select("node", cut.alias("cut")), "node", "left")
    # where the other units do not reach the goal, all of them go left
    return made.select("node", "dim", F.coalesce("cut", F.lit(2 ** (PLACE_BITS + TIE_BITS))).alias("cut")), pins


def key_of(dims: int) -> Column:
    """A unit's key along the dimension of its node: coordinate, then hash."""
    x = F.element_at(F.array(*[F.col(f"x_{k}") for k in range(dims)]), F.col("dim") + 1)
    return F.shiftleft(x, TIE_BITS) + F.col("tie")


def split(units_: DataFrame, leaves: int, slack: float = SLACK) -> DataFrame:
    """g, part and shard of every unit (columns g, part, w, tie, x_0, x_1, ...)."""
    dims = len([c for c in units_.columns if c.startswith("x_")])
    tree = stored(units_.withColumn("node", F.lit(0)).withColumn("leaves", F.lit(leaves)))
    enough = (tree.agg(F.sum("w")).first()[0] or 0) / leaves * slack
    depth = leaves
    while depth > 1:
        chosen = stored(_widest(tree, dims))
        keyed = tree.join(chosen.select("node", "dim"), "node").select("node", "w", key_of(dims).alias("key"))
        cuts, pins = _cuts(keyed, chosen, enough)
        half = F.floor(F.col("leaves") / 2).cast("int")
        # a leaf has no cut and stays
        left = F.col("cut").isNull() | F.coalesce("goes_left", F.col("key") < F.col("cut"))
        grown = tree.join(cuts, "node", "left").withColumn("key", key_of(dims)).join(pins, ["node", "key"], "left")
        tree = stored(grown.select(
            "g", "part", "w", "tie", *[f"x_{k}" for k in range(dims)],
            F.when(left, F.col("node")).otherwise(F.col("node") + half).alias("node"),
            F.when(F.col("cut").isNull(), F.col("leaves")).when(left, half).otherwise(F.col("leaves") - half).alias("leaves")))
        depth = (depth + 1) // 2
    return tree.select("g", "part", F.col("node").alias("shard"))


def shard(docs: DataFrame, leaves: int | None = 16, target_bytes: int | None = None,
          keep: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """The columns keep of the documents with size, text_crc32, law, shard, slot and grown_shard (null).

    There are `leaves` shards, or as many as hold `target_bytes` each.  Reads doc_id, text, lang and source.
    A kept column of one of the added names gives way to the operator's.
    """
    row = free_name(docs, "row")
    made = ["size", "text_crc32", "law", "shard", "slot", "grown_shard"]
    rows = stored(docs.select(
        F.struct(*keep).alias(row), F.monotonically_increasing_id().alias("rid"), doc_size(F.col("text")).alias("size"),
        text_crc32(F.col("text")).alias("text_crc32"), F.xxhash64("text").alias("g"),
        F.col("doc_id").try_cast("double").alias("c_id"), F.log2(doc_size(F.col("text"))).alias("c_size"),
        name_place("lang").alias("c_lang"), name_place("source").alias("c_source")))
    if target_bytes is not None:
        total = rows.agg(F.sum("size")).first()[0] or 0
        leaves = max(1, -(-total // target_bytes))
    parted, points = units(rows.drop(row), leaves)
    shards = split(placed(points), leaves)
    dealt = stored(parted.select("rid", "g", "part").join(shards, ["g", "part"]).select("rid", "shard"))
    source = F.shiftrightunsigned("rid", 33)
    counts = dealt.groupBy("shard", source.alias("from")).agg(F.count("*").alias("n"))
    earlier = Window.partitionBy("shard").orderBy("from").rowsBetween(Window.unboundedPreceding, -1)
    offsets = stored(counts.select("shard", "from", F.coalesce(F.sum("n").over(earlier), F.lit(0)).alias("offset")))
    here = dealt.withColumn("from", source).withColumn(
        "at", F.row_number().over(Window.partitionBy("shard", "from").orderBy("rid")) - 1)
    slots = here.join(offsets, ["shard", "from"]).select("rid", "shard", (F.col("offset") + F.col("at")).cast("long").alias("slot"))
    whole = rows.join(slots, "rid").withColumn("law", F.lit(LAW)).withColumn("grown_shard", F.lit(None).cast("int"))
    return whole.select(*[F.col(f"{row}.{c}") for c in keep if c.lower() not in made], *made)


def write_shards(docs: DataFrame, path: str, **sizes) -> None:
    """Writes whole documents as Parquet, a folder a shard, in the order of the slots."""
    dealt = shard(docs, keep=tuple(docs.columns), **sizes)
    dealt.repartition("shard", F.floor(F.col("slot") / UNIT_ROWS)).sortWithinPartitions("shard", "slot").write.partitionBy(
        "shard").parquet(path)
