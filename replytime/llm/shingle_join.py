"""Exact Jaccard join of documents on five-word shingles, as a metric-space join.

The Jaccard distance d = 1 - J is a metric on sets.  Documents link when
J >= share (0.75), so when d <= radius (0.25).  Steps:

1.  One pass over the texts gives each document's distinct shingle hashes.
    Documents with equal sets are one class, a point of the metric space.
2.  Points far from all others leave.  A point with n shingles shares at least
    t = ceil(share * n) of them with any partner, so the k smallest common ones
    are among its n - t + k smallest by hash.  With k = n / 10 of either point,
    both hold at least t / 10 common shingles there.  These shingles are dealt by
    hash into bins, each bin finds those that two points hold, and points with
    too few go; then the same over all shingles of the points that stay (t of n).
    On text, nearly every distance is exactly 1, so this is the part of the
    space in which pivots tell nothing.
3.  Voronoi regions.  With shingles ordered rare first, two linked points have
    a common shingle among their first n - ceil(share * n) + 1.  The points that
    hold a shingle there form a region around its pivot, the most central
    point of them (largest mean frequency of its shingles).  A point is
    replicated into the regions of all its pivots, and its distance to each is
    computed.  Points within the radius of a pivot link to it.
4.  Two linked points have a region in common.  If both link to its pivot,
    they are connected.  Otherwise one of them, y, is outside the radius, and by
    the triangle inequality the other lies in the window |d(x) - d(y)| <= radius.
    So a region is divided again into rings of outside points by distance (of
    about RING points, by a hash beyond that), each ring gets the points of its
    window, in slices, and the cells are joined independently and exactly.
5.  Components of the links, as the smallest id.

Shingles that many documents of a bounded sample hold (``HOT`` of ``SAMPLE``) are
known to be shared and stay out of the bins, so no common passage gathers in
one task; the result does not depend on the sample.  Nothing is dropped or
capped.

Edge cases: null and empty texts, and texts without words, have no shingles
and link with nothing; rows that repeat an id or a text are points of one
class.  A null doc_id counts as no id: such a row never names a component.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import WORD_PATTERN, free_name, give_back, sample_by_hash, stored, tidy
from .components import components
from .shingles import set_key, shingle_sets

SHARE = (3, 4)
SAMPLE = 4096
HOT = 16
RING = 256
SLICE = 2048


def least_common(n: int, share: tuple[int, int] = SHARE) -> int:
    """Shingles that a set of n has in common with any partner, at least."""
    return -(-share[0] * n // share[1])


def _extra(n: int) -> int:
    """The k of step 2."""
    return max(1, n // 10)


def hot_shingles(docs: DataFrame, sample: int = SAMPLE, hot: int = HOT) -> np.ndarray:
    """Shingles that at least `hot` different sets of a bounded sample hold, ascending."""
    few = sample_by_hash(docs.select("doc_id", "text").where(F.col("text").isNotNull()),
                         F.xxhash64(F.col("doc_id"), F.lit(5)), sample)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sets = shingle_sets(batch.column(0).to_pylist())
            sizes = [len(s) for s in sets]
            keys = np.repeat(np.array([set_key(s) for s in sets], np.int64), sizes)
            flat = np.concatenate(sets) if sets else np.zeros(0, np.uint64)
            yield pa.RecordBatch.from_arrays([pa.array(flat.view(np.int64)), pa.array(keys)], names=["h", "key"])

    held = few.select("text").mapInArrow(tidy(run), "h long, key long").distinct()
    found = held.groupBy("h").agg(F.count("*").alias("n")).where(F.col("n") >= hot).select("h").collect()
    return np.sort(np.array([r[0] for r in found], np.int64).view(np.uint64))


def _bins(rows: DataFrame) -> int:
    """Bins of shingles: as many as the input has partitions, which grow with it."""
    return max(16, rows.rdd.getNumPartitions())


def _dealt(keys: list[int], held: list[np.ndarray], bins: int) -> list[tuple[int, bytes, bytes]]:
    """Rows (bin, shingle hashes, keys) of the given sets, dealt by hash."""
    if not held:
        return []
    flat = np.concatenate(held)
    owner = np.repeat(np.array(keys, np.int64), [len(s) for s in held])
    bin_of = (flat % np.uint64(bins)).astype(np.int64)
    order = np.argsort(bin_of, kind="stable")
    flat, owner, bin_of = flat[order], owner[order], bin_of[order]
    at = np.flatnonzero(np.r_[True, bin_of[1:] != bin_of[:-1]]) if len(flat) else np.zeros(0, int)
    ends = [*at[1:].tolist(), len(flat)]
    return [(int(bin_of[a]), flat[a:b].tobytes(), owner[a:b].tobytes()) for a, b in zip(at.tolist(), ends)]


#: Documents whose shingles are dealt in one go: their places fit two bytes.
GROUP = 1000


def _dealt_short(keys: list[int], held: list[np.ndarray], bins: int) -> list[tuple[int, bytes, bytes, bytes]]:
    """Rows (bin, upper hash halves, places of the keys, keys): 6 bytes a shingle and 8 a key that occurs in the bin.

    Half a hash within a bin may meet another's, which only lets a document
    stay that could have left: the next step compares whole hashes.
    """
    out = []
    for a in range(0, len(keys), GROUP):
        part = held[a:a + GROUP]
        flat = np.concatenate(part)
        place = np.repeat(np.arange(len(part), dtype=np.uint16), [len(s) for s in part])
        table = np.array(keys[a:a + GROUP], np.int64)
        bin_of = (flat % np.uint64(bins)).astype(np.int64)
        order = np.argsort(bin_of, kind="stable")
        half, place, bin_of = (flat[order] >> np.uint64(32)).astype(np.uint32), place[order], bin_of[order]
        at = np.flatnonzero(np.r_[True, bin_of[1:] != bin_of[:-1]]) if len(flat) else np.zeros(0, int)
        for b, e in zip(at.tolist(), [*at[1:].tolist(), len(flat)]):
            own = place[b:e]  # ascends
            new = np.r_[True, own[1:] != own[:-1]]
            out.append((int(bin_of[b]), half[b:e].tobytes(), (np.cumsum(new) - 1).astype(np.uint16).tobytes(),
                        table[own[new]].tobytes()))
    return out


POINTS = "doc_id long, n long, key long, hot long, bin long, hashes binary, places binary, keys binary"


def points(docs: DataFrame, hot: Broadcast, bins: int) -> DataFrame:
    """A row for each document (doc_id, n, key) and, beside them, rows of dealt shingles (bin, hashes, places, keys).

    Dealt are the smallest by hash that step 2 asks for, without hot ones,
    whose number is given with the document.
    """
    schema = pa.schema([(c.split()[0], pa.binary() if c.endswith("binary") else pa.int64())
                        for c in POINTS.split(", ")])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = hot.value
        for batch in batches:
            ids, sets = batch.column(0).to_pylist(), shingle_sets(batch.column(1).to_pylist())
            keys = [set_key(s) if len(s) else None for s in sets]
            out, seen, held = [], {}, []
            for i, key, s in zip(ids, keys, sets):
                if key is not None and key not in seen:
                    few = s[:len(s) - least_common(len(s)) + _extra(len(s))]
                    common = np.isin(few, known, assume_unique=True) if len(known) else np.zeros(len(few), bool)
                    seen[key] = int(common.sum())
                    held.append(few[~common])
                out.append((i, len(s), key, seen.get(key, 0), None, None, None, None))
            out += [(None, None, None, None, *r) for r in _dealt_short(list(seen), held, bins)]
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*out), schema)], schema=schema)

    return docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(tidy(run), POINTS)


def _shared(h: np.ndarray, k: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Hashes and keys of a bin that at least two keys hold, with the number of keys."""
    order = np.lexsort((k, h))
    h, k = h[order], k[order]
    once = np.r_[True, (h[1:] != h[:-1]) | (k[1:] != k[:-1])] if len(h) else np.zeros(0, bool)
    h, k = h[once], k[once]
    start = np.flatnonzero(np.r_[True, h[1:] != h[:-1]]) if len(h) else np.zeros(0, int)
    sizes = np.diff(np.r_[start, len(h)])
    df = np.repeat(sizes, sizes)
    many = df > 1
    return h[many], k[many], df[many]


def crowded(made: DataFrame) -> DataFrame:
    """Classes (key, n, rep) with enough shared shingles among the smallest; made by points()."""

    def count(pdf: pd.DataFrame) -> pd.DataFrame:
        h = np.frombuffer(b"".join(pdf["hashes"]), np.uint32)
        k = np.concatenate([np.frombuffer(keys, np.int64)[np.frombuffer(places, np.uint16)]
                            for places, keys in zip(pdf["places"], pdf["keys"])])
        _, k, _ = _shared(h, k)
        key, n = np.unique(k, return_counts=True)
        give_back()
        return pd.DataFrame({"key": key, "c": n})

    dealt = made.where(F.col("bin").isNotNull()).select("bin", "hashes", "places", "keys")
    counts = dealt.groupBy("bin").applyInPandas(count, "key long, c long").groupBy("key").agg(F.sum("c").alias("c"))
    classes = made.where(F.col("key").isNotNull()).groupBy("key").agg(
        F.max("n").alias("n"), F.min("doc_id").alias("rep"), F.max("hot").alias("hot"))
    least = F.ceil(F.col("n") * SHARE[0] / SHARE[1])  # of any partner's size, too
    need = F.greatest(F.lit(1), F.floor(least / 10))
    enough = F.col("hot") + F.coalesce(F.col("c"), F.lit(0)) >= need
    return classes.join(counts, "key", "left").where(enough).select("key", "n", "rep")


def _texts_of(docs: DataFrame, few: DataFrame) -> DataFrame:
    """key, text of the documents that represent the classes in few."""
    spark = docs.sparkSession
    # few is far smaller than the texts: Spark's own runtime filter (a Bloom filter of the ids, put on the scan) keeps
    # the other texts out of the shuffle; it asks for a filter on the small side and skips sides that are too large
    spark.conf.set("spark.sql.optimizer.runtime.bloomFilter.applicationSideScanSizeThreshold", "16MB")
    none = F.lit(-(1 << 63) + 1)  # joins rows without an id; whose text it is, the key decides below
    ids = few.where(F.col("n") >= 1).select(F.coalesce("rep", none).alias("rep"), "key")
    texts = docs.select(F.coalesce(F.col("doc_id").cast("long"), none).alias("rep"), "text")
    return texts.join(ids, "rep").select("key", "text")


def profiles(docs: DataFrame, few: DataFrame, hot: Broadcast, bins: int) -> DataFrame:
    """key, n, own, score, first, shared: the points that may still have a partner.

    own: shingles no other point holds; shared: the others, ascending; first:
    those of them among the n - least_common(n) + 1 rarest; score: their mean
    root frequency over all n.
    """
    schema = pa.schema([("key", pa.int64()), ("n", pa.int64()), ("bin", pa.int64()), ("hashes", pa.binary()),
                        ("keys", pa.binary())])

    def deal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = hot.value
        for batch in batches:
            out, keys, held = [], [], []
            for key, s in zip(batch.column(0).to_pylist(), shingle_sets(batch.column(1).to_pylist())):
                if not len(s) or set_key(s) != key:
                    continue  # another text of a repeated id
                common = np.isin(s, known, assume_unique=True) if len(known) else np.zeros(len(s), bool)
                keys.append(key)
                held.append(s[~common])
                out.append((key, len(s), None, s[common].tobytes(), None))
            out += [(None, None, *r) for r in _dealt(keys, held, bins)]
            yield pa.RecordBatch.from_arrays(
                [pa.array(c, f.type) for c, f in zip(zip(*out), schema)] if out
                else [pa.array([], f.type) for f in schema], schema=schema)

    dealt = stored(_texts_of(docs, few).mapInArrow(tidy(deal), "key long, n long, bin long, hashes binary, keys binary"))

    def found(pdf: pd.DataFrame) -> pd.DataFrame:
        h, k, df = _shared(np.frombuffer(b"".join(pdf["hashes"]), np.uint64), np.frombuffer(b"".join(pdf["keys"]), np.int64))
        order = np.argsort(k, kind="stable")
        h, k, df = h[order], k[order], df[order]
        at = np.flatnonzero(np.r_[True, k[1:] != k[:-1]]) if len(k) else np.zeros(0, int)
        ends = [*at[1:].tolist(), len(k)]
        give_back()
        return pd.DataFrame({"key": k[at], "hashes": [h[a:b].tobytes() for a, b in zip(at.tolist(), ends)],
                             "df": [df[a:b].astype(np.int32).tobytes() for a, b in zip(at.tolist(), ends)]})

    bins_found = dealt.where(F.col("bin").isNotNull()).select("bin", "hashes", "keys").groupBy("bin").applyInPandas(
        found, "key long, hashes binary, df binary").withColumn("n", F.lit(None).cast("long"))
    bases = dealt.where(F.col("key").isNotNull()).select("key", "hashes", F.lit(None).cast("binary").alias("df"), "n")

    out_schema = pa.schema([("key", pa.int64()), ("n", pa.int64()), ("own", pa.int64()), ("score", pa.float64()),
                            ("first", pa.list_(pa.int64())), ("shared", pa.list_(pa.int64()))])

    def one(key: int, n: int, common: bytes, hashes: list[bytes], dfs: list[bytes]) -> tuple | None:
        known = np.frombuffer(common, np.uint64)
        h = np.r_[np.frombuffer(b"".join(hashes), np.uint64), known]
        df = np.r_[np.frombuffer(b"".join(dfs), np.int32).astype(np.int64), np.full(len(known), 1 << 30)]
        if len(h) < least_common(n):
            return None  # no partner
        own = n - len(h)
        order = np.lexsort((h, df))[:max(0, n - least_common(n) + 1 - own)]
        score = float(np.sqrt(np.minimum(df, 1 << 20)).sum() / n)
        return key, n, own, score, h[order].view(np.int64), np.sort(h).view(np.int64)

    def gather(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """The rows of a key follow one another."""
        now, n, common, hashes, dfs = None, 0, b"", [], []

        def full(rows: list[tuple]) -> None:
            made = one(now, n, common, hashes, dfs) if now is not None else None
            if made:
                rows.append(made)

        for last in (False, True):
            for batch in batches if not last else [None]:
                rows: list[tuple] = []
                if last:
                    full(rows)
                else:
                    for key, h, df, size in zip(*(batch.column(k).to_pylist() for k in range(4))):
                        if key != now:
                            full(rows)
                            now, n, common, hashes, dfs = key, 0, b"", [], []
                        if size is not None:  # a repeated id gives equal bases
                            n, common = size, h
                        else:
                            hashes.append(h)
                            dfs.append(df)
                if rows:
                    yield pa.RecordBatch.from_arrays(
                        [pa.array(c, f.type) for c, f in zip(zip(*rows), out_schema)], schema=out_schema)

    rows = bins_found.select("key", "hashes", "df", "n").unionByName(bases)
    return rows.repartition("key").sortWithinPartitions("key").mapInArrow(
        tidy(gather), "key long, n long, own long, score double, first array<long>, shared array<long>")


def _linked(common, n_a, n_b):
    return SHARE[1] * common >= SHARE[0] * (n_a + n_b - common)


def pivot_distances(near: DataFrame) -> DataFrame:
    """x, pivot, common, n_x, n_p of each point and each pivot of its regions."""
    held = near.select("key", "score", F.explode("first").alias("h"))
    pivots = held.groupBy("h").agg(F.max(F.struct("score", "key")).alias("p"), F.count("*").alias("m")).where(
        F.col("m") > 1).select("h", F.col("p.key").alias("pivot"))
    pairs = held.join(pivots, "h").where(F.col("key") != F.col("pivot")).select(
        F.col("key").alias("x"), "pivot").distinct()
    left = near.select(F.col("key").alias("x"), F.col("n").alias("n_x"), F.col("shared").alias("sx"))
    right = near.select(F.col("key").alias("pivot"), F.col("n").alias("n_p"), F.col("shared").alias("sp"))
    return pairs.join(left, "x").join(right, "pivot").select(
        "x", "pivot", F.size(F.array_intersect("sx", "sp")).cast("long").alias("common"), "n_x", "n_p")


def ring_links(near: DataFrame, dist: DataFrame) -> DataFrame:
    """a, b: links in which one point lies outside the radius of the region's pivot."""
    radius = 1.0 - SHARE[0] / SHARE[1]
    union = F.col("n_x") + F.col("n_p") - F.col("common")
    d = dist.select("x", "pivot", (1.0 - F.col("common") / union).alias("d"),
                    _linked(F.col("common"), F.col("n_x"), F.col("n_p")).alias("inside"))
    tally = d.groupBy("pivot").agg(F.count(F.when(~F.col("inside"), 1)).alias("outer"), F.count("*").alias("all"),
                                   F.min(F.when(~F.col("inside"), F.col("d"))).alias("nearest")).where(
        F.col("outer") > 0)
    # rings of equal width beyond the radius; a ring with many points is split by a hash, its window sliced
    rings = F.greatest(F.lit(1), F.ceil(F.col("outer") / RING))
    width = (1.0 - radius) / rings
    region = d.join(tally.select("pivot", "all", "outer", "nearest", width.alias("width"), rings.alias("rings")), "pivot")
    ring_of = F.least(F.floor((F.col("d") - radius) / F.col("width")), F.col("rings") - 1)
    outer = region.where(~F.col("inside")).withColumn("ring", F.greatest(F.lit(0).cast("long"), ring_of))
    filled = outer.groupBy("pivot", "ring").agg(
        F.ceil(F.count("*") / RING).alias("parts"), F.min("d").alias("low"), F.max("d").alias("high"),
        F.max("all").alias("all")).withColumn("slices", F.ceil(F.col("all") / SLICE))
    slack = radius + 1e-9
    ys = outer.select("x", "pivot", "ring").join(filled, ["pivot", "ring"]).select(
        "pivot", "ring", F.pmod(F.xxhash64("x", F.lit(1)), "parts").alias("part"),
        F.explode(F.sequence(F.lit(0).cast("long"), F.col("slices") - 1)).alias("slice"), F.lit(True).alias("y"), "x")
    # only points that can reach a ring's window go on: close to the pivot, most are out of reach
    reach = region.where(F.col("d") >= F.col("nearest") - slack).select("pivot", "x", "d")
    xs = reach.join(filled, "pivot").where(
        (F.col("d") >= F.col("low") - slack) & (F.col("d") <= F.col("high") + slack)).select(
        "pivot", "ring", F.explode(F.sequence(F.lit(0).cast("long"), F.col("parts") - 1)).alias("part"),
        F.pmod(F.xxhash64("x", F.lit(2)), "slices").alias("slice"), F.lit(False).alias("y"), "x")
    cells = ys.unionByName(xs).join(near.select(F.col("key").alias("x"), "n", "own", "shared"), "x")

    def join(pdf: pd.DataFrame) -> pd.DataFrame:
        y, x = pdf[pdf["y"]], pdf[~pdf["y"]]
        a, b = [], []
        if len(y) and len(x):
            sets = [np.asarray(s, np.int64) for s in y["shared"]]
            flat = np.concatenate(sets)
            owner = np.repeat(np.arange(len(sets)), [len(s) for s in sets])
            order = np.argsort(flat, kind="stable")
            flat, owner = flat[order], owner[order]
            n_y, key_y = y["n"].to_numpy(), y["x"].to_numpy()
            for key, n, s in zip(x["x"], x["n"], x["shared"]):
                s = np.asarray(s, np.int64)
                low, high = np.searchsorted(flat, s, "left"), np.searchsorted(flat, s, "right")
                many = high - low
                total = int(many.sum())
                if not total:
                    continue
                at = np.arange(total) - np.repeat(np.cumsum(many) - many, many) + np.repeat(low, many)
                common = np.bincount(owner[at], minlength=len(sets))
                hit = np.flatnonzero(_linked(common, n, n_y) & (key_y != key))
                a += [key] * len(hit)
                b += key_y[hit].tolist()
        return pd.DataFrame({"a": np.array(a, np.int64), "b": np.array(b, np.int64)})

    return cells.groupBy("pivot", "ring", "part", "slice").applyInPandas(join, "a long, b long")


def _groups(docs: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Documents (doc_id, n, key) and classes (key, rep, g): g names the class's component."""
    hot = docs.sparkSession.sparkContext.broadcast(hot_shingles(docs))
    bins = _bins(docs)
    made = stored(points(docs, hot, 2 * bins))
    few = stored(crowded(made))
    near = stored(profiles(docs, few, hot, bins))
    dist = stored(pivot_distances(near))
    inside = dist.where(_linked(F.col("common"), F.col("n_x"), F.col("n_p"))).select(
        F.col("x").alias("a"), F.col("pivot").alias("b"))
    group = components(inside.unionByName(ring_links(near, dist)))
    own = made.where(F.col("n").isNotNull()).select("doc_id", "n", "key")
    reps = own.where(F.col("key").isNotNull()).groupBy("key").agg(F.min("doc_id").alias("rep"))
    return own, reps.join(group.withColumnRenamed("node", "key"), "key", "left").select(
        "key", "rep", F.coalesce("component", "key").alias("g"))


def shingle_join(docs: DataFrame) -> DataFrame:
    """doc_id, n_shingles, component_id of every document (doc_id, text)."""
    own, classes = _groups(docs)
    ids = classes.groupBy("g").agg(F.min("rep").alias("component_id"))
    names = classes.join(ids, "g").select("key", "component_id")
    return own.join(names, "key", "left").select(
        "doc_id", F.col("n").alias("n_shingles"), F.coalesce("component_id", "doc_id").alias("component_id"))


def one_of_each(docs: DataFrame) -> DataFrame:
    """The documents without near copies: of each component, the document with the smallest id stays.

    All columns are kept.  Documents without shingles all stay.  Of rows that
    repeat an id and a text, one stays.
    """
    _, classes = _groups(docs.select("doc_id", "text"))
    best = classes.groupBy("g").agg(F.min(F.struct(F.col("rep").isNull(), "rep", "key")).alias("b"))
    rep, key, own, row = (free_name(docs, name) for name in ("rep", "key", "own_key", "row"))
    kept = best.select(F.col("b.rep").alias(rep), F.col("b.key").alias(key))

    def run(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for texts in batches:
            yield pd.Series([set_key(s) if len(s) else None for s in shingle_sets(texts.tolist())], dtype="Int64")

    @F.pandas_udf("long")
    def key_of(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        yield from tidy(run)(batches)

    worded = F.coalesce("text", F.lit("")).rlike(WORD_PATTERN)
    keyed = docs.where(worded).withColumn(own, key_of(F.col("text")))
    same = keyed["doc_id"].cast("long").eqNullSafe(kept[rep]) & (keyed[own] == kept[key])
    # of equal rows each task sends one on
    first = F.min_by(F.struct(*docs.columns), F.xxhash64(*docs.columns)).alias(row)
    one = keyed.join(kept, same).groupBy(rep, own).agg(first).select(f"{row}.*")
    return docs.where(~worded).unionByName(one)
