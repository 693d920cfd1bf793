"""Exact cosine join of embeddings by pivots, within equal labels.

For unit vectors the chord |u - v| is a metric, and cosine >= c means a chord
of at most r = sqrt(2 - 2c).  Steps:

1.  Rows with equal label and equal components are one point.
2.  A cell (at first: a label) with more than CELL points is divided around
    PIVOTS of its points, drawn by hash.  A point's home is the part of its
    nearest pivot.  A point y has its match x in the part of pivot q only if
    |y - q| <= R + r, where R is the radius of the part, and if y's distance to
    the plane between its nearest pivot p and q is at most r:
    (|y - q|^2 - |y - p|^2) / (2 |p - q|) <= r.  Both follow from the triangle
    inequality; y is replicated into the parts that pass.
3.  The parts are cells and are divided again, so the number of cells grows with the
    points and a point only ever meets the PIVOTS of its own cells.  A pair meets
    once: points at home are replicated to parts of a later number only, replicas
    to all.  A cell whose parts would hold more than GROWTH times its rows
    (vectors without structure, all about equally far) stays whole.
4.  Cells are joined independently with double precision products.  A cell
    with many points is split by a hash: home points in parts, replicas and
    home points in slices, and every part meets every slice, so no task holds
    more than PART + SLICE points of a cell however many there are.
5.  A cell returns a row for each of its points that has a link there: the number
    of linked rows, and the smallest point that it reaches in the cell.  Pairs
    are never listed, so a family of near copies costs rows in proportion to
    its size.  The numbers add up to the links of a point (its own other rows
    included), the reached points are the links of which components are taken.

Edge cases: rows whose label or vector is null, or whose vector is empty, zero
or holds a null or non-finite component link with nothing; vectors of different
lengths do not compare.  Repeated rows with one vec_id count as rows of their
own.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import stored
from .components import components

CELL = 512
PIVOTS = 16
GROWTH = 2.5
#: Rows of a cell that are measured against its pivots in one task.
MEASURED = 2048
PART = 1024
SLICE = 4096


def usable(embedding: str = "embedding") -> Column:
    """Whether a vector has only finite components and is not zero."""
    e = F.col(embedding)
    finite = F.forall(e, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) != float("inf")))
    return F.coalesce(e.isNotNull() & finite & F.exists(e, lambda x: x != 0), F.lit(False))


def points(rows: DataFrame) -> DataFrame:
    """point (a hash), label, v (double components), copies, rep (smallest vec_id)."""
    v = F.transform("embedding", lambda x: x.cast("double") + F.lit(0.0))  # -0.0 becomes 0.0
    good = rows.where(F.col("label").isNotNull() & usable()).select("vec_id", "label", v.alias("v"))
    return good.groupBy("label", "v").agg(F.count("*").alias("copies"), F.min("vec_id").alias("rep"))


def _unit(v: np.ndarray) -> np.ndarray:
    scale = np.abs(v).max(axis=-1, keepdims=True)  # no overflow or underflow of the squares
    v = v / scale
    return v / np.sqrt((v * v).sum(axis=-1, keepdims=True))


CELLS = "g string, cell string, home boolean, point long, v array<double>, copies long"


def labels(pts: DataFrame) -> DataFrame:
    """CELLS with a cell for each label and length; v is the unit vector."""
    group = F.concat_ws(" ", F.col("label").cast("string"), F.size("v").cast("string"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            units = [_unit(np.array(v, float)) for v in batch.column(4).to_pylist()]
            columns = [*batch.columns[:4], pa.array(units, pa.list_(pa.float64())), batch.column(5)]
            yield pa.RecordBatch.from_arrays(columns, names=[c.split()[0] for c in CELLS.split(", ")])

    return pts.select(group.alias("g"), F.lit("").alias("cell"), F.lit(True).alias("home"), "point", "v", "copies").mapInArrow(
        run, CELLS)


def _distances(rows: DataFrame, pivots: DataFrame) -> DataFrame:
    """CELLS with at (number of the nearest pivot) and d (chords to all pivots of the cell, in their order)."""

    def measure(points_: pd.DataFrame, around: pd.DataFrame) -> pd.DataFrame:
        p = np.stack(around.sort_values("k")["pivot"].to_list())
        v = np.stack(points_["v"].to_list())
        d = np.sqrt(((v[:, None, :] - p[None, :, :]) ** 2).sum(axis=2)) if len(v) * p.size < 1 << 22 else np.stack(
            [np.sqrt(((v - x) ** 2).sum(axis=1)) for x in p], axis=1)
        return points_.drop(columns="bucket").assign(at=d.argmin(axis=1), d=list(d))

    sizes = pivots.groupBy("g", "cell").agg(F.first("buckets").alias("buckets"))
    dealt = rows.join(sizes, ["g", "cell"]).withColumn("bucket", F.pmod(F.xxhash64("point", "home", F.lit(4)), "buckets")).drop("buckets")
    sent = pivots.select("g", "cell", "k", F.col("v").alias("pivot"), F.explode(
        F.sequence(F.lit(0).cast("long"), F.col("buckets") - 1)).alias("bucket"))
    keys = ["g", "cell", "bucket"]
    return dealt.groupBy(*keys).cogroup(sent.groupBy(*keys)).applyInPandas(measure, CELLS + ", at long, d array<double>")


def _parts(measured: DataFrame, pivots: DataFrame, r: float) -> DataFrame:
    """CELLS of the parts: each point at home with its nearest pivot, and its replicas."""
    table = pivots.select("g", "cell", "k", "v")
    other = table.select("g", "cell", F.col("k").alias("k2"), F.col("v").alias("v2"))
    chord = F.sqrt(F.aggregate(F.zip_with("v", "v2", lambda x, y: (x - y) * (x - y)), F.lit(0.0), lambda s, x: s + x))
    between = table.join(other, ["g", "cell"]).groupBy("g", "cell", "k").agg(
        F.sort_array(F.collect_list(F.struct("k2", chord.alias("c")))).alias("row")).select(
        "g", "cell", F.col("k").alias("at"), F.col("row.c").alias("between"))
    radii = measured.where("home").groupBy("g", "cell", "at").agg(F.max(F.element_at("d", (F.col("at") + 1).cast("int"))).alias("radius"))
    radius = radii.groupBy("g", "cell").agg(F.map_from_entries(F.collect_list(F.struct("at", "radius"))).alias("radius"))
    here = measured.join(between, ["g", "cell", "at"]).join(radius, ["g", "cell"])
    near = F.element_at("d", (F.col("at") + 1).cast("int"))

    def goes(q: Column) -> Column:
        to = F.element_at("d", (q + 1).cast("int"))
        reach = F.col("radius")[q]
        plane = to * to - near * near <= 2 * F.element_at("between", (q + 1).cast("int")) * r + 1e-9
        other_side = reach.isNotNull() & (to <= reach + r) & plane
        return (F.col("home") & (q == F.col("at"))) | (other_side & (~F.col("home") | (q > F.col("at"))))

    to = F.filter(F.sequence(F.lit(0).cast("long"), F.size("d").cast("long") - 1), goes)
    return here.select("g", "cell", "home", "at", "point", "v", "copies", F.explode(to).alias("q")).select(
        "g", F.col("cell").alias("parent"), F.concat_ws("/", "cell", F.col("q").cast("string")).alias("cell"),
        (F.col("home") & (F.col("q") == F.col("at"))).alias("home"), "point", "v", "copies")


def divided(rows: DataFrame, cosine: float) -> DataFrame:
    """CELLS divided around pivots until a cell has at most CELL points or cannot be divided."""
    r = float(np.sqrt(max(0.0, 2 - 2 * cosine))) + 1e-9
    finished, level = [], 0
    now = stored(rows)
    while True:
        sizes = now.groupBy("g", "cell").agg(F.count("*").alias("n"), F.count(F.when(F.col("home"), 1)).alias("at_home"))
        large = stored(sizes.where((F.col("n") > CELL) & (F.col("at_home") > 1)).select("g", "cell", "n"))
        if large.isEmpty():
            return _union([*finished, now])
        finished.append(now.join(large, ["g", "cell"], "left_anti"))
        rest = now.join(large, ["g", "cell"])
        order = Window.partitionBy("g", "cell").orderBy(F.xxhash64("point", F.lit(level)), "point")
        pivots = stored(rest.where("home").withColumn("k", (F.row_number().over(order) - 1).cast("long")).where(
            F.col("k") < PIVOTS).select("g", "cell", "k", "v", F.ceil(F.col("n") / MEASURED).alias("buckets")))
        measured = stored(_distances(rest.drop("n"), pivots))
        parts = stored(_parts(measured, pivots, r))
        grown = parts.groupBy("g", F.col("parent").alias("cell")).agg(F.count("*").alias("m"))
        whole = stored(large.join(grown, ["g", "cell"]).where(F.col("m") > GROWTH * F.col("n")).select("g", "cell"))
        finished.append(rest.drop("n").join(whole, ["g", "cell"], "left_semi"))
        now = stored(parts.join(whole.withColumnRenamed("cell", "parent"), ["g", "parent"], "left_anti").drop("parent"))
        level += 1


def _union(tables: list[DataFrame]) -> DataFrame:
    every = tables[0]
    for t in tables[1:]:
        every = every.unionByName(t)
    return every


def blocks(cells: DataFrame) -> DataFrame:
    """Rows of both sides of every block: a cell's points at home in parts, all its points in slices."""
    many = cells.groupBy("g", "cell").agg(
        F.ceil(F.count(F.when(F.col("home"), 1)) / PART).alias("parts"), F.ceil(F.count("*") / SLICE).alias("slices"))
    split = cells.join(many, ["g", "cell"])
    part = F.pmod(F.xxhash64("point", F.lit(1)), "parts")
    piece = F.pmod(F.xxhash64("point", F.lit(2)), "slices")
    last = F.lit(0).cast("long")
    left = split.where("home").select("g", "cell", part.alias("part"), F.explode(
        F.sequence(last, F.col("slices") - 1)).alias("slice"), F.lit(True).alias("left"), "home", "point", "v", "copies")
    right = split.where("parts > 0").select("g", "cell", F.explode(F.sequence(last, F.col("parts") - 1)).alias("part"),
                                            piece.alias("slice"), F.lit(False).alias("left"), "home", "point", "v", "copies")
    return left.unionByName(right)


def _least_reached(linked: np.ndarray, kx: np.ndarray, ky: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Smallest key that each row and each column reaches through the links of a block."""
    lx, ly = kx.copy(), ky.copy()
    i, j = np.nonzero(linked)
    while len(i):
        before = lx.copy(), ly.copy()
        np.minimum.at(lx, i, ly[j])
        np.minimum.at(ly, j, lx[i])
        if (before[0] == lx).all() and (before[1] == ly).all():
            break
    return lx, ly


def block_links(x: pd.DataFrame, y: pd.DataFrame, cosine: float) -> pd.DataFrame:
    """a (point), b (smallest point it reaches here), n (rows it links to here) of a part against a slice.

    Home points stand on both sides, so a pair of them adds to the left one
    here and to the other where it stands left; a replica stands right only,
    so its pairs add to both.
    """
    kx, ky = x["point"].to_numpy(), y["point"].to_numpy()
    mx, my = np.stack(x["v"].to_list()), np.stack(y["v"].to_list())
    dots = mx @ my.T
    linked = (dots >= cosine) & (kx[:, None] != ky[None, :])
    # sums in another order may round across the limit: pairs next to it are summed again, one by one
    i, j = np.nonzero(np.abs(dots - cosine) < 1e-12)
    linked[i, j] = (np.einsum("ij,ij->i", mx[i], my[j]) >= cosine) & (kx[i] != ky[j])
    cx, cy = x["copies"].to_numpy(), y["copies"].to_numpy()
    replica = ~y["home"].to_numpy()
    nx, ny = linked @ cy, np.where(replica, cx @ linked, 0)
    lx, ly = _least_reached(linked, kx, ky)
    sx, sy = linked.any(axis=1), linked.any(axis=0)
    return pd.DataFrame({"a": np.r_[kx[sx], ky[sy]], "b": np.r_[lx[sx], ly[sy]], "n": np.r_[nx[sx], ny[sy]]})


def cell_links(dealt: DataFrame, cosine: float) -> DataFrame:
    """a, b, n of block_links for every part and slice of every cell."""

    def join(pdf: pd.DataFrame) -> pd.DataFrame:
        x, y = pdf[pdf["left"]], pdf[~pdf["left"]]
        if len(x) and len(y):
            return block_links(x, y, cosine)
        return pd.DataFrame({k: np.zeros(0, np.int64) for k in "abn"})

    return dealt.groupBy("g", "cell", "part", "slice").applyInPandas(join, "a long, b long, n long")


def vector_join(rows: DataFrame, cosine: float = 0.98) -> DataFrame:
    """vec_id, n_links, component_id, kept of every row (vec_id, embedding, label)."""
    rows = rows.select(F.col("vec_id").cast("long"), "embedding", "label")
    pts = points(rows)
    pts = stored(pts.withColumn("point", F.xxhash64("label", "v")))
    links = stored(cell_links(blocks(stored(divided(labels(pts), cosine))), cosine))
    linked = links.groupBy(F.col("a").alias("point")).agg(F.sum("n").alias("others"))
    group = components(links.select("a", "b")).withColumnRenamed("node", "point")
    named = pts.select("point", "label", "v", "copies", "rep").join(linked, "point", "left").join(
        group, "point", "left").withColumn("component", F.coalesce("component", "point"))
    ids = named.groupBy("component").agg(F.min("rep").alias("component_id"))
    facts = named.join(ids, "component").select(
        F.col("label").alias("label_p"), F.col("v").alias("v_p"), "component_id",
        (F.coalesce("others", F.lit(0)) + F.col("copies") - 1).alias("n"))
    good = F.col("label").isNotNull() & usable()
    keyed = rows.withColumn("w", F.when(good, F.transform("embedding", lambda x: x.cast("double") + F.lit(0.0))))
    found = keyed.join(facts, (keyed["label"] == facts["label_p"]) & (keyed["w"] == facts["v_p"]), "left")
    component = F.coalesce("component_id", "vec_id")
    return found.select("vec_id", F.coalesce("n", F.lit(0)).cast("long").alias("n_links"),
                        component.alias("component_id"), F.col("vec_id").eqNullSafe(component).alias("kept"))
