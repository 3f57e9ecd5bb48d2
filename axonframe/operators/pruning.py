"""Iterative and score-based removal of streamlines."""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import StructField, StructType

from axonframe.functions.geometry import XYZ
from axonframe.functions.scan import CHUNK, cut_lineage, lookup, order_statistics, row_rank, settled, streamline_keys, subject
from axonframe.functions.sphere import FULL_DETAIL
from axonframe.operators.fields import binned_segments, smoothed_support
from axonframe.operators.geometry import endpoints, segments, streamline_length, trim_segments
from axonframe.operators.selection import ids, keep, mean_cloud_distance, puri_threshold

# --- topology-informed pruning -----------------------------------------------------


def tip_prune(
    pts: DataFrame,
    sel: DataFrame | None = None,
    voxel_mm: float = 1.0,
    iterations: int = 16,
    min_support: int = 1,
    max_unsupported: float = 0.0,
) -> DataFrame:
    """Repeatedly drop streamlines whose share of thinly visited voxels is too large.

    Each round rebuilds the visit density from the survivors and stops when nothing goes. Vertices are
    packed once, a row per piece of a streamline, and every round walks the pieces where they lie:
    visits are counted per voxel at once and are never written or moved, except those of streamlines
    of several pieces. Voxels are sparse rows, so there is no grid size to refuse.
    """
    keys = streamline_keys(pts)
    by = subject(pts)
    voxel = by + ["i", "j", "k"]
    size, share = max(float(voxel_mm), 1e-3), min(max(max_unsupported, 0.0), 1.0)
    packed = cut_lineage(_packed(keep(pts, sel)))
    current = packed.select(*keys).distinct()
    left = current.count()
    for _ in range(max(1, iterations)):
        if left == 0:
            break
        one = F.lit(1).alias("_one")
        corner = packed.groupBy(*by, one).agg(*[F.min(F.array_min(c)).alias(f"_min_{c}") for c in XYZ])
        placed = lookup(packed.select("*", one), corner, by + ["_one"], small=True)
        density = _walked(placed, size, by, distinct=False).groupBy(*voxel).agg(F.count("*").alias("_d"))
        thin = cut_lineage(density.filter(F.col("_d") <= min_support).select(*voxel, F.lit(1).alias("_thin")))
        few = thin.count() <= FEW
        touched = _walked(placed, size, keys, distinct=True)
        single = touched.filter(~F.col("_many")).select(*keys, "i", "j", "k")
        walked = single.unionByName(touched.filter("_many").select(*keys, "i", "j", "k").distinct())
        # A thin voxel has at most min_support visits, so the matched side cannot be hot.
        marked = walked.join(F.broadcast(thin), voxel, "left") if few else lookup(walked, thin, voxel, "left", spread=True)
        judged = marked.groupBy(*keys).agg(F.count("_thin").alias("_weak"), F.count("*").alias("_all"))
        current = cut_lineage(judged.filter(F.col("_weak") / F.col("_all") <= share).select(*keys))
        remaining = current.count()
        if remaining == left:
            break
        left = remaining
        packed = cut_lineage(lookup(packed, current, keys, "left_semi"))
    return current


#: Thin voxels that every task may hold.
FEW = 1 << 18


def _packed(pts: DataFrame) -> DataFrame:
    """A row per piece of ``CHUNK`` vertices of a streamline: arrays ``x, y, z`` in order, with the neighbours
    beyond both seams; ``_before``: the first one is such; ``_many``: the streamline has further pieces."""
    keys = streamline_keys(pts)
    home, seat = F.floor(F.col("point_idx") / CHUNK), F.pmod("point_idx", F.lit(CHUNK))
    seams = F.array_compact(F.array(home, F.when((seat == 0) & (home > 0), home - 1), F.when(seat == CHUNK - 1, home + 1)))
    vertex = F.struct("point_idx", *[F.col(c).cast("double").alias(c) for c in XYZ])
    rows = pts.select(*keys, vertex.alias("_v"), F.explode(seams).alias("_piece"))
    rows = rows.groupBy(*keys, "_piece").agg(F.sort_array(F.collect_list("_v")).alias("_v"))
    many = (F.col("_piece") > 0) | (F.element_at("_v", -1)["point_idx"] >= CHUNK)
    return rows.select(*keys, (F.col("_piece") > 0).alias("_before"), many.alias("_many"), *[F.col(f"_v.{c}").alias(c) for c in XYZ])


def _walked(placed: DataFrame, size: float, keys: list[str], distinct: bool) -> DataFrame:
    """``<keys>, _many, i, j, k``: a row each time that a piece enters a voxel, or for each voxel that it touches.

    The voxels are those of ``visits``.
    """
    rows = placed.select(*keys, "_many", "_before", *XYZ, *[f"_min_{c}" for c in XYZ])
    out = StructType([*(rows.schema[c] for c in (*keys, "_many")), StructField("_at", StructType.fromDDL("i array<int>, j array<int>, k array<int>"))])

    def sampled(a: np.ndarray, b: np.ndarray, t: np.ndarray) -> np.ndarray:
        return np.floor(a + (b - a) * t[:, None]).astype("int64")

    def walk(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            counts = batch["x"].value_lengths().to_numpy()
            row = np.repeat(np.arange(len(counts)), counts)
            p = np.stack([batch[c].flatten().to_numpy(zero_copy_only=False) for c in XYZ], 1)
            low = np.stack([batch[f"_min_{c}"].to_numpy(zero_copy_only=False) for c in XYZ], 1)
            p = (p - (low[row] - size)) * (1.0 / size)
            first = np.append(0, np.cumsum(counts))[:-1]
            # A segment starts at each vertex but the last of a piece, and but the one before the seam.
            starts = np.ones(len(p), bool)
            starts[(first + counts - 1)[counts > 0]] = False
            before = batch["_before"].to_numpy(zero_copy_only=False)
            starts[first[before & (counts > 0)]] = False
            steps = np.zeros(len(p))
            steps[:-1] = np.ceil(np.abs(p[1:] - p[:-1]).max(1))
            starts[:-1] &= np.isfinite(steps[:-1])
            lone = np.zeros(len(p), bool)
            lone[first[counts > 0]] = True
            at = np.flatnonzero(starts)
            n = steps[at].astype("int64") + 1
            seg = np.repeat(at, n)
            s = np.arange(len(seg)) - np.repeat(np.cumsum(n) - n, n)
            share = 1.0 / np.maximum(steps[seg], 1.0)
            cell = sampled(p[seg], p[seg + 1], s * share)
            # The sample before: of the same segment, or the last of the one before it.
            back = np.maximum(seg - 1, 0)
            known = ~lone[seg] & np.isfinite(steps[back])
            joint = known & (s == 0)
            prior = sampled(p[seg], p[seg + 1], (s - 1) * share)
            end = steps[back[joint]]
            prior[joint] = sampled(p[back[joint]], p[seg[joint]], end * (1.0 / np.maximum(end, 1.0)))
            moved = (cell != prior).any(1) | ((s == 0) & ~known)
            cell, owner = cell[moved], row[seg[moved]]
            if distinct and len(cell):
                order = np.lexsort((cell[:, 2], cell[:, 1], cell[:, 0], owner))
                cell, owner = cell[order], owner[order]
                new = np.append(True, (owner[1:] != owner[:-1]) | (cell[1:] != cell[:-1]).any(1))
                cell, owner = cell[new], owner[new]
            ends = pa.array(np.append(0, np.cumsum(np.bincount(owner, minlength=len(counts)))), pa.int32())
            lists = [pa.ListArray.from_arrays(ends, pa.array(cell[:, k].astype("int32"))) for k in range(3)]
            yield pa.RecordBatch.from_arrays([*(batch[c] for c in (*keys, "_many")), pa.StructArray.from_arrays(lists, ["i", "j", "k"])], out.names)

    found = rows.mapInArrow(walk, out)
    each = found.select(*keys, "_many", F.explode(F.arrays_zip("_at.i", "_at.j", "_at.k")).alias("_c"))
    return each.select(*keys, "_many", *[F.col("_c")[c].alias(c) for c in "ijk"])


# --- coherence score ----------------------------------------------------------------


def purifibre_score(
    pts: DataFrame,
    field: DataFrame,
    voxel_mm: float,
    trim: float = 0.1,
    smooth_deg: float = 15.0,
    detail: int = FULL_DETAIL,
    field_pts: DataFrame | None = None,
    binned: DataFrame | None = None,
) -> DataFrame:
    """ln(1 + weakest support) over the trimmed segments of each streamline as ``fico``.

    ``field`` is a direction field on the grid of ``field_pts`` (default: the same
    points). A streamline with no scoreable segment gets NaN. ``binned``: the written
    ``binned_segments`` of the points on that grid, if there are any.
    """
    keys = streamline_keys(pts)
    by = subject(pts, field)
    cell = by + ["i", "j", "k", "bin"]
    # Written before they are trimmed, so that neither the count of a streamline's segments nor the
    # branches below walk the points again.
    if binned is None:
        binned = cut_lineage(binned_segments(pts, voxel_mm, detail, field_pts))
    segs = trim_segments(binned, trim).filter(F.col("w") * F.col("w") >= 1e-10)
    # Equal (streamline, voxel, bin) rows add nothing to a minimum.
    distinct = cut_lineage(segs.select(*keys, "i", "j", "k", "bin").distinct())
    support = smoothed_support(field, distinct.select(*cell).distinct(), smooth_deg, detail)
    weakest = lookup(distinct, support, cell, spread=True).groupBy(*keys).agg(F.min("support").alias("_m"))
    fico = F.coalesce(F.log1p("_m"), F.lit(float("nan")))
    return ids(pts).join(weakest, keys, "left").select(*keys, fico.alias("fico"))


def purifibre(
    pts: DataFrame, field: DataFrame, voxel_mm: float, puri_fraction: float = 0.1, digits: int = 9, **options
) -> tuple[DataFrame, DataFrame]:
    """(scores of all streamlines, survivors at or above the cut).

    Scores are rounded to ``digits``, so supports that differ only by the order of a sum
    tie and the survivors do not depend on the partitioning.
    """
    scored = purifibre_score(pts, field, voxel_mm, **options)
    scored = cut_lineage(scored.withColumn("fico", F.round("fico", digits)))
    return scored, puri_threshold(scored, puri_fraction).select(*streamline_keys(pts), "fico")


# --- duplicates ---------------------------------------------------------------------


def exact_copies(pts: DataFrame) -> DataFrame:
    """(streamline, keeper) for streamlines equal point by point to one with a lower id.

    Candidates share two order-aware 64-bit signatures; the match is then verified vertex
    by vertex against the keeper, so a hash collision never drops a streamline.
    """
    by = subject(pts)
    keys = by + ["streamline_id"]
    vertex = ["point_idx", *XYZ]
    marks = pts.groupBy(*keys).agg(
        F.count("*").alias("_n"),
        F.bit_xor(F.xxhash64(*vertex)).alias("_h1"),
        F.bit_xor(F.xxhash64(F.lit(7), *vertex)).alias("_h2"),
    )
    sign = by + ["_n", "_h1", "_h2"]
    keepers = marks.groupBy(*sign).agg(F.min("streamline_id").alias("keeper"), F.count("*").alias("_copies"))
    keepers = keepers.filter(F.col("_copies") > 1).drop("_copies")
    pairs = lookup(marks, keepers, sign).filter(F.col("streamline_id") != F.col("keeper"))
    pairs = pairs.select(*keys, "keeper", "_n")
    originals = lookup(pts, keepers.select(*by, F.col("keeper").alias("streamline_id")), keys, "left_semi")
    originals = originals.select(*by, F.col("streamline_id").alias("keeper"), *vertex)
    same = lookup(lookup(pts.select(*keys, *vertex), pairs, keys), originals, by + ["keeper", *vertex])
    counted = same.groupBy(*keys, "keeper", "_n").agg(F.count("*").alias("_same"))
    return counted.filter(F.col("_same") == F.col("_n")).select(*keys, "keeper")


def remove_duplicates(
    pts: DataFrame,
    mode: str = "exact",
    tolerance_mm: float = 1.0,
    endpoint_tolerance_mm: float = 2.0,
    min_shared_voxel_fraction: float = 0.9,
) -> DataFrame:
    """Ids left after dropping duplicates; the lowest id of equals stays.

    ``exact``: same points in the same order. ``near`` (after ``exact``): a streamline goes
    if one with a lower id has the same endpoints (either way round) within the endpoint
    tolerance, lies within the tolerance on average, and at least the given fraction of the
    vertices of each lie within the tolerance of the other. Only distances count, so two copies
    are found wherever a grid happens to cut between them.

    Short streamlines are packed, a row each, and told by their whole shape; only those of more
    than ``PIECE`` vertices by signatures and vertex by vertex.
    """
    if mode not in ("exact", "near"):
        raise ValueError(f"unknown duplicate mode {mode!r}")
    keys = streamline_keys(pts)
    long_ones = cut_lineage(pts.groupBy(*keys).agg(F.count("*").alias("_n")).filter(F.col("_n") > PIECE).select(*keys))
    any_long = not long_ones.isEmpty()
    shapes = unique_shapes(lookup(pts, long_ones, keys, "left_anti") if any_long else pts)
    if any_long:
        copies = exact_copies(lookup(pts, long_ones, keys, "left_semi")).select(*keys)
        long_ones = long_ones.join(copies, keys, "left_anti")
    if mode == "exact":
        return shapes.select(*keys).unionByName(long_ones) if any_long else shapes.select(*keys)
    long_pts = keep(pts, cut_lineage(long_ones)) if any_long else None
    return without_near_copies(cut_lineage(shapes), long_pts, tolerance_mm, endpoint_tolerance_mm, min_shared_voxel_fraction)


def unique_shapes(pts: DataFrame) -> DataFrame:
    """``<keys>, x, y, z`` (arrays in order) of short streamlines: of those equal point by point the lowest id.

    One with a missing coordinate equals no other.
    """
    by, keys = subject(pts), streamline_keys(pts)
    rows = pts.groupBy(*keys).agg(
        F.sort_array(F.collect_list(F.struct("point_idx", *XYZ))).alias("_v"),
        F.max(F.col("x").isNull() | F.col("y").isNull() | F.col("z").isNull()).alias("_missing"),
    )
    alone = F.when(F.col("_missing"), F.col("streamline_id")).alias("_alone")
    rows = rows.select(*keys, alone, *[F.col(f"_v.{c}").alias(c) for c in XYZ])
    return rows.groupBy(*by, "_alone", *XYZ).agg(F.min("streamline_id").alias("streamline_id")).select(*keys, *XYZ)


#: Streamlines of a cell that all others are held against first, and how much more each later round takes.
LEADERS, MORE = 64, 16


def without_near_copies(
    shapes: DataFrame, long_pts: DataFrame | None, tolerance: float, end_tolerance: float, fraction: float
) -> DataFrame:
    """Ids without a near copy of a lower id, of short streamlines (``unique_shapes``) and the points of long ones.

    Candidates lie in one cell of the space of both endpoints. A streamline is in one cell, as a copy
    of others it is in every cell that its tolerance reaches, both ways round. The lowest ids of a
    cell are the first to be compared with; whoever copies one of them is done with, so a crowd of
    copies costs one short round, and only what is left meets the further ones. Short streamlines
    meet in blocks, whole; long ones meet by pairs and pieces.
    """
    by, keys = subject(shapes), streamline_keys(shapes)
    cell = 4.0 * max(float(end_tolerance), 1e-6)
    lists = [F.col(c).cast("array<double>").alias(c) for c in XYZ]
    short = shapes.select(*keys, *[F.struct(*[F.element_at(v, n).alias(c) for v, c in zip(lists, XYZ)]).alias(e) for n, e in ((1, "first"), (-1, "last"))])
    shapes = shapes.select(*keys, F.struct("streamline_id", *lists).alias("_shape"))
    ends, long_ones = short, None
    if long_pts is not None:
        long_pts = long_pts.withColumns({c: F.col(c).cast("double") for c in XYZ})
        long_ones = cut_lineage(endpoints(long_pts).select(*keys, "first", "last"))
        ends = cut_lineage(short.unionByName(long_ones))

    def at(end: str) -> list:
        return [F.col(end)[c] for c in XYZ]

    home = F.xxhash64(*[F.floor(v / cell) for v in at("first") + at("last")])
    open_ones = cut_lineage(ends.select(*keys, home.alias("_cell")))
    seats = None
    for one, other in (("first", "last"), ("last", "first")):
        side = ends.select(*keys, *[v.alias(f"_v{n}") for n, v in enumerate(at(one) + at(other))])
        for n in range(6):
            reach = [F.floor((F.col(f"_v{n}") + d * end_tolerance) / cell) for d in (-1, 1)]
            side = side.withColumn(f"_v{n}", F.explode(F.array_distinct(F.array(*reach))))
        side = side.select(*keys, F.xxhash64(*[f"_v{n}" for n in range(6)]).alias("_cell"))
        seats = side if seats is None else seats.unionByName(side)
    # A seat in a cell that nobody lives in meets nobody.
    homes, few = settled(open_ones.select(*by, "_cell").distinct())
    seats = lookup(seats, homes, by + ["_cell"], "left_semi", spread=True, small=few).distinct()
    ranked = cut_lineage(row_rank(seats, ["streamline_id"], "_rank", by + ["_cell"]))
    top = ranked.agg(F.max("_rank").alias("top")).first()["top"]
    longest = shapes.agg(F.max(F.size("_shape.x")).alias("n")).first()["n"]

    begin, size = 0, LEADERS * MORE
    while longest and top is not None and begin <= top:
        leaders = ranked.filter(F.col("_rank").between(begin, begin + size - 1))
        copies = _short_copies(open_ones, leaders, shapes, by, max(SHORT, min(8 * SHORT, VERTICES // longest)), tolerance, end_tolerance, fraction)
        open_ones = cut_lineage(open_ones.join(copies, keys, "left_anti"))
        begin, size = begin + size, size * MORE
    if long_ones is None:
        return open_ones.select(*keys)

    # Long ones on either side meet piece by piece.
    def close(a: str, b: str):
        d = [p - q for p, q in zip(at(a), at(b))]
        return d[0] * d[0] + d[1] * d[1] + d[2] * d[2] <= end_tolerance * end_tolerance

    def as_other(rows: DataFrame) -> DataFrame:
        return rows.select(*by, "_cell", *[F.col(c).alias(f"o_{c}") for c in ("streamline_id", "first", "last")])

    vertices = F.posexplode(F.arrays_zip(*[f"_shape.{c}" for c in XYZ])).alias("point_idx", "_v")
    pts = shapes.select(*keys, vertices).select(*keys, "point_idx", *[F.col("_v")[c].alias(c) for c in XYZ])
    pts = pts.unionByName(long_pts.select(*keys, "point_idx", *XYZ))
    begin, size = 0, LEADERS
    while top is not None and begin <= top:
        leaders = ranked.filter(F.col("_rank").between(begin, begin + size - 1))
        placed, first_ones = lookup(open_ones, ends, keys), lookup(leaders, ends, keys)
        met = lookup(placed, long_ones, keys, "left_semi").join(as_other(first_ones), by + ["_cell"]).unionByName(
            lookup(placed, long_ones, keys, "left_anti").join(as_other(lookup(first_ones, long_ones, keys, "left_semi")), by + ["_cell"])
        ).filter(F.col("o_streamline_id") < F.col("streamline_id"))
        met = met.filter((close("first", "o_first") & close("last", "o_last")) | (close("first", "o_last") & close("last", "o_first")))
        pairs = cut_lineage(met.select(*keys, F.col("o_streamline_id").alias("other")))
        if not pairs.isEmpty():
            copies = near_pairs(pts, pairs, tolerance, fraction).select(*keys).distinct()
            open_ones = cut_lineage(open_ones.join(copies, keys, "left_anti"))
        begin, size = begin + size, size * MORE
    return open_ones.select(*keys)


#: Short streamlines of one row at least, where there are as many, and the rows that a crowded cell is dealt to, if it can be.
SHORT, SPREAD = 4096, 64
#: Streamlines that all are held against at a time, cells of space told apart, distances held at a time, and vertices of a row.
STEP, CELLS, HELD, VERTICES = 512, 512, 1 << 16, 1 << 19


def _short_copies(open_ones: DataFrame, leaders: DataFrame, shapes: DataFrame, by: list[str], part: int, *limits: float) -> DataFrame:
    """Keys of the short ones of ``open_ones`` with a near copy of a lower id among the short ``leaders``.

    Both sides are packed, so two blocks of a cell meet in one row and its pairs are never rows. ``part``: streamlines of a row at most.
    """
    keys, cell = by + ["streamline_id"], by + ["_cell"]
    parts = leaders.groupBy(*cell).agg(F.ceil(F.count("*") / part).alias("_parts"))
    sizes = lookup(open_ones.groupBy(*cell).agg(F.count("*").alias("_n")), parts, cell)
    blocks = F.greatest(F.ceil(F.col("_n") / part), F.least(F.ceil(F.col("_n") / SHORT), F.ceil(SPREAD / F.col("_parts"))))
    sizes, few = settled(sizes.select(*cell, blocks.alias("_blocks")))
    open_ones = lookup(open_ones, sizes, cell, spread=True, small=few)
    open_ones = open_ones.select(*keys, "_cell", F.pmod(F.xxhash64("streamline_id"), F.col("_blocks")).alias("_block"))
    leaders = leaders.select(*keys, "_cell", F.floor(F.col("_rank") / part).alias("_part"))
    own = cut_lineage(open_ones.groupBy(*cell, "_block").agg(F.max("streamline_id").alias("_top")))
    others = cut_lineage(leaders.groupBy(*cell, "_part").agg(F.min("streamline_id").alias("_least")))
    met = cut_lineage(own.join(others, cell).filter("_least < _top").select(*cell, "_block", "_part"))

    def tasks(rows: DataFrame) -> int:
        return max(1, min(rows.count(), 2048))

    def packed(rows: DataFrame, name: str, keyed: DataFrame, out: str) -> DataFrame:
        """A row per block. Few blocks lie in a task, however few bytes they have once written."""
        rows = lookup(rows, shapes, keys).select(*cell, name, "_shape").repartition(tasks(keyed), *cell, name)
        return rows.groupBy(*cell, name).agg(F.sort_array(F.collect_list("_shape")).alias(out))

    # A row for each two blocks, however few bytes it has: they take long.
    n, at = tasks(met), [*cell, "_block", "_part"]

    def dealt_out(side: DataFrame, name: str, other: str) -> DataFrame:
        partners = met.groupBy(*cell, name).agg(F.collect_list(other).alias("_with"))
        rows = lookup(side, partners, [*cell, name])
        return rows.withColumn(other, F.explode("_with")).drop("_with").repartition(n, *at)

    first = dealt_out(packed(open_ones, "_block", own, "a"), "_block", "_part")
    second = dealt_out(packed(leaders, "_part", others, "b"), "_part", "_block")
    rows = first.join(second, at).select(*by, "a", "b")
    found = rows.mapInArrow(_block_copies(by, *limits), StructType([shapes.schema[c] for c in keys]))
    return found.distinct()


def _block_copies(by: list[str], tolerance: float, end_tolerance: float, fraction: float):
    """Two blocks of streamlines -> those of the first that are near copies of one of a lower id in the second.

    Space is cut into the cells that hold vertices of the first block. For each cell, bits tell the
    streamlines of the second that begin, end or come within the tolerance of it. The bits of a
    streamline's cells leave those that may be its originals, and only they are measured.
    """
    end2, slack = end_tolerance * end_tolerance, 1 + 1e-6

    def sides(shapes: pa.StructArray) -> tuple:
        """Ids, vertices, and first vertex and number of vertices of each."""
        ids_, *axes = shapes.flatten()
        starts = axes[0].offsets.to_numpy()
        flat = np.stack([v.flatten().to_numpy(zero_copy_only=False) for v in axes], 1)
        return ids_.to_numpy(), flat, starts[:-1] - starts[0], np.diff(starts)

    def which(side: tuple, fit: np.ndarray) -> np.ndarray:
        """Streamlines all of whose vertices fit."""
        return np.logical_and.reduceat(fit.all(1), side[2])

    def padded(side: tuple, which_: np.ndarray, width: int) -> np.ndarray:
        """Vertices of each, the last one repeated."""
        return side[1].take(side[2][which_][:, None] + np.minimum(np.arange(width), side[3][which_][:, None] - 1), 0)

    def ends(side: tuple, which_: np.ndarray) -> tuple:
        first = side[2][which_]
        return side[1].take(first, 0), side[1].take(first + side[3][which_] - 1, 0)

    def apart2(p: np.ndarray, q: np.ndarray) -> np.ndarray:
        dx, dy, dz = (p[..., k] - q[..., k] for k in range(3))
        return dx * dx + dy * dy + dz * dz

    def near(a: tuple, b: tuple, i: np.ndarray, j: np.ndarray) -> np.ndarray:
        """Which pairs are near copies; those of like sizes are measured together."""
        out = np.zeros(len(i), bool)
        wide = [2 ** np.ceil(np.log2(s[3])).astype(int) for s in (a, b)]
        kind = wide[0][i] * 4096 + wide[1][j]
        order = np.argsort(kind, kind="stable")
        for alike in np.split(order, np.flatnonzero(np.diff(kind[order])) + 1) if len(order) else []:
            m, n = divmod(int(kind[alike[0]]), 4096)
            for at in range(0, len(alike), max(1, HELD // (m * n))):
                some = alike[at : at + max(1, HELD // (m * n))]
                d2 = apart2(padded(a, i[some], m)[:, :, None], padded(b, j[some], n)[:, None])
                sides_ = [(np.sqrt(d2.min(2)), a[3][i[some]]), (np.sqrt(d2.min(1)), b[3][j[some]])]
                real = [np.arange(v.shape[1]) < c[:, None] for v, c in sides_]
                mean = np.where(real[0], sides_[0][0], 0.0).sum(1) / sides_[0][1]
                share = [((v <= tolerance) & r).sum(1) / c for (v, c), r in zip(sides_, real)]
                out[some] = (mean <= tolerance) & (np.minimum(*share) >= fraction)
        return out

    def cells_of(flat: np.ndarray, most: int) -> tuple:
        """The cell of each vertex, the bins of each cell, and the bounds of the bins along each axis."""
        size = max(tolerance, end_tolerance, 1e-6) / 4
        while True:
            bins = [np.unique(np.floor(flat[:, k] / size), return_inverse=True)[1] for k in range(3)]
            top = [int(x.max()) + 1 for x in bins]
            found, cell = np.unique((bins[0] * top[1] + bins[1]) * top[2] + bins[2], return_inverse=True)
            if len(found) <= most:
                break
            size *= 1.3 if len(found) < 4 * most else 2.0
        bounds = [(np.full(t, np.inf), np.full(t, -np.inf)) for t in top]
        for k in range(3):
            np.minimum.at(bounds[k][0], bins[k], flat[:, k])
            np.maximum.at(bounds[k][1], bins[k], flat[:, k])
        return cell, (found // (top[1] * top[2]), found // top[2] % top[1], found % top[2]), bounds

    def reached(bins: list, bounds: list, p: np.ndarray, limit: float) -> np.ndarray:
        """Which points may lie within the limit of some vertex of a cell; single precision, but never too few."""
        total = None
        for x, (low, high), v in zip(bins, bounds, p.T):
            gap = np.maximum(np.maximum(low[:, None] - v, v - high[:, None]), 0.0).astype("float32")
            gap *= gap
            total = gap[x] if total is None else np.add(total, gap[x], out=total)
        return total <= np.float32(limit * limit * slack)

    def marks(bins: tuple, bounds: list, b: tuple, js: np.ndarray) -> np.ndarray:
        """Bits by cell: the streamlines ``js`` (most vertices first) that begin, end or come within reach."""
        count = len(bins[0])
        bits = np.zeros((3, count, -(-len(js) // 64) * 8), "uint8")
        layers = [b[1].take(b[2][js[b[3][js] > n]] + n, 0) for n in range(int(b[3][js[0]]))]
        chunk = max(1, (1 << 17) // len(js))
        for c in range(0, count, chunk):
            some = [x[c : c + chunk] for x in bins]
            cover = np.zeros((len(some[0]), len(js)), bool)
            for p in layers:
                cover[:, : len(p)] |= reached(some, bounds, p, tolerance)
            for n, hit in enumerate([*(reached(some, bounds, p, end_tolerance) for p in ends(b, js)), cover]):
                bits[n, c : c + chunk, : -(-len(js) // 8)] = np.packbits(hit, axis=1, bitorder="little")
        return bits.view("uint64")

    def possible(cell: np.ndarray, need: int, first: np.ndarray, last: np.ndarray, cover: np.ndarray) -> np.ndarray:
        """Bits by streamline of equally many vertices: fitting ends, and at least ``need`` vertices within reach."""
        one, other = cell[:, 0], cell[:, -1]
        bits = (first[one] & last[other]) | (first[other] & last[one])
        if need == cell.shape[1]:
            for n in range(need):
                bits &= cover[cell[:, n]]
        elif need:
            # Vertices within reach are counted in binary, a digit a word.
            digits = [np.zeros_like(bits) for _ in range(cell.shape[1].bit_length())]
            for n in range(cell.shape[1]):
                carry = cover[cell[:, n]]
                for k in range((n + 1).bit_length()):
                    digits[k], carry = digits[k] ^ carry, digits[k] & carry
            more = np.zeros_like(bits)
            for k in reversed(range(len(digits))):
                if need >> k & 1:
                    bits = bits & digits[k]
                else:
                    more |= bits & digits[k]
                    bits = bits & ~digits[k]
            bits |= more
        return bits

    def grouped(a: tuple, open_: np.ndarray) -> tuple:
        """Open streamlines by number of vertices, with their cells and the number that must be within reach."""
        open_ = open_[np.argsort(a[3][open_], kind="stable")]
        counts = a[3][open_]
        starts = np.cumsum(counts) - counts
        own = np.repeat(a[2][open_] - starts, counts) + np.arange(counts.sum())
        cell, bins, bounds = cells_of(a[1][own], max(64, min(CELLS, len(own) // 4)))
        groups = []
        for n, at, m in zip(*np.unique(counts, return_index=True, return_counts=True)):
            enough = np.flatnonzero(np.arange(n + 1) / n >= fraction)
            if len(enough):
                groups.append((open_[at : at + m], cell[starts[at] :][: m * n].reshape(m, n), int(enough[0])))
        return groups, bins, bounds

    def copies(a: tuple, b: tuple) -> np.ndarray:
        left = which(a, np.isfinite(a[1]))
        known = which(b, ~np.isnan(b[1]))
        b = (b[0][known], b[1], b[2][known], b[3][known])
        at, held = 0, 0
        while at < len(b[0]):
            open_ = np.flatnonzero(left & (a[0] > b[0][at]))
            if not len(open_):
                break
            if not held or len(open_) < 0.7 * held:
                (groups, bins, bounds), held = grouped(a, open_), len(open_)
            # Few open ones are held against more at a time.
            step = STEP * max(1, min(8, SHORT // len(open_)))
            js = np.arange(at, min(at + step, len(b[0])))
            js, at = js[np.argsort(-b[3][js], kind="stable")], at + step
            bits = marks(bins, bounds, b, js)
            found = [(np.empty(0, int), np.empty(0, int))]
            for who, cell, need in groups:
                still = np.flatnonzero(left[who])
                words = possible(cell[still], need, *bits)
                row, word = np.nonzero(words)
                hit = np.flatnonzero(np.unpackbits(words[row, word].view("uint8"), bitorder="little"))
                row, word = row[hit // 64], word[hit // 64]
                found.append((who[still[row]], js[word * 64 + hit % 64]))
            i, j = (np.concatenate(v) for v in zip(*found))
            lower = b[0][j] < a[0][i]
            i, j = i[lower], j[lower]
            (p, q), (r, s) = ends(a, i), ends(b, j)
            close = [(apart2(p, u) <= end2) & (apart2(q, v) <= end2) for u, v in ((r, s), (s, r))]
            i, j = i[close[0] | close[1]], j[close[0] | close[1]]
            left[i[near(a, b, i, j)]] = False
        return a[0][which(a, np.isfinite(a[1])) & ~left]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for n in range(batch.num_rows):
                one = batch.slice(n, 1)
                with np.errstate(over="ignore"):
                    gone = copies(*(sides(one[c].flatten()) for c in "ab"))
                same = [one[c].take(pa.array(np.zeros(len(gone), "int64"))) for c in by]
                yield pa.RecordBatch.from_arrays([*same, pa.array(gone)], [*by, "streamline_id"])

    return run


#: Vertices of a piece; two pieces meet in one row.
PIECE = 128


def near_pairs(pts: DataFrame, pairs: DataFrame, tolerance: float, fraction: float) -> DataFrame:
    """Those of ``pairs(streamline_id, other)`` that lie within the tolerance, as a whole and for the
    given fraction of the vertices of each.

    Streamlines come in pieces with boxes. Of two streamlines only the pieces meet that may hold the
    nearest vertex of some vertex of the other, in one row and one array operation.
    """
    by = subject(pts)
    keys, pair = by + ["streamline_id"], by + ["streamline_id", "other"]
    vertex = F.struct("point_idx", *[F.col(c).cast("double").alias(c) for c in XYZ])
    box = [F.min(c).alias(f"lo{c}") for c in XYZ] + [F.max(c).alias(f"hi{c}") for c in XYZ]
    involved = pairs.select(*keys).union(pairs.select(*by, "other")).distinct()
    pieces = lookup(pts, involved, keys, "left_semi").groupBy(*keys, F.floor(F.col("point_idx") / PIECE).alias("piece"))
    pieces = cut_lineage(pieces.agg(F.sort_array(F.collect_list(vertex)).alias("v"), *box))

    def side(name: str, columns: list[str]) -> DataFrame:
        end = "other" if name == "b" else "streamline_id"
        return pieces.select(*by, F.col("streamline_id").alias(end), *[F.col(c).alias(f"{name}_{c}") for c in ["piece", *columns]])

    boxes = [f"{e}{c}" for e in ("lo", "hi") for c in XYZ]
    met = lookup(lookup(pairs, side("a", boxes), keys), side("b", boxes), by + ["other"])
    gap, far = [], []
    for c in XYZ:
        al, ah, bl, bh = (F.col(f"{n}_{e}{c}") for n in "ab" for e in ("lo", "hi"))
        gap.append(F.greatest(bl - ah, al - bh, F.lit(0.0)))
        far.append(F.greatest(bh - al, ah - bl))
    near2, far2 = (d[0] * d[0] + d[1] * d[1] + d[2] * d[2] for d in (gap, far))
    met = met.select(*pair, "a_piece", "b_piece", near2.alias("_near2"), far2.alias("_far2"))
    reach = F.greatest(*[F.min("_far2").over(Window.partitionBy(*pair, f"{n}_piece")) for n in "ab"])
    met = met.withColumn("_reach", reach).filter(F.col("_near2") <= F.col("_reach") * (1 + 1e-12) + 1e-12).drop("_near2", "_far2", "_reach")
    both = lookup(lookup(met, side("a", ["v"]), keys + ["a_piece"]), side("b", ["v"]), by + ["other", "b_piece"])
    row = both.select(F.struct(*pair).alias("pair"), "a_piece", "b_piece", *[F.col(f"{n}_v.{c}").alias(f"{n}_{c}") for n in "ab" for c in XYZ])
    out = StructType([row.schema["pair"], *StructType.fromDDL("a_piece long, b_piece long, a_d array<double>, b_d array<double>").fields])
    measured = row.mapInArrow(_piece_distances, out)
    each = measured.select("pair", F.explode(F.array(
        F.struct(F.lit(0).alias("side"), F.col("a_piece").alias("piece"), F.col("a_d").alias("d")),
        F.struct(F.lit(1).alias("side"), F.col("b_piece").alias("piece"), F.col("b_d").alias("d")),
    )).alias("_e")).select("pair", "_e.side", "_e.piece", F.posexplode("_e.d").alias("at", "d"))
    least = each.groupBy("pair", "side", "piece", "at").agg(F.min("d").alias("d"))
    within = (F.col("d") <= tolerance).cast("double")
    sums = least.groupBy("pair").agg(
        F.avg(F.when(F.col("side") == 0, F.col("d"))).alias("mean_distance_mm"),
        F.least(F.avg(F.when(F.col("side") == 0, within)), F.avg(F.when(F.col("side") == 1, within))).alias("_share"),
    )
    return sums.filter((F.col("mean_distance_mm") <= tolerance) & (F.col("_share") >= fraction)).select("pair.*", "mean_distance_mm")


def _piece_distances(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """From two pieces to the distance of each vertex of one to the nearest of the other, both ways."""
    for batch in batches:
        sides = {}
        for n in "ab":
            lists = [batch[f"{n}_{c}"] for c in XYZ]
            sides[n] = (np.stack([v.flatten().to_numpy() for v in lists], 1), np.append(0, np.cumsum(lists[0].value_lengths().to_numpy())))
        out = {"a": np.empty(len(sides["a"][0])), "b": np.empty(len(sides["b"][0]))}
        for i in range(batch.num_rows):
            (a0, a1), (b0, b1) = (sides[n][1][i : i + 2] for n in "ab")
            p, q = sides["a"][0][a0:a1], sides["b"][0][b0:b1]
            dx, dy, dz = (p[:, None, k] - q[None, :, k] for k in range(3))
            d2 = dx * dx + dy * dy + dz * dz
            out["a"][a0:a1], out["b"][b0:b1] = d2.min(1), d2.min(0)
        lists = [pa.ListArray.from_arrays(pa.array(sides[n][1], pa.int32()), pa.array(np.sqrt(out[n]))) for n in "ab"]
        yield pa.RecordBatch.from_arrays([batch["pair"], batch["a_piece"], batch["b_piece"], *lists], ["pair", "a_piece", "b_piece", "a_d", "b_d"])


def bundle_coverage(candidates: DataFrame, reference: DataFrame, tolerance_mm: float) -> DataFrame:
    """Mean distance candidate to reference, share of reference streamlines within the tolerance
    of the candidates, and the median candidate length: one row, or one a subject."""
    by = subject(candidates, reference)
    one = F.lit(1).alias("_one")
    forward = mean_cloud_distance(candidates, reference).groupBy(*by, one).agg(F.avg("mean_distance_mm").alias("forward_mean_mm"))
    back = mean_cloud_distance(reference, candidates).groupBy(*by, one).agg(
        F.avg((F.col("mean_distance_mm") <= tolerance_mm).cast("double")).alias("coverage")
    )
    lengths = order_statistics(streamline_length(candidates), "length_mm", {"median_length_mm": 0.5}, by).drop("n_finite").withColumn("_one", F.lit(1))
    return forward.join(back, by + ["_one"]).join(lengths, by + ["_one"]).drop("_one")
