"""Voxel densities and direction fields of streamlines."""

from __future__ import annotations

from collections.abc import Iterator
from itertools import product

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from axonframe.functions.geometry import XYZ, attach_bounds, unit_or_zero
from axonframe.functions.scan import lookup, settled, subject
from axonframe.functions.sphere import FULL_DETAIL, bin_count, nearest_bin, neighbour_pairs, opposite_bins, smoothing_kernel
from axonframe.operators.geometry import raster, segments, tangents

MIN_VOXEL_MM = 0.5
SMOOTH_SHARE = 0.35
TENSOR = ("xx", "xy", "xz", "yy", "yz", "zz")


def voxel_size(voxel_mm: float) -> float:
    return max(float(voxel_mm), MIN_VOXEL_MM)


def place(rows: DataFrame, pts: DataFrame, voxel_mm: float, pad: float, at=XYZ) -> DataFrame:
    """Add i, j, k of the grid whose origin lies ``pad`` voxels before the bounding box."""
    size = F.lit(float(voxel_mm))
    boxed = attach_bounds(rows, pts)
    origin = [F.col(f"min_{c}") - F.lit(float(pad * voxel_mm)) for c in XYZ]
    index = {n: F.floor((F.col(a) - o) / size).cast("int") for n, a, o in zip("ijk", at, origin)}
    return boxed.withColumns(index).drop(*[f"{e}_{c}" for e in ("min", "max") for c in XYZ])


def grid_dims(pts: DataFrame, voxel_mm: float) -> tuple[int, int, int]:
    """Dimensions of the padded density grid (two voxels each side) from the bounding box."""
    size = voxel_size(voxel_mm)
    box = pts.agg(*[F.min(c).alias(f"a{c}") for c in XYZ], *[F.max(c).alias(f"b{c}") for c in XYZ]).first()
    return tuple(
        max(int(np.ceil(((box[f"b{c}"] + 2 * size) - (box[f"a{c}"] - 2 * size)) / size)) + 1, 3) for c in XYZ
    )


def with_grid_dims(rows: DataFrame, pts: DataFrame, voxel_mm: float) -> DataFrame:
    """Adds ``n_i, n_j, n_k``, the dimensions of the padded density grid of each subject's points."""
    size = voxel_size(voxel_mm)
    boxed = attach_bounds(rows, pts)
    extent = {n: F.ceil((F.col(f"max_{c}") - F.col(f"min_{c}") + 4 * size) / F.lit(size)) + 1 for n, c in zip("ijk", XYZ)}
    sized = boxed.withColumns({f"n_{n}": F.greatest(v, F.lit(3)).cast("int") for n, v in extent.items()})
    return sized.drop(*[f"{e}_{c}" for e in ("min", "max") for c in XYZ])


def vertex_marks() -> dict[str, Column]:
    """What a vertex with its tangent adds to a voxel: direction colour and orientation tensor."""
    c = [F.abs(F.col(f"t{a}")) for a in XYZ]
    d = dict(zip(XYZ, unit_or_zero(*c)))
    return dict(zip("rgb", c)) | {t: d[t[0]] * d[t[1]] for t in TENSOR}


def voxel_density(pts: DataFrame, voxel_mm: float, colors: bool = True) -> DataFrame:
    """Vertices per voxel with sums of the direction colour and its orientation tensor."""
    size = voxel_size(voxel_mm)
    by = subject(pts)
    rows = tangents(pts) if colors else pts
    rows = place(rows, pts, size, 2)
    aggs = [F.count("*").alias("density")]
    if colors:
        aggs += [F.sum(v).alias(f"sum_{n}") for n, v in vertex_marks().items()]
    return rows.groupBy(*by, "i", "j", "k").agg(*aggs)


def visit_density(pts: DataFrame, voxel_mm: float) -> DataFrame:
    """Voxel visits by segment rasterisation; a streamline counts again only after leaving.

    Origin: bounding box minimum minus one voxel.
    """
    return _entered(pts, voxel_mm).groupBy(*subject(pts), "i", "j", "k").agg(F.count("*").alias("density"))


def visits(pts: DataFrame, voxel_mm: float) -> DataFrame:
    """Visit counts per (streamline, voxel)."""
    walked = _entered(pts, voxel_mm)
    return walked.groupBy(*subject(pts), "streamline_id", "i", "j", "k").agg(F.count("*").alias("visits"))


def _entered(pts: DataFrame, voxel_mm: float) -> DataFrame:
    """A row each time that a streamline enters a voxel."""
    size = max(float(voxel_mm), 1e-3)
    by = subject(pts)
    boxed = attach_bounds(pts.select(*by, "streamline_id", "point_idx", *XYZ), pts)
    # Work in coordinates relative to the grid so the raster needs no per-subject grid.
    relative = boxed.select(
        *by, "streamline_id", "point_idx", *[(F.col(c) - (F.col(f"min_{c}") - F.lit(size))).alias(c) for c in XYZ]
    )
    return raster(relative, lambda *p: [v * F.lit(1.0 / size) for v in p], changes_only=True)


# --- direction fields ---------------------------------------------------------------


def binned_segments(pts: DataFrame, voxel_mm: float, detail: int = FULL_DETAIL, field_pts: DataFrame | None = None) -> DataFrame:
    """Segments with the voxel of their midpoint, their length ``w`` and their bins ``bin`` and ``opposite``.

    The grid is that of ``field_pts`` (default: the same points). A field and the scores against it
    can take these rows as ``binned``, so the points are walked once if they are written.
    """
    placed = place(segments(pts), pts if field_pts is None else field_pts, voxel_size(voxel_mm), 1, [f"m{c}" for c in XYZ])
    bins = opposite_bins(*[F.col(f"u{c}") for c in XYZ], detail)
    columns = [*subject(pts), "streamline_id", "segment_idx", "i", "j", "k", F.col("length").alias("w")]
    rows = placed.select(*columns, bins.alias("_bins"))
    return rows.select("*", "_bins.*").drop("_bins")


def _oriented(pts: DataFrame, voxel_mm: float, mode: str, detail: int | None) -> DataFrame:
    """One row per (segment, voxel) contribution: direction, weight and (given a detail) bins."""
    size = voxel_size(voxel_mm)
    by = subject(pts)
    segs = segments(pts)
    if mode == "tangent":
        segs = segs.filter(F.col("length") >= 1e-6)
        rows = place(segs, pts, size, 1, [f"m{c}" for c in XYZ])
        rows = rows.select(*by, "i", "j", "k", *[f"u{c}" for c in XYZ], F.col("length").alias("w"))
        if detail is None:
            return rows
        u = [F.col(f"u{c}") for c in XYZ]
        return rows.withColumn("_bins", opposite_bins(*u, detail)).select("*", "_bins.*").drop("_bins")
    if mode != "crossings":
        raise ValueError(f"unknown direction field mode {mode!r}")
    boxed = attach_bounds(segs.filter(F.col("length") > 0), pts)
    origin = [F.col(f"min_{c}") - F.lit(size) for c in XYZ]
    for end in "01":
        boxed = boxed.withColumns(
            {f"v{end}{c}": F.floor((F.col(f"{c}{end}") - o) / F.lit(size)).cast("int") for c, o in zip(XYZ, origin)}
        )
    boxed = boxed.filter((F.col("v0x") != F.col("v1x")) | (F.col("v0y") != F.col("v1y")) | (F.col("v0z") != F.col("v1z")))
    for end, other in ("01", "10"):
        boxed = _with_exit(boxed, origin, size, end, other)
    votes = F.array(
        *[F.struct(F.col(f"_exit{e}").alias("ok"), *[F.col(f"v{e}{c}").alias(n) for c, n in zip(XYZ, "ijk")]) for e in "01"]
    )
    u = [f"u{c}" for c in XYZ]
    rows = boxed.withColumn("_v", F.explode(votes)).filter("_v.ok").select(*by, "_v.i", "_v.j", "_v.k", *u, F.lit(1.0).alias("w"))
    return rows if detail is None else rows.withColumn("bin", nearest_bin(*[F.col(c) for c in u], detail))


def _with_exit(rows: DataFrame, origin: list[Column], size: float, start: str, stop: str) -> DataFrame:
    """Add ``_exit<start>``: does the segment pass a face of its start voxel?

    The crossing share of each axis is its own column, so the face tests stay short.
    """
    low = {c: o + F.col(f"v{start}{c}") * F.lit(size) for o, c in zip(origin, XYZ)}
    step = {c: F.col(f"{c}{stop}") - F.col(f"{c}{start}") for c in XYZ}
    rows = rows.withColumns({f"_l{c}": low[c] for c in XYZ} | {f"_d{c}": step[c] for c in XYZ})
    wall = {c: F.col(f"_l{c}") + F.when(F.col(f"_d{c}") > 0, F.lit(size)).otherwise(F.lit(0.0)) for c in XYZ}
    share = {
        f"_t{c}": F.when(F.abs(f"_d{c}") > 1e-8, (wall[c] - F.col(f"{c}{start}")) / F.nullif(F.col(f"_d{c}"), F.lit(0.0)))
        for c in XYZ
    }
    rows = rows.withColumns(share)
    found = F.lit(False)
    for c in XYZ:
        ok = F.col(f"_t{c}").between(1e-5, 1.0)
        for other in XYZ:
            if other != c:
                at = F.col(f"{other}{start}") + F.col(f"_d{other}") * F.col(f"_t{c}")
                ok = ok & at.between(F.col(f"_l{other}") - 1e-4, F.col(f"_l{other}") + size + 1e-4)
        found = found | F.coalesce(ok, F.lit(False))
    return rows.withColumn(f"_exit{start}", found)


def direction_field(
    pts: DataFrame, voxel_mm: float, mode: str = "tangent", detail: int = FULL_DETAIL, binned: DataFrame | None = None
) -> DataFrame:
    """Voxel x sphere-bin histogram in long form (raw weights).

    ``tangent``: segment length to the bins of both directions at the midpoint's voxel; ``binned``:
    the points' ``binned_segments``, where they are there already.
    ``crossings``: one vote in the left and in the entered voxel per face crossing.
    """
    by = subject(pts)
    if binned is not None and mode == "tangent":
        rows = binned.filter(F.col("w") >= 1e-6)
    else:
        rows = _oriented(pts, voxel_mm, mode, detail)
    if mode == "tangent":
        bins = F.array_distinct(F.array("bin", "opposite"))
        rows = rows.select(*by, "i", "j", "k", F.explode(bins).alias("bin"), "w")
    return rows.groupBy(*by, "i", "j", "k", "bin").agg(F.sum("w").alias("weight"))


def direction_summary(pts: DataFrame, voxel_mm: float, mode: str = "tangent") -> DataFrame:
    """Contacts, summed vector and 6-number tensor per voxel.

    In tangent mode vectors are flipped to the +z half-space and weighted by length.
    """
    by = subject(pts)
    rows = _oriented(pts, voxel_mm, mode, None)
    u = {c: F.col(f"u{c}") for c in XYZ}
    flip = F.when(u["z"] >= 0, F.lit(1.0)).otherwise(F.lit(-1.0)) if mode == "tangent" else F.lit(1.0)
    return rows.groupBy(*by, "i", "j", "k").agg(
        F.count("*").alias("n_contacts"),
        *[F.sum(u[c] * flip * F.col("w")).alias(f"v{c}") for c in XYZ],
        *[F.sum(u[t[0]] * u[t[1]] * F.col("w")).alias(t) for t in TENSOR],
    )


def min_contacts_filter(summary: DataFrame, n: int) -> DataFrame:
    return summary.filter(F.col("n_contacts") >= n)


def direction_smooth(field: DataFrame, detail: int = FULL_DETAIL, rounds: int = 2) -> DataFrame:
    """Each round: 0.65 of a bin plus 0.35 of the mean of its sphere neighbours.

    One shuffle by voxel: a voxel is a list of at most one weight per bin, and all rounds
    are one fixed bin x bin matrix applied to a batch of voxels.
    """
    keys = [c for c in field.columns if c not in ("bin", "weight")]
    n = bin_count(detail)
    mix = np.linalg.matrix_power(_neighbour_mix(detail), rounds)
    schema = ", ".join(f"`{k}` {field.schema[k].dataType.simpleString()}" for k in keys)

    def smooth(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in _slices(batches):
            out = _histograms(batch, n) @ mix.T
            row, at = np.nonzero(out)
            frame = batch[keys].iloc[row].reset_index(drop=True)
            yield frame.assign(bin=at.astype("int32"), weight=out[row, at])

    return _per_voxel(field, keys).mapInPandas(smooth, f"{schema}, bin int, weight double")


def _neighbour_mix(detail: int) -> np.ndarray:
    n = bin_count(detail)
    mix = np.eye(n) * (1.0 - SMOOTH_SHARE)
    pairs = np.array(neighbour_pairs(detail))
    degree = np.bincount(pairs[:, 0], minlength=n)
    mix[pairs[:, 0], pairs[:, 1]] = SMOOTH_SHARE / degree[pairs[:, 0]]
    return mix


def _per_voxel(field: DataFrame, keys: list[str]) -> DataFrame:
    """One row per voxel with its bins and weights (bounded by the number of bins)."""
    rows = field.groupBy(*keys).agg(F.collect_list(F.struct("bin", "weight")).alias("_h"))
    return rows.select(*keys, F.col("_h.bin").alias("_b"), F.col("_h.weight").alias("_w"))


def _slices(batches: Iterator[pd.DataFrame], size: int = 512) -> Iterator[pd.DataFrame]:
    for batch in batches:
        for lo in range(0, len(batch), size):
            yield batch.iloc[lo : lo + size]


def _histograms(batch: pd.DataFrame, n: int) -> np.ndarray:
    """Dense voxel x bin matrix of a batch."""
    out = np.zeros((len(batch), n))
    counts = [len(b) for b in batch["_b"]]
    row = np.repeat(np.arange(len(batch)), counts)
    np.add.at(out, (row, np.concatenate(batch["_b"].to_numpy())), np.concatenate(batch["_w"].to_numpy()))
    return out


def direction_normalize(field: DataFrame, mode: str = "global_peak") -> DataFrame:
    """``raw``, ``global_peak``, ``unit_peak`` (per voxel) or ``unit_mass`` (per voxel)."""
    by = subject(field)
    voxel = by + ["i", "j", "k"]
    if mode == "raw":
        return field
    if mode == "global_peak":
        if by:
            tops = field.groupBy(*by).agg(F.max("weight").alias("_m"))
            field = lookup(field, tops, by)
        else:
            field = field.withColumn("_m", F.lit(field.agg(F.max("weight").alias("m")).first()["m"]).cast("double"))
    elif mode in ("unit_peak", "unit_mass"):
        # A voxel has at most one row per bin, so this window is bounded.
        w = Window.partitionBy(*voxel)
        field = field.withColumn("_m", (F.max if mode == "unit_peak" else F.sum)("weight").over(w))
    else:
        raise ValueError(f"unknown normalisation {mode!r}")
    return field.withColumn("weight", F.when(F.col("_m") > 0, F.col("weight") / F.col("_m")).otherwise(F.col("weight"))).drop("_m")


def direction_sample(rows: DataFrame, summary: DataFrame, pts: DataFrame, voxel_mm: float) -> DataFrame:
    """Adds ``vx, vy, vz`` and the tensor ``xx .. zz`` of the summary at each point.

    The vector is that of the point's voxel, else the inverse-square weighted mean of the 26 around
    it, else zero; the tensor is that of the point's voxel, else zero. Outside the grid, which
    ``pts`` defines, both are zero. A voxel's row brings what its points need, so a point takes one lookup.
    """
    size = voxel_size(voxel_mm)
    names = [f"v{c}" for c in XYZ] + list(TENSOR)
    cell = F.struct(*[F.col(c).cast("double").alias(c) for c in names])
    # A row per voxel: its own cell or, of one that has none, the neighbours that count with their offsets.
    by = subject(rows, summary)
    at = [*by, "_i", "_j", "_k"]
    cells = summary.groupBy(*by, "i", "j", "k").agg(F.max(cell).alias("_c"))
    offset = F.explode(F.array(*[F.struct(*[F.lit(d).alias(f"_d{c}") for d, c in zip(o, "ijk")]) for o in product((-1, 0, 1), repeat=3)]))
    seen = cells.withColumn("_o", offset).select(*by, "_c", "_o.*", *[(F.col(c) - F.col(f"_o._d{c}")).alias(f"_{c}") for c in "ijk"])
    here = (F.col("_di") == 0) & (F.col("_dj") == 0) & (F.col("_dk") == 0)
    v = [F.col(f"_c.v{c}") for c in XYZ]
    near = F.struct("_di", "_dj", "_dk", *[x.alias(f"v{c}") for c, x in zip(XYZ, v)])
    counts = ~here & F.coalesce(v[0] * v[0] + v[1] * v[1] + v[2] * v[2] > 1e-10, F.lit(False))
    seen = seen.groupBy(*at).agg(F.max(F.when(here, F.col("_c"))).alias("_own"), F.sort_array(F.collect_list(F.when(counts, near))).alias("_near"))
    seen, small = settled(seen.withColumn("_near", F.when(F.col("_own").isNull(), F.col("_near"))))
    placed = attach_bounds(rows, pts)
    raw = [(F.col(c) - F.col(f"min_{c}")) / F.lit(size) + 1 for c in XYZ]
    dims = [F.greatest(F.ceil((F.col(f"max_{c}") - F.col(f"min_{c}")) / F.lit(size) + 2), F.lit(1)) for c in XYZ]
    inside_grid = F.lit(True)
    for v, n in zip(raw, dims):
        inside_grid = inside_grid & (v >= 0) & (F.floor(v) < n)
    placed = placed.withColumns({f"_r{c}": v for c, v in zip(XYZ, raw)} | {"_inside": F.coalesce(inside_grid, F.lit(False))})
    placed = placed.withColumns({f"_{n}": F.floor(f"_r{c}").cast("int") for n, c in zip("ijk", XYZ)})
    placed = lookup(placed, seen, at, "left", spread=True, small=small)
    # Distance in voxels to the centre of the voxel at an offset, back to mm.
    part = [F.col(f"_r{c}") - F.floor(f"_r{c}") for c in XYZ]
    zero = F.struct(*[F.lit(0.0).alias(f"v{c}") for c in XYZ], F.lit(0.0).alias("w"))

    def add(acc: Column, n: Column) -> Column:
        gap = [(n[f"_d{d}"] + F.lit(0.5) - p) * F.lit(size) for d, p in zip("ijk", part)]
        w = F.lit(1.0) / F.greatest(gap[0] * gap[0] + gap[1] * gap[1] + gap[2] * gap[2], F.lit(1e-4))
        return F.struct(*[(acc[f"v{c}"] + n[f"v{c}"] * w).alias(f"v{c}") for c in XYZ], (acc["w"] + w).alias("w"))

    around = F.when(F.col("_inside") & F.col("_own").isNull() & (F.size("_near") > 0), F.aggregate("_near", zero, add))
    placed = placed.withColumn("_around", around)
    mean = {f"v{c}": F.when(F.col("_around.w") > 0, F.col(f"_around.v{c}") / F.col("_around.w")) for c in XYZ}
    own = {c: F.when(F.col("_inside"), F.col("_own")[c]) for c in names}
    picked = [F.coalesce(own[c], mean[c], F.lit(0.0)).alias(c) if c in mean else F.coalesce(own[c], F.lit(0.0)).alias(c) for c in names]
    return placed.select(*rows.columns, *picked)


def principal_direction(summary: DataFrame, rounds: int = 6) -> DataFrame:
    """Main axis of the 6-number tensor by power iteration, as an absolute RGB colour."""
    t = {n: F.col(n) for n in TENSOR}

    def step(v: Column, _: Column) -> Column:
        m = [
            t["xx"] * v["x"] + t["xy"] * v["y"] + t["xz"] * v["z"],
            t["xy"] * v["x"] + t["yy"] * v["y"] + t["yz"] * v["z"],
            t["xz"] * v["x"] + t["yz"] * v["y"] + t["zz"] * v["z"],
        ]
        length2 = m[0] * m[0] + m[1] * m[1] + m[2] * m[2]
        moved = F.struct(*[(a / F.sqrt(length2)).alias(c) for a, c in zip(m, XYZ)])
        return F.when(length2 < 1e-8, v).otherwise(moved)

    def axis(n: str) -> Column:
        return F.struct(*[F.lit(1.0 if c == n else 0.0).alias(c) for c in XYZ])

    start = F.when((t["xx"] >= t["yy"]) & (t["xx"] >= t["zz"]), axis("x")).when(t["yy"] >= t["zz"], axis("y")).otherwise(axis("z"))
    main = F.aggregate(F.sequence(F.lit(1), F.lit(rounds)), start, step)
    out = summary.withColumn("_v", main)
    return out.withColumns({n: F.abs(F.col("_v")[c]) for n, c in zip("rgb", XYZ)}).drop("_v")


# --- coherence scores ---------------------------------------------------------------


def smoothed_support(field: DataFrame, queried: DataFrame, smooth_deg: float, detail: int) -> DataFrame:
    """Histogram value at the queried (voxel, bin) pairs, after Gaussian smoothing on the
    sphere. A voxel is one array of at most one value per bin; only asked-for bins come out."""
    keys = [c for c in ("subject_id", "i", "j", "k") if c in field.columns and c in queried.columns]
    if smooth_deg <= 0:
        found = queried.join(field, keys + ["bin"], "left")
        known = queried.select(*keys).distinct().join(field.select(*keys).distinct(), keys, "left_semi")
        return found.join(known, keys, "left_semi").select(*keys, "bin", F.coalesce("weight", F.lit(0.0)).alias("support"))
    kernel = smoothing_kernel(float(smooth_deg), detail)
    n = bin_count(detail)
    asked = queried.groupBy(*keys).agg(F.collect_set("bin").alias("_q"))
    both = asked.join(_per_voxel(field, keys), keys)
    schema = ", ".join(f"`{k}` {field.schema[k].dataType.simpleString()}" for k in keys)

    def smooth(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in _slices(batches):
            support = _histograms(batch, n) @ kernel.T
            row = np.repeat(np.arange(len(batch)), [len(q) for q in batch["_q"]])
            at = np.concatenate(batch["_q"].to_numpy())
            frame = batch[keys].iloc[row].reset_index(drop=True)
            yield frame.assign(bin=at.astype("int32"), support=support[row, at])

    return both.mapInPandas(smooth, f"{schema}, bin int, support double")
