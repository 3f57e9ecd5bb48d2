"""Scalar volumes, voxel masks and parcellations as sparse voxel tables."""

from __future__ import annotations

import math
from collections.abc import Iterable, Sequence
from dataclasses import dataclass

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from axonframe.functions.color import clamp01, map_colors, window_level
from axonframe.functions.geometry import SLICE_AXIS, Grid, grid_voxels, inside, points_to_voxels, unflatten, voxel_to_world
from axonframe.functions.scan import is_finite, lookup, order_statistics, subject, voxel_keys
from axonframe.operators.sampling import resample_volume

# --- value ranges -------------------------------------------------------------------


def finite_minmax(df: DataFrame, col: str, by: Sequence[str] = ()) -> DataFrame:
    """Smallest and largest finite value; (0, 1) where there is none."""
    value = F.when(is_finite(F.col(col)), F.col(col))
    return df.groupBy(*by).agg(
        F.coalesce(F.min(value), F.lit(0.0)).alias("lo"), F.coalesce(F.max(value), F.lit(1.0)).alias("hi")
    )


def robust_range(df: DataFrame, col: str, by: Sequence[str] = (), fast: bool = False) -> DataFrame:
    """2 % and 98 % order statistics of the finite values, the upper one at least a hair
    above the lower; (0, 1) for no values. ``fast`` trades exactness for one pass."""
    value = F.when(is_finite(F.col(col)), F.col(col))
    if fast:
        both = df.groupBy(*by).agg(F.percentile_approx(value, [0.02, 0.98], 10_000).alias("_p"))
        lo, hi = F.get("_p", F.lit(0)), F.get("_p", F.lit(1))
        out = both.select(*by, lo.alias("lo"), hi.alias("hi"))
    else:
        out = order_statistics(df, col, {"lo": 0.02, "hi": 0.98}, by).drop("n_finite")
        if by:
            # A group of only non-finite values still has a (default) range.
            out = df.select(*by).distinct().join(out, list(by), "left")
    top = F.greatest(F.col("hi"), F.col("lo") + 1e-6)
    return out.select(
        *by, F.coalesce("lo", F.lit(0.0)).alias("lo"), F.coalesce(top, F.lit(1.0)).alias("hi")
    )


def normalize_volume(voxels: DataFrame) -> DataFrame:
    """Min-max scale the finite values of each volume to [0, 1]; a flat volume becomes 0."""
    by = [c for c in ("subject_id", "volume_id") if c in voxels.columns]
    value = F.when(is_finite(F.col("value")), F.col("value"))
    spans = voxels.groupBy(*by).agg(F.min(value).alias("_lo"), F.max(value).alias("_hi"))
    if by:
        rows = lookup(voxels, spans, by)
    else:
        span = spans.first()
        rows = voxels.withColumns({n: F.lit(span[n]).cast("double") for n in ("_lo", "_hi")})
    scaled = clamp01((F.col("value") - F.col("_lo")) / F.nullif(F.col("_hi") - F.col("_lo"), F.lit(0.0)))
    return rows.withColumn("value", F.when(F.col("_hi") > F.col("_lo"), scaled).otherwise(F.lit(0.0))).drop("_lo", "_hi")


def dpv_to_volume(spark: SparkSession, voxels: DataFrame, grid: Grid) -> DataFrame:
    """Compact per-voxel values min-max scaled onto the full grid, 0 elsewhere."""
    scaled = normalize_volume(voxels.select(*voxel_keys(voxels), "value"))
    dense = grid_voxels(spark, grid)
    if "subject_id" in voxels.columns:
        dense = voxels.select("subject_id").distinct().withColumn(
            "_n", F.explode(F.sequence(F.lit(0), F.lit(grid.nx * grid.ny * grid.nz - 1)))
        ).select("subject_id", *[v.alias(n) for v, n in zip(unflatten(F.col("_n"), grid.nx, grid.ny), "ijk")])
    return dense.join(scaled, voxel_keys(voxels), "left").withColumn("value", F.coalesce("value", F.lit(0.0)))


# --- masks --------------------------------------------------------------------------


def mask_threshold(voxels: DataFrame, threshold: float = 0.5) -> DataFrame:
    """Voxels strictly above the threshold."""
    return voxels.filter(F.col("value") > threshold).select(*voxel_keys(voxels))


def mask_from_parcels(parcels: DataFrame, labels: Iterable[int] | None = None) -> DataFrame:
    """Voxels with a chosen non-zero label; no choice means every non-zero label."""
    rows = parcels.filter(F.col("label") != 0)
    labels = [int(v) for v in labels or []]
    if labels:
        rows = rows.filter(F.col("label").isin(labels))
    return rows.select(*voxel_keys(parcels))


def mask_from_shape(spark: SparkSession, grid: Grid, center: tuple, radius_mm: float, shape: str = "sphere") -> DataFrame:
    """Voxels whose centre lies in a sphere or an axis-aligned box (borders included).

    Only the voxels of the shape's own bounding box are generated.
    """
    if shape not in ("sphere", "box"):
        raise ValueError(f"unknown shape {shape!r}")
    inverse = np.array(grid.inverse).reshape(4, 4)
    middle = inverse[:3, :3] @ np.array(center, dtype=float) + inverse[:3, 3]
    reach = np.abs(inverse[:3, :3]).sum(axis=1) * radius_mm + 1e-6
    lo = [max(0, math.ceil(m - r)) for m, r in zip(middle, reach)]
    hi = [min(n - 1, math.floor(m + r)) for m, r, n in zip(middle, reach, grid.dims)]
    size = [max(0, b - a + 1) for a, b in zip(lo, hi)]
    box = spark.range(size[0] * size[1] * size[2])
    if min(size) == 0:
        box = spark.range(0)
        size = [1, 1, 1]
    ijk = [(v + a).cast("int").alias(n) for v, a, n in zip(unflatten(F.col("id"), size[0], size[1]), lo, "ijk")]
    box = box.select(*ijk)
    d = [w - F.lit(float(c)) for w, c in zip(voxel_to_world(grid, F.col("i"), F.col("j"), F.col("k")), center)]
    if shape == "sphere":
        return box.filter(F.sqrt(d[0] * d[0] + d[1] * d[1] + d[2] * d[2]) <= radius_mm)
    return box.filter((F.abs(d[0]) <= radius_mm) & (F.abs(d[1]) <= radius_mm) & (F.abs(d[2]) <= radius_mm))


def mask_count(mask: DataFrame) -> DataFrame:
    by = [c for c in ("subject_id", "mask_id") if c in mask.columns]
    return mask.groupBy(*by).agg(F.count("*").alias("n_voxels"))


def mask_union(
    spark: SparkSession, a: DataFrame, a_grid: Grid | None, b: DataFrame, b_grid: Grid | None
) -> DataFrame:
    """OR on the grid of ``a``; ``b`` is looked up at ``a``'s voxel centres if the grids
    differ. A mask without a grid is the identity."""
    on = voxel_keys(a, b)
    if a_grid is None:
        return b.select(*on)
    if b_grid is None:
        return a.select(*on)
    if not a_grid.same_as(b_grid):
        centres = grid_voxels(spark, a_grid)
        world = voxel_to_world(a_grid, F.col("i"), F.col("j"), F.col("k"))
        rows = centres.select(*[F.col(n).alias(f"t{n}") for n in "ijk"], *[w.alias(c) for w, c in zip(world, "xyz")])
        seated = points_to_voxels(rows, b_grid, "round")
        b = lookup(seated, b.select(*on).distinct(), on).select(
            *subject(a, b), *[F.col(f"t{n}").alias(n) for n in "ijk"]
        )
    return a.select(*on).unionByName(b.select(*on)).distinct()


def mask_intersect(a: DataFrame, b: DataFrame) -> DataFrame:
    return a.join(b, voxel_keys(a, b), "left_semi")


def mask_dilate(mask: DataFrame, grid: Grid, radius_vox: float) -> DataFrame:
    """Voxels within a Euclidean ball of the mask: squared distance <= ceil(radius^2).

    The squared distance splits by axis, so three passes of 2r + 1 shifts, each reduced to
    the minimum per voxel, replace one pass of about 4 r^3 shifts.
    """
    keys = [c for c in ("subject_id", "mask_id") if c in mask.columns]
    limit = math.ceil(max(radius_vox * radius_vox, 0.0))
    reach = math.isqrt(limit)
    rows = mask.select(*keys, "i", "j", "k", F.lit(0).alias("_g"))
    for axis, size in zip("ijk", grid.dims):
        shifted = rows.withColumn("_d", F.explode(F.sequence(F.lit(-reach), F.lit(reach))))
        shifted = shifted.withColumn(axis, F.col(axis) + F.col("_d")).withColumn("_g", F.col("_g") + F.col("_d") * F.col("_d"))
        shifted = shifted.filter((F.col("_g") <= limit) & F.col(axis).between(0, size - 1))
        rows = shifted.groupBy(*keys, "i", "j", "k").agg(F.min("_g").alias("_g"))
    return rows.drop("_g")


FACES = [(-1, 0, 0), (1, 0, 0), (0, -1, 0), (0, 1, 0), (0, 0, -1), (0, 0, 1)]


def _missing_neighbours(mask: DataFrame, shifts: Sequence[tuple[int, int, int]]) -> DataFrame:
    """(voxel, side) pairs whose neighbour on that side is off."""
    keys = [c for c in ("subject_id", "mask_id") if c in mask.columns]
    on = keys + ["i", "j", "k"]
    sides = F.array(
        *[
            F.struct(F.lit(n).alias("side"), *[F.lit(d).alias(f"d{a}") for d, a in zip(s, "ijk")])
            for n, s in enumerate(shifts)
        ]
    )
    probes = mask.select(*on, F.explode(sides).alias("_s")).select(
        *keys, "_s.side", *[F.col(n).alias(f"_{n}") for n in "ijk"], *[(F.col(n) + F.col(f"_s.d{n}")).alias(n) for n in "ijk"]
    )
    off = probes.join(mask.select(*on), on, "left_anti")
    return off.select(*keys, "side", *[F.col(f"_{n}").alias(n) for n in "ijk"])


def mask_boundary_faces(mask: DataFrame, grid: Grid) -> DataFrame:
    """Faces between a mask voxel and an off neighbour: voxel, side 0-5 (-x +x -y +y -z +z),
    corner positions c0..c3 in world space, counter-clockwise seen from outside."""
    # Corner offsets per side, each in the unit cube of the voxel.
    corners = {
        0: [(0, 0, 0), (0, 0, 1), (0, 1, 1), (0, 1, 0)],
        1: [(1, 0, 0), (1, 1, 0), (1, 1, 1), (1, 0, 1)],
        2: [(0, 0, 0), (1, 0, 0), (1, 0, 1), (0, 0, 1)],
        3: [(0, 1, 0), (0, 1, 1), (1, 1, 1), (1, 1, 0)],
        4: [(0, 0, 0), (0, 1, 0), (1, 1, 0), (1, 0, 0)],
        5: [(0, 0, 1), (1, 0, 1), (1, 1, 1), (0, 1, 1)],
    }
    faces = _missing_neighbours(mask, FACES)
    ijk = [F.col(n) for n in "ijk"]
    out = {}
    for n in range(4):
        def offset(a: int) -> Column:
            table = F.array(*[F.lit(float(corners[s][n][a])) for s in range(6)])
            return F.get(table, F.col("side")) - 0.5

        world = voxel_to_world(grid, *[v + offset(a) for a, v in enumerate(ijk)])
        out[f"c{n}"] = F.struct(*[w.alias(c) for w, c in zip(world, "xyz")])
    return faces.withColumns(out)


def slice_edges(
    mask: DataFrame, grid: Grid, across: int, index: int, drawn_at: float | None = None
) -> DataFrame:
    """In-plane edges of the mask voxels on one voxel layer whose neighbour is off.

    ``across`` is the voxel axis normal to the layer. Gives the voxel, the side (low/high
    of the first and second in-plane axis) and both world end points, drawn at the layer
    or at the fractional voxel coordinate ``drawn_at``.
    """
    plane = [a for a in range(3) if a != across]
    layer = mask.filter(F.col("ijk"[across]) == index)
    shifts = []
    for a in plane:
        for step in (-1, 1):
            shifts.append(tuple(step if n == a else 0 for n in range(3)))
    edges = _missing_neighbours(layer, shifts)
    side = F.col("side")
    first_axis = side < 2
    high = F.pmod(side, F.lit(2)) == 1
    ends: dict[str, Column] = {}
    for tag, along in (("a", -0.5), ("b", 0.5)):
        at: list[Column] = [F.col(n).cast("double") for n in "ijk"]
        if drawn_at is not None:
            at[across] = F.lit(float(drawn_at))
        face = F.when(high, F.lit(0.5)).otherwise(F.lit(-0.5))
        u, v = plane
        at[u] = at[u] + F.when(first_axis, face).otherwise(F.lit(along))
        at[v] = at[v] + F.when(first_axis, F.lit(along)).otherwise(face)
        for c, w in zip("xyz", voxel_to_world(grid, *at)):
            ends[f"{tag}{c}"] = w
    return edges.withColumns(ends)


def parcel_contours(parcels: DataFrame, grid: Grid, axis: int, index: int, labels: Iterable[int]) -> DataFrame:
    """Outline of the label set on one slice: edges to voxels outside the set, with the label."""
    chosen = parcels.filter(F.col("label").isin([int(v) for v in labels]))
    on = voxel_keys(parcels)
    edges = slice_edges(chosen.select(*on), grid, SLICE_AXIS[axis], index)
    return edges.join(chosen.select(*on, "label"), on)


def mask_slice_outline(mask: DataFrame, grid: Grid, axis: int, position_mm: float) -> DataFrame:
    """Outline of a mask where a world plane cuts the grid centre, on the nearest voxel layer."""
    world_axis = SLICE_AXIS[axis]
    row = np.array(grid.affine).reshape(4, 4)[world_axis]
    across = int(np.argmax(np.abs(row[:3])))
    middle = sum(row[a] * (grid.dims[a] - 1) * 0.5 for a in range(3) if a != across)
    at = float((position_mm - row[3] - middle) / row[across])
    if at < -0.5 or at > grid.dims[across] - 0.5:
        return slice_edges(mask.limit(0), grid, across, 0)
    nearest = math.floor(at + 0.5) if at >= 0 else -math.floor(0.5 - at)
    layer = min(max(nearest, 0), grid.dims[across] - 1)
    return slice_edges(mask, grid, across, layer, drawn_at=at)


def nearest_nonempty_slice(voxels: DataFrame, axis: int, preferred: int, n_slices: int) -> DataFrame:
    """The non-empty slice nearest to ``preferred``; the lower one wins a tie."""
    column = "kji"[axis]
    wanted = min(max(preferred, 0), n_slices - 1)
    slices = voxels.select(F.col(column).alias("slice")).distinct()
    distance = F.abs(F.col("slice") - wanted)
    return slices.agg(F.min_by("slice", F.struct(distance, F.col("slice"))).alias("slice"))


# --- smoothing ----------------------------------------------------------------------


def gaussian_kernel(sigma: float) -> list[float]:
    radius = math.ceil(3.0 * sigma)
    raw = [math.exp(-0.5 * x * x / (sigma * sigma)) for x in range(-radius, radius + 1)]
    total = sum(raw)
    return [v / total for v in raw]


def gaussian_blur(
    voxels: DataFrame, dims: tuple[int, int, int] | Sequence[str], sigma: float, values: Sequence[str] = ("value",)
) -> DataFrame:
    """Separable Gaussian blur with clamped edges over sparse voxels (absent = 0).

    ``dims`` are three numbers, or the columns that hold them where subjects differ; those stay.

    Each voxel scatters to its 2r + 1 neighbours of one axis at a time; a border voxel also
    stands in for the samples beyond the border. ``sigma`` under 0.5 changes nothing.
    """
    keys = [c for c in ("subject_id", "group_name") if c in voxels.columns] + [d for d in dims if isinstance(d, str)]
    if sigma < 0.5:
        return voxels.select(*keys, "i", "j", "k", *values)
    kernel = gaussian_kernel(sigma)
    radius = len(kernel) // 2
    # Weight a border voxel adds for the samples beyond it, by distance from the border.
    beyond = {d: sum(kernel[: radius - d]) for d in range(radius + 1)}
    taps = F.array(
        *[
            F.struct(
                F.lit(d).alias("d"),
                F.lit(kernel[d + radius]).alias("w"),
                F.lit(beyond[d] if d >= 0 else 0.0).alias("low"),
                F.lit(beyond[-d] if d <= 0 else 0.0).alias("high"),
            )
            for d in range(-radius, radius + 1)
        ]
    )
    rows = voxels.select(*keys, "i", "j", "k", *values)
    for axis, dim in zip("ijk", dims):
        t, size = F.col("_t"), F.col(dim) if isinstance(dim, str) else F.lit(dim)
        weight = (
            t["w"]
            + F.when(F.col(axis) == 0, t["low"]).otherwise(F.lit(0.0))
            + F.when(F.col(axis) == size - 1, t["high"]).otherwise(F.lit(0.0))
        )
        spread = rows.withColumn("_t", F.explode(taps)).withColumn("_w", weight).withColumn(axis, F.col(axis) + t["d"])
        spread = spread.filter(F.col(axis).between(0, size - 1))
        rows = spread.groupBy(*keys, "i", "j", "k").agg(*[F.sum(F.col("_w") * F.col(v)).alias(v) for v in values])
    return rows


def nw_interpolate(
    sums: DataFrame, dims: tuple[int, int, int], sigma: float, numerator: str, density: str = "density"
) -> DataFrame:
    """Blurred numerator over blurred density: a kernel-weighted field at voxels."""
    blurred = gaussian_blur(sums, dims, sigma, [numerator, density])
    return blurred.filter(F.col(density) > 0).withColumn(numerator, F.col(numerator) / F.col(density))


def iso_level(threshold: float, sigma: float) -> float:
    """A threshold in raw points per voxel, scaled to what the blur leaves at its centre."""
    if sigma < 0.5:
        return threshold
    kernel = gaussian_kernel(sigma)
    return threshold * kernel[len(kernel) // 2] ** 3


def iso_threshold(blurred: DataFrame, threshold: float, sigma: float, value: str = "value") -> DataFrame:
    return blurred.filter(F.col(value) > iso_level(threshold, sigma))


# --- layer stacks -------------------------------------------------------------------


@dataclass(frozen=True)
class VolumeLayer:
    voxels: DataFrame
    grid: Grid
    colormap: str = "grayscale"
    window_center: float = 0.5
    window_width: float = 1.0
    threshold_min: float = float("-inf")
    threshold_max: float = float("inf")
    opacity: float = 1.0
    interpolation: str = "trilinear"
    enabled: bool = True


def blend_volume_layers(spark: SparkSession, layers: Sequence[VolumeLayer]) -> DataFrame:
    """Alpha-over of volume layers on the first layer's grid, premultiplied r, g, b, a.

    The base is read directly and painted at its own opacity; overlays are resampled and
    fade with their windowed value. The layer list is unrolled into one expression.
    """
    if not layers:
        raise ValueError("a stack needs at least one layer")
    base = layers[0].grid
    by = subject(*[layer.voxels for layer in layers])
    on = [*by, "i", "j", "k"]
    rows = grid_voxels(spark, base)
    if by:
        # Each subject has a stack of its own, on the grid of the first layer.
        names = layers[0].voxels.select(*by).distinct().withColumn("_one", F.lit(1))
        rows = rows.withColumn("_one", F.lit(1)).join(names, "_one").drop("_one")
    acc: list[Column] = [F.lit(0.0)] * 4
    for n, layer in enumerate(layers):
        if not layer.enabled:
            continue
        if n == 0:
            values = layer.voxels.select(*on, F.col("value").cast("double").alias(f"_v{n}"))
        else:
            values = resample_volume(spark, base, layer.voxels, layer.grid, layer.interpolation)
            values = values.withColumnRenamed("value", f"_v{n}")
        rows = rows.join(values.select(*on, f"_v{n}"), on, "left")
        v = F.col(f"_v{n}")
        seen = is_finite(v) & (v >= layer.threshold_min) & (v <= layer.threshold_max)
        t = window_level(v, layer.window_center - layer.window_width * 0.5, layer.window_center + layer.window_width * 0.5)
        alpha = F.lit(float(layer.opacity)) if n == 0 else t * F.lit(float(layer.opacity))
        color = map_colors(t, layer.colormap)
        over = [color[c] * alpha for c in "rgb"] + [alpha]
        # Materialise each layer's result as columns so the expression stays linear in size.
        rows = rows.withColumns(
            {f"_o{n}{c}": F.when(seen, o + a * (F.lit(1.0) - alpha)).otherwise(a) for c, o, a in zip("rgba", over, acc)}
        )
        acc = [F.col(f"_o{n}{c}") for c in "rgba"]
    return rows.select(*on, *[clamp01(a).alias(c) for a, c in zip(acc, "rgba")])
