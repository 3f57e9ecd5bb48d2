"""Voxel lookups at points: nearest, trilinear and masked array-valued interpolation."""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, DoubleType, StructField, StructType

from axonframe.functions.bricks import AT, Bricks, make_bricks
from axonframe.functions.geometry import (
    XYZ,
    Grid,
    grid_voxels,
    inside,
    points_to_voxels,
    voxel_to_world,
    world_to_voxel,
)
from axonframe.functions.scan import lookup, streamline_keys, subject, voxel_keys


def sample_nearest(
    pts: DataFrame, voxels: DataFrame, grid: Grid, name: str = "value", outside: float | None = None
) -> DataFrame:
    """Value of the nearest voxel; NULL (or ``outside``) where there is none."""
    on = voxel_keys(pts, voxels)
    seated = points_to_voxels(pts, grid, "round", keep_outside=True)
    values = voxels.select(*on, F.col("value").cast("double").alias(name))
    found = lookup(seated, values, on, "left", spread=True).drop("i", "j", "k")
    return found if outside is None else found.withColumn(name, F.coalesce(name, F.lit(float(outside))))


CORNERS = [(a, b, c) for a in (0, 1) for b in (0, 1) for c in (0, 1)]


def _seated(rows: DataFrame, bricks: Bricks, grid: Grid) -> tuple[DataFrame, list[Column]]:
    """Rows beside the brick of their base voxel, and the weights of the eight corners in order."""
    raw = world_to_voxel(grid, *[F.col(c) for c in XYZ])
    base = [F.floor(v) for v in raw]
    rows = rows.withColumns({f"_b{c}": b for c, b in zip(XYZ, base)} | {f"_f{c}": v - b for c, v, b in zip(XYZ, raw, base)})
    rows = bricks.beside(rows, [F.col(f"_b{c}").cast("int") for c in XYZ])
    weights = []
    for corner in CORNERS:
        share = [F.col(f"_f{c}") if d else F.lit(1.0) - F.col(f"_f{c}") for c, d in zip(XYZ, corner)]
        weights.append(share[0] * share[1] * share[2])
    return rows, weights


def sample_trilinear(pts: DataFrame, voxels: DataFrame, grid: Grid, name: str = "value") -> DataFrame:
    """Adds the eight-corner interpolation at each point, NULL where a corner leaves the grid or
    has no voxel. One lookup a point: the volume comes as bricks."""
    bricks = make_bricks(voxels, F.col("value").cast("double"), subject(pts, voxels))
    rows, weights = _seated(pts, bricks, grid)
    base = [F.col(f"_b{c}") for c in XYZ]
    within = inside(grid, *base) & inside(grid, *[b + 1 for b in base])
    total = None
    for corner, weight in zip(CORNERS, weights):
        term = weight * bricks.cell(*corner)
        total = term if total is None else total + term
    return rows.select(*pts.columns, F.when(within, total).alias(name))


def sample_masked_trilinear(
    pts: DataFrame,
    coeffs: DataFrame,
    grid: Grid,
    gate: str | None = None,
    threshold: float = 0.0,
    min_weight: float = 0.01,
) -> DataFrame:
    """Adds ``coeffs``, the array-valued interpolation over the corners that exist and pass the gate.

    ``coeffs``: i, j, k, coeffs ARRAY<DOUBLE> and optionally the gate column. Weights are
    renormalised; a total weight under ``min_weight`` gives no row.
    """
    present = coeffs if gate is None else coeffs.filter(F.col(gate) >= threshold)
    bricks = make_bricks(present, F.col("coeffs").cast("array<double>"), subject(pts, coeffs), bits=2)
    raw = world_to_voxel(grid, *[F.col(c) for c in XYZ])
    row = F.struct(*[F.col(c) for c in pts.columns])
    seated = pts.select(*bricks.by, row.alias("row"), *[v.alias(f"_v{c}") for c, v in zip(XYZ, raw)])
    seated = seated.withColumns({b: F.shiftright(F.floor(f"_v{c}").cast("int"), bricks.bits) for b, c in zip(AT, XYZ)})
    at = [*bricks.by, *AT]
    # Points of a brick that lie in one partition share a row, so the brick is copied once for many of them.
    seated = seated.sortWithinPartitions(*at)
    of = {f.name: f for f in seated.schema.fields}
    fields = [of[c] for c in at] + [StructField(c, ArrayType(of[c].dataType)) for c in ("row", *[f"_v{c}" for c in XYZ])]
    sets = seated.mapInArrow(_brick_sets(at), StructType(fields))
    met = lookup(sets, bricks.table, at, spread=True).select("row", *[f"_v{c}" for c in XYZ], "_cells")
    out = StructType([*pts.schema.fields, StructField("coeffs", ArrayType(DoubleType()))])
    return met.mapInArrow(_weighted(grid.dims, bricks.bits, bricks.low, bricks.edge, min_weight), out)


#: Points of a brick that go in one row.
POINTS = 1024


def _brick_sets(at: Sequence[str]):
    """Rows sorted by ``at`` -> one row per run of equal ones, the other columns as arrays."""

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            n = batch.num_rows
            if not n:
                continue
            new = np.zeros(n, bool)
            new[::POINTS] = True
            for c in at:
                changed = pc.not_equal(batch[c].slice(1), batch[c].slice(0, n - 1))
                nulls = pc.not_equal(pc.is_null(batch[c].slice(1)), pc.is_null(batch[c].slice(0, n - 1)))
                new[1:] |= pc.or_(pc.fill_null(changed, False), nulls).to_numpy(zero_copy_only=False)
            begins = np.flatnonzero(new)
            offsets, first = pa.array(np.append(begins, n), pa.int32()), pa.array(begins)
            others = [c for c in batch.schema.names if c not in at]
            lists = [pa.ListArray.from_arrays(offsets, batch[c]) for c in others]
            yield pa.RecordBatch.from_arrays([*(batch[c].take(first) for c in at), *lists], [*at, *others])

    return cut


def _weighted(dims: tuple[int, int, int], bits: int, low: int, edge: int, min_weight: float):
    """Points of a brick, in fractional voxels, and its cells -> the weighted means of the cells around each."""

    def of_brick(v: np.ndarray, cells: pa.ListArray) -> tuple[np.ndarray, pa.ListArray]:
        there = cells.is_valid().to_numpy(zero_copy_only=False)
        lengths = cells.value_lengths().fill_null(0).to_numpy(zero_copy_only=False)
        width = int(lengths.max(initial=0))
        own = lengths[:, None] > np.arange(width)
        table, known = np.zeros((len(cells), width)), np.zeros((len(cells), width), bool)
        values = cells.flatten()
        table[own] = values.fill_null(0.0).to_numpy(zero_copy_only=False)
        known[own] = values.is_valid().to_numpy(zero_copy_only=False)
        whole = bool(known[there].all())
        base = np.floor(v)
        share = v - base
        local = (base.astype("int64") & ((1 << bits) - 1)) + low
        total, mass = np.zeros((len(v), width)), np.zeros(len(v))
        sure, longest = np.ones((len(v), width), bool), np.zeros(len(v), "int64")
        for corner in CORNERS:
            w = np.ones(len(v))
            within = np.ones(len(v), bool)
            for n, d in enumerate(corner):
                w = w * (share[:, n] if d else 1.0 - share[:, n])
                within &= (base[:, n] + d >= 0) & (base[:, n] + d < dims[n])
            seat = ((local[:, 0] + corner[0]) * edge + local[:, 1] + corner[1]) * edge + local[:, 2] + corner[2]
            take = np.flatnonzero(within & (w > 0) & there[seat])
            mass[take] += w[take]
            total[take] += w[take, None] * table[seat[take]]
            if not whole:
                sure[take] &= known[seat[take]]
                longest[take] = np.maximum(longest[take], lengths[seat[take]])
        met = (mass > 0) & (mass >= min_weight)
        means = total / np.where(met, mass, 1.0)[:, None]
        if whole:
            values, sizes = pa.array(means[met].ravel()), np.full(int(met.sum()), width)
        else:
            inside_ = (longest[:, None] > np.arange(width)) & met[:, None]
            values, sizes = pa.array(means[inside_], mask=~sure[inside_]), longest[met]
        ends = pa.array(np.append(0, np.cumsum(sizes)), pa.int32())
        return np.flatnonzero(met), pa.ListArray.from_arrays(ends, values)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for n in range(batch.num_rows):
                one = batch.slice(n, 1)
                v = np.stack([one[f"_v{c}"].flatten().to_numpy(zero_copy_only=False) for c in XYZ], 1)
                met, means = of_brick(v, one["_cells"].flatten())
                rows = one["row"].flatten().take(pa.array(met))
                yield pa.RecordBatch.from_arrays([*rows.flatten(), means], [*(f.name for f in rows.type), "coeffs"])

    return run


def sample_volume_along_streamline(
    pts: DataFrame, voxels: DataFrame, grid: Grid, name: str, dps: DataFrame | None = None
) -> DataFrame:
    """Mean of the in-bounds trilinear samples of each streamline as a long DPS table.

    A streamline without a sample gets NaN. An existing field of the same name is replaced.
    """
    keys = streamline_keys(pts)
    sampled = sample_trilinear(pts.select(*keys, *XYZ), voxels, grid, "_v")
    means = sampled.groupBy(*keys).agg(F.coalesce(F.avg("_v"), F.lit(float("nan"))).alias("value"))
    means = means.select(*keys, F.lit(name).alias("field"), "value")
    if dps is None:
        return means
    return dps.filter(F.col("field") != name).select(*means.columns).unionByName(means)


def glyph_gate_values(voxels: DataFrame, volume: DataFrame, grid: Grid, volume_grid: Grid) -> DataFrame:
    """Nearest volume value at each voxel centre, NaN where there is none."""
    world = voxel_to_world(grid, F.col("i"), F.col("j"), F.col("k"))
    rows = voxels.select(*voxels.columns, *[w.alias(c) for w, c in zip(world, XYZ)])
    rows = rows.withColumnsRenamed({n: f"_{n}" for n in "ijk"})
    out = sample_nearest(rows, volume, volume_grid, "gate", outside=float("nan"))
    return out.withColumnsRenamed({f"_{n}": n for n in "ijk"}).drop(*XYZ)


def resample_volume(
    spark: SparkSession, target: Grid, voxels: DataFrame, grid: Grid, interpolation: str = "trilinear"
) -> DataFrame:
    """Values of ``voxels`` at the voxel centres of ``target``, per subject; NULL outside."""
    if interpolation not in ("nearest", "trilinear"):
        raise ValueError(f"unknown interpolation {interpolation!r}")
    by = subject(voxels)
    cells = grid_voxels(spark, target)
    world = voxel_to_world(target, F.col("i"), F.col("j"), F.col("k"))
    centres = cells.select(*[F.col(n).alias(f"t{n}") for n in "ijk"], *[w.alias(c) for w, c in zip(world, XYZ)])
    if by:
        # The grid once for every subject.
        names = voxels.select(*by).distinct().withColumn("_one", F.lit(1))
        centres = centres.withColumn("_one", F.lit(1)).join(names, "_one").drop("_one")
    sampled = sample_nearest(centres, voxels, grid) if interpolation == "nearest" else sample_trilinear(centres, voxels, grid)
    return sampled.select(*by, *[F.col(f"t{n}").alias(n) for n in "ijk"], "value")


def join_labels(rows: DataFrame, labels: DataFrame) -> DataFrame:
    """Label name and colour; unnamed labels get "Label n" and a generated colour."""
    from axonframe.functions.color import label_color

    names = labels.select("label", F.col("name").alias("label_name"), *[c for c in "rgb" if c in labels.columns])
    out = lookup(rows, names, ["label"], "left", spread=True)
    generated = label_color(F.col("label"))
    out = out.withColumn("label_name", F.coalesce("label_name", F.concat(F.lit("Label "), F.col("label").cast("string"))))
    for c in "rgb":
        own: Column = F.col(c) if c in names.columns else F.lit(None).cast("double")
        out = out.withColumn(f"label_{c}", F.coalesce(own, generated[c]))
    return out.drop(*[c for c in "rgb" if c in names.columns])
