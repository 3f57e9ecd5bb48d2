"""Affines, grids and small vector algebra as column expressions (all compute in DOUBLE)."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass
from functools import cached_property

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

XYZ = ("x", "y", "z")
IJK = ("i", "j", "k")


@dataclass(frozen=True)
class Grid:
    """A voxel grid: dimensions and a row-major voxel-to-world affine (voxel centres)."""

    nx: int
    ny: int
    nz: int
    affine: tuple[float, ...]

    @property
    def dims(self) -> tuple[int, int, int]:
        return (self.nx, self.ny, self.nz)

    @cached_property
    def inverse(self) -> tuple[float, ...]:
        return tuple(np.linalg.inv(np.array(self.affine, dtype=float).reshape(4, 4)).ravel().tolist())

    def same_as(self, other: "Grid", tol: float = 1e-3) -> bool:
        return self.dims == other.dims and all(
            abs(a - b) < tol for a, b in zip(self.affine, other.affine)
        )


def scaling_grid(nx: int, ny: int, nz: int, size: float) -> Grid:
    return Grid(nx, ny, nz, (size, 0, 0, 0, 0, size, 0, 0, 0, 0, size, 0, 0, 0, 0, 1))


def read_grid(grids: DataFrame, grid_id: str) -> Grid:
    """One header row of the ``grids`` table."""
    row = grids.filter(F.col("grid_id") == grid_id).select("nx", "ny", "nz", "affine").first()
    if row is None:
        raise ValueError(f"unknown grid {grid_id!r}")
    return Grid(row["nx"], row["ny"], row["nz"], tuple(float(v) for v in row["affine"]))


def apply_affine(m: Sequence[float], x: Column, y: Column, z: Column) -> tuple[Column, Column, Column]:
    """Row-major 4x4 affine on a point; zero coefficients are left out of the expression."""

    def row(r: int) -> Column:
        total: Column | None = None
        for coefficient, axis in zip(m[4 * r : 4 * r + 3], (x, y, z)):
            if coefficient == 0:
                continue
            term = axis if coefficient == 1 else axis * F.lit(float(coefficient))
            total = term if total is None else total + term
        shift = float(m[4 * r + 3])
        if total is None:
            return F.lit(shift)
        return total if shift == 0 else total + F.lit(shift)

    return row(0), row(1), row(2)


def voxel_to_world(grid: Grid, i: Column, j: Column, k: Column) -> tuple[Column, Column, Column]:
    return apply_affine(grid.affine, i.cast("double"), j.cast("double"), k.cast("double"))


def world_to_voxel(grid: Grid, x: Column, y: Column, z: Column) -> tuple[Column, Column, Column]:
    return apply_affine(grid.inverse, x, y, z)


def round_half_away(v: Column) -> Column:
    """Rounding away from zero at halves, kept inside codegen (no decimal detour)."""
    return F.signum(v) * F.floor(F.abs(v) + F.lit(0.5))


def inside(grid: Grid, i: Column, j: Column, k: Column) -> Column:
    return (
        (i >= 0) & (j >= 0) & (k >= 0) & (i < grid.nx) & (j < grid.ny) & (k < grid.nz)
    )


def points_to_voxels(
    pts: DataFrame, grid: Grid, mode: str = "round", keep_outside: bool = False
) -> DataFrame:
    """Add integer ``i, j, k``. ``round`` is the volume rule, ``floor`` the mask rule.

    Points that leave the grid are dropped, or kept with NULL indices.
    """
    if mode not in ("round", "floor"):
        raise ValueError(f"unknown voxel mode {mode!r}")
    snap = round_half_away if mode == "round" else F.floor
    raw = world_to_voxel(grid, F.col("x"), F.col("y"), F.col("z"))
    out = pts.withColumns({c: snap(v).cast("int") for c, v in zip(IJK, raw)})
    ok = inside(grid, F.col("i"), F.col("j"), F.col("k"))
    if not keep_outside:
        return out.filter(ok)
    # Evaluate the test before any index is blanked.
    out = out.withColumn("_ok", ok)
    return out.withColumns({c: F.when(F.col("_ok"), F.col(c)) for c in IJK}).drop("_ok")


def flat_index(i: Column, j: Column, k: Column, nx: int, ny: int) -> Column:
    return i.cast("long") + j.cast("long") * nx + k.cast("long") * (nx * ny)


def unflatten(flat: Column, nx: int, ny: int) -> tuple[Column, Column, Column]:
    return (
        F.pmod(flat, F.lit(nx)).cast("int"),
        F.pmod(F.floor(flat / nx), F.lit(ny)).cast("int"),
        F.floor(flat / (nx * ny)).cast("int"),
    )


def grid_voxels(spark: SparkSession, grid: Grid) -> DataFrame:
    """Every (i, j, k) of a grid, generated in parallel."""
    flat = spark.range(grid.nx * grid.ny * grid.nz)
    return flat.select(*[c.alias(n) for c, n in zip(unflatten(F.col("id"), grid.nx, grid.ny), IJK)])


def min_voxel_size(affine: Sequence[float]) -> float:
    m = np.array(affine, dtype=float).reshape(4, 4)
    return float(np.sqrt((m[:3, :3] ** 2).sum(axis=0)).min())


def min_voxel_size_column(affine: Column) -> Column:
    """The same on an ``affine`` array column."""

    def norm(c: int) -> Column:
        parts = [F.get(affine, F.lit(4 * r + c)) for r in range(3)]
        return F.sqrt(parts[0] * parts[0] + parts[1] * parts[1] + parts[2] * parts[2])

    return F.least(norm(0), norm(1), norm(2))


def affine_from_sform(headers: DataFrame) -> DataFrame:
    """``srow_x/y/z`` arrays of four -> row-major affine."""
    bottom = F.array(*[F.lit(v) for v in (0.0, 0.0, 0.0, 1.0)])
    return headers.withColumn("affine", F.concat("srow_x", "srow_y", "srow_z", bottom))


def affine_from_qform(headers: DataFrame) -> DataFrame:
    """Unit quaternion (b, c, d), offsets and voxel sizes -> row-major affine."""
    b, c, d = (F.col(f"quatern_{n}") for n in "bcd")
    residue = F.lit(1.0) - (b * b + c * c + d * d)
    flat = residue < 1e-7
    unit = F.when(flat, F.lit(1.0) / F.sqrt(b * b + c * c + d * d)).otherwise(F.lit(1.0))
    a = F.when(flat, F.lit(0.0)).otherwise(F.sqrt(F.greatest(residue, F.lit(0.0))))
    b, c, d = b * unit, c * unit, d * unit
    sx, sy, sz = (F.when(F.col(f"pixdim_{n}") > 0, F.col(f"pixdim_{n}")).otherwise(F.lit(1.0)) for n in "123")
    sz = F.when(F.col("pixdim_0") < 0, -sz).otherwise(sz)
    two = F.lit(2.0)
    rows = [
        [(a * a + b * b - c * c - d * d) * sx, two * (b * c - a * d) * sy, two * (b * d + a * c) * sz, F.col("qoffset_x")],
        [two * (b * c + a * d) * sx, (a * a + c * c - b * b - d * d) * sy, two * (c * d - a * b) * sz, F.col("qoffset_y")],
        [two * (b * d - a * c) * sx, two * (c * d + a * b) * sy, (a * a + d * d - b * b - c * c) * sz, F.col("qoffset_z")],
        [F.lit(0.0), F.lit(0.0), F.lit(0.0), F.lit(1.0)],
    ]
    return headers.withColumn("affine", F.array(*[v.cast("double") for r in rows for v in r]))


def header_affines(headers: DataFrame) -> DataFrame:
    """Quaternion form first, row form second; a header with neither is an error."""
    q = affine_from_qform(headers).select(F.col("affine").alias("_q"), *headers.columns)
    s = affine_from_sform(q).withColumnRenamed("affine", "_s")
    chosen = (
        F.when(F.col("qform_code") > 0, F.col("_q"))
        .when(F.col("sform_code") > 0, F.col("_s"))
        .otherwise(F.raise_error(F.lit("header has neither a quaternion nor a row affine")))
    )
    return s.withColumn("affine", chosen).drop("_q", "_s")


# Slice axis 0 is axial (k, z), 1 coronal (j, y), 2 sagittal (i, x).
SLICE_AXIS = {0: 2, 1: 1, 2: 0}


def _slice_base(grid: Grid, axis: int) -> tuple[float, float]:
    a = SLICE_AXIS[axis]
    m = np.array(grid.affine, dtype=float).reshape(4, 4)
    centre = np.array([(n - 1) * 0.5 for n in grid.dims] + [1.0])
    centre[a] = 0.0
    return float((m @ centre)[a]), float(m[a, a])


def slice_world_position(grid: Grid, axis: int, index: Column) -> Column:
    """World coordinate of slice ``index`` at the grid centre."""
    base, step = _slice_base(grid, axis)
    return F.lit(base) + index.cast("double") * F.lit(step)


def nearest_slice_index(grid: Grid, axis: int, position: Column) -> Column:
    base, step = _slice_base(grid, axis)
    last = grid.dims[SLICE_AXIS[axis]] - 1
    if abs(step) > 1e-6:
        at = (position - F.lit(base)) / F.lit(step)
    else:
        at = F.lit(last * 0.5)
    return F.greatest(F.lit(0), F.least(F.lit(last), round_half_away(at).cast("int")))


def norm(x: Column, y: Column, z: Column) -> Column:
    return F.sqrt(x * x + y * y + z * z)


def unit_or_zero(x: Column, y: Column, z: Column) -> tuple[Column, Column, Column]:
    length = norm(x, y, z)
    zero = F.lit(0.0)
    return tuple(F.when(length > 0, v / length).otherwise(zero) for v in (x, y, z))


def bounds(pts: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    aggs = [F.min(c).alias(f"min_{c}") for c in XYZ] + [F.max(c).alias(f"max_{c}") for c in XYZ]
    return pts.groupBy(*by).agg(*aggs)


def attach_bounds(rows: DataFrame, pts: DataFrame) -> DataFrame:
    """Add ``min_x .. max_z`` of ``pts`` to each row: per subject, or as one row of literals."""
    by = ["subject_id"] if "subject_id" in pts.columns and "subject_id" in rows.columns else []
    box = bounds(pts, by)
    if by:
        return rows.join(F.broadcast(box), by)
    values = box.first()
    return rows.withColumns(
        {f"{e}_{c}": F.lit(values[f"{e}_{c}"]).cast("double") for e in ("min", "max") for c in XYZ}
    )
