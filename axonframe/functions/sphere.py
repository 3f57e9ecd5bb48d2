"""A triangulated unit sphere used as direction bins."""

from __future__ import annotations

from functools import lru_cache

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.functions import pandas_udf
from pyspark.sql.types import IntegerType, StructField, StructType

FULL_DETAIL = 3  # 10 * 4**3 + 2 = 642 bins
BATCH = 4096
#: Each face of the cube has so many cells a side, in which few bins can be nearest.
CELLS = 48


@lru_cache(maxsize=None)
def icosphere(detail: int = FULL_DETAIL) -> tuple[np.ndarray, np.ndarray]:
    """(directions, triangles) of an icosahedron split ``detail`` times."""
    g = (1.0 + 5.0**0.5) / 2.0
    signs = [(s, t * g) for s in (-1.0, 1.0) for t in (-1.0, 1.0)]
    points = [(0.0, a, b) for a, b in signs] + [(a, b, 0.0) for a, b in signs] + [(b, 0.0, a) for a, b in signs]
    v = np.array(points)
    v = v / np.linalg.norm(v, axis=1, keepdims=True)
    # Faces are the triples of mutually adjacent corners.
    edge = np.sort(np.linalg.norm(v[:, None] - v[None, :], axis=2).ravel())[12]
    near = np.abs(np.linalg.norm(v[:, None] - v[None, :], axis=2) - edge) < 1e-6
    faces = [
        (a, b, c)
        for a in range(12)
        for b in range(a + 1, 12)
        for c in range(b + 1, 12)
        if near[a, b] and near[b, c] and near[a, c]
    ]
    vertices = [tuple(p) for p in v]
    for _ in range(detail):
        middle: dict[tuple[int, int], int] = {}

        def halfway(a: int, b: int) -> int:
            key = (min(a, b), max(a, b))
            if key not in middle:
                m = np.array(vertices[a]) + np.array(vertices[b])
                vertices.append(tuple(m / np.linalg.norm(m)))
                middle[key] = len(vertices) - 1
            return middle[key]

        split = []
        for a, b, c in faces:
            ab, bc, ca = halfway(a, b), halfway(b, c), halfway(c, a)
            split += [(a, ab, ca), (ab, b, bc), (ca, bc, c), (ab, bc, ca)]
        faces = split
    return np.array(vertices), np.array(faces)


def bin_count(detail: int = FULL_DETAIL) -> int:
    return len(icosphere(detail)[0])


@lru_cache(maxsize=None)
def neighbour_pairs(detail: int = FULL_DETAIL) -> tuple[tuple[int, int], ...]:
    _, faces = icosphere(detail)
    pairs = set()
    for a, b, c in faces.tolist():
        for u, w in ((a, b), (b, c), (c, a)):
            pairs |= {(u, w), (w, u)}
    return tuple(sorted(pairs))


def sphere_bins(spark: SparkSession, detail: int = FULL_DETAIL) -> DataFrame:
    """``bin, dx, dy, dz``: a fixed table of 10 * 4**detail + 2 rows."""
    d, _ = icosphere(detail)
    frame = pd.DataFrame({"bin": np.arange(len(d), dtype="int32"), "dx": d[:, 0], "dy": d[:, 1], "dz": d[:, 2]})
    return spark.createDataFrame(frame)


def sphere_neighbours(spark: SparkSession, detail: int = FULL_DETAIL) -> DataFrame:
    """``bin, neighbour``: at most six rows per bin."""
    return spark.createDataFrame(pd.DataFrame(neighbour_pairs(detail), columns=["bin", "neighbour"], dtype="int32"))


def _cells(v: np.ndarray) -> np.ndarray:
    """Number of the cell of each direction: a face of the cube around the sphere, cut into CELLS x CELLS."""
    rows = np.arange(len(v))
    axis = np.argmax(np.abs(v), axis=1)
    major = v[rows, axis]
    u, w = v[rows, (axis + 1) % 3] / np.abs(major), v[rows, (axis + 2) % 3] / np.abs(major)
    a, b = (np.clip(((c + 1.0) * (CELLS / 2)).astype("int64"), 0, CELLS - 1) for c in (u, w))
    return ((axis * 2 + (major < 0)) * CELLS + a) * CELLS + b


@lru_cache(maxsize=None)
def cell_bins(detail: int = FULL_DETAIL) -> np.ndarray:
    """The bins that can be nearest to a direction of each cell, ascending; the first one fills the row.

    With r the angle from a cell's centre to its farthest corner, a bin that is nearest anywhere in the
    cell is at most 2 r farther from the centre than the centre's own nearest bin.
    """
    directions, _ = icosphere(detail)
    side = np.linspace(-1.0, 1.0, CELLS + 1)
    middle = (side[1:] + side[:-1]) / 2
    found = []
    for face in range(6):
        axis, sign = face // 2, 1.0 - 2.0 * (face % 2)

        def unit(a: np.ndarray, b: np.ndarray) -> np.ndarray:
            v = np.empty((a.size, 3))
            v[:, axis], v[:, (axis + 1) % 3], v[:, (axis + 2) % 3] = sign, a.ravel(), b.ravel()
            return v / np.linalg.norm(v, axis=1, keepdims=True)

        centre = unit(*np.meshgrid(middle, middle, indexing="ij"))
        corners = [unit(*np.meshgrid(x, y, indexing="ij")) for x in (side[1:], side[:-1]) for y in (side[1:], side[:-1])]
        reach = np.arccos(np.clip(np.min([(centre * c).sum(1) for c in corners], axis=0), -1.0, 1.0))
        angle = np.arccos(np.clip(centre @ directions.T, -1.0, 1.0))
        found += [np.flatnonzero(near) for near in angle <= (angle.min(1) + 2 * reach + 1e-6)[:, None]]
    out = np.repeat([[f[0]] for f in found], max(map(len, found)), axis=1).astype("int16" if len(directions) < 1 << 15 else "int32")
    for row, f in zip(out, found):
        row[: len(f)] = f
    return out


def pick_bins(v: np.ndarray, directions: np.ndarray, cells: np.ndarray) -> np.ndarray:
    """``argmax(v @ directions.T, axis=1)``, the first of equal ones, of the bins that each cell may have."""
    out = np.zeros(len(v), dtype="int32")
    size = np.abs(v).max(axis=1) if len(v) else np.zeros(0)
    # Zero and NaN have equal products with all bins: the first one.
    plain = (size > 1e-100) & (size < 1e100)
    for lo in range(0, len(v), BATCH):
        at = np.flatnonzero(plain[lo : lo + BATCH]) + lo
        if len(at):
            p = v[at]
            near = cells[_cells(p)]
            dots = p[:, 0:1] * directions[:, 0][near] + p[:, 1:2] * directions[:, 1][near] + p[:, 2:3] * directions[:, 2][near]
            out[at] = near[np.arange(len(at)), np.argmax(dots, axis=1)]
    for n in np.flatnonzero(~plain & ~np.isnan(v).any(axis=1) & (size > 0)):
        out[n] = np.argmax(v[n, 0] * directions[:, 0] + v[n, 1] * directions[:, 1] + v[n, 2] * directions[:, 2])
    return out


def opposite_bins(dx: Column, dy: Column, dz: Column, detail: int = FULL_DETAIL) -> Column:
    """Struct (bin, opposite): the bins with the largest dot product with the direction and
    with its negative; the first one wins a tie.

    Arrow batches against the few bins of a direction's cell: no row is multiplied by the bin count.
    """
    directions, cells = np.asfortranarray(icosphere(detail)[0]), cell_bins(detail)
    result = StructType([StructField(n, IntegerType()) for n in ("bin", "opposite")])

    @pandas_udf(result)
    def pick(x: pd.Series, y: pd.Series, z: pd.Series) -> pd.DataFrame:
        v = np.stack([s.to_numpy(dtype="float64") for s in (x, y, z)], axis=1)
        return pd.DataFrame({"bin": pick_bins(v, directions, cells), "opposite": pick_bins(-v, directions, cells)})

    return pick(dx, dy, dz)


def nearest_bin(dx: Column, dy: Column, dz: Column, detail: int = FULL_DETAIL) -> Column:
    """Index of the bin with the largest dot product; the first one wins a tie."""
    return opposite_bins(dx, dy, dz, detail)["bin"]


@lru_cache(maxsize=None)
def smoothing_kernel(fwhm_deg: float, detail: int = FULL_DETAIL) -> np.ndarray:
    """Row-normalised Gaussian weights over the angle between bins."""
    d, _ = icosphere(detail)
    sigma = max(np.radians(fwhm_deg) / 2.354820045, 1e-4)
    angle = np.arccos(np.clip(d @ d.T, -1.0, 1.0))
    weights = np.exp(-(angle**2) * 0.5 / sigma**2)
    return weights / weights.sum(axis=1, keepdims=True)
