"""U-shape fits: plane, parabola and triangle of each streamline."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.functions import pandas_udf
from pyspark.sql.types import DoubleType, StructField, StructType

from axonframe.functions.geometry import XYZ
from axonframe.functions.scan import lookup, streamline_keys
from axonframe.operators.selection import stride_sample

TINY = 1e-12
FLAT = 1e-6
PAIRS = ("xx", "xy", "xz", "yy", "yz", "zz")


def _doubles(*names: str) -> StructType:
    return StructType([StructField(n, DoubleType()) for n in names])


def _frame(**columns: np.ndarray) -> pd.DataFrame:
    return pd.DataFrame({f"{name}{c}": v[:, n] for name, v in columns.items() for n, c in enumerate(XYZ)})


def _vectors(frame: pd.DataFrame, name: str) -> np.ndarray:
    return frame[[f"{name}{c}" for c in XYZ]].to_numpy(dtype="float64")


def _unit(v: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Unit vectors and whether they are long enough to have a direction."""
    square = (v * v).sum(axis=1)
    fine = square >= TINY
    return v / np.sqrt(np.where(fine, square, 1.0))[:, None], fine


@pandas_udf(_doubles("ux", "uy", "uz", "vx", "vy", "vz", "ok"))
def _plane_axes(c: pd.DataFrame) -> pd.DataFrame:
    """In-plane axes of a batch of streamlines: along the chord (u) and across it (v)."""
    m = np.empty((len(c), 3, 3))
    for name in PAIRS:
        a, b = "xyz".index(name[0]), "xyz".index(name[1])
        m[:, a, b] = m[:, b, a] = c[name].to_numpy(dtype="float64")
    normal = np.linalg.eigh(m)[1][:, :, 0]
    chord = _vectors(c, "h")
    u, fine = _unit(chord - normal * (chord * normal).sum(axis=1)[:, None])
    return _frame(u=u, v=np.cross(normal, u)).assign(ok=fine.astype("float64"))


TRIANGLE = [f"{n}_{c}" for n in ("apex", "e1", "e2", "plane_normal") for c in XYZ]


@pandas_udf(_doubles(*TRIANGLE, "ok"))
def _triangle(s: pd.DataFrame) -> pd.DataFrame:
    """Least-squares parabola of a batch of streamlines from its sums, read as a triangle."""
    col = {n: s[n].to_numpy(dtype="float64") for n in ("n", "s1", "s2", "s3", "s4", "r0", "r1", "r2", "u_min", "u_max", "v_mid")}
    sign = np.where(col["v_mid"] < 0, -1.0, 1.0)
    normal_matrix = np.array([[col["s4"], col["s3"], col["s2"]], [col["s3"], col["s2"], col["s1"]], [col["s2"], col["s1"], col["n"]]])
    normal_matrix = np.moveaxis(normal_matrix, 2, 0)
    sums = np.stack([col["r2"], col["r1"], col["r0"]], axis=1) * sign[:, None]
    solvable = np.abs(np.linalg.det(normal_matrix)) >= TINY
    normal_matrix[~solvable] = np.eye(3)
    a, b, c = np.linalg.solve(normal_matrix, sums[:, :, None])[:, :, 0].T
    curved = solvable & (np.abs(a) >= FLAT)
    centre, u, v = _vectors(s, "c"), _vectors(s, "u"), _vectors(s, "v") * sign[:, None]

    def on_curve(at: np.ndarray) -> np.ndarray:
        at = np.clip(at, col["u_min"], col["u_max"])
        return centre + u * at[:, None] + v * (a * at * at + b * at + c)[:, None]

    apex = on_curve(-b / np.where(curved, 2.0 * a, 1.0))
    e1, e2 = (on_curve(((_vectors(s, end) - centre) * u).sum(axis=1)) for end in ("first", "last"))
    side = e2 - e1
    normal, tilted = _unit(np.cross(side, apex - (e1 + e2) * 0.5))
    ok = curved & tilted & ((side * side).sum(axis=1) >= TINY)
    out = np.hstack([apex, e1, e2, normal])
    return pd.DataFrame(out, columns=TRIANGLE).assign(ok=ok.astype("float64"))


def fit_parabola_triangle(pts: DataFrame) -> DataFrame:
    """Apex, both feet and plane normal of the parabola through each streamline.

    Two aggregation passes (moments, then plane coordinates) stay in Spark, so no streamline
    is gathered in one place; only the small 3x3 algebra per streamline runs in Arrow
    batches. Streamlines with fewer than four points or a degenerate or flat fit have no row.
    """
    keys = streamline_keys(pts)
    vertex = F.struct(*XYZ)
    stats = pts.groupBy(*keys).agg(
        F.count("*").alias("n"),
        *[F.avg(c).alias(f"c{c}") for c in XYZ],
        # Centred sums: far from the origin, sums of products lose the small axis.
        *[(F.covar_pop(p[0], p[1]) * F.count("*")).alias(p) for p in PAIRS],
        F.min_by(vertex, "point_idx").alias("first"),
        F.max_by(vertex, "point_idx").alias("last"),
    ).filter(F.col("n") >= 4)
    spread = [F.col(p) for p in PAIRS]
    chord = [(F.col("last")[c] - F.col("first")[c]).alias(f"h{c}") for c in XYZ]
    ends = [F.col(e)[c].alias(f"{e}{c}") for e in ("first", "last") for c in XYZ]
    centre = [f"c{c}" for c in XYZ]
    axes = stats.select(*keys, "n", *centre, *ends, _plane_axes(F.struct(*spread, *chord)).alias("_a"))
    axes = axes.select(*keys, "n", *centre, *[f"{e}{c}" for e in ("first", "last") for c in XYZ], "_a.*").filter("ok > 0").drop("ok")
    rows = lookup(pts.select(*keys, "point_idx", *XYZ), axes, keys)
    offset = [F.col(c) - F.col(f"c{c}") for c in XYZ]
    rows = rows.withColumns(
        {f"_{a}": sum((o * F.col(f"{a}{c}") for o, c in zip(offset, XYZ)), F.lit(0.0)) for a in "uv"}
    )
    u, v = F.col("_u"), F.col("_v")
    middle = F.col("point_idx") == F.floor(F.col("n") / 2)
    carried = [c for c in axes.columns if c not in keys]
    sums = rows.groupBy(*keys).agg(
        *[F.first(c).alias(c) for c in carried],
        F.min("_u").alias("u_min"), F.max("_u").alias("u_max"),
        F.sum(u).alias("s1"), F.sum(u * u).alias("s2"), F.sum(u * u * u).alias("s3"), F.sum(u * u * u * u).alias("s4"),
        F.sum(v).alias("r0"), F.sum(u * v).alias("r1"), F.sum(u * u * v).alias("r2"),
        F.max(F.when(middle, v)).alias("v_mid"),
    )
    fit = sums.select(*keys, _triangle(F.struct(*[c for c in sums.columns if c not in keys])).alias("_t"))
    fit = fit.filter("_t.ok > 0")
    return fit.select(
        *keys,
        *[F.struct(*[F.col(f"_t.{n}_{c}").alias(c) for c in XYZ]).alias(n) for n in ("apex", "e1", "e2", "plane_normal")],
    )


def triangle_segments(
    pts: DataFrame,
    groups: DataFrame | None = None,
    stride: int = 1,
    normal_len_mm: float = 3.0,
    show_triangles: bool = True,
    show_normals: bool = True,
) -> DataFrame:
    """Two-point segments of every fitted triangle, plus its normal centred on the apex.

    Triangle edges keep the streamline's first group; normals go to ``apex_normals``.
    """
    keys = streamline_keys(pts)
    if stride > 1:
        pts = lookup(pts, stride_sample(pts.select(*keys).distinct(), stride), keys, "left_semi")
    fits = fit_parabola_triangle(pts)
    if groups is None:
        fits = fits.withColumn("_g", F.lit("triangles"))
    else:
        first = groups.groupBy(*streamline_keys(pts, groups)).agg(F.min("group_name").alias("_g"))
        fits = lookup(fits, first, keys, "left").withColumn("_g", F.coalesce("_g", F.lit("triangles")))
    half = F.lit(normal_len_mm * 0.5)

    def shifted(sign: float) -> Column:
        return F.struct(*[(F.col("apex")[c] + F.col("plane_normal")[c] * half * sign).alias(c) for c in XYZ])

    def piece(n: int, a: Column, b: Column, group: Column) -> Column:
        return F.struct(F.lit(n).alias("piece"), group.alias("group_name"), a.alias("a"), b.alias("b"))

    apex, e1, e2 = F.col("apex"), F.col("e1"), F.col("e2")
    pieces = []
    if show_triangles:
        pieces += [piece(0, e1, apex, F.col("_g")), piece(1, apex, e2, F.col("_g")), piece(2, e1, e2, F.col("_g"))]
    if show_normals:
        pieces.append(piece(3, shifted(-1.0), shifted(1.0), F.lit("apex_normals")))
    return fits.withColumn("_s", F.explode(F.array(*pieces))).select(*keys, "_s.*")
