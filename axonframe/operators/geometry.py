"""Ordered per-streamline operators: segments, tangents, lengths, boxes, rasters."""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from axonframe.functions.geometry import XYZ, Grid, bounds, inside, norm, unit_or_zero, world_to_voxel
from axonframe.functions.scan import cut_lineage, lookup, running_sum, streamline_keys, subject, with_neighbours

SAME_POINT_MM = 1e-4


def segments(pts: DataFrame) -> DataFrame:
    """Consecutive vertex pairs: ends, midpoint, length and unit direction (zero if degenerate)."""
    keys = streamline_keys(pts)
    pairs = with_neighbours(pts.select(*keys, "point_idx", *XYZ), keys, after=XYZ)
    pairs = pairs.filter(F.col("next_x").isNotNull())
    delta = [F.col(f"next_{c}") - F.col(c) for c in XYZ]
    direction = unit_or_zero(*delta)
    return pairs.select(
        *keys,
        F.col("point_idx").alias("segment_idx"),
        *[F.col(c).alias(f"{c}0") for c in XYZ],
        *[F.col(f"next_{c}").alias(f"{c}1") for c in XYZ],
        *[((F.col(c) + F.col(f"next_{c}")) * 0.5).alias(f"m{c}") for c in XYZ],
        norm(*delta).alias("length"),
        *[d.alias(f"u{c}") for d, c in zip(direction, XYZ)],
    )


def tangents(pts: DataFrame) -> DataFrame:
    """Unit tangent per vertex: one-sided at the ends, central inside; lone vertices get 0.5s."""
    keys = streamline_keys(pts)
    near = with_neighbours(pts, keys, before=XYZ, after=XYZ)
    lone = F.col("prev_x").isNull() & F.col("next_x").isNull()
    raw = [F.coalesce(F.col(f"next_{c}"), F.col(c)) - F.coalesce(F.col(f"prev_{c}"), F.col(c)) for c in XYZ]
    out = near.withColumns(
        {f"t{c}": F.when(lone, F.lit(0.5)).otherwise(v) for c, v in zip(XYZ, unit_or_zero(*raw))}
    )
    return out.drop(*[f"{e}_{c}" for e in ("prev", "next") for c in XYZ])


def streamline_length(pts: DataFrame) -> DataFrame:
    """Arc length per streamline; streamlines of one vertex have no row."""
    keys = streamline_keys(pts)
    return segments(pts).groupBy(*keys).agg(F.sum("length").alias("length_mm"))


def length_extents(pts: DataFrame) -> DataFrame:
    """Shortest and longest positive length; (0, 0) if there is none."""
    lengths = streamline_length(pts).filter(F.col("length_mm") > 0)
    return lengths.groupBy(*subject(pts)).agg(
        F.coalesce(F.min("length_mm"), F.lit(0.0)).alias("min_length_mm"),
        F.coalesce(F.max("length_mm"), F.lit(0.0)).alias("max_length_mm"),
    )


def tractogram_summary(pts: DataFrame) -> DataFrame:
    """Vertex and streamline counts with the bounding box, its centre and extent."""
    by = subject(pts)
    # Two levels: distinct ids are counted after a per-streamline partial aggregate.
    per = pts.groupBy(*streamline_keys(pts)).agg(
        F.count("*").alias("n"), *[F.min(c).alias(f"min_{c}") for c in XYZ], *[F.max(c).alias(f"max_{c}") for c in XYZ]
    )
    box = per.groupBy(*by).agg(
        F.count("*").alias("n_streamlines"),
        F.sum("n").alias("n_vertices"),
        *[F.min(f"min_{c}").alias(f"min_{c}") for c in XYZ],
        *[F.max(f"max_{c}").alias(f"max_{c}") for c in XYZ],
    )
    return box.withColumns(
        {f"center_{c}": (F.col(f"min_{c}") + F.col(f"max_{c}")) * 0.5 for c in XYZ}
        | {f"extent_{c}": F.col(f"max_{c}") - F.col(f"min_{c}") for c in XYZ}
    )


def streamline_aabbs(pts: DataFrame) -> DataFrame:
    return bounds(pts, streamline_keys(pts))


def endpoints(pts: DataFrame) -> DataFrame:
    """First and last vertex of each streamline, as structs, with the vertex count."""
    vertex = F.struct(*XYZ)
    return pts.groupBy(*streamline_keys(pts)).agg(
        F.min_by(vertex, "point_idx").alias("first"),
        F.max_by(vertex, "point_idx").alias("last"),
        F.count("*").alias("n_points"),
    )


def endpoint_rows(pts: DataFrame) -> DataFrame:
    """Long form: two rows per streamline (``is_last`` false / true)."""
    ends = endpoints(pts)
    keys = streamline_keys(pts)
    both = F.array(
        F.struct(F.lit(False).alias("is_last"), F.col("first").alias("p")),
        F.struct(F.lit(True).alias("is_last"), F.col("last").alias("p")),
    )
    return ends.withColumn("_e", F.explode(both)).select(*keys, "n_points", "_e.is_last", "_e.p.*")


def trim_segments(segs: DataFrame, fraction: float) -> DataFrame:
    """Drop floor(fraction * n) segments at each end of every streamline."""
    keys = streamline_keys(segs)
    share = max(0.0, min(0.5, fraction))
    # Segment numbers are dense, so the count is the largest number plus one.
    counts = segs.groupBy(*keys).agg((F.max("segment_idx") + 1).alias("_n"))
    cut = F.floor(F.col("_n") * F.lit(share))
    return (
        lookup(segs, counts, keys)
        .filter((F.col("segment_idx") >= cut) & (F.col("segment_idx") < F.col("_n") - cut))
        .drop("_n")
    )


def dedup_consecutive(pts: DataFrame, tolerance: float = SAME_POINT_MM) -> DataFrame:
    """Drop each vertex closer than ``tolerance`` to the last kept one.

    A vertex at least two tolerances from its predecessor is kept whatever came before,
    and a copy of its predecessor is dropped whatever came before. Only the vertices
    creeping in between depend on the past, and only those short runs are folded.
    """
    keys = streamline_keys(pts)
    near = with_neighbours(pts, keys, before=XYZ)
    step = [F.col(c) - F.col(f"prev_{c}") for c in XYZ]
    d2 = step[0] * step[0] + step[1] * step[1] + step[2] * step[2]
    near = near.withColumn("_d2", d2)
    restart = F.col("_d2").isNull() | (F.col("_d2") >= 4 * tolerance * tolerance)
    near = running_sum(near.withColumn("_restart", restart), keys, F.col("_restart").cast("long"), "_run")
    near = near.filter(F.col("_d2").isNull() | (F.col("_d2") > 0))
    run = keys + ["_run"]
    # Written once: it is read three times, and no task holds its scans and the joins below together.
    near = cut_lineage(near.select(*run, "point_idx", *XYZ, "_restart"))
    creeping = near.filter(~F.col("_restart")).select(*run).distinct()
    crept = near.join(creeping, run, "left_semi").select(*run, "point_idx", *XYZ)
    fields = [crept.schema[c] for c in (*keys, "point_idx")]
    # A run is a stream of its own: a task remembers its last kept vertex and nothing else.
    ordered = crept.repartition(*run).sortWithinPartitions(*run, "point_idx")
    folded = ordered.mapInArrow(lambda batches: _kept(batches, run, tolerance), StructType(fields))
    sure = near.filter("_restart").join(creeping, run, "left_anti").select(*keys, "point_idx")
    return pts.join(sure.unionByName(folded), keys + ["point_idx"], "left_semi")


def _kept(batches: Iterator[pa.RecordBatch], run: Sequence[str], tolerance: float) -> Iterator[pa.RecordBatch]:
    """Vertices at least ``tolerance`` from the last one kept of their run."""
    owner, last, limit = None, None, tolerance * tolerance
    for batch in batches:
        owners = zip(*(batch[c].to_pylist() for c in run))
        keep = []
        for at, (own, place) in enumerate(zip(owners, zip(*(batch[c].to_pylist() for c in XYZ)))):
            if own == owner:
                dx, dy, dz = (a - b for a, b in zip(place, last))
                if dx * dx + dy * dy + dz * dz < limit:
                    continue
            owner, last = own, place
            keep.append(at)
        yield batch.take(pa.array(keep, pa.int64())).select([*run[:-1], "point_idx"])


def raster(pts: DataFrame, to_voxel, changes_only: bool) -> DataFrame:
    """Voxels visited by each segment: ceil(longest axis step) samples, both ends included.

    ``to_voxel(x, y, z)`` gives fractional voxel coordinates. With ``changes_only`` a
    sample counts only where the voxel differs from the sample before it, also across
    the joint of two segments; both samples are computed from the row's own three
    vertices, so no second ordered pass is needed.
    """
    keys = streamline_keys(pts)
    near = with_neighbours(pts.select(*keys, "point_idx", *XYZ), keys, before=XYZ, after=XYZ)
    near = near.filter(F.col("next_x").isNotNull())
    here = to_voxel(*[F.col(c) for c in XYZ])
    ahead = to_voxel(*[F.col(f"next_{c}") for c in XYZ])
    behind = to_voxel(*[F.col(f"prev_{c}") for c in XYZ])

    def sample_count(a, b) -> Column:
        return F.ceil(F.greatest(*[F.abs(q - p) for p, q in zip(a, b)])).cast("int")

    near = near.withColumns(
        {f"_a{c}": v for c, v in zip(XYZ, here)}
        | {f"_b{c}": v for c, v in zip(XYZ, ahead)}
        | {f"_p{c}": v for c, v in zip(XYZ, behind)}
        | {"_steps": sample_count(here, ahead), "_back": sample_count(behind, here)}
    )

    def voxel_at(start: str, stop: str, steps: Column, s: Column) -> list[Column]:
        t = s * (F.lit(1.0) / F.greatest(steps, F.lit(1)))
        return [F.floor(F.col(f"{start}{c}") + (F.col(f"{stop}{c}") - F.col(f"{start}{c}")) * t).cast("int") for c in XYZ]

    walked = near.withColumn("_s", F.explode(F.sequence(F.lit(0), F.col("_steps"))))
    at = voxel_at("_a", "_b", F.col("_steps"), F.col("_s"))
    out = walked.withColumns({n: v for n, v in zip("ijk", at)})
    if changes_only:
        joint = voxel_at("_p", "_a", F.col("_back"), F.col("_back"))
        before = voxel_at("_a", "_b", F.col("_steps"), F.col("_s") - 1)
        first = F.col("_s") == 0
        prior = [F.when(first, j).otherwise(b) for j, b in zip(joint, before)]
        moved = prior[0].isNull() | (prior[0] != F.col("i")) | (prior[1] != F.col("j")) | (prior[2] != F.col("k"))
        out = out.filter(moved)
    return out.select(*keys, F.col("point_idx").alias("segment_idx"), F.col("_s").alias("step"), "i", "j", "k")


def voxelize_streamlines(pts: DataFrame, grid: Grid) -> DataFrame:
    """Coverage mask of the segments on a grid."""
    walked = raster(pts, lambda x, y, z: world_to_voxel(grid, x, y, z), changes_only=False)
    ok = inside(grid, F.col("i"), F.col("j"), F.col("k"))
    return walked.filter(ok).select(*subject(pts), "i", "j", "k").distinct()


def slab_filter(rows: DataFrame, centre: tuple, normal: tuple, half_mm: float) -> DataFrame:
    """Rows within ``half_mm`` of a plane; a half width of 0 switches the slab off."""
    if half_mm <= 0:
        return rows
    off = sum(((F.col(c) - F.lit(float(m))) * F.lit(float(n)) for c, m, n in zip(XYZ, centre, normal)), F.lit(0.0))
    return rows.filter(F.abs(off) <= half_mm)
