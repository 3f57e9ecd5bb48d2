"""Voxel envelopes of bundles."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from axonframe.functions.graph import connect
from axonframe.functions.scan import cut_lineage, lookup, streamline_keys, subject
from axonframe.operators.fields import place, vertex_marks, voxel_size, with_grid_dims
from axonframe.operators.geometry import tangents
from axonframe.operators.selection import split_by_group
from axonframe.operators.volumes import gaussian_blur, iso_level


def bundle_envelope(
    pts: DataFrame,
    voxel_mm: float = 2.0,
    threshold: float = 1.0,
    sigma: float = 1.0,
    min_volume_mm3: float = 0.0,
    groups: DataFrame | None = None,
) -> DataFrame:
    """Voxels of the blurred point density above the scaled threshold, small pieces dropped.

    Per subject, and per group when ``groups`` is given (all groups on the grid of the subject's
    points): subject_id, group_name, i, j, k, density, and at each voxel the kernel-weighted mean of
    the direction colour r, g, b and of the orientation tensor xx .. zz. All ten sums are blurred
    together. Voxels belong together across faces.
    """
    size = voxel_size(voxel_mm)
    by = subject(pts)
    marks = vertex_marks()
    rows = place(tangents(pts), pts, size, 2).withColumns({f"_{n}": v for n, v in marks.items()})
    if groups is not None:
        keys = streamline_keys(pts, groups)
        sel = pts.select(*keys).distinct()
        rows = lookup(split_by_group(sel, groups), rows, keys)
    else:
        rows = rows.withColumn("group_name", F.lit("all"))
    owner = [*by, "group_name"]
    keys = [*owner, "i", "j", "k"]
    sums = rows.groupBy(*keys).agg(F.count("*").cast("double").alias("density"), *[F.sum(f"_{n}").alias(n) for n in marks])
    blurred = gaussian_blur(with_grid_dims(sums, pts, voxel_mm), ["n_i", "n_j", "n_k"], sigma, ["density", *marks])
    solid = blurred.filter(F.col("density") > iso_level(threshold, sigma))
    solid = solid.select(*keys, "density", *[(F.col(n) / F.col("density")).alias(n) for n in marks])
    if min_volume_mm3 <= 0:
        return solid
    solid = cut_lineage(solid.withColumn("node", F.xxhash64(*keys)))
    edges = solid.select(F.col("node").alias("u"), F.col("node").alias("v"))
    for axis in "ijk":
        ahead = solid.select(*owner, *[(F.col(n) - 1 if n == axis else F.col(n)).alias(n) for n in "ijk"], F.col("node").alias("v"))
        edges = edges.unionByName(solid.select(*keys, F.col("node").alias("u")).join(ahead, keys).select("u", "v"))
    named = lookup(solid, connect(edges), ["node"])
    sizes = named.groupBy("component").agg((F.count("*") * F.lit(size**3)).alias("_mm3")).filter(F.col("_mm3") >= min_volume_mm3)
    return lookup(named, sizes, ["component"]).select(*keys, "density", *marks)
