"""Bundle plans from catalogued region files, for all subjects and bundles of a catalogue at once."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from axonframe.functions.geometry import Grid, min_voxel_size
from axonframe.functions.scan import lookup
from axonframe.operators.volumes import mask_dilate

# Default distances in mm.
DIST_TO_WAYPOINT_MM = 1.5
DIST_TO_EXCLUSION_MM = 0.0
DIST_TO_ENDPOINT_MM = 4.0


@dataclass(frozen=True)
class RoiPlan:
    """Plans keyed by (subject_id, bundle_id); ``incomplete`` are those left out for want of an include."""

    rules: DataFrame
    masks: DataFrame
    params: DataFrame
    prob_map: DataFrame
    incomplete: DataFrame


def prepare_roi_plan(
    catalog: DataFrame,
    mask_voxels: DataFrame,
    grids: DataFrame,
    bundle: str | None = None,
    waypoint_mm: float = DIST_TO_WAYPOINT_MM,
    exclusion_mm: float = DIST_TO_EXCLUSION_MM,
    endpoint_mm: float = DIST_TO_ENDPOINT_MM,
    min_len_mm: float | None = None,
    max_len_mm: float | None = None,
    lengths: DataFrame | None = None,
) -> RoiPlan:
    """Dilated include masks (each file must be met), excludes joined into one, start and end.

    ``catalog`` is the output of ``catalog_derivatives``, of one session a subject; ``mask_voxels``
    is keyed by path; ``grids`` has path, nx, ny, nz, affine. Each subject has its own plan of each
    bundle (or of ``bundle`` alone): files of one subject are never asked of another. ``lengths``
    (bundle, min_len_mm, max_len_mm) gives a bundle's own limits, before the general ones. No
    include at all, or files on different grids, is an error. The probability maps' paths are passed on.
    """
    role = F.col("role")
    owner = ["subject_id", "bundle"]
    placed = catalog if bundle is None else catalog.filter(F.col("bundle") == bundle)
    if "subject_id" not in placed.columns:
        placed = placed.withColumn("subject_id", F.lit(None).cast("string"))
    placed = placed.join(grids, "path", "left")
    head = placed.filter(role == "include").orderBy(*owner, "idx", "path").first()
    if head is None:
        raise ValueError(f"no include masks for bundle {bundle!r}")
    first = Grid(head["nx"], head["ny"], head["nz"], tuple(float(v) for v in head["affine"]))
    same = (F.col("nx") == first.nx) & (F.col("ny") == first.ny) & (F.col("nz") == first.nz)
    other = placed.filter(~F.coalesce(same, F.lit(False))).select("path").first()
    if other is not None:
        raise ValueError(f"{other['path']} is on another grid")
    size = max(min_voxel_size(first.affine), 1e-6)
    of = Window.partitionBy(*owner)
    placed = placed.withColumn("_whole", F.max(role == "include").over(of))
    incomplete = placed.filter("not _whole").select("subject_id", F.col("bundle").alias("bundle_id")).distinct()
    placed = placed.filter("_whole")
    number = F.when(role != "exclude", F.coalesce(F.col("idx").cast("string"), F.lit(""))).otherwise(F.lit(""))
    # Further include files of one number are waypoints of their own.
    turn = F.row_number().over(Window.partitionBy(*owner, "role", "idx").orderBy("path"))
    again = F.when((role == "include") & (F.col("_turn") > 1), F.concat(F.lit("_"), F.col("_turn").cast("string"))).otherwise(F.lit(""))
    files = placed.withColumn("_turn", turn).filter(role != "probmap").select(
        "subject_id",
        F.col("bundle").alias("bundle_id"),
        "path",
        "role",
        F.concat(F.col("bundle"), F.lit("_"), role, number, again).alias("mask_id"),
        F.when(role == "include", "roi").when(role == "exclude", "roa").otherwise("end").alias("rule"),
    )
    masks = None
    for roles, reach in ((["include"], waypoint_mm), (["exclude"], exclusion_mm), (["start", "end"], endpoint_mm)):
        chosen = files.filter(role.isin(roles)).select("subject_id", "path", "mask_id")
        voxels = lookup(mask_voxels.select("path", "i", "j", "k"), chosen, ["path"]).select("subject_id", "mask_id", "i", "j", "k").distinct()
        grown = mask_dilate(voxels, first, max(reach / size, 0.0))
        masks = grown if masks is None else masks.unionByName(grown)
    params = files.select("subject_id", "bundle_id").distinct()
    given = {"min_len_mm": min_len_mm, "max_len_mm": max_len_mm}
    if lengths is not None:
        own = lengths.select(F.col("bundle").alias("bundle_id"), *[F.col(c).cast("double").alias(f"_{c}") for c in given])
        params = lookup(params, own, ["bundle_id"], "left")
    else:
        params = params.withColumns({f"_{c}": F.lit(None).cast("double") for c in given})
    limits = [F.coalesce(F.col(f"_{c}"), F.lit(v).cast("double")).alias(c) for c, v in given.items()]
    return RoiPlan(
        rules=files.select("subject_id", "bundle_id", F.col("rule").alias("role"), "mask_id").distinct(),
        masks=masks,
        params=params.select("subject_id", "bundle_id", *limits, F.lit(None).cast("double").alias("max_hausdorff_mm")),
        prob_map=placed.filter(role == "probmap").select("subject_id", F.col("bundle").alias("bundle_id"), "path"),
        incomplete=incomplete,
    )
