"""Bundle plans from reference bundles and an orientation field, for a whole cohort at once."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from axonframe.functions.geometry import Grid, min_voxel_size
from axonframe.functions.scan import cut_lineage, subject
from axonframe.operators.geometry import length_extents, voxelize_streamlines
from axonframe.operators.orientation import primary_peak_volume
from axonframe.operators.selection import subsample_points
from axonframe.operators.volumes import mask_dilate


@dataclass(frozen=True)
class ReferencePlan:
    """Plans keyed by bundle_id, and by subject_id where the reference carries one: ``rules`` and
    ``masks`` (limiting, seed, no_end), ``params``, and the ``references`` of the distance rule."""

    rules: DataFrame
    masks: DataFrame
    params: DataFrame
    references: DataFrame


def prepare_reference_plan(
    ref_pts: DataFrame,
    fixels: DataFrame,
    odx_voxels: DataFrame,
    grid: Grid,
    metric: str,
    otsu: float,
    tolerance_mm: float = 12.0,
    seed_tolerance_mm: float = 2.0,
    seed_factor: float = 0.5,
    no_end_factor: float = 0.9,
    max_reference_points: int | None = None,
    bundle: str = "reference",
) -> ReferencePlan:
    """Limiting = coverage dilated by the tolerance; seed = coverage dilated by the seed
    tolerance where the metric reaches its share of the Otsu threshold; no_end = limiting
    where the metric exceeds its share; lengths from the reference widened by two
    tolerances. All reference points are kept unless ``max_reference_points`` asks for a sample
    of each bundle. ``ref_pts`` may carry ``bundle_id``; else all of it is ``bundle``."""
    own = subject(ref_pts)
    rows = ref_pts if "bundle_id" in ref_pts.columns else ref_pts.withColumn("bundle_id", F.lit(bundle))
    on = [*own, "bundle_id"]
    # The operators below keep subjects apart; here a subject's bundles are kept apart the same way.
    owned = rows.withColumn("subject_id", F.struct(*on)).drop("bundle_id")
    back = [F.col(f"subject_id.{c}").alias(c) for c in on]
    # The masks below all start from it; the walk along the segments is taken once.
    coverage = cut_lineage(voxelize_streamlines(owned, grid))
    size = max(min_voxel_size(grid.affine), 1e-6)
    near = min(max(seed_tolerance_mm, 0.0), tolerance_mm)
    limiting = mask_dilate(coverage, grid, max(tolerance_mm / size, 0.0))
    envelope = limiting if near >= tolerance_mm else mask_dilate(coverage, grid, near / size)
    peaks = primary_peak_volume(fixels, odx_voxels, metric)

    def gated(mask: DataFrame, cut: float, inclusive: bool) -> DataFrame:
        # A voxel without a fixel counts as 0.
        value = F.coalesce("value", F.lit(0.0))
        test = value >= cut if inclusive else value > cut
        at = [*subject(mask, peaks), "i", "j", "k"]
        return mask.join(peaks.select(*at, "value"), at, "left").filter(test)

    limiting, envelope = (m.select(*back, "i", "j", "k") for m in (limiting, envelope))
    named = {"limiting": limiting, "seed": gated(envelope, seed_factor * otsu, True), "no_end": gated(limiting, no_end_factor * otsu, False)}
    masks = None
    for name, mask in named.items():
        part = mask.select(*on, F.concat(F.col("bundle_id"), F.lit(f"_{name}")).alias("mask_id"), F.lit(name).alias("role"), "i", "j", "k")
        masks = part if masks is None else masks.unionByName(part)
    masks = cut_lineage(masks)
    tol = max(tolerance_mm, 0.0)
    # The extents are of the positive lengths; a bundle without any has no limits.
    bundles = owned.select("subject_id").distinct().join(length_extents(owned), "subject_id", "left")
    shortest, longest = F.col("min_length_mm"), F.col("max_length_mm")
    params = bundles.select(
        *back,
        F.when(shortest > 0, F.greatest(F.lit(float(tol)), shortest - 2 * tol)).alias("min_len_mm"),
        F.when(longest > 0, longest + 2 * tol).alias("max_len_mm"),
        F.lit(float(tolerance_mm)).alias("max_hausdorff_mm"),
    )
    kept = owned if max_reference_points is None else subsample_points(owned, max_reference_points)
    return ReferencePlan(
        rules=masks.select(*on, "role", "mask_id").distinct(),
        masks=masks.select(*own, "mask_id", "i", "j", "k"),
        params=params,
        references=kept.select(*back, *[c for c in kept.columns if c not in on and c != "subject_id"]),
    )
