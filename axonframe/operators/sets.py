"""Set operations and re-numbering of tractograms (points, groups, scalars)."""

from __future__ import annotations

from collections.abc import Sequence
from typing import NamedTuple

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from axonframe.functions.scan import lookup, row_rank, streamline_keys, subject
from axonframe.operators.selection import ids, keep, touched_voxels
from axonframe.functions.geometry import XYZ, Grid


class Tractogram(NamedTuple):
    """Vertices plus optional long tables of groups and per-streamline scalars."""

    points: DataFrame
    groups: DataFrame | None = None
    dps: DataFrame | None = None


def dense_ids(sel: DataFrame) -> DataFrame:
    """Old id -> new id 0..n-1 in id order, numbered per subject without one big sort."""
    by = subject(sel)
    return row_rank(ids(sel), ["streamline_id"], "new_id", by)


def _renumber(rows: DataFrame, mapping: DataFrame) -> DataFrame:
    keys = streamline_keys(rows, mapping)
    moved = lookup(rows, mapping, keys).withColumn("streamline_id", F.col("new_id")).drop("new_id")
    return moved.select(*rows.columns)


def subset(data: Tractogram, sel: DataFrame) -> Tractogram:
    """Selected streamlines renumbered 0..n-1 with their groups and scalars."""
    mapping = dense_ids(keep(ids(data.points), sel))
    return Tractogram(
        _renumber(data.points, mapping),
        None if data.groups is None else _renumber(data.groups, mapping),
        None if data.dps is None else _renumber(data.dps, mapping),
    )


def merge(left: Tractogram, right: Tractogram, keep_metadata: bool = False) -> Tractogram:
    """Left then right, renumbered. Only geometry is carried unless asked otherwise."""
    return concat_tractograms([(left, None), (right, None)], keep_metadata)


def concat_tractograms(parts: Sequence[tuple[Tractogram, str | None]], keep_metadata: bool = True) -> Tractogram:
    """Inputs in listed order as one tractogram, optionally a group name per input."""
    if len(parts) < 2:
        raise ValueError("choose at least two streamline inputs")

    def stacked(frames: list[DataFrame]) -> DataFrame:
        out = frames[0]
        for frame in frames[1:]:
            out = out.unionByName(frame, allowMissingColumns=True)
        return out

    def tagged(frame: DataFrame, n: int) -> DataFrame:
        return frame.withColumn("_part", F.lit(n))

    points = stacked([tagged(p.points, n) for n, (p, _) in enumerate(parts)])
    by = subject(points)
    order = points.select(*by, "_part", "streamline_id").distinct()
    mapping = row_rank(order, ["_part", "streamline_id"], "new_id", by)
    on = by + ["_part", "streamline_id"]

    def moved(rows: DataFrame) -> DataFrame:
        out = lookup(rows, mapping, on).withColumn("streamline_id", F.col("new_id"))
        return out.drop("new_id", "_part")

    if not keep_metadata:
        core = points.select(*on, "point_idx", *XYZ)
        return Tractogram(moved(core))
    groups = [tagged(p.groups.select(*by, "streamline_id", "group_name"), n) for n, (p, _) in enumerate(parts) if p.groups is not None]
    for n, (p, name) in enumerate(parts):
        if name:
            groups.append(tagged(ids(p.points).withColumn("group_name", F.lit(name)), n))
    dps = [tagged(p.dps, n) for n, (p, _) in enumerate(parts) if p.dps is not None]
    return Tractogram(
        moved(points),
        moved(stacked(groups)).distinct() if groups else None,
        moved(stacked(dps)) if dps else None,
    )


def add_groups_from_parcellation(
    pts: DataFrame, parcels: DataFrame, grid: Grid, labels: DataFrame, name: str
) -> DataFrame:
    """Group ``<prefix>_<label name>`` for each non-zero label a streamline touches.

    The prefix is the parcellation name up to its first dot. The label colour rides along
    as bytes.
    """
    from axonframe.operators.sampling import join_labels

    keys = streamline_keys(pts)
    prefix = name.split(".", 1)[0].strip()
    on = subject(pts, parcels) + ["i", "j", "k"]
    nonzero = parcels.filter(F.col("label") != 0).select(*on, "label")
    touched = lookup(touched_voxels(pts, grid, "round"), nonzero, on, spread=True).select(*keys, "label").distinct()
    named = join_labels(touched, labels)
    channel = {f"color_{c}": F.floor(F.greatest(F.lit(0.0), F.least(F.lit(1.0), F.col(f"label_{c}"))) * 255.0).cast("int") for c in "rgb"}
    return named.withColumns(channel).select(
        *keys, F.concat(F.lit(f"{prefix}_"), "label_name").alias("group_name"), *channel
    )
