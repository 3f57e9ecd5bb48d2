"""Selections: operators that keep whole streamlines. A selection is a DataFrame of ids."""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from axonframe.functions.geometry import XYZ, Grid, points_to_voxels
from axonframe.functions.nearest import distance_to_cloud, nearest_in_radius
from axonframe.functions.scan import (
    first_n,
    lookup,
    order_statistics,
    row_rank,
    running_sum,
    running_total,
    streamline_keys,
    subject,
    voxel_keys,
    with_neighbours,
)
from axonframe.operators.geometry import endpoint_rows, streamline_length


def ids(rows: DataFrame) -> DataFrame:
    return rows.select(*streamline_keys(rows)).distinct()


def keep(rows: DataFrame, sel: DataFrame | None) -> DataFrame:
    """Rows of the selected streamlines. ``None`` means all, an empty selection means none."""
    return rows if sel is None else lookup(rows, sel, streamline_keys(rows, sel), "left_semi")


# --- groups -------------------------------------------------------------------------


def group_filter_from_csv(text: str) -> list[str] | None:
    """``"a, b"`` -> names, ``"__none__"`` -> no group, blank -> all (None)."""
    if text.strip() == "__none__":
        return []
    names = [part.strip() for part in text.split(",") if part.strip()]
    return names or None


def group_select(
    sel: DataFrame, groups: DataFrame, names: Iterable[str] | None, override: Iterable[str] | None = None
) -> DataFrame:
    """Streamlines in at least one named group; ``None`` passes all, an empty list none."""
    names = override if override is not None else names
    if names is None:
        return sel
    names = list(names)
    if not names:
        return sel.limit(0)
    if groups.isEmpty():
        raise ValueError("group selection needs a tractogram with groups")
    keys = streamline_keys(sel, groups)
    members = groups.filter(F.col("group_name").isin(names)).select(*keys).distinct()
    return lookup(sel, members, keys, "left_semi")


def split_by_group(sel: DataFrame, groups: DataFrame, label: str = "all") -> DataFrame:
    """One row per (group, streamline); without groups everything is one flow under ``label``."""
    keys = streamline_keys(sel, groups)
    if groups.isEmpty():
        return sel.withColumn("group_name", F.lit(label))
    return lookup(groups.select(*keys, "group_name").distinct(), sel, keys)


# --- shape queries ------------------------------------------------------------------


def in_box(lo, hi) -> Column:
    test = F.lit(True)
    for c, a, b in zip(XYZ, lo, hi):
        test = test & F.col(c).between(float(a), float(b))
    return test


def sphere_query(pts: DataFrame, center: tuple, radius_mm: float) -> DataFrame:
    """Streamlines with a vertex inside the sphere (border included).

    The box test comes first as plain range predicates, which reach the Parquet scan.
    """
    lo = [c - radius_mm for c in center]
    hi = [c + radius_mm for c in center]
    d = [F.col(c) - F.lit(float(m)) for c, m in zip(XYZ, center)]
    d2 = d[0] * d[0] + d[1] * d[1] + d[2] * d[2]
    return ids(pts.filter(in_box(lo, hi)).filter(d2 <= float(radius_mm) * float(radius_mm)))


def bbox_filter(aabbs: DataFrame, lo: tuple, hi: tuple) -> DataFrame:
    """Streamlines whose bounding box overlaps the box."""
    test = F.lit(True)
    for c, a, b in zip(XYZ, lo, hi):
        test = test & (F.col(f"min_{c}") <= float(b)) & (F.col(f"max_{c}") >= float(a))
    return aabbs.filter(test)


def surface_depth_query(pts: DataFrame, vertices: DataFrame, depth_mm: float) -> DataFrame:
    """Streamlines with a vertex within ``depth_mm`` of a surface vertex."""
    keys = streamline_keys(pts)
    rows = pts.select(*keys, "point_idx", *XYZ)
    return ids(nearest_in_radius(rows, vertices, "vertex_id", depth_mm))


# --- parcels (nearest voxel) --------------------------------------------------------


def touched_voxels(pts: DataFrame, grid: Grid, mode: str) -> DataFrame:
    """Distinct (streamline, voxel): combined map-side before any shuffle."""
    keys = streamline_keys(pts)
    return points_to_voxels(pts, grid, mode).select(*keys, "i", "j", "k").distinct()


def labelled(parcels: DataFrame, labels: Iterable[int]) -> DataFrame:
    return parcels.filter(F.col("label").isin([int(v) for v in labels])).select(*voxel_keys(parcels))


def parcel_roi(pts: DataFrame, parcels: DataFrame, grid: Grid, labels: Iterable[int]) -> DataFrame:
    """Streamlines touching any of the labels; no labels, no streamlines."""
    chosen = labelled(parcels, labels)
    hits = lookup(touched_voxels(pts, grid, "round"), chosen, voxel_keys(pts, parcels), "left_semi", spread=True)
    return ids(hits)


def parcel_roa(pts: DataFrame, parcels: DataFrame, grid: Grid, labels: Iterable[int]) -> DataFrame:
    """Streamlines touching none of the labels; no labels, every streamline."""
    return ids(pts).join(parcel_roi(pts, parcels, grid, labels), streamline_keys(pts), "left_anti")


def parcel_end(
    pts: DataFrame, parcels: DataFrame, grid: Grid, labels: Iterable[int], endpoint_count: int
) -> DataFrame:
    """Streamlines with one (1) or both (2 or more) endpoints in the labels; 0 keeps none."""
    if endpoint_count <= 0:
        return ids(pts).limit(0)
    keys = streamline_keys(pts)
    ends = points_to_voxels(endpoint_rows(pts), grid, "round")
    hits = lookup(ends, labelled(parcels, labels), voxel_keys(pts, parcels), "left_semi", spread=True)
    needed = 1 if endpoint_count == 1 else 2
    return hits.groupBy(*keys).agg(F.count("*").alias("_n")).filter(F.col("_n") >= needed).select(*keys)


def parcel_crop(
    pts: DataFrame, parcels: DataFrame, grid: Grid, labels: Iterable[int], keep_inside: bool = True
) -> DataFrame:
    """Cut streamlines into their runs inside (or outside) the labels.

    A segment's midpoint joins the kept run at every border crossing; runs of fewer than
    two points are dropped. Result: streamline_id, run, point_idx, x, y, z. Groups and
    scalars are not carried.
    """
    keys = streamline_keys(pts)
    labels = list(labels)
    rows = pts.select(*keys, "point_idx", *XYZ)
    if not labels:
        return rows.withColumn("run", F.lit(0).cast("long")).limit(0)
    where = points_to_voxels(rows, grid, "round", keep_outside=True)
    chosen = labelled(parcels, labels).withColumn("_in", F.lit(True))
    where = lookup(where, chosen, voxel_keys(pts, parcels), "left", spread=True).drop("i", "j", "k")
    where = where.withColumn("_in", F.coalesce("_in", F.lit(False)))
    near = with_neighbours(where, keys, before=[*XYZ, "_in"], after=["_in"])
    crossing = F.coalesce(F.col("prev__in") != F.col("_in"), F.lit(False))
    alone = F.col("prev__in").isNull() & F.col("next__in").isNull()
    near = running_sum(near.filter(~alone).withColumn("_cross", crossing), keys, F.col("_cross").cast("long"), "run")
    wanted = F.col("_in") == F.lit(keep_inside)
    point = F.struct("run", F.col("point_idx").alias("pos"), *[F.col(c) for c in XYZ])
    # The midpoint closes the run before it or opens the run after it, whichever is kept.
    middle = F.struct(
        F.when(wanted, F.col("run")).otherwise(F.col("run") - 1).alias("run"),
        F.when(wanted, F.col("point_idx") - 1).otherwise(F.col("point_idx")).alias("pos"),
        *[((F.col(f"prev_{c}") + F.col(c)) * 0.5).alias(c) for c in XYZ],
    )
    emitted = (
        F.when(F.col("_cross") & wanted, F.array(middle, point))
        .when(F.col("_cross"), F.array(middle))
        .when(wanted, F.array(point))
    )
    pieces = near.withColumn("_e", F.explode(emitted)).select(*keys, "_e.*")
    sizes = pieces.groupBy(*keys, "run").agg(F.min("pos").alias("_from"), F.count("*").alias("_n"))
    sizes = sizes.filter(F.col("_n") >= 2)
    return lookup(pieces, sizes, keys + ["run"]).select(
        *keys, "run", (F.col("pos") - F.col("_from")).cast("int").alias("point_idx"), *XYZ
    )


# --- masks (floor voxel) ------------------------------------------------------------


def mask_contacts(pts: DataFrame, masks: DataFrame, grid: Grid) -> DataFrame:
    """Distinct (streamline, mask) pairs."""
    keys = streamline_keys(pts)
    hits = lookup(touched_voxels(pts, grid, "floor"), masks, voxel_keys(pts, masks), spread=True)
    return hits.select(*keys, "mask_id").distinct()


def end_contacts(pts: DataFrame, masks: DataFrame, grid: Grid) -> DataFrame:
    """(streamline, mask) pairs touched by an endpoint; lone vertices have no endpoints."""
    keys = streamline_keys(pts)
    ends = points_to_voxels(endpoint_rows(pts).filter(F.col("n_points") >= 2), grid, "floor")
    return lookup(ends, masks, voxel_keys(pts, masks), spread=True).select(*keys, "mask_id").distinct()


def mask_hits_all(pts: DataFrame, masks: DataFrame, grid: Grid, mask_ids: Iterable[str]) -> DataFrame:
    """Streamlines that pass through every listed mask; with no mask all pass."""
    wanted = sorted(set(mask_ids))
    if not wanted:
        return ids(pts)
    keys = streamline_keys(pts)
    pairs = mask_contacts(pts, masks.filter(F.col("mask_id").isin(wanted)), grid)
    return pairs.groupBy(*keys).agg(F.count("*").alias("_n")).filter(F.col("_n") == len(wanted)).select(*keys)


def mask_endpoint_in(pts: DataFrame, masks: DataFrame, grid: Grid, mask_id: str) -> DataFrame:
    """Streamlines with an endpoint in the mask."""
    return ids(end_contacts(pts, masks.filter(F.col("mask_id") == mask_id), grid))


def mask_end_regions(pts: DataFrame, masks: DataFrame, grid: Grid, mask_ids: Iterable[str]) -> DataFrame:
    """Streamlines where each listed mask holds at least one endpoint."""
    wanted = sorted(set(mask_ids))
    keys = streamline_keys(pts)
    pairs = end_contacts(pts, masks.filter(F.col("mask_id").isin(wanted)), grid)
    return pairs.groupBy(*keys).agg(F.count("*").alias("_n")).filter(F.col("_n") == len(wanted)).select(*keys)


def mask_avoid(pts: DataFrame, masks: DataFrame, grid: Grid, mask_id: str) -> DataFrame:
    """Streamlines with no vertex in the mask."""
    hit = ids(mask_contacts(pts, masks.filter(F.col("mask_id") == mask_id), grid))
    return ids(pts).join(hit, streamline_keys(pts), "left_anti")


def mask_limit_truncate(
    pts: DataFrame, masks: DataFrame, grid: Grid, limiting: str | None = None, term: str | None = None
) -> DataFrame:
    """Cut before the first vertex outside ``limiting``, or just after the first one in ``term``."""
    keys = streamline_keys(pts)
    on = voxel_keys(pts, masks)
    rows = points_to_voxels(pts, grid, "floor", keep_outside=True)

    def flagged(df: DataFrame, mask_id: str | None, name: str) -> DataFrame:
        if mask_id is None:
            return df.withColumn(name, F.lit(None).cast("boolean"))
        voxels = masks.filter(F.col("mask_id") == mask_id).select(*on).distinct().withColumn(name, F.lit(True))
        df = lookup(df, voxels, on, "left", spread=True)
        return df.withColumn(name, F.coalesce(name, F.lit(False)))

    rows = flagged(flagged(rows, limiting, "_limit"), term, "_term").drop("i", "j", "k")
    outside = F.min(F.when(~F.col("_limit"), F.col("point_idx"))).alias("_out")
    ended = F.min(F.when(F.col("_term"), F.col("point_idx") + 1)).alias("_end")
    cuts = rows.groupBy(*keys).agg(outside, ended).filter("_out is not null or _end is not null")
    # The limiting test comes first at each vertex, so the smaller cut wins.
    cuts = cuts.select(*keys, F.least("_out", "_end").alias("_cut"))
    kept = lookup(rows.drop("_limit", "_term"), cuts, keys, "left")
    return kept.filter(F.col("_cut").isNull() | (F.col("point_idx") < F.col("_cut"))).drop("_cut")


# --- measures -----------------------------------------------------------------------


def length_filter(pts: DataFrame, min_mm: float | None = None, max_mm: float | None = None) -> DataFrame:
    """Streamlines by arc length, both limits included. A lone vertex has length 0."""
    keys = streamline_keys(pts)
    lengths = ids(pts).join(streamline_length(pts), keys, "left")
    length = F.coalesce("length_mm", F.lit(0.0))
    test = F.lit(True)
    if min_mm is not None:
        test = test & (length >= min_mm)
    if max_mm is not None:
        test = test & (length <= max_mm)
    return lengths.withColumn("length_mm", length).filter(test)


def mean_cloud_distance(
    pts: DataFrame, ref_pts: DataFrame, by: Iterable[str] | None = None, keys: Iterable[str] | None = None
) -> DataFrame:
    """Mean over the vertices of each ``keys`` (a streamline) of the distance to the nearest
    reference point with the same ``by`` (its subject)."""
    keys = list(keys or streamline_keys(pts))
    rows = pts.select(*keys, *XYZ)
    return distance_to_cloud(rows, ref_pts, by).groupBy(*keys).agg(
        F.avg("distance").alias("mean_distance_mm")
    )


def hausdorff_filter(pts: DataFrame, ref_pts: DataFrame, max_mm: float) -> DataFrame:
    """Streamlines whose mean distance to the reference is at most ``max_mm``; an empty
    reference passes everything."""
    mean = F.col("mean_distance_mm")
    return mean_cloud_distance(pts, ref_pts).filter(mean.isNull() | (mean <= max_mm))


# --- limits and samples -------------------------------------------------------------


def _hashed(sel: DataFrame, seed: int) -> DataFrame:
    """Adds 60 bits of the MD5 of ``seed:<keys>``, a hash that any other system can repeat."""
    text = F.concat_ws(":", F.lit(str(seed)), *[F.col(c).cast("string") for c in streamline_keys(sel)])
    return sel.withColumn("_h", F.conv(F.substring(F.md5(text), 1, 15), 16, 10).cast("long"))


def limit_streamlines(sel: DataFrame, n: int, randomize: bool = False, seed: int = 0) -> DataFrame:
    """First ``n`` ids of each subject, or the ``n`` smallest seeded hashes when randomised."""
    keys = streamline_keys(sel)
    if randomize:
        return random_subset(sel, n, seed)
    return first_n(sel.select(*keys), ["streamline_id"], n, subject(sel))


def random_subset(sel: DataFrame, n: int, seed: int) -> DataFrame:
    """A deterministic random subset of each subject: the ``n`` smallest seeded hashes."""
    keys = streamline_keys(sel)
    return first_n(_hashed(sel.select(*keys), seed), ["_h", "streamline_id"], n, subject(sel)).select(*keys)


def stride_sample(sel: DataFrame, stride: int) -> DataFrame:
    """Every ``stride``-th streamline in id order, starting with the first."""
    keys = streamline_keys(sel)
    if stride <= 1:
        return sel.select(*keys)
    ranked = row_rank(sel.select(*keys), ["streamline_id"], "_pos", subject(sel))
    return ranked.filter(F.col("_pos") % stride == 0).select(*keys)


def subsample_points(pts: DataFrame, max_points: int) -> DataFrame:
    """Every ceil(n / max)-th point of a subject's concatenated streamlines; all if n <= max.

    Positions are vertex offsets of each streamline plus the vertex number: the prefix
    sum runs over streamlines, not over points.
    """
    by, keys = subject(pts), streamline_keys(pts)
    sizes = pts.groupBy(*keys).agg(F.count("*").alias("_n"))
    upto = running_total(sizes, by, ["streamline_id"], F.col("_n"), "_upto")
    stride = F.greatest(F.lit(1), F.ceil(F.sum("_n") / F.lit(max(1, max_points)))).alias("_stride")
    one = F.lit(1).alias("_one")
    totals = sizes.groupBy(*by, one).agg(stride)
    starts = upto.select(*keys, one, (F.col("_upto") - F.col("_n")).alias("_start")).join(totals, by + ["_one"])
    placed = lookup(pts, starts.drop("_one"), keys)
    return placed.filter((F.col("_start") + F.col("point_idx")) % F.col("_stride") == 0).drop("_start", "_stride")


def puri_threshold(scores: DataFrame, fraction: float, score: str = "fico") -> DataFrame:
    """Keep scores at or above the ``fraction`` order statistic; NaN and NULL are dropped."""
    share = max(0.0, min(1.0, fraction))
    by = subject(scores)
    cut = order_statistics(scores, score, {"threshold": share}, by).drop("n_finite")
    finite = scores.filter(F.col(score).isNotNull() & ~F.isnan(score))
    if by:
        kept = lookup(finite, cut, by)
    else:
        row = cut.first()
        kept = finite.withColumn("threshold", F.lit(row["threshold"] if row else None).cast("double"))
    return kept.filter(F.col(score) >= F.col("threshold"))


# --- labels and scalars -------------------------------------------------------------


def parcel_select(labels: DataFrame, chosen: Iterable[int] | None = None) -> DataFrame:
    """The chosen labels of each subject; an empty or missing choice means every non-zero label."""
    chosen = [int(v) for v in chosen or []]
    distinct = labels.select(*subject(labels), "label").distinct()
    return distinct.filter(F.col("label").isin(chosen)) if chosen else distinct.filter(F.col("label") != 0)


def select_field(table: DataFrame, name: str) -> DataFrame:
    """One named scalar of a long table (field, value); an unknown name is an error."""
    chosen = table.filter(F.col("field") == name)
    if chosen.isEmpty():
        raise ValueError(f"unknown scalar field {name!r}")
    return chosen


def select_column(table: DataFrame, keys: Iterable[str], name: str) -> DataFrame:
    """One named scalar of a wide table (a column per field); an unknown name is an error."""
    keys = list(keys)
    if name not in table.columns or name in keys:
        raise ValueError(f"unknown scalar field {name!r}")
    return table.select(*keys, F.col(name).alias("value"))


def expand_dps_to_vertices(pts: DataFrame, dps: DataFrame, field: str) -> DataFrame:
    """Repeat a per-streamline scalar on every vertex; streamlines without one get 0."""
    keys = streamline_keys(pts, dps)
    values = select_field(dps, field).select(*keys, F.col("value").alias(field))
    return lookup(pts, values, keys, "left").withColumn(field, F.coalesce(field, F.lit(0.0)))
