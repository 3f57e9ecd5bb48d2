"""Per-vertex colours of streamlines."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from axonframe.functions.color import bundle_name_color, distinct_color, map_colors, rgb, sheet_color
from axonframe.functions.geometry import XYZ
from axonframe.functions.scan import lookup, row_rank, streamline_keys, subject
from axonframe.operators.geometry import tangents
from axonframe.operators.selection import expand_dps_to_vertices
from axonframe.operators.volumes import robust_range

GREY = (0.5, 0.5, 0.5)


def _spread(rows: DataFrame, color) -> DataFrame:
    keys = streamline_keys(rows) + ["point_idx"]
    return rows.select(*keys, *[color[c].alias(c) for c in "rgb"])


def color_by_direction(pts: DataFrame) -> DataFrame:
    """Absolute tangent as r, g, b."""
    return _spread(tangents(pts), rgb(*[F.abs(F.col(f"t{c}")) for c in XYZ]))


def color_uniform(pts: DataFrame, color: tuple) -> DataFrame:
    return _spread(pts, rgb(*color))


def group_colors(groups: DataFrame, colors: DataFrame | None = None) -> DataFrame:
    """Colour and order of each group of a subject: own colour, well-known name, sheet number, then the
    golden-angle colour of its position. ``colors``: group_name, r, g, b.

    Groups come in the order of the file where ``groups`` has it as ``group_ord``, else by name.
    """
    by = subject(groups)
    order = ["_ord", "group_name"] if "group_ord" in groups.columns else ["group_name"]
    place = F.min("group_ord") if "group_ord" in groups.columns else F.lit(0)
    names = groups.groupBy(*by, "group_name").agg(place.alias("_ord"))
    ranked = row_rank(names, order, "group_ord", by).drop("_ord")
    name = F.col("group_name")
    choice = [bundle_name_color(name), sheet_color(name), distinct_color(F.col("group_ord"))]
    if colors is not None:
        own = colors.select(*subject(groups, colors), "group_name", F.struct(*[F.col(c).cast("double").alias(c) for c in "rgb"]).alias("_own"))
        ranked = lookup(ranked, own, [*subject(groups, colors), "group_name"], "left", spread=True)
        choice = [F.col("_own"), *choice]
    return ranked.select(*by, "group_name", "group_ord", F.coalesce(*choice).alias("color"))


def color_by_group(pts: DataFrame, groups: DataFrame, colors: DataFrame | None = None) -> DataFrame:
    """The colour of each streamline's last group; grey without one."""
    keys = streamline_keys(pts, groups)
    palette = group_colors(groups, colors)
    members = lookup(groups.select(*keys, "group_name"), palette, subject(groups) + ["group_name"], spread=True)
    last = members.groupBy(*keys).agg(F.max_by("color", "group_ord").alias("_c"))
    rows = lookup(pts.select(*keys, "point_idx"), last, keys, "left")
    return _spread(rows, F.coalesce("_c", rgb(*GREY)))


def color_by_scalar(
    pts: DataFrame,
    field: str,
    dps: DataFrame | None = None,
    value_range: tuple | None = None,
    colormap: str = "blue_white_red",
) -> DataFrame:
    """Colour by a per-vertex column, or by a per-streamline field of ``dps``.

    Without a fixed range the robust range of the subject's scalar is used. An unknown field is grey.
    """
    if dps is None:
        if field not in pts.columns:
            return color_uniform(pts, GREY)
        rows, source, column = pts, pts, field
    else:
        chosen = dps.filter(F.col("field") == field)
        if chosen.isEmpty():
            return color_uniform(pts, GREY)
        rows, source, column = expand_dps_to_vertices(pts, dps, field), chosen, "value"
    if value_range is None:
        by = subject(rows, source)
        span = robust_range(source, column, by=by).withColumn("_one", F.lit(1))
        rows = lookup(rows.withColumn("_one", F.lit(1)), span.withColumnsRenamed({"lo": "_lo", "hi": "_hi"}), [*by, "_one"], "left", small=True)
        lo, hi = F.coalesce("_lo", F.lit(0.0)), F.coalesce("_hi", F.lit(1.0))
    else:
        lo, hi = (F.lit(float(v)) for v in value_range)
    t = (F.col(field).cast("double") - lo) / F.greatest(hi - lo, F.lit(1e-10))
    return _spread(rows, map_colors(t, colormap))
