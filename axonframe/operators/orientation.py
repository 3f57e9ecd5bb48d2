"""Fixels, ODF rows and spherical-harmonic rows."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from axonframe.functions.color import map_colors, window_level
from axonframe.functions.geometry import XYZ, norm
from axonframe.functions.scan import is_finite, lookup, settled, subject
from axonframe.operators.volumes import finite_minmax

METRIC_ORDER = ("amplitude", "afd", "qa")
OTSU_BINS = 256


def fixel_keys(*frames: DataFrame) -> list[str]:
    return subject(*frames) + ["voxel_id", "fixel_idx"]


def fixel_slice(fixels: DataFrame, voxels: DataFrame, axis: int, index: int) -> DataFrame:
    """Fixels of the voxels on one slice (0 axial k, 1 coronal j, 2 sagittal i)."""
    column = {0: "k", 1: "j", 2: "i"}[axis]
    layer = voxels.filter(F.col(column) == index).select(*subject(fixels, voxels), "voxel_id", "i", "j", "k")
    return lookup(fixels, layer, subject(fixels, voxels) + ["voxel_id"])


def best_fixel(dirs: DataFrame, fixels: DataFrame, cos_max: float, key: Sequence[str], amplitude: str = "amplitude") -> DataFrame:
    """Per direction, the fixel of its voxel best aligned inside the cone, flipped to the
    direction's half-space; the lowest fixel number wins a tie.

    ``dirs``: key columns (a row per key), voxel_id, dx, dy, dz (unit). A voxel's fixels are one row, and the
    choice is made in the direction's own row: pairs are never rows, so nothing is sorted or grouped.
    """
    on = subject(dirs, fixels) + ["voxel_id"]
    length = norm(F.col("dx"), F.col("dy"), F.col("dz"))
    peak = F.struct("fixel_idx", *[(F.col(f"d{c}") / length).alias(c) for c in XYZ], F.col(amplitude).alias("amplitude"))
    peaks = fixels.filter(length * length >= 1e-8).groupBy(*on).agg(F.sort_array(F.collect_list(peak)).alias("_p"))
    peaks, small = settled(peaks)
    rows = lookup(dirs.select(*dict.fromkeys([*key, *on]), "dx", "dy", "dz"), peaks, on, spread=True, small=small)
    rows = rows.withColumn("_dots", F.transform("_p", lambda p: p["x"] * F.col("dx") + p["y"] * F.col("dy") + p["z"] * F.col("dz")))
    rows = rows.withColumn("_top", F.greatest(F.array_max("_dots"), -F.array_min("_dots")))
    # Fixels are in the order of their numbers, so the first of equal ones is the lowest.
    first = F.least(*[F.nullif(F.array_position("_dots", v), F.lit(0)) for v in (F.col("_top"), -F.col("_top"))]).cast("int") - 1
    # Chosen in a generator: a filter would be pushed below and the products made twice.
    chosen = F.array(F.struct("_top", F.get("_dots", first).alias("_dot"), F.get("_p", first).alias("_b")))
    rows = rows.select(*key, F.inline_outer(chosen)).filter(F.col("_top") >= cos_max)
    sign = F.when(F.col("_dot") >= 0, F.lit(1.0)).otherwise(F.lit(-1.0))
    return rows.select(*key, "_b.fixel_idx", *[(F.col("_b")[c] * sign).alias(c) for c in XYZ], "_b.amplitude")


def primary_peak_volume(fixels: DataFrame, voxels: DataFrame, metric: str) -> DataFrame:
    """The first fixel's metric per voxel; without the metric every voxel is 1."""
    on = subject(fixels, voxels) + ["voxel_id"]
    if metric not in fixels.columns:
        return voxels.select(*subject(voxels), "i", "j", "k", F.lit(1.0).alias("value"))
    first = fixels.filter(F.col("fixel_idx") == 0).select(*on, F.col(metric).alias("value"))
    return lookup(voxels.select(*on, "i", "j", "k"), first, on).drop("voxel_id")


def pick_metric(fixels: DataFrame, metric: str | None = None) -> str:
    """The named metric, or the first available of amplitude, afd, qa."""
    if metric is not None:
        if metric not in fixels.columns:
            raise ValueError(f"unknown fixel metric {metric!r}")
        return metric
    for name in METRIC_ORDER:
        if name in fixels.columns:
            return name
    raise ValueError("no usable fixel metric")


def otsu_threshold(fixels: DataFrame, metric: str | None = None, scope: str = "all", bins: int = OTSU_BINS) -> DataFrame:
    """Threshold with the largest between-class variance of a fixed-width histogram.

    One row per subject: lo, hi, threshold (upper edge of the last bin of the low class;
    the first best bin wins). ``scope`` is ``all`` fixels or ``primary`` peaks.
    """
    from pyspark.sql import Window

    name = pick_metric(fixels, metric)
    by = subject(fixels)
    rows = fixels if scope == "all" else fixels.filter(F.col("fixel_idx") == 0)
    rows = rows.select(*by, F.col(name).cast("double").alias("_x")).filter(is_finite(F.col("_x")))
    spans = rows.groupBy(*by).agg(F.min("_x").alias("lo"), F.max("_x").alias("hi"))
    if by:
        spread = lookup(rows, spans, by)
    else:
        span = spans.first()
        spread = rows.withColumns({n: F.lit(span[n]).cast("double") for n in ("lo", "hi")})
    width = (F.col("hi") - F.col("lo")) / F.lit(float(bins))
    at = F.when(width > 0, F.least(F.floor((F.col("_x") - F.col("lo")) / width), F.lit(bins - 1))).otherwise(F.lit(0))
    # At most `bins` rows per subject from here on.
    hist = spread.groupBy(*by, "lo", "hi", at.alias("bin")).agg(F.count("*").alias("n"))
    upto = Window.partitionBy(*by).orderBy("bin").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    whole = Window.partitionBy(*by)
    moment = F.col("n") * (F.col("bin") + F.lit(0.5))
    hist = hist.withColumns(
        {
            "_w": F.sum("n").over(upto),
            "_m": F.sum(moment).over(upto),
            "_n_all": F.sum("n").over(whole),
            "_m_all": F.sum(moment).over(whole),
        }
    )
    w0, w1 = F.col("_w"), F.col("_n_all") - F.col("_w")
    gap = F.col("_m") / F.nullif(w0, F.lit(0)) - (F.col("_m_all") - F.col("_m")) / F.nullif(w1, F.lit(0))
    variance = F.round(F.coalesce(w0 * w1 * gap * gap, F.lit(0.0)), 3)
    edge = F.col("lo") + (F.col("bin") + F.lit(1.0)) * width
    return hist.groupBy(*by).agg(
        F.first("lo").alias("lo"),
        F.first("hi").alias("hi"),
        F.max_by(edge, F.struct(variance, -F.col("bin"))).alias("threshold"),
    )


def fixel_otsu_gate(fixels: DataFrame, threshold: DataFrame, metric: str | None = None) -> DataFrame:
    """Fixels whose metric is not under the threshold row of ``otsu_threshold``."""
    name = pick_metric(fixels, metric)
    by = subject(fixels, threshold)
    if by:
        return lookup(fixels, threshold.select(*by, "threshold"), by).filter(F.col(name) >= F.col("threshold")).drop("threshold")
    cut = threshold.select("threshold").first()["threshold"]
    return fixels.filter(F.col(name) >= cut)


def color_fixels(
    fixels: DataFrame, scalars: DataFrame | None = None, colormap: str = "inferno", value_range: tuple | None = None
) -> DataFrame:
    """Fixel colours: absolute direction, or a scalar through a colour map over its subject's range.

    ``scalars`` has one value per fixel; a different count is an error.
    """
    keys = fixel_keys(fixels)
    if scalars is None:
        return fixels.select(*keys, *[F.abs(F.col(f"d{c}")).alias(n) for c, n in zip(XYZ, "rgb")])
    on = fixel_keys(fixels, scalars)
    n_fixels, n_values = fixels.count(), scalars.count()
    if n_fixels != n_values:
        raise ValueError(f"{n_values} scalars for {n_fixels} fixels")
    joined = fixels.select(*keys).join(scalars.select(*on, F.col("value").cast("double").alias("_v")), on)
    if value_range is None:
        by = subject(joined, scalars)
        span = finite_minmax(scalars, "value", by).withColumnsRenamed({"lo": "_lo", "hi": "_hi"}).withColumn("_one", F.lit(1))
        joined = lookup(joined.withColumn("_one", F.lit(1)), span, [*by, "_one"])
        value_range = (F.col("_lo"), F.col("_hi"))
    color = map_colors(window_level(F.col("_v"), *value_range), colormap)
    return joined.select(*keys, *[color[c].alias(c) for c in "rgb"])


# --- ODF rows -----------------------------------------------------------------------


def odf_mirror(amps: Column) -> Column:
    """Full sphere from a hemisphere: the row twice."""
    return F.concat(amps, amps)


def odf_condition(amps: Column, subtract_iso: bool = True, norm_within_voxel: bool = True, target_mm: float = 1.0) -> Column:
    """Subtract the finite minimum and scale so the peak equals the target.

    Scaling is skipped with any non-finite value, a peak or a target that is not positive.
    """
    finite = F.filter(amps, is_finite)
    low = F.coalesce(F.array_min(finite), F.lit(0.0)) if subtract_iso else F.lit(0.0)
    moved = F.transform(amps, lambda v: F.when(is_finite(v), v - low).otherwise(v)) if subtract_iso else amps
    if not norm_within_voxel or not 0 < target_mm < float("inf"):
        return moved
    peak = F.coalesce(F.array_max(finite), F.lit(0.0)) - low
    clean = F.size(finite) == F.size(amps)
    scale = F.lit(float(target_mm)) / F.nullif(peak, F.lit(0.0))
    return F.when(clean & (peak > 0), F.transform(moved, lambda v: v * scale)).otherwise(moved)


def sh_to_amplitudes(coeffs: Column, basis: Sequence[Sequence[float]]) -> Column:
    """max(0, coefficients . basis row) per direction; ``basis`` is a fixed matrix."""
    rows = F.array(*[F.array(*[F.lit(float(v)) for v in row]) for row in basis])

    def amplitude(row: Column) -> Column:
        terms = F.zip_with(coeffs, row, lambda a, b: a * b)
        return F.greatest(F.lit(0.0), F.aggregate(terms, F.lit(0.0), lambda acc, v: acc + v))

    return F.transform(rows, amplitude)
