"""Grayordinate matrices: expansion of map values to vertices and voxels."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from axonframe.functions.scan import lookup, subject

LEFT, RIGHT, SUBCORTICAL = "CORTEX_LEFT", "CORTEX_RIGHT", "SUBCORTICAL"


def expand_dense(matrix: DataFrame, models: DataFrame) -> DataFrame:
    """Matrix columns -> (map_id, structure, vertex or i, j, k, value), mapped places only."""
    on = subject(matrix, models) + ["col"]
    places = models.select(*on, "structure", "vertex", "i", "j", "k")
    return lookup(matrix, places, on).drop("col")


def expand_parcels(matrix: DataFrame, members: DataFrame) -> DataFrame:
    """Parcel values copied to every member; the later parcel wins a shared place.

    ``members``: col (parcel number), structure, vertex, i, j, k.
    """
    on = subject(matrix, members) + ["col"]
    place = ["structure", "vertex", "i", "j", "k"]
    spread = members.select(*on, *place).join(matrix, on)
    keys = [*subject(matrix, members), "map_id", *place]
    return spread.groupBy(*keys).agg(F.max_by("value", "col").alias("value"))


def densify(expanded: DataFrame, vertex_counts: dict[str, int]) -> DataFrame:
    """Dense surface form: every vertex of each structure, NaN where nothing is mapped."""
    maps = expanded.select(*subject(expanded), "map_id").distinct()
    # A handful of maps times the fixed vertex range of the surfaces.
    frame = maps.withColumn("_s", F.explode(F.array(*[F.struct(F.lit(s).alias("s"), F.lit(n).alias("n")) for s, n in vertex_counts.items()])))
    frame = frame.withColumn("vertex", F.explode(F.sequence(F.lit(0).cast("long"), F.col("_s.n").cast("long") - 1))).withColumn("structure", F.col("_s.s")).drop("_s")
    on = subject(expanded) + ["map_id", "structure", "vertex"]
    return frame.join(expanded.select(*on, "value"), on, "left").withColumn("value", F.coalesce("value", F.lit(float("nan"))))


def cifti_structure(expanded: DataFrame, structure: str, map_id: object) -> DataFrame:
    """Values of one structure and map; a missing one is an error."""
    chosen = expanded.filter((F.col("structure") == structure) & (F.col("map_id") == map_id))
    if chosen.isEmpty():
        raise ValueError(f"{structure} map {map_id} is unavailable")
    return chosen


def series_values(index: Column, start: float, step: float) -> Column:
    """Series axis value of a map: start + step * index."""
    return F.lit(float(start)) + F.lit(float(step)) * index
