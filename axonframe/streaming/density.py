"""Running voxel density of arriving streamline vertices."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.types import StructType

from axonframe.functions.geometry import Grid, points_to_voxels


def stream_voxel_density(vertices: DataFrame, grid: Grid | None = None, run_id: str | None = None) -> DataFrame:
    """Vertices per voxel of a (streaming or batch) frame.

    Rows carry x, y, z (placed on ``grid``) or a ready ``voxel`` column. ``run_id`` keeps
    only the current run where rows are tagged with one. State is one counter per voxel,
    bounded by the grid, so complete and update mode need no watermark.
    """
    if run_id is not None:
        vertices = vertices.filter(F.col("run_id") == run_id)
    if grid is None:
        return vertices.groupBy("voxel").agg(F.count("*").alias("density"))
    return points_to_voxels(vertices, grid, "floor").groupBy("i", "j", "k").agg(F.count("*").alias("density"))


def start_density(density: DataFrame, sink: str, name: str, checkpoint: str, mode: str = "complete") -> StreamingQuery:
    """Write the running counts: ``memory`` (whole table each time) or a Parquet folder.

    In ``complete`` mode each batch has a folder of all counts. In ``update`` mode it holds only the
    voxels that the batch changed, with their new counts: read with ``current_counts``.
    """
    if mode not in ("complete", "update"):
        raise ValueError(f"unknown output mode {mode!r}")
    writer = density.writeStream.outputMode(mode).option("checkpointLocation", checkpoint).trigger(availableNow=True)
    if sink == "memory":
        return writer.format("memory").queryName(name).start()

    def replace(batch: DataFrame, batch_id: int) -> None:
        # A batch id folder is rewritten whole on retry, so replays do not add up.
        batch.write.mode("overwrite").parquet(f"{sink}/batch={batch_id}")

    return writer.foreachBatch(replace).start()


def latest_batch(spark: SparkSession, sink: str) -> DataFrame:
    rows = spark.read.parquet(sink)
    newest = rows.agg(F.max("batch").alias("b")).first()["b"]
    return rows.filter(F.col("batch") == newest).drop("batch")


# --- update mode ----------------------------------------------------------------------


def _changes(spark: SparkSession, sink: str, voxel: Sequence[str]) -> DataFrame:
    """All rows that still count: ``<voxel>, density, batch``. A compacted table stands for the
    batches up to its number."""
    schema = StructType([*[f for f in spark.read.parquet(sink).schema.fields if f.name in (*voxel, "density", "batch")]])
    rows = spark.read.schema(schema).parquet(sink)
    # Compacted tables are folders of half numbers, so they sort after the batch they end with.
    base = rows.filter(F.col("batch") % 1 != 0).agg(F.max("batch").alias("_base")).withColumn("_one", F.lit(1))
    met = rows.withColumn("_one", F.lit(1)).join(base, "_one")
    return met.filter(F.col("_base").isNull() | (F.col("batch") >= F.col("_base"))).select(*voxel, "density", "batch")


def current_counts(spark: SparkSession, sink: str, voxel: Sequence[str] = ("i", "j", "k")) -> DataFrame:
    """The newest count of each voxel over the folders of an ``update`` sink."""
    newest = _changes(spark, sink, voxel).groupBy(*voxel).agg(F.max_by("density", "batch").alias("density"))
    return newest


def compact(spark: SparkSession, sink: str, voxel: Sequence[str] = ("i", "j", "k")) -> None:
    """Fold the batches of an ``update`` sink into one table, and empty their folders.

    To be called between runs. The table is written before anything is emptied, and until it is whole
    readers do not see it; a call that was cut off can simply be repeated.
    """
    batches = [r["batch"] for r in spark.read.parquet(sink).select("batch").distinct().collect()]
    done = [b for b in batches if b % 1 == 0]
    if not done:
        return
    last = int(max(done))
    current_counts(spark, sink, voxel).write.mode("overwrite").parquet(f"{sink}/batch={last}.5")
    empty = spark.createDataFrame([], spark.read.parquet(f"{sink}/batch={last}.5").schema)
    for batch in batches:
        if batch <= last:
            name = int(batch) if batch % 1 == 0 else batch
            empty.write.mode("overwrite").parquet(f"{sink}/batch={name}")
