"""What the operators share: scratch folders, ordered dealing, names that clash with nothing."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.ml.feature import Bucketizer
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

#: Rows and bytes of one Arrow batch: bounds what a Python task holds at a time.
BATCH_ROWS, BATCH_BYTES = 2048, 16 << 20


def shared_dir(spark: SparkSession, name: str) -> str:
    """A new folder that the driver and all executors reach, under ``spark.checkpoint.dir``.

    Only a local-mode session without that setting gets a folder of its own.
    """
    sc = spark.sparkContext
    base = spark.conf.get("spark.checkpoint.dir", None) or sc.getCheckpointDir()
    if not base:
        if not sc.master.startswith("local["):
            raise ValueError("set spark.checkpoint.dir to a folder all executors share")
        base = tempfile.mkdtemp(prefix="spark-")
        sc.setCheckpointDir(base)
    return f"{base.rstrip('/')}/{name}-{uuid.uuid4().hex}"


def written(df: DataFrame, name: str) -> DataFrame:
    """Cut the lineage: write to the shared folder and read again."""
    path = shared_dir(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def arrow_batches(spark: SparkSession) -> None:
    """Small Arrow batches: long texts must not pile up in a Python task."""
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", BATCH_ROWS)
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", BATCH_BYTES)


def partitions(spark: SparkSession) -> int:
    return max(1, int(spark.conf.get("spark.sql.shuffle.partitions")))


def fresh(df: DataFrame, *names: str) -> list[str]:
    """Column names that the table does not use yet."""
    taken, out = {c.lower() for c in df.columns}, []
    for name in names:
        while name.lower() in taken:
            name = f"_{name}"
        taken.add(name.lower())
        out.append(name)
    return out


def whole_text(text: str | Column = "text") -> Column:
    """The text, with null read as empty."""
    return F.coalesce(F.col(text) if isinstance(text, str) else text, F.lit(""))


@dataclass
class Dealt:
    """Rows with a bucket number that follows the order of their key."""

    rows: DataFrame
    bucket: str
    n: int


def deal_in_order(df: DataFrame, key: str, n: int | None = None) -> Dealt:
    """Number the rows by range of ``key``: bucket 0 has the nulls, then ascending ranges.

    The limits are approximate quantiles of the key over all rows, n values for the driver;
    equal keys share a bucket, whatever the limits are. Reads the key column alone.
    """
    n = n or partitions(df.sparkSession)
    (bucket,) = fresh(df, "bucket")
    steps = [i / n for i in range(1, n)] or [0.5]
    limits = df.agg(F.percentile_approx(key, steps, 20_000).alias("q")).first()["q"] or []
    splits = [float("-inf"), *sorted({float(x) + 0.5 for x in limits or [0]}), float("inf")]
    (value, place) = fresh(df.withColumn(bucket, F.lit(0)), "value", "place")
    cut = Bucketizer(splits=splits, inputCol=value, outputCol=place, handleInvalid="keep")
    rows = cut.transform(df.withColumn(value, F.col(key).cast("double")))
    number = F.when(F.col(key).isNull(), 0).otherwise(F.col(place).cast("int") + 1)
    return Dealt(rows.withColumn(bucket, number).drop(value, place), bucket, len(splits))


def in_partitions(dealt: Dealt, order: Sequence[Column]) -> DataFrame:
    """Bucket k in partition k, sorted."""
    by_place = dealt.rows.repartitionById(dealt.n, F.col(dealt.bucket))
    return by_place.sortWithinPartitions(F.col(dealt.bucket), *order)


def ranked(rows: DataFrame, group: str, order: Sequence[str]) -> DataFrame:
    """Adds ``rank``, the place in ``order`` within the group from 0, and ``n``, the group's size.

    Dealt by ranges of group and order, so a group that holds most rows spans many partitions. Each
    partition is numbered as it is written; what precedes it is one row per group and partition that
    the group touches.
    """
    keys = [F.col(c).asc_nulls_first() for c in (group, *order)]
    dealt = rows.repartitionByRange(*keys).sortWithinPartitions(*keys).withColumn("_id", F.monotonically_increasing_id())
    parted = written(dealt, "ranked").withColumn("_range", F.shiftright("_id", 33))
    counts = parted.groupBy(F.col(group).alias("_g"), F.col("_range").alias("_r")).agg(F.min("_id").alias("_first"), F.count("*").alias("_n"))
    of_group = Window.partitionBy("_g")
    before = F.sum("_n").over(of_group.orderBy("_r").rowsBetween(Window.unboundedPreceding, -1))
    offsets = counts.select("_g", "_r", (F.coalesce(before, F.lit(0)) - F.col("_first")).alias("_shift"), F.sum("_n").over(of_group).alias("n"))
    joined = parted.join(offsets, F.col(group).eqNullSafe(F.col("_g")) & (F.col("_range") == F.col("_r")))
    return joined.withColumn("rank", F.col("_id") + F.col("_shift")).drop("_id", "_range", "_g", "_r", "_shift")
