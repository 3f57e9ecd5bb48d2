"""Ordered scans, joins and order statistics that never gather one key in one task.

A plain ``Window.partitionBy(streamline_id)`` puts a whole streamline in one task, and
a plain ``row_number()`` over everything puts the whole table there. The helpers below
split such groups: by a fixed number of vertices when the order is a dense index, or by
range partitions of the full sort key when it is not.
"""

from __future__ import annotations

import tempfile
from collections.abc import Sequence

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, BinaryType, DataType, StringType, StructType

CHUNK = 4096
DEFAULT_SALTS = 8
#: Groups up to this size are numbered by an ordinary window.
SMALL_LIMIT = 100_000


def subject(*frames: DataFrame) -> list[str]:
    """``["subject_id"]`` when every frame carries it, else no extra key."""
    return ["subject_id"] if all("subject_id" in f.columns for f in frames) else []


def streamline_keys(*frames: DataFrame) -> list[str]:
    return subject(*frames) + ["streamline_id"]


def voxel_keys(*frames: DataFrame) -> list[str]:
    return subject(*frames) + ["i", "j", "k"]


def cut_lineage(df: DataFrame) -> DataFrame:
    """Reliable checkpoint in the folder the session names, so lost executors are no loss.

    ``spark.checkpoint.dir`` is the cluster's shared folder. Only a local-mode session
    without one gets a folder of its own.
    """
    sc = df.sparkSession.sparkContext
    if sc.getCheckpointDir() is None:
        shared = sc.getConf().get("spark.checkpoint.dir") or df.sparkSession.conf.get(
            "spark.checkpoint.dir", None
        )
        if shared:
            sc.setCheckpointDir(shared)
        elif sc.master.startswith("local"):
            sc.setCheckpointDir(tempfile.mkdtemp(prefix="spark-"))
        else:
            raise ValueError("set spark.checkpoint.dir to a folder all executors share")
    return df.checkpoint(eager=True)


def small_table(spark: SparkSession, rows: Sequence[tuple], schema: str) -> DataFrame:
    """A few driver-side rows as a local relation, whose exact size the planner knows."""
    names = [part.split()[0] for part in schema.split(",")]
    return spark.createDataFrame(pd.DataFrame(list(rows), columns=names, dtype=object), schema)


def planned_bytes(df: DataFrame) -> int:
    """Catalyst's own size estimate; no job runs."""
    return int(str(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))


def broadcast_limit(spark: SparkSession) -> int:
    return int(spark._jsparkSession.sessionState().conf().autoBroadcastJoinThreshold())


def is_broadcastable(df: DataFrame) -> bool:
    return planned_bytes(df) <= broadcast_limit(df.sparkSession)


def _width(kind: DataType, value: Column) -> Column:
    """About the bytes of a value in memory."""
    if isinstance(kind, ArrayType):
        return F.lit(24) + F.coalesce(F.size(value), F.lit(0)) * _width(kind.elementType, F.get(value, F.lit(0)))
    if isinstance(kind, StructType):
        return sum((_width(f.dataType, value[f.name]) for f in kind.fields), F.lit(24))
    return F.lit(16) + F.coalesce(F.length(value), F.lit(0)) if isinstance(kind, (StringType, BinaryType)) else F.lit(8)


def settled(table: DataFrame) -> tuple[DataFrame, bool]:
    """The table, written if need be, and whether its true size is under Spark's broadcast threshold.

    The planner only guesses the size of a table that joins and aggregates made, mostly far too high, and
    then moves the rows that are looked up in it.
    """
    if is_broadcastable(table):
        return table, True
    table = cut_lineage(table)
    row = sum((_width(f.dataType, F.col(f"`{f.name}`")) for f in table.schema.fields), F.lit(24))
    size = table.agg(F.sum(row.cast("long")).alias("n")).first()["n"] or 0
    return table, size <= broadcast_limit(table.sparkSession)


def lookup(
    rows: DataFrame, table: DataFrame, on: Sequence[str], how: str = "inner", spread: bool = False,
    salts: int | None = None, small: bool = False,
) -> DataFrame:
    """Equi join of a large row set to a table that is (nearly) unique on ``on``.

    Spark broadcasts a table under its threshold by itself, and AQE cuts a skewed shuffle
    partition of the row side. With ``spread`` (voxel, cell and label keys, where one key
    may hold a third of the rows and the table is far smaller than them) the table is also
    copied ``salts`` times and the rows of a key dealt out over the copies by a hash of the
    row, stable under task retries. A table known to be ``small`` (a row per subject, or measured by
    ``settled``) is broadcast, so the rows stay where they are.
    """
    on = list(on)
    if small:
        return rows.join(F.broadcast(table), on, how)
    if salts is None:
        salts = DEFAULT_SALTS if spread and not is_broadcastable(table) else 1
    if salts <= 1:
        return rows.join(table, on, how)
    dealt = rows.withColumn("_salt", F.pmod(F.xxhash64(*rows.columns), F.lit(salts)).cast("int"))
    copies = F.explode(F.sequence(F.lit(0), F.lit(salts - 1)))
    return dealt.join(table.withColumn("_salt", copies), on + ["_salt"], how).drop("_salt")


def with_neighbours(
    rows: DataFrame,
    keys: Sequence[str],
    index: str = "point_idx",
    before: Sequence[str] = (),
    after: Sequence[str] = (),
    chunk: int = CHUNK,
) -> DataFrame:
    """Add ``prev_<c>`` / ``next_<c>`` of the adjacent vertex along a dense index.

    The window is partitioned by (keys, index div chunk); the vertices at the seams are
    also sent to the adjacent chunk, so the result equals an unbounded window while no
    group holds more than ``chunk + 2`` rows.
    """
    home = F.floor(F.col(index) / chunk)
    seat = F.pmod(F.col(index), F.lit(chunk))
    seams = (
        F.when((seat == 0) & (home > 0), F.array(home, home - 1))
        .when(seat == chunk - 1, F.array(home, home + 1))
        .otherwise(F.array(home))
    )
    w = Window.partitionBy(*keys, "_chunk").orderBy(index)
    added = {f"prev_{c}": F.lag(c).over(w) for c in before}
    added.update({f"next_{c}": F.lead(c).over(w) for c in after})
    return (
        rows.withColumn("_home", home)
        .withColumn("_chunk", F.explode(seams))
        .withColumns(added)
        .filter(F.col("_home") == F.col("_chunk"))
        .drop("_home", "_chunk")
    )


def running_sum(
    rows: DataFrame,
    keys: Sequence[str],
    value: Column,
    out: str,
    index: str = "point_idx",
    chunk: int = CHUNK,
) -> DataFrame:
    """Inclusive running sum along a dense index: sums inside chunks plus chunk offsets."""
    keys = list(keys)
    rows = rows.withColumn("_chunk", F.floor(F.col(index) / chunk)).withColumn("_v", value)
    inside = Window.partitionBy(*keys, "_chunk").orderBy(index).rowsBetween(
        Window.unboundedPreceding, Window.currentRow
    )
    earlier = Window.partitionBy(*keys).orderBy("_chunk").rowsBetween(Window.unboundedPreceding, -1)
    offsets = (
        rows.groupBy(*keys, "_chunk")
        .agg(F.sum("_v").alias("_s"))
        .withColumn("_offset", F.coalesce(F.sum("_s").over(earlier), F.lit(0)))
        .drop("_s")
    )
    return (
        rows.withColumn(out, F.sum("_v").over(inside))
        .join(offsets, keys + ["_chunk"])
        .withColumn(out, F.col(out) + F.col("_offset"))
        .drop("_chunk", "_v", "_offset")
    )


def running_total(
    rows: DataFrame,
    keys: Sequence[str],
    order: Sequence[str],
    weight: Column,
    out: str,
) -> DataFrame:
    """Inclusive running sum in ``order`` within ``keys``, for any order and any group size.

    Rows are range partitioned on the whole sort key, so a key with a third of all rows
    spans many partitions. The split is written once (checkpoint) because range bounds
    are sampled and must not move between the two reads.
    """
    keys, order = list(keys), list(order)
    parted = cut_lineage(
        rows.withColumn("_w", weight)
        .repartitionByRange(*[F.col(c) for c in keys + order])
        .withColumn("_range", F.spark_partition_id())
    )
    inside = Window.partitionBy(*keys, "_range").orderBy(*order).rowsBetween(
        Window.unboundedPreceding, Window.currentRow
    )
    # One row per (key, partition): small however large the key is.
    earlier = Window.partitionBy(*keys).orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)
    offsets = (
        parted.groupBy(*keys, "_range")
        .agg(F.sum("_w").alias("_s"))
        .withColumn("_offset", F.coalesce(F.sum("_s").over(earlier), F.lit(0)))
        .drop("_s")
    )
    return (
        parted.withColumn(out, F.sum("_w").over(inside))
        .join(offsets, keys + ["_range"])
        .withColumn(out, F.col(out) + F.col("_offset"))
        .drop("_range", "_w", "_offset")
    )


def row_rank(rows: DataFrame, order: Sequence[str], out: str, keys: Sequence[str] = ()) -> DataFrame:
    """0-based dense position in ``order`` (which must be unique within ``keys``)."""
    ranked = running_total(rows, keys, order, F.lit(1).cast("long"), out)
    return ranked.withColumn(out, F.col(out) - 1)


#: Shares of the rows at which ``first_n`` may cut before it orders.
SHARES = [2.0**-k for k in range(9, -1, -1)]


def first_n(rows: DataFrame, order: Sequence[str], n: int, by: Sequence[str] = ()) -> DataFrame:
    """The first ``n`` rows in ``order`` of each ``by``; the first column of the order is a number.

    Approximate quantiles of that column, taken in one aggregate, give a value that at least ``n`` rows
    do not exceed; only those are ranked, over range partitions, so neither a large ``n`` nor a large
    group gathers in one task. Quantiles are off by at most a ten-thousandth of the rows, and the
    share taken is at least twice what is needed, so the result is exact.
    """
    by, lead = list(by), order[0]
    if n <= 0:
        return rows.limit(0)
    one = F.lit(1).alias("_one")
    marks = F.percentile_approx(F.col(lead).cast("double"), SHARES, 10_000).alias("_marks")
    stats = rows.groupBy(*by, one).agg(F.count("*").alias("_rows"), marks)
    share = F.lit(2.0 * n) / F.col("_rows")
    enough = F.filter(F.arrays_zip(F.array(*[F.lit(s) for s in SHARES]).alias("share"), F.col("_marks").alias("mark")), lambda m: m["share"] >= share)
    cut = stats.select(*by, "_one", F.get(enough, F.lit(0))["mark"].alias("_cut"))
    near = lookup(rows.withColumn("_one", F.lit(1)), cut, [*by, "_one"])
    # Without a mark that is large enough all rows are ranked; nulls come first in any order.
    near = near.filter(F.col("_cut").isNull() | F.col(lead).isNull() | (F.col(lead).cast("double") <= F.col("_cut")))
    ranked = row_rank(near.drop("_one", "_cut"), order, "_pos", by)
    return ranked.filter(F.col("_pos") < n).drop("_pos")


def is_finite(value: Column) -> Column:
    return value.isNotNull() & ~F.isnan(value) & (F.abs(value) < F.lit(float("inf")))


def order_statistics(
    df: DataFrame, value: str, picks: dict[str, float], by: Sequence[str] = ()
) -> DataFrame:
    """Exact sorted[min(floor(p * n), n - 1)] over finite values, one column per pick.

    Equal values are counted first, so a value that fills the table is one row.
    """
    by = list(by)
    counted = (
        df.filter(is_finite(F.col(value)))
        .groupBy(*by, F.col(value).cast("double").alias("_value"))
        .agg(F.count("*").alias("_n"))
    )
    ranked = running_total(counted, by, ["_value"], F.col("_n"), "_upto")
    if by:
        totals = ranked.groupBy(*by).agg(F.sum("_n").alias("_total"))
        ranked = lookup(ranked, totals, by, small=True)
    else:
        total = ranked.agg(F.coalesce(F.sum("_n"), F.lit(0)).alias("t")).first()["t"]
        ranked = ranked.withColumn("_total", F.lit(int(total)).cast("long"))
    chosen = []
    for name, p in picks.items():
        at = F.least(F.floor(F.col("_total") * F.lit(float(p))), F.col("_total") - 1)
        hit = (F.col("_upto") > at) & (F.col("_upto") - F.col("_n") <= at)
        chosen.append(F.max(F.when(hit, F.col("_value"))).alias(name))
    return ranked.groupBy(*by).agg(F.max("_total").alias("n_finite"), *chosen)


def number_vertices(
    df: DataFrame,
    keys: Sequence[str],
    order: Sequence[str],
    out: str = "point_idx",
    largest_group: int | None = None,
) -> DataFrame:
    """Give rows that carry only an ordering a dense 0-based index within ``keys``.

    The size of the largest group is checked (one count, combined map-side). Groups that
    fit a task use an ordinary window; otherwise the numbering is range partitioned.
    """
    if largest_group is None:
        largest_group = largest_group_size(df, keys)
    if largest_group <= SMALL_LIMIT:
        w = Window.partitionBy(*keys).orderBy(*order)
        return df.withColumn(out, (F.row_number().over(w) - 1).cast("int"))
    return row_rank(df, order, out, keys).withColumn(out, F.col(out).cast("int"))


def largest_group_size(df: DataFrame, keys: Sequence[str]) -> int:
    top = df.groupBy(*keys).count().agg(F.max("count").alias("m")).first()["m"]
    return int(top or 0)
