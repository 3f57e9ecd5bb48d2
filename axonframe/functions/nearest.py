"""Exact nearest targets: packed trees over a space-filling order, searched block by block.

Targets and points are put in Morton order, so rows that follow one another lie close together, and
cut into runs of bounded length with tight boxes: leaves of targets, blocks of points. Runs of boxes
make the nodes above, run upon run, up to one root per group (a subject, say). Since runs are cut by
count and not by place, a dense spot has more leaves, not larger ones: no depth, cell size or number
of targets has to be chosen, and both sides are sorted once.

The search goes down the tree with all blocks at a time. A block keeps the nodes whose least distance
is not beyond the best worst case of any; only boxes meet until the leaves, and then a block streams
its leaves, nearest first. Groups never meet one another.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, DoubleType, IntegerType, LongType, StructField, StructType

from axonframe.functions.geometry import XYZ
from axonframe.functions.scan import cut_lineage, lookup, subject

#: Points of a block, targets of a leaf, nodes below a node.
BLOCK, LEAF, FAN = 128, 32, 64
#: Steps per unit of length of the Morton order, and its bits an axis. Beyond them rows are only ordered less well.
STEPS, BITS = 16.0, 21
#: Targets that a block is held against at a time.
TARGETS = 4096
BOX = [f"{side}{c}" for side in ("lo", "hi") for c in XYZ]


def morton(x: Column, y: Column, z: Column) -> Column:
    """Place in Morton order, from the three coordinates' bits in turn."""
    top = (1 << BITS) - 1

    def spread(v: Column) -> Column:
        n = F.least(F.greatest(F.floor(v * F.lit(STEPS)) + (1 << (BITS - 1)), F.lit(0)), F.lit(top)).cast("long")
        for shift, mask in ((32, 0x1F00000000FFFF), (16, 0x1F0000FF0000FF), (8, 0x100F00F00F00F00F), (4, 0x10C30C30C30C30C3), (2, 0x1249249249249249)):
            n = n.bitwiseOR(F.shiftleft(n, shift)).bitwiseAND(F.lit(mask))
        return n

    return spread(x).bitwiseOR(F.shiftleft(spread(y), 1)).bitwiseOR(F.shiftleft(spread(z), 2))


def runs(rows: DataFrame, by: Sequence[str], payload: str, size: int) -> DataFrame:
    """Rows in Morton order as runs: ``<by>, part, number``, the box, arrays ``x, y, z`` and ``payload``.

    ``part`` is the range of the order, ``number`` the run within it.
    """
    by = list(by)
    kept = rows.select(*by, *[F.col(c).cast("double").alias(c) for c in XYZ], payload)
    order = [*by, "_order", *XYZ]
    dealt = kept.withColumn("_order", morton(*[F.col(c) for c in XYZ])).repartitionByRange(*order).sortWithinPartitions(*order)
    dealt = dealt.drop("_order").withColumn("part", F.spark_partition_id())
    of = {f.name: f for f in kept.schema.fields}
    fields = [of[c] for c in by] + [StructField("part", IntegerType()), StructField("number", LongType())]
    fields += [StructField(c, DoubleType()) for c in BOX]
    fields += [StructField(c, ArrayType(of[c].dataType)) for c in (*XYZ, payload)]

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        number = 0
        for batch in batches:
            n = batch.num_rows
            if not n:
                continue
            groups = list(zip(*(batch[c].to_pylist() for c in by))) if by else [()] * n
            begins, last = [], 0
            for i in range(n):
                if i == 0 or groups[i] != groups[i - 1] or i - last == size:
                    begins.append(i)
                    last = i
            at = np.array(begins)
            place = {c: batch[c].to_numpy() for c in XYZ}
            low = [np.minimum.reduceat(place[c], at) for c in XYZ]
            high = [np.maximum.reduceat(place[c], at) for c in XYZ]
            offsets = pa.array(np.append(at, n), pa.int32())
            lists = [pa.ListArray.from_arrays(offsets, batch[c]) for c in (*XYZ, payload)]
            first = pa.array(at)
            yield pa.RecordBatch.from_arrays(
                [*(batch[c].take(first) for c in (*by, "part")), pa.array(number + np.arange(len(at))), *map(pa.array, low + high), *lists],
                [f.name for f in fields],
            )
            number += len(at)

    return dealt.mapInArrow(cut, StructType(fields))


def _levels(leaves: DataFrame, by: list[str]) -> list[DataFrame]:
    """Nodes level by level, leaves first: ``<by>, a, b``, the box, and the parent's ``up_a, up_b``.

    Runs of a part join first, then runs of parts; every level has about a ``FAN``-th of the nodes
    of the one below, the last one node per group.
    """
    nodes = cut_lineage(leaves.select(*by, F.col("part").cast("long").alias("a"), F.col("number").alias("b"), *BOX))
    top = nodes.agg(F.max("a").alias("a"), F.max("b").alias("b")).first()
    a, b = top["a"] or 0, top["b"] or 0
    out = []
    while a or b:
        up = (F.col("a"), F.expr(f"b div {FAN}")) if b else (F.expr(f"a div {FAN}"), F.lit(0).cast("long"))
        out.append(nodes.withColumns({"up_a": up[0], "up_b": up[1]}))
        box = [F.min(f"lo{c}").alias(f"lo{c}") for c in XYZ] + [F.max(f"hi{c}").alias(f"hi{c}") for c in XYZ]
        nodes = out[-1].groupBy(*by, F.col("up_a").alias("a"), F.col("up_b").alias("b")).agg(*box)
        a, b = (a, b // FAN) if b else (a // FAN, 0)
    zero = F.lit(0).cast("long")
    return [*out, nodes.withColumns({"up_a": zero, "up_b": zero})]


def _beating(pairs: DataFrame, limit2: float | None) -> DataFrame:
    """Pairs of a block and a node that may hold the nearest target of some point of the block."""
    gap, far = [], []
    for c in XYZ:
        ql, qh, tl, th = (F.col(f"{s}{c}") for s in ("q_lo", "q_hi", "lo", "hi"))
        gap.append(F.greatest(tl - qh, ql - th, F.lit(0.0)))
        far.append(F.greatest(th - ql, qh - tl))
    near2 = gap[0] * gap[0] + gap[1] * gap[1] + gap[2] * gap[2]
    far2 = far[0] * far[0] + far[1] * far[1] + far[2] * far[2]
    reach = F.min("_far2").over(Window.partitionBy("block"))
    if limit2 is not None:
        reach = F.least(reach, F.lit(limit2))
    # A whisker of slack so rounding never prunes an exact tie.
    met = pairs.withColumns({"near2": near2, "_far2": far2}).withColumn("_reach", reach)
    return met.filter(F.col("near2") <= F.col("_reach") * (1 + 1e-12) + 1e-12).drop("_far2", "_reach")


def nearest(points: DataFrame, targets: DataFrame, label: str | None, by: Sequence[str] = (), limit: float | None = None) -> DataFrame:
    """All ``points`` with ``nearest`` (the target's label, the smaller at equal distance) and ``d2``.

    Only targets with the same ``by`` count. Without one, or without one within ``limit``, or with a
    coordinate that is null or NaN, both are NULL.
    """
    by, limit2 = list(by), None if limit is None else float(limit) * float(limit)
    known = F.lit(True)
    for c in XYZ:
        known = known & F.col(c).isNotNull() & ~F.isnan(F.col(c).cast("double"))
    named = F.min(label).cast("long") if label else F.lit(0).cast("long")
    positions = targets.filter(known).groupBy(*by, *XYZ).agg(named.alias("label"))
    leaves = cut_lineage(runs(positions, by, "label", LEAF))
    # Points at one place are searched for once; one without a group meets no target.
    for c in by:
        known = known & F.col(c).isNotNull()
    place = [*by, *XYZ]
    carried = points.filter(known).select(*place).distinct().withColumn("row", F.struct(*place))
    blocks = cut_lineage(runs(carried, by, "row", BLOCK).withColumn("block", F.shiftleft(F.col("part").cast("long"), 32) + F.col("number")).drop("part", "number"))
    levels = _levels(leaves, by)
    zero = F.lit(0).cast("long")
    pairs = blocks.select(*by, "block", *[F.col(c).alias(f"q_{c}") for c in BOX], zero.alias("up_a"), zero.alias("up_b"))
    for level in reversed(levels):
        met = _beating(lookup(pairs, level, [*by, "up_a", "up_b"], spread=True), limit2)
        pairs = met.select(*by, "block", *[f"q_{c}" for c in BOX], F.col("a").alias("up_a"), F.col("b").alias("up_b"), "near2")
    at = pairs.select(*by, "block", "near2", F.col("up_a").cast("int").alias("part"), F.col("up_b").alias("number"))
    wanted = lookup(at, leaves.drop(*BOX), [*by, "part", "number"], spread=True)
    none = F.lit(None).cast(blocks.schema["row"].dataType)
    sides = wanted.select("block", "near2", *XYZ, "label", none.alias("row")).unionByName(
        blocks.select("block", F.lit(-1.0).alias("near2"), *XYZ, F.lit(None).cast("array<long>").alias("label"), "row")
    )
    found = sides.repartition("block").sortWithinPartitions("block", "near2").mapInArrow(_searcher(limit2), StructType([
        blocks.schema["row"], StructField("nearest", ArrayType(LongType())), StructField("d2", ArrayType(DoubleType())),
    ]))
    each = found.select(F.explode(F.arrays_zip("row", "nearest", "d2")).alias("_x")).select("_x.row.*", "_x.nearest", "_x.d2")
    each = lookup(points.filter(known), each, place, spread=True).select(*points.columns, "nearest", "d2")
    unknown = points.filter(~known).withColumns({"nearest": F.lit(None).cast("long"), "d2": F.lit(None).cast("double")})
    return each.unionByName(unknown)


def _searcher(limit2: float | None):
    """Reads a block, then its leaves from near to far, and gives out the block with what was found."""

    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = None

        def result() -> pa.RecordBatch:
            _, rows, _, best, d2 = held
            gone = ~np.isfinite(d2) if limit2 is None else ~(d2 <= limit2)
            out = [pa.array(best, mask=gone), pa.array(d2, mask=gone)]
            ends = pa.array([0, len(best)], pa.int32())
            return pa.RecordBatch.from_arrays([rows, *(pa.ListArray.from_arrays(ends, v) for v in out)], ["row", "nearest", "d2"])

        for batch in batches:
            block = batch["block"].to_numpy()
            near2 = batch["near2"].to_numpy()
            axes = [batch[c] for c in XYZ]
            for start, end in zip(*_spans(block)):
                if near2[start] < 0:
                    if held:
                        yield result()
                    points = np.stack([a[int(start)].values.to_numpy() for a in axes], 1)
                    held = (block[start], batch["row"].slice(start, 1), points, np.zeros(len(points), "int64"), np.full(len(points), np.inf))
                    start += 1
                if start == end:
                    continue
                one = [a.slice(start, end - start).flatten().to_numpy() for a in axes]
                _narrow(held, np.stack(one, 1), batch["label"].slice(start, end - start).flatten().to_numpy())
        if held:
            yield result()

    return search


def _spans(block: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    begins = np.flatnonzero(np.concatenate([[True], block[1:] != block[:-1]])) if len(block) else np.zeros(0, int)
    return begins, np.append(begins[1:], len(block)) if len(block) else begins


def _narrow(held: tuple, targets: np.ndarray, labels: np.ndarray) -> None:
    """Takes further targets into account; of equal distances the smallest label stays."""
    _, _, points, best, d2 = held
    for at in range(0, len(targets), TARGETS):
        part, names = targets[at : at + TARGETS], labels[at : at + TARGETS]
        order = np.argsort(names, kind="stable")
        part, names = part[order], names[order]
        dx, dy, dz = (points[:, None, k] - part[None, :, k] for k in range(3))
        all2 = dx * dx + dy * dy + dz * dz
        pick = all2.argmin(1)
        new2, new = all2[np.arange(len(points)), pick], names[pick]
        better = (new2 < d2) | ((new2 == d2) & (new < best))
        d2[better], best[better] = new2[better], new[better]


def nearest_in_radius(points: DataFrame, targets: DataFrame, label: str, radius: float) -> DataFrame:
    """``points`` rows with a target of their subject within ``radius``: adds ``nearest`` and ``d2``.

    Equal distances go to the smallest label.
    """
    if radius <= 0:
        return points.withColumns({"nearest": F.lit(None).cast("long"), "d2": F.lit(None).cast("double")}).limit(0)
    return nearest(points, targets, label, subject(points, targets), radius).filter(F.col("d2").isNotNull())


def distance_to_cloud(points: DataFrame, cloud: DataFrame, by: Sequence[str] | None = None) -> DataFrame:
    """Adds ``distance`` from each point to the nearest position of its subject's ``cloud``.

    Without a position in the cloud the distance is NULL.
    """
    found = nearest(points, cloud, None, subject(points, cloud) if by is None else by)
    return found.withColumn("distance", F.sqrt("d2")).drop("nearest", "d2")
