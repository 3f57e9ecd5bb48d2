"""Volumes as bricks: a row holds a block of voxels with a border of its neighbours.

A point then needs one row of the volume for all voxels around it, so interpolation is one lookup
per point and an expression over the row, and points are never multiplied. Voxels next to a border
are copied into the bricks beyond it; a brick holds at most ``edge ** 3`` values, whatever the data.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from axonframe.functions.scan import lookup

AT = ["_bi", "_bj", "_bk"]


@dataclass(frozen=True)
class Bricks:
    """``table(<by>, _bi, _bj, _bk, _cells)``; ``low`` and ``high`` voxels of border before and after."""

    table: DataFrame
    by: tuple[str, ...]
    bits: int
    low: int
    high: int

    @property
    def edge(self) -> int:
        return (1 << self.bits) + self.low + self.high

    def beside(self, rows: DataFrame, base: Sequence[Column]) -> DataFrame:
        """``rows`` with the brick of their ``base`` voxel, for ``cell``; rows without one are kept."""
        local = [F.col(c).bitwiseAND((1 << self.bits) - 1) + self.low for c in ("_i", "_j", "_k")]
        placed = rows.withColumns({c: b for c, b in zip(("_i", "_j", "_k"), base)})
        at = (local[0] * self.edge + local[1]) * self.edge + local[2]
        placed = placed.withColumns({b: F.shiftright(c, self.bits) for b, c in zip(AT, ("_i", "_j", "_k"))} | {"_at": at})
        return lookup(placed.drop("_i", "_j", "_k"), self.table, [*self.by, *AT], "left", spread=True)

    def cell(self, di: int | Column, dj: int | Column, dk: int | Column) -> Column:
        """The voxel at an offset of the base, NULL where the volume has none."""
        step = (di * self.edge + dj) * self.edge + dk
        return F.get("_cells", F.col("_at") + step)


def make_bricks(voxels: DataFrame, value: Column, by: Sequence[str] = (), bits: int = 3, low: int = 0, high: int = 1) -> Bricks:
    """Bricks of ``2 ** bits`` voxels an axis of ``voxels(<by>, i, j, k, ...)``.

    Of several rows of one voxel the greatest value counts.
    """
    by, side = list(by), 1 << bits
    edge = side + low + high
    rows = voxels.select(*by, "i", "j", "k", value.alias("_value"))
    for axis, brick in zip("ijk", AT):
        inside = F.col(axis).bitwiseAND(side - 1)
        own = F.shiftright(axis, bits)
        seats = [F.struct(own.alias("b"), inside.alias("l"))]
        if high:
            seats.append(F.when(inside < high, F.struct((own - 1).alias("b"), (inside + side).alias("l"))))
        if low:
            seats.append(F.when(inside >= side - low, F.struct((own + 1).alias("b"), (inside - side).alias("l"))))
        rows = rows.withColumn("_s", F.explode(F.filter(F.array(*seats), lambda s: s.isNotNull())))
        rows = rows.withColumns({brick: F.col("_s.b"), axis: F.col("_s.l") + low}).drop("_s")
    place = (F.col("i") * edge + F.col("j")) * edge + F.col("k")
    rows = rows.select(*by, *AT, place.cast("int").alias("_place"), "_value")
    empty = rows.select(*by, *AT).distinct().withColumn("_place", F.explode(F.sequence(F.lit(0), F.lit(edge**3 - 1))))
    empty = empty.withColumn("_value", F.lit(None).cast(rows.schema["_value"].dataType))
    whole = rows.unionByName(empty).repartition(*by, *AT).groupBy(*by, *AT, "_place").agg(F.max("_value").alias("_value"))
    cells = F.transform(F.sort_array(F.collect_list(F.struct("_place", "_value"))), lambda c: c["_value"])
    return Bricks(whole.groupBy(*by, *AT).agg(cells.alias("_cells")), tuple(by), bits, low, high)
