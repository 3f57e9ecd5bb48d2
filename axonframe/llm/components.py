"""Connected components of an edge table."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from axonframe.llm.common import written

#: Edges that a task joins at a time.
CHUNK = 1 << 20


def components(edges: DataFrame) -> DataFrame:
    """``node, root`` for all ends of ``edges(a, b)``; root is the smallest node of a component.

    Tasks join ``CHUNK`` edges at a time into stars, so edges that fit one chunk are done with that.
    Else each round then takes a large-star and a small-star step, each one aggregate per node
    and one join with it, until all edges form stars. Edges fold to distinct pairs before they
    move; a centre with many edges is a skewed join that Spark splits.
    """
    given = written(_ordered(edges), "edges")
    stars, parts = _dealt(given)
    while parts > 1 and not _are_stars(stars):
        stars, parts = _dealt(written(_small_star(_large_star(stars)), "edges"))
    ends = stars.select(F.col("a").alias("node"), F.col("b").alias("root"))
    return ends.union(stars.select("b", "b")).distinct()


def _dealt(edges: DataFrame) -> tuple[DataFrame, int]:
    """The edges as stars of as many tasks as they fill, and that number."""
    parts = max(1, -(-edges.count() // CHUNK))
    return written(_joined(edges.coalesce(parts)), "stars"), parts


def _are_stars(edges: DataFrame) -> bool:
    """No node has two centres or is a centre and has one."""
    ends = edges.select(F.col("a").alias("node"), F.lit(1).alias("centres"), F.lit(0).alias("rays")).union(
        edges.select("b", F.lit(0), F.lit(1))
    )
    nodes = ends.groupBy("node").agg(F.sum("centres").alias("centres"), F.max("rays").alias("rays"))
    return nodes.filter("centres + rays > 1").isEmpty()


def forest(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The same components as stars around their smallest nodes: members and centres."""
    nodes, ends = np.unique(np.concatenate([a, b]), return_inverse=True)
    u, v = ends[: len(a)], ends[len(a) :]
    label = np.arange(len(nodes))
    while True:
        low = np.minimum(label[u], label[v])
        new = label.copy()
        np.minimum.at(new, label[u], low)
        np.minimum.at(new, label[v], low)
        while (new != new[new]).any():
            new = new[new]
        if (new == label).all():
            rays = np.flatnonzero(label != np.arange(len(nodes)))
            return nodes[rays], nodes[label[rays]]
        label = new


def _joined(edges: DataFrame) -> DataFrame:
    """Edges of a task as stars."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []

        def stars() -> pa.RecordBatch:
            table = pa.Table.from_batches(held)
            a, b = forest(table["a"].to_numpy(), table["b"].to_numpy())
            return pa.RecordBatch.from_pydict({"a": pa.array(a, pa.int64()), "b": pa.array(b, pa.int64())})

        for batch in batches:
            held.append(batch)
            if sum(h.num_rows for h in held) >= CHUNK:
                yield stars()
                held = []
        if held:
            yield stars()

    return edges.select("a", "b").mapInArrow(run, "a long, b long")


def _ordered(edges: DataFrame) -> DataFrame:
    """a > b, distinct. A member's edges lie in one partition, so a task that joins them keeps few."""
    pairs = edges.filter("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b"))
    return pairs.repartition("a").distinct()


def _large_star(edges: DataFrame) -> DataFrame:
    """Every larger neighbour of a node goes to the smallest one."""
    both = edges.union(edges.select("b", "a")).toDF("node", "other")
    least = both.groupBy("node").agg(F.least(F.min("other"), F.first("node")).alias("least"))
    moved = both.filter("other > node").join(least, "node").filter("other <> least")
    return moved.select(F.col("other").alias("a"), F.col("least").alias("b"))


def _small_star(edges: DataFrame) -> DataFrame:
    """A node and its smaller neighbours go to the smallest of them."""
    least = edges.groupBy("a").agg(F.min("b").alias("least"))
    moved = edges.join(least, "a").select(F.col("b").alias("a"), F.col("least").alias("b"))
    return _ordered(moved.union(least.select("a", "least")))
