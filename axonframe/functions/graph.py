"""Connected components of edge tables."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from axonframe.functions.scan import cut_lineage, lookup

#: Edges that a task joins at a time.
CHUNK = 1 << 20


def connect(edges: DataFrame) -> DataFrame:
    """``node, component`` of all ends of ``edges(u, v)``: each node with its smallest reachable node.

    Every round starts with forests: a task turns the edges it reads, a bounded number at a time, into
    stars around their smallest nodes. Edges that fill one task are done with that. Else two star
    rewrites follow, each one aggregate per node and one salted look-up of its result, so the centre
    of a large star is dealt over many tasks, until all edges are stars.
    """
    nodes = edges.select("u").union(edges.select("v")).distinct().withColumnRenamed("u", "node")
    links, parts = _forests(cut_lineage(_downward(edges)))
    while parts > 1 and not _are_stars(links):
        both = cut_lineage(links.union(links.select(F.col("v").alias("u"), F.col("u").alias("v"))))
        low = both.groupBy("u").agg(F.least(F.min("v"), F.first("u")).alias("m"))
        large = lookup(both.filter("v > u"), low, ["u"], spread=True).select(F.col("v").alias("u"), F.col("m").alias("v"))
        large = cut_lineage(_downward(large))
        low = large.groupBy("u").agg(F.min("v").alias("m"))
        small = lookup(large, low, ["u"], spread=True).select(F.col("v").alias("u"), F.col("m").alias("v"))
        links, parts = _forests(cut_lineage(_downward(small.union(low.select("u", F.col("m").alias("v"))))))
    roots = links.select(F.col("u").alias("node"), F.col("v").alias("component"))
    return nodes.join(roots, "node", "left").withColumn("component", F.coalesce("component", "node"))


def _downward(edges: DataFrame) -> DataFrame:
    return edges.filter("u <> v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct()


def _are_stars(links: DataFrame) -> bool:
    """No node hangs off two others, or off one while others hang off it."""
    ends = links.select(F.col("u").alias("node"), F.lit(1).alias("up"), F.lit(0).alias("down")).union(links.select("v", F.lit(0), F.lit(1)))
    return ends.groupBy("node").agg(F.sum("up").alias("up"), F.max("down").alias("down")).filter("up + down > 1").isEmpty()


def _forests(links: DataFrame) -> tuple[DataFrame, int]:
    """The links as stars, made in as many tasks as they fill, and that number."""
    parts = max(1, -(-links.count() // CHUNK))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []
        for batch in batches:
            held.append(batch)
            if sum(b.num_rows for b in held) >= CHUNK:
                yield _stars(held)
                held = []
        if held:
            yield _stars(held)

    return cut_lineage(links.coalesce(parts).mapInArrow(run, "u long, v long")), parts


def _stars(batches: list[pa.RecordBatch]) -> pa.RecordBatch:
    u, v = (np.concatenate([b[c].to_numpy() for b in batches]) for c in "uv")
    names, ends = np.unique(np.concatenate([u, v]), return_inverse=True)
    a, b = ends[: len(u)], ends[len(u) :]
    root = np.arange(len(names))
    while True:
        lower = np.minimum(root[a], root[b])
        new = root.copy()
        # Both roots and both ends take the lower root; then every node takes its root's.
        for at in (a, b, root[a], root[b]):
            np.minimum.at(new, at, lower)
        while (new != new[new]).any():
            new = new[new]
        if (new == root).all():
            break
        root = new
    rays = np.flatnonzero(root != np.arange(len(names)))
    return pa.RecordBatch.from_pydict({"u": names[rays], "v": names[root[rays]]})
