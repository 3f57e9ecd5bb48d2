"""N-gram Jaccard join in the metric space of shingle sets.

The distance 1 - Jaccard is a metric, r = 1 - threshold the radius of a link. Texts that have
nothing to do with one another are all at distance 1, where pivots cannot tell them apart, so
the join has two levels, both exact:

*Coarse regions.* The shingles of a set are put in order, those of the fewest sets first. Two linked
sets share one of their first n - ceil(threshold n) + 1, so the components of sets that share such
a shingle are regions without links between them. A shingle of one set alone meets nothing; most
texts have enough of those to be done with at once.

*Voronoi regions.* In a coarse region pivots are drawn and the distance of every set to every
pivot is found. Sets within r of a pivot are linked to it, so a pivot is done with. The others
go to their nearest pivot's cell, and to each further cell whose distance is within 2 r of the
nearest: by the triangle inequality both ends of a link then meet in one cell. Cells are joined
recursively. Where windows would copy so much that the cells' pairs are over half of the region's
it is not split, only its pivots leave. New pivots come from sets outside the region's largest component, and a region is
finished when one component holds it: components, not pairs, are wanted. Regions of at most
``leaf`` sets end in one task; larger ones go through salted passes of the same steps over Spark.

Equal sets are one node from the start and fold in the task that reads them.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from axonframe.llm.common import arrow_batches, fresh, written
from axonframe.llm.components import components
from axonframe.llm.shingles import shingles_of


@dataclass(frozen=True)
class JoinParams:
    """Links have 100 * intersection >= percent * union."""

    words: int = 5
    percent: int = 80
    leaf: int = 1024
    leaf_pivots: int = 32
    leaf_bytes: int = 8 << 20
    pivots: int = 1024
    pivot_bytes: int = 4 << 20
    salts: int = 16
    often: int = 1024
    bucket: int = 1 << 18

    @property
    def radius(self) -> float:
        return 1 - self.percent / 100

    def linked(self, both: np.ndarray, a: np.ndarray, b: int) -> np.ndarray:
        return 100 * both >= self.percent * (a + b - both)


def shingle_sets(texts: list[str | None], words: int) -> list[np.ndarray]:
    """Distinct shingles of each text with A-Z lowered, sorted; of fewer words the one sequence of all."""
    return [np.unique(s) for s in shingles_of([(t or "").encode().lower() for t in texts], words)]


def node_of(values: np.ndarray) -> int:
    return int(np.int64(np.uint64(xxhash.xxh3_64_intdigest(values.tobytes()))))


# --- coarse regions -------------------------------------------------------------------

#: Numbers that travel in one row, bucket by bucket, as bytes.
BLOCKS = "bucket int, shingles binary, nodes binary, needs binary, often binary"


#: Needs travel in two bytes; a smaller need is a longer prefix, never a lost link.
NEED_MOST = (1 << 16) - 1


def shortened(values: np.ndarray, need: int) -> tuple[np.ndarray, int]:
    """Shingles as four bytes, for use inside their bucket, and the need that still holds.

    Shingles of one bucket that agree in these bytes count as one: that may only add meetings. Those
    of one set that do are as many fewer that a linked set surely shares, but at least one.
    """
    short = values.astype(np.uint32)
    in_order = np.sort(short)
    lost = int((in_order[1:] == in_order[:-1]).sum())
    return short, min(max(need - lost, 1), NEED_MOST)


def widened(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Blocks of short shingles as blocks of whole numbers: the bucket, then the four bytes."""
    for batch in batches:
        for row in batch.to_pylist():
            shingle = np.uint64(row["bucket"] << 32) | np.frombuffer(row["shingles"], "<u4").astype(np.uint64)
            yield pa.RecordBatch.from_pydict({
                "bucket": pa.array([row["bucket"]], pa.int32()),
                "shingles": pa.array([shingle.tobytes()]),
                "nodes": pa.array([row["nodes"]]),
                "needs": pa.array([np.frombuffer(row["needs"], "<u2").astype(np.int32).tobytes()]),
            })


def dealt(bucket: np.ndarray, rows: dict[str, np.ndarray]) -> pa.RecordBatch:
    """One row a bucket: the rows of each, in the order they have."""
    order = np.argsort(bucket, kind="stable")
    found, begins = np.unique(bucket[order], return_index=True)
    ends = np.append(begins[1:], len(order))
    columns = {"bucket": pa.array(found.astype(np.int32))}
    for name in ("shingles", "nodes", "needs", "often"):
        values = rows[name][order] if name in rows else np.zeros(0, np.int16)
        size = values.itemsize if name in rows else 0
        offsets = pa.array(np.append(begins, ends[-1:]) * size, pa.int32()) if len(found) else pa.array([0], pa.int32())
        columns[name] = pa.Array.from_buffers(pa.binary(), len(found), [None, offsets.buffers()[1], pa.py_buffer(values.tobytes())])
    return pa.RecordBatch.from_pydict(columns)


def gathered(batches: Iterator[pa.RecordBatch], kinds: dict[str, str], full: int = 1 << 62):
    """``(rows, is_last)`` of each bucket: whole, or as soon as ``full`` rows have come together."""
    bucket, held, size = None, {k: [] for k in kinds}, 0

    def taken() -> dict[str, np.ndarray]:
        return {k: np.concatenate(v) for k, v in held.items()}

    for batch in batches:
        for row in batch.to_pylist():
            if row["bucket"] != bucket:
                if size:
                    yield taken(), True
                bucket, held, size = row["bucket"], {k: [] for k in kinds}, 0
            for k, kind in kinds.items():
                held[k].append(np.frombuffer(row[k], kind))
            size += len(held["nodes"][-1])
            if size >= full:
                yield taken(), False
                held, size = {k: [] for k in kinds}, 0
    if bucket is not None:
        yield (taken() if size else {k: np.zeros(0, kind) for k, kind in kinds.items()}), True


def owned(batches: Iterator[pa.RecordBatch], most: int, buckets: int, full: int) -> Iterator[pa.RecordBatch]:
    """From shingles by bucket to those that several sets have, by bucket of their nodes.

    ``often`` is the number of sets, ``most`` at most. A shingle that comes ``most`` times before its
    bucket is whole is given out at once, and so are its later rows: what is held stays bounded.
    """
    kinds = {"shingles": "<u8", "nodes": "<i8", "needs": "<i4"}
    rest, hot = None, np.zeros(0, np.uint64)

    def out(rows: dict[str, np.ndarray], often: np.ndarray) -> pa.RecordBatch:
        place = ((rows["nodes"].view(np.uint64) >> np.uint64(32)) * np.uint64(buckets)) >> np.uint64(32)
        return dealt(place, {**rows, "often": often.astype(np.int16)})

    for rows, is_last in gathered(batches, kinds, full):
        known = np.isin(rows["shingles"], hot)
        if known.any():
            yield out({k: v[known] for k, v in rows.items()}, np.full(known.sum(), most))
            rows = {k: v[~known] for k, v in rows.items()}
        if rest is not None:
            rows = {k: np.concatenate([rest[k], v]) for k, v in rows.items()}
        order = np.lexsort([rows["nodes"], rows["shingles"]])
        rows = {k: v[order] for k, v in rows.items()}
        shingle, node = rows["shingles"], rows["nodes"]
        fresh_row = np.append(True, (shingle[1:] != shingle[:-1]) | (node[1:] != node[:-1]))[: len(node)]
        rows = {k: v[fresh_row] for k, v in rows.items()}
        shingle = rows["shingles"]
        begins = np.flatnonzero(np.append(True, shingle[1:] != shingle[:-1])[: len(shingle)])
        counts = np.diff(np.append(begins, len(shingle)))
        often = np.repeat(np.minimum(counts, most), counts)
        if is_last:
            several = often > 1
            rest, hot = None, np.zeros(0, np.uint64)
        else:
            several = often >= most
            hot = np.concatenate([hot, shingle[begins[counts >= most]]])
            rest = {k: v[~several] for k, v in rows.items()}
        if several.any():
            yield out({k: v[several] for k, v in rows.items()}, often[several])


def prefixes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """From the shared shingles by bucket of nodes to ``shingle, node``: of each set all but its
    ``need - 1`` last, those that the most sets have."""
    kinds = {"shingles": "<u8", "nodes": "<i8", "needs": "<i4", "often": "<i2"}
    for rows, _ in gathered(batches, kinds):
        order = np.lexsort([~rows["shingles"], -rows["often"], rows["nodes"]])
        node, shingle, need = (rows[k][order] for k in ("nodes", "shingles", "needs"))
        # A shingle given out early may have come twice.
        once = np.append(True, (node[1:] != node[:-1]) | (shingle[1:] != shingle[:-1]))[: len(node)]
        node, shingle, need = node[once], shingle[once], need[once]
        begins = np.flatnonzero(np.append(True, node[1:] != node[:-1])[: len(node)])
        place = np.arange(len(node)) - np.repeat(begins, np.diff(np.append(begins, len(node))))
        keep = place >= need - 1
        yield pa.RecordBatch.from_pydict({"shingle": pa.array(shingle[keep].view(np.int64)), "node": pa.array(node[keep])})


def stars(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """From rows sorted by (shingle, node) to each node with the smallest one it shares a shingle with."""
    last, centre = None, 0
    for batch in batches:
        shingle, node = batch["shingle"].to_numpy(), batch["node"].to_numpy()
        if not len(shingle):
            continue
        begins = np.concatenate([[True], shingle[1:] != shingle[:-1]])
        centres = node[np.flatnonzero(begins)].copy()
        if last is not None and shingle[0] == last:
            centres[0] = centre
        of = centres[np.cumsum(begins) - 1]
        last, centre = int(shingle[-1]), int(of[-1])
        keep = of != node
        pairs = np.unique(np.stack([of[keep], node[keep]], 1), axis=0) if keep.any() else np.zeros((0, 2), np.int64)
        yield pa.RecordBatch.from_pydict({"a": pa.array(pairs[:, 0]), "b": pa.array(pairs[:, 1])})


def meetings(docs: DataFrame, p: JoinParams, shingles: int) -> DataFrame:
    """Pairs (a, b) of nodes that share one of their rarest shingles: each with the smallest that has it.

    All shingles, ``shingles`` in number, cross one exchange to be counted; those of one set alone end
    there. The others go back to their sets, which put them in order, and their first ones meet. Both
    times they travel in blocks, a row for each bucket of a batch, and buckets are of bounded size.
    To be counted a shingle takes 14 bytes: four of its own, eight of its set and two of the need.
    """
    buckets = max(1, -(-shingles // p.bucket))

    def exploded(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: set[int] = set()
        for batch in batches:
            sets, shorts, nodes, needs = [np.zeros(0, np.uint64)], [np.zeros(0, np.uint32)], [], []
            for values in shingle_sets(batch["text"].to_pylist(), p.words):
                # Below this size linked sets are equal.
                if p.percent * (len(values) + 1) > 100 * len(values):
                    continue
                node = node_of(values)
                if node in seen:
                    continue
                if len(seen) > 1 << 20:
                    seen.clear()
                seen.add(node)
                short, need = shortened(values, -(-p.percent * len(values) // 100))
                sets.append(values)
                shorts.append(short)
                nodes.append(node)
                needs.append(need)
            many = np.array([len(v) for v in sets[1:]], np.int64)
            shingle = np.concatenate(sets)
            each = {"nodes": np.array(nodes, np.int64), "needs": np.array(needs, np.uint16)}
            rows = {"shingles": np.concatenate(shorts), **{k: np.repeat(v, many) for k, v in each.items()}}
            yield dealt(((shingle >> np.uint64(32)) * np.uint64(buckets)) >> np.uint64(32), rows)

    rows = docs.select(F.col("text").cast("string").alias("text")).mapInArrow(exploded, BLOCKS)
    counted = rows.repartition("bucket").sortWithinPartitions("bucket")
    shared = counted.mapInArrow(lambda batches: owned(widened(batches), p.often, buckets, 2 * p.bucket), BLOCKS)
    first = shared.repartition("bucket").sortWithinPartitions("bucket").mapInArrow(prefixes, "shingle long, node long")
    return first.repartition("shingle").sortWithinPartitions("shingle", "node").mapInArrow(stars, "a long, b long")


# --- Voronoi regions in one task --------------------------------------------------------


class Joined:
    """Components of the sets 0 .. n - 1, and the links that made them."""

    def __init__(self, labels: list[int]) -> None:
        self.label = np.unique(np.asarray(labels), return_inverse=True)[1]
        self.links: list[tuple[int, int]] = []

    def link(self, i: int, others: np.ndarray) -> None:
        for j in others:
            if self.label[j] != self.label[i]:
                self.links.append((i, int(j)))
                self.label[self.label == self.label[j]] = self.label[i]


class Postings:
    """Sets by their shingles: the sizes of the intersections with one set, or of one of them with all."""

    def __init__(self, sets: list[np.ndarray]) -> None:
        self.sizes = np.array([len(s) for s in sets])
        self.first = np.concatenate([[0], np.cumsum(self.sizes)[:-1]])
        self.values, self.flat = np.unique(np.concatenate(sets), return_inverse=True)
        order = np.argsort(self.flat, kind="stable")
        self.owner = np.repeat(np.arange(len(sets)), self.sizes)[order]
        self.begin = np.searchsorted(self.flat[order], np.arange(len(self.values) + 1))

    def with_own(self, i: int) -> np.ndarray:
        """Intersections of set i with every set."""
        mine = np.zeros(len(self.values), np.int64)
        mine[self.flat[self.first[i] : self.first[i] + self.sizes[i]]] = 1
        return np.add.reduceat(mine[self.flat], self.first)

    def with_other(self, values: np.ndarray) -> np.ndarray:
        at = np.minimum(np.searchsorted(self.values, values), len(self.values) - 1)
        at = at[self.values[at] == values]
        lengths = self.begin[at + 1] - self.begin[at]
        picked = np.repeat(self.begin[at] - np.concatenate([[0], np.cumsum(lengths)[:-1]]), lengths) + np.arange(lengths.sum())
        return np.bincount(self.owner[picked], minlength=len(self.sizes))


def cells_of(distances: np.ndarray, radius: float) -> np.ndarray:
    """Boolean (set, pivot): the nearest pivot's cell and those whose window the set is in."""
    near = distances.min(1, keepdims=True)
    return distances <= near + 2 * radius + 1e-9


def join_region(sets: list[np.ndarray], labels: list[int], p: JoinParams) -> list[tuple[int, int]]:
    """Links that connect the components of ``sets``; those of one label are connected already."""
    joined = Joined(labels)
    todo = [np.arange(len(sets))]
    while todo:
        own = todo.pop()
        label = joined.label[own]
        kinds, counts = np.unique(label, return_counts=True)
        outside = own[label != kinds[np.argmax(counts)]] if len(kinds) else own
        if not len(outside):
            continue
        postings = Postings([sets[i] for i in own])
        sizes, place = postings.sizes, {int(i): k for k, i in enumerate(own)}
        pivots = outside[: min(p.leaf_pivots, math.isqrt(len(own)))]
        distances = np.ones((len(own), len(pivots)))
        for k, i in enumerate(pivots):
            both = postings.with_own(place[int(i)])
            distances[:, k] = 1 - both / (sizes + len(sets[i]) - both)
            joined.link(int(i), own[p.linked(both, sizes, len(sets[i]))])
        rest = ~np.isin(own, pivots)
        if not rest.any() or len(pivots) == len(outside):
            continue
        cells = cells_of(distances, p.radius) & rest[:, None]
        if 2 * (cells.sum(0) ** 2).sum() > rest.sum() ** 2:
            todo.append(own[rest])
        else:
            todo += [own[cells[:, k]] for k in range(len(pivots)) if cells[:, k].sum() > 1]
    return joined.links


# --- regions over Spark -----------------------------------------------------------------

MEMBERS = "region long, node long, label long, shingles binary"


def region_links(members: DataFrame, p: JoinParams) -> DataFrame:
    """Links inside regions of at most a leaf's sets."""

    def solve(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        region, rows = None, []

        def links() -> pa.RecordBatch:
            once = {node: (label, np.frombuffer(s, np.uint64)) for node, label, s in rows}
            nodes = list(once)
            found = join_region([once[i][1] for i in nodes], [once[i][0] for i in nodes], p) if len(nodes) > 1 else []
            kinds = pa.int64()
            return pa.RecordBatch.from_pydict({"a": pa.array([nodes[i] for i, _ in found], kinds), "b": pa.array([nodes[j] for _, j in found], kinds)})

        for batch in batches:
            for r, node, label, s in zip(*[c.to_pylist() for c in batch.columns], strict=True):
                if r != region:
                    if rows:
                        yield links()
                    region, rows = r, []
                rows.append((node, label, s))
        if rows:
            yield links()

    ordered = members.select("region", "node", "label", "shingles").repartition("region").sortWithinPartitions("region", "node")
    return ordered.mapInArrow(solve, "a long, b long")


def pivot_pass(members: DataFrame, pivots: DataFrame, p: JoinParams) -> DataFrame:
    """Each set with its links to the region's pivots and the cells it falls into.

    Sets are dealt out by (region, salt); every share reads the pivots first, then streams its sets.
    """

    def measure(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, chosen, taken, postings = None, [], set(), None
        for batch in batches:
            out = []
            for region, salt, is_set, node, label, s in zip(*[c.to_pylist() for c in batch.columns], strict=True):
                if (region, salt) != at:
                    at, chosen, taken, postings = (region, salt), [], set(), None
                values = np.frombuffer(s, np.uint64)
                if not is_set:
                    chosen.append((node, values))
                    taken.add(node)
                    continue
                postings = postings or Postings([v for _, v in chosen])
                both, sizes = postings.with_other(values), postings.sizes
                distances = 1 - both / (sizes + len(values) - both)
                linked = np.flatnonzero(p.linked(both, sizes, len(values)))
                cells = np.flatnonzero(cells_of(distances[None, :], p.radius)[0])
                is_pivot = node in taken
                out.append((region, node, label, s, [chosen[k][0] for k in linked], [chosen[k][0] for k in cells], is_pivot))
            columns = list(zip(*out, strict=True)) or [[]] * 7
            many = pa.list_(pa.int64())
            kinds = [pa.int64(), pa.int64(), pa.int64(), pa.binary(), many, many, pa.bool_()]
            names = ["region", "node", "label", "shingles", "linked", "cells", "is_pivot"]
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], names)

    salt = F.pmod(F.xxhash64("node"), F.lit(p.salts)).cast("int")
    own = members.select("region", salt.alias("salt"), F.lit(1).alias("is_set"), "node", "label", "shingles")
    copies = pivots.select("region", F.explode(F.sequence(F.lit(0), F.lit(p.salts - 1))).alias("salt"), F.lit(0).alias("is_set"), "node", "label", "shingles")
    dealt = own.unionByName(copies).repartition("region", "salt").sortWithinPartitions("region", "salt", "is_set", "node")
    return dealt.mapInArrow(measure, f"{MEMBERS}, linked array<long>, cells array<long>, is_pivot boolean")


def relabel(members: DataFrame, links: DataFrame) -> DataFrame:
    roots = components(links).select("node", "root")
    return members.drop("label").join(roots, "node", "left").select(
        "region", "node", F.coalesce("root", "node").alias("label"), "shingles"
    )


def links_between(members: DataFrame, p: JoinParams) -> DataFrame:
    """Links that connect the sets of each region: ``a, b``."""
    leaves, links = [], None
    round_no = 0
    while True:
        stats = members.groupBy("region").agg(
            F.count("*").alias("n"), F.sum(F.length("shingles")).alias("bytes"), F.min("label").alias("l0"), F.max("label").alias("l1")
        ).filter("l0 <> l1")
        small = (F.col("n") <= p.leaf) & (F.col("bytes") <= p.leaf_bytes)
        stats = stats.withColumn("is_leaf", small | (F.col("n") <= 2)).select("region", "n", "bytes", "is_leaf")
        open_ones = written(members.join(stats, "region"), "regions")
        leaves.append(written(region_links(open_ones.filter("is_leaf"), p), "links"))
        large = open_ones.filter("not is_leaf")
        if large.isEmpty():
            break
        # Pivots: a hashed draw among the sets outside the largest component, about p.pivots of them.
        held = large.groupBy("region", "label").agg(F.count("*").alias("held"), F.sum(F.length("shingles")).alias("held_bytes"))
        top = held.groupBy("region").agg(F.max_by("label", F.struct("held", "label")).alias("top"))
        outside = held.join(top, "region").filter("label <> top").groupBy("region").agg(F.sum("held").alias("out"), F.sum("held_bytes").alias("out_bytes"))
        draw = F.pmod(F.xxhash64("node", F.lit(round_no)), F.lit(1 << 30)) / F.lit(float(1 << 30))
        candidates = large.join(top, "region").filter("label <> top").join(outside, "region").withColumn("draw", draw)
        share = F.least(F.lit(float(p.pivots)) / F.col("out"), F.lit(float(p.pivot_bytes)) / F.col("out_bytes"))
        # The smallest draw is a pivot in any case.
        first = candidates.groupBy("region").agg(F.min("draw").alias("least"))
        pivots = candidates.join(first, "region").filter((F.col("draw") < share) | (F.col("draw") == F.col("least")))
        measured = written(pivot_pass(large.select("region", "node", "label", "shingles"), pivots, p), "pivots")
        leaves.append(measured.select(F.col("node").alias("a"), F.explode("linked").alias("b")).filter("a <> b"))
        rest = measured.filter("not is_pivot")
        all_sets = rest.groupBy("region").agg(F.count("*").alias("n"))
        in_cells = rest.select("region", F.explode("cells").alias("cell")).groupBy("region", "cell").agg(F.count("*").cast("double").alias("c"))
        work = in_cells.groupBy("region").agg(F.sum(F.col("c") * F.col("c")).alias("work")).join(all_sets, "region")
        rest = rest.join(work.select("region", (2 * F.col("work") <= F.col("n").cast("double") * F.col("n")).alias("split")), "region")
        cells = F.when(F.col("split"), F.col("cells")).otherwise(F.array(F.lit(0).cast("long")))
        cut = rest.select("region", "split", "node", "label", "shingles", F.explode(cells).alias("cell")).select(
            F.when(F.col("split"), F.xxhash64("region", "cell")).otherwise(F.col("region")).alias("region"), "node", "label", "shingles"
        )
        links = union(leaves)
        members = written(relabel(cut, links), "cells")
        round_no += 1
    return union(leaves)


def union(frames: list[DataFrame]) -> DataFrame:
    out = frames[0]
    for f in frames[1:]:
        out = out.unionByName(f)
    return out


def jaccard_components(docs: DataFrame, p: JoinParams = JoinParams()) -> DataFrame:
    """Per row: doc_id, n_shingles and component_id, the smallest doc_id reachable by links.

    A text without words is linked with nothing; its component is its own id. A row with a null id
    has a null component, and a text that only such rows hold takes no part. Rows of one doc_id
    are told apart by their texts. Further columns are not read. An empty table gives an empty
    result.
    """
    return versions_joined(docs, p).select("doc_id", "n_shingles", "component_id")


def keep_one(docs: DataFrame, p: JoinParams = JoinParams()) -> DataFrame:
    """The table with one document of each component, that of the smallest doc_id.

    Texts without words and null ids stay. Rows of one doc_id and one text are one document.
    """
    (version,) = fresh(docs, "version")
    gone = versions_joined(docs, p).filter("doc_id <> component_id").select("doc_id", F.col("version").alias(version)).distinct()
    one = docs.withColumn(version, F.xxhash64(F.col("text").cast("string"))).dropDuplicates(["doc_id", version])
    return one.join(gone, ["doc_id", version], "left_anti").select(docs.columns)


def versions_joined(docs: DataFrame, p: JoinParams) -> DataFrame:
    """doc_id, version (a hash of the text), n_shingles, component_id of every row."""
    arrow_batches(docs.sparkSession)
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))

    def describe(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sets = shingle_sets(batch["text"].to_pylist(), p.words)
            yield pa.RecordBatch.from_pydict({
                "doc_id": batch["doc_id"],
                "version": batch["version"],
                "n_shingles": pa.array([len(s) for s in sets], pa.int64()),
                "node": pa.array([node_of(s) if len(s) else None for s in sets], pa.int64()),
            })

    hashed = rows.select("doc_id", "text", F.xxhash64("text").alias("version"))
    described = written(hashed.mapInArrow(describe, "doc_id long, version long, n_shingles long, node long"), "described")
    classes = described.filter("node is not null").groupBy("node").agg(F.min("doc_id").alias("least"))
    shingles = described.agg(F.sum("n_shingles").alias("n")).first()["n"] or 0
    regions = components(meetings(rows, p, shingles)).select("node", F.col("root").alias("region"))
    wanted = regions.join(classes, "node").select("node", "region", F.col("least").alias("doc_id"))

    def sets_of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            sets = shingle_sets(batch["text"].to_pylist(), p.words)
            for region, node, values in zip(batch["region"].to_pylist(), batch["node"].to_pylist(), sets, strict=True):
                if len(values) and node_of(values) == node:  # else another text of this id
                    out.append((region, node, node, values.tobytes()))
            columns = list(zip(*out, strict=True)) or [[]] * 4
            kinds = [pa.int64(), pa.int64(), pa.int64(), pa.binary()]
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], ["region", "node", "label", "shingles"])

    texts = rows.join(wanted, "doc_id").select("region", "node", "text")
    members = written(texts.mapInArrow(sets_of, MEMBERS), "members")
    roots = components(links_between(members, p))
    named = roots.join(classes, "node").groupBy("root").agg(F.min("least").alias("component"))
    of_node = roots.join(named, "root").select("node", "component")
    final = classes.join(of_node, "node", "left").select("node", F.coalesce("component", "least").alias("component"))
    placed = described.join(final, "node", "left")
    return placed.select(
        "doc_id", "version", "n_shingles", F.when(F.col("doc_id").isNotNull(), F.coalesce("component", "doc_id")).alias("component_id")
    )
