"""Exact top-k search by inner product with KD-trees, one a shard.

Equal vectors are one point, which keeps its k + 1 smallest ids: a larger one is never among the
first k, whoever asks. Median splits of a bounded sample cut space into cells, and a cell of many
points into parts by hash; each part is a shard of bounded size with a KD-tree of its own, split at
the median of the widest dimension, with tight bounding boxes.

A tree is searched best first: of the nodes seen so far the one whose box has the greatest bound of
the inner product comes next, until that bound is below the kth score. Queries start in the cell of
the greatest bound; the kth score found there goes with them to the other cells and shards, which are
left out, whole or in part, where their bound is below it. Nothing else is left out, so the result is
exact, ties included, and the same for any sample.

Vectors are integers: ``floor(scale * x)``. Sums that fit 53 bits are taken in doubles, others in
64-bit or in Python's integers; scores beyond a long are cut to its limits before they are compared.

Defined results: rows with a null id, and vectors that are null or hold null, NaN or infinite
components, take no part. Vectors meet those of equal length only. Repeated rows are candidates of
their own; of the rows equal to a query in id and vector one is the query's own. Ties go to the
smaller id. An empty table gives an empty result. Further columns are not looked at.
"""

from __future__ import annotations

import heapq
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType

from axonframe.functions.scan import lookup
from axonframe.llm.common import arrow_batches, written

LONG = np.iinfo(np.int64)
SHARD = ["dims", "cell", "part"]
FOUND = "code binary, score long, vec_id long, own boolean"


@dataclass(frozen=True)
class SearchParams:
    """``shard`` and ``block`` bound the points and the queries that a task holds at a time; ``sample``
    bounds the points that the driver takes the cells from, ``cells`` their number."""

    k: int = 10
    scale: int = 1024
    shard: int = 16_384
    block: int = 4_096
    leaf: int = 128
    sample: int = 20_000
    cells: int = 1_024


# --- integer vectors --------------------------------------------------------------------------


def quantised(x: np.ndarray, scale: int) -> np.ndarray:
    """``floor(scale * x)`` as 64-bit integers, or as Python's where those are too short."""
    scaled = np.floor(x * scale)
    if not len(x) or np.abs(scaled).max() < 2.0**62:
        return scaled.astype("int64")
    return np.array([int(np.floor(v * scale)) if abs(v) < 2.0**52 else int(v) * scale for v in x], dtype=object)


def encode(m: np.ndarray) -> bytes:
    """The shortest of 16, 32 and 64 bits that holds all numbers, else decimals; equal arrays have equal codes."""
    if m.dtype != object:
        top = max((int(m.max()), -int(m.min()) - 1)) if m.size else 0
        bits = next(b for b in (16, 32, 64) if top < 1 << (b - 1))
        return bytes([bits // 8]) + np.ascontiguousarray(m, f"<i{bits // 8}").tobytes()
    return b"\x00" + ",".join(map(str, m.ravel())).encode()


def decode(code: bytes) -> np.ndarray:
    if code[0]:
        return np.frombuffer(code, f"<i{code[0]}", offset=1).astype("int64")
    return np.array([int(v) for v in code[1:].split(b",")], dtype=object)


def stacked(codes: list[bytes], dims: int) -> np.ndarray:
    rows = [decode(c) for c in codes]
    out = np.empty((len(rows), dims), object if any(r.dtype == object for r in rows) else "int64")
    for i, row in enumerate(rows):
        out[i] = row
    return out


def safe(a: np.ndarray, b: np.ndarray) -> type | str:
    """A type in which inner products of rows of ``a`` and ``b`` are exact."""
    if not a.size or not b.size:
        return "int64"
    top = a.shape[-1] * max(int(a.max()), -int(a.min())) * max(int(b.max()), -int(b.min()))
    return "float64" if top < 1 << 53 else "int64" if top < 1 << 62 else object


# --- trees ------------------------------------------------------------------------------------


@dataclass
class Tree:
    """Nodes in preorder: ``kids`` (0 for leaves), the points ``start`` to ``end``, and tight boxes."""

    points: np.ndarray
    order: np.ndarray
    kids: np.ndarray
    span: np.ndarray
    low: np.ndarray
    high: np.ndarray


def grow(points: np.ndarray, leaf: int) -> Tree:
    """Splits at the median of the widest dimension down to ``leaf`` points; equal points do not occur."""
    order, kids, span, low, high = np.arange(len(points)), [], [], [], []
    todo = [(0, len(points), None)]
    while todo:
        start, end, parent = todo.pop()
        here = len(kids)
        if parent is not None:
            kids[parent[0]][parent[1]] = here
        own = points[order[start:end]]
        low.append(own.min(axis=0))
        high.append(own.max(axis=0))
        kids.append([0, 0])
        span.append([start, end])
        if end - start <= leaf or not own.shape[1]:
            continue
        wide = int(np.argmax(high[-1] - low[-1]))
        middle = (end - start) // 2
        order[start:end] = order[start:end][np.argsort(own[:, wide], kind="stable")]
        todo.append((start + middle, end, (here, 1)))
        todo.append((start, start + middle, (here, 0)))
    return Tree(points[order], order, np.array(kids), np.array(span), np.array(low), np.array(high))


def bounds(queries: np.ndarray, low: np.ndarray, high: np.ndarray) -> np.ndarray:
    """The greatest inner product of each query with any point of each box."""
    kind = safe(queries, np.maximum(np.abs(low), np.abs(high)))
    q, lo, hi = (x.astype(kind) for x in (queries, low, high))
    zero = np.zeros_like(q)
    return within_long(np.maximum(q, zero) @ hi.T + np.minimum(q, zero) @ lo.T)


def within_long(scores: np.ndarray) -> np.ndarray:
    """Python's integers cut at the limits of a long; the other types hold no larger ones."""
    return np.minimum(np.maximum(scores, LONG.min), LONG.max) if scores.dtype == object else scores


def best_first(tree: Tree, queries: np.ndarray, floor: list[int | None], ids: list[list[int]], most: int) -> Iterator[list[tuple[int, int, int]]]:
    """For each query the ``most`` best of the tree as (score, -id, point), of those not below ``floor``."""
    bound = bounds(queries, tree.low, tree.high)
    kind = safe(queries, tree.points)
    q, points = queries.astype(kind), tree.points.astype(kind)
    for row in range(len(q)):
        of_node, best, kth = bound[row], [], floor[row]
        open_nodes = [(-of_node[0], 0)]
        while open_nodes:
            least, node = heapq.heappop(open_nodes)
            if kth is not None and -least < kth:
                break
            left, right = tree.kids[node]
            if left:
                heapq.heappush(open_nodes, (-of_node[left], left))
                heapq.heappush(open_nodes, (-of_node[right], right))
                continue
            start, end = tree.span[node]
            scores = within_long(points[start:end] @ q[row])
            for at in range(end - start) if kth is None else np.flatnonzero(scores >= kth):
                score, point = int(scores[at]), int(start + at)
                for vec_id in ids[tree.order[point]]:
                    entry = (score, -vec_id, point)
                    if len(best) < most:
                        heapq.heappush(best, entry)
                    elif entry > best[0]:
                        heapq.heapreplace(best, entry)
                    else:
                        break
            if len(best) == most and (kth is None or best[0][0] > kth):
                kth = best[0][0]
        yield best


# --- cells ------------------------------------------------------------------------------------


@dataclass
class Cells:
    """Cells by median splits, for each length of vector; ``boxes`` only where there are several."""

    trees: dict[int, list]
    boxes: dict[int, tuple[np.ndarray, np.ndarray, np.ndarray]]

    def of(self, points: np.ndarray) -> np.ndarray:
        out = np.zeros(len(points), int)
        todo = [(0, np.arange(len(points)))]
        tree = self.trees.get(points.shape[1], [0])
        while todo:
            node, rows = todo.pop()
            if not isinstance(tree[node], tuple):
                out[rows] = tree[node]
                continue
            dim, cut, left, right = tree[node]
            below = points[rows, dim] < cut
            todo += [(left, rows[below]), (right, rows[~below])]
        return out


def cut_space(sample: list[bytes], dims: list[int], cells: int) -> Cells:
    trees = {}
    for length in sorted(set(dims)):
        points = stacked([c for c, d in zip(sample, dims) if d == length], length)
        most = max(1, cells * len(points) // len(sample))
        nodes: list = [None]
        # Widest part of the sample first; a part that cannot be split stays a cell.
        heap, number, parts = [(-len(points), 0, np.arange(len(points)))], 0, 1
        while heap:
            size, node, rows = heapq.heappop(heap)
            own = points[rows]
            wide = int(np.argmax(own.max(axis=0) - own.min(axis=0))) if length and len(own) else 0
            cut = np.sort(own[:, wide])[len(own) // 2] if length and len(own) > 1 else None
            below = own[:, wide] < cut if cut is not None else None
            if parts >= most or below is None or not below.any():
                nodes[node] = number
                number += 1
                continue
            left = len(nodes)
            nodes += [None, None]
            nodes[node] = (wide, cut, left, left + 1)
            heapq.heappush(heap, (-int(below.sum()), left, rows[below]))
            heapq.heappush(heap, (-int((~below).sum()), left + 1, rows[~below]))
            parts += 1
        trees[length] = nodes
    return Cells(trees, {})


# --- tables -----------------------------------------------------------------------------------


def coded(rows: DataFrame, key: str, vector: str, scale: int) -> DataFrame:
    """``vec_id, dims, code`` of the rows that take part."""
    schema = to_arrow_schema(StructType.fromDDL("vec_id long, dims int, code binary"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, vectors, out = batch.column(0).to_pylist(), batch.column(1), []
            for vec_id, x in zip(ids, vectors):
                x = x.values.cast(pa.float64()).to_numpy(zero_copy_only=False)
                if np.isfinite(x).all():
                    out.append((vec_id, len(x), encode(quantised(x, scale))))
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*out) if out else ([], [], []), schema)], schema=schema)

    there = rows.select(F.col(key).cast("long").alias("vec_id"), F.col(vector).cast("array<double>").alias("x")).filter("vec_id IS NOT NULL AND x IS NOT NULL")
    return there.mapInArrow(run, "vec_id long, dims int, code binary")


@dataclass
class Index:
    """``shards(dims, cell, part, n, codes, ids, tree)`` and the cells' boxes."""

    shards: DataFrame
    cells: Cells
    params: SearchParams


def build_index(vectors: DataFrame, params: SearchParams) -> Index:
    """``vectors(vec_id, dims, code)``, written. Every point is in one shard."""
    copies = Window.partitionBy("dims", "code").orderBy("vec_id")
    few = vectors.withColumn("_nth", F.row_number().over(copies)).filter(F.col("_nth") <= params.k + 1)
    points = written(few.groupBy("dims", "code").agg(F.sort_array(F.collect_list("vec_id")).alias("ids")), "points")
    n = points.count()
    share = min(1.0, params.sample / max(n, 1))
    drawn = points.filter(F.pmod(F.xxhash64("code"), F.lit(1 << 20)) < int(share * (1 << 20))).select("dims", "code").collect()
    cells = cut_space([bytes(r["code"]) for r in drawn], [r["dims"] for r in drawn], min(params.cells, -(-n // params.shard)))

    def seat(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            codes, dims = batch["code"].to_pylist(), batch["dims"].to_numpy()
            cell = np.zeros(len(codes), "int32")
            for length in np.unique(dims):
                rows = np.flatnonzero(dims == length)
                if len(cells.trees.get(int(length), [0])) > 1:
                    cell[rows] = cells.of(stacked([codes[i] for i in rows], int(length)))
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(cell)], names=[*batch.schema.names, "cell"])

    seated = points.mapInArrow(seat, "dims int, code binary, ids array<long>, cell int")
    sizes = seated.groupBy("dims", "cell").agg(F.ceil(F.count("*") / params.shard).cast("int").alias("parts"))
    dealt = seated.join(sizes, ["dims", "cell"]).withColumn("part", F.pmod(F.xxhash64("code"), F.col("parts")).cast("int"))
    ddl = "dims int, cell int, part int, codes array<binary>, ids array<array<long>>, tree binary, low binary, high binary"
    schema = to_arrow_schema(StructType.fromDDL(ddl))

    def plant(key: tuple, table: pa.Table) -> pa.Table:
        dims = key[0].as_py()
        codes = table["code"].to_pylist()
        tree = grow(stacked(codes, dims), params.leaf)
        layout = np.concatenate([tree.order, tree.kids.ravel(), tree.span.ravel()]).astype("<i4").tobytes()
        row = [*(k.as_py() for k in key), [codes[i] for i in tree.order], table["ids"].to_pylist(), layout, encode(tree.low), encode(tree.high)]
        return pa.table([pa.array([x], f.type) for x, f in zip(row, schema)], schema=schema)

    shards = written(dealt.select(*SHARD, "code", "ids").groupBy(*SHARD).applyInArrow(plant, ddl), "shards")
    several = [d for d, nodes in cells.trees.items() if len(nodes) > 1]
    boxes: dict[int, dict[int, list]] = {d: {} for d in several}
    if several:
        # At most ``cells`` boxes, folded in Spark; a cell of many batches comes in a few pieces.
        for r in _cell_boxes(shards.filter(F.col("dims").isin(several))).collect():
            box, seen = [decode(bytes(r["low"])), decode(bytes(r["high"]))], boxes[r["dims"]].get(r["cell"])
            boxes[r["dims"]][r["cell"]] = [np.minimum(box[0], seen[0]), np.maximum(box[1], seen[1])] if seen else box
    for d, of_cell in boxes.items():
        names = sorted(of_cell)
        cells.boxes[d] = (np.array(names), np.array([of_cell[c][0] for c in names]), np.array([of_cell[c][1] for c in names]))
    return Index(shards, cells, params)


def _cell_boxes(shards: DataFrame) -> DataFrame:
    """``dims, cell, low, high``: the shards' root boxes joined per cell, one at a time."""
    ddl = "dims int, cell int, low binary, high binary"
    schema = to_arrow_schema(StructType.fromDDL(ddl))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            boxes: dict[tuple, list] = {}
            for dims, cell, low, high in zip(*(c.to_pylist() for c in batch.columns)):
                lo, hi = decode(low)[:dims], decode(high)[:dims]
                if (dims, cell) in boxes:
                    lo, hi = np.minimum(lo, boxes[dims, cell][0]), np.maximum(hi, boxes[dims, cell][1])
                boxes[dims, cell] = [lo, hi]
            rows = [(d, c, encode(lo), encode(hi)) for (d, c), (lo, hi) in boxes.items()]
            yield pa.RecordBatch.from_arrays([pa.array(x, f.type) for x, f in zip(zip(*rows) if rows else ([],) * 4, schema)], schema=schema)

    once = shards.select("dims", "cell", "low", "high").mapInArrow(run, ddl)
    return once.repartition("dims", "cell").sortWithinPartitions("dims", "cell").mapInArrow(run, ddl)


def _routes(queries: DataFrame, index: Index, first: bool) -> DataFrame:
    """``dims, code, kth, cell``: the cell of the greatest bound, or all whose bound is not below kth."""
    ddl = "dims int, code binary, kth long, cell int"
    schema = to_arrow_schema(StructType.fromDDL(ddl))
    boxes = index.cells.boxes

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            dims, codes, kths = batch["dims"].to_numpy(), batch["code"].to_pylist(), batch["kth"].to_pylist()
            out = []
            for length in np.unique(dims):
                rows = np.flatnonzero(dims == length)
                if int(length) not in boxes:
                    out += [(int(length), codes[i], kths[i], 0) for i in rows]
                    continue
                names, low, high = boxes[int(length)]
                bound = bounds(stacked([codes[i] for i in rows], int(length)), low, high)
                for i, b in zip(rows, bound):
                    kth = kths[i]
                    chosen = [np.argmax(b)] if first else range(len(names)) if kth is None else np.flatnonzero(b >= kth)
                    out += [(int(length), codes[i], kth, int(names[c])) for c in chosen]
            yield pa.RecordBatch.from_arrays([pa.array(x, f.type) for x, f in zip(zip(*out) if out else ([],) * 4, schema)], schema=schema)

    return queries.select("dims", "code", "kth").mapInArrow(run, ddl)


def _search(routes: DataFrame, index: Index) -> DataFrame:
    """``code, score, vec_id, own`` for routes(dims, cell, part, code, kth): the best of each shard.

    The queries of a shard come in blocks; a task holds one tree and one block.
    """
    params = index.params
    schema = to_arrow_schema(StructType.fromDDL(FOUND))

    def run(shard: pa.Table, asked: pa.Table) -> pa.Table:
        if not shard.num_rows or not asked.num_rows:
            return schema.empty_table()
        row = {c: shard[c][0].as_py() for c in ("dims", "codes", "ids", "tree", "low", "high")}
        dims, n = row["dims"], len(row["codes"])
        layout = np.frombuffer(row["tree"], "<i4")
        kids, span = np.split(layout[n:].reshape(-1, 2), 2)
        tree = Tree(stacked(row["codes"], dims), layout[:n], kids, span, decode(row["low"]).reshape(len(kids), dims), decode(row["high"]).reshape(len(kids), dims))
        codes = asked["code"].to_pylist()
        out = []
        for code, best in zip(codes, best_first(tree, stacked(codes, dims), asked["kth"].to_pylist(), row["ids"], params.k + 1)):
            out += [(code, score, -minus, row["codes"][point] == code) for score, minus, point in best]
        return pa.table([pa.array(x, f.type) for x, f in zip(zip(*out) if out else ([],) * 4, schema)], schema=schema)

    loads = routes.groupBy(*SHARD).agg(F.ceil(F.count("*") / params.block).cast("int").alias("blocks"))
    block = F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("block")
    trees = index.shards.join(loads, SHARD).select(*index.shards.columns, block)
    asked = routes.join(loads, SHARD).withColumn("block", F.pmod(F.xxhash64("code"), F.col("blocks")).cast("int"))
    asked = asked.select(*SHARD, "block", "code", "kth")
    return trees.groupBy(*SHARD, "block").cogroup(asked.groupBy(*SHARD, "block")).applyInArrow(run, FOUND)


def _best(found: DataFrame, most: int) -> DataFrame:
    ranked = found.withColumn("_nth", F.row_number().over(Window.partitionBy("code").orderBy(F.desc("score"), "vec_id")))
    return ranked.filter(F.col("_nth") <= most)


def search(index: Index, queries: DataFrame) -> DataFrame:
    """``code, best``: for each distinct ``queries(dims, code)`` the k + 1 best points, in order."""
    most = index.params.k + 1
    asked = queries.select("dims", "code").distinct()
    names = index.shards.select(*SHARD)
    start = _routes(asked.withColumn("kth", F.lit(None).cast("long")), index, True).withColumn("part", F.lit(0))
    seeded = written(_search(start, index), "seeded")
    kth = _best(seeded, most).groupBy("code").agg(F.when(F.count("*") == most, F.min("score")).alias("kth"))
    known = written(start.drop("kth").join(kth, "code", "left").withColumnRenamed("cell", "seen"), "kth")
    rest = _routes(known, index, False).join(known.select("code", "seen"), "code").join(names, ["dims", "cell"])
    rest = written(rest.filter("NOT (cell = seen AND part = 0)").drop("seen"), "routes")
    found = _best(seeded.union(_search(rest, index)), most)
    entry = F.struct("_nth", "score", "vec_id", "own")
    return found.groupBy("code").agg(F.sort_array(F.collect_list(entry)).alias("best"))


def exact_top_k(rows: DataFrame, is_query: Column, key: str = "vec_id", vector: str = "embedding", params: SearchParams = SearchParams()) -> DataFrame:
    """``query_id, rank, vec_id, score``: the k best other rows for each row that ``is_query`` marks.

    ``is_query`` is a condition on ``vec_id``, the key as a long.
    """
    arrow_batches(rows.sparkSession)
    vectors = written(coded(rows, key, vector, params.scale), "vectors")
    index = build_index(vectors, params)
    asked = vectors.filter(is_query).select(F.col("vec_id").alias("query_id"), "dims", "code")
    found = lookup(asked, search(index, asked), ["code"], spread=True)
    own = F.array_position(F.transform("best", lambda x: x["own"] & (x["vec_id"] == F.col("query_id"))), True)
    others = found.withColumn("_own", own).withColumn("best", F.filter("best", lambda x, i: i + 1 != F.col("_own")))
    each = others.select("query_id", F.posexplode(F.slice("best", 1, params.k)).alias("rank", "_x"))
    return each.select("query_id", (F.col("rank") + 1).cast("int").alias("rank"), "_x.vec_id", "_x.score")
