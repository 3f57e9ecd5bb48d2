"""The trie of conversation prefixes, with a count-min sketch that keeps lone tails out of the shuffle.

A node is a distinct sequence of first turns; its digest is the exclusive or of two 64-bit hashes of
(depth, turn) over the turns, so the digest of the parent is the node's own without its last turn,
and long conversations are digested in chunks.

A count-min sketch of all prefix digests is made first; it never counts too low. Where it says one, the
prefix has one member: such a node is complete as it stands and is given out by the task that reads
it. Only prefixes that it cannot clear are shuffled and grouped exactly, so the result does not
depend on the sketch, and its size is bounded: where it is too small for a corpus it clears less.
Counters end at two, which is all that the question asks.

Subtree totals take no loop over depths. A node lies on the way of its smallest member; what it adds
to its ancestors (tokens saved, one if it is a leaf) is put there, summed from below along each
conversation, and grouped over the members of each node.

Defined results: null roles and texts are empty, null turns come first, equal turns are ordered by
their digest, repeated turns count as turns. Rows with a null ``conv_id`` belong to no conversation.
An empty table has no nodes. Further columns are not looked at. Digests have 128 bits; different
prefixes are taken to differ in them.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType

from axonframe.functions.scan import lookup
from axonframe.llm.common import arrow_batches, ranked, whole_text, written

WORDS = r"[^\x20\x09-\x0D]+"
#: Turns of a conversation that one window holds.
CHUNK = 4096
#: The sketch: rows of counters, cells of a row at most, cells of a block that travels alone.
LANES, CELLS_MOST, BLOCK = 2, 1 << 26, 1 << 16
#: Characters of one piece of a list of ids.
PIECE = 1 << 16
NODE = ["depth", "p1", "p2"]


def shared_turns(conv_id: str = "conv_id") -> Column:
    """How many turns a conversation takes from the first of its block of 20."""
    return (F.crc32(F.col(conv_id).cast("string").cast("binary")) % 4).cast("int")


def numbered_turns(conversations: DataFrame) -> DataFrame:
    """``conv_id, rank, n, turn_hash, words``: digests in place of texts, turns numbered from 0."""
    role, text = whole_text(F.col("role").cast("string")), whole_text(F.col("text").cast("string"))
    rows = conversations.filter("conv_id IS NOT NULL").select(
        F.col("conv_id").cast("long").alias("conv_id"),
        "turn",
        F.unhex(F.md5(F.concat(F.octet_length(role).cast("string"), F.lit(":"), role, text))).alias("turn_hash"),
        F.regexp_count(text, F.lit(WORDS)).cast("long").alias("words"),
    )
    return ranked(rows, "conv_id", ["turn", "turn_hash"]).drop("turn")


def rebuilt(conversations: DataFrame, block: int = 20, most: int = 3) -> tuple[DataFrame, DataFrame]:
    """``turns(conv_id, depth, length, turn_hash, words)`` and ``sizes(conv_id, length)``.

    The first turns of each conversation are those of the first of its block, then its own follow.
    """
    turns = written(numbered_turns(conversations), "turns")
    head = F.sort_array(F.collect_list(F.struct("rank", "turn_hash", "words")))
    heads = turns.filter((F.col("conv_id") % block == 0) & (F.col("rank") < most)).groupBy(F.col("conv_id").alias("base")).agg(head.alias("head"))
    convs = turns.filter("rank = 0").select("conv_id", "n", (F.col("conv_id") - F.col("conv_id") % block).alias("base"), shared_turns().alias("h"))
    given = F.when(F.col("head").isNotNull(), F.slice("head", 1, F.col("h"))).otherwise(F.slice("head", 1, 0))
    convs = convs.join(heads, "base", "left").withColumn("head", F.coalesce(given, F.array().cast(heads.schema["head"].dataType)))
    convs = convs.withColumn("length", (F.size("head") + F.greatest(F.col("n") - F.col("h"), F.lit(0))).cast("long"))
    convs = written(convs.select("conv_id", "head", "h", "length"), "sizes")
    first = convs.select("conv_id", "length", F.posexplode("head").alias("at", "x"))
    first = first.select("conv_id", (F.col("at") + 1).cast("long").alias("depth"), "length", "x.turn_hash", "x.words")
    own = turns.filter(F.col("rank") >= shared_turns()).join(convs.select("conv_id", "length", (F.size("head") - F.col("h")).alias("shift")), "conv_id")
    own = own.select("conv_id", (F.col("rank") + F.col("shift") + 1).alias("depth"), "length", "turn_hash", "words")
    return first.union(own), convs.select("conv_id", "length")


def _along(rows: DataFrame, order: Column, chunk: Column, sums: dict[str, Column], within: str) -> DataFrame:
    """Adds running aggregates of a conversation in ``order``, inclusive of equals.

    Windows hold one chunk; what earlier chunks come to is one row a chunk. ``sums`` are the
    aggregates' inputs, ``within`` is ``bit_xor`` or ``sum``.
    """
    agg = getattr(F, within)
    rows = rows.withColumn("_chunk", chunk)
    here = Window.partitionBy("conv_id", "_chunk").orderBy(order).rangeBetween(Window.unboundedPreceding, Window.currentRow)
    earlier = Window.partitionBy("conv_id").orderBy("_chunk").rowsBetween(Window.unboundedPreceding, -1)
    several = F.max("_chunk").over(Window.partitionBy("conv_id")) != F.min("_chunk").over(Window.partitionBy("conv_id"))
    totals = rows.groupBy("conv_id", "_chunk").agg(*[agg(c).alias(f"_{n}") for n, c in sums.items()])
    before = totals.withColumn("_several", several).filter("_several").select("conv_id", "_chunk", *[agg(f"_{n}").over(earlier).alias(f"_b_{n}") for n in sums])
    out = rows.select("*", *[agg(c).over(here).alias(n) for n, c in sums.items()]).join(before, ["conv_id", "_chunk"], "left")
    join = (lambda a, b: a.bitwiseXOR(b)) if within == "bit_xor" else (lambda a, b: a + b)
    done = {n: join(F.col(n), F.coalesce(F.col(f"_b_{n}"), F.lit(0).cast("long"))) for n in sums}
    return out.withColumns(done).drop("_chunk", *[f"_b_{n}" for n in sums])


def prefixes(turns: DataFrame) -> DataFrame:
    """Adds to ``turns`` the digest of the prefix ``p1, p2`` and that of its parent ``q1, q2``."""
    hashed = turns.withColumns({"z1": F.xxhash64("depth", "turn_hash"), "z2": F.xxhash64("turn_hash", F.lit("second"), "depth")}).drop("turn_hash")
    chunk = F.expr(f"(depth - 1) div {CHUNK}")
    digested = _along(hashed, F.col("depth"), chunk, {"p1": F.col("z1"), "p2": F.col("z2")}, "bit_xor")
    return digested.withColumns({"q1": F.col("p1").bitwiseXOR(F.col("z1")), "q2": F.col("p2").bitwiseXOR(F.col("z2"))}).drop("z1", "z2")


# --- the sketch -------------------------------------------------------------------------------


def cells_of(p1: np.ndarray, p2: np.ndarray, cells: int) -> list[np.ndarray]:
    """A cell in each row of counters; ``cells`` is a power of two."""
    mask = np.uint64(cells - 1)
    return [(p.view("u8") >> np.uint64(7)) & mask for p in (p1, p2)]


def counted(cells: np.ndarray, size: int) -> np.ndarray:
    """Counters that end at two."""
    return np.minimum(np.bincount(cells.astype("i8"), minlength=size), 2).astype("u1")


def packed(counters: np.ndarray) -> bytes:
    return np.packbits(counters >= 1).tobytes() + np.packbits(counters == 2).tobytes()


def unpacked(block: bytes) -> np.ndarray:
    once, twice = np.split(np.unpackbits(np.frombuffer(block, "u1")), 2)
    return once + twice


def sketch(rows: DataFrame, cells: int) -> np.ndarray:
    """``LANES x cells`` counters of the digests ``p1, p2``; at most 2 bits a cell come to the driver."""
    ddl = "lane int, block int, counters binary"
    schema = to_arrow_schema(StructType.fromDDL(ddl))
    size = min(BLOCK, cells)

    def rows_of(held: dict[tuple[int, int], np.ndarray]) -> pa.RecordBatch:
        lanes, blocks = [k[0] for k in held], [k[1] for k in held]
        return pa.RecordBatch.from_arrays([pa.array(x, f.type) for x, f in zip((lanes, blocks, [packed(v) for v in held.values()]), schema)], schema=schema)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[tuple[int, int], np.ndarray] = {}
        for batch in batches:
            for lane, found in enumerate(cells_of(batch["p1"].to_numpy(), batch["p2"].to_numpy(), cells)):
                found = np.sort(found)
                for part in np.split(found, np.flatnonzero(np.diff(found // size)) + 1) if len(found) else []:
                    key = (lane, int(part[0]) // size)
                    new = counted(part % size, size)
                    held[key] = np.minimum(held[key] + new, 2) if key in held else new
        for key, counters in held.items():
            yield rows_of({key: counters})

    def merge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, total = None, None
        for batch in batches:
            for lane, block, counters in zip(*(c.to_pylist() for c in batch.columns)):
                if (lane, block) != key:
                    if key is not None:
                        yield rows_of({key: total})
                    key, total = (lane, block), unpacked(counters)
                else:
                    total = np.minimum(total + unpacked(counters), 2)
        if key is not None:
            yield rows_of({key: total})

    parts = rows.select("p1", "p2").mapInArrow(count, ddl).repartition("lane", "block").sortWithinPartitions("lane", "block")
    out = np.zeros((LANES, cells), "u1")
    for r in parts.mapInArrow(merge, ddl).toLocalIterator():
        out[r["lane"], r["block"] * size : (r["block"] + 1) * size] = unpacked(bytes(r["counters"]))
    return out


def screened(rows: DataFrame, counters: np.ndarray) -> DataFrame:
    """Adds ``alone`` and ``above_alone``: the sketch proves that the prefix, or its parent, has one member."""
    cells = counters.shape[1]
    shipped = rows.sparkSession.sparkContext.broadcast(np.packbits(counters == 1, axis=1))
    out = StructType(rows.schema.fields + StructType.fromDDL("alone boolean, above_alone boolean").fields)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ones = shipped.value

        def one(p1: np.ndarray, p2: np.ndarray) -> np.ndarray:
            found = np.zeros(len(p1), bool)
            for lane, at in enumerate(cells_of(p1, p2, cells)):
                found |= (ones[lane, at >> np.uint64(3)] >> (7 - (at & np.uint64(7))).astype("u1")) & 1 == 1
            return found

        for batch in batches:
            p1, p2, q1, q2, depth = (batch[c].to_numpy() for c in ("p1", "p2", "q1", "q2", "depth"))
            above = one(q1, q2) & (depth > 1)
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(one(p1, p2)), pa.array(above)], names=[*batch.schema.names, "alone", "above_alone"])

    return rows.mapInArrow(run, out)


# --- nodes ------------------------------------------------------------------------------------


def joined_ids(rows: DataFrame) -> DataFrame:
    """``depth, p1, p2, ends_sha256``: the ids of each node, ascending and joined by commas, hashed.

    Ranges of (node, id) make pieces of text in many tasks; the pieces of one node then stream
    through one hash, a piece at a time.
    """
    ddl = "depth long, p1 long, p2 long, range int, at int, piece string"
    schema = to_arrow_schema(StructType.fromDDL(ddl))

    def pieces(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, held, size, at, place = None, [], 0, 0, -1

        def row() -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array([x], f.type) for x, f in zip((*key, place, at, ",".join(held)), schema)], schema=schema)

        out = []
        for batch in batches:
            for depth, p1, p2, conv_id, here in zip(*(c.to_pylist() for c in batch.columns)):
                if (depth, p1, p2) != key or size >= PIECE:
                    if held:
                        out.append(row())
                    at = at + 1 if (depth, p1, p2) == key else 0
                    key, held, size, place = (depth, p1, p2), [], 0, here
                held.append(str(conv_id))
                size += len(held[-1])
            if out:
                yield from pa.Table.from_batches(out).combine_chunks().to_batches()
                out = []
        if held:
            yield row()

    result = "depth long, p1 long, p2 long, ends_sha256 string"
    result_schema = to_arrow_schema(StructType.fromDDL(result))

    def digests(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, state = None, None
        for batch in batches:
            out = []
            for depth, p1, p2, _, _, piece in zip(*(c.to_pylist() for c in batch.columns)):
                if (depth, p1, p2) == key:
                    state.update(b"," + piece.encode())
                    continue
                if key:
                    out.append((*key, state.hexdigest()))
                key, state = (depth, p1, p2), hashlib.sha256(piece.encode())
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(x, f.type) for x, f in zip(zip(*out), result_schema)], schema=result_schema)
        if key:
            yield pa.RecordBatch.from_arrays([pa.array([x], f.type) for x, f in zip((*key, state.hexdigest()), result_schema)], schema=result_schema)

    keys = ["p1", "p2", "depth", "conv_id"]
    dealt = rows.select(*NODE, "conv_id").repartitionByRange(*keys).sortWithinPartitions(*keys).withColumn("_range", F.spark_partition_id())
    parts = dealt.mapInArrow(pieces, ddl).repartition("p1", "p2", "depth").sortWithinPartitions("p1", "p2", "depth", "range", "at")
    return parts.mapInArrow(digests, result)


def prefix_trie(conversations: DataFrame) -> DataFrame:
    """A row a node: ``conv_id, depth, parent_conv_id, n_convs, n_children, n_leaves, saved_tokens, ends_sha256``."""
    spark = conversations.sparkSession
    arrow_batches(spark)
    turns, sizes = rebuilt(conversations)
    turns = written(turns, "rebuilt")
    digested = written(prefixes(turns), "prefixes")
    n = digested.count()
    counters = sketch(digested, min(CELLS_MOST, max(1 << 10, 1 << (2 * n - 1).bit_length() if n else 0)))
    rows = written(screened(digested, counters), "screened")

    zero = F.lit(0).cast("long")
    members = rows.filter("NOT alone").drop("alone", "above_alone")
    root = sizes.select("conv_id", zero.alias("depth"), "length", zero.alias("words"), *[zero.alias(c) for c in ("p1", "p2", "q1", "q2")])
    members = members.select(*root.columns).union(root)
    shared = members.groupBy(*NODE).agg(
        F.min("conv_id").alias("conv_id"), F.count("*").alias("n_convs"), F.max("words").alias("words"), F.max("q1").alias("q1"), F.max("q2").alias("q2"),
    )
    shared = written(shared, "shared")

    # Children of the shared nodes: shared ones, and the first nodes of lone tails.
    lone = rows.filter("alone")
    above = [(F.col("depth") - 1).alias("_d"), F.col("q1").alias("_q1"), F.col("q2").alias("_q2")]
    children = shared.filter("depth > 0").select("conv_id", "depth", *above).union(lone.filter("NOT above_alone").select("conv_id", "depth", *above))
    parents = shared.select(F.col("depth").alias("_d"), F.col("p1").alias("_q1"), F.col("p2").alias("_q2"), F.col("conv_id").alias("parent_conv_id"))
    placed = lookup(children, parents, ["_d", "_q1", "_q2"], spread=True).select("conv_id", "depth", "parent_conv_id")
    # A shared node below a lone one (that the sketch did not clear) has that conversation as parent.
    placed = written(placed, "placed")
    fan = placed.groupBy(F.col("parent_conv_id").alias("conv_id"), (F.col("depth") - 1).alias("depth")).agg(F.count("*").alias("n_children"))
    known = shared.join(fan, ["conv_id", "depth"], "left").withColumn("n_children", F.coalesce("n_children", zero))
    known = written(known, "known")

    leaf_here = (F.col("n_children") == 0).cast("long").alias("leaf")
    added = known.select("conv_id", "depth", ((F.col("n_convs") - 1) * F.col("words")).alias("saved"), leaf_here, *[F.lit(None).cast("long").alias(c) for c in ("p1", "p2")])
    tails = lone.filter("depth = length").select("conv_id", "depth", zero.alias("saved"), F.lit(1).cast("long").alias("leaf"), *[F.lit(None).cast("long").alias(c) for c in ("p1", "p2")])
    ways = members.select("conv_id", "depth", zero.alias("saved"), zero.alias("leaf"), "p1", "p2").union(added.filter("saved > 0 OR leaf > 0")).union(tails)
    below = _along(ways, -F.col("depth"), F.expr(f"-(depth div {CHUNK})"), {"saved_tokens": F.col("saved"), "n_leaves": F.col("leaf")}, "sum")
    below = below.filter("p1 IS NOT NULL AND (saved_tokens > 0 OR n_leaves > 0)")
    totals = below.groupBy(*NODE).agg(F.sum("saved_tokens").alias("saved_tokens"), F.sum("n_leaves").alias("n_leaves"))

    ends = joined_ids(members.filter("depth = length"))
    nodes = known.join(totals, NODE, "left").join(ends, NODE, "left").join(placed, ["conv_id", "depth"], "left")
    # The parent of a shared node that is not among the shared ones is a lone prefix of the same conversation.
    parent = F.when(F.col("depth") > 0, F.coalesce("parent_conv_id", "conv_id"))
    empty = F.sha2(F.lit(""), 256)
    out = nodes.select(
        "conv_id", "depth", parent.alias("parent_conv_id"), "n_convs", "n_children",
        F.coalesce("n_leaves", zero).alias("n_leaves"), F.coalesce("saved_tokens", zero).alias("saved_tokens"), F.coalesce("ends_sha256", empty).alias("ends_sha256"),
    )
    first = lone.join(placed, ["conv_id", "depth"], "left")
    last = F.col("depth") == F.col("length")
    one = F.lit(1).cast("long")
    tail = first.select(
        "conv_id", "depth", F.coalesce("parent_conv_id", "conv_id").alias("parent_conv_id"), one.alias("n_convs"),
        F.when(last, zero).otherwise(one).alias("n_children"), one.alias("n_leaves"), zero.alias("saved_tokens"),
        F.when(last, F.sha2(F.col("conv_id").cast("string"), 256)).otherwise(empty).alias("ends_sha256"),
    )
    return out.union(tail)
