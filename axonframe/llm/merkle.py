"""Content-addressed Merkle manifest of a table, and proofs by descent from its root.

Every row is a leaf. The leaves of a group ascend by their key and fold, ``arity`` at a time,
level by level into one digest; the digests of the groups, in order, fold the same way into the
root. The manifest keeps *records*: a digest and, level by level, the nodes under it, down to its
children ``digits`` levels below. Equal subtrees have one record.

A proof is found from the root down. The requested ranks are cut into digits, one a record; the
step from a record to a child takes the digit, keeps the child and collects what was not chosen on
the way. Only the distinct prefixes that some request needs are walked, so the record of the root
is read once however many leaves are asked for, and the last step answers the requests of one
bottom record together. At the end the collected segments are turned round: leaf first, root last.

Defined results: fields that are null count as ``-``; empty texts as ``0:``. Rows with equal keys
are ordered by their digest, null keys come first; repeated rows are leaves of their own, and the
result has a row for each. An empty table has no root and gives an empty result. Columns of other
names are not looked at.
"""

from __future__ import annotations

import hashlib
from collections.abc import Sequence
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType

from axonframe.llm.common import arrow_batches, ranked, written

#: The fields of a document that a leaf covers, in order.
FIELDS = ("doc_id", "source", "lang", "n_chars", "text")

RECORD = "tier int, height int, digest string, levels array<array<string>>"
STEP = "struct<before: string, after: string>"


@dataclass(frozen=True)
class Shape:
    """``arity`` nodes fold into one; a record spans ``digits`` levels, so it has arity ** digits children."""

    arity: int = 2
    digits: int = 10

    @property
    def width(self) -> int:
        return self.arity**self.digits


@dataclass
class Manifest:
    """The tree as tables.

    ``leaves(<columns>, grp, rank, n, leaf)``; ``records(tier, height, digest, levels)``, where tier 1
    is the tree of the groups and height counts records above the leaves; ``groups(grp, place, height,
    subroot)``; ``root``, a digest or None; the greatest height of each tier.
    """

    leaves: DataFrame
    records: DataFrame
    groups: DataFrame
    root: str | None
    heights: tuple[int, int]
    shape: Shape


def encoded(value: Column) -> Column:
    """``-`` if null, else the UTF-8 byte count, ``:`` and the value."""
    text = value.cast("string")
    return F.when(value.isNull(), F.lit("-")).otherwise(F.concat(F.octet_length(text).cast("string"), F.lit(":"), text))


def leaf_digest(fields: Sequence[Column]) -> Column:
    return F.sha2(F.concat(*[encoded(f) for f in fields]), 256)


def sha(text: str) -> str:
    return hashlib.sha256(text.encode()).hexdigest()


def folded(level: Sequence[str], arity: int) -> list[str]:
    return [sha("".join(level[i : i + arity])) for i in range(0, len(level), arity)]


# --- building --------------------------------------------------------------------------------


def _records(nodes: DataFrame, shape: Shape, tier: int, height: int) -> DataFrame:
    """The records over ``nodes(grp, rank, n, digest)``, the n nodes of each group at this height.

    A record covers at most ``shape.width`` nodes, so no group of rows is larger. Where a group needs
    one record only, that ends at the single node that is left; else each spans all ``digits`` levels.
    """
    ddl = f"grp string, rank long, n long, {RECORD}"
    schema = to_arrow_schema(StructType.fromDDL(ddl))

    def build(key: tuple, table: pa.Table) -> pa.Table:
        order = np.argsort(table["rank"].to_numpy())
        level = table["digest"].take(pa.array(order)).to_pylist()
        n = table["n"][0].as_py()
        levels = []
        while len(levels) < shape.digits and not (n <= shape.width and len(level) == 1):
            levels.append(level)
            level = folded(level, shape.arity)
        row = [key[0].as_py(), key[1].as_py(), -(-n // shape.width), tier, height, level[0], levels]
        return pa.table([[x] for x in row], schema=schema)

    bundles = nodes.select("grp", "rank", "n", "digest", F.expr(f"rank div {shape.width}").alias("_above"))
    return bundles.groupBy("grp", "_above").applyInArrow(build, ddl)


def _tree(nodes: DataFrame, shape: Shape, tier: int) -> tuple[DataFrame, int]:
    """All records over ``nodes`` and the greatest height, one height at a time; each has a
    ``shape.width``-th of the rows of the one before. Where ``n`` is 1 a record is a group's top."""
    records, height = None, 0
    while True:
        made = written(_records(nodes, shape, tier, height), "records")
        records = made if records is None else records.union(made)
        nodes = made.filter("n > 1").select("grp", "rank", "n", "digest")
        if nodes.isEmpty():
            return records, height
        height += 1


def build_manifest(rows: DataFrame, group: str, key: str, leaf: str, shape: Shape = Shape()) -> Manifest:
    """The manifest of ``rows``: ``leaf`` holds the digest, leaves ascend by ``key`` within ``group``.

    Groups are ordered bytewise in UTF-8, null first. Passes: one range exchange for the ranks and one
    exchange by bottom record; above that the rows are a ``shape.width``-th each time.
    """
    arrow_batches(rows.sparkSession)
    named = rows.withColumns({"grp": F.col(group).cast("string"), "leaf": F.col(leaf)})
    leaves = ranked(named, "grp", [key, "leaf"])
    records, top = _tree(leaves.select("grp", "rank", "n", F.col("leaf").alias("digest")), shape, 0)
    tops = records.filter("n = 1").select("grp", "height", F.col("digest").alias("subroot"))
    groups = written(ranked(tops.withColumn("_all", F.lit("")), "_all", ["grp"]), "groups")
    above, top_above = _tree(groups.select(F.col("_all").alias("grp"), "rank", "n", F.col("subroot").alias("digest")), shape, 1)
    root = above.filter("n = 1").first()
    columns = [f.split()[0] for f in RECORD.split(", ")]
    # Content addressing: equal subtrees have one record.
    store = records.union(above).select(*columns).dropDuplicates(columns[:3])
    groups = groups.select("grp", F.col("rank").alias("place"), "height", "subroot")
    return Manifest(leaves, store, groups, root and root["digest"], (top, top_above), shape)


# --- descent ---------------------------------------------------------------------------------


def select_child(levels: Sequence[Sequence[str]], digit: int, arity: int) -> tuple[str, list[tuple[str, str]]]:
    """The child at ``digit`` and, from the top level down, the nodes beside the way to it."""
    segment = []
    for depth in range(len(levels) - 1, -1, -1):
        level, at = levels[depth], digit // arity**depth
        run = at - at % arity
        segment.append(("".join(level[run:at]), "".join(level[at + 1 : run + arity])))
    return levels[0][digit], segment


def _step(frontier: DataFrame, wanted: DataFrame, records: DataFrame, shape: Shape) -> DataFrame:
    """From ``frontier(grp, prefix, digest, path)`` to the wanted children of its records.

    ``wanted(grp, prefix, ...)`` keeps its columns and gains ``digest`` and ``path``. A frontier row
    meets one record and the prefixes below it, at most ``shape.width``, in one group.
    """
    out = StructType([*wanted.schema.fields, *StructType.fromDDL(f"digest string, path array<{STEP}>").fields])
    schema = to_arrow_schema(out)

    def walk(here: pa.Table, asked: pa.Table) -> pa.Table:
        if not here.num_rows or not asked.num_rows:
            return schema.empty_table()
        (row,) = here.to_pylist()
        digest, path = [], []
        for p in asked["prefix"].to_pylist():
            child, segment = select_child(row["levels"], p % shape.width, shape.arity) if row["levels"] else (row["digest"], [])
            digest.append(child)
            path.append([*row["path"], *({"before": b, "after": a} for b, a in segment)])
        return pa.table([*(asked[c] for c in names), pa.array(digest, pa.string()), pa.array(path, schema.field("path").type)], schema=schema)

    names = list(wanted.columns)
    met = frontier.join(records.select("digest", "levels"), "digest")
    met = met.select("grp", F.col("prefix").alias("_above"), "digest", "path", "levels")
    asked = wanted.withColumn("_above", F.expr(f"prefix div {shape.width}"))
    return met.groupBy("grp", "_above").cogroup(asked.groupBy("grp", "_above")).applyInArrow(walk, out)


def _descend(start: DataFrame, wanted: DataFrame, manifest: Manifest, tier: int) -> DataFrame:
    """Walks from ``start(grp, height, digest, path)``, the top record of each group, to the ranks
    that ``wanted(grp, prefix, ...)`` names, one digit a step."""
    frontier = start.sparkSession.createDataFrame([], f"grp string, prefix long, digest string, path array<{STEP}>")
    for height in range(manifest.heights[tier], -1, -1):
        tops = start.filter(F.col("height") == height).select("grp", F.lit(0).cast("long").alias("prefix"), "digest", "path")
        records = manifest.records.filter((F.col("tier") == tier) & (F.col("height") == height))
        below = wanted
        if height:
            below = wanted.select("grp", F.expr(f"prefix div {manifest.shape.width**height}").alias("prefix")).distinct()
        frontier = _step(frontier.union(tops), below, records, manifest.shape)
        if height:
            frontier = written(frontier, "frontier")
    return frontier


def prove(manifest: Manifest, requests: DataFrame) -> DataFrame:
    """Adds ``subroot``, ``root`` and ``siblings`` to ``requests(grp, rank, ...)``, one for a leaf.

    ``siblings`` has one entry a level, leaf first: the digests before and after the node in its run,
    concatenated, both empty where the node is alone. Requests for ranks that do not exist have no
    result.
    """
    manifest_root = F.lit(manifest.root).cast("string")
    groups = manifest.groups
    root = groups.filter("place = 0").select(
        F.lit("").alias("grp"), F.lit(manifest.heights[1]).alias("height"), manifest_root.alias("digest"),
        F.array().cast(f"array<{STEP}>").alias("path"),
    )
    seats = groups.select(F.lit("").alias("grp"), F.col("place").alias("prefix"), F.col("grp").alias("of"), "height")
    start = _descend(root, seats, manifest, 1).select(F.col("of").alias("grp"), "height", "digest", "path")
    start = written(start, "start")
    found = _descend(start, requests.filter("rank >= 0").withColumnRenamed("rank", "prefix"), manifest, 0)
    found = found.withColumnRenamed("prefix", "rank").withColumn("siblings", F.reverse("path")).drop("digest", "path")
    subroots = groups.select(F.col("grp").alias("_g"), "subroot")
    met = found.join(subroots, F.col("grp").eqNullSafe(F.col("_g"))).drop("_g")
    return met.withColumn("root", manifest_root)


def proof_digest(siblings: str = "siblings") -> Column:
    return F.sha2(F.array_join(F.transform(siblings, lambda s: F.concat(s["before"], s["after"])), ""), 256)


def refold(leaf: Column, siblings: str = "siblings") -> Column:
    """The root that a leaf and its siblings give."""
    return F.aggregate(siblings, leaf, lambda acc, s: F.sha2(F.concat(s["before"], acc, s["after"]), 256))


def tampered(every: int = 7, key: str = "doc_id") -> Column:
    """Rows whose crc32 of the decimal key is divisible by ``every``; never null."""
    return F.coalesce(F.crc32(F.col(key).cast("string").cast("binary")) % every == 0, F.lit(False))


def verify_documents(docs: DataFrame, shape: Shape = Shape()) -> DataFrame:
    """A leaf per document, proofs for all of them, and each folded up again with ``n_chars`` off by
    one where ``tampered`` says so."""
    fields = {c: F.col(c) for c in FIELDS}
    changed = fields | {"n_chars": F.when(tampered(), F.try_add("n_chars", F.lit(1))).otherwise(F.col("n_chars"))}
    rows = docs.select(
        "doc_id",
        F.col("lang").cast("string").alias("lang"),
        leaf_digest(list(fields.values())).alias("digest"),
        F.when(tampered(), leaf_digest(list(changed.values()))).alias("changed"),
    )
    manifest = build_manifest(rows, "lang", "doc_id", "digest", shape)
    proved = prove(manifest, manifest.leaves.select("doc_id", "grp", "rank", "leaf", "changed"))
    folded_root = refold(F.coalesce("changed", "leaf"))
    return proved.select(
        "doc_id", "leaf", "subroot", "root", proof_digest().alias("proof_sha256"), folded_root.alias("folded_root"),
        (folded_root == F.col("root")).alias("verified"),
    )
