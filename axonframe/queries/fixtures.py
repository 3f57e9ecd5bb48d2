"""The given tables read as tractometry tables, and the same mapping as SQL text."""

from __future__ import annotations

import itertools
import os
import tempfile

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from axonframe.functions.geometry import Grid, scaling_grid
from axonframe.functions.scan import SMALL_LIMIT, largest_group_size, number_vertices

# Exact decimal halves would round either way after a differently ordered sum. Both sides
# add the same small offset first, far below the last digit kept.
NUDGE = 1.23456789


def r(value: Column, digits: int = 6) -> Column:
    return F.round(value + F.lit(NUDGE * 10.0 ** -(digits + 2)), digits)


def R(value: str, digits: int = 6) -> str:
    return f"(ROUND(({value}) + {NUDGE}e-{digits + 2}, {digits}) + 0.0)"


def number(value: float) -> str:
    """A DOUBLE literal in SQL."""
    text = repr(float(value))
    return text if "e" in text else f"{text}e0"


_counted: dict[str, int] = {}


def table(spark: SparkSession, sf: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf}/{name}.parquet")


def vertices_of(spark: SparkSession, sf: str) -> DataFrame:
    """lineitem rows with a dense point_idx per order (group size checked once per folder)."""
    rows = table(spark, sf, "lineitem")
    if sf not in _counted:
        _counted[sf] = largest_group_size(rows, ["l_orderkey"])
    order = ["l_linenumber", "l_partkey", "l_suppkey"]
    return number_vertices(rows, ["l_orderkey"], order, largest_group=_counted[sf])


def points(spark: SparkSession, sf: str, extra: tuple[str, ...] = ("dpv",)) -> DataFrame:
    columns = {"dpv": F.col("l_extendedprice").alias("dpv")}
    return vertices_of(spark, sf).select(
        F.col("l_orderkey").alias("streamline_id"),
        "point_idx",
        (F.col("l_quantity") + F.pmod("l_partkey", F.lit(8)) / F.lit(8.0)).alias("x"),
        (F.round(F.col("l_discount") * 100) * F.lit(5.0)).alias("y"),
        (F.round(F.col("l_tax") * 100) * F.lit(6.25)).alias("z"),
        *[columns[c] for c in extra],
    )


def groups(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "lineitem").select(
        F.col("l_orderkey").alias("streamline_id"), F.col("l_returnflag").alias("group_name")
    ).distinct()


def dps(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "orders").select(
        F.col("o_orderkey").alias("streamline_id"), F.lit("price").alias("field"), F.col("o_totalprice").alias("value")
    )


def parts(spark: SparkSession, sf: str) -> DataFrame:
    key = F.col("p_partkey")
    return table(spark, sf, "part").select(
        F.pmod(key, F.lit(10)).cast("int").alias("i"),
        F.pmod(F.floor(key / 10), F.lit(10)).cast("int").alias("j"),
        F.floor(key / 100).cast("int").alias("k"),
        F.col("p_retailprice").alias("value"),
        F.pmod("p_size", F.lit(9)).cast("int").alias("label"),
        "p_size",
    )


def voxels(spark: SparkSession, sf: str) -> DataFrame:
    return parts(spark, sf).select("i", "j", "k", "value")


def parcels(spark: SparkSession, sf: str) -> DataFrame:
    return parts(spark, sf).select("i", "j", "k", "label")


def parcel_labels(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "nation").select(F.col("n_nationkey").alias("label"), F.col("n_name").alias("name"))


def mask(spark: SparkSession, sf: str) -> DataFrame:
    return parts(spark, sf).filter("p_size > 30").select("i", "j", "k")


def masks(spark: SparkSession, sf: str) -> DataFrame:
    """Three overlapping masks: large, low and even parts."""
    rows = parts(spark, sf)
    named = [
        rows.filter(rule).select(F.lit(name).alias("mask_id"), "i", "j", "k")
        for name, rule in (("large", "p_size > 30"), ("low", "p_size < 20"), ("even", "p_size % 2 = 0"))
    ]
    return named[0].unionByName(named[1]).unionByName(named[2])


def grid(spark: SparkSession, sf: str) -> Grid:
    top = table(spark, sf, "part").agg(F.max("p_partkey").alias("m")).first()["m"]
    return scaling_grid(10, 10, int(top) // 100 + 1, 5.0)


def surface(spark: SparkSession, sf: str) -> DataFrame:
    key = F.col("s_suppkey")
    return table(spark, sf, "supplier").select(
        key.alias("vertex_id"),
        F.pmod(key * 37, F.lit(50)).cast("double").alias("x"),
        F.pmod(key * 11, F.lit(50)).cast("double").alias("y"),
        (F.col("s_nationkey") * 2).cast("double").alias("z"),
    )


def triangles(spark: SparkSession, sf: str) -> DataFrame:
    keys = table(spark, sf, "supplier").select(F.col("s_suppkey").alias("v0"))
    top = keys.agg(F.max("v0").alias("m")).first()["m"]
    return keys.filter(F.col("v0") + 2 <= int(top)).select(
        F.col("v0").alias("tri_id"), "v0", (F.col("v0") + 1).alias("v1"), (F.col("v0") + 2).alias("v2")
    )


def by_subject(rows: DataFrame, key: str = "streamline_id", n: int = 3) -> DataFrame:
    """The table as that of ``n`` subjects whose ids overlap."""
    return rows.withColumn("subject_id", F.pmod(key, F.lit(n)).cast("string")).withColumn(key, F.expr(f"{key} div {n}"))


def amplitudes(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "embeddings").select(
        F.col("vec_id").alias("voxel_id"), F.col("embedding").cast("array<double>").alias("amps")
    )


def odx_voxels(spark: SparkSession, sf: str) -> DataFrame:
    key = F.col("vec_id")
    return table(spark, sf, "embeddings").select(
        key.alias("voxel_id"),
        F.pmod(key, F.lit(10)).cast("int").alias("i"),
        F.pmod(F.floor(key / 10), F.lit(10)).cast("int").alias("j"),
        F.floor(key / 100).cast("int").alias("k"),
        F.col("label").cast("double").alias("fa"),
    )


def fixels(spark: SparkSession, sf: str) -> DataFrame:
    """Consecutive triples of each row, normalised; the triple's norm is the amplitude."""
    rows = amplitudes(spark, sf).select("voxel_id", F.explode(F.sequence(F.lit(0), F.lit(20))).alias("fixel_idx"), "amps")
    d = [F.get("amps", F.col("fixel_idx") * 3 + n) for n in range(3)]
    rows = rows.select("voxel_id", "fixel_idx", *[v.alias(n) for v, n in zip(d, ("ax", "ay", "az"))])
    length = F.sqrt(F.col("ax") * F.col("ax") + F.col("ay") * F.col("ay") + F.col("az") * F.col("az"))
    rows = rows.withColumn("amplitude", length)
    return rows.select(
        "voxel_id", "fixel_idx", *[(F.col(f"a{c}") / F.col("amplitude")).alias(f"d{c}") for c in "xyz"], "amplitude",
        F.abs("ax").alias("qa"),
    )


def paths(spark: SparkSession, sf: str) -> DataFrame:
    """File names made of customers, nations and regions, in both layouts."""
    rows = table(spark, sf, "customer").join(table(spark, sf, "nation"), F.col("c_nationkey") == F.col("n_nationkey"))
    rows = rows.join(table(spark, sf, "region"), F.col("n_regionkey") == F.col("r_regionkey"))
    key = F.col("c_custkey")
    kind = F.pmod(key, F.lit(8))
    desc = F.translate("n_name", "_", "")
    head = F.concat(F.lit("/deriv/sub-"), key.cast("string"), F.lit("_space-"), F.col("r_name"))
    turn = F.pmod(F.floor(key / 8), F.lit(3)).cast("string")
    name = (
        F.when(kind < 3, F.concat(F.lit("_desc-"), desc, F.lit("Include"), turn, F.lit("_mask.nii.gz")))
        .when(kind == 3, F.concat(F.lit("_desc-"), desc, F.lit("Exclude"), turn, F.lit("_mask.nii.gz")))
        .when(kind == 4, F.concat(F.lit("_desc-"), desc, F.lit("Start_mask.nii.gz")))
        .when(kind == 5, F.concat(F.lit("_desc-"), desc, F.lit("_probseg.nii.gz")))
        .when(kind == 6, F.concat(F.lit("_desc-tract_desc-ROI-N"), F.col("n_nationkey").cast("string"), F.lit("-"), turn, F.lit("-include.nii.gz")))
        .otherwise(F.concat(F.lit("_desc-"), desc, F.lit("_dwi.nii.gz")))
    )
    return rows.select(F.concat(head, name).alias("path"))


def bundles(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "nation").select(
        F.col("n_name").alias("bundle"), F.array(F.concat(F.lit("N"), F.col("n_nationkey").cast("string"))).alias("legacy_keys")
    )


def cifti_matrix(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "lineitem").groupBy(
        F.col("l_linenumber").alias("map_id"), F.col("l_suppkey").alias("col")
    ).agg(F.max("l_extendedprice").alias("value"))


def brain_models(spark: SparkSession, sf: str) -> DataFrame:
    key, part = F.col("s_suppkey"), F.pmod("s_nationkey", F.lit(3))
    flat = F.when(part == 2, key)
    return table(spark, sf, "supplier").select(
        key.alias("col"),
        F.when(part == 0, "CORTEX_LEFT").when(part == 1, "CORTEX_RIGHT").otherwise("SUBCORTICAL").alias("structure"),
        F.when(part < 2, key).alias("vertex"),
        F.pmod(flat, F.lit(10)).cast("int").alias("i"),
        F.floor(flat / 10).cast("int").alias("j"),
        F.when(part == 2, 0).alias("k"),
    )


_scratch = itertools.count()


def scratch(spark: SparkSession) -> str:
    """A new folder every executor can reach: under the session's checkpoint folder."""
    shared = spark.sparkContext.getCheckpointDir() or spark.conf.get("spark.checkpoint.dir", None)
    if shared:
        return f"{shared}/scratch-{os.getpid()}-{next(_scratch)}"
    return tempfile.mkdtemp(prefix="spark-")


# --- the same mapping in SQL ----------------------------------------------------------

CTE = {
    "pts": """SELECT l_orderkey AS streamline_id,
        CAST(ROW_NUMBER() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey) - 1 AS INT) AS point_idx,
        l_quantity + (l_partkey % 8) / CAST(8 AS DOUBLE) AS x,
        ROUND(l_discount * 100) * CAST(5 AS DOUBLE) AS y,
        ROUND(l_tax * 100) * CAST(6.25 AS DOUBLE) AS z,
        l_extendedprice AS dpv FROM lineitem""",
    "grp": "SELECT DISTINCT l_orderkey AS streamline_id, l_returnflag AS group_name FROM lineitem",
    "dps": "SELECT o_orderkey AS streamline_id, 'price' AS field, o_totalprice AS value FROM orders",
    "vox": """SELECT CAST(p_partkey % 10 AS INT) AS i, CAST(FLOOR(p_partkey / 10) AS INT) % 10 AS j,
        CAST(FLOOR(p_partkey / 100) AS INT) AS k, p_retailprice AS value, CAST(p_size % 9 AS INT) AS label, p_size FROM part""",
    "dims": "SELECT 10 AS nx, 10 AS ny, MAX(k) + 1 AS nz FROM vox",
    "lab": "SELECT n_nationkey AS label, n_name AS name FROM nation",
    "msk": "SELECT i, j, k FROM vox WHERE p_size > 30",
    "msks": """SELECT 'large' AS mask_id, i, j, k FROM vox WHERE p_size > 30
        UNION ALL SELECT 'low', i, j, k FROM vox WHERE p_size < 20
        UNION ALL SELECT 'even', i, j, k FROM vox WHERE p_size % 2 = 0""",
    "pvr": """SELECT pts.*, CAST(ROUND(x * 2e-1) AS INT) AS i, CAST(ROUND(y * 2e-1) AS INT) AS j, CAST(ROUND(z * 2e-1) AS INT) AS k FROM pts""",
    "pvf": """SELECT pts.*, CAST(FLOOR(x * 2e-1) AS INT) AS i, CAST(FLOOR(y * 2e-1) AS INT) AS j, CAST(FLOOR(z * 2e-1) AS INT) AS k FROM pts""",
    "near": """SELECT *, LAG(x) OVER w AS px, LAG(y) OVER w AS py, LAG(z) OVER w AS pz,
        LEAD(x) OVER w AS nx, LEAD(y) OVER w AS ny, LEAD(z) OVER w AS nz, COUNT(*) OVER (PARTITION BY streamline_id) AS n
        FROM pts WINDOW w AS (PARTITION BY streamline_id ORDER BY point_idx)""",
    "seg": """SELECT streamline_id, point_idx AS segment_idx, x AS x0, y AS y0, z AS z0, nx AS x1, ny AS y1, nz AS z1,
        (x + nx) * 0.5e0 AS mx, (y + ny) * 0.5e0 AS my, (z + nz) * 0.5e0 AS mz,
        SQRT((nx-x)*(nx-x) + (ny-y)*(ny-y) + (nz-z)*(nz-z)) AS length FROM near WHERE nx IS NOT NULL""",
    "segu": """SELECT *, CASE WHEN length > 0 THEN (x1-x0)/length ELSE 0e0 END AS ux, CASE WHEN length > 0 THEN (y1-y0)/length ELSE 0e0 END AS uy,
        CASE WHEN length > 0 THEN (z1-z0)/length ELSE 0e0 END AS uz FROM seg""",
    "tan": """SELECT streamline_id, point_idx, x, y, z, dpv,
        CASE WHEN n = 1 THEN 0.5e0 WHEN l > 0 THEN dx / l ELSE 0e0 END AS tx,
        CASE WHEN n = 1 THEN 0.5e0 WHEN l > 0 THEN dy / l ELSE 0e0 END AS ty,
        CASE WHEN n = 1 THEN 0.5e0 WHEN l > 0 THEN dz / l ELSE 0e0 END AS tz
        FROM (SELECT *, SQRT(dx*dx + dy*dy + dz*dz) AS l FROM (SELECT *, COALESCE(nx, x) - COALESCE(px, x) AS dx,
        COALESCE(ny, y) - COALESCE(py, y) AS dy, COALESCE(nz, z) - COALESCE(pz, z) AS dz FROM near))""",
    "len": "SELECT streamline_id, SUM(length) AS length_mm FROM seg GROUP BY streamline_id",
    "box": "SELECT MIN(x) AS ax, MIN(y) AS ay, MIN(z) AS az, MAX(x) AS bx, MAX(y) AS by_, MAX(z) AS bz FROM pts",
    "ends": """SELECT streamline_id, ARG_MIN(x, point_idx) AS fx, ARG_MIN(y, point_idx) AS fy, ARG_MIN(z, point_idx) AS fz,
        ARG_MAX(x, point_idx) AS lx, ARG_MAX(y, point_idx) AS ly, ARG_MAX(z, point_idx) AS lz, COUNT(*) AS n FROM pts GROUP BY streamline_id""",
    "endr": """SELECT streamline_id, n, FALSE AS is_last, fx AS x, fy AS y, fz AS z FROM ends
        UNION ALL SELECT streamline_id, n, TRUE, lx, ly, lz FROM ends""",
    "srf": """SELECT s_suppkey AS vertex_id, CAST((s_suppkey * 37) % 50 AS DOUBLE) AS x,
        CAST((s_suppkey * 11) % 50 AS DOUBLE) AS y, CAST(s_nationkey * 2 AS DOUBLE) AS z FROM supplier""",
    "tri": """SELECT s_suppkey AS tri_id, s_suppkey AS v0, s_suppkey + 1 AS v1, s_suppkey + 2 AS v2 FROM supplier
        WHERE s_suppkey + 2 <= (SELECT MAX(s_suppkey) FROM supplier)""",
    "corner": """SELECT tri_id, a.x AS ax, a.y AS ay, a.z AS az, b.x AS bx, b.y AS by_, b.z AS bz, c.x AS cx, c.y AS cy, c.z AS cz
        FROM tri JOIN srf a ON v0 = a.vertex_id JOIN srf b ON v1 = b.vertex_id JOIN srf c ON v2 = c.vertex_id""",
    "cpts": "SELECT * REPLACE (streamline_id // 3 AS streamline_id), CAST(streamline_id % 3 AS VARCHAR) AS subject_id FROM pts",
    "clen": "SELECT CAST(streamline_id % 3 AS VARCHAR) AS subject_id, streamline_id // 3 AS streamline_id, length_mm FROM len",
    "csrf": "SELECT * REPLACE (vertex_id // 3 AS vertex_id), CAST(vertex_id % 3 AS VARCHAR) AS subject_id FROM srf",
    "cdps": "SELECT * REPLACE (streamline_id // 3 AS streamline_id), CAST(streamline_id % 3 AS VARCHAR) AS subject_id FROM dps",
    "cgrp": "SELECT * REPLACE (streamline_id // 3 AS streamline_id), CAST(streamline_id % 3 AS VARCHAR) AS subject_id FROM grp",
    "emb": "SELECT vec_id AS voxel_id, CAST(embedding AS DOUBLE[]) AS amps, label FROM embeddings",
    "odx": """SELECT vec_id AS voxel_id, CAST(vec_id % 10 AS INT) AS i, CAST(FLOOR(vec_id / 10) AS INT) % 10 AS j,
        CAST(FLOOR(vec_id / 100) AS INT) AS k, CAST(label AS DOUBLE) AS fa FROM embeddings""",
    "fix": """SELECT voxel_id, fixel_idx, ax / amplitude AS dx, ay / amplitude AS dy, az / amplitude AS dz, amplitude, ABS(ax) AS qa FROM (
        SELECT *, SQRT(ax*ax + ay*ay + az*az) AS amplitude FROM (SELECT voxel_id, CAST(f AS INT) AS fixel_idx,
        amps[f*3+1] AS ax, amps[f*3+2] AS ay, amps[f*3+3] AS az FROM emb, (SELECT UNNEST(RANGE(21)) AS f)))""",
    "pth": """SELECT '/deriv/sub-' || c_custkey || '_space-' || r_name || CASE
        WHEN c_custkey % 8 < 3 THEN '_desc-' || REPLACE(n_name, '_', '') || 'Include' || t || '_mask.nii.gz'
        WHEN c_custkey % 8 = 3 THEN '_desc-' || REPLACE(n_name, '_', '') || 'Exclude' || t || '_mask.nii.gz'
        WHEN c_custkey % 8 = 4 THEN '_desc-' || REPLACE(n_name, '_', '') || 'Start_mask.nii.gz'
        WHEN c_custkey % 8 = 5 THEN '_desc-' || REPLACE(n_name, '_', '') || '_probseg.nii.gz'
        WHEN c_custkey % 8 = 6 THEN '_desc-tract_desc-ROI-N' || n_nationkey || '-' || t || '-include.nii.gz'
        ELSE '_desc-' || REPLACE(n_name, '_', '') || '_dwi.nii.gz' END AS path
        FROM (SELECT *, CAST(FLOOR(c_custkey / 8) AS BIGINT) % 3 AS t FROM customer) JOIN nation ON c_nationkey = n_nationkey
        JOIN region ON n_regionkey = r_regionkey""",
    "mat": "SELECT l_linenumber AS map_id, l_suppkey AS col, MAX(l_extendedprice) AS value FROM lineitem GROUP BY 1, 2",
    "bm": """SELECT s_suppkey AS col, CASE s_nationkey % 3 WHEN 0 THEN 'CORTEX_LEFT' WHEN 1 THEN 'CORTEX_RIGHT' ELSE 'SUBCORTICAL' END AS structure,
        CASE WHEN s_nationkey % 3 < 2 THEN s_suppkey END AS vertex, CAST(CASE WHEN s_nationkey % 3 = 2 THEN s_suppkey % 10 END AS INT) AS i,
        CAST(CASE WHEN s_nationkey % 3 = 2 THEN FLOOR(s_suppkey / 10) END AS INT) AS j, CASE WHEN s_nationkey % 3 = 2 THEN 0 END AS k FROM supplier""",
}
NEEDS = {
    "dims": ["vox"], "msk": ["vox"], "msks": ["vox"], "pvr": ["pts"], "pvf": ["pts"], "near": ["pts"], "seg": ["near"],
    "segu": ["seg"], "tan": ["near"], "len": ["seg"], "box": ["pts"], "ends": ["pts"], "endr": ["ends"],
    "corner": ["tri", "srf"], "fix": ["emb"], "cpts": ["pts"], "clen": ["len"], "csrf": ["srf"], "cdps": ["dps"], "cgrp": ["grp"],
}


def sql(names: str, body: str, recursive: bool = False) -> str:
    """Body prefixed with the named mappings and whatever they build on."""
    order: list[str] = []

    def add(name: str) -> None:
        for need in NEEDS.get(name, []):
            add(need)
        if name not in order:
            order.append(name)

    for name in names.split():
        add(name)
    head = ",\n".join(f"{n} AS ({CTE[n]})" for n in order)
    text = body.strip()
    word = "WITH RECURSIVE " if recursive else "WITH "
    if text.upper().startswith("WITH "):
        return f"{word}{head}{',' if head else ''}\n{text[5:]}"
    return f"{word}{head}\n{text}" if head else text


# --- registry -------------------------------------------------------------------------

QUERIES: dict = {}
ORACLES: dict[str, str] = {}


def query(name: str, oracle: str | None = None):
    def register(fn):
        QUERIES[name] = fn
        if oracle is not None:
            ORACLES[name] = oracle
        return fn

    return register
