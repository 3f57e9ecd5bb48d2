"""Registered queries: sampling, volumes, masks, matrices and orientation rows."""

from __future__ import annotations

from pyspark.sql import functions as F

from axonframe.functions import color
from axonframe.functions import geometry as geo
from axonframe.operators import cifti, orientation, sampling, volumes
from axonframe.queries import fixtures as fx
from axonframe.queries.fixtures import R, number, query, r, sql
from axonframe.sources.tables import scalar_catalog

POINT = ["streamline_id", "point_idx"]

# Eight corners of a point's cube on the 5 mm grid.
TAPS = """b AS (SELECT streamline_id, point_idx, FLOOR(x * 2e-1) AS bi, FLOOR(y * 2e-1) AS bj, FLOOR(z * 2e-1) AS bk,
      x * 2e-1 - FLOOR(x * 2e-1) AS fx, y * 2e-1 - FLOOR(y * 2e-1) AS fy, z * 2e-1 - FLOOR(z * 2e-1) AS fz FROM pts),
    t AS (SELECT streamline_id, point_idx, bi + a AS i, bj + c AS j, bk + d AS k,
      (CASE a WHEN 1 THEN fx ELSE 1 - fx END) * (CASE c WHEN 1 THEN fy ELSE 1 - fy END) * (CASE d WHEN 1 THEN fz ELSE 1 - fz END) AS w
      FROM b, (SELECT UNNEST([0, 1]) AS a), (SELECT UNNEST([0, 1]) AS c), (SELECT UNNEST([0, 1]) AS d))"""


@query("sample_nearest", sql("pvr vox", "SELECT streamline_id, point_idx, value FROM pvr LEFT JOIN vox USING (i, j, k)"))
def sample_nearest(spark, sf):
    out = sampling.sample_nearest(fx.points(spark, sf), fx.voxels(spark, sf), fx.grid(spark, sf))
    return out.select(*POINT, "value")


@query("sample_trilinear", sql("pts vox", f"""WITH {TAPS}, s AS (SELECT streamline_id, point_idx, SUM(w * value) AS v FROM t JOIN vox USING (i, j, k) GROUP BY 1, 2 HAVING COUNT(*) = 8)
    SELECT streamline_id, point_idx, {R('v', 5)} AS value FROM pts LEFT JOIN s USING (streamline_id, point_idx)"""))
def sample_trilinear(spark, sf):
    out = sampling.sample_trilinear(fx.points(spark, sf), fx.voxels(spark, sf), fx.grid(spark, sf))
    return out.select(*POINT, r(F.col("value"), 5).alias("value"))


@query("sample_masked_trilinear", sql("pts odx emb", f"""WITH {TAPS},
    s AS (SELECT streamline_id, point_idx, n AS term, SUM(w * amps[n + 1]) AS s, SUM(w) AS w FROM t JOIN odx USING (i, j, k) JOIN emb USING (voxel_id), (SELECT UNNEST(RANGE(64)) AS n)
      WHERE w > 0 AND fa >= 3 GROUP BY 1, 2, 3)
    SELECT streamline_id, point_idx, CAST(term AS INT) AS term, {R('s / w')} AS value FROM s WHERE w >= 0.01e0"""))
def sample_masked_trilinear(spark, sf):
    """All 64 amplitudes of each voxel as coefficients, gated by a voxel scalar."""
    rows = fx.odx_voxels(spark, sf).join(fx.amplitudes(spark, sf), "voxel_id")
    rows = rows.select("i", "j", "k", "fa", F.col("amps").alias("coeffs"))
    grid = geo.scaling_grid(10, 10, 10_000, 5.0)
    out = sampling.sample_masked_trilinear(fx.points(spark, sf), rows, grid, "fa", 3.0)
    long = out.select(*POINT, F.posexplode("coeffs").alias("term", "value"))
    return long.withColumn("value", r(F.col("value")))


@query("sample_volume_along_streamline", sql("pts vox dps", f"""WITH {TAPS}, s AS (SELECT streamline_id, point_idx, SUM(w * value) AS v FROM t JOIN vox USING (i, j, k) GROUP BY 1, 2 HAVING COUNT(*) = 8)
    SELECT streamline_id, 'fa' AS field, {R('AVG(v)', 5)} AS value FROM pts LEFT JOIN s USING (streamline_id, point_idx) GROUP BY 1
    UNION ALL SELECT streamline_id, field, value FROM dps"""))
def sample_volume_along_streamline(spark, sf):
    """NaN (no sample in bounds) is shown as NULL."""
    old = fx.dps(spark, sf)
    old = old.unionByName(old.withColumn("field", F.lit("fa")))
    out = sampling.sample_volume_along_streamline(fx.points(spark, sf), fx.voxels(spark, sf), fx.grid(spark, sf), "fa", old)
    shown = F.when(F.col("field") == "fa", r(F.nanvl("value", F.lit(None).cast("double")), 5)).otherwise(F.col("value"))
    return out.select("streamline_id", "field", shown.alias("value"))


@query("glyph_gate_values", sql("odx vox", "SELECT voxel_id, value AS gate FROM odx LEFT JOIN vox USING (i, j, k)"))
def glyph_gate_values(spark, sf):
    grid = fx.grid(spark, sf)
    out = sampling.glyph_gate_values(fx.odx_voxels(spark, sf), fx.voxels(spark, sf), grid, grid)
    return out.select("voxel_id", F.nanvl("gate", F.lit(None).cast("double")).alias("gate"))


def _other_grid(grid: geo.Grid) -> geo.Grid:
    """A 4 mm grid shifted by 1 mm that reaches past the 5 mm one."""
    return geo.Grid(13, 13, max(2, grid.nz), (4.0, 0, 0, 1.0, 0, 4.0, 0, 1.0, 0, 0, 4.0, 1.0, 0, 0, 0, 1))


CENTRES = """g AS (SELECT i AS ti, j AS tj, k AS tk, i * 4e0 + 1 AS x, j * 4e0 + 1 AS y, k * 4e0 + 1 AS z
    FROM (SELECT UNNEST(RANGE(13)) AS i), (SELECT UNNEST(RANGE(13)) AS j), (SELECT UNNEST(RANGE(GREATEST(2, (SELECT nz FROM dims)))) AS k))"""


@query("resample_volume", sql("vox dims", f"""WITH {CENTRES},
    c AS (SELECT ti, tj, tk, FLOOR(x * 2e-1) + a AS i, FLOOR(y * 2e-1) + b AS j, FLOOR(z * 2e-1) + d AS k,
      (CASE a WHEN 1 THEN x * 2e-1 - FLOOR(x * 2e-1) ELSE 1 - (x * 2e-1 - FLOOR(x * 2e-1)) END) * (CASE b WHEN 1 THEN y * 2e-1 - FLOOR(y * 2e-1) ELSE 1 - (y * 2e-1 - FLOOR(y * 2e-1)) END)
      * (CASE d WHEN 1 THEN z * 2e-1 - FLOOR(z * 2e-1) ELSE 1 - (z * 2e-1 - FLOOR(z * 2e-1)) END) AS w
      FROM g, (SELECT UNNEST([0, 1]) AS a), (SELECT UNNEST([0, 1]) AS b), (SELECT UNNEST([0, 1]) AS d)),
    s AS (SELECT ti, tj, tk, SUM(w * value) AS v FROM c JOIN vox USING (i, j, k) GROUP BY 1, 2, 3 HAVING COUNT(*) = 8)
    SELECT CAST(ti AS INT) AS i, CAST(tj AS INT) AS j, CAST(tk AS INT) AS k, {R('v', 5)} AS value FROM g LEFT JOIN s USING (ti, tj, tk)"""))
def resample_volume(spark, sf):
    grid = fx.grid(spark, sf)
    out = sampling.resample_volume(spark, _other_grid(grid), fx.voxels(spark, sf), grid, "trilinear")
    return out.withColumn("value", r(F.col("value"), 5))


@query("resample_volume_cohort", sql("vox", """WITH v AS (SELECT CAST(label % 2 AS VARCHAR) AS subject_id, i, j, k FROM vox), s AS (SELECT a.subject_id, i, j, k, value FROM (SELECT DISTINCT subject_id FROM v) a, vox WHERE NOT (subject_id = '1' AND p_size % 5 = 0)),
    g AS (SELECT subject_id, i, j, k FROM (SELECT DISTINCT subject_id FROM v), (SELECT i, j, k FROM (SELECT UNNEST(RANGE(9)) AS i), (SELECT UNNEST(RANGE(9)) AS j), (SELECT UNNEST(RANGE((SELECT MAX(k) FROM vox))) AS k))),
    t AS (SELECT g.subject_id, g.i, g.j, g.k, SUM(value) * 0.125e0 AS v FROM g JOIN s ON s.subject_id = g.subject_id AND s.i - g.i IN (0, 1) AND s.j - g.j IN (0, 1) AND s.k - g.k IN (0, 1) GROUP BY ALL HAVING COUNT(*) = 8)
    SELECT subject_id, CAST(i AS INT) AS i, CAST(j AS INT) AS j, CAST(k AS INT) AS k, """ + R("v", 5) + """ AS value FROM g LEFT JOIN t USING (subject_id, i, j, k)"""))
def resample_volume_cohort(spark, sf):
    """Two subjects' volumes at the corners between their voxels; the second lacks some voxels."""
    rows = fx.parts(spark, sf).withColumn("subject_id", F.explode(F.array(F.lit("0"), F.lit("1"))))
    rows = rows.filter(~((F.col("subject_id") == "1") & (F.col("p_size") % 5 == 0)))
    grid = fx.grid(spark, sf)
    between = geo.Grid(9, 9, grid.nz - 1, (5.0, 0, 0, 2.5, 0, 5.0, 0, 2.5, 0, 0, 5.0, 2.5, 0, 0, 0, 1))
    out = sampling.resample_volume(spark, between, rows.select("subject_id", "i", "j", "k", "value"), grid, "trilinear")
    return out.withColumn("value", r(F.col("value"), 5))


@query("resample_labels", sql("vox dims", f"""WITH {CENTRES} SELECT CAST(ti AS INT) AS i, CAST(tj AS INT) AS j, CAST(tk AS INT) AS k, CAST(label AS DOUBLE) AS value
    FROM g LEFT JOIN vox ON vox.i = ROUND(x * 2e-1) AND vox.j = ROUND(y * 2e-1) AND vox.k = ROUND(z * 2e-1)"""))
def resample_labels(spark, sf):
    grid = fx.grid(spark, sf)
    labels = fx.parcels(spark, sf).withColumnRenamed("label", "value")
    return sampling.resample_volume(spark, _other_grid(grid), labels, grid, "nearest")


@query("join_labels", sql("vox lab", f"""WITH m AS (SELECT l, (l * 2654435769) % 4294967296 AS m FROM (SELECT DISTINCT CAST(label * 7 AS BIGINT) AS l FROM vox))
    SELECT CAST(l AS INT) AS label, COALESCE(name, 'Label ' || l) AS label_name, {R('LEAST(0.95e0, GREATEST(0.2e0, (m % 256) / 255e0))')} AS label_r,
    {R('LEAST(0.95e0, GREATEST(0.2e0, ((m >> 8) % 256) / 255e0))')} AS label_g, {R('LEAST(0.95e0, GREATEST(0.2e0, ((m >> 16) % 256) / 255e0))')} AS label_b
    FROM m LEFT JOIN lab ON l = lab.label"""))
def join_labels(spark, sf):
    used = fx.parcels(spark, sf).select((F.col("label") * 7).alias("label")).distinct()
    out = sampling.join_labels(used, fx.parcel_labels(spark, sf))
    return out.select("label", "label_name", *[r(F.col(f"label_{c}")).alias(f"label_{c}") for c in "rgb"])


# --- ranges -------------------------------------------------------------------------


@query("robust_range", sql("dps", """WITH o AS (SELECT value, ROW_NUMBER() OVER (ORDER BY value) - 1 AS n, COUNT(*) OVER () AS c FROM dps)
    SELECT MAX(CASE WHEN n = FLOOR(c * 0.02e0) THEN value END) AS lo, MAX(CASE WHEN n = FLOOR(c * 0.98e0) THEN value END) AS hi FROM o"""))
def robust_range(spark, sf):
    return volumes.robust_range(fx.dps(spark, sf), "value")


@query("robust_range_by_map", sql("mat", """WITH o AS (SELECT map_id, value, ROW_NUMBER() OVER (PARTITION BY map_id ORDER BY value) - 1 AS n, COUNT(*) OVER (PARTITION BY map_id) AS c FROM mat)
    SELECT map_id, MAX(CASE WHEN n = FLOOR(c * 0.02e0) THEN value END) AS lo, MAX(CASE WHEN n = FLOOR(c * 0.98e0) THEN value END) AS hi FROM o GROUP BY 1"""))
def robust_range_by_map(spark, sf):
    return volumes.robust_range(fx.cifti_matrix(spark, sf), "value", ["map_id"])


@query("finite_minmax", sql("dps", "SELECT MIN(value) FILTER (WHERE streamline_id % 3 > 0) AS lo, MAX(value) FILTER (WHERE streamline_id % 3 > 0) AS hi FROM dps"))
def finite_minmax(spark, sf):
    """Every third value is replaced by NaN or infinity first."""
    key = F.col("streamline_id")
    broken = F.when(key % 6 == 0, F.lit(float("nan"))).when(key % 3 == 0, F.lit(float("inf"))).otherwise(F.col("value"))
    return volumes.finite_minmax(fx.dps(spark, sf).withColumn("value", broken), "value")


@query("dpv_to_volume", sql("odx vox dims", f"""WITH s AS (SELECT MIN(fa) AS lo, MAX(fa) AS hi FROM odx WHERE k < (SELECT nz FROM dims))
    SELECT v.i, v.j, v.k, {R('COALESCE((fa - lo) / (hi - lo), 0)')} AS value FROM vox v LEFT JOIN odx USING (i, j, k), s"""))
def dpv_to_volume(spark, sf):
    grid = fx.grid(spark, sf)
    values = fx.odx_voxels(spark, sf).filter(F.col("k") < grid.nz).select("i", "j", "k", F.col("fa").alias("value"))
    out = volumes.dpv_to_volume(spark, values, grid)
    return out.select("i", "j", "k", r(F.col("value")).alias("value"))


# --- masks --------------------------------------------------------------------------


@query("mask_threshold", sql("vox", "SELECT i, j, k FROM vox WHERE value > 950"))
def mask_threshold(spark, sf):
    return volumes.mask_threshold(fx.voxels(spark, sf), 950.0)


@query("mask_from_parcels", sql("vox", "SELECT i, j, k FROM vox WHERE label IN (2, 4)"))
def mask_from_parcels(spark, sf):
    return volumes.mask_from_parcels(fx.parcels(spark, sf), [0, 2, 4])


@query("mask_from_shape", sql("vox", "SELECT i, j, k FROM vox WHERE SQRT((i*5-20)*(i*5-20) + (j*5-22)*(j*5-22) + (k*5-10)*(k*5-10)) <= 15 AND i = i UNION ALL SELECT i, j, k + 1000 FROM vox WHERE ABS(i*5-20) <= 8 AND ABS(j*5-22) <= 8 AND ABS(k*5-10) <= 8"))
def mask_from_shape(spark, sf):
    """A ball, and a box shown 1000 layers up, both met with the part table's grid voxels."""
    grid = fx.grid(spark, sf)
    cells = fx.voxels(spark, sf).select("i", "j", "k")
    ball = volumes.mask_from_shape(spark, grid, (20.0, 22.0, 10.0), 15.0)
    box = volumes.mask_from_shape(spark, grid, (20.0, 22.0, 10.0), 8.0, "box")
    on = ["i", "j", "k"]
    return cells.join(ball, on).unionByName(cells.join(box, on).withColumn("k", F.col("k") + 1000))


@query("mask_count", sql("msks", "SELECT mask_id, CAST(COUNT(*) AS BIGINT) AS n_voxels FROM msks GROUP BY 1"))
def mask_count(spark, sf):
    return volumes.mask_count(fx.masks(spark, sf))


@query("mask_union", sql("vox dims", f"""WITH a AS (SELECT DISTINCT CAST(FLOOR(i * 5 / 4e0) AS INT) AS i, CAST(FLOOR(j * 5 / 4e0) AS INT) AS j, k FROM vox WHERE p_size > 45 AND k < GREATEST(2, (SELECT nz FROM dims))),
    {CENTRES}, b AS (SELECT CAST(ti AS INT) AS i, CAST(tj AS INT) AS j, CAST(tk AS INT) AS k FROM g JOIN vox ON vox.i = ROUND(x * 2e-1) AND vox.j = ROUND(y * 2e-1) AND vox.k = ROUND(z * 2e-1) WHERE p_size > 30)
    SELECT i, j, k FROM a UNION SELECT i, j, k FROM b"""))
def mask_union(spark, sf):
    grid = fx.grid(spark, sf)
    other = _other_grid(grid)
    a = fx.parts(spark, sf).filter((F.col("p_size") > 45) & (F.col("k") < other.nz)).select(
        *[F.floor(F.col(n) * 5 / 4.0).cast("int").alias(n) for n in "ij"], "k"
    ).distinct()
    return volumes.mask_union(spark, a, other, fx.mask(spark, sf), grid)


@query("mask_intersect", sql("vox", "SELECT i, j, k FROM vox WHERE p_size > 30 AND value > 950"))
def mask_intersect(spark, sf):
    return volumes.mask_intersect(fx.mask(spark, sf), volumes.mask_threshold(fx.voxels(spark, sf), 950.0))


@query("mask_dilate", sql("vox dims", """WITH m AS (SELECT i, j, k FROM vox WHERE p_size > 48), d AS (SELECT UNNEST(RANGE(-3, 4)) AS d)
    SELECT DISTINCT CAST(i + a.d AS INT) AS i, CAST(j + b.d AS INT) AS j, CAST(k + c.d AS INT) AS k FROM m, d a, d b, d c, dims
    WHERE a.d*a.d + b.d*b.d + c.d*c.d <= 5 AND i + a.d BETWEEN 0 AND 9 AND j + b.d BETWEEN 0 AND 9 AND k + c.d BETWEEN 0 AND nz - 1"""))
def mask_dilate(spark, sf):
    mask = fx.parts(spark, sf).filter("p_size > 48").select("i", "j", "k")
    return volumes.mask_dilate(mask, fx.grid(spark, sf), 2.1)


@query("mask_boundary_faces", sql("msk", """WITH s AS (SELECT * FROM (VALUES (0,-1,0,0),(1,1,0,0),(2,0,-1,0),(3,0,1,0),(4,0,0,-1),(5,0,0,1)) t(side, a, b, c))
    SELECT CAST(side AS INT) AS side, m.i, m.j, m.k, (m.i + CASE side WHEN 1 THEN 0.5 ELSE -0.5 END) * 5e0 AS x0, (m.j + CASE side WHEN 3 THEN 0.5 ELSE -0.5 END) * 5e0 AS y0, (m.k + CASE side WHEN 5 THEN 0.5 ELSE -0.5 END) * 5e0 AS z0
    FROM msk m, s WHERE NOT EXISTS (SELECT 1 FROM msk n WHERE n.i = m.i + a AND n.j = m.j + b AND n.k = m.k + c)"""))
def mask_boundary_faces(spark, sf):
    out = volumes.mask_boundary_faces(fx.mask(spark, sf), fx.grid(spark, sf))
    return out.select("side", "i", "j", "k", *[F.col("c0")[c].alias(f"{c}0") for c in "xyz"])


EDGES = """WITH s AS (SELECT * FROM (VALUES (0,-1,0),(1,1,0),(2,0,-1),(3,0,1)) t(side, a, b)), m AS ({layer})
    SELECT CAST(side AS INT) AS side, m.i, m.j, m.k, {extra} (m.i + CASE side WHEN 1 THEN 0.5 ELSE -0.5 END) * 5e0 AS ax, (m.j + CASE side WHEN 3 THEN 0.5 ELSE -0.5 END) * 5e0 AS ay,
    (m.i + CASE side WHEN 0 THEN -0.5 ELSE 0.5 END) * 5e0 AS bx, (m.j + CASE side WHEN 2 THEN -0.5 ELSE 0.5 END) * 5e0 AS by, {at} AS az
    FROM m, s WHERE NOT EXISTS (SELECT 1 FROM m n WHERE n.i = m.i + a AND n.j = m.j + b)"""


@query("parcel_contours", sql("vox", EDGES.format(layer="SELECT i, j, k, label FROM vox WHERE k = 1 AND label IN (1, 2, 3, 4)", extra="m.label,", at="5e0")))
def parcel_contours(spark, sf):
    out = volumes.parcel_contours(fx.parcels(spark, sf), fx.grid(spark, sf), 0, 1, [1, 2, 3, 4])
    return out.select("side", "i", "j", "k", "label", "ax", "ay", "bx", "by", "az")


@query("mask_slice_outline", sql("msk", EDGES.format(layer="SELECT i, j, k FROM msk WHERE k = 1", extra="", at="6e0")))
def mask_slice_outline(spark, sf):
    out = volumes.mask_slice_outline(fx.mask(spark, sf), fx.grid(spark, sf), 0, 6.0)
    return out.select("side", "i", "j", "k", "ax", "ay", "bx", "by", r(F.col("az")).alias("az"))


@query("nearest_nonempty_slice", sql("vox", "SELECT k AS slice FROM vox WHERE p_size = 50 GROUP BY k ORDER BY ABS(k - 3), k LIMIT 1"))
def nearest_nonempty_slice(spark, sf):
    rows = fx.parts(spark, sf).filter("p_size = 50")
    return volumes.nearest_nonempty_slice(rows, 0, 3, 1_000_000)


# --- smoothing and stacks -----------------------------------------------------------

KERNEL = [number(v) for v in volumes.gaussian_kernel(1.0)]
KER = "ker AS (SELECT UNNEST(RANGE(7)) - 3 AS o, UNNEST([" + ", ".join(KERNEL) + "]) AS w)"


def _blur_sql(value: str, source: str) -> str:
    steps = []
    last = source
    for axis, size in (("i", "10"), ("j", "10"), ("k", "(SELECT nz FROM dims)")):
        others = [a for a in "ijk" if a != axis]
        at = ", ".join(f"t.{axis} AS {axis}" if a == axis else f"s.{a}" for a in "ijk")
        steps.append(
            f"{value}_{axis} AS (SELECT {at}, SUM(w * s.v) AS v FROM (SELECT UNNEST(RANGE({size})) AS {axis}) t, ker JOIN {last} s "
            f"ON s.{axis} = LEAST(GREATEST(t.{axis} + o, 0), {size} - 1) GROUP BY ALL)"
        )
        last = f"{value}_{axis}"
    return ", ".join(steps)


@query("gaussian_blur", sql("vox dims", f"WITH {KER}, src AS (SELECT i, j, k, value AS v FROM vox), {_blur_sql('b', 'src')} SELECT CAST(i AS INT) AS i, CAST(j AS INT) AS j, CAST(k AS INT) AS k, {R('v')} AS value FROM b_k"))
def gaussian_blur(spark, sf):
    grid = fx.grid(spark, sf)
    out = volumes.gaussian_blur(fx.voxels(spark, sf), grid.dims, 1.0)
    return out.withColumn("value", r(F.col("value")))


@query("nw_interpolate", sql("vox dims", f"""WITH {KER}, d0 AS (SELECT i, j, k, 1e0 AS v FROM vox WHERE p_size > 25), n0 AS (SELECT i, j, k, value AS v FROM vox WHERE p_size > 25),
    {_blur_sql('d', 'd0')}, {_blur_sql('n', 'n0')} SELECT CAST(i AS INT) AS i, CAST(j AS INT) AS j, CAST(k AS INT) AS k, {R('n_k.v / d_k.v')} AS value FROM n_k JOIN d_k USING (i, j, k) WHERE d_k.v > 0"""))
def nw_interpolate(spark, sf):
    rows = fx.parts(spark, sf).filter("p_size > 25").select("i", "j", "k", "value", F.lit(1.0).alias("density"))
    out = volumes.nw_interpolate(rows, fx.grid(spark, sf).dims, 1.0, "value")
    return out.select("i", "j", "k", r(F.col("value")).alias("value"))


LEVEL = number(volumes.iso_level(400.0, 1.0))


@query("iso_threshold", sql("vox", f"SELECT i, j, k FROM vox WHERE value - 880 > {LEVEL}"))
def iso_threshold(spark, sf):
    rows = fx.voxels(spark, sf).withColumn("value", F.col("value") - 880)
    return volumes.iso_threshold(rows, 400.0, 1.0).select("i", "j", "k")




@query("blend_volume_layers", sql("vox", f"""
    WITH t AS (SELECT i, j, k, LEAST(1, GREATEST(0, (value - 900) / 200e0)) AS a, LEAST(1, GREATEST(0, (label - 0) / 8e0)) AS b, label >= 2 AS seen FROM vox),
    c AS (SELECT *, LEAST(1, GREATEST(0, b * 2.5e0)) AS hr, LEAST(1, GREATEST(0, b * 2.5e0 - 1)) AS hg, LEAST(1, GREATEST(0, b * 5e0 - 4)) AS hb, 0.8e0 * b AS o FROM t)
    SELECT i, j, k, {R('CASE WHEN seen THEN hr * o + a * (1 - o) ELSE a END')} AS r, {R('CASE WHEN seen THEN hg * o + a * (1 - o) ELSE a END')} AS g,
    {R('CASE WHEN seen THEN hb * o + a * (1 - o) ELSE a END')} AS b, 1e0 AS a FROM c"""))
def blend_volume_layers(spark, sf):
    grid = fx.grid(spark, sf)
    base = volumes.VolumeLayer(fx.voxels(spark, sf), grid, "grayscale", 1000.0, 200.0)
    labels = fx.parcels(spark, sf).withColumnRenamed("label", "value")
    over = volumes.VolumeLayer(labels, grid, "hot", 4.0, 8.0, threshold_min=2.0, opacity=0.8, interpolation="nearest")
    out = volumes.blend_volume_layers(spark, [base, over])
    return out.select("i", "j", "k", *[r(F.col(c)).alias(c) for c in "rgb"], "a")


# --- scalar functions ---------------------------------------------------------------


@query("voxel_to_world", sql("vox", "SELECT i, j, k, i * 2e0 + j * -0.5e0 + 3 AS x, j * 2.5e0 - 7 AS y, i * 0.25e0 + k * 3e0 AS z FROM vox"))
def voxel_to_world(spark, sf):
    grid = geo.Grid(1, 1, 1, (2.0, -0.5, 0, 3.0, 0, 2.5, 0, -7.0, 0.25, 0, 3.0, 0, 0, 0, 0, 1))
    world = geo.voxel_to_world(grid, F.col("i"), F.col("j"), F.col("k"))
    return fx.voxels(spark, sf).select("i", "j", "k", *[w.alias(c) for w, c in zip(world, "xyz")])


@query("world_to_voxel", sql("pts", f"SELECT streamline_id, point_idx, {R('(x - 3) / 2e0')} AS i, {R('(y + 7) / 2.5e0')} AS j, {R('z / 4e0')} AS k FROM pts"))
def world_to_voxel(spark, sf):
    grid = geo.Grid(1, 1, 1, (2.0, 0, 0, 3.0, 0, 2.5, 0, -7.0, 0, 0, 4.0, 0, 0, 0, 0, 1))
    back = geo.world_to_voxel(grid, F.col("x"), F.col("y"), F.col("z"))
    return fx.points(spark, sf).select(*POINT, *[r(v).alias(n) for v, n in zip(back, "ijk")])


QF = """WITH h AS (SELECT s_suppkey, (s_suppkey % 5) / 8e0 AS b, (s_suppkey % 3) / 8e0 AS c, (s_suppkey % 7) / 16e0 AS d, 1 + s_nationkey / 4e0 AS sx, 2e0 AS sy, CASE WHEN s_suppkey % 2 = 0 THEN -1e0 ELSE 1e0 END AS q,
      s_suppkey % 4 AS qform, s_acctbal AS ox FROM supplier)"""


def _headers(spark, sf):
    key = F.col("s_suppkey")
    zero = F.lit(0.0)
    return fx.table(spark, sf, "supplier").select(
        "s_suppkey",
        (F.pmod(key, F.lit(5)) / 8.0).alias("quatern_b"), (F.pmod(key, F.lit(3)) / 8.0).alias("quatern_c"), (F.pmod(key, F.lit(7)) / 16.0).alias("quatern_d"),
        F.when(key % 2 == 0, -1.0).otherwise(1.0).alias("pixdim_0"), (F.lit(1.0) + F.col("s_nationkey") / 4.0).alias("pixdim_1"), F.lit(2.0).alias("pixdim_2"), F.lit(0.0).alias("pixdim_3"),
        F.col("s_acctbal").alias("qoffset_x"), F.lit(1.0).alias("qoffset_y"), F.lit(2.0).alias("qoffset_z"),
        F.pmod(key, F.lit(4)).alias("qform_code"), F.lit(1).alias("sform_code"),
        F.array(F.lit(3.0), zero, zero, F.col("s_acctbal")).alias("srow_x"), F.array(zero, F.lit(4.0), zero, F.lit(5.0)).alias("srow_y"), F.array(zero, zero, F.lit(6.0), F.lit(7.0)).alias("srow_z"),
    )


@query("affine_from_qform", f"""{QF}, a AS (SELECT *, SQRT(1 - (b*b + c*c + d*d)) AS a FROM h)
    SELECT s_suppkey, CASE WHEN qform = 0 THEN 3e0 ELSE {R('(a*a + b*b - c*c - d*d) * sx')} END AS m00, CASE WHEN qform = 0 THEN 0e0 ELSE {R('2 * (b*c - a*d) * sy')} END AS m01,
    CASE WHEN qform = 0 THEN 6e0 ELSE {R('(a*a + d*d - b*b - c*c) * q')} END AS m22, ox AS m03 FROM a""")
def affine_from_qform(spark, sf):
    """Quaternion headers, and every fourth with only the row form."""
    out = geo.header_affines(_headers(spark, sf))
    m = F.col("affine")
    return out.select("s_suppkey", r(m[0]).alias("m00"), r(m[1]).alias("m01"), r(m[10]).alias("m22"), m[3].alias("m03"))


@query("affine_from_sform", "SELECT s_suppkey, 3e0 AS m00, s_acctbal AS m03, 4e0 AS m11, 7e0 AS m23 FROM supplier")
def affine_from_sform(spark, sf):
    m = F.col("affine")
    out = geo.affine_from_sform(_headers(spark, sf))
    return out.select("s_suppkey", m[0].alias("m00"), m[3].alias("m03"), m[5].alias("m11"), m[11].alias("m23"))


@query("min_voxel_size", f"{QF}, a AS (SELECT *, SQRT(1 - (b*b + c*c + d*d)) AS a FROM h) SELECT s_suppkey, CASE WHEN qform = 0 THEN 3e0 ELSE {R('LEAST(sx, sy, 1e0)')} END AS size_mm FROM a")
def min_voxel_size(spark, sf):
    out = geo.header_affines(_headers(spark, sf))
    return out.select("s_suppkey", r(geo.min_voxel_size_column(F.col("affine"))).alias("size_mm"))


# Slice position of an oblique grid: axial slice k at the centre of a 10 x 10 layer.
@query("slice_world_position", sql("vox", f"SELECT i, j, k, {R('4.5 * 0.25e0 + k * 3e0')} AS z FROM vox"))
def slice_world_position(spark, sf):
    grid = geo.Grid(10, 10, 20, (2.0, -0.5, 0, 3.0, 0, 2.5, 0, -7.0, 0.25, 0, 3.0, 0, 0, 0, 0, 1))
    return fx.voxels(spark, sf).select("i", "j", "k", r(geo.slice_world_position(grid, 0, F.col("k"))).alias("z"))


@query("nearest_slice_index", sql("pts", "SELECT streamline_id, point_idx, CAST(LEAST(19, GREATEST(0, ROUND((z - 1.125e0) / 3e0))) AS INT) AS k FROM pts"))
def nearest_slice_index(spark, sf):
    grid = geo.Grid(10, 10, 20, (2.0, -0.5, 0, 3.0, 0, 2.5, 0, -7.0, 0.25, 0, 3.0, 0, 0, 0, 0, 1))
    return fx.points(spark, sf).select(*POINT, geo.nearest_slice_index(grid, 0, F.col("z")).alias("k"))


@query("flat_index", sql("vox", "SELECT i, j, k, CAST(i + j * 10 + k * 100 AS BIGINT) AS flat FROM vox"))
def flat_index(spark, sf):
    return fx.voxels(spark, sf).select("i", "j", "k", geo.flat_index(F.col("i"), F.col("j"), F.col("k"), 10, 10).alias("flat"))


@query("unflatten", "SELECT p_partkey, CAST(p_partkey % 7 AS INT) AS i, CAST(FLOOR(p_partkey / 7) AS INT) % 11 AS j, CAST(FLOOR(p_partkey / 77) AS INT) AS k FROM part")
def unflatten(spark, sf):
    ijk = geo.unflatten(F.col("p_partkey"), 7, 11)
    return fx.table(spark, sf, "part").select("p_partkey", *[v.alias(n) for v, n in zip(ijk, "ijk")])


@query("window_level", sql("pts", f"SELECT streamline_id, point_idx, {R('LEAST(1, GREATEST(0, (dpv - 20000) / 40000e0))')} AS t FROM pts"))
def window_level(spark, sf):
    return fx.points(spark, sf).select(*POINT, r(color.window_level(F.col("dpv"), 20000.0, 60000.0)).alias("t"))


@query("piecewise_gate", sql("pvr vox", f"""SELECT streamline_id, point_idx, {R('CASE WHEN value IS NULL THEN 1e0 WHEN value <= 920 THEN 0.5e0 WHEN value >= 1000 THEN 1.5e0 ELSE 0.5e0 + (value - 920) / 80e0 * 1e0 END')} AS size
    FROM pvr LEFT JOIN vox USING (i, j, k)"""))
def piecewise_gate(spark, sf):
    rows = sampling.sample_nearest(fx.points(spark, sf), fx.voxels(spark, sf), fx.grid(spark, sf), outside=float("nan"))
    return rows.select(*POINT, r(color.piecewise_gate(F.col("value"), 920.0, 1000.0, 0.5, 1.5)).alias("size"))


def stops_sql(t: str, name: str, channel: int) -> str:
    """Linear interpolation between the stops of a colour map."""
    stops = [number(s[channel]) for s in color.STOPS[name]]
    n = len(stops)
    at = f"LEAST({n - 2}, CAST(FLOOR(({t}) * {n - 1}e0) AS INT))"
    table = "[" + ", ".join(stops) + "]"
    return f"({table}[{at} + 1] + ({table}[{at} + 2] - {table}[{at} + 1]) * (({t}) * {n - 1}e0 - FLOOR(({t}) * {n - 1}e0)))"


@query("map_colors", sql("pts", "SELECT streamline_id, point_idx, " + ", ".join(
    f"{R(stops_sql('LEAST(1e0, GREATEST(0e0, (dpv - 20000) / 40000e0))', n, c))} AS {n}_{a}" for n in ("viridis", "inferno") for c, a in enumerate("rgb")) + " FROM pts"))
def map_colors(spark, sf):
    t = color.window_level(F.col("dpv"), 20000.0, 60000.0)
    columns = [r(color.map_colors(t, n)[c]).alias(f"{n}_{c}") for n in ("viridis", "inferno") for c in "rgb"]
    return fx.points(spark, sf).select(*POINT, *columns)


# --- matrices -----------------------------------------------------------------------


@query("cifti_expand_dense", sql("mat bm", "SELECT map_id, structure, vertex, i, j, k, value FROM mat JOIN bm USING (col)"))
def cifti_expand_dense(spark, sf):
    return cifti.expand_dense(fx.cifti_matrix(spark, sf), fx.brain_models(spark, sf))


@query("cifti_densify", sql("mat bm", """WITH n AS (SELECT MAX(s_suppkey) + 1 AS n FROM supplier), v AS (SELECT UNNEST(RANGE((SELECT n FROM n))) AS vertex),
    s AS (SELECT UNNEST(['CORTEX_LEFT', 'CORTEX_RIGHT']) AS structure), m AS (SELECT DISTINCT map_id FROM mat JOIN bm USING (col)), e AS (SELECT * FROM mat JOIN bm USING (col))
    SELECT m.map_id, s.structure, v.vertex, e.value FROM m, s, v LEFT JOIN e ON e.map_id = m.map_id AND e.structure = s.structure AND e.vertex = v.vertex"""))
def cifti_densify(spark, sf):
    """NaN (nothing mapped) is shown as NULL."""
    n = int(fx.table(spark, sf, "supplier").agg(F.max("s_suppkey").alias("m")).first()["m"]) + 1
    expanded = cifti.expand_dense(fx.cifti_matrix(spark, sf), fx.brain_models(spark, sf))
    out = cifti.densify(expanded, {cifti.LEFT: n, cifti.RIGHT: n})
    return out.select("map_id", "structure", "vertex", F.nanvl("value", F.lit(None).cast("double")).alias("value"))


MEMBERS = "SELECT s_nationkey % 4 AS p, 'CORTEX_LEFT' AS structure, s_suppkey AS vertex FROM supplier UNION ALL SELECT s_nationkey % 6, 'CORTEX_LEFT', s_suppkey + 1 FROM supplier"


@query("cifti_expand_parcels", sql("mat", f"""WITH m AS ({MEMBERS}) SELECT map_id, structure, vertex, ARG_MAX(value, col) AS value FROM mat JOIN m ON mat.col = m.p GROUP BY 1, 2, 3"""))
def cifti_expand_parcels(spark, sf):
    fx.table(spark, sf, "supplier").createOrReplaceTempView("supplier")
    nothing = [F.lit(None).cast("int").alias(n) for n in "ijk"]
    members = spark.sql(MEMBERS).select(F.col("p").cast("long").alias("col"), "structure", "vertex", *nothing)
    out = cifti.expand_parcels(fx.cifti_matrix(spark, sf), members)
    return out.select("map_id", "structure", "vertex", "value")


@query("cifti_structure", sql("mat bm", "SELECT vertex, value FROM mat JOIN bm USING (col) WHERE structure = 'CORTEX_RIGHT' AND map_id = 2"))
def cifti_structure(spark, sf):
    expanded = cifti.expand_dense(fx.cifti_matrix(spark, sf), fx.brain_models(spark, sf))
    return cifti.cifti_structure(expanded, cifti.RIGHT, 2).select("vertex", "value")


@query("series_values", sql("mat", "SELECT map_id, col, 0.5e0 + 0.75e0 * map_id AS series_value FROM mat"))
def series_values(spark, sf):
    return fx.cifti_matrix(spark, sf).select("map_id", "col", cifti.series_values(F.col("map_id"), 0.5, 0.75).alias("series_value"))


# --- orientation --------------------------------------------------------------------


@query("fixel_slice", sql("odx fix", "SELECT voxel_id, fixel_idx, i, k FROM fix JOIN odx USING (voxel_id) WHERE j = 4"))
def fixel_slice(spark, sf):
    return orientation.fixel_slice(fx.fixels(spark, sf), fx.odx_voxels(spark, sf), 1, 4).select("voxel_id", "fixel_idx", "i", "k")


@query("select_dpf", sql("fix", f"SELECT voxel_id, fixel_idx, {R('qa')} AS value FROM fix"))
def select_dpf(spark, sf):
    from axonframe.operators.selection import select_column

    return select_column(fx.fixels(spark, sf), ["voxel_id", "fixel_idx"], "qa").withColumn("value", r(F.col("value")))


@query("select_dpv", sql("odx", "SELECT voxel_id, fa AS value FROM odx"))
def select_dpv(spark, sf):
    from axonframe.operators.selection import select_column

    rows = fx.odx_voxels(spark, sf)
    return select_column(rows, ["voxel_id", "i", "j", "k"], scalar_catalog(rows)[0]).select("voxel_id", "value")


OTSU = """o AS (SELECT MIN(amplitude) AS lo, MAX(amplitude) AS hi FROM fix), w AS (SELECT *, (hi - lo) / 256e0 AS width FROM o),
    h AS (SELECT LEAST(CAST(FLOOR((amplitude - lo) / width) AS INT), 255) AS bin, COUNT(*) AS n FROM fix, w GROUP BY 1),
    c AS (SELECT bin, SUM(n) OVER (ORDER BY bin) AS w0, SUM(n * (bin + 0.5e0)) OVER (ORDER BY bin) AS m, SUM(n) OVER () AS wt, SUM(n * (bin + 0.5e0)) OVER () AS mt FROM h),
    v AS (SELECT bin, CASE WHEN wt > w0 THEN ROUND(w0 * (wt - w0) * (m / w0 - (mt - m) / (wt - w0)) * (m / w0 - (mt - m) / (wt - w0)), 3) ELSE 0 END AS var FROM c),
    otsu AS (SELECT lo + (bin + 1e0) * width AS threshold FROM v, w ORDER BY var DESC, bin LIMIT 1)"""


@query("otsu_threshold", sql("fix", f"WITH {OTSU} SELECT {R('threshold')} AS threshold FROM otsu"))
def otsu_threshold(spark, sf):
    return orientation.otsu_threshold(fx.fixels(spark, sf)).select(r(F.col("threshold")).alias("threshold"))


@query("fixel_otsu_gate", sql("fix", f"WITH {OTSU} SELECT voxel_id, fixel_idx FROM fix, otsu WHERE amplitude >= threshold"))
def fixel_otsu_gate(spark, sf):
    rows = fx.fixels(spark, sf)
    return orientation.fixel_otsu_gate(rows, orientation.otsu_threshold(rows)).select("voxel_id", "fixel_idx")


@query("primary_peak_volume", sql("odx fix", f"SELECT i, j, k, {R('amplitude')} AS value FROM odx JOIN fix USING (voxel_id) WHERE fixel_idx = 0"))
def primary_peak_volume(spark, sf):
    out = orientation.primary_peak_volume(fx.fixels(spark, sf), fx.odx_voxels(spark, sf), "amplitude")
    return out.select("i", "j", "k", r(F.col("value")).alias("value"))


@query("best_fixel", sql("segu odx fix", f"""WITH d AS (SELECT streamline_id, segment_idx, voxel_id, ux, uy, uz FROM
      (SELECT *, CAST(ROUND(mx * 2e-1) AS INT) AS i, CAST(ROUND(my * 2e-1) AS INT) AS j, CAST(ROUND(mz * 2e-1) AS INT) AS k FROM segu WHERE length > 0) JOIN odx USING (i, j, k)),
    c AS (SELECT streamline_id, segment_idx, fixel_idx, ux*dx + uy*dy + uz*dz AS dot, dx, amplitude FROM d JOIN fix USING (voxel_id))
    SELECT streamline_id, segment_idx, fixel_idx, {R('CASE WHEN dot >= 0 THEN dx ELSE -dx END')} AS x, {R('amplitude')} AS amplitude FROM c
    WHERE ABS(dot) >= 0.8e0 QUALIFY ROW_NUMBER() OVER (PARTITION BY streamline_id, segment_idx ORDER BY ABS(dot) DESC, fixel_idx) = 1"""))
def best_fixel(spark, sf):
    from axonframe.operators.geometry import segments

    segs = segments(fx.points(spark, sf)).filter("length > 0")
    at = segs.select("streamline_id", "segment_idx", *[F.col(f"m{c}").alias(c) for c in "xyz"], *[F.col(f"u{c}").alias(f"d{c}") for c in "xyz"])
    placed = geo.points_to_voxels(at, geo.scaling_grid(10, 10, 1_000_000, 5.0), "round")
    dirs = placed.join(fx.odx_voxels(spark, sf).select("voxel_id", "i", "j", "k").distinct(), ["i", "j", "k"])
    out = orientation.best_fixel(dirs, fx.fixels(spark, sf), 0.8, ["streamline_id", "segment_idx"])
    return out.select("streamline_id", "segment_idx", "fixel_idx", r(F.col("x")).alias("x"), r(F.col("amplitude")).alias("amplitude"))


@query("color_fixels", sql("fix", f"""WITH s AS (SELECT MIN(qa) AS lo, MAX(qa) AS hi FROM fix), t AS (SELECT voxel_id, fixel_idx, LEAST(1e0, GREATEST(0e0, (qa - lo) / GREATEST(hi - lo, 1e-6))) AS t FROM fix, s)
    SELECT voxel_id, fixel_idx, {R(stops_sql('t', 'inferno', 0))} AS r, {R(stops_sql('t', 'inferno', 1))} AS g, {R(stops_sql('t', 'inferno', 2))} AS b FROM t"""))
def color_fixels(spark, sf):
    rows = fx.fixels(spark, sf)
    scalars = rows.select("voxel_id", "fixel_idx", F.col("qa").alias("value"))
    out = orientation.color_fixels(rows, scalars)
    return out.select("voxel_id", "fixel_idx", *[r(F.col(c)).alias(c) for c in "rgb"])


@query("color_fixels_direction", sql("fix", f"SELECT voxel_id, fixel_idx, {R('ABS(dx)')} AS r, {R('ABS(dy)')} AS g, {R('ABS(dz)')} AS b FROM fix"))
def color_fixels_direction(spark, sf):
    out = orientation.color_fixels(fx.fixels(spark, sf))
    return out.select("voxel_id", "fixel_idx", *[r(F.col(c)).alias(c) for c in "rgb"])


@query("odf_mirror", sql("emb", f"SELECT voxel_id, CAST(p AS INT) AS pos, {R('amps[p % LEN(amps) + 1]')} AS amp FROM emb, (SELECT UNNEST(RANGE(128)) AS p) WHERE p < 2 * LEN(amps)"))
def odf_mirror(spark, sf):
    rows = fx.amplitudes(spark, sf).select("voxel_id", F.posexplode(orientation.odf_mirror(F.col("amps"))).alias("pos", "amp"))
    return rows.withColumn("amp", r(F.col("amp")))


@query("odf_condition", sql("emb", f"SELECT voxel_id, CAST(p AS INT) AS pos, {R('(amps[p + 1] - LIST_MIN(amps)) * (2e0 / (LIST_MAX(amps) - LIST_MIN(amps)))')} AS amp FROM emb, (SELECT UNNEST(RANGE(64)) AS p)"))
def odf_condition(spark, sf):
    amps = orientation.odf_condition(F.col("amps"), target_mm=2.0)
    rows = fx.amplitudes(spark, sf).select("voxel_id", F.posexplode(amps).alias("pos", "amp"))
    return rows.withColumn("amp", r(F.col("amp")))


BASIS = [[((d * 7 + c * 3) % 11 - 5) / 8.0 for c in range(15)] for d in range(12)]
BASIS_SQL = "[" + ", ".join("[" + ", ".join(number(v) for v in row) + "]" for row in BASIS) + "]"


@query("sh_to_amplitudes", sql("emb", f"SELECT voxel_id, CAST(d AS INT) AS dir, {R(f'GREATEST(0, SUM(amps[c + 1] * ({BASIS_SQL})[d + 1][c + 1]))')} AS amp FROM emb, (SELECT UNNEST(RANGE(12)) AS d), (SELECT UNNEST(RANGE(15)) AS c) GROUP BY 1, 2"))
def sh_to_amplitudes(spark, sf):
    """The first 15 amplitudes as coefficients against a fixed 12 x 15 basis."""
    amps = orientation.sh_to_amplitudes(F.slice("amps", 1, 15), BASIS)
    rows = fx.amplitudes(spark, sf).select("voxel_id", F.posexplode(amps).alias("dir", "amp"))
    return rows.withColumn("amp", r(F.col("amp")))
