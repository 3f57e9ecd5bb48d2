"""Registered queries: surfaces, densities, direction fields, colours, pruning and plans."""

from __future__ import annotations

from pyspark.sql import functions as F

from axonframe.functions import geometry as geo
from axonframe.functions.scan import cut_lineage, small_table
from axonframe.functions.sphere import icosphere, nearest_bin, neighbour_pairs
from axonframe.operators import coloring, fields, pruning, selection, shapes, surfaces
from axonframe.operators import geometry as og
from axonframe.operators.volumes import iso_level
from axonframe.plans import classify, envelope, reference, roi, rules
from axonframe.queries import fixtures as fx
from axonframe.queries.fixtures import R, number, query, r, sql
from axonframe.queries.voxel_queries import KER, POINT, stops_sql
from axonframe.sources import catalog
from axonframe.streaming import density as streaming

VOXEL_MM = 4.0

# --- surfaces -----------------------------------------------------------------------

NV = """nv AS (SELECT p.streamline_id, p.point_idx, s.vertex_id, (p.x-s.x)*(p.x-s.x) + (p.y-s.y)*(p.y-s.y) + (p.z-s.z)*(p.z-s.z) AS d2
    FROM pts p JOIN srf s ON s.x BETWEEN p.x - 4 AND p.x + 4 AND s.y BETWEEN p.y - 4 AND p.y + 4 AND s.z BETWEEN p.z - 4 AND p.z + 4
    WHERE (p.x-s.x)*(p.x-s.x) + (p.y-s.y)*(p.y-s.y) + (p.z-s.z)*(p.z-s.z) <= 16
    QUALIFY ROW_NUMBER() OVER (PARTITION BY p.streamline_id, p.point_idx ORDER BY d2, s.vertex_id) = 1)"""


@query("nearest_vertex", sql("pts srf", f"WITH {NV} SELECT streamline_id, point_idx, vertex_id, d2 FROM nv"))
def nearest_vertex(spark, sf):
    return surfaces.nearest_vertex(fx.points(spark, sf), fx.surface(spark, sf), 4.0)


@query("surface_density", sql("pts srf", f"WITH {NV} SELECT srf.vertex_id, CAST(COUNT(nv.vertex_id) AS BIGINT) AS density FROM srf LEFT JOIN nv USING (vertex_id) GROUP BY 1"))
def surface_density(spark, sf):
    return surfaces.surface_density(fx.points(spark, sf), fx.surface(spark, sf), 4.0)


@query("surface_density_streamlines", sql("pts srf", f"WITH {NV} SELECT srf.vertex_id, CAST(COUNT(DISTINCT nv.streamline_id) AS BIGINT) AS density FROM srf LEFT JOIN nv USING (vertex_id) GROUP BY 1"))
def surface_density_streamlines(spark, sf):
    return surfaces.surface_density(fx.points(spark, sf), fx.surface(spark, sf), 4.0, distinct_streamlines=True)


@query("surface_mean_dps", sql("pts srf dps", f"WITH {NV} SELECT srf.vertex_id, {R('AVG(CASE WHEN nv.vertex_id IS NOT NULL THEN COALESCE(value, 0) END)', 4)} AS mean_value FROM srf LEFT JOIN nv USING (vertex_id) LEFT JOIN dps USING (streamline_id) GROUP BY 1"))
def surface_mean_dps(spark, sf):
    """NaN (no contact) is shown as NULL."""
    out = surfaces.surface_mean_dps(fx.points(spark, sf), fx.surface(spark, sf), 4.0, fx.dps(spark, sf), "price")
    return out.select("vertex_id", r(F.nanvl("mean_value", F.lit(None).cast("double")), 4).alias("mean_value"))


CNV = """nv AS (SELECT subject_id, p.streamline_id, p.point_idx, s.vertex_id, (p.x-s.x)*(p.x-s.x) + (p.y-s.y)*(p.y-s.y) + (p.z-s.z)*(p.z-s.z) AS d2
    FROM cpts p JOIN csrf s USING (subject_id) WHERE s.x BETWEEN p.x - 6 AND p.x + 6 AND (p.x-s.x)*(p.x-s.x) + (p.y-s.y)*(p.y-s.y) + (p.z-s.z)*(p.z-s.z) <= 36
    QUALIFY ROW_NUMBER() OVER (PARTITION BY subject_id, p.streamline_id, p.point_idx ORDER BY d2, s.vertex_id) = 1)"""


def _cohort_surface(spark, sf):
    return fx.by_subject(fx.points(spark, sf)), fx.by_subject(fx.surface(spark, sf), "vertex_id")


@query("nearest_vertex_cohort", sql("cpts csrf", f"WITH {CNV} SELECT subject_id, streamline_id, point_idx, vertex_id, d2 FROM nv"))
def nearest_vertex_cohort(spark, sf):
    return surfaces.nearest_vertex(*_cohort_surface(spark, sf), 6.0)


@query("surface_density_cohort", sql("cpts csrf", f"WITH {CNV} SELECT subject_id, vertex_id, CAST(COUNT(nv.vertex_id) AS BIGINT) AS density FROM csrf LEFT JOIN nv USING (subject_id, vertex_id) GROUP BY 1, 2"))
def surface_density_cohort(spark, sf):
    return surfaces.surface_density(*_cohort_surface(spark, sf), 6.0)


@query("surface_mean_dps_cohort", sql("cpts csrf cdps", f"WITH {CNV} SELECT subject_id, vertex_id, {R('AVG(CASE WHEN streamline_id IS NOT NULL THEN COALESCE(value, 0) END)', 4)} AS mean_value FROM csrf LEFT JOIN nv USING (subject_id, vertex_id) LEFT JOIN cdps USING (subject_id, streamline_id) GROUP BY 1, 2"))
def surface_mean_dps_cohort(spark, sf):
    """NaN (no contact) is shown as NULL."""
    out = surfaces.surface_mean_dps(*_cohort_surface(spark, sf), 6.0, fx.by_subject(fx.dps(spark, sf)), "price")
    return out.select("subject_id", "vertex_id", r(F.nanvl("mean_value", F.lit(None).cast("double")), 4).alias("mean_value"))


NORMAL = """(by_-ay)*(cz-az) - (bz-az)*(cy-ay) AS nx, (bz-az)*(cx-ax) - (bx-ax)*(cz-az) AS ny, (bx-ax)*(cy-ay) - (by_-ay)*(cx-ax) AS nz"""


@query("vertex_normals", sql("corner", f"""WITH f AS (SELECT tri_id, {NORMAL} FROM corner), v AS (SELECT tri_id + d AS vertex_id, nx, ny, nz FROM f, (SELECT UNNEST([0, 1, 2]) AS d)),
    s AS (SELECT vertex_id, SUM(nx) AS nx, SUM(ny) AS ny, SUM(nz) AS nz FROM v GROUP BY 1), l AS (SELECT *, SQRT(nx*nx + ny*ny + nz*nz) AS l FROM s)
    SELECT srf.vertex_id, {R('CASE WHEN l > 0 THEN nx / l ELSE 0 END')} AS nx, {R('CASE WHEN l > 0 THEN ny / l ELSE 0 END')} AS ny, {R('CASE WHEN l > 0 THEN nz / l ELSE 0 END')} AS nz FROM srf LEFT JOIN l USING (vertex_id)"""))
def vertex_normals(spark, sf):
    out = surfaces.vertex_normals(fx.surface(spark, sf), fx.triangles(spark, sf))
    return out.select("vertex_id", *[r(F.col(f"n{c}")).alias(f"n{c}") for c in "xyz"])


SIGNED = "(ax*(by_*cz - bz*cy) + ay*(bz*cx - bx*cz) + az*(bx*cy - by_*cx)) / 6e0"


@query("component_volume", sql("corner", f"SELECT CAST(tri_id % 5 AS BIGINT) AS component, {R(f'ABS(SUM({SIGNED}))', 4)} AS volume_mm3, CAST(COUNT(*) AS BIGINT) AS n_triangles FROM corner GROUP BY 1"))
def component_volume(spark, sf):
    corners = surfaces.triangle_corners(fx.triangles(spark, sf), fx.surface(spark, sf))
    out = surfaces.component_volume(corners.withColumn("component", F.pmod("tri_id", F.lit(5))))
    return out.select("component", r(F.col("volume_mm3"), 4).alias("volume_mm3"), "n_triangles")


def _components_sql(on: str, least: int) -> str:
    """Triangles that share a corner position, by way of others too; ``on`` names the surface."""
    key = f"{on}, " if on else ""
    same = f"USING ({key}k)"
    step = " AND ".join(f"e.{c} = w.{c}" for c in ([on] if on else []) + ["u"]).replace("w.u", "w.n")
    return f"""p AS (SELECT {key}tri_id, UNNEST([ax || ',' || ay || ',' || az, bx || ',' || by_ || ',' || bz, cx || ',' || cy || ',' || cz]) AS k FROM t),
    e AS (SELECT DISTINCT {key}a.tri_id AS u, b.tri_id AS v FROM p a JOIN p b {same}),
    w AS (SELECT {key}tri_id AS s, tri_id AS n FROM t UNION SELECT {'w.' + on + ', ' if on else ''}w.s, e.v FROM w JOIN e ON {step}),
    c AS (SELECT {key}n AS tri_id, MIN(s) AS component FROM w GROUP BY ALL),
    s AS (SELECT {key}component, ABS(SUM({SIGNED})) AS v, COUNT(*) AS n FROM c JOIN t USING ({key}tri_id) GROUP BY ALL)
    SELECT {key}tri_id, component, {R('v', 4)} AS volume_mm3, CAST(n AS BIGINT) AS n_triangles FROM c JOIN s USING ({key}component) WHERE v >= {least}"""


@query("mesh_components", sql("corner", f"WITH t AS (SELECT * FROM corner), {_components_sql('', 50)}", recursive=True))
def mesh_components(spark, sf):
    out = surfaces.mesh_components(fx.triangles(spark, sf), fx.surface(spark, sf), 50.0)
    return out.withColumn("volume_mm3", r(F.col("volume_mm3"), 4))


# The triangles of each nation's suppliers are a surface of their own.
@query("mesh_components_surfaces", sql("corner", f"WITH t AS (SELECT corner.*, 'n' || s_nationkey AS surface_id FROM corner JOIN supplier ON s_suppkey = tri_id), {_components_sql('surface_id', 0)}", recursive=True))
def mesh_components_surfaces(spark, sf):
    owner = fx.table(spark, sf, "supplier").select(F.col("s_suppkey").alias("tri_id"), F.concat(F.lit("n"), F.col("s_nationkey").cast("string")).alias("surface_id"))
    triangles = fx.triangles(spark, sf).join(owner, "tri_id")
    corners = triangles.select("surface_id", F.explode(F.array("v0", "v1", "v2")).alias("vertex_id")).distinct()
    out = surfaces.mesh_components(triangles, corners.join(fx.surface(spark, sf), "vertex_id"))
    return out.withColumn("volume_mm3", r(F.col("volume_mm3"), 4))


@query("mesh_plane_segments", sql("corner", f"""WITH e AS (SELECT tri_id, 0 AS n, ax AS px, ay AS py, az AS pz, bx AS qx, by_ AS qy, bz AS qz FROM corner UNION ALL SELECT tri_id, 1, bx, by_, bz, cx, cy, cz FROM corner
      UNION ALL SELECT tri_id, 2, cx, cy, cz, ax, ay, az FROM corner),
    h AS (SELECT tri_id, n, px + (qx - px) * ((pz - 25) / (pz - qz)) AS x, py + (qy - py) * ((pz - 25) / (pz - qz)) AS y FROM e WHERE (pz - 25) * (qz - 25) < 0)
    SELECT tri_id, {R('ARG_MIN(x, n)')} AS ax, {R('ARG_MIN(y, n)')} AS ay, {R('ARG_MAX(x, n)')} AS bx, {R('ARG_MAX(y, n)')} AS by FROM h GROUP BY 1 HAVING COUNT(*) = 2"""))
def mesh_plane_segments(spark, sf):
    out = surfaces.mesh_plane_segments(fx.triangles(spark, sf), fx.surface(spark, sf), 0, 25.0)
    return out.select("tri_id", *[r(F.col(c)).alias(c) for c in ("ax", "ay", "bx", "by")])


def _blend_sql() -> str:
    t = "LEAST(1e0, GREATEST(0e0, s_acctbal / 8000e0))"
    out = []
    for n, c in enumerate("rgb"):
        scalar = f"(CASE WHEN s_acctbal >= 500 THEN {[0.2, 0.4, 0.6][n]}e0 * 0.3e0 + {stops_sql(t, 'viridis', n)} * 0.7e0 ELSE {[0.2, 0.4, 0.6][n]}e0 END)"
        label = f"(CASE WHEN s_nationkey % 4 = 1 THEN {scalar} * 0.5e0 + {[1, 0, 0][n]} * 0.5e0 WHEN s_nationkey % 4 = 2 THEN {scalar} * 0e0 + {[0, 1, 0][n]} * 1e0 ELSE {scalar} END)"
        out.append(f"{R(label)} AS {c}")
    return f"SELECT s_suppkey AS vertex_id, {', '.join(out)} FROM supplier"


@query("blend_surface_layers", _blend_sql())
def blend_surface_layers(spark, sf):
    rows = fx.table(spark, sf, "supplier")
    scalar = rows.select(F.col("s_suppkey").alias("vertex_id"), F.col("s_acctbal").alias("value"))
    label = rows.select(F.col("s_suppkey").alias("vertex_id"), F.pmod("s_nationkey", F.lit(4)).alias("value"))
    colors = small_table(spark, [(1, 1.0, 0.0, 0.0, 0.5), (2, 0.0, 1.0, 0.0, 1.0)], "label int, r double, g double, b double, a double")
    layers = [
        surfaces.SurfaceLayer(scalar, "viridis", 0.0, 8000.0, threshold_min=500.0, opacity=0.7),
        surfaces.SurfaceLayer(label, labels=colors),
    ]
    out = surfaces.blend_surface_layers(fx.surface(spark, sf), layers, (0.2, 0.4, 0.6, 1.0))
    return out.select("vertex_id", *[r(F.col(c)).alias(c) for c in "rgb"])


# --- densities ----------------------------------------------------------------------

AT = "CAST(FLOOR(({0} - ({1} - {2}e0)) / {3}e0) AS INT) AS {4}"


def place_sql(xyz: tuple[str, str, str], pad: float, size: float) -> str:
    return ", ".join(AT.format(c, b, pad * size, size, n) for c, b, n in zip(xyz, ("ax", "ay", "az"), "ijk"))


@query("voxel_density", sql("tan box", f"""SELECT i, j, k, CAST(COUNT(*) AS BIGINT) AS density, {R('SUM(ABS(tx))', 5)} AS sum_r, {R('SUM(ABS(tz))', 5)} AS sum_b,
    {R('SUM(CASE WHEN l > 0 THEN (tx / l) * (tx / l) ELSE 0 END)', 5)} AS sum_xx, {R('SUM(CASE WHEN l > 0 THEN (ABS(ty) / l) * (ABS(tz) / l) ELSE 0 END)', 5)} AS sum_yz
    FROM (SELECT *, SQRT(tx*tx + ty*ty + tz*tz) AS l, {place_sql(('x', 'y', 'z'), 2, 2.0)} FROM tan, box) GROUP BY 1, 2, 3"""))
def voxel_density(spark, sf):
    out = fields.voxel_density(fx.points(spark, sf), 2.0)
    return out.select("i", "j", "k", "density", *[r(F.col(c), 5).alias(c) for c in ("sum_r", "sum_b", "sum_xx", "sum_yz")])


def visits_sql(points: str, size: float, tag: str = "") -> str:
    """Rasterised voxel changes of a point table on its own padded grid."""
    s = f"{size}e0"
    return f"""bx{tag} AS (SELECT MIN(x) - {s} AS ax, MIN(y) - {s} AS ay, MIN(z) - {s} AS az FROM {points}),
    r{tag} AS (SELECT streamline_id, point_idx, (x - ax) * (1e0 / {s}) AS x, (y - ay) * (1e0 / {s}) AS y, (z - az) * (1e0 / {s}) AS z FROM {points}, bx{tag}),
    e{tag} AS (SELECT *, CAST(CEIL(GREATEST(ABS(nx - x), ABS(ny - y), ABS(nz - z))) AS INT) AS steps FROM (SELECT *, LEAD(x) OVER w AS nx, LEAD(y) OVER w AS ny, LEAD(z) OVER w AS nz FROM r{tag}
        WINDOW w AS (PARTITION BY streamline_id ORDER BY point_idx)) WHERE nx IS NOT NULL),
    u{tag} AS (SELECT *, UNNEST(RANGE(steps + 1)) AS s FROM e{tag}),
    v{tag} AS (SELECT streamline_id, point_idx, s, CAST(FLOOR(x + (nx - x) * t) AS INT) AS i, CAST(FLOOR(y + (ny - y) * t) AS INT) AS j, CAST(FLOOR(z + (nz - z) * t) AS INT) AS k
        FROM (SELECT *, s * (1e0 / GREATEST(steps, 1)) AS t FROM u{tag})),
    visit{tag} AS (SELECT streamline_id, i, j, k FROM v{tag} WINDOW q AS (PARTITION BY streamline_id ORDER BY point_idx, s) QUALIFY LAG(i) OVER q IS NULL OR LAG(i) OVER q <> i OR LAG(j) OVER q <> j OR LAG(k) OVER q <> k)"""


@query("visit_density", sql("pts", f"WITH {visits_sql('pts', 2.0)} SELECT i, j, k, CAST(COUNT(*) AS BIGINT) AS density FROM visit GROUP BY 1, 2, 3"))
def visit_density(spark, sf):
    return fields.visit_density(fx.points(spark, sf), 2.0)


@query("voxelize_streamlines", sql("near dims", """WITH e AS (SELECT *, CAST(CEIL(GREATEST(ABS(nx*2e-1 - x*2e-1), ABS(ny*2e-1 - y*2e-1), ABS(nz*2e-1 - z*2e-1))) AS INT) AS steps FROM near WHERE nx IS NOT NULL),
    u AS (SELECT *, UNNEST(RANGE(steps + 1)) AS s FROM e), t AS (SELECT *, s * (1e0 / GREATEST(steps, 1)) AS t FROM u),
    v AS (SELECT DISTINCT CAST(FLOOR(x*2e-1 + (nx*2e-1 - x*2e-1) * t) AS INT) AS i, CAST(FLOOR(y*2e-1 + (ny*2e-1 - y*2e-1) * t) AS INT) AS j, CAST(FLOOR(z*2e-1 + (nz*2e-1 - z*2e-1) * t) AS INT) AS k FROM t)
    SELECT i, j, k FROM v WHERE i BETWEEN 0 AND 9 AND j BETWEEN 0 AND 9 AND k BETWEEN 0 AND (SELECT nz FROM dims) - 1"""))
def voxelize_streamlines(spark, sf):
    return og.voxelize_streamlines(fx.points(spark, sf), fx.grid(spark, sf))


# --- direction fields ---------------------------------------------------------------


def bins_sql(detail: int) -> str:
    rows = ", ".join(f"({n}, {number(d[0])}, {number(d[1])}, {number(d[2])})" for n, d in enumerate(icosphere(detail)[0].tolist()))
    return f"bins AS (SELECT * FROM (VALUES {rows}) t(bin, bx, by_, bz))"


def pairs_sql(detail: int) -> str:
    rows = ", ".join(f"({a},{b})" for a, b in neighbour_pairs(detail))
    return f"nb AS (SELECT * FROM (VALUES {rows}) t(bin, neighbour)), deg AS (SELECT bin AS neighbour, COUNT(*) AS deg FROM nb GROUP BY 1)"


def pick_sql(source: str, key: str, x: str, y: str, z: str) -> str:
    """Bin of the largest dot product per distinct direction, first one on ties."""
    return f"""(SELECT {key}, bin FROM (SELECT {key}, bin, ({x}) * bx + ({y}) * by_ + ({z}) * bz AS dot FROM {source}, bins)
        QUALIFY ROW_NUMBER() OVER (PARTITION BY {key} ORDER BY dot DESC, bin) = 1)"""


DETAIL = 3
DIRS = "dirs AS (SELECT DISTINCT ux, uy, uz FROM segu WHERE length >= 1e-6)"
FIELD = f"""{bins_sql(DETAIL)}, {DIRS},
    plus AS {pick_sql('dirs', 'ux, uy, uz', 'ux', 'uy', 'uz')}, minus AS {pick_sql('dirs', 'ux, uy, uz', '-ux', '-uy', '-uz')},
    seat AS (SELECT segu.*, {place_sql(('mx', 'my', 'mz'), 1, VOXEL_MM)} FROM segu, box WHERE length >= 1e-6),
    field AS (SELECT i, j, k, bin, SUM(length) AS weight FROM (SELECT i, j, k, bin, length FROM seat JOIN plus USING (ux, uy, uz)
      UNION ALL SELECT i, j, k, m.bin, length FROM seat JOIN minus m USING (ux, uy, uz) JOIN plus p USING (ux, uy, uz) WHERE m.bin <> p.bin) GROUP BY 1, 2, 3, 4)"""
SMOOTH = f"""{pairs_sql(DETAIL)}, give AS (SELECT bin, neighbour, 0.35e0 / deg AS g FROM nb JOIN deg USING (neighbour)),
    s1 AS (SELECT i, j, k, bin, SUM(weight) AS weight FROM (SELECT i, j, k, bin, weight * 0.65e0 AS weight FROM field UNION ALL SELECT i, j, k, neighbour, weight * g FROM field JOIN give USING (bin)) GROUP BY 1, 2, 3, 4),
    s2 AS (SELECT i, j, k, bin, SUM(weight) AS weight FROM (SELECT i, j, k, bin, weight * 0.65e0 AS weight FROM s1 UNION ALL SELECT i, j, k, neighbour, weight * g FROM s1 JOIN give USING (bin)) GROUP BY 1, 2, 3, 4)"""


@query("nearest_bin", sql("segu", f"WITH {bins_sql(DETAIL)}, {DIRS} SELECT ux, uy, CAST(bin AS INT) AS bin FROM {pick_sql('dirs', 'ux, uy, uz', 'ux', 'uy', 'uz')}"))
def nearest_bin_query(spark, sf):
    dirs = og.segments(fx.points(spark, sf)).filter("length >= 1e-6").select("ux", "uy", "uz").distinct()
    return dirs.select("ux", "uy", nearest_bin(F.col("ux"), F.col("uy"), F.col("uz"), DETAIL).alias("bin"))


@query("direction_field", sql("segu box", f"WITH {FIELD} SELECT i, j, k, CAST(bin AS INT) AS bin, {R('weight')} AS weight FROM field"))
def direction_field(spark, sf):
    out = fields.direction_field(fx.points(spark, sf), VOXEL_MM, "tangent", DETAIL)
    return out.withColumn("weight", r(F.col("weight")))


def _cross_sql() -> str:
    """Votes of both ends of a segment whose ends lie in different voxels."""
    low = [f"({a} - {VOXEL_MM}e0)" for a in ("ax", "ay", "az")]
    votes = []
    for s, e in (("0", "1"), ("1", "0")):
        tests = []
        for a, c in enumerate("xyz"):
            d = f"({c}{e} - {c}{s})"
            lo = f"({low[a]} + v{s}{c} * {VOXEL_MM}e0)"
            t = f"((CASE WHEN {d} > 0 THEN {lo} + {VOXEL_MM}e0 ELSE {lo} END - {c}{s}) / NULLIF({d}, 0))"
            inner = [f"ABS({d}) > 1e-8", f"{t} >= 1e-5", f"{t} <= 1"]
            for b, o in enumerate("xyz"):
                if o != c:
                    lob = f"({low[b]} + v{s}{o} * {VOXEL_MM}e0)"
                    q = f"({o}{s} + ({o}{e} - {o}{s}) * {t})"
                    inner += [f"{q} >= {lob} - 1e-4", f"{q} <= {lob} + {VOXEL_MM}e0 + 1e-4"]
            tests.append("COALESCE(" + " AND ".join(inner) + ", FALSE)")
        votes.append(f"SELECT ux, uy, uz, v{s}x AS i, v{s}y AS j, v{s}z AS k FROM c WHERE " + " OR ".join(tests))
    seats = ", ".join(
        f"CAST(FLOOR(({c}{e} - {low[a]}) / {VOXEL_MM}e0) AS INT) AS v{e}{c}" for e in "01" for a, c in enumerate("xyz")
    )
    return f"""WITH {bins_sql(DETAIL)}, {DIRS}, plus AS {pick_sql('dirs', 'ux, uy, uz', 'ux', 'uy', 'uz')},
    c AS (SELECT * FROM (SELECT segu.*, box.ax, box.ay, box.az, {seats} FROM segu, box WHERE length >= 1e-6) WHERE v0x <> v1x OR v0y <> v1y OR v0z <> v1z),
    votes AS ({votes[0]} UNION ALL {votes[1]})
    SELECT i, j, k, CAST(bin AS INT) AS bin, CAST(COUNT(*) AS DOUBLE) AS weight FROM votes JOIN plus USING (ux, uy, uz) GROUP BY 1, 2, 3, 4"""


@query("direction_field_crossings", sql("segu box", _cross_sql()))
def direction_field_crossings(spark, sf):
    return fields.direction_field(fx.points(spark, sf), VOXEL_MM, "crossings", DETAIL)


SUMMARY = f"""seat AS (SELECT segu.*, {place_sql(('mx', 'my', 'mz'), 1, VOXEL_MM)}, CASE WHEN uz >= 0 THEN 1e0 ELSE -1e0 END AS f FROM segu, box WHERE length >= 1e-6),
    summ AS (SELECT i, j, k, CAST(COUNT(*) AS BIGINT) AS n_contacts, SUM(ux * f * length) AS vx, SUM(uy * f * length) AS vy, SUM(uz * f * length) AS vz, SUM(ux*ux*length) AS xx, SUM(ux*uy*length) AS xy,
      SUM(ux*uz*length) AS xz, SUM(uy*uy*length) AS yy, SUM(uy*uz*length) AS yz, SUM(uz*uz*length) AS zz FROM seat GROUP BY 1, 2, 3)"""


@query("direction_summary", sql("segu box", f"WITH {SUMMARY} SELECT i, j, k, n_contacts, {R('vx')} AS vx, {R('vz')} AS vz, {R('xx')} AS xx, {R('xy')} AS xy, {R('yz')} AS yz FROM summ"))
def direction_summary(spark, sf):
    out = fields.direction_summary(fx.points(spark, sf), VOXEL_MM)
    return out.select("i", "j", "k", "n_contacts", *[r(F.col(c)).alias(c) for c in ("vx", "vz", "xx", "xy", "yz")])


@query("min_contacts_filter", sql("segu box", f"WITH {SUMMARY} SELECT i, j, k, n_contacts FROM summ WHERE n_contacts >= 5"))
def min_contacts_filter(spark, sf):
    out = fields.min_contacts_filter(fields.direction_summary(fx.points(spark, sf), VOXEL_MM), 5)
    return out.select("i", "j", "k", "n_contacts")


@query("direction_smooth", sql("segu box", f"WITH {FIELD}, {SMOOTH} SELECT i, j, k, CAST(bin AS INT) AS bin, {R('weight')} AS weight FROM s2"))
def direction_smooth(spark, sf):
    field = fields.direction_field(fx.points(spark, sf), VOXEL_MM, "tangent", DETAIL)
    return fields.direction_smooth(field, DETAIL).withColumn("weight", r(F.col("weight")))


@query("direction_normalize", sql("segu box", f"WITH {FIELD} SELECT i, j, k, CAST(bin AS INT) AS bin, {R('weight / SUM(weight) OVER (PARTITION BY i, j, k)')} AS weight FROM field"))
def direction_normalize(spark, sf):
    field = fields.direction_field(fx.points(spark, sf), VOXEL_MM, "tangent", DETAIL)
    return fields.direction_normalize(field, "unit_mass").withColumn("weight", r(F.col("weight")))


@query("direction_normalize_global", sql("segu box", f"WITH {FIELD} SELECT i, j, k, CAST(bin AS INT) AS bin, {R('weight / (SELECT MAX(weight) FROM field)')} AS weight FROM field"))
def direction_normalize_global(spark, sf):
    field = cut_lineage(fields.direction_field(fx.points(spark, sf), VOXEL_MM, "tangent", DETAIL))
    return fields.direction_normalize(field, "global_peak").withColumn("weight", r(F.col("weight")))


# Points moved out of their voxels, some of them out of the grid.
@query("direction_sample", sql("segu box", f"""WITH {SUMMARY}, p AS (SELECT streamline_id, point_idx, x + 0.125e0 AS x, y + 1 AS y, z * 1.25e0 + 1 AS z FROM pts),
    s AS (SELECT p.*, {place_sql(('x', 'y', 'z'), 1, VOXEL_MM)}, (x - ax) / 4e0 + 1 < CEIL((bx - ax) / 4e0 + 2) AND (y - ay) / 4e0 + 1 < CEIL((by_ - ay) / 4e0 + 2) AND (z - az) / 4e0 + 1 < CEIL((bz - az) / 4e0 + 2) AS ok FROM p, box),
    n AS (SELECT s.streamline_id, s.point_idx, v.* EXCLUDE (i, j, k), v.i = s.i AND v.j = s.j AND v.k = s.k AS own, (ax - 4 + (v.i + 0.5e0) * 4 - s.x) AS gx, (ay - 4 + (v.j + 0.5e0) * 4 - s.y) AS gy, (az - 4 + (v.k + 0.5e0) * 4 - s.z) AS gz
      FROM s, (SELECT UNNEST([-1,0,1]) AS a) t1, (SELECT UNNEST([-1,0,1]) AS b) t2, (SELECT UNNEST([-1,0,1]) AS c) t3, box JOIN summ v ON v.i = s.i + a AND v.j = s.j + b AND v.k = s.k + c WHERE ok),
    w AS (SELECT *, CASE WHEN vx*vx + vy*vy + vz*vz > 1e-10 THEN 1e0 / GREATEST(gx*gx + gy*gy + gz*gz, 1e-4) END AS w FROM n),
    q AS (SELECT streamline_id, point_idx, {", ".join(f"CASE WHEN BOOL_OR(own) THEN MAX(CASE WHEN own THEN v{c} END) ELSE SUM(v{c} * w) / SUM(w) END AS v{c}" for c in "xyz")}, {", ".join(f"MAX(CASE WHEN own THEN {t} END) AS {t}" for t in fields.TENSOR)} FROM w GROUP BY 1, 2)
    SELECT streamline_id, point_idx, {", ".join(f"{R(f'COALESCE({c}, 0)', 5)} AS {c}" for c in ("vx", "vy", "vz", *fields.TENSOR))} FROM p LEFT JOIN q USING (streamline_id, point_idx)"""))
def direction_sample(spark, sf):
    pts = fx.points(spark, sf)
    summary = fields.direction_summary(pts, VOXEL_MM)
    moved = pts.select(*POINT, (F.col("x") + 0.125).alias("x"), (F.col("y") + 1).alias("y"), (F.col("z") * 1.25 + 1).alias("z"))
    out = fields.direction_sample(moved, summary, pts, VOXEL_MM)
    return out.select(*POINT, *[r(F.col(c), 5).alias(c) for c in ("vx", "vy", "vz", *fields.TENSOR)])


def _power_sql() -> str:
    steps = ["p0 AS (SELECT *, CASE WHEN xx >= yy AND xx >= zz THEN 1e0 ELSE 0e0 END AS a, CASE WHEN NOT (xx >= yy AND xx >= zz) AND yy >= zz THEN 1e0 ELSE 0e0 END AS b, CASE WHEN NOT (xx >= yy AND xx >= zz) AND yy < zz THEN 1e0 ELSE 0e0 END AS c FROM summ)"]
    for n in range(6):
        steps.append(f"""p{n + 1} AS (SELECT i, j, k, xx, xy, xz, yy, yz, zz, CASE WHEN l < 1e-8 THEN a ELSE ma / SQRT(l) END AS a, CASE WHEN l < 1e-8 THEN b ELSE mb / SQRT(l) END AS b, CASE WHEN l < 1e-8 THEN c ELSE mc / SQRT(l) END AS c
        FROM (SELECT *, ma*ma + mb*mb + mc*mc AS l FROM (SELECT *, xx*a + xy*b + xz*c AS ma, xy*a + yy*b + yz*c AS mb, xz*a + yz*b + zz*c AS mc FROM p{n})))""")
    return ", ".join(steps)


@query("principal_direction", sql("segu box", f"WITH {SUMMARY}, {_power_sql()} SELECT i, j, k, {R('ABS(a)', 5)} AS r, {R('ABS(b)', 5)} AS g, {R('ABS(c)', 5)} AS b FROM p6"))
def principal_direction(spark, sf):
    out = fields.principal_direction(fields.direction_summary(fx.points(spark, sf), VOXEL_MM))
    return out.select("i", "j", "k", *[r(F.col(c), 5).alias(c) for c in "rgb"])


# --- pruning ------------------------------------------------------------------------


def _tip_sql(rounds: int, size: float, support: int, share: float) -> str:
    parts, last = ["k0 AS (SELECT * FROM pts)"], "k0"
    for n in range(1, rounds + 1):
        parts.append(visits_sql(last, size, str(n)))
        parts.append(f"d{n} AS (SELECT i, j, k, COUNT(*) AS d FROM visit{n} GROUP BY 1, 2, 3)")
        parts.append(
            f"ok{n} AS (SELECT streamline_id FROM (SELECT DISTINCT streamline_id, i, j, k FROM visit{n}) JOIN d{n} USING (i, j, k) GROUP BY 1 HAVING COUNT(*) FILTER (WHERE d <= {support}) / COUNT(*)::DOUBLE <= {share})"
        )
        parts.append(f"k{n} AS (SELECT * FROM {last} WHERE streamline_id IN (SELECT streamline_id FROM ok{n}))")
        last = f"k{n}"
    return f"WITH {', '.join(parts)} SELECT DISTINCT streamline_id FROM {last}"


@query("tip_prune", sql("pts", _tip_sql(3, 4.0, 2, 0.1)))
def tip_prune(spark, sf):
    return pruning.tip_prune(fx.points(spark, sf), voxel_mm=4.0, iterations=3, min_support=2, max_unsupported=0.1)


TRIM_SQL = "(SELECT * FROM (SELECT *, COUNT(*) OVER (PARTITION BY streamline_id) AS n FROM seat0) WHERE segment_idx >= FLOOR(n * 0.1e0) AND segment_idx < n - FLOOR(n * 0.1e0))"


def _fico_sql() -> str:
    """Whole-sphere Gaussian smoothing of the queried bins, then the weakest support."""
    sigma = f"(RADIANS(15e0) / 2.354820045e0)"
    return f"""{FIELD}, {SMOOTH}, peak AS (SELECT MAX(weight) AS m FROM s2), nrm AS (SELECT i, j, k, bin, weight / m AS weight FROM s2, peak),
    ker AS (SELECT a.bin AS b, c.bin AS c, EXP(-POWER(ACOS(LEAST(1e0, GREATEST(-1e0, a.bx*c.bx + a.by_*c.by_ + a.bz*c.bz))), 2) * 0.5e0 / ({sigma} * {sigma})) AS w FROM bins a, bins c),
    kn AS (SELECT b, c, w / SUM(w) OVER (PARTITION BY b) AS w FROM ker),
    seat0 AS (SELECT segu.*, {place_sql(('mx', 'my', 'mz'), 1, VOXEL_MM)} FROM segu, box),
    ask AS (SELECT DISTINCT streamline_id, i, j, k, bin FROM {TRIM_SQL} JOIN plus USING (ux, uy, uz) WHERE length * length >= 1e-10),
    sup AS (SELECT q.i, q.j, q.k, q.bin, SUM(w * weight) AS support FROM (SELECT DISTINCT i, j, k, bin FROM ask) q JOIN nrm USING (i, j, k) JOIN kn ON kn.b = q.bin AND kn.c = nrm.bin GROUP BY 1, 2, 3, 4),
    fico AS (SELECT streamline_id, LN(1 + MIN(support)) AS fico FROM ask JOIN sup USING (i, j, k, bin) GROUP BY 1)"""


def _scored(spark, sf):
    """Points, their field, and the binned segments that the field and the scores are made of."""
    pts = fx.points(spark, sf)
    binned = cut_lineage(fields.binned_segments(pts, VOXEL_MM, DETAIL))
    field = fields.direction_field(pts, VOXEL_MM, "tangent", DETAIL, binned)
    field = cut_lineage(fields.direction_smooth(field, DETAIL))
    return pts, fields.direction_normalize(field, "global_peak"), binned


@query("purifibre_score", sql("segu box", f"WITH {_fico_sql()} SELECT p.streamline_id, {R('fico')} AS fico FROM (SELECT DISTINCT streamline_id FROM pts) p LEFT JOIN fico USING (streamline_id)"))
def purifibre_score(spark, sf):
    """NaN (nothing to score) is shown as NULL."""
    pts, field, binned = _scored(spark, sf)
    out = pruning.purifibre_score(pts, field, VOXEL_MM, detail=DETAIL, binned=binned)
    return out.select("streamline_id", r(F.nanvl("fico", F.lit(None).cast("double"))).alias("fico"))


@query("purifibre", sql("segu box", f"""WITH {_fico_sql()}, o AS (SELECT streamline_id, ROUND(fico, 6) + 0.0 AS fico FROM fico), n AS (SELECT fico, ROW_NUMBER() OVER (ORDER BY fico) - 1 AS n, COUNT(*) OVER () AS c FROM o)
    SELECT streamline_id, fico FROM o WHERE fico >= (SELECT fico FROM n WHERE n = LEAST(FLOOR(c * 0.1e0), c - 1))"""))
def purifibre(spark, sf):
    """Survivors of the 10 % cut of the scores rounded to six digits."""
    pts, field, binned = _scored(spark, sf)
    _, kept = pruning.purifibre(pts, field, VOXEL_MM, 0.1, digits=6, detail=DETAIL, binned=binned)
    return kept


# Candidates are the streamlines of group N, the reference those of group R.
COVER = """ref AS (SELECT pts.* FROM pts JOIN grp USING (streamline_id) WHERE group_name = 'R'), cand AS (SELECT pts.* FROM pts JOIN grp USING (streamline_id) WHERE group_name = 'N'),
    rx AS (SELECT DISTINCT x, y, z FROM ref), cx AS (SELECT DISTINCT x, y, z FROM cand),
    fd AS (SELECT c.x, c.y, c.z, SQRT(MIN((c.x-r.x)*(c.x-r.x) + (c.y-r.y)*(c.y-r.y) + (c.z-r.z)*(c.z-r.z))) AS d FROM cx c, rx r GROUP BY 1, 2, 3),
    bd AS (SELECT r.x, r.y, r.z, SQRT(MIN((c.x-r.x)*(c.x-r.x) + (c.y-r.y)*(c.y-r.y) + (c.z-r.z)*(c.z-r.z))) AS d FROM cx c, rx r GROUP BY 1, 2, 3),
    f AS (SELECT streamline_id, AVG(d) AS d FROM cand JOIN fd USING (x, y, z) GROUP BY 1), b AS (SELECT streamline_id, AVG(d) AS d FROM ref JOIN bd USING (x, y, z) GROUP BY 1),
    l AS (SELECT length_mm, ROW_NUMBER() OVER (ORDER BY length_mm) - 1 AS n, COUNT(*) OVER () AS c FROM len WHERE streamline_id IN (SELECT streamline_id FROM cand))"""


@query("bundle_coverage", sql("pts grp len", f"WITH {COVER} SELECT {R('(SELECT AVG(d) FROM f)')} AS forward_mean_mm, {R('(SELECT AVG(CASE WHEN d <= 1 THEN 1e0 ELSE 0e0 END) FROM b)')} AS coverage, {R('(SELECT length_mm FROM l WHERE n = FLOOR(c * 0.5e0))')} AS median_length_mm"))
def bundle_coverage(spark, sf):
    pts, groups = fx.points(spark, sf), fx.groups(spark, sf)
    found, reference_pts = (selection.keep(pts, selection.group_select(selection.ids(pts), groups, [g])) for g in "NR")
    out = pruning.bundle_coverage(found, reference_pts, 1.0)
    return out.select(*[r(F.col(c)).alias(c) for c in out.columns])


@query("bundle_coverage_cohort", sql("cpts cgrp clen", f"""WITH ref AS (SELECT cpts.* FROM cpts JOIN cgrp USING (subject_id, streamline_id) WHERE group_name = 'R'), cand AS (SELECT cpts.* FROM cpts JOIN cgrp USING (subject_id, streamline_id) WHERE group_name = 'N'),
    rx AS (SELECT DISTINCT subject_id, x, y, z FROM ref), cx AS (SELECT DISTINCT subject_id, x, y, z FROM cand),
    m AS (SELECT subject_id, c.x AS cx, c.y AS cy, c.z AS cz, r.x AS rx, r.y AS ry, r.z AS rz, (c.x-r.x)*(c.x-r.x) + (c.y-r.y)*(c.y-r.y) + (c.z-r.z)*(c.z-r.z) AS d2 FROM cx c JOIN rx r USING (subject_id)),
    fd AS (SELECT subject_id, cx AS x, cy AS y, cz AS z, SQRT(MIN(d2)) AS d FROM m GROUP BY ALL), bd AS (SELECT subject_id, rx AS x, ry AS y, rz AS z, SQRT(MIN(d2)) AS d FROM m GROUP BY ALL),
    f AS (SELECT subject_id, streamline_id, AVG(d) AS d FROM cand JOIN fd USING (subject_id, x, y, z) GROUP BY 1, 2), b AS (SELECT subject_id, streamline_id, AVG(d) AS d FROM ref JOIN bd USING (subject_id, x, y, z) GROUP BY 1, 2),
    l AS (SELECT subject_id, length_mm, ROW_NUMBER() OVER (PARTITION BY subject_id ORDER BY length_mm) - 1 AS n, COUNT(*) OVER (PARTITION BY subject_id) AS c FROM clen WHERE (subject_id, streamline_id) IN (SELECT (subject_id, streamline_id) FROM cand))
    SELECT subject_id, {R('f.d')} AS forward_mean_mm, {R('b.d')} AS coverage, {R('length_mm')} AS median_length_mm FROM (SELECT subject_id, AVG(d) AS d FROM f GROUP BY 1) f
    JOIN (SELECT subject_id, AVG(CASE WHEN d <= 1 THEN 1e0 ELSE 0e0 END) AS d FROM b GROUP BY 1) b USING (subject_id) JOIN l USING (subject_id) WHERE n = FLOOR(c * 0.5e0)"""))
def bundle_coverage_cohort(spark, sf):
    pts, groups = fx.by_subject(fx.points(spark, sf)), fx.by_subject(fx.groups(spark, sf))
    found, reference_pts = (selection.keep(pts, selection.group_select(selection.ids(pts), groups, [g])) for g in "NR")
    out = pruning.bundle_coverage(found, reference_pts, 1.0)
    return out.select("subject_id", *[r(F.col(c)).alias(c) for c in out.columns if c != "subject_id"])


# --- colours ------------------------------------------------------------------------


@query("color_by_direction", sql("tan", f"SELECT streamline_id, point_idx, {R('ABS(tx)')} AS r, {R('ABS(ty)')} AS g, {R('ABS(tz)')} AS b FROM tan"))
def color_by_direction(spark, sf):
    out = coloring.color_by_direction(fx.points(spark, sf))
    return out.select(*POINT, *[r(F.col(c)).alias(c) for c in "rgb"])


# Groups R, Corticospinal (known name), sheet_0003 (numbered), in name order.
GROUPS = "CASE group_name WHEN 'A' THEN 'Left Corticospinal' WHEN 'N' THEN 'sheet_0003' ELSE 'zz' END"


@query("color_by_group", sql("pts grp", f"""WITH g AS (SELECT streamline_id, MAX(CASE group_name WHEN 'A' THEN 0 WHEN 'N' THEN 1 ELSE 2 END) AS o FROM grp GROUP BY 1)
    SELECT streamline_id, point_idx, CASE o WHEN 0 THEN 1e0 WHEN 1 THEN {R('0.62e0 - 0.62e0 * 0.72e0 + 0.62e0 * 0.72e0 * (1 - ABS((275.01552e0 / 60) % 2 - 1))')} ELSE {R('0.62e0 - 0.62e0 * 0.72e0 + 0.62e0 * 0.72e0 * (1 - ABS((275.01552e0 / 60) % 2 - 1))')} END AS r
    FROM pts JOIN g USING (streamline_id)"""))
def color_by_group(spark, sf):
    name = F.when(F.col("group_name") == "A", "Left Corticospinal").when(F.col("group_name") == "N", "sheet_0003").otherwise("zz")
    named = fx.groups(spark, sf).withColumn("group_name", name)
    return coloring.color_by_group(fx.points(spark, sf), named).select(*POINT, r(F.col("r")).alias("r"))


def _bwr(t: str) -> str:
    return f"{R(f'CASE WHEN {t} < 0.5 THEN {t} * 2 ELSE 1 END')} AS r, {R(f'CASE WHEN {t} < 0.5 THEN {t} * 2 ELSE (1 - {t}) * 2 END')} AS g, {R(f'CASE WHEN {t} < 0.5 THEN 1 ELSE (1 - {t}) * 2 END')} AS b"


@query("color_by_dpv", sql("pts", f"""WITH o AS (SELECT dpv, ROW_NUMBER() OVER (ORDER BY dpv) - 1 AS n, COUNT(*) OVER () AS c FROM pts),
    s AS (SELECT MAX(CASE WHEN n = FLOOR(c * 0.02e0) THEN dpv END) AS lo, MAX(CASE WHEN n = FLOOR(c * 0.98e0) THEN dpv END) AS hi FROM o),
    t AS (SELECT streamline_id, point_idx, LEAST(1e0, GREATEST(0e0, (dpv - lo) / (hi - lo))) AS t FROM pts, s) SELECT streamline_id, point_idx, {_bwr('t')} FROM t"""))
def color_by_dpv(spark, sf):
    out = coloring.color_by_scalar(fx.points(spark, sf), "dpv")
    return out.select(*POINT, *[r(F.col(c)).alias(c) for c in "rgb"])


@query("color_by_dpv_cohort", sql("cpts", f"""WITH o AS (SELECT subject_id, dpv, ROW_NUMBER() OVER (PARTITION BY subject_id ORDER BY dpv) - 1 AS n, COUNT(*) OVER (PARTITION BY subject_id) AS c FROM cpts),
    s AS (SELECT subject_id, MAX(CASE WHEN n = FLOOR(c * 0.02e0) THEN dpv END) AS lo, MAX(CASE WHEN n = FLOOR(c * 0.98e0) THEN dpv END) AS hi FROM o GROUP BY 1),
    t AS (SELECT subject_id, streamline_id, point_idx, LEAST(1e0, GREATEST(0e0, (dpv - lo) / (hi - lo))) AS t FROM cpts JOIN s USING (subject_id)) SELECT subject_id, streamline_id, point_idx, {_bwr('t')} FROM t"""))
def color_by_dpv_cohort(spark, sf):
    """Each subject over its own range."""
    out = coloring.color_by_scalar(fx.by_subject(fx.points(spark, sf)), "dpv")
    return out.select("subject_id", *POINT, *[r(F.col(c)).alias(c) for c in "rgb"])


@query("color_by_dps", sql("pts dps", f"""WITH t AS (SELECT streamline_id, point_idx, LEAST(1e0, GREATEST(0e0, (COALESCE(value, 0) - 50000) / 250000e0)) AS t FROM pts LEFT JOIN dps USING (streamline_id))
    SELECT streamline_id, point_idx, {_bwr('t')} FROM t"""))
def color_by_dps(spark, sf):
    out = coloring.color_by_scalar(fx.points(spark, sf), "price", fx.dps(spark, sf), (50000.0, 300000.0))
    return out.select(*POINT, *[r(F.col(c)).alias(c) for c in "rgb"])


@query("color_uniform", sql("pts", "SELECT streamline_id, point_idx, 0.25e0 AS r, 0.5e0 AS g, 0.75e0 AS b FROM pts"))
def color_uniform(spark, sf):
    return coloring.color_uniform(fx.points(spark, sf), (0.25, 0.5, 0.75))


# --- shapes -------------------------------------------------------------------------


@query("fit_parabola_triangle")
def fit_parabola_triangle(spark, sf):
    out = shapes.fit_parabola_triangle(fx.points(spark, sf))
    return out.select("streamline_id", *[F.round(F.col(n)[c], 4).alias(f"{n}_{c}") for n in ("apex", "e1", "e2") for c in "xyz"])


@query("triangle_segments")
def triangle_segments(spark, sf):
    out = shapes.triangle_segments(fx.points(spark, sf), fx.groups(spark, sf))
    return out.select("streamline_id", "piece", "group_name", *[F.round(F.col(e)[c], 4).alias(f"{e}{c}") for e in "ab" for c in "xyz"])


# --- plans --------------------------------------------------------------------------


def _rules(spark):
    plan = rules.simple_plan(spark, "one", seed="even")
    plan = rules.add_rule(plan, "one", "roi", "large")
    plan = rules.add_rule(plan, "one", "no_end", "low")
    two = rules.simple_plan(spark, "two")
    two = rules.add_rule(two, "two", "roa", "low")
    two = rules.add_rule(two, "two", "end", "even")
    two = rules.add_rule(two, "two", "limiting", "even")
    two = rules.add_rule(two, "two", "limiting", "large")
    return plan.unionByName(rules.add_rule(two, "two", "term", None))


@query("plan_rules", sql("msks", """WITH p AS (SELECT * FROM (VALUES ('one', 'seed', 'even'), ('one', 'roi', 'large'), ('one', 'no_end', 'low'), ('two', 'roa', 'low'), ('two', 'end', 'even'), ('two', 'limiting', 'large')) t(bundle_id, role, mask_id))
    SELECT bundle_id, role, mask_id, CAST(COUNT(*) AS BIGINT) AS n_voxels FROM p JOIN msks USING (mask_id) GROUP BY 1, 2, 3"""))
def plan_rules(spark, sf):
    sizes = fx.masks(spark, sf).groupBy("mask_id").agg(F.count("*").alias("n_voxels"))
    return _rules(spark).join(sizes, "mask_id").select("bundle_id", "role", "mask_id", "n_voxels")


@query("plan_params_resolve", "SELECT n_name AS bundle_id, CASE WHEN n_nationkey % 2 = 0 THEN n_nationkey * 2e0 ELSE 30e0 END AS min_len_mm, CASE WHEN n_regionkey = 1 THEN 0.75e0 ELSE 0.5e0 END AS step_size_mm FROM nation")
def plan_params_resolve(spark, sf):
    rows = fx.table(spark, sf, "nation").select(
        F.col("n_name").alias("bundle_id"),
        F.when(F.col("n_nationkey") % 2 == 0, F.col("n_nationkey") * 2.0).alias("min_len_mm"),
        F.when(F.col("n_regionkey") == 1, 0.75).alias("step_size_mm"),
    )
    return rules.plan_params_resolve(rows, {"min_len_mm": 30.0, "step_size_mm": 0.5})


CLASSIFY = """WITH c AS (SELECT DISTINCT streamline_id, mask_id FROM pvf JOIN msks USING (i, j, k)),
    t AS (SELECT DISTINCT streamline_id, mask_id FROM (SELECT *, CAST(FLOOR(x * 2e-1) AS INT) AS i, CAST(FLOOR(y * 2e-1) AS INT) AS j, CAST(FLOOR(z * 2e-1) AS INT) AS k FROM endr WHERE n >= 2) JOIN msks USING (i, j, k)),
    ref AS (SELECT DISTINCT x, y, z FROM pts JOIN grp USING (streamline_id) WHERE group_name = 'R'), u AS (SELECT DISTINCT x, y, z FROM pts),
    d AS (SELECT u.x, u.y, u.z, SQRT(MIN((u.x-r.x)*(u.x-r.x) + (u.y-r.y)*(u.y-r.y) + (u.z-r.z)*(u.z-r.z))) AS d FROM u, ref r GROUP BY 1, 2, 3),
    h AS (SELECT streamline_id, AVG(d) AS far FROM pts JOIN d USING (x, y, z) GROUP BY 1),
    s AS (SELECT p.streamline_id, COALESCE(length_mm, 0) AS len, far FROM (SELECT DISTINCT streamline_id FROM pts) p LEFT JOIN len USING (streamline_id) JOIN h USING (streamline_id)),
    cl AS (SELECT streamline_id, 'one' AS bundle_id, CASE WHEN len < 30 THEN 'reject_min_length' WHEN streamline_id NOT IN (SELECT streamline_id FROM c WHERE mask_id = 'large') THEN 'reject_roi'
      WHEN streamline_id IN (SELECT streamline_id FROM t WHERE mask_id = 'low') THEN 'reject_no_end' WHEN far > 1 THEN 'reject_hausdorff' WHEN len > 150 THEN 'reject_max_length' ELSE 'accept' END AS outcome FROM s
      UNION ALL SELECT streamline_id, 'two', CASE WHEN streamline_id IN (SELECT streamline_id FROM c WHERE mask_id = 'low') THEN 'reject_roa' WHEN len < 10 THEN 'reject_min_length'
      WHEN streamline_id NOT IN (SELECT streamline_id FROM t WHERE mask_id = 'even') THEN 'reject_end' ELSE 'accept' END FROM s
      UNION ALL SELECT streamline_id, 'three', CASE WHEN len < 20 THEN 'reject_min_length' WHEN far > 0.5 THEN 'reject_hausdorff' WHEN len > 90 THEN 'reject_max_length' ELSE 'accept' END FROM s)"""


def _classified(spark, sf):
    """Bundle three asks for no mask, only for nearness to its reference."""
    pts = fx.points(spark, sf)
    params = small_table(
        spark,
        [("one", 30.0, 150.0, 1.0), ("two", 10.0, None, None), ("three", 20.0, 90.0, 0.5)],
        "bundle_id string, min_len_mm double, max_len_mm double, max_hausdorff_mm double",
    )
    cloud = selection.keep(pts, selection.group_select(selection.ids(pts), fx.groups(spark, sf), ["R"]))
    references = cloud.select(F.explode(F.array(F.lit("one"), F.lit("three"))).alias("bundle_id"), "x", "y", "z")
    return classify.bundle_classify(pts, _rules(spark), params, fx.masks(spark, sf), fx.grid(spark, sf), references)


@query("bundle_classify", sql("pts grp pvf endr msks len", f"{CLASSIFY} SELECT streamline_id, bundle_id, outcome FROM cl"))
def bundle_classify(spark, sf):
    """Every pair, those without contact expanded."""
    return _classified(spark, sf).pairs()


@query("rejection_summary", sql("pts grp pvf endr msks len", f"{CLASSIFY} SELECT bundle_id, outcome, CAST(COUNT(*) AS BIGINT) AS attempts FROM cl GROUP BY ROLLUP (bundle_id, outcome)"))
def rejection_summary(spark, sf):
    """From the pairs with contact and the counts of the others."""
    return classify.rejection_summary(_classified(spark, sf))


# A bundle per nation: voxels of parts of its number are its waypoint, those of the next number are to be avoided.
NATIONS = """WITH v AS (SELECT DISTINCT streamline_id, p_size % 25 AS n FROM pvf JOIN vox USING (i, j, k)),
    s AS (SELECT p.streamline_id, COALESCE(length_mm, 0) AS len FROM (SELECT DISTINCT streamline_id FROM pts) p LEFT JOIN len USING (streamline_id)),
    e AS (SELECT streamline_id, len, n_name, n_nationkey AS k FROM s, nation),
    cl AS (SELECT e.streamline_id, n_name AS bundle_id, CASE WHEN b.n IS NOT NULL THEN 'reject_roa' WHEN len < k THEN 'reject_min_length' WHEN a.n IS NULL THEN 'reject_roi'
      WHEN len > 40 + 5 * k THEN 'reject_max_length' ELSE 'accept' END AS outcome
      FROM e LEFT JOIN v a ON a.streamline_id = e.streamline_id AND a.n = k LEFT JOIN v b ON b.streamline_id = e.streamline_id AND b.n = (k + 1) % 25)"""


def _classified_nations(spark, sf):
    nation = fx.table(spark, sf, "nation")
    key = F.col("n_nationkey")
    rules_ = nation.select(F.col("n_name").alias("bundle_id"), F.explode(F.array(
        F.struct(F.lit("roi").alias("role"), key.cast("string").alias("mask_id")),
        F.struct(F.lit("roa").alias("role"), F.pmod(key + 1, F.lit(25)).cast("string").alias("mask_id")),
    )).alias("_r")).select("bundle_id", "_r.*")
    params = nation.select(
        F.col("n_name").alias("bundle_id"), key.cast("double").alias("min_len_mm"), (key * 5 + 40).cast("double").alias("max_len_mm"),
        F.lit(None).cast("double").alias("max_hausdorff_mm"),
    )
    masks = fx.parts(spark, sf).select(F.pmod("p_size", F.lit(25)).cast("string").alias("mask_id"), "i", "j", "k")
    return classify.bundle_classify(fx.points(spark, sf), rules_, params, masks, fx.grid(spark, sf))


@query("bundle_classify_nations", sql("pts pvf vox len", f"{NATIONS} SELECT bundle_id, streamline_id FROM cl WHERE outcome = 'accept'"))
def bundle_classify_nations(spark, sf):
    """The accepted pairs of a bundle per nation."""
    return _classified_nations(spark, sf).accepted().select("bundle_id", "streamline_id")


@query("rejection_summary_nations", sql("pts pvf vox len", f"{NATIONS} SELECT bundle_id, outcome, CAST(COUNT(*) AS BIGINT) AS attempts FROM cl GROUP BY ROLLUP (bundle_id, outcome)"))
def rejection_summary_nations(spark, sf):
    return classify.rejection_summary(_classified_nations(spark, sf))


# A bundle per group of each subject, on the 5 mm grid of the orientation field.
REFERENCE = """WITH rp AS (SELECT subject_id, group_name AS bundle_id, cnear.* EXCLUDE (subject_id) FROM (SELECT * REPLACE (streamline_id // 3 AS streamline_id), CAST(streamline_id % 3 AS VARCHAR) AS subject_id FROM near) cnear JOIN cgrp USING (subject_id, streamline_id)),
    dm AS (SELECT MAX(k) + 1 AS nz FROM odx),
    e AS (SELECT *, CAST(CEIL(GREATEST(ABS(nx*2e-1 - x*2e-1), ABS(ny*2e-1 - y*2e-1), ABS(nz*2e-1 - z*2e-1))) AS INT) AS steps FROM rp WHERE nx IS NOT NULL),
    u AS (SELECT *, UNNEST(RANGE(steps + 1)) AS s FROM e), t AS (SELECT *, s * (1e0 / GREATEST(steps, 1)) AS t FROM u),
    cov AS (SELECT DISTINCT subject_id, bundle_id, CAST(FLOOR(x*2e-1 + (nx*2e-1 - x*2e-1) * t) AS INT) AS i, CAST(FLOOR(y*2e-1 + (ny*2e-1 - y*2e-1) * t) AS INT) AS j, CAST(FLOOR(z*2e-1 + (nz*2e-1 - z*2e-1) * t) AS INT) AS k FROM t),
    c AS (SELECT cov.* FROM cov, dm WHERE i BETWEEN 0 AND 9 AND j BETWEEN 0 AND 9 AND k BETWEEN 0 AND dm.nz - 1), o AS (SELECT UNNEST(RANGE(-2, 3)) AS d),
    dil AS (SELECT subject_id, bundle_id, CAST(c.i + a.d AS INT) AS i, CAST(c.j + b.d AS INT) AS j, CAST(c.k + g.d AS INT) AS k, MIN(a.d*a.d + b.d*b.d + g.d*g.d) AS d2 FROM c, o a, o b, o g, dm
      WHERE c.i + a.d BETWEEN 0 AND 9 AND c.j + b.d BETWEEN 0 AND 9 AND c.k + g.d BETWEEN 0 AND dm.nz - 1 GROUP BY 1, 2, 3, 4, 5),
    lim AS (SELECT * EXCLUDE (d2) FROM dil WHERE d2 <= 2), env AS (SELECT * EXCLUDE (d2) FROM dil WHERE d2 <= 1),
    pk AS (SELECT i, j, k, amplitude FROM odx JOIN fix USING (voxel_id) WHERE fixel_idx = 0),
    m AS (SELECT bundle_id || '_limiting' AS mask_id, * FROM lim UNION ALL SELECT bundle_id || '_seed', env.* FROM env LEFT JOIN pk USING (i, j, k) WHERE COALESCE(amplitude, 0) >= 0.5e0 * 0.3e0
    UNION ALL SELECT bundle_id || '_no_end', lim.* FROM lim LEFT JOIN pk USING (i, j, k) WHERE COALESCE(amplitude, 0) > 0.9e0 * 0.3e0)
    SELECT subject_id, bundle_id, mask_id, i, j, k FROM m"""


def _reference_plan(spark, sf):
    voxels = fx.odx_voxels(spark, sf)
    top = voxels.agg(F.max("k").alias("m")).first()["m"]
    pts, groups = fx.by_subject(fx.points(spark, sf)), fx.by_subject(fx.groups(spark, sf))
    ref = pts.join(groups.withColumnRenamed("group_name", "bundle_id"), ["subject_id", "streamline_id"])
    return reference.prepare_reference_plan(ref, fx.fixels(spark, sf), voxels, geo.scaling_grid(10, 10, int(top) + 1, 5.0), "amplitude", 0.3, 6.0, 2.0)


@query("prepare_reference_plan", sql("near odx fix cgrp", REFERENCE))
def prepare_reference_plan(spark, sf):
    """The three masks of every subject and bundle (tolerances of 6 mm and 2 mm on a 5 mm grid)."""
    plan = _reference_plan(spark, sf)
    return plan.rules.join(plan.masks, ["subject_id", "mask_id"]).select("subject_id", "bundle_id", "mask_id", "i", "j", "k")


@query("prepare_reference_plan_lengths", sql("clen cgrp", f"""SELECT subject_id, group_name AS bundle_id, {R('GREATEST(6, MIN(length_mm) - 12, 0)')} AS min_len_mm, {R('MAX(length_mm) + 12')} AS max_len_mm, 6e0 AS max_hausdorff_mm
    FROM clen JOIN cgrp USING (subject_id, streamline_id) WHERE length_mm > 0 GROUP BY 1, 2"""))
def prepare_reference_plan_lengths(spark, sf):
    limits = _reference_plan(spark, sf).params
    return limits.select("subject_id", "bundle_id", r(F.col("min_len_mm")).alias("min_len_mm"), r(F.col("max_len_mm")).alias("max_len_mm"), "max_hausdorff_mm")


# Region files of three subjects: customers of a region of nations name them, each file holds the parts of one size.
FILES = """f AS (SELECT DISTINCT CAST(CAST(FLOOR(c_custkey / 24) AS BIGINT) % 3 AS VARCHAR) AS subject_id, REPLACE(n_name, '_', '') AS bundle_id, n_nationkey,
      CASE WHEN c_custkey % 8 < 4 THEN 'roi' WHEN c_custkey % 8 < 6 THEN 'roa' ELSE 'end' END AS role, CASE WHEN c_custkey % 8 = 6 THEN 'start' WHEN c_custkey % 8 = 7 THEN 'end' END AS side,
      CASE WHEN c_custkey % 8 < 6 THEN CAST(FLOOR(c_custkey / 8) AS BIGINT) % 3 END AS idx FROM customer JOIN nation ON c_nationkey = n_nationkey WHERE n_regionkey = 2),
    w AS (SELECT *, (CAST(subject_id AS BIGINT) * 7 + COALESCE(idx, 5) * 11 + n_nationkey + CASE role WHEN 'roi' THEN 0 WHEN 'roa' THEN 17 ELSE 29 END) % 50 + 1 AS p_size, bundle_id || CASE role WHEN 'roi' THEN '_include' || idx WHEN 'roa' THEN '_exclude' ELSE '_' || side END AS mask_id
      FROM f WHERE (subject_id, bundle_id) IN (SELECT (subject_id, bundle_id) FROM f WHERE role = 'roi')),
    o AS (SELECT UNNEST(RANGE(-2, 3)) AS d),
    dil AS (SELECT DISTINCT subject_id, bundle_id, role, mask_id, CAST(i + a.d AS INT) AS i, CAST(j + b.d AS INT) AS j, CAST(k + c.d AS INT) AS k FROM w JOIN vox USING (p_size), o a, o b, o c, dims
      WHERE a.d*a.d + b.d*b.d + c.d*c.d <= (CASE role WHEN 'end' THEN 3 WHEN 'roi' THEN 1 ELSE 0 END) AND i + a.d BETWEEN 0 AND 9 AND j + b.d BETWEEN 0 AND 9 AND k + c.d BETWEEN 0 AND dims.nz - 1)"""


def _roi_plan(spark, sf):
    rows = fx.table(spark, sf, "customer").join(fx.table(spark, sf, "nation").filter("n_regionkey = 2"), F.col("c_nationkey") == F.col("n_nationkey"))
    key = F.col("c_custkey")
    kind, turn = F.pmod(key, F.lit(8)), F.pmod(F.floor(key / 8), F.lit(3))
    side = F.when(kind == 6, "Start").when(kind == 7, "End")
    token = F.when(kind < 4, F.concat(F.lit("Include"), turn.cast("string"))).when(kind < 6, F.concat(F.lit("Exclude"), turn.cast("string"))).otherwise(side)
    sub = F.pmod(F.floor(key / 24), F.lit(3))
    path = F.concat(F.lit("/deriv/sub-"), sub.cast("string"), F.lit("_space-ASIA_desc-"), F.translate("n_name", "_", ""), token, F.lit("_mask.nii.gz"))
    size = (sub * 7 + F.when(kind < 6, turn).otherwise(5) * 11 + F.col("n_nationkey") + F.when(kind < 4, 0).when(kind < 6, 17).otherwise(29)) % 50 + 1
    files = rows.select(path.alias("path"), size.alias("p_size")).distinct()
    names = fx.table(spark, sf, "nation").filter("n_regionkey = 2").select(F.translate("n_name", "_", "").alias("bundle"), (F.col("n_nationkey") * 2.0).alias("min_len_mm"), F.lit(200.0).alias("max_len_mm"))
    found = cut_lineage(catalog.catalog_derivatives(files.select("path"), names.select("bundle"), "ASIA"))
    voxels = fx.parts(spark, sf).join(files, "p_size").select("path", "i", "j", "k")
    grid = fx.grid(spark, sf)
    header = [F.lit(v).alias(n) for n, v in zip(("nx", "ny", "nz"), grid.dims)]
    grids = found.select("path").distinct().select("path", *header, F.array(*[F.lit(float(v)) for v in grid.affine]).alias("affine"))
    return roi.prepare_roi_plan(found, voxels, grids, waypoint_mm=5.0, exclusion_mm=0.0, endpoint_mm=8.0, lengths=names)


@query("prepare_roi_plan", sql("vox dims", f"WITH {FILES} SELECT subject_id, bundle_id, role, mask_id, CAST(COUNT(*) AS BIGINT) AS n_voxels FROM dil GROUP BY 1, 2, 3, 4"))
def prepare_roi_plan(spark, sf):
    """Voxels per rule of every subject and bundle (5 mm waypoint, 8 mm end reach)."""
    plan = _roi_plan(spark, sf)
    counts = plan.masks.groupBy("subject_id", "mask_id").agg(F.count("*").alias("n_voxels"))
    return plan.rules.join(counts, ["subject_id", "mask_id"]).select("subject_id", "bundle_id", "role", "mask_id", "n_voxels")


@query("plan_classify_keep", sql("pts len endr vox dims cpts clen", f"""WITH {FILES},
    h AS (SELECT DISTINCT subject_id, bundle_id, role, mask_id, streamline_id FROM cpts p JOIN dil USING (subject_id) WHERE i = CAST(FLOOR(x * 2e-1) AS INT) AND j = CAST(FLOOR(y * 2e-1) AS INT) AND k = CAST(FLOOR(z * 2e-1) AS INT)),
    e AS (SELECT DISTINCT subject_id, bundle_id, mask_id, p.streamline_id FROM (SELECT * REPLACE (streamline_id // 3 AS streamline_id), CAST(streamline_id % 3 AS VARCHAR) AS subject_id FROM endr WHERE n >= 2) p JOIN dil USING (subject_id)
      WHERE role = 'end' AND i = CAST(FLOOR(x * 2e-1) AS INT) AND j = CAST(FLOOR(y * 2e-1) AS INT) AND k = CAST(FLOOR(z * 2e-1) AS INT)),
    n AS (SELECT subject_id, bundle_id, COUNT(DISTINCT CASE WHEN role = 'roi' THEN mask_id END) AS rois, COUNT(DISTINCT CASE WHEN role = 'end' THEN mask_id END) AS ends FROM w GROUP BY 1, 2),
    g AS (SELECT subject_id, bundle_id, streamline_id, COUNT(DISTINCT CASE WHEN role = 'roi' THEN mask_id END) AS rois, COUNT(CASE WHEN role = 'roa' THEN 1 END) AS roas FROM h GROUP BY 1, 2, 3),
    x AS (SELECT subject_id, bundle_id, streamline_id, COUNT(*) AS ends FROM e GROUP BY 1, 2, 3)
    SELECT g.subject_id, g.bundle_id, g.streamline_id, p.point_idx FROM g JOIN n USING (subject_id, bundle_id) LEFT JOIN x USING (subject_id, bundle_id, streamline_id) LEFT JOIN clen l USING (subject_id, streamline_id)
      JOIN nation ON REPLACE(n_name, '_', '') = g.bundle_id JOIN cpts p USING (subject_id, streamline_id)
      WHERE g.rois = n.rois AND g.roas = 0 AND COALESCE(x.ends, 0) = n.ends AND COALESCE(length_mm, 0) BETWEEN n_nationkey * 2 AND 200"""))
def plan_classify_keep(spark, sf):
    """Region files to plans, plans to outcomes, and the vertices of what each bundle of each subject accepts."""
    plan = _roi_plan(spark, sf)
    pts = fx.by_subject(fx.points(spark, sf))
    found = classify.bundle_classify(pts, plan.rules, plan.params, plan.masks, fx.grid(spark, sf))
    return found.accepted().join(pts, ["subject_id", "streamline_id"]).select("subject_id", "bundle_id", "streamline_id", "point_idx")


MARKS = ["r", "g", "b", *fields.TENSOR]


def _envelope_sql(owner: list[str], level: float) -> str:
    """Ten sums of each owner's vertices, blurred along one axis after the other."""
    own, by = ", ".join(owner), "subject_id" in owner
    unit = {c: f"(CASE WHEN l > 0 THEN ABS(t{c}) / l ELSE 0 END)" for c in "xyz"}
    marks = {"r": "ABS(tx)", "g": "ABS(ty)", "b": "ABS(tz)"} | {t: f"{unit[t[0]]} * {unit[t[1]]}" for t in fields.TENSOR}
    boxed = "JOIN sbox USING (subject_id)" if by else ", sbox"
    key = "subject_id, " if by else ""
    steps = []
    last = "b0"
    for n, axis in enumerate("ijk"):
        here = ", ".join(f"t.{axis}" if c == axis else f"s.{c}" for c in "ijk")
        sums = ", ".join(f"SUM(w * {v}) AS {v}" for v in ("density", *MARKS))
        owned = ", ".join(f"s.{o}" for o in owner)
        dims = f"(SELECT {key}UNNEST(RANGE(d{axis})) AS {axis}, d{axis} FROM dm) t"
        on = f"s.{axis} = LEAST(GREATEST(t.{axis} + o, 0), t.d{axis} - 1)" + (" AND s.subject_id = t.subject_id" if by else "")
        steps.append(f"b{n + 1} AS (SELECT {owned}, {here}, {sums} FROM {dims}, ker, {last} s WHERE {on} GROUP BY ALL)")
        last = f"b{n + 1}"
    shown = ", ".join(f"{R(f'{m} / density', 5)} AS {m}" for m in MARKS)
    tan = "SELECT * REPLACE (streamline_id // 3 AS streamline_id), CAST(streamline_id % 3 AS VARCHAR) AS subject_id FROM tan" if by else "SELECT * FROM tan"
    group = "cgrp USING (subject_id, streamline_id)" if by else "grp USING (streamline_id)"
    return f"""WITH {KER}, ot AS ({tan}), sbox AS (SELECT {key}MIN(x) AS ax, MIN(y) AS ay, MIN(z) AS az, MAX(x) AS bx, MAX(y) AS by_, MAX(z) AS bz FROM ot GROUP BY ALL),
    dm AS (SELECT {key}GREATEST(3, CAST(CEIL((bx - ax + 32) / 8e0) AS INT) + 1) AS di, GREATEST(3, CAST(CEIL((by_ - ay + 32) / 8e0) AS INT) + 1) AS dj, GREATEST(3, CAST(CEIL((bz - az + 32) / 8e0) AS INT) + 1) AS dk FROM sbox),
    s AS (SELECT ot.*, group_name, SQRT(tx*tx + ty*ty + tz*tz) AS l, {place_sql(('x', 'y', 'z'), 2, 8.0)} FROM ot JOIN {group} {boxed}),
    b0 AS (SELECT {own}, i, j, k, COUNT(*) * 1e0 AS density, {", ".join(f"SUM({v}) AS {m}" for m, v in marks.items())} FROM s GROUP BY ALL), {", ".join(steps)}
    SELECT {own}, CAST(i AS INT) AS i, CAST(j AS INT) AS j, CAST(k AS INT) AS k, {R('density', 5)} AS density, {shown} FROM b3 WHERE density > {number(level)}"""


def _shown(out, digits=5):
    return out.withColumns({c: r(F.col(c), digits) for c in ("density", *MARKS)})


@query("bundle_envelope", sql("tan grp", _envelope_sql(["group_name"], iso_level(30.0, 1.0))))
def bundle_envelope(spark, sf):
    return _shown(envelope.bundle_envelope(fx.points(spark, sf), 8.0, 30.0, 1.0, 0.0, fx.groups(spark, sf)))


@query("bundle_envelope_cohort", sql("tan cgrp", _envelope_sql(["subject_id", "group_name"], iso_level(10.0, 1.0))))
def bundle_envelope_cohort(spark, sf):
    """Each group of each subject, on the subject's own grid."""
    return _shown(envelope.bundle_envelope(fx.by_subject(fx.points(spark, sf)), 8.0, 10.0, 1.0, 0.0, fx.by_subject(fx.groups(spark, sf))))


@query("bundle_envelope_components")
def bundle_envelope_components(spark, sf):
    out = envelope.bundle_envelope(fx.points(spark, sf), 4.0, 8.0, 0.5, 200.0, fx.groups(spark, sf))
    return out.withColumns({c: F.round(c, 4) for c in ("density", *MARKS)})


# --- streaming ----------------------------------------------------------------------


@query("stream_voxel_density", "SELECT CAST(FLOOR(value / 10) AS BIGINT) AS voxel, CAST(COUNT(*) AS BIGINT) AS density FROM events GROUP BY 1")
def stream_voxel_density(spark, sf):
    """The events file replayed as a stream to its end; the final running counts."""
    schema = fx.table(spark, sf, "events").schema
    arriving = spark.readStream.schema(schema).option("pathGlobFilter", "events.parquet").parquet(sf)
    cells = arriving.select(F.floor(F.col("value") / 10).alias("voxel"))
    sink = fx.scratch(spark)
    running = streaming.start_density(streaming.stream_voxel_density(cells), f"{sink}/counts", "density", f"{sink}/state")
    running.awaitTermination()
    return streaming.latest_batch(spark, f"{sink}/counts").select("voxel", "density")


@query("stream_voxel_density_update", sql("dims", """SELECT i, j, k, CAST(COUNT(*) AS BIGINT) AS density FROM (SELECT CAST(FLOOR((l_quantity + (l_partkey % 8) / 8e0) * 2e-1) AS INT) AS i,
    CAST(FLOOR(ROUND(l_discount * 100) * 5e0 * 2e-1) AS INT) AS j, CAST(FLOOR(ROUND(l_tax * 100) * 6.25e0 * 2e-1) AS INT) AS k FROM lineitem WHERE l_returnflag = 'R') p, dims
    WHERE i BETWEEN 0 AND nx - 1 AND j BETWEEN 0 AND ny - 1 AND k BETWEEN 0 AND nz - 1 GROUP BY 1, 2, 3"""))
def stream_voxel_density_update(spark, sf):
    """The vertices of one run as a stream in update mode: each batch writes the voxels it changed; then compacted."""
    arriving = spark.readStream.schema(fx.table(spark, sf, "lineitem").schema).option("pathGlobFilter", "lineitem.parquet").parquet(sf)
    vertices = arriving.select(
        F.col("l_returnflag").alias("run_id"), (F.col("l_quantity") + F.pmod("l_partkey", F.lit(8)) / F.lit(8.0)).alias("x"),
        (F.round(F.col("l_discount") * 100) * F.lit(5.0)).alias("y"), (F.round(F.col("l_tax") * 100) * F.lit(6.25)).alias("z"),
    )
    sink = fx.scratch(spark)
    counts = streaming.stream_voxel_density(vertices, fx.grid(spark, sf), run_id="R")
    streaming.start_density(counts, f"{sink}/counts", "density", f"{sink}/state", "update").awaitTermination()
    streaming.compact(spark, f"{sink}/counts")
    return streaming.current_counts(spark, f"{sink}/counts")
