"""Registered queries: sources, selections and per-streamline geometry."""

from __future__ import annotations

from pyspark.sql import functions as F

from axonframe.functions import geometry as geo
from axonframe.functions.scan import number_vertices
from axonframe.operators import geometry as og
from axonframe.operators import selection as sel
from axonframe.operators import sets
from axonframe.queries import fixtures as fx
from axonframe.queries.fixtures import R, query, r, sql
from axonframe.sources import catalog, tables

IDS = "SELECT DISTINCT streamline_id FROM"
LABELS = [1, 2, 3]
HIT = "SELECT DISTINCT streamline_id FROM pvr JOIN vox USING (i, j, k) WHERE label IN (1, 2, 3)"


# --- sources ------------------------------------------------------------------------


@query("read_tractogram", """
    SELECT vec_id AS subject_id, CAST(FLOOR(p / 7) AS BIGINT) AS streamline_id, CAST(p % 7 AS INT) AS point_idx,
      CAST(embedding[p + 1] AS DOUBLE) AS x, CAST(embedding[p + 22] AS DOUBLE) AS y, CAST(embedding[p + 43] AS DOUBLE) AS z
    FROM embeddings, (SELECT UNNEST(RANGE(21)) AS p)""")
def read_tractogram(spark, sf):
    """The offset-array form (here: an embedding per subject, streamlines across blocks), saved and read."""
    e = F.col("embedding").cast("array<double>")
    files = fx.table(spark, sf, "embeddings").select(
        F.col("vec_id").alias("subject_id"),
        F.array(*[F.lit(v) for v in (0, 7, 14, 21)]).alias("offsets"),
        *[F.slice(e, s, 21).alias(c) for s, c in ((1, "x"), (22, "y"), (43, "z"))],
    )
    path = fx.scratch(spark)
    for name, table in zip(("offsets", "positions"), tables.cut_offset_arrays(files, width=8), strict=True):
        table.write.mode("overwrite").parquet(f"{path}/{name}")
    return tables.read_tractogram(spark, path).points


@query("read_volume", sql("vox", f"""SELECT i, j, k, {R('(value - lo) / (hi - lo)')} AS value
    FROM vox, (SELECT MIN(value) AS lo, MAX(value) AS hi FROM vox)"""))
def read_volume(spark, sf):
    path = fx.scratch(spark)
    fx.voxels(spark, sf).write.mode("overwrite").parquet(path)
    return tables.read_volume(spark, path, normalize=True).select("i", "j", "k", r(F.col("value")).alias("value"))


@query("read_surface", sql("srf tri", """SELECT tri_id, a.vertex_id AS first_vertex, a.x, a.y, a.z FROM tri JOIN srf a ON v0 = a.vertex_id"""))
def read_surface(spark, sf):
    path = fx.scratch(spark)
    fx.surface(spark, sf).write.mode("overwrite").parquet(f"{path}/vertices")
    fx.triangles(spark, sf).write.mode("overwrite").parquet(f"{path}/triangles")
    vertices, triangles = tables.read_surface(spark, path)
    first = vertices.withColumnRenamed("vertex_id", "v0")
    return triangles.join(first, "v0").select("tri_id", F.col("v0").alias("first_vertex"), "x", "y", "z")


@query("read_parcellation", sql("vox lab", """SELECT CAST(l AS INT) AS label, COALESCE(n.name, 'Label ' || l) AS label_name,
      CAST(COUNT(*) AS BIGINT) AS n_voxels FROM (SELECT GREATEST(label - 2, 0) AS l FROM vox) v
    LEFT JOIN (SELECT * FROM lab WHERE label % 2 = 0) n ON v.l = n.label WHERE l > 0 GROUP BY 1, 2"""))
def read_parcellation(spark, sf):
    path = fx.scratch(spark)
    fx.parcels(spark, sf).withColumn("label", F.col("label") - 2).write.mode("overwrite").parquet(path)
    named = fx.parcel_labels(spark, sf).filter("label % 2 = 0")
    parcels, labels = tables.read_parcellation(spark, path, named)
    sizes = parcels.groupBy("label").agg(F.count("*").alias("n_voxels"))
    return labels.join(sizes, "label").select("label", "label_name", "n_voxels")


LINES = """SELECT o_orderkey AS line_no, 'lut' || (o_orderkey % 3) AS file, CASE CAST(o_orderkey % 7 AS INT)
    WHEN 0 THEN '# comment ' || o_orderkey
    WHEN 1 THEN (o_custkey % 400) || ', "Area ' || o_custkey || '"'
    WHEN 2 THEN (o_custkey % 400) || ',Area ' || o_custkey || ',' || (o_custkey % 256) || ',10,20,255'
    WHEN 3 THEN '  ' || (o_custkey % 400) || '   Area ' || o_custkey || ' ' || (o_custkey % 256) || ' 30 40'
    WHEN 4 THEN (o_custkey % 400) || ' Long Area Name ' || (o_custkey % 256) || ' 50 60 0'
    WHEN 5 THEN 'x' || o_custkey || ' not a label'
    ELSE (o_custkey % 400) || ' Plain' END AS value FROM orders"""


@query("read_label_tables", f"""
    WITH lines AS ({LINES}),
    made AS (SELECT file, line_no, CAST(regexp_extract(TRIM(value), '^([0-9]+)', 1) AS BIGINT) AS label,
        CASE WHEN value LIKE '%,%' THEN TRIM(BOTH '"' FROM TRIM(split_part(value, ',', 2)))
             WHEN line_no % 7 = 3 THEN regexp_extract(TRIM(value), '^[0-9]+ +(.*) [0-9]+ 30 40$', 1)
             WHEN line_no % 7 = 4 THEN regexp_extract(TRIM(value), '^[0-9]+ (.*) 50 60 0$', 1)
             ELSE 'Plain' END AS name0,
        CASE line_no % 7 WHEN 2 THEN CAST(split_part(value, ',', 3) AS DOUBLE) / 255 WHEN 3 THEN CAST(regexp_extract(value, ' ([0-9]+) 30 40$', 1) AS DOUBLE) / 255
             WHEN 4 THEN 50 / 255e0 END AS r0,
        CASE line_no % 7 WHEN 2 THEN 10 / 255e0 WHEN 3 THEN 30 / 255e0 WHEN 4 THEN 60 / 255e0 END AS g0,
        CASE line_no % 7 WHEN 2 THEN 20 / 255e0 WHEN 3 THEN 40 / 255e0 WHEN 4 THEN 0e0 END AS b0,
        CASE line_no % 7 WHEN 2 THEN 1e0 WHEN 3 THEN 1e0 WHEN 4 THEN 1e0 ELSE 0.95e0 END AS a
        FROM lines WHERE line_no % 7 NOT IN (0, 5)),
    last AS (SELECT * FROM made QUALIFY ROW_NUMBER() OVER (PARTITION BY file, label ORDER BY line_no DESC) = 1),
    mix AS (SELECT *, (label * 2654435769) % 4294967296 AS m FROM last)
    SELECT file, label, name0 AS name,
      {R("COALESCE(r0, LEAST(0.95e0, GREATEST(0.2e0, (m % 256) / 255e0)))")} AS r,
      {R("COALESCE(g0, LEAST(0.95e0, GREATEST(0.2e0, ((m >> 8) % 256) / 255e0)))")} AS g,
      {R("COALESCE(b0, LEAST(0.95e0, GREATEST(0.2e0, ((m >> 16) % 256) / 255e0)))")} AS b, {R("a")} AS a FROM mix""")
def read_label_tables(spark, sf):
    """Label lines in both layouts; three trailing bytes are read as a colour before four."""
    fx.table(spark, sf, "orders").createOrReplaceTempView("orders")
    path = fx.scratch(spark)
    # A text file per table, its lines in order, whatever the number of tasks that read it.
    lines = spark.sql(LINES).repartitionByRange("file").sortWithinPartitions("file", "line_no")
    lines.select(F.col("file").alias("lut"), "value").write.mode("overwrite").partitionBy("lut").text(path)
    parsed = tables.read_label_tables(spark, f"{path}/lut=*")
    return parsed.select(F.regexp_extract("file", "lut=([^/]+)/", 1).alias("file"), "label", "name", *[r(F.col(c)).alias(c) for c in "rgba"])


@query("read_cifti_tables", sql("mat bm", "SELECT structure, map_id, CAST(COUNT(*) AS BIGINT) AS n FROM mat JOIN bm USING (col) GROUP BY 1, 2"))
def read_cifti_tables(spark, sf):
    path = fx.scratch(spark)
    fx.cifti_matrix(spark, sf).write.mode("overwrite").parquet(f"{path}/matrix")
    fx.brain_models(spark, sf).write.mode("overwrite").parquet(f"{path}/models")
    matrix, models = tables.read_cifti_tables(spark, path)
    return matrix.join(models, "col").groupBy("structure", "map_id").agg(F.count("*").alias("n"))


@query("read_orientation", sql("odx fix", f"SELECT k, CAST(COUNT(*) AS BIGINT) AS n_fixels, {R('AVG(amplitude)')} AS mean_amplitude FROM odx JOIN fix USING (voxel_id) GROUP BY k"))
def read_orientation(spark, sf):
    path = fx.scratch(spark)
    fx.odx_voxels(spark, sf).write.mode("overwrite").parquet(f"{path}/voxels")
    fx.fixels(spark, sf).write.mode("overwrite").parquet(f"{path}/fixels")
    fx.amplitudes(spark, sf).write.mode("overwrite").parquet(f"{path}/odf")
    scene = tables.read_orientation(spark, path)
    both = scene["fixels"].join(scene["voxels"], "voxel_id")
    return both.groupBy("k").agg(F.count("*").alias("n_fixels"), r(F.avg("amplitude")).alias("mean_amplitude"))


@query("write_tractogram", sql("pts grp", f"""WITH picked AS ({HIT.replace('pvr', '(SELECT *, CAST(ROUND(x * 2e-1) AS INT) AS i, CAST(ROUND(y * 2e-1) AS INT) AS j, CAST(ROUND(z * 2e-1) AS INT) AS k FROM pts)').replace('vox', '(SELECT CAST(p_partkey % 10 AS INT) AS i, CAST(FLOOR(p_partkey / 10) AS INT) % 10 AS j, CAST(FLOOR(p_partkey / 100) AS INT) AS k, p_size % 9 AS label FROM part)')}),
    named AS (SELECT streamline_id, ROW_NUMBER() OVER (ORDER BY streamline_id) - 1 AS new_id FROM picked)
    SELECT new_id AS streamline_id, group_name, CAST((SELECT COUNT(*) FROM pts WHERE pts.streamline_id = named.streamline_id) AS BIGINT) AS n_points
    FROM named JOIN grp USING (streamline_id)"""))
def write_tractogram(spark, sf):
    """Save the streamlines touching labels 1-3 and read the result back."""
    pts = fx.points(spark, sf)
    chosen = sel.parcel_roi(pts, fx.parcels(spark, sf), fx.grid(spark, sf), LABELS)
    path = fx.scratch(spark)
    tables.write_tractogram(sets.Tractogram(pts, fx.groups(spark, sf)), chosen, path)
    saved = tables.read_tractogram(spark, path)
    sizes = saved.points.groupBy("streamline_id").agg(F.count("*").alias("n_points"))
    return saved.groups.join(sizes, "streamline_id").select("streamline_id", "group_name", "n_points")


@query("concat_tractograms", sql("pts grp", """
    WITH a AS (SELECT * FROM pts WHERE streamline_id % 3 < 2), b AS (SELECT * FROM pts WHERE streamline_id % 3 > 0),
    ord AS (SELECT part, streamline_id, ROW_NUMBER() OVER (ORDER BY part, streamline_id) - 1 AS new_id FROM
      (SELECT DISTINCT 0 AS part, streamline_id FROM a UNION ALL SELECT DISTINCT 1, streamline_id FROM b)),
    g AS (SELECT new_id, CASE part WHEN 0 THEN 'left' ELSE 'right' END AS group_name FROM ord
      UNION SELECT new_id, group_name FROM ord JOIN grp USING (streamline_id)),
    n AS (SELECT streamline_id, COUNT(*) AS n_points FROM pts GROUP BY 1)
    SELECT new_id AS streamline_id, group_name, CAST(n_points AS BIGINT) AS n_points FROM g JOIN ord USING (new_id) JOIN n USING (streamline_id)"""))
def concat_tractograms(spark, sf):
    pts, groups = fx.points(spark, sf), fx.groups(spark, sf)

    # Two sets that together hold all streamlines and share a third of them.
    def share(part):
        return sets.Tractogram(pts.filter(part), groups.filter(part))

    both = sets.concat_tractograms([(share("streamline_id % 3 < 2"), "left"), (share("streamline_id % 3 > 0"), "right")])
    sizes = both.points.groupBy("streamline_id").agg(F.count("*").alias("n_points"))
    return both.groups.join(sizes, "streamline_id").select("streamline_id", "group_name", "n_points")


# --- file names ---------------------------------------------------------------------

CATALOG = """
    WITH names AS (SELECT path, regexp_extract(path, '[^/]*$') AS name FROM pth),
    b AS (SELECT n_name AS bundle, REPLACE(n_name, '_', '') AS d, 'N' || n_nationkey AS lk FROM nation),
    m AS (SELECT bundle, path, name, regexp_extract(name, '_space-ASIA_desc-' || d || '(.*)$', 1) AS tail FROM names JOIN b ON name LIKE '%\\_space-ASIA\\_desc-' || d || '%' ESCAPE '\\'),
    cur AS (SELECT bundle, CASE WHEN tail LIKE 'Include%' THEN 'include' WHEN tail LIKE 'Exclude%' THEN 'exclude'
        WHEN tail = 'Start_mask.nii.gz' THEN 'start' WHEN tail = 'End_mask.nii.gz' THEN 'end' ELSE 'probmap' END AS role,
        CASE WHEN tail LIKE 'Include%' OR tail LIKE 'Exclude%' THEN CAST(regexp_extract(tail, '([0-9]+)_mask', 1) AS BIGINT) END AS idx, path
      FROM m WHERE regexp_matches(tail, '^((Include|Exclude)[0-9]+|Start|End)_mask.nii.gz$') OR tail = '_probseg.nii.gz'),
    leg AS (SELECT bundle, 'include' AS role, CAST(regexp_extract(name, '-([0-9]+)-include.nii.gz$', 1) AS BIGINT) AS idx, path
      FROM names JOIN b ON regexp_matches(name, '_desc-ROI-' || lk || '-[0-9]+-include.nii.gz$') WHERE name LIKE '%\\_space-ASIA\\_%' ESCAPE '\\'),
    alls AS (SELECT * FROM cur UNION ALL SELECT * FROM leg),
    own AS (SELECT regexp_extract(path, '/sub-([A-Za-z0-9]+)', 1) AS subject_id, CAST(NULL AS VARCHAR) AS session_id, * FROM alls)
    SELECT subject_id, session_id, bundle, role, idx, path FROM own WHERE role IN ('include', 'exclude')
    UNION ALL SELECT subject_id, session_id, bundle, role, NULL, MAX(path) FROM own WHERE role NOT IN ('include', 'exclude') GROUP BY 1, 2, 3, 4"""


@query("catalog_derivatives", sql("pth", CATALOG))
def catalog_derivatives(spark, sf):
    return catalog.catalog_derivatives(fx.paths(spark, sf), fx.bundles(spark, sf), "ASIA")


@query("available_bundles", sql("pth", r"""
    WITH b AS (SELECT n_name AS bundle, REPLACE(n_name, '_', '') AS d, 'N' || n_nationkey AS lk FROM nation)
    SELECT DISTINCT bundle FROM b JOIN pth ON (path LIKE '%\_space-ASIA\_desc-' || d || '%' ESCAPE '\' AND (path LIKE '%\_mask.nii.gz' ESCAPE '\' OR path LIKE '%\_probseg%' ESCAPE '\'))
      OR (path LIKE '%\_space-ASIA\_%' ESCAPE '\' AND path LIKE '%\_desc-ROI-' || lk || '-%' ESCAPE '\')"""))
def available_bundles(spark, sf):
    return catalog.available_bundles(fx.paths(spark, sf), fx.bundles(spark, sf), "ASIA")


@query("detect_spaces", sql("pth", "SELECT DISTINCT regexp_extract(path, '_space-([^_]+)', 1) AS space FROM pth"))
def detect_spaces(spark, sf):
    return catalog.detect_spaces(fx.paths(spark, sf))


@query("pick_space", sql("pth", r"""SELECT space, CAST(COUNT(*) FILTER (WHERE path LIKE '%\_mask.nii.gz' ESCAPE '\' OR path LIKE '%\_probseg%' ESCAPE '\') AS BIGINT) AS n_roi,
    CAST(COUNT(*) AS BIGINT) AS n_any FROM (SELECT path, regexp_extract(path, '_space-([^_]+)', 1) AS space FROM pth) GROUP BY 1 ORDER BY n_roi DESC, space LIMIT 1"""))
def pick_space(spark, sf):
    return catalog.pick_space(fx.paths(spark, sf))


ASSETS = """SELECT '/data/' || s_nationkey || '/f' || s_suppkey || CASE CAST(s_suppkey % 13 AS INT)
    WHEN 0 THEN '.nii.gz' WHEN 1 THEN '.nii' WHEN 2 THEN '_atlas.nii.gz' WHEN 3 THEN '.trx' WHEN 4 THEN '.TCK' WHEN 5 THEN '.dscalar.nii'
    WHEN 6 THEN '.surf.gii' WHEN 7 THEN '.odx' WHEN 8 THEN '.fib.gz' WHEN 9 THEN '.mif' WHEN 10 THEN '.txt' WHEN 11 THEN '.ptseries.nii' ELSE '.xyz' END AS path FROM supplier
    UNION ALL SELECT '/data/' || s_nationkey || '/f' || s_suppkey || CASE CAST(s_suppkey % 39 AS INT) WHEN 1 THEN '.csv' WHEN 14 THEN '.lut' ELSE '.md' END FROM supplier"""


@query("classify_assets", f"""
    WITH a AS ({ASSETS}), n AS (SELECT path, LOWER(regexp_extract(path, '[^/]*$')) AS f, regexp_replace(path, '\\.[^.]*$', '') AS stem FROM a)
    SELECT path, CASE WHEN regexp_matches(f, '\\.(odx|odxd|fib\\.gz|fz|pam5|mif|mif\\.gz)$') THEN 'orientation'
      WHEN regexp_matches(f, '\\.(trx|trk|tck|vtk|tt)$') THEN 'streamlines'
      WHEN regexp_matches(f, '\\.(dscalar|dlabel|dtseries|pscalar)\\.nii$') THEN 'cifti'
      WHEN regexp_matches(f, '\\.nii(\\.gz)?$') THEN CASE WHEN EXISTS (SELECT 1 FROM n t WHERE t.stem = n.stem AND regexp_matches(t.f, '\\.(txt|lut|csv|tsv)$'))
        OR regexp_matches(f, '(parc|atlas|label|seg)') THEN 'parcellation' ELSE 'volume' END
      WHEN regexp_matches(f, '\\.(gii|gifti)$') THEN 'surface' ELSE 'unsupported' END AS kind FROM n""")
def classify_assets(spark, sf):
    fx.table(spark, sf, "supplier").createOrReplaceTempView("supplier")
    return catalog.classify_assets(spark.sql(ASSETS))


@query("guess_label_table", f"""
    WITH a AS ({ASSETS}), n AS (SELECT path, regexp_replace(path, '\\.[^.]*$', '') AS stem FROM a)
    SELECT v.path, MIN(t.path) AS label_table FROM n v LEFT JOIN n t ON v.stem = t.stem AND regexp_matches(t.path, '\\.(txt|lut|csv|tsv)$')
    WHERE regexp_matches(LOWER(v.path), '\\.nii(\\.gz)?$') GROUP BY v.path""")
def guess_label_table(spark, sf):
    fx.table(spark, sf, "supplier").createOrReplaceTempView("supplier")
    return catalog.guess_label_table(spark.sql(ASSETS))


@query("bundle_desc", "SELECT c_custkey, REPLACE(REPLACE(REPLACE(c_mktsegment || ' ' || c_name || '_a-b', ' ', ''), '_', ''), '-', '') AS bundle FROM customer")
def bundle_desc(spark, sf):
    name = F.concat("c_mktsegment", F.lit(" "), "c_name", F.lit("_a-b"))
    return fx.table(spark, sf, "customer").select("c_custkey", catalog.bundle_desc(name).alias("bundle"))


# --- group and shape selections -----------------------------------------------------


@query("group_select", sql("grp", f"{IDS} grp WHERE group_name IN ('A', 'R')"))
def group_select(spark, sf):
    g = fx.groups(spark, sf)
    return sel.group_select(sel.ids(g), g, ["A", "R"])


@query("group_filter_from_csv", sql("grp", f"{IDS} grp WHERE group_name IN ('N', 'R')"))
def group_filter_from_csv(spark, sf):
    g = fx.groups(spark, sf)
    return sel.group_select(sel.ids(g), g, ["A"], override=sel.group_filter_from_csv(" N, R ,"))


@query("split_by_group", sql("grp", "SELECT group_name, streamline_id FROM grp"))
def split_by_group(spark, sf):
    g = fx.groups(spark, sf)
    return sel.split_by_group(sel.ids(g), g).select("group_name", "streamline_id")


@query("parcel_select", sql("vox", "SELECT DISTINCT label FROM vox WHERE label <> 0"))
def parcel_select(spark, sf):
    return sel.parcel_select(fx.parcels(spark, sf))


@query("sphere_query", sql("pts", f"{IDS} pts WHERE (x-25)*(x-25) + (y-25)*(y-25) + (z-25)*(z-25) <= 100"))
def sphere_query(spark, sf):
    return sel.sphere_query(fx.points(spark, sf), (25.0, 25.0, 25.0), 10.0)


@query("bbox_filter", sql("pts", """SELECT streamline_id, MIN(x) AS min_x, MAX(z) AS max_z FROM pts GROUP BY 1
    HAVING MIN(x) <= 12 AND MAX(x) >= 10 AND MIN(y) <= 20 AND MAX(y) >= 5 AND MIN(z) <= 30 AND MAX(z) >= 20"""))
def bbox_filter(spark, sf):
    boxes = og.streamline_aabbs(fx.points(spark, sf))
    return sel.bbox_filter(boxes, (10, 5, 20), (12, 20, 30)).select("streamline_id", "min_x", "max_z")


@query("surface_depth_query", sql("pts srf", f"{IDS} (SELECT p.streamline_id FROM pts p JOIN srf s ON ABS(p.x - s.x) <= 2 AND ABS(p.y - s.y) <= 2 AND ABS(p.z - s.z) <= 2 WHERE (p.x-s.x)*(p.x-s.x) + (p.y-s.y)*(p.y-s.y) + (p.z-s.z)*(p.z-s.z) <= 4)"))
def surface_depth_query(spark, sf):
    return sel.surface_depth_query(fx.points(spark, sf), fx.surface(spark, sf), 2.0)


@query("parcel_roi", sql("pvr vox", HIT))
def parcel_roi(spark, sf):
    return sel.parcel_roi(fx.points(spark, sf), fx.parcels(spark, sf), fx.grid(spark, sf), LABELS)


@query("parcel_roa", sql("pvr vox", f"{IDS} pts WHERE streamline_id NOT IN ({HIT})"))
def parcel_roa(spark, sf):
    return sel.parcel_roa(fx.points(spark, sf), fx.parcels(spark, sf), fx.grid(spark, sf), LABELS)


@query("parcel_end", sql("endr vox", """SELECT streamline_id FROM (SELECT *, CAST(ROUND(x * 2e-1) AS INT) AS i, CAST(ROUND(y * 2e-1) AS INT) AS j,
    CAST(ROUND(z * 2e-1) AS INT) AS k FROM endr) JOIN vox USING (i, j, k) WHERE label IN (1, 2, 3) GROUP BY streamline_id HAVING COUNT(*) >= 2"""))
def parcel_end(spark, sf):
    return sel.parcel_end(fx.points(spark, sf), fx.parcels(spark, sf), fx.grid(spark, sf), LABELS, 2)


def _crop_sql(keep: str) -> str:
    return sql("pvr vox", f"""
    WITH st AS (SELECT p.streamline_id, p.point_idx, p.x, p.y, p.z, COALESCE(v.label IN (1, 2, 3), FALSE) = {keep} AS ok
        FROM pvr p LEFT JOIN vox v USING (i, j, k)),
    lg AS (SELECT *, LAG(ok) OVER w AS pok, LAG(x) OVER w AS px, LAG(y) OVER w AS py, LAG(z) OVER w AS pz, COUNT(*) OVER (PARTITION BY streamline_id) AS n
        FROM st WINDOW w AS (PARTITION BY streamline_id ORDER BY point_idx)),
    rn AS (SELECT *, SUM(CASE WHEN pok <> ok THEN 1 ELSE 0 END) OVER (PARTITION BY streamline_id ORDER BY point_idx) AS run FROM lg WHERE n > 1),
    em AS (SELECT streamline_id, run, point_idx + 0.0 AS pos, x, y, z FROM rn WHERE ok
        UNION ALL SELECT streamline_id, CASE WHEN ok THEN run ELSE run - 1 END, point_idx - 0.5, (px + x) / 2, (py + y) / 2, (pz + z) / 2 FROM rn WHERE pok <> ok)
    SELECT streamline_id, CAST(run AS BIGINT) AS run, CAST(ROW_NUMBER() OVER (PARTITION BY streamline_id, run ORDER BY pos) - 1 AS INT) AS point_idx, x, y, z
    FROM em QUALIFY COUNT(*) OVER (PARTITION BY streamline_id, run) >= 2""")


@query("parcel_crop", _crop_sql("TRUE"))
def parcel_crop(spark, sf):
    return sel.parcel_crop(fx.points(spark, sf), fx.parcels(spark, sf), fx.grid(spark, sf), LABELS, True)


@query("parcel_crop_outside", _crop_sql("FALSE"))
def parcel_crop_outside(spark, sf):
    return sel.parcel_crop(fx.points(spark, sf), fx.parcels(spark, sf), fx.grid(spark, sf), LABELS, False)


@query("mask_hits_all", sql("pvf msks", "SELECT streamline_id FROM pvf JOIN msks USING (i, j, k) WHERE mask_id IN ('large', 'low') GROUP BY 1 HAVING COUNT(DISTINCT mask_id) = 2"))
def mask_hits_all(spark, sf):
    return sel.mask_hits_all(fx.points(spark, sf), fx.masks(spark, sf), fx.grid(spark, sf), ["large", "low"])


TIP = "(SELECT *, CAST(FLOOR(x * 2e-1) AS INT) AS i, CAST(FLOOR(y * 2e-1) AS INT) AS j, CAST(FLOOR(z * 2e-1) AS INT) AS k FROM endr WHERE n >= 2)"


@query("mask_endpoint_in", sql("endr msks", f"{IDS} {TIP} JOIN msks USING (i, j, k) WHERE mask_id = 'even'"))
def mask_endpoint_in(spark, sf):
    return sel.mask_endpoint_in(fx.points(spark, sf), fx.masks(spark, sf), fx.grid(spark, sf), "even")


@query("mask_end_regions", sql("endr msks", f"SELECT streamline_id FROM {TIP} JOIN msks USING (i, j, k) WHERE mask_id IN ('large', 'low') GROUP BY 1 HAVING COUNT(DISTINCT mask_id) = 2"))
def mask_end_regions(spark, sf):
    return sel.mask_end_regions(fx.points(spark, sf), fx.masks(spark, sf), fx.grid(spark, sf), ["large", "low"])


@query("mask_avoid", sql("pvf msks", f"{IDS} pts WHERE streamline_id NOT IN (SELECT streamline_id FROM pvf JOIN msks USING (i, j, k) WHERE mask_id = 'low')"))
def mask_avoid(spark, sf):
    return sel.mask_avoid(fx.points(spark, sf), fx.masks(spark, sf), fx.grid(spark, sf), "low")


@query("mask_limit_truncate", sql("pvf msks", """
    WITH f AS (SELECT streamline_id, point_idx, x, y, z,
        EXISTS (SELECT 1 FROM msks m WHERE m.mask_id = 'even' AND m.i = p.i AND m.j = p.j AND m.k = p.k) AS lim,
        EXISTS (SELECT 1 FROM msks m WHERE m.mask_id = 'large' AND m.i = p.i AND m.j = p.j AND m.k = p.k) AS term FROM pvf p),
    c AS (SELECT streamline_id, LEAST(MIN(CASE WHEN NOT lim THEN point_idx END), MIN(CASE WHEN term THEN point_idx + 1 END)) AS cut FROM f GROUP BY 1)
    SELECT streamline_id, point_idx, x, y, z FROM f JOIN c USING (streamline_id) WHERE cut IS NULL OR point_idx < cut"""))
def mask_limit_truncate(spark, sf):
    pts = fx.points(spark, sf, ())
    return sel.mask_limit_truncate(pts, fx.masks(spark, sf), fx.grid(spark, sf), limiting="even", term="large")


@query("length_filter", sql("pts len", f"""SELECT streamline_id, {R('COALESCE(length_mm, 0)')} AS length_mm FROM (SELECT DISTINCT streamline_id FROM pts)
    LEFT JOIN len USING (streamline_id) WHERE COALESCE(length_mm, 0) BETWEEN 40 AND 120"""))
def length_filter(spark, sf):
    return sel.length_filter(fx.points(spark, sf), 40.0, 120.0).withColumn("length_mm", r(F.col("length_mm")))


# The streamlines of group R are the reference.
HAUSDORFF = """WITH ref AS (SELECT DISTINCT x, y, z FROM pts JOIN grp USING (streamline_id) WHERE group_name = 'R'),
    u AS (SELECT DISTINCT x, y, z FROM pts),
    d AS (SELECT u.x, u.y, u.z, SQRT(MIN((u.x-r.x)*(u.x-r.x) + (u.y-r.y)*(u.y-r.y) + (u.z-r.z)*(u.z-r.z))) AS d FROM u, ref r GROUP BY 1, 2, 3)"""


@query("hausdorff_filter", sql("pts grp", f"{HAUSDORFF} SELECT streamline_id, {R('AVG(d)')} AS mean_distance_mm FROM pts JOIN d USING (x, y, z) GROUP BY 1 HAVING AVG(d) <= 1"))
def hausdorff_filter(spark, sf):
    """All streamlines against all points of a group."""
    pts = fx.points(spark, sf)
    cloud = sel.keep(pts, sel.group_select(sel.ids(pts), fx.groups(spark, sf), ["R"]))
    return sel.hausdorff_filter(pts, cloud, 1.0).select("streamline_id", r(F.col("mean_distance_mm")).alias("mean_distance_mm"))


@query("hausdorff_filter_cohort", sql("cpts cgrp", f"""WITH ref AS (SELECT DISTINCT subject_id, x, y, z FROM cpts JOIN cgrp USING (subject_id, streamline_id) WHERE group_name = 'R'),
    u AS (SELECT DISTINCT subject_id, x, y, z FROM cpts),
    d AS (SELECT subject_id, u.x, u.y, u.z, SQRT(MIN((u.x-r.x)*(u.x-r.x) + (u.y-r.y)*(u.y-r.y) + (u.z-r.z)*(u.z-r.z))) AS d FROM u JOIN ref r USING (subject_id) GROUP BY ALL)
    SELECT subject_id, streamline_id, {R('AVG(d)')} AS mean_distance_mm FROM cpts JOIN d USING (subject_id, x, y, z) GROUP BY 1, 2 HAVING AVG(d) <= 2"""))
def hausdorff_filter_cohort(spark, sf):
    """Each subject against its own reference."""
    pts, groups = fx.by_subject(fx.points(spark, sf)), fx.by_subject(fx.groups(spark, sf))
    cloud = sel.keep(pts, sel.group_select(sel.ids(pts), groups, ["R"]))
    return sel.hausdorff_filter(pts, cloud, 2.0).select("subject_id", "streamline_id", r(F.col("mean_distance_mm")).alias("mean_distance_mm"))


@query("surface_depth_query_cohort", sql("cpts csrf", """SELECT DISTINCT subject_id, streamline_id FROM cpts p JOIN csrf s USING (subject_id)
    WHERE (p.x-s.x)*(p.x-s.x) + (p.y-s.y)*(p.y-s.y) + (p.z-s.z)*(p.z-s.z) <= 9"""))
def surface_depth_query_cohort(spark, sf):
    return sel.surface_depth_query(fx.by_subject(fx.points(spark, sf)), fx.by_subject(fx.surface(spark, sf), "vertex_id"), 3.0)


# --- points, lengths, boxes ---------------------------------------------------------


@query("points_to_voxels", sql("pvr dims", "SELECT streamline_id, point_idx, i, j, k FROM pvr, dims WHERE i BETWEEN 0 AND 9 AND j BETWEEN 0 AND 9 AND k BETWEEN 0 AND dims.nz - 1"))
def points_to_voxels(spark, sf):
    return geo.points_to_voxels(fx.points(spark, sf), fx.grid(spark, sf), "round").select("streamline_id", "point_idx", "i", "j", "k")


@query("points_to_voxels_floor", sql("pvf dims", "SELECT streamline_id, point_idx, i, j, k FROM pvf, dims WHERE i BETWEEN 0 AND 9 AND j BETWEEN 0 AND 9 AND k BETWEEN 0 AND dims.nz - 1"))
def points_to_voxels_floor(spark, sf):
    return geo.points_to_voxels(fx.points(spark, sf), fx.grid(spark, sf), "floor").select("streamline_id", "point_idx", "i", "j", "k")


@query("tractogram_summary", sql("pts", """SELECT CAST(COUNT(DISTINCT streamline_id) AS BIGINT) AS n_streamlines, CAST(COUNT(*) AS BIGINT) AS n_vertices,
    MIN(x) AS min_x, MAX(x) AS max_x, (MIN(y) + MAX(y)) / 2 AS center_y, MAX(z) - MIN(z) AS extent_z FROM pts"""))
def tractogram_summary(spark, sf):
    return og.tractogram_summary(fx.points(spark, sf)).select("n_streamlines", "n_vertices", "min_x", "max_x", "center_y", "extent_z")


@query("streamline_aabbs", sql("pts", "SELECT streamline_id, MIN(x) AS min_x, MIN(y) AS min_y, MIN(z) AS min_z, MAX(x) AS max_x, MAX(y) AS max_y, MAX(z) AS max_z FROM pts GROUP BY 1"))
def streamline_aabbs(spark, sf):
    return og.streamline_aabbs(fx.points(spark, sf))


@query("streamline_length", sql("len", f"SELECT streamline_id, {R('length_mm')} AS length_mm FROM len"))
def streamline_length(spark, sf):
    return og.streamline_length(fx.points(spark, sf)).withColumn("length_mm", r(F.col("length_mm")))


@query("length_extents", sql("len", f"SELECT {R('MIN(length_mm)')} AS min_length_mm, {R('MAX(length_mm)')} AS max_length_mm FROM len WHERE length_mm > 0"))
def length_extents(spark, sf):
    out = og.length_extents(fx.points(spark, sf))
    return out.select(*[r(F.col(c)).alias(c) for c in out.columns])


@query("tangents", sql("tan", f"SELECT streamline_id, point_idx, {R('tx')} AS tx, {R('ty')} AS ty, {R('tz')} AS tz FROM tan"))
def tangents(spark, sf):
    return og.tangents(fx.points(spark, sf)).select("streamline_id", "point_idx", *[r(F.col(c)).alias(c) for c in ("tx", "ty", "tz")])


@query("segments", sql("segu", f"SELECT streamline_id, segment_idx, mx, my, mz, {R('length')} AS length, {R('ux')} AS ux, {R('uz')} AS uz FROM segu"))
def segments(spark, sf):
    out = og.segments(fx.points(spark, sf))
    return out.select("streamline_id", "segment_idx", "mx", "my", "mz", *[r(F.col(c)).alias(c) for c in ("length", "ux", "uz")])


@query("endpoints", sql("ends", "SELECT streamline_id, fx, fy, fz, lx, ly, lz, CAST(n AS BIGINT) AS n_points FROM ends"))
def endpoints(spark, sf):
    out = og.endpoints(fx.points(spark, sf))
    return out.select("streamline_id", *[F.col(e)[c].alias(e[0] + c) for e in ("first", "last") for c in "xyz"], "n_points")


@query("trim_segments", sql("seg", """SELECT streamline_id, segment_idx FROM (SELECT *, COUNT(*) OVER (PARTITION BY streamline_id) AS n FROM seg)
    WHERE segment_idx >= FLOOR(n * 0.3e0) AND segment_idx < n - FLOOR(n * 0.3e0)"""))
def trim_segments(spark, sf):
    return og.trim_segments(og.segments(fx.points(spark, sf)), 0.3).select("streamline_id", "segment_idx")


@query("dedup_consecutive", sql("", """WITH p AS (SELECT l_orderkey AS streamline_id, ROW_NUMBER() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey) - 1 AS point_idx,
        CAST(l_quantity AS INT) AS q FROM lineitem),
    w AS (SELECT streamline_id, point_idx, q AS last, TRUE AS kept FROM p WHERE point_idx = 0
      UNION ALL SELECT p.streamline_id, p.point_idx, CASE WHEN ABS(p.q - w.last) >= 4 THEN p.q ELSE w.last END, ABS(p.q - w.last) >= 4
      FROM w JOIN p ON p.streamline_id = w.streamline_id AND p.point_idx = w.point_idx + 1)
    SELECT streamline_id, CAST(point_idx AS INT) AS point_idx FROM w WHERE kept""", recursive=True))
def dedup_consecutive(spark, sf):
    """Vertices crept along x in steps of 0.00003 mm, so four steps reach the tolerance."""
    rows = fx.vertices_of(spark, sf).select(
        F.col("l_orderkey").alias("streamline_id"), "point_idx", (F.col("l_quantity") * 3e-5).alias("x"),
        F.lit(0.0).alias("y"), F.lit(0.0).alias("z"),
    )
    return og.dedup_consecutive(rows).select("streamline_id", "point_idx")


@query("expand_dps_to_vertices", sql("pts dps", "SELECT streamline_id, point_idx, COALESCE(value, 0) AS price FROM pts LEFT JOIN dps USING (streamline_id)"))
def expand_dps_to_vertices(spark, sf):
    return sel.expand_dps_to_vertices(fx.points(spark, sf), fx.dps(spark, sf), "price").select("streamline_id", "point_idx", "price")


@query("select_dps", sql("dps", "SELECT streamline_id, value FROM dps"))
def select_dps(spark, sf):
    return sel.select_field(fx.dps(spark, sf), "price").select("streamline_id", "value")


@query("slab_filter", sql("pts", "SELECT streamline_id, point_idx FROM pts WHERE ABS((x - 25) * 0.6e0 + (z - 25) * 0.8e0) <= 4"))
def slab_filter(spark, sf):
    return og.slab_filter(fx.points(spark, sf), (25, 25, 25), (0.6, 0.0, 0.8), 4.0).select("streamline_id", "point_idx")


# --- limits, samples, sets ----------------------------------------------------------


@query("limit_streamlines", sql("pts", f"{IDS} pts ORDER BY streamline_id LIMIT 250"))
def limit_streamlines(spark, sf):
    return sel.limit_streamlines(sel.ids(fx.points(spark, sf)), 250)


def _random_sql(n: int, seed: int) -> str:
    return f"SELECT streamline_id FROM (SELECT DISTINCT streamline_id FROM pts) ORDER BY substr(md5('{seed}:' || streamline_id), 1, 15), streamline_id LIMIT {n}"


@query("limit_streamlines_random", sql("pts", _random_sql(250, 7)))
def limit_streamlines_random(spark, sf):
    return sel.limit_streamlines(sel.ids(fx.points(spark, sf)), 250, randomize=True, seed=7)


@query("random_subset", sql("pts", _random_sql(200, 42)))
def random_subset(spark, sf):
    return sel.random_subset(sel.ids(fx.points(spark, sf)), 200, 42)


@query("random_subset_cohort", sql("cpts", """SELECT subject_id, streamline_id FROM (SELECT DISTINCT subject_id, streamline_id FROM cpts)
    QUALIFY ROW_NUMBER() OVER (PARTITION BY subject_id ORDER BY substr(md5('42:' || subject_id || ':' || streamline_id), 1, 15), streamline_id) <= 200"""))
def random_subset_cohort(spark, sf):
    """As many of each subject."""
    return sel.random_subset(sel.ids(fx.by_subject(fx.points(spark, sf))), 200, 42)


@query("stride_sample", sql("pts", "SELECT streamline_id FROM (SELECT streamline_id, ROW_NUMBER() OVER (ORDER BY streamline_id) - 1 AS n FROM (SELECT DISTINCT streamline_id FROM pts)) WHERE n % 7 = 0"))
def stride_sample(spark, sf):
    return sel.stride_sample(sel.ids(fx.points(spark, sf)), 7)


@query("subsample_points", sql("pts", """SELECT streamline_id, point_idx FROM (SELECT *, ROW_NUMBER() OVER (ORDER BY streamline_id, point_idx) - 1 AS pos, COUNT(*) OVER () AS n FROM pts)
    WHERE pos % CAST(CEIL(n / 1000e0) AS BIGINT) = 0"""))
def subsample_points(spark, sf):
    return sel.subsample_points(fx.points(spark, sf), 1000).select("streamline_id", "point_idx")


@query("puri_threshold", sql("dps", """SELECT streamline_id, value FROM dps WHERE value >= (SELECT value FROM (SELECT value, ROW_NUMBER() OVER (ORDER BY value) - 1 AS n, COUNT(*) OVER () AS c FROM dps)
    WHERE n = LEAST(FLOOR(c * 0.1e0), c - 1))"""))
def puri_threshold(spark, sf):
    return sel.puri_threshold(fx.dps(spark, sf), 0.1, "value").select("streamline_id", "value")


@query("merge", sql("pts", """
    WITH ord AS (SELECT part, streamline_id, ROW_NUMBER() OVER (ORDER BY part, streamline_id) - 1 AS new_id FROM
      (SELECT DISTINCT 0 AS part, streamline_id FROM pts WHERE streamline_id % 3 < 2 UNION ALL SELECT DISTINCT 1, streamline_id FROM pts WHERE streamline_id % 3 > 0))
    SELECT new_id AS streamline_id, point_idx, x, y, z FROM ord JOIN pts USING (streamline_id)"""))
def merge(spark, sf):
    """Two sets that together hold all streamlines and share a third of them."""
    pts = fx.points(spark, sf)
    left, right = (sets.Tractogram(pts.filter(part)) for part in ("streamline_id % 3 < 2", "streamline_id % 3 > 0"))
    return sets.merge(left, right).points.select("streamline_id", "point_idx", "x", "y", "z")


@query("subset", sql("pts grp dps", """
    WITH ord AS (SELECT streamline_id, ROW_NUMBER() OVER (ORDER BY streamline_id) - 1 AS new_id FROM (SELECT DISTINCT streamline_id FROM pts WHERE streamline_id % 5 = 1))
    SELECT new_id AS streamline_id, group_name, value FROM ord JOIN grp USING (streamline_id) JOIN dps USING (streamline_id)"""))
def subset(spark, sf):
    pts = fx.points(spark, sf)
    chosen = sel.ids(pts.filter(F.col("streamline_id") % 5 == 1))
    out = sets.subset(sets.Tractogram(pts, fx.groups(spark, sf), fx.dps(spark, sf)), chosen)
    return out.groups.join(out.dps, "streamline_id").select("streamline_id", "group_name", "value")


COPIED = """WITH base AS (SELECT streamline_id, point_idx, ROUND(x / 16) * 16 AS x, ROUND(y / 25) * 25 AS y, ROUND(z / 25) * 25 AS z FROM pts)"""


def copies(spark, sf):
    """Streamlines on a coarse lattice, so many coincide."""
    return fx.points(spark, sf).select(
        "streamline_id", "point_idx", *[(geo.round_half_away(F.col(c) / s) * float(s)).alias(c) for c, s in (("x", 16), ("y", 25), ("z", 25))]
    )


@query("remove_duplicates_exact", sql("pts", f"""{COPIED}, sig AS (SELECT streamline_id, STRING_AGG(x || ',' || y || ',' || z, ';' ORDER BY point_idx) AS s FROM base GROUP BY 1)
    SELECT MIN(streamline_id) AS streamline_id FROM sig GROUP BY s"""))
def remove_duplicates_exact(spark, sf):
    from axonframe.operators.pruning import remove_duplicates

    return remove_duplicates(copies(spark, sf), "exact")


@query("remove_duplicates_near", sql("pts", """WITH base AS (SELECT * FROM pts),
    sig AS (SELECT streamline_id, STRING_AGG(x || ',' || y || ',' || z, ';' ORDER BY point_idx) AS s FROM base GROUP BY 1),
    u AS (SELECT MIN(streamline_id) AS streamline_id FROM sig GROUP BY s),
    e AS (SELECT streamline_id, ARG_MIN(x, point_idx) AS fx, ARG_MIN(y, point_idx) AS fy, ARG_MIN(z, point_idx) AS fz, ARG_MAX(x, point_idx) AS lx, ARG_MAX(y, point_idx) AS ly, ARG_MAX(z, point_idx) AS lz
        FROM base JOIN u USING (streamline_id) GROUP BY 1),
    cand AS (SELECT a.streamline_id AS s, b.streamline_id AS o FROM e a JOIN e b ON b.streamline_id < a.streamline_id
        AND ((ABS(a.fx - b.fx) <= 15 AND ABS(a.fy - b.fy) <= 15 AND ABS(a.lx - b.lx) <= 15 AND (a.fx-b.fx)*(a.fx-b.fx) + (a.fy-b.fy)*(a.fy-b.fy) + (a.fz-b.fz)*(a.fz-b.fz) <= 225 AND (a.lx-b.lx)*(a.lx-b.lx) + (a.ly-b.ly)*(a.ly-b.ly) + (a.lz-b.lz)*(a.lz-b.lz) <= 225)
          OR ((a.fx-b.lx)*(a.fx-b.lx) + (a.fy-b.ly)*(a.fy-b.ly) + (a.fz-b.lz)*(a.fz-b.lz) <= 225 AND (a.lx-b.fx)*(a.lx-b.fx) + (a.ly-b.fy)*(a.ly-b.fy) + (a.lz-b.fz)*(a.lz-b.fz) <= 225))),
    m AS (SELECT s, o, p.point_idx AS a, q.point_idx AS b, SQRT((p.x-q.x)*(p.x-q.x) + (p.y-q.y)*(p.y-q.y) + (p.z-q.z)*(p.z-q.z)) AS d
        FROM cand JOIN base p ON p.streamline_id = s JOIN base q ON q.streamline_id = o),
    forth AS (SELECT s, o, AVG(d) AS mean, AVG(CASE WHEN d <= 12 THEN 1e0 ELSE 0e0 END) AS share FROM (SELECT s, o, a, MIN(d) AS d FROM m GROUP BY 1, 2, 3) GROUP BY 1, 2),
    back AS (SELECT s, o, AVG(CASE WHEN d <= 12 THEN 1e0 ELSE 0e0 END) AS share FROM (SELECT s, o, b, MIN(d) AS d FROM m GROUP BY 1, 2, 3) GROUP BY 1, 2),
    near AS (SELECT DISTINCT s FROM forth f JOIN back USING (s, o) WHERE mean <= 12 AND LEAST(f.share, back.share) >= 0.6)
    SELECT streamline_id FROM u WHERE streamline_id NOT IN (SELECT s FROM near)"""))
def remove_duplicates_near(spark, sf):
    from axonframe.operators.pruning import remove_duplicates

    return remove_duplicates(fx.points(spark, sf), "near", tolerance_mm=12.0, endpoint_tolerance_mm=15.0, min_shared_voxel_fraction=0.6)


@query("add_groups_from_parcellation", sql("pvr vox lab", "SELECT DISTINCT streamline_id, 'atlas_' || name AS group_name FROM pvr JOIN vox USING (i, j, k) JOIN lab USING (label) WHERE label <> 0"))
def add_groups_from_parcellation(spark, sf):
    out = sets.add_groups_from_parcellation(
        fx.points(spark, sf), fx.parcels(spark, sf), fx.grid(spark, sf), fx.parcel_labels(spark, sf), "atlas.v2.nii.gz"
    )
    return out.select("streamline_id", "group_name")
