"""The flagship query: which parcels do streamlines reach, and how long are they."""

from __future__ import annotations

from pyspark.sql import functions as F

from axonframe.operators import geometry as og
from axonframe.operators import selection as sel
from axonframe.functions.scan import lookup
from axonframe.queries import fixtures as fx
from axonframe.queries.fixtures import R, query, r, sql


@query("mean_length_by_label", sql("pvr vox lab len", f"""WITH t AS (SELECT DISTINCT streamline_id, label FROM pvr JOIN vox USING (i, j, k) WHERE label <> 0)
    SELECT label, name AS label_name, CAST(COUNT(*) AS BIGINT) AS n_streamlines, {R('AVG(COALESCE(length_mm, 0))', 4)} AS mean_length_mm FROM t LEFT JOIN len USING (streamline_id) JOIN lab USING (label) GROUP BY 1, 2"""))
def mean_length_by_label(spark, sf):
    """Streamlines per label with their mean arc length: voxel lookup, length, label join."""
    pts, parcels = fx.points(spark, sf), fx.parcels(spark, sf).filter("label <> 0")
    touched = lookup(sel.touched_voxels(pts, fx.grid(spark, sf), "round"), parcels, ["i", "j", "k"], spread=True)
    pairs = touched.select("streamline_id", "label").distinct()
    lengths = lookup(pairs, og.streamline_length(pts), ["streamline_id"], "left")
    means = lengths.groupBy("label").agg(
        F.count("*").alias("n_streamlines"), r(F.avg(F.coalesce("length_mm", F.lit(0.0))), 4).alias("mean_length_mm")
    )
    return means.join(fx.parcel_labels(spark, sf).withColumnRenamed("name", "label_name"), "label")
