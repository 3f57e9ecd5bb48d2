"""The skew-safe paths give what the plain ones give."""

import numpy as np
import pytest
from pyspark.sql import Window
from pyspark.sql import functions as F

from axonframe.functions import graph, nearest, scan, sphere
from axonframe.functions.geometry import scaling_grid
from axonframe.operators import geometry as og
from axonframe.operators import coloring, fields, orientation, pruning, sampling
from axonframe.operators import selection as sel
from axonframe.operators.fields import visit_density, visits, voxel_density
from axonframe.plans import classify, reference
from axonframe.queries import fixtures as fx
from axonframe.sources import tables
from axonframe.streaming import density


@pytest.fixture(scope="module")
def skewed(spark):
    """One streamline holds most rows."""
    rows = spark.range(3000).select(
        F.when(F.col("id") < 2000, 0).otherwise(F.col("id") % 50 + 1).cast("long").alias("streamline_id"),
        F.when(F.col("id") < 2000, F.col("id")).otherwise(F.floor(F.col("id") / 50) - 40).cast("int").alias("point_idx"),
        *[(F.pmod(F.xxhash64("id", F.lit(n)), F.lit(400)) / 8.0).alias(c) for n, c in enumerate("xyz")],
    )
    return scan.cut_lineage(rows)


def same(a, b):
    assert sorted(map(tuple, a.collect())) == sorted(map(tuple, b.collect()))


@pytest.mark.parametrize("chunk", [2, 7, 4096])
def test_chunked_neighbours_equal_a_window(skewed, chunk):
    keys = ["streamline_id"]
    w = Window.partitionBy(*keys).orderBy("point_idx")
    plain = skewed.select(*keys, "point_idx", F.lag("x").over(w).alias("prev_x"), F.lead("x").over(w).alias("next_x"))
    chunked = scan.with_neighbours(skewed, keys, before=["x"], after=["x"], chunk=chunk)
    same(plain, chunked.select(*plain.columns))


@pytest.mark.parametrize("chunk", [2, 7, 4096])
def test_chunked_running_sum(skewed, chunk):
    keys = ["streamline_id"]
    w = Window.partitionBy(*keys).orderBy("point_idx").rowsBetween(Window.unboundedPreceding, 0)
    whole = F.floor("x").cast("long")
    plain = skewed.select(*keys, "point_idx", F.sum(whole).over(w).alias("s"))
    same(plain, scan.running_sum(skewed, keys, whole, "s", chunk=chunk).select(*plain.columns))


def test_range_partitioned_rank(skewed):
    order = ["x", "y", "z", "point_idx"]
    w = Window.partitionBy("streamline_id").orderBy(*order)
    plain = skewed.select("streamline_id", *order, (F.row_number().over(w) - 1).alias("n"))
    same(plain, scan.row_rank(skewed, order, "n", ["streamline_id"]).select(*plain.columns))
    numbered = scan.number_vertices(skewed.drop("point_idx"), ["streamline_id"], ["x", "y", "z"], largest_group=10**9)
    assert numbered.groupBy("streamline_id").agg((F.max("point_idx") + 1 == F.count("*")).alias("ok")).filter("not ok").count() == 0


@pytest.mark.parametrize("how", ["inner", "left", "left_semi"])
def test_salted_lookup(spark, skewed, how):
    table = spark.range(30).select(F.col("id").alias("streamline_id"), (F.col("id") * 2).alias("v"))
    on = ["streamline_id"]
    plain = skewed.join(table, on, how)
    same(plain, scan.lookup(skewed, table, on, how, salts=5).select(*plain.columns))


def test_order_statistics_are_exact(skewed):
    values = sorted(r["x"] for r in skewed.select("x").collect())
    got = scan.order_statistics(skewed, "x", {"lo": 0.02, "mid": 0.5, "top": 1.0}).first()
    n = len(values)
    assert (got["lo"], got["mid"], got["top"]) == (values[int(n * 0.02)], values[n // 2], values[-1])


@pytest.mark.parametrize("n", [1, 7, 400, 2999, 3000, 9000])
def test_first_n_is_exact(skewed, n):
    rows = skewed.select("streamline_id", "point_idx", "x")
    for by in ([], ["streamline_id"]):
        order = ["x", "point_idx", "streamline_id"]
        w = Window.partitionBy(*by).orderBy(*order)
        plain = rows.withColumn("_n", F.row_number().over(w)).filter(F.col("_n") <= n).drop("_n")
        same(plain, scan.first_n(rows, order, n, by).select(*plain.columns))


def test_one_creeping_run_is_streamed(spark):
    """A single endless run of tiny steps: kept vertices are those of a plain loop."""
    step = 3e-5
    rows = spark.range(20_000).select(F.lit(4).cast("long").alias("streamline_id"), F.col("id").cast("int").alias("point_idx"), (F.col("id") * step).alias("x"), F.lit(0.0).alias("y"), F.lit(0.0).alias("z"))
    kept, last = [], None
    for n in range(20_000):
        if last is None or abs(n * step - last) ** 2 >= og.SAME_POINT_MM**2:
            kept.append(n)
            last = n * step
    assert sorted(r["point_idx"] for r in og.dedup_consecutive(rows).collect()) == kept


def brute(points, targets):
    d = ((points[:, None, :] - targets[None, :, :]) ** 2).sum(axis=2)
    return np.sqrt(d.min(axis=1))


def test_distance_to_cloud_equals_brute_force(skewed):
    cloud = skewed.filter("point_idx % 7 = 0")
    p = skewed.select("streamline_id", "point_idx", "x", "y", "z").orderBy("streamline_id", "point_idx").toPandas()
    want = brute(p[["x", "y", "z"]].to_numpy(), cloud.select("x", "y", "z").toPandas().to_numpy())
    got = nearest.distance_to_cloud(skewed.select(*p.columns), cloud).orderBy("streamline_id", "point_idx").toPandas()
    assert list(got.columns) == [*p.columns, "distance"] and np.allclose(got["distance"], want, atol=1e-12)


def test_nearest_of_two_subjects_with_a_dense_spot(spark, monkeypatch):
    """Half of the targets lie in one spot finer than the order's steps; each subject has its own targets."""
    monkeypatch.setattr(nearest, "BLOCK", 16)
    monkeypatch.setattr(nearest, "LEAF", 4)
    monkeypatch.setattr(nearest, "FAN", 3)
    rng = np.random.default_rng(8)
    dense = 20 + rng.random((300, 3)) * 0.01
    places = np.concatenate([rng.integers(0, 40, (300, 3)) / 1.0, dense, [[1e9, -1e9, 0]]])
    targets = [("ab"[n % 2], n // 2 * 10 % 997, *map(float, t)) for n, t in enumerate(places)]
    queries = [("abc"[n % 3], n, *map(float, q)) for n, q in enumerate(np.concatenate([rng.integers(0, 40, (400, 3)) / 1.0, 20 + rng.random((200, 3)) * 0.02]))]
    odd = [("a", 9001, None, 1.0, 1.0), ("b", 9002, float("nan"), 1.0, 1.0), (None, 9003, 1.0, 1.0, 1.0)]
    schema = "subject_id string, {} long, x double, y double, z double"
    points = spark.createDataFrame(queries + odd, schema.format("point_idx")).repartition(5)
    found = nearest.nearest(points, spark.createDataFrame(targets, schema.format("vertex_id")).repartition(3), "vertex_id", ["subject_id"])
    got = {r["point_idx"]: (r["nearest"], r["d2"]) for r in found.collect()}
    assert len(got) == len(queries) + len(odd) == found.count()
    for subject, n, *q in queries:
        own = [(sum((a - b) ** 2 for a, b in zip(q, t)), v) for s, v, *t in targets if s == subject]
        d2, label = min(own, default=(None, None))
        assert got[n][0] == label and (d2 is None or got[n][1] == pytest.approx(d2, abs=1e-12))
    assert {got[n] for n in (9001, 9002, 9003)} == {(None, None)}
    near = nearest.nearest_in_radius(points, spark.createDataFrame(targets, schema.format("vertex_id")), "vertex_id", 3.0)
    assert {(r["point_idx"], r["nearest"]) for r in near.collect()} == {(n, v) for n, (v, d2) in got.items() if d2 is not None and d2 <= 9.0}
    assert nearest.nearest(points, spark.createDataFrame([], schema.format("vertex_id")), "vertex_id").filter("nearest is not null").isEmpty()


@pytest.mark.parametrize("chunk", [60, 1 << 20])
def test_components_of_a_star_and_a_chain(spark, monkeypatch, chunk):
    """In one task, and in rounds of many."""
    monkeypatch.setattr(graph, "CHUNK", chunk)
    rounds = []
    plain = graph._forests
    monkeypatch.setattr(graph, "_forests", lambda links: rounds.append(1) or plain(links))
    star = [(5000, k) for k in range(5001, 5700)]
    chain = [(k * 37 % 499, (k + 1) * 37 % 499) for k in range(498)]
    edges = spark.createDataFrame([*star, *chain, (9000, 9000), (-1, -2)], "u long, v long").repartition(9)
    got = dict(graph.connect(edges).collect())
    want = {k: 0 for k in range(499)} | {k: 5000 for k in range(5000, 5700)} | {9000: 9000, -1: -2, -2: -2}
    assert got == want and len(rounds) < 9


def test_subject_is_part_of_the_key(lines):
    pts = lines([[(0, 0, 0), (3, 4, 0)], [(1, 1, 1), (1, 1, 2)]])
    both = pts.withColumn("subject_id", F.lit("a")).unionByName(pts.withColumns({"subject_id": F.lit("b"), "x": F.col("x") * 2}))
    out = {(r["subject_id"], r["streamline_id"]): r["length_mm"] for r in og.streamline_length(both).collect()}
    assert out[("a", 0)] == 5 and out[("b", 0)] == pytest.approx(52**0.5) and len(out) == 4
    assert voxel_density(both, 1.0).select("subject_id").distinct().count() == 2


def test_partition_count_does_not_matter(spark, skewed):
    one = sel.stride_sample(sel.ids(skewed), 7)
    old = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", "13")
    try:
        same(one, sel.stride_sample(sel.ids(skewed.repartition(11)), 7))
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", old)


def test_stream_equals_batch(spark, sf, tmp_path):
    batch = fx.points(spark, sf).repartition(5)
    batch.write.parquet(str(tmp_path / "in"))
    grid = fx.grid(spark, sf)
    arriving = spark.readStream.schema(batch.schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
    running = density.start_density(density.stream_voxel_density(arriving, grid), str(tmp_path / "out"), "d", str(tmp_path / "state"))
    running.awaitTermination()
    same(density.latest_batch(spark, str(tmp_path / "out")).select("i", "j", "k", "density"), density.stream_voxel_density(batch, grid))


def test_update_mode_replays_and_compacts(spark, sf, tmp_path):
    batch = fx.points(spark, sf).withColumn("run_id", F.when(F.col("streamline_id") % 4 == 0, "old").otherwise("new")).repartition(6)
    batch.write.parquet(str(tmp_path / "in"))
    grid, sink, state = fx.grid(spark, sf), str(tmp_path / "out"), str(tmp_path / "state")
    want = density.stream_voxel_density(batch, grid, "new")

    def run():
        arriving = spark.readStream.schema(batch.schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
        density.start_density(density.stream_voxel_density(arriving, grid, "new"), sink, "d", state, "update").awaitTermination()

    def now():
        return density.current_counts(spark, sink).select("i", "j", "k", "density")

    run()
    sizes = [r["count"] for r in spark.read.parquet(sink).groupBy("batch").count().collect()]
    assert len(sizes) == 6 and max(sizes) <= want.count()
    same(now(), want)
    # A batch written twice counts once, before and after compaction.
    spark.read.parquet(sink).filter("batch = 5").drop("batch").write.mode("overwrite").parquet(str(tmp_path / "again"))
    spark.read.parquet(str(tmp_path / "again")).write.mode("overwrite").parquet(f"{sink}/batch=5")
    same(now(), want)
    density.compact(spark, sink)
    density.compact(spark, sink)
    same(now(), want)
    assert spark.read.parquet(sink).count() == want.count()
    # The stream goes on after compaction.
    batch.limit(200).write.mode("append").parquet(str(tmp_path / "in"))
    run()
    same(now(), density.stream_voxel_density(spark.read.parquet(str(tmp_path / "in")), grid, "new"))


def test_filters_and_columns_reach_the_scan(spark, sf, tmp_path):
    fx.points(spark, sf).write.parquet(str(tmp_path / "p"))
    pts = spark.read.parquet(str(tmp_path / "p"))
    plan = sel.sphere_query(pts, (25.0, 25.0, 25.0), 5.0)._jdf.queryExecution().executedPlan().toString()
    assert "GreaterThanOrEqual(x,20.0)" in plan and "dpv" not in plan.split("ReadSchema")[1]


def test_no_local_checkpoints_or_local_collects():
    import pathlib

    root = pathlib.Path(__file__).resolve().parent.parent / "axonframe"
    text = "".join(p.read_text() for p in root.rglob("*.py"))
    assert "localCheckpoint" not in text and "crossJoin" not in text


def test_masked_sampling_shares_a_brick(spark, monkeypatch):
    """Many points of a brick cross with one copy of it; corners beyond the grid, without a voxel or under the gate do not count."""
    counted = []
    plain = sampling.lookup
    monkeypatch.setattr(sampling, "lookup", lambda rows, *more, **how: counted.append(rows.count()) or plain(rows, *more, **how))
    voxels = {(i, j, k): [float(i), 10.0 * j + k, 1.0] for i in range(6) for j in range(2) for k in range(2) if (i, j, k) != (1, 1, 1)}
    table = spark.createDataFrame([(*v, 0.0 if v[0] == 5 else 1.0, c) for v, c in voxels.items()], "i int, j int, k int, fa double, coeffs array<double>")
    rng = np.random.default_rng(3)
    at = [(0, n, *map(float, p)) for n, p in enumerate(rng.uniform(-1.0, 6.0, (600, 3)) * [1, 0.3, 0.3])] + [(0, 600, 5.0, 0.0, 0.0)]
    pts = spark.createDataFrame(at, "streamline_id long, point_idx int, x double, y double, z double").coalesce(1)
    found = {r["point_idx"]: r["coeffs"] for r in sampling.sample_masked_trilinear(pts, table, scaling_grid(6, 2, 2, 1.0), "fa", 0.5).collect()}
    expected = {}
    for _, n, *p in at:
        base = [int(np.floor(v)) for v in p]
        taps = []
        for d in np.ndindex(2, 2, 2):
            cell = tuple(b + e for b, e in zip(base, d))
            w = float(np.prod([(v - b) if e else 1 - (v - b) for v, b, e in zip(p, base, d)]))
            if cell in voxels and cell[0] != 5 and w > 0:
                taps.append((w, np.array(voxels[cell])))
        mass = sum(w for w, _ in taps)
        if mass >= 0.01:
            expected[n] = sum(w * c for w, c in taps) / mass
    assert set(found) == set(expected) and 100 < len(found) < 600
    assert all(np.allclose(found[n], c, atol=1e-12) for n, c in expected.items())
    assert counted and max(counted) <= 20


def test_visit_density_groups_by_voxel_alone(spark, skewed):
    """Rows grow with the voxels, not with streamlines times voxels: no aggregate holds a streamline."""
    found = visit_density(skewed, 2.0)
    plan = found._jdf.queryExecution().optimizedPlan().toString()
    assert not [line for line in plan.splitlines() if "Aggregate [" in line and "streamline_id" in line]
    same(found, visits(skewed, 2.0).groupBy("i", "j", "k").agg(F.sum("visits")))


def test_pruning_walks_packed_pieces(spark, skewed, monkeypatch):
    """Pieces of a long streamline are walked as one, in the voxels of ``visits``, which are not written."""
    found = {}
    for chunk in (4096, 7):
        monkeypatch.setattr(pruning, "CHUNK", chunk)
        corner = skewed.agg(*[F.min(c).alias(f"_min_{c}") for c in "xyz"])
        placed = pruning._packed(skewed).crossJoin(corner)
        walked = pruning._walked(placed, 2.0, ["streamline_id"], False).groupBy("streamline_id", "i", "j", "k").agg(F.count("*"))
        same(walked, visits(skewed, 2.0))
        same(pruning._walked(placed, 2.0, ["streamline_id"], True).select("streamline_id", "i", "j", "k").distinct(), visits(skewed, 2.0).select("streamline_id", "i", "j", "k"))
        found[chunk] = sorted(r[0] for r in pruning.tip_prune(skewed, None, 2.0, 3, 2, 0.3).collect())
    assert found[7] == found[4096] and len(found[7]) < 51


def test_pruning_writes_no_visits(skewed, monkeypatch):
    """What is written are pieces, streamlines and thin voxels, not what each streamline visits."""
    written = []
    plain = pruning.cut_lineage
    monkeypatch.setattr(pruning, "cut_lineage", lambda df: written.append(set(df.columns)) or plain(df))
    pruning.tip_prune(skewed, None, 2.0, 3, 2, 0.3)
    assert written and not any({"streamline_id", "i"} <= columns for columns in written)


def test_points_at_one_place_are_searched_for_once(spark, monkeypatch):
    searched = []
    plain = nearest.runs
    monkeypatch.setattr(nearest, "runs", lambda rows, by, payload, size: (payload == "row" and searched.append(rows.count())) or plain(rows, by, payload, size))
    at = [(n % 2, n, float(n % 3), -0.0 if n % 4 else 0.0, None if n == 999 else 1.0) for n in range(1000)]
    points = spark.createDataFrame(at, "subject_id int, point_idx int, x double, y double, z double")
    targets = spark.createDataFrame([(0, 7, 1.0, 0.0, 1.0), (0, 8, 9.0, 0.0, 1.0)], "subject_id int, vertex_id long, x double, y double, z double")
    found = {r["point_idx"]: (r["nearest"], r["d2"]) for r in nearest.nearest(points, targets, "vertex_id", ["subject_id"]).collect()}
    assert searched == [6]
    assert found == {n: (None, None) if s or z is None else (7, (x - 1.0) ** 2) for s, n, x, _, z in at}


def joins(df):
    """The join operators of the plan before AQE looks at any size."""
    return [line for line in df._jdf.queryExecution().sparkPlan().toString().splitlines() if "Join" in line]


def test_settled_tables_are_broadcast_by_their_true_size(spark):
    rows = spark.range(1000).select("id", F.pmod("id", F.lit(9)).alias("k"))
    guessed = rows.join(rows.select("k", F.lit("a").alias("a")).distinct(), "k").groupBy("k").agg(F.collect_set("a").alias("a"))
    limit = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    try:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "2000")
        table, small = scan.settled(guessed)
        assert small and not scan.settled(rows)[1]
        assert all("BroadcastHashJoin" in j for j in joins(scan.lookup(rows, table, ["k"], small=small)))
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", limit)


def test_contacts_are_bits_of_words(spark):
    """Plans of more masks than a word has bits; vertices outside the grid; masks nobody touches."""
    line = [(0, p, p * 1.0 + 0.5, 0.5, 0.5) for p in range(70)] + [(1, 0, 0.5, 0.5, 0.5), (1, 1, -3.0, 0.5, 0.5), (2, 0, 69.5, 0.5, 0.5)]
    pts = spark.createDataFrame(line, "streamline_id long, point_idx int, x double, y double, z double")
    masks = spark.createDataFrame([(f"m{n:03}", n, 0, 0) for n in range(80)], "mask_id string, i int, j int, k int")
    role = [("a", "roi", f"m{n:03}") for n in range(70)] + [("b", "end", "m000"), ("b", "end", "m069"), ("c", "no_end", "m069"), ("c", "roa", "m075"), ("d", "roi", "m075")]
    plan = spark.createDataFrame(role, "bundle_id string, role string, mask_id string")
    found = classify._contacts(pts, plan, masks, scaling_grid(100, 10, 10, 1.0))
    rows = {(r["streamline_id"], r["bundle_id"]): (r["_roa"], r["_roi"], r["_no_end"], r["_end"]) for r in found.collect()}
    assert rows == {
        (0, "a"): (False, 70, False, 0), (0, "b"): (False, 0, False, 2), (0, "c"): (False, 0, True, 0),
        (1, "a"): (False, 1, False, 0), (1, "b"): (False, 0, False, 1), (2, "a"): (False, 1, False, 0), (2, "b"): (False, 0, False, 0), (2, "c"): (False, 0, False, 0),
    }
    tall = found._jdf.queryExecution().optimizedPlan().toString()
    assert "bit_or" in tall


def test_points_beside_the_summary_take_its_neighbours(spark):
    """A voxel without a vector brings its neighbours' in its own row."""
    pts = spark.createDataFrame([(0, 0, 0.0, 0.0, 0.0), (0, 1, 8.0, 8.0, 8.0)], "streamline_id long, point_idx int, x double, y double, z double")
    zeros = [0.0] * 6
    summary = spark.createDataFrame([(1, 1, 1, 1.0, 0.0, 0.0, *zeros), (3, 1, 1, 0.0, 1.0, 0.0, *zeros)], "i int, j int, k int, vx double, vy double, vz double, xx double, xy double, xz double, yy double, yz double, zz double")
    at = spark.createDataFrame([(0, 2.0, 2.0, 2.0), (1, 6.0, 2.0, 2.0), (2, 6.0, 6.0, 7.0), (3, 99.0, 2.0, 2.0)], "n int, x double, y double, z double")
    out = fields.direction_sample(at, summary, pts, 4.0)
    assert "_cells" not in out._jdf.queryExecution().optimizedPlan().toString()
    found = {r["n"]: (round(r["vx"], 6), round(r["vy"], 6)) for r in out.collect()}
    assert found == {0: (1.0, 0.0), 1: (0.5, 0.5), 2: (0.5, 0.5), 3: (0.0, 0.0)}


def test_a_subjects_range_is_broadcast(spark, skewed):
    """Rows of a subject are not gathered to meet the one row of their range."""
    rows = skewed.withColumn("subject_id", F.pmod("streamline_id", F.lit(2)))
    found = coloring.color_by_scalar(rows, "x")
    assert joins(found) and "SortMergeJoin" not in "".join(joins(found))


def test_a_reference_is_walked_once(spark, skewed, monkeypatch):
    written = []
    plain = reference.cut_lineage
    monkeypatch.setattr(reference, "cut_lineage", lambda df: written.append(set(df.columns)) or plain(df))
    odx = spark.createDataFrame([(0, 1, 1, 1)], "voxel_id long, i int, j int, k int")
    peaks = spark.createDataFrame([(0, 0, 1.0)], "voxel_id long, fixel_idx int, amplitude double")
    reference.prepare_reference_plan(skewed, peaks, odx, scaling_grid(10, 10, 10, 5.0), "amplitude", 0.3)
    assert {"subject_id", "i", "j", "k"} in written


def test_dedup_writes_its_scan_once(spark, monkeypatch):
    """The scans and the joins after them share no task, and only what the joins need is written."""
    written = []
    plain = og.cut_lineage
    monkeypatch.setattr(og, "cut_lineage", lambda df: written.append(df.columns) or plain(df))
    at = [(0, p, p * 3e-5, 0.0, 0.0, "x") for p in range(9)]
    pts = spark.createDataFrame(at, "streamline_id long, point_idx int, x double, y double, z double, more string")
    assert sorted(r["point_idx"] for r in og.dedup_consecutive(pts).collect()) == [0, 4, 8]
    assert written == [["streamline_id", "_run", "point_idx", "x", "y", "z", "_restart"]]


def test_best_fixel_makes_no_rows_of_pairs(spark):
    """A direction meets its voxel's fixels in its own row: nothing is grouped or sorted per direction."""
    rng = np.random.default_rng(4)
    unit = lambda n: (lambda v: v / np.linalg.norm(v, axis=1, keepdims=True))(rng.normal(size=(n, 3)))
    peaks, ways = unit(60), unit(400)
    peaks[7], peaks[8] = -peaks[5], [0, 0, 0]
    ways[0] = peaks[5]
    fixels = spark.createDataFrame(
        [(n % 3, n, *map(float, 2 * p), float(n)) for n, p in enumerate(peaks)], "voxel_id long, fixel_idx int, dx double, dy double, dz double, amplitude double"
    )
    rows = [(n, 2 if n == 0 else n % 4, *map(float, w)) for n, w in enumerate(ways)]
    dirs = spark.createDataFrame(rows, "line long, voxel_id long, dx double, dy double, dz double")
    out = orientation.best_fixel(dirs, fixels, 0.8, ["line"])
    plan = out._jdf.queryExecution().optimizedPlan().toString()
    assert not [x for x in plan.splitlines() if "Aggregate [" in x and "line#" in x]
    want = {}
    for line, voxel, *w in rows:
        dots = {n: float(p @ w) for n, p in enumerate(peaks) if n % 3 == voxel and n != 8}
        near = [(round(abs(d), 12), -n) for n, d in dots.items() if abs(d) >= 0.8]
        if near:
            n = -max(near)[1]
            want[line] = (n, *np.round(peaks[n] * (1 if dots[n] >= 0 else -1), 9))
    got = {r["line"]: (r["fixel_idx"], round(r["x"], 9), round(r["y"], 9), round(r["z"], 9)) for r in out.collect()}
    assert got == want and got[0][0] == 5 and len(got) < len(rows)


@pytest.mark.parametrize("detail", [0, 1, 3])
def test_bins_are_found_among_those_of_a_cell(detail):
    """A few products a direction, and yet the first largest of all: ties, cell edges and odd rows too."""
    rng = np.random.default_rng(6)
    d, faces = sphere.icosphere(detail)
    cells = sphere.cell_bins(detail)
    assert cells.shape[1] <= 4
    odd = [[0, 0, 0], [np.nan, 1, 0], [1e-200, 0, 1e-201], [1e300, -1e300, 1e200], [-0.0, 1, 0], [5e-324, 0, 0]]
    ways = np.concatenate([
        rng.normal(size=(5000, 3)), d, d[faces].mean(1), (d[faces[:, 0]] + d[faces[:, 1]]) / 2,
        rng.integers(-4, 5, (5000, 3)), rng.integers(-48, 49, (5000, 3)) / 48, odd,
    ])
    dots = ways[:, :1] * d[:, 0] + ways[:, 1:2] * d[:, 1] + ways[:, 2:] * d[:, 2]
    assert (sphere.pick_bins(ways, d, cells) == dots.argmax(1)).all()
    assert (sphere.pick_bins(-ways, d, cells) == dots.argmin(1)).all()


def test_field_and_scores_from_segments_binned_once(spark, sf):
    pts = scan.cut_lineage(fx.points(spark, sf).filter("streamline_id % 9 = 0"))
    binned = scan.cut_lineage(fields.binned_segments(pts, 4.0, 1))
    plain = fields.direction_field(pts, 4.0, detail=1)
    once = fields.direction_field(pts, 4.0, detail=1, binned=binned)
    assert "Window" not in once._jdf.queryExecution().optimizedPlan().toString()
    rows = lambda df: sorted(tuple(round(v, 9) if isinstance(v, float) else v for v in r) for r in df.collect())
    assert rows(once) == rows(plain)
    scores = pruning.purifibre_score(pts, once, 4.0, detail=1, binned=binned)
    assert "Window" not in scores._jdf.queryExecution().optimizedPlan().toString()
    fico = [(r["streamline_id"], str(round(r["fico"], 9))) for r in pruning.purifibre_score(pts, plain, 4.0, detail=1).collect()]
    assert sorted(fico) == sorted((r["streamline_id"], str(round(r["fico"], 9))) for r in scores.collect())


def test_label_lines_are_split_once(spark):
    """However many parts of a line are looked at, its two splits are made once."""
    rows = [(n, t) for n, t in enumerate(["1, A", "2 B c 1 2 3", "2 Late 9 8 7", "x no", "# 3 D", "4,E,1,2,3,255", "5"])]
    out = tables.parse_label_lines(spark.createDataFrame(rows, "line_no int, value string").repartition(2))
    assert out._jdf.queryExecution().optimizedPlan().toString().count("split(") == 2
    assert sorted((r["label"], r["name"]) for r in out.collect()) == [(1, "A"), (2, "Late"), (4, "E")]
