"""Hand cases: exact small inputs with known answers, and invariants."""

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from axonframe.functions import color
from axonframe.functions.geometry import Grid, nearest_slice_index, scaling_grid, slice_world_position
from axonframe.functions.sphere import icosphere, nearest_bin, neighbour_pairs
from axonframe.operators import cifti, coloring, fields, orientation, pruning, sets, shapes, surfaces, volumes
from axonframe.operators import geometry as og
from axonframe.operators import selection as sel
from axonframe.plans import rules
from axonframe.sources import catalog, tables


def ids(df):
    return sorted(r["streamline_id"] for r in df.select("streamline_id").collect())


def run(n, axis=0, start=(0.0, 0.0, 0.0)):
    return [tuple(s + (k if a == axis else 0) for a, s in enumerate(start)) for k in range(n)]


# --- pruning ------------------------------------------------------------------------


def test_single_line_is_pruned(lines):
    assert ids(pruning.tip_prune(lines([run(20)]))) == []


def test_three_equal_lines_stay(lines):
    assert ids(pruning.tip_prune(lines([run(20)] * 3))) == [0, 1, 2]


def test_outlier_goes(lines):
    pts = lines([run(30)] * 6 + [run(30, axis=1, start=(5.0, 0.0, 0.0))])
    assert ids(pruning.tip_prune(pts)) == list(range(6))


def test_full_tolerance_keeps_everything(lines):
    pts = lines([run(10, start=(0.0, 10.0 * n, 0.0)) for n in range(5)])
    assert ids(pruning.tip_prune(pts, max_unsupported=1.0)) == list(range(5))


def test_lone_vertices_are_dropped_by_pruning(lines):
    assert ids(pruning.tip_prune(lines([[(0, 0, 0)], run(5), run(5)]))) == [1, 2]


def test_exact_copies_keep_the_lowest_id(lines):
    pts = lines([run(4), run(5), run(4), run(4)[::-1], run(4)])
    assert ids(pruning.remove_duplicates(pts)) == [0, 1, 3]


def test_near_copies_across_any_border(lines):
    """A pair 0.2 mm apart is found wherever cells begin; the middle of a line counts as well as its ends."""
    shifts = [0.0, 3.9, 7.95, 11.9, 15.95, 23.95]
    pairs = [[(x, y + 50 * n, z + shift + d) for x, y, z in run(8)] for n, shift in enumerate(shifts) for d in (0.0, 0.2)]
    bent = [(x, y + (3.0 if 2 < x < 5 else 0.0), z) for x, y, z in run(8)]
    both = lines([*pairs, bent])
    assert ids(pruning.remove_duplicates(both, "near", 1.0, 2.0, 0.9)) == [0, 2, 4, 6, 8, 10, 12]
    assert ids(pruning.remove_duplicates(both, "near", 1.0, 2.0, 0.7)) == [0, 2, 4, 6, 8, 10]


def test_a_crowd_of_near_copies_makes_few_pairs(lines, monkeypatch):
    monkeypatch.setattr(pruning, "LEADERS", 4)
    pairs = []
    plain = pruning.near_pairs
    monkeypatch.setattr(pruning, "near_pairs", lambda pts, p, *more: pairs.append(p.count()) or plain(pts, p, *more))
    crowd = [[(x, y + n * 1e-4, z) for x, y, z in run(4)] for n in range(300)]
    assert ids(pruning.remove_duplicates(lines([*crowd, run(4, axis=1)]), "near", 1.0, 2.0, 0.9)) == [0, 300]
    assert sum(pairs) < 5 * 300


def test_near_copies_of_short_and_long_lines(lines, monkeypatch):
    """Short ones are told in blocks and make no pairs; whatever the block and piece sizes, the result is that of plain distances."""
    rng = np.random.default_rng(5)
    shapes = [rng.uniform(0, 4, (int(rng.integers(1, 7)), 3)) for _ in range(40)]
    every = [s + rng.normal(0, 0.6, s.shape) for s in shapes for _ in range(4)]
    every = [every[i][::-1] if i % 3 == 0 else every[i] for i in rng.permutation(len(every))]

    def near(p, q):
        ends = [min(max(np.linalg.norm(p[0] - a), np.linalg.norm(p[-1] - b)) for a, b in ((q[0], q[-1]), (q[-1], q[0])))]
        d = np.linalg.norm(p[:, None] - q[None], axis=2)
        return ends[0] <= 2.0 and d.min(1).mean() <= 1.0 and min((d.min(1) <= 1.0).mean(), (d.min(0) <= 1.0).mean()) >= 0.6

    left = [i for i, p in enumerate(every) if not any(near(p, q) for q in every[:i])]
    assert 20 < len(left) < 140
    pairs = []
    plain = pruning.near_pairs
    monkeypatch.setattr(pruning, "near_pairs", lambda pts, p, *more: pairs.append(p.count()) or plain(pts, p, *more))
    pts = lines(every)
    assert ids(pruning.remove_duplicates(pts, "near", 1.0, 2.0, 0.6)) == left
    assert not pairs
    for name, value in (("SHORT", 7), ("STEP", 3), ("LEADERS", 5), ("PIECE", 3)):
        monkeypatch.setattr(pruning, name, value)
    assert ids(pruning.remove_duplicates(pts, "near", 1.0, 2.0, 0.6)) == left
    assert pairs


def test_only_possible_copies_are_measured(monkeypatch):
    """A crowd with like ends and other middles is told apart by cells; whatever their size, the result is that of plain distances."""
    rng = np.random.default_rng(8)
    every = []
    for _ in range(300):
        middle = rng.uniform(0, 400, (int(rng.integers(1, 7)), 3))
        every.append(np.vstack([rng.uniform(0, 3, 3), middle, rng.uniform(0, 3, 3) + [400, 0, 0]])[:: rng.choice([-1, 1])])
    for i in range(40):
        every.append(every[i] + rng.normal(0, 1.5, every[i].shape))
    every[7] = np.where([[False], [True], [False]], np.nan, every[7][[0, 1, -1]])
    order = rng.permutation(len(every))
    first, second = order[:200], np.sort(order)

    def near(p, q):
        ends = [min(max(np.linalg.norm(p[0] - a), np.linalg.norm(p[-1] - b)) for a, b in ((q[0], q[-1]), (q[-1], q[0])))]
        d = np.linalg.norm(p[:, None] - q[None], axis=2)
        return ends[0] <= 5.0 and d.min(1).mean() <= 4.0 and min((d.min(1) <= 4.0).mean(), (d.min(0) <= 4.0).mean()) >= 0.7

    want = {int(i) for i in first if any(near(every[i], every[j]) for j in range(i))}
    assert 5 < len(want) < 100
    block = [[[{"streamline_id": int(i), **dict(zip("xyz", every[i].T.tolist()))} for i in side]] for side in (first, second)]
    batch = pa.RecordBatch.from_arrays([pa.array(side) for side in block], ["a", "b"])
    plain, measured = np.sqrt, []
    for cells in (512, 8):
        monkeypatch.setattr(pruning, "CELLS", cells, raising=False)
        with monkeypatch.context() as counted:
            counted.setattr(pruning.np, "sqrt", lambda v, *more: measured.append(np.size(v)) or plain(v, *more))
            got = [b for out in pruning._block_copies([], 4.0, 5.0, 0.7)(iter([batch])) for b in out["streamline_id"].to_pylist()]
        assert sorted(got) == sorted(want)
    # All pairs have some 20 distances each, 34,000 of them fit by their ends and ids.
    assert sum(measured) < 100_000


def test_short_copies_are_told_by_their_shape(spark, lines, monkeypatch):
    """Only long ones take signatures and joins of vertices; a missing coordinate equals nothing."""
    monkeypatch.setattr(pruning, "PIECE", 6)
    searched = []
    plain = pruning.exact_copies
    monkeypatch.setattr(pruning, "exact_copies", lambda pts: searched.append(ids(pts)) or plain(pts))
    short = [run(4), run(5), run(4), run(4)[::-1], [(-0.0, *p[1:]) if p[0] == 0 else p for p in run(5)]]
    assert ids(pruning.remove_duplicates(lines(short))) == [0, 1, 3]
    assert not searched
    pts = lines([*short, run(7), run(7), run(8)])
    gaps = spark.createDataFrame([(n, p, float(p), None if p else 1.0, 0.0) for n in (8, 9) for p in range(2)], pts.schema)
    assert ids(pruning.remove_duplicates(pts.union(gaps))) == [0, 1, 3, 5, 7, 8, 9]
    assert [sorted(set(s)) for s in searched] == [[5, 6, 7]]


def test_near_copies_in_either_direction(lines):
    shifted = [(x, y + 0.1, z) for x, y, z in run(10)]
    pts = lines([run(10), shifted[::-1], run(10, axis=1)])
    assert ids(pruning.remove_duplicates(pts, "near", 1.0, 1.0, 0.5)) == [0, 2]


# --- selections ---------------------------------------------------------------------


def test_group_selection(spark, lines):
    groups = spark.createDataFrame([(0, "GroupA"), (1, "GroupA"), (2, "GroupB"), (3, "GroupB")], "streamline_id long, group_name string")
    everything = sel.ids(groups)
    assert ids(sel.group_select(everything, groups, ["GroupA"])) == [0, 1]
    assert ids(sel.group_select(everything, groups, None)) == [0, 1, 2, 3]
    assert ids(sel.group_select(everything, groups, [])) == []
    assert ids(sel.group_select(everything, groups, ["GroupA"], override=["GroupB"])) == [2, 3]
    with pytest.raises(ValueError):
        sel.group_select(everything, groups.limit(0), ["GroupA"])


def test_csv_group_filter():
    assert sel.group_filter_from_csv("a, b") == ["a", "b"]
    assert sel.group_filter_from_csv("__none__") == []
    assert sel.group_filter_from_csv("  ") is None


def test_limits_and_subsets(lines):
    pts = lines([[(i, 0, 0), (i + 1, 0, 0)] for i in range(12)])
    everything = sel.ids(pts)
    assert ids(sel.limit_streamlines(everything, 5)) == list(range(5))
    assert ids(sel.limit_streamlines(everything, 0)) == []
    first, again = ids(sel.random_subset(everything, 5, 42)), ids(sel.random_subset(everything, 5, 42))
    assert first == again and len(first) == 5
    assert ids(sel.random_subset(everything.repartition(7), 5, 42)) == first


def test_sphere_border_counts(lines):
    pts = lines([[(0, 0, 0)], [(3, 4, 0)], [(3, 4, 0.1)]])
    assert ids(sel.sphere_query(pts, (0, 0, 0), 5.0)) == [0, 1]


def test_parcel_rules_complement(spark, lines):
    grid = scaling_grid(10, 1, 1, 1.0)
    parcels = spark.createDataFrame([(i, 0, 0, i // 3) for i in range(10)], "i int, j int, k int, label int")
    pts = lines([run(10), run(2), run(3, start=(4.0, 0, 0)), [(50, 0, 0)]])
    hit, miss = ids(sel.parcel_roi(pts, parcels, grid, [1])), ids(sel.parcel_roa(pts, parcels, grid, [1]))
    assert hit == [0, 2] and sorted(hit + miss) == [0, 1, 2, 3]
    assert ids(sel.parcel_roi(pts, parcels, grid, [])) == []
    assert ids(sel.parcel_roa(pts, parcels, grid, [])) == [0, 1, 2, 3]
    assert ids(sel.parcel_end(pts, parcels, grid, [1], 0)) == []
    assert ids(sel.parcel_end(pts, parcels, grid, [1], 1)) == [2]
    assert ids(sel.parcel_end(pts, parcels, grid, [1, 2], 2)) == [2]


def test_crop_adds_midpoints(spark, lines):
    grid = scaling_grid(10, 1, 1, 1.0)
    parcels = spark.createDataFrame([(i, 0, 0, 1) for i in (3, 4, 7)], "i int, j int, k int, label int")
    out = sel.parcel_crop(lines([run(10)]), parcels, grid, [1]).orderBy("run", "point_idx").collect()
    assert [(r["point_idx"], r["x"]) for r in out] == [(0, 2.5), (1, 3.0), (2, 4.0), (3, 4.5), (0, 6.5), (1, 7.0), (2, 7.5)]
    outside = sel.parcel_crop(lines([run(10)]), parcels, grid, [1], keep_inside=False)
    assert [r["x"] for r in outside.orderBy("run", "point_idx").collect()] == [0, 1, 2, 2.5, 4.5, 5, 6, 6.5, 7.5, 8, 9]


def test_masks_use_floor_and_parcels_round(spark, lines):
    grid = scaling_grid(2, 1, 1, 1.0)
    voxel = spark.createDataFrame([("m", 1, 0, 0, 5)], "mask_id string, i int, j int, k int, label int")
    pts = lines([[(0.6, 0, 0), (0.7, 0, 0)]])
    assert ids(sel.parcel_roi(pts, voxel, grid, [5])) == [0]
    assert ids(sel.mask_hits_all(pts, voxel, grid, ["m"])) == []


def test_empty_reference_passes(lines):
    pts = lines([run(3), run(4)])
    assert ids(sel.hausdorff_filter(pts, pts.limit(0), 1.0)) == [0, 1]


def test_unknown_field_is_an_error(spark):
    table = spark.createDataFrame([(1, "fa", 0.5)], "streamline_id long, field string, value double")
    with pytest.raises(ValueError):
        sel.select_field(table, "md")


# --- geometry -----------------------------------------------------------------------


def test_tangents(lines):
    out = {(r["streamline_id"], r["point_idx"]): (r["tx"], r["ty"], r["tz"]) for r in og.tangents(lines([[(0, 0, 0), (1, 0, 0), (1, 1, 0)], [(5, 5, 5)]])).collect()}
    h = 2**-0.5
    assert out[0, 0] == (1, 0, 0) and out[0, 2] == (0, 1, 0)
    assert out[0, 1] == pytest.approx((h, h, 0))
    assert out[1, 0] == (0.5, 0.5, 0.5)


def test_dedup_compares_with_the_last_kept(lines):
    creep = [(n * 4e-5, 0, 0) for n in range(7)]
    kept = og.dedup_consecutive(lines([creep, [(0, 0, 0), (0, 0, 0), (1, 0, 0)]])).orderBy("streamline_id", "point_idx").collect()
    assert [(r["streamline_id"], r["point_idx"]) for r in kept] == [(0, 0), (0, 3), (0, 6), (1, 0), (1, 2)]


def test_slices_round_trip_on_an_oblique_grid(spark):
    grid = Grid(12, 10, 8, (1.9, 0.3, 0.1, -20, -0.2, 2.1, 0.2, 5, 0.1, -0.2, 2.4, 30, 0, 0, 0, 1))
    for axis, n in ((0, 8), (1, 10), (2, 12)):
        rows = spark.range(n).select("id", nearest_slice_index(grid, axis, slice_world_position(grid, axis, F.col("id"))).alias("back"))
        assert rows.filter("id <> back").count() == 0


# --- fields -------------------------------------------------------------------------


def test_sphere_has_642_bins_and_finds_itself(spark):
    d, _ = icosphere()
    assert len(d) == 642 and len({tuple(np.round(v, 9)) for v in d}) == 642
    degree = np.bincount([a for a, _ in neighbour_pairs()])
    assert sorted(set(degree)) == [5, 6] and (degree == 5).sum() == 12
    rows = spark.createDataFrame([(n, *map(float, v)) for n, v in enumerate(d)], "n int, x double, y double, z double")
    assert rows.filter(nearest_bin(F.col("x"), F.col("y"), F.col("z")) != F.col("n")).count() == 0


def test_crossing_votes_in_both_voxels(lines):
    field = fields.direction_field(lines([[(0.25, 0.5, 0.5), (1.5, 0.5, 0.5)]]), 1.0, "crossings")
    rows = field.collect()
    assert len(rows) == 2 and all(r["weight"] == 1.0 for r in rows)
    assert len({r["bin"] for r in rows}) == 1
    best = icosphere()[0][rows[0]["bin"]]
    assert best[0] > 0.99


def test_smoothing_keeps_mass_roughly_and_normalises(lines):
    field = fields.direction_field(lines([run(5), run(5, axis=1)]), 1.0)
    smooth = fields.direction_smooth(field)
    assert smooth.count() > field.count()
    unit = fields.direction_normalize(smooth, "unit_mass").groupBy("i", "j", "k").agg(F.sum("weight").alias("m"))
    assert unit.filter(F.abs(F.col("m") - 1) > 1e-9).count() == 0


def test_coherent_bundle_scores_above_a_stray(lines):
    pts = lines([run(12)] * 8 + [run(12, axis=1, start=(4.0, -6.0, 0.0))])
    field = fields.direction_normalize(fields.direction_smooth(fields.direction_field(pts, 2.0)))
    score = {r["streamline_id"]: r["fico"] for r in pruning.purifibre_score(pts, field, 2.0).collect()}
    assert score[0] > score[8]
    _, kept = pruning.purifibre(pts, field, 2.0, puri_fraction=0.1)
    assert set(ids(kept)) <= set(range(9)) and 8 not in ids(pruning.purifibre(pts, field, 2.0, puri_fraction=0.2)[1])


# --- volumes and masks --------------------------------------------------------------


def test_boundary_faces(spark):
    grid = scaling_grid(5, 5, 5, 1.0)
    one = spark.createDataFrame([(2, 2, 2)], "i int, j int, k int")
    assert volumes.mask_boundary_faces(one, grid).count() == 6
    block = spark.createDataFrame([(i, j, k) for i in range(3) for j in range(3) for k in range(3)], "i int, j int, k int")
    faces = volumes.mask_boundary_faces(block, grid).collect()
    assert len(faces) == 54
    for f in faces:
        a, b, c = (np.array([f[n][x] for x in "xyz"]) for n in ("c0", "c1", "c2"))
        outward = np.cross(b - a, c - a)
        side = np.zeros(3)
        side[f["side"] // 2] = 1 if f["side"] % 2 else -1
        assert np.allclose(outward, side)


def test_dilation(spark):
    grid = scaling_grid(9, 9, 9, 1.0)
    one = spark.createDataFrame([(4, 4, 4)], "i int, j int, k int")
    assert volumes.mask_dilate(one, grid, 0.0).count() == 1
    assert volumes.mask_dilate(one, grid, 1.0).count() == 7
    # The squared radius is rounded up: 1.2^2 -> 2 adds the edge neighbours.
    assert volumes.mask_dilate(one, grid, 1.2).count() == 19
    corner = spark.createDataFrame([(0, 0, 0)], "i int, j int, k int")
    assert volumes.mask_dilate(corner, grid, 1.0).count() == 4


def test_blur_keeps_mass_inside_and_is_identity_when_narrow(spark):
    one = spark.createDataFrame([(6, 6, 6, 8.0)], "i int, j int, k int, value double")
    total = volumes.gaussian_blur(one, (13, 13, 13), 1.0).agg(F.sum("value").alias("s")).first()["s"]
    assert total == pytest.approx(8.0)
    assert volumes.gaussian_blur(one, (13, 13, 13), 0.4).collect() == one.collect()


def test_union_without_a_grid_is_the_other_mask(spark):
    a = spark.createDataFrame([(1, 1, 1)], "i int, j int, k int")
    grid = scaling_grid(3, 3, 3, 1.0)
    assert volumes.mask_union(spark, a, None, a, grid).count() == 1
    assert volumes.mask_union(spark, a, grid, a.limit(0), None).count() == 1


def test_ranges_of_nothing_default(spark):
    empty = spark.createDataFrame([(float("nan"),), (float("inf"),)], "v double")
    assert tuple(volumes.robust_range(empty, "v").first()) == (0.0, 1.0)
    assert tuple(volumes.finite_minmax(empty, "v").first()) == (0.0, 1.0)


# --- orientation rows ---------------------------------------------------------------


@pytest.mark.parametrize(
    "row, options, want",
    [
        ([1.0, 2.0, 3.0], {"subtract_iso": False, "norm_within_voxel": False}, [1, 2, 3]),
        ([1.0, 2.0, 3.0], {"norm_within_voxel": False}, [0, 1, 2]),
        ([1.0, 2.0, 4.0], {"subtract_iso": False, "target_mm": 2.0}, [0.5, 1, 2]),
        ([1.0, 2.0, 3.0], {"target_mm": 4.0}, [0, 2, 4]),
        ([2.0, 2.0], {}, [0, 0]),
        ([1.0, 2.0], {"subtract_iso": False, "target_mm": 0.0}, [1, 2]),
    ],
)
def test_odf_conditioning(spark, row, options, want):
    out = spark.createDataFrame([(row,)], "a array<double>").select(orientation.odf_condition(F.col("a"), **options).alias("a")).first()["a"]
    assert out == pytest.approx(want)


def test_odf_with_a_hole_is_not_scaled(spark):
    df = spark.createDataFrame([([1.0, float("nan"), 3.0],)], "a array<double>")
    out = df.select(orientation.odf_condition(F.col("a"), target_mm=5.0).alias("a")).first()["a"]
    assert out[0] == 0 and np.isnan(out[1]) and out[2] == 2


def test_otsu_splits_two_heaps(spark):
    rows = [(v, 0, 0.1) for v in range(50)] + [(v, 1, 0.9) for v in range(50)]
    fixels = spark.createDataFrame(rows, "voxel_id int, fixel_idx int, qa double")
    cut = orientation.otsu_threshold(fixels)
    assert 0.1 < cut.first()["threshold"] < 0.9
    assert orientation.fixel_otsu_gate(fixels, cut).count() == 50
    with pytest.raises(ValueError):
        orientation.otsu_threshold(fixels.drop("qa"))


def test_fixel_colours_need_matching_counts(spark):
    fixels = spark.createDataFrame([(0, 0, 1.0, 0.0, 0.0)], "voxel_id int, fixel_idx int, dx double, dy double, dz double")
    with pytest.raises(ValueError):
        orientation.color_fixels(fixels, fixels.select("voxel_id", "fixel_idx", F.lit(1.0).alias("value")).limit(0))


def test_gate_is_off_without_a_value(spark):
    df = spark.createDataFrame([(float("nan"),), (0.0,), (0.5,), (2.0,), (float("inf"),)], "v double")
    out = [r[0] for r in df.select(color.piecewise_gate(F.col("v"), 0.0, 1.0, 0.5, 1.5)).collect()]
    assert out == [1.0, 0.5, 1.0, 1.5, 1.0]


# --- surfaces -----------------------------------------------------------------------

BOX = {0: (0, 0, 0), 1: (1, 0, 0), 2: (0, 1, 0), 3: (0, 0, 1)}


def tetrahedra(spark, n):
    vertices = [(4 * t + v, *(c + 10.0 * t for c in p)) for t in range(n) for v, p in BOX.items()]
    faces = [(4 * t + f, *(4 * t + v for v in c)) for t in range(n) for f, c in enumerate([(0, 2, 1), (0, 1, 3), (0, 3, 2), (1, 2, 3)])]
    return (
        spark.createDataFrame([(i, float(x), float(y), float(z)) for i, x, y, z in vertices], "vertex_id long, x double, y double, z double"),
        spark.createDataFrame(faces, "tri_id long, v0 long, v1 long, v2 long"),
    )


def test_components_and_volume(spark):
    vertices, triangles = tetrahedra(spark, 3)
    parts = surfaces.mesh_components(triangles, vertices).collect()
    assert {r["component"] for r in parts} == {0, 4, 8} and len(parts) == 12
    assert all(r["volume_mm3"] == pytest.approx(1 / 6) for r in parts)
    assert surfaces.mesh_components(triangles, vertices, 1.0).count() == 0


def test_long_chain_is_one_component(spark):
    chain = spark.range(300).select(F.col("id").alias("u"), (F.col("id") + 1).alias("v"))
    assert [r["component"] for r in surfaces.connect(chain).select("component").distinct().collect()] == [0]


def test_layer_count_mismatch_is_an_error(spark):
    vertices, _ = tetrahedra(spark, 1)
    short = vertices.limit(2).select("vertex_id", F.lit(1.0).alias("value"))
    with pytest.raises(ValueError):
        surfaces.blend_surface_layers(vertices, [surfaces.SurfaceLayer(short)])


# --- shapes -------------------------------------------------------------------------


def test_parabola_apex(lines):
    u = np.linspace(-5, 5, 21)
    tilted = [(x, 0.8 * 0.3 * x * x, 0.6 * 0.3 * x * x) for x in u]
    fit = shapes.fit_parabola_triangle(lines([tilted, run(20), run(3)])).collect()
    assert len(fit) == 1
    apex, e1, n = fit[0]["apex"], fit[0]["e1"], fit[0]["plane_normal"]
    assert (apex["x"], apex["y"], apex["z"]) == pytest.approx((0, 0, 0), abs=1e-6)
    assert (e1["x"], e1["y"], e1["z"]) == pytest.approx((-5, 6, 4.5), abs=1e-6)
    assert abs(n["x"]) < 1e-9 and n["x"] ** 2 + n["y"] ** 2 + n["z"] ** 2 == pytest.approx(1)
    assert shapes.triangle_segments(lines([tilted])).count() == 4


# --- sets, labels, names ------------------------------------------------------------


def test_merge_count_is_the_sum(lines):
    a, b = lines([run(3), run(4)]), lines([run(5)])
    both = sets.merge(sets.Tractogram(a), sets.Tractogram(b)).points
    assert both.count() == 12 and ids(both.select("streamline_id").distinct()) == [0, 1, 2]
    with pytest.raises(ValueError):
        sets.concat_tractograms([(sets.Tractogram(a), None)])


def test_save_needs_a_path(lines):
    with pytest.raises(ValueError):
        tables.write_tractogram(sets.Tractogram(lines([run(2)])), None, "")


def test_label_files(spark, tmp_path):
    (tmp_path / "a.txt").write_text("# head\n1 Left Area 10 20 30\n2 Plain Name\n2 Later Name 1 2 3 4\n", encoding="utf-8")
    (tmp_path / "b.csv").write_text('5, "Quoted", 255, 0, 0, 255\nx,bad\n', encoding="utf-8")
    rows = {r["label"]: r for r in tables.read_label_tables(spark, str(tmp_path)).collect()}
    assert rows[1]["name"] == "Left Area" and rows[1]["g"] == pytest.approx(20 / 255) and rows[1]["a"] == 1.0
    # Three trailing bytes are a colour, so the fourth from the end stays in the name.
    assert rows[2]["name"] == "Later Name 1" and rows[5]["name"] == "Quoted" and set(rows) == {1, 2, 5}


def test_a_label_file_without_labels_is_an_error(spark, tmp_path):
    (tmp_path / "a.txt").write_text("1 One\n", encoding="utf-8")
    for text in ("# nothing\nno label\n", ""):
        (tmp_path / "b.txt").write_text(text, encoding="utf-8")
        with pytest.raises(Exception, match="no label could be read"):
            tables.read_label_tables(spark, str(tmp_path)).collect()


def test_a_label_file_in_many_splits(spark, tmp_path):
    (tmp_path / "a.txt").write_text("".join(f"{n % 50} Area {n}\r\n" for n in range(4000)), encoding="utf-8", newline="")
    before = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "4096")
    try:
        table = tables.read_label_tables(spark, str(tmp_path))
        assert {r["label"]: r["name"] for r in table.collect()} == {n % 50: f"Area {n}" for n in range(3950, 4000)}
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", before)


def test_offset_arrays(spark, tmp_path):
    sizes = {"a": [0, 3, 40, 0, 1], "b": [17], "c": [], "d": [8, 8]}
    rows = []
    for subject, own in sizes.items():
        ends = [sum(own[:n]) for n in range(len(own) + 1)]
        flat = [float(v) for v in range(ends[-1])]
        rows.append((subject, ends, flat, [v / 2 for v in flat], [-v for v in flat], [v * v for v in flat]))
    files = spark.createDataFrame(rows, "subject_id string, offsets array<int>, x array<float>, y array<float>, z array<float>, fa array<double>")
    offsets, positions = tables.cut_offset_arrays(files, width=8)
    assert positions.count() == 6 + 3 + 2
    offsets.write.parquet(f"{tmp_path}/offsets")
    positions.write.parquet(f"{tmp_path}/positions")
    got = sorted(tuple(r) for r in tables.read_tractogram(spark, str(tmp_path)).points.collect())
    want = [
        (s, n, i, float(v), v / 2, float(-v), float(v * v))
        for s, own in sizes.items() for n, size in enumerate(own) for i in range(size) for v in [sum(own[:n]) + i]
    ]
    assert got == want
    with pytest.raises(Exception, match="offsets point past"):
        tables.join_offset_arrays(offsets, positions.filter("block < 2")).collect()


def test_catalogue_layouts_and_traps(spark):
    names = [
        "sub-01_space-MNI_desc-LeftArcuateInclude2_mask.nii.gz", "sub-01_space-MNI_desc-LeftArcuateInclude1_mask.nii.gz",
        "sub-01_space-MNI_desc-LeftArcuateExclude1_mask.nii.gz", "sub-01_space-MNI_desc-LeftArcuateStart_mask.nii.gz",
        "sub-01_space-MNI_desc-LeftArcuate_probseg.nii.gz", "sub-01_space-MNI_desc-LeftArcuate_dwi.nii.gz",
        "sub-01_space-MNI_desc-PosteriorLeftArcuateInclude1_mask.nii.gz", "sub-01_space-T1w_desc-LeftArcuateInclude3_mask.nii.gz",
        "sub-01_space-MNI_desc-x_desc-ROI-ARC_L-4-include.nii.gz", "sub-01_space-MNI_desc-LeftArcuateInclude9_mask.json",
    ]
    paths = spark.createDataFrame([(f"/d/{n}",) for n in names], "path string")
    bundles = spark.createDataFrame([("Left Arcuate", ["ARC_L"])], "bundle string, legacy_keys array<string>")
    got = sorted((r["role"], r["idx"]) for r in catalog.catalog_derivatives(paths, bundles, "MNI").collect() if r["idx"] is not None)
    assert got == [("exclude", 1), ("include", 1), ("include", 2), ("include", 4)]
    assert {r["role"] for r in catalog.catalog_derivatives(paths, bundles, "MNI").filter("idx is null").collect()} == {"start", "probmap"}
    assert [r["space"] for r in catalog.detect_spaces(paths).orderBy("space").collect()] == ["MNI", "T1w"]
    assert catalog.pick_space(paths).first()["space"] == "MNI"
    assert catalog.available_bundles(paths, bundles, "T1w").count() == 1
    assert catalog.available_bundles(paths, bundles, "none").count() == 0


def test_kinds_of_files(spark):
    want = {
        "/d/a.trx": "streamlines", "/d/b.nii.gz": "volume", "/d/c_atlas.nii.gz": "parcellation", "/d/d.nii.gz": "parcellation",
        "/d/d.nii.txt": "unsupported", "/d/e.dscalar.nii": "cifti", "/d/f.surf.gii": "surface", "/d/g.fib.gz": "orientation",
    }
    paths = spark.createDataFrame([(p,) for p in want], "path string")
    assert {r["path"]: r["kind"] for r in catalog.classify_assets(paths).collect()} == want


def test_rules_replace_and_pass(spark):
    plan = rules.simple_plan(spark, "b")
    plan = rules.add_rule(rules.add_rule(plan, "b", "limiting", "one"), "b", "limiting", "two")
    plan = rules.add_rule(rules.add_rule(plan, "b", "roa", "three"), "b", "roa", "four")
    assert sorted(r["mask_id"] for r in rules.add_rule(plan, "b", "roi", None).collect()) == ["four", "three", "two"]
    with pytest.raises(ValueError):
        rules.add_rule(plan, "b", "nowhere", "m")


def test_missing_map_is_an_error(spark):
    expanded = spark.createDataFrame([(0, cifti.LEFT, 1, 2.0)], "map_id int, structure string, vertex long, value double")
    with pytest.raises(ValueError):
        cifti.cifti_structure(expanded, cifti.LEFT, 3)


def test_region_plan_refuses_missing_includes_and_mixed_grids(spark):
    from axonframe.plans.roi import prepare_roi_plan

    catalog_rows = [("b", "include", 1, "/a"), ("b", "exclude", 1, "/x"), ("b", "end", None, "/e"), ("only", "end", None, "/e")]
    found = spark.createDataFrame(catalog_rows, "bundle string, role string, idx long, path string")
    unit = [1.0, 0, 0, 0, 0, 1.0, 0, 0, 0, 0, 1.0, 0, 0, 0, 0, 1.0]

    def grids(last):
        rows = [("/a", 9, 9, 9, unit), ("/x", 9, 9, 9, unit), ("/e", 9, 9, last, unit)]
        return spark.createDataFrame([(p, i, j, k, [float(v) for v in m]) for p, i, j, k, m in rows], "path string, nx int, ny int, nz int, affine array<double>")

    voxels = spark.createDataFrame([("/a", 4, 4, 4), ("/x", 0, 0, 0), ("/e", 8, 8, 8)], "path string, i int, j int, k int")
    plan = prepare_roi_plan(found, voxels, grids(9), "b", waypoint_mm=1.0, exclusion_mm=0.0, endpoint_mm=1.0, min_len_mm=20.0)
    sizes = {r["mask_id"]: r["count"] for r in plan.masks.groupBy("mask_id").count().collect()}
    assert sizes == {"b_include1": 7, "b_exclude": 1, "b_end": 4}
    assert {(r["role"], r["mask_id"]) for r in plan.rules.collect()} == {("roi", "b_include1"), ("roa", "b_exclude"), ("end", "b_end")}
    assert plan.params.first()["min_len_mm"] == 20.0
    with pytest.raises(ValueError):
        prepare_roi_plan(found, voxels, grids(8), "b")
    with pytest.raises(ValueError):
        prepare_roi_plan(found, voxels, grids(9), "only")


# --- cohorts ------------------------------------------------------------------------


def test_each_subject_has_its_own_single_files(spark):
    names = [f"/d/sub-{s}{ses}/sub-{s}_space-MNI_desc-BStart_mask.nii.gz" for s in "abc" for ses in ("", "/ses-2")]
    paths = spark.createDataFrame([(n,) for n in names], "path string")
    bundles = spark.createDataFrame([("B",)], "bundle string")
    got = catalog.catalog_derivatives(paths, bundles, "MNI").collect()
    assert sorted((r["subject_id"], r["session_id"] or "") for r in got) == [(s, x) for s in "abc" for x in ("", "2")]


def test_subsample_counts_each_subject(lines):
    one = lines([run(7), run(8)]).withColumn("subject_id", F.lit("a"))
    two = lines([run(3), run(2)]).withColumn("subject_id", F.lit("b"))
    both = sel.subsample_points(one.unionByName(two), 5)
    apart = sel.subsample_points(one, 5).unionByName(sel.subsample_points(two, 5))
    key = ["subject_id", "streamline_id", "point_idx"]
    assert sorted(map(tuple, both.select(*key).collect())) == sorted(map(tuple, apart.select(*key).collect()))
    assert both.filter("subject_id = 'a'").count() == 5 and both.filter("subject_id = 'b'").count() == 5


def test_files_of_one_number_are_waypoints_of_their_own(spark):
    from axonframe.plans.roi import prepare_roi_plan

    found = spark.createDataFrame([("b", "include", 1, "/a"), ("b", "include", 1, "/c")], "bundle string, role string, idx long, path string")
    unit = [1.0, 0.0, 0.0, 0.0, 0.0, 1.0, 0.0, 0.0, 0.0, 0.0, 1.0, 0.0, 0.0, 0.0, 0.0, 1.0]
    grids = spark.createDataFrame([(p, 9, 9, 9, unit) for p in ("/a", "/c")], "path string, nx int, ny int, nz int, affine array<double>")
    voxels = spark.createDataFrame([("/a", 1, 1, 1), ("/c", 7, 7, 7)], "path string, i int, j int, k int")
    plan = prepare_roi_plan(found, voxels, grids, "b", waypoint_mm=0.0)
    assert {r["mask_id"] for r in plan.rules.collect()} == {"b_include1", "b_include1_2"}
    assert {r["mask_id"]: r["count"] for r in plan.masks.groupBy("mask_id").count().collect()} == {"b_include1": 1, "b_include1_2": 1}


def test_last_group_in_file_order_wins(spark, lines):
    """With an order of the file the names' order does not count; each subject has its own."""
    pts = lines([run(2)]).withColumn("subject_id", F.explode(F.array(F.lit("a"), F.lit("b"))))
    rows = [("a", 0, "z", 0), ("a", 0, "m", 1), ("b", 0, "m", 0), ("b", 0, "z", 1)]
    groups = spark.createDataFrame(rows, "subject_id string, streamline_id long, group_name string, group_ord int")
    own = spark.createDataFrame([("z", 1.0, 0.0, 0.0), ("m", 0.0, 0.25, 1.0)], "group_name string, r double, g double, b double")
    got = {r["subject_id"]: (r["r"], r["g"], r["b"]) for r in coloring.color_by_group(pts, groups, own).collect()}
    assert got == {"a": (0.0, 0.25, 1.0), "b": (1.0, 0.0, 0.0)}
    by_name = coloring.color_by_group(pts, groups.drop("group_ord"), own).collect()
    assert {(r["r"], r["g"], r["b"]) for r in by_name} == {(1.0, 0.0, 0.0)}


def test_plane_cut_of_a_triangle_without_area(spark):
    """Two crossings at one place are a segment; a corner on the plane is its end, in whatever order the corners come."""
    places = [(0, 0.0, 0.0, 0.0), (1, 2.0, 4.0, 2.0), (2, 4.0, 8.0, 4.0), (3, 0.0, 0.0, 1.0), (4, 5.0, 0.0, 3.0), (5, 0.0, 0.0, -1.0)]
    vertices = spark.createDataFrame(places, "vertex_id long, x double, y double, z double")
    faces = spark.createDataFrame([(0, 0, 1, 2), (1, 3, 4, 5), (2, 5, 3, 4), (3, 4, 5, 3), (4, 0, 3, 5)], "tri_id long, v0 long, v1 long, v2 long")
    cut = {r["tri_id"]: ((r["ax"], r["ay"]), (r["bx"], r["by"])) for r in surfaces.mesh_plane_segments(faces, vertices, 0, 1.0).collect()}
    assert cut[0] == ((1.0, 2.0), (1.0, 2.0))
    assert all(sorted(cut[n]) == [(0.0, 0.0), (2.5, 0.0)] for n in (1, 2, 3))
    assert cut[4] == ((0.0, 0.0), (0.0, 0.0))
