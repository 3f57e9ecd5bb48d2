"""Classification of streamlines against whole bundle plans."""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from axonframe.functions.geometry import XYZ, Grid, points_to_voxels
from axonframe.functions.scan import cut_lineage, lookup, settled, streamline_keys, subject, voxel_keys
from axonframe.operators.geometry import streamline_length
from axonframe.operators.selection import ids, keep, mean_cloud_distance

OUTCOMES = (
    "reject_roa", "reject_min_length", "reject_roi", "reject_no_end", "reject_end",
    "reject_hausdorff", "reject_max_length",
)

#: Masks of a plan that share a long word.
WORD = 64


@dataclass
class Classified:
    """Outcomes of all (streamline, bundle) pairs, those without contact as counts.

    ``touched``: streamline keys, bundle_id, outcome of the pairs that had to be looked at.
    ``untouched``: bundle_id, outcome, attempts of the others; their outcome follows from the
    length alone. ``classes``: bundle_id, length_class and that outcome. ``lengths``: streamline
    keys, length_class.
    """

    touched: DataFrame
    untouched: DataFrame
    classes: DataFrame
    lengths: DataFrame

    def accepted(self, bundle_id: str | None = None) -> DataFrame:
        """The accepted pairs, of one bundle or of all."""
        wanted = F.lit(True) if bundle_id is None else F.col("bundle_id") == bundle_id
        return self.pairs(wanted, "accept").drop("outcome")

    def pairs(self, bundles: Column | None = None, outcome: str | None = None) -> DataFrame:
        """All pairs with their outcome, one row each: as many as streamlines times bundles, so for
        plans of a few bundles, or with ``outcome`` for what is wanted of many."""
        keys = streamline_keys(self.lengths)
        by = subject(self.lengths, self.classes)
        bundles = F.lit(True) if bundles is None else bundles
        of = F.lit(True) if outcome is None else F.col("outcome") == outcome
        blank = lookup(self.lengths, self.classes.filter(bundles & of), [*by, "length_class"], spread=True)
        rest = blank.select(*keys, "bundle_id", "outcome").join(self.touched, [*keys, "bundle_id"], "left_anti")
        return self.touched.filter(bundles & of).unionByName(rest)


def bundle_classify(
    pts: DataFrame,
    rules: DataFrame,
    params: DataFrame,
    masks: DataFrame,
    grid: Grid,
    references: DataFrame | None = None,
) -> Classified:
    """``accept`` or the first rule that fails, for each streamline and each bundle of its plan.

    Order: roa, minimum length, roi, no_end, end, mean distance to the reference, maximum
    length. Only pairs with a contact are looked at: a vertex in one of the bundle's masks or, for
    a bundle that asks for no mask, near its ``references`` (bundle_id, x, y, z). What happens to
    the others depends on the length class only, an interval between the limits of all bundles,
    so they are counted per class. Distances are found last, for pairs that passed the rules before,
    in one search keyed by bundle. Plans, masks and references are per subject where they carry one.
    """
    keys = streamline_keys(pts)
    by = subject(pts, params)
    on_plan = [*by, "bundle_id"]
    rules = rules.select(*subject(pts, rules), "bundle_id", "role", "mask_id").distinct()
    limits = params.select(*on_plan, *[F.col(c).cast("double").alias(c) for c in ("min_len_mm", "max_len_mm", "max_hausdorff_mm")])
    wanted = rules.groupBy(*subject(rules), "bundle_id").agg(
        F.count_if(F.col("role") == "roi").alias("_want_roi"), F.count_if(F.col("role") == "end").alias("_want_end")
    )
    plan = limits.join(wanted, [*subject(limits, rules), "bundle_id"], "left").fillna(0, ["_want_roi", "_want_end"])
    has_ref = F.lit(False)
    if references is not None:
        named = references.select(*subject(limits, references), "bundle_id").distinct().withColumn("_ref", F.lit(True))
        plan = plan.join(named, [*subject(limits, references), "bundle_id"], "left")
        has_ref = F.coalesce(F.col("_ref"), F.lit(False)) & F.col("max_hausdorff_mm").isNotNull()
    plan = cut_lineage(plan.withColumn("_measured", has_ref).drop("_ref"))

    lengths = ids(pts).join(streamline_length(pts), keys, "left").withColumn("length_mm", F.coalesce("length_mm", F.lit(0.0)))
    lengths = cut_lineage(_length_classes(lengths, plan, by))
    classes = cut_lineage(_blank_outcomes(lengths, plan, by))

    flags = _contacts(pts, rules, masks, grid)
    near = None if references is None else _near_references(pts, plan, references, by)
    met = flags if near is None else flags.join(near, [*keys, "bundle_id"], "full")
    judged = lookup(met, lengths, keys)
    judged = lookup(judged, plan, on_plan, spread=True)

    def count(name: str) -> Column:
        return F.coalesce(F.col(name), F.lit(0))

    tests = [
        F.coalesce(F.col("_roa"), F.lit(False)),
        F.col("length_mm") < F.col("min_len_mm"),
        count("_roi") < F.col("_want_roi"),
        F.coalesce(F.col("_no_end"), F.lit(False)),
        count("_end") < F.col("_want_end"),
    ]
    judged = judged.withColumn("_first", _first(tests, OUTCOMES))
    judged = judged.select(*keys, "bundle_id", "_first", "_measured", "length_mm", "max_len_mm", "max_hausdorff_mm")
    far = F.lit(False)
    if references is not None:
        judged = cut_lineage(judged)
        open_pairs = judged.filter(F.col("_first").isNull() & F.col("_measured")).select(*keys, "bundle_id")
        vertices = lookup(open_pairs, pts.select(*keys, "point_idx", *XYZ), keys)
        far_by = [*subject(pts, references), "bundle_id"]
        means = mean_cloud_distance(vertices, references, far_by, [*keys, "bundle_id"])
        judged = judged.join(means, [*keys, "bundle_id"], "left")
        far = F.col("_measured") & (F.col("mean_distance_mm") > F.col("max_hausdorff_mm"))
    last = _first([far, F.col("length_mm") > F.col("max_len_mm")], OUTCOMES[5:])
    touched = judged.select(*keys, "bundle_id", F.coalesce("_first", last, F.lit("accept")).alias("outcome"))
    touched = cut_lineage(touched)

    # Without the pairs that were looked at, by what they would have had without contact.
    sizes = lengths.groupBy(*by, "length_class").agg(F.count("*").alias("n"))
    total = sizes.join(classes, [*by, "length_class"]).groupBy(*on_plan, "outcome").agg(F.sum("n").alias("n"))
    seen = lookup(touched.select(*keys, "bundle_id"), lengths.select(*keys, "length_class"), keys)
    seen = lookup(seen, classes, [*by, "length_class", "bundle_id"], spread=True)
    seen = seen.groupBy(*on_plan, "outcome").agg((-F.count("*")).alias("n"))
    untouched = total.unionByName(seen).groupBy(*on_plan, "outcome").agg(F.sum("n").alias("attempts")).filter("attempts > 0")
    return Classified(touched, untouched, classes, lengths.select(*keys, "length_class"))


def _first(tests: list[Column], names: tuple[str, ...]) -> Column:
    return F.coalesce(*[F.when(test, F.lit(name)) for test, name in zip(tests, names)])


def _length_classes(lengths: DataFrame, plan: DataFrame, by: list[str]) -> DataFrame:
    """Adds ``length_class``: which of the plan's length limits lie below, and which are met exactly."""
    cuts = plan.select(*by, F.explode(F.array("min_len_mm", "max_len_mm")).alias("_cut"))
    cuts = cuts.groupBy(*by, F.lit(1).alias("_one")).agg(F.sort_array(F.collect_set("_cut")).alias("_cuts"))
    placed = lookup(lengths.withColumn("_one", F.lit(1)), cuts, [*by, "_one"], "left", small=True)
    below = F.size(F.filter("_cuts", lambda c: c < F.col("length_mm"))) + F.size(F.filter("_cuts", lambda c: c <= F.col("length_mm")))
    return placed.withColumn("length_class", F.coalesce(below, F.lit(0))).drop("_one", "_cuts")


def _blank_outcomes(lengths: DataFrame, plan: DataFrame, by: list[str]) -> DataFrame:
    """``bundle_id, length_class, outcome`` of pairs without contact: classes times bundles, whatever the data."""
    sample = lengths.groupBy(*by, "length_class").agg(F.min("length_mm").alias("length_mm")).withColumn("_one", F.lit(1))
    each = sample.join(plan.withColumn("_one", F.lit(1)), [*by, "_one"])
    tests = [
        F.col("length_mm") < F.col("min_len_mm"), F.col("_want_roi") > 0, F.col("_want_end") > 0, F.col("_measured"),
        F.col("length_mm") > F.col("max_len_mm"),
    ]
    found = _first(tests, (OUTCOMES[1], OUTCOMES[2], OUTCOMES[4], OUTCOMES[5], OUTCOMES[6]))
    return each.select(*by, "bundle_id", "length_class", F.coalesce(found, F.lit("accept")).alias("outcome"))


def _contacts(pts: DataFrame, rules: DataFrame, masks: DataFrame, grid: Grid) -> DataFrame:
    """``_roa, _roi, _no_end, _end`` of each (streamline, bundle) with a vertex in one of its masks."""
    keys = streamline_keys(pts)
    judging = rules.filter(F.col("role").isin("roa", "roi", "no_end", "end"))
    used = masks.join(judging.select(*subject(masks, rules), "mask_id").distinct(), [*subject(masks, rules), "mask_id"], "left_semi")
    on, owner = voxel_keys(pts, masks), subject(pts, masks, rules)
    # The masks of a plan as bits of a few long words: a streamline's contacts take two words, however many there are.
    names = judging.groupBy(*owner, F.lit(1).alias("_one")).agg(F.sort_array(F.collect_set("mask_id")).alias("_names"))
    bits = cut_lineage(names.select(*owner, F.posexplode("_names").alias("_bit", "mask_id")))
    words = range((bits.agg(F.max("_bit").alias("m")).first()["m"] or 0) // WORD + 1)

    def word(w: int, when: Column | None = None) -> Column:
        here = F.floor(F.col("_bit") / WORD) == w
        one = F.call_function("shiftleft", F.lit(1).cast("long"), F.pmod("_bit", F.lit(WORD)).cast("int"))
        return F.coalesce(F.bit_or(F.when(here if when is None else here & when, one)), F.lit(0).cast("long"))

    seats = points_to_voxels(pts, grid, "floor")
    seen, few = settled(seats.select(*on).distinct())
    marked = lookup(lookup(used, seen, on, "left_semi", small=few), bits, [*owner, "mask_id"], spread=True)
    marked, few = settled(marked.groupBy(*on).agg(*[word(w).alias(f"_w{w}") for w in words]))
    tops = pts.select(*keys, "point_idx", *XYZ)
    # Vertices outside the grid meet no mask, and must not meet one another in one task.
    apart = -1 - F.pmod(F.xxhash64(*keys, "point_idx"), F.lit(1 << 20)).cast("int")
    tops = points_to_voxels(tops, grid, "floor", keep_outside=True).withColumn("i", F.coalesce("i", apart))
    tops = tops.withColumns({c: F.coalesce(c, F.lit(-1)) for c in "jk"})
    rows = lookup(tops, marked, on, "left", spread=True, small=few)
    none = F.lit(0).cast("long")
    held = [F.coalesce(f"_w{w}", none) for w in words]
    found = rows.groupBy(*keys).agg(
        F.count("*").alias("_n"),
        *[F.bit_or(v).alias(f"_body{w}") for w, v in zip(words, held)],
        *[side(v, "point_idx").alias(f"_{name}{w}") for w, v in zip(words, held) for name, side in (("first", F.min_by), ("last", F.max_by))],
    )
    found = found.filter(_any([F.col(f"_body{w}") != 0 for w in words]))
    tips = {f"_tips{w}": F.when(F.col("_n") >= 2, F.col(f"_first{w}").bitwiseOR(F.col(f"_last{w}"))).otherwise(none) for w in words}
    found = found.withColumns(tips).select(*keys, *[f"{side}{w}" for w in words for side in ("_body", "_tips")])
    asked = lookup(judging, bits, [*owner, "mask_id"]).groupBy(*subject(pts, rules), "bundle_id").agg(
        *[word(w, F.col("role") == role).alias(f"_{role}{w}") for w in words for role in ("roa", "roi", "no_end", "end")]
    )
    asked, few = settled(asked.withColumn("_one", F.lit(1)))
    met = lookup(found.withColumn("_one", F.lit(1)), asked, [*subject(pts, rules), "_one"], spread=True, small=few)

    def hits(side: str, role: str) -> list[Column]:
        return [F.col(f"{side}{w}").bitwiseAND(F.col(f"_{role}{w}")) for w in words]

    met = met.filter(_any([h != 0 for role in ("roa", "roi", "no_end", "end") for h in hits("_body", role)]))
    return met.select(
        *keys,
        "bundle_id",
        _any([h != 0 for h in hits("_body", "roa")]).alias("_roa"),
        sum((F.bit_count(h) for h in hits("_body", "roi")), F.lit(0)).alias("_roi"),
        _any([h != 0 for h in hits("_tips", "no_end")]).alias("_no_end"),
        sum((F.bit_count(h) for h in hits("_tips", "end")), F.lit(0)).alias("_end"),
    )


def _any(tests: list[Column]) -> Column:
    return reduce(lambda a, b: a | b, tests)


def _near_references(pts: DataFrame, plan: DataFrame, references: DataFrame, by: list[str]) -> DataFrame:
    """Pairs that a mean distance within the limit is possible for, of bundles that ask for no mask.

    A mean within the limit takes a vertex within it, so the two share a cell as wide as the
    largest limit, or lie in adjacent ones.
    """
    keys = streamline_keys(pts)
    free = plan.filter(F.col("_measured") & (F.col("_want_roi") == 0) & (F.col("_want_end") == 0))
    wide = free.groupBy(*by, F.lit(1).alias("_one")).agg(F.greatest(F.max("max_hausdorff_mm"), F.lit(1e-3)).alias("_wide"))
    cell = [F.floor(F.col(c) / F.col("_wide")).alias(f"_{c}") for c in XYZ]
    free_ones, few = settled(free.select(*by, "bundle_id"))
    clouds = lookup(references, free_ones, [*subject(references, free), "bundle_id"], small=few).withColumn("_one", F.lit(1))
    clouds = lookup(clouds, wide, [*subject(clouds, wide), "_one"], small=True).select(*subject(clouds, wide), "bundle_id", *cell).distinct()
    for c in XYZ:
        clouds = clouds.withColumn(f"_{c}", F.explode(F.array(*[F.col(f"_{c}") + n for n in (-1, 0, 1)])))
    seated = lookup(pts.withColumn("_one", F.lit(1)), wide, [*by, "_one"], small=True).select(*keys, *cell)
    # A cell in one row with the bundles near it, so a vertex is not multiplied before it is known to be new.
    at = [*subject(seated, clouds), *[f"_{c}" for c in XYZ]]
    clouds, few = settled(clouds.groupBy(*at).agg(F.collect_set("bundle_id").alias("_near")))
    met = lookup(seated if few else seated.distinct(), clouds, at, spread=True, small=few)
    return met.select(*keys, F.explode("_near").alias("bundle_id")).distinct()


def keep_accepted(pts: DataFrame, found: Classified, bundle_id: str) -> DataFrame:
    """The vertices of the streamlines that the bundle accepts."""
    return keep(pts, found.accepted(bundle_id).select(*streamline_keys(pts)))


def rejection_summary(found: Classified) -> DataFrame:
    """Attempts per bundle and outcome, with bundle and grand totals (NULL keys), per subject if there are several."""
    by = subject(found.touched, found.untouched)
    looked_at = found.touched.groupBy(*by, "bundle_id", "outcome").agg(F.count("*").alias("attempts"))
    counts = looked_at.unionByName(found.untouched.select(*by, "bundle_id", "outcome", "attempts"))
    if not by:
        return counts.rollup("bundle_id", "outcome").agg(F.sum("attempts").alias("attempts"))
    levels = counts.groupingSets([[*by, "bundle_id", "outcome"], [*by, "bundle_id"], [*by]], *by, "bundle_id", "outcome")
    return levels.agg(F.sum("attempts").alias("attempts"))
