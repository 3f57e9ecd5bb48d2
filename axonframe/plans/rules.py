"""Bundle rules: which mask plays which role for which bundle, and scalar parameters.

``rules``: bundle_id, role, mask_id. ``params``: bundle_id plus one column per parameter.
Roles are roi, roa, end, no_end, limiting, term, seed.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from axonframe.functions.scan import small_table

RULES = "bundle_id string, role string, mask_id string"
ROLES = ("roi", "roa", "end", "no_end", "limiting", "term", "seed")
PARAMS = (
    "min_len_mm", "max_len_mm", "max_angle_deg", "step_size_mm", "fixel_threshold",
    "smooth_fraction", "max_hausdorff_mm", "tolerance_mm", "fixel_otsu",
)


def simple_plan(spark: SparkSession, bundle_id: str, seed: str | None = None) -> DataFrame:
    rows = [(bundle_id, "seed", seed)] if seed else []
    return small_table(spark, rows, RULES)


def simple_params(spark: SparkSession, bundle_id: str, **overrides: float | None) -> DataFrame:
    """One row with the given overrides; the other parameters stay NULL."""
    unknown = set(overrides) - set(PARAMS)
    if unknown:
        raise ValueError(f"unknown parameters {sorted(unknown)}")
    columns = [F.lit(None if overrides.get(p) is None else float(overrides[p])).cast("double").alias(p) for p in PARAMS]
    return spark.range(1).select(F.lit(bundle_id).alias("bundle_id"), *columns)


def add_rule(rules: DataFrame, bundle_id: str, role: str, mask_id: str | None) -> DataFrame:
    """Add a mask in a role. No mask changes nothing; a limiting mask replaces the last.

    Several roa, term or no_end masks of a bundle act as their union, several roi or end
    masks must each be met.
    """
    if role not in ROLES:
        raise ValueError(f"unknown role {role!r}")
    if mask_id is None:
        return rules
    if role in ("limiting", "seed"):
        rules = rules.filter(~((F.col("bundle_id") == bundle_id) & (F.col("role") == role)))
    added = small_table(rules.sparkSession, [(bundle_id, role, mask_id)], RULES)
    return rules.unionByName(added)


def plan_params_resolve(params: DataFrame, defaults: dict[str, float]) -> DataFrame:
    """Plan override, else the operator's default, field by field."""
    return params.select(
        "bundle_id", *[F.coalesce(F.col(n), F.lit(float(v))).alias(n) for n, v in defaults.items()]
    )
