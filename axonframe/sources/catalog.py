"""Derivative-tree file names: roles, spaces, kinds. Inputs are tables of paths."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from axonframe.functions.scan import lookup

IMAGE = ".nii.gz"


def list_paths(spark: SparkSession, root: str) -> DataFrame:
    """Every file under a tree; only the listing is read, never the contents."""
    return spark.read.format("binaryFile").option("recursiveFileLookup", True).load(root).select("path")


def file_name(path: Column) -> Column:
    return F.substring_index(path, "/", -1)


def bundle_desc(name: Column) -> Column:
    """File-name form of a bundle name: blanks, dashes and underscores removed."""
    return F.translate(name, " -_", "")


def images(paths: DataFrame) -> DataFrame:
    return paths.select("path", file_name(F.col("path")).alias("name")).filter(F.col("name").endswith(IMAGE))


def entity(path: Column, key: str) -> Column:
    """Value of a ``key-value`` part of a path, NULL without one."""
    found = F.regexp_extract(path, f"(?:^|[/_]){key}-([A-Za-z0-9]+)", 1)
    return F.when(found != "", found)


def _bundles(bundles: DataFrame) -> DataFrame:
    keys = F.col("legacy_keys") if "legacy_keys" in bundles.columns else F.array().cast("array<string>")
    return bundles.select("bundle", bundle_desc(F.col("bundle")).alias("desc"), keys.alias("legacy_keys"))


def catalog_derivatives(paths: DataFrame, bundles: DataFrame, space: str) -> DataFrame:
    """(subject_id, session_id, bundle, role, idx, path) of the mask and probability files of a space.

    Current layout ``_space-S_desc-<Desc><Role><N>_mask`` / ``_desc-<Desc>_probseg``;
    legacy layout ``_desc-ROI-<key>-<N>-<role>``. A name that starts like the current
    layout of a bundle but ends in another suffix is skipped for that bundle. Roles:
    include, exclude (numbered), start, end, probmap (of a subject and session the last path
    in name order wins).
    The names are parsed once and matched by equality, never by substring per bundle.
    """
    names = images(paths)
    known = _bundles(bundles)
    marker = f"_space-{space}_desc-"
    tail = F.substring_index("name", marker, -1)
    current = names.filter(F.col("name").contains(marker)).withColumn("tail", tail)
    role_pattern = r"^(.*?)(Include[0-9]+|Exclude[0-9]+|Start|End)_mask\.nii\.gz$"
    desc = F.when(
        F.col("tail").rlike(role_pattern), F.regexp_extract("tail", role_pattern, 1)
    ).when(F.col("tail").endswith("_probseg.nii.gz"), F.regexp_extract("tail", r"^(.*)_probseg\.nii\.gz$", 1))
    token = F.regexp_extract("tail", role_pattern, 2)
    parsed = current.withColumn("desc", desc).filter(F.col("desc").isNotNull()).select(
        "path",
        "name",
        "desc",
        F.when(token.startswith("Include"), "include")
        .when(token.startswith("Exclude"), "exclude")
        .when(token == "Start", "start")
        .when(token == "End", "end")
        .otherwise("probmap")
        .alias("role"),
        F.when(F.regexp_extract(token, "([0-9]+)$", 1) != "", F.regexp_extract(token, "([0-9]+)$", 1)).cast("long").alias("idx"),
    )
    modern = lookup(parsed, known.select("bundle", "desc"), ["desc"]).select("bundle", "role", "idx", "path", "name")

    legacy_pattern = r"_desc-ROI-(.+)-([0-9]+)-(include|exclude|start|end)\.nii\.gz$"
    legacy = names.filter(F.col("name").contains(f"_space-{space}_") & F.col("name").rlike(legacy_pattern))
    legacy = legacy.select(
        "path",
        "name",
        F.regexp_extract("name", legacy_pattern, 1).alias("legacy_key"),
        F.regexp_extract("name", legacy_pattern, 2).cast("long").alias("idx"),
        F.regexp_extract("name", legacy_pattern, 3).alias("role"),
    )
    keys = known.select("bundle", "desc", F.explode("legacy_keys").alias("legacy_key"))
    old = lookup(legacy, keys, ["legacy_key"])
    # A name in the bundle's current layout is never read as legacy.
    old = old.filter(~F.contains("name", F.concat(F.lit(marker), F.col("desc"))))
    old = old.select("bundle", "role", F.when(F.col("role").isin("include", "exclude"), F.col("idx")).alias("idx"), "path", "name")
    found = modern.unionByName(old)
    found = found.select(entity(F.col("path"), "sub").alias("subject_id"), entity(F.col("path"), "ses").alias("session_id"), *found.columns)
    numbered = F.col("role").isin("include", "exclude")
    owner = ["subject_id", "session_id", "bundle", "role"]
    single = found.filter(~numbered).groupBy(*owner).agg(F.max_by("path", F.struct("name", "path")).alias("path"))
    return found.filter(numbered).select(*owner, "idx", "path").unionByName(
        single.select(*owner, F.lit(None).cast("long").alias("idx"), "path")
    )


def available_bundles(paths: DataFrame, bundles: DataFrame, space: str) -> DataFrame:
    """Bundles with at least one file in the space: a current-layout prefix on a mask or
    probability file, or a legacy token."""
    names = images(paths).filter(F.col("name").contains(f"_space-{space}_"))
    known = _bundles(bundles)
    marker = f"_space-{space}_desc-"
    current = names.filter(
        F.col("name").contains(marker) & (F.col("name").endswith("_mask.nii.gz") | F.col("name").contains("_probseg"))
    ).select(F.substring_index("name", marker, -1).alias("tail"))
    # A bundle matches when its short name is a prefix of the tail: turn the prefix test
    # into an equi join by listing the tail's prefixes, as many as a file name has letters.
    prefixes = F.transform(F.sequence(F.lit(0), F.length("tail")), lambda n: F.substring(F.col("tail"), F.lit(1), n))
    heads = current.select(F.explode(prefixes).alias("desc")).distinct()
    modern = known.join(heads, "desc", "left_semi").select("bundle")
    words = F.split(F.substring_index("name", "_desc-ROI-", -1), "-")
    heads = F.transform(F.sequence(F.lit(1), F.size(words) - 1), lambda n: F.array_join(F.slice(words, F.lit(1), n), "-"))
    legacy = names.filter(F.col("name").rlike("_desc-ROI-[^-]*-"))
    tokens = legacy.select(F.explode(heads).alias("legacy_key")).distinct()
    old = known.select("bundle", F.explode("legacy_keys").alias("legacy_key")).join(tokens, "legacy_key", "left_semi").select("bundle")
    return modern.unionByName(old).distinct()


def detect_spaces(paths: DataFrame) -> DataFrame:
    """Distinct ``_space-X`` tokens of image names, all occurrences per name."""
    tokens = F.regexp_extract_all("name", F.lit("_space-([^_]*)"), F.lit(1))
    return images(paths).select(F.explode(tokens).alias("space")).filter(F.col("space") != "").distinct()


def pick_space(paths: DataFrame) -> DataFrame:
    """The most frequent space, mask and probability files first, ties to the smaller name."""
    names = images(paths).filter(F.col("name").contains("_space-"))
    first = F.regexp_extract("name", r"_space-([^_]*)(_desc-)?", 1)
    followed = F.regexp_extract("name", r"_space-[^_]*(_desc-)?", 1) != ""
    rows = names.select("name", first.alias("space"), followed.alias("ok")).filter(F.col("ok") & (F.col("space") != ""))
    roi = F.col("name").endswith("_mask.nii.gz") | F.col("name").contains("_probseg")
    counts = rows.groupBy("space").agg(F.count_if(roi).alias("n_roi"), F.count("*").alias("n_any"))
    # Any mask-like file at all makes the mask counts decide.
    ranked = counts.orderBy(
        (F.col("n_roi") > 0).desc(), F.when(F.col("n_roi") > 0, F.col("n_roi")).otherwise(F.col("n_any")).desc(), "space"
    )
    return ranked.limit(1).select("space", "n_roi", "n_any")


# Name endings and words that decide the kind of a file.
ORIENTATION_ENDINGS = (".odx", ".odxd", ".fib.gz", ".fz", ".pam5", ".mif", ".mif.gz")
STREAMLINE_ENDINGS = (".trx", ".trk", ".trk.gz", ".tck", ".vtk", ".tt", ".tt.gz")
MATRIX_ENDINGS = (".dscalar.nii", ".dlabel.nii", ".dtseries.nii", ".pscalar.nii")
SURFACE_ENDINGS = (".gii", ".gifti")
PARCEL_WORDS = ("parcel", "parc", "atlas", "label", "seg", "segmentation")
LABEL_TABLE_ENDINGS = (".txt", ".lut", ".csv", ".tsv")


def _ends(name: Column, endings: tuple[str, ...]) -> Column:
    test = F.lit(False)
    for e in endings:
        test = test | name.endswith(e)
    return test


def _located(paths: DataFrame) -> DataFrame:
    path = F.col("path")
    name = file_name(path)
    return paths.select(
        "path",
        name.alias("name"),
        F.substring(path, F.lit(1), F.length(path) - F.length(name)).alias("dir"),
        F.regexp_replace(name, r"\.[^.]*$", "").alias("stem"),
    )


def guess_label_table(paths: DataFrame) -> DataFrame:
    """(path, label_table): the neighbour ``<stem>.txt/.lut/.csv/.tsv`` tried in that order."""
    rows = _located(paths)
    order = F.lit(None).cast("int")
    for n, e in reversed(list(enumerate(LABEL_TABLE_ENDINGS))):
        order = F.when(F.col("name").endswith(e), F.lit(n)).otherwise(order)
    tables = rows.withColumn("_o", order).filter(F.col("_o").isNotNull())
    tables = tables.groupBy("dir", "stem").agg(F.min_by("path", "_o").alias("label_table"))
    volumes = rows.filter(_ends(F.lower("name"), (".nii", ".nii.gz")))
    return lookup(volumes, tables, ["dir", "stem"], "left").select("path", "label_table")


def classify_assets(paths: DataFrame) -> DataFrame:
    """(path, kind) from name rules."""
    guessed = guess_label_table(paths)
    rows = paths.select("path").join(guessed, "path", "left")
    lower = F.lower(file_name(F.col("path")))
    worded = F.lit(False)
    for w in PARCEL_WORDS:
        worded = worded | lower.contains(w)
    kind = (
        F.when(_ends(lower, ORIENTATION_ENDINGS), "orientation")
        .when(_ends(lower, STREAMLINE_ENDINGS), "streamlines")
        .when(_ends(lower, MATRIX_ENDINGS), "cifti")
        .when(_ends(lower, (".nii", ".nii.gz")) & (F.col("label_table").isNotNull() | worded), "parcellation")
        .when(_ends(lower, (".nii", ".nii.gz")), "volume")
        .when(_ends(lower, SURFACE_ENDINGS), "surface")
        .otherwise("unsupported")
    )
    return rows.select("path", kind.alias("kind"))
