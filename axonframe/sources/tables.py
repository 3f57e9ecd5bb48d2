"""Readers and writers of the table forms."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from axonframe.functions.color import label_color
from axonframe.functions.geometry import XYZ
from axonframe.functions.scan import cut_lineage
from axonframe.operators.sets import Tractogram, subset
from axonframe.operators.volumes import normalize_volume

REQUIRED = {
    "points": {"streamline_id", "point_idx", *XYZ},
    "groups": {"streamline_id", "group_name"},
    "dps": {"streamline_id", "field", "value"},
    "voxels": {"i", "j", "k", "value"},
    "parcels": {"i", "j", "k", "label"},
    "vertices": {"vertex_id", *XYZ},
    "triangles": {"tri_id", "v0", "v1", "v2"},
    "matrix": {"map_id", "col", "value"},
    "models": {"col", "structure"},
    "odx_voxels": {"voxel_id", "i", "j", "k"},
    "fixels": {"voxel_id", "fixel_idx", "dx", "dy", "dz"},
}


def check(df: DataFrame, kind: str) -> DataFrame:
    """Schema gate at an operator's entry."""
    missing = REQUIRED[kind] - set(df.columns)
    if missing:
        raise ValueError(f"{kind} table lacks columns {sorted(missing)}")
    return df


def _optional(spark: SparkSession, path: str) -> DataFrame | None:
    hadoop = spark._jvm.org.apache.hadoop.fs.Path(path)
    there = hadoop.getFileSystem(spark._jsc.hadoopConfiguration()).exists(hadoop)
    return spark.read.parquet(path) if there else None


#: Vertices of one block of the offset-array form.
BLOCK = 4096


def cut_offset_arrays(files: DataFrame, width: int = BLOCK) -> tuple[DataFrame, DataFrame]:
    """One row per file (streamline offsets and flat x, y, z and scalar arrays) -> the two tables of
    the offset-array form: ``offsets`` (streamline_id, start, size, width) and ``positions`` (block,
    width and the arrays of ``width`` vertices, the last block of a file with fewer).
    """
    arrays = [c for c in files.columns if c not in {"offsets", "subject_id"}]
    by = [c for c in ("subject_id",) if c in files.columns]
    ranges = F.transform(
        F.sequence(F.lit(1), F.size("offsets") - 1),
        lambda n: F.struct(
            (n - 1).cast("long").alias("streamline_id"),
            F.get("offsets", n - 1).cast("long").alias("start"),
            (F.get("offsets", n) - F.get("offsets", n - 1)).cast("long").alias("size"),
        ),
    )
    fixed = F.lit(width).cast("long").alias("width")
    offsets = files.select(*by, F.inline(F.when(F.size("offsets") > 1, ranges))).select("*", fixed)
    blocks = F.sequence(F.lit(0), F.floor((F.size("x") - 1) / width).cast("int"))
    parts = files.select(*by, *arrays, F.explode(F.when(F.size("x") > 0, blocks)).alias("_block"))
    cut = [F.slice(c, F.col("_block") * width + 1, F.lit(width)).alias(c) for c in arrays]
    return offsets, parts.select(*by, F.col("_block").cast("long").alias("block"), fixed, *cut)


def join_offset_arrays(offsets: DataFrame, positions: DataFrame) -> DataFrame:
    """The offset-array form -> one row per vertex.

    A streamline is dealt to the blocks it crosses, and each block meets the list of its pieces, at
    most as long as the block: no task holds a file, nor a streamline longer than a block. A
    streamline without vertices has no rows; a vertex that no block holds is an error.
    """
    by = [c for c in ("subject_id",) if c in offsets.columns]
    arrays = [c for c in positions.columns if c not in {*by, "block", "width"}]
    last = F.col("start") + F.col("size") - 1
    first_block, last_block = F.floor(F.col("start") / F.col("width")), F.floor(last / F.col("width"))
    pieces = offsets.filter("size > 0").select("*", F.explode(F.sequence(first_block, last_block)).alias("block"))
    piece = F.struct(
        "streamline_id", "start", F.greatest("start", F.col("block") * F.col("width")).alias("first"),
        F.least(last, (F.col("block") + 1) * F.col("width") - 1).alias("last"),
    )
    lists = pieces.groupBy(*by, "block").agg(F.collect_list(piece).alias("_pieces"))
    both = lists.join(positions, [*by, "block"], "left")
    begin = F.col("block") * F.col("width")

    def vertex(p: Column, v: Column) -> Column:
        values = [F.get(c, (v - begin).cast("int")).cast("double").alias(c) for c in arrays]
        return F.struct(p["streamline_id"].alias("streamline_id"), (v - p["start"]).cast("int").alias("point_idx"), *values)

    rows = F.flatten(F.transform("_pieces", lambda p: F.transform(F.sequence(p["first"], p["last"]), lambda v: vertex(p, v))))
    short = F.col("width").isNull() | (F.array_max(F.transform("_pieces", lambda p: p["last"])) - begin >= F.size("x"))
    lacking = F.raise_error(F.concat(F.lit("offsets point past the positions at block "), F.col("block"))).cast(both.select(rows).schema[0].dataType)
    return both.select(*by, F.inline(F.when(short, lacking).otherwise(rows)))


def read_tractogram(spark: SparkSession, path: str) -> Tractogram:
    """``<path>/points``, or ``<path>/offsets`` and ``<path>/positions`` in the offset-array form,
    with optional ``groups`` and ``dps``; all are Parquet tables."""
    points = _optional(spark, f"{path}/points")
    if points is None:
        points = join_offset_arrays(spark.read.parquet(f"{path}/offsets"), spark.read.parquet(f"{path}/positions"))
    return Tractogram(check(points, "points"), _optional(spark, f"{path}/groups"), _optional(spark, f"{path}/dps"))


def write_tractogram(data: Tractogram, sel: DataFrame | None, path: str) -> None:
    """Save the selected streamlines, renumbered, with their groups; empty groups vanish.

    Scalars are not written. Files are partitioned by subject when there is one.
    """
    if not path:
        raise ValueError("an output path is required")
    chosen = data if sel is None else subset(Tractogram(data.points, data.groups), sel)
    for name, table in (("points", chosen.points), ("groups", chosen.groups)):
        if table is None:
            continue
        writer = table.write.mode("overwrite")
        if "subject_id" in table.columns:
            writer = writer.partitionBy("subject_id")
        writer.parquet(f"{path}/{name}")


def read_volume(spark: SparkSession, path: str, normalize: bool = False) -> DataFrame:
    voxels = check(spark.read.parquet(path), "voxels")
    return normalize_volume(voxels) if normalize else voxels


def read_surface(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    return (
        check(spark.read.parquet(f"{path}/vertices"), "vertices"),
        check(spark.read.parquet(f"{path}/triangles"), "triangles"),
    )


def clean_parcels(parcels: DataFrame) -> DataFrame:
    """Negative labels become 0."""
    return parcels.withColumn("label", F.greatest(F.col("label"), F.lit(0)).cast("int"))


def complete_labels(parcels: DataFrame, labels: DataFrame | None = None) -> DataFrame:
    """The label table of the labels in use, "Label n" where a name is missing."""
    from axonframe.operators.sampling import join_labels

    used = clean_parcels(parcels).select("label").filter(F.col("label") != 0).distinct()
    if labels is None:
        labels = used.limit(0).withColumn("name", F.lit(None).cast("string"))
    return join_labels(used, labels)


def read_parcellation(spark: SparkSession, path: str, labels: DataFrame | None = None) -> tuple[DataFrame, DataFrame]:
    parcels = clean_parcels(check(spark.read.parquet(path), "parcels"))
    return parcels, complete_labels(parcels, labels)


def parse_label_lines(lines: DataFrame, text: str = "value", order: str = "line_no") -> DataFrame:
    """Label-table lines (comma or blank separated, ``#`` comments, optional 0-255 colours)
    -> file, label, name, r, g, b, a. The last line of an id wins."""
    by = [c for c in ("file",) if c in lines.columns]
    rows = lines.select(*by, order, F.trim(text).alias("_t")).filter((F.col("_t") != "") & ~F.col("_t").startswith("#"))

    def number(c: Column, top: int) -> Column:
        ok = c.rlike("^[+]?[0-9]{1,10}$")
        value = F.when(ok, F.regexp_replace(c, "^[+]", "")).cast("long")
        return F.when(value <= top, value)

    comma = F.transform(F.split("_t", ","), lambda p: F.trim(p))
    blank = F.split("_t", r"\s+")
    # Generators, since projections would be merged and filters pushed below them: each part that is
    # looked at would split its line again.
    parts = F.explode_outer(F.array(F.struct(comma.alias("_c"), blank.alias("_b")))).alias("_s")
    rows = rows.select(*by, order, parts).select(*by, order, "_s.*")
    n, m = F.size("_c"), F.size("_b")
    byte = {k: number(F.get("_c", F.lit(k)), 255) for k in range(2, 6)}
    colored = n >= 6
    comma_ok = (n >= 2) & number(F.get("_c", F.lit(0)), 2**32 - 1).isNotNull()
    comma_ok = comma_ok & (~colored | F.greatest(*[v.isNull().cast("int") for v in byte.values()]).__eq__(0))
    comma_row = F.struct(
        number(F.get("_c", F.lit(0)), 2**32 - 1).alias("label"),
        F.regexp_replace(F.get("_c", F.lit(1)), '^"+|"+$', "").alias("name"),
        *[F.when(colored, byte[k] / 255.0).alias(c) for k, c in zip(range(2, 6), "rgba")],
    )

    def last(k: int) -> Column:
        return number(F.get("_b", m - k), 255)

    three = (m >= 5) & last(3).isNotNull() & last(2).isNotNull() & last(1).isNotNull()
    four = (m >= 6) & last(4).isNotNull() & last(3).isNotNull() & last(2).isNotNull() & last(1).isNotNull()

    def words(tail: int) -> Column:
        return F.array_join(F.slice("_b", F.lit(2), F.greatest(m - 1 - tail, F.lit(0))), " ")

    blank_ok = (m >= 2) & number(F.get("_b", F.lit(0)), 2**32 - 1).isNotNull()

    def blank_row(tail: int, *rgba: Column) -> Column:
        return F.struct(
            number(F.get("_b", F.lit(0)), 2**32 - 1).alias("label"),
            words(tail).alias("name"),
            *[v.cast("double").alias(c) for v, c in zip(rgba, "rgba")],
        )

    none = F.lit(None).cast("double")
    # Three trailing bytes are tried before four.
    parsed = (
        F.when(comma_ok, comma_row)
        .when(blank_ok & three, blank_row(3, last(3) / 255.0, last(2) / 255.0, last(1) / 255.0, F.lit(1.0)))
        .when(blank_ok & four, blank_row(4, last(4) / 255.0, last(3) / 255.0, last(2) / 255.0, last(1) / 255.0))
        .when(blank_ok, blank_row(0, none, none, none, none))
    )
    rows = rows.select(*by, order, F.explode_outer(F.array(parsed)).alias("_p")).filter(F.col("_p").isNotNull())
    own = rows.select(*by, order, "_p.*")
    made = label_color(F.col("label"))
    own = own.withColumns({c: F.coalesce(F.col(c), made[c]) for c in "rgb"} | {"a": F.coalesce(F.col("a"), F.lit(0.95))})
    latest = own.groupBy(*by, "label").agg(F.max_by(F.struct("name", *"rgba"), order).alias("_l"))
    return latest.select(*by, "label", "_l.*")


def read_label_tables(spark: SparkSession, path: str) -> DataFrame:
    """Many label-table text files as one table keyed by file; a file without any label is an error.

    Files are read line by line in splits. A line's order is that of its split in the file, then of
    reading; both ends of a split are Spark's, so a large file is read by many tasks.
    """
    file = F.col("_metadata.file_path").alias("file")
    text = F.regexp_replace("value", r"\r$", "").alias("value")
    place = F.struct(F.col("_metadata.file_block_start").alias("split"), F.monotonically_increasing_id().alias("row"))
    raw = spark.read.option("lineSep", "\n").text(path)
    lines = raw.select(file, place.alias("line_no"), text)
    # Written, so that the check below does not read the files again.
    labels = cut_lineage(parse_label_lines(lines))
    # The names that Spark listed, empty files too; both forms of a local name are one.
    plain = F.regexp_replace("file", "^file:/+", "file:/")
    listed = spark.createDataFrame([(name,) for name in raw.inputFiles()], "file string").select(plain.alias("file"))
    known = labels.groupBy(plain.alias("file")).agg(F.count("*").alias("_n"))
    failed = F.raise_error(F.concat(F.lit("no label could be read from "), F.col("file"))).cast("boolean")
    # Never true, so no row is added: the filter stops the query at the first such file.
    bare = listed.join(known, "file", "left").filter(F.when(F.col("_n").isNull(), failed).otherwise(F.lit(False)))
    return labels.unionByName(bare.select("file", *[F.lit(None).cast(f.dataType).alias(f.name) for f in labels.schema[1:]]))


def read_cifti_tables(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    return (
        check(spark.read.parquet(f"{path}/matrix"), "matrix"),
        check(spark.read.parquet(f"{path}/models"), "models"),
    )


def read_orientation(spark: SparkSession, path: str) -> dict[str, DataFrame | None]:
    """Voxels, fixels and, when present, ODF and SH rows."""
    return {
        "voxels": check(spark.read.parquet(f"{path}/voxels"), "odx_voxels"),
        "fixels": check(spark.read.parquet(f"{path}/fixels"), "fixels"),
        "odf": _optional(spark, f"{path}/odf"),
        "sh": _optional(spark, f"{path}/sh"),
    }


def scalar_catalog(table: DataFrame) -> list[str]:
    """Names of the scalar columns of a voxel or fixel table."""
    fixed = {"subject_id", "voxel_id", "fixel_idx", "i", "j", "k", "dx", "dy", "dz"}
    return [c for c in table.columns if c not in fixed]
