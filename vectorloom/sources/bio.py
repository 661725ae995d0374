"""Readers for per-sample interval files, their metadata and taxa profiles."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from vectorloom.operators.matrix import cells_to_matrix
from vectorloom.operators.permute import ordered_rank
from vectorloom.sources.delimited import (
    header_line,
    is_header,
    number,
    positioned_lines,
    with_row_pos,
)
from vectorloom.tables import attach_small, cut_lineage

# 0-based columns of the tab-separated inputs.
BED_FEATURE_COLUMN = 4
BED_VALUE_COLUMN = 5
SAMPLE_COLUMN = 1
CLASS_COLUMN = 5
# Metadata keys for the class and the platform of a sample.
TISSUE_KEY = "manually_curated__tissue_status"
PLATFORM_KEY = "gdc__platform"


def sample_of(file_name: Column) -> Column:
    """Sample id: file name without its ``.bed`` or ``.bed.meta`` ending, up to the last
    ``-`` part; dots inside the id stay."""
    stem = F.regexp_replace(file_name, r"\.bed(\.meta)?$", "")
    return F.regexp_replace(stem, r"-[^-]*$", "")


def read_bed_cells(spark: SparkSession, path: str) -> DataFrame:
    """``sample, pos, feature, value`` from one BED file per sample; blank values are 0.

    Positions follow line order inside a sample, kept by file split and running id.
    """
    lines = (
        spark.read.option("recursiveFileLookup", True).option("pathGlobFilter", "*.bed").text(path)
        .select("value", F.col("_metadata.file_name").alias("file"),
                F.col("_metadata.file_block_start").alias("block"))
        .filter(F.trim(F.col("value")) != "")
    )
    return parse_bed(lines.withColumn("line", F.monotonically_increasing_id()))


def parse_bed(lines: DataFrame, *carry: str) -> DataFrame:
    """``sample, block, line, feature, value`` (and columns to carry) from ``value, file, block,
    line``."""
    parts = F.split(F.col("value"), "\t", -1)
    text = F.get(parts, F.lit(BED_VALUE_COLUMN))
    return lines.select(
        sample_of(F.col("file")).alias("sample"), "block", "line",
        F.trim(F.get(parts, F.lit(BED_FEATURE_COLUMN))).alias("feature"),
        F.when(F.trim(text) == "", F.lit(0.0)).otherwise(number(text)).alias("value"), *carry,
    )


def bed_matrix(cells: DataFrame) -> DataFrame:
    """``sample, features``: one array per sample in line order (a group is one file)."""
    packed = cells.groupBy("sample").agg(
        F.array_sort(F.collect_list(F.struct("block", "line", "value"))).alias("cells")
    )
    return packed.select(
        "sample", F.transform("cells", lambda c: c["value"]).alias("features")
    )


def bed_feature_names(cells: DataFrame) -> DataFrame:
    """Names in the order of the first sample's file: ``pos, name``."""
    first = cells.agg(F.min("sample").alias("s")).first().s
    names = cells.filter(F.col("sample") == F.lit(first)).agg(
        F.array_sort(F.collect_list(F.struct("block", "line", "feature"))).alias("cells")
    )
    return names.select(F.posexplode(F.transform("cells", lambda c: c["feature"])).alias("pos", "name"))


def read_metadata(spark: SparkSession, path: str) -> DataFrame:
    """``sample, label, platform`` from one key/value file per sample."""
    lines = (
        spark.read.option("recursiveFileLookup", True)
        .option("pathGlobFilter", "*.bed.meta").text(path)
        .select("value", sample_of(F.col("_metadata.file_name")).alias("sample"))
    )
    return pivot_metadata(lines, {TISSUE_KEY: "label", PLATFORM_KEY: "platform"})


def read_bed_files(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(cells, names, files) of a folder of BED files, one per sample.

    ``cells``: ``sample, pos, value`` of the files whose features are those of the first sample
    by name, in the same order; ``names``: ``pos, name``; ``files``: ``sample, n_features,
    accepted``, a row per file. Positions are line numbers inside a file, whatever splits it
    was read in. A file is compared by the number of its lines and a sum of hashes of (line
    number, feature), so no file is gathered in one place."""
    lines = (
        spark.read.option("recursiveFileLookup", True).option("pathGlobFilter", "*.bed").text(path)
        .select("value", F.col("_metadata.file_path").alias("_file"),
                F.col("_metadata.file_block_start").alias("_block"),
                F.col("_metadata.file_name").alias("file"))
        .filter(F.trim(F.col("value")) != "")
    )
    placed = with_row_pos(parse_bed(
        lines.withColumn("block", F.col("_block")).withColumn("line", F.lit(0)), "_file", "_block"))
    first = placed.groupBy(F.col("sample").alias("f_sample")).agg(F.min("row_pos").alias("first"))
    cells = attach_small(placed, first, F.col("sample") == F.col("f_sample")).select(
        "sample", (F.col("row_pos") - F.col("first")).cast("int").alias("pos"), "feature", "value")
    mark = F.sum(F.xxhash64("pos", "feature").cast("decimal(38,0)")).alias("mark")
    files = cut_lineage(cells.groupBy("sample").agg(
        F.count(F.lit(1)).cast("int").alias("n_features"), mark))
    model = files.orderBy("sample").first()
    if model is None:
        raise ValueError(f"no lines in the BED files of {path}")
    same = (F.col("n_features") == model.n_features) & (F.col("mark") == F.lit(model.mark))
    files = files.select("sample", "n_features", same.alias("accepted"))
    good = files.where("accepted").select(F.col("sample").alias("a_sample"))
    kept = attach_small(cells, good, F.col("sample") == F.col("a_sample"), "left_semi")
    names = cells.where(F.col("sample") == F.lit(model.sample)).select(
        "pos", F.col("feature").alias("name"))
    return kept.select("sample", "pos", "value"), names, files


def bed_dataset(spark: SparkSession, bed_path: str, metadata_path: str,
                platform: str | None = None) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(matrix, names, files): BED files joined with the metadata files of the same samples, by
    names derived from the files' own. Only labelled samples (of one platform if given) with
    the common features enter the matrix (``sample, label, features``); ``files`` says of every
    BED file its ``n_features``, ``label``, ``platform`` and whether it was ``accepted``."""
    cells, names, files = read_bed_files(spark, bed_path)
    metadata = cut_lineage(read_metadata(spark, metadata_path))
    wanted = select_samples(metadata, platform).select(F.col("sample").alias("w_sample"), "label")
    width = names.count()
    rows = cells_to_matrix(cells, "sample", width)
    matrix = rows.join(wanted, F.col("sample") == F.col("w_sample")).select(
        "sample", "label", "features")
    of_file = metadata.withColumnRenamed("sample", "m_sample")
    told = files.join(of_file, F.col("sample") == F.col("m_sample"), "left").drop("m_sample")
    fits = F.col("label").isNotNull()
    if platform is not None:
        fits = fits & F.coalesce(F.col("platform") == F.lit(platform), F.lit(False))
    return matrix, names, told.withColumn("accepted", F.col("accepted") & fits)


def pivot_metadata(lines: DataFrame, keys: dict[str, str]) -> DataFrame:
    """One row per sample with the values of the wanted keys, from ``sample, value``
    lines ``key<TAB>value``. Plain conditional aggregates, combined map-side."""
    parts = F.split(F.col("value"), "\t", -1)
    pairs = lines.select("sample", F.trim(F.get(parts, F.lit(0))).alias("key"),
                         F.trim(F.get(parts, F.lit(1))).alias("text"))
    wanted = pairs.filter(F.col("key").isin(list(keys)))
    return wanted.groupBy("sample").agg(*[
        F.min(F.when(F.col("key") == key, F.col("text"))).alias(name)
        for key, name in keys.items()
    ])


def select_samples(metadata: DataFrame, platform: str | None = None) -> DataFrame:
    """Labelled samples, of one platform when given."""
    wanted = metadata.filter(F.col("label").isNotNull())
    return wanted if platform is None else wanted.filter(F.col("platform") == F.lit(platform))


def labelled_samples(features: DataFrame, metadata: DataFrame) -> DataFrame:
    """Samples with both features and a label."""
    return features.join(metadata.select("sample", "label"), "sample")


def unmatched_samples(features: DataFrame, metadata: DataFrame) -> DataFrame:
    """Samples without a label row."""
    return features.select("sample").join(metadata, "sample", "left_anti")


def parse_profile(lines: DataFrame, header: str) -> DataFrame:
    """``lineage, sample, value`` from taxa rows (tab-separated, samples in the header)."""
    samples = F.split(F.lit(header), "\t", -1)
    parts = F.split(F.col("value"), "\t", -1)
    rows = lines.filter(F.col("value") != F.lit(header)).select(
        F.trim(F.get(parts, F.lit(0))).alias("lineage"),
        F.posexplode(F.slice(parts, F.lit(2), F.size(parts) - 1)).alias("at", "text"),
    )
    return rows.select("lineage", F.trim(F.get(samples, F.col("at") + 1)).alias("sample"),
                       number(F.col("text")).alias("value"))


def at_rank(profile: DataFrame, rank: str = "s__") -> DataFrame:
    """Rows whose last lineage part has the given rank; that part as ``taxon``."""
    taxon = F.element_at(F.split(F.col("lineage"), r"\|"), -1)
    return profile.withColumn("taxon", taxon).filter(F.col("taxon").startswith(rank))


def read_profile(spark: SparkSession, path: str) -> DataFrame:
    """Profile file or folder; the header is the first line of the first file by name."""
    lines = positioned_lines(spark, path)
    head = header_line(lines)
    if head is None:
        raise ValueError(f"{path} is empty")
    return parse_profile(lines.filter(~is_header(head)).select("value"), head["value"])


def profile_matrix(profile: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Transpose taxa x samples: (``row_id, features``, ``pos, name``), taxa by name.

    Long form and one grouping per sample; no column per sample or taxon. Taxa are numbered
    in ranges. A sample without a value for a taxon has a missing (null) cell there.
    """
    ranked = ordered_rank(profile.select("taxon").distinct(), ["taxon"], "_rank")
    names = cut_lineage(ranked.select((F.col("_rank") - 1).cast("int").alias("pos"),
                                      F.col("taxon").alias("name")))
    numbers = names.select("pos", F.col("name").alias("taxon"))
    cells = attach_small(profile, numbers, "taxon").select(
        F.col("sample").alias("row_id"), "pos", "value")
    return cells_to_matrix(cells, n_features=names.count()), names


def read_sample_classes(spark: SparkSession, path: str) -> DataFrame:
    """``sample, label`` from a tab-separated table (columns 1 and 5)."""
    return parse_sample_classes(spark.read.text(path))


def parse_sample_classes(lines: DataFrame) -> DataFrame:
    parts = F.split(F.col("value"), "\t", -1)
    return lines.select(
        F.trim(F.get(parts, F.lit(SAMPLE_COLUMN))).alias("sample"),
        F.trim(F.get(parts, F.lit(CLASS_COLUMN))).alias("label"),
    ).filter("sample is not null and label is not null")
