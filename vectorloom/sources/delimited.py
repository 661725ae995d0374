"""Labelled delimited text: id, features..., class. Lines of any width are read as one
string and split into an array; there is never one Spark column per feature."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame, Observation, SparkSession, Window
from pyspark.sql import functions as F

from vectorloom.operators.matrix import fill_missing
from vectorloom.tables import written

_BLANKS = " \t\r\n"
# One row of about 200 bytes per input split; beyond this the rows are joined by shuffle.
BROADCAST_SPLITS = 500_000


def data_lines(lines: DataFrame) -> DataFrame:
    """Trimmed lines that are neither blank nor comments."""
    return lines.withColumn("value", F.trim(F.col("value"), F.lit(_BLANKS))).filter(
        (F.col("value") != "") & ~F.col("value").startswith("#")
    )


def number(text: Column, missing: str | None = None) -> Column:
    """Text to DOUBLE; NULL for the missing marker and for anything that is no number
    (a trailing type letter as in ``1.0d`` is none)."""
    cell = F.trim(text, F.lit(_BLANKS))
    bad = cell.rlike(r"^[+-]?[0-9.].*[dDfF]$")
    if missing is not None:
        bad = bad | (cell == F.lit(missing))
    return F.when(~bad, cell.try_cast("double"))


def parse_labelled(lines: DataFrame, sep: str = ",", missing: str | None = None,
                   fill: float | None = None, kept_text: bool = False) -> DataFrame:
    """``row_id, label, features`` (and any other columns) from raw lines in ``value``; with
    ``kept_text`` also the cells as they were written, ``_text``."""
    parts = F.split(F.col("value"), re.escape(sep), -1)
    split = data_lines(lines).withColumn("_parts", parts)
    cells = F.slice("_parts", F.lit(2), F.greatest(F.size("_parts") - 2, F.lit(0)))
    features = F.transform(cells, lambda c: number(c, missing))
    return split.select(
        F.element_at("_parts", 1).alias("row_id"),
        F.element_at("_parts", -1).alias("label"),
        fill_missing(features, fill).alias("features"),
        *([cells.alias("_text")] if kept_text else []), *[c for c in lines.columns if c != "value"],
    )


def header_names(header: str, sep: str = ",") -> list[str]:
    """Feature names: the header without its first and last column."""
    return [name.strip() for name in header.split(sep)[1:-1]]


def feature_table(spark: SparkSession, names: list[str]) -> DataFrame:
    """``pos, name``."""
    return spark.createDataFrame(list(enumerate(names)), "pos INT, name STRING")


def numbered_features(spark: SparkSession, n_features: int) -> DataFrame:
    """Names "0".."n-1" for a matrix stored without names."""
    ids = spark.range(n_features)
    return ids.select(F.col("id").cast("int").alias("pos"), F.col("id").cast("string").alias("name"))


def positioned_lines(spark: SparkSession, path: str) -> DataFrame:
    """Lines with the file and split they come from, for ``with_row_pos``."""
    lines = spark.read.text(path)
    return lines.select(
        "value",
        F.col("_metadata.file_path").alias("_file"),
        F.col("_metadata.file_block_start").alias("_block"),
    )


def with_row_pos(parsed: DataFrame) -> DataFrame:
    """Dense 0-based ``row_pos`` in file order.

    Rows of one file split stay together and in order, so their numbers inside a
    split follow from a running id; only one small row per split is sorted to
    find where each split starts. The rows are written out first, which fixes
    the ids even if executors are lost or splits are planned anew.
    """
    staged = written(parsed.withColumn("_id", F.monotonically_increasing_id()))
    blocks = staged.groupBy("_file", "_block").agg(
        F.min("_id").alias("_first"), F.count(F.lit(1)).alias("_n")
    )
    before = Window.orderBy("_file", "_block").rowsBetween(Window.unboundedPreceding, -1)
    starts = blocks.select(
        "_file", "_block",
        (F.coalesce(F.sum("_n").over(before), F.lit(0)) - F.col("_first")).alias("_shift"),
    )
    few = blocks.count() <= BROADCAST_SPLITS
    numbered = staged.join(F.broadcast(starts) if few else starts, ["_file", "_block"])
    return numbered.withColumn(
        "row_pos", F.col("_id") + F.col("_shift")
    ).drop("_file", "_block", "_id", "_shift")


def header_line(lines: DataFrame):
    """The first line of the first file by name (``value, _file``), None if there is none;
    ``lines`` as from ``positioned_lines``."""
    placed = lines.filter("_block = 0").withColumn("_id", F.monotonically_increasing_id())
    first = F.min(F.struct("_file", "_id", "value")).alias("head")
    return placed.agg(first).first().head


def is_header(head):
    """Whether a positioned line is the header; equal lines elsewhere are data."""
    return ((F.col("_file") == F.lit(head["_file"])) & (F.col("_block") == 0)
            & (F.col("value") == F.lit(head["value"])))


def read_labelled(spark: SparkSession, path: str, sep: str = ",", missing: str | None = None,
                  fill: float | None = None) -> tuple[DataFrame, DataFrame]:
    """(matrix, feature_dim) of a labelled text file; the first line is the header."""
    lines = positioned_lines(spark, path)
    head = header_line(lines)
    if head is None:
        raise ValueError(f"{path} is empty")
    rows = lines.filter(~is_header(head))
    matrix = with_row_pos(parse_labelled(rows, sep, missing, fill))
    ordered = matrix.select("row_id", "row_pos", "label", "features")
    return ordered, feature_table(spark, header_names(head["value"], sep))


def read_feature_list(spark: SparkSession, path: str) -> DataFrame:
    """One feature name per line, blank lines dropped: ``name``."""
    lines = spark.read.text(path).select(F.trim(F.col("value"), F.lit(_BLANKS)).alias("name"))
    return lines.filter("name <> ''")


def read_selections(spark: SparkSession, path: str) -> DataFrame:
    """Previously selected features below a folder: ``name`` from every
    ``selection.txt``, comments skipped."""
    lines = (
        spark.read.option("recursiveFileLookup", True)
        .option("pathGlobFilter", "selection.txt").text(path)
    )
    return data_lines(lines).select(F.col("value").alias("name")).distinct()


def read_selection_tree(spark: SparkSession, path: str) -> DataFrame:
    """``seed, run, chunk, feature`` from ``<seed>/run<n>/chunk_<n>/selection.txt`` below a
    folder. ``seed`` is the folder's name, run and chunk are numbers; all three come from the
    files' paths. A file without features gives one row with a null feature, so that its seed
    and run still count."""
    files = (
        spark.read.format("binaryFile").option("recursiveFileLookup", True)
        .option("pathGlobFilter", "selection.txt").load(path)
    )
    parts = r"/([^/]+)/run(\d+)/chunk_(\d+)/selection\.txt$"
    lines = F.transform(F.split(F.col("content").cast("string"), "\n"),
                        lambda x: F.trim(x, F.lit(_BLANKS)))
    names = F.filter(lines, lambda x: (x != "") & ~x.startswith("#"))
    return files.filter(F.col("path").rlike(parts)).select(
        F.regexp_extract("path", parts, 1).alias("seed"),
        F.regexp_extract("path", parts, 2).cast("int").alias("run"),
        F.regexp_extract("path", parts, 3).cast("int").alias("chunk"),
        F.explode_outer(names).alias("feature"))


def read_labelled_checked(spark: SparkSession, path: str, sep: str = ",",
                          missing: str | None = None, fill: float | None = None):
    """(matrix, feature_dim, counts) like ``read_labelled``; ``counts`` says what the reader met:
    rows, cells marked missing, cells that are no number, and rows whose number of features is
    not the header's (``rejected``, they are left out). They are observed while the rows are
    written, at no extra pass."""
    lines = positioned_lines(spark, path)
    head = header_line(lines)
    if head is None:
        raise ValueError(f"{path} is empty")
    names = header_names(head["value"], sep)
    rows = parse_labelled(lines.filter(~is_header(head)), sep, missing, None, kept_text=True)
    marked = F.filter("_text", lambda c: F.lit(False) if missing is None else
                      F.trim(c, F.lit(_BLANKS)) == F.lit(missing))
    unread = F.filter("features", lambda v: v.isNull())
    fits = F.size("features") == len(names)
    seen = Observation("labelled rows")
    observed = rows.observe(
        seen, F.count(F.lit(1)).alias("rows"),
        F.coalesce(F.sum(F.size(marked)), F.lit(0)).alias("missing"),
        F.coalesce(F.sum(F.size(unread) - F.size(marked)), F.lit(0)).alias("bad_numbers"),
        F.count_if(~fits).alias("rejected"))
    kept = observed.filter(fits).withColumn("features", fill_missing("features", fill))
    matrix = with_row_pos(kept.drop("_text"))
    ordered = matrix.select("row_id", "row_pos", "label", "features")
    return ordered, feature_table(spark, names), seen.get
