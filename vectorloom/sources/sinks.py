"""Writers: datasets, flat exports, chunked and permuted datasets, run reports."""

from __future__ import annotations

import os
from itertools import groupby
from operator import itemgetter
from uuid import uuid4

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from vectorloom.settings import Settings
from vectorloom.sources.delimited import numbered_features
from vectorloom.tables import cut_lineage, prepare


def write_dataset(matrix: DataFrame, feature_dim: DataFrame | None, path: str,
                  mode: str = "errorifexists") -> None:
    """Preprocessed dataset: Parquet tables ``matrix`` and ``feature_dim``."""
    matrix.write.mode(mode).parquet(f"{path}/matrix")
    if feature_dim is not None:
        feature_dim.write.mode(mode).parquet(f"{path}/feature_dim")


def read_dataset(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """(matrix, feature_dim); a dataset without names gets "0".."F-1"."""
    matrix = spark.read.parquet(f"{path}/matrix")
    if path_exists(spark, f"{path}/feature_dim"):
        return matrix, spark.read.parquet(f"{path}/feature_dim")
    width = matrix.agg(F.max(F.size("features"))).first()[0] or 0
    return matrix, numbered_features(spark, width)


def flat_lines(matrix: DataFrame, sep: str = ",", keep_id: bool = True) -> DataFrame:
    """One text line per row: id, features, class."""
    cells = F.array_join(F.transform("features", lambda v: v.cast("string")), sep)
    parts = [F.col("row_id").cast("string")] if keep_id else []
    return matrix.select("row_pos", F.concat_ws(sep, *parts, cells, "label").alias("value"))


def export_flat(matrix: DataFrame, names: list[str], path: str, sep: str = ",",
                keep_id: bool = True, id_name: str = "id", class_name: str = "class") -> None:
    """Delimited export in row order; the header is the first line of the first file.
    With the id column (default) the reader can load it back."""
    first = [id_name] if keep_id else []
    header = sep.join([*first, *names, class_name])
    spark = matrix.sparkSession
    lines = flat_lines(matrix, sep, keep_id).orderBy("row_pos").select("value")
    spark.createDataFrame([(header,)], "value STRING").coalesce(1).union(lines).write.text(path)


def export_species_matrix(matrix: DataFrame, names: list[str], path: str) -> None:
    """Sample x species export: ``Profiles;...;Class``."""
    export_flat(matrix, names, path, sep=";", id_name="Profiles", class_name="Class")


def chunked_rows(matrix: DataFrame, chunks: DataFrame) -> DataFrame:
    """Rows once per chunk of features (``pos, name, chunk``), projected in column order."""
    lists = chunks.groupBy("chunk").agg(F.array_sort(F.collect_list("pos")).alias("positions"))
    plan = [(r.chunk, ",".join(map(str, r.positions))) for r in lists.orderBy("chunk").collect()]
    text = ";".join(f"{chunk}:{positions}" for chunk, positions in plan)
    chunk_text = F.explode(F.split(F.lit(text), ";"))
    halves = F.split(F.col("_chunk"), ":")
    positions = F.split(F.get(halves, F.lit(1)), ",").cast("array<int>")
    return matrix.withColumn("_chunk", chunk_text).select(
        F.get(halves, F.lit(0)).cast("int").alias("chunk"), "row_id", "row_pos", "label",
        F.transform(positions, lambda p: F.get(F.col("features"), p)).alias("features"),
    )


def write_chunks(matrix: DataFrame, chunks: DataFrame, path: str) -> None:
    """One folder per chunk, all written by one job."""
    chunked_rows(matrix, chunks).write.partitionBy("chunk").parquet(f"{path}/matrix")
    chunks.write.partitionBy("chunk").parquet(f"{path}/feature_dim")


def write_permutations(permuted: DataFrame, path: str) -> None:
    """Label-permuted replicates, one folder each; features are joined when read."""
    permuted.write.partitionBy("replicate").parquet(path)


def with_parameters(table: DataFrame, dataset: str, settings: Settings, **more) -> DataFrame:
    """Run parameters as columns."""
    values = {
        "dataset": dataset, "dimensionality": settings.dimensionality,
        "n_levels": settings.levels, "max_retrain": settings.retrain, "seed": settings.seed, **more,
    }
    return table.withColumns({k: F.lit(v) for k, v in values.items()})


def write_summary(runs: DataFrame, path: str, dataset: str, settings: Settings, rules) -> None:
    """Append the retained runs of an elimination with their parameters."""
    with_parameters(
        runs, dataset, settings, accuracy_threshold=rules.accuracy_threshold,
        tolerance=rules.tolerance,
    ).write.mode("append").parquet(path)


def write_selection(selection: DataFrame, path: str) -> None:
    """Best group size, best accuracy and the selected features by name."""
    selection.orderBy("chunk", "feature").write.mode("append").parquet(path)


def write_run_log(history: DataFrame, path: str, dataset: str, settings: Settings,
                  elapsed: float) -> int:
    """Append one run's history under the next attempt number; returns the number."""
    spark, attempt = history.sparkSession, 0
    if path_exists(spark, path):
        last = spark.read.parquet(path).agg(F.max("attempt").alias("n")).first().n
        attempt = 0 if last is None else last + 1
    with_parameters(history, dataset, settings, elapsed=float(elapsed), attempt=attempt).write.mode(
        "append").parquet(path)
    return attempt


def write_ranking(top: DataFrame, path: str) -> None:
    """Ranked features ``name<TAB>share of seeds`` as text, in rank order."""
    line = F.concat_ws("\t", "feature", F.col("frequency").cast("string"))
    top.select(line.alias("value")).write.text(path)


def selection_lines(spark: SparkSession, group_size: int, accuracy: float,
                    features: list[str]) -> DataFrame:
    """Selection report as text lines: three comment lines, then the features."""
    head = [f"# Best group size: {group_size}", f"# Best accuracy: {accuracy}",
            "# Selected Features:"]
    return spark.createDataFrame([(line,) for line in head + sorted(features)], "value STRING")


def write_named_files(lines: DataFrame, path: str) -> None:
    """Text files from ``file, place, value``: one per name below ``path``, lines by place.
    Where ``path`` is a folder that tasks can open (scheme ``file``), each task writes its own
    files under their names, and a file is there whole or not at all. Elsewhere tasks write them
    under the names' hashes and the driver then gives each its name, one call per file."""
    spark = lines.sparkSession
    place = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    files = place.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    target = files.makeQualified(place).toUri()
    if target.getScheme() == "file":
        _write_in_tasks(lines, target.getPath())
    else:
        _write_and_rename(lines, path)


def _write_in_tasks(lines: DataFrame, folder: str) -> None:
    """Tasks stream their rows, sorted by file, into one open file at a time."""
    spark = lines.sparkSession
    prepare(spark)
    os.makedirs(folder, exist_ok=True)

    def write(batches):
        made, name, file, staged = {folder}, None, None, None

        def finish():
            file.close()
            os.replace(staged, f"{folder}/{name}")

        for batch in batches:
            rows = zip(batch.column("file").to_pylist(), batch.column("value").to_pylist())
            for one, some in groupby(rows, itemgetter(0)):
                if one is None:
                    raise ValueError(f"{folder}: a line without a file name")
                if one != name:
                    if file:
                        finish()
                    name, (inside, _, last) = one, f"{folder}/{one}".rpartition("/")
                    if inside not in made:
                        os.makedirs(inside, exist_ok=True)
                        made.add(inside)
                    staged = f"{inside}/.{last}-{uuid4().hex}"  # a name that readers skip
                    file = open(staged, "w", encoding="utf-8", newline="")
                file.writelines(f"{value or ''}\n" for _, value in some)
            yield pa.RecordBatch.from_arrays([pa.array([batch.num_rows])], names=["n"])
        if file:
            finish()

    # Many small files cost by number, not by bytes, so their tasks are not coalesced by bytes.
    tasks = max(spark.sparkContext.defaultParallelism,
                int(spark.conf.get("spark.sql.shuffle.partitions")))
    placed = lines.repartition(tasks, "file").sortWithinPartitions("file", "place")
    placed.select("file", "value").mapInArrow(write, "n BIGINT").agg(F.sum("n")).collect()


def _write_and_rename(lines: DataFrame, path: str) -> None:
    spark = lines.sparkSession
    staged = f"{path}/_staged-{uuid4().hex}"
    names = cut_lineage(lines.select("file").distinct().withColumn("key", F.md5("file")))
    keyed = lines.withColumn("key", F.md5("file"))
    keyed.repartition("key").sortWithinPartitions("key", "place").select("key", "value") \
        .write.partitionBy("key").text(staged)
    for row in names.toLocalIterator():
        _rename_part(spark, f"{staged}/key={row.key}", f"{path}/{row.file}")
    remove_path(spark, staged)


def _rename_part(spark: SparkSession, folder: str, target: str) -> None:
    """The only part file of ``folder`` becomes ``target``."""
    of = spark.sparkContext._jvm.org.apache.hadoop.fs.Path
    files = of(folder).getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    parts = [f.getPath() for f in files.listStatus(of(folder))
             if f.getPath().getName().startswith("part-")]
    if len(parts) != 1:
        raise ValueError(f"{target}: {len(parts)} part files instead of one")
    files.mkdirs(of(target).getParent())
    if not files.rename(parts[0], of(target)):
        raise OSError(f"cannot write {target}")


def write_selection_tree(selections: DataFrame, path: str) -> None:
    """``seed, run, chunk, feature`` as ``seed<n>/run<n>/chunk_<n>/selection.txt`` files: a
    comment line, then the features by name. A null feature leaves a file without any."""
    file = F.concat(F.lit("seed"), F.col("seed").cast("string"), F.lit("/run"),
                    F.col("run").cast("string"), F.lit("/chunk_"),
                    F.col("chunk").cast("string"), F.lit("/selection.txt"))
    features = selections.where("feature IS NOT NULL").select(
        file.alias("file"), F.concat(F.lit("1"), "feature").alias("place"),
        F.col("feature").alias("value"))
    heads = selections.select(file.alias("file")).distinct().select(
        "file", F.lit("0").alias("place"), F.lit("# Selected Features:").alias("value"))
    write_named_files(heads.union(features), path)


def path_exists(spark: SparkSession, path: str) -> bool:
    hadoop = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return hadoop.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(hadoop)


def remove_path(spark: SparkSession, path: str) -> bool:
    hadoop = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return hadoop.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(hadoop, True)
