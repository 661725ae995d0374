"""Operators on the labelled matrix: ``row_id, row_pos, label, features ARRAY<DOUBLE>``."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from vectorloom.tables import attach_small


def int_array(values) -> Column:
    """A constant INT array; folded once, whatever its length."""
    return F.split(F.lit(",".join(str(int(v)) for v in values)), ",").cast("array<int>")


def project_features(matrix: DataFrame, positions) -> DataFrame:
    """Keep the features at the given 0-based positions, in column order."""
    wanted = sorted({int(p) for p in positions})
    if not wanted:
        raise ValueError("no feature left to project")
    gathered = F.transform(int_array(wanted), lambda i: F.get(F.col("features"), i))
    return matrix.withColumn("features", gathered)


def recognise_features(feature_dim: DataFrame, requested: DataFrame):
    """(recognised, unrecognised): requested names that are, or are not, columns."""
    asked = requested.select("name").distinct()
    recognised = feature_dim.join(asked, "name", "left_semi")
    unrecognised = asked.join(feature_dim, "name", "left_anti")
    return recognised, unrecognised


def restrict_features(feature_dim: DataFrame, selected: DataFrame | None) -> DataFrame:
    """Features selected before; everything when nothing was selected."""
    if selected is None or selected.isEmpty():
        return feature_dim
    return feature_dim.join(selected.select("name").distinct(), "name", "left_semi")


def renumber(feature_dim: DataFrame) -> DataFrame:
    """Positions 0..n-1 in column order after a restriction (feature table only)."""
    return feature_dim.select(
        (F.row_number().over(Window.orderBy("pos")) - 1).cast("int").alias("pos"), "name"
    )


def fill_missing(features, fill: float | None = 0.0) -> Column:
    """Replace missing cells; ``fill=None`` leaves them for validation to reject."""
    features = F.col(features) if isinstance(features, str) else features
    if fill is None:
        return features
    return F.transform(features, lambda v: F.when(v.isNull() | F.isnan(v), F.lit(float(fill)))
                       .otherwise(v))


def has_missing(features: Column) -> Column:
    """A null or NaN among the cells; NaN is the greatest value there is."""
    return F.isnan(F.array_max(features)) | F.exists(features, lambda v: v.isNull())


def well_formed(n_features: int) -> Column:
    """Row has a label, the right number of features and no missing cell."""
    return (
        F.col("label").isNotNull()
        & (F.size("features") == n_features)
        & ~F.exists("features", lambda v: v.isNull() | F.isnan(v))
    )


def validate_matrix(matrix: DataFrame, n_features: int):
    """(accepted rows, rejected rows)."""
    good = F.coalesce(well_formed(n_features), F.lit(False))
    return matrix.filter(good), matrix.filter(~good)


def class_membership(matrix: DataFrame) -> DataFrame:
    """``label, row_id, n_members``: members stay rows, so no class becomes one array."""
    totals = matrix.groupBy("label").agg(F.count(F.lit(1)).alias("n_members"))
    return attach_small(matrix.select("label", "row_id"), totals, "label")


def shape_report(matrix: DataFrame) -> DataFrame:
    """One row: number of features, rows and classes."""
    per_class = matrix.groupBy("label").agg(
        F.count(F.lit(1)).alias("n"), F.max(F.size("features")).alias("width")
    )
    return per_class.agg(
        F.max("width").alias("n_features"),
        F.sum("n").alias("n_rows"),
        F.count(F.lit(1)).alias("n_classes"),
    )


def long_cells(matrix: DataFrame, *keep: str) -> DataFrame:
    """Long layout ``keep..., pos, value``."""
    return matrix.select(*keep, F.posexplode("features").alias("pos", "value"))


def cells_to_matrix(cells: DataFrame, key: str = "row_id", n_features: int | None = None,
                    fill: float | None = None) -> DataFrame:
    """Long layout back to one feature array per row, every value at its position.

    A group holds one row's cells, so its size is the feature count (by default the greatest
    position there is). A position without a cell gets ``fill``; null is a missing cell, which
    ``validate_matrix`` reports and training refuses. Of repeated cells the least stays.
    """
    if n_features is None:
        n_features = (cells.agg(F.max("pos")).first()[0] or 0) + 1
    packed = cells.groupBy(key).agg(
        F.array_sort(F.collect_list(F.struct("pos", "value"))).alias("cells")
    )
    gap = F.lit(fill).cast("double")

    def placed(c: Column, i: Column) -> Column:
        before = F.when(i == 0, F.lit(-1)).otherwise(F.get("cells", i - 1)["pos"])
        return F.when(c["pos"] > before, F.concat(
            F.array_repeat(gap, (c["pos"] - before - 1).cast("int")), F.array(c["value"]))
        ).otherwise(F.array().cast("array<double>"))

    rest = F.array_repeat(gap, (F.lit(n_features - 1) - F.element_at("cells", -1)["pos"]).cast("int"))
    return packed.select(key, F.concat(
        F.flatten(F.transform("cells", placed)), rest).alias("features"))
