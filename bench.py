"""Headline queries on BENCH_SF_DIR with local[BENCH_CPUS]; prints one JSON line."""

from __future__ import annotations

import json
import os
import sys
import time
from pathlib import Path

from pyspark.sql import SparkSession
from pyspark.sql import functions as F

sys.path.insert(0, str(Path(__file__).resolve().parent))

from vectorloom import HDClassifier, cross_validate, feature_importance, holdout  # noqa: E402
from vectorloom.item_memory import load_item_memory  # noqa: E402
from vectorloom.operators import encode, splits  # noqa: E402
from vectorloom.plans import catalogue as c  # noqa: E402
from vectorloom.plans.replicates import permutation_accuracy  # noqa: E402
from vectorloom.plans.selection import (  # noqa: E402
    Elimination,
    backward_elimination,
    leave_one_out_accuracy,
)
from vectorloom.settings import Settings  # noqa: E402
from vectorloom.tables import spread  # noqa: E402

FULL = Settings(dimensionality=10000, levels=100)
TEXT = Settings(dimensionality=2000, levels=32)


def run(df) -> None:
    df.write.format("noop").mode("overwrite").save()


def encode_line_items(spark, d):
    """Every line item encoded at D = 10000; all vectors reach the sink."""
    memory = load_item_memory(spark, 10000, 100, 0)
    with spread(c.line_items(spark, d), "row_id") as rows:
        lo, hi = encode.edge_values(rows, 100)
        run(encode.encode_rows(rows, memory, lo, hi, form="packed"))


def encode_embeddings(spark, d):
    memory = load_item_memory(spark, 10000, 100, 0)
    with spread(c.embeddings(spark, d), "row_id") as rows:
        lo, hi = encode.edge_values(rows, 100)
        run(encode.encode_rows(rows, memory, lo, hi, form="packed"))


def fit_line_items(spark, d):
    with spread(c.line_items(spark, d), "row_id") as rows:
        HDClassifier(dimensionality=10000, levels=100).fit(rows).class_vectors(spark).collect()


def holdout_line_items(spark, d):
    holdout(c.line_items(spark, d), 80, FULL).history.collect()


def retrain_line_items(spark, d):
    settings = Settings(10000, 100, retrain=3, retrain_mode="batch")
    holdout(c.line_items(spark, d), 80, settings).history.collect()


def cv_embeddings(spark, d):
    cross_validate(c.embeddings(spark, d), 5, FULL).history.collect()


def cv_embeddings_online(spark, d):
    settings = Settings(10000, 100, retrain=5, stop=True)
    cross_validate(c.embeddings(spark, d), 5, settings).history.collect()


def language_holdout(spark, d):
    run(holdout(c.letter_shares(spark, d), 80, TEXT).predictions(similarity=True))


def language_cv_exclusion(spark, d):
    cross_validate(c.letter_counts(spark, d), 5, TEXT).history.collect()


def language_elimination(spark, d):
    backward_elimination(c.letter_shares(spark, d), TEXT, Elimination(tolerance=1.0), folds=5,
                         names=list(c.LETTERS)).selection.collect()


def language_importance(spark, d):
    feature_importance(c.letter_shares(spark, d), TEXT, 9, [1, 2], percentage=80,
                       names=list(c.LETTERS)).top().collect()


def elimination_embeddings(spark, d):
    """Three rounds of leave-one-out over all 64 embedding features."""
    backward_elimination(c.embeddings(spark, d), TEXT, Elimination(
        group_min=62, accuracy_threshold=0, tolerance=0), percentage=80).selection.collect()


def leave_one_out_wide(spark, d):
    """Every leave-one-out subset of 1000 features, the embedding values over and over."""
    rows = c.embeddings(spark, d).withColumn(
        "features", F.slice(F.flatten(F.array_repeat("features", 16)), 1, 1000))
    leave_one_out_accuracy(rows, TEXT, percentage=80).collect()


def permutation_null(spark, d):
    """1000 label-permuted replicates of the embeddings, each split, trained and scored."""
    permutation_accuracy(c.embeddings(spark, d), 1000, 80,
                         Settings(dimensionality=512, levels=16)).collect()


def holdout_wide(spark, d):
    """256 rows of 200 000 features, the embedding values over and over; 1000 levels."""
    rows = c.embeddings(spark, d).where("row_id < 256").withColumn(
        "features", F.flatten(F.array_repeat("features", 3125)))
    holdout(rows, 80, Settings(dimensionality=10000, levels=1000)).history.collect()


def split_line_items(spark, d):
    with spread(c.line_items(spark, d).select("row_id", "label"), "row_id") as rows:
        run(splits.stratified_split(rows, 80, 0))


HEADLINE = [
    encode_line_items, encode_embeddings, fit_line_items, holdout_line_items,
    retrain_line_items, cv_embeddings, cv_embeddings_online, language_holdout,
    language_cv_exclusion, language_elimination, language_importance, split_line_items,
    elimination_embeddings, holdout_wide, leave_one_out_wide, permutation_null,
]


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    spark = (
        SparkSession.builder.master(f"local[{cpus}]").appName("vectorloom-bench")
        .config("spark.sql.shuffle.partitions", cpus)
        .config("spark.driver.memory", "16g")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.sql.session.timeZone", "UTC")
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    only = set(sys.argv[1:])
    timings = {}
    for query in HEADLINE:
        if only and query.__name__ not in only:
            continue
        start = time.perf_counter()
        query(spark, sf_dir)
        timings[query.__name__] = round(time.perf_counter() - start, 3)
        print(query.__name__, timings[query.__name__], file=sys.stderr, flush=True)
    rows = c.table(spark, sf_dir, "lineitem").agg(F.count(F.lit(1))).first()[0]
    encoded = timings.get("encode_line_items")
    print(json.dumps({
        "metric": "total wall-clock of headline queries",
        "value": round(sum(timings.values()), 3),
        "unit": "sec",
        "queries": timings,
        "sf": Path(sf_dir).name.removeprefix("sf"),
        "config": {
            "cpus": int(cpus), "line_items": {"rows": rows, "features": 4, "D": 10000, "L": 100},
            "embeddings": {"features": 64, "D": 10000, "L": 100},
            "documents": {"features": 26, "D": 2000, "L": 32},
        },
        "encoded_cells_per_second": round(rows * 4 / encoded) if encoded else None,
    }))
    spark.stop()


if __name__ == "__main__":
    main()
