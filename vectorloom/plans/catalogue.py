"""Every operator as a named query over the given tables."""

from __future__ import annotations

from time import perf_counter
from uuid import uuid4

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from vectorloom import kernels
from vectorloom.functions import (
    hv_add,
    hv_cosine,
    hv_dot,
    hv_flip,
    hv_norm,
    hv_roll,
    hv_sub,
    level_of,
    run_id,
)
from vectorloom.item_memory import item_memory_cells, load_item_memory
from vectorloom.operators import bundle, classify, elimination, encode, importance
from vectorloom.operators import matrix as mx
from vectorloom.operators import permute, splits
from vectorloom.plans import evaluate as ev
from vectorloom.plans.model import HDClassifier
from vectorloom.plans.replicates import permutation_accuracy
from vectorloom.plans.selection import (
    Elimination,
    backward_elimination,
    feature_importance,
    leave_one_out_accuracy,
    select_in_chunks,
)
from vectorloom.settings import Settings
from vectorloom.sources import bio, delimited, sinks
from vectorloom.sources.store import ArtifactStore, fingerprint
from vectorloom.tables import checkpoint_dir, cut_lineage, prepare, spread

# Parameters shared with the SQL texts in plans.oracles.
DIM, LEVELS, SEED = 64, 8, 0
PERCENT, FOLDS = 80, 5
LETTERS = "abcdefghijklmnopqrstuvwxyz"
SMALL = Settings(DIM, LEVELS, SEED)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


# ---- inputs ---------------------------------------------------------------------------


def embeddings(spark, sf_dir) -> DataFrame:
    return table(spark, sf_dir, "embeddings").select(
        F.col("vec_id").alias("row_id"), F.col("vec_id").alias("row_pos"),
        F.col("label").cast("string").alias("label"),
        F.col("embedding").cast("array<double>").alias("features"),
    )


def line_items(spark, sf_dir) -> DataFrame:
    key = F.concat_ws("-", "l_orderkey", "l_partkey", "l_suppkey", "l_linenumber",
                      F.col("l_quantity").cast("bigint"))
    order = F.conv(F.substring(F.md5(key), 1, 15), 16, 10).cast("bigint")
    return table(spark, sf_dir, "lineitem").select(
        key.alias("row_id"), order.alias("row_pos"), F.col("l_returnflag").alias("label"),
        F.array("l_quantity", "l_extendedprice", "l_discount", "l_tax").alias("features"),
    )


def letter_counts(spark, sf_dir, letters: str = LETTERS, shares: bool = False) -> DataFrame:
    """Occurrences of each letter in the lower-cased text, or their share of its length."""
    prepare(spark)
    codes = np.frombuffer(letters.encode(), dtype=np.uint8)

    @F.arrow_udf("array<double>")
    def count_letters(text: pa.Array) -> pa.Array:
        lower = pc.utf8_lower(text)
        counts = np.zeros((len(lower), len(codes)))
        for i, one in enumerate(lower):
            raw = np.frombuffer(one.as_buffer(), dtype=np.uint8)
            counts[i] = np.bincount(raw, minlength=256)[codes]
        if shares:
            length = pc.utf8_length(lower).to_numpy(zero_copy_only=False)[:, None]
            counts = np.divide(counts, length, out=np.zeros_like(counts), where=length > 0)
        return kernels.list_column(counts, pa.float64())

    return table(spark, sf_dir, "documents").select(
        F.col("doc_id").alias("row_id"), F.col("doc_id").alias("row_pos"),
        F.col("lang").alias("label"), count_letters("text").alias("features"),
    )


def letter_shares(spark, sf_dir, letters: str = LETTERS) -> DataFrame:
    return letter_counts(spark, sf_dir, letters, shares=True)


def brand_names(spark, sf_dir) -> DataFrame:
    """Per brand, the part names as a feature list, and twice each name's mean size."""
    return table(spark, sf_dir, "part").groupBy("p_brand", "p_name").agg(
        (F.sum("p_size").cast("double") / F.count(F.lit(1)) * 2).alias("accuracy")
    )


def feature_names(spark, sf_dir) -> DataFrame:
    names = table(spark, sf_dir, "part").select(F.col("p_name").alias("name")).distinct()
    return names.withColumn("pos", (F.row_number().over(Window.orderBy("name")) - 1).cast("int"))


def constructed_runs(spark, sf_dir) -> DataFrame:
    """Leave-one-out runs of every brand, scored by the size of the part left out."""
    sets = brand_names(spark, sf_dir)
    lists = sets.groupBy("p_brand").agg(F.array_sort(F.collect_set("p_name")).alias("features"))
    runs = permute.leave_one_out(lists)
    scores = sets.select("p_brand", F.col("p_name").alias("excluded"), "accuracy")
    return runs.join(scores, ["p_brand", "excluded"]).select(
        "p_brand", run_id("features").alias("run_id"), F.size("features").alias("group_size"),
        "accuracy", "features", F.array("excluded").alias("excluded"),
    )


def constructed_selections(spark, sf_dir) -> DataFrame:
    """Events as selections: user = seed, JSON counter = run, event type = feature."""
    return table(spark, sf_dir, "events").select(
        F.col("user_id").alias("seed"),
        F.regexp_extract("props", r'"k": (\d+)', 1).cast("int").alias("run"),
        F.col("event_type").alias("feature"),
    )


def constructed_history(spark, sf_dir) -> DataFrame:
    return table(spark, sf_dir, "events").select(
        F.col("event_type").alias("run_id"), F.col("user_id").alias("model_id"),
        F.col("event_id").alias("iteration"), F.round("value", 2).alias("accuracy"),
    )


# ---- levels and encoding --------------------------------------------------------------


def level_edges(spark, sf_dir):
    return encode.level_edges(embeddings(spark, sf_dir), LEVELS)


def level_edges_by_class(spark, sf_dir):
    return encode.level_edges(line_items(spark, sf_dir), LEVELS, ["label"])


def quantise_levels(spark, sf_dir):
    rows = embeddings(spark, sf_dir)
    lo, hi = encode.edge_values(rows, LEVELS)
    return mx.long_cells(rows, "row_id").select(
        "row_id", "pos", level_of("value", lo, hi, LEVELS).alias("level")
    )


def item_memory_usage(spark, sf_dir):
    """Every sign of the item memory, with the number of cells that use its level."""
    rows = embeddings(spark, sf_dir)
    lo, hi = encode.edge_values(rows, LEVELS)
    used = mx.long_cells(rows).groupBy(level_of("value", lo, hi, LEVELS).alias("level")).agg(
        F.count(F.lit(1)).alias("n_cells")
    )
    signs = item_memory_cells(spark, DIM, LEVELS, SEED)
    return signs.join(used, "level", "left").withColumn(
        "n_cells", F.coalesce("n_cells", F.lit(0)).cast("bigint")
    )


def _encoded(spark, sf_dir, method):
    rows = embeddings(spark, sf_dir)
    lo, hi = encode.edge_values(rows, LEVELS)
    memory = load_item_memory(spark, DIM, LEVELS, SEED)
    hv = method(rows, memory, lo, hi)
    return hv.select("row_id", F.posexplode_outer("hv").alias("d", "h")).withColumn(
        "h", F.col("h").cast("bigint"))


def encode_rows(spark, sf_dir):
    return _encoded(spark, sf_dir, encode.encode_rows)


def encode_rows_native(spark, sf_dir):
    return _encoded(spark, sf_dir, encode.encode_rows_native)


def encode_rows_blocked(spark, sf_dir):
    return _encoded(spark, sf_dir,
                    lambda *a: encode.encode_rows_blocked(*a, block=24))


def class_hypervectors(spark, sf_dir):
    rows = embeddings(spark, sf_dir)
    lo, hi = encode.edge_values(rows, LEVELS)
    memory = load_item_memory(spark, DIM, LEVELS, SEED)
    vectors = bundle.class_hypervectors(rows, memory, lo, hi)
    return vectors.select("label", "class_rank", F.posexplode("hv").alias("d", "h"))


def line_item_class_vectors(spark, sf_dir):
    """Class vectors by counting, one pass over all line items."""
    with spread(line_items(spark, sf_dir), "row_id") as rows:
        model = HDClassifier(dimensionality=DIM, levels=LEVELS, seed=SEED).fit(rows)
    return model.class_vectors(spark).select("label", "class_rank",
                                             F.posexplode("hv").alias("d", "h"))


def class_similarity(spark, sf_dir):
    rows = embeddings(spark, sf_dir)
    model = HDClassifier(dimensionality=DIM, levels=LEVELS, seed=SEED).fit(rows)
    return model.similarities(rows).select(
        "row_id", "class_label", "class_rank", F.round("similarity", 9).alias("similarity")
    )


def predict_class(spark, sf_dir):
    rows = embeddings(spark, sf_dir)
    model = HDClassifier(dimensionality=DIM, levels=LEVELS, seed=SEED).fit(rows)
    return model.transform(rows, similarity=True).select(
        "row_id", "label", "guess", F.round("similarity", 9).alias("similarity")
    )


def vector_helpers(spark, sf_dir):
    """Sum, difference, rotation, sign change, dot product, length and cosine."""
    rows = embeddings(spark, sf_dir)
    lo, hi = encode.edge_values(rows, LEVELS)
    memory = load_item_memory(spark, DIM, LEVELS, SEED)
    hv = encode.encode_rows(rows, memory, lo, hi)
    turned = hv.withColumn("r", hv_roll("hv", F.col("row_id").cast("int")))
    flipped = turned.withColumn("f", hv_flip("hv", F.array(F.lit(0), F.lit(DIM - 1))))
    total = F.aggregate(hv_add("hv", "r"), F.lit(0).cast("bigint"),
                        lambda a, x: a + x.cast("bigint") * x)
    less = F.aggregate(hv_sub("hv", "r"), F.lit(0).cast("bigint"),
                       lambda a, x: a + x.cast("bigint") * x)
    return flipped.select(
        "row_id", total.alias("sum_squares"), less.alias("difference_squares"),
        hv_dot("hv", "f").alias("dot_flipped"), F.round(hv_norm("hv"), 9).alias("norm"),
        F.round(hv_cosine("hv", "r"), 9).alias("cosine"),
    )


# ---- splits and permutations ----------------------------------------------------------


def stratified_split(spark, sf_dir):
    return splits.stratified_split(embeddings(spark, sf_dir), PERCENT, SEED).select(
        "row_id", "label", "is_train")


def line_item_split(spark, sf_dir):
    rows = line_items(spark, sf_dir).select("row_id", "label")
    return splits.stratified_split(rows, PERCENT, SEED)


def kfold_assign(spark, sf_dir):
    return splits.kfold_assign(embeddings(spark, sf_dir), FOLDS).select("row_id", "fold")


def kfold_train_exclusion(spark, sf_dir):
    """Training rows per fold; copies of test documents leave the training set."""
    rows = cut_lineage(letter_counts(spark, sf_dir))
    held = splits.kfold_held_out(rows, FOLDS)
    return splits.kfold_train_rows(held, FOLDS).select("fold", "row_id")


def feature_chunks(spark, sf_dir):
    return permute.feature_chunks(feature_names(spark, sf_dir), 10, SEED).select(
        "pos", "name", "chunk")


def label_permutation(spark, sf_dir):
    return permute.label_permutations(embeddings(spark, sf_dir), 3, SEED).select(
        "replicate", "row_id", "label")


def loo_candidates(spark, sf_dir):
    runs = constructed_runs(spark, sf_dir)
    return runs.select("p_brand", "run_id", "group_size",
                       F.element_at("excluded", 1).alias("excluded"))


def run_ids(spark, sf_dir):
    sets = brand_names(spark, sf_dir).groupBy("p_brand").agg(F.collect_set("p_name").alias("f"))
    return sets.select("p_brand", run_id("f").alias("run_id"), F.size("f").alias("n_features"))


# ---- evaluation -----------------------------------------------------------------------


def language_holdout(spark, sf_dir):
    """Document language from letter shares: held-out predictions."""
    scored = ev.holdout(letter_shares(spark, sf_dir), PERCENT, SMALL).predictions(True)
    return scored.select("row_id", "label", "guess", F.round("similarity", 9).alias("similarity"))


def language_accuracy(spark, sf_dir):
    scored = ev.holdout(letter_shares(spark, sf_dir), PERCENT, SMALL).predictions()
    return classify.accuracy(scored)


def holdout_accuracy(spark, sf_dir):
    return ev.holdout(embeddings(spark, sf_dir), PERCENT, SMALL).best.select("accuracy")


def line_item_holdout(spark, sf_dir):
    return ev.holdout(line_items(spark, sf_dir), PERCENT, SMALL).best.select("accuracy")


def cv_accuracy(spark, sf_dir):
    best = ev.cross_validate(embeddings(spark, sf_dir), FOLDS, SMALL).best
    return classify.fold_mean(best.withColumn("run_id", F.lit("all")))


def cv_history(spark, sf_dir):
    history = ev.cross_validate(embeddings(spark, sf_dir), FOLDS, SMALL).history
    return history.select("model_id", "iteration", "accuracy")


def language_cv(spark, sf_dir):
    """Folds of documents whose copies in the test fold leave the training set."""
    rows = letter_counts(spark, sf_dir)
    return ev.cross_validate(rows, FOLDS, SMALL).history.select("model_id", "accuracy")


def retrain_batch_history(spark, sf_dir):
    settings = Settings(DIM, LEVELS, SEED, retrain=2, retrain_mode="batch")
    return ev.holdout(embeddings(spark, sf_dir), PERCENT, settings).history.select(
        "iteration", F.round("error", 9).alias("error"), "accuracy")


def retrain_online_history(spark, sf_dir):
    settings = Settings(DIM, LEVELS, SEED, retrain=3)
    return ev.holdout(embeddings(spark, sf_dir), PERCENT, settings).history.select(
        "iteration", F.round("error", 9).alias("error"), "accuracy")


def language_online_history(spark, sf_dir):
    settings = Settings(DIM, LEVELS, SEED, retrain=5, stop=True)
    return ev.holdout(letter_shares(spark, sf_dir), PERCENT, settings).history.select(
        "iteration", F.round("error", 9).alias("error"), "accuracy")


def best_iteration(spark, sf_dir):
    return classify.best_iteration(constructed_history(spark, sf_dir))


def fold_mean(spark, sf_dir):
    best = classify.best_iteration(constructed_history(spark, sf_dir), ["run_id", "model_id"])
    return classify.fold_mean(best)


def text_quality_hdc(spark, sf_dir):
    """Quality label of documents from shares of character kinds in the whole text."""
    text, size = F.col("text"), F.length("text")
    kinds = ["[a-z]", "[A-Z]", "[0-9]", r"\s", r"[^\w\s]"]
    shares = [
        F.coalesce(F.try_divide(size - F.length(F.regexp_replace(text, k, "")), size), F.lit(0.0))
        for k in kinds
    ]
    rows = table(spark, sf_dir, "documents").join(
        table(spark, sf_dir, "labels").select("doc_id", "quality"), "doc_id"
    ).select(F.col("doc_id").alias("row_id"), F.col("doc_id").alias("row_pos"),
             F.col("quality").cast("string").alias("label"), F.array(*shares).alias("features"))
    return ev.holdout(rows, PERCENT, SMALL).best.select("accuracy", "iteration")


# ---- elimination and importance -------------------------------------------------------


def retain_runs(spark, sf_dir):
    kept = elimination.retain_runs(constructed_runs(spark, sf_dir), 5.0, ["p_brand"])
    return kept.select("p_brand", "run_id", "accuracy")


def next_base(spark, sf_dir):
    kept = elimination.retain_runs(constructed_runs(spark, sf_dir), 5.0, ["p_brand"])
    base = elimination.next_base(kept, ["p_brand"])
    return base.select("p_brand", "group_size", "next_size", F.explode("base").alias("feature"))


def best_group(spark, sf_dir):
    """Brands as groups of runs: the best one and the union of its features."""
    runs = constructed_runs(spark, sf_dir)
    kept = elimination.retain_runs(runs, 5.0)
    return elimination.best_group(kept).select("group_size", "accuracy", "feature")


def loo_round_accuracy(spark, sf_dir):
    """First elimination round on all letters: accuracy of every leave-one-out subset."""
    return leave_one_out_accuracy(letter_shares(spark, sf_dir), SMALL, percentage=PERCENT,
                                  names=list(LETTERS))


def language_feature_elimination(spark, sf_dir):
    found = backward_elimination(letter_shares(spark, sf_dir), SMALL, Elimination(),
                                 percentage=PERCENT, names=list(LETTERS))
    return found.selection


def language_elimination_runs(spark, sf_dir):
    found = backward_elimination(letter_shares(spark, sf_dir), SMALL,
                                 Elimination(tolerance=1.0), folds=FOLDS, names=list(LETTERS))
    return found.runs.select("run_id", "group_size", "accuracy", "iteration",
                             F.array_join("excluded", ",").alias("excluded"))


def language_elimination_deep(spark, sf_dir):
    """Without tolerance most rounds keep one run and drop one letter: the longest search."""
    found = backward_elimination(letter_shares(spark, sf_dir), SMALL, Elimination(
        accuracy_threshold=0, tolerance=0.0), percentage=PERCENT, names=list(LETTERS))
    return found.runs.select("run_id", "group_size", "accuracy", "iteration",
                             F.array_join("excluded", ",").alias("excluded"))


def backward_selection(spark, sf_dir):
    names = ["quantity", "extendedprice", "discount", "tax"]
    found = backward_elimination(line_items(spark, sf_dir), SMALL,
                                 Elimination(accuracy_threshold=0), percentage=PERCENT, names=names)
    return found.selection


def feature_importance_query(spark, sf_dir):
    found = feature_importance(letter_shares(spark, sf_dir), SMALL, chunk_size=9, seeds=[1, 2],
                               percentage=PERCENT, names=list(LETTERS))
    return found.top()


def line_item_label_permutation(spark, sf_dir):
    """Labels shuffled over rows whose positions are hashes, so with gaps everywhere."""
    return permute.label_permutations(line_items(spark, sf_dir), 2, SEED).select(
        "replicate", "row_id", "label")


def permutation_null(spark, sf_dir):
    """Accuracy of the embedding classifier against label-permuted replicates."""
    rows = embeddings(spark, sf_dir)
    observed = ev.holdout(rows, PERCENT, SMALL).best_scores()[0][0]
    null = permutation_accuracy(rows, 5, PERCENT, SMALL)
    found = importance.permutation_p_value(observed, null)
    return found.withColumns({c: F.round(c, 9) for c in ("null_mean", "p_value")})


def selected_count(spark, sf_dir):
    return importance.selected_count(constructed_selections(spark, sf_dir))


def last_run_per_seed(spark, sf_dir):
    return importance.last_run_per_seed(constructed_selections(spark, sf_dir))


def selection_frequency(spark, sf_dir):
    last = importance.last_run_per_seed(constructed_selections(spark, sf_dir))
    return importance.selection_frequency(last)


def top_features(spark, sf_dir):
    last = importance.last_run_per_seed(constructed_selections(spark, sf_dir))
    top = importance.top_features(importance.selection_frequency(last), 50)
    return top.select("feature", "n_selected", F.round("frequency", 9).alias("frequency"))


# ---- matrix operators, sources and sinks ----------------------------------------------


def class_membership(spark, sf_dir):
    return mx.class_membership(embeddings(spark, sf_dir))


def shape_report(spark, sf_dir):
    return mx.shape_report(embeddings(spark, sf_dir))


def recognised_features(spark, sf_dir):
    """Part types as the known features; all types and brands are asked for."""
    parts = table(spark, sf_dir, "part")
    known = parts.select(F.col("p_type").alias("name")).distinct()
    asked = known.unionByName(parts.select(F.col("p_brand").alias("name")))
    yes, no = mx.recognise_features(known, asked)
    return yes.withColumn("recognised", F.lit(True)).unionByName(
        no.withColumn("recognised", F.lit(False)))


def project_features(spark, sf_dir):
    picked = mx.project_features(embeddings(spark, sf_dir), [40, 3, 17])
    return mx.long_cells(picked, "row_id")


def restrict_features(spark, sf_dir):
    """Part names that appear as selected, renumbered in column order."""
    selected = table(spark, sf_dir, "part").filter("p_type = 'ECONOMY'").select(
        F.col("p_name").alias("name"))
    return mx.renumber(mx.restrict_features(feature_names(spark, sf_dir), selected))


def part_lines(spark, sf_dir) -> DataFrame:
    """Delimited text lines made from parts; odd sizes are missing, small ones comments."""
    size = F.when(F.col("p_size") % 2 == 1, F.lit("?")).otherwise(F.col("p_size").cast("string"))
    line = F.concat_ws(",", F.col("p_partkey").cast("string"), size,
                       F.concat(F.lit(" "), F.col("p_size").cast("string"), F.lit(".5 ")), "p_type")
    value = F.when(F.col("p_size") == 1, F.concat(F.lit("# "), line)).when(
        F.col("p_size") == 2, F.lit("   ")).otherwise(line)
    return table(spark, sf_dir, "part").select(value.alias("value"))


def parse_labelled_text(spark, sf_dir):
    parsed = delimited.parse_labelled(part_lines(spark, sf_dir), ",", "?", 0.0)
    return mx.long_cells(parsed, "row_id", "label")


def validate_rows(spark, sf_dir):
    """Rows with and without missing cells when nothing is filled in."""
    parsed = delimited.parse_labelled(part_lines(spark, sf_dir), ",", "?")
    good, bad = mx.validate_matrix(parsed, 2)
    flagged = good.withColumn("accepted", F.lit(True)).unionByName(
        bad.withColumn("accepted", F.lit(False)))
    return flagged.select("row_id", "accepted")


def meta_pivot(spark, sf_dir):
    """Key/value lines made from events, pivoted to one row per user."""
    lines = table(spark, sf_dir, "events").select(
        F.col("user_id").cast("string").alias("sample"),
        F.concat_ws("\t", "event_type", "props").alias("value"))
    return bio.pivot_metadata(lines, {"click": "label", "error": "platform"})


def select_samples(spark, sf_dir):
    meta = table(spark, sf_dir, "part").select(
        F.col("p_partkey").alias("sample"), F.nullif("p_type", F.lit("SMALL")).alias("label"),
        F.col("p_brand").alias("platform"))
    return bio.select_samples(meta, "Brand#3").select("sample", "label")


def sample_lookup(spark, sf_dir):
    """Parts as samples, suppliers of the same number as their class rows."""
    samples = table(spark, sf_dir, "part").select(F.col("p_partkey").alias("sample"))
    meta = table(spark, sf_dir, "supplier").select(
        F.col("s_suppkey").alias("sample"), F.col("s_name").alias("label"))
    matched = bio.labelled_samples(samples, meta)
    missing = bio.unmatched_samples(samples, meta).withColumn("label", F.lit(None).cast("string"))
    return matched.unionByName(missing)


def taxa_lines(spark, sf_dir) -> DataFrame:
    lineage = F.concat_ws("|", F.concat(F.lit("k__"), "p_brand"), F.concat(
        F.when(F.col("p_size") > 25, F.lit("g__")).otherwise(F.lit("s__")),
        F.col("p_partkey").cast("string")))
    return table(spark, sf_dir, "part").select(F.concat_ws(
        "\t", lineage, F.col("p_size").cast("string"), F.col("p_partkey").cast("string"),
        F.lit("0.5")).alias("value"))


def lineage_filter(spark, sf_dir):
    profile = bio.parse_profile(taxa_lines(spark, sf_dir), "clade\tsample0\tsample1\tsample2")
    return bio.at_rank(profile).select("taxon", "sample", "value")


def long_to_matrix(spark, sf_dir):
    """Taxa x samples transposed to samples x species."""
    profile = bio.parse_profile(taxa_lines(spark, sf_dir), "clade\tsample0\tsample1\tsample2")
    matrix, names = bio.profile_matrix(bio.at_rank(profile))
    cells = mx.long_cells(matrix, "row_id")
    return cells.join(names, "pos").select("row_id", "pos", "name", "value")


def bed_matrix(spark, sf_dir):
    """Tab lines made from events, one file per user: a feature vector per sample."""
    event = table(spark, sf_dir, "events")
    amount = F.when(F.col("event_type") == "error", F.lit(" ")).otherwise(
        F.col("value").cast("decimal(18,2)").cast("string"))
    lines = event.select(
        F.concat_ws("\t", F.lit("chr1"), F.lit("0"), F.lit("1"), F.lit("+"), "event_type",
                    amount).alias("value"),
        F.concat(F.lit("user-"), F.col("user_id").cast("string"), F.lit("-mbv.bed")).alias("file"),
        F.lit(0).cast("bigint").alias("block"), F.col("event_id").alias("line"))
    return mx.long_cells(bio.bed_matrix(bio.parse_bed(lines)), "sample")


def class_lines(spark, sf_dir) -> DataFrame:
    return table(spark, sf_dir, "part").select(F.concat_ws(
        "\t", F.lit("study"), F.col("p_partkey").cast("string"), F.lit("a"), F.lit("b"),
        F.lit("c"), "p_type").alias("value"))


def sample_classes(spark, sf_dir):
    return bio.parse_sample_classes(class_lines(spark, sf_dir))


def profile_file(spark, sf_dir):
    """Taxa profile written as a text file with its header and read again."""
    path = scratch(spark)
    header = spark.createDataFrame([("clade\tsample0\tsample1\tsample2",)], "value STRING")
    header.coalesce(1).union(taxa_lines(spark, sf_dir)).write.text(path)
    return bio.at_rank(bio.read_profile(spark, path)).select("taxon", "sample", "value")


def sample_class_file(spark, sf_dir):
    """Table of sample classes written as text and read again."""
    path = scratch(spark)
    class_lines(spark, sf_dir).write.text(path)
    return bio.read_sample_classes(spark, path)


def species_export_file(spark, sf_dir):
    """Sample x species export and the lines it holds, the header among them."""
    path = scratch(spark)
    rows = table(spark, sf_dir, "part").select(
        F.col("p_partkey").alias("row_id"), F.col("p_partkey").alias("row_pos"),
        F.col("p_type").alias("label"),
        F.array(F.col("p_size").cast("double"), F.lit(0.5)).alias("features"))
    sinks.export_species_matrix(rows, ["s__a", "s__b"], path)
    return spark.read.text(path)


def store_clean_up(spark, sf_dir):
    """An encoded set and the item memory are kept, then removed in two steps; rows that each
    state still serves."""
    store = ArtifactStore(spark, scratch(spark))
    rows = embeddings(spark, sf_dir)
    lo, hi = encode.edge_values(rows, LEVELS)
    key = dict(data=fingerprint(rows), dimensionality=DIM, levels=LEVELS, seed=SEED, lo=lo, hi=hi)
    memory = dict(dimensionality=DIM, levels=LEVELS, seed=SEED)
    store.item_memory(DIM, LEVELS, SEED)
    n = store.encoded(rows, DIM, LEVELS, SEED, lo, hi).count()
    states = []
    for step, keep in (("kept", None), ("encoded removed", True), ("all removed", False)):
        if keep is not None:
            store.clean_up(keep_levels=keep)
        states.append((step, n if store.has("encoded", **key) else 0,
                       store.has("levels", **memory)))
    return spark.createDataFrame(states, "step STRING, encoded_rows BIGINT, has_levels BOOLEAN")


def flat_export_lines(spark, sf_dir):
    rows = table(spark, sf_dir, "part").select(
        F.col("p_partkey").alias("row_id"), F.col("p_partkey").alias("row_pos"),
        F.col("p_type").alias("label"),
        F.array(F.col("p_size").cast("double"), F.lit(0.5)).alias("features"))
    return sinks.flat_lines(rows, ";")


def chunked_dataset(spark, sf_dir):
    """Embedding rows once per random chunk of their features."""
    rows = embeddings(spark, sf_dir)
    width = mx.shape_report(rows).first().n_features
    chunks = permute.feature_chunks(delimited.numbered_features(spark, width), 20, SEED)
    return mx.long_cells(sinks.chunked_rows(rows, chunks), "chunk", "row_id")


# ---- written and read back, in the session's checkpoint folder ------------------------


def scratch(spark: SparkSession) -> str:
    return f"{checkpoint_dir(spark)}/query-{uuid4().hex}"


def store_item_memory(spark, sf_dir):
    """Item memory kept in the store, reloaded, and joined with the use of its levels."""
    store = ArtifactStore(spark, scratch(spark))
    store.item_memory(DIM, LEVELS, SEED)
    kept = store.item_memory(DIM, LEVELS, SEED)
    signs = kept.select("level", F.posexplode("hv").alias("d", "sign"))
    rows = embeddings(spark, sf_dir)
    lo, hi = encode.edge_values(rows, LEVELS)
    used = mx.long_cells(rows).groupBy(level_of("value", lo, hi, LEVELS).alias("level")).agg(
        F.count(F.lit(1)).alias("n_cells"))
    return signs.join(used, "level", "left").select(
        "level", "d", F.col("sign").cast("int").alias("sign"),
        F.coalesce("n_cells", F.lit(0)).cast("bigint").alias("n_cells"))


def store_encoded_set(spark, sf_dir):
    """Encoded rows kept in the store and reloaded."""
    store = ArtifactStore(spark, scratch(spark))
    rows = embeddings(spark, sf_dir)
    lo, hi = encode.edge_values(rows, LEVELS)
    for _ in range(2):
        kept = store.encoded(rows, DIM, LEVELS, SEED, lo, hi, side="all")
    return kept.select("row_id", F.posexplode("hv").alias("d", "h")).withColumn(
        "h", F.col("h").cast("bigint"))


def dataset_round_trip(spark, sf_dir):
    """A dataset stored without feature names gets numbers as names."""
    path = scratch(spark)
    sinks.write_dataset(embeddings(spark, sf_dir), None, path)
    matrix, names = sinks.read_dataset(spark, path)
    return mx.long_cells(matrix, "row_id").join(F.broadcast(names), "pos").select(
        "row_id", "name", "value")


def flat_round_trip(spark, sf_dir):
    """Exported as text with a header and read again, rows numbered in file order."""
    path = scratch(spark)
    rows = embeddings(spark, sf_dir)
    width = mx.shape_report(rows).first().n_features
    sinks.export_flat(rows, [f"f{i}" for i in range(width)], path, sep=";")
    matrix, names = delimited.read_labelled(spark, path, ";")
    return mx.long_cells(matrix, "row_id", "row_pos", "label").join(
        F.broadcast(names), "pos").select("row_id", "row_pos", "label", "name", "value")


def feature_list_file(spark, sf_dir):
    """Requested features from a text file, one per line."""
    path = scratch(spark)
    parts = table(spark, sf_dir, "part")
    known = parts.select(F.col("p_type").alias("name")).distinct()
    lines = known.unionByName(parts.select(F.col("p_brand").alias("name")))
    lines.select(F.concat(F.lit(" "), "name", F.lit("\n")).alias("value")).write.text(path)
    yes, no = mx.recognise_features(known, delimited.read_feature_list(spark, path))
    return yes.withColumn("recognised", F.lit(True)).unionByName(
        no.withColumn("recognised", F.lit(False)))


def chunk_files(spark, sf_dir):
    """One folder per random chunk of features, written by one job."""
    path = scratch(spark)
    rows = embeddings(spark, sf_dir)
    width = mx.shape_report(rows).first().n_features
    chunks = permute.feature_chunks(delimited.numbered_features(spark, width), 20, SEED)
    sinks.write_chunks(rows, chunks, path)
    return mx.long_cells(spark.read.parquet(f"{path}/matrix"), "chunk", "row_id")


def permutation_files(spark, sf_dir):
    path = scratch(spark)
    sinks.write_permutations(permute.label_permutations(embeddings(spark, sf_dir), 3, SEED), path)
    return spark.read.parquet(path).select("replicate", "row_id", "label")


def run_summary(spark, sf_dir):
    """Retained runs of an elimination, appended with their parameters."""
    path, rules = scratch(spark), Elimination(tolerance=1.0)
    found = backward_elimination(letter_shares(spark, sf_dir), SMALL, rules, folds=FOLDS,
                                 names=list(LETTERS))
    sinks.write_summary(found.runs, path, "letters", SMALL, rules)
    return spark.read.parquet(path).select(
        "run_id", "group_size", "accuracy", "dataset", "dimensionality", "n_levels", "tolerance")


def selection_report(spark, sf_dir):
    path = scratch(spark)
    found = backward_elimination(letter_shares(spark, sf_dir), SMALL, Elimination(),
                                 percentage=PERCENT, names=list(LETTERS))
    sinks.write_selection(found.selection, path)
    return spark.read.parquet(path)


def run_log(spark, sf_dir):
    """The same evaluation logged twice under two attempt numbers, with the time it took."""
    path = scratch(spark)
    start = perf_counter()
    history = ev.cross_validate(embeddings(spark, sf_dir), FOLDS, SMALL).history
    elapsed = perf_counter() - start
    for _ in range(2):
        sinks.write_run_log(history, path, "embeddings", SMALL, elapsed)
    return spark.read.parquet(path).select(
        "model_id", "accuracy", "attempt", (F.col("elapsed") > 0).alias("timed"))


def ranking_report(spark, sf_dir):
    path = scratch(spark)
    last = importance.last_run_per_seed(constructed_selections(spark, sf_dir))
    sinks.write_ranking(importance.top_features(importance.selection_frequency(last), 50), path)
    parts = F.split("value", "\t")
    return spark.read.text(path).select(
        F.get(parts, F.lit(0)).alias("feature"),
        F.round(F.get(parts, F.lit(1)).cast("double"), 9).alias("frequency"))


def selection_tree(spark, sf_dir):
    """Selection files of seeds, runs and chunks, written and read by their paths, and the
    features ranked by how many seeds' last runs selected them."""
    path = scratch(spark)
    seed, run = F.col("p_partkey") % 10, F.col("p_size") % 3
    picked = table(spark, sf_dir, "part").select(
        seed.alias("seed"), run.alias("run"),
        F.when(run == 2, F.lit(0)).otherwise(F.col("p_retailprice").cast("int") % 2).alias("chunk"),
        F.concat_ws(" ", "p_brand", "p_type").alias("feature")).distinct()
    sinks.write_selection_tree(picked, path)
    last = importance.last_run_per_seed(delimited.read_selection_tree(spark, path))
    top = importance.top_features(importance.selection_frequency(last))
    return top.select("feature", "n_selected", "n_seeds")


def event_files(spark, sf_dir) -> str:
    """A folder of .bed and .bed.meta files, one of each per user: event counts by type. Every
    seventh user's lines come in another order; every fifth has no tissue status."""
    path = scratch(spark)
    user = F.col("user_id")
    counts = table(spark, sf_dir, "events").groupBy("user_id", "event_type").agg(
        F.count(F.lit(1)).alias("n"))
    rank = F.row_number().over(Window.partitionBy("user_id").orderBy("event_type"))
    amount = F.when(F.col("event_type") == "error", F.lit(" ")).otherwise(
        F.col("n").cast("string"))
    bed = counts.withColumn("rank", rank).select(
        F.concat(F.lit("user-"), user.cast("string"), F.lit("-mbv.bed")).alias("file"),
        F.format_string("%06d", F.when(user % 7 == 3, 1000 - F.col("rank")).otherwise(
            F.col("rank"))).alias("place"),
        F.concat_ws("\t", F.lit("chr1"), F.lit("0"), F.lit("1"), F.lit("+"), "event_type",
                    amount).alias("value"))
    meta_file = F.concat(F.lit("user-"), user.cast("string"), F.lit("-cbs.bed.meta"))
    status = F.when(user % 5 != 1, F.concat_ws(
        "\t", F.lit(bio.TISSUE_KEY), F.when(user % 2 == 0, "tumoral").otherwise("normal")))
    platform = F.concat_ws("\t", F.lit(bio.PLATFORM_KEY), F.concat(F.lit("P"), (user % 3).cast("string")))
    meta = counts.select("user_id").distinct().select(meta_file.alias("file"), F.explode(
        F.array_compact(F.array(F.lit("other\tvalue"), status, platform))).alias("value"))
    sinks.write_named_files(bed, f"{path}/bed")
    sinks.write_named_files(meta.select("file", F.col("value").alias("place"), "value"), f"{path}/meta")
    return path


def bed_files(spark, sf_dir):
    """Labelled matrix of BED files joined with their metadata files."""
    path = event_files(spark, sf_dir)
    matrix, names, _ = bio.bed_dataset(spark, f"{path}/bed", f"{path}/meta")
    cells = mx.long_cells(matrix, "sample", "label")
    return cells.join(F.broadcast(names), "pos").select("sample", "label", "pos", "name", "value")


def bed_file_report(spark, sf_dir):
    """Which files a dataset of one platform takes, and which have other features."""
    path = event_files(spark, sf_dir)
    return bio.bed_dataset(spark, f"{path}/bed", f"{path}/meta", "P1")[2]


def reject_counts(spark, sf_dir):
    """What the reader meets in a file with markers, bad numbers and rows of other widths."""
    path = scratch(spark)
    line = F.when(F.col("value").contains("9.5"), F.concat("value", F.lit(",more"))).when(
        F.col("value").contains(" 4.5"), F.regexp_replace("value", r" 4\.5 ", "4.5.5")).otherwise(
        F.col("value"))
    header = spark.createDataFrame([("id,size,half,class",)], "value STRING")
    header.coalesce(1).union(part_lines(spark, sf_dir).select(line.alias("value"))).write.text(path)
    matrix, _, counts = delimited.read_labelled_checked(spark, path, ",", "?")
    unread = matrix.where(mx.has_missing(F.col("features")))
    return unread.agg(F.count(F.lit(1)).alias("rows_with_missing")).select(
        "*", *[F.lit(counts[c]).cast("bigint").alias(c)
               for c in ("rows", "missing", "bad_numbers", "rejected")])


def store_two_runs(spark, sf_dir):
    """Two runs keep the encoded sets of their folds in one store; one of them is cleaned."""
    store = ArtifactStore(spark, scratch(spark))
    rows = embeddings(spark, sf_dir)
    lo, hi = encode.edge_values(rows, LEVELS)
    folds = {"a": (0, 1), "b": (1, 2)}  # fold 1 is kept by both
    for run, own in folds.items():
        store.item_memory(DIM, LEVELS, SEED, run=run)
        for fold in own:
            store.encoded(rows.where(F.col("row_pos") % 3 == fold), DIM, LEVELS, SEED, lo, hi,
                          run=run, fold=fold, side="test")
    store.clean_up("a")
    states = []
    for fold in range(3):
        part = rows.where(F.col("row_pos") % 3 == fold)
        key = dict(data=fingerprint(part), dimensionality=DIM, levels=LEVELS, seed=SEED, lo=lo,
                   hi=hi, fold=fold, side="test")
        n = spark.read.parquet(store.path("encoded", **key)).count() if store.has(
            "encoded", **key) else 0
        states.append((fold, n))
    return spark.createDataFrame(states, "fold INT, encoded_rows BIGINT")


def stored_model_predictions(spark, sf_dir):
    """Predictions of a model that was saved and loaded."""
    store = ArtifactStore(spark, scratch(spark))
    rows = embeddings(spark, sf_dir)
    store.save_model(HDClassifier(dimensionality=DIM, levels=LEVELS, seed=SEED).fit(rows), "m")
    return store.load_model("m").transform(rows, similarity=True).select(
        "row_id", "label", "guess", F.round("similarity", 9).alias("similarity"))


def chunked_selection(spark, sf_dir):
    """All letters in random chunks of nine, one elimination per chunk."""
    return select_in_chunks(letter_shares(spark, sf_dir), SMALL, 9,
                            Elimination(accuracy_threshold=0), percentage=PERCENT,
                            names=list(LETTERS)).selection


QUERIES = {
    "level_edges": level_edges,
    "level_edges_by_class": level_edges_by_class,
    "quantise_levels": quantise_levels,
    "item_memory_usage": item_memory_usage,
    "encode_rows": encode_rows,
    "encode_rows_native": encode_rows_native,
    "encode_rows_blocked": encode_rows_blocked,
    "class_hypervectors": class_hypervectors,
    "line_item_class_vectors": line_item_class_vectors,
    "class_similarity": class_similarity,
    "predict_class": predict_class,
    "vector_helpers": vector_helpers,
    "stratified_split": stratified_split,
    "line_item_split": line_item_split,
    "kfold_assign": kfold_assign,
    "kfold_train_exclusion": kfold_train_exclusion,
    "feature_chunks": feature_chunks,
    "label_permutation": label_permutation,
    "line_item_label_permutation": line_item_label_permutation,
    "loo_candidates": loo_candidates,
    "run_ids": run_ids,
    "language_holdout": language_holdout,
    "language_accuracy": language_accuracy,
    "holdout_accuracy": holdout_accuracy,
    "line_item_holdout": line_item_holdout,
    "cv_accuracy": cv_accuracy,
    "cv_history": cv_history,
    "language_cv": language_cv,
    "retrain_batch_history": retrain_batch_history,
    "retrain_online_history": retrain_online_history,
    "language_online_history": language_online_history,
    "best_iteration": best_iteration,
    "fold_mean": fold_mean,
    "text_quality_hdc": text_quality_hdc,
    "retain_runs": retain_runs,
    "next_base": next_base,
    "best_group": best_group,
    "loo_round_accuracy": loo_round_accuracy,
    "language_feature_elimination": language_feature_elimination,
    "language_elimination_runs": language_elimination_runs,
    "language_elimination_deep": language_elimination_deep,
    "backward_selection": backward_selection,
    "feature_importance": feature_importance_query,
    "permutation_null": permutation_null,
    "selected_count": selected_count,
    "last_run_per_seed": last_run_per_seed,
    "selection_frequency": selection_frequency,
    "top_features": top_features,
    "class_membership": class_membership,
    "shape_report": shape_report,
    "recognised_features": recognised_features,
    "project_features": project_features,
    "restrict_features": restrict_features,
    "parse_labelled_text": parse_labelled_text,
    "validate_rows": validate_rows,
    "meta_pivot": meta_pivot,
    "select_samples": select_samples,
    "sample_lookup": sample_lookup,
    "lineage_filter": lineage_filter,
    "long_to_matrix": long_to_matrix,
    "bed_matrix": bed_matrix,
    "sample_classes": sample_classes,
    "profile_file": profile_file,
    "sample_class_file": sample_class_file,
    "species_export_file": species_export_file,
    "store_clean_up": store_clean_up,
    "flat_export_lines": flat_export_lines,
    "chunked_dataset": chunked_dataset,
    "store_item_memory": store_item_memory,
    "store_encoded_set": store_encoded_set,
    "dataset_round_trip": dataset_round_trip,
    "flat_round_trip": flat_round_trip,
    "feature_list_file": feature_list_file,
    "chunk_files": chunk_files,
    "permutation_files": permutation_files,
    "run_summary": run_summary,
    "selection_report": selection_report,
    "run_log": run_log,
    "ranking_report": ranking_report,
    "stored_model_predictions": stored_model_predictions,
    "chunked_selection": chunked_selection,
    "selection_tree": selection_tree,
    "bed_files": bed_files,
    "bed_file_report": bed_file_report,
    "reject_counts": reject_counts,
    "store_two_runs": store_two_runs,
}
