import pytest
from pyspark.sql import functions as F

from vectorloom import HDClassifier
from vectorloom.item_memory import load_item_memory
from vectorloom.operators import encode, permute
from vectorloom.operators import matrix as mx
from vectorloom.plans.selection import Elimination
from vectorloom.settings import Settings
from vectorloom.sources import bio, delimited, sinks
from vectorloom.sources.store import ArtifactStore, fingerprint
from vectorloom.streaming import score_stream

TEXT = """id, a ,b,class
r1,1,2.5,x

# a comment
r2, 3 ,?,y
r3,1e2,-4,x
"""


def test_read_labelled(spark, tmp_path):
    path = tmp_path / "m.csv"
    path.write_text(TEXT)
    matrix, dim = delimited.read_labelled(spark, str(path), ",", "?", 0.0)
    assert [(r.row_id, r.row_pos, r.label, r.features) for r in matrix.orderBy("row_pos").collect()] == [
        ("r1", 0, "x", [1.0, 2.5]), ("r2", 1, "y", [3.0, 0.0]), ("r3", 2, "x", [100.0, -4.0])]
    assert [r.name for r in dim.orderBy("pos").collect()] == ["a", "b"]
    strict, _ = delimited.read_labelled(spark, str(path))
    good, bad = mx.validate_matrix(strict, 2)
    assert (good.count(), [r.row_id for r in bad.collect()]) == (2, ["r2"])


def test_row_positions_over_many_splits(spark, tmp_path):
    """Several splits per file, read in any order, blank lines between."""
    lines = [f"r{i},{i},c{i % 3}" + ("\n" if i % 7 == 0 else "") for i in range(5000)]
    (tmp_path / "big.csv").write_text("id,v,class\n" + "\n".join(lines) + "\n")
    name = "spark.sql.files.maxPartitionBytes"
    before = spark.conf.get(name)
    spark.conf.set(name, "4096")
    try:
        matrix, _ = delimited.read_labelled(spark, str(tmp_path / "big.csv"))
        assert matrix.count() == 5000
        assert matrix.filter(F.concat(F.lit("r"), F.col("row_pos")) != F.col("row_id")).isEmpty()
    finally:
        spark.conf.set(name, before)


@pytest.mark.parametrize("text,value", [
    ("1", 1.0), (" 2.5\t", 2.5), ("-1e3", -1000.0), ("inf", float("inf")), ("1_000", None),
    ("?", None), ("", None), ("1.0d", None), ("x", None)])
def test_number(spark, text, value):
    df = spark.createDataFrame([(text,)], "t STRING")
    assert df.select(delimited.number(F.col("t"))).first()[0] == value


def test_feature_list_and_selections(spark, tmp_path):
    (tmp_path / "f.txt").write_text("a\n\n b \n")
    names = delimited.read_feature_list(spark, str(tmp_path / "f.txt"))
    assert sorted(r.name for r in names.collect()) == ["a", "b"]
    for chunk, feature in (("chunk_0", "p"), ("chunk_1", "q")):
        folder = tmp_path / "run0" / chunk / "x"
        folder.mkdir(parents=True)
        (folder / "selection.txt").write_text(f"# one\n# two\n# three\n{feature}\n")
        (folder / "other.txt").write_text("zzz\n")
    found = delimited.read_selections(spark, str(tmp_path / "run0"))
    assert sorted(r.name for r in found.collect()) == ["p", "q"]


def test_bed_and_metadata(spark, tmp_path):
    for sample, values in (("TCGA-A", ["1.5", "", "2"]), ("TCGA-B", ["0.1", "0.2", "0.3"])):
        rows = [f"chr1\t{i}\t{i + 1}\t+\tg{i}\t{v}\textra" for i, v in enumerate(values)]
        (tmp_path / f"{sample}-mbv.bed").write_text("\n".join(rows) + "\n")
        (tmp_path / f"{sample}-mbv.bed.meta").write_text(
            f"{bio.TISSUE_KEY}\tnormal {sample}\nnoise\t1\n{bio.PLATFORM_KEY}\tp{sample[-1]}\n")
    cells = bio.read_bed_cells(spark, str(tmp_path))
    features = bio.bed_matrix(cells)
    meta = bio.read_metadata(spark, str(tmp_path))
    joined = bio.labelled_samples(features, meta).orderBy("sample").collect()
    assert [(r.sample, r.features, r.label) for r in joined] == [
        ("TCGA-A", [1.5, 0.0, 2.0], "normal TCGA-A"), ("TCGA-B", [0.1, 0.2, 0.3], "normal TCGA-B")]
    assert [r.name for r in bio.bed_feature_names(cells).orderBy("pos").collect()] == ["g0", "g1", "g2"]
    assert [r.sample for r in bio.select_samples(meta, "pB").collect()] == ["TCGA-B"]
    assert bio.unmatched_samples(features, meta.filter("platform = 'pA'")).first().sample == "TCGA-B"


def test_taxa_profile_to_labelled_export(spark, tmp_path):
    (tmp_path / "profile.tsv").write_text(
        "clade\tS1\tS2\nk__B|p__X\t9\t9\nk__B|s__b\t1\t2\nk__B|s__a\t3\t4\n")
    (tmp_path / "classes.tsv").write_text("d\tS1\ta\tb\tc\tcase\nd\tS2\ta\tb\tc\tcontrol\n")
    profile = bio.at_rank(bio.read_profile(spark, str(tmp_path / "profile.tsv")))
    features, names = bio.profile_matrix(profile)
    classes = bio.read_sample_classes(spark, str(tmp_path / "classes.tsv"))
    matrix = features.join(classes.withColumnRenamed("sample", "row_id"), "row_id").withColumn(
        "row_pos", F.substring("row_id", 2, 9).cast("bigint"))
    out = str(tmp_path / "out")
    sinks.export_species_matrix(matrix, [r.name for r in names.orderBy("pos").collect()], out)
    text = [p.read_text() for p in sorted((tmp_path / "out").glob("part-*"))]
    assert "".join(text).splitlines() == ["Profiles;s__a;s__b;Class", "S1;3.0;1.0;case",
                                          "S2;4.0;2.0;control"]


def test_flat_export_round_trip(spark, make_matrix, tmp_path):
    rows = make_matrix([("x", [i / 4, -i]) for i in range(50)])
    sinks.export_flat(rows, ["p", "q"], str(tmp_path / "flat"))
    back, dim = delimited.read_labelled(spark, str(tmp_path / "flat"))
    assert [r.name for r in dim.orderBy("pos").collect()] == ["p", "q"]
    got = {int(r.row_id): (r.row_pos, r.label, r.features) for r in back.collect()}
    assert got == {i: (i, "x", [i / 4, -float(i)]) for i in range(50)}
    bare = sinks.flat_lines(rows, ",", keep_id=False).filter("row_pos = 1").first()
    assert bare.value == "0.25,-1.0,x"


def test_dataset_with_and_without_names(spark, make_matrix, tmp_path):
    rows = make_matrix([("x", [1, 2])])
    sinks.write_dataset(rows, delimited.feature_table(spark, ["a", "b"]), str(tmp_path / "one"))
    sinks.write_dataset(rows, None, str(tmp_path / "two"))
    _, named = sinks.read_dataset(spark, str(tmp_path / "one"))
    matrix, plain = sinks.read_dataset(spark, str(tmp_path / "two"))
    assert [r.name for r in named.orderBy("pos").collect()] == ["a", "b"]
    assert [r.name for r in plain.orderBy("pos").collect()] == ["0", "1"]
    assert matrix.first().features == [1.0, 2.0]


def test_chunked_and_permuted_datasets(spark, make_matrix, tmp_path):
    rows = make_matrix([("ab"[i % 2], range(i, i + 5)) for i in range(6)])
    dim = delimited.feature_table(spark, list("vwxyz"))
    chunks = permute.feature_chunks(dim, 2, 0)
    sinks.write_chunks(rows, chunks, str(tmp_path / "chunks"))
    stored = spark.read.parquet(str(tmp_path / "chunks" / "matrix"))
    plan = {}
    for r in chunks.collect():
        plan.setdefault(r.chunk, []).append(r.pos)
    for r in stored.collect():
        assert r.features == [float(r.row_id + p) for p in sorted(plan[r.chunk])]
    assert stored.count() == 18
    sinks.write_permutations(permute.label_permutations(rows, 3, 0), str(tmp_path / "perm"))
    sizes = spark.read.parquet(str(tmp_path / "perm")).groupBy("replicate").count().collect()
    assert {r["count"] for r in sizes} == {6} and len(sizes) == 3


def test_reports(spark, make_matrix, tmp_path):
    from vectorloom import backward_elimination

    rows = make_matrix([("ab"[i % 2], [i % 2, i, 1]) for i in range(20)])
    settings, rules = Settings(16, 2), Elimination(accuracy_threshold=0)
    found = backward_elimination(rows, settings, rules, folds=2, names=["a", "b", "c"])
    sinks.write_summary(found.runs, str(tmp_path / "summary"), "toy", settings, rules)
    summary = spark.read.parquet(str(tmp_path / "summary"))
    assert summary.count() == found.runs.count() and summary.first().dataset == "toy"
    sinks.write_selection(found.selection, str(tmp_path / "selection"))
    assert spark.read.parquet(str(tmp_path / "selection")).count() == found.selection.count()
    history = spark.createDataFrame([("m", 0, None, 50.0)],
                                    "model_id STRING, iteration INT, error DOUBLE, accuracy DOUBLE")
    assert [sinks.write_run_log(history, str(tmp_path / "log"), "toy", settings, 1.5)
            for _ in range(2)] == [0, 1]
    lines = [r.value for r in sinks.selection_lines(spark, 2, 90.0, ["b", "a"]).collect()]
    assert lines[-2:] == ["a", "b"] and all(line.startswith("#") for line in lines[:3])
    top = spark.createDataFrame([("f", 2, 2, 1.0)], "feature STRING, n_selected INT, n_seeds INT, frequency DOUBLE")
    sinks.write_ranking(top, str(tmp_path / "rank"))
    assert spark.read.text(str(tmp_path / "rank")).first().value == "f\t1.0"


def test_store_keys_and_clean_up(spark, make_matrix, tmp_path):
    store = ArtifactStore(spark, str(tmp_path / "store"))
    rows = make_matrix([("a", [0, 1]), ("b", [1, 0])])
    assert store.item_memory(16, 2, 0).count() == 2
    assert store.has("levels", dimensionality=16, levels=2, seed=0)
    assert not store.has("levels", dimensionality=16, levels=2, seed=1)
    first = {r.row_id: r.hv for r in store.encoded(rows, 16, 2, 0, 0.0, 1.0, fold=0).collect()}
    direct = encode.encode_rows(rows, load_item_memory(spark, 16, 2, 0), 0.0, 1.0)
    assert first == {r.row_id: r.hv for r in direct.collect()}
    again = store.encoded(rows, 16, 2, 0, 0.0, 1.0, fold=0)
    assert {r.row_id: r.hv for r in again.collect()} == first
    store.clean_up()
    assert store.has("levels", dimensionality=16, levels=2, seed=0)
    assert not sinks.path_exists(spark, str(tmp_path / "store" / "encoded"))
    store.clean_up(keep_levels=False)
    assert not store.has("levels", dimensionality=16, levels=2, seed=0)
    assert fingerprint(rows) == fingerprint(rows.repartition(7))
    assert fingerprint(rows) != fingerprint(make_matrix([("a", [0, 1]), ("b", [1, 1])]))


def test_model_round_trip_and_stream(spark, make_matrix, tmp_path):
    data = [("ab"[i % 2], [i % 2, i % 5, 1]) for i in range(30)]
    rows = make_matrix(data)
    model = HDClassifier(dimensionality=32, levels=4, retrain=2).fit(rows)
    store = ArtifactStore(spark, str(tmp_path))
    store.save_model(model, "m")
    want = {r.row_id: r.guess for r in model.transform(rows).collect()}
    back = store.load_model("m")
    assert {r.row_id: r.guess for r in back.transform(rows).collect()} == want
    rows.write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(rows.schema).parquet(str(tmp_path / "in"))
    query = (score_stream(stream, back).writeStream.format("memory").queryName("scored")
             .option("checkpointLocation", str(tmp_path / "ck")).start())
    try:
        query.processAllAvailable()
    finally:
        query.stop()
    assert {r.row_id: r.guess for r in spark.table("scored").collect()} == want
    with pytest.raises(ValueError):
        score_stream(rows, back)


def test_matrix_operators(spark, make_matrix):
    rows = make_matrix([("a", [5, 6, 7]), ("b", [8, 9, 10])])
    assert {r.row_id: r.features for r in mx.project_features(rows, [2, 0]).collect()} == {
        0: [5.0, 7.0], 1: [8.0, 10.0]}
    report = mx.shape_report(rows).first()
    assert (report.n_features, report.n_rows, report.n_classes) == (3, 2, 2)
    back = mx.cells_to_matrix(mx.long_cells(rows, "row_id"))
    assert {r.row_id: r.features for r in back.collect()} == {
        r.row_id: r.features for r in rows.collect()}
    dim = delimited.feature_table(spark, ["x", "y", "z"])
    asked = spark.createDataFrame([("z",), ("q",)], "name STRING")
    yes, no = mx.recognise_features(dim, asked)
    assert ([r.name for r in yes.collect()], [r.name for r in no.collect()]) == (["z"], ["q"])
    assert mx.restrict_features(dim, asked.limit(0)).count() == 3
    assert mx.renumber(mx.restrict_features(dim, asked)).first() == (0, "z")


def test_named_files_are_written_by_tasks(spark, tmp_path, monkeypatch):
    def per_file(*_):
        raise AssertionError("one call of the driver per file")

    rows = [(f"s{i % 40}/f-{i % 40}.bed", f"{9 - i // 40}", None if i == 7 else f"line {i} é")
            for i in range(320)]
    lines = spark.createDataFrame(rows, "file STRING, place STRING, value STRING").repartition(5)
    with monkeypatch.context() as patch:
        patch.setattr(sinks, "_rename_part", per_file)
        sinks.write_named_files(lines, f"file:{tmp_path}/a")
    sinks._write_and_rename(lines, f"file:{tmp_path}/b")
    texts = [{str(p.relative_to(tmp_path / top)): p.read_text(encoding="utf-8")
              for p in (tmp_path / top).rglob("*") if p.is_file() and not p.name.endswith(".crc")}
             for top in "ab"]
    assert texts[0] == texts[1] and len(texts[0]) == 40
    assert texts[0]["s7/f-7.bed"].split("\n") == [
        *(f"line {i} é" for i in range(287, 7, -40)), "", ""]
