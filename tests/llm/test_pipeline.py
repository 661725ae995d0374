"""The pipeline stage by stage against SQL and brute force, and on odd rows."""

from collections import Counter

import text_brute as brute
import corpus_pipeline
import duckdb
from text_odd import ODD, SCHEMA

from vectorloom.llm import sql
from vectorloom.tables import written


def run_stages(spark, docs, sf_dir):
    out = [docs]
    for _, stage in corpus_pipeline.STAGES:
        out.append(written(stage(spark, out[-1], sf_dir)))
    return out


def test_stages(spark, sf_dir):
    raw, good, cut, unique, mixed, packed = run_stages(
        spark, spark.read.parquet(f"{sf_dir}/documents.parquet"), sf_dir)
    for df in (good, cut, unique, mixed):
        assert df.columns == raw.columns
    duck = duckdb.connect()
    duck.register("documents", raw.toPandas())
    want = duck.execute(
        f"WITH {sql.measured()}, {sql.judged()} SELECT doc_id FROM v WHERE kept").fetchall()
    assert sorted(r.doc_id for r in good.collect()) == sorted(w[0] for w in want)

    duck.register("goods", good.toPandas())
    want = duck.execute(
        f"WITH {sql.line_cuts('goods')} SELECT doc_id, kept_text FROM cut").fetchall()
    assert sorted((r.doc_id, r.text) for r in cut.collect()) == sorted(want)
    assert all(r.n_chars == len(r.text) for r in cut.collect())

    sets = {r.doc_id: brute.shingles(r.text) for r in cut.collect()}
    kept = {r.doc_id for r in unique.collect()}
    assert len(kept) == unique.count() and kept <= set(sets)
    near = {d: {e for e in sets if e != d and brute.jaccard(sets[d], sets[e]) >= 0.8}
            for d in sets}
    assert all(near[d] & kept for d in sets if d not in kept)
    assert all(d in kept for d in sets if not near[d])
    assert not any(sets[d] == sets[e] for d in kept for e in near[d] & kept)
    missed = sum(len(near[d] & kept) for d in kept)
    assert missed <= 0.1 * sum(map(len, near.values()))

    texts = {r.doc_id: (r.source, r.text) for r in unique.collect()}
    sizes, taken = Counter(), Counter()
    for source, text in texts.values():
        sizes[source] += len(brute.words_of(text))
    copies = Counter()
    for r in mixed.collect():
        taken[r.source] += len(brute.words_of(r.text))
        copies[r.doc_id] += 1
        assert texts[r.doc_id][1].startswith(r.text) and r.source == texts[r.doc_id][0]
    assert max(copies.values()) <= 2
    weights = {s: (3, 1, 2)[i % 3] for i, s in enumerate(sorted(sizes))}
    left, free, target = 1.5 * sum(sizes.values()), set(sizes), {}
    while True:
        level = left / sum(weights[s] for s in free)
        over = {s for s in free if weights[s] * level > 2 * sizes[s]}
        if not over:
            break
        for s in over:
            target[s] = 2 * sizes[s]
            left -= target[s]
        free -= over
    target |= {s: weights[s] * level for s in free}
    assert all(abs(taken[s] - target[s]) <= 1 for s in sizes)

    want = Counter()
    for r in mixed.collect():
        want[r.doc_id] += len(brute.ids_of(r.text, 0))
    got = Counter()
    for r in packed.collect():
        assert len(r.ids) == 4 * r.length
        got[r.doc_id] += r.length
    assert got == want


def test_odd_rows(spark, odd_docs, write_sf):
    for c in ("row", "kept", "size", "fp", "piece", "m", "place", "text_sha256"):
        odd_docs = odd_docs.withColumn(c, odd_docs["lang"])
    stages = run_stages(spark, odd_docs, write_sf(odd_docs))
    assert stages[1].count() == 5 and stages[3].count() == 1 and stages[5].count() > 0
    assert len(ODD) == stages[0].count()


def test_empty_table(spark, write_sf):
    path = write_sf(spark.createDataFrame([], SCHEMA))
    assert corpus_pipeline.run(spark, path).count() == 0
