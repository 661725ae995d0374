"""Queries against brute force, on a given table and on one with nulls, ties and odd texts."""

import text_brute as brute
import pytest
from text_odd import ODD, SCHEMA

from vectorloom.llm.queries import QUERIES


@pytest.fixture(params=["given", "odd"])
def case(request, spark, sf_dir, odd_docs, write_sf):
    if request.param == "given":
        path = sf_dir
        rows = [(r.doc_id, r.text) for r in
                spark.read.parquet(f"{sf_dir}/documents.parquet").collect()]
    else:
        path, rows = write_sf(odd_docs), [(r[0], r[1]) for r in ODD]
    return path, rows


def rows_of(df, *columns):
    return sorted(map(repr, df.select(*columns).toPandas().astype(object)
                      .where(lambda v: v.notna(), None).itertuples(index=False, name=None)))


def expected(rows):
    return sorted(map(repr, rows))


def ints(rows):
    """Longs with nulls come as floats from pandas."""
    return sorted(repr(tuple(int(v) if isinstance(v, float) and v == v else v for v in r))
                  for r in rows)


def test_token_shards(spark, case):
    path, rows = case
    found = QUERIES["op2_token_shards"](spark, path).collect()
    order = sorted(found, key=lambda r: r.start)
    assert [r.doc_id for r in order] == sorted(
        (d for d, _ in rows), key=lambda d: (d is not None, d or 0))
    start = 0
    for r in order:
        assert r.start == start
        start += r.n_tokens
    want = [(d, len(i), brute.crc(i)) for d, t in rows for i in [brute.ids_of(t, 2)]]
    assert ints((r.doc_id, r.n_tokens, r.ids_crc32) for r in found) == ints(want)


def test_substrings(spark, case):
    path, rows = case
    found = QUERIES["op3_substring_dedup"](spark, path).collect()
    assert ints(map(tuple, found)) == ints(brute.substrings(rows))


def test_simhash(spark, case):
    path, rows = case
    found = QUERIES["op6_simhash_near_dedup"](spark, path).collect()
    assert ints(map(tuple, found)) == ints(brute.simhash_components(rows))


def test_licenses(spark, case):
    path, rows = case
    found = QUERIES["op7_license_scan"](spark, path).collect()
    assert ints((r.doc_id, r.n_words, r.n_base, r.first_word, r.last_word, r.base_labels)
                for r in found) == ints((d, *brute.license_base(t)) for d, t in rows)
    for r in found:
        assert set(r.base_labels.split(",")) <= set(r.labels.split(",")) or not r.base_labels
        assert 0 <= r.score <= 1


def test_packing(spark, case):
    path, rows = case
    found = QUERIES["op9_packing"](spark, path).collect()
    sequences = {}
    for r in found:
        sequences.setdefault(r.sequence_id, []).append(r)
    padding = 0
    for pieces in sequences.values():
        at = 0
        for p in sorted(pieces, key=lambda p: p.offset):
            assert p.offset == at
            at += p.length
        assert at <= 1024
        padding += 0 if at & (at - 1) == 0 else 1024 - at
    assert padding == 0
    whole = {}
    for doc_id, text in rows:
        whole.setdefault(doc_id, []).append(brute.ids_of(text, 0))
    pieces = {}
    for r in found:
        pieces.setdefault(r.doc_id, []).append(r)
    assert sum(r.length for r in found) == sum(len(i) for x in whole.values() for i in x)
    for doc_id, several in whole.items():
        if len(several) == 1:
            ids, at = several[0], 0
            for p in sorted(pieces[doc_id], key=lambda p: p.start):
                assert (p.start, p.doc_tokens) == (at, len(ids))
                assert p.ids_crc32 == brute.crc(ids[at:at + p.length])
                at += p.length
            assert at == len(ids)


def test_exact(spark, case):
    path, rows = case
    found = QUERIES["op10_exact_dedup"](spark, path).collect()
    assert ints((r.doc_id, r.keep_id, r.group_size, r.text_sha256) for r in found) == \
        ints(brute.exact(rows))
    kept = [r for r in found if r.kept]
    assert len(kept) == len({r.text_sha256 for r in found})
    assert all(r.doc_id == r.keep_id for r in kept)


ONE_TABLE = [n for n in QUERIES if n not in ("op4_html_extraction", "op13_ranked_search")]


@pytest.mark.parametrize("name", ONE_TABLE)
def test_empty_table(spark, name, write_sf):
    path = write_sf(spark.createDataFrame([], SCHEMA))
    assert QUERIES[name](spark, path).count() == 0


@pytest.mark.parametrize("name", [n for n in ONE_TABLE if n != "op11_spelling_variants"])
def test_odd_rows_and_extra_columns(spark, name, odd_docs, write_sf):
    for c in ("row", "kept", "size", "fp", "digest", "key", "m", "host", "n_words", "ids",
              "tie", "shard", "part", "mini", "piece", "target"):
        odd_docs = odd_docs.withColumn(c, odd_docs["lang"])
    found = QUERIES[name](spark, write_sf(odd_docs)).count()
    assert found == len(ODD) if name != "op9_packing" else found >= len(ODD)
