"""Operators beyond their queries: general interfaces, hot groups, markup, indexes."""

import text_brute as brute
import numpy as np
import pytest
from text_odd import LONG, ODD
from pyspark.sql import functions as F

from vectorloom.llm import exact, licenses, lines, mixing, packing, pages, quality, shards
from vectorloom.llm import simhash, substrings

PAGE = """<html><head><title>No</title><style>p{}</style><script>var t="</p>";</script></head>
<body><div class="top-menu"><a>Home</a> <a>About</a></div><div class="content"><h2>Title</h2>
<p>First paragraph with enough words to be &amp; to stay.</p><p>Short.<ul><li>one<li>two</ul>
<div class="cookie-notice">We use cookies</div><form><label>Email</label></form>
<p>Last   one <span class="ad">buy</span>with a <a href="x">link</a> &eacute;.<br></div>
<div class="sidebar"><p>Something else that is quite long in the sidebar here.</p></div>
<div id="comments"><p>I agree with this long text so very much, dear friends.</p></div>
<footer>(c)"""


def test_main_text():
    assert pages.main_text(PAGE) == (
        "Title\nFirst paragraph with enough words to be & to stay.\nShort.\none\ntwo\n"
        "Last one with a link é.")
    assert pages.main_text(None) == pages.main_text("") == pages.main_text("<nav>x</nav>") == ""
    assert pages.main_text("plain") == "plain"
    assert pages.main_text("<article><h1>A</h1><p>b") == "A\nb"


def test_names_do_not_drop_the_article():
    paragraphs = [f"Paragraph {i} of the article has quite a number of words, all to be kept."
                  for i in range(5)]
    article = "".join(f"<p>{p}</p>" for p in paragraphs)
    menu = "<div class=menu><a>Home</a> <a>About</a></div>"
    comments = "<div id=comments><p>I agree with this text so very much, friends.</p></div>"
    for name in ("class='content has-sidebar'", "class='post comments-open'",
                 "class='elementor-widget elementor-widget-text-editor'",
                 "id='search-results'", "class='notice'"):
        for block in (article, f"<h1>T</h1>{article}", f"<article>{article}</article>"):
            page = f"<body>{menu}<div {name}>{block}</div>{comments}</body>"
            found = pages.main_text(page).split("\n")
            assert found[-5:] == paragraphs and set(found[:-5]) <= {"T"}
    widgets = "".join(f"<div class='elementor-widget elementor-widget-text'><p>{p}</p></div>"
                      for p in paragraphs)
    assert pages.main_text(f"<div>{menu}{widgets}</div>").split("\n") == paragraphs
    page = f"<body><article><p>{paragraphs[0]}</p></article><div id=comments>{article}</div>"
    assert pages.main_text(page) == paragraphs[0]
    assert pages.main_text(f"<body><div class='notice'>{article}") == "\n".join(paragraphs)


LONG_PARAGRAPH = " ".join(["some words of a long paragraph that goes on and on"] * 6)


def test_markup_within_the_article():
    p = f"<p>{LONG_PARAGRAPH}</p>"
    two = f"<article><h1>A</h1>{p}</article><article><h1>B</h1><p>Short one.</p></article>"
    assert pages.main_text(two) == f"A\n{LONG_PARAGRAPH}\nB\nShort one."
    intro = f"<body><div><p>Short intro</p><div>{p}{p}</div></div><footer>f</footer>"
    assert pages.main_text(intro) == f"Short intro\n{LONG_PARAGRAPH}\n{LONG_PARAGRAPH}"
    own = f"<article><header><h1>The title</h1><p>by someone</p></header>{p}</article>"
    assert pages.main_text(own) == f"The title\n{LONG_PARAGRAPH}"
    assert pages.main_text(f"<header><h1>Site</h1></header><article>{p}</article>") == LONG_PARAGRAPH
    ad = f"<article><p>{LONG_PARAGRAPH} <span class=ad>buy <span>now</span> cheap</span> end</p>"
    assert pages.main_text(ad) == f"{LONG_PARAGRAPH} end"
    assert pages.main_text(f"<article>{p}</article><!-- oops <p>raw markup") == LONG_PARAGRAPH
    script = f"<article><script><!-- var x = 1;</script>{p}</article>"
    assert pages.main_text(script) == LONG_PARAGRAPH
    button = f"<article><p>one <button>press</button> two</p>{p}</article>"
    assert pages.main_text(button) == f"one two\n{LONG_PARAGRAPH}"


def test_pages_without_article_elements(spark, sf_dir):
    """The given pages give the same text when plain containers stand for the article."""
    raw = [r.html for r in spark.read.parquet(f"{sf_dir}/pages.parquet").collect()]
    for opens, closes in (("<div>", "</div>"), ("<div class=x><div id=c7>", "</div></div>"),
                          ("<table><tr><td>", "</td></tr></table>"), ("<main>", "</main>")):
        same = [pages.main_text(h.replace("<article>", opens).replace("</article>", closes))
                == pages.main_text(h) for h in raw]
        assert sum(same) >= 0.95 * len(same)


def test_long_pages_and_ties():
    rows = [f"<p>Paragraph number {i} of a very long page, all of equal shape.</p>"
            for i in range(20000)]
    found = pages.main_text("<body><nav><a>x</a></nav><div>" + "".join(rows) + "</div>")
    assert found.count("\n") == len(rows) - 1
    assert pages.main_text("<p>" + "word " * 200000).count("word") == 200000


def test_extract_odd_pages(spark):
    rows = [(1, "u", PAGE, "a"), (None, None, None, None), (2, "u", "", "b"), (2, "u", "", "b")]
    df = spark.createDataFrame(rows, "page_id BIGINT, url STRING, html STRING, text STRING")
    found = sorted(len(r.text) for r in pages.extract(df).collect())
    assert found == [0, 0, 0, len(pages.main_text(PAGE))]
    assert pages.extract(df.limit(0)).count() == 0


def test_given_pages(spark, sf_dir):
    """Pages whose article is marked: everything in it and nothing else."""
    import html
    import re

    from vectorloom.llm.queries import QUERIES

    raw = {r.page_id: r.html for r in spark.read.parquet(f"{sf_dir}/pages.parquet").collect()}
    found = QUERIES["op4_html_extraction"](spark, sf_dir).collect()
    assert len(found) == len(raw)
    for r in found:
        body = re.search(r"<article>(.*?)(</article>|$)", raw[r.page_id], re.S)[1]
        blocks = re.split(r"</?(?:p|h1)>", re.sub("<br>", " ", body))
        texts = [re.sub(r"\s+", " ", html.unescape(re.sub(r"</?[a-z][^>]*>", "", b))).strip()
                 for b in blocks]
        assert r.text == "\n".join(t for t in texts if t)
        assert r.n_chars == len(r.text)


def test_hot_prefixes_get_longer(spark, make_docs):
    """Prefixes with more fragments than ``hot`` give the same result."""
    rng = np.random.default_rng(1)
    shared = [f"s{i}" for i in range(60)]
    rows = []
    for i in range(60):
        own = [f"w{x}" for x in rng.integers(0, 10**9, 40)]
        cut = int(rng.integers(10, 60))
        rows.append((i, " ".join(own[:20] + shared[60 - cut:] + own[20:])))
    docs = make_docs(rows)
    want = sorted((d, n, r) for d, n, r, _ in brute.substrings(rows))
    for hot in (0, 1, 3, 10**6):
        found = substrings.remove_repeats(docs, hot=hot)
        assert sorted((r.doc_id, r.n_words, r.n_removed) for r in found.collect()) == want
    assert any(r for _, _, r in want)


@pytest.mark.parametrize("radius", [2, 6])
@pytest.mark.parametrize("group", [1, 4, 512])
def test_links_in_large_groups(spark, group, radius, monkeypatch, tmp_path):
    """Keys above ``group`` lose no link, whether searched as matrix or outwards."""
    monkeypatch.setattr(simhash, "GROUP", group)
    rng = np.random.default_rng(2)
    centres = rng.integers(0, 2**63, 6, dtype=np.uint64)
    prints = [int(c) for c in centres]
    for c in centres:
        for _ in range(40):
            p = int(c)
            for b in rng.integers(0, 64, int(rng.integers(1, 5))):
                p ^= 1 << int(b)
            prints.append(p)
    signed = sorted({p - 2**64 if p >= 2**63 else p for p in prints})
    nodes = spark.createDataFrame([(p,) for p in signed], "fp BIGINT")
    edges = [(r.u, r.v) for r in simhash.links(
        nodes, f"{tmp_path}/links", radius, group, group).collect()]
    root = {p: p for p in signed}

    def find(x, of):
        while of[x] != x:
            x = of[x]
        return x

    for u, v in edges:
        root[find(u, root)] = find(v, root)
    real = {p: p for p in signed}
    values = np.array(signed, "<i8").view("<u8")
    for i, p in enumerate(signed):
        for j in np.flatnonzero(np.bitwise_count(values ^ values[i]) <= radius):
            real[find(signed[j], real)] = find(p, real)
    same = {}
    for p in signed:
        assert same.setdefault(find(p, root), find(p, real)) == find(p, real)
    assert len(same) == len({find(p, real) for p in signed})


def test_thresholds_cover_the_radius():
    rng = np.random.default_rng(3)
    bits = rng.integers(0, 2, (500, 64)).astype(float)
    chosen = simhash.plan(500, bits.T @ bits)
    assert sum(t + 1 for _, t in chosen) == simhash.RADIUS + 1
    assert len({b for part, _ in chosen for b in part}) == sum(len(p) for p, _ in chosen)


def test_connected_outwards_and_as_matrix():
    rng = np.random.default_rng(5)
    centre = rng.integers(0, 2**63, dtype=np.uint64)
    prints = np.unique(np.array([centre ^ np.uint64(sum(1 << int(b) for b in set(
        rng.integers(0, 64, int(rng.integers(0, 9)))))) for _ in range(700)], np.uint64))
    own = rng.random(len(prints)) < 0.5
    for rows in (prints, prints[:500]):
        mine = own[:len(rows)]
        found = dict(simhash._connected(rows, mine, 5))
        label = [found.get(i, i) for i in range(len(rows))]
        near = (np.bitwise_count(rows[:, None] ^ rows[None, :]) <= 5) & (
            mine[:, None] | mine[None, :])
        want = np.arange(len(rows))
        while True:
            low = np.where(near, want[None, :], len(rows)).min(axis=1)
            low = np.minimum(low, want)
            if (low == want).all():
                break
            want = low
        pairs = set(zip(label, want.tolist(), strict=True))
        assert len(pairs) == len(set(label)) == len(set(want.tolist()))


@pytest.mark.parametrize("pairs", [0, 8])
def test_no_near_pair_of_a_component_stays(spark, make_docs, monkeypatch, pairs):
    """Also where the most typical or least member is dissimilar to all the others, and with
    rounds alone (no pairs) as with all pairs at once."""
    monkeypatch.setattr(simhash, "PAIRS", pairs)
    rng = np.random.default_rng(11)
    one = [f"o{i}" for i in range(100)]
    rows = [(0, " ".join(one))]
    for k in range(1, 5):
        base = one[:40] + [f"b{k}x{i}" for i in range(60)]
        for j in range(6):
            changed = list(base)
            changed[int(rng.integers(0, 100))] = f"c{k}x{j}"
            rows.append((10 * k + j, " ".join(changed)))
    rows.append((99, rows[-1][1]))
    found = simhash.one_of_each(make_docs(rows), radius=64)
    kept = {r.doc_id for r in found.collect()}
    sets = {d: brute.shingles(t) for d, t in rows}
    near = {d: {e for e in sets if e != d and brute.jaccard(sets[d], sets[e]) >= 0.8}
            for d in sets}
    assert 0 in kept and not any(near[d] & kept for d in kept)
    assert all(near[d] & kept for d in sets if d not in kept)


def test_one_of_each(spark, odd_docs, make_docs):
    kept = simhash.one_of_each(odd_docs)
    assert kept.columns == odd_docs.columns
    rows = kept.collect()
    texts = [r.text for r in rows]
    assert sum(t == LONG for t in texts) + sum(" changed " in (t or "") for t in texts) == 1
    assert sum(not brute.words_of(t) for t in texts) == 1
    assert len(rows) == len(ODD) - 4 - 3

    rng = np.random.default_rng(4)
    base = [[f"w{x}" for x in rng.integers(0, 10**6, 400)] for _ in range(30)]
    docs, near = [], []
    for i, words in enumerate(base):
        docs.append((i, " ".join(words)))
        for j in range(3):
            copy = list(words)
            for at in rng.integers(0, 400, 6):
                copy[at] = f"new{rng.integers(0, 10**6)}"
            near.append((100 + 10 * i + j, " ".join(copy)))
    left = [r.doc_id for r in simhash.one_of_each(make_docs(docs + near)).collect()]
    groups = [i if i < 100 else (i - 100) // 10 for i in left]
    assert set(groups) == set(range(30)) and len(left) <= 30 + 0.1 * len(near)


def test_quality_filter_keeps_rows_whole(spark, odd_docs):
    extra = odd_docs.withColumn("m", F.lit(1)).withColumn("kept", F.lit("x"))
    kept = quality.quality_filter(extra)
    assert kept.columns == extra.columns
    assert sorted(map(repr, (r.doc_id for r in kept.collect()))) == \
        sorted(map(repr, [7, 8, 8, None, 12]))


def test_quality_sketch_merges(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    measured = quality.measured(docs, docs["doc_id"])
    halves = [quality.sketches(measured.where(F.col("doc_id") % 2 == k)) for k in (0, 1)]
    keys = ["lang", "source", "rule", "bucket"]
    merged = halves[0].union(halves[1]).groupBy(*keys).agg(F.sum("n").alias("n"))
    assert sorted(map(repr, merged.collect())) == sorted(
        map(repr, quality.sketches(measured).select(*keys, "n").collect()))


def test_boilerplate_lines(spark, make_docs):
    rows = [(i, f"menu\nown {i}\nmenu ", "a") for i in range(20)]
    rows += [(100 + i, f"menu\nother {i}", "b") for i in range(4)]
    rows += [(200, None, "a"), (201, "", None), (202, "menu", None)]
    rows += [(300, "menu\none", "c"), (301, "menu\ntwo", "c"), (302, "menu\nalone", "d")]
    found = {r.doc_id: r.text for r in lines.line_dedup(make_docs(rows)).collect()}
    assert found[3] == "own 3" and found[101] == "other 1"
    assert found[200] is None and found[201] == "" and found[202] == "menu"
    # Two pages are the least that can share a line; a host's only page keeps all of its own.
    assert found[300] == "one" and found[302] == "menu\nalone"


def test_targets_and_curriculum(spark, make_docs):
    rows = [(i, " ".join(["w"] * (5 + i % 7)), "abc"[i % 3 if i % 5 else 0]) for i in range(300)]
    docs = make_docs(rows)
    mixed = mixing.mix(docs).select("row.source", "size", "source_size", "target", "taken")
    for r in mixed.groupBy("source").agg(F.sum("taken").alias("t"), F.max("target").alias("g"),
                                         F.max("source_size").alias("s")).collect():
        assert abs(r.t - r.g) <= 0.5 and r.g <= 2 * r.s
    order = mixing.curriculum(docs)
    assert order.columns == docs.columns
    assert order.select(F.sum(mixing.n_words(F.col("text")))).first()[0] == \
        mixed.agg(F.sum("taken")).first()[0]
    assert mixed.where("taken > 2 * size").count() == 0


def test_time_of_inverts_the_integral(spark):
    knots = ((0.0, 1.0), (0.25, 3.0), (1.0, 0.5))
    df = spark.range(101).select((F.col("id") / 100).alias("f"))
    found = df.select("f", mixing.time_of(F.col("f"), mixing.segments(knots)).alias("t")).collect()
    grid = np.linspace(0, 1, 200001)
    weights = np.interp(grid, *zip(*knots, strict=True))
    area = np.concatenate([[0], np.cumsum((weights[1:] + weights[:-1]) / 2)])
    for r in found:
        assert abs(np.interp(r.t, grid, area / area[-1]) - r.f) < 1e-6


def test_license_templates():
    automata = [licenses.compiled(k, v) for k, v in licenses.TEMPLATES.items()]

    def labels(text):
        return licenses.scan(text, automata)["labels"]

    assert labels("Released under the MIT License.") == "mit,mit-notice"
    assert labels("Licensed under CC BY-NC 4.0.") == "cc-by-nc-4.0"
    assert labels("This work is licensed under the GNU General Public License, version 3.") == \
        "gpl,gpl-3.0"
    assert labels("licensed under the Apache License, Version 2.0") == "apache,apache-2.0"
    assert labels("licensed under the Apache Licence, Version 2.0") == ""
    assert labels("a license") == ""
    one = licenses.compiled("x", "copy <<var;max=3;match=[a-z]+>> of it<<beginOptional>> all"
                                 "<<endOptional>> now")
    words = "copy of it now copy a b c of it all now copy a b c d of it now".encode().split()
    assert [one.accepts(words, i) for i in (0, 4, 12)] == [4, 8, 0]
    with pytest.raises(ValueError):
        licenses.compiled("x", "<<beginOptional>>a<<endOptional>>")


def test_automata_equal_all_readings_of_a_template():
    """A template with optional and replaceable regions against the list of all its readings."""
    import itertools
    import random

    rng = random.Random(4)
    for _ in range(60):
        template, readings = "", [[]]
        for part in range(rng.randint(1, 5)):
            kind = rng.choice(["text", "optional", "var"]) if part else "text"
            words = rng.choices("abc", k=rng.randint(1, 2))
            if kind == "text":
                template += " " + " ".join(words)
                options = [words]
            elif kind == "optional":
                template += f" <<beginOptional>>{' '.join(words)} <<endOptional>>"
                options = [words, []]
            else:
                most = rng.randint(1, 2)
                template += f" <<var;max={most};match=[ab]>>"
                options = [list(x) for k in range(most + 1) for x in itertools.product("ab", repeat=k)]
            readings = [r + o for r in readings for o in options]
        made = licenses.compiled("x", template)
        known = {tuple(r) for r in readings}
        text = rng.choices("abcd", k=40)
        words = " ".join(text).encode().split()
        for at in range(len(text)):
            want = max((n for n in range(1, len(text) - at + 1)
                        if tuple(text[at:at + n]) in known), default=0)
            assert made.accepts(words, at) == want


def test_license_texts_and_template_tables(spark, make_docs):
    bsd = ("Redistribution and use in source and binary forms, with or without modification, are "
           "permitted provided that the following conditions are met: {}Redistributions of source "
           "code must retain the above copyright notice, this list of conditions and the "
           "following disclaimer. {}Redistributions in binary form must reproduce the above "
           "copyright notice, this list of conditions and the following disclaimer in the "
           "documentation and/or other materials provided with the distribution. ")
    third = ("3. Neither the name of the copyright holder nor the names of its contributors may be "
             "used to endorse or promote products derived from this software without specific "
             "prior written permission.")
    gpl = ("This program is free software; you can redistribute it and/or modify it under the terms "
           "of the GNU {}General Public License as published by the Free Software Foundation; "
           "either version 2 of the License, or (at your option) any later version.")
    texts = [bsd.format("1. ", "2. "), bsd.format("* ", "* ") + third, gpl.format(""),
             gpl.format("Lesser "), bsd.format("1. ", "2. ").replace("binary form", "any form"),
             "mit license " * 50000]
    docs = make_docs(list(enumerate(texts)))
    found = {r.doc_id: r for r in licenses.license_scan(docs).collect()}
    assert found[0].labels == "bsd-2-clause" and found[1].labels == "bsd-2-clause,bsd-3-clause"
    assert found[2].labels == "gpl" and found[3].labels == "gpl,lgpl" and found[4].labels == ""
    assert found[5].n_base == 50000 and found[5].last_word == 99998
    table = spark.createDataFrame([("own", "conditions are met"), ("own", "zzz"), (None, "a")],
                                  "label STRING, template STRING")
    again = licenses.license_scan(docs, table)
    assert {r.doc_id for r in again.collect() if "own" in r.labels.split(",")} == {0, 1, 4}


def test_cuckoo_filter_grows_and_deletes():
    digests = [np.random.default_rng(i).bytes(32) for i in range(3000)]
    made = exact.CuckooFilter(buckets=2)
    assert all(made.insert(d) for d in digests) and not any(made.insert(d) for d in digests)
    assert all(d in made for d in digests) and made.buckets > 512
    assert all(made.delete(d) for d in digests[::2]) and not made.delete(digests[0])
    assert [d in made for d in digests] == [i % 2 == 1 for i in range(3000)]
    again = exact.CuckooFilter.load(made.buckets, made.dump(), digests[1::2])
    assert all(d in again for d in digests[1::2]) and digests[0] not in again


def live(index):
    return {r.keep_id: r.group_size for r in index.live().collect()}


def test_exact_index_updates(spark, make_docs):
    first = exact.digests(make_docs([(i, f"t{i % 50}") for i in range(200)]))
    second = exact.digests(make_docs([(1000 + i, f"t{i}") for i in range(40, 60)]))
    index = exact.ExactIndex.empty(spark, 200).insert(first).insert(second)
    unknown = exact.digests(make_docs([(5, "unknown"), (7000, "t1")]))
    assert live(index.delete(unknown)) == live(index)
    # Rows with t1: 1, 51, 101, 151. Without 151 the next one stays, without all the digest goes.
    index = index.delete(first.where("doc_id = 151"))
    assert live(index)[101] == 3 and 151 not in live(index)
    index = index.delete(first.where("doc_id IN (1, 101, 7)"))
    assert live(index)[51] == 1 and live(index)[157] == 3
    index = index.delete(first.where("doc_id = 51"))
    assert len(live(index)) == 59 and not {1, 51, 101, 151} & set(live(index))
    assert live(index)[1045] == 5 and live(index)[1055] == 1 and live(index)[153] == 4


def test_exact_index_counts_copies(spark, make_docs):
    """Rows alike in doc_id and text are entered, and leave, one by one."""
    rows = exact.digests(make_docs([(1, "a"), (2, "a"), (2, "a"), (3, "b")]))
    index = exact.ExactIndex.empty(spark, 4).insert(rows)
    one = rows.where("doc_id = 2").orderBy("row").limit(1)
    index = index.delete(one)
    assert live(index) == {2: 2, 3: 1}
    index = index.delete(rows.where("doc_id = 2"))
    assert live(index) == {1: 1, 3: 1}
    assert live(index.insert(rows.where("doc_id = 2"))) == {2: 3, 3: 1}


def test_exact_index_splits_shards(spark, make_docs, monkeypatch):
    monkeypatch.setattr(exact, "SHARD_DIGESTS", 20)
    index = exact.ExactIndex.empty(spark, 20)
    want = {}
    for k in range(3):
        rows = [(100 * k + i, f"t{(60 * k + i) % 130}") for i in range(80)]
        want.update({t: d for d, t in rows})
        index = index.insert(exact.digests(make_docs(rows)))
    assert index.shards >= 4
    sizes = [len(r.digests) // 32 for r in index.table.collect()]
    assert sum(sizes) == len(want) and max(sizes) <= 60
    assert set(live(index)) == set(want.values())
    again = index.delete(exact.digests(make_docs([(1, "none")])))
    assert live(again) == live(index)


def test_index_finds_keys_and_rejects_others(spark, make_docs):
    docs = make_docs([(i, f"text {i}") for i in range(500)] + [(7, "again"), (None, "none")])
    store = shards.TokenStore.write(docs)
    keys = spark.createDataFrame(
        [(i, 0) for i in range(0, 2000, 7)] + [(7, 1), (7, 2), (None, 0)], "doc_id BIGINT, k BIGINT")
    found = {(r.doc_id, r.k): bytes(r.ids) for r in store.fetch(keys).collect()}
    assert set(found) == {(i, 0) for i in range(0, 500, 7)} | {(7, 1), (None, 0)}
    assert found[(14, 0)] == np.array(brute.ids_of("text 14", 2), "<u4").tobytes()
    assert {found[(7, 0)], found[(7, 1)]} == {
        np.array(brute.ids_of(t, 2), "<u4").tobytes() for t in ("text 7", "again")}


def test_perfect_hash_is_minimal():
    keys = np.random.default_rng(0).integers(0, 2**63, 20000, dtype=np.uint64)
    sizes, bits = shards.build_levels(keys)
    assert sorted(shards.find_slots(keys, sizes, bits)) == list(range(len(keys)))
    assert len(bits) < 4 * len(keys)


def test_packing_tiers():
    rng = np.random.default_rng(0)
    packer = packing.Packer(waiting=8)
    total = 0
    for i, n in enumerate(rng.integers(1, 3000, 400)):
        packer.add(i, np.arange(n, dtype="<u4"))
        total += n
    packer.finish()
    used, sizes = {}, {}
    for _, _, ids, sequence, _, size, _ in packer.made:
        used[sequence] = used.get(sequence, 0) + len(ids)
        sizes[sequence] = size
    assert used == sizes and sum(used.values()) == total
    assert {s for s in sizes.values()} >= {1024, 512}


def test_long_texts_are_encoded_whole():
    from vectorloom.llm import tokens

    encoder = tokens.Encoder.of(tokens.default_vocabulary())
    text = (LONG + "\n") * 60 + "x" * 3000
    assert len(text) > tokens.STEP_CHARS
    ids = np.frombuffer(encoder.encode([text])[0], "<u4")
    assert ids.tolist() == brute.ids_of(text, 0)[:-1]


def test_block_pairs_equal_row_pairs(spark, make_docs, monkeypatch):
    """A dense group whose members are alike but mostly not near copies: compared by blocks in
    tasks or as rows of pairs, the same ones stay."""
    rng = np.random.default_rng(3)
    common = [f"c{i}" for i in range(60)]
    rows = []
    for i in range(90):
        words = list(common)
        for at in rng.integers(0, 60, int(rng.integers(0, 5))):
            words[at] = f"o{i}x{at}"
        rows.append((i, " ".join(words)))
    docs = make_docs(rows)
    sets = {d: brute.shingles(t) for d, t in rows}
    found = []
    for group, members in ((10**6, 128), (1, 3), (1, 128)):
        monkeypatch.setattr(simhash, "PAIRS", 10**6)  # all pairs at once
        monkeypatch.setattr(simhash, "PAIR_GROUP", group)
        monkeypatch.setattr(simhash, "MEMBERS", members)
        found.append({r.doc_id for r in simhash.one_of_each(docs, radius=20).collect()})
    assert found[0] == found[1] == found[2]
    near = [(a, b) for a in found[0] for b in found[0] if a < b
            and brute.jaccard(sets[a], sets[b]) >= 0.8]
    assert not near and 1 < len(found[0]) < 90
    i, j = simhash._similar_places([np.arange(5), np.arange(5), np.arange(9)], np.zeros(3), 0.8)
    assert list(zip(i, j)) == [(0, 1)]
    i, j = simhash._similar_places([np.zeros(0, int)] * 2, np.array([0, 1]), 0.8)
    assert list(zip(i, j)) == [(0, 1)]
