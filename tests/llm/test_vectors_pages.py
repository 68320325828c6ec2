"""Neighbours against brute force, pages with known main text, components, and the pipeline."""

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from bedside.llm import common, graph, pages
from bedside.llm.components import components


def brute(rows, every, k):
    live = [(i, np.array(v, np.float32).astype(float)) for i, v in rows if i is not None and v is not None and None not in v
            and np.isfinite(v).all() and any(v)]
    return {i: sorted((-float(v @ w), j) for j, w in live if j != i)[:k] for i, v in live if i % every == 0}


def test_neighbours_with_copies_and_bad_vectors(spark):
    common.prepare(spark)
    rng = np.random.default_rng(0)
    rows = [(i, rng.normal(size=8).astype(np.float32).tolist()) for i in range(300)]
    same = rng.normal(size=8).astype(np.float32).tolist()
    rows += [(300 + i, same) for i in range(200)]
    rows += [(1000, None), (1020, [0.0] * 8), (1040, [float("nan")] * 8), (1060, [None] * 8), (1080, [float("inf")] * 8), (None, same)]
    rows.append(rows[0])
    df = spark.createDataFrame([(i, v, 1) for i, v in rows], "vec_id long, embedding array<float>, rank int")
    got = graph.nearest(df, every=20, k=20).toPandas()
    want = brute(rows[:-1], 20, 20)
    assert set(got.query_id) == set(want)
    hits = 0
    for q, part in got.sort_values("rank").groupby("query_id"):
        assert list(part["rank"]) == list(range(1, 21)) and not (part.vec_id == q).any()
        hits += len(set(part.vec_id) & {j for _, j in want[q]})
    assert hits / (20 * len(want)) >= 0.97
    assert np.allclose(got[got.query_id == 300].score.max(), -want[300][0][0])


def test_few_vectors_and_none(spark):
    df = spark.createDataFrame([(0, [1.0, 0.0]), (1, [0.0, 1.0]), (20, [1.0, 1.0])], "vec_id long, embedding array<float>")
    got = {(r.query_id, r["rank"], r.vec_id) for r in graph.nearest(df).collect()}
    assert got == {(0, 1, 20), (0, 2, 1), (20, 1, 0), (20, 2, 1)}
    assert graph.nearest(df.limit(0)).count() == 0


@pytest.mark.parametrize("sf", ["sf0.01"])
def test_recall_on_the_tables(spark, sf):
    e = pd.read_parquet(f"/root/testdata/{sf}/embeddings.parquet")
    x, ids = np.array(e.embedding.tolist()).astype(float), e.vec_id.to_numpy()
    got = graph.nearest(spark.read.parquet(f"/root/testdata/{sf}/embeddings.parquet")).toPandas()
    hit = 0
    asks = np.flatnonzero(ids % 20 == 0)
    for q in asks:
        scores = x @ x[q]
        scores[q] = -np.inf
        hit += len(set(ids[np.lexsort((ids, -scores))[:20]]) & set(got[got.query_id == ids[q]].vec_id))
    assert hit / (20 * len(asks)) >= 0.9


PAGE = """<!DOCTYPE html><html><head><title>T</title><style>p{}</style></head><body><header><h1>Site</h1></header><nav><a>menu</a></nav>
<div class="cookie-notice">We use cookies</div><main><article class="post"><h1>Title &amp; x</h1><p>First&nbsp;para<br>line   two <b>bold</b>.
<p>Second <a href="x>y">link</a> 5 < 6<ul><li>one<li>two</ul><div class="share">Share</div><aside>side</aside><form><input>form</form>
<p hidden>no</p></article><section id="comments"><p>reader</p></section></main><div id="sidebar">side</div><footer>f</footer>
<script>if(a<b)"</p>"</script></body>"""


def test_known_page():
    assert pages.Page(PAGE).text() == "Title & x\nFirst para line two bold.\nSecond link 5 < 6\none\ntwo"
    for bad in ("", "<", "<p", "a<b>c", "</p></div>", "<!-- x", "<script>", "<p class='", "&#0;&bogus;", "<a b=\"c>d", "<" * 5000, "<b>" * 5000):
        assert isinstance(pages.Page(bad).text(), str)
    assert pages.Page("plain text").text() == "plain text"
    assert pages.Page("<div>kept</div><div class='ad'>not</div>").text() == "kept"


def test_attributes_are_not_found_in_values():
    assert pages.Page("<article title='a hidden gem'><p title=\"the hidden truth\">One.</p><a href='/x' title=\"A hidden gem\">two</a></article>").text() == "One.\ntwo"
    assert pages.Page("<div>kept</div><div class='ad' title='the class of role play'>not</div>").text() == "kept"
    assert pages.Page("<div>kept</div><div data-x = '>' hidden>no</div><div HIDDEN=''>no</div><div href=/a/ class=ad>no</div>").text() == "kept"


def test_a_short_article_takes_no_text_from_the_page():
    long, card = "The real text of the page. " * 9, "<section class=more><article>Next</article></section>"
    for page in (f"<main><div class=entry>{long}</div></main>{card}", f"<body><div class=entry>{long}</div>{card}</body>", f"<main><div>{long}</div>{card}</main>"):
        assert pages.Page(page).text() == f"{long.strip()}\nNext"
    assert pages.Page(f"<div>menu</div><article>{long}</article>").text() == long.strip()


def test_names_cut_no_wrapper_heading_or_paragraph():
    story = "<article><div class='entry-header'><h1>Title</h1></div><h2 class='section-header'>Part</h2><p class='notice'>Text.</p></article>"
    for wrapper in ("div class='has-sidebar'", "div class='no-sidebar'", "div class='page-with-sidebar'", "div class='overflow-hidden'",
                    "div class='sidebar'", "form", "div role='form'"):
        assert pages.Page(f"<body><{wrapper}>{story}<div class='sidebar'>side</div></{wrapper.split()[0]}></body>").text() == "Title\nPart\nText."
    assert pages.Page("<div class='legal'><div class='share'>all of it</div></div>").text() == "all of it"
    assert pages.Page("<article><p>Short.</p></article><div id='comments'><div>much longer than the text</div></div>").text() == "Short."
    assert pages.Page("<div>some text</div><div class='site-footer'>foot</div>").text() == "some text"


def test_style_tree_cuts_the_frame_of_a_site(spark):
    common.prepare(spark)
    html = ["<body><div class=top>Our brand since 1990</div><div class=story><p>Story {0} begins {0}.</p><p>And ends {0}.</p></div>"
            "<div class=tail>All rights reserved</div></body>".format(i) for i in range(20)]
    rows = [(i, f"http://a.example.org/{i}", h, "m") for i, h in enumerate(html)]
    rows += [(50, "http://b.example.org/", html[3], "m"), (51, None, html[4], "m"), (52, "not a url", None, "m"), (53, "http://a.example.org/x", "", "m"),
             (0, "http://a.example.org/0", html[0], "m")]
    df = spark.createDataFrame(rows, "page_id long, url string, html string, main string")
    got = {r.page_id: r for r in pages.result(df).collect()}
    for i in range(20):
        assert got[i].text == f"Story {i} begins {i}.\nAnd ends {i}."
        assert got[i].n_chars == len(got[i].text)
    assert got[50].text == "Our brand since 1990\nStory 3 begins 3.\nAnd ends 3.\nAll rights reserved"
    assert got[51].text.count("\n") == 3 and got[52].text == got[53].text == ""
    assert pages.result(df).count() == len(rows) and pages.result(df.limit(0)).count() == 0


def test_repeated_pages_count_once(spark):
    common.prepare(spark)
    html = ["<body><div class=top>Our brand</div><div class=story><p>Story {0}.</p></div></body>".format(i) for i in range(8)]
    rows = [(i, f"http://a.example.org/{i}", html[min(i, 7)]) for i in range(160)]
    got = {r.page_id: r.text for r in pages.result(spark.createDataFrame(rows, "page_id long, url string, html string").repartition(4)).collect()}
    assert got == {i: f"Story {min(i, 7)}." for i in range(160)}


def test_articles_of_the_table(spark):
    import html as h
    import re
    sf = "/root/testdata/sf0.01"
    got = pages.result(spark.read.parquet(f"{sf}/pages.parquet")).toPandas().set_index("page_id")
    for p in pd.read_parquet(f"{sf}/pages.parquet").itertuples():
        body = re.search(r"<article>(.*?)(</article>|$)", p.html, re.S)[1]
        blocks = [" ".join(h.unescape(re.sub("<[^>]*>", " ", b)).split()) for b in re.split(r"</?(?:p|h1)[^>]*>", body)]
        assert got.text[p.page_id] == "\n".join(b for b in blocks if b)


def test_components(spark):
    rng = np.random.default_rng(1)
    edges = [(int(a), int(b)) for a, b in rng.integers(0, 400, (300, 2))] + [(i, i + 1) for i in range(1000, 1100)] + [(5, 5)]
    root = {}

    def find(x):
        while root.setdefault(x, x) != x:
            x = root[x]
        return x
    for a, b in edges:
        root[max(find(a), find(b))] = min(find(a), find(b))
    got = {r.u: r.root for r in components(spark.createDataFrame(edges, "u long, v long")).collect()}
    assert got == {x: find(x) for x in root if find(x) != x}
    assert components(spark.createDataFrame([], "u long, v long")).count() == 0


def test_pipeline_stages_keep_columns_and_take_effect(spark, tmp_path):
    pipeline = pytest.importorskip("corpus_pipeline")
    sf = "/root/testdata/sf0.001"
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    columns, before = docs.columns, docs.count()
    for name, stage in pipeline.STAGES:
        stage(spark, docs, sf).write.parquet(str(tmp_path / name))
        docs = spark.read.parquet(str(tmp_path / name))
        if name != pipeline.STAGES[-1][0]:
            assert docs.columns == columns and docs.count() <= before
            before = docs.count()
            assert docs.where(F.length("text") != F.col("n_chars")).count() == 0
    rows = {tuple(r) for r in docs.collect()}
    assert rows == {tuple(r) for r in pipeline.run(spark, sf).collect()} and 0 < len(rows) <= before
