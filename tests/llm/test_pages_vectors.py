"""URL rules, main text and nearest neighbours against brute force; the SQL of the queries that have one."""

import os

import duckdb
import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from labspark.llm import ann, html, queries, urls

PAGES = [
    (1, "http://a.example.com/x", "<link rel='canonical' href=\"https://b.example.net/q?z=1&amp;y=2\">"),
    (2, "https://b.example.net/q?z=1&y=2", None),
    (3, "http://c.example.com/en/1", '<META http-equiv=refresh content="0; url=/other">'),
    (4, "http://c.example.com/en/2", '<link href=/x/y rel="alternate canonical"><link rel=stylesheet href=/s>'),
    (5, "http://C.example.com/x/y#f", '<meta http-equiv="Refresh" content="5;URL=\'//a.example.com/x\'">'),
    (6, None, "x"), (7, "http://Example.ORG/fr/", '<link rel=canonical href="//a.example.com/x">'),
    (None, "nothing", None), (9, "https://example.com", ""), (10, "http://notexample.com/de/1", "<link rel=canonical>"),
    (11, "http://www.EXAMPLE.com/de/1?x=://net/", "<p>"), (12, "ftp://net:80/", None), (13, "http://sub.net/", ""),
    (14, "http://x.example.net/en/", ""), (15, "http://example.net/enx", ""), (2, "https://b.example.net/q?z=1&y=2", None),
]


@pytest.fixture
def pages(spark):
    return spark.createDataFrame([(*p, "extra") for p in PAGES], "page_id long, url string, html string, host string")


def test_rules_and_aliases(pages, spark):
    out = urls.judge_pages(pages).collect()
    assert len(out) == len(PAGES)
    got = {r["page_id"]: (r["host"], r["path"], r["rule"], r["verdict"]) for r in out}
    assert got[1] == ("a.example.com", "/x", None, "block")  # alias of 2, which a rule blocks
    assert got[2] == ("b.example.net", "/q", "net/", "block")
    assert got[3][3] == "allow" and got[4][3] == got[5][3] == "block"  # 4 and 5 reach 1 and so 2
    assert got[7] == ("example.org", "/fr/", "org/fr/", "allow")  # in the blocked class, but allowed by a rule
    assert got[6] == got[None] == ("", "", None, "allow")
    assert got[9] == ("example.com", "", None, "allow") and got[10][2] is None
    assert got[11][2:] == ("example.com/de/", "block") and got[12] == ("net:80", "/", None, "allow")
    assert got[13][2:] == ("net/", "block") and got[14][2:] == ("example.net/en/", "allow") and got[15][2] == "net/"
    logged = spark.createDataFrame([("http://c.example.com/en/1", "http://z.net/"), (None, "http://q.net/")], "source_url string, target_url string")
    assert {r["page_id"]: r["verdict"] for r in urls.judge_pages(pages, logged).collect()}[3] == "block"
    assert urls.judge_pages(pages.limit(0)).count() == 0


@pytest.mark.parametrize("name", ["op5_mixing", "op9_url_filter"])
def test_queries_equal_their_sql(spark, pages, tmp_path, name):
    from labspark.llm.mixing import WEIGHTS
    pages.select("page_id", "url", "html").coalesce(1).write.parquet(str(tmp_path / "pages.parquet"))
    docs = [(i % 900 if i else None, f"text {i % 700}", [*WEIGHTS, "elsewhere", None][i % 7 if i % 3 else i % 10]) for i in range(3000)]
    spark.createDataFrame(docs, "doc_id long, text string, source string").coalesce(1).write.parquet(str(tmp_path / "documents.parquet"))
    found = queries.QUERIES[name](spark, str(tmp_path)).toPandas()
    with duckdb.connect() as db:
        for table in ("pages", "documents"):
            db.execute(f"create view {table} as select * from '{tmp_path}/{table}.parquet/*.parquet'")
        expected = db.execute(queries.ORACLE[name]).df()
    assert sorted(found.columns) == sorted(expected.columns)
    key = lambda df: sorted(tuple("" if pd.isna(x) else str(int(x) if isinstance(x, (float, np.integer)) else x) for x in r)
                            for r in df[sorted(df.columns)].itertuples(index=False))
    assert key(found) == key(expected)


# main text

def test_blocks_of_broken_html():
    page = ("<!DOCTYPE html><title>t</title><body>lead &amp; <i>text</i><!-- <p>no --><p>one<br>two &lt;x&gt; &#233;&nbsp;z"
            "<p><b>three<p>four<script>var t='</p>';</script> more<ul><li>a<li><a href='x>y'>b</a></ul>tail<style>p{}</style>")
    blocks = html.leaf_blocks(page)
    assert [b[0] for b in blocks] == ["lead & text", "one two <x> é z", "three", "four more", "a", "b", "tail"]
    assert [t for t, _ in blocks[5][1]] == ["body", "ul", "li"] and blocks[5][2] == 1 and blocks[4][2] == 0
    assert html.leaf_blocks("") == [] and html.leaf_blocks("<p> </p><script>x") == []
    assert [b[0] for b in html.leaf_blocks("plain &am")] == ["plain &am"]


@pytest.fixture(scope="module")
def tagger():
    return html.fit(html.training_pages())


def test_viterbi_finds_the_best_labelling(tagger):
    rng = np.random.default_rng(1)
    blocks = html.leaf_blocks(next(html.labelled_pages(1, 3)))[:8]
    for _ in range(20):
        scores = rng.normal(size=(len(blocks), 2))
        tagger.emissions = lambda _, scores=scores: scores
        best = max((np.array([int(b) for b in f"{i:0{len(blocks)}b}"]) for i in range(2 ** len(blocks))), key=lambda y: (
            tagger.starts[y[0]] + scores[np.arange(len(y)), y].sum() + tagger.moves[y[:-1], y[1:]].sum()))
        assert tagger.labels(blocks) == best.tolist()
    del tagger.emissions


def test_held_out_accuracy(tagger):
    right = total = 0
    for page in html.labelled_pages(200, 77):
        blocks = html.leaf_blocks(page)
        truth = [int(t.count(html.MAIN) > t.count(html.OTHER)) for t, _, _ in blocks]
        clean = [(t.replace(html.MAIN, "").replace(html.OTHER, "") or "x", s, n) for t, s, n in blocks]
        right += sum(a == b for a, b in zip(tagger.labels(clean), truth, strict=True))
        total += len(blocks)
    assert right / total > 0.99


def test_main_text_of_a_table(spark, tagger):
    good = ("<html><body><nav><ul><li><a href=x>Home</a></li></ul></nav><header><p>Site name</p></header><article><h1>A title</h1>"
            "<p>First  paragraph\n of the text, which is long enough.</p><div class=\"ad\">Buy now and save.</div>"
            "<p>Second &amp; last paragraph of the text.</p></article><div class=\"comments\"><p>I like it a lot.</p></div>"
            "<footer>&copy; someone</footer></body></html>")
    rows = spark.createDataFrame([(1, "u", good), (1, "u", good), (2, None, None), (None, "u", ""), (4, "u", "<p>" + "word " * 50_000)],
                                 "page_id long, url string, html string")
    out = html.main_text(rows, tagger).collect()
    texts = [r["text"] for r in out if r["page_id"] == 1]
    assert texts == ["A title\n\nFirst paragraph of the text, which is long enough.\n\nSecond & last paragraph of the text."] * 2
    assert [(r["text"], r["n_chars"]) for r in out if r["page_id"] in (2, None)] == [("", 0)] * 2
    assert all(r["n_chars"] == len(r["text"]) for r in out)
    assert html.main_text(rows.limit(0), tagger).count() == 0


# nearest neighbours

def brute(vectors, k, asked):
    usable = {}
    for i, v in vectors:
        if i is not None and v is not None and len(v) == 8 and all(x is not None and np.isfinite(x) for x in v) and any(v):
            usable.setdefault((i, tuple(v)), np.array(v, np.float32).astype(float))
    out = []
    for (q, _), v in usable.items():
        if not asked(q):
            continue
        best = {}
        for (i, _), w in usable.items():
            if i != q:
                best[i] = max(best.get(i, -2), round(float(v @ w / np.linalg.norm(v) / np.linalg.norm(w)), 12))
        out += [(q, n + 1, i) for n, (i, _) in enumerate(sorted(best.items(), key=lambda x: (-x[1], x[0]))[:k])]
    return out


@pytest.mark.parametrize("copies", [0, 60])
def test_neighbours_against_brute_force(spark, copies):
    rng = np.random.default_rng(5)
    rows = [(int(i), [float(x) for x in v]) for i, v in enumerate(rng.normal(size=(300, 8)))]
    rows += [(1000 + i, rows[7][1]) for i in range(copies)]
    rows += [rows[3], (None, rows[0][1]), (2000, None), (2050, [0.0] * 8), (2100, [float("nan")] * 8), (2150, [None] * 8),
             (2200, [float("inf")] * 8), (2250, [1.0, 2.0])]
    df = spark.createDataFrame([(*r, 1) for r in rows], "vec_id long, embedding array<float>, score int")
    found = ann.nearest(df, df.where("vec_id % 10 = 0")).collect()
    expected = brute(rows, 5, lambda q: q % 10 == 0)
    got = {(r["query_id"], r["rank"]): r["vec_id"] for r in found}
    assert len(got) == len(found) <= len(expected)
    both = pd.DataFrame(expected, columns=["query_id", "rank", "vec_id"])
    assert ann.recall(pd.DataFrame([(r["query_id"], r["vec_id"]) for r in found], columns=["query_id", "vec_id"]), both) >= 0.9
    if copies:  # equal vectors: ties to the smaller ids, the query itself left out
        assert [got[1000, n] for n in range(1, 6)] == [7, 1001, 1002, 1003, 1004]
        assert [got[1050, n] for n in range(1, 6)] == [7, 1000, 1001, 1002, 1003]
    vectors = {i: np.array(v, np.float32).astype(float) for i, v in rows[:300]}
    for r in found:
        if r["query_id"] in vectors and r["vec_id"] in vectors:
            a, b = vectors[r["query_id"]], vectors[r["vec_id"]]
            assert r["score"] == pytest.approx(a @ b / np.linalg.norm(a) / np.linalg.norm(b), abs=1e-12)
    assert ann.nearest(df.limit(0), df.limit(0)).count() == 0


def test_isolated_vectors_beside_near_copies_have_k_rows(spark):
    rng = np.random.default_rng(8)
    centres = rng.normal(size=(40, 24))
    rows = [(i, [float(x) for x in centres[i % 40] + 1e-3 * rng.normal(size=24)]) for i in range(1200)]
    alone = rng.normal(size=(20, 24))
    rows += [(5000 + i, [float(x) for x in v]) for i, v in enumerate(alone)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>")
    found = ann.nearest(df, df.where("vec_id >= 5000 or vec_id % 10 = 0")).collect()
    asked = {i for i, _ in rows if i >= 5000 or i % 10 == 0}
    ranks = {}
    for r in found:
        ranks.setdefault(r["query_id"], set()).add(r["rank"])
    assert ranks == {i: {1, 2, 3, 4, 5} for i in asked}
    # the comparison with all rows is exact
    exact = ann._compared_with_all(df.where("vec_id >= 5000"), df, 5).collect()
    for q, n, i in brute(rows, 5, lambda q: q >= 5000):
        best = sorted((r for r in exact if r["query_id"] == q), key=lambda r: (-r["score"], r["vec_id"]))
        assert best[n - 1]["vec_id"] == i


def test_few_vectors_give_all_candidates(spark):
    df = spark.createDataFrame([(0, [1.0, 0.0]), (1, [0.9, 0.1]), (2, [0.0, 1.0])], "vec_id int, embedding array<float>")
    rows = ann.nearest(df, df.where("vec_id = 0")).collect()
    assert [(r["rank"], r["vec_id"]) for r in sorted(rows, key=lambda r: r["rank"])] == [(1, 1), (2, 2)]


def test_recall_on_the_test_table(spark):
    folder = "/root/testdata/sf0.01"
    if not os.path.isdir(folder):
        pytest.skip("no test tables here")
    found = queries.op8_neighbours(spark, folder).toPandas()
    table = spark.read.parquet(f"{folder}/embeddings.parquet").toPandas()
    x = np.stack(table["embedding"]).astype(float)
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    ids = table["vec_id"].to_numpy()
    true = []
    for i in np.flatnonzero(ids % 50 == 0):
        s = x @ x[i]
        s[i] = -9
        true += [(ids[i], ids[j]) for j in np.argsort(-s)[:5]]
    assert ann.recall(found, pd.DataFrame(true, columns=["query_id", "vec_id"])) >= 0.9
    assert (found.groupby("query_id")["rank"].max() == 5).all()


def test_tables_without_rows(spark, tmp_path):
    for name, schema in (("documents", "doc_id long, text string, lang string, source string, n_chars long"),
                         ("pages", "page_id long, url string, html string"), ("embeddings", "vec_id long, embedding array<float>, label int")):
        spark.createDataFrame([], schema).write.parquet(str(tmp_path / f"{name}.parquet"))
    for name, query in queries.QUERIES.items():
        assert query(spark, str(tmp_path)).select(F.count(F.lit(1))).first()[0] == 0, name
