"""Registered queries against their SQL on the smallest tables, and expressions against plain Python."""

import os

import duckdb
import pytest
from pyspark.sql import functions as F

from quirefold.functions import scripts, stats
from quirefold.operators import compare, html_blocks, lines
from quirefold.plans import registry
from quirefold.session import TABLES

SF = "/root/testdata/sf0.001"


def _rows(frame):
    frame = frame[sorted(frame.columns)]
    return sorted(tuple(str(v) if not isinstance(v, float) else f"{v:.6f}" for v in r) for r in frame.itertuples(index=False))


@pytest.fixture(scope="module")
def con():
    c = duckdb.connect()
    for t in TABLES:
        if os.path.exists(f"{SF}/{t}.parquet"):
            c.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    return c


@pytest.mark.parametrize("name", sorted(registry.oracle_sql()))
def test_query_equals_its_sql(spark, con, name):
    mine = registry.queries()[name](spark, SF).toPandas()
    theirs = con.execute(registry.oracle_sql()[name]).df()
    assert _rows(mine) == _rows(theirs)


def test_lines_of_null_and_empty(spark):
    docs = spark.createDataFrame([(1, None, "x"), (2, "", "x"), (3, "a\n\nb", "x")], "doc_id long, text string, line string")
    assert sorted(map(tuple, lines.split_lines(docs).collect())) == [(3, 0, "a"), (3, 2, "b")]


def test_dedupe_intersect_median(spark):
    row = spark.range(1).select(
        stats.dedupe(F.array(*map(F.lit, [5.0, 1.0, 2.5, 7.5, 7.0])), 2.0).alias("d"),
        stats.intersect(F.array(F.lit(1.0), F.lit(9.0)), F.array(F.lit(2.5)), 2.0).alias("i"),
        stats.upper_median(F.array(*map(F.lit, [1, 2, 3, 4]))).alias("m"),
    ).first()
    assert (row["d"], row["i"], row["m"]) == ([1.0, 5.0, 7.5], [1.0], 3)


def test_subset_prefix_and_escape(spark):
    row = spark.range(1).select(
        scripts.strip_subset_prefix(F.lit("ABCDEF+Times")).alias("a"),
        scripts.strip_subset_prefix(F.lit("ABCDEF+")).alias("b"),
        scripts.escape_markdown(F.lit("a*b_[c]<d>`\\")).alias("c"),
    ).first()
    assert tuple(row) == ("Times", "ABCDEF+", "a\\*b\\_\\[c\\]\\<d\\>\\`\\\\")


def test_greedy_breaks_like_a_loop(spark):
    text = "aa bbb  c dddddddd ee f ggg"
    expected, width = [], 6
    for w in text.split():
        if expected and len(expected[-1]) + 1 + len(w) <= width:
            expected[-1] += " " + w
        else:
            expected.append(w)
    assert spark.range(1).select(stats.greedy_breaks(F.lit(text), width).alias("x")).first()["x"] == expected


def test_similarity(spark):
    pairs = spark.createDataFrame([(1, 2, "aab", "abb")], "a long, b long, text_a string, text_b string")
    assert tuple(compare.similarity(pairs).first()) == (1, 2, 0.666667, 0.666667)


def test_page_blocks_hold_whole_pages(spark):
    """Against the standard library's parser: no character of a page is lost, and every heading and item is one."""
    from html.parser import HTMLParser

    class Reader(HTMLParser):
        def __init__(self):
            super().__init__(convert_charrefs=True)
            self.raw, self.text, self.tags = 0, [], []

        def handle_starttag(self, tag, attrs):
            self.raw += tag in ("script", "style", "title", "textarea", "noscript", "template", "iframe")
            self.tags.append(tag)

        def handle_endtag(self, tag):
            self.raw -= tag in ("script", "style", "title", "textarea", "noscript", "template", "iframe")

        def handle_data(self, data):
            if not self.raw:
                self.text.append(data)

    got = {}
    for r in registry.queries()["html_page_blocks"](spark, SF).orderBy("seq").collect():
        got.setdefault(r["page_id"], []).append(r)
    pages = spark.read.parquet(f"{SF}/pages.parquet").collect()
    for p in pages:
        reader = Reader()
        reader.feed(p["html"])
        reader.close()
        mine = got.get(p["page_id"], [])
        assert "".join("".join(r["text"] for r in mine).split()) == "".join("".join(reader.text).split())
        assert sum(r["kind"] == "item" for r in mine) == reader.tags.count("li")
        assert sum(r["kind"] == "heading" for r in mine) == sum(t in ("h1", "h2", "h3", "h4", "h5", "h6") for t in reader.tags)


def test_page_blocks_of_odd_markup(spark):
    html = "<h2 class=x>A <i>b</i></h2><p>One &amp; <b>two</b><p id='q'>Three<ul><li><a href='/'>Go</a><li>Stay</ul>"
    pages = spark.createDataFrame([(1, html), (2, None)], "page_id long, html string")
    rows = [tuple(r) for r in html_blocks.page_blocks(pages).orderBy("seq").collect()]
    assert [r[2:] for r in rows] == [("heading", 2, "A b"), ("paragraph", None, "One & two"), ("paragraph", None, "Three"), ("item", None, "Go"), ("item", None, "Stay")]
    assert html_blocks.markdown(html_blocks.page_blocks(pages)).first()["markdown"] == "## A b\n\nOne & two\n\nThree\n\n- Go\n\n- Stay"


def test_containment_in_every_item(spark):
    from collections import Counter

    docs = spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text").collect()
    items = spark.read.parquet(f"{SF}/benchmark.parquet").select("item_id", "text").collect()
    sets = [(i["item_id"], Counter(i["text"] or "")) for i in items]
    expected = {(d["doc_id"], k): (Counter(d["text"]) & c).total() / len(d["text"]) for d in docs if d["text"] for k, c in sets}
    got = {(r["doc_id"], r["item_id"]): r["containment"] for r in registry.queries()["containment_items"](spark, SF).collect()}
    assert len(items) > 1 and got.keys() == expected.keys()
    assert all(abs(got[k] - v) < 1e-6 for k, v in expected.items())
