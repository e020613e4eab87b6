"""Small tables on which queries differed from their SQL, or did more than one look at each text."""

import duckdb
import pandas as pd
import pytest
from pyspark.sql import functions as F

from quirefold.functions import marks, stats
from quirefold.operators import compare
from quirefold.plans import registry

DOCS = [(1, ""), (2, ""), (3, None), (4, "a" * 30), (5, "ab" * 320 + "c"), (6, "a" * 14 + "b" * 6), (7, "a"), (7, "ba"), (8, "é😀a"), (9, None), (10, "z")]
ITEMS = [(3, "abc" * 9), (2, "aab"), (2, "é")]


@pytest.mark.parametrize("name", ["char_similarity", "containment", "degenerate_text"])
def test_odd_texts_equal_their_sql(spark, tmp_path, name):
    more = [(100 + 2 * i, "a" * i + "b" * (640 - i)) for i in range(1, 640)] + [(101 + 2 * i, "a" * 640) for i in range(1, 640)]
    spark.createDataFrame(DOCS + more, "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame(ITEMS, "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    con = duckdb.connect()
    for t in ("documents", "benchmark"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{tmp_path}/{t}.parquet/*.parquet'")
    theirs = con.execute(registry.oracle_sql()[name])
    columns = [c[0] for c in theirs.description]
    mine = registry.queries()[name](spark, str(tmp_path)).select(*columns).collect()
    assert sorted(map(repr, map(tuple, mine))) == sorted(map(repr, theirs.fetchall()))


def test_rounding_is_that_of_sql(spark):
    values = [i / n for n in (640, 5120, 9600) for i in range(1, n, 7)] + [-1 / 640, 0.4999999]
    mine = [r[0] for r in spark.createDataFrame([(v,) for v in values], "v double").select(stats.rounded(F.col("v"), 6)).collect()]
    con = duckdb.connect()
    con.register("t", pd.DataFrame({"i": range(len(values)), "v": values}))
    assert mine == [r[0] for r in con.execute("SELECT round(v, 6) FROM t ORDER BY i").fetchall()]


def test_script_table_is_that_of_sql():
    con = duckdb.connect()
    sample = [0x41, 0xAA, 0xB5, 0xD7, 0x370, 0x3C9, 0x400, 0x531, 0x5D0, 0x61F, 0x700, 0x780, 0x905, 0x985, 0xB85, 0xE01, 0xE81, 0x1000, 0x10A0, 0x1100, 0x1200, 0x1780, 0x1D2B, 0x3041, 0x30A1, 0x30FC, 0x4E00, 0xAC00, 0xFF21, 0x1B000, 0x20000, 0x1F600]
    for code in sample:
        own = marks._script_table()[code]
        for i, name in enumerate(marks.SCRIPTS.values(), 1):
            assert con.execute(f"SELECT regexp_matches(chr({code}), '\\p{{{name}}}')").fetchone()[0] == (own == i), (hex(code), name)


def test_scripts_are_found_in_one_look(spark):
    plan = registry.queries()["script_direction"](spark, "/root/testdata/sf0.001")._jdf.queryExecution().executedPlan().toString()
    assert "regexp" not in plan and plan.count("ArrowEvalPython") == 2  # one for each branch of the union
    assert [marks.main_script(t) for t in (None, "", "12 .", "ab мир", "мир abc", "é!", "日本かな語x", "б\nя é")] == ["Latn", "Latn", "Latn", "Cyrl", "Latn", "Latn", "Hani", "Cyrl"]


def test_counts_shuffle_lists_not_characters(spark):
    docs = spark.createDataFrame([(1, "aab"), (1, "b"), (2, None), (3, "")], "doc_id long, text string")
    counts = compare.char_counts(docs, ["doc_id"])
    assert sorted(map(tuple, counts.collect())) == [(1, "a", 2), (1, "b", 2), (3, "", 1)]
    plan = counts.groupBy("doc_id").agg(F.sum("n"))._jdf.queryExecution().sparkPlan().toString()
    assert "explode" in plan and plan.count("Exchange") <= 1
