"""Markers, boxes, grids and scripts on hand-made rows."""

import pytest
from pyspark.sql import functions as F

from quirefold.functions import boxes, marks
from quirefold.operators import grids
from quirefold.plans import mark_queries, registry


def _one(spark, expression, **values):
    names = ", ".join(f"{k} {t}" for k, (t, _) in values.items())
    return spark.createDataFrame([tuple(v for _, v in values.values())], names).select(expression.alias("r")).first()["r"]


@pytest.mark.parametrize(
    ("text", "hanging", "expected"),
    [("• a", False, (False, "a")), ("3. b", True, (True, "b")), ("3. b", False, None), ("1948 was", True, None), ("–", True, None), (None, True, None)],
)
def test_list_marker(spark, text, hanging, expected):
    got = _one(spark, marks.list_marker(F.col("t"), F.col("h")), t=("string", text), h=("boolean", hanging))
    assert (got and tuple(got)) == expected


def test_win_ansi_bytes(spark):
    text = "aé€“漢\u0081ÿ~"
    assert bytes(_one(spark, marks.win_ansi(F.col("t")), t=("string", text))) == "aé€“ÿ~".encode("cp1252")
    assert bytes(_one(spark, marks.win_ansi(F.col("t")), t=("string", ""))) == b""


def test_slots(spark):
    edges = F.array(*map(F.lit, [0.0, 10.0, 20.0, 30.0]))
    got = [_one(spark, marks.slot(edges, F.col("v")), v=("double", v)) for v in (-5.0, 10.0, 10.5, 20.0, 25.0, 99.0)]
    assert got == [0, 0, 1, 1, 2, 2]
    assert _one(spark, marks.slot(F.array(F.lit(1.0)), F.col("v")), v=("double", 1.0)) is None


def test_boxes(spark):
    box = lambda *v: F.struct(*(F.lit(x).alias(n) for x, n in zip(v, boxes.SIDES, strict=True)))
    one = spark.range(1)
    get = lambda c: (lambda r: r and tuple(r))(one.select(c.alias("r")).first()["r"])
    assert get(boxes.union(box(0, 0, 2, 2), box(1, -1, 5, 1))) == (0, -1, 5, 2)
    assert get(boxes.intersection(box(0, 0, 2, 2), box(1, 1, 5, 5))) == (1, 1, 2, 2)
    assert get(boxes.intersection(box(0, 0, 2, 2), box(2, 0, 5, 5))) == (2, 0, 2, 2)
    assert get(boxes.intersection(box(0, 0, 2, 2), box(3, 0, 5, 5))) is None


def test_grids(spark):
    rows = [(1, 0, "a | b"), (1, 1, "c | "), (1, 2, "plain"), (1, 3, "x | y | z"), (2, 0, "none")]
    lines = spark.createDataFrame(rows, "doc_id long, line long, text string")
    got = {r["first"]: r for r in grids.tables(lines).collect()}
    assert got[0]["markdown"] == "|  |  |\n| --- | --- |\n| a | b |\n| c |  |" and got[0]["fill"] == 0.75
    assert (got[3]["n_rows"], got[3]["n_columns"]) == (1, 3)
    built = lines.where("line = 0 AND doc_id = 1").select(F.array(F.split("text", " . ")).alias("rows"))
    assert built.select(grids.cell(F.col("rows"), 0, 1).alias("c"), grids.cell(F.col("rows"), 4, 0).alias("n")).first() == ("b", None)
    assert grids.tables(lines.limit(0)).count() == 0


def test_collapse_keeps_one_end_space(spark):
    assert _one(spark, marks.collapsed(F.col("t")), t=("string", " 　a\t\n b  ")) == "a b "


def test_divergence_of_texts(spark, tmp_path):
    rows = [(1, "same start then x"), (2, "same start then y"), (3, "same start"), (5, None), (6, "")]
    spark.createDataFrame(rows, "doc_id long, text string").write.parquet(str(tmp_path / "documents.parquet"))
    got = {r["a"]: r["first_difference"] for r in registry.queries()["reading_divergence"](spark, str(tmp_path)).collect()}
    assert got == {1: 16, 2: 10}
    assert mark_queries.MARKED
