"""Queries on markers, boxes, grids, scripts and divergence; documents, lineitem and literal rows are carriers."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Window
from pyspark.sql import functions as F

from quirefold.functions import boxes, marks
from quirefold.operators import grids
from quirefold.plans.registry import query
from quirefold.session import table

_LINES = """WITH l AS (SELECT doc_id, CAST(generate_subscripts(s, 1) - 1 AS BIGINT) AS line, unnest(s) AS text
FROM (SELECT doc_id, string_split(text, chr(10)) AS s FROM documents WHERE text IS NOT NULL))"""
#: The tables have few marked lines, so literal ones go with them, under negative ids.
MARKED = [
    (-1, 0, "• first"), (-1, 1, "*  second"), (-1, 2, "1. one"), (-1, 3, "12) twelve"), (-1, 4, "1948 was a year"), (-1, 5, "–"),
    (-2, 0, "  3.  three"), (-2, 1, "†† note"), (-2, 2, "7 seven"), (-2, 3, "## hash"), (-2, 4, "3."), (-2, 5, "plain"),
]
_MARKED = _LINES + ", m AS (SELECT * FROM l UNION ALL VALUES " + ", ".join(f"({d}, {n}, '{t}')" for d, n, t in MARKED) + ")"


def _lines(spark, sf_dir):
    docs = table(spark, sf_dir, "documents").where("text IS NOT NULL")
    return docs.select("doc_id", F.posexplode(F.split("text", "\n")).alias("line", "text")).withColumn("line", F.col("line").cast("long"))


def _marked(spark, sf_dir):
    return _lines(spark, sf_dir).unionByName(spark.createDataFrame(MARKED, "doc_id long, line long, text string"))


@query("list_markers", _MARKED + rf"""SELECT doc_id, line, b = '' AS ordered, CASE WHEN b <> '' THEN b ELSE n END AS rest FROM (
SELECT doc_id, line, regexp_extract(text, '^\s*[{marks.BULLETS}]\s*(\S.*)$', 1) AS b, regexp_extract(text, '^\s*[0-9]+[.)]\s*(\S.*)$', 1) AS n FROM m) WHERE b <> '' OR n <> ''""")
def q_list_markers(spark, sf_dir):
    """Lines that open with a list marker; plain lines count as hanging, as they have no indent to tell."""
    found = _marked(spark, sf_dir).withColumn("item", marks.list_marker(F.col("text"), F.lit(True)))
    return found.where("item IS NOT NULL").select("doc_id", "line", "item.ordered", "item.rest")


@query("footnote_markers", _MARKED + r"""SELECT * FROM (SELECT doc_id, line, regexp_extract(text, '^\s*([0-9]+|[*]+|[†]+|[‡]+|[§]+|[¶]+|[#]+)', 1) AS marker FROM m) WHERE marker <> ''""")
def q_footnote_markers(spark, sf_dir):
    """Leading digits, or a repeated symbol."""
    return _marked(spark, sf_dir).select("doc_id", "line", marks.leading_marker(F.col("text")).alias("marker")).where("marker IS NOT NULL")


_WHITE = "\\x{09}-\\x{0D}\\x{20}\\x{85}\\x{A0}\\x{1680}\\x{2000}-\\x{200A}\\x{2028}\\x{2029}\\x{202F}\\x{205F}\\x{3000}"
_INVISIBLE = "\\x{200B}-\\x{200F}\\x{FEFF}\\x{AD}"


@query("visible_text", f"""WITH d AS (SELECT doc_id, text, regexp_replace(text, '[{_INVISIBLE}]', '', 'g') AS v FROM documents WHERE text IS NOT NULL)
SELECT doc_id, CAST(length(text) - length(v) AS BIGINT) AS n_invisible, sha256(regexp_replace(regexp_replace(v, '[{_WHITE}]+', ' ', 'g'), '^ ', '')) AS collapsed FROM d""")
def q_visible_text(spark, sf_dir):
    """Zero-width characters and soft hyphens go, white space collapses."""
    docs = table(spark, sf_dir, "documents").where("text IS NOT NULL").withColumn("v", marks.visible(F.col("text")))
    return docs.select("doc_id", (F.length("text") - F.length("v")).cast("long").alias("n_invisible"), F.sha2(marks.collapsed(F.col("v")), 256).alias("collapsed"))


_SPECIAL = "".join(f"\\x{{{ord(c):X}}}" for c in marks.SPECIAL.values())


@query("win_ansi", f"""WITH d AS (SELECT doc_id, length(regexp_replace(text, '[^\\x{{20}}-\\x{{7E}}\\x{{A0}}-\\x{{FF}}{_SPECIAL}]', '', 'g')) AS n FROM documents WHERE text IS NOT NULL)
SELECT doc_id, CAST(n AS BIGINT) AS n_bytes FROM d""")
def q_win_ansi(spark, sf_dir):
    """Bytes of a document's characters in the fonts' usual code page."""
    docs = table(spark, sf_dir, "documents").where("text IS NOT NULL")
    return docs.select("doc_id", F.octet_length(marks.win_ansi(F.col("text"))).cast("long").alias("n_bytes"))


NAMES = [("ABCDEF+Times-Bold", 0), ("Helvetica-Oblique", 3), ("ABCDEF+", 7), ("Arial-BlackItalic", 0), ("abcdef+Bold", 1), ("SemiBoldFace", 2), ("Plain", 0)]
_NAMES = "WITH f(font, mode) AS (VALUES " + ", ".join(f"('{n}', {m})" for n, m in NAMES) + r"), s AS (SELECT *, lower(CASE WHEN regexp_matches(font, '^[A-Z]{6}\+.') THEN substr(font, 8) ELSE font END) AS n FROM f) "


@query("font_emphasis", _NAMES + "SELECT font, regexp_matches(n, 'bold|black|heavy') AS bold, regexp_matches(n, 'italic|oblique') AS italic, mode IN (3, 7) AS invisible FROM s")
def q_font_emphasis(spark, sf_dir):
    """Emphasis from literal font names."""
    found = spark.createDataFrame(NAMES, "font string, mode int").withColumn("e", marks.emphasis(F.col("font"), F.col("mode")))
    return found.select("font", "e.*")


ROLES = ["H", "H1", "H6", "H7", "LI", "LBody", "Lbl", "P", "Span"]


@query("role_blocks", "WITH r(role) AS (VALUES " + ", ".join(f"('{r}')" for r in ROLES) + """) SELECT role,
CASE WHEN regexp_matches(role, '^H[1-6]?$') THEN 'heading' WHEN role IN ('LI', 'LBody') THEN 'item' WHEN role = 'Lbl' THEN NULL ELSE 'paragraph' END AS kind,
CASE WHEN role = 'H' THEN 1 WHEN regexp_matches(role, '^H[1-6]$') THEN CAST(substr(role, 2) AS INT) END AS level FROM r""")
def q_role_blocks(spark, sf_dir):
    """Blocks of literal structure roles."""
    found = spark.createDataFrame([(r,) for r in ROLES], "role string").withColumn("b", marks.role_block(F.col("role")))
    return found.select("role", "b.*")


_SCRIPTS = ", ".join(f"{{'n': len(regexp_extract_all(text, '\\p{{{name}}}')), 'at': CASE WHEN regexp_matches(text, '\\p{{{name}}}') THEN length(regexp_extract(text, '^[^\\p{{{name}}}]*')) + 1 ELSE 0 END, 'tag': '{tag}'}}" for tag, name in marks.SCRIPTS.items())


@query("script_direction", f"""WITH t AS (SELECT doc_id, regexp_replace(text, '[\\n\\r]', ' ', 'g') AS text FROM documents WHERE text IS NOT NULL UNION ALL VALUES (-1, 'שלום abc'), (-2, '12 .'), (-3, 'мир'), (-4, 'ab мир')),
s AS (SELECT doc_id, list_reverse_sort([{_SCRIPTS}])[1] AS b FROM t)
SELECT doc_id, CASE WHEN b.n > 0 THEN b.tag ELSE 'Latn' END AS script, CASE WHEN b.n > 0 AND b.tag IN ('Arab', 'Hebr', 'Syrc', 'Thaa') THEN 'rtl' ELSE 'ltr' END AS direction FROM s""")
def q_script_direction(spark, sf_dir):
    docs = table(spark, sf_dir, "documents").where("text IS NOT NULL").select("doc_id", "text")
    more = spark.createDataFrame([(-1, "שלום abc"), (-2, "12 ."), (-3, "мир"), (-4, "ab мир")], "doc_id long, text string")
    found = docs.unionByName(more).select("doc_id", marks.script_of(F.col("text")).alias("script"))
    return found.select("doc_id", "script", marks.direction_of(F.col("script")).alias("direction"))


EDGES = [0, 20, 40, 80, 160, 320]


@query("line_slots", _LINES + f"SELECT doc_id, line, CAST(greatest(0, least({len(EDGES) - 2}, len(list_filter({EDGES}, lambda e: e < length(text))) - 1)) AS BIGINT) AS slot FROM l")
def q_line_slots(spark, sf_dir):
    """Line lengths stand in for the positions that table edges part."""
    edges = F.array(*map(F.lit, EDGES))
    return _lines(spark, sf_dir).select("doc_id", "line", marks.slot(edges, F.length("text")).cast("long").alias("slot"))


_BOXES = _LINES + ", b AS (SELECT doc_id, line, line % 7 AS x0, 10 * line AS y0, line % 7 + length(text) AS x1, 10 * line + 8 + 4 * (length(text) % 2) AS y1 FROM l)"


def _boxes(spark, sf_dir):
    n, line = F.length("text").cast("long"), F.col("line")
    box = F.struct((line % 7).alias("x0"), (10 * line).alias("y0"), (line % 7 + n).alias("x1"), (10 * line + 8 + 4 * (n % 2)).alias("y1"))
    return _lines(spark, sf_dir).select("doc_id", "line", box.alias("box"))


@query("box_bounds", _BOXES + "SELECT doc_id, min(x0) AS x0, min(y0) AS y0, max(x1) AS x1, max(y1) AS y1 FROM b GROUP BY 1")
def q_box_bounds(spark, sf_dir):
    """Union of the boxes of a document's lines (extents by length)."""
    return _boxes(spark, sf_dir).groupBy("doc_id").agg(boxes.bounds(F.col("box")).alias("b")).select("doc_id", "b.*")


@query("box_overlaps", _BOXES + """, p AS (SELECT doc_id, line, greatest(x0, lag(x0) OVER w) AS x0, greatest(y0, lag(y0) OVER w) AS y0, least(x1, lag(x1) OVER w) AS x1, least(y1, lag(y1) OVER w) AS y1,
lag(line) OVER w AS before FROM b WINDOW w AS (PARTITION BY doc_id ORDER BY line)) SELECT doc_id, line, x0, y0, x1, y1 FROM p WHERE before IS NOT NULL AND x0 <= x1 AND y0 <= y1""")
def q_box_overlaps(spark, sf_dir):
    """Overlap of each line's box with that of the line before."""
    before = F.lag("box").over(Window.partitionBy("doc_id").orderBy("line"))
    found = _boxes(spark, sf_dir).withColumn("before", before).where("before IS NOT NULL")
    return found.withColumn("o", boxes.intersection(F.col("box"), F.col("before"))).where("o IS NOT NULL").select("doc_id", "line", "o.*")


@query("gfm_tables", _LINES + """, r AS (SELECT doc_id, line, list_transform(string_split(text, '|'), lambda c: trim(c)) AS cells, line - row_number() OVER (PARTITION BY doc_id ORDER BY line) AS island FROM l WHERE contains(text, ' | ')),
t AS (SELECT doc_id, min(line) AS first, list(cells ORDER BY line) AS rows, max(len(cells)) AS w, flatten(list(cells)) AS c FROM r GROUP BY doc_id, island)
SELECT doc_id, first, len(rows) AS n_rows, w AS n_columns, round(len(list_filter(c, lambda x: x <> '')) / len(c), 6) AS fill,
'|' || repeat('  |', CAST(w AS INT)) || chr(10) || '|' || repeat(' --- |', CAST(w AS INT)) || chr(10) ||
array_to_string(list_transform(rows, lambda x: '|' || array_to_string(list_transform(x, lambda y: ' ' || y || ' |'), '') || repeat('  |', CAST(w - len(x) AS INT))), chr(10)) AS markdown FROM t""")
def q_gfm_tables(spark, sf_dir):
    """Consecutive lines of cells between bars as tables, with their fill and Markdown."""
    return grids.tables(_lines(spark, sf_dir))


@query("kerning_source", """WITH o AS (SELECT l_orderkey, round(100 * l_discount, 6) AS v, CASE WHEN l_linenumber % 3 > 0 THEN round(100 * l_tax, 6) END AS f FROM lineitem),
c AS (SELECT l_orderkey, count(*) FILTER (abs(v) > 0) AS a, count(*) FILTER (abs(v) > 0 AND abs(v - f) <= 1) AS m FROM o GROUP BY 1)
SELECT l_orderkey, CASE WHEN a = 0 THEN 'none' WHEN 2 * m > a THEN 'font' ELSE 'producer' END AS source FROM c""")
def q_kerning_source(spark, sf_dir):
    """Discounts stand in for adjustments in a text, taxes for the font's own kerning (unknown in every third line)."""
    v, f = F.round(100 * F.col("l_discount"), 6), F.when(F.col("l_linenumber") % 3 > 0, F.round(100 * F.col("l_tax"), 6))
    adjusted = F.abs(v) > 0
    counts = table(spark, sf_dir, "lineitem").groupBy("l_orderkey").agg(F.count_if(adjusted).alias("a"), F.count_if(adjusted & (F.abs(v - f) <= 1)).alias("m"))
    return counts.select("l_orderkey", F.when(F.col("a") == 0, "none").when(2 * F.col("m") > F.col("a"), "font").otherwise("producer").alias("source"))


@query("reading_divergence", f"""WITH n AS (SELECT doc_id, trim(regexp_replace(coalesce(text, ''), '[{_WHITE}]+', ' ', 'g')) AS t FROM documents),
p AS (SELECT x.doc_id AS a, y.doc_id AS b, x.t AS ta, y.t AS tb FROM n x JOIN n y ON y.doc_id = x.doc_id + 1 WHERE x.t <> y.t),
c AS (SELECT doc_id, unnest(string_split(t, '')) AS ch, generate_subscripts(string_split(t, ''), 1) AS pos FROM n),
d AS (SELECT x.doc_id AS a, min(x.pos) - 1 AS i FROM c x JOIN c y ON y.doc_id = x.doc_id + 1 AND y.pos = x.pos WHERE x.ch <> y.ch GROUP BY 1),
q AS (SELECT p.*, coalesce(d.i, least(length(ta), length(tb))) AS i FROM p LEFT JOIN d USING (a))
SELECT a, b, CAST(i AS BIGINT) AS first_difference, substr(ta, CAST(greatest(i - 30, 0) + 1 AS INT), 90) AS before, substr(tb, CAST(greatest(i - 30, 0) + 1 AS INT), 90) AS after FROM q""")
def q_reading_divergence(spark, sf_dir):
    """Where the whole texts of neighbouring documents first differ, with a window of 90 characters."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            rows = []
            for a, b, x, y in batch.itertuples(index=False, name=None):
                low, high = 0, min(len(x), len(y))  # halving: equal slices are compared at the speed of memory
                while low < high:
                    mid = (low + high + 1) // 2
                    low, high = (mid, high) if x[low:mid] == y[low:mid] else (low, mid - 1)
                begin = max(0, low - 30)
                rows.append((a, b, low, x[begin : begin + 90], y[begin : begin + 90]))
            yield pd.DataFrame(rows, columns=["a", "b", "first_difference", "before", "after"])

    text = F.trim(F.regexp_replace(F.coalesce("text", F.lit("")), f"[{marks.WHITE}]+", " "))
    docs = table(spark, sf_dir, "documents").select("doc_id", text.alias("x"))
    after = docs.select((F.col("doc_id") - 1).alias("doc_id"), F.col("x").alias("y"))
    pairs = docs.join(after, "doc_id").where("x <> y").select(F.col("doc_id").alias("a"), (F.col("doc_id") + 1).alias("b"), "x", "y")
    return pairs.mapInPandas(run, "a long, b long, first_difference long, before string, after string")
