"""Queries over the text of `documents`: lines, running lines, words."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from quirefold.functions import scripts, stats
from quirefold.operators import compare, geometry, html_blocks, lines
from quirefold.plans.registry import query
from quirefold.session import table

LINES_SQL = """
WITH l AS (SELECT doc_id, unnest(string_split(text, chr(10))) AS line,
                  generate_subscripts(string_split(text, chr(10)), 1) - 1 AS line_no FROM documents)
SELECT doc_id, CAST(line_no AS BIGINT) AS line_no, line FROM l WHERE length(line) > 0
"""


@query("lines", LINES_SQL)
def q_lines(spark, sf_dir):
    return lines.split_lines(table(spark, sf_dir, "documents"))


@query(
    "running_lines",
    """
WITH l AS (SELECT doc_id, unnest(string_split(text, chr(10))) AS line FROM documents),
t AS (SELECT doc_id, regexp_replace(line, '[0-9]+', '{}', 'g') AS template FROM l WHERE length(line) > 0)
SELECT template, count(DISTINCT doc_id) AS n_docs, count(*) AS n_lines FROM t GROUP BY 1 HAVING count(DISTINCT doc_id) >= 3
""",
)
def q_running_lines(spark, sf_dir):
    return lines.running_lines(lines.split_lines(table(spark, sf_dir, "documents")), F.col("doc_id"))


@query("body_lines", """
WITH l AS (SELECT doc_id, unnest(string_split(text, chr(10))) AS line, generate_subscripts(string_split(text, chr(10)), 1) - 1 AS line_no FROM documents),
t AS (SELECT *, regexp_replace(line, '[0-9]+', '{}', 'g') AS template FROM l WHERE length(line) > 0),
r AS (SELECT template FROM t GROUP BY 1 HAVING count(DISTINCT doc_id) >= 3)
SELECT doc_id, CAST(line_no AS BIGINT) AS line_no, line FROM t ANTI JOIN r USING (template)""")
def q_body_lines(spark, sf_dir):
    """Lines that aren't running lines."""
    found = lines.split_lines(table(spark, sf_dir, "documents"))
    running = lines.running_lines(found, F.col("doc_id")).select("template")
    return found.withColumn("template", lines.template(F.col("line"))).join(running, "template", "left_anti").select("doc_id", "line_no", "line")


@query("words_per_doc", """
SELECT doc_id, CAST(len(list_filter(string_split_regex(text, '[ \\t\\n\\r]+'), lambda x: length(x) > 0)) AS BIGINT) AS n_words FROM documents""")
def q_words_per_doc(spark, sf_dir):
    words = F.filter(F.split("text", "[ \\t\\n\\r]+"), lambda w: F.length(w) > 0)
    return table(spark, sf_dir, "documents").select("doc_id", F.size(words).cast("long").alias("n_words"))


@query("dominant_script", """
WITH c AS (SELECT doc_id, len(regexp_extract_all(text, '[\\x{3040}-\\x{30ff}\\x{3400}-\\x{4dbf}\\x{4e00}-\\x{9fff}\\x{ac00}-\\x{d7af}\\x{f900}-\\x{faff}]')) AS cjk,
 len(regexp_extract_all(text, '[\\x{0e00}-\\x{0eff}\\x{1000}-\\x{109f}\\x{1780}-\\x{17ff}]')) AS cont, len(regexp_extract_all(text, '[\\x{0590}-\\x{08ff}\\x{fb1d}-\\x{fdff}\\x{fe70}-\\x{feff}]')) AS rtl,
 len(regexp_extract_all(text, '[A-Za-z\\x{00c0}-\\x{058f}\\x{1e00}-\\x{1fff}]')) AS sp FROM documents)
SELECT doc_id, CASE WHEN greatest(cjk, cont, rtl, sp) = 0 THEN 'neutral' WHEN cjk = greatest(cjk, cont, rtl, sp) THEN 'cjk' WHEN cont = greatest(cjk, cont, rtl, sp) THEN 'continuous'
 WHEN rtl = greatest(cjk, cont, rtl, sp) THEN 'rtl' ELSE 'spaced' END AS script FROM c""")
def q_dominant_script(spark, sf_dir):
    return table(spark, sf_dir, "documents").select("doc_id", scripts.dominant(F.col("text")).alias("script"))


@query("upper_median_len", """
WITH l AS (SELECT doc_id, list_sort(list_transform(list_filter(string_split(text, chr(10)), lambda x: length(x) > 0), lambda x: length(x))) AS v FROM documents)
SELECT doc_id, CAST(v[len(v) // 2 + 1] AS BIGINT) AS median_len FROM l""")
def q_upper_median(spark, sf_dir):
    sizes = F.transform(F.filter(F.split("text", "\n"), lambda x: F.length(x) > 0), F.length)
    return table(spark, sf_dir, "documents").select("doc_id", stats.upper_median(sizes).cast("long").alias("median_len"))


@query("modal_len", """
WITH l AS (SELECT doc_id, length(unnest(string_split(text, chr(10)))) AS n FROM documents), c AS (SELECT doc_id, n, count(*) AS c FROM l WHERE n > 0 GROUP BY 1, 2)
SELECT doc_id, CAST(n AS BIGINT) AS modal_len FROM c QUALIFY row_number() OVER (PARTITION BY doc_id ORDER BY c DESC, n) = 1""")
def q_modal_len(spark, sf_dir):
    """Most frequent line length, ties to the smaller."""
    found = lines.split_lines(table(spark, sf_dir, "documents")).groupBy("doc_id", F.length("line").cast("long").alias("n")).agg(F.count("*").alias("c"))
    return found.groupBy("doc_id").agg((-F.max(F.struct("c", (-F.col("n")).alias("m")))["m"]).alias("modal_len"))


@query("heading_ladder", """
WITH l AS (SELECT DISTINCT doc_id, length(unnest(string_split(text, chr(10)))) AS n FROM documents)
SELECT doc_id, CAST(n AS BIGINT) AS size, CAST(least(dense_rank() OVER (PARTITION BY doc_id ORDER BY n DESC), 6) AS BIGINT) AS level FROM l WHERE n > 0""")
def q_heading_ladder(spark, sf_dir):
    """Distinct sizes (here line lengths) of a document, largest first, as levels up to 6."""
    sizes = lines.split_lines(table(spark, sf_dir, "documents")).select("doc_id", F.length("line").cast("long").alias("size")).distinct()
    rank = F.dense_rank().over(Window.partitionBy("doc_id").orderBy(F.desc("size")))
    return sizes.select("doc_id", "size", F.least(rank, F.lit(6)).cast("long").alias("level"))


@query("line_islands", """
WITH l AS (SELECT doc_id, unnest(string_split(text, chr(10))) AS line, generate_subscripts(string_split(text, chr(10)), 1) - 1 AS i FROM documents),
g AS (SELECT doc_id, i, CASE WHEN length(line) > 1.3 * lag(length(line)) OVER (PARTITION BY doc_id ORDER BY i) THEN 1 ELSE 0 END AS s FROM l WHERE length(line) > 0)
SELECT doc_id, CAST(i AS BIGINT) AS line_no, CAST(sum(s) OVER (PARTITION BY doc_id ORDER BY i) AS BIGINT) AS island FROM g""")
def q_line_islands(spark, sf_dir):
    """Groups of lines, a new one where the length jumps by 1.3."""
    w = Window.partitionBy("doc_id").orderBy("line_no")
    marked = lines.split_lines(table(spark, sf_dir, "documents")).withColumn("s", F.when(F.length("line") > 1.3 * F.lag(F.length("line")).over(w), 1).otherwise(0))
    return marked.select("doc_id", "line_no", F.sum("s").over(w).alias("island"))


@query("hyphenation", """
WITH l AS (SELECT doc_id, unnest(string_split(text, chr(10))) AS line, generate_subscripts(string_split(text, chr(10)), 1) AS i FROM documents),
n AS (SELECT doc_id, line, lead(line) OVER (PARTITION BY doc_id ORDER BY i) AS nx FROM l WHERE length(line) > 0)
SELECT doc_id, coalesce(bool_or(regexp_matches(line, '[-\\x{AD}]$') AND regexp_matches(nx, '^[a-z]')), false) AS hyphenated FROM n GROUP BY 1""")
def q_hyphenation(spark, sf_dir):
    nxt = F.lead("line").over(Window.partitionBy("doc_id").orderBy("line_no"))
    marked = lines.split_lines(table(spark, sf_dir, "documents")).select("doc_id", "line", nxt.alias("nx"))
    broken = F.col("line").rlike("[-\\u00AD]$") & F.col("nx").rlike("^[a-z]")
    return marked.groupBy("doc_id").agg(F.coalesce(F.bool_or(broken), F.lit(False)).alias("hyphenated"))


@query("html_flow_blocks", """
WITH b AS (SELECT page_id, regexp_extract_all(html, '<(h1|p|li)>([^<]*)</(h1|p|li)>') AS r FROM pages),
u AS (SELECT page_id, unnest(r) AS raw, generate_subscripts(r, 1) - 1 AS seq FROM b)
SELECT page_id, CAST(seq AS BIGINT) AS seq, CASE WHEN raw LIKE '<h1>%' THEN 'heading' WHEN raw LIKE '<li>%' THEN 'item' ELSE 'paragraph' END AS kind,
 regexp_extract(raw, '<(h1|p|li)>([^<]*)</(h1|p|li)>', 2) AS text FROM u""")
def q_html_flow_blocks(spark, sf_dir):
    return html_blocks.flow_blocks(table(spark, sf_dir, "pages"))


@query("markdown", """
WITH b AS (SELECT page_id, regexp_extract_all(html, '<(h1|p|li)>([^<]*)</(h1|p|li)>') AS r FROM pages),
u AS (SELECT page_id, unnest(r) AS raw, generate_subscripts(r, 1) AS seq FROM b),
t AS (SELECT page_id, seq, CASE WHEN raw LIKE '<h1>%' THEN '# ' WHEN raw LIKE '<li>%' THEN '- ' ELSE '' END ||
 regexp_replace(regexp_extract(raw, '<(h1|p|li)>([^<]*)</(h1|p|li)>', 2), '([\\\\`*_\\[\\]<>])', '\\\\\\1', 'g') AS line FROM u)
SELECT page_id, string_agg(line, chr(10) || chr(10) ORDER BY seq) AS markdown FROM t GROUP BY 1""")
def q_markdown(spark, sf_dir):
    return html_blocks.markdown(html_blocks.flow_blocks(table(spark, sf_dir, "pages")))


@query("html_page_blocks")
def q_html_page_blocks(spark, sf_dir):
    """All blocks of whole pages; the SQL of html_flow_blocks takes only h1, p and li without attributes and inner tags."""
    return html_blocks.page_blocks(table(spark, sf_dir, "pages"))


@query("page_markdown")
def q_page_markdown(spark, sf_dir):
    return html_blocks.markdown(html_blocks.page_blocks(table(spark, sf_dir, "pages")))


@query("metadata_disagreement", """
WITH m AS (SELECT page_id, regexp_extract(html, '<title>([^<]*)</title>', 1) AS title, regexp_extract(html, '<h1>([^<]*)</h1>', 1) AS heading FROM pages)
SELECT page_id, title, heading FROM m WHERE title <> '' AND heading <> '' AND title <> heading""")
def q_metadata_disagreement(spark, sf_dir):
    """Pages whose two titles both have a value and differ."""
    both = table(spark, sf_dir, "pages").select("page_id", F.regexp_extract("html", "<title>([^<]*)</title>", 1).alias("title"), F.regexp_extract("html", "<h1>([^<]*)</h1>", 1).alias("heading"))
    return both.where("title <> '' AND heading <> '' AND title <> heading")


@query("dangling_links", """
WITH l AS (SELECT DISTINCT page_id, regexp_extract(url, '^([a-z]+://[^/]+)', 1) AS base, unnest(regexp_extract_all(html, 'href="([^"]*)"', 1)) AS href FROM pages),
t AS (SELECT page_id, href, CASE WHEN href LIKE '/%' THEN base || href ELSE href END AS target FROM l)
SELECT page_id, href, target FROM t WHERE target NOT IN (SELECT url FROM pages WHERE url IS NOT NULL)""")
def q_dangling_links(spark, sf_dir):
    return html_blocks.dangling_links(table(spark, sf_dir, "pages"))


@query("degenerate_text", """
WITH c AS (SELECT doc_id, unnest(string_split(text, '')) AS ch FROM documents), n AS (SELECT doc_id, ch, count(*) AS n FROM c GROUP BY 1, 2)
SELECT doc_id, max(n) / sum(n) > 0.7 AND sum(n) >= 20 AS degenerate FROM n GROUP BY 1""")
def q_degenerate(spark, sf_dir):
    """Whether one character makes up more than 0.7 of at least 20."""
    counts = compare.char_counts(table(spark, sf_dir, "documents"), ["doc_id"])
    return counts.groupBy("doc_id").agg(((F.max("n") / F.sum("n") > 0.7) & (F.sum("n") >= 20)).alias("degenerate"))


@query("char_similarity", """
WITH p AS (SELECT a.doc_id AS a, b.doc_id AS b, a.text AS ta, b.text AS tb FROM documents a JOIN documents b ON b.doc_id = a.doc_id + 1),
c AS (SELECT a, b, ch, sum(1 - s) AS na, sum(s) AS nb FROM (SELECT a, b, unnest(string_split(ta, '')) AS ch, 0 AS s FROM p UNION ALL SELECT a, b, unnest(string_split(tb, '')), 1 FROM p) GROUP BY 1, 2, 3)
SELECT a, b, round(2 * sum(least(na, nb)) / (sum(na) + sum(nb)), 6) AS similarity, round(sum(least(na, nb)) / sum(na), 6) AS containment FROM c GROUP BY 1, 2""")
def q_char_similarity(spark, sf_dir):
    """Shared characters of each document and the next one."""
    return compare.similarity_to_next(table(spark, sf_dir, "documents"))


@query("doc_compare", """
WITH p AS (SELECT doc_id AS a, doc_id + 1 AS b FROM documents), l AS (SELECT doc_id, unnest(string_split(text, chr(10))) AS line, generate_subscripts(string_split(text, chr(10)), 1) AS i FROM documents),
k AS (SELECT * FROM l WHERE length(line) > 0), x AS (SELECT a, b, i, line FROM p JOIN k ON doc_id = a), y AS (SELECT a, b, i, line FROM p JOIN k ON doc_id = b)
SELECT a, b, count(*) FILTER (x.line IS NULL) AS added, count(*) FILTER (y.line IS NULL) AS removed, count(*) FILTER (x.line <> y.line) AS changed FROM x FULL JOIN y USING (a, b, i) GROUP BY 1, 2""")
def q_doc_compare(spark, sf_dir):
    """Differences by position between each document and the next one."""
    docs = table(spark, sf_dir, "documents")
    return compare.line_differences(lines.split_lines(docs), docs.select(F.col("doc_id").alias("a"), (F.col("doc_id") + 1).alias("b")))


@query("page_drift", """
SELECT source, CAST(sum(n_chars) AS BIGINT) AS before, CAST(sum(length(replace(text, ' ', ''))) AS BIGINT) AS after,
 round(CASE WHEN sum(n_chars) = 0 THEN 0 ELSE (sum(length(replace(text, ' ', ''))) - sum(n_chars)) / sum(n_chars) END, 6) AS drift FROM documents GROUP BY 1""")
def q_page_drift(spark, sf_dir):
    """Relative change of characters per source when spaces go."""
    before, after = F.sum("n_chars"), F.sum(F.length(F.replace("text", F.lit(" "), F.lit(""))))
    drift = stats.rounded(F.when(before == 0, 0.0).otherwise((after - before) / before), 6)
    return table(spark, sf_dir, "documents").groupBy("source").agg(before.alias("before"), after.alias("after"), drift.alias("drift"))


@query("redact", """
SELECT doc_id, replace(text, 'the', '###') AS text, CAST((length(text) - length(replace(text, 'the', ''))) // 3 AS BIGINT) AS n_redacted, NOT contains(replace(text, 'the', '###'), 'the') AS verified FROM documents""")
def q_redact(spark, sf_dir):
    """Every occurrence of a literal struck out, and the result searched again."""
    out = F.replace("text", F.lit("the"), F.lit("###"))
    count = ((F.length("text") - F.length(F.replace("text", F.lit("the"), F.lit("")))) / 3).cast("long")
    return table(spark, sf_dir, "documents").select("doc_id", out.alias("text"), count.alias("n_redacted"), (~F.contains(out, F.lit("the"))).alias("verified"))


@query("document_kind", """
SELECT source, CASE WHEN bool_and(length(text) < 200) THEN 'scanned' WHEN bool_or(length(text) < 200) THEN 'mixed' ELSE 'born-digital' END AS kind FROM documents GROUP BY 1""")
def q_document_kind(spark, sf_dir):
    """Kind of a group of pages from their flags (here texts under 200 characters)."""
    flag = F.length("text") < 200
    kind = F.when(F.bool_and(flag), "scanned").when(F.bool_or(flag), "mixed").otherwise("born-digital")
    return table(spark, sf_dir, "documents").groupBy("source").agg(kind.alias("kind"))


@query("confidence", """
WITH c AS (SELECT doc_id, length(text) AS t, len(regexp_extract_all(text, '[ -~]')) AS m FROM documents)
SELECT doc_id, CASE WHEN t = 0 OR m = 0 THEN 'none' WHEN m = t THEN 'exact' ELSE 'partial' END AS confidence FROM c""")
def q_confidence(spark, sf_dir):
    total, mapped = F.length("text"), F.regexp_count("text", F.lit("[ -~]"))
    return table(spark, sf_dir, "documents").select("doc_id", scripts.confidence(total, mapped, mapped).alias("confidence"))


@query("coverage_latin", """
WITH c AS (SELECT doc_id, unnest(string_split(text, '')) AS ch FROM documents)
SELECT doc_id, count(DISTINCT ch) FILTER (regexp_matches(ch, '^[ -~]$')) AS covered FROM c GROUP BY 1""")
def q_coverage(spark, sf_dir):
    """Distinct printable ASCII characters of a document."""
    distinct = F.array_distinct(F.filter(F.split("text", ""), lambda c: c.rlike("^[ -~]$")))
    return table(spark, sf_dir, "documents").select("doc_id", F.size(distinct).cast("long").alias("covered"))


@query("tag_findings", """
SELECT coalesce(l.doc_id, d.doc_id) AS doc_id, CASE WHEN d.doc_id IS NULL THEN 'dangling' ELSE 'unclaimed' END AS finding
FROM labels l FULL JOIN documents d USING (doc_id) WHERE l.doc_id IS NULL OR d.doc_id IS NULL""")
def q_tag_findings(spark, sf_dir):
    """Keys that only one side knows."""
    a = table(spark, sf_dir, "labels").select("doc_id", F.lit(1).alias("l"))
    b = table(spark, sf_dir, "documents").select("doc_id", F.lit(1).alias("d"))
    both = a.join(b, "doc_id", "full_outer").where("l IS NULL OR d IS NULL")
    return both.select("doc_id", F.when(F.col("d").isNull(), "dangling").otherwise("unclaimed").alias("finding"))


@query("greedy_break")
def q_greedy_break(spark, sf_dir):
    """First-fit lines of 60 characters; sequential, so tested against a plain loop."""
    docs = table(spark, sf_dir, "documents")
    return docs.select("doc_id", F.posexplode(stats.greedy_breaks(F.regexp_replace("text", "\n", " "), 60)).alias("line_no", "line"))


@query("interval_gap", """
WITH l AS (SELECT doc_id, length(unnest(string_split(text, chr(10)))) AS n, generate_subscripts(string_split(text, chr(10)), 1) - 1 AS i FROM documents),
s AS (SELECT doc_id, 3 * n AS b, 3 * n + i + 1 AS e FROM l WHERE n > 0),
r AS (SELECT doc_id, b, max(e) OVER (PARTITION BY doc_id ORDER BY b, e ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS reach FROM s)
SELECT doc_id, CAST(b - reach AS BIGINT) AS gap, CAST(reach + (b - reach) / 2 AS DOUBLE) AS middle FROM r WHERE b > reach
QUALIFY row_number() OVER (PARTITION BY doc_id ORDER BY b - reach DESC, reach) = 1""")
def q_interval_gap(spark, sf_dir):
    """Widest empty band among extents made of line lengths."""
    size = F.length("line").cast("long")
    spans = lines.split_lines(table(spark, sf_dir, "documents")).select("doc_id", (3 * size).alias("begin"), (3 * size + F.col("line_no") + 1).alias("end"))
    return geometry.widest_gap(spans)


@query("splice", """
SELECT doc_id, substr(text, 1, 5) || '<cut>' || substr(text, 11) AS text, CAST(CASE WHEN n_chars <= 5 THEN n_chars WHEN n_chars >= 10 THEN n_chars END AS BIGINT) AS end_after FROM documents WHERE length(text) >= 10""")
def q_splice(spark, sf_dir):
    """Characters 5 to 10 replaced, and where the old end of the text lies now."""
    docs = table(spark, sf_dir, "documents").where(F.length("text") >= 10)
    five, ten = F.lit(5), F.lit(10)
    return docs.select("doc_id", geometry.splice(F.col("text"), five, ten, F.lit("<cut>")).alias("text"), geometry.remap(F.col("n_chars"), five, ten, F.lit(5)).cast("long").alias("end_after"))


@query("order_moved", """
WITH l AS (SELECT doc_id, list_filter(string_split(text, chr(10)), lambda x: length(x) > 0) AS v FROM documents WHERE length(replace(text, chr(10), '')) > 0)
SELECT a.doc_id AS a, b.doc_id AS b, list_sort(a.v) = list_sort(b.v) AS same_lines,
 CAST(CASE WHEN list_sort(a.v) = list_sort(b.v) THEN len(list_filter(range(1, len(a.v) + 1), lambda i: a.v[i] <> b.v[i])) ELSE 0 END AS BIGINT) AS moved
FROM l a JOIN l b ON b.doc_id = a.doc_id + 1""")
def q_order_moved(spark, sf_dir):
    docs = table(spark, sf_dir, "documents")
    return geometry.order_moved(lines.split_lines(docs), docs.select(F.col("doc_id").alias("a"), (F.col("doc_id") + 1).alias("b")))


@query("substitute_score", """
WITH s AS (SELECT p_brand AS key, p_partkey AS candidate, abs(p_size - 20) + 2 * abs(p_partkey % 7 - 3) AS score FROM part)
SELECT key, candidate AS best, CAST(score AS BIGINT) AS score, lead(candidate) OVER (PARTITION BY key ORDER BY score, candidate) AS runner_up FROM s
QUALIFY row_number() OVER (PARTITION BY key ORDER BY score, candidate) = 1""")
def q_substitute_score(spark, sf_dir):
    """Weighted penalty and best match; `part` only carries the numbers."""
    score = (F.abs(F.col("p_size") - 20) + 2 * F.abs(F.col("p_partkey") % 7 - 3)).cast("long")
    return geometry.best_match(table(spark, sf_dir, "part").select(F.col("p_brand").alias("key"), F.col("p_partkey").alias("candidate"), score.alias("score")))


@query("containment", """
WITH b AS (SELECT ch, count(*) AS nb FROM (SELECT unnest(string_split(text, '')) AS ch FROM benchmark WHERE item_id = (SELECT min(item_id) FROM benchmark)) GROUP BY 1),
d AS (SELECT doc_id, ch, count(*) AS n FROM (SELECT doc_id, unnest(string_split(text, '')) AS ch FROM documents) GROUP BY 1, 2)
SELECT doc_id, round(sum(least(n, coalesce(nb, 0))) / sum(n), 6) AS containment FROM d LEFT JOIN b USING (ch) GROUP BY 1""")
def q_containment(spark, sf_dir):
    """Share of a document's characters that the first benchmark item holds."""
    items = table(spark, sf_dir, "benchmark")
    first = items.join(F.broadcast(items.agg(F.min("item_id").alias("item_id"))), "item_id")
    chars = compare.char_counts(first.withColumn("k", F.lit(0)), ["k"]).select("ch", F.col("n").alias("nb"))
    own = compare.char_counts(table(spark, sf_dir, "documents"), ["doc_id"])
    share = F.sum(F.least("n", F.coalesce("nb", F.lit(0)))) / F.sum("n")
    return own.join(F.broadcast(chars), "ch", "left").groupBy("doc_id").agg(stats.rounded(share, 6).alias("containment"))


@query("containment_items")
def q_containment_items(spark, sf_dir):
    """Every document against every benchmark item; the SQL of containment takes the first item only."""
    return compare.containment_in_items(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
