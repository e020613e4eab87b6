"""Flow blocks, Markdown, links and metadata of HTML pages by JVM expressions, and blocks of whole pages by a parser."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quirefold.functions import html_tree
from quirefold.functions.scripts import escape_markdown

PAIR = "<(h1|p|li)>([^<]*)</(h1|p|li)>"


def flow_blocks(pages: DataFrame) -> DataFrame:
    """(page_id, seq, kind, text) of the page's h1, p and li elements that hold plain text."""
    found = F.regexp_extract_all("html", F.lit(PAIR), 0)
    rows = pages.select("page_id", F.posexplode(found).alias("seq", "raw"))
    kind = F.regexp_extract("raw", PAIR, 1)
    named = F.when(kind == "h1", "heading").when(kind == "li", "item").otherwise("paragraph")
    return rows.select("page_id", F.col("seq").cast("long").alias("seq"), named.alias("kind"), F.regexp_extract("raw", PAIR, 2).alias("text"))


def tree_blocks(source: str) -> list[tuple[str, int | None, str]]:
    """(kind, level, text) of a page's blocks in order: all its text, with inline markup stripped and references decoded.

    Text in h1 to h6 is a heading with its level, text in li an item, any other text a paragraph.
    """
    out: list[tuple[str, int | None, str]] = []
    run: list[str] = []

    def close(kind):
        text = html_tree.clean("".join(run))
        run.clear()
        if text:
            out.append((*kind, text))

    todo: list = [(html_tree.parse(source), ("paragraph", None), False)]
    while todo:
        part, kind, ends = todo.pop()
        if isinstance(part, str):
            run.append(part)
        elif ends:
            close(kind)
        elif part.tag not in html_tree.BLOCK and part.tag != "html":  # inline: its text belongs to the block around it
            todo.extend((p, kind, False) for p in reversed(part.parts))
        else:
            tag, around = part.tag, kind
            close(around)
            if tag in ("h1", "h2", "h3", "h4", "h5", "h6"):
                kind = ("heading", int(tag[1]))
            elif tag == "li":
                kind = ("item", None)
            todo.append((part, kind, True))
            todo.extend((p, kind, False) for p in reversed(part.parts))
    return out


def page_blocks(pages: DataFrame) -> DataFrame:
    """(page_id, seq, kind, level, text) of whole pages, whatever the attributes, inner tags and missing end tags."""

    def read(batches):
        for batch in batches:
            for page_id, source in zip(batch["page_id"], batch["html"], strict=True):
                rows = [(page_id, i, *b) for i, b in enumerate(tree_blocks(source))]
                if rows:
                    yield pd.DataFrame(rows, columns=["page_id", "seq", "kind", "level", "text"]).astype({"page_id": "Int64", "level": "Int32"})

    picked = pages.select("page_id", F.coalesce("html", F.lit("")).alias("html"))
    return picked.mapInPandas(read, "page_id long, seq long, kind string, level int, text string")


def markdown(blocks: DataFrame) -> DataFrame:
    """(page_id, markdown): blocks in order, a blank line between them; headings have level 1 unless a column says otherwise."""
    text = escape_markdown(F.col("text"))
    mark = F.repeat(F.lit("#"), F.col("level")) if "level" in blocks.columns else F.lit("#")
    line = F.when(F.col("kind") == "heading", F.concat(mark, F.lit(" "), text)).when(F.col("kind") == "item", F.concat(F.lit("- "), text)).otherwise(text)
    rows = blocks.select("page_id", F.struct("seq", line.alias("line")).alias("b"))
    return rows.groupBy("page_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list("b")), lambda b: b["line"]), "\n\n").alias("markdown"))


def dangling_links(pages: DataFrame) -> DataFrame:
    """(page_id, href, target) of links whose target, resolved against the page's host, is no known page."""
    base = F.regexp_extract("url", "^([a-z]+://[^/]+)", 1)
    links = pages.select("page_id", base.alias("base"), F.explode(F.regexp_extract_all("html", F.lit('href="([^"]*)"'), 1)).alias("href")).distinct()
    target = F.when(F.startswith("href", F.lit("/")), F.concat("base", "href")).otherwise(F.col("href"))
    links = links.select("page_id", "href", target.alias("target"))
    return links.join(pages.select(F.col("url").alias("target")).distinct(), "target", "left_anti").select("page_id", "href", "target")
