"""Trees of blocks, kept as a flat table, to Markdown: levels are joined one by one, and each block becomes a piece of its page."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .support import positions

DEPTH = 3
RICH = "array<struct<plain_text:string,code:boolean,bold:boolean,italic:boolean,strikethrough:boolean,link:string>>"


def rich_text(parts: Column) -> Column:
    """Runs of text with their marks, the innermost first: code, bold, italic, struck out, linked."""

    def run(r: Column) -> Column:
        text = r["plain_text"]
        for name, mark in (("code", "`"), ("bold", "**"), ("italic", "*"), ("strikethrough", "~~")):
            text = F.when(F.coalesce(r[name], F.lit(False)), F.concat(F.lit(mark), text, F.lit(mark))).otherwise(text)
        linked = F.coalesce(r["link"], F.lit("")) != ""
        return F.when(F.coalesce(r["plain_text"], F.lit("")) == "", "").when(linked, F.concat(F.lit("["), text, F.lit("]("), r["link"], F.lit(")"))).otherwise(text)

    return F.coalesce(F.array_join(F.transform(parts, run), ""), F.lit(""))


def line(depth: Column) -> Column:
    """The Markdown of a block (type, rich_text, caption, checked, language, url, title); empty paragraphs give nothing."""
    kind, text, caption = F.coalesce("type", F.lit("")), rich_text(F.col("rich_text")), rich_text(F.col("caption"))
    url, item = F.coalesce("url", F.lit("")), lambda mark: F.concat(F.repeat(F.lit("  "), depth), F.lit(mark), text)
    return (
        F.when(kind.isin("paragraph", "toggle"), text)
        .when(kind == "heading_1", F.concat(F.lit("# "), text)).when(kind == "heading_2", F.concat(F.lit("## "), text)).when(kind == "heading_3", F.concat(F.lit("### "), text))
        .when(kind == "bulleted_list_item", item("- ")).when(kind == "numbered_list_item", item("1. "))
        .when(kind == "to_do", F.when(F.coalesce("checked", F.lit(False)), item("- [x] ")).otherwise(item("- [ ] ")))
        .when(kind.isin("quote", "callout"), F.concat(F.lit("> "), text))
        .when(kind == "code", F.concat(F.lit("```"), F.coalesce("language", F.lit("")), F.lit("\n"), text, F.lit("\n```")))
        .when(kind == "divider", "---")
        .when(kind == "image", F.when(url != "", F.concat(F.lit("!["), caption, F.lit("]("), url, F.lit(")"))).otherwise(F.concat(F.lit("*[Image]* "), caption)))
        .when(kind == "bookmark", F.concat(F.lit("["), F.when(caption != "", caption).otherwise(url), F.lit("]("), url, F.lit(")")))
        .when(kind == "child_page", F.concat(F.lit("### "), F.when(F.coalesce("title", F.lit("")) != "", F.col("title")).otherwise("Untitled page")))
        .otherwise(F.concat(F.lit("<!-- unsupported block: "), kind, F.lit(" -->")))
    )


def render(blocks: DataFrame, path: str) -> DataFrame:
    """(page_id, block_id, depth, position, text): the Markdown of a page as its pieces in order, a blank line between two of them.

    ``blocks`` is (page_id, block_id, parent_id, pos, type, rich_text, caption, checked, language, url, title); a null parent_id is a
    block of the page itself. Children follow their parent, in the order of ``pos`` and id, as deep as three levels below the page's
    own; deeper ones, and those whose parent is not there, are left out, and so are pieces without text. No page is one group.
    """
    own = blocks.withColumn("place", F.struct("pos", "block_id"))
    level = own.where("parent_id IS NULL").withColumn("path", F.array("place"))
    rows = level.select("page_id", "block_id", F.lit(0).alias("depth"), "path", line(F.lit(0)).alias("text"))
    for depth in range(1, DEPTH + 1):
        above = level.select(F.col("page_id").alias("of"), F.col("block_id").alias("above"), F.col("path").alias("before"))
        level = own.join(above, (F.col("page_id").eqNullSafe(F.col("of"))) & (F.col("parent_id") == F.col("above"))).withColumn("path", F.concat("before", F.array("place"))).drop("of", "above", "before")
        rows = rows.unionByName(level.select("page_id", "block_id", F.lit(depth).alias("depth"), "path", line(F.lit(depth)).alias("text")))
    return positions(rows.where("text <> ''"), "page_id", ["path"], path).drop("path")
