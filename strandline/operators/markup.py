"""Sections as one stream of items: text lines and tables in page order, so that a table knows the lines before it and text outside
tables is kept. Everything of one section is an array expression of its row (references are decoded in Python); only the rank of tables is a shuffle.

A null or empty body has no items. A table without a filled cell stays an item (it separates lines) but gives no rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from strandline.functions.scalar import decode_entities
from strandline.operators.corpus import BLOCK, DROPPED, unit_near

# Fixed value: lines before a table that may name its unit.
UNIT_REACH = 2
TABLES, ROWS, CELLS = "table|ul|ol", "tr|li", "t[dhe]|tu"
# Marks between parts, before a table, between its rows and between cells: noncharacters, which a body loses first and no character
# reference decodes to.
PART, TABLE, ROW, CELL = "\ufdd0", "\ufdd1", "\ufdd2", "\ufdd3"
MARKS = f"[{PART}{TABLE}{ROW}{CELL}]"


def _inner(text: Column, tags: str) -> Column:
    return F.regexp_extract_all(text, F.lit(rf"(?is)<(?:{tags})\b[^>]*>(.*?)</(?:{tags})>"), F.lit(1))


def _plain(markup: Column, block: str) -> Column:
    """Markup without tags, block tags as `block`."""
    return F.regexp_replace(F.regexp_replace(markup, BLOCK, block), r"<[^>]*>", " ")


def _clean(text: Column) -> Column:
    return F.trim(F.regexp_replace(text, r"\s+", " "))


def _encoded(part: Column) -> Column:
    """One part as text that only lacks its character references: lines, or the rows and cells of a table behind a mark."""
    rows = F.transform(_inner(part, ROWS), lambda r: F.array_join(F.transform(
        F.when(r.rlike(rf"(?i)<(?:{CELLS})\b"), _inner(r, CELLS)).otherwise(F.array(r)), lambda c: _plain(c, " ")), CELL))
    return F.when(part.startswith(TABLE), F.concat(F.lit(TABLE), F.array_join(rows, ROW))).otherwise(_plain(part, "\n"))


def items_of(body: Column, tables: str = TABLES) -> Column:
    """array<struct<is_table, text, rows>>: single-spaced lines, and tables as their rows that hold a filled cell.

    A row without cell tags is one cell. Parts are marked by noncharacters, so that the character references of a whole
    body are decoded at once."""
    bare = F.regexp_replace(F.regexp_replace(F.coalesce(body, F.lit("")), MARKS, ""), DROPPED, "")
    parts = F.split(F.regexp_replace(bare, rf"(?is)(<(?:{tables})\b[^>]*>.*?</(?:{tables})>)", f"{PART}{TABLE}$1{PART}"), PART)
    decoded = decode_entities(F.array_join(F.transform(parts, _encoded), PART))
    cells = lambda row: F.transform(F.split(row, CELL), _clean)
    rows = lambda s: F.filter(F.transform(F.split(F.substring(s, 2, 2 ** 31 - 1), ROW), cells), lambda r: F.exists(r, lambda c: c != ""))
    lines = lambda s: F.filter(F.transform(F.split(s, "\n"), _clean), lambda line: line != "")
    none = F.array().cast("array<array<string>>")
    table = lambda s: F.array(F.struct(F.lit(True).alias("is_table"), F.lit(None).cast("string").alias("text"), rows(s).alias("rows")))
    text = lambda s: F.transform(lines(s), lambda line: F.struct(F.lit(False).alias("is_table"), line.alias("text"), none.alias("rows")))
    return F.flatten(F.transform(F.split(decoded, PART), lambda s: F.when(s.startswith(TABLE), table(s)).otherwise(text(s))))


def _joined(rows: Column, between_rows: str, filled_only: bool) -> Column:
    return F.array_join(F.transform(rows, lambda r: F.array_join(F.filter(r, lambda c: c != "") if filled_only else r, " | ")), between_rows)


def section_tables(sections: DataFrame) -> DataFrame:
    """(page_id, pos, category, item_no, table_n, unit, rows): tables of sections (page_id, pos, category, body) with the unit named
    in the table itself, else in the nearest of the two items before it; `table_n` counts a page's tables of a category."""
    items = sections.select("page_id", "pos", "category", items_of(F.col("body")).alias("_items"))
    placed = items.select("page_id", "pos", "category", F.explode(F.transform("_items", lambda x, i: F.struct(
        i.alias("item_no"), x.is_table.alias("is_table"), x.rows.alias("rows"),
        F.reverse(F.slice("_items", F.greatest(i - (UNIT_REACH - 1), F.lit(1)), F.least(i, F.lit(UNIT_REACH)))).alias("before")))).alias("_t"))
    found = placed.where("_t.is_table").select("page_id", "pos", "category", "_t.item_no", "_t.before", "_t.rows")
    lines = [F.when(~F.get("before", F.lit(k)).is_table, F.get("before", F.lit(k)).text) for k in range(UNIT_REACH)]
    unit = unit_near(_joined(F.col("rows"), "\n", False), *lines)
    order = Window.partitionBy("page_id", "category").orderBy("pos", "item_no")
    return (found.where(F.size("rows") > 0).withColumn("unit", unit).withColumn("table_n", F.row_number().over(order))
            .select("page_id", "pos", "category", "item_no", "table_n", "unit", "rows"))


def table_rows(sections: DataFrame) -> DataFrame:
    """One row per table row with its table's unit, category and rank; `row_no` counts from 0."""
    return section_tables(sections).select("page_id", "pos", "category", "item_no", "table_n", "unit", F.posexplode("rows").alias("row_no", "cells"))


def disclosure_text(pages: DataFrame, body: str = "html", tables: str = TABLES) -> DataFrame:
    """(page_id, text): the lines of a page with each table as one line, cells by ' | ' and rows by ' / ', in page order."""
    line = lambda x: F.when(x.is_table, _joined(x.rows, " / ", True)).otherwise(x.text)
    lines = F.filter(F.transform(items_of(F.col(body), tables), line), lambda s: s != "")
    return pages.select("page_id", F.array_join(lines, "\n").alias("text"))
