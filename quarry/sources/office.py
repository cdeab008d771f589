"""Word documents and PDF pages as blocks, in the columns of every reader: ``doc_id, pos, page_num, block_type, text, level, font_size, bbox``.

A Word document is opened in one task: it is a zip of XML whose order matters. Pages of a PDF come as a table of text spans and one of ruled tables, as an extractor gives them,
and everything from there on is joins and aggregates.
"""

from __future__ import annotations

import io
import re
import zipfile
from collections.abc import Iterator
from xml.etree import ElementTree

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quarry.functions.text import strip
from quarry.operators.geometry import area, intersection
from quarry.sources.files import TEXT_SUFFIXES, clean, decode, load_files, no_box, text_blocks

# The namespace of WordprocessingML, styles that mark a heading, and the characters a heading has at most.
WORD = "{http://schemas.openxmlformats.org/wordprocessingml/2006/main}"
HEADING_STYLES, HEADING_CHARS = ("heading", "title", "标题"), 120
#: A block is a title from so many times the page's median size and up to so many characters; this share of it inside a table is the table's.
TITLE_RATIO, TITLE_CHARS, INSIDE = 1.15, 80, 0.6

_SPACES = {f"{WORD}tab": "\t", f"{WORD}br": "\n", f"{WORD}cr": "\n"}


def _said(element: ElementTree.Element) -> str:
    """The text of a paragraph, runs of blanks as one."""
    whole = "".join((e.text or "") if e.tag == f"{WORD}t" else _SPACES.get(e.tag, "") for e in element.iter())
    return re.sub("[ \t]+", " ", whole.replace("\u00a0", " ")).strip()


def _table(element: ElementTree.Element) -> str:
    """A table as Markdown, its first row the header; rows without text are left out."""
    rows = [[" ".join(_said(p) for p in cell.findall(f"{WORD}p")).strip() for cell in row.findall(f"{WORD}tc")] for row in element.findall(f"{WORD}tr")]
    frame = pd.DataFrame([r for r in rows if any(r)]).fillna("")
    if frame.empty:
        return ""
    drawn = ["| " + " | ".join(r) + " |" for r in frame.itertuples(index=False)]
    return "\n".join([drawn[0], "|" + " --- |" * frame.shape[1], *drawn[1:]])


def _word_blocks(content: bytes) -> Iterator[tuple[str, str, int | None]]:
    """``block_type, text, level`` of what stands in the body itself, in order. A heading's style names its level, or none."""
    with zipfile.ZipFile(io.BytesIO(content)) as parts, parts.open("word/document.xml") as xml:
        body = ElementTree.parse(xml).getroot().find(f"{WORD}body")
    for e in body if body is not None else ():
        if e.tag == f"{WORD}tbl":
            yield "Table", _table(e), None
        elif e.tag == f"{WORD}p":
            named = e.find(f"{WORD}pPr/{WORD}pStyle")
            style, text = (named.get(f"{WORD}val") or "" if named is not None else ""), _said(e)
            if style.lower().startswith(HEADING_STYLES) and len(text) <= HEADING_CHARS:
                number = re.search(r"\d+\s*$", style)
                yield "Title", text, int(number[0]) if number else None
            else:
                yield "Text", text, None


_BLOCK = T.StructType([T.StructField("block_type", T.StringType()), T.StructField("text", T.StringType()), T.StructField("level", T.IntegerType())])
_OPENED = T.StructType([T.StructField("blocks", T.ArrayType(_BLOCK)), T.StructField("fault", T.StringType())])


@F.pandas_udf(_OPENED)
def opened_word(content: pd.Series) -> pd.DataFrame:
    """The blocks of each document, or what is wrong with it: one that can't be read takes no other with it."""
    rows = []
    for b in content:
        try:
            rows.append(([block for block in _word_blocks(b) if block[1]], None))
        except (zipfile.BadZipFile, KeyError, ElementTree.ParseError, TypeError) as fault:
            rows.append((None, f"{type(fault).__name__}: {fault}"))
    return pd.DataFrame(rows, columns=["blocks", "fault"])


def word_documents(files: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Blocks of ``doc_id, content``, and ``doc_id, fault`` of the documents that can't be read. An empty document has neither."""
    read = files.select("doc_id", opened_word("content").alias("o")).select("doc_id", "o.*")
    rows = read.select("doc_id", F.posexplode("blocks").alias("pos", "b"))
    blocks = rows.select("doc_id", F.col("pos").cast("long").alias("pos"), F.lit(1).alias("page_num"), "b.block_type", "b.text", "b.level", F.lit(0.0).alias("font_size"), no_box())
    return blocks, read.where("fault IS NOT NULL").select("doc_id", "fault")


def load_blocks(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """Blocks of all files of a folder by their suffix, and the files that can't be read; a file is its name."""
    files = load_files(spark, path).withColumnRenamed("source_file", "doc_id")
    texts = files.where(F.col("suffix").isin(*TEXT_SUFFIXES)).select("doc_id", "suffix", decode("content").alias("text"))
    blocks, faults = word_documents(files.where(F.col("suffix") == ".docx"))
    return text_blocks(texts).unionByName(blocks), faults


def _lines(spans: Column) -> Column:
    """The text of a block: ``line, span, text`` in order, lines without text left out, none with blanks at its end."""
    numbers = F.array_distinct(F.transform(spans, lambda s: s["line"]))
    lines = F.transform(numbers, lambda n: F.array_join(F.transform(F.filter(spans, lambda s: s["line"] == n), lambda s: F.coalesce(s["text"], F.lit(""))), ""))
    return F.array_join(F.filter(F.transform(lines, lambda x: F.regexp_replace(x, r"\s+$", "")), lambda x: x != ""), "\n")


def pdf_blocks(spans: DataFrame, tables: DataFrame) -> DataFrame:
    """Blocks of pages: text blocks with their font size and, after them, tables.

    ``spans``: ``doc_id, page_num, block, line, span, text, size, bbox`` (``bbox`` of the block); ``tables``: ``doc_id, page_num, table_no, markdown, bbox``. A block is a title by its
    largest span against the median of all spans of its page; sizes of zero don't count. A block that lies for the most part inside one table is told by the table. Blank blocks and
    tables without text are none.
    """
    page = ["doc_id", "page_num"]
    middle = spans.where("size > 0").groupBy(*page).agg(F.median("size").alias("median"))
    ordered = F.array_sort(F.collect_list(F.struct("line", "span", "text")))
    blocks = spans.groupBy(*page, "block").agg(ordered.alias("s"), F.coalesce(F.max("size"), F.lit(0.0)).alias("size"), F.first("bbox", ignorenulls=True).alias("bbox"))
    blocks = blocks.withColumn("text", _lines(F.col("s"))).where(strip(F.col("text")) != "").drop("s")
    told = tables.where(F.coalesce(F.col("markdown"), F.lit("")) != "")
    boxes = told.select(*page, F.col("bbox").alias("around"))
    inside = blocks.join(boxes, page).where((area(F.col("bbox")) > 0) & (intersection(F.col("bbox"), F.col("around")) >= INSIDE * area(F.col("bbox")))).select(*page, "block").distinct()
    kept = blocks.join(inside, [*page, "block"], "left_anti").join(middle, page, "left")
    title = (F.col("median") > 0) & (F.col("size") >= F.col("median") * TITLE_RATIO) & (F.length(strip(F.col("text"))) <= TITLE_CHARS)
    kind = F.when(F.coalesce(title, F.lit(False)), "Title").otherwise("Text")

    def rows(of: DataFrame, late: int, no: str, kind: Column, text: Column, size: Column) -> DataFrame:
        place = F.col("page_num").cast("long") * 1_000_000 + late * 500_000 + F.col(no)
        return of.select("doc_id", place.alias("pos"), F.col("page_num").cast("int").alias("page_num"), kind.alias("block_type"), text.alias("text"), F.lit(None).cast("int").alias("level"), size.alias("font_size"), F.col("bbox").cast("array<double>").alias("bbox"))

    return rows(kept, 0, "block", kind, F.col("text"), F.round("size", 1)).unionByName(rows(told, 1, "table_no", F.lit("Table"), F.col("markdown"), F.lit(0.0)))


def preferred_table_text(ruled: Column, structured: Column, plain: Column) -> Column:
    """The text of a table by the most exact way that found any: ruling lines, then its structure, then the words as they stand."""
    return F.coalesce(*[F.when(strip(c) != "", c) for c in (ruled, structured, plain)], F.lit(""))


def spans_of_lines(texts: DataFrame) -> DataFrame:
    """Text without fonts as spans of one size, a block between blank lines (``doc_id, page_num, text``): for pages of which an extractor tells the text alone."""
    blocks = texts.select("doc_id", "page_num", F.posexplode(F.split("text", r"\n\s*\n")).alias("block", "t")).withColumn("t", clean(F.col("t"))).where("t <> ''")
    lines = blocks.select("doc_id", "page_num", "block", F.posexplode(F.split("t", "\n")).alias("line", "text"))
    return lines.select("doc_id", "page_num", "block", "line", F.lit(0).alias("span"), "text", F.lit(0.0).alias("size"), no_box())
