"""Documents put together from ordered pieces, in blocks: no row, task or group holds a whole document."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.text import pdf_text
from .ordering import running
from .shared import written

#: Characters of a block, but for a piece that is longer itself.
BLOCK = 1 << 20


def _whole(pieces: DataFrame, group: str, order: str, between: str) -> DataFrame:
    of = pieces.groupBy(group).agg(F.array_sort(F.collect_list(F.struct(order, "text"))).alias("x"))
    return of.select(group, *(F.lit(0).cast("long").alias(c) for c in ("block", "offset")), F.array_join("x.text", between).alias("text"))


def _cut(pieces: DataFrame, group: str, order: str, between: str, size: int) -> DataFrame:
    placed = running(pieces, [group], [order], {"chars": F.length("text")})
    start = F.col("chars") + F.greatest(F.col("place") - 1, F.lit(0)) * len(between)
    said = F.concat(F.when(F.col("place") > 0, between).otherwise(""), "text")
    placed = placed.select(group, "place", start.alias("offset"), F.floor(start / size).alias("block"), said.alias("said"))
    blocks = placed.groupBy(group, "block").agg(F.min("offset").alias("offset"), F.array_sort(F.collect_list(F.struct("place", "said"))).alias("x"))
    return blocks.select(group, "block", "offset", F.array_join("x.said", "").alias("text"))


def assembled(pieces: DataFrame, group: str, order: str, between: str, size: int = BLOCK) -> DataFrame:
    """group, block, offset, text: each document's blocks, which joined in order of block are its pieces (column text, by order)
    with between among them; offset is where a block begins in the document, in characters. Pieces that are null or empty are
    left out; a document without others has no block. A document of at most size characters is put together at once; one that is
    longer goes by running sums, and a block begins with the first piece in each size of its characters."""
    rows = pieces.where("text <> ''").select(group, order, "text")
    total = F.sum(F.length("text")) + F.count("*") * len(between)
    long = written(rows.groupBy(group).agg(total.alias("_n")).where(F.col("_n") > size).select(group), "long-documents")
    if long.isEmpty():
        return _whole(rows, group, order, between)
    kept = lambda how: rows.join(long, group, how).select(group, order, "text")
    return _whole(kept("left_anti"), group, order, between).union(_cut(kept("left_semi"), group, order, between, size))


def pdf_blocks(pages: DataFrame, size: int = BLOCK) -> DataFrame:
    """filename, block, offset, text of files given as the texts of their pages (filename, page from 0, text): pages are numbered
    as in the file, unless it has one only, and blank ones left out."""
    counts = pages.groupBy(F.col("filename").alias("_file")).agg(F.count("*").alias("_pages"))
    clean = pages.select("filename", "page", pdf_text(F.coalesce("text", F.lit(""))).alias("text"))
    head = F.when(F.col("_pages") > 1, F.concat(F.lit("## Page "), (F.col("page") + 1).cast("string"), F.lit("\n\n"))).otherwise("")
    rows = clean.where("text <> ''").join(counts, F.col("filename") == F.col("_file")).select("filename", "page", F.concat(head, "text").alias("text"))
    return assembled(rows, "filename", "page", "\n\n", size)


def pdf_notes(pages: DataFrame) -> DataFrame:
    """filename, pages, warnings of files given as in pdf_blocks."""
    some = F.count_if(pdf_text(F.coalesce("text", F.lit(""))) != "")
    counts = pages.groupBy("filename").agg(F.count("*").alias("pages"), some.alias("_some"))
    # The warnings' words.
    said = F.when(F.col("_some") == 0, F.array(F.lit("No selectable text was found. This PDF may be image-based."))).when(F.col("_some") < F.col("pages"), F.array(F.lit("Some pages had little or no extractable text.")))
    return counts.select("filename", "pages", F.coalesce(said, F.expr("cast(array() as array<string>)")).alias("warnings"))


def merged_regions(picks: DataFrame, size: int = BLOCK) -> DataFrame:
    """page, block, offset, text: the picked regions of pages (page, pos, html) in document order, one below the other."""
    return assembled(picks.select("page", "pos", F.col("html").alias("text")), "page", "pos", "\n", size)
