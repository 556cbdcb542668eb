"""Page sections, files, JSON lines, whole-site documents and reports."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import escape_cell, trim_all
from ..functions.urls import default_output


def page_section(title: Column, url: Column, depth: Column, words: Column, fetched_at: Column, warnings: Column, markdown: Column) -> Column:
    """A page's block of a whole-site document."""
    fact = lambda name, value: F.concat(F.lit(f"**{name}:** "), value.cast("string"))
    facts = [F.concat(F.lit("# Page: "), url), fact("Title", title), fact("URL", url), fact("Depth", depth), fact("Word Count", words), fact("Fetched At", fetched_at)]
    warned = F.when(F.size(warnings) > 0, fact("Warnings", F.array_join(warnings, "; ")))
    return F.concat_ws("\n", *facts, warned, F.lit(""), _body(markdown))


def front_matter(title: Column, url: Column, depth: Column, words: Column) -> Column:
    """Facts before a page's own file; quotes are escaped in the title alone."""
    quoted = F.replace(title, F.lit('"'), F.lit('\\"'))
    return F.array_join(F.array(F.lit("---"), F.concat(F.lit('title: "'), quoted, F.lit('"')), F.concat(F.lit('url: "'), url, F.lit('"')), F.concat(F.lit("depth: "), depth.cast("string")), F.concat(F.lit("wordCount: "), words.cast("string")), F.lit("---")), "\n")


def mirror_file(title: Column, url: Column, depth: Column, words: Column, markdown: Column) -> Column:
    """A page's own file: front matter, an empty line, the text and a line feed."""
    return F.concat(front_matter(title, url, depth, words), F.lit("\n\n"), _body(markdown), F.lit("\n"))


def _body(markdown: Column) -> Column:
    return F.when(F.coalesce(markdown, F.lit("")) == "", "_No markdown extracted._").otherwise(markdown)


def jsonl(url: Column, title: Column, markdown: Column, depth: Column, source: Column, fetched_at: Column, words: Column, warnings: Column) -> Column:
    meta = F.struct(depth.alias("depth"), source.alias("source"), fetched_at.alias("fetchedAt"), words.alias("wordCount"), warnings.alias("warnings"))
    return F.to_json(F.struct(url.alias("url"), title.alias("title"), markdown.alias("markdown"), meta.alias("metadata")), {"ignoreNullFields": "false"})


def page_document(title: Column, url: Column, byline: Column, markdown: Column) -> Column:
    """A page's own document; what is missing (null or empty) is left out, a title or text is stood in for."""
    some = lambda c: F.when(F.coalesce(c, F.lit("")) != "", c)
    blocks = [F.concat(F.lit("# "), F.coalesce(some(title), F.lit("Untitled page"))), F.concat(F.lit("Source: "), some(url)), F.concat(F.lit("Byline: "), some(byline))]
    body = F.coalesce(some(trim_all(markdown)), F.lit("_No markdown generated._"))
    return F.concat(trim_all(F.concat_ws("\n\n", *blocks, body)), F.lit("\n"))


def widget_document(title: Column, url: Column, markdown: Column) -> Column:
    """A page's document whose source is always named."""
    some = lambda c, other: F.coalesce(F.nullif(c, F.lit("")), F.lit(other))
    text = F.concat(F.lit("# "), some(title, "Untitled page"), F.lit("\n\nSource: "), url, F.lit("\n\n"), some(trim_all(markdown), "_No markdown generated._"))
    return F.concat(trim_all(text), F.lit("\n"))


def conversion_json(input_path: Column, output_path: Column, markdown: Column, warnings: Column) -> Column:
    return F.to_json(F.struct(input_path.alias("inputPath"), output_path.alias("outputPath"), markdown.alias("markdown"), warnings.alias("warnings")), {"ignoreNullFields": "false"})


def site_document(records: DataFrame, crawled_at: str) -> DataFrame:
    """root, part, place, text: the blocks of each site's whole document in the order of (part, place): 0 the head, 1 a line of
    contents for each page, 2 the rule below, 3 a section for each page. Written one below the other, they are the file; no
    row holds more than a page. records: root, place (of a page in its site), url, title, depth, words, fetched_at, warnings
    (array), markdown; an empty table gives no document.
    """
    host = lambda c: F.lower(F.regexp_extract(c, r"(?i)^https?://(?:[^/?#@]*@)?([^/?#:]+)", 1))
    of = lambda part, place, text: [F.lit(part).alias("part"), place.cast("long").alias("place"), text.alias("text")]
    sites = records.groupBy("root").agg(F.count("*").alias("n"), F.max("place").alias("last"))
    root = F.col("root")
    head = F.concat(F.lit("# Site: "), host(root), F.lit(f" - Crawl Output\nCrawled: {crawled_at} | Pages: "), F.col("n").cast("string"), F.lit(" | Start URL: "), root, F.lit("\n\n## Table of Contents"))
    section = page_section(F.col("title"), F.col("url"), F.col("depth"), F.col("words"), F.col("fetched_at"), F.col("warnings"), F.col("markdown"))
    rule = F.when(F.col("place") < F.col("last"), "\n\n---\n").otherwise("")
    parts = [
        sites.select("root", *of(0, F.lit(0), head)), records.select("root", *of(1, F.col("place"), F.format_string("- [%s](%s)", "title", "url"))),
        sites.select("root", *of(2, F.lit(0), F.lit("\n---\n"))), records.join(sites, "root").select("root", *of(3, F.col("place"), F.concat(section, rule))),
    ]
    return parts[0].union(parts[1]).union(parts[2]).union(parts[3])


def write_site(blocks: DataFrame, folder: str, partitions: int = 64) -> None:
    """Blocks of site_document as text, a folder for each site (root=...); its part files, in order, are the document."""
    ordered = blocks.repartitionByRange(partitions, "root", "part", "place").sortWithinPartitions("root", "part", "place")
    ordered.select(F.col("text").alias("value"), F.url_encode("root").alias("site")).write.partitionBy("site").text(folder)


def map_lines(found: DataFrame, as_json: bool = False) -> DataFrame:
    """root, place, line: discovered pages (root, place, url, depth, source, title, status) as addresses or as JSON."""
    line = F.to_json(F.struct("url", "depth", "source", "title", "status")) if as_json else F.col("url")
    return found.select("root", "place", line.alias("line"))


def crawl_summary(visited: DataFrame, mode: str, min_words: int = 0) -> DataFrame:
    """root, mode, output, discovered, crawled, warnings of each site. visited: root, url, words, warning (null for a page that
    counts); warnings are a number, as their rows are a table of their own."""
    fine = F.col("warning").isNull()
    kept = fine & (F.col("words") >= min_words) & F.lit(mode != "map")
    out = visited.groupBy("root").agg(F.count_if(fine).alias("discovered"), F.count_if(kept).alias("crawled"), F.count_if(~fine | (~kept & F.lit(mode != "map"))).alias("warnings"))
    host = F.lower(F.regexp_extract("root", r"(?i)^https?://(?:[^/?#@]*@)?([^/?#:]+)", 1))
    return out.select("root", F.lit(mode).alias("mode"), (default_output(host, mode) if mode != "map" else F.lit(None).cast("string")).alias("output"), "discovered", "crawled", "warnings")


def table_lines(rows: DataFrame, columns: list[str], order: str) -> DataFrame:
    """part, place, line: a table of any length as Markdown, a line a row: 0 the head, 1 the rule below, 2 the rows at their place
    (order, a number). Written in this order they are the table; no row holds more than a line. Nulls are empty cells."""
    line = lambda cells: F.concat(F.lit("| "), F.array_join(F.array(*map(escape_cell, cells)), " | "), F.lit(" |"))
    spark = rows.sparkSession
    top = spark.createDataFrame([(0, 0), (1, 0)], "part int, place long")
    head = F.when(F.col("part") == 0, line([F.lit(c) for c in columns])).otherwise(F.lit("| " + " | ".join(["---"] * len(columns)) + " |"))
    body = rows.select(F.lit(2).alias("part"), F.col(order).cast("long").alias("place"), line([F.col(c).cast("string") for c in columns]).alias("line"))
    return top.select("part", "place", head.alias("line")).union(body)


def status_report(checks: DataFrame) -> DataFrame:
    """report, ok, warn, fail (numbers of checks), exit_code (1 if any failed) of each report; checks: report, status."""
    n = lambda status: F.count_if(F.col("status") == status).alias(status)
    counts = checks.groupBy("report").agg(n("ok"), n("warn"), n("fail"))
    return counts.withColumn("exit_code", (F.col("fail") > 0).cast("int"))


def write_jsonl(df: DataFrame, folder: str) -> None:
    df.select(F.col("line").alias("value")).write.text(folder)
