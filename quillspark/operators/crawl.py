"""Crawling a table of pages as a breadth-first search of joins.

The pages table stands for the web: url (normalised), html and, where it has them, status and
content_type. Links are a table of (src, pos, dst), written once in buckets by page, with what comes of
fetching each. A level is a join with them, a first-wins choice, an anti-join with the bucketed table of
what was seen, and the budget's cut; it is appended to that table, so lineage stays short and no earlier
level is shuffled again (its keys are read). A site whose page budget is used up leaves the search, so no
level holds more than the links of max_pages pages a site. The driver holds no URLs.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import urls as U
from .shared import shared_path, written


@dataclass(frozen=True)
class CrawlOptions:
    """Patterns are lists parted by commas, checked when the options are made; a page with fewer than min_words is no record."""

    max_pages: int = 300
    max_depth: int = 4
    max_sitemaps: int = 20
    min_words: int = 0
    include: str = ""
    exclude: str = ""

    def __post_init__(self):
        for name, least in (("max_pages", 1), ("max_depth", 0), ("max_sitemaps", 0), ("min_words", 0)):
            if getattr(self, name) < least:
                raise ValueError(f"{name} must be {least} or more")
        U.checked(U.split_patterns(self.include) + U.split_patterns(self.exclude))

    def allows(self, url: Column) -> Column:
        return U.included(url, U.split_patterns(self.include), U.split_patterns(self.exclude))


class Bucketed:
    """A scratch table in the shared folder, dealt by columns into as many buckets as shuffles have partitions, so that joins on
    those columns read it where it lies. It can be appended to; the name goes with drop(), the files with the folder."""

    def __init__(self, spark: SparkSession, label: str, columns: list[str], partition_by: list[str] = []):  # noqa: B006
        self.spark, self.columns, self.partition_by = spark, columns, partition_by
        self.path = shared_path(spark, label)
        self.name = self.path.rpartition("/")[2].replace("-", "_")
        self.buckets = int(spark.conf.get("spark.sql.shuffle.partitions"))

    def append(self, df: DataFrame) -> None:
        to = df.repartition(self.buckets, *self.columns).write.mode("append").partitionBy(*self.partition_by).option("path", self.path)
        to.bucketBy(self.buckets, *self.columns).sortBy(*self.columns).saveAsTable(self.name)

    def rows(self) -> DataFrame:
        return self.spark.table(self.name)

    def drop(self) -> None:
        self.spark.sql(f"DROP TABLE IF EXISTS {self.name}")


def page_links(pages: DataFrame) -> DataFrame:
    """src, pos, dst: the normalised links of each page, in document order."""
    rows = pages.select(F.col("url").alias("src"), F.posexplode(U.hrefs(F.col("html"))).alias("pos", "href"))
    # Written before it is filtered: a condition would be moved below and repeat the long expression for every use.
    return written(rows.select("src", "pos", U.normalise(F.col("href"), F.col("src")).alias("dst")), "links").where("dst is not null")


def _place(n: Column) -> Column:
    """A number as text that sorts as the number does."""
    return F.lpad(n.cast("string"), 10, "0")


def _within(rows: DataFrame, counts: DataFrame | None, most: int) -> DataFrame:
    """The first rows of each root, by seq and url, that its budget has room for after counts (root, n)."""
    ranked = rows.withColumn("rank", F.row_number().over(Window.partitionBy("root").orderBy("seq", "url"))).where(F.col("rank") <= most)
    if counts is not None:
        ranked = ranked.join(counts, "root", "left").where(F.col("rank") + F.coalesce("n", F.lit(0)) <= most).drop("n")
    return ranked.drop("rank")


def _added(counts: DataFrame | None, rows: DataFrame) -> DataFrame:
    now = rows.groupBy("root").agg(F.count("*").alias("n"))
    return now if counts is None else counts.union(now).groupBy("root").agg(F.sum("n").alias("n"))


def sitemap_pages(roots: DataFrame, files: DataFrame, options: CrawlOptions = CrawlOptions()) -> tuple[DataFrame, DataFrame]:
    """(root, url, seq) of the pages that each root's sitemaps name, in the order they are found, and (root, warning).

    files: url (normalised), html and, where it has it, status. /sitemap.xml comes first, nested sitemaps after it, at most
    max_sitemaps of a root (missing ones count); addresses of other origins are passed over.
    """
    ok = F.col("status").between(200, 299) if "status" in files.columns else F.lit(True)
    bodies = files.where(ok).select(F.col("url").alias("file"), F.col("html").alias("body"))
    level = roots.select("root", F.concat(U.origin(F.col("root")), F.lit("/sitemap.xml")).alias("url"), _place(F.lit(0)).alias("seq")).distinct()
    seen, counts, pages, levels = None, None, None, 0
    while True:
        level = level.groupBy("root", "url").agg(F.min("seq").alias("seq"))
        level = level if seen is None else level.join(seen, ["root", "url"], "left_anti")
        level = written(_within(level, counts, options.max_sitemaps), "sitemaps")
        if level.isEmpty():
            break
        seen = level.select("root", "url") if seen is None else seen.union(level.select("root", "url"))
        counts = _added(counts, level)
        locs = level.join(bodies, level["url"] == bodies["file"]).select("root", "seq", F.posexplode(U.sitemap_locs(F.col("body"))).alias("pos", "loc"))
        locs = locs.select("root", U.normalise(F.col("loc"), F.col("root")).alias("url"), F.concat_ws("/", "seq", _place(F.col("pos"))).alias("seq"))
        locs = written(locs, "locs").where(U.is_internal(F.col("url"), F.col("root")))
        # Sitemaps are read level by level, so what an earlier level names comes first.
        named = locs.where(~U.is_sitemap(F.col("url"))).withColumn("seq", F.concat_ws("/", _place(F.lit(levels)), "seq"))
        levels += 1
        pages = named if pages is None else pages.union(named)
        level = locs.where(U.is_sitemap(F.col("url")))
    none = roots.select("root", F.lit("").alias("url"), F.lit("").alias("seq")).limit(0)
    found = (none if pages is None else pages).groupBy("root", "url").agg(F.min("seq").alias("seq"))
    stopped = F.lit(f"Stopped sitemap traversal after {options.max_sitemaps} sitemap files.")
    full = roots.select("root").distinct() if options.max_sitemaps == 0 else counts.where(F.col("n") >= options.max_sitemaps)
    return found, full.select("root", stopped.alias("warning"))


def queue(roots: DataFrame, sitemap: DataFrame, options: CrawlOptions = CrawlOptions()) -> DataFrame:
    """root, url, source, seq: what a crawl begins with, the pages of sitemaps (root, url, seq) first, the start URL last
    unless one of them names it."""
    named = sitemap.where(options.allows(F.col("url"))).select("root", "url", F.lit("sitemap").alias("source"), F.concat(F.lit("0/"), "seq").alias("seq"))
    start = roots.select("root", U.normalise(F.col("root"), F.col("root")).alias("url"), F.lit("seed").alias("source"), F.lit("1").alias("seq")).distinct()
    start = written(start, "seeds").where("url is not null")
    return named.union(start.join(named, ["root", "url"], "left_anti"))


def outcomes(rows: DataFrame, url: str, pages: DataFrame) -> DataFrame:
    """rows with status and warning of fetching what column url names; warning is null for a page that counts."""
    status = F.col("status") if "status" in pages.columns else F.lit(200)
    content = F.col("content_type") if "content_type" in pages.columns else F.lit("text/html")
    fetched = pages.select(F.col("url").alias("_page"), status.cast("int").alias("status"), content.alias("_type"))
    ok = F.coalesce(F.col("status").between(200, 299), F.lit(False))
    reason = F.when(F.coalesce("status", F.lit(0)) == 0, "error").otherwise(F.col("status").cast("string"))
    warning = (
        F.when(~ok, F.format_string("Skipping %s (HTTP %s).", url, reason))
        .when(~F.coalesce(U.is_page_type(F.col("_type")), F.lit(False)), F.format_string("Skipping %s (non-HTML content type: %s).", url, F.coalesce("_type", F.lit(""))))
    )
    return rows.join(fetched, F.col(url) == F.col("_page"), "left").withColumn("warning", warning).drop("_page", "_type")


def _first(level: DataFrame, seen: DataFrame | None = None) -> DataFrame:
    """Each page of a level once, at its first place, and not where an earlier level has it."""
    facts = ["source", "seq", "status", "warning", "n"]
    first = level.groupBy("root", "url").agg(F.min_by(F.struct(*facts), "seq").alias("x")).select("root", "url", "x.*")
    return first if seen is None else first.join(seen.select("root", "url"), ["root", "url"], "left_anti")


def _fetched(level: DataFrame, most: int) -> DataFrame:
    """The pages that are fetched before a root's budget is used up (n of it so far); n becomes what is used then. A level
    below the seeds holds the links of most pages of a root at the most."""
    of_root = Window.partitionBy("root")
    counts = F.col("warning").isNull()
    so_far = F.sum(counts.cast("long")).over(of_root.orderBy("seq", "url").rowsBetween(Window.unboundedPreceding, Window.currentRow)) + F.col("n")
    ranked = level.withColumns({"_upto": so_far, "_all": F.sum(counts.cast("long")).over(of_root) + F.col("n")})
    inside = F.when(counts, F.col("_upto") <= most).otherwise(F.col("_upto") < most)
    return ranked.where(inside).withColumn("n", F.least("_all", F.lit(most))).drop("_upto", "_all")


def _fetched_seeds(level: DataFrame, most: int) -> DataFrame:
    """As _fetched, of seeds, of which a root may have any number: its first pages that count are ranked apart, which keeps most
    rows of a root in each task, and what stands behind the last of them goes."""
    place = F.struct("seq", "url")
    good = level.where("warning is null").withColumn("_rank", F.row_number().over(Window.partitionBy("root").orderBy("seq", "url"))).where(F.col("_rank") <= most)
    used = good.groupBy(F.col("root").alias("_root")).agg(F.count("*").alias("_n"), F.max(place).alias("_last"))
    rows = level.join(used, level["root"] == used["_root"], "left").where(F.col("_last").isNull() | (F.col("_n") < most) | (place <= F.col("_last")))
    return rows.withColumn("n", F.coalesce("_n", F.lit(0)).cast("long")).drop("_root", "_n", "_last")


def visit(seeds: DataFrame, pages: DataFrame, links: DataFrame, options: CrawlOptions = CrawlOptions()) -> DataFrame:
    """root, url, depth, source, seq, status, warning of what a crawl of each root's site fetches; warning is null for the
    pages that count, at most max_pages of a site. By depth and seq they stand in visiting order.

    seeds: root (each is crawled for itself), url, source, seq (place in the queue, a number or text that sorts). What comes of
    a link is told once, for all levels, and the links lie in buckets by their page; the pages visited, in buckets by root and
    url, so that a level shuffles its own rows only, and is written once.
    """
    spark = seeds.sparkSession
    seq = F.col("seq") if dict(seeds.dtypes)["seq"] == "string" else _place(F.col("seq"))
    wanted = seeds.select("root", "url", "source", seq.alias("seq"), F.lit(0).cast("long").alias("n"))
    wanted = wanted.where(U.is_internal(F.col("url"), F.col("root")) & options.allows(F.col("url")))
    graph, seen = Bucketed(spark, "crawl-links", ["src"]), Bucketed(spark, "crawl-seen", ["root", "url"], ["depth"])
    try:
        level = _fetched_seeds(written(_first(outcomes(wanted, "url", pages)), "crawl-seeds"), options.max_pages)
        for depth in range(options.max_depth + 1):
            seen.append(level.withColumn("depth", F.lit(depth)))
            kept = seen.rows().where((F.col("depth") == depth) & F.col("warning").isNull() & (F.col("n") < options.max_pages))
            if depth == options.max_depth or kept.isEmpty():
                break
            if depth == 0:
                allowed = links.where(options.allows(F.col("dst"))).withColumn("origin", U.origin(F.col("dst")))
                graph.append(outcomes(allowed, "dst", pages))
            # A link's place is its page's place, then its own.
            place = F.concat_ws("/", "seq", _place(F.col("pos"))).alias("seq")
            onward = kept.select("root", "url", "seq", "n").join(graph.rows(), (F.col("url") == F.col("src")) & (F.col("origin") == U.origin(F.col("root"))))
            onward = onward.select("root", F.col("dst").alias("url"), F.lit("link").alias("source"), place, "status", "warning", "n")
            level = _fetched(_first(onward, seen.rows()), options.max_pages)
        return written(seen.rows().select("root", "url", "depth", "source", "seq", "status", "warning"), "crawl")
    finally:
        graph.drop()
        seen.drop()


def crawl(seeds: DataFrame, pages: DataFrame, links: DataFrame, options: CrawlOptions = CrawlOptions()) -> DataFrame:
    """root, url, depth, source, seq of the pages that count, as visit() finds them."""
    return visit(seeds, pages, links, options).where("warning is null").drop("status", "warning")


def short_pages(words: DataFrame, options: CrawlOptions) -> DataFrame:
    """words (url, words and others) with a warning for the pages that are too short to be records, null for the others."""
    text = F.concat(F.lit("Skipping "), "url", F.lit(" (content too short: "), F.col("words").cast("string"), F.lit(f" words, min {options.min_words})."))
    return words.withColumn("warning", F.when(F.col("words") < options.min_words, text))
