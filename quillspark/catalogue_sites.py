"""Queries of sites: sitemaps, crawls of many sites at once and what is made of them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .functions import urls as U
from .operators import crawl as C
from .operators import outputs as O
from .registry import DECODED_SQL, NORM_SQL, query, table

#: Pages of a derived site.
PAGES = 50


def _url(page: Column) -> Column:
    """Address of a page of the derived sites: every 17th lies in a folder of its own."""
    folder = F.when(page % 17 == 3, "x").otherwise("p")
    return F.concat(F.lit("http://s"), F.floor(page / PAGES).cast("string"), F.lit(".test/"), folder, F.lit("/"), page.cast("string"))


def derived_sites(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Seeds, pages and links of as many sites as there are PAGES pages in the table, which links none of its own to another:
    from page j of a site at places 0 to 2 to page (7 j + 13 k + 1) mod the site's pages, and at place 3 to another site. Every
    19th page is missing, every 11th not found, every 13th no HTML."""
    pages = table(spark, sf_dir, "pages").select("page_id").crossJoin(F.broadcast(table(spark, sf_dir, "pages").agg((F.max("page_id") + 1).alias("n"))))
    first = (F.floor(F.col("page_id") / PAGES) * PAGES).alias("first")
    pages = pages.select("page_id", "n", first).withColumn("m", F.least(F.lit(PAGES), F.col("n") - F.col("first")))
    inside = F.transform(F.sequence(F.lit(0), F.lit(2)), lambda k: F.col("first") + F.pmod((F.col("page_id") - F.col("first")) * 7 + k * 13 + 1, F.col("m")))
    links = pages.select(_url(F.col("page_id")).alias("src"), F.posexplode(F.concat(inside, F.array(F.pmod(F.col("first") + PAGES, F.col("n"))))).alias("pos", "to"))
    root = _url(F.col("page_id"))
    seeds = pages.where("page_id = first").select(root.alias("root"), root.alias("url"), F.lit("seed").alias("source"), F.lit(0).alias("seq"))
    status = F.when(F.col("page_id") % 11 == 5, 404).otherwise(200)
    kind = F.when(F.col("page_id") % 13 == 7, "application/pdf").otherwise("text/html; charset=utf-8")
    fetched = pages.where("page_id % 19 <> 18").select(root.alias("url"), status.alias("status"), kind.alias("content_type"))
    return seeds, fetched, links.select("src", "pos", _url(F.col("to")).alias("dst"))


_SITES_SQL = f"""n AS (SELECT max(page_id) + 1 AS n FROM pages),
p AS (SELECT page_id AS p, {PAGES} * (page_id // {PAGES}) AS f, least({PAGES}, n - {PAGES} * (page_id // {PAGES})) AS m, 'http://s' || (page_id // {PAGES}) || '.test/' || (CASE WHEN page_id % 17 = 3 THEN 'x' ELSE 'p' END) || '/' || page_id AS url FROM pages, n),
o AS (SELECT *, CASE WHEN p % 19 = 18 THEN 'Skipping ' || url || ' (HTTP error).' WHEN p % 11 = 5 THEN 'Skipping ' || url || ' (HTTP 404).' WHEN p % 13 = 7 THEN 'Skipping ' || url || ' (non-HTML content type: application/pdf).' END AS warning,
 CASE WHEN p % 19 = 18 THEN NULL WHEN p % 11 = 5 THEN 404 ELSE 200 END AS status FROM p),
c AS (SELECT p, f, 0 AS depth FROM o WHERE p = f AND p % 17 <> 3 UNION SELECT q.p, q.f, depth + 1 FROM c JOIN o a ON a.p = c.p AND a.warning IS NULL, (SELECT unnest([0, 1, 2]) AS k) k, o q WHERE q.p = a.f + ((a.p - a.f) * 7 + 13 * k.k + 1) % a.m AND depth < 4 AND q.p % 17 <> 3),
v AS (SELECT p, f, min(depth) AS depth FROM c GROUP BY p, f)"""


@query(f"""WITH RECURSIVE {_SITES_SQL}
SELECT (SELECT url FROM p WHERE p.p = v.f) AS root, o.url, v.depth, coalesce(o.status, 0) AS status, o.warning FROM v JOIN o ON o.p = v.p""")
def crw_01_crawl(spark, sf_dir):
    """All derived sites at once, to a depth of four, without what the pattern excludes; failures get a warning and lead nowhere."""
    return C.visit(*derived_sites(spark, sf_dir), C.CrawlOptions(exclude="/x/")).select("root", "url", "depth", F.coalesce("status", F.lit(0)).alias("status"), "warning")


def _encoded_sql(s: str) -> str:
    return f"array_to_string(list_transform(string_split({s}, ''), lambda x: CASE WHEN ord(x) > 126 THEN url_encode(x) ELSE x END), '')"


@query(rf"""WITH u AS (SELECT page_id, html, {NORM_SQL} AS url FROM pages), p AS (SELECT url, arg_min(html, page_id) AS html, regexp_extract(url, '^https?://[^/]+') AS o FROM u GROUP BY url),
l AS (SELECT p.o, unnest(regexp_extract_all(html, '(?is)<a\b[^>]*?\bhref\s*=\s*"([^"]*)"', 1)) AS h FROM p), d AS (SELECT DISTINCT o, o || {_encoded_sql("h")} AS url FROM l)
SELECT o || '/' AS root, url, 0 AS depth, 'sitemap' AS source, CAST(NULL AS VARCHAR) AS warning FROM p
UNION ALL SELECT o || '/', url, 1, 'link', 'Skipping ' || url || ' (HTTP error).' FROM d WHERE url NOT IN (SELECT url FROM p)""")
def crw_06_real_links(spark, sf_dir):
    """Every host of the table crawled from its pages along the links in their HTML, which lead to no other page of the table:
    each of these is a failure of its own."""
    pages = table(spark, sf_dir, "pages").select("page_id", U.normalise(F.col("url"), F.col("url")).alias("url"), "html")
    pages = pages.groupBy("url").agg(F.min_by("html", "page_id").alias("html"), F.min("page_id").alias("page_id"))
    seeds = pages.select(F.concat(U.origin(F.col("url")), F.lit("/")).alias("root"), "url", F.lit("sitemap").alias("source"), F.col("page_id").alias("seq"))
    out = C.visit(seeds, pages.select("url"), C.page_links(pages.select("url", "html")), C.CrawlOptions(max_pages=1_000_000_000))
    return out.select("root", "url", "depth", "source", "warning")


def _sitemaps(spark, sf_dir) -> tuple[DataFrame, DataFrame]:
    """Roots of the derived sites, and their sitemap files: the first names two others, the first page and itself, these name
    pages by twos, a page of another site and a file that is missing."""
    pages = table(spark, sf_dir, "pages").where(f"page_id % {PAGES} = 0")
    site = F.concat(F.lit("http://s"), F.floor(F.col("page_id") / PAGES).cast("string"), F.lit(".test"))
    loc = lambda x: F.concat(F.lit("<sitemap><loc> "), x, F.lit(" </loc></sitemap>"))
    at = lambda path: F.concat(site, F.lit(path))
    every = lambda first: F.array_join(F.transform(F.sequence(F.lit(first), F.lit(PAGES - 1), F.lit(2)), lambda j: loc(F.concat(site, F.lit("/p/"), j.cast("string"), F.lit("/?a=1&amp;b=2")))), "\n")
    files = {
        "/sitemap.xml": F.concat(loc(at("/a.xml")), loc(at("/Sitemap-b")), loc(at("/p/0")), loc(at("/sitemap.xml"))),
        "/a.xml": F.concat(every(0), loc(F.lit("http://other.test/p/1")), loc(at("/gone.xml"))), "/Sitemap-b": F.concat(every(1), loc(F.lit("mailto:a@b"))),
    }
    rows = pages.select(F.explode(F.array(*(F.struct(at(p).alias("url"), x.alias("html")) for p, x in files.items()))).alias("f")).select("f.*")
    return pages.select(at("/").alias("root")), rows


@query(f"""WITH s AS (SELECT 'http://s' || (page_id // {PAGES}) || '.test' AS s FROM pages WHERE page_id % {PAGES} = 0), j AS (SELECT unnest(range({PAGES})) AS j)
SELECT s || '/' AS root, s || '/p/' || j AS url, 'sitemap' AS source, row_number() OVER (PARTITION BY s ORDER BY CASE WHEN j = 0 THEN 0 ELSE 1 + j % 2 END, j) - 1 AS place FROM s, j
UNION ALL SELECT s || '/', s || '/', 'seed', {PAGES} FROM s""")
def url_11_sitemaps(spark, sf_dir):
    """What a crawl of each derived site begins with: the pages of its sitemaps in the order they are found, then its root."""
    roots, files = _sitemaps(spark, sf_dir)
    begin = C.queue(roots, C.sitemap_pages(roots, files)[0])
    return begin.select("root", "url", "source", (F.row_number().over(Window.partitionBy("root").orderBy("seq")) - 1).cast("long").alias("place"))


def _found(spark, sf_dir) -> DataFrame:
    return table(spark, sf_dir, "pages").select(
        U.origin(F.col("url")).alias("root"), F.col("page_id").alias("place"), "url", (F.col("page_id") % 5).cast("int").alias("depth"), F.lit("link").alias("source"),
        U.page_title(F.col("html"), F.col("url")).alias("title"), F.lit(200).alias("status"),
    )


@query(f"""SELECT regexp_extract(url, '^https?://[^/]+') AS root, page_id AS place, CAST(to_json({{'url': url, 'depth': page_id % 5, 'source': 'link', 'title': {DECODED_SQL}, 'status': 200}}) AS VARCHAR) AS line FROM pages""")
def crw_10_map(spark, sf_dir):
    """Every page as a line of its host's map."""
    return O.map_lines(_found(spark, sf_dir), as_json=True)


@query("""WITH v AS (SELECT regexp_extract(url, '^https?://[^/]+') AS root, page_id % 11 = 5 AS failed, page_id % 100 >= 50 AS long FROM pages)
SELECT root, 'single' AS mode, regexp_replace(regexp_replace(root, '^https?://', ''), '[^a-zA-Z0-9.-]', '_', 'g') || '.crawl.md' AS output, count(*) FILTER (NOT failed) AS discovered, count(*) FILTER (NOT failed AND long) AS crawled, count(*) FILTER (failed OR NOT long) AS warnings FROM v GROUP BY root""")
def crw_11_summary(spark, sf_dir):
    """Each host's crawl in numbers, where every 11th page failed and pages of fewer than 50 words are too short."""
    visited = _found(spark, sf_dir).select("root", "url", (F.col("place") % 100).alias("words"), F.when(F.col("place") % 11 == 5, "failed").alias("warning"))
    return O.crawl_summary(visited, "single", 50)
