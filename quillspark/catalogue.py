"""Registered queries of the library, each over a whole table, and the SQL that checks them: text, addresses and outputs here, sites
and crawls in catalogue_sites, files and their hooks in catalogue_files."""

from __future__ import annotations

from pyspark.sql import functions as F

from .functions import editing as E
from .functions import text as T
from .functions import urls as U
from .operators import crawl as C
from .operators import assembly as A
from .operators import outputs as O
from .registry import DECODED_SQL, NORM_SQL, ORACLE_SQL, QUERIES, query, table  # noqa: F401
from .sources import files as S
from .sources import mirror as M

FETCHED = "2024-01-01T00:00:00.000Z"


@query(r"SELECT doc_id, replace(text, chr(13) || chr(10), chr(10)) AS text_norm FROM documents")
def txt_01_line_endings(spark, sf_dir):
    return table(spark, sf_dir, "documents").select("doc_id", T.line_endings(F.col("text")).alias("text_norm"))


@query(r"SELECT doc_id, len(list_filter(regexp_split_to_array(text, '[ \t\n\x0B\f\r]+'), lambda x: x <> '')) AS words FROM documents")
def txt_02_word_count(spark, sf_dir):
    return table(spark, sf_dir, "documents").select("doc_id", T.word_count(F.col("text")).alias("words"))


@query(r"SELECT page_id, regexp_replace(regexp_extract(url, '([^/]*)$', 1), '(.)\.[^.]*$', '\1') AS stem, lower(regexp_extract(regexp_extract(url, '([^/]*)$', 1), '^.+\.([^.]+)$', 1)) AS ext FROM pages")
def hlp_01_stem_ext(spark, sf_dir):
    return table(spark, sf_dir, "pages").select("page_id", T.file_stem(F.col("url")).alias("stem"), T.file_extension(F.col("url")).alias("ext"))


@query(r"SELECT doc_id, replace(replace(replace(text, '|', '\|'), chr(13) || chr(10), ' '), chr(10), ' ') AS cell FROM documents")
def txt_07_escape_cell(spark, sf_dir):
    return table(spark, sf_dir, "documents").select("doc_id", T.escape_cell(F.col("text")).alias("cell"))


@query("SELECT 'nation' AS name, '| key | name |' || chr(10) || '| --- | --- |' || chr(10) || string_agg('| ' || n_nationkey || ' | ' || n_name || ' |', chr(10) ORDER BY n_nationkey) AS markdown FROM nation")
def txt_08_rows_totable(spark, sf_dir):
    rows = table(spark, sf_dir, "nation").agg(F.array_sort(F.collect_list(F.struct("n_nationkey", "n_name"))).alias("r"))
    cells = F.concat(F.array(F.array(F.lit("key"), F.lit("name"))), F.transform("r", lambda x: F.array(x["n_nationkey"].cast("string"), x["n_name"])))
    return rows.select(F.lit("nation").alias("name"), T.table_markdown(cells).alias("markdown"))


@query("""SELECT 2 AS part, o_orderkey AS place, '| ' || o_orderkey || ' | ' || o_orderstatus || ' | ' || replace(o_orderpriority, '|', '\\|') || ' |' AS line FROM orders
UNION ALL SELECT 0, 0, '| o_orderkey | o_orderstatus | o_orderpriority |' UNION ALL SELECT 1, 0, '| --- | --- | --- |'""")
def txt_08_table_lines(spark, sf_dir):
    """All orders as one Markdown table, a line a row."""
    return O.table_lines(table(spark, sf_dir, "orders"), ["o_orderkey", "o_orderstatus", "o_orderpriority"], "o_orderkey")


@query("SELECT conv_id, turn, '> ' || replace(text, chr(10), chr(10) || '> ') || chr(10) || '> end' AS quoted FROM conversations")
def txt_11_blockquote(spark, sf_dir):
    """Every turn and a last line, parted as Windows does."""
    return table(spark, sf_dir, "conversations").select("conv_id", "turn", T.blockquote(F.concat("text", F.lit("\r\nend"))).alias("quoted"))


@query(r"""SELECT page_id, regexp_replace(url, '[<>:"/\\|?*]', '-', 'g') AS segment FROM pages""")
def txt_13_safe_segment(spark, sf_dir):
    return table(spark, sf_dir, "pages").select("page_id", T.safe_segment(F.col("url")).alias("segment"))


@query(f"SELECT page_id, {DECODED_SQL} AS title FROM pages")
def txt_14_entities(spark, sf_dir):
    raw = T.trim_all(F.regexp_replace(F.regexp_extract("html", U.TITLE, 1), r"[ \t\n\r]+", " "))
    return table(spark, sf_dir, "pages").select("page_id", T.decode_entities(raw).alias("title"))


@query("SELECT doc_id, replace(replace(replace(text, '&', '&amp;'), '<', '&lt;'), '>', '&gt;') AS html FROM documents")
def txt_15_escape_html(spark, sf_dir):
    return table(spark, sf_dir, "documents").select("doc_id", T.escape_html(F.col("text")).alias("html"))


@query(r"""WITH l AS (SELECT doc_id, unnest(string_split(text, chr(10))) AS line, generate_subscripts(string_split(text, chr(10)), 1) - 1 AS line_no FROM documents)
SELECT doc_id, line_no, CASE WHEN regexp_matches(line, '^#{1,6}[ \t]') THEN 'heading' WHEN line LIKE '>%' THEN 'blockquote' WHEN regexp_matches(line, '^[ \t]*```') THEN 'fence' WHEN regexp_matches(line, '^[ \t]*([-*+]|[0-9]+\.)[ \t]+') THEN 'bullet' ELSE 'inline' END AS kind FROM l""")
def txt_16_highlight(spark, sf_dir):
    lines = table(spark, sf_dir, "documents").select("doc_id", F.posexplode(F.split("text", "\n")).alias("line_no", "line"))
    return lines.select("doc_id", F.col("line_no").cast("long").alias("line_no"), T.highlight_class(F.col("line")).alias("kind"))


@query(f"SELECT page_id, {NORM_SQL} AS url_norm FROM pages")
def url_02_normalize(spark, sf_dir):
    return table(spark, sf_dir, "pages").select("page_id", U.normalise(F.col("url"), F.col("url")).alias("url_norm"))


_LINKS_SQL = r"""l AS (SELECT page_id, url, regexp_extract_all(html, '(?is)<a\b[^>]*?\bhref\s*=\s*"([^"]*)"', 1) AS h FROM pages),
p AS (SELECT page_id, url, unnest(h) AS href, generate_subscripts(h, 1) - 1 AS pos FROM l)"""


@query(f"WITH {_LINKS_SQL} SELECT page_id, pos, trim(href) AS href FROM p")
def url_07_links(spark, sf_dir):
    rows = table(spark, sf_dir, "pages").select("page_id", F.posexplode(U.hrefs(F.col("html"))).alias("pos", "href"))
    return rows.select("page_id", F.col("pos").cast("long").alias("pos"), "href")


@query(f"WITH {_LINKS_SQL} SELECT page_id, pos, NOT regexp_matches(href, '^https?://') OR regexp_extract(href, '^(https?://[^/]+)', 1) = regexp_extract(url, '^(https?://[^/]+)', 1) AS internal FROM p")
def url_03_internal(spark, sf_dir):
    rows = table(spark, sf_dir, "pages").select("page_id", "url", F.posexplode(U.hrefs(F.col("html"))).alias("pos", "href"))
    return rows.select("page_id", F.col("pos").cast("long").alias("pos"), U.is_internal(U.normalise(F.col("href"), F.col("url")), F.col("url")).alias("internal"))


@query("SELECT page_id, regexp_matches(lower(url), 'html|page') AND NOT regexp_matches(lower(url), 'utm_') AS kept FROM pages")
def url_04_patterns(spark, sf_dir):
    return table(spark, sf_dir, "pages").select("page_id", U.included(F.col("url"), U.split_patterns("html, page"), U.split_patterns("utm_")).alias("kept"))


@query(f"SELECT page_id, {DECODED_SQL} AS title FROM pages")
def url_08_title(spark, sf_dir):
    return table(spark, sf_dir, "pages").select("page_id", U.page_title(F.col("html"), F.col("url")).alias("title"))


@query(f"""WITH n AS (SELECT page_id, regexp_replace({NORM_SQL}, '^https?://[^/]+', '') AS path FROM pages)
SELECT page_id, CASE WHEN path = '/' THEN 'index.md' WHEN regexp_matches(path, '[.][^/]*$') THEN regexp_replace(substr(path, 2), '[.][^./]*$', '') || '.md' ELSE substr(path, 2) || '/index.md' END AS path FROM n""")
def url_12_mirror_path(spark, sf_dir):
    return table(spark, sf_dir, "pages").select("page_id", U.mirror_path(U.normalise(F.col("url"), F.col("url"))).alias("path"))


_TEXT_SQL = r"trim(regexp_replace(regexp_replace(regexp_replace(html, '(?is)<script\b.*?</script>|<style\b.*?</style>|<!--.*?-->', ' ', 'g'), '<[^>]*>', ' ', 'g'), '[ \t\n\x0B\f\r]+', ' ', 'g'))"
_WORDS_SQL = "len(string_split(text, ' ')) - CAST(text = '' AS INT)"


def _page_records(spark, sf_dir):
    """Pages with title, depth, text outside tags and its words."""
    text = T.plain_text(F.col("html"))
    rows = table(spark, sf_dir, "pages").select("page_id", "url", U.page_title(F.col("html"), F.col("url")).alias("title"), (F.col("page_id") % 5).cast("int").alias("depth"), F.when(F.col("page_id") % 10 == 9, "").otherwise(text).alias("text"))
    return rows.withColumn("words", T.word_count(F.col("text"))).withColumn("warnings", F.when(F.col("page_id") % 4 == 0, F.array(F.lit("a"), F.lit("b"))).otherwise(F.expr("cast(array() as array<string>)")))


_RECORDS_SQL = f"""r AS (SELECT page_id, url, {DECODED_SQL} AS title, page_id % 5 AS depth, CASE WHEN page_id % 10 = 9 THEN '' ELSE {_TEXT_SQL} END AS text FROM pages), w AS (SELECT *, {_WORDS_SQL} AS words FROM r)"""


@query(f"""WITH {_RECORDS_SQL} SELECT page_id, concat_ws(chr(10), '# Page: ' || url, '**Title:** ' || title, '**URL:** ' || url, '**Depth:** ' || depth, '**Word Count:** ' || words, '**Fetched At:** {FETCHED}', CASE WHEN page_id % 4 = 0 THEN '**Warnings:** a; b' END, '', CASE WHEN text = '' THEN '_No markdown extracted._' ELSE text END) AS section FROM w""")
def snk_02_section(spark, sf_dir):
    section = O.page_section(*(F.col(c) for c in ("title", "url", "depth", "words")), F.lit(FETCHED), F.col("warnings"), F.col("text"))
    return _page_records(spark, sf_dir).select("page_id", section.alias("section"))


@query(f"""SELECT page_id, concat_ws(chr(10), '---', 'title: "' || replace({DECODED_SQL}, '"', '\\"') || '"', 'url: "' || url || '"', 'depth: 0', 'wordCount: ' || length(html), '---', '', '_No markdown extracted._', '') AS front FROM pages""")
def snk_03_front_matter(spark, sf_dir):
    return table(spark, sf_dir, "pages").select("page_id", O.mirror_file(U.page_title(F.col("html"), F.col("url")), F.col("url"), F.lit(0), F.length("html"), F.lit("")).alias("front"))


@query(rf"""WITH n AS (SELECT page_id, url, html, {NORM_SQL} AS u FROM pages), p AS (SELECT page_id, url, html, regexp_replace(u, '^https?://[^/]+', '') AS path FROM n),
m AS (SELECT url, CASE WHEN path = '/' THEN 'index.md' WHEN regexp_matches(path, '[.][^/]*$') THEN regexp_replace(substr(path, 2), '[.][^./]*$', '') || '.md' ELSE substr(path, 2) || '/index.md' END AS path,
 concat_ws(chr(10), '---', 'title: "' || replace({DECODED_SQL}, '"', '\"') || '"', 'url: "' || url || '"', 'depth: ' || page_id % 5, 'wordCount: ' || length(html), '---', '', '_No markdown extracted._', '') AS content FROM p)
SELECT path, arg_min(content, url) AS content FROM m GROUP BY path""")
def snk_03_mirror(spark, sf_dir):
    """The files of a mirror of all pages, hosts on top of each other: of pages with one path the smallest address's, of pages
    with one address the first."""
    pages = table(spark, sf_dir, "pages")
    content = O.mirror_file(U.page_title(F.col("html"), F.col("url")), F.col("url"), F.col("page_id") % 5, F.length("html"), F.lit(""))
    files = pages.select(U.mirror_path(U.normalise(F.col("url"), F.col("url"))).alias("path"), content.alias("content"), "url", "page_id")
    return M.one_a_path(files, "url", "page_id")


@query(f"""WITH {_RECORDS_SQL} SELECT page_id, CAST(to_json({{'url': url, 'title': title, 'markdown': text, 'metadata': {{'depth': depth, 'source': 'link', 'fetchedAt': '{FETCHED}', 'wordCount': words, 'warnings': CASE WHEN page_id % 4 = 0 THEN ['a', 'b'] ELSE [] END}}}}) AS VARCHAR) AS line FROM w""")
def snk_04_jsonl(spark, sf_dir):
    line = O.jsonl(*(F.col(c) for c in ("url", "title", "text", "depth")), F.lit("link"), F.lit(FETCHED), F.col("words"), F.col("warnings"))
    return _page_records(spark, sf_dir).select("page_id", line.alias("line"))


_ENDINGS = [*S.SUPPORTED, "xyz", ""]


@query(f"""WITH e AS (SELECT doc_id, text, list_extract([{", ".join(f"'{x}'" for x in _ENDINGS)}], 1 + CAST(doc_id % {len(_ENDINGS)} AS INT)) AS ext FROM documents)
SELECT doc_id || '.' || upper(ext) AS filename, CASE WHEN ext IN ('txt', 'md', 'markdown', 'mdx') THEN text ELSE '' END AS markdown, CASE WHEN ext = '' THEN doc_id || '' ELSE CAST(doc_id AS VARCHAR) END AS title,
 CASE WHEN ext = 'xyz' THEN 'Unsupported file format: .xyz' WHEN ext = '' THEN 'Unsupported file format: .unknown' WHEN ext IN ('txt', 'md', 'markdown', 'mdx') THEN '' ELSE 'No reader for files of this format: .' || ext END AS warnings FROM e WHERE ext NOT IN ('csv', 'rtf')""")
def src_01_dispatch(spark, sf_dir):
    """Documents dealt over all endings, one that is unknown and none; csv and rtf have queries of their own."""
    ext = F.element_at(F.array(*map(F.lit, _ENDINGS)), (F.col("doc_id") % len(_ENDINGS) + 1).cast("int"))
    files = table(spark, sf_dir, "documents").where(~ext.isin("csv", "rtf")).select(F.concat_ws(".", F.col("doc_id").cast("string"), F.upper(ext)).alias("filename"), "text")
    return S.convert(files).withColumn("warnings", F.array_join("warnings", "; "))


@query("SELECT doc_id || '.md' AS filename, replace(text, chr(13) || chr(10), chr(10)) AS markdown, CAST(doc_id AS VARCHAR) AS title, '' AS warnings FROM documents")
def src_07_text(spark, sf_dir):
    files = table(spark, sf_dir, "documents").select(F.concat(F.col("doc_id").cast("string"), F.lit(".md")).alias("filename"), "text")
    return S.convert(files).withColumn("warnings", F.array_join("warnings", "; "))


@query("SELECT c_custkey, '| name | segment |' || chr(10) || '| --- | --- |' || chr(10) || '| ' || c_name || ' | ' || c_mktsegment || ' |' AS markdown FROM customer")
def src_09_csv(spark, sf_dir):
    """One small CSV file for each customer."""
    files = table(spark, sf_dir, "customer").select(F.concat(F.col("c_custkey").cast("string"), F.lit(".csv")).alias("filename"), F.format_string('name, segment\n"%s" ,%s\n\n', "c_name", "c_mktsegment").alias("text"))
    return S.convert(files).select(F.col("title").cast("long").alias("c_custkey"), "markdown")


def _blocks_sql(pieces: str, group: str, order: str, between: int, size: int) -> str:
    """Blocks of documents put together from pieces (text, by order) with line feeds between them."""
    gap = f"repeat(chr(10), {between})"
    return f"""p AS ({pieces}), s AS (SELECT {group}, text, row_number() OVER w - 1 AS place, coalesce(sum(length(text)) OVER (w ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) + greatest(row_number() OVER w - 2, 0) * {between} AS pos FROM p WINDOW w AS (PARTITION BY {group} ORDER BY {order}))
SELECT {group}, CAST(b AS BIGINT) AS block, CAST(min(pos) AS BIGINT) AS "offset", string_agg(CASE WHEN place > 0 THEN {gap} ELSE '' END || text, '' ORDER BY place) AS text FROM (SELECT *, CASE WHEN sum(length(text) + {between}) OVER (PARTITION BY {group}) <= {size} THEN 0 ELSE pos // {size} END AS b FROM s) GROUP BY {group}, b"""


_CLEAN_SQL = r"trim(regexp_replace(replace(text, chr(13) || chr(10), chr(10)), '\n{3,}', chr(10) || chr(10), 'g'), ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13))"


@query("WITH c AS (SELECT conv_id, turn, " + _CLEAN_SQL + " AS text, count(*) OVER (PARTITION BY conv_id) AS n FROM conversations), " + _blocks_sql("SELECT conv_id, turn, CASE WHEN n > 1 THEN '## Page ' || (turn + 1) || chr(10) || chr(10) ELSE '' END || text AS text FROM c WHERE text <> ''", "conv_id", "turn", 2, 100_000))
def src_12_pdf_assembly(spark, sf_dir):
    """Turns of a conversation as the pages of a PDF, in blocks of 100,000 characters."""
    pages = table(spark, sf_dir, "conversations").select(F.col("conv_id").alias("filename"), F.col("turn").alias("page"), "text")
    return A.pdf_blocks(pages, 100_000).withColumnRenamed("filename", "conv_id")


@query("WITH c AS (SELECT conv_id, CASE WHEN conv_id % 3 = 0 AND turn % 2 = 0 OR conv_id % 7 = 0 THEN '' ELSE text END AS text FROM conversations) SELECT conv_id, count(*) AS pages, CASE WHEN count(*) FILTER (text <> '') = 0 THEN 'No selectable text was found. This PDF may be image-based.' WHEN count(*) FILTER (text <> '') < count(*) THEN 'Some pages had little or no extractable text.' ELSE '' END AS warnings FROM c GROUP BY conv_id")
def src_13_pdf_notes(spark, sf_dir):
    """Warnings of the same files, where some have blank pages and some no others."""
    blank = (F.col("conv_id") % 3 == 0) & (F.col("turn") % 2 == 0) | (F.col("conv_id") % 7 == 0)
    pages = table(spark, sf_dir, "conversations").select(F.col("conv_id").alias("filename"), F.when(blank, " \n").otherwise(F.col("text")).alias("text"))
    return A.pdf_notes(pages).select(F.col("filename").alias("conv_id"), "pages", F.array_join("warnings", "; ").alias("warnings"))


@query("SELECT p_partkey, '| ' || p_name || ' | ' || p_size || '.0 | ' || p_size || ' | -3 | ' || p_size || ' | 1 |' AS row FROM part")
def src_21_word_boxes(spark, sf_dir):
    """Parts as OCR words; the last row of each layout table."""
    box = F.struct(F.col("p_size").cast("double").alias("x0"), F.lit(-3.0).alias("y0"), (F.col("p_size") * 2).cast("double").alias("x1"), F.lit(-2.0).alias("y1"))
    words = F.array(F.struct(F.col("p_name").alias("text"), F.col("p_size").cast("double").alias("confidence"), box.alias("bbox")))
    return table(spark, sf_dir, "part").select("p_partkey", F.element_at(F.split(T.layout_table(T.word_boxes(words)), "\n"), -1).alias("row"))


@query("SELECT o_custkey AS report, count(*) FILTER (o_orderstatus = 'F') AS ok, count(*) FILTER (o_orderstatus = 'O') AS warn, count(*) FILTER (o_orderstatus = 'P') AS fail, CAST(count(*) FILTER (o_orderstatus = 'P') > 0 AS INT) AS exit_code FROM orders GROUP BY o_custkey")
def ctl_06_status_report(spark, sf_dir):
    """Each customer's orders as the checks of a report."""
    status = F.when(F.col("o_orderstatus") == "F", "ok").when(F.col("o_orderstatus") == "O", "warn").otherwise("fail")
    return O.status_report(table(spark, sf_dir, "orders").select(F.col("o_custkey").alias("report"), status.alias("status")))


@query(r"""SELECT doc_id, regexp_replace(regexp_replace(replace(replace(replace('`co<de>` ' || text, '&', '&amp;'), '<', '&lt;'), '>', '&gt;'), '`([^`]+)`', '<span class="pbw-md-code">`\1`</span>', 'g'), '(\[[^\]]+\]\([^)]+\))', '<span class="pbw-md-link">\1</span>', 'g') AS html FROM documents""")
def txt_17_inline(spark, sf_dir):
    return table(spark, sf_dir, "documents").select("doc_id", T.highlight_inline(F.concat(F.lit("`co<de>` "), "text")).alias("html"))


@query(r"""WITH w AS (SELECT doc_id, len(list_filter(regexp_split_to_array(text, '[ \t\n\x0B\f\r]+'), lambda x: x <> '')) AS words FROM documents)
SELECT doc_id, words, words >= 50 AS kept FROM w""")
def txt_19_minimum_words(spark, sf_dir):
    """Documents with enough words to keep, and those that get a warning instead."""
    rows = table(spark, sf_dir, "documents").select("doc_id", T.word_count(F.col("text")).alias("words"))
    return rows.withColumn("kept", F.col("words") >= 50)


@query("SELECT p_partkey, floor(p_size * 1.0e-7 * 1e8 + 0.5) / 100 AS cost, '$' || printf('%.2f', floor(p_size * 1.0e-7 * 1e8 + 0.5) / 100) || '/M' AS label FROM part")
def txt_23_cost_label(spark, sf_dir):
    cost = T.cost_per_million(F.col("p_size") * F.lit(1e-7))
    return table(spark, sf_dir, "part").select("p_partkey", cost.alias("cost"), T.cost_label(cost).alias("label"))


@query(f"SELECT page_id, '# ' || {DECODED_SQL} || chr(10) || chr(10) || 'Source: ' || url || chr(10) || chr(10) || CASE WHEN page_id % 2 = 0 THEN 'Byline: ' || page_id || chr(10) || chr(10) ELSE '' END || '_No markdown generated._' || chr(10) AS document FROM pages")
def txt_28_page_document(spark, sf_dir):
    """Every page's document without a body, every second with a byline."""
    byline = F.when(F.col("page_id") % 2 == 0, F.col("page_id").cast("string"))
    return table(spark, sf_dir, "pages").select("page_id", O.page_document(U.page_title(F.col("html"), F.col("url")), F.col("url"), byline, F.lit(" ")).alias("document"))


@query("SELECT page_id, url AS loc FROM pages")
def url_09_sitemap_locs(spark, sf_dir):
    """Each page's address out of a sitemap that lists it, escaped, and a blank one."""
    xml = F.concat(F.lit("<urlset><url><LOC>\n "), T.escape_html(F.col("url")), F.lit(" </LOC></url><url><loc> </loc></url></urlset>"))
    return table(spark, sf_dir, "pages").select("page_id", F.explode(U.sitemap_locs(xml)).alias("loc"))


@query(r"SELECT page_id, regexp_matches(url, '(?i)sitemap|\.xml(\?|$)') AS sitemap, regexp_matches(url, '(?i)html|xml') AS page_type FROM pages")
def url_10_sitemap_type(spark, sf_dir):
    """Addresses that look like sitemaps; addresses stand in for content types."""
    return table(spark, sf_dir, "pages").select("page_id", U.is_sitemap(F.col("url")).alias("sitemap"), U.is_page_type(F.col("url")).alias("page_type"))


@query("""WITH e AS (SELECT p_partkey, CASE p_partkey % 4 WHEN 0 THEN 'JPG' WHEN 1 THEN 'tiff' WHEN 2 THEN 'md' ELSE 'pdf' END AS ext FROM part)
SELECT p_partkey, CASE ext WHEN 'JPG' THEN 'image/jpeg' WHEN 'tiff' THEN 'image/tiff' ELSE 'application/octet-stream' END AS type, ext = 'md' AS as_text FROM e""")
def src_22_types(spark, sf_dir):
    """Image types, and whether a file is read as text, of names with four endings."""
    ext = F.element_at(F.array(*(F.lit(x) for x in ("JPG", "tiff", "md", "pdf"))), (F.col("p_partkey") % 4 + 1).cast("int"))
    ending = T.file_extension(F.concat(F.lit("f."), ext))
    return table(spark, sf_dir, "part").select("p_partkey", T.image_type(ending).alias("type"), ending.isin(S.READ_AS_TEXT).alias("as_text"))


@query("WITH " + _blocks_sql("SELECT conv_id, turn, text FROM conversations WHERE text <> ''", "conv_id", "turn", 1, 2000))
def ext_08_region_merge(spark, sf_dir):
    """Turns of a conversation as picked regions, joined in document order, in blocks of 2,000 characters."""
    picks = table(spark, sf_dir, "conversations").select(F.col("conv_id").alias("page"), F.col("turn").alias("pos"), F.col("text").alias("html"))
    return A.merged_regions(picks, 2000).withColumnRenamed("page", "conv_id")


@query("""SELECT c_custkey, 'Name: ' || c_name || chr(10) || chr(10) || ' caf' || chr(233) || ' ' || chr(128512) || ' ' || c_mktsegment || chr(10) || 'end' AS text FROM customer""")
def src_17_rtf(spark, sf_dir):
    """One small RTF file for each customer: a paragraph, characters by byte and by UTF-16 unit, escaped braces (which go with the others) and a line."""
    raw = F.concat(F.lit("{\\rtf1\\ansi{\\b Name: "), "c_name", F.lit("}\\par caf\\'e9 \\u-10179?\\u-8704? \\{"), "c_mktsegment", F.lit("\\}\\line{}end}"))
    return table(spark, sf_dir, "customer").select("c_custkey", T.rtf_text(raw).alias("text"))


@query("""SELECT c_custkey, c_name || ', "x"' || chr(10) || 'y' || '|' || '' || '|' || c_mktsegment || '|' || chr(57344) AS cells FROM customer""")
def txt_06_csv(spark, sf_dir):
    """Quoted commas, quotes and line breaks, empty cells and blank rows, and a character from the private area."""
    raw = F.concat(F.lit('"'), "c_name", F.lit(', ""x""\ny", ,'), "c_mktsegment", F.lit(" \r\n , \n\ue000"))
    return table(spark, sf_dir, "customer").select("c_custkey", F.array_join(F.flatten(T.csv_rows(raw)), "|").alias("cells"))


@query("SELECT doc_id, '<p>' || (CASE WHEN doc_id % 2 = 0 THEN text ELSE '' END) AS raw, 1000 <= length(text) AND (length(text) // 4) < length(text) * 0.3 AS collapsed FROM documents")
def ext_03_over_collapsed(spark, sf_dir):
    kept = F.when(F.col("doc_id") % 2 == 0, F.col("text")).otherwise("")
    return table(spark, sf_dir, "documents").select("doc_id", F.concat(F.lit("<p>"), kept).alias("raw"), T.over_collapsed(F.length("text"), F.floor(F.length("text") / 4)).alias("collapsed"))


@query("SELECT doc_id, '  ' || replace(text, chr(10), chr(10) || '  ') AS text FROM documents")
def edt_04_indent(spark, sf_dir):
    """All lines of every text indented by two."""
    return table(spark, sf_dir, "documents").select("doc_id", E.act("indent", F.col("text"), F.lit(0), F.length("text"), amount=2)["text"].alias("text"))


@query("SELECT page_id, 'http_' || length(url) || '.test' || '.crawl.jsonl' AS output, '# ' || page_id || chr(10) || chr(10) || 'Source: ' || url || chr(10) || chr(10) || '_No markdown generated._' || chr(10) AS document FROM pages")
def url_13_output(spark, sf_dir):
    host = F.concat(F.lit("http:"), F.length("url").cast("string"), F.lit(".test"))
    document = O.widget_document(F.col("page_id").cast("string"), F.col("url"), F.lit(""))
    return table(spark, sf_dir, "pages").select("page_id", U.default_output(host, "jsonl").alias("output"), document.alias("document"))


@query("SELECT p_partkey AS page_id, 'http://site.test/q/' || p_partkey AS url FROM part WHERE p_partkey IN (SELECT p_partkey FROM part ORDER BY p_partkey DESC LIMIT 13)")
def crw_03_seed_order(spark, sf_dir):
    """Every part is a seed, the last ones first; the page budget of 13 takes them in the order of their numbers."""
    part = table(spark, sf_dir, "part").select(F.col("p_partkey").alias("page_id"), F.concat(F.lit("http://site.test/q/"), F.col("p_partkey").cast("string")).alias("url"))
    seeds = part.select(F.lit("http://site.test/").alias("root"), "url", F.lit("sitemap").alias("source"), (F.lit(1_000_000_000) - F.col("page_id")).alias("seq"))
    links = part.select(F.col("url").alias("src"), F.lit(0).alias("pos"), F.col("url").alias("dst")).limit(0)
    return C.crawl(seeds, part.select("url"), links, C.CrawlOptions(max_pages=13)).join(part, "url").select("page_id", "url")


@query("""SELECT 'http://site.test/' AS root, 0 AS part, 0 AS place, '# Site: site.test - Crawl Output' || chr(10) || 'Crawled: then | Pages: ' || count(*) || ' | Start URL: http://site.test/' || chr(10) || chr(10) || '## Table of Contents' AS text FROM documents
UNION ALL SELECT 'http://site.test/', 1, doc_id, '- [T' || doc_id || '](http://site.test/' || doc_id || ')' FROM documents
UNION ALL SELECT 'http://site.test/', 2, 0, chr(10) || '---' || chr(10)
UNION ALL SELECT 'http://site.test/', 3, doc_id, concat_ws(chr(10), '# Page: http://site.test/' || doc_id, '**Title:** T' || doc_id, '**URL:** http://site.test/' || doc_id, '**Depth:** 1', '**Word Count:** ' || n_chars, '**Fetched At:** now', '**Warnings:** a; b', '', CASE WHEN text = '' THEN '_No markdown extracted._' ELSE text END)
 || CASE WHEN doc_id < (SELECT max(doc_id) FROM documents) THEN chr(10) || chr(10) || '---' || chr(10) ELSE '' END FROM documents""")
def snk_01_site_document(spark, sf_dir):
    """All documents as the pages of one site."""
    url = F.concat(F.lit("http://site.test/"), F.col("doc_id").cast("string"))
    records = table(spark, sf_dir, "documents").select(
        F.lit("http://site.test/").alias("root"), F.col("doc_id").alias("place"), url.alias("url"), F.concat(F.lit("T"), F.col("doc_id").cast("string")).alias("title"), F.lit(1).alias("depth"),
        F.col("n_chars").alias("words"), F.lit("now").alias("fetched_at"), F.array(F.lit("a"), F.lit("b")).alias("warnings"), F.col("text").alias("markdown"),
    )
    return O.site_document(records, "then")


@query(rf"""WITH h AS (SELECT page_id, url, {DECODED_SQL} AS title, {_TEXT_SQL} AS text, list_filter(list_transform(regexp_extract_all(html, '(?is)<a\b[^>]*?\bhref\s*=\s*"([^"]*)"', 1), lambda x: trim(x)), lambda x: x <> '' AND NOT regexp_matches(x, '^(?i)(#|mailto:|tel:|javascript:|data:)')) AS links FROM pages)
SELECT page_id, title, len(links) AS links, len(list_filter(links, lambda x: NOT regexp_matches(x, '^https?://') OR starts_with(x || '/', regexp_extract(url, '^https?://[^/]+') || '/'))) AS internal_links, {_WORDS_SQL} AS words FROM h""")
def page_overview(spark, sf_dir):
    """Title, numbers of links and of links within the site, and words of the text outside tags, of every page."""
    pages = table(spark, sf_dir, "pages").withColumn("links", U.hrefs(F.col("html"))).withColumn("origin", U.origin(F.col("url")))
    inside = F.filter("links", lambda h: U.is_internal_href(h, F.col("origin")))
    words = T.word_count(T.without_tags(F.col("html")))
    return pages.select("page_id", U.page_title(F.col("html"), F.col("url")).alias("title"), F.size("links").cast("long").alias("links"), F.size(inside).cast("long").alias("internal_links"), words.alias("words"))


# The other queries; a module registers its own.
from . import catalogue_files, catalogue_sites  # noqa: E402, F401
