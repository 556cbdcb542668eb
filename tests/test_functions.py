"""Literal cases of functions, sources, outputs and the crawl, with the results that the reference gives."""

import json

import pytest
from pyspark.sql import functions as F

from quillspark.functions import editing as E
from quillspark.functions import text as T
from quillspark.functions import urls as U
from quillspark.operators import crawl as C
from quillspark.operators import outputs as O
from quillspark.sources import files as S


def one(spark, column, **values):
    """A column's value over literals."""
    row = spark.range(1).select(*(v.alias(k) if hasattr(v, "alias") else F.lit(v).alias(k) for k, v in values.items()))
    return row.select(column.alias("x")).first()["x"]


def test_conversion(spark):
    rows = [
        ("note.txt", "Hello\r\nWorld"), ("memo.rtf", r"{\rtf1\ansi\deff0 {\fonttbl {\f0 Times New Roman;}}\f0\fs24 Hello\par World}"),
        ("table.csv", "Name,Role\nAda,Engineer\nLinus,Maintainer"), ("file.xyz", "ignored"), ("one.CSV", "a,b"), ("none.csv", " \n"), ("empty.rtf", "{}"), ("a.html", "<p>"), ("b.docx", None),
    ]
    got = {r["filename"]: r for r in S.convert(spark.createDataFrame(rows, "filename string, text string")).collect()}
    assert got["note.txt"]["markdown"] == "Hello\nWorld" and got["note.txt"]["title"] == "note" and got["note.txt"]["warnings"] == []
    assert got["memo.rtf"]["markdown"].endswith("Hello\n\n World") and got["memo.rtf"]["warnings"] == []
    assert got["table.csv"]["markdown"] == "| Name | Role |\n| --- | --- |\n| Ada | Engineer |\n| Linus | Maintainer |"
    assert got["file.xyz"]["markdown"] == "" and got["file.xyz"]["warnings"] == ["Unsupported file format: .xyz"]
    assert got["one.CSV"]["warnings"] == ["Only one row was found; created a single-row markdown table."]
    assert got["none.csv"]["warnings"] == ["The CSV appears to be empty."] and got["none.csv"]["markdown"] == ""
    assert got["empty.rtf"]["warnings"] == ["No readable text was extracted from this RTF file."]
    assert got["a.html"]["warnings"] and got["b.docx"]["warnings"] and got["b.docx"]["markdown"] == ""
    assert S.convert(spark.createDataFrame(rows, "filename string, text string"), True).where("filename = 'file.xyz'").first()["markdown"] == "ignored"


def test_images_and_pdf(spark):
    word = "struct<text: string, confidence: double, bbox: struct<x0: double, y0: double, x1: double, y1: double>>"
    detected = ("Detected", 96.3, (10.0, 20.0, 80.0, 40.0))
    many = [("w", 1.0, (float(i), 0.0, 1.0, 1.0)) for i in range(301)]
    rows = [
        ("scan.png", None, "Detected text", [detected], "A scanned receipt."), ("empty.png", None, "", [], None), ("long.png", None, "x", many, None),
        ("two.pdf", ["a\r\n\n\n\nb", " "], None, None, None), ("one.pdf", [" a "], None, None, None), ("none.pdf", ["", "\n"], None, None, None),
    ]
    files = spark.createDataFrame(rows, f"filename string, pages array<string>, ocr_text string, words array<{word}>, description string").withColumn("text", F.lit(None).cast("string"))
    got = {r["filename"]: r for r in S.convert(files).collect()}
    assert got["scan.png"]["markdown"].split("\n\n")[:4] == ["## Image Description", "A scanned receipt.", "## OCR Text", "Detected text"]
    assert "| Detected | 96.3 | 10 | 20 | 70 | 20 |" in got["scan.png"]["markdown"] and len(got["scan.png"]["warnings"]) == 1
    assert got["empty.png"]["markdown"] == "" and got["empty.png"]["warnings"][1] == "No readable text was detected in this image."
    assert got["long.png"]["markdown"].count("\n| w |") == 300 and got["long.png"]["warnings"][1] == "Text positioning table was truncated to 300 rows."
    assert got["two.pdf"]["markdown"] == "## Page 1\n\na\n\nb" and got["two.pdf"]["warnings"] == ["Some pages had little or no extractable text."]
    assert got["one.pdf"]["markdown"] == "a" and got["one.pdf"]["warnings"] == []
    assert got["none.pdf"]["markdown"] == "" and got["none.pdf"]["warnings"] == ["No selectable text was found. This PDF may be image-based."]


def test_word_boxes(spark):
    w = F.expr("array(named_struct('text', ' a ', 'confidence', cast(null as double), 'bbox', named_struct('x0', -3.0D, 'y0', -0.5D, 'x1', -4.0D, 'y1', cast(null as double))), named_struct('text', ' ', 'confidence', 1D, 'bbox', null))")
    assert [tuple(x) for x in one(spark, T.word_boxes(F.col("w")), w=w)] == [("a", 0.0, -3, 0, 0, 0)]
    blocks = F.expr("array(named_struct('paragraphs', array(named_struct('lines', array(named_struct('words', array(named_struct('text', 'a', 'confidence', 1.5D, 'bbox', named_struct('x0', 1D, 'y0', 2D, 'x1', cast(null as double), 'y1', 9D)))), null)))), null)")
    got = one(spark, T.block_words(F.col("b")), b=blocks)
    assert [(x["text"], tuple(x["bbox"])) for x in got] == [("a", (1.0, 2.0, 1.0, 9.0))]


@pytest.mark.parametrize(("raw", "want"), [
    (r"a\'e9b", "aéb"), (r"caf\u233 x", "café x"), (r"caf\u233? x", "café x"), (r"\u-10179?\u-8704?", "\U0001f600"), ("a\r\nb", "a\nb"), (r"x\pard y\parx z", "x\n\n y\n\nx z"),
    (r"\{a\\1\}", "a\\1"), (r"\{a\\b\}", "a"), (r"a\line b\tab c", "a\n b\t c"), (r"{\b bold}\par\par\par end", "bold\n\n end"), ("", ""),
])
def test_rtf(spark, raw, want):
    assert one(spark, T.rtf_text(F.col("s")), s=raw) == want


@pytest.mark.parametrize(("raw", "want"), [
    ("a,b\nc", [["a", "b"], ["c"]]), ('"x, y", "say ""hi"""\n', [["x, y", 'say "hi"']]), ('a"b"c,d', [["abc", "d"]]), ('"open\nstill', [["open\nstill"]]), ("\n , \nz", [["z"]]),
    (",1", [["", "1"]]), ("a\rb,c", [["a\rb", "c"]]), ("a\r\nb\r\n", [["a"], ["b"]]), ('""', []), ("a,,b,", [["a", "", "b", ""]]),
])
def test_csv(spark, raw, want):
    assert one(spark, T.csv_rows(F.col("s")), s=raw) == want


def test_small_text_functions(spark):
    assert one(spark, T.blockquote(F.col("s")), s="a\r\nb\nc") == "> a\n> b\n> c"
    assert one(spark, T.to_text(F.col("b")), b=F.lit(b"\xef\xbb\xbfa\xffb")) == "a�b" and bytes(one(spark, T.to_bytes(F.col("s")), s="é")) == b"\xc3\xa9"
    assert [one(spark, T.filename_slug(F.col("s"), "page"), s=s) for s in ("Crème Brûlée!", "--", "ﬁne", "x" * 70)] == ["creme-brulee", "page", "fine", "x" * 60]
    assert [one(spark, T.message_content(F.col("s")), s=s) for s in ('" hi "', '[{"text": "a"}, 3, {"text": 5}, {"text": "b"}]', '{"text": "a"}', "broken")] == ["hi", "a\n\n\nb", "", ""]
    assert [one(spark, T.major_version(F.col("s")), s=s) for s in ("v22.1.0", "18", "x.1", "")] == [22, 18, 0, 0]
    words = F.expr("transform(sequence(1, 41), i -> named_struct('text', concat('w', i)))")
    prompt = one(spark, T.describe_prompt(F.col("s"), F.col("w")), s=" " + "x" * 3001, w=words).split("\n")
    assert prompt[4] == "OCR text excerpt: " + "x" * 3000 and prompt[5].endswith("w39, w40") and prompt[3] == ""
    assert one(spark, T.describe_prompt(F.lit(""), F.expr("cast(array() as array<struct<text: string>>)"))).endswith("excerpt: (none)\nDetected words sample: (none)")
    lines = {"# a <b>": '<span class="pbw-md-heading"># a &lt;b&gt;</span>', " - `x` y": ' <span class="pbw-md-bullet">-</span> <span class="pbw-md-code">`x`</span> y', "[a](b)": '<span class="pbw-md-link">[a](b)</span>', "#x": "#x"}
    assert {k: one(spark, T.highlight_line(F.col("s")), s=k) for k in lines} == lines
    assert [one(spark, T.over_collapsed(F.lit(a), F.lit(b))) for a, b in ((1000, 299), (1000, 300), (999, 1))] == [True, False, False]
    assert one(spark, T.extraction_error(F.lit("Cannot access a chrome:// URL"), "X")).startswith("This browser locks") and one(spark, T.extraction_error(F.lit("odd"), "X")) == "odd"
    assert [one(spark, f(F.col("s")), s=".MD") for f in (T.app_extension, T.app_stem, T.file_extension, T.file_stem)] == ["md", "", "", ".MD"]


def test_ocr_beside_images(spark):
    images = F.expr("array(named_struct('src', 'https://h/a+b.png?x=1', 'alt', 'An (odd)\\nalt', 'text', ' one\\ntwo '), named_struct('src', 'z.gif', 'alt', '', 'text', 'last'), named_struct('src', 'q', 'alt', '', 'text', ' '))")
    got = one(spark, T.splice_ocr(F.col("m"), F.col("i")), m="x ![](a+b.png) ![An (odd) alt](/i/A+B.png) y", i=images)
    assert got == "x ![](a+b.png) ![An (odd) alt](/i/A+B.png)\n\n> OCR: one\n> two\n y\n\n> OCR: last\n"


def test_urls(spark):
    html = "<a href=x'y>1</a><A class=b HREF = \"/q?a=1\">2</A><a href='#t'>3</a><a href=mailto:x>4</a><a href=plain>5</a>"
    assert one(spark, U.hrefs(F.col("h")), h=html) == ["x", "/q?a=1", "plain"]
    cases = {"../b": "http://h.test/a/b", "c?x#y": "http://h.test/a/b/c", "//Q.test:80/": "http://q.test/", "HTTPS://h.test:443/p/": "https://h.test/p", "mailto:x": None, "": "http://h.test/a/b/x", "/" + "s/" * 10_002: "http://h.test/" + "s/" * 10_001 + "s"}
    assert {k: one(spark, U.normalise(F.col("u"), F.lit("http://h.test/a/b/x")), u=k) for k in cases} == cases
    paths = {"http://h/": "index.md", "http://h/a/b.html": "a/b.md", "http://h/a:b": "a-b/index.md", "http://h/x.": "x..md", "http://h/a/ /c.d": "a/index/c.md"}
    assert {k: one(spark, U.mirror_path(F.col("u")), u=k) for k in paths} == paths
    assert one(spark, U.default_output(F.lit("h_é.test"), "single")) == "h__.test.crawl.md"
    assert tuple(one(spark, U.image_source(F.lit("data:image/png;base64,aGk=")))) == ("data:image/png;base64,aGk=", b"hi") and one(spark, U.image_source(F.lit("//h/i")))["url"] == "https://h/i"
    with pytest.raises(ValueError):
        C.CrawlOptions(include="a,(")
    with pytest.raises(ValueError):
        C.CrawlOptions(max_pages=0)


def test_editing(spark):
    t = "one\ntwo\nthree"
    do = lambda name, s, a, b, **o: tuple(one(spark, E.act(name, F.col("t"), F.lit(a), F.lit(b), **o), t=s))
    assert do("wrap", t, 4, 7, before="**", after="**") == ("one\n**two**\nthree", 11, 11)
    assert do("wrap", t, 4, 4, before="_", after="_", placeholder="text") == ("one\n_text_two\nthree", 5, 9)
    assert do("prefix", t, 1, 5, syntax="> ") == ("> one\n> two\nthree", 0, 11)
    assert do("prefixToggle", "> a\nb", 0, 5, syntax="> ") == ("a\n> b", 0, 5)
    assert do("indent", t, 4, 4, amount=2) == ("one\n  two\nthree", 4, 9) and do("indent", "    a", 0, 0, amount=-2) == ("  a", 0, 3)
    assert do("headingId", "# h {#custom-id}\nx", 3, 3) == ("# h {#custom-id}\nx", 6, 15)
    assert do("footnote", "a[^7] b", 7, 7) == ("a[^7] b[^8]\n\n[^8]: footnote text", 9, 10) and do("footnote", "", 0, 0)[0] == "[^1][^1]: footnote text"
    assert do("link", t, 0, 3) == ("[one](url)\ntwo\nthree", 6, 6) and do("link", "", 0, 0) == ("[link text](url)", 1, 10)
    assert do("insert", "ab", 1, 2, syntax="---") == ("a---", 4, 4) and do("image", "", 0, 0)[1:] == (2, 10) and do("unknown", t, 1, 2) == (t, 1, 2)
    assert one(spark, E.decode_escapes(F.lit(r"a\n\tb"))) == "a\n\tb"


def test_imports_and_models(spark):
    rows = [("d/a.md", "x\r\ny", None), ("b.PDF", None, "aGk="), ("c.zip", "z", "aGk="), ("bad.png", None, "*")]
    got = {r["filename"]: (r["text"], r["content"] and bytes(r["content"])) for r in S.imported(spark.createDataFrame(rows, "path string, text string, base64 string")).collect()}
    assert got == {"a.md": ("x\ny", None), "b.PDF": (None, b"hi"), "c.zip": ("z", None), "bad.png": (None, None)}
    assert [one(spark, S.keeps_path(F.lit(p))) for p in ("a.mdx", "a.txt")] == [True, False]
    models = [("m/vision", None, "0.000002", "0.00001", 10, None), ("free", "F", "0", "0", 1, None), ("text-embed", "E", "0.0000001", None, 1, None), ("m/b", "B", "0.0000015", None, None, ["text", "image"]), ("m/t", "T", "0.000003", "x", 5, ["text"])]
    got = S.model_choices(spark.createDataFrame(models, "id string, name string, prompt string, completion string, context_length int, modalities array<string>"), 3).collect()
    assert [(r["title"], r["input_cost"], r["vision"]) for r in got] == [("B", 1.5, True), ("m/vision", 2.0, True), ("T", 3.0, False)]


def test_files(spark, tmp_path):
    (tmp_path / "in").mkdir()
    (tmp_path / "in/a.txt").write_bytes(b"\xef\xbb\xbfhi\xff\r\n")
    (tmp_path / "in/b.png").write_bytes(b"\x89PNG")
    got = {r["filename"]: (r["text"], bytes(r["content"])) for r in S.read_files(spark, str(tmp_path / "in")).collect()}
    assert got["a.txt"][0] == "hi�\r\n" and got["b.png"] == (None, b"\x89PNG")


def test_documents(spark):
    none = F.expr("cast(array() as array<string>)")
    assert one(spark, O.mirror_file(F.lit('a "b"'), F.lit("http://h/"), F.lit(1), F.lit(2), F.lit(""))) == '---\ntitle: "a \\"b\\""\nurl: "http://h/"\ndepth: 1\nwordCount: 2\n---\n\n_No markdown extracted._\n'
    line = one(spark, O.jsonl(F.lit("u"), F.lit("t"), F.lit("m\n"), F.lit(0), F.lit("seed"), F.lit("now"), F.lit(1), none))
    assert line == json.dumps({"url": "u", "title": "t", "markdown": "m\n", "metadata": {"depth": 0, "source": "seed", "fetchedAt": "now", "wordCount": 1, "warnings": []}}, separators=(",", ":"))
    assert one(spark, O.widget_document(F.lit(""), F.lit("u"), F.lit(" "))) == "# Untitled page\n\nSource: u\n\n_No markdown generated._\n"
    assert json.loads(one(spark, O.conversion_json(F.lit("a"), F.lit(None).cast("string"), F.lit("m"), none))) == {"inputPath": "a", "outputPath": None, "markdown": "m", "warnings": []}


WEB = [
    # url, status, content_type, html
    ("http://h.test/sitemap.xml", 200, "text/xml", "<loc>http://h.test/s1</loc><loc>/nested-sitemap.xml</loc><loc>http://x.test/out</loc><loc>http://h.test/gone</loc>"),
    ("http://h.test/nested-sitemap.xml", 200, "text/xml", "<loc>http://h.test/s2</loc><loc>http://h.test/sitemap.xml</loc><loc>http://h.test/third.xml</loc><loc>http://h.test/s1</loc>"),
    ("http://h.test/third.xml", 200, "text/xml", "<loc>http://h.test/s3</loc>"),
    ("http://h.test/", 200, "text/html", "<a href=/p1>1</a><a href='p2'>2</a><a href=http://x.test/>x</a><a href=/p1#a>1</a>"),
    ("http://h.test/s1", 200, "text/html", "<a href=/p2>2</a>"), ("http://h.test/s2", 200, "text/html; charset=utf-8", ""), ("http://h.test/s3", 200, "application/xhtml+xml", ""),
    ("http://h.test/p1", 200, "image/png", ""), ("http://h.test/p2", 200, "text/html", "<a href=/deep>d</a><a href=/skip/me>s</a>"), ("http://h.test/deep", 200, "text/html", "<a href=/deeper>d</a>"),
    ("http://h.test/gone", 404, "text/html", ""), ("http://h.test/skip/me", 200, "text/html", ""), ("http://h.test/deeper", 200, "text/html", ""),
]


def plain_crawl(start, options, seeds):
    """One queue, one page after the other."""
    web, links = {u: (s, t, h) for u, s, t, h in WEB}, {"http://h.test/": ["p1", "p2"], "http://h.test/s1": ["p2"], "http://h.test/p2": ["deep", "skip/me"], "http://h.test/deep": ["deeper"]}
    queue, seen, out = [(u, 0) for u in [*seeds, start]], set(), []
    queued = set()
    queue = [x for x in queue if not (x[0] in queued or queued.add(x[0]))]
    while queue and sum(w is None for _, _, w in out) < options.max_pages:
        url, depth = queue.pop(0)
        if url in seen or "skip" in url:
            continue
        seen.add(url)
        status, kind, _ = web.get(url, (0, "", ""))
        if status != 200:
            out.append((url, depth, f"Skipping {url} (HTTP {status or 'error'})."))
        elif "html" not in kind and "xml" not in kind:
            out.append((url, depth, f"Skipping {url} (non-HTML content type: {kind})."))
        else:
            out.append((url, depth, None))
            for x in links.get(url, []) if depth < options.max_depth else []:
                x = f"http://h.test/{x}"
                if x not in queued and x not in seen:
                    queued.add(x)
                    queue.append((x, depth + 1))
    return out


@pytest.mark.parametrize(("max_pages", "max_depth"), [(300, 4), (300, 1), (3, 4), (4, 2), (5, 4)])
def test_crawl(spark, max_pages, max_depth):
    options = C.CrawlOptions(max_pages=max_pages, max_depth=max_depth, exclude="skip/")
    web = spark.createDataFrame(WEB, "url string, status int, content_type string, html string")
    roots = spark.createDataFrame([("http://h.test",)], "root string")
    found, warned = C.sitemap_pages(roots, web, options)
    order = [r["url"] for r in found.orderBy("seq").collect()]
    assert order == [f"http://h.test/{x}" for x in ("s1", "gone", "s2", "s3")] and warned.isEmpty()
    rows = C.visit(C.queue(roots, found, options), web, C.page_links(web), options).orderBy("depth", "seq").collect()
    assert [(r["url"], r["depth"], r["warning"]) for r in rows] == plain_crawl("http://h.test/", options, order)
    assert [r["source"] for r in rows[:5]] == (["sitemap"] * 4 + ["seed"])[: len(rows)]


def test_sitemap_cap(spark):
    web = spark.createDataFrame(WEB, "url string, status int, content_type string, html string")
    found, warned = C.sitemap_pages(spark.createDataFrame([("http://h.test",), ("http://none.test",)], "root string"), web, C.CrawlOptions(max_sitemaps=2))
    assert {r["url"][-2:] for r in found.collect()} == {"s1", "ne", "s2"} and [r["root"] for r in warned.collect()] == ["http://h.test"]


def test_seeds_in_the_order_of_their_numbers(spark):
    urls = [f"http://h.test/{i}" for i in range(12)]
    pages = spark.createDataFrame([(u, "") for u in urls], "url string, html string")
    seeds = spark.createDataFrame([("http://h.test/", u, "seed", i) for i, u in enumerate(urls)], "root string, url string, source string, seq int")
    got = C.crawl(seeds, pages, C.page_links(pages), C.CrawlOptions(max_pages=3))
    assert {r["url"] for r in got.collect()} == set(urls[:3])


def test_site_document(spark):
    rows = [("http://h.test/", i, f"http://h.test/{i}", f"T{i}", 0, 2, "now", ["w"] if i else [], "some text" if i else "") for i in range(2)]
    records = spark.createDataFrame(rows, "root string, place int, url string, title string, depth int, words int, fetched_at string, warnings array<string>, markdown string")
    blocks = O.site_document(records, "then").orderBy("part", "place").collect()
    section = lambda i, warned, text: f"# Page: http://h.test/{i}\n**Title:** T{i}\n**URL:** http://h.test/{i}\n**Depth:** 0\n**Word Count:** 2\n**Fetched At:** now\n{warned}\n{text}"
    want = "# Site: h.test - Crawl Output\nCrawled: then | Pages: 2 | Start URL: http://h.test/\n\n## Table of Contents\n- [T0](http://h.test/0)\n- [T1](http://h.test/1)\n\n---\n\n"
    want += section(0, "", "_No markdown extracted._") + "\n\n---\n\n" + section(1, "**Warnings:** w\n", "some text") + "\n"
    assert "\n".join(b["text"] for b in blocks) + "\n" == want
    visited = spark.createDataFrame([("http://h.test/", "a", 9, None), ("http://h.test/", "b", 1, None), ("http://h.test/", "c", None, "Skipping")], "root string, url string, words int, warning string")
    assert tuple(O.crawl_summary(visited, "single", 5).first()) == ("http://h.test/", "single", "h.test.crawl.md", 2, 1, 2)
    assert tuple(O.crawl_summary(visited, "map").first()) == ("http://h.test/", "map", None, 2, 0, 1)
    short = C.short_pages(spark.createDataFrame([("u", 3)], "url string, words int"), C.CrawlOptions(min_words=5)).first()["warning"]
    assert short == "Skipping u (content too short: 3 words, min 5)."
