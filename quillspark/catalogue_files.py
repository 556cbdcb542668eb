"""Queries of files, of hooks and options, of providers and models, and of the editor's actions."""

from __future__ import annotations

from pyspark.sql import functions as F

from .functions import editing as E
from .functions import text as T
from .functions import urls as U
from .operators import outputs as O
from .registry import DECODED_SQL, query, table
from .sources import files as S
from .sources import providers as P

_IDS = [p[0] for p in P.PROVIDERS] + ["OpenAI", "none such"]


def _literal(x: object) -> str:
    return "NULL" if x is None else str(x).upper() if isinstance(x, bool) else "'" + x.replace("'", "''") + "'"


_PROVIDERS_SQL = "c(provider, label, default_model, default_url, needs_key, vision, signup_url) AS (VALUES " + ", ".join("(" + ", ".join(map(_literal, p)) + ")" for p in P.PROVIDERS) + ")"


@query(f"""WITH {_PROVIDERS_SQL}, e AS (SELECT p_partkey, list_extract([{", ".join(map(_literal, _IDS))}, NULL], 1 + CAST(p_partkey % {len(_IDS) + 1} AS INT)) AS id FROM part)
SELECT p_partkey, coalesce(c.provider, 'disabled') AS provider, coalesce(c.label, d.label) AS label, coalesce(c.default_model, '') AS default_model, coalesce(c.needs_key, false) AS needs_key, coalesce(c.vision, false) AS vision, CASE WHEN c.needs_key THEN 'APP_' || upper(c.provider) || '_API_KEY' ELSE '' END AS env_var
FROM e LEFT JOIN c ON c.provider = e.id, c d WHERE d.provider = 'disabled'""")
def udf_10_providers(spark, sf_dir):
    """Parts dealt over all ids of providers, one in other case, one unknown and none."""
    id = F.element_at(F.array(*map(F.lit, _IDS), F.lit(None).cast("string")), (F.col("p_partkey") % (len(_IDS) + 1) + 1).cast("int"))
    rows = P.with_provider(table(spark, sf_dir, "part").select("p_partkey", id.alias("id")), F.col("id"), P.providers(spark, "app"))
    return rows.select("p_partkey", "provider", "label", "default_model", "needs_key", "vision", F.coalesce("env_var", F.lit("")).alias("env_var"))


@query(f"""WITH {_PROVIDERS_SQL}, n AS (SELECT count(*) AS n FROM part) SELECT row_number() OVER () AS place, provider, n FROM c, n WHERE provider <> 'disabled'""")
def udf_10_choices(spark, sf_dir):
    """The providers to choose from, in order, with the number of parts they are offered to."""
    parts = table(spark, sf_dir, "part").agg(F.count("*").alias("n"))
    return P.choices(P.providers(spark, "app")).join(F.broadcast(parts)).select(F.col("place").cast("long").alias("place"), "provider", "n")


def _reader():
    """An engine whose image is its text: the text as found, its words in a row of boxes."""
    return lambda content, language: {"text": f"{content.decode()} [{language}]", "words": [{"text": w, "confidence": 50, "bbox": {"x0": i, "y0": 0, "x1": i + 2, "y1": 1}} for i, w in enumerate(content.decode().split()[:1])]}


def _sizer():
    def describe(image):
        if len(image.content) % 7 == 0:
            raise ValueError("no answer")
        return f"{image.mime_type} of {len(image.content)} bytes"

    return describe


@query(r"""WITH d AS (SELECT doc_id, trim(text, ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)) AS text, octet_length(encode(text)) AS n, doc_id % 2 = 0 AS layout, CASE WHEN doc_id % 3 = 0 THEN 'deu' ELSE 'eng' END AS language, doc_id % 5 < 3 AS asked FROM documents),
w AS (SELECT *, list_filter(regexp_split_to_array(text, '[ \t\n\x0B\f\r]+'), lambda x: x <> '')[1] AS word FROM d)
SELECT doc_id || '.png' AS filename, concat_ws(chr(10) || chr(10), CASE WHEN asked AND n % 7 > 0 THEN '## Image Description' || chr(10) || chr(10) || 'image/png of ' || n || ' bytes' END,
 '## OCR Text' || chr(10) || chr(10) || trim(text || ' [' || language || ']'), CASE WHEN layout AND word IS NOT NULL THEN '## Text Positioning' || chr(10) || chr(10) || '| Text | Confidence | Left | Top | Width | Height |' || chr(10) || '| --- | ---: | ---: | ---: | ---: | ---: |' || chr(10) || '| ' || replace(word, '|', '\|') || ' | 50.0 | 0 | 0 | 2 | 1 |' END) AS markdown,
 concat_ws('; ', 'OCR runs locally and may take longer on large images. First run can download language data.', CASE WHEN asked AND n % 7 = 0 THEN 'AI image description failed, so only OCR output was included.' END) AS warnings FROM w""")
def udf_01_hooks(spark, sf_dir):
    """Every document as an image, read and (three of five) described by hooks, each with options of its own as JSON."""
    options = F.to_json(F.struct(F.struct((F.col("doc_id") % 2 == 0).alias("includeLayoutTable"), F.when(F.col("doc_id") % 3 == 0, "deu").alias("language"), F.when(F.col("doc_id") % 5 < 3, "sizer").alias("describer")).alias("image")))
    text = T.trim_all(F.col("text"))
    files = table(spark, sf_dir, "documents").select(F.concat(F.col("doc_id").cast("string"), F.lit(".png")).alias("filename"), F.when(F.length("text") > 0, F.col("text")).otherwise("").cast("binary").alias("content"), options.alias("options"), text.alias("plain"))
    return S.convert(files, recogniser=_reader, describers={"sizer": _sizer}).select("filename", "markdown", F.array_join("warnings", "; ").alias("warnings"))


@query("""WITH e AS (SELECT doc_id, text, list_extract(['md', 'PNG', 'xyz', 'epub', 'csv', ''], 1 + CAST(doc_id % 6 AS INT)) AS ext FROM documents)
SELECT doc_id || '.' || ext AS filename, CASE WHEN ext IN ('PNG', 'epub') THEN '' ELSE replace(text, chr(13) || chr(10), chr(10)) END AS text, CASE WHEN ext IN ('PNG', 'epub') THEN hex(encode(text)) ELSE '' END AS content FROM e""")
def src_26_imports(spark, sf_dir):
    """Documents as files brought in by hand: text, bytes as base64, and of unknown endings."""
    ext = F.element_at(F.array(*map(F.lit, ("md", "PNG", "xyz", "epub", "csv", ""))), (F.col("doc_id") % 6 + 1).cast("int"))
    path = F.concat(F.lit("C:\\dir\\"), F.col("doc_id").cast("string"), F.lit("."), ext)
    rows = S.imported(table(spark, sf_dir, "documents").select(path.alias("path"), "text", F.base64(F.encode("text", "UTF-8")).alias("base64")))
    return rows.select("filename", F.coalesce("text", F.lit("")).alias("text"), F.coalesce(F.hex("content"), F.lit("")).alias("content"))


@query("""SELECT p_partkey, '| ' || p_name || ' | 0.0 | ' || p_size || ' | 0 | 0 | 0 |' || chr(10) || '| b | 2.5 | 0 | 0 | ' || p_size || ' | 0 |' AS rows FROM part""")
def src_20_block_words(spark, sf_dir):
    """Words of nested blocks, some of whose levels, words and values are missing."""
    word = "struct<text:string,confidence:double,bbox:struct<x0:double,y0:double,x1:double,y1:double>>"
    kind = f"array<struct<paragraphs:array<struct<lines:array<struct<words:array<{word}>>>>>>>"
    json = F.concat(
        F.lit('[null,{"paragraphs":null},{"paragraphs":[{"lines":[{"words":[null,'), F.to_json(F.struct(F.col("p_name").alias("text"), F.struct(F.col("p_size").alias("x0")).alias("bbox"))),
        F.lit(']},{"words":null}]},{"lines":[{"words":[{"text":"b","confidence":2.5,"bbox":{"x1":'), F.col("p_size").cast("string"), F.lit('}},{"confidence":1}]}]}]}]'),
    )
    boxes = T.word_boxes(T.block_words(F.from_json(json, kind)))
    lines = F.split(T.layout_table(boxes), "\n")
    return table(spark, sf_dir, "part").select("p_partkey", F.array_join(F.slice(lines, F.lit(3), F.size(lines)), "\n").alias("rows"))


@query("""SELECT doc_id, CAST(to_json({'inputPath': doc_id || '.md', 'outputPath': CASE WHEN doc_id % 2 = 0 THEN doc_id || '.out.md' END, 'markdown': text, 'warnings': CASE WHEN text = '' THEN ['empty'] ELSE [] END}) AS VARCHAR) AS line FROM documents""")
def snk_05_conversion_json(spark, sf_dir):
    name = F.col("doc_id").cast("string")
    warnings = F.when(F.col("text") == "", F.array(F.lit("empty"))).otherwise(F.expr("cast(array() as array<string>)"))
    line = O.conversion_json(F.concat(name, F.lit(".md")), F.when(F.col("doc_id") % 2 == 0, F.concat(name, F.lit(".out.md"))), F.col("text"), warnings)
    return table(spark, sf_dir, "documents").select("doc_id", line.alias("line"))


@query(rf"""WITH t AS (SELECT page_id, regexp_replace(regexp_replace(strip_accents(lower({DECODED_SQL})), '[^a-z0-9]+', '-', 'g'), '^-+|-+$', '', 'g') AS slug FROM pages) SELECT page_id, CASE WHEN slug = '' THEN 'page' ELSE left(slug, 60) END AS slug FROM t""")
def txt_12_slug(spark, sf_dir):
    return table(spark, sf_dir, "pages").select("page_id", T.filename_slug(U.page_title(F.col("html"), F.col("url")), "page").alias("slug"))


@query("""SELECT conv_id, turn, CASE turn % 4 WHEN 0 THEN trim(text, ' ' || chr(9) || chr(10) || chr(13)) WHEN 1 THEN trim(text || chr(10) || 'and' || chr(10), ' ' || chr(9) || chr(10) || chr(13)) ELSE '' END AS content FROM conversations""")
def txt_21_message_content(spark, sf_dir):
    """Turns as the contents of messages: a string, an array with items that have no text, an object, and no JSON."""
    text, turn = F.to_json(F.array("text")), F.col("turn") % 4
    string = F.regexp_replace(text, r"^\[|\]$", "")
    raw = F.when(turn == 0, string).when(turn == 1, F.concat(F.lit('[{"text":'), string, F.lit('},{"text":"and"},{"text":5}]'))).when(turn == 2, F.concat(F.lit('{"text":'), string, F.lit("}"))).otherwise("{no json")
    return table(spark, sf_dir, "conversations").select("conv_id", "turn", T.message_content(raw).alias("content"))


@query("""SELECT p_partkey, 'see ![' || p_name || '](/i/' || p_partkey || '.png)' || chr(10) || chr(10) || '> OCR: one' || chr(10) || '> ' || p_name || chr(10) || ' and more' || chr(10) || chr(10) || '> OCR: last' || chr(10) AS markdown FROM part""")
def ext_06_splice(spark, sf_dir):
    """Text of two images, one of which the Markdown shows."""
    name = F.col("p_name")
    image = lambda src, alt, text: F.struct(src.alias("src"), alt.alias("alt"), text.alias("text"))
    source = F.concat(F.lit("http://h.test/i/"), F.col("p_partkey").cast("string"), F.lit(".png?w=2"))
    images = F.array(image(source, name, F.concat(F.lit(" one\n"), name)), image(F.lit("gone.gif"), F.lit(""), F.lit("last")), image(F.lit("x.png"), name, F.lit(" ")))
    markdown = F.concat(F.lit("see !["), name, F.lit("](/i/"), F.col("p_partkey").cast("string"), F.lit(".png) and more"))
    return table(spark, sf_dir, "part").select("p_partkey", T.splice_ocr(markdown, images).alias("markdown"))


@query("""SELECT p_partkey, CASE p_partkey % 4 WHEN 0 THEN 'Could not read this page.' WHEN 1 THEN 'App can''t read other extensions'' pages.' WHEN 2 THEN 'Click the App icon in the toolbar to grant access to this page, then try again.' ELSE p_name END AS said FROM part""")
def ext_10_errors(spark, sf_dir):
    kind = F.col("p_partkey") % 4
    message = F.when(kind == 0, "").when(kind == 1, "Refused: CHROME-EXTENSION://abc").when(kind == 2, "Cannot access contents of the page.").otherwise(F.col("p_name"))
    return table(spark, sf_dir, "part").select("p_partkey", T.extraction_error(message, "App").alias("said"))


_MODELS = r"""m AS (SELECT p_partkey, CASE p_partkey % 9 WHEN 0 THEN 'text-EMBED-' WHEN 1 THEN 'audio-' WHEN 2 THEN 'my-tts-' WHEN 3 THEN 'moderation-' WHEN 4 THEN 'rerank-' WHEN 5 THEN 'search-' WHEN 6 THEN 'vision-' ELSE 'chat-' END || p_partkey AS id FROM part)"""


@query(f"""WITH {_MODELS}, c AS (SELECT m.id, CASE WHEN p_partkey % 2 = 0 THEN m.id ELSE 'Model ' || p_partkey END AS title, floor(p_size * 1.0e-7 * 1e8 + 0.5) / 100 AS input_cost, p_partkey % 9 = 6 OR p_partkey % 5 = 0 AS vision FROM m JOIN part USING (p_partkey) WHERE p_partkey % 9 >= 6 AND p_partkey % 4 > 0)
SELECT id, title, input_cost, vision FROM c ORDER BY input_cost, id LIMIT 15""")
def udf_08_models(spark, sf_dir):
    """The cheapest general models of a catalogue in which parts are models of nine kinds, some without a price; the limit is the feature."""
    part, kind = table(spark, sf_dir, "part"), F.col("p_partkey") % 9
    names = F.element_at(F.array(*map(F.lit, ("text-EMBED-", "audio-", "my-tts-", "moderation-", "rerank-", "search-", "vision-", "chat-", "chat-"))), (kind + 1).cast("int"))
    models = part.select(
        F.concat(names, F.col("p_partkey").cast("string")).alias("id"), F.when(F.col("p_partkey") % 2 == 1, F.format_string("Model %s", F.col("p_partkey"))).alias("name"),
        F.when(F.col("p_partkey") % 4 > 0, F.concat(F.lit("0.00000"), F.lpad(F.col("p_size").cast("string"), 2, "0"))).alias("prompt"), F.lit("0").alias("completion"),
        F.lit(None).cast("long").alias("context_length"), F.when(F.col("p_partkey") % 5 == 0, F.array(F.lit("text"), F.lit("image"))).alias("modalities"),
    )
    return S.model_choices(models).select("id", "title", "input_cost", "vision")


_PICK = "coalesce(substr(text, 3, 4), '')"


@query(f"""WITH t AS (SELECT doc_id, left(regexp_replace(text, '\\s', '.', 'g') || 'abcdefgh', 20) AS text FROM documents), s AS (SELECT *, {_PICK} AS s, left(text, 2) AS a, substr(text, 7) AS b FROM t)
SELECT doc_id, a || '**' || s || '**' || b AS wrapped, '> ' || text AS quoted, text || ' {{#custom-id}}' AS with_id, a || '[^1]' || b || chr(10) || chr(10) || '[^1]: footnote text' AS noted, a || '[' || s || '](url)' || b AS linked, a || '![alt text](image-url)' || b AS pictured, a || '---' || chr(10) || b AS ruled, length(a) + 8 AS caret FROM s""")
def edt_01_actions(spark, sf_dir):
    """Seven actions on the third to sixth character of the first twenty of every text."""
    text = F.left(F.concat(F.regexp_replace("text", r"[ \t\n\f\r]", "."), F.lit("abcdefgh")), F.lit(20))
    rows = table(spark, sf_dir, "documents").select("doc_id", text.alias("t"))
    do = lambda name, **o: E.act(name, F.col("t"), F.lit(2), F.lit(6), **o)
    made = {"wrapped": do("wrap", before="**", after="**"), "quoted": do("prefixToggle", syntax="> "), "with_id": do("headingId"), "noted": do("footnote"), "linked": do("link"), "pictured": do("image"), "ruled": do("insert", syntax="---\\n")}
    return rows.select("doc_id", *(c["text"].alias(n) for n, c in made.items()), made["wrapped"]["end"].cast("long").alias("caret"))
