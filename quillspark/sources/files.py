"""Tables of files and the choice of handlers."""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from ..functions import text as T
from ..operators.hooks import Hook, describe, recognise

# Extensions and the handlers they choose.
HANDLERS = {
    "txt": "text", "md": "text", "markdown": "text", "mdx": "text", "html": "html", "htm": "html", "csv": "csv", "rtf": "rtf",
    "docx": "docx", "pdf": "pdf", "xlsx": "xlsx", "epub": "epub", "png": "image", "jpg": "image", "jpeg": "image", "gif": "image",
    "webp": "image", "bmp": "image", "tif": "image", "tiff": "image",
}
SUPPORTED = list(HANDLERS)
FILE_INPUT_ACCEPT = ",".join(f".{x}" for x in SUPPORTED)
READ_AS_TEXT = ["txt", "md", "markdown", "mdx", "html", "htm", "csv", "rtf"]


def _named(files: DataFrame) -> DataFrame:
    name = T.base_name(F.col("path"))
    text = F.when(T.file_extension(name).isin(READ_AS_TEXT), T.to_text(F.col("content")))
    return files.select(name.alias("filename"), text.alias("text"), "content")


def read_files(spark: SparkSession, path: str) -> DataFrame:
    """filename, text and content (binary) of files: text is null for binary formats."""
    return _named(spark.read.format("binaryFile").load(path))


BINARY_FILE = "path string, modificationTime timestamp, length long, content binary"


def convert_new(spark: SparkSession, path: str, output: str, log: str, files_a_batch: int = 10_000, **options) -> int:
    """Convert the files of a folder that no earlier run with this log has seen, and append them to the Parquet table output;
    returns their number. options are those of convert().

    A stream that ends once all files present are through (available now): log is its checkpoint, where Spark keeps the names
    of files seen, and output has each batch once, also where a run broke off and the next one does that batch again. A file
    that is written anew under its name is not read again. A store of descriptions is for whole tables, not for streams.
    """
    if options.get("store") is not None:
        raise ValueError("descriptions can't be kept in a store by a stream")
    files = spark.readStream.format("binaryFile").schema(BINARY_FILE).option("maxFilesPerTrigger", files_a_batch).option("recursiveFileLookup", "true").load(path)
    before = _rows(spark, output)
    run = convert(_named(files), **options).writeStream.format("parquet").option("checkpointLocation", log).trigger(availableNow=True).start(output)
    run.awaitTermination()
    return _rows(spark, output) - before


def _rows(spark: SparkSession, path: str) -> int:
    try:
        return spark.read.schema("filename string").parquet(path).count()
    except AnalysisException as e:
        if e.getCondition() != "PATH_NOT_FOUND":
            raise
        return 0


def handler(filename: Column) -> Column:
    """Handler of a file by its extension; null if there is none."""
    kinds = F.create_map(*(F.lit(x) for kv in HANDLERS.items() for x in kv))
    return F.element_at(kinds, T.file_extension(filename))


OPTIONS = "image struct<includeLayoutTable:boolean,language:string,describer:string>"


def adapted(files: DataFrame) -> DataFrame:
    """files with layout, language and describer out of column options, so that each file has its own: a struct whose field
    image may have includeLayoutTable, language and describer, or the same as JSON. What a file's options do not say (none at
    all, no image in them, a missing or null field, text that is no such JSON) is true, eng and null."""
    options = F.col("options")
    kind = files.schema["options"].dataType
    if not isinstance(kind, StructType):
        options, kind = F.from_json(options, OPTIONS), StructType.fromDDL(OPTIONS)
    image = kind["image"].dataType if "image" in kind.names else None
    given = lambda name, other, cast: F.coalesce((options["image"][name] if image is not None and name in image.names else F.lit(None)).cast(cast), F.lit(other).cast(cast))
    return files.withColumns({"layout": given("includeLayoutTable", True, "boolean"), "language": given("language", "eng", "string"), "describer": given("describer", None, "string")})


def convert(files: DataFrame, passthrough: bool = False, recogniser: Hook | None = None, describers: Hook | Mapping[str, Hook] | None = None, store: str | None = None) -> DataFrame:
    """filename, markdown, title, warnings (array) of text, csv and rtf files (text: their content), of pdf files (pages: the
    texts of their pages) and of images (ocr_text, words: what OCR found; description, description_failed), as far as files
    has those columns. No shuffle, no Python but a caller's hooks.

    recogniser and describers (see hooks.recognise and hooks.describe; store, too) fill the columns of images from their bytes
    (content). Column options holds each file's own options (see adapted). Files of unknown extension give empty Markdown
    (passthrough: their text with line feeds) and a warning; so do files whose reader is not part of the library (html, docx,
    xlsx, epub) or whose columns are missing.
    """
    files = files if "text" in files.columns else files.withColumn("text", F.lit(None).cast("string"))
    files = adapted(files) if "options" in files.columns else files
    files = files if recogniser is None else recognise(files, recogniser)
    files = files if describers is None else describe(files, describers, store=store)
    name, ext = F.col("filename"), T.file_extension(F.col("filename"))
    kind = handler(name)
    table = T.let(T.csv_rows(F.col("text")), lambda rows: F.struct(T.table_markdown(rows).alias("markdown"), F.size(rows).alias("rows")))
    files = files.withColumn("_csv", F.when(kind == "csv", table))
    rtf = T.rtf_text(F.col("text"))
    unknown = F.concat(F.lit("Unsupported file format: ."), F.when(ext == "", "unknown").otherwise(ext))
    markdown = F.when(kind == "text", T.line_endings(F.col("text"))).when(kind == "csv", F.col("_csv.markdown")).when(kind == "rtf", rtf)
    said = F.when(F.lit(False), F.expr("cast(array() as array<string>)"))
    read = ["text", "csv", "rtf"]
    if "pages" in files.columns:
        read.append("pdf")
        pages = F.coalesce("pages", F.array())
        markdown = markdown.when(kind == "pdf", T.pdf_markdown(pages))
        said = said.when(kind == "pdf", T.pdf_warnings(pages))
    if "ocr_text" in files.columns:
        read.append("image")
        boxes = T.word_boxes(F.col("words"))
        column = lambda c, other: F.col(c) if c in files.columns else F.lit(other)
        layout = column("layout", True)
        markdown = markdown.when(kind == "image", T.image_markdown(F.col("ocr_text"), boxes, column("description", None).cast("string"), layout))
        failed = F.concat(F.lit("Text recognition failed: "), column("ocr_error", None).cast("string"))
        of_image = F.concat(T.image_warnings(F.col("ocr_text"), boxes, column("description_failed", False), layout), F.array_compact(F.array(failed)))
        said = said.when(kind == "image", of_image)
    unread = F.concat(F.lit("No reader for files of this format: ."), ext)
    markdown = F.coalesce(markdown, F.when(kind.isNull(), T.line_endings(F.col("text")) if passthrough else F.lit("")), F.lit(""))
    warnings = (
        F.when(kind.isNull(), F.array(unknown)).when((kind == "csv") & (F.col("_csv.rows") == 0), F.array(F.lit("The CSV appears to be empty.")))
        .when((kind == "csv") & (F.col("_csv.rows") == 1), F.array(F.lit("Only one row was found; created a single-row markdown table."))).when((kind == "rtf") & (rtf == ""), F.array(F.lit("No readable text was extracted from this RTF file.")))
        .when(~kind.isin(read), F.array(unread)).otherwise(F.coalesce(said, F.expr("cast(array() as array<string>)")))
    )
    return files.select(name.alias("filename"), markdown.alias("markdown"), T.file_stem(name).alias("title"), warnings.alias("warnings"))


def imported(files: DataFrame) -> DataFrame:
    """filename, text, content of files brought in by hand (path, text, base64): text formats keep their text with line feeds,
    others become bytes; base64 that is none gives null."""
    name = F.col("path")
    as_text = T.app_extension(name).isin(READ_AS_TEXT) | ~T.app_extension(name).isin(SUPPORTED)
    text = F.when(as_text, T.line_endings(F.coalesce("text", F.lit(""))))
    return files.select(T.base_name(name).alias("filename"), text.alias("text"), F.when(~as_text, F.try_to_binary(F.coalesce("base64", F.lit("")), F.lit("base64"))).alias("content"))


def keeps_path(path: Column) -> Column:
    """Whether a file is Markdown already, so that saving may go to where it came from."""
    return T.app_extension(path).isin("md", "markdown", "mdx")


def model_choices(models: DataFrame, limit: int = 15) -> DataFrame:
    """The cheapest general models with a price: models has id, name, prompt and completion (prices of a token, as text),
    context_length, modalities (array). The limit is the feature; equal prices stand by id."""
    price = lambda c: T.cost_per_million(F.try_to_number(F.coalesce(c, F.lit("0")), F.lit("999999.999999999999")).cast("double"))
    vision = F.array_contains(F.coalesce("modalities", F.expr("cast(array() as array<string>)")), "image") | F.col("id").rlike("(?i)vision|vl|image")
    out = models.select(
        "id", F.coalesce("name", "id").alias("title"), price(F.col("prompt")).alias("input_cost"), price(F.col("completion")).alias("output_cost"),
        F.coalesce("context_length", F.lit(0)).alias("context_length"), vision.alias("vision"),
    )
    return out.where((F.col("input_cost") > 0) & ~F.col("id").rlike("(?i)embed|audio|tts|moderation|rerank|search")).orderBy("input_cost", "id").limit(limit)
