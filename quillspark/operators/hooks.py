"""A caller's own functions over images: recognition of text and descriptions.

A hook is a function without arguments that makes the object which does the work (a model, a client). Each task makes it when
it meets its first image, keeps it for all its batches and closes it at the end, also where the task fails. Files that are no
images pass without their bytes. What a hook returns depends on its row alone, so a task that is run again gives the same
rows; calls that cost money can be kept in a table (store), from which later runs take them.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator, Mapping
from concurrent.futures import ThreadPoolExecutor
from contextlib import contextmanager
from typing import Any, NamedTuple

import pyarrow as pa
from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import text as T
from .shared import written

Hook = Callable[[], Any]

_BOX = "struct<x0:double,y0:double,x1:double,y1:double>"
_WORDS = f"array<struct<text:string,confidence:double,bbox:{_BOX}>>"
_BOX_TYPE = pa.struct([(c, pa.float64()) for c in ("x0", "y0", "x1", "y1")])
_READ_TYPE = pa.struct([("text", pa.string()), ("words", pa.list_(pa.struct([("text", pa.string()), ("confidence", pa.float64()), ("bbox", _BOX_TYPE)]))), ("error", pa.string())])
_SAID_TYPE = pa.struct([("description", pa.string()), ("error", pa.string())])


class Image(NamedTuple):
    """What a describer gets of an image. words: dicts of text, confidence, left, top, width, height."""

    filename: str
    content: bytes
    mime_type: str
    text: str
    words: list[dict]


@contextmanager
def _made(hooks: Mapping[str, Hook]) -> Iterator[Callable[[str], Any]]:
    """The objects of hooks by name, each made when it is first asked for; those that have close() are closed at the end."""
    made: dict[str, Any] = {}

    def of(name: str) -> Any:
        if name not in made:
            made[name] = hooks[name]()
        return made[name]

    try:
        yield of
    finally:
        for thing in made.values():
            if hasattr(thing, "close"):
                thing.close()


#: Bytes of a batch whose rows are objects of Python at once, about.
PART = 1 << 20


def _parts(rows: pa.Array, more: pa.Array) -> Iterator[tuple[pa.Array, pa.Array]]:
    """A batch of two columns in slices of PART bytes, or of one row."""
    step = max(1, len(rows) * PART // max(1, rows.nbytes))
    for i in range(0, len(rows), step):
        yield rows.slice(i, step), more.slice(i, step)


def _recognised(content: Column, language: Column, hook: Hook, strict: bool) -> Column:
    def read(engine: Any, image: bytes, spoken: str) -> dict:
        try:
            found = engine(image, spoken)
        except Exception as e:
            if strict:
                raise
            return {"text": "", "words": [], "error": f"{type(e).__name__}: {e}"}
        return {"text": found.get("text") or "", "words": found.get("words") or [], "error": None}

    @F.arrow_udf(f"struct<text:string,words:{_WORDS},error:string>")
    def of(batches: Iterator[tuple[pa.Array, pa.Array]]) -> Iterator[pa.Array]:
        with _made({"": hook}) as engine:
            for contents, languages in (part for b in batches for part in _parts(*b)):
                rows = zip(contents, languages)
                yield pa.array([read(engine(""), c.as_py(), s.as_py()) if c.is_valid else None for c, s in rows], _READ_TYPE)

    return of.asNondeterministic()(content, language)


def _described(image: Column, name: Column, hooks: Mapping[str, Hook], parallel: int) -> Column:
    def say(describer: Any, row: dict) -> dict:
        try:
            said = describer(Image(row["filename"], row["content"], row["mime_type"], row["text"], row["words"]))
            return {"description": said, "error": None}
        except Exception as e:  # of any kind: a failed description is a warning, never an error
            return {"description": None, "error": f"{type(e).__name__}: {e}"}

    @F.arrow_udf("struct<description:string,error:string>")
    def of(batches: Iterator[tuple[pa.Array, pa.Array]]) -> Iterator[pa.Array]:
        with _made(hooks) as describer, ThreadPoolExecutor(parallel) as pool:
            for images, names in (part for b in batches for part in _parts(*b)):
                calls = [pool.submit(say, describer(n.as_py()), x.as_py()) if x.is_valid and n.is_valid else None for x, n in zip(images, names)]
                yield pa.array([c and c.result() for c in calls], _SAID_TYPE)

    return of.asNondeterministic()(image, name)


def _is_image(files: DataFrame) -> Column:
    return T.image_type(T.file_extension(F.col("filename"))).startswith("image/") & F.col("content").isNotNull()


def recognise(files: DataFrame, hook: Hook, strict: bool = False) -> DataFrame:
    """files (filename, content, others) with ocr_text, words and ocr_error of images.

    The hook's object is called with an image's bytes and the language (column language, else eng) and gives a dict of text and
    words (dicts of text, confidence, bbox). An exception is the row's ocr_error; strict lets it fail the job instead.
    """
    language = F.coalesce("language", F.lit("eng")) if "language" in files.columns else F.lit("eng")
    found = files.withColumn("_read", _recognised(F.when(_is_image(files), F.col("content")), language, hook, strict))
    return found.withColumns({"ocr_text": F.col("_read.text"), "words": F.col("_read.words"), "ocr_error": F.col("_read.error")}).drop("_read")


def describe(files: DataFrame, hooks: Hook | Mapping[str, Hook], parallel: int = 4, store: str | None = None) -> DataFrame:
    """files (of recognise) with description and description_failed of images.

    The hook's object is called with an Image and gives a text or None; an exception makes description_failed true. Of several
    hooks, by name, column describer says which one is a file's (null or a name that none has: not described). parallel calls
    run at once in a task. store: a folder in which descriptions are kept by file name, bytes and recognised text; what stands
    there is not asked for again, and what failed does not stand there. New ones are appended in one job, whole or not at all.
    """
    named = hooks if isinstance(hooks, Mapping) else {"": hooks}
    if isinstance(hooks, Mapping):
        name = F.col("describer") if "describer" in files.columns else F.lit(None).cast("string")
        name = F.when(name.isin(list(named)), name)
    else:
        name = F.lit("")
    text = F.coalesce(T.trim_all(F.col("ocr_text")), F.lit(""))
    image = F.struct("filename", "content", T.image_type(T.file_extension(F.col("filename"))).alias("mime_type"), text.alias("text"), T.word_boxes(F.col("words")).alias("words"))
    wanted = _is_image(files) & name.isNotNull()
    said = lambda df: df.withColumn("_said", _described(F.when(wanted, image), name, named, parallel))
    if store is None:
        return said(files).withColumns({"description": F.col("_said.description"), "description_failed": F.col("_said.error").isNotNull()}).drop("_said")
    key = F.sha2(F.concat_ws("\x00", name, "filename", F.sha2("content", 256), text), 256)
    keyed = files.withColumn("_key", F.when(wanted, key))
    told = keyed.where("_key is not null").dropDuplicates(["_key"])
    kept = _stored(files, store)
    told = told if kept is None else told.join(kept, "_key", "left_anti")
    now = written(said(told).select("_key", "_said.description", F.col("_said.error").isNotNull().alias("description_failed")), "descriptions")
    now.where("not description_failed").select("_key", "description").write.mode("append").parquet(store)
    known = now if kept is None else now.unionByName(kept.withColumn("description_failed", F.lit(False)))
    return keyed.join(known, "_key", "left").withColumn("description_failed", F.coalesce("description_failed", F.lit(False))).select(*files.columns, "description", "description_failed")


def _stored(files: DataFrame, store: str) -> DataFrame | None:
    try:
        kept = files.sparkSession.read.schema("_key string, description string").parquet(store)
    except AnalysisException as e:
        if e.getCondition() != "PATH_NOT_FOUND":
            raise
        return None
    return written(kept.dropDuplicates(["_key"]), "descriptions")
