"""Hooks of a caller, options of each file, and the catalogue of providers."""

import glob
import os
import uuid

import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from quillspark.operators import hooks
from quillspark.operators.hooks import recognise
from quillspark.operators.lookup import lookup
from quillspark.sources import files as S
from quillspark.sources import providers as P

FIRST = "OCR runs locally and may take longer on large images. First run can download language data."
FAILED = "AI image description failed, so only OCR output was included."


def _engine(folder):
    """An engine that reads an image's bytes as its text; it leaves a file where it is made, and one where it is closed."""

    class Engine:
        def __init__(self):
            self.name = uuid.uuid4().hex
            open(f"{folder}/made-{self.name}", "w").close()

        def __call__(self, content, language):
            text = content.decode()
            if text == "broken":
                raise ValueError("not an image")
            words = [{"text": w, "confidence": 90.0, "bbox": {"x0": 10.0 * i, "y0": 0.0, "x1": 10.0 * i + 5, "y1": 7.4}} for i, w in enumerate(text.split())]
            return {"text": f" {text} {language}\n", "words": words}

        def close(self):
            open(f"{folder}/closed-{self.name}", "w").close()

    return Engine


def _describer(folder):
    def made():
        def say(image):
            open(f"{folder}/asked-{uuid.uuid4().hex}", "w").close()
            if "fail" in image.text:
                raise RuntimeError("no answer")
            return None if "quiet" in image.text else f" {image.filename} {image.mime_type} {len(image.content)} {[w['text'] for w in image.words]} "

        return say

    return made


@pytest.fixture
def files(spark):
    rows = [("d/a.png", b"one two", None), ("b.JPG", b"fail", None), ("c.tiff", b"quiet", None), ("d.png", b"broken", None), ("e.txt", None, "plain\r\ntext"), ("f.png", None, None), ("g.webp", b"", None)]
    return spark.createDataFrame(rows, "filename string, content binary, text string")


def _converted(df):
    return {r["filename"]: (r["markdown"], r["warnings"]) for r in df.collect()}


def test_hooks(files, tmp_path):
    got = _converted(S.convert(files.repartition(2), recogniser=_engine(tmp_path), describers=_describer(tmp_path)))
    table = "## Text Positioning\n\n| Text | Confidence | Left | Top | Width | Height |\n| --- | ---: | ---: | ---: | ---: | ---: |\n"
    one = "## Image Description\n\nd/a.png image/png 7 ['one', 'two']\n\n## OCR Text\n\none two eng\n\n" + table + "| one | 90.0 | 0 | 0 | 5 | 7 |\n| two | 90.0 | 10 | 0 | 5 | 7 |"
    assert got["d/a.png"] == (one, [FIRST])
    assert got["b.JPG"] == ("## OCR Text\n\nfail eng\n\n" + table + "| fail | 90.0 | 0 | 0 | 5 | 7 |", [FIRST, FAILED])
    assert got["c.tiff"][1] == [FIRST] and "Description" not in got["c.tiff"][0]
    assert got["d.png"] == ("## Image Description\n\nd.png image/png 6 []", [FIRST, "No readable text was detected in this image.", "Text recognition failed: ValueError: not an image"])
    assert got["e.txt"] == ("plain\ntext", []) and got["f.png"][1][:1] == [FIRST]
    assert got["g.webp"][0].startswith("## Image Description\n\ng.webp image/webp 0 []\n\n## OCR Text\n\neng")


def test_one_engine_a_task(spark, tmp_path):
    """Made once where a task has images, however many batches it has, never where it has none, and always closed."""
    images = spark.range(0, 400, 1, 3).select(F.lit("x.png").alias("filename"), F.lit("a b").cast("binary").alias("content"))
    texts = spark.range(0, 100, 1, 2).select(F.lit("x.txt").alias("filename"), F.lit("a b").cast("binary").alias("content"))
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "10")
    try:
        assert recognise(images.union(texts), _engine(tmp_path)).where("ocr_text is not null").count() == 400
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    made, closed = (glob.glob(f"{tmp_path}/{x}-*") for x in ("made", "closed"))
    assert len(made) == len(closed) == 3


def test_engine_is_closed_where_a_task_fails(files, tmp_path):
    with pytest.raises(Exception, match="not an image"):
        recognise(files, _engine(tmp_path), strict=True).collect()
    assert len(glob.glob(f"{tmp_path}/made-*")) == len(glob.glob(f"{tmp_path}/closed-*")) > 0


def test_descriptions_are_asked_for_once(files, tmp_path):
    """A second run takes from the store what the first one got, and asks again for what failed; copies are asked for once."""
    for k in ("asked", "made"):
        os.mkdir(f"{tmp_path}/{k}")
    twice = files.union(files.where("filename = 'd/a.png'"))
    run = lambda: _converted(S.convert(twice, recogniser=_engine(tmp_path / "made"), describers=_describer(tmp_path / "asked"), store=f"{tmp_path}/store"))
    first, asked = run(), len(glob.glob(f"{tmp_path}/asked/*"))
    second, again = run(), len(glob.glob(f"{tmp_path}/asked/*"))
    assert first == second and asked == 5 and again == 6  # five images with bytes; one of them fails each time


def test_each_file_has_its_own_options(spark, tmp_path):
    rows = [("a.png", '{"image": {"includeLayoutTable": false, "describer": "plain"}}'), ("b.png", '{"image": {"language": "deu"}}'), ("c.png", "{}"), ("d.png", None), ("e.png", '{"image": {"describer": "unknown"}}'), ("f.png", "no json")]
    files = spark.createDataFrame(rows, "filename string, options string").withColumn("content", F.lit("hi").cast("binary"))
    got = _converted(S.convert(files, recogniser=_engine(tmp_path), describers={"plain": _describer(tmp_path)}))
    assert "Positioning" not in got["a.png"][0] and got["a.png"][0].startswith("## Image Description\n\na.png")
    assert all("Positioning" in got[x][0] and "Description" not in got[x][0] for x in ("b.png", "c.png", "d.png", "e.png", "f.png"))
    assert got["b.png"][0].startswith("## OCR Text\n\nhi deu") and got["c.png"][0].startswith("## OCR Text\n\nhi eng")
    parsed = files.select("filename", "content", F.from_json("options", "image struct<includeLayoutTable:boolean>").alias("options"))
    assert {r["filename"]: (r["layout"], r["language"], r["describer"]) for r in S.adapted(parsed).collect()}["a.png"] == (False, "eng", None)


def test_providers(spark):
    catalogue = P.providers(spark, "app")
    asked = spark.createDataFrame([(1, "openai"), (2, "OpenAI"), (3, None), (4, "none such"), (5, "ollama"), (6, "disabled")], "k int, id string")
    got = {r["k"]: (r["provider"], r["env_var"]) for r in P.with_provider(asked, F.col("id"), catalogue).collect()}
    assert got == {1: ("openai", "APP_OPENAI_API_KEY"), 2: ("disabled", None), 3: ("disabled", None), 4: ("disabled", None), 5: ("ollama", None), 6: ("disabled", None)}
    folded = {r["k"]: r["provider"] for r in P.with_provider(asked, F.col("id"), catalogue, fold_case=True).collect()}
    assert folded[2] == "openai" and folded[4] == "disabled"
    assert [r["provider"] for r in P.choices(catalogue).collect()] == ["openrouter", "openai", "anthropic", "xai", "ollama", "local-endpoint"]


def test_lookup_broadcasts_what_is_small(spark):
    df, dimension = spark.range(100).withColumn("k", F.col("id") % 7), spark.range(5).select(F.col("id").alias("on"), (F.col("id") * 2).alias("v"))
    plan = lambda most: lookup(df, F.col("k"), dimension, "on", most=most)._jdf.queryExecution().optimizedPlan().toString()
    assert "broadcast" in plan(5) and "broadcast" not in plan(4)
    assert lookup(df, F.col("k"), dimension, "on", default=0).where("k > 4 and v <> 0").count() == 0
    with pytest.raises(ValueError, match="never is"):
        lookup(df, F.col("k"), dimension, "on", default=9)


def test_hooks_hold_a_part_of_a_batch(spark):
    """Rows of a batch become objects slice by slice, and all of them, in order."""
    rows = pa.array([bytes(400_000)] * 20)
    parts = list(hooks._parts(rows, pa.array(range(20))))
    assert all(r.nbytes <= hooks.PART and len(r) == len(m) for r, m in parts) and [x for _, m in parts for x in m.to_pylist()] == list(range(20))
    assert [len(r) for r, _ in hooks._parts(pa.array([bytes(3_000_000)] * 2), pa.array(["a", "b"]))] == [1, 1] and not list(hooks._parts(pa.array([], pa.binary()), pa.array([])))
    made = spark.range(3000, numPartitions=1).select(F.concat("id", F.lit(".png")).alias("filename"), F.rpad(F.col("id").cast("string"), 2000, "x").cast("binary").alias("content"))
    got = recognise(made, lambda: lambda content, language: {"text": content.decode().rstrip("x")}).select("filename", "ocr_text").collect()
    assert [(r["filename"], r["ocr_text"]) for r in got] == [(f"{i}.png", str(i)) for i in range(3000)]
