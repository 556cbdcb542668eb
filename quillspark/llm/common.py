"""What the operators share: input shaping, scratch tables in the shared folder, match positions."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Runs of the separators between words, and a run of anything else.
SPACES = r"[\x20\x09-\x0D]+"
WORD = r"[^\x20\x09-\x0D]+"


def shared_dir(spark: SparkSession) -> str:
    """The folder that all executors share (spark.checkpoint.dir). Without that setting, a local session gets a temporary
    folder of its own; on a cluster it is an error, as no machine's own folder would do."""
    path = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not path:
        if not spark.sparkContext.master.startswith("local["):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        path = tempfile.mkdtemp(prefix="quillspark-")
        spark.conf.set("spark.checkpoint.dir", path)
    return path


def scratch_path(spark: SparkSession, label: str) -> str:
    return f"{shared_dir(spark)}/{label}-{uuid.uuid4().hex}"


@contextmanager
def _with(spark: SparkSession, **settings: str) -> Iterator[None]:
    before = {k: spark.conf.get(k, None) for k in settings}
    for k, v in settings.items():
        spark.conf.set(k, v)
    try:
        yield
    finally:
        for k, v in before.items():
            spark.conf.unset(k) if v is None else spark.conf.set(k, v)


@contextmanager
def shuffle_files_go(spark: SparkSession) -> Iterator[None]:
    """Shuffle files of the queries inside go once they are over (by a switch of Spark's), as nothing reads them again. Queries
    that other threads run meanwhile may lose theirs as early; they would be made anew, so results don't change."""
    with _with(spark, **{"spark.sql.classic.shuffleDependency.fileCleanup.enabled": "true"}):
        yield


#: Bytes that a Python worker gets at once. As text, arrays and results they take some ten times that, and a worker keeps what
#: its largest batch took.
BATCH = "8m"


def write_table(df: DataFrame, path: str, *partition_by: str) -> None:
    with shuffle_files_go(df.sparkSession), _with(df.sparkSession, **{"spark.sql.execution.arrow.maxBytesPerBatch": BATCH}):
        df.write.partitionBy(*partition_by).parquet(path)


def materialise(df: DataFrame, label: str, *partition_by: str) -> DataFrame:
    """Write df as Parquet in the shared folder and read it back: later stages survive lost executors and have its true size."""
    path = scratch_path(df.sparkSession, label)
    write_table(df, path, *partition_by)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def texts(docs: DataFrame, key: bool = False, carry: list[str] | None = None) -> DataFrame:
    """doc_id and text (null: empty) alone, and the columns to carry, whatever other columns docs has.

    key adds text_key, a 64-bit hash of the text: (doc_id, text_key) tells repeated doc_ids with
    different texts apart, and rows that are equal in both get equal results.
    """
    text = whole_text(F.col("text"))
    out = [F.col("doc_id"), text.alias("text"), *(carry or [])]
    if key:
        out.append(F.xxhash64(text).alias("text_key"))
    return docs.select(*out)


def whole_text(text: Column) -> Column:
    return F.coalesce(text.cast("string"), F.lit(""))


def renamed(docs: DataFrame) -> tuple[DataFrame, dict[str, str]]:
    """docs under other column names, and the new name of each column: columns that a step adds can't clash with them.
    Back again: .select(*names.values()).toDF(*docs.columns)."""
    names = {c: f"in_{i}" for i, c in enumerate(docs.columns)}
    return docs.toDF(*names.values()), names


def words_of(text: Column) -> Column:
    return F.array_remove(F.split(text, SPACES), "")


def count_chars(text: Column, chars: str) -> Column:
    return (F.length(text) - F.length(F.translate(text, chars, ""))).cast("long")


def match_starts(gaps: Column, matches: Column, block: int = 256) -> Column:
    """0-based code-point starts of matches, given the pieces between them (both of one split of a text).

    Running sums are taken in blocks, so the work stays near linear in the number of matches.
    """
    n = F.size(matches)
    none = F.expr("cast(array() as array<bigint>)")

    def run(acc, i):
        at = acc["at"] + F.length(F.get(gaps, i))
        return F.struct((at + F.length(F.get(matches, i))).cast("long").alias("at"), F.concat(acc["starts"], F.array(at.cast("long"))).alias("starts"))

    def one_block(b):
        first = (b * block).cast("int")
        last = F.least(first + F.lit(block), n) - 1
        return F.aggregate(F.sequence(first, last), F.struct(F.lit(0).cast("long").alias("at"), none.alias("starts")), run)

    def join(acc, x):
        return F.struct((acc["at"] + x["at"]).cast("long").alias("at"), F.concat(acc["starts"], F.array(F.transform(x["starts"], lambda s: s + acc["at"]))).alias("starts"))

    blocks = F.transform(F.sequence(F.lit(0), F.floor((n - 1) / block).cast("int")), one_block)
    joined = F.aggregate(blocks, F.struct(F.lit(0).cast("long").alias("at"), F.expr("cast(array() as array<array<bigint>>)").alias("starts")), join)
    return F.when(n > 0, F.flatten(joined["starts"])).otherwise(none)
