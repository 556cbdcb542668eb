"""Line dedup, in DataFrame functions only: lines that many documents hold stay in one of them.

A line's key is the line without white space at its ends, A-Z in lower case. Keys are hashed to 128 bits; hashes are counted
over documents, and those over the threshold are joined with the places they stand at, so texts are shuffled once, to meet
the places of their dropped lines. Partial sums come before each shuffle, and a line that stands everywhere is one row of the
small side of a join whose large side Spark can split.

Defined results: a null or empty text is one empty line; rows of one doc_id are one document, so a line that only they hold
stays in all of them; rows without a doc_id are one document, too, which comes after all others; repeated rows get equal
results; a line that stands twice in a document stays or goes at both places; an empty table gives an empty result; columns
other than doc_id and text are ignored. Texts are read whole; \\r belongs to the line it stands in.
"""

from __future__ import annotations

import string

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import materialise, renamed, texts, whole_text

BLANKS = " \t\n\x0b\f\r"


def lines_of(text: Column) -> Column:
    return F.split(text, "\n", -1)


def line_key(line: Column) -> Column:
    """The line without white space at its ends, A-Z in lower case and other letters as they are."""
    bare = F.btrim(line, F.lit(BLANKS))
    # All ASCII: lower() does the same, some ten times as fast.
    return F.when(F.octet_length(bare) == F.length(bare), F.lower(bare)).otherwise(F.translate(bare, string.ascii_uppercase, string.ascii_lowercase))


def line_hashes(docs: DataFrame, shortest: int) -> DataFrame:
    """doc_id, text_key, pos (from 0), h1 and h2 (two hashes of the key) of every line whose key has shortest code points."""
    keys = F.transform(lines_of(F.col("text")), line_key)
    hashed = F.transform(keys, lambda k, i: F.when(F.length(k) >= shortest, F.struct(i.alias("pos"), F.xxhash64(k).alias("h1"), F.xxhash64(F.lit(1), k).alias("h2"))))
    rows = texts(docs, key=True).select("doc_id", "text_key", F.explode(F.filter(hashed, lambda x: x.isNotNull())).alias("x"))
    return rows.select("doc_id", "text_key", "x.pos", "x.h1", "x.h2")


def repeated_lines(lines: DataFrame, at_least: int) -> DataFrame:
    """h1, h2, first (the smallest doc_id) of the hashes that stand in at_least documents."""
    if at_least < 2:
        raise ValueError("a repeated line stands in two documents or more")
    unnamed = F.coalesce(F.max(F.when(F.col("doc_id").isNull(), 1)), F.lit(0))
    first = F.min("doc_id").alias("first")
    if at_least == 2:  # two documents differ: no need to count them, and one row a hash leaves each task
        found = lines.groupBy("h1", "h2").agg(first, ((F.min("doc_id") < F.max("doc_id")) | (unnamed > 0)).alias("many"))
    else:
        found = lines.groupBy("h1", "h2").agg(first, (F.count_distinct("doc_id") + unnamed >= at_least).alias("many"))
    return found.where("many and first is not null").select("h1", "h2", "first")


def dropped_places(docs: DataFrame, at_least: int = 2, shortest: int = 10) -> DataFrame:
    """doc_id, text_key, dropped (sorted places, from 0, of the lines to drop) of the documents that have any."""
    lines = materialise(line_hashes(docs, shortest), "line-hashes")
    again = materialise(repeated_lines(lines, at_least), "lines-repeated")
    later = lines.join(again, ["h1", "h2"]).where(F.col("doc_id").isNull() | (F.col("doc_id") > F.col("first")))
    return later.groupBy("doc_id", "text_key").agg(F.sort_array(F.collect_set("pos")).alias("dropped"))


def _kept(lines: Column, dropped: Column) -> Column:
    """The lines between dropped places, stretch by stretch: linear in both."""
    before = lambda i: F.coalesce(F.get(dropped, i - 1), F.lit(-1))
    stretch = lambda i: F.slice(lines, before(i) + 2, F.coalesce(F.get(dropped, i), F.size(lines)) - before(i) - 1)
    return F.flatten(F.transform(F.sequence(F.lit(0), F.size(dropped)), stretch))


def _marked(docs: DataFrame, at_least: int, shortest: int) -> tuple[DataFrame, dict[str, str]]:
    """docs as renamed() gives them, _lines of the text and dropped (places; null: none) of each row."""
    gone = dropped_places(docs, at_least, shortest).withColumnsRenamed({"doc_id": "_id", "text_key": "_key"})
    d, names = renamed(docs)
    d = d.withColumn("_hash", F.xxhash64(whole_text(F.col(names["text"]))))
    d = d.join(gone, d[names["doc_id"]].eqNullSafe(gone["_id"]) & (d["_hash"] == gone["_key"]), "left")
    # A column of its own: inside _kept's lambda, a text would be split again for each stretch.
    return d.withColumn("_lines", lines_of(whole_text(F.col(names["text"])))), names


def _left(text: Column) -> Column:
    return F.when(F.col("dropped").isNull(), text).otherwise(F.array_join(_kept(F.col("_lines"), F.col("dropped")), "\n"))


def dedup_lines(docs: DataFrame, at_least: int = 2, shortest: int = 10) -> DataFrame:
    """doc_id, kept (the text that is left), n_lines (before), n_dropped of every row."""
    d, names = _marked(docs, at_least, shortest)
    text = whole_text(F.col(names["text"]))
    dropped = F.when(F.col("dropped").isNull(), 0).otherwise(F.size("dropped"))
    return d.select(F.col(names["doc_id"]).alias("doc_id"), _left(text).alias("kept"), F.size("_lines").cast("long").alias("n_lines"), dropped.cast("long").alias("n_dropped"))


def line_dedup(docs: DataFrame) -> DataFrame:
    return dedup_lines(docs).select("doc_id", "n_lines", "n_dropped", F.sha2("kept", 256).alias("kept_sha256"))


def drop_repeated_lines(docs: DataFrame, at_least: int = 2, shortest: int = 10) -> DataFrame:
    """docs, all columns, each text without its dropped lines (null texts stay null)."""
    d, names = _marked(docs, at_least, shortest)
    return d.withColumn(names["text"], _left(F.col(names["text"]))).select(*names.values()).toDF(*docs.columns)
