"""Spelling variants: words that differ by one inserted, deleted or replaced code point, grouped under the frequent one.

One edit leaves the part before it and the part after it intact. So the dictionary is sorted forward, where words that share
their first half stand in one block, and reversed, where those that share their last half do; a pair stands together in the
one or the other. A block is a window of places that the edit may be at: what lies before and behind it is the block's key.
Blocks of more than CROWD words are subdivided: the window is halved, and a word goes to the block of either half, with more
of its start or of its end in the key. At windows of one place a block holds the words that agree in all other places, which
are near to each other by that: they are counted and their most frequent two found by sums, without pairs. Pairs of the
smaller blocks are verified. Replacements and insertions have dictionaries of their own, by the length of the shorter word.
A pair's first difference lies in one window only, so no pair is found twice.

Defined results: a null text has no words; words are told apart by their exact letters; a word without near words stands
alone (form null, root itself); ties of n go to the word that is first in code-point order; an empty table gives an empty
result; rows of one doc_id and equal texts count each for itself; columns other than doc_id and text are ignored.
"""

from __future__ import annotations

import re
import zlib
from collections import Counter
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import materialise, texts

SHORTEST, OFTEN, DOMINANT = 7, 2, 10
#: Words that a block may hold before it is subdivided; their pairs are compared.
CROWD = 16
#: Distinct words that a task holds before it passes their counts on.
HELD = 500_000
#: Every so manieth word (by crc32 of doc_id and word) is mistyped by typed_words.
TYPO = 31


def typed_words(docs: DataFrame, shortest: int = SHORTEST) -> DataFrame:
    """word, n (partial counts) of the runs of letters in all texts, A-Z in lower case, with one code point left out of every
    31st, by crc32(doc_id:word). A null doc_id is written as nothing."""
    run = re.compile(f"[a-zÀ-ÿ]{{{shortest},}}")

    def of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: Counter[str] = Counter()
        out = lambda: pa.RecordBatch.from_pydict({"word": pa.array(held.keys(), pa.string()), "n": pa.array(held.values(), pa.int64())})
        for batch in batches:
            for doc_id, text in zip(batch["doc_id"], batch["text"]):
                # As bytes: lower() leaves all but A-Z as they are.
                for word, n in Counter(run.findall(text.as_py().encode().lower().decode())).items():
                    h = zlib.crc32(f"{doc_id.as_py()}:{word}".encode())
                    if h % TYPO == 0:
                        at = h % len(word)
                        word = word[:at] + word[at + 1 :]
                    if len(word) >= shortest:
                        held[word] += n
                if len(held) >= HELD:
                    yield out()
                    held.clear()
        yield out()

    d = texts(docs).select(F.coalesce(F.col("doc_id").cast("string"), F.lit("")).alias("doc_id"), "text")
    return d.mapInArrow(of, "word string, n long")


def vocabulary(words: DataFrame, often: int = OFTEN) -> DataFrame:
    """word, n of the words that occur often enough. words: word, n (counts that are added up)."""
    return words.where("word is not null").groupBy("word").agg(F.sum("n").alias("n")).where(F.col("n") >= often)


def _entries(words: DataFrame) -> DataFrame:
    """A row for each word and dictionary: kind (0 replaced, 1 inserted), c (length of the shorter word), a and b (the window of
    places the edit may be at: all of them), word, n."""
    size = F.length("word")
    entry = lambda kind, c, b: F.struct(F.lit(kind).alias("kind"), c.alias("c"), b.alias("b"))
    # A word is the shorter one of some pairs and the longer one of others.
    kinds = F.array(entry(0, size, size), entry(1, size, size + 1), entry(1, size - 1, size))
    return words.select("word", "n", F.explode(kinds).alias("x")).select("x.kind", "x.c", F.lit(0).alias("a"), "x.b", "word", "n")


def _halved(entries: DataFrame) -> DataFrame:
    """Each entry in the windows of the first and of the last half of its places."""
    mid = F.floor((F.col("a") + F.col("b")) / 2).cast("int")
    window = lambda a, b: F.struct(a.alias("a"), b.alias("b"))
    halves = entries.withColumn("x", F.explode(F.array(window(F.col("a"), mid), window(mid, F.col("b")))))
    return halves.select("kind", "c", "x.a", "x.b", "word", "n")


def _block(kind: str = "kind") -> list[Column]:
    """A block's key: dictionary and window, what stands before the window, and what stands behind it in the shorter word."""
    behind = F.col("c") - F.col("b") + F.col(kind)
    return [F.col("kind"), F.col("c"), F.col("a"), F.col("b"), F.left("word", F.col("a")).alias("head"), F.when(behind > 0, F.right("word", behind)).otherwise("").alias("tail")]


BLOCK = ["kind", "c", "a", "b", "head", "tail"]


def _pairs(blocks: DataFrame) -> DataFrame:
    """v, word, n (of v) of the pairs that the small blocks hold, both ways. Blocks: BLOCK, word, n."""
    one, other = blocks.withColumnsRenamed({"word": "v", "n": "m"}), blocks
    first = F.left("v", F.col("b")) != F.left("word", F.col("b"))  # they differ before the window ends
    sizes = F.when(F.col("kind") == 0, F.col("v") < F.col("word")).otherwise(F.length("v") < F.length("word"))
    near = one.join(other, BLOCK).where(sizes & first & (F.levenshtein("v", "word", 1) == 1))
    ways = F.array(F.struct(F.col("word").alias("word"), F.col("v").alias("near"), F.col("m").alias("n")), F.struct(F.col("v").alias("word"), F.col("word").alias("near"), F.col("n").alias("n")))
    return near.select(F.explode(ways).alias("x")).select("x.*")


def _best(n: str = "n", near: str = "near") -> Column:
    """Sorts by n, then code-point order."""
    return F.struct((-F.col(n)).alias("less"), F.col(near).alias("near"))


def _found(pairs: DataFrame) -> DataFrame:
    """word, n_near and best of pairs (word, near, n): one row of each word leaves a task."""
    return pairs.groupBy("word").agg(F.count("*").alias("n_near"), F.min(_best()).alias("best"))


def _wild(blocks: DataFrame) -> DataFrame:
    """word, n_near, best out of blocks whose window is one place, however many words they hold.

    Replaced: all words of a block are near to each other. Inserted: the shorter word, one at most, is near to each longer one;
    of longer words that begin alike at the window, the first difference may lie behind it, where the pair is counted instead.
    """
    best = F.struct((-F.col("n")).alias("less"), F.col("word").alias("near"))
    replaced = blocks.where("kind = 0")
    top = replaced.groupBy(*BLOCK).agg(F.count("*").alias("size"), F.min(best).alias("first"))
    second = replaced.join(top, BLOCK).where(F.col("word") != F.col("first.near")).groupBy(*BLOCK).agg(F.min(best).alias("second"))
    alike = replaced.join(top.join(second, BLOCK), BLOCK)
    alike = alike.select("word", (F.col("size") - 1).alias("n_near"), F.when(F.col("word") == F.col("first.near"), F.col("second")).otherwise(F.col("first")).alias("best"))
    inserted = blocks.where("kind = 1")
    shorter = inserted.where(F.length("word") == F.col("c")).select(*BLOCK, F.col("word").alias("v"), F.col("n").alias("m"))
    longer = inserted.where(F.length("word") > F.col("c")).join(shorter, BLOCK).where(F.left("v", F.col("b")) != F.left("word", F.col("b")))
    of_longer = longer.select("word", F.lit(1).cast("long").alias("n_near"), F.struct((-F.col("m")).alias("less"), F.col("v").alias("near")).alias("best"))
    of_shorter = longer.groupBy(F.col("v").alias("word")).agg(F.count("*").alias("n_near"), F.min(best).alias("best"))
    return alike.union(of_longer).union(of_shorter)


def near_words(words: DataFrame, crowd: int = CROWD) -> DataFrame:
    """word, n_near, best (struct of less, the negated n, and near, the word) of the words (word, n) that have near ones."""
    found = None
    entries = _halved(_entries(words))
    while True:
        blocks = materialise(entries.select(*_block(), "word", "n"), "spelling-blocks")
        sizes = blocks.groupBy(*BLOCK).agg(F.count("*").alias("size"))
        several = materialise(blocks.join(sizes.where("size > 1"), BLOCK), "spelling-shared")
        one_place = F.col("b") - F.col("a") <= 1
        large = (F.col("size") > crowd) & ~one_place
        here = _found(_pairs(several.where(~large & ~one_place).drop("size"))).union(_wild(several.where(one_place).drop("size")))
        here = materialise(here.groupBy("word").agg(F.sum("n_near").alias("n_near"), F.min("best").alias("best")), "spelling-near")
        found = here if found is None else found.union(here)
        left = several.where(large).select("kind", "c", "a", "b", "word", "n")
        if left.isEmpty():
            return found.groupBy("word").agg(F.sum("n_near").alias("n_near"), F.min("best").alias("best"))
        entries = _halved(left)


def roots(forms: DataFrame) -> DataFrame:
    """word, root of forms (word, form): forms are followed to the last, twice as far in each round."""
    ends = materialise(forms.select("word", F.col("form").alias("root")), "spelling-roots")
    while True:
        onward = ends.select(F.col("word").alias("root"), F.col("root").alias("next"))
        further = materialise(ends.join(onward, "root", "left").select("word", F.coalesce("next", "root").alias("root"), F.col("next").isNotNull().alias("moved")), "spelling-roots")
        ends = further.select("word", "root")
        if further.where("moved").isEmpty():
            return ends


def spelling_variants(words: DataFrame, often: int = OFTEN, dominant: int = DOMINANT, crowd: int = CROWD) -> DataFrame:
    """word, form, root, n, n_near, form_n of every word (of words: word, n) that occurs often enough: form is the near word of
    largest n, if that is dominant times the word's own."""
    known = materialise(vocabulary(words, often), "spelling-words")
    near = near_words(known, crowd)
    rows = known.join(near, "word", "left").withColumn("most", -F.col("best.less"))
    is_form = F.col("most") >= F.col("n") * dominant
    rows = rows.select("word", F.when(is_form, F.col("best.near")).alias("form"), "n", F.coalesce("n_near", F.lit(0)).cast("long").alias("n_near"), F.when(is_form, F.col("most")).alias("form_n"))
    rows = materialise(rows, "spelling-forms")
    ends = roots(rows.where("form is not null"))
    return rows.join(ends, "word", "left").select("word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n")
