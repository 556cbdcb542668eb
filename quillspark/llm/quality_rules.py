"""Quality rules as a short-circuit cascade, in DataFrame functions only.

Defined results: a null text counts as empty (base_failed, not kept); a null doc_id is returned as
null; repeated rows are judged each for itself; an empty table gives an empty result; columns other
than doc_id and text are ignored. Texts of any length are judged whole. The order of the rules never
changes a verdict, only how many rules a document meets.
"""

from __future__ import annotations

import string
import time
from collections.abc import Callable
from dataclasses import dataclass
from statistics import median

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import WORD, count_chars, materialise, renamed, texts, words_of

SYMBOLS = "#*$%&|<>"
#: Costs below this can't be told apart; such rules are ordered by their rejections alone.
LEAST_SECONDS = 2e-3


@dataclass(frozen=True)
class Rule:
    """rejects: a condition over text, words, lines and the base columns."""

    name: str
    rejects: Callable[[], Column]


@dataclass(frozen=True)
class Estimate:
    rule: Rule
    seconds: float
    rejection: float

    @property
    def gain(self) -> float:
        return self.rejection / max(self.seconds, LEAST_SECONDS)


def _letters(chars: str) -> Column:
    return count_chars(F.col("text"), chars)


def default_rules() -> list[Rule]:
    n = F.col("n_words")
    return [
        Rule("symbols_per_word", lambda: F.col("n_symbols") * 10 > n),
        Rule("word_length", lambda: (F.col("word_chars") < 2 * n) | (F.col("word_chars") > 15 * n)),
        Rule("duplicate_lines", lambda: F.col("n_dup_lines") * 2 > F.col("n_lines")),
        Rule("exclamations", lambda: count_chars(F.col("text"), "!") * 4 > n),
        Rule("capitals", lambda: _letters(string.ascii_uppercase) > _letters(string.ascii_lowercase)),
        Rule("bullet_lines", lambda: F.size(F.filter(F.col("lines"), lambda x: x.rlike(r"^[\x20\x09]*[-*•][\x20\x09]"))) * 10 > 9 * F.col("n_lines")),
        Rule("words_with_letters", lambda: F.size(F.filter(F.col("words"), lambda x: x.rlike(r"\p{L}"))) * 10 < 7 * n),
    ]


def base(docs: DataFrame, carry: list[str] | None = None) -> DataFrame:
    """doc_id, text, columns to carry, words, lines and the base columns of every document, without a shuffle."""
    carry = carry or []
    d = texts(docs, carry=carry).withColumn("words", words_of(F.col("text")))
    d = d.withColumn("lines", F.filter(F.split("text", "\n"), lambda x: x.rlike(WORD)))
    d = d.withColumn("_h", F.transform("words", lambda w, i: F.xxhash64(w, F.get("words", i + 1), F.get("words", i + 2))))
    d = d.withColumn("_h", F.when(F.size("words") > 2, F.slice("_h", F.lit(1), F.greatest(F.size("words") - 2, F.lit(0)))).otherwise(F.expr("cast(array() as array<bigint>)")))
    # Equal windows stand side by side once sorted by hash; only texts that have any are sorted.
    pairs = F.sort_array(F.transform("_h", lambda h, i: F.struct(h.alias("h"), i.alias("i"))))
    d = d.withColumn("_p", F.when(F.size(F.array_distinct("_h")) < F.size("_h"), pairs))
    same = lambda x, k: (F.get("_p", k - 1)["h"] == x["h"]) | (F.get("_p", k + 1)["h"] == x["h"])
    d = d.withColumn("_r", F.sort_array(F.transform(F.filter("_p", lambda x, k: F.coalesce(same(x, k), F.lit(False))), lambda x: x["i"])))
    covered = F.aggregate(F.transform("_r", lambda x, k: F.least(F.lit(3), F.coalesce(F.get("_r", k + 1) - x, F.lit(3)))), F.lit(0).cast("long"), lambda a, x: a + x)
    n, chars = F.size("words").cast("long"), F.length(F.translate("text", " \t\n\x0b\f\r", "")).cast("long")
    d = d.select(
        "doc_id", "text", *carry, "words", "lines", n.alias("n_words"), chars.alias("word_chars"), count_chars(F.col("text"), SYMBOLS).alias("n_symbols"),
        (F.size("lines") - F.size(F.array_distinct("lines"))).cast("long").alias("n_dup_lines"),
        F.coalesce(covered, F.lit(0)).cast("long").alias("n_repeat_words"), F.size("lines").cast("long").alias("n_lines"),
    )
    return d.withColumn("base_failed", (F.col("n_words") < 50) | (F.col("n_repeat_words") * 100 > F.col("n_words") * 50))


def estimate(docs: DataFrame, rules: list[Rule], sample_rows: int = 1000, seed: int = 7, runs: int = 3) -> list[Estimate]:
    """Seconds (median of runs, beyond a bare scan) and rejection rate of each rule, each alone over one sample of about
    sample_rows rows, of which those count that pass the base: only they reach the rules."""
    rows = docs.count()
    share = 1.0 if rows <= sample_rows else sample_rows / rows
    drawn = docs.select("doc_id", "text") if share == 1.0 else docs.select("doc_id", "text").sample(share, seed)
    sample = materialise(base(drawn).coalesce(8), "rule-sample").where("not base_failed")
    found = []

    def timed(condition: Column) -> tuple[float, int, int]:
        query = sample.agg(F.count("*").alias("n"), F.count_if(condition).alias("hit"))
        query.first()  # planned and compiled once, before the clock starts
        seconds = []
        for _ in range(runs):
            began = time.perf_counter()
            out = query.first()
            seconds.append(time.perf_counter() - began)
        return median(seconds), out["n"], out["hit"]

    scan = timed(F.lit(True))[0]
    for rule in rules:
        seconds, n, hit = timed(rule.rejects())
        found.append(Estimate(rule, max(seconds - scan, LEAST_SECONDS), hit / max(n, 1)))
    return found


def cascade(estimates: list[Estimate]) -> list[Rule]:
    """Most rejections per second first; ties by name."""
    return [e.rule for e in sorted(estimates, key=lambda e: (-e.gain, e.rule.name))]


def judge(docs: DataFrame, rules: list[Rule] | None = None, sample_rows: int = 1000, carry: list[str] | None = None) -> DataFrame:
    """doc_id, text, columns to carry, the base columns and kept; rules run in the order found on a sample until one rejects."""
    ordered = cascade(estimate(docs, default_rules() if rules is None else rules, sample_rows))
    rejected = F.col("base_failed")
    for rule in ordered:  # OR stops at the first condition that holds
        rejected = rejected | F.coalesce(rule.rejects(), F.lit(False))
    return base(docs, carry).withColumn("kept", ~rejected)


def quality_rules(docs: DataFrame) -> DataFrame:
    return judge(docs).select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept")


def keep_good(docs: DataFrame, rules: list[Rule] | None = None) -> DataFrame:
    """docs, all columns, without the rows that the rules reject; their texts and lines are judged in place, without a join."""
    d, names = renamed(docs)
    held = d.select(F.struct(*names.values()).alias("_row"), F.col(names["doc_id"]).alias("doc_id"), F.col(names["text"]).alias("text"))
    # The row number keeps the optimiser from moving the condition below the steps that compute its columns: there it
    # would repeat each step's expression for every use, and the plan would outgrow the driver.
    judged = judge(held, rules, carry=["_row"]).withColumn("_n", F.monotonically_increasing_id())
    return judged.where(F.col("kept") & (F.col("_n") >= 0)).select("_row.*").toDF(*docs.columns)
