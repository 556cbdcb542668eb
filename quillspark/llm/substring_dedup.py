"""Substring dedup with a log-structured fingerprint index.

Every window of 35 words picks one fingerprint: the smallest hash among the 6-word shingles in it
(the last of equal ones). Equal windows pick the same fingerprint at the same place, and only one
shingle in about fifteen is picked, so the index is small. Each batch of documents adds one
immutable run of (fingerprint, count) and one of places, sorted by fingerprint; its run is merge-joined
with the runs before it, and runs are compacted. Fingerprints seen twice are then verified: first the whole
stretch of words whose windows picked it (one row for 15 windows), and where stretches differ,
window by window. What is taken as equal agrees in the fingerprint and in an independent 64-bit hash
of all its words.

Defined results: a null text has no words; a document with fewer than 35 words loses nothing;
windows of one document count against each other and may overlap; repeated rows count as documents
of their own and get equal results; null doc_ids are kept as null; an empty table gives an empty
result; columns other than doc_id and text are ignored. Texts are read whole.
"""

from __future__ import annotations

import collections
import functools
import hashlib
import itertools
import json
import math
import re
import uuid
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import WORD, materialise, renamed, scratch_path, shuffle_files_go, texts, whole_text

WINDOW = 35
SHINGLE = 6
PICKS = WINDOW - SHINGLE + 1
#: Words hashed at once, and entries of the word cache.
CHUNK = 400_000
CACHE = 400_000
#: A fingerprint is hot if it has HOT_LEAST places in a batch and more than one place in HOT of them all.
HOT_LEAST, HOT = 1000, 100_000

_M1, _M2 = np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB)
_OTHER = np.uint64(0xA5A5A5A5A5A5A5A5)
_B1, _B2 = 0x9E3779B97F4A7C15, 0xD6E8FEB86659FD93


def _mix(x: np.ndarray) -> np.ndarray:
    """A one-to-one scramble of 64-bit values."""
    x = (x ^ (x >> np.uint64(30))) * _M1
    x = (x ^ (x >> np.uint64(27))) * _M2
    return x ^ (x >> np.uint64(31))


class _Words(dict):
    """64-bit hashes of words, kept for the worker's life up to a bound."""

    def __missing__(self, word: bytes) -> int:
        import xxhash

        if len(self) >= CACHE:
            self.clear()
        self[word] = out = xxhash.xxh3_64_intdigest(word)
        return out


_WORDS = _Words()


_POWERS: dict[int, tuple[np.ndarray, np.ndarray]] = {}


def _powers(base: int, n: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers 0 to n, at least, of base's inverse and of base."""
    if base not in _POWERS or len(_POWERS[base][0]) <= n:
        size = max(2 * CHUNK, n)
        _POWERS[base] = tuple(np.cumprod(np.concatenate([np.ones(1, np.uint64), np.full(size, b, np.uint64)])) for b in (pow(base, -1, 1 << 64), base))
    return _POWERS[base]


class _Rolling:
    """Hashes of any stretch [a, b) of a sequence of word hashes."""

    def __init__(self, x: np.ndarray, base: int):
        self.inverse, powers = _powers(base, len(x))
        self.sums = np.concatenate([np.zeros(1, np.uint64), np.cumsum(x * powers[: len(x)])])

    def __call__(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        return _mix((self.sums[b] - self.sums[a]) * self.inverse[a])


def _hashes(text: str) -> np.ndarray:
    words = text.encode().split()
    return np.fromiter(map(_WORDS.__getitem__, words), np.uint64, len(words))


def _rollings(x: np.ndarray) -> tuple[_Rolling, _Rolling]:
    return _Rolling(_mix(x), _B1), _Rolling(_mix(x ^ _OTHER), _B2)


def _picked(x: np.ndarray, ends: np.ndarray) -> dict[str, np.ndarray]:
    """For the words x of documents that end at ends: each run of windows that pick one fingerprint.

    doc, fingerprint, stretch (hash of the run's words; its last five bits are free for a window's number), first (its first window's start in x), n (windows in it).
    """
    one, two = _rollings(x)
    starts = np.arange(len(x) - SHINGLE + 1)
    value = one(starts, starts + SHINGLE)
    at, width = starts, 1
    while width < PICKS:  # doubling: at[s] is the last smallest of the width shingles from s on
        step = min(width, PICKS - width)
        left, right = at[:-step], at[step:]
        at = np.where(value[right] <= value[left], right, left)
        width += step
    window = np.arange(len(at))
    doc = np.searchsorted(ends, window, "right")
    whole = window + WINDOW <= ends[doc]
    window, at, doc = window[whole], at[whole], doc[whole]
    new = np.ones(len(at), bool)
    new[1:] = (at[1:] != at[:-1]) | (doc[1:] != doc[:-1])
    first = np.nonzero(new)[0]
    n = np.diff(np.append(first, len(at)))
    a, pick = window[first], at[first]
    with np.errstate(over="ignore"):
        stretch = _mix(two(a, a + n - 1 + WINDOW) + (pick - a).astype(np.uint64) * _M1 + n.astype(np.uint64) * _M2) & ~np.uint64(31)
    return {"doc": doc[first], "fingerprint": value[pick], "stretch": stretch, "first": a, "n": n}


def _chunks(batch: list[str], least: int) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """Row numbers, concatenated word hashes and ends of the documents with at least so many words."""
    rows, parts, size = [], [], 0

    def out():
        return np.array(rows), np.concatenate(parts), np.cumsum([len(p) for p in parts])

    for i, text in enumerate(batch):
        x = _hashes(text)
        if len(x) >= least:
            rows.append(i)
            parts.append(x)
            size += len(x)
            if size >= CHUNK:
                yield out()
                rows, parts, size = [], [], 0
    if rows:
        yield out()


def occurrences(docs: DataFrame, batches: int = 1) -> DataFrame:
    """Where each fingerprint is picked: doc_id, text_key, fingerprint, stretch, starts (of the runs' first windows), n
    (windows in a run), batch. One row for each document, fingerprint and stretch."""
    d = texts(docs, key=True).withColumn("batch", F.pmod(F.xxhash64("doc_id", "text_key"), F.lit(batches)).cast("int"))

    kind = d.schema["doc_id"].dataType.simpleString()
    def of(frames: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in frames:
            for rows, x, ends in _chunks(b.column("text").to_pylist(), WINDOW):
                p = _picked(x, ends)
                order = np.lexsort((p["first"], p["stretch"], p["fingerprint"], p["doc"]))
                p = {k: v[order] for k, v in p.items()}
                new = np.ones(len(order), bool)
                new[1:] = (p["doc"][1:] != p["doc"][:-1]) | (p["fingerprint"][1:] != p["fingerprint"][:-1]) | (p["stretch"][1:] != p["stretch"][:-1])
                cut = np.nonzero(new)[0]
                begin = np.concatenate([[0], ends[:-1]])
                local = (p["first"] - begin[p["doc"]]).astype(np.int32)
                own = {c: b.column(c).take(pa.array(rows[p["doc"][cut]])) for c in ("doc_id", "text_key", "batch")}
                own |= {c: pa.array(p[c][cut].view(np.int64)) for c in ("fingerprint", "stretch")}
                own["starts"] = pa.ListArray.from_arrays(pa.array(np.append(cut, len(order)).astype(np.int32)), pa.array(local))
                own["n"] = pa.array(p["n"][cut].astype(np.int32))
                names = ["doc_id", "text_key", "fingerprint", "stretch", "starts", "n", "batch"]
                yield pa.RecordBatch.from_arrays([own[c] for c in names], names)

    return d.mapInArrow(of, f"doc_id {kind}, text_key long, fingerprint long, stretch long, starts array<int>, n int, batch int")


class FingerprintIndex:
    """Sorted immutable runs in a folder, listed in a manifest, so that another session can open it and go on.

    Each batch adds a run of (fingerprint, c) and one of places (occurrences), both bucketed and sorted by fingerprint: the
    run is merge-joined with the runs before it, and what it meets with their places, without a shuffle of either side.
    Fingerprints with HOT or more places in a batch (at most 1 / HOT of its places, so a bounded number) have their places
    in a table of their own, which is never dealt by fingerprint. Runs are compacted by size: fan_out of them whose rows are
    of one power of fan_out become one (fan_out ** 2 for places), so a row is written again once for each power, batches
    meet a number of runs that grows as the logarithm of all rows, and large runs are left alone until others are as large.
    """

    def __init__(self, spark: SparkSession, folder: str | None = None, buckets: int | None = None, fan_out: int = 2):
        self.spark, self.fan_out = spark, fan_out
        self.folder = folder or scratch_path(spark, "fingerprints")
        try:
            last = spark.read.schema("version int, runs string").parquet(f"{self.folder}/manifest").orderBy(F.desc("version")).first()
        except AnalysisException:  # no such folder: a new index
            last = None
        self.version = last["version"] if last else 0
        self.runs = json.loads(last["runs"]) if last else {"buckets": buckets or int(spark.conf.get("spark.sql.shuffle.partitions")), "keys": [], "places": [], "hot": [], "schemas": {}, "rows": {}, "written": {}}

    def _commit(self) -> None:
        self.version += 1
        self.spark.range(1).select(F.lit(self.version).alias("version"), F.lit(json.dumps(self.runs)).alias("runs")).coalesce(1).write.mode("append").parquet(f"{self.folder}/manifest")

    def _write(self, df: DataFrame, kind: str) -> str:
        """A new run; its rows are already dealt by fingerprint to as many tasks as there are buckets, or fewer."""
        name = f"{kind}_{uuid.uuid4().hex}"
        with shuffle_files_go(self.spark):
            if kind == "hot":
                df.write.parquet(f"{self.folder}/{name}")
            else:
                df.write.bucketBy(self.runs["buckets"], "fingerprint").sortBy("fingerprint").option("path", f"{self.folder}/{name}").saveAsTable(name)
        self.runs["schemas"][name] = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in df.schema)
        return name

    def run(self, name: str) -> DataFrame:
        if not self.spark.catalog.tableExists(name):  # written by another session
            self.spark.sql(f"CREATE TABLE {name} ({self.runs['schemas'][name]}) USING parquet CLUSTERED BY (fingerprint) SORTED BY (fingerprint) INTO {self.runs['buckets']} BUCKETS LOCATION '{self.folder}/{name}'")
        return self.spark.table(name)

    def _hot(self, name: str) -> DataFrame:
        return self.spark.read.parquet(f"{self.folder}/{name}")

    def add(self, found: DataFrame) -> DataFrame:
        """Add the occurrences of one batch (written, as they are read more than once). Returns those that share their
        fingerprint with another one, in this batch or in earlier ones: the batch's, and the earlier ones they meet."""
        mine = self._write(found.groupBy("fingerprint").agg(F.sum(F.size("starts")).alias("c")), "keys")
        total = self.run(mine).agg(F.coalesce(F.sum("c"), F.lit(0))).first()[0]
        hot = self.run(mine).where(F.col("c") >= max(HOT_LEAST, total // HOT)).select("fingerprint")
        hot_name = None
        cold = found
        if not hot.isEmpty():
            hot_name = self._write(found.join(F.broadcast(hot), "fingerprint", "left_semi"), "hot")
            cold = found.join(F.broadcast(hot), "fingerprint", "left_anti")
        places = self._write(cold.repartition("fingerprint"), "places")
        met = self.run(mine)
        for k, name in enumerate(self.runs["keys"]):
            met = met.join(self.run(name).select("fingerprint", F.lit(True).alias(f"old_{k}")).hint("merge"), "fingerprint", "left")
        old = F.coalesce(*(F.col(f"old_{k}") for k in range(len(self.runs["keys"]))), F.lit(False))
        met = self.run(self._write(met.select("fingerprint", old.alias("old"), "c").where("old or c > 1").select("fingerprint", "old"), "met"))
        hits = self.run(places).join(met.select("fingerprint").hint("merge"), "fingerprint", "left_semi")
        if hot_name:
            hits = hits.unionByName(self._hot(hot_name))
        again = met.where("old").select("fingerprint")
        for name in self.runs["places"]:
            hits = hits.unionByName(self.run(name).join(again.hint("merge"), "fingerprint", "left_semi"))
        for name in self.runs["hot"]:
            keys = self._hot(name).select("fingerprint").distinct().join(again, "fingerprint", "left_semi")
            hits = hits.unionByName(self._hot(name).join(F.broadcast(keys), "fingerprint", "left_semi"))
        hits = materialise(hits, "hits")
        for kind, name, least in (("keys", mine, self.fan_out), ("places", places, self.fan_out**2), ("hot", hot_name, self.fan_out**2)):
            if name:
                self._count(kind, name)
                self._compact(kind, least)
        self._commit()
        return hits

    def _read(self, kind: str, name: str) -> DataFrame:
        return self._hot(name) if kind == "hot" else self.run(name)

    def _count(self, kind: str, name: str) -> None:
        self.runs[kind].append(name)
        self.runs["rows"][name] = n = self._read(kind, name).count()
        self.runs["written"][kind] = self.runs["written"].get(kind, 0) + n

    def _compact(self, kind: str, least: int) -> None:
        """Merge runs of like size until fewer than least of any size are left; the old ones' files stay for sessions that have
        them open."""
        power = lambda name: int(math.log(self.runs["rows"][name] + 1, self.fan_out))
        while True:
            like = collections.Counter(map(power, self.runs[kind]))
            size = min((k for k, n in like.items() if n >= least), default=None)
            if size is None:
                return
            old = [name for name in self.runs[kind] if power(name) == size]
            merged = functools.reduce(DataFrame.unionByName, (self._read(kind, name) for name in old))
            merged = merged.groupBy("fingerprint").agg(F.sum("c").alias("c")) if kind == "keys" else merged.repartition("fingerprint") if kind == "places" else merged
            name = self._write(merged, kind)
            self.runs[kind] = [x for x in self.runs[kind] if x not in old]
            self._count(kind, name)


def _windows(docs: DataFrame, wanted: DataFrame) -> DataFrame:
    """fingerprint, w (hash of a window's words, independent of fingerprint), at (stretch + number of the window, or + 31
    for windows of stretches that are repeated as a whole): the windows of wanted stretches, read from one document each."""
    per_doc = wanted.groupBy("doc_id", "text_key").agg(F.collect_list(F.struct("fingerprint", "stretch", "start", "windows", "whole")).alias("all"))
    # Plain arrays reach pandas as numpy arrays.
    per_doc = per_doc.select(F.col("doc_id").alias("_id"), F.col("text_key").alias("_key"), *(F.col(f"all.{c}").alias(c) for c in ("fingerprint", "stretch", "start", "windows", "whole")))
    keyed = texts(docs, key=True)
    rows = keyed.join(per_doc, keyed["doc_id"].eqNullSafe(per_doc["_id"]) & (keyed["text_key"] == per_doc["_key"])).select("text", "fingerprint", "stretch", "start", "windows", "whole")

    def out(parts: list[tuple[np.ndarray, ...]]) -> pd.DataFrame:
        x, fingerprint, stretch, whole, m, start = map(np.concatenate, zip(*parts))
        bit = np.arange(m.sum()) - np.repeat(np.cumsum(m) - m, m)
        a = np.repeat(start, m) + bit
        w = _Rolling(_mix(x ^ _OTHER), _B2)(a, a + WINDOW).view(np.int64)
        return pd.DataFrame({"fingerprint": np.repeat(fingerprint, m), "w": w, "at": np.repeat(stretch, m) + np.where(np.repeat(whole, m), 31, bit)})

    def of(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in frames:
            parts, size = [], 0
            for text, fingerprint, stretch, start, m, whole in zip(*(b[c] for c in ("text", "fingerprint", "stretch", "start", "windows", "whole"))):
                words = text.encode().split()
                m = m.astype(np.int64)
                # Only the words of wanted stretches are hashed; each stretch stays in one piece.
                edge = np.bincount(start, minlength=len(words) + 1) - np.bincount(start + m - 1 + WINDOW, minlength=len(words) + 1)
                need = np.cumsum(edge[:-1]) > 0
                x = np.fromiter(map(_WORDS.__getitem__, itertools.compress(words, need.tolist())), np.uint64)
                parts.append((x, fingerprint, stretch, whole.astype(bool), m, (np.cumsum(need) - need)[start] + size))
                size += len(x)
                if size >= CHUNK:
                    yield out(parts)
                    parts, size = [], 0
            if parts:
                yield out(parts)

    return rows.mapInPandas(of, "fingerprint long, w long, at long")


def repeated(docs: DataFrame, hits: DataFrame) -> DataFrame:
    """fingerprint, stretch, mask: bit k is set if the stretch's window k has its equal somewhere else."""
    one = [F.first(c).alias(c) for c in ("doc_id", "text_key")]
    per = hits.groupBy("fingerprint", "stretch").agg(F.sum(F.size("starts")).alias("n"), F.first("n").alias("windows"), *one, F.first(F.element_at("starts", 1)).alias("start"))
    per = materialise(per.withColumn("whole", F.col("n") > 1).drop("n"), "stretches")
    # Written, so that both sides of the joins are shuffled by the join alone, and Spark can split a hot fingerprint.
    mixed = materialise(per.groupBy("fingerprint").agg(F.min("stretch").alias("lo"), F.max("stretch").alias("hi")).where("lo <> hi").select("fingerprint"), "mixed")
    windows = materialise(_windows(docs, per.join(mixed, "fingerprint")), "windows")
    # Windows of two stretches or more. The smallest and largest place are all there is of a group of two; only the
    # windows of larger groups are looked up again.
    twice = materialise(windows.groupBy("fingerprint", "w").agg(F.count("*").alias("c"), F.min("at").alias("lo"), F.max("at").alias("hi")).where("lo <> hi"), "repeated-windows")
    ends = twice.select("fingerprint", F.explode(F.array("lo", "hi")).alias("at"))
    inner = windows.join(twice.where("c > 2").select("fingerprint", "w"), ["fingerprint", "w"]).select("fingerprint", "at")
    single = ends.union(inner).where("at & 31 <> 31")
    masks = single.groupBy("fingerprint", F.expr("at & ~31L").alias("stretch")).agg(F.bit_or(F.expr("shiftleft(1L, cast(at & 31 as int))")).alias("mask"))
    full = per.where("whole").select("fingerprint", "stretch", F.expr("shiftleft(1L, windows) - 1").alias("mask"))
    return full.unionByName(masks)


def add_batch(index: FingerprintIndex, found: DataFrame, docs: DataFrame) -> DataFrame:
    """doc_id, text_key, marks (start * 2**30 + mask of each run of windows) of the documents with windows that are repeated
    within a batch or between it and earlier ones; earlier documents that a batch repeats are marked, too.

    found: the occurrences of the batch. docs: the documents of the batch and of those before.
    """
    hits = index.add(found)
    marks = hits.join(materialise(repeated(docs, hits), "repeated"), ["fingerprint", "stretch"])
    marks = marks.select("doc_id", "text_key", F.transform("starts", lambda s: s.cast("long") * F.lit(1 << PICKS).cast("long") + F.col("mask")).alias("m"))
    return materialise(marks.groupBy("doc_id", "text_key").agg(F.flatten(F.collect_list("m")).alias("marks")), "marks")


def removals(docs: DataFrame, batches: int = 2, index: FingerprintIndex | None = None) -> DataFrame:
    """doc_id, text_key, marks of the documents with repeated windows, found batch by batch (dealt by a hash)."""
    found = materialise(occurrences(docs, batches), "occurrences", "batch")
    index = index or FingerprintIndex(docs.sparkSession)
    marks = [add_batch(index, found.where(F.col("batch") == k).drop("batch"), docs) for k in range(batches)]
    all_ = functools.reduce(DataFrame.unionByName, marks)
    return all_.groupBy("doc_id", "text_key").agg(F.flatten(F.collect_list("marks")).alias("marks"))


def covered(n: int, marks: np.ndarray | None) -> np.ndarray:
    """Which of n words lie in a marked window."""
    edge = np.zeros(n + 1, np.int64)
    if marks is not None and len(marks):
        for some in np.array_split(np.asarray(marks, np.int64), 1 + len(marks) // CHUNK):
            i, k = np.nonzero((some[:, None] >> np.arange(PICKS)) & 1)
            at = (some >> PICKS)[i] + k
            edge += np.bincount(at, minlength=n + 1) - np.bincount(at + WINDOW, minlength=n + 1)
    return np.cumsum(edge[:n]) > 0


def _marked(keyed: DataFrame, doc_id: str, marks: DataFrame) -> DataFrame:
    """keyed (with text_key) and marks; null where a document has none."""
    marks = marks.withColumnsRenamed({"doc_id": "marked_id", "text_key": "marked_key"})
    return keyed.join(marks, keyed[doc_id].eqNullSafe(marks["marked_id"]) & (keyed["text_key"] == marks["marked_key"]), "left")


def substring_dedup(docs: DataFrame, batches: int = 2) -> DataFrame:
    """doc_id, n_words, n_removed, kept_sha256."""
    d = _marked(texts(docs, key=True), "doc_id", removals(docs, batches)).select("doc_id", "text", "marks")

    def of(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in frames:
            out = []
            for text, marks in zip(b["text"], b["marks"]):
                words = text.encode().split()
                gone = 0
                n = len(words)
                if marks is not None and len(marks):
                    away = covered(n, marks)
                    gone = int(away.sum())
                    words = [w for w, x in zip(words, away.tolist()) if not x]
                out.append((n, gone, hashlib.sha256(b" ".join(words)).hexdigest()))
            yield pd.concat([b[["doc_id"]].reset_index(drop=True), pd.DataFrame(out, columns=["n_words", "n_removed", "kept_sha256"])], axis=1)

    kind = d.schema["doc_id"].dataType.simpleString()
    return d.mapInPandas(of, f"doc_id {kind}, n_words long, n_removed long, kept_sha256 string")


def drop_repeats(docs: DataFrame, batches: int = 2) -> DataFrame:
    """docs, all columns and rows; from texts with repeated windows the covered words go, each with the space after it.
    n_chars, where docs has it, follows the new text."""
    d, names = renamed(docs)
    text = whole_text(F.col(names["text"]))
    d = _marked(d.withColumn("text_key", F.xxhash64(text)), names["doc_id"], removals(docs, batches))

    @F.pandas_udf("string")
    def cut(text: pd.Series, marks: pd.Series) -> pd.Series:
        out = []
        for t, m in zip(text, marks):
            spans = [x.span() for x in re.finditer(WORD, t)]
            away = covered(len(spans), m).tolist()
            ends = [s for s, _ in spans[1:]] + [len(t)]
            out.append((t[: spans[0][0]] if spans else t) + "".join(t[a:e] for (a, _), e, x in zip(spans, ends, away) if not x))
        return pd.Series(out)

    new = F.when(F.col("marks").isNull(), F.col(names["text"])).otherwise(cut(text, F.coalesce("marks", F.expr("cast(array() as array<bigint>)"))))
    d = d.withColumn(names["text"], new)
    if "n_chars" in names:
        n = names["n_chars"]
        d = d.withColumn(n, F.when(F.col("marks").isNull(), F.col(n)).otherwise(F.length(names["text"]).cast(docs.schema["n_chars"].dataType)))
    return d.select(*names.values()).toDF(*docs.columns)
