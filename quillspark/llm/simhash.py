"""SimHash near-duplicates by deletion variants of two segments.

A 64-bit fingerprint is cut into two halves. Fingerprints at three or fewer differing bits agree in
one half but for at most one bit, so the distinct values of each half are indexed under their
variants with one bit deleted: a variant is shared by two values at most, which makes the lookup an
aggregation and never a join of a group with itself. Pairs of close halves are then matched on the
other half and verified. Halves held by very many fingerprints are matched on deletion variants of
the other half too, so no group is compared with itself pair by pair, and no link is lost.

drop_near_duplicates goes by the Jaccard similarity of shingles. A pair at 0.8 differs in ten of 64 bits on average, too
many for deletion variants, so bands of minimum hashes give further candidates, and all are verified on the sets.

Defined results: null and empty texts (no words) have fingerprint zero and link like any other;
repeated rows get equal results; null doc_ids keep their row but give no id to a component (null if
it has no other); an empty table gives an empty result; columns other than doc_id and text are
ignored. Texts are read whole.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import cache

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import materialise, renamed, texts, whole_text

#: Groups up to this many fingerprints (or pairs up to its square) are compared directly.
DIRECT = 128
#: Half fingerprints in a task that makes their variants, about.
HALVES = 20_000
#: Bands of minimum hashes, and hashes in each. Sets of a small bucket, leaders of a larger one, rounds until buckets are
#: cut finer, and leaders from then on.
BANDS, ROWS = 32, 6
SMALL, LEADERS, COARSE, BLOCK = 8, 1, 3, 32
#: Bits of 64 in which the fingerprints of such candidates may differ: 9.6 do on average at a similarity of 0.8, and more
#: than 20 in 2 of 10,000 pairs.
APART = 20


def shingle_hashes(text: str, shingle: int = 3) -> np.ndarray:
    """XXH64 (seed 42) of the lower-cased word shingles of a text, repeats included; texts of fewer words are one shingle."""
    import xxhash

    words = text.encode().lower().split()  # on bytes: A-Z only, and split at x20, x09-x0D only
    if not words:
        return np.empty(0, np.uint64)
    line = b" ".join(words)
    one = xxhash.xxh64_intdigest
    if len(words) <= shingle:
        return np.array([one(line, 42)], np.uint64)
    ends = np.cumsum([len(w) + 1 for w in words])
    starts = [0, *ends[:-1].tolist()]
    return np.fromiter((one(line[a:b], 42) for a, b in zip(starts, (ends[shingle - 1 :] - 1).tolist())), np.uint64)


def _majority(hashes: np.ndarray) -> int:
    ones = np.zeros(64, np.int64)
    for i in range(0, len(hashes), 1 << 15):
        bits = np.unpackbits(hashes[i : i + (1 << 15)].view(np.uint8), bitorder="little").reshape(-1, 64)
        ones += bits.sum(axis=0, dtype=np.int64)
    return int(sum(1 << j for j in np.nonzero(2 * ones > len(hashes))[0].tolist()))


def fingerprint(text: str, shingle: int = 3) -> int:
    """Unsigned 64-bit SimHash over the hashes of a text's shingles."""
    return _majority(shingle_hashes(text, shingle))


def fingerprints(docs: DataFrame, shingle: int = 3) -> DataFrame:
    """doc_id, text_key, fp (the fingerprint as a signed long) of each row."""
    d = texts(docs, key=True)

    def of(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            fp = np.array([fingerprint(t, shingle) for t in b["text"]], np.uint64).view(np.int64)
            yield pd.DataFrame({"doc_id": b["doc_id"], "text_key": b["text_key"], "fp": fp})

    kind = d.schema["doc_id"].dataType.simpleString()
    return d.mapInPandas(of, f"doc_id {kind}, text_key long, fp long")


def _halves(fps: DataFrame) -> DataFrame:
    """half, v (that half), o (the other half), fp: two rows for each distinct fingerprint."""
    low, high = F.col("fp").bitwiseAND(F.lit(0xFFFFFFFF)), F.shiftrightunsigned("fp", 32)
    row = lambda k, v, o: F.struct(F.lit(k).alias("half"), v.alias("v"), o.alias("o"))
    return fps.select("fp", F.explode(F.array(row(0, low, high), row(1, high, low))).alias("x")).select("fp", "x.half", "x.v", "x.o")


def _cleared(v: Column, i: Column) -> Column:
    return F.expr("v & ~shiftleft(1L, i)") if v is None else v.bitwiseAND(F.bitwise_not(F.call_function("shiftleft", F.lit(1).cast("long"), i)))


def _apart(a: Column, b: Column) -> Column:
    return F.bit_count(a.bitwiseXOR(b))


def links(fps: DataFrame, bits: int = 2, direct: int = DIRECT) -> DataFrame:
    """Links (a, b) that join all of fps (distinct fp) at bits (2 or 3) or fewer differing bits.

    Every pair this close is linked, directly or, inside a very large group, through close members.
    """
    if not 1 <= bits <= 3:
        raise ValueError("two segments cover one to three differing bits")
    halves = materialise(_halves(fps), "simhash-halves")
    # Dealt by the number of halves, as each value becomes 32 rows: by its bytes alone, it would go to a few tasks.
    values = halves.repartition(halves.count() // HALVES + 1, "half", "v").groupBy("half", "v").agg(F.count("*").alias("c"))
    wild = values.select("half", "v", "c", F.explode(F.sequence(F.lit(0), F.lit(31))).alias("i"))
    near = (
        wild.groupBy("half", "i", _cleared(F.col("v"), F.col("i")).alias("rest"))
        .agg(F.min("v").alias("va"), F.max("v").alias("vb"), F.min_by("c", "v").alias("ca"), F.max_by("c", "v").alias("cb"))
        .where("va <> vb").select("half", "va", "vb", "ca", "cb")
    )
    same = values.where("c > 1").select("half", F.col("v").alias("va"), F.col("v").alias("vb"), F.col("c").alias("ca"), F.col("c").alias("cb"))
    pairs = materialise(near.union(same), "simhash-pairs")
    small = F.col("ca") * F.col("cb") <= direct * direct
    left = halves.select("half", F.col("v").alias("va"), F.col("o").alias("oa"), F.col("fp").alias("a"))
    right = halves.select("half", F.col("v").alias("vb"), F.col("o").alias("ob"), F.col("fp").alias("b"))
    verified = (_apart(F.col("a"), F.col("b")) <= bits) & ((F.col("va") != F.col("vb")) | (F.col("a") < F.col("b")))
    few = pairs.where(small).join(left, ["half", "va"]).join(right, ["half", "vb"]).where(verified).select("a", "b")
    many = pairs.where(~small)
    if not many.isEmpty():
        few = few.union(_crowded(many, halves, bits))
    return few.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct()


def _crowded(pairs: DataFrame, halves: DataFrame, bits: int) -> DataFrame:
    """Links for pairs of half values with very many fingerprints: members that agree in all but deleted bits of the
    other half form groups of 2**deleted values a side at most, and each is linked to the group's smallest."""
    side = lambda v: pairs.join(halves, (pairs["half"] == halves["half"]) & (pairs[v] == halves["v"])).select(pairs["half"], "va", "vb", "o", "fp")
    rows = side("va").union(side("vb").where("va <> vb"))
    own = bits - F.when(F.col("va") == F.col("vb"), 0).otherwise(1)  # bits left for the other half
    bit = lambda i: F.call_function("shiftleft", F.lit(1).cast("long"), i)
    one = F.transform(F.sequence(F.lit(0), F.lit(31)), bit)
    two = F.flatten(F.transform(F.sequence(F.lit(0), F.lit(30)), lambda i: F.transform(F.sequence(i + 1, F.lit(31)), lambda j: bit(i).bitwiseOR(bit(j)))))
    three = F.flatten(F.transform(two, lambda m: F.transform(F.filter(one, lambda x: x > m), lambda x: x.bitwiseOR(m))))
    masks = F.when(own == 1, one).when(own == 2, two).otherwise(three)
    keyed = rows.withColumn("mask", F.explode(masks)).withColumn("rest", F.col("o").bitwiseAND(F.bitwise_not("mask")))
    grouped = keyed.groupBy("half", "va", "vb", "mask", "rest").agg(F.collect_set("fp").alias("fps")).where(F.size("fps") > 1)
    pair = grouped.select(F.explode(F.transform("fps", lambda x: F.struct(x.alias("a"), F.col("fps").alias("fps")))).alias("x")).select("x.a", F.explode("x.fps").alias("b"))
    return pair.where((F.col("a") < F.col("b")) & (_apart(F.col("a"), F.col("b")) <= bits))


def components(edges: DataFrame) -> DataFrame:
    """vertex, root of each vertex of edges (a, b): vertices hook to their smallest neighbour by a mixed id, edges are
    contracted, until none is left; each round is written, so lineage stays short."""
    mix = lambda c: F.xxhash64(c)  # noqa: E731  one to one on longs; spreads ids so that chains shrink by a share each round
    e = edges.select(mix("a").alias("x"), mix("b").alias("y"))
    e = materialise(e.select(F.least("x", "y").alias("x"), F.greatest("x", "y").alias("y")), "cc-edges")
    names = edges.select(F.col("a").alias("vertex")).union(edges.select("b")).distinct()
    labels = materialise(names.select("vertex", mix("vertex").alias("root")), "cc-labels")
    while not e.isEmpty():
        hook = materialise(e.groupBy("y").agg(F.min("x").alias("to")), "cc-hooks")
        step = lambda df, c: df.join(hook.withColumnRenamed("y", c), c, "left").withColumn(c, F.coalesce("to", c)).drop("to")  # noqa: B023, E731
        labels = materialise(step(labels, "root"), "cc-labels")
        e = step(step(e, "x"), "y").where("x <> y")
        e = materialise(e.select(F.least("x", "y").alias("x"), F.greatest("x", "y").alias("y")).distinct(), "cc-edges")
    return labels


def near_duplicates(docs: DataFrame, shingle: int = 3, bits: int = 2) -> DataFrame:
    """doc_id, text_key, fp, component_id (smallest doc_id reachable over links)."""
    fps = materialise(fingerprints(docs, shingle), "simhash-fp")
    distinct = materialise(fps.groupBy("fp").agg(F.min("doc_id").alias("rep")), "simhash-distinct")
    found = materialise(links(distinct.select("fp"), bits), "simhash-links")
    roots = components(found)
    members = distinct.join(roots, distinct["fp"] == roots["vertex"])
    ids = members.groupBy("root").agg(F.min("rep").alias("id"))
    linked = members.join(ids, "root").select("fp", "id")
    of = distinct.join(linked, "fp", "left").select("fp", F.coalesce("id", "rep").alias("component_id"))
    return fps.join(materialise(of, "simhash-components"), "fp")


def simhash_near_dedup(docs: DataFrame) -> DataFrame:
    out = near_duplicates(docs)
    return out.select("doc_id", F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id")


@cache
def _draws() -> tuple[np.ndarray, np.ndarray]:
    draw = np.random.RandomState(42).randint(0, 1 << 32, (4, BANDS * ROWS, 1), np.uint64)
    return draw[0] << np.uint64(32) | draw[1] | np.uint64(1), draw[2] << np.uint64(32) | draw[3]


def _band_keys(distinct: np.ndarray) -> list[int]:
    """A hash of each band of ROWS smallest values over distinct shingle hashes, each value under a hash function of its own."""
    import xxhash

    by, plus = _draws()
    least = np.full(BANDS * ROWS, np.iinfo(np.uint64).max, np.uint64)
    for i in range(0, len(distinct), 256):
        np.minimum(least, (by * distinct[i : i + 256] + plus).min(axis=1), out=least)
    rows = least.reshape(BANDS, ROWS)
    return [xxhash.xxh64_intdigest(rows[b].tobytes(), b) for b in range(BANDS)]


def sketches(docs: DataFrame, shingle: int) -> DataFrame:
    """doc_id, text_key, sk (hash of the set of shingles), n (its size), fp and bands (none where only equal sets are close) of each row."""
    d = texts(docs, key=True)

    def of(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        import xxhash

        for b in batches:
            out = []
            for t in b["text"]:
                hashes = shingle_hashes(t, shingle)
                distinct = np.unique(hashes)
                bands = np.array(_band_keys(distinct) if len(distinct) > 3 else [], np.uint64).view(np.int64)
                out.append((xxhash.xxh64_intdigest(distinct.tobytes(), 7), len(distinct), _majority(hashes), bands))
            sk, n, fp, bands = zip(*out) if out else ([], [], [], [])
            signed = lambda x: np.array(x, np.uint64).view(np.int64)
            yield pd.DataFrame({"doc_id": b["doc_id"], "text_key": b["text_key"], "sk": signed(sk), "n": np.array(n, np.int64), "fp": signed(fp), "bands": list(bands)})

    kind = d.schema["doc_id"].dataType.simpleString()
    return d.mapInPandas(of, f"doc_id {kind}, text_key long, sk long, n long, fp long, bands array<long>")


def _sets(docs: DataFrame, wanted: DataFrame, shingle: int) -> DataFrame:
    """sk, hashes (the distinct ones) of the rows wanted (id, key, sk), one for each sk."""
    keyed = texts(docs, key=True)
    found = keyed.join(wanted, keyed["doc_id"].eqNullSafe(wanted["id"]) & (keyed["text_key"] == wanted["key"])).select("sk", "text")

    def of(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            yield pd.DataFrame({"sk": b["sk"], "hashes": [np.unique(shingle_hashes(t, shingle)).view(np.int64) for t in b["text"]]})

    return found.mapInPandas(of, "sk long, hashes array<long>").dropDuplicates(["sk"])


def _verified(pairs: DataFrame, sets: DataFrame, similarity: float) -> DataFrame:
    """The pairs (a, b) whose sets reach the similarity (Jaccard)."""
    side = lambda c: sets.select(F.col("sk").alias(c), F.col("hashes").alias(f"_{c}"))
    both = F.size(F.array_intersect("_a", "_b"))
    return pairs.join(side("b"), "b").join(side("a"), "a").where(both >= similarity * (F.size("_a") + F.size("_b") - both) - 1e-9).select("a", "b")


def _sizes_allow(na: Column, nb: Column, most: Column, similarity: float) -> Column:
    """Whether sets of na and nb shingles that have at most so many in common can reach the similarity."""
    return (1 + similarity) * most >= similarity * (na + nb) - 1e-6


def _without(df: DataFrame, gone: DataFrame, *columns: str) -> DataFrame:
    order = df.columns  # a join by name puts its column first
    for c in columns:
        df = df.join(gone.select(F.col("sk").alias(c)), c, "left_anti")
    return df.select(*order)


def _refined(crowd: DataFrame, sets: DataFrame, similarity: float) -> DataFrame:
    """Crowded buckets cut finer: a set is dealt by its rarest shingles, so many of them that any two sets which reach the
    similarity have one in common (a prefix filter), whatever buckets they shared. A shingle that no other set here has
    counts among them, but makes no bucket. m of a bucket's set: its shingles from this one on that others have, too. In
    the first bucket that two sets share they have no more than the lesser m in common (a positional filter), so sets that
    are close to none of their bucket by their sizes and m leave it."""
    some = crowd.groupBy("sk").agg(F.min("n").alias("n"), F.min("fp").alias("fp"))
    shingles = materialise(some.join(sets, "sk").select("sk", "n", "fp", F.explode("hashes").alias("k")), "near-shingles")
    often = shingles.groupBy("k").agg(F.count("*").alias("c")).where("c > 1")
    shared = shingles.join(often, "k").groupBy("sk", "n", "fp").agg(F.sort_array(F.collect_list(F.struct("c", "k"))).alias("s"))
    # Of n shingles the first n - ceil(similarity * n) + 1, less those of no other set.
    first = F.size("s") - F.ceil(similarity * F.col("n") - 1e-6).cast("int") + 1
    placed = shared.where(first > 0).select(F.posexplode(F.slice("s", F.lit(1), first)).alias("i", "x"), F.size("s").alias("m"), "sk", "n", "fp")
    placed = materialise(placed.select("x.k", "sk", "n", (F.col("m") - F.col("i")).cast("long").alias("m"), "fp"), "near-placed")
    # One of two close sets is the smaller, and its m must do for two of its size. Others need one of these that they suit.
    n, m = F.col("n"), F.col("m")
    other = (1 + similarity) / similarity * m - n  # the most shingles that a close set can have
    lesser = placed.where(_sizes_allow(n, n, m, similarity)).groupBy("k").agg(F.min("n").alias("from"), F.max(other).alias("to"))
    return placed.join(lesser, "k").where((other >= F.col("from") - 1e-6) & (n <= F.col("to") + 1e-6)).select("k", "sk", "n", "m", "fp")


def covered(members: DataFrame, more: DataFrame, sets: DataFrame, similarity: float, block: int = BLOCK) -> DataFrame | None:
    """sk of the sets to drop, so that each reaches the similarity to one that stays and no two candidates that stay reach it.

    members: k, sk, n, fp of buckets of candidates; more: other candidate pairs (a, b). By order of sk, a
    set stays unless it is close to a smaller one that stays. A round compares all sets of buckets of up to SMALL, which are
    then done with, and in larger ones the LEADERS smallest with all. The sets that stay or go leave, and so groups of copies
    do; what is left meets the next round, after COARSE rounds in buckets of one rare shingle, block sets of each with all and
    twice as many each time, as far as a pair's sizes and places there allow it to be close. No pair is left out by that. So
    work never grows with a bucket's square unless very many sets share one of their rarest shingles, with fewer rarer ones
    than close sets may differ in, and none is close to others; those, too, are compared in full, block by block.
    """
    close = materialise(_verified(more, sets, similarity), "near-close")
    crowd, dropped, rounds = members.withColumn("m", F.col("n")), None, 0
    while crowd is not None or not close.isEmpty():
        waiting = lead = None
        if crowd is not None:
            least, few = (SMALL, LEADERS) if rounds < COARSE else (block << min(rounds - COARSE, 10),) * 2
            ranked = crowd.withColumn("r", F.row_number().over(Window.partitionBy("k").orderBy("sk"))).where(F.col("r") <= least + 1)
            ranked = ranked.withColumn("c", F.max("r").over(Window.partitionBy("k"))).where((F.col("c") <= least) | (F.col("r") <= few))
            lead = materialise(ranked.select("k", F.col("sk").alias("a"), F.col("n").alias("na"), F.col("m").alias("ma"), F.col("fp").alias("fpa")), "near-lead")
            likely = _sizes_allow(F.col("na"), F.col("n"), F.least("ma", "m"), similarity) & (_apart(F.col("fpa"), F.col("fp")) <= APART)
            pairs = crowd.join(lead, "k").where((F.col("a") < F.col("sk")) & likely)
            pairs = materialise(pairs.select("a", F.col("sk").alias("b")).distinct(), "near-pairs")
            close = materialise(close.union(_verified(pairs, sets, similarity)).distinct(), "near-close")
            waiting = materialise(crowd.join(lead.select("k", F.col("a").alias("sk")), ["k", "sk"], "left_anti").select("k", "sk"), "near-waiting")
        stay = close.select(F.col("a").alias("sk"))
        if lead is not None:
            stay = _without(stay.union(lead.select("a")), waiting.select("sk").distinct(), "sk")
        stay = materialise(_without(stay.distinct(), close.select(F.col("b").alias("sk")).distinct(), "sk"), "near-stay")
        gone = materialise(close.join(stay.select(F.col("sk").alias("a")), "a", "left_semi").select(F.col("b").alias("sk")).distinct(), "near-gone")
        dropped = gone if dropped is None else dropped.union(gone)
        close = materialise(_without(close, gone, "a", "b"), "near-close")
        rounds += 1
        if crowd is not None:
            large = waiting.select("k").distinct()
            crowd = _without(crowd.join(large, "k", "left_semi").select("k", "sk", "n", "m", "fp"), gone.union(stay), "sk")
            crowd = materialise(_refined(crowd, sets, similarity) if rounds == COARSE else crowd, "near-buckets")
            crowd = None if crowd.isEmpty() else crowd
    return dropped


def drop_near_duplicates(docs: DataFrame, shingle: int = 5, bits: int = 3, similarity: float = 0.8) -> DataFrame:
    """docs, all columns, without near copies: each row that goes has a Jaccard similarity of distinct shingles of at least
    similarity to one that stays, and none of the candidate pairs that stay reaches it.

    A set yields to those that share more bands with others (then, to a smaller hash).
    Of rows with equal sets of shingles the one with the smallest doc_id stays (of rows repeating it, one; of rows without
    any doc_id, one). Candidates are fingerprints at bits or fewer differing bits, and sets that agree in one of BANDS bands
    of ROWS minimum hashes and whose fingerprints differ in APART bits at most: at a similarity
    of 0.8, all but 9 pairs in 10,000 are expected to; all candidates are verified.
    """
    rows = materialise(sketches(docs, shingle), "near-sketches")
    least = F.struct(F.col("doc_id").isNull(), "doc_id", "text_key")
    reps = rows.groupBy("sk").agg(F.min(least).alias("x"), F.min("fp").alias("fp"), F.min("n").alias("n"))
    reps = materialise(reps.select("sk", "n", "fp", F.col("x.doc_id").alias("id"), F.col("x.text_key").alias("key")), "near-reps")
    keys = rows.select("sk", "n", "fp", F.explode("bands").alias("k")).groupBy("k", "sk").agg(F.min("n").alias("n"), F.min("fp").alias("fp"))
    keys = materialise(keys, "near-keys")
    members = materialise(keys.join(keys.groupBy("k").agg(F.count("*").alias("c")).where("c > 1"), "k"), "near-members")
    # One set stands for each fingerprint; sets with the same fingerprint are candidates with it, too.
    some = reps.where("n > 3")
    of = materialise(some.groupBy("fp").agg(F.min("sk").alias("first")), "near-fp")
    found = links(of.select("fp"), bits)
    by = lambda c: of.select(F.col("fp").alias(c), F.col("first").alias(f"first_{c}"))
    linked = found.join(by("a"), "a").join(by("b"), "b").select(F.least("first_a", "first_b").alias("a"), F.greatest("first_a", "first_b").alias("b"))
    same = some.join(of, "fp").where("sk <> first").select(F.col("first").alias("a"), F.col("sk").alias("b"))
    more = materialise(linked.union(same).distinct(), "near-linked")
    wanted = members.select("sk").union(more.select("a")).union(more.select("b")).distinct()
    # Sets that share most with others come first: those that most copies stem from, or are close to, cover them at once.
    order = wanted.join(members.groupBy("sk").agg(F.sum("c").alias("c")), "sk", "left")
    order = materialise(order.select("sk", F.struct((-F.coalesce("c", F.lit(0))).alias("first"), "sk").alias("o")), "near-order")
    ordered = lambda df, c: df.join(order.withColumnsRenamed({"sk": c, "o": f"o_{c}"}), c).drop(c).withColumnRenamed(f"o_{c}", c)
    sets = ordered(_sets(docs, reps.join(wanted, "sk", "left_semi").select("sk", "id", "key"), shingle), "sk")
    more = ordered(ordered(more, "a"), "b").select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b"))
    gone = covered(ordered(members.drop("c"), "sk"), more, materialise(sets, "near-sets"), similarity)
    keep = (reps if gone is None else _without(reps, gone.select("sk.sk"), "sk")).select("id", "key")
    d, names = renamed(docs)
    keyed = d.withColumn("row_key", F.xxhash64(whole_text(F.col(names["text"]))))
    kept = keyed.join(keep, keyed[names["doc_id"]].eqNullSafe(keep["id"]) & (keyed["row_key"] == keep["key"]), "left_semi")
    return kept.dropDuplicates([names["doc_id"], "row_key"]).select(*names.values()).toDF(*docs.columns)
