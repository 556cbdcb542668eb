"""Conversation structure repair: the cheapest edits that give every conversation the turns system?, (user, assistant)+.

A conversation's edits form a lattice: a node is a row to come and what the last turn written was. A* searches it, keyed
(cost plus heuristic, audit); the heuristic is the suffix sum of mandatory deletions and of the charges that truncated rows
cost at least, which never decreases along an edge by more than the edge costs. So the first goal that leaves the heap is the
cheapest and, of those, the one whose audit (the edits' initials in order) comes first in ASCII.

Conversations of up to BLOCK rows are streamed, sorted, through tasks that hold one of them at a time. Longer ones are
numbered by range partitions and cut into blocks; each block gives the best edits from each state to each other one, which
are then chained block by block. Only the hash of a long conversation's whole text has to be one chain: there, a task streams
its pieces in order and holds one of them.

Defined results: null roles and texts are one space; rows of one turn stand by role, then text, and those without a turn
first; rows without a conv_id are one conversation; rows that are equal are repeated turns (the later ones duplicates); an
empty table gives an empty result; columns other than conv_id, turn, role, text (and the one that lost names) are ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterable, Iterator
from heapq import heappop, heappush
from itertools import groupby
from operator import itemgetter

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators.ordering import numbered
from .common import materialise

#: Rows of a conversation that one task may hold; longer ones are searched in blocks of so many.
BLOCK = 256
BLANKS = " \t\n\x0b\f\r"

START, PROMPTED, ASKED, REPLIED = range(4)
ENDS = (START, REPLIED)
#: The state after a role's initial, and the state and role that a rewritten or new turn gives.
KEEP = {(START, "s"): PROMPTED, (START, "u"): ASKED, (PROMPTED, "u"): ASKED, (ASKED, "a"): REPLIED, (REPLIED, "u"): ASKED}
TURN = {START: (ASKED, "user"), PROMPTED: (ASKED, "user"), ASKED: (REPLIED, "assistant"), REPLIED: (ASKED, "user")}
LEGAL = {"su", "ua", "au"}
FINE, BLANK, DUPLICATE, TRUNCATED = range(4)
#: Costs of edits, and what a row with a fault costs at least.
DELETE, REROLE, INSERT, CUT_SHORT = 3, 2, 2, 1
LEAST = (0, DELETE, DELETE, CUT_SHORT)

Best = dict[int, tuple[int, str]]


def cheapest(initials: list[str], faults: list[int], start: int = START, ends: Iterable[int] = ENDS, every: bool = False) -> Best:
    """(cost, audit) of the best edits of rows, by the state they end in: of the best of ends or of every one that is reached."""
    n = len(initials)
    to_come = [0] * (n + 1)
    for i in range(n - 1, -1, -1):
        to_come[i] = to_come[i + 1] + LEAST[faults[i]]
    heap, done, found = [(to_come[0], "", 0, start)], set(), {}
    ends = set(ends)
    while heap:
        key, audit, i, state = heappop(heap)
        if (i, state) in done:
            continue
        done.add((i, state))
        cost = key - to_come[i]
        if i == n and state in ends:
            found[state] = (cost, audit)
            if not every or len(found) == len(ends):
                break
        following = TURN[state][0]
        heappush(heap, (cost + INSERT + to_come[i], audit + "I", i, following))
        if i == n:
            continue
        rest = cost + to_come[i + 1]
        heappush(heap, (rest + DELETE, audit + "D", i + 1, state))
        if faults[i] not in (BLANK, DUPLICATE):
            charge = CUT_SHORT if faults[i] == TRUNCATED else 0
            heappush(heap, (rest + REROLE + charge, audit + "R", i + 1, following))
            kept = KEEP.get((state, initials[i]))
            if kept is not None:
                heappush(heap, (rest + charge, audit + "K", i + 1, kept))
    return found


def applied(rows: list[tuple[str, str]], audit: str, state: int = START) -> Iterator[tuple[str, str, str]]:
    """(edit, role, text) of the turns that an audit makes of rows (role, text)."""
    at = iter(rows)
    for edit in audit:
        role, text = ("", "") if edit == "I" else next(at)
        if edit == "K":
            state = KEEP[state, role[:1]]
        elif edit != "D":
            state, role = TURN[state]
        if edit != "D":
            yield edit, role, text


def illegal_pairs(initials: list[str]) -> int:
    return sum(a + b not in LEGAL for a, b in zip(initials, initials[1:]))


def damaged(conversations: DataFrame) -> DataFrame:
    """conversations with planted damage, by crc32(conv_id:turn) mod 20: 0 loses the row (lost is true), 1 empties its text, 2
    takes its full stops, 3 repeats it, 4 makes it the user's."""
    given = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(" "))
    kind = F.crc32(F.concat(given("conv_id"), F.lit(":"), given("turn")).cast("binary")) % 20
    text = F.when(kind == 1, "").when(kind == 2, F.translate(given("text"), ".!?", "")).otherwise(given("text"))
    role = F.when(kind == 4, "user").otherwise(given("role"))
    copies = F.explode(F.when(kind == 3, F.array(F.lit(0), F.lit(1))).otherwise(F.array(F.lit(0))))
    return conversations.select("conv_id", "turn", role.alias("role"), text.alias("text"), (kind == 0).alias("lost"), copies.alias("copy")).drop("copy")


def _rows(conversations: DataFrame, lost: str | None) -> DataFrame:
    """key (conv_id as text that is never null), conv_id, turn, role, text, lost, state (of the text: fine, blank or truncated)."""
    given = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(" "))
    gone = F.coalesce(lost, F.lit(False)) if lost else F.lit(False)
    bare = F.rtrim(given("text"), F.lit(BLANKS))
    fault = F.when(bare == "", BLANK).when(F.right(bare, F.lit(1)).isin(".", "!", "?"), FINE).otherwise(TRUNCATED)
    key = F.coalesce(F.concat(F.lit("c"), F.col("conv_id").cast("string")), F.lit(""))
    return conversations.select(key.alias("key"), "conv_id", F.col("turn").cast("long").alias("turn"), given("role").alias("role"), given("text").alias("text"), gone.alias("lost"), fault.alias("fault"))


def _groups(batches: Iterable[pa.RecordBatch], *by: str) -> Iterator[tuple[tuple, Iterator[dict]]]:
    """Runs of rows with equal columns by, across batches."""
    rows = (row for batch in batches for row in batch.to_pylist())
    return groupby(rows, key=itemgetter(*by) if len(by) > 1 else lambda r: (r[by[0]],))


def _batched(rows: Iterable[dict], schema: pa.Schema, size: int = 256) -> Iterator[pa.RecordBatch]:
    held = []
    for row in rows:
        held.append(row)
        if len(held) == size:
            yield pa.RecordBatch.from_pylist(held, schema)
            held = []
    yield pa.RecordBatch.from_pylist(held, schema)


_COUNTS = "gaps long, blank long, duplicate long, truncated long, illegal long, cost long, audit string, repaired_sha256 string"


def _repaired(rows: list[dict]) -> tuple[dict, list[tuple[str, str, str]]]:
    """Counts and edits of one conversation's rows, and its turns as repaired."""
    seen, faults, turns = set(), [], {r["turn"] for r in rows} - {None}
    for r in rows:
        said = r["role"], r["text"]
        faults.append(DUPLICATE if r["fault"] != BLANK and said in seen else r["fault"])
        seen.add(said)
    initials = [r["role"][:1] for r in rows]
    cost, audit = min(cheapest(initials, faults).values())
    left = list(applied([(r["role"], r["text"]) for r in rows], audit))
    counts = {name: faults.count(k) for name, k in (("blank", BLANK), ("duplicate", DUPLICATE), ("truncated", TRUNCATED))}
    gaps = max(turns) - min(turns) + 1 - len(turns) if turns else 0
    return counts | {"gaps": gaps, "illegal": illegal_pairs(initials), "cost": cost, "audit": audit}, left


def _fields(kind: str) -> pa.Schema:
    types = {"long": pa.int64(), "int": pa.int32(), "string": pa.string()}
    return pa.schema([(n, types[t]) for n, t in (x.split() for x in kind.split(", "))])


def _short(rows: DataFrame, turns: bool) -> DataFrame:
    """Conversations that a task can hold: their counts (or, with turns, their repaired turns), by key."""
    kind = "key string, place long, role string, text string, edit string" if turns else f"key string, {_COUNTS}"

    def of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def made():
            for (key,), group in _groups(batches, "key"):
                counts, left = _repaired([r for r in group if not r["lost"]])
                if turns:
                    yield from ({"key": key, "place": i, "role": role, "text": text, "edit": edit} for i, (edit, role, text) in enumerate(left))
                else:
                    text = "\n".join(f"{role}:{text}" for _, role, text in left)
                    yield counts | {"key": key, "repaired_sha256": hashlib.sha256(text.encode()).hexdigest()}

        return _batched(made(), _fields(kind))

    order = ["key", "turn", "role", "text"]
    return rows.select(*order, "lost", "fault").repartition("key").sortWithinPartitions(*order).mapInArrow(of, kind)


def _faulted(rows: DataFrame, block: int) -> DataFrame:
    """Rows of long conversations with block and place, and fault with duplicates told."""
    placed = numbered(rows.select("key", "turn", "role", "text", "fault", F.left("text", F.lit(32)).alias("head")), ["key"], ["turn", "role", "head", "text"], range_by=["key", "turn", "role", "head"]).drop("head")
    said = F.sha2(F.concat(F.length("role").cast("string"), F.lit(":"), "role", "text"), 256)
    placed = placed.withColumn("said", said).withColumn("block", F.floor(F.col("place") / block))
    first = placed.groupBy("key", "said").agg(F.min("place").alias("first"), F.count("*").alias("n")).where("n > 1").drop("n")
    fault = F.when((F.col("fault") != BLANK) & (F.col("place") > F.col("first")), DUPLICATE).otherwise(F.col("fault"))
    return materialise(placed.join(first, ["key", "said"], "left").select("key", "block", "place", "turn", "role", "text", fault.alias("fault")), "long-turns")


def _block_edits(rows: DataFrame) -> DataFrame:
    """key, block, the best edits (start, end, cost, audit) of each pair of states; first, last and illegal of its initials."""
    schema = pa.schema([("key", pa.string()), ("block", pa.int64()), ("first", pa.string()), ("last", pa.string()), ("illegal", pa.int64()), ("start", pa.int32()), ("end", pa.int32()), ("cost", pa.int64()), ("audit", pa.string())])

    def of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def made():
            for (key, block), group in _groups(batches, "key", "block"):
                own = list(group)
                initials, faults = [r["initial"] for r in own], [r["fault"] for r in own]
                facts = {"key": key, "block": block, "first": initials[0], "last": initials[-1], "illegal": illegal_pairs(initials)}
                for start in range(4):
                    for end, (cost, audit) in cheapest(initials, faults, start, range(4), every=True).items():
                        yield facts | {"start": start, "end": end, "cost": cost, "audit": audit}

        return _batched(made(), schema)

    order = ["key", "block", "place"]
    light = rows.select(*order, F.left("role", F.lit(1)).alias("initial"), "fault")
    return light.repartition("key", "block").sortWithinPartitions(*order).mapInArrow(of, "key string, block long, first string, last string, illegal long, start int, end int, cost long, audit string")


def _chained(blocks: DataFrame) -> DataFrame:
    """key, block, start, audit, cost, illegal of the edits chosen in each block. Of the best ways to each state, what they
    have in common is settled and leaves memory."""

    def chain(key: str, group: Iterator[dict]) -> Iterator[dict]:
        ways, last = {START: (0, "", [])}, None  # by state: cost, audit and steps since what all have in common
        for _, rows in groupby(group, key=itemgetter("block")):
            after = {}
            for r in rows:
                if r["start"] in ways:
                    cost, audit, steps = ways[r["start"]]
                    option = cost + r["cost"], audit + r["audit"]
                    if r["end"] not in after or option < after[r["end"]][:2]:
                        after[r["end"]] = *option, [*steps, r]
            illegal = r["illegal"] + (last is not None and last + r["first"] not in LEGAL)
            last = r["last"]
            for _, _, steps in after.values():
                steps[-1] = steps[-1] | {"illegal": illegal}
            ways = after
            while all(len(w[2]) > 1 for w in ways.values()) and len({(w[2][0]["start"], w[2][0]["end"]) for w in ways.values()}) == 1:
                done = next(iter(ways.values()))[2][0]
                yield done
                ways = {s: (cost - done["cost"], audit[len(done["audit"]) :], steps[1:]) for s, (cost, audit, steps) in ways.items()}
        yield from min((ways[s] for s in ENDS if s in ways), key=lambda w: w[:2])[2]

    def of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        schema = pa.schema([("key", pa.string()), ("block", pa.int64()), ("start", pa.int32()), ("audit", pa.string()), ("cost", pa.int64()), ("illegal", pa.int64())])
        made = ({f: r[f] for f in schema.names} for (key,), group in _groups(batches, "key") for r in chain(key, group))
        return _batched(made, schema)

    return blocks.repartition("key").sortWithinPartitions("key", "block").mapInArrow(of, "key string, block long, start int, audit string, cost long, illegal long")


def _long_turns(rows: DataFrame, edits: DataFrame) -> DataFrame:
    """key, block, place (in its block), role, text, edit of the repaired turns of long conversations."""
    kind = "key string, block long, place long, role string, text string, edit string"

    def of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def made():
            for (key, block), group in _groups(batches, "key", "block"):
                own = list(group)
                for i, (edit, role, text) in enumerate(applied([(r["role"], r["text"]) for r in own], own[0]["audit"], own[0]["start"])):
                    yield {"key": key, "block": block, "place": i, "role": role, "text": text, "edit": edit}

        return _batched(made(), _fields(kind))

    order = ["key", "block", "place"]
    both = rows.select(*order, "role", "text").join(edits.select("key", "block", "start", "audit"), ["key", "block"])
    return both.repartition("key", "block").sortWithinPartitions(*order).mapInArrow(of, kind)


def _hashed(turns: DataFrame) -> DataFrame:
    """key, repaired_sha256: one chain over each conversation's turns in order."""

    def of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def made():
            for (key,), group in _groups(batches, "key"):
                h, between = hashlib.sha256(), ""
                for r in group:
                    h.update(f"{between}{r['role']}:{r['text']}".encode())
                    between = "\n"
                yield {"key": key, "repaired_sha256": h.hexdigest()}

        return _batched(made(), _fields("key string, repaired_sha256 string"))

    order = ["key", "block", "place"]
    return turns.select(*order, "role", "text").repartition("key").sortWithinPartitions(*order).mapInArrow(of, "key string, repaired_sha256 string")


def _long(rows: DataFrame, keys: DataFrame, block: int) -> tuple[DataFrame, DataFrame]:
    """Counts of the long conversations, and their repaired turns."""
    placed = _faulted(rows.where("not lost"), block)
    edits = materialise(_chained(_block_edits(placed)), "long-edits")
    turns = _long_turns(placed, edits)
    fault = lambda k, name: F.count_if(F.col("fault") == k).alias(name)
    gaps = F.coalesce(F.max("turn") - F.min("turn") + 1 - F.count_distinct("turn"), F.lit(0)).alias("gaps")
    counts = placed.groupBy("key").agg(gaps, fault(BLANK, "blank"), fault(DUPLICATE, "duplicate"), fault(TRUNCATED, "truncated"))
    audit = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("block", "audit"))), lambda x: x["audit"]), "").alias("audit")
    whole = edits.groupBy("key").agg(F.sum("illegal").alias("illegal"), F.sum("cost").alias("cost"), audit)
    out = keys.join(counts, "key", "left").join(whole, "key", "left").join(_hashed(turns), "key", "left")
    none = hashlib.sha256().hexdigest()
    given = {"repaired_sha256": none, "audit": ""}
    return out.select("key", *(F.coalesce(x, F.lit(given.get(x, 0))).cast(kind).alias(x) for x, kind in (f.split() for f in _COUNTS.split(", ")))), turns


def _split(conversations: DataFrame, lost: str | None, block: int) -> tuple[DataFrame, DataFrame, DataFrame | None]:
    """Rows of conversations that one task can hold, the other rows, and the keys of these (none: null)."""
    rows = _rows(conversations, lost)
    keys = materialise(rows.groupBy("key").agg(F.count("*").alias("n")).where(F.col("n") > block).select("key"), "long-keys")
    if keys.isEmpty():
        return rows, rows, None
    return rows.join(keys, "key", "left_anti"), rows.join(keys, "key", "left_semi"), keys


def _ids(conversations: DataFrame, out: DataFrame, *columns: str) -> DataFrame:
    kind = conversations.schema["conv_id"].dataType
    return out.select(F.when(F.col("key") != "", F.substring("key", 2, 1 << 30)).cast(kind).alias("conv_id"), *columns)


def repair_conversations(conversations: DataFrame, lost: str | None = None, block: int | None = None) -> DataFrame:
    """conv_id, gaps, blank, duplicate, truncated, illegal, cost, audit, repaired_sha256 of every conversation. lost: a boolean
    column of rows that are gone; they count for none of these but keep their conv_id."""
    block = block or BLOCK
    rest, long, keys = _split(conversations, lost, block)
    out = _short(rest, turns=False)
    if keys is not None:
        out = out.unionByName(_long(long, keys, block)[0])
    return _ids(conversations, out, *(f.split()[0] for f in _COUNTS.split(", ")))


def repaired_turns(conversations: DataFrame, lost: str | None = None, block: int | None = None) -> DataFrame:
    """conv_id, block, place, role, text, edit: the turns themselves, in the order of (block, place)."""
    block = block or BLOCK
    rest, long, keys = _split(conversations, lost, block)
    out = _short(rest, turns=True).withColumn("block", F.lit(0).cast("long"))
    if keys is not None:
        out = out.unionByName(_long(long, keys, block)[1])
    return _ids(conversations, out, "block", "place", "role", "text", "edit")
