"""Spelling variants, conversation repair and line dedup against plain versions, and on nulls, repeats, ties and empty tables."""

import collections
import hashlib
import itertools
import random
import re
import zlib

import pytest

from quillspark.llm import conversations, line_dedup, spelling

BLANKS = " \t\n\x0b\f\r"


def _lower(s):
    return "".join(c.lower() if c < "\x7f" else c for c in s)


@pytest.fixture(scope="module")
def typed(spark):
    """Documents of words from two letters, so that very many are near to each other, and of longer ones; repeated rows."""
    r = random.Random(3)
    base = ["".join(r.choice("ab") for _ in range(7)) for _ in range(30)] + ["".join(r.choice("abcÉé") for _ in range(r.randint(6, 12))) for _ in range(120)]

    def word():
        w = r.choice(base[: 1 + int(150 * r.random() ** 2)])
        for _ in range(r.choice([0, 0, 0, 1, 1, 2])):
            i, c = r.randrange(len(w)), r.choice("abÿZ")
            w = r.choice([w[:i] + w[i + 1 :], w[:i] + c + w[i:], w[:i] + c + w[i + 1 :]])
        return w

    rows = [(d or None, " ".join(word() for _ in range(200)), "x", 1) for d in range(40)]
    rows += [(50, None, "x", 1), (51, "", "x", 1), rows[3], (52, "a" * 20_000 + " " + "a" * 20_000 + "1" + "a" * 19_999, "x", 1)]
    return rows, spark.createDataFrame(rows, "doc_id long, text string, word string, n int")


def _plain_variants(rows):
    n = collections.Counter()
    for d, text, *_ in rows:
        for w in map(_lower, re.findall("[A-Za-zÀ-ÿ]+", text or "")):
            h = zlib.crc32(f"{'' if d is None else d}:{w}".encode())
            n[w[: h % len(w)] + w[h % len(w) + 1 :] if h % 31 == 0 else w] += 1
    known = {w: c for w, c in n.items() if len(w) >= 7 and c >= 2}

    def near(a, b):
        a, b = sorted((a, b), key=len)
        if len(a) == len(b):
            return sum(x != y for x, y in zip(a, b)) == 1
        return len(b) == len(a) + 1 and any(b[:i] + b[i + 1 :] == a for i in range(len(b)) if a[:i] == b[:i])

    by = {w: [] for w in known}
    for a, b in itertools.combinations(known, 2):
        if abs(len(a) - len(b)) < 2 and near(a, b):
            by[a].append(b)
            by[b].append(a)
    best = {w: min(x, key=lambda v: (-known[v], v)) for w, x in by.items() if x}
    form = {w: v for w, v in best.items() if known[v] >= 10 * known[w]}

    def root(w):
        return root(form[w]) if w in form else w

    return {w: (form.get(w), root(w), c, len(by[w]), known.get(form.get(w))) for w, c in known.items()}


@pytest.mark.parametrize("crowd", [2, 16])
def test_spelling_variants(typed, crowd):
    """Blocks of over two words are halved down to single places, or not."""
    rows, df = typed
    want = _plain_variants(rows)
    assert sum(f is not None for f, *_ in want.values()) > 30 and max(x[3] for x in want.values()) > 30
    got = spelling.spelling_variants(spelling.typed_words(df), crowd=crowd).collect()
    assert {r["word"]: tuple(r)[1:] for r in got} == want and len(got) == len(want)


def test_spelling_chain_ties_and_empty(spark):
    kind = "word string, n long"
    words = [("abcdefg", 10_000), ("abcdefx", 1000), ("abcdeyx", 100), ("abczeyx", 10), ("bbbbbbbb", 4), ("bbbbbbb", 40), ("bbbbbbbc", 40), ("ccccccc", 1), (None, 5)]
    got = {r["word"]: tuple(r)[1:] for r in spelling.spelling_variants(spark.createDataFrame([*words, ("ccccccc", 1)], kind)).collect()}
    assert got["abczeyx"] == ("abcdeyx", "abcdefg", 10, 1, 100) and got["abcdefx"][:2] == ("abcdefg", "abcdefg")
    assert got["bbbbbbbb"] == ("bbbbbbb", "bbbbbbb", 4, 2, 40) and got["ccccccc"] == (None, "ccccccc", 2, 0, None) and len(got) == 8
    assert spelling.spelling_variants(spark.createDataFrame([], kind)).count() == 0


@pytest.fixture(scope="module")
def talks(spark):
    r = random.Random(3)
    rows = []
    for c in [None, *range(50)]:
        for i in range(r.choice([1, 2, 3, 5, 9, 30]) if c != 7 else 300):
            role = r.choice(["user", "assistant", "user", "assistant", "system", "tool", None, ""])
            text = r.choice(["Hi.", "yes", "what?", "", " \n", None, "Ok! ", "Fine.x", *(f"t{r.randint(0, 90)}." for _ in range(4))])
            rows.append((c, r.choice([i, i, i, i + 1, None]) if c != 9 else None, role, text, "x"))
    return rows, spark.createDataFrame(rows, "conv_id long, turn long, role string, text string, audit string")


def _damage(rows):
    for c, t, role, text, _ in rows:
        given = lambda x: " " if x is None else x
        k = zlib.crc32(f"{given(c)}:{given(t)}".encode()) % 20
        text = "" if k == 1 else re.sub("[.!?]", "", given(text)) if k == 2 else given(text)
        yield from [(c, t, "user" if k == 4 else given(role), text)] * (0 if k == 0 else 2 if k == 3 else 1)


def _plain_repair(rows):
    """All ways over the lattice, row by row, the best to each state kept."""
    out = {}
    for conv in {x[0] for x in rows}:
        own = sorted((x[1:] for x in _damage(rows) if x[0] == conv), key=lambda x: (x[0] is not None, x[0] or 0, x[1], x[2]))
        faults, seen = [], set()
        for _, *said in own:
            bare = said[1].strip(BLANKS)
            faults.append("b" if not bare else "d" if tuple(said) in seen else "t" if bare[-1] not in ".!?" else "")
            seen.add(tuple(said))
        after = {("", "s"): "s", ("", "u"): "u", ("s", "u"): "u", ("u", "a"): "a", ("a", "u"): "u"}
        needs = {"": "user", "s": "user", "u": "assistant", "a": "user"}

        def inserted(best):
            for _ in range(3):
                for s, (cost, audit, left) in list(best.items()):
                    to, way = needs[s][0], (cost + 2, audit + "I", (*left, needs[s] + ":"))
                    best[to] = min(best.get(to, way), way)
            return best

        best = inserted({"": (0, "", ())})
        for (_, role, text), fault in zip(own, faults):
            ways = collections.defaultdict(list)
            for s, (cost, audit, left) in best.items():
                ways[s].append((cost + 3, audit + "D", left))
                if fault not in ("b", "d"):
                    ways[needs[s][0]].append((cost + 2 + (fault == "t"), audit + "R", (*left, f"{needs[s]}:{text}")))
                    if (s, role[:1]) in after:
                        ways[after[s, role[:1]]].append((cost + (fault == "t"), audit + "K", (*left, f"{role}:{text}")))
            best = inserted({s: min(x) for s, x in ways.items()})
        cost, audit, left = min(best[s] for s in ("", "a") if s in best)
        turns, first = {x[0] for x in own} - {None}, [x[1][:1] for x in own]
        pairs = sum(a + b not in ("su", "ua", "au") for a, b in zip(first, first[1:]))
        out[conv] = (max(turns) - min(turns) + 1 - len(turns) if turns else 0, faults.count("b"), faults.count("d"), faults.count("t"), pairs, cost, audit, hashlib.sha256("\n".join(left).encode()).hexdigest())
    return out


@pytest.mark.parametrize("block", [256, 20, 1])
def test_conversation_repair(talks, block):
    """In blocks of 256 rows one conversation is long, in blocks of one nearly all are."""
    rows, df = talks
    got = conversations.repair_conversations(conversations.damaged(df), "lost", block).collect()
    want = _plain_repair(rows)
    assert {r["conv_id"]: tuple(r)[1:] for r in got} == want and len(got) == len(want)


def test_repaired_turns(spark, talks):
    said = [(1, 0, "system", "A."), (1, 1, "user", "B?"), (1, 2, "user", "C"), (1, 3, "assistant", "D."), (2, 0, "tool", " ")]
    df = spark.createDataFrame(said, "conv_id long, turn long, role string, text string")
    for block in (256, 2):
        got = sorted(tuple(r) for r in conversations.repaired_turns(df, block=block).drop("block", "place").collect())
        assert got == [(1, "assistant", "D.", "K"), (1, "system", "A.", "K"), (1, "user", "B?", "K")]
        one = {r["conv_id"]: (r["cost"], r["audit"]) for r in conversations.repair_conversations(df, block=block).collect()}
        assert one == {1: (3, "KKDK"), 2: (3, "D")}
    hashes = {r["conv_id"]: r["repaired_sha256"] for r in conversations.repair_conversations(df).collect()}
    assert hashes[1] == hashlib.sha256(b"system:A.\nuser:B?\nassistant:D.").hexdigest()
    assert conversations.repair_conversations(df.limit(0)).count() == 0
    lost = df.selectExpr("*", "true AS gone")
    assert {tuple(r)[1:8] for r in conversations.repair_conversations(lost, "gone").collect()} == {(0, 0, 0, 0, 0, 0, "")}


def test_cheapest_is_first_in_ascii():
    r = random.Random(1)
    for _ in range(200):
        n = r.randint(0, 6)
        initials, faults = [r.choice("suax") for _ in range(n)], [r.choice([0, 0, 0, 1, 2, 3]) for _ in range(n)]
        (cost, audit), = conversations.cheapest(initials, faults).values()
        options = []
        for size in range(n, n + 5):
            for edits in itertools.product("DIKR", repeat=size):
                if size - edits.count("I") != n:
                    continue
                i = total = 0
                state, fits = conversations.START, True
                for e in edits:
                    total += {"D": 3, "I": 2, "K": 0, "R": 2}[e]
                    if e in "KR":
                        fits &= faults[i] not in (1, 2)
                        total += faults[i] == 3
                    state = conversations.KEEP.get((state, initials[i])) if e == "K" else conversations.TURN[state][0] if e in "IR" else state
                    i += e != "I"
                    if state is None or not fits:
                        fits = False
                        break
                if fits and state in conversations.ENDS:
                    options.append((total, "".join(edits)))
        assert (cost, audit) == min(options)
        if n > 4:
            break


def _plain_lines(rows, at_least=2, shortest=10):
    holders = collections.defaultdict(set)
    key = lambda x: _lower(x.strip(BLANKS))
    for d, text, *_ in rows:
        for line in (text or "").split("\n"):
            holders[key(line)].add(d)
    first = {k: min(x - {None}) for k, x in holders.items() if len(k) >= shortest and len(x) >= at_least and x - {None}}
    out = []
    for d, text, *_ in rows:
        lines = (text or "").split("\n")
        left = [x for x in lines if key(x) not in first or d == first[key(x)]]
        out.append((d, len(lines), len(lines) - len(left), hashlib.sha256("\n".join(left).encode()).hexdigest()))
    return collections.Counter(out)


@pytest.fixture(scope="module")
def lined(spark):
    r = random.Random(8)
    pool = [f"  Line number {i} of the Pool\t" if i % 2 else f"LINE number {i} of the pool\r" for i in range(30)] + ["", "short", " Öffentliche ZEILE ", "ÖFFENTLICHE Zeile"]
    rows = [(d if d else None, "\n".join(r.choice([*pool, f"own {d} {i} abcdef"]) for i in range(r.randint(0, 12))), "x", 3) for d in range(80)]
    rows += [(100, None, "x", 3), (101, "", "x", 3), rows[5], rows[5], (rows[6][0], "another text\n" + pool[1], "x", 3), (102, "only here twice\nonly here twice", "x", 3), (102, "only here twice\nonly here twice", "x", 3), (None, "without an id\nLine number 1 of the pool", "x", 3)]
    rows += [(200, "\n".join(f"a line that stands in two documents {i}" for i in range(20_000)), "x", 3), (201, "\n".join(f"A LINE that stands in two documents {i}" for i in range(0, 40_000, 2)), "x", 3)]
    return rows, spark.createDataFrame(rows, "doc_id long, text string, kept string, n_lines int")


@pytest.mark.parametrize("at_least", [2, 5])
def test_line_dedup(lined, at_least):
    rows, df = lined
    got = line_dedup.dedup_lines(df, at_least)
    hashed = [(r["doc_id"], r["n_lines"], r["n_dropped"], hashlib.sha256(r["kept"].encode()).hexdigest()) for r in got.collect()]
    assert collections.Counter(hashed) == _plain_lines(rows, at_least)
    if at_least == 2:
        assert collections.Counter(tuple(r) for r in line_dedup.line_dedup(df).collect()) == _plain_lines(rows)


def test_line_dedup_keeps_columns(lined):
    rows, df = lined
    out = line_dedup.drop_repeated_lines(df)
    assert out.dtypes == df.dtypes and out.count() == len(rows)
    lines = sum((r["text"] or "").count("\n") + 1 for r in out.collect() if r["text"] != "")
    assert lines < sum((t or "").count("\n") + 1 for _, t, *_ in rows) and out.where("text is null").count() == 1
    assert line_dedup.line_dedup(df.limit(0)).count() == 0
