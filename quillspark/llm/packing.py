"""Best-fit packing of tokenised documents into sequences, by bin completion with branch and bound.

Documents are cut only where they are longer than a sequence; full pieces stand alone. The rest is
dealt into buckets of bounded size (by a hash of the document, so that no length or source makes a
bucket large), and each bucket is packed for itself: best-fit decreasing gives the incumbent, and
where it uses more sequences than the waste bound needs, bin completion looks for better fillings
around the largest document left.

Defined results: a null or empty text is one piece holding the end token alone; null doc_ids are
kept as null; repeated rows are packed each for itself; an empty table gives an empty result;
columns other than doc_id and text are ignored. Texts are tokenised whole.
"""

from __future__ import annotations

import re
import struct
import zlib
from bisect import bisect_left
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import materialise, texts

CAPACITY = 4096
END = 1
#: Pieces in a bucket, about; steps that a bucket's search may take, and bins it starts with; entries of the word cache.
BUCKET = 20_000
STEPS = 200_000
REGION = 24
CACHE = 1_000_000
#: Marks that follow a word (an apostrophe may begin a contraction, so it is none).
MARKS = b".,!?;:*#$%&|<>()"


#: Words of letters that the vocabulary only lower-cases and spells as bytes, each byte as the character that stands for it.
PLAIN = re.compile("[a-z\xc0-\xd6\xd8-\xf6\xf8-\xff]+")
_SHOWN = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
_BYTES = {b: chr(b) for b in _SHOWN} | {b: chr(0x100 + i) for i, b in enumerate(x for x in range(0x100) if x not in _SHOWN)}
_SPELLED = {c: "".join(_BYTES[b] for b in chr(c).encode()) for c in range(0xDF, 0x100)}


class _Ids:
    """Little-endian 32-bit ids of words. Ids of a text are those of its words, as the vocabulary drops white space."""

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.bytes = [struct.pack("<I", i) for i in range(self.tokenizer.get_vocab_size())]
        self.known: dict[bytes, bytes] = {}

    def _whole(self, words: list[bytes]) -> Iterator[bytes]:
        for e in self.tokenizer.encode_batch_fast([w.decode() for w in words], add_special_tokens=False):
            yield b"".join([self.bytes[i] for i in e.ids])

    def learn(self, words: set[bytes]) -> None:
        """Add words to known. The vocabulary folds case and parts a letter from the marks after it, so a bare word in lower
        case and a run of marks are tokenised each for itself. Plain words go to its merges at once, others by way of its
        patterns; what may be a special token is left as it is."""
        if len(self.known) + len(words) > CACHE:
            self.known.clear()
        known, merged, rest = self.known, self.tokenizer.model.tokenize, []
        for w in words.difference(known):
            folded = w.lower()
            bare = folded.rstrip(MARKS)
            tail = folded[len(bare) :]
            if b"<|" in w:
                rest.append(w)
                continue
            ids = known.get(bare) if not tail or bare[-1:].isalpha() else None
            if ids is None:
                letters = bare.decode()
                if not PLAIN.fullmatch(letters):
                    rest.append(w)
                    continue
                if not bare.isascii():
                    letters = letters.lower().translate(_SPELLED)
                ids = known[bare] = b"".join([self.bytes[t.id] for t in merged(letters)])
            if tail:
                if tail not in known:
                    known[tail] = next(self._whole([tail]))
                ids += known[tail]
            known[w] = ids
        for i in range(0, len(rest), 2000):
            known.update(zip(rest[i : i + 2000], self._whole(rest[i : i + 2000])))


_IDS: dict[str, _Ids] = {}


def token_bytes(texts: list[str], path: str) -> Iterator[bytes]:
    """Ids of each text and the end token, as little-endian unsigned 32-bit integers."""
    if path not in _IDS:
        _IDS[path] = _Ids(path)
    ids, end = _IDS[path], END.to_bytes(4, "little")
    for i in range(0, len(texts), 100):
        split = [t.encode().split() for t in texts[i : i + 100]]
        ids.learn(set().union(*split))
        get = ids.known.__getitem__
        for words in split:
            yield b"".join(map(get, words)) + end


def pieces(docs: DataFrame, tokenizer: str, capacity: int = CAPACITY) -> DataFrame:
    """doc_id, piece, start, length, ids_crc32, and at (a hash that deals pieces into buckets)."""
    d = texts(docs)

    def of(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in frames:
            out = []
            for i, ids in enumerate(token_bytes(b["text"].tolist(), tokenizer)):
                crc = 0
                for k, at in enumerate(range(0, len(ids), 4 * capacity)):
                    part = ids[at : at + 4 * capacity]
                    out.append((i, k, at // 4, len(part) // 4, zlib.crc32(part)))
            rows = pd.DataFrame(out, columns=["row", "piece", "start", "length", "ids_crc32"])
            yield pd.concat([b["doc_id"].iloc[rows["row"]].reset_index(drop=True), rows.drop(columns="row")], axis=1)

    kind = d.schema["doc_id"].dataType.simpleString()
    out = d.mapInPandas(of, f"doc_id {kind}, piece int, start long, length long, ids_crc32 long")
    return out


def lower_bound(lengths: list[int], capacity: int) -> int:
    """Sequences that any packing needs: the volume bound, raised by documents too large to share."""
    counts = np.bincount(lengths, minlength=capacity + 1)
    size = np.arange(capacity + 1)
    total, best = int((counts * size).sum()), 0
    volume, number = np.cumsum(counts * size), np.cumsum(counts)
    for k in {0, *(int(x) for x in np.nonzero(counts)[0] if x <= capacity // 2)}:
        alone = int(number[-1] - number[capacity - k])  # with nothing of k or more beside them
        half = int(number[capacity - k] - number[capacity // 2]) if capacity - k > capacity // 2 else 0
        between = int(volume[capacity - k] - (volume[k - 1] if k else 0))
        room = half * capacity - int(volume[capacity - k] - volume[capacity // 2]) if half else 0
        small = between - int(volume[capacity - k] - volume[capacity // 2]) if half else between
        best = max(best, alone + half + max(0, -(-(small - room) // capacity)))
    return max(best, -(-total // capacity))


def best_fit(lengths: list[int], capacity: int) -> list[list[int]]:
    """Best-fit decreasing: bins of lengths. Bins of equal room stand in one list, so a step looks at rooms, not bins."""
    by_room: list[list[int]] = [[] for _ in range(capacity + 1)]
    filled = 0  # bit r: some bin has room r
    bins: list[list[int]] = []
    for x in sorted(lengths, reverse=True):
        fits = filled >> x
        if fits:
            room = x + (fits & -fits).bit_length() - 1
            k = by_room[room].pop()
            if not by_room[room]:
                filled ^= 1 << room
        else:
            k, room = len(bins), capacity
            bins.append([])
        bins[k].append(x)
        by_room[room - x].append(k)
        filled |= 1 << (room - x)
    return bins


class _Budget:
    """Steps that the search may still take."""

    def __init__(self, steps: int):
        self.left = steps


def fillings(counts: dict[int, int], first: int, capacity: int, most_waste: int, budget: _Budget) -> list[tuple[int, ...]]:
    """Fillings around a document of length first that leave most_waste or less, fullest first, without those that
    another one dominates: one of whose documents could be exchanged for a larger one that fits in the room left over."""
    sizes = sorted((s for s, n in counts.items() if n and s <= capacity - first), reverse=True)
    falling = [-s for s in sizes]
    found: list[tuple[int, tuple[int, ...]]] = []
    used: dict[int, int] = {}
    # What all documents from a size down add up to: without it a filling can't come close enough.
    rest = np.cumsum([s * counts[s] for s in reversed(sizes)])[::-1].tolist()

    def free(most: int, least: int) -> bool:
        """Whether an unused document is at most so long, and longer than least."""
        for s in sizes[bisect_left(falling, -most) :]:
            budget.left -= 1
            if s <= least:
                return False
            if used.get(s, 0) < counts[s]:
                return True
        return False

    def grow(k: int, room: int, chosen: tuple[int, ...]) -> None:
        if budget.left <= 0:
            return
        budget.left -= 1
        if room <= most_waste and not free(room, 0) and not any(free(c + room, c) for c in set(chosen)):
            found.append((room, chosen))
        for j in range(max(k, bisect_left(falling, -room)), len(sizes)):
            s = sizes[j]
            if room - rest[j] > most_waste or budget.left <= 0:
                return  # all that is left is too small
            budget.left -= 1
            if used.get(s, 0) < counts[s]:
                used[s] = used.get(s, 0) + 1
                grow(j, room - s, (*chosen, s))
                used[s] -= 1

    grow(0, capacity - first, ())
    return [c for _, c in sorted(found, key=lambda x: (x[0], len(x[1])))]


def complete(lengths: list[int], capacity: int, budget: _Budget) -> list[list[int]] | None:
    """Bins of lengths, one fewer than best-fit decreasing needs; None if there are none or the budget ends first.

    Documents under a 256th of the capacity are left to the end, where they go into the rooms left over.
    """
    incumbent = len(best_fit(lengths, capacity))
    dust = sorted((x for x in lengths if x <= capacity // 256), reverse=True)
    counts: dict[int, int] = {}
    for x in lengths:
        if x > capacity // 256:
            counts[x] = counts.get(x, 0) + 1
    left = len(lengths) - len(dust)
    order = sorted(counts, reverse=True)
    branches: list[tuple[int, Iterator[tuple[int, ...]], int, int]] = []  # largest document, fillings to try, waste left, its place in order
    chosen: list[tuple[int, ...]] = []

    def branch(waste: int, k: int) -> None:
        while not counts[order[k]]:
            k += 1
        budget.left -= 1 + len(order) // 64
        counts[order[k]] -= 1
        branches.append((order[k], iter(fillings(counts, order[k], capacity, waste, budget)), waste, k))

    def take_back() -> int:
        for x in chosen[-1]:
            counts[x] += 1
        return 1 + len(chosen.pop())

    if left:
        branch((incumbent - 1) * capacity - sum(lengths) + sum(dust), 0)
    while left:
        if not branches:
            return None
        largest, untried, waste, k = branches[-1]
        if len(chosen) == len(branches):
            left += take_back()
        filling = next(untried, None) if budget.left > 0 else None
        if filling is None:
            counts[largest] += 1
            branches.pop()
            continue
        for x in filling:
            counts[x] -= 1
        chosen.append(filling)
        left -= 1 + len(filling)
        if left:
            branch(waste - (capacity - largest - sum(filling)), k)
    bins = [[b[0], *c] for b, c in zip(branches, chosen)]
    for x in dust:
        if not bins or sum(bins[-1]) + x > capacity:
            bins.sort(key=sum, reverse=True)
        if not bins or sum(bins[-1]) + x > capacity:
            bins.append([])
        bins[-1].append(x)
    return bins if len(bins) < incumbent else None


def fill(lengths: list[int], capacity: int = CAPACITY, steps: int = STEPS, region: int = REGION) -> list[list[int]]:
    """Bins of lengths: best-fit decreasing is the incumbent. While it is above the lower bound, the emptiest bins, at first
    region of them, are packed anew by bin completion into one bin fewer; where that fails, twice as many bins are, up to
    all of them. A search may take a quarter of steps; what it took is charged, and the incumbent stands once none are left."""
    bins = best_fit(lengths, capacity)
    least = lower_bound(lengths, capacity) if lengths else 0
    left, size = steps, region
    while len(bins) > least and left > 0:
        bins.sort(key=lambda b: (-sum(b), b))
        loose = [x for b in bins[-size:] for x in b]
        budget = _Budget(min(left, -(-steps // 4)))
        left -= budget.left
        better = complete(loose, capacity, budget)
        left += max(0, budget.left)
        if better is not None and len(better) < min(size, len(bins)):
            bins[-size:] = better
        elif size >= len(bins):
            break
        else:
            size *= 2
    return bins


def pack(docs: DataFrame, tokenizer: str, capacity: int = CAPACITY, bucket: int = BUCKET, steps: int = STEPS) -> DataFrame:
    """doc_id, piece, start, length, ids_crc32, sequence_id, offset."""
    cut = materialise(pieces(docs, tokenizer, capacity), "pieces")
    buckets = -(-cut.count() // bucket) or 1
    # Pieces that are equal in all columns may share a bucket; that leaves buckets bounded but for rows repeated in great number.
    at = F.pmod(F.xxhash64("doc_id", "piece", "ids_crc32", F.monotonically_increasing_id()), F.lit(buckets)).cast("int")
    dealt = materialise(cut.withColumn("bucket", at), "buckets").repartition(buckets, "bucket")

    def of(rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values(["length", "doc_id", "piece"], ascending=[False, True, True], kind="stable").reset_index(drop=True)
        places: dict[int, list[int]] = {}
        for i, x in zip(range(len(rows) - 1, -1, -1), rows["length"].tolist()[::-1]):
            places.setdefault(x, []).append(i)
        full = rows["length"].eq(capacity)
        bins = [[capacity]] * int(full.sum()) + fill(rows.loc[~full, "length"].tolist(), capacity, steps)
        sequence, offset = np.zeros(len(rows), np.int64), np.zeros(len(rows), np.int64)
        for k, bin_ in enumerate(bins):
            used = 0
            for x in bin_:
                i = places[x].pop()
                sequence[i], offset[i] = k, used
                used += x
        rows["sequence_id"] = rows["bucket"].astype(np.int64) * (1 << 32) + sequence
        rows["offset"] = offset
        return rows.drop(columns="bucket")

    kind = dealt.schema["doc_id"].dataType.simpleString()
    return dealt.groupBy("bucket").applyInPandas(of, f"doc_id {kind}, piece int, start long, length long, ids_crc32 long, sequence_id long, offset long")
