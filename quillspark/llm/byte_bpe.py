"""Byte-level BPE: exact encoding by backtracking from longest matches, and decoding.

Bytes are mapped to Latin-1, so an Aho-Corasick automaton over the vocabulary finds the tokens that
start at each byte. Encoding goes left to right, longest token first, and keeps a token only if it
is compatible with the one before: two tokens are compatible if merging their bytes by rank gives
those same two tokens, which is memoised; as ranks follow the order of merges, it takes only the
parts that stand at the seam while each of the two is merged. A sequence of pairwise compatible tokens is the one that
the merges give, and each byte is given up once at most, so the work is linear in the text. Where
the longest matches one after another are compatible as they are, there is nothing to give up.

Defined results: a null or empty text has no tokens; null doc_ids are kept as null; repeated rows
get equal results; an empty table gives an empty result; columns other than doc_id and text are
ignored. Texts are encoded whole.
"""

from __future__ import annotations

import base64
import hashlib
import re
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame

from .common import texts

#: Entries of each cache of a worker; a cache keeps as many older ones.
CACHE = 300_000
#: Above all ranks.
NEVER = 1 << 40


class Memo(dict):
    """The values of a function by its argument. Full, it starts anew and looks in what it held before first."""

    def __init__(self, of: Callable):
        super().__init__()
        self.of = of
        self.older: dict = {}

    def __missing__(self, key):
        found = self.older.get(key)
        if found is None:
            found = self.of(key)
        if len(self) >= CACHE:
            self.older = dict(self)
            self.clear()
        self[key] = found
        return found


class ByteBpe:
    def __init__(self, ranks: dict[bytes, int], pattern: str):
        import ahocorasick
        import regex

        self.ranks = ranks
        self.token = {r: t for t, r in ranks.items()}
        self.ids = {t: r.to_bytes(4, "little") for t, r in ranks.items()}
        self.find = regex.compile(pattern).findall
        # White space that a space follows, or at an end: then pieces can't be cut at single spaces.
        self.uneven = regex.compile(r"\s |\A | \Z").search
        # A space and letters are one match.
        self.plain = re.compile(" ?[A-Za-z]+").fullmatch
        self.cut = regex.compile(r"(?<=\S)(?=\s)", regex.V1).split
        self.tokens = ahocorasick.Automaton()
        for t in ranks:
            self.tokens.add_word(t.decode("latin-1"), t)
        self.tokens.make_automaton()
        self.widest = max(map(len, ranks))
        self.shorter = Memo(self.prefix)
        self.edges = Memo(self.edge_parts)
        self.compatible = Memo(self.fit)
        self.units = Memo(self.unit)
        self.spaced = Memo(lambda text: self.unit(" " + text))

    def edge_parts(self, token: bytes) -> tuple[list, list]:
        """The parts at the left and at the right end of a token while its bytes are merged by rank, one after another,
        each with the rank of the merge that ends it; nothing for a token that the merges don't give."""
        parts = [bytes([b]) for b in token]
        left, right = [], []
        while len(parts) > 1:
            rank, i = min((self.ranks.get(a + b, NEVER), i) for i, (a, b) in enumerate(zip(parts, parts[1:])))
            if rank == NEVER:
                return [], []
            if i == 0:
                left.append((rank, parts[0]))
            if i == len(parts) - 2:
                right.append((rank, parts[-1]))
            parts[i : i + 2] = [parts[i] + parts[i + 1]]
        return [*left, (NEVER, token)], [*right, (NEVER, token)]

    def fit(self, pair: tuple[bytes, bytes]) -> bool:
        """Whether no merge crosses from one token into the other: at the same rank, the merge further left comes first."""
        before, after = iter(self.edges[pair[0]][1]), iter(self.edges[pair[1]][0])
        end, a = next(before, (-1, b""))
        stop, b = next(after, (-1, b""))
        if min(end, stop) < 0:
            return False
        while True:
            rank = self.ranks.get(a + b, NEVER)
            if rank < end and rank <= stop and rank < NEVER:
                return False
            if end == stop == NEVER:
                return True
            if end <= stop:
                end, a = next(before)
            else:
                stop, b = next(after)

    def prefix(self, token: bytes) -> bytes:
        """The longest token that token starts with, itself left out; empty for none."""
        return next((token[:n] for n in range(len(token) - 1, 0, -1) if token[:n] in self.ranks), b"")

    def encode_piece(self, piece: bytes) -> list[bytes]:
        """Tokens of one match of the pattern."""
        if piece in self.ranks:
            return [piece]
        text, compatible = piece.decode("latin-1"), self.compatible
        out = [t for _, t in self.tokens.iter_long(text)]
        for pair in zip(out, out[1:]):
            if not compatible[pair]:
                return self.backtrack(piece, text)
        return out if b"".join(out) == piece else self.backtrack(piece, text)

    def backtrack(self, piece: bytes, text: str) -> list[bytes]:
        ranks, compatible, shorter, reach, widest = self.ranks, self.compatible, self.shorter, self.tokens.longest_prefix, self.widest
        n, at, token, last = len(piece), 0, b"", b""
        dead = bytearray(n + 1)  # places from which no compatible way leads on
        out: list[bytes] = []
        fresh = True
        while at < n:
            if fresh:  # the longest match here
                token = piece[at : at + reach(text[at : at + widest])]
                if token not in ranks:
                    token = shorter[token]
            while token and (dead[at + len(token)] or last and not compatible[last, token]):
                token = shorter[token]
            fresh = bool(token)
            if fresh:
                out.append(token)
                at += len(token)
                last = token
            else:
                if not out:
                    raise ValueError("the vocabulary lacks single bytes")
                dead[at] = 1
                token = out.pop()
                at -= len(token)
                last = out[-1] if out else b""
                token = shorter[token]
        return out

    def unit(self, text: str) -> bytes:
        """Ids of a stretch of text that no match of the pattern crosses, as little-endian 32-bit integers."""
        ids = self.ids
        pieces = [text] if self.plain(text) else self.find(text)
        return b"".join([ids[t] for p in pieces for t in self.encode_piece(p.encode())])

    def known(self, text: str) -> bytes:
        """As unit; short ones are memoised."""
        return self.units[text] if len(text) <= 64 else self.unit(text)

    def encode(self, text: str) -> bytes:
        """Ids of a text as little-endian 32-bit integers. No match goes from other characters on into white space, so
        texts are cut there and units are memoised."""
        if not text:
            return b""
        if self.uneven(text):
            return b"".join(map(self.known, self.cut(text)))
        first, *rest = text.split(" ")
        spaced = self.spaced
        return self.known(first) + b"".join([spaced[x] if len(x) < 64 else self.unit(" " + x) for x in rest])

    def decode(self, ids: bytes) -> bytes:
        return b"".join(map(self.token.__getitem__, np.frombuffer(ids, "<u4").tolist()))


_LOADED: dict[tuple[str, str], ByteBpe] = {}


def load(path: str, pattern: str) -> ByteBpe:
    """The encoder of a rank file, once for each worker."""
    if (path, pattern) not in _LOADED:
        with open(path, "rb") as f:
            ranks = {base64.b64decode(t): int(r) for t, r in map(bytes.split, f)}
        _LOADED[path, pattern] = ByteBpe(ranks, pattern)
    return _LOADED[path, pattern]


def encode_decode(docs: DataFrame, path: str, pattern: str) -> DataFrame:
    """doc_id, ids (little-endian unsigned 32-bit integers) and decoded, as binary columns."""
    d = texts(docs)

    def of(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        bpe = load(path, pattern)
        for b in frames:
            ids = [bpe.encode(t) for t in b["text"]]
            yield pd.DataFrame({"doc_id": b["doc_id"], "ids": ids, "decoded": [bpe.decode(x) for x in ids]})

    kind = d.schema["doc_id"].dataType.simpleString()
    return d.mapInPandas(of, f"doc_id {kind}, ids binary, decoded binary")


def byte_bpe(docs: DataFrame, path: str, pattern: str) -> DataFrame:
    """doc_id, n_tokens, ids_sha256, decoded_sha256."""
    d = texts(docs)

    def of(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        bpe = load(path, pattern)
        for b in frames:
            out = []
            for t in b["text"]:
                ids = bpe.encode(t)
                out.append((len(ids) // 4, hashlib.sha256(ids).hexdigest(), hashlib.sha256(bpe.decode(ids)).hexdigest()))
            yield pd.concat([b[["doc_id"]].reset_index(drop=True), pd.DataFrame(out, columns=["n_tokens", "ids_sha256", "decoded_sha256"])], axis=1)

    kind = d.schema["doc_id"].dataType.simpleString()
    return d.mapInPandas(of, f"doc_id {kind}, n_tokens long, ids_sha256 string, decoded_sha256 string")
