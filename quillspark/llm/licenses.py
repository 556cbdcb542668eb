"""License scans by template markup: optional and replaceable regions compiled into token automata.

A template is license wording with SPDX-style markup, <<beginOptional>>...<<endOptional>> and
<<var;name;most>> (a replaceable region of at most so many words). It is compiled into an automaton
over words; a text is accepted where it holds words that take the automaton from start to end, so
the mandatory wording must match exactly. Labels of phrases (the base) and of templates are kept apart, so a license may have
two: apache-2 (its phrase) and Apache-2.0 (its template) are one, and so are mit and MIT.

Words: A-Z lower-cased, runs of ASCII letters, digits and any non-ASCII characters.

Defined results: a null or empty text has no words and no labels; null doc_ids are kept as null;
repeated rows get equal results; an empty table gives an empty result; columns other than doc_id and
text are ignored. Texts are scanned whole, so a license far inside a long text is found.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass

import pandas as pd
from pyspark.sql import DataFrame

from .common import texts

WORDS = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"

# Phrases of the base and their labels.
PHRASES = {"under the mit license": "mit", "apache license version 2": "apache-2", "cc by nc": "cc-by-nc"}

# Wording of public licenses and of their usual notices, with markup.
TEMPLATES = {
    "MIT": "Permission is hereby granted, free of charge, to any person obtaining a copy of <<var;software;6>> (the \"Software\"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions: The above copyright notice and this permission notice <<beginOptional>>(including the next paragraph)<<endOptional>> shall be included in all copies or substantial portions of the Software.",
    "MIT-notice": "<<beginOptional>>This <<var;work;3>> is<<endOptional>> <<beginOptional>>released<<endOptional>> <<beginOptional>>licensed<<endOptional>> <<beginOptional>>distributed<<endOptional>> under the <<beginOptional>>terms of the<<endOptional>> MIT License",
    "ISC": "Permission to use, copy, modify, and<<beginOptional>>/or<<endOptional>> distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies.",
    "BSD-2-Clause": "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met: <<var;bullet;1>> Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer. <<var;bullet;1>> Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution.",
    "Apache-2.0": "Licensed under the Apache License, Version 2.0 <<beginOptional>>(the \"License\"); you may not use this <<var;file;3>> except in compliance with the License.<<endOptional>>",
    "GPL-3.0": "<<beginOptional>>This <<var;work;3>> is<<endOptional>> licensed under the <<beginOptional>>terms of the<<endOptional>> GNU General Public License, version 3 <<beginOptional>>or <<beginOptional>>(at your option)<<endOptional>> any later version<<endOptional>>",
    "GPL-2.0-or-later": "This <<var;program;4>> is free software; you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation; either version 2 of the License, or (at your option) any later version.",
    "CC-BY-NC-4.0": "<<beginOptional>>This <<var;work;3>> is<<endOptional>> licensed under <<beginOptional>>a<<endOptional>> <<beginOptional>>Creative Commons<<endOptional>> CC BY-NC 4.0",
    "CC-BY-4.0": "<<beginOptional>>This <<var;work;3>> is<<endOptional>> licensed under <<beginOptional>>a<<endOptional>> <<beginOptional>>Creative Commons<<endOptional>> CC BY 4.0",
    "Unlicense": "This is free and unencumbered software released into the public domain.",
}


def words_of(text: str) -> list[str]:
    return re.findall(WORDS, re.sub("[A-Z]+", lambda m: m[0].lower(), text))


@dataclass(frozen=True)
class Parsed:
    """Markup as a list of words, ("optional", Parsed) and ("var", most)."""

    items: tuple


def parse(template: str) -> Parsed:
    stack: list[list] = [[]]
    for part in re.split(r"(<<.*?>>)", template):
        if part == "<<beginOptional>>":
            stack.append([])
        elif part == "<<endOptional>>":
            if len(stack) == 1:
                raise ValueError("an optional region ends that did not begin")
            inner = Parsed(tuple(stack.pop()))
            stack[-1].append(("optional", inner))
        elif part.startswith("<<var;"):
            stack[-1].append(("var", int(part[2:-2].split(";")[2])))
        elif part.startswith("<<"):
            raise ValueError(f"unknown markup {part}")
        else:
            stack[-1] += words_of(part)
    if len(stack) > 1:
        raise ValueError("an optional region does not end")
    return Parsed(tuple(stack[0]))


class Automaton:
    """States with a word arc, arcs for any word, and free arcs; start is 0."""

    def __init__(self, template: str):
        self.word: list[dict[str, int]] = [{}]
        self.any: list[set[int]] = [set()]
        self.free: list[set[int]] = [set()]
        self.end = self._build(parse(template), 0)
        self.start = self._closed({0})
        self.known: dict[tuple[frozenset[int], str | None], frozenset[int]] = {}
        self.alphabet = {w for arcs in self.word for w in arcs}
        if self.end in self.start:
            raise ValueError("a template needs mandatory words")

    def _state(self) -> int:
        self.word.append({})
        self.any.append(set())
        self.free.append(set())
        return len(self.word) - 1

    def _build(self, parsed: Parsed, at: int) -> int:
        for item in parsed.items:
            after = self._state()
            if isinstance(item, str):
                self.word[at][item] = after
            elif item[0] == "optional":
                inside = self._state()
                self.free[at] |= {inside, after}
                self.free[self._build(item[1], inside)].add(after)
            else:
                for _ in range(item[1]):
                    following = self._state()
                    self.free[at].add(after)
                    self.any[at].add(following)
                    at = following
                self.free[at].add(after)
            at = after
        return at

    def _closed(self, states: set[int]) -> frozenset[int]:
        todo, out = list(states), set(states)
        while todo:
            for x in self.free[todo.pop()] - out:
                out.add(x)
                todo.append(x)
        return frozenset(out)

    def first_words(self) -> set[str] | None:
        """Words that a match can begin with; None if any word can."""
        return None if any(self.any[s] for s in self.start) else {w for s in self.start for w in self.word[s]}

    def step(self, states: frozenset[int], word: str) -> frozenset[int]:
        """States reached over a word; kept, and words of no arc are all alike, so few steps are ever computed."""
        key = (states, word if word in self.alphabet else None)
        if key not in self.known:
            reached = {self.word[s][word] for s in states if word in self.word[s]}.union(*(self.any[s] for s in states))
            self.known[key] = self._closed(reached)
        return self.known[key]

    def accepts_at(self, words: list[str], at: int) -> bool:
        """Whether words from at on begin with a match."""
        states = self.start
        for i in range(at, len(words)):
            states = self.step(states, words[i])
            if self.end in states:
                return True
            if not states:
                return False
        return False


class Scanner:
    def __init__(self, templates: dict[str, str] | None = None):
        self.automata = {k: Automaton(t) for k, t in (TEMPLATES if templates is None else templates).items()}
        self.by_first: dict[str, list[str]] = {}
        self.anywhere = []
        for label, a in self.automata.items():
            first = a.first_words()
            if first is None:
                self.anywhere.append(label)
            for w in first or ():
                self.by_first.setdefault(w, []).append(label)

    def labels(self, words: list[str]) -> set[str]:
        found: set[str] = set()
        here = set(words)
        for i in sorted(i for w in self.by_first.keys() & here for i in _places(words, w)) if not self.anywhere else range(len(words)):
            for label in (*self.by_first.get(words[i], ()), *self.anywhere):
                if label not in found and self.automata[label].accepts_at(words, i):
                    found.add(label)
        return found


def _places(words: list[str], word: str) -> Iterator[int]:
    at = -1
    while True:
        try:
            at = words.index(word, at + 1)
        except ValueError:
            return
        yield at


def phrases(words: list[str]) -> list[tuple[int, int, str]]:
    """First and last word, and label, of every place of a phrase."""
    here, out = set(words), []
    for phrase, label in PHRASES.items():
        p = phrase.split()
        if here.issuperset(p):
            out += [(i, i + len(p) - 1, label) for i in _places(words, p[0]) if words[i : i + len(p)] == p]
    return out


def license_scan(docs: DataFrame, templates: dict[str, str] | None = None) -> DataFrame:
    """doc_id, n_words, n_base, first_word, last_word (of the base's starts), base_labels, labels (the templates' too),
    score: 1 if a template is accepted, 0.5 if only a phrase is found, else 0."""
    d = texts(docs)

    def of(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        scanner = Scanner(templates)
        for b in frames:
            out = []
            for text in b["text"]:
                words = words_of(text)
                places = phrases(words)
                base, own = {x[2] for x in places}, scanner.labels(words)
                starts = [x[0] for x in places]
                out.append((len(words), len(places), min(starts, default=None), max(starts, default=None), ",".join(sorted(base)), ",".join(sorted(base | own)), 1.0 if own else 0.5 if base else 0.0))
            rows = pd.DataFrame(out, columns=["n_words", "n_base", "first_word", "last_word", "base_labels", "labels", "score"])
            rows[["first_word", "last_word"]] = rows[["first_word", "last_word"]].astype("Int64")
            yield pd.concat([b[["doc_id"]].reset_index(drop=True), rows], axis=1)

    kind = d.schema["doc_id"].dataType.simpleString()
    return d.mapInPandas(of, f"doc_id {kind}, n_words long, n_base long, first_word long, last_word long, base_labels string, labels string, score double")


def template_pattern(template: str) -> str:
    """The language of a template as a regular expression over words that each follow one space; for checks in SQL."""

    def of(parsed: Parsed) -> str:
        return "".join(f" {x}" if isinstance(x, str) else f"(?:{of(x[1])})?" if x[0] == "optional" else f"(?: [^ ]+){{0,{x[1]}}}" for x in parsed.items)

    return of(parse(template)) + " "
