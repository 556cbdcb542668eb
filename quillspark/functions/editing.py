"""Editor actions as functions of a text and a selection.

An edit covers the selection or the lines it touches, and puts four parts in its place: what comes before the new selection,
the new selection, what comes behind it, and what goes to the end of the text. An action says which parts these are. Offsets
are 0-based, in code points, end exclusive.
"""

from __future__ import annotations

from collections.abc import Callable
from typing import NamedTuple

from pyspark.sql import Column
from pyspark.sql import functions as F

from .text import WS


class Parts(NamedTuple):
    before: Column
    chosen: Column
    behind: Column
    at_end: Column


class Action(NamedTuple):
    """parts(covered, text, options): covered is what the edit takes out, the selection or (lines) its whole lines."""

    lines: bool
    parts: Callable[[Column, Column, dict], Parts]


def _parts(before: Column | str = "", chosen: Column | str = "", behind: Column | str = "", at_end: Column | str = "") -> Parts:
    return Parts(*(x if isinstance(x, Column) else F.lit(x) for x in (before, chosen, behind, at_end)))


def _or_sample(covered: Column, around: Callable[[Column], Parts], sample: Parts) -> Parts:
    """around(covered), or the sample where nothing is selected."""
    return Parts(*(F.when(covered == "", empty).otherwise(full) for full, empty in zip(around(covered), sample)))


def _each_line(change: Callable[[Column], Column]) -> Callable[[Column], Parts]:
    return lambda covered: _parts(chosen=F.array_join(F.transform(F.split(covered, "\n", -1), change), "\n"))


def _wrapped(covered: Column, text: Column, o: dict) -> Parts:
    before, after = o["before"], o["after"]
    return _or_sample(covered, lambda s: _parts(F.concat(F.lit(before), s, F.lit(after))), _parts(before, o.get("placeholder", ""), after))


def _linked(covered: Column, text: Column, o: dict) -> Parts:
    return _or_sample(covered, lambda s: _parts(F.concat(F.lit("["), s, F.lit("](")), "", "url)"), _parts("[", "link text", "](url)"))


def _prefixed(covered: Column, text: Column, o: dict) -> Parts:
    return _each_line(lambda x: F.concat(F.lit(o["syntax"]), x))(covered)


def _toggled(covered: Column, text: Column, o: dict) -> Parts:
    mark = o["syntax"]
    return _each_line(lambda x: F.when(x.startswith(mark), F.substring(x, F.lit(len(mark) + 1), F.length(x))).otherwise(F.concat(F.lit(mark), x)))(covered)


def _indented(covered: Column, text: Column, o: dict) -> Parts:
    amount = o["amount"]
    return _each_line(lambda x: F.concat(F.lit(" " * amount), x) if amount > 0 else F.regexp_replace(x, f"^ {{1,{max(1, -amount)}}}", ""))(covered)


def _with_id(covered: Column, text: Column, o: dict) -> Parts:
    return _parts(F.concat(F.regexp_replace(covered, rf"[{WS}]*\{{#custom-id\}}$", ""), F.lit(" {#")), "custom-id", "}")


def _noted(covered: Column, text: Column, o: dict) -> Parts:
    """A reference with the number after the largest one of the text, whose note stands at the end."""
    taken = F.transform(F.regexp_extract_all(text, F.lit(r"\[\^([0-9]+)\]"), F.lit(1)), lambda n: n.cast("long"))
    number = (F.coalesce(F.array_max(taken), F.lit(0)) + 1).cast("string")
    gap = F.when(text.rlike(f"[^{WS}]"), "\n\n").otherwise("")
    return _parts("[^", number, "]", F.concat(gap, F.lit("[^"), number, F.lit("]: footnote text")))


# The actions' names, and the samples in the functions above.
ACTIONS = {
    "wrap": Action(False, _wrapped), "blockWrap": Action(False, _wrapped), "prefix": Action(True, _prefixed), "prefixToggle": Action(True, _toggled),
    "insert": Action(False, lambda covered, text, o: _parts(o["syntax"])), "indent": Action(True, _indented), "link": Action(False, _linked),
    "image": Action(False, lambda covered, text, o: _parts("![", "alt text", "](image-url)")), "headingId": Action(True, _with_id), "footnote": Action(False, _noted),
}


def act(name: str, text: Column, start: Column, end: Column, **options) -> Column:
    r"""text, start and end after an action: the new text and selection. An unknown action leaves them as they are. Options are
    before, after, placeholder (wrap, blockWrap), syntax (prefix, prefixToggle, insert) and amount (indent; below zero takes
    spaces away); \n and \t typed in before, after and syntax count as what they stand for."""
    action = ACTIONS.get(name)
    if action is None:
        return F.struct(text.alias("text"), start.cast("int").alias("start"), end.cast("int").alias("end"))
    typed = {k: v.replace("\\n", "\n").replace("\\t", "\t") if k in ("before", "after", "syntax") else v for k, v in options.items()}
    left, right = F.left(text, start), F.substring(text, end + 1, F.length(text))
    covered = F.substring(text, start + 1, F.greatest(end - start, F.lit(0)))
    if action.lines:  # the lines' rests on either side are covered, too
        head, tail = F.substring_index(left, "\n", -1), F.substring_index(right, "\n", 1)
        covered = F.concat(head, covered, tail)
        left, right = F.left(left, F.length(left) - F.length(head)), F.substring(right, F.length(tail) + 1, F.length(right))
    new = action.parts(covered, text, typed)
    at = (F.length(left) + F.length(new.before)).cast("int")
    return F.struct(F.concat(left, new.before, new.chosen, new.behind, right, new.at_end).alias("text"), at.alias("start"), (at + F.length(new.chosen)).cast("int").alias("end"))


def decode_escapes(s: Column) -> Column:
    r"""\n and \t as typed in an option, of a column."""
    return F.replace(F.replace(s, F.lit("\\n"), F.lit("\n")), F.lit("\\t"), F.lit("\t"))
