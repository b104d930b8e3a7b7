"""Mentions of all names of a roster in one pass over a text: an automaton per roster."""

from __future__ import annotations

import json
import unicodedata
from functools import lru_cache
from itertools import accumulate

import ahocorasick
import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F

MENTIONS = "array<struct<start:int,end:int,entry:int,text:string>>"
PARTS = "array<struct<entry:int,parts:array<struct<no:int,text:string,spans:array<struct<start:int,end:int>>>>>>"


@lru_cache(maxsize=1 << 16)
def is_word(char: str) -> bool:
    """Letters, numbers and the underscore."""
    return char == "_" or unicodedata.category(char)[0] in "LN"


class Names:
    """Spellings of a roster's entries; an entry's spellings count in the given order."""

    def __init__(self, spellings: list[list[str | None] | None]):
        holders: dict[str, list[tuple[int, int]]] = {}
        for entry, aliases in enumerate(spellings):
            for order, alias in enumerate(aliases or ()):
                if alias:
                    holders.setdefault(alias, []).append((entry, order))
        self.automaton = ahocorasick.Automaton()
        for alias, held in holders.items():
            self.automaton.add_word(alias, (len(alias), held))
        if holders:
            self.automaton.make_automaton()

    def scan(self, text: str | None, first_only: bool = False) -> list[tuple[int, int, int]]:
        """(start, -end, entry) in order: left to right, of an entry's spellings at one place the first.

        A mention needs a text end or a sign outside words on both sides and uses that sign up, so that an
        entry's next mention cannot share it.
        """
        if not text or not len(self.automaton):
            return []
        found: dict[int, list[tuple[int, int, int]]] = {}
        size = len(text)
        for last, (length, held) in self.automaton.iter(text):
            start, end = last + 1 - length, last + 1
            if (start and is_word(text[start - 1])) or (end < size and is_word(text[end])):
                continue
            for entry, order in held:
                found.setdefault(entry, []).append((start, order, end))
        out = []
        for entry, hits in found.items():
            used = -2
            for start, _, end in sorted(hits):
                if start > used + 1:
                    out.append((start, -end, entry))
                    used = end
                    if first_only:
                        break
        return sorted(out)


@lru_cache(maxsize=64)
def names(packed: str) -> Names:
    """The automaton of a roster; rows of one document follow each other, so it is built once."""
    return Names(json.loads(packed))


def _lists(sizes: list[int], values: pa.Array) -> pa.ListArray:
    return pa.ListArray.from_arrays(pa.array([0, *accumulate(sizes)], pa.int32()), values)


def _ints(values) -> pa.Array:
    return pa.array(values, pa.int32())


def _scanner(first_only: bool):
    @F.arrow_udf(MENTIONS)
    def scan(text: pa.Array, packed: pa.Array) -> pa.Array:
        sizes, starts, ends, entries, found = [], [], [], [], []
        for t, p in zip(text.to_pylist(), packed.to_pylist(), strict=True):
            hits = names(p).scan(t, first_only) if p else []
            sizes.append(len(hits))
            for start, end, entry in hits:
                starts.append(start)
                ends.append(-end)
                entries.append(entry)
                found.append(t[start:-end])
        fields = [_ints(starts), _ints(ends), _ints(entries), pa.array(found, pa.string())]
        return _lists(sizes, pa.StructArray.from_arrays(fields, ["start", "end", "entry", "text"]))

    return scan


def mentions(text: Column, packed: Column, first_only: bool = False) -> Column:
    """array<struct<start,end,entry,text>> of a roster's mentions, by start, longest first, then entry; null names have none.

    ``packed`` is the JSON of one list of spellings per entry.
    """
    return _scanner(first_only)(text, packed)


def parts(text: Column, packed: Column) -> Column:
    """array<struct<entry,parts>>: per entry the lines that mention it, with their number and spans."""

    @F.arrow_udf(PARTS)
    def scan(text: pa.Array, packed: pa.Array) -> pa.Array:
        entries, per_text, per_entry, numbers, lines, per_line, starts, ends = [], [], [], [], [], [], [], []
        for t, p in zip(text.to_pylist(), packed.to_pylist(), strict=True):
            roster, held = names(p) if p else None, {}
            for no, line in enumerate(t.split("\n") if t and roster else ()):
                for start, end, entry in roster.scan(line):
                    of_entry = held.setdefault(entry, {})
                    of_entry.setdefault(no, (line, []))[1].append((start, -end))
            per_text.append(len(held))
            for entry in sorted(held):
                entries.append(entry)
                per_entry.append(len(held[entry]))
                for no, (line, spans) in held[entry].items():
                    numbers.append(no)
                    lines.append(line)
                    per_line.append(len(spans))
                    starts += [s for s, _ in spans]
                    ends += [e for _, e in spans]
        spans = _lists(per_line, pa.StructArray.from_arrays([_ints(starts), _ints(ends)], ["start", "end"]))
        each = _lists(per_entry, pa.StructArray.from_arrays([_ints(numbers), pa.array(lines, pa.string()), spans], ["no", "text", "spans"]))
        return _lists(per_text, pa.StructArray.from_arrays([_ints(entries), each], ["entry", "parts"]))

    return scan(text, packed)
