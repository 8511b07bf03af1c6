"""Large rule tables: thousands of deny patterns, tens of thousands of prefixes.

Deny patterns are screened by the literals that their matches must contain: one
pass of an Aho-Corasick automaton over a command names the patterns that can
match at all, and only these are tried, in order.  Prefixes are found by an
equality join on command type and leading characters, one row for each length
that the type's prefixes have.
"""

from __future__ import annotations

import hashlib
import re
from re import _parser as parser

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tocsin.session import ship, written

# The letters that equal an ASCII one when case is ignored, besides its own other case.
LOOK_ALIKES = str.maketrans({"İ": "i", "ı": "i", "ſ": "s", "K": "k"})


def folded(text: str) -> str:
    return text.translate(LOOK_ALIKES).lower()


def _clauses(parsed) -> list[set[str]]:
    """Sets of folded ASCII texts; a match contains at least one text of every set."""
    found, run = [], ""
    for op, value in [*parsed, (None, None)]:
        if op is parser.LITERAL and value < 128:
            run += chr(value)
            continue
        if op is parser.AT:
            continue  # takes no characters
        if run:
            found.append({folded(run)})
            run = ""
        if op is parser.SUBPATTERN:
            found += _clauses(value[-1])
        elif op in (parser.MAX_REPEAT, parser.MIN_REPEAT, parser.POSSESSIVE_REPEAT) and value[0] > 0:
            found += _clauses(value[-1])
        elif op is parser.BRANCH:
            branches = [_clauses(branch) for branch in value[1]]
            if all(branches):
                found.append(set().union(*(max(b, key=_worth) for b in branches)))
    return found


def _worth(clause: set[str]) -> int:
    return min(map(len, clause))


def needed_literals(pattern: str) -> set[str] | None:
    """Texts of which every match of a pattern, case ignored, contains one when folded; None where there are none."""
    found = _clauses(parser.parse(pattern, re.IGNORECASE))
    return max(found, key=_worth) if found else None


class Screen:
    """Deny patterns in order, behind an automaton of the literals they need."""

    kept: dict[str, Screen] = {}

    def __init__(self, patterns: list[str]):
        import ahocorasick

        self.patterns, self.compiled, self.always = patterns, {}, []
        owners: dict[str, list[int]] = {}
        for n, pattern in enumerate(patterns):
            literals = needed_literals(pattern)
            if literals is None:
                self.always.append(n)
            for literal in literals or ():
                owners.setdefault(literal, []).append(n)
        self.automaton = ahocorasick.Automaton()
        for literal, numbers in owners.items():
            self.automaton.add_word(literal, numbers)
        self.automaton.make_automaton()
        self.searches = bool(owners)

    @classmethod
    def of(cls, patterns: list[str]) -> Screen:
        """The screen of some patterns, made once per worker process."""
        name = hashlib.sha256("\0".join(patterns).encode()).hexdigest()
        if name not in cls.kept:
            cls.kept.clear()
            cls.kept[name] = cls(patterns)
        return cls.kept[name]

    def candidates(self, text: str) -> list[int]:
        found = set(self.always)
        if self.searches:
            for _, numbers in self.automaton.iter(folded(text)):
                found.update(numbers)
        return sorted(found)

    def first(self, text: str) -> int | None:
        """Position, from 1, of the first pattern that is found in a text."""
        for n in self.candidates(text):
            if n not in self.compiled:
                self.compiled[n] = re.compile(self.patterns[n], re.IGNORECASE)
            if self.compiled[n].search(text):
                return n + 1
        return None


def first_screened(frame: DataFrame, patterns: list[str], text: str = "cmd") -> Column:
    """Position (from 1) of the first pattern found in a column, or null; nulls have none."""
    ship(frame.sparkSession)
    sent = frame.sparkSession.sparkContext.broadcast(list(patterns))

    @F.pandas_udf("int")
    def position(commands: pd.Series) -> pd.Series:
        screen = Screen.of(sent.value)
        return pd.Series([None if c is None else screen.first(c) for c in commands], dtype="Int32")

    return position(F.col(text))


def with_first_prefix(frame: DataFrame, prefixes: DataFrame, name: str = "verb", text: str = "cmd") -> DataFrame:
    """Add the first prefix, by ordinal, that a column begins with, among those of its row's ``command_type``.

    ``prefixes`` has command_type, ordinal and pattern.  Rows of a null text have no prefix.
    """
    rules = prefixes.groupBy("command_type", "pattern").agg(F.min("ordinal").alias("ordinal"))
    rules = written(rules, "prefixes")
    sized = rules.groupBy("command_type").agg(F.collect_set(F.length("pattern")).alias("_lengths"))
    rows = written(frame.withColumn("_row", F.monotonically_increasing_id()), "screened")
    # Only rows with a text, and lengths that it has, are looked up.
    asked = rows.select("_row", "command_type", F.col(text).alias("_text")).filter(F.col("_text").isNotNull())
    asked = asked.join(sized, "command_type").select("_row", "command_type", "_text", F.explode("_lengths").alias("_n"))
    asked = asked.filter(F.col("_n") <= F.length("_text"))
    asked = asked.select("_row", "command_type", F.left("_text", F.col("_n")).alias("pattern"))
    found = asked.join(rules, ["command_type", "pattern"]).groupBy("_row").agg(F.min_by("pattern", "ordinal").alias(name))
    return rows.join(found, "_row", "left").drop("_row")
