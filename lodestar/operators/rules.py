"""Large rule tables against large tables of texts, without trying every rule on every text.

A pattern can only match where one of its required literals stands: the longest plain string of a sequence, or one of each branch of an
alternation. The literals of all rules make one automaton per task, which reads each text once and names the rules that can match it; only
these are tried. Rules without a required literal (``\\d+``) are tried on every text. What matches is decided by the pattern itself, in the
engine, so the result is that of trying all.

A rule table is small by nature: it is collected, MAX_RULES rows at most.
"""

from __future__ import annotations

import re
import re._parser as parser
from collections.abc import Iterator
from functools import cache

import ahocorasick
import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, functions as F

from lodestar.common import edges, true

MAX_RULES = 100_000


@cache
def _folds() -> dict[int, str]:
    """Characters that case-insensitive matching takes for another than their lower case: by way of the upper case, one for one."""

    def fold(c: str) -> str:
        up = c.upper()
        low = (up if len(up) == 1 else c).lower()
        return low if len(low) == 1 else low[0]

    return {i: fold(chr(i)) for i in range(0x80, 0x10000) if not 0xD800 <= i < 0xE000 and fold(chr(i)) != chr(i)}


def folded(text: str) -> str:
    """A text in which all characters that match each other without case are the same."""
    return text.lower() if text.isascii() else "".join(c.lower() if c < "\x80" else c for c in text).translate(_folds())


def _literals(tree) -> frozenset[str] | None:
    """Strings one of which every match holds, or None. Of the parts of a sequence the one whose shortest string is longest counts."""
    options: list[frozenset[str]] = []
    run = ""

    def end():
        nonlocal run
        if run:
            options.append(frozenset([run]))
        run = ""

    for op, value in tree:
        name = str(op)
        if name == "LITERAL":
            run += chr(value)
            continue
        end()
        found = None
        if name == "SUBPATTERN":
            found = _literals(value[-1])
        elif name == "BRANCH":
            parts = [_literals(b) for b in value[1]]
            found = frozenset().union(*parts) if all(parts) else None
        elif name in ("MAX_REPEAT", "MIN_REPEAT", "POSSESSIVE_REPEAT") and value[0] >= 1:
            found = _literals(value[2])
        elif name == "ATOMIC_GROUP":
            found = _literals(value)
        elif name == "IN" and all(str(o) == "LITERAL" for o, _ in value) and len(value) <= 8:
            found = frozenset(chr(c) for _, c in value)
        if found:
            options.append(found)
    end()
    return max(options, key=lambda s: (min(map(len, s)), -len(s)), default=None)


def required_literals(pattern: str) -> frozenset[str] | None:
    """Folded strings one of which every case-insensitive match of a pattern holds; None if the pattern does not tell."""
    try:
        found = _literals(parser.parse(pattern, re.IGNORECASE | re.UNICODE))
    except (re.error, OverflowError, RecursionError):
        return None  # a construct of the engine's own
    return frozenset(map(folded, found)) if found else None


class Automaton:
    """Names the rules whose required literals a text holds."""

    def __init__(self, patterns: list[str | None]):
        by_literal: dict[str, set[int]] = {}
        self.always: list[int] = []
        for k, p in enumerate(patterns):
            if p is None:
                continue
            literals = required_literals(p)
            if literals is None:
                self.always.append(k)
            for x in literals or ():
                by_literal.setdefault(x, set()).add(k)
        self.words = ahocorasick.Automaton()
        for x, rules in by_literal.items():
            self.words.add_word(x, tuple(rules))
        self.some = bool(by_literal)
        if self.some:
            self.words.make_automaton()

    def candidates(self, text: str | None) -> np.ndarray:
        if text is None:
            return np.zeros(0, np.int32)
        hit = {rules for _, rules in self.words.iter(folded(text))} if self.some else ()
        return np.array(sorted(set(self.always).union(*hit)), np.int32)


def match_rules(df: DataFrame, key: str, subjects: dict[str | None, Column], rules: DataFrame, rule_key: str = "rule_id", field: str | None = None, pattern: str = "pattern", unless: str | None = None) -> DataFrame:
    """(key, rule_key) of the rows whose subject a rule's pattern matches, and its ``unless`` pattern does not. Case does not count.

    subjects: the text that a rule of each ``field`` value looks at; without ``field`` the only one. Rules of other fields, and rules
    with a null pattern, match nothing.
    """
    columns = [rule_key, F.col(field).alias("_field") if field else F.lit(None).cast("string").alias("_field"), F.col(pattern).alias("_pattern"), F.col(unless).alias("_unless") if unless else F.lit(None).cast("string").alias("_unless")]
    listed = rules.select(*columns).where(F.col("_pattern").isNotNull()).limit(MAX_RULES + 1).collect()
    if len(listed) > MAX_RULES:
        raise ValueError(f"more than {MAX_RULES} rules")
    out, asked_for = None, {r["_field"] for r in listed}
    for name, subject in [s for s in subjects.items() if s[0] in asked_for] or list(subjects.items())[:1]:
        own = [r for r in listed if r["_field"] == name]
        table = df.sparkSession.createDataFrame([(k, r[0], edges(r["_pattern"]), r["_unless"] and edges(r["_unless"])) for k, r in enumerate(own)], f"_k int, {rule_key} {rules.schema[rule_key].dataType.simpleString()}, _pattern string, _unless string")
        asked = df.select(key, subject.alias("_text")).withColumn("_k", F.explode(_candidates([r["_pattern"] for r in own])("_text")))
        flags = lambda c: F.concat(F.lit("(?iu)"), F.col(c))
        hit = F.regexp_like("_text", flags("_pattern")) & ~true(F.regexp_like("_text", flags("_unless")))
        part = asked.join(F.broadcast(table), "_k").where(hit).select(key, rule_key)
        out = part if out is None else out.unionByName(part)
    return out


def _candidates(patterns: list[str]):
    @F.pandas_udf("array<int>")
    def found(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        automaton = Automaton(patterns)
        for texts in batches:
            yield pd.Series([automaton.candidates(t) for t in texts], index=texts.index, dtype=object)

    return found
