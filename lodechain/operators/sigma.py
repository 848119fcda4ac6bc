"""Detection rules compiled to predicates: selections, modifiers and conditions become one column (and, for a check,
one SQL expression) instead of being read again for every event."""

from __future__ import annotations

import fnmatch
import re
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


@dataclass(frozen=True)
class Rule:
    id: str
    detection: dict
    condition: str
    level: str = "medium"


def atom(name: str, mods: list[str], want) -> Column:
    """One field test. Values are alternatives, all needed with ``all``; comparisons ignore case unless ``cased``;
    precedence contains, startswith, endswith, re, equality. A null value or an empty list fails."""
    cased = "cased" in mods
    v = F.col(name).cast("string")
    v = v if cased else F.lower(v)
    tests = []
    for w in want if isinstance(want, list) else [want]:
        w = str(w) if cased else str(w).lower()
        kind = next((m for m in ("contains", "startswith", "endswith", "re") if m in mods), "")
        tests.append({"contains": lambda w=w: v.contains(w), "startswith": lambda w=w: v.startswith(w), "endswith": lambda w=w: v.endswith(w), "re": lambda w=w: v.rlike(w), "": lambda w=w: v == w}[kind]())
    if not tests:
        return F.lit(False)
    return F.coalesce(reduce(Column.__and__ if "all" in mods else Column.__or__, tests), F.lit(False))


def selection(spec) -> Column:
    """A mapping is the AND of its fields, a list of mappings their OR; keyword lists match nothing."""
    if isinstance(spec, dict):
        parts = [atom(k.split("|")[0], k.split("|")[1:], w) for k, w in spec.items()]
        return reduce(Column.__and__, parts, F.lit(True))
    maps = [s for s in spec if isinstance(s, dict)]
    return reduce(Column.__or__, map(selection, maps), F.lit(False))


class _Parser:
    """Recursive descent over a condition: not binds tighter than and, and than or. What a condition names but the rule
    lacks is false, a missing end of a bracket is supplied, and what stands behind a whole expression is not read."""

    WORD = re.compile(r"\(|\)|\b(?:and|or|not|of|them|all|\d+)\b|[A-Za-z_][\w\-*]*|\S")

    def __init__(self, text: str, named: dict[str, Column]):
        self.tokens, self.named = self.WORD.findall(text), named

    def peek(self) -> str | None:
        return self.tokens[0] if self.tokens else None

    def either(self) -> Column:
        left = self.both()
        while self.peek() == "or":
            self.tokens.pop(0)
            left = left | self.both()
        return left

    def both(self) -> Column:
        left = self.negated()
        while self.peek() == "and":
            self.tokens.pop(0)
            left = left & self.negated()
        return left

    def negated(self) -> Column:
        if self.peek() == "not":
            self.tokens.pop(0)
            return ~self.negated()
        return self.single()

    def chosen(self, name: str) -> list[Column]:
        if name == "them":
            return list(self.named.values())
        if "*" in name:
            return [c for n, c in self.named.items() if fnmatch.fnmatchcase(n, name)]
        return [self.named.get(name, F.lit(False))]

    def single(self) -> Column:
        if not self.tokens:
            return F.lit(False)
        token = self.tokens.pop(0)
        if token == "(":
            inner = self.either()
            if self.peek() == ")":
                self.tokens.pop(0)
            return inner
        if token == "all" or token.isdigit():  # any number asks for one at least
            if self.peek() != "of" or len(self.tokens) < 2:
                del self.tokens[: int(self.peek() == "of")]
                return F.lit(False)
            self.tokens.pop(0)
            found = self.chosen(self.tokens.pop(0))
            return reduce(Column.__and__ if token == "all" else Column.__or__, found) if found else F.lit(False)
        return reduce(Column.__or__, self.chosen(token), F.lit(False))


def compile_rule(rule: Rule) -> Column:
    """The rule's predicate; false where no selection holds (also for ``not x``)."""
    named = {n: F.coalesce(selection(s), F.lit(False)) for n, s in rule.detection.items()}
    return reduce(Column.__or__, named.values(), F.lit(False)) & _Parser(rule.condition, named).either()


def match(events: DataFrame, rules: list[Rule], out: str = "hits", chunk: int = 100) -> DataFrame:
    """``events`` with the ids of all rules that hold, in one pass; at most ``chunk`` predicates share an expression."""
    parts = [F.array_compact(F.array(*[F.when(compile_rule(r), r.id) for r in rules[i : i + chunk]])) for i in range(0, len(rules), chunk)]
    return events.withColumn(out, F.concat(*parts) if parts else F.array().cast("array<string>"))
