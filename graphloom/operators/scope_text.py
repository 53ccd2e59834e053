"""Scope constraints named in a question, by alias tables."""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F

from .aliases import EXAMPLE, Names


def _quoted(x: str) -> str:
    return re.sub(r"([^\w\s])", r"\\\1", x)


def _found(text: Column, table: dict[str, str], before: str = r"\b", after: str = r"\b") -> Column:
    """Canonical names whose aliases the text holds."""
    names: dict[str, list[str]] = {}
    for alias, name in table.items():
        names.setdefault(name, []).append(_quoted(alias))
    tests = [F.when(text.rlike(f"{before}(?:{'|'.join(sorted(a, key=len, reverse=True))}){after}"), F.lit(n)) for n, a in sorted(names.items())]
    return F.filter(F.array(*tests), lambda x: x.isNotNull())


def authors(question: Column, names: Names = EXAMPLE) -> Column:
    """By alias, by full name after in, by, from, for or according to, or by part of a name there (the shortest that fits)."""
    low = F.lower(question)
    named = F.regexp_extract_all(question, F.lit(r"\b(?:in|according to|by|from|for)\s+([A-Z][a-zà-ÿ]+(?:\s+[A-Z][a-zà-ÿ]+)*)"), F.lit(1))
    ordered = F.array(*map(F.lit, sorted(names.known, key=lambda x: (len(x), x))))
    resolve = lambda n: F.get(F.filter(ordered, lambda a: F.lower(a).contains(F.lower(n))), 0)
    partial = F.filter(F.transform(named, lambda n: F.coalesce(F.try_element_at(F.create_map(*(F.lit(x) for kv in names.authors.items() for x in kv)), F.lower(n)), resolve(n))), lambda x: x.isNotNull())
    return F.array_sort(F.array_distinct(F.concat(_found(low, names.authors), partial)))


def works(question: Column, names: Names = EXAMPLE) -> Column:
    return _found(F.lower(question), names.works, before=r"\b(?:in|from)\s+(?:the\s+)?")


def traditions(question: Column, names: Names = EXAMPLE) -> Column:
    return _found(F.lower(question), names.traditions)


def domains(question: Column, names: Names = EXAMPLE) -> Column:
    nouns = {a: n for a, n in names.domains.items() if not a.endswith("al")}
    adjectives = {a: n for a, n in names.domains.items() if a.endswith("al")}
    low = F.lower(question)
    return F.array_sort(F.array_union(_found(low, nouns, before=r"\b(?:about|on|concerning|regarding)\s+"), _found(low, adjectives, after=r"\s+(?:question|issue|problem|view)")))
