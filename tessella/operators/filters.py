"""Inline filters of a query text, and pages of listings."""

from __future__ import annotations

import re
from dataclasses import dataclass, field
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessella.functions.paths import slashed

#: Names that a language filter may use for another.
ALIASES = {"js": "javascript", "ts": "typescript", "py": "python", "rs": "rust", "rb": "ruby", "kt": "kotlin", "cs": "csharp", "c++": "cpp", "objc": "objectivec", "golang": "go"}
_FILTER = re.compile(r"""\b(kind|lang|language|path|name):("[^"]*"|'[^']*'|\S+)""", re.I)
MAX_EDITS = 2


@dataclass
class Filters:
    kinds: list[str] = field(default_factory=list)
    langs: list[str] = field(default_factory=list)
    paths: list[str] = field(default_factory=list)
    names: list[str] = field(default_factory=list)

    def merged(self, other: Filters) -> Filters:
        return Filters(self.kinds + other.kinds, self.langs + other.langs, self.paths + other.paths, self.names + other.names)

    def condition(self, path: str | None = None, lang: str | None = None, kind: str | None = None) -> Column:
        """All filters but that by name. A row without kind passes the filter by kind."""
        out = F.lit(True)
        any_of = lambda c, values: reduce(lambda a, b: a | b, (F.contains(c, F.lit(v)) for v in values))
        if path and self.paths:
            out &= any_of(slashed(F.col(path)), [p.replace("\\", "/") for p in self.paths])
        if lang and self.langs:
            out &= any_of(F.lower(lang), [*self.langs, *(ALIASES[v] for v in self.langs if v in ALIASES)])
        if kind and self.kinds:
            out &= F.col(kind).isNull() | any_of(F.lower(kind), self.kinds)
        return out


def parse(query: str) -> tuple[str, Filters]:
    """The query's words, and the filters among them; a filter without a value is a word."""
    found = Filters()

    def take(m: re.Match) -> str:
        key, value = m[1].lower(), m[2]
        if value[0] in "\"'" and value[-1] == value[0] and len(value) > 1:
            value = value[1:-1]
        if not value:
            return m[0]
        if key == "kind":
            found.kinds.append(value.lower())
        elif key in ("lang", "language"):
            found.langs.append(value.lower())
        else:
            (found.paths if key == "path" else found.names).append(value)
        return " "

    return " ".join(_FILTER.sub(take, query).split()), found


def augmented(query: str, kinds: tuple[str, ...] = (), langs: tuple[str, ...] = (), path: str = "") -> str:
    """The query with filters given apart, written as inline ones before it."""
    return " ".join([*(f"kind:{k}" for k in kinds), *(f"lang:{v}" for v in langs), *([f"path:{path}"] if path else []), query])


def bounded_distance(a: Column, b: Column, most: int) -> Column:
    """Edit distance without case; most + 1 if it is larger."""
    d = F.levenshtein(F.lower(a), F.lower(b), most)
    return F.when(d < 0, most + 1).otherwise(d)


def by_name(rows: DataFrame, names: list[str], column: str) -> DataFrame:
    """Rows whose name holds one of the texts, or has none; if no row with a name does, those within two edits of one."""
    holds = reduce(lambda a, b: a | b, (F.contains(F.lower(column), F.lit(n.lower())) for n in names))
    near = reduce(lambda a, b: a | b, (F.levenshtein(F.lower(column), F.lit(n.lower()), MAX_EDITS) >= 0 for n in names))
    flagged = rows.withColumns({"holds_": F.coalesce(holds, F.lit(True)), "near_": F.coalesce(near, F.lit(False))}).where("holds_ or near_")
    # one row: whether any row holds a text
    some = F.broadcast(flagged.agg(F.coalesce(F.bool_or("holds_"), F.lit(False)).alias("some_")))
    return flagged.join(some).where((F.col("some_") & F.col("holds_")) | (~F.col("some_") & F.col("near_"))).select(*rows.columns)


def page(rows: DataFrame, key: str, limit: int, part: str | None = None, after: str | None = None) -> DataFrame:
    """A page of a listing in order of key: those that hold a text, case aside, and come after a key."""
    if part:
        rows = rows.where(F.contains(F.lower(key), F.lit(part.lower())))
    if after is not None:
        rows = rows.where(F.col(key) > after)
    return rows.orderBy(key).limit(limit)
