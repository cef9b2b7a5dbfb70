"""Query trees. They say what to find; `compile` turns them into one DataFrame plan."""

from __future__ import annotations

import datetime as dt
import math
import re
from dataclasses import dataclass, field

DEFAULT_FIELD = "_all"


class Query:
    """Any query; validate() tells whether it can mean anything."""

    def validate(self) -> None:
        pass


@dataclass(frozen=True)
class Term(Query):
    term: str
    field: str = DEFAULT_FIELD
    boost: float = 1.0


@dataclass(frozen=True)
class Match(Query):
    """Analysed text; its terms are alternatives (or) or all needed (and)."""

    text: str
    field: str = DEFAULT_FIELD
    analyzer: str = "standard"
    operator: str = "or"
    fuzziness: int = 0
    prefix: int = 0
    boost: float = 1.0


@dataclass(frozen=True)
class MatchPhrase(Query):
    text: str
    field: str = DEFAULT_FIELD
    analyzer: str = "standard"
    slop: int = 0


@dataclass(frozen=True)
class MultiPhrase(Query):
    """Alternatives for each position; an empty slot stands for any term."""

    terms: tuple[tuple[str, ...], ...]
    field: str = DEFAULT_FIELD
    slop: int = 0

    def validate(self) -> None:
        if not self.terms:
            raise ValueError("a phrase needs a term")


@dataclass(frozen=True)
class Prefix(Query):
    prefix: str
    field: str = DEFAULT_FIELD
    boost: float = 1.0


@dataclass(frozen=True)
class Wildcard(Query):
    """* stands for any characters, ? for one."""

    pattern: str
    field: str = DEFAULT_FIELD
    boost: float = 1.0

    def regexp(self) -> str:
        return "".join(".*" if c == "*" else "." if c == "?" else re.escape(c) for c in self.pattern)


@dataclass(frozen=True)
class Regexp(Query):
    """A regular expression of a whole term."""

    pattern: str
    field: str = DEFAULT_FIELD
    boost: float = 1.0


@dataclass(frozen=True)
class Fuzzy(Query):
    """Terms within an edit distance (with transpositions) that share a prefix."""

    term: str
    field: str = DEFAULT_FIELD
    fuzziness: int = 1
    prefix: int = 0
    boost: float = 1.0

    def validate(self) -> None:
        if not 0 <= self.fuzziness <= 2:
            raise ValueError("fuzziness must be 0, 1 or 2")


@dataclass(frozen=True)
class TermRange(Query):
    """Terms from low to high in byte order; '' is open."""

    low: str = ""
    high: str = ""
    field: str = DEFAULT_FIELD
    include_low: bool = True
    include_high: bool = False
    boost: float = 1.0

    def validate(self) -> None:
        if not self.low and not self.high:
            raise ValueError("a term range needs an end")


@dataclass(frozen=True)
class NumericRange(Query):
    low: float = -math.inf
    high: float = math.inf
    field: str = DEFAULT_FIELD
    include_low: bool = True
    include_high: bool = False
    boost: float = 1.0

    def validate(self) -> None:
        if math.isinf(self.low) and math.isinf(self.high):
            raise ValueError("a numeric range needs an end")


@dataclass(frozen=True)
class DateRange(Query):
    start: dt.datetime | None = None
    end: dt.datetime | None = None
    field: str = DEFAULT_FIELD
    include_start: bool = True
    include_end: bool = False

    def validate(self) -> None:
        if self.start is None and self.end is None:
            raise ValueError("a date range needs an end")


@dataclass(frozen=True)
class GeoBox(Query):
    left: float
    top: float
    right: float
    bottom: float
    field: str = DEFAULT_FIELD


@dataclass(frozen=True)
class GeoDistance(Query):
    lon: float
    lat: float
    distance: str
    field: str = DEFAULT_FIELD
    boost: float = 1.0


@dataclass(frozen=True)
class GeoPolygon(Query):
    points: tuple[tuple[float, float], ...]
    field: str = DEFAULT_FIELD
    boost: float = 1.0


@dataclass(frozen=True)
class MatchAll(Query):
    pass


@dataclass(frozen=True)
class MatchNone(Query):
    pass


@dataclass(frozen=True)
class Boolean(Query):
    must: tuple[Query, ...] = ()
    should: tuple[Query, ...] = ()
    must_not: tuple[Query, ...] = ()
    min_should: int = 0
    boost: float = 1.0

    def validate(self) -> None:
        clauses = (*self.must, *self.should, *self.must_not)
        if not clauses:
            raise ValueError("a boolean query needs a clause")
        for c in clauses:
            c.validate()


@dataclass(frozen=True)
class SortKey:
    """A field, '_score' or '_id' by name, or any Column through `expr`."""

    name: str = ""
    desc: bool = False
    missing_first: bool = False
    expr: object = field(default=None, compare=False)

    @staticmethod
    def parse(text: str) -> "SortKey":
        desc, name = text.startswith("-"), text.lstrip("+-")
        return SortKey(name, desc or name == "_score")
