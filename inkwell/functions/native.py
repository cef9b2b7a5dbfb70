"""Text analysis as Columns: what built-ins express stays on the JVM, the rest is one Arrow call.

Tokens are array<struct<term:string,pos:int>>; a plain term array is array<string>.
"""

from __future__ import annotations

from array import array
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F

from . import languages
from . import tokens as T

TOKENS = "array<struct<term:string,pos:int>>"
PLACED = "array<struct<term:string,pos:array<int>>>"
COUNTS = "array<struct<term:string,n:bigint>>"
GAP = 100


# --- terms ---------------------------------------------------------------------------------


def letters(text: Column) -> Column:
    return F.regexp_extract_all(text, F.lit(r"(\p{L}+)"), F.lit(1))


def simple_terms(text: Column) -> Column:
    return letters(F.lower(text))


def whitespace_terms(text: Column) -> Column:
    return F.regexp_extract_all(text, F.lit(r"([^ \t\n\r\f]+)"), F.lit(1))


def pattern_terms(text: Column, pattern: str) -> Column:
    return F.filter(F.regexp_extract_all(text, F.lit(f"({pattern})"), F.lit(1)), lambda t: t != "")


def keyword_terms(text: Column) -> Column:
    return F.when(text.isNotNull(), F.array(text))


TERMS = {"simple": simple_terms, "whitespace": whitespace_terms, "keyword": keyword_terms}


def strip_html(text: Column) -> Column:
    return F.regexp_replace(text, r"(?s)<!--.*?-->|</?[!\w][^<>]*>", " ")


def drop_stop(terms: Column, words) -> Column:
    return F.filter(terms, lambda t: ~t.isin(*words))


def keep_length(terms: Column, least: int = 0, most: int = 0) -> Column:
    return F.filter(terms, lambda t: (F.char_length(t) >= least) & (F.char_length(t) <= most if most else F.lit(True)))


def truncate(terms: Column, n: int) -> Column:
    return F.transform(terms, lambda t: F.substring(t, 1, n))


def ngrams(terms: Column, least: int, most: int) -> Column:
    def of(t: Column) -> Column:
        start = F.sequence(F.lit(1), F.greatest(F.char_length(t) - (least - 1), F.lit(1)))
        if least == most:
            cut = F.transform(start, lambda i: F.substring(t, i, F.lit(least)))
            return F.when(F.char_length(t) >= least, cut).otherwise(F.array().cast("array<string>"))
        size = F.sequence(F.lit(least), F.lit(most))
        cut = F.transform(start, lambda i: F.transform(size, lambda n: F.when(i + n - 1 <= F.char_length(t), F.substr(t, i, n))))
        return F.filter(F.flatten(cut), lambda g: g.isNotNull())

    return F.flatten(F.transform(terms, of))


def edge_ngrams(terms: Column, least: int, most: int, back: bool = False) -> Column:
    take = F.right if back else F.left
    return F.flatten(
        F.transform(
            terms,
            lambda t: F.transform(
                F.filter(F.sequence(F.lit(least), F.lit(most)), lambda n: n <= F.char_length(t)), lambda n: take(t, n)
            ),
        )
    )


def bound(value: Column, use) -> Column:
    """use(value) with the value computed once, however often (and in whatever lambda) it is used."""
    return F.transform(F.array(value), use)[0]


def shingles(terms: Column, n: int, sep: str = " ") -> Column:
    """Every run of n neighbouring terms."""

    def of(a: Column) -> Column:
        starts = F.sequence(F.lit(1), F.size(a) - n + 1)
        return F.when(F.size(a) >= n, F.transform(starts, lambda i: F.concat_ws(sep, *(F.get(a, i + (k - 1)) for k in range(n)))))

    return bound(terms, of)


def reverse_terms(terms: Column) -> Column:
    return F.transform(terms, F.reverse)


def unique(terms: Column) -> Column:
    return F.array_distinct(terms)


# --- counts --------------------------------------------------------------------------------


def runs(ordered: Column, key, make) -> Column:
    """make(array, start, size) of every run of elements with the same key in an ordered array."""

    def of(a: Column) -> Column:
        begins = lambda i: (i == 0) | ~key(F.get(a, i)).eqNullSafe(key(F.get(a, i - 1)))
        starts = F.filter(F.sequence(F.lit(0), F.size(a) - 1), begins)
        each = lambda s: F.transform(s, lambda i, k: make(a, i, F.coalesce(F.get(s, k + 1), F.size(a)) - i))
        return F.when(F.size(a) > 0, bound(starts, each))

    return bound(ordered, of)


def counted(terms: Column) -> Column:
    """Of a term array each distinct term and its occurrences, by a sort in the row."""
    one = lambda a, i, n: F.struct(F.get(a, i).alias("term"), n.cast("long").alias("n"))
    return runs(F.sort_array(terms), lambda t: t, one)


def placed(tokens: Column) -> Column:
    """PLACED of a token array: each distinct term and its positions, by a sort in the row."""
    ordered = F.sort_array(F.transform(tokens, lambda t: F.struct(t["term"].alias("term"), t["pos"].alias("pos"))))

    def one(a: Column, i: Column, n: Column) -> Column:
        return F.struct(F.get(a, i)["term"].alias("term"), F.transform(F.slice(a, i + 1, n), lambda t: t["pos"]).alias("pos"))

    return F.coalesce(runs(ordered, lambda t: t["term"], one), F.array().cast(PLACED))


def unplaced(terms: Column) -> Column:
    """The token array that placed() came from; terms at one position in their own order."""
    each = F.transform(terms, lambda t: F.transform(t["pos"], lambda p: F.struct(p.alias("pos"), t["term"].alias("term"))))
    return F.transform(F.sort_array(F.flatten(each)), lambda t: F.struct(t["term"].alias("term"), t["pos"].alias("pos")))


# --- tokens --------------------------------------------------------------------------------


def numbered(terms: Column) -> Column:
    """Terms with positions 1, 2, .."""
    return F.transform(terms, lambda t, i: F.struct(t.alias("term"), (i + 1).cast("int").alias("pos")))


def joined(values: Column) -> Column:
    """Token arrays of several values of a field: each begins GAP after the one before."""
    start = F.array().cast(TOKENS)

    def add(acc: Column, v: Column) -> Column:
        last = F.coalesce(F.try_element_at(acc, F.lit(-1))["pos"] + GAP, F.lit(0))
        return F.concat(acc, F.transform(v, lambda t: F.struct(t["term"].alias("term"), (t["pos"] + last).cast("int").alias("pos"))))

    return F.aggregate(values, start, add)


class _Lists:
    """Lists of terms with a number each, as Arrow: what is in Python objects is bounded, however
    many rows there are."""

    FLUSH = 1 << 18

    def __init__(self, name: str, kind: pa.DataType):
        self.name, self.kind, self.parts = name, kind, []
        self._begin()

    def _begin(self) -> None:
        self.terms, self.numbers, self.ends, self.none = [], array("q"), [0], []

    def end(self, null: bool = False) -> None:
        """Ends a row."""
        self.ends.append(len(self.terms))
        self.none.append(null)
        if len(self.terms) >= self.FLUSH:
            self._flush()

    def _flush(self) -> None:
        numbers = pa.array(np.frombuffer(self.numbers, np.int64) if self.numbers else [], pa.int64()).cast(self.kind)
        values = pa.StructArray.from_arrays([pa.array(self.terms, pa.string()), numbers], names=["term", self.name])
        self.parts.append(pa.ListArray.from_arrays(pa.array(self.ends, pa.int32()), values, mask=pa.array(self.none, pa.bool_())))
        self._begin()

    def all(self) -> pa.Array:
        self._flush()
        return pa.concat_arrays(self.parts)


def _add(out: _Lists, chunks: T.ByChunk, text: str, start: int, last: int = 0) -> int:
    """Adds a text's tokens, which begin after a position, and returns the last one's (`last` without any)."""
    for c in chunks.chunks(text):
        terms, at, moved = chunks.of(c)
        if terms:
            out.terms += terms
            out.numbers.extend([start + p for p in at])
            last = start + at[-1]
        start += moved
    return last


def analysed(name: str, many: bool = False):
    """An Arrow-batched function from text (from an array of texts if many) to tokens, for analysers that need Python."""

    @F.arrow_udf(TOKENS)
    def run(values: pa.Array) -> pa.Array:
        chunks, out = languages.by_chunk(name), _Lists("pos", pa.int32())
        for v in values:
            s = v.as_py()
            if many:
                last = -GAP
                for one in s or ():
                    if one is not None:
                        last = _add(out, chunks, one, max(0, last + GAP), last)
            elif s is not None:
                _add(out, chunks, s, 0)
            out.end(s is None and not many)
        return out.all()

    return run.asNondeterministic()  # so that it is never inlined into a lambda


def counted_words(text: Column, analyzer: str) -> Column:
    """COUNTS of a text column by an analyser that needs Python."""

    @F.arrow_udf(COUNTS)
    def run(values: pa.Array) -> pa.Array:
        chunks, out = languages.by_chunk(analyzer), _Lists("n", pa.int64())
        for v in values:
            s = v.as_py()
            if s is not None:
                found = chunks.counts(s)
                out.terms += found
                out.numbers.extend(found.values())
            out.end(s is None)
        return out.all()

    return run(text)


def tokens(text: Column, analyzer: str, many: bool = False) -> Column:
    """Tokens of a text column (of an array of texts if many), native where the analyser is."""
    if analyzer in TERMS:
        make = TERMS[analyzer]
        one = lambda t: numbered(make(t))
        return joined(F.transform(F.filter(text, lambda v: v.isNotNull()), one)) if many else one(text)
    return analysed(analyzer, many)(text)


def any_of(conditions: list[Column]) -> Column:
    return reduce(lambda a, b: a | b, conditions, F.lit(False))
