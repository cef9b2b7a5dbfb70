"""Highlighting of returned hits: fragments around matched terms, marked up.

Runs only on the few rows that a search returns, as one Arrow-batched function that analyses
the stored text again; nothing about offsets needs to be stored.
"""

from __future__ import annotations

import html
from collections.abc import Callable
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F

from ..functions import languages
from ..functions.tokens import frequencies
from . import query as Q


@dataclass(frozen=True)
class Formatter:
    before: str
    after: str
    escape: Callable[[str], str] = lambda s: s


HTML = Formatter("<mark>", "</mark>", lambda s: html.escape(s, quote=True).replace("&#x27;", "&#39;").replace("&quot;", "&#34;"))
ANSI = Formatter("\x1b[43m", "\x1b[0m")


def merge(spans: list[tuple[int, int]]) -> list[tuple[int, int]]:
    """Overlapping spans as one, in order."""
    out: list[tuple[int, int]] = []
    for a, b in sorted(spans):
        if out and a < out[-1][1]:
            out[-1] = (out[-1][0], max(b, out[-1][1]))
        else:
            out.append((a, b))
    return out


def windows(text: str, spans: list[tuple[int, int, str]], size: int) -> list[tuple[int, int]]:
    """A window of `size` characters centred on each location, shifted to lie in the text."""
    out = []
    for a, b, _ in spans:
        start = max(0, min((a + b - size) // 2, len(text) - size))
        window = (start, min(len(text), start + size))
        if window not in out:
            out.append(window)
    return out or [(0, min(len(text), size))]


def fragments(
    text: str, terms: set[str], analyzer: str, formatter: Formatter = HTML, best: int = 1, size: int = 200, separator: str = "…"
) -> list[str]:
    """The best fragments that don't overlap: those holding the most distinct terms."""
    data = text.encode()
    spans = [
        (len(data[: t.start].decode()), len(data[: t.end].decode()), t.term)
        for t in languages.analyzer(analyzer)(text)
        if t.term in terms
    ]
    scored = sorted(
        windows(text, spans, size), key=lambda w: (-len({t for a, b, t in spans if w[0] <= a and b <= w[1]}), w[0])
    )
    chosen: list[tuple[int, int]] = []
    for w in scored:
        if len(chosen) < best and all(w[1] <= c[0] or w[0] >= c[1] for c in chosen):
            chosen.append(w)
    out = []
    for lo, hi in chosen:
        s, at = "", lo
        for a, b in merge([(a, b) for a, b, _ in spans if lo <= a and b <= hi]):
            s += formatter.escape(text[at:a]) + formatter.before + formatter.escape(text[a:b]) + formatter.after
            at = b
        s += formatter.escape(text[at:hi])
        out.append((separator if lo > 0 else "") + s + (separator if hi < len(text) else ""))
    return out


def query_terms(q: Q.Query, field: str) -> set[str]:
    """The plain terms that a query looks for in a field (composites count)."""
    match q:
        case Q.Term():
            return {q.term} if q.field in (field, Q.DEFAULT_FIELD) else set()
        case Q.Match() | Q.MatchPhrase():
            return {t.term for t in languages.analyzer(q.analyzer)(q.text)} if q.field in (field, Q.DEFAULT_FIELD) else set()
        case Q.MultiPhrase():
            return {t for s in q.terms for t in s if t} if q.field in (field, Q.DEFAULT_FIELD) else set()
        case Q.Boolean():
            return set().union(*(query_terms(x, field) for x in (*q.must, *q.should)))
    return set()


def highlight(
    text: Column, terms: set[str], analyzer: str, formatter: Formatter = HTML, best: int = 1, size: int = 200
) -> Column:
    """array<string> of the best fragments of each text."""

    @F.arrow_udf("array<string>")
    def run(values: pa.Array) -> pa.Array:
        out = [None if s is None else fragments(s, terms, analyzer, formatter, best, size) for s in values.to_pylist()]
        return pa.array(out, pa.list_(pa.string()))

    return run(text)


def located(text: Column, terms: set[str], analyzer: str) -> Column:
    """array<struct<term,pos,start,end>> of the terms' occurrences; start and end are byte offsets."""
    kind = pa.struct([("term", pa.string()), ("pos", pa.int32()), ("start", pa.int32()), ("end", pa.int32())])

    @F.arrow_udf("array<struct<term:string,pos:int,start:int,end:int>>")
    def run(values: pa.Array) -> pa.Array:
        out = []
        for s in values.to_pylist():
            if s is None:
                out.append(None)
                continue
            found = frequencies(languages.analyzer(analyzer)(s))
            places = ((t, *x) for t in sorted(terms & found.keys()) for x in found[t])
            out.append([{"term": t, "pos": p, "start": a, "end": b} for t, p, a, b in places])
        return pa.array(out, pa.list_(kind))

    return run(text)
