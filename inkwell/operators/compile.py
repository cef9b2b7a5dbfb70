"""Query trees to one DataFrame plan.

All term leaves of a tree are read in one pass over the postings of the fields they name; each
posting adds its BM25 weight to the leaves that it belongs to, and one aggregation by document
gives every leaf a flag and a score, and a phrase the places of its terms. Predicates on typed
columns are Columns on the documents; those that every match must satisfy filter the scan. The
tree itself is then one Column expression over flags and scores: n clauses cost one shuffle, not
n joins. Statistics (document counts, lengths, document
frequencies of the terms read) are aggregates joined in; they are small and AQE broadcasts them.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, field
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import geo, languages
from ..functions import tokens as T
from . import query as Q
from .index import Index


@dataclass
class TermsLeaf:
    """Postings of a field whose term satisfies a condition, with a boost by term."""

    field: str
    accepts: Callable[[Column], Column]
    boost: Callable[[Column], Column] = lambda t: F.lit(1.0)


@dataclass
class Compiled:
    index: Index
    scored: bool = True
    terms: list[TermsLeaf] = field(default_factory=list)
    flags: list[Column] = field(default_factory=list)
    phrases: list[Column] = field(default_factory=list)  # which postings hold a phrase's terms
    everything: bool = False

    def leaf(self, leaf: TermsLeaf) -> tuple[Column, Column]:
        self.terms.append(leaf)
        k = len(self.terms) - 1
        score = F.coalesce(F.col(f"s{k}"), F.lit(0.0)) if self.scored else F.lit(0.0)
        return F.coalesce(F.col(f"m{k}"), F.lit(False)), score

    def flag(self, condition: Column, score: float = 1.0) -> tuple[Column, Column]:
        self.flags.append(F.coalesce(condition, F.lit(False)))
        return F.col(f"f{len(self.flags) - 1}"), F.lit(float(score))

    def phrase(self, name: str, slots: list[tuple[str, ...]], slop: int) -> Column:
        wanted = {t for s in slots for t in s}
        self.phrases.append((F.col("field") == name) & F.col("term").isin(*wanted))
        return F.coalesce(phrase(F.col(f"p{len(self.phrases) - 1}"), slots, slop), F.lit(False))


def edit_distance(a: str, b: str, most: int) -> int:
    """Optimal string alignment distance, or most + 1."""
    if abs(len(a) - len(b)) > most:
        return most + 1
    before: list[int] = []
    prev = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        row = [i]
        for j, y in enumerate(b, 1):
            d = min(prev[j] + 1, row[-1] + 1, prev[j - 1] + (x != y))
            if i > 1 and j > 1 and x == b[j - 2] and a[i - 2] == y:
                d = min(d, before[j - 2] + 1)
            row.append(d)
        before, prev = prev, row
    return min(prev[-1], most + 1)


def fuzzy_terms(index: Index, q: Q.Fuzzy) -> dict[str, int]:
    """Dictionary terms within the distance. A built-in bound selects; few terms reach the driver."""
    k = q.fuzziness

    def near(t: Column) -> Column:
        sized = t.startswith(q.term[: q.prefix]) & (F.abs(F.char_length(t) - len(q.term)) <= k)
        return sized & (F.levenshtein(t, F.lit(q.term), 2 * k) >= 0)  # a transposition is two plain edits

    found = index.dictionary(q.field, near).select("term")
    out = {r.term: edit_distance(r.term, q.term, k) for r in found.toLocalIterator()}
    return {t: d for t, d in out.items() if d <= k}


def walk(c: Compiled, q: Q.Query) -> tuple[Column, Column] | None:
    """(flag, score) Columns of a query; None where it can't match anything."""
    ix = c.index
    match q:
        case Q.Term():
            return c.leaf(TermsLeaf(q.field, lambda t: t == q.term, lambda t: F.lit(q.boost)))
        case Q.Match():
            found = [t.term for t in languages.analyzer(q.analyzer)(q.text)]
            if not found:
                return None
            if q.fuzziness:
                parts = tuple(Q.Fuzzy(t, q.field, q.fuzziness, q.prefix, q.boost) for t in found)
            else:
                parts = tuple(Q.Term(t, q.field, q.boost) for t in found)
            if q.operator == "and":
                return walk(c, Q.Boolean(must=parts, boost=q.boost))
            return walk(c, Q.Boolean(should=parts, min_should=1, boost=q.boost))
        case Q.Fuzzy():
            q.validate()
            if not q.fuzziness:
                return walk(c, Q.Term(q.term, q.field, q.boost))
            near = fuzzy_terms(ix, q)
            if not near:
                return None
            weight = {t: q.boost * (1 - d / max(1, min(len(t), len(q.term)))) for t, d in near.items()}
            pairs = F.create_map(*[F.lit(x) for kv in weight.items() for x in kv])
            return c.leaf(TermsLeaf(q.field, lambda t: t.isin(*weight), lambda t: pairs[t]))
        case Q.Prefix():
            return c.leaf(TermsLeaf(q.field, lambda t: t.startswith(q.prefix), lambda t: F.lit(q.boost)))
        case Q.Wildcard():
            return walk(c, Q.Regexp(q.regexp(), q.field, q.boost))
        case Q.Regexp():
            rx = q.pattern.removeprefix("^")
            lead = literal_prefix(rx)
            return c.leaf(
                TermsLeaf(q.field, lambda t: t.startswith(lead) & t.rlike(f"^(?s:{rx})$"), lambda t: F.lit(q.boost))
            )
        case Q.TermRange():
            def inside(t: Column) -> Column:
                low = (t >= q.low if q.include_low else t > q.low) if q.low else F.lit(True)
                high = (t <= q.high if q.include_high else t < q.high) if q.high else F.lit(True)
                return low & high

            return c.leaf(TermsLeaf(q.field, inside, lambda t: F.lit(q.boost)))
        case Q.MatchPhrase():
            found = languages.analyzer(q.analyzer)(q.text)
            if not found:
                return None
            at = T.positions(found)
            slots: list[list[str]] = [[] for _ in range(at[-1] - at[0] + 1)]
            for t, p in zip(found, at):
                slots[p - at[0]].append(t.term)
            return walk(c, Q.MultiPhrase(tuple(map(tuple, slots)), q.field, q.slop))
        case Q.MultiPhrase():
            q.validate()
            slots = [tuple(t for t in s if t) for s in q.terms]
            parts = [
                c.leaf(TermsLeaf(q.field, lambda t, s=s: t.isin(*s))) for s in slots if s
            ]
            if not parts:
                return None
            ok = c.phrase(q.field, slots, q.slop)
            return reduce(lambda a, b: a & b, (p[0] for p in parts), ok), reduce(lambda a, b: a + b, (p[1] for p in parts))
        case Q.NumericRange():
            return c.flag(condition(ix, q), q.boost)
        case Q.DateRange() | Q.GeoBox() | Q.GeoDistance() | Q.GeoPolygon():
            return c.flag(condition(ix, q))
        case Q.MatchAll():
            c.everything = True
            return F.lit(True), F.lit(1.0)
        case Q.MatchNone():
            return None
        case Q.Boolean():
            return boolean(c, q)
    raise TypeError(f"not a query: {q!r}")


def condition(ix: Index, q: Q.Query) -> Column | None:
    """The predicate of a query on a typed column, null where a document has no value."""
    match q:
        case Q.NumericRange():
            low, high = F.lit(q.low), F.lit(q.high)

            def number(v: Column) -> Column:
                a = v >= low if q.include_low else v > low
                if q.high == float("inf"):
                    return a
                return a & (v <= high if q.include_high else v < high)

            return ix.any_value(q.field, number)
        case Q.DateRange():
            q.validate()

            def day(v: Column) -> Column:
                a = F.lit(True) if q.start is None else v >= F.lit(q.start) if q.include_start else v > F.lit(q.start)
                b = F.lit(True) if q.end is None else v <= F.lit(q.end) if q.include_end else v < F.lit(q.end)
                return a & b

            return ix.any_value(q.field, day)
        case Q.GeoBox():
            return ix.any_value(q.field, lambda p: geo.in_box(p["lon"], p["lat"], q.left, q.top, q.right, q.bottom))
        case Q.GeoDistance():
            m = geo.parse_distance(q.distance)
            return ix.any_value(q.field, lambda p: geo.within_distance(p["lon"], p["lat"], (q.lon, q.lat), m))
        case Q.GeoPolygon():
            return ix.any_value(q.field, lambda p: geo.in_polygon(p["lon"], p["lat"], list(q.points)))
    return None


def required(ix: Index, q: Q.Query) -> list[Column]:
    """Bare predicates that every match satisfies, which the scan of the documents can take."""
    if isinstance(q, Q.Boolean):
        return [p for x in q.must for p in required(ix, x)]
    p = condition(ix, q)
    return [] if p is None else [p]


def literal_prefix(rx: str) -> str:
    """Plain characters that every match begins with."""
    if "|" in rx:
        return ""
    out = ""
    for i, ch in enumerate(rx):
        if not (ch.isalnum() or ch in " _-@"):
            return out[:-1] if ch in "*?{" and out else out
        out += ch
    return out


def boolean(c: Compiled, q: Q.Boolean) -> tuple[Column, Column] | None:
    must = [walk(c, x) for x in q.must]
    should = [walk(c, x) for x in q.should]
    must_not = [x for x in (walk(c, x) for x in q.must_not) if x]
    if None in must:
        return None
    some = [x for x in should if x]
    least = q.min_should if q.must else max(1, q.min_should) if q.should else 0
    if q.should and len(some) < least:
        return None
    if not q.must and not q.should:
        if not q.must_not:
            return None
        c.everything = True
        ok, score = F.lit(True), F.lit(1.0)
    else:
        ok, score = F.lit(True), F.lit(0.0)
        for flag, s in must:
            ok, score = ok & flag, score + s
        for flag, s in some:
            score = score + F.when(flag, s).otherwise(0.0)
        if least:
            ok = ok & (reduce(lambda a, b: a + b, (f.cast("int") for f, _ in some)) >= least)
    for flag, _ in must_not:
        ok = ok & ~flag
    return ok, score * F.lit(float(q.boost))


def phrase(tokens: Column, slots: list[tuple[str, ...]], slop: int) -> Column:
    """Whether a path through the slots exists: nested existence tests over token positions.

    Each slot's term follows the one before within the slop that is left; slots without terms
    move one place on; no occurrence is used twice; a path stays in one source field.
    """
    while slots and not slots[0]:
        slots = slots[1:]

    def step(toks: Column, k: int, at: Column, src: Column | None, left: Column, used: list[tuple[Column, int]]) -> Column:
        while k < len(slots) and not slots[k]:
            k, at = k + 1, at + 1
        if k >= len(slots):
            return F.lit(True)

        def fits(t: Column) -> Column:
            cost = F.abs(at + 1 - t["pos"])
            ok = t["term"].isin(*slots[k]) & (cost <= left)
            if src is not None:
                ok &= t["src"] == src
            for pos, j in used:
                if set(slots[j]) & set(slots[k]):
                    ok &= t["pos"] != pos
            return ok & step(toks, k + 1, t["pos"], src, left - cost, [*used, (t["pos"], k)])

        return F.exists(toks, fits)

    def begins(toks: Column) -> Column:
        return F.exists(
            toks,
            lambda t: t["term"].isin(*slots[0]) & step(toks, 1, t["pos"], t["src"], F.lit(slop), [(t["pos"], 0)]),
        )

    return F.exists(F.array(tokens), begins)


def idf(n_docs: Column, df: Column, kind: str) -> Column:
    ratio = (n_docs - df + 0.5) / (df + 0.5)
    return F.log(1 + ratio) if kind == "lucene" else F.log(1 + (n_docs - df) + 0.5 / (df + 0.5))


def bm25(tf: Column, dl: Column, avg: Column, weight: Column, k1: float, b: float) -> Column:
    i = 1 / (k1 * ((1 - b) + b * dl / avg))
    return weight - weight / (1 + tf * i)


def matches(index: Index, q: Q.Query, scored: bool = True, parts: bool = False) -> DataFrame:
    """doc_num and score of every match, in no order. parts: keep each leaf's score, s0, s1, .."""
    return _matches(index, q, scored, parts, False)


def matched_docs(index: Index, q: Q.Query, scored: bool = True) -> DataFrame:
    """Every match with all columns of its document: a query without terms only filters them."""
    return _matches(index, q, scored, False, True)


def _matches(index: Index, q: Q.Query, scored: bool, parts: bool, whole: bool) -> DataFrame:
    c = Compiled(index, scored)
    tree = walk(c, q)
    columns = index.docs.columns if whole else ["doc_num"]
    if tree is None:
        return index.docs.select(*_quoted(columns), F.lit(0.0).alias("score")).where(F.lit(False))
    ok, score = tree
    score = (score if scored else F.lit(0.0)).alias("score")
    found = _leaves(c) if c.terms else None
    if found is None or c.flags or c.everything:
        base = reduce(DataFrame.where, required(index, q), index.docs)
        base = base.select(*_quoted(columns), *(f.alias(f"f{k}") for k, f in enumerate(c.flags)))
        found = base if found is None else base.join(found, "doc_num", "left")
    elif whole:
        return found.where(ok).select("doc_num", score).join(index.docs, "doc_num").select(*_quoted(columns), "score")
    extra = [f"s{k}" for k in range(len(c.terms))] if parts and scored else []
    return found.where(ok).select(*_quoted(columns), score, *extra)


def _quoted(names: list[str]) -> list[str]:
    return [f"`{n}`" for n in names]


def _leaves(c: Compiled) -> DataFrame:
    """doc_num with the flag and score of each term leaf, and the tokens of each phrase's terms."""
    index, accepts = c.index, _accepting(c.terms)
    at = bool(c.phrases)
    hits = index.hits(accepts, at, shared=c.scored)
    mine = [(F.col("field") == x.field) & x.accepts(F.col("term")) for x in c.terms]
    aggs = [F.max(F.when(m, True)).alias(f"m{k}") for k, m in enumerate(mine)]
    if c.scored:
        hits = hits.join(index.weights(accepts, hits, at), ["field", "term"])
        avg = F.col("sum_ttf") / F.col("doc_count")
        for k, (x, m) in enumerate(zip(c.terms, mine)):
            sim = index.similarity_of(x.field)
            w = x.boost(F.col("term")) * idf(F.col("doc_count"), F.col("df"), sim.idf)
            aggs.append(F.sum(F.when(m, bm25(F.col("tf"), F.col("dl"), avg, w, sim.k1, sim.b))).alias(f"s{k}"))
    tokens = F.transform("at", lambda a: F.struct(F.col("term").alias("term"), a["pos"].alias("pos"), a["src"].alias("src")))
    aggs += [F.flatten(F.collect_list(F.when(m, tokens))).alias(f"p{k}") for k, m in enumerate(c.phrases)]
    return hits.groupBy("doc_num").agg(*aggs)


def _accepting(leaves: list[TermsLeaf]) -> dict[str, Callable[[Column], Column]]:
    by: dict[str, list] = {}
    for x in leaves:
        by.setdefault(x.field, []).append(x.accepts)

    def some(accepts: list) -> Callable[[Column], Column]:
        return lambda t: reduce(lambda x, y: x | y, (g(t) for g in accepts))

    return {f: some(a) for f, a in by.items()}


def multi_search(indexes: list[Index], q: Q.Query, scored: bool = True) -> DataFrame:
    """Matches of several indexes, each scored by its own statistics."""
    parts = [
        matches(ix, q, scored).select(F.lit(k).alias("index_ord"), "doc_num", "score") for k, ix in enumerate(indexes)
    ]
    return reduce(DataFrame.unionByName, parts)
