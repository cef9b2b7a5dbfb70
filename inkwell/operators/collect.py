"""Collectors: sorting, top-n, paging, all matches, explanations."""

from __future__ import annotations

from dataclasses import dataclass, field
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import query as Q
from .compile import Compiled, idf, matched_docs, matches, walk
from .index import KEYWORD, TEXT, Index


@dataclass(frozen=True)
class Search:
    """A request. sort: SortKeys or strings ('-name', '_score'); after / before: key values."""

    query: Q.Query
    n: int | None = 10
    start: int = 0
    sort: tuple = ("-_score",)
    after: tuple | None = None
    before: tuple | None = None
    scored: bool = True
    select: tuple[str, ...] = ()
    explain: bool = False
    keys: tuple[Q.SortKey, ...] = field(init=False)

    def __post_init__(self):
        keys = tuple(Q.SortKey.parse(k) if isinstance(k, str) else k for k in self.sort)
        object.__setattr__(self, "keys", keys)


def sort_value(index: Index, key: Q.SortKey) -> Column:
    """A document's sort value: of several the least."""
    if key.expr is not None:
        return key.expr
    if key.name == "_score":
        return F.col("score")
    if key.name not in index.fields:
        return F.lit(None).cast("string")
    spec = index.fields[key.name]
    if spec.kind == TEXT or index.is_many(spec.source):
        return F.array_min(index.values(key.name))
    return F.col(f"`{spec.source}`").cast("string" if spec.kind == KEYWORD else index.docs.schema[spec.source].dataType)


def ordering(keys: tuple[Q.SortKey, ...], flip: bool = False) -> list[Column]:
    out = []
    for i, k in enumerate(keys):
        c, desc, first = F.col(f"k{i}"), k.desc != flip, k.missing_first != flip
        if desc:
            out.append(c.desc_nulls_first() if first else c.desc_nulls_last())
        else:
            out.append(c.asc_nulls_first() if first else c.asc_nulls_last())
    return out


def beyond(keys: tuple[Q.SortKey, ...], values: tuple, flip: bool) -> Column:
    """Sort keys strictly after the values (before them if flip); ties of all keys are left out."""
    out, tie = F.lit(False), F.lit(True)
    for i, (k, v) in enumerate(zip(keys, values)):
        c, desc, first = F.col(f"k{i}"), k.desc != flip, k.missing_first != flip
        if v is None:
            later = c.isNotNull() if first else F.lit(False)
            same = c.isNull()
        else:
            later = (c < F.lit(v)) if desc else (c > F.lit(v))
            later = F.coalesce(later, F.lit(not first))
            same = F.coalesce(c == F.lit(v), F.lit(False))
        out, tie = out | (tie & later), tie & same
    return out


def search(index: Index, request: Search) -> DataFrame:
    """The hits in order: doc_num, _id, score, the selected columns."""
    by_score = len(request.keys) == 1 and request.keys[0].name == "_score" and request.keys[0].expr is None
    if by_score and request.after is None and request.before is None:
        # Only the hits that are returned meet the document columns.
        found = matches(index, request.query, request.scored)
        top = found.orderBy(F.col("score").desc() if request.keys[0].desc else F.col("score"), "doc_num")
        top = page(top, request)
        cols = ["doc_num", "score", "_id", *request.select]
        out = top.join(index.docs.select("doc_num", "_id", *request.select), "doc_num").select(*cols)
        return explained(index, request, out).orderBy(
            F.col("score").desc() if request.keys[0].desc else F.col("score"), "doc_num"
        )
    rows = matched_docs(index, request.query, request.scored).select(
        "*", *(sort_value(index, k).alias(f"k{i}") for i, k in enumerate(request.keys))
    )
    if request.before is not None:
        rows = rows.where(beyond(request.keys, request.before, True))
        rows = page(rows.orderBy(*ordering(request.keys, True), F.col("doc_num").desc()), request)
        rows = rows.orderBy(*ordering(request.keys), "doc_num")
    else:
        if request.after is not None:
            rows = rows.where(beyond(request.keys, request.after, False))
        rows = page(rows.orderBy(*ordering(request.keys), "doc_num"), request)
    return explained(index, request, rows.select("doc_num", "score", "_id", *request.select, *(f"k{i}" for i in range(len(request.keys)))))


def page(rows: DataFrame, request: Search) -> DataFrame:
    if request.start:
        rows = rows.offset(request.start)
    return rows if request.n is None else rows.limit(request.n)


def all_matches(index: Index, q: Q.Query, scored: bool = True) -> DataFrame:
    """Every match, in no order: the stream that aggregations consume."""
    return matches(index, q, scored)


def explained(index: Index, request: Search, rows: DataFrame) -> DataFrame:
    """With a JSON tree of each returned hit's score, if asked for."""
    if not request.explain:
        return rows
    c = Compiled(index)
    walk(c, request.query)
    parts = matches(index, request.query, True, parts=True).drop("score")
    leaf = [
        F.struct(F.col(f"s{k}").alias("value"), F.lit(f"weight of clause {k} in {x.field}, bm25").alias("message"))
        for k, x in enumerate(c.terms)
    ]
    children = F.filter(F.array(*leaf), lambda x: x["value"].isNotNull()) if leaf else F.array()
    tree = F.to_json(F.struct(F.col("score").alias("value"), F.lit("sum of").alias("message"), children.alias("children")))
    return rows.join(parts, "doc_num").withColumn("explanation", tree).drop(*(f"s{k}" for k in range(len(leaf))))


def locations(index: Index, q: Q.Query, hits: DataFrame) -> DataFrame:
    """field, term and positions of the query's terms in the given hits (doc_num)."""
    c = Compiled(index, False)
    walk(c, q)
    docs = index.docs.join(hits.select("doc_num"), "doc_num")
    parts = []
    for x in c.terms:
        accepts = x.accepts
        found = F.filter(index.tokens(x.field), lambda t: accepts(t["term"]))
        parts.append(docs.select("doc_num", F.lit(x.field).alias("field"), F.inline(found)))
    rows = reduce(DataFrame.unionByName, parts)
    return rows.groupBy("doc_num", "field", "src", "term").agg(F.sort_array(F.collect_set("pos")).alias("positions"))


__all__ = ["Search", "search", "all_matches", "locations", "idf"]
