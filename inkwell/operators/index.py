"""An index: documents with analysed fields, read as postings, token arrays or typed columns.

The same queries run on a DataFrame indexed on the fly (token arrays are computed by the scan,
and cut down to the query's terms before they are exploded) and on stored segments (postings
sorted by term, so that a scan prunes by statistics).
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, field, replace
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as ST

from ..functions import native

TEXT, KEYWORD, NUMERIC, DATE, GEO, COMPOSITE, STORED = "text keyword numeric date geo composite stored".split()
POSTING = ("field", "term", "doc_num", "tf", "dl")


@dataclass(frozen=True)
class FieldSpec:
    """How a column is indexed. A composite has no column: it repeats the tokens of others."""

    name: str
    kind: str = TEXT
    analyzer: str = "standard"
    column: str = ""
    include: tuple[str, ...] = ()
    exclude: tuple[str, ...] = ()

    @property
    def source(self) -> str:
        return self.column or self.name

    def takes(self, name: str) -> bool:
        return name not in self.exclude and (not self.include or name in self.include)


@dataclass(frozen=True)
class Similarity:
    """BM25 parameters; idf 'faithful' or 'lucene' (the textbook form)."""

    k1: float = 1.2
    b: float = 0.75
    idf: str = "faithful"


def infer_fields(df: DataFrame, analyzer: str = "standard") -> tuple[FieldSpec, ...]:
    """A field for every column that can be one, and _all over the text fields."""
    out = []
    for f in df.schema.fields:
        t = f.dataType.elementType if isinstance(f.dataType, ST.ArrayType) else f.dataType
        if isinstance(t, ST.StringType):
            out.append(FieldSpec(f.name, TEXT, analyzer))
        elif isinstance(t, ST.NumericType):
            out.append(FieldSpec(f.name, NUMERIC))
        elif isinstance(t, (ST.TimestampType, ST.DateType)):
            out.append(FieldSpec(f.name, DATE))
        elif isinstance(t, ST.StructType) and {"lon", "lat"} <= set(t.names):
            out.append(FieldSpec(f.name, GEO))
    return (*out, FieldSpec("_all", COMPOSITE, exclude=("_id",)))


def _placed(tokens: Column) -> Column:
    """Of a token array each distinct term with its frequency and places, by a sort in the row."""
    ordered = F.sort_array(F.transform(tokens, lambda t, i: F.struct(t["term"].alias("term"), i.alias("i"), t["pos"].alias("pos"), t["src"].alias("src"))))

    def posting(a: Column, i: Column, n: Column) -> Column:
        at = F.transform(F.slice(a, i + 1, n), lambda t: F.struct(t["pos"].alias("pos"), t["src"].alias("src")))
        return F.struct(F.get(a, i)["term"].alias("term"), n.alias("tf"), at.alias("at"))

    return native.runs(ordered, lambda t: t["term"], posting)


@dataclass(frozen=True)
class Index:
    """docs has doc_num, id, the columns, and token columns where they are stored."""

    docs: DataFrame
    fields: dict[str, FieldSpec]
    similarity: Similarity = Similarity()
    postings: DataFrame | None = None
    stored_tokens: tuple[str, ...] = ()
    stats: DataFrame | None = field(default=None, compare=False)
    by_field: dict[str, Similarity] = field(default_factory=dict)

    @staticmethod
    def of(
        df: DataFrame, id_col: str, fields: tuple[FieldSpec, ...] | None = None,
        similarity: Similarity = Similarity(), doc_num: Column | None = None,
    ) -> "Index":
        """df indexed as it is read. doc_num breaks ties: the id if it is an integer, else row order."""
        specs = fields or infer_fields(df)
        if doc_num is None:
            whole = isinstance(df.schema[id_col].dataType, ST.IntegralType)
            doc_num = F.col(id_col).cast("long") if whole else F.monotonically_increasing_id()
        docs = df.withColumns({"doc_num": doc_num, "_id": F.col(id_col).cast("string")})
        known = {"_id": FieldSpec("_id", KEYWORD, "keyword")} | {s.name: s for s in specs}
        # Analysers in Python get a column of their own, as lambdas can't hold them; a query that
        # doesn't read the field prunes it.
        python = [s for s in known.values() if s.kind == TEXT and s.analyzer not in native.TERMS]
        many = {s.name: isinstance(df.schema[s.source].dataType, ST.ArrayType) for s in python}
        docs = docs.withColumns(
            {f"__tok_{s.name}": native.tokens(F.col(f"`{s.source}`"), s.analyzer, many[s.name]) for s in python}
        )
        return Index(docs, known, similarity, stored_tokens=tuple(s.name for s in python))

    def with_similarity(self, similarity: Similarity, name: str | None = None) -> "Index":
        """Another similarity for all fields, or for one."""
        if name is None:
            return replace(self, similarity=similarity)
        return replace(self, by_field={**self.by_field, name: similarity})

    def similarity_of(self, name: str) -> Similarity:
        return self.by_field.get(name, self.similarity)

    # --- columns on docs -------------------------------------------------------------------

    def is_many(self, column: str) -> bool:
        return isinstance(self.docs.schema[column].dataType, ST.ArrayType)

    def _parts(self, name: str) -> list[FieldSpec]:
        """The fields that a field's tokens come from: of a composite those that it takes."""
        spec = self.fields.get(name)
        if spec and spec.kind == COMPOSITE:
            return [s for s in self.fields.values() if s.kind in (TEXT, KEYWORD) and spec.takes(s.name)]
        return [spec] if spec else []

    def plain(self, spec: FieldSpec) -> Column:
        """array<struct<term,pos>> of a field that isn't composite, null where it has no value."""
        if spec.name in self.stored_tokens:
            return F.col(f"__tok_{spec.name}")
        analyzer = "keyword" if spec.kind == KEYWORD else spec.analyzer
        return native.tokens(F.col(f"`{spec.source}`"), analyzer, self.is_many(spec.source))

    def tokens(self, name: str) -> Column:
        """array<struct<term,pos,src>> of a field; empty where it has no value."""
        none = F.array().cast("array<struct<term:string,pos:int,src:string>>")

        def of(s: FieldSpec) -> Column:
            one = lambda t: F.struct(t["term"].alias("term"), t["pos"].alias("pos"), F.lit(s.name).alias("src"))
            return F.coalesce(F.transform(self.plain(s), one), none)

        parts = [of(s) for s in self._parts(name)]
        return F.concat(*parts) if len(parts) > 1 else parts[0] if parts else none

    def terms(self, name: str) -> Column:
        """The terms of tokens(), without building these."""
        none = F.array().cast("array<string>")

        def of(s: FieldSpec) -> Column:
            analyzer = "keyword" if s.kind == KEYWORD else s.analyzer
            if s.name in self.stored_tokens or self.is_many(s.source):
                return F.transform(self.plain(s), lambda t: t["term"])
            return native.TERMS[analyzer](F.col(f"`{s.source}`"))

        parts = [F.coalesce(of(s), none) for s in self._parts(name)]
        return F.concat(*parts) if len(parts) > 1 else parts[0] if parts else none

    def length(self, name: str) -> Column:
        """Tokens of a field; of a stored one a number beside the document, not its tokens."""
        spec = self.fields.get(name)
        if spec and spec.kind == COMPOSITE:
            parts = [s.name for s in self.fields.values() if s.kind in (TEXT, KEYWORD) and spec.takes(s.name)]
            return reduce(lambda a, b: a + b, map(self.length, parts), F.lit(0))
        if f"__len_{name}" in self.docs.columns:
            return F.col(f"__len_{name}")
        return F.size(self.terms(name))

    def any_value(self, name: str, ok: Callable[[Column], Column]) -> Column:
        if name not in self.fields:
            return F.lit(False)
        c = self.fields[name].source
        return F.exists(F.col(f"`{c}`"), ok) if self.is_many(c) else ok(F.col(f"`{c}`"))

    def values(self, name: str) -> Column:
        """A field's distinct values as an array: of a text field its terms."""
        spec = self.fields[name]
        if spec.kind == TEXT:
            return F.array_distinct(self.terms(name))
        c = F.col(f"`{spec.source}`")
        return F.array_distinct(F.filter(c, lambda v: v.isNotNull())) if self.is_many(spec.source) else F.when(c.isNotNull(), F.array(c)).otherwise(F.array().cast(ST.ArrayType(self.docs.schema[spec.source].dataType)))

    # --- postings --------------------------------------------------------------------------

    def hits(self, accepts: dict[str, Callable[[Column], Column]], at: bool = False, shared: bool = False) -> DataFrame:
        """field, term, doc_num, tf, dl of the postings that a field's condition accepts; at: with
        `at`, the position and source field of each occurrence. shared: weights() are wanted too."""
        if self.postings is not None:
            ok = reduce(
                lambda a, b: a | b, ((F.col("field") == f) & accept(F.col("term")) for f, accept in accepts.items())
            )
            return self.postings.where(ok).select(*POSTING, *(["at"] if at else []))
        return reduce(DataFrame.unionAll, (self._scan(f, accept, at, shared) for f, accept in accepts.items()))

    def _accepted(self, name: str, accept: Callable[[Column], Column] | None, at: bool, shared: bool) -> DataFrame:
        """doc_num, dl and t, the accepted terms (tokens if at) of every document.

        Shared, it ends in an exchange that Spark reuses: postings and weights come from one
        analysis of the texts. Both read all of its columns.
        """
        base = self.docs.select("doc_num", (self.tokens(name) if at else self.terms(name)).alias("t"))
        mine = F.filter("t", (lambda t: accept(t["term"])) if at else accept) if accept else F.col("t")
        base = base.select("doc_num", F.size("t").alias("dl"), mine.alias("t"))
        return base.repartition("doc_num") if shared else base

    def _scan(self, name: str, accept: Callable[[Column], Column] | None, at: bool = False, shared: bool = False) -> DataFrame:
        out = [F.lit(name).alias("field"), *POSTING[1:], *(["at"] if at else [])]
        base = self._accepted(name, accept, at, shared)
        base = base.select("doc_num", "dl", (_placed(F.col("t")) if at else native.counted(F.col("t"))).alias("c"))
        # An inner inline would be filtered by its input's size, for which that is computed again.
        rows = base.select("doc_num", "dl", F.inline_outer("c").alias("term", "tf", *(["at"] if at else []))).where(F.col("tf").isNotNull())
        return rows.withColumn("tf", F.col("tf").cast("int")).select(*out)

    def all_postings(self, name: str) -> DataFrame:
        if self.postings is not None:
            return self.postings.where(F.col("field") == name)
        return self._scan(name, None, True)

    def located(self, name: str) -> DataFrame:
        """term, doc_num, src, pos of every token of a field."""
        return self.docs.select("doc_num", F.inline(self.tokens(name))).select("term", "doc_num", "src", "pos")

    def field_stats(self, names: list[str]) -> DataFrame:
        """field, doc_count (documents with the field), sum_ttf, total_docs."""
        if self.stats is not None:
            return self.stats.where(F.col("field").isin(*names))
        aggs = []
        for k, n in enumerate(names):
            size = self.length(n)
            aggs += [F.count_if(size > 0).alias(f"c{k}"), F.coalesce(F.sum(size), F.lit(0)).cast("long").alias(f"t{k}")]
        one = self.docs.agg(F.count(F.lit(1)).alias("total_docs"), *aggs)
        rows = F.array(
            *(
                F.struct(F.lit(n).alias("field"), F.col(f"c{k}").alias("doc_count"), F.col(f"t{k}").alias("sum_ttf"), "total_docs")
                for k, n in enumerate(names)
            )
        )
        return one.select(F.inline(rows))

    def weights(self, accepts: dict[str, Callable[[Column], Column]], hits: DataFrame, at: bool = False) -> DataFrame:
        """field, term, df, doc_count, sum_ttf of the accepted terms: all that scores need. hits: what
        hits() gives, with the same `at` and shared.

        Without stored postings one pass gives both: every document adds its length under the
        null term, and itself under each of its accepted terms; tasks send a row a term.
        """
        if self.postings is not None:
            return self.frequencies(hits).join(self.field_stats(list(accepts)).drop("total_docs"), "field")
        parts = []
        for name, accept in accepts.items():
            mine = F.transform("t", lambda t: t["term"]) if at else F.col("t")
            mine = F.concat(F.array(F.lit(None).cast("string")), F.array_distinct(mine))
            rows = self._accepted(name, accept, at, True).select("dl", F.explode(mine).alias("term"))
            parts.append(
                rows.groupBy("term")
                .agg(F.count_if(F.col("dl") > 0).alias("df"), F.sum("dl").cast("long").alias("dls"))
                .select(F.lit(name).alias("field"), "term", "df", "dls")
            )
        w = Window.partitionBy("field")
        whole = F.col("term").isNull()
        return (
            reduce(DataFrame.unionAll, parts)
            .select(
                "field", "term", "df",
                F.max(F.when(whole, F.col("df"))).over(w).alias("doc_count"),
                F.max(F.when(whole, F.col("dls"))).over(w).alias("sum_ttf"),
            )
            .where(~whole)
        )

    def frequencies(self, hits: DataFrame) -> DataFrame:
        return hits.groupBy("field", "term").agg(F.count(F.lit(1)).alias("df"))

    def dictionary(
        self, name: str, condition: Callable[[Column], Column] | None = None, start: str = "", end: str = "", pattern: str = ""
    ) -> DataFrame:
        """term and df of a field's terms in [start, end), matching a pattern as a whole."""

        def ok(t: Column) -> Column:
            kept = condition(t) if condition else F.lit(True)
            if start:
                kept &= t >= start
            if end:
                kept &= t < end
            if pattern:
                kept &= t.rlike(f"^(?s:{pattern})$")
            return kept

        if self.postings is not None:
            rows = self.postings.where((F.col("field") == name) & ok(F.col("term")))
        else:
            rows = self.docs.select(F.explode(F.array_distinct(F.filter(self.terms(name), ok))).alias("term"))
        return rows.groupBy("term").agg(F.count(F.lit(1)).alias("df"))

    def count(self) -> int:
        return self.docs.count()

    def field_names(self) -> list[str]:
        return sorted(self.fields)
