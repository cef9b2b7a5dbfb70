"""Aggregations over all matches: metrics, buckets and their nesting, each one groupBy.

Value sources are Columns on the matched documents (see `source`); multi-valued fields are
arrays, of which every value counts.
"""

from __future__ import annotations

import datetime as dt
import math
import time
from collections.abc import Callable
from dataclasses import dataclass, field, replace

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as ST

from . import query as Q
from .compile import matched_docs
from .index import Index


@dataclass(frozen=True)
class Metric:
    """kind: count, sum, min, max, avg, cardinality, quantile. of: a source Column (an array)."""

    kind: str
    of: Column | None = None
    weight: Column | None = None
    start: float | None = None
    points: tuple[float, ...] = ()
    exact: bool = False

    def column(self) -> Column:
        """The aggregate over rows that hold arrays of values."""
        if self.kind == "count":
            return F.count(F.lit(1))
        v = self.of
        add = lambda a, x: a + x
        zero = F.lit(0.0)
        numbers = F.transform(v, lambda x: x.cast("double")) if self.kind not in ("cardinality",) else v
        total = F.sum(F.aggregate(numbers, zero, add)) if self.kind in ("sum", "avg") else None
        if self.kind == "sum":
            return F.coalesce(total, zero)
        if self.kind == "min":
            return F.coalesce(F.min(F.array_min(numbers)), F.lit(math.inf))
        if self.kind == "max":
            most = F.coalesce(F.max(F.array_max(numbers)), F.lit(-math.inf))
            return most if self.start is None else F.greatest(most, F.lit(float(self.start)))
        if self.kind == "avg":
            w = F.lit(1.0) if self.weight is None else F.coalesce(self.weight.cast("double"), F.lit(1.0))
            top = F.sum(F.aggregate(numbers, zero, add) * w)
            below = F.sum(F.size(numbers) * w)
            return F.when(below != 0, top / below).otherwise(F.lit(math.nan))
        raise ValueError(f"no metric {self.kind!r}")


def count() -> Metric:
    return Metric("count")


def total(of: Column) -> Metric:
    return Metric("sum", of)


def least(of: Column) -> Metric:
    return Metric("min", of)


def most(of: Column, start: float | None = None) -> Metric:
    return Metric("max", of, start=start)


def average(of: Column, weight: Column | None = None) -> Metric:
    """(Weighted) mean; NaN of nothing."""
    return Metric("avg", of, weight)


def cardinality(of: Column, exact: bool = False) -> Metric:
    return Metric("cardinality", of, exact=exact)


def quantiles(of: Column, points: tuple[float, ...], exact: bool = False) -> Metric:
    return Metric("quantile", of, points=points, exact=exact)


@dataclass(frozen=True)
class Range:
    """[low, high); a missing end is open."""

    low: float | dt.datetime | None = None
    high: float | dt.datetime | None = None
    name: str = ""

    def title(self) -> str:
        if self.name:
            return self.name
        if any(isinstance(x, dt.datetime) for x in (self.low, self.high)):
            say = lambda x: "" if x is None else x.strftime("%Y-%m-%dT%H:%M:%SZ")
        else:
            say = lambda x: f"{x:f}"
            return f"[{say(-math.inf if self.low is None else self.low)},{say(math.inf if self.high is None else self.high)})"
        return f"[{say(self.low)},{say(self.high)})"

    def holds(self, v: Column) -> Column:
        ok = v.isNotNull()
        if self.low is not None:
            ok &= v >= F.lit(self.low)
        if self.high is not None:
            ok &= v < F.lit(self.high)
        return ok


@dataclass(frozen=True)
class Buckets:
    """terms (ranges empty) or ranges over a source, with metrics and nested buckets."""

    of: Column
    size: int = 10
    ranges: tuple[Range, ...] = ()
    metrics: dict[str, Metric] = field(default_factory=dict)
    nested: dict[str, "Buckets"] = field(default_factory=dict)

    def with_nested(self, name: str, b: "Buckets") -> "Buckets":
        return replace(self, nested={**self.nested, name: b})


def source(index: Index, name: str) -> Column:
    """A field's values as an array."""
    return index.values(name)


def filtered(of: Column, keep: Callable[[Column], Column]) -> Column:
    return F.filter(of, keep)


def missing(of: Column, value) -> Column:
    """A source with a value for documents that have none."""
    return F.when(F.size(of) > 0, of).otherwise(F.array(F.lit(value)))


def _about_distinct(v: Column) -> Column:
    """A sketch's distinct count, with a standard error of 0.4 %.

    Its buffer is one binary of 64 kB at most. That of approx_count_distinct is a column for every
    ten registers, copied field by field.
    """
    hashed = F.when(v.isNotNull(), F.xxhash64(v))
    return F.hll_sketch_estimate(F.hll_sketch_agg(hashed, 16))


def metrics_of(rows: DataFrame, by: list[str], metrics: dict[str, Metric]) -> DataFrame:
    """Metrics a group. Distinct counts and quantiles explode their values first, by themselves."""
    plain = {n: m for n, m in metrics.items() if m.kind not in ("cardinality", "quantile")}
    out = rows.groupBy(*by).agg(F.count(F.lit(1)).alias("count"), *(m.column().alias(n) for n, m in plain.items()))
    for n, m in metrics.items():
        if n in plain:
            continue
        values = rows.select(*by, F.explode_outer(m.of).alias("v"))
        if m.kind == "cardinality":
            agg = F.count_distinct("v") if m.exact else _about_distinct(F.col("v"))
        else:
            points = F.array(*map(F.lit, m.points))
            agg = F.percentile("v", points) if m.exact else F.percentile_approx("v", points, 10_000)
        part = values.groupBy(*by).agg(agg.alias(n))
        if not by:
            out = out.withColumn(n, part.scalar())
            continue
        on = [F.col(f"a.{b}").eqNullSafe(F.col(f"b.{b}")) for b in by]
        out = out.alias("a").join(part.alias("b"), on, "left").select("a.*", f"b.{n}")
    return out


def aggregate(rows: DataFrame, buckets: Buckets, by: tuple[str, ...] = (), name: str = "bucket") -> dict[str, DataFrame]:
    """DataFrames by path ('' for these buckets, 'child', 'child/grandchild'), one row a bucket.

    rows are matched documents. A bucket's columns: those of its parents, `name`, count and the
    metrics; for terms `other`, matches less the counts of the buckets kept.
    """
    keys = list(by)
    if buckets.ranges:
        held = F.filter(
            F.array(*(F.when(F.exists(buckets.of, r.holds), F.lit(r.title())) for r in buckets.ranges)),
            lambda x: x.isNotNull(),
        )
        exploded = rows.select("*", F.explode(held).alias(name))
        out = metrics_of(exploded, [*keys, name], buckets.metrics)
        if not keys:  # empty ranges are reported too
            spark = rows.sparkSession
            names = spark.createDataFrame([(i, r.title()) for i, r in enumerate(buckets.ranges)], f"ord int, {name} string")
            empty = metrics_of(rows.limit(0), [], buckets.metrics)
            fill = [F.coalesce(F.col(c), empty.select(c).scalar()).alias(c) for c in ("count", *buckets.metrics)]
            out = names.join(out, name, "left").orderBy("ord").select(name, *fill)
    else:
        exploded = rows.select("*", F.explode(buckets.of).alias(name))
        out = metrics_of(exploded, [*keys, name], buckets.metrics)
        every = rows.groupBy(*keys).agg(F.count(F.lit(1)).alias("__all"))
        if keys:
            from pyspark.sql import Window

            w = Window.partitionBy(*keys).orderBy(F.col("count").desc(), name)
            out = out.withColumn("__r", F.row_number().over(w)).where(F.col("__r") <= buckets.size).drop("__r")
            kept = out.groupBy(*keys).agg(F.sum("count").alias("__kept"))
            out = out.join(every, keys).join(kept, keys)
        else:
            out = out.orderBy(F.col("count").desc(), name).limit(buckets.size)
            kept = out.agg(F.coalesce(F.sum("count"), F.lit(0)).alias("__kept"))
            out = out.withColumn("__all", every.scalar()).withColumn("__kept", kept.scalar())
        out = out.withColumn("other", F.col("__all") - F.col("__kept")).drop("__all", "__kept")
        if not keys:
            out = out.orderBy(F.col("count").desc(), name)
    result = {"": out}
    for child, b in buckets.nested.items():
        inside = exploded.join(out.select(*keys, name), [*keys, name], "left_semi")
        for path, df in aggregate(inside, b, (*keys, name), child).items():
            result[f"{child}/{path}".rstrip("/")] = df
    return result


def matched(index: Index, q: Q.Query) -> DataFrame:
    """Matches with their documents, the rows that aggregations read."""
    return matched_docs(index, q)


def standard(rows: DataFrame) -> DataFrame:
    """count and max_score (0 at least) of matches."""
    return rows.agg(F.count(F.lit(1)).alias("count"), F.greatest(F.coalesce(F.max("score"), F.lit(0.0)), F.lit(0.0)).alias("max_score"))


def timed(action: Callable[[], object]) -> tuple[object, float]:
    """What an action returns, and the seconds that it took."""
    start = time.monotonic()
    result = action()
    return result, time.monotonic() - start
