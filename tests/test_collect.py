"""Sorting, paging, aggregations, highlighting."""

import datetime as dt
import math

import pytest
from pyspark.sql import functions as F

from inkwell.operators import aggs as A
from inkwell.operators import query as Q
from inkwell.operators.collect import Search, locations, search
from inkwell.operators.highlight import fragments, highlight, located, query_terms
from inkwell.operators.index import DATE, KEYWORD, NUMERIC, TEXT, FieldSpec, Index, Similarity


@pytest.fixture(scope="module")
def six(spark):
    rows = [
        ("a", "marty", 19.0, dt.datetime(2014, 11, 25), ["gopher", "belieber"]),
        ("b", "steve", 21.0, dt.datetime(2000, 9, 11), ["thought-leader", "futurist"]),
        ("c", "aster", 21.0, dt.datetime(1954, 2, 2), ["red", "blue", "green"]),
        ("d", None, 65.0, dt.datetime(1978, 12, 2), ["cats"]),
        ("e", "nancy", None, dt.datetime(1954, 10, 22), ["pain"]),
        ("f", "frank", 1.0, None, ["vitamin", "purple"]),
    ]
    df = spark.createDataFrame(rows, "id string, name string, age double, born timestamp, tags array<string>")
    fields = (FieldSpec("name"), FieldSpec("age", NUMERIC), FieldSpec("born", DATE), FieldSpec("tags", KEYWORD))
    return Index.of(df, "id", fields, doc_num=F.ascii("id").cast("long"))


@pytest.mark.parametrize(
    "sort,want",
    [
        (("name",), "cfaebd"),
        (("-name",), "beafcd"),
        ((Q.SortKey("name", True, True),), "dbeafc"),
        (("age", "_id"), "fabcde"),
        (("-_id",), "fedcba"),
        (("tags",), "acdbef"),
        (("-born", "_id"), "abdecf"),
        (("age", "name"), "facbde"),
    ],
)
def test_sorts(six, sort, want):
    assert "".join(r["_id"] for r in search(six, Search(Q.MatchAll(), sort=sort)).collect()) == want


@pytest.mark.parametrize(
    "kw,want",
    [
        ({"sort": ("name",), "after": ("marty",)}, "ebd"),
        ({"sort": ("name",), "before": ("nancy",)}, "cfa"),
        ({"sort": ("_id",), "after": ("d",)}, "ef"),
        ({"sort": ("_id",), "before": ("d",)}, "abc"),
        ({"sort": ("_id",), "before": ("d",), "n": 2}, "bc"),
        ({"sort": ("_id",), "start": 2, "n": 3}, "cde"),
        ({"n": 0}, ""),
    ],
)
def test_pages(six, kw, want):
    assert "".join(r["_id"] for r in search(six, Search(Q.MatchAll(), **kw)).collect()) == want


def test_pages_tile_the_order(six):
    keys, got = ("age", "_id"), []
    every = [r["_id"] for r in search(six, Search(Q.MatchAll(), sort=keys)).collect()]
    after = None
    while rows := search(six, Search(Q.MatchAll(), n=2, sort=keys, after=after)).collect():
        got += [r["_id"] for r in rows]
        after = (rows[-1].k0, rows[-1].k1)
    assert got == every


@pytest.fixture(scope="module")
def stock(spark):
    d = dt.datetime
    rows = [
        ("a", "book", d(2014, 11, 25), 2.0), ("b", "book", d(2013, 7, 25), 7.0), ("c", "book", d(2014, 3, 3), 1.0),
        ("d", "book", d(2014, 9, 16), 9.0), ("e", "book", d(2014, 11, 15), 5.0), ("f", "movie", d(2017, 6, 5), 3.0),
        ("g", "movie", d(2011, 10, 3), 9.0), ("h", "movie", d(2019, 8, 2), 9.0), ("h", "movie", d(2014, 12, 14), 1.0),
        ("i", "game", d(2013, 10, 20), 9.0),
    ]
    df = spark.createDataFrame(rows, "id string, type string, updated timestamp, rating double")
    return Index.of(df, "id", (FieldSpec("type"), FieldSpec("updated", DATE), FieldSpec("rating", NUMERIC)))


def test_buckets(stock):
    rows = A.matched(stock, Q.MatchAll())
    assert A.standard(rows).first().asDict() == {"count": 10, "max_score": 1.0}
    rating = A.source(stock, "rating")
    high = A.Buckets(rating, ranges=(A.Range(None, 5.0, "low"), A.Range(5.0, None, "high"), A.Range(50.0, None, "none")))
    by_type = A.Buckets(A.source(stock, "type"), 2, metrics={"top": A.most(rating), "mean": A.average(rating)}).with_nested("r", high)
    out = A.aggregate(rows, by_type)
    assert [(r.bucket, r["count"], r.top, r.other) for r in out[""].collect()] == [("book", 5, 9.0, 1), ("movie", 4, 9.0, 1)]
    nested = {(r.bucket, r.r): r["count"] for r in out["r"].collect()}
    assert nested == {("book", "low"): 2, ("book", "high"): 3, ("movie", "low"): 2, ("movie", "high"): 2}
    assert [(r.bucket, r["count"]) for r in A.aggregate(rows, high)[""].collect()] == [("low", 4), ("high", 6), ("none", 0)]
    cut = dt.datetime(2012, 1, 1)
    dates = A.Buckets(A.source(stock, "updated"), ranges=(A.Range(None, cut, "old"), A.Range(cut, None, "new")))
    assert [(r.bucket, r["count"]) for r in A.aggregate(rows, dates)[""].collect()] == [("old", 1), ("new", 9)]


def test_metrics(stock):
    rows, rating = A.matched(stock, Q.MatchAll()), A.source(stock, "rating")
    m = {
        "n": A.count(), "sum": A.total(rating), "lo": A.least(rating), "hi": A.most(rating, 100.0), "mean": A.average(rating),
        "kinds": A.cardinality(A.source(stock, "type")), "q": A.quantiles(rating, (0.5,), exact=True),
        "few": A.total(A.filtered(rating, lambda v: v > 8)),
    }
    r = A.metrics_of(rows, [], m).first()
    assert (r.n, r["sum"], r.lo, r.hi, r.mean, r.kinds, r.q, r.few) == (10, 55.0, 1.0, 100.0, 5.5, 3, [6.0], 36.0)
    none = A.metrics_of(A.matched(stock, Q.MatchNone()), [], m).first()
    assert none["sum"] == 0 and none.lo == math.inf and math.isnan(none.mean)


def test_highlights(spark):
    text = "bring a <b> long & winding rope"
    q = Q.Match("long", "name", "en")
    want = "bring a &lt;b&gt; <mark>long</mark> &amp; winding rope"
    assert fragments(text, query_terms(q, "name"), "en") == [want]
    assert fragments("missess", {"long"}, "standard") == ["missess"]
    df = spark.createDataFrame([(text,), (None,), ("",)], "t string")
    assert [r[0] for r in df.select(highlight(F.col("t"), {"long"}, "en")).collect()] == [[want], None, [""]]
    far = "x " * 300 + "needle " + "y " * 300
    (f,) = fragments(far, {"needle"}, "standard")
    assert f.startswith("…") and f.endswith("…") and "<mark>needle</mark>" in f


def test_offsets_of_hits(spark):
    df = spark.createDataFrame([("é long, long way",), (None,)], "t string")
    got = [r[0] for r in df.select(located(F.col("t"), {"long", "no"}, "standard")).collect()]
    assert [tuple(x) for x in got[0]] == [("long", 2, 3, 7), ("long", 3, 9, 13)] and got[1] is None


def test_similarity_by_field(spark):
    df = spark.createDataFrame([(1, "a b", "a"), (2, "a", "c")], "id long, x string, y string")
    ix = Index.of(df, "id", (FieldSpec("x", TEXT, "simple"), FieldSpec("y", TEXT, "simple")))
    q = Q.Boolean(should=(Q.Term("a", "x"), Q.Term("a", "y")))
    scores = lambda i: {r.doc_num: r.score for r in A.matched(i, q).collect()}
    plain, other = scores(ix), scores(ix.with_similarity(Similarity(idf="lucene"), "y"))
    assert plain[2] == other[2] and plain[1] != other[1]
    assert A.timed(lambda: 3)[0] == 3


def test_locations(six):
    hits = search(six, Search(Q.Term("marty", "name")))
    assert [(r.term, r.positions) for r in locations(six, Q.Term("marty", "name"), hits).collect()] == [("marty", [1])]


def test_a_distinct_count_is_one_small_buffer(spark):
    """Within 3 %, nulls don't count; once a buffer was 6,554 columns, and a task took 487 MB."""
    rows = spark.range(30_000).select((F.col("id") % 3).alias("g"), F.when(F.col("id") % 5 > 0, F.col("id").cast("double")).alias("v"))
    out = A.metrics_of(rows, ["g"], {"about": A.cardinality(F.array("v"))})
    assert all(abs(r.about - 8000) <= 240 for r in out.collect())
    none = A.metrics_of(rows.where("v is null"), [], {"about": A.cardinality(F.array("v"))})
    assert none.first().about == 0
    plan = out._jdf.queryExecution().executedPlan().toString()
    assert "ObjectHashAggregate" in plan and "approx_count_distinct" not in plan
