"""Golden scores and results over small fixtures."""

import datetime as dt

import pytest
from pyspark.sql import functions as F

from inkwell.operators import query as Q
from inkwell.operators.collect import Search, search
from inkwell.operators.compile import matches
from inkwell.operators.index import COMPOSITE, DATE, KEYWORD, NUMERIC, TEXT, FieldSpec, Index


@pytest.fixture(scope="module")
def stub(spark):
    rows = [
        (1, "marty", " ".join(["beer"] * 4), "harbour way", None),
        (2, "steve", "angst beer couch database", "harbour way", "mister"),
        (3, "dustin", "apple beer column dank", None, "mister"),
        (4, "ravi", " ".join(["beer"] * 65), None, None),
        (5, "bobert", "water", None, "mister"),
    ]
    df = spark.createDataFrame(rows, "id long, name string, desc string, street string, title string")
    fields = tuple(FieldSpec(n, TEXT, "whitespace") for n in ("name", "desc", "street", "title"))
    return Index.of(df, "id", fields)


def scores(index, q):
    return {r.doc_num: r.score for r in matches(index, q).collect()}


BEER = Q.Term("beer", "desc")
MARTY, DUSTIN, STEVE = (Q.Term(n, "name") for n in ("marty", "dustin", "steve"))
MARTY5 = Q.Term("marty", "name", boost=5.0)
CASES = [
    (Q.Boolean(must=(BEER,), must_not=(STEVE,)), {1: 0.6596799472864431, 3: 0.4881300112458731, 4: 0.7033879235186731}),
    (
        Q.Boolean(must=(BEER,), should=(MARTY, DUSTIN), must_not=(STEVE,)),
        {1: 1.4205783261826577, 3: 1.2490283901420876, 4: 0.7033879235186731},
    ),
    (Q.Boolean(should=(MARTY, DUSTIN), must_not=(STEVE,)), {1: 0.7608983788962145, 3: 0.7608983788962145}),
    (Q.Boolean(must=(BEER,), should=(MARTY, DUSTIN), min_should=2), {}),
    (Q.Boolean(must=(MARTY5, Q.Boolean(must=(BEER,)))), {1: 4.464171841767515}),
    (Q.Boolean(must=(Q.Term("angst", "desc"), BEER)), {2: 1.5816824552876687}),
    (Q.MultiPhrase((("angst",), ("beer",)), "desc"), {2: 1.5816824552876687}),
    (Q.Boolean(must=(BEER, Q.Term("mister", "title", 5.0))), {2: 0.7916104490288789, 3: 0.7916104490288789}),
    (
        Q.Boolean(must=(Q.Term("beer", "desc", 5.0), Q.Term("harbour", "street"), Q.Term("mister", "title", 5.0))),
        {2: 2.8270039289187148},
    ),
    (
        Q.Fuzzy("beet", "desc"),
        {1: 0.49475996046483234, 2: 0.3660975084344048, 3: 0.3660975084344048, 4: 0.5275409426390048},
    ),
    (Q.Fuzzy("aplee", "desc", 2), {3: 0.6561314664250772}),
    (Q.Fuzzy("water", "desc", 2, 3), {5: 1.2329571465400413}),
    (Q.MatchAll(), dict.fromkeys(range(1, 6), 1.0)),
    (Q.MatchNone(), {}),
    (Q.Boolean(must_not=(STEVE,)), {1: 1.0, 3: 1.0, 4: 1.0, 5: 1.0}),
]


@pytest.mark.parametrize("case", range(len(CASES)))
def test_golden_scores(stub, case):
    q, want = CASES[case]
    got = scores(stub, q)
    assert got.keys() == want.keys()
    for k, v in want.items():
        assert got[k] == pytest.approx(v, abs=1e-12)


@pytest.fixture(scope="module")
def people(spark):
    day = lambda y, m, d, *t: dt.datetime(y, m, d, *t)
    rows = [
        ("a", "marty", 19.0, "mista", ["gopher", "belieber"], None),
        ("b", "steve has <a> long & complicated name", 27.0, "missess", None, day(2001, 9, 9, 1, 46, 40)),
        ("c", "bob walks home", 64.0, "masta", None, day(2014, 5, 13, 16, 53, 20)),
        ("d", "bobbleheaded wings top the phone", 72.0, "mizz", None, day(2014, 5, 13, 16, 53, 20)),
    ]
    df = spark.createDataFrame(rows, "id string, name string, age double, title string, tags array<string>, birthday timestamp")
    fields = (
        FieldSpec("name", TEXT, "en"), FieldSpec("age", NUMERIC), FieldSpec("title", TEXT), FieldSpec("tags", KEYWORD),
        FieldSpec("birthday", DATE), FieldSpec("_all", COMPOSITE, exclude=("_id",)),
    )
    return Index.of(df, "id", fields, doc_num=F.ascii("id").cast("long"))


def ids(index, q, **kw):
    return [r["_id"] for r in search(index, Search(q, **({"sort": ("_id",)} | kw))).collect()]


PEOPLE = [
    (Q.Term("marti", "name"), "a"),
    (Q.Term("walking", "name"), ""),
    (Q.MatchPhrase("complicated name", "_all", "en"), "b"),
    (Q.Match("walking", "name", "en"), "c"),
    (Q.Prefix("bobble"), "d"),
    (Q.Prefix("miss", "title"), "b"),
    (Q.NumericRange(high=30, field="age"), "ab"),
    (Q.Boolean(must=(Q.NumericRange(low=20, field="age"), Q.NumericRange(high=30, field="age"))), "b"),
    (Q.DateRange(start=dt.datetime(2010, 1, 1), field="birthday"), "cd"),
    (Q.DateRange(end=dt.datetime(2010, 1, 1), field="birthday"), "b"),
    (Q.Term("gopher", "tags"), "a"),
    (Q.Term("other", "tags"), ""),
    (Q.Fuzzy("msrti", "name"), "a"),
    (Q.Regexp("mar.*", "name"), "a"),
    (Q.Regexp("mar.", "name"), ""),
    (Q.Wildcard("mar*", "name"), "a"),
    (Q.Boolean(should=(Q.Term("b", "_id"), Q.Term("c", "_id"))), "bc"),
    (Q.TermRange("mis", "miz", "title"), "ab"),
    (Q.Match("", "name"), ""),
    (Q.MatchAll(), "abcd"),
]


@pytest.mark.parametrize("case", range(len(PEOPLE)))
def test_finds(people, case):
    q, want = PEOPLE[case]
    assert "".join(ids(people, q)) == want


def test_boosts_order(people):
    for boosted in (Q.Term("steve", "name", 5.0), Q.Fuzzy("steve", "name", boost=5.0), Q.Regexp("stev.*", "name", 5.0),
                    Q.NumericRange(25, 29, "age", boost=5.0)):
        q = Q.Boolean(should=(Q.Term("marti", "name"), boosted))
        assert ids(people, q, sort=("-_score",)) == ["b", "a"]


def test_explanation_adds_up(stub):
    import json

    r = search(stub, Search(Q.Boolean(should=(BEER, MARTY)), n=1, explain=True)).first()
    tree = json.loads(r.explanation)
    assert tree["value"] == pytest.approx(sum(c["value"] for c in tree["children"]))


def test_phrases(spark):
    df = spark.createDataFrame(
        [(1, ["Twenty Thousand Leagues Under The Sea"]), (2, ["bad call", "defenseless receiver"])], "id long, body array<string>"
    )
    ix = Index.of(df, "id", (FieldSpec("body", TEXT, "en"),))
    find = lambda text, slop=0: sorted(r.doc_num for r in matches(ix, Q.MatchPhrase(text, "body", "en", slop)).collect())
    for text in ("Twenty", "Twenty Thousand Leagues", "Leagues Under the Sea", "Thousand Leagues Under the Sea", "under the sea"):
        assert find(text) == [1], text
    assert find("bad call") == find("defenseless receiver") == [2]
    assert find("bad receiver") == find("call defenseless") == []
    assert find("Twenty Leagues") == [] and find("Twenty Leagues", 1) == [1] and find("Twenty under the sea", 2) == [1]
    multi = Q.MultiPhrase((("twenti", "thirti"), ("thousand",)), "body")
    assert [r.doc_num for r in matches(ix, multi).collect()] == [1]


def test_multi_valued_and_missing_phrase_slots(spark):
    df = spark.createDataFrame([(1, "a b a c"), (2, "a a b"), (3, None), (4, "")], "id long, t string")
    ix = Index.of(df, "id", (FieldSpec("t", TEXT, "whitespace"),))
    find = lambda *slots, slop=0: sorted(r.doc_num for r in matches(ix, Q.MultiPhrase(slots, "t", slop)).collect())
    assert find(("a",), (), ("a",)) == [1]
    assert find(("a",), ("a",)) == [2]
    assert find(("a",), ("b",), slop=1) == [1, 2]
    assert find(("a",), ("b",), ("a",)) == [1]


def test_texts_are_analysed_once(spark):
    """Postings and weights come from one exchange: the documents were read twice."""
    docs = spark.createDataFrame([(1, "a cat and a dog"), (2, "two cats"), (3, "")], "id long, body string")
    for analyzer, q in (("en", Q.Match("cat", "body", "en")), ("simple", Q.MatchPhrase("a dog", "body", "simple"))):
        found = matches(Index.of(docs, "id", (FieldSpec("body", TEXT, analyzer),)), q)
        assert sorted(r.doc_num for r in found.collect()) == ([1, 2] if analyzer == "en" else [1])
        plan = found._jdf.queryExecution().executedPlan().toString().split("== Initial Plan ==")[0]
        assert plan.count("ReusedExchange") == 1
        assert plan.count("ArrowEvalPython") == (analyzer == "en")


def test_terms_are_filtered_before_they_are_counted(spark):
    """A dictionary takes a document's terms as they are, without structures, and drops them in the row."""
    docs = spark.createDataFrame([(1, "from form fro far"), (2, "from FROM frim")], "id long, body string")
    ix = Index.of(docs, "id", (FieldSpec("body", TEXT, "simple"),))
    found = ix.dictionary("body", lambda t: t.startswith("fr"), end="fro_")
    assert sorted(map(tuple, found.collect())) == [("frim", 1), ("fro", 1)]
    plan = found._jdf.queryExecution().optimizedPlan().toString()
    assert "struct" not in plan and "Filter" not in plan
    fuzzy = matches(ix, Q.Match("from", "body", "simple", fuzziness=1, prefix=1))
    assert sorted(r.doc_num for r in fuzzy.collect()) == [1, 2]
