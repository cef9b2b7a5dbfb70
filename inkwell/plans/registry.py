"""Registered queries, one or more an operator, and the SQL that they are compared with.

Scores are rounded to six digits: sums over partitions have no fixed order. Where a query
returns ranked hits, it returns all of them, unless the top is what it is about.
"""

from __future__ import annotations

import datetime as dt
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import geo, native
from ..operators import aggs as A
from ..operators import query as Q
from ..operators.collect import Search, search
from ..operators.compile import matches, multi_search
from ..operators.highlight import highlight
from ..operators.index import COMPOSITE, DATE, GEO, KEYWORD, NUMERIC, TEXT, FieldSpec, Index, Similarity
from ..session import ship, spread, table

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def register(name: str, sql: str | None = None):
    def keep(f):
        QUERIES[name] = f
        if sql:
            ORACLES[name] = sql
        return f

    return keep


def documents(spark: SparkSession, d: str, analyzer: str = "simple", **kw) -> Index:
    fields = (
        FieldSpec("text", TEXT, analyzer), FieldSpec("lang", KEYWORD), FieldSpec("source", KEYWORD),
        FieldSpec("n_chars", NUMERIC), FieldSpec("_all", COMPOSITE, include=("text", "source")),
    )
    return Index.of(spread(table(ship(spark), d, "documents")), "doc_id", fields, **kw)


def events(spark: SparkSession, d: str) -> Index:
    fields = (FieldSpec("event_type", KEYWORD), FieldSpec("value", NUMERIC), FieldSpec("ts", DATE), FieldSpec("user_id", NUMERIC))
    return Index.of(table(ship(spark), d, "events"), "event_id", fields)


def ranked(found: DataFrame, name: str = "doc_id") -> DataFrame:
    return found.select(F.col("doc_num").alias(name), F.round("score", 6).alias("score"))


# --- SQL building blocks -------------------------------------------------------------------

TOKENS = r"regexp_extract_all(lower(text), '\p{L}+')"


def bm25_sql(where: str, boosts: str = "1.0", k1: float = 1.2, b: float = 0.75) -> str:
    """CTEs up to c: doc_id, term, contribution."""
    return f"""
WITH tok AS (SELECT doc_id, unnest({TOKENS}) AS term FROM documents),
dl AS (SELECT doc_id, len({TOKENS}) AS dl FROM documents),
st AS (SELECT CAST(count(*) FILTER (WHERE dl > 0) AS DOUBLE) AS n, CAST(sum(dl) AS DOUBLE) AS ttf FROM dl),
tf AS (SELECT doc_id, term, count(*) AS tf FROM tok WHERE {where} GROUP BY ALL),
df AS (SELECT term, count(*) AS df FROM tf GROUP BY term),
w AS (SELECT tf.doc_id, tf.term, tf.tf, ({boosts}) * ln(1 + (n - df) + 0.5 / (df + 0.5)) AS w,
             1 / ({k1} * ((1 - {b}) + {b} * dl / (ttf / n))) AS i
      FROM tf JOIN df ON tf.term = df.term JOIN dl ON tf.doc_id = dl.doc_id CROSS JOIN st),
c AS (SELECT doc_id, term, w - w / (1 + tf * i) AS s FROM w)"""


def any_sql(where: str, **kw) -> str:
    return bm25_sql(where, **kw) + "\nSELECT doc_id, round(sum(s), 6) AS score FROM c GROUP BY doc_id"


# --- leaf queries --------------------------------------------------------------------------


@register("term_bm25", any_sql("term = 'that'"))
def term_bm25(spark, d):
    return ranked(matches(documents(spark, d), Q.Term("that", "text")))


@register(
    "match_or_bm25",
    any_sql("term IN ('the', 'and')")
    + "\nORDER BY score DESC, doc_id LIMIT 10",
)
def match_or_bm25(spark, d):
    """The top 10; ties by id."""
    q = Q.Match("The and", "text", "simple")
    keys = (Q.SortKey(expr=F.round("score", 6), desc=True),)
    return ranked(search(documents(spark, d), Search(q, 10, sort=keys)))


@register("match_and_bm25", bm25_sql("term IN ('this', 'from')") + "\nSELECT doc_id, round(sum(s), 6) AS score FROM c GROUP BY doc_id HAVING count(*) = 2")
def match_and_bm25(spark, d):
    return ranked(matches(documents(spark, d), Q.Match("this from", "text", "simple", "and")))


@register("bm25_boosted", any_sql("term IN ('with', 'pour')", boosts="CASE WHEN tf.term = 'with' THEN 3.0 ELSE 1.0 END"))
def bm25_boosted(spark, d):
    q = Q.Boolean(should=(Q.Term("with", "text", 3.0), Q.Term("pour", "text")))
    return ranked(matches(documents(spark, d), q))


@register("bm25_custom_k1b", any_sql("term = 'that'", k1=0.9, b=0.4))
def bm25_custom_k1b(spark, d):
    return ranked(matches(documents(spark, d, similarity=Similarity(0.9, 0.4)), Q.Term("that", "text")))


@register("match_all", "SELECT doc_id, CAST(1.0 AS DOUBLE) AS score FROM documents")
def match_all(spark, d):
    return ranked(matches(documents(spark, d), Q.MatchAll()))


@register("match_none", "SELECT doc_id, CAST(1.0 AS DOUBLE) AS score FROM documents WHERE false")
def match_none(spark, d):
    return ranked(matches(documents(spark, d), Q.MatchNone()))


@register("prefix_query", any_sql("term LIKE 'that%'"))
def prefix_query(spark, d):
    return ranked(matches(documents(spark, d), Q.Prefix("that", "text")))


@register("wildcard_query", any_sql("term LIKE 'w_t%h'"))
def wildcard_query(spark, d):
    return ranked(matches(documents(spark, d), Q.Wildcard("w?t*h", "text")))


@register("regexp_query", any_sql("regexp_full_match(term, 'th(at|is)(the)?')"))
def regexp_query(spark, d):
    return ranked(matches(documents(spark, d), Q.Regexp("th(at|is)(the)?", "text")))


@register("term_range_query", any_sql("term >= 'that' AND term < 'thate'"))
def term_range_query(spark, d):
    return ranked(matches(documents(spark, d), Q.TermRange("that", "thate", "text")))


@register(
    "fuzzy_query",
    any_sql("damerau_levenshtein(term, 'with') <= 1", boosts="1 - damerau_levenshtein(tf.term, 'with') / CAST(least(length(tf.term), 4) AS DOUBLE)"),
)
def fuzzy_query(spark, d):
    return ranked(matches(documents(spark, d), Q.Fuzzy("with", "text", 1)))


@register("match_fuzzy", any_sql("damerau_levenshtein(term, 'from') <= 1 AND term LIKE 'f%'", boosts="1 - damerau_levenshtein(tf.term, 'from') / CAST(least(length(tf.term), 4) AS DOUBLE)"))
def match_fuzzy(spark, d):
    return ranked(matches(documents(spark, d), Q.Match("from", "text", "simple", fuzziness=1, prefix=1)))


MANY = "the and with that this from pour dans que der und los para".split()


@register("disjunction_of_many", any_sql(f"term IN {tuple(MANY)}"))
def disjunction_of_many(spark, d):
    """More than ten clauses."""
    return ranked(matches(documents(spark, d), Q.Match(" ".join(MANY), "text", "simple")))


# --- phrases -------------------------------------------------------------------------------

PLACED = f"""p AS (SELECT doc_id, unnest({TOKENS}) AS term, unnest(range(len({TOKENS}))) AS pos FROM documents)"""


@register(
    "phrase_exact",
    bm25_sql("term IN ('of', 'the')") + f""", {PLACED},
hit AS (SELECT DISTINCT a.doc_id FROM p a JOIN p b ON a.doc_id = b.doc_id AND b.pos = a.pos + 1 WHERE a.term = 'of' AND b.term = 'the')
SELECT doc_id, round(sum(s), 6) AS score FROM c WHERE doc_id IN (SELECT doc_id FROM hit) GROUP BY doc_id""",
)
def phrase_exact(spark, d):
    return ranked(matches(documents(spark, d), Q.MatchPhrase("of the", "text", "simple")))


@register(
    "multi_phrase",
    bm25_sql("term IN ('of', 'in', 'the', 'a')") + f""", {PLACED},
hit AS (SELECT DISTINCT a.doc_id FROM p a JOIN p b ON a.doc_id = b.doc_id AND b.pos = a.pos + 1
        WHERE a.term IN ('of', 'in') AND b.term IN ('the', 'a'))
SELECT doc_id, round(sum(s), 6) AS score FROM c WHERE doc_id IN (SELECT doc_id FROM hit) GROUP BY doc_id""",
)
def multi_phrase(spark, d):
    return ranked(matches(documents(spark, d), Q.MultiPhrase((("of", "in"), ("the", "a")), "text")))


@register(
    "phrase_sloppy",
    bm25_sql("term IN ('with', 'that')") + f""", {PLACED},
hit AS (SELECT DISTINCT a.doc_id FROM p a JOIN p b ON a.doc_id = b.doc_id AND abs(b.pos - a.pos - 1) <= 2
        WHERE a.term = 'with' AND b.term = 'that')
SELECT doc_id, round(sum(s), 6) AS score FROM c WHERE doc_id IN (SELECT doc_id FROM hit) GROUP BY doc_id""",
)
def phrase_sloppy(spark, d):
    return ranked(matches(documents(spark, d), Q.MatchPhrase("with that", "text", "simple", 2)))


# --- booleans ------------------------------------------------------------------------------

FLAGS = bm25_sql("term IN ('the', 'with', 'that', 'from')") + """,
f AS (SELECT doc_id, max(term = 'the') AS the, max(term = 'with') AS wit, max(term = 'that') AS tha, max(term = 'from') AS fro,
      coalesce(sum(s) FILTER (WHERE term = 'the'), 0) AS s_the, coalesce(sum(s) FILTER (WHERE term = 'with'), 0) AS s_with,
      coalesce(sum(s) FILTER (WHERE term = 'that'), 0) AS s_that, coalesce(sum(s) FILTER (WHERE term = 'from'), 0) AS s_from
      FROM c GROUP BY doc_id)"""
THE, WITH, THAT, FROM = (Q.Term(t, "text") for t in ("the", "with", "that", "from"))


@register("bool_must_should", FLAGS + "\nSELECT doc_id, round(s_the + s_with + s_that, 6) AS score FROM f WHERE the")
def bool_must_should(spark, d):
    return ranked(matches(documents(spark, d), Q.Boolean(must=(THE,), should=(WITH, THAT))))


@register(
    "bool_min_should",
    FLAGS + "\nSELECT doc_id, round(2.0 * (s_with + s_that + s_from), 6) AS score FROM f WHERE CAST(wit AS INT) + CAST(tha AS INT) + CAST(fro AS INT) >= 2",
)
def bool_min_should(spark, d):
    return ranked(matches(documents(spark, d), Q.Boolean(should=(WITH, THAT, FROM), min_should=2, boost=2.0)))


@register("bool_must_not", FLAGS + "\nSELECT doc_id, round(s_the, 6) AS score FROM f WHERE the AND NOT wit AND NOT tha")
def bool_must_not(spark, d):
    return ranked(matches(documents(spark, d), Q.Boolean(must=(THE,), must_not=(WITH, THAT))))


@register(
    "bool_only_must_not",
    f"SELECT doc_id, CAST(1.0 AS DOUBLE) AS score FROM documents WHERE NOT list_contains({TOKENS}, 'the')",
)
def bool_only_must_not(spark, d):
    return ranked(matches(documents(spark, d), Q.Boolean(must_not=(THE,))))


@register(
    "bool_nested_filter",
    FLAGS + """
SELECT f.doc_id, round(s_the + 1.0 + CASE WHEN wit AND fro THEN s_with + s_from ELSE 0 END, 6) AS score
FROM f JOIN documents d ON d.doc_id = f.doc_id WHERE the AND d.n_chars >= 1000 AND d.n_chars < 5000 AND d.lang <> 'fr'""",
)
def bool_nested_filter(spark, d):
    q = Q.Boolean(
        must=(THE, Q.NumericRange(1000, 5000, "n_chars")),
        should=(Q.Boolean(must=(WITH, FROM)),),
        must_not=(Q.Term("fr", "lang"),),
    )
    return ranked(matches(documents(spark, d), q))


@register(
    "score_none",
    f"SELECT doc_id, CAST(0.0 AS DOUBLE) AS score FROM documents WHERE list_contains({TOKENS}, 'the') AND list_contains({TOKENS}, 'with')",
)
def score_none(spark, d):
    return ranked(matches(documents(spark, d), Q.Boolean(must=(THE, WITH)), scored=False))


# --- ranges --------------------------------------------------------------------------------


@register("numeric_range", "SELECT o_orderkey, CAST(2.5 AS DOUBLE) AS score FROM orders WHERE o_totalprice >= 1000 AND o_totalprice < 90000")
def numeric_range(spark, d):
    ix = Index.of(table(ship(spark), d, "orders"), "o_orderkey", (FieldSpec("o_totalprice", NUMERIC),))
    return ranked(matches(ix, Q.NumericRange(1000, 90000, "o_totalprice", boost=2.5)), "o_orderkey")


@register(
    "date_range",
    "SELECT event_id, CAST(1.0 AS DOUBLE) AS score FROM events WHERE ts >= TIMESTAMP '2024-01-10' AND ts <= TIMESTAMP '2024-01-12'",
)
def date_range(spark, d):
    q = Q.DateRange(dt.datetime(2024, 1, 10), dt.datetime(2024, 1, 12), "ts", include_end=True)
    return ranked(matches(events(spark, d), q), "event_id")


# --- geo -----------------------------------------------------------------------------------


def places(spark: SparkSession, d: str) -> Index:
    """Customers at points derived from their keys."""
    c = table(ship(spark), d, "customer").withColumn(
        "at",
        F.struct(
            ((F.col("c_custkey") * 7919 % 36000) / 100 - 180).alias("lon"),
            ((F.col("c_custkey") * 10473 % 18000) / 100 - 90).alias("lat"),
        ),
    )
    return Index.of(c, "c_custkey", (FieldSpec("at", GEO),))


PLACES = """WITH g AS (SELECT c_custkey, (c_custkey * 7919 % 36000) / 100.0 - 180 AS lon, (c_custkey * 10473 % 18000) / 100.0 - 90 AS lat FROM customer),
q AS (SELECT *, floor((lon + 180) * (4294967295 / 360.0)) / (4294967295 / 360.0) - 180 AS qlon,
             floor((lat + 90) * (4294967295 / 180.0)) / (4294967295 / 180.0) - 90 AS qlat FROM g)"""
KM = """(2 / 1000.0 * sqrt((pow(6378137e0 * 6378137e0 * cos(r), 2) + pow(6356752.3142e0 * 6356752.3142e0 * sin(r), 2))
 / (pow(6378137e0 * cos(r), 2) + pow(6356752.3142e0 * sin(r), 2)))
 * asin(least(1.0, sqrt((1 - cos(radians({lat} - qlat))) / 2
 + cos(radians({lat})) * cos(radians(qlat)) * (1 - cos(radians({lon} - qlon))) / 2))))"""
RADIUS = ", t AS (SELECT *, pi() * floor(abs(({lat} + qlat) / 2) * (pi() / 180) * (1024 / (pi() / 2)) + 0.5) / 2049 AS r FROM q)"
SOME = [(-10.0, 35.0), (40.0, 35.5), (30.0, 70.0), (10.0, 50.0), (-20.0, 60.0)]


@register(
    "geo_box",
    PLACES + " SELECT c_custkey, CAST(1.0 AS DOUBLE) AS score FROM g WHERE lat BETWEEN -30 AND 40 AND (lon >= 150 OR lon <= -120)",
)
def geo_box(spark, d):
    """A box across the dateline."""
    return ranked(matches(places(spark, d), Q.GeoBox(150, 40, -120, -30, "at")), "c_custkey")


@register(
    "geo_distance",
    PLACES + RADIUS.format(lat=48.85) + f" SELECT c_custkey, CAST(1.0 AS DOUBLE) AS score FROM t WHERE {KM.format(lat=48.85, lon=2.35)} <= 1500",
)
def geo_distance(spark, d):
    return ranked(matches(places(spark, d), Q.GeoDistance(2.35, 48.85, "1500km", "at")), "c_custkey")


def polygon_sql(points) -> str:
    cross = [
        f"CAST(({y1} > lat) <> ({y2} > lat) AND lon < ({x2} - {x1}) * (lat - {y1}) / ({y2} - {y1}) + {x1} AS INT)"
        for (x1, y1), (x2, y2) in zip([tuple(f"({v})" for v in p) for p in points], [tuple(f"({v})" for v in p) for p in [points[-1], *points[:-1]]])
        if y1 != y2
    ]
    return f"({' + '.join(cross)}) % 2 = 1"


@register("geo_polygon", PLACES + f" SELECT c_custkey, CAST(1.0 AS DOUBLE) AS score FROM g WHERE {polygon_sql(SOME)}")
def geo_polygon(spark, d):
    return ranked(matches(places(spark, d), Q.GeoPolygon(tuple(SOME), "at")), "c_custkey")


@register(
    "geo_sort_distance",
    PLACES + RADIUS.format(lat=40.0) + f" SELECT c_custkey, round({KM.format(lat=40.0, lon=-74.0)}, 6) AS km FROM t ORDER BY km, c_custkey LIMIT 25",
)
def geo_sort_distance(spark, d):
    """The 25 nearest."""
    ix = places(spark, d)
    lon, lat = geo.quantised(F.col("at.lon"), 360), geo.quantised(F.col("at.lat"), 180)
    km = F.round(geo.haversine_km(F.lit(-74.0), F.lit(40.0), lon, lat), 6)
    hits = search(ix, Search(Q.MatchAll(), 25, sort=(Q.SortKey(expr=km),)))
    return hits.select(F.col("doc_num").alias("c_custkey"), F.col("k0").alias("km"))


def _geohash_sql(precision: int) -> str:
    """Of (ix, iy), half the bits each, longitude first."""
    half = 5 * precision // 2
    bit = lambda b: f"(({'iy' if b % 2 else 'ix'} >> {half - 1 - b // 2}) & 1)"
    codes = (" + ".join(f"{bit(5 * k + b)} * {16 >> b}" for b in range(5)) for k in range(precision))
    return " || ".join(f"substr('0123456789bcdefghjkmnpqrstuvwxyz', CAST({c} + 1 AS BIGINT), 1)" for c in codes)


MORTON = " + ".join(f"((mx >> {b}) & 1)::HUGEINT * {1 << 2 * b} + ((my >> {b}) & 1)::HUGEINT * {2 << 2 * b}" for b in range(32))


@register(
    "geohash",
    PLACES + f""", cells AS (SELECT c_custkey, least(floor((lon + 180) / 360.0 * 32768), 32767)::BIGINT AS ix,
  least(floor((lat + 90) / 180.0 * 32768), 32767)::BIGINT AS iy, floor((lon + 180) * (4294967295 / 360.0))::BIGINT AS mx,
  floor((lat + 90) * (4294967295 / 180.0))::BIGINT AS my FROM g),
m AS (SELECT c_custkey, {_geohash_sql(6)} AS geohash, {MORTON} AS m FROM cells)
SELECT c_custkey, geohash, CAST(CASE WHEN m >= 9223372036854775808 THEN m - 18446744073709551616 ELSE m END AS BIGINT) AS morton FROM m""",
)
def geohash_cells(spark, d):
    """Geohash and Morton layout key of every place."""
    lon, lat = F.col("at.lon"), F.col("at.lat")
    return places(spark, d).docs.select("c_custkey", geo.geohash(lon, lat, 6).alias("geohash"), geo.morton(lon, lat).alias("morton"))


# --- sorting and paging --------------------------------------------------------------------


def parts(spark: SparkSession, d: str) -> Index:
    return Index.of(
        table(ship(spark), d, "part"), "p_partkey",
        (FieldSpec("p_brand", KEYWORD), FieldSpec("p_size", NUMERIC), FieldSpec("p_retailprice", NUMERIC)),
    )


def part_keys(found: DataFrame) -> DataFrame:
    return found.select(F.col("doc_num").alias("p_partkey"))


@register("sort_multi", "SELECT p_partkey FROM part ORDER BY p_size DESC, p_retailprice, p_partkey LIMIT 50")
def sort_multi(spark, d):
    return part_keys(search(parts(spark, d), Search(Q.MatchAll(), 50, sort=("-p_size", "p_retailprice"))))


@register("top_n_from", "SELECT p_partkey FROM part ORDER BY p_brand, p_partkey LIMIT 20 OFFSET 40")
def top_n_from(spark, d):
    return part_keys(search(parts(spark, d), Search(Q.MatchAll(), 20, start=40, sort=("p_brand",))))


@register("search_after", "SELECT p_partkey FROM part WHERE p_size > 10 OR (p_size = 10 AND p_partkey > 100) ORDER BY p_size, p_partkey LIMIT 30")
def search_after(spark, d):
    keys = ("p_size", Q.SortKey(expr=F.col("p_partkey")))
    return part_keys(search(parts(spark, d), Search(Q.MatchAll(), 30, sort=keys, after=(10, 100))))


@register(
    "search_before",
    "SELECT p_partkey FROM (SELECT * FROM part WHERE p_size < 20 ORDER BY p_size DESC, p_partkey DESC LIMIT 30)",
)
def search_before(spark, d):
    return part_keys(search(parts(spark, d), Search(Q.MatchAll(), 30, sort=("p_size",), before=(20,))))


def labelled(spark: SparkSession, d: str) -> Index:
    docs = table(ship(spark), d, "documents").select("doc_id", "lang").join(table(spark, d, "labels"), "doc_id", "left")
    return Index.of(docs, "doc_id", (FieldSpec("lang", KEYWORD), FieldSpec("quality", NUMERIC), FieldSpec("toxic", NUMERIC)))


LABELLED = "SELECT d.doc_id FROM documents d LEFT JOIN labels l ON d.doc_id = l.doc_id ORDER BY quality {}, d.doc_id LIMIT 100"


@register("sort_missing_last", LABELLED.format("DESC NULLS LAST"))
def sort_missing_last(spark, d):
    return search(labelled(spark, d), Search(Q.MatchAll(), 100, sort=("-quality",))).select(F.col("doc_num").alias("doc_id"))


@register("sort_missing_first", LABELLED.format("ASC NULLS FIRST"))
def sort_missing_first(spark, d):
    keys = (Q.SortKey("quality", missing_first=True),)
    return search(labelled(spark, d), Search(Q.MatchAll(), 100, sort=keys)).select(F.col("doc_num").alias("doc_id"))


# --- aggregations --------------------------------------------------------------------------


@register(
    "agg_metrics",
    "SELECT count(*) AS n, round(sum(value), 4) AS total, min(value) AS lo, max(value) AS hi, round(avg(value), 6) AS mean FROM events WHERE event_type = 'purchase'",
)
def agg_metrics(spark, d):
    ix = events(spark, d)
    v = A.source(ix, "value")
    rows = A.matched(ix, Q.Term("purchase", "event_type"))
    m = {"n": A.count(), "total": A.total(v), "lo": A.least(v), "hi": A.most(v), "mean": A.average(v)}
    return A.metrics_of(rows, [], m).select("n", F.round("total", 4).alias("total"), "lo", "hi", F.round("mean", 6).alias("mean"))


@register(
    "agg_weighted_avg",
    "SELECT round(sum(l_extendedprice * l_quantity) / sum(l_quantity), 4) AS mean FROM lineitem",
)
def agg_weighted_avg(spark, d):
    li = table(ship(spark), d, "lineitem")
    m = {"mean": A.average(F.array("l_extendedprice"), F.col("l_quantity"))}
    return A.metrics_of(li, [], m).select(F.round("mean", 4).alias("mean"))


@register(
    "agg_terms",
    """WITH t AS (SELECT event_type AS bucket, count(*) AS count FROM events GROUP BY event_type ORDER BY count DESC, bucket LIMIT 3)
SELECT bucket, count, CAST((SELECT count(*) FROM events) - (SELECT sum(count) FROM t) AS BIGINT) AS other FROM t""",
)
def agg_terms(spark, d):
    ix = events(spark, d)
    return A.aggregate(A.matched(ix, Q.MatchAll()), A.Buckets(A.source(ix, "event_type"), 3))[""]


@register(
    "agg_terms_nested",
    """WITH t AS (SELECT event_type AS bucket FROM events GROUP BY event_type ORDER BY count(*) DESC, bucket LIMIT 3),
r AS (SELECT bucket, u.band, value FROM events JOIN t ON event_type = bucket
      JOIN (VALUES ('low', -1e300, 50.0), ('mid', 25.0, 75.0), ('high', 50.0, 1e300)) u(band, lo, hi) ON value >= lo AND value < hi)
SELECT bucket, band, count(*) AS count, round(sum(value), 4) AS total FROM r GROUP BY bucket, band""",
)
def agg_terms_nested(spark, d):
    """Overlapping ranges within the three commonest types."""
    ix = events(spark, d)
    v = A.source(ix, "value")
    bands = A.Buckets(v, ranges=(A.Range(None, 50.0, "low"), A.Range(25.0, 75.0, "mid"), A.Range(50.0, None, "high")), metrics={"total": A.total(v)})
    out = A.aggregate(A.matched(ix, Q.MatchAll()), A.Buckets(A.source(ix, "event_type"), 3).with_nested("band", bands))
    return out["band"].withColumn("total", F.round("total", 4))


@register(
    "agg_ranges",
    """SELECT bucket, count(value) AS count FROM (VALUES ('[-inf,10.000000)', -1e300, 10.0), ('mid', 10.0, 90.0), ('top', 1e12, 1e300)) u(bucket, lo, hi)
LEFT JOIN events ON value >= lo AND value < hi GROUP BY bucket""",
)
def agg_ranges(spark, d):
    ix = events(spark, d)
    b = A.Buckets(A.source(ix, "value"), ranges=(A.Range(None, 10.0), A.Range(10.0, 90.0, "mid"), A.Range(1e12, None, "top")))
    return A.aggregate(A.matched(ix, Q.MatchAll()), b)[""].select(F.regexp_replace("bucket", "-Infinity", "-inf").alias("bucket"), "count")


@register(
    "agg_date_ranges",
    """SELECT CASE WHEN ts < TIMESTAMP '2024-01-15' THEN 'first' ELSE 'second' END AS bucket, count(*) AS count, max(value) AS top FROM events GROUP BY bucket""",
)
def agg_date_ranges(spark, d):
    ix = events(spark, d)
    cut = dt.datetime(2024, 1, 15)
    b = A.Buckets(A.source(ix, "ts"), ranges=(A.Range(None, cut, "first"), A.Range(cut, None, "second")), metrics={"top": A.most(A.source(ix, "value"))})
    return A.aggregate(A.matched(ix, Q.MatchAll()), b)[""]


@register("agg_filtered", "SELECT event_type AS bucket, count(*) AS count, round(coalesce(sum(value) FILTER (WHERE value > 50), 0), 4) AS big FROM events GROUP BY event_type")
def agg_filtered(spark, d):
    ix = events(spark, d)
    big = A.filtered(A.source(ix, "value"), lambda v: v > 50)
    b = A.Buckets(A.source(ix, "event_type"), 100, metrics={"big": A.total(big)})
    return A.aggregate(A.matched(ix, Q.MatchAll()), b)[""].select("bucket", "count", F.round("big", 4).alias("big"))


@register("agg_cardinality", "SELECT event_type, count(*) AS count, count(DISTINCT user_id) AS users FROM events GROUP BY event_type")
def agg_cardinality(spark, d):
    rows = A.matched(events(spark, d), Q.MatchAll())
    return A.metrics_of(rows, ["event_type"], {"users": A.cardinality(F.array("user_id"), exact=True)})


@register("agg_cardinality_approx", "SELECT count(*) AS count, count(DISTINCT user_id) AS users, true AS near FROM events")
def agg_cardinality_approx(spark, d):
    """A sketch's distinct count beside the exact one, from which it differs by at most 3 %."""
    rows, of = A.matched(events(spark, d), Q.MatchAll()), F.array("user_id")
    out = A.metrics_of(rows, [], {"users": A.cardinality(of, exact=True), "about": A.cardinality(of)})
    return out.select("count", "users", (F.abs(F.col("about") - F.col("users")) <= 0.03 * F.col("users")).alias("near"))


@register("agg_quantiles_approx", "SELECT event_type, count(*) AS count, true AS near FROM events GROUP BY event_type")
def agg_quantiles_approx(spark, d):
    """A sketch's median, within the exact quantiles 0.49 and 0.51."""
    rows, of = A.matched(events(spark, d), Q.MatchAll()), F.array("value")
    out = A.metrics_of(rows, ["event_type"], {"q": A.quantiles(of, (0.49, 0.51), exact=True), "about": A.quantiles(of, (0.5,))})
    return out.select("event_type", "count", F.col("about")[0].between(F.col("q")[0], F.col("q")[1]).alias("near"))


@register("agg_quantiles", "SELECT event_type, count(*) AS count, round(quantile_cont(value, 0.5), 6) AS p50, round(quantile_cont(value, 0.9), 6) AS p90 FROM events GROUP BY event_type")
def agg_quantiles(spark, d):
    rows = A.matched(events(spark, d), Q.MatchAll())
    out = A.metrics_of(rows, ["event_type"], {"q": A.quantiles(F.array("value"), (0.5, 0.9), exact=True)})
    return out.select("event_type", "count", F.round(F.col("q")[0], 6).alias("p50"), F.round(F.col("q")[1], 6).alias("p90"))


@register("agg_standard", bm25_sql("term = 'that'") + "\nSELECT count(*) AS count, round(max(s), 6) AS max_score FROM c")
def agg_standard(spark, d):
    out = A.standard(matches(documents(spark, d), Q.Term("that", "text")))
    return out.select("count", F.round("max_score", 6).alias("max_score"))


# --- index contents ------------------------------------------------------------------------


@register("collection_count", "SELECT count(*) AS n FROM documents")
def collection_count(spark, d):
    return documents(spark, d).docs.agg(F.count(F.lit(1)).alias("n"))


@register("field_stats", f"SELECT 'text' AS field, count(*) FILTER (WHERE len({TOKENS}) > 0) AS doc_count, CAST(sum(len({TOKENS})) AS BIGINT) AS sum_ttf, count(*) AS total_docs FROM documents")
def field_stats(spark, d):
    return documents(spark, d).field_stats(["text"])


@register("dictionary_scan", f"SELECT term, count(*) AS df FROM (SELECT DISTINCT doc_id, unnest({TOKENS}) AS term FROM documents) WHERE term >= 'm' AND term < 'n' GROUP BY term")
def dictionary_scan(spark, d):
    return documents(spark, d).dictionary("text", start="m", end="n")


@register("composite_all", f"SELECT doc_id, CAST(0.0 AS DOUBLE) AS score FROM documents WHERE source = 'src3' OR list_contains({TOKENS}, 'with')")
def composite_all(spark, d):
    q = Q.Boolean(should=(Q.Term("src3"), Q.Term("with")))
    return ranked(matches(documents(spark, d), q, scored=False))


@register("postings_scan", f"SELECT term, doc_id, count(*) AS tf FROM (SELECT doc_id, unnest({TOKENS}) AS term FROM documents) WHERE term IN ('the', 'que') GROUP BY ALL")
def postings_scan(spark, d):
    hits = documents(spark, d).hits({"text": lambda t: t.isin("the", "que")})
    return hits.select("term", F.col("doc_num").alias("doc_id"), F.col("tf").cast("long").alias("tf"))


# --- analysis ------------------------------------------------------------------------------


FEW = 100_000


def apart(docs: DataFrame, key: str) -> tuple[DataFrame, DataFrame | None]:
    """Rows whose key is theirs alone, and the others if there are any: one job over the keys."""
    repeated = docs.groupBy(key).agg(F.count(F.lit(1)).alias("n")).where("n > 1").select(F.col(key).alias("__repeated"))
    n = repeated.limit(FEW + 1).count()
    if not n:
        return docs, None
    ids = F.broadcast(repeated) if n <= FEW else repeated
    same = F.col(key).eqNullSafe(F.col("__repeated"))
    return docs.join(ids, same, "left_anti"), docs.join(ids, same, "left_semi")


def term_counts(docs: DataFrame, counts, key: str = "doc_id") -> DataFrame:
    """Terms a document. counts: their Column, native.COUNTS; only rows that share their id meet."""

    def rows(df: DataFrame) -> DataFrame:
        # An inner inline would be filtered by its input's size, for which that is computed again.
        return spread(df).select(key, counts.alias("c")).select(key, F.inline_outer("c")).where(F.col("n").isNotNull())

    once, again = apart(docs, key)
    if again is None:
        return rows(once)
    return rows(once).unionAll(rows(again).groupBy(key, "term").agg(F.sum("n").alias("n")))


def counts_sql(terms: str, table_: str = "documents", key: str = "doc_id") -> str:
    return f"SELECT {key}, term, count(*) AS n FROM (SELECT {key}, unnest({terms}) AS term FROM {table_}) GROUP BY ALL"


STOP = ("the", "of", "and", "de", "la", "der", "que")
ANALYSES = {
    "simple": (lambda s: s, TOKENS),
    "stop": (lambda s: native.drop_stop(s, STOP), f"list_filter({TOKENS}, lambda x: x NOT IN {STOP})"),
    "length": (lambda s: native.keep_length(s, 3, 6), f"list_filter({TOKENS}, lambda x: length(x) >= 3 AND length(x) <= 6)"),
    "truncate": (lambda s: native.truncate(s, 4), f"list_transform({TOKENS}, lambda x: x[1:4])"),
    "unique": (lambda s: native.unique(s), f"list_distinct({TOKENS})"),
    "reverse": (lambda s: native.reverse_terms(s), f"list_transform({TOKENS}, lambda x: reverse(x))"),
    "edge_ngram": (lambda s: native.edge_ngrams(s, 2, 3), ""),
    "shingle": (lambda s: native.shingles(s, 2), ""),
}


def _analysis(name: str):
    make, sql = ANALYSES[name]
    if name == "shingle":
        sql = f"""SELECT doc_id, term, count(*) AS n FROM (
SELECT doc_id, t || ' ' || lead(t) OVER (PARTITION BY doc_id ORDER BY i) AS term
FROM (SELECT doc_id, unnest({TOKENS}) AS t, unnest(range(len({TOKENS}))) AS i FROM documents)) WHERE term IS NOT NULL GROUP BY ALL"""
    elif name == "edge_ngram":
        sql = f"""SELECT doc_id, term, count(*) AS n FROM (
SELECT doc_id, x[1:k] AS term FROM (SELECT doc_id, unnest({TOKENS}) AS x FROM documents), (VALUES (2), (3)) v(k) WHERE length(x) >= k) GROUP BY ALL"""
    else:
        sql = counts_sql(sql)

    @register(f"analyze_{name}", sql)
    def run(spark, d):
        return term_counts(table(ship(spark), d, "documents"), native.counted(make(native.simple_terms(F.col("text")))))


for _name in ANALYSES:
    _analysis(_name)


@register(
    "analyze_ngram",
    f"""SELECT doc_id, term, count(*) AS n FROM (
SELECT doc_id, x[i:i + 2] AS term FROM (SELECT doc_id, x, unnest(range(1, length(x) - 1)) AS i
FROM (SELECT doc_id, unnest({TOKENS}) AS x FROM documents))) GROUP BY ALL""",
)
def analyze_ngram(spark, d):
    docs = table(ship(spark), d, "documents")
    return term_counts(docs, native.counted(native.ngrams(native.simple_terms(F.col("text")), 3, 3)))


@register("analyze_whitespace", counts_sql(r"regexp_extract_all(text, '[^ \t\n\r\f]+')"))
def analyze_whitespace(spark, d):
    return term_counts(table(ship(spark), d, "documents"), native.counted(native.whitespace_terms(F.col("text"))))


@register("analyze_keyword", "SELECT doc_id, lang AS term, count(*) AS n FROM documents GROUP BY ALL")
def analyze_keyword(spark, d):
    return term_counts(table(ship(spark), d, "documents"), native.counted(native.keyword_terms(F.col("lang"))))


@register(
    "analyze_html_strip",
    counts_sql(r"regexp_extract_all(lower(regexp_replace(html, '(?s)<!--.*?-->|</?[!\w][^<>]*>', ' ', 'g')), '\p{L}+')", "pages", "page_id"),
)
def analyze_html_strip(spark, d):
    pages = table(ship(spark), d, "pages")
    return term_counts(pages, native.counted(native.simple_terms(native.strip_html(F.col("html")))), "page_id")


def _by_analyzer(name: str):
    @register(f"analyze_{name}")
    def run(spark, d):
        return term_counts(table(ship(spark), d, "documents"), native.counted_words(F.col("text"), name))


for _name in ("standard", "web", "en", "fr", "de", "es", "it", "pt", "nl", "ru", "cjk"):
    _by_analyzer(_name)


@register("match_english")
def match_english(spark, d):
    """English stems, in Python on the workers."""
    return ranked(matches(documents(spark, d, "en"), Q.Match("ingly tioned the", "text", "en")))


@register("highlight_html")
def highlight_html(spark, d):
    """The best fragment of each of the top 20."""
    hits = search(documents(spark, d), Search(Q.Match("that with", "text", "simple"), 20, select=("text",)))
    return hits.select(F.col("doc_num").alias("doc_id"), highlight(F.col("text"), {"that", "with"}, "simple").alias("fragments"))


@register(
    "explain_scores",
    bm25_sql("term IN ('the', 'with', 'that')")
    + """
SELECT doc_id, round(sum(s), 6) AS total, round(sum(s), 6) AS parts, count(*) AS clauses FROM c
WHERE doc_id IN (SELECT doc_id FROM c WHERE term = 'the') GROUP BY doc_id ORDER BY total DESC, doc_id LIMIT 10""",
)
def explain_scores(spark, d):
    """The top 10 with how their scores came about, read back from the explanations."""
    q = Q.Boolean(must=(THE,), should=(WITH, THAT))
    keys = (Q.SortKey(expr=F.round("score", 6), desc=True),)
    rows = search(documents(spark, d), Search(q, 10, sort=keys, explain=True))
    tree = F.from_json("explanation", "value double, children array<struct<value: double, message: string>>")
    each = F.transform(tree["children"], lambda x: x["value"])
    return rows.select(
        F.col("doc_num").alias("doc_id"), F.round(tree["value"], 6).alias("total"),
        F.round(F.aggregate(each, F.lit(0.0), lambda a, x: a + x), 6).alias("parts"), F.size(each).cast("long").alias("clauses"),
    )


@register(
    "multi_search",
    any_sql("term = 'that'").replace("SELECT doc_id, round(sum(s), 6) AS score FROM c GROUP BY doc_id", "SELECT 0 AS index_ord, doc_id AS num, round(sum(s), 6) AS score FROM c GROUP BY doc_id")
    + """ UNION ALL SELECT * FROM (""" + any_sql("term = 'that'").replace("documents", "v").replace("WITH tok", "WITH v AS (SELECT conv_id * 1000 + turn AS doc_id, text FROM conversations), tok").replace("SELECT doc_id, round(sum(s), 6) AS score FROM c GROUP BY doc_id", "SELECT 1 AS index_ord, doc_id AS num, round(sum(s), 6) AS score FROM c GROUP BY doc_id") + ")",
)
def multi_search_both(spark, d):
    """Documents and conversations, each scored by its own statistics."""
    talk = table(ship(spark), d, "conversations").withColumn("num", F.col("conv_id") * 1000 + F.col("turn"))
    second = Index.of(talk, "num", (FieldSpec("text", TEXT, "simple"),))
    out = multi_search([documents(spark, d), second], Q.Term("that", "text"))
    return out.select("index_ord", F.col("doc_num").alias("num"), F.round("score", 6).alias("score"))


# --- stored indexes ------------------------------------------------------------------------


def _store(spark: SparkSession):
    from ..session import shared_dir
    from ..sources.store import IndexWriter

    fields = (FieldSpec("text", TEXT, "simple"), FieldSpec("lang", KEYWORD))
    return IndexWriter(spark, shared_dir(ship(spark)), fields, "doc_id")


UPDATED = """WITH u AS (SELECT doc_id, lang FROM documents WHERE doc_id % 3 <> 0 AND lang <> 'es'
UNION ALL SELECT doc_id, 'new' AS lang FROM documents WHERE doc_id % 3 = 0)"""


@register("update_delete_snapshot", UPDATED + " SELECT lang, count(*) AS n FROM u GROUP BY lang")
def update_delete_snapshot(spark, d):
    """Insert all, update every third, delete a language, merge the segments."""
    docs = table(spark, d, "documents")
    with _store(spark) as w:
        w.batch(insert=docs)
        w.batch(update=docs.where("doc_id % 3 = 0").withColumn("lang", F.lit("new")), delete_terms=[("lang", "es")])
        w.merge(w.manifest.segments)
        return w.reader().index().docs.groupBy("lang").agg(F.count(F.lit(1)).alias("n"))


@register("stored_match", any_sql("term IN ('that', 'with')"))
def stored_match(spark, d):
    """A match over stored postings."""
    with _store(spark) as w:
        w.batch(insert=table(spark, d, "documents"))
        ix = w.reader().index()
        found = matches(ix, Q.Match("that with", "text", "simple")).join(ix.docs.select("doc_num", "doc_id"), "doc_num")
        return found.select("doc_id", F.round("score", 6).alias("score"))


@register("incremental_ingest", "SELECT event_type, count(*) AS n FROM events GROUP BY event_type")
def incremental_ingest(spark, d):
    """Events streamed into an index, a micro-batch an epoch."""
    from ..session import shared_dir
    from ..sources.store import IndexWriter
    from ..streaming.ingest import ingest

    schema = table(ship(spark), d, "events").schema
    # The stream's source is a folder; a table is one file or a folder of parts.
    stream = spark.readStream.schema(schema).option("pathGlobFilter", "*.parquet").parquet(f"{d}/events.parquet*")
    path = shared_dir(spark)
    with IndexWriter(spark, path, (FieldSpec("event_type", KEYWORD), FieldSpec("value", NUMERIC)), "event_id") as w:
        ingest(stream, w, f"{path}-stream", "insert").awaitTermination()
        return w.reader().index().docs.groupBy("event_type").agg(F.count(F.lit(1)).alias("n"))
