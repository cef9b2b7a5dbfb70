"""Token streams, stemmers, geographic and numeric functions."""

import math

import pyarrow as pa
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from inkwell.functions import geo, languages, native, snowball, stemmers
from inkwell.functions import tokens as T
from inkwell.plans import registry


def terms(tokens):
    return [t.term for t in tokens]


def test_unicode_words():
    assert terms(T.unicode_words("Hello World.")) == ["Hello", "World"]
    assert terms(T.unicode_words("Dominique@mcdiabetes.com can't 3.14 x_y")) == ["Dominique", "mcdiabetes.com", "can't", "3.14", "x_y"]
    assert [(t.term, t.start, t.end, t.type) for t in T.unicode_words("こんにちは世界")] == [
        (c, 3 * i, 3 * i + 3, "ideographic") for i, c in enumerate("こんにちは世界")
    ]
    assert [t.type for t in T.unicode_words("age 25")] == ["alphanum", "numeric"]
    assert terms(T.unicode_words("カタカナ")) == ["カタカナ"]
    assert T.unicode_words("") == [] and T.unicode_words(" .,! ") == []


def test_offsets_are_bytes():
    data = "é bon 漢 x".encode()
    assert [data[t.start : t.end].decode() for t in T.unicode_words("é bon 漢 x")] == ["é", "bon", "漢", "x"]


@given(st.text(max_size=40))
@settings(max_examples=200, deadline=None)
def test_every_tokenizer_cuts_the_text(text):
    data = text.encode()
    for tok in (T.unicode_words, T.letters, T.not_space, T.single, T.web_words):
        for t in tok(text):
            assert data[t.start : t.end].decode() == t.term


def test_other_tokenizers():
    assert terms(T.letters("a1b'c")) == ["a", "b", "c"]
    assert terms(T.pattern_tokens("[0-9]+")("a12b3")) == ["12", "3"]
    assert terms(T.web_words("mail me@x.org at http://a.b/c?d=1, #tag @you")) == ["mail", "me@x.org", "at", "http://a.b/c?d=1", "#tag", "@you"]
    assert terms(T.exceptions("a-b", T.letters)("x a-b y")) == ["x", "a-b", "y"]


def line(*words):
    return [T.Token(w) for w in words]


def test_filters():
    assert terms(T.lower(line("ÀB"))) == ["àb"]
    stopped = T.stop({"the"})(line("a", "the", "the", "b"))
    assert [(t.term, t.incr) for t in stopped] == [("a", 1), ("b", 3)]
    assert terms(T.length(2, 3)(line("a", "bb", "ccc", "dddd"))) == ["bb", "ccc"]
    assert terms(T.truncate(2)(line("abc"))) == ["ab"]
    assert [(t.term, t.incr) for t in T.ngrams(1, 2)(line("abc"))] == [("a", 1), ("ab", 0), ("b", 0), ("bc", 0), ("c", 0)]
    assert terms(T.edge_ngrams(1, 2)(line("abc"))) == ["a", "ab"] and terms(T.edge_ngrams(1, 2, True)(line("abc"))) == ["c", "bc"]
    assert terms(T.reverse(line("abç", "éx"))) == ["çba", "xé"]
    assert [(t.term, t.incr) for t in T.unique(line("a", "b", "a", "c"))] == [("a", 1), ("b", 1), ("c", 2)]
    assert terms(T.normalise("NFKC")(line("ﬁ"))) == ["fi"]
    assert terms(T.apostrophe(line("Türkiye'de", "’x"))) == ["Türkiye", ""]
    assert terms(T.elision({"l"})(line("l'avion", "d'or"))) == ["avion", "d'or"]
    assert terms(T.possessive(line("marty's", "MARTY’S", "s"))) == ["marty", "MARTY", "s"]
    assert terms(T.camel_case(line("HTTPServer2Go"))) == ["HTTP", "Server", "2", "Go"]
    assert terms(T.compounds({"soft", "ball"})(line("softball"))) == ["softball", "soft", "ball"]
    assert T.read_words("a # note\n| all\n b \n") == {"a", "b"}
    marked = T.keyword_marker({"running"})(line("running", "jumping"))
    assert terms(T.each(stemmers.porter, keywords=True)(marked)) == ["running", "jump"]


def test_shingles():
    f = T.shingles(2, 2, original=False)
    assert terms(f(line("the", "quick", "brown"))) == ["the quick", "quick brown"]
    gap = [T.Token("sees"), T.Token("quick", incr=2)]
    assert terms(f(gap)) == ["sees _", "_ quick"]
    wide = T.shingles(3, 3, original=False)([T.Token("test", 0, 4), T.Token("text", 5, 9), T.Token("see", 12, 15, 2)])
    assert [(t.term, t.start, t.end, t.incr) for t in wide] == [("test text _", 0, 9, 1), ("text _ see", 5, 15, 1)]
    both = T.shingles(2, 3)(line("a", "b", "c"))
    assert [(t.term, t.incr) for t in both] == [("a", 1), ("b", 1), ("a b", 0), ("c", 1), ("b c", 0), ("a b c", 0)]
    assert terms(T.shingles(2, 2)(line("a", "b"))) == ["a", "b", "a b"]


def test_characters():
    assert T.strip_html("a<b class='x'>c</b>").split() == ["a", "c"]
    assert T.fold_ascii("Ærøskøbing naïve ﬁ") == "AEroskobing naive fi"
    assert T.replace_chars("([a-z]+)@x", "$1 at x")("me@x") == "me at x"
    assert T.split_joiners("a‌b") == "a b"


def test_cjk():
    analyze = languages.analyzer("cjk")
    assert terms(analyze("こんにちは 世界")) == ["こん", "んに", "にち", "ちは", "世界"]
    assert terms(analyze("一")) == ["一"] and terms(analyze("Ａｂ")) == ["ab"]


@pytest.mark.parametrize(
    "lang,pairs",
    [
        ("english", "running:run nation:nation nations:nation consistency:consist happily:happili dying:die skies:sky generously:generous knightly:knight cried:cri ties:tie by:by"),
        ("porter", "caresses:caress ponies:poni cats:cat feed:feed agreed:agre plastered:plaster motoring:motor conflated:conflat hopping:hop relational:relat rational:ration electrical:electr hopefulness:hope"),
        ("swedish", "jaktkarlarne:jaktkarl klokast:klok friheten:frihet"),
        ("danish", "undersøgelse:undersøg barnløshed:barnløs"),
        ("norwegian", "havnedistriktene:havnedistrikt opning:opning"),
        ("dutch", "lichamelijk:licham opglimlachten:opglimlacht"),
        ("russian", "важный:важн падал:пада"),
        ("german_light", "häuser:haus"),
        ("french_minimal", "chevaux:cheval"),
    ],
)
def test_stems(lang, pairs):
    for pair in pairs.split():
        w, want = pair.split(":")
        assert getattr(stemmers, lang)(w) == want, w


@pytest.mark.parametrize(
    "lang,pairs",
    [
        ("german", "aufeinanderfolgenden:aufeinanderfolg kategorischen:kategor häuser:haus"),
        ("spanish", "chicas:chic cheques:chequ tomando:tom claramente:clar"),
        ("italian", "abbandonata:abbandon propriamente:propr"),
        ("french", "continuellement:continuel majestueusement:majestu continuation:continu"),
        ("hungarian", "babakocsijáért:babakocs házak:ház"),
        ("finnish", "edeltäjien:edeltäj taloissa:talo"),
    ],
)
def test_snowball(lang, pairs):
    for pair in pairs.split():
        w, want = pair.split(":")
        assert getattr(snowball, lang)(w) == want, w


@given(st.text(alphabet="aeioubcdnrstlméèüöäíqgyh'", max_size=14))
@settings(max_examples=400, deadline=None)
def test_stemmers_take_any_word(word):
    for f in ("german", "spanish", "italian", "french", "hungarian", "finnish"):
        assert len(getattr(snowball, f)(word)) <= len(word) + 3
    for f in ("english", "porter", "swedish", "danish", "norwegian", "dutch", "russian", "german_light", "spanish_light", "italian_light", "portuguese_light", "french_light", "french_minimal", "hindi_stem", "arabic_light", "sorani_stem"):
        getattr(stemmers, f)(word)


def test_analysers():
    assert terms(languages.analyzer("en")("Leagues Under the Sea's")) == ["leagu", "sea"]
    for name in (*languages.LANGUAGES, "de-snowball", "fr-snowball", "cjk", "web", "standard", "simple", "keyword", "whitespace"):
        assert isinstance(languages.analyzer(name)("Text, 123 и текст متن पाठ"), list)
    with pytest.raises(ValueError):
        languages.analyzer("xx")


def test_native_terms_equal_python(spark):
    texts = ["The Quick brown-fox", "", "é漢字 x1y", None]
    df = spark.createDataFrame([(t,) for t in texts], "t string")
    got = [r[0] for r in df.select(F.transform(native.tokens(F.col("t"), "simple"), lambda x: x["term"])).collect()]
    assert got == [None if t is None else terms(languages.analyzer("simple")(t)) for t in texts]
    words = F.array(*map(F.lit, ("abcd", "a", "xyz")))
    row = spark.range(1).select(
        native.ngrams(words, 2, 3).alias("n"), native.edge_ngrams(words, 1, 2, True).alias("e"), native.shingles(words, 2).alias("s"),
        native.truncate(words, 2).alias("t"), native.keep_length(words, 2, 3).alias("l"), native.drop_stop(words, ["a"]).alias("d"),
    ).first()
    assert row.n == ["ab", "abc", "bc", "bcd", "cd", "xy", "xyz", "yz"] and row.e == ["d", "cd", "a", "z", "yz"]
    assert row.s == ["abcd a", "a xyz"] and row.t == ["ab", "a", "xy"] and row.l == ["xyz"] and row.d == ["abcd", "xyz"]


def test_distances():
    assert geo.parse_distance("100mi") == pytest.approx(160934.4) and geo.parse_distance("5") == 5
    assert geo.parse_distance("3nauticalmiles") == 5556 and geo.convert_distance(1000, "km") == 1
    with pytest.raises(ValueError):
        geo.parse_distance("5parsecs")


def test_points_of_all_kinds():
    assert geo.parse_point([1, 2]) == geo.parse_point("2,1") == geo.parse_point({"lng": 1, "lat": 2}) == (1.0, 2.0)
    lon, lat = geo.parse_point(geo.geohash_encode(-77.0365, 38.8977))
    assert lon == pytest.approx(-77.0365, abs=1e-6) and lat == pytest.approx(38.8977, abs=1e-6)
    assert geo.geohash_encode(-5.6, 42.6, 5) == "ezs42"


def test_geo_columns(spark):
    df = spark.createDataFrame([(-5.6, 42.6), (0.0, 0.0), (179.9, -89.9)], "lon double, lat double")
    rows = df.select("lon", "lat", geo.geohash(F.col("lon"), F.col("lat"), 7).alias("h"), geo.morton(F.col("lon"), F.col("lat")).alias("m")).collect()
    for r in rows:
        assert r.h == geo.geohash_encode(r.lon, r.lat, 7)
        x, y = int((r.lon + 180) * (geo.STEPS / 360)), int((r.lat + 90) * (geo.STEPS / 180))
        assert r.m & (2**64 - 1) == geo.interleave(x, y) and geo.deinterleave(geo.interleave(x, y)) == (x, y)


@given(st.floats(-170, 170), st.floats(-80, 80), st.floats(1, 2_000_000), st.floats(0, 2 * math.pi), st.floats(0, 1))
@settings(max_examples=200, deadline=None)
def test_box_holds_the_circle(lon, lat, meters, angle, part):
    left, top, right, bottom = geo.box_around(lon, lat, meters)
    d = part * meters / 6378137
    y = math.asin(math.sin(math.radians(lat)) * math.cos(d) + math.cos(math.radians(lat)) * math.sin(d) * math.cos(angle))
    x = math.radians(lon) + math.atan2(math.sin(angle) * math.sin(d) * math.cos(math.radians(lat)), math.cos(d) - math.sin(math.radians(lat)) * math.sin(y))
    px, py = (math.degrees(x) + 540) % 360 - 180, math.degrees(y)
    assert bottom - 1e-6 <= py <= top + 1e-6
    assert (px >= left - 1e-6 or px <= right + 1e-6) if right < left else (left - 1e-6 <= px <= right + 1e-6)


@given(st.floats(allow_nan=False), st.floats(allow_nan=False))
@settings(deadline=None)
def test_sortable_numbers(a, b):
    assert geo.sortable_float(geo.sortable_int(a)) == a
    if a < b:
        assert geo.sortable_int(a) < geo.sortable_int(b)
        assert geo.prefix_coded(geo.sortable_int(a)) < geo.prefix_coded(geo.sortable_int(b))
    for shift in (0, 4, 60):
        v, s = geo.prefix_decoded(geo.prefix_coded(geo.sortable_int(a), shift))
        assert s == shift and v == geo.sortable_int(a) >> shift << shift


def test_chunks_equal_the_whole_text():
    texts = ("", " the  \n of", "word. (x) the&& #foo foo## www.&& xhttps://&& _a_ 'dogs' DOGS'S. l' é. the@x.com \\the/ the-a {the} ~the^")
    texts += ("豈 一二", "\ufa6c 一 二三 ｱｲ ｶﾞ", "l'avion d’eau the\tTHE", "a" * 300 + " the " + "b-c" * 200, "می‌خواهم و در", "İstanbul'da ve", "0 00 the")
    for name in ("standard", "web", "cjk", *languages.LANGUAGES, "fr-snowball"):
        for text in texts:
            found = languages.analyzer(name)(text)
            chunks, got, start = languages.by_chunk(name), [], 0
            for c in chunks.chunks(text):
                terms, at, moved = chunks.of(c)
                got += [(t, start + p) for t, p in zip(terms, at)]
                start += moved
            assert got == list(zip([t.term for t in found], T.positions(found))), (name, text)
            assert chunks.counts(text) == {t: len(at) for t, at in T.frequencies(found).items()}


def test_what_analysers_hold_in_python_is_bounded(spark):
    """Tokens of a batch become Arrow as they are found: once they were all Python objects."""
    from inkwell.functions.native import _Lists

    out, most = _Lists("pos", pa.int32()), 0
    for k in range(3000):
        out.terms += ["word"] * 500
        out.numbers.extend(range(500))
        out.end()
        most = max(most, len(out.terms))
    assert most < _Lists.FLUSH + 500 and len(out.all()) == 3000
    rows = spark.createDataFrame([(k, "cats the dog, cats " * 300) for k in range(1000)] + [(-1, None), (-2, "")], "k int, s string")
    got = rows.select("k", native.tokens(F.col("s"), "en").alias("t"), native.counted_words(F.col("s"), "en").alias("c")).coalesce(1)
    by = {r.k: r for r in got.collect()}
    assert by[-1].t is None and by[-1].c is None and by[-2].t == [] and by[-2].c == []
    assert all([x.pos for x in by[k].t[:4]] == [1, 3, 4, 5] and {(x.term, x.n) for x in by[k].c} == {("cat", 600), ("dog", 300)} for k in range(1000))


def test_terms_counted_in_the_row(spark):
    """No shuffle of terms, no second evaluation, but rows that share their id are counted together."""
    rows = [(1, "b a b"), (2, "a"), (2, "a c"), (None, "z"), (None, "z"), (3, ""), (4, None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    counts = native.counted(native.simple_terms(F.col("text")))
    got = registry.term_counts(docs, counts)
    want = {(1, "b", 2), (1, "a", 1), (2, "a", 2), (2, "c", 1), (None, "z", 2)}
    assert sorted(map(tuple, got.collect()), key=str) == sorted(want, key=str)
    alone = registry.term_counts(docs.where("doc_id = 1"), counts)
    assert sorted(map(tuple, alone.collect())) == [(1, "a", 1), (1, "b", 2)]
    plan = alone._jdf.queryExecution().optimizedPlan().toString()
    assert "Aggregate" not in plan and plan.count("regexp_extract_all") == 1
