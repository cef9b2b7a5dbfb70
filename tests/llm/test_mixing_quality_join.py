"""Mixing, the attention classifier, the Jaccard join and the pipeline against brute force."""

import itertools
import random
import re
import unicodedata

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from inkwell.llm import jaccard_join as J
from inkwell.llm import mixing, queries
from inkwell.llm import quality_mil as M
from inkwell.session import table

# --- mixing --------------------------------------------------------------------------------


@pytest.fixture(scope="module")
def sources(spark):
    rng = random.Random(4)
    rows = [(i, " ".join(["w"] * rng.randint(1, 60)), rng.choice("aaaaaabbc")) for i in range(1500)]
    return spark.createDataFrame(rows, "doc_id long, text string, source string")


SCHEDULE = {"a": [1.0, 1.0, 0.2], "b": [0.5, 2.0, 2.0], "c": [0.0, 0.5, 1.0]}
KNOTS = (0.0, 0.4, 1.0)


def share(source, t):
    w = {s: np.interp(t, KNOTS, np.array(v) / sum(np.array(list(SCHEDULE.values())))) for s, v in SCHEDULE.items()}
    return w[source]


@pytest.mark.parametrize("budget", [None, 20_000.0])
def test_mix_follows_the_schedule(sources, budget):
    rows = mixing.mix_sources(sources, schedule=SCHEDULE, knots=KNOTS, budget=budget).collect()
    assert all(0 <= r.position < 1 for r in rows)
    total = sum(r.n_tokens for r in rows)
    if budget:
        assert abs(total - budget) < 200
    else:
        assert {r.doc_id for r in rows} == set(range(1500))
        assert min(max(r.epoch for r in rows if r.source == s) for s in "abc") == 0
    grid = np.linspace(0, 1, 2001)
    for s in "abc":
        mine = sorted((r.position, r.n_tokens) for r in rows if r.source == s)
        at, tokens = np.array([p for p, _ in mine]), np.cumsum([n for _, n in mine])
        area = np.concatenate(([0], np.cumsum((share(s, grid[1:]) + share(s, grid[:-1])) / 2 * np.diff(grid))))
        for t in (0.1, 0.3, 0.5, 0.8, 1.0):
            want = (budget or total) * np.interp(t, grid, area)
            got = tokens[np.searchsorted(at, t) - 1] if (at < t).any() else 0
            assert abs(got - want) <= 60 + 0.01 * want


def test_positions_invert_demand(spark):
    """The closed form against numerical integration, flat and sloping segments."""
    shares, knots = [0.2, 0.2, 0.6, 0.1], [0.0, 0.3, 0.7, 1.0]
    grid = np.linspace(0, 1, 200_001)
    f = np.interp(grid, knots, shares)
    area = np.concatenate(([0], np.cumsum((f[1:] + f[:-1]) / 2 * np.diff(grid))))
    q = np.linspace(0, area[-1] * 0.9999, 57)
    df = spark.createDataFrame([(float(x),) for x in q], "q double")
    got = [r[0] for r in df.select(mixing.due(F.col("q"), [F.lit(s) for s in shares], knots)).collect()]
    assert np.allclose(got, np.interp(q, area, grid), atol=1e-5)


@pytest.mark.parametrize("parts", [1, 7, 300])
def test_rows_are_in_order_and_positions_do_not_depend_on_the_parts(sources, parts):
    mixed = mixing.mix_sources(sources, parts=parts, schedule=SCHEDULE, knots=KNOTS)
    assert mixed.rdd.getNumPartitions() == parts
    rows = mixed.select(F.spark_partition_id().alias("p"), "position", "doc_id", "epoch").collect()
    assert [r.position for r in rows] == sorted(r.position for r in rows)
    assert all(min(int(r.position * parts), parts - 1) == r.p for r in rows)
    other = mixing.mix_sources(sources, parts=3, schedule=SCHEDULE, knots=KNOTS).collect()
    key = lambda rs: sorted((r.doc_id, r.epoch, round(r.position, 9)) for r in rs)
    assert key(rows) == key(other)


def test_whole_rows_are_shuffled_once(spark, sf):
    docs = table(spark, sf, "documents")
    plan = mixing.mix_sources(docs, carry=True)._jdf.queryExecution().executedPlan().toString()
    plan = plan.split("== Initial Plan ==")[0]
    wide = [x for x in plan.split("\n") if re.search(r"\bExchange (?!Single)", x) and "Broadcast" not in x and "hashpartitioning" not in x]
    assert len(wide) == 1 and "part#" in wide[0] and "SortMergeJoin" not in plan


def test_unspaced_words_are_counted(spark):
    rows = [("漢字 and かな。\tx", 7), ("a  b", 2), (" ", 0), (None, 0), ("ไทย", 3)]
    got = spark.createDataFrame(rows, "t string, n int").select(mixing.word_count(F.col("t")).alias("m"), "n").collect()
    assert [r.m for r in got] == [r.n for r in got]


def test_tokens_may_be_given(spark):
    df = spark.createDataFrame([(i, "x", "s", i % 5) for i in range(50)], "doc_id long, text string, source string, tokens int")
    assert {(r.doc_id, r.n_tokens) for r in mixing.mix_sources(df, tokens_col="tokens").collect()} == {(i, i % 5) for i in range(50)}


def test_columns_of_any_name_are_carried(spark):
    names = ["doc_id", "Text", "source", "s", "b", "N", "h", "part", "__n", "EPOCH", "a.b", "position", "lo", "c1"]
    df = spark.createDataFrame([tuple([1, "x y", "s", *range(11)])], ", ".join(f"v{i} {t}" for i, t in enumerate(["int", "string", "string"] + ["int"] * 11))).toDF(*names)
    out = mixing.mix_sources(df, carry=True)
    kept = [n for n in names if n not in ("EPOCH", "position")]
    assert out.columns == [*kept, "epoch", "position"]
    assert list(out.first())[3:-2] == [v for n, v in zip(names[3:], range(11)) if n in kept]


def test_mixing_against_its_sql(spark, odd, tmp_path):
    duckdb = pytest.importorskip("duckdb")
    more = spark.createDataFrame([(i % 300, f"word {'x ' * (i % 9)}" if i % 7 else None, ["a", "b", None][i % 3]) for i in range(600)] + [(900, " ", "blank"), (901, "", "blank")], "doc_id long, text string, source string")
    both = more.unionByName(odd.select("doc_id", "text", "source"))
    both.write.parquet(str(tmp_path / "d"))
    con = duckdb.connect()
    con.execute(f"CREATE VIEW documents AS SELECT * FROM '{tmp_path}/d/*.parquet'")
    want = con.execute(mixing.oracle()).fetchall()
    got = [(*list(r)[:4], round(r.position, 6)) for r in mixing.mix_sources(both, parts=9).collect()]
    flat = lambda rows: sorted(map(repr, rows))
    assert flat(got) == flat(want)
    assert {r[0] for r in got} == {r.doc_id for r in both.collect()}


def test_mixing_edges(odd, none, nameless):
    rows = mixing.mix_sources(odd).collect()
    assert {r.doc_id for r in rows} == {1, 2, 3, 4, 5, 6, 7, 8, None} and {r.source for r in rows} == {None, "s0", "s1", "s2"}
    assert len([r for r in rows if r.doc_id == 1 and r.epoch == 0]) == 2
    assert mixing.mix_sources(none).count() == 0
    assert [(r.position, r.epoch) for r in mixing.mix_sources(nameless).collect()] == [(0.0, 0)] * 3  # no tokens: once, at 0
    whole = mixing.mix_sources(odd, carry=True)
    assert whole.columns == [c for c in odd.columns if c not in ("epoch", "position")] + ["epoch", "position"]
    assert whole.count() == len(rows)


def test_null_sources_have_a_weight(spark):
    df = spark.createDataFrame([(1, "a b", None), (2, "c d", "s"), (3, "e f", "unlisted")], "doc_id long, text string, source string")
    rows = mixing.mix_sources(df, schedule={None: [1.0, 1.0], "s": [1.0, 1.0]}).collect()
    assert {r.doc_id for r in rows} == {1, 2}


# --- quality -------------------------------------------------------------------------------


def test_attention_gradients():
    rng = np.random.default_rng(0)
    count = np.array([1, 3, 2, 5])
    x, y = rng.standard_normal((11, 7)).astype(np.float64), np.array([1.0, 0, 1, 0])
    p = {"E": rng.standard_normal((7, 4)), "e": rng.standard_normal(4), "V": rng.standard_normal((4, 3)), "U": rng.standard_normal((4, 3)),
         "w": rng.standard_normal(3), "c": rng.standard_normal(4), "b": np.array(0.3)}
    model = M.Mil(np.zeros(7), p)

    def loss():
        s = model.score(x, count)
        return -np.mean(y * np.log(s) + (1 - y) * np.log(1 - s))

    for k, g in model.gradients(x, count, y, 0.0).items():
        for i in np.ndindex(p[k].shape):
            was, eps = p[k][i], 1e-6
            p[k][i] = was + eps
            up = loss()
            p[k][i] = was - eps
            down = loss()
            p[k][i] = was
            assert (up - down) / (2 * eps) == pytest.approx(g[i], abs=1e-6)
    a = model.attention(x, count)
    assert np.allclose(np.add.reduceat(a, np.cumsum(count) - count), 1)


def test_passages_cover_documents():
    docs = [b"A", b"Some longer text, with 12 numbers!" * 20, b"z" * 999]
    raw = np.frombuffer(b"".join(docs), np.uint8)
    offsets = np.cumsum([0, *map(len, docs)])
    x, count = M.encode_passages(raw, offsets, 100)
    assert count.tolist() == [1, 7, 10]
    first = np.cumsum(count) - count
    for d, f, c in zip(docs, first, count):
        sizes = np.diff([k * len(d) // c for k in range(c + 1)])
        digits = (x[f : f + c, M.BUCKETS + 2] ** 2 * sizes).sum()
        assert digits == pytest.approx(sum(ch in b"0123456789" for ch in d), abs=1e-3)
        alone, _ = M.encode_passages(np.frombuffer(d, np.uint8), np.array([0, len(d)]), 100)
        assert np.array_equal(alone, x[f : f + c])


def bags(rng, n):
    """Bad documents hold one shouted passage among good ones."""
    words = "river stone morning garden letter window people water winter summer".split()
    say = lambda k: " ".join(rng.choice(words) for _ in range(k))
    rows = []
    for i in range(n):
        text = say(rng.randint(100, 900))
        if i % 2:
            at = rng.randrange(len(text))
            text = text[:at] + " BUY!!! NOW!!! FREE!!! $$$ " * 12 + text[at:]
        rows.append((i, text, 1 - i % 2))
    return rows


def test_held_out_accuracy_and_attention(spark):
    rows = bags(random.Random(8), 600)
    docs = spark.createDataFrame([r[:2] for r in rows], "doc_id long, text string")
    labels = spark.createDataFrame([(i, y) for i, _, y in rows if i < 400], "doc_id long, quality int")
    got = {r.doc_id: r.keep for r in M.score_quality(docs, labels, passage=256).collect()}
    right = sum(got[i] == bool(y) for i, _, y in rows if i >= 400)
    assert right >= 196
    model = M.fit(docs, labels, passage=256)
    text = next(t for i, t, y in rows if i >= 400 and not y).encode()
    x, count = M.encode_passages(np.frombuffer(text, np.uint8), np.array([0, len(text)]), 256)
    shouted = text.find(b"BUY") * count[0] // len(text)
    a = model.attention(x, count)
    assert a[shouted : shouted + 3].sum() > 0.5 * a.sum()


def test_quality_edges(spark, odd, none, nameless):
    labels = spark.createDataFrame([(1, 1), (1, 0), (None, 0), (5, None), (99, 0)], "doc_id long, quality int")
    rows = M.score_quality(odd, labels).collect()  # too few labels: nothing with words is rejected
    assert len(rows) == odd.count()
    assert {r.doc_id for r in rows if not r.keep} == {3, 4} and all((r.quality_score is None) == (not r.keep) for r in rows)
    for df in (none, nameless):
        assert M.score_quality(df, labels).where("keep").count() == 0
    kept = M.keep_quality(odd, labels)
    assert kept.schema == odd.schema and kept.count() == odd.count() - 2
    assert M.score_quality(odd, labels.limit(0)).count() == odd.count()


def test_scores_of_the_corpus(spark):
    """Held-out accuracy on labelled documents of the test data."""
    d = "/root/testdata/sf0.01"
    docs, labels = table(spark, d, "documents"), table(spark, d, "labels")
    train = labels.where("doc_id % 3 > 0")
    rows = M.score_quality(docs, train).join(labels.where("doc_id % 3 = 0"), "doc_id").collect()
    good = [r.keep for r in rows if r.quality == 1]
    bad = [r.keep for r in rows if r.quality == 0]
    assert np.mean(good) >= 0.97 and np.mean(bad) <= 0.1


# --- Jaccard join --------------------------------------------------------------------------


def gram_set(text, n=3):
    w = re.findall("[0-9a-z\x80-\U0010ffff]+", re.sub("[A-Z]", lambda m: m[0].lower(), text))
    return {tuple(w[i : i + n]) for i in range(max(1, len(w) - n + 1))} if w else set()


def brute(rows, t):
    sets = [(i, g) for i, s in rows if i is not None and s and (g := gram_set(s))]
    out = {}
    for (a, x), (b, y) in itertools.combinations(sets, 2):
        if a != b and (j := len(x & y) / len(x | y)) >= t:
            key = (min(a, b), max(a, b))
            out[key] = max(j, out.get(key, 0))
    return out


@pytest.fixture(scope="module")
def copies():
    rng = random.Random(9)
    vocab = [f"w{i}" for i in range(400)]
    passage = [rng.choice(vocab) for _ in range(60)]
    rows, i = [], 0
    for _ in range(60):
        base = [rng.choice(vocab) for _ in range(rng.randint(3, 120))]
        if rng.random() < 0.3:
            base += passage
        for k in range(rng.choice((1, 1, 2, 5))):
            w = list(base)
            for _ in range(k * len(w) // 40):
                w[rng.randrange(len(w))] = rng.choice(vocab)
            rows.append((i, " ".join(w)))
            i += 1
    rows += [(i + k, "the very same text in all of these copies") for k in range(6)]
    return rows + [(1000, "One, two!"), (1001, "one two"), (1002, ""), (1003, None), (None, "one two"), (1004, "...")]


def classes_of(rows, t):
    """Brute force over (id, distinct text): class and number of links of every id."""
    nodes = sorted({(i, frozenset(gram_set(x))) for i, x in rows if i is not None and x and gram_set(x)}, key=lambda n: n[0])
    near = [
        (a, b) for a, b in itertools.combinations(nodes, 2) if len(a[1] & b[1]) / len(a[1] | b[1]) >= t
    ]
    links = dict.fromkeys((i for i, _ in rows if i is not None), 0)
    for a, b in near:
        links[a[0]] += 1
        links[b[0]] += 1
    roots = components([(a[0], b[0]) for a, b in near])
    return {i: (roots.get(i, i), n) for i, n in links.items()}


@pytest.mark.parametrize("tile,most", [(5, 2_000_000), (1024, 2_000_000), (1024, 150)])
def test_classes_are_exact_on_a_fixture(spark, copies, tile, most):
    df = spark.createDataFrame(copies, "doc_id long, text string")
    # Of so many bands and rows of one hash each, no pair above the threshold is without a key.
    got = J.jaccard_classes(df, tile=tile, tile_grams=most, bands=60, rows=1).collect()
    assert {r.doc_id: (r.class_id, r.n_links) for r in got} == classes_of(copies, 0.5) and len(got) == len({i for i, _ in copies} - {None})


def test_pairs_and_membership_give_all_links(spark, copies):
    df = spark.createDataFrame(copies, "doc_id long, text string")
    rows = J.jaccard_join(df, tile=7, bands=60, rows=1).collect()
    got = {(r.doc_a, r.doc_b): r.jaccard for r in rows}
    assert len(got) == len(rows)
    sets = {i: frozenset(gram_set(x)) for i, x in copies if i is not None and x and gram_set(x)}
    least = {}
    for i in sorted(sets):
        least.setdefault(sets[i], i)
    full = brute(copies, 0.5)
    assert got == pytest.approx({k: v for k, v in full.items() if all(least[sets[x]] == x for x in k) or (v == 1 and least[sets[k[1]]] == k[0])})


def test_pairs_without_a_minhash_key_are_found(spark):
    rows = []
    for k in range(1500):  # 24 n-grams of which 16 are shared: a similarity of exactly a half
        a = [f"a{k}x{i}" for i in range(26)]
        rows += [(2 * k, " ".join(a)), (2 * k + 1, " ".join(a[:18] + [f"b{k}x{i}" for i in range(8)]))]
    grams, count = J.gram_sets(*J.utf8(pa.array([x for _, x in rows]))[:2], 3)
    keys = J.minhash_keys(grams, count, 36, 3)
    missed = [k for k in range(1500) if not (keys[2 * k] == keys[2 * k + 1]).any()]
    assert len(missed) > 3
    rows = [rows[i] for k in missed for i in (2 * k, 2 * k + 1)]
    got = J.jaccard_classes(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert {r.doc_id: (r.class_id, r.n_links) for r in got} == {i: (i // 2 * 2, 1) for i, _ in rows}


@pytest.mark.parametrize("t", [0.3, 0.5, 0.8])
def test_all_pairs_are_found_whatever_the_keys(spark, copies, monkeypatch, t):
    monkeypatch.setattr(J, "COUNTED", 500)  # several buckets
    df = spark.createDataFrame(copies, "doc_id long, text string")
    got = J.jaccard_classes(df, threshold=t, bands=1, rows=9).collect()
    assert {r.doc_id: (r.class_id, r.n_links) for r in got} == classes_of(copies, t)


def test_tiles_cover_every_pair_once(spark):
    rng = random.Random(5)
    rows = [(rng.choice((1, 1, 1, 2)), i, i, i, rng.randint(1, 400)) for i in range(600)]
    df = spark.createDataFrame(rows, "g long, doc_id long, w1 long, w2 long, size int")
    tiles = {}
    for r in J.in_tiles(df, "g", 0.5, 50, 4000).collect():
        for t in r.tiles:
            tiles.setdefault((r.g, t.i, t.j), []).append((t.side, r.doc_id, r["size"]))
    met = []
    for (g, i, j), members in tiles.items():
        assert len(members) < 200
        left, right = ([m for m in members if m[0] % 2 == s % 2 and m[0] >= s] for s in (1, 2))
        assert {m[0] for m in members} <= ({0} if i == j else {1, 2})
        met += [tuple(sorted((a[1], b[1]))) for a, b in (itertools.combinations(members, 2) if i == j else itertools.product(left, right))]
    assert len(met) == len(set(met))
    want = {(a[1], b[1]) for a, b in itertools.combinations(rows, 2) if a[0] == b[0] and min(a[4], b[4]) >= max(a[4], b[4]) / 2}
    assert want <= set(met)


@pytest.mark.parametrize("most", [1, 50, 10**6])
def test_tile_stage_is_exact(most):
    rng = np.random.default_rng(3)
    base = [rng.choice(np.arange(2000, dtype=np.uint64), 60, replace=False) for _ in range(6)]
    sets = [np.unique(np.append(rng.choice(base[k % 6], rng.integers(5, 60), replace=False), rng.integers(5000, 10**9, rng.integers(0, 40)).astype(np.uint64))) for k in range(150)]
    count, flat = np.array([len(x) for x in sets]), np.concatenate(sets)
    maps, words = J.bitmaps_of(flat, count)
    starts, side = np.array([0, 70, 150]), np.array([0] * 70 + [1] * 30 + [2] * 50)
    got = {}
    for i, j in J.tile_pairs(starts, side, most):
        i, j, both, jac = J.exact(*J.possible(i, j, count, maps, words, 0.5), flat, count, 0.5, most)
        got |= {(a, b): (n, x) for a, b, n, x in zip(i.tolist(), j.tolist(), both.tolist(), jac.tolist())}
    want = {}
    for a, b in [*itertools.combinations(range(70), 2), *itertools.product(range(70, 100), range(100, 150))]:
        n = len(set(sets[a].tolist()) & set(sets[b].tolist()))
        if 2 * n >= count[a] + count[b] - n:
            want[a, b] = (n, n / (count[a] + count[b] - n))
    assert got == want


def test_shared_footers_link_nothing(spark):
    rng = random.Random(1)
    vocab = [f"w{i}" for i in range(5000)]
    foot = "this page was made by the friendly staff of our small town library in spring"
    rows = [(i, " ".join(rng.choices(vocab, k=rng.randint(30, 80))) + " " + foot) for i in range(2000)]
    rows += [(5000 + i, rows[i][1] + " more") for i in range(5)]
    join = J.Join(spark.createDataFrame(rows, "doc_id long, text string"), "doc_id", "text", 3, 0.5, 36, 3, 1024, 2_000_000)
    blocks = [r["count"] for r in join.tiles.groupBy("block").count().collect()]
    assert max(blocks) <= 3 and 5 <= len(blocks) <= 40  # the bound lets a few chance pairs through


def unicode_words(text):
    """By characters: letters, marks and digits run on, those of unspaced scripts stand alone."""
    out, going = [], False
    for c in re.sub("[A-Z]", lambda m: m[0].lower(), text):
        alone = re.match("[\u0e00-\u0eff\u3005-\u3007\u3040-\u30ff\u4e00-\u9fff\U00020000-\U0002a6df]", c)
        if unicodedata.category(c)[0] not in "LMN":
            going = False
        elif alone or not going:
            out.append(c)
            going = not alone
        else:
            out[-1] += c
    return out


def test_words_are_unicode_words():
    rng = random.Random(12)
    letters = "abZ 9é\u0301ßЖ漢字。、ひカーไทยกี่ \u00a0—“”’\u2009한국𠀀🎉,.\u3000"
    texts = ["".join(rng.choices(letters, k=rng.randrange(40))) for _ in range(400)]
    hashes, count = J.word_hashes(*J.utf8(pa.array(texts))[:2])
    words = [unicode_words(t) for t in texts]
    assert count.tolist() == [len(w) for w in words]
    flat = [w for ws in words for w in ws]
    assert len(set(flat)) == len(set(hashes.tolist())) == len(set(zip(flat, hashes.tolist())))


def test_near_copies_without_spaces_are_joined(spark):
    rng = random.Random(13)
    rows = []
    for k, script in enumerate((range(0x4E00, 0x5200), range(0x3041, 0x3090), range(0x0E01, 0x0E2E))):
        a = "".join(chr(rng.choice(script)) for _ in range(133))
        rows += [(2 * k, a[:60] + "。" + a[60:]), (2 * k + 1, a[:30] + "们" + a[31:60] + "，" + a[60:100] + "们" + a[101:])]
    a = [f"w{rng.randrange(99)}" for _ in range(60)]
    rows += [(6, " ".join(a)), (7, "\u00a0— ".join(a))]
    got = J.jaccard_join(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    grams = [{tuple(w[i : i + 3]) for i in range(len(w) - 2)} for w in (unicode_words(t) for _, t in rows)]
    assert {(r.doc_a, r.doc_b) for r in got} == {(0, 1), (2, 3), (4, 5), (6, 7)}
    for r in got:
        x, y = grams[r.doc_a], grams[r.doc_b]
        assert r.jaccard == pytest.approx(len(x & y) / len(x | y))


def components(pairs):
    root: dict = {}

    def find(x):
        while root.setdefault(x, x) != x:
            x = root[x]
        return x

    for a, b in pairs:
        a, b = find(a), find(b)
        root[max(a, b)] = min(a, b)
    return {x: find(x) for x in list(root)}


def test_near_copies_are_dropped(spark, copies):
    df = spark.createDataFrame(copies, "doc_id long, text string")
    gone = {i for i, (c, _) in classes_of(copies, 0.5).items() if c != i}
    kept = J.drop_near_duplicates(df, bands=60, rows=1)
    assert kept.columns == df.columns
    ids = [r.doc_id for r in kept.collect()]
    assert sorted(ids, key=str) == sorted((i for i, _ in copies if i not in gone), key=str)


@pytest.mark.parametrize("most", [300, 40])
def test_bitmaps_bound_overlap(most):
    rng = np.random.default_rng(1)
    sets = [np.unique(rng.integers(0, 500, rng.integers(1, most)).astype(np.uint64)) for _ in range(40)]
    count = np.array([len(s) for s in sets])
    maps, words = J.bitmaps_of(np.concatenate(sets), count)
    assert len(maps) == words.sum() and (words * 64 >= 2 * count).all()
    i, j = np.triu_indices(40, 1)
    for t in (0.1, 0.3, 0.6):
        kept = set(zip(*(x.tolist() for x in J.possible(i, j, count, maps, words, t))))
        for a, b in zip(i.tolist(), j.tolist()):
            both = len(np.intersect1d(sets[a], sets[b]))
            assert both / (count[a] + count[b] - both) < t or (a, b) in kept


def test_components(spark):
    rng = random.Random(2)
    edges = [(i, i + 1) for i in range(0, 60)] + [(rng.randrange(100, 300), rng.randrange(100, 300)) for _ in range(150)]
    df = spark.createDataFrame(edges, "a long, b long")
    got = {r.node: r.root for r in J.components(df).collect()}
    want = {x: r for x, r in components([e for e in edges if e[0] != e[1]]).items() if x != r}
    assert {x: r for x, r in got.items() if x != r} == want
    assert J.components(df.limit(0)).count() == 0


def test_join_edges(spark, odd, none, nameless):
    got = {(r.doc_a, r.doc_b): r.jaccard for r in J.jaccard_join(odd).collect()}
    assert got == {(1, 2): 1.0}
    rows = {r.doc_id: (r.class_id, r.n_links) for r in J.jaccard_classes(odd).collect()}
    assert rows == {i: (1, 1) if i < 3 else (i, 0) for i in range(1, 9)}
    for f in (J.jaccard_join, J.jaccard_classes):
        assert f(none).count() == 0 and f(nameless).count() == 0
    several = [(1, "a b c d e"), (1, "v w x y z"), (2, "a b c d e f"), (3, "v w x y z"), (3, "v w x y z"), (4, "else where"), (None, "a b c d e")]
    df = spark.createDataFrame(several, "doc_id long, text string")
    rows = {r.doc_id: (r.class_id, r.n_links) for r in J.jaccard_classes(df, bands=60, rows=1).collect()}
    assert rows == classes_of(several, 0.5) == {1: (1, 2), 2: (1, 1), 3: (1, 1), 4: (4, 0)}
    kept = J.drop_near_duplicates(odd)
    assert sorted(str(r.doc_id) for r in kept.collect()) == sorted("1 1 3 4 None 5 6 7 8".split())
    assert J.drop_near_duplicates(none).count() == 0 and J.drop_near_duplicates(nameless).count() == 3


# --- pipeline ------------------------------------------------------------------------------


def test_pipeline_against_its_stages(spark, sf, tmp_path):
    docs = table(spark, sf, "documents")
    names = [n for n, _ in corpus_pipeline.STAGES]
    assert names == ["quality", "near_duplicates", "personal_data", "mixing", "packing"]
    labels = {r.doc_id: r.quality for r in table(spark, sf, "labels").collect()}
    at, out = docs, {}
    for name, stage in corpus_pipeline.STAGES:
        df = stage(spark, at, sf)
        if name != "packing":
            assert df.columns == docs.columns, name
        df.write.parquet(str(tmp_path / name))
        at = spark.read.parquet(str(tmp_path / name))
        out[name] = at.collect()
    kept = {r.doc_id for r in out["quality"]}
    assert np.mean([i in kept for i, y in labels.items() if y == 1]) > 0.95
    assert np.mean([i in kept for i, y in labels.items() if y == 0]) < 0.2
    rows = [(r.doc_id, r.text) for r in out["quality"]]
    roots = components(brute(rows, 0.5))
    assert {r.doc_id for r in out["near_duplicates"]} == {i for i, _ in rows if roots.get(i, i) == i}
    clean = {r.doc_id: r for r in out["personal_data"]}
    key = queries.pseudonyms.Pseudonyms(queries.pseudonyms.secret_key(spark))
    assert len(clean) == len(out["near_duplicates"])
    for r in out["near_duplicates"]:
        assert clean[r.doc_id].text == key.replace(r.text)[0]
    assert {r.doc_id for r in out["mixing"]} == set(clean)
    packed = [p.doc_id for w in out["packing"] for p in w.pieces]
    assert set(packed) == {r.doc_id for r in out["mixing"] if r.text.strip("")}
    assert corpus_pipeline.run(spark, sf).count() == len(out["packing"])


@pytest.mark.parametrize("which", ["odd", "none", "nameless"])
def test_every_stage_takes_odd_tables(spark, request, sf, which):
    docs = request.getfixturevalue(which)
    for name, stage in corpus_pipeline.STAGES:
        out = stage(spark, docs, sf)
        if name != "packing":
            assert out.columns == docs.columns, name
        rows = out.collect()
        if which == "none":
            assert not rows
        if which == "odd":
            found = {r.doc_id for r in rows} if name != "packing" else {p.doc_id for r in rows for p in r.pieces}
            assert found >= {1, 7} if name == "quality" else found >= {None, 1, 5, 6, 7, 8}


def test_packing_follows_the_files(spark, sf, tmp_path):
    mixed = corpus_pipeline.mixing(spark, table(spark, sf, "documents"), sf)
    mixed.write.parquet(str(tmp_path / "m"))
    read = spark.read.parquet(str(tmp_path / "m"))
    order = [
        r.doc_id
        for r in read.select("doc_id", "_metadata.file_name", "_metadata.row_index").orderBy("file_name", "row_index").collect()
    ]
    windows = corpus_pipeline.packing(spark, read, sf).orderBy("shard", "window").collect()
    got = [p.doc_id for w in windows for p in w.pieces if p.start == 0]
    assert got == order


def test_every_query_is_registered():
    assert [int(re.match(r"op(\d+)_", n)[1]) for n in queries.QUERIES] == list(range(1, 11))
