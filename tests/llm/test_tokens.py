"""Token output, prefix counts, packing and fertility against the tokenizers themselves."""

import itertools
import math
import random

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from inkwell.llm import fertility, packing, prefix_counts, queries, token_output
from inkwell.llm import common
from inkwell.llm.common import BYTE_BPE, PIECE_BPE, ByteBpe, loaded

TEXTS = st.text(alphabet=st.sampled_from(list(" \n\t'srevlmdtABC helo12é漢🎉!?　 \x1c.,½²")), max_size=30)


@given(TEXTS)
@settings(max_examples=300, deadline=None)
def test_cached_ids_are_exact(text):
    bpe = loaded(ByteBpe, BYTE_BPE)
    assert bpe.encode(text).tolist() == bpe.encoding.encode_ordinary(text)


@given(TEXTS)
@settings(max_examples=150, deadline=None)
def test_counts_at_every_prefix_are_exact(text):
    bpe = loaded(prefix_counts.PrefixBpe, BYTE_BPE)
    width, data = bpe.changes(text)
    got = np.cumsum(prefix_counts.changes_of(width, data)).tolist()
    assert got == [len(bpe.encoding.encode_ordinary(text[: i + 1])) for i in range(len(text))]


def test_counts_of_long_pieces():
    bpe = loaded(prefix_counts.PrefixBpe, BYTE_BPE)
    for text in ("a" * 300, " " * 300 + "x", "=-" * 120, "\n" * 200, "zqj" * 90 + "é"):
        width, data = bpe.changes(text)
        got = np.cumsum(prefix_counts.changes_of(width, data)).tolist()
        assert got == [len(bpe.encoding.encode_ordinary(text[: i + 1])) for i in range(len(text))]


@given(TEXTS)
@settings(max_examples=200, deadline=None)
def test_pieces_by_word_are_exact(text):
    model = loaded(common.Pieces, PIECE_BPE)
    assert model.encode(text).tolist() == model.model.encode(text)


@given(st.integers(1, 32), st.integers(1, 9), st.data())
@settings(max_examples=200, deadline=None)
def test_bit_packing_round_trip(bits, block, data):
    ids = np.array(data.draw(st.lists(st.integers(0, 2**bits - 1), max_size=40)), np.uint32)
    payload, offsets = token_output.pack_blocks(ids, bits, block)
    assert len(offsets) == -(-len(ids) // block) + 1 and offsets[-1] == len(payload)
    for start, stop in ((0, len(ids)), (3, 17), (8, 9), (5, 5)):
        got = token_output.read_tokens(payload, offsets, len(ids), bits, block, start, stop)
        assert got.tolist() == ids[start:stop].tolist()
    if bits < 32 and len(ids):
        with pytest.raises(ValueError):
            token_output.pack_bits(np.array([2**bits], np.uint64).astype(np.uint32), bits)


def test_vocabulary_bits():
    assert [token_output.bits_for(n) for n in (1, 2, 3, 256, 257, 32_000, 50_257, 65_536, 65_537)] == [1, 1, 2, 8, 9, 15, 16, 16, 17]


def test_many_documents_are_packed_as_one():
    rng = np.random.default_rng(2)
    docs = [rng.integers(0, 2**15, n).astype(np.uint32) for n in (0, 1, 63, 64, 65, 0, 1000, 3)]
    assert [token_output.pack_blocks(d, 15, 64) for d in docs] == list(zip(*token_output.pack_documents(docs, 15, 64)))
    assert token_output.pack_documents([], 15, 64) == ([], [])
    flat = docs[6]
    want = sum(int(x) << (15 * k) for k, x in enumerate(flat)).to_bytes(-(-15 * 1000 // 8), "little")
    assert token_output.pack_bits(flat, 15) == want


@pytest.mark.parametrize("path,bits", [(PIECE_BPE, 15), (BYTE_BPE, 16)])
def test_token_output(spark, odd, none, nameless, path, bits):
    model = loaded(common.vocabulary(path), path)
    encode = model.model.encode if path == PIECE_BPE else model.encoding.encode_ordinary
    rows = token_output.pack_tokens(odd, block_tokens=64, tokenizer=path).collect()
    assert len(rows) == odd.count()
    by = {r.doc_id: r for r in rows}
    for r in odd.collect():
        p = by[r.doc_id]
        if r.text is None:
            assert p.payload is None and p.n_tokens is None
            continue
        want = encode(r.text)
        assert p.bits == bits and len(p.payload) <= len(want) * bits / 8 + len(p.block_offsets)
        got = token_output.read_tokens(p.payload, p.block_offsets, p.n_tokens, p.bits, 64, 0, len(want))
        assert got.tolist() == want
        assert token_output.read_tokens(p.payload, p.block_offsets, p.n_tokens, p.bits, 64, 60, 70).tolist() == want[60:70]
    assert by[3].n_tokens == 0 and bytes(by[3].payload) == b"" and by[3].block_offsets == [0]
    assert token_output.pack_tokens(none).count() == 0
    assert [r.payload for r in token_output.pack_tokens(nameless).collect()] == [None] * 3


def test_token_output_with_odd_widths(spark, odd):
    rows = token_output.pack_tokens(odd, extra_ids=100_000, block_tokens=37, tokenizer=BYTE_BPE).where("doc_id = 5").collect()
    want = loaded(ByteBpe, BYTE_BPE).encoding.encode_ordinary(odd.where("doc_id = 5").first().text)
    assert rows[0].bits == 18
    got = token_output.read_tokens(rows[0].payload, rows[0].block_offsets, rows[0].n_tokens, 18, 37, 100, 333)
    assert got.tolist() == want[100:333]


def test_the_query_packs_fifteen_bits(spark, sf):
    rows = queries.op1_token_output(spark, sf).collect()
    model = loaded(common.Pieces, PIECE_BPE).model
    texts = {r.doc_id: r.text for r in queries.documents(spark, sf).collect()}
    assert len(rows) == len(texts)
    for r in rows:
        got = token_output.read_tokens(r.payload, r.block_offsets, r.n_tokens, r.bits, r.block_tokens, 0, r.n_tokens)
        assert r.bits == 15 and got.tolist() == model.encode(texts[r.doc_id])


def test_prefix_counts(odd, none, nameless):
    encode = loaded(prefix_counts.PrefixBpe, BYTE_BPE).encoding.encode_ordinary
    rows = {r.doc_id: r for r in prefix_counts.prefix_counts(odd, stride=100, budgets=(0, 3, 10**6)).collect()}
    for r in odd.collect():
        p = rows[r.doc_id]
        if r.text is None:
            assert p.n_chars is None and p.changes is None
            continue
        assert (p.n_chars, p.n_tokens) == (len(r.text), len(encode(r.text)))
        for n in {0, 1, 5, 99, 100, 101, len(r.text) // 2, len(r.text)}:
            if n <= len(r.text):
                assert prefix_counts.tokens_at(n, p.width, p.stride, p.counts, p.changes) == len(encode(r.text[:n]))
        most = max((i for i in range(min(60, len(r.text)) + 1) if len(encode(r.text[:i])) <= 3), default=0)
        assert p.fits == [0, most, len(r.text)]
        assert prefix_counts.longest_prefix(3, p.width, p.changes) == most
    assert prefix_counts.prefix_counts(none).count() == 0
    assert prefix_counts.prefix_counts(nameless).where("n_tokens is not null").count() == 0


# --- packing -------------------------------------------------------------------------------


def brute(lengths, penalty, window):
    """The least cost over all ways to cut."""
    n, best = len(lengths), math.inf
    for ends in itertools.product((0, 1), repeat=n - 1):
        cut = [i + 1 for i, e in enumerate(ends) if e] + [n]
        at, cost = 0, 0
        for c in cut:
            size = sum(lengths[at:c])
            cost = math.inf if size > window else cost + window - size + penalty[c - 1]
            at = c
        best = min(best, cost)
    return best


def test_cuts_are_optimal():
    rng = random.Random(3)
    for _ in range(200):
        n, window = rng.randint(1, 10), rng.randint(4, 12)
        lengths = [rng.randint(1, window) for _ in range(n)]
        penalty = [rng.choice((0, 2, 7)) for _ in range(n - 1)] + [0]
        ends, cost = packing.cuts(np.array(lengths), np.array(penalty), window)
        assert cost == brute(lengths, penalty, window)
        at = got = 0
        for e in ends:
            assert sum(lengths[at:e]) <= window
            got += window - sum(lengths[at:e]) + penalty[e - 1]
            at = e
        assert at == n and got == cost


def test_unit_lengths_add_up():
    counter = loaded(packing.UnitCounter, BYTE_BPE)
    text = 'One here. Two there!  "Three?" she said.\n\nFour\nfive 3.14 six'
    units = counter.lengths(text)
    assert units.sum() == len(counter.encoding.encode_ordinary(text)) and len(units) == 6


def test_packing(spark, odd, none, nameless):
    rows = packing.pack(odd, window=256, shard_units=4).collect()
    seen: dict = {}
    encode = loaded(ByteBpe, BYTE_BPE).encoding.encode_ordinary
    for r in rows:
        assert r.n_tokens == sum(p.stop - p.start for p in r.pieces) == 256 - r.padding and 0 < r.n_tokens <= 256
        for p in r.pieces:
            seen.setdefault(p.doc_id, []).append((p.start, p.stop))
    want = {r.doc_id: len(encode(r.text)) for r in odd.collect() if r.text}
    assert seen.keys() == want.keys()
    for k, spans in seen.items():
        total = want[k] * (2 if k == 1 else 1)
        assert sum(b - a for a, b in spans) == total
    assert len({r.shard for r in rows}) > 2 and sorted((r.shard, r.window) for r in rows) == sorted({(r.shard, r.window) for r in rows})
    assert any(r.cut == "inside" for r in rows)  # the long text has a sentence longer than a window
    assert packing.pack(none).count() == 0 and packing.pack(nameless).count() == 0


@pytest.mark.parametrize("ids", [lambda i: i, lambda i: i * 10**12 + 7, lambda i: None])
def test_packing_keeps_order_whatever_the_ids(spark, ids):
    """Windows depend on the order and the lengths, not on the values of ids."""
    texts = [f"word{i} " * (i % 7 + 1) for i in range(200)]
    df = spark.createDataFrame([(ids(i), t, i) for i, t in enumerate(texts)], "doc_id long, text string, k0 int")
    rows = sorted(packing.pack(df, window=50, shard_units=64, order=[F.col("k0")]).collect(), key=lambda r: (r.shard, r.window))
    flat = [(p.doc_id, p.start) for r in rows for p in r.pieces]
    if ids(1):
        assert flat == sorted(flat) and {d for d, _ in flat} == {ids(i) for i in range(200)}
    got = [(r.shard, r.window, r.n_tokens, [(p.start, p.stop) for p in r.pieces]) for r in rows]
    # By hand: shards of 64 units, one unit a document here, each packed by itself.
    encode = loaded(ByteBpe, BYTE_BPE).encoding.encode_ordinary
    want = []
    for s in range(0, 200, 64):
        lengths = [len(encode(t)) for t in texts[s : s + 64]]
        at = 0
        for w, end in enumerate(packing.cuts(np.array(lengths), np.zeros(len(lengths), int), 50)[0]):
            want.append((s // 64, w, sum(lengths[at:end]), [(0, n) for n in lengths[at:end]]))
            at = end
    assert got == want


def test_packing_does_not_depend_on_the_partitions(spark, odd):
    say = lambda n: sorted(map(str, packing.pack(odd.repartition(n), window=64, shard_units=50).collect()))
    assert say(1) == say(5)


def test_rows_from_memory_are_packed_as_written(spark, tmp_path):
    df = spark.createDataFrame([((i * 7) % 50, f"text {i}") for i in range(50)], "doc_id long, text string").repartition(3)
    df.write.parquet(str(tmp_path / "x"))
    order = lambda d: [p.doc_id for r in packing.pack_in_file_order(d).orderBy("shard", "window").collect() for p in r.pieces]
    assert order(df) == order(spark.read.parquet(str(tmp_path / "x"))) != sorted(range(50))


# --- fertility -----------------------------------------------------------------------------


def test_fertility_measures(spark, odd, none, nameless):
    model = loaded(common.Pieces, PIECE_BPE)
    rows = {r.doc_id: r for r in fertility.fertility_rules(odd).collect()}
    for r in odd.collect():
        got = rows[r.doc_id]
        if not r.text:
            assert got.keep is False and got.reasons == ["empty"] and got.entropy is None
            continue
        ids = model.model.encode(r.text)
        p = np.unique(ids, return_counts=True)[1] / len(ids)
        assert got.chars_per_token == pytest.approx(len(r.text) / len(ids))
        assert got.entropy == pytest.approx(-(p * np.log2(p)).sum(), abs=1e-9)
        assert got.byte_share == pytest.approx(np.mean(model.is_byte[ids]))
    newline = model.model.encode("a\nb")[1]
    assert model.model.is_byte(newline) and not model.is_byte[newline]
    assert rows[5].band == "script:Latin" and rows[8].band == "xx"
    assert fertility.fertility_rules(none).count() == 0
    assert fertility.fertility_rules(nameless).where("keep").count() == 0


def test_fertility_bands_tell_junk(spark):
    rng = random.Random(5)
    vocab = "the of and house water tree road people very small great letter number morning evening under".split()
    prose = [(i, " ".join(rng.choice(vocab) for _ in range(150)), "en") for i in range(300)]
    junk = [(1000 + i, "".join(rng.choice("☃ẞⱷ☂ꙮ") for _ in range(300)), "en") for i in range(5)]
    same = [(2000 + i, "buy " * 200, "en") for i in range(5)]
    df = spark.createDataFrame(prose + junk + same, "doc_id long, text string, lang string")
    kept = {r.doc_id for r in fertility.fertility_rules(df).where("keep").collect()}
    assert not any(i >= 1000 for i in kept) and len(kept) >= 297


def test_fences_against_brute_force(spark, sf):
    """Quartiles by sorting, fences and verdicts by hand, over the registered query's own measures."""
    rows = queries.op4_tokeniser_fertility(spark, sf).collect()
    names = fertility.named(2)
    grid = lambda m, v: math.floor(v / fertility.GRID[m.rstrip("_2")] + 0.5)
    size = lambda r: int(math.log2(r.n_tokens))
    live = [r for r in rows if r.n_tokens]

    def group(of, m):
        values = sorted(grid(m, r[m]) for r in of)
        if len(values) < 30:
            return None
        q1, q3 = (values[math.ceil(len(values) * q) - 1] * fertility.GRID[m.rstrip("_2")] for q in (0.25, 0.75))
        wide = 3 * max(q3 - q1, {"c": 0.1, "b": 0.01, "e": 0.2}[m[0]])
        return q1 - wide, q3 + wide

    limits, judged = {}, 0
    for r in live:
        key = r.band, size(r)
        if key not in limits:
            own = [x for x in live if x.band == r.band]
            fine, near = [x for x in own if size(x) == key[1]], [x for x in own if abs(size(x) - key[1]) <= 1]
            limits[key] = {m: (group(fine, m) or group(near, m), group(own, m)) for m in names}, sorted(x.n_tokens for x in own)
        of, sizes = limits[key]
        long = len(sizes) >= 30 and r.n_tokens >= sizes[math.ceil(len(sizes) / 2) - 1]
        want = []
        for m in names:
            first, whole = of[m]
            lo, hi = first or (whole if long and whole else (-math.inf, math.inf))
            if not first and m.startswith("entropy"):
                hi = math.inf
            judged += lo > -math.inf
            want += [f"{m}_low"] * (r[m] < lo) + [f"{m}_high"] * (r[m] > hi)
        assert r.reasons == want and r.keep == (not want)
    assert judged > len(live) and any(not r.keep for r in live)


def test_rare_languages_are_not_judged_by_others(spark):
    rng = random.Random(6)
    vocab = "the of and house water tree road people very small great letter number morning evening under".split()
    prose = [(i, " ".join(rng.choice(vocab) for _ in range(150)), "en") for i in range(300)]
    letters = {"zh": "的一是不了人在有我他这中大来上国个到说们为子和你地出道也时年得就那要下以生会自着去之过家学对可", "th": "กขคงจชซญดตถทนบปผพฟมยรลวสหอฮะาิีุูเแโไ"}
    rare = [(1000 + i, "".join(rng.choices(x, k=160)), y) for y, x in letters.items() for i in range(5)]
    null = [(2000 + i, t, None) for i, (_, t, _) in enumerate(rare)]
    long = [(3000 + i, "".join(rng.choice("☃ẞⱷ☂ꙮ") for _ in range(110)), "en") for i in range(5)]
    df = spark.createDataFrame(prose + rare + null + long, "doc_id long, text string, lang string")
    rows = fertility.fertility_rules(df).collect()
    assert all(r.keep for r in rows if 1000 <= r.doc_id < 3000)
    assert not any(r.keep for r in rows if r.doc_id >= 3000)


def test_scripts():
    assert fertility.script("Привет, мир") == "script:Cyrillic" and fertility.script("123 !") == "script:none"
