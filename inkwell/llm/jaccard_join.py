"""N-gram Jaccard join: near-duplicate documents by the overlap of their word n-grams.

1. Every document becomes a set of 64-bit hashes of its word n-grams (all of them), computed on
   the bytes of a batch at once: a 128-bit sum tells equal sets, a bitmap of four to eight bits an
   n-gram is its signature, and `bands` keys of `rows` MinHashes each name the groups in which
   most partners are found. A pair of similarity s shares no such key with probability
   (1 - s^rows)^bands, 0.8 % at the default threshold 0.5: step 3 finds these.
2. Sets that share a key are compared by size and bitmap before anything is linked: popcount(a xor
   b) bounds the overlap from above by (|a| + |b| - popcount) / 2, so what is no pair falls away
   here, and text that many documents have in common (a footer) links nothing by itself. What
   could be a pair is linked; connected sets form a block.
3. Every n-gram is counted over all sets. Only those that several sets have can be shared, so a set
   has partners only if these are `t` of it; of its n of them, rarest first, the first n - t * size + 1
   are keys too: two sets at or above the threshold t have such a key in common, always (the prefix
   filter). Keys within one block have done their work; the others' groups are compared and linked
   as in 2. No pair is missed, whatever `bands` and `rows`: they only save work.
4. Sets of a block are intersected exactly, as sorted arrays, wherever their bitmaps allow it.

In 2 to 4 a group of more than `tile` sets (or `tile_grams` n-grams) is cut into size bands, and
these by hash into slots of about that many sets; two slots form a tile if their sizes allow the
threshold. A tile is the unit of work, many of them go into one task, and a tile hands on its links
as a forest with counts, never all pairs. No pair, partner or candidate is capped.
Texts are shuffled once, to those of their rows that are in blocks; n-grams of blocks once a tile;
of all n-grams 32 bits once to be counted, and those that several sets have once more.

Equal sets go through this once, as their least id.

Words are runs of letters, marks and digits as Unicode has them, ASCII lower-cased; each character
of scripts written without spaces (Han, Kana, Thai, Lao, Khmer, Burmese) is a word. A text of
fewer than n words has its word sequence as its only n-gram. Defined results: null texts, and
texts without words, match nothing (not even each other); null ids are dropped; rows that repeat
an id are one document with all its rows' texts: it belongs to one class, its links are those of
each distinct text, and it never pairs with itself; other columns are ignored, whatever their
names; an empty table gives no rows. The driver gathers nothing but a sum, and a count and a sum a round.
"""

from __future__ import annotations

import unicodedata
from collections.abc import Iterator
from functools import cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import forget, stored
from .common import mix64, numbered, place, runs, slices, texts_of, utf8

_FOLD = np.zeros(256, np.uint64)  # 0 for what separates words
for _c in [*range(48, 58), *range(97, 123), *range(128, 256)]:
    _FOLD[_c] = _c
_FOLD[65:91] = np.arange(97, 123)
_FOLD = mix64(_FOLD) * (_FOLD != 0)
_IN_WORD = _FOLD != 0
_BASE = np.uint64(0x9E3779B97F4A7C15)


# Blocks of scripts that don't separate words.
_UNSPACED = (
    (0x0E00, 0x0EFF), (0x1000, 0x109F), (0x1780, 0x17FF), (0x19E0, 0x19FF), (0x3005, 0x3007), (0x3031, 0x3035),
    (0x3040, 0x30FF), (0x31F0, 0x31FF), (0x3400, 0x4DBF), (0x4E00, 0x9FFF), (0xA9E0, 0xA9FF), (0xAA60, 0xAA7F),
    (0xF900, 0xFAFF), (0xFF66, 0xFF9F), (0x1B000, 0x1B16F), (0x20000, 0x323AF),
)


@cache
def character_kinds() -> np.ndarray:
    """Of every code point: 0 separates words, 1 is part of one, 2 is one by itself."""
    kinds = np.fromiter((unicodedata.category(chr(c))[0] in "LMN" for c in range(0x110000)), np.uint8, 0x110000)
    for lo, hi in _UNSPACED:
        kinds[lo : hi + 1] *= 2
    return kinds


def byte_kinds(raw: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Which bytes are in words, and which begin a word or what follows a word of one character."""
    inside, cut = _IN_WORD[raw], np.zeros(len(raw), bool)
    lead = np.flatnonzero(raw >= 0xC0)
    if not len(lead):
        return inside, cut
    size = 2 + (raw[lead] >= 0xE0) + (raw[lead] >= 0xF0).astype(np.int64)
    code = raw[lead] & (0xFF >> (size + 1)).astype(np.uint8)
    code = code.astype(np.int64)
    for k in range(1, 4):
        more = k < size
        code[more] = code[more] << 6 | raw[lead[more] + k] & 0x3F
    kind = character_kinds()[code]
    for k in range(4):
        inside[lead[k < size] + k] = kind[k < size] > 0
    alone = kind == 2
    cut[lead[alone]] = True
    after = (lead + size)[alone]
    cut[after[after < len(raw)]] = True
    return inside, cut


def _powers(n: int) -> np.ndarray:
    with np.errstate(over="ignore"):
        return np.cumprod(np.full(n, _BASE))


def word_hashes(raw: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all words in order, and the number of words of each document."""
    inside, cut = byte_kinds(raw)
    first = inside.copy()
    first[1:] &= ~inside[:-1] | cut[1:]
    at = offsets[:-1]
    at = at[at < len(raw)]
    first[at] = inside[at]  # a word never goes on into the next document
    pos = np.flatnonzero(inside)
    if not len(pos):
        return np.zeros(0, np.uint64), np.zeros(len(offsets) - 1, np.int64)
    starts = np.flatnonzero(first)
    head = np.flatnonzero(first[pos])
    length = np.diff(head, append=len(pos))
    value = _FOLD[raw[pos]] * _powers(int(length.max()))[runs(length)]
    words = mix64(np.add.reduceat(value, head) + length.astype(np.uint64))
    return words, np.diff(np.searchsorted(starts, offsets))


def gram_sets(raw: np.ndarray, offsets: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """Sorted distinct n-gram hashes of all documents, one after another, and how many each has."""
    words, count = word_hashes(raw, offsets)
    grams = np.where(count >= n, count - n + 1, np.minimum(count, 1))
    doc = np.repeat(np.arange(len(count)), grams)
    start = np.repeat(np.cumsum(count) - count, grams) + runs(grams)
    size = np.minimum(n, count)[doc]
    h = size.astype(np.uint64)
    for k in range(n):
        more = k < size
        h = np.where(more, mix64(h * _BASE + words[np.where(more, start + k, 0)]) if len(words) else h, h)
    order = np.lexsort((h, doc))
    h, doc = h[order], doc[order]
    new = np.ones(len(h), bool)
    new[1:] = (h[1:] != h[:-1]) | (doc[1:] != doc[:-1])
    h, doc = h[new], doc[new]
    return h, np.bincount(doc, minlength=len(count))


def minhash_keys(grams: np.ndarray, count: np.ndarray, bands: int, rows: int) -> np.ndarray:
    """(documents, bands) keys; documents must have grams."""
    rng = np.random.default_rng(20_240_601)
    a = rng.integers(1, 1 << 32, bands * rows, dtype=np.uint64).astype(np.uint32) | np.uint32(1)
    b = rng.integers(0, 1 << 32, bands * rows, dtype=np.uint64).astype(np.uint32)
    low = (grams >> np.uint64(32)).astype(np.uint32)
    first = np.cumsum(count) - count
    keys = np.empty((len(count), bands), np.uint64)
    for band in range(bands):
        key = np.full(len(count), band, np.uint64)
        for r in range(band * rows, (band + 1) * rows):
            v = low * a[r] + b[r]
            v ^= v >> np.uint32(15)
            v *= np.uint32(0x2C1B3C6D)
            key = key * _BASE + np.minimum.reduceat(v, first)
        keys[:, band] = mix64(key)
    return keys


def bitmaps_of(grams: np.ndarray, count: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Bitmaps of all sets one after another, as 64-bit words, and the words of each: a power of
    two, with at least four bits a member. The bit of a hash is the hash modulo the bits."""
    words = 1 << np.ceil(np.log2(np.maximum(count, 16) / 16)).astype(np.int64)
    bits = words * 64
    start = np.cumsum(bits) - bits
    flags = np.zeros(int(bits.sum()), np.uint8)
    flags[np.repeat(start, count) + (grams & np.repeat((bits - 1).astype(np.uint64), count)).astype(np.int64)] = 1
    return np.packbits(flags, bitorder="little").view(np.uint64), words


def folded(maps: np.ndarray, words: int) -> np.ndarray:
    """Bitmaps of more words as bitmaps of fewer: the bit of a hash modulo the fewer bits."""
    return np.bitwise_or.reduce(maps.reshape(len(maps), -1, words), axis=1)


def possible(i: np.ndarray, j: np.ndarray, size: np.ndarray, maps: np.ndarray, words: np.ndarray, t: float):
    """Of the pairs (i, j) those whose sizes and bitmaps allow a similarity of t."""
    need = np.ceil(t / (1 + t) * (size[i] + size[j]) - 1e-9)
    ok = np.minimum(size[i], size[j]) >= need
    i, j, need = i[ok], j[ok], need[ok]
    keep = np.zeros(len(i), bool)
    first = np.cumsum(words) - words
    shapes = words[i] << 32 | words[j]
    for shape in np.unique(shapes):
        wi, wj = int(shape >> 32), int(shape & 0xFFFFFFFF)
        w = min(wi, wj)
        mine = np.flatnonzero(shapes == shape)
        step = max(1, (1 << 20) // max(wi, wj))
        for at in range(0, len(mine), step):
            m = mine[at : at + step]
            a = folded(maps[first[i[m]][:, None] + np.arange(wi)], w)
            b = folded(maps[first[j[m]][:, None] + np.arange(wj)], w)
            apart = np.bitwise_count(a ^ b).sum(1, dtype=np.int64)
            keep[m] = (size[i[m]] + size[j[m]] - apart) // 2 >= need[m]
    return i[keep], j[keep]


def least_labels(n: int, i: np.ndarray, j: np.ndarray) -> np.ndarray:
    """Of nodes 0 .. n-1 linked by (i, j), the least of each one's component."""
    label = np.arange(n)
    while True:
        new = label.copy()
        low = np.minimum(label[i], label[j])
        np.minimum.at(new, label[i], low)
        np.minimum.at(new, label[j], low)
        while not np.array_equal(new, new[new]):
            new = new[new]
        if np.array_equal(new, label):
            return label
        label = new


@cache
def corner(n: int) -> tuple[np.ndarray, np.ndarray]:
    return np.triu_indices(n, 1)


def tile_pairs(starts: np.ndarray, side: np.ndarray, most: int = 1 << 21) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Pairs to compare, of all tiles (rows starts[k] .. starts[k+1]-1), about `most` at a time:
    all of a tile of one slot, and of two slots those between them."""
    found, n = [], 0
    for a, z in zip(starts[:-1].tolist(), starts[1:].tolist()):
        if side[a]:  # two slots, of which one can be empty
            left = np.flatnonzero(side[a:z] == 1) + a
            other = np.flatnonzero(side[a:z] == 2) + a
            step = max(1, most // max(1, len(other)))
            for k in range(0, len(left), step):
                part = left[k : k + step]
                found.append((np.repeat(part, len(other)), np.tile(other, len(part))))
                n += len(found[-1][0])
                if n >= most:
                    yield tuple(np.concatenate(x) for x in zip(*found))
                    found, n = [], 0
        elif z - a <= 64:
            i, j = corner(z - a)
            found.append((i + a, j + a))
            n += len(i)
        else:
            step = max(1, most // (z - a))
            for k in range(a, z, step):
                rows = np.arange(k, min(k + step, z))
                many = z - 1 - rows
                found.append((np.repeat(rows, many), runs(many) + np.repeat(rows + 1, many)))
                n += len(found[-1][0])
                if n >= most:
                    yield tuple(np.concatenate(x) for x in zip(*found))
                    found, n = [], 0
        if n >= most:
            yield tuple(np.concatenate(x) for x in zip(*found))
            found, n = [], 0
    if n:
        yield tuple(np.concatenate(x) for x in zip(*found))


def exact(i: np.ndarray, j: np.ndarray, grams: np.ndarray, count: np.ndarray, t: float, most: int = 1 << 22):
    """Pairs (i, j) at or above t, with what they share: each i's array is searched for the members
    of all its partners' arrays at once."""
    order = np.argsort(i, kind="stable")
    i, j = i[order], j[order]
    first = np.cumsum(count) - count
    both = np.zeros(len(i), np.int64)
    edges = np.flatnonzero(np.diff(i, prepend=-1))
    for a, z in zip(edges.tolist(), [*edges[1:].tolist(), len(i)]):
        mine = grams[first[i[a]] : first[i[a]] + count[i[a]]]
        while a < z:
            sizes = count[j[a:z]]
            k = a + max(1, int(np.searchsorted(np.cumsum(sizes), most, "right")))
            sizes = sizes[: k - a]
            theirs = grams[np.repeat(first[j[a:k]], sizes) + runs(sizes)]
            at = np.searchsorted(mine, theirs)
            at[at == len(mine)] = 0
            both[a:k] = np.add.reduceat(mine[at] == theirs, np.cumsum(sizes) - sizes, dtype=np.int64)
            a = k
    jaccard = both / (count[i] + count[j] - both)
    ok = jaccard >= t
    return i[ok], j[ok], both[ok], jaccard[ok]


SIGNATURE = "doc_id long, w1 long, w2 long, size int, keys array<long>, bitmap binary"
SEEN = 100_000


def set_hashes(grams: np.ndarray, count: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    first = np.cumsum(count) - count
    return tuple(mix64(np.add.reduceat(mix64(grams ^ np.uint64(c)), first)).view(np.int64) for c in (0, 0x5851F42D4C957F2D))


def binaries(data: np.ndarray, lengths: np.ndarray) -> pa.Array:
    """Binary values that lie one after another."""
    offsets = np.concatenate(([0], np.cumsum(lengths))).astype(np.int32)
    return pa.Array.from_buffers(pa.binary(), len(lengths), [None, pa.py_buffer(offsets), pa.py_buffer(np.ascontiguousarray(data))])


def first_seen(seen: set, rows: list[tuple]) -> list[int]:
    """Places of rows that this task hasn't met; it remembers SEEN of them, so a row that repeats
    very often leaves a task only a few times."""
    out = []
    for k, row in enumerate(rows):
        if row not in seen:
            if len(seen) >= SEEN:
                seen.clear()
            seen.add(row)
            out.append(k)
    return out


def signatures(texts: DataFrame, n: int, bands: int, rows: int) -> DataFrame:
    """Id, set hash, size, keys and bitmap of every document that has words."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: set = set()
        for batch in slices(batches):
            raw, offsets, _ = utf8(batch.column(1))
            grams, count = gram_sets(raw, offsets, n)
            there = np.flatnonzero(count)
            if not len(there):
                continue
            count = count[there]
            keys = minhash_keys(grams, count, bands, rows).view(np.int64)
            w1, w2 = set_hashes(grams, count)
            maps, words = bitmaps_of(grams, count)
            ids = batch.column(0).take(pa.array(there))
            lists = pa.ListArray.from_arrays(pa.array(np.arange(len(there) + 1, dtype=np.int32) * bands), pa.array(keys.ravel()))
            new = first_seen(seen, list(zip(ids.to_pylist(), w1.tolist(), w2.tolist())))
            yield pa.RecordBatch.from_arrays(
                [ids, pa.array(w1), pa.array(w2), pa.array(count.astype(np.int32)), lists, binaries(maps.view(np.uint8), words * 8)],
                names=["doc_id", "w1", "w2", "size", "keys", "bitmap"],
            ).take(pa.array(new, pa.int64()))

    return texts.mapInArrow(run, SIGNATURE)


COUNTED = 2_500_000  # n-grams a bucket, in which they are counted at once


def rows_by(group: np.ndarray, sets: np.ndarray, size: np.ndarray, grams: np.ndarray, *more: np.ndarray):
    """Of n-grams, one a row of the arrays, by group: the groups that occur, and for each, as binaries,
    its sets one after another (hash, size, how many of the n-grams are its own), the n-grams' low 32
    bits, and what `more` says of them. `sets` and `size` are given for each n-gram, and a set's
    n-grams lie together."""
    order = np.argsort(group, kind="stable")
    group, sets = group[order], sets[order]
    new = np.ones(len(group), bool)
    new[1:] = group[1:] != group[:-1]
    at = np.flatnonzero(new)
    new[1:] |= sets[1:] != sets[:-1]
    head = np.flatnonzero(new)
    each = np.diff(np.append(at, len(group)))
    heads = np.diff(np.append(np.searchsorted(head, at), len(head)))
    columns = [(sets[head], heads), (size[order][head], heads), (np.diff(np.append(head, len(group))), heads)]
    columns += [(x[order], each) for x in (grams, *more)]
    kinds = ("<i8", "<u4", "<u4", "<u4", *("u1" for _ in more))
    made = [binaries(x.astype(k).view(np.uint8), n * np.dtype(k).itemsize) for (x, n), k in zip(columns, kinds)]
    return group[at], made


def by_group(batches: Iterator[pa.RecordBatch]) -> Iterator[list[pa.RecordBatch]]:
    """Rows sorted by their first column, in lists of all rows of one value."""
    held: list[pa.RecordBatch] = []
    for batch in batches:
        at = batch.column(0).to_numpy(zero_copy_only=False)
        cuts = [0, *(np.flatnonzero(np.diff(at)) + 1).tolist(), len(at)]
        for a, z in zip(cuts[:-1], cuts[1:]):
            if a == z:
                continue
            if held and held[0].column(0)[0].as_py() != at[a]:
                yield held
                held = []
            held.append(batch.slice(a, z - a))
    if held:
        yield held


def together(parts: list[pa.RecordBatch], column: str, kind: str) -> np.ndarray:
    """The values of a binary column, all rows' one after another."""
    return np.concatenate([buffers_of(pa.chunked_array([p.column(column)]))[0].view(kind) for p in parts])


def counted_grams(texts: DataFrame, n: int, buckets: int) -> DataFrame:
    """By `part`, a hash of the set: the n-grams that several sets have, with how common they are."""

    def deal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple] = []

        def piece() -> pa.RecordBatch:
            grams, count, w1 = (np.concatenate(x) for x in zip(*held))
            bucket = (grams >> np.uint64(32)) % np.uint64(buckets)
            bucket = bucket.astype(np.uint16 if buckets < 1 << 16 else np.int64)
            group, made = rows_by(bucket, np.repeat(w1, count), np.repeat(count, count), grams & np.uint64(0xFFFFFFFF))
            return pa.RecordBatch.from_arrays([pa.array(group.astype(np.int32)), *made], names=["bucket", "sets", "size", "many", "grams"])

        for batch in slices(batches):
            raw, offsets, _ = utf8(batch.column(1))
            grams, count = gram_sets(raw, offsets, n)
            count = count[count > 0]
            if len(count):
                held.append((grams, count, set_hashes(grams, count)[0]))
            if sum(len(x[0]) for x in held) >= 1 << 20:
                yield piece()
                held.clear()
        if held:
            yield piece()

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for parts in by_group(batches):
            sets, size, many = (together(parts, c, k) for c, k in (("sets", "<i8"), ("size", "<u4"), ("many", "<u4")))
            grams = together(parts, "grams", "<u4")
            # Copies of a set have the same n-grams here: one of them counts.
            _, first = np.unique(sets, return_index=True)
            kept = np.zeros(len(sets), bool)
            kept[first] = True
            grams = grams[np.repeat(kept, many)]
            sets, size, many = sets[kept], size[kept], many[kept]
            both = grams.astype(np.uint64) << np.uint64(32) | np.repeat(np.arange(len(sets), dtype=np.uint64), many)
            both.sort()
            grams, of = (both >> np.uint64(32)).astype(np.uint32), both.astype(np.uint32)
            start = np.flatnonzero(np.concatenate(([True], grams[1:] != grams[:-1])))
            times = np.diff(np.append(start, len(grams)))
            common = np.repeat(np.minimum(8 * np.log2(times), 255).astype(np.uint8), times)
            several = np.repeat(times > 1, times)
            grams, of, common = grams[several], of[several], common[several]
            if not len(grams):
                continue
            order = np.argsort(of, kind="stable")
            grams, of, common = grams[order], of[order], common[order]
            part = (sets.view(np.uint64) % np.uint64(buckets)).astype(np.int32)
            group, made = rows_by(part[of], sets[of], size[of], grams, common)
            bucket = np.full(len(group), parts[0].column(0)[0].as_py(), np.int32)
            yield pa.RecordBatch.from_arrays(
                [pa.array(group), pa.array(bucket), *made], names=["part", "bucket", "sets", "size", "many", "grams", "common"]
            )

    kinds = "sets binary, size binary, many binary, grams binary"
    dealt = texts.mapInArrow(deal, f"bucket int, {kinds}").repartition(buckets, "bucket").sortWithinPartitions("bucket")
    return dealt.mapInArrow(count, f"part int, bucket int, {kinds}, common binary")


def prefix_keys(texts: DataFrame, n: int, t: float, buckets: int) -> DataFrame:
    """(w1, key): sets of a similarity of at least t have at least one key in common."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for parts in by_group(batches):
            sets, size, many = (together(parts, c, k) for c, k in (("sets", "<i8"), ("size", "<u4"), ("many", "<u4")))
            grams, common = together(parts, "grams", "<u4"), together(parts, "common", "u1")
            rows = [buffers_of(pa.chunked_array([p.column("grams")]))[1] for p in parts]
            bucket = np.concatenate([np.repeat(p.column("bucket").to_numpy(), np.diff(r) // 4) for p, r in zip(parts, rows)])
            w1, first, which = np.unique(sets, return_index=True, return_inverse=True)
            have = np.bincount(which, many, len(w1)).astype(np.int64)
            need = np.maximum(np.ceil(t * size[first] * (1 - 1e-12) - 1e-9).astype(np.int64), 1)
            of = np.repeat(which, many)
            able = (have >= need)[of]
            of, common = of[able], common[able]
            key = bucket[able].astype(np.int64) << 32 | grams[able]
            order = np.lexsort((key, common, of))
            of, key = of[order], key[order]
            each = np.bincount(of, minlength=len(w1))
            taken = runs(each) < (have - need + 1)[of]
            taken[1:] &= (key[1:] != key[:-1]) | (of[1:] != of[:-1])
            yield pa.RecordBatch.from_arrays([pa.array(w1[of[taken]]), pa.array(key[taken])], names=["w1", "key"])

    counted = counted_grams(texts, n, buckets).repartition(buckets, "part").sortWithinPartitions("part")
    return counted.mapInArrow(run, "w1 long, key long")


def components(edges: DataFrame) -> DataFrame:
    """(node, root) for the nodes of undirected edges (a, b): root is the least id reached.

    Large-star and small-star steps in turn (Kiveris et al. 2014): O(log^2) rounds over the edges,
    whatever the shape. A node's least neighbour is a partial aggregate that is joined back, so a
    node with very many edges is split like any skewed join. Each round is stored in the shared folder.
    """
    e = stored(edges.where("a != b").selectExpr("greatest(a, b) as u", "least(a, b) as v").distinct())
    before = None
    while True:
        # Large star: each node's larger neighbours go to its least neighbour (or itself).
        both = e.unionAll(e.selectExpr("v as u", "u as v"))
        least = both.groupBy("u").agg(F.least(F.min("v"), F.first("u")).alias("m"))
        big = both.where("v > u").join(least, "u").selectExpr("v as u", "m as v").distinct()
        # Small star: its smaller neighbours and itself go to the least of them.
        least = big.groupBy("u").agg(F.min("v").alias("m"))
        moved = big.join(least, "u").where("v != m").selectExpr("v as u", "m as v")
        small = moved.unionAll(least.selectExpr("u", "m as v")).distinct()
        old, e = e, stored(small)
        forget(old)
        # One number tells whether anything moved: the sum of hashes of the edges.
        now = e.agg(F.count(F.lit(1)), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if now == before:
            return e.selectExpr("u as node", "v as root")
        before = now


def whole_tiles(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[pa.Table, np.ndarray]]:
    """Rows sorted by tile (the first three columns) in pieces of whole tiles, and where these start."""

    def piece(parts: list[pa.RecordBatch]) -> tuple[pa.Table, np.ndarray]:
        table = pa.Table.from_batches(parts).combine_chunks()
        at = np.stack([table.column(c).to_numpy() for c in range(3)])
        new = np.flatnonzero((at[:, 1:] != at[:, :-1]).any(0)) + 1
        return table, np.concatenate(([0], new, [table.num_rows]))

    held: list[pa.RecordBatch] = []
    for batch in slices(batches, 1 << 14, 32 << 20):
        at = np.stack([batch.column(c).to_numpy(zero_copy_only=False) for c in range(3)])
        if held and [held[-1].column(c)[held[-1].num_rows - 1].as_py() for c in range(3)] != at[:, 0].tolist():
            yield piece(held)
            held = []
        new = np.flatnonzero((at[:, 1:] != at[:, :-1]).any(0)) + 1
        if len(new):
            cut = int(new[-1])
            yield piece([*held, batch.slice(0, cut)])
            held = [batch.slice(cut)]
        else:
            held.append(batch)
    if held:
        yield piece(held)


def in_tiles(rows: DataFrame, key: str, t: float, tile: int, tile_grams: int) -> DataFrame:
    """rows with `tiles`, an array of (i, j, side): the tiles of its group that a row belongs to, and
    whether as one slot's (0) or as the left (1) or right (2) of two.

    Groups of at most `tile` rows and tile_grams n-grams are one tile. Others are cut into size bands
    of which only few neighbours can hold partners, and bands by hash into slots.
    """
    band = F.floor(F.log(F.col("size")) * (2 / np.log(1 / t)) if t < 1 else F.col("size")).cast("int")
    rows = rows.withColumn("band", band)
    bands = rows.groupBy(key, "band").agg(
        F.count(F.lit(1)).alias("n"), F.sum("size").alias("grams"), F.min("size").alias("lo"), F.max("size").alias("hi")
    )
    large = bands.groupBy(key).agg(F.sum("n").alias("all_n"), F.sum("grams").alias("all_grams"))
    large = large.where((F.col("all_n") > tile) | (F.col("all_grams") > tile_grams)).select(key)
    slots = F.ceil(F.greatest(F.col("n") / tile, F.col("grams") / tile_grams)).cast("int").alias("slots")
    bands = bands.join(large, key).select(key, "band", slots, "lo", "hi")
    left = bands.select(key, F.col("band").alias("lb"), F.col("slots").alias("ls"), F.col("hi").alias("l_hi"))
    right = bands.select(key, F.col("band").alias("rb"), F.col("slots").alias("rs"), F.col("lo").alias("r_lo"))
    pairs = (
        left.join(right, key)
        .where((F.col("lb") <= F.col("rb")) & (F.col("l_hi") >= F.col("r_lo") * t))
        .withColumn("ln", F.explode(F.sequence(F.lit(0), F.col("ls") - 1)))
        .withColumn("rn", F.explode(F.sequence(F.lit(0), F.col("rs") - 1)))
        .where("lb < rb or ln <= rn")
        .selectExpr(key, "lb", "ln", "rb", "rn", "lb * 4294967296L + ln as i", "rb * 4294967296L + rn as j")
    )
    place = pairs.selectExpr(key, "lb as band", "ln as slot", "struct(i, j, if(i = j, 0, 1) as side) as at").unionAll(
        pairs.where("i != j").selectExpr(key, "rb as band", "rn as slot", "struct(i, j, 2 as side) as at")
    )
    place = place.groupBy(key, "band", "slot").agg(F.collect_list("at").alias("tiles"))
    rows = rows.join(bands.select(key, "band", "slots"), [key, "band"], "left")
    slot = F.coalesce(F.pmod(F.xxhash64("doc_id", "w1"), F.col("slots").cast("long")), F.lit(-1)).cast("int")
    rows = rows.withColumn("slot", slot).join(place, [key, "band", "slot"], "left")
    alone = F.array(F.struct(F.lit(0).cast("long").alias("i"), F.lit(0).cast("long").alias("j"), F.lit(0).alias("side")))
    return rows.withColumn("tiles", F.coalesce("tiles", alone)).drop("band", "slots", "slot")


def by_tile(rows: DataFrame, key: str, *columns: str) -> DataFrame:
    """Rows once a tile, the tiles dealt to tasks and sorted; equal rows of a tile lie together."""
    rows = rows.withColumn("at", F.explode("tiles"))
    rows = rows.select(F.col(key).alias("block"), "at.i", "at.j", "at.side", "doc_id", "w1", "w2", "size", *columns)
    return rows.repartition("block", "i", "j").sortWithinPartitions("block", "i", "j", "side", "doc_id", "w1", "w2")


def once(table: pa.Table, starts: np.ndarray) -> tuple[pa.Table, np.ndarray]:
    """The table without rows that repeat the one before (a row read twice), and its starts."""
    at = np.stack([table[c].to_numpy() for c in ("side", "doc_id", "w1", "w2")])
    new = np.ones(table.num_rows, bool)
    new[1:] = (at[:, 1:] != at[:, :-1]).any(0)
    new[starts[:-1]] = True
    if new.all():
        return table, starts
    return table.filter(pa.array(new)), np.concatenate(([0], np.cumsum(new)))[starts]


def linked(records: DataFrame, t: float) -> DataFrame:
    """Edges (a, b) that connect, tile by tile, all sets whose sizes and bitmaps allow t."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table, starts in whole_tiles(batches):
            table, starts = once(table, starts)
            size = table["size"].to_numpy().astype(np.int64)
            raw, offsets = buffers_of(table["bitmap"])
            maps, words = raw.view(np.uint64), np.diff(offsets) // 8
            found = [possible(i, j, size, maps, words, t) for i, j in tile_pairs(starts, table["side"].to_numpy())]
            i, j = (np.concatenate(x) for x in zip(*found)) if found else (np.zeros(0, np.int64),) * 2
            root = least_labels(len(size), i, j)
            here = np.flatnonzero(root != np.arange(len(size)))
            ids = table["doc_id"].to_numpy()
            yield pa.RecordBatch.from_arrays([pa.array(ids[here]), pa.array(ids[root[here]])], names=["a", "b"])

    return records.mapInArrow(run, "a long, b long").where("a != b").distinct()


def buffers_of(column: pa.ChunkedArray) -> tuple[np.ndarray, np.ndarray]:
    """All bytes of a binary column, in memory of their own, and the offsets."""
    array = column.combine_chunks().cast(pa.large_binary())
    if isinstance(array, pa.ChunkedArray):
        array = array.chunk(0) if array.num_chunks else pa.array([], pa.large_binary())
    _, offsets, data = array.buffers()
    off = np.frombuffer(offsets, np.int64)[array.offset : array.offset + len(array) + 1]
    return np.frombuffer(data, np.uint8)[off[0] : off[-1]].copy(), off - off[0]


class Join:
    """What classes and pairs share: signatures, equal sets, blocks and their tiles."""

    def __init__(self, docs, id_col, text_col, n, threshold, bands, rows, tile, tile_grams):
        self.n, self.t = n, threshold
        self.texts = texts_of(docs, id_col, text_col).where("doc_id is not null and text is not null")
        sig = stored(signatures(self.texts, n, bands, rows))
        self.ids = sig.select("doc_id", "w1", "w2", "size").distinct()
        # Equal sets: the least id stands for all.
        self.sets = self.ids.groupBy("w1", "w2").agg(
            F.min("doc_id").alias("least"), F.count(F.lit(1)).alias("copies"), F.first("size").alias("size")
        )
        mine = self.sets.select("w1", "w2", F.col("least").alias("doc_id"), "copies")
        reps = (
            sig.join(mine, ["w1", "w2", "doc_id"])
            .groupBy("w1", "w2", "doc_id")
            .agg(*(F.first(c).alias(c) for c in ("size", "copies", "keys", "bitmap")))
        )
        # A stored table's row ids stay as they are, so a short one names a set from here on.
        reps = stored(reps.withColumn("rid", F.monotonically_increasing_id()))
        self.reps, self.tile, self.tile_grams = reps, tile, tile_grams
        # Keys that several sets have; nearly all have one and fall away.
        keyed = reps.select("rid", F.explode("keys").alias("key"))
        several = keyed.groupBy("key").agg(F.count(F.lit(1)).alias("n")).where("n > 1").select("key")
        blocks = stored(components(self.links(keyed, several)))
        # What those keys missed: keys of the prefix filter that sets of several blocks have.
        total = sig.agg(F.sum("size")).first()[0] or 0
        rare = prefix_keys(self.texts, n, threshold, max(1, -(-total // COUNTED)))
        nodes = reps.join(blocks, reps["doc_id"] == blocks["node"], "left")
        nodes = nodes.select("w1", "rid", F.coalesce("root", "doc_id").alias("root"))
        keyed = stored(rare.join(nodes, "w1").select("rid", "key", "root"))
        several = keyed.groupBy("key").agg(F.min("root").alias("lo"), F.max("root").alias("hi")).where("lo != hi").select("key")
        missed = self.links(keyed.select("rid", "key"), several)
        blocks = components(blocks.selectExpr("node as a", "root as b").unionAll(missed))
        roots = blocks.select(F.col("root").alias("node"), "root")
        blocks = blocks.unionAll(roots).distinct().select(F.col("node").alias("doc_id"), F.col("root").alias("block"))
        members = stored(reps.select("doc_id", "w1", "w2", "size", "copies").join(blocks, "doc_id"))
        self.tiles = by_tile(self.with_grams(in_tiles(members, "block", threshold, tile, tile_grams)), "block", "copies", "grams")

    def links(self, keyed: DataFrame, several: DataFrame) -> DataFrame:
        """Edges that connect the sets with one of the keys of `several` in common that could be pairs."""
        records = stored(keyed.join(several, "key"))
        # Of keys with the same sets one is enough.
        groups = records.groupBy("key").agg(
            F.count(F.lit(1)).alias("n"), F.bit_xor(F.xxhash64("rid")).alias("x"), F.bit_xor(F.xxhash64("rid", F.lit(1))).alias("y")
        )
        live = groups.groupBy("n", "x", "y").agg(F.min("key").alias("key")).select("key")
        records = stored(records.join(live, "key").join(self.reps.select("rid", "doc_id", "w1", "w2", "size"), "rid"))
        records = in_tiles(records, "key", self.t, self.tile, self.tile_grams).join(self.reps.select("rid", "bitmap"), "rid")
        return linked(by_tile(records, "key", "bitmap"), self.t)

    def with_grams(self, members: DataFrame) -> DataFrame:
        """members with `grams`, their sorted sets as binary, from the texts of their ids."""
        n = self.n

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            seen: set = set()
            for batch in slices(batches):
                raw, offsets, _ = utf8(batch.column(batch.num_columns - 1))
                grams, count = gram_sets(raw, offsets, n)
                there = np.flatnonzero(count)
                w1, w2 = set_hashes(grams, count[there]) if len(there) else (np.zeros(0, np.int64),) * 2
                # Of an id with several texts, the one that the row stands for.
                same = (w1 == batch.column(1).to_numpy()[there]) & (w2 == batch.column(2).to_numpy()[there])
                ids = batch.column(0).to_numpy()[there[same]].tolist()
                new = there[same][first_seen(seen, list(zip(ids, w1[same].tolist(), w2[same].tolist())))]
                data = binaries(grams.view(np.uint8), count * 8)
                rows = pa.array(new)
                yield pa.RecordBatch.from_arrays(
                    [c.take(rows) for c in batch.columns[:-1]] + [data.take(rows)], names=[*batch.schema.names[:-1], "grams"]
                )

        cols = ["doc_id", "w1", "w2", "size", "copies", "block", "tiles"]
        joined = self.texts.join(members, "doc_id").select(*cols, "text")
        kinds = "doc_id long, w1 long, w2 long, size int, copies long, block long, tiles array<struct<i:long,j:long,side:int>>"
        return joined.mapInArrow(run, kinds + ", grams binary")

    def found(self, pairs: bool) -> DataFrame:
        """Pairs, or of every set in one its root and number of links, tile by tile."""
        t = self.t

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for table, starts in whole_tiles(batches):
                table, starts = once(table, starts)
                ids, side = table["doc_id"].to_numpy(), table["side"].to_numpy()
                raw, offsets = buffers_of(table["grams"])
                grams, count = raw.view(np.uint64), np.diff(offsets) // 8
                maps, words = bitmaps_of(grams, count)
                links, root = np.zeros(len(ids), np.int64), np.arange(len(ids))
                copies = table["copies"].to_numpy()
                for i, j in tile_pairs(starts, side):
                    i, j = possible(i, j, count, maps, words, t)
                    i, j, both, jaccard = exact(i, j, grams, count, t)
                    if pairs:
                        apart = ids[i] != ids[j]
                        a, b = ids[i][apart], ids[j][apart]
                        yield pa.RecordBatch.from_arrays(
                            [pa.array(np.minimum(a, b)), pa.array(np.maximum(a, b)), pa.array(both[apart].astype(np.int32)), pa.array(jaccard[apart])],
                            names=["doc_a", "doc_b", "shared", "jaccard"],
                        )
                    else:
                        np.add.at(links, i, copies[j])
                        np.add.at(links, j, copies[i])
                        # What was linked before goes in as links to roots.
                        root = least_labels(len(ids), np.append(np.arange(len(ids)), i), np.append(root, j))
                if not pairs:
                    k = np.flatnonzero(links)
                    w1, w2 = table["w1"].to_numpy(), table["w2"].to_numpy()
                    yield pa.RecordBatch.from_arrays(
                        [pa.array(x[k]) for x in (ids, w1, w2, ids[root], links)], names=["doc_id", "w1", "w2", "root", "links"]
                    )

        if pairs:
            out = self.tiles.mapInArrow(run, "doc_a long, doc_b long, shared int, jaccard double")
            return out.groupBy("doc_a", "doc_b").agg(F.max("shared").alias("shared"), F.max("jaccard").alias("jaccard"))
        return self.tiles.mapInArrow(run, "doc_id long, w1 long, w2 long, root long, links long")


def jaccard_classes(
    docs: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    n: int = 3,
    threshold: float = 0.5,
    bands: int = 36,
    rows: int = 3,
    tile: int = 1024,
    tile_grams: int = 2_000_000,
) -> DataFrame:
    """doc_id, class_id (the least id that links lead to) and n_links (the documents, equal or at or
    above the threshold, that each of its texts is linked to) of every id that isn't null."""
    join = Join(docs, id_col, text_col, n, threshold, bands, rows, tile, tile_grams)
    near = stored(join.found(pairs=False))
    at = join.ids.select("doc_id", "w1", "w2").join(join.sets.select("w1", "w2", "least", "copies"), ["w1", "w2"])
    equal = at.where("doc_id != least").selectExpr("doc_id as a", "least as b")
    roots = components(near.selectExpr("doc_id as a", "root as b").unionAll(equal))
    more = near.groupBy("w1", "w2").agg(F.sum("links").alias("links"))
    links = at.join(more, ["w1", "w2"], "left").groupBy("doc_id")
    links = links.agg(F.sum(F.col("copies") - 1 + F.coalesce("links", F.lit(0))).alias("n_links"))
    everyone = ids_of(docs, id_col)
    return (
        everyone.join(links, "doc_id", "left")
        .join(roots.select(F.col("node").alias("doc_id"), "root"), "doc_id", "left")
        .select("doc_id", F.coalesce("root", "doc_id").alias("class_id"), F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"))
    )


def ids_of(docs: DataFrame, id_col: str) -> DataFrame:
    return numbered(docs).select(F.col(place(docs, id_col)).cast("long").alias("doc_id")).where("doc_id is not null").distinct()


def jaccard_join(
    docs: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    n: int = 3,
    threshold: float = 0.5,
    bands: int = 36,
    rows: int = 3,
    tile: int = 1024,
    tile_grams: int = 2_000_000,
) -> DataFrame:
    """doc_a < doc_b, shared (n-grams in common), jaccard: all pairs of different sets, as the least
    ids of these, and a link from each least id to every id with an equal set."""
    join = Join(docs, id_col, text_col, n, threshold, bands, rows, tile, tile_grams)
    equal = join.ids.select("doc_id", "w1", "w2").join(join.sets, ["w1", "w2"]).where("doc_id != least")
    equal = equal.selectExpr("least as doc_a", "doc_id as doc_b", "size as shared", "1D as jaccard")
    both = join.found(pairs=True).unionByName(equal)
    return both.groupBy("doc_a", "doc_b").agg(F.max("shared").alias("shared"), F.max("jaccard").alias("jaccard"))


def drop_near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", **join) -> DataFrame:
    """docs without all but one (the least id) of each class.

    Rows of null ids stay, as do all rows of an id that stays; every column keeps its name.
    """
    gone = jaccard_classes(docs, id_col, text_col, **join).where("class_id != doc_id").select(F.col("doc_id").alias("gone"))
    kept = numbered(docs).join(gone, F.col(place(docs, id_col)).cast("long") == F.col("gone"), "left_anti")
    return kept.toDF(*docs.columns)
