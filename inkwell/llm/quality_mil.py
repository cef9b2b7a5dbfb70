"""Quality classifier by attention-based multiple-instance learning.

A document is a bag of passages of about `passage` bytes that together cover all of it. Each
passage is encoded by its hashed byte trigrams, word shapes and character classes. Gated
attention (tanh and sigmoid branches, multiplied) gives every passage a weight; the weighted
mean of the passage representations is scored by a logistic layer. Only document labels are
needed, and a long document with one bad part can still be told.

Training is by Adam on a sample of labelled documents, balanced over the classes, bounded by
`sample` rows and `sample_bytes` of text (parameters, 4,000 and 64 MB by default) and chosen by
hash, on the driver. The threshold
is set on held-out sampled documents: the score below which at most `false_rejects` of the good
ones fall. Scoring reads every document whole, in one narrow pass without a shuffle.

Defined results: null and empty texts get a null score and keep false; labels that are null or
whose document is missing aren't used; a document with labels that disagree is good if any says
so; with fewer than `least` labelled documents of a class nothing is rejected (score 1);
ids may be null or repeat; other columns pass through in the filtering form and are ignored in
the scoring form; an empty table gives no rows.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import numbered, place, runs, slices, take, texts_of, utf8

BUCKETS = 512
CLASSES = 12
WIDTH = BUCKETS + 2 * CLASSES


def _class_table() -> np.ndarray:
    """Byte to class: lower, upper, digit, space, newline, sentence end, comma, quote, bracket,
    other mark, non-ASCII, control."""
    t = np.full(256, 9, np.uint8)
    t[:32] = 11
    for i, chars in enumerate((range(97, 123), range(65, 91), range(48, 58), b" \t", b"\n", b".!?", b",;:", b"'\"", b"()[]{}")):
        t[list(chars)] = i
    t[128:] = 10
    return t


CLASS = _class_table()


def encode_passages(raw: np.ndarray, offsets: np.ndarray, passage: int) -> tuple[np.ndarray, np.ndarray]:
    """Passage features (n, WIDTH) of documents that aren't empty, and passages by document."""
    sizes = np.diff(offsets)
    count = -(-sizes // passage)
    # Passages of a document have equal length, up to one byte.
    k = runs(count)
    doc = np.repeat(np.arange(len(sizes)), count)
    start = offsets[:-1][doc] + k * sizes[doc] // count[doc]
    n = len(start)
    bounds = np.append(start, offsets[-1])
    length = np.diff(bounds)
    which = np.repeat(np.arange(n, dtype=np.int32), length)
    folded = raw | ((CLASS[raw] == 1) << 5).astype(np.uint8)
    # Trigrams that reach beyond a document see zeros, so features don't depend on neighbours.
    b = np.concatenate((folded, [0, 0])).astype(np.uint32)
    second, third = b[1:-1].copy(), b[2:].copy()
    ends = offsets[1:][sizes > 0]
    second[ends - 1] = third[ends - 1] = 0
    third[ends[sizes[sizes > 0] > 1] - 2] = 0
    h = b[:-2] * np.uint32(0x9E3779B1) + second * np.uint32(0x85EBCA77) + third * np.uint32(0xC2B2AE3D)
    h ^= h >> np.uint32(15)
    h = (h * np.uint32(0x2C1B3C6D)) >> np.uint32(32 - 9)
    grams = np.bincount(which.astype(np.int64) * BUCKETS + h, minlength=n * BUCKETS).reshape(n, BUCKETS)
    c = CLASS[raw]
    kinds = np.bincount(which.astype(np.int64) * CLASSES + c, minlength=n * CLASSES).reshape(n, CLASSES)
    change = np.zeros(len(c), bool)
    change[:-1] = (c[:-1] == c[1:]) & (which[:-1] == which[1:])  # a class that repeats itself
    again = np.bincount(which[change].astype(np.int64) * CLASSES + c[change], minlength=n * CLASSES).reshape(n, CLASSES)
    out = np.empty((n, WIDTH), np.float32)
    size = np.maximum(length, 1)[:, None].astype(np.float32)
    np.sqrt(grams / size, out=out[:, :BUCKETS], casting="unsafe")
    np.sqrt(kinds / size, out=out[:, BUCKETS : BUCKETS + CLASSES], casting="unsafe")
    np.sqrt(again / size, out=out[:, BUCKETS + CLASSES :], casting="unsafe")
    return out, count


def encode_all(raw: np.ndarray, offsets: np.ndarray, passage: int, size: int = 2 << 20) -> tuple[np.ndarray, np.ndarray]:
    """encode_passages by pieces of about `size` bytes: what it needs beside its result stays small."""
    total = int((-(-np.diff(offsets) // passage)).sum())
    x, counts, at, row = np.empty((total, WIDTH), np.float32), [], 0, 0
    while at < len(offsets) - 1:
        end = max(at + 1, int(np.searchsorted(offsets, offsets[at] + size, "right")) - 1)
        part, count = encode_passages(raw[offsets[at] : offsets[end]], offsets[at : end + 1] - offsets[at], passage)
        x[row : row + len(part)] = part
        counts.append(count)
        at, row = end, row + len(part)
    return x, np.concatenate(counts)


@dataclass
class Mil:
    """Encoder E, gates V and U, attention w, score c and bias; threshold on the score."""

    mean: np.ndarray
    params: dict[str, np.ndarray]
    threshold: float = 0.0

    def forward(self, x: np.ndarray, count: np.ndarray) -> tuple:
        p = self.params
        h = np.tanh((x - self.mean) @ p["E"] + p["e"])
        t, s = np.tanh(h @ p["V"]), 1 / (1 + np.exp(-(h @ p["U"])))
        a = (t * s) @ p["w"]
        first = np.cumsum(count) - count
        a = np.exp(a - np.repeat(np.maximum.reduceat(a, first), count))
        a /= np.repeat(np.add.reduceat(a, first), count)
        z = np.add.reduceat(a[:, None] * h, first, axis=0)
        return h, t, s, a, z, 1 / (1 + np.exp(-(z @ p["c"] + p["b"])))

    def score(self, x: np.ndarray, count: np.ndarray) -> np.ndarray:
        return self.forward(x, count)[5]

    def attention(self, x: np.ndarray, count: np.ndarray) -> np.ndarray:
        return self.forward(x, count)[3]

    def gradients(self, x: np.ndarray, count: np.ndarray, y: np.ndarray, decay: float) -> dict[str, np.ndarray]:
        p = self.params
        h, t, s, a, z, out = self.forward(x, count)
        first, doc = np.cumsum(count) - count, np.repeat(np.arange(len(count)), count)
        d = (out - y) / len(y)
        dz = d[:, None] * p["c"]
        da = (dz[doc] * h).sum(1)
        dl = a * (da - np.add.reduceat(a * da, first)[doc])
        dh = a[:, None] * dz[doc]
        dt, ds = dl[:, None] * p["w"] * s * (1 - t * t), dl[:, None] * p["w"] * t * s * (1 - s)
        dh += dt @ p["V"].T + ds @ p["U"].T
        de = dh * (1 - h * h)
        g = {"E": (x - self.mean).T @ de, "e": de.sum(0), "V": h.T @ dt, "U": h.T @ ds,
             "w": (dl[:, None] * t * s).sum(0), "c": z.T @ d, "b": np.array(d.sum())}
        return {k: v + (decay * p[k] if k in "EVUc" else 0) for k, v in g.items()}


def train(
    x: np.ndarray, count: np.ndarray, y: np.ndarray, use: np.ndarray, hidden: int = 32, gate: int = 16,
    epochs: int = 30, batch: int = 64, rate: float = 3e-3, decay: float = 1e-4, seed: int = 7,
) -> Mil:
    """A model of the documents that `use` (their indices) names."""
    rng = np.random.default_rng(seed)
    draw = lambda *shape: (rng.standard_normal(shape) / np.sqrt(shape[0])).astype(np.float32)
    params = {"E": draw(x.shape[1], hidden) * 4, "e": np.zeros(hidden, np.float32), "V": draw(hidden, gate),
              "U": draw(hidden, gate), "w": draw(gate), "c": draw(hidden), "b": np.array(0.0)}
    model = Mil(x.mean(0, dtype=np.float64).astype(np.float32), params)
    first = np.cumsum(count) - count
    m = {k: np.zeros_like(v) for k, v in params.items()}
    v = {k: np.zeros_like(w) for k, w in params.items()}
    step = 0
    for _ in range(epochs):
        order = rng.permutation(use)
        for at in range(0, len(order), batch):
            docs = order[at : at + batch]
            c = count[docs]
            rows = np.repeat(first[docs], c) + runs(c)
            step += 1
            for k, g in model.gradients(x[rows], c, y[docs], decay).items():
                m[k] = 0.9 * m[k] + 0.1 * g
                v[k] = 0.999 * v[k] + 0.001 * g * g
                change = rate * (m[k] / (1 - 0.9**step)) / (np.sqrt(v[k] / (1 - 0.999**step)) + 1e-8)
                params[k] = (params[k] - change).astype(np.float32)
    return model


def set_threshold(model: Mil, score: np.ndarray, y: np.ndarray, false_rejects: float) -> None:
    """The score under which the fewest mistakes are left, and at most false_rejects of the good fall."""
    good, bad = np.sort(score[y == 1]), np.sort(score[y == 0])
    if not len(good) or not len(bad):
        return
    # One good document may always fall: a label can be wrong.
    limit = good[min(len(good) - 1, max(1, int(false_rejects * len(good))))]
    points = np.unique(np.concatenate((good, bad[bad <= limit], [limit])))
    points = points[points <= limit]
    wrong = np.searchsorted(good, points) / len(good) + 1 - np.searchsorted(bad, points) / len(bad)
    point = points[np.flatnonzero(wrong == wrong.min())[-1]]
    # Between the classes rather than next to either.
    under = bad[bad < point]
    model.threshold = float((under[-1] + point) / 2) if len(under) else 0.0


def fit(
    docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "quality",
    sample: int = 4000, sample_bytes: int = 64_000_000, passage: int = 1024, false_rejects: float = 0.01, least: int = 10, **training,
) -> Mil | None:
    """A model from at most `sample` labelled documents, half of them of each class.

    Of each class documents are taken in hash order up to half of sample_bytes; one larger than
    that is passed over whole.
    """
    known = (
        take(labels, id=id_col, y=label_col)
        .select(F.col("id").cast("long"), F.col("y").cast("int"))
        .where("id is not null and y in (0, 1)")
        .groupBy("id")
        .agg(F.max("y").alias("y"))
    )
    # A little more than half the sample of each class: some labels' documents may be gone.
    order = F.xxhash64("id"), F.col("id")
    chosen = known.where("y = 0").orderBy(*order).limit(sample).unionAll(known.where("y = 1").orderBy(*order).limit(sample))
    texts = texts_of(docs, id_col, text_col).withColumnRenamed("doc_id", "id")
    # `chosen` has at most 2 * sample rows of two numbers, whatever the input.
    chosen = F.broadcast(chosen) if sample <= 1_000_000 else chosen
    sized = texts.where("text is not null and text != ''").select("*", F.octet_length("text").alias("bytes"))
    found = sized.join(chosen, "id").where(F.col("bytes") <= sample_bytes // 2)
    # Of an id's several texts the one of the least hash.
    found = found.groupBy("id", "y").agg(F.min_by(F.struct("text", "bytes"), F.xxhash64("text")).alias("t")).select("id", "y", "t.*")
    so_far = Window.partitionBy("y").orderBy(*order)
    kept = found.select("*", F.sum("bytes").over(so_far).alias("total"), F.row_number().over(so_far).alias("rank"))
    rows = kept.where((F.col("total") <= sample_bytes // 2) & (F.col("rank") <= sample // 2)).select("id", "text", "y").toArrow()
    rows = rows.sort_by("id").combine_chunks()
    y = np.asarray(rows["y"].to_numpy(), np.float32)
    if min((y == 0).sum(), (y == 1).sum()) < least:
        return None
    raw, offsets, _ = utf8(rows["text"])
    x, count = encode_all(raw, offsets, passage)
    del rows, raw
    # By hash again: four of five documents are trained on, the others set the threshold.
    held = np.random.default_rng(11).random(len(y)) < 0.2
    first = np.cumsum(count) - count
    pick = lambda mask: np.repeat(first[mask], count[mask]) + runs(count[mask])
    model = train(x, count, y, np.flatnonzero(~held), **training)
    set_threshold(model, model.score(x[pick(held)], count[held]), y[held], false_rejects)
    return model


def scores(raw: np.ndarray, offsets: np.ndarray, model: Mil | None, passage: int) -> list[float | None]:
    there = np.diff(offsets) > 0
    out: list[float | None] = [None] * len(there)
    if there.any():
        x, count = encode_passages(raw, np.append(offsets[:-1][there], offsets[-1]), passage)
        found = model.score(x, count) if model else np.ones(len(count))
        for i, v in zip(np.flatnonzero(there), found):
            out[i] = float(v)
    return out


def score_quality(
    docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", passage: int = 1024, **fitting
) -> DataFrame:
    """doc_id, quality_score and keep for every document."""
    model = fit(docs, labels, id_col, text_col, passage=passage, **fitting)
    threshold = model.threshold if model else 0.0

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            raw, offsets, _ = utf8(batch.column(1))
            s = scores(raw, offsets, model, passage)
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(s, pa.float64()), pa.array([v is not None and v >= threshold for v in s])],
                names=["doc_id", "quality_score", "keep"],
            )

    return texts_of(docs, id_col, text_col).mapInArrow(run, "doc_id long, quality_score double, keep boolean")


def keep_quality(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", passage: int = 1024, **fitting) -> DataFrame:
    """The documents that the classifier doesn't reject, with all their columns."""
    model = fit(docs, labels, id_col, text_col, passage=passage, **fitting)
    threshold = model.threshold if model else 0.0

    @F.arrow_udf("boolean")
    def good(text: pa.Array) -> pa.Array:
        out: list[bool] = []
        for part in slices(iter([pa.RecordBatch.from_arrays([text], names=["text"])])):
            raw, offsets, _ = utf8(part.column(0))
            out += [v is not None and v >= threshold for v in scores(raw, offsets, model, passage)]
        return pa.array(out, pa.bool_())

    kept = numbered(docs).where(good(F.col(place(docs, text_col)).cast("string")))
    return kept.toDF(*docs.columns)
