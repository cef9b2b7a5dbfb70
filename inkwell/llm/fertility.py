"""Quality rule on tokeniser fertility, with rejection bands per language or script.

Public vocabularies that weren't fitted to a text spend tokens on it in a way that tells prose
from junk: characters per token, the share of byte-fallback tokens (byte pieces, or byte-level tokens
that are no whole characters), and the entropy of the token distribution, for each vocabulary.
Bands are Tukey fences over all documents of one language (of one script,
where the language is null) and one power of two of length, because entropy grows with length.
A group of fewer than `least` documents takes the fences of its own language over neighbouring
lengths (one power of two either side); where these are too few as well, those of its language at
all lengths, if it is no shorter than the language's median (a shorter text varies more; a longer
one has more entropy, not less). Other languages never count: one with fewer than `least`
documents rejects nothing, however large the corpus. Line breaks and tabs, which the piece
vocabulary spells as bytes, don't count as fallback.

The texts are read and tokenised once; the measures (a few numbers a document) are stored in
the shared folder, because bands and verdicts both need them. Quartiles are those of the measures on
a grid (`GRID`), from one count of (language, length, measure, grid step): exact for what they
state, the same for any partitioning, and a sum that a language of any size adds up before the
shuffle. The table of fences has a row a language and length; the verdict is one join with it.

Defined results: one row a document, keep false with reason 'empty' for null and empty texts
(their measures are null); ids may be null or repeat; columns may have any names; an empty table
gives no rows.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from functools import cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..session import stored
from .common import MULTI_BPE, PIECE_BPE, loaded, slices, take, vocabulary

MEASURES = ("chars_per_token", "byte_share", "entropy")
GRID = {"chars_per_token": 0.01, "byte_share": 0.001, "entropy": 0.01, "size": 1.0}


def named(vocabularies: int) -> list[str]:
    """Measures of the first vocabulary by their names, of others with a number."""
    return [m + (f"_{k + 1}" if k else "") for k in range(vocabularies) for m in MEASURES]


@cache
def log2_table(n: int) -> np.ndarray:
    k = np.arange(n, dtype=np.float64)
    return k * np.log2(np.maximum(k, 1))


def entropy(ids: np.ndarray) -> float:
    """Bits a token, from the counts of the ids of one document."""
    s = np.sort(ids)
    edges = np.flatnonzero(s[1:] != s[:-1])
    counts = np.diff(np.concatenate(([-1], edges, [len(s) - 1])))
    n = len(s)
    return float(np.log2(n) - (counts * np.log2(counts)).sum() / n) if n else 0.0


SCRIPTS = (
    ("Latin", "A-Za-zÀ-ɏ"), ("Greek", "Ͱ-Ͽ"), ("Cyrillic", "Ѐ-ӿ"), ("Hebrew", "֐-׿"), ("Arabic", "؀-ۿ"),
    ("Devanagari", "ऀ-ॿ"), ("Thai", "฀-๿"), ("Kana", "぀-ヿ"), ("Han", "㐀-鿿"), ("Hangul", "가-힯"),
)
COUNTERS = [(name, re.compile(f"[{span}]+")) for name, span in SCRIPTS]


def script(text: str) -> str:
    """The script of most of a text's letters."""
    n, name = max((sum(map(len, rx.findall(text))), name) for name, rx in COUNTERS)
    return f"script:{name if n else 'none'}"


def measure(docs: DataFrame, id_col: str, text_col: str, lang_col: str, tokenizers: tuple[str, ...]) -> DataFrame:
    names = named(len(tokenizers))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        models = [loaded(vocabulary(path), path) for path in tokenizers]
        for batch in slices(batches, 2048):
            rows = []
            for text, lang in zip(batch.column(1).to_pylist(), batch.column(2).to_pylist()):
                if not text:
                    rows.append((lang, 0, *[None] * len(names)))
                    continue
                of_all = []
                for model in models:
                    ids = model.encode(text)
                    of_all += [len(text) / len(ids), float(model.is_byte[ids].mean()), entropy(ids)]
                    n = len(ids) if len(of_all) == 3 else n
                rows.append((lang or script(text), n, *of_all))
            band, n, *rest = zip(*rows)
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(band, pa.string()), pa.array(n, pa.int32())]
                + [pa.array(x, pa.float64()) for x in rest],
                names=["doc_id", "band", "n_tokens", *names],
            )

    picked = take(docs, doc_id=id_col, text=text_col, lang=lang_col).select(
        F.col("doc_id").cast("long"), F.col("text").cast("string"), F.col("lang").cast("string")
    )
    return picked.mapInArrow(run, "doc_id long, band string, n_tokens int, " + ", ".join(f"{m} double" for m in names))


def quartiles(bins: DataFrame, by: list[str], least: int) -> DataFrame:
    """q1, median and q3 of each measure and group of at least `least` documents: the lowest grid step
    that a quarter, half or three quarters of them don't exceed."""
    bins = bins.groupBy(*by, "measure", "step").agg(F.sum("n").alias("n"))
    group = Window.partitionBy(*by, "measure")
    upto = bins.select("*", F.sum("n").over(group.orderBy("step")).alias("upto"), F.sum("n").over(group).alias("all"))
    upto = upto.where(F.col("all") >= least)
    at = lambda q: F.min(F.when(F.col("upto") >= F.col("all") * q, F.col("step")))
    return upto.groupBy(*by, "measure").agg(at(0.25).alias("q1"), at(0.5).alias("q2"), at(0.75).alias("q3"))


def fences(measured: DataFrame, names: list[str], k: float, least: int, floors: dict) -> DataFrame:
    """A row for each band and size class that occurs: of every measure m the limits m_lo and m_hi, and
    those of the language m_l_lo and m_l_hi for texts of l_median tokens or more."""
    step = lambda m: F.floor(F.col(m) / GRID[m.rstrip("_0123456789")] + 0.5).cast("long")
    each = [F.struct(F.lit(m).alias("measure"), step(m).alias("step")) for m in names]
    each.append(F.struct(F.lit("size").alias("measure"), F.col("n_tokens").cast("long").alias("step")))
    bins = (
        measured.where("n_tokens > 0")
        .select("band", "size_class", F.explode(F.array(*each)).alias("x"))
        .groupBy("band", "size_class", "x.measure", "x.step")
        .agg(F.count(F.lit(1)).alias("n"))
    )
    bins = stored(bins)
    fine = quartiles(bins.where("measure != 'size'"), ["band", "size_class"], least)
    around = F.explode(F.array(*(F.col("size_class") + i for i in (-1, 0, 1))))
    wide = quartiles(bins.where("measure != 'size'").withColumn("size_class", around), ["band", "size_class"], least)
    lang = quartiles(bins, ["band"], least)
    limits = []
    for m in names:
        kind = m.rstrip("_0123456789")
        of = lambda t, e, m=m: F.max(F.when(F.col("measure") == m, F.col(f"{t}{e}") * GRID[m.rstrip("_0123456789")]))
        for own, t in ((True, "w"), (False, "l")):
            q1, q3 = (F.coalesce(of("f", e), of("w", e)) if own else of(t, e) for e in ("_q1", "_q3"))
            spread = k * F.greatest(q3 - q1, F.lit(floors[kind]))
            name = m if own else f"{m}_l"
            limits += [(q1 - spread).alias(f"{name}_lo"), (q3 + spread).alias(f"{name}_hi")]
    said = lambda df, t, by: df.select(*by, "measure", *(F.col(q).alias(f"{t}_{q}") for q in ("q1", "q2", "q3")))
    groups = bins.select("band", "size_class", "measure").distinct()
    both = (
        groups.join(said(fine, "f", ["band", "size_class"]), ["band", "size_class", "measure"], "left")
        .join(said(wide, "w", ["band", "size_class"]), ["band", "size_class", "measure"], "left")
        .join(said(lang, "l", ["band"]), ["band", "measure"], "left")
    )
    median = F.max(F.when(F.col("measure") == "size", F.col("l_q2"))).alias("l_median")
    return both.groupBy("band", "size_class").agg(median, *limits)


def fertility_rules(
    docs: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    lang_col: str = "lang",
    tokenizers: tuple[str, ...] = (PIECE_BPE, MULTI_BPE),
    k: float = 3.0,
    least: int = 30,
    floors: dict | None = None,
) -> DataFrame:
    """Measures and verdict of every document.

    k: interquartile ranges beyond the quartiles. floors: the least interquartile range of each
    measure, so that a very uniform group doesn't reject what differs in nothing that matters.
    n_tokens is the first vocabulary's.
    """
    floors = {"chars_per_token": 0.1, "byte_share": 0.01, "entropy": 0.2} | (floors or {})
    names = named(len(tokenizers))
    m = stored(measure(docs, id_col, text_col, lang_col, tokenizers)).withColumn(
        "size_class", F.floor(F.log2(F.greatest("n_tokens", F.lit(1)))).cast("int")
    )
    # Stored, so that its size is known when the join is planned: broadcast if small, else shuffled.
    limits = stored(fences(m, names, k, least, floors))
    j = m.join(limits, ["band", "size_class"], "left")
    reasons = [F.when(F.coalesce("n_tokens", F.lit(0)) == 0, F.lit("empty"))]
    for x in names:
        own = [F.when(F.col("n_tokens") >= F.col("l_median"), F.col(f"{x}_l_{e}")) for e in ("lo", "hi")]
        lo = F.coalesce(f"{x}_lo", own[0])
        hi = F.coalesce(f"{x}_hi", own[1] if not x.startswith("entropy") else F.lit(None))
        reasons += [F.when(F.col(x) < lo, F.lit(f"{x}_low")), F.when(F.col(x) > hi, F.lit(f"{x}_high"))]
    why = F.filter(F.array(*reasons), lambda r: r.isNotNull())
    return j.select("doc_id", "band", "n_tokens", *names, why.alias("reasons")).withColumn("keep", F.size("reasons") == 0)
