"""Order-preserving packing by dynamic programming.

The corpus is read in a fixed order and cut into windows of at most `window` tokens, at
document ends or sentence ends only. A cut plan costs its padding (unused tokens of every
window) plus `split_penalty` tokens for each cut inside a document and `hard_penalty` for each
cut inside a sentence, which only sentences longer than a window have. With S the prefix sums
of the unit lengths,

    f[j] = window - S[j] + penalty[j] + min over i with S[j] - S[i] <= window of (f[i] + S[i]),

and as the admissible i only move forward, a monotone queue yields each minimum in constant
time: linear in all, and the least cost for the shard. Ties take the earliest cut.

A shard is a run of the order of about shard_units units, by the count of units before it and not by
the values of ids, and is packed by itself (its last window bears its padding): shards run in
parallel, and the result doesn't depend on the cluster, on gaps between ids or on the files. The order
is found by one range shuffle of the unit lengths, a few bytes a sentence, and a count a partition;
texts are never shuffled. Exact token counts come from a public vocabulary.

Defined results: null and empty texts have no tokens and appear in no window; repeated rows
are packed each by itself; rows of equal order keep (doc_id, text hash) order, null ids first;
columns may have any names; an empty table gives no windows.
"""

from __future__ import annotations

from collections import deque
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..session import stored
from .common import BYTE_BPE, CHUNK, ByteBpe, Remember, loaded, numbered, place, slices

SCHEMA = (
    "shard long, window int, n_tokens int, padding int, cut string, "
    "pieces array<struct<doc_id:long,start:int,stop:int>>"
)
ENDS = tuple(".!?…。！？।")
CLOSERS = "\"'”’)]»"


class UnitCounter(ByteBpe):
    """Token counts of sentences, as cut out of the encoding of the whole text."""

    def __init__(self, path: str):
        super().__init__(path)
        self.coded = Remember(self.code)

    def code(self, chunk: str) -> int:
        """Twice the chunk's tokens, plus 1 if a sentence ends with it."""
        end = "\n" in chunk or chunk.rstrip(CLOSERS).endswith(ENDS)
        return 2 * (len(self.ids[chunk]) // 4) + end

    def lengths(self, text: str) -> np.ndarray:
        code = np.fromiter(map(self.coded.__getitem__, CHUNK.findall(text)), np.int64)
        if not len(code):
            return code
        total = np.cumsum(code >> 1)
        ends = code & 1
        ends[-1] = 1
        # White space after an end belongs to it: a cut is after the last of several ends.
        ends[:-1] &= 1 - ends[1:]
        return np.diff(total[ends.astype(bool)], prepend=0)


def split_long(lengths: np.ndarray, window: int) -> tuple[np.ndarray, np.ndarray]:
    """Units of at most a window, and which of them end inside a sentence."""
    if not len(lengths) or lengths.max() <= window:
        return lengths, np.zeros(len(lengths), bool)
    parts = -(-lengths // window)
    out = np.full(parts.sum(), window, np.int64)
    last = np.cumsum(parts) - 1
    out[last] = lengths - (parts - 1) * window
    inside = np.ones(len(out), bool)
    inside[last] = False
    return out, inside


def cuts(lengths: np.ndarray, penalty: np.ndarray, window: int) -> tuple[list[int], int]:
    """Unit indices at which windows end, and the plan's cost. Lengths are 1 .. window."""
    n = len(lengths)
    s = [0, *np.cumsum(lengths).tolist()]
    pen = [0, *penalty.tolist()]
    f, back = [0] * (n + 1), [0] * (n + 1)
    queue = deque([0])
    values = deque([0])  # f[i] + s[i], increasing from the head
    for j in range(1, n + 1):
        least = s[j] - window
        while s[queue[0]] < least:
            queue.popleft()
            values.popleft()
        back[j] = queue[0]
        f[j] = fj = window - s[j] + pen[j] + values[0]
        v = fj + s[j]
        while values and values[-1] > v:
            values.pop()
            queue.pop()
        values.append(v)
        queue.append(j)
    out, j = [], n
    while j:
        out.append(j)
        j = back[j]
    return out[::-1], f[n]


def pack_shard(table: pa.Table, window: int, split_penalty: int, hard_penalty: int) -> pa.Table:
    table = table.sort_by([("at", "ascending")])
    ids = table["doc_id"].to_pylist()
    units = table["units"].combine_chunks()
    bounds = np.asarray(units.offsets)
    flat = np.asarray(units.values)
    doc, lengths, penalty, start = [], [], [], []
    for k in range(len(ids)):
        part, inside = split_long(flat[bounds[k] : bounds[k + 1]].astype(np.int64), window)
        p = np.where(inside, hard_penalty, split_penalty)
        p[-1] = 0
        doc.append(np.full(len(part), k))
        lengths.append(part)
        penalty.append(p)
        start.append(np.cumsum(part) - part)
    doc, lengths, penalty, start = map(np.concatenate, (doc, lengths, penalty, start))
    ends, _ = cuts(lengths, penalty, window)
    rows = []
    shard, at = table["shard"][0].as_py(), 0
    for w, end in enumerate(ends):
        first = np.flatnonzero(np.diff(doc[at:end], prepend=-1)) + at
        stop = np.append(first[1:], end) - 1
        pieces = [
            {"doc_id": ids[doc[a]], "start": int(start[a]), "stop": int(start[b] + lengths[b])}
            for a, b in zip(first, stop)
        ]
        n = int(lengths[at:end].sum())
        p = penalty[end - 1]
        cut = "document" if p == 0 and (end == len(doc) or doc[end] != doc[end - 1]) else "sentence"
        if end < len(doc) and doc[end] == doc[end - 1] and p == hard_penalty != split_penalty:
            cut = "inside"
        rows.append((shard, w, n, window - n, cut, pieces))
        at = end
    return pa.Table.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows), OUT)], schema=OUT)


OUT = pa.schema(
    [("shard", pa.int64()), ("window", pa.int32()), ("n_tokens", pa.int32()), ("padding", pa.int32()),
     ("cut", pa.string()), ("pieces", pa.list_(pa.struct([("doc_id", pa.int64()), ("start", pa.int32()), ("stop", pa.int32())])))]
)


def pack(
    docs: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    order: list[Column] | None = None,
    shard_units: int = 1 << 18,
    window: int = 2048,
    split_penalty: int = 64,
    hard_penalty: int = 1024,
    tokenizer: str = BYTE_BPE,
) -> DataFrame:
    """Windows of the corpus in the order of some columns (default: the id).

    (shard, window) is the order of the windows. pieces: the token ranges [start, stop) of documents
    that fill a window, in order.
    """
    keys = [f"k{i}" for i in range(len(order or [0]))]

    def units(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counter = loaded(UnitCounter, tokenizer)
        for batch in slices(batches, 2048):
            found = [counter.lengths(t) for t in batch.column(batch.num_columns - 1).to_pylist()]
            offsets = np.zeros(len(found) + 1, np.int32)
            np.cumsum([len(x) for x in found], out=offsets[1:])
            flat = np.concatenate(found).astype(np.int32) if found else np.zeros(0, np.int32)
            lists = pa.ListArray.from_arrays(pa.array(offsets), pa.array(flat))
            yield pa.RecordBatch.from_arrays([*batch.columns[:-1], lists], names=[*keys, "doc_id", "tie", "units"])

    text = F.col(place(docs, text_col)).cast("string")
    ident = F.col(place(docs, id_col)).cast("long")
    if order is None:
        sent = numbered(docs).select(ident.alias("k0"), ident.alias("doc_id"), F.xxhash64(text).alias("tie"), text.alias("text"))
    else:
        # The order is said in the input's own names; it comes last, where it clashes with none.
        n = len(docs.columns)
        both = docs.select("*", *order)
        both = both.toDF(*(f"c{i}" if i < n else keys[i - n] for i in range(n + len(keys))))
        sent = both.select(*keys, ident.alias("doc_id"), F.xxhash64(text).alias("tie"), text.alias("text"))
    sent = sent.where("text is not null and text != ''")
    kinds = ", ".join(f"{k} {sent.schema[k].dataType.simpleString()}" for k in keys)
    # Stored, because a range shuffle reads its input twice.
    lengths = stored(sent.mapInArrow(units, f"{kinds}, doc_id long, tie long, units array<int>"))
    by = [*keys, "doc_id", "tie", "row"]

    def counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Rows with their place in the partition and the units before them."""
        task, row, before = TaskContext.get().partitionId(), 0, 0
        for batch in batches:
            offsets = np.asarray(batch.column(1).offsets)
            n, sizes = batch.num_rows, np.diff(offsets)
            total = before + np.cumsum(sizes, dtype=np.int64)
            columns = [pa.array(np.full(n, task, np.int32)), pa.array(row + np.arange(n)), pa.array(total - sizes)]
            yield pa.RecordBatch.from_arrays([*batch.columns, *columns], names=["doc_id", "units", "part", "at", "before"])
            row, before = row + n, before + int(sizes.sum())

    # Equal rows are told apart by where they lie, so that any number of them can be split.
    ranged = lengths.withColumn("row", F.monotonically_increasing_id()).repartitionByRange(*by).sortWithinPartitions(*by)
    ranged = stored(ranged.select("doc_id", "units").mapInArrow(counted, "doc_id long, units array<int>, part int, at long, before long"))
    # One row a partition of the range shuffle.
    sums = ranged.groupBy("part").agg(F.max(F.col("before") + F.size("units")).alias("n"))
    starts = sums.select("part", (F.sum("n").over(Window.orderBy("part")) - F.col("n")).alias("start"))
    shard = F.floor((F.col("start") + F.col("before")) / F.lit(shard_units)).cast("long")
    at = F.col("part").cast("long") * F.lit(1 << 40) + F.col("at")
    placed = ranged.join(starts, "part").select(shard.alias("shard"), at.alias("at"), "doc_id", "units")

    def one(table: pa.Table) -> pa.Table:
        return pack_shard(table, window, split_penalty, hard_penalty)

    return placed.groupBy("shard").applyInArrow(one, SCHEMA)


def pack_in_file_order(docs: DataFrame, **options) -> DataFrame:
    """pack() in the order in which the rows were written: by file name and row of what docs reads.

    Rows that come from anywhere else are written first, in their own order, to the shared folder.
    """
    order = [F.col("_metadata.file_name"), F.col("_metadata.row_index")]
    try:
        docs.select(*order)
    except AnalysisException:
        docs = stored(docs)
    return pack(docs, order=order, **options)
