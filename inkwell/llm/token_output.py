"""Token-ID binary output: fixed-width bit packing with block offsets.

Every id takes the least number of bits that the vocabulary needs. A document's ids are cut
into blocks of `block_tokens`; each block starts on a byte, so block b of a document can be
read alone from block_offsets[b] with vectorised numpy, and token i lies in block
i // block_tokens. One narrow pass: no shuffle, and no state beyond one slice of a batch.

Defined results: a null text gives null counts and payload; an empty text 0 tokens, an empty
payload and offsets [0]; ids may be null or repeat, each row is packed by itself; other
columns of the input are ignored, whatever their names; an empty table gives no rows.
"""

from __future__ import annotations

from collections.abc import Iterator
from math import gcd

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from .common import PIECE_BPE, loaded, slices, texts_of, vocabulary

SCHEMA = (
    "doc_id long, n_tokens int, bits int, block_tokens int, block_offsets array<int>, payload binary"
)


def bits_for(vocabulary: int) -> int:
    """The least width that holds ids 0 .. vocabulary-1."""
    return max(1, int(vocabulary - 1).bit_length())


def pack_bits(ids: np.ndarray, bits: int) -> bytes:
    """Ids in little-endian bit order, padded with zero bits to a whole byte."""
    return packed_rows(ids, bits).view(np.uint8).ravel()[: -(-len(ids) * bits // 8)].tobytes()


def packed_rows(ids: np.ndarray, bits: int) -> np.ndarray:
    """Ids shifted into 64-bit words. A row of words holds as many ids as fill whole words; each of
    its ids has the same place in every row, so one shift serves a whole column."""
    if len(ids) and int(ids.max()) >> bits:
        raise ValueError(f"an id needs more than {bits} bits")
    n = 64 // gcd(64, bits)
    flat = np.zeros(-(-len(ids) // n) * n, np.uint64)
    flat[: len(ids)] = ids
    columns = np.ascontiguousarray(flat.reshape(-1, n).T)
    out = np.zeros((bits * n // 64, columns.shape[1]), np.uint64)
    for k in range(n):
        word, shift = divmod(k * bits, 64)
        out[word] |= columns[k] << np.uint64(shift)
        if shift + bits > 64:
            out[word + 1] |= columns[k] >> np.uint64(64 - shift)
    return np.ascontiguousarray(out.T)


def unpack_bits(data: bytes, bits: int, count: int) -> np.ndarray:
    raw = np.zeros(len(data) + 8, np.uint64)
    raw[: len(data)] = np.frombuffer(data, np.uint8)
    at = np.arange(count) * bits
    first = at >> 3
    value = np.zeros(count, np.uint64)
    for k in range((bits + 14) // 8):
        value |= raw[first + k] << np.uint64(8 * k)
    return (value >> (at & 7).astype(np.uint64) & np.uint64((1 << bits) - 1)).astype(np.uint32)


def pack_blocks(ids: np.ndarray, bits: int, block: int) -> tuple[bytes, list[int]]:
    """The payload, and where each block starts and the last ends."""
    data, offsets = pack_documents([ids], bits, block)
    return data[0], offsets[0]


def pack_documents(documents: list[np.ndarray], bits: int, block: int) -> tuple[list[bytes], list[list[int]]]:
    """pack_blocks() of many documents, all of whose blocks are shifted at once."""
    sizes = np.array([len(d) for d in documents], np.int64)
    blocks = -(-sizes // block)
    doc = np.repeat(np.arange(len(sizes)), blocks)
    nth = np.arange(len(doc)) - np.repeat(np.cumsum(blocks) - blocks, blocks)
    length = np.minimum(block, sizes[doc] - nth * block)
    n = 64 // gcd(64, bits)
    wide = -(-length // n) * n  # every block starts on a row of words
    start = np.cumsum(wide) - wide
    ids = np.zeros(int(wide.sum()), np.uint32)
    if len(ids):
        flat = np.concatenate(documents)
        ids[np.repeat(start, length) + np.arange(len(flat)) - np.repeat(np.cumsum(length) - length, length)] = flat
    raw = packed_rows(ids, bits).view(np.uint8).ravel().tobytes()
    cut = [raw[a : a + k] for a, k in zip((start * bits // 8).tolist(), (-(-length * bits // 8)).tolist())]
    full, out, offsets, at = (block * bits + 7) // 8, [], [], 0
    for n_blocks in blocks.tolist():
        data = b"".join(cut[at : at + n_blocks])
        out.append(data)
        offsets.append([*range(0, n_blocks * full, full), len(data)])
        at += n_blocks
    return out, offsets


def read_tokens(payload: bytes, offsets, n_tokens: int, bits: int, block: int, start: int, stop: int):
    """Tokens start .. stop-1, touching only the blocks that hold them."""
    start, stop = max(0, start), min(stop, n_tokens)
    if stop <= start:
        return np.zeros(0, np.uint32)
    first, last = start // block, (stop - 1) // block
    parts = [
        unpack_bits(payload[offsets[b] : offsets[b + 1]], bits, min(block, n_tokens - b * block))
        for b in range(first, last + 1)
    ]
    return np.concatenate(parts)[start - first * block : stop - first * block]


def pack_tokens(
    docs: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    tokenizer: str = PIECE_BPE,
    extra_ids: int = 1,
    block_tokens: int = 1024,
) -> DataFrame:
    """Packed token ids of every document. extra_ids: ids kept free above the vocabulary (end of text)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = loaded(vocabulary(tokenizer), tokenizer)
        bits = bits_for(bpe.size + extra_ids)
        for batch in slices(batches):
            found = [None if t is None else bpe.encode(t) for t in batch.column(1).to_pylist()]
            there = [x for x in found if x is not None]
            done = iter(zip(*pack_documents(there, bits, block_tokens)))
            out = [(None, None, None) if x is None else (len(x), *next(done)) for x in found]
            n, data, offsets = zip(*out)
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column(0),
                    pa.array(n, pa.int32()),
                    pa.array([bits] * len(n), pa.int32()),
                    pa.array([block_tokens] * len(n), pa.int32()),
                    pa.array(offsets, pa.list_(pa.int32())),
                    pa.array(data, pa.binary()),
                ],
                names=["doc_id", "n_tokens", "bits", "block_tokens", "block_offsets", "payload"],
            )

    return texts_of(docs, id_col, text_col).mapInArrow(run, SCHEMA)
