"""What the operators share: column access, Arrow batches, exact cached tokenisation."""

from __future__ import annotations

import base64
import re
from array import array
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

TOKENIZERS = "/opt/tokenizers"
BYTE_BPE = f"{TOKENIZERS}/byte_bpe_50k.tiktoken"
PIECE_BPE = f"{TOKENIZERS}/piece_bpe_32k.model"
MULTI_BPE = f"{TOKENIZERS}/byte_bpe_multi_50k.tiktoken"

# The published pre-tokenisation of the byte-level vocabulary.
PRETOKEN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
# Unicode White_Space, which is what \s means there; Python's own \s also has \x1c-\x1f.
WS = "\t-\r \x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000"
# White space is the only thing pre-tokens never straddle, so these chunks are unions of
# whole pre-tokens and each can be encoded by itself.
# A run of Latin letters (all letters of U+00C0..U+024F) before an ASCII character is a whole
# pre-token; taking it alone makes the chunks recur more.
LATIN = "A-Za-z\u00c0-\u00d6\u00d8-\u00f6\u00f8-\u024f"
WORD = f" ?[{LATIN}]++(?![^\\x00-\\x7f])| ?[^{WS}]+"
CHUNK = re.compile(f"{WORD}|[{WS}]+(?![^{WS}])|[{WS}]+")
CACHED = 600_000
LONG_CHUNK = 64


def numbered(df: DataFrame) -> DataFrame:
    """df with its columns named c0, c1, .. by place, so that no two names differ in case only and
    names of an operator's own can't clash. toDF(*df.columns) gives the names back."""
    return df.toDF(*(f"c{i}" for i in range(len(df.columns))))


def place(df: DataFrame, name: str) -> str:
    """The numbered name of a column: the first of exactly this name, else the only one in any case."""
    names = df.columns
    if name in names:
        return f"c{names.index(name)}"
    found = [i for i, n in enumerate(names) if n.lower() == name.lower()]
    if len(found) != 1:
        raise ValueError(f"{len(found)} columns are named {name!r}; there are {names}")
    return f"c{found[0]}"


def take(df: DataFrame, **columns: str) -> DataFrame:
    """Only these columns (new name = name in df), whatever else df has."""
    return numbered(df).select(*(F.col(place(df, c)).alias(new) for new, c in columns.items()))


def texts_of(df: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """doc_id (long) and text (string) of every row."""
    return take(df, doc_id=id_col, text=text_col).select(
        F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")
    )


def without(names: list[str], gone: tuple[str, ...]) -> list[int]:
    """Places of the names that aren't among `gone`, whatever their case."""
    return [i for i, n in enumerate(names) if n.lower() not in gone]


def ranks_of(path: str) -> dict[bytes, int]:
    with open(path, "rb") as f:
        return {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}


class Remember(dict):
    """A bounded memo: values of short keys are kept, long ones are computed each time."""

    def __init__(self, make):
        super().__init__()
        self.make = make

    def __missing__(self, key):
        value = self.make(key)
        if len(key) <= LONG_CHUNK:
            if len(self) >= CACHED:
                self.clear()
            self[key] = value
        return value


class ByteBpe:
    """Exact byte-level BPE. Words recur, so each distinct chunk is encoded once per worker."""

    def __init__(self, path: str):
        import tiktoken

        self.ranks = ranks_of(path)
        self.size = len(self.ranks)
        self.width = "<u4"
        self.encoding = tiktoken.Encoding(
            "public", pat_str=PRETOKEN, mergeable_ranks=self.ranks, special_tokens={}
        )
        # No whole characters: what a text of unknown script falls back to.
        self.is_byte = np.zeros(self.size, bool)
        for token, i in self.ranks.items():
            try:
                token.decode()
            except UnicodeDecodeError:
                self.is_byte[i] = True
        self.single = self.encoding._core_bpe.encode_single_piece
        self.ids = Remember(lambda c: array("I", self.chunk_ids(c)).tobytes())

    def chunk_ids(self, chunk: str) -> list[int]:
        if chunk.isalpha() or (chunk[0] == " " and chunk[1:].isalpha()):  # one pre-token
            return self.single(chunk.encode())
        return self.encoding.encode_ordinary(chunk)

    def encode(self, text: str) -> np.ndarray:
        return np.frombuffer(b"".join(map(self.ids.__getitem__, CHUNK.findall(text))), "<u4")


SPACED = re.compile(" +[^ ]*")


class Pieces:
    """Exact sentencepiece ids, of which no piece straddles a space: each word is encoded once."""

    def __init__(self, path: str):
        import sentencepiece

        self.model = sentencepiece.SentencePieceProcessor(model_file=path)
        n = self.model.get_piece_size()
        self.size = n
        spaces = {"<0x09>", "<0x0A>", "<0x0D>"}
        self.is_byte = np.array([self.model.is_byte(i) and self.model.id_to_piece(i) not in spaces for i in range(n)])
        self.width = "<u2" if n <= 1 << 16 else "<u4"
        space = self.model.piece_to_id("▁")
        self.ids = Remember(
            lambda c: np.array(self.model.encode(c[1:]) if c != " " else [space], self.width).tobytes()
        )

    def encode(self, text: str) -> np.ndarray:
        if not text:
            return np.zeros(0, self.width)
        return np.frombuffer(b"".join(map(self.ids.__getitem__, SPACED.findall(" " + text))), self.width)


def vocabulary(path: str) -> type:
    """The class that reads a tokenizer file."""
    return Pieces if path.endswith(".model") else ByteBpe


_LOADED: dict = {}


def loaded(kind, path: str):
    """One tokenizer of a kind and path per worker process."""
    if (kind, path) not in _LOADED:
        _LOADED[kind, path] = kind(path)
    return _LOADED[kind, path]


def slices(batches: Iterator[pa.RecordBatch], rows: int = 512, size: int = 8 << 20) -> Iterator[pa.RecordBatch]:
    """Smaller batches: at most `rows`, and `size` bytes of text unless one row has more."""
    for batch in batches:
        lengths = np.zeros(batch.num_rows, np.int64)
        for c in batch.columns:
            if pa.types.is_string(c.type) or pa.types.is_large_string(c.type) or pa.types.is_binary(c.type):
                lengths += pc.binary_length(c).fill_null(0).to_numpy(zero_copy_only=False)
        ends = np.cumsum(lengths)
        at = 0
        while at < batch.num_rows:
            before = ends[at - 1] if at else 0
            end = max(at + 1, min(at + rows, int(np.searchsorted(ends, before + size, "right"))))
            yield batch.slice(at, end - at)
            at = end


def utf8(array: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """All bytes of a string column, the n+1 offsets into them, and which rows are not null."""
    if isinstance(array, pa.ChunkedArray):
        array = array.combine_chunks()
    there = np.asarray(array.is_valid())
    if array.null_count:
        array = array.fill_null("")
    array = array.cast(pa.large_string())
    _, offsets, data = array.buffers()
    off = np.frombuffer(offsets, np.int64)[array.offset : array.offset + len(array) + 1]
    raw = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    return raw[off[0] : off[-1]], off - off[0], there


def runs(of: np.ndarray) -> np.ndarray:
    """0, 1, .. within each run; of: the runs' lengths."""
    return np.arange(of.sum()) - np.repeat(np.cumsum(of) - of, of)


def mix64(x: np.ndarray) -> np.ndarray:
    """The finaliser of splitmix64: every input bit moves every output bit."""
    x = x.astype(np.uint64, copy=True)
    x ^= x >> np.uint64(30)
    x *= np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x94D049BB133111EB)
    x ^= x >> np.uint64(31)
    return x
