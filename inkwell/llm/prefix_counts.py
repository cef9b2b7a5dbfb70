"""Exact token count at every prefix of a text, by dynamic programming.

The encoding of the bytes w[:i] of one pre-token ends in the one vocabulary token t for which
t follows the last token of the encoding of w[:i-|t|] and the two stay apart when encoded
together. So last[i] and count[i] = count[i-|t|] + 1 come from earlier prefixes without
encoding any prefix again. Prefixes of a text reduce to prefixes of its white-space chunks,
whose counts are memoised per worker.

Counts are stored as one signed byte a character (the change that the character makes; it can
be negative) and absolute counts at each `stride` characters, so a lookup adds up fewer than
`stride` bytes. A document in which a change needs more than a byte gets 4-byte changes.

Defined results: a null text gives nulls; an empty text 0 characters, 0 tokens and empty
changes; ids may be null or repeat; other columns are ignored; an empty table gives no rows.
The unit of a prefix is the Unicode code point. A budget smaller than the first prefix's count
gives 0 characters.
"""

from __future__ import annotations

import re
from array import array
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from .common import BYTE_BPE, PRETOKEN, WORD, WS, ByteBpe, Remember, loaded, slices, texts_of

# A run of two or more white-space characters is kept with the word after it: whether its
# last character goes with the word depends on both.
PIECE = re.compile(f"[{WS}]{{2,}}[^{WS}]+|{WORD}|[{WS}]+")
SPLIT = re.compile(f"([{WS}]*)(.*)", re.S)
MEMO_BYTES, MEMO = 40, 400_000
SCHEMA = (
    "doc_id long, n_chars int, n_tokens int, width int, stride int, counts array<int>, "
    "changes binary, fits array<int>"
)


class PrefixBpe(ByteBpe):
    def __init__(self, path: str):
        import regex

        super().__init__(path)
        self.pretokens = regex.compile(PRETOKEN).findall
        self.longest = max(map(len, self.ranks))
        self.apart: dict[tuple[bytes, bytes], bool] = {}
        self.memo: dict[bytes, tuple[bytes, bytes]] = {b"": (b"\0", b"")}
        self.bytes8 = Remember(lambda c: array("b", self.change(c)).tobytes())

    def stay_apart(self, key: tuple[bytes, bytes]) -> bool:
        if len(self.apart) > 1_000_000:
            self.apart.clear()
        a, b = key
        known = self.apart[key] = self.single(a + b) == [self.ranks[a], self.ranks[b]]
        return known

    def dp(self, w: bytes) -> bytes | list[int]:
        """count[i] for each byte prefix w[:i]; count[0] is 0.

        Short prefixes are remembered with their last token: words share most of theirs.
        """
        n = len(w)
        ranks, longest, apart, test = self.ranks, self.longest, self.apart, self.stay_apart
        if n > MEMO_BYTES:
            count, last = [0] * (n + 1), [b""] * (n + 1)
            for i in range(1, n + 1):
                for j in (i - 1 - len(last[i - 1]), *range(max(0, i - longest), i)):
                    t = w[j:i]
                    if t in ranks and (j == 0 or (apart.get(k) if (k := (last[j], t)) in apart else test(k))):
                        count[i], last[i] = count[j] + 1, t
                        break
            return count
        memo = self.memo
        i = n
        while w[:i] not in memo:
            i -= 1
        count, last = memo[w[:i]]
        while i < n:
            i += 1
            # The last token is unique, so the order of trial is free: most often it is the
            # previous one grown by a byte, or the byte alone.
            for j in (i - 1 - len(last), i - 1, *range(max(0, i - longest), i - 1)):
                t = w[j:i]
                if t in ranks and (j == 0 or (apart[k] if (k := (memo[w[:j]][1], t)) in apart else test(k))):
                    count, last = count + bytes((count[j] + 1,)), t
                    break
            memo[w[:i]] = count, last
        if len(memo) > MEMO:
            self.memo = {b"": (b"\0", b"")}
        return count

    def piece(self, w: str) -> list[int]:
        """Counts at each character prefix of one pre-token."""
        count = self.dp(w.encode())
        if w.isascii():
            return list(count[1:])
        out, at = [], 0
        for c in w:
            at += len(c.encode())
            out.append(count[at])
        return out

    def chunk(self, chunk: str) -> list[int]:
        """Counts at each character prefix of a chunk."""
        if chunk.isalpha() or (chunk[0] == " " and chunk[1:].isalpha()):  # one pre-token
            return self.piece(chunk)
        run, word = SPLIT.fullmatch(chunk).groups()
        if not word:
            return self.piece(run)
        out: list[int] = []
        base = 0
        if run == " ":
            word = chunk
        elif run:
            out += self.piece(run)
            base = self.dp(run[:-1].encode())[-1]
            if run[-1] == " ":
                word = " " + word
            else:
                base += self.dp(run[-1].encode())[-1]
        for w in self.pretokens(word):
            if w[0] == "'" and len(w) > 1 and w[1].isalpha():  # its prefixes split otherwise
                counts = [len(self.encoding.encode_ordinary(w[: k + 1])) for k in range(len(w))]
            else:
                counts = self.piece(w)
            out += [base + c for c in counts]
            base = out[-1]
        if run and run != " " and run[-1] == " ":
            del out[len(run)]  # the space was counted with the run
        return out

    def change(self, chunk: str) -> list[int]:
        counts = self.chunk(chunk)
        return [a - b for a, b in zip(counts, [0, *counts])]

    def changes(self, text: str) -> tuple[int, bytes]:
        """Bytes a change, and the changes that the characters make."""
        pieces = PIECE.findall(text)
        try:
            return 1, b"".join(map(self.bytes8.__getitem__, pieces))
        except OverflowError:
            return 4, b"".join(array("i", self.change(p)).tobytes() for p in pieces)


def changes_of(width: int, data: bytes) -> np.ndarray:
    return np.frombuffer(data, np.int8 if width == 1 else "<i4")


def tokens_at(prefix: int, width: int, stride: int, counts, changes: bytes) -> int:
    """Tokens of the first `prefix` characters, from stored values alone."""
    block = prefix // stride
    part = changes[block * stride * width : prefix * width]
    return int(counts[block]) + int(changes_of(width, part).sum(dtype=np.int64))


def longest_prefix(budget: int, width: int, changes: bytes) -> int:
    """Characters of the longest prefix that takes at most `budget` tokens."""
    fits = np.flatnonzero(np.cumsum(changes_of(width, changes), dtype=np.int64) <= budget)
    return int(fits[-1]) + 1 if len(fits) else 0


def prefix_counts(
    docs: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    tokenizer: str = BYTE_BPE,
    stride: int = 1024,
    budgets: tuple[int, ...] = (512, 2048, 8192),
) -> DataFrame:
    """Every document's prefix counts; fits: characters of its longest prefix within each budget."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = loaded(PrefixBpe, tokenizer)
        for batch in slices(batches):
            rows: list[tuple] = []
            for text in batch.column(1).to_pylist():
                if text is None:
                    rows.append((None,) * 7)
                    continue
                width, data = bpe.changes(text)
                count = np.cumsum(changes_of(width, data), dtype=np.int32)
                n = len(count)
                stored = [0, *count[stride - 1 :: stride].tolist()]
                fits = []
                for b in budgets:
                    if not n or count[-1] <= b:
                        fits.append(n)
                    else:
                        ok = np.flatnonzero(count <= b)
                        fits.append(int(ok[-1]) + 1 if len(ok) else 0)
                rows.append((n, int(count[-1]) if n else 0, width, stride, stored, data, fits))
            n, tokens, width, strides, stored, data, fits = zip(*rows)
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column(0),
                    *(pa.array(x, pa.int32()) for x in (n, tokens, width, strides)),
                    pa.array(stored, pa.list_(pa.int32())),
                    pa.array(data, pa.binary()),
                    pa.array(fits, pa.list_(pa.int32())),
                ],
                names=["doc_id", "n_chars", "n_tokens", "width", "stride", "counts", "changes", "fits"],
            )

    return texts_of(docs, id_col, text_col).mapInArrow(run, SCHEMA)
