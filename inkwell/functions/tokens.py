"""Text analysis as Python token streams: character filters, tokenizers, token filters.

Used where no built-in expresses the step (Unicode segmentation, stemming, normalisation); see
`native` for the Column forms. A token carries UTF-8 byte offsets, a position increment, a type
and a keyword flag. Everything here is a plain function over one value, so an analyser runs
inside one Arrow-batched function whatever its chain.
"""

from __future__ import annotations

import re
import unicodedata
from collections import Counter
from collections.abc import Callable, Iterable, Sequence
from dataclasses import dataclass
from functools import lru_cache
from typing import NamedTuple

import regex


class Token(NamedTuple):
    term: str
    start: int = 0
    end: int = 0
    incr: int = 1
    type: str = "alphanum"
    keyword: bool = False


Filter = Callable[[list[Token]], list[Token]]
Tokenizer = Callable[[str], list[Token]]

# --- character filters ---------------------------------------------------------------------


def replace_chars(pattern: str, by: str) -> Callable[[str], str]:
    """Regexp replacement; $1 and ${1} in `by` refer to groups."""
    rx, to = regex.compile(pattern), re.sub(r"\$\{?(\w+)\}?", r"\\g<\1>", by)
    return lambda s: rx.sub(to, s)


def strip_html(s: str) -> str:
    """Each tag, comment or doctype becomes one space."""
    return HTML.sub(" ", s)


HTML = re.compile(r"</?[!\w]+(?:\s+(?:[^\s\"'>/=]+(?:\s*=\s*(?:\"[^\"]*\"|'[^']*'|[^\s\"'=<>`]+))?|\"[^\"]*\"))*\s*/?>|<!--.*?-->", re.S)


def split_joiners(s: str) -> str:
    return s.replace("\u200c", " ")


_FOLD_MORE = {
    "Æ": "AE", "æ": "ae", "Œ": "OE", "œ": "oe", "ß": "ss", "ẞ": "SS", "Ø": "O", "ø": "o", "Đ": "D", "đ": "d",
    "Ð": "D", "ð": "d", "Þ": "TH", "þ": "th", "Ł": "L", "ł": "l", "ı": "i", "Ħ": "H", "ħ": "h", "Ŋ": "N", "ŋ": "n",
    "ĸ": "q", "ſ": "s", "Ŧ": "T", "ŧ": "t", "ƒ": "f", "‘": "'", "’": "'", "‚": "'", "‛": "'", "“": '"', "”": '"',
    "„": '"', "«": '"', "»": '"', "‹": "'", "›": "'", "‐": "-", "‑": "-", "‒": "-", "–": "-", "—": "-", "′": "'", "″": '"',
    "⁄": "/", "•": "*",
}


def fold_ascii(s: str) -> str:
    """Accents, ligatures and typographic marks as ASCII; what has no ASCII form stays."""
    if s.isascii():
        return s
    out = []
    for c in s:
        if c < "\x80":
            out.append(c)
        elif c in _FOLD_MORE:
            out.append(_FOLD_MORE[c])
        else:
            d = "".join(x for x in unicodedata.normalize("NFKD", c) if not unicodedata.combining(x))
            d = "".join(_FOLD_MORE.get(x, x) for x in d)
            out.append(d if d.isascii() and d else c)
    return "".join(out)


# --- tokenizers ----------------------------------------------------------------------------


def _spans(text: str, spans: Iterable[tuple[int, int, str]]) -> list[Token]:
    """Tokens of character spans, with byte offsets."""
    if text.isascii():
        return [Token(text[a:b], a, b, 1, t) for a, b, t in spans]
    out, at, byte = [], 0, 0
    for a, b, t in spans:
        byte += len(text[at:a].encode())
        end = byte + len(text[a:b].encode())
        out.append(Token(text[a:b], byte, end, 1, t))
        at, byte = b, end
    return out


_WORD = regex.compile(r"(?V1)(?w)\b")
_IDEO = regex.compile(r"[\p{Han}\p{Hiragana}\p{Katakana}]")
_NUM = regex.compile(r"\p{Nd}")
_ALNUM = regex.compile(r"[\p{L}\p{N}\p{M}]")
_ONE = regex.compile(r"[\p{Han}\p{Hiragana}]")


_SPACED = re.compile("[^ \\t\\n\\r]+")


@lru_cache(200_000)
def _segments(chunk: str) -> tuple[tuple[int, int, str], ...]:
    """Word spans of text without white space, which no word straddles: chunks recur."""
    spans, cuts = [], [m.start() for m in _WORD.finditer(chunk)]
    for a, b in zip(cuts, [*cuts[1:], len(chunk)]):
        seg = chunk[a:b]
        if not seg or not _ALNUM.search(seg):
            continue
        if _ONE.match(seg):  # ideographs and hiragana are words one by one
            spans += [(a + i, a + i + 1, "ideographic") for i in range(len(seg)) if _ALNUM.match(seg[i])]
        elif _IDEO.match(seg):
            spans.append((a, b, "ideographic"))
        else:
            spans.append((a, b, "numeric" if _NUM.match(seg) and not regex.search(r"\p{L}", seg) else "alphanum"))
    return tuple(spans)


def unicode_words(text: str) -> list[Token]:
    """Words by the Unicode text segmentation rules; segments without letters or digits go."""
    spans = []
    for m in _SPACED.finditer(text):
        chunk, at = m[0], m.start()
        if chunk.isascii() and chunk.isalpha():
            spans.append((at, m.end(), "alphanum"))
        elif len(chunk) > 256:
            spans += [(at + a, at + b, t) for a, b, t in _segments.__wrapped__(chunk)]
        else:
            spans += [(at + a, at + b, t) for a, b, t in _segments(chunk)]
    return _spans(text, spans)


def pattern_tokens(pattern: str) -> Tokenizer:
    rx = regex.compile(pattern)

    def kind(s: str) -> str:
        return "ideographic" if _ONE.match(s) else "numeric" if s.isdigit() else "alphanum"

    return lambda text: _spans(text, [(m.start(), m.end(), kind(m[0])) for m in rx.finditer(text) if m[0]])


def character_tokens(accept: Callable[[str], bool]) -> Tokenizer:
    """Runs of accepted characters."""

    def run(text: str) -> list[Token]:
        spans, start = [], None
        for i, c in enumerate(text):
            if accept(c) and start is None:
                start = i
            elif not accept(c) and start is not None:
                spans.append((start, i, "alphanum"))
                start = None
        if start is not None:
            spans.append((start, len(text), "alphanum"))
        return _spans(text, spans)

    return run


letters = pattern_tokens(r"\p{L}+")
not_space = pattern_tokens(r"\S+")


def single(text: str) -> list[Token]:
    return _spans(text, [(0, len(text), "alphanum")])


def exceptions(pattern: str, rest: Tokenizer) -> Tokenizer:
    """Matches of the pattern are kept whole; what lies between goes to another tokenizer."""
    rx = regex.compile(pattern)

    def run(text: str) -> list[Token]:
        out, at, byte = [], 0, 0

        def between(upto: int) -> None:
            for t in rest(text[at:upto]):
                out.append(t._replace(start=t.start + byte, end=t.end + byte))

        for m in rx.finditer(text):
            if not m[0]:
                continue
            between(m.start())
            start = byte + len(text[at : m.start()].encode())
            out.append(Token(m[0], start, start + len(m[0].encode())))
            at, byte = m.end(), out[-1].end
        between(len(text))
        return out

    return run


WEB = (
    r"(?i)[a-z0-9._%+\-]+@[a-z0-9.\-]+\.[a-z]{2,}"
    r"|(?:https?://|ftp://|www\.)[^\s<>\"'(){}]*[^\s<>\"'(){}.,;:!?]"
    r"|[@#][\p{L}\p{N}_]+"
)
web_words = exceptions(WEB, unicode_words)

# --- token filters -------------------------------------------------------------------------


def each(change: Callable[[str], str], keywords: bool = False) -> Filter:
    """A change of every term; keywords=True leaves those marked as keywords alone."""
    plain, change = change, lru_cache(100_000)(change)

    def run(tokens: list[Token]) -> list[Token]:
        out = []
        for t in tokens:
            term = t[0] if keywords and t.keyword else change(t[0])
            out.append(t if term == t[0] else Token(term, *t[1:]))
        return out

    run.word = plain
    return run


def dropping(keep: Callable[[Token], bool]) -> Filter:
    """Dropped tokens leave their increments to the next one kept."""

    def run(tokens: list[Token]) -> list[Token]:
        out, carry = [], 0
        for t in tokens:
            if keep(t):
                out.append(t._replace(incr=t.incr + carry) if carry else t)
                carry = 0
            else:
                carry += t.incr
        return out

    return run


lower = each(str.lower)


def stop(words: Iterable[str]) -> Filter:
    words = frozenset(words)
    run = dropping(lambda t: t.term not in words)
    run.word = lambda w: None if w in words else w
    return run


def length(least: int = 0, most: int = 0) -> Filter:
    """Characters of a term; 0 is no limit."""
    return dropping(lambda t: len(t.term) >= least and (not most or len(t.term) <= most))


def truncate(n: int) -> Filter:
    return each(lambda s: s[:n])


def _grams(tokens: list[Token], cut: Callable[[str], Iterable[str]]) -> list[Token]:
    out = []
    for t in tokens:
        for k, g in enumerate(cut(t.term)):
            out.append(t._replace(term=g, incr=0 if k else 1))
    return out


def ngrams(least: int, most: int) -> Filter:
    def cut(s: str):
        return (s[i : i + n] for i in range(len(s)) for n in range(least, most + 1) if i + n <= len(s))

    return lambda tokens: _grams(tokens, cut)


def edge_ngrams(least: int, most: int, back: bool = False) -> Filter:
    def cut(s: str):
        return (s[len(s) - n :] if back else s[:n] for n in range(least, most + 1) if n <= len(s))

    return lambda tokens: _grams(tokens, cut)


def shingles(least: int, most: int, original: bool = True, sep: str = " ", fill: str = "_") -> Filter:
    """Word n-grams ending at each word; a gap in the positions counts as filler words."""

    def run(tokens: list[Token]) -> list[Token]:
        out, line = [], []
        for t in tokens:
            if original:
                out.append(t)
            for x in [None] * (t.incr - 1) + [t]:  # None: a filler
                line = [*line, x][-most:]
                later = original
                for n in range(least, len(line) + 1):
                    part = [p for p in line[-n:] if p]
                    term = sep.join(p.term if p else fill for p in line[-n:])
                    out.append(Token(term, part[0].start if part else 0, part[-1].end if part else 0, 0 if later else 1, "shingle"))
                    later = True
        return out

    return run


def reverse_term(s: str) -> str:
    return "".join(reversed(regex.findall(r"(?s:.)\p{M}*", s)))


reverse = each(reverse_term)


def unique(tokens: list[Token]) -> list[Token]:
    seen: set[str] = set()
    return dropping(lambda t: not (t.term in seen or seen.add(t.term)))(tokens)


def normalise(form: str) -> Filter:
    return each(lambda s: unicodedata.normalize(form, s))


apostrophe = each(lambda s: re.split("['’]", s, maxsplit=1)[0])


def elision(articles: Iterable[str]) -> Filter:
    articles = frozenset(articles)

    def cut(s: str) -> str:
        m = re.match("([^'’]*)['’]", s)
        return s[m.end() :] if m and m[1].lower() in articles else s

    return each(cut)


possessive = each(lambda s: s[:-2] if len(s) > 1 and s[-2] in "'’＇" and s[-1] in "sS" else s)


def keyword_marker(words: Iterable[str]) -> Filter:
    words = frozenset(words)
    return lambda tokens: [t._replace(keyword=True) if t.term in words else t for t in tokens]


def camel_case(tokens: list[Token]) -> list[Token]:
    """Runs of lower case (with one capital before), capitals, digits and others."""
    out = []
    for t in tokens:
        at = t.start
        for k, p in enumerate(CAMEL.findall(t.term)):
            size = len(p.encode())
            out.append(Token(p, at, at + size, t.incr if not k else 1, t.type, t.keyword))
            at += size
    return out


CAMEL = regex.compile(r"\p{Lu}+(?=\p{Lu}\p{Ll})|\p{Lu}?\p{Ll}+|\p{Lu}+|\p{N}+|[^\p{Lu}\p{Ll}\p{N}]+")


def compounds(words: Iterable[str], least_word: int = 5, least: int = 2, most: int = 15, longest_only: bool = False) -> Filter:
    """Dictionary words inside a term, at the same position."""
    words = frozenset(words)

    def run(tokens: list[Token]) -> list[Token]:
        out = []
        for t in tokens:
            out.append(t)
            if len(t.term) < least_word:
                continue
            for i in range(len(t.term) - least + 1):
                found = [t.term[i : i + n] for n in range(least, most + 1) if i + n <= len(t.term) and t.term[i : i + n] in words]
                for w in found[-1:] if longest_only else found:
                    start = t.start + len(t.term[:i].encode())
                    out.append(Token(w, start, start + len(w.encode()), 0, t.type))
        return out

    return run


def read_words(text: str) -> set[str]:
    """A word list, one a line; # and | begin comments."""
    return {w for line in text.splitlines() if (w := re.split("[#|]", line)[0].strip())}


_WIDE = {c: chr(c - 0xFEE0) for c in range(0xFF01, 0xFF5F)} | {0x3000: " "}


def fold_width(s: str) -> str:
    """Full-width ASCII to ASCII, half-width katakana to full width."""
    return unicodedata.normalize("NFC", "".join(
        _WIDE.get(ord(c)) or (unicodedata.normalize("NFKC", c) if 0xFF65 <= ord(c) <= 0xFF9F else c) for c in s
    ).replace("\u3099", "゙").replace("\u309a", "゚")) if s and not s.isascii() else s


width = each(fold_width)


def cjk_bigrams(unigrams: bool = False) -> Filter:
    """Neighbouring ideographs as overlapping pairs; a lone one stays single."""

    def run(tokens: list[Token]) -> list[Token]:
        chars: list[Token] = []
        out: list[Token] = []

        def flush() -> None:
            if len(chars) == 1 and not unigrams:
                out.append(chars[0]._replace(type="single"))
            for i, c in enumerate(chars):
                if unigrams:
                    out.append(c._replace(type="single"))
                if i + 1 < len(chars):
                    d = chars[i + 1]
                    out.append(Token(c.term + d.term, c.start, d.end, 0 if unigrams else c.incr, "double"))
            chars.clear()

        for t in tokens:
            if t.type != "ideographic":
                flush()
                out.append(t)
                continue
            if chars and (chars[-1].end != t.start or t.incr != 1):
                flush()
            at = t.start
            for k, c in enumerate(t.term):
                size = len(c.encode())
                chars.append(Token(c, at, at + size, t.incr if not k else 1, t.type))
                at += size
        flush()
        return out

    run.word = lambda w: w
    return run


# --- analysers -----------------------------------------------------------------------------


@dataclass(frozen=True)
class Analyzer:
    tokenizer: Tokenizer
    filters: Sequence[Filter] = ()
    chars: Sequence[Callable[[str], str]] = ()

    def __call__(self, text: str) -> list[Token]:
        for c in self.chars:
            text = c(text)
        tokens = self.tokenizer(text)
        for f in self.filters:
            tokens = f(tokens)
        return tokens


def positions(tokens: list[Token], start: int = 0) -> list[int]:
    out = []
    for t in tokens:
        start += t.incr
        out.append(start)
    return out


#: Ideographs that normalisation may make longer, in bytes: the offsets after them don't hold.
_GROWING = re.compile("[\uf900-\ufaff\U0002f800-\U0002fa1f]")


#: One word of simple letters between ASCII marks that join nothing to it.
_PLAIN = re.compile("[!-\"$-/:-?\\[-^`{-~]*([A-Za-zÀ-ÖØ-öø-ɏЀ-ҁ]+)[!-/:-@\\[-^`{-~]*")
_LINK = ("www", "http", "https", "ftp")


Chunk = tuple[tuple[str, ...], tuple[int, ...], int]


class ByChunk:
    """An analyser of words none of whose filters looks across white space, stretch by stretch.

    Stretches without white space recur, so that most are looked up. A filter with a function `word`
    does by it what it does to a lone word of letters (None: it drops it).
    """

    KEPT = 200_000

    def __init__(self, analyze: Analyzer):
        self.analyze, self.chars = analyze, analyze.chars
        self.kept: dict[str, Chunk] = {}
        found = [getattr(f, "word", None) for f in analyze.filters]
        self.steps = None if None in found else found

    def of(self, chunk: str) -> Chunk:
        """Terms, their positions in the chunk, and how far it moves on those after it."""
        found = self.kept.get(chunk)
        if found is None:
            found = self._plain(chunk) or self._of(chunk)
            if len(chunk) <= 256:
                if len(self.kept) >= self.KEPT:
                    self.kept.clear()
                self.kept[chunk] = found
        return found

    def _plain(self, chunk: str) -> Chunk | None:
        m = _PLAIN.fullmatch(chunk) if self.steps is not None else None
        if m is None or m[1].lower().endswith(_LINK):
            return None
        word = m[1]
        for step in self.steps:
            word = step(word)
            if word is None:
                return (), (), 1
        return (word,), (1,), 1

    def _of(self, chunk: str) -> Chunk:
        found = self.analyze.tokenizer(f"{chunk} 0")  # the 0 takes over the increments of what is dropped before it
        for f in self.analyze.filters:
            found = f(found)
        at = positions(found)
        return tuple(t.term for t in found[:-1]), tuple(at[:-1]), at[-1] - 1

    def chunks(self, text: str) -> list[str]:
        for c in self.chars:
            text = c(text)
        return [text] if not text.isascii() and _GROWING.search(text) else _SPACED.findall(text)

    def counts(self, text: str) -> dict[str, int]:
        """Occurrences by term; a chunk is looked up once a text."""
        out: dict[str, int] = {}
        kept = self.kept
        for chunk, n in Counter(self.chunks(text)).items():
            for t in (kept.get(chunk) or self.of(chunk))[0]:
                out[t] = out.get(t, 0) + n
        return out


def frequencies(tokens: list[Token]) -> dict[str, list[tuple[int, int, int]]]:
    """Term to its (position, start, end) occurrences."""
    out: dict[str, list[tuple[int, int, int]]] = {}
    for t, p in zip(tokens, positions(tokens)):
        out.setdefault(t.term, []).append((p, t.start, t.end))
    return out
