"""Personal data to format-preserving Feistel pseudonyms.

Numbers are taken only if they validate: payment cards (Luhn), IBANs (mod 97), IPv4 addresses
(octets), telephone and social-security numbers (their numbering plans; the usual French, German and
Spanish groupings too), dates (the calendar; months as names, and years of two digits as 1930 to 2029).
E-mail local parts and long hexadecimal secrets keep their character classes. Each value is
an integer of its format's domain; a keyed Feistel network permutes that domain, walking its
cycle until the result is valid again, and check digits are recomputed. A format's domain is what is
read as this format, both ways: a date's has its widths, its order of day and month and its range of
years (to 999, to 1899, to 2099, later), a phone's its layout and whether it fits the North American
plan. So a pseudonym looks like what it replaces, has its length, and equal values get equal
pseudonyms in all documents (a card with or without separators too), while distinct ones stay
distinct and the key restores them.

There is no default key: who has the key can restore. secret_key() gives a session's.

Defined results: a null text stays null with n_pii 0, an empty one empty; every other column
of the input passes through as it is, whatever its name (n_pii and pii_kinds in any case are replaced
if the report is wanted); rows may repeat; an empty table gives no rows. The text column is the one of
exactly the name given, else the only one in another case. One narrow pass; only texts that a JVM
pattern finds suspicious reach Python, and these whole.
"""

from __future__ import annotations

import hashlib
import re
import secrets
from datetime import date
from math import isqrt

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import numbered, place, without

ROUNDS = 8
# Whatever can hold personal data: an address sign, seven or more digits with separators, a
# date or dotted quad, an account number, a long hexadecimal run.
SUSPECT = (
    r"@|\d[\d .()/\-]{5,}\d|\d{1,4}[-/.]\d{1,2}[-/.]\d{1,4}|[0-9a-fA-F]{32}|[A-Z]{2}\d{2} ?[A-Z0-9]{4}"
)
MONTHS = (
    "January February March April May June July August September October November December".split(),
    "Jan Feb Mar Apr May Jun Jul Aug Sep Oct Nov Dec".split(),
    "Januar Februar März April Mai Juni Juli August September Oktober November Dezember".split(),
    "janvier février mars avril mai juin juillet août septembre octobre novembre décembre".split(),
    "enero febrero marzo abril mayo junio julio agosto septiembre octubre noviembre diciembre".split(),
)
# Of a name in several lists the first counts.
LIST_OF = {m.lower(): names for names in reversed(MONTHS) for m in names}
_NAMES = "|".join(sorted(LIST_OF, key=lambda m: (-len(m), m)))
_DAY = r"\d{1,2}(?:\.|st|nd|rd|th|er|º)?"
SUSPECT += rf"| [12]\d\d\d(?<=(?iu:{_NAMES})\.?(?: del?| \d{{1,2}}(?:st|nd|rd|th)?)?,? \d{{4}})"
PARTS = {
    "email": r"(?<![\w.+-])[A-Za-z0-9][\w.+-]*@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)*\.[A-Za-z]{2,}",
    "iban": r"\b[A-Z]{2}\d{2}(?: ?[A-Z0-9]{4}){2,7}(?: ?[A-Z0-9]{1,4})?\b",
    "secret": r"(?<![0-9A-Za-z])(?=[0-9a-fA-F]*\d)(?:[0-9a-f]{32,}|[0-9A-F]{32,})(?![0-9A-Za-z])",
    "ip": r"(?<![\d.])\d{1,3}(?:\.\d{1,3}){3}(?![\d]|\.\d)",
    "date": r"(?<![\d/.-])(?:\d{4}(?P<s1>[-/.])\d{1,2}(?P=s1)\d{1,2}|\d{1,2}(?P<s2>[-/.])\d{1,2}(?P=s2)\d{4}"
    # Years of two digits: with dots and dashes only if day and month have two as well.
    r"|\d{1,2}/\d{1,2}/\d\d|\d\d(?P<s3>[-.])\d\d(?P=s3)\d\d)(?![\d]|[-/.]\d)"
    rf"|(?<![\w/.-])(?i:{_DAY}(?: de| of)? (?:{_NAMES})\.?(?: del?)?,? [12]\d\d\d"
    rf"|(?:{_NAMES})\.? \d{{1,2}}(?:st|nd|rd|th)?,? [12]\d\d\d)(?![\w])",
    "ssn": r"(?<![\d-])\d{3}-\d{2}-\d{4}(?![\d-])",
    "phone": r"(?<![\w+])(?:\+\d{1,3}[ .-]?)?(?:\(\d{2,4}\)[ .-]?|\d{2,4}[ .-])\d{3}[ .-]\d{4}(?!\d)"
    r"|(?<![\w+])\+\d{1,3}[ .-]?(?:\(0\)[ .-]?)?\d{1,4}(?:[ .-]?\d{2,4}){1,5}(?!\d)"
    # National: a trunk 0 and pairs (French), an area code and the rest (German), nine digits (Spanish).
    r"|(?<![\w+])(?<!\d[ .-])(?:0[1-9](?:[ .-]?\d\d){4}|(?:0[1-9]\d{1,3}|\(0[1-9]\d{1,3}\))(?: ?[/-] ?| )\d{2,8}(?:[ -]\d{2,8}){0,3}"
    r"|[6-9]\d\d(?P<s4>[ -])\d{3}(?P=s4)\d{3}|[6-9]\d\d(?P<s5>[ -])\d\d(?P=s5)\d\d(?P=s5)\d\d"
    r"|9\d(?P<s6>[ -])\d{3}(?P=s6)\d\d(?P=s6)\d\d)(?![ .-]?\d)",
    "card": r"(?<![\d-])\d(?:[ -]?\d){12,18}(?![\d-]*\d)",
}
# Digits are those of ASCII, as on the JVM.
PARTS = {k: p.replace(r"[\d", "[0-9").replace(r"\d", "[0-9]") for k, p in PARTS.items()}
PATTERN = re.compile("|".join(f"(?P<{k}>{p})" for k, p in PARTS.items()))
ALONE = {k: re.compile(p) for k, p in PARTS.items()}
KINDS = tuple(PARTS)
NATIONAL = re.compile(PARTS["phone"][PARTS["phone"].rindex(r"(?<![0-9][ .-])") :])
# The characters of an IBAN by country.
IBAN_LENGTHS = {
    country: n
    for n, countries in {
        15: "NO", 16: "BE", 18: "DK FI FK FO GL NL SD", 19: "MK SI", 20: "AT BA EE KZ LT LU MN XK", 21: "CH HR LI LV",
        22: "BG BH CR DE GB GE IE ME RS VA", 23: "AE GI IL IQ OM SO TL", 24: "AD CZ ES MD PK RO SA SE SK TN VG",
        25: "LY PT ST", 26: "IS TR", 27: "BI DJ FR GR IT MC MR SM", 28: "AL AZ BY CY DO GT HN HU LB NI PL SV",
        29: "BR EG PS QA UA", 30: "JO KW MU YE", 31: "MT SC", 32: "LC", 33: "RU",
    }.items()
    for country in countries.split()
}
# Dates stay in their range of years.
ERAS = [(date(a, 1, 1).toordinal(), date(z, 12, 31).toordinal()) for a, z in ((1, 999), (1000, 1899), (1900, 2099), (2100, 9999))]


class Feistel:
    """A keyed permutation of range(n) for any n and tweak."""

    def __init__(self, key: bytes):
        self.key = hashlib.blake2b(key, digest_size=32).digest()

    def turn(self, tweak: bytes, i: int, half: int, n: int) -> int:
        data = half.to_bytes((half.bit_length() + 7) // 8 or 1, "big")
        h = hashlib.blake2b(b"%d|%s|%d|" % (i, tweak, n) + data, key=self.key).digest()
        return int.from_bytes(h, "big") % n

    def permute(self, x: int, n: int, tweak: bytes, back: bool = False) -> int:
        if n < 2:
            return x
        a = isqrt(n - 1) + 1  # a * b >= n, and little more
        b = -(-n // a)
        while True:
            left, right = divmod(x, b)
            if not back:
                for i in range(0, ROUNDS, 2):
                    left = (left + self.turn(tweak, i, right, a)) % a
                    right = (right + self.turn(tweak, i + 1, left, b)) % b
            else:
                for i in reversed(range(0, ROUNDS, 2)):
                    right = (right - self.turn(tweak, i + 1, left, b)) % b
                    left = (left - self.turn(tweak, i, right, a)) % a
            x = left * b + right
            if x < n:  # else walk on along the cycle
                return x

    def valid(self, x: int, n: int, tweak: bytes, ok, back: bool = False) -> int:
        """Permutes the values that satisfy ok among themselves."""
        x = self.permute(x, n, tweak, back)
        while not ok(x):
            x = self.permute(x, n, tweak, back)
        return x


def luhn_digit(body: str) -> str:
    total = 0
    for i, c in enumerate(reversed(body)):
        d = int(c) * (2 - i % 2)
        total += d - 9 * (d > 9)
    return str(-total % 10)


def mod97(iban: str) -> int:
    return int("".join(str(int(c, 36)) for c in iban[4:] + iban[:4])) % 97


CLASSES = ("0123456789", "abcdefghijklmnopqrstuvwxyz", "ABCDEFGHIJKLMNOPQRSTUVWXYZ")


def classes(text: str, alphabets=CLASSES) -> list[str | None]:
    return [next((a for a in alphabets if c in a), None) for c in text]


def to_int(text: str, kinds) -> tuple[int, int]:
    x, n = 0, 1
    for c, a in zip(text, kinds):
        if a:
            x, n = x * len(a) + a.index(c), n * len(a)
    return x, n


def from_int(x: int, text: str, kinds) -> str:
    out = list(text)
    for i in reversed(range(len(out))):
        if a := kinds[i]:
            x, d = divmod(x, len(a))
            out[i] = a[d]
    return "".join(out)


class Pseudonyms:
    """Replaces every validated value of a text. back=True restores."""

    def __init__(self, key: bytes):
        self.feistel = Feistel(key)

    def by_class(self, text: str, tweak: bytes, back: bool, alphabets=CLASSES, ok=lambda s: True) -> str:
        kinds = classes(text, alphabets)
        x, n = to_int(text, kinds)
        return from_int(self.feistel.valid(x, n, tweak, lambda y: ok(from_int(y, text, kinds)), back), text, kinds)

    def email(self, s: str, back: bool) -> str | None:
        local, domain = s.rsplit("@", 1)
        # Upper and lower case link to the same pseudonym: the case of each letter stays.
        low = "".join(c.lower() if c.isascii() else c for c in local)
        done = self.by_class(low, b"email|" + domain.lower().encode(), back)
        return "".join(d.upper() if c.isascii() and c.isupper() else d for c, d in zip(local, done)) + "@" + domain

    def secret(self, s: str, back: bool) -> str | None:
        upper = s != s.lower()
        digits = "0123456789ABCDEF" if upper else "0123456789abcdef"

        def ok(x: str) -> bool:  # has a digit, and in capitals a letter, as what is read has
            return any(c.isdigit() for c in x) and (not upper or any(c.isalpha() for c in x))

        return self.by_class(s, b"secret|%d" % len(s), back, (digits,), ok)

    def iban(self, s: str, back: bool) -> str | None:
        bare = s.replace(" ", "")
        if len(bare) != IBAN_LENGTHS.get(bare[:2], len(bare)):
            return None
        if not 15 <= len(bare) <= 34 or mod97(bare) != 1 or not 2 <= int(bare[2:4]) <= 98:
            return None
        body = self.by_class(bare[4:], b"iban|" + bare[:2].encode(), back)
        check = f"{98 - mod97(bare[:2] + '00' + body):02d}"
        return spread(bare[:2] + check + body, s, str.isalnum)

    def ip(self, s: str, back: bool) -> str | None:
        parts = s.split(".")
        if any(int(p) > 255 or (len(p) > 1 and p[0] == "0") for p in parts):
            return None
        # Octets keep their widths: 0-9, 10-99 and 100-255 are the digits of a mixed radix.
        low = [(0, 10, 100)[len(p) - 1] for p in parts]
        size = [(10, 90, 156)[len(p) - 1] for p in parts]
        x, n = 0, 1
        for p, a, b in zip(parts, low, size):
            x, n = x * b + int(p) - a, n * b
        y = self.feistel.permute(x, n, b"ip", back)
        out = []
        for a, b in zip(reversed(low), reversed(size)):
            y, d = divmod(y, b)
            out.append(str(a + d))
        return ".".join(reversed(out))

    def day(self, day: int, ok, back: bool) -> int | None:
        """The day that takes this one's place among the days of its era that are ok."""
        first, last = next(e for e in ERAS if e[0] <= day <= e[1])
        if not ok(date.fromordinal(day)):
            return None
        return first + self.feistel.valid(day - first, last - first + 1, b"date", lambda d: ok(date.fromordinal(first + d)), back)

    def written(self, s: str, back: bool) -> str | None:
        """A date with the month's name: the result has one as long, of the same language."""
        name = re.search(rf"(?i)(?<![^\W\d_])(?:{_NAMES})(?![^\W\d_])", s)[0]
        names = LIST_OF[name.lower()]
        by_month = [m.lower() for m in names]
        first, year = (re.search(x, s) for x in (r"\d{1,2}(?!\d)", r"\d{4}"))
        suffix = re.match(r"(?i)st|nd|rd|th|er|$", s[first.end() :])
        suffix = suffix[0].lower() if suffix else ""
        try:
            day = date(int(year[0]), by_month.index(name.lower()) + 1, int(first[0])).toordinal()
        except ValueError:
            return None

        def ok(v: date) -> bool:
            m, n = by_month[v.month - 1], v.day
            english = "th" if n in (11, 12, 13) else {1: "st", 2: "nd", 3: "rd"}.get(n % 10, "th")
            right = not suffix or suffix == (("er" if n == 1 else "") if suffix == "er" else english)
            return 1000 <= v.year < 3000 and len(m) == len(name) and LIST_OF[m] is names and right and (len(first[0]) == 2 or n < 10)

        if (found := self.day(day, ok, back)) is None:
            return None
        v = date.fromordinal(found)
        month = by_month[v.month - 1]
        month = month.upper() if name.isupper() else month.capitalize() if name[0].isupper() else month
        out = s.replace(name, month, 1).replace(year[0], f"{v.year:04d}", 1)
        return out[: first.start()] + str(v.day).zfill(len(first[0])) + out[first.end() :]

    def date(self, s: str, back: bool) -> str | None:
        if re.search(r"[^\W\d_]", s):
            return self.written(s, back)
        sep = re.search(r"\D", s)[0]
        parts = s.split(sep)
        short = len(parts[0]) < 4 and len(parts[2]) == 2  # a year of two digits is one of 1930 to 2029
        full = lambda y: 1900 + y if y >= 30 else 2000 + y
        if len(parts[0]) == 4:
            orders = ((0, 1, 2),)
        else:
            orders = ((2, 1, 0), (2, 0, 1)) if sep != "/" else ((2, 0, 1), (2, 1, 0))
        for order in orders:
            try:
                day = date(*(full(int(parts[i])) if short and i == 2 else int(parts[i]) for i in order)).toordinal()
            except ValueError:
                continue

            def fields(v: date) -> list[int]:
                new = dict(zip(order, (v.year, v.month, v.day)))
                return [new[i] for i in range(3)]

            def ok(v: date) -> bool:
                # The result keeps the widths and is read in the same order.
                f = fields(v)
                if short and not 1930 <= f[2] < 2030:
                    return False
                if any(len(p) == 1 and x > 9 for p, x in zip(parts, f)):
                    return False
                return order == orders[0] or f[order[2]] > 12

            if (found := self.day(day, ok, back)) is None:
                return None
            return sep.join(str(v).zfill(4 if short and i == 2 else len(p))[-len(p) :] for i, (v, p) in enumerate(zip(fields(date.fromordinal(found)), parts)))
        return None

    def ssn(self, s: str, back: bool) -> str | None:
        def ok(x: int) -> bool:
            area, group, serial = x // 10**6, x // 10**4 % 100, x % 10**4
            return 0 < area < 900 and area != 666 and group > 0 and serial > 0

        x = int(s.replace("-", ""))
        if not ok(x):
            return None
        return spread(f"{self.feistel.valid(x, 10**9, b'ssn', ok, back):09d}", s, str.isdigit)

    def phone(self, s: str, back: bool) -> str | None:
        digits = re.sub(r"\D", "", s)
        code = ""
        if s[0] == "+":
            # The country code stays; without a separator the first digit stands for it.
            lead = re.match(r"\+(\d{1,3})(?=\D)", s)
            code = lead[1] if lead else digits[0]
        elif NATIONAL.fullmatch(s):
            # The trunk 0, or the first digit of nine, stays: it tells the layout.
            code = digits[0]
            if code == "0" and not 9 <= len(digits) <= 12:
                return None
        trunk = code == "0" and s[0] != "+"
        rest = digits[len(code) :]
        n = len(rest)
        if not 7 <= n <= 14 or len(digits) > 15 or (trunk and rest[0] == "0"):
            return None
        national = bool(NATIONAL.fullmatch(s))
        in_plan = lambda x: n == 10 and not trunk and x // 10**9 > 1 and x // 10**6 % 10 > 1
        plan = in_plan(int(rest))

        def written(x: int) -> str:
            return spread(code + f"{x:0{n}d}", s, lambda c: "0" <= c <= "9")

        def ok(x: int) -> bool:
            # Read again, it is national or not, and in the North American plan or not, as before.
            return (not trunk or x >= 10 ** (n - 1)) and in_plan(x) == plan and bool(NATIONAL.fullmatch(written(x))) == national

        return written(self.feistel.valid(int(rest), 10**n, b"phone|%d|%d" % (n, plan), ok, back))

    def card(self, s: str, back: bool) -> str | None:
        digits = re.sub(r"\D", "", s)
        if luhn_digit(digits[:-1]) != digits[-1] or len(set(digits)) == 1:
            return None
        n = len(digits) - 1
        repeats = {int(str(d) * n) for d in range(10) if luhn_digit(str(d) * n) == str(d)}
        body = f"{self.feistel.valid(int(digits[:-1]), 10**n, b'card|%d' % n, lambda x: x not in repeats, back):0{n}d}"
        return spread(body + luhn_digit(body), s, str.isdigit)

    def replace(self, text: str, back: bool = False) -> tuple[str, list[str]]:
        """The text with every value replaced, and the kinds of the values in their order."""
        kinds: list[str] = []

        def one(kind: str, found: str) -> tuple[str, str] | None:
            """What a match, or of an IBAN the part that validates, was and becomes."""
            ends = [len(found)]
            if kind == "iban":
                ends += [m.end() for m in re.finditer(r"[A-Z0-9](?![A-Z0-9])", found)][-2::-1]
            for end in ends:
                if (new := getattr(self, kind)(found[:end], back)) is not None:
                    return found[:end], new
            return None

        out, at = [], 0
        while m := PATTERN.search(text, at):
            kind, end, done = next(k for k in KINDS if m[k] is not None), m.end(), None
            for other in KINDS[KINDS.index(kind) :]:  # what isn't valid as one kind may be as another
                if (hit := m if other == kind else ALONE[other].match(text, m.start())) and (done := one(other, hit[0])):
                    break
            out.append(text[at : m.start()])
            if done:
                kinds.append(other)
                out.append(done[1])
                at = m.start() + len(done[0])
            else:
                out.append(text[m.start() : end])
                at = end
        return "".join(out) + text[at:], kinds


def spread(chars: str, like: str, mine) -> str:
    """chars put where `like` has characters of its kind, separators kept."""
    it = iter(chars)
    return "".join(next(it) if mine(c) else c for c in like)


def secret_key(spark: SparkSession) -> bytes:
    """The key in spark.inkwell.pseudonym.secret (Spark redacts settings of such names in its logs).

    Where none is set, a random one is made for the session: its results can't be restored later.
    """
    name = "spark.inkwell.pseudonym.secret"
    key = spark.conf.get(name, None)
    if not key:
        key = secrets.token_hex(32)
        spark.conf.set(name, key)
    return key.encode()


def pseudonymise(docs: DataFrame, key: bytes, text_col: str = "text", report: bool = True) -> DataFrame:
    """docs with pseudonyms in text_col; report: also n_pii and pii_kinds (in order of appearance)."""
    if not key:
        raise ValueError("an empty key protects nothing")

    @F.arrow_udf("struct<text:string,kinds:array<string>>")
    def replaced(text: pa.Array) -> pa.Array:
        p = Pseudonyms(key)
        done = [None if t is None else p.replace(t) for t in text.to_pylist()]
        return pa.StructArray.from_arrays(
            [
                pa.array([d and d[0] for d in done], pa.string()),
                pa.array([d and d[1] for d in done], pa.list_(pa.string())),
            ],
            names=["text", "kinds"],
        )

    at = place(docs, text_col)
    text = F.col(at).cast("string")
    # Only suspects are sent: the others travel as nulls.
    out = numbered(docs).select("*", replaced(F.when(text.rlike(SUSPECT), text)).alias("new"))
    names = docs.columns
    kept = [i for i in (without(names, ("n_pii", "pii_kinds")) if report else range(len(names)))]
    columns = [F.coalesce("new.text", text).alias(at) if f"c{i}" == at else F.col(f"c{i}") for i in kept]
    names = [names[i] for i in kept]
    if report:
        columns += [F.coalesce(F.size("new.kinds"), F.lit(0)), F.coalesce("new.kinds", F.array().cast("array<string>"))]
        names += ["n_pii", "pii_kinds"]
    return out.select(*columns).toDF(*names)
