"""Pseudonyms, license scans and telephony against independent checks."""

import datetime as dt
import random
import re
import struct
import textwrap
from difflib import SequenceMatcher

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from inkwell.llm import licenses, pseudonyms, telephony
from inkwell.llm.pseudonyms import Feistel, Pseudonyms, luhn_digit, mod97, pseudonymise

P = Pseudonyms(b"test key")


@pytest.mark.parametrize("n", [1, 2, 3, 10, 97, 1000, 4097])
def test_feistel_permutes(n):
    f = Feistel(b"k")
    out = [f.permute(x, n, b"t") for x in range(n)]
    assert sorted(out) == list(range(n))
    assert [f.permute(y, n, b"t", back=True) for y in out] == list(range(n))


@given(st.integers(2, 10**30), st.data())
@settings(max_examples=100, deadline=None)
def test_feistel_inverts(n, data):
    x = data.draw(st.integers(0, n - 1))
    y = P.feistel.permute(x, n, b"w")
    assert 0 <= y < n and P.feistel.permute(y, n, b"w", back=True) == x


VALUES = {
    "card": ["4111 1111 1111 1111", "4111111111111111", "5500-0000-0000-0004", "378282246310005"],
    "iban": ["GB82 WEST 1234 5698 7654 32", "DE89370400440532013000"],
    "ip": ["8.196.197.208", "10.0.0.1"],
    "phone": ["+1 (415) 555-0132", "415-555-0132", "+49 30 1234567"],
    "ssn": ["123-45-6789"],
    "date": ["2021-02-28", "28.02.2021", "12/31/1999", "31/12/1999", "1/2/2020"],
    "email": ["Jane.Doe42@mail.example.com"],
    "secret": ["9f86d081884c7d659a2feaa0c55ad015a3bf4f1b", "9F86D081884C7D659A2FEAA0C55AD015"],
}


@pytest.mark.parametrize("kind,value", [(k, v) for k, vs in VALUES.items() for v in vs])
def test_values_are_replaced_in_their_format(kind, value):
    text = f"before {value} after"
    new, kinds = P.replace(text)
    assert kinds == [kind] and value not in new and len(new) == len(text)
    shape = lambda s: re.sub("[a-z]", "a", re.sub("[A-Z]", "A", re.sub(r"\d", "9", s)))
    if kind != "secret":
        assert shape(new) == shape(text)
    assert P.replace(new, back=True) == (text, [kind])
    assert P.replace(f"other {value}.")[0] == f"other {new[7:-6]}."
    got = new[7:-6]
    digits = re.sub(r"\D", "", got)
    if kind == "card":
        assert luhn_digit(digits[:-1]) == digits[-1]
    if kind == "iban":
        assert mod97(got.replace(" ", "")) == 1
    if kind == "ip":
        assert all(int(x) < 256 for x in got.split("."))


MORE = {
    "phone": ["+33 6 12 34 56 78", "06 12 34 56 78", "01.23.45.67.89", "030 1234567", "030/1234567", "(030) 1234567", "0171 234 56 78", "612 345 678", "612 34 56 78", "91 123 45 67"],
    "date": ["12 March 1998", "March 12, 1998", "3rd May 2001", "12. März 1998", "1er mars 1998", "12 de marzo de 1998", "14 juillet 1989", "03/05/98", "13.05.98", "31 DECEMBER 1999"],
}


@pytest.mark.parametrize("kind,value", [(k, v) for k, vs in MORE.items() for v in vs])
def test_national_phones_and_written_dates(kind, value):
    text = f"before {value} after"
    new, kinds = P.replace(text)
    assert kinds == [kind] and value not in new and len(new) == len(text)
    assert P.replace(new, back=True) == (text, [kind])


def test_more_suspects_reach_python(spark):
    rows = [(v,) for vs in MORE.values() for v in vs]
    assert spark.createDataFrame(rows, "t string").where(~F.col("t").rlike(pseudonyms.SUSPECT)).collect() == []


@pytest.mark.parametrize("iban", ["ES91 2100 0418 4502 0005 1332", "BE68 5390 0754 7034", "AT61 1904 3002 3457 3201", "PL61 1090 1014 0000 0712 1981 2874"])
@pytest.mark.parametrize("next", ["BIC CAIXESBB", "EUR", "A 1", "GB82 WEST 1234 5698 7654 32"])
def test_words_after_ibans(iban, next):
    new, kinds = P.replace(f"{iban} {next}")
    assert kinds[0] == "iban" and iban not in new and mod97(new[: len(iban)].replace(" ", "")) == 1
    assert P.replace(new, back=True)[0] == f"{iban} {next}" and len(kinds) == 1 + next.startswith("GB")


def test_cards_link_across_separators():
    a, b = P.replace("4111 1111 1111 1111")[0], P.replace("4111111111111111")[0]
    assert a.replace(" ", "") == b


def test_padded_dates_link_across_formats():
    iso, dotted = P.replace("2021-02-28")[0], P.replace("28.02.2021")[0]
    assert dt.date.fromisoformat(iso) == dt.datetime.strptime(dotted, "%d.%m.%Y").date()


@pytest.mark.parametrize(
    "text", ["4111 1111 1111 1112", "1234567890123456", "999.1.1.1", "2021-02-30", "000-12-3456", "version 1.2", "ISBN 12345", "GB82 WEST 1234 5698 7654 33"]
)
def test_what_does_not_validate_stays(text):
    assert P.replace(text) == (text, [])


def random_dates(rng):
    y, m, d = rng.choice((rng.randint(1, 9999), rng.randint(1900, 2099))), rng.randint(1, 12), rng.randint(1, 28)
    pad = lambda x: f"{x:0{rng.choice((1, 2))}d}"
    sep = rng.choice("-/.")
    return rng.choice(
        (f"{y:04d}{sep}{pad(m)}{sep}{pad(d)}", f"{pad(d)}{sep}{pad(m)}{sep}{y:04d}", f"{pad(m)}{sep}{pad(d)}{sep}{y:04d}",
         f"{m:02d}.{d:02d}.{y % 100:02d}", f"{pad(d)} {rng.choice(pseudonyms.MONTHS[0] + pseudonyms.MONTHS[3])} {1000 + y % 2000}")
    )


def random_phones(rng):
    d = lambda n: "".join(rng.choices("0123456789", k=n))
    return rng.choice((f"{d(3)}-{d(3)}-{d(4)}", f"({d(3)}) {d(3)} {d(4)}", f"+{d(2)} {d(3)} {d(3)} {d(4)}", f"0{d(1)} {d(2)} {d(2)} {d(2)} {d(2)}", f"0{d(2)} {d(7)}", f"{d(3)} {d(3)} {d(3)}", f"+{d(11)}"))


def random_addresses(rng):
    return ".".join(str(rng.choice((rng.randrange(10), rng.randrange(100), rng.randrange(256)))) for _ in range(4))


def random_secrets(rng):
    return "".join(rng.choices(rng.choice(("0123456789abcdef", "0123456789ABCDEF", "0123456789")), k=rng.choice((32, 40))))


@pytest.mark.parametrize("make", [random_dates, random_phones, random_addresses, random_secrets])
def test_every_format_is_permuted(make):
    """Distinct in, distinct out; the layout stays; the key restores."""
    rng = random.Random(17)
    values = {make(rng) for _ in range(3000)}
    done = {v: P.replace(v) for v in values}
    taken = {v: new for v, (new, kinds) in done.items() if kinds}
    assert len(taken) > 0.3 * len(values) and sum(v != new for v, new in taken.items()) > 0.99 * len(taken)
    assert len(set(taken.values())) == len(taken)
    for v, new in taken.items():
        assert len(new) == len(v) and [c if not c.isalnum() else "x" for c in new] == [c if not c.isalnum() else "x" for c in v]
        assert P.replace(new, back=True) == (v, done[v][1])


@pytest.mark.parametrize("value", ["1899-12-31", "2100-01-01", "1/05/2015", "7/02/2018", "12 March 1850"])
def test_all_years_and_mixed_widths(value):
    new, kinds = P.replace(value)
    assert kinds == ["date"] and new != value and P.replace(new, back=True)[0] == value


def test_small_domains_are_permuted_whole():
    """All days of a narrow layout, all last octets: nothing collides, nothing leaves the layout."""
    days = [f"{m}/{d}/19{y:02d}" for y in range(100) for m in range(1, 10) for d in range(1, 10)]
    new = {P.replace(v)[0] for v in days}
    assert len(new) == len(days) and all(re.fullmatch(r"\d/\d/\d{4}", v) for v in new)
    hosts = [f"1.2.3.{i}" for i in range(256)]
    assert len({P.replace(h)[0] for h in hosts}) == 256


def test_columns_of_any_name_pass(spark):
    names = ["doc_id", "TEXT", "__new", "new", "N_PII", "c0", "a.b", "text.kinds"]
    df = spark.createDataFrame([(1, "mail jane@example.com", 2, 3, 4, 5, 6, 7)], "a int, b string, c int, d int, e int, f int, g int, h int").toDF(*names)
    row = pseudonymise(df, b"k").first()
    assert row.n_pii == 1 and "jane" not in row.TEXT and row[2:4] == (2, 3)
    assert pseudonymise(df, b"k").columns == [n for n in names if n != "N_PII"] + ["n_pii", "pii_kinds"]
    kept = pseudonymise(df, b"k", report=False)
    assert kept.columns == names and kept.first()[2:] == (2, 3, 4, 5, 6, 7) and "jane" not in kept.first()[1]
    both = spark.createDataFrame([("a@example.com", "b@example.com")], "x string, y string").toDF("text", "TEXT")
    row = pseudonymise(both, b"k", report=False).first()
    assert row[0] != "a@example.com" and row[1] == "b@example.com"
    with pytest.raises(ValueError):
        pseudonymise(df, b"")


def test_keys(spark):
    key = pseudonyms.secret_key(spark)
    assert key == pseudonyms.secret_key(spark) and len(key) >= 32
    assert Pseudonyms(b"other").replace("10.0.0.1") != P.replace("10.0.0.1")


def test_distinct_values_stay_distinct():
    rng = random.Random(1)
    cards = {b + luhn_digit(b) for b in ("%015d" % rng.randrange(10**15) for _ in range(500))}
    assert len({P.replace(c)[0] for c in cards}) == len(cards)


def test_pseudonymise_table(odd, none, nameless):
    new = pseudonymise(odd, key=b"test key")
    assert new.columns == [c for c in odd.columns if c != "n_pii"] + ["n_pii", "pii_kinds"]
    rows = {r.doc_id: r for r in new.collect()}
    for r in odd.collect():
        want = (None, []) if r.text is None else P.replace(r.text)
        assert (rows[r.doc_id].text, rows[r.doc_id].pii_kinds) == want
        assert rows[r.doc_id]["a.b"] == r["a.b"] and rows[r.doc_id].n_pii == len(want[1])
    assert rows[7].n_pii == 2
    assert pseudonymise(none, b"k").count() == 0 and pseudonymise(nameless, b"k").count() == 3


def test_jvm_suspects_miss_nothing(spark):
    rows = [(v,) for vs in VALUES.values() for v in vs]
    got = spark.createDataFrame(rows, "t string").where(F.col("t").rlike(pseudonyms.SUSPECT)).count()
    assert got == len(rows)


# --- licenses ------------------------------------------------------------------------------

MIT_FILE = """MIT License

Copyright (c) 2021 Somebody

Permission is hereby granted, free of charge, to any person obtaining a copy
of this software and associated documentation files (the "Software"), to deal
in the Software without restriction, including without limitation the rights
to use, copy, modify, merge, publish, distribute, sublicense, and/or sell
copies of the Software, and to permit persons to whom the Software is
furnished to do so, subject to the following conditions:

The above copyright notice and this permission notice shall be included in all
copies or substantial portions of the Software.

THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR
IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY,
FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE
AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER
LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM,
OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE
SOFTWARE.
"""
GPL_HEADER = """/*
 * This file is part of something.
 *
 * This program is free software: you can redistribute it and/or modify
 * it under the terms of the GNU General Public License as published by
 * the Free Software Foundation, either version 3 of the License, or
 * (at your option) any later version.
 */
int main() { return 0; }
"""
APACHE_HEADER = """# Licensed under the Apache License, Version 2.0 (the "License");
# you may not use this file except in compliance with the License.
# You may obtain a copy of the License at
#
#     http://www.apache.org/licenses/LICENSE-2.0
#
# Unless required by applicable law or agreed to in writing, software
# distributed under the License is distributed on an "AS IS" BASIS,
# WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied.
# See the License for the specific language governing permissions and
# limitations under the License.
"""


def wrapped(name, lead="", width=72):
    """A template broken into lines, with a blank line before its longer sentences."""
    text = next(t for n, _, t in licenses.default_templates() if n == name)
    parts = re.split(r"(?<=[.:]) (?=[A-Z])", text)
    return "\n\n".join(textwrap.fill(p, width, initial_indent=lead, subsequent_indent=lead) for p in parts)


@pytest.mark.parametrize(
    "text,license",
    [
        (MIT_FILE, "MIT"), (GPL_HEADER, "GPL-3.0"), (APACHE_HEADER, "Apache-2.0"),
        (wrapped("ISC/full", "// "), "ISC"), (wrapped("MPL-2.0/header", " * "), "MPL-2.0"), (wrapped("BSD-2-Clause/full"), "BSD-2-Clause"),
        (wrapped("BSD-3-Clause/full", "# "), "BSD-3-Clause"), (wrapped("EPL-2.0/header"), "EPL-2.0"), (wrapped("Unlicense/notice"), "Unlicense"),
        (wrapped("LGPL-2.1/header-library", "; "), "LGPL-2.1"), (wrapped("AGPL-3.0/header"), "AGPL-3.0"), (wrapped("Zlib/notice"), "Zlib"),
        ("// SPDX-License-Identifier: MIT\nint x;", "MIT"),
        ("This work is licensed under a Creative Commons Attribution 4.0 International License.", "CC-BY-4.0"),
        ("This work is licensed under a Creative Commons Attribution-ShareAlike 3.0 Unported License.", "CC-BY-SA-3.0"),
    ],
)
def test_licenses_as_they_are_written(text, license):
    scanner = licenses.Scanner(licenses.default_templates(), 3)
    for t in (text, f"Some prose comes before.\n\n{text}\n\nand after."):
        assert {r[3] for r in scanner.scan(t, 0.1, 0.1)} - {None} == {license}


def test_ranking_by_brute_force():
    """The rank of every template by compressing with each dictionary, one at a time."""
    import zstandard as z

    templates = licenses.default_templates()
    scanner = licenses.Scanner(templates, 3)
    for block in (MIT_FILE, GPL_HEADER, "Released under the MIT License.", "all about licences and dogs"):
        data = licenses.Scanner.form(block)
        params = z.ZstdCompressionParameters.from_level(3, write_content_size=False, write_dict_id=False)
        alone = len(z.ZstdCompressor(compression_params=params).compress(data))
        want = []
        for name, _, text in templates:
            d = z.ZstdCompressionDict(licenses.Scanner.form(text), dict_type=z.DICT_TYPE_RAWCONTENT)
            want.append((len(z.ZstdCompressor(dict_data=d, compression_params=params).compress(data)) - alone, name))
        size, order = scanner.ranked(block)
        assert size == alone and [x[:2] for x in order] == sorted(want)
    assert scanner.ranked(MIT_FILE)[1][0][1] == "MIT/full"


def test_blocks_go_to_the_end_of_a_paragraph():
    lines = ["copyright one"] + ["words"] * 30 + ["all rights reserved", "", "copyright two"]
    assert list(licenses.blocks(lines, [i in (0, 31, 33) for i in range(34)])) == [(0, 31), (33, 33)]


def scan(spark, *texts):
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    return {r.doc_id: r for r in licenses.scan_licenses(df).collect()}


def test_licenses(spark):
    bsd = next(t for n, _, t in licenses.default_templates() if n == "BSD/grant")
    got = scan(
        spark,
        "prose\nReleased under the MIT License.\nmore prose",
        "Licensed under the Apache License, Version 2.0.",
        "This work is licensed under the GNU General Public License, version 3.",
        "Licensed under CC BY-NC 4.0.",
        "\n".join(bsd.split(". ")),
        "We talked of a licence to fish, and of nothing else.",
        "Nothing here.",
        bsd.replace("source and binary", "compiled"),
    )
    assert [got[i].license for i in range(5)] == ["MIT", "Apache-2.0", "GPL-3.0", "CC-BY-NC-4.0", "BSD"]
    assert got[5].license is None and 6 not in got
    assert got[0].missing == got[0].added == [] and got[0].saved > 0 and got[0].first_line == 1
    assert got[7].license == "BSD" and got[7].missing == ["source", "and", "binary"] and got[7].added == ["compiled"]


def test_versions_are_told_apart(spark):
    got = scan(spark, "Licensed under CC BY-SA 3.0.", "Licensed under CC BY-ND 4.0.")
    assert [got[i].license for i in (0, 1)] == ["CC-BY-SA-3.0", "CC-BY-ND-4.0"]


def test_license_edges(odd, none, nameless):
    rows = licenses.scan_licenses(odd).collect()
    assert [(r.doc_id, r.license) for r in rows] == [(7, "MIT")]
    assert licenses.scan_licenses(none).count() == 0 and licenses.scan_licenses(nameless).count() == 0


def test_long_lines_are_scanned_whole(spark):
    grant = next(t for n, _, t in licenses.default_templates() if n == "ISC/grant")
    filler = "and some of the words in this text are of no use to any person " * 3000
    got = scan(spark, filler + grant + " " + filler, filler + "copyright " + filler)
    assert got[0].license == "ISC" and got[0].missing == got[0].added == [] and got[1].license is None


def test_unconfirmed_blocks_of_any_length_are_compared_whole():
    rng = random.Random(15)
    words = licenses.words(MIT_FILE) + [f"w{i}" for i in range(40)]
    scanner = licenses.Scanner(licenses.default_templates(), 3)
    made = {n: licenses.words(t) for n, _, t in licenses.default_templates()}
    for n in (5, 60, 150, 500, 4000):  # below and above all that templates are long
        text = "copyright released under " + " ".join(rng.choices(words, k=n)) + " license"
        ((_, block, name, lic, *_, missing, added),) = scanner.scan(text, 0.1, 0.1)
        assert lic is None and block == text
        have, missed, more = licenses.words(text), [], []
        codes = SequenceMatcher(None, made[name], have, autojunk=False).get_opcodes()
        same = [k for k, c in enumerate(codes) if c[0] == "equal"]
        for k, (kind, a, b, c, d) in enumerate(codes):
            if kind != "equal":
                missed += made[name][a:b]
                more += have[c:d] if same[0] < k < same[-1] else []
        assert (missing, added) == (missed, more)


def test_ranks_do_not_depend_on_the_length_of_a_line():
    rng = random.Random(17)
    scanner = licenses.Scanner(licenses.default_templates(), 3)
    made = {n: t for n, _, t in licenses.default_templates()}
    vocab = ["".join(rng.choices("abcdefghijklmnopqrstuvwxyz", k=rng.randint(3, 9))) for _ in range(3000)]
    for name, spdx in (("ISC/grant", "ISC"), ("GPL-3.0/header", "GPL-3.0"), ("MIT/grant", "MIT")):
        unlike = made[name].split()
        for k in range(5, len(unlike), 7):  # too many to be confirmed
            unlike[k] = rng.choice(vocab)
        for n in (0, 500, 3000, 10_000):
            filler = " ".join(rng.choices(vocab, k=n))
            ((*_, template, lic, _, saved, rank, _, _),) = scanner.scan(f"{filler} {' '.join(unlike)} copyright {filler}", 0.1, 0.1)
            assert lic is None and template.split("/")[0] == spdx and saved > 40 and rank == 1


def test_longest_matches_as_difflib_finds_them():
    rng = random.Random(16)
    for _ in range(300):
        a, b = (rng.choices("abcdef", k=rng.randrange(k)) for k in (12, 60))
        assert licenses.Matcher(a, b).get_opcodes() == SequenceMatcher(None, a, b, autojunk=False).get_opcodes()


def test_wrapped_grants_are_confirmed(spark):
    """As licence files have them: 76 columns, blank lines between clauses, and comment marks."""
    made = {n: t for n, _, t in licenses.default_templates()}
    clauses = {"MIT/grant": "The above", "BSD/grant": "Redistributions", "ISC/grant": None, "GPL-2.0/header": None, "GPL-3.0/header": None}
    texts = []
    for name, at in clauses.items():
        parts = re.split(f" (?={at})", made[name]) if at else [made[name]]
        wrapped = "\n\n".join(textwrap.fill(p, 76) for p in parts)
        texts += [f"A tool\n\n{wrapped}\n\nmore prose", "\n".join(f" * {x}" for x in wrapped.split("\n"))]
    got = scan(spark, *texts)
    assert [got[i].license for i in range(10)] == [x for x in ("MIT", "BSD", "ISC", "GPL-2.0", "GPL-3.0") for _ in "ab"]
    assert all(r.missing == r.added == [] for r in got.values())
    assert got[0].first_line == 2 and got[0].block == texts[0][8:-12]


def test_short_statements_in_long_lines(spark):
    rng = random.Random(8)
    vocab = ["".join(rng.choices("abcdefghijklmnopqrstuvwxyz", k=rng.randint(2, 9))) for _ in range(3000)]
    short = [(lic, text) for n, lic, text in licenses.default_templates() if n.endswith(("/released", "/licensed"))]
    prose = lambda: " ".join(rng.choices(vocab, k=4000))
    got = scan(spark, *(f"{prose()} {text} {prose()}" for _, text in short))
    assert [got[i].license for i in range(len(short))] == [lic for lic, _ in short]


def test_each_statement_of_a_document_is_returned(spark):
    texts = {
        "Licensed under the Apache License, Version 2.0.\nReleased under the MIT License.": ["Apache-2.0", "MIT"],
        "Released under the MIT License. Words, and licensed under CC BY 4.0. " * 2: ["MIT", "CC-BY-4.0"] * 2,
        "// SPDX-License-Identifier: MIT": ["MIT"],
        "SPDX-License-Identifier: (GPL-2.0-or-later WITH Classpath-exception-2.0) OR Apache-2.0": ["GPL-2.0", "Apache-2.0"],
        "under a Creative Commons Attribution 4.0 International License": ["CC-BY-4.0"],
        "Creative Commons Attribution-NonCommercial-NoDerivs 3.0 Unported": ["CC-BY-NC-ND-3.0"],
        "Photo: CC BY-SA 3.0": ["CC-BY-SA-3.0"],
        "Under the MIT licence of old.\nReleased under the MIT License.": [None, "MIT"],
    }
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    rows = licenses.scan_licenses(df).collect()
    assert [[r.license for r in rows if r.doc_id == i] for i in range(len(texts))] == list(texts.values())


def test_near_finds_every_copy():
    rng = random.Random(3)
    template = [f"w{rng.randrange(30)}" for _ in range(50)]
    words, want = [], []
    for _ in range(40):
        words += [rng.choice(template[:9] + ["x"]) for _ in range(rng.randrange(60))]
        copy = list(template)
        for _ in range(rng.randrange(3)):
            copy[rng.randrange(1, 49)] = "y"
        want.append((len(words), len(words) + 50))
        words += copy
    got = [(a, b) for a, b, _, _ in licenses.near(template, words, 5, 5)]
    assert len(got) == 40 and all(a <= e and s <= b for (s, e), (a, b) in zip(want, got))


def test_word_differences():
    missing, added = licenses.differences("a b c d".split(), "x a b q d y".split())
    assert (missing, added) == (["c"], ["q"])


# --- telephony -----------------------------------------------------------------------------


def mulaw(byte):
    byte = ~byte & 0xFF
    v = (((byte & 15) << 3) + 132 << (byte >> 4 & 7)) - 132
    return -v if byte & 128 else v


def alaw(byte):
    byte ^= 0x55
    e, m = byte >> 4 & 7, byte & 15
    v = (m << 4) + 8 if e == 0 else (m << 4) + 264 << (e - 1)
    return v if byte & 128 else -v


def test_tables():
    assert telephony.mulaw_table().tolist() == [mulaw(b) for b in range(256)]
    assert telephony.alaw_table().tolist() == [alaw(b) for b in range(256)]
    assert telephony.mulaw_table()[0] == -32124 and telephony.mulaw_table()[0xFF] == 0
    assert sorted(telephony.alaw_table())[-1] == 32256


def adpcm(block):
    """One block, a nibble at a time."""
    value, index = struct.unpack("<hB", block[:3])
    index, out, steps = min(index, 88), [value], telephony.ima_steps()
    for byte in block[4:]:
        for n in (byte & 15, byte >> 4):
            step = int(steps[index])
            d = (step >> 3) + (step >> 2 if n & 1 else 0) + (step >> 1 if n & 2 else 0) + (step if n & 4 else 0)
            value = max(-32768, min(32767, value - d if n & 8 else value + d))
            index = max(0, min(88, index + (-1, -1, -1, -1, 2, 4, 6, 8)[n & 7]))
            out.append(value)
    return out


def test_adpcm_blocks():
    rng = random.Random(2)
    payloads = [rng.randbytes(n) for n in (0, 3, 4, 5, 31, 32, 33, 64, 100)]
    got = telephony.decode_adpcm(payloads, 32)
    for p, g in zip(payloads, got):
        want = [v for i in range(0, len(p), 32) if len(p[i : i + 32]) >= 4 for v in adpcm(p[i : i + 32])]
        assert g.tolist() == want


@pytest.mark.parametrize("rate,to", [(8000, 16000), (8000, 8000), (8000, 24000), (8000, 11025), (16000, 8000)])
def test_resampling_keeps_tones(rate, to):
    t = np.arange(rate // 4) / rate
    tone = lambda t: 12000 * np.sin(2 * np.pi * 440 * t)
    y = telephony.resample(tone(t), rate, to)
    assert len(y) == -(-len(t) * to // rate)
    middle = slice(len(y) // 4, 3 * len(y) // 4)
    assert np.abs(y[middle] - tone(np.arange(len(y)) / to)[middle]).max() < 120


def test_signals_of_a_batch_do_not_mix():
    rng = np.random.default_rng(0)
    signals = [rng.integers(-9000, 9000, n).astype(np.int16) for n in (0, 1, 7, 400, 33)]
    for rate, to in ((8000, 16000), (8000, 11025)):
        together = telephony.resample_many(signals, rate, to)
        for s, y in zip(signals, together):
            assert np.abs(y.astype(int) - telephony.resample(s, rate, to)).max(initial=0) <= 1
            assert len(y) == -(-len(s) * to // rate)


def test_telephony_table(spark, none, odd):
    rows = [(1, bytes(range(256)), "MULAW", 1), (2, b"", "alaw", 2), (3, None, "alaw", 3), (4, b"abc", None, 4), (5, b"abc", "opus", 5),
            (6, bytes(range(200)) * 50, "adpcm", 6), (None, b"\xff" * 9, "mulaw", 7), (7, b"ab", "adpcm", 8)]
    df = spark.createDataFrame(rows, "doc_id long, payload binary, codec string, pcm int")
    got = {r.doc_id: r for r in telephony.decode_telephony(df).collect()}
    assert len(got) == 8 and got[1].n_samples == 512 and got[1].sample_rate == 16000
    assert bytes(got[1].pcm) == telephony.resample(telephony.mulaw_table()[np.arange(256)], 8000, 16000).astype("<i2").tobytes()
    assert got[2].n_samples == 0 and bytes(got[2].pcm) == b"" and got[7].n_samples == 0
    assert all(got[i].pcm is None and got[i].n_samples is None for i in (3, 4, 5))
    blocks = telephony.decode_adpcm([rows[5][1]], 256)[0]
    assert np.abs(np.frombuffer(got[6].pcm, "<i2")[::2].astype(int) - blocks).max() <= 1
    assert telephony.decode_telephony(df.limit(0)).count() == 0
