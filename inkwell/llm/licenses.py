"""License scan by conditional compression.

Documents with a line that could state a license are found on the JVM. All their words, whatever
the lines and blank lines they are on, are searched for each template: a statement is confirmed
only on its exact wording differences, and its block is the lines that hold it. Lines that could
state a license and hold no confirmed template form blocks with their neighbours. A block is
compressed alone and with each template as a raw zstandard dictionary: what the dictionary saves
ranks the templates.

Defined results: one row a confirmed statement (of templates that share words the one with most
of them in common, then fewest differences, then by name) and one a block without any, whose
license is null and whose differences are those of the best-ranked template; documents without
either give none, nulls and empty texts included. Equal reductions rank by template name. Ids may
be null or repeat; other columns are ignored; an empty table gives no rows. Blocks of any length
are compressed whole; a template saves of a block the most that it saves of any of the
overlapping stretches of 2,048 bytes that make it up (a shorter block is one), so that a rank does
not depend on what else is in a long line. All words of an unconfirmed block are compared. One narrow pass; only documents with a
candidate reach Python.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator
from difflib import Match, SequenceMatcher
from functools import cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from .common import slices, texts_of

SPDX = "SPDX-License-Identifier"
# Words that any license statement uses, in the languages of the corpus.
TRIGGER = (
    r"(?i)licen[cs]|lizenz|copyright|copyleft|©|\(c\) ?(?:19|20)\d\d|spdx|all rights reserved|permission is hereby"
    r"|redistribution and use|creative commons|\bcc[ -]?(?:by|0)\b|public domain|without warranty of"
)
_MIT = (
    "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and "
    'associated documentation files (the "Software"), to deal in the Software without restriction, including '
    "without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell "
    "copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the "
    "following conditions: The above copyright notice and this permission notice shall be included in all "
    "copies or substantial portions of the Software."
)
_BSD = (
    "Redistribution and use in source and binary forms, with or without modification, are permitted provided "
    "that the following conditions are met: Redistributions of source code must retain the above copyright "
    "notice, this list of conditions and the following disclaimer. Redistributions in binary form must "
    "reproduce the above copyright notice, this list of conditions and the following disclaimer in the "
    "documentation and/or other materials provided with the distribution."
)
_ISC = (
    "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is "
    "hereby granted, provided that the above copyright notice and this permission notice appear in all copies."
)
_AS_IS = (
    'THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO '
    "THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE "
    "AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, "
    "TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE "
    "SOFTWARE."
)
_BSD_THIRD = (
    "Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote "
    "products derived from this software without specific prior written permission."
)
_BSD_AS_IS = (
    'THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS "AS IS" AND ANY EXPRESS OR IMPLIED WARRANTIES, '
    "INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE "
    "DISCLAIMED. IN NO EVENT SHALL THE COPYRIGHT HOLDER OR CONTRIBUTORS BE LIABLE FOR ANY DIRECT, INDIRECT, INCIDENTAL, "
    "SPECIAL, EXEMPLARY, OR CONSEQUENTIAL DAMAGES (INCLUDING, BUT NOT LIMITED TO, PROCUREMENT OF SUBSTITUTE GOODS OR "
    "SERVICES; LOSS OF USE, DATA, OR PROFITS; OR BUSINESS INTERRUPTION) HOWEVER CAUSED AND ON ANY THEORY OF LIABILITY, "
    "WHETHER IN CONTRACT, STRICT LIABILITY, OR TORT (INCLUDING NEGLIGENCE OR OTHERWISE) ARISING IN ANY WAY OUT OF THE USE "
    "OF THIS SOFTWARE, EVEN IF ADVISED OF THE POSSIBILITY OF SUCH DAMAGE."
)
_ISC_AS_IS = (
    'THE SOFTWARE IS PROVIDED "AS IS" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL '
    "IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS. IN NO EVENT SHALL THE AUTHOR BE LIABLE FOR ANY SPECIAL, DIRECT, "
    "INDIRECT, OR CONSEQUENTIAL DAMAGES OR ANY DAMAGES WHATSOEVER RESULTING FROM LOSS OF USE, DATA OR PROFITS, WHETHER IN "
    "AN ACTION OF CONTRACT, NEGLIGENCE OR OTHER TORTIOUS ACTION, ARISING OUT OF OR IN CONNECTION WITH THE USE OR "
    "PERFORMANCE OF THIS SOFTWARE."
)
_GPL = (
    "{2} is free software: you can redistribute it and/or modify it under the terms of the GNU "
    "{1}General Public License as published by the Free Software Foundation, either version {0} of the License, "
    "or (at your option) any later version."
)
# Wordings that stand by themselves: (template, license, text).
_HEADERS = (
    ("Apache-2.0/header", "Apache-2.0", 'Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file except in compliance with the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0 Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an "AS IS" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied. See the License for the specific language governing permissions and limitations under the License.'),
    ("MPL-2.0/header", "MPL-2.0", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not distributed with this file, You can obtain one at https://mozilla.org/MPL/2.0/."),
    ("EPL-2.0/header", "EPL-2.0", "This program and the accompanying materials are made available under the terms of the Eclipse Public License 2.0 which is available at https://www.eclipse.org/legal/epl-2.0/"),
    ("Unlicense/notice", "Unlicense", "This is free and unencumbered software released into the public domain. Anyone is free to copy, modify, publish, use, compile, sell, or distribute this software, either in source code form or as a compiled binary, for any purpose, commercial or non-commercial, and by any means."),
    ("Zlib/notice", "Zlib", "This software is provided 'as-is', without any express or implied warranty. In no event will the authors be held liable for any damages arising from the use of this software. Permission is granted to anyone to use this software for any purpose, including commercial applications, and to alter it and redistribute it freely, subject to the following restrictions:"),
    ("BSL-1.0/notice", "BSL-1.0", "Distributed under the Boost Software License, Version 1.0."),
    ("WTFPL/notice", "WTFPL", "Everyone is permitted to copy and distribute verbatim or modified copies of this license document, and changing it is allowed as long as the name is changed."),
    ("CC0-1.0/waiver", "CC0-1.0", "To the extent possible under law, the author has waived all copyright and related or neighboring rights to this work."),
)
_CC = {
    "BY": ("Attribution",),
    "BY-SA": ("Attribution-ShareAlike",),
    "BY-NC": ("Attribution-NonCommercial",),
    "BY-ND": ("Attribution-NoDerivatives", "Attribution-NoDerivs"),
    "BY-NC-SA": ("Attribution-NonCommercial-ShareAlike",),
    "BY-NC-ND": ("Attribution-NonCommercial-NoDerivatives", "Attribution-NonCommercial-NoDerivs"),
}


@cache
def default_templates() -> tuple[tuple[str, str, str], ...]:
    """(template, license, text): grants, headers, one-line statements, SPDX ids and Creative
    Commons names of common licenses."""
    names = {
        "MIT": "MIT License",
        "Apache-2.0": "Apache License, Version 2.0",
        "BSD-2-Clause": "BSD 2-Clause License",
        "BSD-3-Clause": "BSD 3-Clause License",
        "ISC": "ISC License",
        "MPL-2.0": "Mozilla Public License, Version 2.0",
        "GPL-2.0": "GNU General Public License, version 2",
        "GPL-3.0": "GNU General Public License, version 3",
        "LGPL-3.0": "GNU Lesser General Public License, version 3",
        "AGPL-3.0": "GNU Affero General Public License, version 3",
        "EPL-2.0": "Eclipse Public License, version 2.0",
        "CC0-1.0": "CC0 1.0",
    } | {
        f"CC-{kind}-{v}": f"CC {kind} {v}"
        for kind in _CC
        for v in ("3.0", "4.0")
    }
    made = [
        (f"{spdx}/{how}", spdx, text.format(name))
        for spdx, name in names.items()
        for how, text in (
            ("released", "Released under the {}."),
            ("licensed", "Licensed under {}."),
            ("licensed-the", "Licensed under the {}."),
            ("work", "This work is licensed under the {}."),
        )
    ]
    made += [(f"{spdx}/spdx", spdx, f"{SPDX}: {spdx}") for spdx in names]
    made += [
        (f"{spdx}/spdx-{which}", spdx, f"{SPDX}: {spdx}{end}")
        for spdx in names
        if "GPL" in spdx
        for which, end in (("only", "-only"), ("later", "-or-later"))
    ]
    for kind, written in _CC.items():
        for v in ("3.0", "4.0"):
            forms = {f"CC {kind} {v}", f"CC-{kind}-{v}"} | {
                f"Creative Commons {x} {v}" for name in written for x in (name, name.replace("-", " "))
            }
            made += [(f"CC-{kind}-{v}/name-{i}", f"CC-{kind}-{v}", x) for i, x in enumerate(sorted(forms))]
            made += [
                (f"CC-{kind}-{v}/legal-{i}-{k}", f"CC-{kind}-{v}", f"{lead} licensed under {a} Creative Commons {name} {v} {port} License")
                for k, name in enumerate(written)
                for i, (lead, a, port) in enumerate((("This work is", "a", "International"), ("This work is", "a", "Unported"), ("Content is", "the", "International")))
            ]
    made += [("CC0-1.0/name", "CC0-1.0", "CC0 1.0"), ("CC0-1.0/name-long", "CC0-1.0", "Creative Commons Zero")]
    # Whole licenses, and grants without their disclaimers. BSD alone says nothing of clauses.
    made += [("MIT/grant", "MIT", _MIT), ("MIT/full", "MIT", f"{_MIT} {_AS_IS}")]
    made += [("ISC/grant", "ISC", _ISC), ("ISC/full", "ISC", f"{_ISC} {_ISC_AS_IS}")]
    made += [("BSD/grant", "BSD", _BSD), ("BSD-2-Clause/full", "BSD-2-Clause", f"{_BSD} {_BSD_AS_IS}")]
    made += [("BSD-3-Clause/grant", "BSD-3-Clause", f"{_BSD} {_BSD_THIRD}"), ("BSD-3-Clause/full", "BSD-3-Clause", f"{_BSD} {_BSD_THIRD} {_BSD_AS_IS}")]
    for kind, of in (("GPL", ""), ("LGPL", "Lesser "), ("AGPL", "Affero ")):
        for v in ("2", "2.1", "3"):
            if (kind, v) in (("GPL", "2.1"), ("LGPL", "2"), ("AGPL", "2"), ("AGPL", "2.1")):
                continue
            name = f"{kind}-{v}" + ".0" * ("." not in v)
            made += [(f"{name}/header{end}", name, _GPL.format(v, of, f"This {what}")) for end, what in (("", "program"), ("-library", "library"))]
    made += list(_HEADERS)
    made += [("reserved", "proprietary", "All rights reserved.")]
    return tuple(made)


def words(text: str) -> list[str]:
    return re.findall(r"\w+(?:[.\-]\w+)*", text.lower())


def expression(have: list[str], end: int) -> Iterator[int]:
    """Where the further ids of an SPDX expression are whose first id ends before `end`."""
    while end + 1 < len(have) and have[end] in ("or", "and", "with"):
        if have[end] != "with":
            yield end + 1
        end += 2


def blocks(lines: list[str], hit: list[bool]) -> Iterator[tuple[int, int]]:
    """(first, last) of runs of neighbouring lines of which each is a hit, or lies between two
    that are with no blank line in between, however far apart."""
    at = 0
    while at < len(lines):
        if not hit[at]:
            at += 1
            continue
        end = reach = at
        while reach + 1 < len(lines) and lines[reach + 1].strip():
            reach += 1
            if hit[reach]:
                end = reach
        yield at, end
        at = end + 1


class Matcher(SequenceMatcher):
    """SequenceMatcher without junk; the places of each word in b are looked at all at once, so that
    a long b takes time in proportion to it."""

    def __init__(self, a: list[str], b: list[str]):
        super().__init__(None, a, b, autojunk=False)
        self.at = {w: np.array(self.b2j.get(w, ()), np.int64) for w in set(a)}
        self.run = np.zeros(len(b) + 1, np.int64)  # of the equal words that end before each place of b

    def find_longest_match(self, alo: int = 0, ahi: int | None = None, blo: int = 0, bhi: int | None = None) -> Match:
        """The longest; of such the first in a, and of these the first in b."""
        ahi, bhi = len(self.a) if ahi is None else ahi, len(self.b) if bhi is None else bhi
        best, before = Match(alo, blo, 0), np.zeros(0, np.int64)
        for i in range(alo, ahi):
            here = self.at[self.a[i]]
            here = here[np.searchsorted(here, blo) : np.searchsorted(here, bhi)]
            size = self.run[here] + 1
            self.run[before + 1] = 0
            self.run[here + 1] = size
            before = here
            if len(here) and (most := int(size.max())) > best.size:
                best = Match(i - most + 1, int(here[size.argmax()]) - most + 1, most)
        self.run[before + 1] = 0
        return best


def differences(template: list[str], block: list[str]) -> tuple[list[str], list[str]]:
    """Template words that the block lacks, and words that it has between those it shares."""
    missing, added, matched = [], [], False
    codes = Matcher(template, block).get_opcodes()
    last = max((i for i, c in enumerate(codes) if c[0] == "equal"), default=-1)
    for i, (kind, a, b, c, d) in enumerate(codes):
        matched |= kind == "equal"
        if kind in ("delete", "replace"):
            missing += template[a:b]
        if kind in ("insert", "replace") and matched and i < last:
            added += block[c:d]
    return missing, added


def aligned(template: list[str], block: list[str]) -> tuple[int, int, list[str], list[str]] | None:
    """The stretch of a block that differs least from the template: (start, end, missing, added)."""
    parts = SequenceMatcher(None, template, block, autojunk=False).get_matching_blocks()[:-1]
    best = None
    for i in range(len(parts)):
        same = 0
        for j in range(i, len(parts)):
            same += parts[j].size
            cost = len(template) + parts[j].b + parts[j].size - parts[i].b - 2 * same
            if best is None or cost < best[0]:
                best = (cost, i, j)
    if best is None:
        return None
    used = parts[best[1] : best[2] + 1]
    start, end = used[0].b, used[-1].b + used[-1].size
    mine = {k for p in used for k in range(p.a, p.a + p.size)}
    theirs = {k for p in used for k in range(p.b, p.b + p.size)}
    missing = [w for k, w in enumerate(template) if k not in mine]
    return start, end, missing, [block[k] for k in range(start, end) if k not in theirs]


def near(template: list[str], have: list[str], less: int, more: int) -> Iterator[tuple[int, int, list[str], list[str]]]:
    """Stretches of `have` that lack at most `less` words of the template and add at most `more`.

    Such a stretch has at most `span` words, begins with a word of the template and has `need`
    of them; only windows in which so many are found are aligned.
    """
    need, span, want = len(template) - less, len(template) + more, Counter(template)
    at = np.array([i for i, w in enumerate(have) if w in want], np.int64)
    starts = at[np.searchsorted(at, at + span) - np.arange(len(at)) >= need]

    def inside(lo: int, hi: int) -> Iterator[tuple[int, int, list[str], list[str]]]:
        if hi - lo < need or (Counter(have[lo:hi]) & want).total() < need:
            return
        found = aligned(template, have[lo:hi])
        if found and len(found[2]) <= less and len(found[3]) <= more:
            start, end = lo + found[0], lo + found[1]
            yield from inside(lo, start)
            yield start, end, *found[2:]
            yield from inside(end, hi)
        elif hi - lo > span:  # words around the stretch can hide it
            end = lo
            for s in starts[np.searchsorted(starts, lo) : np.searchsorted(starts, hi)].tolist():
                if s >= end:
                    for one in inside(s, min(s + span, hi)):
                        yield one
                        end = one[1]

    done = k = 0
    while k < len(starts):
        lo = max(int(starts[k]), done)
        for one in inside(lo, min(lo + 2 * span, len(have))):
            yield one
            done = one[1]
        k = int(np.searchsorted(starts, max(done, lo + span + 1)))


# With a short dictionary zstandard has small tables for any block: beyond this many bytes they
# fill up, the less the longer the template, whatever the words.
STRETCH, STEP = 2048, 512


def stretches(data: bytes) -> Iterator[bytes]:
    """Of STRETCH bytes, one every STEP and one at the end; they overlap and leave nothing out."""
    last = max(0, len(data) - STRETCH)
    for at in (*range(0, last, STEP), last):
        yield data[at : at + STRETCH]


class Scanner:
    def __init__(self, templates, level: int):
        import zstandard as z

        self.templates = [(t, lic, words(text)) for t, lic, text in templates]
        # Compression has a floor of a few bytes a frame; neither header nor checksum is wanted.
        plain = z.ZstdCompressionParameters.from_level(level, write_content_size=False, write_dict_id=False)
        self.alone = z.ZstdCompressor(compression_params=plain)
        self.with_template = []
        for _, _, text in templates:
            d = z.ZstdCompressionDict(self.form(text), dict_type=z.DICT_TYPE_RAWCONTENT)
            self.with_template.append(z.ZstdCompressor(dict_data=d, compression_params=plain))
        self.seen: dict[str, tuple] = {}

    @staticmethod
    def form(text: str) -> bytes:
        return " ".join(words(text)).encode()

    def ranked(self, block: str) -> tuple[int, list[tuple]]:
        """Compressed size alone, and (change of the stretch that changes most, name, template words) of
        all templates, best first."""
        if (found := self.seen.get(block)) is None:
            data = self.form(block)
            alone = len(self.alone.compress(data))
            parts = [(x, len(self.alone.compress(x))) for x in stretches(data)]
            found = alone, sorted(
                (min(len(c.compress(x)) - n for x, n in parts), t[0], t[2]) for t, c in zip(self.templates, self.with_template)
            )
            if len(block) < 1000 and len(self.seen) < 10_000:
                self.seen[block] = found
        return found

    def stated(self, have: list[str], max_missing: float, max_added: float) -> list[tuple]:
        """(start, end, template, license, missing, added) of the templates found in the words;
        of those that share words the one with most words in common, then fewest differences."""
        joined, offsets, found = f" {' '.join(have)} ", None, []
        for name, lic, template in self.templates:
            if not template:
                continue
            less, more = int(max_missing * len(template)), int(max_added * len(template))
            if less or more:
                found += [(s, e, name, lic, m, a, len(template) - len(m)) for s, e, m, a in near(template, have, less, more)]
                continue
            needle, at = f" {' '.join(template)} ", -1
            while (at := joined.find(needle, at + 1)) >= 0:
                if offsets is None:
                    offsets = np.cumsum([0, *(len(w) + 1 for w in have)])
                start = int(np.searchsorted(offsets, at))
                found.append((start, start + len(template), name, lic, [], [], len(template)))
        for at in [i for i, w in enumerate(have) if w == SPDX.lower()]:
            for k in expression(have, at + 2):
                for name, lic, template in self.templates:
                    if template == [SPDX.lower(), have[k]]:
                        found.append((k, k + 1, name, lic, [], [], 1))
        taken, out = np.zeros(len(have), bool), []
        for start, end, *row, _ in sorted(found, key=lambda f: (-f[6], len(f[4]) + len(f[5]), f[2], f[0])):
            if not taken[start:end].any():
                taken[start:end] = True
                out.append((start, end, *row))
        return sorted(out)

    def scan(self, text: str, max_missing: float, max_added: float) -> Iterator[tuple]:
        """(first line, block, template, license, ...) of what a document states, in order."""
        lines = text.split("\n")
        by_line = [words(x) for x in lines]
        have = [w for x in by_line for w in x]
        line_of = np.repeat(np.arange(len(lines)), [len(x) for x in by_line])
        hit = [bool(re.search(TRIGGER, x)) for x in lines]
        rows = []
        for start, end, name, lic, missing, added in self.stated(have, max_missing, max_added):
            first, last = int(line_of[start]), int(line_of[end - 1])
            block = "\n".join(lines[first : last + 1])
            hit[first : last + 1] = [False] * (last + 1 - first)
            alone, order = self.ranked(block)
            rank, change = next((k, c) for k, (c, n, _) in enumerate(order, 1) if n == name)
            rows.append((first, block, name, lic, alone, -change, rank, missing, added))
        for first, last in blocks(lines, hit):
            block = "\n".join(lines[first : last + 1])
            alone, order = self.ranked(block)
            change, name, template = order[0]
            missing, added = differences(template, words(block))
            rows.append((first, block, name, None, alone, -change, 1, missing, added))
        return iter(sorted(rows, key=lambda r: r[0]))


_SCANNERS: dict = {}
SCHEMA = (
    "doc_id long, first_line int, block string, template string, license string, size_alone int, "
    "saved int, rank int, missing array<string>, added array<string>"
)


def scan_licenses(
    docs: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    templates: tuple[tuple[str, str, str], ...] | None = None,
    level: int = 3,
    max_missing: float = 0.1,
    max_added: float = 0.1,
) -> DataFrame:
    """License statements and unconfirmed blocks of all documents; every template is compared."""
    templates = templates or default_templates()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        if (key := (templates, level)) not in _SCANNERS:
            _SCANNERS[key] = Scanner(templates, level)
        scanner = _SCANNERS[key]
        schema = pa.schema(
            [("doc_id", pa.int64()), ("first_line", pa.int32()), ("block", pa.string()), ("template", pa.string()),
             ("license", pa.string()), ("size_alone", pa.int32()), ("saved", pa.int32()), ("rank", pa.int32()),
             ("missing", pa.list_(pa.string())), ("added", pa.list_(pa.string()))]
        )
        for batch in slices(batches):
            rows = []
            for doc_id, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                rows += [(doc_id, *row) for row in scanner.scan(text, max_missing, max_added)]
            yield pa.RecordBatch.from_arrays(
                [pa.array(c, f.type) for c, f in zip(zip(*rows), schema)] if rows else [pa.array([], f.type) for f in schema],
                schema=schema,
            )

    return (
        texts_of(docs, id_col, text_col)
        .where(f"text rlike '{TRIGGER.replace(chr(92), chr(92) * 2)}'")
        .mapInArrow(run, SCHEMA)
    )
