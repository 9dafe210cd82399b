"""License scan by conditional compression.

A run of sentences or lines that speaks of licensing is compressed alone and then with each license template as
a raw zstandard dictionary. The templates that shrink it most are its likely sources; a word-level
comparison with the block, best first, then confirms one and lists how the wording differs, unless it
differs in a word that tells licenses apart. Of
overlapping findings those stay that explain most words together.
"""

from __future__ import annotations

import difflib
import json
import re
from bisect import bisect_left, bisect_right
from collections import Counter, defaultdict
from functools import lru_cache

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame

from reelspan.llm.common import keyed_text, map_batches

#: License identifiers with the names that statements give them.
NAMES = (
    ("MIT", ("the MIT License",)),
    ("Apache-2.0", ("the Apache License, Version 2.0", "the Apache License 2.0", "the Apache 2.0 License")),
    ("BSD-2-Clause", ("the BSD 2-Clause License", "the Simplified BSD License")),
    ("BSD-3-Clause", ("the BSD 3-Clause License", "the New BSD License")),
    ("ISC", ("the ISC License",)),
    ("Zlib", ("the zlib License",)),
    ("BSL-1.0", ("the Boost Software License 1.0", "the Boost Software License, Version 1.0")),
    ("MPL-2.0", ("the Mozilla Public License 2.0", "the Mozilla Public License, v. 2.0", "the Mozilla Public License, version 2.0")),
    ("EPL-2.0", ("the Eclipse Public License 2.0", "the Eclipse Public License, version 2.0")),
    ("Unlicense", ("the Unlicense",)),
    ("CC0-1.0", ("CC0 1.0", "the CC0 1.0 Universal License")),
)
#: Families of which one rule makes the names: (identifier, name, short name, versions), and the
#: conditions of Creative Commons licenses.
GNU = (("GPL", "GNU General Public License", "GNU GPL", ("2", "3")), ("LGPL", "GNU Lesser General Public License", "GNU LGPL", ("2.1", "3")), ("AGPL", "GNU Affero General Public License", "GNU AGPL", ("3",)))
CONDITIONS = {"BY": "Attribution", "NC": "NonCommercial", "SA": "ShareAlike", "ND": "NoDerivatives"}
COMMONS = ("BY", "BY-SA", "BY-ND", "BY-NC", "BY-NC-SA", "BY-NC-ND")
COMMONS_VERSIONS = (("4.0", "International"), ("3.0", "Unported"))
#: Statements that name a license, and those that give its identifier alone.
STATEMENTS = ("Released under {}.", "Licensed under {}.", "Distributed under {}.", "Published under {}.", "This work is licensed under {}.", "This project is licensed under {}.", "This project is licensed under the terms of {}.", "This software is released under {}.", "This file is licensed under {}.")
TAGS = ("SPDX-License-Identifier: {}", "License: {}")
#: Stands for up to MOST_FREE words of a name, a year or a work.
FREE, MOST_FREE = "<any>", 12
_FREE_WORD = "free__words"
#: Notices and passages of the licenses themselves, and statements that reserve rights.
TEXTS = (
    ("MIT", "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the \"Software\"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions:"),
    ("MIT", "The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software."),
    ("MIT", "THE SOFTWARE IS PROVIDED \"AS IS\", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE."),
    ("Apache-2.0", "Licensed under the Apache License, Version 2.0 (the \"License\"); you may not use this file except in compliance with the License. You may obtain a copy of the License at"),
    ("GPL-2.0-or-later", "This program is free software; you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation; either version 2 of the License, or (at your option) any later version."),
    ("GPL-2.0-only", "This program is free software; you can redistribute it and/or modify it under the terms of the GNU General Public License version 2 as published by the Free Software Foundation."),
    ("GPL-3.0-or-later", "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version."),
    ("LGPL-2.1-or-later", "This library is free software; you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License as published by the Free Software Foundation; either version 2.1 of the License, or (at your option) any later version."),
    ("LGPL-3.0-or-later", "This program is free software: you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version."),
    ("AGPL-3.0-or-later", "This program is free software: you can redistribute it and/or modify it under the terms of the GNU Affero General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version."),
    ("BSD-3-Clause", "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met:"),
    ("BSD-3-Clause", "Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission."),
    ("ISC", "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies."),
    ("Zlib", "Permission is granted to anyone to use this software for any purpose, including commercial applications, and to alter it and redistribute it freely, subject to the following restrictions:"),
    ("MPL-2.0", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0."),
    ("CC0-1.0", "This work has been dedicated to the public domain under CC0 1.0."),
    ("Unlicense", "This is free and unencumbered software released into the public domain."),
    ("all-rights-reserved", "All rights reserved."),
    ("all-rights-reserved", "Copyright <any>. All rights reserved."),
)


def templates() -> tuple[tuple[str, str], ...]:
    """(license, wording) of all statements, tags and texts."""
    named = list(NAMES)
    for short, name, brief, versions in GNU:
        for v in versions:
            named.append((f"{short}-{v if '.' in v else v + '.0'}", tuple(f"the {n}{v_}" for n, v_ in ((name, f", version {v}"), (name, f" version {v}"), (name, f" v{v}"), (name, f" {v if '.' in v else v + '.0'}"), (brief, f" v{v}"), (brief, f" {v}")))))
    for kind in COMMONS:
        for v, place in COMMONS_VERSIONS:
            full = f"Creative Commons {'-'.join(CONDITIONS[c] for c in kind.split('-'))} {v}"
            named.append((f"CC-{kind}-{v}", (f"CC {kind} {v}", f"a {full} {place} License", f"the {full} {place} License", f"a {full} License", f"the {full} License")))
    out = [(lic, how.format(name)) for lic, names in named for name in names for how in STATEMENTS]
    out += [(lic, tag.format(lic)) for lic, _ in named for tag in TAGS]
    for lic, _ in named:
        if "GPL" in lic:
            out += [(f"{lic}-{end}", tag.format(f"{lic}-{end}")) for end in ("only", "or-later") for tag in TAGS]
    return (*out, *TEXTS)


TEMPLATES = templates()
#: What a run must hold to be looked at; every template does.
TRIGGER = re.compile(r"licen[sc]|rights\W+reserved|copyright|public\W+domain|redistribut|permission\W+(?:is|to)|creative\W+commons|\bCC0\b|unencumbered|as\W+is\b|warrant|\b[al]?gpl|\bcc\W+by\b", re.I)
#: Parts of words that tell licenses apart, or turn what is said into its opposite: no copy of a template
#: lacks one that it has or has one that it lacks. The same goes for words with digits.
TELLING = frozenset("mit apache gnu gpl lgpl agpl lesser affero library general bsd clause simplified new isc zlib boost mozilla mpl eclipse epl unlicense cc cc0 creative commons attribution noncommercial sharealike noderivatives noderivs commercial nc nd sa only later not no non never nor without except".split())
#: Share by which a template must shrink a block to be compared; differing words, as a share of the
#: template's, up to which a block is a modified copy.
LEAST_REDUCTION, MOST_DIFFERENT = 0.25, 0.2
#: Blocks whose judgement is remembered, and the longest of these.
REMEMBERED, LONGEST = 20_000, 1000
_PART = re.compile(r"(?:[^.!?\n]|[.!?](?!\s|\Z))*(?:[.!?]|\n|\Z)")
_WORD = re.compile(r"\w+(?:[.\-/]\w+)*", re.U)


def words_of(text: str) -> list[str]:
    """Lower-case words; version numbers and hyphenated names are one word."""
    return [w.lower() for w in _WORD.findall(text)]


def telling(word: str) -> bool:
    """Whether a word tells licenses apart."""
    return any(p in TELLING or any(map(str.isdigit, p)) for p in re.split(r"[-./]", word))


class Scanner:
    """The templates as compressors, and as word lists."""

    def __init__(self, templates=TEMPLATES):
        self.templates = [(name, text, words_of(text.replace(FREE, _FREE_WORD))) for name, text in templates]
        lost = [text for _, text, _ in self.templates if not TRIGGER.search(text)]
        if lost:
            raise ValueError(f"no run of these would be looked at: {lost}")
        self.plain, self.given = zstandard.ZstdCompressor(level=6), []
        for _, text, _ in self.templates:
            known = zstandard.ZstdCompressionDict(text.replace(FREE, "").lower().encode(), dict_type=zstandard.DICT_TYPE_RAWCONTENT)
            known.precompute_compress(level=6)
            self.given.append(zstandard.ZstdCompressor(dict_data=known))
        free = np.array([wanted.count(_FREE_WORD) for _, _, wanted in self.templates])
        self.sizes = np.array([len(wanted) for _, _, wanted in self.templates])
        self.named, self.free = self.sizes - free, MOST_FREE * free
        self.longest = int(((1 + MOST_DIFFERENT) * self.sizes + self.free).max())
        owners = defaultdict(list)
        for i, (_, _, wanted) in enumerate(self.templates):
            for word, n in Counter(w for w in wanted if w != _FREE_WORD).items():
                owners[word].append((i, n))
        self.owners = {w: tuple(np.array(x) for x in zip(*o, strict=True)) for w, o in owners.items()}
        self.remembered = lru_cache(maxsize=REMEMBERED)(self._judge)

    def judge(self, block: str) -> tuple | None:
        """(license, template, rank, share saved, status, differences) of a block, or None."""
        return self.remembered(block) if len(block) <= LONGEST else self._judge(block)

    def ranked(self, block: str) -> list[tuple[float, int]]:
        """(share saved, template) of all templates, the largest saving first."""
        data = block.lower().encode()
        alone = len(self.plain.compress(data))
        saved = [((alone - len(c.compress(data))) / alone, i) for i, c in enumerate(self.given)]
        return sorted(saved, key=lambda x: (-x[0], x[1]))

    def _judge(self, block: str) -> tuple | None:
        words = words_of(block)
        best = None
        for rank, (saved, i) in enumerate(self.ranked(block)):
            if saved < LEAST_REDUCTION:
                break
            name, _, wanted = self.templates[i]
            if abs(len(words) - len(wanted)) > MOST_DIFFERENT * len(wanted) + self.free[i]:
                continue
            missing, added = differences(wanted, words)
            n = len(missing) + len(added)
            if n > MOST_DIFFERENT * len(wanted) or any(map(telling, missing)) or any(map(telling, added)):
                continue
            found = (n, -len(wanted), rank, name, i, saved, missing, added)
            best = min(best, found) if best else found
            if not n and not self.free[i]:
                break  # no other template is as near
        if best is None:
            return None
        n, _, rank, name, i, saved, missing, added = best
        return name, i, rank + 1, round(saved, 4), "modified" if n else "exact", json.dumps({"missing": missing, "added": added}, ensure_ascii=False) if n else ""

    def scan(self, text: str) -> list[tuple]:
        """(start, end, *judgement) of each statement of a text, paragraph by paragraph."""
        if not TRIGGER.search(text):
            return []
        out, at = [], 0
        for paragraph in re.split(r"(\n[ \t\r]*\n\s*)", text):
            if TRIGGER.search(paragraph):
                out += [(at + i, at + j, *hit) for i, j, hit in self.statements(paragraph)]
            at += len(paragraph)
        return out

    def statements(self, paragraph: str) -> list[tuple]:
        """(start, end, judgement) of the findings among all runs of parts (a part ends with a sentence
        or a line), without overlaps: those with the most template words less twice the differing
        ones, then the shortest."""
        parts = [m.span() for m in _PART.finditer(paragraph) if m[0]]
        joined = paragraph.replace("\n", " ").replace("\r", " ")
        ends, starts = [j for _, j in parts], [i for i, _ in parts]
        words = {}
        hits: dict[int, list[tuple]] = defaultdict(list)
        spans = {(bisect_right(ends, m.start()), bisect_left(starts, m.end()) - 1) for m in TRIGGER.finditer(paragraph)}
        seen = set()
        for a, b in sorted(spans):
            held = 0
            for i in range(b, -1, -1):
                if i not in words:
                    words[i] = words_of(paragraph[slice(*parts[i])])
                held += len(words[i])
                if i <= a and held > self.longest:
                    break
                if i > a or not words[i]:
                    continue
                for j in self.likely(paragraph, parts, words, i):
                    if j >= b and (i, j) not in seen:
                        seen.add((i, j))
                        start = parts[i][0] + len(joined[slice(*parts[i])]) - len(joined[slice(*parts[i])].lstrip())
                        part = joined[start : parts[j][1]].rstrip()
                        if hit := self.judge(part):
                            n = int(self.named[hit[1]]) - 2 * differing(hit[5])
                            hits[j].append((i, n, start, start + len(part), hit))
        best: list[tuple] = []  # of the parts up to one with hits: (that part, score, -characters, last hit, before it)
        for j in sorted(hits):
            options = [best[-1]] if best else [(-1, 0, 0, None, None)]
            for i, n, start, end, hit in hits[j]:
                k = bisect_left(best, i, key=lambda x: x[0]) - 1
                before = best[k] if k >= 0 else (-1, 0, 0, None, None)
                options.append((j, before[1] + n, before[2] - (end - start), (start, end, hit), before))
            top = max(options, key=lambda x: x[1:3])
            best.append((j, *top[1:]))
        out, here = [], best[-1] if best else None
        while here and here[3]:
            out.append(here[3])
            here = here[4]
        return out[::-1]

    def likely(self, paragraph: str, parts: list[tuple[int, int]], words: dict, i: int) -> list[int]:
        """The parts that end a run from part ``i`` whose words, in any order, are near enough to a
        template's: a bound on the differences, so no run that fails it can be a finding."""
        if (i, "ends") in words:
            return words[i, "ends"]
        out, total, held, common = [], 0, Counter(), np.zeros(len(self.templates), dtype=np.int64)
        for j in range(i, len(parts)):
            if j not in words:
                words[j] = words_of(paragraph[slice(*parts[j])])
            total += len(words[j])
            if total > self.longest:
                break
            for word in words[j]:
                held[word] += 1
                if owners := self.owners.get(word):
                    common[owners[0]] += held[word] <= owners[1]
            if words[j] and (self.named - common + np.maximum(0, total - common - self.free) <= MOST_DIFFERENT * self.sizes).any():
                out.append(j)
        words[i, "ends"] = out
        return out


def differing(noted: str) -> int:
    """The number of differing words of a judgement."""
    return sum(map(len, json.loads(noted).values())) if noted else 0


def differences(wanted: list[str], words: list[str]) -> tuple[list[str], list[str]]:
    """Words of the template that the block lacks, and words of the block that the template lacks;
    up to MOST_FREE words in the place of FREE are free."""
    missing, added = [], []
    for kind, a, b, c, d in difflib.SequenceMatcher(None, wanted, words, autojunk=False).get_opcodes():
        if kind == "equal":
            continue
        free = _FREE_WORD in wanted[a:b] and d - c <= MOST_FREE
        missing += [w for w in wanted[a:b] if w != _FREE_WORD]
        added += [] if free else words[c:d]
    return missing, added


def scan_licenses(df: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """One row for each license statement found (a text of several paragraphs has one for each): key, start, length (code points), license, template
    (its number), rank among the templates by size reduction, reduction, status (exact or modified)
    and differences (JSON, empty when exact).

    Documents without a finding have no row. Null and empty texts have none; repeated rows give
    repeated findings; a null key stays null; other columns are not read. No shuffle.
    """

    def make():
        scanner = Scanner()

        def work(batch: pa.RecordBatch) -> pa.RecordBatch | None:
            rows = []
            for doc, body in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                rows += [(doc, start, end - start, name, i, rank, saved, status, diff) for start, end, name, i, rank, saved, status, diff in scanner.scan(body)]
            if not rows:
                return None
            types = [pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.int32(), pa.int32(), pa.float64(), pa.string(), pa.string()]
            names = [key, "start", "length", "license", "template", "rank", "reduction", "status", "differences"]
            return pa.RecordBatch.from_arrays([pa.array(list(c), t) for c, t in zip(zip(*rows, strict=True), types, strict=True)], names=names)

        return work

    return map_batches(keyed_text(df, key, text), make, f"{key} long, start long, length long, license string, template int, rank int, reduction double, status string, differences string")
