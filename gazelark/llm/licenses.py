"""License scans by conditional compression.

A candidate block is a stretch of lines with a licence's cue words. It is compressed alone and with each template as a raw
zstandard dictionary; a template that makes it smaller may be what the block repeats, the more the likelier. These
templates are then held against the block word by word, and the one with fewest differences wins if they are few enough
and none is a number or a word that tells licences apart. So compression ranks and exact wording decides. The winner's stretch is cut
out and what is left on both sides is judged again, until nothing more is confirmed.

Cases: null and empty texts, and texts without cues, have no blocks; very long texts are scanned once and only their candidate blocks
are compressed; of templates with as few differences the one that makes the block smallest wins, then the first; repeated rows and null keys are
scanned each; an empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

import re
from difflib import SequenceMatcher

import pyarrow as pa
from pyspark.sql import DataFrame

from ._shared import small_batches

MAX_DIFFERENT = 0.15

# The wording of common licence notices and grants.
TEMPLATES = {
    "Apache-2.0": [
        "Licensed under the Apache License, Version 2.0.",
        'Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file except in compliance with the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0 Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an "AS IS" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied. See the License for the specific language governing permissions and limitations under the License.',
    ],
    "MIT": [
        "Released under the MIT License.",
        "Licensed under the MIT License.",
        'Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the "Software"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions: The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software. THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT.',
    ],
    "GPL-3.0": [
        "This work is licensed under the GNU General Public License, version 3.",
        "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version.",
    ],
    "GPL-2.0": [
        "This work is licensed under the GNU General Public License, version 2.",
        "This program is free software; you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation; either version 2 of the License, or (at your option) any later version.",
    ],
    "LGPL-3.0": ["This work is licensed under the GNU Lesser General Public License, version 3."],
    "AGPL-3.0": ["This work is licensed under the GNU Affero General Public License, version 3."],
    "BSD-3-Clause": [
        "Licensed under the BSD 3-Clause License.",
        "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met: 1. Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer. 2. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution. 3. Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission.",
    ],
    "BSD-2-Clause": ["Licensed under the BSD 2-Clause License."],
    "MPL-2.0": ["This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not distributed with this file, You can obtain one at https://mozilla.org/MPL/2.0/."],
    "ISC": ["Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies."],
    "CC-BY-4.0": ["Licensed under CC BY 4.0.", "This work is licensed under a Creative Commons Attribution 4.0 International License."],
    "CC-BY-SA-4.0": ["Licensed under CC BY-SA 4.0.", "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License."],
    "CC-BY-NC-4.0": ["Licensed under CC BY-NC 4.0.", "This work is licensed under a Creative Commons Attribution-NonCommercial 4.0 International License."],
    "CC-BY-ND-4.0": ["Licensed under CC BY-ND 4.0.", "This work is licensed under a Creative Commons Attribution-NoDerivatives 4.0 International License."],
    "CC0-1.0": ["Released under CC0 1.0.", "To the extent possible under law, the author has waived all copyright and related or neighboring rights to this work."],
    "Unlicense": ["This is free and unencumbered software released into the public domain."],
}
CUES = ("licen", "permission", "redistribut", "public domain", "waived all copyright", "cc0", "warranty", "mozilla")
# Words that tell one licence from another, besides numbers.
TELLING = frozenset("apache mit gnu gpl lesser lgpl affero agpl bsd mozilla mpl isc cc by sa nc nd cc0 sharealike noncommercial noderivatives attribution unencumbered clause".split())

_WORD = re.compile(r"[^\W_]+")


def _words(text: str) -> list[str]:
    return [m[0] for m in _WORD.finditer(text.lower())]


class Scanner:
    def __init__(self, templates: dict[str, list[str]]):
        import zstandard

        self.names = [(name, i) for name, texts in templates.items() for i in range(len(texts))]
        texts = [templates[name][i] for name, i in self.names]
        self.words = [_words(t) for t in texts]
        self.plain = zstandard.ZstdCompressor(level=9, write_content_size=False)
        self.with_template = [zstandard.ZstdCompressor(level=9, write_content_size=False, dict_data=zstandard.ZstdCompressionDict(t.encode(), dict_type=zstandard.DICT_TYPE_RAWCONTENT)) for t in texts]
        self.longest = max(map(len, self.words))
        self.known: dict[str, tuple | None] = {}

    def blocks(self, text: str) -> list[tuple[int, int]]:
        """Stretches of neighbouring lines with cue words, each within the lines' sentences if a line is long."""
        low = text.lower()
        if len(low) != len(text):  # a letter whose small form has more characters; offsets must stay those of the text
            low = "".join(c if len(x := c.lower()) != 1 else x for c in text)
        if not any(c in low for c in CUES):
            return []
        out: list[tuple[int, int]] = []
        at = 0
        for line in low.split("\n"):
            end = at + len(line)
            if any(c in line for c in CUES):
                for a, b in self._sentences(line):
                    if out and text[out[-1][1] : at + a].isspace():
                        out[-1] = (out[-1][0], at + b)
                    else:
                        out.append((at + a, at + b))
            at = end + 1
        return out

    @staticmethod
    def _sentences(line: str) -> list[tuple[int, int]]:
        bounds = [0, *[m.end() for m in re.finditer(r"[.!?][\"')\]]*\s+", line) if not re.search(r"\b(?:v|no)\.\s+$", line[max(0, m.start() - 3) : m.end()])], len(line)]
        parts = list(zip(bounds, bounds[1:], strict=False))
        cued = [i for i, (a, b) in enumerate(parts) if any(c in line[a:b] for c in CUES)]
        out: list[tuple[int, int]] = []
        last = -9
        for i in cued:
            a, b = parts[i]
            a += len(line[a:b]) - len(line[a:b].lstrip())
            b = a + len(line[a:b].rstrip())
            if i - last <= 2:  # one sentence between is part of the wording
                out[-1] = (out[-1][0], b)
            else:
                out.append((a, b))
            last = i
        return out

    def hits(self, block: str) -> list[tuple[int, int, tuple]]:
        """(start, end, judge()'s winner) of each licence in the block, in order; one alone has all of the block."""
        found, todo = [], [(0, len(block))]
        while todo:
            a, b = todo.pop()
            piece = block[a:b]
            if any(c in piece.lower() for c in CUES) and (hit := self.judge(piece)):
                c, d = a + hit[4], a + hit[5]
                found.append((c, d, hit))
                todo += [(a, c), (d, b)]
        return sorted(found, key=lambda x: x[:2]) if len(found) != 1 else [(0, len(block), found[0][2])]

    def judge(self, block: str) -> tuple[str, float, int, str, int, int] | None:
        """(licence, size reduction, number of differences, the differences, start and end of its stretch) of the winner, if one is confirmed."""
        if block not in self.known:
            if len(self.known) > 50_000:
                self.known.clear()
            self.known[block] = self._judge(block)
        return self.known[block]

    def _judge(self, block: str):
        data = block.encode()
        alone = len(self.plain.compress(data))
        sizes = [len(c.compress(data)) for c in self.with_template]
        ranked = sorted(range(len(sizes)), key=lambda i: (sizes[i], i))
        own = _words(block)
        found = []
        for i in ranked:
            if sizes[i] >= alone:
                continue
            missing, extra = self._differences(own, self.words[i])
            if len(missing) + len(extra) <= MAX_DIFFERENT * len(self.words[i]) and not any(w in TELLING or w[0].isdigit() for w in missing + extra):
                found.append((len(missing) + len(extra), sizes[i], i, missing, extra))
        if not found:
            return None
        n, size, i, missing, extra = min(found)
        return self.names[i][0], 1 - size / alone, n, " ".join(["-" + w for w in missing] + ["+" + w for w in extra]), *self._stretch(block, own, self.words[i])

    @staticmethod
    def _stretch(block: str, own: list[str], template: list[str]) -> tuple[int, int]:
        """The characters from the first to the last word that block and template share, with signs that follow."""
        same = [m for m in SequenceMatcher(None, template, own, autojunk=False).get_matching_blocks() if m.size]
        at = [m.span() for m in _WORD.finditer(block)]
        if len(at) != len(own):  # a letter whose small form has more characters
            return 0, len(block)
        end = at[same[-1].b + same[-1].size - 1][1]
        while end < len(block) and not block[end].isalnum() and not block[end].isspace():
            end += 1
        return at[same[0].b][0], end

    @staticmethod
    def _differences(own: list[str], template: list[str]) -> tuple[list[str], list[str]]:
        """The template's words that the block lacks, and the block's words among those that it has; what stands around them is no difference."""
        missing, extra = [], []
        steps = SequenceMatcher(None, template, own, autojunk=False).get_opcodes()
        first = next((k for k, s in enumerate(steps) if s[0] == "equal"), len(steps))
        last = max((k for k, s in enumerate(steps) if s[0] == "equal"), default=-1)
        for k, (kind, a, b, c, d) in enumerate(steps):
            if kind != "equal":
                missing += template[a:b]
                if first < k < last or (kind == "replace" and b > a):
                    extra += own[c:d][: max(b - a, 1)] if not first < k < last else own[c:d]
        return missing, extra


def _scan(templates):
    names = ["doc_id", "n_blocks", "n_licenses", "licenses", "spans", "n_differences", "differences", "reduction"]
    kinds = [pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.string(), pa.int64(), pa.string(), pa.float64()]

    def run(batches):
        scanner = Scanner(templates)
        for batch in batches:
            columns: list[list] = [[] for _ in names]
            for key, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                blocks = scanner.blocks(text) if text else []
                hits = [(a + c, a + d, hit) for a, b in blocks for c, d, hit in scanner.hits(text[a:b])]
                row = (key, len(blocks), len(hits), ",".join(sorted({h[0] for _, _, h in hits})), ",".join(f"{h[0]}:{a}:{b}" for a, b, h in hits), sum(h[2] for _, _, h in hits), "; ".join(h[3] for _, _, h in hits if h[3]), max((h[1] for _, _, h in hits), default=0.0))
                for c, v in zip(columns, row, strict=True):
                    c.append(v)
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, kinds, strict=True)], names=names)

    return run


def scan_licenses(docs: DataFrame, templates: dict[str, list[str]] | None = None, text: str = "text", key: str = "doc_id") -> DataFrame:
    """One row a document: (key, n_blocks, n_licenses, licenses, spans, n_differences, differences, reduction).

    n_blocks candidates, n_licenses confirmed ones; spans lists licence:start:end in code points; differences has a `-` before words
    that a block lacks and a `+` before those that it has instead; reduction is the largest share of size saved.
    """
    small_batches(docs.sparkSession)
    schema = "doc_id long, n_blocks long, n_licenses long, licenses string, spans string, n_differences long, differences string, reduction double"
    out = docs.select(docs[key].cast("long").alias("doc_id"), docs[text].alias("text")).mapInArrow(_scan(templates or TEMPLATES), schema)
    return out.withColumnRenamed("doc_id", key)


def op3_license_compression(spark, sf_dir: str) -> DataFrame:
    return scan_licenses(spark.read.parquet(f"{sf_dir}/documents.parquet"))
