"""Operator 3, licence scans: sparse TF-IDF cosine to templates, then inheritance from the nearest ancestor directory.

Templates are notices and whole texts of licences. What is compared with them is
every line of a text, every block of two and more neighbouring comment lines (a
header that is wrapped over lines) and, of licence files (LICENSE, LICENCE,
COPYING, NOTICE), the whole text; nothing is chosen by keywords. A unit's words
are weighted by term frequency and inverse document frequency over the templates
(a word of no template weighs as one of a single template) and compared with each
template by cosine, as sparse products in the tasks that read the texts. Versions of
a licence are templates of their own, and one counts only where a unit holds its
numbers, so that a version without a template is not taken for another. A file has
the licence of its best unit of at least `least` cosine (ties: the first template by
name). A directory has the licence of its best licence file (ties: by name); a file
without one inherits from the nearest ancestor directory that has one. Inheritance
joins paths: distinct directories are joined to their ancestors first, files to
their own directory last.

Skew: a text is scored where it is read. A common directory is one row until the
last join, which adaptive execution can split.

Rows: a null or empty text has no unit. A null path has no directory and
inherits nothing. Rows that repeat a path each get a row. `file` is a unique id.
The input's columns are file, path and text by name; any others are left alone.
"""

from __future__ import annotations

import math
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from . import arrowtext as at
from .tables import cut, small_batches, table

LEAST = 0.55

#: Texts of licences as their authors publish them, blanks collapsed.
_MIT = """Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the "Software"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions: The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software. THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE."""
_BSD = """Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met: 1. Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer. 2. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution."""
_BSD_NAMES = """3. Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission."""
_BSD_END = """THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS "AS IS" AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED. IN NO EVENT SHALL THE COPYRIGHT HOLDER OR CONTRIBUTORS BE LIABLE FOR ANY DIRECT, INDIRECT, INCIDENTAL, SPECIAL, EXEMPLARY, OR CONSEQUENTIAL DAMAGES (INCLUDING, BUT NOT LIMITED TO, PROCUREMENT OF SUBSTITUTE GOODS OR SERVICES; LOSS OF USE, DATA, OR PROFITS; OR BUSINESS INTERRUPTION) HOWEVER CAUSED AND ON ANY THEORY OF LIABILITY, WHETHER IN CONTRACT, STRICT LIABILITY, OR TORT (INCLUDING NEGLIGENCE OR OTHERWISE) ARISING IN ANY WAY OUT OF THE USE OF THIS SOFTWARE, EVEN IF ADVISED OF THE POSSIBILITY OF SUCH DAMAGE."""
_APACHE_HEADER = """Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file except in compliance with the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0 Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an "AS IS" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied. See the License for the specific language governing permissions and limitations under the License."""
_APACHE_TERMS = """Apache License Version 2.0, January 2004 TERMS AND CONDITIONS FOR USE, REPRODUCTION, AND DISTRIBUTION 1. Definitions. "License" shall mean the terms and conditions for use, reproduction, and distribution as defined by Sections 1 through 9 of this document. "Licensor" shall mean the copyright owner or entity authorized by the copyright owner that is granting the License. "Legal Entity" shall mean the union of the acting entity and all other entities that control, are controlled by, or are under common control with that entity. "Work" shall mean the work of authorship, whether in Source or Object form, made available under the License. "Derivative Works" shall mean any work, whether in Source or Object form, that is based on (or derived from) the Work. "Contribution" shall mean any work of authorship that is intentionally submitted to Licensor for inclusion in the Work. "Contributor" shall mean Licensor and any individual or Legal Entity on behalf of whom a Contribution has been received by Licensor. 2. Grant of Copyright License. Subject to the terms and conditions of this License, each Contributor hereby grants to You a perpetual, worldwide, non-exclusive, no-charge, royalty-free, irrevocable copyright license to reproduce, prepare Derivative Works of, publicly display, publicly perform, sublicense, and distribute the Work and such Derivative Works in Source or Object form. 3. Grant of Patent License. 4. Redistribution. You may reproduce and distribute copies of the Work or Derivative Works thereof in any medium, with or without modifications, and in Source or Object form, provided that You meet the conditions of this License. 5. Submission of Contributions. 6. Trademarks. 7. Disclaimer of Warranty. 8. Limitation of Liability. 9. Accepting Warranty or Additional Liability."""
_GNU = """{this} is free software: you can redistribute it and/or modify it under the terms of the GNU {kind}General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version. {this} is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE. See the GNU {kind}General Public License for more details. You should have received a copy of the GNU {kind}General Public License along with this program. If not, see https://www.gnu.org/licenses/."""
_GNU_2 = """{this} is free software; you can redistribute it and/or modify it under the terms of the GNU {kind}General Public License as published by the Free Software Foundation; either version {version} of the License, or (at your option) any later version. {this} is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE. See the GNU {kind}General Public License for more details. You should have received a copy of the GNU {kind}General Public License along with {that}; if not, write to the Free Software Foundation, Inc., 51 Franklin Street, Fifth Floor, Boston, MA 02110-1301 USA."""

#: Notices and texts of licences. A licence with several has a name and, after a blank, which form it is.
TEMPLATES = {
    "AGPL-3.0 (header)": _GNU.format(this="This program", kind="Affero "),
    "Apache-1.1": "Licensed under the Apache Software License, Version 1.1.",
    "Apache-1.1 (title)": "Apache License, Version 1.1",
    "Apache-2.0 (title)": "Apache License, Version 2.0",
    "Apache-2.0": "Licensed under the Apache License, Version 2.0 (the License); you may not use this file except in compliance with the License.",
    "Apache-2.0 (header)": _APACHE_HEADER,
    "Apache-2.0 (short)": "Licensed under the Apache License, Version 2.0.",
    "Apache-2.0 (terms)": _APACHE_TERMS,
    "BSD-2-Clause (text)": f"{_BSD} {_BSD_END}",
    "BSD-3-Clause": "Redistribution and use in source and binary forms are permitted under the BSD 3-Clause License.",
    "BSD-3-Clause (text)": f"{_BSD} {_BSD_NAMES} {_BSD_END}",
    "CC-BY-4.0": "This work is licensed under a Creative Commons Attribution 4.0 International License, CC BY 4.0.",
    "CC-BY-NC-4.0": "Licensed under CC BY-NC 4.0.",
    "CC0-1.0": "Released to the public domain under CC0 1.0 Universal.",
    "GPL-2.0": "This work is licensed under the GNU General Public License, version 2.",
    "GPL-2.0 (header)": _GNU_2.format(this="This program", that="this program", kind="", version="2"),
    "GPL-2.0 (title)": "GNU GENERAL PUBLIC LICENSE Version 2, June 1991",
    "GPL-3.0 (title)": "GNU GENERAL PUBLIC LICENSE Version 3, 29 June 2007",
    "GPL-3.0": "This work is licensed under the GNU General Public License, version 3.",
    "GPL-3.0 (header)": _GNU.format(this="This program", kind=""),
    "ISC (text)": 'Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies. THE SOFTWARE IS PROVIDED "AS IS" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS.',
    "LGPL-2.1": "This library is licensed under the GNU Lesser General Public License, version 2.1.",
    "LGPL-2.1 (header)": _GNU_2.format(this="This library", that="this library", kind="Lesser ", version="2.1"),
    "LGPL-2.1 (title)": "GNU LESSER GENERAL PUBLIC LICENSE Version 2.1, February 1999",
    "LGPL-3.0 (title)": "GNU LESSER GENERAL PUBLIC LICENSE Version 3, 29 June 2007",
    "LGPL-3.0": "This library is licensed under the GNU Lesser General Public License, version 3.",
    "LGPL-3.0 (header)": _GNU.format(this="This library", kind="Lesser "),
    "MIT": "Released under the MIT License.",
    "MIT (text)": _MIT,
    "MPL-2.0": "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0.",
    "MPL-2.0 (header)": "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not distributed with this file, You can obtain one at https://mozilla.org/MPL/2.0/.",
    "Proprietary": "All rights reserved.",
    **{f"{x} (spdx)": f"SPDX-License-Identifier: {x}" for x in ("AGPL-3.0", "Apache-2.0", "BSD-2-Clause", "BSD-3-Clause", "CC-BY-4.0", "CC0-1.0", "GPL-2.0", "GPL-3.0", "ISC", "LGPL-2.1", "LGPL-3.0", "MIT", "MPL-2.0")},
    **{f"{x} (spdx {form})": f"SPDX-License-Identifier: {x}-{form}" for x in ("AGPL-3.0", "GPL-2.0", "GPL-3.0", "LGPL-2.1", "LGPL-3.0") for form in ("only", "or-later")},
}

#: Licences of several versions; a unit has one of these only if it holds the numbers of its version (a last 0 may be left out).
VERSIONED = ("AGPL", "Apache", "CC-BY", "CC-BY-NC", "CC0", "GPL", "LGPL", "MPL")

#: The template that counts only where no other is close enough: its words stand in other licences' copyright lines.
RESERVED = "Proprietary"
LICENCE_FILE = r"(?i)(^|/)(LICEN[CS]E|COPYING|NOTICE)[^/]*$"
#: What a comment line begins with.
COMMENT = ("#", "//", "/*", "*", ";", "--", "%", "<!--", '"""')
PIECE_BYTES = 1 << 20
_WORD = r"[a-z0-9]+"
_WORD_BYTE = np.zeros(256, bool)
_WORD_BYTE[48:58] = _WORD_BYTE[97:123] = True


def template_weights(templates: dict[str, str] = TEMPLATES) -> tuple[list[tuple[str, str, float]], dict[str, float], float]:
    """(template, word, weight / template norm), idf by word, and the idf of any other word."""
    words = {name: re.findall(_WORD, text.lower()) for name, text in templates.items()}
    df = {w: sum(w in own for own in words.values()) for own in words.values() for w in own}
    idf = {w: math.log(1 + len(templates) / n) for w, n in df.items()}
    rows = []
    for name, own in sorted(words.items()):
        norm = math.sqrt(sum((own.count(w) * idf[w]) ** 2 for w in set(own)))
        rows += [(name, w, own.count(w) * idf[w] / norm) for w in sorted(set(own))]
    return rows, idf, math.log(1 + len(templates))


def needed_words(templates: dict[str, str] = TEMPLATES) -> dict[str, list[str]]:
    """Of each template the numbers of its licence's version, which a unit must hold: 2 of GPL-2.0, 2 and 1 of LGPL-2.1."""
    out = {}
    for name in sorted(templates):
        family, _, version = name.split(" ")[0].rpartition("-")
        out[name] = sorted(set(version.removesuffix(".0").split("."))) if family in VERSIONED else []
    return out


class Scorer:
    """Cosines of the units of texts to the templates, as sparse products."""

    def __init__(self, templates: dict[str, str] = TEMPLATES, least: float = LEAST):
        rows, idf, self.other = template_weights(templates)
        self.names, self.vocabulary, self.least = sorted(templates), sorted(idf), least
        self.reserved = self.names.index(RESERVED) if RESERVED in templates else -1
        self.idf = np.array([idf[w] for w in self.vocabulary])
        self.matrix = np.zeros((len(self.vocabulary), len(self.names)))
        at_word, at_name = {w: n for n, w in enumerate(self.vocabulary)}, {n: k for k, n in enumerate(self.names)}
        for name, word, weight in rows:
            self.matrix[at_word[word], at_name[name]] = weight
        needs = needed_words(templates)
        self.needed = [np.array([at_word[w] for w in needs[n] if w in at_word], np.int64) for n in self.names]
        self.known = pa.array([w.encode() for w in self.vocabulary], pa.binary())

    def cosines(self, word: np.ndarray, unit: np.ndarray, n: int, number: np.ndarray) -> np.ndarray:
        """The cosine of each of n units to its best template, and that template, as two columns. word: codes of words, unit: the unit of each, number: the place of a code in the vocabulary, or -1."""
        pair, tf = np.unique(unit.astype(np.int64) * max(1, number.size) + word, return_counts=True)
        unit, place = pair // max(1, number.size), number[pair % max(1, number.size)]
        weight = tf * np.where(place >= 0, self.idf[np.maximum(place, 0)], self.other)
        norm = np.sqrt(np.bincount(unit, weight * weight, minlength=n))
        inside = place >= 0
        unit, place, weight = unit[inside], place[inside], weight[inside]
        out = np.zeros((n, 2))
        edges = np.searchsorted(unit, np.arange(n + 1))
        heavy = np.bincount(unit, weight * self.matrix.max(1)[place], minlength=n)  # no template can give more
        for u in np.flatnonzero(heavy >= (self.least - 1e-5) * norm).tolist():
            own = slice(edges[u], edges[u + 1])
            if own.start < own.stop:
                dots = np.round(weight[own] @ self.matrix[place[own]] / norm[u], 6)
                near = [k for k in np.flatnonzero(dots >= self.least).tolist() if np.isin(self.needed[k], place[own]).all()]
                if near:
                    best = min(near, key=lambda k: (k == self.reserved, -dots[k], k))
                    out[u] = dots[best], best
        return out

    def best(self, data: np.ndarray, offsets: np.ndarray, whole: np.ndarray) -> list[tuple[str, float] | None]:
        """Of each text the template of the best cosine, if it is close enough. whole: texts that are also compared as a whole."""
        data = at.LOWER[data]
        ends_of = np.flatnonzero(data == 10)
        line_starts = np.unique(np.concatenate([offsets[:-1], ends_of + 1]))
        line_starts = line_starts[line_starts < offsets[-1]]
        inside = _WORD_BYTE[data]
        starts, ends = at.runs(inside, offsets)
        if not starts.size:
            return [None] * (len(offsets) - 1)
        to = np.concatenate([[0], np.cumsum(ends - starts)]).astype(np.int32)
        coded = pa.Array.from_buffers(pa.binary(), starts.size, [None, pa.py_buffer(to), pa.py_buffer(data[inside])]).dictionary_encode()
        number = pc.fill_null(pc.index_in(coded.dictionary, value_set=self.known), -1).to_numpy(zero_copy_only=False).astype(np.int64)
        word = coded.indices.to_numpy().astype(np.int64)
        line, text = np.searchsorted(line_starts, starts, "right") - 1, np.searchsorted(offsets, starts, "right") - 1
        of_line = np.searchsorted(offsets, line_starts, "right") - 1
        rounds = [(word, line, line_starts.size, of_line)]
        block = self._blocks(data, line_starts, of_line)
        if (block >= 0).any():
            own = block[line] >= 0
            n = int(block.max()) + 1
            owner = np.zeros(n, np.int64)
            owner[block[block >= 0]] = of_line[block >= 0]
            rounds.append((word[own], block[line[own]], n, owner))
        own = whole[text]
        if own.any():
            rounds.append((word[own], text[own], len(offsets) - 1, np.arange(len(offsets) - 1)))
        best: list[tuple[bool, float, int] | None] = [None] * (len(offsets) - 1)
        for words, unit, n, owner in rounds:
            found = self.cosines(words, unit, n, number)
            for u in np.flatnonzero(found[:, 0] >= self.least).tolist():
                mine = (int(found[u, 1]) == self.reserved, -found[u, 0], int(found[u, 1]))
                d = int(owner[u])
                best[d] = mine if best[d] is None else min(best[d], mine)
        return [None if b is None else (self.names[b[2]], -b[1]) for b in best]

    @staticmethod
    def _blocks(data: np.ndarray, line_starts: np.ndarray, of_line: np.ndarray) -> np.ndarray:
        """The number of each line's block of two and more neighbouring comment lines of a text, or -1."""
        shown = np.flatnonzero(~at.BLANK[data])
        first = np.searchsorted(shown, line_starts)
        begin = np.where(first < shown.size, shown[np.minimum(first, shown.size - 1)], data.size) if shown.size else np.full(line_starts.size, data.size)
        limit = np.append(line_starts[1:], data.size)
        comment = np.zeros(line_starts.size, bool)
        for sign in COMMENT:
            like = begin + len(sign) <= limit
            for k, c in enumerate(sign.encode()):
                like &= data[np.minimum(begin + k, data.size - 1)] == c
            comment |= like
        new = comment.copy()
        new[1:] &= ~comment[:-1] | (of_line[1:] != of_line[:-1])
        block = np.where(comment, np.cumsum(new) - 1, -1)
        size = np.bincount(block[comment], minlength=int(new.sum()))
        return np.where((block >= 0) & (size[np.maximum(block, 0)] >= 2) if size.size else False, block, -1)


def header_licences(files: DataFrame, templates: dict[str, str] = TEMPLATES, least: float = LEAST) -> DataFrame:
    """file, licence and cosine of the rows (file, path, text) of which a line, a block of comment lines or, in a licence file, the whole text is close enough to a template."""
    small_batches(files.sparkSession)
    sent = files.sparkSession.sparkContext.broadcast(Scorer(templates, least))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows, data, offsets in at.pieces(batches, "text", PIECE_BYTES):
            found = sent.value.best(data, offsets, rows.column(1).to_numpy(zero_copy_only=False).astype(bool))
            kept = [n for n, f in enumerate(found) if f]
            columns = [rows.column(0).take(pa.array(kept, pa.int64())), pa.array([found[n][0].split(" ")[0] for n in kept], pa.string()), pa.array([found[n][1] for n in kept], pa.float64())]
            yield pa.RecordBatch.from_arrays(columns, names=["file", "licence", "cosine"])

    whole = F.coalesce(F.col("path").rlike(LICENCE_FILE), F.lit(False))
    narrow = files.select("file", whole.alias("whole"), "text")
    return narrow.mapInArrow(run, f"file {narrow.schema['file'].dataType.simpleString()}, licence string, cosine double")


def _directory(path: Column) -> Column:
    return F.regexp_extract(path, r"^(.*/)?[^/]*$", 1)


def scan_licences(files: DataFrame, templates: dict[str, str] = TEMPLATES, least: float = LEAST) -> DataFrame:
    """files: file (unique id), path, text. Returns file, path, licence, cosine, how (header, inherited, none) and origin, the directory it comes from."""
    own = cut(header_licences(files.select("file", "path", "text"), templates, least))
    told = files.select("file", "path", _directory(F.col("path")).alias("dir")).join(own, "file", "left")
    holders = told.where(F.col("licence").isNotNull() & F.col("path").rlike(LICENCE_FILE))
    licensed = holders.groupBy("dir").agg(F.min_by("licence", F.struct(-F.col("cosine"), "path", "licence")).alias("dir_licence"))
    # each directory and its ancestors, "a/b/" -> "a/b/", "a/", ""
    parts = F.split("dir", "/")
    levels = F.transform(F.sequence(F.lit(0), F.size(parts) - 1), lambda n: F.struct(n.alias("depth"), F.when(n == 0, "").otherwise(F.concat(F.array_join(F.slice(parts, 1, n), "/"), F.lit("/"))).alias("above")))
    dirs = told.where("path is not null").select("dir").distinct()
    above = dirs.select("dir", F.explode(levels).alias("x")).select("dir", "x.depth", "x.above")
    nearest = above.join(licensed.withColumnRenamed("dir", "above"), "above").groupBy("dir").agg(F.max_by(F.struct("above", "dir_licence"), "depth").alias("n")).withColumnRenamed("dir", "near_dir")
    found = told.join(nearest, F.expr("dir = near_dir and licence is null and path is not null"), "left")
    return found.select(
        "file",
        "path",
        F.coalesce("licence", "n.dir_licence").alias("licence"),
        "cosine",
        F.when(F.col("licence").isNotNull(), "header").when(F.col("n").isNotNull(), "inherited").otherwise("none").alias("how"),
        F.when(F.col("licence").isNotNull(), F.col("dir")).otherwise(F.col("n.above")).alias("origin"),
    )


def document_paths(docs: DataFrame) -> DataFrame:
    """documents as a tree of files: source / thousands / hundreds of the id; each tenth id is a LICENSE file two levels up, ids that end in 5 are one level up."""
    k, top, sub = F.col("doc_id"), F.floor(F.col("doc_id") / 1000), F.floor(F.col("doc_id") / 100)
    name = F.concat(F.lit("LICENSE-"), k)
    path = F.when(k % 10 == 0, F.concat_ws("/", "source", name)).when(k % 10 == 5, F.concat_ws("/", "source", top, name)).otherwise(F.concat_ws("/", "source", top, sub, F.concat(k, F.lit(".txt"))))
    return docs.select(F.col("doc_id").alias("file"), path.alias("path"), "text")


def op3_licences(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scan_licences(document_paths(table(spark, sf_dir, "documents"))).withColumnRenamed("file", "doc_id")


def _sql() -> str:
    weights, idf, other = template_weights()
    known = ", ".join(f"('{n}', '{w}', {x!r}::DOUBLE)" for n, w, x in weights)
    scale = ", ".join(f"('{w}', {x!r}::DOUBLE)" for w, x in sorted(idf.items()))
    blanks = " || ".join(f"chr({n})" for n in (32, 9, 11, 12, 13))
    need = ", ".join(f"('{n}', '{w}')" for n, words in needed_words().items() for w in words)
    comment = " OR ".join(f"starts_with(ltrim(line, {blanks}), '{sign}')" for sign in COMMENT)
    return f"""
WITH known(licence, word, weight) AS (VALUES {known}), scale(word, idf) AS (VALUES {scale}), need(licence, word) AS (VALUES {need}),
f AS (SELECT doc_id, text, CASE WHEN doc_id % 10 = 0 THEN concat(source, '/LICENSE-', doc_id)
  WHEN doc_id % 10 = 5 THEN concat(source, '/', doc_id // 1000, '/LICENSE-', doc_id)
  ELSE concat(source, '/', doc_id // 1000, '/', doc_id // 100, '/', doc_id, '.txt') END AS path FROM documents),
ln AS (SELECT doc_id, i, l[i] AS line FROM (SELECT doc_id, l, unnest(range(1, len(l) + 1)) AS i FROM (SELECT doc_id, string_split(text, chr(10)) AS l FROM f WHERE text IS NOT NULL))),
cm AS (SELECT doc_id, i, line, i - row_number() OVER (PARTITION BY doc_id ORDER BY i) AS block FROM ln WHERE {comment}),
h AS (SELECT DISTINCT doc_id, header FROM (SELECT doc_id, line AS header FROM ln
  UNION ALL SELECT doc_id, string_agg(line, ' ' ORDER BY i) FROM cm GROUP BY doc_id, block HAVING count(*) > 1
  UNION ALL SELECT doc_id, text FROM f WHERE text IS NOT NULL AND regexp_matches(path, '{LICENCE_FILE}'))),
w AS (SELECT header, word, count(*) AS tf FROM (SELECT header, unnest(regexp_extract_all(translate(header, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '{_WORD}')) AS word FROM (SELECT DISTINCT header FROM h)) GROUP BY ALL),
x AS (SELECT header, word, tf * coalesce(idf, {other!r}::DOUBLE) AS w FROM w LEFT JOIN scale USING (word)),
n AS (SELECT header, sqrt(sum(w * w)) AS norm FROM x GROUP BY header),
c AS (SELECT header, licence, round(sum(w * weight) / any_value(norm), 6) AS cosine FROM x JOIN known USING (word) JOIN n USING (header) GROUP BY header, licence),
lacks AS (SELECT c.header, licence FROM c JOIN need USING (licence) LEFT JOIN w ON w.header = c.header AND w.word = need.word WHERE w.word IS NULL GROUP BY ALL),
own AS (SELECT doc_id, split_part(licence, ' ', 1) AS licence, cosine FROM h JOIN (SELECT * FROM c ANTI JOIN lacks USING (header, licence)) c USING (header) WHERE cosine >= {LEAST} QUALIFY row_number() OVER (PARTITION BY doc_id ORDER BY c.licence = '{RESERVED}', cosine DESC, c.licence) = 1),
t AS (SELECT f.doc_id, path, regexp_extract(path, '^(.*/)?[^/]*$', 1) AS dir, licence, cosine FROM f LEFT JOIN own USING (doc_id)),
l AS (SELECT dir AS above, licence AS dir_licence FROM t WHERE licence IS NOT NULL AND regexp_matches(path, '{LICENCE_FILE}') QUALIFY row_number() OVER (PARTITION BY dir ORDER BY cosine DESC, path, licence) = 1),
near AS (SELECT d.dir, above, dir_licence FROM (SELECT DISTINCT dir FROM t) d JOIN l ON starts_with(d.dir, above) QUALIFY row_number() OVER (PARTITION BY d.dir ORDER BY length(above) DESC) = 1)
SELECT doc_id, path, coalesce(licence, dir_licence) AS licence, cosine, CASE WHEN licence IS NOT NULL THEN 'header' WHEN near.dir IS NOT NULL THEN 'inherited' ELSE 'none' END AS how,
  CASE WHEN licence IS NOT NULL THEN t.dir ELSE above END AS origin
FROM t LEFT JOIN near ON t.dir = near.dir AND t.licence IS NULL
"""


OP3_SQL = _sql()
