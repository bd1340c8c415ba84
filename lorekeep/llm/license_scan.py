"""Licence scan: sparse TF-IDF cosine of headers and licence files to templates, then inheritance by directories.

A file is compared as a whole, by its header (the comment it starts with), its paragraphs, and their lines and sentences.
Frequencies of the templates' terms are counted over all of these units of all files; a term of no template counts as
if one unit had it. What two units have in common with a template is bounded by their terms, so units that cannot reach the
threshold whatever the frequencies are dropped as they are read, and no other.
"""

from __future__ import annotations

import re
from array import array
from collections import Counter
from collections.abc import Iterator

import numpy as np
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import add_by_batch, bound_batches, stored, table

#: Names of licences and the sentences that stand for them in headers and licence files.
TEMPLATES = [
    ("Apache-2.0", "Licensed under the Apache License, Version 2.0"),
    ("Apache-2.0", "you may not use this file except in compliance with the License"),
    ("Apache-2.0", "SPDX-License-Identifier: Apache-2.0"),
    ("BSD-2-Clause", "SPDX-License-Identifier: BSD-2-Clause"),
    ("BSD-3-Clause", "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met"),
    ("BSD-3-Clause", "SPDX-License-Identifier: BSD-3-Clause"),
    ("CC-BY-4.0", "This work is licensed under a Creative Commons Attribution 4.0 International License"),
    ("CC-BY-4.0", "Licensed under CC BY 4.0"),
    ("CC-BY-NC-4.0", "Licensed under CC BY-NC 4.0"),
    ("CC-BY-NC-4.0", "This work is licensed under a Creative Commons Attribution-NonCommercial 4.0 International License"),
    ("CC-BY-SA-4.0", "Licensed under CC BY-SA 4.0"),
    ("CC0-1.0", "To the extent possible under law, the author has waived all copyright and related or neighboring rights to this work"),
    ("GPL-2.0", "This work is licensed under the GNU General Public License, version 2"),
    ("GPL-3.0", "This work is licensed under the GNU General Public License, version 3"),
    ("GPL-3.0", "SPDX-License-Identifier: GPL-3.0-or-later"),
    ("LGPL-3.0", "under the terms of the GNU Lesser General Public License, version 3"),
    ("AGPL-3.0", "under the terms of the GNU Affero General Public License, version 3"),
    ("MIT", "Released under the MIT License"),
    ("MIT", "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files"),
    ("MIT", "SPDX-License-Identifier: MIT"),
    ("MPL-2.0", "This Source Code Form is subject to the terms of the Mozilla Public License, version 2.0"),
]
_GNU = "This {0} is free software; you can redistribute it and/or modify it under the terms of the GNU {1} as published by the Free Software Foundation; either version {2} of the License, or (at your option) any later version."
_GNU_ONLY = "This {0} is free software; you can redistribute it and/or modify it under the terms of the GNU {1} version {2} as published by the Free Software Foundation."
for _n, _l, _v, _d in (("GPL-2.0", "General Public License", "2", "June 1991"), ("GPL-3.0", "General Public License", "3", "29 June 2007"), ("LGPL-2.1", "Lesser General Public License", "2.1", "February 1999"), ("LGPL-3.0", "Lesser General Public License", "3", "29 June 2007"), ("AGPL-3.0", "Affero General Public License", "3", "19 November 2007")):
    # heads of whole licence files, and the paragraph that headers have
    TEMPLATES += [(_n, f"GNU {_l} Version {_v}, {_d}")] + [(_n, t.format(w, _l, _v)) for t in (_GNU, _GNU_ONLY) for w in ("program", "library")] + [(_n, f"SPDX-License-Identifier: {_n}-{w}") for w in ("only", "or-later")]
for _n, _t in (("CC-BY-4.0", "Attribution"), ("CC-BY-SA-4.0", "Attribution-ShareAlike"), ("CC-BY-NC-4.0", "Attribution-NonCommercial"), ("CC-BY-ND-4.0", "Attribution-NoDerivatives"), ("CC-BY-NC-SA-4.0", "Attribution-NonCommercial-ShareAlike"), ("CC-BY-NC-ND-4.0", "Attribution-NonCommercial-NoDerivatives")):
    TEMPLATES += [(_n, f"{_t} 4.0 International"), (_n, f"Creative Commons {_t} 4.0 International Public License"), (_n, f"This work is licensed under a Creative Commons {_t} 4.0 International License"), (_n, f"Licensed under {_n.replace('CC-BY', 'CC BY').replace('-4.0', ' 4.0')}")]
TEMPLATES += [
    ("Apache-2.0", "Apache License Version 2.0, January 2004 http://www.apache.org/licenses/"),
    ("Apache-2.0", 'Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file except in compliance with the License.'),
    ("CC0-1.0", "Creative Commons CC0 1.0 Universal"),
    ("CC0-1.0", "CC0 1.0 Universal"),
    ("EPL-1.0", "Eclipse Public License - v 1.0"),
    ("EPL-2.0", "Eclipse Public License - v 2.0"),
    ("EPL-1.0", "This program and the accompanying materials are made available under the terms of the Eclipse Public License v1.0 which accompanies this distribution, and is available at http://www.eclipse.org/legal/epl-v10.html"),
    ("EPL-2.0", "This program and the accompanying materials are made available under the terms of the Eclipse Public License 2.0 which is available at https://www.eclipse.org/legal/epl-2.0/"),
    ("ISC", "ISC License"),
    ("ISC", "SPDX-License-Identifier: ISC"),
    ("ISC", "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies."),
    ("MIT", "MIT License"),
    ("MIT", "The MIT License (MIT)"),
    ("MIT", 'Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the "Software"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions:'),
    ("MPL-2.0", "Mozilla Public License Version 2.0"),
    ("MPL-2.0", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0."),
    ("MPL-2.0", "SPDX-License-Identifier: MPL-2.0"),
]
TEMPLATES = list(dict.fromkeys(TEMPLATES))
_BSD = "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met: 1. Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer. 2. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution. "
_BSD_3 = "3. Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission. "
_BSD_END = 'THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS "AS IS" AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED. IN NO EVENT SHALL THE COPYRIGHT HOLDER OR CONTRIBUTORS BE LIABLE FOR ANY DIRECT, INDIRECT, INCIDENTAL, SPECIAL, EXEMPLARY, OR CONSEQUENTIAL DAMAGES (INCLUDING, BUT NOT LIMITED TO, PROCUREMENT OF SUBSTITUTE GOODS OR SERVICES; LOSS OF USE, DATA, OR PROFITS; OR BUSINESS INTERRUPTION) HOWEVER CAUSED AND ON ANY THEORY OF LIABILITY, WHETHER IN CONTRACT, STRICT LIABILITY, OR TORT (INCLUDING NEGLIGENCE OR OTHERWISE) ARISING IN ANY WAY OUT OF THE USE OF THIS SOFTWARE, EVEN IF ADVISED OF THE POSSIBILITY OF SUCH DAMAGE.'
#: Whole texts of the short licences.
TEXTS = [
    ("BSD-2-Clause", _BSD + _BSD_END),
    ("BSD-3-Clause", _BSD + _BSD_3 + _BSD_END),
    ("ISC", 'Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies. THE SOFTWARE IS PROVIDED "AS IS" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS. IN NO EVENT SHALL THE AUTHOR BE LIABLE FOR ANY SPECIAL, DIRECT, INDIRECT, OR CONSEQUENTIAL DAMAGES OR ANY DAMAGES WHATSOEVER RESULTING FROM LOSS OF USE, DATA OR PROFITS, WHETHER IN AN ACTION OF CONTRACT, NEGLIGENCE OR OTHER TORTIOUS ACTION, ARISING OUT OF OR IN CONNECTION WITH THE USE OR PERFORMANCE OF THIS SOFTWARE.'),
    ("MIT", 'Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the "Software"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions: The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software. THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE.'),
]
#: Terms; what stands before the text of a line in comments; the comment that a file starts with; between paragraphs. All
#: mean the same to Python and to DuckDB.
TERM = r"[a-z0-9]+(?:\.[0-9]+)*"
COMMENT = r"""(?m)^[ \t]*(?:(?:/\*+|\*+/|\*+|//+|#+|--+|;+|%+|<!--|"{3}|'{3})[ \t]*)?"""
HEADER = r"^[ \t\n]*(?:/\*(?s:.*?)\*/|<!--(?s:.*?)-->|(?:(?:#|//|--|;|%)[^\n]*\n[ \t\n]*)+)"
GAP = r"\n(?:[ \t]*\n)+"
STOP = r"([.!?])[ \t]+"
LICENCE_FILES = r"(?i)(?:^|/)(?:UN)?(?:LICEN[SC]E|COPYING|COPYRIGHT|NOTICE)[^/]*$"


_FOLD = {c: c + 32 for c in range(65, 91)}
_TERMS, _COMMENT, _HEADER, _GAP, _STOP = (re.compile(x) for x in (TERM, COMMENT, HEADER, GAP, STOP))


class Units:
    """Counts of the terms of a file's units. Terms of templates have numbers; all others count as unknown."""

    def __init__(self, least: float):
        self.least = least
        self.bags = [Counter(_TERMS.findall(t.translate(_FOLD))) for _, t in TEMPLATES + TEXTS]
        self.number = {t: i for i, t in enumerate(sorted({t for b in self.bags for t in b}))}

    def split(self, terms: list[str]) -> tuple[list[int], list[str]]:
        """Numbers of the known terms, and the unknown ones."""
        numbers = list(map(self.number.get, terms))
        known = [n for n in numbers if n is not None]
        return known, terms if not known else [t for t, n in zip(terms, numbers, strict=True) if n is None]

    def of(self, text: str) -> Iterator[tuple[list[int], list[str], int]]:
        """(numbers of the known terms, the unknown ones, how many units are the same) for all units of a whole text that
        have terms. A line that is a sentence, a paragraph or the file as well is one of these that counts so often."""
        text = re.sub(r"\r\n?", "\n", text.translate(_FOLD)) + "\n"
        head = _HEADER.match(text)
        if head and (terms := _TERMS.findall(head[0])):
            yield *self.split(terms), 1
        parts: list[list] = []  # of the file: known, unknown, times
        for paragraph in _GAP.split(_COMMENT.sub("", text)):
            first = start = len(parts)
            for line in paragraph.split("\n"):
                for part in _STOP.sub("\\1\n", line).split("\n") if "." in line or "!" in line or "?" in line else [line]:
                    if terms := _TERMS.findall(part):
                        parts.append([*self.split(terms), 1])
                    if part.endswith((".", "!", "?")):
                        yield from self._joined(parts, start)
                        start = len(parts)
            yield from self._joined(parts, start)
            yield from self._joined(parts, first)
        yield from self._joined(parts, 0)
        yield from map(tuple, parts)

    @staticmethod
    def _joined(parts: list[list], start: int) -> Iterator[tuple[list[int], list[str], int]]:
        """The unit of all parts from start on; of a single part, it counts once more instead."""
        if len(parts) == start + 1:
            parts[start][2] += 1
        elif len(parts) > start:
            yield [n for p in parts[start:] for n in p[0]], [t for p in parts[start:] for t in p[1]], 1

    def vector(self, known: list[int], unknown: list[str]) -> tuple[list[int], list[int], int] | None:
        """(numbers, counts, sum of squared counts of unknown terms), or None if no frequencies bring the unit near a template.

        The cosine is at most the root of the known terms' share of the squared weights, and no known term weighs more
        than an unknown one.
        """
        room = 1 / self.least**2 - 1
        if not known or len(unknown) > room * len(known) ** 2:
            return None
        counts = Counter(known)
        if len(unknown) > (most := room * sum(n * n for n in counts.values())):
            return None
        squares = sum(n * n for n in Counter(unknown).values())
        return (list(counts), list(counts.values()), squares) if squares <= most else None


class Scorer:
    """Cosines with all templates, given the number of units and of those that have each term."""

    def __init__(self, units: Units, total: int, df: np.ndarray):
        matrix = np.zeros((len(units.bags), len(units.number)))
        for i, b in enumerate(units.bags):
            for t, n in b.items():
                matrix[i, units.number[t]] = n
        total += len(units.bags)
        self.idf = np.log((total + 1) / (df + (matrix > 0).sum(0) + 1)) + 1
        self.unknown = np.log((total + 1) / 2) + 1
        weights = matrix * self.idf
        self.templates = weights / np.sqrt((weights**2).sum(1, keepdims=True))
        self.least = units.least

    def best(self, ids: list[int], counts: list[int], unknown: int) -> tuple | None:
        """(0 for a whole licence text, else 1; minus the score; the name) of the nearest template, if it is near enough."""
        x = np.array(counts) * self.idf[ids]
        known, norm = (x * x).sum(), (x * x).sum() + unknown * self.unknown**2
        if known < (self.least - 1e-6) ** 2 * norm:  # the known terms' share bounds the cosine
            return None
        score = np.minimum(1.0, np.round(self.templates[:, ids] @ x / np.sqrt(norm), 9))
        found = [(int(i < len(TEMPLATES)), -float(score[i]), (TEMPLATES + TEXTS)[i][0]) for i in np.flatnonzero(score >= self.least)]
        return min(found, default=None)


CANDIDATES = T.StructType(
    [T.StructField("path", T.StringType(), True), T.StructField("vectors", T.ArrayType(T.ArrayType(T.IntegerType(), False), False), True)]
    + [T.StructField("units", T.LongType(), True), T.StructField("df", T.ArrayType(T.LongType(), False), True)]
)


def own_licences(files: DataFrame, path: str = "path", text: str = "text", least: float = 0.75) -> DataFrame:
    """path, licence, score for every file of which a unit is near enough to a template: the best one.

    Units are the file, its header, its paragraphs (which end at empty lines, comment marks aside), their lines and their
    sentences (which end at a full stop before a blank or a line's end). A licence found by a whole licence text comes
    before all others; then the best score, then the first name. Null paths and texts, and texts without terms, give no row;
    rows with equal paths count as one file. Files are read once, whole, and what goes on are the counts of units that may
    be near enough.
    """
    import pyarrow as pa

    units = Units(least)
    bound_batches(files.sparkSession)

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark.sql.pandas.types import to_arrow_schema

        schema = to_arrow_schema(CANDIDATES)
        for b in batches:
            total, seen, paths, found = 0, array("i"), [], []
            for p, t in zip(b.column(0).to_pylist(), b.column(1), strict=True):
                vectors = []
                for known, unknown, times in units.of(t.as_py()):
                    total += times
                    if known:
                        for _ in range(times):
                            seen.extend(set(known))
                        if v := units.vector(known, unknown):
                            vectors.append([v[2], *(x for pair in zip(v[0], v[1], strict=True) for x in pair)])
                if vectors:
                    paths.append(p)
                    found.append(vectors)
            df = np.bincount(np.frombuffer(seen, np.int32) if seen else [], minlength=len(units.number))
            # a row of frequencies for each batch
            yield pa.RecordBatch.from_pydict({"path": [*paths, None], "vectors": [*found, None], "units": [None] * len(paths) + [total], "df": [None] * len(paths) + [df.tolist()]}, schema=schema)

    whole = files.select(F.col(f"`{path}`").cast("string").alias("path"), F.col(f"`{text}`").alias("text")).where("path is not null and text is not null")
    rows = stored(whole.mapInArrow(read, CANDIDATES), "candidates")
    total = rows.agg(F.sum("units").alias("n")).first().n or 0
    counted = {r.pos: r.n for r in rows.where("units is not null").select(F.posexplode("df").alias("pos", "x")).groupBy("pos").agg(F.sum("x").alias("n")).collect()}  # terms of the templates
    scorer = files.sparkSession.sparkContext.broadcast(Scorer(units, total, np.array([counted.get(i, 0) for i in range(len(units.number))])))

    def score():
        def run(column):
            out = []
            for vectors in column.to_pylist():
                best = [b for v in vectors if (b := scorer.value.best(v[1::2], v[2::2], v[0]))]
                out.append(min(best, default=None))
            return [[b and b[0] for b in out], [b and -b[1] for b in out], [b and b[2] for b in out]]

        return run

    fields = [T.StructField("part", T.IntegerType()), T.StructField("score", T.DoubleType()), T.StructField("licence", T.StringType())]
    scored = add_by_batch(rows.where("path is not null").select("path", "vectors"), ["vectors"], fields, score).where("licence is not null")
    return scored.groupBy("path").agg(F.min_by(F.struct("licence", "score"), F.struct("part", -F.col("score"), F.col("licence"))).alias("l")).select("path", "l.licence", "l.score")


def licences(files: DataFrame, path: str = "path", text: str = "text", least: float = 0.75) -> DataFrame:
    """path, licence, score, licence_from for every path: its own licence, else that of the licence file in the nearest
    directory above it, else nulls. A directory with several licence files takes the best score, then the first name."""
    own = stored(own_licences(files, path, text, least), "licences")
    every = files.where(F.col(f"`{path}`").isNotNull()).select(F.col(f"`{path}`").alias("path")).distinct()
    directory = F.when(F.instr("path", "/") > 0, F.regexp_replace("path", r"/[^/]*$", "")).otherwise("")
    holders = own.where(F.col("path").rlike(LICENCE_FILES)).select(directory.alias("dir"), "licence", "score", F.col("path").alias("licence_from"))
    rank = F.row_number().over(Window.partitionBy("dir").orderBy(F.desc("score"), "licence", "licence_from"))
    holders = stored(holders.withColumn("r", rank).where("r = 1").drop("r"), "holders")
    bare = stored(every.join(own.select("path"), "path", "left_anti").select("path", directory.alias("dir")), "bare")
    # directories, not files, look for their ancestors: a crowded directory asks once
    dirs = bare.select("dir").distinct().withColumn("parts", F.split("dir", "/"))
    up = F.transform(F.sequence(F.lit(0), F.size("parts")), lambda k: F.struct(k.alias("depth"), F.array_join(F.slice(F.col("parts"), 1, k), "/").alias("above")))
    asked = dirs.select("dir", F.explode(up).alias("u")).select("dir", "u.depth", "u.above")
    met = asked.join(holders.withColumnRenamed("dir", "above"), "above")
    nearest = met.groupBy("dir").agg(F.max_by(F.struct("licence", "score", "licence_from"), "depth").alias("l")).select("dir", "l.*")
    inherited = bare.join(nearest, "dir", "left").select("path", "licence", "score", "licence_from")
    return own.select("path", "licence", "score", F.col("path").alias("licence_from")).unionAll(inherited)


def op9_query(spark, sf_dir: str) -> DataFrame:
    """Licences of all documents as files of a tree: a source's folders of 1,000 and of 100 ids. The document whose id is
    divisible by 100 counts as the licence file of its folder. Documents without an id are one file of their source's folder
    `none`, as rows with one id are one file; each row gets its file's licence."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "source", "text")
    ids = F.coalesce(F.floor(F.col("doc_id") / 1000).cast("string"), F.lit("none")), F.coalesce(F.floor(F.col("doc_id") / 100).cast("string"), F.lit("none"))
    folder = F.concat_ws("/", F.coalesce("source", F.lit("none")), *ids)
    name = F.when(F.col("doc_id") % 100 == 0, F.concat(F.lit("LICENSE."), F.col("doc_id").cast("string"))).otherwise(F.concat(F.coalesce(F.col("doc_id").cast("string"), F.lit("none")), F.lit(".txt")))
    files = docs.select("doc_id", F.concat_ws("/", folder, name).alias("path"), "text")
    found = licences(files.select("path", "text"))
    return files.select("doc_id", "path").join(found, "path").select("doc_id", "path", "licence", "score", "licence_from")
