"""License scans: TF-IDF cosine of headers and licence files to templates, then inheritance from the nearest ancestor directory.

1. A text is cut into pieces at line ends and sentence ends; pieces without a term don't count. Every window of so many pieces that follow each other as WINDOWS
   says is compared with every template, so a notice that is wrapped over lines, stands in a comment, or beside other prose is seen as a
   whole; a licence file, and any text with no more pieces than the largest window, is compared as a whole, too. Weights are term count times ln((1 + templates) / (1 + templates with the term)) + 1, so
   they don't depend on the corpus. Windows count from a cosine of `least` on; of these a file gets the license that matches most weight (the
   product of the window with the unit template), so that a license isn't taken for a shorter one that it contains. A window that names versions, none of
   which the template has, though it has some, isn't compared with it. A file with an SPDX line has the license expression that it states, read exactly, with similarity 1:
   identifiers joined by OR, AND and WITH stay as they are.
2. Bounds spare most windows the exact comparison: products are sums over pieces, and the norm is at least that of counts 1. They are computed for
   all windows at once in numpy; only a window whose bound reaches `least` is counted.
3. A licence file (LICENSE..., LICENCE..., COPYING...) with a license declares it for its directory: of several the most similar one, then the
   least path.
4. Distinct directories are joined with the declarations of their ancestors, themselves included, and take the deepest. Files without a
   license of their own get that of their directory. Scored rows are written once and read three times; only paths and names go
   through the joins; a hot directory, or a root with many below it, is dealt to as many tasks as it needs.

Cases: a null or empty text has no license of its own. A very long text is read to its end, SLICE characters' worth of texts at a time. A null path is in
no directory: it neither declares nor inherits. Equal paths and repeated rows are each a file. Equal weights go to the higher similarity, then to the license's least name. Null
or equal ids make no difference. Columns of the input may have any names: only id, path and text are read. An empty table gives no row.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from leadmill.llm.common import join_dealt, reliable, whole_text
from leadmill.llm.pieces import slices

_MIT = """Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the "Software"), to deal in the Software without restriction, including without limitation the rights to use, copy,
modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions: The above copyright notice and this permission notice shall be included in
all copies or substantial portions of the Software. THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT
SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE."""
_ISC = """Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies."""
_BSD = """Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met: 1. Redistributions of source code must retain the above copyright notice, this list of conditions and the following
disclaimer. 2. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution."""
_BSD_3 = _BSD + """ 3. Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission."""
_APACHE = """Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file except in compliance with the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0 Unless required by applicable law or agreed
to in writing, software distributed under the License is distributed on an "AS IS" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied. See the License for the specific language governing permissions and limitations under the License."""
_GNU = "This program is free software: you can redistribute it and/or modify it under the terms of the GNU {} as published by the Free Software Foundation, either version {} of the License, or (at your option) any later version."
_LGPL_21 = "This library is free software; you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License as published by the Free Software Foundation; either version 2.1 of the License, or (at your option) any later version."
_ONLY = "This program is free software; you can redistribute it and/or modify it under the terms of the GNU {} version {} as published by the Free Software Foundation."
_GPL_BEGIN = "Everyone is permitted to copy and distribute verbatim copies of this license document, but changing it is not allowed. Preamble The licenses for most software are designed to take away your freedom to share and change it."
_0BSD = 'Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted. THE SOFTWARE IS PROVIDED "AS IS" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS.'
_BOOST = 'Boost Software License - Version 1.0 - August 17th, 2003 Permission is hereby granted, free of charge, to any person or organization obtaining a copy of the software and accompanying documentation covered by this license (the "Software") to use, reproduce, display, distribute, execute, and transmit the Software, and to prepare derivative works of the Software'
_EPL = "This program and the accompanying materials are made available under the terms of the Eclipse Public License 2.0 which is available at https://www.eclipse.org/legal/epl-2.0/"

#: SPDX ids, and texts by which files declare them: titles, notices, headers, and whole short licenses.
TEMPLATES = (
    ("MIT", "MIT License"),
    ("MIT", "The MIT License (MIT)"),
    ("MIT", "Released under the MIT License."),
    ("MIT", "Licensed under the MIT license. See LICENSE in the project root for license information."),
    ("MIT", "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files"),
    ("MIT", _MIT),
    ("ISC", _ISC),
    ("Apache-2.0", "Licensed under the Apache License, Version 2.0."),
    ("Apache-2.0", 'Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file except in compliance with the License.'),
    ("Apache-2.0", _APACHE),
    ("Apache-2.0", "Apache License Version 2.0, January 2004 http://www.apache.org/licenses/"),
    ("GPL-3.0", "This work is licensed under the GNU General Public License, version 3."),
    ("GPL-3.0-or-later", _GNU.format("General Public License", 3)),
    ("GPL-3.0-only", _ONLY.format("General Public License", 3)),
    ("GPL-3.0", "GNU GENERAL PUBLIC LICENSE Version 3, 29 June 2007"),
    ("GPL-3.0", "GNU GENERAL PUBLIC LICENSE Version 3, 29 June 2007 Copyright (C) 2007 Free Software Foundation, Inc. " + _GPL_BEGIN.replace("most software", "most software and other practical works")),
    ("GPL-2.0", "This work is licensed under the GNU General Public License, version 2."),
    ("GPL-2.0-or-later", _GNU.format("General Public License", 2)),
    ("GPL-2.0-only", _ONLY.format("General Public License", 2)),
    ("GPL-2.0", "GNU GENERAL PUBLIC LICENSE Version 2, June 1991"),
    ("GPL-2.0", "GNU GENERAL PUBLIC LICENSE Version 2, June 1991 Copyright (C) 1989, 1991 Free Software Foundation, Inc. " + _GPL_BEGIN),
    ("LGPL-3.0", "Licensed under the GNU Lesser General Public License, version 3."),
    ("LGPL-3.0-or-later", _GNU.format("Lesser General Public License", 3)),
    ("LGPL-3.0", "GNU LESSER GENERAL PUBLIC LICENSE Version 3, 29 June 2007"),
    ("LGPL-2.1", "Licensed under the GNU Lesser General Public License, version 2.1."),
    ("LGPL-2.1-or-later", _LGPL_21),
    ("LGPL-2.1", "GNU LESSER GENERAL PUBLIC LICENSE Version 2.1, February 1999"),
    ("AGPL-3.0", "Licensed under the GNU Affero General Public License, version 3."),
    ("AGPL-3.0-or-later", _GNU.format("Affero General Public License", 3)),
    ("AGPL-3.0", "GNU AFFERO GENERAL PUBLIC LICENSE Version 3, 19 November 2007"),
    ("EPL-2.0", _EPL),
    ("EPL-2.0", "Eclipse Public License - v 2.0"),
    ("BSL-1.0", _BOOST),
    ("BSL-1.0", "Distributed under the Boost Software License, Version 1.0. (See accompanying file LICENSE_1_0.txt or copy at http://www.boost.org/LICENSE_1_0.txt)"),
    ("0BSD", _0BSD),
    ("0BSD", "BSD Zero Clause License"),
    ("BSD-2-Clause", _BSD),
    ("BSD-3-Clause", _BSD_3),
    ("BSD-3-Clause", "Redistribution and use in source and binary forms, with or without modification, are permitted under the BSD license"),
    ("BSD-3-Clause", "Use of this source code is governed by a BSD-style license that can be found in the LICENSE file."),
    ("MPL-2.0", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0."),
    ("MPL-2.0", "Mozilla Public License Version 2.0"),
    ("CC-BY-4.0", "Licensed under CC BY 4.0."),
    ("CC-BY-4.0", "This work is licensed under a Creative Commons Attribution 4.0 International License."),
    ("CC-BY-NC-4.0", "Licensed under CC BY-NC 4.0."),
    ("CC-BY-NC-4.0", "This work is licensed under a Creative Commons Attribution-NonCommercial 4.0 International License."),
    ("CC-BY-SA-4.0", "Licensed under CC BY-SA 4.0."),
    ("CC-BY-SA-4.0", "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License."),
    ("CC0-1.0", "Released into the public domain under CC0 1.0."),
    ("Unlicense", "This is free and unencumbered software released into the public domain."),
    ("Proprietary", "Copyright. All rights reserved. Unauthorized copying of this file is prohibited, proprietary and confidential."),
)
LEAST, WINDOWS = 0.7, (*range(1, 13), 14, 16, 20, 24, 28, 32)
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
_LOWERED = str.maketrans(UPPER, LOWER)
_TERM = re.compile("[a-z0-9]+")
_SENTENCE_END = re.compile("([.!?])[ \t]+")
_LICENCE_FILE = r"^(?i)(LICEN[SC]E|COPYING)[^/]*$"
_SLACK = 1e-6
VERSION = r"\bv(?:ersion)?[ .]{0,2}([0-9]+(?:[.][0-9]+)?)"
_ID = "[A-Za-z0-9.+-]+"
SPDX = rf"SPDX-License-Identifier:[ \t]*([(]*{_ID}[)]*(?: +(?:OR|AND|WITH) +[(]*{_ID}[)]*)*)"


def pieces(text: str) -> list[tuple[list[str], list[str]]]:
    """The terms of each piece that has any, and the versions that it names, without `.0`."""
    cut = _SENTENCE_END.sub(r"\1\n", text.translate(_LOWERED)).split("\n")
    return [(t, versions(x)) for x in cut if (t := _TERM.findall(x))]


def versions(text: str) -> list[str]:
    return [v.removesuffix(".0") for v in re.findall(VERSION, text, re.ASCII)]


class Templates:
    """Sparse unit vectors of the templates, by term."""

    def __init__(self, templates: tuple[tuple[str, str], ...] = TEMPLATES):
        counts = [Counter(_TERM.findall(text.translate(_LOWERED))) for _, text in templates]
        in_templates = Counter(t for c in counts for t in c)
        self.idf = {t: math.log((1 + len(templates)) / (1 + n)) + 1 for t, n in in_templates.items()}
        self.other = math.log(1 + len(templates)) + 1
        self.names = [name for name, _ in templates]
        self.versions = [set(versions(text.translate(_LOWERED))) for _, text in templates]
        self.by_term: dict[str, list[tuple[int, float]]] = {}
        for k, c in enumerate(counts):
            norm = math.sqrt(sum((n * self.idf[t]) ** 2 for t, n in c.items()))
            for t, n in c.items():
                self.by_term.setdefault(t, []).append((k, n * self.idf[t] / norm))
        self.number = {t: i for i, t in enumerate(self.by_term, 1)}  # 0: a term of no template
        self.product = np.zeros((len(self.number) + 1, len(templates)))
        self.square = np.full(len(self.number) + 1, self.other**2)
        for t, i in self.number.items():
            self.square[i] = self.idf[t] ** 2
            for k, w in self.by_term[t]:
                self.product[i, k] = self.idf[t] * w

    def match(self, window: list[tuple[list[str], list[str]]], least: float) -> tuple[float, float, str] | None:
        """-weight, -similarity and license of a window's best template at `least` or more."""
        count, dots = Counter(t for terms, _ in window for t in terms), {}
        named = {v for _, own in window for v in own}
        for t, n in count.items():
            for k, w in self.by_term.get(t, ()):
                dots[k] = dots.get(k, 0.0) + n * self.idf[t] * w
        norm = math.sqrt(sum((n * self.idf.get(t, self.other)) ** 2 for t, n in count.items()))
        return min(((-round(d, 6), -round(d / norm, 6), self.names[k]) for k, d in dots.items() if round(d / norm, 6) >= least and not (named and self.versions[k] and named.isdisjoint(self.versions[k]))), default=None)

    def windows(self, texts: list[list[tuple[list[str], list[str]]]], least: float) -> Iterator[tuple[int, int, int]]:
        """(text, first piece, last piece + 1) of all windows whose similarity may reach `least`."""
        of_text = np.repeat(np.arange(len(texts)), [len(t) for t in texts])
        flat = [terms for t in texts for terms, _ in t]
        if not flat:
            return
        number = np.fromiter((self.number.get(t, 0) for p in flat for t in p), np.int64)
        first = np.r_[0, np.cumsum([len(p) for p in flat])]
        square = np.r_[0, np.cumsum(np.add.reduceat(self.square[number], first[:-1]))]
        known = np.flatnonzero(number)
        piece = np.searchsorted(first, known, "right") - 1
        product = np.zeros((len(flat) + 1, self.product.shape[1]))
        if len(known):
            head = np.flatnonzero(np.r_[True, piece[1:] != piece[:-1]])
            product[piece[head] + 1] = np.add.reduceat(self.product[number[known]], head, axis=0)
        np.cumsum(product, axis=0, out=product)
        begin = np.searchsorted(of_text, np.arange(len(texts) + 1))
        for n in (n for n in WINDOWS if n <= len(flat)):
            a = np.arange(len(flat) - n + 1)
            a = a[of_text[a] == of_text[a + n - 1]]
            top = (product[a + n] - product[a]).max(axis=1)
            for i in a[top >= (least - _SLACK) * np.sqrt(square[a + n] - square[a])].tolist():
                k = int(of_text[i])
                yield k, i - int(begin[k]), i - int(begin[k]) + n

    def best(self, texts: list[str], whole: list[bool], least: float) -> list[tuple[float | None, str | None]]:
        """Of each text the similarity of its best window and that one's license. whole: the text as one window is compared, too."""
        cut = [pieces(t) for t in texts]
        spans = [*self.windows(cut, least), *((k, 0, len(c)) for k, (c, w) in enumerate(zip(cut, whole, strict=True)) if c and (w or len(c) <= WINDOWS[-1]))]
        found: list[tuple[float, float, str] | None] = [None] * len(texts)
        for k, a, b in spans:
            m = self.match(cut[k][a:b], least)
            if m and (found[k] is None or m < found[k]):
                found[k] = m
        stated = [re.search(SPDX, t, re.ASCII) if "SPDX-License-Identifier:" in t else None for t in texts]
        return [(1.0, re.sub(" +", " ", s[1])) if s else (-m[1], m[2]) if m else (None, None) for s, m in zip(stated, found, strict=True)]


def _file_name(path: Column) -> Column:
    return F.regexp_extract(path, "([^/]*)$", 1)


def own_licenses(files: DataFrame, id_col: str, path_col: str, text_col: str, least: float = LEAST) -> DataFrame:
    """doc_id, path, similarity and own_license (both null below `least`): a row per file."""
    path = F.col(f"`{path_col}`")
    rows = files.select(F.col(f"`{id_col}`").cast("long").alias("doc_id"), path.alias("path"), whole_text(f"`{text_col}`").alias("t"), F.coalesce(_file_name(path).rlike(_LICENCE_FILE), F.lit(False)).alias("whole"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        templates = Templates()
        for b in batches:
            for part, texts in slices(b, "t"):
                best = templates.best(texts, part.column("whole").to_pylist(), least)
                yield pa.RecordBatch.from_arrays([part.column("doc_id"), part.column("path"), pa.array([s for s, _ in best], pa.float64()), pa.array([n for _, n in best], pa.string())], ["doc_id", "path", "similarity", "own_license"])

    return rows.mapInArrow(run, "doc_id long, path string, similarity double, own_license string")


def licenses(files: DataFrame, id_col: str = "doc_id", path_col: str = "path", text_col: str = "text", least: float = LEAST) -> DataFrame:
    """doc_id, path, similarity, own_license, license, from_dir (the directory whose declaration was inherited)."""
    rows = reliable(own_licenses(files, id_col, path_col, text_col, least))
    rows = rows.withColumn("dir", F.when(F.contains("path", F.lit("/")), F.regexp_replace("path", "/[^/]*$", "")).when(F.col("path").isNotNull(), F.lit("")))
    declared = rows.where(F.col("own_license").isNotNull() & _file_name(F.col("path")).rlike(_LICENCE_FILE))
    declared = declared.groupBy(F.col("dir").alias("from_dir")).agg(F.min(F.struct((-F.col("similarity")).alias("s"), "path", "own_license")).alias("d")).select("from_dir", F.col("d.own_license").alias("declared"))
    dirs = rows.where("dir is not null").select("dir").distinct()
    names = F.split("dir", "/")
    ancestors = F.concat(F.array(F.lit("")), F.transform(F.sequence(F.lit(1), F.size(names)), lambda i: F.array_join(F.slice(names, F.lit(1), i), "/")))
    near = join_dealt(dirs.select("dir", F.posexplode(F.array_distinct(ancestors)).alias("depth", "from_dir")), declared, "from_dir")
    near = near.groupBy("dir").agg(F.max(F.struct("depth", "from_dir", "declared")).alias("n")).select("dir", F.col("n.from_dir").alias("from_dir"), F.col("n.declared").alias("declared"))
    out = join_dealt(rows, reliable(near), "dir", "left")
    inherits = F.col("own_license").isNull()
    return out.select("doc_id", "path", "similarity", "own_license", F.coalesce("own_license", "declared").alias("license"), F.when(inherits, F.col("from_dir")).alias("from_dir"))


def document_paths(docs: DataFrame) -> DataFrame:
    """`documents` as files: doc_id, text and a path made of source and id. Every third one is a licence file."""
    i = F.col("doc_id")
    a, b = F.concat(F.lit("a"), (i % 7).cast("string")), F.concat(F.lit("b"), (i % 5).cast("string"))
    folder = F.when(i % 4 == 0, F.col("source")).when(i % 4 == 1, F.concat_ws("/", "source", a)).otherwise(F.concat_ws("/", "source", a, b))
    name = F.concat(F.when(i % 3 == 0, F.lit("LICENSE.")).otherwise(F.lit("f")), i.cast("string"))
    return docs.select("doc_id", "text", F.concat(folder, F.lit("/"), name).alias("path"))


def oracle() -> str:
    """SQL for the licenses of `document_paths`, written apart from the code above: every window of every text, without bounds."""
    quote = lambda s: "'" + s.replace("'", "''") + "'"
    values = ", ".join(f"({k}, {quote(n)}, {quote(t)})" for k, (n, t) in enumerate(TEMPLATES))
    return f"""
WITH template(k, name, body) AS (VALUES {values}),
tt AS (SELECT k, name, unnest(regexp_extract_all(translate(body, '{UPPER}', '{LOWER}'), '[a-z0-9]+')) AS term FROM template),
tf AS (SELECT k, name, term, count(*) AS n FROM tt GROUP BY ALL),
idf AS (SELECT term, ln((1 + {len(TEMPLATES)}) / (1.0 + count(DISTINCT k))) + 1 AS idf FROM tf GROUP BY term),
tw AS (SELECT k, name, term, n * idf AS w FROM tf JOIN idf USING (term)),
tn AS (SELECT k, sqrt(sum(w * w)) AS norm FROM tw GROUP BY k),
tv AS (SELECT k, list_transform(regexp_extract_all(translate(body, '{UPPER}', '{LOWER}'), '{VERSION}', 1), lambda x: regexp_replace(x, '[.]0$', '')) AS versions FROM template),
files AS (
  SELECT doc_id, coalesce(text, '') AS text,
    source || CASE WHEN doc_id % 4 = 0 THEN '' WHEN doc_id % 4 = 1 THEN '/a' || (doc_id % 7) ELSE '/a' || (doc_id % 7) || '/b' || (doc_id % 5) END AS dir,
    CASE WHEN doc_id % 3 = 0 THEN 'LICENSE.' ELSE 'f' END || doc_id AS name
  FROM documents),
raw AS (SELECT doc_id, list_filter(string_split(regexp_replace(translate(text, '{UPPER}', '{LOWER}'), '([.!?])[ \t]+', '\\1' || chr(10), 'g'), chr(10)), lambda x: regexp_matches(x, '[a-z0-9]')) AS x FROM files),
cut AS (SELECT doc_id, list_transform(x, lambda y: regexp_extract_all(y, '[a-z0-9]+')) AS p, list_transform(x, lambda y: list_transform(regexp_extract_all(y, '{VERSION}', 1), lambda z: regexp_replace(z, '[.]0$', ''))) AS v FROM raw),
win AS (SELECT doc_id, i, n FROM (SELECT doc_id, len(p) AS np, unnest(range(1, len(p) + 1)) AS i FROM cut) x, (SELECT unnest({list(WINDOWS)}) AS n) y WHERE i + n - 1 <= np
  UNION ALL SELECT doc_id, 0, len(p) FROM cut WHERE len(p) > 0 AND (doc_id % 3 = 0 OR len(p) <= {WINDOWS[-1]})),
wt AS (SELECT w.doc_id, w.i, w.n, unnest(flatten(p[greatest(w.i, 1) : greatest(w.i, 1) + w.n - 1])) AS term FROM win w JOIN cut USING (doc_id)),
wf AS (SELECT doc_id, i, n, term, count(*) AS c FROM wt GROUP BY ALL),
ww AS (SELECT doc_id, i, n, wf.term, c * coalesce(idf, ln(1 + {len(TEMPLATES)}) + 1) AS w, idf IS NOT NULL AS known FROM wf LEFT JOIN idf ON wf.term = idf.term),
wn AS (SELECT doc_id, i, n, sqrt(sum(w * w)) AS norm, sqrt(sum(w * w) FILTER (known)) / sqrt(sum(w * w)) AS most FROM ww GROUP BY ALL),
dots AS (SELECT ww.doc_id, ww.i, ww.n, wn.norm, tw.k, tw.name, sum(ww.w * tw.w) AS dot FROM wn JOIN ww ON ww.doc_id = wn.doc_id AND ww.i = wn.i AND ww.n = wn.n AND wn.most > {LEAST - 0.01} JOIN tw ON ww.term = tw.term GROUP BY ALL),
sims AS (
  SELECT doc_id, name, round(dot / tn.norm, 6) AS weight, round(dot / (dots.norm * tn.norm), 6) AS s FROM dots JOIN tn USING (k) JOIN tv USING (k) JOIN cut USING (doc_id)
  WHERE len(versions) = 0 OR len(flatten(v[greatest(i, 1) : greatest(i, 1) + n - 1])) = 0 OR list_has_any(versions, flatten(v[greatest(i, 1) : greatest(i, 1) + n - 1]))),
spdx AS (SELECT doc_id, regexp_replace(regexp_extract(text, '{SPDX}', 1), ' +', ' ', 'g') AS stated FROM files),
best AS (SELECT doc_id, s, name FROM sims WHERE s >= {LEAST} QUALIFY row_number() OVER (PARTITION BY doc_id ORDER BY weight DESC, s DESC, name) = 1),
own AS (SELECT f.doc_id, f.dir, f.name AS file, f.dir || '/' || f.name AS path, CASE WHEN stated <> '' THEN 1.0::DOUBLE ELSE s END AS similarity, CASE WHEN stated <> '' THEN stated ELSE best.name END AS own_license FROM files f LEFT JOIN best USING (doc_id) LEFT JOIN spdx USING (doc_id)),
declared AS (SELECT dir AS from_dir, own_license AS declared FROM own WHERE own_license IS NOT NULL AND starts_with(file, 'LICENSE') QUALIFY row_number() OVER (PARTITION BY dir ORDER BY similarity DESC, path) = 1),
near AS (
  SELECT d.dir, from_dir, declared FROM (SELECT DISTINCT dir FROM own) d JOIN declared ON d.dir = from_dir OR starts_with(d.dir, from_dir || '/')
  QUALIFY row_number() OVER (PARTITION BY d.dir ORDER BY length(from_dir) DESC) = 1)
SELECT doc_id, path, similarity, own_license, coalesce(own_license, declared) AS license, CASE WHEN own_license IS NULL THEN from_dir END AS from_dir
FROM own LEFT JOIN near USING (dir)
"""
