"""Licence scans: TF-IDF cosine of headers and licence files to templates, then inheritance from the nearest directory above."""

from __future__ import annotations

import re
from collections import Counter
from math import log, sqrt

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from planwatch.llm.common import documents, slices, utf8, written

#: How a licence is named behind "licensed under" or "released under".
NAMES = {
    "Apache-2.0": ("the Apache License, Version 2.0", "Apache 2.0"),
    "MIT": ("the MIT License",),
    "ISC": ("the ISC License",),
    "BSD-2-Clause": ("the BSD 2-Clause License", "the Simplified BSD License"),
    "BSD-3-Clause": ("the BSD 3-Clause License", "the BSD License", "the New BSD License"),
    "GPL-2.0": ("the GNU General Public License, version 2", "the GNU GPL v2"),
    "GPL-3.0": ("the GNU General Public License, version 3", "the GNU GPL v3"),
    "LGPL-2.1": ("the GNU Lesser General Public License, version 2.1",),
    "LGPL-3.0": ("the GNU Lesser General Public License, version 3",),
    "AGPL-3.0": ("the GNU Affero General Public License, version 3",),
    "MPL-2.0": ("the Mozilla Public License, version 2.0", "the MPL 2.0"),
    "CC-BY-4.0": ("CC BY 4.0", "the Creative Commons Attribution 4.0 International License"),
    "CC-BY-SA-4.0": ("CC BY-SA 4.0", "the Creative Commons Attribution-ShareAlike 4.0 International License"),
    "CC-BY-NC-4.0": ("CC BY-NC 4.0", "the Creative Commons Attribution-NonCommercial 4.0 International License"),
    "CC0-1.0": ("CC0 1.0", "the CC0 1.0 Universal Public Domain Dedication"),
}
#: Headers, the heads of long licences, and short licences as a whole.
TEXTS = {
    "Apache-2.0": (
        'Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file except in compliance with the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0 Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an "AS IS" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied. See the License for the specific language governing permissions and limitations under the License.',
        "Apache License Version 2.0, January 2004 http://www.apache.org/licenses/ TERMS AND CONDITIONS FOR USE, REPRODUCTION, AND DISTRIBUTION",
    ),
    "MIT": (
        'Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the "Software"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions: The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software. THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE.',
    ),
    "ISC": (
        'Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies. THE SOFTWARE IS PROVIDED "AS IS" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS. IN NO EVENT SHALL THE AUTHOR BE LIABLE FOR ANY SPECIAL, DIRECT, INDIRECT, OR CONSEQUENTIAL DAMAGES OR ANY DAMAGES WHATSOEVER RESULTING FROM LOSS OF USE, DATA OR PROFITS, WHETHER IN AN ACTION OF CONTRACT, NEGLIGENCE OR OTHER TORTIOUS ACTION, ARISING OUT OF OR IN CONNECTION WITH THE USE OR PERFORMANCE OF THIS SOFTWARE.',
    ),
    "BSD-2-Clause": (
        "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met: 1. Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer. 2. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution.",
    ),
    "BSD-3-Clause": (
        "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met: 1. Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer. 2. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution. 3. Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission.",
    ),
    "GPL-2.0": (
        "This program is free software; you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation; either version 2 of the License, or (at your option) any later version.",
        "GNU GENERAL PUBLIC LICENSE Version 2, June 1991",
    ),
    "GPL-3.0": (
        "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version.",
        "GNU GENERAL PUBLIC LICENSE Version 3, 29 June 2007",
    ),
    "LGPL-2.1": (
        "This library is free software; you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License as published by the Free Software Foundation; either version 2.1 of the License, or (at your option) any later version.",
        "GNU LESSER GENERAL PUBLIC LICENSE Version 2.1, February 1999",
    ),
    "LGPL-3.0": (
        "This library is free software: you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version.",
        "GNU LESSER GENERAL PUBLIC LICENSE Version 3, 29 June 2007",
    ),
    "AGPL-3.0": (
        "This program is free software: you can redistribute it and/or modify it under the terms of the GNU Affero General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version.",
        "GNU AFFERO GENERAL PUBLIC LICENSE Version 3, 19 November 2007",
    ),
    "MPL-2.0": ("This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not distributed with this file, You can obtain one at http://mozilla.org/MPL/2.0/.", "Mozilla Public License Version 2.0 1. Definitions"),
    "CC0-1.0": ("To the extent possible under law, the author has waived all copyright and related or neighboring rights to this work.",),
    "Proprietary": ("All rights reserved.", "No part of this publication may be reproduced or transmitted in any form without prior written permission."),
}
#: The names behind either verb, and the texts.
TEMPLATES = {k: [*(f"{verb} under {n}" for n in NAMES.get(k, ()) for verb in ("licensed", "released")), *TEXTS.get(k, ())] for k in sorted({*NAMES, *TEXTS})}

_TERM = re.compile(rb"[a-z0-9]+(?:[.-][a-z0-9]+)*")
_TAG = re.compile(rb"<[^<>]*>")
_SPDX = re.compile(rb"(?i)spdx-license-identifier\s*:([^\r\n]*)")
_SPDX_ID = re.compile(rb"[a-z0-9]+(?:[.-]+[a-z0-9]+)*")
_CARRIER = r"(?i)^(licen[cs]e|copying|notice|copyright)([._-].*)?$"
LEAST = 0.75  # cosine
FEW = 100_000  # directories, about 10 MB


def terms(text: bytes) -> list[bytes]:
    """The terms of a text without its markup."""
    return _TERM.findall((_TAG.sub(b" ", text) if b"<" in text else text).lower())


class Templates:
    """Sparse TF-IDF vectors of the templates. Terms weigh how often they stand there times 1 + log((1 + texts) / (1 + texts that have
    them)); a term of no template weighs as much as the rarest of one."""

    def __init__(self, templates: dict[str, list[str]], n_texts: int, df: dict[bytes, int]):
        bags = [(name, Counter(terms(t.encode()))) for name, texts in templates.items() for t in texts]
        self.number = {t: i for i, t in enumerate(dict.fromkeys(t for _, b in bags for t in b))}
        self.names = [name for name, _ in bags]
        self.sizes = [sum(b.values()) for _, b in bags]
        idf = np.array([1 + log((1 + n_texts) / (1 + min(df.get(t, 0), n_texts))) for t in self.number])
        self.idf = np.append(idf, idf.max(initial=1.0))
        self.vectors = np.zeros((len(bags), len(self.idf)))
        for row, (_, b) in zip(self.vectors, bags):
            row[[self.number[t] for t in b]] = list(b.values())
        self.vectors *= self.idf
        self.norms = np.sqrt((self.vectors**2).sum(axis=1))

    def best(self, found: list[bytes], least: float = LEAST, whole: bool = False) -> tuple[float, str | None]:
        """The highest cosine of at least ``least``, and its template's name: between a template and any run of as many terms as it has, and
        with ``whole`` all terms together. Of equal ones the longest template counts, then the first by name.

        Exact and complete: a template is skipped only if the terms that the text has of it can't reach ``least``, and a run only if
        its dot product over the least norm that its terms can have doesn't.
        """
        n, none = len(found), len(self.number)
        if not n:
            return 0.0, None
        ids = np.fromiter((self.number.get(t, none) for t in found), np.int64, n)
        there = np.zeros(none + 1, bool)
        there[ids] = True
        reach = (self.vectors[:, there] ** 2).sum(axis=1) >= (least * self.norms) ** 2
        top: tuple = (0.0, 0, None)
        if reach.any():
            squares = np.concatenate([[0.0], np.cumsum(self.idf[ids] ** 2)])
            for t in np.flatnonzero(reach).tolist():
                dots = np.concatenate([[0.0], np.cumsum((self.vectors[t] * self.idf)[ids])])
                for size in {min(self.sizes[t], n), *([n] if whole else [])}:
                    dot = dots[size:] - dots[: len(dots) - size]
                    bound = dot / (self.norms[t] * np.sqrt(squares[size:] - squares[: len(squares) - size]))
                    mine = 0.0
                    for at in np.argsort(-bound, kind="stable").tolist():
                        if bound[at] < max(least, mine) - 1e-9:
                            break
                        counts = np.bincount(ids[at : at + size], minlength=none + 1)
                        exact = np.append(counts[:none], 0) * self.idf
                        others = Counter(x for x, i in zip(found[at : at + size], ids[at : at + size].tolist()) if i == none)
                        norm = sqrt(float((exact**2).sum()) + sum(k * k for k in others.values()) * float(self.idf[none]) ** 2)
                        mine = max(mine, float(dot[at]) / (self.norms[t] * norm))
                    key = (round(mine, 9), self.sizes[t], [-ord(c) for c in self.names[t]])
                    if mine >= least - 1e-9 and (top[2] is None or key > top[:2] + ([-ord(c) for c in top[2]],)):
                        top = (*key[:2], self.names[t])
        return min(top[0], 1.0), top[2]


def document_frequencies(files: DataFrame, known: list[bytes]) -> tuple[int, dict[bytes, int]]:
    """The number of all texts, and of those that have each of the ``known`` terms. The driver gets a row for each of these."""
    wanted = frozenset(known)

    def run(batches):
        df, n = Counter(), 0
        for b in slices(batches):
            for t in utf8(b.column(0)):
                df.update(wanted.intersection(terms(t)))
                n += 1
        yield pa.RecordBatch.from_arrays([pa.array(["", *(t.decode() for t in df)], pa.string()), pa.array([n, *df.values()], pa.int64())], names=["term", "n"])

    counts = {r["term"]: r["n"] for r in files.select("text").mapInArrow(run, "term string, n bigint").groupBy("term").agg(F.sum("n").alias("n")).collect()}
    return counts.pop("", 0), {t.encode(): n for t, n in counts.items()}


def _tagged(text: bytes, names: dict[bytes, str]) -> str | None:
    """The first licence of the text's SPDX tags that has a template; names are those of the templates in lower case."""
    ids = (i for tag in _SPDX.findall(text) for i in _SPDX_ID.findall(tag.lower()))
    return next((names[i] for i in (i.removesuffix(b"-only").removesuffix(b"-or-later") for i in ids) if i in names), None)


def own_licences(files: DataFrame, templates: dict[str, list[str]] = TEMPLATES, least: float = LEAST) -> DataFrame:
    """files (id, path, text) with own_licence and own_score of the best header anywhere in the text; null and 0 without one.

    A licence file (``_CARRIER``) is compared as a whole too. An SPDX tag names its licence and scores 1; of an expression the first
    licence with a template counts. IDF is that of all ``files``.
    """
    known = list(Templates(templates, 0, {}).number)
    shared = files.sparkSession.sparkContext.broadcast(Templates(templates, *document_frequencies(files, known)))  # as large as the templates
    tags, carrier = {k.lower().encode(): k for k in templates}, re.compile(_CARRIER)

    def run(batches):
        for b in slices(batches):
            names, scores = [], []
            for path, t in zip(b.column(1).to_pylist(), utf8(b.column(2))):
                name = _tagged(t, tags)
                score, name = (1.0, name) if name else shared.value.best(terms(t), least, bool(path and carrier.match(path.rsplit("/", 1)[-1])))
                names.append(name)
                scores.append(score if name else 0.0)
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(names, pa.string()), pa.array(scores, pa.float64())], names=["id", "path", "own_licence", "own_score"])

    return files.select("id", "path", "text").mapInArrow(run, "id string, path string, own_licence string, own_score double")


def licences(files: DataFrame, templates: dict[str, list[str]] = TEMPLATES, least: float = LEAST, few: int = FEW) -> DataFrame:
    """(id, path, own_licence, own_score, licence, inherited_from) for each row of files (id, path, text).

    A file without a licence of its own inherits that of the nearest directory at or above its own which has a licence
    file (LICENSE, COPYING, NOTICE, or the directory's index, a path that ends in /); of several in a directory the best
    score counts, then the first by path. inherited_from is that directory. Null and empty texts have no licence of their
    own; a null path inherits nothing. Repeated rows stay, other columns are not read, and an empty table gives no rows.

    A directory can hold a third of all files: up to ``few`` directories that inherit are broadcast, so files stay where they are; of more
    each has one row, so that the adaptive plan can split the files' side of the join.
    """
    found = written(own_licences(files, templates, least), "licences")
    name = F.regexp_extract("path", r"([^/]*)$", 1)
    placed = found.withColumn("dir", F.regexp_replace("path", r"/?[^/]*$", ""))
    carriers = placed.where(F.col("own_licence").isNotNull() & ((name == "") | name.rlike(_CARRIER))).groupBy("dir").agg(F.min_by("own_licence", F.struct(-F.col("own_score"), F.col("path"))).alias("given"))
    parts = F.split("dir", "/")
    above = F.transform(F.sequence(F.lit(1), F.size(parts)), lambda i: F.struct(i.alias("depth"), F.array_join(F.slice(parts, F.lit(1), i), "/").alias("up")))
    dirs = placed.where(F.col("own_licence").isNull() & F.col("dir").isNotNull()).select("dir").distinct().withColumn("a", F.explode(above)).select("dir", "a.*")
    heirs = written(dirs.join(carriers.withColumnRenamed("dir", "up"), "up").groupBy("dir").agg(F.max_by(F.struct("given", "up"), "depth").alias("from")), "heirs")
    inherits = F.col("own_licence").isNull()
    joined = placed.join(F.broadcast(heirs) if heirs.count() <= few else heirs, "dir", "left")
    return joined.select("id", "path", "own_licence", "own_score", F.coalesce("own_licence", "from.given").alias("licence"), F.when(inherits, F.col("from.up")).alias("inherited_from"))


def op5_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents, as files of their source and language, and all pages, under host and path; see ``licences`` for nulls and repeated rows."""
    docs = documents(spark, sf_dir).select(F.concat(F.lit("document:"), F.col("doc_id")).alias("id"), F.concat_ws("/", F.lit("documents"), "source", "lang", F.col("doc_id").cast("string")).alias("path"), "text")
    pages = spark.read.parquet(f"{sf_dir}/pages.parquet").select(F.concat(F.lit("page:"), F.col("page_id")).alias("id"), F.regexp_extract("url", r"^[a-z]+://([^?#]*)", 1).alias("path"), F.col("html").alias("text"))
    found = licences(docs.unionByName(pages))
    number = F.regexp_extract("id", r"(\d+)$", 1).cast("bigint")
    return found.select(F.when(F.col("id").startswith("document:"), number).alias("doc_id"), F.when(F.col("id").startswith("page:"), number).alias("page_id"), "path", "own_licence", "own_score", "licence", "inherited_from")
