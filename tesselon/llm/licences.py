"""Licence scan: headers and licence files against templates by sparse TF-IDF cosine, then inheritance down the tree.

1. One pass counts, for each of 2**SLOTS hashed terms, the documents that have it; the counts (1 MB a partition) are
   summed by range and give inverse document frequencies over the whole corpus.
2. A second pass compares, for each template, the windows of its length that begin with one of its words, anywhere in a
   text. The dot product is linear in occurrences and read off a running sum; with the sum of squared frequencies as the
   least possible norm it bounds the cosine from above, and only windows that may reach the threshold are weighed exactly.
3. A file without a licence of its own takes that of the licence files in its nearest directory upwards. Distinct
   directories are joined to their ancestors' licences by path, then files to their directory.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import arrow, blobs, only, settle, share, summed, type_of
from .textkit import U, Words, distinct, slices

SLOTS = 18
NEAR = 0.05
LICENCE_FILE = r"(?i)^(un)?(licen[cs]e|copying|copyright|notice)([._-].*)?$"

TEMPLATES: list[tuple[str, str]] = [
    ("ISC", "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies."),
    ("ISC", "Licensed under the ISC License."),
    ("Unlicense", "This is free and unencumbered software released into the public domain."),
    ("Zlib", "This software is provided 'as-is', without any express or implied warranty. In no event will the authors be held liable for any damages arising from the use of this software."),
    ("BSL-1.0", "Distributed under the Boost Software License, Version 1.0."),
    ("EPL-2.0", "This program and the accompanying materials are made available under the terms of the Eclipse Public License 2.0"),
    ("LGPL-2.1", "This library is free software; you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License as published by the Free Software Foundation; either version 2.1 of the License"),
    ("MIT", "Released under the MIT License."),
    ("MIT", "Licensed under the MIT License."),
    ("MIT", "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the \"Software\"), to deal in the Software without restriction"),
    ("Apache-2.0", "Licensed under the Apache License, Version 2.0."),
    ("Apache-2.0", "Licensed under the Apache License, Version 2.0 (the \"License\"); you may not use this file except in compliance with the License."),
    ("GPL-3.0", "This work is licensed under the GNU General Public License, version 3."),
    ("GPL-3.0", "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version."),
    ("GPL-2.0", "This program is free software; you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation; either version 2 of the License"),
    ("LGPL-3.0", "Licensed under the GNU Lesser General Public License, version 3."),
    ("AGPL-3.0", "Licensed under the GNU Affero General Public License, version 3."),
    ("MPL-2.0", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0."),
    ("BSD-3-Clause", "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met: Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution. Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission."),
    ("BSD-2-Clause", "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met: Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution. THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS \"AS IS\" AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED."),
    ("BSD (2 or 3 clauses)", "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met"),
    ("BSD-3-Clause", "Use of this source code is governed by a BSD-style license."),
    ("CC-BY-4.0", "Licensed under CC BY 4.0."),
    ("CC-BY-4.0", "This work is licensed under a Creative Commons Attribution 4.0 International License."),
    ("CC-BY-SA-4.0", "Licensed under CC BY-SA 4.0."),
    ("CC-BY-NC-4.0", "Licensed under CC BY-NC 4.0."),
    ("CC-BY-NC-4.0", "This work is licensed under a Creative Commons Attribution-NonCommercial 4.0 International License."),
    ("CC0-1.0", "Released into the public domain under CC0 1.0 Universal."),
    ("Proprietary", "All rights reserved."),
    ("Proprietary", "All rights reserved. No part of this work may be reproduced without written permission."),
]


def slots(words: Words) -> np.ndarray:
    return (words.hash >> U(64 - SLOTS)).astype(np.int64)


def _frequencies(batches):
    df, docs = np.zeros(1 << SLOTS, np.int64), 0
    for batch in batches:
        for _, texts in slices(batch.column(0)):
            words = Words(texts)
            df += np.bincount(distinct(words.row() << SLOTS | slots(words)) & ((1 << SLOTS) - 1), minlength=1 << SLOTS)
            docs += len(texts)
    if docs:
        yield blobs(np.append(df, docs).astype(np.int64))


def inverse_frequencies(texts: DataFrame) -> np.ndarray:
    """1 + ln((1 + documents) / (1 + documents with the term)) of each slot."""
    sums = summed(arrow(texts, _frequencies, "part int, blob binary"), (1 << SLOTS) + 1, np.int64).astype(np.float64)
    return 1 + np.log((1 + sums[-1]) / (1 + sums[:-1]))


class Book:
    """The templates: name, length in words, and unit weights by slot."""

    def __init__(self, templates: list[tuple[str, str]], idf: np.ndarray):
        self.names, self.idf, self.lengths, self.weights = [n for n, _ in templates], idf, [], []
        words = Words(pa.array([t for _, t in templates], pa.string()))
        at = slots(words)
        self.member = np.zeros(len(idf), bool)
        for i in range(len(templates)):
            terms, counts = np.unique(at[words.first[i] : words.first[i + 1]], return_counts=True)
            vector = counts * idf[terms]
            self.member[terms] = True
            self.lengths.append(int(words.count[i]))
            self.weights.append((terms, vector / max(np.sqrt((vector**2).sum()), 1e-12)))


def licences(book: Book, texts: pa.Array, threshold: float) -> dict[int, tuple[float, str]]:
    """row -> (cosine, licence): of the templates whose best window comes within ``NEAR`` of the row's best cosine the
    longest, which says most (a whole text before its first sentence), then the one of greater cosine, then the first."""
    words = Words(texts)
    at = slots(words)
    hit = np.flatnonzero(book.member[at])
    best: dict[int, dict[int, float]] = {}
    if not len(hit):
        return {}
    row = np.searchsorted(words.first, hit, "right") - 1
    squares = np.concatenate([[0.0], np.cumsum(book.idf[at] ** 2)])
    slot = at[hit]
    for number, (length, (terms, weights)) in enumerate(zip(book.lengths, book.weights)):
        k = np.minimum(np.searchsorted(terms, slot), max(len(terms) - 1, 0))
        own = np.flatnonzero(terms[k] == slot) if len(terms) else np.zeros(0, np.int64)
        start = hit[own]
        end = np.minimum(start + length, words.first[1:][row[own]])
        total = np.concatenate([[0.0], np.cumsum(weights[k[own]] * book.idf[slot[own]])])
        dot = total[np.searchsorted(start, end)] - total[:-1]
        for i in np.flatnonzero(dot >= threshold * np.sqrt(squares[end] - squares[start]) - 1e-9).tolist():
            window, counts = np.unique(at[start[i] : end[i]], return_counts=True)
            cosine = round(float(dot[i] / np.sqrt(((counts * book.idf[window]) ** 2).sum())), 6)
            r = int(row[own[i]])
            if cosine >= threshold and cosine > best.setdefault(r, {}).get(number, 0.0):
                best[r][number] = cosine
    return {r: choice(book, found) for r, found in best.items() if found}


def choice(book: Book, found: dict[int, float]) -> tuple[float, str]:
    least = max(found.values()) - NEAR
    number = max((n for n, c in found.items() if c >= least), key=lambda n: (book.lengths[n], found[n], -n))
    return found[number], book.names[number]


def parent(path: Column) -> Column:
    """The directory of a path; '' is the root."""
    return F.regexp_replace(F.regexp_replace(path, "[^/]*$", ""), "/+$", "")


def scan_licences(
    spark: SparkSession, docs: DataFrame, threshold: float = 0.8, templates: list[tuple[str, str]] = TEMPLATES, doc_id: str = "doc_id", text: str = "text", path: str = "path"
) -> DataFrame:
    """(doc_id, path, licence, similarity, basis, licensed_by) for every row.

    ``basis`` is 'own' where the text holds a template's words with a cosine of at least ``threshold`` (see ``licences``
    for which counts), 'inherited' where the nearest directory upwards with a licensed licence
    file gives one (``licensed_by`` is that directory; of several licence files in it the most similar counts, then the
    least name), and null, with a null licence, otherwise. A null or empty text has no licence of its own but may
    inherit; a null path inherits nothing. Repeated rows and null ids are reported each. Other columns are ignored
    whatever their names; an empty table gives an empty result.
    """
    rows = only(docs, doc=doc_id, text=text, path=path).select("doc", F.col("path").cast("string").alias("path"), "text")
    idf = inverse_frequencies(rows.select("text").filter("text IS NOT NULL"))
    shared = share(spark, Book(templates, idf))

    def run(batches):
        book = shared()
        for batch in batches:
            for at, texts in slices(batch.column(2)):
                best = licences(book, texts, threshold)
                found = [best.get(i, (None, None)) for i in range(len(texts))]
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0).slice(at, len(texts)), batch.column(1).slice(at, len(texts)), pa.array([n for _, n in found], pa.string()), pa.array([c for c, _ in found], pa.float64())], ["doc", "path", "own", "cosine"]
                )

    found = settle(arrow(rows, run, f"doc {type_of(rows, 'doc')}, path string, own string, cosine double"), "licences").withColumn("dir", parent(F.col("path")))
    name = F.regexp_extract("path", "[^/]*$", 0)
    files = found.filter(F.col("own").isNotNull() & name.rlike(LICENCE_FILE))
    given = files.groupBy(F.col("dir").alias("from_dir")).agg(F.min_by(F.struct("own", "cosine"), F.struct(-F.col("cosine"), "own")).alias("g"))
    parts = F.when(F.col("dir") == "", F.array().cast("array<string>")).otherwise(F.split("dir", "/"))
    upwards = found.filter("own IS NULL AND dir IS NOT NULL").select("dir").distinct().withColumn("parts", parts)
    upwards = upwards.select("dir", F.explode(F.transform(F.sequence(F.lit(0), F.size("parts")), lambda k: F.struct(k.alias("depth"), F.array_join(F.slice("parts", F.lit(1), k), "/").alias("above")))).alias("a"))
    nearest = upwards.join(given, F.col("a.above") == F.col("from_dir")).groupBy("dir").agg(F.max_by(F.struct("from_dir", "g"), "a.depth").alias("n"))
    nearest = nearest.select(F.col("dir").alias("d"), "n")
    out = found.join(nearest, F.col("own").isNull() & (F.col("dir") == F.col("d")), "left")
    return out.select(
        F.col("doc").alias("doc_id"), "path", F.coalesce("own", "n.g.own").alias("licence"), F.coalesce("cosine", "n.g.cosine").alias("similarity"),
        F.when(F.col("own").isNotNull(), "own").when(F.col("n").isNotNull(), "inherited").alias("basis"), F.col("n.from_dir").alias("licensed_by"),
    )
