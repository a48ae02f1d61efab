"""License scans by diagonal voting.

Every k-gram of words of every document is hashed and joined, in Spark, to the positions of the
license templates. A hit at word p of a document and word t of a template votes for the diagonal
p - t; votes are summed for each diagonal, diagonals that inserted or dropped words can part are merged,
and the spans with as many votes as a span of the asked coverage must have are compared with the template
by their longest common subsequence of words. Besides that, the base phrases are found exactly.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tessel.llm import textbytes as T
from tessel.llm.common import small, small_batches, written

#: The base phrases (words in order) and their labels.
PHRASES = {
    "under the mit license": "mit",
    "apache license version 2": "apache-2",
    "cc by nc": "cc-by-nc",
}

#: Passages of published licenses and their notices, by label (before a ``#``: the rest names the passage).
TEMPLATES = {
    "mit": """Permission is hereby granted, free of charge, to any person obtaining a copy of this software and
        associated documentation files (the "Software"), to deal in the Software without restriction, including
        without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell
        copies of the Software, and to permit persons to whom the Software is furnished to do so""",
    "apache-2": """Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file except
        in compliance with the License. You may obtain a copy of the License at""",
    "bsd": """Redistribution and use in source and binary forms, with or without modification, are permitted provided
        that the following conditions are met""",
    "gpl": """This program is free software: you can redistribute it and/or modify it under the terms of the GNU
        General Public License as published by the Free Software Foundation, either version""",
    "lgpl": """This library is free software; you can redistribute it and/or modify it under the terms of the GNU
        Lesser General Public License as published by the Free Software Foundation""",
    "mpl-2": """This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the
        MPL was not distributed with this file, You can obtain one at""",
    "isc": """Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is
        hereby granted, provided that the above copyright notice and this permission notice appear in all copies""",
    "cc-by": """This work is licensed under a Creative Commons Attribution 4.0 International License""",
    "cc-by-nc": """This work is licensed under a Creative Commons Attribution NonCommercial 4.0 International License""",
    "unlicense": """This is free and unencumbered software released into the public domain""",
    "mit#notice": """The above copyright notice and this permission notice shall be included in all copies or substantial
        portions of the Software""",
    "mit#warranty": """THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT
        LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT""",
    "apache-2#copyright": """Subject to the terms and conditions of this License, each Contributor hereby grants to You a
        perpetual, worldwide, non-exclusive, no-charge, royalty-free, irrevocable copyright license to reproduce, prepare
        Derivative Works of, publicly display, publicly perform, sublicense, and distribute the Work and such Derivative
        Works in Source or Object form""",
    "apache-2#warranty": """Unless required by applicable law or agreed to in writing, software distributed under the License
        is distributed on an "AS IS" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied. See the
        License for the specific language governing permissions and limitations under the License""",
    "apache-2#terms": """"License" shall mean the terms and conditions for use, reproduction, and distribution as defined by
        Sections 1 through 9 of this document""",
    "bsd#source": """Redistributions of source code must retain the above copyright notice, this list of conditions and the
        following disclaimer""",
    "bsd#binary": """Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the
        following disclaimer in the documentation and/or other materials provided with the distribution""",
    "bsd-3": """Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote
        products derived from this software without specific prior written permission""",
    "bsd#warranty": """THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS "AS IS" AND ANY EXPRESS OR IMPLIED
        WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR
        PURPOSE ARE DISCLAIMED""",
    "gpl#or-later": """This program is free software; you can redistribute it and/or modify it under the terms of the GNU General
        Public License as published by the Free Software Foundation; either version 2 of the License, or (at your option) any
        later version""",
    "gpl#warranty": """This program is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the
        implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE. See the GNU General Public License for more
        details""",
    "gpl-2#preamble": """The licenses for most software are designed to take away your freedom to share and change it. By contrast,
        the GNU General Public License is intended to guarantee your freedom to share and change free software to make sure the
        software is free for all its users""",
    "gpl-3#preamble": """The GNU General Public License is a free, copyleft license for software and other kinds of works""",
    "gpl-3#freedom": """The licenses for most software and other practical works are designed to take away your freedom to share and
        change the works. By contrast, the GNU General Public License is intended to guarantee your freedom to share and change
        all versions of a program""",
    "agpl-3": """This program is free software: you can redistribute it and/or modify it under the terms of the GNU Affero General
        Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any
        later version""",
    "agpl-3#preamble": """The GNU Affero General Public License is a free, copyleft license for software and other kinds of works,
        specifically designed to ensure cooperation with the community in the case of network server software""",
    "lgpl#terms": """This version of the GNU Lesser General Public License incorporates the terms and conditions of version 3 of the
        GNU General Public License, supplemented by the additional permissions listed below""",
    "mpl-2#terms": """"Contributor" means each individual or legal entity that creates, contributes to the creation of, or owns
        Covered Software""",
    "epl-2": """This program and the accompanying materials are made available under the terms of the Eclipse Public License 2.0
        which is available at""",
    "epl#terms": """THE ACCOMPANYING PROGRAM IS PROVIDED UNDER THE TERMS OF THIS ECLIPSE PUBLIC LICENSE ("AGREEMENT"). ANY USE,
        REPRODUCTION OR DISTRIBUTION OF THE PROGRAM CONSTITUTES RECIPIENT'S ACCEPTANCE OF THIS AGREEMENT""",
    "isc#warranty": """THE SOFTWARE IS PROVIDED "AS IS" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE
        INCLUDING ALL IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS""",
    "zlib": """This software is provided 'as-is', without any express or implied warranty. In no event will the authors be held
        liable for any damages arising from the use of this software""",
    "zlib#origin": """The origin of this software must not be misrepresented; you must not claim that you wrote the original
        software. If you use this software in a product, an acknowledgment in the product documentation would be appreciated but
        is not required""",
    "bsl-1": """Permission is hereby granted, free of charge, to any person or organization obtaining a copy of the software and
        accompanying documentation covered by this license (the "Software") to use, reproduce, display, distribute, execute, and
        transmit the Software""",
    "unlicense#terms": """Anyone is free to copy, modify, publish, use, compile, sell, or distribute this software, either in source
        code form or as a compiled binary, for any purpose, commercial or non-commercial, and by any means""",
    "cc-by-sa": """This work is licensed under a Creative Commons Attribution ShareAlike 4.0 International License""",
    "cc-by-nd": """This work is licensed under a Creative Commons Attribution NoDerivatives 4.0 International License""",
    "cc-by-nc-sa": """This work is licensed under a Creative Commons Attribution NonCommercial ShareAlike 4.0 International License""",
    "cc-by-nc-nd": """This work is licensed under a Creative Commons Attribution NonCommercial NoDerivatives 4.0 International License""",
    "cc0": """To the extent possible under law, the person who associated CC0 with this work has waived all copyright and related or
        neighboring rights to this work""",
}

#: English words that join others; a gram of such words alone says little.
JOINING = "a an and any are as at be but by for from if in is it its may no not of on or so such that the their this to under with without you your".split()

#: Rows of a file of spans and of labels, about.
FILE_ROWS = 1 << 13

#: Longest k-grams; shorter ones are taken where a span of the asked coverage needn't keep any (:func:`kept_grams`).
GRAM = 4


def missing(n: int, coverage: float) -> int:
    """Words of a template of ``n`` that a span of the coverage may lack."""
    return n - math.ceil(round(coverage * n, 9))


def kept_grams(n: int, k: int, drift: int, coverage: float) -> int:
    """The fewest k-grams of a template of ``n`` words in a span of the coverage at most ``drift`` words longer than it.

    It lacks ``missing`` words and holds up to ``missing + drift`` others; each may part a run of kept words.
    """
    lost = missing(n, coverage)
    return n - lost - (2 * lost + drift + 1) * (k - 1)


def indexed(words: list[bytes], k: int, spare: int) -> list[int]:
    """The places of a template's k-grams that vote: all but up to ``spare`` of those that only have joining words.

    Such grams are in most texts, so they are most of the hits; a span that is to be found keeps ``spare`` more grams
    than it needs, whichever they are.
    """
    plain = [i for i in range(len(words) - k + 1) if all(w.decode() in JOINING for w in words[i : i + k])]
    left_out = set(plain[: max(0, spare)])
    return [i for i in range(len(words) - k + 1) if i not in left_out]


def common(masks: list[int], n: int, need: int) -> tuple[int, int | None]:
    """(longest common subsequence with a template of ``n`` words, place at which it first has ``need`` words or None).

    ``masks`` holds for each word of the text the set of template places where it stands, as bits.
    """
    full = rest = (1 << n) - 1
    end = None
    for i, m in enumerate(masks):
        hit = rest & m
        rest = ((rest + hit) | (rest - hit)) & full
        if end is None and n - rest.bit_count() >= need:
            end = i
    return n - rest.bit_count(), end


def spans_of(want: list[bytes], words: list[bytes], start: int, stop: int, need: int, reach: int) -> list[tuple[int, int, int]]:
    """(first word, last word, words in order) of the shortest places in ``words[start:stop]`` with ``need`` words of ``want`` in order.

    The places don't overlap; the third value is the most that ``reach`` words that hold the place have in order.
    """
    at: dict[bytes, int] = {}
    for i, w in enumerate(want):
        at[w] = at.get(w, 0) | 1 << i
    hits = [(i, at[words[i]]) for i in range(start, stop) if words[i] in at]
    found, after = [], 0
    for j, (i, _) in enumerate(hits):
        while after < len(hits) and hits[after][0] < i + reach:
            after += 1
        if after - j >= need:
            same, end = common([m for _, m in hits[j:after]], len(want), need)
            if end is not None:
                found.append((i, hits[j + end][0], same))
    out: list[tuple[int, int, int]] = []
    for first, last, _ in sorted(found, key=lambda x: (x[1] - x[0], x[0])):
        if all(last < o[0] or first > o[1] for o in out):
            out.append((first, last, max(same for i, _, same in found if i <= first and last < i + reach)))
    return out


def words_of(text: str) -> list[bytes]:
    """The words of the contract: runs of digits, a-z (after lower-casing A-Z) and non-ASCII characters."""
    data = T.LOWER[np.frombuffer(text.encode(), np.uint8)]
    starts, ends = T.word_spans(data, np.array([0, len(data)]), T.LOWER_WORD)
    raw = data.tobytes()
    return [raw[s:e] for s, e in zip(starts, ends, strict=True)]


def _hashes(words: list[bytes]) -> np.ndarray:
    data = np.frombuffer(b" ".join(words), np.uint8)
    starts, ends = T.word_spans(data, np.array([0, len(data)]), T.LOWER_WORD)
    return T.span_hash(T.prefix_hash(data), starts, ends)


def _base(hashes: np.ndarray, starts: np.ndarray, ends: np.ndarray, raw: bytes, row_of: np.ndarray, phrases: dict) -> list[tuple[int, int, str]]:
    """(row, index of the first word, label) of the places where a phrase stands inside one text."""
    out = []
    for phrase, label in phrases.items():
        words = phrase.encode().split()
        want, n = _hashes(words), len(words)
        if len(hashes) < n:
            continue
        at = np.flatnonzero(hashes[: len(hashes) - n + 1] == want[0])
        for i in at.tolist():
            if row_of[i] == row_of[i + n - 1] and all(raw[starts[i + j] : ends[i + j]] == w for j, w in enumerate(words)):
                out.append((int(row_of[i]), i, label))
    return out


def _files(rows: int) -> int:
    return max(1, -(-rows // FILE_ROWS))


def scan(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", phrases: dict = PHRASES, templates: dict = TEMPLATES, k: int = GRAM, drift: int = 3, coverage: float = 0.8) -> DataFrame:
    """doc_id, n_words, n_base, first_word, last_word, base_labels, labels, score; one row per row of ``docs``.

    ``n_base``, ``first_word`` and ``last_word`` are of the base phrases; ``labels`` adds the templates
    of which a span holds at least ``coverage`` of the words in order. Where spans of templates overlap the one with the
    larger coverage (in tenths) counts, then the one with more words, the earlier one, the first label. ``score`` is the
    best coverage of a template, 1 where a base phrase stands, 0 without labels.

    No span that is at most ``drift`` words longer than its template is missed, wherever words are replaced, dropped or
    put in; longer ones, up to three times the template, count if they keep as many k-grams.

    * A null text is empty: no words, no labels, score 0.
    * Rows that repeat an id and a text get equal results; null ids are told apart by their texts.
    * Only hits are shuffled, by document; the templates are a table of a row per word, :data:`TEMPLATES` by default.
    * Other columns are not read; an empty table gives no rows.
    """
    spark = docs.sparkSession
    small_batches(spark)
    base = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    base = base.withColumn("digest", F.xxhash64("text"))

    labels = [x.partition("#")[0] for x in templates]
    bodies = [words_of(x) for x in templates.values()]
    while k > 1 and any(kept_grams(len(words), k, drift, coverage) < 1 for words in bodies):
        k -= 1
    kept = [kept_grams(len(words), k, drift, coverage) for words in bodies]
    needed = [max(1, min(n, max(2, int(0.3 * len(words))))) for n, words in zip(kept, bodies, strict=True)]
    places = []
    for t, words in enumerate(bodies):
        grams = T.gram_hash(_hashes(words), k).view(np.int64)
        places += [(int(grams[p]), t, p) for p in indexed(words, k, kept[t] - needed[t])]
    table = spark.createDataFrame(places, "gram long, template int, at int")
    # The hits of a span lie on diagonals that its missing and its other words can part.
    apart = [2 * missing(len(words), coverage) + drift for words in bodies]
    least = [len(words) - missing(len(words), coverage) for words in bodies]
    by_template = lambda values: F.element_at(F.array(*map(F.lit, values)), F.col("template") + 1)

    def counted(batches):
        for b in batches:
            ids, digests = b["doc_id"], b["digest"]
            for row, stop, at, data in T.chunks(b["text"]):
                data = T.LOWER[data]
                starts, ends = T.word_spans(data, at, T.LOWER_WORD)
                hashes = T.span_hash(T.prefix_hash(data), starts, ends)
                first = np.searchsorted(starts, at)
                n = np.diff(first)
                row_of = np.repeat(np.arange(stop - row), n)
                places = _base(hashes, starts, ends, data.tobytes(), row_of, phrases)
                by: dict[int, list] = {}
                for r, i, label in places:
                    by.setdefault(r, []).append((i - int(first[r]), label))
                grams = T.gram_hash(hashes, k).view(np.int64)
                inside = np.flatnonzero(row_of[: len(grams)] == row_of[k - 1 :]) if len(grams) else np.zeros(0, np.int64)
                cuts = np.concatenate(([0], np.cumsum(np.bincount(row_of[inside], minlength=stop - row)))).astype(np.int32)
                mine = [by.get(r, []) for r in range(stop - row)]
                yield pa.RecordBatch.from_arrays(
                    [
                        ids[row:stop],
                        digests[row:stop],
                        pa.array(n.astype(np.int64)),
                        pa.array([len(m) for m in mine], pa.int64()),
                        pa.array([min(i for i, _ in m) if m else None for m in mine], pa.int64()),
                        pa.array([max(i for i, _ in m) if m else None for m in mine], pa.int64()),
                        pa.array([sorted({x for _, x in m}) for m in mine], pa.list_(pa.string())),
                        pa.ListArray.from_arrays(pa.array(cuts), pa.array(grams[inside])),
                    ],
                    names,
                )

    names = ["doc_id", "digest", "n_words", "n_base", "first_word", "last_word", "found", "grams"]
    schema = "doc_id long, digest long, n_words long, n_base long, first_word long, last_word long, found array<string>, grams array<long>"
    read = base.mapInArrow(counted, schema)

    # The narrow results and the hits come from one pass: both are kept, the hashes are not.
    grams = read.select("doc_id", "digest", F.posexplode("grams").alias("pos", "gram"))
    hits = grams.join(F.broadcast(table), "gram").select("doc_id", "digest", "template", "pos", (F.col("pos") - F.col("at")).alias("diagonal"), "at")
    votes = hits.groupBy("doc_id", "digest", "template", "diagonal").agg(F.min("pos").alias("first"), F.max("pos").alias("last"), F.collect_set("at").alias("ats"))
    line = Window.partitionBy("doc_id", "digest", "template").orderBy("diagonal")
    gap = F.col("diagonal") - F.lag("diagonal").over(line)
    votes = votes.withColumn("band", F.sum(F.when(gap <= by_template(apart), 0).otherwise(1)).over(line))
    bands = votes.groupBy("doc_id", "digest", "template", "band").agg(F.min("first").alias("first"), F.max("last").alias("last"), F.size(F.array_distinct(F.flatten(F.collect_list("ats")))).alias("votes"))
    spans = bands.where(F.col("votes") >= by_template(needed)).groupBy("doc_id", "digest").agg(F.collect_set(F.struct("template", "first", "last")).alias("spans"))
    # At most a row for each document is left, so the files are few, however many partitions the hits took.
    spans = written(spans.coalesce(_files(docs.count())), "license-spans")
    n_spans = spans.count()

    def verified(batches):
        for b in batches:
            rows = []
            for doc, digest, text, cands in zip(*(b[c].to_pylist() for c in ("doc_id", "digest", "text", "spans")), strict=True):
                words = words_of(text)
                matches = []
                places: dict[int, list] = {}
                for c in sorted(cands, key=lambda c: c["first"]):
                    reach = 3 * (len(bodies[c["template"]]) + drift)
                    start, stop = max(0, c["first"] - reach), min(len(words), c["last"] + k + reach)
                    mine = places.setdefault(c["template"], [])
                    if mine and start <= mine[-1][1]:
                        mine[-1][1] = max(mine[-1][1], stop)
                    else:
                        mine.append([start, stop])
                for t, mine in places.items():
                    want = bodies[t]
                    for start, stop in mine:
                        for first, last, same in spans_of(want, words, start, stop, least[t], 3 * (len(want) + drift)):
                            share = same / len(want)
                            matches.append((-round(share, 1), -same, first, last, labels[t], share))
                best: list[tuple] = []
                for m in sorted(matches):  # where spans of two templates overlap, the better one counts
                    if all(m[3] < o[2] or m[2] > o[3] or m[4] == o[4] for o in best):
                        best.append(m)
                if best:
                    rows.append((doc, digest, sorted({m[4] for m in best}), max(m[5] for m in best)))
            columns = list(zip(*rows, strict=True)) or [[]] * 4
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, (pa.int64(), pa.int64(), pa.list_(pa.string()), pa.float64()), strict=True)], ["doc_id", "digest", "more", "share"])

    out_schema = "doc_id long, digest long, more array<string>, share double"
    narrow = read.drop("grams")
    if n_spans:
        right = spans.withColumnsRenamed({"doc_id": "d", "digest": "g"})
        met = base.join(small(right, n_spans, 160), F.col("doc_id").eqNullSafe(F.col("d")) & (F.col("digest") == F.col("g"))).drop("d", "g")
        sure = written(met.mapInArrow(verified, out_schema).dropDuplicates(["doc_id", "digest"]).coalesce(_files(n_spans)), "license-labels")
        right = sure.withColumnsRenamed({"doc_id": "d", "digest": "g"})
        narrow = narrow.join(small(right, sure.count(), 96), F.col("doc_id").eqNullSafe(F.col("d")) & (F.col("digest") == F.col("g")), "left")
    else:
        narrow = narrow.select("*", F.array().cast("array<string>").alias("more"), F.lit(0.0).alias("share"))
    every = F.array_sort(F.array_union("found", F.coalesce("more", F.array().cast("array<string>"))))
    return narrow.select(
        "doc_id",
        "n_words",
        "n_base",
        "first_word",
        "last_word",
        F.array_join("found", ",").alias("base_labels"),
        F.array_join(every, ",").alias("labels"),
        F.when(F.col("n_base") > 0, F.lit(1.0)).otherwise(F.coalesce("share", F.lit(0.0))).alias("score"),
    )


