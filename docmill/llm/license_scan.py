"""License scanning by diagonal voting.

All rolling word 3-grams of every text are hashed and joined by Spark to the positions
of the template grams.  A hit at text position p and template position t votes for the
diagonal p - t.  Votes are added up by text, template and diagonal; neighbouring
diagonals, no further apart than half a template, are merged, since inserted or lost
words move the rest of a match to another diagonal.  A merged span that covers enough of
its template is verified in the text itself: the template's grams must occur there word
by word and in order, as far as a longest increasing chain reaches.

The templates are a parameter of fixed size, so their positions are broadcast.  Grams
are joined in the task that made them; only hits and one row per text are written.
Texts are read again for the spans to verify, and move only if they hold one.

Defined cases: a null or empty text has no words, empty label strings and score 0;
repeated rows get equal results; of spans of a label with one start the one with most
grams stays, and of those the earlier template; further
columns are ignored.
"""

from __future__ import annotations

from bisect import bisect_left
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from docmill.llm.common import broadcast_if_small, materialize, texts
from docmill.llm.hashing import word_hashes

# The phrases of the base rule with their labels.
PHRASES = {"gnu general public license": "gpl", "apache license": "apache", "cc by": "cc-by", "mit license": "mit"}

# License notices in the words of their licenses.
TEMPLATES = {
    "mit": [
        "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files, to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software",
        "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the Software), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions: The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software. THE SOFTWARE IS PROVIDED AS IS, WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE.",
        "Released under the MIT License",
        "Licensed under the MIT License",
    ],
    "apache": [
        "Licensed under the Apache License, Version 2.0 (the License); you may not use this file except in compliance with the License. You may obtain a copy of the License at",
        "Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an AS IS BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied. See the License for the specific language governing permissions and limitations under the License.",
        "Licensed under the Apache License, Version 2.0",
    ],
    "gpl": [
        "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version",
        "This program is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE. See the GNU General Public License for more details.",
        "This work is licensed under the GNU General Public License, version 3",
    ],
    "cc-by": [
        "This work is licensed under a Creative Commons Attribution 4.0 International License",
        "Licensed under CC BY 4.0",
    ],
    "cc-by-nc": ["Licensed under CC BY-NC 4.0", "This work is licensed under a Creative Commons Attribution-NonCommercial 4.0 International License"],
    "cc-by-sa": ["Licensed under CC BY-SA 4.0", "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License"],
    "bsd": [
        "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met",
        "Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer. 2. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution. THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS AS IS AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED.",
    ],
    "isc": ["Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies."],
    "zlib": ["This software is provided as-is, without any express or implied warranty. In no event will the authors be held liable for any damages arising from the use of this software. Permission is granted to anyone to use this software for any purpose, including commercial applications, and to alter it and redistribute it freely, subject to the following restrictions"],
    "unlicense": ["This is free and unencumbered software released into the public domain. Anyone is free to copy, modify, publish, use, compile, sell, or distribute this software, either in source code form or as a compiled binary, for any purpose, commercial or non-commercial, and by any means."],
    "mpl": ["This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not distributed with this file, You can obtain one at"],
}
GRAM = 3
VERIFY = 0.8  # share of a template's grams that a span must hold in order

_KEEP = bytes(c if c >= 128 or chr(c).isdigit() or chr(c).islower() else c + 32 if chr(c).isupper() else 32 for c in range(256))
_GAP = np.array([c < 128 and not (chr(c).isdigit() or chr(c).islower()) for c in range(256)])
_MIX = np.uint64(0x9E3779B97F4A7C15)


def license_words(text: bytes) -> list[bytes]:
    return text.translate(_KEEP).split()


def gram_hashes(flat: bytes) -> np.ndarray:
    """64-bit hashes of all rolling grams of one text of kept bytes."""
    words = word_hashes(flat, _GAP)[0].astype(np.uint64)
    n = len(words) - GRAM + 1
    h = np.zeros(max(0, n), dtype=np.uint64)
    for k in range(GRAM if n > 0 else 0):
        h = ((h ^ words[k : k + n]) + np.uint64(k)) * _MIX
        h ^= h >> np.uint64(31)
    return h.view(np.int64)


def template_positions(templates: dict[str, list[str]]) -> list[tuple[int, str, int, int, int]]:
    """(gram hash, label, template, position, grams in the template)."""
    rows, number = [], 0
    for label, notices in templates.items():
        for notice in notices:
            grams = gram_hashes(notice.encode().translate(_KEEP)).tolist()
            rows += [(g, label, number, t, len(grams)) for t, g in enumerate(grams)]
            number += 1
    return rows


def chain(words: list[bytes], places: dict[tuple, list[int]]) -> int:
    """Length of the longest run of template grams that occur in ``words`` in order."""
    tails: list[int] = []
    for i in range(len(words) - GRAM + 1):
        for at in reversed(places.get(tuple(words[i : i + GRAM]), ())):
            k = bisect_left(tails, at)
            tails[k : k + 1] = [at]
    return len(tails)


BASE = "doc_id bigint, mark bigint, n_words bigint, n_base bigint, first_word bigint, last_word bigint, base array<string>"
SCAN = f"row bigint, about struct<{BASE.replace(' bigint', ': bigint').replace(' array', ': array')}>, grams array<bigint>"


def _scan(docs: DataFrame, phrases: dict[str, str]) -> DataFrame:
    """Base places and all gram hashes of every text, behind one null for the text."""
    needles = [(b" " + p.encode() + b" ", label) for p, label in phrases.items()]

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part, raw in texts(batch, most=1_000_000):
                about, grams = [], []
                for doc_id, mark, text in zip(part.column("doc_id").to_pylist(), part.column("mark").to_pylist(), raw, strict=True):
                    kept = text.translate(_KEEP)
                    words = kept.split()
                    flat, places, labels = b" %b " % b" ".join(words), [], set()
                    for needle, label in needles:
                        word = last = 0
                        at = flat.find(needle)
                        while at >= 0:
                            word += flat.count(b" ", last, at)
                            last = at
                            places.append(word)
                            labels.add(label)
                            at = flat.find(needle, at + 1)
                    about.append({"doc_id": doc_id, "mark": mark, "n_words": len(words), "n_base": len(places), "first_word": min(places, default=None), "last_word": max(places, default=None), "base": sorted(labels)})
                    grams.append(gram_hashes(kept))
                sizes = np.array([len(g) + 1 for g in grams])
                ends = np.cumsum(sizes)
                flat_grams, null = np.zeros(int(ends[-1]), dtype=np.int64), np.zeros(int(ends[-1]), dtype=bool)
                null[ends - sizes] = True
                flat_grams[~null] = np.concatenate(grams)
                lists = pa.ListArray.from_arrays(pa.array(np.append(0, ends), pa.int32()), pa.array(flat_grams, pa.int64(), mask=null))
                kind = pa.struct([(c.split()[0], pa.list_(pa.string()) if "array" in c else pa.int64()) for c in BASE.split(", ")])
                yield pa.RecordBatch.from_arrays([part.column("row"), pa.array(about, kind), lists], ["row", "about", "grams"])

    return docs.select("doc_id", F.xxhash64("text").alias("mark"), F.monotonically_increasing_id().alias("row"), "text").mapInArrow(scan, SCAN)


def _verified(spans: DataFrame, docs: DataFrame, notices: list[str]) -> DataFrame:
    """The spans (doc_id, mark, template, start, end) with their share of grams in order."""
    places: list[dict[tuple, list[int]]] = []
    for notice in notices:
        words, mine = license_words(notice.encode()), {}
        for t in range(len(words) - GRAM + 1):
            mine.setdefault(tuple(words[t : t + GRAM]), []).append(t)
        places.append(mine)
    sizes = [sum(map(len, p.values())) for p in places]

    def verify(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for row in batch.to_pylist():
                words = license_words((row["text"] or "").encode("utf-8", "surrogatepass"))
                for s in row["spans"]:
                    found = chain(words[s["start"] : s["end"]], places[s["template"]])
                    out.append((row["doc_id"], row["mark"], s["template"], s["start"], found / sizes[s["template"]]))
            yield pa.RecordBatch.from_arrays([pa.array([r[k] for r in out], t) for k, t in enumerate((pa.int64(), pa.int64(), pa.int32(), pa.int64(), pa.float64()))], ["doc_id", "mark", "template", "start", "score"])

    wanted = spans.groupBy("doc_id", "mark").agg(F.collect_set(F.struct("template", "start", "end")).alias("spans")).alias("s")
    held = docs.select("doc_id", "text", F.xxhash64("text").alias("mark")).alias("d")
    joined = held.join(broadcast_if_small(wanted), F.expr("d.doc_id <=> s.doc_id and d.mark = s.mark")).select("d.doc_id", "d.mark", "d.text", "s.spans")
    return joined.mapInArrow(verify, "doc_id bigint, mark bigint, template int, start bigint, score double").dropDuplicates(["doc_id", "mark", "template", "start"])


def scan_licenses(docs: DataFrame, templates: dict[str, list[str]] | None = None, phrases: dict[str, str] | None = None) -> DataFrame:
    """One row per document: base places, ``spans`` (label, start, end, score) of
    verified notices, and the labels of both."""
    templates, phrases = templates or TEMPLATES, phrases or PHRASES
    docs = docs.select("doc_id", "text")
    positions = docs.sparkSession.createDataFrame(template_positions(templates), "gram bigint, label string, template int, at int, grams int")
    each = _scan(docs, phrases).select("row", "about", F.posexplode("grams").alias("pos", "gram"))
    each = each.select("row", F.when(F.col("pos") == 0, F.col("about")).alias("about"), (F.col("pos") - 1).alias("pos"), "gram")
    joined = each.join(F.broadcast(positions), "gram", "left").where("about is not null or at is not null").drop("gram")
    found = materialize(joined, "license-hits")
    # The votes of one text lie together, so they are added up before they move.
    hits = found.where("at is not null").withColumn("diagonal", F.col("pos") - F.col("at"))
    voted = hits.groupBy("row", "label", "template", "grams", "diagonal").agg(F.collect_set("at").alias("at"), F.min("pos").alias("start"), F.max("pos").alias("end"))
    along = W.partitionBy("row", "template").orderBy("diagonal")
    far = F.col("diagonal") - F.lag("diagonal").over(along) > F.greatest(F.lit(1), F.floor(F.col("grams") / 2))
    runs = voted.withColumn("run", F.sum(F.when(far, 1).otherwise(0)).over(along.rowsBetween(W.unboundedPreceding, 0)))
    covered = F.size(F.array_distinct(F.flatten(F.collect_list("at"))))
    merged = runs.groupBy("row", "label", "template", "grams", "run").agg(covered.alias("covered"), F.min("start").cast("bigint").alias("start"), (F.max("end") + GRAM).cast("bigint").alias("end")).where(F.col("covered") >= VERIFY * F.col("grams"))
    about = found.where("about is not null").select("row", "about.*")
    candidates = materialize(merged.join(about.select("row", "doc_id", "mark"), "row"), "license-spans")
    notices = [n for group in templates.values() for n in group]
    good = _verified(candidates, docs, notices).where(F.col("score") >= VERIFY).alias("g")
    spans = candidates.alias("c").join(good, F.expr("c.doc_id <=> g.doc_id and c.mark = g.mark and c.template = g.template and c.start = g.start")).select("c.*", "g.score")
    best = F.row_number().over(W.partitionBy("row", "label", "start").orderBy(F.desc(F.col("score") * F.col("grams")), "end", "template"))
    spans = spans.withColumn("n", best).where("n = 1").groupBy("row").agg(F.array_sort(F.collect_list(F.struct("start", "end", "label", "score"))).alias("spans"))
    return about.join(broadcast_if_small(spans), "row", "left").drop("row", "mark")
