"""Licence scan by a positional index over rare words.

Templates (notices, references and SPDX tags of licences) are indexed by their rarest
words, those in the fewest templates: each has postings (template, position). The
index's words in a file are looked up, and each
posting puts the template at a relative position of the file. Where the postings of
enough words of a template intersect within ``PLAY`` words, the template is laid over
the text: most of its words must stand in place and its mandatory phrases must stand
there word by word. So many words are indexed per template that postings cannot miss
a place where enough words stand, so a text's labels depend on that text alone.

One pass over the texts in Arrow batches; nothing is shuffled.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import cloudpickle
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from turnledger.llm.arrays import blocks, hash_strings, offsets_of, split_words

#: Separators of words, base phrases and their labels.
SEPARATORS = "[\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+"
PHRASES = {"mit license": "mit", "apache license": "apache", "general public license": "gpl"}

#: label -> (text, mandatory phrases); standard wording of the licences' notices.
TEMPLATES = {
    "mit-reference": ("released under the MIT License", ["mit license"]),
    "mit-text": (
        "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files",
        ["permission is hereby granted free of charge"]),
    "apache-2.0": ("licensed under the Apache License, Version 2.0", ["apache license version 2 0"]),
    "gpl-3.0": ("licensed under the GNU General Public License, version 3", ["gnu general public license version 3"]),
    "gpl-text": (
        "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License",
        ["free software", "general public license"]),
    "lgpl": ("under the terms of the GNU Lesser General Public License", ["gnu lesser general public license"]),
    "mpl-2.0": ("subject to the terms of the Mozilla Public License, v. 2.0", ["mozilla public license v 2 0"]),
    "bsd-text": (
        "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met",
        ["redistribution and use in source and binary forms"]),
    "isc-text": (
        "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted",
        ["permission to use copy modify and or distribute this software"]),
    "cc-by-nc-4.0": ("licensed under CC BY-NC 4.0", ["cc by nc 4 0"]),
    "cc-by-sa-4.0": ("licensed under CC BY-SA 4.0", ["cc by sa 4 0"]),
    "cc-by-4.0": ("licensed under CC BY 4.0", ["cc by 4 0"]),
    "unlicense": ("This is free and unencumbered software released into the public domain", ["free and unencumbered software"]),
    "mit-warranty": (
        "THE SOFTWARE IS PROVIDED \"AS IS\", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT",
        ["the software is provided as is"]),
    "mit-notice": (
        "The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software",
        ["this permission notice shall be included"]),
    "bsd-source": ("Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer", ["redistributions of source code must retain"]),
    "bsd-binary": ("Redistributions in binary form must reproduce the above copyright notice", ["redistributions in binary form must reproduce"]),
    "bsd-3-clause": (
        "Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission",
        ["endorse or promote products derived from this software"]),
    "apache-text": (
        "you may not use this file except in compliance with the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0",
        ["except in compliance with the license"]),
    "apache-short": ("licensed under Apache-2.0", ["licensed under apache 2 0"]),
    "gpl-2.0": ("either version 2 of the License, or (at your option) any later version", ["either version 2 of the license"]),
    "gpl-3.0-text": ("either version 3 of the License, or (at your option) any later version", ["either version 3 of the license"]),
    "gpl-warranty": (
        "This program is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE",
        ["in the hope that it will be useful"]),
    "gpl-2.0-short": ("under GPL v2", ["under gpl v2"]),
    "gpl-3.0-short": ("under GPL v3", ["under gpl v3"]),
    "agpl-3.0": ("under the terms of the GNU Affero General Public License", ["gnu affero general public license"]),
    "epl-2.0": ("under the terms of the Eclipse Public License 2.0", ["eclipse public license 2 0"]),
    "cc0-1.0": ("dedicated to the public domain under CC0 1.0 Universal", ["cc0 1 0"]),
    "zlib": (
        "Altered source versions must be plainly marked as such, and must not be misrepresented as being the original software",
        ["altered source versions must be plainly marked"]),
    "boost": (
        "Permission is hereby granted, free of charge, to any person or organization obtaining a copy of the software and accompanying documentation covered by this license",
        ["any person or organization obtaining a copy"]),
}
#: Identifiers of licences in SPDX tags.
SPDX = """MIT Apache-2.0 GPL-2.0-only GPL-2.0-or-later GPL-3.0-only GPL-3.0-or-later LGPL-2.1-only LGPL-2.1-or-later LGPL-3.0-only LGPL-3.0-or-later AGPL-3.0-only
  AGPL-3.0-or-later MPL-2.0 BSD-2-Clause BSD-3-Clause ISC Unlicense CC0-1.0 CC-BY-4.0 CC-BY-SA-4.0 Zlib EPL-2.0 BSL-1.0""".split()
TEMPLATES |= {f"spdx-{x.lower()}": (f"SPDX-License-Identifier: {x}", [f"spdx license identifier {x}"]) for x in SPDX}
#: Rarest words indexed per template at least, votes that must agree, words' play in place, share of words in place.
RARE, VOTES, PLAY, COVER = 5, 3, 2, 0.8


def words_of(texts: list[str]) -> list[list[str]]:
    flat, ends = split_words(pa.array(texts, pa.string()), pattern=SEPARATORS)
    flat = flat.to_pylist()
    return [flat[a:b] for a, b in zip(ends[:-1], ends[1:])]


class Index:
    """Templates and phrases as word numbers; postings (template, position) of each word."""

    def __init__(self, templates: dict = TEMPLATES, phrases: dict = PHRASES):
        self.labels = list(templates)
        bodies = words_of([templates[x][0] for x in self.labels])
        keys = [words_of(templates[x][1]) for x in self.labels]
        base = words_of(list(phrases))
        vocabulary = sorted({w for part in [*bodies, *base, *[k for ks in keys for k in ks]] for w in part})
        number = {w: i for i, w in enumerate(vocabulary)}
        self.hashes = hash_strings(pa.array(vocabulary, pa.string()))
        self.order = np.argsort(self.hashes)
        self.bodies = [np.array([number[w] for w in b]) for b in bodies]
        self.keys = [[np.array([number[w] for w in k]) for k in ks] for ks in keys]
        self.base = [(np.array([number[w] for w in b]), label) for b, label in zip(base, phrases.values())]
        # a template may miss this many of its places
        spare = [max(m for m in range(len(b)) if (len(b) - m) / len(b) >= COVER) for b in self.bodies]
        holding = np.bincount(np.concatenate([np.unique(b) for b in self.bodies]), minlength=len(vocabulary))
        self.idf = np.log((len(self.bodies) + 1) / (holding + 1))
        ranked = [sorted(set(body.tolist()), key=lambda w: (-self.idf[w], w)) for body in self.bodies]
        # at most ``spare`` of the indexed words do not vote for the place where a template stands
        self.rare = [words[: max(RARE, m + VOTES)] for words, m in zip(ranked, spare)]
        self.needed = np.array([max(1, min(VOTES, len(words) - m)) for words, m in zip(self.rare, spare)])
        posts = sorted((w, t, j) for t, (body, words) in enumerate(zip(self.bodies, self.rare)) for w in words for j in np.flatnonzero(body == w).tolist())
        self.posts = np.array(posts, np.int64).reshape(-1, 3)
        self.first = np.searchsorted(self.posts[:, 0], np.arange(len(vocabulary) + 1))

    def numbered(self, text: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """The word numbers of the texts, -1 for words outside the index, and their offsets."""
        flat, ends = split_words(text, pattern=SEPARATORS)
        hashes = hash_strings(flat)
        sorted_ = self.hashes[self.order]
        at = np.minimum(np.searchsorted(sorted_, hashes), len(sorted_) - 1)
        return np.where(sorted_[at] == hashes, self.order[at], -1), ends

    def intersected(self, ids: np.ndarray, ends: np.ndarray) -> list[tuple[int, np.ndarray]]:
        """(text, templates) where postings of enough words put the template at one place, give or take PLAY words."""
        at = np.flatnonzero(ids >= 0)
        n = self.first[ids[at] + 1] - self.first[ids[at]]
        post = np.repeat(self.first[ids[at]], n) + np.arange(int(n.sum())) - np.repeat(offsets_of(n)[:-1], n)
        doc = np.searchsorted(ends, np.repeat(at, n), side="right") - 1
        template, start = self.posts[post, 1], np.repeat(at, n) - self.posts[post, 2]
        cell = doc * len(self.bodies) + template
        order = np.lexsort((start, cell))
        cell, start = cell[order], start[order]
        ahead = np.arange(len(cell)) + self.needed[cell % len(self.bodies)] - 1
        there = np.minimum(ahead, len(cell) - 1)
        met = (ahead < len(cell)) & (cell[there] == cell) & (start[there] - start <= 2 * PLAY)
        cells = np.unique(cell[met])
        docs, begin = np.unique(cells // len(self.bodies), return_index=True)
        return [(int(d), part % len(self.bodies)) for d, part in zip(docs, np.split(cells, begin[1:]))]


def places(ids: np.ndarray, phrase: np.ndarray) -> np.ndarray:
    """Where ``phrase`` stands word by word."""
    n = len(ids) - len(phrase) + 1
    if n <= 0:
        return np.empty(0, np.int64)
    ok = ids[:n] == phrase[0]
    for k in range(1, len(phrase)):
        ok &= ids[k : n + k] == phrase[k]
    return np.flatnonzero(ok)


def templates_in(ids: np.ndarray, index: Index, chosen: np.ndarray) -> dict[str, float]:
    """label -> share of the template's words in place, of every one of the templates numbered ``chosen`` verified in one text."""
    found = {}
    for t in chosen:
        body, edge = index.bodies[t], len(index.bodies[t]) + PLAY
        near = {}  # where a word stands at most PLAY away; a start is counted from -edge
        for w in set(body.tolist()):
            near[w] = np.zeros(len(ids) + 2 * edge, bool)
            for d in range(-PLAY, PLAY + 1):
                near[w][np.flatnonzero(ids == w) + edge + d] = True
        n = len(ids) + 2 * edge - len(body) + 1
        votes = np.zeros(n, np.int64)
        for w in index.rare[t]:
            votes += np.logical_or.reduce([near[w][j : j + n] for j in np.flatnonzero(body == w)])
        starts = np.flatnonzero(votes >= index.needed[t])
        inside = np.sum([near[w][starts + j] for j, w in enumerate(body.tolist())], axis=0) / len(body)
        for share, start in sorted(zip(inside[inside >= COVER].tolist(), (starts[inside >= COVER] - edge).tolist()), reverse=True):
            region = ids[max(0, start - PLAY) : max(0, start + len(body) + PLAY)]
            if all(len(places(region, k)) for k in index.keys[t]):
                found[index.labels[t]] = share
                break
    return found


def scan(docs: DataFrame, templates: dict = TEMPLATES, phrases: dict = PHRASES) -> DataFrame:
    """Per row of ``docs``: (doc_id, n_words, n_base, first_word, last_word, base_labels, labels, score).

    n_base counts the places of the base phrases, first_word and last_word are
    their smallest and largest start. labels adds the templates verified; score
    is the highest share of words in place of anything found (1 for a base
    phrase, 0 without a label), the greatest of several. Null and empty texts have no
    words and no labels; repeated rows repeat their result; an empty table gives an
    empty one; other columns are not read.
    """
    index = Index(templates, phrases)
    shared = docs.sparkSession.sparkContext.broadcast(cloudpickle.dumps(index))
    fields = ["doc_id", "n_words", "n_base", "first_word", "last_word", "base_labels", "labels", "score"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        index = cloudpickle.loads(shared.value)
        for batch in batches:
            for block in blocks(batch, "text"):
                ids, ends = index.numbered(block.column("text"))
                n = len(ends) - 1
                owner = np.repeat(np.arange(n), np.diff(ends))
                count, first, last = np.zeros(n, np.int64), np.full(n, np.iinfo(np.int64).max), np.full(n, -1)
                base, more, score = [set() for _ in range(n)], [set() for _ in range(n)], np.zeros(n)
                for phrase, label in index.base:
                    at = places(ids, phrase)
                    at = at[owner[at] == owner[at + len(phrase) - 1]]
                    doc = owner[at]
                    np.add.at(count, doc, 1)
                    np.minimum.at(first, doc, at - ends[doc])
                    np.maximum.at(last, doc, at - ends[doc])
                    for d in np.unique(doc):
                        base[d].add(label)
                        score[d] = 1.0
                for d, chosen in index.intersected(ids, ends):
                    for label, share in templates_in(ids[ends[d] : ends[d + 1]], index, chosen).items():
                        more[d].add(label)
                        score[d] = max(score[d], share)
                yield pa.RecordBatch.from_arrays(
                    [
                        block.column("doc_id"), pa.array(np.diff(ends)), pa.array(count), pa.array(np.where(count == 0, 0, first), mask=count == 0), pa.array(last, mask=count == 0),
                        pa.array([",".join(sorted(b)) for b in base]), pa.array([",".join(sorted(b | m)) for b, m in zip(base, more)]), pa.array(score),
                    ],
                    names=fields,
                )

    kind = docs.schema["doc_id"].dataType.simpleString()
    schema = f"doc_id {kind}, n_words bigint, n_base bigint, first_word bigint, last_word bigint, base_labels string, labels string, score double"
    return docs.select("doc_id", F.col("text").cast("string").alias("text")).mapInArrow(run, schema)
