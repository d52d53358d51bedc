"""License scans by a positional rare-token index.

Templates (license notices, and the base phrases) are indexed by word with their
positions; document frequencies of their words over the whole corpus give each word
its IDF. A file is looked up by its own highest-IDF license words: for each template
whose key phrases' words it has, by the rarest of the template's words that are in
the file, as many as no match could do without. A hit at file position i and
template position p proposes that the template begins at i - p. The postings are
intersected by these relative positions: only places that two template positions
propose, to within DRIFT inserted or missing words, are checked. There the
mandatory key phrases must stand in order, and the words that stand in order within
DRIFT of their places must make up LEAST_SHARE of the notice by IDF.

As the words looked up are chosen by weight, every place that reaches the share
is proposed: the index finds what a scan of all places would find.
"""

from __future__ import annotations

import math
from collections import Counter, defaultdict
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tarnfield.llm.text import as_bytes

#: Lower-cases A-Z and turns every byte that no word has into a space.
FOLD = bytes(c if 48 <= c <= 57 or 97 <= c <= 122 or c >= 128 else c + 32 if 65 <= c <= 90 else 32 for c in range(256))

# Base phrases and the labels they give.
PHRASES = {
    "under the mit license": "mit",
    "apache license version 2": "apache-2",
    "cc by nc": "cc-by-nc",
}


@dataclass(frozen=True)
class Template:
    """``keys`` are phrases of the notice that must stand where it is found, in this order."""

    label: str
    notice: str
    keys: tuple[str, ...]


_GRANT = "permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files the software to deal in the software without restriction including without limitation the rights to use copy modify merge publish distribute sublicense and or sell copies of the software and to permit persons to whom the software is furnished to do so subject to the following conditions"
_BSD = "redistribution and use in source and binary forms with or without modification are permitted provided that the following conditions are met"
_BSD_SOURCE = "redistributions of source code must retain the above copyright notice this list of conditions and the following disclaimer"
_BSD_BINARY = "redistributions in binary form must reproduce the above copyright notice this list of conditions and the following disclaimer in the documentation and or other materials provided with the distribution"
_BSD_NAMES = "neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission"
_GNU = "this program is free software you can redistribute it and or modify it under the terms of the gnu {} as published by the free software foundation either version {} of the license or at your option any later version"


def _gnu(label: str, name: str, version: str) -> Template:
    return Template(label, _GNU.format(name, version), (f"gnu {name}", f"version {version} of the license"))


def _creative(label: str, name: str) -> Template:
    return Template(label, f"this work is licensed under a creative commons {name} 4 0 international license", (f"creative commons {name} 4 0",))


# Notices as license texts and file headers have them.
TEMPLATES = (
    Template("mit", _GRANT + " the above copyright notice and this permission notice shall be included in all copies or substantial portions of the software", ("permission is hereby granted", "associated documentation files", "sublicense")),
    Template("mit", _GRANT.partition(" the software")[0], ("permission is hereby granted", "associated documentation files")),
    Template("isc", "permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted provided that the above copyright notice and this permission notice appear in all copies", ("with or without fee is hereby granted",)),
    Template("bsd", _BSD, ("source and binary forms",)),
    Template("bsd-2", f"{_BSD} 1 {_BSD_SOURCE} 2 {_BSD_BINARY}", ("source and binary forms", "redistributions of source code", "redistributions in binary form")),
    Template("bsd-3", f"{_BSD} 1 {_BSD_SOURCE} 2 {_BSD_BINARY} 3 {_BSD_NAMES}", ("source and binary forms", "redistributions in binary form", "endorse or promote products")),
    Template("zlib", "this software is provided as is without any express or implied warranty in no event will the authors be held liable for any damages arising from the use of this software permission is granted to anyone to use this software for any purpose including commercial applications and to alter it and redistribute it freely subject to the following restrictions", ("will the authors be held liable", "alter it and redistribute it freely")),
    Template("boost-1", "permission is hereby granted free of charge to any person or organization obtaining a copy of the software and accompanying documentation covered by this license", ("person or organization", "covered by this license")),
    Template("unlicense", "this is free and unencumbered software released into the public domain anyone is free to copy modify publish use compile sell or distribute this software", ("free and unencumbered software", "public domain")),
    Template("wtfpl", "do what the fuck you want to public license", ("what the fuck you want",)),
    Template("apache-2", "licensed under the apache license version 2 0 the license you may not use this file except in compliance with the license you may obtain a copy of the license at", ("apache license version 2", "except in compliance with the license")),
    Template("apache-2", "unless required by applicable law or agreed to in writing software distributed under the license is distributed on an as is basis without warranties or conditions of any kind either express or implied", ("applicable law or agreed to in writing", "without warranties or conditions of any kind")),
    _gnu("gpl-2", "general public license", "2"),
    _gnu("gpl-3", "general public license", "3"),
    _gnu("lgpl-2.1", "lesser general public license", "2 1"),
    _gnu("lgpl-3", "lesser general public license", "3"),
    _gnu("agpl-3", "affero general public license", "3"),
    Template("gpl-2", "licensed under the gnu general public license version 2", ("gnu general public license version 2",)),
    Template("gpl-3", "licensed under the gnu general public license version 3", ("gnu general public license version 3",)),
    Template("mpl-2", "this source code form is subject to the terms of the mozilla public license v 2 0 if a copy of the mpl was not distributed with this file you can obtain one at", ("source code form is subject to", "mozilla public license v 2 0")),
    Template("epl-2", "this program and the accompanying materials are made available under the terms of the eclipse public license 2 0", ("eclipse public license 2 0",)),
    Template("cddl", "the contents of this file are subject to the terms of the common development and distribution license", ("common development and distribution license",)),
    Template("eupl", "licensed under the eupl you may not use this work except in compliance with the licence", ("eupl", "in compliance with the licence")),
    Template("artistic-2", "you may redistribute it and or modify it under the terms of the artistic license 2 0", ("artistic license 2 0",)),
    Template("ofl", "this font software is licensed under the sil open font license version 1 1", ("sil open font license",)),
    Template("python", "this license agreement is between the python software foundation psf and the individual or organization licensee", ("python software foundation", "licensee")),
    _creative("cc-by", "attribution"),
    _creative("cc-by-sa", "attribution sharealike"),
    _creative("cc-by-nd", "attribution noderivatives"),
    _creative("cc-by-nc", "attribution noncommercial"),
    _creative("cc-by-nc-sa", "attribution noncommercial sharealike"),
    _creative("cc-by-nc-nd", "attribution noncommercial noderivatives"),
    Template("cc0", "to the extent possible under law the author has waived all copyright and related or neighboring rights to this work", ("to the extent possible under law", "waived all copyright")),
    Template("proprietary", "all rights reserved no part of this publication may be reproduced distributed or transmitted in any form or by any means without the prior written permission of the publisher", ("all rights reserved", "no part of this publication", "prior written permission")),
    *(Template(label, f"spdx license identifier {words}", (f"license identifier {words}",)) for label, words in (("mit", "mit"), ("apache-2", "apache 2 0"), ("bsd-2", "bsd 2 clause"), ("bsd-3", "bsd 3 clause"), ("isc", "isc"), ("gpl-2", "gpl 2 0"), ("gpl-3", "gpl 3 0"), ("lgpl-2.1", "lgpl 2 1"), ("lgpl-3", "lgpl 3 0"), ("agpl-3", "agpl 3 0"), ("mpl-2", "mpl 2 0"), ("epl-2", "epl 2 0"), ("cc0", "cc0 1 0"), ("unlicense", "unlicense"), ("zlib", "zlib"))),
)
#: Share of a notice's words (by IDF weight) that must stand near their places, and
#: how far from these they may be.
LEAST_SHARE, DRIFT = 0.6, 5


def fold(raw: bytes | None) -> list[bytes]:
    return (raw or b"").translate(FOLD).split()


def vocabulary(templates: tuple[Template, ...] = TEMPLATES) -> list[bytes]:
    return sorted({w for t in (*PHRASES, *(t.notice for t in templates)) for w in fold(t.encode())})


def keys_stand(words: list[bytes], keys: list[list[bytes]], lo: int, hi: int) -> bool:
    """Whether the key phrases stand in words[lo:hi], each behind the one before."""
    at = max(lo, 0)
    for key in keys:
        at = next((i for i in range(at, min(hi, len(words)) - len(key) + 1) if words[i] == key[0] and words[i : i + len(key)] == key), -1)
        if at < 0:
            return False
        at += len(key)
    return True


def share_at(words: list[bytes], notice: list[bytes], weight: list[float], start: int) -> float:
    """Greatest weight of notice words that stand in order, each within DRIFT of its
    place from ``start`` on, over the whole weight.

    A Fenwick tree over the places keeps the heaviest chain that ends before each."""
    first = max(start - DRIFT, 0)
    size = min(start + len(notice) + DRIFT, len(words)) - first
    heaviest = [0.0] * (max(size, 0) + 1)
    best = 0.0
    for p, (word, x) in enumerate(zip(notice, weight)):
        found = []
        for i in range(max(start + p - DRIFT, 0), min(start + p + DRIFT + 1, len(words))):
            if words[i] == word:
                k, before = i - first, 0.0
                while k > 0:
                    before = max(before, heaviest[k])
                    k &= k - 1
                found.append((i, x + before))
        for i, v in found:  # chains that end with this word do not go on with it
            best = max(best, v)
            k = i - first + 1
            while k <= size and heaviest[k] < v:
                heaviest[k] = v
                k += k & -k
    return best / sum(weight)


class RareTokenIndex:
    """Postings of template words by template, and the checks of a proposed place."""

    def __init__(self, df: dict[bytes, int], n_docs: int, templates: tuple[Template, ...] = TEMPLATES) -> None:
        self.vocabulary = frozenset(vocabulary(templates))
        self.idf = {w: math.log((1 + n_docs) / (1 + df.get(w, 0))) + 1.0 for w in self.vocabulary}
        self.phrases = [(fold(p.encode()), label) for p, label in PHRASES.items()]
        # a phrase is looked up by its rarest word
        self.rarest = [max(range(len(p)), key=lambda k: (self.idf[p[k]], -k)) for p, _ in self.phrases]
        self.notices = [(t.label, fold(t.notice.encode()), [fold(k.encode()) for k in t.keys]) for t in templates]
        self.weights = [[self.idf[w] for w in notice] for _, notice, _ in self.notices]
        self.needed = [frozenset(w for k in keys for w in k) for _, _, keys in self.notices]
        self.postings = []
        for _, notice, _ in self.notices:
            places: dict[bytes, list[int]] = defaultdict(list)
            for k, w in enumerate(notice):
                places[w].append(k)
            self.postings.append(dict(places))

    def looked_up(self, e: int, present: set[bytes]) -> list[bytes]:
        """The file's rarest words of a template. What is left over, without the heaviest
        looked-up place, weighs too little for a match, so that a match has two of them."""
        whole = sum(self.weights[e])
        own = sorted((w for w in self.postings[e] if w in present), key=lambda w: (-self.idf[w], w))
        left = sum(self.idf[w] * len(self.postings[e][w]) for w in own)
        out = []
        for w in own:
            if left + self.idf[own[0]] < LEAST_SHARE * whole * (1 - 1e-9):
                break
            out.append(w)
            left -= self.idf[w] * len(self.postings[e][w])
        return out

    def starts(self, e: int, chosen: list[bytes], where: dict[bytes, list[int]]) -> list[int]:
        """Where template ``e`` may begin: within DRIFT of the proposals of two of its places."""
        votes = sorted((i - p, p) for w in chosen for p in self.postings[e][w] for i in where.get(w, ()))
        out = set()
        for (low, p), (high, q) in zip(votes, votes[1:]):
            if p != q and high - low <= 2 * DRIFT:
                out.update(range(high - DRIFT, low + DRIFT + 1))
        return sorted(out)

    def scan(self, words: list[bytes]) -> tuple[int, int | None, int | None, list[str], list[str], float]:
        """n_base, first_word, last_word, base labels, all labels, score."""
        present = self.vocabulary.intersection(words)
        where: dict[bytes, list[int]] = defaultdict(list)
        phrases = [k for k, (phrase, _) in enumerate(self.phrases) if present.issuperset(phrase)]
        chosen = {e: self.looked_up(e, present) for e, need in enumerate(self.needed) if need <= present}
        asked = {self.phrases[k][0][self.rarest[k]] for k in phrases}.union(*chosen.values())
        if asked:
            for i, w in enumerate(words):
                if w in asked:
                    where[w].append(i)
        starts, base, more, score = [], set(), set(), 0.0
        for k in phrases:
            phrase, label = self.phrases[k]
            at = self.rarest[k]
            found = [i - at for i in where[phrase[at]] if i >= at and words[i - at : i - at + len(phrase)] == phrase]
            if found:
                starts += found
                base.add(label)
                score = 1.0
        for e, own in chosen.items():
            label, notice, keys = self.notices[e]
            best = 0.0
            for s in self.starts(e, own, where):
                if keys_stand(words, keys, s - DRIFT, s + len(notice) + DRIFT):
                    best = max(best, share_at(words, notice, self.weights[e], s))
                    if best >= 1.0 - 1e-9:  # no other place can weigh more
                        break
            if best >= LEAST_SHARE:
                more.add(label)
                score = max(score, best)
        return len(starts), min(starts, default=None), max(starts, default=None), sorted(base), sorted(base | more), round(min(score, 1.0), 6)


def word_frequencies(docs: DataFrame, text_col: str = "text", templates: tuple[Template, ...] = TEMPLATES) -> tuple[dict[bytes, int], int]:
    """Documents of the whole corpus that hold each template word, and how many
    documents there are. The vocabulary is fixed, so a partition sends one row for
    each of its words at most."""
    words = vocabulary(templates)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own, counts, n = frozenset(words), Counter(), 0
        for batch in batches:
            for raw in as_bytes(batch.column(0)):
                n += 1
                counts.update(own.intersection(fold(raw)))
        yield pa.RecordBatch.from_arrays([pa.array([w.decode() for w in counts] + [""]), pa.array([*counts.values(), n], pa.int64())], names=["word", "n"])

    rows = docs.select(text_col).mapInArrow(run, "word string, n long").groupBy("word").agg(F.sum("n").alias("n")).collect()
    df = {r["word"].encode(): r["n"] for r in rows}
    return df, df.pop(b"", 0)


def scan_licenses(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", templates: tuple[Template, ...] = TEMPLATES) -> DataFrame:
    """One row per document: id, n_words, n_base, first_word, last_word, base_labels, labels, score.

    Two passes over the texts and no shuffle of them. A null or empty text has no
    words, no places, empty label strings and score 0. Places may overlap and all
    count; several notices at one place give a label each. ``score`` is the greatest
    share of a notice that stands in place, 1 where a base phrase does. Repeated rows
    are scanned each; a very long text is held as a list of its words.
    """
    df, n_docs = word_frequencies(docs, text_col, templates)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        index = RareTokenIndex(df, n_docs, templates)
        for batch in batches:
            rows = []
            for raw in as_bytes(batch.column(1)):
                words = fold(raw)
                n, first, last, base, labels, score = index.scan(words)
                rows.append((len(words), n, first, last, ",".join(base), ",".join(labels), score))
            cols = list(zip(*rows)) or [()] * 7
            kinds = [pa.int64()] * 4 + [pa.string()] * 2 + [pa.float64()]
            yield pa.RecordBatch.from_arrays([batch.column(0), *(pa.array(c, k) for c, k in zip(cols, kinds))], names=[id_col, "n_words", "n_base", "first_word", "last_word", "base_labels", "labels", "score"])

    kind = docs.schema[id_col].dataType.simpleString()
    return docs.select(id_col, text_col).mapInArrow(run, f"`{id_col}` {kind}, n_words long, n_base long, first_word long, last_word long, base_labels string, labels string, score double")


def op8_license_scans(spark, sf_dir: str) -> DataFrame:
    return scan_licenses(spark.read.parquet(f"{sf_dir}/documents.parquet"))
