"""Licence scan with a positional index of rare words; DataFrame functions only.

Licence templates are posted in an index under one word each: of the words of a template's key phrase the one with
the highest inverse document frequency, counted over all documents. A file's words are looked up in the index; every place
of such a word, less the word's place in the template, is a place where the template may begin. There the key phrase is
verified word by word, and the other words of the template are intersected by relative position, weighed by their inverse
document frequency.
"""

from __future__ import annotations

from dataclasses import dataclass
from math import log

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: What is no word: everything below 0x80 but digits and a-z.
_GAP = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"

#: Phrases of the base labels.
BASE = (("mit", "mit license"), ("apache", "apache license"), ("gpl", "general public license"))


@dataclass(frozen=True)
class Template:
    label: str
    words: str
    key: str


#: Usual notices of public licences, lower case, without punctuation; the key phrase is a part of the words. Fixed values.
NOTICES = (
    Template("mit", "released under the mit license", "mit license"),
    Template("mit", "permission is hereby granted free of charge to any person obtaining a copy of this software", "permission is hereby granted free of charge"),
    Template("apache", "licensed under the apache license version 2 0", "apache license"),
    Template("gpl", "licensed under the gnu general public license version 3", "general public license"),
    Template("bsd", "redistribution and use in source and binary forms with or without modification are permitted", "redistribution and use in source and binary forms"),
    Template("mpl", "subject to the terms of the mozilla public license v 2 0", "mozilla public license"),
    Template("cc-by-nc", "licensed under cc by nc 4 0", "cc by nc"),
    Template("cc-by", "creative commons attribution 4 0 international license", "creative commons attribution"),
    Template("all-rights-reserved", "copyright all rights reserved", "all rights reserved"),
)

#: Whole texts of short licences, and the notices that the long ones ask for in every file. Fixed values.
WHOLE = (
    Template("mit", """permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files the software to deal
in the software without restriction including without limitation the rights to use copy modify merge publish distribute sublicense and or sell copies of the software and to
permit persons to whom the software is furnished to do so subject to the following conditions the above copyright notice and this permission notice shall be included in all
copies or substantial portions of the software the software is provided as is without warranty of any kind express or implied including but not limited to the warranties of
merchantability fitness for a particular purpose and noninfringement in no event shall the authors or copyright holders be liable for any claim damages or other liability
whether in an action of contract tort or otherwise arising from out of or in connection with the software or the use or other dealings in the software""",
             "permission is hereby granted free of charge"),
    Template("isc", """permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted provided that the above copyright
notice and this permission notice appear in all copies the software is provided as is and the author disclaims all warranties with regard to this software including all implied
warranties of merchantability and fitness in no event shall the author be liable for any special direct indirect or consequential damages or any damages whatsoever resulting
from loss of use data or profits whether in an action of contract negligence or other tortious action arising out of or in connection with the use or performance of this
software""", "and or distribute this software for any purpose"),
    Template("bsd", """redistribution and use in source and binary forms with or without modification are permitted provided that the following conditions are met 1
redistributions of source code must retain the above copyright notice this list of conditions and the following disclaimer 2 redistributions in binary form must reproduce the
above copyright notice this list of conditions and the following disclaimer in the documentation and or other materials provided with the distribution this software is provided
by the copyright holders and contributors as is and any express or implied warranties including but not limited to the implied warranties of merchantability and fitness for a
particular purpose are disclaimed in no event shall the copyright holder or contributors be liable for any direct indirect incidental special exemplary or consequential damages
including but not limited to procurement of substitute goods or services loss of use data or profits or business interruption however caused and on any theory of liability
whether in contract strict liability or tort including negligence or otherwise arising in any way out of the use of this software even if advised of the possibility of such
damage""", "redistribution and use in source and binary forms"),
    Template("zlib", """this software is provided as is without any express or implied warranty in no event will the authors be held liable for any damages arising from the use of
this software permission is granted to anyone to use this software for any purpose including commercial applications and to alter it and redistribute it freely subject to the
following restrictions 1 the origin of this software must not be misrepresented you must not claim that you wrote the original software if you use this software in a product
an acknowledgment in the product documentation would be appreciated but is not required 2 altered source versions must be plainly marked as such and must not be misrepresented
as being the original software 3 this notice may not be removed or altered from any source distribution""", "origin of this software must not be misrepresented"),
    Template("unlicense", """this is free and unencumbered software released into the public domain anyone is free to copy modify publish use compile sell or distribute this
software either in source code form or as a compiled binary for any purpose commercial or non commercial and by any means""", "free and unencumbered software"),
    Template("apache", """licensed under the apache license version 2 0 the license you may not use this file except in compliance with the license you may obtain a copy of the
license at http www apache org licenses license 2 0 unless required by applicable law or agreed to in writing software distributed under the license is distributed on an as is
basis without warranties or conditions of any kind either express or implied see the license for the specific language governing permissions and limitations under the
license""", "licensed under the apache license"),
    Template("gpl", """this program is free software you can redistribute it and or modify it under the terms of the gnu general public license as published by the free software
foundation either version 3 of the license or at your option any later version this program is distributed in the hope that it will be useful but without any warranty without
even the implied warranty of merchantability or fitness for a particular purpose see the gnu general public license for more details""", "terms of the gnu general public license"),
)
TEMPLATES = NOTICES + WHOLE
#: Share of a template's weight that has to be in place beside the key phrase.
COVERAGE = 0.5


def word_list(text: Column) -> Column:
    """Words of a text whose A-Z are lower case.

    ``lower`` also changes letters beyond ASCII, all of which are word characters before and after; it turns none
    of them into a letter of a key phrase but the Kelvin sign, which has a ``k``.
    """
    return F.array_remove(F.split(F.lower(F.coalesce(text, F.lit(""))), _GAP), "")


def document_frequency(words: DataFrame, vocabulary: list[str]) -> tuple[int, dict[str, int]]:
    """Rows of ``words``, and in how many of them each word of the vocabulary occurs."""
    total = words.count()
    found = words.select(F.explode(F.array_intersect("words", F.array(*map(F.lit, vocabulary)))).alias("word")).groupBy("word").agg(F.count("*").alias("n"))
    return total, {r["word"]: r["n"] for r in found.collect()}


def _start(phrase: list[str], within: list[str]) -> int:
    return next(i for i in range(len(within)) if within[i:i + len(phrase)] == phrase)


def _postings(total: int, df: dict[str, int], templates: tuple[Template, ...], base: tuple[tuple[str, str], ...]) -> tuple[list[str], Column]:
    """Index words, and the index, a map from word to its postings: the word's place in the template, words, weights, key, label."""
    weight = {w: log(1 + max(total, 1) / (1 + df.get(w, 0))) for t in (*(t.words for t in templates), *(p for _, p in base)) for w in t.split()}
    postings: dict[str, list[Column]] = {}
    for label, words, key, is_base in (*((t.label, t.words, t.key, False) for t in templates), *((name, p, p, True) for name, p in base)):
        own, phrase = words.split(), key.split()
        begin = _start(phrase, own)
        rare = max(range(len(phrase)), key=lambda i: (weight[phrase[i]], -i))
        sums = sum(weight[w] for w in own)
        postings.setdefault(phrase[rare], []).append(F.struct(
            F.lit(begin + rare).alias("at"), F.array(*map(F.lit, own)).alias("words"),
            F.array(*(F.lit(weight[w] / sums) for w in own)).alias("weights"), F.lit(begin).alias("key_at"), F.lit(len(phrase)).alias("key_size"),
            F.lit(label).alias("label"), F.lit(is_base).alias("base")))
    return sorted(postings), F.create_map(*[x for word in sorted(postings) for x in (F.lit(word), F.array(*postings[word]))])


def license_scan(docs: DataFrame, templates: tuple[Template, ...] = TEMPLATES, base: tuple[tuple[str, str], ...] = BASE, coverage: float = COVERAGE) -> DataFrame:
    """One row per document: ``doc_id``, ``n_words``, ``n_base``, ``first_word``, ``last_word``, ``base_labels``, ``labels``, ``score``.

    ``n_base`` counts the places where the words of a phrase of ``base`` stand consecutively, ``first_word`` and ``last_word`` are the smallest and
    largest place of a first word (words from 0; null without one). ``labels`` adds the labels of templates whose key phrase is in the text and
    whose words are in place by ``coverage`` or more of their weight. ``score`` is the largest such share of a template at any place with
    its key phrase, to nine digits: 1 for a whole template, 0 without a key phrase; phrases of ``base`` don't count.

    * A null text counts as an empty one: zeros, empty labels. Texts are taken whole; a template may begin before the text or end behind it.
    * Repeated rows each give a row, a null ``doc_id`` too. No documents: no rows. Other columns are ignored, whatever their names.
    """
    words = docs.select(F.col("doc_id").cast("long").alias("doc_id"), word_list(F.col("text")).alias("words"))
    vocabulary = sorted({w for t in (*(t.words for t in templates), *(p for _, p in base)) for w in t.split()})
    anchors, index = _postings(*document_frequency(words, vocabulary), templates, base)

    indexed = F.array(*map(F.lit, anchors))
    # only files with a word of the index are looked at word by word
    places = F.when(F.arrays_overlap("words", indexed), F.filter(
        F.transform("words", lambda w, i: F.struct(w.alias("word"), i.alias("at"))), lambda x: x["word"].isin(anchors)))
    held = words.select("doc_id", "words", F.size("words").cast("long").alias("n_words"), places.alias("places"))

    def verified(start: Column, t: Column) -> Column:
        return F.forall(F.sequence(F.lit(0), t["key_size"] - 1), lambda j: F.coalesce(
            F.get("words", start + t["key_at"] + j) == F.get(t["words"], t["key_at"] + j), F.lit(False)))

    def in_place(start: Column, t: Column) -> Column:
        return F.aggregate(F.sequence(F.lit(0), F.size(t["words"]) - 1), F.lit(0.0), lambda total, j: total + F.when(
            F.get("words", start + j) == F.get(t["words"], j), F.get(t["weights"], j)).otherwise(0.0))

    def looked_up(p: Column) -> Column:
        mine = F.filter(F.col("postings")[p["word"]], lambda t: verified(p["at"] - t["at"], t))
        return F.transform(mine, lambda t: F.struct((p["at"] - t["at"]).cast("long").alias("start"), t["label"].alias("label"), t["base"].alias("base"),
                                                    in_place(p["at"] - t["at"], t).alias("share")))

    found = F.when(F.size("places") > 0, F.flatten(F.transform("places", looked_up)))
    matched = held.withColumn("postings", index).select("doc_id", "n_words", F.coalesce(found, F.array().cast(
        "array<struct<start:bigint,label:string,base:boolean,share:double>>")).alias("found"))
    bases = F.filter("found", lambda x: x["base"])

    def labels(rows: Column) -> Column:
        return F.array_join(F.array_sort(F.array_distinct(F.transform(rows, lambda x: x["label"]))), ",")

    starts = F.transform(bases, lambda x: x["start"])
    return matched.select(
        "doc_id", "n_words", F.size(bases).cast("long").alias("n_base"), F.array_min(starts).alias("first_word"), F.array_max(starts).alias("last_word"),
        labels(bases).alias("base_labels"), labels(F.filter("found", lambda x: x["base"] | (x["share"] >= coverage))).alias("labels"),
        F.round(F.least(F.lit(1.0), F.coalesce(F.array_max(F.transform(F.filter("found", lambda x: ~x["base"]), lambda x: x["share"])), F.lit(0.0))), 9).alias("score"))
