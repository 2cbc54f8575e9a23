"""Licence scan against plain code, on written-out and on given texts."""

import re
from math import log

from deltatree.llm import licenses as L

TEXTS = [None, "", "Released under the MIT License.", "mit  LICENSE, MIT-license mit", "Apache\nLicense and the Apache License, Version 2.0", "license mit", "xmit license",
         "This work is licensed under the GNU General Public License, version 3.", "general public license", "Licensed under CC BY-NC 4.0.", "cc by nc",
         "All rights reserved", "MIT", "permission is hereby granted, free of charge", "Permission is hereby granted, free of charge, to any person obtaining a copy of this software",
         "é MIT License ü", "MITé License", "mit license " * 3000, "word " * 9000, "MIT Lİcense", "apache license general public license mit license",
         "Copyright 2020 Someone. " + L.WHOLE[0].words, L.WHOLE[1].words[:300], "x " * 50 + L.WHOLE[3].words + " end", L.WHOLE[4].words.upper(), L.WHOLE[5].words, L.WHOLE[6].words + "\n" + L.WHOLE[2].words]


def plain(rows):
    lists = [re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", re.sub("[A-Z]", lambda m: m[0].lower(), t or "")) for _, t in rows]
    df = {}
    for words in lists:
        for w in set(words):
            df[w] = df.get(w, 0) + 1
    weight = lambda w: log(1 + len(rows) / (1 + df.get(w, 0)))
    out = []
    for (doc, _), words in zip(rows, lists, strict=True):
        base, labels, best = [], set(), 0.0
        for p in range(len(words)):
            for name, phrase in L.BASE:
                if words[p:p + len(phrase.split())] == phrase.split():
                    base.append((p, name))
        for t in L.TEMPLATES:
            own, key = t.words.split(), t.key.split()
            at = next(i for i in range(len(own)) if own[i:i + len(key)] == key)
            for p in (p for p in range(len(words)) if words[p:p + len(key)] == key):
                start = p - at
                share = sum(weight(w) for j, w in enumerate(own) if 0 <= start + j < len(words) and words[start + j] == w) / sum(map(weight, own))
                best = max(best, share)
                labels |= {t.label} if share >= L.COVERAGE else set()
        names = {n for _, n in base}
        out.append((doc, len(words), len(base), min((p for p, _ in base), default=None), max((p for p, _ in base), default=None), ",".join(sorted(names)),
                    ",".join(sorted(names | labels)), round(min(best, 1.0), 9)))
    return sorted(out, key=str)


def rows_of(frame):
    return sorted(((*tuple(r)[:7], round(r.score, 9)) for r in frame.collect()), key=str)


def test_against_plain_code(documents, given):
    rows = list(enumerate(TEXTS)) + [(None, "mit license"), (2, "mit license")] + [(1000 + r[0], r[1]) for r in given("documents").select("doc_id", "text").collect()]
    docs = documents(rows).selectExpr("*", "'x' as words", "1 as label", "2 as postings", "3 as places")
    assert rows_of(L.license_scan(docs)) == plain(rows)
    assert L.license_scan(docs.where("false")).collect() == []


def test_no_python_in_the_plan(documents):
    plan = L.license_scan(documents([(1, "mit license")]))._jdf.queryExecution().executedPlan().toString()
    assert not re.search("Python|Arrow|Pandas", plan)


def test_whole_texts_and_scores(documents):
    """A whole licence has score 1 whatever stands around it; a phrase alone has the share of its notice."""
    rows = [(i, f"head of file {i}\n{t.words}\ncode code") for i, t in enumerate(L.WHOLE)] + [(100, "see the mit license here"), (101, "general public license of nothing"), (102, "code")]
    got = {r.doc_id: r for r in L.license_scan(documents(rows)).collect()}
    for i, t in enumerate(L.WHOLE):
        assert t.label in got[i].labels.split(",") and got[i].score == 1.0
    assert 0 < got[100].score < 1 and 0 < got[101].score < 1 and got[102].score == 0 and got[100].base_labels == "mit"
