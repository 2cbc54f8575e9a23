"""Benchmark passages against a plain search of every window."""

import hashlib
import re

import pytest

from deltatree.llm import decontaminate as D

WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def words(text):
    return WORD.findall(re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))


def brute(docs, items, window=10):
    tests = []
    for i, text in items:
        w = words(text)
        m = min(window, len(w))
        tests += [(i, tuple(w[p:p + m])) for p in range(len(w) - m + 1)] if m else []
    out = []
    for doc, text in docs:
        w = words(text)
        hit, ids = set(), set()
        for i, t in tests:
            for p in range(len(w) - len(t) + 1):
                if tuple(w[p:p + len(t)]) == t:
                    hit |= set(range(p, p + len(t)))
                    ids |= {str(i)} - {"None"}
        out.append((doc, len(w), len(hit), len(ids), hashlib.sha256(",".join(sorted(ids)).encode()).hexdigest(), bool(hit)))
    return sorted(out, key=str)


ITEMS = [(1, "alpha beta gamma delta epsilon zeta eta theta iota kappa lambda mu"), (2, "Short Item here"), (10, "short item HERE"), (3, None), (4, "?!"),
         (None, "no id at all"), (5, "a a a a a a a a a a a a"), (6, "é à ü ñ ß 漢 字 x y z"), (1, "second text of item one which has many words in it")]
DOCS = [(1, "Alpha, beta gamma-delta epsilon zeta eta theta iota kappa lambda"), (2, "alpha beta gamma delta epsilon zeta eta theta iota"), (3, None), (4, ""),
        (5, "x short item. here short item here"), (6, "a " * 40), (7, "é à ü ñ ß 漢 字 x y z"), (8, "É à ü ñ ß 漢 字 x y z"), (None, "there is no id at all"), (5, "short item"),
        (9, "beta gamma delta epsilon zeta eta theta iota kappa lambda mu " * 3), (10, "clean text " * 300), (11, "short item"), (12, "here")]


@pytest.mark.parametrize("most_bytes", [D.BLOCK_BYTES, 40])
def test_against_brute_force(spark, documents, most_bytes):
    items = spark.createDataFrame(ITEMS, "item_id long, text string")
    got = [tuple(r) for r in D.contamination(documents(DOCS), items, most_bytes=most_bytes).collect()]
    assert sorted((r[:6] for r in got), key=str) == brute(DOCS, ITEMS)
    longest = {r[0]: (r[6], r[7]) for r in got}
    assert longest[1] == (11, "1") and longest[9] == (11, "1") and longest[10] == (0, None) and longest[2] == (0, None)
    assert longest[6] == (12, "5")
    kept = D.decontaminate(documents(DOCS).selectExpr("*", "1 as _found0", "'x' as items"), items, most_bytes=most_bytes)
    assert kept.columns == ["doc_id", "text", "_found0", "items"]
    assert sorted(str(r[0]) for r in kept.collect()) == sorted(str(r[0]) for r in got if not r[5])


def test_repeated_items_are_gathered_once(spark, documents):
    """A test that a benchmark repeats very often is one test; windows of many tests are found by one table."""
    items = spark.createDataFrame([ITEMS[0]] * 5000 + ITEMS[1:], "item_id long, text string")
    blocks, read = D._blocks(items, D.BLOCK_BYTES)
    assert blocks == 1 and len(read(0)) == len(ITEMS)
    blocks, read = D._blocks(items, 100)
    assert sum(len(read(b)) for b in range(blocks)) == len(ITEMS) and 2 < blocks < 10
    got = [tuple(r)[:6] for r in D.contamination(documents(DOCS), items, most_bytes=100).collect()]
    assert sorted(got, key=str) == brute(DOCS, ITEMS)


def test_no_items_and_no_documents(spark, documents):
    none = spark.createDataFrame([], "item_id long, text string")
    assert all(not r.contaminated and r.n_items == 0 for r in D.contamination(documents(DOCS), none).collect())
    assert D.contamination(documents([]), none).collect() == []
