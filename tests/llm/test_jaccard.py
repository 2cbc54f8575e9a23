"""The similarity join against all pairs by brute force."""

import random
import re

import pytest

from deltatree.llm import jaccard


def brute(rows, k, percent):
    sets = []
    for _, text in rows:
        words = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
        sets.append({tuple(words[i:i + k]) for i in range(max(1, len(words) - k + 1))} if words else set())
    label = list(range(len(rows)))

    def find(x):
        while label[x] != x:
            x = label[x]
        return x

    for i in range(len(rows)):
        for j in range(i):
            if sets[i] and sets[j] and 100 * len(sets[i] & sets[j]) >= percent * len(sets[i] | sets[j]):
                label[find(i)] = find(j)
    ids = {}
    for i, (doc, _) in enumerate(rows):
        if doc is not None:
            ids[find(i)] = min(doc, ids.get(find(i), doc))
    return sorted(((doc, len(sets[i]), ids.get(find(i))) for i, (doc, _) in enumerate(rows)), key=str)


def variants(seed=5, n=60):
    rng = random.Random(seed)
    base = [rng.choice("abcdefghij") * rng.randint(1, 4) + str(rng.randint(0, 40)) for _ in range(80)]
    rows = []
    for i in range(n):
        words = list(base)
        for _ in range(rng.choice([0, 1, 1, 2, 2, 3, 4, 8])):
            words[rng.randrange(len(words))] = f"x{rng.randint(0, 9)}"
        rows.append((1000 + i, " ".join(words)))
    return rows


EDGE = [
    (1, None), (2, ""), (3, " \t\n"), (4, "one"), (5, "One"), (6, "one two"), (7, "one  two"), (8, "a b c"), (9, "A B C"), (9, "a b c"),
    (None, "a b c"), (None, "only null ids here"), (12, "É é ß 漢字 a b"), (13, "é É ß 漢字 a b"), (14, "é É ß 漢字 a b"), (15, "w" * 5000),
    (16, " ".join(f"w{i}" for i in range(9))), (17, " ".join(f"w{i}" for i in range(10))), (18, " ".join(f"w{i}" for i in range(12))),
    (19, " ".join(f"w{i}" for i in range(11))), (-3, " ".join(f"w{i}" for i in range(13))),
]


def test_blocks_by_their_grams(documents, monkeypatch):
    """A few long texts are too much for one task as many short ones are; a representative's equal rows are held once."""
    monkeypatch.setattr(jaccard, "BLOCK_GRAMS", 300)
    rows = EDGE + variants() + variants(6, 30) + variants()[:1] * 200
    got = jaccard.jaccard_components(documents(rows), 3, 90).collect()
    assert sorted((tuple(r) for r in got), key=str) == brute(rows, 3, 90)


@pytest.mark.parametrize("k, percent, block", [(3, 90, 2048), (5, 80, 8), (3, 90, 5)])
def test_against_brute_force(documents, k, percent, block):
    rows = EDGE + variants() + variants(6, 30)
    got = jaccard.jaccard_components(documents(rows), k, percent, block=block).collect()
    assert sorted((tuple(r) for r in got), key=str) == brute(rows, k, percent)


def test_many_copies_and_no_rows(documents):
    rows = [(i, "the same text in every row of a third of all") for i in range(300)] + [(1000 + i, f"row {i} of its own kind") for i in range(50)]
    got = {r[0]: r[2] for r in jaccard.jaccard_components(documents(rows)).collect()}
    assert all(got[i] == 0 for i in range(300)) and all(got[1000 + i] == 1000 + i for i in range(50))
    assert jaccard.jaccard_components(documents([])).collect() == []


def test_keep_one(documents):
    rows = EDGE + variants() + [(1000, variants()[5][1]), (1000, variants()[0][1])]
    docs = documents(rows).selectExpr("*", "'a' as _row", "1 as _id", "2 as stays", "3 as mark")
    kept = jaccard.keep_one(docs, 3, 90)
    assert kept.dtypes == docs.dtypes
    got = [(r.doc_id, r.text) for r in kept.collect()]
    groups = brute(rows, 3, 90)
    empty = [r for r in rows if not (r[1] or "").split()]
    assert sorted(i for i, t in got if (i, t) not in empty and i is not None) == sorted({c for _, n, c in groups if n and c is not None})
    assert sorted((r for r in got if r in empty), key=str) == sorted(empty, key=str) and got.count((None, "only null ids here")) == 1


def test_texts_of_one_id_meet_their_own_tasks(documents):
    rows = [(None, text) for _, text in variants(7, 40)] + [(5, text) for _, text in variants(8, 40)]
    docs = documents(sorted(set(rows), key=str))
    tasks = jaccard.document_sets(docs, 3).selectExpr("doc_id", "mark", "digest", "1L as task")
    assert jaccard.task_texts(docs, tasks).count() == tasks.count() == len(set(rows))
    got = jaccard.jaccard_components(docs, 3, 90).collect()
    assert sorted((tuple(r) for r in got), key=str) == brute(sorted(set(rows), key=str), 3, 90)
