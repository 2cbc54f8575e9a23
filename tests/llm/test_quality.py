"""Quality classifier and quality rules: counts by brute force, held-out accuracy, odd rows."""

import random
import re
import zlib

import pytest

from deltatree.llm import features as X
from deltatree.llm import quality_rules as R
from deltatree.llm import quality_svm as S

ODD = [(1, None), (2, ""), (3, " \n\t "), (4, "x" * 20000), (5, "a b c d e " * 6), (6, "a b c d e\n" * 4 + "\n\n"), (7, "é ü #*$ %&|<> 漢字 zwei\n\n \nzwei\nzwei\n zwei"),
       (8, "one two three four five six seven eight nine ten"), (8, "one two three four five six seven eight nine"), (None, "a b"), (9, "a a a a a a a a a a")]


def brute(text):
    words = re.findall(r"[^\x20\x09-\x0D]+", text or "")
    seen, again = set(), 0
    for line in (text or "").split("\n"):
        if re.search(r"[^\x20\x09-\x0D]", line):
            again += line in seen
            seen.add(line)
    fives = [tuple(words[i:i + 5]) for i in range(len(words) - 4)]
    inside = {i + j for i, f in enumerate(fives) if fives.count(f) > 1 for j in range(5)}
    symbols = len(re.findall(r"[#*$%&|<>]", text or ""))
    failed = len(words) < 10 or 100 * len(inside) > 20 * len(words)
    return len(words), sum(map(len, words)), symbols, again, len(inside), failed


@pytest.fixture(scope="module")
def labels(spark):
    rows = [(i, i % 2, 0) for i in range(1000, 1100)] + [(None, 1, 0), (1000, None, 0), (1001, 0, 0), (1, 7, 0), (2, 1, 0)]
    return spark.createDataFrame(rows, "doc_id long, quality int, toxic int")


def corpus():
    rng = random.Random(3)
    good, bad = "the rain falls over a quiet town where people walk home slowly under old trees".split(), "BUY!! $$$ FREE!! click ### win%%% cash&&& NOW!!".split()
    return [(i, " ".join(rng.choices(good if i % 2 else bad, k=25))) for i in range(1000, 1100)]


def test_counts(spark, documents, labels, given):
    rows = ODD + [tuple(r) for r in given("documents").select("doc_id", "text").limit(60).collect()]
    got = R.quality_report(documents(rows), labels).collect()
    assert sorted(tuple(r)[:7] for r in got if r[0] is not None) == sorted((i, *brute(t)) for i, t in rows if i is not None)
    assert len(got) == len(rows) and not any(r.kept and r.base_failed for r in got)


def test_rules_keep_and_reject(spark, documents, labels):
    docs = documents(corpus() + ODD).selectExpr("*", "1 as label", "'x' as places", "'en' as kept")
    kept = R.keep_quality(docs, labels)
    assert kept.columns == docs.columns
    ids = {r.doc_id for r in kept.collect()}
    assert {i for i in range(1003, 1100) if i % 2} <= ids and not ids & {i for i in range(1002, 1100) if i % 2 == 0}
    assert R.keep_quality(documents([]), labels).collect() == []


def test_classifier_held_out(spark, documents, labels):
    got = S.quality_scores(documents(corpus() + ODD), labels).collect()
    assert len(got) == 100 + len(ODD) and all(0 <= r.score <= 1 and r.predicted == (r.score >= 0.3) for r in got)
    assert all(r.held_out == (r.doc_id is not None and zlib.crc32(str(r.doc_id).encode()) % 5 == 0) for r in got)
    assert all(r.predicted == r.doc_id % 2 for r in got if r.held_out and r.doc_id > 1001)


def test_classifier_ignores_held_out_labels(spark, documents, labels):
    turned = labels.selectExpr("doc_id", "case when crc32(cast(cast(doc_id as string) as binary)) % 5 = 0 then 1 - quality else quality end as quality")
    a, b = ({(r.doc_id, round(r.score, 9)) for r in S.quality_scores(documents(corpus()), x).collect()} for x in (labels, turned))
    assert a == b


def test_no_labels_and_no_documents(spark, documents, labels):
    none = labels.where("false")
    assert {r.score for r in S.quality_scores(documents(corpus()), none).collect()} == {0.5}
    assert S.quality_scores(documents([]), labels).collect() == []


@pytest.mark.parametrize("query, column", [("op1_quality_classifier", "predicted"), ("op6_quality_rules", "kept")])
def test_given_labels(spark, sf_dir, query, column):
    from deltatree.llm.queries import QUERIES

    larger = sf_dir.replace("0.001", "0.01")  # the smallest size has labels for 16 rejected texts only
    got = QUERIES[query](spark, larger).join(spark.read.parquet(f"{larger}/labels.parquet").selectExpr("doc_id", "quality as truth"), "doc_id").collect()
    rows = [r for r in got if (r.held_out if query[:3] == "op1" else not r.base_failed)]
    assert len(rows) > 10 and sum(int(r[column]) == r.truth for r in rows) >= 0.95 * len(rows)


def test_ratio_and_repeats():
    import numpy as np

    rows = [np.array([0, 1]), np.array([0, 2])]
    ratio = S.log_count_ratio(rows, np.array([1, 0]), 3)
    assert ratio[1] > 0 > ratio[2] and abs(ratio[0]) < 1e-12
    assert X.repeated_words(np.array([1, 2, 1, 2, 1], np.uint64), 5) == 0
