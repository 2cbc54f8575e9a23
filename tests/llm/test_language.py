"""Language identification: kernel values by brute force, held-out accuracy, odd rows."""

import zlib

import numpy as np
import pyarrow as pa

from deltatree.llm import language as L
from deltatree.llm.queries import op3_language_id


def test_kernel_counts_common_grams():
    texts = ["Abc abd", "abc", "", None, "123 !?", "é漢 b"]
    p = L.presence(pa.array(texts))

    def grams(t):
        data = "".join(c.lower() if c.isascii() and c.isalpha() else " " if c.isascii() else c for c in t or "").encode()
        return {data[i:i + n] for n in L.LENGTHS for i in range(len(data) - n + 1) if data[i:i + n].strip(b" ")}
    sets = [grams(t) for t in texts]
    want = [[len(a & b) / max(1, len(a) * len(b)) ** 0.5 for b in sets] for a in sets]
    assert np.allclose(p @ p.T, want, atol=1e-5)


def test_held_out_accuracy(spark, sf_dir, given):
    truth = {r.doc_id: (r.lang, r.text) for r in given("documents").collect()}
    got = op3_language_id(spark, sf_dir).collect()
    assert len(got) == len(truth)
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 3 == 1) and 0 <= r.score <= 1 for r in got)
    held = [r for r in got if r.held_out]
    assert sum(r.lang_pred == truth[r.doc_id][0] for r in held) >= 0.95 * len(held)


def test_odd_rows(spark, given):
    odd = spark.createDataFrame([(1, None, "en"), (2, "", "en"), (3, "12 ?! \n", None), (8, "² ½ Ⅷ ①", None), (None, "the of and with", None), (4, "é", None), (4, "é", "de"), (5, "a" * 50000, None),
                                 (6, "漢字", None)], "doc_id long, text string, lang string")
    docs = given("documents").select("doc_id", "text", "lang").unionByName(odd).selectExpr("*", "1 as n", "2 as fold", "3 as unit", "4 as held_out")
    got = [r for r in L.languages(docs).collect()]
    assert len(got) == docs.count()
    assert sum(r.lang_pred == "und" for r in got) == 4 and all(r.score == 0 for r in got if r.lang_pred == "und")
    assert {r.lang_pred for r in got} <= {"en", "de", "fr", "es", "und"}
    assert {r.lang_pred for r in L.languages(docs.where("lang is null")).collect()} == {"und"}
    assert L.languages(docs.where("false")).collect() == []


def test_every_language_is_learned(spark, monkeypatch):
    """With many languages each has fewer texts and landmarks; none is left out."""
    monkeypatch.setattr(L, "ALL_LANDMARKS", 80)
    monkeypatch.setattr(L, "ALL_TEXTS", 160)
    words = {f"l{k:02d}": [f"{chr(97 + k % 26)}{chr(97 + k // 26)}{c}" * 2 for c in "bdfhjm"] for k in range(40)}
    rows = [(k * 100 + i, " ".join((w[i % 6:] + w[:i % 6]) * 3), lang) for k, (lang, w) in enumerate(words.items()) for i in range(12)]
    got = L.languages(spark.createDataFrame(rows, "doc_id long, text string, lang string")).collect()
    truth = {r[0]: r[2] for r in rows}
    assert {r.lang_pred for r in got} == set(words) and sum(r.lang_pred == truth[r.doc_id] for r in got) >= 0.95 * len(got)
