"""The pipeline: columns, effects of every stage, and the whole against plain code."""

import random
import re

import corpus_pipeline as C
from deltatree.session import cut_lineage


def test_stages_take_effect(spark, sf_dir, given):
    docs = given("documents")
    assert [n for n, _ in C.STAGES] == ["quality_rules", "ngram_jaccard_join", "substring_dedup", "benchmark_decontamination", "best_fit_packing"]
    tests = [re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", r.text.lower()) for r in given("benchmark").collect()]
    passages = {tuple(w[i:i + 10]) for w in tests for i in range(len(w) - 9)}
    now, sizes = docs, [docs.count()]
    for name, stage in C.STAGES[:-1]:
        now = cut_lineage(stage(spark, now, sf_dir), name)
        assert now.columns == docs.columns and dict(now.dtypes) == dict(docs.dtypes)
        sizes.append(now.count())
    assert sizes[0] > sizes[1] > sizes[2] == sizes[3] > sizes[4] > 0.3 * sizes[0]
    rows = now.collect()
    for r in rows:
        words = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", r.text.lower())
        assert not {tuple(words[i:i + 10]) for i in range(len(words) - 9)} & passages
        assert r.n_chars == len(r.text)
    packed = C.run(spark, sf_dir).collect()
    assert {r.doc_id for r in packed} == {r.doc_id for r in rows}


def test_clean_documents_pass_unchanged(spark, tmp_path):
    rng = random.Random(8)
    words = ["".join(rng.choices("aeioulmnrst", k=rng.randint(2, 9))) for _ in range(900)]
    rows = [(i, " ".join(rng.choices(words, k=120)), "en", "s", 0) for i in range(120)]
    bad = [(200 + i, " ".join(rng.choices(["$$$", "###", "BUY!!", "%%%"] + words[:9], k=120)), "en", "s", 0) for i in range(60)]
    leak = rows[7][1].split()[:12]
    extra = [(300, rows[3][1] + " end", "en", "s", 0), (301, " ".join(rng.choices(words, k=50) + leak), "en", "s", 0), (302, None, None, None, None)]
    docs = spark.createDataFrame([(i, t, a, b, None if t is None else len(t)) for i, t, a, b, _ in rows + bad + extra], "doc_id long, text string, lang string, source string, n_chars long")
    docs.write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(i, int(i < 200), 0) for i, *_ in rows[::2] + bad[::2]], "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    spark.createDataFrame([(1, " ".join(leak))], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    now = docs
    for name, stage in C.STAGES[:-1]:
        now = cut_lineage(stage(spark, now, str(tmp_path)), name)
    assert sorted((r.doc_id, r.text) for r in now.collect()) == sorted((i, t) for i, t, *_ in rows if i != 7)
    assert {r.doc_id for r in C.run(spark, str(tmp_path)).collect()} == {i for i, *_ in rows if i != 7}
