"""URL filter: rules by plain code, likelihoods by a plain model, held-out verdicts, odd rows."""

import collections
import random
import re
import zlib

import numpy as np
import pyarrow as pa

from deltatree.llm import urls as U
from deltatree.llm.queries import URL_RULES, op10_url_filters


def plain(url):
    if not url or "://" not in url:
        return "", "", None, None
    rest = url.split("://", 1)[1]
    host = re.split(r"[/?#]", rest, maxsplit=1)[0]
    path = re.split(r"[?#]", rest[len(host):], maxsplit=1)[0]
    host = re.sub("[A-Z]", lambda m: m[0].lower(), host)
    fits = []
    for kind, rule in URL_RULES:
        h, p = rule.split("/", 1)
        if (host == h or host.endswith("." + h)) and path.startswith("/" + p):
            fits.append((len(rule), rule, kind))
    best = max(fits, default=(0, None, None))
    return host, path, best[1], best[2]


ODD = [None, "", "no scheme", "http://", "HTTP://EXAMPLE.ORG/es/x", "http://org/", "http://borg/", "http://a.org", "http://a.b.example.org/en/12?x=/", "x://y://z.org/",
       "http://example.org/en/1", "http://example.org?p=/es/", "http://w.com/fr/#a", "http://w.com/de/", "http://É.com/de/", "http://a.net/" + "x" * 20000, "http://a.org\n/x"]


def test_rules_and_odd_rows(spark):
    rows = [(i, u) for i, u in enumerate(ODD * 2)] + [(None, "http://w.com/fr/a")]
    pages = spark.createDataFrame(rows, "page_id long, url string").selectExpr("*", "'h' as host", "1 as verdict", "2 as text", "3 as html")
    got = U.url_verdicts(pages, URL_RULES).collect()
    assert sorted((r[:4] for r in (tuple(x) for x in got)), key=str) == sorted(((i, *plain(u)[:3]) for i, u in rows), key=str)
    assert all(r.verdict == (plain(dict(rows)[r.page_id])[3] or ("allow" if r.score >= 0.5 else "block")) for r in got if r.page_id is not None)
    assert U.url_verdicts(pages.where("false"), URL_RULES).collect() == []
    assert {r.score for r in U.url_verdicts(pages.where("url like '%/fr/%'"), URL_RULES).collect()} == {0.5}


def test_likelihood_by_a_plain_model():
    texts = ["abcabd", "abc", "xyz", ""]
    pairs, contexts, at = U._places(pa.array(texts))
    counts = np.array([np.bincount(pairs.ravel(), minlength=U.SIZE), np.bincount(contexts.ravel(), minlength=U.SIZE)])
    seen = {}
    for t in texts:
        full = "\2" * U.ORDER + t + "\3"
        for i in range(U.ORDER, len(full)):
            for o in range(U.ORDER + 1):
                c = full[i - o:i]
                seen[c] = seen.get(c, 0) + 1
                seen[c, full[i]] = seen.get((c, full[i]), 0) + 1

    def p(full, i, o):
        if o < 0:
            return 1 / 256
        c = full[i - o:i]
        return (seen.get((c, full[i]), 0) + U.PRIOR * p(full, i, o - 1)) / (seen.get(c, 0) + U.PRIOR)
    got = U.log_likelihood(pairs, contexts, counts)
    for k, t in enumerate(texts):
        full = "\2" * U.ORDER + t + "\3"
        want = [np.log(p(full, i, U.ORDER)) for i in range(U.ORDER, len(full))]
        assert np.allclose(got[at[k]:at[k + 1]], want)


def test_verdicts_without_a_rule(spark):
    rows = [(i, f"http://w{i % 7}.org/news/{'abcd'[i % 4]}{i}.html") for i in range(300)]
    rows += [(1000 + i, f"http://w{i % 7}.com/de/casino-win{'abcd'[i % 4]}{i}") for i in range(300)]
    rows += [(2000 + i, f"http://w{i % 7}.net/news/{i}.html") for i in range(50)] + [(3000 + i, f"http://w{i % 7}.net/xx/casino-win/{i}") for i in range(50)]
    got = {r.page_id: r for r in U.url_verdicts(spark.createDataFrame(rows, "page_id long, url string"), URL_RULES).collect()}
    assert all(got[2000 + i].rule is None and got[2000 + i].verdict == "allow" and got[3000 + i].verdict == "block" for i in range(50))


def test_given_pages(spark, sf_dir, given):
    truth = {r.page_id: plain(r.url) for r in given("pages").collect()}
    got = op10_url_filters(spark, sf_dir).collect()
    assert len(got) == len(truth) and all((r.host, r.path, r.rule) == truth[r.page_id][:3] and r.verdict == (truth[r.page_id][3] or r.verdict) for r in got)
    assert {r.verdict for r in got if r.rule is None} == {"allow", "block"}


def test_counts_are_exact_and_whole(spark):
    rng = random.Random(7)
    rows = [(f"h.x/{rng.getrandbits(40):x}", i % 3 > 0, i % 5 == 0) for i in range(12000)]
    model = U.count_models(spark.createDataFrame(rows, "text string, accepted boolean, held boolean").repartition(3)).toPandas()
    want = collections.Counter()
    for t, accepted, held in rows:
        full = "\2" * U.ORDER + t + "\3"
        want.update((full[i - U.ORDER:i + 1], 2 * held + (not accepted)) for i in range(U.ORDER, len(full)))
    longest = model[model["gram"].to_numpy(np.int64) >> 48 == 2 * U.ORDER + 1]
    assert len(longest) == len({g for g, _ in want}) > 1 << 16
    got = {(int(r.gram & (1 << 48) - 1).to_bytes(6, "big").decode(), k): n for r in longest.itertuples() for k, n in enumerate((r.n0, r.n1, r.n2, r.n3)) if n}
    assert got == want


def test_scores_are_those_of_all_labelled_urls(spark):
    rows = [(i, f"http://w{i % 7}.{'org/news' if i % 2 else 'com/de'}/{i * 7919 % 1000}") for i in range(200)] + [(1000 + i, f"http://x.net/{i}/news") for i in range(40)]
    pages = spark.createDataFrame(rows, "page_id long, url string").repartition(3)
    got = {r.page_id: r.score for r in U.url_verdicts(pages, URL_RULES).collect()}
    texts = {i: "".join(plain(u)[:2]) for i, u in rows}
    kinds = {i: plain(u)[3] for i, u in rows}

    def d(i, held):
        keys, pairs, contexts, _ = U._numbered(pa.array([texts[i]]))
        one = []
        for kind in ("allow", "block"):
            mine = [t for j, t in texts.items() if kinds[j] == kind and (held or zlib.crc32(t.encode()) % U.HELD)]
            grams, n = np.unique(np.concatenate([x.ravel() for x in U._grams(pa.array(mine))[:2]]), return_counts=True)
            c = np.array([dict(zip(grams.tolist(), n.tolist(), strict=True)).get(k, 0) for k in keys.tolist()])
            one.append(U.log_likelihood(pairs, contexts, np.array([c, c])).mean())
        return one[0] - one[1]
    some = [i for i in texts if i % 9 == 0]
    x, y = np.array([d(i, True) for i in some]), np.array([got[i] for i in some])
    near = (y > 1e-9) & (y < 1 - 1e-9)  # beyond that the logarithm is of rounded digits
    x, y = x[near], np.log(y[near] / (1 - y[near]))
    assert x.size > 8 and np.allclose(np.polyval(np.polyfit(x, y, 1), x), y, atol=1e-5)


def test_ngrams_are_never_broadcast(spark):
    rows = [(i, f"w{i % 7}.x", f"/{i}", None, "allow" if i % 2 else "block", f"w{i % 7}.x/{i}", i % 5 == 0) for i in range(400)]
    rows = U._in_blocks(spark.createDataFrame(rows, "page_id long, host string, path string, rule string, verdict string, text string, held boolean").repartition(3))
    model = U.count_models(rows.selectExpr("text", "verdict = 'allow' as accepted", "held"))
    kept = {k: spark.conf.get(k) for k in ("spark.sql.autoBroadcastJoinThreshold", "spark.sql.adaptive.enabled")}
    try:
        for adaptive in ("true", "false"):
            spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "1g")
            spark.conf.set("spark.sql.adaptive.enabled", adaptive)
            scored = U.differences(rows, model)
            assert len(scored.collect()) == 400
            plan = scored._jdf.queryExecution().executedPlan().toString()
            assert "SortMergeJoin" in plan and "Broadcast" not in plan and "ShuffledHashJoin" not in plan
    finally:
        for k, v in kept.items():
            spark.conf.set(k, v)
