"""Substring dedup: planted passages go from all documents but the first, everything else stays as it is."""

import random
import re

import numpy as np

from deltatree.llm import substrings as S


def words(rng, n):
    return " ".join("".join(rng.choices("abcdefghijklmnopé", k=rng.randint(1, 9))) for _ in range(n))


def planted():
    rng = random.Random(9)
    passage = [words(rng, 51 + 10 * i) for i in range(3)]
    rows, held = [], {}
    for i in range(40):
        text = words(rng, rng.randint(60, 200))
        if i % 4 == 0:
            p = passage[(i // 4) % 3]
            at = rng.choice([k for k, c in enumerate(text) if c == " "] + [0])
            text = text[:at] + (" " if at else "") + p + " " + text[at:].lstrip()
            held[i] = p
        rows.append((i, text))
    return rows, held


def test_planted_passages(documents):
    rows, held = planted()
    got = {r.doc_id: r for r in S.substring_report(documents(rows)).collect()}
    first = {p: min(i for i, q in held.items() if q == p) for p in held.values()}
    for i, text in rows:
        r = got[i]
        if i in held and i != first[held[i]]:
            assert r.repeated and r.first_doc_ids[0] == first[held[i]] and held[i] not in r.text
            assert r.n_removed >= 0.6 * len(held[i]) and r.n_removed <= len(held[i]) + 2
            left = iter(r.text.split())  # what stays is a subsequence of the words
            assert all(any(w == x for x in text.split()) for w in left)
        else:
            assert (r.text, r.n_removed, r.repeated) == (text, 0, False)


def test_copies_and_odd_rows(documents):
    rng = random.Random(2)
    long, short = words(rng, 90), words(rng, 12)
    rows = [(5, long), (3, long), (3, long), (4, long), (None, long), (6, short), (7, short), (8, None), (9, None), (10, ""), (11, "x" * 30000), (12, "x" * 30000),
            (13, "漢" * 3000), (14, long + "\n" + long), (15, words(rng, 2000))]
    got = sorted(((r.doc_id, r.text) for r in S.substring_report(documents(rows)).collect()), key=str)
    want = dict(rows) | {5: "", 4: "", None: ""}
    assert all(want[i] == t for i, t in got if i != 14)
    assert len(dict(got)[14].split()) < 40
    assert S.substring_report(documents([])).collect() == []


def test_columns_stay(documents):
    rows, _ = planted()
    docs = documents(rows).selectExpr("*", "cast(length(text) as long) as n_chars", "'a' as _row", "'b' as digests", "'c' as _key", "1 as _id")
    out = S.remove_repeats(docs)
    assert out.dtypes == docs.dtypes
    got = out.collect()
    assert len(got) == len(rows) and all(r.n_chars == len(r.text) and (r._row, r.digests, r._id) == ("a", "b", 1) for r in got)


def test_chunks_shift_with_the_text():
    text = words(random.Random(4), 400).encode()
    moved = b"one more word " + text
    def chunks(t):
        starts, _ = S.chunk_starts(np.frombuffer(t, np.uint8), np.array([0, len(t)]))
        assert b"".join(t[b:e] for b, e in zip(starts, [*starts[1:], len(t)])) == t and all(t[s] & 0xC0 != 0x80 for s in starts)
        return [t[b:e] for b, e in zip(starts, [*starts[1:], len(t)])]
    a, b = chunks(text), chunks(moved)
    assert len(set(a) & set(b)) > 0.95 * len(a) and max(map(len, a)) <= S.MAX_CHUNK


def test_rows_without_an_id_are_documents_of_their_own(documents):
    rng = random.Random(12)
    long, passage = words(rng, 90), words(rng, 80)
    own = [words(rng, 70) for _ in range(6)]
    shared = [f"{o} {passage} {o[::-1]}" for o in own]
    docs = documents([(None, long)] * 3 + [(None, t) for t in shared] + [(None, None), (7, own[0] * 2)])
    got = S.substring_report(docs).collect()
    assert len(got) == 11 and sorted(r.text for r in got if r.text in ("", long)) == ["", "", long]
    assert sum(passage in (r.text or "") for r in got) == 1
    cut = [r for r in got if r.repeated]
    assert all(r.doc_id is None for r in cut) and sum(r.first_doc_ids == [None] for r in cut) >= 6
    kept = [r.text for r in S.remove_repeats(docs).collect()]
    assert kept.count(long) == 1 and sum(passage in (t or "") for t in kept) == 1


def test_scripts_without_blanks(documents):
    """Whole copies and long passages of Chinese, Japanese and Thai text go; short ones, and words around them, stay."""
    rng = random.Random(12)

    def text(first, last, n):
        return "".join(chr(rng.randrange(first, last)) for _ in range(n))

    chinese, thai, kana, wide = text(0x4E00, 0x9FA0, 4000), text(0x0E01, 0x0E2F, 900), text(0x3041, 0x3095, 600), text(0x20000, 0x20100, 300)
    shared = text(0x4E00, 0x9FA0, 200)
    rows = [(1, chinese), (2, chinese), (3, thai), (4, thai), (5, kana), (6, kana), (7, wide), (8, wide), (9, text(0x4E00, 0x9FA0, 300) + shared), (10, "own words " + shared + "。end of it"),
            (11, chinese[:30]), (12, text(0x4E00, 0x9FA0, 50))]
    got = {r.doc_id: r for r in S.substring_report(documents(rows)).collect()}
    for kept, gone in ((1, 2), (3, 4), (5, 6), (7, 8)):
        assert got[kept].text == dict(rows)[kept] and got[gone].text == "" and got[gone].first_doc_ids == [kept]
    assert got[9].text == rows[8][1] and got[12].text == rows[11][1] and got[11].text == rows[10][1]
    left = got[10].text
    assert left.startswith("own words ") and left.endswith("end of it") and len(left) < 20 + 2 * 24


def test_words_of_a_span():
    """Units by plain code, over spans that begin and end anywhere."""
    rng = random.Random(2)
    for _ in range(300):
        text = "".join(rng.choice(["a", "bc", " ", "\n", "漢", "字", "ไ", "é", "가", "𠀀", "x "]) for _ in range(rng.randrange(1, 40)))
        data = text.encode()
        cuts = sorted(rng.sample(range(len(text) + 1), 2)) if len(text) > 1 else [0, len(text)]
        b, e = (len(text[:c].encode()) for c in cuts)
        units = [(m.start(), m.end(), m[0]) for m in re.finditer("[漢字ไ𠀀]|[^\\s漢字ไ𠀀]+", text)]
        inside = [u for u in units if cuts[0] <= u[0] and u[1] <= cuts[1]]
        weight = sum(1 if u[2] in "漢字ไ𠀀" else 2 for u in inside)
        for least in (1, 2, 4):
            got = S.repeated_words(data, [(b, e)], least)
            assert bool(got) == (weight >= 2 * least), (text, cuts, got)
            if got:
                assert got[0][0] == len(text[:inside[0][0]].encode()) and got[0][1] >= len(text[:inside[-1][1]].encode())
