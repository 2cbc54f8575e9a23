"""Packing: ids of the tokenizers library, exact pieces, gapless sequences, few of them."""

import random
import zlib
from collections import defaultdict

import numpy as np
import public_tokenizers
import pytest
from tokenizers import Tokenizer

from deltatree.llm import packing as K

PATH = public_tokenizers.path("byte_bpe_50k.json")
TEXTS = [None, "", " ", "  two  spaces ", "a\n\n b \t c", "it's we'll THEY'RE", "漢字 é ü 😀  x y", "<|endoftext|> is text", "a <|endoftext|> b<|endoftext|><|endoftext|>\n", "<|endoftext", "x" * 3000, "1234 5678, #$%!",
         "word " * 2047, "word " * 2048, "a" + " a" * 5000, "\r\n end\n"]


@pytest.fixture(scope="module")
def plain():
    tokenizer = Tokenizer.from_file(PATH)
    return lambda t: tokenizer.encode(t or "", add_special_tokens=False).ids + [0]


def check(rows, texts, plain, length=2048):
    pieces, sequences = defaultdict(dict), defaultdict(list)
    for r in rows:
        pieces[r.doc_id][r.piece] = r
        sequences[r.sequence_id].append((r.offset, r.length))
    for doc, text in texts.items():
        ids, at = plain(text), 0
        mine = [pieces[doc][i] for i in range(len(pieces[doc]))]
        for i, r in enumerate(mine):
            assert r.start == at and (r.length == length or i == 0) and r.length <= length
            assert r.ids_crc32 == zlib.crc32(np.array(ids[at:at + r.length], "<u4").tobytes())
            at += r.length
        assert at == len(ids) and len(mine) == -(-len(ids) // length)
    for places in sequences.values():
        end = 0
        for offset, n in sorted(places):
            assert offset == end
            end += n
        assert end <= length
    return len(sequences)


def test_pieces_and_sequences(documents, plain, given):
    rows = list(enumerate(TEXTS)) + [(100 + r[0], r[1]) for r in given("documents").select("doc_id", "text").collect()]
    texts = dict(rows)
    got = K.pack(documents(rows), PATH).collect()
    used = check(got, texts, plain)
    full = sum(r.length == 2048 for r in got)
    assert used - full <= -(-sum(r.length for r in got if r.length < 2048) // 2048) + 2
    small = K.pack(documents(rows), PATH, group=20).collect()
    check(small, texts, plain)


def test_repeated_rows_and_none(documents):
    got = K.pack(documents([(1, "same"), (1, "same"), (None, "x"), (None, None)]), PATH).collect()
    assert len(got) == 4 and len({(r.sequence_id, r.offset) for r in got}) == 4
    assert K.pack(documents([]), PATH).collect() == []


def test_equal_rows_are_spread(documents):
    got = K.pack(documents([(1, "word " * 1000)] * 600 + [(None, "x")] * 300), PATH, group=100).collect()
    groups = defaultdict(int)
    for r in got:
        groups[r.sequence_id % 9] += 1
    assert len(got) == 900 and len(groups) == 9 and max(groups.values()) < 200


def test_rule():
    sizes = np.array(random.Random(1).choices(range(1, 2048), k=3000))
    sequence, offset = K.pack_groups(sizes)
    total = np.bincount(sequence, sizes)
    gaps = []  # best fit by plain search
    for s in sorted(sizes, reverse=True):
        fits = [g for g in gaps if g >= s]
        if fits:
            gaps.remove(min(fits))
        gaps.append((min(fits) if fits else 2048) - s)
    assert total.max() <= 2048 and total.size <= 1.005 * len(gaps)
    one, _ = K.pack_groups(np.array([1024, 1024, 2047, 1]))
    assert len(set(one)) == 2
