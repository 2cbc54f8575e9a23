"""Token counts against the tokenizers library, the merge loop against a plain one."""

import json
import random

import public_tokenizers
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from deltatree.llm import token_counts as C

PATH = public_tokenizers.path("byte_bpe_50k.json")
TEXTS = [None, "", " ", "  two  spaces ", "a\n\n b \t c", "it's we'll THEY'RE 'S", "漢字 é ü 😀  x y", "<|endoftext|>", "a <|endoftext|> b<|endoftext|>",
         "<|endoftext", "x" * 3000, "1234 5678, #$%!²½Ⅷ", "word " * 512, "word " * 513, "the" * 4000, "漢字" * 3000, " " * 5000, "\r\n end\n", "\x00\x7f́"]


TOKENIZER = Tokenizer.from_file(PATH)


def library_count(text):
    return len(TOKENIZER.encode(text or "", add_special_tokens=False).ids)


@pytest.fixture
def library():
    return library_count


def test_documents(documents, library, spark, sf_dir):
    rows = list(enumerate(TEXTS)) + [(None, "no id"), (3, "repeated"), (3, "repeated")]
    rows += [(100 + r[0], r[1]) for r in spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text").collect()]
    got = C.token_counts(documents(rows).selectExpr("*", "1 AS n_tokens", "2 AS n_bytes"), PATH).collect()
    want = [(i, len((t or "").encode()), library(t), library(t) > 512) for i, t in rows]
    assert sorted(map(tuple, got), key=repr) == sorted(want, key=repr)


def test_no_documents(documents):
    assert C.token_counts(documents([]), PATH).collect() == []


def test_forgotten_pieces(library, monkeypatch):
    monkeypatch.setattr(C, "REMEMBERED", 3)
    own = C.Counting(C.counting(PATH).ranks, C.counting(PATH).added)
    text = "one two three four five six seven one two three " * 5
    assert own.text(text) == library(text) and len(own.known) <= 3


@settings(max_examples=300, deadline=None)
@given(st.lists(st.sampled_from(["a", "b", " ", "\n", "<|endoftext|>", "é", "漢字", "1", "'s", "'S", "　", "​", " the", "😀", "zz", "\t", "_"])))
def test_any_text(parts):
    assert C.counting(PATH).text("".join(parts)) == library_count("".join(parts))


def test_all_characters():
    """The library and the pattern here take characters of all scripts for the same kind."""
    count = C.counting(PATH)
    for low in [*range(0, 0x3400, 256), *range(0xA000, 0xAC00, 256), *range(0xE000, 0x20000, 512)]:
        chars = [chr(c) for c in range(low, low + 256) if not 0xD800 <= c < 0xE000]
        text = " ".join(f"a{c}1{c}!" for c in chars)
        assert count.text(text) == library_count(text), hex(low)


def test_merges_against_plain_loop():
    r = random.Random(5)
    for _ in range(300):
        ranks = {r.randrange(3 if i < 2 else 256, 4 if i < 2 else 257 + i) << 32 | r.randrange(5): i for i in range(6)}
        ranks |= {r.randrange(5) << 32 | r.randrange(5): 100 + i for i in range(8)}
        word = bytes(r.randrange(5) for _ in range(r.randrange(30)))
        at = list(word)
        while True:
            pairs = [(ranks[p], i) for i in range(len(at) - 1) if (p := at[i] << 32 | at[i + 1]) in ranks]
            if not pairs:
                break
            rank, i = min(pairs)
            at[i:i + 2] = [256 + rank]
        assert C.merged_count(word, ranks) == len(at)


def test_other_tokenizers_are_refused(tmp_path):
    with open(PATH, encoding="utf-8") as file:
        spec = json.load(file)
    for change in ({"normalizer": {"type": "NFC"}}, {"pre_tokenizer": {"type": "Whitespace"}}):
        path = tmp_path / f"{next(iter(change))}.json"
        path.write_text(json.dumps(spec | change))
        with pytest.raises(ValueError):
            C.counting(str(path))
