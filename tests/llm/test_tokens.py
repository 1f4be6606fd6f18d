import random

import numpy as np
import pyarrow as pa
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from chartloom.llm import packing, token_files
from chartloom.llm import tokens as T

ALPHABET = list("ab ABZ,.;:!?\n\n\t é́Σς.,1٣<|>\x1c\x85 　中…“”'tİ▁ﬁ") + ["<|endoftext|>", "<|ENDOFTEXT|>", "  ", "\n\n", "'s"]


def fuzz(n=3000):
    r = random.Random(1)
    return ["", "a" * 5000, " ".join(str(i) for i in range(3000)), None, *["".join(r.choice(ALPHABET) for _ in range(r.randint(0, 30))) for _ in range(n)]]


@pytest.mark.parametrize(("name", "cut"), [("byte_bpe_50k.json", "space"), ("word_bpe_49k.json", "blank")])
def test_ids_equal_the_library(name, cut):
    t = T.HFTokenizer(T.vocabulary_path(name), cut, bits=12)  # a small cache: it is emptied and grown on the way
    texts = fuzz()
    want = [e.ids for e in t.tokenizer.encode_batch([x or "" for x in texts], add_special_tokens=False)]
    assert [x.tolist() for x in t.ids(pa.array(texts, pa.string()))] == want


def test_counts_equal_the_library():
    p = T.PieceCounter(T.vocabulary_path("piece_bpe_32k.model"), bits=12)
    texts = fuzz()
    assert p.counts(pa.array(texts, pa.string())).tolist() == [len(x) for x in p.model.encode([x or "" for x in texts])]


def test_chunks_that_share_a_hash_stay_apart(monkeypatch):
    whole = T.run_hashes
    monkeypatch.setattr(T, "run_hashes", lambda *a: whole(*a) & np.uint64(0xFF00000000000000) | np.uint64(1))
    texts = fuzz(600)
    t = T.HFTokenizer(T.vocabulary_path("byte_bpe_50k.json"), "space", bits=12)
    assert [x.tolist() for x in t.ids(pa.array(texts, pa.string()))] == [e.ids for e in t.tokenizer.encode_batch([x or "" for x in texts], add_special_tokens=False)]
    p = T.PieceCounter(T.vocabulary_path("piece_bpe_32k.model"), bits=12)
    assert p.counts(pa.array(texts, pa.string())).tolist() == [len(x) for x in p.model.encode([x or "" for x in texts])]


@given(st.lists(st.integers(0, 2**32 - 1), max_size=1200), st.integers(0, 5))
@settings(max_examples=40, deadline=None)
def test_token_file_round_trip(ids, cuts):
    ids = np.array(ids, np.uint32)
    ends = np.sort(np.r_[np.random.default_rng(cuts).integers(0, len(ids) + 1, cuts), len(ids)])
    f = token_files.TokenFile(token_files.encode(np.arange(len(ends)), ends, ids))
    assert f.all().tolist() == ids.tolist()
    for i in range(0, len(ids), 7):
        assert f[i] == ids[i]
    for k in range(len(ends)):
        assert f.document(k).tolist() == ids[(ends[k - 1] if k else 0) : ends[k]].tolist()


@given(st.dictionaries(st.integers(1, 64), st.integers(1, 40), max_size=30))
@settings(max_examples=100, deadline=None)
def test_packing_plan(histogram):
    made = packing.plan(histogram, 64)
    used: dict[int, list] = {}
    for length, n in histogram.items():
        seq, off = made.place(np.full(n, length, np.int64), np.arange(n, dtype=np.int64))
        for s, o in zip(seq.tolist(), off.tolist()):
            used.setdefault(s, []).append((o, length))
    for places in used.values():
        at = 0
        for o, length in sorted(places):
            assert o == at
            at += length
        assert at <= 64
        assert sum(length > 64 // 3 for _, length in places) <= 2
    total = sum(k * n for k, n in histogram.items())
    large = sum(n for k, n in histogram.items() if k > 32)
    assert len(used) == made.n_sequences <= max(large, -(-total // 64)) * 1.4 + 2
