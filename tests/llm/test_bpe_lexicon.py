"""Operator 6 against the tokenizers library."""

import hashlib
import random

import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest
from tokenizers import Tokenizer

from riskflow.llm import bpe_lexicon as B
from riskflow.llm.textarrays import IntTable, text_groups

PATH = public_tokenizers.path("byte_bpe_50k.json")
PARTS = ["t", "the", " the", "'s", "'re", "'ll", "'", "x", "re", " ", "  ", "\n", "\t", "1", "²", "é", "中", ",", "!", " ", "\u0085", "😀", "<|endoftext|>", "<|endoftext", "aaaa", "don't"]


@pytest.fixture(scope="module")
def library():
    return Tokenizer.from_file(PATH)


def fuzz(n):
    rng = random.Random(8)
    return ["".join(rng.choice(PARTS) for _ in range(rng.randint(0, 25))) for _ in range(n)]


def test_worker_codec_matches_library(library, tmp_path):
    vocab = B.load_vocabulary(PATH)
    B.Lexicon.save([b"the", b" the", b"'s", b" ", b"aaaa", "é".encode(), b"a" * 40], vocab, str(tmp_path))
    for codec in (B.Codec(vocab, B.Lexicon(str(tmp_path))), B.Codec(vocab, None)):
        texts = fuzz(3000) + [None, "", "a" * 3000, " " * 500]
        for lo, hi, data, offsets in text_groups(pa.array(texts, pa.string()), 4096):
            ids, first = codec.encode(data, offsets)
            for i in range(lo, hi):
                assert ids[first[i - lo]:first[i - lo + 1]].tolist() == library.encode(texts[i] or "", add_special_tokens=False).ids, texts[i]
            assert codec.decode(ids) == data.tobytes()


def test_automaton_is_minimal_and_numbers_words():
    words = sorted({b"tap", b"taps", b"top", b"tops", b"stop", b"stops", b""})
    keys, targets, outputs, final, start = B.minimal_automaton(words)
    step = {k: (t, o) for k, t, o in zip(keys.tolist(), targets.tolist(), outputs.tolist(), strict=True)}
    for number, word in enumerate(words):
        state, total = start, 0
        for byte in word:
            state, out = step[state * 256 + byte]
            total += out
        assert final[state] and total == number
    futures = {}
    for w in words:
        for i in range(len(w) + 1):
            futures.setdefault(w[:i], frozenset(x[i:] for x in words if x.startswith(w[:i])))
    assert len(final) == len(set(futures.values()))


def test_int_table():
    rng = np.random.default_rng(0)
    keys = np.unique(rng.integers(0, 1 << 40, 5000))
    table = IntTable.build(keys, np.arange(len(keys)))
    assert (table.get(keys) == np.arange(len(keys))).all()
    assert (table.get(np.setdiff1d(rng.integers(0, 1 << 40, 5000), keys)) == -1).all()


def test_query_columns(spark, frame, library, odd_texts, vocabulary):
    docs = list(enumerate(fuzz(300) + odd_texts + [" ".join(vocabulary)])) + [(None, "x")]
    out = B.digests(B.encode_documents(frame(docs), PATH, lexicon_words=50)).collect()
    assert len(out) == len(docs)
    text = dict(docs)
    for r in out:
        ids = library.encode(text[r["doc_id"]] or "", add_special_tokens=False).ids
        want = (len(ids), hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest(), hashlib.sha256(library.decode(ids, skip_special_tokens=False).encode()).hexdigest())
        assert tuple(r)[1:] == want, r["doc_id"]
    assert B.encode_documents(frame([]), PATH).count() == 0


def test_lexicon_takes_the_most_frequent(spark, frame):
    docs = [(i, "one two two three three three three") for i in range(40)]
    assert set(B.frequent_words(frame(docs), PATH, limit=2)) == {b" three", b" two"}
    assert set(B.frequent_words(frame(docs), PATH, limit=10)) == {b"one", b" two", b" three"}
