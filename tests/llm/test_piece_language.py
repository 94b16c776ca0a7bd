"""Operator 5: the forward sum against all segmentations, EM's likelihood, and held-out accuracy."""

import itertools
import zlib

import numpy as np
import public_tokenizers
import pytest

from riskflow.llm import piece_language as L

MODEL = public_tokenizers.path("piece_bpe_32k.model")


def test_forward_sums_all_segmentations():
    pieces = L.Pieces(["▁", "▁a", "a", "b", "ab", "ba", "▁ab", "bab"])
    p = np.random.default_rng(0).random((len(pieces.sizes), 2))
    number = {t: i for i, t in enumerate(["▁", "▁a", "a", "b", "ab", "ba", "▁ab", "bab"])}
    words = ["abab", "b", "axb", "babab"]
    points = np.frombuffer("".join(words).encode("utf-32-le"), np.uint32)
    lengths = np.array([len(w) for w in words])
    for which, letters, n in L.matrices(points, np.cumsum(lengths) - lengths, lengths):
        got = np.exp(pieces.log_probabilities(letters, n, pieces.scaled(p)))
        for k, row in zip(which, got, strict=True):
            text = "▁" + words[k]
            total = np.zeros(2)
            for cuts in itertools.product([0, 1], repeat=len(text) - 1):
                parts, at = [], 0
                for i, c in enumerate([*cuts, 1], 1):
                    if c:
                        parts.append(text[at:i])
                        at = i
                rows = [number.get(x, len(number) if x == "x" else None) for x in parts]
                if None not in rows:
                    total += np.prod(p[rows], axis=0)
            assert np.allclose(row, total)


def test_long_words_are_summed_whole(monkeypatch):
    """Blocks of any size, a 10,000-letter word against a plain sum, and expected counts that agree with the short words' way."""
    texts = ["▁", "▁a", "a", "b", "ab", "ba", "▁ab", "bab", "abab"]
    pieces = L.Pieces(texts)
    number = {t: i for i, t in enumerate(texts)}
    rng = np.random.default_rng(4)
    p = rng.random((len(pieces.sizes), 3)) / 3
    logs = pieces.unscaled_logs(pieces.scaled(p))
    assert np.allclose(logs, np.log(p))
    for size, block in ((7, 3), (90, 4), (90, 1000), (10_000, 64), (10_000, 1 << 14)):
        monkeypatch.setattr(L, "BLOCK_LETTERS", block)
        word = "▁" + "".join(rng.choice(list("abx"), size, p=[0.45, 0.45, 0.1]))
        plain = np.full((len(word) + 1, 3), -np.inf)
        plain[0] = 0
        for i in range(len(word)):
            here = [(j, number[word[i:j]]) for j in range(i + 1, min(i + 5, len(word)) + 1) if word[i:j] in number]
            for j, k in here + ([] if any(j == i + 1 for j, _ in here) else [(i + 1, len(number))]):
                plain[j] = np.logaddexp(plain[j], plain[i] + np.log(p[k]))
        letters = np.array(list(map(ord, word)))
        assert np.allclose(pieces.long_forward(letters, logs), plain[-1])
        if size < 100:
            weight = rng.random(3)
            total = np.zeros_like(p)
            pieces.add_long_counts(letters, logs, weight, total)
            want = pieces.expected_counts(letters[None, :], np.array([len(letters)]), pieces.scaled(p), weight[None, :])
            assert np.allclose(total, want)


def test_long_runs_are_one_word(spark, frame, monkeypatch):
    words = {"aa": "lomitrasenpol", "bb": "gurvekdoshbrim"}
    docs = [(i, words[lang] * (1 + i % 40), lang) for i, lang in enumerate(["aa", "bb"] * 60)] + [(900, "lomi" * 30_000, None)]
    data = np.frombuffer(("x" * 500 + " y").encode(), np.uint8)
    assert L.letter_words(data, np.array([0, len(data)]))[2].tolist() == [500, 1]
    want = sorted(map(str, L.identify(frame(docs), MODEL).collect()))
    assert sum("lang_pred='aa'" in r for r in want) == 61
    monkeypatch.setattr(L, "MAX_LETTERS", 200)          # which words are long does not matter
    got = L.identify(frame(docs[:-1]), MODEL).collect()
    assert [r["lang_pred"] for r in sorted(got)] == [lang for _, _, lang in docs[:-1]]


def sample(n):
    words = {"aa": "lo mi tra sen pol".split(), "bb": "gur vek dosh brim yat".split()}
    rng = np.random.default_rng(7)
    return [(i, " ".join(rng.choice(words[lang], 12)).upper() if i % 5 == 0 else " ".join(rng.choice(words[lang], 12)), lang)
            for i, lang in enumerate(["aa", "bb"] * (n // 2))]


def test_held_out_accuracy_and_odd_rows(spark, frame, odd_texts):
    docs = sample(240) + [(1000 + i, t, "aa" if i == 3 else None) for i, t in enumerate(odd_texts)] + [(2000, "1 2 3", "bb"), (None, "lo mi", "aa")]
    got = L.identify(frame(docs), MODEL).collect()
    assert len(got) == len(docs)
    by_id = {r["doc_id"]: r for r in got}
    for i, text, lang in docs:
        if i is not None:
            assert by_id[i]["held_out"] == (zlib.crc32(str(i).encode()) % 4 == 2)
        letters = any(c.isalpha() for c in text or "")
        assert (by_id[i]["lang_pred"] != "und") == letters and 0 <= by_id[i]["score"] <= 1
    held = [by_id[i]["lang_pred"] == lang for i, _, lang in docs[:240] if by_id[i]["held_out"]]
    assert len(held) > 40 and all(held)


def test_no_labels_and_empty_table(spark, frame):
    assert [r["lang_pred"] for r in L.identify(frame([(1, "lo mi", None)]), MODEL).collect()] == ["und"]
    assert L.identify(frame([]), MODEL).count() == 0


def test_expectation_maximisation_raises_the_likelihood():
    pieces = L.Pieces.load(MODEL)
    words = ["lomi", "trasen", "polomi", "gurvek"]
    points = np.frombuffer("".join(words).encode("utf-32-le"), np.uint32)
    lengths = np.array([len(w) for w in words])
    which, letters, n = next(L.matrices(points, np.cumsum(lengths) - lengths, lengths))
    p, last = np.full((len(pieces.sizes), 1), 1 / len(pieces.sizes)), -np.inf
    for _ in range(4):
        now = pieces.log_probabilities(letters, n, pieces.scaled(p)).sum()
        assert now >= last - 1e-9
        last = now
        counts = pieces.expected_counts(letters, n, pieces.scaled(p), np.ones((len(words), 1)))
        p = counts / counts.sum()
    assert last == pytest.approx(last)
