"""Operator 12 against direct counting."""

import random
import re
from collections import Counter, defaultdict

import numpy as np
import pytest

from riskflow.llm import collocations as C

UPPER = str.maketrans({chr(c): chr(c + 32) for c in range(65, 91)})


def brute(docs, top=2000, least=10):
    f, n = defaultdict(Counter), Counter()
    for lang, text in docs:
        lang = "und" if lang is None else lang
        for piece in re.split(r"[.,;:!?\x0A-\x0D]", (text or "").translate(UPPER)):
            words = re.findall(r"[^\x20\x09]+", piece)
            n[lang] += len(words)
            for size in (1, 2, 3):
                f[lang].update(tuple(words[i:i + size]) for i in range(len(words) - size + 1))
    out = []
    for lang, counts in f.items():
        frequent = {p: a for p, a in counts.items() if len(p) > 1 and a >= least}
        rows = []
        for p, a in frequent.items():
            if any(len(q) > len(p) and 100 * b >= 50 * a and any(q[i:i + len(p)] == p for i in range(len(q))) for q, b in frequent.items()):
                continue
            score, k = min((1000000 * a * a // (counts[p[:k]] * counts[p[k:]]), k) for k in range(1, len(p)))
            rows.append((-score, -a, " ".join(p).encode(), counts[p[:k]], counts[p[k:]]))
        for i, (score, a, phrase, l, r) in enumerate(sorted(rows)[:top]):
            out.append((lang, i + 1, phrase.decode(), -a, l, r, n[lang], -score))
    return sorted(out)


def texts(vocabulary, count=260):
    rng = random.Random(4)
    common = [rng.choice(vocabulary) for _ in range(25)]
    phrases = [[rng.choice(common + vocabulary[:40]) for _ in range(rng.randint(2, 5))] for _ in range(30)]
    out = []
    for i in range(count):
        words = [w for _ in range(rng.randint(0, 40)) for w in (rng.choice(phrases) if rng.random() < 0.5 else [rng.choice(common)])]
        text = "".join((w.upper() if rng.random() < 0.1 else w) + rng.choice([" ", " ", " ", "  ", "\t", ", ", ".", "\n", "\x0b", " ", "\x1f"]) for w in words)
        out.append((rng.choice(["en", "en", "en", "fr", None, "und"]), text))
    return out


def frame_of(frame, docs):
    return frame([(i, text, lang) for i, (lang, text) in enumerate(docs)])


@pytest.mark.parametrize("bucket_words", [50, C.BUCKET_WORDS])
def test_against_counting(frame, vocabulary, odd_texts, bucket_words):
    docs = texts(vocabulary) + [("en", t) for t in odd_texts] + [("es", "a b a b " * 6), ("de", "İ ẞ é́ " * 12)]
    got = sorted(tuple(r) for r in C.collocations(frame_of(frame, docs), bucket_words=bucket_words).collect())
    assert got == brute(docs)
    assert len(got) > 60


def test_top_and_ties(frame, vocabulary):
    docs = [("en", ". ".join(f"{a} {b}" for a, b in zip(vocabulary[::2], vocabulary[1::2], strict=True)))] * 11
    got = sorted(tuple(r) for r in C.collocations(frame_of(frame, docs), top=17).collect())
    assert got == brute(docs, top=17) and len(got) == 17


def test_empty(frame):
    assert C.collocations(frame([])).count() == 0
    assert C.collocations(frame([(1, None), (2, ""), (3, "one"), (4, ".,;")])).count() == 0


def test_held_suffixes_and_merging(frame, vocabulary):
    docs = texts(vocabulary, 120)
    suffixes = C.routed_suffixes(frame_of(frame, docs).selectExpr("coalesce(lang, 'und') lang", "text"), 3)
    want = sorted(tuple(r) for r in C.phrase_counts(suffixes).collect())
    assert sorted(tuple(r) for r in C.phrase_counts(suffixes, held=5).collect()) == want


def test_products_beyond_64_bits(spark):
    big = 4_000_000_000_000
    phrases = spark.createDataFrame([("en", "a b", 2, big - 7)], "lang string, phrase string, words int, a long")
    words = spark.createDataFrame([("en", "a", big), ("en", "b", big + 3)], "lang string, phrase string, n long")
    assert C.scored(phrases, words).first()["score"] == 1000000 * (big - 7) ** 2 // (big * (big + 3))


def test_sort_of_random_keys():
    rng = np.random.default_rng(2)
    for n, wide in [(0, 1), (1, 1), (500, 3), (3000, 12), (3000, 400)]:
        keys = rng.integers(0, wide, (3, n))
        keys[2, rng.random(n) < 0.3] = -1
        weight = rng.integers(1, 4, n)
        want = Counter()
        for k in range(n):
            want[tuple(keys[:2, k])] += weight[k]
            if keys[2, k] >= 0:
                want[tuple(keys[:, k])] += weight[k]
        got = {tuple(keys[:words, p]): c for words, at, counts in C.three_way_counts(keys, weight, 5) for p, c in zip(at, counts, strict=True)}
        assert got == {k: v for k, v in want.items() if v >= 5}
