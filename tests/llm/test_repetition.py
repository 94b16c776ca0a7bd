"""Operator 3 against direct counting."""

import random
import re
from collections import Counter

from riskflow.llm import repetition as R


def brute(text):
    words = re.findall(r"[^\x20\x09-\x0D]+", text)

    def marked(n):
        grams = Counter(tuple(words[i:i + n]) for i in range(len(words) - n + 1))
        return {j for i in range(len(words) - n + 1) if grams[tuple(words[i:i + n])] > 1 for j in range(i, i + n)}

    total = max(1, sum(map(len, words)))
    seen, lines, chars = set(), 0, 0
    for line in text.split("\n"):
        inside = re.findall(r"[^\x20\x09-\x0D]+", line)
        if inside and line in seen:
            lines += 1
            chars += sum(map(len, inside))
        seen.add(line)
    covers = [sum(len(words[j]) for j in marked(n)) / total for n in R.NGRAM_LIMITS] + [chars / total]
    repeated = len(marked(3))
    failed = len(words) < 50 or 100 * repeated > 50 * len(words)
    kept = not failed and all(c <= m for c, m in zip(covers, [*R.NGRAM_LIMITS.values(), R.LINE_LIMIT], strict=True))
    return [len(words), sum(map(len, words)), len(re.findall(r"[#*$%&|<>]", text)), lines, repeated, failed, kept, *covers]


def texts(vocabulary):
    rng = random.Random(3)
    out = []
    for k in range(150):
        phrase = [rng.choice(vocabulary) for _ in range(rng.randint(1, 14))]
        words = [w for _ in range(rng.randint(0, 30)) for w in (phrase if rng.random() < k / 150 else [rng.choice(vocabulary) for _ in range(5)])]
        out.append("".join(w + rng.choice([" ", " ", " ", "\n", "\t", "\u00a0", " # ", "\r\n"]) for w in words))
    return out


def test_against_counting(spark, frame, vocabulary, odd_texts):
    docs = list(enumerate(texts(vocabulary) + odd_texts))
    got = {r["doc_id"]: list(r)[1:] for r in R.quality_rules(frame(docs)).collect()}
    for i, text in docs:
        want = brute(text or "")
        assert got[i][:7] == want[:7], i
        assert all(abs(a - b) < 1e-12 for a, b in zip(got[i][7:], want[7:], strict=True)), i


def test_filter_keeps_all_columns(spark, frame, vocabulary):
    docs = list(enumerate(texts(vocabulary))) + [(None, " ".join(vocabulary[:80])), (None, "short")]
    df = frame(docs)
    kept = R.kept_documents(df)
    assert kept.schema == df.schema
    assert sorted(str(r["doc_id"]) for r in kept.collect()) == sorted(str(r["doc_id"]) for r in R.quality_rules(df).where("kept").collect())
    assert R.quality_rules(frame([])).count() == 0 and R.kept_documents(frame([])).count() == 0
