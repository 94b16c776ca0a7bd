"""Operator 8 against Python's re, and the automata against their rules."""

import hashlib
import random
import re
import time

import numpy as np
import pyarrow as pa
import pytest

from riskflow.llm import secret_automaton as S
from riskflow.llm.textarrays import text_groups

ASSIGN = re.compile(r"""((?i:password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.A)
PARTS = ["token", "TOKEN", "ſecret", "secret", "password", "passwd", "api_key", "ApiKey", "=", ":", "'", '"', " ", "  ", "abc", "abcdef", "AKIA", "AKIA" + "A" * 16,
         "0123456789abcdef" * 2, "f" * 23, "f" * 24, "\n", "é", "==", "-", "K", "ghp_" + "a" * 36, "-----BEGIN RSA PRIVATE KEY-----"]


def brute(text):
    out = [(m.start(), 0, m.end()) for m in ASSIGN.finditer(text) if len(m.group(2)) >= 6]
    out += [(m.start(), 1, m.end()) for m in re.finditer("AKIA[A-Z0-9]+", text) if len(m.group()) >= 20]
    return sorted(out + [(m.start(), 2, m.end()) for m in re.finditer("[0-9a-f]+", text) if len(m.group()) >= 24])


def fuzz(n):
    rng = random.Random(10)
    return ["".join(rng.choice(PARTS) for _ in range(rng.randint(0, 14))) for _ in range(n)]


def test_scanner_matches_re():
    scan = S.scanner(S.RULES)
    texts = fuzz(8000) + ["a" * 5000 + " token=" + "b" * 5000, "", None, "f" * 100_000]
    for lo, hi, data, offsets in text_groups(pa.array(texts, pa.string()), 50_000):
        found = scan.spans(data, offsets)
        for i in range(lo, hi):
            assert [s for s in found.get(i - lo, []) if s[1] < 3] == brute(texts[i] or ""), texts[i]


def test_one_pass_marks_what_single_rules_end():
    rules = [S.seq(S.word("ab"), S.plus(S.chars("a-c"))), S.word("bca"), S.seq(S.chars("b"), S.opt(S.chars("x")), S.word("c"))]
    machine = S.compile_rules(rules, True)
    rng = np.random.default_rng(0)
    for _ in range(50):
        data = rng.choice(np.frombuffer(b"abcx\n", np.uint8), 3000)
        marks = machine.accept[S.trace(machine, data)]
        text = data.tobytes()
        assert [i for i in range(len(text)) if marks[i] & 2] == [m.start() + 2 for m in re.finditer(b"(?=bca)", text)]
        assert [i for i in range(len(text)) if marks[i] & 4] == sorted(m.start() + len(m.group(1)) - 1 for m in re.finditer(b"(?=(bx?c))", text))
        assert bool((marks & 1).any()) == bool(re.search(b"ab[a-c]", text))


def test_added_kinds_and_odd_rows(spark, frame, odd_texts):
    docs = [(i, t) for i, t in enumerate(odd_texts)] + [(100, "é -----BEGIN EC PRIVATE KEY----- x"), (101, "ghp_" + "Z9" * 20), (None, "token=abcdef")]
    out = S.digests(S.secret_spans(frame(docs)), S.BASE_KINDS).collect()
    assert len(out) == len(docs)
    by_id = {r["doc_id"]: r for r in out}
    assert by_id[100]["spans"] == "key_block:2:32" and by_id[101]["spans"] == "code_host:0:44"
    assert by_id[None]["spans"] == "assign:0:12" and by_id[None]["n_assign"] == 1
    assert by_id[0]["spans"] == "" and by_id[0]["base_sha256"] == hashlib.sha256(b"").hexdigest()
    assert S.secret_spans(frame([])).count() == 0


def test_query_digest(spark, frame):
    docs = list(enumerate(fuzz(400)))
    for r in S.digests(S.secret_spans(frame(docs)), S.BASE_KINDS).collect():
        spans = brute(docs[r["doc_id"]][1])
        joined = ",".join(f"{S.BASE_KINDS[k]}:{a}:{b}" for a, k, b in spans)
        assert r["base_sha256"] == hashlib.sha256(joined.encode()).hexdigest()
        assert [r[f"n_{k}"] for k in S.BASE_KINDS] == [sum(x == k for _, x, _ in spans) for k in range(3)]


def one_text(scan, text):
    data = np.frombuffer(text.encode(), np.uint8)
    return scan.spans(data, np.array([0, len(data)])).get(0, [])


def test_regexes_are_compiled_from_their_text():
    rng = random.Random(3)
    for pattern in (r"a(?:b|cd)*e", r"[a-c]{2}d{3,}", r"(?i:ab|c)[x-]\x20?e", r"a+\.b|[\]b]c", r"(a|b{0,}c)d"):
        scan = S.Scanner((S.Rule("one", pattern, S.at_least(1)),))
        for _ in range(80):
            text = "".join(rng.choice("abcdeABCx-. ]\n") for _ in range(40)) + rng.choice(["abcdcde", "aaddd", "Abx e", "bcd"])
            assert one_text(scan, text) == [(m.start(), 0, m.end()) for m in re.finditer(pattern, text)]
    for wrong in ("a.b", "(ab", "ab)", "[^a]", r"\d", "é", "a*"):
        with pytest.raises(ValueError):
            S.Scanner((S.Rule("one", wrong, S.at_least(1)),))


def test_long_lines_are_read_once():
    scan = S.scanner(S.RULES)
    begin = time.monotonic()
    assert one_text(scan, "eyJ" * 400_000 + " eyJa.b." + "_" * 40)[0] == (1_200_001, 8, 1_200_048)
    assert one_text(scan, "-----BEGIN " * 100_000 + "PRIVATE KEY-----") == [(1_099_989, 3, 1_100_016)]
    assert one_text(scan, ("f" * 23 + " ") * 40_000 + "f" * 24) == [(960_000, 2, 960_024)]
    assert one_text(scan, "token=" * 200_000) == [(0, 0, 1_200_000)]
    tail = S.Scanner((S.Rule("tail", "a([ab]*c)?", S.at_least(1)),))      # every match reads to the end of the line in vain
    assert len(one_text(tail, "ab" * 100_000)) == 100_000
    assert time.monotonic() - begin < 30
