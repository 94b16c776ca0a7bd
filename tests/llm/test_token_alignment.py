"""Operator 13 against the tokenizers' own libraries and plain overlap counting."""

import hashlib
import random
from collections import Counter, defaultdict

import public_tokenizers as P
import pytest
import sentencepiece
from tokenizers import Tokenizer

from riskflow.llm import token_alignment as T

A_PATH, B_PATH = P.path("byte_bpe_50k.json"), P.path("piece_bpe_32k.model")


@pytest.fixture(scope="module")
def libraries():
    a = Tokenizer.from_file(A_PATH)
    a.encode_special_tokens = True
    b = sentencepiece.SentencePieceProcessor(model_file=B_PATH)
    letters = T.byte_letters()
    names = {i: p for p, i in a.get_vocab().items()}

    def a_bytes(i):
        return names[i].encode() if i == 50256 else bytes(letters[c] for c in names[i])

    def b_bytes(i):
        p = b.id_to_piece(i)
        return bytes([int(p[3:5], 16)]) if b.is_byte(i) else p.replace("▁", " ").encode()

    return (lambda t: a.encode(t, add_special_tokens=False).ids), a_bytes, b.encode, b_bytes


def spans(ids, to_bytes):
    out, at = [], 0
    for i in ids:
        out.append((at, at + len(to_bytes(i)), i))
        at = out[-1][1]
    return out


def brute(texts, libraries):
    """Rows (n_a, n_b, n_groups, n_links, n_best, count_sum, groups) by the definition."""
    encode_a, a_bytes, encode_b, b_bytes = libraries
    found, held = [], Counter()
    for text in texts:
        a = b = []
        if text:
            a, b = encode_a(" " + text), encode_b(text)
            whole = (" " + text).encode()
            if b"".join(map(a_bytes, a)) != whole or b"".join(map(b_bytes, b)) != whole:
                a = b = []
        sa, sb = spans(a, a_bytes), spans(b, b_bytes)
        links = [(i, j) for s, e, i in sa for u, v, j in sb if s < v and u < e] if len(sa) < 3000 else None
        if links is None:                                       # a long text: the same by a merge
            links, k = [], 0
            for s, e, i in sa:
                while k and sb[k][0] > s:
                    k -= 1
                while sb[k][1] <= s:
                    k += 1
                m = k
                while m < len(sb) and sb[m][0] < e:
                    links.append((i, sb[m][2]))
                    m += 1
        held.update(set(links))
        common = sorted({e for _, e, _ in sa} & {e for _, e, _ in sb})
        low, groups = 0, []
        for c in common:
            groups.append(",".join(str(i) for s, e, i in sa if low <= s and e <= c) + "|" + ",".join(str(i) for s, e, i in sb if low <= s and e <= c) if len(sa) < 3000 else "")
            low = c
        found.append((len(a), len(b), len(groups), links, ";".join(groups)))
    top = defaultdict(int)
    for (i, _), n in held.items():
        top[i] = max(top[i], n)
    return [(na, nb, ng, len(links), sum(held[x] == top[x[0]] for x in links), sum(held[x] for x in links), g) for na, nb, ng, links, g in found]


def sample(vocabulary, odd_texts):
    rng = random.Random(8)
    out = [*odd_texts, "▁", "a▁b", "<|endoftext|>", "<s> </s> <unk> <0x41>", "aaaaaaaaaaaa aaaa aaa", "  two  spaces \t tab\r\nline", "日本語テキスト 😀 ẞ", "\x00null\x01", " leading", "don't we'll I'M"]
    for _ in range(120):
        out.append("".join(rng.choice(vocabulary) + rng.choice([" ", " ", "", ", ", ". ", "\n", "  ", "1234"]) for _ in range(rng.randint(1, 80))))
    return out


@pytest.mark.parametrize("most", [0, T.BROADCAST_PAIRS])
def test_against_definition(frame, vocabulary, odd_texts, libraries, most):
    docs = list(enumerate(sample(vocabulary, odd_texts)))
    got = {r["doc_id"]: list(r)[1:] for r in T.align_corpus(frame(docs), A_PATH, B_PATH, broadcast_pairs=most).collect()}
    for (i, text), want in zip(docs, brute([t for _, t in docs], libraries), strict=True):
        if want[0] < 3000:
            assert tuple(got[i]) == want, (i, text)
        else:
            assert tuple(got[i][:6]) == want[:6], i
            pairs = [g.split("|") for g in got[i][6].split(";")]
            assert sum(len(x.split(",")) for x, _ in pairs) == want[0] and sum(len(y.split(",")) for _, y in pairs) == want[1]


def test_digest_repeats_and_empty(frame):
    rows = [(1, "same text"), (1, "same text"), (None, "same text"), (2, None), (3, "")]
    got = sorted((tuple(r) for r in T.align_corpus(frame(rows), A_PATH, B_PATH, digest=True).collect()), key=str)
    plain = [tuple(r) for r in T.align_corpus(frame([(1, "same text")]), A_PATH, B_PATH).collect()][0]
    sha = hashlib.sha256(plain[-1].encode()).hexdigest()
    full = (*plain[1:5], plain[4], 3 * plain[4], sha)
    assert got == sorted([(1, *full), (1, *full), (None, *full), (2, 0, 0, 0, 0, 0, 0, ""), (3, 0, 0, 0, 0, 0, 0, "")], key=str)
    assert T.align_corpus(frame([]), A_PATH, B_PATH).count() == 0


def test_pairs_beyond_the_held_number(frame, vocabulary, monkeypatch):
    docs = [(i, " ".join(vocabulary[i:i + 40])) for i in range(60)]
    want = {tuple(r) for r in T.pair_counts(T.aligned(frame(docs), A_PATH, B_PATH), A_PATH, B_PATH).collect()}
    monkeypatch.setattr(T, "HELD_PAIRS", 7)
    assert {tuple(r) for r in T.pair_counts(T.aligned(frame(docs), A_PATH, B_PATH), A_PATH, B_PATH).collect()} == want
