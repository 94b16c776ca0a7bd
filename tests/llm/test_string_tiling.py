"""Operator 7 against a plain greedy string tiling."""

import decimal
import random
import re
import time

import numpy as np

from riskflow.llm import string_tiling as S


def plain_tiles(a, b, least):
    """Greedy string tiling by the book: all longest matches of unmarked tokens, again and again."""
    free_a, free_b, covered = [True] * len(a), [True] * len(b), 0
    while True:
        best, found = least - 1, []
        for i in range(len(a)):
            for j in range(len(b)):
                k = 0
                while i + k < len(a) and j + k < len(b) and a[i + k] == b[j + k] and free_a[i + k] and free_b[j + k]:
                    k += 1
                if k > best:
                    best, found = k, [(i, j)]
                elif k == best and k >= least:
                    found.append((i, j))
        if not found:
            return covered
        for i, j in found:
            if all(free_a[i:i + best]) and all(free_b[j:j + best]):
                free_a[i:i + best], free_b[j:j + best] = [False] * best, [False] * best
                covered += best


def words(text):
    return re.findall(r"[0-9a-zé]+", (text or "").lower())


def corpus(vocabulary):
    rng = random.Random(9)
    items = [(i, " ".join(rng.choice(vocabulary) for _ in range(rng.randint(3, 30)))) for i in range(12)] + [(50, None), (51, ""), (52, "a b a b a b a b")]
    docs = []
    for i in range(60):
        parts = [" ".join(rng.choice(vocabulary) for _ in range(rng.randint(0, 20)))]
        for _ in range(rng.randint(0, 2)):
            w = (rng.choice(items)[1] or "").split()
            cut = rng.randint(0, len(w))
            moved = w[cut:] + (["new"] if rng.random() < 0.3 else []) + w[:cut]
            parts += [", ".join(x.upper() for x in moved), " ".join(rng.choice(vocabulary) for _ in range(9))]
        docs.append((i, "\n".join(parts)))
    return docs + [(90, "a b a b a b a b a b a b c a b a b")], items


def test_against_plain_tiling(spark, frame, vocabulary, odd_texts):
    docs, items = corpus(vocabulary)
    docs += [(200 + i, t) for i, t in enumerate(odd_texts)]
    bench = spark.createDataFrame([(i, t, "clash") for i, t in items], "item_id long, text string, doc_id string")
    want = {}
    for d, text in docs:
        if len(text or "") > 50_000:
            continue
        for i, item in items:
            covered = plain_tiles(words(item), words(text), min(5, len(words(item)) or 5))
            if covered:
                want[d, i] = covered
    for block_bytes in (1 << 20, 200):                         # one block, and many
        got = {(r["doc_id"], r["item_id"]): r for r in S.shared_passages(frame(docs), bench, block_bytes=block_bytes).collect()}
        assert {k: r["tiled_tokens"] for k, r in got.items()} == want
    text = dict(docs)
    for (d, i), r in got.items():
        pieces = [text[d][s["start"]:s["end"]] for s in r["spans"]]
        assert sum(len(words(p)) for p in pieces) == r["tiled_tokens"] and len(pieces) == r["tiles"]


def test_reordered_passage_is_a_leak_and_clean_rows_stay(spark, frame, vocabulary):
    item = " ".join(vocabulary[:40])
    w = item.split()
    docs = [(1, "start " + " ".join(w[20:] + ["between"] + w[:20])), (2, " ".join(w[:20])), (3, "clean"), (None, item), (4, None), (4, item)]
    bench = spark.createDataFrame([(7, item), (7, item)], "item_id long, text string")
    assert sorted(str(r["doc_id"]) for r in S.leaks(frame(docs), bench).collect()) == ["1", "1", "4", "4", "None", "None"]
    clean = S.without_leaks(frame(docs), bench)
    assert sorted((r["doc_id"], r["text"]) for r in clean.collect() if r["text"]) == [(2, docs[1][1]), (3, "clean")]
    assert clean.count() == 3 and clean.schema == frame(docs).schema


def test_empty_tables(spark, frame):
    bench = spark.createDataFrame([], "item_id long, text string")
    assert S.leaks(frame([(1, "a b c d e f")]), bench).count() == 0
    assert S.without_leaks(frame([(1, "a b c d e f")]), bench).count() == 1
    assert S.leaks(frame([]), spark.createDataFrame([(1, "a b c d e")], "item_id long, text string")).count() == 0


def test_bounds_lose_no_leak(vocabulary):
    rng = random.Random(21)
    few = vocabulary[:9]                                       # many windows are shared by many items
    items = [(i, " ".join(rng.choice(few) for _ in range(rng.randint(1, 25)))) for i in range(60)]
    texts = []
    for _ in range(40):
        w = rng.choice(items)[1].split()
        cut = rng.randint(0, len(w))
        texts.append(" ".join([*w[cut:], *(rng.choice(few) for _ in range(rng.randint(0, 12))), *w[:cut]]))
    for coverage in (0.0, 0.5, 0.8, 1.0):
        block = S.Block(items, 5, coverage)
        for text in texts:
            data = np.frombuffer(text.encode(), np.uint8)
            got = {i: tiled for _, i, _, tiled, _ in block.leaks(data, np.array([0, len(data)]))}
            want = {i: plain_tiles(words(item), words(text), min(5, len(words(item)))) for i, item in items}
            assert got == {i: n for i, n in want.items() if n and n >= coverage * len(words(items[i][1]))}


def test_phrase_of_all_items_costs_no_tiling(vocabulary):
    rng = random.Random(4)
    phrase = "choose the best answer below"
    items = [(i, " ".join([phrase, *(f"{rng.choice(vocabulary)}{rng.randrange(10**9)}" for _ in range(30))])) for i in range(2000)]
    block = S.Block(items, 5, 0.8)
    text = f"{phrase} and then {phrase}. " * 20
    data = np.frombuffer((text + items[7][1]).encode(), np.uint8)
    begin = time.monotonic()
    found = block.leaks(data, np.array([0, len(text), len(data)]))
    assert time.monotonic() - begin < 0.5
    assert [(t, i, n, m) for t, i, n, m, _ in found] == [(1, 7, 35, 35)]


def test_short_items_any_ids_and_one_stage(spark, frame):
    docs = frame([(1, "So: Forty-Two!"), (2, "forty"), (3, "two forty"), (4, None)])
    bench = spark.createDataFrame([(decimal.Decimal("1.50"), "forty two"), (None, "forty two")], "item_id decimal(9,2), text string")
    got = S.leaks(docs, bench, block_bytes=8)                  # a block for each item or so
    assert sorted((r["doc_id"], str(r["item_id"]), r["coverage"], r["spans"][0]["start"]) for r in got.collect()) == [(1, "1.50", 1.0, 4), (1, "None", 1.0, 4)]
    clean = S.without_leaks(docs, bench, block_bytes=8)
    assert sorted(r["doc_id"] for r in clean.collect()) == [2, 3, 4]
    for frame_ in (got, clean):
        assert frame_._jdf.queryExecution().optimizedPlan().toString().count("MapInArrow") == 1
