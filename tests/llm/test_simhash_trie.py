"""Operator 9 against all pairs of fingerprints."""

import random
import re

import numpy as np
import pytest
import xxhash

from riskflow.llm import components, simhash_trie as S


def fingerprint(text, words=3):
    w = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m.group().lower(), text or ""))
    grams = [" ".join(w[i:i + words]) for i in range(len(w) - words + 1)] if len(w) >= words else [" ".join(w)] if w else []
    hashes = [xxhash.xxh64_intdigest(g.encode(), 42) for g in grams]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def classes(prints, bits):
    """Smallest id of each id's component, over all pairs."""
    ids = sorted(prints)
    label = {i: i for i in ids}
    changed = True
    while changed:
        changed = False
        for i in ids:
            for j in ids:
                if (prints[i] ^ prints[j]).bit_count() <= bits and label[j] < label[i]:
                    label[i], changed = label[j], True
    return label


def test_against_all_pairs(spark, frame, vocabulary, odd_texts):
    rng = random.Random(11)
    base = [[rng.choice(vocabulary) for _ in range(rng.randint(0, 120))] for _ in range(25)]
    docs = []
    for i in range(150):
        w = list(rng.choice(base))
        for _ in range(rng.randint(0, 2)):
            if w:
                w[rng.randrange(len(w))] = rng.choice(vocabulary).upper()
        docs.append((i + 10, " ".join(w)))
    docs += [(300 + i, t) for i, t in enumerate(odd_texts)]
    prints = {i: fingerprint(t) for i, t in docs}
    for bits in (0, 2, 5):
        want = classes(prints, bits)
        out = S.near_duplicates(frame(docs), max_bits=bits).select("doc_id", S.hexed().alias("f"), "component_id").collect()
        assert len(out) == len(docs)
        assert {r["doc_id"]: (r["f"], r["component_id"]) for r in out} == {i: (f"{prints[i]:016x}", want[i]) for i in prints}


@pytest.mark.parametrize("slice_pairs", [S.WALK_PAIRS, 3])
def test_walk_finds_every_pair(monkeypatch, slice_pairs):
    monkeypatch.setattr(S, "WALK_PAIRS", slice_pairs)
    rng = np.random.default_rng(1)
    for depth in (0, 3, 6):
        seeds = rng.integers(0, 1 << 62, 12).astype(np.uint64)
        fps = np.unique(np.array([int(rng.choice(seeds)) ^ sum(1 << int(b) for b in rng.integers(0, 64, rng.integers(0, 5))) for _ in range(500)], np.uint64))
        nodes = sorted({(int(f) >> (64 - depth) if depth else 0, depth) for f in fps})
        want = {(int(a), int(b)) for k, a in enumerate(fps) for b in fps[k + 1:] if int(a ^ b).bit_count() <= 3}
        got = set()
        for i, j, bit, spent in S.node_pairs(nodes, 3):
            left, right = (fps[(fps >> np.uint64(64 - depth) if depth else fps * 0) == nodes[k][0]] for k in (i, j))
            for x, y in S.linked_pairs(left, right, bit, spent, 3, i == j):
                for a, b in zip(x, y, strict=True):
                    pair = tuple(sorted((int(left[a]), int(right[b]))))
                    assert pair not in got
                    got.add(pair)
        assert got == want


def test_walk_of_a_dense_subtree_waits_in_slices():
    rng = np.random.default_rng(5)
    fps = np.unique(rng.integers(0, 1 << 18, 60_000).astype(np.uint64))
    n = sum(len(i) for i, _ in S.linked_pairs(fps, fps, 63, 0, 1, True))
    assert n == sum(int(np.isin(fps ^ np.uint64(1 << b), fps).sum()) for b in range(18)) // 2


def test_nodes_of_two_depths():
    nodes = [(0b0, 1), (0b100, 3), (0b101, 3), (0b11, 2)]
    pairs = {(i, j): (bit, spent) for i, j, bit, spent in S.node_pairs(nodes, 1)}
    assert pairs[0, 1] == (62, 1) and pairs[1, 2] == (60, 1) and pairs[1, 3] == (61, 1) and (0, 0) in pairs
    assert (0, 3) in pairs and pairs[0, 3] == (62, 1)


def test_spanning_forest_is_no_larger_than_the_cluster():
    fps = np.unique(np.array([sum(1 << b for b in pair) for pair in [(i, j) for i in range(40) for j in range(40)]], np.uint64))
    a, b = S.forest_links(np.sort(fps), None, 63, 0, 2)
    assert len(a) == len(fps) - 1


def test_heavy_branches_are_cut_deeper(spark):
    rng = np.random.default_rng(2)
    fps = np.unique(np.concatenate([rng.integers(0, 1 << 62, 300), rng.integers(0, 1 << 20, 3000)]).astype(np.int64))
    df = spark.createDataFrame([(int(f),) for f in fps], "fp long")
    nodes = S.cut_nodes(df, len(fps))
    counts = [sum(int(f) >> (64 - d) == p for f in fps.tolist()) for p, d in nodes]
    assert sum(counts) == len(fps) and max(counts) <= -(-len(fps) // S.NODES)


def test_repeated_ids_null_ids_and_empty(spark, frame):
    docs = [(5, "one two three four"), (5, "one two three four"), (None, "one two three four"), (3, "other words here now"), (None, "alone in its class here")]
    out = sorted(((r["doc_id"], r["component_id"]) for r in S.near_duplicates(frame(docs)).collect()), key=str)
    assert out == sorted([(5, 5), (5, 5), (None, 5), (3, 3), (None, None)], key=str)
    assert S.near_duplicates(frame([])).count() == 0


def test_components_of_chain_and_star(spark):
    links = [(i, i + 1) for i in range(100, 160)] + [(1, x) for x in range(200, 260)] + [(7, 7), (9, 8), (8, 9)]
    out = {r["node"]: r["component"] for r in components.components(spark.createDataFrame(links, "a long, b long"), "a", "b").collect()}
    assert out == {**dict.fromkeys(range(100, 161), 100), **dict.fromkeys([1, *range(200, 260)], 1), 8: 8, 9: 8}
