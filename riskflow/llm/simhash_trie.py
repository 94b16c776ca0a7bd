"""SimHash near-duplicates by a binary trie joined with itself (operator 9).

A text's fingerprint has a bit set where over half of its shingles' XXH64 hashes have it. Distinct fingerprints
form a binary trie. Its upper nodes are cut where a subtree holds about ``1 / NODES`` of the fingerprints (heavy
branches are followed deeper, so clusters of similar texts are cut as finely as the rest). Pairs of these nodes are
walked together with the differing prefix bits added up, and pairs over the budget are dropped. Each remaining
pair of subtrees is one group of a Spark shuffle, where the walk goes on: two sorted arrays are halved bit by bit,
differing bits accumulate, and a pair of nodes is pruned as soon as they exceed the budget. A group returns a
spanning forest of its links, so a dense cluster yields no more links than it has fingerprints. Links become
components by star steps in Spark.

Fingerprints link at ``max_bits`` or fewer differing bits, whatever their texts; equal fingerprints always do.

Defined results: null or empty text: fingerprint zero, linked like any other. Null doc_id: keeps a row and its
component, but is never a component's smallest id unless no other exists. Repeated rows and ties: each row its
own row. Empty table: empty result. Other columns are ignored.
"""

from __future__ import annotations

from collections import defaultdict

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import ready
from .components import components

SHINGLE_WORDS, MAX_BITS, SEED = 3, 2, 42
#: subtrees the trie is cut into, and the most fingerprints of one subtree (which wins once a table is large)
NODES, NODE_ROWS = 64, 1 << 20
#: bits by which heavy subtrees are split at a time
STEP_BITS = 4
#: node pairs with at most so many fingerprint pairs are compared directly
LEAF_PAIRS = 16
#: node pairs that the walk takes down at a time; what a level has beyond them waits
WALK_PAIRS = 1 << 14


# ------------------------------------------------------------------ fingerprints

def shingle_hashes(text: bytes, words: int) -> np.ndarray:
    """XXH64 of all shingles of a text, A-Z lower-cased."""
    w = text.lower().split()
    if not w:
        return np.zeros(0, np.uint64)
    if len(w) <= words:
        return np.array([xxhash.xxh64_intdigest(b" ".join(w), SEED)], np.uint64)
    digest = xxhash.xxh64_intdigest
    return np.fromiter((digest(b" ".join(s), SEED) for s in zip(*(w[i:] for i in range(words)), strict=False)), np.uint64, len(w) - words + 1)


def majority_bits(hashes: np.ndarray) -> int:
    """The 64 bits that are set in over half of the hashes."""
    if not len(hashes):
        return 0
    counts = np.zeros(64, np.int64)
    for lo in range(0, len(hashes), 1 << 16):
        part = hashes[lo:lo + (1 << 16)].astype(">u8")
        counts += np.unpackbits(part.view(np.uint8).reshape(-1, 8), axis=1).sum(axis=0, dtype=np.int64)
    return int.from_bytes(np.packbits(2 * counts > len(hashes)).tobytes(), "big")


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text: str = "text", words: int = SHINGLE_WORDS) -> DataFrame:
    """``id_col`` and ``fp``: the fingerprint's 64 bits as a signed long."""
    ready(docs)

    def run(batches):
        for batch in batches:
            fps = np.fromiter((majority_bits(shingle_hashes(t.as_buffer().to_pybytes() if t.is_valid else b"", words)) for t in batch.column(1)), np.uint64, batch.num_rows)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(fps.view(np.int64))], [id_col, "fp"])

    kind = docs.schema[id_col].dataType.simpleString()
    return docs.select(F.col(id_col), F.col(text).cast("string").alias(text)).mapInArrow(run, f"`{id_col}` {kind}, fp long")


# ------------------------------------------------------------------ the walk of two subtrees

def _split(fps: np.ndarray, lo: np.ndarray, hi: np.ndarray, bit: int) -> np.ndarray:
    """Where, in each sorted range lo..hi of equal higher bits, the set ``bit`` begins."""
    if bit < 0:
        return hi
    head = fps[lo] >> np.uint64(bit) | np.uint64(1)
    return np.clip(np.searchsorted(fps, head << np.uint64(bit)), lo, hi)


def linked_pairs(left: np.ndarray, right: np.ndarray, bit: int, spent: int, budget: int, same: bool):
    """Index pairs of two sorted arrays (equal above ``bit`` each) that differ in at most ``budget`` bits.

    ``spent`` bits of the budget are used above ``bit``. ``same``: both arrays are one, pairs come once. The walk goes
    down first, ``WALK_PAIRS`` node pairs at a time, so at most four such slices wait at each of 64 levels.
    """
    if not len(left) or not len(right):
        return
    waiting = [(bit, [np.array([x]) for x in (0, len(left), 0, len(right), spent, same)])]
    while waiting:
        bit, (a_lo, a_hi, b_lo, b_hi, used, own) = waiting.pop()
        small = ((a_hi - a_lo) * (b_hi - b_lo) <= LEAF_PAIRS) | (bit < 0)
        if small.any():
            wide = b_hi[small] - b_lo[small]
            size = (a_hi[small] - a_lo[small]) * wide
            group = np.repeat(np.arange(len(size)), size)
            k = np.arange(len(group)) - np.repeat(np.cumsum(size) - size, size)
            i, j = a_lo[small][group] + k // wide[group], b_lo[small][group] + k % wide[group]
            near = (np.bitwise_count(left[i] ^ right[j]) <= budget) & (~own[small][group] | (i < j))
            if near.any():
                yield i[near], j[near]
            go = ~small
            a_lo, a_hi, b_lo, b_hi, used, own = (x[go] for x in (a_lo, a_hi, b_lo, b_hi, used, own))
            if not len(a_lo):
                continue
        a_mid, b_mid = _split(left, a_lo, a_hi, bit), _split(right, b_lo, b_hi, bit)
        parts = []
        for al, ah, bl, bh, more, once in ((a_lo, a_mid, b_lo, b_mid, 0, own), (a_mid, a_hi, b_mid, b_hi, 0, own),
                                           (a_lo, a_mid, b_mid, b_hi, 1, own & False), (a_mid, a_hi, b_lo, b_mid, 1, own & False)):
            live = (ah > al) & (bh > bl) & (used + more <= budget)
            if more and al is a_mid:
                live &= ~own                                   # of one node, the cross pair comes once
            parts.append([x[live] for x in (al, ah, bl, bh, used + more, once)])
        below = [np.concatenate(x) for x in zip(*parts, strict=True)]
        waiting += [(bit - 1, [x[lo:lo + WALK_PAIRS] for x in below]) for lo in range(0, len(below[0]), WALK_PAIRS)]


class Forest:
    """Union-find over indices; ``add`` keeps only links that join two trees."""

    def __init__(self, n: int):
        self.parent = list(range(n))
        self.links: list[tuple[int, int]] = []

    def find(self, x: int) -> int:
        p = self.parent
        while p[x] != x:
            p[x] = p[p[x]]
            x = p[x]
        return x

    def add(self, i: np.ndarray, j: np.ndarray) -> None:
        for a, b in zip(i.tolist(), j.tolist(), strict=True):
            x, y = self.find(a), self.find(b)
            if x != y:
                self.parent[max(x, y)] = min(x, y)
                self.links.append((a, b))


def forest_links(left: np.ndarray, right: np.ndarray | None, bit: int, spent: int, budget: int) -> tuple[np.ndarray, np.ndarray]:
    """A spanning forest of the links within ``left``, or between ``left`` and ``right``."""
    same = right is None
    other = left if same else right
    shift = 0 if same else len(left)
    forest = Forest(len(left) + (0 if same else len(other)))
    for i, j in linked_pairs(left, other, bit, spent, budget, same):
        forest.add(i, j + shift)
    if not forest.links:
        return np.zeros(0, np.uint64), np.zeros(0, np.uint64)
    i, j = np.array(forest.links).T
    return left[i], other[j - shift]


# ------------------------------------------------------------------ cutting and pairing subtrees

def cut_nodes(distinct: DataFrame, total: int) -> list[tuple[int, int]]:
    """Trie nodes ``(prefix, depth)`` that cover all fingerprints, each with at most its share of them.

    Only node counts reach the driver: 2^STEP_BITS for each node that is still too heavy.
    """
    most = max(1, min(-(-total // NODES), NODE_ROWS))
    done, heavy, depth = [], [0], 0
    while heavy:
        step = min(STEP_BITS, 64 - depth)
        below = distinct
        if depth:
            known = distinct.sparkSession.createDataFrame([(p,) for p in heavy], "head long")
            below = distinct.join(F.broadcast(known), F.shiftrightunsigned("fp", 64 - depth) == F.col("head"))
        depth += step
        heavy = []
        for row in below.groupBy(F.shiftrightunsigned("fp", 64 - depth).alias("p")).count().collect():
            (heavy if row["count"] > most and depth < 64 else done).append(row["p"] if row["count"] > most and depth < 64 else (row["p"], depth))
    mask = (1 << 64) - 1
    return sorted(((p & mask & ((1 << d) - 1), d) for p, d in done), key=lambda x: x[0] << (64 - x[1]))


def node_pairs(nodes: list[tuple[int, int]], budget: int) -> list[tuple[int, int, int, int]]:
    """Pairs ``(i, j, bit, spent)`` of nodes, i <= j, whose common-depth prefixes differ in at most ``budget`` bits."""
    children: dict[tuple[int, int], int] = {n: i for i, n in enumerate(nodes)}
    inner: set[tuple[int, int]] = set()
    for p, d in nodes:
        while d and (p >> 1, d - 1) not in inner:
            p, d = p >> 1, d - 1
            inner.add((p, d))
    out = []
    stack = [((0, 0), (0, 0), 0)]
    while stack:
        a, b, spent = stack.pop()
        a_leaf, b_leaf = a in children, b in children
        if a_leaf and b_leaf:
            i, j = sorted((children[a], children[b]))
            out.append((i, j, 63 - min(a[1], b[1]), spent))
            continue
        exists = lambda n: n in children or n in inner
        for x in (0, 1):
            for y in (0, 1):
                na = a if a_leaf else (a[0] * 2 + x, a[1] + 1)
                nb = b if b_leaf else (b[0] * 2 + y, b[1] + 1)
                if (a_leaf and x) or (b_leaf and y) or (a == b and x > y) or not exists(na) or not exists(nb):
                    continue
                more = int(not a_leaf and not b_leaf and x != y)    # bits below the higher node count in the walk
                if spent + more <= budget:
                    stack.append((na, nb, spent + more))
    return out


def fingerprint_links(distinct: DataFrame, budget: int = MAX_BITS) -> DataFrame:
    """Links ``(a, b)`` between distinct fingerprints (``fp``) that span every component within ``budget`` bits."""
    spark = ready(distinct)
    nodes = cut_nodes(distinct, distinct.count())
    pairs = node_pairs(nodes, budget)
    heads = np.array([p << (64 - d) if d else 0 for p, d in nodes], np.uint64)
    partners: dict[int, list[tuple[int, int]]] = defaultdict(list)
    for k, (i, j, _, _) in enumerate(pairs):
        partners[i].append((k, 0))
        if j != i:
            partners[j].append((k, 1))
    per_node = [np.array(partners.get(i, []), np.int64).reshape(-1, 2) for i in range(len(nodes))]
    shared = spark.sparkContext.broadcast((heads, per_node, pairs))

    def deal(batches):
        heads, per_node, _ = shared.value
        for batch in batches:
            fps = np.asarray(batch.column(0), np.int64).view(np.uint64)
            node = np.searchsorted(heads, fps, "right") - 1
            for n in np.unique(node):
                mine, to = fps[node == n].view(np.int64), per_node[n]
                yield pa.RecordBatch.from_arrays([
                    pa.array(np.repeat(to[:, 0].astype(np.int32), len(mine))), pa.array(np.repeat(to[:, 1].astype(np.int8), len(mine))),
                    pa.array(np.tile(mine, len(to)))], ["pair", "side", "fp"])

    def walk(key, table):
        _, _, pairs = shared.value
        i, j, bit, spent = pairs[key[0].as_py()]
        fps, side = table["fp"].to_numpy().view(np.uint64), table["side"].to_numpy()
        left = np.sort(fps[side == 0])
        right = None if i == j else np.sort(fps[side == 1])
        a, b = forest_links(left, right, bit, spent, budget)
        return pa.table({"a": a.view(np.int64), "b": b.view(np.int64)})

    dealt = distinct.select("fp").mapInArrow(deal, "pair int, side byte, fp long")
    return dealt.groupBy("pair").applyInArrow(walk, "a long, b long")


# ------------------------------------------------------------------ the operator

def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text: str = "text", words: int = SHINGLE_WORDS,
                    max_bits: int = MAX_BITS) -> DataFrame:
    """``id_col``, ``fp`` and ``component_id`` (smallest id of the component) for every row."""
    prints = fingerprints(docs, id_col, text, words).checkpoint()
    classes = prints.groupBy("fp").agg(F.min(id_col).alias("least")).checkpoint()
    parts = components(fingerprint_links(classes.select("fp"), max_bits), "a", "b").withColumnRenamed("node", "fp")
    placed = classes.join(parts, "fp", "left").withColumn("component", F.coalesce("component", "fp"))
    least = placed.groupBy("component").agg(F.min("least").alias("component_id"))
    label = placed.join(least, "component").select("fp", "component_id").checkpoint()
    return prints.join(label, "fp").select(id_col, "fp", "component_id")


def hexed(fp: str = "fp"):
    """A signed long as 16 lower-case hex digits."""
    return F.lower(F.lpad(F.hex(F.col(fp)), 16, "0"))
