"""Benchmark decontamination by greedy string tiling (operator 7).

Tokens are runs of letters and digits, A-Z and the Latin-1 capitals lower-cased. Seeds are the ``MIN_TILE``-token
windows of the benchmark; an item of fewer tokens is its own seed, so its least tile is all of it. Documents are read
once: the benchmark is cut into blocks of at most ``BLOCK_BYTES`` of its text, each a file that Spark ships to every
executor, and a task holds one block at a time. Windows of a document that are seeds name the items it shares tokens
with. For each such item, the longest match of unmarked tokens is found by Karp-Rabin hashes of all windows of a length,
marked in both, and searched again, down to the least tile. An item is leaked where the tiles cover at least
``MIN_COVERAGE`` of its tokens: the order of its parts in the document does not matter. All of this happens where the
document is read, so a passage that a third of all documents hold moves no rows.

Two exact bounds keep phrases that many items share from costing a tiling for each. Tiles of ``c`` tokens hold at least
``c / MIN_TILE`` seed places, so an item with fewer places than that among its most frequent seeds can leave these out of
the index: a leaked item is still named by another. And tiles lie under shared seeds, so an item or a document with
fewer tokens under them than the coverage asks for is not tiled.

Defined results: null or empty text, on either side: no tokens, no leak. Ties: of equally long matches the first in the
item, then in the document, is marked first. Repeated rows: each document row with each item row. Ids may be of any
type, and null. Empty tables: empty result. Memory follows the longest single text. Other columns are ignored.
"""

from __future__ import annotations

import math
import os
import pickle
import tempfile
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import SparkFiles
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type

from .common import ready
from .textarrays import mix, powers, ragged, slice_hashes, text_groups

MIN_TILE, MIN_COVERAGE = 5, 0.8
#: benchmark text of a block, at most
BLOCK_BYTES = 16 << 20

_TOKEN = np.zeros(256, bool)
_TOKEN[[*range(0x30, 0x3A), *range(0x41, 0x5B), *range(0x61, 0x7B), *range(0x80, 0x100)]] = True
_FOLD = np.arange(256, dtype=np.uint8)
_FOLD[0x41:0x5B] += 0x20
_ROLL = 0xBF58476D1CE4E5B9


def tokens(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Starts, ends (bytes), 64-bit hashes and text numbers of all tokens."""
    n = len(data)
    folded = _FOLD[data]
    if n:
        capital = np.flatnonzero((data[1:] >= 0x80) & (data[1:] <= 0x9E) & (data[1:] != 0x97) & (data[:-1] == 0xC3)) + 1
        folded[capital] += 0x20
    inside = _TOKEN[data]
    before, after = np.zeros(n + 1, bool), np.zeros(n + 1, bool)
    before[1:], after[:n] = inside, inside
    before[offsets] = after[offsets] = False
    starts, ends = np.flatnonzero(inside & ~before[:n]), np.flatnonzero(inside & ~after[1:]) + 1
    return starts, ends, slice_hashes(folded, starts, ends), np.searchsorted(offsets[1:], starts, "right")


def window_hashes(hashes: np.ndarray, length: int) -> np.ndarray:
    """Karp-Rabin hashes of all windows of ``length`` tokens."""
    n = len(hashes)
    if n < length:
        return np.zeros(0, np.uint64)
    sums = np.zeros(n + 1, np.uint64)
    np.cumsum(hashes * powers(_ROLL, n), out=sums[1:])
    return mix((sums[length:] - sums[:n - length + 1]) * powers(pow(_ROLL, -1, 1 << 64), n)[:n - length + 1])


def greedy_tiles(item: np.ndarray, doc: np.ndarray, least: int) -> list[tuple[int, int, int]]:
    """Tiles ``(place in item, place in doc, length)``: longest first, never overlapping, ``least`` tokens or more."""
    free_a, free_b = np.ones(len(item), bool), np.ones(len(doc), bool)

    def matches(length: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        def unmarked(free):
            taken = np.append(0, np.cumsum(~free))
            return np.flatnonzero(taken[length:] == taken[:len(free) - length + 1])

        a, b = unmarked(free_a), unmarked(free_b)
        ha, hb = window_hashes(item, length)[a], window_hashes(doc, length)[b]
        both = np.intersect1d(ha, hb)
        a_in, b_in = np.isin(ha, both), np.isin(hb, both)
        return a[a_in], ha[a_in], b[b_in], hb[b_in]

    out: list[tuple[int, int, int]] = []
    high = min(len(item), len(doc))
    while high >= least:
        low, top, found = least, high, None
        while low <= top:                                      # a match of some length holds matches of all lesser ones
            middle = (low + top) // 2
            now = matches(middle)
            if len(now[0]):
                found, low = (middle, *now), middle + 1
            else:
                top = middle - 1
        if found is None:
            break
        high, a, ha, b, hb = found
        places: dict[int, list[int]] = {}
        for j, h in zip(b.tolist(), hb.tolist(), strict=True):
            places.setdefault(h, []).append(j)
        marked = False
        for i, h in zip(a.tolist(), ha.tolist(), strict=True):
            if not free_a[i:i + high].all():
                continue
            for k, j in enumerate(places[h]):
                if free_b[j:j + high].all() and np.array_equal(item[i:i + high], doc[j:j + high]):
                    free_a[i:i + high] = free_b[j:j + high] = False
                    out.append((i, j, high))
                    places[h] = places[h][k + 1:]
                    marked = True
                    break
        if not marked:                                         # equal hashes of different tokens
            high -= 1
    return out


class Index:
    """Seeds of one length and the items they name."""

    def __init__(self, seeds: np.ndarray, owners: np.ndarray):
        order = np.lexsort((owners, seeds))
        self.owners = owners[order]
        self.keys, self.first, self.counts = np.unique(seeds[order], return_index=True, return_counts=True)
        self.shift = np.uint64(64 - max(16, (16 * len(self.keys)).bit_length()))
        self.some = np.zeros(1 << (64 - int(self.shift)), bool)      # looked at before the keys
        self.some[(self.keys >> self.shift).astype(np.int64)] = True

    def named(self, windows: np.ndarray, text: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Distinct pairs of a text (number of the windows' texts, -1: none) and an item, by text."""
        place = np.flatnonzero(self.some[(windows >> self.shift).astype(np.int64)] & (text >= 0))
        seed = np.minimum(np.searchsorted(self.keys, windows[place]), len(self.keys) - 1)
        hit = self.keys[seed] == windows[place]
        once = np.unique(text[place[hit]] * len(self.keys) + seed[hit])
        seed, times = once % len(self.keys), self.counts[once % len(self.keys)]
        items = self.owners.max() + 1
        pairs = np.unique(np.repeat(once // len(self.keys), times) * items + self.owners[ragged(self.first[seed], times)])
        return pairs // items, pairs % items


def _under(places: np.ndarray, length: int) -> int:
    """Tokens under windows of ``length`` at the ascending ``places``."""
    return int(np.minimum(np.diff(places), length).sum()) + length if len(places) else 0


class Block:
    """Some benchmark items with their indexes by seed length; pairs below ``coverage`` need not be found."""

    def __init__(self, items: list[tuple[object, str | None]], least: int, coverage: float = 0.0):
        self.coverage, self.ids, self.items = coverage, [i for i, _ in items], []
        windows: dict[int, list[tuple[int, np.ndarray, np.ndarray]]] = {}
        for number, (_, text) in enumerate(items):
            data = np.frombuffer((text or "").encode(), np.uint8)
            self.items.append(tokens(data, np.array([0, len(data)]))[2])
            if length := min(least, len(self.items[-1])):
                windows.setdefault(length, []).append((number, *np.unique(window_hashes(self.items[-1], length), return_counts=True)))
        self.indexes: dict[int, Index] = {}
        for length, found in sorted(windows.items()):
            known, held = np.unique(np.concatenate([seeds for _, seeds, _ in found]), return_counts=True)
            seeds_of, owners_of = [], []
            for number, seeds, times in found:
                spare = math.ceil(self._needed(number) / length) - 1     # places that a leak can do without
                order = np.argsort(-held[np.searchsorted(known, seeds)], kind="stable")
                kept = order[np.cumsum(times[order]) > spare]
                seeds_of.append(seeds[kept])
                owners_of.append(np.full(len(kept), number))
            self.indexes[length] = Index(np.concatenate(seeds_of), np.concatenate(owners_of))

    def _needed(self, number: int) -> int:
        """Tiled tokens that an item's pairs have, at least."""
        return math.ceil(self.coverage * len(self.items[number]))

    def leaks(self, data: np.ndarray, offsets: np.ndarray) -> list[tuple[int, int, int, int, list[tuple[int, int]]]]:
        """``(text, item, item tokens, tiled tokens, byte spans)`` of the pairs that share a seed and reach the coverage."""
        starts, ends, hashes, doc = tokens(data, offsets)
        out = []
        for length, index in self.indexes.items():
            windows = window_hashes(hashes, length)
            if not len(windows):
                continue
            texts, items = index.named(windows, np.where(doc[:len(windows)] == doc[length - 1:], doc[:len(windows)], -1))
            if not len(texts):
                continue
            heads = np.flatnonzero(np.append(True, texts[1:] != texts[:-1]))
            for lo, hi in zip(heads.tolist(), [*heads[1:].tolist(), len(texts)], strict=True):
                text = int(texts[lo])
                begin, end = np.searchsorted(doc, [text, text + 1]).tolist()
                own = windows[begin:end - length + 1]
                order = np.argsort(own, kind="stable")
                for number in items[lo:hi].tolist():
                    tiles = self._tiles(number, length, hashes[begin:end], own[order], order)
                    if tiles is not None:
                        spans = sorted((int(starts[begin + j]), int(ends[begin + j + n - 1])) for j, n in tiles)
                        out.append((text, number, len(self.items[number]), sum(n for _, n in tiles), spans))
        return out

    def _tiles(self, number: int, length: int, hashes: np.ndarray, ranked: np.ndarray, order: np.ndarray) -> list[tuple[int, int]] | None:
        """``(place in the text, length)`` of the tiles, or None below the coverage.

        ``ranked`` are the text's windows in ascending order, ``order`` their places.
        """
        item = self.items[number]
        seeds = window_hashes(item, length)
        low, high = np.searchsorted(ranked, seeds, "left"), np.searchsorted(ranked, seeds, "right")
        shared = np.flatnonzero(high > low)
        once = shared[np.unique(seeds[shared], return_index=True)[1]]
        places = np.sort(order[ragged(low[once], (high - low)[once])])
        if min(_under(shared, length), _under(places, length)) < max(self._needed(number), 1):
            return None
        # only tokens inside seeds of this item can be tiled: those stretches, with a stop between them
        last = np.append(places[1:] > places[:-1] + length, True)
        first = np.append(True, last[:-1])
        parts, where = [], []
        for a, b in zip(places[first].tolist(), (places[last] + length).tolist(), strict=True):
            parts += [hashes[a:b], np.array([_stop(len(where))], np.uint64)]
            where += [*range(a, b), -1]
        tiles = [(where[j], n) for _, j, n in greedy_tiles(item, np.concatenate(parts), length)]
        return tiles if tiles and sum(n for _, n in tiles) >= self.coverage * len(item) else None


def _stop(n: int) -> int:
    """A token hash that no other stop has; an equal token's hash is as unlikely as any collision."""
    return (0xA5A5A5A5A5A5A5A5 + n * 0x9E3779B97F4A7C15) % (1 << 64)


LEAK = ("item_tokens long, tiled_tokens long, tiles long, coverage double, spans array<struct<start:long,end:long>>")


def benchmark_blocks(benchmark: DataFrame, item_col: str, text: str, block_bytes: int):
    """Yield the benchmark's rows in blocks of about ``block_bytes`` of text or less."""
    size = benchmark.agg(F.sum(F.octet_length(F.col(text).cast("string")))).first()[0] or 0
    blocks = max(1, -(-2 * size // block_bytes))
    part = F.pmod(F.xxhash64(item_col, text), F.lit(blocks))
    for b in range(blocks):
        rows = benchmark.where(part == b) if blocks > 1 else benchmark
        items = [(r[0], r[1]) for r in rows.select(item_col, F.col(text).cast("string")).collect()]
        if items:
            yield sorted(items, key=lambda x: (x[0] is None, x[0], x[1] or ""))


_FOLDERS: list[tempfile.TemporaryDirectory] = []
_LOADED: dict[str, Block] = {}


def ship_blocks(spark: SparkSession, benchmark: DataFrame, item_col: str, text: str, least: int, coverage: float, block_bytes: int) -> list[str]:
    """Names of the files that hold the benchmark's blocks on every executor.

    The driver serves them, also to executors that join later, and deletes its copies when the process ends.
    """
    names = []
    for items in benchmark_blocks(benchmark, item_col, text, block_bytes):
        if not names:
            _FOLDERS.append(tempfile.TemporaryDirectory(prefix="benchmark-blocks-"))
        names.append(f"benchmark-{uuid.uuid4().hex[:12]}.block")
        path = os.path.join(_FOLDERS[-1].name, names[-1])
        with open(path, "wb") as f:
            pickle.dump(Block(items, least, coverage), f, protocol=5)
        spark.sparkContext.addFile(path)
    return names


def shipped(names: list[str]) -> Iterator[Block]:
    """The blocks, one in memory at a time; a single one stays for the next call."""
    for name in names:
        if name not in _LOADED:
            _LOADED.clear()
            with open(SparkFiles.get(name), "rb") as f:
                _LOADED[name] = pickle.load(f)  # noqa: S301 - written by ship_blocks
        yield _LOADED[name]


def shared_passages(docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text: str = "text", item_col: str = "item_id",
                    least: int = MIN_TILE, block_bytes: int = BLOCK_BYTES, least_coverage: float = 0.0) -> DataFrame:
    """``id_col``, ``item_col`` and the tiling (spans in code points) of the pairs that share a seed and reach ``least_coverage``."""
    spark = ready(docs)
    kind, item_kind = (d.schema[c].dataType.simpleString() for d, c in ((docs, id_col), (benchmark, item_col)))
    item_type = to_arrow_type(benchmark.schema[item_col].dataType)
    schema = f"`{id_col}` {kind}, `{item_col}` {item_kind}, {LEAK}"
    spans_type = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))
    names = ship_blocks(spark, benchmark, item_col, text, least, least_coverage, block_bytes)

    def tile(batches):
        for batch in batches:
            for block in shipped(names):
                for lo, hi, data, offsets in text_groups(batch.column(1)):
                    found = block.leaks(data, offsets)
                    if not found:
                        continue
                    points = np.append(0, np.cumsum((data & 0xC0) != 0x80))
                    rows, item, size, tiled, spans = zip(*found, strict=True)
                    spans = [[{"start": int(points[a] - points[offsets[r]]), "end": int(points[b] - points[offsets[r]])} for a, b in s] for r, s in zip(rows, spans, strict=True)]
                    own = batch.column(0).slice(lo, hi - lo).take(pa.array(rows))
                    yield pa.RecordBatch.from_arrays([
                        own, pa.array([block.ids[i] for i in item], item_type), pa.array(size, pa.int64()), pa.array(tiled, pa.int64()),
                        pa.array([len(s) for s in spans], pa.int64()), pa.array([t / n for t, n in zip(tiled, size, strict=True)], pa.float64()),
                        pa.array(spans, spans_type)], [id_col, item_col, "item_tokens", "tiled_tokens", "tiles", "coverage", "spans"])

    return docs.select(F.col(id_col), F.col(text).cast("string").alias(text)).mapInArrow(tile, schema)


def leaks(docs: DataFrame, benchmark: DataFrame, least_coverage: float = MIN_COVERAGE, **options) -> DataFrame:
    """The pairs of document and item whose tiles cover at least ``least_coverage`` of the item."""
    return shared_passages(docs, benchmark, least_coverage=least_coverage, **options)


def without_leaks(docs: DataFrame, benchmark: DataFrame, text: str = "text", item_col: str = "item_id", least: int = MIN_TILE,
                  least_coverage: float = MIN_COVERAGE, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """The rows of ``docs``, all columns, that leak no item; decided where a row is read."""
    spark = ready(docs)
    place = docs.columns.index(text)
    names = ship_blocks(spark, benchmark, item_col, text, least, least_coverage, block_bytes)

    def clean(batches):
        for batch in batches:
            keep = np.ones(batch.num_rows, bool)
            for block in shipped(names):
                for lo, _, data, offsets in text_groups(batch.column(place)):
                    keep[[lo + found[0] for found in block.leaks(data, offsets)]] = False
            yield batch.filter(pa.array(keep))

    return docs.mapInArrow(clean, docs.schema)
