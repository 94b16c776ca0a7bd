"""Operator 12: phrase collocations by a multikey three-way quicksort of suffix pointers.

Texts are cut into pieces and words. Every word with a follower in its piece begins a suffix of at most ``MAX_WORDS`` words.

* Each task counts the equal suffixes of a batch, and routes them by language and their first two words to a bucket, so all
  occurrences of a phrase meet in one bucket. Buckets follow the number of words; rows of a bucket are packed suffixes
  and their counts, so a passage that a third of all texts hold is one suffix of each batch.
* A bucket sorts pointers to its suffixes word by word: a segment of pointers is parted into smaller, equal and greater at a
  pivot word; the equal part goes on to the next word. All segments are parted at the same time, in numpy. The size
  of a part that is equal in k words is the count of their phrase. A part below the least count is abandoned: no
  phrase in it can reach it. Batches of a bucket are sorted into distinct suffixes as they arrive, so memory
  follows the distinct suffixes of a bucket.
* Counts of single words are a plain aggregate. Scores and the removal of phrases inside longer ones are joins over the
  frequent phrases; the first rows of each language are a window's top k, which Spark takes from each task.

Defined results: a null text is empty; a null language is ``und``, and so is a language of that name. Repeated rows count each
time. An empty table gives no rows. Columns other than the text and the language are not read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import ready, stashed
from .textarrays import mix, slice_hashes, text_groups

MAX_WORDS = 3
#: a phrase has this many occurrences at least
LEAST = 10
#: a phrase goes if a longer one has this percentage of its occurrences
INSIDE_PERCENT = 50
SCALE = 1_000_000
TOP = 2000
#: words to a bucket, on average
BUCKET_WORDS = 2_000_000
#: suffixes that a bucket holds before it sorts them into distinct ones
HELD_SUFFIXES = 3_000_000
#: bytes of text that are cut into words at a time
CUT_BYTES = 2 << 20

#: fixed values: white space between words, and what ends a piece
BETWEEN, ENDS = b"\x20\x09", b".,;:!?\x0A\x0B\x0C\x0D"
_KIND = np.zeros(256, np.int8)
_KIND[list(BETWEEN)] = 1
_KIND[list(ENDS)] = 2
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[0x41:0x5B] += 0x20


def binary_array(data: np.ndarray, starts: np.ndarray, ends: np.ndarray, inside: np.ndarray) -> pa.Array:
    """The slices ``data[starts[i]:ends[i]]`` as one array; ``inside`` marks exactly their bytes."""
    offsets = np.append(0, np.cumsum(ends - starts)).astype(np.int64)
    return pa.LargeBinaryArray.from_buffers(pa.large_binary(), len(starts), [None, pa.py_buffer(offsets), pa.py_buffer(data[inside])])


def coded(values: pa.Array) -> tuple[np.ndarray, pa.Array]:
    """Number of each value in the array of distinct values, and that array."""
    out = values.dictionary_encode()
    return out.indices.to_numpy().astype(np.int64), out.dictionary


def cut_words(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, pa.Array, np.ndarray]:
    """Of texts end to end: each word's text and distinct number, the distinct words, and whether the next word follows in its piece."""
    data = _LOWER[data]
    kind = _KIND[data]
    inside = kind == 0
    before = np.append(False, inside)
    before[offsets] = False
    after = np.append(inside, False)
    after[offsets] = False
    starts = np.flatnonzero(inside & ~before[:-1])
    ends = np.flatnonzero(inside & ~after[1:]) + 1
    number, words = coded(binary_array(data, starts, ends, inside))
    marks = np.append(0, np.cumsum(kind == 2))
    text = np.searchsorted(offsets[1:], starts, "right")
    follows = np.zeros(len(starts), bool)
    follows[:-1] = (text[1:] == text[:-1]) & (marks[starts[1:]] == marks[ends[:-1]])
    return text, number, words, follows


def word_hashes(words: pa.Array) -> np.ndarray:
    _, offsets, data = words.buffers()
    offsets = np.frombuffer(offsets, np.int64)[words.offset:words.offset + len(words) + 1]
    data = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    return slice_hashes(data[offsets[0]:offsets[-1]], offsets[:-1] - offsets[0], offsets[1:] - offsets[0])


def languages(column: pa.Array) -> tuple[np.ndarray, list[str]]:
    out = column.dictionary_encode()
    return out.indices.to_numpy(), out.dictionary.to_pylist()


def by_language(batches, least_bytes: int = CUT_BYTES) -> Iterator[tuple[str, np.ndarray, pa.Array, np.ndarray]]:
    """``(lang, numbers, words, follows)`` for the texts of one language in a part of a batch (columns: lang, text)."""
    for batch in batches:
        for lo, hi, data, offsets in text_groups(batch.column(1), least_bytes):
            text, number, words, follows = cut_words(data, offsets)
            which, names = languages(batch.column(0).slice(lo, hi - lo))
            own = which[text]
            order = np.argsort(own, kind="stable")
            borders = np.searchsorted(own[order], np.arange(len(names) + 1))
            for i, name in enumerate(names):
                at = order[borders[i]:borders[i + 1]]
                if len(at):
                    yield name, number[at], words, follows[at]


# ------------------------------------------------------------------ counts of words

def word_counts(docs: DataFrame) -> DataFrame:
    """``lang, phrase, n`` of single words; ``docs`` has the columns lang and text."""
    def count(batches):
        for lang, number, words, _ in by_language(batches):
            n = np.bincount(number, minlength=len(words))
            some = np.flatnonzero(n)
            yield pa.RecordBatch.from_arrays([pa.array([lang] * len(some), pa.string()), words.take(pa.array(some)).cast(pa.binary()).cast(pa.string()),
                                              pa.array(n[some])], ["lang", "phrase", "n"])

    return docs.mapInArrow(count, "lang string, phrase string, n long").groupBy("lang", "phrase").agg(F.sum("n").alias("n"))


# ------------------------------------------------------------------ suffixes

def distinct_suffixes(first: np.ndarray, second: np.ndarray, third: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """One place of each distinct suffix, and how often it occurs; ``third`` is -1 where the piece ends."""
    wide = int(max(first.max(initial=0), second.max(initial=0), third.max(initial=0))) + 2
    _, pair = np.unique(first * wide + second, return_inverse=True)
    _, at, n = np.unique(pair * wide + third + 1, return_index=True, return_counts=True)
    return at, n


def routed_suffixes(docs: DataFrame, buckets: int) -> DataFrame:
    """``lang, bucket, suffixes, n``: packed distinct suffixes of a part of a batch, and their counts (little-endian 32-bit)."""
    def route(batches):
        for lang, number, words, follows in by_language(batches):
            at = np.flatnonzero(follows)
            if not len(at):
                continue
            two = follows[at] & np.append(follows, False)[at + 1]
            third = np.where(two, number[np.minimum(at + 2, len(number) - 1)], -1)
            keep, n = distinct_suffixes(number[at], number[at + 1], third)
            first, second, third = number[at[keep]], number[at[keep] + 1], third[keep]
            h = word_hashes(words)
            bucket = (mix(h[first] * np.uint64(3) + mix(h[second])) % np.uint64(buckets)).astype(np.int64)
            order = np.argsort(bucket, kind="stable")
            bucket, n = bucket[order], n[order].astype("<u4")
            third = third[order]
            joined = pc.binary_join_element_wise(words.take(pa.array(first[order])), words.take(pa.array(second[order])),
                                                 words.take(pa.array(third, mask=third < 0)), pa.scalar(b" ", pa.large_binary()), null_handling="skip")
            lines = pc.binary_join_element_wise(joined, pa.scalar(b"", pa.large_binary()), pa.scalar(b"\n", pa.large_binary()))
            _, offsets, data = lines.buffers()
            offsets = np.frombuffer(offsets, np.int64)[:len(lines) + 1]
            data, counts = data.to_pybytes(), n.tobytes()
            cuts = np.flatnonzero(np.append(True, bucket[1:] != bucket[:-1]))
            ends = np.append(cuts[1:], len(bucket))
            yield pa.RecordBatch.from_arrays([
                pa.array([lang] * len(cuts), pa.string()), pa.array(bucket[cuts]),
                pa.array([data[offsets[s]:offsets[e]] for s, e in zip(cuts.tolist(), ends.tolist(), strict=True)], pa.binary()),
                pa.array([counts[4 * s:4 * e] for s, e in zip(cuts.tolist(), ends.tolist(), strict=True)], pa.binary()),
            ], ["lang", "bucket", "suffixes", "n"])

    return docs.mapInArrow(route, "lang string, bucket long, suffixes binary, n binary")


class Suffixes:
    """Distinct suffixes of a bucket: word numbers (``MAX_WORDS`` rows, -1 after the end), their counts, and the words."""

    def __init__(self, keys: np.ndarray, n: np.ndarray, words: pa.Array):
        self.keys, self.n, self.words = keys, n, words

    @classmethod
    def parsed(cls, packed: list[bytes], counts: list[bytes]) -> Suffixes:
        data = np.frombuffer(b"".join(packed), np.uint8)
        line_end = data == 0x0A
        inside = ~line_end & (data != 0x20)
        edge = np.flatnonzero(~inside)                                   # every word is followed by a mark
        starts = np.append(0, edge[:-1] + 1) if len(edge) else edge
        number, words = coded(binary_array(data, starts, edge, inside))
        last = np.flatnonzero(line_end[edge])                            # last word of each suffix
        first = np.append(0, last[:-1] + 1) if len(last) else last
        keys = np.full((MAX_WORDS, len(last)), -1, np.int64)
        for k in range(MAX_WORDS):
            some = first + k <= last
            keys[k, some] = number[first[some] + k]
        return cls(keys, np.frombuffer(b"".join(counts), "<u4").astype(np.int64), words)

    def merged(self, other: Suffixes) -> Suffixes:
        """Both, equal suffixes added."""
        number, words = coded(pa.concat_arrays([self.words, other.words]))
        new = number[len(self.words):]
        added = np.where(other.keys < 0, -1, new[np.maximum(other.keys, 0)]) if len(new) else other.keys
        keys = np.concatenate([self.keys, added], axis=1)
        n = np.concatenate([self.n, other.n])
        wide = len(words) + 1
        _, group = np.unique(keys[0] * wide + keys[1] + 1, return_inverse=True)
        _, at, group = np.unique(group * wide + keys[2] + 1, return_index=True, return_inverse=True)
        return Suffixes(keys[:, at], np.bincount(group, n, len(at)).astype(np.int64), words)


def three_way_counts(keys: np.ndarray, n: np.ndarray, least: int) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """``(words, pointers, counts)`` of all phrases of two or more words with ``least`` occurrences or more.

    Multikey three-way quicksort of the pointers ``0 .. len(n) - 1``: every segment is parted at the median of three of its
    keys at its depth; the equal part goes one key deeper, to the last one. Parts whose counts add up to less than
    ``least`` are abandoned, and so is what is left of a suffix that has ended.
    """
    deepest = len(keys)
    pointer = np.arange(len(n))
    begin = np.zeros(1 if len(n) else 0, np.int64)                     # first place of each segment
    depth = np.zeros(len(begin), np.int64)
    while len(begin):
        size = np.diff(np.append(begin, len(pointer)))
        segment = np.repeat(np.arange(len(begin)), size)
        key = keys[depth[segment], pointer]
        low, mid, high = key[begin], key[begin + size // 2], key[begin + size - 1]
        pivot = np.maximum(np.minimum(low, mid), np.minimum(np.maximum(low, mid), high))[segment]
        part = 3 * segment + (key >= pivot) + (key > pivot)
        counts = np.bincount(part, n[pointer], 3 * len(begin)).astype(np.int64)
        sizes = np.bincount(part, minlength=3 * len(begin))
        equal = np.zeros(3 * len(begin), bool)
        equal[1::3] = pivot[begin] >= 0                                # an ended suffix has no next word
        stays = counts >= least
        stays[1::3] &= equal[1::3]
        new_depth = np.repeat(depth, 3) + equal
        rows = stays[part]
        pointer, part = pointer[rows], part[rows]
        order = np.argsort(part, kind="stable")
        pointer, part = pointer[order], part[order]
        kept = np.flatnonzero(stays & (sizes > 0))
        begin = np.searchsorted(part, kept)
        found = equal[kept]
        for words in range(2, deepest + 1):
            hit = found & (new_depth[kept] == words)
            if hit.any():
                yield words, pointer[begin[hit]], counts[kept[hit]]
        depth = new_depth[kept]
        on = depth < deepest
        if not on.all():
            inside = np.repeat(on, np.diff(np.append(begin, len(pointer))))
            sizes = np.diff(np.append(begin, len(pointer)))[on]
            pointer, depth = pointer[inside], depth[on]
            begin = np.cumsum(sizes) - sizes


def phrase_counts(suffixes: DataFrame, least: int = LEAST, held: int = HELD_SUFFIXES) -> DataFrame:
    """``lang, phrase, words, a`` of all phrases of 2 to ``MAX_WORDS`` words with ``least`` occurrences or more."""
    def sort(key: tuple[pa.Scalar, ...], batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        have, packed, counts, size = None, [], [], 0

        def flushed():
            new = Suffixes.parsed(packed, counts)
            none = Suffixes(np.zeros((MAX_WORDS, 0), np.int64), np.zeros(0, np.int64), pa.array([], pa.large_binary()))
            return new.merged(none) if have is None else have.merged(new)

        for batch in batches:
            for body, n in zip(batch.column("suffixes"), batch.column("n"), strict=True):
                packed.append(body.as_py())
                counts.append(n.as_py())
                size += len(counts[-1]) // 4
                if size > held:
                    have, packed, counts, size = flushed(), [], [], 0
        if packed:
            have = flushed()
        for words, at, n in three_way_counts(have.keys, have.n, least):
            parts = [have.words.take(pa.array(have.keys[k, at])) for k in range(words)]
            phrase = pc.binary_join_element_wise(*parts, pa.scalar(b" ", pa.large_binary()))
            yield pa.RecordBatch.from_arrays([pa.array([key[0].as_py()] * len(at), pa.string()), phrase.cast(pa.binary()).cast(pa.string()),
                                              pa.array(np.full(len(at), words), pa.int32()), pa.array(n)], ["lang", "phrase", "words", "a"])

    return suffixes.groupBy("lang", "bucket").applyInArrow(sort, "lang string, phrase string, words int, a long")


# ------------------------------------------------------------------ scores

def scored(phrases: DataFrame, words: DataFrame) -> DataFrame:
    """``phrases`` with the counts ``l`` and ``r`` of the two parts at their lowest-scoring cut, and ``score``.

    A part of a frequent phrase is at least as frequent, so its count is in ``phrases`` or ``words``. Products are decimals of 38
    digits: exact up to 10^15 occurrences.
    """
    parts = phrases.select("lang", F.col("phrase").alias("part"), F.col("a").alias("f")).unionByName(
        words.select("lang", F.col("phrase").alias("part"), F.col("n").alias("f")))
    word = F.split("phrase", " ")
    cuts = phrases.withColumn("k", F.explode(F.sequence(F.lit(1), F.col("words") - 1))).select(
        "*", F.array_join(F.slice(word, F.lit(1), F.col("k")), " ").alias("head"),
        F.array_join(F.slice(word, F.col("k") + 1, F.col("words") - F.col("k")), " ").alias("tail"))
    for part, count in (("head", "l"), ("tail", "r")):
        cuts = cuts.join(parts.select("lang", F.col("part").alias(part), F.col("f").alias(count)), ["lang", part])
    score = F.expr(f"CAST({SCALE} AS DECIMAL(7,0)) * CAST(a AS DECIMAL(15,0)) * CAST(a AS DECIMAL(15,0)) div (CAST(l AS DECIMAL(15,0)) * CAST(r AS DECIMAL(15,0)))")
    cuts = cuts.withColumn("cut", F.struct(score.alias("score"), "k", "l", "r"))
    return cuts.groupBy("lang", "phrase", "words", "a").agg(F.min("cut").alias("cut")).select(
        "lang", "phrase", "words", "a", "cut.l", "cut.r", "cut.score")


def not_inside(phrases: DataFrame, counts: DataFrame, percent: int = INSIDE_PERCENT) -> DataFrame:
    """``phrases`` without those whose words lie inside a longer phrase of ``counts`` with ``percent`` of their occurrences."""
    word = F.split("phrase", " ")
    longer = counts.where("words > 2").withColumn("size", F.explode(F.sequence(F.lit(2), F.col("words") - 1))).withColumn(
        "start", F.explode(F.sequence(F.lit(1), F.col("words") - F.col("size") + 1)))
    inner = longer.groupBy("lang", F.array_join(F.slice(word, F.col("start"), F.col("size")), " ").alias("phrase")).agg(F.max("a").alias("most"))
    return phrases.join(inner, ["lang", "phrase"], "left").where(F.col("most").isNull() | (100 * F.col("most") < percent * F.col("a"))).drop("most")


def collocations(docs: DataFrame, lang: str = "lang", text: str = "text", top: int = TOP, least: int = LEAST,
                 bucket_words: int = BUCKET_WORDS) -> DataFrame:
    """``lang, rank, phrase, a, l, r, n, score``: each language's first ``top`` phrases by score, count and bytes."""
    spark = ready(docs)
    texts = docs.select(F.coalesce(F.col(lang).cast("string"), F.lit("und")).alias("lang"), F.coalesce(F.col(text).cast("string"), F.lit("")).alias("text"))
    with stashed(word_counts(texts), "collocation-words") as words:
        totals = words.groupBy("lang").agg(F.sum("n").alias("n")).checkpoint()
        total = totals.agg(F.sum("n")).first()[0] or 0
        buckets = max(1, -(-total // bucket_words))
        with stashed(phrase_counts(routed_suffixes(texts, buckets), least), "collocation-phrases") as phrases:
            found = not_inside(scored(phrases, words.where(F.col("n") >= least)), phrases)
            place = Window.partitionBy("lang").orderBy(F.desc("score"), F.desc("a"), F.asc("phrase"))
            first = found.withColumn("rank", F.row_number().over(place)).where(F.col("rank") <= top)
            out = first.join(totals, "lang").select("lang", F.col("rank").cast("long").alias("rank"), "phrase", "a", "l", "r", "n", "score")
            return out.checkpoint()
