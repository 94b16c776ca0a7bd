"""Byte-level BPE through a minimal acyclic transducer of frequent words (operator 6).

Texts are cut into pretokens by the vocabulary's own pattern, column-wise: each character gets its class
(letter, number, white space, other) and the borders follow from neighbouring classes. The most frequent
pretokens of the *whole* corpus (counted by Spark, ``lexicon_words`` of them at most) are compiled into one
minimal acyclic automaton: equal suffixes share states, and the outputs along a word's path add up to its
number, which points at its token ids. The arrays are saved as files, shipped with ``addFile`` and memory-mapped
by the workers. All words of a group of texts walk the automaton together, one byte per step. Words outside the
lexicon are merged exactly, lowest rank first, also together. The lexicon decides only speed, never the ids.

Defined results: null or empty text: no ids, empty decoded text. Repeated rows and ties: each row on its own.
Empty table: empty result. Memory follows the longest single text. Extra columns are ignored.
"""

from __future__ import annotations

import atexit
import json
import os
import shutil
import tempfile
import uuid
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import SparkFiles
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import ready, stashed
from .textarrays import IntTable, ragged, slice_hashes, text_groups

#: words of the lexicon, at most
LEXICON_WORDS = 65_536
#: longer pretokens are never taken into the lexicon
LEXICON_BYTES = 48
#: bytes of text counted at a time before counts leave a worker
COUNT_GROUP_BYTES = 2 << 20

LETTER, NUMBER, SPACE, OTHER = 1, 2, 3, 0


# ------------------------------------------------------------------ vocabulary

@dataclass
class Vocabulary:
    """Token bytes by id, byte ids, ranked pairs and added tokens of a byte-level BPE file."""

    tokens: list[bytes]
    byte_ids: np.ndarray
    pairs: IntTable           # left * 2^20 + right -> rank * 2^20 + merged id
    added: dict[bytes, int]


def _byte_alphabet() -> dict[str, int]:
    """The printable stand-ins of the 256 bytes in byte-level BPE files (a public, fixed rule)."""
    plain = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    rest = [b for b in range(256) if b not in set(plain)]
    return {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(rest)}


def load_vocabulary(path: str) -> Vocabulary:
    with open(path, encoding="utf-8") as f:
        spec = json.load(f)
    alphabet = _byte_alphabet()
    vocab = spec["model"]["vocab"]
    added = {t["content"].encode(): t["id"] for t in spec["added_tokens"]}
    tokens = [b""] * (max([*vocab.values(), *added.values()]) + 1)
    for text, i in vocab.items():
        tokens[i] = bytes(alphabet[c] for c in text)
    for text, i in added.items():
        tokens[i] = text
    left, right, merged = [], [], []
    for pair in spec["model"]["merges"]:
        a, b = pair if isinstance(pair, list) else pair.split(" ")
        left.append(vocab[a])
        right.append(vocab[b])
        merged.append(vocab[a + b])
    keys = (np.array(left, np.int64) << 20) | np.array(right, np.int64)
    values = (np.arange(len(keys), dtype=np.int64) << 20) | np.array(merged, np.int64)
    byte_ids = np.zeros(256, np.int64)
    for c, b in alphabet.items():
        byte_ids[b] = vocab[c]
    return Vocabulary(tokens, byte_ids, IntTable.build(keys, values), added)


# ------------------------------------------------------------------ pretokens

_CLASSES: np.ndarray | None = None


def classes() -> np.ndarray:
    """Class of each code point: letter, number, white space or other."""
    global _CLASSES
    if _CLASSES is None:
        import regex

        every = "".join(map(chr, [*range(0xD800), *range(0xE000, 0x110000)]))
        table = np.zeros(0x110000, np.uint8)
        for kind, pattern in ((LETTER, r"\p{L}+"), (NUMBER, r"\p{N}+"), (SPACE, r"\s+")):
            for m in regex.finditer(pattern, every):
                table[np.frombuffer(m.group().encode("utf-32-le"), np.uint32)] = kind
        _CLASSES = table
    return _CLASSES


def pretokens(data: np.ndarray, offsets: np.ndarray, added: dict[bytes, int]) -> tuple[np.ndarray, np.ndarray]:
    """Byte borders of all pretokens, and for each the id of an added token or -1.

    Follows the pattern ``'s|'t|'re|'ve|'m|'ll|'d| ?\\p{L}+| ?\\p{N}+| ?[^\\s\\p{L}\\p{N}]+|\\s+(?!\\S)|\\s+``,
    applied to each text and to the stretches between added tokens.
    """
    n = len(data)
    if not n:
        return np.zeros(1, np.int64), np.zeros(0, np.int64)
    raw = data.tobytes()
    points = np.frombuffer(raw.decode("utf-8").encode("utf-32-le"), np.uint32)
    at = np.flatnonzero((data & 0xC0) != 0x80)             # byte place of each character
    m = len(points)
    cls = classes()[points]
    fresh = np.zeros(m + 1, bool)                            # a text or a stretch starts here
    fresh[np.searchsorted(at, offsets)] = True
    special = []
    for word, token in added.items():
        place = raw.find(word)
        while place >= 0:
            owner = np.searchsorted(offsets, place, "right")
            if place + len(word) <= offsets[owner]:
                special.append((place, place + len(word), token))
                place = raw.find(word, place + len(word))
            else:
                place = raw.find(word, place + 1)
    special.sort()
    for a, b, _ in special:
        fresh[np.searchsorted(at, [a, b])] = True
    fresh[0] = fresh[m] = True
    space = cls == SPACE
    blank = points == 0x20
    start = np.ones(m + 1, bool)
    start[1:m] = (cls[1:] != cls[:-1]) | fresh[1:m]
    joined = np.zeros(m + 1, bool)                           # preceded by a blank of its own text
    joined[1:m] = blank[:-1] & ~space[1:] & ~fresh[1:m]
    last = np.zeros(m + 1, bool)                             # white space right before something else
    last[:m - 1] = space[:-1] & ~space[1:] & ~fresh[1:m]
    quote = np.flatnonzero((points[:-2] == 0x27) & start[:m - 2] & ~joined[:m - 2] & (cls[1:-1] == LETTER) & ~fresh[1:m - 1]) if m > 2 else np.zeros(0, np.int64)
    start |= last
    start &= ~joined
    if m >= 2 and points[m - 2] == 0x27 and cls[m - 1] == LETTER and not fresh[m - 1] and not joined[m - 2] and \
            (cls[m - 3] != OTHER or fresh[m - 2] if m > 2 else True):
        quote = np.append(quote, m - 2)
    if len(quote):
        one = np.isin(points[quote + 1], [ord(c) for c in "stmd"])
        second = np.where(quote + 2 < m, points[np.minimum(quote + 2, m - 1)], 0)
        second = np.where(fresh[quote + 2], 0, second)
        first = points[quote + 1]
        two = (((first == ord("r")) | (first == ord("v"))) & (second == ord("e"))) | ((first == ord("l")) & (second == ord("l")))
        for some, k in ((quote[one], 2), (quote[two], 3)):
            start[some + 1] = False
            start[some + k] = True                           # the rest of the letters, or what starts there anyway
            after = some + k
            inner = after[after < m]
            start[inner[joined[inner]]] = False
    if special:
        for a, b, _ in special:
            i, j = np.searchsorted(at, [a, b])
            start[i + 1:j] = False
            start[i] = start[j] = True
    begin = np.flatnonzero(start[:m])
    borders = np.append(at[begin], n)
    token = np.full(len(begin), -1, np.int64)
    if special:
        where = np.searchsorted(borders, [a for a, _, _ in special])
        token[where] = [t for _, _, t in special]
    return borders, token


# ------------------------------------------------------------------ exact merges

def merge_words(words: list[bytes], vocab: Vocabulary) -> tuple[np.ndarray, np.ndarray]:
    """Token ids of all words end to end and the number of ids of each: lowest rank first, left to right."""
    lengths = np.fromiter(map(len, words), np.int64, len(words))
    ids = vocab.byte_ids[np.frombuffer(b"".join(words), np.uint8)]
    word = np.repeat(np.arange(len(words)), lengths)
    none = np.int64(1 << 62)
    done_ids, done_words = [], []
    while len(ids):
        pair = np.full(len(ids), none)
        same = word[1:] == word[:-1]
        hit = np.flatnonzero(same)
        pair[hit] = vocab.pairs.get((ids[hit] << 20) | ids[hit + 1], none)
        heads = np.flatnonzero(np.concatenate(([True], ~same)))
        best = np.minimum.reduceat(pair, heads)
        counts = np.diff(np.append(heads, len(ids)))
        best_each = np.repeat(best, counts)
        open_ = best_each < none
        if not open_.all():
            done_ids.append(ids[~open_])
            done_words.append(word[~open_])
            ids, word, pair, best_each = ids[open_], word[open_], pair[open_], best_each[open_]
            if not len(ids):
                break
        take = pair == best_each
        place = np.arange(len(ids))
        run = np.maximum.accumulate(np.where(take & ~np.concatenate(([False], take[:-1])), place, 0))
        take &= ((place - run) & 1) == 0                     # of a a a, the first two merge
        ids = np.where(take, pair & ((1 << 20) - 1), ids)
        keep = np.concatenate(([True], ~take[:-1]))
        ids, word = ids[keep], word[keep]
    flat = np.concatenate(done_ids) if done_ids else np.zeros(0, np.int64)
    owner = np.concatenate(done_words) if done_words else np.zeros(0, np.int64)
    order = np.argsort(owner, kind="stable")
    return flat[order], np.bincount(owner, minlength=len(words))


# ------------------------------------------------------------------ automaton

def minimal_automaton(words: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, int]:
    """Arcs (key = state * 256 + byte, target, output), final states and the start of sorted, distinct words.

    States with equal futures are shared as soon as a later word leaves their branch. An arc's output is the
    number of words before those behind it, so the outputs along a word add up to its place in the list.
    """
    register: dict[tuple, int] = {}
    arcs_of: list[tuple] = []
    final_of: list[bool] = []

    def settle(final: bool, arcs: list) -> int:
        key = (final, tuple(arcs))
        if (known := register.get(key)) is None:
            register[key] = known = len(arcs_of)
            arcs_of.append(key[1])
            final_of.append(final)
        return known

    path: list[list] = [[False, []]]                        # open states of the last word: final, settled arcs
    before = b""
    for word in words:
        shared = len(os.path.commonprefix([before, word]))
        while len(path) - 1 > shared:
            final, arcs = path.pop()
            path[-1][1].append((before[len(path) - 1], settle(final, arcs)))
        path += [[False, []] for _ in range(len(word) - shared)]
        path[-1][0] = True
        before = word
    while len(path) > 1:
        final, arcs = path.pop()
        path[-1][1].append((before[len(path) - 1], settle(final, arcs)))
    start = settle(*path[0])
    below = np.zeros(len(arcs_of), np.int64)
    keys, targets, outputs = [], [], []
    for state, arcs in enumerate(arcs_of):                  # a state's targets are settled before it
        total = int(final_of[state])
        for byte, target in arcs:
            keys.append(state * 256 + byte)
            targets.append(target)
            outputs.append(total)
            total += int(below[target])
        below[state] = total
    return (np.array(keys, np.int64), np.array(targets, np.int64), np.array(outputs, np.int64),
            np.array(final_of, bool), start)


class Lexicon:
    """Memory-mapped automaton with the ids of its words."""

    FILES = ("arc_keys", "arc_values", "outputs", "final", "id_starts", "ids", "meta")

    def __init__(self, folder: str):
        a = {f: np.load(os.path.join(folder, f + ".npy"), mmap_mode="r") for f in self.FILES}
        self.start, probes = (int(x) for x in a["meta"])
        self.arcs = IntTable(a["arc_keys"], a["arc_values"], probes)
        self.outputs, self.final, self.id_starts, self.ids = a["outputs"], a["final"], a["id_starts"], a["ids"]

    @classmethod
    def save(cls, words: list[bytes], vocab: Vocabulary, folder: str) -> None:
        words = sorted(set(words))
        keys, targets, outputs, final, start = minimal_automaton(words)
        table = IntTable.build(keys, (targets << 32) | np.arange(len(keys)))
        ids, counts = merge_words(words, vocab)
        for name, array in zip(cls.FILES, (table.keys, table.values, outputs, final, np.append(0, np.cumsum(counts)), ids.astype(np.int32),
                                           np.array([start, table.probes])), strict=True):
            np.save(os.path.join(folder, name + ".npy"), array)

    def numbers(self, data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
        """Each word's number, or -1 outside the lexicon: all words step through their bytes together."""
        state = np.full(len(starts), self.start, np.int64)
        number = np.zeros(len(starts), np.int64)
        result = np.full(len(starts), -1, np.int64)
        active = np.arange(len(starts))
        place = starts.copy()
        while len(active):
            over = place == ends[active]
            if over.any():
                ended = active[over]
                good = self.final[state[over]]
                result[ended[good]] = number[over][good]
                active, place, state, number = active[~over], place[~over], state[~over], number[~over]
                if not len(active):
                    break
            arc = self.arcs.get((state << 8) | data[place])
            alive = arc >= 0
            if not alive.all():
                active, place, number, arc = active[alive], place[alive], number[alive], arc[alive]
            state = arc >> 32
            number = number + self.outputs[arc & 0xFFFFFFFF]
            place = place + 1
        return result


# ------------------------------------------------------------------ encoding in a worker

class Codec:
    """Encoder and decoder of one vocabulary with one lexicon."""

    def __init__(self, vocab: Vocabulary, lexicon: Lexicon | None):
        self.vocab, self.lexicon = vocab, lexicon
        self.token_lengths = np.fromiter(map(len, vocab.tokens), np.int64, len(vocab.tokens))
        self.token_starts = np.append(0, np.cumsum(self.token_lengths))[:-1]
        self.token_data = np.frombuffer(b"".join(vocab.tokens), np.uint8)

    def encode(self, data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all texts end to end, and where each text's ids start (one more entry than texts)."""
        borders, special = pretokens(data, offsets, self.vocab.added)
        starts, ends = borders[:-1], borders[1:]
        if self.lexicon is not None:
            number = self.lexicon.numbers(data, starts, ends)
            number[special >= 0] = -1
        else:
            number = np.full(len(starts), -1, np.int64)
        known = number >= 0
        count = np.zeros(len(starts), np.int64)
        source = np.zeros(len(starts), np.int64)
        pool = []
        if known.any():
            first = self.lexicon.id_starts[number[known]]
            count[known] = self.lexicon.id_starts[number[known] + 1] - first
            source[known] = first
            pool.append(np.asarray(self.lexicon.ids, np.int64))
        base = len(pool[0]) if pool else 0
        rest = np.flatnonzero(~known & (special < 0))
        if len(rest):
            raw = data.tobytes()
            seen: dict[bytes, int] = {}
            which = np.fromiter((seen.setdefault(raw[a:b], len(seen)) for a, b in zip(starts[rest].tolist(), ends[rest].tolist(), strict=True)), np.int64, len(rest))
            ids, counts = merge_words(list(seen), self.vocab)
            first = np.cumsum(counts) - counts
            source[rest], count[rest] = base + first[which], counts[which]
            pool.append(ids)
            base += len(ids)
        marked = np.flatnonzero(special >= 0)
        if len(marked):
            source[marked], count[marked] = base + np.arange(len(marked)), 1
            pool.append(special[marked])
        flat = np.concatenate(pool)[ragged(source, count)] if pool else np.zeros(0, np.int64)
        ends_of = np.append(0, np.cumsum(count))
        return flat, ends_of[np.searchsorted(starts, offsets)]

    def decode(self, ids: np.ndarray) -> bytes:
        """The bytes behind the ids."""
        return self.token_data[ragged(self.token_starts[ids], self.token_lengths[ids])].tobytes()


_CODECS: dict[tuple[str, str], Codec] = {}


def _codec(vocab_path: str, prefix: str) -> Codec:
    key = (vocab_path, prefix)
    if key not in _CODECS:
        _CODECS.clear()
        with tempfile.TemporaryDirectory(prefix="lexicon-") as folder:     # the mapped files themselves are Spark's
            for f in Lexicon.FILES:
                os.symlink(SparkFiles.get(f"{prefix}{f}.npy"), os.path.join(folder, f + ".npy"))
            _CODECS[key] = Codec(load_vocabulary(vocab_path), Lexicon(folder))
    return _CODECS[key]


# ------------------------------------------------------------------ Spark jobs

def count_pretokens(docs: DataFrame, vocab_path: str, text: str = "text") -> DataFrame:
    """Each pretoken (``word`` binary) with its count ``n`` over all texts."""
    ready(docs)

    def count(batches):
        vocab = load_vocabulary(vocab_path)
        for batch in batches:
            for _, _, data, offsets in text_groups(batch.column(0), COUNT_GROUP_BYTES):
                borders, special = pretokens(data, offsets, vocab.added)
                plain = (special < 0) & (np.diff(borders) <= LEXICON_BYTES)
                starts, ends = borders[:-1][plain], borders[1:][plain]
                _, first, n = np.unique(slice_hashes(data, starts, ends), return_index=True, return_counts=True)
                size = ends[first] - starts[first]
                offs = np.append(0, np.cumsum(size)).astype(np.int32)
                body = data[ragged(starts[first], size)]
                word = pa.BinaryArray.from_buffers(pa.binary(), len(n), [None, pa.py_buffer(offs), pa.py_buffer(body)])
                yield pa.RecordBatch.from_arrays([word, pa.array(n, pa.int64())], ["word", "n"])

    parts = docs.select(F.col(text).cast("string")).mapInArrow(count, "word binary, n long")
    return parts.groupBy("word").agg(F.sum("n").alias("n"))


def frequent_words(docs: DataFrame, vocab_path: str, limit: int = LEXICON_WORDS, text: str = "text") -> list[bytes]:
    """The pretokens at or above the lowest count at which no more than ``limit`` words are left."""
    with stashed(count_pretokens(docs, vocab_path, text), "lexicon-counts") as counts:
        # counts to two binary digits: few classes, whatever the corpus
        step = F.pow(F.lit(2.0), F.greatest(F.floor(F.log2(F.col("n"))) - 2, F.lit(0)))
        classed = counts.withColumn("least", (F.floor(F.col("n") / step) * step).cast("long"))
        total, least = 0, None
        for row in classed.groupBy("least").count().orderBy(F.desc("least")).collect():
            total += row["count"]
            if total > limit:
                break
            least = row["least"]
        if least is None:
            return []
        return [bytes(r[0]) for r in counts.where(F.col("n") >= least).select("word").collect()]


def encode_documents(docs: DataFrame, vocab_path: str, id_col: str = "doc_id", text: str = "text",
                     lexicon_words: int = LEXICON_WORDS) -> DataFrame:
    """``id_col``, ``ids`` (binary: little-endian unsigned 32-bit) and ``decoded`` (the text decoded from the ids)."""
    spark = ready(docs)
    words = frequent_words(docs, vocab_path, lexicon_words, text)
    prefix = f"lexicon-{uuid.uuid4().hex[:12]}-"
    folder = tempfile.mkdtemp(prefix="lexicon-build-")
    atexit.register(shutil.rmtree, folder, ignore_errors=True)             # the driver serves the files to late executors until then
    Lexicon.save(words, load_vocabulary(vocab_path), folder)
    for f in Lexicon.FILES:
        os.rename(os.path.join(folder, f + ".npy"), os.path.join(folder, f"{prefix}{f}.npy"))
        spark.sparkContext.addFile(os.path.join(folder, f"{prefix}{f}.npy"))

    def encode(batches):
        codec = _codec(vocab_path, prefix)
        for batch in batches:
            for lo, hi, data, offsets in text_groups(batch.column(1)):
                ids, first = codec.encode(data, offsets)
                packed = ids.astype("<u4").tobytes()
                back = codec.decode(ids)
                size = np.append(0, np.cumsum(codec.token_lengths[ids]))[first]
                yield pa.RecordBatch.from_arrays([
                    batch.column(0).slice(lo, hi - lo),
                    pa.array([packed[4 * a:4 * b] for a, b in zip(first[:-1], first[1:], strict=True)], pa.binary()),
                    pa.array([back[a:b].decode("utf-8", "replace") for a, b in zip(size[:-1], size[1:], strict=True)], pa.string()),
                ], [id_col, "ids", "decoded"])

    kind = docs.schema[id_col].dataType.simpleString()
    return docs.select(F.col(id_col), F.col(text).cast("string").alias(text)).mapInArrow(encode, f"`{id_col}` {kind}, ids binary, decoded string")


def digests(encoded: DataFrame, id_col: str = "doc_id") -> DataFrame:
    """Token count and SHA-256 of ids and decoded text of ``encode_documents``."""
    return encoded.select(id_col, (F.octet_length("ids") / 4).cast("long").alias("n_tokens"),
                          F.sha2("ids", 256).alias("ids_sha256"),
                          F.sha2(F.col("decoded").cast("binary"), 256).alias("decoded_sha256"))
