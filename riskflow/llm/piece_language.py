"""Language identification by segmentation-marginalised unigrams (operator 5).

Each language has a probability for every piece of a fixed public vocabulary. A word's probability is the sum over
all its segmentations into pieces, by a forward pass; a text's score is the sum over its words. Distinct words of a
group of texts walk the vocabulary's trie together, position by position. The probabilities are fitted by
expectation-maximisation (forward-backward over all segmentations) on a bounded sample of labelled texts: about
``TRAIN_DOCS`` for each language, taken by hash. The expected counts are summed by Spark; the driver holds one
number for each piece and language.

Words are maximal runs of letters, lower-cased, of any length. Those of over ``MAX_LETTERS`` letters are walked on their own, in
logarithms and in blocks of letters that hand on the sums of what reaches into the next block; the sums are the same.

Defined results: null or empty text, or no letter: ``und`` with score 0. Null language: not learnt from. Null doc_id:
not held out, not learnt from. Equal scores: the alphabetically first language. No labelled text: all ``und``.
Repeated rows: each row on its own. Empty table: empty result. Long texts are scored whole. Other columns are ignored.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .bpe_lexicon import LETTER, classes
from .common import ready
from .textarrays import IntTable, ragged, slice_hashes, text_groups

#: texts learnt from for each language, about
TRAIN_DOCS = 2_000
#: rounds of expectation-maximisation, and the count added to every piece
ROUNDS, ADDED = 3, 0.05
#: letters of the words that walk together; longer ones are walked on their own, ``BLOCK_LETTERS`` starts at a time
MAX_LETTERS = 64
BLOCK_LETTERS = 1 << 14
GROUP_BYTES = 3 << 20
#: distinct words that walk the trie together
WALK_WORDS = 8_192
#: factor for each letter that keeps products of piece probabilities near one
SCALE = 24.0
UNKNOWN = "und"
_MARK = 0x2581                                               # the vocabulary's sign for the start of a word


class Pieces:
    """Trie over the letters of all pieces; ``piece[node]`` is a piece's number or -1."""

    def __init__(self, pieces: list[str]):
        children: dict[int, int] = {}
        self.piece = [-1]
        self.sizes = []
        for text in pieces:
            node = 0
            for c in text:
                key = node << 21 | ord(c)
                if key not in children:
                    children[key] = len(self.piece)
                    self.piece.append(-1)
                node = children[key]
            if self.piece[node] < 0:
                self.piece[node] = len(self.sizes)
                self.sizes.append(len(text))
        self.arcs = IntTable.build(np.array(list(children), np.int64), np.array(list(children.values()), np.int64))
        self.piece = np.array(self.piece)
        self.sizes = np.array([*self.sizes, 1])             # the last one: a letter outside the vocabulary

    @classmethod
    def load(cls, model_file: str) -> Pieces:
        """Pieces of letters, with or without the sign for a word's start, of a sentencepiece model."""
        import sentencepiece

        model = sentencepiece.SentencePieceProcessor(model_file=model_file)
        texts = (model.id_to_piece(i) for i in range(model.get_piece_size()) if not (model.is_control(i) or model.is_unknown(i) or model.is_byte(i)))
        return cls(sorted({t for t in texts if t and (t.lstrip("▁") or t).isalpha() or t == "▁"}))

    def walk(self, letters: np.ndarray, lengths: np.ndarray):
        """All arcs ``(start, end, rows, piece)`` of words (rows of ``letters``), by ascending start."""
        for i in range(letters.shape[1]):
            rows = np.flatnonzero(lengths > i)
            if not len(rows):
                return
            node, j, alone = np.zeros(len(rows), np.int64), i, np.zeros(len(lengths), bool)
            alone[rows] = True
            while len(rows):
                node = self.arcs.get(node << 21 | letters[rows, j])
                live = node >= 0
                rows, node = rows[live], node[live]
                piece = self.piece[node]
                found = piece >= 0
                if found.any():
                    if j == i:
                        alone[rows[found]] = False
                    yield i, j + 1, rows[found], piece[found]
                j += 1
                more = lengths[rows] > j
                rows, node = rows[more], node[more]
            rest = np.flatnonzero(alone)
            if len(rest):
                yield i, i + 1, rest, np.full(len(rest), len(self.sizes) - 1)

    def forward(self, letters: np.ndarray, lengths: np.ndarray, p: np.ndarray, keep: list | None = None) -> np.ndarray:
        """Scaled probabilities of all beginnings: ``[word, letters read, language]``."""
        out = np.zeros((len(lengths), letters.shape[1] + 1, p.shape[1]))
        out[:, 0] = 1.0
        for arc in self.walk(letters, lengths):
            i, j, rows, piece = arc
            out[rows, j] += out[rows, i] * p[piece]
            if keep is not None:
                keep.append(arc)
        return out

    def block_arcs(self, letters: np.ndarray, lo: int, hi: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Arcs of one word that start at ``lo .. hi - 1``: ends and pieces in the order of their starts, and where each start's begin."""
        starts, ends, pieces = [], [], []
        rows, node, depth = np.arange(lo, hi), np.zeros(hi - lo, np.int64), 0
        alone = np.ones(hi - lo, bool)
        while len(rows):
            node = self.arcs.get(node << 21 | letters[rows + depth])
            rows, node = rows[node >= 0], node[node >= 0]
            depth += 1
            found = self.piece[node] >= 0
            starts.append(rows[found])
            ends.append(rows[found] + depth)
            pieces.append(self.piece[node[found]])
            if depth == 1:
                alone[rows[found] - lo] = False
            more = rows + depth < len(letters)
            rows, node = rows[more], node[more]
        rest = np.flatnonzero(alone) + lo
        start = np.concatenate([*starts, rest])
        order = np.argsort(start, kind="stable")
        end = np.concatenate([*ends, rest + 1])[order]
        piece = np.concatenate([*pieces, np.full(len(rest), len(self.sizes) - 1)])[order]
        return end, piece, np.searchsorted(start[order], np.arange(lo, hi + 1))

    def unscaled_logs(self, scaled: np.ndarray) -> np.ndarray:
        return np.log(np.maximum(scaled, 1e-300)) - self.sizes[:, None] * np.log(SCALE)

    def long_forward(self, letters: np.ndarray, logs: np.ndarray, kept: np.ndarray | None = None) -> np.ndarray:
        """Logarithm of a long word's probability; ``kept`` gets those of all its beginnings."""
        reach = int(self.sizes.max()) + 1
        sums = np.full((BLOCK_LETTERS + reach, logs.shape[1]), -np.inf)
        sums[0] = 0.0
        for lo in range(0, len(letters), BLOCK_LETTERS):
            hi = min(lo + BLOCK_LETTERS, len(letters))
            end, piece, first = self.block_arcs(letters, lo, hi)
            end = end - lo
            for i in range(hi - lo):
                a, b = first[i], first[i + 1]
                at = end[a:b]
                sums[at] = np.logaddexp(sums[at], sums[i] + logs[piece[a:b]])
            if kept is not None:
                kept[lo:hi] = sums[:hi - lo]
            left = sums[hi - lo:hi - lo + reach].copy()          # what reaches into the next block
            sums[:] = -np.inf
            sums[:len(left)] = left
        return sums[0]

    def add_long_counts(self, letters: np.ndarray, logs: np.ndarray, weight: np.ndarray, total: np.ndarray) -> None:
        """Adds a long word's expected uses of each piece and language to ``total``."""
        before = np.zeros((len(letters), logs.shape[1]))
        whole = self.long_forward(letters, logs, before)
        after = np.full((len(letters) + 1, logs.shape[1]), -np.inf)
        after[-1] = 0.0
        for lo in reversed(range(0, len(letters), BLOCK_LETTERS)):
            hi = min(lo + BLOCK_LETTERS, len(letters))
            end, piece, first = self.block_arcs(letters, lo, hi)
            for i in reversed(range(hi - lo)):
                a, b = first[i], first[i + 1]
                tail = logs[piece[a:b]] + after[end[a:b]]
                after[lo + i] = np.logaddexp.reduce(tail, axis=0)
                total[piece[a:b]] += weight * np.exp(before[lo + i] + tail - whole)

    def scaled(self, p: np.ndarray) -> np.ndarray:
        return p * SCALE ** self.sizes[:, None]

    def log_probabilities(self, letters: np.ndarray, lengths: np.ndarray, p: np.ndarray) -> np.ndarray:
        done = self.forward(letters, lengths, p)[np.arange(len(lengths)), lengths]
        return np.log(np.maximum(done, 1e-300)) - lengths[:, None] * np.log(SCALE)

    def expected_counts(self, letters: np.ndarray, lengths: np.ndarray, p: np.ndarray, weight: np.ndarray) -> np.ndarray:
        """Expected uses of each piece and language; ``weight[word, language]`` is how often the word occurs."""
        arcs: list = []
        before = self.forward(letters, lengths, p, arcs)
        at = np.arange(len(lengths))
        share = weight / np.maximum(before[at, lengths], 1e-300)
        after = np.zeros_like(before)
        after[at, lengths] = 1.0
        used, uses = [], []
        for i, j, rows, piece in reversed(arcs):
            tail = p[piece] * after[rows, j]
            after[rows, i] += tail
            used.append(piece)
            uses.append(before[rows, i] * tail * share[rows])
        used, uses = np.concatenate(used), np.concatenate(uses)
        return np.column_stack([np.bincount(used, uses[:, g], len(self.sizes)) for g in range(p.shape[1])])


_LOWER: np.ndarray | None = None


def lower() -> np.ndarray:
    """Lower case of each code point, where that is one code point."""
    global _LOWER
    if _LOWER is None:
        table = np.arange(0x110000)
        for c in range(0x1F000):
            if not 0xD800 <= c < 0xE000 and len(low := chr(c).lower()) == 1:
                table[c] = ord(low)
        _LOWER = table.astype(np.int32)
    return _LOWER


def letter_words(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Lower-cased code points of the texts, starts and lengths of their words in them, and each word's text."""
    points = np.frombuffer(data.tobytes().decode("utf-8").encode("utf-32-le"), np.uint32)
    at = np.append(np.flatnonzero((data & 0xC0) != 0x80), len(data))
    border = np.searchsorted(at, offsets)
    inside = classes()[points] == LETTER
    cut = np.zeros(len(points) + 1, bool)
    cut[border] = True
    begins = inside & (cut[:-1] | np.append(True, ~inside[:-1])[:len(points)])
    starts = np.flatnonzero(begins)
    ends = np.flatnonzero(inside & (cut[1:] | np.append(~inside[1:], True)[:len(points)])) + 1
    lengths = ends - starts
    return lower()[points], starts, lengths, np.searchsorted(border[1:], starts, "right")


def distinct(points: np.ndarray, starts: np.ndarray, lengths: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For each word the number of its distinct word, and for each of these a place where it occurs."""
    codes, unique = pd.factorize(slice_hashes(points, starts, starts + lengths))
    place = np.empty(len(unique), np.int64)
    place[codes[::-1]] = np.arange(len(codes))[::-1]
    return codes, place


def matrices(points: np.ndarray, starts: np.ndarray, lengths: np.ndarray):
    """Yield ``(which, letters, lengths)`` of words of similar length, the sign for a word's start before each; no long words."""
    order = np.argsort(lengths, kind="stable")
    order = order[:int((lengths <= MAX_LETTERS).sum())]
    for lo in range(0, len(order), WALK_WORDS):
        which = order[lo:lo + WALK_WORDS]
        n = lengths[which]
        letters = np.zeros((len(which), int(n.max()) + 1), np.int64)
        letters[:, 0] = _MARK
        row = np.repeat(np.arange(len(which)), n)
        letters[row, 1 + ragged(np.zeros(len(n), np.int64), n)] = points[ragged(starts[which], n)]
        yield which, letters, n + 1


def long_words(points: np.ndarray, starts: np.ndarray, lengths: np.ndarray):
    """Yield ``(which, letters)`` of the words that ``matrices`` leaves out, the sign for a word's start before each."""
    for k in np.flatnonzero(lengths > MAX_LETTERS).tolist():
        yield k, np.append(_MARK, points[starts[k]:starts[k] + lengths[k]]).astype(np.int64)


# ------------------------------------------------------------------ Spark jobs

def _held_out(id_col: str):
    return F.coalesce(F.crc32(F.col(id_col).cast("string")) % 4 == 2, F.lit(False))


def training_words(docs: DataFrame, id_col: str, text: str, lang: str, train_docs: int) -> tuple[DataFrame | None, list[str]]:
    """Counts ``(lang, word, n)`` over about ``train_docs`` texts of each language, and the languages."""
    able = docs.where(F.col(lang).isNotNull() & F.col(id_col).isNotNull() & ~_held_out(id_col) & F.col(text).isNotNull())
    sizes = {r[0]: r[1] for r in able.groupBy(lang).count().collect()}
    if not sizes:
        return None, []
    share = F.create_map(*[x for k, n in sorted(sizes.items()) for x in (F.lit(k), F.lit(min(1.0, train_docs / n)))])
    taken = able.where(F.pmod(F.xxhash64(id_col, F.lit("train")), F.lit(1_000_000)) < share[F.col(lang)] * 1_000_000)

    def count(batches):
        for batch in batches:
            names = np.array(batch.column(0).to_pylist(), dtype=object)
            for lo, hi, data, offsets in text_groups(batch.column(1), GROUP_BYTES):
                points, starts, lengths, doc = letter_words(data, offsets)
                if not len(starts):
                    continue
                codes, place = distinct(points, starts, lengths)
                label, values = pd.factorize(names[lo:hi][doc])
                pair, n = np.unique(codes * len(values) + label, return_counts=True)
                word = ["".join(map(chr, points[starts[k]:starts[k] + lengths[k]])) for k in place.tolist()]
                yield pa.RecordBatch.from_arrays([pa.array([values[i] for i in pair % len(values)], pa.string()),
                                                  pa.array([word[i] for i in pair // len(values)], pa.string()), pa.array(n)], ["lang", "word", "n"])

    counted = taken.select(F.col(lang).cast("string"), F.col(text).cast("string")).mapInArrow(count, "lang string, word string, n long")
    return counted.groupBy("lang", "word").agg(F.sum("n").alias("n")), sorted(map(str, sizes))


def fit(docs: DataFrame, pieces: Pieces, id_col: str = "doc_id", text: str = "text", lang: str = "lang",
        train_docs: int = TRAIN_DOCS, rounds: int = ROUNDS) -> tuple[np.ndarray, list[str]]:
    """Piece probabilities ``[piece, language]`` and the languages."""
    spark = ready(docs)
    words, langs = training_words(docs, id_col, text, lang, train_docs)
    if not langs:
        return np.zeros((len(pieces.sizes), 0)), []
    words = words.checkpoint()
    number = {name: g for g, name in enumerate(langs)}
    shared = spark.sparkContext.broadcast(pieces)
    p = np.full((len(pieces.sizes), len(langs)), 1.0 / len(pieces.sizes))
    for _ in range(rounds):
        now = p

        def expect(batches, now=now):
            own, total = shared.value, np.zeros_like(now)
            scaled = own.scaled(now)
            for batch in batches:
                if not batch.num_rows:
                    continue
                text = batch.column(1).to_pylist()
                lengths = np.fromiter(map(len, text), np.int64, len(text))
                points = np.frombuffer("".join(text).encode("utf-32-le"), np.uint32).astype(np.int64)
                weight = np.zeros((len(text), len(langs)))
                weight[np.arange(len(text)), [number[x] for x in batch.column(0).to_pylist()]] = np.asarray(batch.column(2))
                for which, letters, n in matrices(points, np.cumsum(lengths) - lengths, lengths):
                    total += own.expected_counts(letters, n, scaled, weight[which])
                for k, letters in long_words(points, np.cumsum(lengths) - lengths, lengths):
                    own.add_long_counts(letters, own.unscaled_logs(scaled), weight[k], total)
            piece, g = np.nonzero(total)
            yield pa.RecordBatch.from_arrays([pa.array(piece, pa.int32()), pa.array(g, pa.int32()), pa.array(total[piece, g])], ["piece", "g", "n"])

        counts = np.zeros_like(p)
        for r in words.mapInArrow(expect, "piece int, g int, n double").groupBy("piece", "g").agg(F.sum("n").alias("n")).toLocalIterator():
            counts[r["piece"], r["g"]] = r["n"]
        counts += ADDED
        p = counts / counts.sum(axis=0)
    return p, langs


def predict(docs: DataFrame, pieces: Pieces, p: np.ndarray, langs: list[str], id_col: str = "doc_id", text: str = "text") -> DataFrame:
    """``id_col``, ``lang_pred`` and ``score``, the prediction's share among the languages."""
    spark = ready(docs)
    shared = spark.sparkContext.broadcast((pieces, pieces.scaled(p)))
    names = np.array([*langs, UNKNOWN], dtype=object)

    def run(batches):
        own, scaled = shared.value
        for batch in batches:
            for lo, hi, data, offsets in text_groups(batch.column(1), GROUP_BYTES):
                total = np.zeros((hi - lo, len(langs)))
                points, starts, lengths, doc = letter_words(data, offsets)
                if len(starts) and langs:
                    codes, place = distinct(points, starts, lengths)
                    logs = np.zeros((len(place), len(langs)))
                    for which, letters, n in matrices(points, starts[place], lengths[place]):
                        logs[which] = own.log_probabilities(letters, n, scaled)
                    for k, letters in long_words(points, starts[place], lengths[place]):
                        logs[k] = own.long_forward(letters, own.unscaled_logs(scaled))
                    for g in range(len(langs)):
                        total[:, g] = np.bincount(doc, logs[codes, g], hi - lo)
                some = np.bincount(doc, minlength=hi - lo) > 0
                if not langs:
                    some &= False
                best = np.where(some, total.argmax(axis=1) if langs else 0, len(langs))
                share = 1.0 / np.exp(np.minimum(total - total.max(axis=1, keepdims=True), 0)).sum(axis=1) if langs else np.zeros(hi - lo)
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(lo, hi - lo), pa.array(names[best].tolist(), pa.string()),
                                                  pa.array(np.where(some, share, 0.0))], [id_col, "lang_pred", "score"])

    kind = docs.schema[id_col].dataType.simpleString()
    return docs.select(F.col(id_col), F.col(text).cast("string").alias(text)).mapInArrow(run, f"`{id_col}` {kind}, lang_pred string, score double")


def identify(docs: DataFrame, model_file: str, id_col: str = "doc_id", text: str = "text", lang: str = "lang",
             train_docs: int = TRAIN_DOCS) -> DataFrame:
    """Fits on the rows that are not held out and predicts all: ``id_col``, ``held_out``, ``lang_pred``, ``score``."""
    pieces = Pieces.load(model_file)
    p, langs = fit(docs, pieces, id_col, text, lang, train_docs)
    return predict(docs, pieces, p, langs, id_col, text).select(id_col, _held_out(id_col).alias("held_out"), "lang_pred", "score")
