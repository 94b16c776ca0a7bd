"""Quality rules by repetition coverage (operator 3).

Words are maximal runs without white space (space, 0x09-0x0D). For several lengths n, 64-bit rolling hashes of
all n-word windows of a text are computed column-wise; windows whose hash occurs twice or more mark their words,
and the share of word characters inside marked words is that length's coverage. Lines that equal an earlier line
of the text are compared exactly and give the line coverage. A longer window can only repeat where a shorter one
does, so only those places are sorted again.

Verdict: a text is rejected when it fails the base rules or when a coverage exceeds its limit.

Defined results: null or empty text: no words, all counts 0, coverage 0, base_failed (too few words). Repeated rows
and ties: each row on its own. Empty table: empty result. Memory follows the longest single text. Other columns
are ignored.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import ready
from .textarrays import mix, slice_hashes, text_groups, words

#: window length in words -> largest share of word characters inside repeated windows; the first occurrence
#: counts too, so this is about twice the usual limits for the later occurrences alone
NGRAM_LIMITS = {5: 0.30, 6: 0.30, 8: 0.30, 10: 0.30}
#: largest share of word characters inside lines that equal an earlier line
LINE_LIMIT = 0.20
#: base rules: fewest words, window length and largest percentage of words in repeated windows
MIN_WORDS, BASE_WINDOW, BASE_PERCENT = 50, 3, 50

SYMBOLS = np.zeros(256, bool)
SYMBOLS[[ord(c) for c in "#*$%&|<>"]] = True

_STEP = 0xD6E8FEB86659FD93


def repeated_words(hashes: np.ndarray, doc: np.ndarray, lengths: tuple[int, ...]) -> dict[int, np.ndarray]:
    """For each window length: which words lie in a window found twice or more in their text."""
    n = len(hashes)
    out = {}
    at = np.arange(n)
    rolling = hashes.copy()                                   # of the windows that start at ``at``
    size, step = 1, _STEP
    own = mix(doc.astype(np.uint64) + np.uint64(1))
    for length in sorted(lengths):
        while size < length:
            inside = at + size < n
            at, rolling = at[inside], rolling[inside]
            same = doc[at + size] == doc[at]
            at, rolling = at[same], rolling[same]
            rolling = rolling + hashes[at + size] * np.uint64(step)
            step = step * _STEP % (1 << 64)
            size += 1
        key = mix(rolling) ^ own[at]
        order = np.argsort(key)
        ordered = key[order]
        equal = ordered[1:] == ordered[:-1]
        twice = np.zeros(len(key), bool)
        twice[order[1:][equal]] = True
        twice[order[:-1][equal]] = True
        at, rolling = at[twice], rolling[twice]
        marks = np.zeros(n + 1, np.int64)
        marks[at] = 1
        marks[at + length] -= 1
        out[length] = np.cumsum(marks[:-1]) > 0
    return out


def repeated_lines(raw: bytes, weight_before) -> tuple[int, int]:
    """Lines with a word that equal an earlier line: their number and their word characters."""
    seen: set[bytes] = set()
    count = chars = place = 0
    for line in raw.split(b"\n"):
        if line in seen:
            count += 1
            chars += int(weight_before(place + len(line)) - weight_before(place))
        elif line.strip(b" \t\n\v\f\r"):
            seen.add(line)
        place += len(line) + 1
    return count, chars


def measure(data: np.ndarray, offsets: np.ndarray, lengths: tuple[int, ...]) -> dict[str, np.ndarray]:
    """All counts of the texts ``data[offsets[i]:offsets[i + 1]]``."""
    texts = len(offsets) - 1
    starts, ends = words(data, offsets)
    doc = np.searchsorted(offsets[1:], starts, "right")
    lead = np.append(0, np.cumsum((data & 0xC0) != 0x80))
    chars = lead[ends] - lead[starts]
    before = np.zeros(len(data) + 1, np.int64)                # word characters before a byte
    before[ends] = chars
    before = np.cumsum(before)
    symbols = np.append(0, np.cumsum(SYMBOLS[data]))
    marked = repeated_words(slice_hashes(data, starts, ends), doc, lengths)
    out = {"n_words": np.bincount(doc, minlength=texts), "word_chars": np.bincount(doc, chars, texts).astype(np.int64),
           "n_symbols": symbols[offsets[1:]] - symbols[offsets[:-1]]}
    for n in lengths:
        out[f"words_{n}"] = np.bincount(doc[marked[n]], minlength=texts)
        out[f"chars_{n}"] = np.bincount(doc, chars * marked[n], texts).astype(np.int64)
    raw = data.tobytes()
    lines = [repeated_lines(raw[a:b], lambda x, a=a: before[a + x]) for a, b in zip(offsets[:-1].tolist(), offsets[1:].tolist(), strict=True)]
    out["n_dup_lines"] = np.array([x[0] for x in lines], np.int64)
    out["chars_lines"] = np.array([x[1] for x in lines], np.int64)
    return out


def judged(data: np.ndarray, offsets: np.ndarray, limits: dict[int, float], line_limit: float) -> dict[str, np.ndarray]:
    """Counts, coverages, ``base_failed`` and ``kept`` of all texts."""
    m = measure(data, offsets, tuple(sorted({BASE_WINDOW, *limits})))
    total = np.maximum(m["word_chars"], 1)
    m["n_repeat_words"] = m[f"words_{BASE_WINDOW}"]
    m["cover_lines"] = m["chars_lines"] / total
    over = m["cover_lines"] > line_limit
    for n, most in limits.items():
        m[f"cover_{n}"] = m[f"chars_{n}"] / total
        over |= m[f"cover_{n}"] > most
    m["base_failed"] = (m["n_words"] < MIN_WORDS) | (100 * m["n_repeat_words"] > BASE_PERCENT * m["n_words"])
    m["kept"] = ~(m["base_failed"] | over)
    return m


def quality_rules(docs: DataFrame, id_col: str = "doc_id", text: str = "text", limits: dict[int, float] = NGRAM_LIMITS,
                  line_limit: float = LINE_LIMIT) -> DataFrame:
    """``id_col``, the counts, ``base_failed`` and ``kept``, and the coverages (0 to 1), one row per row of ``docs``."""
    ready(docs)
    counts = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words"]
    covers = [*(f"cover_{n}" for n in limits), "cover_lines"]
    names = [*counts, "base_failed", "kept", *covers]

    def run(batches):
        for batch in batches:
            for lo, hi, data, offsets in text_groups(batch.column(1)):
                m = judged(data, offsets, limits, line_limit)
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(lo, hi - lo), *(pa.array(m[c]) for c in names)], [id_col, *names])

    kind = docs.schema[id_col].dataType.simpleString()
    types = ["long"] * len(counts) + ["boolean"] * 2 + ["double"] * len(covers)
    schema = ", ".join([f"`{id_col}` {kind}", *(f"{c} {t}" for c, t in zip(names, types, strict=True))])
    return docs.select(F.col(id_col), F.col(text).cast("string").alias(text)).mapInArrow(run, schema)


def kept_documents(docs: DataFrame, text: str = "text", limits: dict[int, float] = NGRAM_LIMITS, line_limit: float = LINE_LIMIT) -> DataFrame:
    """The rows of ``docs``, all columns, that the rules keep; decided where a row is read."""
    ready(docs)
    place = docs.columns.index(text)

    def run(batches):
        for batch in batches:
            for lo, hi, data, offsets in text_groups(batch.column(place)):
                yield batch.slice(lo, hi - lo).filter(pa.array(judged(data, offsets, limits, line_limit)["kept"]))

    return docs.mapInArrow(run, docs.schema)
