"""Operator 13: alignment of two tokenizers' tokens over a corpus, with an identity-map fast path.

Each text is encoded by A (byte-level BPE, over a space and the text) and by B (pieces with byte fallback, over the text).
Byte offsets where tokens of both end cut them into groups; every pair of tokens whose byte ranges overlap is a link.

* The array ``same`` gives for each A id the B id with the same bytes. A group of one A and one B token is nearly always such
  an identity: these are counted in vectors as long as A's vocabulary, one per task, and looked up in a table no longer.
* Other links are irregular; only they enter the pair aggregation. Each task counts its pairs before they are shuffled, so
  a pair that a third of all texts hold is one row per task.
* A pair's count is the number of texts that hold it. Texts are encoded once: each text's distinct pairs are written next to
  its counts, exploded where they are read, and looked up (irregular pairs are joined: sent to every task below a counted
  size, by a shuffle above it). What a text adds up is a partial sum before it is shuffled.

Defined results: a null or empty text, and one whose tokens' bytes differ from the space and the text (a text with U+2581), has
no tokens: zeros and an empty string. Strings of special tokens are plain text. Rows may repeat, ids may be null: each
row is a document. An empty table gives no rows. Other columns of the input are not read.
"""

from __future__ import annotations

import json
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import remove_path, scratch_path
from .common import ready
from .textarrays import GROUP_BYTES

#: irregular pairs that are sent to every task, at most (24 bytes each); more are joined by a shuffle
BROADCAST_PAIRS = 2_000_000
#: distinct pairs that a task holds before it passes their counts on
HELD_PAIRS = 1 << 20
#: a run of this many characters of one class goes through the library whose merging is not quadratic
LONG_RUN = 500
_LONG = re.compile(rf"\S{{{LONG_RUN}}}|\s{{{LONG_RUN}}}")
#: fixed value: pre-token pattern of the byte-level vocabulary
BYTE_PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
_BYTE_PIECE = re.compile(r"<0x([0-9A-F]{2})>")


def byte_letters() -> dict[str, int]:
    """The letter that stands for each byte in a byte-level vocabulary: printable bytes stand for themselves."""
    plain = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    other = [b for b in range(256) if b not in set(plain)]
    return {**{chr(b): b for b in plain}, **{chr(256 + i): b for i, b in enumerate(other)}}


class TokenizerA:
    """Byte-level BPE. ``table[i]`` has the bytes of id i."""

    def __init__(self, path: str):
        import tiktoken
        from tokenizers import Tokenizer

        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        vocab, letters = spec["model"]["vocab"], byte_letters()
        self.table = [b""] * (max([*vocab.values(), *(t["id"] for t in spec["added_tokens"])]) + 1)
        special = {t["content"] for t in spec["added_tokens"]}
        for piece, i in vocab.items():
            self.table[i] = piece.encode() if piece in special else bytes(letters[c] for c in piece)
        self.exact = Tokenizer.from_file(path)
        self.exact.no_truncation()
        self.exact.no_padding()
        self.exact.encode_special_tokens = True
        merges = [m.split(" ") if isinstance(m, str) else m for m in spec["model"]["merges"]]
        made = [vocab[a + b] for a, b in merges]
        ranked = made == sorted(made) and {self.table[i] for i in vocab.values() if len(self.table[i]) == 1} == {bytes([b]) for b in range(256)}
        pre = json.dumps(spec.get("pre_tokenizer"))
        plain = spec.get("normalizer") is None and '"ByteLevel"' in pre and '"Split"' not in pre and '"add_prefix_space": true' not in pre
        ranks = {self.table[i]: i for p, i in vocab.items() if p not in special}
        # ids in the order of their merges are ranks: the same merges by a faster library
        self.fast = tiktoken.Encoding("a", pat_str=BYTE_PATTERN, mergeable_ranks=ranks, special_tokens={}) if ranked and plain else None

    def encode(self, text: str) -> list[int]:
        if self.fast is None or _LONG.search(text):
            return self.exact.encode(text, add_special_tokens=False).ids
        return self.fast.encode_ordinary(text)


class TokenizerB:
    """Pieces with byte fallback. ``table[i]`` has the bytes of id i; U+2581 stands for a space."""

    def __init__(self, path: str):
        import sentencepiece

        self.model = sentencepiece.SentencePieceProcessor(model_file=path)
        pieces = [self.model.id_to_piece(i) for i in range(self.model.get_piece_size())]
        found = [_BYTE_PIECE.fullmatch(p) for p in pieces]
        self.is_byte = np.array([m is not None for m in found])
        self.table = [bytes([int(m[1], 16)]) if m else p.replace("▁", " ").encode() for p, m in zip(pieces, found, strict=True)]

    def encode(self, texts: list[str]) -> list[list[int]]:
        return self.model.encode(texts, num_threads=1)


def digits(n: int, marks: str) -> pa.Array:
    """The decimal numbers below ``n`` followed by each of ``marks``: number i with mark k lies at ``i + k * n``."""
    return pa.array([f"{i}{m}" for m in marks for i in range(n)], pa.string())


class Aligner:
    """Both tokenizers, and the identity map between their ids."""

    def __init__(self, a_path: str, b_path: str):
        self.a, self.b = TokenizerA(a_path), TokenizerB(b_path)
        by_bytes: dict[bytes, int] = {}
        for i in sorted(range(len(self.b.table)), key=lambda i: (self.b.is_byte[i], i)):    # a piece before a byte
            by_bytes.setdefault(self.b.table[i], i)
        self.same = np.array([by_bytes.get(x, -1) for x in self.a.table], np.int64)
        self.a_len = np.array([len(x) for x in self.a.table], np.int64)
        self.b_len = np.array([len(x) for x in self.b.table], np.int64)
        self.names = pa.concat_arrays([digits(len(self.a_len), ",|"), digits(len(self.b_len), ",;")])

    def tokens(self, texts: list[str | None]) -> tuple[list[list[int]], list[list[int]]]:
        """Ids of A and B for each text; none where the bytes differ."""
        some = [i for i, t in enumerate(texts) if t]
        found_b = self.b.encode([texts[i] for i in some])
        a_ids: list[list[int]] = [[] for _ in texts]
        b_ids: list[list[int]] = [[] for _ in texts]
        a_table, b_table = self.a.table, self.b.table
        for i, b in zip(some, found_b, strict=True):
            text = " " + texts[i]
            want = text.encode()
            if b"".join(map(b_table.__getitem__, b)) != want:
                continue
            a = self.a.encode(text)
            if b"".join(map(a_table.__getitem__, a)) == want:
                a_ids[i], b_ids[i] = a, b
        return a_ids, b_ids

    def align(self, texts: list[str | None]) -> pa.RecordBatch:
        """One row per text: ``ALIGNED`` without the id."""
        a_lists, b_lists = self.tokens(texts)
        n = len(texts)
        n_a, n_b = (np.fromiter(map(len, x), np.int64, n) for x in (a_lists, b_lists))
        a, b = (np.fromiter((i for x in lists for i in x), np.int64, int(k.sum())) for lists, k in ((a_lists, n_a), (b_lists, n_b)))
        a_end, b_end = np.cumsum(self.a_len[a]), np.cumsum(self.b_len[b])       # byte offsets over all texts
        size = int(a_end[-1]) if len(a_end) else 0
        in_a, in_b = np.zeros(size + 1, bool), np.zeros(size + 1, bool)
        in_a[a_end], in_b[b_end] = True, True
        both = in_a & in_b
        a_doc, b_doc = np.repeat(np.arange(n), n_a), np.repeat(np.arange(n), n_b)
        a_last, b_last = both[a_end], both[b_end]
        n_groups = np.bincount(a_doc[a_last], minlength=n)

        # every byte range between two neighbouring ends lies in one token of each side: one link
        cut = np.flatnonzero(in_a | in_b)
        ia, ib = (np.cumsum(x)[cut] - x[cut] for x in (in_a, in_b))
        link_a, link_b, link_doc = a[ia], b[ib], a_doc[ia]
        n_links = np.bincount(link_doc, minlength=n)
        key, occ = np.unique((link_doc << 40) | (link_a << 20) | link_b, return_counts=True)
        d, x, y = key >> 40, (key >> 20) & 0xFFFFF, key & 0xFFFFF
        identity = self.same[x] == y

        return pa.RecordBatch.from_arrays([
            pa.array(n_a), pa.array(n_b), pa.array(n_groups), pa.array(n_links),
            self.group_texts(a, b, a_last, b_last, n_a, n_b),
            rows_of(d[identity], n, {"a": x[identity], "n": occ[identity]}),
            rows_of(d[~identity], n, {"a": x[~identity], "b": y[~identity], "n": occ[~identity]}),
        ], ["n_a", "n_b", "n_groups", "n_links", "groups", "same", "pairs"])

    def group_texts(self, a: np.ndarray, b: np.ndarray, a_last: np.ndarray, b_last: np.ndarray, n_a: np.ndarray, n_b: np.ndarray) -> pa.Array:
        """``a1,a2|b1;a3|b2,b3`` for each text: A and B tokens of all groups in turn, with the marks that follow them."""
        a_group, b_group = (np.cumsum(x) - x for x in (a_last, b_last))
        groups = int(a_last.sum())
        before_b = np.append(0, np.cumsum(np.bincount(b_group, minlength=groups)))[:groups + 1]
        upto_a = np.cumsum(np.bincount(a_group, minlength=groups))
        code = np.empty(len(a) + len(b), np.int32)
        code[np.arange(len(a)) + before_b[a_group]] = a + len(self.a_len) * a_last
        code[np.arange(len(b)) + upto_a[b_group]] = 2 * len(self.a_len) + b + len(self.b_len) * b_last
        joined = self.names.take(pa.array(code))
        _, offsets, data = joined.buffers()
        ends = np.frombuffer(offsets, np.int32)[:len(code) + 1][np.append(0, np.cumsum(n_a + n_b))]
        data = data.to_pybytes() if data is not None else b""
        return pa.array([data[s:max(s, e - 1)].decode() for s, e in zip(ends[:-1].tolist(), ends[1:].tolist(), strict=True)], pa.string())


def rows_of(doc: np.ndarray, n: int, columns: dict[str, np.ndarray]) -> pa.ListArray:
    """For each of ``n`` texts the list of its structs; ``doc`` is sorted."""
    offsets = np.append(0, np.cumsum(np.bincount(doc, minlength=n))).astype(np.int32)
    fields = pa.StructArray.from_arrays([pa.array(v, pa.int32()) for v in columns.values()], list(columns))
    return pa.ListArray.from_arrays(pa.array(offsets), fields)


ALIGNED = "n_a long, n_b long, n_groups long, n_links long, groups string, same array<struct<a:int,n:int>>, pairs array<struct<a:int,b:int,n:int>>"

_ALIGNERS: dict[tuple[str, str], Aligner] = {}


def aligner(a_path: str, b_path: str) -> Aligner:
    """The worker's aligner of two vocabularies."""
    if (a_path, b_path) not in _ALIGNERS:
        _ALIGNERS[a_path, b_path] = Aligner(a_path, b_path)
    return _ALIGNERS[a_path, b_path]


def text_slices(column: pa.Array, most: int = GROUP_BYTES) -> Iterator[tuple[int, list[str | None]]]:
    """The column's texts, about ``most`` bytes (or one text) at a time, with the number of their first row."""
    size = np.cumsum([0, *(x or 0 for x in pc.binary_length(column).to_pylist())])
    lo = 0
    while lo < len(column):
        hi = max(lo + 1, int(np.searchsorted(size, size[lo] + most, "right")) - 1)
        yield lo, column.slice(lo, hi - lo).to_pylist()
        lo = hi


def aligned(docs: DataFrame, a_path: str, b_path: str, id_col: str = "doc_id", text: str = "text") -> DataFrame:
    """``id_col`` and ``ALIGNED``: counts, the groups as text, and the distinct links with their occurrences in the text.

    ``same`` has the links between tokens of equal bytes (B's id follows from A's), ``pairs`` the others.
    """
    ready(docs)

    def run(batches):
        own = aligner(a_path, b_path)
        for batch in batches:
            for lo, texts in text_slices(batch.column(1)):
                out = own.align(texts)
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(lo, len(texts)), *out.columns], [id_col, *out.schema.names])

    kind = docs.schema[id_col].dataType.simpleString()
    return docs.select(F.col(id_col), F.col(text).cast("string").alias(text)).mapInArrow(run, f"`{id_col}` {kind}, {ALIGNED}")


def pair_counts(links: DataFrame, a_path: str, b_path: str) -> DataFrame:
    """``a, b, n_docs, best, identity`` for every linked pair of ids: how many rows of ``links`` hold it.

    ``best`` marks the pairs with the highest count of their A id, ties included.
    """
    def run(batches):
        own = aligner(a_path, b_path)
        vector = np.zeros(len(own.same), np.int64)
        held: list[tuple[np.ndarray, np.ndarray]] = []
        size = 0

        def merged():
            key = np.concatenate([k for k, _ in held])
            key, where = np.unique(key, return_inverse=True)
            return key, np.bincount(where, np.concatenate([n for _, n in held]), len(key)).astype(np.int64)

        def rows(key, n):
            return pa.RecordBatch.from_arrays([pa.array(key >> 20, pa.int32()), pa.array(key & 0xFFFFF, pa.int32()), pa.array(n)], ["a", "b", "n"])

        for batch in batches:
            vector += np.bincount(batch.column(0).flatten().field("a").to_numpy(), minlength=len(vector))
            pairs = batch.column(1).flatten()
            key = (pairs.field("a").to_numpy().astype(np.int64) << 20) | pairs.field("b").to_numpy()
            held.append(np.unique(key, return_counts=True))
            size += len(held[-1][0])
            if size > HELD_PAIRS:
                held = [merged()]
                size = len(held[0][0])
                if size > HELD_PAIRS // 2:
                    yield rows(*held[0])
                    held, size = [], 0
        if held:
            yield rows(*merged())
        a = np.flatnonzero(vector)
        yield rows((a << 20) | own.same[a], vector[a])

    same = aligner(a_path, b_path).same
    n = links.select("same", "pairs").mapInArrow(run, "a int, b int, n long").groupBy("a", "b").agg(F.sum("n").alias("n_docs"))
    n = n.checkpoint()
    # one row for each id of A's vocabulary at most
    top = F.broadcast(n.groupBy("a").agg(F.max("n_docs").alias("most")))
    known = F.broadcast(links.sparkSession.createDataFrame(
        pa.table({"a": pa.array(np.flatnonzero(same >= 0), pa.int32()), "b": pa.array(same[same >= 0], pa.int32()), "identity": pa.array(np.ones((same >= 0).sum(), bool))})))
    return n.join(top, "a").join(known, ["a", "b"], "left").select(
        "a", "b", "n_docs", (F.col("n_docs") == F.col("most")).alias("best"), F.coalesce("identity", F.lit(False)).alias("identity"))


def link_sums(links: DataFrame, counts: DataFrame, row: str, broadcast_pairs: int = BROADCAST_PAIRS) -> DataFrame:
    """``row, n_best, count_sum``: for each row of ``links`` that has any, its links that are their A id's best, and all their counts added."""
    counts = counts.checkpoint()
    identity = F.broadcast(counts.where("identity").select("a", "n_docs", "best"))        # at most A's vocabulary
    other = counts.where("not identity").select("a", "b", "n_docs", "best")
    other = F.broadcast(other) if other.count() <= broadcast_pairs else other
    sums = [F.sum(F.when(F.col("best"), F.col("n")).otherwise(0)).alias("n_best"), F.sum(F.col("n") * F.col("n_docs")).alias("count_sum")]
    easy = links.select(row, F.inline("same")).join(identity, "a").groupBy(row).agg(*sums)
    hard = links.select(row, F.inline("pairs")).join(other, ["a", "b"]).groupBy(row).agg(*sums)
    return easy.unionByName(hard).groupBy(row).agg(F.sum("n_best").alias("n_best"), F.sum("count_sum").alias("count_sum"))


def align_corpus(docs: DataFrame, a_path: str, b_path: str, id_col: str = "doc_id", text: str = "text",
                 digest: bool = False, broadcast_pairs: int = BROADCAST_PAIRS) -> DataFrame:
    """``id_col, n_a, n_b, n_groups, n_links, n_best, count_sum`` and the groups of every row of ``docs``.

    The groups are the column ``groups``, or with ``digest`` only their SHA-256 in ``groups_sha256`` ('' without tokens).
    """
    spark = ready(docs)
    shown = F.when(F.col("n_a") > 0, F.sha2("groups", 256)).otherwise("").alias("groups_sha256") if digest else F.col("groups")
    path = scratch_path(spark, "alignment")
    found = aligned(docs.select(F.col(id_col).alias("_id"), F.col(text).alias("_text")), a_path, b_path, "_id", "_text")
    (found.select("_id", "n_a", "n_b", "n_groups", "n_links", shown, "same", "pairs", F.monotonically_increasing_id().alias("_row"))
     .write.option("compression", "zstd").parquet(path))
    links = spark.read.parquet(path)
    sums = link_sums(links, pair_counts(links, a_path, b_path), "_row", broadcast_pairs)
    name = "groups_sha256" if digest else "groups"
    out = links.select("_row", "_id", "n_a", "n_b", "n_groups", "n_links", name).join(sums, "_row", "left").select(
        F.col("_id").alias(id_col), "n_a", "n_b", "n_groups", "n_links", F.coalesce("n_best", F.lit(0).cast("long")).alias("n_best"),
        F.coalesce("count_sum", F.lit(0).cast("long")).alias("count_sum"), name)
    out = out.checkpoint()
    remove_path(spark, path)
    return out
