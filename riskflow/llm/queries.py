"""Registered queries of the ten operators: each runs over its whole table with production parameters."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import remove_path, scratch_path
from ..sources.tables import read_table
from . import bpe_lexicon, collocations, consensus_paths, line_runs, pii_labelers, piece_language, repetition, secret_automaton, simhash_trie, string_tiling, token_alignment, url_trees, warc
from .common import documents, stashed

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE: dict[str, str] = {}


def query(fn: Callable[[SparkSession, str], DataFrame]) -> Callable[[SparkSession, str], DataFrame]:
    QUERIES[fn.__name__] = fn
    return fn


def byte_bpe_path() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


@query
def op1_line_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document without the later repeats of its runs of lines."""
    return line_runs.drop_repeated_runs(documents(spark, sf_dir))


#: Restates the result without fingerprints: a line goes if a shortest window of 50 characters or more, forward or back
#: from some line, covers it and its text is met earlier.
ORACLE["op1_line_runs"] = """
WITH d AS (SELECT doc_id, coalesce(text, '') AS t, text FROM documents),
l AS (SELECT doc_id, unnest(string_split(t, chr(10))) AS s, generate_subscripts(string_split(t, chr(10)), 1) - 1 AS line FROM d),
o AS (SELECT *, sum(length(s) + 1) OVER (PARTITION BY doc_id ORDER BY line) AS e FROM l),
p AS (SELECT *, e - length(s) - 1 AS b FROM o),
w AS (
  SELECT doc_id, min(line) OVER f AS first, max(line) OVER f AS last, string_agg(s, chr(10)) OVER f AS body, max(e) OVER f - min(b) OVER f AS n
  FROM p WINDOW f AS (PARTITION BY doc_id ORDER BY b RANGE BETWEEN CURRENT ROW AND 49 FOLLOWING)
  UNION
  SELECT doc_id, min(line) OVER r, max(line) OVER r, string_agg(s, chr(10)) OVER r, max(e) OVER r - min(b) OVER r
  FROM p WINDOW r AS (PARTITION BY doc_id ORDER BY e RANGE BETWEEN 49 PRECEDING AND CURRENT ROW)),
k AS (SELECT *, row_number() OVER (PARTITION BY body ORDER BY doc_id, first) AS place FROM w WHERE n >= 50),
g AS (SELECT DISTINCT doc_id, unnest(generate_series(first, last)) AS line FROM k WHERE place > 1),
x AS (SELECT l.doc_id, count(*) AS n_lines, count(g.line) AS n_dropped, coalesce(string_agg(l.s, chr(10) ORDER BY l.line) FILTER (g.line IS NULL), '') AS body
      FROM l LEFT JOIN g ON l.doc_id = g.doc_id AND l.line = g.line GROUP BY l.doc_id)
SELECT d.doc_id, CASE WHEN d.text IS NULL THEN NULL ELSE x.body END AS text,
       CASE WHEN d.text IS NULL THEN 0 ELSE x.n_lines END AS n_lines, x.n_dropped
FROM d JOIN x USING (doc_id)
"""


@query
def op2_pii_labelers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Personal data of every whole text: base counts and digest, and all spans."""
    return pii_labelers.digests(pii_labelers.private_spans(documents(spark, sf_dir)))


@query
def op3_repetition(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Base counts, repetition coverages and the verdict for every whole text."""
    return repetition.quality_rules(documents(spark, sf_dir))


def _repetition_sql() -> str:
    """Counts words in windows and lines with window functions; no hashes."""
    lengths = sorted({repetition.BASE_WINDOW, *repetition.NGRAM_LIMITS})
    space = r"[\x20\x09-\x0D]"
    marks = "".join(f"""
g{n} AS (SELECT doc_id, i, string_agg(s, ' ') OVER v AS k, count(*) OVER v AS c
  FROM w WINDOW v AS (PARTITION BY doc_id ORDER BY i ROWS BETWEEN CURRENT ROW AND {n - 1} FOLLOWING)),
m{n} AS (SELECT doc_id, i, max(twice) OVER (PARTITION BY doc_id ORDER BY i ROWS BETWEEN {n - 1} PRECEDING AND CURRENT ROW) AS f FROM (
  SELECT doc_id, i, CASE WHEN c = {n} AND count(*) OVER (PARTITION BY doc_id, k) > 1 THEN 1 ELSE 0 END AS twice FROM g{n})),""" for n in lengths)
    joins = " ".join(f"JOIN m{n} USING (doc_id, i)" for n in lengths)
    covers = ", ".join(f"sum(length(s) * m{n}.f) AS chars_{n}" for n in repetition.NGRAM_LIMITS)
    share = {f"cover_{n}": f"coalesce(a.chars_{n}, 0) / greatest(coalesce(a.word_chars, 0), 1)::DOUBLE" for n in repetition.NGRAM_LIMITS}
    share["cover_lines"] = "coalesce(x.chars_lines, 0) / greatest(coalesce(a.word_chars, 0), 1)::DOUBLE"
    limits = {**{f"cover_{n}": v for n, v in repetition.NGRAM_LIMITS.items()}, "cover_lines": repetition.LINE_LIMIT}
    return f"""
WITH d AS (SELECT doc_id, coalesce(text, '') AS t FROM documents),
u AS (SELECT doc_id, regexp_extract_all(t, '[^\\x20\\x09-\\x0D]+') AS ws FROM d),
w AS (SELECT doc_id, unnest(ws) AS s, generate_subscripts(ws, 1) AS i FROM u),{marks}
a AS (SELECT doc_id, count(*) AS n_words, sum(length(s)) AS word_chars, sum(m{repetition.BASE_WINDOW}.f) AS n_repeat_words, {covers}
  FROM w {joins} GROUP BY doc_id),
l AS (SELECT doc_id, unnest(string_split(t, chr(10))) AS s, generate_subscripts(string_split(t, chr(10)), 1) AS i FROM d),
x AS (SELECT doc_id, count(*) AS n_dup_lines, sum(length(regexp_replace(s, '{space}', '', 'g'))) AS chars_lines
  FROM (SELECT *, row_number() OVER (PARTITION BY doc_id, s ORDER BY i) AS place FROM l WHERE regexp_matches(s, '[^\\x20\\x09-\\x0D]'))
  WHERE place > 1 GROUP BY doc_id),
c AS (SELECT d.doc_id, coalesce(a.n_words, 0) AS n_words, CAST(coalesce(a.word_chars, 0) AS BIGINT) AS word_chars,
  length(d.t) - length(regexp_replace(d.t, '[#*$%&|<>]', '', 'g')) AS n_symbols, coalesce(x.n_dup_lines, 0) AS n_dup_lines,
  CAST(coalesce(a.n_repeat_words, 0) AS BIGINT) AS n_repeat_words, {", ".join(f"{v} AS {k}" for k, v in share.items())}
  FROM d LEFT JOIN a USING (doc_id) LEFT JOIN x USING (doc_id)),
b AS (SELECT *, n_words < {repetition.MIN_WORDS} OR 100 * n_repeat_words > {repetition.BASE_PERCENT} * n_words AS base_failed FROM c)
SELECT *, NOT (base_failed OR {" OR ".join(f"{k} > {v}" for k, v in limits.items())}) AS kept FROM b
"""


ORACLE["op3_repetition"] = _repetition_sql()


#: fixed rules of the url query: verdict, host, path
URL_RULES = [
    ("allow", "org", "/"),
    ("block", "example.org", "/es/"),
    ("block", "example.org", "/en/1"),
    ("allow", "com", "/fr/"),
    ("block", "com", "/de/"),
]


@query
def op4_url_trees(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Host, path, rule and verdict of every page's url."""
    return url_trees.judge(read_table(spark, sf_dir, "pages", ["page_id", "url"]), URL_RULES)


@query
def op5_piece_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Language of every whole text, learnt from the texts that are not held out."""
    import public_tokenizers

    docs = documents(spark, sf_dir, "doc_id", "text", "lang")
    return piece_language.identify(docs, public_tokenizers.path("piece_bpe_32k.model"))


@query
def op6_bpe_lexicon(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every whole text encoded and decoded: token count, SHA-256 of ids and of the decoded text."""
    return bpe_lexicon.digests(bpe_lexicon.encode_documents(documents(spark, sf_dir), byte_bpe_path()))


@query
def op7_string_tiling(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents that hold a benchmark item: pairs of ids with the tiles' coverage and spans."""
    return string_tiling.leaks(documents(spark, sf_dir), read_table(spark, sf_dir, "benchmark", ["item_id", "text"]))


@query
def op8_secret_automaton(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Secrets of every whole text: base counts and digest, and all spans."""
    return secret_automaton.digests(secret_automaton.secret_spans(documents(spark, sf_dir)), secret_automaton.BASE_KINDS)


@query
def op9_simhash_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fingerprint and component of every whole text: 3-word shingles, at most 2 differing bits."""
    found = simhash_trie.near_duplicates(documents(spark, sf_dir), words=3, max_bits=2)
    return found.select("doc_id", simhash_trie.hexed().alias("fingerprint"), "component_id")


@query
def op10_warc_transactions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every page written to WARC archives, read back and assembled into captures."""
    path = scratch_path(spark, "warc")
    try:
        warc.write_warc(read_table(spark, sf_dir, "pages", ["page_id", "url", "html"]), path)
        # headers and digests are read once; the joins go over that table, not over the archives again
        with stashed(warc.read_records(spark, path, with_payload=False), "warc-records") as records:
            return warc.resolved(warc.assemble(records))
    finally:
        remove_path(spark, path)


ORACLE["op10_warc_transactions"] = """
WITH p AS (SELECT page_id, octet_length(encode(coalesce(html, ''))) AS payload_bytes, sha256(coalesce(html, '')) AS payload_digest FROM pages),
f AS (SELECT payload_digest, min(page_id) AS first FROM p WHERE payload_bytes >= 100 GROUP BY payload_digest)
SELECT p.page_id, p.payload_bytes, p.payload_digest,
       CASE WHEN f.first IS NOT NULL AND p.page_id IS DISTINCT FROM f.first THEN 'revisit' ELSE 'response' END AS record_type,
       CASE WHEN f.first IS NOT NULL AND p.page_id IS DISTINCT FROM f.first THEN f.first END AS refers_to
FROM p LEFT JOIN f USING (payload_digest)
"""


@query
def op13_token_alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every whole text's tokens by both vocabularies, cut into groups; links counted over all documents."""
    import public_tokenizers

    return token_alignment.align_corpus(documents(spark, sf_dir), byte_bpe_path(), public_tokenizers.path("piece_bpe_32k.model"), digest=True)


@query
def op12_collocations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The 2,000 strongest phrases of two and three words of each language."""
    return collocations.collocations(documents(spark, sf_dir, "lang", "text"))


#: Restates the contract with arrays and window functions; wide integers for the products.
ORACLE["op12_collocations"] = r"""
WITH d AS (SELECT row_number() OVER () AS id, coalesce(lang, 'und') AS lang,
                  translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS t FROM documents),
p AS (SELECT id, lang, unnest(regexp_split_to_array(t, '[.,;:!?\x0A-\x0D]')) AS piece, generate_subscripts(regexp_split_to_array(t, '[.,;:!?\x0A-\x0D]'), 1) AS no FROM d),
q AS (SELECT id, lang, no, regexp_extract_all(piece, '[^\x20\x09]+') AS ws FROM p),
w AS (SELECT id, lang, no, unnest(ws) AS w1, generate_subscripts(ws, 1) AS i FROM q),
s AS (SELECT lang, w1, lead(w1, 1) OVER o AS w2, lead(w1, 2) OVER o AS w3 FROM w WINDOW o AS (PARTITION BY id, no ORDER BY i)),
f1 AS (SELECT lang, w1, count(*) AS f FROM s GROUP BY lang, w1),
f2 AS (SELECT lang, w1, w2, count(*) AS f FROM s WHERE w2 IS NOT NULL GROUP BY lang, w1, w2),
f3 AS (SELECT lang, w1, w2, w3, count(*) AS f FROM s WHERE w3 IS NOT NULL GROUP BY lang, w1, w2, w3 HAVING count(*) >= 10),
n AS (SELECT lang, CAST(sum(f) AS BIGINT) AS n FROM f1 GROUP BY lang),
c AS (
  SELECT b.lang, b.w1 || ' ' || b.w2 AS phrase, b.f AS a, 1 AS k, x.f AS l, y.f AS r
  FROM f2 b JOIN f1 x ON x.lang = b.lang AND x.w1 = b.w1 JOIN f1 y ON y.lang = b.lang AND y.w1 = b.w2
  WHERE b.f >= 10 AND NOT EXISTS (SELECT 1 FROM f3 t WHERE t.lang = b.lang AND t.w1 = b.w1 AND t.w2 = b.w2 AND 100 * t.f >= 50 * b.f)
    AND NOT EXISTS (SELECT 1 FROM f3 t WHERE t.lang = b.lang AND t.w2 = b.w1 AND t.w3 = b.w2 AND 100 * t.f >= 50 * b.f)
  UNION ALL
  SELECT t.lang, t.w1 || ' ' || t.w2 || ' ' || t.w3, t.f, 1, x.f, y.f
  FROM f3 t JOIN f1 x ON x.lang = t.lang AND x.w1 = t.w1 JOIN f2 y ON y.lang = t.lang AND y.w1 = t.w2 AND y.w2 = t.w3
  UNION ALL
  SELECT t.lang, t.w1 || ' ' || t.w2 || ' ' || t.w3, t.f, 2, x.f, y.f
  FROM f3 t JOIN f2 x ON x.lang = t.lang AND x.w1 = t.w1 AND x.w2 = t.w2 JOIN f1 y ON y.lang = t.lang AND y.w1 = t.w3),
g AS (SELECT *, CAST(1000000::HUGEINT * a * a // (l::HUGEINT * r) AS BIGINT) AS score FROM c),
m AS (SELECT *, row_number() OVER (PARTITION BY lang, phrase ORDER BY score, k) AS cut FROM g),
z AS (SELECT lang, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, encode(phrase)) AS rank, phrase, a, l, r, score FROM m WHERE cut = 1)
SELECT z.lang, rank, phrase, a, l, r, n, score FROM z JOIN n USING (lang) WHERE rank <= 2000
"""


@query
def op11_consensus_paths(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The main text of every page, read by the winning paths of its host."""
    found = consensus_paths.extract(read_table(spark, sf_dir, "pages", ["page_id", "url", "html"]))
    return found.withColumn("n_chars", F.length("text").cast("long"))
