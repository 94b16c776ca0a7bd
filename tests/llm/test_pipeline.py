"""Pipeline and registered queries: brute force of every stage on its own input, and the SQL of those that have one."""

import duckdb
import numpy as np
import public_tokenizers
import pytest
from tokenizers import Tokenizer

import __spark_entry__ as entry
import corpus_pipeline
from riskflow.llm.queries import ORACLE, QUERIES
from scripts.check_oracle import digest

from .test_line_runs import brute as lines_brute
from .test_repetition import brute as quality_brute
from .test_simhash_trie import fingerprint
from .test_string_tiling import words

SF = "/root/testdata/sf0.001"


def test_every_operator_is_registered():
    assert {name.split("_")[0] for name in QUERIES} == {f"op{n}" for n in range(1, 14)}
    assert set(QUERIES) | {"pipeline"} <= set(entry.queries())
    assert [name for name, _ in corpus_pipeline.STAGES] == ["quality_rules", "line_dedup", "simhash_near_dedup", "benchmark_decontamination", "bpe_encode"]


@pytest.mark.parametrize("name", sorted(ORACLE))
def test_sql(spark, name):
    con = duckdb.connect()
    for table in ("documents", "pages"):
        con.execute(f"CREATE VIEW {table} AS SELECT * FROM read_parquet('{SF}/{table}.parquet')")
    df, cur = QUERIES[name](spark, SF), con.execute(ORACLE[name])
    cols = [d[0] for d in cur.description]
    assert sorted(df.columns) == sorted(cols)
    assert digest(df.columns, [tuple(r) for r in df.collect()])[0] == digest(cols, cur.fetchall())[0]


def test_stages_against_brute_force(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    library = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    bench = [words(r["text"]) for r in spark.read.parquet(f"{SF}/benchmark.parquet").collect()]
    for name, stage in corpus_pipeline.STAGES:
        before = {r["doc_id"]: r for r in docs.collect()}
        docs = stage(spark, docs, SF)
        after = {r["doc_id"]: r for r in docs.collect()}
        if name != "bpe_encode":
            assert sorted(docs.columns) == sorted(corpus_pipeline.COLUMNS)
        if name == "quality_rules":
            assert after == {i: r for i, r in before.items() if quality_brute(r["text"] or "")[6]}
        elif name == "line_dedup":
            want = lines_brute([(i, before[i]["text"]) for i in sorted(before)])
            assert {i: r["text"] for i, r in after.items()} == {i: t for i, t in want.items() if t or not before[i]["text"]}
            assert all(r["n_chars"] == len(r["text"]) for r in after.values() if r["text"] is not None)
        elif name == "simhash_near_dedup":
            ids = sorted(before)
            prints = np.array([fingerprint(before[i]["text"]) for i in ids], np.uint64)
            label = list(range(len(ids)))
            for _ in ids:
                for k in range(len(ids)):
                    label[k] = min(label[j] for j in np.flatnonzero(np.bitwise_count(prints ^ prints[k]) <= 2))
            assert sorted(after) == [i for k, i in enumerate(ids) if label[k] == k]
        elif name == "benchmark_decontamination":
            def holds(text):
                own = " ".join(words(text))
                return any(len(b) >= 5 and f" {' '.join(b)} " in f" {own} " for b in bench)

            assert not any(holds(r["text"]) for r in after.values())
            assert {i for i, r in before.items() if holds(r["text"])} == set(before) - set(after)
        else:
            assert {i: r["n_tokens"] for i, r in after.items()} == {i: len(library.encode(r["text"] or "", add_special_tokens=False).ids) for i, r in before.items()}


def test_stages_on_an_empty_table(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet").limit(0)
    for _, stage in corpus_pipeline.STAGES:
        docs = stage(spark, docs, SF)
        assert docs.count() == 0
