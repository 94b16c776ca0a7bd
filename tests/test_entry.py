"""Driver contract: entry runs, every query is registered, a sample matches its oracle at sf0.001."""

import duckdb

import __spark_entry__ as E
from scripts.check_oracle import TABLES, digest

SF = "/root/testdata/sf0.001"


def test_entry(spark):
    df = E.entry(spark)
    rows = df.collect()
    assert len(rows) == 1 and set(df.columns) >= {"pr_auc", "roc_auc", "threshold"}


def test_oracle_keys_subset():
    assert set(E.oracle_sql()) <= set(E.queries())
    assert len(E.queries()) >= 60


def test_sample_against_oracle(spark):
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{SF}/{t}.parquet')")
    for name in ["causal_features", "time_split_ties", "category_map", "tune_and_report", "card_profile",
                 "recent_k", "cut_lines", "feature_auc", "score_requests", "alert_enrich"]:
        df = E.queries()[name](spark, SF)
        cur = con.execute(E.oracle_sql()[name])
        ocols = [d[0] for d in cur.description]
        assert sorted(df.columns) == sorted(ocols), name
        assert digest(df.columns, [tuple(r) for r in df.collect()])[0] == digest(ocols, cur.fetchall())[0], name
