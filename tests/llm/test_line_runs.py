"""Operator 1 against a brute-force reading: a line goes if a run of >= 50 characters around it occurs earlier."""

import random

from riskflow.llm import line_runs


def brute(docs, least=50):
    """docs: (id, text) with distinct ids, ids ascending. Kept texts."""
    runs = {}
    for i, text in docs:
        lines = (text or "").split("\n")
        for p in range(len(lines)):
            size = 0
            for q in range(p, len(lines)):
                size += len(lines[q]) + 1
                if size >= least:
                    runs.setdefault(tuple(lines[p:q + 1]), []).append((i, p, q))
                if size >= 4 * least + max(map(len, lines)):
                    break
    gone = set()
    for places in runs.values():
        for i, p, q in sorted(places)[1:]:
            gone |= {(i, x) for x in range(p, q + 1)}
    return {i: None if t is None else "\n".join(x for k, x in enumerate(t.split("\n")) if (i, k) not in gone) for i, t in docs}


def test_against_brute_force(spark, frame, vocabulary):
    rng = random.Random(1)
    lines = [" ".join(rng.choice(vocabulary) for _ in range(rng.randint(0, 9))) for _ in range(40)]
    docs = [(i, "\n".join(rng.choice(lines) for _ in range(rng.randint(0, 9)))) for i in range(120)] + [(500, None), (501, "")]
    got = {r["doc_id"]: r["text"] for r in line_runs.drop_repeated_runs(frame(docs)).collect()}
    assert got == brute(docs)


def test_copies_overlap_and_short_lines(spark, frame):
    long = "a line that is long enough to count as a run by its own length"
    docs = [(1, f"{long}\nx"), (2, f"x\n{long}\nx\ny"), (3, "x"), (4, "\n".join([long] * 3)), (5, f"{long}\nx")]
    got = {r["doc_id"]: (r["text"], r["n_lines"], r["n_dropped"]) for r in line_runs.drop_repeated_runs(frame(docs)).collect()}
    assert got == {1: (f"{long}\nx", 2, 0), 2: ("x\ny", 4, 2), 3: ("x", 1, 0), 4: ("", 3, 3), 5: ("", 2, 2)}


def test_odd_rows(spark, frame, odd_texts):
    docs = [(i, t) for i, t in enumerate(odd_texts)] + [(None, "y" * 60), (None, "y" * 60), (99, "y" * 60)]
    out = line_runs.drop_repeated_runs(frame(docs)).collect()
    assert len(out) == len(docs) and set(out[0].asDict()) >= {"doc_id", "text", "th", "line", "n_dropped"}
    assert [r["text"] for r in out if r["doc_id"] is None] == ["y" * 60] * 2        # equal rows are one document
    assert [r["text"] for r in out if r["doc_id"] == 99] == [""]                    # null ids come first
    assert next(r["text"] for r in out if r["doc_id"] == 0) is None
    assert line_runs.drop_repeated_runs(frame([])).count() == 0


def test_runs_no_python(spark, frame):
    plan = line_runs.drop_repeated_runs(frame([(1, "a")]))._jdf.queryExecution().toString()
    assert "Python" not in plan and "InPandas" not in plan and "InArrow" not in plan
