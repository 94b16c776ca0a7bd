"""Operator 10: exact round trip through archives, and assembly through every kind of link."""

import hashlib

import pytest

from riskflow.llm import warc as W
from riskflow.session import scratch_path

BIG = "é" * 100 + "WARC/1.1\r\n\r\nContent-Length: 5\r\n\r\n\n\r"
PAGES = [(1, "http://a/x", BIG), (2, "http://a/y", BIG), (3, None, None), (4, "", "short"), (5, "u\r\nX: y", "short"), (None, "http://b", BIG), (1, "http://a/x", BIG),
         (7, "http://c?q", "x" * 100), (8, "http://c", "x" * 99), (9, "http://c", "x" * 99), (10, "z", "x" * 100), (11, "http://long", "line\n" * 60_000), (12, "http://e", "")]


@pytest.fixture(scope="module")
def archive(spark):
    path = scratch_path(spark, "warc-test")
    pages = spark.createDataFrame([(*p, "clash", "clash") for p in PAGES], "page_id long, url string, html string, digest string, row string").repartition(3)
    W.write_warc(pages, path)
    return path


def test_round_trip(spark, archive):
    captures = W.assemble(W.read_records(spark, archive)).collect()
    assert len(captures) == len(PAGES)
    assert all(c["request"]["type"] == "request" and c["metadata"]["type"] == "metadata" for c in captures)
    got = sorted((c["metadata"]["fields"], bytes(c["main"]["payload"])) for c in captures if c["main"]["type"] == "response")
    want = [(p, h) for p, _, h in PAGES if not (p in (2, 10) or (p is None))]
    assert got == sorted((f"page-id: {p}\r\n", (h or "").encode()) for p, h in want)


def test_query_result(spark, archive):
    out = W.resolved(W.assemble(W.read_records(spark, archive, with_payload=False))).collect()
    first = {}
    for p, _, h in PAGES:
        if p is not None and len((h or "").encode()) >= 100:
            first[h] = min(p, first.get(h, p))
    want = []
    for p, _, h in PAGES:
        body = (h or "").encode()
        again = h in first and first[h] != p
        want.append((p, len(body), hashlib.sha256(body).hexdigest(), "revisit" if again else "response", first[h] if again else None))
    assert sorted(map(str, map(tuple, out))) == sorted(map(str, want))


def test_empty_table(spark):
    path = scratch_path(spark, "warc-empty")
    W.write_warc(spark.createDataFrame([], "page_id long, url string, html string"), path)
    assert W.resolved(W.assemble(W.read_records(spark, path))).count() == 0


def test_links_in_any_direction(spark):
    def record(i, kind, to):
        return (i, kind, to, None, None, None, None, None, None)

    rows = [record("m1", "response", []), record("q1", "request", ["m1"]), record("d1", "metadata", ["m1"]),
            record("m2", "response", ["q2", "d2"]), record("q2", "request", []), record("d2", "metadata", []),
            record("m3", "revisit", []), record("q3", "request", ["m3"]), record("d3", "metadata", ["q3"]),
            record("m4", "resource", []), record("lost", "request", ["gone"]), record("q5", "request", [])]
    out = W.assemble(spark.createDataFrame(rows, W.RECORD_SCHEMA).repartition(3)).collect()
    got = {c["main"]["record_id"]: tuple(c[k] and c[k]["record_id"] for k in ("request", "metadata")) for c in out if c["main"]}
    assert got == {"m1": ("q1", "d1"), "m2": ("q2", "d2"), "m3": ("q3", "d3"), "m4": (None, None)}
    assert sorted(x["record_id"] for c in out if not c["main"] for x in c["others"]) == ["lost", "q5"]


def test_no_record_is_lost(spark):
    """Two requests, several metadata records, other types, repeated main records, records without a capture, shared links."""
    import random

    def record(i, kind, to):
        return (i, kind, to, f"u{i}", None, None, None, None, None)

    rows = [record("m1", "response", []), record("q1", "request", ["m1"]), record("q0", "request", ["m1"]), record("d1", "metadata", ["q1"]), record("d0", "metadata", ["m1"]),
            record("c1", "conversion", ["m1"]), record("m1", "response", []), record("w", "warcinfo", []), record("m2", "revisit", ["q0"]), record("d9", "metadata", ["none"])]
    rng = random.Random(2)
    for i in range(60):
        rows.append(record(f"x{i}", rng.choice(["response", "request", "metadata", "conversion", "resource", None]), [f"x{rng.randrange(80)}" for _ in range(rng.randrange(3))]))
    out = W.assemble(spark.createDataFrame(rows, W.RECORD_SCHEMA).repartition(4)).collect()
    found = [x["record_id"] for c in out for x in [c["main"], c["request"], c["metadata"], *c["others"]] if x]
    assert sorted(found) == sorted(r[0] for r in rows)
    one = next(c for c in out if c["main"] and c["main"]["record_id"] == "m1")
    assert (one["request"]["record_id"], one["metadata"]["record_id"]) == ("q0", "d0")
    assert [x["record_id"] for x in one["others"]] == ["m1", "q1", "d1", "c1"]
    alone = [c for c in out if not c["main"]]
    assert {"w", "d9"} <= {c["others"][0]["record_id"] for c in alone} and all(len(c["others"]) == 1 and not c["request"] and not c["metadata"] for c in alone)


def test_damaged_payload_is_an_error():
    record = b"WARC/1.1\r\nWARC-Type: response\r\nContent-Length: 3\r\n\r\nabc\r\n\r\n"
    assert [b for _, b in W.parse_records(record * 2)] == [b"abc", b"abc"]
    with pytest.raises(ValueError, match="no record"):
        list(W.parse_records(b"junk" + record))
