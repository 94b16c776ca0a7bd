"""Operator 2: base spans against Python's re, estimated reliabilities, and what the classifier adds."""

import hashlib
import random
import re

from riskflow.llm import pii_labelers as P


def luhn(digits):
    doubled = [int(c) * (1 + i % 2) for i, c in enumerate(reversed(digits))]
    return sum(x - 9 if x > 9 else x for x in doubled) % 10 == 0


def brute(text):
    out = [(m.start(), 0, m.end()) for m in re.finditer(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", text)]
    out += [(m.start(), 1, m.end()) for m in re.finditer(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", text) if all(int(x) <= 255 for x in m.group().split("."))]
    for m in re.finditer(r"[0-9]([\x20-]?[0-9])+", text):
        digits = re.sub("[^0-9]", "", m.group())
        if 14 <= len(digits) <= 19 and luhn(digits):
            out.append((m.start(), 2, m.end()))
    out += [(m.start(), 3, m.end()) for m in re.finditer(r"\+[0-9][\x20().0-9-]+[0-9]", text) if 10 <= len(re.sub("[^0-9]", "", m.group())) <= 15]
    return sorted(out)


def check(spark, frame, docs):
    got = P.digests(P.private_spans(frame(docs))).collect()
    assert len(got) == len(docs)
    want = {}
    for i, text in docs:
        spans = brute(text or "")
        joined = ",".join(f"{P.BASE_KINDS[k]}:{a}:{b}" for a, k, b in spans)
        want[i] = (*(sum(k == x for _, x, _ in spans) for k in range(4)), hashlib.sha256(joined.encode()).hexdigest(), joined)
    for r in got:
        base = ",".join(s for s in r["spans"].split(",") if s.split(":")[0] in P.BASE_KINDS)
        assert (r["n_email"], r["n_ip"], r["n_card"], r["n_phone"], r["base_sha256"], base) == want[r["doc_id"]], r["doc_id"]
    return {r["doc_id"]: r["spans"] for r in got}


PARTS = ["a", "b@c", "@", ".", "a.b", "x@y.z", "1.2.3.4", "255.255.255.255", "256.1.1.1", "000255.0.0.1", ".5", "4111111111111111", "4111 1111 1111 1111",
         "4", "5 ", " ", "-", "+1 (386) 555-3733", "+49 30 1234567", "+", "(", "é", "\n", "😀", "%"]


def test_base_spans(spark, frame):
    rng = random.Random(2)
    docs = [(i, "".join(rng.choice(PARTS) for _ in range(rng.randint(0, 14)))) for i in range(1500)]
    check(spark, frame, docs)


def test_odd_rows(spark, frame, odd_texts):
    docs = [(i, t) for i, t in enumerate(odd_texts)]
    docs += [(100, "7" * 60_000), (101, "a" * 100_000 + "@"), (102, "1.2.3.4 " * 3000), (103, "+1" + " " * 50_000)]
    check(spark, frame, docs)
    assert P.private_spans(frame([])).count() == 0
    assert P.digests(P.private_spans(frame([(None, "x@y.zz")]))).first()["n_email"] == 1


def test_added_kinds_are_learnt(spark, frame):
    docs = [(i, f"write to jo{i}@mail.example.com or call +1 (386) 555-{3000 + i} from host 10.1.2.{i % 200}") for i in range(60)]
    docs += [(100 + i, f"please call 386 555 {3000 + i} now, account DE89 3704 0044 0532 0130 00, thanks") for i in range(40)]
    docs += [(200, "nothing at all")]
    spans = check(spark, frame, docs)
    assert all("local_phone:12:24" in spans[100 + i] and "iban:" in spans[100 + i] for i in range(40))
    assert spans[200] == ""


def test_added_spans_that_meet_base_ones_go(spark):
    """Against all pairs, over random spans of both kinds, and in a text of 60,000 spans."""
    rng = random.Random(5)
    rows = []
    for i in range(80):
        spans = [(s, rng.randrange(8), s + rng.randint(1, 9)) for s in (rng.randrange(120) for _ in range(rng.randint(1, 25)))]
        base, added = [(*x, True) for x in spans if x[1] < 4], [(*x, False) for x in spans if x[1] >= 4]
        rows.append((i, i if i % 9 else None, base, added))
    rows.append((80, 80, [(10 * k, 0, 10 * k + 5, True) for k in range(30_000)], [(10 * k + 3, 6, 10 * k + (4 if k % 2 else 9), False) for k in range(15_000)] + [(10 * k + 5, 6, 10 * k + 10, False) for k in range(15_000)]))
    span = "array<struct<start:int,kind:int,end:int,base:boolean>>"
    got = P._without_overlaps(spark.createDataFrame(rows, f"__row long, doc_id int, base {span}, added {span}").repartition(3), "doc_id").collect()
    want = {}
    for i, doc, base, added in rows:
        kept = added if i == 80 else [c for c in added if not any(b[0] < c[2] and c[0] < b[2] for b in base)]
        want[i] = (doc, sorted(base + (kept if i < 80 else [c for c in kept if c[0] % 10 == 5])))
    assert sorted(((r["doc_id"], [tuple(x) for x in r["found"]]) for r in got), key=str) == sorted((w for w in want.values() if w[1]), key=str)


def test_estimate_finds_the_unreliable_labeler():
    patterns = [(0, (P.YES, P.YES, 0, 0, P.YES, 0), 60), (0, (P.NO, P.NO, 0, 0, P.YES, 0), 30), (0, (P.YES, P.YES, 0, 0, P.NO, 0), 30), (0, (P.NO, P.NO, 0, 0, P.NO, 0), 30)]
    prior, table = P.estimate(patterns)
    right = [table[j][1][P.YES] - table[j][0][P.YES] for j in (0, 1, 4)]
    assert min(right[:2]) > 0.8 > right[2]
    assert 0.4 < prior[0] < 0.8
