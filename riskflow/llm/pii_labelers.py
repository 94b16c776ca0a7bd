"""Personal data by weak supervision (operator 2), in DataFrame operations only.

Candidate spans of every kind come from regular expressions. Labelers vote on each candidate (yes, no or nothing):
its shape, a checksum or range, a gazetteer, cue words before it, the characters around it, and words that speak
against it. Expectation-maximisation over the counts of equal vote patterns (a table bounded by kinds and votes, not
by the data) estimates how reliable each labeler is and how often each kind is real. The resulting posteriors train
a logistic span classifier on other features (kind, length, neighbours, cue), again from bounded counts. Candidates of
the added kinds are kept where the classifier says so and no base span overlaps; base spans always stay.

Matches are leftmost and non-overlapping for each kind. Possessive repeats and look-behinds only spare the search
what cannot match; they do not change what is found. Spans are code points, end exclusive.

Defined results: null or empty text: no spans. Repeated rows: each row on its own. Ties: equal starts are ordered by kind
as listed. No candidates at all: the starting reliabilities. Empty table: empty result. Very long texts: positions
are sums over blocks of matches, so the work follows the text's length. Other columns are ignored.
"""

from __future__ import annotations

import math
from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import ready

BASE_KINDS = ("email", "ip", "card", "phone")

#: fixed patterns of the base kinds, then of the kinds this method adds
PATTERNS = {
    "email": r"(?:\G|(?<![A-Za-z0-9._%+-]))[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
    "ip": r"(?:\G|(?<![0-9]))[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++",
    "card": r"[0-9](?:[\x20-]?[0-9])++",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
    "ssn": r"(?<![0-9A-Za-z-])[0-9]{3}-[0-9]{2}-[0-9]{4}(?![0-9A-Za-z-])",
    "iban": r"(?<![A-Za-z0-9])[A-Z]{2}[0-9]{2}(?: ?[A-Z0-9]{4}){3,7}(?: ?[A-Z0-9]{1,3})?(?![A-Za-z0-9])",
    "local_phone": r"(?<![0-9A-Za-z+(.-])\(?[0-9]{3}\)?[ .-][0-9]{3}[ .-][0-9]{4}(?![0-9A-Za-z-])",
    "person": r"(?<![A-Za-z])(?:Mr|Mrs|Ms|Dr|Prof)\.? [A-Z][a-z]{1,30}(?: [A-Z][a-z]{1,30}){0,2}",
}
KINDS = tuple(PATTERNS)

#: fixed gazetteers
TOP_LEVEL = "com org net edu gov mil int info biz io de fr es it uk us ca au nl be ch at pl se no fi dk pt ie jp cn in br mx ru eu".split()
CALLING_CODES = "1 7 20 27 30 31 32 33 34 36 39 40 41 43 44 45 46 47 48 49 51 52 54 55 56 57 60 61 62 63 64 65 66 81 82 84 86 90 91 92 351 352 353 358 420 421 971 972".split()
IBAN_COUNTRIES = "AD AT BE BG CH CY CZ DE DK EE ES FI FR GB GR HR HU IE IS IT LI LT LU LV MC MT NL NO PL PT RO SE SI SK SM TR".split()
GIVEN_NAMES = "Anna Carlos Claire David Elena Emma Francois Hans Jack James Jean John Jose Juan Julia Karl Laura Lucia Maria Marie Mary Michael Paul Peter Pierre Robert Sarah Sofia Thomas William".split()
#: fixed cue words, by kind, looked for shortly before a candidate
CUES = {
    "email": "mail|contact|write to|reach",
    "ip": r"\bip\b|host|server|address|login",
    "card": "card|visa|credit|payment|account",
    "phone": r"\btel|phone|call|mobile|fax",
    "ssn": r"\bssn\b|social security",
    "iban": r"\biban\b|account|bank",
    "local_phone": r"\btel|phone|call|mobile|fax",
    "person": "name|dear|signed|contact",
}
#: fixed words and signs before a number that speak against it
AGAINST = r"(?i)(?:\bv|\bver\.?|version|isbn|\bno\.?|build|#|\$|%)\s*$"
LABELERS = ("shape", "check", "gazetteer", "cue", "edge", "against")
NOTHING, YES, NO = 0, 1, 2

#: characters of context before a candidate; matches summed at a time
CONTEXT, BLOCK = 24, 256
#: rounds of expectation-maximisation; steps and rate of the classifier's descent
EM_ROUNDS, STEPS, RATE = 25, 400, 0.5


# ------------------------------------------------------------------ small pieces

def let(fields: dict[str, Column], body: Callable[[Column], Column]) -> Column:
    """``body`` over a struct of ``fields``, each evaluated once."""
    return F.element_at(F.transform(F.array(F.struct(*(c.alias(k) for k, c in fields.items()))), body), 1)


def _sums(a: Column) -> Column:
    """0, then the running sums of an array of long."""
    return F.aggregate(a, F.array(F.lit(0).cast("long")), lambda acc, v: F.array_append(acc, F.element_at(acc, -1) + v))


def running(a: Column) -> Column:
    """For each entry the sum of those before it; by blocks, so long arrays stay cheap."""
    def joined(s: Column) -> Column:
        return F.flatten(F.transform(s["blocks"], lambda x, i: F.transform(F.slice(_sums(x), 1, F.size(x)), lambda y: y + F.element_at(s["before"], i + 1))))

    def blocked(s: Column) -> Column:
        blocks = F.transform(F.sequence(F.lit(0), F.greatest(F.ceil(F.size(s["a"]) / BLOCK).cast("int") - 1, F.lit(0))), lambda b: F.slice(s["a"], b * BLOCK + 1, BLOCK))
        return let({"blocks": blocks}, lambda t: let({"blocks": t["blocks"], "before": _sums(F.transform(t["blocks"], lambda x: F.aggregate(x, F.lit(0).cast("long"), lambda p, q: p + q)))}, joined))

    return let({"a": a}, blocked)


MATCH = "array<struct<start:bigint,end:bigint,match:string,before:string,after:string>>"


def matches(text: Column, pattern: str) -> Column:
    """All matches with places and context: the pieces between them give the places."""
    def placed(s: Column) -> Column:
        n = F.size(s["m"])
        sizes = F.zip_with(F.slice(s["g"], 1, n), s["m"], lambda g, m: (F.length(g) + F.length(m)).cast("long"))
        ahead = F.zip_with(F.slice(s["g"], 1, n), running(sizes), lambda g, r: F.struct(g.alias("g"), (r + F.length(g)).alias("start")))
        behind = F.zip_with(s["m"], F.slice(s["g"], 2, n), lambda m, g: F.struct(m.alias("m"), F.left(g, F.lit(1)).alias("after")))
        return F.zip_with(ahead, behind, lambda a, b: F.struct(a["start"].alias("start"), (a["start"] + F.length(b["m"])).alias("end"), b["m"].alias("match"),
                                                               F.right(a["g"], F.lit(CONTEXT)).alias("before"), b["after"].alias("after")))

    found = let({"m": F.regexp_extract_all(text, F.lit(pattern), F.lit(0)), "g": F.split(text, pattern)}, placed)
    return F.when(text.rlike(pattern), found).otherwise(F.array().cast(MATCH))


def _digits(c: Column) -> Column:
    return F.regexp_replace(c, "[^0-9]", "")


def luhn(digits: Column) -> Column:
    """Whether a string of digits passes the Luhn sum."""
    def total(s: Column) -> Column:
        doubled = F.transform(F.sequence(F.lit(1), F.length(s["r"])), lambda i: F.when(i % 2 == 1, s["r"].substr(i, F.lit(1)).cast("int"))
                              .otherwise((2 * s["r"].substr(i, F.lit(1)).cast("int")) % 10 + F.floor(s["r"].substr(i, F.lit(1)).cast("int") / 5).cast("int")))
        return F.aggregate(doubled, F.lit(0), lambda a, b: a + b) % 10 == 0

    return let({"r": F.reverse(digits)}, total)


def mod_97(iban: Column) -> Column:
    """Whether an IBAN leaves 1 on division by 97, letters counting from 10."""
    def total(s: Column) -> Column:
        def step(acc: Column, i: Column) -> Column:
            code = F.ascii(s["t"].substr(i, F.lit(1)))
            return F.when(code < 58, (acc * 10 + code - 48) % 97).otherwise((acc * 100 + code - 55) % 97)

        return F.aggregate(F.sequence(F.lit(1), F.length(s["t"])), F.lit(0), step) == 1

    plain = F.regexp_replace(iban, " ", "")
    return let({"t": F.concat(F.substr(plain, F.lit(5)), F.left(plain, F.lit(4)))}, total)


def small_parts(match: Column) -> Column:
    """Whether all parts between dots are 255 or less."""
    return F.forall(F.split(match, r"\."), lambda p: (F.length(F.ltrim(p, F.lit("0"))) <= 3) & (F.coalesce(F.right(p, F.lit(3)).try_cast("int"), F.lit(0)) <= 255))


def _base_ok(kind: str, match: Column) -> Column:
    n = F.length(_digits(match))
    if kind == "ip":
        return small_parts(match)
    if kind == "card":
        return F.when(n.between(14, 19), luhn(_digits(match))).otherwise(False)
    if kind == "phone":
        return n.between(10, 15)
    return F.lit(kind == "email")


# ------------------------------------------------------------------ labelers

def _vote(yes: Column, otherwise: int = NO) -> Column:
    return F.when(yes, YES).otherwise(otherwise)


def _votes(kind: str, c: Column) -> dict[str, Column]:
    """Each labeler's vote on a candidate ``c``."""
    match, none = c["match"], F.lit(NOTHING)
    shape = {"email": r"^[A-Za-z0-9][A-Za-z0-9._%+-]*@[A-Za-z0-9.-]+\.[A-Za-z]{2,}$", "ip": r"^[1-9][0-9]{0,2}(?:\.[0-9]{1,3}){3}$",
             "card": r"^(?:[0-9]{4}[ -]?){3}[0-9]{1,7}$", "phone": r"^\+[0-9]{1,3}[ ().-]", "iban": r"^[A-Z]{2}[0-9]{2}(?: ?[A-Z0-9]{4})+(?: ?[A-Z0-9]{1,3})?$",
             "local_phone": r"^\(?[2-9]", "person": r"^(?:Mr|Mrs|Ms|Dr|Prof)\.? [A-Z][a-z]+"}
    votes = {"shape": _vote(match.rlike(shape[kind])) if kind in shape else _vote(~match.rlike("^(?:000|666|9)|-00-|-0000$")),
             "check": _vote(mod_97(match)) if kind == "iban" else _vote(_base_ok(kind, match)) if kind in BASE_KINDS and kind != "email" else none,
             "gazetteer": none,
             "cue": _vote(c["before"].rlike(f"(?i)(?:{CUES[kind]})"), NOTHING),
             "edge": _vote(~c["before"].rlike("[A-Za-z0-9]$") & ~c["after"].rlike("^[A-Za-z0-9]")),
             "against": F.when(c["before"].rlike(AGAINST), NO).otherwise(NOTHING)}
    if kind == "email":
        votes["gazetteer"] = _vote(F.lower(F.substring_index(match, ".", -1)).isin(TOP_LEVEL))
    elif kind == "ip":
        votes["gazetteer"] = _vote(~match.rlike(r"^(?:0+|22[4-9]|2[3-9][0-9])\."))
    elif kind == "card":
        votes["gazetteer"] = _vote(match.rlike("^[3-6]"))
    elif kind == "phone":
        votes["gazetteer"] = _vote(match.rlike(rf"^\+(?:{'|'.join(CALLING_CODES)})[^0-9]") | match.rlike(rf"^\+(?:{'|'.join(CALLING_CODES)})[0-9]{{7}}"))
    elif kind == "iban":
        votes["gazetteer"] = _vote(F.left(match, F.lit(2)).isin(IBAN_COUNTRIES))
    elif kind == "person":
        votes["gazetteer"] = _vote(match.rlike(rf" (?:{'|'.join(GIVEN_NAMES)})\b"), NOTHING)
    return votes


def _neighbour(c: Column) -> Column:
    return F.when(c == "", 0).when(c.rlike(r"^\s$"), 1).when(c.rlike("^[A-Za-z0-9]$"), 2).otherwise(3)


FEATURES = {"kind": len(KINDS), "size": 8, "left": 4, "right": 4, "hint": 2}


def candidates(docs: DataFrame, id_col: str, text: str) -> DataFrame:
    """``id_col`` and ``found``: all candidates of all kinds with votes and features, by start, then kind as listed."""
    own = F.coalesce(F.col(text).cast("string"), F.lit(""))
    arrays = []
    for k, kind in enumerate(KINDS):
        def described(c: Column, k: int = k, kind: str = kind) -> Column:
            votes = _votes(kind, c)
            return F.struct(c["start"].alias("start"), F.lit(k).alias("kind"), c["end"].alias("end"), _base_ok(kind, c["match"]).alias("base"),
                            *(votes[v].alias(v) for v in LABELERS), F.least(F.floor((c["end"] - c["start"]) / 4).cast("int"), F.lit(7)).alias("size"),
                            _neighbour(F.right(c["before"], F.lit(1))).alias("left"), _neighbour(c["after"]).alias("right"), votes["cue"].alias("hint"))

        arrays.append(F.transform(matches(F.col("__text"), PATTERNS[kind]), _unary(described)))
    rows = docs.select(F.col(id_col), own.alias("__text"))
    return rows.select(id_col, F.array_sort(F.concat(*arrays)).alias("found"))


def _unary(fn: Callable[[Column], Column]) -> Callable[[Column], Column]:
    return lambda c: fn(c)


# ------------------------------------------------------------------ reliabilities and classifier (bounded counts on the driver)

def estimate(patterns: list[tuple[int, tuple[int, ...], int]], rounds: int = EM_ROUNDS) -> tuple[list[float], list[list[list[float]]]]:
    """Expectation-maximisation over ``(kind, votes, count)``: the share of real spans by kind, and each labeler's
    probability of nothing / yes / no for unreal and for real spans."""
    prior = [0.5] * len(KINDS)
    table = [[[0.4, 0.15, 0.45], [0.25, 0.65, 0.1]] for _ in LABELERS]
    for _ in range(rounds):
        real, seen = [1.0] * len(KINDS), [2.0] * len(KINDS)
        counts = [[[1.0, 0.5, 1.0], [1.0, 1.0, 0.5]] for _ in LABELERS]
        for kind, votes, n in patterns:
            odds = math.log(prior[kind] / (1 - prior[kind])) + sum(math.log(table[j][1][v] / table[j][0][v]) for j, v in enumerate(votes))
            p = 1 / (1 + math.exp(-max(min(odds, 500), -500)))
            real[kind] += n * p
            seen[kind] += n
            for j, v in enumerate(votes):
                counts[j][1][v] += n * p
                counts[j][0][v] += n * (1 - p)
        prior = [min(max(r / s, 1e-6), 1 - 1e-6) for r, s in zip(real, seen, strict=True)]
        table = [[[c / sum(row) for c in row] for row in rows] for rows in counts]
    return prior, table


def posterior(c: Column, prior: list[float], table: list[list[list[float]]]) -> Column:
    """The probability that candidate ``c`` is real, from its votes."""
    def choose(field: Column, values: list[float]) -> Column:
        out = F.lit(float(values[0]))
        for i, v in enumerate(values[1:], 1):
            out = F.when(field == i, float(v)).otherwise(out)
        return out

    odds = choose(c["kind"], [math.log(p / (1 - p)) for p in prior])
    for j, name in enumerate(LABELERS):
        odds = odds + choose(c[name], [math.log(table[j][1][v] / table[j][0][v]) for v in (NOTHING, YES, NO)])
    return 1 / (1 + F.exp(-odds))


def train(rows: list[tuple[tuple[int, ...], float, float]], steps: int = STEPS, rate: float = RATE) -> tuple[float, list[list[float]]]:
    """Logistic weights from ``(feature values, sum of posteriors, count)``: a bias and a weight for each value."""
    bias, weights = 0.0, [[0.0] * n for n in FEATURES.values()]
    total = sum(n for _, _, n in rows)
    for _ in range(steps if total else 0):
        db, dw = 0.0, [[0.0] * len(w) for w in weights]
        for values, real, n in rows:
            z = bias + sum(w[v] for w, v in zip(weights, values, strict=True))
            gap = (real - n / (1 + math.exp(-max(min(z, 500), -500)))) / total
            db += gap
            for d, v in zip(dw, values, strict=True):
                d[v] += gap
        bias += rate * db
        weights = [[x + rate * (y - 1e-4 * x) for x, y in zip(w, d, strict=True)] for w, d in zip(weights, dw, strict=True)]
    return bias, weights


def classified(c: Column, bias: float, weights: list[list[float]]) -> Column:
    """Whether the classifier holds candidate ``c`` for real."""
    z = F.lit(float(bias))
    for name, w in zip(FEATURES, weights, strict=True):
        part = F.lit(float(w[0]))
        for i, v in enumerate(w[1:], 1):
            part = F.when(c[name] == i, float(v)).otherwise(part)
        z = z + part
    return z >= 0


# ------------------------------------------------------------------ the operator

def private_spans(docs: DataFrame, id_col: str = "doc_id", text: str = "text") -> DataFrame:
    """``id_col`` and ``found``: array of ``(start, kind, end, base)``, base spans and those the classifier adds."""
    ready(docs)
    marked = candidates(docs, id_col, text).withColumn("__row", F.monotonically_increasing_id()).checkpoint()
    each = marked.select(F.explode("found").alias("c"))
    patterns = [(r[0], tuple(r[1:-1]), r[-1]) for r in each.groupBy("c.kind", *(f"c.{v}" for v in LABELERS)).count().collect()]
    prior, table = estimate(patterns)
    sums = each.withColumn("p", posterior(F.col("c"), prior, table)).groupBy(*(f"c.{f}" for f in FEATURES)).agg(F.sum("p").alias("p"), F.count("*").alias("n"))
    bias, weights = train(sorted((tuple(r[:-2]), float(r[-2]), float(r[-1])) for r in sums.collect()))

    shown = lambda c: F.struct(c["start"], c["kind"], c["end"], c["base"])
    added = F.filter("found", lambda c: (c["kind"] >= len(BASE_KINDS)) & classified(c, bias, weights))
    split = marked.select(id_col, "__row", F.transform(F.filter("found", lambda c: c["base"]), shown).alias("base"), F.transform(added, shown).alias("added"))
    plain = split.where(F.size("added") == 0).select(id_col, F.col("base").alias("found"))
    return plain.unionByName(_without_overlaps(split.where(F.size("added") > 0), id_col))


def _without_overlaps(split: DataFrame, id_col: str) -> DataFrame:
    """``id_col, found`` of texts that have added spans: base spans, and added ones that meet no base span.

    Running ends of the base spans before a span and starts of those after it, in a sort of a text's spans each way.
    """
    each = split.select("__row", F.col(id_col).alias("__id"), F.explode(F.concat("base", "added")).alias("c"))
    along = Window.partitionBy("__row").orderBy("c.start", "c.end", "c.kind")
    before = F.max(F.when(F.col("c.base"), F.col("c.end"))).over(along.rowsBetween(Window.unboundedPreceding, -1))
    back = Window.partitionBy("__row").orderBy(F.desc("c.start"), F.desc("c.end"), F.desc("c.kind"))     # a frame to the end would be quadratic
    after = F.min(F.when(F.col("c.base"), F.col("c.start"))).over(back.rowsBetween(Window.unboundedPreceding, -1))
    meets = F.coalesce(before > F.col("c.start"), F.lit(False)) | F.coalesce(after < F.col("c.end"), F.lit(False))
    kept = each.withColumn("__meets", meets).where(F.col("c.base") | ~F.col("__meets"))
    return kept.groupBy("__row", "__id").agg(F.array_sort(F.collect_list("c")).alias("found")).select(F.col("__id").alias(id_col), "found")


def joined(spans: Column) -> Column:
    """``kind:start:end`` of an array of spans, comma-joined."""
    names = F.array(*(F.lit(k) for k in KINDS))
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", F.element_at(names, s["kind"] + 1), s["start"], s["end"])), ",")


def _count_of(k: int) -> Column:
    return F.size(F.filter("found", lambda s: s["base"] & (s["kind"] == k))).cast("long")


def digests(found: DataFrame, id_col: str = "doc_id") -> DataFrame:
    """Counts of the base kinds, SHA-256 of their joined spans, and all spans joined."""
    base = F.filter("found", lambda s: s["base"])
    return found.select(id_col, *(_count_of(k).alias(f"n_{kind}") for k, kind in enumerate(BASE_KINDS)),
                        F.sha2(joined(base).cast("binary"), 256).alias("base_sha256"), joined(F.col("found")).alias("spans"))
