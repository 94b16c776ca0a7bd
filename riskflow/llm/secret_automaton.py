"""Secret scan by one combined deterministic automaton (operator 8).

Every rule is a regular expression. All rules together, unanchored, become one nondeterministic automaton; subset
construction and partition refinement turn it into minimal transition arrays over byte classes. A group of texts is
scanned in one pass over its bytes: the bytes are dealt to equal lanes that step through the arrays together, and a
lane that did not begin at rest is stepped again from its true state until both traces agree. No rule crosses a line,
so spans are needed only in the lines that the pass marks for a rule. There the automaton of the reversed rule, run
the same way from the lines' ends, marks every byte at which a match begins; from the first of these the rule's own
automaton reads to the longest end, and the next is sought behind it. Bytes are read again only within matches, so the
work is linear in a line of any length. Matches that fail a rule's length test are dropped and not retried.

Spans are code points, end exclusive. Base kinds are ``assign``, ``access`` and ``hex``; the others add spans.

Defined results: null or empty text: no spans. Repeated rows and ties: each row on its own; equal starts are
ordered by kind as listed. Empty table: empty result. Memory follows the longest single text. Other columns are
ignored.
"""

from __future__ import annotations

import functools
import re
from collections.abc import Callable
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import ready
from .textarrays import text_groups

#: bytes a lane takes of a group
LANE = 1024

# ------------------------------------------------------------------ expressions over byte sets


@dataclass(frozen=True)
class Node:
    """``set``: one byte of ``bytes``; ``seq``/``alt``: the parts; ``opt``/``plus``: one part."""

    kind: str
    parts: tuple = ()
    bytes: frozenset = frozenset()


def chars(spec: str) -> Node:
    """One byte out of ``spec``; ``a-z`` is a range, a ``-`` at the end itself."""
    out, i = set(), 0
    while i < len(spec):
        if i + 2 < len(spec) and spec[i + 1] == "-":
            out.update(range(ord(spec[i]), ord(spec[i + 2]) + 1))
            i += 3
        else:
            out.add(ord(spec[i]))
            i += 1
    return Node("set", bytes=frozenset(out))


def seq(*parts: Node) -> Node:
    return Node("seq", parts)


def alt(*parts: Node) -> Node:
    return Node("alt", parts)


def opt(part: Node) -> Node:
    return Node("opt", (part,))


def plus(part: Node) -> Node:
    return Node("plus", (part,))


def star(part: Node) -> Node:
    return opt(plus(part))


def times(part: Node, n: int) -> Node:
    return seq(*[part] * n)


def word(text: str, fold: bool = False) -> Node:
    """The bytes of ``text``; ``fold``: letters in either case."""
    return seq(*(Node("set", bytes=frozenset({ord(c.lower()), ord(c.upper())} if fold else {ord(c)})) for c in text))


def backwards(node: Node) -> Node:
    """The expression of the reversed matches."""
    parts = tuple(backwards(p) for p in node.parts)
    return Node(node.kind, parts[::-1] if node.kind == "seq" else parts, node.bytes)


_TOKEN = re.compile(r"\[(?:\\.|[^\]\\])+\]|\(\?i:|\(\?:|\(|\\x[0-9A-Fa-f]{2}|\\.|\{[0-9]+(?:,)?\}|.", re.S)
_ESCAPE = re.compile(r"\\x([0-9A-Fa-f]{2})|\\(\W)")


def _plain(token: str) -> str:
    """``token`` with its escapes (``\\x20``, ``\\.``) replaced by what they stand for."""
    out = _ESCAPE.sub(lambda m: chr(int(m[1], 16)) if m[1] else m[2], token)
    if not out.isascii() or re.search(r"\\[A-Za-z0-9]", token.replace("\\x", "")):
        raise ValueError(f"{token} is not supported")
    return out


def parse(pattern: str) -> Node:
    """The expression of a regex: ASCII characters, sets, groups, ``(?i:``, ``|``, ``?``, ``*``, ``+``, ``{n}`` and ``{n,}``."""
    tokens, at = _TOKEN.findall(pattern), 0

    def branches(fold: bool) -> Node:
        nonlocal at
        out, parts = [], []
        while at < len(tokens) and tokens[at] != ")":
            token = tokens[at]
            at += 1
            if token == "|":
                out, parts = [*out, seq(*parts)], []
            elif token in "?*+":
                parts.append({"?": opt, "*": star, "+": plus}[token](parts.pop()))
            elif token[0] == "{" and len(token) > 1:
                part, n = parts.pop(), int(token.strip("{,}"))
                more = [star(part)] if n == 0 else [times(part, n - 1), plus(part)]
                parts.append(seq(*more) if "," in token else times(part, n))
            elif token in ("(", "(?:", "(?i:"):
                parts.append(branches(fold or token == "(?i:"))
                if at == len(tokens):
                    raise ValueError(f"{pattern}: a group is open")
                at += 1
            elif token[0] == "[" and len(token) > 2:
                if token[1] == "^":
                    raise ValueError(f"{token} is not supported")
                found = chars(_plain(token[1:-1])).bytes
                parts.append(Node("set", bytes=found | frozenset(ord(chr(b).swapcase()) for b in found if fold)))
            elif token in ".^$[]{}":
                raise ValueError(f"{token} is not supported")
            else:
                parts.append(word(_plain(token), fold))
        return alt(*out, seq(*parts)) if out else seq(*parts)

    node = branches(False)
    if at < len(tokens):
        raise ValueError(f"{pattern}: a group is closed twice")
    return node


# ------------------------------------------------------------------ rules

def _assign_ok(match: bytes) -> bool:
    """The value behind the separator has six characters or more."""
    at = min(i for i in (match.find(b":"), match.find(b"=")) if i >= 0) + 1
    value = match[at:].lstrip(b" ")
    return len(value[1:] if value[:1] in (b'"', b"'") else value) >= 6


@dataclass(frozen=True)
class Rule:
    kind: str
    pattern: str
    accepts: Callable[[bytes], bool]


def at_least(n: int) -> Callable[[bytes], bool]:
    return lambda match: len(match) >= n


#: fixed patterns of the base kinds, then the kinds this method adds
RULES = (
    Rule("assign", r"""(?i:password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?[A-Za-z0-9+/_.=-]+""", _assign_ok),
    Rule("access", "AKIA[A-Z0-9]+", at_least(20)),
    Rule("hex", "[0-9a-f]{24,}", at_least(24)),
    Rule("key_block", "-----BEGIN [A-Z0-9 ]*PRIVATE KEY-----", at_least(1)),
    Rule("code_host", "gh[pousr]_[A-Za-z0-9]+", at_least(40)),
    Rule("chat", "xox[abprs]-[A-Za-z0-9-]+", at_least(20)),
    Rule("payment", "[rs]k_live_[A-Za-z0-9]+", at_least(24)),
    Rule("maps", "AIza[A-Za-z0-9_-]+", at_least(39)),
    Rule("web_token", r"eyJ[A-Za-z0-9_-]+\.[A-Za-z0-9_-]+\.[A-Za-z0-9_-]+", at_least(36)),
)
BASE_KINDS = ("assign", "access", "hex")


# ------------------------------------------------------------------ compilation


class _Graph:
    """Nondeterministic automaton: byte-set edges and empty edges."""

    def __init__(self):
        self.edges: list[list[tuple[frozenset, int]]] = []
        self.empty: list[list[int]] = []

    def state(self) -> int:
        self.edges.append([])
        self.empty.append([])
        return len(self.edges) - 1

    def add(self, node: Node, start: int) -> int:
        """Wire ``node`` behind ``start``; the state it ends in."""
        if node.kind == "set":
            end = self.state()
            self.edges[start].append((node.bytes, end))
        elif node.kind == "seq":
            end = start
            for part in node.parts:
                end = self.add(part, end)
        elif node.kind == "alt":
            end = self.state()
            for part in node.parts:
                self.empty[self.add(part, start)].append(end)
        else:
            inner = self.state()
            self.empty[start].append(inner)
            last, end = self.add(node.parts[0], inner), self.state()
            self.empty[last].append(end)
            if node.kind == "plus":
                self.empty[last].append(inner)
            else:
                self.empty[start].append(end)
        return end

    def closure(self, states) -> frozenset:
        out, stack = set(states), list(states)
        while stack:
            for t in self.empty[stack.pop()]:
                if t not in out:
                    out.add(t)
                    stack.append(t)
        return frozenset(out)


@dataclass
class Automaton:
    """Minimal transition arrays: ``step[state * classes + byte_class[byte]]``; bit k of ``accept``: rule k ends here.

    State 0 is the start. ``dead``: the state without a future, or -1.
    """

    step: np.ndarray
    byte_class: np.ndarray
    classes: int
    accept: np.ndarray
    dead: int

    @functools.cached_property
    def lists(self) -> tuple[list[int], list[int], list[int]]:
        """The arrays as lists, for walks of one byte at a time."""
        return self.step.tolist(), self.byte_class.tolist(), self.accept.tolist()


def compile_rules(patterns: list[Node], search: bool, every: bool = False) -> Automaton:
    """Subset construction and minimisation; ``search``: a match may begin at every byte.

    A search needs one mark for each rule and line, so a rule that has just ended is forgotten until it begins
    anew; this keeps the arrays small. ``every``: all ends are marked.
    """
    graph = _Graph()
    root = graph.state()
    ends, owner = {}, {}
    for k, p in enumerate(patterns):
        own = graph.state()
        graph.empty[root].append(own)
        end = graph.add(p, own)
        ends[end] = k
        owner.update(dict.fromkeys(range(own, len(graph.edges)), k))
    sets = sorted({s for edges in graph.edges for s, _ in edges}, key=sorted)
    signature = np.zeros((256, len(sets)), np.uint8)
    for j, s in enumerate(sets):
        signature[sorted(s), j] = 1
    _, sample, byte_class = np.unique(signature, axis=0, return_index=True, return_inverse=True)
    byte_class = byte_class.reshape(-1)
    first = graph.closure([root])
    known, order, rows = {first: 0}, [first], []
    for states in order:
        row = []
        for byte in sample.tolist():
            to = {t for s in states for accepted, t in graph.edges[s] if byte in accepted}
            target = graph.closure(to)
            if search and every:
                target |= first
            elif search:
                over = {ends[t] for t in target if t in ends}
                target = frozenset(t for t in target if t in ends or owner[t] not in over) | first
            if target not in known:
                known[target] = len(order)
                order.append(target)
            row.append(known[target])
        rows.append(row)
    step = np.array(rows, np.int64)
    accept = np.array([sum(1 << ends[s] for s in states if s in ends) for states in order], np.int64)
    block = np.unique(accept, return_inverse=True)[1].reshape(-1)
    while True:                                                # refine until the blocks agree on every byte class
        _, finer = np.unique(np.column_stack([block, block[step]]), axis=0, return_inverse=True)
        finer = finer.reshape(-1)
        if finer.max() == block.max():
            break
        block = finer
    number = np.full(block.max() + 1, -1)
    number[block[0]] = 0
    rest = [b for b in range(block.max() + 1) if b != block[0]]
    number[rest] = np.arange(1, len(rest) + 1)
    block = number[block]
    keep = np.unique(block, return_index=True)[1]
    step, accept = block[step[keep]], accept[keep]
    dead = np.flatnonzero((step == np.arange(len(step))[:, None]).all(axis=1) & (accept == 0))
    return Automaton(step.astype(np.int32).reshape(-1), byte_class.astype(np.uint8), len(sample), accept,
                     int(dead[0]) if len(dead) and not search else -1)


def trace(machine: Automaton, data: np.ndarray) -> np.ndarray:
    """The state after each byte, beginning at rest: all lanes in step, then lanes that began elsewhere."""
    n, c = len(data), machine.classes
    lanes = -(-n // LANE)
    kind = np.zeros(lanes * LANE, np.int32)
    kind[:n] = machine.byte_class[data]
    kind = np.ascontiguousarray(kind.reshape(lanes, LANE).T)
    states = np.empty((LANE, lanes), np.int32)
    now = np.zeros(lanes, np.int32)
    for k in range(LANE):
        now = machine.step[now * c + kind[k]]
        states[k] = now
    step = machine.step
    for lane in range(1, lanes):
        state = int(states[LANE - 1, lane - 1])
        if state:                                              # the lane began at rest, but the text was elsewhere
            for k in range(LANE):
                state = int(step[state * c + kind[k, lane]])
                if states[k, lane] == state:
                    break
                states[k, lane] = state
    return states.T.reshape(-1)[:n]


def longest(machine: Automaton, line: bytes, start: int, stuck: set[tuple[int, int]]) -> int:
    """End of the longest match at ``start``, or -1.

    ``stuck`` collects places and states beyond a match's end from which no later end was reached; a later call stops
    there, so that no byte is read more than once in a state.
    """
    step, byte_class, accept = machine.lists
    c, dead, state, best, beyond = machine.classes, machine.dead, 0, -1, []
    for i in range(start, len(line)):
        state = step[state * c + byte_class[line[i]]]
        if state == dead or (stuck and (i, state) in stuck):
            break
        if accept[state]:
            best, beyond = i + 1, []
        else:
            beyond.append((i, state))
    stuck.update(beyond)
    return best


class Scanner:
    """The combined automaton with each rule's own, forwards and backwards."""

    def __init__(self, rules: tuple[Rule, ...]):
        self.rules = rules
        nodes = [parse(r.pattern) for r in rules]
        self.all = compile_rules(nodes, True)
        self.each = [compile_rules([n], False) for n in nodes]
        self.back = [compile_rules([backwards(n)], True, True) for n in nodes]
        for r, m in zip(rules, self.each, strict=True):
            if m.accept[0] or any(m.step[int(m.byte_class[10]) + s * m.classes] != m.dead for s in range(len(m.accept))):
                raise ValueError(f"rule {r.kind} crosses a line or matches nothing")

    def rule_spans(self, text: bytes, k: int) -> tuple[list[int], list[int]]:
        """Starts and ends of the leftmost, longest, non-overlapping matches of rule ``k`` in ``text`` (lines)."""
        turned = np.frombuffer(text, np.uint8)[::-1]
        begins = np.flatnonzero(self.back[k].accept[trace(self.back[k], turned)][::-1])
        accepts, starts, ends, at, stuck = self.rules[k].accepts, [], [], 0, set()
        for begin in begins.tolist():
            if begin >= at:
                at = longest(self.each[k], text, begin, stuck)
                if accepts(text[begin:at]):
                    starts.append(begin)
                    ends.append(at)
        return starts, ends

    def spans(self, data: np.ndarray, offsets: np.ndarray) -> dict[int, list[tuple[int, int, int]]]:
        """For each text with a match: ``(start, rule, end)`` in code points of the text, sorted."""
        out: dict[int, list[tuple[int, int, int]]] = {}
        if not len(data):
            return out
        # A search automaton marks every match, wherever it began, so texts may lie end to end; a mark that
        # reaches over a border finds no span below.
        marks = self.all.accept[trace(self.all, data)]
        hit = np.flatnonzero(marks)
        if not len(hit):
            return out
        raw = data.tobytes()
        cut = np.zeros(len(data) + 1, bool)
        cut[1:] = data == 10
        cut[offsets] = True
        cuts = np.flatnonzero(cut)                             # where lines start, and the end
        line = np.searchsorted(cuts, hit, "right") - 1
        points = np.append(0, np.cumsum((data & 0xC0) != 0x80))
        for k in range(len(self.rules)):
            own = np.unique(line[marks[hit] >> k & 1 > 0])
            if not len(own):
                continue
            first, last = cuts[own], cuts[own + 1]
            starts, ends = self.rule_spans(b"".join(raw[a:b] + b"\n" for a, b in zip(first.tolist(), last.tolist(), strict=True)), k)
            size = last - first + 1                            # with the line end that parts it from the next
            begin = np.cumsum(size) - size
            starts, ends = np.array(starts, np.int64), np.array(ends, np.int64)
            at = np.searchsorted(begin, starts, "right") - 1
            shift = first[at] - begin[at]
            text = np.searchsorted(offsets, starts + shift, "right") - 1
            base = points[offsets[text]]
            for d, a, b in zip(text.tolist(), (points[starts + shift] - base).tolist(), (points[ends + shift] - base).tolist(), strict=True):
                out.setdefault(d, []).append((a, k, b))
        return {d: sorted(spans) for d, spans in out.items()}


_SCANNERS: dict[tuple, Scanner] = {}


def scanner(rules: tuple[Rule, ...]) -> Scanner:
    key = tuple((r.kind, r.pattern) for r in rules)
    if key not in _SCANNERS:
        _SCANNERS[key] = Scanner(rules)
    return _SCANNERS[key]


# ------------------------------------------------------------------ Spark job

SPANS = "array<struct<kind:string,start:int,end:int>>"


def secret_spans(docs: DataFrame, id_col: str = "doc_id", text: str = "text", rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """``id_col`` and ``found``: all spans of a text by start, then kind as listed."""
    ready(docs)
    scan = scanner(rules)                                      # compiled once, on the driver
    item = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int32()), ("end", pa.int32())]))
    kinds = [r.kind for r in rules]

    def run(batches):
        for batch in batches:
            for lo, hi, data, offsets in text_groups(batch.column(1)):
                found = scan.spans(data, offsets)
                rows = [[{"kind": kinds[k], "start": a, "end": b} for a, k, b in found.get(i, ())] for i in range(hi - lo)]
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(lo, hi - lo), pa.array(rows, item)], [id_col, "found"])

    kind = docs.schema[id_col].dataType.simpleString()
    return docs.select(F.col(id_col), F.col(text).cast("string").alias(text)).mapInArrow(run, f"`{id_col}` {kind}, found {SPANS}")


def joined(spans):
    """``kind:start:end`` of an array of spans, comma-joined."""
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"], s["end"])), ",")


def count_of(kind: str):
    return F.size(F.filter("found", lambda s: s["kind"] == kind)).cast("long")


def digests(found: DataFrame, kinds: tuple[str, ...], id_col: str = "doc_id") -> DataFrame:
    """Counts of the base ``kinds``, SHA-256 of their joined spans, and all spans joined."""
    base = F.filter("found", lambda s: s["kind"].isin(*kinds))
    return found.select(id_col, *(count_of(k).alias(f"n_{k}") for k in kinds),
                        F.sha2(joined(base).cast("binary"), 256).alias("base_sha256"), joined(F.col("found")).alias("spans"))
