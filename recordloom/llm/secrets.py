"""Operator 9, secret scans: all rules in one minimised automaton, run over every byte once.

A rule is a lead (a regular expression), then a run of body bytes; it is a secret if the run is long
enough.  The rules' expressions are compiled together by subset construction over classes of bytes and
minimised by partition refinement; the result is one array of transitions.  A task cuts its bytes into
lanes at bytes after which every state is the start state, so no match reaches over a cut, and steps all
lanes at once, one byte each.  A lane in which a rule's state accepted, which is rare, is walked again with
that rule's own automaton for the spans: leftmost, longest, non-overlapping within a kind.  A walk passes no byte
twice in one state, so its time is linear in the lane, however many leads begin in vain.

Cases.  Null and empty text: no spans.  Very long texts: more lanes; a text without any cutting byte is one
long lane.  Repeated rows are each returned; an empty table gives an empty result; other columns of the
input are ignored by find_secrets and kept by redact.
"""

from __future__ import annotations

import hashlib
import re
from array import array
from collections.abc import Callable, Iterator
from functools import cache
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from recordloom.llm import wordhash as wh
from recordloom.llm.storage import documents, map_arrow


class Rule(NamedTuple):
    kind: str
    lead: str
    body: str  #: a class of ASCII bytes
    least: int  #: shortest secret body
    any_case: bool = False  #: letters of the lead in either case


#: Kinds in the order in which equal starts are listed.  The first three are the base rules.
RULES = (
    Rule("assign", r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?""", "[A-Za-z0-9+/_.=-]", 12, True),
    Rule("access", "AKIA", "[A-Z0-9]", 14),
    Rule("hex", "", "[0-9a-f]", 16),
    Rule("github", "gh[oprsu]_", "[A-Za-z0-9]", 30),
    Rule("slack", "xox[abeprs]-", "[A-Za-z0-9-]", 10),
    Rule("google", "AIza", "[A-Za-z0-9_-]", 30),
    Rule("payment", "[rs]k_live_", "[A-Za-z0-9]", 16),
    Rule("jwt", r"eyJ[A-Za-z0-9_-]+\.eyJ[A-Za-z0-9_-]+\.", "[A-Za-z0-9_-]", 10),
    Rule("private_key", "-----BEGIN [A-Z ]*PRIVATE KEY", "-", 5),
)
BASE = 3
#: Body bytes that the shared automaton waits for after a lead before it accepts.
LOOK = 2
LANE = 256
#: Bytes of a failed lead from which on its way is kept.
RETRY = 8
NONE, NEW = -1, -2


class Automaton(NamedTuple):
    classes: np.ndarray  #: byte -> class
    width: int  #: number of classes
    moves: np.ndarray  #: state * width + class -> next state * width; state 0 is the start
    accepts: np.ndarray  #: state -> bits of the rules that accept

    def cuts(self) -> np.ndarray:
        """Bytes after which every state is the start state."""
        return (self.moves.reshape(-1, self.width) == 0).all(0)[self.classes]


def _byte(p: str, i: int) -> tuple[int, int]:
    """The byte that stands at i, plain or after a backslash, and the place after it."""
    if p.startswith("\\x", i):
        return int(p[i + 2 : i + 4], 16), i + 4
    i += p[i] == "\\"
    return ord(p[i]), i + 1


def _set(p: str, i: int) -> tuple[frozenset[int], int]:
    """The class of bytes whose bracket opens at i."""
    found, i = set(), i + 1
    while p[i] != "]":
        first, i = _byte(p, i)
        last = first
        if p[i] == "-" and p[i + 1] != "]":
            last, i = _byte(p, i + 1)
        found |= set(range(first, last + 1))
    return frozenset(found), i + 1


def parse(p: str, i: int = 0) -> tuple[list[list[tuple]], int]:
    """A rule's expression from i on, to its end or a closing bracket: alternatives of items (what, least, most).

    Known are bytes, classes, groups, alternatives and the repeats ? * + {n} {n,m}.
    """
    found: list[list[tuple]] = [[]]
    while i < len(p) and p[i] != ")":
        if p[i] == "|":
            found.append([])
            i += 1
            continue
        if p[i] == "(":
            what, i = parse(p, i + 3 if p.startswith("(?:", i) else i + 1)
            i += 1
        elif p[i] == "[":
            what, i = _set(p, i)
        else:
            one, i = _byte(p, i)
            what = frozenset({one})
        least, most = 1, 1
        if i < len(p) and p[i] == "{":
            end = p.index("}", i)
            numbers = [int(n) for n in p[i + 1 : end].split(",")]
            (least, most), i = (numbers[0], numbers[-1]), end + 1
        elif i < len(p) and p[i] in "?*+":
            (least, most), i = {"?": (0, 1), "*": (0, None), "+": (1, None)}[p[i]], i + 1
        found[-1].append((what, least, most))
    return found, i


class _Nfa:
    def __init__(self) -> None:
        self.steps: list[list[tuple[frozenset[int], int]]] = []
        self.free: list[list[int]] = []

    def state(self) -> int:
        self.steps.append([])
        self.free.append([])
        return len(self.steps) - 1

    def add(self, items: list[tuple], at: int, any_case: bool) -> int:
        """Append items (what, least, most), one after another, to the state at; their end state."""
        for what, least, most in items:
            for _ in range(least):
                at = self.once(what, at, any_case)
            if most == least:
                continue
            self.free[at].append(to := self.state())
            if most is None:
                self.free[to].append(loop := self.state())
                self.free[self.once(what, loop, any_case)].append(to)
            else:
                for _ in range(most - least):
                    at = self.once(what, at, any_case)
                    self.free[at].append(to)
            at = to
        return at

    def once(self, what: frozenset[int] | list[list[tuple]], at: int, any_case: bool) -> int:
        """Append one byte of a set, or one of some alternatives."""
        to = self.state()
        if isinstance(what, frozenset):
            letters = {b for b in what if chr(b).isalpha()} if any_case else set()
            self.steps[at].append((what | {ord(f(chr(b))) for b in letters for f in (str.lower, str.upper)}, to))
        else:
            for branch in what:
                self.free[at].append(first := self.state())
                self.free[self.add(branch, first, any_case)].append(to)
        return to

    def closure(self, states: set[int]) -> frozenset[int]:
        found, todo = set(states), list(states)
        while todo:
            for s in self.free[todo.pop()]:
                if s not in found:
                    found.add(s)
                    todo.append(s)
        return frozenset(found)


def compile_rules(patterns: list[tuple[str, bool]], anywhere: bool) -> Automaton:
    """One minimised automaton for all patterns (expression, any case), at the start of the bytes or anywhere in them."""
    nfa = _Nfa()
    start = nfa.state()
    ends = {}
    for i, (pattern, any_case) in enumerate(patterns):
        nfa.free[start].append(first := nfa.state())
        ends[nfa.once(parse(pattern)[0], first, any_case)] = 1 << i
    sets = sorted({wanted for step in nfa.steps for wanted, _ in step}, key=sorted)
    kinds: dict[tuple[bool, ...], int] = {}
    classes = np.array([kinds.setdefault(tuple(b in wanted for wanted in sets), len(kinds)) for b in range(256)])
    samples = [int(np.flatnonzero(classes == c)[0]) for c in range(len(kinds))]
    opening = nfa.closure({start})
    ids, rows, todo = {opening: 0}, [], [opening]
    for now in todo:
        row = []
        for byte in samples:
            after = {to for s in now for wanted, to in nfa.steps[s] if byte in wanted} | ({start} if anywhere else set())
            after = nfa.closure(after)
            if after not in ids:
                ids[after] = len(ids)
                todo.append(after)
            row.append(ids[after])
        rows.append(row)
    moves = np.array(rows)
    accepts = np.array([sum({ends[s] for s in now if s in ends}) for now in todo])
    # refine the partition by accepted rules until moves agree within each block
    _, block = np.unique(accepts, return_inverse=True)
    while True:
        _, finer = np.unique(np.column_stack([block, block[moves]]), axis=0, return_inverse=True)
        if finer.max() == block.max():
            break
        block = finer
    order = {int(b): i for i, b in enumerate(dict.fromkeys([int(block[0]), *map(int, block)]))}
    block = np.array([order[int(b)] for b in block])
    small, kept = np.zeros((len(order), len(kinds)), np.int64), np.zeros(len(order), np.int64)
    small[block], kept[block] = block[moves], accepts
    return Automaton(classes.astype(np.int64), len(kinds), (small * len(kinds)).ravel(), kept)


@cache
def automata(rules: tuple[Rule, ...]) -> tuple[Automaton, list[tuple[Automaton, frozenset[int]]]]:
    """The shared automaton, and each rule's lead with its body bytes."""
    look = [(f"{r.lead}{r.body}{{{r.least if not r.lead else min(r.least, LOOK)}}}", r.any_case) for r in rules]
    bodies = [parse(r.body)[0][0][0][0] for r in rules]
    return compile_rules(look, True), [(compile_rules([(r.lead, r.any_case)], False), body) for r, body in zip(rules, bodies, strict=True)]


def lanes(part: wh.Slice, cuts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Starts and ends of pieces of about LANE bytes that end at a cutting byte or a text's end."""
    spots = np.flatnonzero(cuts[part.data]) + 1
    aimed = np.searchsorted(spots, np.arange(LANE, len(part.data), LANE))
    starts = np.unique(np.concatenate([part.offsets[:-1], spots[aimed[aimed < len(spots)]]]))
    starts = starts[starts < len(part.data)]
    return starts, np.append(starts[1:], len(part.data))


def flagged(part: wh.Slice, automaton: Automaton) -> Iterator[tuple[int, int, int]]:
    """(start, end, bits of rules) of the lanes in which a rule accepted."""
    if not len(part.data):
        return
    starts, ends = lanes(part, automaton.cuts())
    order = np.argsort(starts - ends, kind="stable")
    starts, lengths = starts[order], (ends - starts)[order]
    symbols = automaton.classes[part.data]
    accepts = np.repeat(automaton.accepts, automaton.width)
    state, bits = np.zeros(len(starts), np.int64), np.zeros(len(starts), np.int64)
    active = len(starts) - np.searchsorted(lengths[::-1], np.arange(lengths[0]), "right")
    for t, n in enumerate(active.tolist()):
        state[:n] = automaton.moves[state[:n] + symbols[starts[:n] + t]]
        bits[:n] |= accepts[state[:n]]
    for i in np.flatnonzero(bits):
        yield int(starts[i]), int(starts[i] + lengths[i]), int(bits[i])


def walk(data: bytes, lead: Automaton, body: frozenset[int], least: int) -> Iterator[tuple[int, int]]:
    """Leftmost longest non-overlapping matches with a body of at least one byte; those with a long enough body are yielded."""
    classes, moves, accepts, width = lead.classes.tolist(), lead.moves.tolist(), lead.accepts.tolist(), lead.width
    # state -> place -> where a failed run through it accepted last (NONE: nowhere, NEW: no run yet), so that no place is passed twice in one state
    passed: dict[int, array] = {}
    dead = next((s for s in range(len(accepts)) if not accepts[s] and all(m == s * width for m in moves[s * width : (s + 1) * width])), -1) * width
    at = 0
    while at < len(data):
        state, to, opened, states = 0, at, at if accepts[0] else NONE, []
        while to < len(data) and state != dead:
            state = moves[state + classes[data[to]]]
            to += 1
            if state in passed and passed[state][to] != NEW:
                opened = max(opened, passed[state][to])
                break
            states.append(state)
            if accepts[state // width]:
                opened = to
        end = opened
        while 0 <= end < len(data) and data[end] in body:
            end += 1
        if opened >= 0 and end > opened:
            if end - opened >= least:
                yield at, end
            at = end
        else:
            if len(states) > RETRY:
                for place, s in enumerate(states, at + 1):
                    if s not in passed:
                        passed[s] = array("q", [NEW]) * (len(data) + 1)
                    passed[s][place] = opened if place <= opened else NONE
            at += 1


def scan(part: wh.Slice, rules: tuple[Rule, ...] = RULES) -> dict[int, list[tuple[int, int, int]]]:
    """Text of the slice -> (start byte, rank of the kind, end byte) of its secrets, in order."""
    shared, own = automata(rules)
    found: dict[int, list[tuple[int, int, int]]] = {}
    for start, end, bits in flagged(part, shared):
        text = int(np.searchsorted(part.offsets, start, "right")) - 1
        piece, base = part.data[start:end].tobytes(), start - int(part.offsets[text])
        for k, rule in enumerate(rules):
            if bits >> k & 1:
                found.setdefault(text, []).extend((base + a, k, base + b) for a, b in walk(piece, *own[k], rule.least))
    return {text: sorted(spans) for text, spans in found.items() if spans}


def _listed(spans: list[tuple[int, int, int]], data: np.ndarray, rules: tuple[Rule, ...]) -> list[tuple[int, str]]:
    """(rank, kind:start:end) in code points."""
    before = np.zeros(len(data) + 1, np.int64)
    np.cumsum((data & 0xC0) != 0x80, out=before[1:])
    return [(k, f"{rules[k].kind}:{before[a]}:{before[b]}") for a, k, b in spans]


def find_secrets(docs: DataFrame, keep: list[str] | None = None, text: str = "text", rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """The kept columns; per base rule the number of spans; base_sha256; spans of all rules as kind:start:end."""
    keep = keep or ["doc_id"]
    source = docs.select(*keep, F.col(text).alias("__text"))
    counted = [f"n_{r.kind}" for r in rules[:BASE]]
    schema = ", ".join([*(f"`{f.name}` {f.dataType.simpleString()}" for f in source.schema if f.name != "__text"), *(f"{c} long" for c in counted), "base_sha256 string, spans string"])
    none = hashlib.sha256(b"").hexdigest()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            n = batch.num_rows
            counts = np.zeros((BASE, n), np.int64)
            digests, spans = [none] * n, [""] * n
            for part in wh.slices(batch.column(len(keep))):
                for t, found in scan(part, rules).items():
                    listed = _listed(found, part.data[part.offsets[t] : part.offsets[t + 1]], rules)
                    row = part.first + t
                    counts[:, row] = np.bincount([k for k, _ in listed if k < BASE], minlength=BASE)
                    digests[row] = hashlib.sha256(",".join(s for k, s in listed if k < BASE).encode()).hexdigest()
                    spans[row] = ",".join(s for _, s in listed)
            yield pa.RecordBatch.from_arrays([*batch.columns[: len(keep)], *map(pa.array, counts), pa.array(digests, pa.string()), pa.array(spans, pa.string())], names=[*keep, *counted, "base_sha256", "spans"])

    return map_arrow(source, run, schema)


def replace_spans(docs: DataFrame, text: str, spans: Callable[[wh.Slice], dict[int, list[tuple[int, int, bytes]]]]) -> DataFrame:
    """docs with parts of its text replaced: spans gives (start byte, end byte, new bytes) per text, not overlapping and in order."""
    at = docs.columns.index(text)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            column, new = batch.column(at), {}
            for part in wh.slices(column):
                for t, found in spans(part).items():
                    raw, pieces, done = part.data[part.offsets[t] : part.offsets[t + 1]].tobytes(), [], 0
                    for a, b, put in found:
                        pieces += [raw[done:a], put]
                        done = b
                    new[part.first + t] = b"".join([*pieces, raw[done:]]).decode()
            if new:
                column = pa.array([new.get(i, v) for i, v in enumerate(column.to_pylist())], column.type)
            yield pa.RecordBatch.from_arrays([column if i == at else c for i, c in enumerate(batch.columns)], schema=batch.schema)

    return map_arrow(docs, run, docs.schema)


#: What ends a private key; without it, the characters of which its material consists.
_KEY_END, _KEY_BODY = re.compile(rb"-----END [A-Z ]*PRIVATE KEY-{0,5}"), re.compile(rb"[A-Za-z0-9+/=\s-]*")


def _whole_key(raw: bytes, end: int) -> int:
    """Where a private key ends whose opening line ends at end."""
    closed = _KEY_END.search(raw, end)
    opened = raw.find(b"-----BEGIN ", end)
    if closed and (opened < 0 or closed.start() < opened):
        return closed.end()
    return _KEY_BODY.match(raw, end, opened if opened >= 0 else len(raw)).end()


def redact(docs: DataFrame, text: str = "text", rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """docs with every secret replaced by its kind in brackets, private keys with their material and closing line; overlapping secrets are replaced together, under the first one's kind."""

    def spans(part: wh.Slice) -> dict[int, list[tuple[int, int, bytes]]]:
        out = {}
        for t, found in scan(part, rules).items():
            joined: list[list] = []
            for a, k, b in found:
                if rules[k].kind == "private_key" and not (joined and a < joined[-1][1]):
                    b = _whole_key(part.data[part.offsets[t] : part.offsets[t + 1]].tobytes(), b)
                if joined and a < joined[-1][1]:
                    joined[-1][1] = max(joined[-1][1], b)
                else:
                    joined.append([a, b, f"[{rules[k].kind}]".encode()])
            out[t] = joined
        return out

    return replace_spans(docs, text, spans)


def op9_secret_scans(spark: SparkSession, sf_dir: str) -> DataFrame:
    return find_secrets(documents(spark, sf_dir))


def _marked(k: int, r: Rule) -> str:
    case = "(?i)" if r.any_case else ""
    pattern = f"{case}(?:{r.lead})({r.body}+)".replace("(password|", "(?:password|").replace("'", "''")
    return f"SELECT r, {k} AS k, '{r.kind}' AS kind, {r.least} AS least, '{pattern}' AS pattern, string_split(regexp_replace(text, '{pattern}', chr(1) || '\\0' || chr(2) || '\\1' || chr(3), 'g'), chr(1)) AS p FROM docs"


ORACLE_SQL = rf"""
WITH docs AS (SELECT row_number() OVER () AS r, doc_id, coalesce(text, '') AS text FROM documents),
marked AS ({" UNION ALL ".join(_marked(k, r) for k, r in enumerate(RULES))}),
pieces AS (SELECT r, k, kind, least, unnest(p) AS piece, unnest(range(len(p))) AS i FROM marked WHERE len(p) > 1),
cut AS (SELECT *, CASE WHEN i = 0 THEN 0 ELSE strpos(piece, chr(2)) - 1 END AS n, CASE WHEN i = 0 THEN 0 ELSE strpos(piece, chr(3)) - strpos(piece, chr(2)) - 1 END AS body,
  CASE WHEN i = 0 THEN length(piece) ELSE strpos(piece, chr(2)) - 1 + length(piece) - strpos(piece, chr(3)) END AS len FROM pieces),
placed AS (SELECT *, sum(len) OVER (PARTITION BY r, k ORDER BY i) - len AS start FROM cut),
spans AS (SELECT r, k, start, kind || ':' || start::BIGINT || ':' || (start + n)::BIGINT AS s FROM placed WHERE i > 0 AND body >= least),
per AS (SELECT r, {", ".join(f"count(*) FILTER (k = {k}) AS n_{x.kind}" for k, x in enumerate(RULES[:BASE]))}, string_agg(s, ',' ORDER BY start, k) FILTER (k < {BASE}) AS base, string_agg(s, ',' ORDER BY start, k) AS spans FROM spans GROUP BY r)
SELECT doc_id, {", ".join(f"coalesce(n_{x.kind}, 0)::BIGINT AS n_{x.kind}" for x in RULES[:BASE])}, sha256(coalesce(base, '')) AS base_sha256, coalesce(spans, '') AS spans
FROM docs LEFT JOIN per ON per.r = docs.r
"""
