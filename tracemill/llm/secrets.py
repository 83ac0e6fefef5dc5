"""Secret scans (2): all rules in one deterministic automaton, one pass over the bytes.

Rules are regular expressions over bytes, compiled here: parse, Thompson automaton, subset construction,
minimisation by partition refinement, transition arrays. The scanning automaton reads "anything, then a
rule" for all rules at once, so one pass tells which rules occur in a text at all. Only for those, the
rule's own (anchored) automaton marks the leftmost longest spans that do not overlap within the rule; of
these, spans that miss the rule's length are dropped after they were consumed. An attempt follows its
automaton to the end, however far; it leaves marks where nothing more was accepted, and later attempts that
come to a mark in the same state stop there, so that failing attempts over one run stay cheap.

Defined results: null counts as empty (no spans); repeated rows and rows without an id give a row each; an empty
table gives none; very long texts are read whole; other columns play no part.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass
from functools import cache

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .words import map_rows


@dataclass(frozen=True)
class Rule:
    """``head`` then ``tail``, both greedy; a match counts if the tail has ``least`` bytes.

    ``trigger``: what any counting match contains, for the scanning automaton; long counts in several
    triggers would multiply its states. Give the rules in the order in which spans at the same start are
    listed.
    """

    kind: str
    head: str
    tail: str
    least: int
    trigger: str
    base: bool = False


# The base rules.
BASE = (
    Rule("assign", r"([pP][aA][sS][sS][wW][oO][rR][dD]|[pP][aA][sS][sS][wW][dD]|[sS][eE][cC][rR][eE][tT]|[tT][oO][kK][eE][nN]|[aA][pP][iI]_?[kK][eE][yY])[\"']?\x20*[:=]\x20*[\"']?", r"[A-Za-z0-9+/_.=-]+", 8,
         r"([pP][aA][sS][sS][wW][oO][rR][dD]|[pP][aA][sS][sS][wW][dD]|[sS][eE][cC][rR][eE][tT]|[tT][oO][kK][eE][nN]|[aA][pP][iI]_?[kK][eE][yY])[\"']?\x20*[:=]\x20*[\"']?[A-Za-z0-9+/_.=-]", True),
    Rule("access", r"AKIA", r"[A-Z0-9]+", 12, r"AKIA[A-Z0-9]", True),
    Rule("hex", r"", r"[0-9a-f]+", 32, r"[0-9a-f]{32}", True),
)
RULES = (
    *BASE,
    Rule("pem", r"-----BEGIN [A-Z ]*PRIVATE KEY", r"-----", 5, r"-----BEGIN "),
    Rule("forge", r"gh[oprsu]_", r"[A-Za-z0-9]+", 36, r"gh[oprsu]_[A-Za-z0-9]"),
    Rule("chat", r"xox[abprs]-", r"[A-Za-z0-9-]+", 10, r"xox[abprs]-"),
    Rule("jwt", r"eyJ[A-Za-z0-9_-]+\.eyJ[A-Za-z0-9_-]+\.", r"[A-Za-z0-9_-]+", 16, r"eyJ"),
    Rule("url", r"(https?|ftp|ssh|redis|mysql|postgres|postgresql|mongodb|amqp)://[A-Za-z0-9_.-]+:", r"[A-Za-z0-9_.!~*-]+@", 4, r"://"),
)


class _Parser:
    """Regular expressions with literals, escapes, classes, ``( | )``, ``? * +`` and ``{n}``, into Thompson form."""

    def __init__(self) -> None:
        self.empty: list[list[int]] = []
        self.move: list[tuple[frozenset[int], int] | None] = []

    def state(self) -> int:
        self.empty.append([])
        self.move.append(None)
        return len(self.empty) - 1

    def parse(self, pattern: str) -> tuple[int, int]:
        self.text, self.at = pattern.encode(), 0
        out = self._either()
        if self.at != len(self.text):
            raise ValueError(f"unexpected {chr(self.text[self.at])!r} at {self.at}")
        return out

    def _peek(self) -> str:
        return chr(self.text[self.at]) if self.at < len(self.text) else ""

    def _either(self) -> tuple[int, int]:
        ways = [self._sequence()]
        while self._peek() == "|":
            self.at += 1
            ways.append(self._sequence())
        if len(ways) == 1:
            return ways[0]
        a, b = self.state(), self.state()
        for x, y in ways:
            self.empty[a].append(x)
            self.empty[y].append(b)
        return a, b

    def _sequence(self) -> tuple[int, int]:
        a = b = self.state()
        while self._peek() not in ("", "|", ")"):
            x, y = self._repeated()
            self.empty[b].append(x)
            b = y
        return a, b

    def _repeated(self) -> tuple[int, int]:
        begin = self.at
        x, y = self._atom()
        end, sign = self.at, self._peek()
        if sign == "{":
            close = self.text.index(b"}", self.at)
            for _ in range(int(self.text[self.at + 1 : close]) - 1):
                self.at = begin
                p, q = self._atom()
                self.empty[y].append(p)
                y = q
            self.at = close + 1
            if self._peek() in ("?", "*", "+") or end > close:
                raise ValueError("a count can't be repeated")
        elif sign and sign in "?*+":
            self.at += 1
            a, b = self.state(), self.state()
            self.empty[a].append(x)
            self.empty[y].append(b)
            if sign != "+":
                self.empty[a].append(b)
            if sign != "?":
                self.empty[y].append(x)
            return a, b
        return x, y

    def _atom(self) -> tuple[int, int]:
        c = self._peek()
        self.at += 1
        if c == "(":
            out = self._either()
            self.at += 1
            return out
        if c == "[":
            close = self.text.index(b"]", self.at)
            body, self.at = self.text[self.at : close], close + 1
            kept, i = set(), 0
            while i < len(body):
                if i + 2 < len(body) and body[i + 1] == 45:
                    kept.update(range(body[i], body[i + 2] + 1))
                    i += 3
                else:
                    kept.add(body[i])
                    i += 1
            return self._one(frozenset(kept))
        if c == "\\":
            c = self._peek()
            self.at += 1
            if c == "x":
                c = chr(int(self.text[self.at : self.at + 2], 16))
                self.at += 2
        return self._one(frozenset([ord(c)]))

    def _one(self, kept: frozenset[int]) -> tuple[int, int]:
        a, b = self.state(), self.state()
        self.move[a] = (kept, b)
        return a, b


@dataclass(frozen=True)
class Automaton:
    """``rows[state][byte]`` is the next state, -1 for none; ``accepts[state]`` has a bit for each pattern.

    States that accept have the highest numbers, from ``accepting`` on; 0 is the start unless it accepts.
    """

    rows: tuple[tuple[int, ...], ...]
    accepts: tuple[int, ...]
    start: int
    accepting: int


def compile_patterns(patterns: tuple[str, ...], anywhere: bool) -> Automaton:
    """Subset construction over byte classes, then minimisation. ``anywhere``: a match may begin at any byte."""
    nfa = _Parser()
    ends, root = {}, nfa.state()
    for i, p in enumerate(patterns):
        a, b = nfa.parse(p)
        nfa.empty[root].append(a)
        ends[b] = ends.get(b, 0) | 1 << i

    @cache
    def closed(state: int) -> frozenset[int]:
        seen, todo = {state}, [state]
        while todo:
            for x in nfa.empty[todo.pop()]:
                if x not in seen:
                    seen.add(x)
                    todo.append(x)
        return frozenset(x for x in seen if nfa.move[x] or x in ends)

    # Bytes that no pattern tells apart share a class.
    kinds = [{i for i, m in enumerate(nfa.move) if m and b in m[0]} for b in range(256)]
    classes: dict[frozenset[int], int] = {}
    of = [classes.setdefault(frozenset(k), len(classes)) for k in kinds]
    sample = [of.index(c) for c in range(len(classes))]
    begin = closed(root)
    number, todo, moves = {begin: 0}, [begin], []
    while todo:
        here = todo.pop(0)
        row = []
        for b in sample:
            there = frozenset().union(*(closed(m[1]) for x in here if (m := nfa.move[x]) and b in m[0]), begin if anywhere else ())
            if not there:
                row.append(-1)
                continue
            if there not in number:
                number[there] = len(number)
                todo.append(there)
            row.append(number[there])
        moves.append(row)
    said = [0] * len(number)
    for states, k in number.items():
        for x in states:
            said[k] |= ends.get(x, 0)
    # Partition refinement: states stay together while they accept alike and lead to the same parts.
    part = said[:]
    while True:
        ids: dict[tuple, int] = {}
        new = [ids.setdefault((part[k], *(part[x] if x >= 0 else None for x in row)), len(ids)) for k, row in enumerate(moves)]
        if len(ids) == len(set(part)):
            break
        part = new
    ids = {}
    part = [ids.setdefault(p, len(ids)) for p in part]
    member = {p: k for k, p in reversed(list(enumerate(part)))}
    order = sorted(member, key=lambda p: (bool(said[member[p]]), p))
    name = {p: i for i, p in enumerate(order)}
    rows = tuple(tuple(name[part[x]] if (x := moves[member[p]][of[b]]) >= 0 else -1 for b in range(256)) for p in order)
    accepts = tuple(said[member[p]] for p in order)
    return Automaton(rows, accepts, name[part[0]], sum(not x for x in accepts))


class Scanner:
    """The compiled rules."""

    def __init__(self, rules: tuple[Rule, ...] = RULES) -> None:
        self.rules = rules
        self.all = compile_patterns(tuple(r.trigger for r in rules), anywhere=True)
        self.own = [(compile_patterns((r.head,), False) if r.head else None, compile_patterns((r.tail,), False)) for r in rules]

    def occurring(self, data: bytes) -> int:
        """The one pass: a bit for each rule whose trigger occurs."""
        rows, accepts, least, found = self.all.rows, self.all.accepts, self.all.accepting, 0
        state = self.all.start
        for b in data:
            state = rows[state][b]
            if state >= least:
                found |= accepts[state]
        return found

    @staticmethod
    def _longest(a: Automaton, data: bytes, at: int, dead: set[tuple[int, int]] | None = None) -> int:
        """End of the longest match at a place, -1 for none. ``dead``: places and states from which nothing more is accepted; grows."""
        rows, least, state = a.rows, a.accepting, a.start
        end = at if state >= least else -1
        passed = []
        for i in range(at, len(data)):
            if dead is not None and not i & 63:  # runs that met stay together, so a mark at every 64th byte is enough
                if (i, state) in dead:
                    break
                passed.append((i, state))
            state = rows[state][data[i]]
            if state < 0:
                break
            if state >= least:
                end = i + 1
        if passed:
            dead.update(x for x in passed if x[0] >= end)
        return end

    def spans(self, data: bytes) -> list[tuple[int, int, int]]:
        """(start, number of the rule, end) in bytes, sorted."""
        found, out = self.occurring(data), []
        for k, rule in enumerate(self.rules):
            if not found >> k & 1:
                continue
            head, tail = self.own[k]
            lead = (head or tail).rows[(head or tail).start]
            may = bytes(b for b in range(256) if lead[b] >= 0)
            at, n = 0, len(data)
            heads, tails = (None, None) if rule.base else (set(), set())
            is_lead = [b in may for b in range(256)]
            while at < n:
                if not is_lead[data[at]]:
                    at += 1
                    continue
                middle = self._longest(head, data, at, heads) if head else at
                end = self._longest(tail, data, middle, tails) if middle >= 0 else -1
                if end <= at:
                    at += 1
                    continue
                if end - middle >= rule.least:
                    out.append((at, k, end))
                at = end
        return sorted(out)


OUT = "doc_id long, n_assign long, n_access long, n_hex long, base_sha256 string, spans string"


def scan_secrets(docs: DataFrame, rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """A row for each document: base counts, the digest of the base spans, and all spans in code points."""
    state: dict[str, Scanner] = {}

    def scan(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
        if "scanner" not in state:
            state["scanner"] = Scanner(rules)
        scanner = state["scanner"]
        ids, rows = batch.column("doc_id").cast(pa.int64()), []
        for text in batch.column("text"):
            data = memoryview(text.as_buffer()).tobytes() if text.is_valid else b""
            spans, told, counts = scanner.spans(data), [], dict.fromkeys(("assign", "access", "hex"), 0)
            point = at = 0
            begins = {}
            for place in sorted({p for s, _, e in spans for p in (s, e)}):
                point += len(data[at:place].decode())
                begins[place], at = point, place
            for s, k, e in spans:
                told.append((rules[k], f"{rules[k].kind}:{begins[s]}:{begins[e]}"))
                if rules[k].base:
                    counts[rules[k].kind] += 1
            base = ",".join(t for r, t in told if r.base)
            rows.append((*counts.values(), hashlib.sha256(base.encode()).hexdigest(), ",".join(t for _, t in told)))
        cols = list(zip(*rows, strict=True)) if rows else [[]] * 5
        kinds = (pa.int64(),) * 3 + (pa.string(),) * 2
        yield pa.RecordBatch.from_arrays([ids, *(pa.array(c, t) for c, t in zip(cols, kinds, strict=True))], ["doc_id", "n_assign", "n_access", "n_hex", "base_sha256", "spans"])

    return map_rows(docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")), scan, OUT)
