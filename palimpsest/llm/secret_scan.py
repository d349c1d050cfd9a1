"""Secrets by one deterministic automaton for all rules, scanned in one pass over the bytes of a text.

Rules are regular expressions over ASCII. They are compiled to one automaton that finds the ends of every rule's matches
anywhere (Thompson construction, subset construction, minimisation) and for each rule to one that extends a match and one that
runs backwards to its start. Transitions are arrays over classes of bytes that no rule tells apart.
"""

from __future__ import annotations

from collections import defaultdict
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from .common import map_texts, spans_replaced


@dataclass(frozen=True)
class Rule:
    """A pattern, perhaps after a leading one, and what a match must have besides: so many characters behind the leading pattern."""

    kind: str
    pattern: str
    least: int = 1
    lead: str = ""


_KEYWORD = "|".join("".join(f"[{c}{c.upper()}]" if c.isalpha() else c for c in w) for w in ("password", "passwd", "secret", "token", "api_?key"))
BASE = [
    Rule("assign", "[A-Za-z0-9+/_.=-]+", least=8, lead=rf"({_KEYWORD})[\"']?\x20*[:=]\x20*[\"']?"),
    Rule("access", "AKIA[A-Z0-9]+", least=16),
    Rule("hex", "[0-9a-f]{32,}"),
]
ADDED = [
    Rule("forge", "gh[pousr]_[A-Za-z0-9]+", least=40),
    Rule("chat", "xox[abprs]-[A-Za-z0-9-]+", least=20),
    Rule("payment", "[rs]k_live_[A-Za-z0-9]+", least=24),
    Rule("webtoken", r"eyJ[A-Za-z0-9_-]+\.eyJ[A-Za-z0-9_-]+\.[A-Za-z0-9_-]+", least=40),
    Rule("private_key", "-----BEGIN ([A-Z]+ )*PRIVATE KEY-----"),
]


# Regular expressions as trees: ("set", bytes), ("cat", parts), ("alt", parts), ("rep", part, least, most or None).


def _class(body: str) -> frozenset[int]:
    out, i = set(), 0
    while i < len(body):
        if i + 2 < len(body) and body[i + 1] == "-":
            out.update(range(ord(body[i]), ord(body[i + 2]) + 1))
            i += 3
        else:
            out.add(ord(body[i]))
            i += 1
    return frozenset(out)


def parse(pattern: str) -> tuple:
    """The tree of a pattern: literals, classes, groups, alternatives, ? * + {m,n}, and escapes of single characters or \\xHH."""
    at = 0

    def alternatives() -> tuple:
        nonlocal at
        parts = [sequence()]
        while at < len(pattern) and pattern[at] == "|":
            at += 1
            parts.append(sequence())
        return parts[0] if len(parts) == 1 else ("alt", parts)

    def sequence() -> tuple:
        nonlocal at
        parts = []
        while at < len(pattern) and pattern[at] not in "|)":
            parts.append(repeated(atom()))
        return ("cat", parts)

    def atom() -> tuple:
        nonlocal at
        c = pattern[at]
        at += 1
        if c == "(":
            inside = alternatives()
            at += 1
            return inside
        if c == "[":
            end = pattern.index("]", at)
            body, at = pattern[at:end], end + 1
            return ("set", _class(body.replace('\\"', '"')))
        if c == "\\":
            c = pattern[at]
            at += 1
            if c == "x":
                at += 2
                return ("set", frozenset([int(pattern[at - 2 : at], 16)]))
        return ("set", frozenset([ord(c)]))

    def repeated(part: tuple) -> tuple:
        nonlocal at
        while at < len(pattern) and pattern[at] in "?*+{":
            c = pattern[at]
            at += 1
            if c == "{":
                end = pattern.index("}", at)
                low, comma, high = pattern[at:end].partition(",")
                at = end + 1
                part = ("rep", part, int(low), (int(high) if high else None) if comma else int(low))
            else:
                part = ("rep", part, int(c == "+"), 1 if c == "?" else None)
        return part

    return alternatives()


def reverse(tree: tuple) -> tuple:
    """The tree of the reversed strings."""
    if tree[0] == "cat":
        return ("cat", [reverse(x) for x in reversed(tree[1])])
    if tree[0] == "alt":
        return ("alt", [reverse(x) for x in tree[1]])
    return ("rep", reverse(tree[1]), *tree[2:]) if tree[0] == "rep" else tree


class _Graph:
    """A nondeterministic automaton in pieces."""

    def __init__(self) -> None:
        self.steps: list[list[tuple[frozenset[int], int]]] = []
        self.free: list[list[int]] = []

    def state(self) -> int:
        self.steps.append([])
        self.free.append([])
        return len(self.steps) - 1

    def add(self, tree: tuple, start: int) -> int:
        """Append what the tree matches; returns its last state."""
        if tree[0] == "set":
            end = self.state()
            self.steps[start].append((tree[1], end))
            return end
        if tree[0] == "cat":
            for x in tree[1]:
                start = self.add(x, start)
            return start
        if tree[0] == "alt":
            end = self.state()
            for x in tree[1]:
                first = self.state()
                self.free[start].append(first)
                self.free[self.add(x, first)].append(end)
            return end
        _, part, least, most = tree
        for _ in range(least):
            start = self.add(part, start)
        end = self.state()
        self.free[start].append(end)
        if most is None:
            loop = self.state()
            self.free[start].append(loop)
            back = self.add(part, loop)
            self.free[back] += [loop, end]
        for _ in range((most or least) - least):
            start = self.add(part, start)
            self.free[start].append(end)
        return end

    def closure(self, states) -> frozenset[int]:
        todo, seen = list(states), set(states)
        while todo:
            for x in self.free[todo.pop()]:
                if x not in seen:
                    seen.add(x)
                    todo.append(x)
        return frozenset(seen)


class Automaton:
    """A minimal deterministic automaton over byte classes, as one flat array.

    `move[state + class]` is the next state, a multiple of the number of classes. States from `accepting` on accept; `marks` has
    the rules that each accepts. State 0 is the start; in an anchored automaton `dead` is the state of no return, else -1.
    """

    def __init__(self, trees: list[tuple], anywhere: bool) -> None:
        graph = _Graph()
        start = graph.state()
        ends = {}
        for i, tree in enumerate(trees):
            first = graph.state()
            graph.free[start].append(first)
            ends[graph.add(tree, first)] = i
        self.classes, width, samples = self._classes(graph)
        table, marks = self._subsets(graph, start, ends, samples, anywhere)
        table, marks = self._minimal(table, marks)
        order = [0, *sorted(range(1, len(table)), key=lambda s: bool(marks[s]))]
        place = {s: i * width for i, s in enumerate(order)}
        self.width = width
        self.move = [place[t] for s in order for t in table[s]]
        self.marks = [marks[s] for s in order]
        self.accepting = next((i for i, m in enumerate(self.marks) if m), len(order)) * width
        self.dead = next((place[s] for s in range(len(table)) if not marks[s] and all(t == s for t in table[s])), -1)

    @staticmethod
    def _classes(graph: _Graph) -> tuple[bytes, int, list[int]]:
        """The class of each byte, the number of classes, and a byte of each."""
        sets = sorted({s for steps in graph.steps for s, _ in steps}, key=sorted)
        kinds: dict[tuple, int] = {}
        classes = [kinds.setdefault(tuple(b in s for s in sets), len(kinds)) for b in range(256)]
        return bytes(classes), len(kinds), [classes.index(k) for k in range(len(kinds))]

    @staticmethod
    def _subsets(graph: _Graph, start: int, ends: dict[int, int], samples: list[int], anywhere: bool) -> tuple[list[list[int]], list[frozenset]]:
        """Subset construction; `anywhere` lets a match start at every byte."""
        first = graph.closure([start])
        names, todo, table = {first: 0}, [first], []
        while len(table) < len(names):
            now = todo[len(table)]
            row = []
            for b in samples:
                after = graph.closure({t for s in now for bytes_, t in graph.steps[s] if b in bytes_}) | (first if anywhere else frozenset())
                if after not in names:
                    names[after] = len(names)
                    todo.append(after)
                row.append(names[after])
            table.append(row)
        return table, [frozenset(ends[s] for s in state if s in ends) for state in todo]

    @staticmethod
    def _minimal(table: list[list[int]], marks: list[frozenset]) -> tuple[list[list[int]], list[frozenset]]:
        """Merge states that no string tells apart, by refining their partition."""
        kinds: dict = {}
        part = [kinds.setdefault(m, len(kinds)) for m in marks]
        while True:
            kinds = {}
            finer = [kinds.setdefault((part[s], *[part[t] for t in table[s]]), len(kinds)) for s in range(len(table))]
            if len(kinds) == len(set(part)):
                break
            part = finer
        one = {}
        for s, p in enumerate(finer):
            one.setdefault(p, s)
        return [[finer[t] for t in table[one[p]]] for p in range(len(one))], [marks[one[p]] for p in range(len(one))]

    def longest(self, data: bytes, at: int, stop: int, step: int = 1) -> int | None:
        """Where the longest match from `at` ends, going by `step` up to `stop`; None if there is none."""
        move, kinds, state, found = self.move, self.classes, 0, None
        while at != stop and state != self.dead:
            state = move[state + kinds[data[at]]]
            at += step
            if state >= self.accepting:
                found = at
        return found


class Scanner:
    """All rules in one automaton, and each rule's own in both directions."""

    def __init__(self, rules: list[Rule]) -> None:
        trees = [parse(r.lead + r.pattern) for r in rules]
        self.rules = rules
        self.all = Automaton(trees, anywhere=True)
        self.forward = [Automaton([t], anywhere=False) for t in trees]
        self.backward = [Automaton([reverse(t)], anywhere=False) for t in trees]
        self.leads = [Automaton([parse(r.lead)], anywhere=False) if r.lead else None for r in rules]

    def ends(self, data: bytes) -> dict[int, list[tuple[int, int]]]:
        """For each rule the ranges of places behind bytes at which matches end, in one pass over the bytes."""
        move, accepting, marks, width = self.all.move, self.all.accepting, self.all.marks, self.all.width
        state, seen, at = 0, [], 0
        for at, kind in enumerate(data.translate(self.all.classes), 1):
            state = move[state + kind]
            if state >= accepting:
                seen.append((at, state))
        out: dict[int, list[tuple[int, int]]] = defaultdict(list)
        for at, state in seen:
            for rule in marks[state // width]:
                runs = out[rule]
                if runs and runs[-1][1] == at - 1:
                    runs[-1] = (runs[-1][0], at)
                else:
                    runs.append((at, at))
        return out

    def spans(self, data: bytes) -> list[tuple[int, int, int]]:
        """(start, rule, end) in bytes of each rule's leftmost longest matches, which do not overlap, by start and rule.

        Of the matches that are still to come the one whose shortest form ends first is next; it starts as far left as it can.
        """
        found = []
        for rule, runs in self.ends(data).items():
            past = 0
            for first, last in runs:
                at = max(first, past + 1)
                while at <= last:
                    before = self.backward[rule].longest(data, at - 1, past - 1, -1)
                    if before is None:
                        at += 1
                        continue
                    past = self.forward[rule].longest(data, before + 1, len(data))
                    if self._counts(rule, data, before + 1, past):
                        found.append((before + 1, rule, past))
                    at = max(at, past) + 1
        return sorted(found)

    def _counts(self, rule: int, data: bytes, start: int, end: int) -> bool:
        lead = self.leads[rule]
        return end - (lead.longest(data, start, end) if lead else start) >= self.rules[rule].least

    def __call__(self, texts: pa.Array) -> pa.Array:
        return pa.array([self.located(t.as_py()) for t in texts], _SPANS)

    def located(self, text: str | None) -> list[dict]:
        """The spans of a text in code points, the end exclusive."""
        data = (text or "").encode()
        spans = self.spans(data)
        ascii_only = len(data) == len(text or "")
        out, before, points = [], 0, 0
        for start, rule, end in spans:
            if ascii_only:
                points = start
            else:
                points += len(data[before:start].decode())
                before = start
            out.append({"start": points, "rank": rule, "end": points + end - start, "kind": self.rules[rule].kind})  # matches are ASCII
        return out


_SPANS = pa.list_(pa.struct([("start", pa.int32()), ("rank", pa.int32()), ("end", pa.int32()), ("kind", pa.string())]))
_SPANS_SQL = "array<struct<start:int,rank:int,end:int,kind:string>>"


def find_secrets(docs: DataFrame, text_col: str = "text", rules: list[Rule] | None = None, keep: list[str] | None = None) -> DataFrame:
    """For every row: `row` (the columns in `keep`, all by default) and `spans`, an array of (start, rank, end, kind) by start and rule.

    Places are code points, the end exclusive. Null counts as empty; empty texts have an empty array; repeated rows get the
    same result each; an empty table gives an empty result. Column names cannot clash, as the input's stay in `row`.
    """
    rules = BASE + ADDED if rules is None else rules
    found = map_texts(docs, text_col, lambda: Scanner(rules), T._parse_datatype_string(_SPANS_SQL), keep)
    return found.withColumnRenamed("out", "spans")


def masked(docs: DataFrame, text_col: str = "text", rules: list[Rule] | None = None) -> DataFrame:
    """`docs` with every secret in `text_col` replaced by [KIND]; those that overlap are replaced together, by the first one's kind."""
    return spans_replaced(find_secrets(docs, text_col, rules), text_col, docs.columns)
