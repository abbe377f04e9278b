"""Regular expressions to one minimal byte automaton.

A rule's regex (literals, escapes, classes, groups, ``|``, ``? * +``, ``{m}``, ``{m,}``, ``{m,n}`` and ``(?i:...)``
for ASCII letters) becomes a nondeterministic automaton, subset construction over byte classes makes it
deterministic, and partition refinement makes it minimal. Automata that each watch for one rule in a whole text
are joined to one that watches for all. Only numpy arrays remain.
"""

from __future__ import annotations

import functools
import operator
import re
from collections.abc import Callable
from dataclasses import dataclass

import numpy as np

ALL = frozenset(range(256))


class _Nfa:
    """States with byte edges and free edges, built from a regex by recursive descent."""

    def __init__(self) -> None:
        self.edges: list[list[tuple[frozenset[int], int]]] = []
        self.free: list[list[int]] = []

    def state(self) -> int:
        self.edges.append([])
        self.free.append([])
        return len(self.edges) - 1

    def rule(self, regex: str) -> tuple[int, int]:
        self.text, self.at, self.fold = regex, 0, False
        made = self._choice()
        if self.at != len(regex):
            raise ValueError(f"unexpected {regex[self.at]!r} at {self.at} of {regex!r}")
        return made

    def unit(self, regex: str) -> frozenset[int]:
        """The characters of a class by itself."""
        self.text, self.at, self.fold = regex, 0, False
        chars = frozenset(self._class())
        assert self.at == len(regex), regex
        return chars

    def turn(self) -> None:
        """Every edge leads the other way."""
        edges, free = [[] for _ in self.edges], [[] for _ in self.free]
        for s, (out, idle) in enumerate(zip(self.edges, self.free, strict=True)):
            for chars, t in out:
                edges[t].append((chars, s))
            for t in idle:
                free[t].append(s)
        self.edges, self.free = edges, free

    def classes(self) -> tuple[np.ndarray, list[int]]:
        """(class of each byte, one byte of each class): bytes of a class are on the same edges."""
        sets = sorted({chars for edges in self.edges for chars, _ in edges}, key=sorted)
        marks: dict[tuple, int] = {}
        classes = np.array([marks.setdefault(tuple(b in s for s in sets), len(marks)) for b in range(256)])
        return classes, [int(np.flatnonzero(classes == c)[0]) for c in range(len(marks))]

    def after(self, states: frozenset[int], byte: int) -> set[int]:
        return {t for s in states for chars, t in self.edges[s] if byte in chars}

    def closed(self, states: set[int]) -> set[int]:
        """``states`` and what free edges reach from them."""
        todo, seen = list(states), set(states)
        while todo:
            for t in self.free[todo.pop()]:
                if t not in seen:
                    seen.add(t)
                    todo.append(t)
        return seen

    def _peek(self) -> str:
        return self.text[self.at : self.at + 1]

    def _choice(self) -> tuple[int, int]:
        a, b = self.state(), self.state()
        while True:
            x, y = self._sequence()
            self.free[a].append(x)
            self.free[y].append(b)
            if self._peek() != "|":
                return a, b
            self.at += 1

    def _sequence(self) -> tuple[int, int]:
        a = b = self.state()
        while self._peek() not in ("", "|", ")"):
            begin = self.at
            x, y = self._atom()
            end, least, most = self.at, 1, 1
            if m := re.compile(r"\?|\*|\+|\{(\d+)(,?)(\d*)\}").match(self.text, self.at):
                self.at = m.end()
                sign = m[0][0]
                least = int(m[1]) if sign == "{" else int(sign == "+")
                most = {"?": 1, "*": None, "+": None}.get(sign, int(m[3]) if m[3] else None if m[2] else least) if m[0] else 1
            after = self.at
            for k in range(max(least, most or least + 1)):
                if k:  # a copy of the atom, read again
                    self.at = begin
                    x, y = self._atom()
                    assert self.at == end
                self.free[b].append(x)
                out = self.state()
                self.free[y].append(out)
                if k >= least:
                    self.free[b].append(out)
                if most is None and k >= least:
                    self.free[y].append(x)
                b = out
            self.at = after
        return a, b

    def _atom(self) -> tuple[int, int]:
        c = self.text[self.at]
        if c == "(":
            fold = self.fold
            if self.text.startswith("(?i:", self.at):
                self.at, self.fold = self.at + 4, True
            else:
                self.at += 1
            made = self._choice()
            assert self._peek() == ")", self.text
            self.at, self.fold = self.at + 1, fold
            return made
        chars = self._class() if c == "[" else {self._char()}
        if self.fold:
            chars = {y for x in chars for y in ((x, x ^ 32) if 65 <= x & ~32 <= 90 else (x,))}
        a, b = self.state(), self.state()
        self.edges[a].append((frozenset(chars), b))
        return a, b

    def _char(self) -> int:
        c = self.text[self.at]
        if c != "\\":
            self.at += 1
            return ord(c)
        if self.text[self.at + 1] == "x":
            self.at += 4
            return int(self.text[self.at - 2 : self.at], 16)
        self.at += 2
        return ord(self.text[self.at - 1])

    def _class(self) -> set[int]:
        self.at += 1
        other = self._peek() == "^"
        self.at += other
        chars: set[int] = set()
        while self._peek() != "]":
            lo = hi = self._char()
            if self._peek() == "-" and self.text[self.at + 1] != "]":
                self.at += 1
                hi = self._char()
            chars.update(range(lo, hi + 1))
        self.at += 1
        return set(ALL - chars) if other else chars


@dataclass
class Dfa:
    """classes: byte -> class. table: (state, class) -> state; state 0 is dead, ``start`` begins. accept: bit k of a state is rule k."""

    classes: np.ndarray
    table: np.ndarray
    accept: np.ndarray
    start: int

    def flat(self) -> tuple[bytes, list[int], list[int], int]:
        """(byte -> class, state * n + class -> state * n, state * n -> accepted rules, start * n) for a loop over bytes."""
        n = self.table.shape[1]
        accept = [0] * (len(self.accept) * n)
        accept[::n] = self.accept.tolist()
        return self.classes.astype(np.uint8).tobytes(), (self.table * n).reshape(-1).tolist(), accept, self.start * n


def compile_rules(rules: list[str], anywhere: bool = False, backward: bool = False) -> Dfa:
    """One automaton for all rules. anywhere: a rule may begin at each byte; else only at the first. backward: texts are read from their end."""
    nfa = _Nfa()
    made = [nfa.rule(rule) for rule in rules]
    if backward:
        nfa.turn()
        made = [(b, a) for a, b in made]
    begin = nfa.state()
    if anywhere:
        nfa.edges[begin].append((ALL, begin))
    ends: dict[int, int] = {}
    for k, (a, b) in enumerate(made):
        nfa.free[begin].append(a)
        ends[b] = ends.get(b, 0) | 1 << k
    classes, sample = nfa.classes()

    def closed(states: set[int]) -> frozenset[int]:
        return frozenset(s for s in nfa.closed(states) if nfa.edges[s] or s in ends)

    def step(here: frozenset[int], byte: int) -> frozenset[int]:
        return closed(nfa.after(here, byte))

    def accepts(here: frozenset[int]) -> int:
        return functools.reduce(operator.or_, (ends.get(s, 0) for s in here), 0)

    return _subsets(classes, sample, closed({begin}), step, accepts)


def watch_rule(lead: str, unit: str, least: int) -> Dfa:
    """An automaton over whole texts that accepts while a match of ``lead`` and ``unit`` (a class, ``least`` times or more) is open.

    Matches do not overlap: once a match is open all other attempts are given up, and new ones begin with the byte that
    ends it. Of attempts under way the first to open counts; it is the leftmost where no lead
    can hold another. Without a unit a match is its lead, and accepted where it ends; these may overlap.
    """
    nfa = _Nfa()
    a, end = nfa.rule(lead)
    chars = nfa.unit(unit) if unit else frozenset()
    for _ in range(least if unit else 0):
        last, end = end, nfa.state()
        nfa.edges[last].append((chars, end))
    if unit:
        nfa.edges[end].append((chars, end))
    start, alone = frozenset(nfa.closed({a})), frozenset({end})

    def step(here: frozenset[int], byte: int) -> frozenset[int]:
        if unit and here == alone:
            return alone if byte in chars else settled(nfa.after(start, byte))
        return settled(nfa.after(here | start, byte))

    def settled(states: set[int]) -> frozenset[int]:
        seen = frozenset(s for s in nfa.closed(states) if nfa.edges[s] or s == end)
        return alone if unit and end in seen else seen

    return _subsets(*nfa.classes(), frozenset(), step, lambda here: int(end in here))


def joined(watchers: list[Dfa]) -> Dfa:
    """One automaton that runs all ``watchers`` at once; bit k of a state tells whether number k accepts.

    Only pairs of states that some text reaches are made. It is minimal if the watchers are: two of
    its states differ in one watcher's state, which some text tells apart by that watcher's own bit.
    """
    out = watchers[0]
    for k, one in enumerate(watchers[1:], 1):
        _, sample, classes = np.unique(out.classes * one.table.shape[1] + one.classes, return_index=True, return_inverse=True)
        left, right, n = out.table[:, out.classes[sample]], one.table[:, one.classes[sample]], len(one.table)
        pairs = new = np.array([out.start * n + one.start])
        while len(new):
            new = np.setdiff1d(left[new // n] * n + right[new % n], pairs)
            pairs = np.union1d(pairs, new)
        table = np.searchsorted(pairs, left[pairs // n] * n + right[pairs % n])
        accept = out.accept[pairs // n] | one.accept[pairs % n] << k
        out = Dfa(classes, table, accept, int(np.searchsorted(pairs, out.start * n + one.start)))
    return out


def _subsets(classes: np.ndarray, sample: list[int], start: frozenset[int], step: Callable, accepts: Callable) -> Dfa:
    """Subset construction from ``start``, then partition refinement. The empty set becomes state 0."""
    number: dict[frozenset[int], int] = {frozenset(): 0}
    number.setdefault(start, len(number))
    todo, table = list(number), {}
    while todo:
        here = todo.pop()
        row = [step(here, byte) for byte in sample]
        for after in row:
            if after not in number:
                number[after] = len(number)
                todo.append(after)
        table[number[here]] = [number[after] for after in row]
    full = np.array([table[i] for i in range(len(number))])
    accept = np.array([accepts(states) for states in number], np.int64)
    group = np.unique(accept, return_inverse=True)[1]
    while True:
        finer = np.unique(np.column_stack([group, group[full]]), axis=0, return_inverse=True)[1].reshape(-1)
        if finer.max() == group.max():
            break
        group = finer
    _, first = np.unique(group, return_index=True)
    rename = np.argsort(np.argsort(first))  # state 0 is first of its group
    new = rename[group]
    keep = np.sort(first)
    return Dfa(classes, new[full[keep]], accept[keep], int(new[number[start]]))
