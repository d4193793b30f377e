"""Rule patterns compiled to deterministic automata: subset construction, minimisation, transition arrays.

Patterns use literals, classes, groups, alternatives and greedy repeats over bytes. They are read with the
standard library's pattern parser; look-around, anchors and back-references are refused.
"""

from __future__ import annotations

from dataclasses import dataclass
from re import _constants as C
from re import _parser

import numpy as np


class _Graph:
    """Nondeterministic automaton: per state its byte moves and its empty moves."""

    def __init__(self) -> None:
        self.moves: list[list[tuple[frozenset[int], int]]] = []
        self.empty: list[list[int]] = []

    def state(self) -> int:
        self.moves.append([])
        self.empty.append([])
        return len(self.moves) - 1

    def add(self, parsed, start: int, fold: bool) -> int:
        """Append a parsed sequence behind `start`; returns its last state."""
        for op, arg in parsed:
            start = self._one(op, arg, start, fold)
        return start

    def _bytes(self, items, fold: bool) -> frozenset[int]:
        found: set[int] = set()
        negate = False
        for op, arg in items:
            if op is C.LITERAL:
                found.add(arg)
            elif op is C.RANGE:
                found.update(range(arg[0], arg[1] + 1))
            elif op is C.NEGATE:
                negate = True
            else:
                raise ValueError(f"class item {op} is not supported")
        if fold:
            found |= {b ^ 0x20 for b in found if chr(b & 0xDF).isalpha() and b < 128}
        return frozenset(range(256)) - found if negate else frozenset(found)

    def _one(self, op, arg, start: int, fold: bool) -> int:
        if op in (C.LITERAL, C.NOT_LITERAL, C.IN):
            items = arg if op is C.IN else [(C.NEGATE, None)] * (op is C.NOT_LITERAL) + [(C.LITERAL, arg)]
            end = self.state()
            self.moves[start].append((self._bytes(items, fold), end))
        elif op is C.SUBPATTERN:
            end = self.add(arg[3], start, fold)
        elif op is C.BRANCH:
            end = self.state()
            for option in arg[1]:
                first = self.state()
                self.empty[start].append(first)
                self.empty[self.add(option, first, fold)].append(end)
        elif op is C.MAX_REPEAT:
            least, most, body = arg
            end = start
            for _ in range(least):
                end = self.add(body, end, fold)
            if most is C.MAXREPEAT:
                loop = self.state()
                self.empty[end].append(loop)
                self.empty[self.add(body, loop, fold)].append(loop)
                end = loop
            else:
                stops = [end]
                for _ in range(most - least):
                    stops.append(self.add(body, stops[-1], fold))
                end = self.state()
                for s in stops:
                    self.empty[s].append(end)
        else:
            raise ValueError(f"{op} is not supported")
        return end

    def closure(self, states) -> frozenset[int]:
        seen, todo = set(states), list(states)
        while todo:
            for t in self.empty[todo.pop()]:
                if t not in seen:
                    seen.add(t)
                    todo.append(t)
        return frozenset(seen)


@dataclass(frozen=True)
class Automaton:
    """next[state, column[byte]] is the next state; accepts[state] has a bit per rule; state 0 is the start.

    An anchored automaton has a dead state, which all bytes keep; a searching one has none.
    """

    next: np.ndarray
    column: np.ndarray
    accepts: np.ndarray
    dead: int

    def resets(self) -> np.ndarray:
        """Per byte, whether it sends every state to the start: text may be cut behind it."""
        return (self.next == 0).all(axis=0)[self.column]


def compile_rules(patterns: list[tuple[str, bool]], searching: bool) -> Automaton:
    """One minimal automaton for patterns (pattern, either case). Searching: matches may begin anywhere."""
    graph = _Graph()
    root, rule_of = graph.state(), {}
    for no, (pattern, fold) in enumerate(patterns):
        first = graph.state()
        graph.empty[root].append(first)
        rule_of[graph.add(_parser.parse(pattern), first, fold)] = 1 << no
    # Bytes that no pattern tells apart share a column.
    sets = sorted({s for moves in graph.moves for s, _ in moves}, key=sorted)
    signs = [tuple(b in s for s in sets) for b in range(256)]
    order = {sign: i for i, sign in enumerate(dict.fromkeys(signs))}
    column = np.array([order[s] for s in signs], np.uint8)
    sample = [signs.index(s) for s in order]

    begin = graph.closure([root])
    number, todo, rows = {begin: 0}, [begin], []
    while len(rows) < len(number):
        here, row = todo[len(rows)], []
        for b in sample:
            to = {t for s in here for chars, t in graph.moves[s] if b in chars}
            reached = graph.closure(to | ({root} if searching else set()))
            if reached not in number:
                number[reached] = len(number)
                todo.append(reached)
            row.append(number[reached])
        rows.append(row)
    following = np.array(rows, np.int32)
    accepts = np.array([sum({rule_of[s] for s in states if s in rule_of}) for states in todo], np.int64)

    # Minimisation: split the classes of equal acceptance until their transitions agree.
    group, count = np.unique(accepts, return_inverse=True)[1], 0
    while count < (count := group.max() + 1):
        group = np.unique(np.column_stack([group, group[following]]), axis=0, return_inverse=True)[1].ravel()
    rank = np.full(count, -1)
    first_of = np.unique(group, return_index=True)[1]
    rank[group[np.sort(first_of)]] = np.arange(count)  # the start stays state 0
    states = np.sort(first_of)
    dead = number.get(frozenset(), -1)
    return Automaton(rank[group[following[states]]].astype(np.int32), column, accepts[states], int(rank[group[dead]]) if dead >= 0 else -1)


def scan(automaton: Automaton, data: np.ndarray, starts: np.ndarray, ends: np.ndarray, width: int = 2048) -> np.ndarray:
    """The rules that match somewhere in each piece data[start:end], as bits: one pass over the bytes.

    Pieces of similar length advance together, a byte at a time, through the transition array.
    """
    cols = automaton.next.shape[1]
    step = np.ascontiguousarray(automaton.next * cols).ravel()  # states as offsets of their rows
    accepts = np.repeat(automaton.accepts, cols)
    accepting = bool(accepts.any())
    found = np.zeros(len(starts), np.int64)
    lengths = ends - starts
    order = np.argsort(-lengths, kind="stable")
    mapped = automaton.column[data]
    for at in range(0, len(order) if accepting else 0, width):
        mine = order[at : at + width]
        first, length = starts[mine], lengths[mine]
        state, seen = np.zeros(len(mine), np.int32), np.zeros(len(mine), np.int64)
        # How many pieces are still running at each step; they are in descending order of length.
        running = np.searchsorted(-length, -np.arange(length[0]), side="left") if len(length) else []
        for t, k in enumerate(running):
            now = step[state[:k] + mapped[first[:k] + t]]
            state[:k] = now
            seen[:k] |= accepts[now]
        found[mine] = seen
    return found


def longest(automaton: Automaton, data: bytes) -> list[tuple[int, int]]:
    """Leftmost, longest, non-overlapping matches of an anchored automaton."""
    rows, accepts, dead = automaton.next[:, automaton.column].tolist(), automaton.accepts.tolist(), automaton.dead
    firsts = [row != dead for row in rows[0]]
    found, at, n = [], 0, len(data)
    while at < n:
        if not firsts[data[at]]:
            at += 1
            continue
        state, last, pos = 0, -1, at
        while pos < n:
            state = rows[state][data[pos]]
            if state == dead:
                break
            pos += 1
            if accepts[state]:
                last = pos
        if last > at:
            found.append((at, last))
        at = max(last, at + 1)
    return found
