"""Rule regexes -> one minimal deterministic automaton over bytes, and a batch scan with it.

The regex subset: literals, escapes ``\\xHH \\d \\w \\s``, ``.``, classes, groups, ``(?i:...)``,
``|``, ``? * +`` and ``{m}``, ``{m,}``, ``{m,n}``.  No anchors, no back-references.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np

Node = tuple


class Regex:
    """Recursive-descent reader of the subset: gives a tree of ("set", bytes), ("cat", ...), ("alt", ...), ("rep", node, m, n)."""

    NAMED = {"d": b"0123456789", "s": b" \t\n\r\x0b\x0c", "w": b"ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789_"}

    def __init__(self, source: str):
        self.s, self.i, self.fold = source, 0, False

    def read(self) -> Node:
        tree = self.alternatives()
        if self.i != len(self.s):
            raise ValueError(f"unexpected {self.s[self.i:]!r}")
        return tree

    def peek(self) -> str:
        return self.s[self.i : self.i + 1]

    def take(self, text: str) -> bool:
        if self.s.startswith(text, self.i):
            self.i += len(text)
            return True
        return False

    def alternatives(self) -> Node:
        options = [self.sequence()]
        while self.take("|"):
            options.append(self.sequence())
        return options[0] if len(options) == 1 else ("alt", *options)

    def sequence(self) -> Node:
        parts = []
        while self.peek() and self.peek() not in "|)":
            parts.append(self.repeated(self.atom()))
        return ("cat", *parts)

    def repeated(self, node: Node) -> Node:
        while True:
            if self.take("?"):
                node = ("rep", node, 0, 1)
            elif self.take("*"):
                node = ("rep", node, 0, None)
            elif self.take("+"):
                node = ("rep", node, 1, None)
            elif self.take("{"):
                body, _, rest = self.s[self.i :].partition("}")
                self.i = len(self.s) - len(rest)
                low, comma, high = body.partition(",")
                node = ("rep", node, int(low), int(high) if high else None if comma else int(low))
            else:
                return node

    def atom(self) -> Node:
        if self.take("("):
            outer = self.fold
            if self.take("?i:"):
                self.fold = True
            else:
                self.take("?:")
            tree = self.alternatives()
            if not self.take(")"):
                raise ValueError("missing )")
            self.fold = outer
            return tree
        if self.take("["):
            return ("set", self.folded(self.members()))
        if self.take("."):
            return ("set", frozenset(range(256)) - {10})
        return ("set", self.folded(self.one()))

    def one(self) -> frozenset[int]:
        if self.take("\\"):
            c = self.s[self.i]
            self.i += 1
            if c == "x":
                self.i += 2
                return frozenset([int(self.s[self.i - 2 : self.i], 16)])
            return frozenset(self.NAMED[c] if c in self.NAMED else {"n": b"\n", "t": b"\t", "r": b"\r"}.get(c, c.encode()))
        c = self.s[self.i]
        self.i += 1
        return frozenset([ord(c)])

    def members(self) -> frozenset[int]:
        inverse, found = self.take("^"), set()
        while not self.take("]"):
            low = self.one()
            if self.peek() == "-" and self.s[self.i + 1] != "]":
                self.i += 1
                found |= set(range(min(low), min(self.one()) + 1))
            else:
                found |= low
        return frozenset(range(256)) - found if inverse else frozenset(found)

    def folded(self, members: frozenset[int]) -> frozenset[int]:
        if not self.fold:
            return members
        return members | {b ^ 32 for b in members if 65 <= (b & ~32) <= 90}


class Nfa:
    """Thompson construction; ``backwards`` reads every sequence from its end."""

    def __init__(self, backwards: bool):
        self.backwards, self.empty, self.steps = backwards, [], []

    def state(self) -> int:
        self.empty.append([])
        self.steps.append(None)
        return len(self.empty) - 1

    def add(self, tree: Node, start: int) -> int:
        kind = tree[0]
        if kind == "set":
            end = self.state()
            self.steps[start] = (tree[1], end)
            return end
        if kind == "cat":
            for part in reversed(tree[1:]) if self.backwards else tree[1:]:
                step = self.state()
                self.empty[start].append(step)
                start = self.add(part, step)
            return start
        if kind == "alt":
            end = self.state()
            for option in tree[1:]:
                step = self.state()
                self.empty[start].append(step)
                self.empty[self.add(option, step)].append(end)
            return end
        _, node, low, high = tree
        for _ in range(low):
            step = self.state()
            self.empty[start].append(step)
            start = self.add(node, step)
        if high is None:
            loop, end = self.state(), self.state()
            self.empty[start].append(loop)
            step = self.state()
            self.empty[loop] += [step, end]
            self.empty[self.add(node, step)].append(loop)
            return end
        end = self.state()
        for _ in range(high - low):
            step = self.state()
            self.empty[start] += [step, end]
            start = self.add(node, step)
        self.empty[start].append(end)
        return end

    def closure(self, states: frozenset[int]) -> frozenset[int]:
        found, todo = set(states), list(states)
        while todo:
            for s in self.empty[todo.pop()]:
                if s not in found:
                    found.add(s)
                    todo.append(s)
        return frozenset(found)


@dataclass
class Dfa:
    """``step[state * 256 + byte]`` is the next state times 256; ``accepts[state]`` is a bit set of rules; state 0 starts."""

    step: np.ndarray
    accepts: np.ndarray
    dead: int | None


def _minimise(step: np.ndarray, accepts: np.ndarray) -> Dfa:
    """Moore's refinement: states are split until equal blocks step into equal blocks."""
    _, block = np.unique(accepts, return_inverse=True)
    while True:
        signature = np.concatenate([block[:, None], block[step]], 1)
        _, finer = np.unique(signature, axis=0, return_inverse=True)
        finer = finer.ravel()
        if finer.max() == block.max():
            break
        block = finer
    order = {block[0]: 0}
    for b in block:
        order.setdefault(b, len(order))
    name = np.array([order[b] for b in block])
    small = np.zeros((len(order), 256), np.int64)
    marks = np.zeros(len(order), np.int64)
    small[name] = name[step]
    marks[name] = accepts
    dead = [s for s in range(len(order)) if not marks[s] and (small[s] == s).all()]
    return Dfa((small * 256).astype(np.int32).ravel(), marks, dead[0] if dead else None)


def compile_rules(sources: list[str], backwards: bool = False, search: bool = False) -> Dfa:
    """Subset construction over the union of all rules; with ``search`` a match may begin at any byte."""
    nfa = Nfa(backwards)
    start, ends = nfa.state(), {}
    for k, source in enumerate(sources):
        entry = nfa.state()
        nfa.empty[start].append(entry)
        ends[nfa.add(Regex(source).read(), entry)] = 1 << k
    first = nfa.closure(frozenset([start]))
    known, rows, todo = {first: 0}, [], [first]
    for states in todo:
        to: list[set[int]] = [set(first) if search else set() for _ in range(256)]
        for s in states:
            if nfa.steps[s]:
                members, end = nfa.steps[s]
                for b in members:
                    to[b].add(end)
        row, closed = [], {}
        for group in map(frozenset, to):
            if group not in closed:
                closed[group] = nfa.closure(group)
            if closed[group] not in known:
                known[closed[group]] = len(known)
                todo.append(closed[group])
            row.append(known[closed[group]])
        rows.append(row)
    accepts = np.array([sum(mark for end, mark in ends.items() if end in states) for states in known])
    return _minimise(np.array(rows), accepts)


def scan(dfa: Dfa, data: np.ndarray, lanes: int = 4096) -> tuple[np.ndarray, np.ndarray]:
    """Run a search automaton over ``data`` in one pass; (positions after which it accepts, rule bits).

    The bytes are cut into lanes that step together.  A lane first assumes the start
    state; lanes whose predecessor ends in another state run again until all agree.
    """
    n = len(data)
    if not n:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    width = max(64, -(-n // lanes))
    count = -(-n // width)
    padded = np.zeros(count * width, np.uint8)
    padded[:n] = data
    grid = np.ascontiguousarray(padded.reshape(count, width).T).astype(np.int32)
    marked = dfa.accepts > 0
    flag = np.repeat(marked, 256)
    begin = np.zeros(count, np.int32)
    end = np.zeros(count, np.int32)
    hits: dict[int, tuple[np.ndarray, np.ndarray]] = {}
    todo = np.arange(count)
    while len(todo):
        state = begin[todo]
        columns = grid if len(todo) == count else grid[:, todo]
        rows, where, what = [], [], []
        for t in range(width):
            state = dfa.step.take(state + columns[t])
            hit = flag.take(state)
            if hit.any():
                at = np.flatnonzero(hit)
                rows.append(np.full(len(at), t))
                where.append(at)
                what.append(state[at])
        end[todo] = state
        t, lane, found = (np.concatenate(x) if x else np.zeros(0, np.int64) for x in (rows, where, what))
        lane_of = todo[lane.astype(np.int64)]
        order = np.argsort(lane_of, kind="stable")
        lane_of, t, found = lane_of[order], t[order], found[order]
        for k, lane_no in enumerate(todo):
            a, b = np.searchsorted(lane_of, lane_no), np.searchsorted(lane_of, lane_no, "right")
            hits[int(lane_no)] = (lane_no * width + t[a:b], found[a:b])
        wrong = np.flatnonzero(begin[1:] != end[:-1]) + 1
        begin[wrong] = end[wrong - 1]
        todo = wrong
    place = np.concatenate([hits[k][0] for k in range(count)])
    state = np.concatenate([hits[k][1] for k in range(count)]) // 256
    inside = place < n
    return place[inside].astype(np.int64), dfa.accepts[state[inside].astype(np.int64)]


def alive(dfa: Dfa) -> np.ndarray:
    """For each state a bit set of the rules that still accept there or further on."""
    step = dfa.step.reshape(-1, 256) // 256
    found = dfa.accepts.copy()
    while True:
        more = found | np.bitwise_or.reduce(found[step], 1)
        if np.array_equal(more, found):
            return found
        found = more


def longest(dfa: Dfa, live: np.ndarray, data: bytes, at: int, bit: int) -> int:
    """End of the longest match of one rule of an anchored automaton from ``at``; -1 without one."""
    state, best, step, accepts = 0, -1, dfa.step, dfa.accepts
    for i in range(at, len(data)):
        state = int(step[state * 256 + data[i]]) // 256
        if not live[state] & bit:
            break
        if accepts[state] & bit:
            best = i + 1
    return best
