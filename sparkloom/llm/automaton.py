"""A small regex compiler: rules to one minimal deterministic automaton in transition arrays.

Syntax: literals, ``\\`` escapes (``\\xHH`` too), ``[...]`` classes with ranges, groups, ``|``, and the
quantifiers ``? * + {m} {m,} {m,n}``.  Patterns are over bytes; ASCII only.
"""

from __future__ import annotations

import numpy as np

Node = tuple  # ("set", frozenset) | ("cat", nodes) | ("alt", nodes) | ("rep", node, least, most or None)


class _Parser:
    def __init__(self, pattern: str, fold: bool):
        self.p, self.i, self.fold = pattern, 0, fold

    def parse(self) -> Node:
        node = self.alternatives()
        if self.i != len(self.p):
            raise ValueError(f"unexpected {self.p[self.i]!r} at {self.i} in {self.p!r}")
        return node

    def peek(self) -> str:
        return self.p[self.i] if self.i < len(self.p) else ""

    def alternatives(self) -> Node:
        options = [self.sequence()]
        while self.peek() == "|":
            self.i += 1
            options.append(self.sequence())
        return options[0] if len(options) == 1 else ("alt", options)

    def sequence(self) -> Node:
        items = []
        while self.peek() not in ("", "|", ")"):
            items.append(self.quantified())
        return ("cat", items)

    def quantified(self) -> Node:
        node = self.atom()
        while (c := self.peek()) and c in "?*+{":
            self.i += 1
            if c == "{":
                end = self.p.index("}", self.i)
                least, _, most = self.p[self.i : end].partition(",")
                node = ("rep", node, int(least), int(most) if most else (None if "," in self.p[self.i : end] else int(least)))
                self.i = end + 1
            else:
                node = ("rep", node, int(c == "+"), 1 if c == "?" else None)
        return node

    def atom(self) -> Node:
        c = self.p[self.i]
        if c == "(":
            self.i += 1
            node = self.alternatives()
            self.i += 1
            return node
        if c == "[":
            return self.bracket()
        return self.one(self.literal())

    def literal(self) -> int:
        c, self.i = self.p[self.i], self.i + 1
        if c != "\\":
            return ord(c)
        c, self.i = self.p[self.i], self.i + 1
        if c == "x":
            self.i += 2
            return int(self.p[self.i - 2 : self.i], 16)
        return ord(c)

    def one(self, *bytes_: int) -> Node:
        both = {ord(f(chr(b))) for b in bytes_ for f in (str.lower, str.upper)} if self.fold else set(bytes_)
        return ("set", frozenset(both))

    def bracket(self) -> Node:
        self.i += 1
        found: set[int] = set()
        while self.peek() != "]":
            a = self.literal()
            if self.peek() == "-" and self.p[self.i + 1] != "]":
                self.i += 1
                found.update(range(a, self.literal() + 1))
            else:
                found.add(a)
        self.i += 1
        return self.one(*found)


class _Nfa:
    """Thompson's construction; ``backwards`` builds the automaton of the reversed language."""

    def __init__(self, backwards: bool = False):
        self.empty: list[list[int]] = []
        self.edges: list[list[tuple[frozenset[int], int]]] = []
        self.backwards = backwards

    def state(self) -> int:
        self.empty.append([])
        self.edges.append([])
        return len(self.empty) - 1

    def add(self, node: Node, at: int) -> int:
        kind = node[0]
        if kind == "set":
            end = self.state()
            self.edges[at].append((node[1], end))
            return end
        if kind == "cat":
            for x in reversed(node[1]) if self.backwards else node[1]:
                at = self.add(x, at)
            return at
        if kind == "alt":
            ends = [self.add(x, at) for x in node[1]]
            end = self.state()
            for e in ends:
                self.empty[e].append(end)
            return end
        _, body, least, most = node
        for _ in range(least):
            at = self.add(body, at)
        if most is None:
            loop = self.state()
            self.empty[at].append(loop)
            self.empty[self.add(body, loop)].append(loop)
            return loop
        end = self.state()
        for _ in range(most - least):
            self.empty[at].append(end)
            at = self.add(body, at)
        self.empty[at].append(end)
        return end

    def closure(self, states) -> frozenset[int]:
        todo, found = list(states), set(states)
        while todo:
            for s in self.empty[todo.pop()]:
                if s not in found:
                    found.add(s)
                    todo.append(s)
        return frozenset(found)


class Dfa:
    """``classes``: byte -> class; ``table[state, class]``; ``accept[state]``: bits of the rules; start 0.

    States that accept anything have the highest numbers, from ``first_accepting`` on."""

    def __init__(self, nfa: _Nfa, start: int, accepts: dict[int, int], search: bool):
        sets = {s for edges in nfa.edges for s, _ in edges}
        kinds: dict[tuple, int] = {}
        ordered = sorted(sets, key=sorted)
        self.classes = np.zeros(256, np.uint8)
        for b in range(256):
            self.classes[b] = kinds.setdefault(tuple(b in s for s in ordered), len(kinds))
        example = {c: b for b, c in reversed(list(enumerate(self.classes.tolist())))}
        begin = nfa.closure([start])
        numbers, rows, queue = {begin: 0}, [], [begin]
        for now in queue:
            row = []
            for c in range(len(kinds)):
                goal = {t for s in now for on, t in nfa.edges[s] if example[c] in on}
                nxt = nfa.closure(goal | ({start} if search else set()))
                if nxt not in numbers:
                    numbers[nxt] = len(numbers)
                    queue.append(nxt)
                row.append(numbers[nxt])
            rows.append(row)
        accept = [sum({1 << accepts[s] for s in now if s in accepts}) for now in queue]
        self._minimise(np.array(rows), np.array(accept))

    def _minimise(self, table: np.ndarray, accept: np.ndarray) -> None:
        """Refine the partition by accepted rules until no block's members go to different blocks."""
        _, block = np.unique(accept, return_inverse=True)
        while True:
            _, finer = np.unique(np.column_stack([block, block[table]]), axis=0, return_inverse=True)
            finer = finer.reshape(-1)
            if finer.max() == block.max():
                break
            block = finer
        kept = [int(np.flatnonzero(block == k)[0]) for k in range(block.max() + 1)]
        kept.sort(key=lambda s: (accept[s] != 0, block[s] != block[0], s))
        rank = {int(block[s]): i for i, s in enumerate(kept)}
        place = np.array([rank[int(b)] for b in block])
        self.table, self.accept = place[table[kept]].astype(np.int32), accept[kept]
        self.first_accepting = int((self.accept == 0).sum())
        sinks = [s for s in range(len(kept)) if not self.accept[s] and (self.table[s] == s).all()]
        self.dead = sinks[0] if sinks else -1


def _shortest(node: Node) -> Node:
    """node without the open end of its last repetition: where a match first may end."""
    if node[0] == "cat" and node[1]:
        return ("cat", [*node[1][:-1], _shortest(node[1][-1])])
    if node[0] == "rep" and node[3] is None:
        return ("rep", node[1], node[2], node[2])
    return node


def compile_rules(patterns: list[tuple[str, bool]]) -> tuple[Dfa, list[Dfa], list[Dfa]]:
    """The automaton that searches for all rules at once, and per rule those of its reversed beginnings
    and of its whole matches; a rule is (pattern, letters in either case).

    The searching one knows the rules without the open end of their last repetition.  Else each state
    would also have to tell which rules' last runs still go on, for all sets of rules."""
    nfa, accepts, backward, forward = _Nfa(), {}, [], []
    start = nfa.state()
    for k, (pattern, fold) in enumerate(patterns):
        node = _Parser(pattern, fold).parse()
        first = nfa.state()
        nfa.empty[start].append(first)
        accepts[nfa.add(_shortest(node), first)] = k
        for backwards, body, out in ((True, _shortest(node), backward), (False, node, forward)):
            own = _Nfa(backwards)
            begin = own.state()
            out.append(Dfa(own, begin, {own.add(body, begin): 0}, search=False))
    return Dfa(nfa, start, accepts, search=True), backward, forward


SEPARATOR = 0xFF  # never in UTF-8; it is in no rule, so it leads back to the start


def scan(dfa: Dfa, data: np.ndarray, lanes: int = 4096, least: int = 1024) -> tuple[np.ndarray, np.ndarray]:
    """(positions, states) where a match may end, over texts joined with ``SEPARATOR``.

    One pass over the bytes: the data is cut into lanes that step together, each from the start state.
    A lane whose predecessor ended in another state is then stepped again from that one, until it meets
    the states it went through before."""
    if not len(data):
        return np.zeros(0, np.int64), np.zeros(0, np.int32)
    width = max(1, min(lanes, len(data) // least))
    long = -(-len(data) // width)
    padded = np.full(width * long, SEPARATOR, np.uint8)
    padded[: len(data)] = data
    steps = np.ascontiguousarray(dfa.classes[padded].reshape(width, long).T).astype(np.int32)
    n = dfa.table.shape[1]
    flat = (dfa.table * n).astype(np.int32).ravel()  # states times n, ready for the next look-up
    went = np.empty((long, width), np.int32)
    state = np.zeros(width, np.int32)
    for i in range(long):
        np.add(state, steps[i], out=state)
        np.take(flat, state, out=went[i])
        state = went[i].copy()
    for k in np.flatnonzero(went[-1, :-1] != 0) + 1 if width > 1 else ():
        k = int(k)
        while k < width and not _resume(flat, steps, went, k):
            k += 1
    at, lane = np.nonzero(went >= dfa.first_accepting * n)
    where = lane.astype(np.int64) * long + at
    order = np.argsort(where)
    return where[order], (went[at, lane] // n)[order]


def _resume(flat: np.ndarray, steps: np.ndarray, went: np.ndarray, k: int) -> bool:
    """Steps lane k from where lane k - 1 ended; False if it ends in another state than before."""
    s = int(went[-1, k - 1])
    for i in range(len(steps)):
        s = int(flat[s + steps[i, k]])
        if s == went[i, k]:
            return True
        went[i, k] = s
    return False


def first_start(back: Dfa, data: bytes, floor: int, end: int) -> int:
    """The leftmost s >= floor where a match may begin that first may end at ``end``, or -1."""
    s, best = 0, -1
    for i in range(end - 1, floor - 1, -1):
        s = int(back.table[s, back.classes[data[i]]])
        if s == back.dead:
            break
        if back.accept[s]:
            best = i
    return best


def last_end(forward: Dfa, data: bytes, start: int) -> int:
    """The end of the longest match from ``start``, or -1."""
    s, best = 0, -1
    for i in range(start, len(data)):
        s = int(forward.table[s, forward.classes[data[i]]])
        if s == forward.dead:
            break
        if forward.accept[s]:
            best = i + 1
    return best
