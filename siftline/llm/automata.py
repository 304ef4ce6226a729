"""Regular expressions compiled together into one deterministic automaton over bytes.

The syntax is the part of common regular expressions that secret rules use:
characters, escapes, classes, groups, alternatives, ``? * + {m} {m,} {m,n}`` and
``(?i:...)``.  Matches found by the automaton are of the longest kind.
"""

from __future__ import annotations

import re
from collections import deque
from dataclasses import dataclass, field

_TOKEN = re.compile(r"\(\?i:|\\x[0-9A-Fa-f]{2}|\\.|\{\d+(?:,\d*)?\}|\[(?:\\x[0-9A-Fa-f]{2}|\\.|[^\]\\])+\]|.", re.S)


def _byte(token: str) -> int:
    if token.startswith("\\x"):
        return int(token[2:], 16)
    return ord(token[1] if token.startswith("\\") else token)


def _members(token: str) -> frozenset[int]:
    """Bytes of a character class."""
    parts = re.findall(r"\\x[0-9A-Fa-f]{2}|\\.|.", token[1:-1], re.S)
    negated = parts[0] == "^"
    parts, found, i = parts[negated:], set(), 0
    while i < len(parts):
        if i + 2 < len(parts) and parts[i + 1] == "-":
            found.update(range(_byte(parts[i]), _byte(parts[i + 2]) + 1))
            i += 3
        else:
            found.add(_byte(parts[i]))
            i += 1
    return frozenset(range(256)) - found if negated else frozenset(found)


def parse(pattern: str) -> tuple:
    """A tree of ("set", bytes), ("cat", items), ("alt", items) and ("rep", item, least, most or None)."""
    tokens = deque(_TOKEN.findall(pattern))

    def one(members: frozenset[int], fold: bool) -> tuple:
        if fold:
            members |= {ord(chr(x).swapcase()) for x in members if chr(x).isascii() and chr(x).isalpha()}
        return ("set", frozenset(members))

    def alternatives(fold: bool) -> tuple:
        branches, items = [], []
        while tokens and tokens[0] != ")":
            token = tokens.popleft()
            if token == "|":
                branches.append(("cat", items))
                items = []
            elif token in ("(", "(?i:"):
                items.append(alternatives(fold or token != "("))
                tokens.popleft()
            elif token in ("?", "*", "+") or token[0] == "{" and len(token) > 1:
                if token[0] == "{":
                    least, comma, most = token[1:-1].partition(",")
                    bounds = int(least), int(most) if most else (None if comma else int(least))
                else:
                    bounds = {"?": (0, 1), "*": (0, None), "+": (1, None)}[token]
                items.append(("rep", items.pop(), *bounds))
            elif token[0] == "[":
                items.append(one(_members(token), fold))
            else:
                items.append(one(frozenset({_byte(token)}), fold))
        branches.append(("cat", items))
        return ("alt", branches)

    return alternatives(False)


def mirrored(tree: tuple) -> tuple:
    """The expression of the reversed strings."""
    kind = tree[0]
    if kind == "set":
        return tree
    if kind == "rep":
        return ("rep", mirrored(tree[1]), *tree[2:])
    items = [mirrored(x) for x in tree[1]]
    return (kind, items[::-1] if kind == "cat" else items)


@dataclass
class _Graph:
    """A nondeterministic automaton: free moves and moves by a byte set."""

    free: list[list[int]] = field(default_factory=list)
    moves: list[list[tuple[frozenset[int], int]]] = field(default_factory=list)

    def state(self) -> int:
        self.free.append([])
        self.moves.append([])
        return len(self.free) - 1

    def add(self, tree: tuple, start: int) -> int:
        """Lets the tree begin in ``start``; the state it ends in."""
        kind = tree[0]
        if kind == "set":
            end = self.state()
            self.moves[start].append((tree[1], end))
        elif kind == "cat":
            end = start
            for item in tree[1]:
                end = self.add(item, end)
        elif kind == "alt":
            end = self.state()
            for item in tree[1]:
                begin = self.state()
                self.free[start].append(begin)
                self.free[self.add(item, begin)].append(end)
        else:
            _, item, least, most = tree
            end = start
            for _ in range(least):
                end = self.add(item, end)
            if most is None:
                loop = self.state()
                self.free[end].append(loop)
                self.free[self.add(item, loop)].append(loop)
                end = loop
            else:
                last = self.state()
                for _ in range(most - least):
                    self.free[end].append(last)
                    end = self.add(item, end)
                self.free[end].append(last)
                end = last
        return end


@dataclass(frozen=True)
class Automaton:
    """Transition array of a minimised automaton.

    ``classes`` maps a byte to its class; states are numbered in steps of
    ``width`` classes, so the next state is ``table[state + class]``.  States
    from ``accepting`` on accept the rules in ``rules[state // width]``.
    """

    classes: bytes
    width: int
    table: list[int]
    start: int
    accepting: int
    rules: list[tuple[int, ...]]


def _closure(graph: _Graph, states) -> frozenset[int]:
    seen, waiting = set(states), list(states)
    while waiting:
        for x in graph.free[waiting.pop()]:
            if x not in seen:
                seen.add(x)
                waiting.append(x)
    return frozenset(seen)


def _byte_classes(graph: _Graph) -> tuple[bytes, list[int]]:
    """Bytes that no rule tells apart share a class; also one byte of each class."""
    sets = {members for moves in graph.moves for members, _ in moves}
    signature: dict[tuple, int] = {}
    classes = bytearray(256)
    for x in range(256):
        classes[x] = signature.setdefault(tuple(x in members for members in sets), len(signature))
    return bytes(classes), [classes.index(k) for k in range(len(signature))]


def _subsets(graph: _Graph, start: int, ends: dict[int, int], anywhere: bool) -> tuple[bytes, list[list[int]], list[tuple[int, ...]]]:
    """Subset construction; ``anywhere`` lets a match begin at every byte."""
    classes, samples = _byte_classes(graph)
    begin = _closure(graph, [start])
    numbers, order, rows = {begin: 0}, [begin], []
    for states in order:
        row = []
        for sample in samples:
            reached = {to for x in states for members, to in graph.moves[x] if sample in members}
            target = _closure(graph, reached | ({start} if anywhere else set()))
            if target not in numbers:
                numbers[target] = len(order)
                order.append(target)
            row.append(numbers[target])
        rows.append(row)
    return classes, rows, [tuple(sorted({ends[x] for x in states if x in ends})) for states in order]


def _minimised(rows: list[list[int]], accepts: list[tuple[int, ...]]) -> tuple[list[list[int]], list[tuple[int, ...]], int]:
    """Merges states that no string tells apart: blocks are split until all successors agree."""
    block = {x: i for i, x in enumerate(sorted(set(accepts)))}
    of = [block[x] for x in accepts]
    while True:
        signatures: dict[tuple, int] = {}
        after = [signatures.setdefault((of[s], *(of[t] for t in rows[s])), len(signatures)) for s in range(len(rows))]
        if len(signatures) == len(set(of)):
            break
        of = after
    count = len(set(of))
    one = {of[s]: s for s in range(len(rows))}
    by_accept = sorted(range(count), key=lambda b: (bool(accepts[one[b]]), b))
    number = {b: i for i, b in enumerate(by_accept)}
    merged = [[number[of[t]] for t in rows[one[b]]] for b in by_accept]
    return merged, [accepts[one[b]] for b in by_accept], number[of[0]]


def compile_rules(trees: list[tuple], anywhere: bool) -> Automaton:
    """One automaton for all expressions; rule numbers are their places in the list."""
    graph = _Graph()
    start = graph.state()
    ends: dict[int, int] = {}
    for k, tree in enumerate(trees):
        begin = graph.state()
        graph.free[start].append(begin)
        ends[graph.add(tree, begin)] = k
    classes, rows, accepts = _subsets(graph, start, ends, anywhere)
    rows, accepts, first = _minimised(rows, accepts)
    width = len(rows[0])
    plain = sum(not x for x in accepts)
    return Automaton(classes, width, [t * width for row in rows for t in row], first * width, plain * width, accepts)


class Scanner:
    """Leftmost, longest, non-overlapping matches of several rules from one pass over the bytes.

    The forward automaton tells where matches of each rule end.  Each run of
    ends is one match, whose start the automaton of the mirrored rule finds by
    reading back from the last end, at most to the end of the match before.
    """

    def __init__(self, patterns: list[str]):
        trees = [parse(x) for x in patterns]
        self.forward = compile_rules(trees, anywhere=True)
        self.backward = [compile_rules([mirrored(x)], anywhere=False) for x in trees]

    def _ends(self, data: bytes) -> dict[int, list[list[int]]]:
        """Runs [first, last] of bytes at which a match of the rule ends."""
        table, state, accepting = self.forward.table, self.forward.start, self.forward.accepting
        classes = data.translate(self.forward.classes)
        for c in classes:
            state = table[state + c]
            if state >= accepting:
                break
        else:
            return {}
        runs: dict[int, list[list[int]]] = {}
        state, width, rules = self.forward.start, self.forward.width, self.forward.rules
        for i, c in enumerate(classes):
            state = table[state + c]
            if state >= accepting:
                for rule in rules[state // width]:
                    own = runs.setdefault(rule, [])
                    if own and own[-1][1] == i - 1:
                        own[-1][1] = i
                    else:
                        own.append([i, i])
        return runs

    def spans(self, data: bytes) -> list[tuple[int, int, int]]:
        """(rule, start, end) in bytes, by rule and place."""
        found = []
        for rule, runs in sorted(self._ends(data).items()):
            machine, floor = self.backward[rule], 0
            for _, last in runs:
                state, start = machine.start, -1
                for at in range(last, floor - 1, -1):
                    state = machine.table[state + machine.classes[data[at]]]
                    if state >= machine.accepting:
                        start = at
                    elif state == self._dead(machine):
                        break
                if start >= 0:
                    found.append((rule, start, last + 1))
                    floor = last + 1
        return found

    @staticmethod
    def _dead(machine: Automaton) -> int:
        """The state that nothing leaves, if there is one."""
        for state in range(0, machine.accepting, machine.width):
            if all(x == state for x in machine.table[state : state + machine.width]):
                return state
        return -1
