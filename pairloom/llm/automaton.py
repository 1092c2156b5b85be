"""Byte automata: regexes to transition arrays, and a scan of many bytes at once.

Thompson construction, subset construction over classes of bytes that no rule
tells apart, and minimisation by partition refinement.  Supported are literals,
classes, groups, alternatives, greedy repeats and (?i:...), all over bytes.
"""

from __future__ import annotations

import re
from dataclasses import dataclass
from re import _constants as op, _parser

import numpy as np

# Never part of UTF-8, so it can stand between texts and reset the scan.
GAP = 0xFF
# So few lanes are corrected one by one.
FEW = 8


def _set_of(items, folded: bool) -> frozenset[int]:
    out: set[int] = set()
    negate = False
    for kind, value in items:
        if kind is op.NEGATE:
            negate = True
        elif kind is op.LITERAL:
            out.add(value)
        elif kind is op.RANGE:
            out.update(range(value[0], value[1] + 1))
        else:
            raise ValueError(f"class item {kind} is not supported")
    if folded:
        out |= {ord(c) for b in out if b < 128 for c in (chr(b).lower(), chr(b).upper())}
    return frozenset(set(range(256)) - {GAP} - out if negate else out)


def _tree(parsed, folded: bool):
    """The parsed regex as nested ("set" | "cat" | "alt" | "repeat", ...) tuples."""
    parts = []
    for kind, value in parsed:
        if kind is op.LITERAL:
            parts.append(("set", _set_of([(op.LITERAL, value)], folded)))
        elif kind is op.NOT_LITERAL:
            parts.append(("set", _set_of([(op.NEGATE, None), (op.LITERAL, value)], folded)))
        elif kind is op.IN:
            parts.append(("set", _set_of(value, folded)))
        elif kind is op.ANY:
            parts.append(("set", _set_of([(op.NEGATE, None), (op.LITERAL, 10)], False)))
        elif kind is op.SUBPATTERN:
            _, add, _, inner = value
            parts.append(_tree(inner, folded or bool(add & re.IGNORECASE)))
        elif kind is op.BRANCH:
            parts.append(("alt", [_tree(x, folded) for x in value[1]]))
        elif kind is op.MAX_REPEAT:
            low, high, inner = value
            parts.append(("repeat", low, None if high is op.MAXREPEAT else high, _tree(inner, folded)))
        else:
            raise ValueError(f"{kind} is not supported")
    return ("cat", parts)


def _mirrored(tree):
    if tree[0] == "cat":
        return ("cat", [_mirrored(x) for x in reversed(tree[1])])
    if tree[0] == "alt":
        return ("alt", [_mirrored(x) for x in tree[1]])
    if tree[0] == "repeat":
        return (*tree[:3], _mirrored(tree[3]))
    return tree


class _Nfa:
    def __init__(self) -> None:
        self.free: list[list[int]] = []
        self.step: list[tuple[frozenset[int], int] | None] = []

    def state(self) -> int:
        self.free.append([])
        self.step.append(None)
        return len(self.free) - 1

    def add(self, tree, start: int) -> int:
        """Adds the tree behind `start`; returns its last state."""
        kind = tree[0]
        if kind == "set":
            here, end = self.state(), self.state()
            self.free[start].append(here)
            self.step[here] = (tree[1], end)
            return end
        if kind == "cat":
            for part in tree[1]:
                start = self.add(part, start)
            return start
        if kind == "alt":
            end = self.state()
            for part in tree[1]:
                self.free[self.add(part, start)].append(end)
            return end
        _, low, high, inner = tree
        for _ in range(low):
            start = self.add(inner, start)
        if high is None:
            loop, end = self.state(), self.state()
            self.free[start].append(loop)
            self.free[self.add(inner, loop)].append(loop)
            self.free[loop].append(end)
            return end
        end = self.state()
        for _ in range(high - low):
            self.free[start].append(end)
            start = self.add(inner, start)
        self.free[start].append(end)
        return end

    def closed(self, states) -> frozenset[int]:
        out, todo = set(states), list(states)
        while todo:
            for other in self.free[todo.pop()]:
                if other not in out:
                    out.add(other)
                    todo.append(other)
        return frozenset(out)


@dataclass(frozen=True)
class Automaton:
    """classes: class of each byte; table[state, class]: next state; accept[state]: bit set of rules.

    State 0 is the start; where the automaton is anchored the last state is dead.
    """

    classes: np.ndarray
    table: np.ndarray
    accept: np.ndarray
    dead: int

    def last_accept(self, data: bytes, start: int, stop: int, step: int) -> int:
        """The furthest place, reading from start towards stop, at which it accepts; -1 if it never does.

        Backwards, `start` and `stop` are ends of prefixes, as in slices.
        """
        found, state, at = -1, 0, start
        table, classes, accept, dead = self.table, self.classes, self.accept, self.dead
        while at != stop:
            state = int(table[state, classes[data[at if step > 0 else at - 1]]])
            if state == dead:
                break
            at += step
            if accept[state]:
                found = at
        return found

    def first_accept(self, data: bytes, start: int) -> int:
        """The first place, reading on from start, at which an unanchored automaton accepts; -1 if it never does."""
        state = 0
        table, classes, accept = self.table.tolist(), self.classes.tolist(), self.accept.tolist()
        for at in range(start, len(data)):
            state = table[state][classes[data[at]]]
            if accept[state]:
                return at + 1
        return -1


def compile_rules(patterns: list[str], anchored: bool = False, mirrored: bool = False) -> Automaton:
    """One minimal automaton for all patterns; unanchored, it accepts at each end of each match."""
    nfa, starts, ends = _Nfa(), [], {}
    for bit, pattern in enumerate(patterns):
        tree = _tree(_parser.parse(pattern.encode()), False)
        starts.append(nfa.state())
        ends[nfa.add(_mirrored(tree) if mirrored else tree, starts[-1])] = 1 << bit
    sets = sorted({step[0] for step in nfa.step if step}, key=sorted)
    marks = np.zeros((256, len(sets) + 1), bool)
    for i, chars in enumerate(sets):
        marks[sorted(chars), i] = True
    marks[GAP, -1] = True
    _, first, classes = np.unique(marks, axis=0, return_index=True, return_inverse=True)
    classes = classes.reshape(-1).astype(np.uint8)

    begin = nfa.closed(starts)
    again = frozenset() if anchored else begin
    numbers, queue, rows = {begin: 0}, [begin], []
    for current in queue:
        steps = [nfa.step[s] for s in current if nfa.step[s]]
        row = []
        for byte in first.tolist():
            reached = frozenset() if byte == GAP else nfa.closed([to for chars, to in steps if byte in chars])
            target = (begin if byte == GAP else reached | again) if not anchored else reached
            if target not in numbers:
                numbers[target] = len(queue)
                queue.append(target)
            row.append(numbers[target])
        rows.append(row)
    table = np.array(rows, np.int32)
    accept = np.array([sum(ends.get(s, 0) for s in states) for states in queue], np.int64)
    table, accept, block = _minimal(table, accept)
    return Automaton(classes, table, accept, int(block[numbers[frozenset()]]) if frozenset() in numbers else -1)


def _minimal(table: np.ndarray, accept: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Merges states that no input tells apart; the start stays state 0."""
    block = np.unique(accept, return_inverse=True)[1].reshape(-1)
    while True:
        _, finer = np.unique(np.column_stack([block, block[table]]), axis=0, return_inverse=True)
        finer = finer.reshape(-1)
        if finer.max() == block.max():
            break
        block = finer
    order = np.full(block.max() + 1, -1)
    seen = 0
    for b in block.tolist():
        if order[b] < 0:
            order[b] = seen
            seen += 1
    block = order[block]
    one = np.zeros(seen, np.int64)
    one[block[::-1]] = np.arange(len(block))[::-1]
    return block[table[one]].astype(np.int32), accept[one], block


def scan(machine: Automaton, data: np.ndarray, lanes: int = 2048) -> tuple[np.ndarray, np.ndarray]:
    """Ends (exclusive) at which an unanchored automaton accepts, and the rules that do.

    The bytes are cut into lanes which advance together, one gather per step.
    Each lane first assumes the start state; lanes that had another one run
    again until they meet the states found before, so the result is that of one
    plain pass.
    """
    if not len(data):
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    width = machine.table.shape[1]
    flat = (machine.table * width).astype(np.int32).reshape(-1)
    accepts = np.repeat(machine.accept, width)
    steps = -(-len(data) // lanes)
    padded = np.full(steps * lanes, GAP, np.uint8)
    padded[: len(data)] = data
    read = np.ascontiguousarray(machine.classes[padded].reshape(lanes, steps).T).astype(np.int32)
    states = np.empty((steps, lanes), np.int32)
    state = np.zeros(lanes, np.int32)
    for t in range(steps):
        state = flat[state + read[t]]
        states[t] = state
    assumed = np.zeros(lanes, np.int32)
    plain: list[int] = []
    while True:
        true = np.concatenate([[0], states[-1, :-1]]).astype(np.int32)
        wrong = np.flatnonzero(true != assumed)
        if not len(wrong):
            break
        assumed, state = true, true[wrong]
        if len(wrong) <= FEW:
            # A long match corrects lane after lane; plain steps are faster there than gathers of a few values.
            plain = plain or flat.tolist()
            for lane, at in zip(wrong.tolist(), state.tolist()):
                before, now = states[:, lane].tolist(), []
                for symbol, old in zip(read[:, lane].tolist(), before):
                    at = plain[at + symbol]
                    if at == old:
                        break
                    now.append(at)
                states[: len(now), lane] = now
            continue
        for t in range(steps):
            state = flat[state + read[t, wrong]]
            differs = state != states[t, wrong]
            if not differs.all():
                wrong, state = wrong[differs], state[differs]
                if not len(wrong):
                    break
            states[t, wrong] = state
    hit = accepts[states.T.reshape(-1)]
    at = np.flatnonzero(hit)
    return at + 1, hit[at]
