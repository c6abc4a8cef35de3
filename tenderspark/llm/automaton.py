"""Regular expressions as one deterministic automaton over bytes.

Rules are built from a few combinators, turned into a non-deterministic automaton, made deterministic by subset
construction over byte classes and reduced by partition refinement. Tables are numpy arrays: `step[state, class]`,
`byte_class[256]` and a bit mask of the rules each state accepts.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np

# A pattern is a nested tuple: ("set", frozenset of bytes) | ("seq", p, ...) | ("alt", p, ...) | ("star", p)


def chars(*parts: str):
    """One byte of the given characters; 'a-z' is a range."""
    out: set[int] = set()
    for p in parts:
        out |= set(range(ord(p[0]), ord(p[2]) + 1)) if len(p) == 3 and p[1] == "-" else set(map(ord, p))
    return ("set", frozenset(out))


def lit(text: str, any_case: bool = False):
    return seq(*(("set", frozenset(map(ord, {c.lower(), c.upper()} if any_case else {c}))) for c in text))


def seq(*ps):
    return ("seq", *ps)


def alt(*ps):
    return ("alt", *ps)


def star(p):
    return ("star", p)


def plus(p, least: int = 1):
    return seq(*[p] * least, star(p))


def maybe(p):
    return alt(p, seq())


def reverse(p):
    if p[0] == "seq":
        return ("seq", *map(reverse, p[:0:-1]))
    return p if p[0] == "set" else (p[0], *map(reverse, p[1:]))


@dataclass(frozen=True)
class Automaton:
    byte_class: np.ndarray  # uint8[256]
    step: np.ndarray  # int32[states, classes]
    accepts: np.ndarray  # int64[states], bit k: rule k
    start: int
    dead: int  # state that never accepts again, or -1

    def resets(self) -> np.ndarray:
        """bool[256]: bytes that lead from every state to the start state, so text may be cut after them."""
        return (self.step == self.start).all(axis=0)[self.byte_class]

    def longest(self, data: bytes, at: int, rule: int) -> int:
        """End of the longest match of `rule` that begins at `at`, or -1 (for an anchored automaton)."""
        state, end = self.start, -1
        for i in range(at, len(data)):
            state = self.step[state, self.byte_class[data[i]]]
            if state == self.dead:
                break
            if self.accepts[state] >> rule & 1:
                end = i + 1
        return end

    def lengths_back(self, data: bytes, last: int, rule: int) -> list[int]:
        """Lengths of all matches of `rule` that end with data[last] (for an automaton of reversed patterns)."""
        state, out = self.start, []
        for n, i in enumerate(range(last, -1, -1), 1):
            state = self.step[state, self.byte_class[data[i]]]
            if state == self.dead:
                break
            if self.accepts[state] >> rule & 1:
                out.append(n)
        return out

    def ends(self, data: bytes, begin: int, stop: int, rule: int) -> list[int]:
        """Positions in [begin, stop) with which a match ends that starts at `begin` or later (search automaton)."""
        state, out = self.start, []
        for i in range(begin, stop):
            state = self.step[state, self.byte_class[data[i]]]
            if self.accepts[state] >> rule & 1:
                out.append(i)
        return out


def _nfa(patterns):
    moves: list[list[tuple[frozenset, int]]] = []
    empty: list[list[int]] = []

    def new():
        moves.append([])
        empty.append([])
        return len(moves) - 1

    def build(p, a):
        if p[0] == "set":
            b = new()
            moves[a].append((p[1], b))
            return b
        if p[0] == "seq":
            for q in p[1:]:
                a = build(q, a)
            return a
        b = new()
        if p[0] == "alt":
            for q in p[1:]:
                s = new()
                empty[a].append(s)
                empty[build(q, s)].append(b)
            return b
        s = new()  # star
        empty[a].append(s)
        empty[build(p[1], s)].append(s)
        empty[s].append(b)
        return b

    root = new()
    ends = {}
    for k, p in enumerate(patterns):
        s = new()
        empty[root].append(s)
        ends[build(p, s)] = k
    return moves, empty, root, ends


def compile_rules(patterns: list, search: bool) -> Automaton:
    """One minimal automaton for all patterns; with `search` a match may begin anywhere."""
    moves, empty, root, ends = _nfa(patterns)

    def closure(states):
        seen, todo = set(states), list(states)
        while todo:
            for t in empty[todo.pop()]:
                if t not in seen:
                    seen.add(t)
                    todo.append(t)
        return frozenset(seen)

    sets = {s for m in moves for s, _ in m}
    signature = [tuple(b in s for s in sets) for b in range(256)]
    classes = {g: k for k, g in enumerate(dict.fromkeys(signature))}
    byte_class = np.array([classes[g] for g in signature], np.uint8)
    sample = {classes[g]: b for b, g in enumerate(signature)}
    first = closure([root])
    number, table, todo = {first: 0}, [], [first]
    for state in todo:  # grows while subsets are found
        row = []
        for c in range(len(classes)):
            goal = {t for s in state for chars_, t in moves[s] if sample[c] in chars_}
            nxt = closure(goal | ({root} if search else set()))
            if nxt not in number:
                number[nxt] = len(todo)
                todo.append(nxt)
            row.append(number[nxt])
        table.append(row)
    step = np.array(table, np.int32)
    accepts = np.array([sum(1 << k for k in {ends[s] for s in state if s in ends}) for state in todo], np.int64)
    # Minimise: refine the partition by accepted rules until successors agree.
    block = np.unique(accepts, return_inverse=True)[1]
    while True:
        finer = np.unique(np.column_stack([block, block[step]]), axis=0, return_inverse=True)[1].ravel()
        if finer.max() == block.max():
            break
        block = finer
    keep = np.unique(block, return_index=True)[1]
    small, mask = block[step[keep]].astype(np.int32), accepts[keep]
    stuck = np.flatnonzero((small == np.arange(len(small))[:, None]).all(axis=1) & (mask == 0))
    return Automaton(byte_class, small, mask, int(block[0]), int(stuck[0]) if len(stuck) and not search else -1)


def scan(automaton: Automaton, buffer: np.ndarray, lane: int = 4096) -> tuple[np.ndarray, np.ndarray]:
    """(positions, accept masks) of all accepting steps in one pass over `buffer`.

    The buffer is cut into lanes behind bytes that reset the automaton, so lanes run side by side: each numpy step
    advances all lanes by one byte. Text without such bytes simply makes a longer lane.
    """
    n = len(buffer)
    if not n:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    cuts = np.flatnonzero(automaton.resets()[buffer]) + 1
    wanted = np.arange(lane, n, lane)
    at = np.searchsorted(cuts, wanted)
    begins = np.unique(np.concatenate([[0], cuts[at[at < len(cuts)]]]))
    begins = begins[begins < n]
    lengths = np.diff(np.append(begins, n))
    order = np.argsort(-lengths, kind="stable")
    begins, lengths = begins[order], lengths[order]
    classes = automaton.byte_class[buffer]
    width = automaton.step.shape[1]
    flat = (automaton.step * width).ravel()  # states scaled by the row width
    accepting = np.repeat(automaton.accepts != 0, width)
    state = np.full(len(begins), automaton.start * width, np.int32)
    live = np.searchsorted(-lengths, -np.arange(lengths[0]), side="left")  # lanes longer than t
    places, states = [], []
    for t in range(lengths[0]):
        m = live[t]
        now = flat[state[:m] + classes[begins[:m] + t]]
        state[:m] = now
        hit = accepting[now]
        if hit.any():
            k = np.flatnonzero(hit)
            places.append(begins[k] + t)
            states.append(now[k] // width)
    if not places:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    where, what = np.concatenate(places), automaton.accepts[np.concatenate(states)]
    order = np.argsort(where, kind="stable")
    return where[order], what[order]
