"""The cheapest edits of a conversation: bidirectional Dijkstra over its edit lattice.

A node is (rows gone through, state of the roles so far).  States: 0 nothing yet, 1 a system row, 2 last a user row, 3 last an
assistant row.  Edges are the edits.  Two heaps grow from both ends; where they meet, every crossing of the least cost is
finished, and of these the least audit is taken.  An audit is the edits' initials in order.
"""

from __future__ import annotations

import heapq
from collections.abc import Iterable
from functools import lru_cache

# Costs of the edits.
KEEP, REROLE, DELETE, INSERT, TRUNCATED = 0, 2, 3, 2, 1
# Row codes: initial of its role (x: none of s, u, a), upper case if truncated, MUST_GO if it has to be deleted.
MUST_GO = "-"
STATES = range(4)
FINAL = (0, 3)
KEPT = {(0, "s"): 1, (0, "u"): 2, (1, "u"): 2, (3, "u"): 2, (2, "a"): 3}
PUT = (2, 2, 3, 2)  # the state after a user or an assistant row is put in, whichever may follow
Label = tuple[int, str]


def after_keep(state: int, code: str) -> int | None:
    """The state after a row is kept; None where its role may not follow, or it has to go."""
    return KEPT.get((state, code.lower()))


def _forward(codes: str, at: int, state: int) -> Iterable[tuple[int, int, int, str]]:
    yield at, PUT[state], INSERT, "I"
    if at < len(codes):
        code = codes[at]
        yield at + 1, state, DELETE, "D"
        if code != MUST_GO:
            extra = TRUNCATED * code.isupper()
            yield at + 1, PUT[state], REROLE + extra, "R"
            to = after_keep(state, code)
            if to is not None:
                yield at + 1, to, KEEP + extra, "K"


def _backward(codes: str, at: int, state: int) -> Iterable[tuple[int, int, int, str]]:
    before = [s for s in STATES if PUT[s] == state]
    for s in before:
        yield at, s, INSERT, "I"
    if at:
        code = codes[at - 1]
        yield at - 1, state, DELETE, "D"
        if code != MUST_GO:
            extra = TRUNCATED * code.isupper()
            for s in before:
                yield at - 1, s, REROLE + extra, "R"
            for s in STATES:
                if after_keep(s, code) == state:
                    yield at - 1, s, KEEP + extra, "K"


class _Side:
    """One heap and what it has settled.

    Edits that cost nothing take a row each, so nodes of equal cost are settled in the order of their rows, and a node's
    label (cost, audit) is final when it is taken.  Audits of equal cost at a node never begin one
    with the other (that would take inserts, which cost), so the least part of an audit makes the least whole.
    """

    def __init__(self, starts: Iterable[tuple[int, int]], step, ahead: int):
        self.step, self.ahead = step, ahead
        self.best: dict[tuple[int, int], Label] = {node: (0, "") for node in starts}
        self.settled: dict[tuple[int, int], Label] = {}
        self.heap = [(0, ahead * at, "", state) for at, state in self.best]
        heapq.heapify(self.heap)

    def least(self) -> float:
        """Cost of what is settled next."""
        while self.heap and (self.ahead * self.heap[0][1], self.heap[0][3]) in self.settled:
            heapq.heappop(self.heap)
        return self.heap[0][0] if self.heap else float("inf")

    def settle(self, codes: str):
        """Settle the next node; its label and edges."""
        cost, place, audit, state = heapq.heappop(self.heap)
        at = self.ahead * place
        self.settled[at, state] = (cost, audit)
        edges = []
        for to, other, price, letter in self.step(codes, at, state):
            label = (cost + price, audit + letter if self.ahead > 0 else letter + audit)
            edges.append(((to, other), label))
            if (to, other) not in self.settled and label < self.best.get((to, other), (float("inf"), "")):
                self.best[to, other] = label
                heapq.heappush(self.heap, (label[0], self.ahead * to, label[1], other))
        return (at, state), (cost, audit), edges


def cheapest(codes: str, start: int = 0, ends: Iterable[int] = FINAL) -> Label | None:
    """Least cost and, of the audits of that cost, the least, from a state before the rows to one of the states behind them."""
    ahead = _Side([(0, start)], _forward, 1)
    back = _Side([(len(codes), s) for s in ends], _backward, -1)
    found: Label | None = None
    turn = 0
    while True:
        a, b = ahead.least(), back.least()
        most = found[0] if found else float("inf")
        # Beyond the sum of both heaps no crossing of the least cost is left; where one heap is empty, the other ends.
        if a == b == float("inf") or (a + b if max(a, b) < float("inf") else min(a, b)) > most:
            return found
        forward = a < b or (a == b and turn % 2 == 0)
        turn += 1
        own, other = (ahead, back) if forward else (back, ahead)
        node, label, edges = own.settle(codes)
        for at, (cost, audit) in [(node, label), *edges]:
            met = other.settled.get(at)
            if met and (found is None or cost + met[0] <= found[0]):
                whole = audit + met[1] if forward else met[1] + audit
                found = min(found or (float("inf"), ""), (cost + met[0], whole))


@lru_cache(maxsize=20_000)
def cheapest_whole(codes: str) -> Label:
    """``cheapest`` for a whole conversation; short ones are often alike."""
    return cheapest(codes) or (0, "")


def crossings(codes: str) -> list[tuple[int, int, int, str]]:
    """Of a piece of a conversation: (state before, state behind, cost, audit) for every pair of states that edits join."""
    out = []
    for start in STATES:
        for end in STATES:
            label = cheapest(codes, start, (end,))
            if label:
                out.append((start, end, *label))
    return out


def chain(paths: dict[int, Label], piece: Iterable[tuple[int, int, int, str]]) -> dict[int, Label]:
    """The best label by state behind a piece, from those before it."""
    out: dict[int, Label] = {}
    for start, end, cost, audit in piece:
        if start in paths:
            label = (paths[start][0] + cost, paths[start][1] + audit)
            out[end] = min(out.get(end, label), label)
    return out
