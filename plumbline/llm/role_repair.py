"""Cheapest edits that give a row sequence legal roles: a run-length min-plus program.

Legal role sequences are empty or ``s?(ua)+`` (system, user, assistant). A row
is a symbol: the class of its role's initial and whether it must go or is cut
off. A step from before a row to after it is a 4 x 4 min-plus matrix over the
states (start, after s, after u, after a); a run of equal symbols is a power of
it, taken from cached binary powers, so the costs of a run of any length need
a few products. The edits are then unrolled forwards: in each state the
ASCII-least edit that still reaches the least cost.
"""

from __future__ import annotations

import functools
from collections.abc import Iterable, Iterator

# Costs and the symbols' parts.
REROLE, DELETE, INSERT, CUT_OFF = 2, 3, 2, 1
SYSTEM, USER, ASSISTANT, OTHER = range(4)
#: A symbol is 2 * initial + cut off; GONE stands for every row that must be deleted.
GONE = 8
START, AFTER_S, AFTER_U, AFTER_A = range(4)
#: The state an inserted or re-roled row leads to, and the role it then has.
NEXT = (AFTER_U, AFTER_U, AFTER_A, AFTER_U)
ROLES = ("", "system", "user", "assistant")

STATES = range(4)
FAR = 1 << 60
Vector = tuple[int, ...]
Matrix = tuple[Vector, ...]


def kept_state(state: int, initial: int) -> int | None:
    """The state after a row that keeps its role, or None where that is not legal."""
    if initial == SYSTEM:
        return AFTER_S if state == START else None
    return NEXT[state] if initial == NEXT[state] - 1 else None


def times(a: Matrix, b: Matrix) -> Matrix:
    return tuple(tuple(min(FAR, *(a[q][k] + b[k][r] for k in STATES)) for r in STATES) for q in STATES)


def apply(a: Matrix, v: Vector) -> Vector:
    return tuple(min(FAR, a[q][0] + v[0], a[q][1] + v[1], a[q][2] + v[2], a[q][3] + v[3]) for q in STATES)


def _inserts() -> Matrix:
    rows = [[FAR] * 4 for _ in STATES]
    for q in STATES:
        at, cost = q, 0
        while cost < rows[q][at]:
            rows[q][at], at, cost = cost, NEXT[at], cost + INSERT
    return tuple(map(tuple, rows))


INSERTS = _inserts()
#: Least cost from each state where no row is left.
END = apply(INSERTS, (0, FAR, FAR, 0))


@functools.cache
def row_moves(symbol: int) -> Matrix:
    """Costs of one row, with the insertions before it."""
    rows = [[FAR] * 4 for _ in STATES]
    for q in STATES:
        rows[q][q] = DELETE
        if symbol != GONE:
            initial, cut = divmod(symbol, 2)
            rows[q][NEXT[q]] = min(rows[q][NEXT[q]], REROLE + CUT_OFF * cut)
            if (to := kept_state(q, initial)) is not None:
                rows[q][to] = min(rows[q][to], CUT_OFF * cut)
    return times(INSERTS, tuple(map(tuple, rows)))


@functools.cache
def power(symbol: int, k: int) -> Matrix:
    """The moves of 2**k equal rows."""
    return times(half := power(symbol, k - 1), half) if k else row_moves(symbol)


def advance(symbol: int, length: int, v: Vector) -> Vector:
    """Least costs before ``length`` equal rows, given those after them."""
    for k in range(length.bit_length()):
        if length >> k & 1:
            v = apply(power(symbol, k), v)
    return v


#: Rows whose costs are held at once while a run is unrolled.
BLOCK = 1024


def solve(runs: list[tuple[int, int]]) -> tuple[int, str]:
    """(least cost, its ASCII-least edits): D, I, K and R in row order."""
    after = [END]
    for symbol, length in reversed(runs):
        after.append(advance(symbol, length, after[-1]))
    cost, state, audit = after[-1][START], START, bytearray()
    for (symbol, length), end in zip(runs, after[-2::-1]):
        initial, cut = divmod(symbol, 2) if symbol != GONE else (None, 0)
        for first in range(0, length, BLOCK):
            size = min(BLOCK, length - first)
            costs = [advance(symbol, length - first - size, end)]
            for _ in range(size):
                costs.append(apply(row_moves(symbol), costs[-1]))
            for k in range(size, 0, -1):
                now, then = costs[k], costs[k - 1]
                while now[state] != DELETE + then[state] and now[state] == INSERT + now[NEXT[state]]:
                    audit += b"I"
                    state = NEXT[state]
                if now[state] == DELETE + then[state]:
                    audit += b"D"
                elif (to := kept_state(state, initial)) is not None and now[state] == CUT_OFF * cut + then[to]:
                    audit += b"K"
                    state = to
                else:
                    audit += b"R"
                    state = NEXT[state]
    while END[state]:
        audit += b"I"
        state = NEXT[state]
    return cost, audit.decode()


def shortened(symbols: Iterable[int]) -> list[tuple[int, int]]:
    """Runs of equal symbols as (symbol, length)."""
    runs: list[list[int]] = []
    for s in symbols:
        if runs and runs[-1][0] == s:
            runs[-1][1] += 1
        else:
            runs.append([s, 1])
    return [(s, n) for s, n in runs]


class Edits:
    """The edits of an audit, taken row by row while the rows pass by."""

    def __init__(self, audit: str):
        self.audit, self.at, self.state = audit, 0, START

    def inserted(self) -> Iterator[str]:
        """Roles of the empty rows that stand here."""
        while self.at < len(self.audit) and self.audit[self.at] == "I":
            self.state, self.at = NEXT[self.state], self.at + 1
            yield ROLES[self.state]

    def row(self, role: str) -> str | None:
        """The role the next row ends with; None where it is deleted."""
        edit, self.at = self.audit[self.at], self.at + 1
        if edit == "D":
            return None
        if edit == "K":
            self.state = AFTER_S if role[:1] == "s" else NEXT[self.state]
            return role
        self.state = NEXT[self.state]
        return ROLES[self.state]
