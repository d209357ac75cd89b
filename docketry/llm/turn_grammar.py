"""Cheapest edits that give a conversation its form, as min-plus steps.

Role initials must read ``(s?(ua)+)?``: states are START, SYSTEM, USER and
ASSISTANT by the last one, and a conversation may end in START or ASSISTANT.
A turn's symbol is its initial with its fault.  Edits, in the order that decides
ties: Delete, Insert, Keep, Rerole.
"""

from functools import lru_cache

START, SYSTEM, USER, ASSISTANT = range(4)
STATES = range(4)
FAR = 1 << 60
DELETE, INSERT, REROLE, TRUNCATED = 4, 3, 3, 3
#: Costs to end well after the last turn.
END = (0, 2 * INSERT, INSERT, 0)
#: The state that an inserted or re-roled turn leads to.
NEXT = (USER, USER, ASSISTANT, USER)
NAMES = {USER: "user", ASSISTANT: "assistant"}
#: The states that a kept turn may follow and the one it leads to, by initial.
KEEP = {"s": ((START,), SYSTEM), "u": ((START, SYSTEM, ASSISTANT), USER), "a": ((USER,), ASSISTANT)}

#: Blank or repeated turns: to be deleted.
GONE = 0
_INITIALS = "sua?"


def symbol(initial: str, truncated: bool) -> int:
    """The symbol of a turn that may stay."""
    return 1 + 2 * (_INITIALS.index(initial) if initial in "sua" else 3) + truncated


@lru_cache(None)
def _edits(kind: int, state: int) -> tuple[tuple[str, int, int], ...]:
    """``(letter, cost, next state)`` of the edits that use up a turn."""
    out = [("D", DELETE, state)]
    if kind != GONE:
        initial, more = _INITIALS[(kind - 1) // 2], TRUNCATED * ((kind - 1) % 2)
        if state in KEEP.get(initial, ((), 0))[0]:
            out.append(("K", more, KEEP[initial][1]))
        out.append(("R", REROLE + more, NEXT[state]))
    return tuple(out)


@lru_cache(None)
def _without_insert(kind: int, after: tuple[int, ...]) -> tuple[int, ...]:
    return tuple(min(cost + after[to] for _, cost, to in _edits(kind, s)) for s in STATES)


@lru_cache(None)
def before(kind: int, after: tuple[int, ...]) -> tuple[int, ...]:
    """Costs to go in each state before a turn, from those after it.

    More than two inserts in a row lead where fewer do."""
    plain = _without_insert(kind, after)
    return tuple(
        min(plain[s], INSERT + plain[NEXT[s]], 2 * INSERT + plain[NEXT[NEXT[s]]]) for s in STATES
    )


@lru_cache(None)
def choose(kind: int, after: tuple[int, ...], state: int) -> tuple[str, int]:
    """The ASCII-least of the cheapest edits for a turn, and the state after it."""
    letters, plain, total = "", _without_insert(kind, after), before(kind, after)
    while True:
        options = [(letter, cost + after[to], to) for letter, cost, to in _edits(kind, state)]
        options.append(("I", INSERT + total[NEXT[state]], NEXT[state]))
        letter, _, state = min((x for x in options if x[1] == total[state]), key=lambda x: x[0])
        letters += letter
        if letter != "I":
            return letters, state
        assert plain  # an insert is always followed by an edit that uses up the turn


def normal(costs: tuple[int, ...]) -> tuple[tuple[int, ...], int]:
    """The costs over the least one, and that; there are few different ones."""
    least = min(costs)
    return tuple(c - least for c in costs), least


def product(left: tuple, right: tuple) -> tuple:
    """The min-plus product of two transitions."""
    return tuple(
        tuple(min(left[s][k] + right[k][t] for k in STATES) for t in STATES) for s in STATES
    )


SAME = tuple(tuple(0 if s == t else FAR for t in STATES) for s in STATES)


@lru_cache(None)
def power(kind: int, exponent: int) -> tuple:
    """The transition of ``2 ** exponent`` turns of one symbol."""
    if exponent:
        half = power(kind, exponent - 1)
        return product(half, half)
    columns = [before(kind, tuple(0 if s == t else FAR for s in STATES)) for t in STATES]
    return tuple(tuple(min(columns[t][s], FAR) for t in STATES) for s in STATES)


def applied(transition: tuple, after: tuple[int, ...]) -> tuple[int, ...]:
    """Costs before, from those after a transition."""
    return tuple(min(min(row[t] + after[t] for t in STATES), FAR) for row in transition)


def advance(kind: int, times: int, after: tuple[int, ...]) -> tuple[int, ...]:
    """Costs before a run of equal symbols, by the binary powers of its transition."""
    bit = 0
    while times:
        if times & 1:
            after = applied(power(kind, bit), after)
        times >>= 1
        bit += 1
    return after


def transition(runs: list[tuple[int, int]]) -> tuple:
    """The transition of runs ``(symbol, times)``, four columns of costs."""
    columns = []
    for t in STATES:
        costs = tuple(0 if s == t else FAR for s in STATES)
        for kind, times in reversed(runs):
            costs = tuple(min(c, FAR) for c in advance(kind, times, costs))
        columns.append(costs)
    return tuple(tuple(columns[t][s] for t in STATES) for s in STATES)


def unroll(
    runs: list[tuple[int, int]], after: tuple[int, ...], state: int
) -> tuple[list[tuple[int, str, int]], int]:
    """The edits as ``(symbol, letters of a turn, times)`` and the state at the end."""
    ends = [normal(after)[0]]
    for kind, times in reversed(runs):
        ends.append(normal(advance(kind, times, ends[-1]))[0])
    out = []
    for (kind, times), end in zip(runs, reversed(ends[:-1])):
        costs, fixed = [end], False
        while len(costs) < times and not fixed:
            costs.append(normal(before(kind, costs[-1]))[0])
            fixed = costs[-1] == costs[-2]
        k = 0
        while k < times:
            left = times - 1 - k
            letters, to = choose(kind, costs[min(left, len(costs) - 1)], state)
            alike = 1
            if fixed and to == state and left >= len(costs) - 1:
                alike = left - (len(costs) - 1) + 1  # nothing changes while the costs don't
            out.append((kind, letters, alike))
            state = to
            k += alike
    return out, state


def tail(state: int) -> str:
    """The inserts after the last turn."""
    return "I" * (END[state] // INSERT)
