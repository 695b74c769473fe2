"""The cheapest edits that make a list of turns legal, by iterative-deepening A*.

Turns are codes: their role's initial (s, u, a; x for any other), a capital if the turn is truncated, `-` if it must go. The roles that stay must
read `(s?(ua)+)?`. Edits are D (delete, 4), I (insert an empty turn, 3), K (keep, 0) and R (give the role that may come next, 3); a truncated turn
that stays costs 3 more. Which role is inserted or given follows from the turns before, so a string of edits says all.
"""

from __future__ import annotations

from functools import lru_cache

#: States: nothing yet, after system, after user, after assistant. The initial that an insertion gives in each, and the state after it.
START, SYSTEM, USER, ASSISTANT = range(4)
GIVEN = "uuau"
AFTER = (USER, USER, ASSISTANT, USER)
LEGAL = {"su", "ua", "au"}
#: Cost and edits that end a conversation in each state.
ENDS = ((0, ""), (6, "II"), (3, "I"), (0, ""))
NEVER = 10**15
DELETE, INSERT, ROLE, TRUNCATED = 4, 3, 3, 3


def kept(state: int, initial: str) -> int | None:
    """The state after a turn is kept, None where its role may not come."""
    if initial == "s":
        return SYSTEM if state == START else None
    return AFTER[state] if initial == GIVEN[state] else None


def needs(codes: str) -> list[int]:
    """Lower bounds of the cost of the turns from each on: what each must cost, and the most that disjoint pairs of neighbours, of which one must change, add."""
    n = len(codes)
    own, pairs = [0] * (n + 1), [0] * (n + 2)
    after = None  # nearest turn that may stay, with a role of the pattern
    for i in range(n - 1, -1, -1):
        code = codes[i]
        own[i] = own[i + 1] + (DELETE if code in "-X" else 3 if code == "x" or code.isupper() else 0)
        pairs[i] = pairs[i + 1]
        if code == "-":
            continue
        if code in "xX":
            after = None
            continue
        if after is not None and (code + codes[after]).lower() not in LEGAL:
            pairs[i] = max(pairs[i], (1 if code.isupper() or codes[after].isupper() else 3) + pairs[after + 1])
        after = i
    return [a + b for a, b in zip(own, pairs, strict=False)]


def _moves(codes: str, i: int, state: int, at_end: bool) -> list[tuple[str, int, int, int]]:
    """(edit, cost, next turn, next state) in ASCII order of edits."""
    if i == len(codes):
        return [("I", INSERT, i, AFTER[state])] if at_end else []
    code = codes[i]
    out = [("D", DELETE, i + 1, state), ("I", INSERT, i, AFTER[state])]
    if code != "-":
        more = TRUNCATED if code.isupper() else 0
        then = kept(state, code.lower())
        if then is not None:
            out.append(("K", more, i + 1, then))
        if code.lower() != GIVEN[state]:
            out.append(("R", ROLE + more, i + 1, AFTER[state]))
    return out


@lru_cache(maxsize=1 << 16)
def search(codes: str, entry: int = START, goals: tuple[int, ...] = (START, ASSISTANT), at_end: bool = True) -> tuple[int, str] | None:
    """(cost, edits) that lead from state `entry` over all turns to one of the goals: the cheapest, of equal ones the ASCII-least; None if there is no way.

    Depth-first searches in ASCII order run under rising bounds; `low` holds for each turn and state the cost below which all ways on have failed,
    from which the next bound comes. Insertions after the last turn are only tried `at_end`.
    """
    n = len(codes)
    need = needs(codes)
    system_from = max((i for i, c in enumerate(codes) if c in "sS"), default=-1)

    def bound_of(i: int, state: int) -> int:
        reachable = any(
            g == state or (i < n or at_end) and (g in (USER, ASSISTANT) or g == SYSTEM and state == START and i <= system_from) for g in goals
        )
        return need[i] if reachable else NEVER

    low = [[bound_of(i, s) for s in range(4)] for i in range(n + 1)]
    moves: dict[tuple[int, int], list] = {}
    while (bound := low[0][entry]) < NEVER:
        path: list[str] = []
        stack = [[0, entry, 0, 0]]
        while stack:
            frame = stack[-1]
            i, state, spent, tried = frame
            if i == n and state in goals:
                return spent, "".join(path)
            options = moves.get((i, state))
            if options is None:
                options = moves[i, state] = _moves(codes, i, state, at_end)
            while tried < len(options):
                edit, cost, j, then = options[tried]
                tried += 1
                if spent + cost + low[j][then] <= bound:
                    frame[3] = tried
                    stack.append([j, then, spent + cost, 0])
                    path.append(edit)
                    break
            else:
                best = min((cost + low[j][then] for _, cost, j, then in options), default=NEVER)
                low[i][state] = max(low[i][state], min(best, NEVER))
                stack.pop()
                if path:
                    path.pop()
    return None


@lru_cache(maxsize=1 << 12)
def table(codes: str) -> tuple[tuple[int, ...], tuple[int, ...]]:
    """(costs, ranks) of the way over a part of a conversation from each state (4 entries each) to each; ranks order the edits of one entry."""
    costs, ranks = [], []
    for entry in range(4):
        found = [search(codes, entry, (goal,), False) for goal in range(4)]
        order = sorted(range(4), key=lambda g: (found[g] is None, found[g][1] if found[g] else ""))
        costs += [f[0] if f else NEVER for f in found]
        ranks += [order.index(g) for g in range(4)]
    return tuple(costs), tuple(ranks)


def through(parts: list[tuple], entry: int) -> list[list[tuple[int, int, int]]]:
    """After each part, for each state, (cost, rank of the edits so far, state before the part) of the best way there from `entry`."""
    now = [(0, 0, -1) if s == entry else (NEVER, s, -1) for s in range(4)]
    out = []
    for costs, ranks in parts:
        best = [min((now[m][0] + costs[4 * m + x], now[m][1], ranks[4 * m + x], m) for m in range(4)) for x in range(4)]
        order = sorted(range(4), key=lambda x: (best[x][0] >= NEVER, best[x][1:]))
        now = [(min(best[x][0], NEVER), order.index(x), best[x][3]) for x in range(4)]
        out.append(now)
    return out


def joined(parts: list[tuple]) -> tuple[list[int], list[int]]:
    """`table` of several parts, one after the other, from theirs."""
    ends = [through(parts, entry)[-1] for entry in range(4)]
    return [x[0] for e in ends for x in e], [x[1] for e in ends for x in e]


def way(parts: list[tuple], entry: int, goal: int) -> list[tuple[int, int]]:
    """(entry, exit) of each part on the best way from `entry` to `goal`."""
    found, out = through(parts, entry), []
    for now in reversed(found):
        out.append((now[goal][2], goal))
        goal = now[goal][2]
    return out[::-1]


def ending(costs: list[int], ranks: list[int]) -> int:
    """The state in which a whole conversation's best way ends, before what ENDS adds."""
    return min(range(4), key=lambda x: (costs[x] + ENDS[x][0], ranks[x]))
