"""Cutting stock by column generation: a linear program over patterns of lengths, priced by a knapsack programme.

Everything here runs on the driver over a histogram of at most ``capacity - 1`` lengths, however many
documents there are.
"""

from __future__ import annotations

import numpy as np

#: The linear program is good enough when it is within this share of a lower bound.
GAP = 2e-3
MOST_PIVOTS = 600

Pattern = tuple[tuple[int, int], ...]  # (length, copies), longest first


def greedy(histogram: dict[int, int], capacity: int) -> list[tuple[Pattern, int]]:
    """First-fit patterns from the longest length on, each used as often as its lengths last."""
    left = {k: v for k, v in sorted(histogram.items(), reverse=True) if v > 0}
    out = []
    while left:
        room, made = capacity, {}
        for length, count in left.items():
            if copies := min(count, room // length):
                made[length] = copies
                room -= copies * length
            if not room:
                break
        times = min(left[k] // v for k, v in made.items())
        for k, v in made.items():
            left[k] -= v * times
            if not left[k]:
                del left[k]
        out.append((tuple(made.items()), times))
    return out


def priced(lengths: np.ndarray, prices: np.ndarray, capacity: int) -> tuple[float, list[np.ndarray]]:
    """The dearest pattern by an unbounded knapsack, and the dearest that begin with each of a few dear lengths."""
    best, take = np.zeros(capacity + 1), np.full(capacity + 1, -1)
    use = np.flatnonzero(prices > 1e-12)
    order = use[np.argsort(lengths[use])]
    size, worth = lengths[order], prices[order]
    for room in range(1, capacity + 1):
        best[room] = best[room - 1]
        k = np.searchsorted(size, room, side="right")
        if k:
            value = worth[:k] + best[room - size[:k]]
            i = int(value.argmax())
            if value[i] > best[room] + 1e-13:
                best[room], take[room] = value[i], order[i]

    def pattern(first: int) -> np.ndarray:
        made = np.zeros(len(lengths))
        made[first] += 1
        room = capacity - int(lengths[first])
        while room > 0:
            if take[room] < 0:
                room -= 1
                continue
            made[take[room]] += 1
            room -= int(lengths[take[room]])
        return made

    value = prices[order] + best[capacity - lengths[order]]
    dear = order[np.argsort(-value, kind="stable")[:24]]
    return float(best[capacity]), [pattern(int(i)) for i in dear]


def linear_program(histogram: dict[int, int], capacity: int) -> list[tuple[Pattern, float]]:
    """Patterns and how often to use each, such that every length is covered with about the fewest sequences."""
    lengths = np.array(sorted(histogram), np.int64)
    need = np.array([histogram[int(x)] for x in lengths], float)
    m = len(lengths)
    at = {int(x): i for i, x in enumerate(lengths)}
    # Greedy patterns, used a broken number of times, are the first basis: each one uses up a length that no
    # later one holds, so they are independent; lengths used up by the way join it as patterns of their own.
    basis, amount = np.diag((capacity // lengths).astype(float)), np.zeros(m)  # rows: patterns
    left = {i: need[i] for i in reversed(range(m))}
    while left:
        room, row = capacity, np.zeros(m)
        for i, count in left.items():
            if copies := min(int(np.ceil(count)), room // int(lengths[i])):
                row[i] = copies
                room -= copies * int(lengths[i])
        held = [int(i) for i in np.flatnonzero(row)]
        out = min(held, key=lambda i: left[i] / row[i])
        times = left[out] / row[out]
        basis[out], amount[out] = row, times
        for i in held:
            left[i] -= times * row[i]
            if i == out or left[i] < 1e-9:
                del left[i]
    inverse = np.linalg.inv(basis.T)  # of the matrix whose columns are the patterns
    prices = inverse.sum(0)
    pool = np.zeros((0, m))
    least = float((lengths * need).sum()) / capacity
    for _ in range(MOST_PIVOTS):
        if amount.sum() <= least * (1 + GAP):
            break
        worth = pool @ prices
        j = int(worth.argmax()) if len(pool) else -1
        if j < 0 or worth[j] <= 1 + 1e-9:
            top, new = priced(lengths, prices, capacity)
            least = max(least, amount.sum() / max(top, 1.0))  # the dual bound: prices / top are feasible
            new = [x for x in new if x @ prices > 1 + 1e-9]
            if not new:
                break
            pool = np.concatenate([pool[-2 * m :], np.array(new)])
            continue
        enter = pool[j]
        step = inverse @ enter
        ok = step > 1e-9
        if not ok.any():
            pool = np.delete(pool, j, axis=0)
            continue
        ratio = np.where(ok, amount / np.where(ok, step, 1), np.inf)
        r = int(ratio.argmin())
        theta = ratio[r]
        amount = np.maximum(amount - theta * step, 0)
        amount[r] = theta
        basis[r] = enter
        row = inverse[r] / step[r]
        inverse -= np.outer(step, row)
        inverse[r] = row
        prices = inverse.sum(0)
    return [(tuple((int(lengths[i]), int(basis[r, i])) for i in np.flatnonzero(basis[r])[::-1]), float(amount[r])) for r in range(m) if amount[r] > 1e-9]


def completed(left: dict[int, int], capacity: int) -> list[tuple[Pattern, int]]:
    """Exact fills of one to three lengths for what rounding leaves, longest lengths first, the most plentiful partners first."""
    count = np.zeros(capacity + 1, np.int64)
    for k, v in left.items():
        count[k] = v
    out = []
    for length in range(capacity - 1, 0, -1):
        rest = capacity - length
        while count[length] > 0:
            count[length] -= 1  # its own copy is spoken for
            partner = np.minimum(count[: rest + 1], count[rest::-1])  # a and rest - a
            if rest % 2 == 0:
                partner[rest // 2] = count[rest // 2] // 2
            partner[0] = count[rest]
            a = int(partner.argmax())
            count[length] += 1
            if partner[a] <= 0:
                break
            made: dict[int, int] = {}
            for k in (length, max(a, rest - a), min(a, rest - a)):
                if k:
                    made[k] = made.get(k, 0) + 1
            times = int(min(count[k] // v for k, v in made.items()))
            for k, v in made.items():
                count[k] -= v * times
            out.append((tuple(sorted(made.items(), reverse=True)), times))
    return out


def full_patterns(histogram: dict[int, int], capacity: int) -> tuple[list[tuple[Pattern, int]], dict[int, int]]:
    """Patterns that fill a sequence exactly and their whole numbers, and the lengths that none of them takes."""
    left = {k: v for k, v in histogram.items() if v > 0}
    chosen: list[tuple[Pattern, int]] = []

    def use(pattern: Pattern, times: int) -> None:
        times = min([times, *(left.get(k, 0) // v for k, v in pattern)])
        if times > 0 and sum(k * v for k, v in pattern) == capacity:
            chosen.append((pattern, times))
            for k, v in pattern:
                left[k] -= v * times

    if left:
        found = linear_program(left, capacity)
        for pattern, amount in found:
            use(pattern, int(amount + 1e-6))
        for pattern, amount in sorted(found, key=lambda x: -(x[1] % 1)):
            use(pattern, 1)
        for pattern, times in completed(left, capacity):
            use(pattern, times)
    return chosen, {k: v for k, v in left.items() if v}


def powers(total: int) -> list[int]:
    """The powers of two that sum to total, largest first."""
    return [1 << k for k in reversed(range(total.bit_length())) if total >> k & 1]
