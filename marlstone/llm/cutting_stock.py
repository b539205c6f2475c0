"""Cutting stock by column generation over a histogram of length classes.

The linear program has one row for each class and is solved by the revised simplex method; columns are priced by an
unbounded knapsack dynamic program over the capacity. Besides patterns (which items share a sequence) a column may cut
one item of a class into two items of smaller classes, at a small cost, since documents may be cut. Work and memory
depend on the number of classes only (a constant), never on the number of documents.
"""

from __future__ import annotations

import numpy as np


def price_pattern(duals: np.ndarray, capacity: int) -> tuple[float, np.ndarray]:
    """The pattern of greatest dual value: counts for each class 1..len(duals)."""
    n = len(duals)
    best = np.zeros(capacity + 1)
    take = np.zeros(capacity + 1, dtype=np.int64)
    for room in range(1, capacity + 1):
        m = min(room, n)
        values = duals[:m] + best[room - 1 :: -1][:m]  # class c leaves room - c
        c = int(values.argmax())
        if values[c] > best[room - 1] + 1e-12:
            best[room], take[room] = values[c], c + 1
        else:
            best[room] = best[room - 1]
    counts = np.zeros(n, dtype=np.int64)
    room = capacity
    while room > 0:
        if take[room]:
            counts[take[room] - 1] += 1
            room -= take[room]
        else:
            room -= 1
    return float(best[capacity]), counts


def price_cut(duals: np.ndarray, cost: float) -> tuple[float, int, int]:
    """The cut c -> (a, c - a) of the least reduced cost, as (reduced cost, c, a)."""
    n = len(duals)
    found = (0.0, 0, 0)
    for c in range(2, n + 1):
        half = c // 2
        pair = duals[:half] + duals[c - 2 - np.arange(half)]  # classes a and c - a
        a = int(pair.argmin())
        reduced = cost - (duals[c - 1] - pair[a])
        if reduced < found[0] - 1e-12:
            found = (float(reduced), c, a + 1)
    return found


def as_column(entry: tuple, n: int) -> np.ndarray:
    """What a pattern or a cut supplies to each class: a cut gives one item of its class and needs its two parts."""
    kind, what, _ = entry
    if kind == "pattern":
        return what.astype(float)
    out = np.zeros(n)
    c, a = what
    out[c - 1] += 1
    out[a - 1] -= 1
    out[c - a - 1] -= 1
    return out


def solve(demand: np.ndarray, capacity: int, cut_cost: float = 0.02, rounds: int = 4000) -> tuple[list[tuple[np.ndarray, float]], list[tuple[int, int, float]]]:
    """Fractional optimum: [(counts by class, times)], [(class, first part, times)]. demand[c - 1] items of class c."""
    n = len(demand)
    rows = np.eye(n)
    columns: list[tuple[str, np.ndarray | tuple[int, int], float]] = []
    scale = np.zeros(n)
    for c in range(1, n + 1):
        counts = np.zeros(n, dtype=np.int64)
        counts[c - 1] = capacity // c
        columns.append(("pattern", counts, 1.0))
        scale[c - 1] = capacity // c
    inverse = rows / scale[:, None]
    # a little more of each class, unequally: where many classes are empty, ties would let the simplex method go in circles
    demand = demand + 1e-7 * (1 + np.arange(n) / n)
    level = demand / scale
    sound = (list(columns), level)  # the last basis that was inverted anew
    for turn in range(rounds):
        if turn % 50 == 49:  # rounding errors of the updates don't add up
            try:
                inverse = np.linalg.inv(np.stack([as_column(x, n) for x in columns], axis=1))
            except np.linalg.LinAlgError:  # a feasible plan all the same, only some rounds short of the optimum
                columns, level = sound
                break
            level = np.maximum(inverse @ demand, 0)
            sound = (list(columns), level)
        costs = np.array([x[2] for x in columns])
        duals = costs @ inverse
        value, counts = price_pattern(np.maximum(duals, 0), capacity)
        gain, enter = 1.0 - value, ("pattern", counts, 1.0)
        cut_gain, c, a = price_cut(duals, cut_cost)
        if cut_gain < gain:
            gain, enter = cut_gain, ("cut", (c, a), cut_cost)
        column = as_column(enter, n)
        if gain > -1e-7:
            break
        direction = inverse @ column
        # what is smaller than this is rounding error, and as a pivot would make the basis singular
        usable = direction > 1e-7 * max(1.0, float(np.abs(direction).max()))
        limits = np.where(usable, level / np.where(usable, direction, 1), np.inf)
        least = float(limits.min())
        if not np.isfinite(least):
            break
        leave = int(np.where(limits <= least + 1e-9 * (1 + least), direction, -np.inf).argmax())  # among ties, the greatest pivot
        step = limits[leave]
        level = np.maximum(level - step * direction, 0)
        level[leave] = step
        pivot = inverse[leave] / direction[leave]
        inverse -= np.outer(direction, pivot)
        inverse[leave] = pivot
        columns[leave] = enter
    patterns = [(what, float(x)) for (kind, what, _), x in zip(columns, level) if kind == "pattern" and x > 1e-5]
    cuts = [(what[0], what[1], float(x)) for (kind, what, _), x in zip(columns, level) if kind == "cut" and x > 1e-5]
    return patterns, cuts
