"""Cutting stock by column generation, on a histogram of lengths. Its size hangs on the capacity, never on the corpus."""

from __future__ import annotations

import numpy as np


def best_pattern(values: np.ndarray, capacity: int) -> tuple[float, np.ndarray]:
    """Unbounded knapsack: class ``i`` takes ``i + 1`` units and is worth ``values[i]``; the best value and how often each class occurs."""
    m = len(values)
    best = np.zeros(capacity + 1)
    take = np.full(capacity + 1, -1)
    for room in range(1, capacity + 1):
        n = min(m, room)
        worth = values[:n] + best[room - 1 :: -1][:n] if room > 1 else values[:1] + best[:1]
        i = int(np.argmax(worth))
        if worth[i] > best[room - 1] + 1e-12:
            best[room], take[room] = worth[i], i
        else:
            best[room] = best[room - 1]
    pattern, room = np.zeros(m, dtype=np.int64), capacity
    while room > 0:
        if take[room] < 0:
            room -= 1
        else:
            pattern[take[room]] += 1
            room -= take[room] + 1
    return float(best[capacity]), pattern


def _times(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Matrix product in this thread alone; the matrices are small and the driver has other work."""
    return np.einsum("ij,jk->ik", a, b)


def solve(demand: np.ndarray, capacity: int, gap: float = 2e-4, most_steps: int = 8_000) -> list[tuple[np.ndarray, float]]:
    """Patterns and how often the linear program uses each, so that every class is met.

    Minimises the number of patterns. The basis starts with one-class patterns; dual prices of the basis price the next
    pattern by the knapsack; the bound of Farley (value / best price) ends the search once ``gap`` is reached. Only
    classes that occur have a row; their demand is moved by less than a hundredth of an item, so that no pivot stands still.
    """
    asked = np.flatnonzero(demand)
    m = len(asked)
    target = demand[asked] + np.random.default_rng(7).uniform(1e-3, 1e-2, m)
    each = np.maximum(1, capacity // (asked + 1))
    basis = list(np.diag(each))
    inverse = np.diag(1.0 / each)
    level = target / each
    for step in range(most_steps):
        prices = np.zeros(len(demand))
        prices[asked] = np.maximum(inverse.sum(axis=0), 0.0)
        worth, whole = best_pattern(prices, capacity)
        if worth <= 1 + 1e-9 or 1 - 1 / worth <= gap:
            break
        pattern = whole[asked]
        change = (inverse * pattern).sum(axis=1)
        room = np.where(change > 1e-9, level / np.where(change > 1e-9, change, 1.0), np.inf)
        out = int(np.argmin(room))
        if not np.isfinite(room[out]):
            break
        moved = room[out]
        level = np.maximum(level - moved * change, 0.0)
        level[out] = moved
        row = inverse[out] / change[out]
        inverse -= np.outer(change, row)
        inverse[out] = row
        basis[out] = pattern
        if step % 200 == 199:
            # One Newton step takes out what rounding has put into the inverse.
            error = 2 * np.eye(m) - _times(np.array(basis, dtype=float).T, inverse)
            inverse = _times(inverse, error)
            level = np.maximum((inverse * target).sum(axis=1), 0.0)
    plans = []
    for own, x in zip(basis, level):
        if x > 1e-9:
            whole = np.zeros(len(demand), dtype=np.int64)
            whole[asked] = own
            plans.append((whole, float(x)))
    return plans


def rounded(demand: np.ndarray, capacity: int) -> list[tuple[np.ndarray, int]]:
    """Whole numbers of patterns that hold exactly ``demand[i]`` items of class ``i`` (``i + 1`` units each).

    The linear program is rounded down; the rest, at most a few items a class, is filled largest first.
    """
    left = demand.astype(np.int64).copy()
    plan = []
    if left.sum():
        for pattern, level in sorted(solve(left, capacity), key=lambda p: -p[1]):
            used = pattern > 0
            times = int(min(np.floor(level + 1e-6), (left[used] // pattern[used]).min(initial=np.iinfo(np.int64).max)))
            if times > 0:
                plan.append((pattern, times))
                left -= times * pattern
    while left.any():
        pattern, room = np.zeros(len(left), dtype=np.int64), capacity
        for i in range(len(left) - 1, -1, -1):
            n = min(left[i], room // (i + 1))
            pattern[i] = n
            room -= n * (i + 1)
        times = int((left[pattern > 0] // pattern[pattern > 0]).min())
        plan.append((pattern, times))
        left -= times * pattern
    return plan
