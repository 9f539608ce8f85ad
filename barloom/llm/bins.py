"""Bin packing of one bounded cell: best fit, lower bounds, and a grouping genetic algorithm.

A packing is a list of bins, a bin a list of item numbers. Nothing here knows of Spark.
"""

from __future__ import annotations

from bisect import bisect_left, insort

import numpy as np

from barloom.llm.ship import by_value

by_value(__name__)


def best_fit(lengths, order, capacity: int, bins: list[list[int]]) -> list[list[int]]:
    """The bins with the items of ``order`` added, each where it leaves least room."""
    rooms = [(capacity - sum(lengths[i] for i in b), n) for n, b in enumerate(bins)]
    rooms = sorted(r for r in rooms if r[0] > 0)
    for item in order:
        size = lengths[item]
        at = bisect_left(rooms, (size, -1))
        if at < len(rooms):
            room, n = rooms.pop(at)
            bins[n].append(item)
        else:
            room, n = capacity, len(bins)
            bins.append([item])
        if room > size:
            insort(rooms, (room - size, n))
    return bins


def descending(lengths, items=None) -> list[int]:
    return sorted(range(len(lengths)) if items is None else items, key=lambda i: (-lengths[i], i))


def lower_bound(lengths, capacity: int) -> int:
    """No packing has fewer bins (Martello and Toth's second bound over all thresholds)."""
    count = np.bincount(np.asarray(lengths, dtype=np.int64), minlength=capacity + 1)[: capacity + 1]
    upto, weight = np.cumsum(count), np.cumsum(count * np.arange(capacity + 1))
    half = capacity // 2
    a = np.arange(0, half + 1)
    large = upto[capacity] - upto[capacity - a]
    middle = upto[capacity - a] - upto[half]
    free = middle * capacity - (weight[capacity - a] - weight[half])
    small = weight[half] - np.where(a > 0, weight[np.maximum(a - 1, 0)], 0)
    return int((large + middle + np.maximum(0, -(-(small - free) // capacity))).max())


def fitness(bins, lengths, capacity: int):
    """Fewer bins first, then fuller ones."""
    return len(bins), -sum((sum(lengths[i] for i in b) / capacity) ** 2 for b in bins)


def cross(mother, father, lengths, capacity: int, rng) -> list[list[int]]:
    """The father's well-filled bins go whole into the mother; her bins that hold one of their items
    are dissolved, and the items without a place are added by best fit."""
    full = [b for b in father if sum(lengths[i] for i in b) >= 0.97 * capacity] or father
    taken = [b for b in full if rng.random() < 0.5] or full[:1]
    inside = {i for b in taken for i in b}
    kept, displaced = [], []
    for b in mother:
        if inside.isdisjoint(b):
            kept.append(list(b))
        else:
            displaced.extend(i for i in b if i not in inside)
    return best_fit(lengths, descending(lengths, displaced), capacity, kept + [list(b) for b in taken])


def mutate(bins, lengths, capacity: int, rng) -> list[list[int]]:
    """The least filled bins and a few others are emptied and their items added again."""
    order = sorted(range(len(bins)), key=lambda n: sum(lengths[i] for i in bins[n]))
    out = set(order[:2]) | set(rng.choice(len(bins), min(len(bins), 3), replace=False).tolist())
    kept = [list(b) for n, b in enumerate(bins) if n not in out]
    loose = [i for n in out for i in bins[n]]
    return best_fit(lengths, [loose[k] for k in rng.permutation(len(loose))], capacity, kept)


def start(lengths, capacity: int, size: int, rng) -> list[list[list[int]]]:
    """Best fit by falling length, and by lengths with some noise."""
    first = [best_fit(lengths, descending(lengths), capacity, [])]
    noisy = lambda: (-np.asarray(lengths) * rng.uniform(0.8, 1.0, len(lengths))).argsort(kind="stable").tolist()
    return first + [best_fit(lengths, noisy(), capacity, []) for _ in range(size - 1)]


def evolve(population, lengths, capacity: int, generations: int, rng, bound: int):
    """The population after some generations, best first; it stops when the bound is reached."""
    rank = lambda bins: fitness(bins, lengths, capacity)
    population = sorted(population, key=rank)
    for _ in range(generations):
        if len(population[0]) <= bound:
            break
        mother, father = (population[k] for k in rng.integers(0, len(population), 2))
        child = mutate(cross(mother, father, lengths, capacity, rng), lengths, capacity, rng)
        if rank(child) < rank(population[-1]) and all(rank(child) != rank(p) for p in population):
            population = sorted([*population[:-1], child], key=rank)
    return population
