"""Runs (maximal repetitions) of a sequence by Lyndon roots.

The first phase of a linear suffix sorter groups suffixes by their longest Lyndon prefix. Groups
are taken from the largest on. A suffix that is taken leaves the list of those still open, and
the nearest open suffix to its left, which is smaller, gets the taken prefix appended to its own:
once for each suffix of the group that finds it. Suffixes of one group that get the same number
of appendices go on as a new group just above what stays of their old one, more appendices
higher. Every suffix is taken once and brings at most one other to a new group, so the phase
takes linear time but for the sorting of the symbols, and its groups are the Lyndon array. Doing
so under an order of the symbols and under its reverse gives two arrays, and every run has a
Lyndon root in one of them. Equal neighbouring roots are of one group, so a root that repeats is
seen without comparing symbols; it is then extended to both sides as far as the sequence goes on
with its period.

Places that can lie in no run are left out before (`stretches`): in a run of period q all places
but the last q have the same symbol again within q, so with a least exponent e there is a
stretch of (e - 1) q places with that property. Only such stretches are grouped.
"""

from __future__ import annotations

import numpy as np


def lyndon_groups(symbols: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For each place the length of its longest Lyndon word and a number of that word.

    Two places have the same number if and only if their words are equal.
    """
    n = len(symbols)
    if not n:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    order = symbols.argsort(kind="stable")
    cuts = np.flatnonzero(np.diff(symbols[order])) + 1
    sizes = np.diff(np.concatenate(([0], cuts, [n])))
    at = np.empty(n, np.int64)
    at[order] = np.repeat(np.arange(len(sizes)), sizes)
    group = at.tolist()
    members = [part.tolist() for part in np.split(order, cuts)]
    length = [1] * len(members)
    # Neighbours of a group in the order of groups, and of an open suffix; -1 and n stand for none.
    below, above = list(range(-1, len(members) - 1)), list(range(1, len(members) + 1))
    left, right = [n, *range(n)], list(range(1, n + 2))
    current = len(members) - 1
    while current >= 0:
        found: dict[int, int] = {}
        for i in members[current]:  # ascending, so a left neighbour is never of the same group
            if group[i] == current:
                a, b = left[i], right[i]
                right[a], left[b] = b, a
                if a != n:
                    found[a] = found.get(a, 0) + 1
        moved: dict[tuple[int, int], list[int]] = {}
        for j, times in found.items():
            moved.setdefault((group[j], times), []).append(j)
        size = length[current]
        for old, times in sorted(moved, reverse=True) if len(moved) > 1 else moved:
            new, places, upper = len(members), moved[old, times], above[old]
            members.append(places)
            length.append(length[old] + times * size)
            below.append(old)
            above.append(upper)
            below[upper] = above[old] = new
            for j in places:
                group[j] = new
        current = below[current]
    numbers = np.array(group, np.int64)
    return np.array(length, np.int64)[numbers], numbers


def _agree(symbols: np.ndarray, a: int, b: int, step: int) -> int:
    """How many symbols from places a < b on agree, going right (step 1) or left (step -1)."""
    most = len(symbols) - b if step > 0 else a + 1
    done, size = 0, 64
    while done < most:
        size = min(size, most - done)
        if step > 0:
            differ = np.flatnonzero(symbols[a + done:a + done + size] != symbols[b + done:b + done + size])
        else:
            differ = np.flatnonzero(symbols[a - done - size + 1:a - done + 1][::-1] != symbols[b - done - size + 1:b - done + 1][::-1])
        if len(differ):
            return done + int(differ[0])
        done += size
        size *= 4
    return done


def rooted_runs(symbols: np.ndarray, least_exponent: int = 2) -> set[tuple[int, int, int]]:
    """(start, length, period) of all runs with length >= least_exponent * period."""
    n = len(symbols)
    runs: set[tuple[int, int, int]] = set()
    for line in (symbols, -symbols):
        size, word = lyndon_groups(line)
        places = np.arange(n)
        if least_exponent > 2:
            # At least two whole roots stand side by side; of a row of equal ones the first is taken.
            after = places + size
            again = np.append(word, -1)[np.minimum(after, n)] == word
            before = places - size
            inside = (before >= 0) & (word[np.maximum(before, 0)] == word)
            places = np.flatnonzero(again & ~inside)
        for i, p in zip(places.tolist(), size[places].tolist()):
            start = i - _agree(symbols, i - 1, i + p - 1, -1) if i else 0
            length = i + p + _agree(symbols, i, i + p, 1) - start
            if length >= least_exponent * p:
                runs.add((start, length, p))
    return runs


def stretches(symbols: np.ndarray, ends: np.ndarray, least_exponent: int, least_length: int) -> tuple[np.ndarray, np.ndarray]:
    """(starts, ends) of the parts of several sequences in a row that may hold runs.

    `ends` are the ends of the sequences. Periods are tried in doublings: for those from h + 1 to
    2 h a run has (least_exponent - 1) (h + 1) places that have their symbol again within 2 h.
    """
    n = len(symbols)
    order = symbols.argsort(kind="stable")
    ahead = np.full(n, n, np.int64)
    same = symbols[order[1:]] == symbols[order[:-1]]
    ahead[order[:-1][same]] = (order[1:] - order[:-1])[same]
    end = np.repeat(ends, np.diff(ends, prepend=0))
    ahead[np.arange(n) + ahead >= end] = n  # again, but in another sequence
    longest = int(np.diff(ends, prepend=0).max()) if n else 0
    open_from = np.zeros(n + 1, np.int64)
    half, most = 0, 1
    while n and half * least_exponent < longest:
        near = np.zeros(n + 2, np.int8)
        near[1:-1] = ahead <= most
        edges = np.flatnonzero(np.diff(near))
        a, b = edges[::2], edges[1::2]
        least = max(least_length - most, (least_exponent - 1) * (half + 1))
        long = b - a >= least
        a, b = a[long], b[long]
        np.add.at(open_from, a, 1)
        np.add.at(open_from, np.minimum(b + most, end[a]), -1)
        half, most = most, most * 2
    inside = np.zeros(n + 2, np.int8)
    inside[1:-1] = np.cumsum(open_from[:-1]) > 0
    # Parts of two sequences that touch stay two.
    inside_edges = np.flatnonzero(np.diff(inside))
    cuts = ends[(inside[ends] > 0) & (inside[np.minimum(ends + 1, n + 1)] > 0)]
    return np.sort(np.concatenate((inside_edges[::2], cuts))), np.sort(np.concatenate((inside_edges[1::2], cuts)))


def find_runs(symbols: np.ndarray, ends: np.ndarray, least_exponent: int = 4, least_length: int = 6) -> list[tuple[int, int, int]]:
    """(start, length, period) of the runs of several sequences in a row, each within its own, sorted.

    A run has at least `least_exponent` (two or more) times its period and at least `least_length`.
    """
    found: list[tuple[int, int, int]] = []
    for a, b in zip(*(edges.tolist() for edges in stretches(symbols, ends, least_exponent, least_length))):
        own = rooted_runs(symbols[a:b], least_exponent)
        found += [(a + start, length, p) for start, length, p in own if length >= least_length]
    return sorted(found)
