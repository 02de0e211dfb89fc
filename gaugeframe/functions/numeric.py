"""Small numeric kernels for use inside grouped tasks; only NumPy is needed."""

from __future__ import annotations

import heapq
import math
from collections.abc import Callable

import numpy as np


def beta_share(a: float, b: float, x: float) -> float:
    """The regularised incomplete beta function, by the modified Lentz continued fraction."""
    if x <= 0 or x >= 1:
        return float(x >= 1)
    if x > (a + 1) / (a + b + 2):
        return 1 - beta_share(b, a, 1 - x)
    front = math.exp(math.lgamma(a + b) - math.lgamma(a) - math.lgamma(b) + a * math.log(x) + b * math.log1p(-x)) / a
    tiny, c, d = 1e-300, 1.0, 1 - (a + b) * x / (a + 1)
    d = 1 / (d if abs(d) > tiny else tiny)
    total = d
    for m in range(1, 500):
        for top in (m * (b - m) * x / ((a + 2 * m - 1) * (a + 2 * m)), -(a + m) * (a + b + m) * x / ((a + 2 * m) * (a + 2 * m + 1))):
            d, c = 1 + top * d, 1 + top / c
            d = 1 / (d if abs(d) > tiny else tiny)
            c = c if abs(c) > tiny else tiny
            total *= d * c
        if abs(d * c - 1) < 1e-15:
            break
    return front * total


def t_two_sided(t: float, df: float) -> float:
    return beta_share(df / 2, 0.5, df / (df + t * t))


def f_upper(f: float, d1: float, d2: float) -> float:
    return beta_share(d2 / 2, d1 / 2, d2 / (d2 + d1 * f)) if f > 0 else 1.0


def assign(cost: np.ndarray) -> list[tuple[int, int]]:
    """The one-to-one assignment of least total cost: shortest augmenting paths with potentials."""
    flip = cost.shape[0] > cost.shape[1]
    c = cost.T if flip else cost
    n, m = c.shape
    u, v, owner = np.zeros(n), np.zeros(m), np.full(m, -1)
    for row in range(n):
        best, via, done = np.full(m, np.inf), np.full(m, -1), np.zeros(m, bool)
        at, last = row, -1
        while True:
            gain = c[at] - u[at] - v
            better = ~done & (gain + (0 if last < 0 else best[last]) < best)
            best[better] = gain[better] + (0 if last < 0 else best[last])
            via[better] = last
            last = int(np.argmin(np.where(done, np.inf, best)))
            done[last] = True
            if owner[last] < 0:
                break
            at = owner[last]
        reach = best[last]
        held = done & (owner >= 0)
        u[owner[held]] += reach - best[held]
        u[row] += reach
        v[done] -= reach - best[done]
        while last >= 0:
            before = via[last]
            owner[last] = owner[before] if before >= 0 else row
            last = before
    pairs = [(int(r), int(k)) for k, r in enumerate(owner) if r >= 0]
    return sorted((k, r) if flip else (r, k) for r, k in pairs)


def transport(rows: np.ndarray, cols: np.ndarray, cost: np.ndarray, supply: np.ndarray, demand: np.ndarray, none: float) -> np.ndarray:
    """Units sent over each pair (row, col): of least total cost, where a unit of a row that is not sent costs ``none``.

    Shortest augmenting paths with potentials over the given pairs, which are sorted by row and hold each pair once;
    memory grows with the pairs.
    """
    first = np.searchsorted(rows, np.arange(len(supply) + 1))

    def near(r: int) -> list[tuple[int, int, np.ndarray]]:
        apart = np.full(len(demand), np.inf)
        apart[cols[first[r] : first[r + 1]]] = cost[first[r] : first[r + 1]]
        return [(0, len(demand), apart)]

    units = np.zeros(len(rows), np.int64)
    for col, held in enumerate(transport_near(near, supply, demand, none)):
        for r, n in held.items():
            units[first[r] + np.flatnonzero(cols[first[r] : first[r + 1]] == col)[0]] = n
    return units


def transport_near(near: Callable[[int], list[tuple[int, int, np.ndarray]]], supply: np.ndarray, demand: np.ndarray, none: float) -> list[dict[int, int]]:
    """For each column the units that rows send to it, as in ``transport``.

    ``near`` gives ranges (from, to, costs) of columns that hold all of a row's, with infinite costs of others. A search
    looks no farther than the nearest end found so far. Memory grows with the rows and columns, if ``near`` doesn't hold
    the pairs.
    """
    u, v, left = np.zeros(len(supply)), np.zeros(len(demand)), demand.astype(np.int64)
    free = left > 0
    best, via = np.full(len(demand), np.inf), np.full(len(demand), -1)
    sent: list[dict[int, int]] = [{} for _ in demand]  # by column: what each row brings
    for row in range(len(supply)):
        more = int(supply[row])
        while more:
            seen, last, heap, done, told = {row: 0.0}, {}, [], [], []
            length, end, stay, ahead = np.inf, -1, -1, [row]  # of the nearest end so far
            while True:
                for r in ahead:  # rows reached at this length
                    d, less = seen[r], seen[r] - u[r]
                    if less + none < length:
                        length, end, stay = less + none, -1, r
                    for lo, hi, apart in near(r):
                        new = apart - v[lo:hi]
                        new += less
                        better = new < best[lo:hi]
                        better &= new < length
                        at = better.nonzero()[0]
                        if not len(at):
                            continue
                        new = np.maximum(new[at], d)  # no column is nearer than the row, so none is reached again by a rounding
                        at += lo
                        better = new < best[at]
                        at, new = at[better], new[better]
                        ends = free[at]
                        if ends.any():
                            k = int(np.where(ends, new, np.inf).argmin())
                            if new[k] < length:
                                length, end, stay, via[at[k]] = float(new[k]), int(at[k]), -1, r
                            better = (new < length) & ~ends
                            at, new = at[better], new[better]
                        best[at], via[at] = new, r
                        at = at.tolist()
                        told += at
                        for item in zip(new.tolist(), at):
                            heapq.heappush(heap, item)
                while heap and heap[0][0] > best[heap[0][1]]:
                    heapq.heappop(heap)
                if not heap or heap[0][0] >= length:
                    break
                far, col = heapq.heappop(heap)
                done.append(col)
                ahead = []
                for r in sent[col]:
                    if r not in seen:
                        seen[r], last[r] = far, col
                        ahead.append(r)
            for r, d in seen.items():
                u[r] += length - d
            for c in done:
                v[c] -= length - best[c]
            best[told] = np.inf
            # the way back: pairs that gain and, before each, the pair that loses
            gains, loses, r = [], [], stay
            if end >= 0:
                gains.append((int(via[end]), end))
                r = int(via[end])
            while r != row:
                col = last[r]
                loses.append((r, col))
                r = int(via[col])
                gains.append((r, col))
            n = min([more, *(sent[c][r] for r, c in loses), *([int(left[end])] if end >= 0 else [])])
            for r, c in gains:
                sent[c][r] = sent[c].get(r, 0) + n
            for r, c in loses:
                sent[c][r] -= n
                if not sent[c][r]:
                    del sent[c][r]
            if end >= 0:
                left[end] -= n
                free[end] = left[end] > 0
            more -= n
    return sent


def in_order(x: np.ndarray, y: np.ndarray, reach: float) -> tuple[np.ndarray, np.ndarray]:
    """Matches (rows of x, rows of y) of two sorted lists on a line: as many as can be within the reach, of least total distance.

    Matches that cross can be uncrossed at no cost, so some best ones keep the order, and prefixes are compared with
    prefixes. Rows of x are halved where the best of both parts meet, so memory grows with the points and not with their
    pairs; time grows with the pairs within the reach. A cost is complex: less the number of matches, then the distance,
    in which order NumPy compares.
    """
    found: list[tuple[int, int]] = []
    parts = [(0, len(x), 0, len(y))]
    while parts:
        i, k, j, m = parts.pop()
        own, other = x[i:k], y[j:m]
        low, high = _reached(own, other, reach)
        if k - i <= 1 or (high - low + 1).sum() <= CELLS:
            found += [(i + a, j + b) for a, b in _traced(own, other, low, high, reach)]
            continue
        h = (k - i) // 2
        before = _prefixes(own[:h], other, low[:h], high[:h], reach)
        back = -own[h:][::-1], -other[::-1]
        after = _prefixes(*back, *_reached(*back, reach), reach)[::-1]
        meet = j + int(np.argmin(before + after))
        parts += [(i, i + h, j, meet), (i + h, k, meet, m)]
    pairs = np.array(sorted(found), np.int64).reshape(-1, 2)
    return pairs[:, 0], pairs[:, 1]


#: Cells of prefixes, at most, that ``in_order`` holds at once.
CELLS = 1_000_000


def _reached(x: np.ndarray, y: np.ndarray, reach: float) -> tuple[np.ndarray, np.ndarray]:
    """For each row of x the range of y that may lie within the reach, a rounding wider; neither end falls."""
    wide = reach + 1e-12 * (np.abs(x) + reach)
    low, high = np.searchsorted(y, x - wide, "left"), np.searchsorted(y, x + wide, "right")
    return np.minimum.accumulate(low[::-1])[::-1], np.maximum.accumulate(high)


def _row(best: np.ndarray, at: float, y: np.ndarray, lo: int, hi: int, reach: float) -> np.ndarray:
    """Costs of the prefixes of lo to hi of y with one more row of x, from those without it."""
    apart = np.abs(at - y[lo:hi])
    gain = np.empty(hi - lo, complex)
    gain.real, gain.imag = np.where(apart <= reach, -1.0, np.inf), apart
    new = best[lo : hi + 1].copy()
    new[1:] = np.minimum(new[1:], best[lo:hi] + gain)
    return np.minimum.accumulate(new)


def _prefixes(x: np.ndarray, y: np.ndarray, low: np.ndarray, high: np.ndarray, reach: float) -> np.ndarray:
    """Cost of all of x with each prefix of y; below the last row's range it may be that of fewer rows, which is no less."""
    best, top = np.zeros(len(y) + 1, complex), 0
    for at, lo, hi in zip(x, low, high):
        best[top + 1 : hi + 1] = best[top]  # rows so far reach no farther
        best[lo : hi + 1] = _row(best, at, y, lo, hi, reach)
        top = hi
    best[top + 1 :] = best[top]
    return best


def _traced(x: np.ndarray, y: np.ndarray, low: np.ndarray, high: np.ndarray, reach: float) -> list[tuple[int, int]]:
    """Matches of x and y by rows of prefixes that are kept and followed back."""
    best, top, rows = np.zeros(len(y) + 1, complex), 0, []
    for at, lo, hi in zip(x, low, high):
        best[top + 1 : hi + 1] = best[top]
        rows.append(_row(best, at, y, lo, hi, reach))
        best[lo : hi + 1] = rows[-1]
        top = hi
    pairs, j = [], len(y)
    for i in range(len(x) - 1, -1, -1):
        j = min(j, int(high[i]))
        cost = rows[i][j - low[i]]
        while j > low[i] and rows[i][j - 1 - low[i]] == cost:
            j -= 1
        without = rows[i - 1][min(j, int(high[i - 1])) - low[i - 1]] if i else 0
        if cost != without:
            j -= 1
            pairs.append((i, j))
    return pairs[::-1]


def nonnegative_fit(a: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Least squares with weights of 0 or more, by active sets."""
    w, free = np.zeros(a.shape[1]), np.zeros(a.shape[1], bool)
    for _ in range(3 * a.shape[1] + 10):
        slope = a.T @ (y - a @ w)
        slope[free] = -np.inf
        if slope.max(initial=-np.inf) <= 1e-10 * max(1.0, np.abs(a.T @ y).max(initial=0)):
            break
        free[int(np.argmax(slope))] = True
        while True:
            z = np.zeros_like(w)
            z[free] = np.linalg.lstsq(a[:, free], y, rcond=None)[0]
            bad = free & (z <= 0)
            if not bad.any():
                break
            step = np.min(w[bad] / (w[bad] - z[bad]))
            w = w + step * (z - w)
            free &= w > 1e-14
            w[~free] = 0
        w = z
    return w


def logistic4(t: np.ndarray, p: np.ndarray) -> np.ndarray:
    """low + height / (1 + exp(-rate (t - middle)))."""
    return p[0] + p[1] / (1 + np.exp(-np.clip(p[2] * (t - p[3]), -60, 60)))


def fit_logistic4(t: np.ndarray, y: np.ndarray) -> tuple[np.ndarray, float]:
    """Damped least squares for ``logistic4``: parameters and residual sum of squares."""
    span = float(np.ptp(t)) or 1.0
    half = t[np.argmin(np.abs(y - (y.min() + y.max()) / 2))]
    p, damp = np.array([y.min(), float(np.ptp(y)) or 1.0, 8 / span, half]), 1e-2
    error = float(((y - logistic4(t, p)) ** 2).sum())
    for _ in range(200):
        e = 1 / (1 + np.exp(-np.clip(p[2] * (t - p[3]), -60, 60)))
        g = p[1] * e * (1 - e)
        j = np.column_stack([np.ones_like(t), e, g * (t - p[3]), -g * p[2]])
        h = j.T @ j
        step = np.linalg.lstsq(h + damp * np.diag(np.diag(h) + 1e-12), j.T @ (y - logistic4(t, p)), rcond=None)[0]
        new = float(((y - logistic4(t, p + step)) ** 2).sum())
        if new < error:
            done = error - new < 1e-12 * max(error, 1e-300)
            p, error, damp = p + step, new, damp / 3
            if done:
                break
        else:
            damp *= 4
            if damp > 1e12:
                break
    return p, error
