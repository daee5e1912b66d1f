"""Additive Holt-Winters with a weekly season for many series at once (M6).

A Spark task holds a batch of series as arrays of daily values and moves all of them, at all parameter points tried, one day a
step: the recurrence (see ``forecast``) is then a few vector operations a day, whatever the number of keys and points. Memory is bounded in
steps of ``WIDTH`` series-points.

Three ways to choose what the recurrence needs:

* fixed: given (alpha, beta, gamma), start state from the first two weeks;
* grid: the same start, the point of a grid with the smallest squared error (of equals the first);
* estimated: the fits are linear in the start state (level, trend, seven seasons), so the recurrence also carries the state's sensitivities to
  it, and the normal equations of a series give the start with the smallest squared error for a point. The point itself is
  found in the unit cube by a pattern search from the best one of the grid, all series in lock step: six neighbours a round, the step is halved where
  none is better. The season of the start sums to zero, which fixes the one direction that no fit can tell.
"""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import pyarrow as pa

M = 7
STATES = 2 + M
#: series-points moved at once
WIDTH = 4096
#: series of one output batch
ROWS = 1024
#: first and last step of the pattern search
FIRST_STEP, LAST_STEP = 0.1, 1e-4

RESULT = "series_key string, a double, c double, g double, sse double, level double, trend double, ring array<double>, start array<double>, fits array<double>"


def start_states(y: np.ndarray) -> np.ndarray:
    """Level, trend and seasons of the first two weeks; sums run left to right."""
    first, second = y[:, 0].copy(), y[:, M].copy()
    for i in range(1, M):
        first = first + y[:, i]
        second = second + y[:, M + i]
    level = first / float(M)
    return np.column_stack([level, (second / float(M) - level) / float(M), *(y[:, i] - level for i in range(M))])


def run(y: np.ndarray, n: np.ndarray, start: np.ndarray, p: np.ndarray, keep: bool = False):
    """Squared error, last state and (if asked for) fits of each row: values y[:, :n], start states, points (a, c, g).
    A row stays as it is behind its own last day."""
    a, c, g = p.T
    level, trend = start[:, 0].copy(), start[:, 1].copy()
    ring = [start[:, 2 + i].copy() for i in range(M)]
    days = np.ascontiguousarray(y.T)
    sse, fits = np.zeros(len(y)), np.zeros(days.shape) if keep else None
    least = int(n.min(initial=len(days)))
    for t, x in enumerate(days):
        s0 = ring[t % M]
        base = level + trend
        fit = base + s0
        err = x - fit
        new = a * (x - s0) + (1.0 - a) * base
        slope = c * (new - level) + (1.0 - c) * trend
        season = g * (x - level - trend) + (1.0 - g) * s0
        if t < least:
            sse += err * err
            level, trend, ring[t % M] = new, slope, season
        else:
            on = t < n
            sse = np.where(on, sse + err * err, sse)
            level, trend, ring[t % M] = np.where(on, new, level), np.where(on, slope, trend), np.where(on, season, s0)
        if keep:
            fits[t] = fit
    at = (n[:, None] + np.arange(M)) % M  # the season of the day behind the last comes first
    return sse, level, trend, np.take_along_axis(np.column_stack(ring), at, axis=1), fits.T if keep else None


def best_start(y: np.ndarray, n: np.ndarray, p: np.ndarray) -> np.ndarray:
    """The start states with the smallest squared error for the points p, by normal equations carried along the recurrence."""
    rows = len(y)
    a, c, g = (x[:, None] for x in p.T)
    unit = np.zeros((rows, STATES + 1))  # a state as a function of the start: its sensitivities, and a constant
    level, trend = unit.copy(), unit.copy()
    level[:, 0] = trend[:, 1] = 1.0
    ring = []
    for i in range(M):
        ring.append(unit.copy())
        ring[-1][:, 2 + i] = 1.0
    normal = np.zeros((rows, STATES + 1, STATES + 1))
    for t in range(y.shape[1]):
        s0, base = ring[t % M], level + trend
        miss = -(base + s0)
        miss[:, -1] += y[:, t]
        on = (t < n)[:, None]
        miss = np.where(on, miss, 0.0)
        normal += miss[:, :, None] * miss[:, None, :]
        x = unit.copy()
        x[:, -1] = y[:, t]
        new = a * (x - s0) + (1.0 - a) * base
        slope = c * (new - level) + (1.0 - c) * trend
        season = g * (x - base) + (1.0 - g) * s0
        level, trend, ring[t % M] = np.where(on, new, level), np.where(on, slope, trend), np.where(on, season, s0)
    w, r = normal[:, :STATES, :STATES], normal[:, :STATES, -1]
    size = np.trace(w, axis1=1, axis2=2)[:, None, None] + 1e-300
    flat = np.zeros(STATES)
    flat[2:] = 1.0
    w = w + size * (np.outer(flat, flat) + 1e-13 * np.eye(STATES))
    return -np.linalg.solve(w, r[:, :, None])[:, :, 0]


def _tried(y, n, p, start_of):
    """Squared error and start of every (row, point), in steps of bounded width; p has the shape (rows, points, 3)."""
    rows, points = p.shape[:2]
    sse, start = np.empty((rows, points)), np.empty((rows, points, STATES))
    step = max(1, WIDTH // points)
    for i in range(0, rows, step):
        j = min(i + step, rows)
        wide = lambda x: np.repeat(x[i:j], points, axis=0)  # noqa: E731, B023
        q = p[i:j].reshape(-1, 3)
        s = start_of(wide(y), wide(n), q)
        sse[i:j] = run(wide(y), wide(n), s, q)[0].reshape(j - i, points)
        start[i:j] = s.reshape(j - i, points, STATES)
    return sse, start


def grid_points(y: np.ndarray, n: np.ndarray, grid: np.ndarray, start_of) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(point, squared error, start) of the best grid point of each row, of equals the first."""
    sse, start = _tried(y, n, np.broadcast_to(grid, (len(y), *grid.shape)), start_of)
    at, rows = sse.argmin(axis=1), np.arange(len(y))
    return grid[at], sse[rows, at], start[rows, at]


def estimate(y: np.ndarray, n: np.ndarray, grid: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(point, squared error, start) with start states and point both estimated; never worse than the grid from the usual start."""
    scale = np.maximum(np.abs(y).max(axis=1, keepdims=True), 1e-300)
    z = y / scale
    usual, usual_sse, usual_start = grid_points(z, n, grid, lambda v, *_: start_states(v))
    p, sse, start = grid_points(z, n, grid, best_start)
    worse = usual_sse < sse
    p[worse], sse[worse], start[worse] = usual[worse], usual_sse[worse], usual_start[worse]
    step = np.full(len(y), FIRST_STEP)
    moves = np.concatenate([np.eye(3), -np.eye(3)])
    while (live := np.flatnonzero(step >= LAST_STEP)).size:
        near = np.clip(p[live, None] + step[live, None, None] * moves, 0.0, 1.0)
        tried, starts = _tried(z[live], n[live], near, best_start)
        at = tried.argmin(axis=1)
        low = tried[np.arange(len(live)), at]
        better = low < sse[live] * (1 - 1e-12)
        x = live[better]
        p[x], sse[x], start[x] = near[better, at[better]], low[better], starts[better, at[better]]
        step[live[~better]] /= 2
    return p, sse * scale[:, 0] ** 2, start * scale


def chosen(mode: str, fixed: Sequence[float], grid: np.ndarray, y: np.ndarray, n: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(point, start state) of each row, by one of the three ways."""
    if mode == "estimated":
        p, _, start = estimate(y, n, grid)
    elif mode == "grid":
        p, _, start = grid_points(y, n, grid, lambda v, *_: start_states(v))
    else:
        p, start = np.broadcast_to(np.array(fixed, float), (len(y), 3)), start_states(y)
    return p, start


def _lists(x: np.ndarray, n: np.ndarray | int) -> pa.Array:
    """The first n entries of each row as a list."""
    n = np.broadcast_to(n, len(x))
    off = np.concatenate(([0], np.cumsum(n))).astype(np.int32)
    return pa.ListArray.from_arrays(pa.array(off), pa.array(x[np.arange(x.shape[1]) < n[:, None]]))


def smoother(mode: str, fixed: Sequence[float], grid: np.ndarray):
    """Arrow batches of (series_key, ys, more) -> rows of RESULT, followed by the further columns."""
    def of(batches):
        for whole in batches:
            for at in range(0, whole.num_rows, ROWS):
                b = whole.slice(at, ROWS)
                ys = b.column("ys")
                n = np.diff(ys.offsets.to_numpy())
                y = np.zeros((len(n), int(n.max())))
                y[np.arange(y.shape[1]) < n[:, None]] = ys.flatten().to_numpy(zero_copy_only=False)
                p, start = chosen(mode, fixed, grid, y, n)
                sse, level, trend, ring, fits = run(y, n, start, p, keep=True)
                numbers = [pa.array(np.ascontiguousarray(x)) for x in (*p.T, sse, level, trend)]
                more = [(c, b.column(c)) for c in b.schema.names if c not in ("series_key", "ys")]
                yield pa.RecordBatch.from_arrays([b.column("series_key"), *numbers, _lists(ring, M), _lists(start, STATES), _lists(fits, n), *(x for _, x in more)],
                                                 names=["series_key", "a", "c", "g", "sse", "level", "trend", "ring", "start", "fits", *(c for c, _ in more)])
    return of
