"""Distances and coverage of polylines in metres, on the plane about the mean latitude of what is compared: the mean of both
sides' own means, so that it does not matter how many vertices a side is written with.

Small numpy helpers for the refine step of the spatial join: one call judges one pair of geometries."""

from __future__ import annotations

import numpy as np

from .columns import EARTH_METRES

#: Metres between the samples of a line, and below which a geometry counts as a point.
STEP, POINT_METRES = 25.0, 50.0
#: The share of both geometries that has to coincide.
LEAST_COVERAGE = 0.6
#: Metres by which rounding may carry a sample past the reach that it lies at exactly.
ROUNDING = 1e-6


def planar(*lines: np.ndarray) -> list[np.ndarray]:
    """The lines (rows of lon, lat) in metres about the mean of their mean latitudes, each unbroken at the antimeridian and in
    the branch nearest the first line's start."""
    scale = EARTH_METRES * np.cos(np.radians(np.mean([x[:, 1].mean() for x in lines])))
    return [np.column_stack([np.radians(unbroken(x, lines[0][0, 0])[:, 0]) * scale, np.radians(x[:, 1]) * EARTH_METRES]) for x in lines]


def unbroken(line: np.ndarray, near: float) -> np.ndarray:
    """The line in degrees without a break at the antimeridian, its start in the branch nearest a longitude."""
    start = line[0, 0] - 360 * np.round((line[0, 0] - near) / 360)
    east = line[:, 0] - line[0, 0]
    return np.column_stack([start + east - 360 * np.round(east / 360), line[:, 1]])


def to_segments(points: np.ndarray, line: np.ndarray) -> np.ndarray:
    """Each point's distance to a planar polyline."""
    start, step = (line, np.zeros_like(line)) if len(line) == 1 else (line[:-1], np.diff(line, axis=0))
    off = points[:, None, :] - start[None, :, :]
    square = (step**2).sum(axis=1)
    share = np.clip((off * step).sum(axis=2) / np.where(square > 0, square, 1.0), 0.0, 1.0)
    return np.sqrt(((off - share[:, :, None] * step) ** 2).sum(axis=2)).min(axis=1)


def crosses(a: np.ndarray, b: np.ndarray) -> bool:
    """Whether some segment of a properly crosses one of b; touching ends are found by the distances."""
    if len(a) < 2 or len(b) < 2:
        return False

    def side(p: np.ndarray, q: np.ndarray, r: np.ndarray) -> np.ndarray:
        return np.sign((q[..., 0] - p[..., 0]) * (r[..., 1] - p[..., 1]) - (q[..., 1] - p[..., 1]) * (r[..., 0] - p[..., 0]))

    p, q, r, s = a[:-1, None], a[1:, None], b[None, :-1], b[None, 1:]
    return bool(((side(p, q, r) * side(p, q, s) < 0) & (side(r, s, p) * side(r, s, q) < 0)).any())


def min_distance(a: np.ndarray, b: np.ndarray) -> float:
    a, b = planar(a, b)
    return 0.0 if crosses(a, b) else float(min(to_segments(a, b).min(), to_segments(b, a).min()))


def length(line: np.ndarray) -> float:
    return float(np.hypot(*np.diff(planar(line)[0], axis=0).T).sum()) if len(line) > 1 else 0.0


def samples(line: np.ndarray, step: float = STEP) -> np.ndarray:
    """Points of an unbroken line in degrees every step metres along its whole length, and its end once."""
    if len(line) < 2:
        return line
    walked = np.concatenate([[0.0], np.cumsum(np.hypot(*np.diff(planar(line)[0], axis=0).T))])
    if walked[-1] == 0:
        return line[:1]
    at = np.append(np.arange(0.0, walked[-1], step), walked[-1])
    return np.column_stack([np.interp(at, walked, line[:, k]) for k in (0, 1)])


def coverage(a: np.ndarray, b: np.ndarray, reach: float) -> float:
    """The share of a's samples that lie within reach of b, each on the plane about the mean of its own latitude and b's."""
    points = samples(unbroken(a, b[0, 0]))
    b = unbroken(b, b[0, 0])
    scale = np.column_stack([np.cos(np.radians((points[:, 1] + b[:, 1].mean()) / 2)), np.ones(len(points))]) * EARTH_METRES
    start, step = (b, np.zeros_like(b)) if len(b) == 1 else (b[:-1], np.diff(b, axis=0))
    off, step = np.radians(points[:, None] - start[None]) * scale[:, None], np.radians(step)[None] * scale[:, None]
    square = (step**2).sum(axis=2)
    share = np.clip((off * step).sum(axis=2) / np.where(square > 0, square, 1.0), 0.0, 1.0)
    return float((np.sqrt(((off - share[:, :, None] * step) ** 2).sum(axis=2)).min(axis=1) <= reach + ROUNDING).mean())


def symmetric_coverage(a: np.ndarray, b: np.ndarray, reach: float) -> float:
    """The smaller share of either line's samples that lie within reach of the other."""
    return min(coverage(a, b, reach), coverage(b, a, reach))


def distance_rows(p: np.ndarray, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Row by row, the distance of point p to the planar segment from a to b."""
    (along, up), (east, north) = ((q - a).T for q in (b, p))
    square = along * along + up * up
    share = np.clip((east * along + north * up) / np.where(square > 0, square, 1.0), 0.0, 1.0)
    east, north = east - share * along, north - share * up
    return np.sqrt(east * east + north * north)


def judge_short(a: np.ndarray, b: np.ndarray, points: np.ndarray, others: np.ndarray, reach: float) -> tuple[np.ndarray, np.ndarray]:
    """(metres, coverage) as judge_ends, the smaller coverage of the two."""
    metres, *shares = judge_ends(a, b, points, others, reach)
    return metres, np.minimum(*shares)


def judge_ends(a: np.ndarray, b: np.ndarray, points: np.ndarray, others: np.ndarray, reach: float) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(metres, coverage of a, of b) of many pairs at once, each side a point or a line of two ends: a and b hold the ends
    (pairs, 2, 2), a point's twice; points and others say which are points. Coverage is nan beyond reach and between points."""
    scale = EARTH_METRES * np.cos(np.radians((a[:, :, 1].mean(axis=1) + b[:, :, 1].mean(axis=1)) / 2))

    def unbroken_ends(x: np.ndarray) -> np.ndarray:
        start = x[:, 0, 0] - 360 * np.round((x[:, 0, 0] - a[:, 0, 0]) / 360)
        east = x[:, 1, 0] - x[:, 0, 0]
        return np.stack([np.column_stack([start, start + east - 360 * np.round(east / 360)]), x[:, :, 1]], axis=2)

    def planar_ends(x: np.ndarray) -> list[np.ndarray]:
        return [np.column_stack([np.radians(x[:, k, 0]) * scale, np.radians(x[:, k, 1]) * EARTH_METRES]) for k in (0, 1)]

    def own_length(x: np.ndarray) -> np.ndarray:
        east = x[:, 1, 0] - x[:, 0, 0]
        return EARTH_METRES * np.hypot(np.radians(east - 360 * np.round(east / 360)) * np.cos(np.radians(x[:, :, 1].mean(axis=1))), np.radians(x[:, 1, 1] - x[:, 0, 1]))

    def side(p: np.ndarray, q: np.ndarray, r: np.ndarray) -> np.ndarray:
        return np.sign((q[:, 0] - p[:, 0]) * (r[:, 1] - p[:, 1]) - (q[:, 1] - p[:, 1]) * (r[:, 0] - p[:, 0]))

    x, y = unbroken_ends(a), unbroken_ends(b)
    (p, q), (r, s) = planar_ends(x), planar_ends(y)
    metres = np.minimum.reduce([distance_rows(p, r, s), distance_rows(q, r, s), distance_rows(r, p, q), distance_rows(s, p, q)])
    metres[(side(p, q, r) * side(p, q, s) < 0) & (side(r, s, p) * side(r, s, q) < 0)] = 0.0
    shares = [np.full(len(a), np.nan) for _ in range(2)]
    at = np.flatnonzero((metres <= reach) & (np.maximum(own_length(a), own_length(b)) >= POINT_METRES))
    if len(at):
        shares[0][at], shares[1][at] = within(x[at], y[at], reach), within(y[at], x[at], reach)
    return metres, *shares


def judge(left: tuple[np.ndarray, np.ndarray, np.ndarray], right: tuple[np.ndarray, np.ndarray, np.ndarray], reach: float) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(metres, coverage of the left, of the right) of pairs of (vertices, start, size); coverage is nan beyond reach and between
    points. Points and lines of two ends are judged together, longer lines pair by pair."""
    n = len(left[1])
    metres, shares = np.full(n, np.inf), [np.full(n, np.nan) for _ in range(2)]
    short = (left[2] <= 2) & (right[2] <= 2)
    at = np.flatnonzero(short)
    if len(at):
        ends = [xy[np.stack([start[at], start[at] + size[at] - 1], axis=1)] for xy, start, size in (left, right)]
        metres[at], shares[0][at], shares[1][at] = judge_ends(*ends, *(size[at] == 1 for _, _, size in (left, right)), reach)
    for k in np.flatnonzero(~short).tolist():
        a, b = (xy[start[k] : start[k] + size[k]] for xy, start, size in (left, right))
        metres[k] = min_distance(a, b)
        if metres[k] <= reach and max(length(a), length(b)) >= POINT_METRES:
            shares[0][k], shares[1][k] = coverage(a, b, reach), coverage(b, a, reach)
    return metres, *shares


def within(x: np.ndarray, y: np.ndarray, reach: float) -> np.ndarray:
    """Row by row, the share of the samples of line x (its ends in degrees, unbroken) that lie within reach of line y, each on
    the plane about the mean of its own latitude and y's. Where both run along latitudes, the samples within reach lie side by side:
    only those next to where they must begin and end are looked at."""
    own = x[:, :, 1].mean(axis=1)
    run = np.radians(x[:, 1] - x[:, 0]) * EARTH_METRES
    long = np.hypot(run[:, 0] * np.cos(np.radians(own)), run[:, 1])
    steps = np.ceil(long / STEP).astype(np.int64)  # and the end; a line without length is its start alone
    near = np.empty(len(x), dtype=np.int64)
    level = (x[:, 0, 1] == x[:, 1, 1]) & (y[:, 0, 1] == y[:, 1, 1]) & (steps > 6)
    level &= np.abs(np.radians(y[:, 0, 1] - x[:, 0, 1])) * EARTH_METRES < reach - 1000 * ROUNDING
    for rows, count in ((np.flatnonzero(~level), each_sample), (np.flatnonzero(level), first_and_last)):
        if len(rows):
            near[rows] = count(x[rows], y[rows], long[rows], steps[rows], reach)
    return near / (steps + 1)


def near_samples(row: np.ndarray, k: np.ndarray, x: np.ndarray, y: np.ndarray, long: np.ndarray, steps: np.ndarray, reach: float) -> np.ndarray:
    """Whether sample k of line x[row] lies within reach of y[row]."""
    share = np.where(k == steps[row], 1.0, k * STEP / np.where(long > 0, long, 1.0)[row])
    (lon, lat), (ends, ahead) = (x[row, 0, d] + (x[:, 1, d] - x[:, 0, d])[row] * share for d in (0, 1)), (y[row, 0], y[row, 1])
    scale = np.cos(np.radians((lat + y[:, :, 1].mean(axis=1)[row]) / 2)) * EARTH_METRES
    east, north = np.radians(ends[:, 0] - lon) * scale, np.radians(ends[:, 1] - lat) * EARTH_METRES
    along, up = np.radians(ahead[:, 0] - lon) * scale - east, np.radians(ahead[:, 1] - lat) * EARTH_METRES - north
    square = along * along + up * up
    at = np.clip(-(east * along + north * up) / np.where(square > 0, square, 1.0), 0.0, 1.0)
    east, north = -east - at * along, -north - at * up
    return np.sqrt(east * east + north * north) <= reach + ROUNDING


def each_sample(x: np.ndarray, y: np.ndarray, long: np.ndarray, steps: np.ndarray, reach: float) -> np.ndarray:
    """How many samples of line x lie within reach of y."""
    row = np.repeat(np.arange(len(x)), steps + 1)
    k = np.arange(len(row)) - np.repeat(np.cumsum(steps + 1) - steps - 1, steps + 1)
    return np.bincount(row, weights=near_samples(row, k, x, y, long, steps, reach), minlength=len(x)).astype(np.int64)


def first_and_last(x: np.ndarray, y: np.ndarray, long: np.ndarray, steps: np.ndarray, reach: float) -> np.ndarray:
    """As each_sample, of lines along latitudes. A sample that rounding puts on the other side of where they begin or end is
    next to it, so the two on each side decide."""
    north = np.radians(y[:, 0, 1] - x[:, 0, 1]) * EARTH_METRES
    scale = np.cos(np.radians((x[:, 0, 1] + y[:, 0, 1]) / 2)) * EARTH_METRES
    rim = np.degrees(np.sqrt(np.maximum((reach + ROUNDING) ** 2 - north * north, 0.0)) / scale)
    a, b = ((e - x[:, 0, 0]) / (x[:, 1, 0] - x[:, 0, 0]) * long / STEP for e in (y[:, :, 0].min(axis=1) - rim, y[:, :, 0].max(axis=1) + rim))
    low, high = np.clip(np.ceil(np.minimum(a, b)), 0, steps).astype(np.int64), np.clip(np.floor(np.maximum(a, b)), -1, steps - 1).astype(np.int64)
    at = np.stack([low - 1, low, high, high + 1, steps], axis=1)
    row = np.repeat(np.arange(len(x)), 5)
    on = near_samples(row, at.ravel(), x, y, long, steps, reach).reshape(-1, 5)
    on[:, :4] &= (at[:, :4] >= 0) & (at[:, :4] < steps[:, None])  # the end stands by itself
    low, high = np.where(on[:, 0], low - 1, np.where(on[:, 1], low, low + 1)), np.where(on[:, 3], high + 1, np.where(on[:, 2], high, high - 1))
    return np.maximum(high - low + 1, 0) + on[:, 4]
