"""Highest obstacles on the 72 rays of many samples, on arrays of one cell.

Seen along a ray, an obstacle covers a span across it. The spans of a direction are sorted into lanes a few metres wide
and, in a lane, by how far along they end. A ray looks only at its own lane, from its sample outwards, and ends where
nothing that follows is high enough to raise its angle by a whole degree. So a ray meets a few obstacles near it, and no
pair of a sample and a far obstacle is made. Lanes only say what is tested: each test is exact and on the coordinates themselves.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np

from ..constants import AZIMUTH_BINS, EYE_HEIGHT_M, RAY_CAP_M

BLOCK_M = 8.0
#: metres by which lanes are generous
SLACK_M = 1e-5
#: heights that lanes tell apart, and by how much these are generous
HIGH_M, HIGH_SLACK_M = 1e6, 1e-3
#: an angle under half a degree is none
LEAST_RATIO = float(np.tan(np.radians(0.5)))
JUST_UNDER = 1.0 - 1e-9


@dataclass
class Spans:
    """Obstacles seen along some directions; arrays of one element per direction and obstacle that matters there.

    `v` is across the ray and `u` along it; u grows by `grade` from `u_at_low` while v goes from v_low to v_high.
    """

    turn: np.ndarray  # which of the directions
    who: np.ndarray
    v_low: np.ndarray
    v_high: np.ndarray
    u_at_low: np.ndarray
    grade: np.ndarray
    u_low: np.ndarray
    u_high: np.ndarray


def raised(ratio: np.ndarray) -> np.ndarray:
    """The ratio (tangent) that an angle must at least have to count as a higher whole degree than this one's."""
    degree = np.rint(np.clip(np.degrees(np.arctan(ratio)), 0.0, 90.0))
    return np.where(degree < 90.0, np.tan(np.radians(np.minimum(degree, 89.0) + 0.5)), np.inf) * JUST_UNDER


def turns(rays_at_once: int, samples: int, others: int):
    """Slices of the directions whose rays, and whose obstacles, fit the memory of a task."""
    step = max(1, min(AZIMUTH_BINS, rays_at_once // max(1, samples, others)))
    return (slice(i, min(i + step, AZIMUTH_BINS)) for i in range(0, AZIMUTH_BINS, step))


def _segmented(values: np.ndarray, lane: np.ndarray, wide: float, best) -> np.ndarray:
    """Least or greatest value (`best`) from each element to the end of its lane; values span less than `wide`, lanes ascend."""
    base = lane * (wide if best is np.minimum else -wide)
    return best.accumulate((values + base)[::-1])[::-1] - base


def march(spans: Spans, heights: np.ndarray, u: np.ndarray, v: np.ndarray, lane_m: float, touch_m: float, most: float, meet) -> np.ndarray:
    """Highest ratio of every ray, exact to the whole degree: an array like u and v, (direction, sample).

    meet(turn, sample, who) tells the ratio of each pair, -inf where they do not meet. All pairs are tested whose ratio
    may be `most` or more, and those within touch_m.
    """
    n_turns, n = u.shape
    u0, v0 = u.min(axis=1), v.min(axis=1)
    lanes = int((v.max(axis=1) - v0).max() // lane_m) + 1
    far = float((u.max(axis=1) - u0).max()) + RAY_CAP_M + 1.0
    blocks = int(far // BLOCK_M) + 1

    # one element per lane that a span covers
    low = np.floor((spans.v_low - SLACK_M - v0[spans.turn]) / lane_m)
    high = np.floor((spans.v_high + SLACK_M - v0[spans.turn]) / lane_m)
    seen = np.flatnonzero((high >= 0) & (low < lanes) & (spans.u_high + SLACK_M >= u0[spans.turn]) & (spans.u_low - SLACK_M <= u0[spans.turn] + far))
    low, high = np.maximum(low[seen], 0).astype("int64"), np.minimum(high[seen], lanes - 1).astype("int64")
    many = high - low + 1
    of = np.repeat(seen, many)
    lane = np.arange(len(of)) - np.repeat(np.cumsum(many) - many, many) + np.repeat(low, many)
    turn, start_v = spans.turn[of], spans.v_low[of]
    left = v0[turn] + lane * lane_m - SLACK_M - start_v
    with np.errstate(invalid="ignore", over="ignore"):
        a = spans.u_at_low[of] + np.maximum(left, 0.0) * spans.grade[of]
        b = spans.u_at_low[of] + np.minimum(left + lane_m + 2.0 * SLACK_M, spans.v_high[of] - start_v) * spans.grade[of]
        begins = np.fmax(np.fmin(a, b), spans.u_low[of]) - SLACK_M - u0[turn]
        ends = np.fmin(np.fmax(a, b), spans.u_high[of]) + SLACK_M - u0[turn]
    kept = np.flatnonzero((ends >= 0.0) & (begins <= far))
    of, turn, lane, begins, ends = of[kept], turn[kept], lane[kept], np.maximum(begins[kept], -1.0), ends[kept]

    lane = turn * lanes + lane
    cell = lane * blocks + np.minimum(ends // BLOCK_M, blocks - 1).astype("int64")
    first = np.concatenate([[0], np.cumsum(np.bincount(cell, minlength=n_turns * lanes * blocks))])
    order = np.sort(cell << 32 | np.arange(len(cell))) & 0xFFFFFFFF
    of, lane = of[order], lane[order]
    who, v_low, v_high = spans.who[of], spans.v_low[of] - SLACK_M, spans.v_high[of] + SLACK_M
    nearest = _segmented(begins[order], lane, far + 10.0, np.minimum) - SLACK_M
    above = np.clip(np.nan_to_num(heights[who], nan=-HIGH_M), -HIGH_M, HIGH_M)
    highest = _segmented(above, lane, 3.0 * HIGH_M, np.maximum) + HIGH_SLACK_M
    highest = np.where(highest >= HIGH_M, np.inf, highest) - EYE_HEIGHT_M

    along, across = (u - u0[:, None]).ravel(), v.ravel()
    lane = (np.arange(n_turns)[:, None] * lanes + ((v - v0[:, None]) // lane_m).astype("int64")).ravel()
    at, last = first[lane * blocks + (along // BLOCK_M).astype("int64")], first[(lane + 1) * blocks]
    best = np.full(n_turns * n, -np.inf)
    ray = np.flatnonzero(at < last)
    whole = np.stack([at[ray], last[ray], ray])
    real = np.stack([along[ray], across[ray], np.full(len(ray), min(LEAST_RATIO * JUST_UNDER, most))])
    with np.errstate(divide="ignore", invalid="ignore"):
        while whole.shape[1]:
            at, last, ray = whole
            gap = nearest[at] - real[0]
            on = (gap <= touch_m + SLACK_M) | ((gap <= RAY_CAP_M) & (highest[at] / gap >= real[2]))
            near = np.flatnonzero(on & (v_low[at] <= real[1]) & (real[1] <= v_high[at]))
            if len(near):
                r = ray[near]
                ratio = meet(r // n, r % n, who[at[near]])
                higher = np.flatnonzero(ratio > best[r])
                r, near, ratio = r[higher], near[higher], ratio[higher]
                best[r] = ratio
                real[2, near] = np.maximum(np.minimum(raised(ratio), most), real[2, near])
            at += 1
            on &= at < last
            if not on.all():
                whole, real = whole[:, on], real[:, on]
    return best.reshape(n_turns, n)
