"""SetSketch registers of shingle sets, and the joint estimate of two sets' similarity from them.

A register holds floor(1 - log_base(x)) of the least x that any element draws for it, where an element's draws for a
register are exponential with rate RATE. Draws are made as one ascending stream per element whose points fall on
random registers; the stream is followed only as far as points can still be a register's minimum, so a
set of n elements costs about n + M log M draws. Registers of a union are the larger ones of both: sketches merge.
"""

from __future__ import annotations

import numpy as np

M = 252
BASE = 1.001
RATE = 20.0
_TOP = 65534
_LOG_BASE = np.log(BASE)
_GOLD, _C1, _C2 = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB)


def mix(z: np.ndarray) -> np.ndarray:
    z = (z ^ (z >> np.uint64(30))) * _C1
    z = (z ^ (z >> np.uint64(27))) * _C2
    return z ^ (z >> np.uint64(31))


def sketch(elements: np.ndarray, owner: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """elements: distinct 64-bit hashes per owner; owner: 0..len(sizes)-1; sizes: elements per owner (> 0). Rows of M registers."""
    n = len(sizes)
    least = np.full(n * M, np.inf)
    todo = np.arange(n)
    reach = (np.log(M) + 3.0) / (RATE * sizes)
    while len(todo):
        wanted = np.zeros(n, bool)
        wanted[todo] = True
        keep = wanted[owner]
        h, own = elements[keep], owner[keep]
        x = np.zeros(len(h))
        at, step = 0, 1
        while len(h):
            k = np.arange(at, at + step, dtype=np.uint64)
            z = mix(h[:, None] + (k[None, :] + np.uint64(1)) * _GOLD)
            u = ((z >> np.uint64(11)).astype(np.float64) + 0.5) * 2.0**-53
            points = x[:, None] + np.cumsum(-np.log(u), axis=1) / (M * RATE)
            place = (mix(z ^ _C2) >> np.uint64(33)) % np.uint64(M)
            inside = points <= reach[own][:, None]
            slot = own[:, None] * M + place.astype(np.int64)
            np.minimum.at(least, slot[inside], points[inside])
            on = inside[:, -1]
            h, own, x = h[on], own[on], points[on, -1]
            at, step = at + step, min(step * 2, 64)
        bad = ~np.isfinite(least.reshape(n, M)).all(axis=1)
        todo = np.flatnonzero(bad)
        reach[todo] *= 2
    return np.clip(np.floor(1 - np.log(least.reshape(n, M)) / _LOG_BASE), 0, _TOP).astype(np.uint16)


def _p(x: np.ndarray) -> np.ndarray:
    return -np.log1p(-np.clip(x, 1e-12, 1) * (BASE - 1) / BASE) / _LOG_BASE


def _likelihood(j, u, v, more, less, same):
    a, b = _p(u - v * j), _p(v - u * j)
    return more * np.log(a) + less * np.log(b) + same * np.log(np.clip(1 - a - b, 1e-12, 1))


def may_reach(more: np.ndarray, less: np.ndarray, n_a: np.ndarray, n_b: np.ndarray, threshold: float, slack: float = 14.0) -> np.ndarray:
    """Whether similarity `threshold` is compatible with the registers: more/less count those in which a's is larger/smaller.

    The sizes are known, so the similarity is the only parameter of the joint likelihood. A pair passes if its
    maximum lies at the threshold or above, or is at most `slack` (over 5 standard deviations) better than the threshold.
    """
    u = n_a / (n_a + n_b)
    v = 1 - u
    most = np.minimum(u / v, v / u)
    same = M - more - less
    best = np.full(len(u), -np.inf)
    at = np.zeros(len(u))
    for step in np.linspace(0, 1, 33):
        j = step * most
        value = _likelihood(j, u, v, more, less, same)
        better = value > best
        best, at = np.where(better, value, best), np.where(better, j, at)
    here = _likelihood(np.minimum(threshold, most), u, v, more, less, same)
    return (most >= threshold - 1e-12) & ((at >= threshold) | (here >= best - slack))
