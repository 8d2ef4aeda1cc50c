"""Numbers of tables in a Pitman-Yor restaurant, drawn from their conditional.

Given the tables T of a restaurant's other dishes and the probability p of a dish
above, c customers of the dish sit at t tables with a probability in proportion to
the product of (strength + d (T + i)) p for i below t, times S(c, t): the ways to
divide c customers over t tables, a generalised Stirling number. Up to ``EXACT``
customers the numbers come from their recurrence. For more, S(c, t) t! d^t / c! is the
probability that t Sibuya(d) numbers add up to c, the coefficient of z^c in
(1 - (1 - z)^d)^t: by an integral around the branch cut where t is below c^d, by a
saddle point where it is above and the integral would cancel.
"""

from __future__ import annotations

import functools
import math

import numpy as np

#: Customers of a dish up to which the recurrence is used, and up to which its numbers are not taken as logarithms.
EXACT, SMALL = 1024, 32
#: Cells of one matrix of weights, and points of the grid of t for many customers.
CELLS, POINTS = 1_000_000, 500


@functools.lru_cache(maxsize=8)
def stirling(d: float, most: int = EXACT) -> tuple[np.ndarray, np.ndarray]:
    """Logarithms of S(c, t + 1) at [t, c] for c up to ``most``, and S(c, t + 2) / S(c, t + 1)."""
    ways = np.full((most, most + 1), -np.inf)
    ways[0, 1] = 0.0
    for c in range(2, most + 1):
        t = np.arange(1, c)
        ways[: c - 1, c] = ways[: c - 1, c - 1] + np.log(c - 1 - d * t)
        ways[1:c, c] = np.logaddexp(ways[1:c, c], ways[: c - 1, c - 1])
    with np.errstate(invalid="ignore"):
        ratio = np.exp(np.diff(ways[: SMALL + 1], axis=0))
    return ways, np.nan_to_num(ratio, nan=0.0)


def _cut(n: int, t: np.ndarray, d: float) -> np.ndarray:
    """Log probabilities that t Sibuya numbers add up to n, by the integral along both sides of the cut."""
    y = np.linspace(-25.0, math.log(80.0), 260)
    x = np.exp(y) / n
    side = np.log(1 - np.expm1(x) ** d * np.exp(-1j * math.pi * d))
    part = np.exp(t[:, None] * side[None, :] - n * x[None, :]).imag * x
    return np.log(np.maximum(part.sum(1) * (y[1] - y[0]) / math.pi, 1e-300))


def _saddle(n: int, t: np.ndarray, d: float) -> np.ndarray:
    """The same for t below n by the saddle point of t log(1 - (1 - e^s)^d) - n s, u being 1 - e^s."""
    low, high = np.full(len(t), math.log(1e-300)), np.full(len(t), -1e-15)
    for _ in range(80):
        mid = (low + high) / 2
        few = t * d * np.exp((d - 1) * mid) * np.expm1(mid) / np.expm1(d * mid) < n
        high, low = np.where(few, mid, high), np.where(few, low, mid)
    log_u = (low + high) / 2
    u, rest, power = np.exp(log_u), -np.expm1(log_u), -np.expm1(d * log_u)
    slope = d * (((d - 1) * u ** (d - 2) * rest - u ** (d - 1)) * power + d * rest * u ** (2 * d - 2)) / power**2
    return t * np.log(power) - n * np.log(rest) - 0.5 * np.log(2 * math.pi * t * rest * -slope)


def log_sums(n: int, t: np.ndarray, d: float) -> np.ndarray:
    """Log probabilities that t Sibuya(d) numbers add up to n."""
    t = np.asarray(t, np.float64)
    edge = min(max(1.5 * n**d, 1.0), n - 1.0)
    out = np.empty(len(t))
    below, above = t <= edge, (t > edge) & (t < n)
    if below.any():
        out[below] = _cut(n, t[below], d)
    if above.any():
        at = np.array([edge])
        out[above] = _saddle(n, t[above], d) + (_cut(n, at, d) - _saddle(n, at, d))
    out[t == n] = n * math.log(d)
    return out


def _log_weights(c: int, t: np.ndarray, fixed: float, parent: float, d: float) -> np.ndarray:
    a = fixed / d
    return np.array([math.lgamma(a + x) - math.lgamma(x + 1) for x in t.tolist()]) + t * math.log(parent) + log_sums(c, t, d)


def many(u: float, c: int, fixed: float, parent: float, d: float) -> int:
    """Tables of c customers, by inversion over all t if few can matter, else over a grid that is made finer where the probability is.

    Without the customers' number t - 1 is negative binomial, and c customers make large
    t less likely still, so what is 12 deviations above that mean is left out.
    """
    mean = (fixed / d + 1) * parent / max(1 - parent, 1e-12)
    most = min(c, int(31 + mean + 12 * math.sqrt(mean / max(1 - parent, 1e-12))))
    t, end = np.arange(1, most + 1), most + 1
    if most > POINTS:
        t = np.unique(np.rint(np.geomspace(1, most, POINTS)).astype(np.int64))  # a point stands for those up to the next one
        for _ in range(2):
            w = _log_weights(c, t, fixed, parent, d)
            near = np.flatnonzero(w + np.log(np.diff(np.r_[t, end])) > w.max() - 32)
            low, end = int(t[max(near[0] - 1, 0)]), int(np.r_[t, end, end][near[-1] + 2])
            t = np.arange(low, end) if end - low <= 2 * POINTS else np.unique(np.rint(np.linspace(low, end - 1, 2 * POINTS)).astype(np.int64))
    w = _log_weights(c, t, fixed, parent, d)
    width = np.diff(np.r_[t, end])
    sums = np.cumsum(np.exp(w - w.max()) * width)
    spot = min(int(np.searchsorted(sums, u * sums[-1], side="right")), len(t) - 1)
    inside = (u * sums[-1] - (sums[spot - 1] if spot else 0.0)) / max(sums[spot] - (sums[spot - 1] if spot else 0.0), 1e-300)
    return int(t[spot] + min(int(inside * width[spot]), width[spot] - 1))


def _most(c: np.ndarray, fixed: np.ndarray, parent: np.ndarray, d: float) -> np.ndarray:
    """How many tables c customers can have but for a probability that does not matter; see :func:`many`."""
    rest = np.maximum(1 - parent, 1e-12)
    mean = (fixed / d + 1) * parent / rest
    return np.minimum(c, 31 + mean + 12 * np.sqrt(mean / rest)).astype(np.int64)


def tables(u: np.ndarray, c: np.ndarray, fixed: np.ndarray, parent: np.ndarray, d: float) -> np.ndarray:
    """Tables of dishes with c customers each, one uniform number u a dish; ``fixed`` is strength + d * tables of the other dishes.

    Dishes that can have about as many tables are drawn together.
    """
    t = (c > 0).astype(np.int64)
    ways, ratio = stirling(d)
    for i in np.flatnonzero(c > EXACT):
        t[i] = many(float(u[i]), int(c[i]), float(fixed[i]), float(parent[i]), d)
    some = np.flatnonzero((c > 1) & (c <= EXACT))
    most = _most(c[some], fixed[some], parent[some], d)
    order = np.argsort(most, kind="stable")
    some, most = some[order], most[order]
    at = 0
    while at < len(some):
        m = int(most[at])
        m = min(m if m < 5 else m + m // 4, EXACT)
        end = int(np.searchsorted(most, m, side="right"))
        for k in range(at, end, step := max(CELLS // m, 1)):
            j = some[k : min(k + step, end)]
            n, f, p = c[j], fixed[j], parent[j]
            if m <= SMALL:
                sums, w = np.empty((m, len(j))), np.ones(len(j))
                sums[0] = 1.0
                for i in range(1, m):
                    w = w * ((f + d * i) * p * ratio[i - 1, n])
                    np.add(sums[i - 1], w, out=sums[i])
            else:
                w = np.cumsum(np.log((f + d * np.arange(m)[:, None]) * p), 0) + ways[:m, n]
                sums = np.cumsum(np.exp(w - w.max(0)), 0)
            t[j] = 1 + (sums[:-1] <= u[j] * sums[-1]).sum(0)
        at = end
    return t
