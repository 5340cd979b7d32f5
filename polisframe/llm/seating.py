"""Draws of how many tables serve a dish in a restaurant of a Pitman-Yor process, from P(t) ~ S_d(c, t) a^t at every number c of customers.

S are the generalised Stirling numbers. Up to ``EXACT`` customers they come from their recurrence. Beyond it they are contour integrals,
S_d(c, t) = c! / (t! d^t) [z^c] (1 - (1 - z)^d)^t, tabulated on a geometric grid of c and interpolated in log c: one by one for the first ``FEW`` numbers of
tables, as log ratios of neighbours for more. Where more than that are likely the draw is normal, with the mode, curvature and skewness of the ratios
(within 2 % of the exact mean; within 8 % where nearly every customer has a table of their own).
"""

from __future__ import annotations

import numpy as np

from polisframe.llm._shared import uniform

EXACT, FEW = 512, 256
#: Grid steps in an octave of customers, and octaves.
_STEPS, _OCTAVES = 4, 32
_NODES = 64


def log_stirling(discount: float, most: int = EXACT) -> np.ndarray:
    """[c, t]: logarithm of the generalised Stirling number S_d(c, t), -inf where t > c or t = 0 < c."""
    out = np.full((most + 1, most + 1), -np.inf)
    out[0, 0] = 0.0
    for c in range(most):
        t = np.arange(1, c + 2)
        with np.errstate(divide="ignore"):
            stay = np.log(np.maximum(c - discount * t, 0.0)) + out[c, 1:c + 2]
        out[c + 1, 1:c + 2] = np.logaddexp(out[c, 0:c + 1], stay)
    return out


def log_coefficient(c: np.ndarray, t: np.ndarray, discount: float) -> np.ndarray:
    """log [z^c] (1 - (1 - z)^d)^t for 1 <= t < c, along a parabola around the cut z >= 1 through the saddle point.

    With z = 1 - w / c; where the power is near 1 its constant part, which adds nothing to the integral, is taken off.
    """
    c, t = np.broadcast_arrays(np.asarray(c, float), np.asarray(t, float))
    low, high = np.full(c.shape, -30.0), np.log(c) - 1e-9
    for _ in range(60):
        mid = (low + high) / 2
        x = np.exp(mid - np.log(c))
        rising = (c + 1) * x / (1 - x) - t * discount * x**discount / -np.expm1(discount * np.log(x)) > 0
        low, high = np.where(rising, low, mid), np.where(rising, mid, high)
    saddle = np.maximum(np.exp((low + high) / 2), np.minimum(1.0, c / 4))
    reach = 6.5 * np.minimum(1.0, 1 / np.sqrt(saddle))
    u = reach[..., None] * np.arange(_NODES) / (_NODES - 1)
    x = saddle[..., None] * (1 + 1j * u) ** 2 / c[..., None]
    power = np.log1p(-np.exp(np.log(x) * discount)) * t[..., None]
    kernel = -(c[..., None] + 1) * np.log1p(-x)
    deep = power[..., :1].real < -2
    scale = np.where(deep, power + kernel, kernel).real.max(axis=-1, keepdims=True)
    whole = np.exp(np.where(deep, power + kernel - scale, -np.inf))
    part = np.expm1(np.where(deep, 0, power)) * np.exp(np.where(deep, -np.inf, kernel - scale).astype(complex))
    value = (np.where(deep, whole, part) * (1 + 1j * u)).real
    value[..., 0] /= 2
    total = value.sum(axis=-1) * reach / (_NODES - 1) * 2 * saddle / (np.pi * c)
    return np.log(np.abs(total)) + scale[..., 0]


def _log_factorials(n: int) -> np.ndarray:
    return np.append(0.0, np.cumsum(np.log(np.arange(1, n + 1))))


class Seats:
    """Draws for one discount; the tables have a fixed size."""

    def __init__(self, discount: float):
        self.discount = discount
        with np.errstate(invalid="ignore"):
            self.exact = log_stirling(discount)[:, 1:].astype(np.float32)
        grid = EXACT * 2 ** (np.arange(_STEPS * _OCTAVES + 1) / _STEPS)
        few = np.arange(1, FEW + 1)
        # row by row, to need little memory
        self.few = np.stack([log_coefficient(c, few, discount) for c in grid]) - _log_factorials(FEW)[1:] - few * np.log(discount)
        self.few -= self.few[:, :1]
        # what the ratio of neighbours S(c, t + 1) / S(c, t) is beside its limit 1 / (t d)
        self.many = FEW / 8 * 2 ** (np.arange(8 * (_OCTAVES - 4)) / 8)
        inside = self.many + 1 < 0.95 * grid[:, None]
        c, t = np.where(inside, grid[:, None], EXACT), np.where(inside, self.many, 1.0)
        ratio = np.stack([log_coefficient(x, y + 1, discount) - log_coefficient(x, y, discount) for x, y in zip(c, t, strict=True)]) + np.log(t / (t + 1))
        # with nearly as many tables as customers S(c, c - j) is about (c^2 (1 - d) / 2)^j / j!
        most = np.log(2 * np.maximum(grid[:, None] - self.many, 0.5) / (grid[:, None] ** 2 * (1 - discount))) + np.log(self.many * discount)
        self.ratio = np.where(inside, ratio, most)

    def _row(self, customers: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Grid row below each number of customers, and how far it is on the way to the next."""
        at = np.clip(np.log2(customers / EXACT) * _STEPS, 0, _STEPS * _OCTAVES - 1e-6)
        return at.astype(np.int64), at - np.floor(at)

    def log_ratio(self, customers: np.ndarray, tables: np.ndarray) -> np.ndarray:
        """log S(c, t + 1) / S(c, t), interpolated."""
        row, f = self._row(customers)
        at = np.clip(np.log2(tables / self.many[0]) * 8, 0, len(self.many) - 1 - 1e-6)
        column, g = at.astype(np.int64), at - np.floor(at)
        beside = ((1 - f) * ((1 - g) * self.ratio[row, column] + g * self.ratio[row, column + 1])
                  + f * ((1 - g) * self.ratio[row + 1, column] + g * self.ratio[row + 1, column + 1]))
        return beside - np.log(tables * self.discount)

    def draw(self, customers: np.ndarray, a: np.ndarray, noise: np.ndarray) -> np.ndarray:
        """Tables of each group of customers (one or more); ``noise``: a 64-bit number of each, which fixes the draw."""
        tables = np.ones(len(customers), np.int64)
        u = uniform(noise)
        limit = a / self.discount  # t - 1 tends to a Poisson number of this mean
        reach = np.minimum(customers, np.ceil(1.3 * limit + 12 * np.sqrt(limit + 1) + 40)).astype(np.int64)
        listed = (customers > 1) & ((customers <= EXACT) | (reach <= FEW))
        rows = np.flatnonzero(listed)
        rows = rows[np.argsort(reach[rows], kind="stable")]
        while len(rows):
            n = max(1, int(np.searchsorted(np.arange(1, len(rows) + 1) * reach[rows], 1 << 20, "right")))
            now, rows = rows[:n], rows[n:]
            tables[now] = self._listed(customers[now], a[now], u[now], int(reach[now[-1]]))
        rows = np.flatnonzero((customers > 1) & ~listed)
        if len(rows):
            tables[rows] = self._normal(customers[rows], a[rows], u[rows], noise[rows])
        return tables

    def _listed(self, customers: np.ndarray, a: np.ndarray, u: np.ndarray, reach: int) -> np.ndarray:
        t = np.arange(1, reach + 1)
        score = t * np.log(a)[:, None]
        small = customers <= EXACT
        score[small] += self.exact[customers[small], :reach]
        if not small.all():
            row, f = self._row(customers[~small])
            few = min(reach, FEW)  # such rows reach no further, others of the block may
            score[~small, :few] += (1 - f)[:, None] * self.few[row, :few] + f[:, None] * self.few[row + 1, :few]
            score[~small, few:] = -np.inf
        sums = np.cumsum(np.exp(score - score.max(axis=1, keepdims=True)), axis=1)
        return 1 + np.minimum((sums < u[:, None] * sums[:, -1:]).sum(axis=1), reach - 1)

    def _normal(self, customers: np.ndarray, a: np.ndarray, u: np.ndarray, noise: np.ndarray) -> np.ndarray:
        low, high = np.ones(len(a)), customers.astype(float)
        for _ in range(50):
            mid = np.sqrt(low * high)
            up = np.log(a) + self.log_ratio(customers, mid) > 0
            low, high = np.where(up, mid, low), np.where(up, high, mid)
        top = np.sqrt(low * high)
        step = 0.05 * top
        below, here, above = (self.log_ratio(customers, top + s) for s in (-step, 0 * step, step))
        variance = np.minimum(2 * step / np.maximum(below - above, 1e-9), top)
        skew = (above + below - 2 * here) / step**2
        middle = top + 0.5 + np.clip(skew * variance**2 / 2, -2.0, 2.0)
        normal = np.sqrt(-2 * np.log(u)) * np.cos(2 * np.pi * uniform(noise + np.uint64(1 << 40)))
        return np.clip(np.rint(middle + np.sqrt(variance) * normal), 1, customers).astype(np.int64)
