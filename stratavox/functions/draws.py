"""Random numbers that are pure functions of a seed and a key.

A uniform number comes from the digest of its key, so it does not depend on partitions,
order or retries, and SQL can draw the same one.
"""

from __future__ import annotations

import math

import numpy as np
from pyspark.sql import Column
from pyspark.sql import functions as F

#: Hexadecimal digits of a digest that make a uniform number: 52 bits.
DIGITS = 13


def uniform(seed: int, *key: Column | str) -> Column:
    """Number from 0 to below 1 for each key; nulls in a key count as empty."""
    parts = [F.coalesce((F.col(k) if isinstance(k, str) else k).cast("string"), F.lit("")) for k in key]
    return F.conv(F.left(F.md5(F.concat_ws(":", F.lit(str(seed)), *parts)), F.lit(DIGITS)), 16, 10).cast("long") / F.lit(float(16**DIGITS))


def uniform_sql(seed: int, *key: str) -> str:
    """The same number in SQL."""
    parts = ", ".join(f"coalesce(({k})::VARCHAR, '')" for k in key)
    return f"(('0x' || left(md5(concat_ws(':', '{seed}', {parts})), {DIGITS}))::BIGINT / {float(16**DIGITS)!r})"


def normal(first: Column, second: Column) -> Column:
    """Standard normal number from two uniform ones."""
    return F.sqrt(-2 * F.log(1 - first)) * F.cos(F.lit(2 * math.pi) * second)


class Stream:
    """Uniform numbers one after another for each of many rows, all rows at once."""

    def __init__(self, first: np.ndarray) -> None:
        self.state = (first * 2.0**52).astype(np.uint64) << np.uint64(11)

    def next(self, at: np.ndarray) -> np.ndarray:
        """The next number, above 0 and below 1, of the rows ``at``."""
        with np.errstate(over="ignore"):
            self.state[at] += np.uint64(0x9E3779B97F4A7C15)
            z = self.state[at]
            z = (z ^ (z >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
            z = (z ^ (z >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
        return ((z ^ (z >> np.uint64(31))) >> np.uint64(12)).astype(np.float64) * 2.0**-52 + 2.0**-53

    def normal(self, at: np.ndarray) -> np.ndarray:
        return np.sqrt(-2 * np.log(self.next(at))) * np.cos(2 * np.pi * self.next(at))


def gamma(shape: np.ndarray, stream: Stream, rows: np.ndarray) -> np.ndarray:
    """Gamma numbers by rejection from cubed normals, for all rows still open at once; shapes under 1 by a power of a uniform."""
    out = np.empty(len(rows))
    d = np.where(shape < 1, shape + 1, shape) - 1 / 3
    c = 1 / np.sqrt(9 * d)
    open_ = np.arange(len(rows))
    while len(open_):
        x, u = stream.normal(rows[open_]), stream.next(rows[open_])
        v = (1 + c[open_] * x) ** 3
        with np.errstate(invalid="ignore", divide="ignore"):
            good = (v > 0) & (np.log(u) < 0.5 * x * x + d[open_] * (1 - v + np.log(v)))
        out[open_[good]] = d[open_[good]] * v[good]
        open_ = open_[~good]
    return np.where(shape < 1, out * stream.next(rows) ** (1 / np.maximum(shape, 1e-300)), out)


def beta(a: np.ndarray, b: np.ndarray, stream: Stream, rows: np.ndarray) -> np.ndarray:
    x, y = gamma(a, stream, rows), gamma(b, stream, rows)
    return x / np.maximum(x + y, 1e-300)


def von_mises(mean: np.ndarray, kappa: np.ndarray, stream: Stream, rows: np.ndarray) -> np.ndarray:
    """Angles in radians by rejection from a wrapped Cauchy distribution, for all rows still open at once."""
    tau = 1 + np.sqrt(1 + 4 * kappa * kappa)
    rho = (tau - np.sqrt(2 * tau)) / (2 * kappa)
    r = (1 + rho * rho) / (2 * rho)
    out = np.empty(len(rows))
    open_ = np.arange(len(rows))
    while len(open_):
        z, u, side = np.cos(np.pi * stream.next(rows[open_])), stream.next(rows[open_]), stream.next(rows[open_])
        f = np.clip((1 + r[open_] * z) / (r[open_] + z), -1, 1)
        c = kappa[open_] * (r[open_] - f)
        with np.errstate(invalid="ignore", divide="ignore"):
            good = (c * (2 - c) > u) | (np.log(c / u) + 1 >= c)
        out[open_[good]] = np.where(side[good] < 0.5, -1, 1) * np.arccos(f[good])
        open_ = open_[~good]
    return mean + out


def truncated_normal(mean: np.ndarray, std: np.ndarray, lo: np.ndarray, hi: np.ndarray, u: np.ndarray, points: int = 2049) -> np.ndarray:
    """Inverse of the distribution between the bounds, from sums of the density over the part that holds its mass."""
    a, b = (lo - mean) / std, (hi - mean) / std
    peak = np.clip(0.0, a, b)
    reach = np.minimum(9.0, 40.0 / np.maximum(np.abs(peak), 1e-9))  # in a tail the density falls by the distance to the mean
    a, b = np.maximum(a, peak - np.where(peak < 0, reach, 9.0)), np.minimum(b, peak + np.where(peak > 0, reach, 9.0))
    x = a[:, None] + (b - a)[:, None] * np.linspace(0, 1, points)
    density = np.exp(-0.5 * (x * x - (peak * peak)[:, None]))
    mass = np.concatenate([np.zeros((len(a), 1)), np.cumsum((density[:, 1:] + density[:, :-1]) / 2, axis=1)], axis=1)
    target = u * mass[:, -1]
    k = np.clip((mass <= target[:, None]).sum(axis=1), 1, points - 1)
    row = np.arange(len(a))
    share = (target - mass[row, k - 1]) / np.maximum(mass[row, k] - mass[row, k - 1], 1e-300)
    return mean + std * (x[row, k - 1] + share * (x[row, k] - x[row, k - 1]))
