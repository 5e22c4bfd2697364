"""Uncertain values: parsing, nominal value, variance, draws."""

from __future__ import annotations

import math
from collections.abc import Callable
from functools import reduce

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, StructField, StructType

from . import draws

SCHEMA = (
    "kind string, value double, mean double, std double, lo double, hi double, probs map<string,double>, dip_mean double, dip_kappa double, azimuth_mean double, azimuth_kappa double, name string, params map<string,double>"
)
NAMES = [x.split()[0] for x in SCHEMA.replace("map<string,double>", "map").split(", ")]
#: The names of distributions.
DISTRIBUTIONS = ("uniform", "triangular", "lognormal", "truncnorm", "beta")
#: Each distribution's parameters with their other names.
PARAMETERS = {
    "uniform": {"lo": ("loc", "lo"), "width": ("scale",), "hi": ("hi",)},
    "triangular": {"lo": ("left", "lo"), "mode": ("mode", "c"), "hi": ("right", "hi")},
    "lognormal": {"sigma": ("sigma", "s"), "mean": ("mean", "loc"), "scale": ("scale",)},
    "truncnorm": {"mean": ("mean", "loc"), "std": ("std", "scale"), "lo": ("lo", "a"), "hi": ("hi", "b")},
    "beta": {"alpha": ("alpha", "a"), "beta": ("beta", "b"), "lo": ("lo",), "hi": ("hi",)},
}


def held(value: Column, use: Callable[[Column], Column]) -> Column:
    """``use`` of a value that is computed once a row, as a lambda's variable; a column put in many places is computed in each, and code as long as that stays uncompiled."""
    return F.get(F.transform(F.array(value), use), F.lit(0))


def parse_uncertainty(text: Column) -> Column:
    """Struct with ``kind`` and ``valid``; null text gives null.

    A stated kind wins, in any case; else the keys present tell it, in the order point,
    gaussian, interval, categorical, orientation, distribution.
    """
    return F.when(text.isNotNull(), held(F.from_json(text, SCHEMA), _described))


def _described(u: Column) -> Column:
    """The fields of a parsed text with their ``kind`` and whether they are ``valid``."""
    has = lambda *names: reduce(lambda a, b: a & b, [u[n].isNotNull() for n in names])
    by_keys = (
        F.when(has("value"), "point").when(has("mean", "std"), "gaussian").when(has("lo", "hi"), "interval").when(has("probs"), "categorical")
        .when(has("dip_mean", "dip_kappa", "azimuth_mean", "azimuth_kappa"), "orientation").when(has("name", "params"), "distribution")
    )
    kind = F.coalesce(F.lower(u["kind"]), by_keys)
    shares = F.map_values(u["probs"])
    total = F.aggregate(shares, F.lit(0.0), lambda a, p: a + p)
    valid = (
        F.when(kind == "point", u["value"].isNotNull()).when(kind == "gaussian", u["mean"].isNotNull() & (u["std"] > 0)).when(kind == "interval", u["lo"] < u["hi"])
        .when(kind == "categorical", (F.size(shares) > 0) & F.forall(shares, lambda p: p > 0) & (F.abs(total - 1) <= 1e-6))
        .when(kind == "orientation", u["dip_mean"].between(0, 90) & (u["dip_kappa"] > 0) & (u["azimuth_mean"] >= 0) & (u["azimuth_mean"] < 360) & (u["azimuth_kappa"] > 0))
        .when(kind == "distribution", u["name"].isin(*DISTRIBUTIONS) & u["params"].isNotNull()).otherwise(False)
    )
    return F.struct(kind.alias("kind"), F.coalesce(valid, F.lit(False)).alias("valid"), *[u[n].alias(n) for n in NAMES[1:]])


def parameters(u: Column, name: str) -> dict[str, Column]:
    """A distribution's parameters by their first name, other names and defaults resolved."""
    given = {k: F.coalesce(*[F.try_element_at(u["params"], F.lit(n)) for n in names]) for k, names in PARAMETERS[name].items()}
    or_ = lambda k, default: F.coalesce(given[k], default if isinstance(default, Column) else F.lit(float(default)))
    if name == "uniform":
        lo = or_("lo", 0)
        return {"lo": lo, "hi": F.coalesce(lo + given["width"], given["hi"], F.lit(1.0))}
    if name == "triangular":
        return {"lo": or_("lo", 0), "mode": or_("mode", 0.5), "hi": or_("hi", 1)}
    if name == "lognormal":
        return {"sigma": or_("sigma", 1), "scale": F.coalesce(given["scale"], F.exp(or_("mean", 0)))}
    if name == "truncnorm":
        mean, std = or_("mean", 0), or_("std", 1)
        return {"mean": mean, "std": std, "lo": or_("lo", mean - 2 * std), "hi": or_("hi", mean + 2 * std)}
    return {"alpha": or_("alpha", 1), "beta": or_("beta", 1), "lo": or_("lo", 0), "hi": or_("hi", 1)}


def by_kind(u: Column, kinds: dict[str, Column], named: dict[str, Column]) -> Column:
    """The expression of a value's kind or, for a distribution, of its name; null for others."""
    out = F.when(F.lit(False), F.lit(None).cast("double"))
    for kind, value in kinds.items():
        out = out.when(u["kind"] == kind, value)
    for name, value in named.items():
        out = out.when((u["kind"] == "distribution") & (u["name"] == name), value)
    return out


def nominal(u: Column) -> Column:
    """The nominal number of a value: means, an interval's middle, a triangle's mode; null for categories and orientations."""
    return held(u, _nominal)


def _nominal(u: Column) -> Column:
    p = {name: parameters(u, name) for name in DISTRIBUTIONS}
    log, b = p["lognormal"], p["beta"]
    return by_kind(
        u,
        {"point": u["value"], "gaussian": u["mean"], "interval": (u["lo"] + u["hi"]) / 2},
        {
            "uniform": (p["uniform"]["lo"] + p["uniform"]["hi"]) / 2, "triangular": p["triangular"]["mode"], "lognormal": log["scale"] * F.exp(log["sigma"] * log["sigma"] / 2), "truncnorm": p["truncnorm"]["mean"],
            "beta": b["lo"] + (b["hi"] - b["lo"]) * b["alpha"] / (b["alpha"] + b["beta"]),
        },
    )


def nominal_category(u: Column) -> Column:
    """The most probable category, the first on ties."""
    best = F.array_max(F.map_values(u["probs"]))
    return F.get(F.filter(F.map_keys(u["probs"]), lambda k: F.element_at(u["probs"], k) == best), F.lit(0))


@F.pandas_udf(DoubleType())
def truncated_variance(mean: pd.Series, std: pd.Series, lo: pd.Series, hi: pd.Series) -> pd.Series:
    """Variance of a normal cut off at both ends."""

    def one(m: float, s: float, a: float, b: float) -> float | None:
        if any(x is None or math.isnan(x) for x in (m, s, a, b)) or s <= 0 or a >= b:
            return None
        a, b = (a - m) / s, (b - m) / s
        density = lambda x: math.exp(-x * x / 2) / math.sqrt(2 * math.pi)
        mass = (math.erf(b / math.sqrt(2)) - math.erf(a / math.sqrt(2))) / 2
        if mass <= 0:
            return 0.0
        shift = (density(a) - density(b)) / mass
        return s * s * (1 + (a * density(a) - b * density(b)) / mass - shift * shift)

    return pd.Series([one(*x) for x in zip(mean, std, lo, hi, strict=True)], dtype=float)


def variance(u: Column) -> Column:
    """Variance; 0 for a point; null for intervals, categories and orientations."""
    ends = held(u, lambda u: F.when((u["kind"] == "distribution") & (u["name"] == "truncnorm"), F.struct(*[x.alias(k) for k, x in parameters(u, "truncnorm").items()])))
    return F.coalesce(held(u, _closed_variance), truncated_variance(*[ends[k] for k in ("mean", "std", "lo", "hi")]))


def _closed_variance(u: Column) -> Column:
    p = {name: parameters(u, name) for name in DISTRIBUTIONS}
    (lo, hi), t, log, b = (p["uniform"][k] for k in ("lo", "hi")), p["triangular"], p["lognormal"], p["beta"]
    square = F.exp(log["sigma"] * log["sigma"])
    a, c, d = t["lo"], t["mode"], t["hi"]
    both = b["alpha"] + b["beta"]
    return by_kind(
        u,
        {"point": F.lit(0.0), "gaussian": u["std"] * u["std"]},
        {
            "uniform": (hi - lo) * (hi - lo) / 12, "triangular": (a * a + c * c + d * d - a * c - a * d - c * d) / 18, "lognormal": (square - 1) * log["scale"] * log["scale"] * square,
            "beta": (b["hi"] - b["lo"]) * (b["hi"] - b["lo"]) * b["alpha"] * b["beta"] / (both * both * (both + 1)),
        },
    )


def interval_as_distribution(lo: Column, hi: Column, name: str, mode: Column | None = None, alpha: float = 1.0, beta: float = 1.0) -> Column:
    """Distribution struct of an interval: uniform, triangular (mode or midpoint) or beta."""
    middle = (lo + hi) / 2
    params = {
        "uniform": {"lo": lo, "hi": hi}, "triangular": {"left": lo, "mode": middle if mode is None else F.coalesce(mode, middle), "right": hi}, "beta": {"lo": lo, "hi": hi, "alpha": F.lit(alpha), "beta": F.lit(beta)}
    }.get(name)
    if params is None:
        raise ValueError(f"no distribution {name} of an interval")
    return F.struct(F.lit("distribution").alias("kind"), F.lit(name).alias("name"), F.create_map(*[x for k, v in params.items() for x in (F.lit(k), v)]).alias("params"))


def sample_number(u: Column, seed: int, *key: Column | str) -> Column:
    """A number drawn of a point, gaussian, interval, uniform, triangular or lognormal value; null for others. Equal seed and key give equal numbers."""
    x, y = draws.uniform(seed, *key, F.lit("0")), draws.uniform(seed, *key, F.lit("1"))
    return held(F.struct(u.alias("u"), x.alias("x"), draws.normal(x, y).alias("z")), lambda h: _drawn(h["u"], h["x"], h["z"]))


def _drawn(u: Column, x: Column, z: Column) -> Column:
    p, t, log = parameters(u, "uniform"), parameters(u, "triangular"), parameters(u, "lognormal")
    lo, mode, hi = t["lo"], t["mode"], t["hi"]
    rise, fall = lo + F.sqrt(x * (hi - lo) * (mode - lo)), hi - F.sqrt((1 - x) * (hi - lo) * (hi - mode))
    return by_kind(
        u,
        {"point": u["value"], "gaussian": u["mean"] + u["std"] * z, "interval": u["lo"] + (u["hi"] - u["lo"]) * x},
        {"uniform": p["lo"] + (p["hi"] - p["lo"]) * x, "triangular": F.when(x * (hi - lo) < mode - lo, rise).otherwise(fall), "lognormal": F.exp(F.log(log["scale"]) + log["sigma"] * z)},
    )


def sample_category(u: Column, seed: int, *key: Column | str) -> Column:
    """A category drawn by its probability: the first whose cumulated weight passes a uniform number; null for other kinds."""
    x = draws.uniform(seed, *key, F.lit("0"))
    start = F.struct(F.lit(0.0).alias("sum"), F.lit(None).cast("string").alias("found"))
    step = lambda a, e: F.struct((a["sum"] + e["value"]).alias("sum"), F.when(a["found"].isNull() & (a["sum"] + e["value"] > x), e["key"]).otherwise(a["found"]).alias("found"))
    found = F.aggregate(F.map_entries(u["probs"]), start, step)
    return F.when(u["kind"] == "categorical", F.coalesce(found["found"], F.try_element_at(F.map_keys(u["probs"]), F.lit(-1))))


@F.pandas_udf(StructType([StructField(name, DoubleType()) for name in ("number", "dip", "azimuth")]))
def _rare(name: pd.Series, p: pd.Series, q: pd.Series, r: pd.Series, s: pd.Series, first: pd.Series) -> pd.DataFrame:
    """Draws whose inverse has no closed form, in arrays over all rows of a batch."""
    out = np.full((len(name), 3), np.nan)
    p, q, r, s = (x.to_numpy(float) for x in (p, q, r, s))
    names, stream = name.to_numpy(object), draws.Stream(first.to_numpy(float))
    at = np.flatnonzero((names == "truncnorm") & (q > 0) & (r < s))
    for k in range(0, len(at), 500):
        rows = at[k : k + 500]
        out[rows, 0] = draws.truncated_normal(p[rows], q[rows], r[rows], s[rows], stream.next(rows))
    at = np.flatnonzero((names == "beta") & (p > 0) & (q > 0))
    out[at, 0] = r[at] + (s[at] - r[at]) * draws.beta(p[at], q[at], stream, at)
    at = np.flatnonzero((names == "orientation") & (q > 0) & (s > 0))
    out[at, 1] = np.clip(np.degrees(draws.von_mises(np.radians(p[at]), q[at], stream, at)), 0, 90)
    out[at, 2] = np.degrees(draws.von_mises(np.radians(r[at]), s[at], stream, at)) % 360
    return pd.DataFrame(out, columns=["number", "dip", "azimuth"])


def _rare_parameters(u: Column) -> Column:
    n, b = parameters(u, "truncnorm"), parameters(u, "beta")
    rare = F.when(u["kind"] == "orientation", "orientation").when((u["kind"] == "distribution") & u["name"].isin("truncnorm", "beta"), u["name"])
    pick = lambda orientation, truncnorm, other: F.when(rare == "orientation", orientation).when(rare == "truncnorm", truncnorm).when(rare == "beta", other)
    return F.struct(
        rare.alias("name"), pick(u["dip_mean"], n["mean"], b["alpha"]).alias("p"), pick(u["dip_kappa"], n["std"], b["beta"]).alias("q"), pick(u["azimuth_mean"], n["lo"], b["lo"]).alias("r"), pick(u["azimuth_kappa"], n["hi"], b["hi"]).alias("s")
    )


def sample(u: Column, seed: int, *key: Column | str) -> Column:
    """One draw of a parsed value: struct ``number, category, dip, azimuth`` with those that its kind has.

    Equal seed and key give equal draws, wherever the row is. Truncated normal, beta and
    orientation values are drawn in arrays by an Arrow helper, all others by expressions.
    """
    rare = held(u, _rare_parameters)
    drawn = _rare(*[rare[k] for k in ("name", *"pqrs")], draws.uniform(seed, *key, F.lit("0")))
    clean = lambda name: F.when(~F.isnan(drawn[name]), drawn[name])
    return F.struct(
        F.coalesce(sample_number(u, seed, *key), clean("number")).alias("number"), sample_category(u, seed, *key).alias("category"), clean("dip").alias("dip"), clean("azimuth").alias("azimuth")
    )


def position_with_std(position: Column) -> Column:
    """Nominal value and standard deviation on each axis of an array of parsed values; an unknown variance counts as 0."""
    return F.transform(position, lambda u: F.struct(F.when(u["kind"] == "gaussian", u["mean"]).when(u["kind"] == "interval", (u["lo"] + u["hi"]) / 2).otherwise(u["value"]).alias("value"), F.coalesce(F.when(u["kind"] == "gaussian", u["std"]), F.lit(0.0)).alias("std")))
