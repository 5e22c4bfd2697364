"""Information and prediction scores of layers.

Long layers are ``layer, voxel_id, value``; wide layers have a row for each voxel with a
column for each layer, and ``iz`` for the depth.
"""

from __future__ import annotations

import math
from itertools import combinations

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.histogram import bin_of, entropy_term

MARGINAL_BINS, JOINT_BINS, RIDGE, FOLDS = 50, 30, 1.0, 5


def present(layers: DataFrame) -> DataFrame:
    """Rows with a value; NaN counts as missing."""
    return layers.where("value is not null and not isnan(value)")


def entropy_continuous(layers: DataFrame, bins: int = MARGINAL_BINS) -> DataFrame:
    """``layer, entropy``: differential entropy from a histogram, at least 0; 0 for a constant or fewer than two values."""
    values = present(layers)
    ranges = values.groupBy("layer").agg(F.min("value").alias("lo"), F.max("value").alias("hi"), F.count("*").alias("n"))
    binned = values.join(F.broadcast(ranges), "layer").groupBy("layer", bin_of(F.col("value"), F.col("lo"), F.col("hi"), bins).alias("bin"))
    counts = binned.agg(F.count("*").alias("c"), F.first("n").alias("n"), (F.first("hi") - F.first("lo")).alias("extent"))
    width = F.col("extent") / bins
    density = F.try_divide(F.col("c"), F.col("n") * width)
    summed = counts.groupBy("layer").agg(F.sum(F.when((F.col("extent") > 0) & (F.col("n") > 1), entropy_term(density) * width).otherwise(0.0)).alias("h"))
    return summed.select("layer", F.greatest(F.col("h"), F.lit(0.0)).alias("entropy"))


def entropy_discrete(layers: DataFrame) -> DataFrame:
    """``layer, entropy``: entropy of the values' shares, at least 0; 0 for fewer than two values."""
    counts = present(layers).groupBy("layer", "value").agg(F.count("*").alias("c"))
    totals = counts.groupBy("layer").agg(F.sum("c").alias("n"))
    shares = counts.join(F.broadcast(totals), "layer")
    summed = shares.groupBy("layer").agg(F.sum(F.when(F.col("n") > 1, entropy_term(F.col("c") / F.col("n"))).otherwise(0.0)).alias("h"))
    return summed.select("layer", F.greatest(F.col("h"), F.lit(0.0)).alias("entropy"))


def layer_entropy(layers: DataFrame, index: DataFrame) -> DataFrame:
    """Entropy of each layer by its ``dtype`` in ``index (layer, dtype)``: categorical and boolean layers are discrete."""
    typed = layers.join(F.broadcast(index.select("layer", "dtype")), "layer")
    discrete = F.col("dtype").isin("categorical", "boolean")
    return entropy_discrete(typed.where(discrete)).unionAll(entropy_continuous(typed.where(~discrete)))


def joint_entropy(wide: DataFrame, pairs: list[tuple[str, str]], bins: int = JOINT_BINS) -> DataFrame:
    """``layer_a, layer_b, entropy`` over rows where both layers have a value, by area-weighted densities.

    All pairs share one pass for the ranges and one for the bins: a row is exploded to its
    pairs, and map-side sums cap what is shuffled at bins * bins rows a pair and task.
    """
    ok = lambda c: F.col(c).isNotNull() & ~F.isnan(F.col(c).cast("double"))
    both = F.array(*[F.when(ok(a) & ok(b), F.struct(F.lit(a).alias("layer_a"), F.lit(b).alias("layer_b"), F.col(a).cast("double").alias("a"), F.col(b).cast("double").alias("b"))) for a, b in pairs])
    rows = wide.select(F.explode(both).alias("p")).where("p is not null").select("p.*")
    key = ["layer_a", "layer_b"]
    ranges = rows.groupBy(*key).agg(*[f(c).alias(f"{n}_{c}") for c in "ab" for n, f in (("lo", F.min), ("hi", F.max))], F.count("*").alias("n"))
    binned = rows.join(F.broadcast(ranges), key).groupBy(*key, *[bin_of(F.col(c), F.col(f"lo_{c}"), F.col(f"hi_{c}"), bins).alias(f"bin_{c}") for c in "ab"])
    counts = binned.agg(F.count("*").alias("c"), F.first("n").alias("n"), ((F.first("hi_a") - F.first("lo_a")) * (F.first("hi_b") - F.first("lo_b"))).alias("extent"))
    area = F.col("extent") / (bins * bins)
    summed = counts.groupBy(*key).agg(F.sum(F.when((F.col("extent") > 0) & (F.col("n") > 1), entropy_term(F.try_divide(F.col("c"), F.col("n") * area)) * area).otherwise(0.0)).alias("h"))
    return summed.select(*key, F.greatest(F.col("h"), F.lit(0.0)).alias("entropy"))


def long_layers(wide: DataFrame, names: list[str]) -> DataFrame:
    """Long rows of wide layers."""
    values = F.array(*[F.struct(F.lit(n).alias("layer"), F.col(n).cast("double").alias("value")) for n in names])
    return wide.select("voxel_id", F.inline(values)).select("layer", "voxel_id", "value")


def mutual_information(wide: DataFrame, pairs: list[tuple[str, str]], dtypes: dict[str, str] | None = None) -> DataFrame:
    """``layer_a, layer_b, mi``, at least 0. Marginals have 50 bins on each layer's own values, the joint 30 by 30."""
    names = sorted({x for p in pairs for x in p})
    dtypes = dtypes or {}
    index = wide.sparkSession.createDataFrame([(n, dtypes.get(n, "float")) for n in names], "layer string, dtype string")
    own = layer_entropy(long_layers(wide, names), index)
    joint = joint_entropy(wide, pairs)
    wanted = wide.sparkSession.createDataFrame(pairs, "layer_a string, layer_b string")
    out = wanted.join(joint.withColumnRenamed("entropy", "h_ab"), ["layer_a", "layer_b"], "left")
    for side in "ab":
        out = out.join(own.select(F.col("layer").alias(f"layer_{side}"), F.col("entropy").alias(f"h_{side}")), f"layer_{side}", "left")
    zero = lambda c: F.coalesce(c, F.lit(0.0))
    return out.select("layer_a", "layer_b", F.greatest(F.lit(0.0), zero("h_a") + zero("h_b") - zero("h_ab")).alias("mi"))


def mdl(wide: DataFrame, names: list[str], n_voxels: int, dtypes: dict[str, str] | None = None) -> float:
    """Description length of a set of layers: their structure, and what they leave unexplained of each other."""
    if not names:
        return 0.0
    index = wide.sparkSession.createDataFrame([(n, (dtypes or {}).get(n, "float")) for n in names], "layer string, dtype string")
    own = layer_entropy(long_layers(wide, names), index).agg(F.sum("entropy")).first()[0] or 0.0
    pairs = list(combinations(names, 2))
    shared = (mutual_information(wide, pairs, dtypes).agg(F.sum("mi")).first()[0] or 0.0) if pairs else 0.0
    n = len(names)
    return n * math.log2(n + 1) + 32 * n + max(0.0, (own - shared) * n_voxels)


def depth_fold(iz: Column, nz: int, k: int = FOLDS) -> Column:
    """Contiguous depth folds; the first ``nz % k`` are one slice longer."""
    k = min(k, nz)
    size, longer = divmod(nz, k)
    edge = longer * (size + 1)
    return F.when(iz < edge, F.floor(iz / (size + 1))).otherwise(longer + F.floor((iz - edge) / size)).cast("int")


def _cross_sums(wide: DataFrame, sets: dict[str, list[str]], nz: int, folds: int) -> dict[str, dict[int, np.ndarray]]:
    """For each set of layers and fold, ``X'X`` with a leading column of ones over rows complete in that set; one pass for all."""
    names = sorted({n for s in sets.values() for n in s})
    aggregates = []
    for key, own in sets.items():
        complete = F.lit(True)
        for n in own:
            complete = complete & F.col(n).isNotNull()
        for i, a in enumerate(["", *own]):
            for j, b in enumerate(["", *own]):
                if i <= j:
                    x = (F.col(a) if a else F.lit(1.0)) * (F.col(b) if b else F.lit(1.0))
                    aggregates.append(F.sum(F.when(complete, x)).alias(f"{key}:{i}:{j}"))
    clean = wide.select("iz", *[F.nanvl(F.col(n).cast("double"), F.lit(None).cast("double")).alias(n) for n in names])
    out: dict[str, dict[int, np.ndarray]] = {key: {} for key in sets}
    for row in clean.groupBy(depth_fold(F.col("iz"), nz, folds).alias("fold")).agg(*aggregates).collect():  # at most `folds` rows
        for key, own in sets.items():
            m = np.zeros((len(own) + 1, len(own) + 1))
            for i in range(len(own) + 1):
                for j in range(i, len(own) + 1):
                    m[i, j] = m[j, i] = row[f"{key}:{i}:{j}"] or 0.0
            out[key][row.fold] = m
    return out


def ridge_cv(wide: DataFrame, sets: dict[str, list[str]], nz: int, alpha: float = RIDGE, folds: int = FOLDS) -> dict[str, dict[str, float]]:
    """Cross-validated MSE of predicting each layer of each set from the set's others.

    Training sums of a fold are all sums less the fold's own, so one pass serves all
    targets and sets; errors come from a second pass with the coefficients as literals.
    A fold counts if it has test rows and more training rows than layers; with none the
    error is infinite. The intercept is penalised like the other coefficients.
    """
    sums = _cross_sums(wide, sets, nz, folds)
    names = sorted({n for s in sets.values() for n in s})
    clean = wide.select(depth_fold(F.col("iz"), nz, folds).alias("fold"), *[F.nanvl(F.col(n).cast("double"), F.lit(None).cast("double")).alias(n) for n in names])
    aggregates, order = [], []
    for key, own in sets.items():
        total = sum(sums[key].values(), np.zeros((len(own) + 1, len(own) + 1)))
        for t, target in enumerate(own, 1):
            predictors = [0, *[k for k in range(1, len(own) + 1) if k != t]]
            guess = None
            for fold, m in sums[key].items():
                train = total - m
                if m[0, 0] < 1 or train[0, 0] < len(own) + 1:
                    continue
                a = train[np.ix_(predictors, predictors)] + alpha * np.eye(len(predictors))
                beta = np.linalg.solve(a, train[predictors, t])
                line = F.lit(float(beta[0]))
                for b, k in zip(beta[1:], predictors[1:], strict=True):
                    line = line + F.lit(float(b)) * F.col(own[k - 1])
                guess = F.when(F.col("fold") == fold, line) if guess is None else guess.when(F.col("fold") == fold, line)
            if guess is None:
                continue
            complete = F.lit(True)
            for n in own:
                complete = complete & F.col(n).isNotNull()
            error = F.col(target) - guess
            aggregates.append(F.avg(F.when(complete, error * error)).alias(f"{key}:{target}"))
            order.append((key, target))
    out: dict[str, dict[str, float]] = {key: dict.fromkeys(own, math.inf) for key, own in sets.items()}
    if aggregates:
        for row in clean.groupBy("fold").agg(*aggregates).collect():
            for key, target in order:
                if row[f"{key}:{target}"] is not None:
                    out[key].setdefault(("all", target), []).append(row[f"{key}:{target}"])
        for key, target in order:
            errors = out[key].pop(("all", target), None)
            if errors:
                out[key][target] = sum(errors) / len(errors)
    return out


def bic(n: int, k: int, mse: float) -> float:
    """Bayesian information criterion of a Gaussian fit; infinite for an error of 0."""
    return n * math.log(mse) + k * math.log(n) if mse > 0 else math.inf


def joint_prediction_score(errors: dict[str, float], n_voxels: int) -> dict[str, float]:
    """Joint score of a set of layers from their errors; infinite errors add 0 but count. Fewer than two layers give zeros."""
    n = len(errors)
    if n < 2:
        return {"total_mse": 0.0, "mean_mse": 0.0, "bic": 0.0}
    total = sum(e for e in errors.values() if math.isfinite(e))
    return {"total_mse": total, "mean_mse": total / n, "bic": bic(n_voxels, n * n, total / n)}


def evaluate_layer(wide: DataFrame, old: list[str], new: str, nz: int, n_voxels: int, dtypes: dict[str, str] | None = None) -> dict:
    """Verdict on a new layer: admitted if it lowers the BIC of joint prediction.

    The first layer is always admitted. With one earlier layer the score before is 0.
    Before and after are scored from the same passes. For an admitted layer also its
    mutual information with each earlier one.
    """
    if not old:
        return {"admitted": True, "bic_before": 0.0, "bic_after": 0.0, "bic_delta": -1.0, "predicted_value": 1.0, "mutual_info": {}}
    errors = ridge_cv(wide, {"before": old, "after": [*old, new]}, nz)
    before, after = joint_prediction_score(errors["before"], n_voxels), joint_prediction_score(errors["after"], n_voxels)
    delta = after["bic"] - before["bic"]
    admitted = delta < 0
    shared = {r.layer_b: r.mi for r in mutual_information(wide, [(new, o) for o in old], dtypes).collect()} if admitted else {}
    return {"admitted": admitted, "bic_before": before["bic"], "bic_after": after["bic"], "bic_delta": delta, "cv_mse_delta": after["mean_mse"] - before["mean_mse"], "predicted_value": -delta, "mutual_info": shared}


def reevaluate_layer(wide: DataFrame, names: list[str], layer: str, nz: int, n_voxels: int) -> dict:
    """Verdict on a stored layer against all others; ``layers`` are those that stay."""
    others = [n for n in names if n != layer]
    verdict = evaluate_layer(wide, others, layer, nz, n_voxels)
    return verdict | {"layers": [*others, layer] if verdict["admitted"] else others}


def marginal_contributions(wide: DataFrame, names: list[str], nz: int, n_voxels: int) -> dict[str, float]:
    """For each layer, BIC without it less BIC with all; all left-out sets share two passes."""
    sets = {"all": names} | {f"no{k}": [n for n in names if n != x] for k, x in enumerate(names)}
    errors = ridge_cv(wide, {k: s for k, s in sets.items() if len(s) > 1}, nz)
    whole = joint_prediction_score(errors.get("all", {}), n_voxels)["bic"]
    return {x: joint_prediction_score(errors.get(f"no{k}", {}), n_voxels)["bic"] - whole for k, x in enumerate(names)}


def layer_digest(layers: DataFrame, index: DataFrame) -> DataFrame:
    """``layer, digest``: 16 hex digits of name, type and values, from digests of chunks of voxels."""
    chunk = F.expr("voxel_id div 4096")
    cells = layers.groupBy("layer", chunk.alias("chunk")).agg(F.sha2(F.to_json(F.array_sort(F.collect_list(F.struct("voxel_id", "value")))), 256).alias("part"))
    whole = cells.groupBy("layer").agg(F.concat_ws(",", F.transform(F.array_sort(F.collect_list(F.struct("chunk", "part"))), lambda x: x["part"])).alias("parts"))
    return whole.join(index.select("layer", "dtype"), "layer").select("layer", F.left(F.sha2(F.concat_ws("|", "layer", "dtype", "parts"), 256), F.lit(16)).alias("digest"))
