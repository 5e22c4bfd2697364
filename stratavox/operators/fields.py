"""Voxel fields of unit probabilities: building blocks, reduction, checks, statistics and comparison.

A field has a row for each voxel: ``voxel_id, ix, iy, iz, most_likely, probs, support,
entropy, in_domain``; arrays follow the order of the unit catalogue.
"""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..grid import Grid
from ..sources.shared import shared_path


def total(values: Column) -> Column:
    return F.aggregate(values, F.lit(0.0), lambda a, x: a + x)


def fit_planes(contacts: DataFrame) -> DataFrame:
    """``pair, n, a, b, c, rms`` of ``z = a x + b y + c`` by least squares; one or two contacts are an error, a flat system gives nulls.

    Sums are of centred coordinates, so the normal equations are two by two.
    """
    means = contacts.groupBy("pair").agg(F.avg("x").alias("mx"), F.avg("y").alias("my"), F.avg("z").alias("mz"), F.count("*").alias("n"))
    d = contacts.join(means, "pair").select("pair", "n", "mx", "my", "mz", (F.col("x") - F.col("mx")).alias("x"), (F.col("y") - F.col("my")).alias("y"), (F.col("z") - F.col("mz")).alias("z"))
    product = lambda p, q: F.sum(F.col(p) * F.col(q)).alias(f"s{p}{q}")
    s = d.groupBy("pair").agg(F.first("n").alias("n"), F.first("mx").alias("mx"), F.first("my").alias("my"), F.first("mz").alias("mz"), *[product(*pq) for pq in ("xx", "xy", "yy", "xz", "yz", "zz")])
    s = s.withColumn("n", F.when(F.col("n") < 3, F.raise_error(F.concat(F.lit("fewer than three contacts for "), F.col("pair").cast("string"))).cast("long")).otherwise(F.col("n")))
    det = F.nullif(F.col("sxx") * F.col("syy") - F.col("sxy") * F.col("sxy"), F.lit(0.0))
    s = s.withColumns({"a": F.when(F.col("n") > 2, (F.col("sxz") * F.col("syy") - F.col("syz") * F.col("sxy")) / det), "b": F.when(F.col("n") > 2, (F.col("syz") * F.col("sxx") - F.col("sxz") * F.col("sxy")) / det)})
    rest = F.col("szz") - F.col("a") * F.col("sxz") - F.col("b") * F.col("syz")
    return s.select("pair", "n", "a", "b", (F.col("mz") - F.col("a") * F.col("mx") - F.col("b") * F.col("my")).alias("c"), F.sqrt(F.greatest(rest, F.lit(0.0)) / F.col("n")).alias("rms"))


def layer_distance(planes: list[tuple[float, float, float, int]], grid: Grid, free: float) -> Column:
    """Least signed distance of a cell to a unit's planes (``a, b, c, sign``); ``free`` times the diagonal without planes."""
    x, y, z = F.col("x"), F.col("y"), F.col("z")
    parts = [F.lit(float(sign)) * (z - (a * x + b * y + c)) / float((a * a + b * b + 1) ** 0.5) for a, b, c, sign in planes]
    if not parts:
        return F.lit(free * grid.diagonal)
    return F.least(*parts) if len(parts) > 1 else parts[0]


def membership(distance: Column, bandwidth: float) -> Column:
    """Logistic function of distance over bandwidth, clipped at 60."""
    return 1 / (1 + F.exp(-F.greatest(F.lit(-60.0), F.least(F.lit(60.0), distance / bandwidth))))


def compose(support: dict[str, Column], order: list[list[str]], modes: dict[str, str]) -> dict[str, Column]:
    """Exclusive support from ``order`` (units of equal rank together, top first).

    An eroding unit takes its share from all below; units of equal rank share the union
    of their supports in proportion; soft units leave others as they are.
    """
    out, left = {}, F.lit(1.0)
    for rank in order:
        own = [u for u in rank if u in support]
        outside = F.lit(1.0)
        for u in own:
            outside = outside * (1 - support[u])
        summed = sum((support[u] for u in own), F.lit(0.0))
        for u in own:
            share = support[u] if len(own) == 1 else (1 - outside) * F.coalesce(F.try_divide(support[u], F.nullif(summed, F.lit(0.0))), F.lit(0.0))
            out[u] = left * share
        eroding = [u for u in own if modes.get(u, "erode") == "erode"]
        for u in eroding:
            left = left * (1 - support[u])
    return out


def normalise(exclusive: Column, support: Column, least: float) -> tuple[Column, Column]:
    """Probabilities (what is left of 1 is background) and the most likely unit: first on ties, -1 where support is weak."""
    whole = total(exclusive) + F.greatest(F.lit(0.0), 1 - total(exclusive))
    probs = F.transform(exclusive, lambda x: F.coalesce(F.try_divide(x, F.nullif(whole, F.lit(0.0))), F.lit(0.0)))
    return probs, F.when(F.array_max(support) < least, F.lit(-1)).otherwise(F.array_position(probs, F.array_max(probs)).cast("int") - 1)


def normalised_entropy(probs: Column, inside: Column) -> Column:
    """Entropy in units of log2(k); 0 for at most one unit and outside the domain."""
    h = F.aggregate(probs, F.lit(0.0), lambda a, p: a - F.when(p > 0, p * F.log2(p)).otherwise(0.0))
    return F.when(inside & (F.size(probs) > 1), h / F.log2(F.size(probs).cast("double"))).otherwise(0.0)


def integrate_subcells(samples: DataFrame) -> DataFrame:
    """Weighted sums of ``unit, membership, weight, weak`` by cell and unit; a cell is weak if all its samples are."""
    return samples.groupBy("voxel_id", "unit").agg(F.sum(F.col("membership") * F.col("weight")).alias("membership"), F.bool_and("weak").alias("weak"))


def voxel_count_drop(field: DataFrame, prior: DataFrame, threshold: float) -> DataFrame:
    """Units of both fields that lost more than a share of their voxels."""
    count = lambda df, name: df.where("most_likely >= 0").groupBy("most_likely").agg(F.count("*").alias(name))
    both = count(prior, "before").join(count(field, "after"), "most_likely")
    return both.withColumn("drop", (F.col("before") - F.col("after")) / F.col("before")).where(F.col("drop") > threshold)


def reduce_ensemble(fields: DataFrame, n: int, units: int, least: float) -> DataFrame:
    """One field from realisations ``(realisation, voxel_id, probs, in_domain)``: means over all, units absent count 0.

    Sums by unit are columns of one aggregate, so partial sums meet before the shuffle and
    nothing is exploded.
    """
    sums = fields.groupBy("voxel_id").agg(F.bool_or("in_domain").alias("in_domain"), *[F.sum(F.coalesce(F.get("probs", F.lit(k)), F.lit(0.0))).alias(f"u{k}") for k in range(units)])
    probs = F.array(*[F.col(f"u{k}") / n for k in range(units)])
    out = sums.select("voxel_id", "in_domain", probs.alias("probs"))
    best = F.when(~F.col("in_domain") | (F.array_max("probs") < least), F.lit(-1)).otherwise(F.array_position("probs", F.array_max("probs")).cast("int") - 1)
    return out.withColumns({"most_likely": best, "entropy": normalised_entropy(F.col("probs"), F.col("in_domain"))})


def check_column_order(field: DataFrame, ranks: DataFrame) -> DataFrame:
    """``ix, iy, breaks``: columns with a unit that ranks above the unit on top of it (``ranks (unit, rank)``, 0 on top), and how many; unknown units are skipped."""
    ranked = field.where("most_likely >= 0").join(ranks.select(F.col("unit").alias("most_likely"), "rank"), "most_likely")
    above = F.lag("rank").over(Window.partitionBy("ix", "iy").orderBy(F.desc("iz")))
    return ranked.withColumn("above", above).where("rank < above").groupBy("ix", "iy").agg(F.count("*").alias("breaks"))


def check_bulk_volume(field: DataFrame, bounds: DataFrame, cell_volume: float) -> DataFrame:
    """Units whose volume is outside ``lo, hi``, with their first cell."""
    volumes = field.groupBy(F.col("most_likely").alias("unit")).agg((F.count("*") * cell_volume).alias("volume"), F.min("voxel_id").alias("first_voxel"))
    out = bounds.join(volumes, "unit", "left").withColumn("volume", F.coalesce("volume", F.lit(0.0)))
    return out.where((F.col("volume") < F.col("lo")) | (F.col("volume") > F.col("hi")))


def check_domain_closure(field: DataFrame, most: int = 100) -> DataFrame:
    """One row: ``open_cells`` in the domain without unit, and the first of them (a report of at most ``most``)."""
    holes = field.where("in_domain and most_likely < 0")
    first = holes.orderBy("voxel_id").limit(most).agg(F.array_sort(F.collect_list("voxel_id")).alias("first_voxels"))
    return holes.agg(F.count("*").alias("open_cells")).crossJoin(F.broadcast(first))


def check_existence(field: DataFrame, units: DataFrame, tolerance: float = 0.05) -> DataFrame:
    """Doubtful units (``p_exists`` below a half) that fill more of the domain than their probability allows."""
    inside = field.where("in_domain")
    cells = F.broadcast(inside.agg(F.count("*").alias("cells")))
    shares = inside.groupBy(F.col("most_likely").alias("unit")).agg(F.count("*").alias("n")).crossJoin(cells).select("unit", (F.col("n") / F.col("cells")).alias("share"))
    return units.where("p_exists < 0.5").join(shares, "unit").where(F.col("share") > F.col("p_exists") + tolerance)


def check_orphan_blobs(field: DataFrame, grid: Grid, rounds: int = 200) -> DataFrame:
    """``unit, blobs`` of units in more than one face-connected piece.

    Cells of one unit on top of each other are one run; runs, not cells, are joined:
    neighbouring columns' runs of a unit that overlap in height touch. The least run of
    each component spreads by joins, halving paths, until nothing changes; each round is
    written to the shared folder. More than ``rounds`` rounds are an error.
    """
    column = Window.partitionBy("ix", "iy", "most_likely").orderBy("iz")
    cells = field.where("most_likely >= 0").select("ix", "iy", "iz", "most_likely")
    island = cells.withColumn("island", F.col("iz") - F.row_number().over(column))
    runs = island.groupBy("ix", "iy", "most_likely", "island").agg(F.min("iz").alias("lo"), F.max("iz").alias("hi"))
    runs = runs.select("most_likely", "ix", "iy", "lo", "hi", grid.voxel_id(F.col("ix"), F.col("iy"), F.col("lo")).alias("run")).cache()
    other = runs.select("most_likely", F.col("lo").alias("lo2"), F.col("hi").alias("hi2"), F.col("run").alias("run2"), F.explode(F.array(F.struct((F.col("ix") - 1).alias("ix"), "iy"), F.struct("ix", (F.col("iy") - 1).alias("iy")))).alias("n")).select("most_likely", "lo2", "hi2", "run2", "n.ix", "n.iy")
    touching = runs.join(other, ["most_likely", "ix", "iy"]).where("lo <= hi2 and lo2 <= hi").select("run", "run2")
    links = touching.unionAll(touching.select(F.col("run2").alias("run"), F.col("run").alias("run2"))).cache()
    label = runs.select("run", F.col("run").alias("root"))
    before = None
    for _ in range(rounds):
        near = links.join(label.withColumnRenamed("run", "run2"), "run2").groupBy("run").agg(F.min("root").alias("near"))
        step = label.join(near, "run", "left").select("run", F.least("root", F.coalesce("near", "root")).alias("root"))
        jump = step.select(F.col("run").alias("root"), F.col("root").alias("next"))
        label = step.join(jump, "root").select("run", F.col("next").alias("root"))
        path = shared_path(label.sparkSession, f"blobs-{uuid.uuid4().hex}")
        label.write.parquet(path)
        label = label.sparkSession.read.schema(label.schema).parquet(path)
        now = label.agg(F.sum(F.col("root").cast("decimal(38,0)"))).first()[0]
        if now == before:
            break
        before = now
    else:
        raise RuntimeError(f"pieces not settled after {rounds} rounds")
    return runs.join(label, "run").groupBy(F.col("most_likely").alias("unit")).agg(F.count_distinct("root").alias("blobs")).where("blobs > 1")


def field_stats(field: DataFrame) -> DataFrame:
    """``unit, mean_prob`` inside the domain, rescaled to 1, with mean entropy and the domain's share."""
    whole = F.broadcast(field.agg(F.avg(F.when(F.col("in_domain"), F.col("entropy"))).alias("mean_entropy"), F.avg(F.col("in_domain").cast("double")).alias("domain_share")))
    means = field.where("in_domain").select(F.posexplode("probs").alias("unit", "p")).groupBy("unit").agg(F.avg("p").alias("m"))
    scale = F.broadcast(means.agg(F.nullif(F.sum("m"), F.lit(0.0)).alias("t")))
    return means.crossJoin(scale).select("unit", F.coalesce(F.col("m") / F.col("t"), F.lit(0.0)).alias("mean_prob")).crossJoin(whole)


def coverage(reference: DataFrame, candidate: DataFrame) -> DataFrame:
    """One row: share of the reference's domain that the candidate covers; 1 for an empty reference."""
    both = reference.where("in_domain").select("voxel_id").join(candidate.select("voxel_id", F.col("in_domain").alias("c")), "voxel_id", "left")
    return both.agg(F.coalesce(F.try_divide(F.count_if("c").cast("double"), F.count("*")), F.lit(1.0)).alias("coverage"))


def align_fields(reference: DataFrame, candidate: DataFrame, units_a: list[str], units_b: list[str]) -> DataFrame:
    """``voxel_id, p, q, shared``: both fields' probabilities over the union of units, rescaled; shared where both have some."""
    union = [*units_a, *[u for u in units_b if u not in units_a]]

    def over(units: list[str]) -> Column:
        place = {u: k for k, u in enumerate(units)}
        values = F.array(*[F.coalesce(F.get("probs", F.lit(place[u])), F.lit(0.0)) if u in place else F.lit(0.0) for u in union])
        return values

    a = reference.select("voxel_id", F.col("in_domain").alias("in_a"), over(units_a).alias("p"))
    b = candidate.select("voxel_id", F.col("in_domain").alias("in_b"), over(units_b).alias("q"))
    scaled = lambda c: F.transform(c, lambda x: F.coalesce(x / F.nullif(total(F.col(c)), F.lit(0.0)), F.lit(0.0)))
    joined = a.join(b, "voxel_id")
    return joined.select("voxel_id", "in_a", (F.col("in_a") & F.col("in_b") & (total(F.col("p")) > 0) & (total(F.col("q")) > 0)).alias("shared"), scaled("p").alias("p"), scaled("q").alias("q"))


def divergence(aligned: DataFrame, epsilon: float = 0.01, sample_size: float = 1.0, weighted: bool = True, by: list[str] | None = None) -> DataFrame:
    """One row (with ``by``, one for each key): mean smoothed divergence in bits of q from p over the shared cells, times the sample size.

    Weighted (the forward form): each cell counts by what its smoothed reference leaves certain, and
    is capped at log2(1 / epsilon). Without shared cells infinite if the reference has any, else 0.
    """
    k = F.size("p")
    smooth = lambda c: F.transform(c, lambda x: (1 - epsilon) * x + epsilon / k)
    bits = F.aggregate(F.zip_with(smooth("p"), smooth("q"), lambda a, b: a * F.log2(a / b)), F.lit(0.0), lambda s, x: s + x)
    if weighted:
        bits = F.least(bits * (1 - normalised_entropy(smooth("p"), F.lit(True))), F.log2(F.lit(1 / epsilon)))
    sums = aligned.groupBy(*(by or [])).agg(F.avg(F.when(F.col("shared"), bits)).alias("m"), F.coalesce(F.bool_or("in_a"), F.lit(False)).alias("some"))
    return sums.select(*(by or []), F.when(F.col("m").isNotNull(), F.col("m") * sample_size).when(F.col("some"), F.lit(float("inf"))).otherwise(0.0).alias("loss"))


def annealed_thresholds(candidates: DataFrame, initial: float, steady: float, window: int, least_pool: int, warm_up: int) -> DataFrame:
    """Adds ``threshold`` and ``admitted`` from the counters that each candidate met: ``pool_size, episode_count, admission_count``.

    Infinite until pool and warm-up are full, then linear in the admissions from initial to
    steady; without a window steady at once. Null counters count as 0.
    """
    count = lambda c: F.coalesce(c, F.lit(0))
    line = F.lit(steady) if window <= 0 else F.lit(initial) + (F.lit(steady) - F.lit(initial)) * F.least(F.lit(1.0), count("admission_count") / window)
    open_ = (count("pool_size") < least_pool) | (count("episode_count") < warm_up)
    out = candidates.withColumn("threshold", F.when(open_, F.lit(float("inf"))).otherwise(line))
    return out.withColumn("admitted", F.col("score") <= F.col("threshold"))


def retain_reservoir(pool: DataFrame, capacity: int, seed: int) -> DataFrame:
    """Locked rows and a uniform random choice of the others, ``capacity`` in all for each pool."""
    order = Window.partitionBy("pool_id").orderBy(F.desc("locked"), F.xxhash64(F.lit(seed), "candidate_id"), "candidate_id")
    return pool.withColumn("rank", F.row_number().over(order)).where((F.col("rank") <= capacity) | F.col("locked")).drop("rank")


def pool_append(pool: DataFrame, new: DataFrame, capacity: int) -> DataFrame:
    """Pool with the new rows whose content is unknown; the newest ``capacity`` of each pool stay."""
    fresh = new.join(pool.select("pool_id", "content_hash"), ["pool_id", "content_hash"], "left_anti").dropDuplicates(["pool_id", "content_hash"])
    order = Window.partitionBy("pool_id").orderBy(F.desc("seq"))
    return pool.unionByName(fresh).withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= capacity).drop("rank")
