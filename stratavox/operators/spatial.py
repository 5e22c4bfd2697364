"""Points and lines to voxels, painting, and look-ups on a grid."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StructField, StructType

from ..grid import Grid

METRES_PER_DEGREE = 111_320.0
RULES = ("replace", "max", "add", "mean")


def coord_to_voxel(df: DataFrame, grid: Grid, x: str = "lon", y: str = "lat", z: str = "depth_m") -> DataFrame:
    """Adds ``in_range, ix, iy, iz, voxel_id``; out of range (or null) the indices are null."""
    inside = grid.inside(F.col(x), F.col(y), F.col(z))
    cells = {f"i{n}": F.when(inside, grid.index(axis, F.col(c))) for axis, (n, c) in enumerate(zip("xyz", (x, y, z), strict=True))}
    df = df.withColumns({"in_range": inside, **cells})
    return df.withColumn("voxel_id", grid.voxel_id(F.col("ix"), F.col("iy"), F.col("iz")))


def voxel_to_coord(df: DataFrame, grid: Grid) -> DataFrame:
    """Adds the cell's centre as ``lon, lat, depth_m``."""
    return df.withColumns({name: grid.centre(axis, F.col(i)) for axis, (name, i) in enumerate((("lon", "ix"), ("lat", "iy"), ("depth_m", "iz")))})


def metres_to_degrees(metres: Column, latitude: Column) -> tuple[Column, Column]:
    """Degrees of longitude and of latitude for a distance at a latitude."""
    return metres / (METRES_PER_DEGREE * F.cos(F.radians(latitude))), metres / METRES_PER_DEGREE


def _spheres(df: DataFrame, grid: Grid, keep: list[str]) -> DataFrame:
    """Voxels whose centre lies within ``radius_m`` of ``lon, lat, depth_m`` (all in range)."""
    lon_r, lat_r = metres_to_degrees(F.col("radius_m"), F.col("lat"))
    centred = coord_to_voxel(df, grid).where("in_range")
    for axis, (name, radius) in enumerate((("x", lon_r), ("y", lat_r), ("z", F.col("radius_m")))):
        reach = (F.floor(radius / (grid.maximum[axis] - grid.origin[axis]) * grid.shape[axis]) + 1).cast("int")
        low, high = F.greatest(F.lit(0), F.col(f"i{name}") - reach), F.least(F.lit(grid.shape[axis] - 1), F.col(f"i{name}") + reach)
        centred = centred.withColumn(f"box_{name}", F.sequence(low, high))
    boxes = centred.select(*keep, "lon", "lat", "depth_m", "radius_m", "box_y", "box_z", F.explode("box_x").alias("ix"))
    boxes = boxes.select("*", F.explode("box_y").alias("iy")).drop("box_y").select("*", F.explode("box_z").alias("iz")).drop("box_z")
    east = (grid.centre(0, F.col("ix")) - F.col("lon")) * METRES_PER_DEGREE * F.cos(F.radians("lat"))
    north = (grid.centre(1, F.col("iy")) - F.col("lat")) * METRES_PER_DEGREE
    down = grid.centre(2, F.col("iz")) - F.col("depth_m")
    near = boxes.where(F.sqrt(east * east + north * north + down * down) <= F.col("radius_m"))
    return near.select(*keep, grid.voxel_id(F.col("ix"), F.col("iy"), F.col("iz")).alias("voxel_id"), "ix", "iy", "iz")


def rasterize_spheres(points: DataFrame, grid: Grid) -> DataFrame:
    """``points`` columns with a row for each voxel of each point's sphere; points out of range give none.

    The box of candidate cells is exploded row by row, so one point costs its own box and
    nothing is shuffled. Partitions that hold large boxes are dealt out by the caller's
    ``repartition`` where radii differ much.
    """
    keep = [c for c in points.columns if c not in ("lon", "lat", "depth_m", "radius_m")]
    return _spheres(points, grid, keep)


def _spread(low: np.ndarray, high: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """``of, at``: for each place its numbers from low to high."""
    n = np.maximum(high - low + 1, 0)
    of = np.repeat(np.arange(len(n)), n)
    return of, np.arange(len(of)) - (np.cumsum(n) - n)[of] + low[of]


def _parts(sizes: np.ndarray, held: int) -> Iterator[slice]:
    """Places in a row whose sizes add up to about ``held`` at most."""
    cuts = np.flatnonzero(np.diff(np.cumsum(sizes) // held)) + 1
    yield from map(slice, [0, *cuts], [*cuts, len(sizes)])


def _cos2(lat: tuple[np.ndarray, np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """Least and greatest squared cosine of the latitudes between two."""
    a, b = np.abs(lat[0]), np.abs(lat[1])
    far, near = np.maximum(a, b), np.where(lat[0] * lat[1] <= 0, 0.0, np.minimum(a, b))
    known = far < 90
    return np.where(known, np.cos(np.radians(far)) ** 2, 0.0), np.where(known, np.cos(np.radians(near)) ** 2, 1.0)


def line_voxels(start: np.ndarray, end: np.ndarray, radius: np.ndarray, samples: np.ndarray, grid: Grid, held: int = 500_000) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """``line, voxel`` of each voxel with a sample of the line within the radius, in parts; the result is that of all samples.

    ``start`` and ``end`` are rows of ``lon, lat, depth_m``. The samples that a voxel may have are narrowed axis by axis. Of these the
    nearest is known from the least of a parabola, once for the least and once for the greatest cosine of their
    latitudes; only where the two disagree, or rounding might decide, a voxel's samples are measured one by one.
    """
    unit = np.array([METRES_PER_DEGREE, METRES_PER_DEGREE, 1.0])
    step, last = end - start, samples - 1
    slack = [1e-9 * (1 + abs(a) + abs(b)) for a, b in zip(grid.origin, grid.maximum, strict=True)]
    centres = [grid.origin[axis] + (np.arange(grid.shape[axis]) + 0.5) * grid.cell[axis] for axis in range(3)]
    reach_m = radius * (1 + 1e-9)

    def bounds(axis: int, line: np.ndarray, share: tuple, reach: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Cells whose centre is within reach of the line between two shares of it."""
        p, q = (start[line, axis] + s * step[line, axis] for s in share)
        place = lambda x: (x - grid.origin[axis]) / grid.cell[axis] - 0.5
        top = grid.shape[axis] - 1
        return np.clip(np.ceil(place(np.minimum(p, q) - reach)), 0, top + 1).astype(np.int64), np.clip(np.floor(place(np.maximum(p, q) + reach)), -1, top).astype(np.int64)

    def narrowed(axis: int, line: np.ndarray, share: tuple, reach: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Shares of the line between which a cell's centre is within reach."""
        off, along = centres[axis][at] - start[line, axis], step[line, axis]
        with np.errstate(divide="ignore", invalid="ignore"):
            a, b = (off - reach) / along, (off + reach) / along
        level = along == 0
        return np.maximum(share[0], np.where(level, -np.inf, np.minimum(a, b))), np.minimum(share[1], np.where(level, np.inf, np.maximum(a, b)))

    def spread(axis: int, line: np.ndarray, share: tuple, reach: np.ndarray, *more: np.ndarray) -> tuple:
        of, at = _spread(*bounds(axis, line, share, reach))
        share = narrowed(axis, line[of], (share[0][of], share[1][of]), reach[of], at)
        met = share[0] <= share[1]
        return line[of][met], (share[0][met], share[1][met]), [x[of][met] for x in more] + [at[met]]

    every = np.arange(len(samples))
    line, share, (iy,) = spread(1, every, (np.zeros(len(every)), np.ones(len(every))), reach_m / METRES_PER_DEGREE + slack[1])
    with np.errstate(divide="ignore"):
        east = reach_m[line] / (METRES_PER_DEGREE * np.sqrt(_cos2(tuple(start[line, 1] + s * step[line, 1] for s in share))[0])) + slack[0]
    low, high = bounds(0, line, share, east)
    for part in _parts(np.maximum(high - low + 1, 0) * grid.shape[2], held):
        of, between, (y, x) = spread(0, line[part], (share[0][part], share[1][part]), east[part], iy[part])
        of, between, (y, x, z) = spread(2, of, between, reach_m[of] + slack[2], y, x)
        r, n, v = radius[of], last[of], step[of] * unit
        centre = np.stack([centres[0][x], centres[1][y], centres[2][z]], axis=1)
        d = (centre - start[of]) * unit
        first, final = np.clip(np.floor(between[0] * n) - 1, 0, n), np.clip(np.ceil(between[1] * n) + 1, 0, n)
        squares = _cos2((start[of, 1] + first / n * step[of, 1], start[of, 1] + final / n * step[of, 1]))

        def away(share: np.ndarray, w: np.ndarray, d: np.ndarray = d, v: np.ndarray = v) -> np.ndarray:
            rest = d - share[:, None] * v
            return w * rest[:, 0] ** 2 + rest[:, 1] ** 2 + rest[:, 2] ** 2

        def nearest(w: np.ndarray, d: np.ndarray = d, v: np.ndarray = v) -> tuple[np.ndarray, np.ndarray]:
            """The share at which the line is nearest, and its square there over that of the share."""
            weights = np.stack([w, np.ones(len(w)), np.ones(len(w))], axis=1)
            square = (weights * v * v).sum(axis=1)
            return (weights * d * v).sum(axis=1) / np.where(square > 0, square, 1.0), square

        def least(w: np.ndarray) -> np.ndarray:
            k = np.floor(np.clip(nearest(w)[0] * n, first, final))
            return np.minimum(away(k / n, w), away(np.minimum(k + 1, final) / n, w))

        unsure = 1e-6 + 1e-9 * r
        found = (r >= unsure) & (least(squares[1]) <= (r - unsure) ** 2)
        open_ = np.flatnonzero(~found & (least(squares[0]) <= (r + unsure) ** 2))
        w, around = squares[0][open_], (r + unsure)[open_] ** 2
        at_best, square = nearest(w, d[open_], v[open_])
        with np.errstate(divide="ignore", invalid="ignore"):
            half = np.sqrt(np.maximum(around - away(at_best, w, d[open_], v[open_]), 0.0) / square)
        short = ~(final[open_] - first[open_] > 16) | ~np.isfinite(half)
        low_k = np.where(short, first[open_], np.clip(np.floor((at_best - half) * n[open_]) - 1, first[open_], final[open_])).astype(np.int64)
        high_k = np.where(short, final[open_], np.clip(np.ceil((at_best + half) * n[open_]) + 1, first[open_], final[open_])).astype(np.int64)
        for some in _parts(high_k - low_k + 1, held):
            cell, k = _spread(low_k[some], high_k[some])
            cell = open_[some][cell]
            at = start[of[cell]] + (k / n[cell])[:, None] * step[of[cell]]
            rest = (centre[cell] - at) * unit
            rest[:, 0] *= np.cos(np.radians(at[:, 1]))
            found[cell[np.sqrt((rest * rest).sum(axis=1)) <= r[cell]]] = True
        yield of[found], (x[found] * grid.shape[1] + y[found]) * grid.shape[2] + z[found]


def rasterize_lines(lines: DataFrame, grid: Grid) -> DataFrame:
    """A row for each voxel of each line, once; a line with a sample out of range gives none.

    A line has ``max(10, floor(1000 * norm))`` samples with a sphere of half its width. The norm adds degrees and
    metres, so a line that falls by 80 m has 80,000 samples; they are not made one by one.
    """
    ends = [("lon0", "lon1"), ("lat0", "lat1"), ("depth0", "depth1")]
    length = F.sqrt(sum(((F.col(b) - F.col(a)) * (F.col(b) - F.col(a)) for a, b in ends), F.lit(0.0)))
    n = F.greatest(F.lit(10), F.floor(length * 1000)).cast("long")
    keep = [c for c in lines.columns if c not in ("lon0", "lat0", "depth0", "lon1", "lat1", "depth1", "width_m")]
    # The line is straight: all samples are in range if the first and the last are.
    whole = grid.inside(*[F.col(a) for a, _ in ends]) & grid.inside(*[F.col(a) + (F.col(b) - F.col(a)) for a, b in ends]) & (F.col("width_m") >= 0) & ~F.isnan(F.col("width_m").cast("double"))
    # A short row stands for up to thousands of voxels: lines are dealt out before that, and voxels known by one number.
    dealt = lines.where(whole).repartition(int(lines.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    places = [c for pair in zip(*ends, strict=True) for c in pair]
    sized = dealt.select(*keep, F.array(*[F.col(c).cast("double") for c in places], F.col("width_m").cast("double") / 2, n.cast("double")).alias("line"))
    schema = StructType([*lines.select(*keep).schema.fields, StructField("voxel_id", LongType())])

    def go(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for k in range(0, batch.num_rows, 1000):
                rows = batch.slice(k, 1000)
                numbers = rows.column(len(keep)).flatten().to_numpy(zero_copy_only=False).reshape(-1, 8)
                for line, voxel in line_voxels(numbers[:, :3], numbers[:, 3:6], numbers[:, 6], numbers[:, 7], grid):
                    yield pa.RecordBatch.from_arrays([*[rows.column(c).take(pa.array(line)) for c in range(len(keep))], pa.array(voxel)], [*keep, "voxel_id"])

    voxels = sized.mapInArrow(go, schema).distinct()
    _, ny, nz = grid.shape
    return voxels.select("*", F.expr(f"int(voxel_id div {ny * nz})").alias("ix"), F.expr(f"int((voxel_id div {nz}) % {ny})").alias("iy"), F.expr(f"int(voxel_id % {nz})").alias("iz"))


def paint_layer(ops: DataFrame, rule: str, base: DataFrame | None = None) -> DataFrame:
    """``layer, voxel_id, value`` after painting ``layer, voxel_id, seq, value`` in order of ``seq`` under one rule.

    Painting starts from the base's value or 0. One rule has a closed form for any number
    of operations on a voxel, so hot voxels need no list: replace is the last value, max
    and add are aggregates, and each step of mean halves what was there before.
    """
    if rule not in RULES:
        raise ValueError(f"unknown rule {rule}")
    key = ["layer", "voxel_id"]
    start = F.coalesce("base", F.lit(0.0)) if base is not None else F.lit(0.0)
    if rule == "mean":
        # The k-th of n values weighs 2 ** -(n - k + 1); values too far back vanish in double precision.
        order = Window.partitionBy(*key).orderBy(F.desc("seq"), F.desc("value"))
        weighed = ops.withColumn("back", F.row_number().over(order)).withColumn("part", F.col("value") * F.pow(F.lit(0.5), F.col("back")))
        grouped = weighed.groupBy(*key).agg(F.sum("part").alias("painted"), F.count("*").alias("n"))
        value = start * F.pow(F.lit(0.5), F.col("n")) + F.col("painted")
    elif rule == "replace":
        grouped = ops.groupBy(*key).agg(F.max_by("value", F.struct("seq", "value")).alias("painted"))
        value = F.col("painted")
    elif rule == "max":
        grouped = ops.groupBy(*key).agg(F.max("value").alias("painted"))
        value = F.greatest(start, F.col("painted"))
    else:
        grouped = ops.groupBy(*key).agg(F.sum("value").alias("painted"))
        value = start + F.col("painted")
    if base is None:
        return grouped.select(*key, value.alias("value"))
    joined = base.select(*key, F.col("value").alias("base")).join(grouped, key, "full_outer")
    return joined.select(*key, F.when(F.col("painted").isNull(), F.col("base")).otherwise(value).alias("value"))


def paint_mixed(ops: DataFrame, base: DataFrame | None = None) -> DataFrame:
    """Painting where ``rule`` differs from operation to operation: a fold over each voxel's operations in order."""
    key = ["layer", "voxel_id"]
    grouped = ops.groupBy(*key).agg(F.array_sort(F.collect_list(F.struct("seq", "rule", "value"))).alias("ops"))
    if base is not None:
        grouped = grouped.join(base.select(*key, F.col("value").alias("base")), key, "full_outer")
    else:
        grouped = grouped.withColumn("base", F.lit(None).cast("double"))
    fold = (
        "aggregate(coalesce(ops, array()), coalesce(base, 0D), (a, o) -> case o.rule when 'replace' then o.value when 'max' then greatest(a, o.value) "
        "when 'add' then a + o.value when 'mean' then (a + o.value) / 2 else a end)"
    )
    return grouped.select(*key, F.expr(fold).alias("value"))


def query_region(layers: DataFrame, grid: Grid, lon: float, lat: float, depth_m: float, radius_m: float, most: int = 50) -> DataFrame:
    """``layer, voxel_id, ix, iy, iz, value, total_voxels``: non-zero values in the first ``most`` voxels of a sphere, in index order."""
    spark = layers.sparkSession
    centre = spark.createDataFrame([(lon, lat, depth_m, radius_m)], "lon double, lat double, depth_m double, radius_m double")
    ball = rasterize_spheres(centre, grid)
    total = ball.agg(F.count("*").alias("total_voxels"))
    first = F.broadcast(ball.orderBy("ix", "iy", "iz").limit(most).crossJoin(F.broadcast(total)))
    return layers.select("layer", "voxel_id", "value").join(first, "voxel_id").where("value <> 0").select("layer", "voxel_id", "ix", "iy", "iz", "value", "total_voxels")


def operation_log(ops: DataFrame, most: int | None = None) -> DataFrame:
    """Operations, newest first; with ``most``, only so many."""
    ordered = ops.orderBy(F.desc("ts"), F.desc("op_id"))
    return ordered.limit(most) if most else ordered


def subcell_samples(cells: DataFrame, grid: Grid, k: int) -> DataFrame:
    """Gauss-Legendre points of each cell: ``voxel_id, sample, sx, sy, sz, weight``; weights of a cell add up to 1."""
    nodes, weights = np.polynomial.legendre.leggauss(k)
    made = []
    for a in range(k):
        for b in range(k):
            for c in range(k):
                made.append((len(made), *(float(nodes[i]) * grid.cell[axis] / 2 for axis, i in enumerate((a, b, c))), float(weights[a] * weights[b] * weights[c] / 8)))
    samples = cells.sparkSession.createDataFrame(made, "sample int, dx double, dy double, dz double, weight double")
    # k ** 3 rows, whatever the grid.
    return cells.crossJoin(F.broadcast(samples)).select("voxel_id", "sample", *[(F.col(c) + F.col(f"d{c}")).alias(f"s{c}") for c in "xyz"], "weight")


def sample_field(field: DataFrame, points: DataFrame, grid: Grid) -> DataFrame:
    """Field values at points ``point_id, x, y, z``: nearest cell on each axis, the first on ties, probabilities rescaled to 1."""
    cells = {}
    for axis, name in enumerate("xyz"):
        at = (F.col(name) - grid.origin[axis]) / grid.cell[axis] - 0.5
        cells[f"i{name}"] = F.greatest(F.lit(0), F.least(F.lit(grid.shape[axis] - 1), F.ceil(at - 0.5))).cast("int")
    placed = points.withColumns(cells).withColumn("voxel_id", grid.voxel_id(F.col("ix"), F.col("iy"), F.col("iz"))).select("point_id", "voxel_id")
    found = placed.join(field.select("voxel_id", "probs", "support", "entropy"), "voxel_id")
    total = F.aggregate("probs", F.lit(0.0), lambda a, p: a + p)
    return found.withColumn("total", total).withColumn("probs", F.when(F.col("total") > 0, F.transform("probs", lambda p: p / F.col("total"))).otherwise(F.col("probs"))).drop("total")


def idw_interpolate(cells: DataFrame, samples: DataFrame, power: float = 2.0, unit: int | None = None, broadcast_rows: int = 10_000) -> DataFrame:
    """``voxel_id, estimate``: inverse-distance mean of ``samples (x, y, z, value)``; null outside the unit.

    Every cell needs every sample: a stated set of samples, dealt in blocks of at most
    ``broadcast_rows``, meets all cells, and sums are added up by voxel.
    """
    wanted = cells if unit is None else cells.where(F.col("most_likely") == unit)
    blocks = max(1, -(-samples.count() // broadcast_rows))
    numbered = samples.select(F.col("x").alias("px"), F.col("y").alias("py"), F.col("z").alias("pz"), F.col("value").alias("v")).withColumn("block", F.pmod(F.xxhash64("px", "py", "pz", "v"), F.lit(blocks)))
    distance = F.sqrt((F.col("x") - F.col("px")) ** 2 + (F.col("y") - F.col("py")) ** 2 + (F.col("z") - F.col("pz")) ** 2)
    weight = F.pow(F.greatest(distance, F.lit(1e-6)), F.lit(-power))
    sums = None
    for k in range(blocks):
        part = wanted.crossJoin(F.broadcast(numbered.where(F.col("block") == k))).select("voxel_id", weight.alias("w"), "v").groupBy("voxel_id").agg(F.sum(F.col("w") * F.col("v")).alias("wv"), F.sum("w").alias("w"))
        sums = part if sums is None else sums.unionAll(part)
    if blocks > 1:
        sums = sums.groupBy("voxel_id").agg(F.sum("wv").alias("wv"), F.sum("w").alias("w"))
    return cells.select("voxel_id").join(sums, "voxel_id", "left").select("voxel_id", (F.col("wv") / F.col("w")).alias("estimate"))


def slice_field(field: DataFrame, grid: Grid, axis: str, index: int | None = None) -> DataFrame:
    """One plane of cells; the middle one by default."""
    n = grid.shape["xyz".index(axis)]
    index = n // 2 if index is None else index
    if not 0 <= index < n:
        raise IndexError(f"plane {index} of {n}")
    return field.where(F.col(f"i{axis}") == index)


def padded_bounds(points: DataFrame) -> DataFrame:
    """One row with ``lo_x, hi_x, ...``: bounds with 5 % of the extent, at least 1, on each side; 0 to 1 without points."""
    aggregates, out = [], []
    for c in "xyz":
        aggregates += [F.min(c).alias(f"min_{c}"), F.max(c).alias(f"max_{c}")]
        pad = F.greatest(0.05 * (F.col(f"max_{c}") - F.col(f"min_{c}")), F.lit(1.0))
        out += [F.coalesce(F.col(f"min_{c}") - pad, F.lit(0.0)).alias(f"lo_{c}"), F.coalesce(F.col(f"max_{c}") + pad, F.lit(1.0)).alias(f"hi_{c}")]
    return points.agg(*aggregates).select(*out)
