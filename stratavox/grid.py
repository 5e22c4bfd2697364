"""Regular 3-D grids: a few numbers on the driver that become literals in column expressions."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


@dataclass(frozen=True)
class Grid:
    """Box from ``origin`` to ``maximum`` cut into ``shape`` cells; voxels are numbered row-major."""

    origin: tuple[float, float, float]
    maximum: tuple[float, float, float]
    shape: tuple[int, int, int]
    crs: str | None = None

    def __post_init__(self) -> None:
        if min(self.shape) < 1 or any(b <= a for a, b in zip(self.origin, self.maximum, strict=True)):
            raise ValueError("a grid needs a positive extent and at least one cell on each axis")

    @classmethod
    def from_bounds(cls, bounds: tuple[tuple[float, float], ...], nx: int, ny: int, nz: int, crs: str | None = None) -> Grid:
        return cls(tuple(b[0] for b in bounds), tuple(b[1] for b in bounds), (nx, ny, nz), crs)

    @property
    def cell(self) -> tuple[float, float, float]:
        return tuple((b - a) / n for a, b, n in zip(self.origin, self.maximum, self.shape, strict=True))

    @property
    def n_voxels(self) -> int:
        return self.shape[0] * self.shape[1] * self.shape[2]

    @property
    def diagonal(self) -> float:
        return sum((b - a) ** 2 for a, b in zip(self.origin, self.maximum, strict=True)) ** 0.5

    @property
    def spacing(self) -> float:
        return min(self.cell)

    def voxel_id(self, ix: Column, iy: Column, iz: Column) -> Column:
        return (ix.cast("long") * self.shape[1] + iy) * self.shape[2] + iz

    def centre(self, axis: int, index: Column) -> Column:
        return F.lit(self.origin[axis]) + (index + 0.5) * self.cell[axis]

    def index(self, axis: int, value: Column) -> Column:
        """Cell of a coordinate inside the bounds; the upper edge belongs to the last cell."""
        share = (value - self.origin[axis]) / (self.maximum[axis] - self.origin[axis])
        return F.least(F.floor(share * self.shape[axis]), F.lit(self.shape[axis] - 1)).cast("int")

    def inside(self, x: Column, y: Column, z: Column) -> Column:
        return F.coalesce(x.between(self.origin[0], self.maximum[0]) & y.between(self.origin[1], self.maximum[1]) & z.between(self.origin[2], self.maximum[2]), F.lit(False))


#: The grid of the survey area, and the smaller one.
SURVEY_GRID = Grid((117.832397, -27.441096, 0.0), (117.973493, -27.3, 80.0), (200, 200, 8), "EPSG:4326")
SMALL_GRID = Grid((117.832397, -27.441096, 0.0), (117.973493, -27.3, 80.0), (25, 25, 5), "EPSG:4326")


def grid_cells(spark: SparkSession, grid: Grid) -> DataFrame:
    """Every cell: ``voxel_id, ix, iy, iz, x, y, z``."""
    _, ny, nz = grid.shape
    ids = spark.range(grid.n_voxels).withColumnRenamed("id", "voxel_id")
    cells = ids.select("voxel_id", F.expr(f"int(voxel_id div {ny * nz})").alias("ix"), F.expr(f"int((voxel_id div {nz}) % {ny})").alias("iy"), F.expr(f"int(voxel_id % {nz})").alias("iz"))
    return cells.withColumns({name: grid.centre(axis, F.col(f"i{name}")) for axis, name in enumerate("xyz")})
