"""From points to a verdict on a layer."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame

from ..grid import Grid
from ..operators import scoring


def wide_layers(placed: DataFrame, layers: dict[str, Column]) -> DataFrame:
    """``voxel_id, iz`` and a column for each layer: aggregates of the points in each voxel.

    One shuffle on the voxel, of partial aggregates.
    """
    rows = placed.where("in_range").groupBy("voxel_id", "iz").agg(*[c.alias(n) for n, c in layers.items()])
    return rows


def paint_and_score(wide: DataFrame, old: list[str], new: str, grid: Grid) -> DataFrame:
    """One row with the verdict on ``new`` beside the layers in ``old``."""
    wide = wide.select("voxel_id", "iz", *old, new)
    found = scoring.evaluate_layer(wide, old, new, grid.shape[2], grid.n_voxels)
    row = (new, found["admitted"], found["bic_before"], found["bic_after"], found["bic_delta"], found["predicted_value"], found["mutual_info"])
    return wide.sparkSession.createDataFrame([row], "layer string, admitted boolean, bic_before double, bic_after double, bic_delta double, predicted_value double, mutual_info map<string,double>")
