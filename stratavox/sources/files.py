"""Assay tables, layer stores, fields, logs, graph documents and manifests as files."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType
from pyspark.sql.utils import AnalysisException

from ..grid import Grid
from ..operators.graph import folded_kind

CELL = "layer string, voxel_id long, ix int, iy int, iz int, value double"
INDEX = "layer string, dtype string, metadata string, hypothesis_uri string, experiment_id string, added_at timestamp, bic_delta double, mutual_info map<string,double>"
METRICS = (
    "metric_type string, inference_id string, run_id string, episode_id string, backend string, model string, phase string, success boolean, "
    "usage struct<prompt_tokens:int,completion_tokens:int,total_tokens:int,model:string,stop_reason:string>, latency_ms double, prompt_tokens_per_second double, output_tokens_per_second double, "
    "total_tokens_per_second double, gpu_memory_mb double, host_memory_mb double, kv_cache_usage_pct double, num_requests_running int, num_requests_waiting int, phase_name string, duration_ms double, retry_count int"
)


def read_assays(spark: SparkSession, path: str, schema: StructType | str) -> DataFrame:
    """Assay CSV with a header; cells that don't fit the schema are null."""
    return spark.read.schema(schema).csv(path, header=True, mode="PERMISSIVE")


class LayerStore:
    """Layers as Parquet partitions by name, with an index of their descriptions.

    The index is a log: a layer's last entry counts, and an entry with ``dropped`` ends it.
    """

    def __init__(self, spark: SparkSession, folder: str, grid: Grid) -> None:
        self.spark, self.folder, self.grid = spark, folder.rstrip("/"), grid

    def _index(self) -> DataFrame:
        schema = f"{INDEX}, version string, seq long, dropped boolean"
        try:
            return self.spark.read.schema(schema).parquet(f"{self.folder}/index")
        except AnalysisException:
            return self.spark.createDataFrame([], schema)

    def list_layers(self) -> DataFrame:
        """Descriptions of the layers, without values."""
        last = self._index().groupBy("layer").agg(F.max_by(F.struct("dtype", "metadata", "hypothesis_uri", "experiment_id", "added_at", "bic_delta", "mutual_info", "version", "seq", "dropped"), "seq").alias("r"))
        return last.select("layer", "r.*").where("not dropped")

    def _log(self, row: DataFrame) -> None:
        last = self._index().agg(F.coalesce(F.max("seq"), F.lit(0))).first()[0]
        row.withColumn("seq", F.lit(last + 1)).write.mode("append").parquet(f"{self.folder}/index")

    def write_layer(self, values: DataFrame, layer: str, dtype: str = "float", metadata: str | None = None) -> None:
        """Adds a layer of ``ix, iy, iz, value``: a row for each cell of the grid; an existing name is an error."""
        if self.list_layers().where(F.col("layer") == layer).take(1):
            raise ValueError(f"layer {layer} exists")
        nx, ny, nz = self.grid.shape
        inside = F.col("ix").between(0, nx - 1) & F.col("iy").between(0, ny - 1) & F.col("iz").between(0, nz - 1)
        voxel = self.grid.voxel_id(F.col("ix"), F.col("iy"), F.col("iz"))
        found = values.agg(F.count("*").alias("n"), F.count_distinct(voxel).alias("d"), F.coalesce(F.bool_and(inside), F.lit(False)).alias("ok")).first()
        if found.n != self.grid.n_voxels or found.d != found.n or not found.ok:
            raise ValueError(f"layer {layer} does not fill the grid")
        version = uuid.uuid4().hex
        values.select(voxel.alias("voxel_id"), "ix", "iy", "iz", F.nanvl(F.col("value").cast("double"), F.lit(None).cast("double")).alias("value")).write.parquet(f"{self.folder}/values/{version}")
        empty = self.spark.createDataFrame([(layer, dtype, metadata, version)], "layer string, dtype string, metadata string, version string")
        self._log(empty.select("layer", "dtype", "metadata", F.lit(None).cast("string").alias("hypothesis_uri"), F.lit(None).cast("string").alias("experiment_id"), F.current_timestamp().alias("added_at"), F.lit(None).cast("double").alias("bic_delta"), F.lit(None).cast("map<string,double>").alias("mutual_info"), "version", F.lit(False).alias("dropped")))

    def read_layer(self, layer: str) -> DataFrame:
        row = self.list_layers().where(F.col("layer") == layer).first()
        if row is None:
            raise KeyError(layer)
        return self.spark.read.schema(CELL.split(", ", 1)[1]).parquet(f"{self.folder}/values/{row.version}").select(F.lit(layer).alias("layer"), "*")

    def drop_layer(self, layer: str) -> None:
        row = self.list_layers().where(F.col("layer") == layer)
        if not row.take(1):
            raise KeyError(layer)
        self._log(row.drop("seq").withColumn("dropped", F.lit(True)))


def layer_from_array(df: DataFrame, grid: Grid, values: str = "values", nested: bool = True) -> DataFrame:
    """Cells ``layer, ix, iy, iz, voxel_id, value`` of a nested [x][y][z] or a flat row-major array."""
    _, ny, nz = grid.shape
    if nested:
        x = df.select("layer", F.posexplode(values).alias("ix", "a"))
        y = x.select("layer", "ix", F.posexplode("a").alias("iy", "b"))
        cells = y.select("layer", "ix", "iy", F.posexplode("b").alias("iz", "value"))
    else:
        flat = df.select("layer", F.posexplode(values).alias("v", "value"))
        cells = flat.select("layer", F.expr(f"int(v div {ny * nz})").alias("ix"), F.expr(f"int((v div {nz}) % {ny})").alias("iy"), F.expr(f"int(v % {nz})").alias("iz"), "value")
    return cells.withColumn("voxel_id", grid.voxel_id(F.col("ix"), F.col("iy"), F.col("iz")))


def layer_to_array(cells: DataFrame) -> DataFrame:
    """``layer, ix, values``: a nested [y][z] array for each x-slab."""
    columns = cells.groupBy("layer", "ix", "iy").agg(F.array_sort(F.collect_list(F.struct("iz", "value"))).alias("z"))
    columns = columns.select("layer", "ix", "iy", F.transform("z", lambda c: c["value"]).alias("z"))
    slabs = columns.groupBy("layer", "ix").agg(F.array_sort(F.collect_list(F.struct("iy", "z"))).alias("y"))
    return slabs.select("layer", "ix", F.transform("y", lambda c: c["z"]).alias("values"))


def write_field(field: DataFrame, meta: DataFrame, path: str) -> None:
    """A field and its one-row description; the number of cells must match the described shape."""
    m = meta.first()
    if field.count() != m.nx * m.ny * m.nz:
        raise ValueError("the field does not fill its shape")
    wrong = field.where(F.size("probs") != len(m.unit_ids)).take(1)
    if wrong:
        raise ValueError("probabilities and units differ in number")
    field.write.parquet(f"{path}/cells")
    meta.write.parquet(f"{path}/meta")


def read_field(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    return spark.read.parquet(f"{path}/cells"), spark.read.parquet(f"{path}/meta")


def with_derived_scalars(field: DataFrame, channels: DataFrame, feature_names: list[str]) -> DataFrame:
    """Field with ``channels (voxel_id, channel, value)`` in its ``derived`` map; a later value of a name wins.

    A channel with the name of a feature is an error.
    """
    clash = channels.where(F.col("channel").isin(feature_names)).select("channel").take(1)
    if clash:
        raise ValueError(f"channel {clash[0].channel} is a feature")
    new = channels.groupBy("voxel_id").agg(F.map_from_entries(F.collect_list(F.struct("channel", "value"))).alias("new"))
    old = F.coalesce(F.col("derived"), F.create_map().cast("map<string,double>"))
    added = F.coalesce(F.col("new"), F.create_map().cast("map<string,double>"))
    kept = F.map_filter(old, lambda k, _: ~F.coalesce(F.map_contains_key(added, k), F.lit(False)))
    return field.join(new, "voxel_id", "left").withColumn("derived", F.map_concat(kept, added)).drop("new")


def read_metrics(spark: SparkSession, path: str) -> DataFrame:
    """All ``metrics_*.jsonl`` below a folder; lines that are no objects are left out."""
    rows = spark.read.schema(f"{METRICS}, _bad string").json(path, recursiveFileLookup=True, pathGlobFilter="metrics_*.jsonl", columnNameOfCorruptRecord="_bad", mode="PERMISSIVE")
    return rows.where("metric_type is not null").drop("_bad")


def read_runs(spark: SparkSession, path: str, schema: StructType | str) -> DataFrame:
    """All ``run.json`` below a folder, the last file of each run; a malformed file is an error."""
    rows = spark.read.schema(schema).json(path, multiLine=True, recursiveFileLookup=True, pathGlobFilter="run.json", mode="FAILFAST")
    named = rows.select("*", F.col("_metadata.file_path").alias("file"))
    return named.groupBy("run_id").agg(F.max_by(F.struct(*[c for c in rows.columns if c != "run_id"]), "file").alias("r")).select("run_id", "r.*")


def read_episodes(spark: SparkSession, path: str, schema: StructType | str) -> DataFrame:
    """Episode lines with the names of older logs mapped to today's: score, turns and peaks."""
    rows = spark.read.schema(schema).json(path)
    has = lambda c: F.col(c) if c in rows.columns else F.lit(None)
    older = {"score": ("space_freed_kb", "double"), "llm_turns": ("action_count", "int"), "gpu_util_peak": ("peak_gpu_utilization", "double"), "cpu_util_peak": ("peak_cpu_utilization", "double")}
    return rows.withColumns({name: F.coalesce(has(name).cast(kind), has(old).cast(kind)) for name, (old, kind) in older.items()})


def read_graph_docs(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """``nodes`` and ``edges`` of graph documents, one JSON file each, with kinds folded."""
    node = "node_id string, id string, kind string, unit_id string, p_exists double, provenance string, metadata map<string,string>, between array<string>, surface_points array<string>, position string"
    edge = "edge_id string, id string, kind string, source string, target string, p_exists double, provenance string, metadata map<string,string>"
    as_struct = lambda s: "struct<" + ",".join(":".join(x.split(" ", 1)) for x in s.split(", ")) + ">"
    docs = spark.read.schema(f"graph_id string, nodes array<{as_struct(node)}>, edges array<{as_struct(edge)}>").json(path, multiLine=True)

    def rows(column: str, key: str) -> DataFrame:
        out = docs.select("graph_id", F.posexplode(column).alias(f"{column[:-1]}_seq", "x")).select("graph_id", f"{column[:-1]}_seq", "x.*")
        return out.withColumns({key: F.coalesce(key, "id"), "kind": folded_kind(F.col("kind")), "p_exists": F.coalesce("p_exists", F.lit(1.0))}).drop("id")

    return rows("nodes", "node_id"), rows("edges", "edge_id")


def write_jsonl(rows: DataFrame, path: str, order: list[str]) -> None:
    """One JSON object a line, in the given order."""
    rows.orderBy(*order).write.json(path, ignoreNullFields=False)


def data_preview(rows: DataFrame, n: int = 10, chars: int = 200) -> DataFrame:
    """The first rows, with long texts cut for display."""
    return rows.limit(n).select(*[F.left(F.col(c), F.lit(chars)).alias(c) if kind == "string" else F.col(c) for c, kind in rows.dtypes])


def file_manifest(spark: SparkSession, folder: str) -> DataFrame:
    """``path, size, sha256`` of every file below a folder."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(folder)
    return files.select(F.regexp_replace("path", f"^.*?{folder.rstrip('/').split('://')[-1]}/", "").alias("path"), F.col("length").alias("size"), F.sha2("content", 256).alias("sha256"))


def dataset_drift(before: DataFrame, after: DataFrame) -> DataFrame:
    """``path, change``: files added, removed or changed between two manifests."""
    both = before.select("path", F.col("sha256").alias("a")).join(after.select("path", F.col("sha256").alias("b")), "path", "full_outer")
    change = F.when(F.col("a").isNull(), "added").when(F.col("b").isNull(), "removed").when(F.col("a") != F.col("b"), "changed")
    return both.select("path", change.alias("change")).where("change is not null")
