"""Small pieces that the operators of this subpackage share.

Shared storage, column clean-up, word hashing in numpy and connected components.
"""

from __future__ import annotations

import ctypes
import tempfile
import uuid
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Whitespace of the word rule ``[^\x20\x09-\x0D]+``; ``bytes.split()`` splits at exactly these.
WHITESPACE = " \t\n\r\x0b\x0c"

#: Rows are sent to Python until they are this large; Spark's own default is 64 MB.
BATCH_SIZE = "spark.sql.execution.arrow.maxBytesPerBatch"
BATCH_BYTES = 4 << 20


def shared_folder(spark: SparkSession) -> str:
    """The folder that driver and executors share: ``spark.checkpoint.dir``.

    Where it is unset, a local session gets a temporary folder of its own; on a
    cluster that would lose files, so there it is an error.
    """
    given = spark.conf.get("spark.checkpoint.dir", None)
    if given:
        return given.rstrip("/")
    if not spark.sparkContext.master.startswith("local"):
        raise ValueError("spark.checkpoint.dir names no shared folder")
    folder = "file://" + tempfile.mkdtemp(prefix="spark-", dir="/tmp")
    spark.conf.set("spark.checkpoint.dir", folder)
    return folder


def written(df: DataFrame, name: str) -> DataFrame:
    """``df`` as a Parquet table in the shared folder, reread: it ends the lineage."""
    spark = df.sparkSession
    path = f"{shared_folder(spark)}/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def partitions(spark: SparkSession) -> int:
    """Shuffle partitions of the session, as the cluster's operator has set them."""
    return max(1, int(spark.conf.get("spark.sql.shuffle.partitions")))


def columns(df: DataFrame, *names: str) -> DataFrame:
    """Only the named columns, so that other columns can't clash with the operator's."""
    return df.select(*[F.col(f"`{n}`") for n in names])


def unused(df: DataFrame, *names: str) -> list[str]:
    """A column name for each of ``names`` that ``df`` does not have, by Spark's rule on case."""
    held = {c.lower() for c in df.columns}
    out = []
    for name in names:
        while name.lower() in held:
            name += "_"
        held.add(name.lower())
        out.append(name)
    return out


def small_batches(df: DataFrame) -> DataFrame:
    """``df``, whose session from now on sends whole texts to Python in batches of bounded size.

    The JVM holds a batch outside its heap and a worker holds it several times over, so batches
    of 10,000 texts fill an executor. A size that the cluster's operator has set stays.
    """
    conf = df.sparkSession.conf
    if conf.get(BATCH_SIZE, None) is None:
        conf.set(BATCH_SIZE, BATCH_BYTES)
    return df


def released(function: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """A function of ``mapInArrow`` that gives its memory back when its task ends: the worker stays and waits for others."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        try:
            yield from function(batches)
        finally:
            pa.default_memory_pool().release_unused()
            if trim := getattr(ctypes.CDLL(None), "malloc_trim", None):  # of glibc
                trim(0)

    return run


def map_batches(
    df: DataFrame, function: Callable[[pa.RecordBatch], pa.RecordBatch | None], schema: str
) -> DataFrame:
    """``mapInArrow`` with a function of one batch."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = function(batch) if batch.num_rows else None
            if out is not None and out.num_rows:
                yield out

    return small_batches(df).mapInArrow(released(run), schema)


def packed(df: DataFrame, text: str = "text") -> DataFrame:
    """``df`` with its text as compressed bytes, so that a shuffle of whole texts moves less; a null is an empty text."""
    place = df.columns.index(text)

    def pack(batch: pa.RecordBatch) -> pa.RecordBatch:
        zip_ = zstandard.ZstdCompressor(level=3).compress
        data = pa.array([zip_((t.as_py() or "").encode()) for t in batch.column(place)], pa.binary())
        return batch.set_column(place, text, data)

    kinds = ", ".join(f"`{c}` {'binary' if c == text else kind}" for c, kind in df.dtypes)
    return map_batches(df, pack, kinds)


def unpacked(column: pa.Array) -> Iterator[bytes]:
    """UTF-8 bytes of packed texts."""
    unzip = zstandard.ZstdDecompressor().decompress
    for x in column:
        yield unzip(x.as_py())


class SpanHasher:
    """64-bit hashes of word spans of one text, from prefix sums of a polynomial.

    Words are joined by one space. The hash of words ``i .. i+k-1`` depends on those
    words alone, whatever stands around them, and costs a few numpy operations for
    all ``i`` at once. ``seed`` picks independent hash functions.
    """

    def __init__(self, seed: int) -> None:
        rng = np.random.default_rng(seed)
        self.table = rng.integers(1, 2**63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
        self.base = int(rng.integers(1, 2**62)) * 8 + 5
        self.mix = np.uint64(int(rng.integers(1, 2**62)) * 2 + 1)
        self._grow(1 << 16)

    def _grow(self, size: int) -> None:
        def powers(of: int) -> np.ndarray:
            steps = np.full(size + 1, of % 2**64, dtype=np.uint64)
            steps[0] = 1
            return np.cumprod(steps, dtype=np.uint64)

        self.up, self.down = powers(self.base), powers(pow(self.base, -1, 2**64))

    def prefix(self, data: np.ndarray) -> np.ndarray:
        if len(data) >= len(self.up):
            self._grow(2 * len(data))
        sums = np.zeros(len(data) + 1, np.uint64)
        np.cumsum(self.table[data] * self.up[: len(data)], out=sums[1:])
        return sums

    def spans(self, prefix: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        """Hash of ``data[start:end]`` for each pair."""
        return self._mixed((prefix[end] - prefix[start]) * self.down[start])

    def runs(self, values: np.ndarray, k: int) -> np.ndarray:
        """Hash of each run of ``k`` neighbouring 64-bit values."""
        n = len(values)
        if n < k:
            return np.empty(0, np.uint64)
        if n >= len(self.up):
            self._grow(2 * n)
        sums = np.zeros(n + 1, np.uint64)
        np.cumsum(values * self.up[:n], out=sums[1:])
        return self._mixed((sums[k:] - sums[:-k]) * self.down[: n - k + 1])

    def _mixed(self, x: np.ndarray) -> np.ndarray:
        x ^= x >> np.uint64(32)
        x *= self.mix
        x ^= x >> np.uint64(29)
        return x


def word_bounds(words: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The words with a space behind each as bytes, and where each word starts and ends (its space included)."""
    data = np.frombuffer(b" ".join(words) + b" ", np.uint8) if words else np.empty(0, np.uint8)
    ends = np.flatnonzero(data == 32) + 1
    starts = np.concatenate([np.zeros(1, np.int64), ends[:-1]]) if len(ends) else ends
    return data, starts, ends


def texts(column: pa.Array) -> Iterator[str]:
    """Texts of an Arrow column, a null as the empty text."""
    for x in column:
        yield x.as_py() or ""


def connected_components(edges: DataFrame, max_rounds: int = 60) -> DataFrame:
    """Smallest vertex reachable from each vertex of ``edges (a, b)``: ``(id, component)``.

    Alternating large-star and small-star rounds (Kiveris et al., 2014) until the edges
    no longer change. A round writes its edges to the shared folder, so a lost executor
    costs one round. A hub's edges are dealt by both ends; no group is gathered:
    neighbourhood minima are partial aggregates, joined back.

    Self links and nulls are left out; an empty table gives an empty table.
    """
    edges = edges.where("a is not null and b is not null and a <> b")
    edges = written(edges.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct(), "edges")
    before = None
    for _ in range(max_rounds):
        both = edges.unionAll(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = both.groupBy("u").agg(F.least(F.min("v"), F.first("u")).alias("m"))
        large = both.join(low, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").distinct()
        large = written(large, "large-star")
        low = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(low, "u")
        small = (
            small.select(F.col("v").alias("u"), F.col("m").alias("v"))
            .unionAll(small.select(F.col("u"), F.col("m").alias("v")))
            .where("u <> v")
            .distinct()
        )
        edges = written(small, "small-star")
        now = edges.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if now == before:
            break
        before = now
    else:
        raise RuntimeError(f"components not settled after {max_rounds} rounds")
    return edges.select(F.col("u").alias("id"), F.col("v").alias("component")).unionAll(
        edges.select(F.col("v").alias("id"), F.col("v").alias("component")).distinct()
    )
