"""Reversible line deduplication: sharded cuckoo filters over exact reference counts.

State, each part a Parquet table in the shared folder:

* ``refs (h1, h2, doc_id)``: which document holds which line key, once each;
* ``counts (h1, h2, n_docs, top_doc)``: the exact reference count of each key;
* ``filters (shard, cuckoo)``: for each shard of the keys, a cuckoo filter of its keys.

Documents are inserted in batches. A batch's keys first ask the filters: keys that no
filter knows are new and need no look-up; the others are merged with the exact counts.
Deleting documents lowers the counts, takes keys that reach zero out of the filters and
so undoes their insertion. A key is a 128-bit hash of the line.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass, replace

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import WHITESPACE, columns, map_batches, partitions, texts, unused, written
from .cuckoo import CuckooFilter

LOWER = {k: k + 32 for k in range(65, 91)}
KEY = ["h1", "h2"]


@dataclass(frozen=True)
class LineRules:
    min_chars: int = 20
    min_docs: int = 3


def line_key(line: str, rules: LineRules) -> bytes | None:
    """128-bit key of a line, none for a line too short to be judged."""
    key = line.strip(WHITESPACE).translate(LOWER)
    return xxhash.xxh3_128_digest(key.encode()) if len(key) >= rules.min_chars else None


def line_refs(docs: DataFrame, rules: LineRules, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """``h1, h2, doc_id`` of the keys of each row; rows without doc_id hold none."""

    def refs(batch: pa.RecordBatch) -> pa.RecordBatch:
        keys, owner = [], []
        for d, value in zip(batch.column(0).to_pylist(), texts(batch.column(1)), strict=True):
            own = {line_key(x, rules) for x in value.split("\n")} - {None}
            keys += own
            owner += [d] * len(own)
        h = np.frombuffer(b"".join(keys), np.int64).reshape(-1, 2)
        return pa.RecordBatch.from_arrays([pa.array(h[:, 0]), pa.array(h[:, 1]), pa.array(owner, pa.int64())], names=["h1", "h2", "doc_id"])

    taken = docs.select(F.col(f"`{doc_id}`").cast("long").alias("doc_id"), F.col(f"`{text}`").alias("text")).where("doc_id is not null")
    return map_batches(taken, refs, "h1 long, h2 long, doc_id long")


def _counted(refs: DataFrame) -> DataFrame:
    return refs.groupBy(*KEY).agg(F.count("*").alias("n_docs"), F.max("doc_id").alias("top_doc"))


@dataclass(frozen=True)
class LineIndex:
    """State after some insertions and deletions; every change gives a new state."""

    refs: DataFrame
    counts: DataFrame
    filters: DataFrame
    shards: int

    @classmethod
    def empty(cls, spark: SparkSession, shards: int | None = None) -> LineIndex:
        make = spark.createDataFrame
        return cls(
            make([], "h1 long, h2 long, doc_id long"),
            make([], "h1 long, h2 long, n_docs long, top_doc long"),
            make([], "shard int, cuckoo binary"),
            shards or 4 * partitions(spark),
        )

    def _shard(self) -> F.Column:  # type: ignore[name-defined]
        return F.pmod(F.col("h2"), F.lit(self.shards)).cast("int").alias("shard")

    def _probe(self, counts: DataFrame) -> DataFrame:
        """``counts`` with ``known``: whether its shard's filter may hold the key."""

        def probe(_: tuple, left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
            if len(right):
                held = CuckooFilter.from_bytes(right["cuckoo"].iloc[0])
                left["known"] = held.contains(left["h1"].to_numpy().view(np.uint64))
            else:
                left["known"] = False
            return left.drop(columns="shard")

        keyed = counts.withColumn("shard", self._shard()).groupBy("shard")
        return keyed.cogroup(self.filters.groupBy("shard")).applyInPandas(probe, "h1 long, h2 long, n_docs long, top_doc long, known boolean")

    def _changed_filters(self, added: DataFrame, removed: DataFrame) -> DataFrame:
        """Filters after adding and removing distinct keys, shard by shard; a full filter is rebuilt larger from the exact counts."""
        change = added.select(self._shard(), "h1", F.lit(True).alias("add")).unionAll(removed.select(self._shard(), "h1", F.lit(False).alias("add")))

        def apply(key: tuple, left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
            fresh = left.loc[left["add"], "h1"].to_numpy().view(np.uint64)
            gone = left.loc[~left["add"], "h1"].to_numpy().view(np.uint64)
            if len(right):
                held = CuckooFilter.from_bytes(right["cuckoo"].iloc[0])
                held.delete(gone)
                if np.count_nonzero(held.table) + len(fresh) > 0.8 * held.table.size or not held.insert(fresh):
                    return pd.DataFrame({"shard": [key[0]], "cuckoo": [b""]})
            else:
                held = CuckooFilter.build(fresh)
            return pd.DataFrame({"shard": [key[0]], "cuckoo": [held.to_bytes()]})

        return change.groupBy("shard").cogroup(self.filters.groupBy("shard")).applyInPandas(apply, "shard int, cuckoo binary")

    def _with_filters(self, counts: DataFrame, added: DataFrame, removed: DataFrame) -> DataFrame:
        changed = written(self._changed_filters(added, removed), "filters")
        full = changed.where("length(cuckoo) = 0").select("shard")

        def build(key: tuple, rows: pd.DataFrame) -> pd.DataFrame:
            return pd.DataFrame({"shard": [key[0]], "cuckoo": [CuckooFilter.build(rows["h1"].to_numpy().view(np.uint64)).to_bytes()]})

        rebuilt = counts.select(self._shard(), "h1").join(full, "shard", "left_semi").groupBy("shard").applyInPandas(build, "shard int, cuckoo binary")
        return written(changed.where("length(cuckoo) > 0").unionAll(rebuilt), "filters")

    def insert(self, refs: DataFrame) -> LineIndex:
        """With a batch of references; those that the index holds already change nothing."""
        fresh = written(refs.distinct(), "line-refs")
        if self.refs.take(1):
            fresh = written(fresh.join(self.refs, [*KEY, "doc_id"], "left_anti"), "line-refs")
        probed = written(self._probe(_counted(fresh)), "line-probe")
        maybe = probed.where("known").drop("known")
        old = self.counts
        joined = old.join(maybe.select(*KEY, F.col("n_docs").alias("n"), F.col("top_doc").alias("t")), KEY, "left")
        merged = joined.select(*KEY, (F.col("n_docs") + F.coalesce("n", F.lit(0))).alias("n_docs"), F.greatest("top_doc", "t").alias("top_doc"))
        false_alarm = maybe.join(old, KEY, "left_anti")
        new = probed.where("not known").drop("known").unionAll(false_alarm)
        counts = written(merged.unionAll(new), "line-counts")
        filters = self._with_filters(counts, new, new.limit(0))
        return replace(self, refs=self.refs.unionAll(fresh), counts=counts, filters=filters)

    def delete(self, doc_ids: DataFrame) -> LineIndex:
        """Without the references of some documents (``doc_id``), as if never inserted."""
        gone = self.refs.join(doc_ids.select("doc_id").distinct(), "doc_id", "left_semi").select(*KEY, "doc_id")
        refs = written(self.refs.join(doc_ids.select("doc_id").distinct(), "doc_id", "left_anti").select(*KEY, "doc_id"), "line-refs")
        touched = written(gone.select(*KEY).distinct(), "line-touched")
        left = written(_counted(refs.join(touched, KEY, "left_semi")), "line-left")
        counts = written(self.counts.join(touched, KEY, "left_anti").unionAll(left), "line-counts")
        zero = touched.join(left, KEY, "left_anti")
        return replace(self, refs=refs, counts=counts, filters=self._with_filters(counts, zero.limit(0), zero))

    def dropped(self, rules: LineRules) -> DataFrame:
        """``doc_id, h1, h2``: keys that lose their lines in a document."""
        common = self.counts.where(F.col("n_docs") >= rules.min_docs).select(*KEY, "top_doc")
        return self.refs.join(common, KEY).where("doc_id < top_doc").select("doc_id", *KEY)


def indexed(docs: DataFrame, rules: LineRules, batches: int = 2, doc_id: str = "doc_id", text: str = "text") -> LineIndex:
    """Index of all rows, inserted in batches by hash of doc_id."""
    index = LineIndex.empty(docs.sparkSession)
    for k in range(batches):
        index = index.insert(line_refs(docs.where(F.pmod(F.xxhash64(f"`{doc_id}`"), F.lit(batches)) == k), rules, doc_id, text))
    return index


def _cut(docs: DataFrame, rules: LineRules, batches: int, doc_id: str, text: str, drop: str) -> DataFrame:
    """``docs`` with the keys that each row loses in a column ``drop``, null where none."""
    (holder,) = unused(docs, "holder")
    drops = indexed(columns(docs, doc_id, text), rules, batches, doc_id, text).dropped(rules).groupBy(F.col("doc_id").alias(holder)).agg(F.collect_list(F.struct(*KEY)).alias(drop))
    return docs.join(drops, F.col(f"`{doc_id}`").cast("long") == F.col(holder), "left").drop(holder)


def _kept_lines(value: str | None, drops: list[dict] | None, rules: LineRules) -> tuple[int, list[str]]:
    lines = (value or "").split("\n")
    if drops is None or not len(drops):
        return len(lines), lines
    gone = {np.array([x["h1"], x["h2"]], np.int64).tobytes() for x in drops}
    return len(lines), [x for x in lines if line_key(x, rules) not in gone]


def dedup_lines(docs: DataFrame, rules: LineRules = LineRules(), batches: int = 2, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """``doc_id, n_lines, n_dropped, kept_sha256, kept_text`` of every row.

    A line with a key found in at least ``min_docs`` documents stays only in the largest
    doc_id that holds it. A null or empty text is one empty line. Rows with equal doc_id
    are one holder, each loses its lines by the same rule; a null doc_id holds no key and
    loses no line. Other columns are not read.
    """
    joined = _cut(columns(docs, doc_id, text).toDF("doc_id", "text"), rules, batches, "doc_id", "text", "gone")

    def cut(batch: pa.RecordBatch) -> pa.RecordBatch:
        rows = [_kept_lines(t, d, rules) for t, d in zip(batch.column(1).to_pylist(), batch.column(2).to_pylist(), strict=True)]
        kept = ["\n".join(x) for _, x in rows]
        return pa.RecordBatch.from_arrays(
            [batch.column(0), pa.array([n for n, _ in rows], pa.int64()), pa.array([n - len(x) for n, x in rows], pa.int64()), pa.array([hashlib.sha256(x.encode()).hexdigest() for x in kept], pa.string()), pa.array(kept, pa.string())],
            names=["doc_id", "n_lines", "n_dropped", "kept_sha256", "kept_text"],
        )

    return map_batches(joined.select(F.col("doc_id").cast("long").alias("doc_id"), "text", "gone"), cut, "doc_id long, n_lines long, n_dropped long, kept_sha256 string, kept_text string")


def rewrite_documents(docs: DataFrame, rules: LineRules = LineRules(), batches: int = 2, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """``docs`` with repeated lines taken out of ``text``; all rows and other columns stay, whatever their names."""
    (gone,) = unused(docs, "gone")
    joined = _cut(docs, rules, batches, doc_id, text, gone)

    @F.pandas_udf("string")
    def kept(values: pd.Series, drops: pd.Series) -> pd.Series:
        return pd.Series([v if d is None or not len(d) else "\n".join(_kept_lines(v, d, rules)[1]) for v, d in zip(values, drops, strict=True)], dtype=object)

    return joined.withColumn(text, F.when(F.col(gone).isNull(), F.col(f"`{text}`")).otherwise(kept(F.col(f"`{text}`"), F.col(gone)))).select(*[F.col(f"`{c}`") for c in docs.columns])
