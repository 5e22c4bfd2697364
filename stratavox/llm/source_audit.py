"""Audit of how far the sources of a language differ in their terms.

Identical texts of a language are collapsed first: a task keeps one copy of each text and
counts its sources, the copies of all tasks meet in one shuffle, and each distinct text is
tokenized once; its term counts and document frequencies are weighted by the copies.

Terms that neither of two sources holds add the same amount for every term, and terms that
only one of them holds add an amount that depends on their count alone. So a pair of
sources is evaluated from the number of its terms by count, and only terms that both hold
are met one by one.
"""

from __future__ import annotations

import hashlib
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
import zstandard
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import columns, partitions, written

#: Bytes that are no part of a term become spaces; A-Z are lower-cased.
FOLD = bytes(c + 32 if 65 <= c <= 90 else c if 97 <= c <= 122 or c >= 128 else 32 for c in range(256))


@dataclass(frozen=True)
class AuditSettings:
    #: Documents of a language that a kept term stands in, and ranks of the part ``term``.
    least_documents: int = 3
    ranks: int = 200
    scale: int = 1_000_000_000
    #: Distinct texts, and distinct (language, source, term), that a task holds before it hands them on.
    held_texts: int = 20_000
    held_terms: int = 400_000
    #: Parts that the pairs of a language are dealt out to.
    salts: int = 16


def collapsed(docs: DataFrame, settings: AuditSettings) -> DataFrame:
    """``lang, digest, source, n, text``: copies by text and source, merged within each task.

    A task sends a text along with the first of its rows only, compressed; the other rows
    of that text have a null.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pack = zstandard.ZstdCompressor(level=1).compress
        held: dict[tuple[str, bytes, str], int] = {}
        texts: dict[tuple[str, bytes], bytes] = {}
        size = 0
        for batch in batches:
            langs, sources = batch.column(0).to_pylist(), batch.column(1).to_pylist()
            for lang, source, cell in zip(langs, sources, batch.column(2), strict=True):
                text = cell.as_py()
                digest = hashlib.blake2b(text, digest_size=16).digest()
                if (lang, digest) not in texts:
                    data = texts[lang, digest] = pack(text)
                    size += len(data)
                held[lang, digest, source] = held.get((lang, digest, source), 0) + 1
                if len(held) >= settings.held_texts or size >= 16_000_000:
                    yield emptied(held, texts)
                    size = 0
        if held:
            yield emptied(held, texts)

    def emptied(held: dict, texts: dict) -> pa.RecordBatch:
        rows = [(lang, digest, source, n, texts.pop((lang, digest), None)) for (lang, digest, source), n in held.items()]
        held.clear()
        return pa.RecordBatch.from_arrays(
            [pa.array(x, kind) for x, kind in zip(zip(*rows, strict=True), (pa.string(), pa.binary(), pa.string(), pa.int64(), pa.binary()), strict=True)],
            names=["lang", "digest", "source", "n", "text"],
        )

    return docs.mapInArrow(run, "lang string, digest binary, source string, n long, text binary")


def term_counts(docs: DataFrame, settings: AuditSettings = AuditSettings()) -> DataFrame:
    """``lang, source, term, n, documents``: occurrences of each term and documents that hold it, by source."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        unpack = zstandard.ZstdDecompressor().decompress
        held: dict[tuple[str, str], dict[bytes, list[int]]] = {}
        size, last, terms = 0, None, {}
        for batch in batches:
            langs, sources, copies = (batch.column(k).to_pylist() for k in (0, 2, 3))
            for k, (lang, source, n) in enumerate(zip(langs, sources, copies, strict=True)):
                key = lang, batch.column(1)[k].as_py()
                if key != last:  # the first row of a text carries it
                    last, terms = key, Counter(unpack(batch.column(4)[k].as_py()).translate(FOLD).split())
                own = held.setdefault((lang, source), {})
                size -= len(own)
                for term, found in terms.items():
                    if (both := own.get(term)) is None:
                        own[term] = [found * n, n]
                    else:
                        both[0] += found * n
                        both[1] += n
                size += len(own)
                if size >= settings.held_terms:
                    yield from emptied(held)
                    size = 0
        yield from emptied(held)

    def emptied(held: dict) -> Iterator[pa.RecordBatch]:
        for (lang, source), own in held.items():
            yield pa.RecordBatch.from_arrays(
                [pa.array([lang] * len(own), pa.string()), pa.array([source] * len(own), pa.string()), pa.array(own, pa.binary()), *(pa.array([x[k] for x in own.values()], pa.int64()) for k in (0, 1))],
                names=["lang", "source", "term", "n", "documents"],
            )
        held.clear()

    met = collapsed(docs, settings).repartition(partitions(docs.sparkSession), "lang", "digest")
    met = met.sortWithinPartitions("lang", "digest", F.col("text").isNull())
    counts = met.mapInArrow(run, "lang string, source string, term binary, n long, documents long")
    counts = counts.groupBy("lang", "source", "term").agg(F.sum("n").alias("n"), F.sum("documents").alias("documents"))
    return counts.withColumn("term", F.col("term").cast("string"))


def share(n: Column, total: Column, terms: Column, scale: int) -> Column:
    """``1 + floor(scale * (n + 1) / (total + terms))`` exactly."""
    return F.call_function("div", (n + F.lit(1)).cast("decimal(19,0)") * F.lit(scale).cast("decimal(19,0)"), (total + terms).cast("decimal(38,0)")) + F.lit(1)


def excess(p: Column, q: Column) -> Column:
    """``floor((p - q)^2 / q)``; shares end at 10^9 + 1, so squares fit 64 bits."""
    return F.call_function("div", (p - q) * (p - q), q)


def audit(docs: DataFrame, settings: AuditSettings = AuditSettings()) -> DataFrame:
    """``lang, source, part, item, value, rank`` of every source of every language.

    Null text, lang and source are empty strings; a document without terms still makes its
    (lang, source) group. Repeated rows count each. A language without kept terms has
    pairs of value 0 and no terms; a language of one source has no pairs. An empty table
    gives an empty table. Other columns than text, lang and source are not read.
    """
    spark = docs.sparkSession
    docs = columns(docs, "lang", "source", "text").select(
        *(F.coalesce(F.col(c), F.lit("")).alias(c) for c in ("lang", "source")), F.coalesce(F.col("text").cast("binary"), F.lit(b"")).alias("text")
    )
    counts = written(term_counts(docs, settings), "audit-counts")
    of_lang = counts.groupBy("lang", "term").agg(F.sum("n").alias("lang_n"), F.sum("documents").alias("documents"))
    terms = written(of_lang.where(F.col("documents") >= settings.least_documents).drop("documents"), "audit-terms")
    held = written(counts.drop("documents").join(terms, ["lang", "term"]), "audit-held")

    langs = terms.groupBy("lang").agg(F.count("*").alias("terms"), F.sum("lang_n").alias("lang_total"))
    groups = docs.select("lang", "source").distinct()
    groups = groups.join(held.groupBy("lang", "source").agg(F.sum("n").alias("total")), ["lang", "source"], "left").join(langs, "lang", "left")
    groups = groups.select("lang", "source", *(F.coalesce(F.col(c), F.lit(0)).alias(c) for c in ("total", "terms", "lang_total")))
    number = lambda n, total: share(F.col(n) if isinstance(n, str) else F.lit(n), F.col(total), F.col("terms"), settings.scale)
    groups = groups.withColumn("none", F.when(F.col("terms") > 0, number(0, "total")))
    groups = written(groups.withColumn("id", F.monotonically_increasing_id()), "audit-groups")
    sized = groups.where("terms > 0")
    held = held.join(sized, ["lang", "source"])
    shares = written(held.select("id", "lang", "source", "term", "n", "none", number("n", "total").alias("p"), number("lang_n", "lang_total").alias("q")), "audit-shares")

    above = shares.where("p > q").select("lang", "source", F.col("term").alias("item"), excess(F.col("p"), F.col("q")).alias("value"))
    by_value = Window.partitionBy("lang", "source").orderBy(F.desc("value"), "item")
    above = above.withColumn("rank", F.row_number().over(by_value)).where(F.col("rank") <= settings.ranks)

    pairs = pair_values(groups, shares, settings).withColumn("rank", F.row_number().over(by_value))
    return pairs.select("lang", "source", F.lit("pair").alias("part"), "item", "value", "rank").unionAll(
        above.select("lang", "source", F.lit("term").alias("part"), "item", "value", "rank")
    )


def pair_values(groups: DataFrame, shares: DataFrame, settings: AuditSettings) -> DataFrame:
    """``lang, source, item, value`` of every ordered pair of sources of a language.

    ``value`` is the number of kept terms times the amount of a term that neither holds,
    corrected by count for the terms that each holds, and term by term for those of both.
    """
    salts = F.explode(F.sequence(F.lit(0), F.lit(settings.salts - 1)))
    one = groups.select("lang", F.col("id").alias("a"), F.col("none").alias("p0"), "terms", F.pmod(F.xxhash64("source"), F.lit(settings.salts)).cast("int").alias("salt"))
    other = groups.select("lang", F.col("id").alias("b"), F.col("none").alias("q0"), salts.alias("salt"))
    pair = one.join(other, ["lang", "salt"]).where("a <> b")
    neither = excess(F.col("p0"), F.col("q0"))
    base = pair.select("a", "b", F.when(F.col("terms") > 0, neither * F.col("terms")).otherwise(F.lit(0).cast("long")).alias("value"))

    spread = shares.groupBy("lang", "id", "p").agg(F.count("*").alias("of"), F.first("none").alias("none"))
    spread = spread.withColumn("salt", F.pmod(F.xxhash64("id", "p"), F.lit(settings.salts)).cast("int"))
    met = spread.join(other, ["lang", "salt"]).where("id <> b")
    own = met.select(F.col("id").alias("a"), "b", (F.col("of") * (excess(F.col("p"), F.col("q0")) - excess(F.col("none"), F.col("q0")))).alias("value"))
    theirs = met.select(F.col("b").alias("a"), F.col("id").alias("b"), (F.col("of") * (excess(F.col("q0"), F.col("p")) - excess(F.col("q0"), F.col("none")))).alias("value"))

    left = shares.select("lang", "term", F.col("id").alias("a"), F.col("p").alias("p"), F.col("none").alias("p0"))
    right = shares.select("lang", "term", F.col("id").alias("b"), F.col("p").alias("q"), F.col("none").alias("q0"))
    corrected = lambda p, q, p0, q0: excess(p, q) - excess(p, q0) - excess(p0, q) + excess(p0, q0)
    p, q, p0, q0 = (F.col(c) for c in ("p", "q", "p0", "q0"))
    both = left.join(right, ["lang", "term"]).where("a < b").groupBy("a", "b").agg(F.sum(corrected(p, q, p0, q0)).alias("there"), F.sum(corrected(q, p, q0, p0)).alias("back"))
    both = both.select(F.explode(F.array(F.struct("a", "b", F.col("there").alias("value")), F.struct(F.col("b").alias("a"), F.col("a").alias("b"), F.col("back").alias("value")))).alias("x")).select("x.*")

    total = base.unionAll(own).unionAll(theirs).unionAll(both).groupBy("a", "b").agg(F.sum("value").alias("value"))
    named = total.join(groups.select(F.col("id").alias("a"), "lang", "source"), "a")
    return named.join(groups.select(F.col("id").alias("b"), F.col("source").alias("item")), "b").select("lang", "source", "item", "value")
