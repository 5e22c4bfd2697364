"""Quality rules judged by document and by host.

A document has rule failures of its own. Failures are also added up by host (the
``source`` of a document); a host's failure rate is shrunk towards all hosts by a beta
prior fitted to them, so that a host with few documents is not condemned by chance. A
host whose shrunken rate is above a limit gets a bad verdict, which is joined back to its
documents: there, documents that fail any soft rule are rejected too. Documents without a
failure are kept at any host.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import columns, map_batches, texts, unused, written

SYMBOLS = b"#*$%&|<>"
STATS = "doc_id long, host string, n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, n_lines long"


@dataclass(frozen=True)
class HostRules:
    """Limits of the base rules, of the soft rules and of a host's shrunken failure rate."""

    min_words: int = 10
    max_repeat_percent: int = 20
    window: int = 5
    soft_symbols_per_word: float = 0.1
    soft_dup_lines: float = 0.3
    soft_repeat_words: float = 0.1
    soft_word_length: tuple[float, float] = (2.5, 12.0)
    host_rate: float = 0.5
    #: Host verdicts are sent to all executors up to so many hosts, else joined by shuffle.
    broadcast_hosts: int = 20_000


def repeated_words(words: list[bytes], window: int) -> int:
    """Words inside windows of ``window`` words that stand twice or more in the text.

    Windows get exact numbers by pairing: numbers of windows of size k and of single words
    give numbers of windows of size k + 1, without hash collisions.
    """
    if len(words) <= window:
        return 0
    known: dict[bytes, int] = {}
    word = np.fromiter((known.setdefault(w, len(known)) for w in words), np.int64, len(words))
    if len(known) == len(words):
        return 0
    number = word
    for size in range(2, window + 1):
        pair = number[: len(words) - size + 1] * len(known) + word[size - 1 :]
        distinct, number, count = np.unique(pair, return_inverse=True, return_counts=True)
        if len(distinct) == len(pair):
            return 0
    starts = np.flatnonzero(count[number] > 1)
    step = np.zeros(len(words) + 1, np.int64)
    np.add.at(step, starts, 1)
    np.add.at(step, starts + window, -1)
    return int((np.cumsum(step)[:-1] > 0).sum())


def document_stats(docs: DataFrame, text: str = "text", doc_id: str = "doc_id", host: str = "source", window: int = 5) -> DataFrame:
    """Counts of each whole text. A null text has no words; repeated rows stay repeated."""

    def stats(batch: pa.RecordBatch) -> pa.RecordBatch:
        rows = []
        for value in texts(batch.column(2)):
            data = value.encode()
            words = data.split()
            joined = b"".join(words)
            lines = data.split(b"\n")
            full = [x for x in lines if x.strip()]
            rows.append(
                (
                    len(words),
                    len(joined.decode()),
                    len(joined) - len(joined.translate(None, SYMBOLS)),
                    len(full) - len(set(full)),
                    repeated_words(words, window),
                    len(full),
                )
            )
        counts = np.array(rows, np.int64).reshape(-1, 6)
        return pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), *(pa.array(c) for c in counts.T)], names=[x.split()[0] for x in STATS.split(", ")])

    taken = docs.select(F.col(f"`{doc_id}`").cast("long").alias("doc_id"), F.col(f"`{host}`").cast("string").alias("host"), F.col(f"`{text}`").alias("text"))
    return map_batches(taken, stats, STATS)


def flagged(stats: DataFrame, rules: HostRules) -> DataFrame:
    """``base_failed`` and ``soft_failed`` of each row of counts."""
    words = F.greatest(F.col("n_words"), F.lit(1))
    low, high = rules.soft_word_length
    return stats.withColumns(
        {
            "base_failed": (F.col("n_words") < rules.min_words) | (100 * F.col("n_repeat_words") > rules.max_repeat_percent * F.col("n_words")),
            "soft_failed": (F.col("n_symbols") > rules.soft_symbols_per_word * words)
            | (F.col("n_dup_lines") > rules.soft_dup_lines * F.greatest(F.col("n_lines"), F.lit(1)))
            | (F.col("n_repeat_words") > rules.soft_repeat_words * words)
            | ~(F.col("word_chars") / words).between(low, high),
        }
    )


def host_rates(flags: DataFrame) -> DataFrame:
    """Failures of each host with their shrunken rate: ``host, docs, failures, rate``.

    The beta prior has the mean of all documents and the strength that the spread of the
    hosts' raw rates leaves after binomial noise (method of moments). Where hosts don't
    differ by more than noise, the prior outweighs every host. Null hosts are one host.
    """
    hosts = flags.groupBy("host").agg(F.count("*").alias("docs"), F.sum((F.col("base_failed") | F.col("soft_failed")).cast("long")).alias("failures"))
    hosts = written(hosts, "hosts")
    whole = hosts.agg(F.sum("docs").alias("n"), F.sum("failures").alias("f"), F.count("*").alias("k"), F.sum(F.col("docs") * F.col("docs")).alias("n2"), F.sum(F.col("failures") * F.col("failures") / F.col("docs")).alias("r2")).first()
    n, f, k = whole.n or 0, whole.f or 0, whole.k or 0
    mean = f / n if n else 0.5
    between = (whole.r2 or 0.0) - n * mean * mean
    spread = n - (whole.n2 or 0) / n if n else 0.0
    noise = mean * (1 - mean)
    share = (between - (k - 1) * noise) / (spread - (k - 1)) / noise if k > 1 and noise > 0 and spread > k - 1 else 0.0
    share = min(max(share, 1e-6), 0.999)
    strength = 1 / share - 1
    rate = (F.col("failures") + F.lit(mean * strength)) / (F.col("docs") + F.lit(strength))
    return hosts.withColumn("rate", rate)


def judge(docs: DataFrame, rules: HostRules = HostRules(), text: str = "text", doc_id: str = "doc_id", host: str = "source") -> DataFrame:
    """Counts and verdict of every row of ``docs``.

    Columns: ``doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words,
    base_failed, kept, soft_failed, host_rate, host_bad``. Nulls: a null text is empty (and
    fails), a null host is a host of its own, a null doc_id is carried through. Repeated
    rows are judged and counted each. An empty table gives an empty table. Other columns of
    ``docs`` are not read.
    """
    flags = written(flagged(document_stats(docs, text, doc_id, host, rules.window), rules), "quality-stats")
    hosts = host_rates(flags)
    verdicts = hosts.select(F.col("host").alias("verdict_host"), F.col("rate").alias("host_rate"), (F.col("rate") > rules.host_rate).alias("host_bad"))
    if hosts.count() <= rules.broadcast_hosts:
        verdicts = F.broadcast(verdicts)
    joined = flags.join(verdicts, F.col("host").eqNullSafe(F.col("verdict_host")), "left")
    kept = ~F.col("base_failed") & ~(F.col("soft_failed") & F.coalesce(F.col("host_bad"), F.lit(False)))
    return joined.withColumn("kept", kept).select(
        "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "soft_failed", "host_rate", "host_bad"
    )


def filter_documents(docs: DataFrame, rules: HostRules = HostRules(), text: str = "text", doc_id: str = "doc_id", host: str = "source") -> DataFrame:
    """The rows of ``docs`` that are kept, with all their columns.

    Texts are not shuffled where the hosts' verdicts are small: a row's own failures are
    computed beside it. Rows with equal doc_id are judged each by their own text. Nulls are
    judged as in ``judge``; other columns are carried, whatever their names.
    """
    verdict, bad_host = unused(docs, "verdict", "bad_host")
    bad = host_rates(written(flagged(document_stats(docs, text, doc_id, host, rules.window), rules), "quality-stats")).where(F.col("rate") > rules.host_rate).select(F.col("host").alias(bad_host))
    if bad.count() <= rules.broadcast_hosts:
        bad = F.broadcast(bad)
    from_text = verdict_column(text, rules)
    marked = docs.withColumn(verdict, from_text).join(bad, F.col(f"`{host}`").cast("string").eqNullSafe(F.col(bad_host)), "left")
    return marked.where((F.col(verdict) == 0) | ((F.col(verdict) == 1) & F.col(bad_host).isNull())).select(*[F.col(f"`{c}`") for c in docs.columns])


def verdict_column(text: str, rules: HostRules):
    """0 for a text without failure, 1 with soft failures only, 2 where a base rule fails."""
    low, high = rules.soft_word_length

    @F.pandas_udf("int")
    def verdict(values):
        import pandas as pd

        out = []
        for value in values:
            data = (value or "").encode()
            words = data.split()
            joined = b"".join(words)
            n, repeats = len(words), repeated_words(words, rules.window)
            full = [x for x in data.split(b"\n") if x.strip()]
            if n < rules.min_words or 100 * repeats > rules.max_repeat_percent * n:
                out.append(2)
            else:
                soft = (
                    len(joined) - len(joined.translate(None, SYMBOLS)) > rules.soft_symbols_per_word * n
                    or len(full) - len(set(full)) > rules.soft_dup_lines * max(len(full), 1)
                    or repeats > rules.soft_repeat_words * n
                    or not low <= len(joined.decode()) / n <= high
                )
                out.append(int(soft))
        return pd.Series(out, dtype="int32")

    return verdict(F.col(f"`{text}`"))
