"""Personal data in texts, and terms that give protected entities away.

Addresses and numbers are found by patterns. A term then counts as revealing when the
corpus shows that knowing it tells most of what there is to know about an entity: its
disclosure is the pointwise mutual information of term and entity, estimated from the
documents that hold both, as a share of the entity's own information. Terms are all words
and numbers of whole texts. Those above a threshold are removed, those above a lower one
generalised, wherever they stand in a document that holds the entity.

Everything is built from DataFrame and SQL functions.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import columns, written

#: Kinds in their order, with a cheap test and the pattern. Quantifiers are possessive so
#: that long texts need no backtracking; the card pattern starts at 16 digits, since matches
#: are maximal and shorter ones are dropped anyway.
PATTERNS = {
    "email": (r"@", r"[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++"),
    "ip": (r"[0-9]\.[0-9]", r"[0-9]++(?:\.[0-9]++){3}"),
    "card": (r"[0-9](?:[\x20-]?[0-9]){15}", r"[0-9](?:[\x20-]?[0-9]){15,}+"),
    "phone": (r"\+[0-9]", r"\+[0-9][\x20().0-9-]+[0-9]"),
}
IP = r"^0*(?:[0-9]{1,2}|1[0-9]{2}|2[0-4][0-9]|25[0-5])(?:\.0*(?:[0-9]{1,2}|1[0-9]{2}|2[0-4][0-9]|25[0-5])){3}$"
SPAN = "array<struct<start:int,end:int,value:string>>"
#: A term is a maximal run of letters, marks and digits.
TERM = r"[\p{L}\p{M}\p{N}]"


@dataclass(frozen=True)
class DisclosureRules:
    #: Documents that must hold both term and entity before an estimate counts.
    support: int = 2
    remove: float = 0.8
    generalise: float = 0.5
    #: Entities, candidate terms and told terms are sent to all executors up to this number, else joined by shuffle.
    broadcast_terms: int = 50_000


def spans(text: str, pattern: str, offset: str = "0") -> str:
    """SQL of all matches in order with their code points; offset is added to both ends."""
    quoted = pattern.replace("\\", "\\\\").replace("'", "\\'")
    return (
        f"aggregate(arrays_zip(split({text}, '{quoted}', -1), regexp_extract_all({text}, '{quoted}', 0)), "
        f"named_struct('at', cast({offset} as int), 'found', cast(array() as {SPAN})), "
        "(a, x) -> named_struct('at', a.at + length(x['0']) + coalesce(length(x['1']), 0), 'found', if(x['1'] is null, a.found, "
        "concat(a.found, array(named_struct('start', a.at + length(x['0']), 'end', a.at + length(x['0']) + length(x['1']), 'value', x['1']))))), "
        "a -> a.found)"
    )


def _valid(kind: str, found: str) -> str:
    digits = "regexp_replace(x.value, '[^0-9]', '')"
    luhn = (
        "aggregate(sequence(1, length({d})), 0, (s, i) -> s + if(i % 2 = 1, cast(substr({d}, -i, 1) as int), "
        "2 * cast(substr({d}, -i, 1) as int) - if(cast(substr({d}, -i, 1) as int) > 4, 9, 0))) % 10 = 0"
    )
    tests = {
        "email": "true",
        "ip": f"x.value rlike r'{IP}'",
        "card": f"length({digits}) between 16 and 19 and {luhn.format(d=digits)}",
        "phone": f"length({digits}) between 8 and 15",
    }
    return f"filter({found}, x -> {tests[kind]})"


def base_spans(docs: DataFrame) -> DataFrame:
    """``doc_id, th, email, ip, card, phone, entities, text``: spans by kind, and distinct entities.

    ``th`` is a hash of the text, so that rows with equal doc_id don't mix. A null text is
    empty; texts without entities are null, for no term of theirs is looked for.
    """
    out = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64("text").alias("th"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    for kind, (test, pattern) in PATTERNS.items():
        found = F.expr(_valid(kind, spans("text", pattern)))
        out = out.withColumn(kind, F.when(F.col("text").rlike(test), found).otherwise(F.expr(f"cast(array() as {SPAN})")))
    entity = {"email": "lower(x.value)", "ip": "x.value", "card": "regexp_replace(x.value, '[^0-9]', '')", "phone": "regexp_replace(x.value, '[^0-9]', '')"}
    named = [f"transform({kind}, x -> concat('{kind}:', {entity[kind]}))" for kind in PATTERNS]
    out = out.withColumn("entities", F.expr(f"array_distinct(concat({', '.join(named)}))"))
    return out.withColumn("text", F.when(F.size("entities") > 0, F.col("text")))


def told_spans(text: str, told: str) -> str:
    """SQL of all places of the terms in the map ``told``, in order: ``start, end, removed``."""
    quoted = f"{TERM}++".replace("\\", "\\\\")
    empty = "cast(array() as array<struct<start:int,end:int,removed:boolean>>)"
    return (
        f"aggregate(arrays_zip(split({text}, '{quoted}', -1), regexp_extract_all({text}, '{quoted}', 0)), named_struct('at', 0, 'found', {empty}), "
        f"(a, x) -> named_struct('at', a.at + length(x['0']) + coalesce(length(x['1']), 0), 'found', if(x['1'] is null or {told}[lower(x['1'])] is null, a.found, "
        f"concat(a.found, array(named_struct('start', a.at + length(x['0']), 'end', a.at + length(x['0']) + length(x['1']), 'removed', {told}[lower(x['1'])]))))), "
        "a -> a.found)"
    )


def terms_of(text: str) -> Column:
    """The distinct terms of a text, in lower case."""
    return F.array_distinct(F.transform(F.filter(F.split(text, TERM.replace("[", "[^", 1) + "+"), lambda x: x != ""), F.lower))


def sent(rows: DataFrame, rules: DisclosureRules) -> DataFrame:
    return F.broadcast(rows) if rows.count() <= rules.broadcast_terms else rows


def disclosures(docs: DataFrame, base: DataFrame, rules: DisclosureRules) -> tuple[DataFrame, DataFrame]:
    """``entity, term, disclosure`` of terms at or above the lower threshold, from counts over all documents.

    Also ``doc_id, th, entity, term`` of every term of the documents that hold an entity
    which could have such terms.
    """
    total = base.count()
    holders = base.where(F.size("entities") > 0).select("doc_id", "th", F.explode("entities").alias("entity"), "text")
    # An entity of fewer documents has no term with enough support.
    entities = holders.groupBy("entity").agg(F.count("*").alias("n_entity")).where(F.col("n_entity") >= rules.support)
    entities = sent(written(entities, "pii-entities"), rules)
    held = holders.join(entities.select("entity"), "entity").select("doc_id", "th", "entity", F.explode(terms_of("text")).alias("term"))
    pairs = held.groupBy("entity", "term").agg(F.count("*").alias("n_both"))
    pairs = written(pairs.where(F.col("n_both") >= rules.support), "pii-pairs")
    counts = docs.select(F.explode(terms_of("text")).alias("term"))
    terms = pairs.select("term").distinct()
    # Too many terms to send: all are counted, since a shuffle of counts by task is less than one of all words.
    if terms.count() <= rules.broadcast_terms:
        counts = counts.join(F.broadcast(terms), "term", "left_semi")
    counts = counts.groupBy("term").agg(F.count("*").alias("n_term"))
    known = pairs.join(entities, "entity").join(counts, "term")
    n = F.lit(float(max(total, 1)))
    # Twice the support in the smallest corpus keeps an entity's information above zero.
    own = F.greatest(F.log2(n / F.col("n_entity")), F.lit(1e-9))
    shared = F.log2(F.col("n_both") * n / (F.col("n_term") * F.col("n_entity")))
    told = known.select("entity", "term", (shared / own).alias("disclosure")).where(F.col("disclosure") >= rules.generalise)
    return sent(written(told, "pii-told"), rules), held


def find(docs: DataFrame, rules: DisclosureRules = DisclosureRules(), doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """Spans of every row: ``doc_id, th, email, ip, card, phone`` (arrays of start, end, value) and ``terms`` (start, end, removed).

    Null and empty texts have no spans. Repeated rows have equal spans and count as
    documents each. A null doc_id is an id like others. Other columns are not read. Very
    long texts are searched whole.
    """
    docs = columns(docs, doc_id, text).toDF("doc_id", "text")
    base = written(base_spans(docs), "pii-spans")
    told, held = disclosures(docs, base, rules)
    terms = held.join(told, ["entity", "term"]).groupBy("doc_id", "th", "term").agg(F.max("disclosure").alias("d"))
    terms = terms.groupBy("doc_id", "th").agg(F.map_from_entries(F.collect_list(F.struct("term", (F.col("d") >= rules.remove).alias("removed")))).alias("told"))
    terms = terms.select(F.col("doc_id").alias("__d"), F.col("th").alias("__t"), "told")
    joined = base.drop("entities").join(terms, F.col("doc_id").eqNullSafe(F.col("__d")) & (F.col("th") == F.col("__t")), "left").drop("__d", "__t")
    joined = joined.withColumn("terms", F.when(F.col("told").isNotNull(), F.expr(told_spans("text", "told")))).drop("text", "told")
    empty = F.expr("cast(array() as array<struct<start:int,end:int,removed:boolean>>)")
    # A term inside an address or number goes with it.
    whole = F.expr("filter(coalesce(terms, none), t -> not exists(concat(email, ip, card, phone), x -> x.start < t.end and t.start < x.end))")
    return joined.withColumn("none", empty).withColumn("terms", whole).drop("none")


def joined_spans(kinds: list[str]) -> Column:
    """``kind:start:end`` of the kinds in their order, then by start, comma-joined."""
    parts = [f"transform({column}, x -> concat('{name}:', x.start, ':', x.end))" for column, name in ((k, k.removesuffix("s") if k == "terms" else k) for k in kinds)]
    return F.array_join(F.expr(f"concat({', '.join(parts)})"), ",")


def sanitise(docs: DataFrame, rules: DisclosureRules = DisclosureRules(), doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """``doc_id, text``: texts with entities and generalised terms as their kind in brackets, and removed terms gone."""
    docs = columns(docs, doc_id, text).toDF("doc_id", "text")
    found = find(docs, rules).select(F.col("doc_id").alias("__d"), F.col("th").alias("__t"), *PATTERNS, "terms").dropDuplicates(["__d", "__t"])
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text", F.xxhash64("text").alias("th")).join(found, F.col("doc_id").eqNullSafe(F.col("__d")) & (F.col("th") == F.col("__t")), "left")
    cuts = [f"transform({k}, x -> named_struct('start', x.start, 'end', x.end, 'put', '[{k.upper()}]'))" for k in PATTERNS]
    cuts.append("transform(terms, x -> named_struct('start', x.start, 'end', x.end, 'put', if(x.removed, '', '[TERM]')))")
    rows = rows.withColumn("cuts", F.expr(f"array_sort(concat({', '.join(cuts)}))"))
    done = (
        "aggregate(cuts, named_struct('at', 0, 'out', ''), (a, x) -> if(x.start < a.at, a, named_struct('at', x.end, 'out', concat(a.out, substr(text, a.at + 1, x.start - a.at), x.put))), "
        "a -> concat(a.out, substr(text, a.at + 1)))"
    )
    return rows.select("doc_id", F.when(F.size("cuts") > 0, F.expr(done)).otherwise(F.col("text")).alias("text"))
