"""Structured parts of model answers: code, lists, JSON and repetition."""

from __future__ import annotations

import difflib
import json

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

FENCE = r"(?s)```([A-Za-z0-9_+-]*)[ \t]*\r?\n(.*?)```"


def extract_code_block(text: Column, languages: list[str], fallback: str = "none") -> Column:
    """The first non-empty fenced block of an accepted language.

    Without one: ``none`` gives null, ``raw`` the trimmed text, ``no_fence`` the trimmed
    text only if it has no fence at all.
    """
    tags = F.transform(F.regexp_extract_all(text, F.lit(FENCE), F.lit(1)), F.lower)
    bodies = F.transform(F.regexp_extract_all(text, F.lit(FENCE), F.lit(2)), lambda b: F.regexp_replace(b, r"^\s+|\s+$", ""))
    accepted = F.filter(F.arrays_zip(tags.alias("tag"), bodies.alias("body")), lambda x: x["tag"].isin([x.lower() for x in languages]) & (x["body"] != ""))
    found = F.get(accepted, F.lit(0))["body"]
    trimmed = F.regexp_replace(text, r"^\s+|\s+$", "")
    if fallback == "raw":
        return F.coalesce(found, trimmed)
    if fallback == "no_fence":
        return F.coalesce(found, F.when(~F.contains(text, F.lit("```")), trimmed))
    return found


def markdown_items(text: Column) -> Column:
    """Texts of bulleted and numbered list items."""
    return F.transform(F.regexp_extract_all(text, F.lit(r"(?m)^[ \t]*(?:[-*+]|[0-9]+[.)])[ \t]+(.+?)[ \t]*$"), F.lit(1)), lambda x: x)


def keyed_list(text: Column, key: str) -> Column:
    """The array of strings under a key of a JSON object, null if there is none."""
    return F.from_json(F.get_json_object(text, f"$.{key}"), "array<string>")


@F.pandas_udf(StringType())
def first_balanced_object(texts: pd.Series) -> pd.Series:
    """The first ``{...}`` with balanced braces outside of strings that parses as JSON."""

    def scan(text: str | None) -> str | None:
        start = (text or "").find("{")
        while start >= 0:
            depth, quoted, escaped = 0, False, False
            for k in range(start, len(text)):
                c = text[k]
                if escaped:
                    escaped = False
                elif quoted:
                    escaped, quoted = c == "\\", c != '"'
                elif c == '"':
                    quoted = True
                elif c in "{}":
                    depth += 1 if c == "{" else -1
                    if not depth:
                        try:
                            json.loads(text[start : k + 1])
                        except ValueError:
                            break
                        return text[start : k + 1]
            start = text.find("{", start + 1)
        return None

    return pd.Series([scan(t) for t in texts], dtype=object)


def first_json_object(text: Column) -> Column:
    """The whole text if it is a JSON object, else the stretch from the first to the last brace if that is one; else null."""
    whole = F.trim(text)
    inner = F.regexp_extract(text, r"(?s)(\{.*\})", 1)
    valid = lambda c: c.startswith("{") & F.get_json_object(c, "$").isNotNull()
    return F.when(valid(whole), whole).when(valid(inner), inner)


def paragraphs(text: Column, least: int = 100) -> Column:
    """Paragraphs of at least so many characters; a fenced block is one paragraph, blank lines in it included."""
    marked = F.regexp_replace(text, r"(?s)(```.*?```)", "\n\n$1\n\n")
    parts = F.regexp_extract_all(marked, F.lit(r"(?s)(```.*?```|(?:(?!\n[ \t]*\n|```).)+)"), F.lit(1))
    return F.filter(F.transform(parts, lambda p: F.regexp_replace(p, r"^\s+|\s+$", "")), lambda p: F.length(p) >= least)


def exact_repetition(text: Column, run: int = 3, least: int = 100) -> Column:
    """Place of the first paragraph that begins a run of equal neighbours, null if there is none."""
    parts = paragraphs(text, least)
    starts = F.filter(F.sequence(F.lit(0), F.greatest(F.size(parts) - run, F.lit(0))), lambda k: (k + run <= F.size(parts)) & F.forall(F.slice(parts, k + 1, F.lit(run)), lambda p: p == F.get(parts, k)))
    return F.get(starts, F.lit(0))


def detect_repetition(text: Column, run: int = 3, window: int = 5, ratio: float = 0.95, least: int = 100) -> Column:
    """``start, kind, preview`` of the first repetition: a run of near-equal neighbours, else a paragraph that ``run - 1`` of the ``window`` before it (at least ``run``) are near to; ``start`` is the first of them."""

    @F.pandas_udf("start int, kind string, preview string")
    def scan(lists: pd.Series) -> pd.DataFrame:
        def near(a: str, b: str) -> bool:
            if a == b:
                return True
            if 2 * min(len(a), len(b)) < ratio * (len(a) + len(b)):
                return False
            m = difflib.SequenceMatcher(None, a, b, autojunk=False)
            return m.quick_ratio() >= ratio and m.ratio() >= ratio

        rows = []
        for parts in lists:
            parts = [] if parts is None else list(parts)
            found = next(((k, "adjacent") for k in range(len(parts) - run + 1) if all(near(parts[j], parts[j + 1]) for j in range(k, k + run - 1))), None)
            back = max(window, run)
            alike = (([j for j in range(max(0, k - back), k) if near(parts[j], parts[k])][: run - 1], k) for k in range(len(parts)))
            found = found or next(((min([*near_ones, k]), "window") for near_ones, k in alike if len(near_ones) >= run - 1), None)
            rows.append((found[0], found[1], parts[found[0]][:80]) if found else (None, None, None))
        return pd.DataFrame(rows, columns=["start", "kind", "preview"]).astype({"start": "Int32"})

    return scan(paragraphs(text, least))
