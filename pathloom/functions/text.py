"""Scalar text functions: names, guards, citations and JSON salvage."""

from __future__ import annotations

import csv
import html
import io
import json
import re

from pyspark.sql import Column
from pyspark.sql import functions as F


def safe_name(name: Column, strip_json: bool = True) -> Column:
    """Characters other than (Unicode) word characters, '.' and '-' become '_'; a '.json' ending, in any
    case, goes first."""
    base = F.regexp_replace(name, r"(?i)\.json$", "") if strip_json else name
    return F.regexp_replace(base, r"(?U)[^\w.-]", "_")


def base_name(path: Column) -> Column:
    return F.element_at(F.split(path, "/"), -1)


def stem(path: Column) -> Column:
    return F.regexp_replace(base_name(path), r"(?<=.)\.[^.]*$", "")


def suffix(path: Column) -> Column:
    """The ending from the last dot on, which the stem leaves out; empty if there is none."""
    return F.regexp_extract(base_name(path), r"(?<=.)(\.[^.]*)$", 1)


def formula_guard(value: Column) -> Column:
    """A quote before text that a spreadsheet would take for a formula."""
    return F.when(value.rlike(r"^[=+\-@]"), F.concat(F.lit("'"), value)).otherwise(value)


def ngram_text(ngram: Column) -> Column:
    return F.array_join(ngram, " ")


def ngram_items(text: Column) -> Column:
    """Items of a space-joined n-gram; runs of white space count once."""
    trimmed = F.regexp_replace(text, r"^\s+|\s+$", "")
    return F.when(trimmed == "", F.array().cast("array<string>")).otherwise(F.split(trimmed, r"\s+"))


def cited_tokens(text: Column) -> Column:
    """Decompiler-style function tokens (FUN_ and four or more hex digits), distinct and sorted."""
    return F.array_sort(F.array_distinct(F.regexp_extract_all(text, F.lit(r"\bFUN_[0-9a-fA-F]{4,}\b"), F.lit(0))))


def cited_names(text: Column, known: Column, explicit: Column | None = None) -> Column:
    """Those of the known names that stand in text as whole words, and the cited tokens; sorted. A list of explicitly cited names, where
    there is one, is the answer instead."""
    literal = lambda name: F.replace(name, F.lit(r"\E"), F.lit(r"\E\\E\Q"))
    quoted = lambda name: F.concat(F.lit(r"(?U)(?<!\w)\Q"), literal(name), F.lit(r"\E(?!\w)"))
    found = F.filter(known, lambda name: (F.length(name) > 0) & F.regexp_like(text, quoted(name)))
    named = F.array_sort(F.array_distinct(F.concat(found, cited_tokens(text))))
    if explicit is None:
        return named
    return F.coalesce(F.array_sort(F.array_distinct(F.filter(explicit, lambda x: F.length(x) > 0))), named)


def redacted(text: Column, secret: str) -> Column:
    return F.replace(text, F.lit(secret), F.lit("[REDACTED]")) if secret else text


def finite(value: Column) -> Column:
    return value.isNotNull() & ~F.isnan(value) & (F.abs(value) < F.lit(float("inf")))


def direction(contribution: Column) -> Column:
    """Zero counts as benign."""
    return F.when(contribution > 0, "toward cryptojacking").otherwise("toward benign")


def valid_json(text: Column) -> Column:
    """text if it is one JSON object without repeated keys, else null."""
    clean = F.regexp_replace(text, r"^[\x{FEFF}\s]+|\s+$", "")
    return F.when(F.try_parse_json(clean).isNotNull() & clean.rlike(r"(?s)^\s*\{"), clean)


def salvaged_json(raw: Column) -> Column:
    """The JSON object in a model's answer: the answer itself, or without its reasoning block, or in a code
    fence, or between the outermost braces; the reasoning block is searched last. Null if there is none."""
    clean = F.regexp_replace(raw, r"^\s+|\s+$", "")
    spoken = F.regexp_replace(F.regexp_replace(clean, r"(?s)<think>.*?</think>", ""), r"^\s+|\s+$", "")

    def inside(text: Column) -> list[Column]:
        fence = F.regexp_extract(text, r"(?s)```(?:json)?\s*(.*?)```", 1)
        braces = F.regexp_extract(text, r"(?s)\{.*\}", 0)
        return [valid_json(fence), valid_json(braces)]

    return F.coalesce(valid_json(clean), valid_json(spoken), *inside(spoken), *inside(clean))


# What a missing key of an analysis stands for, and the tiers that exist.
TIERS = ("high-confidence", "low-confidence", "benign")
ANALYSIS = "tier string, explanation string, evidence_analysis array<struct<ngram: string, shap_contribution: double, assessment: string>>, confidence_score double, key_indicators array<string>, recommended_action string"


def completed_analysis(salvaged: Column) -> Column:
    """A struct of ANALYSIS with every missing field filled; an unknown tier is benign."""
    a = F.from_json(salvaged, ANALYSIS)
    return F.struct(
        F.when(a["tier"].isin(*TIERS), a["tier"]).otherwise("benign").alias("tier"),
        F.coalesce(a["explanation"], F.lit("")).alias("explanation"),
        F.coalesce(a["evidence_analysis"], F.from_json(F.lit("[]"), "array<struct<ngram: string, shap_contribution: double, assessment: string>>")).alias("evidence_analysis"),
        F.coalesce(a["confidence_score"], F.lit(0.0)).alias("confidence_score"),
        F.coalesce(a["key_indicators"], F.array().cast("array<string>")).alias("key_indicators"),
        F.coalesce(a["recommended_action"], F.lit("Manual review required")).alias("recommended_action"),
    )


def json_pointer(document: str | None, path: str | None) -> str | None:
    """What an RFC 6901 pointer finds in a JSON text, as JSON; strings come bare. Null if it finds nothing."""
    try:
        value = json.loads(document)
        if not path.startswith("/"):
            return None
        for token in path[1:].split("/"):
            token = token.replace("~1", "/").replace("~0", "~")
            value = value[int(token)] if isinstance(value, list) else value[token]
    except (ValueError, KeyError, IndexError, TypeError, AttributeError):
        return None
    return value if isinstance(value, str) else json.dumps(value, ensure_ascii=False)


def display(value: object) -> str:
    """How a report shows a value."""
    if value is None:
        return "N/A"
    return f"{value:.4f}" if isinstance(value, float) else str(value)


def markdown_table(columns: list[str], rows: list[dict]) -> str:
    lines = ["| " + " | ".join(columns) + " |", "| " + " | ".join("---" for _ in columns) + " |"]
    return "\n".join(lines + ["| " + " | ".join(display(r.get(c)) for c in columns) + " |" for r in rows])


def file_name(name: str) -> str:
    return re.sub(r"[^\w.-]", "_", name)


def csv_table(columns: list[str], rows: list[dict]) -> str:
    """With a byte order mark and the formula guard."""
    out = io.StringIO()
    writer = csv.writer(out, lineterminator="\n")
    writer.writerow(columns)
    for r in rows:
        values = ["" if r.get(c) is None else r[c] for c in columns]
        writer.writerow(["'" + v if isinstance(v, str) and v[:1] in tuple("=+-@") else v for v in values])
    return "\ufeff" + out.getvalue()


def html_table(columns: list[str], rows: list[dict]) -> str:
    cells = lambda tag, values: "<tr>" + "".join(f"<{tag}>{html.escape(v)}</{tag}>" for v in values) + "</tr>"
    body = "".join(cells("td", [display(r.get(c)) for c in columns]) for r in rows)
    return f"<table><thead>{cells('th', columns)}</thead><tbody>{body}</tbody></table>"


def duration(seconds: float) -> str:
    """From an hour on hours and minutes, from a minute on minutes and seconds, else seconds; negative ones count as none."""
    hours, within = divmod(max(0, int(seconds)), 3600)
    minutes, rest = divmod(within, 60)
    larger, smaller, units = (hours, minutes, "hm") if hours else (minutes, rest, "ms")
    return f"{larger}{units[0]} {smaller:02d}{units[1]}" if larger else f"{rest}s"


