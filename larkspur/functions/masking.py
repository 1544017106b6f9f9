"""Column functions that mask: spans by entity, rule patterns, and lists of spans."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..schema import LAST_FOUR, SPAN

MARK = "•"
#: Letters and decimal digits of the basic plane: what a mask hides (fixed value).
ALNUM = r"[\p{L}\p{Nd}&&[\x{0}-\x{FFFF}]]"
#: Rule patterns (fixed values).
SSN = r"\b\d{3}-\d{2}-(\d{4})\b"
EMAIL = r"\b[a-zA-Z0-9._%+-]+@[a-zA-Z0-9.-]+\.[a-zA-Z]{2,}\b"
#: Everything before the fourth-last digit, and the rest.
TAIL = r"(?s)^(.*)(\p{Nd}(?:\P{Nd}*\p{Nd}){3}\P{Nd}*)$"


def entity_of(label: Column) -> Column:
    return F.regexp_replace(label, "^[BI]-", "")


def mask_all(text: Column) -> Column:
    """Every letter and digit hidden, all else as it is; the length stays."""
    return F.regexp_replace(text, ALNUM, MARK)


def mask_span(text: Column, label: Column, show: Column) -> Column:
    """mask_all, but for entities with a last-four rule, where shown and where there are four digits, up to those."""
    eligible = show & F.upper(entity_of(label)).isin(LAST_FOUR) & text.rlike(TAIL)
    return F.when(eligible, F.concat(mask_all(F.regexp_extract(text, TAIL, 1)), F.regexp_extract(text, TAIL, 2))).otherwise(mask_all(text))


def mask_ssn(text: Column) -> Column:
    """Dashed numbers, the last four digits shown."""
    return F.regexp_replace(text, SSN, f"{MARK * 3}-{MARK * 2}-$1")


def mask_email(text: Column) -> Column:
    """Mail addresses, fully. Texts without @ skip the splitting."""
    between = F.split(text, EMAIL, -1)
    hidden = F.concat(F.transform(F.regexp_extract_all(text, F.lit(EMAIL), 0), mask_all), F.array(F.lit("")))
    return F.when(F.contains(text, F.lit("@")), F.array_join(F.zip_with(between, hidden, lambda a, b: F.concat(a, b)), "")).otherwise(text)


def mask_fallback(text: Column) -> Column:
    """Both rule patterns; lengths stay, so offsets of model spans stay valid."""
    return mask_email(mask_ssn(text))


def valid_spans(spans: Column, text: Column) -> Column:
    return F.filter(spans, lambda s: (s["start"] >= 0) & (s["end"] > s["start"]) & (s["end"] <= F.length(text)))


def apply_spans(text: Column, spans: Column, show: Column) -> Column:
    """The text with each valid span masked by its entity."""

    def put(acc: Column, s: Column) -> Column:
        size = s["end"] - s["start"]
        return F.overlay(acc, mask_span(F.substr(acc, s["start"] + 1, size), s["entity"], show), s["start"] + 1, size)

    return F.aggregate(valid_spans(spans, text), text, put)


def entity_types(spans: Column) -> Column:
    return F.array_sort(F.array_distinct(F.transform(spans, lambda s: s["entity"])))


def no_spans() -> Column:
    return F.array().cast(f"array<{SPAN.simpleString()}>")
