"""Text expressions: tokens, HTML fields, pattern scans, template filling."""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import Column, functions as F

from attestra import fixed_values as fixed


def tokens(text: Column) -> Column:
    """Sorted distinct lower-case alphanumeric tokens (term frequency is always one)."""
    runs = F.split(F.lower(text), fixed.TOKEN_SEPARATOR)
    return F.sort_array(F.array_remove(F.array_distinct(runs), ""))


def html_text(html: Column) -> Column:
    """Tags replaced by a blank, then runs of white space collapsed."""
    return F.regexp_replace(F.regexp_replace(html, r"<[^>]+>", " "), r"\s+", " ")


def contains_any(text: Column, needles: tuple[str, ...]) -> Column:
    hit = F.lit(False)
    for needle in needles:
        hit = hit | text.contains(needle)
    return hit


def first_match(text: Column, pattern: str) -> Column:
    """The first match of a pattern, or NULL when there is none."""
    return F.nullif(F.regexp_extract(text, f"({pattern})", 1), F.lit(""))


def forbidden_language(text: Column) -> Column:
    return text.rlike(fixed.FORBIDDEN_CLAIM_LANGUAGE)


def safe_identifier(value: Column) -> Column:
    return F.coalesce(value.rlike(fixed.IDENTIFIER_PATTERN), F.lit(False))


def secret_findings(text: Column, patterns=fixed.SECRET_PATTERNS) -> Column:
    """Names of the secret patterns that occur in a text, in pattern order."""
    return F.array_compact(F.array(*[F.when(text.rlike(p), F.lit(name)) for name, p in patterns]))


def fill_template(template: Column, parameters: Mapping[str, Column]) -> Column:
    """Replace every ``{name}`` by its parameter; NULL if any parameter is NULL."""
    out = template
    for name, value in parameters.items():
        out = F.replace(out, F.lit("{" + name + "}"), value.cast("string"))
    return out
