"""Vacancy title normalisation (I21, I22, N1) as Column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from jobsift.functions.text import squeeze, strip

# A parenthesised aside, and the title part separators.
PAREN_PATTERN = r"\((.*?)\)"
SLASH_PATTERN = r"[/\\]"


def _c(c) -> Column:
    return F.col(c) if isinstance(c, str) else c


def parentheses(c) -> Column:
    """The texts inside parentheses, in order."""
    return F.regexp_extract_all(_c(c), F.lit(PAREN_PATTERN), 1)


def without_parentheses(c) -> Column:
    """Title with asides removed, whitespace squeezed and stripped."""
    return strip(squeeze(F.regexp_replace(_c(c), PAREN_PATTERN, "")))


def slash_parts(c) -> Column:
    """Non-blank stripped parts between ``/`` or ``\\``."""
    parts = F.transform(F.split(_c(c), SLASH_PATTERN), strip)
    return F.filter(parts, lambda s: F.length(s) > 0)


def clean_title(c) -> Column:
    """First slash part of the title without asides; null when empty."""
    return F.try_element_at(slash_parts(without_parentheses(c)), F.lit(1))
