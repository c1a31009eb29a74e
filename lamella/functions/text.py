"""String predicates of text detections and identifiers."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: The ideograph, punctuation and full-width ranges.
CJK = "[\\u4E00-\\u9FFF\\u3400-\\u4DBF\\u3000-\\u303F\\uFF00-\\uFFEF]"
#: Fixed value: one instance suffix of an identifier.
SUFFIX = r"_(r\d+c\d+|h\d+|i\d+|\d+)$"


def has_cjk(x: Column) -> Column:
    return x.rlike(CJK)


def is_number(x: Column) -> Column:
    """Three digits or more, in any script, and nothing else."""
    return x.rlike(r"(?U)^\d{3,}$")


def is_single_latin(x: Column) -> Column:
    return x.rlike("^[A-Za-z]$")


def family_of(identifier: Column) -> Column:
    """The identifier without its last instance suffix; itself if nothing else is left."""
    return F.coalesce(F.nullif(F.regexp_replace(identifier, SUFFIX, ""), F.lit("")), identifier)


def json_in(content: Column) -> Column:
    """The JSON text in a model's answer: all of it, else what is fenced, else from the first brace to the last."""
    whole = F.trim(content)
    fenced = F.regexp_extract(content, r"(?s)```json\s*(.*?)\s*```", 1)
    braces = F.regexp_extract(content, r"(?s)\{.*\}", 0)
    valid = lambda x: F.when(F.try_parse_json(x).isNotNull() & (x != ""), x)
    return F.coalesce(valid(whole), valid(fenced), valid(braces))
