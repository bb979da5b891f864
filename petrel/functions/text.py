"""String functions with Unicode white space and title case, as JVM expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..schema import PLACEHOLDERS

_SPACE = r"[\s\x1c-\x1f]"


def strip(c: Column) -> Column:
    """Without white space (any Unicode one, and U+001C to U+001F) at both ends; ``trim`` knows U+0020 only."""
    return F.regexp_replace(c, rf"(?U)^{_SPACE}+|{_SPACE}+$", "")


def title(c: Column) -> Column:
    """Every run of letters with its first letter upper case and the rest lower; ``initcap`` only looks at blanks."""
    runs = F.regexp_extract_all(c, F.lit(r"([\p{Lu}\p{Ll}\p{Lt}]+|[^\p{Lu}\p{Ll}\p{Lt}]+)"), F.lit(0))
    return F.array_join(F.transform(runs, lambda t: F.concat(F.upper(F.substring(t, 1, 1)), F.lower(F.substr(t, F.lit(2))))), "")


def clean(c: Column, title_case: bool = True) -> Column:
    """Control characters become blanks, white space collapses, ends are stripped, words get title case."""
    c = strip(F.regexp_replace(F.regexp_replace(c, r"[\x00-\x1f\x7f-\x9f]", " "), r"(?U)\s+", " "))
    return title(c) if title_case else c


def is_placeholder(c: Column) -> Column:
    return F.lower(strip(c)).isin(PLACEHOLDERS)


def split_objects(cell: Column) -> Column:
    """Object types of a cell: a JSON list if it begins with "[", else parts between | ; , and line feeds; trimmed, no empty ones."""
    cell = strip(F.coalesce(cell, F.lit("None")))
    listed = F.from_json(cell, "array<string>", {"allowSingleQuotes": "false"})
    listed = F.transform(listed, lambda x: F.coalesce(x, F.lit("None")))
    parts = F.coalesce(F.when(cell.startswith("["), listed), F.split(cell, r"[|;,\n]+"))
    return F.filter(F.transform(parts, strip), lambda x: x != "")


def slug(c: Column) -> Column:
    return F.btrim(F.regexp_replace(F.lower(c), "[^a-z0-9]+", "_"), F.lit("_"))
