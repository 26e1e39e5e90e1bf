"""Link names, polylines and messages."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# --- fixed value: link name pattern ---
LINK_NAME_PATTERN = r"^[sS]?[_-]?(\d+)[_-](\d+)$"


def link_key(from_id: Column, to_id: Column) -> Column:
    """Join key ``s_{from}-{to}``."""
    return F.concat(F.lit("s_"), from_id.cast("string"), F.lit("-"), to_id.cast("string"))


def link_from(name: Column) -> Column:
    return F.nullif(F.regexp_extract(F.trim(name), LINK_NAME_PATTERN, 1), F.lit(""))


def link_to(name: Column) -> Column:
    return F.nullif(F.regexp_extract(F.trim(name), LINK_NAME_PATTERN, 2), F.lit(""))


def canonical_link(name: Column) -> Column:
    """Canonical join key of a raw link name, NULL when it does not parse."""
    return link_key(link_from(name), link_to(name))


def blank_to_null(value: Column, tokens: list[str]) -> Column:
    """NULL for the usual missing-value tokens."""
    return F.when(~F.trim(value).isin(tokens), value)
