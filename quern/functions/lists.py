"""List-valued text."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Items of a list literal: quoted text with escapes, or a bare run up to the next comma.
ITEM = r"""(?s)'[^'\\]*+(?:\\.[^'\\]*+)*+'|"[^"\\]*+(?:\\.[^"\\]*+)*+"|[^,'"\s][^,'"]*+"""


def _cleaned(items: Column) -> Column:
    return F.filter(F.transform(items, lambda x: F.trim(x)), lambda x: x != "")


def _unquoted(item: Column) -> Column:
    """Text between the quotes with its escapes taken off; a bare item as it is."""
    inner = F.regexp_replace(F.substring(item, F.lit(2), F.length(item) - 2), r"(?s)\\(.)", "$1")
    return F.when(item.rlike("^['\"]"), inner).otherwise(item)


def parse_list(c: Column) -> Column:
    """Items of a list literal, else of a comma list, else the text itself; blank gives none."""
    text = F.trim(c)
    literal = text.rlike(r"(?s)^\[.*\]$")
    inside = F.regexp_replace(text, r"(?s)^\[|\]$", "")
    items = (
        F.when(text.isNull() | (text == ""), F.array().cast("array<string>"))
        .when(literal, F.transform(F.regexp_extract_all(inside, F.lit(ITEM), F.lit(0)), _unquoted))
        .when(F.contains(text, F.lit(",")), F.split(text, ","))
        .otherwise(F.array(text))
    )
    return _cleaned(items)


def literal_items(c: Column) -> Column:
    """Items of a list literal of quoted texts and numbers; any other text is no list and gives none."""
    item = r"""(?:'[^'\\]*+(?:\\.[^'\\]*+)*+'|"[^"\\]*+(?:\\.[^"\\]*+)*+"|[-+]?\d[\d._]*+)"""
    whole = F.trim(c).rlike(r"(?s)^\[\s*+(?:" + item + r"\s*+(?:,\s*+" + item + r"\s*+)*+(?:,\s*+)?)?+\]$")
    return F.when(whole, parse_list(c)).otherwise(F.array().cast("array<string>"))


def list_features(items: Column) -> dict[str, Column]:
    """Size, first item or `Unknown`, joined length and a more-than-one flag."""
    return {
        "items": F.size(items),
        "first_item": F.coalesce(F.try_element_at(items, F.lit(1)), F.lit("Unknown")),
        "joined_length": F.length(F.array_join(items, ", ")),
        "several": (F.size(items) > 1).cast("int"),
    }


def first_label(c: Column) -> Column:
    """First label of a list text as the class, or the text itself."""
    return F.coalesce(F.try_element_at(parse_list(c), F.lit(1)), c)
