"""Tolerant JSON reading with VARIANT (L-3, O-9)."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

from quire.functions.arrays import let
from quire.functions.text import WS, strip


def _parses(c: Column) -> Column:
    return F.try_parse_json(c).isNotNull()


def json_candidates(c: Column) -> Column:
    """The texts to try in order: as given, without a code fence, the widest {...} part."""
    whole = strip(F.coalesce(c, F.lit("")))
    fenced = strip(F.regexp_replace(F.regexp_replace(whole, rf"(?i)^```(?:json)?{WS}*", ""), rf"{WS}*```$", ""))
    return F.array(whole, fenced, F.regexp_extract(fenced, r"(?s)\{.*\}", 0))


def extract_json(c: Column) -> Column:
    """L-3: the JSON object text of a model answer; ``{}`` when there is none.

    A valid value that is no object counts as an empty object.
    """
    first = F.get(F.filter(json_candidates(c), _parses), F.lit(0))
    return let(first, lambda j: F.when(j.startswith("{"), j).otherwise(F.lit("{}")))


def member_text(v: Column, name: str) -> Column:
    """A member as trimmed-free text: missing gives '', a JSON null gives 'None'."""
    raw = F.try_variant_get(v, f"$.{name}", "variant")
    return F.when(F.is_variant_null(raw), F.lit("None")).otherwise(
        F.coalesce(F.try_variant_get(v, f"$.{name}", "string"), F.lit("")))


def member_list(v: Column, name: str) -> Column:
    """A member as an array of VARIANT; NULL when it is missing or no list."""
    return F.try_variant_get(v, f"$.{name}", "array<variant>")


def item_texts(items: Column) -> Column:
    """List items as texts; a missing list is empty."""
    none = F.array().cast("array<string>")
    return F.coalesce(F.transform(items, lambda x: F.when(F.is_variant_null(x), F.lit("None")).otherwise(
        F.coalesce(F.try_variant_get(x, "$", "string"), F.lit("")))), none)


def parse_json_list(c: Column) -> Column:
    """O-9: a JSON list of texts; anything else is the empty list."""
    return item_texts(F.try_variant_get(F.try_parse_json(c), "$", "array<variant>"))
