"""Lenient readings of raw fields: dates, defaults, creators, attributes."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from boxmill.schema import ATTRIBUTE_MAP


def _col(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


def parse_time(text: Column | str) -> Column:
    """ISO text -> TIMESTAMP; text without a zone is UTC, junk is NULL.

    Every value is read on its own, so formats may be mixed within a column.
    """
    s = F.trim(_col(text))
    signs = ("+", "-")
    zoned = (F.length(s) > 16) & (
        F.lower(F.right(s, F.lit(1))).eqNullSafe("z")
        | F.substring(s, -6, 1).isin(*signs)
        | F.substring(s, -5, 1).isin(*signs)
    )
    hours_only = (F.length(s) > 16) & F.substring(s, -3, 1).isin(*signs)
    zone = F.when(F.length(s) <= 10, F.lit(" 00:00:00Z")).when(hours_only, F.lit(":00")).when(zoned, F.lit("")).otherwise(F.lit("Z"))
    return F.when(F.substring(s, 5, 1) == "-", F.concat(s, zone).try_cast("timestamp"))


def updated_date(date: Column | str, at: Column | str) -> Column:
    return F.coalesce(_col(date), _col(at), F.lit(""))


def or_empty(value: Column | str, default) -> Column:
    return F.coalesce(_col(value), F.lit(default))


def creator_name(created_by: Column | str, owner: Column | str | None = None) -> Column:
    """User name out of ``created_by``, else ``owner``.

    Each may hold a plain name or the JSON text of a user object, whose
    ``username`` counts before its ``name``.
    """

    def name(user: Column) -> Column:
        is_object = F.startswith(user, F.lit("{"))
        inner = F.coalesce(
            F.nullif(F.get_json_object(user, "$.username"), F.lit("")),
            F.get_json_object(user, "$.name"),
            F.lit(""),
        )
        return F.when(is_object, inner).otherwise(user)

    given = F.nullif(_col(created_by), F.lit(""))
    if owner is not None:
        given = F.coalesce(given, F.nullif(_col(owner), F.lit("")))
    return F.coalesce(name(given), F.lit(""))


def attributes_map(names: Column | str, values: Column | str) -> Column:
    """Two parallel arrays -> map; a repeated name keeps its first place and its
    last value.  Written without ``mapKeyDedupPolicy`` so any session works."""
    n, v = _col(names), _col(values)
    keys = F.array_distinct(n)
    last = F.transform(
        keys,
        lambda k: F.element_at(F.filter(F.arrays_zip(n.alias("n"), v.alias("v")), lambda e: e["n"] == k), -1)["v"],
    )
    return F.map_from_arrays(keys, last).cast(ATTRIBUTE_MAP)


def _quoted(text: Column) -> Column:
    boxed = F.to_json(F.array(text))
    return F.substring(boxed, F.lit(2), F.length(boxed) - F.lit(2))


def attributes_json(attributes: Column | str) -> Column:
    """Map -> JSON object text, ``{"a": "b", "c": "d"}``; non-ASCII is kept."""
    entries = F.map_entries(F.coalesce(_col(attributes), F.create_map().cast(ATTRIBUTE_MAP)))
    pairs = F.transform(
        entries,
        lambda e: F.concat(
            _quoted(e["key"]), F.lit(": "),
            F.when(e["value"].isNull(), F.lit("null")).otherwise(_quoted(e["value"])),
        ),
    )
    return F.concat(F.lit("{"), F.array_join(pairs, ", "), F.lit("}"))
