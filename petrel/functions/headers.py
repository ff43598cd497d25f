"""Header lookup on ARRAY<STRUCT<name, value>> columns; all expressions stay in the JVM."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

UUID_PATTERN = r"([0-9a-fA-F]{8}-[0-9a-fA-F]{4}-[0-9a-fA-F]{4}-[0-9a-fA-F]{4}-[0-9a-fA-F]{12})"


def get_header(headers: Column, name: str) -> Column:
    """Value of the first header of that name, whatever its letter case; NULL if there is none."""
    hits = F.filter(headers, lambda h: F.lower(h["name"]) == F.lit(name.lower()))
    return F.try_element_at(hits, F.lit(1))["value"]


def set_header(headers: Column, name: str, value: Column) -> Column:
    """Headers without those of this name (any letter case), and the new one at the end."""
    kept = F.filter(headers, lambda h: ~F.coalesce(F.lower(h["name"]) == F.lit(name.lower()), F.lit(False)))
    return F.concat(kept, F.array(F.struct(F.lit(name).alias("name"), value.alias("value"))))


def uuid_bytes(text: Column) -> Column:
    """The 16 bytes of the first UUID in a text: equal for equal UUIDs, however they are written."""
    found = F.regexp_extract(text, UUID_PATTERN, 1)
    return F.when(found != "", F.unhex(F.translate(found, "-", "")))


def uuid_text(raw: Column) -> Column:
    """Lower-case 8-4-4-4-12 spelling of 16 bytes."""
    digits = F.lower(F.hex(raw))
    return F.regexp_replace(digits, "^(.{8})(.{4})(.{4})(.{4})(.{12})$", "$1-$2-$3-$4-$5")
