"""Small fixed dictionaries as literal map expressions (no join, no shuffle)."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

MAX_LITERAL_KEYS = 500


def literal_map(table: dict, key_type: str = "string", value_type: str = "string") -> Column:
    """``dict`` → constant map column.  The size limit keeps plans small."""
    if len(table) > MAX_LITERAL_KEYS:
        raise ValueError(f"{len(table)} keys; join a DataFrame instead of a literal map")
    cells = []
    for key, value in table.items():
        cells += [F.lit(key).cast(key_type), F.lit(value).cast(value_type)]
    return F.create_map(*cells)


def lookup(table: dict, key: Column, key_type: str = "string", value_type: str = "string") -> Column:
    """Value for ``key`` or null."""
    return F.try_element_at(literal_map(table, key_type, value_type), key)


def cve_struct(entry: dict) -> Column:
    ids = F.array(*[F.lit(i) for i in entry["cve_ids"]]).cast("array<string>")
    return F.struct(
        ids.alias("cve_ids"),
        F.lit(entry["cwe"]).alias("cwe"),
        F.lit(entry["name"]).alias("name"),
        F.lit(entry["description"]).alias("description"),
        F.lit(entry["tip"]).alias("tip"),
    )


def cve_map(table: dict, key_type: str) -> Column:
    cells = []
    for key, entry in table.items():
        cells += [F.lit(key).cast(key_type), cve_struct(entry)]
    return F.create_map(*cells)
