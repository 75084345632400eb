"""Alert columns: priority, CVSS, signature, categories and vulnerability lookup."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from emberwatch import dictionaries as D
from emberwatch.functions.lookup import cve_map, cve_struct, lookup

# --- fixed values: score limits per scale (CRITICAL, HIGH, MEDIUM) ---------------------
POSITIVE_LIMITS = (0.02, 0.05, 0.08)
NEGATIVE_LIMITS = (-0.15, -0.12, -0.10)


def _negative_scale(score: Column, scale: str) -> Column:
    if scale == "auto":
        return score < 0
    return F.lit(scale == "negative")


def priority(score: Column, priority_hits: Column, scale: str = "auto") -> Column:
    """Priority from score and count of high-priority events.

    ``scale`` is 'auto' (sign of the score decides), 'positive' or 'negative'.
    """
    hits = F.coalesce(priority_hits, F.lit(0))

    def bands(limits):
        critical, high, medium = limits
        return (
            F.when((hits >= 3) | (score <= critical), "CRITICAL")
            .when((hits > 0) | (score <= high), "HIGH")
            .when(score <= medium, "MEDIUM")
            .otherwise("LOW")
        )

    return F.when(_negative_scale(score, scale), bands(NEGATIVE_LIMITS)).otherwise(
        bands(POSITIVE_LIMITS)
    )


def cvss(score: Column, level: Column, scale: str = "auto") -> Column:
    """Linear inside each priority band, clamped to 0-10, one decimal."""
    size = F.abs(score)
    negative = (
        F.when(level == "CRITICAL", F.least(F.lit(10.0), 9.0 + (size - 0.15) / 0.05))
        .when(level == "HIGH", 7.0 + (size - 0.12) / 0.03 * 2.0)
        .when(level == "MEDIUM", 4.0 + (size - 0.10) / 0.02 * 3.0)
        .otherwise(F.greatest(F.lit(0.1), size * 10))
    )
    positive = (
        F.when(level == "CRITICAL", F.least(F.lit(10.0), 9.0 + (0.02 - score) / 0.02))
        .when(level == "HIGH", 7.0 + (0.05 - score) / 0.03 * 2.0)
        .when(level == "MEDIUM", 4.0 + (0.08 - score) / 0.03 * 3.0)
        .otherwise(F.greatest(F.lit(0.1), (0.10 - score) / 0.02 * 3.9))
    )
    banded = F.round(F.when(_negative_scale(score, scale), negative).otherwise(positive), 1)
    return F.round(F.greatest(F.lit(0.0), F.least(F.lit(10.0), banded)), 1)


def categories(hit_columns: list[str]) -> Column:
    """Array of categories whose ``<category>_hits`` is positive, in column order."""
    named = [F.when(F.col(c) > 0, F.lit(c.removesuffix("_hits"))) for c in hit_columns]
    return F.array_except(F.array(*named), F.array(F.lit(None).cast("string")))


def signature(threats: Column, score: Column) -> Column:
    joined = F.concat_ws("+", F.sort_array(threats))
    bucket = F.round(score * 100) / 100
    name = F.when(joined == "", "unknown").otherwise(joined)
    return F.concat(name, F.lit("@"), bucket.cast("string"))


def rank(level: Column) -> Column:
    return F.coalesce(lookup(D.PRIORITY_RANK, level, value_type="int"), F.lit(0))


def at_least(level: Column, minimum: str, default: int = 2) -> Column:
    """True when the priority reaches ``minimum``; a null level counts as MEDIUM."""
    known = F.coalesce(level, F.lit("MEDIUM"))
    return rank(known) >= D.PRIORITY_RANK.get(minimum, default)


def default_cvss(level: Column) -> Column:
    return F.coalesce(lookup(D.PRIORITY_CVSS, level, value_type="double"), F.lit(5.0))


def repaired_cvss(level: Column, stored: Column) -> Column:
    """Stored CVSS when it reaches its band, else the band's midpoint."""
    floor = F.coalesce(lookup(D.PRIORITY_CVSS_FLOOR, level, value_type="double"), F.lit(0.0))
    return F.when(stored >= floor, stored).otherwise(default_cvss(level))


def cve_for_category(threats: Column, table: dict = D.CVE_BY_CATEGORY) -> Column:
    """Entry of the first known category in array order, null when none is known."""
    known = F.array(*[F.lit(k) for k in table])
    first = F.try_element_at(F.array_intersect(threats, known), F.lit(1))
    return F.try_element_at(cve_map(table, "string"), first)


def cve_for_event(event: Column, table: dict = D.CVE_BY_EVENT) -> Column:
    return F.try_element_at(cve_map(table, "bigint"), event)


def cve_info(threats: Column, event: Column | None = None) -> Column:
    """Most specific entry: event id, then first known category, then the generic one."""
    choices = [cve_for_category(threats), cve_struct(D.CVE_GENERIC)]
    if event is not None:
        choices.insert(0, cve_for_event(event))
    return F.coalesce(*choices)
