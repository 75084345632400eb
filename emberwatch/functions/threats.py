"""Severity levels, threat keyword flags and the weighted keyword score."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from emberwatch import dictionaries as D
from emberwatch.functions.text import is_blank


def any_of(lowered: Column, words: list[str]) -> Column:
    """True when the lower-cased text contains any of the words.

    Words covered by a shorter listed word ('login failed' by 'failed') are left out;
    the answer is the same and each row is searched fewer times.
    """
    needed = [w for w in words if not any(o != w and o in w for o in words)]
    test = lowered.contains(needed[0])
    for word in needed[1:]:
        test = test | lowered.contains(word)
    return test


def level(lowered: Column) -> Column:
    return (
        F.when(any_of(lowered, D.LEVEL_WORDS["ERROR"]), "ERROR")
        .when(any_of(lowered, D.LEVEL_WORDS["WARN"]), "WARN")
        .otherwise("INFO")
    )


def threat_flags(lowered: Column, keywords: dict, suffix: str = "_flag") -> list[Column]:
    """One 0/1 column per threat category."""
    return [
        any_of(lowered, words).cast("int").alias(category + suffix)
        for category, words in keywords.items()
    ]


def first_category(lowered: Column, keywords: dict = D.REALTIME_KEYWORDS) -> Column:
    """Upper-cased first matching category in dictionary order, else INFO."""
    chain = F.when(F.lit(False), F.lit(""))
    for category, words in keywords.items():
        chain = chain.when(any_of(lowered, words), category.upper())
    return chain.otherwise("INFO")


def keyword_score(text: Column, weights: dict = D.ATTACK_WEIGHTS, templates=()) -> Column:
    """Sum of matched weights plus a bonus per custom phrase, capped, one decimal.

    Phrases match as substrings, single words only as whole words.
    """
    lowered = F.lower(text)
    total = F.lit(0.0)
    for word, weight in weights.items():
        hit = lowered.contains(word)
        if " " not in word:
            hit = hit & lowered.rlike(r"(?U)\b" + re.escape(word) + r"\b")
        total = total + F.when(hit, float(weight)).otherwise(0.0)
    for phrase in templates:
        total = total + F.when(
            lowered.contains(phrase.lower()), D.CUSTOM_TEMPLATE_BONUS
        ).otherwise(0.0)
    capped = F.round(F.least(total, F.lit(D.SCORE_CEILING)), 1)
    return F.when(text.isNull() | is_blank(text), 0.0).otherwise(capped)


def score_band(score: Column) -> Column:
    chain = F.when(F.lit(False), F.lit(""))
    for floor, band in D.SCORE_BANDS:
        chain = chain.when(score >= floor, band)
    return chain.when(score > 0, "LOW").otherwise("NONE")


def with_lowered(df: DataFrame, raw: str = "raw", out: str = "_lower") -> DataFrame:
    return df.withColumn(out, F.lower(F.col(raw)))
