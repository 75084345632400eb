"""DuckDB SQL fragments shared by the oracles, built from the same fixed values."""

from __future__ import annotations

from emberwatch import dictionaries as D
from emberwatch.functions.text import CHANNEL, EVENT_ID, MASK_TOKENS, REWRITES


def quote(text: str) -> str:
    return "'" + text.replace("'", "''") + "'"


def rewrites(expr: str, rules) -> str:
    """Nested replaces.  RE2 has no lookbehind, so the path rule keeps its left neighbour; it
    never backtracks, so possessive loops are written as plain ones."""
    for pattern, replacement in rules:
        pattern = pattern.replace("*+", "*")
        if pattern.startswith(r"(?<!\w)"):
            pattern = r"(^|[^\w])" + pattern.removeprefix(r"(?<!\w)")
            replacement = r"\1" + replacement
        expr = f"regexp_replace({expr}, {quote(pattern)}, {quote(replacement)}, 'g')"
    return expr


def mask_tokens(expr: str) -> str:
    return rewrites(expr, [r for r in REWRITES if r[1] in MASK_TOKENS])


def strip(expr: str) -> str:
    return f"regexp_replace({expr}, '^\\s+|\\s+$', '', 'g')"


def case_of(expr: str, table: dict, default: str = "NULL") -> str:
    whens = " ".join(
        f"WHEN {quote(k) if isinstance(k, str) else k} THEN {quote(v) if isinstance(v, str) else v}"
        for k, v in table.items()
    )
    return f"(CASE {expr} {whens} ELSE {default} END)"


def event_id(raw: str = "raw") -> str:
    return f"TRY_CAST(regexp_extract({raw}, '{EVENT_ID}', 1) AS BIGINT)"


def event_template(raw: str = "raw") -> str:
    number = event_id(raw)
    category = case_of(number, D.EVENT_TEMPLATES, f"concat('windows_event_', {number})")
    channel = f"coalesce(nullif(regexp_extract({raw}, {quote(CHANNEL)}, 1), ''), 'Windows')"
    return f"concat({channel}, ' ', {category})"


def log_template(raw: str = "raw") -> str:
    header = r"^(?:\S+\s+\d+\s+\d+:\d+:\d+\s+)?(?:\S+\s+)?(.+)$"
    body = f"regexp_replace({strip(raw)}, {quote(header)}, {quote(chr(92) + '1')})"
    return strip(rewrites(body, REWRITES))


def template(raw: str = "raw") -> str:
    return (
        f"CASE WHEN {event_id(raw)} IS NOT NULL THEN {event_template(raw)} "
        f"ELSE {log_template(raw)} END"
    )


def template_id(expr: str = "template") -> str:
    return f"(('0x' || substr(md5({expr}), 1, 8))::BIGINT % 100000)"


def any_of(words, lowered: str = "lower(raw)") -> str:
    return "(" + " OR ".join(f"contains({lowered}, {quote(w)})" for w in words) + ")"


def level(lowered: str = "lower(raw)") -> str:
    return (
        f"CASE WHEN {any_of(D.LEVEL_WORDS['ERROR'], lowered)} THEN 'ERROR' "
        f"WHEN {any_of(D.LEVEL_WORDS['WARN'], lowered)} THEN 'WARN' ELSE 'INFO' END"
    )


def flags(keywords: dict, suffix: str = "_flag", lowered: str = "lower(raw)") -> str:
    return ", ".join(
        f"{any_of(words, lowered)}::INTEGER AS {category}{suffix}"
        for category, words in keywords.items()
    )


def hits(keywords: dict) -> str:
    return ", ".join(f"sum({c}_flag)::BIGINT AS {c}_hits" for c in keywords)


def parse_timestamp(raw: str = "raw") -> str:
    s = strip(raw)
    return (
        f"coalesce(try_strptime(substr({s}, 1, 19), '%Y-%m-%dT%H:%M:%S'), "
        f"try_strptime(substr({s}, 1, 19), '%Y-%m-%d %H:%M:%S'), "
        f"try_strptime(substr({s}, 1, 17), '%y/%m/%d %H:%M:%S'), "
        f"try_strptime(substr({s}, 1, 10), '%Y-%m-%d'))"
    )


MINUTE = "strftime(date_trunc('minute', ts), '%Y%m%d_%H%M')"


def event_threat(expr: str) -> str:
    return case_of(expr, D.EVENT_THREATS)


def cve_case(key: str, table: dict, field: str) -> str:
    """CASE over a vulnerability table; id lists are joined with commas."""
    values = {
        k: ",".join(v["cve_ids"]) if field == "cve_ids" else v[field] for k, v in table.items()
    }
    return case_of(key, values)
