"""Text functions: normalisation, template ids, masking, timestamps, tip steps."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from emberwatch import dictionaries as D
from emberwatch.functions.lookup import literal_map

# --- fixed values: rewrite rules, applied in this order -------------------------------
# (pattern, replacement)
# Patterns are Java regular expressions; (?U) gives \w, \d, \s and \b their Unicode
# meaning.  Path segments repeat possessively: a plain group loop would use a stack frame
# per segment, and one encoded blob has hundreds of thousands.

REWRITES = [
    (r"\d{4}-\d{2}-\d{2}[T ]\d{2}:\d{2}:\d{2}(?:\.\d+)?(?:Z|[+-]\d{2}:?\d{2})?", "<TIMESTAMP>"),
    (r"\b(?:Jan|Feb|Mar|Apr|May|Jun|Jul|Aug|Sep|Oct|Nov|Dec)\s+\d{1,2}\s+\d{2}:\d{2}:\d{2}", "<TIMESTAMP>"),
    (r"\b[0-9a-fA-F]{8}-[0-9a-fA-F]{4}-[0-9a-fA-F]{4}-[0-9a-fA-F]{4}-[0-9a-fA-F]{12}\b", "<UUID>"),
    (r"\b\d{1,3}(?:\.\d{1,3}){3}(?::\d{2,5})?\b", "<IP>"),
    (r"\b(?:[0-9a-fA-F]{1,4}:){7}[0-9a-fA-F]{1,4}\b", "<IPV6>"),
    (r"\b(?:[0-9a-fA-F]{2}[:\-]){5}[0-9a-fA-F]{2}\b", "<MAC>"),
    (r"[A-Za-z]:\\(?:[^\s\\/:*?\"<>|]+\\)*+[^\s\\/:*?\"<>|]*", "<PATH>"),
    (r"(?<!\w)/[^\s/]+(?:/[^\s/]+)*+", "<PATH>"),
    (r"\b0x[0-9a-fA-F]+\b", "<HEX>"),
    (r"\b[0-9a-fA-F]{8,}\b", "<HEX>"),
    (r"https?://\S+", "<URL>"),
    (r"\b[\w.+-]+@[\w.-]+\.\w{2,}\b", "<EMAIL>"),
    (r"\bS-\d-\d-\d{2,}-\d+-\d+-\d+\b", "<SID>"),
    (r"(?i)\bport\s+\d{2,5}\b", "port <PORT>"),
    (r"\b\d+\b", "<NUM>"),
    (r"\s{2,}", " "),
]

# the rewrites that stand alone as token masks for free text
MASK_TOKENS = ["<UUID>", "<IP>", "<IPV6>", "<MAC>", "<EMAIL>", "<SID>"]

LOG_HEADER = r"(?Ud)^(?:\S+\s+\d+\s+\d+:\d+:\d+\s+)?(?:\S+\s+)?(.+)$"
EVENT_ID = r"EventID=(\d+)"
CHANNEL = r"\[(Security|System|Application)\]"
HDFS_BLOCK_LOOSE = r"(blk_[-\d]+)"

# --------------------------------------------------------------------------------------


def _col(value) -> Column:
    return F.col(value) if isinstance(value, str) else value


WHITE_SPACE = (
    " \t\n\r\x0b\x0c\x1c\x1d\x1e\x1f\x85\xa0\u1680\u2000\u2001\u2002\u2003\u2004\u2005"
    "\u2006\u2007\u2008\u2009\u200a\u2028\u2029\u202f\u205f\u3000"
)


def strip(text) -> Column:
    """Trim every kind of white space (plain ``trim`` removes only spaces)."""
    return F.btrim(_col(text), F.lit(WHITE_SPACE))


def is_blank(text) -> Column:
    return ~_col(text).rlike(r"(?U)\S")


def flatten_newlines(text) -> Column:
    """``\\r\\n`` and ``\\n`` become one space."""
    return F.regexp_replace(_col(text), r"\r\n|\n", " ")


def word_count(text) -> Column:
    return F.size(F.regexp_extract_all(_col(text), F.lit(r"(?U)\S+"), F.lit(0)))


def rewrite(text, rules=REWRITES) -> Column:
    """Apply ordered regex rewrites as one expression.

    The text occurs once at every level, so the expression stays small when Spark pushes
    a filter on the result below the projection.
    """
    out = _col(text)
    for pattern, replacement in rules:
        out = F.regexp_replace(out, "(?U)" + pattern, replacement)
    return out


def mask_tokens(text) -> Column:
    """Mask UUID, IP, MAC, e-mail and SID tokens in free text."""
    return rewrite(text, [r for r in REWRITES if r[1] in MASK_TOKENS])


def event_id(text) -> Column:
    """Windows event id in ``EventID=<n>``, null when absent."""
    return F.regexp_extract(_col(text), EVENT_ID, 1).try_cast("bigint")


def event_template(text) -> Column:
    """Template of a Windows event line: channel plus event category."""
    raw = _col(text)
    number = event_id(raw)
    channel = F.coalesce(F.nullif(F.regexp_extract(raw, CHANNEL, 1), F.lit("")), F.lit("Windows"))
    category = F.coalesce(
        F.try_element_at(literal_map(D.EVENT_TEMPLATES, "bigint"), number),
        F.concat(F.lit("windows_event_"), number.cast("string")),
    )
    return F.concat_ws(" ", channel, category)


def drop_log_header(text) -> Column:
    return F.regexp_replace(strip(text), LOG_HEADER, "$1")


def normalize(text) -> Column:
    """Stable template of a raw line; dynamic tokens become placeholders."""
    raw = _col(text)
    return F.when(event_id(raw).isNotNull(), event_template(raw)).otherwise(
        strip(rewrite(drop_log_header(raw)))
    )


def template_id(template) -> Column:
    """First 32 bits of the MD5, modulo 100000."""
    return F.conv(F.substring(F.md5(_col(template)), 1, 8), 16, 10).cast("bigint") % 100000


def hdfs_block(text) -> Column:
    """First ``blk_…`` token, null when absent."""
    return F.nullif(F.regexp_extract(_col(text), HDFS_BLOCK_LOOSE, 1), F.lit(""))


def parse_timestamp(text) -> Column:
    """Timestamp at the start of a line in one of four formats, else null.

    Shape is checked by a pattern first, so the cast never works on foreign text.
    """
    raw = strip(text)
    head = F.substring(raw, 1, 19)
    short = F.substring(raw, 1, 17)
    day = F.substring(raw, 1, 10)
    year = F.substring(short, 1, 2)
    century = F.when(year >= "69", "19").otherwise("20")
    return F.coalesce(
        F.when(
            head.rlike(r"^\d{4}-\d{2}-\d{2}[T ]\d{2}:\d{2}:\d{2}$"), head.try_cast("timestamp")
        ),
        F.when(
            short.rlike(r"^\d{2}/\d{2}/\d{2} \d{2}:\d{2}:\d{2}$"),
            F.concat(century, F.translate(short, "/", "-")).try_cast("timestamp"),
        ),
        F.when(day.rlike(r"^\d{4}-\d{2}-\d{2}$"), day.try_cast("timestamp")),
    )


def minute_bucket(ts) -> Column:
    return F.date_format(F.date_trunc("minute", _col(ts)), "yyyyMMdd_HHmm")


def mask_email(address) -> Column:
    """``name@host`` → ``n***@host``; anything without ``@`` → a fixed phrase."""
    value = _col(address)
    local = F.substring_index(value, "@", 1)
    domain = F.substring(value, F.length(local) + F.lit(2), F.length(value))
    return F.when(
        value.contains("@"),
        F.concat(
            F.when(F.length(local) > 1, F.substring(local, 1, 1)).otherwise(""),
            F.lit("***@"),
            domain,
        ),
    ).otherwise("your registered email")


def title_label(category) -> Column:
    return F.initcap(F.replace(_col(category), F.lit("_"), F.lit(" ")))


def tip_steps(tip) -> Column:
    """Numbered tip text → array of step texts, in order, without blanks."""
    parts = F.split(strip(tip), r"(?U)\s*\d+\.\s+")
    trimmed = F.transform(parts, lambda p: strip(p))
    return F.coalesce(F.filter(trimmed, lambda p: p != ""), F.array().cast("array<string>"))


def immediate_steps(tip) -> Column:
    return F.slice(tip_steps(tip), 1, 2)


def later_steps(tip) -> Column:
    steps = tip_steps(tip)
    return F.slice(steps, F.lit(3), F.greatest(F.size(steps) - F.lit(2), F.lit(0)))
