"""Secrets in text: three fixed patterns, and strings that a primed compressor finds new.

A random key does not compress: neither the text around it nor a dictionary of usual identifiers
holds parts of it.  Each candidate string that stands in a sensitive context is therefore measured
by the bytes it adds to the compressed form of its surroundings.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from itertools import accumulate

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from emberwatch.llm.common import keyed_text, map_keyed, released

# The base patterns and their kinds in order.
ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.I | re.A)
ACCESS = re.compile(r"AKIA[A-Z0-9]+")
HEX = re.compile(r"[0-9a-f]+")
LEAST = {"assign": 8, "access": 16, "hex": 32}
KINDS = ["assign", "access", "hex", "novel"]

#: A candidate is a run of key characters with a letter and a digit; the sensitive word stands before it,
#: or in its name where the run is an unquoted name=value.
SHORTEST = 14
CANDIDATE = re.compile(rf"[A-Za-z0-9+/_~.=-]{{{SHORTEST},}}")
SENSITIVE_WORDS = "password passwd passphrase secret token apikey api_key credential bearer authorization private_key access_key signing session_id".split()
SENSITIVE = re.compile("|".join(SENSITIVE_WORDS) + r"|private\x20key|access\x20key|api\x20key", re.I | re.A)
NEAR = 48
#: Characters of text on either side that the compressor has seen before the candidate.
AROUND = 1500
#: Reported at or above so many added bytes per character, and so many added bytes in all.
NEW_PER_CHAR, NEW_BYTES = 0.75, 12
#: Identifiers and literals of ordinary code and settings that a key is not made of.
IDENTIFIERS = (
    "username password passwd passphrase secret token apikey api_key api-key access_key access-key secret_key private_key public_key "
    "client_id client_secret session_id authorization bearer credential credentials signature certificate encrypted encryption "
    "localhost example placeholder changeme your_token_here your-api-key-here xxxxxxxxxxxxxxxx 0000000000000000 1234567890123456 "
    "abcdefghijklmnopqrstuvwxyz ABCDEFGHIJKLMNOPQRSTUVWXYZ 0123456789 config configuration settings environment production "
    "development default database connection http:// https:// www. .com .org .net .json .yaml /usr/local/bin /etc/ /home/ /var/log/ "
    "application version description content-type utf-8 timestamp 2024-01-01 created_at updated_at enabled disabled required "
    "request response header payload message error exception return import function class public static const value string number "
    "boolean integer object array null true false undefined"
)

Span = tuple[int, int, str]
_HEX_BYTES = bytes(104 if chr(c) in "0123456789abcdef" else 32 for c in range(256))
_HEX_RUN = b"h" * LEAST["hex"]
_FIRST_SIGNS = [b"password", b"passwd", b"secret", b"token", b"apikey", b"api_key"]
_SENSITIVE_SIGNS = [w.encode() for w in SENSITIVE_WORDS] + [b"private key", b"access key", b"api key"]


class Novelty:
    """Bytes that a string adds to the compressed form of its surroundings."""

    def __init__(self, level: int = 6):
        import zstandard

        primed = zstandard.ZstdCompressionDict(IDENTIFIERS.encode(), dict_type=zstandard.DICT_TYPE_RAWCONTENT)
        self.compress = zstandard.ZstdCompressor(level=level, dict_data=primed, write_content_size=False).compress

    def added(self, around: str, string: str) -> int:
        base = around.encode()
        return len(self.compress(base + b"\n" + string.encode())) - len(self.compress(base + b"\n"))


def base_spans(raw: bytes, text: str, low: bytes) -> list[Span]:
    """Matches of the base patterns, leftmost and non-overlapping within a kind."""
    found = []
    if any(s in low for s in _FIRST_SIGNS):
        found += [(m.start(), m.end(), "assign") for m in ASSIGN.finditer(text) if len(m[2]) >= LEAST["assign"]]
    if b"AKIA" in raw:
        found += [(m.start(), m.end(), "access") for m in ACCESS.finditer(text) if m.end() - m.start() >= LEAST["access"]]
    if _HEX_RUN in raw.translate(_HEX_BYTES):
        found += [(m.start(), m.end(), "hex") for m in HEX.finditer(text) if m.end() - m.start() >= LEAST["hex"]]
    return found


def uncovered(start: int, end: int, covers: list[Span]) -> list[tuple[int, int]]:
    """Parts of a stretch that lie in none of the sorted spans."""
    out = []
    for a, b, _ in covers:
        if a > start:
            out.append((start, min(a, end)))
        start = max(start, b)
        if start >= end:
            break
    return out + [(start, end)] if start < end else out


def value_start(string: str) -> int:
    """Where the value of an unquoted name=value begins, 0 without a name; names may follow each other."""
    at = 0
    while (cut := string.find("=", at)) > at and string[cut:].strip("="):
        name = string[at:cut]
        if any(map(str.isdigit, name)) and not SENSITIVE.search(name):
            break
        at = cut + len(string[cut:]) - len(string[cut:].lstrip("="))
    return at


def novel_spans(text: str, base: list[Span], novelty: Novelty) -> list[Span]:
    """Candidates in a sensitive context that stay incompressible; parts of base spans are left out.

    An unquoted name=value is measured by its value, and its name belongs to the context.  Copies of
    a string do not make it known, and a string found new is reported wherever it stands.
    """
    found, known = [], set()
    places = sorted(base)
    ends = list(accumulate((end for _, end, _ in places), max))

    def is_novel(start, end, context):
        string = text[start:end]
        if len(string) < SHORTEST or string.isalpha() or not (any(map(str.isdigit, string)) and any(map(str.isalpha, string))):
            return False
        if not SENSITIVE.search(text, max(0, context - NEAR), start):
            return False
        if string in known:
            return True
        # copies are blanked in a window longer by one string, so that none is cut at its far end
        blank, far = " " * len(string), AROUND + len(string)
        before = text[max(0, start - far) : start].replace(string, blank)[-AROUND:]
        after = text[end : end + far].replace(string, blank)[:AROUND]
        new = novelty.added(before + after, string)
        if new >= NEW_BYTES and new >= NEW_PER_CHAR * len(string):
            known.add(string)
            return True
        return False

    i = 0
    for m in CANDIDATE.finditer(text):
        string = m[0].rstrip(".=~-")
        start, end = m.start(), m.start() + len(string)
        while i < len(places) and ends[i] <= start:
            i += 1
        j = i
        while j < len(places) and places[j][0] < end:
            j += 1
        at = start + value_start(string)
        tries = [at]
        if i == j:  # also with the name, and behind a name with digits
            tries += [start] if at > start else []
            cut = string.find("=", at - start) + 1
            tries += [start + cut] if cut else []
        for a in tries:
            free = [(x, y) for x, y in uncovered(a, end, places[i:j]) if any(map(str.isalnum, text[x:y]))]
            if free and not is_novel(a, end, start):  # a part may be new where the whole is not
                free = [(x, y) for x, y in free if i < j and is_novel(x, y, start)]
            if free:
                found += [(x, y, "novel") for x, y in free]
                break
    return with_copies(text, found, known, places) if found else []


def with_copies(text: str, found: list[Span], known: set[str], places: list[Span]) -> list[Span]:
    """The spans and those of further copies of the known strings, without spans inside another one."""
    heads: dict[str, list[str]] = {}
    for string in known:
        heads.setdefault(string[:SHORTEST], []).append(string)
    copies = []
    for m in CANDIDATE.finditer(text):
        run = m[0]
        for i in range(len(run) - SHORTEST + 1):
            for string in heads.get(run[i : i + SHORTEST], ()):
                if run.startswith(string, i):
                    copies.append((m.start() + i, m.start() + i + len(string)))
    at, spans = 0, set(found)
    ends = list(accumulate((end for _, end, _ in places), max))
    for start, end in sorted(copies):
        while at < len(places) and ends[at] <= start:
            at += 1
        j = at
        while j < len(places) and places[j][0] < end:
            j += 1
        spans |= {(x, y, "novel") for x, y in uncovered(start, end, places[at:j]) if any(map(str.isalnum, text[x:y]))}
    out: list[Span] = []
    for span in sorted(spans, key=lambda s: (s[0], -s[1])):
        if not out or span[1] > out[-1][1]:
            out.append(span)
    return out


def spans_of(raw: bytes, novelty: Novelty) -> list[Span]:
    """All spans of a text by start and kind, as code points with an exclusive end."""
    low = raw.lower()
    sensitive = any(s in low for s in _SENSITIVE_SIGNS)
    if not sensitive and b"AKIA" not in raw and _HEX_RUN not in raw.translate(_HEX_BYTES):
        return []
    text = raw.decode()
    found = base_spans(raw, text, low)
    if sensitive:
        found += novel_spans(text, found, novelty)
    return sorted(found, key=lambda s: (s[0], KINDS.index(s[2])))


def scanned(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """Per row: key and ``spans``, an array of (kind, start, end) by start and kind.

    Null and empty texts have no spans.  Rows are independent; null keys pass through.
    """
    rows = keyed_text(docs, key, text, as_bytes=True)

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        novelty = Novelty()
        for frame in frames:
            spans = [[{"kind": k, "start": s, "end": e} for s, e, k in spans_of(t, novelty)] for t in frame["_text"]]
            yield pd.DataFrame({"_key": frame["_key"], "spans": spans})

    return map_keyed(rows, run, "spans array<struct<kind: string, start: long, end: long>>").withColumnRenamed("_key", key)


def joined(spans: F.Column) -> F.Column:
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"], s["end"])), ",")


def redacted(docs: DataFrame, text: str = "text", length: str | None = "n_chars", mark: str = "[SECRET]") -> DataFrame:
    """All rows and columns, with the spans of each text replaced by ``mark`` and its length set anew.

    Spans that touch or overlap share one mark.  Texts without spans, null ones included, stay as they are.
    """
    import pyarrow as pa

    columns = docs.columns
    at, long_at = columns.index(text), columns.index(length) if length in columns else None

    def run(batches):
        novelty = Novelty()
        for batch in batches:
            texts = batch.column(at).to_pylist()
            changed = {}
            for i, t in enumerate(texts):
                spans = spans_of(t.encode(), novelty) if t else []
                if spans:
                    out, done = [], 0
                    for start, end, _ in spans:
                        if start > done or not out:
                            out += [t[done:start], mark]
                        done = max(done, end)
                    changed[i] = "".join(out) + t[done:]
            if changed:
                arrays = batch.columns
                for i, t in changed.items():
                    texts[i] = t
                arrays[at] = pa.array(texts, batch.schema.field(at).type)
                if long_at is not None:
                    sizes = batch.column(long_at).to_pylist()
                    for i, t in changed.items():
                        sizes[i] = len(t)
                    arrays[long_at] = pa.array(sizes, batch.schema.field(long_at).type)
                batch = pa.RecordBatch.from_arrays(arrays, schema=batch.schema)
            yield batch

    return docs.mapInArrow(released(run), docs.schema)
