"""License mentions by ordered signature rules, with built-in Spark functions only.

A text becomes its lower-case words between single blanks, so rules are plain word patterns.  Each
rule has a keyword that all its matches contain, once "licence" is spelt "license"; a test on words of
all keywords passes most texts by, and a rule's own pattern runs only where its keyword occurs.
Matches become spans of words.
Rules are ordered by priority: a span inside another one of equal or better priority is dropped.
Every step stays within its row, so nothing is shuffled.
"""

from __future__ import annotations

import json

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: The base phrases with their labels.
BASE = [("cc by", "cc-by"), ("general public license", "gpl"), ("all rights reserved", "reserved")]
NOT_WORD = r"[\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"

#: Priorities: a license with its version or its own legal text, a license by name, a general notice.
EXACT, NAMED, GENERAL = 1, 2, 3
CONFIDENCE = {EXACT: 0.98, NAMED: 0.85, GENERAL: 0.5}
BASE_CONFIDENCE = 0.6

_LATER = r"(?: or (?:at your option )?(?:any )?(?:later|newer)(?: version)?| only)?"
_V = r"(?: the)?(?: terms of)?(?: version| v| ver)?"


def _versions(*numbers: str) -> list[tuple[str, str]]:
    """Versions and the patterns of their words: 2.0 is written 2, 2 0, v2 or v2 0."""
    out = []
    for number in numbers:
        major, _, minor = number.partition(".")
        tail = "(?: 0)?" if minor in ("", "0") else f" {minor}"
        out.append((number, rf"(?: version| v| ver| release)? v?{major}{tail}(?! \d)"))
    return out


def _families() -> list[tuple[str, int, str, str]]:
    rules: list[tuple[str, int, str, str]] = []

    def add(label, priority, keyword, pattern):
        rules.append((label, priority, keyword, pattern))

    # GNU licenses, by long name, by short name, and as identifiers.
    gnu = {"gpl": "", "lgpl": "(?:lesser|library) ", "agpl": "affero "}
    for short, long in gnu.items():
        for number, version in _versions("1.0", "2.0", "2.1", "3.0"):
            if (short, number) in {("gpl", "2.1"), ("lgpl", "1.0"), ("agpl", "2.0"), ("agpl", "2.1")}:
                continue
            name = f"{short}-{number}"
            add(name, EXACT, "public license", rf"(?:gnu )?{long}general public licen[sc]e(?: {short})?(?: as published by the free software foundation)?(?: either)?{version}{_LATER}")
            add(name, EXACT, short, rf"(?:gnu )?{short}{version}{_LATER}")
            add(name, EXACT, "licenses", rf"gnu org licenses (?:old licenses )?{short}{version}")
        add(short, NAMED, "public license", rf"(?:gnu )?{long}general public licen[sc]e")
        add(short, NAMED, short, rf"(?:gnu )?{short}(?: licen[sc]ed?)")
        add(short, NAMED, f"{short}", rf"(?:under|of) the (?:gnu )?{short}")
    add("gfdl", NAMED, "documentation license", "(?:gnu )?free documentation licen[sc]e")
    for number, version in _versions("1.1", "1.2", "1.3"):
        add(f"gfdl-{number}", EXACT, "documentation license", rf"(?:gnu )?free documentation licen[sc]e{version}{_LATER}")

    # Creative Commons: each kind in short form, in words and as an address, with and without version.
    kinds = {
        "by": "attribution",
        "by-sa": "attribution share ?alike",
        "by-nd": "attribution no ?deriv(?:ative|ative works|atives|s)",
        "by-nc": "attribution non ?commercial",
        "by-nc-sa": "attribution non ?commercial share ?alike",
        "by-nc-nd": "attribution non ?commercial no ?deriv(?:ative|ative works|atives|s)",
    }
    for kind, words in kinds.items():
        blank = kind.replace("-", " ")
        for number, version in _versions("1.0", "2.0", "2.5", "3.0", "4.0"):
            add(f"cc-{kind}-{number}", EXACT, "cc by", rf"cc {blank}{version}(?: international| unported| generic)?")
            add(f"cc-{kind}-{number}", EXACT, "creative commons", rf"creative commons {words}{version}(?: international| unported| generic)?")
            add(f"cc-{kind}-{number}", EXACT, "creativecommons org", rf"creativecommons org licenses {blank}{version}")
        add(f"cc-{kind}", NAMED, "cc by", rf"cc {blank}(?! (?:sa|nd|nc)\b)")
        add(f"cc-{kind}", NAMED, "creative commons", rf"creative commons {words}(?: licen[sc]e)?")
        add(f"cc-{kind}", NAMED, "creativecommons org", rf"creativecommons org licenses {blank}(?! (?:sa|nd|nc)\b)")
    add("cc0-1.0", EXACT, "cc0", r"cc0(?: 1 0)?(?: universal)?")
    add("cc0-1.0", EXACT, "zero", r"creative commons zero(?: v?1 0)?(?: universal)?")
    add("cc0-1.0", EXACT, "publicdomain", r"creativecommons org publicdomain zero 1 0")
    add("cc", GENERAL, "creative commons", r"creative commons(?: licen[sc]ed?)?")

    # Licenses with versions: name, pattern of the name, pattern of an identifier, keyword, versions.
    versioned = [
        ("apache", r"apache(?: software)? licen[sc]e", "apache", "apache", ("1.0", "1.1", "2.0")),
        ("mpl", r"mozilla public licen[sc]e", "mpl", "mozilla public", ("1.0", "1.1", "2.0")),
        ("epl", r"eclipse public licen[sc]e", "epl", "eclipse public", ("1.0", "2.0")),
        ("cddl", r"common development and distribution licen[sc]e", "cddl", "common development", ("1.0", "1.1")),
        ("cpl", r"common public licen[sc]e", "cpl", "common public", ("0.5", "1.0")),
        ("ipl", r"ibm public licen[sc]e", "ipl", "ibm public", ("1.0",)),
        ("eupl", r"european union public licen[sc]e", "eupl", "european union public", ("1.0", "1.1", "1.2")),
        ("artistic", r"artistic licen[sc]e", "artistic", "artistic", ("1.0", "2.0")),
        ("osl", r"open software licen[sc]e", "osl", "open software license", ("1.0", "1.1", "2.0", "2.1", "3.0")),
        ("afl", r"academic free licen[sc]e", "afl", "academic free", ("1.1", "1.2", "2.0", "2.1", "3.0")),
        ("bsl", r"boost software licen[sc]e", "bsl", "boost software", ("1.0",)),
        ("busl", r"business source licen[sc]e", "busl", "business source", ("1.0", "1.1")),
        ("sspl", r"server side public licen[sc]e", "sspl", "server side public", ("1.0",)),
        ("ofl", r"(?:sil )?open font licen[sc]e", "ofl", "open font", ("1.0", "1.1")),
        ("psf", r"python software foundation licen[sc]e", "psf", "python software", ("2.0",)),
        ("zpl", r"zope public licen[sc]e", "zpl", "zope public", ("1.1", "2.0", "2.1")),
        ("lppl", r"latex project public licen[sc]e", "lppl", "latex project", ("1.0", "1.1", "1.2", "1.3")),
        ("php", r"php licen[sc]e", "php", "php license", ("3.0", "3.01")),
        ("ms-pl", r"microsoft public licen[sc]e", "ms pl", "microsoft public", ("1.0",)),
        ("ms-rl", r"microsoft reciprocal licen[sc]e", "ms rl", "microsoft reciprocal", ("1.0",)),
        ("cecill", r"cecill(?: free software)? licen[sc]e", "cecill", "cecill", ("1.0", "1.1", "2.0", "2.1")),
        ("apsl", r"apple public source licen[sc]e", "apsl", "apple public", ("1.0", "1.1", "1.2", "2.0")),
        ("odbl", r"open (?:data commons )?(?:open )?database licen[sc]e", "odbl", "database license", ("1.0",)),
        ("elastic", r"elastic licen[sc]e", "elastic", "elastic license", ("1.0", "2.0")),
        ("llama", r"llama(?: \d)? community licen[sc]e", "llama", "community license", ("2.0", "3.0")),
        ("openrail", r"(?:bigscience )?open ?rail(?: m)? licen[sc]e", "openrail", "rail", ("1.0",)),
        ("mulan", r"mulan (?:psl|permissive software licen[sc]e)", "mulanpsl", "mulan", ("1.0", "2.0")),
        ("python", r"python licen[sc]e", "python", "python license", ("2.0",)),
    ]
    for name, pattern, identifier, keyword, numbers in versioned:
        for number, version in _versions(*numbers):
            add(f"{name}-{number}", EXACT, keyword, rf"{pattern}{version}")
            add(f"{name}-{number}", EXACT, identifier, rf"{identifier}{version}(?: licen[sc]e)?")
        add(name, NAMED, keyword, pattern)

    # Licenses by name or by a sentence of their own text.
    texts = [
        ("mit", "mit license", r"(?:the )?mit licen[sc]e"),
        ("mit", "expat", r"(?:the )?expat licen[sc]e"),
        ("mit", "permission is hereby", r"permission is hereby granted free of charge to any person obtaining a copy"),
        ("mit", "without restriction", r"to deal in the software without restriction"),
        ("mit-0", "mit no attribution", r"mit no attribution"),
        ("x11", "x11 license", r"x11 licen[sc]e"),
        ("isc", "isc license", r"isc licen[sc]e"),
        ("isc", "with or without fee", r"permission to use copy modify and or distribute this software for any purpose with or without fee"),
        ("bsd-2-clause", "bsd 2", r"bsd 2 clause(?: simplified)?(?: licen[sc]e)?"),
        ("bsd-2-clause", "simplified bsd", r"simplified bsd licen[sc]e"),
        ("bsd-3-clause", "bsd 3", r"bsd 3 clause(?: new| revised)?(?: licen[sc]e)?"),
        ("bsd-3-clause", "new bsd", r"new bsd licen[sc]e"),
        ("bsd-3-clause", "modified bsd", r"modified bsd licen[sc]e"),
        ("bsd-3-clause", "neither the name", r"neither the name of(?: \S+){1,12} nor the names of its contributors"),
        ("bsd-4-clause", "bsd 4", r"bsd 4 clause(?: original)?(?: licen[sc]e)?"),
        ("bsd-4-clause", "advertising materials", r"all advertising materials mentioning features or use of this software"),
        ("0bsd", "zero clause bsd", r"zero clause bsd"),
        ("bsd", "redistributions of source", r"redistributions of source code must retain the above copyright notice"),
        ("zlib", "zlib", r"zlib(?: libpng)? licen[sc]e"),
        ("zlib", "misrepresented", r"the origin of this software must not be misrepresented"),
        ("unlicense", "unlicense", r"(?:the )?unlicense"),
        ("unlicense", "unencumbered", r"free and unencumbered software released into the public domain"),
        ("wtfpl", "wtfpl", r"wtfpl"),
        ("openssl", "openssl license", r"openssl licen[sc]e"),
        ("postgresql", "postgresql license", r"postgresql licen[sc]e"),
        ("ncsa", "ncsa", r"university of illinois ncsa open source licen[sc]e"),
        ("json", "not evil", r"the software shall be used for good not evil"),
        ("beerware", "beer", r"beer ?ware licen[sc]e"),
        ("apache-2.0", "apache org", r"apache org licenses license 2 0"),
        ("mpl-2.0", "source code form", r"this source code form is subject to the terms of the mozilla public licen[sc]e v 2 0"),
        ("gpl", "free software you can", r"this (?:program|library|file) is free software you can redistribute it"),
        ("pddl-1.0", "public domain dedication", r"public domain dedication and licen[sc]e"),
        ("odc-by-1.0", "odc", r"odc by(?: v?1 0)?"),
    ]
    for label, keyword, pattern in texts:
        add(label, EXACT, keyword, pattern)
    for label, keyword, pattern in [
        ("bsd", "bsd", r"bsd(?: style)? licen[sc]e"),
        ("mit", "license", r"mit (?:style|like) licen[sc]e"),
        ("public-domain", "public domain", r"(?:in|into|to) the public domain"),
    ]:
        add(label, NAMED, keyword, pattern)

    # General notices.
    for label, keyword, pattern in [
        ("licensed", "licensed under", r"(?:dual )?licen[sc]ed under"),
        ("licensed", "license", r"(?:released|distributed|published|available) under the(?: \S+){1,8}? licen[sc]e"),
        ("licensed", "license agreement", r"(?:end user )?licen[sc]e agreement"),
        ("copyright", "copyright", r"copyright(?: c)?(?: by)?(?: \d{4})+"),
        ("copyright", "copyright", r"copyright c"),
        ("proprietary", "proprietary", r"proprietary and confidential"),
        ("proprietary", "unauthorized", r"unauthorized (?:copying|reproduction|distribution|use)"),
        ("reserved", "rights reserved", r"(?:all|some|no) rights reserved"),
        ("warranty", "warranty", r"without (?:any )?warranty"),
        ("warranty", "provided", r"provided (?:as is|by the copyright holders)"),
        ("open-source", "open source license", r"open source licen[sc]e"),
        ("spdx", "spdx", r"spdx licen[sc]e identifier(?: \S+){1,3}"),
        ("terms", "terms of use", r"subject to (?:the|our) terms of use"),
    ]:
        add(label, GENERAL, keyword, pattern)
    return rules


RULES = _families()


def _between_blanks(pattern: str) -> str:
    return f" (?:{pattern})(?= )"


def _blanks(text: F.Column) -> F.Column:
    return F.octet_length(text) - F.octet_length(F.replace(text, F.lit(" "), F.lit("")))


def _rules() -> F.Column:
    rows = [
        {"rule": i, "label": label, "priority": priority, "keyword": keyword, "pattern": _between_blanks(pattern)}
        for i, (label, priority, keyword, pattern) in enumerate(RULES)
    ]
    schema = "array<struct<rule: int, label: string, priority: int, keyword: string, pattern: string>>"
    return F.from_json(F.lit(json.dumps(rows)), schema)  # constant: folded once by the optimizer


def _gate_words() -> list[str]:
    """One word of every keyword and base phrase; a text with none of them has no match.

    Patterns consist of whole words, so a keyword's longest unusual word stands in the text as a word,
    except for the first parts of words that may be written as one, and in either spelling of a license.
    """
    usual = {"by", "the", "in", "is", "not", "as", "or"}
    words = {max(reversed(k.split()), key=lambda w: (w not in usual, len(w))) for k in [k for _, _, k, _ in RULES] + [p for p, _ in BASE]}
    words |= {"beerware", "openrail"}
    return sorted(words | {w.replace("license", "licence") for w in words})


def _spans(words: F.Column, rule: F.Column) -> F.Column:
    """Spans of words of a rule's matches: the blanks before a match count the words before it."""
    found = F.regexp_extract_all(words, rule["pattern"], F.lit(0))
    between = F.split(words, rule["pattern"], -1)
    total = lambda parts: F.aggregate(parts, F.lit(0), lambda n, p: n + _blanks(p))

    def span(match, i):
        start = total(F.slice(between, 1, i + 1)) + total(F.slice(found, 1, i))
        return F.struct(
            start.alias("first"),
            (start + _blanks(match) - 1).alias("last"),
            rule["priority"].alias("priority"),
            rule["rule"].alias("rule"),
            rule["label"].alias("label"),
        )

    return F.transform(found, span)


_SPAN = "struct<first: int, last: int, priority: int, rule: int, label: string>"


def _kept(spans: F.Column) -> F.Column:
    """Spans that lie in no other span of equal or better priority.

    By rising start and falling end, a span is inside an earlier one exactly if the furthest end
    so far, over priorities at least as good, reaches its own end.
    """
    ordered = F.array_sort(
        F.transform(spans, lambda s: F.struct(s["first"].alias("first"), (-s["last"]).alias("back"), s["priority"].alias("priority"), s["rule"].alias("rule"), s["label"].alias("label")))
    )
    ends = {p: F.lit(-1).alias(f"end{p}") for p in (EXACT, NAMED, GENERAL)}
    start = F.struct(*ends.values(), F.array().cast(f"array<{_SPAN}>").alias("kept"))

    def step(acc, s):
        last = -s["back"]
        reach = F.greatest(*[F.when(F.lit(p) <= s["priority"], acc[f"end{p}"]).otherwise(F.lit(-1)) for p in ends])
        own = F.struct(s["first"].alias("first"), last.alias("last"), s["priority"].alias("priority"), s["rule"].alias("rule"), s["label"].alias("label"))
        return F.struct(
            *[F.when(s["priority"] == p, F.greatest(acc[f"end{p}"], last)).otherwise(acc[f"end{p}"]).alias(f"end{p}") for p in ends],
            F.when(reach >= last, acc["kept"]).otherwise(F.concat(acc["kept"], F.array(own))).alias("kept"),
        )

    return F.aggregate(ordered, start, step, lambda acc: acc["kept"])


def scanned(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """Per row: key, ``n_words``, base places (``n_base``, ``first_word``, ``last_word``), ``base_labels``,
    ``labels``, ``spans`` (first, last, priority, rule, label) and ``score``.

    Words count from 0.  Null and empty texts have no words, no spans, null places and score 0.
    Rows are independent; repeated rows and null keys pass through.
    """
    value = F.coalesce(F.col(f"`{text}`"), F.lit(""))
    rows = docs.select(F.col(f"`{key}`").alias("_key"), F.split(F.lower(value), NOT_WORD, -1).alias("_parts"))
    ends = [F.when(F.element_at("_parts", at) == "", 1).otherwise(0) for at in (1, -1)]
    spaced = F.concat(F.lit(" "), F.trim(F.array_join("_parts", " ")), F.lit(" "))
    rows = rows.select(
        "_key",
        F.greatest(F.size("_parts") - ends[0] - ends[1], F.lit(0)).cast("long").alias("n_words"),
        F.when(F.arrays_overlap("_parts", F.split(F.lit(" ".join(_gate_words())), " ")), spaced).alias("_words"),
    )
    words = F.col("_words")
    pieces = [F.when(F.contains(words, F.lit(f" {p} ")), F.split(words, f" {p}(?= )", -1)).alias(f"_base{i}") for i, (p, _) in enumerate(BASE)]
    one_spelling = F.col("_one_spelling")
    rows = rows.withColumn("_one_spelling", F.replace(words, F.lit("licence"), F.lit("license")))
    hits = F.flatten(F.transform(F.filter(_rules(), lambda r: F.contains(one_spelling, r["keyword"])), lambda r: _spans(words, r)))
    rows = rows.select("_key", "n_words", *pieces, F.when(words.isNotNull(), hits).alias("_hits"))
    base = [F.col(f"_base{i}") for i in range(len(BASE))]
    firsts = [_blanks(F.element_at(b, 1)) for b in base]
    lasts = [F.col("n_words") - (_blanks(F.element_at(b, -1)) - 1) - len(p.split()) for b, (p, _) in zip(base, BASE, strict=True)]
    base_labels = F.array_sort(F.array_compact(F.array(*[F.when(b.isNotNull(), F.lit(label)) for b, (_, label) in zip(base, BASE, strict=True)])))
    rows = rows.select(
        "_key",
        "n_words",
        sum([F.coalesce(F.size(b) - 1, F.lit(0)) for b in base], F.lit(0)).cast("long").alias("n_base"),
        F.least(*firsts).cast("long").alias("first_word"),
        F.greatest(*lasts).cast("long").alias("last_word"),
        base_labels.alias("base_labels"),
        F.coalesce(F.when(F.size("_hits") > 0, _kept(F.col("_hits"))), F.array().cast(f"array<{_SPAN}>")).alias("spans"),
    )
    best = F.array_min(F.transform("spans", lambda s: s["priority"]))
    known = F.create_map(*[F.lit(x) for p, c in CONFIDENCE.items() for x in (p, c)])
    score = F.greatest(F.coalesce(known[best], F.lit(0.0)), F.when(F.col("n_base") > 0, F.lit(BASE_CONFIDENCE)).otherwise(F.lit(0.0)))
    labels = F.array_sort(F.array_union("base_labels", F.transform("spans", lambda s: s["label"])))
    return rows.select(
        F.col("_key").alias(key), "n_words", "n_base", "first_word", "last_word", "base_labels", labels.alias("labels"), "spans", score.alias("score")
    )
