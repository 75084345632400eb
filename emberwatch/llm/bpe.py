"""Exact byte-pair encoding by dynamic programming over prefixes.

Merging pair by pair rescans a word after every merge.  Here every prefix of a word stores the
one token its encoding ends with: a token that ends at the prefix is that token exactly if it
may follow the last token of the prefix before it, that is, if encoding the two tokens' text
together gives the same two tokens.  Matches come from an automaton over the vocabulary; the ids
follow from the back-pointers.  Words repeat, so each task keeps a bounded table of pieces.
"""

from __future__ import annotations

import hashlib
import json
import os
import re
import struct
import unicodedata
from collections.abc import Iterator

import pandas as pd
import regex
from pyspark.sql import DataFrame

from emberwatch.llm.common import keyed_text, map_keyed

#: Fixed values of this tokenizer family: the split rule and the end-of-word mark.
SPLIT = r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"
WORD_END = "</w>"
SPACES = "\t\n\x0b\x0c\r \x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000"
#: Distinct strings a worker remembers; beyond it the table restarts, with the same results.
REMEMBERED = 250_000

#: Number of tokens, ids packed little-endian in four bytes each, tokens joined by a space.
Encoded = tuple[int, bytes, str]


def byte_letters() -> list[str]:
    """The printable character that stands for each byte in a byte-level vocabulary."""
    kept = [*range(33, 127), *range(161, 173), *range(174, 256)]
    letters, shifted = {b: chr(b) for b in kept}, 256
    for b in range(256):
        if b not in letters:
            letters[b] = chr(shifted)
            shifted += 1
    return [letters[b] for b in range(256)]


class Encoder:
    """Encoder of one tokenizer file (its JSON text)."""

    def __init__(self, spec: str):
        import ahocorasick

        loaded = json.loads(spec)
        vocab, merges = loaded["model"]["vocab"], loaded["model"]["merges"]
        self.token = {i: t for t, i in vocab.items()}
        self.added = {a["content"]: a["id"] for a in loaded["added_tokens"]}
        self.token |= {i: t for t, i in self.added.items()}
        self.letters = byte_letters()
        # A merge's rank is its place in the list; ids follow it, which the pair test uses.
        self.merged, self.parts = {}, {}
        previous = -1
        for left, right in merges:
            made = vocab[left + right]
            if made <= previous:
                raise ValueError("ids of merged tokens must follow the order of the merges")
            previous = made
            pair = vocab[left], vocab[right]
            self.merged[pair] = made
            self.parts[made] = pair
        self.fits = {}
        self.automaton = ahocorasick.Automaton()
        for text, i in vocab.items():
            if i not in self.parts or self.may_follow(*self.parts[i], before=i):
                word_end = text.endswith(WORD_END)
                shape = text[: -len(WORD_END)] + "\0" if word_end else text
                self.automaton.add_word(shape, (i, len(shape) - word_end))
        self.automaton.make_automaton()
        added = sorted(self.added, key=len, reverse=True)
        self.added_rule = re.compile("(" + "|".join(map(re.escape, added)) + ")")
        self.added_mark = os.path.commonprefix(added)
        self.split = regex.compile(SPLIT)
        self.strings: dict[str, Encoded] = {}

    def may_follow(self, left: int, right: int, before: int | None = None) -> bool:
        """Whether encoding the text of both tokens together yields the two tokens again.

        Undo merges in reverse order on both sides of the border: wherever the two inner tokens
        would have merged earlier than the younger of them was built, the border does not hold.
        ``before`` asks it only for merges older than that one.
        """
        known = self.fits.get((left, right)) if before is None else None
        if known is not None:
            return known
        a, b, youngest, holds = left, right, float("inf") if before is None else before, True
        while True:
            made = self.merged.get((a, b))
            if made is not None and made < youngest:
                holds = False
                break
            # The younger inner token is taken apart; of two equally young ones the left one was built first.
            age_a, age_b = self.parts.get(a) and a or -1, self.parts.get(b) and b or -1
            if age_a < 0 and age_b < 0:
                break
            if age_a > age_b:
                youngest, a = a, self.parts[a][1]
            else:
                youngest, b = b + 1, self.parts[b][0]
        if before is None:
            if len(self.fits) > REMEMBERED:
                self.fits.clear()
            self.fits[left, right] = holds
        return holds

    def piece_ids(self, piece: str) -> list[int]:
        """Ids of one piece of the split rule."""
        letters, fits = self.letters, self.fits
        text = piece if piece.isascii() and piece.isprintable() else "".join([letters[b] for b in piece.encode()])
        n = len(text)
        last, came = [-1] * (n + 1), [0] * (n + 1)
        for end, (token, size) in self.automaton.iter(text + "\0"):
            # The mark belongs to the last letter: a match that ends at the mark ends the word,
            # one that ends at the last letter without the mark cannot be part of it.
            end += 1
            if end > n:
                end = n
            elif end == n:
                continue
            if last[end] < 0:
                start = end - size
                if start:
                    before = last[start]
                    if before < 0:
                        continue
                    fit = fits.get((before, token))
                    if not (self.may_follow(before, token) if fit is None else fit):
                        continue
                last[end] = token
                came[end] = start
        ids, at = [], n
        while at:
            ids.append(last[at])
            at = came[at]
        ids.reverse()
        return ids

    def remember(self, string: str, ids: list[int]) -> Encoded:
        token = self.token
        found = len(ids), struct.pack(f"<{len(ids)}I", *ids), " ".join([token[i] for i in ids])
        if len(self.strings) >= REMEMBERED:
            self.strings.clear()
        self.strings[string] = found
        return found

    def string_ids(self, string: str) -> Encoded:
        """Count, packed ids and decoded tokens of a normalised string without white space."""
        if string.isalpha():
            return self.remember(string, self.piece_ids(string))
        word, mark = string[:-1], string[-1]
        if mark in ",.!?;:" and word.isalpha():  # a word and one mark: two pieces, both known or worth it
            known = self.strings.get
            a, b = known(word) or self.string_ids(word), known(mark) or self.string_ids(mark)
            return a[0] + b[0], a[1] + b[1], f"{a[2]} {b[2]}"
        return self.remember(string, [i for piece in self.split.findall(string) for i in self.piece_ids(piece)])

    def plain(self, text: str) -> list[Encoded]:
        """Encoded strings of a text without added tokens."""
        text = unicodedata.normalize("NFC", text)
        # Lower case goes letter by letter, so the final form of sigma is not taken from context.
        text = "".join([c.lower() for c in text]) if "Σ" in text else text.lower()
        parts = [p for p in SPACE_RUN.split(text) if p] if ODD_SPACE.search(text) else text.split()
        known, slow = self.strings.get, self.string_ids
        return [known(p) or slow(p) for p in parts]

    def encode(self, text: str) -> Encoded:
        if self.added_mark in text:
            found = []
            for part in self.added_rule.split(text):
                found += [self.remember(part, [self.added[part]])] if part in self.added else self.plain(part)
        else:
            found = self.plain(text)
        return sum([f[0] for f in found]), b"".join([f[1] for f in found]), " ".join([f[2] for f in found])


#: Python also splits at four control characters that the tokenizer does not take for white space.
ODD_SPACE = re.compile("[\x1c-\x1f]")
SPACE_RUN = re.compile(f"[{SPACES}]+")

_encoder: dict[int, Encoder] = {}


def encoder_of(spec: str) -> Encoder:
    """One encoder per worker process and tokenizer."""
    key = hash(spec)
    if key not in _encoder:
        _encoder[key] = Encoder(spec)
    return _encoder[key]


def encoded(docs: DataFrame, spec: str, key: str = "doc_id", text: str = "text") -> DataFrame:
    """Per row: key, number of tokens, packed ids (little-endian, four bytes each), decoded text.

    ``spec`` is the JSON text of the tokenizer file (a fixed size, whatever the input).  A null
    or empty text has no tokens.  Rows are independent: repeated rows and null keys pass through.
    """
    return _mapped(docs, spec, key, text, "ids binary, decoded string", lambda n, ids, out: (ids, out))


def encoded_digests(docs: DataFrame, spec: str, key: str = "doc_id", text: str = "text") -> DataFrame:
    """As ``encoded``, with SHA-256 digests of ids and decoded text in place of both."""
    return _mapped(
        docs,
        spec,
        key,
        text,
        "ids_sha256 string, decoded_sha256 string",
        lambda n, ids, out: (hashlib.sha256(ids).hexdigest(), hashlib.sha256(out.encode()).hexdigest()),
    )


def _mapped(docs, spec, key, text, columns, shown):
    rows = keyed_text(docs, key, text)
    names = [c.split()[0] for c in columns.split(",")]
    shared = docs.sparkSession.sparkContext.broadcast(spec)

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        encoder = encoder_of(shared.value)
        for frame in frames:
            out = [encoder.encode(t) for t in frame["_text"]]
            made = [shown(*o) for o in out]
            yield pd.DataFrame(
                {"_key": frame["_key"], "n_tokens": [o[0] for o in out], **{c: [m[i] for m in made] for i, c in enumerate(names)}}
            )
        # The worker goes on to other stages: it keeps the tables of the vocabulary, not the strings and pairs.
        encoder.strings.clear()
        encoder.fits.clear()

    return map_keyed(rows, run, f"n_tokens long, {columns}").withColumnRenamed("_key", key)
