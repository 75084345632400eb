"""Weighted acyclic automata over word sequences, as sorted arrays.

An automaton holds sequences of words, each with a weight.  Its arcs stand in the order of a walk that
visits a state's arcs by label before it goes on: every arc has a depth (words before it), a label (a
number into the sorted words) and the weight of the sequence that ends with it.  Sequences with common
first words share their arcs, and the arcs of the last depth all end in the one final state, which
needs no record.  Since the order of arcs is the order of sequences, any range of sequences is a range
of arcs, once the arcs that lead to its first one are put before it with weight 0.
"""

from __future__ import annotations

import bisect
import struct
from collections.abc import Sequence
from dataclasses import dataclass

import numpy as np
import zstandard

#: Never part of UTF-8 text, so it can stand between words.
SPLIT = b"\xff"


@dataclass
class Transducer:
    words: list[bytes]  # sorted, distinct
    depth: np.ndarray  # uint8
    label: np.ndarray  # int64
    weight: np.ndarray  # int64

    def __len__(self) -> int:
        return len(self.depth)

    def parents(self) -> np.ndarray:
        """For each arc the arc before it in its sequences, -1 at depth 0."""
        found = np.full(len(self), -1, np.int64)
        at = np.arange(len(self))
        for d in range(1, int(self.depth.max(initial=0)) + 1):
            last = np.maximum.accumulate(np.where(self.depth == d - 1, at, -1))
            own = self.depth == d
            found[own] = last[own]
        return found

    def sequence(self, arc: int, parents: np.ndarray) -> list[bytes]:
        found = []
        while arc >= 0:
            found.append(self.words[self.label[arc]])
            arc = parents[arc]
        return found[::-1]

    def sequences(self, arcs: np.ndarray) -> list[list[bytes]]:
        """The word sequences that end with the given arcs."""
        parents, words = self.parents(), self.words
        columns, now = [], np.asarray(arcs, np.int64)
        while (now >= 0).any():
            columns.append(np.where(now >= 0, self.label[now], -1).tolist())
            now = np.where(now >= 0, parents[now], -1)
        return [[words[x] for x in reversed(labels) if x >= 0] for labels in zip(*columns, strict=True)]

    def cut(self, start: int, stop: int, parents: np.ndarray) -> Transducer:
        """The sequences of arcs ``start`` to ``stop``, with the words they need only."""
        path, arc = [], int(parents[start]) if stop > start else -1
        while arc >= 0:
            path.append(arc)
            arc = int(parents[arc])
        path = np.array(path[::-1], np.int64)
        label = np.concatenate([self.label[path], self.label[start:stop]])
        used, label = np.unique(label, return_inverse=True)
        depth = np.concatenate([self.depth[path], self.depth[start:stop]])
        weight = np.concatenate([np.zeros(len(path), np.int64), self.weight[start:stop]])
        return Transducer([self.words[x] for x in used], depth, label.astype(np.int64), weight)

    def place(self, sequence: Sequence[bytes], parents: np.ndarray) -> int:
        """The first arc whose sequence is not smaller than ``sequence``."""
        low, high = 0, len(self)  # the arcs below the words found so far
        for d, word in enumerate(sequence):
            arcs = low + np.flatnonzero(self.depth[low:high] == d)
            label = bisect.bisect_left(self.words, word)
            i = int(np.searchsorted(self.label[arcs], label))
            if i == len(arcs):
                return high
            if label == len(self.words) or self.words[self.label[arcs[i]]] != word:
                return int(arcs[i])
            if d == len(sequence) - 1:
                return int(arcs[i])
            high = int(arcs[i + 1]) if i + 1 < len(arcs) else high
            low = int(arcs[i]) + 1
        return low

    def packed(self) -> bytes:
        """Labels and weights by as few bytes as the largest needs, in sequence order, compressed."""
        label = np.uint16 if len(self.words) <= 1 << 16 else np.uint32
        top = int(self.weight.max(initial=0))
        weight = np.uint8 if top < 1 << 8 else np.uint32 if top < 1 << 32 else np.int64
        words = SPLIT.join(self.words)
        head = struct.pack("<QQBB", len(self), len(words), np.dtype(label).itemsize, np.dtype(weight).itemsize)
        return zstandard.ZstdCompressor(level=1).compress(
            b"".join([head, words, self.depth.astype(np.uint8).tobytes(), self.label.astype(label).tobytes(), self.weight.astype(weight).tobytes()])
        )

    @staticmethod
    def unpacked(raw: bytes) -> Transducer:
        data = zstandard.ZstdDecompressor().decompress(raw)
        n, size, label, weight = struct.unpack_from("<QQBB", data)
        at = struct.calcsize("<QQBB")
        words = data[at : at + size].split(SPLIT) if n else []
        at += size
        depth = np.frombuffer(data, np.uint8, n, at)
        labels = np.frombuffer(data, f"<u{label}", n, at + n).astype(np.int64)
        weights = np.frombuffer(data, f"<{'i' if weight == 8 else 'u'}{weight}", n, at + n + n * label).astype(np.int64)
        return Transducer(words, depth, labels, weights)


EMPTY = Transducer([], np.zeros(0, np.uint8), np.zeros(0, np.int64), np.zeros(0, np.int64))


def from_levels(words: list[bytes], labels: list[np.ndarray], above: list[np.ndarray], weights: list[np.ndarray]) -> Transducer:
    """From arcs level by level, each level sorted by (arc above, label); ``above[0]`` is not read.

    Each level is the set of distinct sequences of one length in order, so appending levels is adding
    sorted sequences to the automaton; here the arcs are put into the order of the walk.
    """
    sizes = [np.ones(len(x), np.int64) for x in labels]
    for d in range(len(labels) - 1, 0, -1):
        sizes[d - 1] += np.bincount(above[d], weights=sizes[d], minlength=len(labels[d - 1])).astype(np.int64)
    total = int(sizes[0].sum()) if labels else 0
    depth, label, weight = np.zeros(total, np.uint8), np.zeros(total, np.int64), np.zeros(total, np.int64)
    before = None
    for d, size in enumerate(sizes):
        run = np.cumsum(size) - size
        if d:
            # arcs of one state follow each other: take off what stands before its first arc
            first = np.zeros(len(labels[d - 1]), np.int64)
            heads = np.flatnonzero(np.diff(above[d], prepend=-1)) if len(above[d]) else np.zeros(0, np.int64)
            first[above[d][heads]] = run[heads]
            run = before[above[d]] + 1 + run - first[above[d]]
        depth[run], label[run], weight[run] = d, labels[d], weights[d]
        before = run
    return Transducer(words, depth, label, weight)


def from_sequences(sequences: Sequence[Sequence[bytes]], weights: Sequence[int]) -> Transducer:
    """From distinct sequences in ascending order, each added after the words it shares with the one before."""
    words = sorted({w for s in sequences for w in s})
    number = {w: i for i, w in enumerate(words)}
    depth, label, weight, last = [], [], [], ()
    for sequence, own in zip(sequences, weights, strict=True):
        same = 0
        while same < len(last) and same < len(sequence) and last[same] == sequence[same]:
            same += 1
        for d in range(same, len(sequence)):
            depth.append(d)
            label.append(number[sequence[d]])
            weight.append(own if d == len(sequence) - 1 else 0)
        last = sequence
    return Transducer(words, np.array(depth, np.uint8), np.array(label, np.int64), np.array(weight, np.int64))


def union(parts: Sequence[Transducer]) -> Transducer:
    """All sequences of ``parts``; weights of equal sequences add up."""
    parts = [p for p in parts if len(p)]
    if len(parts) < 2:
        return parts[0] if parts else EMPTY
    words = sorted(set().union(*[p.words for p in parts]))
    number = {w: i for i, w in enumerate(words)}
    depth = np.concatenate([p.depth for p in parts])
    label = np.concatenate([np.array([number[w] for w in p.words], np.int64)[p.label] for p in parts])
    weight = np.concatenate([p.weight for p in parts])
    starts = np.cumsum([0] + [len(p) for p in parts])
    parent = np.concatenate([p.parents() + np.where(p.depth > 0, s, 0) for p, s in zip(parts, starts, strict=False)])
    merged = np.zeros(len(depth), np.int64)  # each arc's place among the distinct arcs of its level
    labels, above, weights = [], [], []
    for d in range(int(depth.max()) + 1):
        own = np.flatnonzero(depth == d)
        base = merged[parent[own]] if d else np.zeros(len(own), np.int64)
        keys, place = np.unique(base * len(words) + label[own], return_inverse=True)
        merged[own] = place
        labels.append(keys % len(words))
        above.append(keys // len(words))
        sums = np.zeros(len(keys), np.int64)
        np.add.at(sums, place, weight[own])
        weights.append(sums)
    return from_levels(words, labels, above, weights)


def compose(counts: Transducer, wanted: Transducer) -> np.ndarray:
    """For every arc of ``wanted`` the weight of its sequence in ``counts``, 0 where it has none.

    Both are walked together, state by state: arcs meet if they leave states that met and agree in label.
    """
    found = np.zeros(len(wanted), np.int64)
    if not len(counts) or not len(wanted):
        return found
    number = {w: i for i, w in enumerate(counts.words)}
    label = np.array([number.get(w, -1) for w in wanted.words], np.int64)[wanted.label]
    below, above = wanted.parents(), counts.parents()
    met = np.full(len(wanted), -1, np.int64)
    for d in range(int(wanted.depth.max()) + 1):
        have, own = np.flatnonzero(counts.depth == d), np.flatnonzero(wanted.depth == d)
        if not len(have):
            break
        base = len(counts.words)
        keys = (above[have] + 1) * base + counts.label[have]
        state = met[below[own]] if d else np.full(len(own), -1, np.int64)
        ask = np.where((label[own] >= 0) & ((state >= 0) | (d == 0)), (state + 1) * base + label[own], -1)
        at = np.minimum(np.searchsorted(keys, ask), len(keys) - 1)
        met[own] = np.where(keys[at] == ask, have[at], -1)
        found[own] = np.where(met[own] >= 0, counts.weight[np.maximum(met[own], 0)], 0)
    return found
