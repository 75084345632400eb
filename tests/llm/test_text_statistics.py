"""Collocations, source mixing and spelling variants: odd rows, and against plain versions."""

import collections
import random
import re
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from emberwatch.llm import collocations, mixture, spelling
from emberwatch.llm.transducer import EMPTY, SPLIT, Transducer, compose, from_sequences, union

CLASH = "key word words n f range lang_of size a b rank target places copies order slice part first blob".split()
SCHEMA = "doc_id long, text string, lang string, source string"


def frame(spark, rows):
    return spark.createDataFrame(rows, SCHEMA).withColumns({c: F.lit("clash") for c in CLASH})


def collected(df, *names):
    return sorted((tuple(r) for r in df.select(*names).collect()), key=str)


# --- automata ---------------------------------------------------------------------------


def drawn(draw, n):
    return {tuple(draw.choices([b"a", b"b", b"\x00", b"ab", "é".encode(), b""], k=draw.randint(1, 5))): draw.randint(1, 500) for _ in range(n)}


def contents(t: Transducer) -> dict:
    arcs = np.flatnonzero(t.weight)
    return dict(zip(map(tuple, t.sequences(arcs)), t.weight[arcs].tolist(), strict=True))


def test_union_cut_compose_and_packing_equal_plain_counts():
    draw = random.Random(4)
    for n in (1, 5, 80, 300):
        tables = [drawn(draw, n) for _ in range(4)]
        parts = [from_sequences(sorted(t), [t[s] for s in sorted(t)]) for t in tables]
        total = collections.Counter()
        for t in tables:
            total.update(t)
        joined = union(parts)
        assert contents(joined) == total
        assert contents(Transducer.unpacked(joined.packed())) == total
        assert [joined.sequence(int(i), joined.parents()) for i in np.flatnonzero(joined.weight)] == sorted(map(list, total))
        parents = joined.parents()
        for point in [*map(list, list(total)[:20]), [b"zz"], [b""], [b"a", b"zz"]]:
            at = joined.place(point, parents)
            low, high = contents(joined.cut(0, at, parents)), contents(joined.cut(at, len(joined), parents))
            assert low | high == total and not low.keys() & high.keys()
            assert all(list(s) < point for s in low) and all(list(s) >= point for s in high)
        asked = sorted({*list(total)[::3], (b"no",), (b"a", b"no"), (b"a", b"b", b"a", b"b", b"a", b"a")})
        wanted = from_sequences(asked, [1] * len(asked))
        assert compose(joined, wanted)[np.flatnonzero(wanted.weight)].tolist() == [total.get(s, 0) for s in asked]
    assert contents(union([])) == {} and len(EMPTY) == 0 and contents(Transducer.unpacked(EMPTY.packed())) == {}


def test_blocks_hold_every_phrase_once():
    counted = collocations.phrase_counts({b"en": [b"a b a b" + SPLIT + b"c a b", b"  "], b"de": [b"a"]})
    blocks = list(collocations.blocks_of(counted, 3))
    assert len(blocks) > 2 and contents(union([Transducer.unpacked(b) for _, _, b in blocks])) == contents(counted)
    assert contents(counted)[(b"en", b"a", b"b")] == 3 and contents(counted)[(b"en",)] == 7


# --- collocations -----------------------------------------------------------------------


def plain_collocations(rows, most):
    counts = collections.defaultdict(collections.Counter)
    for _, text, lang, _ in rows:
        low = re.sub("[A-Z]", lambda m: m[0].lower(), text or "")
        for piece in re.split(r"[.,;:!?\x0A-\x0D]", low):
            words = re.findall(r"[^\x20\x09]+", piece)
            for k in range(1, 5):
                for i in range(len(words) - k + 1):
                    counts[lang if lang is not None else "und"][tuple(words[i : i + k])] += 1
    out = []
    for lang, f in counts.items():
        n = sum(c for g, c in f.items() if len(g) == 1)
        often = {g: c for g, c in f.items() if len(g) > 1 and c >= 30}
        found = []
        for g, a in often.items():
            longer = [c for h, c in often.items() if len(h) > len(g) and any(h[i : i + len(g)] == g for i in range(len(h)))]
            if any(100 * c >= 80 * a for c in longer):
                continue
            score, _, left, right = min((2000000 * a // (f[g[:k]] + f[g[k:]]), k, f[g[:k]], f[g[k:]]) for k in range(1, len(g)))
            found.append((-score, -a, " ".join(g).encode(), left, right))
        out += [(lang, i + 1, p.decode(), -a, x, y, n, -s) for i, (s, a, p, x, y) in enumerate(sorted(found)[:most])]
    return sorted(out, key=str)


@pytest.mark.parametrize("arcs", [1 << 20, 400])
def test_collocations_equal_plain_counts(spark, monkeypatch, arcs):
    monkeypatch.setattr(collocations, "RANGE_ARCS", arcs)
    monkeypatch.setattr(collocations, "BLOCK_ARCS", arcs // 2)
    draw = random.Random(7)
    words = ["the", "The", "of", "É", "é", "x y", "\x01", "a-b", "New", "York", "\U0001f600"]
    texts = [" ".join(draw.choices(words, weights=range(11, 0, -1), k=draw.randint(0, 60))).replace("of é", "of.é").replace("a-b the", "a-b\tthe\x0b") for _ in range(400)]
    rows = [(i % 40 or None, t, draw.choice(["en", "en", "", None, "und"]), "s") for i, t in enumerate(texts)]
    rows += [(1, None, "en", "s"), (2, "", None, None), (3, " \t\n.", "xx", "s"), (4, "one one one", "rare", "s"), (5, "on and on " * 3000, "long", "s")]
    got = collected(collocations.collocations(frame(spark, rows).repartition(5), most=40), "lang", "rank", "phrase", "a", "l", "r", "n", "score")
    assert got == plain_collocations(rows, 40) and len(got) > 60


def test_collocation_scores_are_exact(spark):
    big = 3 * 10**15
    counted = spark.createDataFrame(
        [(0, "en", 2, "a b", big - 1), (0, "en", 1, "a", big), (0, "en", 1, "b", big + 1), (0, "en", 3, "a b c", big // 2), (0, "en", 2, "b c", big // 2), (0, "en", 1, "c", big // 2)],
        "range long, lang string, words int, phrase string, f long",
    )
    scored = {r["phrase"]: r for r in collocations.scored(counted).collect()}
    assert scored["a b"]["score"] == 2000000 * (big - 1) // (2 * big + 1)
    assert (scored["a b c"]["l"], scored["a b c"]["r"]) == (big, big // 2)
    assert sorted(r["phrase"] for r in collocations.outermost(collocations.scored(counted)).collect()) == ["a b", "a b c"]


def test_empty_tables(spark):
    none = frame(spark, [])
    assert collocations.collocations(none).collect() == []
    assert spelling.grouped(none).collect() == []
    planned = mixture.scheduled(none)
    assert planned.collect() == [] and mixture.training_order(planned).collect() == []
    blank = frame(spark, [(1, None, None, None), (2, "", "en", "s")])
    assert collocations.collocations(blank).collect() == [] and spelling.grouped(blank).collect() == []
    assert [r["places"] for r in mixture.scheduled(blank).collect()] == [[], []]


# --- mixing -----------------------------------------------------------------------------


def plain_targets(sizes):
    names = sorted(sizes, key=lambda s: (s is None, (s or "").encode()))
    weight = {s: (5, 2, 1)[i % 3] for i, s in enumerate(names)}
    total, stopped = sum(sizes.values()), set()
    while True:
        level = (total - sum(3 * sizes[s] for s in stopped)) / max(1e-300, sum(weight[s] for s in names if s not in stopped))
        more = {s for s in names if s not in stopped and weight[s] * level > 3 * sizes[s]}
        if not more:
            return {s: 3 * sizes[s] if s in stopped else weight[s] * level for s in names}
        stopped |= more


def test_mixture_meets_targets(spark):
    draw = random.Random(3)
    rows = [(i, "w " * int(draw.paretovariate(1.1)), "en", draw.choice(["a", "a", "a", "b", "c", None, "Z", "é"])) for i in range(1500)]
    rows += [(9000 + i, "w", "en", s) for i, s in enumerate(["tiny", "void", "huge"])] + [(9100, "w " * 90_000, "en", "huge"), (9200, "", "en", "void2")]
    rows += [(None, "same words here", "en", "a")] * 40 + [(7, "x y", "en", "b")] * 3 + [(8, None, "en", None), (8, " \t\r\n", "en", None)]
    df = frame(spark, rows)
    planned = mixture.scheduled(df.repartition(7))
    got = planned.withColumn("taken", mixture.taken()).collect()
    assert len(got) == len(rows)
    sizes = collections.Counter()
    for _, text, _, source in rows:
        sizes[source] += len((text or "").split())
    want, used = plain_targets(sizes), collections.Counter()
    for r in got:
        assert r["source_size"] == sizes[r["source"]] and r["target"] == pytest.approx(want[r["source"]], rel=1e-12)
        assert 0 <= r["taken"] <= 3 * r["size"] and all(0 <= p["position"] <= 1 for p in r["places"])
        used[r["source"]] += r["taken"]
    assert all(abs(used[s] - want[s]) <= 0.5 for s in sizes)
    assert sum(want.values()) == pytest.approx(sum(sizes.values()))
    # another layout, the same plan
    again = mixture.scheduled(df.repartition(3)).select(planned.columns)
    assert collected(again, "doc_id", "size", "places") == collected(planned, "doc_id", "size", "places")


def test_curriculum_positions_follow_the_schedules(spark):
    rows = [(i, "w", "en", "abc"[i % 3]) for i in range(3000)]
    order = mixture.training_order(mixture.scheduled(frame(spark, rows)).select("doc_id", "places")).collect()
    assert [r["position"] for r in order] == sorted(r["position"] for r in order)
    early = collections.Counter("abc"[r["doc_id"] % 3] for r in order if r["position"] < 0.5)
    late = collections.Counter("abc"[r["doc_id"] % 3] for r in order if r["position"] >= 0.5)
    # a fades from 7.5 to 2.5, b stays level, c grows from 0.5 to 1.5
    assert early["a"] / late["a"] == pytest.approx(6.25 / 3.75, rel=0.02)
    assert early["b"] / late["b"] == pytest.approx(1, rel=0.02) and early["c"] / late["c"] == pytest.approx(0.75 / 1.25, rel=0.05)


def test_time_at_inverts_broken_lines(spark):
    knots = [(0.0, 0.0), (0.2, 3.0), (0.5, 3.0), (0.7, 0.0), (0.9, 0.0), (1.0, 2.0)]
    area = np.linspace(0, mixture.areas(knots)[-1], 301)
    times = [r[0] for r in spark.createDataFrame([(float(a),) for a in area], "a double").select(mixture.time_at(F.col("a"), knots)).collect()]
    fine = np.linspace(0, 1, 400_001)
    weights = np.interp(fine, *zip(*knots, strict=True))
    sums = np.concatenate([[0], np.cumsum((weights[1:] + weights[:-1]) / 2 * np.diff(fine))])
    assert np.allclose(np.interp(times, fine, sums), area, atol=1e-5) and times == sorted(times)


def test_word_count_of_odd_texts(spark):
    texts = ["", None, " ", "a", " a ", "a\tb\x0bc\x0cd\re\nf", "x y z\x1cw", "é 😀", "w " * 200_000]
    got = spark.createDataFrame([(t,) for t in texts], "t string").select(mixture.word_count(F.col("t"))).collect()
    assert [r[0] for r in got] == [len(re.findall(r"[^\x20\x09-\x0D]+", t or "")) for t in texts]


# --- spelling ---------------------------------------------------------------------------


def plain_words(rows):
    n = collections.Counter()
    for key, text, *_ in rows:
        for run in re.findall("[A-Za-zÀ-ÿ]+", text or ""):
            low = re.sub("[A-Z]", lambda m: m[0].lower(), run)
            h = zlib.crc32(f"{'' if key is None else key}:{low}".encode())
            n[low[: h % len(low)] + low[h % len(low) + 1 :] if h % 31 == 0 else low] += 1
    return {w: c for w, c in n.items() if len(w) >= 7 and c >= 2}


def one_apart(a, b):
    if len(a) > len(b):
        a, b = b, a
    if a == b or len(b) - len(a) > 1:
        return False
    same = next((i for i, (x, y) in enumerate(zip(a, b, strict=False)) if x != y), len(a))
    return a[same + (len(a) == len(b)) :] == b[same + 1 :]


def plain_variants(n):
    near = {w: [v for v in n if one_apart(w, v)] for w in n}
    form = {}
    for w in n:
        best = min(near[w], key=lambda v: (-n[v], v), default=None)
        form[w] = best if best and n[best] >= 10 * n[w] else None
    out = []
    for w in n:
        root = w
        while form[root]:
            root = form[root]
        out.append((w, form[w], root, n[w], len(near[w]), n[form[w]] if form[w] else None))
    return sorted(out, key=str)


COLUMNS = "word", "form", "root", "n", "n_near", "form_n"


def test_spelling_equals_plain_search(spark):
    draw = random.Random(11)
    stems = ["abcabca", "abcabcab", "aaaaaaa", "aaaaaaaa", "éàéàéàé", "Émérite", "committee", "ÿÿÿÿÿÿÿÿ", "×÷×÷×÷×", "verylongwordthatisspelt"]
    pool = []
    for stem in stems:
        for _ in range(12):
            w = list(stem)
            for _ in range(draw.randint(0, 2)):
                i = draw.randrange(len(w))
                w[i : i + 1] = draw.choice([[], ["b"], ["é", w[i]], ["a"]])
            pool.append("".join(w))
    rows = []
    for i in range(120):
        rows.append((draw.choice([i, 5, None]), " ".join(draw.choices(pool + stems * 30, k=60)), "en", "s"))
    rows += [(1, None, None, None), (2, "", "en", "s"), (3, "short x7longenough seven77 ALLCAPSWORD allcapsword", "en", "s")]
    n = plain_words(rows)
    got = collected(spelling.grouped(frame(spark, rows).repartition(5)), *COLUMNS)
    want = plain_variants(n)
    assert got == want and sum(w[1] is not None for w in want) > 5 and sum(w[4] for w in want) > 50


def test_spelling_follows_chains_and_breaks_ties(spark):
    n = {"aaaaaaa": 2, "aaaaaab": 20, "aaaaabb": 200, "aaaabbb": 2000, "aaabbbb": 20_000, "zzzzzzz": 2, "zzzzzzy": 30, "yzzzzzz": 30, "lonely7word": 3}
    words = spark.createDataFrame(list(n.items()), "word string, n long")
    got = {r["word"]: r for r in spelling.variants(words).collect()}
    assert collected(spelling.variants(words), *COLUMNS) == plain_variants(n)
    assert got["aaaaaaa"]["root"] == "aaabbbb" and got["zzzzzzz"]["form"] == "yzzzzzz"


def test_spelling_of_very_long_words_and_many_alike(spark):
    long = "ab" * 30_000
    rows = [(1, f"{long} {long} {long}b {long}b", "en", "s")]
    assert [r["n_near"] for r in spelling.grouped(frame(spark, rows), change=None).collect()] == [1, 1]
    letters = "abcdefghijklmnopqrstuvwxyz"
    n = {f"prefix{x}{y}": 2 for x in letters for y in letters}
    words = spark.createDataFrame(list(n.items()), "word string, n long")
    assert {r["n_near"] for r in spelling.variants(words).collect()} == {50}
