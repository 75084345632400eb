"""Every operator on odd rows, and against a plain version."""

import collections
import hashlib
import html
import random
import re
import tracemalloc

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import Window
from pyspark.sql import functions as F

from emberwatch.llm import bpe, common, decontaminate, html_text, licenses, minhash, queries, quality, secrets, suffix_dedup, topk, toxicity

LONG = "word " * 30_000 + "/" * 20_000
ODD = [(1, None), (2, ""), (3, " \n\t "), (4, LONG), (5, "same text"), (5, "same text"), (None, "no id"), (6, "é😀 ß"), (7, "x" * 50_000)]
CLASH = "_key _text id class score spans batch row text_key _words n shared"


@pytest.fixture(scope="module")
def odd(spark):
    """Null, empty, blank, long, repeated and non-ASCII texts beside columns with clashing names."""
    df = spark.createDataFrame(ODD, "doc_id long, text string")
    return df.withColumns({c: F.lit("clash") for c in CLASH.split()})


@pytest.fixture(scope="module")
def none(spark):
    return spark.createDataFrame([], "doc_id long, text string, lang string, source string, n_chars long")


def rows(df, *names):
    return sorted(map(tuple, df.select(*names).collect()), key=str)


# --- toxicity and quality ---------------------------------------------------------------


def auc(pairs):
    ranks = np.argsort(np.argsort([s for s, _ in pairs]))
    y = np.array([label for _, label in pairs])
    return (ranks[y == 1].sum() - y.sum() * (y.sum() - 1) / 2) / (y.sum() * (1 - y).sum())


@pytest.mark.parametrize("name, label", [("op1_toxicity", "toxic"), ("op8_quality", "quality")])
def test_held_out_accuracy(spark, name, label):
    sf = "/root/testdata/sf0.01"
    scores = queries.QUERIES[name](spark, sf)
    labels = spark.read.parquet(f"{sf}/labels.parquet")
    held = scores.join(labels, "doc_id").where("held_out").select("score", label).collect()
    assert len(held) > 50 and auc([tuple(r) for r in held]) > 0.9
    assert scores.where("score is null or score < 0 or score > 1").count() == 0
    assert scores.count() == spark.read.parquet(f"{sf}/documents.parquet").count()


def test_classifiers_on_odd_rows(spark, odd, none):
    no_labels = spark.createDataFrame([], "doc_id long, toxic int, quality int")
    both = spark.createDataFrame([(1, 1, 1), (4, 0, 0), (5, None, 1), (None, 1, 1)], "doc_id long, toxic int, quality int")
    for labels in (no_labels, both):
        model = toxicity.trained(odd, labels)
        assert toxicity.scored(odd, model).where("score between 0 and 1").count() == len(ODD)
        assert toxicity.clean(odd, model).columns == odd.columns
        values = quality.described(odd)
        assert quality.scored(values, quality.fitted(values, labels)).where("score between 0 and 1").count() == len(ODD)
    assert toxicity.scored(none, toxicity.trained(none, no_labels)).count() == 0
    assert quality.scored(quality.described(none), quality.fitted(quality.described(none), no_labels)).count() == 0


def test_toxicity_learns_from_every_labelled_row(spark):
    """A word that only the last of 4,000 positive rows hold, in the order of the keys' hashes, is known."""
    place = F.row_number().over(Window.partitionBy("toxic").orderBy(F.xxhash64("doc_id")))
    rows = spark.range(8000).select(F.col("id").alias("doc_id"), (F.col("id") % 2).cast("int").alias("toxic"))
    word = F.when(F.col("toxic") == 0, "plain").when(F.col("place") <= 3000, "early").otherwise("latecomer")
    text = F.concat_ws(" ", F.lit("some words"), F.col("doc_id") % 50, word, F.lit("and more"))
    rows = rows.withColumn("place", place).withColumn("text", text)
    model = toxicity.trained(rows.select("doc_id", "text"), rows.select("doc_id", "toxic"))
    asked = spark.createDataFrame([(w, f"some words 7 {w} and more") for w in ("plain", "early", "latecomer")], "doc_id string, text string")
    got = {r["doc_id"]: r["score"] >= 0.5 for r in toxicity.scored(asked, model).collect()}
    assert got == {"plain": False, "early": True, "latecomer": True}


def test_toxicity_training_repeats(spark):
    """Shards hold the same rows whatever the order and partitions of the input."""
    rows = spark.range(7000).selectExpr("id as doc_id", "int(id % 3 = 0) as toxic", "concat('w', id % 97, ' t', id % 3) as text")
    a, b = (toxicity.trained(r.select("doc_id", "text"), r.select("doc_id", "toxic")) for r in (rows, rows.repartition(5).orderBy("text")))
    assert all(np.array_equal(x, y) for x, y in zip([a.e_whole, a.out, a.thresholds], [b.e_whole, b.out, b.thresholds], strict=True))


def test_toxicity_labelled_texts_move_once_and_packed(spark, capsys):
    """Texts are dealt into their shards once, with their labels, and each is packed."""
    rows = spark.range(9000).selectExpr("id as doc_id", "int(id % 3 = 0) as toxic", "repeat(concat('word', id % 97, ' '), 90) as text")
    placed, weights, shards = toxicity.labelled(rows.select("doc_id", "text"), rows.selectExpr("string(doc_id) as doc_id", "toxic"), "doc_id", "text", "toxic")
    placed.explain("formatted")
    plan = capsys.readouterr().out
    assert shards == 2 and placed.rdd.getNumPartitions() == 2 and weights == {0: 1.0, 1: 1.0}
    exchanges = re.findall(r"\) Exchange\nInput \[\d+\]: \[(.*)\]\nArguments: (\w+)", plan)
    assert [kind for columns, kind in exchanges if "_text" in columns] == ["hashpartitioning"]
    got = placed.selectExpr("count(*) as n", "sum(length(_text)) as size", "count_if(_label = 1) as toxic").first()
    assert (got["n"], got["toxic"]) == (9000, 3000) and 4 * got["size"] < rows.selectExpr("sum(length(text))").first()[0]


def test_toxicity_words_are_hashed_together(monkeypatch):
    draw = random.Random(5)
    texts = [" ".join("".join(draw.choices("abcdefgh", k=draw.randint(1, 9))) for _ in range(2_000)) for _ in range(3)]
    texts += ["", " \n\t ", "Für THE der of-des 7x", "w" * 300 + " " + "v" * 64 + " " + "u" * 65, "é😀 ß", "a", "\0which\0", "und"] + [" ".join(sum(toxicity.COMMON.values(), []))]
    raw = [t.encode() for t in texts]
    plain = [common.alnum_words(t) for t in raw]
    model = toxicity.Model.of_rows((np.arange(toxicity.BUCKETS) % 50, 50), (np.arange(toxicity.BUCKETS) % 30, 30))
    model.bias = np.float32(0.25)
    names = {w.encode(): i for i, name in enumerate(toxicity.LANGUAGES) for w in toxicity.COMMON.get(name, ())}
    crc, calls = toxicity.zlib.crc32, []

    class Counted:
        @staticmethod
        def crc32(*args):
            calls.append(args)
            return crc(*args)

    monkeypatch.setattr(toxicity, "zlib", Counted)
    logits, languages = toxicity.Tables(model).logits(raw)
    assert len(calls) <= 2  # the words of 300 and 65 bytes

    words = toxicity.Words(raw)
    flat = [w for own in plain for w in own]
    assert words.sizes.tolist() == [len(own) for own in plain]
    assert words.whole.tolist() == [crc(w) for w in flat]
    assert words.stem.tolist() == [crc(w[: toxicity.STEM_BYTES], 77) for w in flat]
    assert words.languages().tolist() == [names.get(w, 0) for w in flat]
    for own, logit, language in zip(plain, logits, languages, strict=True):
        x = np.array([model.e_whole[crc(w) % toxicity.BUCKETS % 50] + model.e_stem[crc(w[:4], 77) % toxicity.BUCKETS % 30] for w in own]).reshape(-1, toxicity.DIM)
        most = []
        for k, width in enumerate(toxicity.WIDTHS):
            c = [sum(x[i + j] @ model.filters[k][j] for j in range(width)) + model.shift[k] for i in range(len(x) - width + 1)]
            most.append(np.maximum(np.max(c, axis=0), 0) if c else np.zeros(toxicity.FILTERS))
        assert logit == pytest.approx(np.concatenate(most) @ model.out + model.bias, abs=1e-4)
        votes = np.bincount([names.get(w, 0) for w in own], minlength=len(toxicity.LANGUAGES))
        votes[0] = 0
        assert language == votes.argmax()


# --- top-k ------------------------------------------------------------------------------


def test_topk_equals_brute_force(spark, monkeypatch):
    monkeypatch.setattr(topk, "SHARD_ROWS", 60)
    draw = np.random.default_rng(5)
    data = {i: np.round(draw.normal(0, 0.3, 12), 2).tolist() for i in range(300)}
    for i in range(0, 300, 7):
        data[i] = data[14]  # many equal vectors: ties go to the smaller id
    table = [(i, v, "x") for i, v in data.items()] + [(14, data[14], "again")]
    table += [(900, None, "n"), (1000, [float("nan")] * 12, "n"), (1100, [None] + [0.1] * 11, "n"), (None, [0.1] * 12, "n"), (1200, [float("inf")] * 12, "n")]
    df = spark.createDataFrame(table, "vec_id long, embedding array<double>, shard string")
    got = rows(topk.searched(df, F.col("_id") % 20 == 0, k=10), "query_id", "rank", "vec_id", "score")
    q = {i: np.floor(np.array(v) * 1024).astype(int) for i, v in data.items()}
    want = []
    for a in q:
        if a % 20 == 0:
            best = sorted((-int(q[a] @ q[b]), b) for b in q if b != a)[:10]
            want += [(a, r + 1, b, -s) for r, (s, b) in enumerate(best)]
    assert got == sorted(want, key=str)


def test_topk_with_few_rows(spark):
    df = spark.createDataFrame([(0, [1.0]), (1, [-1.0])], "vec_id long, embedding array<double>")
    assert rows(topk.searched(df, F.col("_id") == 0), "query_id", "rank", "vec_id", "score") == [(0, 1, 1, -(1024 * 1024))]
    assert topk.searched(df.limit(0), F.col("_id") == 0).count() == 0


# --- secrets ----------------------------------------------------------------------------


def test_secret_spans(spark, odd, none):
    key = "k9Jx2Lq8Zr4Tn7Wb1Vy6Hc3Md5"
    texts = {
        1: 'é password="abcdefgh12" token=secret:abcdefgh',
        2: "AKIAABCDEFGHIJKL AKIAABC 0123456789abcdef0123456789abcdef",
        3: f"signing bearer {key} end",
        4: "the session_id 1234567890123456 and username123username",
        5: "PassWD : short api-key= 'longenough1'",
    }
    df = spark.createDataFrame(list(texts.items()), "doc_id long, text string")
    got = {r["doc_id"]: [tuple(s) for s in r["spans"]] for r in secrets.scanned(df).collect()}
    assert got[1] == [("assign", 2, 22)]  # the second match is too short and still covers the third
    assert got[2] == [("access", 0, 16), ("hex", 25, 57)]
    assert got[3] == [("novel", 15, 15 + len(key))]
    assert got[4] == []
    assert got[5] == []  # one value is too short, one key has a hyphen
    out = {r["doc_id"]: r["text"] for r in secrets.redacted(df).collect()}
    assert out[3] == "signing bearer [SECRET] end" and out[4] == texts[4]
    assert secrets.scanned(odd).count() == len(ODD) and secrets.redacted(odd).columns == odd.columns
    assert secrets.scanned(none).count() == 0


def test_secret_base_patterns_equal_plain_matching():
    draw = random.Random(3)
    parts = ["password", "Token", "api_key", "APIKEY", "=", ": ", '"', "'", "AKIA", "ABCDEFGH12345678", "0123456789abcdef", "deadbeef" * 4, " ", "é", "x"]
    for _ in range(2000):
        text = "".join(draw.choice(parts) for _ in range(draw.randint(1, 14)))
        raw = text.encode()
        got = sorted(secrets.base_spans(raw, text, raw.lower()))
        want = [(m.start(), m.end(), "assign") for m in secrets.ASSIGN.finditer(text) if len(m[2]) >= 8]
        want += [(m.start(), m.end(), "access") for m in secrets.ACCESS.finditer(text) if len(m[0]) >= 16]
        want += [(m.start(), m.end(), "hex") for m in secrets.HEX.finditer(text) if len(m[0]) >= 32]
        assert got == sorted(want)


KEY = "wJ4lrXUtnF3MI7K9mDENGbPxR2fiCYqT8hVs5Lz0"


@pytest.mark.parametrize(
    "before, value, after",
    [
        ("export AWS_SECRET_ACCESS_KEY=", KEY, "\n"),
        ("private_key=", KEY, ""),
        ("https://host.example/page?session_id=", KEY, "&x=1"),
        ("env --set=SIGNING_NAME_2=", KEY, "=="),
        ("DB_PASSWORD=short\nAWS_SECRET_ACCESS_KEY=", KEY, "\nREGION=eu"),
    ],
)
def test_secret_of_an_unquoted_assignment(before, value, after):
    spans = secrets.spans_of((before + value + after).encode(), secrets.Novelty())
    assert spans == [(len(before), len(before) + len(value), "novel")]


def test_secret_that_holds_a_base_span():
    hexes = "0123456789abcdef" * 2
    text = f"credential {KEY}X{hexes} end"
    a = text.index(hexes)
    assert secrets.spans_of(text.encode(), secrets.Novelty()) == [(11, a, "novel"), (a, a + 32, "hex")]
    text = f"AWS_SECRET_TOKEN={KEY}"  # the base span covers the value, and the name is none
    assert secrets.spans_of(text.encode(), secrets.Novelty()) == [(11, len(text), "assign")]


@pytest.mark.parametrize("between", [" and ", "\n" + "plain words of the page " * 60 + "\n"])
def test_secret_that_stands_twice(between):
    text = f"signing bearer {KEY}{between}x/{KEY}/y token: {KEY}"
    places = [m.start() for m in re.finditer(KEY, text)]
    found = secrets.spans_of(text.encode(), secrets.Novelty())
    covered = {i for a, b, _ in found for i in range(a, b)}
    assert len(places) == 3 and all(set(range(p, p + len(KEY))) <= covered for p in places)
    assert KEY not in "".join(c for i, c in enumerate(text) if i not in covered)


# --- near-duplicates ----------------------------------------------------------------------


def plain_components(texts):
    sets = {}
    for i, t in texts.items():
        w = (t or "").encode().lower().split()
        sets[i] = {tuple(w[j : j + 5]) for j in range(len(w) - 4)} if len(w) >= 5 else {tuple(w)} if w else set()
    root = {i: i for i in texts}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    ids = sorted(texts)
    for x, i in enumerate(ids):
        for j in ids[:x]:
            both = len(sets[i] & sets[j])
            if both and 100 * both >= 85 * (len(sets[i]) + len(sets[j]) - both):
                a, b = find(i), find(j)
                root[max(a, b)] = min(a, b)
    return [(i, len(sets[i]), find(i), i == find(i)) for i in ids]


def test_near_duplicates_equal_brute_force(spark, monkeypatch):
    monkeypatch.setattr(minhash, "BLOCK_ROWS", 8)
    draw = random.Random(11)
    base = [draw.choice("alpha beta gamma delta eps zeta eta theta".split()) + str(draw.randint(0, 999)) for _ in range(120)]
    texts = {0: None, 1: "", 2: "Two words", 3: "two  WORDS", 4: "two words more"}
    for i in range(10, 70):  # a family around the threshold: zero to eight edits each
        words = list(base)
        for _ in range(draw.randint(0, 8)):
            words[draw.randrange(len(words))] = f"edit{draw.random()}"
        texts[i] = " ".join(words)
    for i in range(70, 76):
        texts[i] = texts[10]
    df = spark.createDataFrame(list(texts.items()), "doc_id long, text string").withColumn("band", F.lit(1))
    got = rows(minhash.grouped(df), "doc_id", "n_shingles", "component_id", "kept")
    assert got == sorted(plain_components(texts), key=str)
    kept = {r["doc_id"] for r in minhash.deduplicated(df).collect()}
    assert kept == {i for i, _, c, _ in plain_components(texts) if i == c}


def test_near_duplicates_on_odd_rows(spark, odd, none):
    got = collections.Counter((r["doc_id"], r["component_id"], r["kept"]) for r in minhash.grouped(odd).collect())
    assert got[5, 5, True] == 2 and got[None, None, True] == 1 and got[2, 2, True] == 1 and sum(got.values()) == len(ODD)
    out = minhash.deduplicated(odd)
    assert out.columns == odd.columns and out.where("doc_id = 5").count() == 1 and out.count() == len(ODD) - 1
    assert minhash.grouped(none).count() == 0 and minhash.deduplicated(none).count() == 0


def test_signatures_hold_the_words_of_few_texts(spark, monkeypatch):
    """A batch of 8 MB is split into words piece by piece: words take ten times the memory of their text."""
    grabbed = []
    monkeypatch.setattr(minhash, "map_keyed", lambda rows, run, columns, key: grabbed.append(run))
    minhash.signatures(spark.createDataFrame([], "doc_id long, text string"), "doc_id", "text")
    draw = random.Random(3)
    texts = [b" ".join(b"w%d" % draw.randrange(10**6) for _ in range(5_000)) for _ in range(200)]
    batch = pd.DataFrame({"id": range(200), "text_key": range(200), "_text": texts})
    tracemalloc.start()
    try:
        got = pd.concat(grabbed[0](iter([batch])))
        peak = tracemalloc.get_traced_memory()[1]
    finally:
        tracemalloc.stop()
    assert got["id"].tolist() == list(range(200)) and got["n"].min() > 4_900
    assert peak < 3 * sum(map(len, texts))


def anonymous_mb():
    with open("/proc/self/smaps_rollup") as found:
        return sum(int(line.split()[1]) for line in found if line.startswith("Anonymous:")) / 1024


def test_a_task_gives_its_memory_back():
    """What a task freed goes back to the system although something above it is still in use."""
    kept = []

    def run(batches):
        for n in batches:
            held = [np.ones(30_000, np.uint8) for _ in range(n)]
            kept.append(np.ones(30_000, np.uint8))
            yield len(held)

    before = anonymous_mb()
    assert list(common.released(run)(iter([6_000]))) == [6_000]
    assert anonymous_mb() - before < 90


def test_near_duplicates_with_null_and_shared_keys(spark):
    """Unrelated texts without a key, or under one key, are groups of their own."""
    unlike = [" ".join(f"{w}{i}" for i in range(20)) for w in ("red", "green", "blue", "grey")]
    table = [(None, unlike[0]), (None, unlike[0]), (None, unlike[1]), (7, unlike[2]), (7, unlike[3]), (8, unlike[3]), (None, unlike[3]), (None, " ")]
    out = minhash.deduplicated(spark.createDataFrame(table, "doc_id long, text string"))
    assert rows(out, "doc_id", "text") == sorted([(None, unlike[0]), (None, unlike[1]), (7, unlike[2]), (7, unlike[3]), (None, " ")], key=str)


# --- licenses -----------------------------------------------------------------------------


def test_license_places_and_labels(spark, odd, none):
    texts = {
        1: "CC-BY stuff, cc by. All Rights\nReserved! cc-by-nc 4.0",
        2: "Licensed under the GNU General Public License, version 3 or later.",
        3: "Released under the MIT License. Licensed under the Apache License, Version 2.0.",
        4: "the accby general public licenses",
        5: "Mit freundlichen",
        6: "İ CC BY",
    }
    df = spark.createDataFrame(list(texts.items()), "doc_id long, text string")
    got = {r["doc_id"]: r for r in licenses.scanned(df).collect()}
    assert got[1][1:6] == (13, 4, 0, 8, ["cc-by", "reserved"])
    assert "gpl-3.0" in got[2]["labels"] and [s["label"] for s in got[2]["spans"]] == ["licensed", "gpl-3.0"]
    assert got[2][2:6] == (1, 4, 4, ["gpl"])
    assert {"mit", "apache-2.0"} <= set(got[3]["labels"]) and "apache" not in got[3]["labels"]
    assert got[4][2:7] == (0, None, None, [], []) and got[5]["labels"] == [] and got[5]["score"] == 0
    assert got[6][1:6] == (3, 1, 1, 1, ["cc-by"])
    odd_rows = licenses.scanned(odd).collect()
    assert len(odd_rows) == len(ODD) and {r["n_words"] for r in odd_rows if r["doc_id"] in (1, 2, 3)} == {0}
    assert licenses.scanned(none).count() == 0
    assert len(licenses.RULES) > 300


def test_license_rules_with_repeats(spark):
    df = spark.createDataFrame([(1, "cc by " * 3000 + "mit license " * 500)], "doc_id long, text string")
    row = licenses.scanned(df).first()
    assert row["n_base"] == 3000 and row["last_word"] == 5998 and {"cc-by", "mit"} <= set(row["labels"])


def alternatives(pattern):
    """Strings that the pattern matches: every alternative, option and character class taken at least once."""
    from re import _parser

    def join(parts):  # the first of each, and every other one beside the first of the rest
        first = "".join(p[0] for p in parts)
        return [first] + ["".join(q[0] for q in parts[:i]) + x + "".join(q[0] for q in parts[i + 1 :]) for i, p in enumerate(parts) for x in p[1:]]

    def of(tree):
        parts = []
        for kind, value in tree:
            kind = str(kind)
            if kind == "LITERAL":
                parts.append([chr(value)])
            elif kind == "IN":
                chars = [chr(v) if str(k) == "LITERAL" else {"CATEGORY_NOT_SPACE": "x", "CATEGORY_DIGIT": "2"}[str(v)] for k, v in value]
                parts.append(chars)
            elif kind == "SUBPATTERN":
                parts.append(of(value[3]))
            elif kind == "BRANCH":
                parts.append([x for b in value[1] for x in of(b)])
            elif kind in ("MAX_REPEAT", "MIN_REPEAT"):
                low, _, inner = value
                inner = of(inner)
                parts.append([x * max(low, 1) for x in inner] + ([""] if low == 0 else []))
            else:
                assert kind == "ASSERT_NOT", kind
        return join(parts)

    return [x for x in dict.fromkeys(of(_parser.parse(pattern))) if re.fullmatch(pattern, x)]


def test_license_gates_lose_no_match(spark, monkeypatch):
    """With and without the gates the spans agree on a string for every alternative of every rule."""
    made = [x for _, _, _, pattern in licenses.RULES for x in alternatives(pattern)]
    assert all(alternatives(pattern) for _, _, _, pattern in licenses.RULES)
    for word in ("without any warranty", "distributed under the x license", "bsd style licence", "mit like license", "zlib libpng license"):
        assert word in made
    df = spark.createDataFrame([(i, x) for i, x in enumerate(dict.fromkeys(made))], "doc_id long, text string").repartition(8)
    gated = rows(licenses.scanned(df), "doc_id", "labels", "spans", "score")
    monkeypatch.setattr(licenses, "RULES", [(label, priority, "", pattern) for label, priority, _, pattern in licenses.RULES])
    words = sorted({w for x in made for w in x.split()})
    monkeypatch.setattr(licenses, "_gate_words", lambda: words)
    assert gated == rows(licenses.scanned(df), "doc_id", "labels", "spans", "score")
    assert all(spans for _, _, spans, _ in gated)


# --- suffix de-duplication ------------------------------------------------------------------


def plain_repeats(texts):
    seen = collections.Counter(t[s : s + 200] for t in texts for s in range(len(t) - 199))
    out = []
    for t in texts:
        gone = bytearray(len(t))
        for s in range(len(t) - 199):
            if seen[t[s : s + 200]] > 1:
                gone[s : s + 200] = b"\1" * 200
        rest = bytes(c for c, g in zip(t, gone, strict=True) if not g)
        out.append((len(t), sum(gone), len(re.findall(b"\1+", bytes(gone))), hashlib.sha256(rest).hexdigest()))
    return out


@pytest.mark.parametrize("batch, part", [(8 << 20, 1 << 17), (1500, 700)])
def test_repeats_equal_brute_force(spark, monkeypatch, batch, part):
    monkeypatch.setattr(suffix_dedup, "BATCH_BYTES", batch)
    monkeypatch.setattr(suffix_dedup, "PART", part)
    draw = random.Random(7)
    letters = lambda n: "".join(draw.choice("abcdefghij ") for _ in range(n))
    passage = letters(230)
    texts = [letters(300) + passage + letters(50) for _ in range(6)]
    texts += [passage[:199] + letters(99), letters(40) + passage[20:] + passage[:210], "ab" * 400, "", "short", "é" * 300, passage, letters(3000)]
    texts += [texts[0], letters(900)]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(3)
    got = rows(suffix_dedup.without_repeats(df, keep_text=False), "doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256")
    assert got == sorted([(i, *r) for i, r in enumerate(plain_repeats([t.encode() for t in texts]))], key=str)


def test_repeats_on_odd_rows(spark, odd, none):
    found = suffix_dedup.without_repeats(odd).collect()
    assert len(found) == len(ODD)
    by_id = {r["doc_id"]: r for r in found}
    assert by_id[1]["n_bytes"] == 0 and by_id[7]["n_removed"] == 50_000 and by_id[5]["n_removed"] == 0
    assert bytes(by_id[6]["kept"]).decode() == "é😀 ß"
    assert suffix_dedup.without_repeats(none).count() == 0


def test_blocks_of_samples_are_of_like_size():
    text = np.random.default_rng(3).integers(97, 123, 1 << 20, dtype=np.uint8).tobytes()
    records = suffix_dedup.Batch([text]).records()
    sizes = [len(r) // records.itemsize for _, r in suffix_dedup._by_block(records, "bucket", 40)]
    assert sum(sizes) == len(records) and max(sizes) < 2 * len(records) / 40


# --- decontamination ------------------------------------------------------------------------


def plain_hits(docs, items, window=10):
    split = lambda t: re.findall(rb"[0-9a-z\x80-\xff]+", (t or "").encode().translate(bytes(c + 32 if 65 <= c <= 90 else c for c in range(256))))
    windows = []
    for key, text in items:
        w = split(text)
        n = min(window, len(w))
        windows += [(key, tuple(w[i : i + n])) for i in range(len(w) - n + 1) if n]
    out = []
    for key, text in docs:
        w, hit, found = split(text), set(), set()
        for item, win in windows:
            for i in range(len(w) - len(win) + 1):
                if tuple(w[i : i + len(win)]) == win:
                    hit.update(range(i, i + len(win)))
                    found.add(str(item))
        out.append((key, len(w), len(hit), sorted(found)))
    return out


def test_decontamination_equals_brute_force(spark, monkeypatch, none):
    monkeypatch.setattr(decontaminate, "SHARD_BYTES", 400)
    monkeypatch.setattr(decontaminate, "BLOCK_BYTES", 150)  # several blocks of items
    draw = random.Random(2)
    vocabulary = "the of and to é1 in is it for on".split()
    text = lambda n: " ".join(draw.choice(vocabulary) for _ in range(n))
    items = [(i, text(draw.choice([3, 9, 10, 14, 25]))) for i in range(12)] + [(50, ""), (51, None), (3, "Rare words only")]
    docs = [(i, text(draw.randint(0, 60))) for i in range(40)]
    docs += [(100 + i, f"{text(5)} {items[i][1].upper()}, {text(5)}") for i in range(12)] + [(200, None), (201, "rare, WORDS only!")]
    d = spark.createDataFrame(docs, "doc_id long, text string").withColumn("items", F.lit(0))
    b = spark.createDataFrame(items, "item_id long, text string")
    got = rows(decontaminate.contamination(d, b), "doc_id", "n_words", "n_hit", "items")
    want = plain_hits(docs, items)
    assert got == sorted(want, key=str)
    kept = {r["doc_id"] for r in decontaminate.decontaminated(d, b).collect()}
    assert kept == {k for k, _, n, _ in want if not n}
    assert decontaminate.contamination(d, b.limit(0)).where("n_hit > 0").count() == 0
    assert decontaminate.contamination(none, b).count() == 0


def test_longest_match(spark):
    words = [f"w{i}" for i in range(30)]
    b = spark.createDataFrame([(1, " ".join(words))], "item_id long, text string")
    d = spark.createDataFrame([(1, "x " + " ".join(words[5:20]) + " y")], "doc_id long, text string")
    row = decontaminate.contamination(d, b).first()
    assert [tuple(m) for m in row["matches"]] == [("1", 1, 15, 15)] and row["n_hit"] == 15


def test_decontamination_on_odd_rows(spark, odd):
    b = spark.createDataFrame([(1, "same text")], "item_id long, text string")
    got = decontaminate.contamination(odd, b).where("n_hit > 0").collect()
    assert [(r["doc_id"], r["n_hit"]) for r in got] == [(5, 2), (5, 2)]


# --- encoding -------------------------------------------------------------------------------


def test_encoding_equals_the_library(spark, odd, none):
    tokenizers = pytest.importorskip("tokenizers")
    spec = queries.tokenizer_spec()
    library = tokenizers.Tokenizer.from_str(spec)
    library.no_truncation()
    library.no_padding()
    texts = [r["text"] for r in spark.read.parquet("/root/testdata/sf0.001/documents.parquet").collect()]
    draw = random.Random(4)
    texts += ["", "Don't <|endoftext|>x<|startoftext|> ΣΑΣ İ \x1c ½²", "日本語 한국어 😀🇺🇸", "́abc a　b​c", "a" * 500, "!?" * 300, "\x00\x7f"]
    texts += ["".join(draw.choice("abcdefghijklmnopqrstuvwxyz '.éß1") for _ in range(120)) for _ in range(300)]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = {r["doc_id"]: r for r in bpe.encoded(df, spec).collect()}
    for i, t in enumerate(texts):
        ids = library.encode(t, add_special_tokens=False).ids
        assert bytes(got[i]["ids"]) == np.array(ids, "<u4").tobytes() and got[i]["n_tokens"] == len(ids)
        assert got[i]["decoded"] == library.decode(ids, skip_special_tokens=False)
    assert bpe.encoded_digests(odd, spec).count() == len(ODD) and bpe.encoded(none, spec).count() == 0


# --- pages ----------------------------------------------------------------------------------


def test_page_text_of_the_given_pages(spark):
    found = html_text.extracted(spark.read.parquet("/root/testdata/sf0.001/pages.parquet").withColumn("_key", F.lit(0)))
    pages = {r["page_id"]: r["html"] for r in spark.read.parquet("/root/testdata/sf0.001/pages.parquet").collect()}
    for r in found.collect():
        body = pages[r["page_id"]].split("<article>")[1].split("</article>")[0]
        parts = [" ".join(html.unescape(re.sub(r"<[^>]+>", "", x)).split()) for x in re.split(r"</?(?:p|h1)>|<br><p>", body)]
        assert r["text"] == "\n".join(p for p in parts if p) and r["n_chars"] == len(r["text"])


@pytest.mark.parametrize(
    "page, want",
    [
        (None, ""),
        ("", ""),
        ("just text", "just text"),
        ("<p>One &lt;b&gt; line\n of  text<br>goes on.</p><script>x='</p>'</script>", "One <b> line of text goes on."),
        (
            "<body class='has-sidebar'><header><h1>Site</h1></header><nav><a href=x>Home</a></nav><div id=cookie-notice>We use cookies"
            " for the best of all that is on the site.</div><article><h1>Title</h1><p>The first part of the text is here and is long"
            " enough.<p>Short.<aside>Buy the thing now and be happy with it</aside><form><p>Send the form to us</form><p>The last of"
            " the parts is this one.</article><section class='comments'><p>I like the text and it is good for me</p></section>"
            "<footer>of the site</footer>",
            "Title\nThe first part of the text is here and is long enough.\nShort.\nThe last of the parts is this one.",
        ),
        ("<ul><li><a href=a>One</a></li><li><a href=b>Two</a></li></ul><div>The text of the page is here, and it is all that there is.</div>", "The text of the page is here, and it is all that there is."),
        ("<p hidden>the secret of the page</p><p>Text <a href='x'>link</a> of the page that is in the open here.", "Text link of the page that is in the open here."),
    ],
)
def test_page_rules(page, want):
    assert html_text.main_text(page) == want


LINE = "The first part of the text is here and is long enough for it."


@pytest.mark.parametrize("names", ["class='site has-sidebar'", "class=no-sidebar", "class='layout-sidebar-right'", "id=with-menu", "class='sidebar page'"])
@pytest.mark.parametrize("name", ["div", "span"])
@pytest.mark.parametrize("inner", ["article", "main", "div"])
def test_page_wrappers_keep_the_article(names, name, inner):
    page = f"<{name} {names}><{inner}><h1>Title</h1><p>{LINE}</p></{inner}></{name}><div class=sidebar><p>All of the offers of the day.</p></div>"
    assert html_text.main_text(page) == f"Title\n{LINE}"


def test_page_ids_of_an_article():
    body = f"<h2 id='related-work'>Related work</h2><section id='legal-history'><p>{LINE}</p></section><p id='social-effects'>{LINE}</p>"
    assert html_text.main_text(f"<article>{body}</article>") == f"Related work\n{LINE}\n{LINE}"
    rest = f"<section class=comments><article><p>{LINE * 9}</p></article></section><div id=related-posts><p>{LINE}</p></div>"
    for page in (f"<article>{body}</article>{rest}", f"<article>{body}{rest}</article>"):
        assert html_text.main_text(page) == f"Related work\n{LINE}\n{LINE}"


def test_pages_on_odd_rows(spark):
    pages = [(1, "u", None), (None, None, "<p>The text is here for all of the readers.</p>"), (2, "u", "<a " * 20_000), (3, "u", "<div>" * 20_000 + "x")]
    df = spark.createDataFrame(pages, "page_id long, url string, html string").withColumn("text", F.lit("clash"))
    got = {r["page_id"]: r["text"] for r in html_text.extracted(df).collect()}
    assert got[1] == "" and got[None].startswith("The text") and got[3] == "x"
    assert html_text.extracted(df.limit(0)).count() == 0


# --- keys -------------------------------------------------------------------------------

BIG = [9007199254740993, 9007199254740995, -9007199254740993, None]


def test_whole_number_keys_keep_every_digit(spark):
    """Keys beyond 2^53 beside a null, in one batch, through every operator."""
    passage = " ".join(f"word{i}" for i in range(60))
    docs = spark.createDataFrame([(k, f"{passage} own{i % 2} token = abcdefgh1234") for i, k in enumerate(BIG)], "doc_id long, text string").coalesce(1)
    labels = spark.createDataFrame([(BIG[0], 1, 1), (BIG[1], 0, 0)], "doc_id long, toxic int, quality int")
    bench = spark.createDataFrame([("i", passage)], "item_id string, text string")
    values = quality.described(docs)
    results = {
        "toxicity": toxicity.scored(docs, toxicity.trained(docs, labels)),
        "secrets": secrets.scanned(docs),
        "minhash": minhash.grouped(docs),
        "suffix_dedup": suffix_dedup.without_repeats(docs),
        "decontaminate": decontaminate.contamination(docs, bench),
        "described": values,
        "quality": quality.scored(values, quality.fitted(values, labels)),
        "bpe": bpe.encoded_digests(docs, queries.tokenizer_spec()),
        "html": html_text.extracted(docs.selectExpr("doc_id as page_id", "'u' as url", "text as html")).withColumnRenamed("page_id", "doc_id"),
    }
    for name, got in results.items():
        assert got.schema["doc_id"].dataType == docs.schema["doc_id"].dataType, name
        assert sorted(map(str, (r[0] for r in got.select("doc_id").collect()))) == sorted(map(str, BIG)), name
    assert {r["component_id"] for r in results["minhash"].collect()} == {-9007199254740993}


@pytest.mark.parametrize("label", [0, 1])
def test_one_class_of_labels_drops_no_document(spark, odd, label):
    labels = spark.createDataFrame([(1, label), (4, label), (5, label)], "doc_id long, toxic int")
    assert toxicity.clean(odd, toxicity.trained(odd, labels)).count() == len(ODD)


def test_documents_without_words_stay(spark, odd):
    model = toxicity.Model([np.array([1]), np.array([2])], [np.array([1]), np.array([2])])
    model.thresholds[:] = -1e9  # everything with words would go
    assert {r[0] for r in toxicity.clean(odd, model).select("text").collect()} == {None, "", " \n\t "}


def test_shingles_of_many_texts_are_those_of_each(monkeypatch):
    monkeypatch.setattr(minhash, "MIX_WORDS", 20)
    draw = random.Random(2)
    texts = [[b"w%d" % draw.randrange(9) for _ in range(draw.choice([0, 1, 3, 4, 5, 6, 30, 70]))] for _ in range(80)]
    assert all((a == minhash.shingles(t)).all() and len(a) == len(minhash.shingles(t)) for a, t in zip(minhash.all_shingles(texts), texts, strict=True))


PARAGRAPH = "<p>The quick fox is in the house and it was not at all that bad for the people of the town.</p>"


@pytest.mark.parametrize("holder", ["form id=aspnetForm", "fieldset", "form class=search"])
def test_html_keeps_the_article_inside_a_form(holder):
    """A whole page may lie in one form; other forms go, whether the article is beside or around them."""
    article, asked = f"<article><h1>Title</h1>{PARAGRAPH}</article>", "<div>Your name is not shown to the people that are in here</div>"
    name = holder.split()[0]
    whole = html_text.main_text(f"<{holder}>{asked}{article}</{name}>")
    assert whole == html_text.main_text(article) and whole.startswith("Title\nThe quick")
    assert html_text.main_text(f"<{holder}>{asked}</{name}>{article}") == whole
    assert html_text.main_text(f"<article><h1>Title</h1>{PARAGRAPH}<{holder}>{asked}</{name}></article>") == whole
    assert html_text.main_text(f"{article}<{holder}><article>{asked}</article></{name}>") == whole


@pytest.mark.parametrize("name,left", [("button", 3), ("svg", 3), ("video", 3), ("select", 3), ("script", 1), ("style", 1)])
def test_html_unclosed_elements(name, left):
    """Without its end tag an element takes nothing with it, unless its content is text by definition."""
    assert html_text.main_text(f"<article>{PARAGRAPH}<{name}>{PARAGRAPH}{PARAGRAPH}</article>").count("fox") == left


@pytest.mark.parametrize("page", ["<div>" * 60000 + "</ul>" * 60000, "<span class=share>x " * 60000, "<button>" * 60000 + "</svg>" * 60000], ids=["ends", "spans", "buttons"])
def test_html_long_broken_pages_take_linear_time(page):
    import time

    begin = time.time()
    assert "The quick fox" in html_text.main_text(page + PARAGRAPH)
    assert time.time() - begin < 20
