"""Line dedup, near-dedup, decontamination and language ID against plain versions."""

import collections
import math
import os
import random

import numpy as np
import pyarrow as pa
import pytest

from profusion.llm import decontamination, language_id, line_dedup, near_dedup
from tests.llm import helpers as H

VOCABULARY = [f"w{i}" for i in range(400)]


def prose(r, n):
    return " ".join(r.choice(VOCABULARY) for _ in range(n))


def edited(r, text, share):
    return " ".join(r.choice(VOCABULARY) if r.random() < share else w for w in text.split())


# Line dedup


def test_perfect_hash():
    keys = np.random.default_rng(1).integers(0, 2**63, 20_000).astype(np.uint64)
    perfect = line_dedup.PerfectHash.build(keys)
    assert sorted(perfect.index(keys)) == list(range(len(keys)))
    assert line_dedup.PerfectHash.build(keys[:0]).index(keys[:3]).tolist() == [-1] * 3


def test_line_dedup(spark, monkeypatch):
    monkeypatch.setattr(line_dedup, "SHARD_KEYS", 7)
    r = random.Random(3)
    lines = [prose(r, 3) for _ in range(60)] + ["short", "", "  ", "ÉCOLE des mines", "école des mines"]
    texts = ["\n".join(r.choice([x, x.upper(), f" {x}\t"]) for x in r.choices(lines, k=r.randint(1, 12))) for _ in range(80)] + H.ODD + [None]
    want = H.line_dedup(dict(enumerate(texts)))
    got = {x["doc_id"]: (x["n_lines"], x["n_dropped"], x["kept_sha256"]) for x in line_dedup.line_digests(H.documents(spark, texts)).collect()}
    assert got == {i: (n, k, H.sha256(t)) for i, (n, k, t) in want.items()}
    full = line_dedup.dedup_lines(H.documents(spark, texts).selectExpr("*", "1 AS n_lines", "2 AS id", "array(1) AS drop"))
    assert {x["doc_id"]: x["text"] for x in full.collect()} == {i: t for i, (_, _, t) in want.items()}
    assert full.columns[:6] == ["doc_id", "text", "lang", "source", "n_chars", "n_lines"] and full.columns[-2:] == ["n_lines_", "n_dropped"]
    assert {x["n_lines"] for x in full.collect()} == {1}


def test_hot_lines_are_salted(spark, monkeypatch):
    """A line that all documents hold goes to several copies of its shard's arrays; columns of the operator's own names pass through."""
    monkeypatch.setattr(line_dedup, "SHARD_KEYS", 7)
    docs = H.documents(spark, [f"a line that all of them hold\nown line number {i}" for i in range(300)])
    keys = docs.selectExpr("doc_id AS id", "text").mapInArrow(line_dedup._document_keys(10), line_dedup.KEYS)
    shards, n = line_dedup.shards_of(keys)
    assert n == 43 and [x["salts"] > 1 for x in line_dedup.hot_shards(shards).collect()] == [True]
    assert sum(len(x["counts"]) for x in shards.collect()) == 301  # every distinct line is in the index
    got = line_dedup.dedup_lines(docs.selectExpr("*", "doc_id * 2 AS __id", "'x' AS __drop", "1 AS shard", "2 AS salts")).collect()
    assert all((x["n_dropped"], x["__id"], x["__drop"], x["shard"]) == (int(x["doc_id"] > 0), 2 * x["doc_id"], "x", 1) for x in got)
    kept = near_dedup.near_dedup(H.documents(spark, ["a b c d e f"] * 3).selectExpr("*", "doc_id * 2 AS __id", "7 AS bucket")).collect()
    assert [(x["doc_id"], x["__id"], x["bucket"]) for x in kept] == [(0, 0, 7)]


def test_line_dedup_ids(spark):
    rows = [(5, "a repeated line"), (5, "a repeated line\na repeated line"), (None, "a repeated line\nx"), (None, "only without an id")]
    got = line_dedup.dedup_lines(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert sorted((x["doc_id"] or 0, x["text"]) for x in got) == [(0, "only without an id"), (0, "x"), (5, "a repeated line"), (5, "a repeated line\na repeated line")]
    assert line_dedup.dedup_lines(H.documents(spark, [])).count() == 0
    assert line_dedup.line_digests(H.documents(spark, [])).count() == 0


# Near-dedup


def test_signatures_are_unbiased():
    r = np.random.default_rng(5)
    base, a = r.integers(0, 2**63, 300).astype(np.uint64), r.integers(0, 7, 300)
    b = np.maximum(0, a + r.integers(-1, 2, 300))
    true, seen = np.minimum(a, b).sum() / np.maximum(a, b).sum(), []
    for k in range(20):
        s = near_dedup.mix(base + np.uint64(k * 7919 + 1))
        sig = near_dedup.bag_minhash(np.repeat([0, 1], [(a > 0).sum(), (b > 0).sum()]), np.concatenate([s[a > 0], s[b > 0]]), np.concatenate([a[a > 0], b[b > 0]]), 2)
        seen.append((sig[0] == sig[1]).mean())
    assert abs(np.mean(seen) - true) < 0.03


def test_near_classes_of_dense_groups(spark, monkeypatch):
    """Groups whose members are links apart and almost links apart: leaders, ties and exact blocks all work."""
    monkeypatch.setattr(near_dedup, "BLOCK", 16)
    monkeypatch.setattr(near_dedup, "EXACT_BLOCK", 8)
    r = random.Random(7)
    texts = []
    for share in (0.01, 0.015, 0.02, 0.03):
        base = prose(r, 120)
        texts += [edited(r, base, share) for _ in range(40)]
    texts += [prose(r, 60) for _ in range(30)] + [texts[0]] * 20 + ["w1 w2 w3"] * 2 + ["w1 w2 w3 " * 50] * 2 + H.ODD + [None]
    want = H.near_classes(dict(enumerate(texts)))
    got = {x["doc_id"]: x["class_id"] for x in near_dedup.near_duplicate_classes(H.documents(spark, texts)).collect()}
    assert got == want
    kept = near_dedup.near_dedup(H.documents(spark, texts).selectExpr("*", "'x' AS class_id", "1 AS id", "2 AS a"))
    assert sorted(x["doc_id"] for x in kept.collect()) == sorted(set(want.values()))


def test_near_dedup_ids(spark):
    t = "one two three four five six seven"
    rows = [(None, t), (3, t), (3, t), (9, t + " eight nine ten"), (None, "other words of another text here")]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    got = near_dedup.near_duplicate_classes(df).collect()
    assert sorted((x["doc_id"] or 0, x["class_id"] or 0) for x in got) == [(0, 0), (0, 3), (3, 3), (3, 3), (9, 9)]
    assert near_dedup.near_duplicate_classes(H.documents(spark, [])).count() == 0


def test_near_dedup_of_short_texts_alone(spark):
    """A slice may hold fewer words than a shingle."""
    for n in range(7):
        got = near_dedup.bags(pa.array([" ".join("abcdefg"[:n])]))
        assert len(got[0]) == max(min(n, 1), n - 4)
    docs = H.documents(spark, ["one two"]).union(H.documents(spark, ["one two three"]).selectExpr("doc_id + 1", "text", "lang", "source", "n_chars"))
    assert docs.rdd.glom().map(len).filter(bool).collect() == [1, 1]
    assert sorted((x["doc_id"], x["class_id"]) for x in near_dedup.near_duplicate_classes(docs).collect()) == [(0, 0), (1, 1)]


# Decontamination


def test_contamination(spark):
    r = random.Random(11)
    items = [prose(r, n) for n in (15, 20, 40, 60, 200, 300, 4)] + [None, "", " ", "w1 w2 w3"]
    docs = [prose(r, 2000) for _ in range(12)]
    docs += [prose(r, 1000) + " " + t.upper() + "\n" + prose(r, 50) for t in items[:6]] + [edited(r, items[3], 0.02), edited(r, items[4], 0.02), edited(r, items[5], 0.05), items[6], "W1 w2\tw3", " ".join(items[2].split()[:36])] + H.ODD
    bench = spark.createDataFrame(list(enumerate(items)), "item_id long, text string").selectExpr("*", "1 AS h", "2 AS n_item")
    got = decontamination.contaminated(H.documents(spark, docs).selectExpr("*", "1 AS h", "1 AS item_id"), bench).collect()
    want = H.contained(dict(enumerate(docs)), dict(enumerate(items)))
    assert {(x["doc_id"], x["item_id"]) for x in got} == want and len(got) == len(want)
    kept = decontamination.decontaminate(H.documents(spark, docs), bench)
    assert {x["doc_id"] for x in kept.collect()} == set(range(len(docs))) - {d for d, _ in want}
    monkey = decontamination.BROADCAST_ROWS
    decontamination.BROADCAST_ROWS = 0
    try:
        assert decontamination.contaminated(H.documents(spark, docs), bench).count() == len(want)
    finally:
        decontamination.BROADCAST_ROWS = monkey


def test_small_items_cost_large_ones_no_probes(spark):
    """Each size partition is searched by its own bound: further items of another size leave its probes as they were."""
    r = random.Random(21)
    large, small, docs = [prose(r, 400) for _ in range(5)], [prose(r, 7) for _ in range(40)], [prose(r, 300) for _ in range(30)]

    def probed(items):
        _, sketch = decontamination.sketches(spark.createDataFrame(list(enumerate(items)), "item_id long, text string"))
        bounds = {x["part"]: x["bound"] for x in sketch.groupBy("part").agg(decontamination.F.max("h").alias("bound")).collect()}
        shingles = decontamination._shingled(H.documents(spark, docs), decontamination.id_or_last(), "doc_id").selectExpr("doc_id", "explode_outer(s) AS h")
        return {x["part"]: x["count"] for x in decontamination.probes(shingles, bounds).groupBy("part").count().collect()}, shingles.count()

    (alone, all_), (mixed, _) = probed(large), probed(large + small)
    assert list(alone) == [8] and alone[8] < 0.4 * all_ and mixed[8] == alone[8] and mixed[decontamination.WHOLE] > 0.8 * all_


@pytest.mark.parametrize("bound", [0.3, 0.5, 0.8, 1.0])
def test_containment_bounds(spark, bound):
    """Any bound, items of mixed sizes, documents that hold from a fifth to all of an item: equal to brute force."""
    r = random.Random(12)
    items = [prose(r, n) for n in (6, 9, 20, 20, 70, 170, 400)]
    docs = [prose(r, 300) + "\n" + " ".join(t.split()[: max(1, round(len(t.split()) * share))]) for t in items for share in (0.2, 0.35, 0.45, 0.55, 0.7, 0.85, 0.95, 1.0)]
    bench = spark.createDataFrame(list(enumerate(items)), "item_id long, text string")
    got = decontamination.contaminated(H.documents(spark, docs), bench, bound).collect()
    want = H.contained(dict(enumerate(docs)), dict(enumerate(items)), bound)
    assert {(x["doc_id"], x["item_id"]) for x in got} == want and len(got) == len(want)


def test_sketches_miss_rarely():
    """The needed hits against the exact hypergeometric tail, for documents that hold just the bound."""
    for t in (0.1, 0.3, 0.5, 0.8, 0.95):
        k = decontamination.sketch_length(t)
        need = decontamination.needed_hits(k, t)
        for n in (k, 2 * k, 1000 + k):
            held = math.ceil(t * n)
            tail = sum(math.comb(held, x) * math.comb(n - held, k - x) for x in range(need)) / math.comb(n, k)
            assert need >= 1 and tail <= decontamination.MISS


def test_contamination_ids_and_empty_tables(spark):
    t = "a b c d e f g h"
    docs = spark.createDataFrame([(1, t), (1, t), (None, t), (2, "a b c d e f g"), (2, "f g h d e f g h")], "doc_id long, text string")
    bench = spark.createDataFrame([(7, t), (7, t), (None, t)], "item_id long, text string")
    assert sorted(map(tuple, decontamination.contaminated(docs, bench).collect()), key=lambda x: x[0] or 0) == [(None, 7, 4, 4, 1.0), (1, 7, 4, 4, 1.0), (2, 7, 4, 4, 1.0)]
    assert decontamination.decontaminate(docs.selectExpr("*", "1 AS __id"), bench).count() == 0  # rows without doc_id are a document like others
    assert decontamination.contaminated(docs, bench.limit(0)).count() == 0
    assert decontamination.decontaminate(docs, bench.limit(0)).count() == 5
    assert decontamination.contaminated(docs.limit(0), bench).count() == 0


# Language ID


@pytest.fixture(scope="module")
def languages(spark):
    r = random.Random(2)
    make = {"aa": ["kola", "mira", "tano", "belu"], "bb": ["strz", "kwid", "plom", "grun"], "cc": ["oui", "eau", "aie", "ieu"]}
    rows = [(i, " ".join("".join(r.choices(make[k], k=r.randint(1, 4))) for _ in range(r.randint(5, 60))), k, "s", 0) for i, k in enumerate(r.choices(list(make), k=240))]
    return spark.createDataFrame(rows, H.SCHEMA)


def test_probabilities_add_up():
    m = language_id.Model(["x", "y"], [{"abab": 3, "ba": 2, "cab": 1}, {"bbb": 5, "abc": 2}], order=3)
    letters = "abc" + chr(language_id.END)
    for context in ("", "a", "ab", "ca"):
        base = m.score_words([context])[0] if context else 0.0
        total = 0.0
        for c in letters[:-1]:
            whole = m.score_words([context + c])[0] - _end(m, context + c)
            total = total + 2.0 ** (whole - (base - _end(m, context) if context else 0.0))
        end = 2.0 ** (_end(m, context) if context else m.score_words([""])[0])
        assert np.all(total + end < 1.0 + 1e-9) and np.all(total + end > 0.8)  # the rest is for unseen symbols


def _end(m, word):
    """Log probability of the end after a word: by sequences that differ in nothing else."""
    full = m.score_words([word])[0]
    marked = chr(language_id.START) + word
    p = np.full(len(m.langs), m.floor)
    row = lambda g: next(iter(m.rows[m._find(np.array([m._hash_text(g)], np.uint64))]), None) if m._find(np.array([m._hash_text(g)], np.uint64))[0] >= 0 else None
    k = len(m.langs)
    for n in range(1, min(m.order, len(marked) + 1) + 1):
        context = marked[len(marked) - n + 1 :] if n > 1 else ""
        g, c = row(context + chr(language_id.END)), row(context)
        p = (g[:k] if g is not None else 0.0) + (c[k:] if c is not None else 1.0) * p
    assert np.all(full <= 0)
    return np.log2(p)


def test_language_of_held_out_documents(spark, languages):
    got = language_id.predictions(languages).join(languages.select("doc_id", "lang"), "doc_id").collect()
    assert len(got) == 240 and all(0 <= x["score"] <= 1 for x in got)
    held = [x for x in got if x["held_out"]]
    assert held and all(x["lang_pred"] == x["lang"] and x["accepted"] for x in held)


DOCUMENTS = "/root/testdata/sf0.01/documents.parquet"


def captured(monkeypatch):
    """The tables that the operator writes while training."""
    seen, real = [], language_id.written
    monkeypatch.setattr(language_id, "written", lambda df, name: seen.append(real(df, name)) or seen[-1])
    return seen


@pytest.mark.skipif(not os.path.exists(DOCUMENTS.replace("0.01", "0.001")), reason="no tables")
def test_language_equals_the_slow_way(spark, monkeypatch):
    """Every row of the smallest table against a recursive model of the same sample: language, cross-entropy, acceptance."""
    docs = spark.read.parquet(DOCUMENTS.replace("0.01", "0.001"))
    seen = captured(monkeypatch)
    model = language_id.train(docs)
    cut = language_id.CALIBRATION_DOCS / (language_id.SAMPLE_DOCS + language_id.CALIBRATION_DOCS)
    sample = [(x["lang"], x["text"]) for x in seen[0].filter(language_id.F.col("part") >= cut).collect()]
    got = language_id.detect(docs.select("doc_id", "text"), model).collect()
    want = H.slow_languages(sample, [x["text"] for x in got], model.order)
    limit = dict(zip(model.langs, model.limit, strict=True))
    assert len(got) >= 200
    for x, h in zip(got, want, strict=True):
        if not h:
            assert (x["lang_pred"], x["accepted"]) == ("und", False)
            continue
        best = min(h, key=h.get)
        assert x["lang_pred"] == best and x["cross_entropy"] == pytest.approx(h[best], rel=1e-4)
        assert x["accepted"] == (h[best] <= limit[best]) or abs(h[best] - limit[best]) < 1e-3


@pytest.mark.skipif(not os.path.exists(DOCUMENTS), reason="no tables")
def test_language_of_held_out_rows_of_documents(spark):
    """Accuracy by language on labelled rows that were not learned from."""
    docs = spark.read.parquet(DOCUMENTS)
    got = language_id.predictions(docs).filter("held_out").join(docs.select("doc_id", "lang", "text"), "doc_id").filter("lang is not null and lang_pred <> 'und'").collect()
    right = collections.defaultdict(list)
    for x in got:
        right[x["lang"]].append(x["lang_pred"] == x["lang"])
    assert len(got) > 100 and len(right) >= 4 and all(np.mean(v) >= 0.97 for v in right.values())


def test_the_language_sample_is_bounded(spark, languages, monkeypatch):
    """A text that repeats a thousand times counts once; no more texts than asked for are read."""
    seen = captured(monkeypatch)
    many = languages.union(languages.limit(1).crossJoin(spark.range(1000)).select(*languages.columns))
    language_id.train(many, 20, 10)
    counts = {x["lang"]: (x["count"], x["texts"]) for x in seen[0].groupBy("lang").agg(language_id.F.count("*").alias("count"), language_id.F.count_distinct("text").alias("texts")).collect()}
    assert all(n == k <= 30 for n, k in counts.values()) and counts


def test_repeats_do_not_starve_a_language(spark):
    """60 different texts beside 20,000 equal ones of their language: 40 are learned from, and no language is taken for the other."""
    r = random.Random(3)
    word = lambda letters: "".join(r.choice(letters) for _ in range(r.randint(3, 8)))
    texts = {k: [" ".join(word(letters) for _ in range(40)) for _ in range(60)] for k, letters in (("aa", "kolamirt"), ("bb", "kolesund"))}
    rows = spark.createDataFrame([(t, k) for k, own in texts.items() for t in own], "text string, lang string")
    many = rows.union(rows.filter("lang = 'aa'").limit(1).crossJoin(spark.range(20_000)).select("text", "lang"))
    model = language_id.train(many, 40, 20)
    got = language_id.detect(rows, model).groupBy("lang", "lang_pred").count().collect()
    assert [(x["lang"], x["count"]) for x in sorted(got, key=lambda x: x["lang"]) if x["lang"] == x["lang_pred"]] == [("aa", 60), ("bb", 60)]


def test_language_edge_cases(spark, languages):
    model = language_id.train(languages)
    r = random.Random(1)
    odd = H.documents(spark, [None, "²½", "12 -- 3", "KOLAmira tano", "".join(r.choice("qxjvwyzh") for _ in range(200))]).selectExpr("*", "7 AS score", "'x' AS lang_pred", "1 AS h")
    got = language_id.detect(odd, model).orderBy("doc_id").collect()
    assert [x["lang_pred_"] for x in got[:4]] == ["und", "und", "und", "aa"] and [x["accepted"] for x in got] == [False, False, False, True, False]
    assert [x["score_"] for x in got[:3]] == [0.0] * 3 and got[0].asDict().keys() == {*odd.columns, "lang_pred_", "score_", "cross_entropy", "accepted"}
    assert {(x["score"], x["lang_pred"]) for x in got} == {(7, "x")}
    nothing = language_id.train(languages.selectExpr("text", "cast(null AS string) AS lang"))
    assert {x["lang_pred"] for x in language_id.detect(languages, nothing).collect()} == {"und"}
    assert language_id.predictions(H.documents(spark, [])).count() == 0
