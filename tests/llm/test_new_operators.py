"""Importance resampling, the quality model and periodic runs against plain versions."""

from __future__ import annotations

import hashlib
import math
import random
import re
import zlib
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest

from profusion.llm import importance_resampling as ir
from profusion.llm import periodic_runs as pr
from profusion.llm import quality_gam as gam
from profusion.session import table

SF = "/root/testdata/sf0.001"
DOCS = "doc_id long, text string"


# ---------------------------------------------------------------- importance resampling


def _features(text):
    low = re.sub("[A-Z]", lambda m: m[0].lower(), text or "")
    w = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", low)
    return w, [" ".join(w[i : i + k]) for k in (1, 2, 3) for i in range(len(w) - k + 1)]


def _slow_importance(docs: dict, target: list, percent=5, least=20):
    bucket = lambda f: zlib.crc32(f.encode()) % 10000
    own = {k: [sum(x, []) for x in zip(*map(_features, texts), strict=True)] for k, texts in docs.items()}
    s, t = Counter(bucket(f) for _, fs in own.values() for f in fs), Counter(bucket(f) for x in target for f in _features(x)[1])
    big_s, big_t = sum(s.values()), sum(t.values())
    gain = {b: math.floor(1000 * math.log((t[b] + 1.0) * (big_s + 10000.0) / ((s[b] + 1.0) * (big_t + 10000.0)))) for b in s}
    rows = {}
    for k, (w, fs) in own.items():
        h = int(hashlib.sha256(f"42:{'' if k is None else k}".encode()).hexdigest()[:8], 16)
        weight = sum(gain[bucket(f)] for f in fs)
        rows[k] = [len(fs), weight, weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296))), None, len(w)]
    able = sorted((k for k in rows if rows[k][4] >= least), key=lambda k: (-rows[k][2], math.inf if k is None else k))
    for place, k in enumerate(able[: percent * len(able) // 100], 1):
        rows[k][3] = place
    return {k: tuple(v) for k, v in rows.items()}


def _by_id(df):
    got = [(r["doc_id"], (r["n_features"], r["weight"], r["score"], r["rank"], r["n_words"])) for r in df.collect()]
    assert len({k for k, _ in got}) == len(got)
    return dict(got)


def test_importance_of_all_documents(spark):
    docs, bench = table(spark, SF, "documents"), table(spark, SF, "benchmark")
    slow = _slow_importance({r["doc_id"]: [r["text"]] for r in docs.collect()}, [r["text"] for r in bench.collect()])
    assert _by_id(ir.importance(docs, bench)) == slow
    assert sum(v[3] is not None for v in slow.values()) == 5 * sum(v[4] >= 20 for v in slow.values()) // 100 > 0


ODD = [
    (1, "A b, a-B Äb É3"), (1, "one more row of it"), (None, "no id " * 30), (None, None), (2, None), (3, ""), (4, " .,!\n\t"), (5, "x" * 5000), (6, "wort " * 21),
    (7, "same words here " * 8), (8, "same words here " * 8), (9, "İSTANBUL K ſ ÀÉ " * 6), (-3, "a\x00b\x1fc 0" * 9),
]


def test_importance_of_odd_rows(spark):
    rows = [(i, t, "x", 7) for i, t in ODD]
    docs = spark.createDataFrame(rows, DOCS + ", weight string, RANK int")
    target = spark.createDataFrame([(1, "same words"), (2, None), (3, "Wort é")], DOCS)
    by: dict = {}
    for i, t in ODD:
        by.setdefault(i, []).append(t)
    slow = _slow_importance(by, ["same words", None, "Wort é"], percent=60)
    assert _by_id(ir.importance(docs, target, percent=60)) == slow
    drawn = ir.resample(docs, target, percent=60)
    assert drawn.columns == docs.columns
    assert {r["doc_id"] for r in drawn.collect()} == {k for k, v in slow.items() if v[3]} and drawn.count() == sum(v[3] is not None for k, v in slow.items() for _ in by[k])


def test_importance_of_empty_tables(spark):
    docs, none = spark.createDataFrame(ODD, DOCS), spark.createDataFrame([], DOCS)
    assert ir.importance(none, docs).count() == 0 and ir.resample(none, none).count() == 0
    by: dict = {}
    for i, t in ODD:
        by.setdefault(i, []).append(t)
    assert _by_id(ir.importance(docs, none)) == _slow_importance(by, [])


def test_ranks_over_many_partitions_and_ties(spark):
    rows = [(i, 20 + i % 3, (i * 7919) % 50) for i in range(2000)] + [(3000 + i, 5, 99) for i in range(9)]
    scored = spark.createDataFrame(rows, "doc long, n_words long, score long").repartition(7)
    got = {r["doc"]: r["rank"] for r in ir.ranked(scored, 30, 20).collect()}
    able = sorted((d for d, n, _ in rows if n >= 20), key=lambda d: (-dict((a, c) for a, _, c in rows)[d] if d < 0 else -((d * 7919) % 50), d))
    assert len(got) == len(rows) and {d: p for d, p in got.items() if p} == {d: p for p, d in enumerate(able[:600], 1)}


def test_importance_has_no_python_and_broadcasts_only_gains(spark):
    plan = ir.features(table(spark, SF, "documents"), ir.id_or_last())._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Arrow" not in plan and plan.count("split(") == 1, plan


# ---------------------------------------------------------------- quality


def _slow_features(text):
    text = text or ""
    data, words, lines = text.encode(), text.encode().split(), text.split("\n")
    kinds = Counter(gam.KIND[b] for b in data)
    filled, some, letters = max(len(data) - kinds[gam.BLANK], 1), max(len(words), 1), max(kinds[gam.LOWER] + kinds[gam.UPPER], 1)
    low = [re.sub(rb"[A-Z]", lambda m: m[0].lower(), w) for w in words]
    pairs = list(zip(low, low[1:], strict=False))
    odd = sum(gam.KIND[a] >= gam.SHOUT and gam.KIND[b] == gam.BLANK for a, b in zip(data, data[1:], strict=False))
    return [
        math.log2(len(words) + 1), filled / some, math.log2(len(words) / len(lines) + 1), letters / filled, kinds[gam.UPPER] / letters, kinds[gam.DIGIT] / filled, kinds[gam.MARK] / some,
        kinds[gam.SHOUT] / some, kinds[gam.SYMBOL] / filled, kinds[gam.BAR] / some, sum(a == b for a, b in pairs) / some, len(set(low)) / some, max(Counter(low).values(), default=0) / some,
        (len(pairs) - len(set(pairs))) / max(len(pairs), 1), (len(lines) - len(set(lines))) / len(lines), odd / some,
    ]


TEXTS = [None, "", " ", "\n\n", "a", "A a A a", "Ünïcödé wörds | here!! $$$ ### 12", "line\nline\nline\nother", "x " * 3000, "tail!", "\x0b\x0c|", "é" * 40, "mixed Case mixed case\nMixed"]


def test_features_equal_the_slow_ones(spark):
    texts = TEXTS + [r["text"] for r in table(spark, SF, "documents").limit(60).collect()]
    assert np.allclose(gam.features(pa.array(texts)), [_slow_features(t) for t in texts], rtol=0, atol=1e-12)
    assert gam.features(pa.array([None, ""], pa.string())).shape == (2, len(gam.FEATURES)) and gam.features(pa.array([], pa.string())).shape == (0, len(gam.FEATURES))
    assert np.array_equal(gam.features(pa.array(texts)[5:]), gam.features(pa.array(texts[5:])))


def test_scores_are_the_sums_of_the_tables():
    draw = np.random.default_rng(3)
    x = draw.normal(size=(3000, 4)).round(2)
    y = ((x[:, 0] > 0) ^ (x[:, 1] > 0.3)).astype(float)  # an interaction: no single feature tells
    model = gam.fit(x, y, np.arange(len(y)) % 4 == 0)
    fresh = draw.normal(size=(500, 4)).round(2)
    score = model.score(fresh)
    assert model.pairs[0] == (1, 0)
    assert (((fresh[:, 0] > 0) ^ (fresh[:, 1] > 0.3)) == (score >= 0.5)).mean() > 0.9
    for row, got in zip(fresh[:50], score, strict=False):
        z = model.base + sum(t[sum(row[k] >= c for c in e)] for k, (e, t) in enumerate(zip(model.edges, model.tables, strict=True)))
        z += sum(t[sum(row[a] >= c for c in model.coarse[a]), sum(row[b] >= c for c in model.coarse[b])] for (a, b), t in zip(model.pairs, model.pair_tables, strict=True))
        assert math.isclose(got, 1 / (1 + math.exp(-z)), rel_tol=1e-9)


def test_trees_against_all_cuts():
    draw = np.random.default_rng(5)
    for _ in range(50):
        g, h = draw.normal(size=9) * 5, draw.uniform(0.5, 3, 9)
        worth = lambda parts: sum(g[a:b].sum() ** 2 / (h[a:b].sum() + gam.RIDGE) for a, b in parts)
        able = [c for c in range(1, 9) if min(h[:c].sum(), h[c:].sum()) >= gam.LEAST_HESSIAN]
        cut = max(able, key=lambda c: worth([(0, c), (c, 9)]))
        step = gam.tree(g, h, 2)
        if worth([(0, cut), (cut, 9)]) > worth([(0, 9)]):
            assert np.allclose(step, [g[:cut].sum() / (h[:cut].sum() + gam.RIDGE)] * cut + [g[cut:].sum() / (h[cut:].sum() + gam.RIDGE)] * (9 - cut))


def test_quality_of_held_out_documents(spark):
    docs, labels = table(spark, "/root/testdata/sf0.01", "documents"), table(spark, "/root/testdata/sf0.01", "labels")
    got = {r["doc_id"]: r for r in gam.predictions(docs, labels).collect()}
    assert len(got) == docs.count() and all(0 <= r["score"] <= 1 and r["predicted"] == int(r["score"] >= 0.3) for r in got.values())
    assert all(r["held_out"] == (zlib.crc32(str(k).encode()) % 5 == 0) for k, r in got.items())
    true = {r["doc_id"]: r["quality"] for r in labels.collect()}
    unseen = [(got[k]["predicted"], q) for k, q in true.items() if got[k]["held_out"]]
    assert len(unseen) > 50 and sum(p == q for p, q in unseen) / len(unseen) >= 0.95


def test_quality_of_odd_rows(spark):
    rows = [(i, t, -7.0, 1) for i, t in enumerate(TEXTS)] + [(None, "good words here", 0.0, 2), (0, None, 0.0, 3)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, score double, Predicted int")
    labels = spark.createDataFrame([(3, 1, 0), (3, 0, 0), (5, None, 0), (None, 1, 0), (8, 0, 0), (99, 1, 0)], "doc_id long, quality int, toxic int")
    out = gam.score(docs, gam.train(docs, labels))
    assert out.columns == ["doc_id", "text", "score", "Predicted", "score_"] and [r["score"] for r in out.orderBy("doc_id", "Predicted").collect()].count(-7.0) == len(TEXTS)
    assert all(0 <= r["score_"] <= 1 for r in out.collect()) and out.count() == len(rows)
    none = labels.limit(0)
    assert {r["score"] for r in gam.predictions(docs, none).collect()} == {0.5}
    assert gam.predictions(docs.limit(0), labels).count() == 0
    got = gam.predictions(docs, labels)
    assert got.columns == ["doc_id", "held_out", "score", "predicted"] and got.count() == len(rows)


def test_the_sample_is_bounded_and_does_not_hang_on_partitions(spark):
    docs, labels = table(spark, "/root/testdata/sf0.01", "documents"), table(spark, "/root/testdata/sf0.01", "labels")
    one, two = gam.train(docs.repartition(1), labels, 120), gam.train(docs.repartition(5), labels.repartition(3), 120)
    assert one.base == two.base and all(np.array_equal(a, b) for a, b in zip(one.tables, two.tables, strict=True))


# ---------------------------------------------------------------- runs


def _slow_runs(s, least_words=6, least_periods=4):
    out, n = set(), len(s)
    for p in range(1, n // least_periods + 1):
        i = 0
        while i + p < n:
            if s[i] != s[i + p]:
                i += 1
                continue
            j = i
            while j + p < n and s[j] == s[j + p]:
                j += 1
            w = s[i : j + p]
            if len(w) >= max(least_words, least_periods * p) and not any(all(w[k] == w[k + q] for k in range(len(w) - q)) for q in range(1, p)):
                out.add((i, len(w), p))
            i = j
    return sorted(out)


def _slow_lyndon(s):
    n = len(s)
    after, ahead = [0] * n, [0] * n
    for i in range(n):
        j = next((j for j in range(i + 1, n) if s[j:] < s[i:]), n)
        l = 0
        while j + l < n and s[i + l] == s[j + l]:
            l += 1
        if l:
            after[i], ahead[i] = j, l
    return after, ahead


def _texts(n):
    draw = random.Random(13)
    for _ in range(n):
        kinds, size = draw.choice([1, 2, 2, 3, 5]), draw.randint(0, 36)
        s = [draw.randrange(kinds) for _ in range(size)]
        if size and draw.random() < 0.5:
            a, p = draw.randrange(size), draw.randint(1, 6)
            s = [s[i] if i < a else s[min(a + (i - a) % p, size - 1)] for i in range(size)]
        yield s


def test_lyndon_arrays_and_runs_equal_brute_force():
    for s in _texts(4000):
        assert pr.lyndon(s) == _slow_lyndon(s), s
        for least in ((6, 4), (2, 2), (2, 3)):
            assert pr.find_runs(s, *least) == _slow_runs(s, *least), (s, least)
    with pytest.raises(ValueError):
        pr.find_runs([1, 1], 2, 1)


def test_comparisons_stay_linear():
    n = 20_000
    fib = [[0], [0, 1]]
    while len(fib[-1]) < n:
        fib.append(fib[-1] + fib[-2])
    draw = random.Random(1)
    half = [0] * (n // 2)
    texts = [
        [0] * n, fib[-1][:n], half + [1] + half + [2], [2] * (n // 2) + [1] + [2] * (n // 2) + [0], [draw.randrange(2) for _ in range(n)], [i % 977 for i in range(n)], [(i & -i).bit_length() for i in range(1, n)],
        [bin(i).count("1") & 1 for i in range(n)], [0 if i % 137 else i // 137 for i in range(n)], sum(([0] * k + [1] for k in range(1, 200)), []), sum(([0] * k + [1] for k in range(200, 0, -1)), []),
    ]
    for s in texts:
        top = max(s)
        for order in (s, [top - x for x in s]):
            counted = [0]
            pr.lyndon(order, counted)
            assert counted[0] <= 4 * len(s)


def _slow_digest(doc_id, text):
    w = re.findall(r"[^\x20\x09-\x0D]+", text or "")
    n, h = len(w), zlib.crc32(str(doc_id).encode())
    g = h // 10
    if doc_id is not None and h % 10 == 0 and n:
        a = g % n
        p = 1 + (n - a) // (3 + g % 8)
        w = [w[i] if i < a else w[a + (i - a) % p] for i in range(n)]
    runs = _slow_runs(w)
    gone = {i for a, size, q in runs for i in range(a + q, a + size)}
    best = sorted(runs, key=lambda r: (-r[1], r[0], r[2]))[:1]
    sha = lambda t: hashlib.sha256(t.encode()).hexdigest()
    longest = (*best[0], 1000 * best[0][1] // best[0][2]) if best else (None,) * 4
    return (len(runs), *longest, sha("".join(f"{a},{b},{c}\n" for a, b, c in runs)), sha(" ".join(x for i, x in enumerate(w) if i not in gone)))


def _fields(r):
    return tuple(r[c] for c in ("n_runs", "start", "length", "period", "exponent_milli", "runs_sha256", "collapsed_sha256"))


def test_digests_equal_brute_force(spark):
    docs = table(spark, SF, "documents").filter("n_chars < 4000")
    rows = docs.select("doc_id", "text").collect()
    ids = [i for i in range(4000) if zlib.crc32(str(i).encode()) % 10 == 0]
    odd = ["", None, " \t", "a", "a a a a a a", "a b " * 9, "\x1c\x85\xa0 x\x0by " * 7, "Ä ä " * 5 + "b b b b b b c", " ".join("abcabcabcabcabab")]
    made = [(i, t) for i, t in zip(ids, odd * 12, strict=False)] + [(None, "z " * 7), (None, "z " * 7), (17, "p q r " * 4)]
    every = docs.select("doc_id", "text").union(spark.createDataFrame(made, DOCS)).repartition(3)
    got = pr.digests(every).collect()
    want = sorted(map(str, ((r["doc_id"], *_slow_digest(r["doc_id"], r["text"])) for r in rows)))
    want += [str((i, *_slow_digest(i, t))) for i, t in made]
    assert sorted(str((r["doc_id"], *_fields(r))) for r in got) == sorted(want)
    assert any(r["n_runs"] for r in got) and pr.digests(docs.limit(0)).count() == 0


def test_collapse_and_find_keep_other_columns(spark):
    docs = spark.createDataFrame([(1, "a b " * 6 + "c", "own", 4), (2, None, None, None), (3, "x  y", "", 0)], DOCS + ", collapsed string, Runs int")
    out = {r["doc_id"]: r for r in pr.collapse(docs).collect()}
    assert [out[i]["collapsed_"] for i in (1, 2, 3)] == ["a b c", "", "x y"] and out[1]["collapsed"] == "own" and out[2]["Runs"] is None
    found = pr.find(docs)
    assert found.columns == ["doc_id", "text", "collapsed", "Runs", "runs_"]
    assert [[tuple(x) for x in r["runs_"]] for r in found.orderBy("doc_id").collect()] == [[(0, 12, 2)], [], []]
    assert pr.collapse(docs.limit(0)).count() == 0


def test_a_very_long_text_of_one_word(spark):
    docs = spark.createDataFrame([(1, "w " * 400_000)], DOCS)
    r = pr.digests(docs).first()
    assert (r["n_runs"], r["start"], r["length"], r["period"]) == (1, 0, 400_000, 1)
