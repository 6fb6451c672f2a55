"""Language ID: interpolated Kneser-Ney character models, one per language, in one sorted hash array.

Words (runs of letters, lower case) are padded with a start and an end mark and scored on their own, so
a text's cross-entropy is a sum over its words and each distinct word is scored once per worker.
An n-gram is a 64-bit hash. The sorted array of the hashes of all languages carries two rows of numbers
per n-gram: its discounted probability as an n-gram and its back-off weight as a context, for each
language. Probabilities are interpolated from the uniform one upward; the winner has the lowest
cross-entropy per character.

Two calibrations on labelled documents that were not trained on: a temperature that turns cross-entropies
into the probability ``score``, and for each language the highest acceptable cross-entropy, half-way
between the 99.9 % quantile of its own texts and the entropy of random letters.

Training reads at most ``SAMPLE_DOCS`` and ``CALIBRATION_DOCS`` different labelled texts per language, chosen by a
hash of the text; the model is therefore bounded and is broadcast. Every row of the input is predicted.

Defined cases: null texts and texts without a letter give ``und``, score 0 and not accepted; documents
without a label or text are not learned from; no labelled document at all gives ``und`` for every row;
ties go to the first language by name; other columns pass through untouched, new ones take the next free
name; an empty table gives an empty result.
"""

from __future__ import annotations

import math
import re
from collections import Counter, defaultdict
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from profusion.llm.common import new_names, slices, task
from profusion.session import written

ORDER = 4
SAMPLE_DOCS = 1000
CALIBRATION_DOCS = 300
#: Words whose scores a task keeps (some 100 bytes each); the cache goes with the task.
CACHE_WORDS = 200_000
_WORD = re.compile(r"[^\W\d_]+")
_MASK = np.uint64(0x9E3779B97F4A7C15)
START, END = 2, 3
PREDICTED = ("lang_pred", "score", "cross_entropy", "accepted")


def letters(text: str | None) -> list[str]:
    words = _WORD.findall((text or "").lower())
    if all(map(str.isalpha, words)):
        return words
    return [w for w in ("".join(filter(str.isalpha, w)) for w in words) if w]  # without signs such as 2 in superscript


class Model:
    """The sorted arrays and the two calibrations."""

    def __init__(self, langs: list[str], counts: list[dict[str, int]], order: int = ORDER):
        self.langs, self.order = langs, order
        self.heat, self.limit = 1.0, [math.inf] * len(langs)
        alphabet = {c for words in counts for w in words for c in w}
        self.floor = 1.0 / (len(alphabet) + 2)
        rows: dict[str, list[float]] = defaultdict(lambda: [0.0] * len(langs) + [1.0] * len(langs))
        for k, words in enumerate(counts):
            self._estimate(k, words, rows)
        keys = np.array([self._hash_text(g) for g in rows], np.uint64)
        by = np.argsort(keys)
        self.keys = keys[by]
        self.rows = np.array(list(rows.values()), np.float64).reshape(len(rows), 2 * len(langs))[by]

    def _estimate(self, k: int, words: dict[str, int], rows: dict[str, list[float]]) -> None:
        counts: list[Counter] = [Counter() for _ in range(self.order + 1)]
        for word, times in words.items():
            marked = chr(START) + word + chr(END)
            for end in range(2, len(marked) + 1):
                for n in range(1, min(self.order, end) + 1):
                    gram = marked[end - n : end]
                    # Kneser-Ney: full counts at the top and where the word's start leaves no left neighbour.
                    counts[n][gram] += times if n == self.order or gram[0] == chr(START) else 0
        for n in range(self.order, 1, -1):
            for gram in counts[n]:
                if gram[1:2] != chr(START):
                    counts[n - 1][gram[1:]] += 1  # one more left neighbour
        for n in range(1, self.order + 1):
            of = Counter(counts[n].values())
            d = of[1] / (of[1] + 2 * of[2]) if of[1] else 0.5
            total, kinds = Counter(), Counter()
            for gram, c in counts[n].items():
                total[gram[:-1]] += c
                kinds[gram[:-1]] += 1
            for gram, c in counts[n].items():
                rows[gram][k] = max(c - d, 0.0) / total[gram[:-1]]
            for context, c in total.items():
                rows[context][len(self.langs) + k] = d * kinds[context] / c

    @staticmethod
    def _hash_text(gram: str) -> int:
        h = 0x51ED270B
        for c in gram:
            h = ((h ^ ord(c)) * int(_MASK)) % (1 << 64)
            h ^= h >> 29
        return h

    def _find(self, h: np.ndarray) -> np.ndarray:
        at = np.searchsorted(self.keys, h)
        at[at == len(self.keys)] = 0
        return np.where(self.keys[at] == h, at, -1) if len(self.keys) else np.full(len(h), -1)

    def score_words(self, words: list[str]) -> np.ndarray:
        """Log2 probability of each word in each language (float64, words x languages)."""
        n = np.fromiter((len(w) + 2 for w in words), np.int64, len(words))
        chars = np.frombuffer("".join(f"{chr(START)}{w}{chr(END)}" for w in words).encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.uint64)
        word = np.repeat(np.arange(len(words)), n)
        into = np.arange(len(chars)) - np.repeat(np.cumsum(n) - n, n)
        k = len(self.langs)
        found: list[np.ndarray] = []  # found[m-1][i]: the row of the m-gram that ends at i
        for m in range(1, self.order + 1):
            h, ok = np.full(len(chars), 0x51ED270B, np.uint64), into >= m - 1
            for j in range(m - 1, -1, -1):
                shifted = np.zeros(len(chars), np.uint64)
                shifted[j:] = chars[: len(chars) - j]
                h = (h ^ shifted) * _MASK
                h ^= h >> np.uint64(29)
            found.append(np.where(ok, self._find(h), -1))
        empty = self._find(np.array([0x51ED270B], np.uint64))[0]
        p = np.full((len(chars), k), self.floor)
        table = np.vstack([self.rows, [0.0] * k + [1.0] * k])  # the last row: not seen
        for m in range(1, self.order + 1):
            if m == 1:
                back = np.full(len(chars), empty)
            else:
                back = np.concatenate([[-1], found[m - 2][:-1]])
            use = into >= m - 1
            p = np.where(use[:, None], table[found[m - 1], :k] + table[back, k:] * p, p)
        logs = np.where((into > 0)[:, None], np.log2(np.maximum(p, 1e-12)), 0.0)
        out = np.zeros((len(words), k))
        np.add.at(out, word, logs)
        return out


class Scorer:
    """Scores texts with a cache of word scores."""

    def __init__(self, model: Model):
        self.model, self.known, self.table = model, {}, np.zeros((0, len(model.langs)), np.float32)

    def entropies(self, texts: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
        """Cross-entropy per character in each language, and the number of characters (ends included)."""
        words = [letters(t) for t in texts]
        new = list({w for own in words for w in own if w not in self.known})
        if new:
            if len(self.known) + len(new) > CACHE_WORDS:
                self.known, self.table = {}, self.table[:0]
                new = list({w for own in words for w in own})
            start = len(self.known)
            self.known.update(zip(new, range(start, start + len(new)), strict=True))
            self.table = np.concatenate([self.table, self.model.score_words(new).astype(np.float32)])
        h, n = np.zeros((len(texts), len(self.model.langs))), np.zeros(len(texts), np.int64)
        get = self.known.__getitem__
        for i, own in enumerate(words):
            if own:
                n[i] = sum(map(len, own)) + len(own)
                h[i] = -self.table[np.fromiter(map(get, own), np.int64, len(own))].sum(axis=0, dtype=np.float64) / n[i]
        return h, n

    def predict(self, texts: list[str | None]) -> tuple[list[str], np.ndarray, np.ndarray, np.ndarray]:
        """Language, score, cross-entropy and acceptance of each text."""
        if not self.model.langs:
            zero = np.zeros(len(texts))
            return ["und"] * len(texts), zero, zero, np.zeros(len(texts), bool)
        h, n = self.entropies(texts)
        best = h.argmin(axis=1)
        own = h[np.arange(len(texts)), best]
        score = np.where(n > 0, 1.0 / np.exp2(-self.model.heat * (h - own[:, None])).sum(axis=1), 0.0)
        accepted = (n > 0) & (own <= np.array(self.model.limit)[best])
        return [self.model.langs[b] if k else "und" for b, k in zip(best, n, strict=True)], score, np.where(n > 0, own, 0.0), accepted


@task
def _word_counts(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for batch in batches:
        rows = Counter()
        for lang, text in zip(batch["lang"], batch["text"], strict=True):
            rows.update((lang, w) for w in letters(text))
        yield pd.DataFrame([(a, b, n) for (a, b), n in rows.items()], columns=["lang", "word", "n"])


def train(labelled: DataFrame, sample_docs: int = SAMPLE_DOCS, calibration_docs: int = CALIBRATION_DOCS) -> Model:
    """Fit on columns text and lang. Reads ``sample_docs`` different texts per language, and ``calibration_docs`` others to
    calibrate, in that proportion if there are fewer; both are chosen by a hash of the text. A repeated text counts once, in the
    draw too: how large a share of a language is drawn follows from its different texts, estimated with room for the error."""
    have = labelled.filter("text is not null and lang is not null").select("text", "lang")
    sizes = {r["lang"]: r["n"] for r in have.groupBy("lang").agg(F.approx_count_distinct("text", 0.02).alias("n")).collect()}
    langs = sorted(sizes)
    if not langs:
        return Model([], [])
    most = sample_docs + calibration_docs
    share = F.create_map(*(x for k in langs for x in (F.lit(k), F.lit(min(1.0, 1.25 * (most + 100) / max(1, sizes[k]))))))
    draw = F.pmod(F.xxhash64("text", F.lit(6)), F.lit(1 << 40)) / float(1 << 40)
    chosen = have.withColumn("part", draw / share[F.col("lang")]).filter("part < 1").groupBy("lang", "text").agg(F.min("part").alias("part"))
    place = F.row_number().over(Window.partitionBy("lang").orderBy("part", "text"))  # some ``most`` texts a language
    cut = calibration_docs / most
    chosen = chosen.withColumn("place", place).filter(F.col("place") <= most)
    part = (F.col("place") - 0.5) / F.count("*").over(Window.partitionBy("lang"))
    chosen = written(chosen.withColumn("part", part), "language-sample")
    counted = chosen.filter(F.col("part") >= cut).select("lang", "text").mapInPandas(_word_counts, "lang string, word string, n long")
    counts: dict[str, dict[str, int]] = {k: {} for k in langs}
    for r in counted.groupBy("lang", "word").agg(F.sum("n").alias("n")).toLocalIterator():
        counts[r["lang"]][r["word"]] = r["n"]
    model = Model(langs, [counts[k] for k in langs])
    _calibrate(model, chosen.filter(F.col("part") < cut))
    return model


def _calibrate(model: Model, docs: DataFrame) -> None:
    shared = docs.sparkSession.sparkContext.broadcast(model)

    @task
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        scorer = Scorer(shared.value)
        for batch in batches:
            h, n = scorer.entropies(batch["text"].tolist())
            keep = n > 0
            yield pd.DataFrame({"lang": batch["lang"][keep], "h": list(h[keep])})

    rows = docs.select("text", "lang").mapInPandas(run, "lang string, h array<double>").collect()
    if not rows:
        return
    h, true = np.array([r["h"] for r in rows]), np.array([model.langs.index(r["lang"]) for r in rows])
    own = h[np.arange(len(h)), true]
    nll = lambda heat: (heat * own + np.log2(np.exp2(-heat * (h - h.min(axis=1)[:, None])).sum(axis=1)) - heat * h.min(axis=1)).mean()
    model.heat = float(min((2.0**k for k in range(-2, 7)), key=nll))
    draw = np.random.default_rng(6)
    symbols = sorted({c for w in letters(" ".join(map(chr, range(97, 123)))) for c in w})
    noise = model.score_words(["".join(draw.choice(symbols, draw.integers(2, 12))) for _ in range(2000)])
    length = 7.5  # mean letters of the random words, with the end
    for k in range(len(model.langs)):
        mine = own[true == k]
        random = float(-noise[:, k].mean() / length)
        usual = float(np.quantile(mine, 0.999)) if len(mine) else random
        model.limit[k] = max(usual, (usual + random) / 2)


def detect(docs: DataFrame, model: Model) -> DataFrame:
    """``docs`` with lang_pred, score, cross_entropy, accepted (``new_names``)."""
    import pyspark.sql.types as T
    from pyspark.sql.pandas.types import to_arrow_schema

    shared = docs.sparkSession.sparkContext.broadcast(model)
    kinds = [T.StringType(), T.DoubleType(), T.DoubleType(), T.BooleanType()]
    new = [T.StructField(name, kind) for name, kind in zip(new_names(docs, *PREDICTED), kinds, strict=True)]
    rest = docs.schema.fields
    schema = T.StructType(rest + new)
    arrow = to_arrow_schema(schema)

    @task
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scorer = Scorer(shared.value)
        for whole in batches:
            for batch in slices(whole, "text"):
                got = scorer.predict(batch.column("text").to_pylist())
                yield pa.RecordBatch.from_arrays([batch.column(f.name).cast(arrow.field(f.name).type) for f in rest] + [pa.array(got[0], pa.string()), *map(pa.array, got[1:])], schema=arrow)

    return docs.mapInArrow(run, schema)


def held_out(folds: int = 5, fold: int = 0):
    return F.pmod(F.crc32(F.col("doc_id").cast("string").cast("binary")), F.lit(folds)) == fold


def predictions(docs: DataFrame) -> DataFrame:
    """The contract's query: learn where crc32(doc_id) mod 5 is not 0, predict every row."""
    model = train(docs.filter(~F.coalesce(held_out(), F.lit(False))))
    return detect(docs.select("doc_id", "text"), model).select("doc_id", F.coalesce(held_out(), F.lit(False)).alias("held_out"), "lang_pred", "score", "cross_entropy", "accepted")
