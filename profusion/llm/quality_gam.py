"""Quality classifier: a generalised additive model with pairwise interactions, by cyclic boosting of shallow trees.

A text becomes ``FEATURES``, counted over all its bytes, words and lines with array operations on slices of bounded size. The
model is a constant, a lookup table of log-odds per feature and one per chosen pair of features:

* Each feature's bins are quantiles of the sample; a pair uses coarser bins of both.
* Boosting goes round the features: a tree of ``LEAVES`` leaves is fitted to one feature's gradients per bin, and a small part
  of it is added to that feature's table. So all features share the credit, and each table can be read on its own.
* Then the ``PAIRS`` pairs that explain most of what is left, by the best cut in both, get tables the same way, their trees cutting one
  feature and then each side by the other.
* A part of the sample, chosen by hash, decides after how many rounds to stop.

Scoring finds a row's bins and adds up table entries for all rows of a slice at once.

The fit reads at most ``SAMPLE_DOCS`` labelled documents, chosen by a hash of the id; their features come to the driver, the model
(some thousand numbers) goes to the tasks. Every document is scored.

Defined cases: null and empty texts have the features of an empty text and a score like any other; documents without doc_id are
scored and never learned from; a document with several labels counts with the highest; labels that are null are ignored; without
any label the score is 0.5, with labels of one kind it is near that; repeated rows are scored alike; other columns of ``docs``
pass through ``score`` unchanged, whatever their names (new columns get a name that is free); an empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

from profusion.llm.common import fresh, hash_strings, slices, task, token_hashes

SAMPLE_DOCS = 20_000
BINS, PAIR_BINS, LEAVES, PAIRS = 48, 12, 3, 8
ROUNDS, RATE, PATIENCE = 300, 0.08, 25
#: The least sum of second derivatives in a leaf, and what is added to it.
LEAST_HESSIAN, RIDGE = 1.0, 1.0
THRESHOLD = 0.3

FEATURES = [
    "words", "word_length", "line_words", "letters", "upper", "digits", "marks", "shouts", "symbols", "bars", "same_as_last", "distinct_words", "commonest_word", "repeated_pairs",
    "repeated_lines", "word_ends",
]
#: Kinds of bytes; those of letters beyond ASCII count as small letters.
LOWER, UPPER, DIGIT, BLANK, MARK, SHOUT, BAR, SYMBOL = range(8)  # from SHOUT on, words seldom end so


def _kinds() -> np.ndarray:
    kind = np.full(256, SYMBOL, np.uint8)
    for which, chars in ((LOWER, [*range(97, 123), *range(128, 256)]), (UPPER, range(65, 91)), (DIGIT, range(48, 58)), (BLANK, [32, *range(9, 14)]), (MARK, b".,;:'-?\""), (SHOUT, b"!"), (BAR, b"|")):
        kind[list(chars)] = which
    return kind


KIND = _kinds()


def _repeats(hashes: np.ndarray, row: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """For each of ``n`` rows, how many different values it has, and how often it has its commonest one."""
    key = np.sort((row.astype(np.uint64) << np.uint64(44)) | (hashes >> np.uint64(20)))
    at = np.flatnonzero(np.concatenate([[True], key[1:] != key[:-1]])) if len(key) else np.zeros(0, np.int64)
    of, times = (key[at] >> np.uint64(44)).astype(np.int64), np.diff(np.append(at, len(key)))
    kinds, most = np.bincount(of, minlength=n), np.zeros(n, np.int64)
    some = np.flatnonzero(kinds)
    if len(some):
        most[some] = np.maximum.reduceat(times, (np.cumsum(kinds) - kinds)[some])
    return kinds, most


def features(texts: pa.Array) -> np.ndarray:
    """The features of each text, rows by ``FEATURES``."""
    texts = pc.fill_null(texts, "")
    n = len(texts)
    strings = texts.to_pylist()
    size = np.fromiter((len(t.encode("utf-8", "surrogatepass")) for t in strings), np.int64, n)
    kind = KIND[np.frombuffer("".join(strings).encode("utf-8", "surrogatepass"), np.uint8)]
    of = np.repeat(np.arange(n), size)
    count = np.bincount(of * 8 + kind, minlength=8 * n).reshape(n, 8).astype(np.float64)
    filled = np.maximum(size - count[:, BLANK], 1)
    letters = np.maximum(count[:, LOWER] + count[:, UPPER], 1)
    # Words whose last byte is neither letter, digit nor mark.
    odd = np.flatnonzero((kind[:-1] >= SHOUT) & (kind[1:] == BLANK) & (of[:-1] == of[1:]))
    odd = np.bincount(of[odd], minlength=n)

    h, at = token_hashes(texts)
    words = np.diff(at).astype(np.float64)
    some = np.maximum(words, 1)
    row = np.repeat(np.arange(n), np.diff(at))
    kinds, most = _repeats(h, row, n)
    follows = row[1:] == row[:-1]
    same = np.bincount(row[1:][follows & (h[1:] == h[:-1])], minlength=n)
    pair_kinds, _ = _repeats(((h[:-1] * np.uint64(0x9E3779B97F4A7C15)) ^ h[1:])[follows], row[1:][follows], n)
    pairs = np.maximum(words - 1, 0)

    lines = pc.split_pattern(texts, "\n")
    n_lines = np.maximum(np.diff(lines.offsets.to_numpy()), 1)
    coded = pc.dictionary_encode(lines.flatten())
    line_h = hash_strings(coded.dictionary)[coded.indices.to_numpy()] if len(coded) else np.zeros(0, np.uint64)
    line_kinds, _ = _repeats(line_h, np.repeat(np.arange(n), np.diff(lines.offsets.to_numpy())), n)

    return np.column_stack([
        np.log2(words + 1), filled / some, np.log2(words / n_lines + 1), letters / filled, count[:, UPPER] / letters, count[:, DIGIT] / filled, count[:, MARK] / some, count[:, SHOUT] / some,
        count[:, SYMBOL] / filled, count[:, BAR] / some, same / some, kinds / some, most / some, (pairs - pair_kinds) / np.maximum(pairs, 1), (n_lines - line_kinds) / n_lines, odd / some,
    ])


@dataclass
class Model:
    """Log-odds: a constant, a table per feature, a table per pair."""

    base: float = 0.0
    edges: list[np.ndarray] = field(default_factory=list)
    tables: list[np.ndarray] = field(default_factory=list)
    coarse: list[np.ndarray] = field(default_factory=list)
    pairs: list[tuple[int, int]] = field(default_factory=list)
    pair_tables: list[np.ndarray] = field(default_factory=list)

    def score(self, x: np.ndarray) -> np.ndarray:
        """Probability of label 1 for rows of features."""
        z = np.full(len(x), self.base)
        for k, (edges, table) in enumerate(zip(self.edges, self.tables, strict=True)):
            z += table[np.searchsorted(edges, x[:, k], "right")]
        for (a, b), table in zip(self.pairs, self.pair_tables, strict=True):
            z += table[np.searchsorted(self.coarse[a], x[:, a], "right"), np.searchsorted(self.coarse[b], x[:, b], "right")]
        return 1 / (1 + np.exp(-z))


def cuts(values: np.ndarray, bins: int) -> np.ndarray:
    """At most ``bins`` - 1 rising bounds, at quantiles of the different values as well as of all."""
    kinds = np.unique(values)
    if len(kinds) <= bins:
        return (kinds[1:] + kinds[:-1]) / 2
    part = np.linspace(0, 1, bins // 2 + 1)[1:-1]
    return np.unique(np.concatenate([np.quantile(values, part), np.quantile(kinds, part)]))


def _best(g: np.ndarray, h: np.ndarray) -> tuple[float, int]:
    """Gain and place of the best cut of bins with these sums of gradients and second derivatives; place 0 if none is allowed."""
    if len(g) < 2:
        return 0.0, 0
    gl, hl = np.cumsum(g)[:-1], np.cumsum(h)[:-1]
    gs, hs = g.sum(), h.sum()
    fit = lambda a, b: a * a / (b + RIDGE)
    gain = np.where((hl >= LEAST_HESSIAN) & (hs - hl >= LEAST_HESSIAN), fit(gl, hl) + fit(gs - gl, hs - hl) - fit(gs, hs), 0.0)
    k = int(gain.argmax())
    return (float(gain[k]), k + 1) if gain[k] > 0 else (0.0, 0)


def tree(g: np.ndarray, h: np.ndarray, leaves: int = LEAVES) -> np.ndarray:
    """The step for each bin: a tree of so many leaves over a row of bins, grown by the best cut."""
    parts = [(0, len(g))]
    while len(parts) < leaves:
        gain, cut, part = max(((*_best(g[a:b], h[a:b]), (a, b)) for a, b in parts), key=lambda t: t[0])
        if not cut:
            break
        parts.remove(part)
        parts += [(part[0], part[0] + cut), (part[0] + cut, part[1])]
    step = np.zeros(len(g))
    for a, b in parts:
        step[a:b] = g[a:b].sum() / (h[a:b].sum() + RIDGE)
    return step


def pair_tree(g: np.ndarray, h: np.ndarray) -> tuple[float, np.ndarray]:
    """Gain and step of the best tree that cuts one axis of a table, then each side on the other axis."""
    best, step = 0.0, np.zeros(g.shape)
    for turned in (False, True):
        a, b = (g.T, h.T) if turned else (g, h)
        for cut in range(1, len(a)):
            gain, made = 0.0, np.zeros(a.shape)
            for rows in (slice(0, cut), slice(cut, None)):
                ga, ha = a[rows].sum(axis=0), b[rows].sum(axis=0)
                own, at = _best(ga, ha)
                gain += own + ga.sum() ** 2 / (ha.sum() + RIDGE)
                for columns in (slice(0, at), slice(at, None)):
                    made[rows, columns] = ga[columns].sum() / (ha[columns].sum() + RIDGE) if len(ga[columns]) else 0.0
            gain -= a.sum() ** 2 / (b.sum() + RIDGE)
            if gain > best:
                best, step = gain, made.T.copy() if turned else made
    return best, step


def fit(x: np.ndarray, y: np.ndarray, judge: np.ndarray) -> Model:
    """The model of rows of features and their labels; ``judge`` marks the rows that only tell when to stop."""
    if not len(y):
        return Model()
    rate = np.clip(y.mean(), 0.01, 0.99)
    model = Model(float(np.log(rate / (1 - rate))))
    if y.min() == y.max() or judge.all():
        return model
    learn = ~judge
    z = np.full(len(y), model.base)
    width = range(x.shape[1])
    model.edges = [cuts(x[learn, k], BINS) for k in width]
    model.coarse = [cuts(x[learn, k], PAIR_BINS) for k in width]
    bins = [np.searchsorted(model.edges[k], x[:, k], "right") for k in width]
    rough = [np.searchsorted(model.coarse[k], x[:, k], "right") for k in width]
    sizes, rough_sizes = [len(e) + 1 for e in model.edges], [len(e) + 1 for e in model.coarse]
    model.tables = [np.zeros(s) for s in sizes]

    def sums(at: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray]:
        p = 1 / (1 + np.exp(-z))
        return np.bincount(at[learn], (y - p)[learn], size), np.bincount(at[learn], (p * (1 - p))[learn], size)

    def loss() -> float:
        some = judge if judge.any() else learn
        return float((np.logaddexp(0, z) - y * z)[some].mean())

    def boost(places: list[np.ndarray], tables: list[np.ndarray], grow) -> None:
        """Round after round, a step for each table; the tables end as they were at the least loss."""
        nonlocal z
        best, kept, start, since = loss(), [t.copy() for t in tables], z.copy(), 0
        for _ in range(ROUNDS):
            for at, table in zip(places, tables, strict=True):
                g, h = sums(at, table.size)
                step = RATE * grow(g.reshape(table.shape), h.reshape(table.shape))
                table += step
                z = z + step.ravel()[at]
            now, since = loss(), since + 1
            if now < best - 1e-6:
                best, kept, since = now, [t.copy() for t in tables], 0
            elif since >= PATIENCE:
                break
        z = start
        for at, table, own in zip(places, tables, kept, strict=True):
            table[...] = own
            z = z + own.ravel()[at]

    boost(bins, model.tables, tree)
    gains = []
    for a in width:
        for b in range(a):
            shape = (rough_sizes[a], rough_sizes[b])
            g, h = (v.reshape(shape) for v in sums(rough[a] * shape[1] + rough[b], shape[0] * shape[1]))
            gains.append((pair_tree(g, h)[0], a, b))
    model.pairs = [(a, b) for gain, a, b in sorted(gains, reverse=True)[:PAIRS] if gain > 0]
    model.pair_tables = [np.zeros((rough_sizes[a], rough_sizes[b])) for a, b in model.pairs]
    boost([rough[a] * rough_sizes[b] + rough[b] for a, b in model.pairs], model.pair_tables, lambda g, h: pair_tree(g, h)[1])
    return model


def held_out(folds: int = 5) -> Column:
    return F.coalesce(F.pmod(F.crc32(F.col("doc_id").cast("string").cast("binary")), F.lit(folds)) == 0, F.lit(False))


def train(docs: DataFrame, labels: DataFrame, sample_docs: int = SAMPLE_DOCS) -> Model:
    """Fit on ``docs`` (doc_id, text) and ``labels`` (doc_id, quality 0 or 1), of which at most ``sample_docs`` are read."""
    draw = F.xxhash64("doc_id", F.lit(12))
    known = labels.filter("doc_id is not null and quality is not null").groupBy("doc_id").agg(F.max("quality").cast("double").alias("y"))
    chosen = known.withColumn("draw", draw).orderBy("draw", "doc_id").limit(sample_docs)
    rows = docs.select("doc_id", "text").join(F.broadcast(chosen), "doc_id").select("draw", "y", "text")

    @task
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for batch in slices(whole, "text"):
                x = features(batch.column("text"))
                yield pa.RecordBatch.from_arrays([batch.column("draw"), batch.column("y"), pa.array(list(x), pa.list_(pa.float64()))], ["draw", "y", "x"])

    got = rows.mapInArrow(run, "draw long, y double, x array<double>").toArrow().sort_by([("draw", "ascending"), ("y", "ascending")])
    if not got.num_rows:
        return Model()
    x = np.array(got.column("x").to_pylist())
    by = np.lexsort((*x.T, got.column("draw").to_numpy()))  # the same rows in the same order, whatever the tasks
    return fit(x[by], got.column("y").to_numpy()[by], got.column("draw").to_numpy()[by] % 4 == 0)


def score(docs: DataFrame, model: Model, name: str = "score") -> DataFrame:
    """``docs`` with a column of the probability of label 1, under ``name`` or the next free one."""
    schema = T.StructType([*docs.schema.fields, T.StructField(fresh(name, docs), T.DoubleType())])
    arrow = to_arrow_schema(schema)
    shared = docs.sparkSession.sparkContext.broadcast(model)

    @task
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for batch in slices(whole, "text"):
                found = pa.array(shared.value.score(features(batch.column("text"))))
                yield pa.RecordBatch.from_arrays([c.cast(f.type) for c, f in zip(batch.columns, arrow, strict=False)] + [found], schema=arrow)

    return docs.mapInArrow(run, schema)


def predictions(docs: DataFrame, labels: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """The contract's query: learn where crc32(doc_id) mod 5 is not 0, score every row."""
    model = train(docs.filter(~held_out()), labels)
    return score(docs.select("doc_id", "text"), model).select("doc_id", held_out().alias("held_out"), "score", (F.col("score") >= threshold).cast("int").alias("predicted"))
