"""LM scoring: quantised n-gram counts in a log-frequency Bloom filter, probed by the workers.

Counts of one- and two-word sequences of the training documents (each text between end marks) are quantised
to levels with the lower bounds 1, 2, 3, 4, 6, 8, 12, 16, ... A level-q sequence is entered with each of the
levels 1..q; its level is read back by probing 1, 2, ... until a probe fails, so counts are never
underestimated and are overestimated by one level with the filter's error rate (about 1 %).

* Sequences are hashed into segments, whose number follows the corpus. Tasks send sorted, delta-coded
  32-bit prints and counts for each segment (about 2.5 bytes a sequence); one task per segment adds them up
  and builds the segment's filter at ``BITS`` bits an entry.
* The segments are written to the shared folder by the executors and sent to every executor as files of
  its own (``addFile``); the driver sees their names only. Workers map the files into memory, so that all
  workers of a machine share one copy and read what they probe. The filter grows with the distinct
  sequences of the corpus: every machine needs the disk for it, and memory for it to be fast.
* P(w | h) = (low(h w) + MU P(w)) / (high(h) + MU) over P(w) = (low(w) + 1) / (N + V + 1), where low and high
  are the least and the largest count of a level. As low(h w) adds up to c(h) at most, these probabilities
  add up to 1 at most for each h, but for errors of the filter (about 1 % of the pairs that never occur seem to
  occur once).

The exact unigram base score needs exact counts. The words with the highest counts, at most
``HEAD_WORDS``, are broadcast; all other occurrences are joined by hash, so no hot word is ever shuffled.
Words are told apart by 64-bit hashes.

Defined cases: a null or empty text is one end mark; a row without doc_id is a training row; rows that
repeat are scored and counted each; with no training row every probability is that of V = N = 0; other
columns are not read; an empty table gives an empty result.
"""

from __future__ import annotations

import os
import uuid
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.parquet as pq
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from profusion.llm.common import END_TOKEN, mix, signed, slices, task, token_hashes
from profusion.session import written

BITS, MU = 12, 2.0
HEAD_WORDS = 1 << 18
SEGMENT_TOKENS = 500_000
#: The least count of each level, from level 1 on.
LEAST = np.array([1, 2, 3, *(x << k for k in range(61) for x in (4, 6))], np.int64)
#: Tokens that a task counts, or scores, at a time; entries whose places are computed at a time.
COUNT_TOKENS, SCORE_TOKENS, CHUNK = 1_000_000, 500_000, 250_000
_F = np.uint64(0x9E3779B97F4A7C15)
_TWO = np.uint64(0xD1B54A32D192ED03)


def _sequences(batches: Iterator[pa.RecordBatch], most: int = COUNT_TOKENS):
    """Batches of rows with their tokens: (row columns, tokens with leading and closing end marks, row of each token)."""
    rows, parts, total = [], [], 0

    def done():
        n = np.concatenate([np.diff(o) for _, o in parts])
        words = np.concatenate([w for w, _ in parts])
        out = np.full(len(words) + 2 * len(n), END_TOKEN, np.uint64)
        row = np.repeat(np.arange(len(n), dtype=np.int32), n + 2)
        out[np.arange(len(words)) + 2 * np.repeat(np.arange(len(n)), n) + 1] = words
        return pa.Table.from_batches(rows), out, row

    for whole in batches:
        for batch in slices(whole, "text"):
            parts.append(token_hashes(batch.column("text")))
            rows.append(batch)
            total += len(parts[-1][0])
            if total >= most:
                yield done()
                rows, parts, total = [], [], 0
    if rows:
        yield done()


def _items(tokens: np.ndarray, row: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Hashes of the predicted tokens' unigrams and bigrams, and which tokens are predicted (all but the leading marks)."""
    predicted = np.flatnonzero(np.concatenate([[False], row[1:] == row[:-1]])) if len(row) else np.zeros(0, np.int64)
    one = mix(tokens + _F)
    two = mix(tokens[predicted - 1] * _F + tokens[predicted] + _TWO)
    return one, two, predicted


@task
def _unigrams(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for _, tokens, row in _sequences(batches):
        _, _, predicted = _items(tokens, row)
        h, n = np.unique(tokens[predicted], return_counts=True)
        yield pa.RecordBatch.from_arrays([pa.array(signed(h)), pa.array(n)], ["h", "n"])


def segment_of(items: np.ndarray, segments: int) -> np.ndarray:
    return ((items >> np.uint64(32)) * np.uint64(segments) >> np.uint64(32)).astype(np.int64)


def prints_of(items: np.ndarray) -> np.ndarray:
    return (items & np.uint64(0xFFFFFFFF)).astype(np.uint32)


def pack(prints: np.ndarray, counts: np.ndarray) -> bytes:
    """Sorted prints as byte planes of their differences, then the counts."""
    gaps = np.diff(prints, prepend=np.uint32(0)).astype("<u4")
    planes = gaps.view(np.uint8).reshape(-1, 4).T
    return len(prints).to_bytes(4, "little") + zlib.compress(planes.tobytes() + counts.astype("<u4").view(np.uint8).reshape(-1, 4).T.tobytes(), 1)


def unpack(blob: bytes) -> tuple[np.ndarray, np.ndarray]:
    n = int.from_bytes(blob[:4], "little")
    raw = np.frombuffer(zlib.decompress(blob[4:]), np.uint8).reshape(8, n)
    whole = lambda p: np.ascontiguousarray(p.T).view("<u4").ravel()
    return np.cumsum(whole(raw[:4]), dtype=np.uint32), whole(raw[4:])


def _packed(segments: int):
    @task
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for _, tokens, row in _sequences(batches):
            one, two, predicted = _items(tokens, row)
            items, n = np.unique(np.concatenate([one[predicted], two]), return_counts=True)
            at = np.searchsorted(segment_of(items, segments), np.arange(segments + 1))
            full = np.flatnonzero(np.diff(at))
            blobs = []
            for s in full:
                own = prints_of(items[at[s] : at[s + 1]])
                by = np.argsort(own)
                blobs.append(pack(own[by], n[at[s] : at[s + 1]][by]))
            yield pa.RecordBatch.from_arrays([pa.array(full.astype(np.int32)), pa.array(blobs, pa.binary())], ["segment", "blob"])

    return run


def _places(prints: np.ndarray, level: int | np.ndarray, words: int | np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Word and four-bit mask of entries."""
    h = mix(prints.astype(np.uint64) * _F + np.asarray(level).astype(np.uint64) * _TWO)
    bit = lambda k: np.uint64(1) << ((h >> np.uint64(40 + 6 * k)) & np.uint64(63))
    return ((h & np.uint64(0xFFFFFFFFFF)) % np.asarray(words).astype(np.uint64)).astype(np.int64), bit(0) | bit(1) | bit(2) | bit(3)


def build_segment(prints: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """The filter of a segment: distinct prints with their counts."""
    level = np.searchsorted(LEAST, counts, "right")
    words = np.zeros(max(1, -(-int(level.sum()) * BITS // 64)), np.uint64)
    for start in range(0, len(prints), CHUNK):
        left, q = prints[start : start + CHUNK], level[start : start + CHUNK]
        for each in range(1, int(q.max()) + 1):
            at, mask = _places(left[q >= each], each, len(words))
            np.bitwise_or.at(words, at, mask)
    return words


def _segment(rows: pa.Table) -> pa.Table:
    parts = [unpack(b) for b in rows.column("blob").to_pylist()]
    prints, counts = np.concatenate([p for p, _ in parts]), np.concatenate([c for _, c in parts])
    by = np.argsort(prints)
    prints, counts = prints[by], counts[by].astype(np.int64)
    first = np.flatnonzero(np.concatenate([[True], prints[1:] != prints[:-1]]))
    words = build_segment(prints[first], np.add.reduceat(counts, first))
    return pa.table({"segment": rows.column("segment").slice(0, 1), "words": pa.array([words.tobytes()], pa.binary())})


def _mapped(name: str) -> tuple[np.ndarray, np.ndarray]:
    """The segments of a file sent to this machine, as rows (segment, start, size), and their words, mapped from disk.

    The first worker that needs a file writes its words one after the other beside it, and removes the file.
    """
    from pyspark import SparkFiles

    source = SparkFiles.get(name)
    words, index = f"{source}.words", f"{source}.npy"
    if not os.path.exists(index):
        own, rows, at = f"{source}.{uuid.uuid4().hex}", [], 0
        try:
            with open(own, "wb") as f:
                for batch in pq.ParquetFile(source).iter_batches(batch_size=16):
                    for segment, raw in zip(batch.column("segment").to_pylist(), batch.column("words"), strict=True):
                        f.write(raw.as_buffer())
                        rows.append((segment, at, len(raw.as_buffer()) // 8))
                        at += rows[-1][2]
            np.save(f"{own}.npy", np.array(rows, np.int64).reshape(-1, 3))
            os.replace(own, words)
            os.replace(f"{own}.npy", index)
            os.remove(source)
        except FileNotFoundError:
            if not os.path.exists(index):  # else another worker was faster
                raise
    rows = np.load(index)
    return rows, np.memmap(words, np.uint64, "r") if len(rows) else np.zeros(0, np.uint64)


class Filter:
    """The segments in files of this machine, mapped when first used."""

    def __init__(self, segments: int, files: list[str]):
        self.segments, self.files, self.held = segments, files, None

    def __getstate__(self):
        return {"segments": self.segments, "files": self.files, "held": None}

    def _open(self):
        if self.held is None:
            file, start, size = np.zeros(self.segments, np.int32), np.zeros(self.segments, np.int64), np.zeros(self.segments, np.int64)
            words = []
            for k, name in enumerate(self.files):
                rows, own = _mapped(name)
                words.append(own)
                file[rows[:, 0]], start[rows[:, 0]], size[rows[:, 0]] = k, rows[:, 1], rows[:, 2]
            self.held = file, start, size, words
        return self.held

    def levels(self, items: np.ndarray) -> np.ndarray:
        """The level of each item (uint8), 0 if it is not held."""
        file, start, size, words = self._open()
        out = np.zeros(len(items), np.uint8)
        segment = segment_of(items, self.segments)
        by = np.argsort(file[segment], kind="stable") if len(words) > 1 else np.arange(len(items))
        cut = np.searchsorted(file[segment[by]], np.arange(len(words) + 1))
        for k, flat in enumerate(words):
            for at in range(cut[k], cut[k + 1], CHUNK):
                own = by[at : min(at + CHUNK, cut[k + 1])]
                own, level = own[size[segment[own]] > 0], 0
                while len(own):
                    level += 1
                    s = segment[own]
                    place, mask = _places(prints_of(items[own]), level, size[s])
                    own = own[flat[start[s] + place] & mask == mask]
                    out[own] = level
        return out


def low(level: np.ndarray) -> np.ndarray:
    """The least count of a level; 0 for level 0."""
    return np.concatenate([[0], LEAST]).astype(float)[level]


def high(level: np.ndarray) -> np.ndarray:
    """The largest count of a level; 0 for level 0."""
    return (LEAST - 1).astype(float)[level]


def build_filter(training: DataFrame, tokens: int) -> Filter:
    spark = training.sparkSession
    segments = max(8, -(-tokens // SEGMENT_TOKENS))
    packed = training.select("text").mapInArrow(_packed(segments), "segment int, blob binary")
    built = written(packed.groupBy("segment").applyInArrow(_segment, "segment int, words binary"), "bloom-segments")
    paths = sorted(built.inputFiles())
    for path in paths:
        spark.sparkContext.addFile(path)
    return Filter(segments, [os.path.basename(p) for p in paths])


ROW = "rid long, doc_id long, held_out boolean, n_tokens long, n_known long, base double, score double, h long, times long"


def probability(two: np.ndarray, before: np.ndarray, one: np.ndarray, total: int, kinds: int) -> np.ndarray:
    """P(w | h) from the levels of h w, h and w. A word pair cannot be more frequent than its first word."""
    most = high(before)
    return (np.minimum(low(two), most) + MU * (low(one) + 1) / (total + kinds + 1)) / (most + MU)


def _scores(filter_: Filter, head, total: int, kinds: int):
    @task
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        rid, (known_h, known_c) = TaskContext.get().partitionId() << 36, head.value
        for rows, tokens, row in _sequences(batches, SCORE_TOKENS):
            one, two, predicted = _items(tokens, row)
            of, n = row[predicted], rows.num_rows
            distinct, back = np.unique(one, return_inverse=True)
            level = filter_.levels(distinct)[back]
            score = np.bincount(of, np.log10(probability(filter_.levels(two), level[predicted - 1], level[predicted], total, kinds)), n)
            # Exact base score: the head here, the rest by a join.
            word = tokens[predicted]
            at = np.searchsorted(known_h, word)
            at[at == len(known_h)] = 0
            hit = known_h[at] == word if len(known_h) else np.zeros(len(word), bool)
            base = np.bincount(of[hit], np.log10((known_c[at[hit]] + 1) / (total + kinds + 1)), n)
            rest_row, rest_word = of[~hit], word[~hit]
            by = np.lexsort((rest_word, rest_row))
            rest_row, rest_word = rest_row[by], rest_word[by]
            first = np.flatnonzero(np.concatenate([[True], (rest_row[1:] != rest_row[:-1]) | (rest_word[1:] != rest_word[:-1])])) if len(by) else np.zeros(0, np.int64)
            times = np.diff(np.concatenate([first, [len(by)]]))
            ids = rid + np.arange(n, dtype=np.int64)
            rid += n
            none = pa.nulls
            m = len(first)
            ints = lambda x: pa.array(x.astype(np.int64))
            col = lambda name: rows.column(name).combine_chunks()
            yield pa.RecordBatch.from_arrays([
                ints(ids), col("doc_id"), col("held_out"), ints(np.bincount(of, minlength=n)), ints(np.bincount(of[hit], minlength=n)), pa.array(base.astype(float)), pa.array(score.astype(float)), pa.array(signed(mix(ids.astype(np.uint64) + _TWO))), pa.array(np.zeros(n, np.int64)),
            ], names=_NAMES)
            yield pa.RecordBatch.from_arrays([
                ints(ids[rest_row[first]]), none(m, pa.int64()), none(m, pa.bool_()), none(m, pa.int64()), none(m, pa.int64()), none(m, pa.float64()), none(m, pa.float64()), pa.array(signed(rest_word[first])), ints(times),
            ], names=_NAMES)

    return run


_NAMES = [x.split(" ")[0] for x in ROW.split(", ")]


def held_out(folds: int = 7, fold: int = 2):
    return F.coalesce(F.pmod(F.crc32(F.col("doc_id").cast("string").cast("binary")), F.lit(folds)) == fold, F.lit(False))


def score(docs: DataFrame, train=None) -> DataFrame:
    """doc_id, held_out, n_tokens, n_known, train_tokens (long), base_score, score (double) per document.

    ``train``: a condition on doc_id that tells the held-out rows; by default the contract's.
    """
    out = held_out() if train is None else train
    spark = docs.sparkSession
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text", out.alias("held_out"))
    training = rows.filter(~F.col("held_out"))
    counts = written(training.select("text").mapInArrow(_unigrams, "h long, n long").groupBy("h").agg(F.sum("n").alias("c")), "unigrams")
    total, kinds = counts.agg(F.coalesce(F.sum("c"), F.lit(0)), F.count("*")).first()
    # The lowest count of the head: at most HEAD_WORDS words have it or more. Counts are looked at in steps of an eighth of an octave.
    step = F.floor(F.log2("c") * 8).cast("int")
    steps = counts.groupBy(step.alias("step")).agg(F.min("c").alias("c"), F.count("*").alias("k")).orderBy(F.desc("step")).collect()
    least, held = int(total) + 1, 0
    for r in steps:
        held += r["k"]
        if held > HEAD_WORDS:
            break
        least = r["c"]
    top = counts.filter(F.col("c") >= least).toPandas().sort_values("h", key=lambda h: h.astype("int64").to_numpy().view(np.uint64))
    head = spark.sparkContext.broadcast((np.ascontiguousarray(top["h"].to_numpy(np.int64)).view(np.uint64), top["c"].to_numpy(np.float64)))
    model = build_filter(training, int(total))
    scored = rows.mapInArrow(_scores(model, head, int(total), int(kinds)), ROW)
    rest = counts.filter(F.col("c") < least)
    own = F.col("n_tokens").isNull()
    c = F.when(own, F.coalesce("c", F.lit(0)))
    joined = scored.join(rest, "h", "left").select("rid", "doc_id", "held_out", "n_tokens", F.when(own, F.when(c > 0, F.col("times")).otherwise(0)).otherwise(F.col("n_known")).alias("n_known"), F.when(own, F.col("times") * F.log10((c + 1) / F.lit(float(total + kinds + 1)))).otherwise(F.col("base")).alias("base"), "score")
    return joined.groupBy("rid").agg(
        F.max("doc_id").alias("doc_id"), F.max("held_out").alias("held_out"), F.max("n_tokens").alias("n_tokens"), F.sum("n_known").alias("n_known"),
        F.lit(int(total)).cast("long").alias("train_tokens"), F.sum("base").alias("base_score"), F.max("score").alias("score"),
    ).drop("rid")
