"""Periodic runs: all maximal repetitions of words, from Lyndon arrays in linear time.

A run is a stretch of words with smallest period q that no neighbour extends. Every run holds, for one of the two orders
of the alphabet (words by their first place, and the reverse), a longest Lyndon word of length q; so the runs follow from the
next smaller suffixes of both orders. No suffix array, suffix tree or hash of substrings is made: words are numbered, and
numbers are compared.

``lyndon`` goes over a text once, from left to right, and keeps the chain of suffixes that are smaller than all after them.
A new suffix ends the edges of the chain's suffixes that are larger. What two suffixes share is found with three rules, so that each
comparison either is the last one for an edge or moves the rightmost matched place on, and the whole takes linear time:

* Inside a matched extension S[a..a+e) = S[b..b+e) the suffix at b + x does what the suffix at a + x did, as long as that was decided
  inside; its edges are copied, not compared.
* Where it was not decided inside, the two suffixes share all up to the extension's end, and comparison begins there.
* Along the chain, what a suffix shares with the next one follows from what that shares with the last, unless both are equal.

The first Lyndon root of a run has an edge of the run's period, and what its ends share is how far the run goes on to the
right; to the left it goes on less than a period.

Texts are independent: they are spread over tasks in slices of bounded size, nothing is shuffled, and a lost task is done again.

Defined cases: null, empty and blank texts have no words, no runs and stay as they are (their collapsed text is empty); rows are
judged one by one, so repeated rows, ties and rows without doc_id do not matter; a text of one repeated word is one run of period
1; other columns pass through ``collapse`` unchanged in any case of letters (new columns get a name that is free); an empty table gives an empty result.
"""

from __future__ import annotations

import hashlib
import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

from profusion.llm.common import fresh, slices, task

#: A run has at least so many words and so many periods.
LEAST_WORDS, LEAST_PERIODS = 6, 4


def split_words(text: str | None) -> list[bytes]:
    """The runs of characters other than [\\x20\\x09-\\x0D], as UTF-8."""
    return (text or "").encode("utf-8", "surrogatepass").split()


def lyndon(s: list[int], counted: list[int] | None = None) -> tuple[list[int], list[int]]:
    """For each suffix of ``s`` (numbers from 0) the next smaller suffix and how much they share, where that is anything.

    A suffix without a smaller one, or that shares nothing with it, has 0 shared words; a suffix is larger than its prefixes.
    ``counted[0]`` grows by the comparisons of words.
    """
    n = len(s)
    s = [*s, -1]  # also read as s[-1], the end of the chain
    before, shared = [-1] * n, [0] * n  # the chain below, and what is shared with it
    after, ahead = [0] * n, [0] * n
    most = [0] * n  # the most that a suffix shares with one that it was compared with
    a = b = end = 0  # s[a:a + end - b] == s[b:end], and s[a + end - b] != s[end]
    steps = 0
    for r in range(1, n):
        c, x = r - 1, s[r]
        if r >= end:
            while s[c] > x:
                c = before[c]
            if s[c] < x:
                before[r] = c
                continue
            l = 1
            steps += 1
        else:
            d = b - a
            m, copy = end - r, r - d
            if most[copy] < m:  # all was decided inside the extension
                below = before[copy] + d
                while c != below:
                    l = ahead[c - d]
                    if l:
                        after[c], ahead[c] = r, l
                    c = before[c]
                before[r], shared[r], most[r] = below, shared[copy], most[copy]
                continue
            while True:  # as far as it was decided inside
                l = shared[copy] if c - d == before[copy] else ahead[c - d]
                if l >= m:
                    l = m
                    break
                if l:
                    after[c], ahead[c] = r, l
                c = before[c]
        while True:
            at = l
            while s[c + l] == s[r + l]:
                l += 1
            steps += l - at + 1
            best = c
            if s[c + l] < s[r + l]:
                before[r], shared[r] = c, l
                break
            after[c], ahead[c] = r, l
            below, known = before[c], shared[c]
            while below >= 0 and known > l:  # shares with r what its neighbour shares, and is larger likewise
                c = below
                after[c], ahead[c] = r, l
                below, known = before[c], shared[c]
            if below < 0 or known < l:
                before[r], shared[r] = below, known
                break
            c = below
        most[r] = l
        a, b, end = best, r, r + l
    if counted is not None:
        counted[0] += steps
    return after, ahead


def find_runs(s: list[int], least_words: int = LEAST_WORDS, least_periods: int = LEAST_PERIODS) -> list[tuple[int, int, int]]:
    """Start, length and smallest period of every run of at least so many words and periods (two or more), by start, then period."""
    if least_periods < 2:
        raise ValueError("a run has two periods at least")
    found = set()
    top = max(s, default=0)
    for order in (s, [top - x for x in s]):
        after, ahead = lyndon(order)
        for at, right in enumerate(ahead):
            if not right or right <= (least_periods - 2) * (p := after[at] - at):
                continue
            left = 0
            while left < p and at - left > 0 and s[at - left - 1] == s[at - left - 1 + p]:
                left += 1
            if left < p and left + p + right >= max(least_words, least_periods * p):
                found.add((at - left, left + p + right, p))
    return sorted(found)


def runs_of(words: list[bytes], **least) -> list[tuple[int, int, int]]:
    number = {w: i for i, w in enumerate(dict.fromkeys(words))}
    return find_runs(list(map(number.__getitem__, words)), **least)


def without_repeats(words: list[bytes], runs: list[tuple[int, int, int]]) -> list[bytes]:
    """The words that no run holds after its first period."""
    if not runs:
        return words
    out, at = [], 0
    for start, end in sorted((a + p, a + n) for a, n, p in runs):
        out += words[at : max(at, start)]
        at = max(at, end)
    return out + words[at:]


def _mapped(docs: DataFrame, new: list[T.StructField], rows) -> DataFrame:
    """``docs`` with the new columns, of which ``rows`` makes the lists from the words of each text."""
    schema = T.StructType([*docs.schema.fields, *new])
    arrow = to_arrow_schema(schema)
    kept = len(docs.columns)

    @task
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for batch in slices(whole, "text"):
                made = rows(batch)
                columns = [batch.column(i).cast(arrow.field(i).type) for i in range(kept)]
                yield pa.RecordBatch.from_arrays(columns + [pa.array(x, arrow.field(kept + i).type) for i, x in enumerate(made)], schema=arrow)

    return docs.mapInArrow(run, schema)


def find(docs: DataFrame) -> DataFrame:
    """``docs`` with a column ``runs`` (or the next free name): an array of start, length, period (long), by start, then period."""
    run = T.StructType([T.StructField(c, T.LongType()) for c in ("start", "length", "period")])

    def rows(batch: pa.RecordBatch) -> list[list]:
        found = (runs_of(split_words(t)) for t in batch.column("text").to_pylist())
        return [[[{"start": a, "length": n, "period": p} for a, n, p in own] for own in found]]

    return _mapped(docs, [T.StructField(fresh("runs", docs), T.ArrayType(run))], rows)


def collapse(docs: DataFrame) -> DataFrame:
    """``docs`` with a column ``collapsed`` (or the next free name): the text's words but those that repeat a run's first period,
    joined by one space."""

    def rows(batch: pa.RecordBatch) -> list[list]:
        words = [split_words(t) for t in batch.column("text").to_pylist()]
        return [[b" ".join(without_repeats(w, runs_of(w))).decode("utf-8", "surrogatepass") for w in words]]

    return _mapped(docs, [T.StructField(fresh("collapsed", docs), T.StringType())], rows)


def disturbed(doc_id: int | None, words: list[bytes]) -> list[bytes]:
    """The contract's words: of about a tenth of the documents, chosen by the id, a tail repeats itself."""
    h = zlib.crc32(str(doc_id).encode()) if doc_id is not None else 1
    g, n = h // 10, len(words)
    if h % 10 or not n:
        return words
    a = g % n
    p = 1 + (n - a) // (3 + g % 8)
    return words[:a] + (words[a : a + p] * (-(-(n - a) // p)))[: n - a]


DIGESTS = "doc_id long, n_runs long, start long, length long, period long, exponent_milli long, runs_sha256 string, collapsed_sha256 string"


def digests(docs: DataFrame) -> DataFrame:
    """The contract's query: a row per document."""

    @task
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for batch in slices(whole, "text"):
                yield pa.RecordBatch.from_pylist([_digest(*x) for x in zip(*(batch.column(c).to_pylist() for c in ("doc_id", "text")), strict=True)], schema=_arrow(DIGESTS))

    return docs.selectExpr("cast(doc_id as long) as doc_id", "text").mapInArrow(run, DIGESTS)


def _arrow(ddl: str) -> pa.Schema:
    kinds = {"long": pa.int64(), "string": pa.string()}
    return pa.schema([(name, kinds[kind]) for name, kind in (x.split() for x in ddl.split(", "))])


def _digest(doc_id: int | None, text: str | None) -> dict:
    words = disturbed(doc_id, split_words(text))
    runs = runs_of(words)
    start, length, period = min(runs, key=lambda r: (-r[1], r[0], r[2])) if runs else (None, None, None)
    sha = lambda x: hashlib.sha256(x).hexdigest()
    return {
        "doc_id": doc_id, "n_runs": len(runs), "start": start, "length": length, "period": period, "exponent_milli": 1000 * length // period if runs else None,
        "runs_sha256": sha("".join("%d,%d,%d\n" % r for r in runs).encode()), "collapsed_sha256": sha(b" ".join(without_repeats(words, runs))),
    }
