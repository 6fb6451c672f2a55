"""MinHash near-dedup: BagMinHash signatures, banding, exact multiset overlap, connected classes.

A text is the multiset of its five-word shingles (A-Z lower-cased words, cut at white space; a text of
fewer than five words is one shingle of all its words). Two texts are linked when the weighted Jaccard
similarity of their multisets is 0.8 or more; classes are the connected components of the links.

* Signatures. A shingle of count w owns Poisson processes over the weight axis, one for each dyadic cell
  [0,1), [1,2), [2,4), ... below w, seeded by shingle and cell, of rate equal to the cell's width. A point
  has a time, a position in its cell and a component; it counts iff its position is below w. A component
  is the earliest counted point, so two signatures agree in it with probability equal to the weighted
  Jaccard similarity. A process stops once its time passes the largest minimum of the document.
* Candidates. 32 bands of 4 components: two texts of similarity 0.8 share no band with probability 5e-8.
  Exact copies are one node from the start, so a group of copies has one row per band.
* No pairs within a bucket. Members are verified against the bucket's smallest. A bucket whose members are
  then in one class is done. In the others, blocks of signatures are compared; pairs of different classes
  that agree in 60 % of the components tie their members into a group (at similarity 0.8 a true link lies
  5.6 standard deviations above that). Within a group, blocks of multisets are compared exactly, as one
  matrix product per two blocks, and a task returns only links that join classes. Nothing is capped, and
  no step has a row per pair.
* Verification streams members past their leader's text; a leader of many members has several copies.

Defined cases: null, empty and blank texts have no shingles and are copies of each other; rows that share
a doc_id share their links; rows without doc_id count as one last document; other columns pass through;
an empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from profusion.llm.common import NO_ID, fresh, id_or_last, mix, slices, task, token_hashes
from profusion.operators.components import components
from profusion.session import shuffle_partitions, written

WORDS = 5
SIMILARITY = 0.8
COMPONENTS, ROWS = 128, 4
LIKELY = 0.6
#: So that a similarity of exactly the bound counts.
ROUNDING = 1e-6
#: Members, counted in each bucket, that a copy of a leader's text serves; signatures and multisets in a block; columns of a product.
LEADER_SHARE, BLOCK, EXACT_BLOCK, COLUMNS = 512, 512, 256, 8192
#: The class that stands for all small ones, which share their blocks.
SHARED = -(1 << 63)
#: Open groups whose lists of blocks are broadcast.
BROADCAST_ROWS = 100_000
#: A multiset of more bytes takes the room of several in a block.
BAG_BYTES = 16 << 10
_FACTOR = np.uint64(0x9E3779B97F4A7C15)


def _step(i: int) -> np.uint64:
    return np.uint64(i * int(_FACTOR) % (1 << 64))


def shingles(words: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Shingle hashes of all rows and the row of each."""
    n = np.diff(offsets)
    row = np.repeat(np.arange(len(n)), n)
    left = offsets[1:][row] - np.arange(len(words))  # words from here to the end of the row
    acc = np.zeros(len(words), np.uint64)
    for j in range(WORDS):
        ahead = np.zeros(len(words), np.uint64)
        ahead[: max(0, len(words) - j)] = words[j:]
        acc = acc * _FACTOR + np.where(left > j, ahead, np.uint64(j + 1))
    whole = np.minimum(n, WORDS)[row] <= left
    return mix(acc[whole]), row[whole]


def bags(texts: pa.Array, ordered: bool = True) -> tuple[np.ndarray, np.ndarray, np.ndarray, tuple[np.ndarray, np.ndarray]]:
    """Row, shingle and count of the rows' multisets, by row and shingle if ``ordered``; the words and their offsets."""
    words, offsets = token_hashes(texts)
    s, row = shingles(words, offsets)
    if not ordered:  # few shingles repeat within a row: only those are sorted
        own = mix(s + (row.astype(np.uint64) + np.uint64(1)) * _FACTOR)
        by_own = np.sort(own)
        often = np.isin(own, by_own[1:][by_own[1:] == by_own[:-1]], kind="sort")
        once, s2, row2 = (row[~often], s[~often]), s[often], row[often]
    else:
        once, s2, row2 = (row[:0], s[:0]), s, row
    order = np.lexsort((s2, row2))
    s2, row2 = s2[order], row2[order]
    first = np.flatnonzero(np.concatenate([[True], (s2[1:] != s2[:-1]) | (row2[1:] != row2[:-1])])) if len(s2) else np.zeros(0, np.int64)
    count = np.diff(np.concatenate([first, [len(s2)]]))
    return np.concatenate([once[0], row2[first]]), np.concatenate([once[1], s2[first]]), np.concatenate([np.ones(len(once[0]), np.int64), count]), (words, offsets)


def bag_minhash(row: np.ndarray, shingle: np.ndarray, count: np.ndarray, rows: int, m: int = COMPONENTS) -> np.ndarray:
    """Signatures (rows x m, uint32) of multisets; rows without shingles get zeros."""
    sig = np.full(rows * m, np.inf)
    cells = 1 + np.ceil(np.log2(np.maximum(count, 1))).astype(np.int64)
    of = np.repeat(np.arange(len(row)), cells)
    cell = np.arange(len(of)) - np.repeat(np.cumsum(cells) - cells, cells)
    low = np.where(cell > 0, 2.0 ** (cell - 1), 0.0)
    width = np.where(cell > 0, low, 1.0)
    key = mix(shingle[of] + (cell.astype(np.uint64) + np.uint64(1)) * _FACTOR)
    doc, most, t = row[of], count[of].astype(float), np.zeros(len(of))
    point = 0
    while len(key):
        point += 2
        u = (mix(key + _step(point)) >> np.uint64(11)).astype(float) + 1
        v = mix(key + _step(point + 1))
        t = t - np.log(u / 2.0**53) / width
        at = low + width * ((v >> np.uint64(32)).astype(float) / 2.0**32)
        counts = at < most
        np.minimum.at(sig, (doc * m + (v % np.uint64(m)).astype(np.int64))[counts], t[counts])
        alive = t < sig.reshape(-1, m).max(axis=1)[doc]
        key, doc, most, low, width, t = (x[alive] for x in (key, doc, most, low, width, t))
    sig[np.isinf(sig)] = 0
    return (mix(sig.view(np.uint64)) >> np.uint64(32)).astype(np.uint32).reshape(rows, m)


@task
def _signed_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for whole in batches:
        for batch in slices(whole, "text"):
            row, s, count, (words, offsets) = bags(batch.column("text"), ordered=False)
            sig = bag_minhash(row, s, count, batch.num_rows)
            raw = memoryview(np.ascontiguousarray(words)).cast("B")
            digests = np.frombuffer(b"".join(xxhash.xxh3_128_digest(raw[8 * a : 8 * b]) for a, b in zip(offsets[:-1], offsets[1:], strict=True)), np.int64).reshape(-1, 2)
            yield pa.RecordBatch.from_arrays([
                batch.column("id"), pa.array(np.ascontiguousarray(digests[:, 0])), pa.array(np.ascontiguousarray(digests[:, 1])),
                pa.array([x.tobytes() for x in sig], pa.binary()), pa.array(np.diff(offsets) > 0),
            ], ["id", "k1", "k2", "sig", "filled"])


def _verify(least: float):
    @task
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Rows come sorted: a leader's text, then its members."""
        now, lead = None, None
        for whole in batches:
            for batch in slices(whole, "text"):
                row, s, count, _ = bags(batch.column("text"))
                cut = np.searchsorted(row, np.arange(batch.num_rows + 1))
                a, salt, kind, b = (batch.column(c).fill_null(0).to_numpy() for c in ("a", "salt", "kind", "b"))
                found = []
                for i in range(batch.num_rows):
                    own = s[cut[i] : cut[i + 1]], count[cut[i] : cut[i + 1]]
                    if (a[i], salt[i]) != now:
                        now, lead = (a[i], salt[i]), []
                    if kind[i] == 0:
                        lead.append(own)  # more than one only where rows share a doc_id
                        continue
                    for v, w in lead:
                        at = np.searchsorted(v, own[0])
                        at[at == len(v)] = 0
                        hit = v[at] == own[0] if len(v) else np.zeros(len(own[0]), bool)
                        both = np.minimum(w[at[hit]], own[1][hit]).sum()
                        if both and both >= least * (w.sum() + own[1].sum() - both) - ROUNDING:
                            found.append(i)
                            break
                yield pa.RecordBatch.from_arrays([pa.array(a[found]), pa.array(b[found])], ["a", "b"])

    return run


def _links(pairs: DataFrame, texts: DataFrame, least: float) -> DataFrame:
    """Those pairs (a, b) whose texts are alike enough; n: how many members all buckets of a have.

    A leader's text has a copy for every ``LEADER_SHARE`` of them, and a member goes to one by its hash. All pairs of
    a leader know n, so no member needs a join on the leader.
    """
    share = lambda n: F.ceil(n / LEADER_SHARE).cast("int")
    leaders = pairs.groupBy("a").agg(share(F.max("n")).alias("copies"))
    lead = leaders.join(texts.withColumnRenamed("id", "a"), "a").select("a", F.explode(F.sequence(F.lit(0), F.col("copies") - 1)).alias("salt"), F.lit(0).alias("kind"), F.lit(None).cast("long").alias("b"), "text")
    members = pairs.join(texts.withColumnRenamed("id", "b"), "b").select("a", F.pmod(F.xxhash64("b"), share(F.col("n"))).cast("int").alias("salt"), F.lit(1).alias("kind"), "b", "text")
    rows = lead.union(members).repartition(shuffle_partitions(pairs.sparkSession), "a", "salt").sortWithinPartitions("a", "salt", "kind")
    return rows.mapInArrow(_verify(least), "a long, b long")


def _open(members: DataFrame, classes: DataFrame) -> DataFrame:
    """Members, with their class, of the buckets that hold more than one class."""
    known = members.select("bucket", "id").join(classes, "id", "left").withColumn("class", F.coalesce("class", "id"))
    several = written(known.groupBy("bucket").agg(F.min("class").alias("c0"), F.max("class").alias("c1")).filter("c0 <> c1").select("bucket"), "open")
    return known.join(several, "bucket")


def _forest(a: np.ndarray, b: np.ndarray) -> list[int]:
    """Positions of the pairs that join what the pairs before them left apart."""
    up: dict[int, int] = {}

    def top(x: int) -> int:
        while (y := up.get(x, x)) != x:
            up[x] = up.get(y, y)
            x = y
        return x

    out = []
    for i, (x, y) in enumerate(zip(a.tolist(), b.tolist(), strict=True)):
        x, y = top(x), top(y)
        if x != y:
            up[max(x, y)] = min(x, y)
            out.append(i)
    return out


def _sides(rows: pa.Table) -> tuple[np.ndarray, np.ndarray]:
    side = rows.column("side").to_numpy()
    left = np.flatnonzero(side == 0)
    return left, left if rows.column("x")[0].as_py() == rows.column("y")[0].as_py() else np.flatnonzero(side == 1)


def _likely(rows: pa.Table) -> pa.Table:
    """Ties between members of two blocks: enough to connect all pairs of different classes that look alike."""
    ids, cls = (rows.column(c).to_numpy() for c in ("id", "class"))
    sig = np.frombuffer(b"".join(rows.column("sig").to_pylist()), np.uint32).reshape(-1, COMPONENTS)
    left, right = _sides(rows)
    a, b = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
    for i in left:
        fit = right[(cls[right] != cls[i]) & ((sig[right] == sig[i]).sum(axis=1) >= LIKELY * COMPONENTS)]
        a.append(np.full(len(fit), ids[i]))
        b.append(ids[fit])
    a, b = np.concatenate(a), np.concatenate(b)
    keep = _forest(a, b)
    return pa.table({"a": pa.array(a[keep]), "b": pa.array(b[keep])})


@task
def _bag_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for whole in batches:
        for batch in slices(whole, "text"):
            row, s, count, _ = bags(batch.column("text"))
            of = np.repeat(np.arange(len(row)), count)
            nth = np.arange(len(of)) - np.repeat(np.cumsum(count) - count, count)
            each = mix(s[of] + (nth.astype(np.uint64) + np.uint64(1)) * _FACTOR)
            cut = np.searchsorted(row[of], np.arange(batch.num_rows + 1))
            yield pa.RecordBatch.from_arrays([batch.column("id"), batch.column("class"), batch.column("group"), pa.array([each[i:j].tobytes() for i, j in zip(cut[:-1], cut[1:], strict=True)], pa.binary())], ["id", "class", "group", "bag"])


def _exact(least: float):
    def run(rows: pa.Table) -> pa.Table:
        """Links between members of two blocks that join classes. A multiset is the set of its (shingle, n-th time)."""
        ids, cls = (rows.column(c).to_numpy() for c in ("id", "class"))
        sets = [np.frombuffer(x, np.uint64) for x in rows.column("bag").to_pylist()]
        left, right = _sides(rows)
        n = np.array([len(x) for x in sets], np.float64)
        flat, of = np.concatenate(sets), np.repeat(np.arange(len(sets)), [len(x) for x in sets])
        _, column, times = np.unique(flat, return_inverse=True, return_counts=True)
        often = times[column] > 1
        column, of = column[often], of[often]
        _, column = np.unique(column, return_inverse=True)
        by = np.argsort(column, kind="stable")
        column, of = column[by], of[by]
        shared = np.zeros((len(left), len(right)))
        at_left, at_right = np.full(len(sets), -1), np.full(len(sets), -1)
        at_left[left], at_right[right] = np.arange(len(left)), np.arange(len(right))
        for start in range(0, int(column[-1]) + 1 if len(column) else 0, COLUMNS):
            i, j = np.searchsorted(column, [start, start + COLUMNS])
            one, two = np.zeros((len(left), COLUMNS), np.float32), np.zeros((len(right), COLUMNS), np.float32)
            c, o = column[i:j] - start, of[i:j]
            one[at_left[o][at_left[o] >= 0], c[at_left[o] >= 0]] = 1
            two[at_right[o][at_right[o] >= 0], c[at_right[o] >= 0]] = 1
            shared += one @ two.T
        link = (shared > 0) & (shared >= least * (n[left][:, None] + n[right][None, :] - shared) - ROUNDING) & (cls[left][:, None] != cls[right][None, :])
        i, j = np.nonzero(link)
        a, b = left[i], right[j]
        _, first = np.unique(np.stack([np.minimum(cls[a], cls[b]), np.maximum(cls[a], cls[b])]), axis=1, return_index=True)
        a, b = a[first], b[first]
        keep = _forest(cls[a], cls[b])
        return pa.table({"a": pa.array(ids[a[keep]]), "b": pa.array(ids[b[keep]])})

    return run


def _blocks(df: DataFrame, key: str, size: int, weight: Column) -> DataFrame:
    """Each row to every two blocks of its group that are to be compared: x, y, and which of them is its own (side).

    A block has about ``size`` members of a group by weight. A class of that size or more has blocks of its own, which are
    not compared with each other; the small classes share the others. So the rows of a large class go to the
    blocks of the other classes only.
    """
    sized = df.groupBy(key, "class").agg(F.sum(weight).alias("w")).withColumn("m", F.when(F.col("w") >= size, F.ceil(F.col("w") / size)).otherwise(0).cast("int"))
    large = F.collect_list(F.when(F.col("m") > 0, F.struct(F.col("class").alias("of"), "m")))
    small = F.ceil(F.sum(F.when(F.col("m") == 0, F.col("w")).otherwise(0)) / size).cast("int")
    lists = written(sized.groupBy(key).agg(large.alias("large"), small.alias("small")), "blocks")
    if lists.count() <= BROADCAST_ROWS:  # else Spark splits the rows of a large group
        lists = F.broadcast(lists)
    of, m = F.struct(F.lit(SHARED).alias("of"), F.col("small").alias("m")), F.col("large")
    row = df.join(lists, key).withColumn("__block", F.coalesce(F.get(F.filter(m, lambda b: b["of"] == F.col("class")), F.lit(0)), of))
    number = lambda b: F.transform(F.sequence(F.lit(0), b["m"] - 1), lambda k: F.struct(b["of"].alias("of"), k.alias("k")))
    every = F.flatten(F.transform(F.concat(m, F.when(F.col("small") > 0, F.array(of)).otherwise(F.array().cast("array<struct<of:bigint,m:int>>"))), number))
    row = row.withColumn("__own", F.struct(F.col("__block.of").alias("of"), F.pmod(F.xxhash64("id"), F.col("__block.m")).cast("int").alias("k")))
    row = row.withColumn("__other", F.explode(F.filter(every, lambda b: (b["of"] != F.col("__own.of")) | (b["of"] == SHARED))))
    return row.withColumns({"x": F.least("__own", "__other"), "y": F.greatest("__own", "__other"), "side": F.when(F.col("__own") <= F.col("__other"), 0).otherwise(1)}).drop("__own", "__other", "__block", "large", "small")


def near_duplicate_classes(docs: DataFrame, least: float = SIMILARITY) -> DataFrame:
    """One row per row of ``docs``: doc_id, class_id (the smallest doc_id of its class)."""
    source = docs.select(id_or_last().alias("id"), "text")
    nodes = written(source.mapInArrow(_signed_rows, "id long, k1 long, k2 long, sig binary, filled boolean"), "signatures")
    # Equal words have equal signatures, so any of a group will do. Joins on a hot key are with written tables, which Spark can split.
    same = written(nodes.groupBy("k1", "k2").agg(F.min("id").alias("rep"), F.any_value("sig").alias("sig"), F.any_value("filled").alias("filled")), "distinct-texts")
    reps = same.filter("filled").select(F.col("rep").alias("id"), "sig")
    bands = reps.select("id", F.explode(F.array(*(F.xxhash64(F.lit(i), F.substring("sig", 1 + 4 * ROWS * i, 4 * ROWS)) for i in range(COMPONENTS // ROWS)))).alias("bucket"))
    buckets = bands.groupBy("bucket").agg(F.min("id").alias("first"), F.count("*").alias("n")).filter("n > 1")
    buckets = written(buckets.withColumn("n", F.sum("n").over(Window.partitionBy("first"))), "buckets")  # a document leads a bucket for each band at most
    members = written(bands.join(buckets, "bucket"), "bucket-members")
    texts = written(source.join(members.select("id").distinct(), "id", "left_semi"), "candidate-texts")

    tested = members.filter("first <> id").groupBy(F.col("first").alias("a"), F.col("id").alias("b")).agg(F.max("n").alias("n"))
    links = written(_links(tested, texts, least), "links")
    classes = components(links)
    still = written(_open(members, classes), "open-buckets")
    if not still.isEmpty():
        dealt = _blocks(still, "bucket", BLOCK, F.lit(1)).join(reps, "id")
        ties = dealt.groupBy("bucket", "x", "y").applyInArrow(_likely, "a long, b long")
        groups = components(written(ties.distinct(), "ties")).withColumnRenamed("class", "group")
        groups = groups.union(groups.select(F.col("group").alias("id"), "group").distinct())  # the smallest of each group
        groups = groups.join(still.select("id", "class").distinct(), "id")
        filled = written(groups.join(texts, "id").select("id", "class", "group", "text").mapInArrow(_bag_rows, "id long, class long, group long, bag binary"), "group-bags")
        weight = F.greatest(F.lit(1), F.ceil(F.length("bag") / BAG_BYTES))
        more = _blocks(filled, "group", EXACT_BLOCK, weight).groupBy("group", "x", "y").applyInArrow(_exact(least), "a long, b long")
        classes = components(written(links.union(more), "links"))
    known = written(same.select("k1", "k2", "rep").join(classes.withColumnRenamed("id", "rep"), "rep", "left").select("k1", "k2", F.coalesce("class", "rep").alias("class_id")), "text-classes")
    out = nodes.select("id", "k1", "k2").join(known, ["k1", "k2"])
    back = lambda c: F.when(F.col(c) != NO_ID, F.col(c))
    return out.select(back("id").alias("doc_id"), back("class_id").alias("class_id"))


def near_dedup(docs: DataFrame, least: float = SIMILARITY) -> DataFrame:
    """``docs`` with one document of each class: the rows of the smallest doc_id. All columns stay."""
    classes = near_duplicate_classes(docs, least)
    own = fresh("__id", docs)
    extra = classes.filter("class_id is not null and (doc_id is null or doc_id <> class_id)").select(id_or_last().alias(own)).distinct()
    return docs.withColumn(own, id_or_last()).join(extra, own, "left_anti").select(*docs.columns)


ORACLE_SQL = r"""
WITH RECURSIVE t AS (
  SELECT doc_id AS id, list_filter(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x20\x09-\x0D]+'), lambda x: x <> '') AS ws
  FROM documents),
w AS (SELECT id, unnest(ws) AS w, generate_subscripts(ws, 1) AS pos, len(ws) AS n FROM t),
l AS (
  SELECT id, pos, n, w, lead(w, 1) OVER o AS w1, lead(w, 2) OVER o AS w2, lead(w, 3) OVER o AS w3, lead(w, 4) OVER o AS w4
  FROM w WINDOW o AS (PARTITION BY id ORDER BY pos)),
s AS (
  SELECT id, concat_ws(' ', w, w1, w2, w3, w4) AS sh, count(*) AS n FROM l WHERE pos <= n - 4 OR (n < 5 AND pos = 1) GROUP BY 1, 2
  UNION ALL SELECT id, '', 1 FROM t WHERE len(ws) = 0),
size AS (SELECT id, sum(n) AS n FROM s GROUP BY id),
p AS (SELECT a.id AS a, b.id AS b, sum(least(a.n, b.n)) AS shared FROM s a JOIN s b ON a.sh = b.sh AND a.id < b.id GROUP BY 1, 2),
e AS (SELECT a, b FROM p JOIN size x ON a = x.id JOIN size y ON b = y.id WHERE 5 * shared >= 4 * (x.n + y.n - shared)),
both_ways AS (SELECT a, b FROM e UNION SELECT b, a FROM e),
r AS (SELECT doc_id AS id, doc_id AS reach FROM documents UNION SELECT r.id, b FROM r JOIN both_ways ON r.reach = a)
SELECT id AS doc_id, min(reach) AS class_id FROM r GROUP BY id
"""
