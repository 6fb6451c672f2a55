"""Benchmark decontamination: size-partitioned MinHash containment search, then exact verification.

Native: DataFrame and SQL functions only.

* Texts become words (lower case, cut at white space) and five-word shingles; a text of fewer than five
  words is one shingle of all its words.
* Items are partitioned by size (powers of two of their number of distinct shingles). An item's MinHash sketch
  is its smallest shingle hashes. Its length and the hits it takes to be a candidate depend on the size and on
  the bound ``t``: a document that holds t of an item lacks at most m = n - ceil(t n) of its n shingles, so it
  holds at least c of any m + c. Where m + c fits ``k``, that many make the sketch and the search is exact. Larger items
  have k hashes, of which a document that holds t of the item has fewer than the needed ones with probability
  ``MISS`` at most (Chernoff's bound, which holds for draws without replacement); k grows where t is low.
* Each partition is searched by itself: its hash bound is the largest hash in its sketches, and of a document's shingles only those
  under it are looked up, among the sketches of that partition. So large items cost few look-ups whatever small items there
  are. (Partitions whose sketches hold all shingles of their items have no use for a bound; they are one.) Documents of any length
  are searched whole; a long document costs one pass over its shingles, not a signature per window.
* Candidates are verified with all shingles of the item: shared distinct shingles over the item's.

The sketch table is as large as the benchmark. It, and the shingles of the candidate items, are broadcast only while
they have at most ``BROADCAST_ROWS`` rows each, counted; beyond it the join is a shuffled one on the shingle hash,
with written tables, so that Spark splits a common shingle.

Defined cases: null, empty or blank texts have no shingles, match nothing and are never items; rows that share a
doc_id or item_id are one text set; rows without doc_id are one document of their own, with a null doc_id in the result; items
without item_id are ignored; other columns are not read; empty tables give an empty result.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from profusion.llm.common import NO_ID, SPACE, fresh, id_or_last
from profusion.session import written

WORDS = 5
CONTAINMENT = 0.8
#: The least length of the longest sketches, the hits that an exact sketch asks for, the accepted probability of a miss.
SKETCH, HITS, MISS = 32, 4, 1e-9
BROADCAST_ROWS = 1_000_000
#: The partition of the items whose sketches hold all their shingles.
WHOLE = -1


def _word_hashes(text: Column) -> Column:
    words = F.filter(F.split(F.lower(text), SPACE + "+"), lambda w: w != "")
    return F.transform(words, lambda w: F.xxhash64(w))


def shingle_hashes(h: Column, n: int = WORDS) -> Column:
    """Distinct hashes of the n-word shingles, from the array of word hashes."""
    size = F.size(h)
    at = F.sequence(F.lit(0), size - n)
    window = lambda i: F.xxhash64(*(F.get(h, i + j) for j in range(n)))
    return F.array_distinct(F.when(size >= n, F.transform(at, window)).when(size > 0, F.array(F.xxhash64(h))).otherwise(F.array().cast("array<long>")))


def _shingled(df: DataFrame, key: Column, name: str) -> DataFrame:
    h = df.select(key.alias(name), _word_hashes(F.coalesce("text", F.lit(""))).alias("h")).filter(F.col(name).isNotNull())
    # Explode s with explode_outer: explode adds a filter on s below, which would compute the words of a text anew for each shingle.
    return h.select(name, shingle_hashes(F.col("h")).alias("s"))


def sketch_length(t: float) -> int:
    """k: at least ``SKETCH``, and so long that a document with containment t misses all of it with probability ``MISS`` at most."""
    return SKETCH if t >= 1 else max(SKETCH, math.ceil(math.log(MISS) / math.log1p(-t)))


def needed_hits(k: int, t: float) -> int:
    """The most hits that can be asked for: fewer of k have probability exp(-k KL(x, t)), x = (hits - 1) / k, at most."""

    def miss(hits: int) -> float:
        x = (hits - 1) / k
        return math.exp(-k * ((x * math.log(x / t) if x else 0.0) + (1 - x) * (math.log((1 - x) / (1 - t)) if t < 1 else math.inf)))

    return max((hits for hits in range(1, math.ceil(k * t) + 1) if (hits - 1) / k < t and miss(hits) <= MISS), default=1)


def sketches(benchmark: DataFrame, t: float = CONTAINMENT) -> tuple[DataFrame, DataFrame]:
    """Items (item_id, n_item, part, need, s: all hashes, rising), and the sketch rows (h, item_id, part)."""
    k = sketch_length(t)
    items = _shingled(benchmark, F.col("item_id"), "item_id").groupBy("item_id").agg(F.array_sort(F.array_distinct(F.flatten(F.collect_list("s")))).alias("s"))
    items = items.withColumn("n_item", F.size("s").cast("long")).filter("n_item > 0")
    held = F.greatest(F.ceil(F.lit(t) * F.col("n_item") - 1e-9), F.lit(1))
    hits = F.least(F.lit(HITS), held)
    length = F.col("n_item") - held + hits
    items = items.withColumns({
        "part": F.when(F.least(length, F.lit(k)) >= F.col("n_item"), WHOLE).otherwise(F.floor(F.log2("n_item")).cast("int")),
        "length": F.least(length, F.lit(k)).cast("int"),
        "need": F.when(length <= k, hits).otherwise(needed_hits(k, t)).cast("int"),
    })
    items = written(items, "benchmark-items")
    return items, written(items.select(F.explode(F.slice("s", F.lit(1), F.col("length"))).alias("h"), "item_id", "part"), "sketches")


def probes(shingles: DataFrame, bounds: dict[int, int]) -> DataFrame:
    """doc_id, h and part: each shingle hash once for every partition under whose bound it lies."""
    under = F.array(*(F.when(F.col("h") <= F.lit(bound), F.lit(part)) for part, bound in sorted(bounds.items()))) if bounds else F.array().cast("array<int>")
    least = shingles.filter(F.col("h") <= F.lit(max(bounds.values(), default=-(1 << 63))))
    return least.select("doc_id", "h", F.explode(under).alias("part")).filter("part is not null")


def contaminated(docs: DataFrame, benchmark: DataFrame, containment: float = CONTAINMENT) -> DataFrame:
    """Rows doc_id, item_id, n_shared, n_item (long), containment (double), for containment at or above the bound (above 0)."""
    if not 0 < containment <= 1:
        raise ValueError("containment lies above 0 and is at most 1")
    items, sketch = sketches(benchmark, containment)
    # One row per partition: powers of two, so at most 64.
    parts = sketch.groupBy("part").agg(F.max("h").alias("bound"), F.count("*").alias("n")).collect()
    small = (lambda d: F.broadcast(d)) if sum(p["n"] for p in parts) <= BROADCAST_ROWS else (lambda d: d)
    sought = probes(_shingled(docs, id_or_last(), "doc_id").select("doc_id", F.explode_outer("s").alias("h")), {p["part"]: p["bound"] for p in parts})
    # Rows that share a doc_id may repeat a hash: distinct (h) per document and item.
    hits = sought.join(small(sketch.select("h", "part", "item_id")), ["h", "part"]).groupBy("doc_id", "item_id").agg(F.count_distinct("h").alias("hits"))
    candidates = hits.join(small(items.select("item_id", "need")), "item_id").filter("hits >= need").select("doc_id", "item_id")
    candidates = written(candidates, "decontamination-candidates")
    # Verification: all shingles of the candidate items, in the candidate documents only.
    chosen = written(items.join(candidates.select("item_id").distinct(), "item_id", "left_semi").select("item_id", "n_item", F.explode("s").alias("h")), "candidate-items")
    few = (lambda d: F.broadcast(d)) if chosen.count() <= BROADCAST_ROWS else (lambda d: d)
    # A document of many candidate items meets each item's shingles once; pairs are linear in candidates.
    rows = docs.select(id_or_last().alias("doc_id"), "text").join(candidates.select("doc_id").distinct(), "doc_id", "left_semi")
    shared = (
        _shingled(rows, F.col("doc_id"), "doc_id").select("doc_id", F.explode_outer("s").alias("h")).join(few(chosen), "h")
        .groupBy("doc_id", "item_id", "n_item").agg(F.count_distinct("h").alias("n_shared"))
    )
    share = F.col("n_shared") / F.col("n_item")
    return (
        shared.join(candidates, ["doc_id", "item_id"], "left_semi").withColumn("containment", share).filter(share >= containment)
        .select(F.when(F.col("doc_id") != NO_ID, F.col("doc_id")).alias("doc_id"), "item_id", "n_shared", "n_item", "containment")
    )


def decontaminate(docs: DataFrame, benchmark: DataFrame, containment: float = CONTAINMENT) -> DataFrame:
    """``docs`` without the documents that contain an item of the benchmark; all columns stay."""
    own = fresh("__id", docs)
    leaks = contaminated(docs, benchmark, containment).select(id_or_last().alias(own)).distinct()
    return docs.withColumn(own, id_or_last()).join(leaks, own, "left_anti").select(*docs.columns)


ORACLE_SQL = r"""
WITH t AS (
  SELECT 'd' AS kind, doc_id AS id, lower(coalesce(text, '')) AS text FROM documents
  UNION ALL SELECT 'b', item_id, lower(coalesce(text, '')) FROM benchmark),
w AS (
  SELECT kind, id, unnest(ws) AS w, generate_subscripts(ws, 1) AS pos, len(ws) AS n
  FROM (SELECT kind, id, list_filter(regexp_split_to_array(text, '[\x20\x09-\x0D]+'), lambda x: x <> '') AS ws FROM t)),
l AS (
  SELECT kind, id, pos, n, w, lead(w, 1) OVER o AS w1, lead(w, 2) OVER o AS w2, lead(w, 3) OVER o AS w3, lead(w, 4) OVER o AS w4
  FROM w WINDOW o AS (PARTITION BY kind, id ORDER BY pos)),
s AS (
  SELECT DISTINCT kind, id, concat_ws(' ', w, w1, w2, w3, w4) AS sh
  FROM l WHERE pos <= n - 4 OR (n < 5 AND pos = 1)),
items AS (SELECT id, count(*) AS n FROM s WHERE kind = 'b' GROUP BY id),
shared AS (
  SELECT d.id AS doc_id, b.id AS item_id, count(*) AS n_shared
  FROM s d JOIN s b ON d.sh = b.sh AND d.kind = 'd' AND b.kind = 'b' GROUP BY 1, 2)
SELECT doc_id, item_id, n_shared, n AS n_item, CAST(n_shared AS DOUBLE) / n AS containment
FROM shared JOIN items ON item_id = items.id WHERE CAST(n_shared AS DOUBLE) / n >= 0.8
"""
