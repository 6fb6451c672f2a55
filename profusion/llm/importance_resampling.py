"""Target-distribution importance resampling over hashed word n-grams.

Native: DataFrame and SQL functions only.

* A text's words are exploded with their positions, each position gives the array of the runs of 1 to ``GRAMS`` words
  that begin there, and that array is exploded too. Both stay inside generated code; no n-gram is ever collected.
* A feature's bucket is the CRC-32 of its bytes modulo ``BUCKETS``. Buckets are counted over the raw documents and over the
  target texts, each task summing up first, so a shuffle moves at most one row per bucket and task.
* The gains, one whole number of thousandths per bucket, are as many rows as buckets, whatever the input: they are
  broadcast (up to ``BROADCAST_BUCKETS``, else the join is left to the planner) and summed up per document.
* Gumbel noise from a keyed hash of the id makes the draw: the highest of weight plus noise are a sample without
  replacement in proportion to exp(weight).
* Ranks come without a global window: a range-partitioned sort is written with each row's partition and its place there,
  and a table of one row per partition holds how many rows stand before it.

Defined cases: null and empty texts have no features, weight 0 and no rank; rows that share a doc_id are one document of all
their texts (no feature spans two rows); rows without doc_id are one document with a null id, whose noise is that of the empty
id and which comes last among ties; an empty target gives the same gain to equally frequent features, an empty table an
empty result; other columns are not read, whatever their names.
"""

from __future__ import annotations

import string

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from profusion.llm.common import NO_ID, fresh, id_or_last
from profusion.session import written

GRAMS = 3
BUCKETS = 10_000
PERCENT, LEAST_WORDS, SEED = 5, 20, 42
#: More gains than these are not broadcast.
BROADCAST_BUCKETS = 1_000_000
#: Fixed value: all of ASCII but digits and small letters parts words.
SEPARATORS = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"


def words(text: Column) -> Column:
    """The words of a text, A-Z lower-cased; null has none."""
    text = F.coalesce(text, F.lit(""))
    plain = F.length(text) == F.octet_length(text)  # lower() takes other letters than A-Z too, where there are any
    low = F.when(plain, F.lower(text)).otherwise(F.translate(text, string.ascii_uppercase, string.ascii_lowercase))
    return F.array_remove(F.split(low, SEPARATORS), "")


def features(docs: DataFrame, key: Column, buckets: int = BUCKETS) -> DataFrame:
    """Columns doc, nth (0 where a word stands alone) and bucket, a row per feature; a text without words gives one row of nulls."""
    at = docs.select(key.alias("doc"), words(F.col("text")).alias("w")).select("doc", "w", F.posexplode_outer("w").alias("i", "a"))
    runs = [F.col("a")]
    for k in range(1, GRAMS):
        runs.append(F.concat(runs[-1], F.lit(" "), F.get("w", F.col("i") + k)))
    each = at.select("doc", F.posexplode(F.array(*runs)).alias("nth", "gram")).filter("gram is not null or nth = 0")
    return each.select("doc", "nth", F.pmod(F.crc32(F.col("gram").cast("binary")), F.lit(buckets)).alias("bucket"))


def bucket_gains(docs: DataFrame, target: DataFrame, buckets: int = BUCKETS) -> DataFrame:
    """Columns bucket and gain (thousandths), for the buckets that the documents have."""
    count = lambda df, name: features(df, F.lit(None).cast("long"), buckets).filter("bucket is not null").groupBy("bucket").agg(F.count("*").alias(name))
    counts = written(count(docs, "s").join(count(target, "t"), "bucket", "left").select("bucket", "s", F.coalesce("t", F.lit(0)).alias("t")), "bucket-counts")
    seen = counts.agg(F.sum("s").alias("s")).first()
    aimed = target.select(F.size(words(F.col("text"))).cast("long").alias("n")).agg(*(F.sum(F.greatest(F.col("n") - k, F.lit(0))).alias(f"g{k}") for k in range(GRAMS))).first()
    raw, wanted = float(seen["s"] or 0), float(sum(aimed[f"g{k}"] or 0 for k in range(GRAMS)))
    double = lambda c: F.col(c).cast("double")
    ratio = (double("t") + 1) * F.lit(raw + buckets) / ((double("s") + 1) * F.lit(wanted + buckets))
    return counts.select("bucket", F.floor(F.lit(1000.0) * F.log(ratio)).cast("long").alias("gain"))


def weights(docs: DataFrame, target: DataFrame, buckets: int = BUCKETS) -> DataFrame:
    """Columns doc (doc_id, ``NO_ID`` for none), n_words, n_features and weight, a row per document."""
    gains = bucket_gains(docs, target, buckets)
    gains = F.broadcast(gains) if buckets <= BROADCAST_BUCKETS else gains
    return features(docs, id_or_last(), buckets).join(gains, "bucket", "left").groupBy("doc").agg(
        F.count_if((F.col("nth") == 0) & F.col("bucket").isNotNull()).alias("n_words"), F.count("bucket").alias("n_features"), F.coalesce(F.sum("gain"), F.lit(0)).cast("long").alias("weight"),
    )


def noise(key: Column, seed: int = SEED) -> Column:
    """Gumbel noise in thousandths, from the first 32 bits of sha256(``seed:id``)."""
    text = F.concat(F.lit(f"{seed}:"), F.when(key != NO_ID, key.cast("string")).otherwise(""))
    h = F.conv(F.substring(F.sha2(text.cast("binary"), 256), 1, 8), 16, 10).cast("double")
    return F.floor(F.lit(-1000.0) * F.log(-F.log((h + 0.5) / 4294967296.0))).cast("long")


def ranked(scored: DataFrame, percent: int = PERCENT, least_words: int = LEAST_WORDS) -> DataFrame:
    """``scored`` (a written table with doc, n_words, score) with ``rank`` 1, 2, 3, ... for the highest ``percent`` of the documents
    of at least ``least_words`` words, null for all others."""
    able = F.col("n_words") >= least_words
    place = F.monotonically_increasing_id().bitwiseAND(F.lit((1 << 33) - 1))
    order = [F.col("score").desc(), F.col("doc").asc()]
    rows = written(scored.filter(able).repartitionByRange(*order).sortWithinPartitions(*order).withColumns({"part": F.spark_partition_id(), "place": place}), "ranked")
    sizes = rows.groupBy("part").agg(F.count("*").alias("n"))  # a row per partition of the sort
    over = Window.orderBy("part")
    before = sizes.select("part", (F.sum("n").over(over.rowsBetween(Window.unboundedPreceding, 0)) - F.col("n")).alias("before"), F.sum("n").over(over.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)).alias("all"))
    rank = F.col("before") + F.col("place") + 1
    drawn = rows.join(F.broadcast(before), "part").withColumn("rank", F.when(rank <= F.floor(F.col("all") * percent / 100), rank).cast("long"))
    return drawn.drop("part", "place", "before", "all").unionByName(scored.filter(~able).withColumn("rank", F.lit(None).cast("long")))


def importance(docs: DataFrame, target: DataFrame, percent: int = PERCENT, least_words: int = LEAST_WORDS, seed: int = SEED, buckets: int = BUCKETS) -> DataFrame:
    """Rows doc_id, n_features, weight, score, rank, n_words (all long) for every document."""
    scored = written(weights(docs, target, buckets).withColumn("score", F.col("weight") + noise(F.col("doc"), seed)), "importance")
    out = ranked(scored, percent, least_words)
    return out.select(F.when(F.col("doc") != NO_ID, F.col("doc")).alias("doc_id"), "n_features", "weight", "score", "rank", "n_words")


def resample(docs: DataFrame, target: DataFrame, **options) -> DataFrame:
    """The rows of the drawn documents, with all their columns."""
    own = fresh("__id", docs)
    drawn = importance(docs, target, **options).filter("rank is not null").select(id_or_last().alias(own))
    return docs.withColumn(own, id_or_last()).join(drawn, own, "left_semi").select(*(F.col(f"`{c}`") for c in docs.columns))


#: CRC-32 is linear: a text's is that of as many zero bytes, xor for each byte what it adds at its distance from the end.
ORACLE_SQL = r"""
WITH RECURSIVE
bits AS (SELECT b::UBIGINT AS b, b::UBIGINT AS x, 0 AS step FROM range(256) t(b)
  UNION ALL SELECT b, CASE WHEN x & 1 = 1 THEN xor(x >> 1, 3988292384::UBIGINT) ELSE x >> 1 END, step + 1 FROM bits WHERE step < 8),
crc AS (SELECT b, x FROM bits WHERE step = 8),
texts AS (
  SELECT kind, id, list_filter(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x00-\x2F\x3A-\x60\x7B-\x7F]+'), lambda w: w <> '') AS ws
  FROM (SELECT 'd' AS kind, doc_id AS id, text FROM documents UNION ALL SELECT 'b', item_id, text FROM benchmark)),
spots AS (SELECT kind, id, ws, unnest(range(1, len(ws) + 1)) AS i FROM texts),
grams AS (
  SELECT kind, id, unnest(CASE WHEN i + 2 <= len(ws) THEN [ws[i], ws[i] || ' ' || ws[i + 1], ws[i] || ' ' || ws[i + 1] || ' ' || ws[i + 2]]
    WHEN i + 1 <= len(ws) THEN [ws[i], ws[i] || ' ' || ws[i + 1]] ELSE [ws[i]] END) AS gram FROM spots),
counted AS (SELECT kind, id, gram, count(*) AS n FROM grams GROUP BY ALL),
kinds AS (SELECT gram, hex(encode(gram)) AS h, len(hex(encode(gram))) // 2 AS size FROM (SELECT DISTINCT gram FROM counted)),
far AS (SELECT b, x, 0 AS k FROM crc
  UNION ALL SELECT f.b, xor(f.x >> 8, c.x), f.k + 1 FROM far f JOIN crc c ON c.b = (f.x & 255) WHERE f.k < (SELECT max(size) FROM kinds)),
zeros AS (SELECT 0 AS size, 4294967295::UBIGINT AS x
  UNION ALL SELECT size + 1, xor(z.x >> 8, c.x) FROM zeros z JOIN crc c ON c.b = (z.x & 255) WHERE size < (SELECT max(size) FROM kinds)),
bytes AS (SELECT gram, size, unnest(range(0, size)) AS k, h FROM kinds),
summed AS (
  SELECT gram, any_value(size) AS size, bit_xor(f.x) AS x
  FROM (SELECT gram, size, k, (instr('0123456789ABCDEF', substr(h, 2 * (size - 1 - k) + 1, 1)) - 1) * 16 + instr('0123456789ABCDEF', substr(h, 2 * (size - 1 - k) + 2, 1)) - 1 AS b FROM bytes) s
  JOIN far f ON f.k = s.k AND f.b = s.b GROUP BY gram),
bucketed AS (SELECT gram, xor(xor(s.x, z.x), 4294967295::UBIGINT) % 10000 AS bucket FROM summed s JOIN zeros z USING (size)),
features AS (SELECT kind, id, bucket, sum(n) AS n FROM counted JOIN bucketed USING (gram) GROUP BY ALL),
totals AS (SELECT sum(n) FILTER (kind = 'd') AS S, coalesce(sum(n) FILTER (kind = 'b'), 0) AS T FROM features),
gains AS (
  SELECT bucket, floor(1000 * ln(CAST(coalesce(sum(n) FILTER (kind = 'b'), 0) + 1 AS DOUBLE) * CAST(any_value(S) + 10000 AS DOUBLE)
    / (CAST(coalesce(sum(n) FILTER (kind = 'd'), 0) + 1 AS DOUBLE) * CAST(any_value(T) + 10000 AS DOUBLE)))) AS gain
  FROM features, totals GROUP BY bucket),
weighed AS (SELECT id, sum(n) AS n_features, sum(n * gain) AS weight FROM features JOIN gains USING (bucket) WHERE kind = 'd' GROUP BY id),
docs AS (
  SELECT id AS doc_id, coalesce(n_features, 0) AS n_features, coalesce(weight, 0) AS weight, len(ws) AS n_words,
    list_reduce(list_transform(range(1, 9), lambda k: instr('0123456789abcdef', substr(sha256('42:' || id), k, 1)) - 1), lambda a, d: a * 16 + d) AS h
  FROM texts LEFT JOIN weighed USING (id) WHERE kind = 'd'),
scored AS (SELECT *, weight + floor(-1000 * ln(-ln((h + 0.5::DOUBLE) / 4294967296::DOUBLE))) AS score FROM docs),
placed AS (SELECT doc_id, row_number() OVER (ORDER BY score DESC, doc_id) AS place, count(*) OVER () AS able FROM scored WHERE n_words >= 20)
SELECT doc_id, CAST(n_features AS BIGINT) AS n_features, CAST(weight AS BIGINT) AS weight, CAST(score AS BIGINT) AS score,
  CASE WHEN place <= 5 * able // 100 THEN place END AS rank, CAST(n_words AS BIGINT) AS n_words
FROM scored LEFT JOIN placed USING (doc_id)
"""
