"""Line dedup: a sharded minimal perfect hash over the distinct lines, probed by the documents.

Four steps, none of which joins or moves line texts:

1. Each document sends the 128-bit hash of each distinct key once; a partial aggregation gives, for
   each key, its smallest document and how many hold it.
2. The distinct keys are dealt into shards of bounded size. A task builds each shard's minimal perfect
   hash (cascaded bit arrays) and the arrays it indexes: 32-bit fingerprints, saturating 8-bit counts, and, for the keys
   with a count over one only, the smallest document. A line costs about six bytes.
3. The documents' key hashes stream past the arrays of their shard; the count array decides which repeat. A shard with
   many times the usual probes has several copies (salts), in proportion to its probes, so a key that a third of all
   documents hold is spread over tasks and nothing is gathered.
4. Only hits return to the documents, which drop those lines.

Every probed key is in the index, so a line is dropped wrongly only if two keys agree in the 64 bits of slot and
shard and in the fingerprint.

Defined cases: a null or empty text is one empty line; keys under ``min_chars`` code points never
repeat; rows that share a doc_id are one document; rows without doc_id are one document that comes
after all others; an empty table gives an empty result; other columns pass through untouched.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from profusion.llm.common import fresh, id_or_last, mix, new_names, slices, task, unsigned
from profusion.session import shuffle_partitions, written

STRIP = b" \t\n\x0b\x0c\r"
MIN_CHARS = 10
#: Keys in a shard, roughly; how many times the mean of probes makes a shard hot; hot shards that are broadcast at most.
SHARD_KEYS, HOT, HOT_SHARDS = 20_000, 4, 100_000
SEVERAL = 255


def line_keys(text: str | None) -> list[bytes]:
    """The key of each line of a text."""
    return [line.strip(STRIP).lower() for line in (text or "").encode("utf-8", "surrogatepass").split(b"\n")]


def long_enough(key: bytes, min_chars: int) -> bool:
    return len(key) >= min_chars and len(key.decode("utf-8", "surrogatepass")) >= min_chars


def key_hash(key: bytes) -> bytes:
    return xxhash.xxh3_128_digest(key)


class PerfectHash:
    """Minimal perfect hash over distinct 64-bit keys by cascaded bit arrays.

    At each level a key claims a slot by hash; slots claimed once are settled, the rest go to the next
    level. A key's index is the rank of its bit.
    """

    def __init__(self, sizes: list[int], words: np.ndarray):
        self.sizes, self.words = sizes, words
        ones = np.bitwise_count(words).astype(np.int64)
        self.rank = np.concatenate([[0], np.cumsum(ones)])

    @classmethod
    def build(cls, keys: np.ndarray, gamma: float = 1.7) -> "PerfectHash":
        sizes, bits, left = [], [], keys
        while len(left):
            size = int(max(64, gamma * len(left)) + 63) // 64 * 64
            slot = cls._slot(left, len(sizes), size)
            claims = np.bincount(slot, minlength=size)
            sizes.append(size)
            bits.append(claims == 1)
            left = left[claims[slot] > 1]
        flat = np.packbits(np.concatenate(bits), bitorder="little") if bits else np.zeros(0, np.uint8)
        return cls(sizes, flat.view(np.uint64))

    @staticmethod
    def _slot(keys: np.ndarray, level: int, size: int) -> np.ndarray:
        return (mix(keys + np.uint64((level + 1) * 0x9E3779B97F4A7C15 % (1 << 64))) % np.uint64(size)).astype(np.int64)

    def index(self, keys: np.ndarray) -> np.ndarray:
        """The index of each member; any index or -1 for other keys."""
        out = np.full(len(keys), -1, np.int64)
        left, start = np.arange(len(keys)), 0
        for level, size in enumerate(self.sizes):
            if not len(left):
                break
            at = start + self._slot(keys[left], level, size)
            word, bit = self.words[at >> 6], (at & 63).astype(np.uint64)
            found = (word >> bit) & np.uint64(1) == 1
            hit, below = left[found], (np.uint64(1) << bit[found]) - np.uint64(1)
            out[hit] = self.rank[at[found] >> 6] + np.bitwise_count(word[found] & below)
            left, start = left[~found], start + size
        return out


SHARD = "shard int, sizes array<long>, bits binary, prints binary, counts binary, firsts binary, probes long"
KEYS = "h1 long, h2 long, id long"


def _document_keys(min_chars: int):
    @task
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for batch in slices(whole, "text"):
                ids, digests, n = [], [], []
                for i, text in zip(batch.column("id").to_pylist(), batch.column("text").to_pylist(), strict=True):
                    own = {key_hash(k) for k in set(line_keys(text)) if long_enough(k, min_chars)}
                    digests.extend(own)
                    ids.append(i)
                    n.append(len(own))
                h = np.frombuffer(b"".join(digests), np.int64).reshape(-1, 2)
                yield pa.RecordBatch.from_arrays([pa.array(np.ascontiguousarray(h[:, 0])), pa.array(np.ascontiguousarray(h[:, 1])), pa.array(np.repeat(np.array(ids, np.int64), n))], ["h1", "h2", "id"])

    return run


def _build_shard(rows: pa.Table) -> pa.Table:
    h1, h2 = (unsigned(rows.column(c).to_numpy()) for c in ("h1", "h2"))
    _, one = np.unique(h1, return_index=True)  # of two keys that share h1 (2**-64) the first stands for both
    h1, h2 = h1[one], h2[one]
    first, last, n = (rows.column(c).to_numpy()[one] for c in ("first", "last", "n"))
    counts = np.where(first == last, 1, np.minimum(n, SEVERAL))  # rows that share a doc_id are one document
    perfect = PerfectHash.build(h1)
    order = np.empty(len(h1), np.int64)
    order[perfect.index(h1)] = np.arange(len(h1))
    counts, first = counts[order], first[order]
    blob = lambda x, kind: pa.array([x.astype(kind).tobytes()], pa.binary())
    return pa.table({
        "shard": pa.array([rows.column("shard")[0].as_py()], pa.int32()),
        "sizes": pa.array([perfect.sizes], pa.list_(pa.int64())),
        "bits": pa.array([perfect.words.tobytes()], pa.binary()),
        "prints": blob(h2[order], np.uint32), "counts": blob(counts, np.uint8), "firsts": blob(first[counts > 1], np.int64),
        "probes": pa.array([int(n.sum())]),
    })


class Shard:
    """The arrays of a shard."""

    def __init__(self, row: dict):
        self.perfect = PerfectHash(row["sizes"], np.frombuffer(row["bits"], np.uint64))
        self.prints, self.counts, self.firsts = (np.frombuffer(row[k], t) for k, t in (("prints", np.uint32), ("counts", np.uint8), ("firsts", np.int64)))
        self.place = np.cumsum(self.counts > 1) - 1

    def repeats(self, h1: np.ndarray, h2: np.ndarray, ids: np.ndarray) -> np.ndarray:
        """Which probes are of a key that several documents hold, a smaller one among them."""
        at = self.perfect.index(h1)
        hit = (at >= 0) & (self.prints[at] == h2.astype(np.uint32)) & (self.counts[at] > 1)
        hit[hit] = self.firsts[self.place[at[hit]]] != ids[hit]
        return hit


@task
def _probe(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows come sorted: the arrays of a shard, then the probes that belong to it."""
    now, held = None, None
    for batch in batches:
        key = np.stack([batch.column("shard").to_numpy(), batch.column("salt").to_numpy()])
        kind = batch.column("kind").to_numpy()
        h1, h2, ids = (batch.column(c).fill_null(0).to_numpy() for c in ("h1", "h2", "id"))
        cut = np.flatnonzero(np.any(key[:, 1:] != key[:, :-1], axis=0)) + 1
        hit = np.zeros(batch.num_rows, bool)
        for a, b in zip([0, *cut], [*cut, batch.num_rows], strict=True):
            if a == b:
                continue
            if (k := (key[0, a], key[1, a])) != now:
                now, held = k, None
            if kind[a] == 0:
                held = Shard(batch.slice(a, 1).to_pylist()[0])
                a += 1
            if held is not None and a < b:
                hit[a:b] = held.repeats(unsigned(h1[a:b]), unsigned(h2[a:b]), ids[a:b])
        yield pa.RecordBatch.from_arrays([pa.array(x[hit]) for x in (h1, h2, ids)], ["h1", "h2", "id"])


def shards_of(keys: DataFrame) -> tuple[DataFrame, int]:
    """The compact arrays over all distinct keys, and the number of shards that keys are dealt to."""
    distinct = written(keys.groupBy("h1", "h2").agg(F.min("id").alias("first"), F.max("id").alias("last"), F.count("*").alias("n")), "distinct-lines")
    n = max(1, -(-distinct.count() // SHARD_KEYS))
    return written(distinct.withColumn("shard", F.pmod("h1", F.lit(n)).cast("int")).groupBy("shard").applyInArrow(_build_shard, SHARD), "line-shards"), n


def hot_shards(shards: DataFrame) -> DataFrame:
    """shard and salts of the shards with more than ``HOT`` times the mean of probes; at most ``HOT_SHARDS`` rows."""
    mean, times = shards.agg(F.coalesce(F.avg("probes"), F.lit(1.0))).first()[0], HOT
    while True:
        hot = shards.filter(F.col("probes") > times * mean).select("shard", F.ceil(F.col("probes") / (times * mean)).cast("int").alias("salts"))
        if hot.count() <= HOT_SHARDS:
            return hot
        times *= 2  # fewer than shards / times lie over that


def repeated_lines(docs: DataFrame, min_chars: int = MIN_CHARS) -> DataFrame:
    """Columns id and drop (array of h1, h2): the keys whose lines document ``id`` loses."""
    spark = docs.sparkSession
    keys = docs.select(id_or_last().alias("id"), "text").mapInArrow(_document_keys(min_chars), KEYS)
    shards, n = shards_of(keys)
    hot = F.broadcast(hot_shards(shards))
    salts = F.coalesce("salts", F.lit(1))
    probes = keys.withColumn("shard", F.pmod("h1", F.lit(n)).cast("int")).join(hot, "shard", "left").select(
        "shard", F.pmod(F.xxhash64("id"), salts).cast("int").alias("salt"), F.lit(1).alias("kind"), "h1", "h2", "id",
        *(F.lit(None).cast(t).alias(c) for c, t in (("sizes", "array<long>"), ("bits", "binary"), ("prints", "binary"), ("counts", "binary"), ("firsts", "binary"))),
    )
    arrays = shards.join(hot, "shard", "left").select("shard", F.explode(F.sequence(F.lit(0), salts - 1)).alias("salt"), F.lit(0).alias("kind"), *(F.lit(None).cast("long").alias(c) for c in ("h1", "h2", "id")), "sizes", "bits", "prints", "counts", "firsts")
    hits = (
        probes.union(arrays).repartition(shuffle_partitions(spark), "shard", "salt").sortWithinPartitions("shard", "salt", "kind")
        .mapInArrow(_probe, KEYS)
    )
    return written(hits.groupBy("id").agg(F.collect_list(F.struct("h1", "h2")).alias("drop")), "dropped-lines")


@task
def _rewrite(batches: Iterator[pa.RecordBatch], drop: str, finish, schema: pa.Schema) -> Iterator[pa.RecordBatch]:
    for whole in batches:
        for batch in slices(whole, "text"):
            out = {"text": [], "n_lines": [], "n_dropped": []}
            for text, lost in zip(batch.column("text").to_pylist(), batch.column(drop).to_pylist(), strict=True):
                lines = (text or "").split("\n")
                if lost:
                    gone = {np.array([x["h1"], x["h2"]], np.int64).tobytes() for x in lost}
                    stay = [line for line, k in zip(lines, line_keys(text), strict=True) if key_hash(k) not in gone]
                else:
                    stay = lines
                out["text"].append("\n".join(stay))
                out["n_lines"].append(len(lines))
                out["n_dropped"].append(len(lines) - len(stay))
            yield finish(batch, out, schema)


def dedup_lines(docs: DataFrame, min_chars: int = MIN_CHARS) -> DataFrame:
    """``docs`` with repeated lines dropped from ``text``, and columns n_lines and n_dropped (long; ``new_names``)."""
    return _joined(docs, min_chars, digest=False)


def _joined(docs: DataFrame, min_chars: int, digest: bool) -> DataFrame:
    import pyspark.sql.types as T
    from pyspark.sql.pandas.types import to_arrow_schema

    own, drop = fresh("__id", docs), fresh("__drop", docs)
    hits = repeated_lines(docs, min_chars).withColumnsRenamed({"id": own, "drop": drop})
    kept = docs.select("doc_id", "text") if digest else docs
    rows = kept.withColumn(own, id_or_last()).join(hits, own, "left").drop(own)
    counts = dict(zip(new_names(kept, "n_lines", "n_dropped"), ("n_lines", "n_dropped"), strict=True))
    tail = [T.StructField(name, T.LongType()) for name in counts]
    if digest:
        fields = [T.StructField("doc_id", kept.schema["doc_id"].dataType), *tail, T.StructField("kept_sha256", T.StringType())]
    else:
        fields = [*(T.StructField(f.name, T.StringType()) if f.name == "text" else f for f in kept.schema.fields), *tail]
    schema = T.StructType(fields)
    arrow = to_arrow_schema(schema)

    def finish(batch: pa.RecordBatch, out: dict, schema: pa.Schema) -> pa.RecordBatch:
        if digest:
            out["kept_sha256"] = [hashlib.sha256(t.encode("utf-8", "surrogatepass")).hexdigest() for t in out["text"]]
        made = {name: out[of] for name, of in counts.items()} | {k: v for k, v in out.items() if k in ("text", "kept_sha256")}
        return pa.RecordBatch.from_arrays([pa.array(made[f.name], f.type) if f.name in made else batch.column(f.name).cast(f.type) for f in schema], schema=schema)

    return rows.mapInArrow(lambda it: _rewrite(it, drop, finish, arrow), schema)


def line_digests(docs: DataFrame, min_chars: int = MIN_CHARS) -> DataFrame:
    """Per document: doc_id, n_lines, n_dropped, kept_sha256 of the text that stays."""
    return _joined(docs, min_chars, digest=True)


ORACLE_SQL = r"""
WITH lines AS (
  SELECT doc_id, unnest(string_split(coalesce(text, ''), chr(10))) AS line,
         generate_subscripts(string_split(coalesce(text, ''), chr(10)), 1) AS pos
  FROM documents),
keyed AS (
  SELECT doc_id, pos, line,
         translate(trim(line, ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)),
                   'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS key
  FROM lines),
rep AS (
  SELECT key, min(doc_id) AS first FROM keyed WHERE length(key) >= 10
  GROUP BY key HAVING count(DISTINCT doc_id) >= 2),
marked AS (
  SELECT k.doc_id, k.pos, k.line, (r.key IS NOT NULL AND r.first <> k.doc_id) AS gone
  FROM keyed k LEFT JOIN rep r ON k.key = r.key)
SELECT doc_id, count(*) AS n_lines, count(*) FILTER (WHERE gone) AS n_dropped,
       sha256(coalesce(string_agg(line, chr(10) ORDER BY pos) FILTER (WHERE NOT gone), '')) AS kept_sha256
FROM marked GROUP BY doc_id
"""
