"""Matching: shared e-mails and phones, and guarded agreement of name and company.

Shared keys make stars, by one aggregation each, not joins. Two records of one name and company (a block) are linked unless their
e-mails, or their phones, are both known and disjoint; then they are flagged instead.

Neither needs pairs. Which links a block adds depends only on what its records lack: two records that both know e-mails, or both
phones, and are not in conflict share one, so the stars have linked them already. What is left are records that know neither,
which link with all, and those that know only e-mails, which link with those that know only phones. That is a star or two.
And every pair of a block is linked or flagged; so two entities are possible duplicates exactly if they meet in a block. The flags are
kept as rows (block, entity), as many as there are records at most, and are expanded only where a list is asked for.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from profusion.functions import normalize as N
from profusion.functions.text import clean_name, email_key, strip
from profusion.operators.components import components
from profusion.session import written


def key_set(values: Column, form) -> Column:
    """Sorted distinct keys of the values that are not blank."""
    filled = F.filter(F.coalesce(values, F.array().cast("array<string>")), lambda x: x.isNotNull() & (strip(x) != ""))
    return F.array_sort(F.array_distinct(F.transform(filled, form)))


def match_keys(records: DataFrame, normalized_phone_match: bool = False, default_region: str = "US") -> DataFrame:
    phone = (lambda p: F.coalesce(N.phone(p, default_region)["value"], strip(p))) if normalized_phone_match else strip
    return records.select(
        "rec_pos", key_set(F.col("emails"), email_key).alias("emails"), key_set(F.col("phones"), phone).alias("phones"),
        clean_name(F.col("full_name")).alias("name"), clean_name(N.current_company(F.col("experience"))).alias("company"),
    )


def star_edges(rows: DataFrame, key: str, node: str = "rec_pos") -> DataFrame:
    """Edges (a, b) from the smallest node of each key to the others."""
    first = rows.groupBy(key).agg(F.min(node).alias("a"), F.max(node).alias("__last")).filter("a <> __last").drop("__last")
    first = written(first, "shared-keys")  # so that Spark can split the rows of a hot key
    return rows.join(first, key).select("a", F.col(node).alias("b")).filter("a <> b")


def conflict(a: Column, b: Column) -> Column:
    """Both sets are known and share nothing."""
    return (F.size(a) > 0) & (F.size(b) > 0) & ~F.arrays_overlap(a, b)


def block_links(keys: DataFrame) -> DataFrame:
    """Edges (a, b) that connect, together with those of shared keys, all records of a block that are not in conflict."""
    blocks = keys.filter("name <> '' AND company <> ''").select("rec_pos", "name", "company", (F.size("emails") > 0).alias("mailed"), (F.size("phones") > 0).alias("phoned"))
    mailed, phoned, p = F.col("mailed"), F.col("phoned"), F.col("rec_pos")
    tops = blocks.groupBy("name", "company").agg(
        F.min(F.when(~mailed & ~phoned, p)).alias("bare"), F.min(F.when(mailed & ~phoned, p)).alias("mail"), F.min(F.when(~mailed & phoned, p)).alias("phone"), F.count("*").alias("n"),
    )
    tops = written(tops.filter("n > 1 AND (bare IS NOT NULL OR mail IS NOT NULL AND phone IS NOT NULL)").drop("n"), "block-tops")  # so that Spark can split the rows of a hot block
    other = F.when(~mailed & phoned, F.col("mail")).when(mailed & ~phoned, F.col("phone"))
    edges = blocks.join(tops, ["name", "company"]).select(F.explode(F.array("bare", other)).alias("a"), p.alias("b"))
    return edges.filter("a <> b")


def duplicate_groups(keys: DataFrame, assigned: DataFrame) -> DataFrame:
    """Entities that are possible duplicates of each other: name and company (of the block), entity, n (entities of the block), for
    blocks of several."""
    blocks = keys.filter("name <> '' AND company <> ''").select("rec_pos", "name", "company")
    members = blocks.join(assigned, "rec_pos").select("name", "company", "entity").distinct()
    members = written(members, "block-members")
    several = written(members.groupBy("name", "company").agg(F.count("*").alias("n")).filter("n > 1"), "shared-blocks")
    return members.join(several, ["name", "company"])


def duplicate_counts(groups: DataFrame) -> DataFrame:
    """Entities of ``duplicate_groups`` with n_duplicates, the number of their possible duplicates, and no lists of them.

    An entity of one block has all others of the block; only those that stand in several blocks need their pairs, so that none counts twice.
    """
    of = groups.groupBy("entity").agg(F.count("*").alias("blocks"), F.max("n").alias("n"))
    several = groups.join(of.filter("blocks > 1").select("entity"), "entity", "left_semi").select("entity", "name", "company")
    pairs = several.join(groups.select("name", "company", F.col("entity").alias("other")), ["name", "company"]).filter("entity <> other")
    return of.filter("blocks = 1").select("entity", (F.col("n") - 1).alias("n_duplicates")).union(pairs.groupBy("entity").agg(F.count_distinct("other").alias("n_duplicates")))


def blocked_pairs(keys: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Edges inside equal sets of keys, and pairs (a, b, conflicting) of distinct sets within a block: a report of all pairs, for
    blocks of which all pairs are wanted. Clustering does without."""
    blocks = keys.filter("name <> '' AND company <> ''")
    same = written(blocks.groupBy("name", "company", "emails", "phones").agg(F.min("rec_pos").alias("a")), "distinct-keys")
    inside = blocks.join(same, ["name", "company", "emails", "phones"]).select("a", F.col("rec_pos").alias("b")).filter("a <> b")
    x, y = same.alias("x"), same.alias("y")
    pairs = x.join(y, (F.col("x.name") == F.col("y.name")) & (F.col("x.company") == F.col("y.company")) & (F.col("x.a") < F.col("y.a")))
    clash = conflict(F.col("x.emails"), F.col("y.emails")) | conflict(F.col("x.phones"), F.col("y.phones"))
    return inside, pairs.select(F.col("x.a").alias("a"), F.col("y.a").alias("b"), clash.alias("conflicting"))


def cluster(records: DataFrame, **options) -> tuple[DataFrame, DataFrame]:
    """(rec_pos, entity) for each record, entity being the smallest rec_pos of its cluster; and its ``duplicate_groups``."""
    keys = written(match_keys(records, **options), "match-keys")
    by = lambda c: star_edges(keys.select("rec_pos", F.explode(c).alias("key")), "key")
    entity = components(by("emails").union(by("phones")).union(block_links(keys))).withColumnsRenamed({"id": "rec_pos", "class": "entity"})
    assigned = keys.select("rec_pos").join(entity, "rec_pos", "left").select("rec_pos", F.coalesce("entity", "rec_pos").alias("entity"))
    assigned = written(assigned, "assigned")
    return assigned, duplicate_groups(keys, assigned)
