"""The whole run: folder of files to configured profiles."""

from __future__ import annotations

import json
import logging
import os
import sys
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Observation, SparkSession, Window
from pyspark.sql import functions as F

from profusion.functions.selector import OutputConfig, command_line_default, needs, project, read_config, to_json_rows
from profusion.operators.match import cluster
from profusion.operators.merge import flag_groups, merge
from profusion.session import written
from profusion.sources.files import read_folder

log = logging.getLogger("profusion")


@dataclass(frozen=True)
class Options:
    """Choices that leave the original behaviour; the defaults keep it."""

    default_region: str = "US"
    normalized_phone_match: bool = False
    strict_dates: bool = False
    strict_compat: bool = True


def _observed(df: DataFrame, name: str, what: str) -> DataFrame:
    """``written``, its rows counted by the write itself."""
    seen = Observation(name)
    out = written(df.observe(seen, F.count(F.lit(1)).alias("n")), name)
    log.info("%d %s", seen.get["n"], what)
    return out


def linked(records: DataFrame, as_of: Column | None = None, options: Options = Options(), config: OutputConfig | None = None) -> tuple[DataFrame, DataFrame]:
    """Source records to canonical entities without flags, and the groups of possible duplicates among them (``match.duplicate_groups``).

    With a configuration only what it puts out is merged: without confidence, only the fields it names; without provenance, no log.
    """
    records = _observed(records, "records", "source records")
    assigned, groups = cluster(records, normalized_phone_match=options.normalized_phone_match, default_region=options.default_region)
    fields, logged = needs(config) if config else (None, True)
    merged = merge(records.join(assigned, "rec_pos"), as_of, options.default_region, options.strict_compat, fields, logged)
    return _observed(merged, "merged", "entities"), groups


def resolve(records: DataFrame, as_of: Column | None = None, options: Options = Options(), config: OutputConfig | None = None) -> DataFrame:
    """Source records to canonical entities (``linked``) with their flags, in order of their first record (column entity)."""
    merged, groups = linked(records, as_of, options, config)
    logged = needs(config)[1] if config else True
    return flag_groups(merged, groups) if not config or logged or "possible_duplicate_of" in {f.source for f in config.fields} else merged


def run(spark: SparkSession, folder: str, config: OutputConfig | None = None, as_of: Column | None = None, options: Options = Options()) -> DataFrame:
    """Projected profiles of the records in a folder; empty if there are none. What could not be read is logged, by kind and reason."""
    if "://" not in folder and not os.path.isdir(folder):
        raise FileNotFoundError(folder)
    config = config or command_line_default()
    found = read_folder(spark, folder, options.strict_dates)
    log_errors(found.errors)
    return project(resolve(found.records, as_of, options, config).orderBy("entity"), config)


def log_errors(errors: DataFrame, most: int = 20) -> None:
    """How many files and items could not be read, and the first of them by name; all are rows of ``errors``."""
    by_kind = errors.groupBy(F.coalesce("source_type", F.lit("file")).alias("kind")).agg(F.count("*").alias("n"), F.count_distinct("file").alias("files"))
    for r in by_kind.orderBy("kind").collect():  # a row per source type
        log.warning("%s: %d errors in %d files", r["kind"], r["n"], r["files"])
    for r in errors.orderBy("file", "item").limit(most).collect():
        log.warning("skipped %s%s: %s", r["file"], "" if r["item"] is None else f", item {r['item']}", r["reason"])


def write_json(profiles: DataFrame, out: str | None = None) -> None:
    """A JSON array, two spaces of indent, to a file of the driver or standard output; rows are streamed.

    For results of any size there is ``write_json_parts``.
    """
    if out:
        os.makedirs(os.path.dirname(os.path.abspath(out)), exist_ok=True)
    f = open(out, "w", encoding="utf-8") if out else sys.stdout
    try:
        first = True
        f.write("[")
        for row in to_json_rows(profiles).toLocalIterator():
            text = json.dumps(json.loads(row["value"]), indent=2, ensure_ascii=False)
            f.write(("\n" if first else ",\n") + "\n".join("  " + line for line in text.split("\n")))
            first = False
        f.write("]\n" if first else "\n]\n")
    finally:
        if out:
            f.close()


def write_json_parts(profiles: DataFrame, folder: str, order: str | None = None) -> None:
    """A JSON array in parts: text files of ``folder`` that tasks write, which in the order of their names are one valid array.

    Rows are numbered per part first (a running sum over one row per part); so each task knows which of its rows opens the
    array and which closes it. ``order`` is a column to sort by, else the rows come as they are. An empty result is ``[]``.
    """
    place = F.monotonically_increasing_id().bitwiseAND(F.lit((1 << 33) - 1))
    rows = to_json_rows(profiles.repartitionByRange(order).sortWithinPartitions(order) if order else profiles)
    rows = written(rows.withColumns({"part": F.spark_partition_id(), "place": place}), "json-rows")
    sizes = rows.groupBy("part").agg(F.count("*").alias("n"))
    ends = sizes.select("part", "n", (F.col("part") == F.min("part").over(Window.partitionBy())).alias("first"), (F.col("part") == F.max("part").over(Window.partitionBy())).alias("last"))
    known = rows.join(F.broadcast(ends), "part")
    head = F.when(F.col("first") & (F.col("place") == 0), "[").otherwise(",")
    tail = F.when(F.col("last") & (F.col("place") == F.col("n") - 1), "]").otherwise("")
    lines = known.select("part", "place", F.concat(head, "value", tail).alias("value"))
    if sizes.isEmpty():
        lines = profiles.sparkSession.createDataFrame([(0, 0, "[]")], "part int, place long, value string")
    lines.repartitionByRange("part").sortWithinPartitions("part", "place").select("value").write.text(folder)
