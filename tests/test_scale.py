"""How the work of queries over tables of few bytes is spread over tasks."""

import os

import pytest
from pyspark.sql import functions as F

import __spark_entry__ as entry
from profusion.operators.merge import proposals
from profusion.plans.catalog import _records
from tests.test_entry import SF

pytestmark = pytest.mark.skipif(not os.path.isdir(SF), reason="no tables")


@pytest.mark.parametrize("name", ["Q47_notes_fallbacks", "Q28_notes_parser"])
def test_notes_of_a_small_file_are_parsed_by_many_tasks(spark, name):
    assert entry.queries()[name](spark, SF).rdd.getNumPartitions() >= 8


def test_proposals_without_a_log_carry_none_of_it(spark):
    """What only the log shows costs nothing where there is none: no JSON and no notes are made."""
    study = F.array(F.struct(F.lit("MIT").alias("institution"), F.lit("BS").alias("degree"), F.lit(None).cast("string").alias("field"), F.lit(1990).alias("end_year")))
    rows = _records(spark.range(3), "id", "id", F.lit("resume"), education=study, emails=F.array(F.lit("a@b.example")))
    with_log, without = (proposals(rows, F.lit("2026-01-01").cast("date"), log=log) for log in (True, False))
    assert with_log.filter("json IS NOT NULL").count() == 12
    assert without.filter("json IS NOT NULL OR note IS NOT NULL").count() == 0
    assert without.drop("json", "note").exceptAll(with_log.drop("json", "note")).count() == 0 and without.count() == 12
