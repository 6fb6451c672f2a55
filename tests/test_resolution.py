"""Matching, merging and output at size, and against brute force."""

from __future__ import annotations

import itertools
import json
import logging
import random
import time

import pytest
from pyspark.sql import functions as F

from profusion.functions.selector import load_config, needs, project
from profusion.operators.match import block_links, cluster, match_keys
from profusion.operators.merge import merge, proposals
from profusion.plans.pipeline import log_errors, resolve, write_json_parts
from profusion.schema import RAW
from tests.fixtures import persons

def as_of():
    return F.lit("2026-01-01").cast("date")

NAMES = "rec_pos source_id source_type method full_name emails phones location links headline years_experience skills experience education".split()


def _raw(spark, rows):
    return spark.createDataFrame([tuple(r.get(n) for n in NAMES) for r in rows], RAW)


def _random_records(draw, n):
    kinds = ["recruiter_csv", "ats_json", "resume", "recruiter_notes", "other"]
    some = lambda values, most: [draw.choice(values) for _ in range(draw.randint(0, most))]
    for i in range(n):
        yield {
            "rec_pos": i, "source_id": f"s{draw.randrange(n)}", "source_type": draw.choice(kinds), "method": draw.choice(["direct_field", "regex_extract", "heuristic_parse"]),
            "full_name": draw.choice(["Ann", " Ann ", "Bo", "", None]), "emails": draw.choice([None, some(["a@x", "A@x ", "b@x", "c@x", " "], 2)]), "phones": some(["650 555 0100", "12", "+44 20 7946 0958", ""], 2),
            "location": draw.choice([None, ("Rome", None, draw.choice(["Italy", "uk", None, "Nowhere"]))]), "links": draw.choice([None, ("l", None, None, some(["o1", "o2"], 3))]), "headline": draw.choice([None, "", "Hi"]),
            "years_experience": draw.choice([None, 2.0, 5.5]), "skills": draw.choice([None, some(["js", "JavaScript", "Go", "K8s"], 3)]),
            "experience": draw.choice([None, [(c, draw.choice(["t", "u", None]), draw.choice([None, "2018-01", "2019"]), draw.choice([None, "2020-03", "Present"]), None) for c in some(["Acme", "ACME Inc", "Birch", "", None], 3)]]),
            "education": [(draw.choice(["MIT", "Mit", None]), draw.choice(["BS", None]), draw.choice(["x", "y", None]), draw.choice([None, 2000, 2001])) for _ in range(draw.randint(0, 2))],
        }


# ---------------------------------------------------------------- matching


def _slow_clusters(rows):
    """Entities and possible duplicates by all pairs."""
    top = {r["rec_pos"]: r["rec_pos"] for r in rows}

    def find(x):
        while top[x] != x:
            x = top[x]
        return x

    flags = []
    for a, b in itertools.combinations(rows, 2):
        shared = any(set(a[c]) & set(b[c]) for c in ("emails", "phones"))
        block = a["name"] and a["company"] and (a["name"], a["company"]) == (b["name"], b["company"])
        clash = any(a[c] and b[c] and not set(a[c]) & set(b[c]) for c in ("emails", "phones"))
        if shared or block and not clash:
            x, y = sorted((find(a["rec_pos"]), find(b["rec_pos"])))
            top[y] = x
        if block and clash:
            flags.append((a["rec_pos"], b["rec_pos"]))
    entity = {x: find(x) for x in top}
    return entity, {tuple(sorted((entity[a], entity[b]))) for a, b in flags if entity[a] != entity[b]}


def test_linear_matching_equals_all_pairs(spark):
    draw = random.Random(11)
    for t in range(3):
        mails, n = [3, 8, 30][t], 70
        raw = [
            {"rec_pos": i, "full_name": f"N{draw.randrange(4) or ''}" if draw.random() < 0.9 else None, "emails": [f"m{draw.randrange(mails)}@x" for _ in range(draw.choice([0, 1, 1, 2]))],
             "phones": [f"{draw.randrange(mails)}" for _ in range(draw.choice([0, 0, 1, 2]))], "experience": [(draw.choice(["Acme", "Birch", ""]), None, None, None, None)]}
            for i in range(n)
        ]
        records = _raw(spark, raw)
        rows = [r.asDict() for r in match_keys(records).collect()]
        entity, pairs = _slow_clusters(rows)
        assigned, groups = cluster(records)
        assert {r["rec_pos"]: r["entity"] for r in assigned.collect()} == entity
        found = groups.collect()
        by_block: dict = {}
        for r in found:
            by_block.setdefault((r["name"], r["company"]), []).append(r["entity"])
            assert r["n"] >= 2
        assert {p for own in by_block.values() for p in itertools.combinations(sorted(own), 2)} == pairs, t


def test_a_block_of_many_sets_stays_linear(spark):
    n = 100_000
    work = F.array(F.struct(F.lit("Acme").alias("company"), *(F.lit(None).cast("string").alias(x) for x in ("title", "start", "end", "summary"))))
    base = spark.range(n).select(F.col("id").alias("rec_pos"), F.lit("Ann Lee").alias("full_name"), F.array(F.concat(F.lit("m"), "id")).alias("emails"), F.array().cast("array<string>").alias("phones"), work.alias("experience"))
    start = time.time()
    assigned, groups = cluster(base)
    assert assigned.select("entity").distinct().count() == n and groups.count() == n and groups.select("n").distinct().collect()[0]["n"] == n
    bare = base.withColumn("emails", F.when(F.col("rec_pos") > 7, F.col("emails")).otherwise(F.array().cast("array<string>")))
    edges = block_links(match_keys(bare))
    assert edges.count() <= 2 * n
    assigned, groups = cluster(bare)
    assert assigned.select("entity").distinct().count() == 1 and groups.isEmpty()
    assert time.time() - start < 120


def test_precision_and_recall_against_known_persons(spark):
    records = persons.records(spark, 100_000)
    assigned, groups = cluster(records)
    truth = assigned.join(records.select("rec_pos", "person"), "rec_pos")
    pairs = lambda *keys: truth.groupBy(*keys).count().selectExpr("sum(count * (count - 1) / 2) n").first()["n"]
    both, found, true = pairs("person", "entity"), pairs("entity"), pairs("person")
    assert both / found > 0.93 and 0.95 < both / true < 1
    # What is missed has only name and company in common with the rest of its person: all of it is flagged.
    split = truth.groupBy("person").agg(F.count_distinct("entity").alias("k"), F.collect_set("entity").alias("entities")).filter("k > 1")
    flagged = split.select("person", F.explode("entities").alias("entity")).join(groups.select("entity").distinct(), "entity", "left_semi").select("person").distinct()
    assert split.count() > 1000 and flagged.count() == split.count()


# ---------------------------------------------------------------- merging


def test_merging_without_log_gives_the_same_values(spark):
    draw = random.Random(12)
    records = _raw(spark, list(_random_records(draw, 160))).withColumn("entity", F.col("rec_pos") % 9)
    whole = {r["entity"]: r.asDict(True) for r in merge(records, as_of()).collect()}
    lean = {r["entity"]: r.asDict(True) for r in merge(records, as_of(), log=False).collect()}
    assert len(whole) == 9 and all(whole[e].pop("provenance") and lean[e].pop("provenance") == [] for e in whole)
    assert lean == whole


def test_only_fields_asked_for_are_proposed(spark):
    draw = random.Random(13)
    records = _raw(spark, list(_random_records(draw, 60))).withColumn("entity", F.col("rec_pos") % 4)
    config = load_config({"include_provenance": False, "include_confidence": False, "fields": [{"path": "m", "from": "emails[0]"}, {"path": "skills", "type": "object[]"}]})
    fields, log = needs(config)
    assert (fields, log) == ({"emails", "skills"}, False)
    p = proposals(records, as_of(), fields=fields)
    assert {r["field"] for r in p.select("field").distinct().collect()} <= {"", "emails", "skills"}
    plan = p._jdf.queryExecution().optimizedPlan().toString()
    assert "normalize_failed" not in plan and "experience.title" not in plan and "emails" in plan  # nothing of phones, countries, work
    assert "normalize_failed" in proposals(records, as_of())._jdf.queryExecution().optimizedPlan().toString()
    want = {r["entity"]: (r["emails"], r["skills"], r["candidate_id"]) for r in merge(records, as_of()).collect()}
    got = {r["entity"]: (r["emails"], r["skills"], r["candidate_id"]) for r in merge(records, as_of(), fields=fields, log=log).collect()}
    assert got == want
    for more in ({"include_confidence": True}, {"fields": [{"path": "overall_confidence", "type": "number"}]}):
        assert needs(load_config({"include_provenance": False, "include_confidence": False, "fields": [{"path": "full_name"}]} | more))[0] is None
    assert needs(load_config({"include_confidence": False, "fields": [{"path": "full_name"}]})) == ({"full_name"}, True)


def test_an_entity_of_a_million_records(spark):
    n = 1_000_000
    k = F.col("id")
    base = _raw(spark, []).schema
    given = {
        "rec_pos": k, "source_id": F.concat(F.lit("s"), k), "source_type": F.when(k % 2 == 0, "recruiter_csv").otherwise("resume"), "method": F.lit("direct_field"), "full_name": F.concat(F.lit("Name "), k % 3),
        "emails": F.array(F.concat(F.lit("m"), k % 5, F.lit("@x"))), "headline": F.when(k == 77_777, "once"),
    }
    rows = spark.range(n).select(*((given[f.name] if f.name in given else F.lit(None)).cast(f.dataType).alias(f.name) for f in base), F.lit(0).cast("long").alias("entity"))
    e = merge(rows, as_of(), fields={"full_name", "emails", "headline"}, log=False).first()
    assert (e["full_name"], e["emails"], e["headline"], e["provenance"]) == ("Name 0", [f"m{i}@x" for i in range(5)], "once", [])


# ---------------------------------------------------------------- the run


@pytest.mark.parametrize("n", [0, 1, 5, 300])
def test_an_array_in_parts_is_one_array(spark, tmp_path, n):
    rows = spark.range(n).repartition(6).select(F.col("id"), F.concat(F.lit('a "b" '), F.col("id").cast("string")).alias("t"), F.lit(None).cast("string").alias("none"))
    for order in ("id", None):
        out = tmp_path / str(order)
        write_json_parts(rows, str(out), order)
        got = json.loads("".join(p.read_text() for p in sorted(out.glob("part-*"))))
        assert sorted(got, key=lambda r: r["id"]) == [{"id": i, "t": f'a "b" {i}', "none": None} for i in range(n)]
        assert order is None or [r["id"] for r in got] == list(range(n))


def test_counts_are_logged_by_the_writes(spark, caplog):
    records = _raw(spark, [{"rec_pos": i, "source_id": str(i), "source_type": "resume", "method": "direct_field", "full_name": "A", "emails": [f"{i % 3}@x"]} for i in range(7)])
    with caplog.at_level(logging.INFO, "profusion"):
        resolve(records, as_of())
        log_errors(spark.createDataFrame([("f.csv", 3, "recruiter_csv", "a row of 9 characters"), ("g.md", None, None, "no known kind of file")], "file string, item long, source_type string, reason string"))
    said = [r.getMessage() for r in caplog.records if r.name == "profusion"]
    assert said[:2] == ["7 source records", "3 entities"]
    assert said[2:] == ["file: 1 errors in 1 files", "recruiter_csv: 1 errors in 1 files", "skipped f.csv, item 3: a row of 9 characters", "skipped g.md: no known kind of file"]


def test_a_pruned_run_gives_the_same_output(spark):
    draw = random.Random(14)
    records = _raw(spark, list(_random_records(draw, 80)))
    config = load_config({"include_provenance": False, "include_confidence": False, "fields": [{"path": "id", "from": "candidate_id"}, {"path": "mails", "from": "emails", "type": "string[]"}, {"path": "dup", "from": "possible_duplicate_of", "type": "string[]"}]})
    whole = project(resolve(records, as_of()), config).collect()
    assert sorted(map(str, project(resolve(records, as_of(), config=config), config).collect())) == sorted(map(str, whole))
