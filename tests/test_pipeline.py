"""The whole run on a small folder, against known results."""

import collections
import json

import pytest
from pyspark.sql import functions as F

from profusion.functions.selector import load_config, project, to_json_rows
from profusion.operators.match import cluster
from profusion.operators.merge import provenance_rows
from profusion.plans.pipeline import Options, resolve, run, write_json
from profusion.schema import RAW
from profusion.sources.files import read_folder, read_records
from tests import fixtures


@pytest.fixture(scope="module")
def folder(tmp_path_factory):
    return fixtures.write(tmp_path_factory.mktemp("inputs"))


@pytest.fixture(scope="module")
def entities(spark, folder):
    return resolve(read_records(spark, folder), F.lit("2025-03-01").cast("date")).orderBy("entity").collect()


def test_records_and_files_without(spark, folder):
    found = read_folder(spark, folder)
    assert found.records.count() == 8
    assert {(r["file"], r["source_type"]) for r in found.errors.collect()} == {("g.md", None), ("h.json", "ats_json"), ("e.pdf", "resume")}


def test_entities(entities):
    """Mira: the mean of name 1, city and country 0.85, years 0.9, e-mail 1, phone 1, rust (which free text is not searched for) 0.85 + 0.05, kubernetes 0.525 + 0.05,
    airflow 0.85, work 1 and study 0.85. Values of one source keep its trust: 0.85, 0.9, and 0.55 * 0.65 for notes."""
    got = [(e["full_name"], e["overall_confidence"]) for e in entities]
    mira = round((1000 + 850 + 850 + 900 + 1000 + 1000 + 900 + 575 + 850 + 1000 + 850) / 11) / 1000
    assert got == [("Mira Okafor", mira), ("Tomas Lindqvist", 0.85), ("Ines Duarte", 0.358), ("Raj Verma", 0.9), ("Tomas Lindqvist", 0.9)]


def test_log(entities):
    """A row for every value that a source proposes: winners, losers and failures."""
    count = [collections.Counter(p["field"] for p in e["provenance"]) for e in entities]
    assert count[0] == {
        "full_name": 4, "years_experience": 4 + 2, "location.city": 1, "location.country": 1, "emails": 4, "phones": 4, "skills": 5, "experience": 4, "experience.title": 4, "experience.start": 2, "experience.end": 2,
        "experience.summary": count[0]["experience.summary"], "education": 1, "education.field": 1, "education.end_year": 1,
    }
    assert count[1]["location.country"] == 2 and entities[1]["location"]["country"] is None  # unreadable, logged twice
    derived = [p for p in entities[0]["provenance"] if p["field"] == "years_experience" and p["confidence"] in (0.68, 0.6)]
    assert sorted(json.loads(p["value"]) for p in derived) == [2.3, 3.0]


def test_log_as_a_long_table(spark, folder, entities):
    """The same rows as in the entities, but for flags and the second log of an unreadable country."""
    as_of = F.lit("2025-03-01").cast("date")
    records = read_records(spark, folder)
    assigned, _ = cluster(records)
    rows = provenance_rows(records.join(assigned, "rec_pos"), as_of).collect()
    got = collections.Counter((r["entity"], r["field"], r["source_id"], r["value"]) for r in rows)
    nested = collections.Counter((e["entity"], p["field"], p["source_id"], p["value"]) for e in entities for p in e["provenance"] if p["field"] != "possible_duplicate_of")
    assert set(got) == set(nested) and sum((nested - got).values()) == 1


def test_conflicting_namesakes_are_flagged_not_merged(entities):
    one, two = entities[1], entities[4]
    assert one["possible_duplicate_of"] == [two["candidate_id"]] and two["possible_duplicate_of"] == [one["candidate_id"]]
    last = one["provenance"][-1]
    assert (last["field"], last["source_type"], last["confidence"], json.loads(last["value"])) == ("possible_duplicate_of", "system", 0.4, [two["candidate_id"]])
    assert all(not e["possible_duplicate_of"] for e in (entities[0], entities[2], entities[3]))


def test_winners_and_losers(entities):
    mira, raj = entities[0], entities[3]
    work = mira["experience"][0]
    assert (work["company"], work["title"], work["start"], work["end"]) == ("Helix Labs Inc", "Principal Engineer", "2019-07", "2022-07")
    assert {json.loads(p["value"]) for p in mira["provenance"] if p["field"] == "experience.title"} == {"Principal Engineer", "Staff Engineer", "Data Engineer", "Platform Lead"}
    assert {s["name"]: s["confidence"] for s in mira["skills"]} == {"rust": 0.9, "kubernetes": 0.575, "airflow": 0.85}
    assert (mira["years_experience"], mira["phones"], mira["location"][:]) == (8.0, ["+13125550147"], ("Leeds", None, "GB"))
    assert [x[:] for x in mira["education"]] == [("TU Delft", "MSc", "Physics", 2016)]
    assert raj["phones"] == [] and [(p["value"], p["note"]) for p in raj["provenance"] if p["field"] == "phones"] == [("null", "normalize_failed: ambiguous_region")]


def test_stable_ids(spark, folder, entities):
    again = resolve(read_records(spark, folder).repartition(5), F.lit("2025-03-01").cast("date")).orderBy("entity").collect()
    assert [e["candidate_id"] for e in again] == [e["candidate_id"] for e in entities]
    assert all(len(e["candidate_id"]) == len("cand_") + 32 for e in entities)


def test_custom_config_as_json(spark, folder, tmp_path):
    config = load_config({"include_provenance": False, "fields": [
        {"path": "who", "from": "full_name", "type": "string", "required": True}, {"path": "mail", "from": "emails[0]", "type": "string"},
        {"path": "call", "from": "phones[0]", "type": "string", "normalize": "E164"}, {"path": "knows", "from": "skills[].name", "type": "string[]", "normalize": "canonical"},
        {"path": "land", "from": "location.country"},
    ]})
    out = tmp_path / "deep" / "out.json"
    write_json(run(spark, folder, config, F.lit("2025-03-01").cast("date")), str(out))
    rows = json.loads(out.read_text())
    assert rows[3] == {"who": "Raj Verma", "mail": "raj@verma.example", "call": None, "knows": [], "land": None, "overall_confidence": 0.9}
    assert rows[0]["call"] == "+13125550147" and sorted(rows[0]["knows"]) == ["airflow", "kubernetes", "rust"] and rows[0]["land"] == "GB"


def test_default_output_keeps_nulls_and_log(spark, folder, tmp_path):
    out = tmp_path / "out.json"
    write_json(run(spark, folder), str(out))
    mira = json.loads(out.read_text())[0]
    assert mira["links"] == {"linkedin": None, "github": None, "portfolio": None, "other": []} and mira["headline"] is None
    assert {p["value"] for p in mira["provenance"] if p["field"] == "years_experience"} == {9.0, 8.0, 7.5, 6.0, 3.0, 2.3}


def test_missing_folder_and_empty_folder(spark, tmp_path):
    with pytest.raises(FileNotFoundError):
        run(spark, str(tmp_path / "none"))
    (tmp_path / "empty").mkdir()
    out = tmp_path / "out.json"
    write_json(run(spark, str(tmp_path / "empty")), str(out))
    assert json.loads(out.read_text()) == []


def _raw(spark, rows):
    names = [f.split(" ")[0] for f in ("rec_pos source_id source_type method full_name emails phones location links headline years_experience skills experience education").split()]
    return spark.createDataFrame([tuple(r.get(n) for n in names) for r in rows], RAW)


def test_clusters_through_a_compatible_record(spark):
    """A and B conflict, but both agree with C: the guard is pairwise."""
    work = [("Acme Inc", "x", None, None, None)]
    base = {"source_type": "ats_json", "method": "direct_field", "full_name": "Ann Lee", "experience": work}
    rows = [base | {"rec_pos": 1, "source_id": "a", "emails": ["a@x.com"]}, base | {"rec_pos": 2, "source_id": "b", "emails": ["b@x.com"]}, base | {"rec_pos": 3, "source_id": "c", "emails": []}]
    assert resolve(_raw(spark, rows)).count() == 1
    assert resolve(_raw(spark, rows[:2])).count() == 2


def test_phone_spelling_option(spark):
    rows = [{"rec_pos": i, "source_id": str(i), "source_type": "resume", "method": "regex_extract", "phones": [p]} for i, p in enumerate(["650 555 0100", "+1 650-555-0100"])]
    assert resolve(_raw(spark, rows)).count() == 2
    assert resolve(_raw(spark, rows), options=Options(normalized_phone_match=True)).count() == 1


def test_links_headline_and_failed_country(spark):
    row = {"rec_pos": 1, "source_id": "s", "source_type": "ats_json", "method": "direct_field", "full_name": " Ann ", "headline": " Hi ", "location": ("Rome", None, "Nowhere"), "links": ("l", None, None, ["o1", "o2", "o1"])}
    e = resolve(_raw(spark, [row])).first()
    assert (e["full_name"], e["headline"], e["links"]["linkedin"], e["links"]["other"], e["location"]["country"]) == ("Ann", "Hi", "l", ["o1", "o2"], None)
    assert sum(p["field"] == "location.country" for p in e["provenance"]) == 2
    e = resolve(_raw(spark, [row]), options=Options(strict_compat=False)).first()
    assert sum(p["field"] == "location.country" for p in e["provenance"]) == 1


def test_stated_and_derived_years(spark):
    row = {"rec_pos": 1, "source_id": "r", "source_type": "resume", "method": "regex_extract", "full_name": "A", "years_experience": 12.0, "experience": [("C", "t", "2010-01", "2013-01", None), ("D", "u", "2014-02", "2015-02", None)]}
    e = resolve(_raw(spark, [row])).first()
    assert e["years_experience"] == 4.0 and [json.loads(p["value"]) for p in e["provenance"] if p["field"] == "years_experience"] == [12.0, 4.0]


@pytest.mark.parametrize("path", ["", "name", "emails[]", "skills[0]", "skills.name", "provenance[].x", "location.street", "a.b.c", "emails[0].x"])
def test_bad_paths(path):
    with pytest.raises(ValueError):
        load_config({"fields": [{"path": "x", "from": path}] if path else [{"path": ""}]})


def test_bad_policy():
    with pytest.raises(ValueError):
        load_config({"on_missing": "ignore"})


@pytest.fixture(scope="module")
def canonical(spark):
    rows = [{"rec_pos": i, "source_id": str(i), "source_type": "recruiter_csv", "method": "direct_field", "full_name": n, "emails": e} for i, (n, e) in enumerate([("Ann", ["a@x.com"]), ("Bo", [])])]
    return resolve(_raw(spark, rows)).orderBy("entity").cache()


def test_omit(canonical):
    config = load_config({"on_missing": "omit", "include_provenance": False, "fields": [{"path": "n", "from": "full_name"}, {"path": "mail", "from": "emails[0]"}, {"path": "links", "type": "object"}]})
    rows = [json.loads(r["value"]) for r in to_json_rows(project(canonical, config)).collect()]
    assert set(rows[0]) == {"n", "mail", "links", "overall_confidence"} and set(rows[1]) == {"n", "links", "overall_confidence"}
    assert rows[1]["links"]["linkedin"] is None


@pytest.mark.parametrize("config", [
    {"on_missing": "error", "fields": [{"path": "mail", "from": "emails[0]"}]}, {"fields": [{"path": "mail", "from": "emails[0]", "required": True}]},
    {"fields": [{"path": "n", "from": "full_name", "type": "number"}]},
])
def test_failures(canonical, config):
    with pytest.raises(Exception, match="mail|full_name|of type"):
        project(canonical, load_config(config | {"include_provenance": False})).collect()


def test_unknown_type_and_normalizer(canonical):
    config = load_config({"include_provenance": False, "include_confidence": False, "fields": [{"path": "n", "from": "full_name", "type": "thing", "normalize": "nothing"}]})
    assert [r["n"] for r in project(canonical, config).collect()] == ["Ann", "Bo"]
