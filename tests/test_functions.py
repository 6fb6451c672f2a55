"""Normalizers, text parsers and sources."""

import io
import json
import random
import zipfile
import zlib

import pytest
from pyspark.sql import functions as F

from profusion.functions import normalize as N
from profusion.functions import textparse as X
from profusion.functions.text import clean_name, find_emails, number
from profusion.operators.components import components
from profusion.session import shared_dir
from profusion.sources.files import ats_json, detect, docx_text, read_records, recruiter_csv
from profusion.sources.pdftext import pdf_text


def evaluate(spark, values, f, kind="string"):
    return [r["y"] for r in spark.createDataFrame([(v,) for v in values], f"x {kind}").select(f(F.col("x")).alias("y")).collect()]


def pairs(rows):
    return [(r["value"], r["note"]) for r in rows]


def test_phone(spark):
    got = pairs(evaluate(spark, ["+1 (650) 555-0100", "650 555 0100", "12345", "", None, "call", "+44 20 7946 0958", "+919876543210", "1-650-555-0100"], N.phone))
    bad = "normalize_failed: "
    assert got == [("+16505550100", None), ("+16505550100", None), (None, bad + "ambiguous_region"), (None, None), (None, None), (None, bad + "invalid_format"), ("+442079460958", None), ("+919876543210", None), ("+16505550100", None)]


def test_phones_of_further_plans(spark):
    good = ["+41 44 668 18 00", "+46 8 123 456 78", "+55 11 91234-5678", "+353 1 234 5678", "+34 612 345 678", "+7 912 345-67-89"]
    assert all(note is None and value == "+" + "".join(filter(str.isdigit, text)) for text, (value, note) in zip(good, pairs(evaluate(spark, good, N.phone)), strict=True))
    assert all(note for _, note in pairs(evaluate(spark, ["+41 44 668 18", "+34 112 345 678", "+47 123 45 678", "+55 11 1234"], N.phone)))
    assert pairs(evaluate(spark, ["044 668 18 00"], lambda c: N.phone(c, "CH"))) == [("+41446681800", None)]


def test_calling_codes(spark):
    assert len(N.assigned_codes()) == len(set(N.assigned_codes())) and not any(a != b and b.startswith(a) for a in N.assigned_codes() for b in N.assigned_codes())
    assert set(N.CALLING) <= set(N.assigned_codes())
    got = pairs(evaluate(spark, ["+254 712 345 678", "+999 12345678", "+210 1234567890", "+254 1", "+254 712 345 678 901"], N.phone))
    bad = "normalize_failed: "
    assert got == [("+254712345678", None), (None, bad + "unknown_calling_code"), (None, bad + "unknown_calling_code"), (None, bad + "ambiguous_region"), (None, bad + "ambiguous_region")]


def test_date(spark):
    got = pairs(evaluate(spark, ["2020-05", "2020", "May 2020", "2020 DEC", "2020/13", "2020-05-17", "Present", "", None], N.date))
    year = "precision: year"
    assert got == [("2020-05", None), ("2020-01", year), ("2020-05", None), ("2020-12", None), ("2020-13", None), ("2020-01", year), (None, "normalize_failed: no_valid_year"), (None, None), (None, None)]


def test_country_and_skill(spark):
    assert pairs(evaluate(spark, ["United States", " usa", "IT", "it", "Nowhere", None], N.country)) == [("US", None), ("US", None), ("IT", None), (None, "normalize_failed: unknown_country"), (None, "normalize_failed: unknown_country"), (None, None)]
    assert evaluate(spark, ["ReactJS", "React.js", "python3", " Cobol "], N.skill) == ["react", "react", "python", "cobol"]


def test_skill_scan(spark):
    assert evaluate(spark, ["React.js and GitHub", "React", "c++ node.js", "javascripts", "my_py_lib"], N.skills_in) == [["git", "javascript", "react"], [], ["c++", "javascript", "nodejs"], [], ["python"]]


def test_clean_name_and_numbers(spark):
    assert evaluate(spark, ["Apple Inc.", "The CO-Op, Ltd", "Ünï", None], clean_name) == ["apple", "theop", "n", ""]
    assert evaluate(spark, ["5", " 5.5 ", "5d", "1_0", "", "1e3"], number) == [5.0, 5.5, None, None, None, 1000.0]


def test_years_between(spark):
    rows = spark.createDataFrame([("2018-05", "2024-05"), ("2020-01", None), ("2020-01", "now"), ("2020-13", "2021-01"), ("2020-01", "2021-13"), (None, None), ("2024-01", "2020-01")], "a string, b string")
    assert [r[0] for r in rows.select(N.years_between(F.col("a"), F.col("b"), F.lit("2022-01-01").cast("date"))).collect()] == [6.0, 2.0, 2.0, 0.0, 0.0, 0.0, 0.0]


def test_trust(spark):
    assert spark.range(1).select(N.trust(F.lit("ats_json"), F.lit("heuristic_parse")), N.trust(F.lit("x"), F.lit(None))).first()[:] == (552, 250)


def test_emails_in_unicode_text(spark):
    assert evaluate(spark, ["é@x.com, é@x.com a.b@c.org"], find_emails) == [["é@x.com", "a.b@c.org"]]


def test_resume_parts(spark):
    text = "RESUME\nann@x.com\n1234567\nAnn Lee\nCompany: Acme\nTitle: Dev\nPeriod: 2018-05 to 2020-01\n3+ years of experience"
    e = evaluate(spark, [text], X.resume_experience)[0]
    assert [(x["company"], x["title"], x["start"], x["end"]) for x in e] == [("Acme", "Dev", "2018", "05")]
    e = evaluate(spark, [text], lambda c: X.resume_experience(c, strict_dates=True))[0]
    assert (e[0]["start"], e[0]["end"]) == ("2018-05", "2020-01")
    assert evaluate(spark, [text, "McVeigh\nBob"], X.resume_name) == ["Ann Lee", "Bob"]
    assert evaluate(spark, [text, ""], X.stated_years) == [3.0, None]


def test_notes(spark):
    text = "Notes for Bo Li\n\nemail: a@x.com, ,b@x.com\nEmail: c@x.com\nSkills: A,B\nskills: C\ntotal Experience: 2 years\nPhone:"
    df = spark.createDataFrame([(text,)], "text string").withColumn("k", X.keyed_lines(F.col("text")))
    r = df.select(*X.notes(F.col("text"), F.col("k"))).first()
    assert (r["full_name"], r["emails"], r["phones"], r["skills"], r["years_experience"], r["experience"]) == ("Bo Li", ["c@x.com"], [], ["A", "B", "C"], 2.0, [])


def test_keys_of_notes_equal_separate_patterns(spark):
    """One pattern for all keys finds what a pattern for each key, tried in order, finds."""
    import re

    keys = {
        "name": r"^(?:Candidate\s+)?Name\s*:\s*(.*)$", "email": r"^Email\s*:\s*(.*)$", "phone": r"^Phone\s*:\s*(.*)$", "company": r"^(?:Current\s+)?Company\s*:\s*(.*)$", "title": r"^(?:Current\s+)?Title\s*:\s*(.*)$",
        "skills": r"^Skills\s*:\s*(.*)$", "years": r"(?:Years\s+of\s+)?Experience\s*:\s*(\d+(?:\.\d+)?)\s*years?",
    }
    draw = random.Random(28)
    parts = ["Name", "candidate\t NAME", "Email", "phone", "Current Company", "company", "TITLE", "current title", "Skills", "SKILLſ", "Years of Experience", "experience", ":", " : ", ":", "3", "2.5 years", "10 year", "x, y", "é", " ", "\r"]
    texts = ["\n".join("".join(draw.choice(parts) for _ in range(draw.randint(0, 6))) for _ in range(8)) for _ in range(300)]
    got = [[tuple(x) for x in r] for r in evaluate(spark, texts, X.keyed_lines)]
    for text, found in zip(texts, got, strict=True):
        want = []
        for line in filter(None, map(str.strip, text.split("\n"))):
            hit = next(((k, m) for k, p in keys.items() if (m := re.search(p, line, re.I))), None)
            want += [(hit[0], hit[1][1].strip())] if hit else []
        assert found == want, text


def test_detect(spark):
    rows = [("a.CSV", ""), ("b.json", "[]"), ("c.json", "{"), ("d.docx", ""), ("e.txt", "x"), ("My_Notes.txt", "x"), ("f.txt", "x\nCandidate Notes"), ("g.xml", "")]
    got = detect(spark.createDataFrame(rows, "file string, text string")).collect()
    assert [r["source_type"] for r in got] == ["recruiter_csv", "ats_json", None, "resume", "resume", "recruiter_notes", "recruiter_notes", None]


def test_csv_rows(spark):
    text = "full_name,name,email\nA,,x@y.z\n\n B ,C\n"
    got = recruiter_csv(spark.createDataFrame([("f.csv", text)], "file string, text string")).orderBy("item").collect()
    assert [(r["source_id"], r["full_name"], r["emails"], r["experience"]) for r in got] == [("f.csv_row_0", "A", ["x@y.z"], []), ("f.csv_row_1", "C", [], [])]


@pytest.mark.parametrize("bad", [5, {"email": 7}, {"experience": []}, {"years_experience": 0, "experience": [1]}, {"years_experience": 1, "education": [{"end_year": [1]}]}])
def test_a_bad_item_ends_its_file(spark, bad):
    items = [{"ats_id": "a", "years_experience": 1}, bad, {"ats_id": "c"}]
    files = spark.createDataFrame([("f.json", json.dumps(items)), ("g.json", json.dumps({"name": "One"}))], "file string, text string")
    assert sorted(r["source_id"] for r in ats_json(files).collect()) == ["f.json_ats_a", "g.json_ats_index_0"]


def test_a_file_is_judged_and_parsed_once(spark):
    """The first impossible item is found below the explosion of the items, not for each of them, and no filter parses the text again."""
    files = spark.createDataFrame([("f", "[{}]")], "file string, text string")
    plan = ats_json(files)._jdf.queryExecution().optimizedPlan().toString()
    above, _, below = plan.partition("Generate posexplode")
    assert "array_min" not in above and "array_min" in below
    assert plan.count("parseJson") == 1
    many = "[" + ",".join(['{"ats_id": "a", "years_experience": 1}'] * 3000 + ["7", "{}"]) + "]"
    files = spark.createDataFrame([("f", many), ("g", "[]"), ("h", "[null]"), ("i", "{}"), ("j", "{")], "file string, text string")
    assert {r["file"]: r["n"] for r in ats_json(files).selectExpr("split(source_id, '_')[0] AS file").groupBy("file").agg(F.count("*").alias("n")).collect()} == {"f": 3000, "i": 1}


def test_ats_forms(spark):
    item = {"name": " A ", "location": "X, Y", "skills": "p, ,q", "years_experience": "2.5", "experience": [1, {"company": "C"}], "education": [{"end_year": "x"}, {"end_year": 2001}, 3], "company": "Z"}
    r = ats_json(spark.createDataFrame([("f.json", json.dumps([item]))], "file string, text string")).first()
    assert (r["full_name"], r["location"][:], r["skills"], r["years_experience"]) == ("A", ("X", None, "Y"), ["p", "q"], 2.5)
    assert [x["company"] for x in r["experience"]] == ["C"] and [x["end_year"] for x in r["education"]] == [None, 2001]


def test_docx():
    w = 'xmlns:w="http://schemas.openxmlformats.org/wordprocessingml/2006/main"'
    p = lambda t: f"<w:p><w:r><w:t>{t}</w:t></w:r></w:p>"
    xml = f"<w:document {w}><w:body>{p('one')}<w:tbl><w:tr><w:tc>{p('a')}</w:tc><w:tc>{p('b')}</w:tc></w:tr></w:tbl>{p('two')}</w:body></w:document>"
    data = io.BytesIO()
    with zipfile.ZipFile(data, "w") as z:
        z.writestr("word/document.xml", xml)
    assert docx_text(data.getvalue()) == "one\ntwo\na b\n" and docx_text(b"no") is None


def pdf(pages, packed=True, to_unicode=None):
    """A small PDF: one content stream a page."""
    parts = [b"<< /Type /Catalog /Pages 2 0 R >>", b"<< /Type /Pages /Kids [" + b" ".join(b"%d 0 R" % (4 + 2 * i) for i in range(len(pages))) + b"] /Count %d /Resources << /Font << /F1 3 0 R >> >> >>" % len(pages)]
    parts.append(b"<< /Type /Font /Subtype /Type1 /BaseFont /Helvetica" + (b" /ToUnicode %d 0 R" % (4 + 2 * len(pages)) if to_unicode else b"") + b" >>")

    def stream(raw):
        data = zlib.compress(raw) if packed else raw
        return b"<< /Length %d%s >>\nstream\n%s\nendstream" % (len(data), b" /Filter /FlateDecode" if packed else b"", data)

    for i, raw in enumerate(pages):
        parts += [b"<< /Type /Page /Parent 2 0 R /Contents %d 0 R >>" % (5 + 2 * i), stream(raw)]
    if to_unicode:
        parts.append(stream(to_unicode))
    return b"%PDF-1.4\n" + b"".join(b"%d 0 obj\n%s\nendobj\n" % (i, x) for i, x in enumerate(parts, 1)) + b"trailer << /Root 1 0 R >>\n%%EOF"


@pytest.mark.parametrize("packed", [True, False])
def test_pdf(packed):
    one = b"BT /F1 12 Tf 72 700 Td (Mira \\(M\\) Okafor) Tj 0 -14 Td [(Data) -300 (Engi) 20 (neer)] TJ T* (caf\\351) Tj ET"
    assert pdf_text(pdf([one, b"BT (two) Tj (<6f6e>) Tj <6f6e> Tj ET"], packed)) == "Mira (M) Okafor\nData Engineer\ncafé\ntwo<6f6e>on\n"
    codes = b"1 beginbfchar <0001> <0041> endbfchar 1 beginbfrange <0002> <0004> <0062> endbfrange"
    assert pdf_text(pdf([b"BT /F1 9 Tf <0001000200030004> Tj ET"], packed, codes)) == "Abcd\n"


def test_pdf_damage():
    sound = pdf([b"BT (x) Tj ET"])
    for bad in (b"", b"%PDF-1.4 cut off", sound[:150], sound.replace(b"FlateDecode", b"LZWDecode"), sound.replace(b"/Root", b"/Encrypt 9 0 R /Root"), sound.replace(zlib.compress(b"BT (x) Tj ET"), b"nonsense")):
        assert pdf_text(bad) is None


def test_pdf_resume(spark, tmp_path):
    text = b"BT 72 700 Td (Mira Okafor) Tj 0 -14 Td (mira@okafor.dev) Tj 0 -14 Td (6 years of experience with Docker) Tj ET"
    (tmp_path / "r.pdf").write_bytes(pdf([text]))
    r = read_records(spark, str(tmp_path)).first()
    assert (r["full_name"], r["emails"], r["years_experience"], r["skills"], r["source_type"]) == ("Mira Okafor", ["mira@okafor.dev"], 6.0, ["docker"], "resume")


def test_components_of_chains(spark):
    edges = [(i, i + 1) for i in range(40)] + [(100, 120), (120, 110), (7, 7)]
    got = {r["id"]: r["class"] for r in components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert all(got[i] == 0 for i in range(1, 41)) and got[110] == got[120] == 100
    assert components(spark.createDataFrame([], "a long, b long")).count() == 0


def test_components_of_hubs_and_random_graphs(spark):
    """Stars around the smallest and the largest id, and random edges, in many partitions."""
    r = random.Random(4)
    edges = [(0, i) for i in range(1, 400)] + [(2000, i) for i in range(1001, 1400)] + [(r.randrange(3000, 3600), r.randrange(3000, 3600)) for _ in range(350)]
    up = {x: x for e in edges for x in e}

    def top(x):
        return x if up[x] == x else top(up[x])

    for a, b in edges:
        a, b = top(a), top(b)
        up[max(a, b)] = min(a, b)
    got = {x["id"]: x["class"] for x in components(spark.createDataFrame(edges, "a long, b long").repartition(16)).collect()}
    assert got == {x: top(x) for x in up if top(x) != x}


def test_a_cluster_needs_a_shared_folder():
    class Session:
        class conf:
            get = staticmethod(lambda key, default: {"spark.master": "spark://host:7077"}.get(key, default))

    with pytest.raises(ValueError):
        shared_dir(Session)
