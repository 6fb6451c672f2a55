"""Files of a small input folder, as text. All persons are invented; what comes of them is worked out in test_pipeline."""

import json

NOTES = """Recruiter Notes on Mira Okafor
Email: mira@okafor.dev
Phone: +1 312 555 0147
Company: Helix Labs
Title: Platform Lead
Skills: Rust, Kubernetes
Experience: 9 years
"""
RESUME = """Mira Okafor
mira@okafor.dev
+1 (312) 555-0147

Work History:
Data Engineer at Helix Labs (2017-03 - 2019-06)

6 years of experience with K8s and Rust
"""
CSV = """full_name,email_address,telephone,company,job_title,experience_years
Mira Okafor,Mira@Okafor.dev,312-555-0147,Helix Labs Inc,Principal Engineer,8

Raj Verma,raj@verma.example,777,Quarry Ltd,Analyst,2
Tomas Lindqvist,tomas@home.example,+1 312 555 0199,Birch & Co,Buyer,11
"""
ITEMS = json.dumps([
    {
        "ats_id": "m1", "name": "Mira Okafor", "email": "mira@okafor.dev", "phone": "+1.312.555.0147", "location": "Leeds, UK", "skills": "rust, Airflow", "years_experience": "7.5",
        "experience": [{"company": "HELIX LABS", "title": "Staff Engineer", "start": "2019-07", "end": "2022-07"}],
        "education": [{"institution": "TU Delft", "degree": "MSc", "field": "Physics", "end_year": 2016}],
    },
    {"ats_id": "t1", "full_name": "Tomas Lindqvist", "email": "t.lindqvist@work.example", "telephone": "+1 312 555 0155", "company": "Birch Co.", "title": "Buyer", "location": {"city": "Turku", "country": "nowhere"}},
])
INES = """Recruiter notes on Ines Duarte
Email: ines@duarte.example
Company: Cobalt
Skills: Go
"""
FILES = {"a.notes.txt": NOTES, "b.txt": RESUME, "c.json": ITEMS, "d.txt": INES, "e.pdf": "%PDF-1.4 cut off", "f.csv": CSV, "g.md": "of no known kind", "h.json": "["}


def write(folder) -> str:
    for name, text in FILES.items():
        (folder / name).write_text(text, encoding="utf-8")
    return str(folder)
