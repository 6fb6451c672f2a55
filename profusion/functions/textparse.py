"""Free-text parsers: resumes and recruiter notes, as Column expressions over the whole text."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from profusion.functions import normalize as N
from profusion.functions.text import EMAIL, PHONE, find_emails, find_phones, lines, number, strip
from profusion.schema import EXPERIENCE

# Headings that rule a line out as a name, and the patterns of sections and keys.
NOT_NAMES = ["resume", "cv", "experience", "education", "skills", "summary"]
YEARS = r"(?Ui)(\d+(?:\.\d+)?)\s*(?:\+)?\s*years?(?:\s+of)?\s+experience"
BLOCK = r"(?Uid)(?:Company|Employer|At):\s*(.*?)\n(?:Title|Role|Position):\s*(.*?)\n(?:Dates|Period):\s*(.*?)(?:\n|\z)"
SECTION = r"(?Uids)(?:Experience|Work History|Professional Experience):?\s*\n(.*?)(?:\n\n|\n[A-Z][a-z]+:|\z)"
ROLE = r"(?Ui)([A-Za-z\s]+)\s+at\s+([A-Za-z0-9\s]+)\s*\((\d{4}[-/]\d{2}|\d{4})\s*[-–to\s]+\s*(\d{4}[-/]\d{2}|\d{4}|present|current)\)"
RANGE = r"[-–to]+"
STRICT_RANGE = r"(?i)\s*–\s*|\s+-\s+|\s+to\s+"
#: A line of notes: a key and its value, or years of experience anywhere in it.
KEYED = (
    r"(?Uid)^(?:((?:Candidate\s+)?Name|Email|Phone|(?:Current\s+)?Company|(?:Current\s+)?Title|Skills)\s*:\s*(.*)"
    r"|.*?Experience\s*:\s*(\d+(?:\.\d+)?)\s*years?.*)$"
)
HEADER = r"(?Uid)^(?:Recruiter\s+)?Notes\s+(?:on|for|on\s+candidate)\s+(.*)$"
NO_EXPERIENCE = f"array<{EXPERIENCE}>"


def _group(text: Column, pattern: str, i: int) -> Column:
    return F.regexp_extract(text, pattern, i)


def _entry(company: Column, title: Column, start: Column, end: Column, summary: Column) -> Column:
    return F.struct(company.alias("company"), title.alias("title"), start.cast("string").alias("start"), end.cast("string").alias("end"), summary.cast("string").alias("summary"))


def resume_name(text: Column) -> Column:
    """The first of the first five lines that is short and looks like no address, number or heading."""
    def plausible(line: Column) -> Column:
        low, ok = F.lower(line), (F.length(line) < 50) & ~F.contains(line, F.lit("@")) & ~line.rlike(r"(?U)\d{5,}")
        for word in NOT_NAMES:
            ok = ok & ~F.contains(low, F.lit(word))
        return ok

    return F.get(F.filter(F.slice(lines(text), 1, 5), plausible), F.lit(0))


def stated_years(text: Column) -> Column:
    return number(F.nullif(_group(text, YEARS, 1), F.lit("")))


def resume_experience(text: Column, strict_dates: bool = False) -> Column:
    """Company, title and dates blocks; if there is none, ``Title at Company (from - to)`` rows of the first section."""
    part = lambda x, i: F.get(F.transform(F.split(x, STRICT_RANGE if strict_dates else RANGE), strip), F.lit(i))
    blocks = F.transform(
        F.regexp_extract_all(text, F.lit(BLOCK), F.lit(0)),
        lambda b: _entry(strip(_group(b, BLOCK, 1)), strip(_group(b, BLOCK, 2)), part(strip(_group(b, BLOCK, 3)), 0), part(strip(_group(b, BLOCK, 3)), 1), F.lit(None)),
    )
    rows = F.transform(
        F.regexp_extract_all(_group(text, SECTION, 1), F.lit(ROLE), F.lit(0)),
        lambda r: _entry(strip(_group(r, ROLE, 2)), strip(_group(r, ROLE, 1)), strip(_group(r, ROLE, 3)), strip(_group(r, ROLE, 4)), F.lit(None)),
    )
    # One evaluation of the blocks, and of the rows only where there is no block.
    filled = F.get(F.filter(F.array(blocks), lambda x: F.size(x) > 0), F.lit(0))
    return F.coalesce(filled, rows)


def resume(text: Column, strict_dates: bool = False) -> list[Column]:
    """Name, emails, phones, skills, years and experience of a resume text."""
    return [
        resume_name(text).alias("full_name"), find_emails(text).alias("emails"), find_phones(text).alias("phones"), N.skills_in(text).alias("skills"),
        stated_years(text).alias("years_experience"), resume_experience(text, strict_dates).alias("experience"),
    ]


def keyed_lines(text: Column) -> Column:
    """Array of (key, value): the first key that each non-blank line matches. One pattern finds all keys."""
    def keyed(line: Column) -> Column:
        years, spelled = _group(line, KEYED, 3), F.translate(_group(line, KEYED, 1), "ſıİK", "siik")  # which fold to letters of keys
        key = F.when(years != "", "years").otherwise(F.nullif(F.lower(F.regexp_replace(spelled, r"(?Ud)^.*\s", "")), F.lit("")))
        return F.struct(key.alias("key"), F.when(years != "", years).otherwise(strip(_group(line, KEYED, 2))).alias("value"))

    return F.filter(F.transform(lines(text), keyed), lambda x: x["key"].isNotNull())


def notes(text: Column, keyed: Column) -> list[Column]:
    """The fields of recruiter notes; ``keyed`` is a column made by :func:`keyed_lines`."""
    of = lambda key: F.transform(F.filter(keyed, lambda x: x["key"] == key), lambda x: x["value"])
    last = lambda key: F.try_element_at(of(key), F.lit(-1))
    listed = lambda c: F.filter(F.transform(F.split(c, ","), strip), lambda x: x != "")
    none = F.array().cast("array<string>")
    head = F.filter(F.transform(F.slice(F.split(text, "\n"), 1, 3), strip), lambda x: x.rlike(HEADER))
    header = strip(_group(F.get(head, F.lit(0)), HEADER, 1))
    company, title = F.nullif(last("company"), F.lit("")), F.nullif(last("title"), F.lit(""))
    entry = _entry(last("company"), last("title"), F.lit(None), F.lit(None), F.lit("Extracted from recruiter notes"))
    given = lambda c, other: F.when(F.size(c) > 0, c).otherwise(other)
    skills = F.flatten(F.transform(of("skills"), listed))
    return [
        F.coalesce(F.nullif(last("name"), F.lit("")), header).alias("full_name"),
        F.array_distinct(given(F.coalesce(listed(last("email")), none), F.regexp_extract_all(text, F.lit(EMAIL), F.lit(0)))).alias("emails"),
        F.array_distinct(given(F.coalesce(listed(last("phone")), none), F.regexp_extract_all(text, F.lit(PHONE), F.lit(0)))).alias("phones"),
        given(skills, N.skills_in(text)).alias("skills"),
        number(last("years")).alias("years_experience"),
        F.when(company.isNotNull() | title.isNotNull(), F.array(entry)).otherwise(F.array().cast(NO_EXPERIENCE)).alias("experience"),
    ]

