"""Scalar normalizers. Each returns a struct of value and note, but for those that cannot fail."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from profusion.functions.text import strip

FAILED = "normalize_failed: "

# Country spellings, skill spellings, calling codes with national number forms, trust. A code or skill with its
# spellings is the natural form of the first two; the lookups below need them by spelling.
COUNTRIES = {
    "US": ["united states", "united states of america", "usa", "us"],
    "GB": ["united kingdom", "uk", "great britain", "gb"],
    "IN": ["india", "ind", "in"],
    "CA": ["canada", "can", "ca"],
    "DE": ["germany", "deutschland", "de"],
    "FR": ["france", "fra", "fr"],
    "JP": ["japan", "jpn", "jp"],
    "AU": ["australia", "aus", "au"],
    "SG": ["singapore", "sgp", "sg"],
}
SKILLS = {
    "react": ["reactjs", "react.js", "react-js", "react js"],
    "javascript": ["javascript", "js", "es6", "ecmascript"],
    "python": ["python", "py", "python3", "python 3"],
    "typescript": ["typescript", "ts"],
    "nodejs": ["node", "nodejs", "node.js", "node js"],
    "docker": ["docker", "dockerfile", "containers"],
    "kubernetes": ["kubernetes", "k8s"],
    "aws": ["aws", "amazon web services", "ec2", "s3"],
    "c++": ["c++", "cpp", "c plus plus"],
    "postgresql": ["postgres", "postgresql", "pgsql"],
    "git": ["git", "github", "gitlab"],
    "django": ["django", "django framework"],
    "machine-learning": ["machine learning", "ml", "deep learning", "dl"],
    "nlp": ["nlp", "natural language processing"],
    "java": ["java", "jdk"],
}
CALLING = {
    "1": r"[2-9]\d{2}[2-9]\d{6}", "44": r"[1-37]\d{8,9}", "91": r"[6-9]\d{9}|[1-5]\d{9}", "49": r"[1-9]\d{5,12}", "33": r"[1-9]\d{8}",
    "81": r"[1-9]\d{8,9}", "61": r"[2-478]\d{8}", "65": r"[3689]\d{7}",
    "7": r"[3489]\d{9}", "27": r"[1-8]\d{8}", "31": r"[1-9]\d{8}", "32": r"[1-9]\d{7,8}", "34": r"[5-9]\d{8}", "41": r"[2-9]\d{8}", "43": r"[1-9]\d{3,12}", "45": r"[2-9]\d{7}", "46": r"[1-9]\d{6,9}", "47": r"[2-9]\d{7}",
    "48": r"[1-9]\d{8}", "52": r"[1-9]\d{9}", "55": r"[1-9][1-9](?:9\d{8}|[2-5]\d{7})", "82": r"[1-9]\d{7,9}", "86": r"1[3-9]\d{9}|[2-9]\d{8,10}", "351": r"[2-46-9]\d{8}", "353": r"[1-9]\d{6,8}", "852": r"[2-9]\d{7}",
    "971": r"5\d{8}|[2-9]\d{7}", "972": r"5\d{8}|[2-9]\d{7}",
}
REGION_CODE = {
    "US": "1", "CA": "1", "GB": "44", "IN": "91", "DE": "49", "FR": "33", "JP": "81", "AU": "61", "SG": "65", "RU": "7", "ZA": "27", "NL": "31", "BE": "32", "ES": "34", "CH": "41", "AT": "43", "DK": "45",
    "SE": "46", "NO": "47", "PL": "48", "MX": "52", "BR": "55", "KR": "82", "CN": "86", "PT": "351", "IE": "353", "HK": "852", "AE": "971", "IL": "972",
}
#: The calling codes of E.164 that are assigned to countries and networks.
CODES = (
    "1 7 20 27 211-213 216 218 220-229 230-239 240-249 250-258 260-269 290 291 297-299 30-34 36 39 350-359 370-383 385-387 389 40 41 43-49 420 421 423 51-58 500-509 590-599 60-66 670 672-683 685-692 "
    "81 82 84 86 850 852 853 855 856 870 878 880-883 886 888 90-95 98 960-968 970-977 979 992-996 998"
)
MONTHS = ["jan", "feb", "mar", "apr", "may", "jun", "jul", "aug", "sep", "oct", "nov", "dec"]
#: Confidence in thousandths by source type (rows) and method (columns), rounded as the sum of parts requires.
METHODS = ["direct_field", "regex_extract", "heuristic_parse", "derived", ""]
TRUST = {
    "recruiter_csv": [900, 630, 585, 720, 450],
    "ats_json": [850, 595, 552, 680, 425],
    "resume": [750, 525, 488, 600, 375],
    "recruiter_notes": [550, 385, 358, 440, 275],
    "": [500, 350, 325, 400, 250],
}

SKILL_OF = {alias: name for name, aliases in SKILLS.items() for alias in aliases}
COUNTRY_OF = {alias: code for code, aliases in COUNTRIES.items() for alias in aliases}


def _lookup(table: dict, key: Column) -> Column:
    """The table's text for a key, null if it has none; one constant, whatever the table's size."""
    return F.str_to_map(F.lit("\n".join(f"{a}\t{b}" for a, b in table.items())), F.lit("\n"), F.lit("\t"))[key]


def assigned_codes() -> list[str]:
    """CODES, without its ranges."""
    return [str(n) for part in CODES.split() for a, _, b in [part.partition("-")] for n in range(int(a), int(b or a) + 1)]


def _numbers() -> str:
    """One pattern of all numbers with a calling code: the groups that match are the code and the national number."""
    plans = [f"({code}){'' if code == '1' else '0?'}({form})" for code, form in CALLING.items()]
    rest = "|".join(c for c in assigned_codes() if c not in CALLING)
    return f"^(?:{'|'.join(plans)}|(?=\\d{{9,14}}$)({rest})(\\d+))$"


def _result(value: Column | None, note: Column | str | None) -> Column:
    return F.struct((F.lit(None) if value is None else value).cast("string").alias("value"), (note if isinstance(note, Column) else F.lit(note)).cast("string").alias("note"))


def phone(c: Column, default_region: str = "US") -> Column:
    """E.164 form of a phone number. Numbers without + are read in the default region.

    Known number plans are those of CALLING; other assigned calling codes need 9 to 14 digits in all, unassigned ones fail.
    """
    plus = strip(c).startswith("+")
    digits = F.regexp_replace(c, r"(?U)[^\d]", "")
    home = REGION_CODE[default_region]
    zero = "" if home == "1" else "0?"
    own, every = f"^(?:{zero}({CALLING[home]})|{home}{zero}({CALLING[home]}))$", _numbers()
    groups = "".join(f"${i + 1}" for i in range(2 * len(CALLING) + 2))  # those of other plans are empty
    got = F.when(plus & digits.rlike(every), F.concat(F.lit("+"), F.regexp_replace(digits, every, groups))).when(~plus & digits.rlike(own), F.concat(F.lit(f"+{home}"), F.regexp_replace(digits, own, "$1$2")))
    known = digits.rlike(f"^(?:{'|'.join(assigned_codes())})")
    return (
        F.when(c.isNull() | (c == ""), _result(None, None))
        .when(~c.rlike(r"(?U)[\d+]"), _result(None, FAILED + "invalid_format"))
        .when(got.isNotNull(), _result(got, None))
        .otherwise(_result(None, F.when(plus & ~known, FAILED + "unknown_calling_code").otherwise(FAILED + "ambiguous_region")))
    )


def date(c: Column) -> Column:
    """``YYYY-MM`` form of a date text; a bare year is its January, noted as such."""
    t = strip(c)
    year = F.regexp_extract(t, r"\b((?:19|20)\d{2})\b", 1)
    low = F.lower(t)
    months = F.split(F.lit(" ".join(MONTHS)), " ")
    month = F.get(F.filter(months, lambda m: F.contains(low, m)), F.lit(0))  # the first of the year that occurs
    month = F.lpad(F.array_position(months, month).cast("string"), 2, "0")
    return (
        F.when(c.isNull() | (c == ""), _result(None, None))
        .when(t.rlike(r"^\d{4}$"), _result(F.concat(t, F.lit("-01")), "precision: year"))
        .when(t.rlike(r"^\d{4}[-/]\d{2}$"), _result(F.concat(F.substring(t, 1, 4), F.lit("-"), F.substring(t, 6, 2)), None))
        .when(year == "", _result(None, FAILED + "no_valid_year"))
        .when(month.isNotNull(), _result(F.concat(year, F.lit("-"), month), None))
        .otherwise(_result(F.concat(year, F.lit("-01")), "precision: year"))
    )


def country(c: Column) -> Column:
    """ISO 3166 alpha-2 code."""
    code = F.coalesce(_lookup(COUNTRY_OF, F.lower(strip(c))), F.when(strip(c).rlike(r"^\p{Lu}{2}$"), strip(c)))
    return F.when(c.isNull() | (c == ""), _result(None, None)).when(code.isNotNull(), _result(code, None)).otherwise(_result(None, FAILED + "unknown_country"))


def skill(c: Column) -> Column:
    key = F.lower(strip(c))
    return F.coalesce(_lookup(SKILL_OF, key), key)


def skills_in(text: Column) -> Column:
    """Sorted canonical skills whose spellings occur as words in a free text."""
    # A search at each place, for any spelling that begins there: spellings that begin alike are of one skill.
    quoted = lambda a: a.replace(".", r"\.").replace("+", r"\+")
    special = ["c++", "node.js"]  # their ends are no ends of words
    plain = "|".join(quoted(a) for a in SKILL_OF if a not in special)
    low = F.lower(text)
    all_ = lambda pattern: F.regexp_extract_all(low, F.lit(f"(?U)(?={pattern})"), F.lit(1))
    found = F.concat(all_(rf"(?:\b|_)({plain})(?:\b|_)"), all_(rf"\b({'|'.join(map(quoted, special))})(?:\b|\s|$)"))
    return F.array_sort(F.array_distinct(F.transform(F.array_distinct(found), lambda a: _lookup(SKILL_OF, a))))


def years_between(start: Column, end: Column, as_of: Column) -> Column:
    """Years from start to end, one decimal; open or unreadable ends mean ``as_of``; unreadable starts give 0."""
    s, e = date(start)["value"], date(end)["value"]
    today = end.isNull() | (end == "") | F.lower(strip(end)).isin("present", "current", "now") | e.isNull()
    bad = ~today & F.try_to_date(e, "yyyy-MM").isNull()
    days = F.datediff(F.when(today, as_of).otherwise(F.try_to_date(e, "yyyy-MM")), F.try_to_date(s, "yyyy-MM"))
    return F.when(bad, 0.0).otherwise(F.coalesce(F.round(F.greatest(F.lit(0.0), days / 365.25), 1), F.lit(0.0)))


def current_company(experience: Column) -> Column:
    """Company of the first open entry, else of the first entry."""
    is_open = lambda x: x["end"].isNull() | (x["end"] == "") | F.lower(strip(x["end"])).isin("present", "current")
    return F.coalesce(F.get(F.filter(experience, is_open), F.lit(0)), F.get(experience, F.lit(0)))["company"]


def trust(source_type: Column, method: Column) -> Column:
    """Confidence of a source type and method in thousandths."""
    table = {f"{s}|{m}": v for s, row in TRUST.items() for m, v in zip(METHODS, row, strict=True)}
    kind = F.when(source_type.isin(*filter(None, TRUST)), source_type).otherwise("")
    how = F.when(method.isin(*filter(None, METHODS)), method).otherwise("")
    return _lookup(table, F.concat_ws("|", kind, how)).cast("int")
