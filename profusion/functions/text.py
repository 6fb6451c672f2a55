"""String helpers with the semantics of the sources' text handling, as Column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def strip(c: Column) -> Column:
    """Trim Unicode white space at both ends."""
    return F.regexp_replace(c, r"(?U)^\s+|\s+$", "")


def empty_to_null(c: Column) -> Column:
    return F.nullif(c, F.lit(""))


def first_filled(*columns: Column) -> Column:
    """The first column that is neither null nor ''; white space counts as filled."""
    return F.coalesce(*map(empty_to_null, columns))


def number(c: Column) -> Column:
    """A double where the text is a plain decimal number, else null."""
    t = strip(c)
    return F.when(t.rlike(r"^[+-]?(?:\d+\.?\d*|\.\d+)(?:[eE][+-]?\d+)?$"), t.try_cast("double"))


def lines(c: Column) -> Column:
    """Stripped lines that are not blank."""
    return F.filter(F.transform(F.split(c, "\n"), strip), lambda x: x != "")


def clean_name(c: Column) -> Column:
    """Matching form of a name: lower case, company suffix words and all but a-z0-9 removed."""
    # The company suffixes.
    bare = F.regexp_replace(F.lower(F.coalesce(c, F.lit(""))), r"\b(?:inc|corp|co|ltd|llc|limited|corporation)\b", "")
    return F.regexp_replace(bare, r"[^a-z0-9]", "")


def email_key(c: Column) -> Column:
    return F.lower(strip(c))


def find_emails(c: Column) -> Column:
    return F.array_distinct(F.transform(F.regexp_extract_all(c, F.lit(EMAIL), F.lit(0)), strip))


def find_phones(c: Column) -> Column:
    return F.array_distinct(F.transform(F.regexp_extract_all(c, F.lit(PHONE), F.lit(0)), strip))


#: What counts as an address or a number in free text.
EMAIL = r"(?U)[\w\.-]+@[\w\.-]+\.\w+"
PHONE = r"(?U)(?:\+?\d{1,4}[-.\s]?)?\(?\d{3}\)?[-.\s]?\d{3}[-.\s]?\d{4}"
