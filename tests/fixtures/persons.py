"""Invented persons with known truth: several records each, with spellings, shared phones, lost keys and namesakes."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from profusion.sources.files import RECORD_FIELDS

SYLLABLES = ["ba", "ko", "mi", "ra", "te", "lu", "no", "si", "ve", "du", "pa", "jo"]


def _word(seed: int, size: int):
    pick = lambda i: F.get(F.array(*map(F.lit, SYLLABLES)), F.pmod(F.xxhash64("own", F.lit(seed + i)), F.lit(len(SYLLABLES))).cast("int"))
    return F.initcap(F.concat(*(pick(i) for i in range(size))))


def records(spark: SparkSession, n: int, seed: int = 1) -> DataFrame:
    """Source records of ``n`` persons, with the column ``person``.

    A person has one to three records. The second spells the e-mail otherwise, the third has a mistake in it but the phone of
    the first. Every 40th person's first record also has the phone of the next person (a household); of every 25th the second
    record has an e-mail of its own and no phone, so only name and company are left; every tenth has the name and company of another.
    """
    p = F.col("person")
    people = spark.range(n).select(F.col("id").alias("person"))
    own = F.when(p % 10 == 9, p - 1).otherwise(p)  # namesakes
    people = people.select("person", F.explode(F.sequence(F.lit(0), (p % 3).cast("int"))).alias("r"), own.alias("own"))
    people = people.withColumns({"full_name": F.concat_ws(" ", _word(seed, 3), _word(seed + 10, 4)), "company": F.concat(_word(seed + 20, 3), F.lit(" Inc"))})
    r, lost = F.col("r"), (p % 25 == 0) & (F.col("r") == 1)
    mail = F.concat(F.lit("u"), p.cast("string"), F.lit("@mail.example"))
    email = F.when(lost, F.concat(F.lit("lost"), p.cast("string"), F.lit("@mail.example"))).when(r == 0, mail).when(r == 1, F.concat(F.lit(" "), F.upper(mail))).otherwise(F.concat(F.lit("typo"), mail))
    phone = lambda x: F.concat(F.lit("+1 650 "), F.lpad(x.cast("string"), 7, "0"))
    phones = F.when(lost | (r == 1), F.array().cast("array<string>")).when((r == 0) & (p % 40 == 0), F.array(phone(p), phone(p + 1))).otherwise(F.array(phone(p)))
    work = F.array(F.struct(F.col("company").alias("company"), F.lit("Clerk").alias("title"), F.lit(None).cast("string").alias("start"), F.lit("Present").alias("end"), F.lit(None).cast("string").alias("summary")))
    given = {
        "source_id": F.concat_ws("_", p.cast("string"), r.cast("string")), "source_type": F.get(F.array(F.lit("recruiter_csv"), F.lit("ats_json"), F.lit("resume")), r), "method": F.lit("direct_field"),
        "full_name": F.col("full_name"), "emails": F.array(email), "phones": phones, "experience": work, "skills": F.array(F.lit("js"), F.lit("Go")),
    }
    columns = [(given[c] if c in given else F.lit(None)).cast(kind).alias(c) for c, kind in RECORD_FIELDS if c not in ("file", "item")]
    return people.select((p * 4 + r).alias("rec_pos"), *columns, p.alias("person"))
