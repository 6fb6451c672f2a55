"""Merging: all records of an entity become one row, by one long table of proposals and two aggregations.

Each record proposes values for fields. Values are aggregated (confidence of the most trusted source plus
0.05 per further agreeing source, 1 at most), then fields (the value of highest confidence, the first
proposed among equals), then entities. Confidences are integers in thousandths until the end.

There are two ways. With the log, each value carries the proposals made for it, and the entity's row holds them all. Without it
(``log=False``) values are first aggregated by source, so that no list grows with the records of an entity: a winner per field, the
distinct values of those fields that keep all, and the sources of skills are all that is gathered. The log is then a table of its
own (``provenance_rows``). Only the fields asked for are proposed.
"""

from __future__ import annotations

from functools import partial

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from profusion.functions import normalize as N
from profusion.functions.text import clean_name, email_key, strip
from profusion.session import written

#: Output fields that records propose values for, and those of them that keep all values.
PROPOSED = ["full_name", "headline", "years_experience", "location", "emails", "phones", "links", "skills", "experience", "education"]
LISTS = ["emails", "phones", "links.other", "skills"]
#: Order of the fields in the provenance log.
FIELDS = [
    "full_name", "headline", "years_experience", "location.city", "location.region", "location.country", "emails", "phones",
    "links.linkedin", "links.github", "links.portfolio", "links.other", "skills",
]
EXPERIENCE_FIELDS = ["experience.title", "experience.start", "experience.end", "experience.summary", "experience"]
EDUCATION_FIELDS = ["education.field", "education.end_year", "education"]
STEP, FULL = 50, 1000

_ENTRY = "struct<company:string,title:string,institution:string,degree:string>"
_PROPOSAL = f"struct<field:string,grp:string,value:string,failed:boolean,json:string,num:double,conf:int,note:string,entry:{_ENTRY}>"


def json_text(c: Column) -> Column:
    """JSON of a column of any type; nulls inside stay."""
    listed = F.to_json(F.array(c), {"ignoreNullFields": "false"})
    return F.when(c.isNull(), "null").otherwise(F.substring(listed, F.lit(2), F.length(listed) - 2))


def _proposal(field: str, value: Column, conf: Column, *, grp: Column | None = None, failed: Column | None = None, json: Column | None = None, num: Column | None = None, note: Column | None = None, entry: Column | None = None, log: bool = True) -> Column:
    """A value that a record proposes; without ``log`` its JSON and note, which nothing else reads, are null and cost nothing."""
    none = lambda kind: F.lit(None).cast(kind)
    failed = F.lit(False) if failed is None else failed
    return F.struct(
        F.lit(field).alias("field"), (F.lit("") if grp is None else grp).alias("grp"), value.alias("value"), failed.alias("failed"),
        (F.when(failed, "null").otherwise(json_text(value) if json is None else json) if log else none("string")).alias("json"), (none("double") if num is None else num).alias("num"),
        conf.cast("int").alias("conf"), (none("string") if note is None or not log else note).alias("note"), (none(_ENTRY) if entry is None else entry).alias("entry"),
    ).cast(_PROPOSAL)


def _if(condition: Column, proposal: Column) -> Column:
    return F.when(condition, F.array(proposal)).otherwise(F.array().cast(f"array<{_PROPOSAL}>"))


def _filled(c: Column) -> Column:
    return F.coalesce(c != "", F.lit(False))


def _each(values: Column, proposal, kind: str = "array<string>") -> Column:
    return F.transform(F.coalesce(values, F.array().cast(kind)), proposal)


def proposals(records: DataFrame, as_of: Column, default_region: str = "US", fields: set[str] | None = None, log: bool = True) -> DataFrame:
    """Rows entity, rec_pos, idx, source_id, source_type, method and the proposal's fields. ``records`` has a column entity.

    Of ``PROPOSED`` only ``fields`` are proposed, all if that is None; besides, each record proposes its source, for the field ''.
    Without ``log`` the columns json and note are null.
    """
    proposal = partial(_proposal, log=log)
    conf, derived = N.trust(F.col("source_type"), F.col("method")), N.trust(F.col("source_type"), F.lit("derived"))
    col = F.col

    def plain(field: str, c: Column) -> Column:
        return _if(_filled(c), proposal(field, strip(c), conf))

    def coded(field: str, c: Column, result: Column, keep: Column | None = None) -> Column:
        bad = result["value"].isNull()
        return proposal(field, F.coalesce(result["value"], F.concat(F.lit("normalize_failed_"), c)), conf, failed=bad, note=result["note"])

    not_blank = lambda x: x.isNotNull() & (strip(x) != "")
    years = lambda v, c: proposal("years_experience", v.cast("string"), c, json=v.cast("string"), num=v)

    def stated_and_derived() -> list[Column]:
        work = F.coalesce("experience", F.array().cast("array<struct<company:string,title:string,start:string,end:string,summary:string>>"))
        computed = F.round(F.aggregate(work, F.lit(0.0), lambda acc, e: acc + N.years_between(e["start"], e["end"], as_of)), 1)
        return [_if(col("years_experience").isNotNull(), years(col("years_experience"), conf)), _if(computed > 0, years(computed, derived))]

    def experience(e: Column) -> Column:
        grp = clean_name(e["company"])
        entry = F.struct(e["company"].alias("company"), e["title"].alias("title"), F.lit(None).cast("string").alias("institution"), F.lit(None).cast("string").alias("degree"))
        whole = json_text(F.struct(e["company"].alias("company"), e["title"].alias("title"), e["start"].alias("start"), e["end"].alias("end")))
        sub = lambda f, c, note=None: _if(_filled(c), proposal(f, c, conf, grp=grp, note=note))
        parts = F.concat(
            sub("experience.title", e["title"]), sub("experience.start", e["start"], N.date(e["start"])["note"]), sub("experience.end", e["end"], N.date(e["end"])["note"]),
            sub("experience.summary", e["summary"]), F.array(proposal("experience", grp, conf, grp=grp, json=whole, entry=entry)),
        )
        return F.when(grp != "", parts).otherwise(F.array().cast(f"array<{_PROPOSAL}>"))

    def education(e: Column) -> Column:
        grp = F.concat(clean_name(e["institution"]), F.lit("\u0001"), clean_name(e["degree"]))
        entry = F.struct(F.lit(None).cast("string").alias("company"), F.lit(None).cast("string").alias("title"), e["institution"].alias("institution"), e["degree"].alias("degree"))
        year = e["end_year"].cast("string")
        parts = F.concat(
            _if(_filled(e["field"]), proposal("education.field", e["field"], conf, grp=grp)),
            _if(e["end_year"].isNotNull(), proposal("education.end_year", year, conf, grp=grp, json=year, num=e["end_year"].cast("double"), note=N.date(year)["note"])),
            F.array(proposal("education", grp, conf, grp=grp, json=json_text(e), entry=entry)),
        )
        return F.when(grp != "\u0001", parts).otherwise(F.array().cast(f"array<{_PROPOSAL}>"))

    country = col("location.country")
    parts = {
        "full_name": lambda: [_if(F.coalesce(strip(col("full_name")) != "", F.lit(False)), proposal("full_name", strip(col("full_name")), conf))],
        "headline": lambda: [plain("headline", col("headline"))],
        "years_experience": stated_and_derived,
        "location": lambda: [
            plain("location.city", col("location.city")), plain("location.region", col("location.region")), _if(_filled(country), coded("location.country", country, N.country(country))),
        ],
        "emails": lambda: [_each(F.filter(F.coalesce("emails", F.array().cast("array<string>")), not_blank), lambda x: proposal("emails", email_key(x), conf, json=json_text(x)))],
        "phones": lambda: [_each(F.filter(F.coalesce("phones", F.array().cast("array<string>")), not_blank), lambda x: coded("phones", x, N.phone(x, default_region)))],
        "links": lambda: [
            plain("links.linkedin", col("links.linkedin")), plain("links.github", col("links.github")), plain("links.portfolio", col("links.portfolio")),
            _each(F.filter(F.coalesce(col("links.other"), F.array().cast("array<string>")), _filled), lambda x: proposal("links.other", strip(x), conf)),
        ],
        "skills": lambda: [_each(F.filter(F.coalesce("skills", F.array().cast("array<string>")), lambda x: x.isNotNull()), lambda x: proposal("skills", N.skill(x), conf))],
        "experience": lambda: [F.flatten(F.transform(F.coalesce("experience", F.array().cast("array<struct<company:string,title:string,start:string,end:string,summary:string>>")), experience))],
        "education": lambda: [F.flatten(F.transform(F.coalesce("education", F.array().cast("array<struct<institution:string,degree:string,field:string,end_year:int>>")), education))],
    }
    wanted = [part for name in PROPOSED if fields is None or name in fields for part in parts[name]()]
    every = F.concat(F.array(proposal("", col("source_id"), conf)), *wanted)
    return records.select("entity", "rec_pos", "source_id", "source_type", "method", F.posexplode(every).alias("idx", "p")).select("entity", "rec_pos", "idx", "source_id", "source_type", "method", "p.*")


def corroborated(best: Column, sources: Column) -> Column:
    """Thousandths: the best source's confidence plus a step per further agreeing source."""
    return F.least(F.lit(FULL), best + STEP * (sources - 1)).cast("int")


def value_groups(p: DataFrame) -> DataFrame:
    """One row per entity, field, group and value: conf, sources, the first place, the best entry and the proposals."""
    log = F.struct("rec_pos", "idx", "source_id", "source_type", "method", "json", "conf", "note")
    return p.groupBy("entity", "field", "grp", "value", "failed").agg(
        corroborated(F.max("conf"), F.size(F.collect_set("source_id"))).alias("conf"), F.array_sort(F.collect_set("source_id")).alias("sources"), F.max("num").alias("num"),
        F.min(F.struct("rec_pos", "idx")).alias("first"), F.max_by("entry", F.struct("conf", -F.col("rec_pos"), -F.col("idx"))).alias("entry"), F.array_sort(F.collect_list(log)).alias("log"),
    )


def field_groups(v: DataFrame) -> DataFrame:
    """One row per entity, field and group: the winner, its confidence, all values in order of proposal."""
    rank = F.when(~F.col("failed"), F.struct("conf", -F.col("first.rec_pos"), -F.col("first.idx")))
    return v.groupBy("entity", "field", "grp").agg(
        F.max_by(F.struct("value", "num"), rank).alias("win"), F.max(F.when(~F.col("failed"), F.col("conf"))).alias("conf"), F.min("first").alias("first"),
        F.max_by("entry", rank).alias("entry"), F.array_sort(F.collect_list(F.struct("first", "value", "conf", "sources", "failed", "log"))).alias("vals"),
        _id_of(F.col("value")).alias("id"),
    )


def lean_groups(p: DataFrame) -> DataFrame:
    """``field_groups`` without logs: values are aggregated by source first, and only fields of ``LISTS`` keep their values."""
    key = ["entity", "field", "grp", "value", "failed"]
    rank = F.struct("conf", -F.col("rec_pos"), -F.col("idx"))
    by_source = p.groupBy(*key, "source_id").agg(F.max("conf").alias("conf"), F.max("num").alias("num"), F.min(F.struct("rec_pos", "idx")).alias("first"), F.max(F.struct(rank.alias("rank"), "entry")).alias("top"))
    v = by_source.groupBy(*key).agg(
        corroborated(F.max("conf"), F.count("*")).alias("conf"), F.array_sort(F.collect_list(F.when(F.col("field") == "skills", F.col("source_id")))).alias("sources"), F.max("num").alias("num"),
        F.min("first").alias("first"), F.max("top")["entry"].alias("entry"),
    )
    won = F.when(~F.col("failed"), F.struct("conf", -F.col("first.rec_pos"), -F.col("first.idx")))
    kept = F.when(F.col("field").isin(*LISTS), F.struct("first", "value", "conf", "sources", "failed"))
    return v.groupBy("entity", "field", "grp").agg(
        F.max_by(F.struct("value", "num"), won).alias("win"), F.max(F.when(~F.col("failed"), F.col("conf"))).alias("conf"), F.min("first").alias("first"),
        F.max_by("entry", won).alias("entry"), F.array_sort(F.collect_list(kept)).alias("vals"), _id_of(F.col("value")).alias("id"),
    )


def _id_of(values: Column) -> Column:
    """An id of a set of texts, whatever their order: two sums without carry of hashes, in hexadecimal digits."""
    return F.concat(*(F.lpad(F.lower(F.hex(F.bit_xor(F.xxhash64(values, F.lit(seed))))), 16, "0") for seed in (1, 2)))


def merge(records: DataFrame, as_of: Column | None = None, default_region: str = "US", strict_compat: bool = True, fields: set[str] | None = None, log: bool = True) -> DataFrame:
    """One row per entity: column entity, then those of the canonical schema, possible_duplicate_of being empty.

    ``strict_compat`` logs an unreadable country twice per proposal, as the original behaviour has it. Only ``fields`` are
    merged, all if that is None (the overall confidence then is that of these fields); without ``log``, provenance is empty.
    """
    as_of = F.current_date() if as_of is None else as_of
    p = proposals(records, as_of, default_region, fields, log)
    fields = field_groups(value_groups(p)) if log else lean_groups(p)
    whole = fields.groupBy("entity").agg(F.max(F.when(F.col("field") == "", F.col("id"))).alias("__id"), F.collect_list(F.when(F.col("field") != "", F.struct("field", "grp", "win", "conf", "first", "entry", "vals"))).alias("items"))
    items, vals = F.col("items"), fields.schema["vals"].dataType
    of = lambda f: F.get(F.filter(items, lambda x: x["field"] == f), F.lit(0))
    within = lambda f, g: F.get(F.filter(items, lambda x: (x["field"] == f) & (x["grp"] == g)), F.lit(0))
    good = lambda f: F.filter(F.coalesce(of(f)["vals"], F.array().cast(vals)), lambda v: ~v["failed"])
    groups = lambda f: F.transform(F.array_sort(F.transform(F.filter(items, lambda x: x["field"] == f), lambda x: F.struct(x["first"].alias("first"), x["grp"].alias("grp"), x["conf"].alias("conf"), x["entry"].alias("entry")))), lambda x: x)
    whole = whole.withColumns({"exp": groups("experience"), "edu": groups("education")})
    values = lambda f: F.transform(good(f), lambda v: v["value"])
    win = lambda f: of(f)["win"]["value"]

    def as_experience(g: Column) -> Column:
        sub = lambda f: within(f, g["grp"])["win"]["value"]
        start, end = sub("experience.start"), sub("experience.end")
        return F.struct(
            g["entry"]["company"].alias("company"), F.coalesce(sub("experience.title"), g["entry"]["title"]).alias("title"),
            F.coalesce(N.date(start)["value"], start).alias("start"), F.coalesce(N.date(end)["value"], end).alias("end"), sub("experience.summary").alias("summary"),
        )

    def as_education(g: Column) -> Column:
        return F.struct(
            g["entry"]["institution"].alias("institution"), g["entry"]["degree"].alias("degree"), within("education.field", g["grp"])["win"]["value"].alias("field"),
            within("education.end_year", g["grp"])["win"]["num"].cast("int").alias("end_year"),
        )

    def entries(item: Column, twice: bool = False) -> Column:
        rows = lambda vals: F.flatten(F.transform(vals, lambda v: F.transform(v["log"], lambda p: _provenance(item["field"], p))))
        bad = F.filter(item["vals"], lambda v: v["failed"])
        return F.concat(rows(bad), rows(item["vals"])) if twice else rows(item["vals"])

    def _provenance(field: Column, p: Column) -> Column:
        return F.struct(field.alias("field"), p["source_id"].alias("source_id"), p["source_type"].alias("source_type"), p["method"].alias("method"), p["json"].alias("value"), (p["conf"] / 1000).alias("confidence"), p["note"].alias("note"))

    none = F.array().cast("array<struct<field:string,source_id:string,source_type:string,method:string,value:string,confidence:double,note:string>>")
    logged = lambda item, twice=False: F.when(item.isNotNull(), entries(item, twice)).otherwise(none)
    by_group = lambda c, names: F.flatten(F.transform(F.col(c), lambda g: F.concat(*(logged(within(f, g["grp"])) for f in names))))
    provenance = none if not log else F.concat(
        *(logged(of(f), twice=strict_compat and f == "location.country") for f in FIELDS),
        by_group("exp", EXPERIENCE_FIELDS), by_group("edu", EDUCATION_FIELDS),
    )
    city, region, country = win("location.city"), win("location.region"), win("location.country")
    confs = lambda f: F.transform(good(f), lambda v: v["conf"])
    single = lambda f: F.when(_filled(win(f)), F.array(of(f)["conf"])).otherwise(F.array().cast("array<int>"))
    all_confs = F.concat(
        *map(single, ["full_name", "location.city", "location.region", "location.country", "headline", "years_experience"]), *map(confs, ["emails", "phones", "skills"]),
        F.transform("exp", lambda g: g["conf"]), F.transform("edu", lambda g: g["conf"]),
    )
    out = whole.select(
        "entity", F.concat(F.lit("cand_"), F.col("__id")).alias("candidate_id"), win("full_name").alias("full_name"),
        values("emails").alias("emails"), values("phones").alias("phones"),
        F.when(city.isNotNull() | region.isNotNull() | country.isNotNull(), F.struct(city.alias("city"), region.alias("region"), country.alias("country"))).alias("location"),
        F.struct(*(win(f"links.{k}").alias(k) for k in ("linkedin", "github", "portfolio")), values("links.other").alias("other")).alias("links"),
        win("headline").alias("headline"), of("years_experience")["win"]["num"].alias("years_experience"),
        F.transform(good("skills"), lambda v: F.struct(v["value"].alias("name"), (v["conf"] / 1000).alias("confidence"), v["sources"].alias("sources"))).alias("skills"),
        F.transform("exp", as_experience).alias("experience"), F.transform("edu", as_education).alias("education"), provenance.alias("provenance"),
        F.array().cast("array<string>").alias("possible_duplicate_of"), all_confs.alias("__c"),
    )
    mean = F.aggregate("__c", F.lit(0), lambda a, c: a + c) / F.size("__c")
    return out.withColumn("overall_confidence", F.when(F.size("__c") > 0, F.round(mean / 1000, 3)).otherwise(0.0)).drop("__c")


def provenance_rows(records: DataFrame, as_of: Column | None = None, default_region: str = "US") -> DataFrame:
    """The log as a long table, a row per proposal: entity, rec_pos, idx (its order) and the columns of a provenance entry.

    Nothing is gathered, so an entity of any number of records has its log in as many tasks; a country that cannot be read
    is logged once.
    """
    p = proposals(records, F.current_date() if as_of is None else as_of, default_region).filter("field <> ''")
    return p.select("entity", "rec_pos", "idx", "field", "source_id", "source_type", "method", F.col("json").alias("value"), (F.col("conf") / 1000).alias("confidence"), "note")


def _flagged(merged: DataFrame, listed: DataFrame) -> DataFrame:
    """``merged`` with the lists of ``listed`` (entity, __dup) as possible duplicates, and one provenance row each."""
    row = F.struct(
        F.lit("possible_duplicate_of").alias("field"), F.lit(None).cast("string").alias("source_id"), F.lit("system").alias("source_type"), F.lit("fuzzy_name_company_match").alias("method"),
        json_text(F.col("__dup")).alias("value"), F.lit(0.4).alias("confidence"), F.lit("matched_via: fuzzy_name_company").alias("note"),
    )
    found = merged.join(listed, "entity", "left")
    return found.withColumns({
        "possible_duplicate_of": F.coalesce("__dup", "possible_duplicate_of"), "provenance": F.when(F.col("__dup").isNotNull(), F.concat("provenance", F.array(row))).otherwise(F.col("provenance")),
    }).drop("__dup")


def flag_duplicates(merged: DataFrame, assigned: DataFrame, flags: DataFrame) -> DataFrame:
    """Lift flagged record pairs to entities: possible_duplicate_of and one provenance row each."""
    at = lambda c: assigned.withColumnsRenamed({"rec_pos": c, "entity": f"e{c}"})
    pairs = flags.join(at("a"), "a").join(at("b"), "b").filter("ea <> eb").select("ea", "eb")
    both = pairs.union(pairs.select("eb", "ea")).distinct()
    names = merged.select(F.col("entity").alias("eb"), "candidate_id")
    return _flagged(merged, both.join(names, "eb").groupBy("ea").agg(F.array_sort(F.collect_set("candidate_id")).alias("__dup")).withColumnRenamed("ea", "entity"))


def flag_groups(merged: DataFrame, groups: DataFrame) -> DataFrame:
    """Expand groups of possible duplicates (``match.duplicate_groups``) to a list per entity: the ids of a group are gathered once
    and go to its members as one list. The lists are what is long, m ids for each of m members; nothing else is."""
    named = written(groups.join(merged.select("entity", "candidate_id"), "entity"), "group-members")
    ids = written(named.groupBy("name", "company").agg(F.collect_list("candidate_id").alias("ids")), "group-ids")
    lists = named.join(ids, ["name", "company"]).groupBy("entity", "candidate_id").agg(F.flatten(F.collect_list("ids")).alias("ids"))
    return _flagged(merged, lists.select("entity", F.array_sort(F.array_remove(F.array_distinct("ids"), F.col("candidate_id"))).alias("__dup")))
