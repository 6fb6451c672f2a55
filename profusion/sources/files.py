"""File sources: a folder of CSV exports, JSON exports, resumes and notes becomes source records.

All reading goes through Spark's sources, so any store Spark reads will do. CSV and JSON files of any size are cut in many
tasks (``splits``); documents and notes are read whole. Detection and parsing are Column expressions; Python workers only see what
needs them: CSV dialects, cuts, DOCX and PDF.

A file or item that cannot be read gives no record and never fails the run. Parsers give rows that are records or errors;
``read_folder`` writes them once and parts them, so the table of errors (file, item, source_type, reason) costs no second parse.
Files can also be rows of a table (file, content, text); then each is parsed by one task.
"""

from __future__ import annotations

import csv
import io
import sys
import zipfile
from collections.abc import Iterator
from dataclasses import dataclass
from xml.etree import ElementTree

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import Window

from profusion.functions import textparse as X
from profusion.functions.text import first_filled, number, strip
from profusion.schema import EDUCATION, EXPERIENCE, LINKS, LOCATION
from profusion.session import written
from profusion.sources import splits
from profusion.sources.pdftext import pdf_text

csv.field_size_limit(sys.maxsize)

#: A source record with its place: file and item.
RECORD = (
    f"file string, item long, source_id string, source_type string, method string, full_name string, emails array<string>, phones array<string>, location {LOCATION}, links {LINKS}, "
    f"headline string, years_experience double, skills array<string>, experience array<{EXPERIENCE}>, education array<{EDUCATION}>"
)
#: The columns of CSV exports that are read, by preference.
CSV_COLUMNS = {
    "full_name": ["name", "full_name", "candidate_name"],
    "email": ["email", "email_address"],
    "phone": ["phone", "telephone", "phone_number"],
    "company": ["current_company", "company"],
    "title": ["title", "current_title", "job_title"],
    "years": ["years_experience", "experience_years"],
}
NOTE_HEADS = ["recruiter notes", "candidate notes", "notes on candidate"]
CSV_COLUMN_NAMES = [c for columns in CSV_COLUMNS.values() for c in columns]
#: File names by how they are read.
CSV_NAMES, JSON_NAMES, WHOLE_NAMES = "*.[cC][sS][vV]", "*.[jJ][sS][oO][nN]", "*.{[tT][xX][tT],[pP][dD][fF],[dD][oO][cC][xX]}"
#: Documents and notes of more bytes are not read, and JSON texts of more are not parsed as one value.
WHOLE_BYTES, VARIANT_BYTES = 1 << 30, 100 << 20


def _names(spark: SparkSession, folder: str, pattern: str = "*") -> DataFrame:
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "false").option("pathGlobFilter", pattern).load(folder)
    return files.withColumn("file", F.col("_metadata.file_name"))


def scan(spark: SparkSession, folder: str, pattern: str = "*") -> DataFrame:
    """The files of a folder, not of folders below it: file, content, text (UTF-8, invalid bytes dropped)."""
    return _names(spark, folder, pattern).filter(F.col("length") <= WHOLE_BYTES).select("file", "content", splits.valid_text(F.col("content").cast("string")).alias("text"))


def is_json(text: Column) -> Column:
    """Whether a text is JSON; of one that no value can hold, whether its list or object can be read through."""
    long = F.coalesce(F.json_array_length(text), F.size(F.json_object_keys(text))).isNotNull()
    return F.when(F.octet_length(text) <= VARIANT_BYTES, F.try_parse_json(text).isNotNull()).otherwise(long)


def source_type(name: Column, text: Column) -> Column:
    """recruiter_csv, ats_json, resume or recruiter_notes; null if the file is of no known kind."""
    low = F.lower(name)
    head = F.lower(F.substring(text, 1, 1000))
    noted = F.contains(low, F.lit("notes")) | F.contains(low, F.lit("recruiter"))
    for phrase in NOTE_HEADS:
        noted = noted | F.contains(head, F.lit(phrase))
    return (
        F.when(low.endswith(".csv"), "recruiter_csv")
        .when(low.endswith(".json") & is_json(text), "ats_json")
        .when(low.endswith(".pdf") | low.endswith(".docx"), "resume")
        .when(low.endswith(".txt"), F.when(noted, "recruiter_notes").otherwise("resume"))
    )


def detect(files: DataFrame) -> DataFrame:
    return files.withColumn("source_type", source_type(F.col("file"), F.col("text")))


def _complete(df: DataFrame) -> DataFrame:
    """All columns of RECORD in order, and ``reason``; those ``df`` lacks are null. Rows with a reason are errors."""
    out = []
    for name, kind in [*RECORD_FIELDS, ("reason", "string")]:
        out.append(F.col(name).cast(kind).alias(name) if name in df.columns else F.lit(None).cast(kind).alias(name))
    return df.select(*out)


def _records(found: DataFrame) -> DataFrame:
    return found.filter("reason is null").drop("reason")


def _fields() -> list[tuple[str, str]]:
    fields, depth, at = [], 0, 0
    for i, c in enumerate(RECORD + ","):
        depth += (c == "<") - (c == ">")
        if c == "," and not depth:
            name, _, kind = RECORD[at:i].strip().partition(" ")
            fields.append((name, kind))
            at = i + 1
    return fields


RECORD_FIELDS = _fields()


def _role(company: Column, title: Column, summary: Column) -> Column:
    entry = F.struct(company.alias("company"), title.alias("title"), F.lit(None).cast("string").alias("start"), F.lit(None).cast("string").alias("end"), summary.cast("string").alias("summary"))
    return F.when(first_filled(company, title).isNotNull(), F.array(entry)).otherwise(F.array().cast(f"array<{EXPERIENCE}>"))


def _one(c: Column) -> Column:
    """A list of the stripped text, empty if that is blank."""
    return F.when(strip(F.coalesce(c, F.lit(""))) != "", F.array(strip(c))).otherwise(F.array().cast("array<string>"))


def _csv_rows(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for files in batches:
        for name, text in zip(files["file"], files["text"], strict=True):
            rows = [[name, i, *(row.get(c) for c in CSV_COLUMN_NAMES), None] for i, row in enumerate(csv.DictReader(io.StringIO(text, newline="")))]
            yield pd.DataFrame(rows, columns=["file", "item", *CSV_COLUMN_NAMES, "reason"])


def recruiter_csv(files: DataFrame) -> DataFrame:
    """Records of CSV files that are rows (file, text)."""
    ddl = "file string, item long, " + ", ".join(f"`{c}` string" for c in CSV_COLUMN_NAMES) + ", reason string"
    return _records(_csv_found(files.select("file", "text").mapInPandas(_csv_rows, ddl)))


def _csv_found(rows: DataFrame) -> DataFrame:
    of = {k: first_filled(*map(F.col, columns)) for k, columns in CSV_COLUMNS.items()}
    return _complete(rows.select(
        "file", "item", F.concat_ws("_row_", "file", F.col("item").cast("string")).alias("source_id"), F.lit("recruiter_csv").alias("source_type"), F.lit("direct_field").alias("method"),
        strip(of["full_name"]).alias("full_name"), _one(of["email"]).alias("emails"), _one(of["phone"]).alias("phones"), number(of["years"]).alias("years_experience"),
        _role(of["company"], of["title"], F.lit("Current role from Recruiter CSV")).alias("experience"), F.array().cast("array<string>").alias("skills"), "reason",
    ))


#: The fields of an item that are read, first those that can make it impossible.
JUDGED_PATHS = ["years_experience", "experience", "email_address", "email", "telephone", "phone", "education"]
ITEM_PATHS = [*JUDGED_PATHS, "ats_id", "candidate_name", "full_name", "name", "location", "skills", "company_name", "company", "job_title", "title"]


def _variants(paths: list[str]) -> str:
    """The type of an item's fields, which are taken from it once, as a struct of variants."""
    return "struct<" + ",".join(f"{p}:variant" for p in paths) + ">"


def _kind_of(path: str, fields: str) -> str:
    """SQL: the kind of a field. It stands beside ``fields`` as ``kind_<path>``, found once; expressions below read both, at ``of``."""
    return f"coalesce(schema_of_variant({fields}.{path}), 'VOID')"


def _kind(path: str, of: str = "") -> str:
    return f"{of}kind_{path}"


def _text(path: str, of: str = "") -> str:
    return f"try_variant_get({of}fields.{path}, '$', 'string')"


def _part(path: str, entry: str) -> str:
    return f"try_variant_get({entry}, '$.{path}', 'string')"


def _filled(path: str, of: str = "") -> str:
    """SQL: the field is neither missing, null, '', 0, false nor empty."""
    k, v = _kind(path, of), f"{of}fields.{path}"
    return f"""(CASE WHEN {k} = 'VOID' THEN false WHEN {k} = 'STRING' THEN {_text(path, of)} <> '' WHEN {k} = 'BOOLEAN' THEN try_variant_get({v}, '$', 'boolean')
        WHEN {k} LIKE 'ARRAY%' THEN size(try_variant_get({v}, '$', 'array<variant>')) > 0 WHEN {k} LIKE 'OBJECT%' THEN {k} <> 'OBJECT<>' ELSE try_variant_get({v}, '$', 'double') <> 0 END)"""


def _first(*paths: str) -> Column:
    return F.expr("coalesce(" + ", ".join(f"CASE WHEN {_filled(p)} THEN {_text(p)} END" for p in paths) + ")")


def ats_json(files: DataFrame) -> DataFrame:
    """Records of JSON files that are rows (file, text). An item of impossible form drops itself and the items after it in its file."""
    listed = lambda kind: f"coalesce(try_variant_get(v, '$', 'array<{kind}>'), array(try_variant_get(v, '$', '{kind}')))"
    parsed = files.select("file", F.try_parse_json("text").alias("v"))
    judged = ", ".join(f"'kind_{p}', {_kind_of(p, 'i')}" for p in JUDGED_PATHS)
    judged = F.expr(f"transform({listed(_variants(JUDGED_PATHS))}, i -> named_struct('fields', i, {judged}))")
    many = parsed.select("file", judged.alias("judged"), F.expr(listed("variant")).alias("many"))
    first = F.expr(f"array_min(transform(judged, (x, at) -> CASE WHEN {_impossible('x.')} IS NOT NULL THEN at END))")
    # Found once a file, below the explosion; "outer", or Spark infers a filter of empty lists that parses each text again.
    many = many.select("file", "many", first.alias("first_bad"))
    items = many.select("file", "first_bad", F.posexplode_outer("many").alias("item_no", "item")).filter("item_no < coalesce(first_bad, 2147483647)")
    return _items_read(_with_fields(items.select("file", F.col("item_no").cast("long").alias("item_no"), "item", F.lit(None).cast("string").alias("why")))).drop("reason")


def _impossible(of: str = "") -> str:
    """SQL: why an item cannot be read, null if it can."""
    # float() of a list or object; strip() of what is no string; int() of a list or object.
    kind, filled = lambda p: _kind(p, of), lambda p: _filled(p, of)
    years = f"NOT {filled('years_experience')} AND ({kind('experience')} LIKE 'ARRAY%' OR {kind('experience')} LIKE 'OBJECT%') OR {kind('years_experience')} LIKE 'OBJECT<_%' OR ({kind('years_experience')} LIKE 'ARRAY%' AND {filled('years_experience')})"
    no_text = lambda a, b: f"CASE WHEN {filled(a)} THEN {kind(a)} <> 'STRING' WHEN {filled(b)} THEN {kind(b)} <> 'STRING' ELSE false END"
    ends = f"{kind('education')} LIKE 'ARRAY%' AND exists(try_variant_get({of}fields.education, '$', 'array<variant>'), e -> coalesce(schema_of_variant(try_variant_get(e, '$.end_year', 'variant')), '') RLIKE '^(OBJECT<.|ARRAY<[^V])')"
    return f"""(CASE WHEN {of}fields IS NULL THEN 'the item is no object' WHEN {years} THEN 'years of experience are a list or object'
        WHEN {no_text('email_address', 'email')} THEN 'the e-mail is no text' WHEN {no_text('telephone', 'phone')} THEN 'the phone is no text' WHEN {ends} THEN 'an end year is a list or object' END)"""


def _ats_found(items: DataFrame) -> DataFrame:
    """Records and errors of items (file, item_no, item, reason); those after a file's first impossible item are errors.

    The items of a file may be in many rows (a written table); its first impossible one is an aggregate.
    """
    items, bad = _with_fields(items), F.expr(_impossible())
    # No filter of rows: it would go below the fields and find them again for each use.
    first = items.groupBy("file").agg(F.min(F.when(F.col("reason").isNull() & bad.isNotNull(), F.col("item_no"))).alias("first_bad"))
    why = F.coalesce("reason", F.when(F.col("item_no") == F.col("first_bad"), bad), F.when(F.col("item_no") > F.col("first_bad"), "it follows an item that cannot be read"))
    return _items_read(items.join(first, "file", "left").withColumn("why", why))


def _with_fields(items: DataFrame) -> DataFrame:
    found = items.withColumn("fields", F.expr(f"try_variant_get(item, '$', '{_variants(ITEM_PATHS)}')"))
    return found.withColumns({f"kind_{p}": F.expr(_kind_of(p, "fields")) for p in ITEM_PATHS})


def _items_read(good: DataFrame) -> DataFrame:
    """Records of items with their fields; ``why`` is the reason of those that are errors."""
    place = F.transform(F.split(F.expr(_text("location")), ","), strip)
    at = lambda i: F.get(place, F.lit(i))
    location = F.when(F.expr(f"{_kind('location')} LIKE 'OBJECT%'"), F.struct(*(F.expr(_part(x, "fields.location")).alias(x) for x in ("city", "region", "country")))).when(
        F.expr(f"{_kind('location')} = 'STRING'"),
        F.struct(at(0).alias("city"), F.when(F.size(place) == 3, at(1)).alias("region"), F.when(F.size(place) == 3, at(2)).when(F.size(place) == 2, at(1)).alias("country")),
    )
    listed = F.filter(F.transform(F.split(F.expr(_text("skills")), ","), strip), lambda x: x != "")
    skills = F.when(F.expr(f"{_kind('skills')} = 'STRING'"), listed).otherwise(F.coalesce(F.expr("try_variant_get(fields.skills, '$', 'array<string>')"), F.array().cast("array<string>")))
    objects = lambda path: f"filter(try_variant_get(fields.{path}, '$', 'array<variant>'), e -> coalesce(schema_of_variant(e), '') LIKE 'OBJECT%')"
    entries = F.expr(f"transform({objects('experience')}, e -> named_struct(" + ", ".join(f"'{x}', {_part(x, 'e')}" for x in ("company", "title", "start", "end", "summary")) + "))")
    education = F.expr(
        f"transform({objects('education')}, e -> named_struct(" + ", ".join(f"'{x}', {_part(x, 'e')}" for x in ("institution", "degree", "field"))
        + f", 'end_year', CASE WHEN trim({_part('end_year', 'e')}) RLIKE '^[+-]?[0-9]+$' THEN nullif(try_cast(trim({_part('end_year', 'e')}) AS INT), 0) END))"
    )
    company, title = _first("company_name", "company"), _first("job_title", "title")
    return _complete(good.select(
        "file", F.col("item_no").alias("item"), F.concat(F.col("file"), F.lit("_ats_"), F.coalesce(_first("ats_id"), F.concat(F.lit("index_"), F.col("item_no").cast("string")))).alias("source_id"),
        F.lit("ats_json").alias("source_type"), F.lit("direct_field").alias("method"), strip(_first("candidate_name", "full_name", "name")).alias("full_name"),
        _one(_first("email_address", "email")).alias("emails"), _one(_first("telephone", "phone")).alias("phones"), location.alias("location"), skills.alias("skills"),
        number(_first("years_experience", "experience")).alias("years_experience"),
        F.when(F.expr(f"{_kind('experience')} LIKE 'ARRAY%'"), entries).otherwise(_role(company, title, F.lit(None))).alias("experience"),
        F.coalesce(education, F.array().cast(f"array<{EDUCATION}>")).alias("education"), F.col("why").alias("reason"),
    ))


def docx_text(content: bytes) -> str | None:
    """Paragraphs outside tables, then one line per table row; null if the file is damaged."""
    w = "{http://schemas.openxmlformats.org/wordprocessingml/2006/main}"
    words = lambda node: "".join(t.text or "" for t in node.iter(f"{w}t"))
    try:
        with zipfile.ZipFile(io.BytesIO(content)) as z:
            body = ElementTree.fromstring(z.read("word/document.xml")).find(f"{w}body")
        out = [words(p) for p in body.findall(f"{w}p")]
        for table in body.findall(f"{w}tbl"):
            out += [" ".join("\n".join(words(p) for p in cell.iter(f"{w}p")) for cell in row.findall(f"{w}tc")) for row in table.findall(f"{w}tr")]
        return "".join(f"{line}\n" for line in out)
    except Exception:  # noqa: BLE001  whatever a damaged archive or document makes the parsers raise
        return None


def _document_texts(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for files in batches:
        texts = [docx_text(c) if n.lower().endswith(".docx") else pdf_text(c) for n, c in zip(files["file"], files["content"], strict=True)]
        yield pd.DataFrame({"file": files["file"], "text": texts})


def _resumes_found(files: DataFrame, strict_dates: bool = False) -> DataFrame:
    binary = F.lower("file").rlike(r"\.(pdf|docx)$")
    texts = files.filter(~binary).select("file", "text").union(files.filter(binary).select("file", "content").mapInPandas(_document_texts, "file string, text string"))
    reason = F.when(F.col("text").isNull(), "a damaged document, or one that cannot be read").when(strip(F.col("text")) == "", "no text")
    return _complete(texts.select("file", F.lit(0).alias("item"), F.col("file").alias("source_id"), F.lit("resume").alias("source_type"), F.lit("regex_extract").alias("method"), *X.resume(F.col("text"), strict_dates), reason.alias("reason")))


def resumes(files: DataFrame, strict_dates: bool = False) -> DataFrame:
    return _records(_resumes_found(files, strict_dates))


def recruiter_notes(files: DataFrame) -> DataFrame:
    keyed = files.select("file", "text", X.keyed_lines(F.col("text")).alias("keyed"))
    return _complete(keyed.select("file", F.lit(0).alias("item"), F.col("file").alias("source_id"), F.lit("recruiter_notes").alias("source_type"), F.lit("heuristic_parse").alias("method"), *X.notes(F.col("text"), F.col("keyed")))).drop("reason")


@dataclass(frozen=True)
class Found:
    """What a folder holds: records (rec_pos follows file name and place in the file), and errors (file, item, source_type, reason)."""

    records: DataFrame
    errors: DataFrame


def read_folder(spark: SparkSession, folder: str, strict_dates: bool = False) -> Found:
    """All source records of a folder, and why files and items gave none. Everything is parsed once.

    Files without a byte are not seen by Spark's sources: they give neither.
    """
    names = _names(spark, folder).select("file", "length")
    low = F.lower("file")
    csvs, jsons = low.endswith(".csv"), low.endswith(".json")
    whole = low.endswith(".txt") | low.endswith(".pdf") | low.endswith(".docx")
    texts = scan(spark, folder, WHOLE_NAMES).withColumn("source_type", source_type(F.col("file"), F.col("text")))
    of = lambda kind: texts.filter(F.col("source_type") == kind)
    parts = [_resumes_found(of("resume"), strict_dates), _complete(recruiter_notes(of("recruiter_notes")))]
    if not names.filter(csvs).isEmpty():
        parts.append(_csv_found(splits.csv_rows(splits.pieces(spark, folder, CSV_NAMES, splits.Csv.separator), CSV_COLUMN_NAMES)))
    if not names.filter(jsons).isEmpty():
        parts.append(_ats_found(splits.json_items(splits.pieces(spark, folder, JSON_NAMES, splits.Json.separator))))
    reason = F.when(~(csvs | jsons | whole), "no known kind of file").when(whole & (F.col("length") > WHOLE_BYTES), "too long for a document")
    parts.append(_complete(names.select("file", reason.alias("reason")).filter("reason is not null")))
    found = parts[0]
    for part in parts[1:]:
        found = found.unionByName(part)
    found = written(found, "found")
    return Found(positioned(_records(found), names.select("file", F.lit("").alias("source_type"))), found.filter("reason is not null").select("file", "item", "source_type", "reason"))


def read_records(spark: SparkSession, folder: str, strict_dates: bool = False) -> DataFrame:
    """All source records of a folder; rec_pos follows file name and place in the file."""
    return read_folder(spark, folder, strict_dates).records


def read_files(files: DataFrame, strict_dates: bool = False) -> DataFrame:
    """All source records of detected files that are rows (file, content, text, source_type)."""
    of = lambda kind: files.filter(F.col("source_type") == kind)
    found = recruiter_csv(of("recruiter_csv")).unionByName(ats_json(of("ats_json"))).unionByName(resumes(of("resume"), strict_dates)).unionByName(recruiter_notes(of("recruiter_notes")))
    return positioned(found, files)


def positioned(found: DataFrame, files: DataFrame) -> DataFrame:
    """rec_pos: the files in name order, each file's items in order, without a global sort of records.

    The upper bits number the files, the lower 32 the items. The file names alone are sorted, over all tasks: each
    partition of the sorted names is numbered by itself and begins after those before it. No parser runs for that.
    """
    names = written(files.filter("source_type is not null").select("file").distinct().repartitionByRange("file").sortWithinPartitions("file").withColumns({"part": F.spark_partition_id(), "at": F.monotonically_increasing_id().bitwiseAND(F.lit((1 << 33) - 1))}), "file-names")
    sizes = names.groupBy("part").agg(F.count("*").alias("n"))  # a row for each partition
    before = sizes.select("part", F.coalesce(F.sum("n").over(Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("before"))
    numbered = names.join(F.broadcast(before), "part").select("file", (F.col("before") + F.col("at") + 1).alias("file_no"))
    return found.join(numbered, "file").withColumn("rec_pos", F.col("file_no") * F.lit(1 << 32) + F.col("item")).drop("file_no", "file", "item")
