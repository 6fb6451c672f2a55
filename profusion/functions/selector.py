"""Output configuration: a small path grammar compiled to Columns over the canonical schema."""

from __future__ import annotations

import json
import re
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from profusion.functions import normalize as N
from profusion.operators.merge import json_text

# The fields and sub-fields that paths can name, default outputs, and type and normalizer names.
BASE = [
    "candidate_id", "full_name", "emails", "phones", "location", "links", "headline", "years_experience", "skills", "experience", "education",
    "provenance", "overall_confidence", "possible_duplicate_of",
]
INDEXED = ["emails", "phones"]
LISTED = {
    "skills": ["name", "confidence", "sources"], "experience": ["company", "title", "start", "end", "summary"], "education": ["institution", "degree", "field", "end_year"],
}
NESTED = {"location": ["city", "region", "country"], "links": ["linkedin", "github", "portfolio", "other"]}
DEFAULT_TYPES = {
    "candidate_id": "string", "full_name": "string", "emails": "string[]", "phones": "string[]", "location": "object", "links": "object", "headline": "string",
    "years_experience": "number", "skills": "object[]", "experience": "object[]", "education": "object[]", "possible_duplicate_of": "string[]",
}
NORMALIZERS = {"e164": "phone", "phone": "phone", "canonical": "skill", "skill": "skill", "country": "country", "iso3166": "country"}
POLICIES = ("null", "omit", "error")


@dataclass(frozen=True)
class Path:
    """A parsed path: a field, its index, or a sub-field of the field or of each of its items."""

    base: str
    index: int | None = None
    sub: str | None = None
    each: bool = False


def parse_path(path: str) -> Path:
    """Parse and check a path such as full_name, emails[0], skills[].name or location.city."""
    if not path:
        raise ValueError("an empty path")
    if path in BASE:
        return Path(path)
    m = re.fullmatch(r"(\w+)(?:\[(\d*)\])?(?:\.(\w+))?", path)
    if m:
        base, index, sub = m.groups()
        if index and sub is None and base in INDEXED:
            return Path(base, index=int(index))
        if index == "" and sub in LISTED.get(base, []):
            return Path(base, sub=sub, each=True)
        if index is None and sub in NESTED.get(base, []):
            return Path(base, sub=sub)
    raise ValueError(f"not a path of the canonical schema: {path!r}")


def compile_path(path: Path) -> Column:
    c = F.col(path.base)
    if path.index is not None:
        return F.get(c, F.lit(path.index))
    if path.each:
        return F.coalesce(F.filter(F.transform(c, lambda x: x[path.sub]), lambda x: x.isNotNull()), F.array())
    return c[path.sub] if path.sub else c


@dataclass(frozen=True)
class OutputField:
    path: str
    type: str = "string"
    source: str = ""
    required: bool = False
    normalize: str | None = None


@dataclass(frozen=True)
class OutputConfig:
    fields: list[OutputField] = field(default_factory=list)
    include_confidence: bool = True
    include_provenance: bool = True
    on_missing: str = "null"


def needs(config: OutputConfig) -> tuple[set[str] | None, bool]:
    """The canonical fields that a configuration puts out (None: all, as the overall confidence takes all), and whether it needs the log."""
    bases = {parse_path(f.source).base for f in config.fields}
    every = config.include_confidence or "overall_confidence" in bases
    return None if every else bases, config.include_provenance or "provenance" in bases


def load_config(data: dict | str | None = None) -> OutputConfig:
    """A checked configuration from a dict or JSON text; without fields, the default ones."""
    data = json.loads(data) if isinstance(data, str) else data or {}
    fields = []
    for f in data.get("fields") or []:
        source = f.get("from") or f["path"]
        parse_path(source)
        fields.append(OutputField(f["path"], f.get("type", "string"), source, bool(f.get("required", False)), f.get("normalize")))
    policy = data.get("on_missing", "null")
    if policy not in POLICIES:
        raise ValueError(f"on_missing is {policy!r}, not one of {', '.join(POLICIES)}")
    if not fields:
        fields = [OutputField(p, t, p) for p, t in DEFAULT_TYPES.items() if p != "possible_duplicate_of"]
    return OutputConfig(fields, data.get("include_confidence", True), data.get("include_provenance", True), policy)


def command_line_default() -> OutputConfig:
    """All default fields; id and name are required."""
    return OutputConfig([OutputField(p, t, p, required=p in ("candidate_id", "full_name")) for p, t in DEFAULT_TYPES.items()])


def read_config(path: str | None) -> OutputConfig:
    """The configuration in a file; that of the command line if there is no such file."""
    import os

    if not path or not os.path.exists(path):
        return command_line_default()
    with open(path, encoding="utf-8") as f:
        return load_config(json.load(f))


def _normalized(c: Column, kind: T.DataType, name: str | None) -> tuple[Column, T.DataType]:
    """Apply a normalizer by name, to each item of a list; what cannot be normalized stays."""
    how = NORMALIZERS.get((name or "").lower())
    if how is None:
        return c, kind
    inner = kind.elementType if isinstance(kind, T.ArrayType) else kind
    if isinstance(inner, (T.StructType, T.ArrayType)):
        return c, kind

    def one(x: Column) -> Column:
        text = x.cast("string")
        got = N.skill(text) if how == "skill" else (N.phone(text) if how == "phone" else N.country(text))["value"]
        return F.when(text == "", text).otherwise(F.coalesce(got, text))

    if how != "skill" and not isinstance(inner, T.StringType):
        return c, kind
    return (F.transform(c, one), T.ArrayType(T.StringType())) if isinstance(kind, T.ArrayType) else (one(c), T.StringType())


def fits(kind: T.DataType, declared: str) -> bool:
    """Whether values of a Column's type pass the declared output type; unknown names accept all."""
    declared = declared.strip().lower()
    number = (T.NumericType, T.BooleanType)
    plain = {"string": T.StringType, "number": number, "boolean": T.BooleanType, "object": T.StructType}
    if declared in plain:
        return isinstance(kind, plain[declared])
    if declared.endswith("[]") and declared[:-2] in ("string", "number", "object"):
        return isinstance(kind, T.ArrayType) and isinstance(kind.elementType, plain[declared[:-2]])
    return True


def _missing(c: Column, kind: T.DataType) -> Column:
    if isinstance(kind, T.ArrayType):
        return F.coalesce(F.size(c) <= 0, F.lit(True)) | c.isNull()
    return c.isNull() | (c == "") if isinstance(kind, T.StringType) else c.isNull()


def project(canonical: DataFrame, config: OutputConfig) -> DataFrame:
    """The configured output columns, and ``_omitted`` (names left out of the row) under the omit policy.

    A missing required field, a missing field under the error policy and a value of another than the
    declared type fail the job as soon as such a row is computed.
    """
    out, omitted = [], []
    for f in config.fields:
        raw = compile_path(parse_path(f.source))
        kind = canonical.select(raw.alias("x")).schema["x"].dataType
        c, kind = _normalized(raw, kind, f.normalize)
        missing = _missing(c, kind)
        fail = lambda text: F.raise_error(F.lit(text)).cast(kind.simpleString())  # noqa: B023, E731
        if f.required or config.on_missing == "error":
            c = F.when(missing, fail(f"field {f.path!r} (from {f.source!r}) is missing")).otherwise(c)
        elif f.type.endswith("[]") and isinstance(kind, T.ArrayType):
            c = F.when(missing, F.array().cast(kind.simpleString())).otherwise(c)
        else:
            c = F.when(~missing, c)
        if not fits(kind, f.type):
            c = F.when(~missing, fail(f"a value of field {f.path!r} is not of type {f.type!r}")).otherwise(c)
        out.append(c.alias(f.path))
        omitted.append(F.when(missing, F.lit(f.path)))
    if config.include_confidence:
        out.append(F.col("overall_confidence"))
    if config.include_provenance:
        out.append(F.col("provenance"))
    if config.on_missing == "omit":
        out.append(F.array_compact(F.array(*omitted)).alias("_omitted"))
    return canonical.select(*out)


def _provenance_json() -> Column:
    """The log as JSON; its values are JSON already."""
    def row(p: Column) -> Column:
        parts = [F.concat(F.lit(f'"{k}":'), p[k] if k == "value" else json_text(p[k])) for k in ("field", "source_id", "source_type", "method", "value", "confidence", "note")]
        return F.concat(F.lit("{"), F.array_join(F.array(*parts), ","), F.lit("}"))

    return F.concat(F.lit("["), F.array_join(F.transform("provenance", row), ","), F.lit("]"))


def to_json_rows(projected: DataFrame) -> DataFrame:
    """One column ``value``: each row as a JSON object with explicit nulls and without its omitted names."""
    omits = "_omitted" in projected.columns
    parts = []
    for f in projected.schema.fields:
        if f.name == "_omitted":
            continue
        log = f.name == "provenance" and isinstance(f.dataType, T.ArrayType) and isinstance(f.dataType.elementType, T.StructType)
        pair = F.concat(F.lit(json.dumps(f.name) + ":"), _provenance_json() if log else json_text(F.col(f"`{f.name}`")))
        parts.append(F.when(~F.array_contains("_omitted", F.lit(f.name)), pair) if omits else pair)
    return projected.select(F.concat(F.lit("{"), F.array_join(F.array_compact(F.array(*parts)), ","), F.lit("}")).alias("value"))
