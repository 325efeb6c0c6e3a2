"""Turns an output config into one select over canonical profiles: paths to columns, types to casts, a tree of paths to structs."""

from __future__ import annotations

import json

import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from kindred.functions.scalars import e164, month
from kindred.functions.text import let
from kindred.plans.config import DEFAULT, KindredError, OutputConfig, OutputField

#: Named normalizers that a field can ask for; `canonical` is the taxonomy's exact name.
EMAIL = r"^[A-Za-z0-9_'+.-]*[A-Za-z0-9_+-]@([A-Za-z0-9][A-Za-z0-9-]*\.)+[A-Za-z]{2,}$"


def exact_skill(c: Column) -> Column:
    """The taxonomy's name for a skill that is in it whatever its case, else the trimmed text."""
    from kindred.functions.fuzzy import TAXONOMY

    out = F.trim(c)
    for known in TAXONOMY:
        out = F.when(F.lower(F.trim(c)) == known.lower(), known).otherwise(out)
    return out


HOOKS = {"E164": e164, "YYYY-MM": month, "canonical": exact_skill}


def path_column(path: str, schema: T.DataType) -> tuple[Column | None, T.DataType]:
    """The column at a path such as a.b[0].c and its type; no column if there is no such place. `length` of a list or text is its length."""
    parts = [p for p in re.sub(r"\[(\d+)\]", r".\1", path).split(".") if p]
    col, kind = None, schema
    for p in parts:
        if isinstance(kind, T.StructType) and p in kind.names:
            col, kind = (F.col(f"`{p}`") if col is None else col[p]), kind[p].dataType
        elif isinstance(kind, T.ArrayType) and p.isdigit():
            col, kind = F.get(col, F.lit(int(p))), kind.elementType
        elif p == "length" and isinstance(kind, T.ArrayType):
            col, kind = F.size(col), T.IntegerType()
        elif p == "length" and isinstance(kind, T.StringType):
            col, kind = F.length(col), T.IntegerType()
        else:
            return None, T.StringType()
    return col, kind


def as_text(c: Column, kind: T.DataType) -> Column:
    if isinstance(kind, T.StructType):
        return F.to_json(c)
    if isinstance(kind, T.ArrayType):
        return F.array_join(F.transform(c, lambda x: as_text(x, kind.elementType)), ",")
    if isinstance(kind, (T.DoubleType, T.FloatType)):  # whole numbers without a point
        return F.when(c == F.floor(c), F.floor(c).cast("string")).otherwise(c.cast("string"))
    return c.cast("string")


def coerced(c: Column, kind: T.DataType, to: str) -> Column:
    """c as the declared type: numbers that aren't are null, a flag is whether there is something, a lone value becomes a list."""
    text = as_text(c, kind)
    if to == "string":
        return text
    if to == "number":
        return c.cast("double") if isinstance(kind, T.NumericType) else F.when(F.trim(text) == "", 0.0).otherwise(F.trim(text).try_cast("double"))
    if to == "boolean":
        if isinstance(kind, T.StringType):
            return c != ""
        if isinstance(kind, T.NumericType):
            return (c != 0) & ~F.isnan(c.cast("double"))
        return F.when(c.isNotNull(), True)
    if to == "string[]":
        return F.transform(c, lambda x: as_text(x, kind.elementType)) if isinstance(kind, T.ArrayType) else F.when(c.isNotNull(), F.array(text))
    return c


def value(f: OutputField, schema: T.StructType) -> Column:
    col, kind = path_column(f.source, schema)
    if col is None:
        return F.lit(None).cast({"number": "double", "boolean": "boolean", "string[]": "array<string>"}.get(f.type, "string"))
    if f.normalize:
        hook = HOOKS[f.normalize](as_text(col, kind))
        # What a normalizer finds no value in is missing, not a text.
        return coerced(F.when(col.isNotNull(), hook), T.StringType(), f.type)
    return coerced(col, kind, f.type)


def without(c: Column, kind: T.DataType, name: str) -> Column:
    """c without fields of that name, at any depth."""
    if isinstance(kind, T.ArrayType):
        return F.transform(c, lambda x: without(x, kind.elementType, name)) if _holds(kind, name) else c
    if isinstance(kind, T.StructType) and _holds(kind, name):
        return F.when(c.isNotNull(), F.struct(*[without(c[f.name], f.dataType, name).alias(f.name) for f in kind if f.name != name]))
    return c


def _holds(kind: T.DataType, name: str) -> bool:
    if isinstance(kind, T.ArrayType):
        return _holds(kind.elementType, name)
    return isinstance(kind, T.StructType) and any(f.name == name or _holds(f.dataType, name) for f in kind)


def _tree(columns: dict[str, Column], prefix: str = "") -> list[Column]:
    """Columns by dotted path as structs of structs."""
    out: dict[str, dict[str, Column]] = {}
    for path, c in columns.items():
        head, _, rest = path.partition(".")
        out.setdefault(head, {})[rest] = c
    return [(part[""] if "" in part else F.struct(*_tree(part))).alias(head) for head, part in out.items()]


def projected(profiles: DataFrame, config: OutputConfig = DEFAULT, keep: tuple[str, ...] = ()) -> DataFrame:
    """profiles in the config's shape, with `warnings` (an array of texts) and the columns to keep.

    A required field without a value gives a warning. With on_missing `error` such a profile is refused: see `refused`. With
    `omit`, write the result with `as_json`, which leaves out what is null.
    """
    if config.fields is None:
        return profiles.withColumn("warnings", F.array(F.lit("Invalid config fields: defaulting to canonical profile")))
    schema = profiles.schema
    values = {f.path: value(f, schema) for f in config.fields}
    if not config.include_confidence:
        for f in config.fields:
            col, kind = path_column(f.source, schema)
            if f.type == "object" and col is not None:
                values[f.path] = without(values[f.path], kind, "confidence")
    names = [f for f in config.fields if f.required]
    # A required field whose value is null gives one warning each.
    warn = F.array_compact(F.array(*[F.when(value(f, schema).isNull(), F.lit(f"Required field '{f.path}' is missing")) for f in names])) if names else F.array().cast("array<string>")
    columns = _tree(values)
    if config.include_confidence:
        columns.append(F.col("overall_confidence"))
    if config.include_provenance:
        columns.append(F.col("provenance"))
    return profiles.select(*[F.col(k) for k in keep], *columns, warn.alias("warnings"))


def accepted(out: DataFrame) -> DataFrame:
    """What of a projection passes: no required field is missing and, where `shape.with_faults` has judged it, nothing is against its schema."""
    good = F.size("warnings") == 0
    return out.where(good & (F.size("faults") == 0) if "faults" in out.columns else good)


def refused(out: DataFrame) -> DataFrame:
    return out.where(F.size("warnings") > 0)


def checked(out: DataFrame, config: OutputConfig) -> DataFrame:
    """With on_missing `error`, raises VALIDATION_ERROR for the first profile that lacks a required field."""
    if config.on_missing == "error":
        first = refused(out).select("warnings").first()
        if first:
            raise KindredError("VALIDATION_ERROR", "; ".join(first.warnings), 422, list(first.warnings))
    return out


def _text(c: Column) -> Column:
    """The JSON of a value of any type."""
    whole = F.to_json(F.struct(c.alias("v")), {"ignoreNullFields": "false"})
    return F.substr(whole, F.lit(6), F.length(whole) - 6)


def _without_missing(c: Column, paths: list[str]) -> Column:
    """The JSON of a struct whose members at the paths are left out if they are null; what lies below a path is whole."""
    heads: dict[str, list[str]] = {}
    for p in paths:
        head, _, rest = p.partition(".")
        heads.setdefault(head, []).append(rest)
    members = []
    for head, rest in heads.items():
        own = c[head] if rest == [""] else _without_missing(c[head], rest)
        text = _text(own) if rest == [""] else F.nullif(own, F.lit("{}"))
        members.append(F.when(own.isNotNull(), F.concat(F.lit(json.dumps(head) + ":"), text)))
    return F.concat(F.lit("{"), F.array_join(F.array_compact(F.array(*members)), ","), F.lit("}"))


def json_column(columns: list[str], config: OutputConfig = DEFAULT) -> Column:
    """The JSON of a projection's row. Under `omit`, declared members without a value are left out; nulls inside a value stay."""
    body = [c for c in columns if c not in ("warnings", "faults")]
    whole = F.struct(*body)
    if config.on_missing != "omit":
        return F.to_json(whole, {"ignoreNullFields": "false"})
    declared = [f.path for f in config.fields or ()]
    rest = [c for c in body if c not in {p.partition(".")[0] for p in declared}]
    return let(whole, lambda w: _without_missing(w, declared + rest))


def as_json(out: DataFrame, config: OutputConfig = DEFAULT, name: str = "json") -> DataFrame:
    """One JSON text of each row."""
    return out.select(json_column(out.columns, config).alias(name))


def canonical_faults(profiles: DataFrame) -> DataFrame:
    """profiles with `faults`: what is against the rules of canonical profiles. Keep rows without any."""
    ok_month = lambda m: m.isNull() | m.rlike(r"^\d{4}-\d{2}$")
    url = lambda u: u.isNull() | u.rlike(r"^[A-Za-z][A-Za-z0-9+.-]*:\S+$")
    rules = {
        "candidate_id": F.col("candidate_id").isNotNull(),
        "full_name": F.col("full_name").isNotNull(),
        "emails": F.forall("emails", lambda e: e.rlike(EMAIL)),
        "location.country": F.col("location.country").isNull() | (F.length("location.country") == 2),
        "links": url(F.col("links.linkedin")) & url(F.col("links.github")) & url(F.col("links.portfolio")) & F.forall("links.other", url),
        "skills": F.forall("skills", lambda s: s["confidence"].between(0, 1)),
        "experience": F.forall("experience", lambda j: ok_month(j["start"]) & ok_month(j["end"])),
        "provenance": F.size("provenance") > 0,
        "overall_confidence": F.col("overall_confidence").between(0, 1),
    }
    return profiles.withColumn("faults", F.array_compact(F.array(*[F.when(~F.coalesce(rule, F.lit(False)), name) for name, rule in rules.items()])))
