"""The schema that a config declares, and what of an output is against it, by path.

A config is compiled to a StructType once; an output, be it a projection or JSON text from elsewhere, is one variant a row, and the
schema is unrolled into one expression over it. Nothing is shuffled and no Python runs in tasks.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from kindred.functions.text import let
from kindred.plans.config import DEFAULT, OutputConfig
from kindred.plans.project import json_column

FAULTS = "array<struct<path:string,fault:string>>"
MISSING = "is missing"
#: What a number may be at least and at most, by the name in a field's metadata.
LIMITS = "limits"
_LEAVES = {"string": T.StringType(), "number": T.DoubleType(), "boolean": T.BooleanType(), "string[]": T.ArrayType(T.StringType(), False), "object": T.VariantType()}
_WANTED = {"string": "a text", "double": "a number", "boolean": "a flag", "variant": "a record or a list"}


def output_schema(config: OutputConfig = DEFAULT) -> T.StructType | None:
    """The declared shape: records for paths with dots, which can't be missing; fields that aren't required may be null.

    An `object` is a variant that holds a record or a list. Without fields anything goes: None.
    """
    if config.fields is None:
        return None
    root = T.StructType()
    for f in config.fields:
        *parents, name = f.path.split(".")
        at = root
        for p in parents:
            if p not in at.names:
                at.add(p, T.StructType(), False)
            at = at[p].dataType
        at.add(name, _LEAVES[f.type], not f.required)
    if config.include_confidence and "overall_confidence" not in root.names:
        root.add("overall_confidence", T.DoubleType(), True, {LIMITS: [0, 1]})
    if config.include_provenance and "provenance" not in root.names:
        entry = T.StructType([T.StructField(n, T.StringType(), False) for n in ("field", "source", "method")])
        root.add("provenance", T.ArrayType(entry, False), True)
    return root


def _member(v: Column, name: str) -> Column:
    return F.try_variant_get(v, f"$[{_quoted(name)}]", "variant")


def _quoted(name: str) -> str:
    return f'"{name}"' if "'" in name else f"'{name}'"


def _faults(v: Column, kind: T.DataType, needed: bool, path: Column, limits: list | None = None) -> Column:
    """What of a variant is against a type: array<struct<path, fault>>. A record or list of another kind is one fault, without its members'."""
    none = F.array().cast(FAULTS)
    fault = lambda what: F.array(F.struct(path.alias("path"), F.lit(what).alias("fault")))

    def judged(told: Column) -> Column:
        if isinstance(kind, T.StructType):
            below = lambda f: F.concat(path, F.when(path != "", ".").otherwise(""), F.lit(f.name))
            own = [_faults(_member(v, f.name), f.dataType, not f.nullable, below(f), f.metadata.get(LIMITS)) for f in kind]
            right, rest, wanted = told.startswith("OBJECT"), F.concat(*own) if own else none, "a record"
        elif isinstance(kind, T.ArrayType):
            items = F.try_variant_get(v, "$", "array<variant>")
            at = lambda k: F.concat(path, F.lit("["), k.cast("string"), F.lit("]"))
            rest = F.flatten(F.transform(items, lambda x, k: _faults(x, kind.elementType, not kind.containsNull, at(k))))
            right, wanted = told.startswith("ARRAY"), "a list"
        else:
            wanted, rest = _WANTED[kind.simpleString()], none
            if isinstance(kind, T.DoubleType):
                number = F.try_variant_get(v, "$", "double")
                right = told.rlike("^(BIGINT|DECIMAL|DOUBLE|FLOAT)") & ~F.isnan(number)
                if limits:
                    rest = F.when(~number.between(*limits), fault(f"isn't from {limits[0]} to {limits[1]}")).otherwise(none)
            else:
                right = told.rlike({"string": "^STRING", "boolean": "^BOOLEAN", "variant": "^(OBJECT|ARRAY)"}[kind.simpleString()])
        return F.when(told == "VOID", fault(MISSING) if needed else none).when(~right, fault(f"isn't {wanted}")).otherwise(rest)

    return let(F.coalesce(F.schema_of_variant(v), F.lit("VOID")), judged)


def json_faults(body: Column, config: OutputConfig = DEFAULT) -> Column:
    """What of JSON texts is against the declared shape: array<struct<path, fault>>. Null, or text that is no JSON, is missing as a whole."""
    schema = output_schema(config)
    if schema is None:
        return F.array().cast(FAULTS)
    return _faults(F.try_parse_json(body), schema, True, F.lit(""))


def with_faults(out: DataFrame, config: OutputConfig = DEFAULT) -> DataFrame:
    """A projection with `faults`: texts that tell each fault's path. Under `omit` the output is judged as it is written, without what is null."""
    schema = output_schema(config)
    if schema is None:
        return out.withColumn("faults", F.array().cast("array<string>"))
    if config.on_missing == "omit":
        whole = F.parse_json(json_column(out.columns, config))
    else:
        whole = F.to_variant_object(F.struct(*[c for c in schema.names if c in out.columns]))
    return out.withColumn("faults", F.transform(_faults(whole, schema, True, F.lit("")), lambda f: F.concat(f["path"], F.lit(" "), f["fault"])))
