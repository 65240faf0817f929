"""Validation of descriptors against the fields of their plugin, held as a table of rules."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gridweave.operators._joins import broadcast_if_small
from gridweave.operators.catalog import no_clash

#: Plugin of a descriptor that names none.
DEFAULT_PLUGIN = "QueryBasedPlugin"

# The spellings that a boolean field accepts beside true and false.
TRUE_WORDS = ["true", "t", "yes", "y", "on", "1"]
FALSE_WORDS = ["false", "f", "no", "n", "off", "0"]


def _kind(v: Column) -> Column:
    """Name of the JSON kind of a variant: STRING, BIGINT, DECIMAL, DOUBLE, BOOLEAN, VOID, ARRAY, OBJECT."""
    return F.regexp_extract(F.schema_of_variant(v), "^[A-Z]+", 0)


def _text(v: Column) -> Column:
    return F.try_variant_get(v, "$", "string")


def _items(v: Column) -> Column:
    return F.try_variant_get(v, "$", "array<variant>")


def _values(v: Column) -> Column:
    return F.map_values(F.try_variant_get(v, "$", "map<string,variant>"))


def _is_str(v: Column) -> Column:
    return _kind(v) == "STRING"


def _is_float(v: Column) -> Column:
    return _kind(v).isin("BIGINT", "DECIMAL", "DOUBLE", "FLOAT", "BOOLEAN") | (
        _is_str(v) & F.trim(_text(v)).try_cast("double").isNotNull())


def _is_int(v: Column) -> Column:
    number = F.trim(_text(v)).try_cast("decimal(38,9)")
    whole = F.coalesce(number == F.floor(number), F.lit(False))
    return (_kind(v) == "BOOLEAN") | (_kind(v).isin("BIGINT", "DECIMAL", "DOUBLE", "FLOAT", "STRING") & whole)


def _is_bool(v: Column) -> Column:
    return (_kind(v) == "BOOLEAN") | (
        _kind(v).isin("STRING", "BIGINT") & F.lower(_text(v)).isin(TRUE_WORDS + FALSE_WORDS))


def _is_file(v: Column) -> Column:
    def part(name):
        return F.coalesce(F.try_variant_get(v, f"$.{name}", "string"), F.lit(""))

    return (_kind(v) == "OBJECT") & (part("class") == "File") & ((part("location") != "") | (part("path") != ""))


#: Type name of a rule -> test of a value.
TYPES = {
    "any": lambda v: F.lit(True),
    "str": _is_str,
    "int": _is_int,
    "float": _is_float,
    "bool": _is_bool,
    "File": _is_file,
    "list": lambda v: _kind(v) == "ARRAY",
    "dict": lambda v: _kind(v) == "OBJECT",
    "list[str]": lambda v: (_kind(v) == "ARRAY") & F.forall(_items(v), _is_str),
    "list[int]": lambda v: (_kind(v) == "ARRAY") & F.forall(_items(v), _is_int),
    "list[File]": lambda v: (_kind(v) == "ARRAY") & F.forall(_items(v), _is_file),
    "dict[str]": lambda v: (_kind(v) == "OBJECT") & F.forall(_values(v), _is_str),
    "dict[list[str]]": lambda v: (_kind(v) == "OBJECT") & F.forall(
        _values(v), lambda x: (_kind(x) == "ARRAY") & F.forall(_items(x), _is_str)),
}


def _fits(v: Column, r: Column) -> Column:
    """Whether a value has the type of a rule, or is a JSON null that the rule allows."""
    test = F.lit(False)
    for name, is_type in TYPES.items():
        test = F.when(r["base"] == name, is_type(v)).otherwise(test)
    return F.coalesce(test, F.lit(False)) | (r["nullable"] & (_kind(v) == "VOID"))


def validate_plugin_fields(descriptors: DataFrame, rules: DataFrame, descriptor: str = "descriptor",
                           plugin: str = "hook_plugin", forbid_extra: bool = True) -> DataFrame:
    """Add ``errors`` (array of messages) and ``valid`` to ``descriptors``; one pass, no Python.

    ``descriptor`` is a JSON object as text or VARIANT.  ``rules`` holds ``plugin, field, type, required``: a type is one
    of :data:`TYPES`, with ``?`` behind it if null is allowed; a plugin without fields has one row
    with a null ``field``.  A row of ``descriptors`` is checked against the rules of its plugin (null or empty:
    :data:`DEFAULT_PLUGIN`).  Messages, in this order: the unknown plugin, or a descriptor that is no object, alone;
    otherwise a missing or badly typed field per rule by name of the field, then each field no rule names
    (left out with ``forbid_extra=False``) by name.

    Conversions are those of a lenient model: whole numbers and their text are integers, numbers and
    their text are floats, booleans count as numbers, and the usual words are booleans.  A ``File`` is
    an object of that class with a location or a path.  Repeated rules count once; a field with two
    different rules must meet both.  ``errors`` and ``valid`` among the columns of ``descriptors`` are refused,
    and so is a rule of an unknown type.  The rules of one plugin are one row (its fields); that table is broadcast if
    it measures small, and joined otherwise.
    """
    no_clash(descriptors, ["errors", "valid", "_rules", "_fields", "_plugin"])
    base = F.regexp_replace("type", r"\?$", "")
    odd = rules.where(F.col("field").isNotNull() & ~F.coalesce(base.isin(list(TYPES)), F.lit(False))).select("type").first()
    if odd:
        raise ValueError(f"unknown field type: {odd[0]!r}")
    rule = F.struct(F.col("field").alias("field"), F.col("type").alias("type"),
                    F.coalesce("required", F.lit(False)).alias("required"), base.alias("base"),
                    F.col("type").endswith("?").alias("nullable"))
    per_plugin = rules.where(F.col("plugin").isNotNull()).groupBy(F.col("plugin").alias("_key")).agg(
        F.array_sort(F.collect_set(F.when(F.col("field").isNotNull(), rule))).alias("_rules"))
    own = F.when(F.coalesce(plugin, F.lit("")) == "", F.lit(DEFAULT_PLUGIN)).otherwise(F.col(plugin))
    given = F.col(descriptor) if descriptors.schema[descriptor].dataType.typeName() == "variant" else (
        F.try_parse_json(descriptor))
    rows = descriptors.withColumn("_plugin", own).withColumn(
        "_fields", F.try_variant_get(given, "$", "map<string,variant>"))
    rows = rows.join(broadcast_if_small(per_plugin), F.col("_plugin") == F.col("_key"), "left")

    names = F.map_keys("_fields")

    def message(r):
        value = F.col("_fields")[r["field"]]
        there = F.array_contains(names, r["field"])
        return (F.when(~there & r["required"], F.concat(F.lit("missing field: "), r["field"]))
                 .when(there & ~_fits(value, r),
                       F.concat(F.lit("wrong type for "), r["field"], F.lit(": not "), r["type"])))

    found = F.filter(F.transform("_rules", message), lambda m: m.isNotNull())
    if forbid_extra:
        extra = F.array_sort(F.array_except(names, F.transform("_rules", lambda r: r["field"])))
        found = F.concat(found, F.transform(extra, lambda n: F.concat(F.lit("unexpected field: "), n)))
    errors = (F.when(F.col("_rules").isNull(), F.array(F.concat(F.lit("Unknown execution hooks plugin: "), F.col("_plugin"))))
               .when(F.col("_fields").isNull(), F.array(F.lit("descriptor is not a JSON object")))
               .otherwise(found))
    return (rows.withColumn("errors", errors).withColumn("valid", F.size("errors") == 0)
                .drop("_key", "_rules", "_fields", "_plugin"))
