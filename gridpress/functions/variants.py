"""Kinds and members of JSON values held as VARIANT."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

OBJECT, ARRAY = "map<string,variant>", "array<variant>"


def is_object(t: Column, v: Column) -> Column:
    """Whether a member is an object; its text ``t`` settles most cases."""
    return F.coalesce(t.startswith("{") & F.schema_of_variant(v).startswith("OBJECT"), F.lit(False))


def is_array(t: Column, v: Column) -> Column:
    """Whether a member is an array; its text ``t`` settles most cases."""
    return F.coalesce(t.startswith("[") & F.schema_of_variant(v).startswith("ARRAY"), F.lit(False))


def kind(v: Column) -> Column:
    """``object, array, string, boolean, null`` or ``number``; null when absent."""
    schema = F.schema_of_variant(v)
    return (
        F.when(v.isNull(), F.lit(None))
        .when(schema.startswith("OBJECT"), F.lit("object"))
        .when(schema.startswith("ARRAY"), F.lit("array"))
        .when(schema == "STRING", F.lit("string"))
        .when(schema == "BOOLEAN", F.lit("boolean"))
        .when(schema == "VOID", F.lit("null"))
        .otherwise(F.lit("number"))
    )


def member(v: Column, key: Column) -> Column:
    """Own member of an object by name; null when there is none."""
    quote = F.when(key.contains('"'), F.lit("'")).otherwise(F.lit('"'))
    return F.try_variant_get(v, F.concat(F.lit("$["), quote, key, quote, F.lit("]")), "variant")
