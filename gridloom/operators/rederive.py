"""Recorded results against their re-derivation, nested values compared leaf by leaf."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, DataType, MapType, StructType

from gridloom.operators.grades import adoption_model
from gridloom.operators.ranks import run_keys
from gridloom.operators.tokens import brand_colors

LEAF = "array<struct<path:string,value:string>>"


def leaves(value: Column, kind: DataType, path: Column) -> Column:
    """All leaves of a value as (path, value) with values as text: fields by name, elements by place, map entries by key.

    A list or map has its size as a leaf as well, so that a missing and an empty one differ; elements compare in order.
    """
    if isinstance(kind, StructType):
        parts = [leaves(value[f.name], f.dataType, F.concat(path, F.lit(f".{f.name}"))) for f in kind.fields]
        return F.concat(*parts) if parts else F.array().cast(LEAF)
    size = F.array(F.struct(F.concat(path, F.lit(".size")).alias("path"), F.when(value.isNotNull(), F.size(value)).cast("string").alias("value")))
    none = F.array().cast(LEAF)
    if isinstance(kind, ArrayType):
        each = F.transform(value, lambda x, i: leaves(x, kind.elementType, F.concat(path, F.lit("["), i.cast("string"), F.lit("]"))))
        return F.concat(size, F.coalesce(F.flatten(each), none))
    if isinstance(kind, MapType):
        each = F.transform(F.map_entries(value), lambda e: leaves(e["value"], kind.valueType, F.concat(path, F.lit("["), e["key"].cast("string"), F.lit("]"))))
        return F.concat(size, F.coalesce(F.flatten(each), none))
    return F.array(F.struct(path.alias("path"), value.cast("string").alias("value")))


def leaf_rows(df: DataFrame, keys: list[str], name: str) -> DataFrame:
    """(keys, path, name) with a row for each leaf of the other columns, and one, of an empty path, for the row itself."""
    own = [leaves(F.col(f"`{f.name}`"), f.dataType, F.lit(f.name)) for f in df.schema.fields if f.name not in keys]
    here = F.array(F.struct(F.lit("").alias("path"), F.lit("row").alias("value")))
    return df.select(*keys, F.explode(F.concat(here, *own)).alias("leaf")).select(*keys, "leaf.path", F.col("leaf.value").alias(name))


def compare_nested(recorded: DataFrame, derived: DataFrame, keys: list[str]) -> DataFrame:
    """(keys, path, recorded, derived): every leaf on which two tables of one row a key disagree, with rows that only one has.

    Of a row that the other table lacks only the row itself is reported, not its leaves. Equal tables give nothing.
    """
    a, b = leaf_rows(recorded, keys, "recorded"), leaf_rows(derived, keys, "derived")
    diff = a.join(b, [*keys, "path"], "full").where(~F.col("recorded").eqNullSafe(F.col("derived")))
    alone = diff.where("path = ''").select(*keys)
    return diff.where("path = ''").unionByName(diff.where("path <> ''").join(alone, keys, "left_anti"))


def identity_drift(recorded: DataFrame, decls: DataFrame, subjects: DataFrame) -> DataFrame:
    """Recorded brand colors (columns of brand_colors, or some of them) against those that the declarations give."""
    keys = [*run_keys(recorded), "token"]
    return compare_nested(recorded, brand_colors(decls, subjects).select(recorded.columns), keys)


def adoption_drift(recorded: DataFrame, capabilities: DataFrame, usage: DataFrame) -> DataFrame:
    """Recorded adoption models (repo_id, model) against those that capabilities and usage give."""
    return compare_nested(recorded, adoption_model(capabilities, usage), ["repo_id"])
