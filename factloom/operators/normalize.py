"""Nested facts as three flat relations: facts, records and values.

The plan follows from the schema alone: one projection for the scalar fields, and for each
container one ``posexplode`` below its parent.  Nothing is inferred or shuffled."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

IDENTITY = ("fact_id", "path", "language", "start_line", "end_line")
VALUE_SCHEMA = (
    "fact_id string, relation string, parent_id string, container_length bigint, entry_kind string, ordinal bigint, map_key string, "
    "string_value string, integer_value bigint, float_value double, boolean_value boolean"
)
RECORD_SCHEMA = "fact_id string, relation string, parent_id string, record_id string, ordinal bigint, fields map<string,string>"


def _kind(t: T.DataType) -> str:
    if isinstance(t, T.BooleanType):
        return "boolean"
    if isinstance(t, (T.DoubleType, T.FloatType, T.DecimalType)):
        return "float"
    return "integer" if isinstance(t, T.IntegralType) else "string"


def _scalar(t: T.DataType) -> bool:
    return not isinstance(t, (T.ArrayType, T.MapType, T.StructType))


@dataclass(frozen=True)
class _Container:
    relation: str
    rows: DataFrame  # fact_id, parent_id, value
    kind: T.DataType


def _flat(schema: T.StructType, col: Column | None, prefix: str = "") -> tuple[list[tuple[str, Column, T.DataType]], list[tuple[str, Column, T.DataType]]]:
    """Scalars and containers of a struct, nested objects by dotted names."""
    scalars, containers = [], []
    for f in schema.fields:
        value, name = (F.col(f"`{f.name}`") if col is None else col[f.name]), prefix + f.name
        if isinstance(f.dataType, T.StructType):
            s, c = _flat(f.dataType, value, name + ".")
            scalars += s
            containers += c
        elif _scalar(f.dataType):
            scalars.append((name, value, f.dataType))
        else:
            containers.append((name, value, f.dataType))
    return scalars, containers


def facts(table: DataFrame) -> DataFrame:
    """Identity, a column for each scalar, and presence and length of each container."""
    scalars, containers = _flat(T.StructType([f for f in table.schema.fields if f.name not in IDENTITY]), None)
    columns = [v.alias(n) for n, v, _ in scalars]
    for n, v, _ in containers:
        columns += [v.isNotNull().alias(f"{n}.present"), F.when(v.isNotNull(), F.size(v).cast("bigint")).alias(f"{n}.length")]
    return table.select(*IDENTITY, *columns)


def _walk(rows: DataFrame, relation: str, kind: T.DataType, records: list[DataFrame], values: list[DataFrame]) -> None:
    """``rows`` has fact_id, parent_id and value, a container."""
    size = F.size("value").cast("bigint")
    if isinstance(kind, T.MapType):
        entries = rows.select("fact_id", "parent_id", size.alias("n"), F.posexplode(F.map_entries("value")).alias("i", "e"))
        values.append(_value(entries, relation, "entry", F.col("e.value"), F.col("e.key").cast("string"), kind.valueType))
        return
    element = kind.elementType
    items = rows.select("fact_id", "parent_id", size.alias("n"), F.posexplode("value").alias("i", "e"))
    if _scalar(element):
        values.append(_value(items, relation, "item", F.col("e"), F.lit(None).cast("string"), element))
        return
    here = F.concat_ws("/", "parent_id", F.concat(F.lit(relation.rsplit(".", 1)[-1] + ":"), F.col("i").cast("string")))
    items = items.where(F.col("e").isNotNull()).select("fact_id", "parent_id", here.alias("record_id"), F.col("i").cast("bigint").alias("ordinal"), "e")
    if isinstance(element, T.ArrayType):
        records.append(items.select("fact_id", F.lit(relation).alias("relation"), "parent_id", "record_id", "ordinal", F.create_map().cast("map<string,string>").alias("fields")))
        _walk(items.select("fact_id", F.col("record_id").alias("parent_id"), F.col("e").alias("value")), relation + ".items", element, records, values)
        return
    scalars, containers = _flat(element, F.col("e"))
    pairs = [x for n, v, _ in scalars for x in (F.lit(n), v.cast("string"))]
    fields = F.map_filter(F.create_map(*pairs), lambda k, v: v.isNotNull()) if pairs else F.create_map().cast("map<string,string>")
    records.append(items.select("fact_id", F.lit(relation).alias("relation"), "parent_id", "record_id", "ordinal", fields.alias("fields")))
    for n, v, t in containers:
        _walk(items.select("fact_id", F.col("record_id").alias("parent_id"), v.alias("value")), f"{relation}.{n}", t, records, values)


def _value(rows: DataFrame, relation: str, entry: str, value: Column, key: Column, kind: T.DataType) -> DataFrame:
    name = _kind(kind)
    types = {"string": "string", "integer": "bigint", "float": "double", "boolean": "boolean"}
    columns = [(value if k == name else F.lit(None)).cast(t).alias(f"{k}_value") for k, t in types.items()]
    return rows.select("fact_id", F.lit(relation).alias("relation"), "parent_id", F.col("n").alias("container_length"), F.lit(entry).alias("entry_kind"), F.col("i").cast("bigint").alias("ordinal"), key.alias("map_key"), *columns)


def normalize(table: DataFrame) -> dict[str, DataFrame]:
    """``facts``, ``records`` and ``values`` of a nested family."""
    _, containers = _flat(T.StructType([f for f in table.schema.fields if f.name not in IDENTITY]), None)
    records: list[DataFrame] = []
    values: list[DataFrame] = []
    for n, v, t in containers:
        _walk(table.select("fact_id", F.col("fact_id").alias("parent_id"), v.alias("value")).where(F.col("value").isNotNull()), n, t, records, values)
    spark = table.sparkSession
    return {"facts": facts(table), "records": _union(records) or spark.createDataFrame([], RECORD_SCHEMA), "values": _union(values) or spark.createDataFrame([], VALUE_SCHEMA)}


def _union(parts: list[DataFrame]) -> DataFrame | None:
    out = None
    for p in parts:
        out = p if out is None else out.unionByName(p)
    return out
