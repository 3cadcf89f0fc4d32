"""Types of columns that change over time: what a JSON column holds, and the type that takes in two others."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, functions as F, types as T

WHOLE = (T.ByteType, T.ShortType, T.IntegerType, T.LongType)
REAL = (T.FloatType, T.DoubleType, T.DecimalType)


def common(a: T.DataType, b: T.DataType) -> T.DataType:
    """The least type that holds both: long, double, a struct or list of common types, or else text."""
    if a == b or isinstance(b, T.NullType):
        return a
    if isinstance(a, T.NullType):
        return b
    if isinstance(a, WHOLE) and isinstance(b, WHOLE):
        return T.LongType()
    if isinstance(a, WHOLE + REAL) and isinstance(b, WHOLE + REAL):
        return T.DoubleType()
    if isinstance(a, T.StructType) and isinstance(b, T.StructType):
        return merged(a, b)
    if isinstance(a, T.ArrayType) and isinstance(b, T.ArrayType):
        return T.ArrayType(common(a.elementType, b.elementType))
    return T.StringType()


def merged(a: T.StructType, b: T.StructType) -> T.StructType:
    """Fields of both, those of ``a`` first; one that both have gets the common type."""
    of_a, of_b = ({f.name: f.dataType for f in s.fields} for s in (a, b))
    names = [*of_a, *[n for n in of_b if n not in of_a]]
    return T.StructType([T.StructField(n, common(of_a.get(n, T.NullType()), of_b.get(n, T.NullType()))) for n in names])


def as_type(value: Column, had: T.DataType, to: T.DataType) -> Column:
    """A value in the common type; nested values become JSON where that is text, fields that were not there are null."""
    if had == to:
        return value
    if isinstance(had, T.StructType) and isinstance(to, T.StructType):
        there = {f.name: f.dataType for f in had.fields}
        parts = [(as_type(value[f.name], there[f.name], f.dataType) if f.name in there else F.lit(None).cast(f.dataType)).alias(f.name) for f in to.fields]
        return F.when(value.isNotNull(), F.struct(*parts))
    if isinstance(had, T.ArrayType) and isinstance(to, T.ArrayType):
        return F.transform(value, lambda x: as_type(x, had.elementType, to.elementType))
    if isinstance(had, (T.StructType, T.ArrayType, T.MapType)):
        return F.to_json(value)
    return value.cast(to)


def widened(frames: list[DataFrame]) -> list[DataFrame]:
    """The same tables with one schema, which has the columns of all."""
    schema = reduce(merged, [f.schema for f in frames])
    return [f if f.schema == schema else f.select(*[as_type(F.col(f"`{c.name}`") if c.name in f.columns else F.lit(None), f.schema[c.name].dataType if c.name in f.columns else T.NullType(), c.dataType).alias(c.name) for c in schema.fields]) for f in frames]


def plain(t: T.DataType) -> T.DataType:
    """Types of a JSON value as a table has them: decimals are doubles, what is only ever null, or now this and now that, is text."""
    if isinstance(t, T.StructType):
        return T.StructType([T.StructField(f.name, plain(f.dataType)) for f in t.fields])
    if isinstance(t, T.ArrayType):
        return T.ArrayType(plain(t.elementType))
    return T.DoubleType() if isinstance(t, REAL) else T.LongType() if isinstance(t, WHOLE) else T.StringType() if isinstance(t, (T.NullType, T.VariantType)) else t


def json_schemas(rows: DataFrame, column: str, by: str) -> dict[str, T.StructType]:
    """The schema of the JSON objects of each group, from one aggregate; ``by`` has few values, which reach the driver."""
    found = rows.groupBy(by).agg(F.schema_of_variant_agg(F.try_parse_json(column)).alias("s")).collect()
    made = {r[by]: T._parse_datatype_string(r["s"].replace("OBJECT<", "STRUCT<")) for r in found if r["s"]}
    return {name: plain(t) for name, t in made.items() if isinstance(t, T.StructType)}
