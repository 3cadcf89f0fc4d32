"""MySQL functions that a migrated query needs, on Spark's own; only the format letters are mapped here."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

#: MySQL format letters and Spark's.
FORMAT = {"%Y": "yyyy", "%m": "MM", "%d": "dd", "%H": "HH", "%i": "mm", "%s": "ss"}


def spark_format(fmt: str) -> str:
    for theirs, ours in FORMAT.items():
        fmt = fmt.replace(theirs, ours)
    return fmt


def date_format(ts: Column, fmt: str) -> Column:
    return F.date_format(ts, spark_format(fmt))


def ifnull(a: Column, b: Column) -> Column:
    return F.coalesce(a, b)


def isnull(a: Column) -> Column:
    return F.isnull(a)


def group_concat(a: Column, order: Column, separator: str = ",") -> Column:
    """Aggregate: values joined in the order of ``order``."""
    return F.array_join(F.transform(F.array_sort(F.collect_list(F.struct(order.alias("o"), a.cast("string").alias("a")))), lambda s: s["a"]), separator)


def json_extract(doc: Column, path: str) -> Column:
    return F.get_json_object(doc, path)


def json_unquote(value: Column) -> Column:
    """A JSON string without its quotes and escapes; what is no JSON string stays."""
    quoted = F.startswith(value, F.lit('"')) & F.endswith(value, F.lit('"')) & (F.char_length(value) > 1)
    return F.when(quoted, F.coalesce(F.get_json_object(F.concat(F.lit("["), value, F.lit("]")), "$[0]"), value)).otherwise(value)


def curdate() -> Column:
    return F.current_date()


def from_unixtime(seconds: Column) -> Column:
    return F.timestamp_seconds(seconds)


def unix_timestamp(ts: Column) -> Column:
    return F.unix_timestamp(ts)


def convert_tz(ts: Column, source: str, target: str) -> Column:
    return F.convert_timezone(F.lit(source), F.lit(target), ts)


def datediff(a: Column, b: Column) -> Column:
    return F.datediff(a, b)


def timestampdiff_minutes(a: Column, b: Column) -> Column:
    return F.timestamp_diff("MINUTE", a, b)
