"""File sources: project trees and record files, read by Spark."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, functions as F, types as T

from siltstone.session import materialize

GOLDEN = "id string, kind string, question string, input_sql string, source string, target string, expected_tokens array<string>, forbidden_tokens array<string>, top_k int, expected_doc_ids array<string>, expected_keywords array<string>, min_facts int"


def json_lines(spark: SparkSession, path: str, schema: str = GOLDEN, kind: str | None = None) -> DataFrame:
    """One record a line; blank lines and lines that start with # are skipped."""
    rows = spark.read.text(path).where((F.trim("value") != "") & ~F.startswith(F.ltrim("value"), F.lit("#"))).select(F.from_json("value", schema).alias("r")).select("r.*")
    return rows if kind is None else rows.where(F.col("kind") == kind)


def whole_files(spark: SparkSession, path: str, pattern: str) -> DataFrame:
    """``(file, value)`` of all files below a folder whose name fits."""
    files = spark.read.option("wholetext", True).option("recursiveFileLookup", True).option("pathGlobFilter", pattern).text(path)
    return files.select(F.col("_metadata.file_path").alias("file"), "value")


#: Fixed value: names of configuration files.
APPLICATION = "application*.{yml,yaml,properties}"


def application_files(spark: SparkSession, root: str) -> DataFrame:
    """``(file, value)`` of the configuration files of a project, in whichever folder below ``root``, by their names."""
    return whole_files(spark, root, APPLICATION)


def properties(files: DataFrame) -> DataFrame:
    """``(file, key, value)`` of properties files: ``key=value`` or ``key: value`` lines, comments left out."""
    lines = files.select("file", F.explode(F.split("value", r"\r?\n")).alias("line")).where(~F.col("line").rlike(r"^\s*([#!]|$)"))
    cut = lambda g: F.trim(F.regexp_extract("line", r"^\s*([^=:\s]+)\s*[=:]?\s*(.*)$", g))
    return lines.select("file", cut(1).alias("key"), cut(2).alias("value"))


def flat_json(df: DataFrame, keys: list[str], column: str) -> DataFrame:
    """``(*keys, path, value)``: leaves of JSON documents under dotted paths, ``[i]`` for list items, null as empty text.

    One step a level, as many as the deepest document has; what looks nested but can't be parsed is a leaf. Empty objects
    and lists have no leaf. Each level is written before the next one is taken apart.
    """
    left = df.select(*keys, F.lit("").alias("path"), F.col(column).alias("j"))
    out = None
    while True:
        start = F.substring(F.ltrim("j"), 1, 1)
        as_map, as_list = F.when(start == "{", F.from_json("j", "map<string,string>")), F.when(start == "[", F.from_json("j", "array<string>"))
        left = materialize(left.withColumn("m", as_map).withColumn("l", as_list), "json-level")
        leaf = left.where("m is null and l is null").select(*keys, "path", F.coalesce("j", F.lit("")).alias("value"))
        out = leaf if out is None else out.unionByName(leaf)
        nested = left.where("m is not null or l is not null")
        if nested.isEmpty():
            return out
        dot = F.when(F.col("path") == "", "").otherwise(F.concat("path", F.lit(".")))
        of_map = F.transform(F.map_entries("m"), lambda e: F.struct(F.concat(dot, e["key"]).alias("path"), e["value"].alias("j")))
        of_list = F.transform("l", lambda x, i: F.struct(F.concat("path", F.lit("["), i.cast("string"), F.lit("]")).alias("path"), x.alias("j")))
        left = nested.select(*keys, F.explode(F.coalesce(of_map, of_list)).alias("e")).select(*keys, "e.path", "e.j")


DEPENDENCY = T.StructType([T.StructField(n, T.StringType()) for n in ("groupId", "artifactId", "version")])


def dependencies(spark: SparkSession, path: str, pattern: str = "pom.xml") -> DataFrame:
    """``(ga, version)`` of every dependency in the pom.xml files, or others by pattern, below a folder."""
    rows = spark.read.format("xml").option("rowTag", "dependency").option("recursiveFileLookup", True).option("pathGlobFilter", pattern).schema(DEPENDENCY).load(path)
    return rows.select(F.concat_ws(":", "groupId", "artifactId").alias("ga"), "version")


def mapper_sql(files: DataFrame) -> DataFrame:
    """``(file, kind, text, dynamic)``: statements in mapper files; a statement is dynamic if its text has a placeholder or escaped tags."""
    maps = files.where(F.contains("value", F.lit("mapper.dtd")) | F.contains("value", F.lit("<mapper ")))
    pattern = r"(?s)<(select|insert|update|delete)\b[^>]*>(.*?)</\1>"
    found = maps.select("file", F.explode(F.arrays_zip(F.regexp_extract_all("value", F.lit(pattern), F.lit(1)).alias("kind"), F.regexp_extract_all("value", F.lit(pattern), F.lit(2)).alias("body"))).alias("s"))
    bare = F.regexp_replace(F.col("s.body"), r"<!\[CDATA\[|\]\]>|<[^>]*>", "")
    text = F.trim(F.regexp_replace(F.regexp_replace(F.regexp_replace(bare, "&lt;", "<"), "&gt;", ">"), "&amp;", "&"))
    dynamic = F.contains(text, F.lit("${")) | F.contains(text, F.lit("<if")) | F.contains(text, F.lit("<foreach"))
    return found.select("file", F.col("s.kind").alias("kind"), text.alias("text"), dynamic.alias("dynamic"))


def annotation_sql(files: DataFrame) -> DataFrame:
    """``(file, kind, text)``: statements in annotations, from the first to the last quote within the parentheses."""
    pattern = r"(?s)@(Select|Insert|Update|Delete)\s*\(([^)]*\"[^\"]*\"[^)]*)\)"
    found = files.select("file", F.explode(F.arrays_zip(F.regexp_extract_all("value", F.lit(pattern), F.lit(1)).alias("kind"), F.regexp_extract_all("value", F.lit(pattern), F.lit(2)).alias("body"))).alias("s"))
    return found.select("file", F.col("s.kind").alias("kind"), F.regexp_extract(F.col("s.body"), r'(?s)"(.*)"', 1).alias("text"))


def patch_sets(spark: SparkSession, path: str, multi_line: bool = True) -> DataFrame:
    """Results of JSON patch sets, one row each, with the task they belong to; a file is one set, or each of its lines is."""
    return spark.read.option("multiLine", multi_line).json(path).select("taskId", F.explode("results").alias("r")).select("taskId", "r.*")


def anchors_of(html: Column) -> Column:
    """Targets of the links of a page."""
    return F.regexp_extract_all(html, F.lit(r'<a href="([^"]*)"'), F.lit(1))
