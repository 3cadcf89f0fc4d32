"""Project scanning and patches: dialect features, rewrites, config and dependency rules, the code graph."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, functions as F

from siltstone.functions import text as tx

#: Features of two dialects by name and pattern.
FEATURES = [
    ("ORACLE:CONNECT_BY", r"(?i)\bCONNECT\s+BY\b"), ("ORACLE:DUAL", r"(?i)\bFROM\s+DUAL\b"), ("ORACLE:MINUS_OP", r"(?i)\bMINUS\b"), ("ORACLE:NVL", r"(?i)\bNVL\s*\("),
    ("ORACLE:PLSQL_BLOCK", r"(?is)BEGIN\s+.*\s+END;"), ("ORACLE:ROWNUM", r"(?i)\bROWNUM\b"), ("ORACLE:SYSDATE", r"(?i)\bSYSDATE\b"),
    ("MSSQL:BRACKET_IDENT", r"\[[A-Za-z_]\w*\]"), ("MSSQL:GETDATE", r"(?i)\bGETDATE\s*\("), ("MSSQL:ISNULL_FN", r"(?i)\bISNULL\s*\("), ("MSSQL:TOP_N", r"(?i)\bSELECT\s+TOP\b"),
]
#: MySQL functions that need a note, aliases of dialects, rewrites in their order.
NOTED = ["DATE_FORMAT", "IFNULL", "ISNULL", "GROUP_CONCAT", "JSON_EXTRACT", "JSON_UNQUOTE", "FROM_UNIXTIME", "UNIX_TIMESTAMP", "CURDATE", "CONVERT_TZ", "DATEDIFF", "TIMESTAMPDIFF"]
ALIASES = {"opengauss": "postgres", "open_gauss": "postgres", "gauss": "postgres", "postgresql": "postgres", "pg": "postgres", "mysql8": "mysql", "mysql5": "mysql"}
REWRITES = [(r"(?i)\bROWNUM\s*<=?\s*(\d+)", "LIMIT $1", "rownum to limit"), (r"(?i)\bSYSDATE\b", "CURRENT_TIMESTAMP", "sysdate to current_timestamp"), (r"(?i)\bNVL\(", "COALESCE(", "nvl to coalesce"), (r"(?i)\bDUAL\b", "", "dual removed")]
RENAMES = ["servlet", "persistence", "validation", "annotation"]
SENSITIVE = r"(?i)password|secret|token|accesskey|private-key"
RISKY = ["com.oracle.database.jdbc:ojdbc", "com.microsoft.sqlserver:mssql-jdbc", "net.sourceforge.jtds:jtds", "com.ibm.db2:db2jcc"]
REPLACEMENTS = {"com.oracle.database.jdbc:ojdbc11": "com.dameng:DmJdbcDriver18:8.1.3.62", "mysql:mysql-connector-java": "com.dameng:DmJdbcDriver18:8.1.3.62", "com.alibaba:druid": "com.alibaba:druid:1.2.23"}


def features(sql: Column) -> Column:
    """Sorted names of the features that occur."""
    return F.array_sort(F.array_compact(F.array(*[F.when(sql.rlike(p), F.lit(n)) for n, p in FEATURES])))


def dialect(found: Column) -> Column:
    has = lambda p: F.exists(found, lambda x: F.startswith(x, F.lit(p)))
    return F.when(has("ORACLE:"), "ORACLE").when(has("MSSQL:"), "MSSQL").otherwise("GENERIC")


def normal_dialect(name: Column) -> Column:
    low = F.lower(F.trim(name))
    known = F.create_map(*[F.lit(x) for pair in ALIASES.items() for x in pair])
    return F.when(F.coalesce(name, F.lit("")) == "", "mysql").otherwise(F.coalesce(F.try_element_at(known, low), low))


def notes(sql: Column) -> Column:
    """Names of MySQL features in a statement that need a note."""
    upper = F.upper(sql)
    compact = F.replace(upper, F.lit(" "), F.lit(""))
    found = [F.when(F.contains(compact, F.lit(k + "(")), F.lit(k)) for k in NOTED]
    found += [F.when(F.contains(upper, F.lit("AUTO_INCREMENT")), F.lit("AUTO_INCREMENT")), F.when(F.contains(upper, F.lit("FULLTEXT")) | F.contains(compact, F.lit("MATCH(")), F.lit("FULLTEXT")), F.when(F.contains(sql, F.lit("`")), F.lit("BACKTICK"))]
    return F.array_compact(F.array(*found))


def rewrite_sql(sql: Column) -> tuple[Column, Column]:
    """The rewritten statement and the reasons; each rule sees what the rules before it left."""
    reasons = []
    for pattern, new, reason in REWRITES:
        reasons.append(F.when(sql.rlike(pattern), F.lit(reason)))
        sql = F.regexp_replace(sql, pattern, new)
    return sql, F.concat_ws("; ", *reasons)


def sensitive(key: Column) -> Column:
    return key.rlike(SENSITIVE)


def encrypted(key: Column, value: Column) -> Column:
    return sensitive(key) & (F.startswith(value, F.lit("ENC(")) | F.startswith(value, F.lit("{cipher}")))


def rewrite_config(key: Column, line: Column, secret: Column) -> tuple[Column, Column]:
    """A configuration line for the new database, and the reasons."""
    url, driver = F.contains(key, F.lit("datasource.url")), F.contains(key, F.lit("driver-class-name"))
    new = F.regexp_replace(F.regexp_replace(line, r"jdbc:oracle:thin:@//?([^:/]+):(\d+)[:/](\w+)", r"jdbc:dm://$1:$2?schema=$3"), r"jdbc:mysql://([^?]+).*", "jdbc:dm://$1")
    out = F.when(url, new).otherwise(line)
    out = F.when(driver, F.regexp_replace(out, r"oracle\.jdbc\.OracleDriver|com\.mysql\.cj\.jdbc\.Driver", "dm.jdbc.driver.DmDriver")).otherwise(out)
    out = F.when(secret, F.regexp_replace(out, r"(password\s*:\s*)[^\s#]+", r"$1\${DB_PASSWORD}")).otherwise(out)
    return out, F.concat_ws("; ", F.when(url, F.lit("jdbc url")), F.when(driver, F.lit("driver class")), F.when(secret, F.lit("placeholder for plain text")))


def rename_imports(source: Column) -> tuple[Column, Column]:
    """Source text with javax imports renamed, and how many there were."""
    pattern = rf"(?m)^(import\s+(?:static\s+)?)javax\.({'|'.join(RENAMES)})"
    return F.regexp_replace(source, pattern, "$1jakarta.$2"), F.regexp_count(source, F.lit(pattern))


def risk_dependencies(deps: DataFrame) -> DataFrame:
    """Dependencies (column ``ga``) that start with a known risky name."""
    risky = reduce(lambda a, b: a | b, [F.startswith("ga", F.lit(p)) for p in RISKY])
    return deps.where(risky).withColumn("reason", F.lit("closed-source DB driver"))


def replace_dependencies(deps: DataFrame) -> DataFrame:
    """Replacement, confidence and review flag of each dependency from the rule table (a map: a few rules)."""
    known = F.create_map(*[F.lit(x) for pair in REPLACEMENTS.items() for x in pair])
    out = deps.withColumn("replacement", F.try_element_at(known, F.col("ga")))
    return out.withColumn("confidence", F.when(F.col("replacement").isNull(), 0.0).otherwise(0.9)).withColumn("needs_review", F.col("replacement").isNull())


def code_graph(deps: DataFrame, classes: DataFrame, statements: DataFrame, config: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Nodes ``(id, kind, attrs)`` and edges ``(src, dst, relation)`` of a project.

    deps ``(ga, version)``, classes ``(file, class, method)``, statements ``(n, text, origin)``, config ``(file, key, value)``. Of
    repeated nodes one stays; statements without a known file have no edge.
    """
    ref = lambda kind, *c: F.concat(F.lit(kind + ":"), F.concat_ws(":", *c))
    attrs = lambda **kw: F.create_map(*[x for k, v in kw.items() for x in (F.lit(k), v.cast("string"))])
    risk = F.coalesce(F.col("reason").isNotNull(), F.lit(False))
    risky = risk_dependencies(deps.select("ga").distinct())
    method = F.concat("class", F.lit("#"), "method")
    parts = [
        deps.join(risky, "ga", "left").select(ref("dep", F.col("ga")).alias("id"), F.lit("Dependency").alias("kind"), attrs(ga=F.col("ga"), version=F.col("version"), risk=risk).alias("attrs")),
        classes.select(ref("file", F.col("file")).alias("id"), F.lit("File").alias("kind"), attrs(path=F.col("file")).alias("attrs")),
        classes.select(ref("class", F.col("class")).alias("id"), F.lit("Class").alias("kind"), attrs(name=F.col("class")).alias("attrs")),
        classes.select(ref("method", method).alias("id"), F.lit("Method").alias("kind"), attrs(name=F.col("method"), owner=F.col("class")).alias("attrs")),
        statements.select(ref("sql", F.col("n").cast("string")).alias("id"), F.lit("SQL").alias("kind"), attrs(text=tx.preview(F.col("text")), origin=F.col("origin"), dialect=dialect(features(F.col("text")))).alias("attrs")),
        config.select(ref("cfg", F.col("file"), F.col("key")).alias("id"), F.lit("ConfigKey").alias("kind"), attrs(file=F.col("file"), key=F.col("key"), sensitive=sensitive(F.col("key")), encrypted=encrypted(F.col("key"), F.col("value"))).alias("attrs")),
    ]
    nodes = reduce(DataFrame.unionByName, parts).dropDuplicates(["id"])
    files = classes.select(F.col("file").alias("origin")).distinct()
    edges = classes.select(ref("file", F.col("file")).alias("src"), ref("class", F.col("class")).alias("dst"), F.lit("DECLARES").alias("relation"))
    edges = edges.unionByName(classes.select(ref("class", F.col("class")).alias("src"), ref("method", method).alias("dst"), F.lit("CONTAINS").alias("relation"))).distinct()
    refers = statements.join(files, "origin").select(ref("file", F.col("origin")).alias("src"), ref("sql", F.col("n").cast("string")).alias("dst"), F.lit("REFERS_TO").alias("relation"))
    return nodes, edges.unionByName(refers)


def profile(nodes: DataFrame) -> DataFrame:
    """One row about a project: nodes of each kind, Oracle statements, risky dependencies, encrypted keys."""
    kind = lambda k, name: F.count_if(F.col("kind") == k).alias(name)
    attr = lambda k, v: F.try_element_at("attrs", F.lit(k)) == v
    return nodes.agg(
        kind("File", "files"), kind("Class", "classes"), kind("Method", "methods"), kind("SQL", "statements"), kind("Dependency", "dependencies"), kind("ConfigKey", "config_keys"),
        F.count_if(attr("dialect", "ORACLE")).alias("oracle_statements"), F.count_if(attr("risk", "true")).alias("risky_dependencies"), F.count_if(attr("encrypted", "true")).alias("encrypted_keys"),
    )


def errors(**rules: Column) -> Column:
    """Messages of the rules that fail; a null counts as failed."""
    return F.array_compact(F.array(*[F.when(~F.coalesce(ok, F.lit(False)), F.lit(name)) for name, ok in rules.items()]))


def payload_errors(task_id: Column, suggestions: Column) -> Column:
    """What is wrong with a request, in order: its task id, its list of suggestions, and each of them by its place from 0."""
    of_list = F.transform(suggestions, lambda s, i: F.when(s["category"].isNull() | s["target"].isNull(), F.concat(F.lit("suggestions["), i.cast("string"), F.lit("] misses category or target"))))
    whole = F.array(F.when(task_id.try_cast("int").isNull(), F.lit("task_id must be an int")), F.when(F.coalesce(F.size(suggestions), F.lit(0)) < 1, F.lit("suggestions must be a non-empty list")))
    return F.array_compact(F.concat(whole, F.coalesce(of_list, F.array().cast("array<string>"))))
