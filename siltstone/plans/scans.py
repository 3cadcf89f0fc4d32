"""Project queries: statements, configuration, dependencies and sources derived from orders, parts, events and suppliers."""

from __future__ import annotations

from pyspark.sql import functions as F

from siltstone.functions import mysql, text as tx
from siltstone.operators import projects, records, tasks
from siltstone.session import fresh_path, table

STATEMENT = """case o_orderpriority when '1-URGENT' then concat('SELECT NVL(a,0), SYSDATE FROM t', o_custkey, ' WHERE ROWNUM <= ', o_orderkey)
 when '2-HIGH' then concat('SELECT TOP 5 [a] FROM t', o_custkey) when '3-MEDIUM' then concat('select id from dual where k = ', o_orderkey)
 when '4-NOT SPECIFIED' then concat('SELECT `a`, IFNULL (b, 1), DATE_FORMAT(c, ''%Y'') FROM t', o_custkey) else concat('SELECT a FROM t', o_custkey, ' MINUS SELECT b FROM u') end"""


def statements(spark, sf_dir):
    return table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("n"), F.expr(STATEMENT).alias("text"), F.concat(F.lit("src/T"), F.col("o_custkey").cast("string"), F.lit(".java")).alias("origin"))




def config(spark, sf_dir):
    keys = F.array(*map(F.lit, ("spring.datasource.url", "spring.datasource.password", "spring.datasource.driver-class-name")))
    rows = table(spark, sf_dir, "supplier").select("s_suppkey", "s_nationkey", "s_acctbal", F.explode(keys).alias("key"))
    value = F.when(F.col("key").endswith("url"), F.concat(F.lit("url: jdbc:mysql://db"), "s_suppkey", F.lit(":3306/x?useSSL=false")))
    value = value.when(F.col("key").endswith("password"), F.when(F.col("s_acctbal") > 5000, "ENC(abc)").otherwise(F.concat(F.lit("password: p"), "s_suppkey")))
    return rows.select(F.concat(F.lit("app-"), "s_suppkey", F.lit(".yml")).alias("file"), "key", value.otherwise("driver: com.mysql.cj.jdbc.Driver").alias("value"))


def dependencies(spark, sf_dir):
    name = F.when(F.col("p_size") > 40, "com.oracle.database.jdbc:ojdbc11").when(F.col("p_size") > 30, "mysql:mysql-connector-java").when(F.col("p_size") > 25, "net.sourceforge.jtds:jtds")
    return table(spark, sf_dir, "part").select("p_partkey", name.otherwise(F.concat(F.lit("org.parts:"), F.replace("p_name", F.lit(" "), F.lit("-")))).alias("ga"), F.col("p_size").cast("string").alias("version"))


def sources(spark, sf_dir):
    text = F.concat(F.lit("import javax.servlet.Filter;\nimport java.util.List;\nimport javax."), F.when(F.col("c_mktsegment") == "BUILDING", "validation.Valid").otherwise("sql.DataSource"), F.lit(";\nclass C"), "c_custkey", F.lit(" {}"))
    return table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("id"), text.alias("source"))


def dialect_features(spark, sf_dir):
    found = projects.features(F.col("text"))
    return statements(spark, sf_dir).select("n", F.array_join(found, ",").alias("features"), projects.dialect(found).alias("dialect"))


def dialect_alias(spark, sf_dir):
    name = F.element_at(F.array(*map(F.lit, ("PG", "openGauss", "mysql8", "Oracle", ""))), F.col("p_size") % 5 + 1)
    return table(spark, sf_dir, "part").select("p_partkey", projects.normal_dialect(name).alias("dialect"))


def mysql_notes(spark, sf_dir):
    return statements(spark, sf_dir).select("n", F.explode(projects.notes(F.col("text"))).alias("keyword"))


def oracle_rewrite(spark, sf_dir):
    new, reasons = projects.rewrite_sql(F.col("text"))
    return statements(spark, sf_dir).select("n", new.alias("rewritten"), reasons.alias("rationale"))


def config_flags(spark, sf_dir):
    return config(spark, sf_dir).select("file", "key", projects.sensitive(F.col("key")).alias("sensitive"), projects.encrypted(F.col("key"), F.col("value")).alias("encrypted"))


def config_rewrite(spark, sf_dir):
    new, notes = projects.rewrite_config(F.col("key"), F.col("value"), projects.sensitive(F.col("key")))
    return config(spark, sf_dir).select("file", "key", new.alias("rewritten"), notes.alias("rationale"))


def import_rename(spark, sf_dir):
    new, n = projects.rename_imports(F.col("source"))
    return sources(spark, sf_dir).select("id", F.md5(new.cast("binary")).alias("renamed_md5"), n.alias("changed"), F.when(n > 0, 0.95).otherwise(0.0).alias("confidence"))


def unified_diff(spark, sf_dir):
    new, _ = projects.rewrite_sql(F.col("text"))
    return statements(spark, sf_dir).select("n", tx.unified_diff(F.col("origin"), F.col("text"), new).alias("diff"))


def risk_dependency(spark, sf_dir):
    return projects.risk_dependencies(dependencies(spark, sf_dir))


def dependency_replacement(spark, sf_dir):
    return projects.replace_dependencies(dependencies(spark, sf_dir))


def project(spark, sf_dir):
    classes = table(spark, sf_dir, "customer").select(F.concat(F.lit("src/T"), "c_custkey", F.lit(".java")).alias("file"), F.concat(F.lit("T"), "c_custkey").alias("class"), F.lower("c_mktsegment").alias("method"))
    return projects.code_graph(dependencies(spark, sf_dir).groupBy("ga").agg(F.max("version").alias("version")), classes, statements(spark, sf_dir), config(spark, sf_dir))


def code_graph(spark, sf_dir):
    nodes, edges = project(spark, sf_dir)
    return nodes.groupBy(F.col("kind").alias("name")).agg(F.count(F.lit(1)).alias("n")).unionByName(edges.groupBy(F.col("relation").alias("name")).agg(F.count(F.lit(1)).alias("n")))


def project_profile(spark, sf_dir):
    return projects.profile(project(spark, sf_dir)[0])


def patch_generate(spark, sf_dir):
    """Patches of statements and dependencies, summed up by category."""
    new, reasons = projects.rewrite_sql(F.col("text"))
    sql = statements(spark, sf_dir).select(F.lit("sql_dialect").alias("category"), F.when(reasons != "", 0.92).otherwise(0.55).alias("confidence"), (reasons == "").alias("needs_review"))
    deps = dependency_replacement(spark, sf_dir).select(F.lit("dependency").alias("category"), "confidence", "needs_review")
    imports = import_rename(spark, sf_dir).select(F.lit("api_rename").alias("category"), "confidence", (F.col("changed") == 0).alias("needs_review"))
    return tasks.patch_set(sql.unionByName(deps).unionByName(imports), ["category"])


def units(spark, sf_dir):
    """Risk units of five categories; every 50th statement has lost its text, and nobody handles events."""
    row = lambda df, category, key, text, ref: df.select(F.lit(category).alias("category"), F.concat(F.lit(category + "-"), key.cast("string")).alias("unit"), text.alias("text"), ref.alias("ref"))
    text = F.when(F.col("n") % 50 != 0, F.col("text"))
    out = row(statements(spark, sf_dir), "SQL_DIALECT", F.col("n"), text, F.lit(None).cast("string"))
    out = out.unionByName(row(config(spark, sf_dir), "CONFIG", F.concat_ws("/", "file", "key"), F.col("value"), F.col("key")))
    out = out.unionByName(row(dependencies(spark, sf_dir), "DEPENDENCY", F.col("p_partkey"), F.col("version"), F.col("ga")))
    out = out.unionByName(row(sources(spark, sf_dir), "API_RENAME", F.col("id"), F.col("source"), F.lit(None).cast("string")))
    return out.unionByName(row(table(spark, sf_dir, "events"), "EVENT", F.col("event_id"), F.col("event_type"), F.lit(None).cast("string")))


def handlers():
    text, ref = F.col("text"), F.col("ref")
    of, missing = (lambda c: F.col("category") == c), F.when(text.isNull(), F.lit("no code fragment"))
    renamed, changed = projects.rename_imports(text)
    sql, reasons = projects.rewrite_sql(text)
    setting, notes = projects.rewrite_config(ref, text, projects.sensitive(ref))
    target = F.try_element_at(F.create_map(*[F.lit(x) for pair in projects.REPLACEMENTS.items() for x in pair]), ref)
    return [
        tasks.Handler("api_rename", of("API_RENAME"), renamed, F.concat(F.lit("imports renamed: "), changed.cast("string")), F.when(changed > 0, 0.95).otherwise(0.0), changed == 0, missing),
        tasks.Handler("config", of("CONFIG"), setting, notes, F.lit(0.93), F.lit(False), missing),
        tasks.Handler("dependency", of("DEPENDENCY"), target, F.coalesce(F.concat(F.lit("replaced by "), target), F.concat(F.lit("no replacement for "), ref)), F.when(target.isNull(), 0.0).otherwise(0.9), target.isNull(), F.lit(None).cast("string")),
        tasks.Handler("sql_dialect", of("SQL_DIALECT"), sql, reasons, F.when(reasons != "", 0.92).otherwise(0.55), reasons == "", missing),
    ]


def patch_dispatch(spark, sf_dir):
    found = tasks.dispatch(units(spark, sf_dir), handlers(), ["unit", "category"])
    return found.select("unit", "category", "handler", F.md5(F.col("patched").cast("binary")).alias("patched_md5"), "rationale", "confidence", "needs_review")


def patch_unhandled(spark, sf_dir):
    return tasks.unhandled(units(spark, sf_dir), handlers()).groupBy("category").agg(F.count(F.lit(1)).alias("n"))


def record_check(spark, sf_dir):
    """Events as structured records: known kinds, values within bounds, a payload with its field."""
    payload = F.from_json("props", "k int")
    found = projects.errors(event_type=F.col("event_type").isin("view", "click", "purchase", "signup"), value=F.col("value").between(0, 100), payload=payload["k"].isNotNull())
    return table(spark, sf_dir, "events").select("event_id", F.array_join(found, ",").alias("errors"), (F.size(found) == 0).alias("valid"))


def record_quarantine(spark, sf_dir):
    """Events that break a rule are set aside; then errors become a known kind and what was set aside is looked at again."""
    first, second = fresh_path(spark, "quarantine"), fresh_path(spark, "quarantine-again")
    rows = table(spark, sf_dir, "events").select("event_id", "event_type", "value")
    rules = lambda *kinds: projects.errors(event_type=F.col("event_type").isin(*kinds), value=F.col("value").between(0, 100))
    good = records.quarantine(rows, rules("view", "click", "purchase", "signup"), first)
    more = records.retry(records.held(spark, first), "event_id long, event_type string, value double", rules("view", "click", "purchase", "signup", "error"), second, 1)
    passed = records.together([good.withColumn("state", F.lit("good")), more.withColumn("state", F.lit("later"))]).groupBy("state").agg(F.count(F.lit(1)).alias("n"))
    return passed.unionByName(records.summary(records.held(spark, second)).select(F.col("error").alias("state"), "n"))


def payload_check(spark, sf_dir):
    """Requests of a task with its suggestions: at least one, each with category and target."""
    rows = table(spark, sf_dir, "customer").join(table(spark, sf_dir, "orders").withColumnRenamed("o_custkey", "c_custkey"), "c_custkey", "left")
    whole = F.col("o_orderstatus").isNotNull() & (F.col("o_orderpriority") != "5-LOW")
    sums = rows.groupBy("c_custkey").agg(F.count("o_orderkey").alias("n"), F.count_if(F.col("o_orderkey").isNotNull() & ~whole).alias("bad"))
    found = F.concat_ws("; ", F.when(F.col("n") == 0, F.lit("suggestions must be a non-empty list")), F.when(F.col("bad") > 0, F.concat("bad", F.lit(" suggestions miss category or target"))))
    return sums.select("c_custkey", found.alias("errors"))


def payload_errors(spark, sf_dir):
    """The same requests with their suggestions as lists; every tenth task id is no number."""
    one = F.struct("o_orderkey", F.col("o_orderstatus").alias("category"), F.when(F.col("o_orderpriority") != "5-LOW", F.col("o_orderpriority")).alias("target"))
    lists = table(spark, sf_dir, "orders").groupBy(F.col("o_custkey").alias("c_custkey")).agg(F.array_sort(F.collect_list(one)).alias("s"))
    rows = table(spark, sf_dir, "customer").select("c_custkey").join(lists, "c_custkey", "left")
    task = F.concat(F.when(F.col("c_custkey") % 10 == 0, "t").otherwise(""), F.col("c_custkey").cast("string"))
    found = projects.payload_errors(task, F.col("s"))
    return rows.select("c_custkey", F.array_join(found, "; ").alias("errors"), (F.size(found) == 0).alias("valid"))


def payload_strip(spark, sf_dir):
    both = F.create_map(F.lit("_event"), F.col("event_type"), F.lit("user"), F.col("user_id").cast("string"), F.lit("_k"), F.get_json_object("props", "$.k"))
    kept = F.map_filter(both, lambda k, v: ~F.startswith(k, F.lit("_")))
    return table(spark, sf_dir, "events").select("event_id", F.array_join(F.map_keys(kept), ",").alias("keys"), F.try_element_at(kept, F.lit("user")).alias("user"))


def text_preview(spark, sf_dir):
    return table(spark, sf_dir, "documents").select("doc_id", tx.preview(F.col("text")).alias("preview"))


def mysql_functions(spark, sf_dir):
    """The functions that migrated queries call, over all events."""
    ts = F.col("ts").cast("timestamp")
    return table(spark, sf_dir, "events").select(
        "event_id", mysql.date_format(ts, "%Y-%m-%d %H:%i:%s").alias("formatted"), mysql.ifnull(F.nullif("event_type", F.lit("error")), F.lit("none")).alias("kind"), mysql.isnull(F.nullif("event_type", F.lit("error"))).alias("missing"),
        mysql.json_extract(F.col("props"), "$.k").alias("k"), mysql.unix_timestamp(ts).alias("epoch"), mysql.date_format(mysql.from_unixtime(mysql.unix_timestamp(ts)), "%H:%i").alias("clock"),
        mysql.datediff(ts, F.lit("2024-01-01").cast("date")).alias("days"), mysql.timestampdiff_minutes(F.lit("2024-01-01").cast("timestamp"), ts).alias("minutes"),
        mysql.json_unquote(F.concat(F.lit('"a\\"'), "event_type", F.lit('"'))).alias("unquoted"), mysql.date_format(mysql.convert_tz(ts.cast("timestamp_ntz"), "UTC", "Asia/Shanghai"), "%Y-%m-%d %H:%i").alias("zoned"), (mysql.curdate() >= F.to_date(F.lit("2024-01-01"))).alias("past"),
    )


def group_concat(spark, sf_dir):
    return table(spark, sf_dir, "nation").groupBy("n_regionkey").agg(mysql.group_concat(F.col("n_name"), F.col("n_nationkey")).alias("names"))


QUERIES = {f.__name__: f for f in (dialect_features, dialect_alias, mysql_notes, oracle_rewrite, config_flags, config_rewrite, import_rename, unified_diff, risk_dependency, dependency_replacement, code_graph, project_profile, patch_generate, patch_dispatch, patch_unhandled, record_check, record_quarantine, payload_check, payload_errors, payload_strip, text_preview, mysql_functions, group_concat)}

S = f"s as (select o_orderkey n, {STATEMENT} text, 'src/T' || o_custkey || '.java' origin from orders)"
C = """k as (select s_suppkey, s_acctbal, unnest(['spring.datasource.url', 'spring.datasource.password', 'spring.datasource.driver-class-name']) key from supplier),
c as (select 'app-' || s_suppkey || '.yml' file, key, case when key like '%url' then 'url: jdbc:mysql://db' || s_suppkey || ':3306/x?useSSL=false' when key like '%password' then case when s_acctbal > 5000 then 'ENC(abc)' else 'password: p' || s_suppkey end else 'driver: com.mysql.cj.jdbc.Driver' end as value from k)"""
D = "d as (select p_partkey, case when p_size > 40 then 'com.oracle.database.jdbc:ojdbc11' when p_size > 30 then 'mysql:mysql-connector-java' when p_size > 25 then 'net.sourceforge.jtds:jtds' else 'org.parts:' || replace(p_name, ' ', '-') end ga, p_size::VARCHAR version from part)"
I = "i as (select c_custkey id, 'import javax.servlet.Filter;' || chr(10) || 'import java.util.List;' || chr(10) || 'import javax.' || case when c_mktsegment = 'BUILDING' then 'validation.Valid' else 'sql.DataSource' end || ';' || chr(10) || 'class C' || c_custkey || ' {}' source, case when c_mktsegment = 'BUILDING' then 2 else 1 end n from customer)"
FEATURE_LIST = "list_sort(list_filter([" + ", ".join(f"case when regexp_matches(text, '{p}') then '{n}' end" for n, p in projects.FEATURES) + "], lambda x: x is not null))"
DIALECT = f"case when len(list_filter({FEATURE_LIST}, lambda x: starts_with(x, 'ORACLE:'))) > 0 then 'ORACLE' when len({FEATURE_LIST}) > 0 then 'MSSQL' else 'GENERIC' end"
NOTE_LIST = "[" + ", ".join(f"case when contains(replace(upper(text), ' ', ''), '{k}(') then '{k}' end" for k in projects.NOTED) + ", case when contains(upper(text), 'AUTO_INCREMENT') then 'AUTO_INCREMENT' end, case when contains(upper(text), 'FULLTEXT') or contains(replace(upper(text), ' ', ''), 'MATCH(') then 'FULLTEXT' end, case when contains(text, '`') then 'BACKTICK' end]"


def rewritten_sql():
    text, reasons = "text", []
    for pattern, new, reason in projects.REWRITES:
        reasons.append(f"case when regexp_matches({text}, '{pattern}') then '{reason}' end")
        text = f"regexp_replace({text}, '{pattern}', '{new.replace('$', chr(92))}', 'g')"
    return text, "concat_ws('; ', " + ", ".join(reasons) + ")"


NEW, WHY = rewritten_sql()
SENS = "regexp_matches(key, '(?i)password|secret|token|accesskey|private-key')"
REPL = "case ga " + " ".join(f"when '{a}' then '{b}'" for a, b in projects.REPLACEMENTS.items()) + " end"
RISK = " or ".join(f"starts_with(ga, '{p}')" for p in projects.RISKY)
PATCH = "count(*) total, round(avg(confidence), 6) mean_confidence, count(*) filter (needs_review) review"
ORACLES = {
    "dialect_features": f"with {S} select n, array_to_string({FEATURE_LIST}, ',') features, {DIALECT} dialect from s",
    "dialect_alias": "select p_partkey, ['postgres', 'postgres', 'mysql', 'oracle', 'mysql'][p_size % 5 + 1] dialect from part",
    "mysql_notes": f"with {S}, l as (select n, unnest({NOTE_LIST}) keyword from s) from l where keyword is not null",
    "oracle_rewrite": f"with {S} select n, {NEW} rewritten, {WHY} rationale from s",
    "config_flags": f"with {C} select file, key, {SENS} \"sensitive\", {SENS} and (starts_with(value, 'ENC(') or starts_with(value, '{{cipher}}')) encrypted from c",
    "config_rewrite": f"""with {C} select file, key, case when key like '%url' then regexp_replace(value, 'jdbc:mysql://([^?]+).*', 'jdbc:dm://\\1') when key like '%password' then regexp_replace(value, '(password\\s*:\\s*)[^\\s#]+', '\\1${{DB_PASSWORD}}') else replace(value, 'com.mysql.cj.jdbc.Driver', 'dm.jdbc.driver.DmDriver') end rewritten,
        case when key like '%url' then 'jdbc url' when key like '%password' then 'placeholder for plain text' else 'driver class' end rationale from c""",
    "import_rename": f"with {I} select id, md5(replace(replace(source, 'javax.servlet', 'jakarta.servlet'), 'javax.validation', 'jakarta.validation')) renamed_md5, n changed, 0.95::DOUBLE confidence from i",
    "unified_diff": f"with {S} select n, '--- a/' || origin || chr(10) || '+++ b/' || origin || chr(10) || '@@ -1,1 +1,1 @@' || chr(10) || '-' || text || chr(10) || '+' || {NEW} || chr(10) diff from s",
    "risk_dependency": f"with {D} select *, 'closed-source DB driver' reason from d where {RISK}",
    "dependency_replacement": f"with {D} select *, {REPL} replacement, case when {REPL} is null then 0.0 else 0.9 end::DOUBLE confidence, {REPL} is null needs_review from d",
    "code_graph": f"""with {S}, {C}, {D} select 'Dependency' as name, count(distinct ga) n from d union all select unnest(['File', 'Class', 'Method', 'DECLARES', 'CONTAINS']), count(*) from customer
        union all select 'SQL', count(*) from s union all select 'ConfigKey', count(*) from c union all select 'REFERS_TO', count(*) from orders where o_custkey in (select c_custkey from customer)""",
    "project_profile": f"""with {S}, {C}, {D} select (select count(*) from customer) files, (select count(*) from customer) classes, (select count(*) from customer) methods, (select count(*) from s) statements, (select count(distinct ga) from d) dependencies, (select count(*) from c) config_keys,
        (select count(*) from s where {DIALECT} = 'ORACLE') oracle_statements, (select count(distinct ga) from d where {RISK}) risky_dependencies, (select count(*) from c where starts_with(value, 'ENC(')) encrypted_keys""",
    "patch_generate": f"""with {S}, {D}, {I}, p as (select 'sql_dialect' category, case when {WHY} <> '' then 0.92 else 0.55 end confidence, {WHY} = '' needs_review from s
        union all select 'dependency', case when {REPL} is null then 0.0 else 0.9 end, {REPL} is null from d union all select 'api_rename', 0.95, false from i) select category, count(*) total, round(avg(confidence::DOUBLE), 6) mean_confidence, count(*) filter (needs_review) review from p group by category""",
    "patch_dispatch": f"""with {S}, {C}, {D}, {I}, l as (select n, case when n % 50 <> 0 then text end text from s), p as (
        select 'SQL_DIALECT-' || n unit, 'SQL_DIALECT' category, 'sql_dialect' as "handler", {NEW} patched, case when text is null then 'handler error: no code fragment' else {WHY} end rationale, case when text is null then 0.0 when {WHY} <> '' then 0.92 else 0.55 end confidence, text is null or {WHY} = '' needs_review from l
        union all select 'CONFIG-' || file || '/' || key, 'CONFIG', 'config', case when key like '%url' then regexp_replace(value, 'jdbc:mysql://([^?]+).*', 'jdbc:dm://\\1') when key like '%password' then regexp_replace(value, '(password\\s*:\\s*)[^\\s#]+', '\\1${{DB_PASSWORD}}') else replace(value, 'com.mysql.cj.jdbc.Driver', 'dm.jdbc.driver.DmDriver') end,
          case when key like '%url' then 'jdbc url' when key like '%password' then 'placeholder for plain text' else 'driver class' end, 0.93, false from c
        union all select 'DEPENDENCY-' || p_partkey, 'DEPENDENCY', 'dependency', {REPL}, coalesce('replaced by ' || {REPL}, 'no replacement for ' || ga), case when {REPL} is null then 0.0 else 0.9 end, {REPL} is null from d
        union all select 'API_RENAME-' || id, 'API_RENAME', 'api_rename', replace(replace(source, 'javax.servlet', 'jakarta.servlet'), 'javax.validation', 'jakarta.validation'), 'imports renamed: ' || n, 0.95, false from i)
        select unit, category, "handler", md5(patched) patched_md5, rationale, confidence::DOUBLE confidence, needs_review from p""",
    "patch_unhandled": "select 'EVENT' category, count(*) n from events",
    "record_check": """with e as (select event_id, concat_ws(',', case when event_type not in ('view', 'click', 'purchase', 'signup') then 'event_type' end, case when not (value between 0 and 100) then 'value' end, case when (props->>'$.k') is null then 'payload' end) errors from events)
        select event_id, errors, errors = '' valid from e""",
    "record_quarantine": """with e as (select event_type in ('view', 'click', 'purchase', 'signup') k, event_type = 'error' x, value between 0 and 100 v from events)
        select case when k and v then 'good' else 'later' end state, count(*) n from e where v and (k or x) group by all
        union all select 'value', count(*) from e where not v having count(*) > 0 union all select 'event_type', count(*) from e where not k and not x having count(*) > 0""",
    "payload_check": """with r as (select c_custkey, count(o_orderkey) n, count(*) filter (o_orderkey is not null and o_orderpriority = '5-LOW') bad from customer left join orders on c_custkey = o_custkey group by c_custkey)
        select c_custkey, concat_ws('; ', case when n = 0 then 'suggestions must be a non-empty list' end, case when bad > 0 then bad || ' suggestions miss category or target' end) errors from r""",
    "payload_errors": """with o as (select o_custkey c_custkey, o_orderpriority p, row_number() over (partition by o_custkey order by o_orderkey) - 1 i from orders),
        e as (select c_custkey, -2 i, 'task_id must be an int' e from customer where c_custkey % 10 = 0 union all select c_custkey, -1, 'suggestions must be a non-empty list' from customer where c_custkey not in (select o_custkey from orders)
        union all select c_custkey, i, 'suggestions[' || i || '] misses category or target' from o where p = '5-LOW')
        select c_custkey, coalesce(string_agg(e, '; ' order by i), '') errors, count(e) = 0 as "valid" from customer left join e using (c_custkey) group by c_custkey""",
    "payload_strip": "select event_id, 'user' keys, user_id::VARCHAR \"user\" from events",
    "text_preview": "select doc_id, case when length(text) > 200 then substr(text, 1, 200) || '...' else text end preview from documents",
    "mysql_functions": """select event_id, strftime(ts, '%Y-%m-%d %H:%M:%S') formatted, coalesce(nullif(event_type, 'error'), 'none') kind, event_type = 'error' missing, props->>'$.k' k, floor(epoch(ts))::BIGINT epoch, strftime(ts, '%H:%M') clock,
        datediff('day', DATE '2024-01-01', ts::DATE)::INT as "days", (floor(epoch(ts - TIMESTAMP '2024-01-01') / 60))::BIGINT as "minutes",
        'a"' || event_type unquoted, strftime(ts + interval 8 hour, '%Y-%m-%d %H:%M') zoned, true past from events""",
    "group_concat": "select n_regionkey, string_agg(n_name, ',' order by n_nationkey) as names from nation group by n_regionkey",
}
