"""Streaming and file queries: the given tables are written as files to shared storage, then read as sources and streams."""

from __future__ import annotations

from pyspark.sql import functions as F

from siltstone.operators import projects
from siltstone.plans import migration, scans
from siltstone.session import fresh_path, table
from siltstone.sources import files
from siltstone.streaming import buckets, cdc


def change_files(spark, sf_dir):
    """All events as JSON lines, and one unreadable line for each event without a positive value class."""
    path = fresh_path(spark, "changes")
    rows = migration.changes(spark, sf_dir)
    good = rows.select(F.to_json(F.struct("id", "seq", "deleted", "event_type", "value")).alias("value"))
    bad = rows.where("value > 300").select(F.concat(F.lit("{broken "), F.col("seq").cast("string")).alias("value"))
    good.unionByName(bad).write.text(path)
    return path


def applied(spark, sf_dir):
    out, dead = fresh_path(spark, "cdc"), fresh_path(spark, "dead")
    cdc.apply_stream(cdc.changes(spark, change_files(spark, sf_dir)), out, dead, fresh_path(spark, "cdc-log")).awaitTermination()
    return out, dead


def cdc_apply(spark, sf_dir):
    out, _ = applied(spark, sf_dir)
    return cdc.snapshot(spark, out).select("id", "seq", "event_type", "value")


def cdc_dead_letter(spark, sf_dir):
    _, dead = applied(spark, sf_dir)
    return spark.read.parquet(dead).select(F.col("_bad").alias("line"))


def cdc_tables(spark, sf_dir):
    """Changes of two tables by topic, in two files each; the second files have one more column, and one topic is nobody's."""
    path, out, dead = fresh_path(spark, "topics"), fresh_path(spark, "tables"), fresh_path(spark, "topics-dead")
    events = migration.changes(spark, sf_dir).select(F.lit("app.src.db.events").alias("topic"), F.to_json(F.struct("id", "seq", "deleted", "event_type", F.when(F.col("seq") % 2 == 1, F.col("event_type")).alias("again"))).alias("line"), (F.col("seq") % 2).alias("late"))
    orders = table(spark, sf_dir, "orders").select(F.lit("app.src.db.orders").alias("topic"), F.to_json(F.struct(F.col("o_custkey").alias("id"), F.col("o_orderkey").alias("seq"), (F.col("o_orderstatus") == "F").alias("deleted"), F.col("o_orderpriority").alias("priority"))).alias("line"), F.lit(0).cast("long").alias("late"))
    other = table(spark, sf_dir, "region").select(F.lit("app.log").alias("topic"), F.to_json(F.struct(F.col("r_regionkey").alias("id"), F.lit(1).alias("seq"))).alias("line"), F.lit(0).cast("long").alias("late"))
    rows = events.unionByName(orders).unionByName(other)
    for late in (1, 0):
        rows.where(F.col("late") == late).select("topic", "line").coalesce(1).write.mode("append").json(path)
    stream = spark.readStream.schema("topic string, line string").option("maxFilesPerTrigger", 1).json(path)
    cdc.apply_topics(stream, out, dead, fresh_path(spark, "topics-log"), r"^app\.src\.db\.(.*)$").awaitTermination()
    one, two = (cdc.snapshot(spark, f"{out}/{name}") for name in ("events", "orders"))
    found = one.select(F.lit("events").alias("table"), F.col("id").cast("string").alias("id"), "seq", F.col("event_type").alias("value"), "again").unionByName(two.select(F.lit("orders").alias("table"), F.col("id").cast("string").alias("id"), "seq", F.col("priority").alias("value"), F.lit(None).cast("string").alias("again")))
    lost = spark.read.parquet(dead).select(F.lit("dead").alias("table"), F.get_json_object("line", "$.id").alias("id"), F.lit(None).cast("long").alias("seq"), F.col("topic").alias("value"), F.lit(None).cast("string").alias("again"))
    return found.unionByName(lost)


def golden_records(spark, sf_dir):
    """Questions as JSON lines with comments and blank lines between, read back by kind."""
    path = fresh_path(spark, "golden")
    rows = table(spark, sf_dir, "benchmark").select(F.concat(F.lit("g"), "item_id").alias("id"), F.when(F.col("item_id") % 3 == 0, "sql").otherwise("qa").alias("kind"), F.col("text").alias("question"), (F.col("item_id") % 7).cast("int").alias("top_k"))
    lines = rows.select(F.explode(F.array(F.concat(F.lit("# "), "id"), F.lit("  "), F.to_json(F.struct("id", "kind", "question", "top_k")))).alias("value"))
    lines.write.text(path)
    return files.json_lines(spark, path, kind="qa").select("id", "kind", F.md5(F.col("question").cast("binary")).alias("question_md5"), "top_k")


def patch_sets(spark, sf_dir):
    """Suggestions of customers as JSON patch sets, one a file line, read back as one row a patch."""
    path = fresh_path(spark, "patch-sets")
    one = F.struct(F.col("o_orderkey").cast("string").alias("unitId"), F.col("o_orderpriority").alias("category"), (F.col("o_orderkey") % 100 / 100.0).alias("confidence"))
    table(spark, sf_dir, "orders").groupBy(F.col("o_custkey").alias("taskId")).agg(F.collect_list(one).alias("results")).write.json(path)
    return files.patch_sets(spark, path, multi_line=False).select("taskId", "unitId", "category", F.round("confidence", 6).alias("confidence"))


def project_scan(spark, sf_dir):
    """A project tree end to end: files of four kinds are written, read back, scanned, and become the code graph and its profile."""
    root = fresh_path(spark, "project")
    tag = lambda name, value: F.concat(F.lit(f"<{name}>"), value, F.lit(f"</{name}>"))
    one = tag("dependency", F.concat(tag("groupId", F.substring_index("ga", ":", 1)), tag("artifactId", F.substring_index("ga", ":", -1)), tag("version", F.col("version"))))
    modules = scans.dependencies(spark, sf_dir).groupBy(F.floor(F.col("p_partkey") / 1000).alias("module")).agg(F.array_join(F.collect_list(one), "").alias("d"))  # a thousand at most
    modules.select("module", tag("project", tag("dependencies", F.col("d"))).alias("value")).write.partitionBy("module").text(f"{root}/pom")
    scans.config(spark, sf_dir).select(F.concat("file", F.lit("."), "key", F.lit("="), "value").alias("value")).write.text(f"{root}/config")
    rows = scans.statements(spark, sf_dir).select(F.concat(F.lit("<mapper namespace='m"), F.col("n").cast("string"), F.lit("'><select id='q'>"), F.replace("text", F.lit("<"), F.lit("&lt;")), F.lit("</select></mapper>")).alias("value"))
    rows.write.text(f"{root}/mapper")
    scans.sources(spark, sf_dir).select("source").write.text(f"{root}/java")
    read = files.dependencies(spark, f"{root}/pom", "*.txt").groupBy("ga").agg(F.max("version").alias("version"))
    config = files.properties(files.whole_files(spark, f"{root}/config", "*.txt"))
    sql = files.mapper_sql(files.whole_files(spark, f"{root}/mapper", "*.txt"))
    java = files.whole_files(spark, f"{root}/java", "*.txt").select("file", F.explode(F.regexp_extract_all("value", F.lit(r"class (\w+)"), F.lit(1))).alias("class"))
    classes = java.select(F.concat_ws("/", F.lit("src"), "class").alias("file"), "class", F.lit("run").alias("method"))
    nodes, _ = projects.code_graph(read, classes, sql.select(F.monotonically_increasing_id().alias("n"), "text", F.lit("mapper").alias("origin")), config.withColumn("file", F.regexp_extract("key", r"^(.*?\.yml)", 1)).withColumn("key", F.regexp_replace("key", r"^.*?\.yml\.", "")))
    return projects.profile(nodes)


def task_progress(spark, sf_dir):
    stream = cdc.progress(cdc.changes(spark, change_files(spark, sf_dir)).where("_bad is null"))
    out = fresh_path(spark, "progress")

    def put(rows, number):
        rows.write.mode("overwrite").parquet(f"{out}/v={number}")

    stream.writeStream.outputMode("complete").foreachBatch(put).option("checkpointLocation", fresh_path(spark, "progress-log")).trigger(availableNow=True).start().awaitTermination()
    return spark.read.parquet(f"{out}/v={buckets.versions(spark, out)[-1]}").select("id", "n", "percent", "last")


def stream_ingest(spark, sf_dir):
    """Documents come as files in three runs, the second with those of the first again; a digest of the text is the key."""
    path, out, log = fresh_path(spark, "incoming"), fresh_path(spark, "ingest"), fresh_path(spark, "ingest-log")
    docs = table(spark, sf_dir, "documents").select("doc_id", "lang", F.md5(F.col("text").cast("binary")).alias("key"))
    for some in (docs.where("doc_id % 3 = 0"), docs.where("doc_id % 3 < 2"), docs.where("doc_id % 3 = 2")):
        some.select("lang", "key").write.mode("append").parquet(path)
        cdc.ingest_stream(spark.readStream.schema("lang string, key string").parquet(path), out, log, "key").awaitTermination()
    return cdc.ingested(spark, out).select("key")


def json_flatten(spark, sf_dir):
    """Payloads of events inside a nested document."""
    doc = F.concat(F.lit('{"user": {"id": '), F.col("user_id").cast("string"), F.lit(', "tags": ["'), "event_type", F.lit('", null]}, "props": '), "props", F.lit("}"))
    return files.flat_json(table(spark, sf_dir, "events").select("event_id", doc.alias("j")), ["event_id"], "j")


def config_scan(spark, sf_dir):
    """Configuration keys written as properties files, read back from the folder."""
    path = fresh_path(spark, "config")
    rows = scans.config(spark, sf_dir).where("key not like '%url'")
    rows.select(F.concat("file", F.lit("."), "key", F.lit("="), "value").alias("value")).write.text(path)
    return files.properties(files.whole_files(spark, path, "*.txt")).select("key", "value")


def application_scan(spark, sf_dir):
    """Configuration files of a project by their names, among others that are left alone."""
    path = fresh_path(spark, "project")
    rows = scans.config(spark, sf_dir).where("key not like '%url'")
    for name, some in (("application", rows.where("key like '%password'")), ("bootstrap", rows)):
        lines = some.select(F.concat("file", F.lit("."), "key", F.lit("="), "value").alias("value"))
        lines.write.text(f"{path}/{name}")
        folder = spark._jvm.org.apache.hadoop.fs.Path(f"{path}/{name}")
        fs = folder.getFileSystem(spark._jsc.hadoopConfiguration())
        for i, part in enumerate(s.getPath() for s in fs.listStatus(folder) if s.getPath().getName().startswith("part-")):
            fs.rename(part, spark._jvm.org.apache.hadoop.fs.Path(folder, f"{name}-{i}.{('properties', 'yml')[i % 2]}"))
    return files.properties(files.application_files(spark, path)).select("key", "value")


def mapper_sql(spark, sf_dir):
    """Statements wrapped as mapper files."""
    tag = F.when(F.col("text").contains("t1"), "update").otherwise("select")
    body = F.concat(F.lit("<mapper namespace='a'>\n<"), tag, F.lit(" id='q'> "), F.replace("text", F.lit("<"), F.lit("&lt;")), F.lit(" ${x}</"), tag, F.lit(">\n</mapper>"))
    found = files.mapper_sql(scans.statements(spark, sf_dir).select(F.col("n").alias("file"), body.alias("value")))
    return found.select(F.col("file").alias("n"), "kind", "text", "dynamic")


def annotation_sql(spark, sf_dir):
    body = F.concat(F.lit('interface A {\n  @Select("'), F.regexp_replace("text", r"[()]", " "), F.lit('")\n  int q();\n}'))
    return files.annotation_sql(scans.statements(spark, sf_dir).select(F.col("n").alias("file"), body.alias("value"))).select(F.col("file").alias("n"), "kind", "text")


def page_links(spark, sf_dir):
    return table(spark, sf_dir, "pages").select("page_id", F.explode(files.anchors_of(F.col("html"))).alias("href")).groupBy("href").agg(F.count(F.lit(1)).alias("n"))


QUERIES = {f.__name__: f for f in (cdc_apply, cdc_dead_letter, cdc_tables, golden_records, patch_sets, project_scan, task_progress, stream_ingest, json_flatten, config_scan, application_scan, mapper_sql, annotation_sql, page_links)}

ORACLES = {
    "cdc_tables": f"""with {migration.LATEST}, e as (select id, seq, event_type from c where not deleted), o as (select o_custkey id, arg_max(o_orderkey, o_orderkey) seq, arg_max(o_orderpriority, o_orderkey) p, arg_max(o_orderstatus, o_orderkey) st from orders group by o_custkey)
        select 'events' "table", id::VARCHAR id, seq::BIGINT seq, event_type as value, case when seq % 2 = 1 then event_type end again from e union all select 'orders', id::VARCHAR, seq::BIGINT, p, null from o where st <> 'F' union all select 'dead', r_regionkey::VARCHAR, null, 'app.log', null from region""",
    "golden_records": "select 'g' || item_id id, 'qa' kind, md5(text) question_md5, (item_id % 7)::INT top_k from benchmark where item_id % 3 <> 0",
    "patch_sets": "select o_custkey \"taskId\", o_orderkey::VARCHAR \"unitId\", o_orderpriority category, round(o_orderkey % 100 / 100.0, 6)::DOUBLE confidence from orders",
    "project_scan": scans.ORACLES["project_profile"],
    "cdc_apply": f"with {migration.LATEST} select id, seq, event_type, value from c where not deleted",
    "cdc_dead_letter": "select '{broken ' || event_id line from events where value > 300",
    "task_progress": "select user_id id, count(*) n, least(100, floor(count(*) * 100 / 6 + 0.5))::INT percent, arg_max(event_type, event_id) \"last\" from events group by user_id",
    "stream_ingest": "select distinct md5(text) key from documents",
    "json_flatten": """select event_id, 'user.id' path, user_id::VARCHAR as value from events union all select event_id, 'user.tags[0]', event_type from events union all select event_id, 'user.tags[1]', '' from events
        union all select event_id, 'props.k', props->>'$.k' from events""",
    "config_scan": f"with {scans.C} select file || '.' || key \"key\", value from c where key not like '%url'",
    "application_scan": f"with {scans.C} select file || '.' || key \"key\", value from c where key like '%password'",
    "mapper_sql": f"with {scans.S} select n, case when contains(text, 't1') then 'update' else 'select' end kind, text || ' ${{x}}' text, true \"dynamic\" from s",
    "annotation_sql": f"with {scans.S} select n, 'Select' kind, regexp_replace(text, '[()]', ' ', 'g') text from s",
    "page_links": "with l as (select unnest(regexp_extract_all(html, '<a href=\"([^\"]*)\"', 1)) href from pages) select href, count(*) n from l group by href",
}
