"""Reconciliation queries: orders against a damaged copy of themselves."""

from __future__ import annotations

from pyspark.sql import functions as F

from siltstone.operators import narrowing, reconcile
from siltstone.session import fresh_path, table
from siltstone.sources import jdbc


def source(spark, sf_dir):
    return table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey", "o_orderstatus", "o_totalprice", "o_orderpriority")


def target(spark, sf_dir):
    """Finished urgent orders are lost, partial low ones cost more."""
    dear = (F.col("o_orderstatus") == "P") & (F.col("o_orderpriority") == "5-LOW")
    rows = source(spark, sf_dir).where("not (o_orderstatus = 'F' and o_orderpriority = '1-URGENT')")
    return rows.withColumn("o_totalprice", F.when(dear, F.col("o_totalprice") + 1).otherwise(F.col("o_totalprice")))


def row_parity(spark, sf_dir):
    return reconcile.row_parity(source(spark, sf_dir), target(spark, sf_dir))


def except_diff(spark, sf_dir):
    return reconcile.except_diff(target(spark, sf_dir), source(spark, sf_dir), ["o_orderkey"])


def range_profile(spark, sf_dir):
    return reconcile.range_profile(table(spark, sf_dir, "lineitem"))


def recon_report(spark, sf_dir):
    return reconcile.difference(source(spark, sf_dir), target(spark, sf_dir), "o_orderkey")


def schema_diff(spark, sf_dir):
    """The copy's schema with one type changed and one column less, next to how many rows each side has."""
    a, b = source(spark, sf_dir), target(spark, sf_dir).drop("o_custkey").withColumn("o_totalprice", F.col("o_totalprice").cast("decimal(20,4)"))
    rows = a.agg(F.count(F.lit(1)).alias("source_rows")).join(b.agg(F.count(F.lit(1)).alias("target_rows")), how="cross")
    return reconcile.schema_diff(a, b).join(F.broadcast(rows), how="cross")


def type_cast_copy(spark, sf_dir):
    """Orders as an older database holds them, cast on the way."""
    old = table(spark, sf_dir, "orders").select(
        "o_orderkey", F.when(F.col("o_orderpriority") == "5-LOW", "0000-00-00 00:00:00").otherwise(F.date_format("o_orderdate", "yyyy-MM-dd HH:mm:ss")).alias("d"),
        F.when(F.col("o_orderstatus") == "F", "1").otherwise("0").alias("flag"), F.when(F.col("o_orderstatus") == "P", "n/a").otherwise(F.col("o_totalprice").cast("decimal(20,2)").cast("string")).alias("price"),
    )
    cast = reconcile.cast_rule
    return old.select("o_orderkey", F.date_format(cast(F.col("d"), "DATE"), "yyyy-MM-dd HH:mm:ss").alias("ordered"), cast(F.col("flag"), "TINYINT(1)").alias("done"), cast(F.col("price"), "NUMBER").cast("double").alias("price"))


def table_copy(spark, sf_dir):
    """Full copy in key ranges through shared storage, then read back."""
    path = fresh_path(spark, "table-copy")
    table(spark, sf_dir, "lineitem").repartitionByRange(8, "l_orderkey").write.option("maxRecordsPerFile", 50_000).parquet(path)
    copy = spark.read.parquet(path)
    whole = reconcile.row_parity(table(spark, sf_dir, "lineitem"), copy).agg((F.min("n") == F.max("n")).alias("complete"))
    sums = copy.groupBy("l_returnflag", "l_linestatus").agg(
        F.count(F.lit(1)).alias("n"), F.round(F.sum("l_extendedprice"), 2).alias("price"), F.sum(F.col("l_orderkey") * 7 + F.col("l_partkey") * 5 + F.col("l_suppkey") * 3 + F.col("l_linenumber")).alias("keys"), F.min(F.date_format("l_shipdate", "yyyy-MM-dd")).alias("first_shipped"),
    )
    return sums.join(F.broadcast(whole), how="cross")  # one row


def local_damage(spark, sf_dir):
    """A copy in which some stretches of keys have lost, changed or more rows, stored in order of the keys next to its source."""
    a, b = fresh_path(spark, "ordered-source"), fresh_path(spark, "ordered-target")
    rows = source(spark, sf_dir)
    rows.repartitionByRange("o_orderkey").sortWithinPartitions("o_orderkey").write.parquet(a)
    hurt, k = F.col("o_orderkey") % 10007 < 40, F.col("o_orderkey")
    kept = rows.where(~hurt | (k % 3 != 0)).withColumn("o_totalprice", F.when(hurt & (k % 3 == 1), F.col("o_totalprice") + 1).otherwise(F.col("o_totalprice")))
    more = rows.where(hurt & (k % 3 == 2)).withColumn("o_orderkey", -k - 1)
    kept.unionByName(more).repartitionByRange("o_orderkey").sortWithinPartitions("o_orderkey").write.parquet(b)
    return spark.read.parquet(a), spark.read.parquet(b)


def except_by_ranges(spark, sf_dir):
    a, b = local_damage(spark, sf_dir)
    return narrowing.except_diff(b, a, "o_orderkey", ["o_orderkey"])


def recon_by_ranges(spark, sf_dir):
    a, b = local_damage(spark, sf_dir)
    return narrowing.difference(a, b, "o_orderkey")


def jdbc_copy(spark, sf_dir):
    """Orders in a database, a third of them of one customer, copied out in even ranges; the database is an embedded one, so the master must be local."""
    home = fresh_path(spark, "database").removeprefix("file:")
    url, options = f"jdbc:derby:;databaseName={home};create=true", {"driver": "org.apache.derby.jdbc.EmbeddedDriver"}
    spark._jvm.java.lang.System.setProperty("derby.stream.error.file", f"{home}.log")
    rows = source(spark, sf_dir).withColumn("o_custkey", F.when(F.col("o_orderkey") % 3 == 0, 7).when(F.col("o_orderkey") % 11 != 0, F.col("o_custkey")).cast("long"))
    rows.write.format("jdbc").options(url=url, dbtable="orders_in", batchsize="5000", **options).save()
    step = rows.count() // 12 + 1
    copied = jdbc.copy(spark, url, "orders_in", options, fresh_path(spark, "jdbc-copy"), "o_custkey", "o_orderkey", step)
    largest = copied.groupBy("_range").agg(F.count(F.lit(1)).alias("n")).agg((F.max("n") <= 2 * step).alias("even"))
    sums = copied.groupBy("o_orderstatus").agg(F.count(F.lit(1)).alias("n"), F.round(F.sum("o_totalprice"), 2).alias("price"), F.sum(F.col("o_orderkey") * 3 + F.coalesce("o_custkey", F.lit(-1))).alias("keys"))
    return sums.join(F.broadcast(largest), how="cross")  # one row


def changes(spark, sf_dir):
    return table(spark, sf_dir, "events").select(F.col("user_id").alias("id"), F.col("event_id").alias("seq"), (F.col("event_type") == "error").alias("deleted"), "event_type", "value")


def cdc_latest(spark, sf_dir):
    return reconcile.latest(changes(spark, sf_dir), "id", "seq").select("id", "seq", "deleted", "event_type", "value")


def cdc_merge(spark, sf_dir):
    """A snapshot of all customers as of sequence -1, then all events as changes with a new column."""
    start = table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("id"), F.lit(-1).cast("long").alias("seq"), F.col("c_acctbal").alias("value"))
    return reconcile.present(reconcile.merge(start, changes(spark, sf_dir), "id", "seq", "deleted")).select("id", "seq", "event_type", "value")


QUERIES = {f.__name__: f for f in (except_by_ranges, recon_by_ranges, row_parity, except_diff, range_profile, recon_report, schema_diff, type_cast_copy, table_copy, jdbc_copy, cdc_latest, cdc_merge)}

S = """s as (select o_orderkey, o_custkey, o_orderstatus, o_totalprice, o_orderpriority from orders),
t as (select o_orderkey, o_custkey, o_orderstatus, case when o_orderstatus = 'P' and o_orderpriority = '5-LOW' then o_totalprice + 1 else o_totalprice end o_totalprice, o_orderpriority from s where not (o_orderstatus = 'F' and o_orderpriority = '1-URGENT'))"""
LATEST = "c as (select user_id id, event_id seq, event_type = 'error' deleted, event_type, value from events qualify row_number() over (partition by user_id order by event_id desc) = 1)"
PROFILE = " union all ".join(f"select '{c}' column_name, min({c})::DOUBLE low, max({c})::DOUBLE high, round(avg({c}::DOUBLE), 6) mean from lineitem" for c in ("l_orderkey", "l_partkey", "l_suppkey", "l_linenumber", "l_quantity", "l_extendedprice", "l_discount", "l_tax"))
HURT = """s as (select o_orderkey, o_custkey, o_orderstatus, o_totalprice, o_orderpriority from orders),
t as (select o_orderkey, o_custkey, o_orderstatus, case when o_orderkey % 10007 < 40 and o_orderkey % 3 = 1 then o_totalprice + 1 else o_totalprice end o_totalprice, o_orderpriority from s where not (o_orderkey % 10007 < 40 and o_orderkey % 3 = 0)
 union all select -o_orderkey - 1, o_custkey, o_orderstatus, o_totalprice, o_orderpriority from s where o_orderkey % 10007 < 40 and o_orderkey % 3 = 2)"""
ORACLES = {
    "except_by_ranges": f"with {HURT} select * from (select * from t except select * from s) order by o_orderkey limit 100",
    "recon_by_ranges": f"""with {HURT}, b as (select s.o_orderkey sk, t.o_orderkey tk, (s.o_custkey, s.o_orderstatus, s.o_totalprice, s.o_orderpriority) is distinct from (t.o_custkey, t.o_orderstatus, t.o_totalprice, t.o_orderpriority) d from s full join t using (o_orderkey)),
        n as (select count(sk) source_rows, count(tk) target_rows, count(*) filter (where tk is null) missing, count(*) filter (where sk is null) extra, count(*) filter (where sk is not null and tk is not null and d) changed from b)
        select *, round(abs(source_rows - target_rows) / greatest(source_rows, 1), 6) row_delta, abs(source_rows - target_rows) / greatest(source_rows, 1) < 0.05 "within" from n""",
    "jdbc_copy": """with k as (select o_orderstatus, o_totalprice, o_orderkey, case when o_orderkey % 3 = 0 then 7 when o_orderkey % 11 <> 0 then o_custkey end c from orders)
        select o_orderstatus, count(*) n, round(sum(o_totalprice), 2) price, sum(o_orderkey * 3 + coalesce(c, -1))::BIGINT keys, true "even" from k group by o_orderstatus""",
    "row_parity": f"with {S} select 'source' side, count(*) n from s union all select 'target', count(*) from t",
    "except_diff": f"with {S} select * from (select * from t except select * from s) order by o_orderkey limit 100",
    "range_profile": PROFILE,
    "recon_report": f"""with {S}, r as (select (select count(*) from s) source_rows, (select count(*) from t) target_rows, (select count(*) from s where o_orderkey not in (select o_orderkey from t)) missing, 0::BIGINT extra,
        (select count(*) from s join t using (o_orderkey) where s.o_totalprice <> t.o_totalprice) changed)
        select *, round(abs(source_rows - target_rows) / source_rows, 6) row_delta, abs(source_rows - target_rows) / source_rows < 0.05 as "within" from r""",
    "schema_diff": f"""with {S}, k as (select * from (values ('o_orderkey', 'bigint', 'bigint'), ('o_custkey', 'bigint', null), ('o_orderstatus', 'string', 'string'), ('o_totalprice', 'double', 'decimal(20,4)'), ('o_orderpriority', 'string', 'string')) v(column_name, source_type, target_type))
        select *, source_type is not distinct from target_type same, null::INT source_precision, null::INT source_scale, case when target_type like 'decimal%' then 20 end::INT target_precision, case when target_type like 'decimal%' then 4 end::INT target_scale, (select count(*) from s) source_rows, (select count(*) from t) target_rows from k""",
    "type_cast_copy": "select o_orderkey, case when o_orderpriority <> '5-LOW' then strftime(o_orderdate, '%Y-%m-%d %H:%M:%S') end ordered, o_orderstatus = 'F' done, case when o_orderstatus <> 'P' then round(o_totalprice, 2) end price from orders",
    "table_copy": "select l_returnflag, l_linestatus, count(*) n, round(sum(l_extendedprice), 2) price, sum(l_orderkey * 7 + l_partkey * 5 + l_suppkey * 3 + l_linenumber)::BIGINT keys, strftime(min(l_shipdate), '%Y-%m-%d') first_shipped, true complete from lineitem group by all",
    "cdc_latest": f"with {LATEST} from c",
    "cdc_merge": f"with {LATEST} select c_custkey id, -1::BIGINT seq, null::VARCHAR event_type, c_acctbal as value from customer where c_custkey not in (select id from c) union all select id, seq, event_type, value from c where not deleted",
}
