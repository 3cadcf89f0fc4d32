"""Task queries: customers are tasks, nations projects, orders suggestions, events steps."""

from __future__ import annotations

from pyspark.sql import Window, functions as F

from siltstone.operators import tasks
from siltstone.session import table


def task_rows(spark, sf_dir):
    return table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("id"), F.col("c_nationkey").alias("project_id"), F.col("c_name").alias("name"), F.col("c_mktsegment").alias("status"))


def suggestions(spark, sf_dir):
    return table(spark, sf_dir, "orders").select(
        F.col("o_orderkey").alias("id"), F.col("o_custkey").alias("task_id"), F.col("o_orderstatus").alias("category"), F.col("o_orderpriority").alias("risk_level"),
        F.least(F.lit(1.0), F.col("o_totalprice") / 500000).alias("confidence"), (F.col("o_totalprice") < 100000).alias("needs_review"), F.col("o_orderdate").alias("created_at"),
    )


def steps(spark, sf_dir):
    return table(spark, sf_dir, "events").select(F.col("event_id").alias("id"), F.col("user_id").alias("task_id"), F.col("event_type").alias("stage"), F.col("value").alias("elapsed"), F.when(F.col("event_type") == "error", "FAIL").otherwise("OK").alias("status"), (F.col("event_id") % 1000).alias("tokens"), F.round(F.col("event_id") % 11 / 10.0, 1).alias("confidence"), "ts")


def task_list(spark, sf_dir):
    return task_rows(spark, sf_dir)


def task_by_key(spark, sf_dir):
    """A point lookup for the largest id there is."""
    rows = task_rows(spark, sf_dir)
    return rows.join(rows.agg(F.max("id").alias("id")), "id")


def task_lookup(spark, sf_dir):
    """Lookups of the tasks that orders name, and of one that is not there for each nation."""
    wanted = table(spark, sf_dir, "orders").select(F.col("o_custkey").alias("id")).distinct().unionByName(table(spark, sf_dir, "nation").select((-F.col("n_nationkey") - 1).cast("long").alias("id")))
    return tasks.lookup(task_rows(spark, sf_dir), wanted, "id")


def tasks_of_project(spark, sf_dir):
    rows = task_rows(spark, sf_dir).where("project_id = 7")
    return rows.withColumn("place", F.row_number().over(Window.partitionBy("project_id").orderBy(F.desc("id"))))


def suggestions_of_task(spark, sf_dir):
    return suggestions(spark, sf_dir).withColumn("place", F.row_number().over(Window.partitionBy("task_id").orderBy("id"))).select("task_id", "id", "place")


def recent_tasks(spark, sf_dir):
    return task_rows(spark, sf_dir).orderBy(F.desc("id")).limit(5)


def patch_aggregate(spark, sf_dir):
    return tasks.patch_set(suggestions(spark, sf_dir), ["task_id"])


def by_category(spark, sf_dir):
    return tasks.patch_set(suggestions(spark, sf_dir), ["category", "risk_level"])


def batch_summary(spark, sf_dir):
    return steps(spark, sf_dir).agg(F.count(F.lit(1)).alias("total"), F.count_if(F.col("status") == "OK").alias("ok"), F.count_if(F.col("status") == "FAIL").alias("fail"))


def report_stats(spark, sf_dir):
    high = F.col("risk_level").isin("1-URGENT", "2-HIGH")
    return suggestions(spark, sf_dir).agg(
        F.count(F.lit(1)).alias("total"), F.count_if(~F.col("needs_review")).alias("success"), F.count_if(F.col("needs_review")).alias("manual"), F.count_if(high).alias("high_risk"), F.countDistinct("task_id").alias("tables"), F.count_if(F.col("category") == "P").alias("indexes_changed"),
    )


def dashboard_kpis(spark, sf_dir):
    """Counts of today, the last day with suggestions, and of all time."""
    rows = suggestions(spark, sf_dir).withColumn("day", F.to_date("created_at"))
    last = rows.agg(F.max("day").alias("last"))
    return rows.join(F.broadcast(last), how="cross").agg(F.count(F.lit(1)).alias("suggestions"), F.count_if(F.col("day") == F.col("last")).alias("today"), F.countDistinct("task_id").alias("active_tasks"), F.round(F.avg("confidence"), 6).alias("mean_confidence"))


def risk_distribution(spark, sf_dir):
    return tasks.share(suggestions(spark, sf_dir), "risk_level")


def daily_trend(spark, sf_dir):
    return tasks.on_every_day(tasks.daily(suggestions(spark, sf_dir), "created_at", "suggestions"), "suggestions").select(F.date_format("day", "yyyy-MM-dd").alias("day"), "suggestions")


def week_delta(spark, sf_dir):
    """Steps of each week against the week before."""
    weeks = steps(spark, sf_dir).groupBy(F.date_format(F.date_trunc("week", "ts"), "yyyy-MM-dd").alias("week")).agg(F.count(F.lit(1)).alias("n"))
    return weeks.withColumn("change", F.col("n") - F.lag("n").over(Window.orderBy("week")))  # a row for each week


def stage_metrics(spark, sf_dir):
    return tasks.stage_metrics(steps(spark, sf_dir), "stage")


def workflow_outcome(spark, sf_dir):
    return tasks.outcomes(steps(spark, sf_dir), "task_id")


def fail_stop(spark, sf_dir):
    return tasks.until_failure(steps(spark, sf_dir), "task_id", ["ts", "id"]).select("task_id", "id", "stage", "status")


def step_progress(spark, sf_dir):
    place = F.row_number().over(Window.partitionBy("task_id").orderBy("ts", "id"))
    return steps(spark, sf_dir).select("task_id", "id", place.alias("n")).select("task_id", "id", "n", tasks.percent(F.col("n")).alias("percent"))


def risk_rollup(spark, sf_dir):
    """Risks by category and severity; the overall risk is the worst one found. Priorities start with their order."""
    rows = suggestions(spark, sf_dir).groupBy("category", "risk_level").agg(F.count(F.lit(1)).alias("n"))
    return rows.withColumn("worst_in_category", F.min("risk_level").over(Window.partitionBy("category")))


QUERIES = {f.__name__: f for f in (task_list, task_by_key, task_lookup, tasks_of_project, suggestions_of_task, recent_tasks, patch_aggregate, by_category, batch_summary, report_stats, dashboard_kpis, risk_distribution, daily_trend, week_delta, stage_metrics, workflow_outcome, fail_stop, step_progress, risk_rollup)}

T = "t as (select c_custkey id, c_nationkey project_id, c_name as name, c_mktsegment status from customer)"
G = "g as (select o_orderkey id, o_custkey task_id, o_orderstatus category, o_orderpriority risk_level, least(1.0, o_totalprice / 500000) confidence, o_totalprice < 100000 needs_review, o_orderdate created_at from orders)"
P = "p as (select event_id id, user_id task_id, event_type stage, value elapsed, case when event_type = 'error' then 'FAIL' else 'OK' end status, event_id % 1000 tokens, event_id % 11 / 10.0 confidence, ts from events)"
SET = "count(*) total, round(avg(confidence), 6) mean_confidence, count(*) filter (needs_review) review"
ORACLES = {
    "task_list": f"with {T} from t",
    "task_by_key": f"with {T} select * from t where id = (select max(id) from t)",
    "task_lookup": f"with {T}, w as (select distinct o_custkey id from orders union all select -n_nationkey - 1 from nation) select w.id, project_id, name, status, case when t.id is null then 'not found' end error from w left join t using (id)",
    "tasks_of_project": f"with {T} select *, (row_number() over (order by id desc))::INT place from t where project_id = 7",
    "suggestions_of_task": f"with {G} select task_id, id, (row_number() over (partition by task_id order by id))::INT place from g",
    "recent_tasks": f"with {T} select * from t order by id desc limit 5",
    "patch_aggregate": f"with {G} select task_id, {SET} from g group by task_id",
    "by_category": f"with {G} select category, risk_level, {SET} from g group by all",
    "batch_summary": f"with {P} select count(*) total, count(*) filter (status = 'OK') ok, count(*) filter (status = 'FAIL') fail from p",
    "report_stats": f"with {G} select count(*) total, count(*) filter (not needs_review) success, count(*) filter (needs_review) manual, count(*) filter (risk_level in ('1-URGENT', '2-HIGH')) high_risk, count(distinct task_id) tables, count(*) filter (category = 'P') indexes_changed from g",
    "dashboard_kpis": f"with {G} select count(*) suggestions, count(*) filter (created_at::DATE = (select max(created_at)::DATE from g)) today, count(distinct task_id) active_tasks, round(avg(confidence), 6) mean_confidence from g",
    "risk_distribution": f"with {G} select risk_level, count(*) n, round(count(*) / sum(count(*)) over (), 6) share from g group by risk_level",
    "daily_trend": f"""with {G}, d as (select created_at::DATE d, count(*) n from g group by 1), s as (select unnest(generate_series((select min(d) from d), (select max(d) from d), interval 1 day))::DATE d)
        select strftime(s.d, '%Y-%m-%d') as day, coalesce(n, 0) suggestions from s left join d using (d)""",
    "week_delta": f"with {P}, w as (select strftime(date_trunc('week', ts), '%Y-%m-%d') as \"week\", count(*) n from p group by 1) select week as \"week\", n, n - lag(n) over (order by week) change from w",
    "stage_metrics": f"with {P} select stage, count(*) steps, round(avg(elapsed), 6) mean_elapsed, max(elapsed) max_elapsed, count(*) filter (status = 'FAIL') failed, sum(tokens)::BIGINT tokens, round(avg(confidence), 6) mean_confidence from p group by stage",
    "workflow_outcome": f"with {P} select task_id, count(*) steps, case when bool_and(status = 'OK') then 'success' else 'partial' end outcome from p group by task_id",
    "fail_stop": f"with {P} select task_id, id, stage, status from p qualify coalesce(count(*) filter (status = 'FAIL') over (partition by task_id order by ts, id rows between unbounded preceding and 1 preceding), 0) = 0",
    "step_progress": f"with {P}, r as (select task_id, id, (row_number() over (partition by task_id order by ts, id))::INT n from p) select task_id, id, n, least(100, floor(n * 100 / 6 + 0.5))::INT percent from r",
    "risk_rollup": f"with {G}, r as (select category, risk_level, count(*) n from g group by all) select *, min(risk_level) over (partition by category) worst_in_category from r",
}
