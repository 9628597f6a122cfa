"""Tasks and agents: statistics, pages, sweeps, status updates.

Every operator takes its time as an argument; none reads the clock."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window as W, functions as F

STATUSES = ("pending", "processing", "completed", "failed")
STUCK_ERROR = "Task timed out or was interrupted"


def seconds_between(start: str, end: str) -> Column:
    micros = lambda c: F.unix_micros(F.col(c).cast("timestamp"))
    return (micros(end) - micros(start)) / 1e6


def agent_statistics(agents: DataFrame, tasks: DataFrame) -> DataFrame:
    """Counts by status and the mean duration of completed tasks, for every agent. Tasks are
    summed before the join, so only one row for each agent is shuffled; agents without a
    task keep zeros and no mean."""
    per_agent = tasks.groupBy("agent_id").agg(
        *[F.count_if(F.col("status") == s).alias(f"{s}_tasks") for s in STATUSES],
        F.count("id").alias("total_tasks"),
        F.avg(F.when(F.col("status") == "completed", seconds_between("started_at", "completed_at"))).alias("avg_duration"),
    )
    joined = agents.join(per_agent, agents["id"] == per_agent["agent_id"], "left")
    counts = [F.coalesce(f"{s}_tasks", F.lit(0)).alias(f"{s}_tasks") for s in STATUSES]
    return joined.select(agents["id"].alias("agent_id"), agents["type"].alias("agent_type"), *counts, F.coalesce("total_tasks", F.lit(0)).alias("total_tasks"), "avg_duration")


def status_counts(tasks: DataFrame, agent_id: int | None = None) -> DataFrame:
    """(status, n) for all four statuses, zero where there is none."""
    rows = tasks if agent_id is None else tasks.where(F.col("agent_id") == agent_id)
    every = tasks.sparkSession.createDataFrame([(s,) for s in STATUSES], "status string")
    found = rows.groupBy("status").agg(F.count("*").alias("n"))
    return every.join(found, "status", "left").select("status", F.coalesce("n", F.lit(0)).alias("n"))


def agent_metrics(tasks: DataFrame) -> DataFrame:
    """Status counts and their sum for each agent that has tasks."""
    counts = [F.count_if(F.col("status") == s).alias(f"{s}_tasks") for s in STATUSES]
    return tasks.groupBy("agent_id").agg(*counts, F.count("*").alias("total_tasks"))


def latest_per_agent(tasks: DataFrame, n: int = 10) -> DataFrame:
    """The n newest tasks of each agent with their rank."""
    order = W.partitionBy("agent_id").orderBy(F.col("created_at").desc(), F.col("id").desc())
    return tasks.withColumn("rank_", F.row_number().over(order)).where(F.col("rank_") <= n).select("agent_id", "id", "status", "rank_")


def system_metrics(tasks: DataFrame, agents: DataFrame, minutes_saved: int = 5) -> DataFrame:
    """One row: agents, tasks by status, efficiency in percent, hours saved."""
    a = agents.agg(F.count_if(F.col("status") == "active").alias("active_agents"), F.count("*").alias("total_agents"))
    t = tasks.agg(F.count("*").alias("total_tasks"), *[F.count_if(F.col("status") == s).alias(f"{s}_tasks") for s in STATUSES])
    done = F.col("completed_tasks") + F.col("failed_tasks")
    # One row on either side.
    return a.join(t, F.lit(True)).select(
        "*", F.when(done > 0, 100.0 * F.col("completed_tasks") / done).otherwise(0.0).alias("efficiency"), (F.col("completed_tasks") * minutes_saved / 60.0).alias("hours_saved")
    )


def task_page(tasks: DataFrame, status: str | None = None, agent_id: int | None = None, limit: int = 50, offset: int = 0) -> DataFrame:
    """One page of tasks, newest first; limits and offsets that aren't positive are ignored."""
    rows = tasks
    if agent_id is not None:
        rows = rows.where(F.col("agent_id") == agent_id)
    if status is not None:
        rows = rows.where(F.col("status") == status)
    rows = rows.orderBy(F.col("created_at").desc(), F.col("id").desc())
    if offset > 0:
        rows = rows.offset(offset)
    return rows.limit(limit) if limit > 0 else rows


def matching_count(tasks: DataFrame, status: str | None = None, agent_id: int | None = None) -> DataFrame:
    """How many tasks the pages hold in all."""
    return task_page(tasks, status, agent_id, 0, 0).agg(F.count("*").alias("n"))


def is_stuck(as_of: Column, hours: int = 1) -> Column:
    since = as_of - F.expr(f"INTERVAL '{hours}' HOUR")
    return (F.col("status") == "processing") & ((F.col("started_at") < since) | (F.col("started_at").isNull() & (F.col("created_at") < since)))


def stuck_tasks(tasks: DataFrame, as_of: Column, hours: int = 1) -> DataFrame:
    """(id, action, status, error) of tasks in processing for longer than `hours`; a task that
    never started counts from its creation."""
    return tasks.where(is_stuck(as_of, hours)).select("id", "action", F.lit("failed").alias("status"), F.lit(STUCK_ERROR).alias("error"))


def sweep(tasks: DataFrame, as_of: Column, hours: int = 1) -> DataFrame:
    """All tasks after the sweep: the stuck ones failed, completed at as_of."""
    stuck = is_stuck(as_of, hours)
    return tasks.withColumns({"completed_at": F.when(stuck, as_of).otherwise(F.col("completed_at")), "status": F.when(stuck, "failed").otherwise(F.col("status"))})


def activity_log(tasks: DataFrame, n: int | None = None) -> DataFrame:
    """Tasks as log entries; with n the newest n."""
    level = F.when(F.col("status") == "failed", "error").when(F.col("status") == "completed", "success").otherwise("processing")
    rows = tasks.select("id", "agent_id", level.alias("level"), F.concat_ws(": ", "action", "status").alias("message"), "created_at")
    return rows if n is None else rows.orderBy(F.col("created_at").desc(), F.col("id").desc()).limit(n)


def update_status(tasks: DataFrame, changes: DataFrame, as_of: Column) -> DataFrame:
    """Tasks after changes (id, new_status): started_at is set if it was null and the task now
    runs, completed_at when it ends; tasks without a change stay as they are."""
    both = tasks.join(changes.select("id", "new_status"), "id", "left")
    new = F.col("new_status")
    return both.select(
        "id", "agent_id", "action", F.coalesce(new, F.col("status")).alias("status"), "priority", "created_at",
        F.when(new.isin("processing", "completed", "failed"), F.coalesce("started_at", as_of)).otherwise(F.col("started_at")).alias("started_at"),
        F.when(new.isin("completed", "failed"), as_of).otherwise(F.col("completed_at")).alias("completed_at"),
    )


def finish(tasks: DataFrame, ends: DataFrame, as_of: Column) -> DataFrame:
    """Tasks after they end: ends (id, output, error) has one row for each that did. With an error
    they are failed, else completed with the output; all end at as_of."""
    done = ends.select("id", F.col("output").alias("new_output"), F.col("error").alias("new_error"), F.lit(True).alias("done_"))
    ended = F.col("done_").isNotNull()
    new = lambda c: F.when(ended, F.col(f"new_{c}")).otherwise(F.col(c) if c in tasks.columns else F.lit(None).cast("string"))
    return tasks.join(done, "id", "left").select(
        *[c for c in tasks.columns if c not in ("status", "completed_at", "output", "error")],
        F.when(F.col("new_error").isNotNull(), "failed").when(ended, "completed").otherwise(F.col("status")).alias("status"),
        F.when(ended, as_of).otherwise(F.col("completed_at")).alias("completed_at"), new("output").alias("output"), new("error").alias("error"),
    )


def append_rows(log: DataFrame, new: DataFrame, as_of: Column) -> DataFrame:
    """A log (audit entries, messages) with new rows at its end, stamped as_of."""
    return log.unionByName(new.withColumn("timestamp", as_of), allowMissingColumns=True)


def page_bounds(total: Column, page: Column, limit: int) -> dict[str, Column]:
    """offset, number of pages, and whether a page (from 1 on) has one before and one behind it."""
    return {"offset": (page - 1) * limit, "pages": F.ceil(total / limit), "has_previous": page > 1, "has_next": page * limit < total}


def of_kind(rows: DataFrame, kind: str | None, col: str = "type", limit: int | None = None) -> DataFrame:
    """Rows whose col is kind, whatever the case; None and All take every row. With limit the
    newest ones."""
    kept = rows if kind is None or kind.lower() == "all" else rows.where(F.lower(col) == kind.lower())
    return kept if limit is None else kept.orderBy(F.col("created_at").desc(), F.col("id").desc()).limit(limit)


def merge_fields(old: DataFrame, changes: DataFrame, key: str = "id", as_of: Column | None = None) -> DataFrame:
    """Rows of old with the non-null fields of changes put in their place (a partial update).
    With as_of, updated_at of every row that has a change is set, even of one without fields."""
    if as_of is not None:
        changes = changes.withColumn("updated_at", as_of)
    fields = [c for c in changes.columns if c != key]
    new = changes.select(key, *[F.col(c).alias(f"new_{c}") for c in fields])
    both = old.join(new, key, "left")
    return both.select(*[F.coalesce(f"new_{c}", c).alias(c) if c in fields else F.col(c) for c in old.columns])


def insert_tasks(tasks: DataFrame, new: DataFrame, as_of: Column) -> DataFrame:
    """tasks with new ones (id, agent_id, action, priority) appended as pending."""
    made = new.select("id", "agent_id", "action", F.lit("pending").alias("status"), "priority", as_of.alias("created_at"))
    return tasks.unionByName(made, allowMissingColumns=True)


def task_rollup(tasks: DataFrame) -> DataFrame:
    """Counts by agent and status with subtotals and the total."""
    return tasks.rollup("agent_id", "status").agg(F.count("*").alias("n"))


def field_domains(tasks: DataFrame) -> DataFrame:
    """Tasks whose status or priority is outside its domain."""
    return tasks.where(~F.col("status").isin(*STATUSES) | ~F.col("priority").isin("low", "medium", "high", "urgent"))


def mark_status(tasks: DataFrame, changes: DataFrame, as_of: Column) -> DataFrame:
    """Tasks after changes (id, new_status) by the simple rule: started_at is as_of every time."""
    both = tasks.join(changes.select("id", "new_status"), "id", "left")
    changed = F.col("new_status").isNotNull()
    return both.withColumns({"status": F.coalesce("new_status", "status"), "started_at": F.when(changed, as_of).otherwise(F.col("started_at"))}).select(*tasks.columns)
