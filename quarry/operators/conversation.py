"""Jobs, conversations and event streams reduced to their state."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

JOB_STATES = ("queued", "running", "succeeded", "failed")
TERMINAL = ("complete", "error")
#: Phases of a job in order; fixed values.
PHASES = ("cloning", "parsing", "graph", "summaries", "embeddings")
COMPACT_AT, CONTEXT_MESSAGES, TOOL_BUDGET = 2000, 10, 2


def job_states(events: DataFrame) -> DataFrame:
    """job_id, status, phase, updated_at: the last event of each job (job_id, status, phase, ts, seq); a terminal state is never left."""
    rank = F.struct(F.col("status").isin("succeeded", "failed").cast("int").alias("t"), F.col("ts"), F.col("seq"))
    last = events.groupBy("job_id").agg(F.max_by(F.struct("status", "phase", "ts"), rank).alias("s"))
    return last.select("job_id", F.col("s.status").alias("status"), F.col("s.phase").alias("phase"), F.col("s.ts").alias("updated_at"))


def job_percent(phase: Column, status: Column) -> Column:
    """Percent of a job by the place of its phase, 100 for a job that succeeded."""
    at = F.array_position(F.array(*[F.lit(p) for p in PHASES]), phase)
    return F.when(status == "succeeded", 100).otherwise(F.least(F.round(F.coalesce(at, F.lit(0)) / len(PHASES) * 100).cast("int"), F.lit(100)))


def recent(messages: DataFrame, n: int = CONTEXT_MESSAGES, key: str = "conv_id", order: str = "turn") -> DataFrame:
    """The last n messages of each conversation, oldest first within it."""
    w = Window.partitionBy(key).orderBy(F.desc(order))
    return messages.withColumn("_n", F.row_number().over(w)).filter(F.col("_n") <= n).drop("_n").orderBy(key, order)


def latest(rows: DataFrame, key: str, order: str, tie: str) -> DataFrame:
    """The newest row of each key."""
    w = Window.partitionBy(key).orderBy(F.desc(order), F.desc(tie))
    return rows.withColumn("_n", F.row_number().over(w)).filter("_n = 1").drop("_n")


def compaction_points(messages: DataFrame, limit: int = COMPACT_AT) -> DataFrame:
    """conv_id, turn, running_chars, included: characters so far in a conversation; from the message that reaches the limit on, history before it is to be replaced by a summary."""
    w = Window.partitionBy("conv_id").orderBy("turn")
    running = messages.withColumn("running_chars", F.sum(F.length(F.coalesce("text", F.lit("")))).over(w.rowsBetween(Window.unboundedPreceding, 0)))
    first = F.min(F.when(F.col("running_chars") >= limit, F.col("turn"))).over(Window.partitionBy("conv_id"))
    return running.select("conv_id", "turn", "running_chars", F.coalesce(F.col("turn") >= first, F.lit(True)).alias("included"))


def context(summaries: DataFrame, messages: DataFrame, current: DataFrame, n: int = CONTEXT_MESSAGES) -> DataFrame:
    """conv_id, position, role, text: the summary first, then the last messages, then the current one."""
    s = summaries.select("conv_id", F.lit(0).alias("part"), F.lit(0).cast("bigint").alias("turn"), F.lit("system").alias("role"), F.col("summary").alias("text"))
    m = recent(messages, n).select("conv_id", F.lit(1).alias("part"), F.col("turn").cast("bigint").alias("turn"), "role", "text")
    c = current.select("conv_id", F.lit(2).alias("part"), F.lit(0).cast("bigint").alias("turn"), F.lit("user").alias("role"), "text")
    w = Window.partitionBy("conv_id").orderBy("part", "turn")
    return s.unionByName(m).unionByName(c).select("conv_id", F.row_number().over(w).alias("position"), "role", "text")


def stream_texts(events: DataFrame) -> DataFrame:
    """session_id, text, n_tools, state: the deltas of each session joined in order, its tool calls counted, and how it ended.

    events: session_id, seq, event_type (delta, tool_call, complete, error), delta. What comes after the first terminal event is left out.
    """
    w = Window.partitionBy("session_id").orderBy("seq").rowsBetween(Window.unboundedPreceding, -1)
    ended = F.coalesce(F.max(F.col("event_type").isin(*TERMINAL).cast("int")).over(w), F.lit(0))
    live = events.withColumn("_e", ended).filter("_e = 0")
    deltas = F.array_sort(F.collect_list(F.when(F.col("event_type") == "delta", F.struct("seq", "delta"))))
    grouped = live.groupBy("session_id").agg(F.array_join(F.transform(deltas, lambda x: x["delta"]), "").alias("text"), F.count_if(F.col("event_type") == "tool_call").alias("n_tools"), F.max(F.when(F.col("event_type").isin(*TERMINAL), F.col("event_type"))).alias("end"))
    return grouped.select("session_id", "text", "n_tools", F.coalesce("end", F.lit("streaming")).alias("state"))


def tool_status(events: DataFrame) -> DataFrame:
    """session_id, tool_id, status: the furthest state of each tool call, streaming, pending, executing, completed or failed."""
    order = F.array(*[F.lit(x) for x in ("streaming", "pending", "executing", "completed", "failed")])
    return events.groupBy("session_id", "tool_id").agg(F.max_by("status", F.array_position(order, F.col("status"))).alias("status"))


def over_budget(calls: DataFrame, budget: int = TOOL_BUDGET, timeout_s: int = 30) -> DataFrame:
    """The calls (session_id, seq, seconds) with their number in the session, and whether they exceed the budget or the time."""
    w = Window.partitionBy("session_id").orderBy("seq")
    return calls.withColumn("call_no", F.row_number().over(w)).withColumn("over_budget", F.col("call_no") > budget).withColumn("timed_out", F.col("seconds") > timeout_s)


def webhook_records(payloads: DataFrame) -> DataFrame:
    """delivery_id, event, repository, detail, n_commits, valid: small records of webhook payloads (delivery_id, event, body).

    A push names its branch without ``refs/heads/``. Bodies that are no object, and events without a rule, are kept as invalid.
    """
    schema = "action string, ref string, repository struct<full_name:string>, commits array<struct<id:string>>, installation struct<id:bigint>, pull_request struct<number:bigint>, issue struct<number:bigint>"
    p = payloads.withColumn("j", F.from_json("body", schema))
    detail = (
        F.when(F.col("event") == "push", F.regexp_replace("j.ref", "^refs/heads/", ""))
        .when(F.col("event") == "pull_request", F.concat_ws("#", "j.action", F.col("j.pull_request.number").cast("string")))
        .when(F.col("event") == "issues", F.concat_ws("#", "j.action", F.col("j.issue.number").cast("string")))
        .when(F.col("event").isin("installation", "repository"), F.col("j.action"))
    )
    return p.select("delivery_id", "event", F.col("j.repository.full_name").alias("repository"), detail.alias("detail"), F.coalesce(F.size("j.commits"), F.lit(0)).alias("n_commits"), (F.col("j").isNotNull() & detail.isNotNull()).alias("valid"))


def push_commits(payloads: DataFrame) -> DataFrame:
    """delivery_id, commit_id: one row per commit of the pushes."""
    j = F.from_json("body", "commits array<struct<id:string>>")
    return payloads.filter("event = 'push'").select("delivery_id", F.explode(j["commits"]).alias("c")).select("delivery_id", F.col("c.id").alias("commit_id"))


def message_states(events: DataFrame) -> DataFrame:
    """session_id, turn, text, n_tools, n_open_tools, state: the state of each message of a conversation.

    events: session_id, seq, event_type (user, delta, tool_call, tool_result, complete, error), delta, tool_id. A user's event opens a turn;
    what follows up to the next one is the answer's message. Deltas are joined in order, a tool is open until its result comes, and what
    comes after a turn's first terminal event is left out.
    """
    opened = Window.partitionBy("session_id").orderBy("seq").rowsBetween(Window.unboundedPreceding, 0)
    turn = F.sum((F.col("event_type") == "user").cast("int")).over(opened)
    placed = events.withColumn("turn", turn)
    before = Window.partitionBy("session_id", "turn").orderBy("seq").rowsBetween(Window.unboundedPreceding, -1)
    ended = F.coalesce(F.max(F.col("event_type").isin(*TERMINAL).cast("int")).over(before), F.lit(0))
    live = placed.withColumn("_e", ended).filter("_e = 0")
    deltas = F.array_sort(F.collect_list(F.when(F.col("event_type") == "delta", F.struct("seq", "delta"))))
    called = F.collect_set(F.when(F.col("event_type") == "tool_call", F.col("tool_id")))
    answered = F.collect_set(F.when(F.col("event_type") == "tool_result", F.col("tool_id")))
    grouped = live.groupBy("session_id", "turn").agg(
        F.array_join(F.transform(deltas, lambda x: x["delta"]), "").alias("text"), F.size(called).alias("n_tools"), F.size(F.array_except(called, answered)).alias("n_open_tools"),
        F.max(F.when(F.col("event_type").isin(*TERMINAL), F.col("event_type"))).alias("end"),
    )
    return grouped.select("session_id", "turn", "text", "n_tools", "n_open_tools", F.coalesce("end", F.lit("streaming")).alias("state"))


def message_history(messages: DataFrame, conversations: DataFrame, n: int | None = None) -> DataFrame:
    """conv_id, title, turn, role, text: the messages (conv_id, turn, role, text) of conversations (conv_id, title) that exist, in order, the last n of each."""
    rows = messages if n is None else recent(messages, n)
    return rows.join(conversations.select("conv_id", "title").dropDuplicates(["conv_id"]), "conv_id").select("conv_id", "title", "turn", "role", "text")


def append_messages(messages: DataFrame, new: DataFrame) -> DataFrame:
    """The messages with new ones (conv_id, role, text, sent) behind them: turns go on from each conversation's last one, in order of ``sent``."""
    last = messages.groupBy("conv_id").agg(F.max("turn").alias("_last"))
    w = Window.partitionBy("conv_id").orderBy("sent", "role", "text")
    turn = F.coalesce("_last", F.lit(0)) + F.row_number().over(w)
    return messages.unionByName(new.join(last, "conv_id", "left").withColumn("turn", turn.cast("bigint")).select(*messages.columns))


def update_job(projects: DataFrame, jobs: DataFrame) -> DataFrame:
    """The projects (project_id, ..., job_id) with the newest job of each (project_id, job_id, ts)."""
    newest = jobs.groupBy("project_id").agg(F.max_by("job_id", F.struct("ts", "job_id")).alias("_job"))
    return projects.join(newest, "project_id", "left").withColumn("job_id", F.coalesce("_job", "job_id")).select(*projects.columns)


def delete_projects(projects: DataFrame, conversations: DataFrame, messages: DataFrame, gone: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """The three tables without the projects (project_id) that are gone, their conversations and their messages."""
    ids = gone.select("project_id").distinct()
    lost = conversations.join(ids, "project_id", "left_semi").select("conv_id").distinct()
    return projects.join(ids, "project_id", "left_anti").select(*projects.columns), conversations.join(ids, "project_id", "left_anti").select(*conversations.columns), messages.join(lost, "conv_id", "left_anti").select(*messages.columns)
