"""Run records (R01-R10): one definition for batch tables and for streams of node events."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.stats import running_counts

#: Nodes that can fall back, and after how many seconds a session is dropped.
FALLBACK_NODES = ("view", "click", "purchase")
TTL_SECONDS = 600


def node_events(df: DataFrame) -> DataFrame:
    """event_id, session_id, ts, node, duration_ms and status from raw events; works on streams."""
    status = F.when(F.col("event_type") == "error", "error").when(F.col("event_id") % 20 == 0, "skipped").otherwise("success")
    return df.select("event_id", F.col("user_id").alias("session_id"), F.col("ts").cast("timestamp").alias("ts"), F.col("event_type").alias("node"), F.col("value").alias("duration_ms"), status.alias("status"))


def _metrics() -> list[Column]:
    n = F.count(F.lit(1))
    return [
        n.alias("executions"), F.count_if(F.col("status") == "error").alias("errors"), F.round(F.count_if(F.col("status") == "error") / n, 6).alias("error_rate"),
        F.count_if((F.col("status") == "skipped") & F.col("node").isin(*FALLBACK_NODES)).alias("fallbacks"), F.round(F.sum("duration_ms"), 4).alias("total_ms"), F.round(F.max("duration_ms"), 4).alias("max_ms"),
    ]


def node_metrics(events: DataFrame) -> DataFrame:
    return events.groupBy("node").agg(*_metrics())


def windowed_metrics(events: DataFrame, length: str, slide: str | None = None, late: str | None = None) -> DataFrame:
    """Metrics by node and window; a watermark bounds the state on a stream."""
    rows = events.withWatermark("ts", late) if late else events
    w = F.window("ts", length, slide) if slide else F.window("ts", length)
    return rows.groupBy(w.alias("w"), "node").agg(*_metrics()).select(F.col("w.start").alias("window_start"), "node", "executions", "errors", "total_ms")


def session_windows(events: DataFrame, gap: str, late: str | None = None) -> DataFrame:
    rows = events.withWatermark("ts", late) if late else events
    return rows.groupBy(F.session_window("ts", gap).alias("w"), "session_id").agg(F.count(F.lit(1)).alias("n")).select("session_id", F.col("w.start").alias("window_start"), "n")


def latency_summary(events: DataFrame) -> DataFrame:
    """Count, mean, extremes and the upper middle element of the durations of each node.

    The middle element is element n // 2 of n sorted values, found from running counts of the
    distinct durations; no task orders all durations of a node."""
    n = F.count("duration_ms")
    by = events.groupBy("node").agg(n.alias("n"), F.round(F.avg("duration_ms"), 2).alias("mean"), F.round(F.min("duration_ms"), 2).alias("min"), F.round(F.max("duration_ms"), 2).alias("max"))
    counts = events.where("duration_ms is not null").groupBy("node", "duration_ms").agg(F.count(F.lit(1)).alias("c"))
    below = running_counts(counts, "duration_ms", "c", ["node"])
    mid = below.join(by.select("node", "n"), "node").where(F.col("_below") + F.col("c") > F.floor(F.col("n") / 2)).groupBy("node").agg(F.round(F.min("duration_ms"), 2).alias("p50"))
    return by.join(mid, "node", "left").na.fill(0.0, ["mean", "min", "max", "p50"])


def trace_summary(events: DataFrame) -> DataFrame:
    """Per session: nodes in order, failed and skipped counts, total time."""
    entry = F.struct("ts", "event_id", "node")
    return events.groupBy("session_id").agg(
        F.array_join(F.transform(F.array_sort(F.collect_list(entry)), lambda x: x["node"]), ">").alias("nodes"), F.count_if(F.col("status") == "error").alias("n_failed"), F.count_if(F.col("status") == "skipped").alias("n_skipped"),
        F.round(F.sum("duration_ms"), 4).alias("total_ms"), (F.count_if(F.col("status") == "error") > 0).alias("has_fatal"),
    )


def audit_records(events: DataFrame) -> DataFrame:
    """Per session: duration of each node as a map, and totals."""
    by = events.groupBy("session_id", "node").agg(F.round(F.sum("duration_ms"), 4).alias("ms"), F.count(F.lit(1)).alias("n"))
    return by.groupBy("session_id").agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct("node", "ms")))).alias("durations"), F.sum("n").alias("n_events"), F.round(F.sum("ms"), 4).alias("total_ms"))


def session_updates(events: DataFrame) -> DataFrame:
    """Updates of sessions: a status, and a payload that a null leaves as it is."""
    status = F.when(F.col("node") == "signup", "pending").when(F.col("node") == "view", "phase1_ready").when(F.col("node") == "purchase", "complete").when(F.col("node") == "error", "error")
    return events.select("session_id", "ts", "event_id", status.alias("status"), F.when(F.col("node") == "purchase", F.col("duration_ms")).alias("payload"))


def session_state(updates: DataFrame) -> DataFrame:
    """The state after all updates: last status and last payload that are not null, first time."""
    order = F.struct("ts", "event_id")
    last = lambda c: F.max_by(c, F.when(F.col(c).isNotNull(), order)).alias(c)
    return updates.groupBy("session_id").agg(last("status"), last("payload"), F.min("ts").alias("created_at"), F.count(F.lit(1)).alias("n_updates"))


def live_sessions(state: DataFrame, now: Column, seconds: int = TTL_SECONDS) -> DataFrame:
    """Sessions whose age, counted from their creation, is within the limit."""
    return state.where(F.unix_timestamp(now) - F.unix_timestamp("created_at") <= seconds)


def recent_sessions(state: DataFrame, n: int) -> DataFrame:
    return state.orderBy(F.desc("created_at"), "session_id").limit(max(1, min(n, 100)))


def recent_with_today(state: DataFrame, n: int, now: Column) -> DataFrame:
    """The newest sessions, and beside them how many were created since the last midnight (UTC session time) up to now."""
    today = state.agg(F.count_if((F.col("created_at") >= F.date_trunc("day", now)) & (F.col("created_at") <= now)).alias("n_today"))
    return recent_sessions(state, n).crossJoin(F.broadcast(today))  # one row


def average_time(events: DataFrame) -> DataFrame:
    return events.agg(F.round(F.avg(F.when(F.col("duration_ms") > 0, F.col("duration_ms"))), 6).alias("avg_ms"), F.count_if(F.col("duration_ms") > 0).alias("n"))


def event_stream(spark: SparkSession, folder: str, pattern: str, schema: str) -> DataFrame:
    return spark.readStream.schema(schema).option("pathGlobFilter", pattern).option("maxFilesPerTrigger", 1).parquet(folder)


def run_to_table(stream: DataFrame, path: str, mode: str = "complete") -> DataFrame:
    """Run a stream over what is there and give the last state of its result, kept in a written table."""
    spark = stream.sparkSession

    def keep(batch: DataFrame, epoch: int) -> None:
        batch.write.mode("overwrite" if mode == "complete" else "append").parquet(f"{path}/{epoch if mode == 'complete' else 'all'}")

    q = stream.writeStream.outputMode(mode).foreachBatch(keep).option("checkpointLocation", f"{path}-checkpoint").trigger(availableNow=True).start()
    q.awaitTermination()
    last = max([p["batchId"] for p in q.recentProgress], default=0)
    return spark.read.schema(stream.schema).parquet(f"{path}/{last if mode == 'complete' else 'all'}")


STATE_OUT = "session_id bigint, status string, payload double"


def stateful_sessions(updates: DataFrame, seconds: int = TTL_SECONDS) -> DataFrame:
    """The same upsert as a stateful stream operator. A session leaves the state when that many
    seconds of processing time have passed since it was created, as in live_sessions()."""
    from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

    def upsert(key, rows: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        if state.hasTimedOut:
            state.remove()
            return
        now_ms = state.getCurrentProcessingTimeMs()
        status, payload, ends = state.get if state.exists else (None, None, now_ms + 1000 * seconds)
        for r in pd.concat(list(rows)).sort_values(["ts", "event_id"]).itertuples():
            status = r.status if isinstance(r.status, str) else status
            payload = payload if pd.isna(r.payload) else float(r.payload)
        state.update((status, payload, ends))
        state.setTimeoutDuration(max(1, ends - now_ms))
        yield pd.DataFrame({"session_id": [key[0]], "status": [status], "payload": [payload]})

    return updates.groupBy("session_id").applyInPandasWithState(upsert, STATE_OUT, "status string, payload double, ends bigint", "update", GroupStateTimeout.ProcessingTimeTimeout)


SESSION_OUT = "session_id bigint, status string, payload double, created_at timestamp, n_updates bigint, expired boolean"
_SESSION_STATE = "status string, status_at bigint, status_id bigint, payload double, payload_at bigint, payload_id bigint, created_at bigint, n_updates bigint"


def expiring_sessions(updates: DataFrame, seconds: int = TTL_SECONDS, late: str = "0 seconds") -> DataFrame:
    """session_state() as a stateful operator on event time: one row whenever a session changes, and one
    with `expired` when the watermark passes its creation by so many seconds; it then leaves the state.

    The state of a session is eight values, whatever the number of its updates, and order among updates
    is by (ts, event_id) also across micro-batches."""
    from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

    def latest(rows: pd.DataFrame, column: str, held: tuple) -> tuple:
        """(value, micros, id) of the last update that has the column, or what is held if that is later."""
        some = rows[rows[column].notna()]
        if some.empty:
            return held
        at = some.sort_values(["_at", "event_id"]).iloc[-1]
        new = (at[column], int(at["_at"]), int(at["event_id"]))
        return new if held[1] is None or new[1:] > held[1:] else held

    def upsert(key, parts: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        held = state.get if state.exists else (None,) * 6 + (None, 0)
        status, payload, created, n = held[0:3], held[3:6], held[6], held[7]
        if not state.hasTimedOut:
            for rows in parts:
                rows = rows.assign(_at=rows["ts"].astype("datetime64[us]").astype("int64"))
                status, payload = latest(rows, "status", status), latest(rows, "payload", payload)
                first = int(rows["_at"].min())
                created, n = first if created is None else min(created, first), n + len(rows)
        ends = created // 1000 + 1000 * seconds
        over = state.hasTimedOut or ends <= state.getCurrentWatermarkMs()
        if over:
            state.remove()
        else:
            state.update((status[0], status[1], status[2], None if payload[0] is None else float(payload[0]), payload[1], payload[2], created, n))
            state.setTimeoutTimestamp(ends)
        yield pd.DataFrame({"session_id": [key[0]], "status": [status[0]], "payload": [payload[0]], "created_at": [pd.Timestamp(created, unit="us")], "n_updates": [n], "expired": [over]})

    return updates.withWatermark("ts", late).groupBy("session_id").applyInPandasWithState(upsert, SESSION_OUT, _SESSION_STATE, "append", GroupStateTimeout.EventTimeTimeout)


def last_states(stream: DataFrame, path: str) -> DataFrame:
    """Run expiring_sessions() over what is there: the last row of each session."""
    spark = stream.sparkSession

    def keep(batch: DataFrame, epoch: int) -> None:
        batch.write.mode("overwrite").parquet(f"{path}/epoch={epoch}")

    stream.writeStream.outputMode("append").foreachBatch(keep).option("checkpointLocation", f"{path}-checkpoint").trigger(availableNow=True).start().awaitTermination()
    rows = spark.read.schema(f"{SESSION_OUT}, epoch bigint").option("basePath", path).parquet(path)
    columns = [c for c in rows.columns if c not in ("session_id", "epoch")]
    return rows.groupBy("session_id").agg(F.max_by(F.struct(*columns), F.struct("epoch", "n_updates", "expired")).alias("s")).select("session_id", "s.*")
