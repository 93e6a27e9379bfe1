"""Queries R01-R10: batch rollups with SQL, and the same definitions as streams over the events table."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import evaluation as E
from ..operators import models as M
from ..sources.files import work_dir
from ..streaming import runs as R
from .base import query
from .q_models import _scored_sql, given

events = lambda t: R.node_events(t.events)
_EVENTS = "event_id bigint, user_id bigint, ts timestamp_ntz, event_type string, value double, props string"
stream = lambda t: R.node_events(R.event_stream(t.spark, t.sf_dir, "events*.parquet", _EVENTS))
_M = "count(*) AS executions, count(*) FILTER (WHERE status = 'error') AS errors, round(count(*) FILTER (WHERE status = 'error') * 1.0 / count(*), 6) AS error_rate, count(*) FILTER (WHERE status = 'skipped' AND node IN ('view', 'click', 'purchase')) AS fallbacks, round(sum(duration_ms), 4) AS total_ms, round(max(duration_ms), 4) AS max_ms"
query("R01_node_metrics", f"SELECT node, {_M} FROM trace_v GROUP BY node")(lambda t: R.node_metrics(events(t)))
query("R01_node_metrics_stream", f"SELECT node, {_M} FROM trace_v GROUP BY node")(lambda t: R.run_to_table(R.node_metrics(stream(t)), work_dir(t.spark)))
query("R02_latency_summary", "SELECT node, count(*) AS n, round(avg(duration_ms), 2) AS mean, round(min(duration_ms), 2) AS min, round(max(duration_ms), 2) AS max, round(list_sort(list(duration_ms))[count(*) // 2 + 1], 2) AS p50 FROM trace_v GROUP BY node")(lambda t: R.latency_summary(events(t)))
query("R03_trace_summary", "SELECT session_id, string_agg(node, '>' ORDER BY ts, event_id) AS nodes, count(*) FILTER (WHERE status = 'error') AS n_failed, count(*) FILTER (WHERE status = 'skipped') AS n_skipped, round(sum(duration_ms), 4) AS total_ms, count(*) FILTER (WHERE status = 'error') > 0 AS has_fatal FROM trace_v GROUP BY session_id")(lambda t: R.trace_summary(events(t)))
query("R04_audit_record", "SELECT session_id, round(sum(duration_ms) FILTER (WHERE node = 'click'), 4) AS click_ms, count(*) AS n_events FROM trace_v GROUP BY session_id")(
    lambda t: R.audit_records(events(t)).select("session_id", F.col("durations")["click"].alias("click_ms"), "n_events")
)
_STATUS = "CASE node WHEN 'signup' THEN 'pending' WHEN 'view' THEN 'phase1_ready' WHEN 'purchase' THEN 'complete' WHEN 'error' THEN 'error' END"
_STATE = f"st AS (SELECT session_id, arg_max({_STATUS}, (ts, event_id)) FILTER (WHERE {_STATUS} IS NOT NULL) AS status, arg_max(duration_ms, (ts, event_id)) FILTER (WHERE node = 'purchase') AS payload, min(ts) AS created_at, count(*) AS n_updates FROM trace_v GROUP BY session_id)"
state = lambda t: R.session_state(R.session_updates(events(t)))
query("R05_session_state", f"WITH {_STATE} SELECT session_id, status, payload, n_updates FROM st")(lambda t: state(t).select("session_id", "status", "payload", "n_updates"))
query("R06_expire_sessions", f"WITH {_STATE} SELECT session_id FROM st WHERE epoch(date_trunc('second', TIMESTAMP '2024-01-01 00:30:00')) - epoch(date_trunc('second', created_at)) <= 600")(
    lambda t: R.live_sessions(state(t), F.lit("2024-01-01 00:30:00").cast("timestamp")).select("session_id")
)
# the same as stateful streams on event time: no session ends before ten years; and sessions end 600 s after
# their creation while the stream's time runs to half past midnight
session_stream = lambda t, seconds, until: R.last_states(R.expiring_sessions(R.session_updates(stream(t).where(F.col("ts") <= F.lit(until).cast("timestamp"))), seconds), work_dir(t.spark) + "/sessions")
query("R05_session_state_stream", f"WITH {_STATE} SELECT session_id, status, payload, n_updates FROM st")(lambda t: session_stream(t, 315360000, "2100-01-01").select("session_id", "status", "payload", "n_updates"))
query("R06_expire_sessions_stream", f"WITH {_STATE.replace('FROM trace_v GROUP', 'FROM ev GROUP').replace('st AS', 'ev AS (SELECT * FROM trace_v WHERE ts <= TIMESTAMP ' + chr(39) + '2024-01-01 00:30:00' + chr(39) + '), st AS', 1)} SELECT session_id, status, payload, n_updates, epoch_ms((SELECT max(ts) FROM ev)) > epoch_ms(created_at) + 600000 AS expired FROM st")(
    lambda t: session_stream(t, R.TTL_SECONDS, "2024-01-01 00:30:00").select("session_id", "status", "payload", "n_updates", "expired")
)
query("R07_recent_sessions", f"WITH {_STATE} SELECT session_id, status FROM st ORDER BY created_at DESC, session_id LIMIT 20")(lambda t: R.recent_sessions(state(t), 20).select("session_id", "status"))
query("R07_recent_sessions_today", f"WITH {_STATE} SELECT session_id, status, (SELECT count(*) FROM st WHERE created_at >= TIMESTAMP '2024-01-01' AND created_at <= TIMESTAMP '2024-01-01 13:00:00') AS n_today FROM st ORDER BY created_at DESC, session_id LIMIT 20")(
    lambda t: R.recent_with_today(state(t), 20, F.lit("2024-01-01 13:00:00").cast("timestamp")).select("session_id", "status", "n_today")
)
query("R08_avg_response_time", "SELECT round(avg(duration_ms) FILTER (WHERE duration_ms > 0), 6) AS avg_ms, count(*) FILTER (WHERE duration_ms > 0) AS n FROM trace_v")(lambda t: R.average_time(events(t)))
_WIN = "SELECT date_trunc('day', ts) AS window_start, node, count(*) AS executions, count(*) FILTER (WHERE status = 'error') AS errors, round(sum(duration_ms), 4) AS total_ms FROM trace_v GROUP BY 1, 2"
_day = lambda d: d.withColumn("window_start", F.col("window_start").cast("timestamp_ntz"))
query("R09_windowed_node_metrics", _WIN)(lambda t: _day(R.windowed_metrics(events(t), "1 day")))
query("R09_windowed_node_metrics_stream", _WIN)(lambda t: _day(R.run_to_table(R.windowed_metrics(stream(t), "1 day", late="1 day"), work_dir(t.spark))))
query("R09_session_windows", "SELECT session_id, count(*) AS n_windows, CAST(sum(n) AS BIGINT) AS n FROM (SELECT session_id, w, count(*) AS n FROM (SELECT *, sum(g) OVER (PARTITION BY session_id ORDER BY ts, event_id) AS w FROM (SELECT *, CASE WHEN ts - lag(ts) OVER (PARTITION BY session_id ORDER BY ts, event_id) <= INTERVAL 6 HOUR THEN 0 ELSE 1 END AS g FROM trace_v) a) b GROUP BY 1, 2) c GROUP BY 1")(
    lambda t: R.session_windows(events(t), "6 hours").groupBy("session_id").agg(F.count(F.lit(1)).alias("n_windows"), F.sum("n").alias("n"))
)


@query("R10_scored_request_stream")
def _(t):
    """A model fitted on the listings scores a stream of events joined to them, without state."""
    rows = M.assembled(M.model_rows(t.listings_v))
    model = M.learner("linear").fit(rows)
    requests = stream(t).select("event_id", F.col("session_id").alias("owner_id")).join(t.listings_v.groupBy("owner_id").agg(F.min("listing_id").alias("listing_id")), "owner_id").join(t.listings_v.drop("owner_id"), "listing_id")
    data = M.model_rows(requests.withColumn("listing_id", F.struct("event_id", "listing_id")))
    scored = E.scored(M.probabilities(model, M.assembled(data)), M.P, M.CUTS)
    return R.run_to_table(scored.select("listing_id.event_id", "listing_id.listing_id", "predicted", F.round("expected_value", 6).alias("expected_value")), work_dir(t.spark), "append")


_FIRST = "SELECT e.event_id, l.* FROM events e JOIN (SELECT owner_id, min(listing_id) AS listing_id FROM listings_v GROUP BY 1) o ON o.owner_id = e.user_id JOIN listings_v l ON l.listing_id = o.listing_id"


@query("R10_scored_request_stream_given", f"SELECT event_id, listing_id, predicted, round(ev, 6) AS expected_value FROM {_scored_sql(f'({_FIRST})')} s")
def _(t):
    """The model with given weights scores a stream of events joined to listings, without state."""
    first = t.listings_v.groupBy("owner_id").agg(F.min("listing_id").alias("listing_id"))
    requests = stream(t).select("event_id", F.col("session_id").alias("owner_id")).join(first, "owner_id").join(t.listings_v.drop("owner_id"), "listing_id")
    data = M.model_rows(requests.withColumn("listing_id", F.struct("event_id", "listing_id")))
    scored = E.scored(M.probabilities(given, data), M.P, M.CUTS)
    return R.run_to_table(scored.select("listing_id.event_id", "listing_id.listing_id", "predicted", F.round("expected_value", 6).alias("expected_value")), work_dir(t.spark), "append")
