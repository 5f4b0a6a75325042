"""Usage, cost, counter, log and rate reports."""

from __future__ import annotations

from pyspark.sql import functions as F

from .. import fixtures as fx
from ..functions import parsing as ps
from ..operators.timeline import quota_windows, running_sum, trailing_count
from ..plans import usage as us
from . import query
from .views import NOW_SQL


def r6(c):
    return F.round(c, 6).alias(c)


def log(spark, sf):
    u = fx.usage_log(spark, sf)
    return u.withColumn("total_tokens", ps.total_tokens("prompt_tokens", "completion_tokens"))


SUMS = """count(*) AS requests, CAST(coalesce(sum(prompt_tokens), 0) AS BIGINT) AS prompt_tokens,
  CAST(coalesce(sum(completion_tokens), 0) AS BIGINT) AS completion_tokens,
  CAST(coalesce(sum(prompt_tokens + completion_tokens), 0) AS BIGINT) AS total_tokens"""


@query("usage_hourly", f"""
SELECT date_trunc('hour', called_at) AS hour, activity, mode, provider, model, operation, {SUMS}
FROM usage_log WHERE called_at >= {NOW_SQL} - INTERVAL 720 HOUR GROUP BY ALL""")
def usage_hourly(spark, sf):
    return us.usage_hourly(log(spark, sf), fx.NOW, 720)


SETS = [["operation"], ["provider"], ["model"], ["activity"], ["mode", "provider"],
        ["activity", "mode", "provider"]]


@query("usage_breakdown", "WITH g AS (" + " UNION ALL ".join(
    f"SELECT '{','.join(s)}' AS breakdown, " + ", ".join(
        f"{d if d in s else 'NULL'} AS {d}" for d in ("activity", "mode", "model", "operation", "provider"))
    + f", {SUMS} FROM usage_log GROUP BY {', '.join(s)}" for s in SETS) + """)
SELECT *, round(total_tokens * 100.0::DOUBLE / sum(total_tokens) OVER (PARTITION BY breakdown), 6) AS share_pct FROM g""")
def usage_breakdown(spark, sf):
    return us.usage_breakdown(log(spark, sf), SETS).withColumn("share_pct", F.round("share_pct", 6))


@query("usage_provider_share", f"""
WITH g AS (SELECT operation, provider, {SUMS} FROM usage_log WHERE called_at >= TIMESTAMP '2024-01-20' GROUP BY 1, 2)
SELECT *, 'operation,provider' AS breakdown,
  round(total_tokens * 100.0::DOUBLE / sum(total_tokens) OVER (PARTITION BY operation), 6) AS share_pct FROM g""")
def usage_provider_share(spark, sf):
    out = us.usage_breakdown(log(spark, sf), [["operation", "provider"]], now="2024-01-20 09:00:00",
                             share_of=["operation"])
    return out.withColumn("share_pct", F.round("share_pct", 6))


@query("usage_today", f"SELECT {SUMS} FROM usage_log WHERE called_at >= TIMESTAMP '2024-01-20'")
def usage_today(spark, sf):
    return us.usage_totals(log(spark, sf), "2024-01-20 09:00:00")


DELTA = """d AS (SELECT *, lag(bytes) OVER (PARTITION BY project_id, branch_id ORDER BY collected_at, sample_id)
  AS previous FROM counter_samples)"""


@query("counter_deltas", f"""
WITH {DELTA} SELECT sample_id, previous, coalesce(bytes < previous, false) AS counter_reset,
  CASE WHEN bytes >= previous THEN bytes - previous END AS delta FROM d""")
def counter_deltas(spark, sf):
    d = us.counter_deltas(fx.counter_samples(spark, sf), ["project_id", "branch_id"])
    return d.select("sample_id", "previous", "counter_reset", "delta")


@query("egress_hourly", f"""
WITH {DELTA}, b AS (SELECT *, date_trunc('hour', collected_at) AS hour, bytes - previous AS delta FROM d
  WHERE bytes >= previous)
SELECT hour, project_id, branch_id, arg_max(delta, epoch_us(collected_at)) AS public_bytes,
  CAST(0 AS BIGINT) AS private_bytes, arg_max(delta, epoch_us(collected_at)) AS total_bytes FROM b GROUP BY 1, 2, 3""")
def egress_hourly(spark, sf):
    d = us.counter_deltas(fx.counter_samples(spark, sf), ["project_id", "branch_id"])
    return us.egress_hourly(d, ["project_id", "branch_id"])


def usage_payloads(spark, sf):
    """Consumption answers built from the events: alternative keys and null metrics on purpose."""
    e = fx.table(spark, sf, "events")
    i = F.col("event_id")
    hour = F.date_format("ts", "yyyy-MM-dd'T'HH:00:00'Z'")
    n = F.floor("value").cast("bigint").cast("string")
    flat = F.concat(F.lit('{"time":"'), hour, F.lit('","public_network_transfer_bytes":'), n, F.lit("}"))
    nested = F.concat(F.lit('{"hour":"'), hour, F.lit('","metrics":{"public_network_transfer_bytes":'), n,
                      F.lit(',"private_network_transfer_bytes":'), n, F.lit("}}"))
    user = F.col("user_id").cast("string")
    return e.select(
        F.when(i % 4 == 0, F.concat(F.lit('{"projects":[{"project_id":"p'), user, F.lit('","usage":['), nested,
                                    F.lit("]}]}")))
        .when(i % 4 == 1, F.concat(F.lit('{"projects":[{"id":"p'), user, F.lit('","buckets":['), flat, F.lit(","),
                                   flat, F.lit("]}]}")))
        .when(i % 4 == 2, F.concat(F.lit('{"data":[{"id":"p'), user, F.lit('","buckets":['), nested, F.lit("]}]}")))
        .otherwise(F.concat(F.lit('{"projects":[{"usage":['), flat, F.lit("]}]}"))).alias("payload"))


@query("flattened_usage", """
WITH e AS (SELECT event_id, 'p' || user_id AS project_id, strftime(ts, '%Y-%m-%dT%H:00:00Z') AS hour,
  CAST(floor(value) AS BIGINT) AS n FROM events)
SELECT project_id, hour, n AS public_bytes, n AS private_bytes, 2 * n AS total_bytes FROM e WHERE event_id % 4 IN (0, 2)
UNION ALL SELECT project_id, hour, n, 0, n FROM e, range(2) WHERE event_id % 4 = 1""")
def flattened_usage(spark, sf):
    return us.flatten_usage(usage_payloads(spark, sf))


@query("job_limits", "SELECT * FROM job_limits")
def job_limits(spark, sf):
    return us.parse_limits(fx.job_limits(spark, sf))


RUNS = """r AS (SELECT e.*, l.cpu, l.gib, l.timeout_s,
    greatest((epoch_us(completed_at) - epoch_us(started_at)) / 1e6, 0.0) AS billed
  FROM job_execs e JOIN job_limits l USING (job) WHERE completed_at >= TIMESTAMP '2024-01-05'),
q AS (SELECT *, least(app_seconds, billed) AS app, greatest(billed - least(app_seconds, billed), 0.0) AS over FROM
  (SELECT *, CASE WHEN app_seconds IS NULL THEN NULL ELSE app_seconds END AS a2 FROM r))"""


@query("job_runs", f"""
WITH {RUNS} SELECT execution, coalesce(completed_condition, 'unknown') AS status,
  timeout_s > 0 AND billed >= timeout_s * 0.9 AS near_timeout, round(billed, 6) AS billed_seconds,
  round(CASE WHEN app_seconds IS NOT NULL THEN app END, 6) AS app_seconds,
  round(CASE WHEN app_seconds IS NOT NULL THEN over END, 6) AS overhead_seconds,
  round(billed * cpu, 6) AS billed_vcpu_s, round(billed * gib, 6) AS billed_gib_s,
  round(CASE WHEN app_seconds IS NOT NULL THEN app * cpu END, 6) AS app_vcpu_s,
  round(CASE WHEN app_seconds IS NOT NULL THEN over * gib END, 6) AS overhead_gib_s FROM q""")
def job_runs(spark, sf):
    r = us.job_runs(fx.job_execs(spark, sf), us.parse_limits(fx.job_limits(spark, sf)), "2024-01-05 00:00:00")
    return r.select("execution", "status", "near_timeout", *[r6(c) for c in (
        "billed_seconds", "app_seconds", "overhead_seconds", "billed_vcpu_s", "billed_gib_s", "app_vcpu_s",
        "overhead_gib_s")])


@query("job_hourly", f"""
WITH {RUNS} SELECT date_trunc('hour', completed_at) AS hour, job, count(*) AS executions,
  round(sum(billed), 6) AS runtime_seconds, round(sum(billed * cpu), 6) AS vcpu_seconds,
  round(sum(billed * gib), 6) AS gib_seconds,
  count(*) FILTER (WHERE timeout_s > 0 AND billed >= timeout_s * 0.9) AS near_timeout_count FROM q GROUP BY 1, 2""")
def job_hourly(spark, sf):
    r = us.job_runs(fx.job_execs(spark, sf), us.parse_limits(fx.job_limits(spark, sf)), "2024-01-05 00:00:00")
    return us.job_hourly(r).select("hour", "job", "executions", r6("runtime_seconds"), r6("vcpu_seconds"),
                                   r6("gib_seconds"), "near_timeout_count")


def _service_use(spark, sf):
    """Request latencies as service use: service = job, seconds = value / 1000."""
    e = fx.table(spark, sf, "events").where("event_type = 'view'")
    return e.select(F.concat(F.lit("job"), (F.col("user_id") % 6).cast("string")).alias("job"),
                    (F.floor(F.col("value") * 100) / 1000).alias("seconds"))


MONTHLY = """m AS (SELECT l.job, coalesce(u.runs, 0) AS runs, coalesce(u.seconds, 0.0) AS seconds,
    coalesce(u.runs, 0) * 1.0::DOUBLE AS month_runs, coalesce(u.seconds, 0.0) * cpu * 1.0 AS month_vcpu_s,
    coalesce(u.seconds, 0.0) * gib * 1.0 AS month_gib_s FROM job_limits l LEFT JOIN (
    SELECT 'job' || (user_id % 6) AS job, count(*) AS runs, sum(floor(value * 100) / 1000) AS seconds
    FROM events WHERE event_type = 'view' GROUP BY 1) u USING (job))"""


@query("monthly_projection", f"""
WITH {MONTHLY} SELECT job, runs, round(seconds::DOUBLE, 6) AS seconds, month_runs,
  round(month_vcpu_s::DOUBLE, 6) AS month_vcpu_s, round(month_gib_s::DOUBLE, 6) AS month_gib_s FROM m""")
def monthly_projection(spark, sf):
    p = us.project_monthly(_service_use(spark, sf), us.parse_limits(fx.job_limits(spark, sf)), "job", 30)
    return p.select("job", "runs", r6("seconds"), "month_runs", r6("month_vcpu_s"), r6("month_gib_s"))


@query("quota_share", f"""
WITH {MONTHLY} SELECT sum(month_runs) AS month_runs, round(sum(month_vcpu_s)::DOUBLE, 6) AS month_vcpu_s,
  round(sum(month_gib_s)::DOUBLE, 6) AS month_gib_s, round(sum(month_runs) * 100.0 / 2000000::DOUBLE, 6) AS runs_pct,
  round(sum(month_vcpu_s)::DOUBLE * 100 / 180000, 6) AS vcpu_pct,
  round(sum(month_gib_s)::DOUBLE * 100 / 360000, 6) AS gib_pct FROM m""")
def quota_share(spark, sf):
    p = us.quota_share(us.project_monthly(_service_use(spark, sf), us.parse_limits(fx.job_limits(spark, sf)),
                                          "job", 30))
    return p.select("month_runs", *[r6(c) for c in p.columns if c != "month_runs"])


@query("parsed_log_lines", """
SELECT pos, nullif(regexp_extract(t, '^\\[[0-9:]+\\]\\s+\\w+:\\s+(.+)$', 1), '') AS message,
  CASE WHEN t NOT LIKE '[%' THEN nullif(regexp_extract(t, '^([A-Za-z0-9_]+):\\s*(.*)$', 1), '') END AS key,
  CASE WHEN t NOT LIKE '[%' THEN nullif(regexp_extract(t, '^([A-Za-z0-9_]+):\\s*(.*)$', 2), '') END AS value,
  CASE WHEN t LIKE '{%' THEN CAST(json_extract(t, '$.durationMs') AS DOUBLE) END AS json_ms
FROM (SELECT pos, trim(text) AS t FROM log_lines)""")
def parsed_log_lines(spark, sf):
    return us.parse_log_lines(fx.log_lines(spark, sf)).select("pos", "message", "key", "value", "json_ms")


@query("app_runtime", """
WITH p AS (SELECT *, CASE WHEN text LIKE '[%' THEN substr(text, 18) END AS message,
    CASE WHEN text LIKE '{%' THEN CAST(json_extract(text, '$.durationMs') AS DOUBLE) END AS json_ms,
    CASE WHEN text LIKE '    durationMs:%' THEN CAST(substr(text, 16) AS DOUBLE) END AS field_ms FROM log_lines),
c AS (SELECT *, last_value(message IGNORE NULLS) OVER (PARTITION BY execution ORDER BY ts, pos
    ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS event FROM p),
m AS (SELECT execution, ts, coalesce(json_ms, CASE WHEN event ILIKE '%finished%' THEN field_ms END) AS ms FROM c)
SELECT execution, round(arg_max(ms, epoch_us(ts)) / 1000.0, 6) AS app_seconds FROM m WHERE ms IS NOT NULL GROUP BY 1""")
def app_runtime(spark, sf):
    return us.app_runtime(fx.log_lines(spark, sf)).select("execution", r6("app_seconds"))


@query("rolling_rate", """
WITH r AS (SELECT user_id AS key, event_id AS pos, ts, CAST(floor(epoch_us(ts) / 1e6) AS BIGINT) AS sec FROM events),
w AS (SELECT *, count(*) OVER (PARTITION BY key ORDER BY sec RANGE BETWEEN 86399 PRECEDING AND CURRENT ROW) AS in_window,
  count(*) OVER (PARTITION BY key, CAST(ts AS DATE) ORDER BY ts, pos ROWS UNBOUNDED PRECEDING) AS in_day FROM r)
SELECT pos, in_window, in_day, greatest(4 - in_window, 0) AS window_left, greatest(3 - in_day, 0) AS day_left,
  in_window > 4 OR in_day > 3 AS exhausted FROM w""")
def rolling_rate(spark, sf):
    r = fx.requests(spark, sf)
    t = trailing_count(r, "key", "ts", 86400, "in_window")
    t = running_sum(t.withColumns({"day": F.to_date("ts"), "one": F.lit(1)}), ["key", "day"], ["ts", "pos"], "one",
                    "in_day")
    return t.select("pos", "in_window", "in_day", F.greatest(F.lit(4) - F.col("in_window"), F.lit(0)).alias("window_left"),
                    F.greatest(F.lit(3) - F.col("in_day"), F.lit(0)).alias("day_left"),
                    ((F.col("in_window") > 4) | (F.col("in_day") > 3)).alias("exhausted"))


@query("minute_rate", """
WITH r AS (SELECT event_type AS key, event_id AS pos, ts, CAST(floor(epoch_us(ts) / 1e6) AS BIGINT) AS sec FROM events),
w AS (SELECT *, count(*) OVER (PARTITION BY key ORDER BY sec RANGE BETWEEN 59 PRECEDING AND CURRENT ROW) AS in_window,
  count(*) OVER (PARTITION BY key, CAST(ts AS DATE) ORDER BY ts, pos ROWS UNBOUNDED PRECEDING) AS in_day FROM r)
SELECT pos, in_window, in_day, greatest(14 - in_window, 0) AS window_left, greatest(1450 - in_day, 0) AS day_left,
  in_window > 14 OR in_day > 1450 AS exhausted FROM w""")
def minute_rate(spark, sf):
    e = fx.table(spark, sf, "events").select(F.col("event_type").alias("key"), "ts", F.col("event_id").alias("pos"))
    return us.rolling_rate(e).select("pos", "in_window", "in_day", "window_left", "day_left", "exhausted")


@query("quota_decisions", """
WITH RECURSIVE r AS (SELECT user_id AS key, event_id AS pos, epoch_us(ts) AS us, row_number() OVER (
    PARTITION BY user_id ORDER BY ts, event_id) AS idx FROM events),
chain AS (SELECT key, us AS start_us, idx AS start_idx FROM r WHERE idx = 1
  UNION ALL SELECT c.key, n.us, n.idx FROM chain c JOIN LATERAL (
    SELECT us, idx FROM r WHERE r.key = c.key AND r.us >= c.start_us + 172800000000 ORDER BY idx LIMIT 1) n ON true),
w AS (SELECT r.pos, r.us, r.idx, c.start_us, c.start_idx FROM r ASOF JOIN chain c
  ON r.key = c.key AND r.idx >= c.start_idx)
SELECT pos, idx - start_idx + 1 <= 3 AS allowed, greatest(3 - (idx - start_idx + 1), 0) AS remaining,
  CAST(ceil((start_us + 172800000000 - us) / 1e6) AS BIGINT) AS reset_seconds,
  CASE WHEN idx - start_idx + 1 <= 3 THEN 0 ELSE CAST(ceil((start_us + 172800000000 - us) / 1e6) AS BIGINT) END
    AS retry_after_seconds FROM w""")
def quota_decisions(spark, sf):
    out = quota_windows(fx.requests(spark, sf), "key", "ts", "pos", 3, 172800)
    return out.select("pos", "allowed", F.col("remaining").cast("bigint").alias("remaining"), "reset_seconds",
                      "retry_after_seconds")
