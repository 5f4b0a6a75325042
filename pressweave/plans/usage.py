"""Usage, cost and log reports."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .. import vocab
from ..functions import parsing as ps
from ..functions.news import seconds_between
from ..operators.timeline import carry_forward, lag_value, running_sum, trailing_count
from .feed import as_datetime, ntz

USAGE_KEYS = ["hour", "activity", "mode", "provider", "model", "operation"]


def _tokens(name):
    return F.coalesce(F.sum(name), F.lit(0)).cast("bigint").alias(name)


def usage_hourly(log: DataFrame, now, lookback_hours: int = 24) -> DataFrame:
    """Requests and tokens per hour and label set; missing labels are '', missing tokens 0."""
    since = as_datetime(now) - dt.timedelta(hours=lookback_hours)
    labels = {c: F.coalesce(c, F.lit("")) for c in USAGE_KEYS[1:]}
    return (log.where(F.col("called_at") >= ntz(since))
            .withColumns({**labels, "hour": F.date_trunc("hour", "called_at").cast("timestamp_ntz")})
            .groupBy(*USAGE_KEYS)
            .agg(F.count(F.lit(1)).alias("requests"), _tokens("prompt_tokens"), _tokens("completion_tokens"),
                 _tokens("total_tokens")))


def usage_breakdown(log: DataFrame, sets: list[list[str]], now=None, share_of: list[str] | None = None) -> DataFrame:
    """All breakdowns in one scan (GROUPING SETS) with each row's share of the total tokens.

    ``breakdown`` names the dimensions of the row; with ``share_of`` the share is taken within those
    dimensions instead of the whole set."""
    dims = sorted({d for s in sets for d in s})
    rows = log if now is None else log.where(
        F.col("called_at") >= ntz(as_datetime(now).replace(hour=0, minute=0, second=0, microsecond=0)))
    g = rows.groupingSets([[F.col(d) for d in s] for s in sets], *dims).agg(
        F.grouping_id().alias("_gid"), F.count(F.lit(1)).alias("requests"), _tokens("prompt_tokens"),
        _tokens("completion_tokens"), _tokens("total_tokens"))
    names = {sum(1 << (len(dims) - 1 - i) for i, d in enumerate(dims) if d not in s): ",".join(s) for s in sets}
    label = F.element_at(F.create_map(*[F.lit(x) for kv in names.items() for x in kv]), F.col("_gid").cast("int"))
    w = Window.partitionBy("_gid", *(share_of or []))
    share = F.col("total_tokens") * 100.0 / F.nullif(F.sum("total_tokens").over(w), F.lit(0))
    return g.withColumn("share_pct", share).withColumn("breakdown", label).drop("_gid")


def usage_totals(log: DataFrame, now) -> DataFrame:
    day = as_datetime(now).replace(hour=0, minute=0, second=0, microsecond=0)
    return log.where(F.col("called_at") >= ntz(day)).agg(
        F.count(F.lit(1)).alias("requests"), _tokens("prompt_tokens"), _tokens("completion_tokens"),
        _tokens("total_tokens"))


# ---- counters ---------------------------------------------------------------------

def counter_deltas(samples: DataFrame, keys: list[str], ts: str = "collected_at", value: str = "bytes",
                   tie: str = "sample_id") -> DataFrame:
    """Growth since the previous sample of the same key; a falling counter is a reset without delta."""
    t = lag_value(samples, keys, [ts, tie], value, "previous")
    reset = F.coalesce(F.col(value) < F.col("previous"), F.lit(False))
    return t.withColumns({"counter_reset": reset, "delta": F.when(
        F.col("previous").isNotNull() & ~reset, F.col(value) - F.col("previous"))})


def egress_hourly(deltas: DataFrame, keys: list[str], ts: str = "collected_at") -> DataFrame:
    """Delta booked per hour: the last sample of the hour wins, as a keyed overwrite would leave it."""
    booked = deltas.where("delta is not null").withColumn("hour", F.date_trunc("hour", ts).cast("timestamp_ntz"))
    return booked.groupBy("hour", *keys).agg(
        F.max_by("delta", F.struct(ts, "sample_id")).alias("public_bytes")).withColumns(
        {"private_bytes": F.lit(0).cast("bigint"), "total_bytes": F.col("public_bytes")})


USAGE_JSON = ("projects array<struct<project_id:string,id:string,"
              "usage:array<struct<hour:string,time:string,timestamp:string,public_network_transfer_bytes:bigint,"
              "private_network_transfer_bytes:bigint,metrics:struct<public_network_transfer_bytes:bigint,"
              "private_network_transfer_bytes:bigint>>>,"
              "buckets:array<struct<hour:string,time:string,timestamp:string,public_network_transfer_bytes:bigint,"
              "private_network_transfer_bytes:bigint,metrics:struct<public_network_transfer_bytes:bigint,"
              "private_network_transfer_bytes:bigint>>>>>")


def flatten_usage(payloads: DataFrame, json_col: str = "payload") -> DataFrame:
    """Nested consumption answers to one row per project and hour."""
    schema = USAGE_JSON + ", data " + USAGE_JSON.split(" ", 1)[1]
    p = payloads.select(F.from_json(json_col, schema).alias("j"))

    def filled(a):
        return F.when(F.size(F.col(a)) > 0, F.col(a))

    pr = p.select(F.explode(F.coalesce(filled("j.projects"), F.col("j.data"))).alias("p"))
    b = pr.select(F.coalesce("p.project_id", "p.id").alias("project_id"),
                  F.explode(F.coalesce(filled("p.usage"), F.col("p.buckets"))).alias("b"))

    def metric(name):
        return F.coalesce(F.when(F.col("b.metrics").isNotNull(), F.col(f"b.metrics.{name}"))
                          .otherwise(F.col(f"b.{name}")), F.lit(0))

    out = b.select("project_id", F.coalesce("b.hour", "b.time", "b.timestamp").alias("hour"),
                   metric("public_network_transfer_bytes").alias("public_bytes"),
                   metric("private_network_transfer_bytes").alias("private_bytes"))
    return out.where("project_id <> '' and hour <> ''").withColumn(
        "total_bytes", F.col("public_bytes") + F.col("private_bytes"))


# ---- job runs ---------------------------------------------------------------------

def parse_limits(limits: DataFrame) -> DataFrame:
    return limits.select("job", ps.cpu_cores("cpu").alias("cpu"), ps.mem_gib("memory").alias("gib"),
                         ps.secs("timeout").alias("timeout_s"))


RESOURCE_PATHS = ("$.spec.template.spec.containers[0].resources.limits.",
                  "$.spec.template.spec.template.spec.containers[0].resources.limits.")


def limits_from_json(resources: DataFrame, json_col: str = "spec") -> DataFrame:
    """Limits of the first container, at the direct or the nested template path."""
    def at(name):
        return F.coalesce(*[F.get_json_object(json_col, p + name) for p in RESOURCE_PATHS])
    timeout = F.coalesce(F.get_json_object(json_col, "$.spec.template.spec.timeoutSeconds"),
                         F.get_json_object(json_col, "$.spec.template.spec.template.spec.timeoutSeconds"),
                         F.get_json_object(json_col, "$.spec.template.timeoutSeconds"))
    return parse_limits(resources.select("job", at("cpu").alias("cpu"), at("memory").alias("memory"),
                                         timeout.alias("timeout")))


def job_runs(execs: DataFrame, limits: DataFrame, cutoff=None) -> DataFrame:
    """Billed, application and overhead time of each finished run, as seconds, vCPU- and GiB-seconds.

    ``execs``: job, execution, started_at, completed_at, completed_condition, app_seconds."""
    t = execs.where("started_at is not null and completed_at is not null")
    if cutoff is not None:
        t = t.where(F.col("completed_at") >= ntz(as_datetime(cutoff)))
    t = t.join(limits, "job")
    billed = F.greatest(seconds_between("completed_at", "started_at"), F.lit(0.0))
    t = t.withColumn("billed_seconds", billed).withColumns({
        "app_seconds": F.when(F.col("app_seconds").isNotNull(), F.least("app_seconds", "billed_seconds")),
        "status": F.coalesce("completed_condition", F.lit("unknown")),
        "near_timeout": (F.col("timeout_s") > 0) & (F.col("billed_seconds") >= F.col("timeout_s") * 0.9)})
    t = t.withColumn("overhead_seconds", F.when(
        F.col("app_seconds").isNotNull(), F.greatest(F.col("billed_seconds") - F.col("app_seconds"), F.lit(0.0))))
    return t.withColumns({f"{k}_{u}": F.col(f"{k}_seconds") * F.col(r) for k in ("billed", "app", "overhead")
                          for u, r in (("vcpu_s", "cpu"), ("gib_s", "gib"))})


def job_hourly(runs: DataFrame) -> DataFrame:
    return (runs.withColumn("hour", F.date_trunc("hour", "completed_at").cast("timestamp_ntz"))
            .groupBy("hour", "job")
            .agg(F.count(F.lit(1)).alias("executions"), F.sum("billed_seconds").alias("runtime_seconds"),
                 F.sum("billed_vcpu_s").alias("vcpu_seconds"), F.sum("billed_gib_s").alias("gib_seconds"),
                 F.count_if("near_timeout").alias("near_timeout_count")))


def project_monthly(use: DataFrame, limits: DataFrame, name: str, days: float) -> DataFrame:
    """Thirty-day projection of runs, vCPU- and GiB-seconds per ``name``; names without use stay at zero."""
    t = use.groupBy(name).agg(F.count(F.lit(1)).alias("runs"), F.sum("seconds").alias("seconds"))
    t = limits.join(t, name, "left").fillna({"runs": 0, "seconds": 0.0})
    k = 30.0 / days
    return t.select(name, "runs", "seconds", (F.col("runs") * k).alias("month_runs"),
                    (F.col("seconds") * F.col("cpu") * k).alias("month_vcpu_s"),
                    (F.col("seconds") * F.col("gib") * k).alias("month_gib_s"))


def quota_share(projected: DataFrame, requests: float = vocab.QUOTA_REQUESTS,
                vcpu: float = vocab.QUOTA_VCPU_SECONDS, gib: float = vocab.QUOTA_GIB_SECONDS) -> DataFrame:
    def pct(c, limit):
        return F.sum(c) * 100.0 / F.nullif(F.lit(float(limit)), F.lit(0.0))
    return projected.agg(F.sum("month_runs").alias("month_runs"), F.sum("month_vcpu_s").alias("month_vcpu_s"),
                         F.sum("month_gib_s").alias("month_gib_s"), pct("month_runs", requests).alias("runs_pct"),
                         pct("month_vcpu_s", vcpu).alias("vcpu_pct"), pct("month_gib_s", gib).alias("gib_pct"))


# ---- logs -------------------------------------------------------------------------

def parse_log_lines(lines: DataFrame) -> DataFrame:
    """Add ``clean, message, key, value, json_ms`` to raw log lines."""
    t = lines.withColumn("clean", ps.clean_log("text"))
    field = ps.log_field(F.col("clean"))
    return t.withColumns({"message": ps.log_message(F.col("clean")), "key": field["key"], "value": field["value"],
                          "json_ms": ps.json_duration_ms("clean")})


def app_runtime(lines: DataFrame) -> DataFrame:
    """Last reported application runtime per execution, in seconds.

    A ``durationMs`` field counts when the message line it belongs to says finished or complete; a
    structured line carries both itself."""
    t = parse_log_lines(lines).drop("text", "clean")
    t = carry_forward(t, "execution", ["ts", "pos"], "message", "event")
    number = F.col("value").try_cast("double")
    ms = F.coalesce("json_ms", F.when((F.col("key") == "durationMs") & ps.is_finished("event"), number))
    return (t.withColumn("ms", ms).where("ms is not null").groupBy("execution")
            .agg((F.max_by("ms", F.struct("ts", "pos")) / 1000.0).alias("app_seconds")))


# ---- request rates ----------------------------------------------------------------

def rolling_rate(requests: DataFrame, key: str = "key", per_minute: int = 14, per_day: int = 1450,
                 seconds: int = 60) -> DataFrame:
    """Trailing-minute and calendar-day counts with the head-room left under each limit."""
    t = trailing_count(requests, key, "ts", seconds, "in_window")
    t = t.withColumns({"day": F.to_date("ts"), "_one": F.lit(1)})
    t = running_sum(t, [key, "day"], ["ts", "pos"], "_one", "in_day")
    return t.drop("_one").withColumns({
        "window_left": F.greatest(F.lit(per_minute) - F.col("in_window"), F.lit(0)),
        "day_left": F.greatest(F.lit(per_day) - F.col("in_day"), F.lit(0)),
        "exhausted": (F.col("in_window") > per_minute) | (F.col("in_day") > per_day)})
