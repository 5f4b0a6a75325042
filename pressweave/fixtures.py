"""The driver's parquet tables seen through the news data model (see FIXTURES.md).

Only integer arithmetic and plain string functions are used, so any SQL engine
can rebuild the same rows.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import vocab

NOW = "2024-01-31 00:00:00"


def table(spark: SparkSession, sf: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf.rstrip('/')}/{name}.parquet")


def now_lit():
    return F.expr(f"timestamp_ntz'{NOW}'")


def _lit_list(values):
    return F.array(*[F.lit(v) for v in values])


def news_sources(spark: SparkSession, sf: str) -> DataFrame:
    s = table(spark, sf, "documents").select("source").distinct()
    sid = F.substring("source", 4, 10).cast("bigint")
    return s.select(
        sid.alias("id"), F.col("source").alias("slug"), F.col("source").alias("name"),
        F.concat(F.lit("https://"), "source", F.lit(".example")).alias("url"),
        F.get(_lit_list(vocab.BIAS_ZONES), (sid % 5).cast("int")).alias("bias_rating"),
        (sid != 19).alias("is_active"))


EXCLUDED_IMAGES = ["src3", "src7"]


def news_articles(spark: SparkSession, sf: str) -> DataFrame:
    d = table(spark, sf, "documents")
    i = F.col("doc_id")
    topics = _lit_list(vocab.TOPICS)
    minutes = (i * 37 % 43200).cast("int")

    def at(extra):
        base = F.expr("timestamp_ntz'2024-01-01 00:00:00'")
        return base + F.make_dt_interval(F.lit(0), F.lit(0), minutes + extra)

    def num(prefix, n):
        return F.concat(F.lit(prefix), (i % n).cast("string"))

    title = F.substring(F.substring_index("text", "\n", 1), 1, 80)
    return d.select(
        i.alias("id"),
        F.substring("source", 4, 10).cast("bigint").alias("source_id"),
        F.col("source").alias("source_slug"),
        F.concat(F.lit("https://"), "source", F.lit(".example/a/"), i.cast("string")).alias("url"),
        title.alias("title"),
        F.col("text").alias("body"),
        F.when(i % 19 == 0, None).when(i % 43 == 0, "N/A")
         .otherwise(F.substring("text", 1, 200)).alias("summary"),
        F.when(i % 5 == 0, None).otherwise(F.substring("text", 1, 120)).alias("main_event"),
        title.alias("story_identity"),
        F.when(i % 29 == 0, None).otherwise(at(0)).alias("published_at"),
        at(20).alias("created_at"),
        F.when(i % 37 == 0, None).otherwise(F.array_distinct(F.array(
            F.get(topics, (i % 13).cast("int")),
            F.get(topics, (F.floor(i / 13) % 13).cast("int"))))).alias("topics"),
        F.when(i % 31 == 0, None).otherwise(
            F.array(num("Ent ", 17), num("Org ", 11), num("Ent ", 5))).alias("entities"),
        F.get(_lit_list(["event", "event", "event", "opinion", "background", "aggregation"]),
              (i % 6).cast("int")).alias("article_type"),
        num("Loc ", 9).alias("location"),
        F.when(i % 7 == 0, None).otherwise(
            F.concat(F.lit("https://img.example/"), i.cast("string"))).alias("image_url"),
        F.when(i % 41 == 0, None).otherwise(i % 199).alias("story_id"),
    )


def article_vectors(spark: SparkSession, sf: str) -> DataFrame:
    """``(id, embedding array<double>)``: every article borrows one driver vector."""
    e = table(spark, sf, "embeddings")
    n = e.count()
    d = table(spark, sf, "documents").select(F.col("doc_id").alias("id"))
    return (d.withColumn("vec_id", F.col("id") % F.lit(n))
            .join(e.select("vec_id", F.col("embedding").cast("array<double>").alias("embedding")), "vec_id")
            .select("id", "embedding"))


def news_stories(spark: SparkSession, sf: str, entities: bool = False) -> DataFrame:
    from .plans.stories import cluster_facts
    a = news_articles(spark, sf)
    facts = cluster_facts(a.where("story_id is not null"), news_sources(spark, sf),
                          key="story_id", entities=entities)
    return facts.withColumnRenamed("story_id", "id")


def _event_tables(spark, sf):
    return table(spark, sf, "events")


def usage_log(spark: SparkSession, sf: str) -> DataFrame:
    e = _event_tables(spark, sf)
    odd_user = F.col("user_id") % 2 == 1
    return e.select(
        F.col("event_id").alias("id"),
        F.when(F.col("event_type").isin("click", "view"), "gemini").otherwise("openrouter").alias("provider"),
        F.when(odd_user, "gemini-fallback").otherwise("openrouter").alias("mode"),
        F.concat(F.lit("m"), (F.col("user_id") % 3).cast("string")).alias("model"),
        F.when(F.col("event_type") == "signup", "embedding").otherwise("chat").alias("operation"),
        F.concat(F.when(F.col("event_id") % 2 == 0, "scheduled").otherwise("manual"),
                 F.when(odd_user, "_recluster_storytitle").otherwise("_process_summarize")).alias("activity"),
        F.floor(F.col("value") * 10).cast("bigint").alias("prompt_tokens"),
        F.when(F.col("event_id") % 13 == 0, None).otherwise(
            F.floor("value").cast("bigint")).alias("completion_tokens"),
        F.col("ts").alias("called_at"))


def counter_samples(spark: SparkSession, sf: str) -> DataFrame:
    return _event_tables(spark, sf).select(
        F.col("event_id").alias("sample_id"), F.col("user_id").alias("project_id"),
        F.when(F.col("user_id") % 3 == 0, None).otherwise(
            F.concat(F.lit("br"), (F.col("user_id") % 3).cast("string"))).alias("branch_id"),
        F.col("ts").alias("collected_at"), F.floor(F.col("value") * 1000).cast("bigint").alias("bytes"))


def log_lines(spark: SparkSession, sf: str) -> DataFrame:
    e = _event_tables(spark, sf)
    n = F.floor(F.col("value") * 100).cast("bigint").cast("string")
    kind = F.col("event_type")
    return e.select(
        F.concat(F.lit("exec"), F.col("user_id").cast("string")).alias("execution"),
        F.col("ts"), F.col("event_id").alias("pos"),
        F.when(kind == "signup", "[12:00:00] INFO: Job finished")
         .when(kind == "purchase", F.concat(F.lit("    durationMs: "), n))
         .when(kind == "view", F.concat(F.lit("    count: "), n))
         .when(kind == "click", "[12:00:00] INFO: Job started")
         .otherwise(F.concat(F.lit('{"msg":"Job complete","durationMs":'), n, F.lit("}"))).alias("text"))


def job_execs(spark: SparkSession, sf: str) -> DataFrame:
    e = _event_tables(spark, sf).where(F.col("event_type").isin("purchase", "error"))
    secs = F.floor(F.col("value") * 10).cast("bigint")
    return e.select(
        F.concat(F.lit("job"), (F.col("user_id") % 6).cast("string")).alias("job"),
        F.concat(F.lit("exec"), F.col("event_id").cast("string")).alias("execution"),
        F.col("ts").alias("started_at"),
        F.when(F.col("event_id") % 17 == 0, None).otherwise(
            F.col("ts") + F.make_dt_interval(F.lit(0), F.lit(0), F.lit(0), secs.cast("decimal(18,6)"))
        ).alias("completed_at"),
        F.when(F.col("event_id") % 5 == 0, None).otherwise(
            F.when(F.col("event_type") == "error", "False").otherwise("True")).alias("completed_condition"),
        F.when(F.col("event_id") % 4 == 0, None).otherwise((secs * 3 / 4).cast("double")).alias("app_seconds"))


def job_limits(spark: SparkSession, sf: str) -> DataFrame:
    j = (_event_tables(spark, sf).select((F.col("user_id") % 6).alias("j")).distinct())
    return j.select(F.concat(F.lit("job"), F.col("j").cast("string")).alias("job"),
                    F.when(F.col("j") % 2 == 0, "500m").otherwise("1").alias("cpu"),
                    F.when(F.col("j") % 3 == 0, "512Mi").otherwise("1Gi").alias("memory"),
                    F.when(F.col("j") == 5, "").otherwise("600s").alias("timeout"))


def requests(spark: SparkSession, sf: str) -> DataFrame:
    return _event_tables(spark, sf).select(F.col("user_id").alias("key"), "ts",
                                           F.col("event_id").alias("pos"))
