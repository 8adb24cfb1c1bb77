"""Streaming jobs over the driver tables: each runs to the end of the input and returns what it wrote."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession, Window, functions as F

from tracelake.functions.text import local_day
from tracelake.operators.usage import dedup_usage
from tracelake.plans.binding import EVENTS_SQL, table
from tracelake.session import shared_folder
from tracelake.streaming import jobs, tail, versions

#: Micro-batches that the event table is landed as.
BATCHES = 4
QUERIES: dict = {}
ORACLES: dict = {}


def query(sql: str | None = None):
    def register(fn):
        QUERIES[fn.__name__] = fn
        if sql:
            ORACLES[fn.__name__] = sql
        return fn

    return register


def _run_dir(spark: SparkSession) -> str:
    """A new folder below the shared checkpoint folder."""
    return f"{shared_folder(spark)}/run-{uuid.uuid4().hex}"


def _stream(spark: SparkSession, sf: str) -> DataFrame:
    """The event table landed as several files, each a batch; rows are dealt by a hash, so every batch brings late ones."""
    spark.conf.set("spark.sql.session.timeZone", "UTC")
    landed = f"{_run_dir(spark)}/landed"
    events = table(spark, sf, "events")
    dealt = events.withColumn("deal", F.pmod(F.xxhash64("event_id"), F.lit(BATCHES)))
    dealt.repartition(BATCHES, "deal").write.partitionBy("deal").parquet(landed)
    e = spark.readStream.schema(events.schema).option("maxFilesPerTrigger", 1).parquet(landed)
    return e.select(
        "user_id", "event_id", "event_type", F.get_json_object("props", "$.k").cast("bigint").alias("k"), F.round(F.col("value") * 100).cast("bigint").alias("units"),
        F.col("ts").cast("timestamp").alias("ts"), F.unix_millis(F.col("ts").cast("timestamp")).alias("ts_ms"),
    )


def _usage_rows(e: DataFrame) -> DataFrame:
    return e.where(~F.col("event_type").isin("error", "signup")).select(
        F.col("user_id").cast("string").alias("file"), F.lit(0).alias("epoch"), F.col("k").cast("string").alias("message_key"), F.col("event_id").alias("ord"),
        F.col("user_id").cast("string").alias("session_id"), F.col("event_type").alias("model"), local_day("ts_ms").alias("day"), F.col("units").alias("input"), F.col("k").alias("output"),
        F.lit(0).cast("bigint").alias("cache_read"), F.lit(0).cast("bigint").alias("cache_create"),
    )


def _sums(df: DataFrame) -> DataFrame:
    return df.groupBy("session_id", "model").agg(F.sum("messages").alias("messages"), F.sum("input").alias("input"), F.sum("output").alias("output")).where("messages <> 0")


_DEDUP = f"""WITH {EVENTS_SQL}, won AS (SELECT * FROM ev WHERE event_type NOT IN ('error', 'signup') QUALIFY row_number() OVER (PARTITION BY user_id, k ORDER BY event_id DESC) = 1)
    SELECT CAST(user_id AS VARCHAR) AS session_id, event_type AS model, CAST(count(*) AS BIGINT) AS messages, CAST(sum(units) AS BIGINT) AS input, CAST(sum(k) AS BIGINT) AS output FROM won GROUP BY 1, 2"""


@query(_DEDUP)
def stream_dedup(spark, sf):
    where = _run_dir(spark)
    jobs.stream_usage(_usage_rows(_stream(spark, sf)), f"{where}/out", f"{where}/ckpt", trigger={"availableNow": True}).awaitTermination()
    return _sums(jobs.usage_deltas(spark, f"{where}/out"))


@query(f"SELECT CAST(count(*) AS BIGINT) AS groups, CAST(0 AS BIGINT) AS different FROM ({_DEDUP})")
def stream_equals_batch(spark, sf):
    """The streamed latest row of every message against the batch result of the same rows."""
    from tracelake.plans.binding import event_lines

    where, key = _run_dir(spark), ["file", "epoch", "message_key"]
    q = jobs.write_versions(jobs.stream_latest_usage(_usage_rows(_stream(spark, sf)), key), f"{where}/out", f"{where}/ckpt", {"availableNow": True})
    q.awaitTermination()
    one = F.lit(1).cast("bigint")
    streamed = _sums(jobs.latest_versions(spark.read.parquet(f"{where}/out"), key).withColumn("messages", one))
    won = dedup_usage(_usage_rows(event_lines(spark, sf)), "message_key", "ord", "last", ["file"])
    batch = won.withColumn("messages", one)
    both = streamed.withColumn("side", F.lit(0)).unionByName(_sums(batch).withColumn("side", F.lit(1)))
    g = both.groupBy("session_id", "model", "messages", "input", "output").agg(F.count(F.lit(1)).alias("n"))
    return g.agg(F.count(F.lit(1)).alias("groups"), F.count_if(F.col("n") != 2).alias("different"))


@query(f"WITH {EVENTS_SQL} SELECT user_id, ts_ms // 3600000 * 3600000 AS window_start, count(*) AS n FROM ev GROUP BY 1, 2")
def stream_activity(spark, sf):
    where = _run_dir(spark)
    jobs.stream_counts(_stream(spark, sf), f"{where}/out", f"{where}/ckpt", ["user_id"], "ts", "1 hour", {"availableNow": True}).awaitTermination()
    return jobs.window_counts(spark, f"{where}/out", ["user_id"])


@query(
    f"""WITH {EVENTS_SQL}, a AS (SELECT user_id, k, max(ts_ms) AS last_ts, arg_max(event_type, ts_ms) AS t FROM ev GROUP BY 1, 2), wm AS (SELECT max(ts_ms) AS w FROM ev)
    SELECT CAST(user_id AS VARCHAR) AS session_id, CAST(k AS VARCHAR) AS agent_key,
      CASE WHEN t = 'purchase' THEN 'done' WHEN w >= last_ts + 86400000 THEN 'stalled' ELSE 'running' END AS state,
      CASE WHEN t <> 'purchase' AND w >= last_ts + 86400000 THEN last_ts + 86400000 ELSE last_ts END AS state_at FROM a CROSS JOIN wm"""
)
def stream_lifecycle(spark, sf):
    e = _stream(spark, sf).select(
        F.col("user_id").cast("string").alias("session_id"), F.col("k").cast("string").alias("agent_key"), "ts_ms", (F.col("event_type") == "purchase").alias("finished")
    )
    where = _run_dir(spark)
    jobs.stream_lifecycle(e, f"{where}/out", f"{where}/ckpt", stall_ms=86_400_000, trigger={"availableNow": True}).awaitTermination()
    # the state as the last change tells it, the time from the table
    told = spark.read.parquet(f"{where}/out/changes").groupBy("session_id", "agent_key").agg(F.max_by("state", "batch").alias("state"))
    kept = versions.current(spark, f"{where}/out", ["session_id", "agent_key"], "session_id string, agent_key string, at bigint")
    return told.join(kept, ["session_id", "agent_key"]).select("session_id", "agent_key", "state", F.col("at").alias("state_at"))


@query(f"WITH {EVENTS_SQL} SELECT user_id, max(event_id) AS last_seen FROM ev GROUP BY 1")
def stream_change_feed(spark, sf):
    """Each user's newest event as the changes of a feed tell it: the last change of a user."""
    where = _run_dir(spark)
    newest = _stream(spark, sf).groupBy("user_id").agg(F.max("event_id").alias("newest"))

    def sink(changed: DataFrame, batch_id: int) -> None:
        changed.write.mode("overwrite").parquet(f"{where}/feed/batch={batch_id}")

    jobs.change_feed(newest, ["user_id"], ["newest"], f"{where}/store", sink, f"{where}/ckpt", {"availableNow": True}).awaitTermination()
    told = spark.read.parquet(f"{where}/feed").select("user_id").distinct()
    kept = versions.current(spark, f"{where}/store", ["user_id"], "user_id bigint, newest bigint")
    return kept.join(told, "user_id", "left_semi").select("user_id", F.col("newest").alias("last_seen"))


# ---------------------------------------------------------------------------------------------- landed chunks (S16, ST1, ST7)
_LINES = """l AS (SELECT 'u' || CAST(user_id % 7 AS VARCHAR) AS file, CAST(event_id >= 6000 AS INTEGER) AS epoch, event_id // 1500 AS chunk, event_id,
      CAST(event_id AS VARCHAR) || ',' || event_type || CASE WHEN event_id % 3 = 0 THEN ' é' ELSE '' END AS body, CASE WHEN event_id % 2 = 0 THEN 1 ELSE 0 END AS cr FROM events),
    o AS (SELECT *, octet_length(encode(body)) + cr + 1 AS size FROM l),
    p AS (SELECT *, sum(size) OVER (PARTITION BY file, epoch ORDER BY event_id) - size AS ord FROM o)"""


def chunk_share(chunks: int) -> int:
    """Files of a batch, so that so many chunks come in ``BATCHES`` batches (at least 9 files each)."""
    return max(9, -(-chunks // BATCHES))


@query(f"WITH {_LINES} SELECT file, epoch, count(*) AS n, CAST(sum(ord) AS BIGINT) AS offsets, CAST(max(ord) AS BIGINT) AS last, CAST(sum(event_id) AS BIGINT) AS ids, sum(length(body)) AS chars FROM p GROUP BY 1, 2")
def stream_chunks(spark: SparkSession, sf: str) -> DataFrame:
    """Raw bytes to lines: several chunks a log, line ends of both kinds, and a truncated log (a new epoch starts at 0)."""
    run = _run_dir(spark)
    e = table(spark, sf, "events")
    body = F.concat_ws(",", F.col("event_id").cast("string"), "event_type")
    body = F.concat(body, F.when(F.col("event_id") % 3 == 0, F.lit(" é")).otherwise(""), F.when(F.col("event_id") % 2 == 0, F.lit("\r")).otherwise(""))
    rows = e.select(
        F.concat(F.lit("u"), (F.col("user_id") % 7).cast("string")).alias("file"), (F.col("event_id") >= 6000).cast("int").alias("epoch"), F.expr("event_id div 1500").alias("chunk"), "event_id", body.alias("value")
    )
    sizes = rows.groupBy("file", "epoch", "chunk").agg(F.sum(F.octet_length("value") + 1).alias("bytes"))
    before = F.sum("bytes").over(Window.partitionBy("file", "epoch").orderBy("chunk").rowsBetween(Window.unboundedPreceding, -1))
    placed = sizes.select("file", "epoch", "chunk", F.coalesce(before, F.lit(0)).cast("bigint").alias("offset"))
    landed = rows.join(placed, ["file", "epoch", "chunk"]).repartition("file", "epoch", "offset").sortWithinPartitions("file", "epoch", "offset", "event_id")
    landed.select("file", "epoch", "offset", "value").write.partitionBy("file", "epoch", "offset").text(f"{run}/landed")
    # a fixed number of batches, however many chunks there are: each batch lists the whole folder and commits
    lines = tail.read_chunks(spark, f"{run}/landed", max_files=chunk_share(placed.count())).select("file", "epoch", "ord", "value")
    q = lines.writeStream.format("parquet").option("checkpointLocation", f"{run}/ck").option("path", f"{run}/out").trigger(availableNow=True).start()
    q.awaitTermination()
    out = spark.read.schema(lines.schema).parquet(f"{run}/out")
    return out.groupBy("file", "epoch").agg(
        F.count(F.lit(1)).alias("n"), F.sum("ord").alias("offsets"), F.max("ord").alias("last"), F.sum(F.split("value", ",")[0].cast("bigint")).alias("ids"), F.sum(F.length("value")).alias("chars")
    )


def _in_time(spark: SparkSession, sf: str, late: bool = False) -> DataFrame:
    """The event table landed batch after batch in the order of time; with ``late`` every tenth row comes one batch later."""
    landed = f"{_run_dir(spark)}/landed"
    events = table(spark, sf, "events")
    batch = F.least(F.floor(F.dayofmonth("ts") / 8), F.lit(BATCHES - 1))
    dealt = events.withColumn("deal", batch + F.when(F.lit(late) & (F.col("event_id") % 10 == 0), 1).otherwise(0))
    for k in range(BATCHES + late):
        dealt.where(F.col("deal") == k).coalesce(1).write.mode("append").parquet(landed)
    e = spark.readStream.schema(events.schema).option("maxFilesPerTrigger", 1).parquet(landed)
    return e.select("user_id", "event_id", F.col("ts").cast("timestamp").alias("ts"), F.to_date("ts").alias("day"))


@query("SELECT user_id, count(*) AS days, min(day) AS first_day FROM (SELECT DISTINCT user_id, CAST(ts AS DATE) AS day FROM events) GROUP BY 1")
def stream_first_wins(spark: SparkSession, sf: str) -> DataFrame:
    """Of the lines of a user and day the first that comes stays; what is remembered of a day leaves with the watermark."""
    run = _run_dir(spark)
    first = jobs.stream_usage_first(_in_time(spark, sf), ["user_id", "day"], "ts", "1 day").select("user_id", "day")
    q = first.writeStream.format("parquet").option("checkpointLocation", f"{run}/ck").option("path", f"{run}/out").trigger(availableNow=True).start()
    q.awaitTermination()
    return spark.read.schema(first.schema).parquet(f"{run}/out").groupBy("user_id").agg(F.count(F.lit(1)).alias("days"), F.min("day").alias("first_day"))


_SLIDING = "SELECT (epoch_ms(ts) // {slide} - i) * {slide} AS window_start, count(*) AS n FROM events, (SELECT unnest(range({k})) AS i) GROUP BY 1"


def _rolling(spark: SparkSession, sf: str, size: str, slide: str) -> DataFrame:
    """The last count of every sliding window, from updates over several batches with late rows."""
    run = _run_dir(spark)
    counts = jobs.stream_activity(_in_time(spark, sf, late=True), (), "ts", "17 days", size, slide)

    def flush(batch: DataFrame, batch_id: int) -> None:
        batch.write.mode("overwrite").parquet(f"{run}/out/batch={batch_id}")

    versions.start(counts, flush, f"{run}/ck", {"availableNow": True}, "update").awaitTermination()
    return spark.read.parquet(f"{run}/out").groupBy("window_start").agg(F.max_by("n", "batch").alias("n"))


@query(_SLIDING.format(slide=600_000, k=3))
def stream_rolling_minutes(spark: SparkSession, sf: str) -> DataFrame:
    """Events of the last 30 minutes, every 10 minutes."""
    return _rolling(spark, sf, "30 minutes", "10 minutes")


@query(_SLIDING.format(slide=900_000, k=4))
def stream_rolling_hour(spark: SparkSession, sf: str) -> DataFrame:
    """Calls of the last hour, every quarter."""
    return _rolling(spark, sf, "1 hour", "15 minutes")
