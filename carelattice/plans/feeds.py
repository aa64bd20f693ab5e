"""Log and stream queries on the given tables."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from carelattice.operators import compliance, latency
from carelattice.plans import auditing, roles, writing
from carelattice.plans.registry import Tables, query
from carelattice.session import cut_lineage, new_path
from carelattice.sources.readers import parse_app_log
from carelattice.streaming import feeds, stateful


def _log_lines(t: Tables) -> DataFrame:
    """Events as log lines: even ones in the old format, odd ones in the current one."""
    old = F.col("event_id") % 2 == 0
    at = F.date_format("ts", "yyyy-MM-dd HH:mm:ss")
    answer = F.concat(
        F.lit("POST /intake 201 patient_id="), F.col("user_id") + 3_000_000_000, F.lit(" elapsed="), F.col("value"),
        F.lit("s"),
    )
    request = F.concat(F.lit('POST /intake body={"p": '), F.col("props"), F.lit("}"))
    health = F.concat(F.lit("GET /healthz 200 "), F.col("value"), F.lit("ms"))
    message = (
        F.when(F.col("event_type") == "signup", answer)
        .when(F.col("event_type") == "view", health)
        .when(F.col("event_type") == "click", F.lit("something else entirely"))
        .otherwise(request)
    )
    current = F.concat(at, F.lit(",250 INFO [intake-service] "), message)
    line = F.when(old, F.concat(at, F.lit(" INFO  "), message)).otherwise(current)
    return t.events.select(
        "event_id", F.concat(F.lit("log"), F.col("user_id")).alias("source"), line.alias("value")
    )


@query(f"""
    SELECT event_id,
           date_trunc('second', ts)
             + CASE WHEN event_id % 2 = 1 THEN INTERVAL 250 MILLISECOND ELSE INTERVAL 0 SECOND END
             AS ts,
           CASE WHEN event_id % 2 = 1 THEN 'intake-service' END AS service,
           CASE event_type WHEN 'view' THEN 'GET' WHEN 'click' THEN NULL ELSE 'POST' END AS method,
           CASE event_type WHEN 'view' THEN '/healthz' WHEN 'click' THEN NULL ELSE '/intake' END
             AS path,
           CASE event_type WHEN 'signup' THEN 201 WHEN 'view' THEN 200 END AS status,
           round(CASE event_type WHEN 'signup' THEN value WHEN 'view' THEN value / 1000 END, 9)
             AS elapsed_s,
           CASE event_type WHEN 'signup' THEN user_id + 3000000000 END AS patient_id,
           CASE WHEN event_type IN ('purchase', 'error') THEN '{{"p": ' || props || '}}' END AS body
    FROM events""")
def app_log(t: Tables) -> DataFrame:
    parsed = parse_app_log(_log_lines(t).drop("source"))
    return parsed.select(
        "event_id", F.col("ts").cast("timestamp_ntz").alias("ts"), "service", "method", "path",
        "status", F.round("elapsed_s", 9).alias("elapsed_s"), "patient_id", "body",
    )


@query("""
    WITH e AS (
      SELECT user_id, date_trunc('second', ts)
             + CASE WHEN event_id % 2 = 1 THEN INTERVAL 250 MILLISECOND ELSE INTERVAL 0 SECOND END
             AS moment, event_type, value, CASE WHEN event_type <> 'signup' THEN props END AS props,
             CASE event_type WHEN 'signup' THEN 201 END AS status
      FROM events WHERE event_type NOT IN ('view', 'click')),
    walked AS (
      SELECT *, sum(CASE WHEN status IS NULL THEN 1 ELSE -1 END) OVER w AS open,
             count(*) FILTER (WHERE status IS NULL) OVER w AS asked,
             count(*) FILTER (WHERE status IS NOT NULL) OVER w AS answered
      FROM e WINDOW w AS (PARTITION BY user_id ORDER BY moment, status NULLS FIRST, props, value
                          ROWS UNBOUNDED PRECEDING)),
    lows AS (
      SELECT *, least(0, min(open) OVER w) AS low FROM walked
      WINDOW w AS (PARTITION BY user_id ORDER BY moment, status NULLS FIRST, props, value
                   ROWS UNBOUNDED PRECEDING)),
    numbered AS (
      SELECT *, low < coalesce(lag(low) OVER w, 0) AS lone FROM lows
      WINDOW w AS (PARTITION BY user_id ORDER BY moment, status NULLS FIRST, props, value))
    SELECT 'log' || a.user_id AS source, a.moment AS answered_at, r.moment AS requested_at,
           '{"p": ' || r.props || '}' AS request_body, a.user_id + 3000000000 AS patient_id,
           a.value AS elapsed_s
    FROM numbered a LEFT JOIN numbered r
      ON r.user_id = a.user_id AND r.status IS NULL AND NOT a.lone AND r.asked = a.answered + a.low
    WHERE a.status = 201""")
def pair_intake(t: Tables) -> DataFrame:
    log = cut_lineage(parse_app_log(_log_lines(t).drop("event_id")), "log")
    paired = latency.pair_intake(log)
    return paired.select(
        "source",
        F.col("answered_at").cast("timestamp_ntz").alias("answered_at"),
        F.col("requested_at").cast("timestamp_ntz").alias("requested_at"),
        "request_body", "patient_id", "elapsed_s",
    )


def _streamed(t: Tables, name: str) -> DataFrame:
    """A given table as a stream."""
    batch = getattr(t, name)
    return (
        t.spark.readStream.schema(batch.schema)
        .option("pathGlobFilter", f"{name}.parquet")
        .parquet(t.folder)
    )


def _in_parts(t: Tables, parts: int = 3) -> DataFrame:
    """The events as a stream of `parts` micro-batches or more, in order of their time."""
    path = new_path(t.spark, "parts")
    files = 2
    bounds = t.events.select(F.unix_micros(F.col("ts").cast("timestamp")).alias("at"))
    low, high = bounds.agg(F.min("at"), F.max("at")).first()
    step = (high - low) // parts + 1 if low is not None else 1
    part = F.floor((F.unix_micros(F.col("ts").cast("timestamp")) - F.lit(low)) / step)
    for k in range(parts):
        t.events.where(part == k).repartition(files).write.mode("append").parquet(path)
    return t.spark.readStream.schema(t.events.schema).option("maxFilesPerTrigger", files).parquet(path)


class _Parts(Tables):
    """The events as a stream in several micro-batches."""

    def __init__(self, t: Tables):
        super().__init__(t.spark, t.folder)
        self.events = _in_parts(t)


def run_to_table(t: Tables, stream: DataFrame, label: str) -> DataFrame:
    """Run an append stream over all that is there and read what it wrote."""
    path = new_path(t.spark, label)
    run = (
        stream.writeStream.format("parquet")
        .option("path", f"{path}/rows")
        .option("checkpointLocation", f"{path}/checkpoint")
        .trigger(availableNow=True)
        .start()
    )
    run.awaitTermination()
    return t.spark.read.schema(stream.schema).parquet(f"{path}/rows")


class _Streams(Tables):
    """The given tables, each read as a stream."""

    def __init__(self, t: Tables):
        super().__init__(t.spark, t.folder)

    def __getattr__(self, name: str) -> DataFrame:
        return _streamed(Tables(self.spark, self.folder), name)


@query("""
    SELECT o_orderkey AS message_id,
           CASE WHEN o_orderstatus = 'P' THEN 'M' ELSE '' END || o_custkey AS mrn,
           o_orderpriority AS allergy, 'drug' || o_custkey AS medication
    FROM orders""")
def stream_hl7(t: Tables) -> DataFrame:
    messages = writing._messages(_Streams(t)).withColumn(
        "arrived_at", F.lit("2024-01-01").cast("timestamp")
    )
    records = feeds.stream_records(messages).select(
        "message_id", "mrn",
        F.array_join("allergies", ",").alias("allergy"),
        F.array_join("medications", ",").alias("medication"),
    )
    return run_to_table(t, records, "hl7")


_CLOSED_SQL = """
    SELECT date_trunc('day', ts) AS window_start, value,
           row_number() OVER (PARTITION BY date_trunc('day', ts) ORDER BY value) AS rank,
           count(*) OVER (PARTITION BY date_trunc('day', ts)) AS n
    FROM events WHERE value IS NOT NULL AND date_trunc('day', ts) < (
      SELECT date_trunc('day', max(ts) - INTERVAL 10 MINUTE) FROM events)"""


def _closed_windows(t: Tables) -> DataFrame:
    """Latency by day over the events in several micro-batches, of the windows closed at the end."""
    requests = roles.log_requests(_Parts(t)).withColumn(
        "answered_at", F.col("answered_at").cast("timestamp")
    )
    return run_to_table(t, feeds.stream_latency(requests, "1 day"), "latency")


@query(f"""
    SELECT window_start, max(n) AS n, max(value) AS max,
           min(value) FILTER (WHERE rank >= ceil(0.5 * n)) AS p50,
           min(value) FILTER (WHERE rank >= ceil(0.95 * n)) AS p95
    FROM ({_CLOSED_SQL}) c GROUP BY 1 HAVING max(n) <= {feeds.SKETCH_ITEMS}""")
def stream_latency(t: Tables) -> DataFrame:
    """Windows whose values all fit a sketch, so that its percentiles are exact."""
    windows = _closed_windows(t).where(F.col("n") <= feeds.SKETCH_ITEMS).drop("sketch")
    return windows.withColumn("window_start", F.col("window_start").cast("timestamp_ntz"))


@query(f"""
    SELECT TIMESTAMP '1970-01-01' + to_days(CAST(7 * (CAST(epoch(window_start) AS BIGINT) // 604800) AS INTEGER)) AS window_start,
           count(*) AS n, max(value) AS max, true AS p50_held, true AS p95_held
    FROM ({_CLOSED_SQL}) c GROUP BY 1""")
def stream_latency_weeks(t: Tables) -> DataFrame:
    """Weeks merged from the sketches of their days; each percentile is held against the exact ranks
    of the week's values."""
    days = _closed_windows(t)
    windows = cut_lineage(feeds.merge_latency(days, "7 days").drop("sketch"), "weeks")
    day, week = (F.window(F.col("ts").cast("timestamp"), w)["start"] for w in ("1 day", "7 days"))
    values = (
        t.events.select(day.alias("_day"), "ts", "value")
        .join(days.select(F.col("window_start").alias("_day")), "_day", "left_semi")
        .select(week.alias("window_start"), "value")
    )
    counts = values.join(windows, "window_start").groupBy("window_start").agg(
        *[
            F.count_if(F.col("value") < F.col(p)).alias(f"{p}_below") for p in feeds.QUANTILES
        ],
        *[F.count_if(F.col("value") <= F.col(p)).alias(f"{p}_upto") for p in feeds.QUANTILES],
    )

    def held(name: str, q: float):
        low, high = (q - feeds.SKETCH_ERROR) * F.col("n"), (q + feeds.SKETCH_ERROR) * F.col("n")
        return ((F.col(f"{name}_below") <= high) & (F.col(f"{name}_upto") >= low)).alias(f"{name}_held")

    return windows.join(counts, "window_start").select(
        F.col("window_start").cast("timestamp_ntz").alias("window_start"), "n", "max",
        *[held(name, q) for name, q in feeds.QUANTILES.items()],
    )


@query(f"SELECT request_id, slot_id, outcome FROM ({writing._OUTCOMES_SQL}) x")
def stream_bookings(t: Tables) -> DataFrame:
    requests = writing._bookings(_Parts(t)).withColumn(
        "requested_at", F.col("requested_at").cast("timestamp")
    )
    path = new_path(t.spark, "bookings")
    stateful.start_bookings(
        requests, writing._held(t), f"{path}/outcomes", f"{path}/checkpoint"
    ).awaitTermination()
    found = stateful.booking_results(t.spark, f"{path}/outcomes", requests)
    return found.select("request_id", "slot_id", "outcome")


@query(auditing.ID_WALK_SQL)
def stream_id_walk(t: Tables) -> DataFrame:
    events = roles.access_events(_Parts(t)).withColumn("ts", F.col("ts").cast("timestamp"))
    reads = compliance.as_reads(events, "user_id", "ts", "event_id", "k")
    path = new_path(t.spark, "walks")
    stateful.start_walk_alerts(reads, path, f"{path}/checkpoint").awaitTermination()
    found = stateful.walk_alerts(t.spark, path, reads, min_run=2)
    return found.withColumns(
        {c: F.col(c).cast("timestamp_ntz") for c in ("first_at", "last_at")}
    )
