"""Queries that write the given tables through sinks and read them back through readers."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from carelattice.operators import compliance, writes
from carelattice.plans import roles
from carelattice.plans.feeds import run_to_table
from carelattice.plans.registry import Tables, query
from carelattice.session import new_path
from carelattice.sources import readers, sinks
from carelattice.streaming import feeds


@query(f"""
    SELECT id, patient_id, slot_id, coalesce(status, 'confirmed') AS status, created_at
    FROM ({roles.APPOINTMENTS_SQL}) a""")
def appointments_from_csv(t: Tables) -> DataFrame:
    """All appointments as a CSV snapshot of the older kind, read and brought to today's columns."""
    path = new_path(t.spark, "csv")
    rows = roles.appointments(t).select(
        "id", "patient_id", "slot_id", "status",
        F.date_format("created_at", "yyyy-MM-dd'T'HH:mm:ss.SSSSSS").alias("created_at"),
    )
    rows.write.csv(path, header=True)
    read = readers.read_csv_snapshot(t.spark, path, "appointments").where("_corrupt is null")
    aligned = readers.align_generation(read.drop("_corrupt"), "appointments")
    return aligned.select(
        "id", "patient_id", "slot_id", "status", F.col("created_at").cast("timestamp_ntz").alias("created_at")
    )


@query("""
    SELECT o_orderkey AS id, o_custkey AS patient_id,
           CASE WHEN o_orderkey % 2 = 0 THEN o_orderpriority END AS encounter_type,
           CASE WHEN o_orderkey % 2 = 0 THEN o_orderstatus END AS status
    FROM orders""")
def encounters_of_two_generations(t: Tables) -> DataFrame:
    """Odd orders appended as files of an older generation, even ones as newer files."""
    root = new_path(t.spark, "generations")
    rows = roles.encounters(t)
    sinks.append_table(rows.where("id % 2 = 1").select("id", "patient_id"), root, "encounters")
    newer = rows.where("id % 2 = 0").select("id", "patient_id", "encounter_type", "status")
    sinks.append_table(newer, root, "encounters")
    return readers.read_table(t.spark, root, "encounters").select("id", "patient_id", "encounter_type", "status")


@query(f"""
    SELECT id, CASE WHEN id % 3 = 0 THEN 'denied' WHEN id % 2 = 0 THEN 'fulfilled' ELSE status END AS status
    FROM ({roles.ROI_SQL}) r""")
def requests_after_status_changes(t: Tables) -> DataFrame:
    """Status changes appended in two batches, the later one winning."""
    root = new_path(t.spark, "changes")
    requests = roles.roi_requests(t).select("id", "status")
    for every, status, day in ((3, "denied", "2024-01-02"), (2, "fulfilled", "2024-01-01")):
        changed = requests.where(F.col("id") % every == 0).select(
            "id", F.lit(status).alias("status"), F.lit(day).cast("timestamp").alias("changed_at")
        )
        sinks.append_status_changes(changed, root, "roi_requests")
    changes = t.spark.read.parquet(f"{root}/roi_requests_status")
    return sinks.current_state(requests, changes).select("id", "status")


#: Bytes of message files in a micro-batch.
_BATCH = 16 << 20


@query(f"""
    SELECT id, CASE WHEN id IN (SELECT o_custkey * 10 FROM orders) THEN 'cancelled' ELSE status END AS status,
           id IN (SELECT o_custkey * 10 FROM orders) AND status IS DISTINCT FROM 'cancelled' AS changed
    FROM ({roles.APPOINTMENTS_SQL}) a""")
def appointments_after_changes(t: Tables) -> DataFrame:
    """Appointments kept in parts: only the changed rows are appended, then only the parts that hold
    one are written again."""
    root = new_path(t.spark, "cancelled")
    sinks.save_parts(roles.appointments(t), f"{root}/appointments", part_rows=1_000)
    held = sinks.read_parts(t.spark, f"{root}/appointments")
    asked = t.orders.select((F.col("o_custkey") * 10).alias("appointment_id"))
    at = F.lit("2024-02-01").cast("timestamp")
    sinks.append_status_changes(writes.cancellation_changes(asked, held, at), root, "appointments")
    changes = t.spark.read.parquet(f"{root}/appointments_status")
    sinks.compact_parts(t.spark, f"{root}/appointments", changes, part_rows=1_000)
    after = sinks.read_parts(t.spark, f"{root}/appointments")
    marked = changes.select("id", F.lit(True).alias("changed"))
    return after.join(marked, "id", "left").select(
        "id", "status", F.coalesce("changed", F.lit(False)).alias("changed")
    )


_CALLS_SQL = "SELECT DISTINCT o_custkey AS id FROM orders"


@query(f"""
    SELECT id, 'fulfilled' AS status, TIMESTAMP '2024-02-01' AS changed_at FROM ({roles.ROI_SQL}) r
    WHERE status <> 'fulfilled' AND id IN ({_CALLS_SQL})""")
def fulfilment_changes(t: Tables) -> DataFrame:
    """Only the rows that a batch of calls changes, as they are appended and read back."""
    root = new_path(t.spark, "fulfilled")
    calls = t.orders.select(F.col("o_custkey").alias("request_id"))
    at = F.lit("2024-02-01").cast("timestamp_ntz")
    changes = writes.fulfilment_changes(calls, roles.roi_requests(t), at)
    sinks.append_status_changes(changes, root, "roi_requests")
    return t.spark.read.schema(changes.schema).parquet(f"{root}/roi_requests_status")


@query(f"""
    WITH called AS (SELECT id, patient_id FROM ({roles.ROI_SQL}) r WHERE id IN ({_CALLS_SQL})),
    placed AS (
      SELECT o_custkey AS patient_id, l_linestatus,
             row_number() OVER packet AS n, (row_number() OVER packet - 1) // 40 AS page
      FROM orders JOIN lineitem ON l_orderkey = o_orderkey
      WINDOW packet AS (PARTITION BY o_custkey ORDER BY l_orderkey, l_linenumber, l_partkey, l_suppkey))
    SELECT id AS request_id, called.patient_id, COALESCE(page, 0)::INTEGER AS page,
           count(l_linestatus) AS n_records, COALESCE(string_agg(l_linestatus, '' ORDER BY n), '') AS states
    FROM called LEFT JOIN placed USING (patient_id) GROUP BY 1, 2, 3""")
def fulfil_packets(t: Tables) -> DataFrame:
    """What each called request releases, page by page."""
    calls = t.orders.select(F.col("o_custkey").alias("request_id"))
    records = roles.patient_records(t).withColumn("id", F.struct("encounter_id", "id"))
    packets = writes.fulfil_packets(calls, roles.roi_requests(t), records, page_rows=40)
    return packets.select(
        "request_id", "patient_id", "page",
        F.size("records").cast("long").alias("n_records"),
        F.array_join(F.transform("records", lambda r: r["status"]), "").alias("states"),
    )


def _one_file_each(texts: DataFrame, path: str) -> str:
    """Write every row's `value` as a file of its own in one folder, by as many tasks as a shuffle has."""
    tasks = int(texts.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    texts.select("value").repartition(tasks).write.option("maxRecordsPerFile", 1).text(path)
    return path


@query("""
    SELECT s_suppkey::VARCHAR AS mrn, 'nation' || s_nationkey AS allergy, 'dose' || s_suppkey AS medication
    FROM supplier WHERE s_suppkey % 7 <> 0
    UNION ALL SELECT NULL, NULL, 'empty' FROM supplier WHERE s_suppkey % 7 = 0""")
def stream_hl7_files(t: Tables) -> DataFrame:
    """Suppliers as message files, every seventh blank, streamed a bounded size at a time; refused messages,
    of the same files read as a table, stand beside the records."""
    key = F.col("s_suppkey")
    message = F.concat(
        F.lit("MSH|^~\\&|S|S|P|C|20240101||ADT^A01|"), key, F.lit("\rPID|1||"), key, F.lit("||A^B||19700101|F\r"),
        F.lit("AL1|1|DA|p^nation"), F.col("s_nationkey"), F.lit("\rRXA|0|1|x||dose"), key,
    )
    texts = t.supplier.select(F.when(key % 7 == 0, F.lit(" ")).otherwise(message).alias("value"))
    path = _one_file_each(texts, new_path(t.spark, "messages"))
    feed = readers.stream_hl7(t.spark, path, bytes_per_trigger=_BATCH)
    records = run_to_table(t, feeds.stream_records(feed), "hl7-files").select(
        "mrn", F.array_join("allergies", ",").alias("allergy"),
        F.array_join("medications", ",").alias("medication"),
    )
    refused = feeds.stream_rejects(readers.read_hl7(t.spark, path)).select(
        F.lit(None).cast("string").alias("mrn"), F.lit(None).cast("string").alias("allergy"),
        F.col("reject_reason").alias("medication"),
    )
    return records.unionByName(refused)


@query("""
    SELECT o_orderkey AS request_id, o_custkey AS path_patient_id, o_custkey + o_orderkey % 5 AS token_patient_id
    FROM orders WHERE o_orderkey % 5 <> 0 AND o_orderkey % 11 <> 0""")
def captured_chart_requests(t: Tables) -> DataFrame:
    """Orders as requests in capture files of some hundred each; every eleventh has no token."""
    key, owner = F.col("o_orderkey"), F.col("o_custkey")
    token = F.concat(F.lit("Bearer <patient-"), owner + key % 5, F.lit("-token>"))
    header = F.struct(F.lit("Authorization").alias("name"), token.alias("value"))
    none = F.array().cast("array<struct<name: string, value: string>>")
    entry = F.struct(
        F.lit("2024-01-01T00:00:00.000Z").alias("startedDateTime"),
        F.struct(
            F.lit("GET").alias("method"),
            F.concat(F.lit("https://portal.example/patients/"), owner, F.lit("/records")).alias("url"),
            F.when(key % 11 == 0, none).otherwise(F.array(header)).alias("headers"),
        ).alias("request"),
        F.struct(F.lit(200).alias("status"), key.cast("string").alias("comment")).alias("response"),
    )
    captures = t.orders.groupBy(F.floor(key / 500).alias("file")).agg(F.collect_list(entry).alias("entries"))
    texts = captures.select(F.to_json(F.struct(F.struct("entries").alias("log"))).alias("value"))
    entries = readers.read_har(t.spark, _one_file_each(texts, new_path(t.spark, "captures")))
    found = compliance.foreign_chart_requests(entries)
    return found.select(
        F.col("comment").cast("long").alias("request_id"), "path_patient_id", "token_patient_id"
    )


@query("""
    SELECT c_name AS query, c_custkey AS expected_patient_id, c_mktsegment AS expected_answer,
           count(o_orderkey) AS n_cited, COALESCE(sum(o_orderkey), 0)::BIGINT AS cited
    FROM customer LEFT JOIN orders ON o_custkey = c_custkey GROUP BY ALL""")
def goldset_cases(t: Tables) -> DataFrame:
    """Customers as gold-set cases that cite their orders, in files of some hundred each."""
    cited = t.orders.groupBy(F.col("o_custkey").alias("c_custkey")).agg(
        F.collect_list("o_orderkey").alias("cites_records")
    )
    case = F.struct(
        F.col("c_name").alias("query"), F.col("c_custkey").alias("expected_patient_id"),
        F.col("c_mktsegment").alias("expected_answer"),
        F.coalesce("cites_records", F.array()).alias("cites_records"),
    )
    sets = (
        t.customer.join(cited, "c_custkey", "left")
        .groupBy(F.floor(F.col("c_custkey") / 300).alias("file")).agg(F.collect_list(case).alias("cases"))
    )
    texts = sets.select(
        F.to_json(F.struct(F.lit("by customer").alias("description"), "cases")).alias("value")
    )
    cases = readers.read_goldset(t.spark, _one_file_each(texts, new_path(t.spark, "goldsets")))
    return cases.select(
        "query", "expected_patient_id", "expected_answer",
        F.size("cites_records").cast("long").alias("n_cited"),
        F.aggregate("cites_records", F.lit(0).cast("long"), lambda a, b: a + b).alias("cited"),
    )
