"""Read queries on the given tables."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from carelattice.operators import charts, eligibility, reads, search
from carelattice.plans import roles
from carelattice.plans.registry import Tables, query


def _record_columns(df: DataFrame) -> DataFrame:
    return df.select("*", "id.*").drop("id")


@query("""
    SELECT c_custkey AS id, c_name AS name, c_mktsegment AS gender FROM customer
    WHERE c_name ILIKE '%1%' ORDER BY c_custkey LIMIT 25 OFFSET 50""")
def patient_search(t: Tables) -> DataFrame:
    return reads.patient_search(roles.patients(t), "1", limit=25, offset=50)


@query("SELECT count(*) AS total FROM customer WHERE c_name ILIKE '%r#0_0%1%'")
def patient_search_total(t: Tables) -> DataFrame:
    return reads.patient_search_total(roles.patients(t), "R#0_0%1")


@query("""
    SELECT 'empty' AS q, id, name, gender FROM (
      SELECT c_custkey AS id, c_name AS name, c_mktsegment AS gender FROM customer
      ORDER BY c_custkey LIMIT 100 OFFSET 10) x
    UNION ALL SELECT 'missing', id, name, gender FROM (
      SELECT c_custkey AS id, c_name AS name, c_mktsegment AS gender FROM customer
      ORDER BY c_custkey LIMIT 100 OFFSET 10) x""")
def patient_search_without_text(t: Tables) -> DataFrame:
    """An empty search text, like a missing one, matches every patient."""
    empty = reads.patient_search(roles.patients(t), "", limit=100, offset=10)
    missing = reads.patient_search(roles.patients(t), None, limit=100, offset=10)
    return empty.select(F.lit("empty").alias("q"), "*").unionByName(
        missing.select(F.lit("missing").alias("q"), "*")
    )


@query("""
    SELECT u.id, c_name AS name, c_mktsegment AS gender, c_custkey IS NOT NULL AS found
    FROM (SELECT DISTINCT user_id * 7 AS id FROM events) u
    LEFT JOIN customer ON c_custkey = u.id""")
def patient_lookup(t: Tables) -> DataFrame:
    ids = t.events.select((F.col("user_id") * 7).alias("id"))
    return reads.patient_lookup(roles.patients(t), ids)


@query("""
    SELECT o_custkey AS patient_id, o_orderkey AS encounter_id, o_orderstatus AS status,
           l_linenumber, l_partkey, l_suppkey, l_returnflag AS kind
    FROM orders LEFT JOIN lineitem ON l_orderkey = o_orderkey""")
def chart_flat(t: Tables) -> DataFrame:
    rows = charts.chart_rows(
        roles.encounters(t), roles.records(t),
        encounter_columns=["id", "patient_id", "status"], record_columns=["id", "kind"],
    )
    return rows.select(
        "patient_id", "encounter_id", "encounter.status", "record.id.*",
        F.col("record.kind").alias("kind"),
    )


# Rows of a page in the checks, small enough for many charts to have several.
_PAGE = 40


@query(f"""
    WITH asked AS (SELECT DISTINCT user_id AS patient_id FROM events),
    placed AS (
      SELECT o_custkey AS patient_id, o_orderkey, l_orderkey, l_returnflag,
             row_number() OVER chart AS n,
             (row_number() OVER chart - 1) // {_PAGE} AS page
      FROM orders LEFT JOIN lineitem ON l_orderkey = o_orderkey
      WHERE o_custkey IN (SELECT patient_id FROM asked)
      WINDOW chart AS (PARTITION BY o_custkey ORDER BY o_orderkey, l_linenumber, l_partkey, l_suppkey))
    SELECT asked.patient_id, COALESCE(page, 0)::INTEGER AS page, count(DISTINCT o_orderkey) AS n_encounters,
           count(l_orderkey) AS n_records, COALESCE(string_agg(l_returnflag, '' ORDER BY n), '') AS kinds
    FROM asked LEFT JOIN placed USING (patient_id) GROUP BY 1, 2""")
def patient_chart(t: Tables) -> DataFrame:
    """Nested charts of all users, page by page: sizes, and record kinds in order."""
    ids = t.events.select(F.col("user_id").alias("patient_id"))
    chart = charts.patient_chart(
        roles.encounters(t), roles.records(t), ids, page_rows=_PAGE,
        encounter_columns=["id", "patient_id"], record_columns=["id", "kind"],
    )
    records = F.flatten(F.transform("encounters", lambda e: e["records"]))
    return chart.select(
        "patient_id", "page",
        F.size("encounters").cast("long").alias("n_encounters"),
        F.size(records).cast("long").alias("n_records"),
        F.array_join(F.transform(records, lambda r: r["kind"]), "").alias("kinds"),
    )


@query("""
    SELECT o_custkey AS patient_id, count(*) AS n_encounters,
           CAST(sum(n) AS BIGINT) AS n_records, CAST(sum(r) AS BIGINT) AS n_results,
           CAST(sum(n - r) AS BIGINT) AS n_notes
    FROM (SELECT o_custkey, o_orderkey, count(l_orderkey) AS n,
                 count(*) FILTER (WHERE l_returnflag = 'R') AS r
          FROM orders LEFT JOIN lineitem ON l_orderkey = o_orderkey
          GROUP BY o_custkey, o_orderkey) x
    GROUP BY o_custkey""")
def chart_summary(t: Tables) -> DataFrame:
    return reads.chart_summary(roles.encounters(t), roles.records(t))


@query("""
    SELECT o_orderkey AS encounter_id, o_custkey AS patient_id, count(l_orderkey) AS n_records,
           count(*) FILTER (WHERE l_returnflag = 'R') AS n_results,
           count(l_orderkey) - count(*) FILTER (WHERE l_returnflag = 'R') AS n_notes
    FROM orders LEFT JOIN lineitem ON l_orderkey = o_orderkey GROUP BY o_orderkey, o_custkey""")
def encounter_summary(t: Tables) -> DataFrame:
    return reads.encounter_summary(roles.encounters(t), roles.records(t))


@query("SELECT doc_id, lang FROM documents WHERE text ILIKE '%anon%'")
def record_search(t: Tables) -> DataFrame:
    bodies = t.documents.withColumnRenamed("text", "body")
    return search.record_search(bodies, "ANON", ["doc_id", "lang"])


@query("""
    SELECT item_id AS query_id, doc_id FROM benchmark b
    JOIN documents d ON d.text ILIKE '%' || b.text || '%'
    UNION ALL
    SELECT 1000000 + n_nationkey, doc_id FROM nation
    JOIN documents d ON n_nationkey % 5 <> 0 AND d.text ILIKE '%an_' || n_nationkey || '%'""")
def record_search_many(t: Tables) -> DataFrame:
    """Benchmark items and short wildcard texts as queries; every fifth of these is empty and finds nothing."""
    whole = t.benchmark.select(F.col("item_id").alias("query_id"), F.col("text").alias("q"))
    wild = t.nation.select(
        (F.col("n_nationkey") + 1_000_000).cast("long").alias("query_id"),
        F.when(F.col("n_nationkey") % 5 == 0, F.lit("")).otherwise(F.concat(F.lit("an_"), F.col("n_nationkey"))).alias("q"),
    )
    bodies = t.documents.select("doc_id", F.col("text").alias("body"))
    return search.record_search_many(bodies, whole.unionByName(wild)).select("query_id", "doc_id")


@query("""
    SELECT l_suppkey AS provider_id, s_name AS provider, l_shipdate AS start_at, 'open' AS status,
           l_orderkey, l_linenumber, l_partkey, l_suppkey
    FROM lineitem LEFT JOIN supplier ON s_suppkey = l_suppkey WHERE l_linestatus = 'O'
    ORDER BY l_shipdate, l_orderkey, l_linenumber, l_partkey, l_suppkey LIMIT 50""")
def open_slots(t: Tables) -> DataFrame:
    return _record_columns(reads.open_slots(roles.slots(t), roles.providers(t)))


@query(f"""
    SELECT id, patient_id, slot_id, status, created_at,
           row_number() OVER (PARTITION BY patient_id ORDER BY created_at DESC, id DESC) AS place
    FROM ({roles.APPOINTMENTS_SQL}) a
    WHERE patient_id IN (SELECT o_custkey FROM orders)""")
def appointments_for(t: Tables) -> DataFrame:
    ids = t.orders.select(F.col("o_custkey").alias("patient_id"))
    found = reads.appointments_for(roles.appointments(t), ids)
    return found.select("id", "patient_id", "slot_id", "status", "created_at", "place")


@query(f"""
    SELECT id, patient_id, slot_id, status, scheduled_for FROM (
      SELECT *, row_number() OVER (PARTITION BY patient_id
                                   ORDER BY scheduled_for ASC NULLS FIRST, id) AS rn
      FROM ({roles.APPOINTMENTS_SQL}) a
      WHERE status IS NULL OR lower(status) NOT IN ('cancelled', 'canceled', 'completed')) x
    WHERE rn = 1""")
def next_appointment(t: Tables) -> DataFrame:
    found = reads.next_appointment(roles.appointments(t))
    return found.select("id", "patient_id", "slot_id", "status", "scheduled_for")


@query("""
    SELECT patient_id, encounter_id, l_linenumber, l_partkey, l_suppkey, status FROM (
      SELECT o_custkey AS patient_id, l_orderkey AS encounter_id, l_linenumber, l_partkey,
             l_suppkey, l_linestatus AS status,
             row_number() OVER (PARTITION BY o_custkey
               ORDER BY l_orderkey, l_linenumber, l_partkey, l_suppkey) AS rn
      FROM lineitem JOIN orders ON l_orderkey = o_orderkey WHERE l_returnflag = 'R') x
    WHERE rn <= 5""")
def recent_results(t: Tables) -> DataFrame:
    found = reads.recent_results(roles.encounters(t), roles.records(t))
    return found.select("patient_id", "encounter_id", "id.*", "status")


@query(f"""
    SELECT id, patient_id, recipient, status, range_start AS date_range_start
    FROM ({roles.ROI_SQL}) r""")
def roi_requests_list(t: Tables) -> DataFrame:
    listed = reads.roi_requests_list(roles.roi_requests(t))
    return listed.select(
        "id", "patient_id", "recipient", "status",
        F.to_date("date_range_start").alias("date_range_start"),
    )


@query("""
    SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, l_shipdate AS start_at
    FROM lineitem WHERE l_linestatus = 'O'""")
def bookable_slots(t: Tables) -> DataFrame:
    return _record_columns(reads.bookable_slots(roles.slots(t)).select("id", "start_at"))


@query(f"""
    SELECT id, patient_id, status FROM ({roles.ROI_SQL}) r
    WHERE status NOT IN ('fulfilled', 'completed', 'denied')""")
def actionable_roi(t: Tables) -> DataFrame:
    return reads.actionable_roi(roles.roi_requests(t)).select("id", "patient_id", "status")


@query(f"""
    SELECT status, CASE WHEN status IN ('confirmed', 'completed') THEN 'ok'
                        WHEN status = 'cancelled' THEN 'bad' ELSE 'neutral' END AS status_variant,
           count(*) AS n
    FROM ({roles.APPOINTMENTS_SQL}) a GROUP BY 1, 2""")
def status_variants(t: Tables) -> DataFrame:
    badged = reads.with_status_variant(roles.appointments(t))
    return badged.groupBy("status", "status_variant").agg(F.count(F.lit(1)).alias("n"))


@query("""
    SELECT u.patient_id, o_orderkey AS encounter_id, l_linenumber, l_partkey, l_suppkey,
           l_linestatus AS status
    FROM (SELECT DISTINCT user_id AS patient_id FROM events WHERE event_type = 'signup') u
    JOIN orders ON o_custkey = u.patient_id JOIN lineitem ON l_orderkey = o_orderkey""")
def disclosure_packet(t: Tables) -> DataFrame:
    rows = charts.packet_rows(roles.patient_records(t), roles.roi_requests(t))
    return rows.select("patient_id", "encounter_id", "id.*", "status")


@query(f"""
    WITH asked AS (SELECT DISTINCT user_id AS patient_id FROM events),
    placed AS (
      SELECT o_custkey AS patient_id, l_linestatus,
             row_number() OVER packet AS n, (row_number() OVER packet - 1) // {_PAGE} AS page
      FROM orders JOIN lineitem ON l_orderkey = o_orderkey
      WINDOW packet AS (PARTITION BY o_custkey ORDER BY l_orderkey, l_linenumber, l_partkey, l_suppkey))
    SELECT asked.patient_id, COALESCE(page, 0)::INTEGER AS page, count(l_linestatus) AS n_records,
           COALESCE(string_agg(l_linestatus, '' ORDER BY n), '') AS states
    FROM asked LEFT JOIN placed USING (patient_id) GROUP BY 1, 2""")
def disclosure_documents(t: Tables) -> DataFrame:
    """The nested packets of all users, page by page: size, and record states in order."""
    ids = t.events.select(F.col("user_id").alias("patient_id"))
    records = roles.patient_records(t).withColumn("id", F.struct("encounter_id", "id"))
    packets = charts.disclosure_packet(records, ids, page_rows=_PAGE)
    return packets.select(
        "patient_id", "page",
        F.size("records").cast("long").alias("n_records"),
        F.array_join(F.transform("records", lambda r: r["status"]), "").alias("states"),
    )


@query(f"SELECT * FROM ({roles.RESPONSES_SQL}) r")
def check_responses(t: Tables) -> DataFrame:
    return eligibility.check_responses(roles.payer_responses(t))


_LATEST_SQL = f"""c AS ({roles.COVERAGES_SQL}), r AS ({roles.RESPONSES_SQL}),
    latest AS (
      SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY insurance_id
        ORDER BY checked_at DESC, active, raw_status NULLS FIRST, payer) AS rn FROM r) x
      WHERE rn = 1)"""


@query(f"""
    WITH {_LATEST_SQL}
    SELECT c.id, c.member_id AS insurance_id, r.active, r.payer, r.raw_status, r.checked_at,
           r.error, CASE WHEN r.checked_at IS NULL THEN 'no_response' ELSE 'checked' END AS outcome
    FROM c LEFT JOIN latest r ON r.insurance_id = c.member_id WHERE c.member_id <> ''
    UNION ALL
    SELECT id, '', NULL, NULL, NULL, NULL, NULL, 'rejected' FROM c WHERE member_id = ''""")
def eligibility_outcome(t: Tables) -> DataFrame:
    found = eligibility.eligibility_outcome(roles.coverages(t), roles.payer_responses(t))
    return found.select(
        "id", "insurance_id", "active", "payer", "raw_status", "checked_at", "error", "outcome"
    )


@query(f"""
    WITH {_LATEST_SQL}
    SELECT c.id, CASE WHEN checked_at IS NULL OR raw_status IS NULL THEN 'unknown'
                      WHEN active THEN 'active' ELSE 'inactive' END AS status,
           checked_at AS verified_at
    FROM c LEFT JOIN latest ON insurance_id = NULLIF(c.member_id, '')""")
def refresh_coverage(t: Tables) -> DataFrame:
    after = eligibility.refresh_coverage(roles.coverages(t), roles.payer_responses(t))
    return after.select("id", "status", "verified_at")
