from __future__ import annotations

import json
from types import SimpleNamespace

import pytest
from pyspark.sql import functions as F

from carelattice import schemas
from carelattice import session as session_module
from carelattice.operators.hl7 import parse_hl7
from carelattice.operators.writes import validate_intake
from carelattice.sources import readers, sinks
from tests.conftest import rows, ts


def test_csv_snapshots(spark, tmp_path):
    (tmp_path / "patients.csv").write_text(
        "id,name,dob,ssn,address,created_via,created_at\n"
        '4100000001,Ife Okafor,1952-07-30,987-65-4320,"Mill 9, Upper Fen",front_desk,2025-11-03 20:15:30\n'
        "x,Bad Row,,,,,\n"
    )
    (tmp_path / "encounters.csv").write_text(
        "patient_id,encounter_type,provider,summary,allergies,medications,occurred_at\n"
        "77,telehealth,Eva Lind,follow up,,,2025-10-31 16:45:00\n"
    )
    (tmp_path / "appointments.csv").write_text(
        "id,patient_id,slot_id,status,created_at\n6,77,5000000008,cancelled,2025-11-03 21:20:00.075\n"
    )
    patients = readers.read_csv_snapshot(spark, str(tmp_path / "patients.csv"), "patients").cache()
    assert rows(patients.where("_corrupt is null"), "id", "address", "created_at") == [
        (4_100_000_001, "Mill 9, Upper Fen", ts("2025-11-03 20:15:30"))
    ]
    assert patients.where("_corrupt is not null").count() == 1
    encounters = readers.read_csv_snapshot(spark, str(tmp_path / "encounters.csv"), "encounters")
    assert rows(encounters, "allergies", "medications") == [(None, None)]
    made = readers.read_csv_snapshot(spark, str(tmp_path / "appointments.csv"), "appointments")
    assert rows(made, "created_at") == [(ts("2025-11-03 21:20:00.075"),)]
    aligned = readers.align_generation(made.drop("_corrupt"), "appointments")
    assert aligned.columns == schemas.TABLES["appointments"].names


def test_generations(spark, table, tmp_path):
    root = str(tmp_path)
    old = table("id int, patient_id int, summary string", (1, 5, "old"))
    new = table("id int, patient_id int, summary string, status string", (2, 5, "new", "open"), (3, 5, "x", None))
    sinks.append_table(old, root, "encounters")
    found = readers.read_table(spark, root, "encounters", F.lit("2026-01-01").cast("timestamp"))
    assert rows(found, "id", "status", "allergies", "occurred_at") == [(1, "finished", None, ts("2026-01-01"))]
    sinks.append_table(new, root, "encounters")
    both = readers.read_table(spark, root, "encounters")
    assert rows(both, "id", "status") == [(1, None), (2, "open"), (3, None)]
    users = readers.align_generation(table("id int, username string, role string", (1, "a", None)), "users")
    assert rows(users, "role", "is_active") == [("staff", True)]
    assert [f.dataType for f in users.schema] == [f.dataType for f in schemas.TABLES["users"]]


def test_hl7_batches_by_size(spark, tmp_path):
    for i in range(30):
        (tmp_path / f"{i}.hl7").write_text(f"MSH|{i:05d}")

    def batches(name, **bound):
        feed = readers.stream_hl7(spark, str(tmp_path), **bound)
        run = feed.writeStream.format("memory").queryName(name).trigger(availableNow=True).start()
        run.awaitTermination()
        assert spark.table(name).distinct().count() == 30
        return len([p for p in run.recentProgress if p["numInputRows"]])

    assert batches("by_files", files_per_trigger=10) == 3
    assert batches("by_bytes", bytes_per_trigger=1_000) == 1
    assert batches("by_few_bytes", bytes_per_trigger=150) == 2


def test_hl7_folder(spark, tmp_path):
    (tmp_path / "a.hl7").write_bytes(b"MSH|x\rPID|1||M1||N\r")
    (tmp_path / "b.hl7").write_bytes(b"PID|1||M2||N\n\n")
    found = readers.read_hl7(spark, str(tmp_path))
    assert found.where("arrived_at is not null and message_id like '%hl7'").count() == 2
    assert rows(parse_hl7(found), "mrn") == [("M1",), ("M2",)]


def test_har_and_goldset(spark, tmp_path):
    entry = {
        "startedDateTime": "2025-12-09T07:45:33.000Z",
        "request": {"method": "GET", "url": "https://desk.example/patients/31/chart",
                    "headers": [{"name": "authorization", "value": "Bearer <patient-30-token>"}]},
        "response": {"status": 200, "statusText": "OK", "comment": "seen"},
    }
    bare = {**entry, "request": {"method": "GET", "url": "https://x/", "headers": []}}
    (tmp_path / "portal.har").write_text(json.dumps({"log": {"version": "1.2", "entries": [entry, bare]}}, indent=1))
    found = readers.read_har(spark, str(tmp_path / "portal.har"))
    assert rows(found, "position", "authorization", "status") == [
        (0, "Bearer <patient-30-token>", 200), (1, None, 200),
    ]
    assert found.first().started_at == ts("2025-12-09 07:45:33")
    case = {"query": "q", "expected_patient_id": 1, "expected_answer": "a", "cites_records": [1, 2]}
    (tmp_path / "gold.json").write_text(json.dumps({"description": "d", "cases": [case]}, indent=1))
    assert rows(readers.read_goldset(spark, str(tmp_path / "gold.json"))) == [(0, "q", 1, "a", [1, 2])]


def test_log_and_payload_files(spark, tmp_path):
    (tmp_path / "a.log").write_text("2025-11-03 20:41:30 INFO  GET /healthz 200 1.5ms\n")
    assert rows(readers.read_app_log(spark, str(tmp_path / "a.log")), "path", "status") == [("/healthz", 200)]
    (tmp_path / "in.json").write_text('{"demographics": {"name": "A"}}\n{"demographics": {}}\n')
    valid, rejected = validate_intake(readers.read_intake_payloads(spark, str(tmp_path / "in.json")))
    assert (valid.count(), rejected.count()) == (1, 1)


def test_status_changes(spark, table, tmp_path):
    base = table("id int, status string", (1, "pending"), (2, "pending"))
    for status, at in (("denied", "2026-01-02"), ("fulfilled", "2026-01-03"), ("x", "2026-01-01")):
        change = table("id int, status string, changed_at timestamp", (1, status, ts(at)))
        sinks.append_status_changes(change, str(tmp_path), "roi_requests")
    changes = spark.read.parquet(f"{tmp_path}/roi_requests_status")
    after = sinks.current_state(base, changes)
    assert rows(after) == [(1, "fulfilled"), (2, "pending")]
    assert rows(spark.read.parquet(sinks.compact(after, f"{tmp_path}/s", 3))) == rows(after)


def test_only_touched_parts_are_written(spark, table, tmp_path):
    path = str(tmp_path / "appointments")
    base = table("id int, status string", *[(i, "confirmed") for i in range(40)])
    sinks.save_parts(base, path, part_rows=10)
    first = table("id int, status string, changed_at timestamp", (3, "cancelled", ts("2026-01-01")),
                  (31, "x", ts("2026-01-01")), (31, "cancelled", ts("2026-01-02")))
    assert sinks.compact_parts(spark, path, first, part_rows=10) == 1
    assert sinks.compact_parts(spark, path, first, part_rows=10) == 2
    later = first.unionByName(table("id int, status string, changed_at timestamp", (3, "completed", ts("2026-01-03"))))
    assert sinks.compact_parts(spark, path, later.where("id = 3"), part_rows=10) == 3
    found = sinks.read_parts(spark, path)
    assert rows(found) == [(i, {3: "completed", 31: "cancelled"}.get(i, "confirmed")) for i in range(40)]
    written = {(p.parent.name, p.name) for p in (tmp_path / "appointments").glob("part=*/version=*")}
    assert {v for part, v in written if part == "part=1"} == {"version=0"}
    assert {v for part, v in written if part == "part=3"} == {"version=0", "version=1", "version=2"}
    assert {v for part, v in written if part == "part=0"} == {f"version={v}" for v in range(4)}


def test_many_parts_are_listed_by_few_tasks(spark, table, tmp_path):
    path, context = str(tmp_path / "appointments"), spark.sparkContext
    sinks.save_parts(table("id int, status string", *[(i, "confirmed") for i in range(200)]), path, part_rows=2)
    context.setJobGroup("listing", "the parts")
    found = sinks.read_parts(spark, path)
    context.setLocalProperty("spark.jobGroup.id", None)
    tracker = context.statusTracker()
    stages = [s for job in tracker.getJobIdsForGroup("listing") for s in tracker.getJobInfo(job).stageIds]
    tasks = [tracker.getStageInfo(s).numTasks for s in stages]
    assert tasks and max(tasks) <= int(spark.conf.get("spark.sql.shuffle.partitions"))
    assert rows(found) == [(i, "confirmed") for i in range(200)]


def test_database_tables_are_read_in_ranges(spark, table):
    """The embedded database among Spark's own jars, held in memory."""
    url = "jdbc:derby:memory:clinic;create=true"
    driver = {"driver": "org.apache.derby.iapi.jdbc.AutoloadedDriver"}
    made = table("id int, patient_id int, status string", *[(i, i % 3, "confirmed" if i % 2 else None) for i in range(-2, 50)])
    made.write.jdbc(url, "appointments", mode="overwrite", properties=driver)
    found = readers.read_jdbc_table(spark, url, "appointments", (0, 40), 4, **driver)
    assert found.columns == schemas.TABLES["appointments"].names
    assert found.rdd.getNumPartitions() == 4
    assert found.count() == 52
    kept = found.where("id >= 45").select("id", "status")
    assert rows(kept, "id") == [(i,) for i in range(45, 50)]
    plan = kept._jdf.queryExecution().executedPlan().toString()
    pushed = plan[plan.index("PushedFilters"):]
    assert "GreaterThanOrEqual(ID,45)" in pushed.replace("id", "ID") and "patient" not in plan.lower()


def test_batches_are_replay_safe(spark, table, tmp_path):
    path = str(tmp_path / "out")
    assert sinks.read_batches(spark, path, "a int").count() == 0
    sinks.write_batch(table("a int", (1,)), path, 0)
    sinks.write_batch(table("a int", (2,)), path, 1)
    sinks.write_batch(table("a int", (2,)), path, 1)
    assert rows(sinks.read_batches(spark, path, "a int"), "a") == [(1,), (2,)]
    assert rows(sinks.read_batches(spark, path, "a int", before=1), "a") == [(1,)]


def test_bucketed_tables_join_without_shuffle(spark):
    kept = "spark.sql.autoBroadcastJoinThreshold"
    before = spark.conf.get(kept)
    spark.conf.set(kept, "-1")
    try:
        left = sinks.save_bucketed(spark.range(100).selectExpr("id as k", "id"), "bucketed_left", "k", 4)
        right = sinks.save_bucketed(spark.range(100).selectExpr("id as k"), "bucketed_right", "k", 4)
        joined = left.join(right, "k")
        assert "Exchange" not in joined._jdf.queryExecution().executedPlan().toString()
        assert joined.count() == 100
    finally:
        spark.conf.set(kept, before)
        spark.sql("drop table if exists bucketed_left")
        spark.sql("drop table if exists bucketed_right")


def test_the_work_folder_is_the_cluster_s(tmp_path):
    def session(master, **settings):
        conf = SimpleNamespace(get=lambda key, default: settings.get(key, default))
        context = SimpleNamespace(master=master, applicationId=f"app-{master}")
        return SimpleNamespace(conf=conf, sparkContext=context)

    named = session("yarn", **{"spark.checkpoint.dir": "hdfs://shared/work/"})
    assert session_module.work_folder(named) == "hdfs://shared/work"
    with pytest.raises(RuntimeError):
        session_module.work_folder(session("yarn"))
    local = session("local[2]")
    assert session_module.work_folder(local) == session_module.work_folder(local)
