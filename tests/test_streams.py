"""Streams over several micro-batches against their batch twins."""

from __future__ import annotations

import os
import random
import time

import pytest
from pyspark.sql import functions as F

from carelattice.operators import compliance, writes
from carelattice.sources import readers, sinks
from carelattice.streaming import feeds, stateful
from tests.conftest import rows, ts
from tests.test_hl7 import SAMPLE


def arriving(spark, df, order, path, parts):
    """`df` as a stream that delivers its rows in `parts` micro-batches by `order`."""
    listed = df.orderBy(order).collect()
    size = -(-len(listed) // parts)
    for i in range(parts):
        chunk = spark.createDataFrame(listed[i * size:(i + 1) * size], df.schema).coalesce(1)
        chunk.write.mode("append").parquet(str(path))
        time.sleep(0.02)
    stream = spark.readStream.schema(df.schema).option("maxFilesPerTrigger", 1)
    return stream.parquet(str(path))


@pytest.fixture()
def requests(table):
    rng = random.Random(8)
    made = [
        (f"r{i:03d}", ts(f"2026-01-01 00:{i // 60:02d}:{i % 60:02d}"), rng.choice([1, 1, rng.randint(2, 40)]))
        for i in range(160)
    ]
    return table("request_id string, requested_at timestamp, slot_id int", *made)


def test_bookings(spark, table, requests, tmp_path):
    held = table("slot_id int, status string", (2, "confirmed"), (3, "cancelled"))
    stream = arriving(spark, requests, "requested_at", tmp_path / "in", 4)
    out, checkpoint = str(tmp_path / "out"), str(tmp_path / "checkpoint")
    stateful.start_bookings(stream, held, out, checkpoint).awaitTermination()
    columns = ["request_id", "slot_id", "outcome"]
    twin = rows(writes.resolve_bookings(requests, held), *columns)
    assert rows(stateful.booking_results(spark, out, stream), *columns) == twin
    assert len(os.listdir(out)) >= 4

    # A later batch that repeats old requests and asks for a taken and a free slot.
    more = table(
        "request_id string, requested_at timestamp, slot_id int",
        ("r000", ts("2026-01-02"), 1), ("n1", ts("2026-01-02"), 1), ("n2", ts("2026-01-02"), 77),
        ("n2", ts("2026-01-02 00:00:01"), 77),
    )
    more.coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    stateful.start_bookings(stream, held, out, checkpoint).awaitTermination()
    assert rows(stateful.booking_results(spark, out, stream), *columns) == sorted(
        [*twin, ("n1", 1, "slot_taken"), ("n2", 77, "confirmed")]
    )


def test_a_replayed_batch_changes_nothing(spark, table, requests, tmp_path):
    held = table("slot_id int, status string", (2, "confirmed"))
    path, schema = str(tmp_path / "out"), "request_id string, slot_id int, requested_at timestamp, outcome string"
    for batch_id, part in ((0, requests.where("request_id < 'r080'")), (1, requests.where("request_id >= 'r080'"))):
        for _ in range(2):
            prior = sinks.read_batches(spark, path, schema, before=batch_id)
            sinks.write_batch(stateful.booking_outcomes(part, prior, held), path, batch_id)
    found = sinks.read_batches(spark, path, schema)
    assert rows(found, "request_id", "outcome") == rows(
        writes.resolve_bookings(requests, held), "request_id", "outcome"
    )


@pytest.mark.parametrize("split_above, full_every", [(20, 2), (100_000, 50)])
def test_id_walks(spark, table, tmp_path, monkeypatch, split_above, full_every):
    monkeypatch.setattr(stateful, "FULL_STATE_EVERY", full_every)
    rng = random.Random(9)
    made, last = [], {}
    for seq in range(240):
        who = rng.choice("aab") if 60 < seq < 200 else rng.choice("ac")
        n = last[who] + 1 if who in last and rng.random() < 0.8 else rng.randint(1, 500)
        last[who] = n
        made.append((who, ts(f"2026-01-01 00:{seq // 60:02d}:{seq % 60:02d}"), seq, n))
    events = table("who string, at timestamp, seq int, n int", *made)
    stream = arriving(spark, events, "seq", tmp_path / "in", 5)
    reads = compliance.as_reads(stream, "who", "at", "seq", "n")
    out = str(tmp_path / "out")
    stateful.start_walk_alerts(reads, out, str(tmp_path / "cp"), split_above).awaitTermination()
    columns = ["principal", "first_at", "last_at", "first_id", "last_id", "n_reads"]
    twin = compliance.id_walk_detection(compliance.as_reads(events, "who", "at", "seq", "n"))
    assert rows(stateful.walk_alerts(spark, out, reads), *columns) == rows(twin, *columns)


def collect(stream, name):
    query = stream.writeStream.format("memory").queryName(name).trigger(availableNow=True).start()
    query.awaitTermination()
    return stream.sparkSession.table(name)


def test_hl7_feed(spark, tmp_path):
    feed = tmp_path / "feed"
    feed.mkdir()
    resent = SAMPLE.replace("77-K", "78-K")
    other = SAMPLE.replace("X-311", "X-312").replace("77-K", "79-K")
    elsewhere = SAMPLE.replace("|NORTH|DESK", "|SOUTH|DESK").replace("77-K", "80-K")
    for name, text in (("a", SAMPLE), ("b", resent), ("c", other), ("g", elsewhere), ("d", "PID|1||M1"), ("e", "PID|1||M2"), ("f", "  ")):
        (feed / f"{name}.hl7").write_text(text)
    records = collect(feeds.stream_records(readers.stream_hl7(spark, str(feed))), "hl7_records")
    found = rows(records, "mrn", "medications")
    assert len(found) == 5 and {m.split("^")[0] for m, _ in found} in (
        {"77-K", "79-K", "80-K", "M1", "M2"}, {"78-K", "79-K", "80-K", "M1", "M2"},
    )
    rejects = collect(feeds.stream_rejects(readers.stream_hl7(spark, str(feed))), "hl7_rejects")
    assert rows(rejects, "reject_reason") == [("empty",)]


def test_latency_windows_close(spark, table, tmp_path):
    made = [(ts(f"2026-01-01 {h:02d}:{m:02d}:00"), float(h + m)) for h in range(5) for m in range(0, 60, 5)]
    requests = table("answered_at timestamp, elapsed_s double", *made)
    stream = arriving(spark, requests, "answered_at", tmp_path / "in", 3)
    windows = collect(feeds.stream_latency(stream, "1 hour", "10 minutes"), "latency")
    twin = requests.groupBy(F.date_trunc("hour", "answered_at").alias("w")).agg(
        F.count("*"), F.max("elapsed_s")
    )
    # The last hour is still open.
    assert rows(windows, "window_start", "n", "max") == rows(twin)[:-1]


def test_latency_sketches_keep_their_error(spark, table, tmp_path):
    rng = random.Random(6)
    made = [(ts(f"2026-01-{d:02d} {i % 24:02d}:00:00"), rng.lognormvariate(0, 1)) for d in (1, 2, 3) for i in range(9_000)]
    requests = table("answered_at timestamp, elapsed_s double", *made)
    stream = arriving(spark, requests, "answered_at", tmp_path / "in", 3)
    days = collect(feeds.stream_latency(stream, "1 day"), "latency_days")
    assert days.count() == 2
    both = feeds.merge_latency(days, "30 days").first()
    for found, values in [(both, [v for at, v in made if at < ts("2026-01-03")])] + [
        (r, [v for at, v in made if at.date() == r.window_start.date()]) for r in days.collect()
    ]:
        assert found.n == len(values) and found.max == max(values)
        for name, q in feeds.QUANTILES.items():
            rank = sum(v <= found[name] for v in values) / len(values)
            assert abs(rank - q) <= feeds.SKETCH_ERROR
