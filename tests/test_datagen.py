from __future__ import annotations

import pytest

from carelattice import schemas
from carelattice.datagen import generate_clinic
from carelattice.operators import identity, latency, quality, reads
from carelattice.session import cut_lineage
from carelattice.sources.readers import parse_app_log
from tests.conftest import rows

N = 400


@pytest.fixture(scope="module")
def clinic(spark):
    return generate_clinic(spark, N)


def test_columns_and_keys(clinic):
    for name, schema in schemas.TABLES.items():
        assert clinic[name].columns == schema.names
        if name != "users":
            assert quality.duplicate_keys(clinic[name], "id").count() == 0
        required = [f.name for f in schema if not f.nullable]
        assert quality.null_profile(clinic[name], name, required).where("n_null > 0").count() == 0
    assert quality.orphan_counts(clinic, schemas.FOREIGN_KEYS).where("n_orphans > 0").count() == 0
    mismatched = quality.record_patient_mismatches(clinic["records"], clinic["encounters"])
    assert mismatched.count() == 0


def test_mixes(clinic):
    for (name, column), domain in schemas.ENUM_DOMAINS.items():
        profile = quality.enum_profile(clinic[name], name, column, domain)
        assert profile.where("value is not null and not in_domain").count() == 0
    n = clinic["patients"].count()
    assert n > N
    per_patient = clinic["encounters"].count() / n
    assert 1.6 < per_patient < 2.1
    signed = clinic["consents"].where("kind = 'npp_ack'").count() / n
    assert 0.78 < signed < 0.92


def test_same_rows_on_any_partitioning(spark, clinic):
    spark.conf.set("spark.sql.leafNodeDefaultParallelism", "3")
    try:
        again = generate_clinic(spark, N)
        for name in ("patients", "records", "appointments"):
            assert again[name].exceptAll(clinic[name]).count() == 0
    finally:
        spark.conf.unset("spark.sql.leafNodeDefaultParallelism")
    other = generate_clinic(spark, N, seed=8)
    assert other["patients"].exceptAll(clinic["patients"]).count() > 0


def test_planted_double_bookings_are_found(clinic):
    pairs = quality.retry_pairs(clinic["appointments"], 0.5)
    planted = {(r.slot_id, r.gap_ms) for r in pairs.collect()}
    assert {(slot, 399) for slot in range(1, N // 2 // 20 + 1)} <= planted


def test_planted_duplicates_are_clustered(clinic):
    links = identity.match_links(clinic["patients"], clinic["insurance_coverages"])
    clusters = identity.person_clusters(clinic["patients"], links)
    found = {p: q for p, q in rows(clusters)}
    charts = [p for p in found if p > N]
    assert len(charts) > N / 50
    assert all(found[p] == (p - N) // 2 for p in charts)
    assert all(found[p] == p for p in found if p <= N)


def test_logged_registrations(clinic):
    log = cut_lineage(parse_app_log(clinic["log_lines"]), "log")
    paired = latency.pair_intake(log)
    assert paired.count() == N
    assert paired.where("elapsed_s between 4.0 and 5.0").count() == N


def test_charts(clinic):
    summary = reads.encounter_summary(clinic["encounters"], clinic["records"])
    assert summary.count() == clinic["encounters"].count()
    assert summary.selectExpr("sum(n_records)").first()[0] == clinic["records"].count()
