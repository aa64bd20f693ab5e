"""Coverage checks against a table of payer responses."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from carelattice.functions.ordered import first_rows
from carelattice.functions.text import is_blank, strip


def _active(status_code: Column, error: Column) -> Column:
    """A call that succeeded with a status below 400."""
    return F.coalesce(error.isNull() & (status_code < 400), F.lit(False))


def check_responses(responses: DataFrame) -> DataFrame:
    """Each payer call's outcome; calls for a blank id are refused and left out."""
    failed = F.col("error").isNotNull()
    return responses.where(~is_blank(F.col("insurance_id"))).select(
        strip(F.col("insurance_id")).alias("insurance_id"),
        _active(F.col("status_code"), F.col("error")).alias("active"),
        "payer",
        F.when(~failed, F.col("status_code")).alias("raw_status"),
        "checked_at",
        "error",
    )


def _latest(responses: DataFrame) -> DataFrame:
    return first_rows(
        check_responses(responses), ["insurance_id"],
        [F.desc("checked_at"), F.asc("active"), F.asc_nulls_first("raw_status"), F.asc("payer")],
    )


def eligibility_outcome(coverages: DataFrame, responses: DataFrame) -> DataFrame:
    """Per coverage with a member id: the outcome of the latest payer response.

    `outcome` is `rejected` for a blank member id, `no_response` where the payer was
    not asked, else `checked`. A null member id is not asked about and has no row.
    """
    asked = coverages.where(F.col("member_id").isNotNull()).withColumn(
        "insurance_id", strip(F.col("member_id"))
    )
    blank = asked.where(F.col("insurance_id") == "").withColumn("outcome", F.lit("rejected"))
    checked = (
        asked.where(F.col("insurance_id") != "")
        .join(_latest(responses), "insurance_id", "left")
        .withColumn(
            "outcome",
            F.when(F.col("checked_at").isNull(), F.lit("no_response")).otherwise(F.lit("checked")),
        )
    )
    return checked.unionByName(blank, allowMissingColumns=True)


def refresh_coverage(coverages: DataFrame, responses: DataFrame) -> DataFrame:
    """Coverages with status and verification time from the latest response.

    A failed call (no status code) gives `unknown`; coverages without a member id or
    without a response stay as they are. Rows without a member id skip the join, so
    they do not meet in one task.
    """
    latest = _latest(responses).select(
        "insurance_id",
        F.when(F.col("raw_status").isNull(), F.lit("unknown"))
        .when(F.col("active"), F.lit("active"))
        .otherwise(F.lit("inactive"))
        .alias("_status"),
        F.col("checked_at").alias("_verified_at"),
    )
    key = strip(F.col("member_id"))
    named = coverages.where(~is_blank(F.col("member_id"))).withColumn("insurance_id", key)
    unnamed = coverages.where(is_blank(F.col("member_id")))
    refreshed = (
        named.join(latest, "insurance_id", "left")
        .withColumn("status", F.coalesce("_status", "status"))
        .withColumn("verified_at", F.coalesce("_verified_at", "verified_at"))
        .select(*coverages.columns)
    )
    return refreshed.unionByName(unnamed)
