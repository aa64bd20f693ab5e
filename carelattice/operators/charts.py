"""Patient charts and disclosure packets, flat and as paged nested documents."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from carelattice import schemas
from carelattice.functions.ordered import Ordered
from carelattice.session import cut_lineage

# Rows nested into one document page.
PAGE_ROWS = 1_000


def _asked(ids: DataFrame) -> DataFrame:
    """The requested patients, each once, read once."""
    return cut_lineage(ids.select("patient_id").distinct(), "asked-patients")


def _headers(encounters: DataFrame, columns: list[str] | None) -> DataFrame:
    shown = columns or schemas.ENCOUNTER_OUT
    own = [c for c in shown if c in encounters.columns and c not in ("id", "patient_id")]
    return encounters.select(
        "patient_id",
        F.col("id").alias("encounter_id"),
        F.struct(F.col("id"), "patient_id", *own).alias("encounter"),
    )


def _entries(records: DataFrame, columns: list[str] | None) -> DataFrame:
    detail = columns or schemas.RECORD_OUT
    return records.select(
        "encounter_id", F.struct(*[c for c in detail if c in records.columns]).alias("record")
    )


def _asked_chart(
    encounters: DataFrame, records: DataFrame, patients: DataFrame,
    encounter_columns: list[str] | None, record_columns: list[str] | None,
) -> tuple[DataFrame, DataFrame]:
    """The requested patients' encounters (patient_id, encounter_id, encounter), and their records
    (patient_id, encounter_id, record).

    Both are written, so either table is read once, with the keys asked for as the only
    condition: records meet a table of known size, which Spark broadcasts or, on tables bucketed by
    the encounter, joins in place. Whatever follows works on what was asked for.
    """
    headers = cut_lineage(
        _headers(encounters, encounter_columns).join(patients, "patient_id", "left_semi"),
        "asked-encounters",
    )
    owners = headers.select("encounter_id", "patient_id")
    rows = cut_lineage(
        _entries(records, record_columns).join(owners, "encounter_id")
        .select("patient_id", "encounter_id", "record"),
        "asked-records",
    )
    return headers, rows


def _bare(headers: DataFrame, rows: DataFrame) -> DataFrame:
    """Encounters that no record belongs to."""
    return headers.join(rows.select("encounter_id").distinct(), "encounter_id", "left_anti")


def chart_rows(
    encounters: DataFrame,
    records: DataFrame,
    ids: DataFrame | None = None,
    encounter_columns: list[str] | None = None,
    record_columns: list[str] | None = None,
) -> DataFrame:
    """Encounter rows with their records; an encounter without records has one row.

    Records are matched by encounter only. The match is an inner join, whose both
    sides AQE may split when one encounter holds very many records (the record side
    of an outer join it could not); encounters without records are added by an anti
    join on the distinct encounter ids. With `ids`, both work on the rows of these
    patients only.
    """
    if ids is not None:
        headers, rows = _asked_chart(
            encounters, records, _asked(ids), encounter_columns, record_columns
        )
        matched = rows.join(headers.drop("patient_id"), "encounter_id")
    else:
        headers = _headers(encounters, encounter_columns)
        rows = _entries(records, record_columns)
        matched = headers.join(rows, "encounter_id")
    return matched.unionByName(_bare(headers, rows), allowMissingColumns=True).select(
        "patient_id", "encounter_id", "encounter", "record"
    )


def _large(sizes: DataFrame, page_rows: int) -> DataFrame:
    """Patients who need more than one page, of (patient_id, n)."""
    return cut_lineage(sizes.where(F.col("n") > page_rows).select("patient_id"), "large")


def _numbered(rows: DataFrame, order: list[str], page_rows: int, split_above: int) -> DataFrame:
    """Add `page`: the row number within the patient over `page_rows`, from 0."""
    placed = Ordered(rows, ["patient_id"], order, split_above=split_above).number("_n").frame()
    page = F.floor((F.col("_n") - 1) / F.lit(page_rows)).cast("int")
    return placed.withColumn("page", page).drop("_n")


def patient_chart(
    encounters: DataFrame,
    records: DataFrame,
    ids: DataFrame,
    page_rows: int = PAGE_ROWS,
    split_above: int = 1_000_000,
    encounter_columns: list[str] | None = None,
    record_columns: list[str] | None = None,
) -> DataFrame:
    """Nested charts: encounters by id, each with its records by id.

    One document per patient and page. A page holds `page_rows` chart rows, so a
    chart of ordinary size is one document and a huge one is several of bounded
    size; an encounter that crosses a border goes on in the next page. An unknown
    patient has one empty page.

    Each table is read once and cut down to the requested patients first. Only rows of patients who need
    several pages are ordered.
    """
    patients = _asked(ids)
    headers, rows = _asked_chart(encounters, records, patients, encounter_columns, record_columns)
    per_encounter = (
        headers.select("patient_id", "encounter_id", F.lit(0).alias("_rows"))
        .unionByName(rows.select("patient_id", "encounter_id", F.lit(1).alias("_rows")))
        .groupBy("patient_id", "encounter_id")
        .agg(F.greatest(F.lit(1), F.sum("_rows")).alias("_rows"))
    )
    sizes = per_encounter.groupBy("patient_id").agg(F.sum("_rows").alias("n"))
    large = _large(sizes, page_rows)
    first = F.lit(0).alias("page")
    if large.isEmpty():
        heads, lines = headers.withColumn("page", first), rows.withColumn("page", first)
    else:
        several = cut_lineage(
            rows.join(large, "patient_id", "left_semi").unionByName(
                _bare(headers.join(large, "patient_id", "left_semi"), rows).drop("encounter"),
                allowMissingColumns=True,
            ).withColumn("_record_id", F.col("record.id")),
            "pages",
        )
        numbered = cut_lineage(
            _numbered(several, ["encounter_id", "_record_id"], page_rows, split_above)
            .drop("_record_id"),
            "numbered-pages",
        )
        begun = numbered.select("patient_id", "encounter_id", "page").distinct()
        heads = headers.join(large, "patient_id", "left_anti").withColumn("page", first).unionByName(
            begun.join(headers.drop("patient_id"), "encounter_id")
        )
        lines = rows.join(large, "patient_id", "left_anti").withColumn("page", first).unionByName(
            numbered.where(F.col("record").isNotNull())
        )
    # A patient without encounters keeps this empty page; to others it adds nothing.
    empty = patients.withColumn("page", first)
    blocks = (
        heads.unionByName(lines, allowMissingColumns=True)
        .unionByName(empty, allowMissingColumns=True)
        .groupBy("patient_id", "page", "encounter_id")
        .agg(
            F.any_value("encounter", True).alias("encounter"),
            F.array_sort(F.collect_list("record")).alias("records"),
        )
    )
    block = F.when(F.col("encounter_id").isNotNull(), F.struct("encounter", "records"))
    return blocks.groupBy("patient_id", "page").agg(
        F.array_sort(F.collect_list(block)).alias("encounters")
    )


def packet_rows(records: DataFrame, ids: DataFrame) -> DataFrame:
    """All records of the requested patients, flat. Nothing checks an authorization."""
    return records.join(ids.select("patient_id").distinct(), "patient_id")


def disclosure_packet(
    records: DataFrame,
    ids: DataFrame,
    page_rows: int = PAGE_ROWS,
    split_above: int = 1_000_000,
) -> DataFrame:
    """Nested packets: the patient's records by id, paged; unknown patients are empty.

    The records of the requested patients are read once and written; whatever follows works on them.
    """
    patients = _asked(ids)
    released = [c for c in schemas.RELEASED_RECORD if c in records.columns]
    rows = cut_lineage(
        records.join(patients, "patient_id", "left_semi")
        .select("patient_id", "id", F.struct(*released).alias("record")),
        "released-records",
    )
    large = _large(rows.groupBy("patient_id").agg(F.count(F.lit(1)).alias("n")), page_rows)
    first = F.lit(0).alias("page")
    if large.isEmpty():
        lines = rows.withColumn("page", first)
    else:
        several = cut_lineage(rows.join(large, "patient_id", "left_semi"), "pages")
        lines = rows.join(large, "patient_id", "left_anti").withColumn("page", first).unionByName(
            _numbered(several, ["id"], page_rows, split_above)
        )
    # A patient without records keeps this empty page; to others it adds nothing.
    empty = patients.withColumn("page", first)
    return (
        lines.drop("id").unionByName(empty, allowMissingColumns=True)
        .groupBy("patient_id", "page")
        .agg(F.array_sort(F.collect_list("record")).alias("records"))
    )
