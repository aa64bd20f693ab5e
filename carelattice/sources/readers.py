"""Readers: clinic tables, CSV snapshots, HL7, logs, captures, gold sets."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from carelattice import schemas

# Columns of the older CSV snapshots, in file order.
CSV_SNAPSHOTS = {
    "patients": "id bigint, name string, dob string, ssn string, address string,"
    " created_via string, created_at timestamp",
    "encounters": "patient_id bigint, encounter_type string, provider string, summary string,"
    " allergies string, medications string, occurred_at timestamp",
    "appointments": "id bigint, patient_id bigint, slot_id bigint, status string, created_at timestamp",
}

_HAR = (
    "log struct<entries array<struct<startedDateTime string,"
    " request struct<method string, url string, headers array<struct<name string, value string>>>,"
    " response struct<status int, statusText string, comment string>>>>"
)
_GOLDSET = (
    "description string, cases array<struct<query string, expected_patient_id bigint,"
    " expected_answer string, cites_records array<bigint>>>"
)


def align_generation(df: DataFrame, table: str, as_of: Column | None = None) -> DataFrame:
    """Bring a snapshot of any schema generation to the current columns and types.

    A column the snapshot lacks gets its default, or null; nulls in present NOT NULL
    columns get the default too. Time defaults take `as_of`, and stay null without it.
    """
    defaults = {k: F.lit(v) for k, v in schemas.DEFAULTS.get(table, {}).items()}
    if as_of is not None and table in schemas.TIME_DEFAULTS:
        defaults[schemas.TIME_DEFAULTS[table]] = as_of
    columns = []
    for field in schemas.TABLES[table].fields:
        default = defaults.get(field.name, F.lit(None)).cast(field.dataType)
        if field.name not in df.columns:
            value = default
        elif field.nullable or field.name not in defaults:
            value = F.col(field.name).cast(field.dataType)
        else:
            value = F.coalesce(F.col(field.name).cast(field.dataType), default)
        columns.append(value.alias(field.name))
    return df.select(*columns)


def read_table(
    spark: SparkSession, root: str, table: str, as_of: Column | None = None, mixed: bool = True
) -> DataFrame:
    """One clinic table from Parquet.

    With `mixed`, files of older generations may lie beside newer ones: Spark then
    reads every file's schema, which a table of one generation can be spared.
    """
    files = spark.read.option("mergeSchema", mixed).parquet(f"{root}/{table}")
    return align_generation(files, table, as_of)


def read_jdbc_table(
    spark: SparkSession, url: str, table: str, bounds: tuple[int, int], partitions: int, **options
) -> DataFrame:
    """One clinic table from a live database, read in `partitions` ranges of its id.

    Filters and the columns used reach the database. Ids outside `bounds` are read too, by the first and
    the last range: they only say where to cut.
    """
    reader = spark.read.format("jdbc").options(
        url=url,
        dbtable=table,
        partitionColumn="id",
        lowerBound=bounds[0],
        upperBound=bounds[1],
        numPartitions=partitions,
        **options,
    )
    return align_generation(reader.load(), table)


def read_csv_snapshot(spark: SparkSession, path: str, kind: str) -> DataFrame:
    """A CSV snapshot with its own columns; an unreadable row keeps its text in `_corrupt`."""
    schema = T._parse_datatype_string(CSV_SNAPSHOTS[kind]).add("_corrupt", T.StringType())
    return spark.read.csv(
        path,
        schema=schema,
        header=True,
        mode="PERMISSIVE",
        columnNameOfCorruptRecord="_corrupt",
        escape='"',
    )


def _message_rows(texts: DataFrame) -> DataFrame:
    return texts.select(
        F.col("_metadata.file_path").alias("message_id"),
        F.col("value").alias("message"),
        F.col("_metadata.file_modification_time").alias("arrived_at"),
    )


def read_hl7(spark: SparkSession, path: str) -> DataFrame:
    """One message per file, with its file and arrival time."""
    return _message_rows(spark.read.text(path, wholetext=True))


def stream_hl7(
    spark: SparkSession, path: str, files_per_trigger: int = 1_000, bytes_per_trigger: int | None = None
) -> DataFrame:
    """The same as a stream over a folder that receives files, a bounded number at a time, or else a
    bounded size: a batch costs its state's commits, however few messages it has."""
    files = spark.readStream.format("text").option("wholetext", True)
    if bytes_per_trigger:
        bounded = files.option("maxBytesPerTrigger", bytes_per_trigger)
    else:
        bounded = files.option("maxFilesPerTrigger", files_per_trigger)
    return _message_rows(bounded.load(path))


_MARK = "\x01"
# A log line of either format: time, level, service, message.
_LOG_LINE = (
    "^([0-9-]{10} [0-9:]{8}(?:[,.][0-9]{3})?) +([A-Z]+) +(?:\\[([^\\]]*)\\] )?(.*)$"
)
# What follows in a message without its body: method, path, status.
_REQUEST = "^(GET|POST|PUT|PATCH|DELETE) (/[^ ]*)(?: +([0-9]{3})(?= |$))?.*$"


def _groups(text: str, regex: str, n: int) -> Column:
    """The groups of one match as an array, from one run of the regex; else the text alone."""
    marked = _MARK.join(f"${i}" for i in range(1, n + 1))
    return F.split(F.regexp_replace(text, regex, marked), _MARK)


def parse_app_log(lines: DataFrame) -> DataFrame:
    """Log lines (`value`) of either format -> typed columns; other lines are kept as text."""
    kept = [c for c in lines.columns if c != "value"]

    def group(parts: str, i: int, n: int) -> Column:
        return F.when(F.size(parts) == n, F.nullif(F.get(parts, F.lit(i)), F.lit("")))

    def number(regex: str) -> Column:
        return F.nullif(F.regexp_extract("_rest", regex, 1), F.lit(""))

    body = "body=(\\{.*\\})"
    headed = lines.select(*kept, "value", _groups("value", _LOG_LINE, 4).alias("_head"))
    split = headed.select(
        *kept,
        F.replace(group("_head", 0, 4), F.lit(","), F.lit(".")).try_cast("timestamp").alias("ts"),
        group("_head", 1, 4).alias("level"),
        group("_head", 2, 4).alias("service"),
        F.coalesce(group("_head", 3, 4), "value").alias("message"),
    )
    bodied = split.select(
        "*",
        F.nullif(F.regexp_extract("message", body, 1), F.lit("")).alias("body"),
        F.regexp_replace("message", body, "").alias("_rest"),
    )
    asked = bodied.select("*", _groups("_rest", _REQUEST, 3).alias("_request"))
    millis = number(" ([0-9.]+)ms(?: |$)").try_cast("double") / 1000
    return asked.select(
        *kept,
        "ts",
        "level",
        "service",
        group("_request", 0, 3).alias("method"),
        group("_request", 1, 3).alias("path"),
        group("_request", 2, 3).cast("int").alias("status"),
        F.coalesce(number(" elapsed=([0-9.]+)s").try_cast("double"), millis).alias("elapsed_s"),
        number(" patient_id=([0-9]+)(?![0-9A-Za-z])").try_cast("bigint").alias("patient_id"),
        "body",
        "message",
    )


def read_app_log(spark: SparkSession, path: str) -> DataFrame:
    lines = spark.read.text(path).select(F.col("_metadata.file_path").alias("source"), "value")
    return parse_app_log(lines)


def stream_app_log(spark: SparkSession, path: str) -> DataFrame:
    lines = spark.readStream.format("text").load(path)
    return parse_app_log(lines.select(F.col("_metadata.file_path").alias("source"), "value"))


def read_har(spark: SparkSession, path: str) -> DataFrame:
    """One row per captured request."""
    entries = spark.read.json(path, schema=_HAR, multiLine=True).select(
        F.posexplode("log.entries").alias("position", "e")
    )
    tokens = F.filter("e.request.headers", lambda h: F.lower(h["name"]) == "authorization")
    return entries.select(
        "position",
        F.to_timestamp("e.startedDateTime").alias("started_at"),
        F.col("e.request.method").alias("method"),
        F.col("e.request.url").alias("url"),
        F.get(tokens, F.lit(0))["value"].alias("authorization"),
        F.col("e.response.status").alias("status"),
        F.col("e.response.comment").alias("comment"),
    )


def read_goldset(spark: SparkSession, path: str) -> DataFrame:
    """One row per gold-set case."""
    return spark.read.json(path, schema=_GOLDSET, multiLine=True).select(
        F.posexplode("cases").alias("case_id", "c")
    ).select("case_id", "c.*")


def read_intake_payloads(spark: SparkSession, path: str) -> DataFrame:
    """One JSON payload per line, as text for `writes.validate_intake`."""
    return spark.read.text(path).select(F.col("value").alias("payload"))
