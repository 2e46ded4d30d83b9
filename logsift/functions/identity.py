"""Identity of a log line: service, logger, and the hash that names its template."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# --- fixed values ---------------------------------------------------------------------------
SERVICE_LABELS = ["compose_service", "container_name"]
UNKNOWN_SERVICE = "unknown"
SYSTEM_JOB = "system"
SYSTEM_SERVICE = "system"
SYSTEM_LOGGER = "syslog"
LOGGER_KEYS = ["logger", "target", "logger_name", "module"]
# program name of "<Mon> <day> <time> <host> <program>[<pid>]:"
SYSLOG_PROGRAM = r"(?U)^\S+\s+\d+\s+[\d:]+\s+\S+\s+([\w./-]+?)(?:\[\d+\])?:"


def service_from_labels(labels: Column) -> Column:
    known = [F.try_element_at(labels, F.lit(name)) for name in SERVICE_LABELS]
    return F.coalesce(*known, F.lit(UNKNOWN_SERVICE))


def service_from_syslog(line: Column) -> Column:
    program = F.nullif(F.regexp_extract(line, SYSLOG_PROGRAM, 1), F.lit(""))
    return F.coalesce(program, F.lit(SYSTEM_SERVICE))


def json_document(line: Column) -> Column:
    """The line as a one-element variant array if it could be one JSON object, else NULL.

    The parser accepts anything after a complete value. Inside brackets a tail that does not
    close them is an error, and ``is_single_object`` rules out the tails that do.
    """
    bracketed = F.concat(F.lit("["), line, F.lit("]"))
    return F.when(F.rlike(line, F.lit(r"^[ \t\r\n]*\{")), F.try_parse_json(bracketed))


def is_single_object(line: Column, document: Column) -> Column:
    """Whether the whole line is exactly one JSON object.

    A tail after the object can only slip past the array brackets by starting with ``]`` and
    past an object wrapper by starting with ``}``; it cannot do both.
    """
    wrapped = F.concat(F.lit('{"x":'), line, F.lit("}"))
    return (
        F.schema_of_variant(document).startswith("ARRAY<OBJECT<")
        & F.try_variant_get(document, "$[1]", "variant").isNull()
        & (~F.contains(line, F.lit("]")) | F.try_parse_json(wrapped).isNotNull())
    )


def _text_field(document: Column, key: str) -> Column:
    value = F.try_variant_get(document, f"$[0].{key}", "variant")
    return F.when(
        F.schema_of_variant(value) == "STRING", F.try_variant_get(document, f"$[0].{key}", "string")
    )


def add_logger(df: DataFrame) -> DataFrame:
    """Logger of each line: a marker for the system job, else the first text-valued logger key
    of a line that is one JSON object, else empty."""
    line, document = F.col("line"), F.col("_json")
    named = F.coalesce(*[_text_field(document, key) for key in LOGGER_KEYS])
    docker_logger = F.when(document.isNotNull() & is_single_object(line, document), named)
    is_system = F.col("job") == SYSTEM_JOB
    return (
        df.withColumn("_json", F.when(~is_system, json_document(line)))
        .withColumn(
            "logger",
            F.when(is_system, F.lit(SYSTEM_LOGGER)).otherwise(
                F.coalesce(docker_logger, F.lit(""))
            ),
        )
        .drop("_json")
    )


def add_service(df: DataFrame) -> DataFrame:
    return df.withColumn(
        "service_name",
        F.when(F.col("job") == SYSTEM_JOB, service_from_syslog(F.col("line"))).otherwise(
            service_from_labels(F.col("labels"))
        ),
    )


def add_identity(df: DataFrame) -> DataFrame:
    return add_logger(add_service(df))


def template_hash(service: Column, logger: Column, template: Column) -> Column:
    """SHA-256 over the three parts, kept apart by NUL so no two triples share a text."""
    parts = [F.coalesce(part, F.lit("")) for part in (service, logger, template)]
    return F.coalesce(F.sha2(F.concat_ws("\0", *parts), 256), F.lit(""))
