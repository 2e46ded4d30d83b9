"""Checks of the persisted tables; every check returns its violations as (table, rule, key)."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from logsift.functions.masking import leaked_shapes
from logsift.schemas import (
    CLASSIFICATIONS,
    FINDING_STATUSES,
    HEALTH_VERDICTS,
    RUN_STATUSES,
    SEVERITIES,
)

PRIMARY_KEYS = {
    "run": "id",
    "log_template": "template_hash",
    "verdict": "template_hash",
    "finding": "id",
    "api_call": "id",
}
# (table, column, referenced table, referenced column); a verdict may come before its template
FOREIGN_KEYS = [
    ("template_occurrence", "template_hash", "log_template", "template_hash"),
    ("template_occurrence", "run_id", "run", "id"),
    ("finding", "run_id", "run", "id"),
    ("finding", "template_hash", "log_template", "template_hash"),
    ("api_call", "run_id", "run", "id"),
]
DOMAINS = [
    ("run", "id", "status", RUN_STATUSES),
    ("run", "id", "health_verdict", HEALTH_VERDICTS),
    ("verdict", "template_hash", "classification", CLASSIFICATIONS),
    ("finding", "id", "severity", SEVERITIES),
    ("finding", "id", "status", FINDING_STATUSES),
]
# (table, key, rule, condition that must not be false)
RANGES = [
    ("run", "id", "window_order", "window_end >= window_start"),
    ("run", "id", "total_events", "total_events >= 0"),
    ("log_template", "template_hash", "hash_length", "char_length(template_hash) = 64"),
    ("log_template", "template_hash", "total_count", "total_count >= 0"),
    ("log_template", "template_hash", "seen_order", "last_seen >= first_seen"),
    ("template_occurrence", "template_hash", "count", "count >= 0"),
    ("template_occurrence", "template_hash", "window_order", "window_end >= window_start"),
    ("api_call", "id", "input_tokens", "input_tokens >= 0"),
    ("api_call", "id", "output_tokens", "output_tokens >= 0"),
    ("api_call", "id", "cache_write_tokens", "cache_write_tokens >= 0"),
    ("api_call", "id", "cache_read_tokens", "cache_read_tokens >= 0"),
    ("api_call", "id", "latency_ms", "latency_ms >= 0"),
    ("api_call", "id", "estimated_cost_usd", "estimated_cost_usd >= 0"),
]


def _found(rows: DataFrame, table: str, rule: str, key: Column) -> DataFrame:
    return rows.select(
        F.lit(table).alias("table"), F.lit(rule).alias("rule"), key.cast("string").alias("key")
    )


def _all(parts: list[DataFrame]) -> DataFrame:
    return reduce(lambda a, b: a.unionByName(b), parts)


def _rules_in_one_scan(
    tables: dict[str, DataFrame], rules: list[tuple[str, str, str, Column]]
) -> DataFrame:
    """Violations of row rules, with one scan per table for all of its rules."""
    parts = []
    for table, rows in tables.items():
        own = [(key, rule, broken) for t, key, rule, broken in rules if t == table]
        if not own:
            continue
        key = own[0][0]
        broken_rules = F.array_compact(
            F.array(*[F.when(broken, F.lit(rule)) for _, rule, broken in own])
        )
        parts.append(
            rows.select(
                F.lit(table).alias("table"),
                F.explode(broken_rules).alias("rule"),
                F.col(key).cast("string").alias("key"),
            )
        )
    return _all(parts)


def check_domains(tables: dict[str, DataFrame]) -> DataFrame:
    """Values outside of their column's domain; NULL is not a violation."""
    rules = [(t, key, column, ~F.col(column).isin(domain)) for t, key, column, domain in DOMAINS]
    return _rules_in_one_scan(tables, rules)


def check_ranges(tables: dict[str, DataFrame]) -> DataFrame:
    rules = [(t, key, rule, ~F.expr(condition)) for t, key, rule, condition in RANGES]
    return _rules_in_one_scan(tables, rules)


def check_primary_keys(tables: dict[str, DataFrame]) -> DataFrame:
    """Keys that occur more than once; counted inside the tasks first."""
    parts = []
    for table, rows in tables.items():
        if table in PRIMARY_KEYS:
            key = PRIMARY_KEYS[table]
            repeated = rows.groupBy(key).agg(F.count("*").alias("n")).filter("n > 1")
            parts.append(_found(repeated, table, "primary_key", F.col(key)))
    return _all(parts)


def check_foreign_keys(tables: dict[str, DataFrame]) -> DataFrame:
    """Referenced keys that do not exist, each once.

    The referring side is made distinct before the join, so a key that a third of all rows
    refers to is a single row by then.
    """
    parts = []
    for table, column, target, target_column in FOREIGN_KEYS:
        if table in tables and target in tables:
            referred = tables[table].select(F.col(column).alias("_key")).dropDuplicates()
            known = tables[target].select(F.col(target_column).alias("_key"))
            dangling = referred.filter(F.col("_key").isNotNull()).join(known, "_key", "left_anti")
            parts.append(_found(dangling, table, f"{column} -> {target}", F.col("_key")))
    return _all(parts)


def all_checks(tables: dict[str, DataFrame]) -> DataFrame:
    return _all(
        [
            check(tables)
            for check in (check_domains, check_ranges, check_primary_keys, check_foreign_keys)
        ]
    )


def redaction_audit(templates: DataFrame) -> DataFrame:
    """Templates that still show a shape masking should have taken."""
    return templates.withColumn("leaked", F.explode(leaked_shapes(F.col("template_text"))))


def redaction_summary(masked: DataFrame) -> DataFrame:
    """Per audited shape: lines that show it, and templates that still do; one pass over both."""

    def marks(text: str, in_line: int, in_template: int) -> Column:
        return F.transform(
            leaked_shapes(F.col(text)),
            lambda shape: F.struct(
                shape.alias("leaked"),
                F.lit(in_line).cast("bigint").alias("lines"),
                F.lit(in_template).cast("bigint").alias("templates"),
            ),
        )

    found = masked.select(F.inline(F.concat(marks("line", 1, 0), marks("template_text", 0, 1))))
    return found.groupBy("leaked").agg(
        F.sum("lines").alias("lines"), F.sum("templates").alias("templates")
    )
