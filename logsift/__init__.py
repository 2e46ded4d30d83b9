"""Spark jobs that turn raw log lines into a ranked, auditable list of problems."""
