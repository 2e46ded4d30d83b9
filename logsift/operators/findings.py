"""From model reports to findings that point at templates and carry a status."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from logsift.functions.refs import expand_refs
from logsift.functions.severity import severity_rank
from logsift.schemas import MODEL_RESPONSE, REPORT_TOOL

# Finding ids are the run's number followed by the finding's place in its report.
IDS_PER_RUN = 1_000_000_000
REQUIRED = ["summary", "total_events", "health", "findings"]
REQUIRED_IN_FINDING = [
    "template_ref",
    "severity",
    "service",
    "issue",
    "count",
    "first_seen",
    "last_seen",
]

# --- fixed values: what a finding of several templates says, around their names ----------------
GROUPED_BEFORE, GROUPED_AFTER = " (Grouped finding: also covers ", ".)"


def _complete(report: Column) -> Column:
    whole = F.lit(True)
    for name in REQUIRED:
        whole = whole & report[name].isNotNull()

    def lacks_something(finding: Column) -> Column:
        lacks = F.lit(False)
        for name in REQUIRED_IN_FINDING:
            lacks = lacks | finding[name].isNull()
        return lacks

    return whole & ~F.coalesce(F.exists(report["findings"], lacks_something), F.lit(False))


def decode_reports(responses: DataFrame) -> DataFrame:
    """Each response with its report, NULL where there is none or it lacks a required field.

    The report is the input of the first block that calls the report tool.
    """
    decoded = responses.withColumn("_response", F.from_json("response_json", MODEL_RESPONSE))
    calls = F.filter(
        "_response.content", lambda b: (b["type"] == "tool_use") & (b["name"] == REPORT_TOOL)
    )
    return (
        decoded.withColumn("report", F.get(calls, F.lit(0))["input"])
        .withColumn("report", F.when(_complete(F.col("report")), F.col("report")))
        .select("run_id", "report")
    )


def parse_reports(decoded: DataFrame) -> DataFrame:
    return decoded.filter(F.col("report").isNotNull()).select("run_id", "report.*")


def failed_reports(decoded: DataFrame) -> DataFrame:
    return decoded.filter(F.col("report").isNull()).select("run_id")


def explode_findings(reports: DataFrame) -> DataFrame:
    """One row per reported finding; ``finding_no`` keeps the report's order, from 0."""
    return reports.select("run_id", F.posexplode("findings").alias("finding_no", "f")).select(
        "run_id", F.col("finding_no").cast("bigint"), "f.*"
    )


def cited_refs(findings: DataFrame) -> DataFrame:
    """One row per reference a finding cites, in cited order."""
    return findings.select(
        "run_id",
        "finding_no",
        F.posexplode(expand_refs(F.col("template_ref"))).alias("position", "ref"),
    ).withColumn("position", F.col("position").cast("bigint"))


def resolve_refs(findings: DataFrame, refs: DataFrame) -> DataFrame:
    """Every finding with the template of its first cited reference that was sent.

    Other sent references are named in the issue; those not sent are passed over. A finding
    that cites nothing sent gets no template.
    """
    sent = refs.select("run_id", F.col("template_ref").alias("ref"), "template_hash")
    resolved = (
        cited_refs(findings)
        .join(sent, ["run_id", "ref"])
        .groupBy("run_id", "finding_no")
        .agg(
            F.min_by("template_hash", "position").alias("template_hash"),
            F.sort_array(F.collect_list(F.struct("position", "ref"))).alias("_sent"),
        )
        .withColumn("_others", F.transform(F.expr("slice(_sent, 2, size(_sent))"), lambda s: s["ref"]))
        .drop("_sent")
    )
    grouped = F.concat(
        F.col("issue"),
        F.lit(GROUPED_BEFORE),
        F.array_join("_others", ", "),
        F.lit(GROUPED_AFTER),
    )
    return (
        findings.join(resolved, ["run_id", "finding_no"], "left")
        .withColumn("issue_text", F.when(F.size("_others") > 0, grouped).otherwise(F.col("issue")))
        .drop("_others")
    )


def kept_findings(resolved: DataFrame) -> DataFrame:
    return resolved.filter(F.col("template_hash").isNotNull()).select(
        (F.col("run_id") * IDS_PER_RUN + F.col("finding_no")).alias("id"),
        "run_id",
        "template_hash",
        "severity",
        F.col("issue_text").alias("issue"),
        "recommendation",
    )


def rejected_findings(resolved: DataFrame) -> DataFrame:
    """Findings that cite nothing that was sent, with the text they cited."""
    return resolved.filter(F.col("template_hash").isNull()).select(
        "run_id", "finding_no", "template_ref", "issue"
    )


def _per_run(findings: DataFrame) -> DataFrame:
    """The last severity of each template in each run; reduces a hot template to one row a run."""
    return findings.groupBy("template_hash", "run_id").agg(
        F.max_by("severity", "id").alias("severity")
    )


def latest_prior_severity(findings: DataFrame) -> DataFrame:
    """Per template and run with findings: the severity in the latest earlier run."""
    by_run = Window.partitionBy("template_hash").orderBy("run_id")
    return (
        _per_run(findings)
        .withColumn("prior_severity", F.lag("severity").over(by_run))
        .select("template_hash", "run_id", "prior_severity")
    )


def _status(severity: Column, prior: Column) -> Column:
    return (
        F.when(prior.isNull(), F.lit("new"))
        .when(severity_rank(severity) > severity_rank(prior), F.lit("escalating"))
        .otherwise(F.lit("recurring"))
    )


def finding_status(findings: DataFrame) -> DataFrame:
    """All findings with their status against the runs before theirs."""
    prior = latest_prior_severity(findings)
    return (
        findings.join(prior, ["template_hash", "run_id"])
        .withColumn("status", _status(F.col("severity"), F.col("prior_severity")))
        .drop("prior_severity")
    )


def status_against(new: DataFrame, stored: DataFrame) -> DataFrame:
    """New findings with their status against the latest other run stored for the template.

    Findings of the same run never see each other. The two latest stored runs per template are
    enough: one of them is another run.
    """
    latest = Window.partitionBy("template_hash").orderBy(F.col("run_id").desc())
    two = (
        _per_run(stored)
        .withColumn("_rank", F.row_number().over(latest))
        .filter("_rank <= 2")
        .select("template_hash", F.col("run_id").alias("other_run"), F.col("severity").alias("s"))
    )
    prior = (
        new.select("template_hash", "run_id")
        .dropDuplicates()
        .join(two, "template_hash")
        .filter(F.col("other_run") != F.col("run_id"))
        .groupBy("template_hash", "run_id")
        .agg(F.max_by("s", "other_run").alias("prior_severity"))
    )
    return (
        new.join(prior, ["template_hash", "run_id"], "left")
        .withColumn("status", _status(F.col("severity"), F.col("prior_severity")))
        .drop("prior_severity")
    )


# --- fixed values: words a claim of a crash or signal must quote ------------------------------
EVIDENCE_WORDS = [
    "SIGINT",
    "SIGTERM",
    "SIGKILL",
    "SIGSEGV",
    "SIGABRT",
    "Received signal",
    "forwarding signal",
    "Out of memory",
    "oom-killer",
    "Killed process",
    "segfault",
    "core dumped",
    "panic:",
    "Shutting down",
    "Stopping worker",
    r"Worker \S+ stopped",
]
QUOTE_LENGTH = 20


# A quote holds this many pieces of GRAM characters in a row; the one with the smallest hash stands for it.
GRAM = 11
WINDOW = QUOTE_LENGTH - GRAM + 1


def minimisers(text: str) -> Column:
    """(gram, left, right) of the pieces that stand for the quotes of a text, by winnowing.

    Of every WINDOW pieces in a row the one with the smallest hash is taken, the first of equal ones. Two
    texts with a common quote take the same piece of it, and of all pieces about two in eleven are taken.
    left and right are what a quote may have on either side of the piece. A shorter text has none.
    """
    whole = F.col(text)

    def gram(at: Column) -> Column:
        return F.struct(F.xxhash64(F.substring(whole, at, F.lit(GRAM))).alias("h"), at.alias("at"))

    def picked(grams: Column) -> Column:
        starts = F.sequence(F.lit(1), F.size(grams) - WINDOW + 1)
        return F.array_distinct(F.transform(starts, lambda i: F.array_min(F.slice(grams, i, WINDOW))))

    def shown(x: Column) -> Column:
        before = F.greatest(x["at"] - WINDOW + 1, F.lit(1))
        return F.struct(
            F.substring(whole, x["at"], F.lit(GRAM)).alias("gram"),
            F.substring(whole, before, x["at"] - before).alias("left"),
            F.substring(whole, x["at"] + GRAM, F.lit(WINDOW - 1)).alias("right"),
        )

    # the outer function binds the pieces, so that they are not hashed anew for each window
    every = F.transform(F.sequence(F.lit(1), F.length(whole) - GRAM + 1), gram)
    found = F.transform(F.array(every), lambda grams: F.transform(picked(grams), shown))[0]
    return F.when(F.length(whole) >= QUOTE_LENGTH, found)


def _same_quote() -> Column:
    """Whether both sides of a common piece agree for as long as a quote is."""

    def agree(taken: Column) -> Column:
        rest = F.lit(WINDOW - 1) - taken
        return (
            (F.length("s_left") >= taken)
            & (F.length("o_left") >= taken)
            & (F.length("s_right") >= rest)
            & (F.length("o_right") >= rest)
            & (F.right("s_left", taken) == F.right("o_left", taken))
            & (F.left("s_right", rest) == F.left("o_right", rest))
        )

    return F.exists(F.sequence(F.lit(0), F.lit(WINDOW - 1)), agree)


def quote_evidence_check(findings: DataFrame, occurrences: DataFrame) -> DataFrame:
    """Findings that name such a word, and whether they quote a sample line that holds it.

    A quote is any 20 characters of the issue that stand in one of the template's sample lines,
    of which there are a fixed few. The pieces that stand for the quotes of both meet in a join, and what
    is around them is compared; so the work grows with the lengths of issue and samples, not with their
    product, and few of their pieces are shuffled.
    """
    words = "|".join(EVIDENCE_WORDS)
    claims = findings.filter(F.rlike("issue", F.lit(words)))
    keys = ["run_id", "template_hash", "gram"]
    said = claims.select("id", "run_id", "template_hash", F.inline(minimisers("issue"))).distinct()
    said = said.withColumnsRenamed({"left": "s_left", "right": "s_right"})
    shown = (
        occurrences.select("run_id", "template_hash", F.explode("exemplar_lines").alias("sample"))
        .join(claims.select("run_id", "template_hash").distinct(), ["run_id", "template_hash"], "left_semi")
        .filter(F.rlike("sample", F.lit(words)))
        .select("run_id", "template_hash", F.inline(minimisers("sample")))
        .distinct()
        .withColumnsRenamed({"left": "o_left", "right": "o_right"})
    )
    quoting = said.join(shown, keys).filter(_same_quote()).select("id").distinct()
    return claims.join(quoting.withColumn("_found", F.lit(True)), "id", "left").select(
        "id", "run_id", "template_hash", F.coalesce("_found", F.lit(False)).alias("has_evidence")
    )
