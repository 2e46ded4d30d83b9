"""References such as ``t12``, as a report cites them: single, listed or as ranges."""

from __future__ import annotations

from collections.abc import Callable
from string import ascii_lowercase, ascii_uppercase

from pyspark.sql import Column
from pyspark.sql import functions as F

# --- fixed values ---------------------------------------------------------------------------
EN_DASH = "–"
MAX_RANGE_SPAN = 1024
LARGEST_REF = 18446744073709551615


def _lower(text: Column) -> Column:
    return F.translate(text, ascii_uppercase, ascii_lowercase)


def _single(token: Column) -> Column:
    """A token as one reference; a bare number means the reference of that number."""
    lowered = _lower(token)
    return F.when(F.rlike(lowered, F.lit("^[0-9]+$")), F.concat(F.lit("t"), lowered)).otherwise(
        lowered
    )


def _number(token: Column) -> Column:
    """The number of a reference, or NULL for anything else."""
    significant = F.regexp_extract(_lower(token), r"^(?:t\+?)?0*([0-9]+)$", 1)
    value = significant.try_cast("decimal(38,0)")
    return F.when(value <= F.lit(str(LARGEST_REF)).cast("decimal(38,0)"), value)


def _let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body`` of a value that is computed once, however often the body names it."""
    return F.element_at(F.transform(F.array(value), body), 1)


def _expand(token: Column, span_limit: int) -> Column:
    dash = F.instr(token, "-")
    first = _number(F.substring_index(token, "-", 1))
    second = F.when(dash > 0, _number(F.substring(token, dash + 1, F.length(token))))

    def members(ends: Column) -> Column:
        low, high = F.least(ends["a"], ends["b"]), F.greatest(ends["a"], ends["b"])
        span = F.least(high - low, F.lit(span_limit).cast("decimal(38,0)")).cast("int")
        names = F.transform(
            F.sequence(F.lit(0), span),
            lambda i: F.concat(F.lit("t"), (low + i).cast("decimal(38,0)").cast("string")),
        )
        is_range = ends["a"].isNotNull() & ends["b"].isNotNull()
        return F.when(is_range, names).otherwise(F.array(_single(token)))

    return _let(F.struct(first.alias("a"), second.alias("b")), members)


def expand_refs(cited: Column, span_limit: int = MAX_RANGE_SPAN) -> Column:
    """All references a text cites, in cited order and without repeats.

    Lists are separated by commas, semicolons or white space. A range may run either way, with
    a hyphen or en dash, spaces around it allowed; it ends at most span_limit past its lower end. A
    token that is neither is kept, so that it fails the look-up like any unknown reference.
    """
    dashed = F.regexp_replace(F.replace(cited, F.lit(EN_DASH), F.lit("-")), " *- *", "-")
    tokens = F.filter(F.split(dashed, r"(?U)[,;\s]+"), lambda t: t != "")
    return F.array_distinct(F.flatten(F.transform(tokens, lambda token: _expand(token, span_limit))))
