"""Column functions that normalise ticket and article fields."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

from ticketloom import vocab
from ticketloom.functions import edits


def literal_map(entries: dict) -> Column:
    """A constant map column; folded once per plan."""
    return F.create_map(*[F.lit(x) for pair in entries.items() for x in pair])


def lookup(key: Column, entries: dict, default=None) -> Column:
    """Value of ``key`` in a constant map, or ``default``."""
    found = F.element_at(literal_map(entries), key)
    return found if default is None else F.coalesce(found, F.lit(default))


def nonempty(col: Column) -> Column:
    """NULL for the empty string, else the value."""
    return F.nullif(col, F.lit(""))


def first_nonempty(*cols: Column) -> Column:
    """First alias that is neither NULL nor empty."""
    return F.coalesce(*[nonempty(c) for c in cols]) if cols else F.lit(None).cast("string")


@F.pandas_udf(StringType())
def _python_title(values: pd.Series) -> pd.Series:
    return values.str.title()


def normalize_category(col: Column, compat: bool = False) -> Column:
    """Alias map on the trimmed lower-case value, else the title-cased value; NULL and '' give NULL.

    Unknown values are capitalised after white space. ``compat=True`` capitalises the untrimmed value after
    every non-letter, as Python's ``str.title`` does; that form needs a pandas UDF.
    """
    known = F.element_at(literal_map(vocab.CATEGORY_ALIASES), F.lower(F.trim(col)))
    other = _python_title(col) if compat else F.initcap(F.trim(col))
    return F.when(nonempty(col).isNull(), None).otherwise(F.coalesce(known, other))


def normalize_priority(col: Column, compat: bool = False) -> Column:
    """Priority to P1..P4; NULL and '' give NULL, unknown text gives P3.

    A leading digit 1-5, bare or after a ``P``, wins (5 counts as P4). ``compat=True`` uses the alias map alone,
    under which an already normalised ``P1`` turns into P3.
    """
    key = F.lower(F.trim(col))
    mapped = lookup(key, vocab.PRIORITY_ALIASES, vocab.DEFAULT_PRIORITY)
    if not compat:
        digit = F.regexp_extract(key, r"^p?([1-5])([^0-9]|$)", 1)
        mapped = F.when(digit == "", mapped).otherwise(
            F.concat(F.lit("P"), F.least(digit, F.lit("4")))
        )
    return F.when(nonempty(col).isNull(), None).otherwise(mapped)


def priority_prefix(col: Column) -> Column:
    """``P2-High`` -> ``P2``; missing -> P3; a value that does not start with P is kept."""
    return (
        F.when(nonempty(col).isNull(), F.lit(vocab.DEFAULT_PRIORITY))
        .when(col.startswith("P"), F.split_part(col, F.lit("-"), F.lit(1)))
        .otherwise(col)
    )


def article_id(file_name: Column) -> Column:
    """First 16 hex digits of the md5 of the file name."""
    return F.substring(F.md5(file_name), 1, 16)


def queue_for(category: Column) -> Column:
    return lookup(category, vocab.QUEUES, vocab.DEFAULT_QUEUE)


def sla_hours(priority: Column) -> Column:
    return lookup(priority, vocab.SLA_HOURS, vocab.DEFAULT_SLA_HOURS)


def sla_risk(priority: Column, confidence: Column) -> Column:
    """P1 or P2 predicted with confidence above 0.6."""
    return F.coalesce(priority.isin("P1", "P2") & (confidence > 0.6), F.lit(False))


def hours_between(start: Column, end: Column) -> Column:
    return F.timestamp_diff("MICROSECOND", start, end) / F.lit(3_600_000_000)


def clamp_score(col: Column) -> Column:
    """Rubric score limited to 1..5; missing -> 3."""
    return F.greatest(F.lit(1), F.least(F.lit(5), F.coalesce(col, F.lit(vocab.DEFAULT_SCORE))))


def weighted_score(scores: dict[str, Column]) -> Column:
    """Rubric sum; a missing criterion counts as 3."""
    total = F.lit(0.0)
    for name, weight in vocab.RUBRIC_WEIGHTS.items():
        score = scores.get(name, F.lit(None).cast("double"))
        total = total + F.coalesce(score, F.lit(vocab.DEFAULT_SCORE)) * F.lit(weight)
    return total


def hedging_count(text: Column) -> Column:
    """How many of the hedging phrases occur in the text, whatever the case."""
    lowered = F.lower(F.coalesce(text, F.lit("")))
    total = F.lit(0)
    for phrase in vocab.HEDGING_PHRASES:
        total = total + F.contains(lowered, F.lit(phrase.lower())).cast("int")
    return total


def preview(text: Column, size: int = 300) -> Column:
    """The first ``size`` characters, with ``...`` when something was left out."""
    return F.when(F.length(text) > size, F.concat(F.substring(text, 1, size), F.lit("..."))).otherwise(text)


def modification_share(draft: Column, final: Column) -> Column:
    """Edit distance over the longer length, by whole texts of any script."""
    longest = F.greatest(F.length(draft), F.length(final))
    return F.when(longest == 0, F.lit(0.0)).otherwise(edits.edit_distance(draft, final) / longest)


def acceptance_band(share: Column, rejected: Column | None = None) -> Column:
    """as_is / minor (< 20 %) / major / rejected."""
    band = F.when(share == 0, "as_is").when(share < 0.2, "minor").otherwise("major")
    return band if rejected is None else F.when(rejected, "rejected").otherwise(band)
