"""Request parameters as columns: page limit, feed switches, provider, reaction."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from matchspark.schemas import PROVIDERS, REACTION_TYPES, REACTOR_TYPES

DEFAULT_LIMIT = 50
MAX_LIMIT = 100
DEFAULT_PROVIDER = "google"


def _col(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


def page_limit(text: Column | str) -> Column:
    """Limit text -> 1..100; absent, unreadable or non-positive text gives 50."""
    text = _col(text)
    number = F.when(text.rlike(r"\A[+-]?[0-9]+\z"), text.try_cast("bigint"))
    return (
        F.when(number > 0, F.least(number, F.lit(MAX_LIMIT)))
        .otherwise(F.lit(DEFAULT_LIMIT))
        .cast("int")
    )


def exclude_reacted(text: Column | str) -> Column:
    """Only the exact text 'false' shows items already reacted to."""
    return F.coalesce(_col(text), F.lit("")) != "false"


def part_switched_off(text: Column | str) -> Column:
    """Only the exact text 'true' leaves a feed part out."""
    return F.coalesce(_col(text), F.lit("")) == "true"


def normalise_provider(text: Column | str) -> Column:
    """Absent or '' -> the default provider, a known one -> itself, else NULL (an error)."""
    text = F.coalesce(_col(text), F.lit(""))
    return F.when(text == "", F.lit(DEFAULT_PROVIDER)).when(text.isin(PROVIDERS), text)


def valid_reaction_type(text: Column | str) -> Column:
    return F.coalesce(_col(text).isin(REACTION_TYPES), F.lit(False))


def valid_reactor_type(text: Column | str) -> Column:
    return F.coalesce(_col(text).isin(REACTOR_TYPES), F.lit(False))
