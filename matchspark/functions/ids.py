"""Sortable 26-letter surrogate ids: 48 bits of time, then 80 bits of entropy."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# The 32 letters, in ascending order.
ALPHABET = "0123456789abcdefghjkmnpqrstvwxyz"

_TIME_LETTERS = 10
_HEX_GROUP = 5  # five hex digits are 20 bits, that is four letters


def _letters(number: Column, count: int) -> list[Column]:
    """The low ``count`` groups of five bits of a BIGINT, highest first."""
    return [
        F.substring(
            F.lit(ALPHABET),
            (F.shiftright(number, 5 * i).bitwiseAND(F.lit(31)) + 1).cast("int"),
            F.lit(1),
        )
        for i in reversed(range(count))
    ]


def encode_id(prefix: str, time: Column, entropy_hex: Column) -> Column:
    """``prefix_`` + time letters + entropy letters; entropy is the first 20 hex digits."""
    letters = _letters(time.cast("bigint"), _TIME_LETTERS)
    for start in range(1, 21, _HEX_GROUP):
        group = F.conv(F.substring(entropy_hex, start, _HEX_GROUP), 16, 10).cast("bigint")
        letters += _letters(group, 4)
    return F.concat(F.lit(prefix + "_"), *letters)


def id_millis(ulid: Column | str) -> Column:
    """The time (ms since the epoch) inside an id."""
    ulid = F.col(ulid) if isinstance(ulid, str) else ulid
    body = F.substring_index(ulid, "_", -1)
    total = F.lit(0).cast("bigint")
    for i in range(1, _TIME_LETTERS + 1):
        value = F.position(F.substring(body, i, 1), F.lit(ALPHABET)) - 1
        total = total * 32 + value
    return total


def _millis(instant: Column) -> Column:
    """Milliseconds since the epoch, rounded to the nearest."""
    return F.floor((F.unix_micros(instant) + 500) / 1000)


def _as_utc(wall: Column) -> Column:
    """A time without zone read as UTC, whatever zone the session has."""
    return F.from_utc_timestamp(
        wall.cast("timestamp_ntz").cast("timestamp"), F.current_timezone()
    )


def random_id(prefix: str) -> Column:
    """A fresh id per row.  Not repeatable: write the rows out before a second use."""
    return encode_id(
        prefix,
        _millis(F.current_timestamp()),
        F.replace(F.uuid(), F.lit("-"), F.lit("")),
    )


def _part(key: Column | str) -> Column:
    """A key's text in which neither a bar nor NULL can be taken for another key."""
    text = (F.col(key) if isinstance(key, str) else key).cast("string")
    text = F.replace(F.replace(text, F.lit("\\"), F.lit("\\\\")), F.lit("|"), F.lit("\\|"))
    return F.coalesce(text, F.lit("\\N"))


def derived_id(prefix: str, at: Column, *key: Column | str, seed: str = "") -> Column:
    """The same id for the same (time, seed, key), so that a job can be run again."""
    text = F.concat_ws("|", F.lit(seed), *[_part(k) for k in key])
    return encode_id(prefix, _millis(_as_utc(at)), F.sha2(text, 256))


def assign_ids(
    df: DataFrame, prefix: str, at: Column, key: list[str], column: str = "id", seed: str = ""
) -> DataFrame:
    """``df`` with a surrogate id derived from the time ``at`` and the key columns."""
    return df.withColumn(column, derived_id(prefix, at, *key, seed=seed))
