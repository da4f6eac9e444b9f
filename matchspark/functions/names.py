"""Clean names and 'about' texts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

NAME_MAX = 128
ABOUT_MAX = 500

# Unicode white space that trimming removes.
WHITE_SPACE = (
    r"\t\n\x0B\f\r \x{85}\x{A0}\x{1680}\x{2000}-\x{200A}\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}"
)
# Tags to strip, and the letters allowed.
TAGS = r"<[^>]*>"
ALLOWED = r"\A[a-zA-Z\t\n\f\r '-]+\z"

FORBIDDEN_CHARS = "forbidden_chars"
TOO_LONG = "too_long"


def trim_white_space(text: Column) -> Column:
    return F.regexp_replace(text, rf"\A[{WHITE_SPACE}]+|[{WHITE_SPACE}]+\z", "")


def _clean(df: DataFrame, text: str, longest: int, value: str, error: str) -> DataFrame:
    bare = F.regexp_replace(trim_white_space(F.col(text)), TAGS, "")
    fault = F.when(~F.coalesce(F.col("_bare").rlike(ALLOWED), F.lit(False)), FORBIDDEN_CHARS).when(
        F.length("_bare") > longest, TOO_LONG
    )
    # Of the letters allowed only the apostrophe has an HTML escape.
    escaped = F.replace(F.col("_bare"), F.lit("'"), F.lit("&#39;"))
    # Columns of their own, so that each regular expression runs once per row.
    return (
        df.withColumn("_bare", bare)
        .withColumn(error, fault)
        .withColumn(value, F.when(F.col(error).isNull(), escaped))
        .drop("_bare")
    )


def clean_names(
    df: DataFrame, text: str, value: str = "value", error: str = "error"
) -> DataFrame:
    """``df`` with the cleaned name, or why it is refused."""
    return _clean(df, text, NAME_MAX, value, error)


def clean_abouts(
    df: DataFrame, text: str, value: str = "value", error: str = "error"
) -> DataFrame:
    """``df`` with the cleaned text, or why it is refused."""
    return _clean(df, text, ABOUT_MAX, value, error)
